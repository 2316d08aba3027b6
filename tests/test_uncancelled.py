"""Changes by gap that were not taken back."""

import pytest

from textmend.operators import evaluate as E


def test_uncancelled(spark):
    rows = [(1, "a bc", "ab c", "a bc"), (2, "a b", "a  b", "a   b"), (3, "ab", "a b", "a b"), (4, "", " ", ""), (5, None, "a", "a"), (6, "a  b", "a b", "a   b"), (7, "ab", "ab", "a b")]
    got = sorted(map(tuple, E.uncancelled(spark.createDataFrame(rows, "k int, correct string, corrupt string, predicted string"), "k").collect()))
    assert got == [(2, 1, "DELETION"), (2, 1, "DELETION"), (3, 1, "DELETION"), (7, 1, "DELETION")]
    with pytest.raises(Exception, match="more than spaces"):
        E.uncancelled(spark.createDataFrame([(1, "a", "ab", "a")], "k int, correct string, corrupt string, predicted string"), "k").collect()
