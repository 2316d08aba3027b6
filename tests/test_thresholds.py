"""Thresholds of predictions in rounds: labels, sweeps and runs that go on where one was interrupted."""

import random

from pyspark.sql import functions as F

from textmend.functions import spaces as SP
from textmend.operators import thresholds as TH


def by_hand(said, due):
    """Cases of one place, and the sums at a threshold of 0."""
    due, false, out = set(due), set(), []
    for ins, p in said:
        if ins in due:
            due.remove(ins)
            out.append((p, 1, 0, 0))
        elif (not ins) in false:
            false.remove(not ins)
            out.append((p, 0, -1, 0))
        else:
            false.add(ins)
            out.append((p, 0, 1, 0))
    return out + [(-1.0, 0, 0, 1)] * len(due)


def test_labels_by_hand(spark):
    rnd, said, truth, want = random.Random(8), [], [], []
    for key in range(20):
        for k in range(12):
            s = [(rnd.random() < 0.5, rnd.randint(0, 100) / 100) for _ in range(rnd.randint(0, 5))]
            due = [x for x in (True, False) if rnd.random() < 0.4]
            said += [(key, k, r, ins, p) for r, (ins, p) in enumerate(s)]
            truth += [(key, k, x) for x in due]
            want += [(key, *c) for c in by_hand(s, due)]
    predicted = spark.createDataFrame(said, "seq_id int, k int, round int, insertion boolean, p double")
    got = TH.labelled(predicted, spark.createDataFrame(truth, "seq_id int, k int, insertion boolean"), "seq_id")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    swept = {r.t: (r.tp, r.fp, r.fn) for r in TH.sweep(TH.state_of(predicted.select("seq_id").distinct(), got, "seq_id")).collect()}
    for t, sums in swept.items():
        above = [c for c in want if c[1] >= t]
        assert sums == (sum(c[2] for c in above), sum(c[3] for c in above), sum(c[2] + c[4] for c in want) - sum(c[2] for c in above))


def test_an_interrupted_run_goes_on(spark, tmp_path):
    sequences = spark.range(40).select(F.col("id").alias("seq_id"))
    worked = []

    def cases_of(rows):
        worked.append(rows.count())
        return rows.where("seq_id % 5 != 0").select("seq_id", ((F.col("seq_id") % 7) / 7).alias("p"), (F.col("seq_id") % 2).cast("int").alias("tp"), (1 - F.col("seq_id") % 2).cast("int").alias("fp"), F.lit(0).alias("fn"))

    whole = TH.sweep(TH.resumed(str(tmp_path / "whole"), sequences, cases_of)).collect()
    TH.resumed(str(tmp_path / "parts"), sequences.where("seq_id < 13"), cases_of)
    TH.resumed(str(tmp_path / "parts"), sequences.where("seq_id < 29"), cases_of)
    parts = TH.sweep(TH.resumed(str(tmp_path / "parts"), sequences, cases_of))
    assert sorted(parts.collect()) == sorted(whole) and worked == [40, 13, 16, 11]
    top = TH.best(parts).first()
    assert top.f1 == max(r.f1 for r in whole) and top.t == max(r.t for r in whole if r.f1 == top.f1)


def test_rounds_see_what_the_round_before_did(spark):
    """A gap of no known context stays; others follow their neighbours' states, and nothing is left of empty texts."""
    model = spark.createDataFrame([("a|bc", "20", 0.9), ("ab|c", "12", 0.8)], "context string, around string, p double")
    rows = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "x")], "seq_id long, text string")
    gaps = TH.neighbourhoods(rows, ["seq_id"], F.col("text"))
    got = [tuple(r) for r in TH.predictions(gaps, model, "seq_id", 5).orderBy("round", "k").collect()]
    assert got[:2] == [(1, 1, 0, True, 0.9), (1, 2, 1, True, 0.8)]  # the second space comes once the first is there
    assert {r[0] for r in got} == {1}


def test_rounds_in_chunks_equal_rounds_on_rows_of_gaps(spark):
    """No gap is a row of a shuffle: a chunk's texts are, and the result is that of windows over all gaps."""
    rng = random.Random(3)
    spaced = lambda m: "".join(c + " " * (rng.random() < 0.3) for c in m).strip()
    merged = ["".join(rng.choice("ab😀") for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    rows = spark.createDataFrame([(i, spaced(m), spaced(m)) for i, m in enumerate(merged)], "seq_id long, true string, corrupt string")
    model = TH.shares(TH.neighbourhoods(rows.where("seq_id < 20"), ["seq_id"], F.col("true")), "seq_id")
    gaps = TH.neighbourhoods(rows, ["seq_id"], F.col("corrupt"), {"o": SP.gaps(F.col("true"))})
    truth = gaps.where("o != gap").select("seq_id", "k", F.col("o").alias("insertion"))
    want = TH.state_of(rows, TH.labelled(TH.predictions(gaps, model, "seq_id", 3), truth, "seq_id"), "seq_id")
    made = TH.state_in_chunks(rows, TH.shares_around(rows.where("seq_id < 20"), "true"), "true", "corrupt", "seq_id", 3)
    got = sorted(map(tuple, made.collect()))
    assert got == sorted(map(tuple, want.collect())) and sum(r[3] < 0 for r in got) > 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
