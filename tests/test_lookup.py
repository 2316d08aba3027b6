"""Repair with counts joined from whole tables against repair with all counts at hand."""

import random

from pyspark.sql import functions as F

from textmend.functions import spaces as SP
from textmend.functions import text as T
from textmend.operators import language_model as LM
from textmend.operators import lookup, search, stats
from textmend.plans import preparation
from textmend.plans import search as plans
from tests.conftest import SF


def sample(spark):
    rows = T.lines(spark.read.parquet(f"{SF}/documents.parquet")).where("length(text) < 200 and seq_id % 5 = 0").select("seq_id", "text").limit(120)
    rows = rows.unionAll(spark.createDataFrame([(-1, ""), (-2, " a  b "), (-3, None), (-4, "thequick  brownfox é𝒳")], "seq_id long, text string"))
    return rows.withColumn("corrupt", SP.corrupt(F.col("text"), F.col("seq_id"), 0.1, 0.3, 5)).localCheckpoint()


def predicted(df):
    return {r.seq_id: r.predicted for r in df.collect()}


def test_rare_counts_are_looked_up(spark):
    """Beyond 100,000 words and 200,000 bigrams the rarest still count."""
    counts = spark.range(250_000).select(F.concat(F.lit("w"), "id").alias("key"), F.lit(1).cast("long").alias("cnt"))
    rows = lookup.chunked(spark.createDataFrame([(i, f"w{i * 1000}") for i in range(250)], "seq_id long, corrupt string"), "seq_id", "corrupt", 100)
    found = lookup.found(rows, "corrupt", lookup.words_asked(lookup.word_spans(20)), counts)
    assert {f"w{i * 1000}" for i in range(250)} <= {r.key for r in found.collect()}


def test_words_equal_whole_dictionaries(spark):
    rows = sample(spark)
    documents = T.lines(spark.read.parquet(f"{SF}/documents.parquet"))
    uni = {r.token: r.cnt for r in stats.merged_unigrams(stats.unigrams(documents)).collect()}
    bi = {(r.left, r.right): r.cnt for r in stats.bigrams(documents).collect()}
    total = sum(uni.values())
    chunks = lookup.chunked(rows, "seq_id", "corrupt", 3000)
    for function, spans, pairs in (
        (search.viterbi, lambda n: lookup.word_spans(20), True),
        (lambda u, b, n, t: search.left_to_right(u, b, t), lookup.edge_spans, True),
        (lambda u, b, n, t: search.maximum_matching(u, t), lookup.word_spans, False),
        (lambda u, b, n, t: search.fewest_non_words(u, t), lambda n: lookup.word_spans(20), False),
        (lambda u, b, n, t: search.unigram_corrector(u, b, t), lambda n: lookup.neighbour_spans(4), True),
        (lambda u, b, n, t: search.bigram_postprocess(u, b, t), lambda n: lookup.neighbour_spans(2), True),
        (lambda u, b, n, t: search.window_fixer(u, n, t), lambda n: lookup.neighbour_spans(8), False),
    ):
        got = predicted(plans.by_words(chunks, documents, "corrupt", function, spans, pairs))
        assert got == {r.seq_id: None if r.corrupt is None else function(uni, bi, total, r.corrupt) for r in rows.collect()}


def test_grams_equal_the_whole_model(spark):
    rows = sample(spark)
    counted = LM.counts(T.lines(spark.read.parquet(f"{SF}/documents.parquet"))).localCheckpoint()
    model = LM.Model(LM.collected(counted))
    chunks = lookup.chunked(rows, "seq_id", "corrupt", 3000)
    for function in (lambda m, t: search.beam_search(m, t, 6.32, 6.9), search.greedy, search.iterative_window, search.best_first):
        got = predicted(plans.by_grams(chunks, counted, "corrupt", lambda m: lookup.each(lambda t: function(m, t))))
        assert got == {r.seq_id: None if r.corrupt is None else function(model, r.corrupt) for r in rows.collect()}


def test_beams_of_many_texts_equal_those_of_one():
    rng = random.Random(3)
    words = "the cat sat on a mat and then that other cat ran off".split()
    said = " ".join(rng.choice(words) for _ in range(400))
    model = LM.Model({("\x02" * 3 + said + "\x03")[i : i + 4]: 3 for i in range(len(said) + 1)})
    texts = ["", " ", "a", "the  cat", " thecat "] + ["".join(c + " " * (rng.random() < 0.1) for c in " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) if c != " " or rng.random() < 0.7) for _ in range(120)] + ["žluťoučký kůň", "𝒳 y"]
    for beams in (1, 5):
        assert search.beam_search_many(model, texts, 1.2, 0.9, beams, 16) == [search.beam_search(model, t, 1.2, 0.9, beams) for t in texts]


def test_gap_grams_of_many_texts_equal_those_of_each():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é𝒳 ") for _ in range(rng.randrange(12))) for _ in range(300)]
    for some in (texts, [t.replace("  ", " ") for t in texts], [], *[[t] for t in texts[:60]]):
        number, bits = LM.numbered(some)
        assert set(LM.spelled(LM.gap_gram_codes(some, number, bits), number, bits)) == set().union(*map(LM.gap_grams, some))


def test_long_lines_are_repaired_to_their_end():
    model = LM.Model({("\x02" * 3 + "the cat sat " * 50 + "\x03")[i : i + 4]: 50 for i in range(602)})
    text = ("thecat sat " * 260).strip()
    assert search.greedy(model, text) == ("the cat sat " * 260).strip()


def test_words_of_any_length_match():
    word = "electroencephalographically"
    assert search.maximum_matching({word: 3, "is": 5}, f"is{word}is") == f"is {word} is"


def test_matching_keeps_spaces_behind_wide_gaps():
    assert search.maximum_matching({}, "a  bcd e") == "a bcd e" and search.maximum_matching({"bcd": 1}, "  xbcd  e") == "x bcd e"


def test_edits_beyond_fifty_are_counted(spark, tmp_path):
    text = "several plain words to be changed somehow " * 1000
    spark.createDataFrame([(1, "en", "s", text, len(text))], "doc_id long, lang string, source string, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("typo_noise", "hyphen_noise", "ocr_noise", "mixed_noise"):
        assert preparation.QUERIES[name](spark, str(tmp_path)).first().n_changed > 50
    a, b = F.lit("ab" * 3000), F.lit("ba" * 1000 + "cd" * 2000)
    assert spark.range(1).select(plans.exact_edits(a, b) == F.levenshtein(a, b)).first()[0]


def test_letters_beyond_ascii_are_put_in():
    model = LM.Model({("\x02" * 3 + "die tür ist grün " * 50 + "\x03")[i : i + 4]: 50 for i in range(852)})
    assert search.spelling_beam(model, "die tur ist grün", letter_penalty=1.0) == "die tür ist grün"


def test_baselines_on_small_dictionaries():
    u, b = {"the": 50, "cat": 20, "sat": 10, "thecat": 1}, {("the", "cat"): 5}
    assert search.unigram_corrector(u, b, "th e cat") == "the cat" and search.unigram_corrector(u, b, "thecat sat") == "the cat sat"
    assert search.unigram_corrector({"thecat": 5, "the": 1000, "cat": 900}, {("the", "cat"): 3}, "thecat") == "thecat"  # a split counts as its pair does
    assert search.bigram_postprocess(u, b, "thecat s at") == "the cat sat" and search.bigram_postprocess(u, b, "") == ""
    assert search.window_fixer({k: n for k, n in u.items() if k != "thecat"}, 80, "t h e cat s at") == "the cat sat"


def test_beams_do_not_ask_for_wide_gaps(spark, monkeypatch):
    """Texts with wide gaps are not walked through gram by gram, and come out as they do one by one."""
    rows = sample(spark)
    counted = LM.counts(T.lines(spark.read.parquet(f"{SF}/documents.parquet"))).localCheckpoint()
    model = LM.Model(LM.collected(counted))
    texts = [r.corrupt for r in rows.collect() if r.corrupt is not None] + ["a   b c", "   ", "  a", "a  "]
    asked = lookup.one_space_grams_asked(set(texts))
    few = LM.Model.of({k: n for k, n in [("=" + g, n) for g, n in model.count.items()] + [("<" + g, n) for g, n in model.context.items()] if k in asked})

    def walked(text):
        raise AssertionError("walked through")

    monkeypatch.setattr(LM, "gap_grams", walked)
    assert search.beam_search_many(few, texts, 1.2, 0.9) == [search.beam_search(model, t, 1.2, 0.9) for t in texts]


def test_edges_equal_whole_dictionaries(spark):
    """Joins of more words than a window of four, and parts joined with the next word, have their counts too."""
    rows = sample(spark).unionAll(spark.createDataFrame([(-9, "", "i n t e r e s t i n g the  q uick brown f o x")], "seq_id long, text string, corrupt string"))
    documents = T.lines(spark.read.parquet(f"{SF}/documents.parquet")).select("text").unionAll(spark.createDataFrame([("interesting interestingthe in inte inter intere interes",)], "text string"))
    uni = {r.token: r.cnt for r in stats.merged_unigrams(stats.unigrams(documents)).collect()}
    bi = {(r.left, r.right): r.cnt for r in stats.bigrams(documents).collect()}
    total = sum(uni.values())
    chunks = lookup.chunked(rows, "seq_id", "corrupt", 3000)
    for function, pairs in (
        (lambda u, b, n, t, seen: search.left_to_right(u, b, t, seen), True),
        (lambda u, b, n, t, seen: search.unigram_corrector(u, b, t, seen), True),
        (lambda u, b, n, t, seen: search.bigram_postprocess(u, b, t, seen), True),
        (lambda u, b, n, t, seen: search.window_fixer(u, n, t, seen=seen), False),
    ):
        got = predicted(plans.by_words(chunks, documents, "corrupt", function, plans.EDGES, pairs))
        assert got == {r.seq_id: None if r.corrupt is None else function(uni, bi, total, r.corrupt, None) for r in rows.collect()}
