"""Queries on language models, spelling noise and repair by search."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from textmend.functions import batches
from textmend.functions import text as T
from textmend.operators import evaluate as E
from textmend.operators import language_model as LM
from textmend.operators import lookup as L
from textmend.operators import search as R
from textmend.operators import stats as S
from textmend.operators.lineage import checkpoint
from textmend.plans.corpus import LINES, STUMPED, lines
from textmend.plans.repair import noisy, rounded

QUERIES, ORACLE_SQL = {}, {}
#: Fixed value: characters of the longest word that a segmentation looks for.
LONGEST = 20


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


GRAMS = "g4 as (select lang, substr(t, i, 4) as gram, count(*) as cnt from (select lang, t, unnest(range(1, length(t) - 2)) as i from (select lang, repeat(chr(2), 3) || text || chr(3) as t from lines)) group by 1, 2), c4 as (select gram, sum(cnt) as cnt from g4 group by 1)"
MODEL = "c3 as (select substr(gram, 2) as gram, sum(cnt) as cnt from c4 group by 1), c2 as (select substr(gram, 2) as gram, sum(cnt) as cnt from c3 group by 1), c1 as (select substr(gram, 2) as gram, sum(cnt) as cnt from c2 group by 1), p1 as (select gram, (cnt + 5.0 / 256) / ((select sum(cnt) from c1) + 5.0) as p from c1), " + ", ".join(
    f"x{n} as (select substr(gram, 1, {n - 1}) as context, sum(cnt) as n from c{n} group by 1), p{n} as (select gram, (cnt + 5.0 * p) / (n + 5.0) as p from (select a.gram, a.cnt, x.n, s.p from c{n} a join x{n} x on x.context = substr(a.gram, 1, {n - 1}) join p{n - 1} s on s.gram = substr(a.gram, 2)))" for n in (2, 3, 4))


@query(f"with {LINES}, {GRAMS} select gram, cast(cnt as bigint) as cnt from c4")
def char_lm_counts(spark, sf_dir):
    return LM.counts(lines(spark, sf_dir))


@query(f"with {LINES}, {GRAMS}, {MODEL} select gram, cast(cnt as bigint) as cnt, round(p, 6) as p from p4 join c4 using (gram)")
def char_lm_probabilities(spark, sf_dir):
    return rounded(LM.probabilities(LM.counts(lines(spark, sf_dir))))


@query(f"with {LINES}, {GRAMS}, {MODEL} select lang, cast(sum(cnt) as bigint) as n, round(pow(2, -sum(cnt * log2(p)) / sum(cnt)), 4) as perplexity from g4 join p4 using (gram) group by 1")
def lm_perplexity(spark, sf_dir):
    by_lang = checkpoint(LM.grams(lines(spark, sf_dir), ["lang"]).groupBy("lang", "gram").agg(F.count("*").alias("cnt")))
    model = LM.probabilities(by_lang.groupBy("gram").agg(F.sum("cnt").alias("cnt")))
    return LM.perplexity(by_lang, model, "lang").select("lang", "n", F.round("perplexity", 4).alias("perplexity"))


@query(f"with {LINES}, {GRAMS}, r as (select gram, cnt, row_number() over (partition by substr(gram, 1, 3) order by cnt desc, gram) - 1 as rank from c4) select cast(rank as bigint) as rank, cast(sum(cnt) as bigint) as n from r where rank < 10 group by 1")
def topk_rank_histogram(spark, sf_dir):
    """How often the character that comes next is the model's first, second, ... guess."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.substring("gram", 1, 3)).orderBy(F.desc("cnt"), "gram")
    ranked = LM.counts(lines(spark, sf_dir)).withColumn("rank", (F.row_number().over(w) - 1).cast("long"))
    return ranked.where("rank < 10").groupBy("rank").agg(F.sum("cnt").alias("n"))


def exact_edits(a: Column, b: Column) -> Column:
    """Edit distance without a bound; bounded ones, which are quick, come first and give way where they end."""
    near = [F.nullif(F.levenshtein(a, b, k), F.lit(-1)) for k in (50, 500, 5000)]
    return F.coalesce(*near, F.levenshtein(a, b)).cast("long")


#: For ``by_words``: spans at the edges of the text's words.
EDGES = object()
#: Characters of a chunk for grams: the more, the fewer of its grams are new.
GRAM_CHARACTERS = 1 << 20


def noisy_chunks(spark, sf_dir, characters: int = L.MANY) -> DataFrame:
    """The lines with noise and their chunk, worked out wherever they are used: written, the texts are several times the input."""
    return L.dealt(noisy(spark, sf_dir).select("seq_id", "lang", "correct", "corrupt"), "seq_id", size(spark, sf_dir), characters)


def size(spark, sf_dir) -> int:
    """Characters of all lines; noise hardly changes it."""
    return lines(spark, sf_dir).agg(F.sum(F.length("text"))).first()[0] or 0


def scores(predicted: DataFrame) -> DataFrame:
    """Scores by language."""
    return rounded(E.summary(E.error_counts(predicted, ["seq_id", "lang"]), ["lang"]))


#: What ``E.counter`` makes of a chunk's rows.
COUNTED = [StructField("lang", StringType()), *[StructField(n, LongType()) for n in batches.COUNTS]]


def by_grams(rows: DataFrame, counted: DataFrame, text: str, make, asked=L.grams_asked, use=None, fields=None) -> DataFrame:
    """rows repaired by the function that ``make`` builds from a model; the counts come from joins with all grams. asked: the keys that
    a chunk's texts need. use, fields: as in ``L.repaired``."""
    table = checkpoint(L.gram_table(counted))
    common = L.mostly(table)
    return L.repaired(rows, text, L.found(rows, text, asked, table, common=common), lambda found: make(LM.Model.of(found)), common=common, use=use, fields=fields)


def by_words(rows: DataFrame, documents: DataFrame, text: str, function, spans, pairs: bool = False, sized: bool = False, many: bool = False, use=None, fields=None) -> DataFrame:
    """rows repaired by a function of the counts of words and of pairs, the number of all words, and a text. The counts come
    from joins with all words, and with all bigrams where ``pairs`` are asked for. sized: the function also gets the number of
    characters of the longest word. spans: None for all of up to LONGEST characters, or of the words' sizes if sized; EDGES for those
    that end or begin with a word of the text: the function then gets a dictionary to keep what it has worked out in a chunk.
    many: the function gets the counts, the number and all texts of a chunk. use, fields: as in ``L.repaired``."""
    u = checkpoint(S.token_counts(documents))
    total, longest, n = u.agg(F.sum("cnt"), F.max(F.length("key")), F.count("*")).first()
    every, edges = spans is None, spans is EDGES
    spans, more = None if every or edges else spans(longest or 0), (longest or 1,) * sized
    common = L.mostly(u) if edges or every else None
    if edges:
        # a pair can be asked for only if together it is a word, or stands between spaces
        counts = L.found_edges(rows, text, u, checkpoint(S.pair_counts(documents, made_up(rows, text, u, n, total))) if pairs else None, common)
    else:
        counts = checkpoint(L.found_spans(rows, text, u, None if sized else LONGEST) if every else L.found(rows, text, L.words_asked(spans), u))
        common = None
        if pairs:
            b = checkpoint(S.pair_counts(documents))
            counts = counts.unionAll(L.found(rows, text, L.known_pairs_asked(LONGEST) if every else L.pairs_asked(spans), b, counts))

    def make(found: dict[str, int]):
        u = {k: n for k, n in found.items() if " " not in k}
        b = {tuple(k.split(" ")): n for k, n in found.items() if " " in k}
        if many:
            return lambda texts: function(u, b, total, texts)
        known = ({},) if edges else ()
        if every:
            known = (sorted({len(k) for k in u if len(k) > 1}, reverse=True),) if sized else (L.heads_of(u, LONGEST),)
        return L.each(lambda t: function(u, b, total, t, *more, *known))

    return L.repaired(rows, text, counts, make, common=common, use=use, fields=fields)


def made_up(rows: DataFrame, text: str, u: DataFrame, n: int, total: int):
    """Which neighbours among tokens make up a word of u, or what stands between spaces in the texts."""
    words, snippets = L.SpanFilter(u, n), L.SnippetFilter(rows.select(text), total or 0)

    def wanted(tokens: list[str]) -> np.ndarray:
        ends = np.cumsum([len(t) for t in tokens], dtype=np.int64)
        out = np.zeros(max(0, len(tokens) - 1), np.bool_)
        if len(out):
            h = L.span_hashes("".join(tokens))(np.concatenate(([0], ends[:-2])), ends[1:])
            for known in (words, snippets):
                out[known.may_hold(h)] = True
        return out

    return wanted


def with_model(spark, sf_dir, make, asked=L.grams_asked):
    rows = noisy_chunks(spark, sf_dir, GRAM_CHARACTERS)
    counts = by_grams(rows, LM.counts(lines(spark, sf_dir)), "corrupt", make, asked, E.counter(["lang"]), COUNTED)
    return rounded(E.summary(E.judged(counts), ["lang"]))


def with_words(spark, sf_dir, function, spans=None, pairs: bool = False, sized: bool = False, many: bool = False):
    """Scores by language; the rules for marks come last."""
    use = E.counter(["lang"], batches.postprocess)
    counts = by_words(noisy_chunks(spark, sf_dir), lines(spark, sf_dir), "corrupt", function, spans, pairs, sized, many, use, COUNTED)
    return rounded(E.summary(E.judged(counts), ["lang"]))


@query()
def beam_repair(spark, sf_dir):
    """Beam search under the character model with the one set of penalties for all benchmarks."""
    p_insert, p_delete = R.PENALTIES["ONE"][""]
    return with_model(spark, sf_dir, lambda m: partial(R.beam_search_many, m, p_insert=p_insert, p_delete=p_delete), L.one_space_grams_asked)


@query()
def greedy_repair(spark, sf_dir):
    return with_model(spark, sf_dir, lambda m: L.each(partial(R.greedy, m)))


@query()
def iterative_window_repair(spark, sf_dir):
    return with_model(spark, sf_dir, lambda m: L.each(partial(R.iterative_window, m)))


@query()
def viterbi_repair(spark, sf_dir):
    return with_words(spark, sf_dir, lambda u, b, n, text, heads: R.viterbi(u, b, n, text, LONGEST, heads), pairs=True)


@query()
def maximum_matching_repair(spark, sf_dir):
    return with_words(spark, sf_dir, lambda u, b, n, text, longest, sizes: R.maximum_matching(u, text, longest, sizes), sized=True)


@query()
def left_to_right_repair(spark, sf_dir):
    return with_words(spark, sf_dir, R.left_to_right_many, EDGES, pairs=True, many=True)


@query()
def fewest_non_words_repair(spark, sf_dir):
    return with_words(spark, sf_dir, lambda u, b, n, text, heads: R.fewest_non_words(u, text, LONGEST, heads))


@query()
def unigram_repair(spark, sf_dir):
    return with_words(spark, sf_dir, R.unigram_corrector_many, EDGES, pairs=True, many=True)


@query()
def bigram_postprocess_repair(spark, sf_dir):
    return with_words(spark, sf_dir, R.bigram_postprocess_many, EDGES, pairs=True, many=True)


@query()
def window_fixer_repair(spark, sf_dir):
    return with_words(spark, sf_dir, R.window_fixer_many, EDGES, many=True)


@query()
def two_pass_repair(spark, sf_dir):
    """Beam search forward, then backward on what came out, with a model of the reversed lines."""
    p_insert, p_delete = R.PENALTIES["UNI+"]["Wiki"]
    beams = lambda m: partial(R.beam_search_many, m, p_insert=p_insert, p_delete=p_delete)
    forward = by_grams(noisy_chunks(spark, sf_dir, GRAM_CHARACTERS), LM.counts(lines(spark, sf_dir)), "corrupt", beams, L.one_space_grams_asked)
    turned = checkpoint(forward.withColumn("turned", F.reverse("predicted")).drop("predicted"))  # the search is done once
    backward = LM.counts(lines(spark, sf_dir).select(F.reverse("text").alias("text")))
    fixed = by_grams(L.dealt(turned, "seq_id", size(spark, sf_dir), GRAM_CHARACTERS), backward, "turned", beams, L.one_space_grams_asked)
    return scores(fixed.withColumn("predicted", F.reverse("predicted")))


@query(f"with {LINES}, {GRAMS.replace('|| text ||', '|| reverse(text) ||')}, {MODEL} select lang, cast(sum(cnt) as bigint) as n, round(pow(2, -sum(cnt * log2(p)) / sum(cnt)), 4) as perplexity from g4 join p4 using (gram) group by 1")
def backward_perplexity(spark, sf_dir):
    """Perplexity of a model that reads from the end."""
    by_lang = LM.grams(lines(spark, sf_dir).select("lang", F.reverse("text").alias("text")), ["lang"]).groupBy("lang", "gram").agg(F.count("*").alias("cnt"))
    model = LM.probabilities(by_lang.groupBy("gram").agg(F.sum("cnt").alias("cnt")))
    return LM.perplexity(by_lang, model, "lang").select("lang", "n", F.round("perplexity", 4).alias("perplexity"))


_WORDS = r"select distinct unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_'']*')) as token from {0}"


@query(f"""with {LINES}, w as ({_WORDS.format('benchmark')}), d as ({_WORDS.format('lines')}), {STUMPED.format('ws', 'w')}, {STUMPED.format('ds', 'd')},
 p as (select a.token as word, b.token as other, min(case when a.token = b.token then 0 when a.i = 0 or b.i = 0 or a.i = b.i then 1 else 2 end) as distance from ws a join ds b using (stump) group by 1, 2) select word, other, cast(distance as bigint) as distance, cast(case when distance > 1 then 2 else distance end as bigint) as banded from p""")
def levenshtein_pairs(spark, sf_dir):
    """Edit distances of the benchmark's words and documents' words that are the same but for at most one character each, and
    those cut off above 1."""
    words = lambda df: df.select(F.explode(T.words(F.col("text"))).alias("token")).distinct()
    w = S.stumps(words(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))).withColumnRenamed("token", "word")
    pairs = w.join(S.stumps(words(lines(spark, sf_dir))).withColumnRenamed("token", "other"), "stump").select("word", "other").distinct()
    near = F.levenshtein("word", "other", 1)
    return pairs.select("word", "other", F.levenshtein("word", "other").cast("long").alias("distance"), F.when(near < 0, 2).otherwise(near).cast("long").alias("banded"))
