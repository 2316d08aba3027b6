"""Quality rules with robust multivariate outliers.

Base rules reject short and repetitive documents. Of the rest, each language and source gets a minimum covariance
determinant estimate of transformed text statistics, and a document whose Mahalanobis distance from its group's
estimate is too large is rejected. Built-in functions only: no Python runs on the executors.

The estimate starts three times, from medians and floors, from all rows' moments, and from moments of rows drawn in
towards the medians. Concentration steps make each start's subset the rows nearest to its last estimate; of the three
that come of them, the one of least determinant is taken. One step is one aggregation: rows fall into distance bins of
their group, each bin keeps counts and moments, and the bins up to the wanted share of rows give the next mean and
covariance. A group of any size is therefore a set of partial sums, never rows gathered in one task.

Groups of every size are estimated alike: to its own sums each group adds those of ``prior`` typical rows of its language,
and each language those of ``prior`` typical rows of all. A group of thousands is hardly moved, one of a few rows is
measured by its language.

Edge cases: null and empty texts have no words and fail the base rules; a null language or source is a group like any
other; floors on the spread of each statistic keep the covariance regular when all rows of a group tie; an only document
is its own group, language and corpus, and is kept; repeated rows yield repeated result rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmend.functions.arrays import let
from textmend.llm.common import checkpoint, small_side

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT, PRIOR, SUBSET, STEPS = 50, 50, 50, 0.75, 4
#: Statistic: least standard deviation it is given, and the first start's spread in units of it.
FLOORS = {"s_words": 0.5, "s_word_chars": 0.05, "s_symbols": 0.2, "s_dup_lines": 0.1, "s_repeat": 0.08, "s_upper": 0.02}
#: Squared distance beyond which a document is an outlier: the chi-squared quantile (six degrees) of
#: one in 10^12. Statistics of prose have longer tails than normal ones: one in 10^4 (27.9) would reject 0.6 % of the good
#: documents of a labelled set that this quantile keeps all of.
CUTOFF, CHI2_MEDIAN = 69.0, 5.348
BINS_PER_E, TOP_BIN = 12, 240


def repeated_words(words: Column) -> Column:
    """Words in three-word windows found twice or more. Window hashes are sorted with their places, so equal ones are
    neighbours; each place covers three words, less what the place before it has covered."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def some(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(o: Column) -> Column:
            h = lambda k: F.get(o, k)["h"]
            same = F.filter(o, lambda x, k: F.coalesce(x["h"] == h(k - 1), F.lit(False)) | F.coalesce(x["h"] == h(k + 1), F.lit(False)))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        def covered(at: Column) -> Column:
            return F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

        return covered(let(ordered, places))

    return F.when(n < 3, 0).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(some(h)))).cast("long")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts per row, the base verdict and the transformed statistics."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), "")).withColumn(
        "lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    counted = rows.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).alias("n_upper"),
    )
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return counted.select(
        *counted.columns[:8],
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        F.log1p("n_words").alias("s_words"), F.log(F.greatest(chars / n, F.lit(0.1))).alias("s_word_chars"), F.log1p(20 * F.col("n_symbols") / n).alias("s_symbols"),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("s_dup_lines"), (F.col("n_repeat_words") / n).alias("s_repeat"), (F.col("n_upper") / chars).alias("s_upper"),
    )


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance from the columns m_i (means) and w_i_j (inverse of the covariance's Cholesky factor)."""
    total = F.lit(0.0)
    for i in range(len(names)):
        total = total + F.pow(sum((F.col(f"w_{i}_{j}") * (F.col(names[j]) - F.col(f"m_{j}")) for j in range(i + 1)), F.lit(0.0)), 2)
    return total


def _sums(names: list[str], values: list[Column]) -> list[Column]:
    """Count, sums and sums of products: the moments that add up."""
    d = range(len(names))
    return [F.count("*").cast("double").alias("n"), *[F.sum(values[i]).alias(f"x_{i}") for i in d], *[F.sum(values[i] * values[j]).alias(f"xx_{i}_{j}") for i in d for j in range(i + 1)]]


def _with_prior(moments: DataFrame, prior: float) -> DataFrame:
    """Moments (lang, source, start, n, sums) with ``prior`` typical rows of the language added, to whose own ``prior`` of all."""
    sums = [c for c in moments.columns if c not in ("lang", "source", "start")]

    def added(rows: DataFrame, wider: DataFrame, on: list[str]) -> DataFrame:
        typical = wider.select(*on, *[(prior * F.col(c) / F.col("n")).alias(f"_{c}") for c in sums])
        both = rows.join(small_side(checkpoint(typical)), on)
        return both.select(*rows.columns[: -len(sums)], *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums])

    langs = moments.groupBy("lang", "start").agg(*[F.sum(c).alias(c) for c in sums])
    every = langs.groupBy("start").agg(*[F.sum(c).alias(c) for c in sums])
    return added(moments, added(langs, every, ["start"]), ["lang", "start"])


def _factors(moments: DataFrame, names: list[str]) -> DataFrame:
    """Means, inverse Cholesky factors and the logarithm of the determinant from counts and sums, column by column."""
    d, n = len(names), F.col("n")
    out = moments.withColumns({f"m_{i}": F.col(f"x_{i}") / n for i in range(d)})
    out = out.withColumns({f"c_{i}_{j}": F.col(f"xx_{i}_{j}") / n - F.col(f"m_{i}") * F.col(f"m_{j}") + (F.lit(FLOORS[names[i]] ** 2) if i == j else F.lit(0.0)) for i in range(d) for j in range(i + 1)})
    for j in range(d):
        out = out.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(F.col(f"c_{j}_{j}") - sum((F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0)), F.lit(1e-12))))
        out = out.withColumns({f"l_{i}_{j}": (F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l_{j}_{j}") for i in range(j + 1, d)})
    for i in range(d):
        out = out.withColumns({f"w_{i}_{j}": (F.lit(1.0) if i == j else -sum((F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}") for k in range(j, i)), F.lit(0.0))) / F.col(f"l_{i}_{i}") for j in range(i + 1)})
    log_det = 2 * sum((F.log(f"l_{j}_{j}") for j in range(d)), F.lit(0.0))
    return out.select(*GROUP, "start", log_det.alias("log_det"), *_estimate(d))


GROUP = ["lang", "source"]


def _estimate(d: int) -> list[str]:
    return [*[f"m_{i}" for i in range(d)], *[f"w_{i}_{j}" for i in range(d) for j in range(i + 1)]]


def _bin(distance: Column) -> Column:
    """Logarithmic distance bins; everything close to the centre shares the first."""
    return F.least(F.lit(TOP_BIN), F.greatest(F.lit(0), F.floor(BINS_PER_E * F.log(F.greatest(distance, F.lit(1e-9)) / 0.05)))).cast("int")


def medians(rows: DataFrame, names: list[str], parts: int = 16) -> DataFrame:
    """(lang, source, m_*): the middle of the bin that holds a statistic's median; bins are a part of its floor wide. A task
    sends one count for each bin it has met, so what meets at a group has a bound, however many tasks there are."""
    width = {c: FLOORS[c] / parts for c in names}
    placed = F.array(*[F.struct(F.lit(i).alias("at"), F.floor(F.col(c) / width[c]).alias("bin")) for i, c in enumerate(names)])
    bins = rows.select(*GROUP, F.explode(placed).alias("p")).groupBy(*GROUP, "p.at", "p.bin").count()
    each = Window.partitionBy(*GROUP, "at")
    bins = bins.withColumns({"upto": F.sum("count").over(each.orderBy("bin")), "all": F.sum("count").over(each)})
    half = bins.where(2 * F.col("upto") >= F.col("all")).groupBy(*GROUP, "at").agg(F.min("bin").alias("bin"))
    middle = lambda i, c: F.max(F.when(F.col("at") == i, (F.col("bin") + 0.5) * width[c])).alias(f"m_{i}")
    return half.groupBy(*GROUP).agg(*[middle(i, c) for i, c in enumerate(names)])


def starts(rows: DataFrame, names: list[str], prior: float = PRIOR) -> DataFrame:
    """(lang, source, start, estimate): three first estimates of each group."""
    d = len(names)
    middle = checkpoint(medians(rows, names))
    spread = [F.lit(1 / (2 * FLOORS[names[i]]) if i == j else 0.0).alias(f"w_{i}_{j}") for i in range(d) for j in range(i + 1)]
    first = middle.select(*GROUP, F.lit(0).alias("start"), F.lit(0.0).alias("log_det"), *[f"m_{i}" for i in range(d)], *spread)
    placed = rows.join(small_side(middle), GROUP)
    reach = [4 * FLOORS[c] for c in names]
    drawn_in = [F.col(f"m_{i}") + reach[i] * F.tanh((F.col(c) - F.col(f"m_{i}")) / reach[i]) for i, c in enumerate(names)]
    values = F.array(*[F.struct(F.lit(k + 1).alias("start"), *[v.alias(f"v_{i}") for i, v in enumerate(vs)]) for k, vs in enumerate(([F.col(c) for c in names], drawn_in))])
    both = placed.select(*GROUP, F.inline(values)).groupBy(*GROUP, "start").agg(*_sums(names, [F.col(f"v_{i}") for i in range(d)]))
    return first.unionByName(_factors(_with_prior(checkpoint(both), prior), names))


def estimates(rows: DataFrame, names: list[str], subset: float = SUBSET, steps: int = STEPS, prior: float = PRIOR) -> DataFrame:
    """(lang, source, log_det, m_*, w_*, scale): rows has lang, source and the statistics."""
    now = checkpoint(starts(rows, names, prior))
    binned = lambda now: rows.join(small_side(now), GROUP).withColumn("bin", _bin(_distance(names)))
    for _ in range(steps):
        bins = checkpoint(binned(now).groupBy(*GROUP, "start", "bin").agg(*_sums(names, [F.col(c) for c in names])))
        near = bins.join(small_side(checkpoint(_limits(bins, subset, prior))), [*GROUP, "start"])
        sums = [F.sum(F.when(F.col("bin") <= F.col("limit"), F.col(c)).otherwise(0.0)).alias(c) for c in bins.columns if c not in (*GROUP, "start", "bin")]
        now = checkpoint(_factors(_with_prior(checkpoint(near.groupBy(*GROUP, "start").agg(*sums)), prior), names))
    best = now.groupBy(*GROUP).agg(F.min_by(F.struct("start", "log_det", *_estimate(len(names))), F.struct("log_det", "start")).alias("b"))
    now = checkpoint(best.select(*GROUP, "b.*"))
    # the distance that half of the rows keep to, against a normal sample's
    bins = checkpoint(binned(now).groupBy(*GROUP, "start", "bin").agg(F.count("*").cast("double").alias("n")))
    half = _limits(bins.withColumn("start", F.lit(0)), 0.5, prior)
    scale = 0.05 * F.exp((F.col("limit") + 1) / BINS_PER_E) / CHI2_MEDIAN
    return checkpoint(now.join(half.select(*GROUP, F.greatest(F.lit(1.0), scale).alias("scale")), GROUP).drop("start"))


def _limits(bins: DataFrame, share: float, prior: float) -> DataFrame:
    """(lang, source, start, limit): the last bin that a share of the rows keeps to, the group's own and its language's
    weighed by its number of rows and by ``prior``."""

    def last(counts: DataFrame, by: list[str], name: str) -> DataFrame:
        each = Window.partitionBy(*by)
        before = F.coalesce(F.sum("n").over(each.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        upto = counts.select(*by, "bin", before.alias("before"), F.sum("n").over(each).alias("all"))
        return upto.where(F.col("before") < share * F.col("all")).groupBy(*by).agg(F.max("bin").alias(name), F.first("all").alias(f"n_{name}"))

    own = last(bins.select(*GROUP, "start", "bin", "n"), [*GROUP, "start"], "own")
    wider = last(bins.groupBy("lang", "start", "bin").agg(F.sum("n").alias("n")), ["lang", "start"], "wider")
    blend = (F.col("n_own") * F.col("own") + prior * F.col("wider")) / (F.col("n_own") + prior)
    return own.join(small_side(checkpoint(wider)), ["lang", "start"]).select(*GROUP, "start", F.round(blend).cast("int").alias("limit"))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior: float = PRIOR, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, the counts, base_failed, kept, distance), one row per input row; distance is null where the base rules fail."""
    names = list(FLOORS)
    rows = checkpoint(text_statistics(docs, id_col, text_col, lang_col, source_col))
    passed = rows.where(~F.col("base_failed")).select(*GROUP, *names)
    found = estimates(passed, names, prior=prior)
    distance = F.when(~F.col("base_failed"), _distance(names) / F.col("scale"))
    return rows.join(small_side(found), GROUP, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= cutoff)).alias("kept"), distance.alias("distance"),
    )
