"""Space errors in spans of tokens: consecutive spans of drawn lengths with rates from a distribution, or spans with lengths
and rates from a table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmend.functions.arrays import let, number_up_to, running_sums
from textmend.functions.rng import at_place, row_seed
from textmend.operators.edits import choices, chosen, settled

#: A draw's place is token * STRIDE + character; the space behind a token has the last place.
STRIDE = 1_000_000


def span_ends(n: Column, seed: Column, least: int = 5, most: int = 10) -> Column:
    """array<bigint>: where consecutive spans of least to most of n tokens end, lengths drawn; the last ends at n."""
    lengths = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / least).cast("int")), lambda k: least + F.floor(at_place(seed, k) * (most - least + 1)))
    return let(running_sums(lengths), lambda e: F.transform(F.filter(e, lambda x, k: (k == 0) | (F.get(e, k - 1) < n)), lambda x: F.least(x, n.cast("bigint"))))


def power_law(exponent: Column, u: Column) -> Column:
    """The rate in [0, 1] whose share of the law of density exponent * x^(exponent - 1) is u."""
    return F.pow(u, 1 / exponent)


def fitted_power_law(rates: DataFrame, x: str) -> DataFrame:
    """One row (exponent, p_zero): the likeliest exponent of the rates in (0, 1], and the share of zeros among all rates, to six
    digits. Other rates and nulls say nothing; no positive rate: no exponent, all are zero."""
    v, zeros = F.col(x), F.avg((F.col(x) == 0).cast("double"))
    positive = F.when(v > 0, v)
    return rates.where(v.between(0, 1)).agg(F.round(-F.count(positive) / F.sum(F.log(positive)), 6).alias("exponent"), F.round(F.coalesce(zeros, F.lit(1.0)), 6).alias("p_zero"))


def gamma_quantiles(shape: float, scale: float, n: int = 256) -> list[float]:
    """Quantiles of a gamma distribution at 0, 1/n, ..., (n - 1)/n and 1 - 1/(16 n)."""

    def below(x: float) -> float:  # the lower incomplete gamma function by its series
        term = total = 1 / shape
        k = 1
        while term > total * 1e-15:
            term *= x / (shape + k)
            total, k = total + term, k + 1
        return total * math.exp(shape * math.log(x) - x - math.lgamma(shape))

    def quantile(p: float) -> float:
        low, high = 0.0, 1.0
        while below(high) < p:
            high *= 2
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if middle > 0 and below(middle) < p else (low, middle) if middle > 0 else (low, high)
        return high * scale

    return [0.0] + [quantile(k / n) for k in range(1, n)] + [quantile(1 - 1 / (16 * n))]


def from_quantiles(grid: list[float], u: Column) -> Column:
    """A draw by the inverse of a distribution function that its quantiles at even steps give, linear between them."""
    known, n = F.array(*[F.lit(g) for g in grid]), len(grid) - 1
    at = F.floor(u * n).cast("int")
    return F.get(known, at) + (u * n - at) * (F.get(known, at + 1) - F.get(known, at))


def fitted_spans(rows: DataFrame, rate, seed: int, key: str = "seq_id", text: str = "text") -> DataFrame:
    """Rows with noisy and rates, one for each span of five to ten tokens. rate(u, v): a span's rate of two draws. Inside a
    span, with its rate, a space is put behind a character that none follows, and a space before a token is dropped; spaces
    between spans stay. Null texts stay null, with null rates."""

    def noisy(m: Column) -> Column:
        tokens = m["tokens"]
        n = F.size(tokens)

        def one(t: Column, j: Column) -> Column:
            draw = lambda k: at_place(m["seed"], j.cast("long") * STRIDE + k)

            def spaced(s: Column) -> Column:
                inner = F.array_join(F.transform(F.split(t, ""), lambda c, k: F.when((k + 1 < F.length(t)) & (draw(k) < s["p"]), F.concat(c, F.lit(" "))).otherwise(c)), "")
                dropped = (F.get(tokens, j + 1) != "") & (j + 1 < s["stop"]) & (draw(STRIDE - 1) < s["p"])
                return F.concat(inner, F.when((j + 1 == n) | dropped, "").otherwise(" "))

            return let(number_up_to(m["ends"], j), lambda span: let(F.struct(F.get(m["rates"], span).alias("p"), F.get(m["ends"], span).alias("stop")), spaced))

        return F.array_join(F.transform(tokens, one), "")

    seeded = rows.withColumn("_m", F.struct(F.split(text, " ").alias("tokens"), row_seed(seed, F.col(key)).alias("seed"), span_ends(F.size(F.split(text, " ")), row_seed(seed + 1, F.col(key))).alias("ends")))
    drawn = F.transform(F.col("_m.ends"), lambda e, k: rate(at_place(row_seed(seed + 2, F.col(key)), k), at_place(row_seed(seed + 3, F.col(key)), k)))
    made = seeded.withColumn("rates", F.when(F.col(text).isNotNull(), drawn)).withColumn("_m", F.col("_m").withField("rates", F.col("rates")))
    return made.select(*rows.columns, F.when(F.col(text).isNotNull(), let(F.col("_m"), noisy)).alias("noisy"), "rates")


#: Erroneous spans among spans and tokens without error.
P_ERRONEOUS = 910 / (16229 - 1429 + 910)


def span_table(rates: DataFrame) -> DataFrame:
    """One row of choices of spans (n_tokens, p_insert, p_delete), by how often rates has them. Lengths 1 to 10 and rates to
    two digits: at most 102,010 different ones, whatever the input."""
    percent = lambda c: F.lpad(F.round(F.col(c) * 100).cast("int").cast("string"), 3, "0")
    named = rates.where("n_tokens between 1 and 10 and p_insert between 0 and 1 and p_delete between 0 and 1").select(F.lit("").alias("key"), F.concat(F.lpad(F.col("n_tokens").cast("string"), 2, "0"), percent("p_insert"), percent("p_delete")).alias("v"), F.lit(1).alias("w"))
    return choices(named, "key", "v", "w").groupBy().agg(F.first("values").alias("_values"), F.first("ends").alias("_ends"), F.first("total").alias("_total"))


def empirical_spans(rows: DataFrame, rates: DataFrame, seed: int, p: float = P_ERRONEOUS, key: str = "seq_id", text: str = "text") -> DataFrame:
    """Rows with noisy and n_spans. With p, an erroneous span begins at a token that no span has; its length and its rates are
    drawn from the table (n_tokens, p_insert, p_delete). Inside it, spaces are dropped and put in before characters that no
    space follows; runs of spaces become one. Without a table nothing changes; null texts stay null."""

    def spans(m: Column) -> Column:
        draw = lambda j, k: at_place(m["seed"], j.cast("long") * 4 + k)
        hits = F.filter(F.sequence(F.lit(0), F.size(m["tokens"]) - 1), lambda j: draw(j, 0) < p)
        named = F.transform(hits, lambda j: F.struct(j.alias("at"), chosen(m["values"], m["ends"], draw(j, 1) * m["total"]).alias("v")))
        sized = F.transform(F.filter(named, lambda s: s["v"].isNotNull()), lambda s: F.struct(s["at"].alias("at"), F.substring(s["v"], 1, 2).cast("int").alias("size"), s["v"].alias("new")))
        return settled(sized)

    def noisy(m: Column) -> Column:
        tokens, found = m["tokens"], m["spans"]

        def one(t: Column, j: Column) -> Column:
            draw = lambda k: at_place(m["other"], j.cast("long") * STRIDE + k)

            def spaced(s: Column) -> Column:
                put = lambda k: ((k > 0) | (j > s["at"])) & ((k + 1 < F.length(t)) | s["last"]) & (draw(k) < s["p_insert"])
                inner = F.array_join(F.transform(F.split(t, ""), lambda c, k: F.when(put(k), F.concat(F.lit(" "), c)).otherwise(c)), "")
                behind = F.when((j + 1 == F.size(tokens)) | (s["inside"] & ~s["last"] & (draw(STRIDE - 1) < s["p_delete"])), "").otherwise(" ")
                return F.concat(F.when(s["inside"], inner).otherwise(t), behind)

            def rated(s: Column) -> Column:
                end = s["at"] + s["size"]
                rate = lambda at: F.substring(s["new"], at, 3).cast("int") / 100
                return let(F.struct(s["at"].alias("at"), (j < end).alias("inside"), ((j + 1 == end) | (j + 1 == F.size(tokens))).alias("last"), rate(3).alias("p_insert"), rate(6).alias("p_delete")), spaced)

            return let(F.get(found, number_up_to(m["begins"], j) - 1), rated)

        return F.trim(F.regexp_replace(F.array_join(F.transform(tokens, one), ""), " +", " "))

    table = span_table(rates)
    seeded = rows.crossJoin(F.broadcast(table)).withColumn("_m", F.struct(  # one row of bounded size
        F.split(text, " ").alias("tokens"), row_seed(seed, F.col(key)).alias("seed"), row_seed(seed + 1, F.col(key)).alias("other"), F.col("_values").alias("values"), F.col("_ends").alias("ends"), F.col("_total").alias("total")))
    found = seeded.withColumn("_spans", F.when(F.col(text).isNotNull(), let(F.col("_m"), spans)))
    m = F.struct(F.col("_m.tokens").alias("tokens"), F.col("_m.other").alias("other"), F.col("_spans").alias("spans"), F.transform("_spans", lambda s: s["at"]).alias("begins"))
    return found.select(*rows.columns, F.when(F.col(text).isNotNull(), let(m, noisy)).alias("noisy"), F.when(F.col(text).isNotNull(), F.size("_spans").cast("long")).alias("n_spans"))
