"""Changes of text at drawn places: weighted choices from tables, changes that do not overlap, and the text they give.

A change is a struct (at, size, new): size units from place at on (from 0) give way to new; size 0 puts new in before them.
Units are characters or tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmend.functions.arrays import let, number_up_to, running_max, running_sums

#: Into how many parts the rows of one key are dealt before they meet its choices.
SALTS = 16


def choices(table: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """(key, total, ends, values): each key's distinct values in order, and the running sums of their weights (whole numbers;
    rows of nulls or of no positive weight say nothing)."""
    added = table.where(F.col(key).isNotNull() & F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(F.col(key).alias("key"), F.col(value).alias("v")).agg(F.sum(F.col(weight).cast("long")).alias("w"))
    listed = added.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("v", "w"))).alias("l"))
    return listed.select("key", F.col("l")["v"].alias("values"), running_sums(F.col("l")["w"]).alias("ends")).withColumn("total", F.element_at("ends", -1))


def chosen(values: Column, ends: Column, x: Column) -> Column:
    """The value whose share of the weights holds x, 0 <= x < total."""
    return F.get(values, number_up_to(ends, x))


def with_choices(rows: DataFrame, found: DataFrame, key: str, prefix: str, salt: Column) -> DataFrame:
    """Rows with a key's choices as {prefix}_values, _ends, _total, null where it has none. A hot key's rows are dealt by salt,
    so that no task gets all of them."""
    dealt = found.select(F.col("key").alias(key), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), *[F.col(c).alias(f"{prefix}_{c}") for c in ("values", "ends", "total")])
    return rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(dealt, [key, "_salt"], "left").drop("_salt")


def settled(edits: Column) -> Column:
    """Of changes in order of their places, from left to right those that begin where the last one kept has ended. Only
    changes that could overlap are folded together, so the work is linear."""

    def folded(part: Column) -> Column:
        begin = F.struct(F.lit(0).alias("end"), F.slice(part, 1, 0).alias("kept"))

        def add(a: Column, e: Column) -> Column:
            end = (e["at"] + e["size"]).cast("int")
            return F.when(e["at"] >= a["end"], F.struct(end.alias("end"), F.concat(a["kept"], F.array(e)).alias("kept"))).otherwise(a)

        return F.aggregate(part, begin, add, lambda a: a["kept"])

    def parted(m: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(m["e"]) - 1), lambda i: (i == 0) | (F.get(m["e"], i)["at"] >= F.get(m["ends"], i - 1)))
        return let(firsts, lambda f: F.flatten(F.transform(f, lambda s, k: folded(F.slice(m["e"], s + 1, F.coalesce(F.get(f, k + 1), F.size(m["e"])) - s)))))

    with_ends = F.struct(edits.alias("e"), running_max(F.transform(edits, lambda e: e["at"] + e["size"])).alias("ends"))
    return F.when(F.size(edits) == 0, edits).otherwise(let(with_ends, parted))


def applied(units: Column, edits: Column, between: str = "") -> Column:
    """The text that units give after changes in order that do not overlap; null changes are none."""

    def written(m: Column) -> Column:
        e = m["e"]
        end = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1)["at"] + F.get(e, i - 1)["size"]).cast("int")
        parts = F.transform(e, lambda x, i: let(end(i), lambda b: F.concat(F.slice(m["u"], b + 1, x["at"].cast("int") - b), F.array(x["new"]))))
        last = F.element_at(e, -1)
        rest = let((last["at"] + last["size"]).cast("int"), lambda b: F.slice(m["u"], b + 1, F.greatest(F.size(m["u"]) - b, F.lit(0))))
        return F.array_join(F.concat(F.flatten(parts), rest), between)

    return F.when(F.coalesce(F.size(edits), F.lit(0)) <= 0, F.array_join(units, between)).otherwise(let(F.struct(units.alias("u"), edits.alias("e")), written))


def edited(rows: DataFrame, edits: DataFrame, key: str, units: Column, between: str = "") -> DataFrame:
    """Rows with noisy, the text after the changes (key, at, size, new) given for them, and n_edits. Keys are unique; a null
    text stays null."""
    listed = edits.groupBy(key).agg(settled(F.sort_array(F.collect_list(F.struct("at", "size", "new")))).alias("_edits"))
    joined = rows.join(listed, key, "left")
    return joined.select(*rows.columns, applied(units, F.col("_edits"), between).alias("noisy"), F.coalesce(F.size("_edits"), F.lit(0)).cast("long").alias("n_edits")).withColumn(
        "n_edits", F.greatest("n_edits", F.lit(0).cast("long")))
