"""Noise whose errors come from tables: weighted errors of scanners, misspellings of a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmend.functions.arrays import let
from textmend.functions.rng import at_place, row_seed
from textmend.operators.edits import choices, chosen, edited, with_choices
from textmend.operators.noise import LETTERS, _letter, _pick

#: What a scanner takes two characters or one for, and the marks it puts in.
CONFUSED = {
    "m": ["iii", "in", "ni", "rn", "rii", "ln", "nl", "tn", "lll"], "n": ["ii", "ll"], "d": ["cl", "(t"], "ü": ["ii", "ll"], "ff": ["tl", "tf"], "b": ["t)"], "p": ["l)", "i)", "1)"], "O": ["()"],
    "c": ["(:", "(-"], "ai": ["M"], "al": ["M"], "fo": ["tb"], "t": ["l,"],
}
ANY = LETTERS + LETTERS.upper() + "0123456789" + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def weighted_errors(rows: DataFrame, table: DataFrame, p: float, p_insert: float, seed: int, key: str = "seq_id", text: str = "text") -> DataFrame:
    """Rows with noisy and n_edits. With p an error stands at a character or at a token's end; with p_insert it puts in
    one of the table's insertions (correct is empty), else one, two or three characters are misread: their errors are pooled and
    drawn by frequency. An error goes on behind what it replaced, and none reaches over a space. Where the table knows nothing
    of the characters, they stay; at a token's end, only an insertion can stand. table: (wrong, correct, freq); pairs with a
    space, or of more than three correct characters, are no errors of characters."""
    usable = table.where((F.length("correct") <= 3) & ~F.col("correct").contains(" ") & ~F.col("wrong").contains(" "))
    found = choices(usable, "correct", "wrong", "freq")
    p_end = p * p_insert / (1 - p + p * p_insert)  # at an end another draw follows until one inserts or none is due

    def drawn(m: Column) -> Column:
        char = lambda i: F.coalesce(F.get(m["chars"], i), F.lit(" "))
        draw = lambda i, k: at_place(m["seed"], i.cast("long") * 4 + k)
        hits = F.filter(F.sequence(F.lit(0), F.size("chars")), lambda i: draw(i, 0) < p)

        def spot(i: Column) -> Column:
            a, b, c = char(i), char(i + 1), char(i + 2)
            end = (a == " ") & (i > 0) & (char(i - 1) != " ")
            inserts = F.when(a == " ", end & (draw(i, 0) < p_end)).otherwise(draw(i, 1) < p_insert)
            reads = ~inserts & (a != " ")
            one = F.when(inserts, F.lit("")).when(reads, a)
            two = F.when(reads & (b != " "), F.concat(a, b))
            three = F.when(reads & (b != " ") & (c != " "), F.concat(a, b, c))
            return F.struct(i.alias("at"), one.alias("one"), two.alias("two"), three.alias("three"), draw(i, 2).alias("u"))

        return F.filter(F.transform(hits, spot), lambda s: s["one"].isNotNull())

    seeded = rows.where(F.col(text) != "").select(key, F.split(text, "").alias("chars"), row_seed(seed, F.col(key)).alias("seed"))
    spots = seeded.select(key, F.inline(let(F.struct("chars", "seed"), drawn)))
    for name in ("one", "two", "three"):
        spots = with_choices(spots, found, name, name, F.col("at"))
    total = {n: F.coalesce(F.col(f"{n}_total"), F.lit(0)) for n in ("one", "two", "three")}
    x = F.col("u") * (total["one"] + total["two"] + total["three"])
    value = lambda n, x: chosen(F.col(f"{n}_values"), F.col(f"{n}_ends"), x)
    in_one, in_two = x < total["one"], x < total["one"] + total["two"]
    new = F.when(in_one, value("one", x)).when(in_two, value("two", x - total["one"])).otherwise(value("three", x - total["one"] - total["two"]))
    size = F.when(in_one, F.length("one")).when(in_two, 2).otherwise(3)
    edits = spots.select(key, "at", size.alias("size"), new.alias("new")).where("new is not null")
    return edited(rows, edits, key, F.split(text, ""))


def random_error(t: Column, draw) -> Column:
    """A letter put in, taken out, replaced or exchanged with the next one, at a place up to the token's end; where there is
    nothing to take, replace or exchange, the token stays. draw(k): random numbers."""
    at = _pick(draw(2), F.length(t) + 1)
    head, here, rest = F.substring(t, F.lit(1), at), F.substring(t, at + 1, F.lit(1)), F.substring(t, at + 2, F.length(t))
    kind = _pick(draw(1), 4)
    swapped = F.when(rest != "", F.concat(head, F.substring(rest, 1, 1), here, F.substring(rest, F.lit(2), F.length(rest)))).otherwise(t)
    return F.when(kind == 0, F.concat(head, _letter(draw(3)), here, rest)).when(kind == 1, F.concat(head, rest)).when((kind == 2) & (here != ""), F.concat(head, _letter(draw(3)), rest)).when(kind == 3, swapped).otherwise(t)


def misspellings(rows: DataFrame, table: DataFrame, p: float, p_random: float, seed: int, key: str = "seq_id", text: str = "text") -> DataFrame:
    """Rows with noisy and n_edits. With p, a token between spaces is misspelt: with 1 - p_random as the table does, drawn by
    frequency, else, or where it does not know the token, by a random error. table: (correct, misspelling, freq). Copies of a
    token draw apart; a hot token's copies are dealt to several tasks."""

    def drawn(m: Column) -> Column:
        draw = lambda i, k: at_place(m["seed"], i.cast("long") * 8 + k)
        hits = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: draw(i, 0) < p)
        one = lambda i: F.get(m["tokens"], i)
        return F.transform(hits, lambda i: F.struct(i.alias("at"), one(i).alias("token"), random_error(one(i), lambda k: draw(i, k)).alias("error"), F.when(draw(i, 4) > p_random, draw(i, 5)).alias("u")))

    seeded = rows.where(F.col(text).isNotNull()).select(key, F.split(text, " ").alias("tokens"), row_seed(seed, F.col(key)).alias("seed"))
    spots = seeded.select(key, F.inline(let(F.struct("tokens", "seed"), drawn)))
    met = with_choices(spots, choices(table, "correct", "misspelling", "freq"), "token", "t", F.col(key) + F.col("at"))
    known = chosen(F.col("t_values"), F.col("t_ends"), F.col("u") * F.col("t_total"))
    edits = met.select(key, "at", F.lit(1).alias("size"), F.coalesce(known, "error").alias("new"))
    return edited(rows, edits, key, F.split(text, " "), " ")


def scanner_errors(text: Column, row: Column, p: float, seed: int) -> Column:
    """array of changes, to be settled and applied: with p at each character, in equal shares a mark is put in before it, it is
    taken out, or it (or it and the next) is misread as any mark or as the table has it. Spaces are neither taken out nor misread."""
    marks = F.array(*[F.lit(c) for c in ANY])
    table = F.create_map(*[x for k, v in CONFUSED.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    none = F.array().cast("array<string>")

    def drawn(m: Column) -> Column:
        draw = lambda i, k: at_place(m["seed"], i.cast("long") * 4 + k)
        hits = F.filter(F.sequence(F.lit(0), F.size(m["chars"]) - 1), lambda i: draw(i, 0) < p)
        change = lambda i, size, new: F.struct(i.alias("at"), size.alias("size"), new.alias("new"))

        def spot(i: Column) -> Column:
            c, kind = F.get(m["chars"], i), _pick(draw(i, 1), 3)
            one = F.coalesce(F.try_element_at(table, c), none)
            two = F.coalesce(F.try_element_at(table, F.concat(c, F.coalesce(F.get(m["chars"], i + 1), F.lit("")))), none)

            def misread(x: Column) -> Column:
                pool = F.concat(marks, x["one"], x["two"])
                at = _pick(draw(i, 2), F.size(pool))
                return change(i, F.when(at < len(ANY) + F.size(x["one"]), 1).otherwise(2), F.get(pool, at))

            return F.when(kind == 0, change(i, F.lit(0), F.get(marks, _pick(draw(i, 2), len(ANY))))).when((kind == 1) & (c != " "), change(i, F.lit(1), F.lit(""))).when(
                (kind == 2) & (c != " "), let(F.struct(one.alias("one"), F.when(F.get(m["chars"], i + 1).isNotNull(), two).otherwise(none).alias("two")), misread))

        return F.filter(F.transform(hits, spot), lambda s: s.isNotNull())

    return F.when(text == "", F.filter(F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit("").alias("new"))), lambda e: F.lit(False))).otherwise(
        let(F.struct(F.split(text, "").alias("chars"), row_seed(seed, row).alias("seed")), drawn))


def masked_typos(text: Column, row: Column, p: float, seed: int) -> Column:
    """struct<text, mask, n_edits>: with p, one edit in a token, of any place and kind; a replacement is another letter. mask has a 0 for each
    character of a token that was drawn, a 1 for all others and for spaces. Tokens of one character are not taken out. row: a
    bigint; a null text gives null."""
    letters = LETTERS + LETTERS.upper()

    def all_of(m: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            draw = lambda k: at_place(m["seed"], i.cast("long") * 8 + k)
            n, kind = F.length(t), _pick(draw(1), 4)
            at = _pick(draw(2), n + F.when(kind == 0, 1).when(kind == 3, -1).otherwise(0))
            head, here, rest = F.substring(t, F.lit(1), at), F.substring(t, at + 1, F.lit(1)), F.substring(t, at + 2, n)
            others = F.replace(F.lit(letters), here)
            other = F.substring(others, _pick(draw(3), F.length(others)) + 1, F.lit(1))
            new = F.when(kind == 0, F.concat(head, _letter(draw(3), letters), here, rest)).when((kind == 1) & (n > 1), F.concat(head, rest)).when((kind == 2) & (n > 0), F.concat(head, other, rest)).when(
                (kind == 3) & (n > 1), F.concat(head, F.substring(rest, 1, 1), here, F.substring(rest, F.lit(2), n))).otherwise(t)
            return F.when(draw(0) < p, F.struct(new.alias("t"), F.lit("0").alias("m"))).otherwise(F.struct(t.alias("t"), F.lit("1").alias("m")))

        mask = lambda x: F.array_join(F.transform(x, lambda y: F.repeat(y["m"], F.length(y["t"]))), "1")
        return let(F.transform(m["tokens"], one), lambda x: F.struct(F.array_join(F.transform(x, lambda y: y["t"]), " ").alias("text"), mask(x).alias("mask"), F.size(F.filter(x, lambda y: y["m"] == "0")).alias("n_edits")))

    return F.when(text.isNotNull(), let(F.struct(F.split(text, " ").alias("tokens"), row_seed(seed, row).alias("seed")), all_of))
