"""Cleaning and splitting of lines, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what counts as white space. Java's \s lacks the no-break and other Unicode spaces.
WS = r"[\s\x1C-\x1F\x85\xA0  -     　]"
WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_']*"
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"
PRETOKEN = r"\p{N}+(?:[.,]\p{N}+)*|\p{L}+(?:-\p{L}+)*(?:['’][stm]\b)?|\s+|[^\s\p{L}\p{N}]"
#: Fixed value: signs of a sentence that is no prose.
BAD_SENTENCE = r' [.,;:!?)] |[(] |<|>|""|\(\)| \' |\([,;]|colspan'


def unify_spaces(text: Column) -> Column:
    """Runs of any white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def preprocess(text: Column) -> Column:
    """No-break spaces to spaces, ends trimmed, runs of spaces to one."""
    return F.regexp_replace(F.trim(F.translate(text, "\u00a0", " ")), " {2,}", " ")


def remove_spaces(text: Column) -> Column:
    return F.translate(text, " ", "")


def match_key(text: Column) -> Column:
    """Without spaces and hyphens."""
    return F.translate(text, " -", "")


def unify_quotes(text: Column) -> Column:
    return F.translate(text, "‘’“”", "''\"\"")


def fix_old_print(text: Column) -> Column:
    """Long s and ligatures spelled out; no space before closing marks nor after opening ones."""
    for old, new in (("ſ", "s"), ("ﬁ", "fi"), ("ﬀ", "ff"), ("ﬃ", "ffi")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(F.regexp_replace(text, "[ ]+([,;?!:)”])", "$1"), "([(“])[ ]+", "$1")


def remove_hyphenation(text: Column) -> Column:
    """Hyphen and space between two letters go."""
    return F.regexp_replace(text, r"(?<=\p{L})[-‑] (?=\p{L})", "")


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def separate_characters(text: Column) -> Column:
    """A space between all neighbours that are no spaces."""
    return F.regexp_replace(text, "(?<=[^ ])(?=[^ ])", " ")


def is_number(text: Column) -> Column:
    return text.try_cast("double").isNotNull()


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """array<struct<token, delimiter_before>>: runs of letters, of digits, and single other signs. The first counts as
    delimited."""
    found = F.regexp_extract_all(text, F.lit(rf"\s?(?:{TOKEN})"), F.lit(0))
    return F.transform(found, lambda t, i: F.struct(F.ltrim(t).alias("token"), ((i == 0) | t.rlike(r"^\s")).alias("delimiter_before")))


def pretokens(text: Column) -> Column:
    """Runs of spaces, words and numbers, and single signs; marks inside numbers, hyphens inside words and 's, 't, 'm stay."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


#: Abbreviations that end no sentence, with the space behind them.
ABBREVIATED = r"(\b(?:e\.g|i\.e|et al|al|cf|vs|Fig|fig|Eq|No|no|Dr|Mr|Mrs|Ms|St|approx)\.) "


def sentences(text: Column) -> Column:
    """A line's sentences: cut behind . ! ? and a space, but not behind abbreviations; ends trimmed."""
    held = F.regexp_replace(text, ABBREVIATED, "$1\x01")
    return F.transform(F.split(F.regexp_replace(held, r"([.!?]) ", "$1\n"), "\n"), lambda s: F.trim(F.translate(s, "\x01", " ")))


#: Where a run of words that single spaces part begins or ends. A pattern of the run itself would go one level deeper for each word.
_RUN_ENDS = r"(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N} ]| [^\p{L}\p{N}]| $)|(?<=[^\p{L}\p{N} ]|[^\p{L}\p{N}] |^ )(?=[\p{L}\p{N}])"


def pieces(text: Column) -> Column:
    """Runs of words that single spaces part, and what stands between them; joined, they are the text."""
    return F.filter(F.split(text, _RUN_ENDS), lambda p: p != "")


def editable_runs(text: Column) -> Column:
    """Words that single spaces part, as one run."""
    return F.filter(pieces(text), lambda p: p.rlike(r"^[\p{L}\p{N}]"))


def character_set_tokens(text: Column) -> Column:
    """Tokens of one set of characters (letters, digits, all else), with the space behind them."""
    return F.regexp_extract_all(text, F.lit(r"(?:[A-Za-z]+|[0-9]+|[^A-Za-z0-9 ]+) ?| "), F.lit(0))


def stripped(token: Column) -> dict[str, Column]:
    """prefix and suffix of marks, the word between them, and whether six tenths of it are letters."""
    part = lambda k: F.regexp_extract(token, r"(?s)^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$", k)
    word = part(2)
    letters = F.length(F.regexp_replace(word, r"[^\p{L}]", ""))
    return {"prefix": part(1), "word": word, "suffix": part(3), "is_word": (letters >= 0.6 * F.length(word)) & (word != "")}


def without_end_hyphens(token: Column) -> Column:
    """Hyphens at the end go; of a token of hyphens one stays."""
    rest = F.regexp_replace(token, "-+$", "")
    return F.when(rest == "", F.substring(token, 1, 1)).otherwise(rest)


def encoded(text: Column, known: Column) -> Column:
    """array<bigint>: place of each character in the array of known ones, from 3 on; 2 is unknown, 1 and 0 are begin and end."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.array_position(known, c) + 2)


def decoded(codes: Column, known: Column) -> Column:
    return F.array_join(F.transform(codes, lambda x: F.coalesce(F.get(known, (x - 3).cast("int")), F.lit("?"))), "")


def padded(codes: Column, size: int, with_: int, front: bool = False) -> Column:
    """Cut or filled to a size: the head, filled behind, or in front the tail, filled before."""
    fill = F.array_repeat(F.lit(with_).cast("long"), size)
    return F.slice(F.concat(fill, codes), -size, size) if front else F.slice(F.concat(codes, fill), 1, size)


def lines(documents: DataFrame) -> DataFrame:
    """(seq_id, doc_id, lang, source, text): the non-empty lines; seq_id is doc_id * 10^6 + line."""
    split = documents.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return split.where("text <> ''").select((F.col("doc_id") * 1_000_000 + F.col("line")).alias("seq_id"), "doc_id", "lang", "source", "text")


def paragraphs(numbered: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Lines to paragraphs: (key, para, text). Blank lines part them; lines of one are joined with a space."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    marked = numbered.withColumn("para", F.sum((F.col(text) == "").cast("long")).over(w)).where(F.col(text) != "")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), " ")
    return marked.groupBy(key, "para").agg(joined.alias("text"))


def hyphen_islands(numbered: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Lines that end with a hyphen joined to those that follow: (key, island, first, n_lines, text, sizes). sizes holds the
    number of characters that are no spaces of each line, so that ``unmerge`` can cut a repaired text again."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    begins = 1 - F.coalesce(F.lag(F.col(text).endswith("-").cast("int")).over(w), F.lit(0))
    marked = numbered.withColumn("_begins", begins).withColumn("island", F.sum("_begins").over(w))
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    grouped = marked.groupBy(key, "island").agg(ordered.alias("l"))
    return grouped.select(key, "island", F.col("l")[0]["o"].alias("first"), F.size("l").cast("long").alias("n_lines"), F.array_join(F.transform("l", lambda x: x["t"]), "").alias("text"),
                          F.transform("l", lambda x: F.length(F.translate(x["t"], " ", ""))).alias("sizes"))


def unmerge(text: Column, sizes: Column) -> Column:
    """Cut a repaired text so that each piece has its size of characters that are no spaces; spaces at cuts go."""
    begin = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("out"))

    def cut(a: Column, n: Column) -> Column:
        piece = F.coalesce(F.regexp_substr(a["rest"], F.concat(F.lit("^ *(?:[^ ] *){"), n.cast("string"), F.lit("}"))), F.lit(""))
        return F.struct(F.substring(a["rest"], F.length(piece) + 1, F.length(a["rest"])).alias("rest"), F.concat(a["out"], F.array(F.trim(piece))).alias("out"))

    return F.aggregate(sizes, begin, cut, lambda a: a["out"])
