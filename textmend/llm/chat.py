"""Chat formatting with prefix-target expansion.

A conversation becomes one formatted string: for each turn ``<|turn|>role<|says|>text<|end|>``. Every assistant turn is
an example of its own: the string up to and with that turn, in which only that turn's text is under the loss mask. As
all examples of a conversation are prefixes of its string, they travel as offsets (end, target start, target end);
``examples`` expands them, a row for each assistant turn with its context and its target.

Control strings inside roles and texts are escaped by one more backslash behind their first character, which can be
undone exactly, whatever the text holds.

Built-in functions only: no Python runs on the executors. One conversation is one row, as its digest and its last
example hold all of it.

Edge cases: null texts and roles count as empty; turns are ordered by turn, then role, then text, so ties and repeated
rows have one order; conversations without assistant turns have no examples and an empty loss text; an empty table
yields an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template, and what is escaped: its own control strings and those of other common templates.
TURN, SAYS, END, ASSISTANT = "<|turn|>", "<|says|>", "<|end|>", "assistant"
_CONTROL = r"(<|\[)(\\*)(\||/?s>|/?INST\]|/?SYS\])"
_ESCAPED = r"(<|\[)\\(\\*)(\||/?s>|/?INST\]|/?SYS\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, examples array<struct<example, end, target_start, target_end>>): offsets count code points
    from 0, ends are exclusive. Offsets are running sums over a conversation's turns; turns are shuffled once."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    rows = rows.select("conv_id", "turn", "role", "text", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS)).alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + len(END)
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    target = F.col("role") == ASSISTANT
    rows = rows.select("conv_id", "head", "body", target.alias("target"), F.sum(size).over(so_far).alias("end"), (F.count_if(target).over(so_far) - 1).cast("int").alias("example"))
    stop = (F.col("end") - len(END)).cast("int")
    example = F.struct("example", F.col("end").cast("int").alias("end"), (stop - F.length("body")).alias("target_start"), stop.alias("target_end"))
    pieces = F.sort_array(F.collect_list(F.struct("end", F.concat("head", "body", F.lit(END)).alias("piece"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("formatted"), F.sort_array(F.collect_list(F.when(F.col("target"), example))).alias("examples"))


def examples(formatted: DataFrame, keep: list[str] | None = None, outer: bool = False) -> DataFrame:
    """(keep, example, context, target): one row for each assistant turn, its context all that stands before it; only target
    is trained on. outer: a conversation without examples keeps a row of nulls. keep: ["conv_id"] unless given."""
    rows = formatted.select(*(keep or ["conv_id"]), "formatted", (F.explode_outer if outer else F.explode)("examples").alias("e"))
    cut = lambda a, b: F.substring("formatted", a + 1, b - a)
    return rows.select(*(keep or ["conv_id"]), F.col("e.example").alias("example"), cut(F.lit(0), F.col("e.target_start")).alias("context"), cut(F.col("e.target_start"), F.col("e.target_end")).alias("target"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted string."""
    quoted = lambda s: s.replace("|", r"\|")
    pieces = F.filter(F.split(formatted, quoted(END), -1), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(
        unescape(F.substring(F.substring_index(x, SAYS, 1), F.lit(len(TURN) + 1), F.length(x))).alias("role"), unescape(F.substring_index(x, SAYS, -1)).alias("text")))
