"""The row-local operators on streams. They take and return DataFrames without aggregation, so the batch functions run
unchanged; only hyphen continuation needs lines that come later, and keeps the open line of each file as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textmend.functions import text as T
from textmend.operators import rules


def line_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """(file, text) of files as they arrive."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def repaired_stream(lines: DataFrame) -> DataFrame:
    """Lines cleaned and repaired by rules; marker lines that begin with # pass as they are."""
    fixed = rules.character_rules(T.unify_spaces(F.col("text")))
    return lines.withColumn("repaired", F.when(F.col("text").startswith("#"), F.col("text")).otherwise(fixed))


def token_counts(events: DataFrame, time: str, text: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Token counts by window of event time; rows later than the watermark are dropped."""
    tokens = events.withWatermark(time, late).select(F.window(time, window).alias("window"), F.explode(F.split(text, T.WS + "+")).alias("token"))
    return tokens.where("token <> ''").groupBy("window", "token").agg(F.count("*").alias("cnt"))


def _joiner(wait_ms: int):
    def join_open(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else ""
        if state.hasTimedOut:  # nothing has come to continue the last line: it is whole as it is
            state.remove()
            yield pd.DataFrame({"file": [key[0]], "text": [held]})
            return
        out = []
        for text in pd.concat(list(batches)).sort_values("line")["text"]:
            held += text
            if not held.endswith("-"):
                out.append(held)
                held = ""
        if held:
            state.update((held,))
            state.setTimeoutDuration(wait_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"file": [key[0]] * len(out), "text": out})

    return join_open


def joined_hyphens(lines: DataFrame, wait_ms: int = 3_600_000) -> DataFrame:
    """lines: (file, line, text). A line that ends with a hyphen waits for the next of its file; if none comes for so long, as
    at a file's end, it is passed on as it is. Lines of a file must not overtake each other from batch to batch."""
    return lines.groupBy("file").applyInPandasWithState(_joiner(wait_ms), "file string, text string", "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)
