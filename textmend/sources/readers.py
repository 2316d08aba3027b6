"""Texts, articles and predictions in and out. Everything is a DataFrame with an explicit line number, as files have no
order once they are split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of each file under path, empty lines included. A file is numbered as a whole in one row."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r?\n$", "").alias("t"))
    return whole.select("file", F.posexplode(F.split("t", "\r?\n")).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


def read_unordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): splittable, for files of any size where the order of lines does not count."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, text) from JSON lines in a tree of folders."""
    return spark.read.schema("id string, title string, text string").option("recursiveFileLookup", True).json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) without a last line that is a run time."""
    rows = read_lines(spark, path)
    last = rows.groupBy("file").agg(F.max("line").alias("last"), F.max_by("text", "line").alias("tail"))
    kept = rows.join(last, "file").where(~((F.col("line") == F.col("last")) & F.col("tail").try_cast("double").isNotNull()))
    return kept.select("file", "line", "text")


def mean_runtimes(spark: SparkSession, path: str) -> DataFrame:
    """(file, seconds per line) where the last line is the total run time."""
    last = read_lines(spark, path).groupBy("file").agg(F.max("line").alias("n"), F.max_by("text", "line").try_cast("double").alias("total"))
    return last.where("total is not null").select("file", (F.col("total") / F.greatest("n", F.lit(1))).alias("seconds"))


def aligned(**tables: DataFrame) -> DataFrame:
    """One row per line that all tables (line, text) have, with a text column for each."""
    out = None
    for name, df in tables.items():
        one = df.select("line", F.col("text").alias(name))
        out = one if out is None else out.join(one, "line")
    return out


def typo_table(spark: SparkSession, path: str) -> DataFrame:
    """(correct, misspelling, freq) from lines ``correct (misspelling freq)+``."""
    parts = spark.read.text(path).select(F.split("value", " ").alias("p"))
    at = F.filter(F.sequence(F.lit(1), F.size("p") - 2), lambda i: i % 2 == 1)
    return parts.where("size(p) >= 3").select(F.col("p")[0].alias("correct"), F.inline(F.transform(at, lambda i: F.struct(F.get("p", i).alias("misspelling"), F.get("p", i + 1).cast("long").alias("freq")))))


def ocr_table(spark: SparkSession, path: str) -> DataFrame:
    """(wrong, correct, freq) from tab-separated files."""
    return spark.read.schema("wrong string, correct string, freq long").option("sep", "\t").option("quote", "").csv(path).na.fill("", ["wrong", "correct"])


def merged_tables(tables: list[tuple[DataFrame, float]]) -> DataFrame:
    """Frequencies of several OCR tables, each with its weight, added up."""
    every = None
    for df, weight in tables:
        weighted = df.select("wrong", "correct", (F.col("freq") * weight).alias("freq"))
        every = weighted if every is None else every.unionAll(weighted)
    return every.groupBy("wrong", "correct").agg(F.sum("freq").alias("freq"))


def write_lines(rows: DataFrame, path: str, key: str = "file") -> None:
    """Lines in a folder for each key, in order inside each file."""
    rows.repartition(key).sortWithinPartitions(key, "line").select(key, "text").write.mode("overwrite").partitionBy(key).text(path)


def write_paragraphs(rows: DataFrame, path: str, most: int = 5000) -> None:
    """Parquet by split, a bounded number of rows a file."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", most).partitionBy("split").parquet(path)


def missing(rows: DataFrame, done: DataFrame, key: str = "seq_id") -> DataFrame:
    """Rows that an earlier run has not written yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def upserted(results: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Result rows of both, the new one where a key is in both."""
    both = results.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new")))
    return both.withColumn("_n", first).where("_n = 1").drop("_n", "_new")


def length_batches(rows: DataFrame, size: int, text: str = "text", key: str = "seq_id") -> DataFrame:
    """rows with ``batch``: rows of equal length in batches of ``size``."""
    place = F.row_number().over(Window.partitionBy(F.length(text)).orderBy(F.md5(F.col(key).cast("string"))))
    return rows.withColumn("batch", F.concat_ws("-", F.length(text).cast("string"), F.floor((place - 1) / size).cast("string")))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): each file under path as one text."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def files_under(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of a tree of folders, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def read_table(spark: SparkSession, path: str, columns: str, sep: str = "\t") -> DataFrame:
    """Separated values without quotes, typed by ``columns`` ("name type, ..."); short rows are filled with nulls."""
    return spark.read.schema(columns).option("sep", sep).option("quote", "").option("header", False).csv(path)


def write_table(rows: DataFrame, path: str, sep: str = "\t") -> None:
    """Separated values with a header; nulls are empty."""
    rows.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def first_lines(rows: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """The first n rows (file, line, text) of each file, or n random ones, the same for a seed everywhere."""
    order = F.col("line") if seed is None else F.md5(F.concat_ws(":", F.lit(str(seed)), "file", F.col("line").cast("string")))
    place = F.row_number().over(Window.partitionBy("file").orderBy(order))
    return rows.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def longest_first(pairs: DataFrame, text: str, n: int) -> DataFrame:
    """The n rows of the longest texts, longest first; ties by the text."""
    return pairs.orderBy(F.desc(F.length(text)), text).limit(n)


def runtime_per_1000(runtimes: DataFrame, by: list[str]) -> DataFrame:
    """(by, seconds): seconds per 1000 characters of rows with seconds and chars."""
    return runtimes.groupBy(*by).agg((1000 * F.sum("seconds") / F.sum("chars")).alias("seconds"))
