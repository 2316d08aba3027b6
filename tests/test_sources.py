"""Readers, writers and the stream with state, on small files."""

import time

from textmend.sources import readers as R
from textmend.streaming import repair as stream


def lines_of(tmp_path, files):
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")


def named(df, *columns):
    return sorted((r.file.rsplit("/", 1)[-1], *[r[c] for c in columns]) for r in df.collect())


def test_lines_and_predictions(spark, tmp_path):
    lines_of(tmp_path, {"a.txt": "one\n\nthree\n2.5\n", "b.txt": "x\r\ny"})
    rows = R.read_lines(spark, str(tmp_path))
    assert named(rows, "line", "text") == [("a.txt", 0, "one"), ("a.txt", 1, ""), ("a.txt", 2, "three"), ("a.txt", 3, "2.5"), ("b.txt", 0, "x"), ("b.txt", 1, "y")]
    assert named(R.read_predictions(spark, str(tmp_path)), "text") == [("a.txt", ""), ("a.txt", "one"), ("a.txt", "three"), ("b.txt", "x"), ("b.txt", "y")]
    assert [round(r.seconds, 6) for r in R.mean_runtimes(spark, str(tmp_path)).collect()] == [round(2.5 / 3, 6)]
    assert named(R.first_lines(rows, 1), "text") == [("a.txt", "one"), ("b.txt", "x")] and R.first_lines(rows, 2, 7).count() == 4
    assert [r.text for r in R.longest_first(rows, "text", 2).collect()] == ["three", "2.5"]
    assert named(R.read_whole(spark, str(tmp_path)), "text")[1] == ("b.txt", "x\r\ny") and named(R.files_under(spark, str(tmp_path)), "bytes") == [("a.txt", 15), ("b.txt", 4)]


def test_articles_and_tables(spark, tmp_path):
    lines_of(tmp_path / "in", {"p/a.jsonl": '{"id": "1", "title": "T", "text": "a\\nb"}\n', "q/b.jsonl": '{"id": "2", "text": "c"}\n'})
    assert sorted((r.id, r.title, r.text) for r in R.read_articles(spark, str(tmp_path / "in")).collect()) == [("1", "T", "a\nb"), ("2", None, "c")]
    df = spark.createDataFrame([("a b", 1, 0.5), ("c", None, None)], "name string, n long, x double")
    R.write_table(df, str(tmp_path / "t"))
    assert sorted(map(tuple, R.read_table(spark, str(tmp_path / "t"), "name string, n long, x double").where("name <> 'name'").collect()), key=str) == [("a b", 1, 0.5), ("c", None, None)]
    weighted = R.merged_tables([(spark.createDataFrame([("a", "b", 2), ("c", "d", 1)], "wrong string, correct string, freq long"), 1.0), (spark.createDataFrame([("a", "b", 3)], "wrong string, correct string, freq long"), 0.5)])
    assert sorted(map(tuple, weighted.collect())) == [("a", "b", 3.5), ("c", "d", 1.0)]
    assert R.runtime_per_1000(spark.createDataFrame([("m", 2.0, 500), ("m", 1.0, 1000)], "m string, seconds double, chars long"), ["m"]).first().seconds == 2.0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("f", k, f"l{k}") for k in range(20)] + [("g", 0, "only")], "file string, line long, text string")
    R.write_lines(rows, str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o" / "file=f")).collect()] == [f"l{k}" for k in range(20)]
    R.write_paragraphs(rows.selectExpr("file as split", "text"), str(tmp_path / "p"), 5)
    assert spark.read.parquet(str(tmp_path / "p")).where("split = 'f'").count() == 20 and len(list((tmp_path / "p" / "split=f").glob("*.parquet"))) >= 4
    done = spark.createDataFrame([(1,), (1,)], "seq_id long")
    assert [r.seq_id for r in R.missing(spark.range(3).toDF("seq_id"), done).orderBy("seq_id").collect()] == [0, 2]
    old, new = (spark.createDataFrame(x, "k string, v long") for x in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]))
    assert sorted(map(tuple, R.upserted(old, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    batches = R.length_batches(rows.selectExpr("text", "xxhash64(file, line) as seq_id"), 4).groupBy("batch").count().collect()
    assert all(r["count"] <= 4 for r in batches) and sum(r["count"] for r in batches) == 21


def test_hyphens_on_a_stream(spark, tmp_path):
    rows = [("f", 0, "con-"), ("f", 1, "tinued"), ("f", 2, "whole"), ("f", 3, "open-")]
    spark.createDataFrame(rows, "file string, line long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("file string, line long, text string").parquet(str(tmp_path / "in"))
    query = stream.joined_hyphens(source, 1000).writeStream.format("memory").queryName("joined").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            got = sorted(r.text for r in spark.table("joined").collect())
            if len(got) == 3:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert got == ["con-tinued", "open-", "whole"]
