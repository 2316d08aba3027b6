import re

from pyspark.sql import functions as F

from tests.conftest import SF
from textmend.llm import pii

FOUND = re.compile(r"\S+@\S+|\+1 \(\d+\) [\d-]+|(?:\d+\.){3}\d+|\d{16}")


def replaced(spark, rows, secret="k"):
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, key string")
    out = pii.replace(df, secret)
    assert out.columns == df.columns
    return [r.text for r in out.orderBy(F.monotonically_increasing_id()).collect()]


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(re.sub(r"\D", "", s)))) % 10 == 0


def test_each_kind_keeps_type_and_format(spark):
    texts = [
        "mail Ann.Lee42@Mail.example.org now", "call +1 (407) 555-7710 or 407-555-7711.", "host 10.2.3.4, v1.2.3", "card 4111 1111 1111 1111 and 4111111111111112", "ssn 123-45-6789", "pay DE89 3704 0044 0532 0130 00 today",
        "Mr. John Smith met Mrs Jane Smith. Frau MÜLLER", "Госпожа Анна Петрова", "nothing here 12 2005-01-02 3.14", "", None,
    ]
    out = replaced(spark, [(i, t, "x", "y") for i, t in enumerate(texts)])
    assert re.fullmatch(r"mail [A-Z][a-z]{2}\.[A-Z][a-z]{2}\d\d@[A-Z][a-z]{3}\.[a-z]{7}\.org now", out[0])
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}\.", out[1])
    assert re.fullmatch(r"host (\d{1,3}\.){3}\d{1,3}, v1\.2\.3", out[2])
    cards = re.fullmatch(r"card (4\d{3} \d{4} \d{4} \d{4}) and (4\d{15})", out[3])
    assert luhn(cards[1]) and not luhn(cards[2])
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", out[4])
    assert re.fullmatch(r"pay DE\d\d( \d{4}){4} \d\d today", out[5])
    names = re.fullmatch(r"Mr\. ([A-Z][a-z]+)o ([A-Z][a-z]+) met Mrs ([A-Z][a-z]+)a ([A-Z][a-z]+)\. Frau ([A-Z]+)", out[6])
    assert names and names[2] == names[4]  # a couple keeps a common surname
    iban = lambda t: int("".join(str(int(c, 36)) for c in re.sub(r"\W", "", t)[4:] + re.sub(r"\W", "", t)[:4])) % 97
    assert iban("DE89 3704 0044 0532 0130 00") == iban(out[5][4:-6]) == 1
    assert re.fullmatch(r"Госпожа [А-Я][а-я]+а [А-Я][а-я]+ова", out[7])
    assert out[8:] == texts[8:]
    assert all(a != b for a, b in zip(out[:8], texts[:8], strict=True))


def test_same_value_same_surrogate_whatever_its_form(spark):
    out = replaced(spark, [(1, "(407) 555-7710", "", ""), (2, "407-555-7710 A@B.com", "", ""), (2, "407-555-7710 a@b.COM", "", ""), (None, "Mr. John Smith, Mr. Smith", "", "")])
    assert re.sub(r"\D", "", out[0]) == re.sub(r"\D", "", out[1]) == re.sub(r"\D", "", out[2])
    assert out[1].split()[1].lower() == out[2].split()[1].lower()
    assert out[3].split(" ")[2].rstrip(",") == out[3].split(" ")[4]
    assert replaced(spark, [(1, "(407) 555-7710", "", "")], "other") != out[:1]


def test_a_name_is_replaced_with_and_without_its_title(spark):
    text = "Mr. John Smith met Mrs Smith. John Smith left; SMITH's car and Smith-Brown stayed. Dr. Ann Lee, prof Lee, Prof. Dr. Ann Lee and Ann. Smithson smith"
    out, other, russian = replaced(spark, [(1, text, "", ""), (2, "John Smith and Ann have no title here", "", ""), (3, "Господин Иван Петров и Госпожа Анна Петрова. Петров, Петрова", "", "")])
    john, smith = re.match(r"Mr\. (\w+) (\w+) met Mrs (?=\2)\w+\. ", out).groups()
    ann, lee = re.search(r"Dr\. (\w+) (\w+), prof", out).groups()
    assert john.endswith("o") and not {"John", "Ann"} & {john, ann} and len({john, smith, ann, lee}) == 4
    assert out == text.replace("Smith-Brown", "-").replace("Smithson", "~").replace("SMITH", smith.upper()).replace("John", john).replace("Smith", smith).replace("Ann", ann).replace("Lee", lee).replace("-", "Smith-Brown").replace("~", "Smithson")
    assert other == "John Smith and Ann have no title here"
    m = re.fullmatch(r"Господин (\w+) (\w+) и Госпожа (\w+) (\w+)\. (\w+), (\w+)", russian)
    assert m[4] == m[2] + "а" and (m[5], m[6]) == (m[2], m[4]) and m[2] != "Петров"


def test_short_values_stay_distinct(spark):
    """Thirty one-letter hosts have 26 letters: the surrogates of some grow."""
    rows = [(i, f"x{chr(97 + i % 26)}@{c}.org and {c}@example.org", "", "") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123")]
    out = [re.fullmatch(r"(\w+)@(\w+)\.org and (\w+)@(\w+)\.org", t).groups() for t in replaced(spark, rows)]
    assert len({o[1] for o in out}) == 30 and len({o[2] for o in out}) == 30 and len({o[3] for o in out}) == 1
    assert not {o[1] for o in out} & set("abcdefghijklmnopqrstuvwxyz0123")


def test_very_long_text(spark):
    text = "Mr. Paul Berg wrote to a.b@c.org and Berg answered. " * 4000
    out, = replaced(spark, [(1, text, "", "")])
    assert len(set(out.split(". "))) == len(set(text.split(". "))) and "Berg" not in out and "a.b@c" not in out


def test_documents_keep_distinctness_and_all_else(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    old = {r.doc_id: r.text for r in docs.collect()}
    new = {r.doc_id: r.text for r in pii.replace(docs, "k").collect()}
    to = {}
    for i, text in old.items():
        a, b = FOUND.findall(text), FOUND.findall(new[i])
        assert len(a) == len(b) and FOUND.sub("", text) == FOUND.sub("", new[i])
        for x, y in zip(a, b, strict=True):
            assert to.setdefault(x, y) == y
    assert to and len(set(to.values())) == len(to) and not set(to) & set(to.values())


def test_collisions_are_settled(spark):
    keys = spark.createDataFrame([(f"ip\x1f10.0.0.{i}",) for i in range(200)], "key string")
    real, core = pii.core, pii.core
    try:  # a surrogate of few values collides often, also with real ones
        pii.core = lambda key, attempt, secret, syllables=3: F.concat(F.lit("10.0."), F.pmod(F.xxhash64(key, attempt), F.lit(3)).cast("string"), F.lit("."), F.pmod(F.xxhash64(attempt, key), F.lit(150)).cast("string"))
        rare = {r.key: r.attempt for r in pii.exceptions(keys, "k", patience=200).collect()}
        all_keys = keys.select("key", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in rare.items() for x in kv]), F.col("key")), F.lit(0)).alias("n"))
        made = [r[0] for r in all_keys.select(pii.core(F.col("key"), F.col("n"), "k")).collect()]
    finally:
        pii.core = core
    assert rare and len(set(made)) == 200 and not {f"10.0.0.{i}" for i in range(200)} & set(made)
    assert real is pii.core


def test_exceptions_reach_the_documents(spark, monkeypatch):
    rows = [(1, "a 10.0.0.1 b", "", ""), (None, "10.0.0.1", "", ""), (2, "10.0.0.2", "", "")]
    plain = replaced(spark, rows)
    monkeypatch.setattr(pii, "exceptions", lambda keys, secret, syllables: keys.where(F.col("key").contains("10.0.0.1")).withColumn("attempt", F.lit(3)))
    got = sorted(r.text for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string, id string, key string"), "k").collect())
    assert plain[2] in got and plain[1] not in got and f"a {got[1] if got[0].startswith('a') else got[0]} b" in got or f"a {got[0]} b" in got


def test_empty_table(spark):
    assert replaced(spark, []) == []
