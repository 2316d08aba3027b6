import random
import re

from pyspark.sql import functions as F

from textmend.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, parts int"


def test_everything_reads_back(spark):
    rng = random.Random(6)
    bits = ["<|turn|>", "<|end|>", "<|says|>", "<", "|", "\\", "[INST]", "[/INST]", "[\\INST]", "</s>", "<s>", "<\\\\|", "[[SYS]", "a", "é😀", "\n", " "]
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "<|end|>", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))]), "x", 1))
    rows += [(90, 0, "assistant", "same", "", 0)] * 2 + [(None, 5, "user", "no id", "", 0), (91, 1, "assistant", "", "", 0)]
    rng.shuffle(rows)
    made = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    got = made.select("conv_id", chat.read_turns(made.formatted).alias("turns")).collect()
    targets = {}
    for r in chat.examples(made.withColumn("context", F.lit("clash")), outer=True).orderBy("example").collect():
        targets.setdefault(r.conv_id, []).extend([] if r.example is None else [(r.example, r.target)])
    want = {}
    for conv, turn, role, text, *_ in rows:
        want.setdefault(conv, []).append((turn, role or "", text or ""))
    assert len(got) == len(want)
    for r in got:
        turns = [t[1:] for t in sorted(want[r.conv_id])]
        assert [(t.role, t.text) for t in r.turns] == turns
        unescaped = [re.sub(chat._ESCAPED, r"\1\2\3", t) for _, t in targets[r.conv_id]]
        assert unescaped == [t for role, t in turns if role == "assistant"] and [k for k, _ in targets[r.conv_id]] == list(range(len(unescaped)))
    for r in made.collect():
        assert all(s not in r.formatted for s in ("</s>", "<s>", "[INST]", "[/INST]"))
        assert r.formatted.count("<|") == 3 * len(want[r.conv_id])


def test_each_assistant_turn_is_an_example_with_its_whole_prefix(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "U1"), (1, 2, "assistant", "A1"), (1, 3, "user", "U2"), (1, 4, "assistant", "A2"), (1, 5, "user", "late"), (2, 0, "user", "alone")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.example): (r.context, r.target) for r in chat.examples(made).collect()}
    first = "<|turn|>system<|says|>S<|end|><|turn|>user<|says|>U1<|end|><|turn|>assistant<|says|>"
    assert got == {(1, 0): (first, "A1"), (1, 1): (first + "A1<|end|><|turn|>user<|says|>U2<|end|><|turn|>assistant<|says|>", "A2")}


def test_long_conversations(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(3000)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat.examples(made).where("example in (0, 1499)").orderBy("example").collect()
    assert [(r.example, r.target) for r in got] == [(0, "t1"), (1499, "t2999")]
    assert got[1].context.endswith("<|says|>t2998<|end|><|turn|>assistant<|says|>") and got[1].context.startswith("<|turn|>user<|says|>t0<|end|>")


def test_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
