"""Queries of the operators, each over its whole table, with the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.llm import bpe, chat, fill_middle, html_text, licenses, pii, pu_quality, quality_rules, runs, secrets, simhash, suffix_dedup, tiling
from textmend.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: In use, a secret of the user's; the queries need one that stays.
PII_SECRET = "surrogates"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.replace(docs.select("doc_id", "text"), PII_SECRET)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    trusted = labels.where((F.col("quality") == 1) & ~pu_quality.held_out()).select("doc_id")
    scored = pu_quality.score(table(spark, sf_dir, "documents"), trusted)
    return scored.select("doc_id", pu_quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.spelled(F.col("base")), 256).alias("base_sha256"), secrets.spelled(F.col("all")).alias("spans"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(spark, public_tokenizers.path(VOCABULARY))
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = chat.format_conversations(turns.unionByName(own))
    turns = chat.read_turns(F.col("formatted"))
    spoken = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = ["conv_id", "n_turns", "turns_sha256", "formatted_chars"]
    made = made.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "formatted", "examples")
    # the rows are dealt out by conversation already, so that no turn is shuffled again
    expanded = chat.examples(made, whole, outer=True)
    targets = F.sort_array(F.collect_list(F.when(F.col("example").isNotNull(), F.struct("example", chat.unescape(F.col("target")).alias("said")))))
    read = expanded.groupBy("conv_id").agg(*[F.first(c).alias(c) for c in whole[1:]], F.array_join(F.transform(targets, lambda t: t["said"]), "").alias("loss"),
                                           F.count("example").alias("n_examples"), F.coalesce(F.sum(F.length("context")), F.lit(0)).alias("context_chars"))
    return read.select(*whole[:3], F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples", "context_chars")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).drop("distance")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document, by a hash of its id, gets a periodic tail first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({runs.WORD})")).alias("words"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    docs = docs.withColumn("first", F.when((F.col("h") % 10 == 0) & (n > 0), (g % n).cast("int")))
    period = (1 + F.floor((n - F.col("first")) / (3 + g % 8))).cast("int")
    words = F.when(F.col("first").isNull(), F.col("words")).otherwise(runs.repeated_tail(F.col("words"), F.col("first"), period))
    found = runs.periodic_runs(docs.select("doc_id", F.array_join(words, " ").alias("text")))
    order = lambda a, b: F.when((a["length"] > b["length"]) | (a["length"] == b["length"]) & ((a["start"] < b["start"]) | (a["start"] == b["start"]) & (a["period"] < b["period"])), -1).otherwise(1)
    best = F.when(F.size("runs") > 0, F.get(F.array_sort("runs", order), F.lit(0)))
    spelled = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("best", best)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
                        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"), F.sha2(F.when(F.size("runs") > 0, F.concat(spelled, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restore(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {q.__name__: q for q in (
    op1_pii, op2_decontamination, op3_quality_classifier, op4_secrets, op5_simhash, op6_bpe, op7_chat, op8_licenses, op9_quality_rules, op10_html, op11_suffix_dedup, op12_runs, op13_fill_in_middle)}
_ESCAPE = r"length(regexp_replace({0}, '(<|\[)(\\*)(\||/?s>|/?INST\]|/?SYS\])', '\1\2\\\3', 'g'))"
_ORDER = "order by turn, role, text"
#: What SQL can express; tests compare the others with brute force.
ORACLE_SQL: dict[str, str] = {
    "op7_chat": f"""with own as (select unnest(['user', 'assistant']) as role, unnest([0, 1]) as turn), t as (select conv_id, turn, role, coalesce(text, '') as text from conversations union all select -1, turn, role, '</s>[INST] ok [/INST]' from own),
 s as (select *, {len(chat.TURN + chat.SAYS + chat.END)} + {_ESCAPE.format('role')} + {_ESCAPE.format('text')} as n, {len(chat.TURN + chat.SAYS)} + {_ESCAPE.format('role')} as head from t),
 c as (select *, coalesce(sum(n) over (partition by conv_id {_ORDER} rows between unbounded preceding and 1 preceding), 0) as before from s)
 select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) as turns_sha256, cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' {_ORDER}) filter (where role = 'assistant'), '')) as loss_sha256, cast(sum(n) as bigint) as formatted_chars, count(*) filter (where role = 'assistant') as n_examples,
 cast(coalesce(sum(before + head) filter (where role = 'assistant'), 0) as bigint) as context_chars from c group by 1""",
    "op11_suffix_dedup": f"""with d as (select doc_id, encode(coalesce(text, '')) as data from documents), b as (select *, octet_length(data) as n from d),
 w as (select doc_id, k, data[k + 1:k + {suffix_dedup.THRESHOLD}] as s from (select doc_id, data, unnest(range(0, n - {suffix_dedup.THRESHOLD - 1})) as k from b)),
 g as (select doc_id, k from (select *, min(doc_id) over (partition by s) as least from w) where doc_id > least),
 o as (select *, coalesce(k > lag(k) over (partition by doc_id order by k) + {suffix_dedup.THRESHOLD}, true) as fresh from g), i as (select *, sum(cast(fresh as int)) over (partition by doc_id order by k) as run from o),
 r as (select doc_id, min(k) as a, max(k) + {suffix_dedup.THRESHOLD} as z from i group by doc_id, run),
 p as (select doc_id, sum(z - a) as gone, count(*) as spans from r group by 1),
 c as (select b.doc_id, coalesce(lag(z) over (partition by b.doc_id order by a), 0) as x, a as y from r join b using (doc_id) union all select doc_id, coalesce(max(z), 0), any_value(n) from b left join r using (doc_id) group by 1),
 h as (select doc_id, string_agg(hex(data[x + 1:y]), '' order by x) as kept from c join b using (doc_id) where y > x group by 1)
 select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from b left join p using (doc_id) left join h using (doc_id)""",
    "op13_fill_in_middle": f"""with d as (select doc_id, coalesce(text, '') as t, sha256('{fill_middle.SEED}:' || cast(doc_id as varchar)) as h from documents),
 u as (select *, regexp_extract_all(t, '{fill_middle.UNIT}') as lines, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d),
 c as (select *, len(lines) as n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as x, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as y,
 case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= {fill_middle.EXAMPLE_PERCENT} then 'plain' when h4 % 100 < {fill_middle.SPM_PERCENT} then 'spm' else 'psm' end as form from u),
 p as (select *, array_to_string(lines[1:x], '') as pre, array_to_string(lines[x + 1:y], '') as mid, array_to_string(lines[y + 1:n], '') as suf from c)
 select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
 sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from p""",
}
