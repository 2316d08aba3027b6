"""Queries on corpora dealt into each other and on differences between texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmend.functions import spaces as SP
from textmend.operators import evaluate as E
from textmend.operators import mixing as M
from textmend.plans.corpus import LINES, documents
from textmend.plans.repair import BASE, GAPS, NOISE, noisy

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


_DEALT = "{0} as (select {2} as first, id, place from (select id, row_number() over (order by id) as k from {1}) join (select md5('77:{3}:' || id) as place, row_number() over (order by md5('77:{3}:' || id)) as k from {1}) using (k))"


@query(f"with d as (select doc_id as id from documents), b as (select item_id as id from benchmark), {_DEALT.format('x', 'd', 'true', 'a')}, {_DEALT.format('y', 'b', 'false', 'b')} select first, id, row_number() over (order by place, first, id) - 1 as n from (select * from x union all select * from y)")
def dataset_interleave(spark, sf_dir):
    """Documents and benchmark items in one random order in which both keep their own."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"))
    return M.interleaved(documents(spark, sf_dir).select(F.col("doc_id").alias("id")), items, "id", 77)


@query(f"""with {LINES}, {NOISE}, g as (select seq_id, replace(text, ' ', '') as m, {GAPS.format('text')} as o, {GAPS.format('corrupt')} as c from noise), k as (select seq_id, unnest(o) as o, unnest(c) as c, unnest(string_split(m, '') || ['']) as y, generate_subscripts(o, 1) - 1 as k, len(o) - 1 as n from g),
 s as (select *, lag(y) over w as x, k + coalesce(sum(o) over (w rows between unbounded preceding and 1 preceding), 0) as a, k + coalesce(sum(c) over (w rows between unbounded preceding and 1 preceding), 0) as b from k window w as (partition by seq_id order by k))
 select seq_id, cast(a as int) as a, cast(b as int) as b from s where o <> c and k < n and greatest(o, c) = 1 and regexp_matches(x, '^[0-9a-z]$') and regexp_matches(y, '^[0-9a-z]$')""")
def readable_differences(spark, sf_dir):
    """Places of spaces between letters or digits that lines and their corrupt versions do not share."""
    return noisy(spark, sf_dir).select("seq_id", F.inline(SP.readable_differences(F.col("correct"), F.col("corrupt"))))


_KINDS = "case when {0} > {1} then 'DELETION' else 'INSERTION' end"


@query(f"""{BASE}, k as (select seq_id, unnest(o) as o, unnest(c) as c, unnest(p) as p, generate_subscripts(o, 1) - 1 as position from gaps), made as (select seq_id, position, {_KINDS.format('p', 'c')} as type from k where p <> c union all select seq_id, position, {_KINDS.format('c', 'o')} from k where o <> c)
 select seq_id, cast(position as int) as position, type, case type when 'DELETION' then 'INSERTION' else 'DELETION' end as inverse from made qualify min(type) over (partition by seq_id, position) = max(type) over (partition by seq_id, position)""")
def uncancelled_changes(spark, sf_dir):
    """Changes that noise and then rules made, by gap, without those that took each other back."""
    rows = noisy(spark, sf_dir).select("seq_id", "correct", "corrupt", "predicted")
    return E.uncancelled(rows, "seq_id").withColumn("inverse", SP.inverted(F.col("type")))
