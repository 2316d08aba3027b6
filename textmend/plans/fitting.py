"""Queries on thresholds fitted on predictions in rounds, with their SQL."""

from __future__ import annotations

from textmend.operators import thresholds as TH
from textmend.plans.corpus import LINES
from textmend.plans.repair import GAPS, NOISE, noisy, rounded

QUERIES, ORACLE_SQL = {}, {}
#: Lines that the model learns from; thresholds are fitted on the others.
TRAIN = "substr(md5('73:' || seq_id), 1, 1) < '8'"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


_CONTEXT = "substr(m, greatest(k - 1, 1), least(k, 2)) || '|' || substr(m, k + 1, 2)"
_AROUND = "coalesce(cast(cast(lag({0}) over w as int) as varchar), '2') || coalesce(cast(cast(lead({0}) over w as int) as varchar), '2') as around"
_WINDOW = "window w as (partition by seq_id order by k)"


def round_sql(name: str, before: str) -> str:
    """name(seq_id, k, context, o, first, was, p, changed, gap): a round after the states (gap) before."""
    return f"""{name}_n as (select seq_id, k, context, o, first, gap, {_AROUND.format('gap')} from {before} {_WINDOW}),
 {name}_p as (select n.*, case when gap then 1 - coalesce(p, 0.2::double) else coalesce(p, 0.2::double) end as sure from {name}_n n left join model using (context, around)),
 {name} as (select seq_id, k, context, o, first, gap as was, sure, sure >= 0.5 as changed, gap <> (sure >= 0.5) as gap from {name}_p)"""


_CASES = f"""{LINES}, {NOISE}, chars as (select seq_id, replace(text, ' ', '') as m, {GAPS.format('text')} as o, {GAPS.format('corrupt')} as c from noise),
 ks as (select seq_id, m, unnest(range(1, length(m))) as k, o, c from chars), g as (select seq_id, k, {_CONTEXT} as context, o[k + 1] > 0 as o, c[k + 1] > 0 as gap, c[k + 1] > 0 as first from ks),
 truth as (select seq_id, context, o, {_AROUND.format('o')} from g where {TRAIN} {_WINDOW}), model as (select context, around, (cast(sum(cast(o as int)) as bigint) + 0.2::double) / (count(*) + 1.0::double) as p from truth group by 1, 2),
 held as (select * from g where not ({TRAIN})), {round_sql('r0', 'held')}, {round_sql('r1', 'r0')}, {round_sql('r2', 'r1')},
 made as (select *, row_number() over (partition by seq_id, k order by r) as nth from (select seq_id, k, o, first, sure, 0 as r from r0 where changed union all select seq_id, k, o, first, sure, 1 from r1 where changed union all select seq_id, k, o, first, sure, 2 from r2 where changed)),
 cases as (select floor(sure * 1000) / 1000.0::double as t, cast(o <> first and nth = 1 as int) as tp, case when o <> first then case when nth = 1 then 0 when nth % 2 = 0 then 1 else -1 end when nth % 2 = 1 then 1 else -1 end as fp from made),
 due as (select count(*) as n from held where o <> gap)"""
_SWEEP = "b as (select t, sum(tp) as tp, sum(fp) as fp from cases group by 1), s as (select t, cast(sum(tp) over (order by t desc) as bigint) as tp, cast(sum(fp) over (order by t desc) as bigint) as fp from b)"


def held_state(spark, sf_dir):
    """The state after three rounds on the held-out lines."""
    texts = noisy(spark, sf_dir).select("seq_id", "correct", "corrupt")
    model = TH.shares_around(texts.where(TRAIN), "correct")
    return TH.state_in_chunks(texts.where(f"not ({TRAIN})"), model, "correct", "corrupt", "seq_id", 3)


@query(f"with {_CASES}, {_SWEEP} select t, tp, fp, cast((select n from due) - tp as bigint) as fn, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as precision, round(tp / (select n from due), 6) as recall, round(case when tp = 0 then 0 else 2.0 * tp / (tp + fp + (select n from due)) end, 6) as f1 from s")
def signed_threshold_sweep(spark, sf_dir):
    """Scores of all thresholds of predictions in rounds on held-out lines; a prediction that takes a false one back counts
    as one fewer."""
    return rounded(TH.sweep(held_state(spark, sf_dir)))
