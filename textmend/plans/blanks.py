"""Queries on blanks and penalties, with their SQL. Models learn from one hash half of the lines, the other is scored."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmend.operators import blanks as B
from textmend.operators import language_model as LM
from textmend.operators.lineage import checkpoint
from textmend.plans.corpus import LINES, lines
from textmend.plans.fitting import TRAIN
from textmend.plans.repair import GAPS, NOISE, noisy, rounded

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def windows_sql(name: str, n: int, before: int, behind: int, source: str) -> str:
    """name(gram, cnt): windows of n characters of source(text), padded."""
    return f"{name} as (select substr(t, i, {n}) as gram, count(*) as cnt from (select t, unnest(range(1, length(t) - {n - 2})) as i from (select repeat(chr(2), {before}) || text || repeat(chr(3), {behind}) as t from {source})) group by 1)"


_SHARE = "(coalesce({0}.cnt, 0) + 1 / 256::double) / (coalesce({1}.n, 0) + 1::double)"
_NEAR = f"""train as (select * from lines where {TRAIN}), {windows_sql('t3', 3, 2, 2, 'train')}, l2 as (select substr(gram, 1, 2) as key, sum(cnt) as n from t3 group by 1), r2 as (select substr(gram, 2, 2) as key, sum(cnt) as n from t3 group by 1),
 five as (select seq_id, i - 1 as k, substr(t, i, 5) as five from (select seq_id, t, unnest(range(1, length(t) - 3)) as i from (select seq_id, repeat(chr(2), 2) || corrupt || repeat(chr(3), 3) as t from noise where not ({TRAIN})))),
 spots as (select seq_id, k, false as blank, substr(five, 1, 4) as near from five union all select seq_id, k, true, substr(five, 1, 2) || substr(five, 4, 2) from five where substr(five, 3, 1) = ' '),
 parts as (select near, {_SHARE.format('a', 'l')} as f, {_SHARE.format('b', 'r')} as b, {_SHARE.format('c', 'l')} as fn, {_SHARE.format('d', 'r')} as bn from (select distinct near from spots) left join l2 l on l.key = substr(near, 1, 2) left join r2 r on r.key = substr(near, 3, 2)
 left join t3 a on a.gram = substr(near, 1, 2) || ' ' left join t3 b on b.gram = ' ' || substr(near, 3, 2) left join t3 c on c.gram = substr(near, 1, 3) left join t3 d on d.gram = substr(near, 2, 3)),
 p as (select near, (f + b) / 2 as average, f * b as multiply, (f + b) / 2 / ((f + b) / 2 + (fn + bn) / 2) as average_compared, f * b / (f * b + fn * bn) as multiply_compared, f * b * (1 - fn * bn) as multiply_compared_min from parts)"""
_METHODS = ["average", "multiply", "average_compared", "multiply_compared", "multiply_compared_min"]


@query(f"with {LINES}, {NOISE}, {_NEAR} select near, {', '.join(f'round({m}, 6) as {m}' for m in _METHODS)} from p")
def blank_probabilities(spark, sf_dir):
    """Every surrounding of a place in the held-out corrupt lines with the probability of a blank, by each way to combine."""
    held = noisy(spark, sf_dir).where(f"not ({TRAIN})").select("seq_id", F.col("corrupt").alias("text"))
    return rounded(B.blank_probabilities(B.places(held, []), B.triples(lines(spark, sf_dir).where(TRAIN))))


@query(f"with {LINES}, {NOISE}, {_NEAR}, s as (select seq_id, k, blank, case when blank then 1 - multiply_compared else multiply_compared end as p from spots join p using (near)) select seq_id, count(*) filter (where not blank and p >= 0.9) as n_insert, count(*) filter (where blank and p >= 0.9) as n_delete, coalesce(md5(string_agg(k || case when blank then '-' else '+' end, ',' order by k, blank) filter (where p >= 0.9)), md5('')) as changes_md5 from s group by 1")
def blank_changes(spark, sf_dir):
    """By held-out corrupt line: places where a blank likely comes or goes."""
    held = noisy(spark, sf_dir).where(f"not ({TRAIN})").select("seq_id", F.col("corrupt").alias("text"))
    size = lines(spark, sf_dir).where(f"not ({TRAIN})").agg(F.sum(F.length("text"))).first()[0] or 0  # noise hardly changes it
    every = B.changes_by_line(held, "seq_id", B.triples(lines(spark, sf_dir).where(TRAIN)), 0.9, characters=size)
    return every.select("seq_id", "n_insert", "n_delete", F.md5("changes").alias("changes_md5"))



_LEVELS = ", ".join([f"k{n} as (select substr(gram, 2) as gram, sum(cnt) as cnt from k{n + 1} group by 1)" for n in (3, 2, 1)] + [f"y{n} as (select substr(gram, 1, {n - 1}) as gram, sum(cnt) as n from k{n} group by 1)" for n in (2, 3, 4)])
_GRAMS = {"space": "substr(near, 1, 3) || ' '", "w1": "substr(near, 2, 2) || ' ' || substr(near, 4, 1)", "w2": "substr(near, 3, 1) || ' ' || substr(near, 4, 2)", "w3": "' ' || substr(near, 4, 3)", "n1": "substr(near, 1, 4)", "n2": "substr(near, 2, 4)", "n3": "substr(near, 3, 4)"}
_ASKED = "asked as (select distinct unnest([" + ", ".join(_GRAMS.values()) + "]) as gram from near6), q1 as (select asked.gram, (coalesce(k1.cnt, 0) + 5 * (1 / 256::double)) / ((select sum(cnt) from k4) + 5::double) as p from asked left join k1 on k1.gram = substr(asked.gram, 4, 1)), " + ", ".join(
    f"q{n} as (select q.gram, (coalesce(k.cnt, 0) + 5 * p) / (coalesce(y.n, 0) + 5::double) as p from q{n - 1} q left join k{n} k on k.gram = substr(q.gram, {5 - n}, {n}) left join y{n} y on y.gram = substr(q.gram, {5 - n}, {n - 1}))" for n in (2, 3, 4))
_RATIOS = ["space.p", "space.p * w1.p / n1.p", "space.p * w1.p / n1.p * w2.p / n2.p", "space.p * w1.p / n1.p * w2.p / n2.p * w3.p / n3.p"]
_AHEAD = f"""train as (select * from lines where {TRAIN}), {windows_sql('k4', 4, 3, 1, 'train')}, {_LEVELS},
 held as (select seq_id, repeat(chr(2), 3) || trim(regexp_replace(text, ' +', ' ', 'g'), ' ') || repeat(chr(3), 3) as t, {GAPS.format('text')} as o, {GAPS.format('corrupt')} as c from noise where not ({TRAIN})),
 cut as (select seq_id, i, substr(t, i, 3) || substr(ltrim(substr(t, i + 3, 4), ' '), 1, 3) as near from (select seq_id, t, unnest(range(1, length(t) - 4)) as i from held) where substr(t, i + 2, 1) <> ' '),
 ends as (select seq_id, near, row_number() over (partition by seq_id order by i) as k from cut), each as (select seq_id, unnest(o) > 0 as o, unnest(c) > 0 as c, generate_subscripts(o, 1) as k, len(o) as n from held),
 gaps6 as (select near, o, c from ends join each using (seq_id, k) where k > 1 and k < n), near6 as (select near, o, c, count(*) as cnt from gaps6 group by 1, 2, 3), {_ASKED},
 scores as (select near, unnest([{', '.join(f"{{'ahead': {k}, 'score': ln({r})}}" for k, r in enumerate(_RATIOS))}]) as s from (select distinct near from near6) {' '.join(f"join q4 {name} on {name}.gram = {gram}" for name, gram in _GRAMS.items())}),
 scored as (select s.ahead as ahead, o, c, cnt, case when c then -s.score else s.score end as score from near6 join scores using (near)),
 bins as (select ahead, c, greatest(-1, least(200, floor(10 * score + 1e-9)))::int as t, sum(case when o <> c then cnt else 0 end) as tp, sum(case when o <> c then 0 else cnt end) as fp from scored group by 1, 2, 3),
 summed as (select ahead, c, t, sum(tp) over w as tp, sum(fp) over w as fp from bins window w as (partition by ahead, c order by t desc)), due as (select ahead, sum(tp) as due from bins group by 1),
 axis as (select ahead, c, t, tp, fp from summed where t >= 0 union all select ahead, x.c, 201, 0, 0 from due, (values (true), (false)) x(c)),
 pairs as (select i.ahead, i.t as insertion, d.t as deletion, cast(i.tp + d.tp as bigint) as tp, cast(i.fp + d.fp as bigint) as fp, cast(due as bigint) as due from axis i join axis d on i.ahead = d.ahead and not i.c and d.c join due on due.ahead = i.ahead)"""


@query(f"with {LINES}, {NOISE}, {_AHEAD} select ahead, insertion, deletion, tp, fp, due - tp as fn, round(case when tp = 0 then 0 else 2.0::double * tp / (tp + fp + due) end, 6) as f1 from pairs qualify row_number() over (partition by ahead order by case when tp = 0 then 0 else 2.0::double * tp / (tp + fp + due) end desc, insertion desc, deletion desc) = 1")
def lookahead_penalties(spark, sf_dir):
    """The pair of penalties of the best F1 when a space is judged with 0 to 3 characters behind it."""
    cases = checkpoint(B.ahead_cases(noisy(spark, sf_dir).where(f"not ({TRAIN})"), "correct", "corrupt"))
    scores = B.ahead_scores(cases, LM.counts(lines(spark, sf_dir).where(TRAIN)))
    return rounded(B.best_pair(cases, scores))
