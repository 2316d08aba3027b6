"""Queries on noise, repair, evaluation and fitting, with their SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmend.functions import spaces as SP
from textmend.functions import text as T
from textmend.functions.rng import uniform_sql
from textmend.operators import evaluate as E
from textmend.operators import labeling as L
from textmend.operators import rules as R
from textmend.operators.lineage import checkpoint
from textmend.plans.corpus import LINES, documents, lines

QUERIES, ORACLE_SQL = {}, {}
P_INSERT, P_DELETE, SEED = 0.03, 0.15, 5


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


U = uniform_sql(SEED, "seq_id", "(i - 1)")
NOISE = f"""noise as (select seq_id, doc_id, lang, source, text, array_to_string(list_transform(ch, lambda c, i: case when c = ' ' then case when {U} < {P_DELETE} then '' else ' ' end when i > 1 and ch[i - 1] <> ' ' and {U} < {P_INSERT} then ' ' || c else c end), '') as corrupt from (select *, string_split(text, '') as ch from lines))"""
RULED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(corrupt, ' ([,.)])', '\1', 'g'), '([0-9]) ([0-9])', '\1\2', 'g'), '([0-9]) ([0-9])', '\1\2', 'g'), ',([^ 0-9])', ', \1', 'g'), '([^ (])\(', '\1 (', 'g'), ';([^ ])', '; \1', 'g')"
GAPS = "list_transform(regexp_extract_all({0} || '$', '( *)[^ ]', 1), lambda x: length(x))"
PRED = f"pred as (select *, {RULED} as predicted from noise), gaps as (select *, {GAPS.format('text')} as o, {GAPS.format('corrupt')} as c, {GAPS.format('predicted')} as p from pred)"
SUM = "cast(list_sum(list_transform(range(1, len(o) + 1), lambda k: {0})) as bigint)"
COUNTS = "counts as (select *, tp_del + tp_ins as tp, fp_del + fp_ins as fp, fn_del + fn_ins as fn, fp_del + fn_del + fp_ins + fn_ins = 0 as is_correct from (select seq_id, doc_id, lang, source, " + ", ".join(
    f"{SUM.format(f)} as {n}" for n, f in {
        "tp_del": "(o[k] > c[k] and p[k] > c[k])::int", "fp_del": "(o[k] <= c[k] and p[k] > c[k])::int", "fn_del": "(o[k] > c[k] and p[k] <= c[k])::int",
        "tp_ins": "greatest(0, c[k] - greatest(o[k], p[k]))", "fp_ins": "greatest(0, least(o[k], c[k]) - p[k])", "fn_ins": "greatest(0, least(p[k], c[k]) - o[k])"}.items()) + " from gaps))"
BASE = f"with {LINES}, {NOISE}, {PRED}, {COUNTS}"
SCORES = "round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as precision, round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as recall, round(case when tp = 0 then 0 else 2.0 * tp / (2 * tp + fp + fn) end, 6) as f1"


def noisy(spark, sf_dir) -> DataFrame:
    """Lines as they are (correct), with spaces put in and taken out (corrupt), and repaired by rules (predicted)."""
    rows = lines(spark, sf_dir).withColumn("corrupt", SP.corrupt(F.col("text"), F.col("seq_id"), P_INSERT, P_DELETE, SEED))
    return rows.withColumnRenamed("text", "correct").withColumn("predicted", R.character_rules(F.col("corrupt")))


def counts(spark, sf_dir) -> DataFrame:
    return E.error_counts(noisy(spark, sf_dir), ["seq_id", "doc_id", "lang", "source"])


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


@query(f"with {LINES}, {NOISE} select seq_id, md5(corrupt) as corrupt_md5, length(corrupt)::bigint as n from noise")
def token_corruptor(spark, sf_dir):
    return noisy(spark, sf_dir).select("seq_id", F.md5("corrupt").alias("corrupt_md5"), F.length("corrupt").cast("long").alias("n"))


@query(f"with {LINES} select seq_id, md5(replace(text, ' ', '')) as merged_md5, cast(greatest(2 * length(replace(text, ' ', '')) - 1, 0) as bigint) as n_separated from lines")
def remove_and_separate(spark, sf_dir):
    """All spaces removed; a space between all characters."""
    merged = SP.merged(F.col("text"))
    return lines(spark, sf_dir).select("seq_id", F.md5(merged).alias("merged_md5"), F.length(T.separate_characters(merged)).cast("long").alias("n_separated"))


@query(f"with {LINES}, g as (select seq_id, {GAPS.format('text')} as o from lines) select seq_id, array_to_string(list_filter(range(0, len(o) - 1), lambda k: o[k + 1] > 0), ',') as places from g")
def space_positions_merged(spark, sf_dir):
    return lines(spark, sf_dir).select("seq_id", F.array_join(F.transform(SP.positions_in_merged(F.col("text")), lambda x: x.cast("string")), ",").alias("places"))


@query(f"""with {LINES}, {NOISE}, g as (select seq_id, {GAPS.format('text')} as o, {GAPS.format('corrupt')} as c from noise), k as (select seq_id, unnest(o) as o, unnest(c) as c, generate_subscripts(o, 1) as k from g),
 s as (select *, k - 1 + coalesce(sum(c) over (partition by seq_id order by k rows between unbounded preceding and 1 preceding), 0) as s from k)
 select seq_id, cast(s + c as int) as position, 'DELETION' as type from s where o > c union all select seq_id, cast(unnest(range(cast(s + o as bigint), cast(s + c as bigint))) as int), 'INSERTION' from s where c > o""")
def space_corruption_positions(spark, sf_dir):
    errors = SP.corruptions(SP.gaps(F.col("correct")), SP.gaps(F.col("corrupt")))
    return noisy(spark, sf_dir).select("seq_id", F.inline(errors))


@query(f"{BASE} select seq_id, tp_del, fp_del, fn_del, tp_ins, fp_ins, fn_ins, is_correct from counts")
def corruption_tp_fp_fn(spark, sf_dir):
    return counts(spark, sf_dir).drop("doc_id", "lang", "source")


TOTALS = "cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn"


@query(f"{BASE}, t as (select lang, count(*) as n, {TOTALS}, round(avg(is_correct::int), 6) as sequence_accuracy from counts group by 1) select lang, n, tp, fp, fn, sequence_accuracy, {SCORES} from t")
def eval_by_lang(spark, sf_dir):
    """How well the character rules repair each language: the flagship."""
    return rounded(E.summary(counts(spark, sf_dir), ["lang"]))


@query(f"{BASE}, t as (select lang, source, {TOTALS} from counts group by grouping sets ((lang, source), (lang), ())) select lang, source, tp, fp, fn, {SCORES} from t")
def eval_grouping_sets(spark, sf_dir):
    c = counts(spark, sf_dir)
    total = lambda k: F.sum(F.col(f"{k}_del") + F.col(f"{k}_ins")).alias(k)
    sets = c.groupingSets([["lang", "source"], ["lang"], []], "lang", "source").agg(total("tp"), total("fp"), total("fn"))
    return rounded(E.with_scores(sets))


@query(f"with {LINES} select seq_id, md5(text) as back_md5 from lines")
def revert_roundtrip(spark, sf_dir):
    """The corruptions of every line, undone, give the line."""
    rows = noisy(spark, sf_dir)
    back = SP.revert(F.col("corrupt"), SP.corruptions(SP.gaps(F.col("correct")), SP.gaps(F.col("corrupt"))))
    return rows.select("seq_id", F.md5(back).alias("back_md5"))


@query(f"with {LINES}, {NOISE} select seq_id, md5({RULED}) as predicted_md5 from noise")
def character_rules(spark, sf_dir):
    return noisy(spark, sf_dir).select("seq_id", F.md5("predicted").alias("predicted_md5"))


@query()
def rule_postprocess(spark, sf_dir):
    return noisy(spark, sf_dir).select("seq_id", R.postprocess(F.col("corrupt")).alias("predicted"))


CONTEXT = "substr(m, greatest(k - 2, 1), least(k, 3)) || '|' || substr(m, k + 1, 2)"
GAP_ROWS = f"gl as (select *, {GAPS.format('text')} as o, {GAPS.format('corrupt')} as c, replace(text, ' ', '') as m from noise), gk as (select seq_id, lang, m, o, c, unnest(range(1, length(m))) as k from gl), gr as (select seq_id, lang, k, {CONTEXT} as context, o[k + 1] as o, c[k + 1] as gap from gk)"
MODEL = "model as (select context, count(*) as n, cast(sum((o > 0)::int) as bigint) as n_space, (sum((o > 0)::int) + 0.2) / (count(*) + 1.0) as p_space from gr group by 1)"
LABELED = f"with {LINES}, {NOISE}, {GAP_ROWS}, {MODEL}, lab as (select gr.*, p_space as p, case when gap = 0 and p_space >= 0.9 then 1 when gap > 0 and 1 - p_space >= 0.9 then 0 else gap end as new from gr join model using (context))"


def labelled(spark, sf_dir) -> DataFrame:
    """Counted gaps (lang, context, o, gap, cnt) with p and new. The model comes from the same counts: a corrupt text has the
    characters, and so the contexts, of the true one."""
    counted = checkpoint(L.gap_counts(noisy(spark, sf_dir), "correct", "corrupt", ["lang"]))
    return L.predicted(counted, L.fit_counts(counted), 0.9, 0.9)


@query(f"with {LINES}, {NOISE}, {GAP_ROWS}, {MODEL} select context, n, n_space from model")
def labeler_probabilities(spark, sf_dir):
    """What the labeler's probabilities are made of, as whole numbers."""
    return L.fit(lines(spark, sf_dir)).select("context", "n", "n_space")


@query(f"{LABELED}, t as (select lang, sum((o > gap and new > gap or o < gap and new < gap)::int) as tp, sum((new > gap and o <= gap or new < gap and o >= gap)::int) as fp, sum((o > gap and new <= gap or o < gap and new >= gap)::int) as fn from lab group by 1) select lang, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, {SCORES} from t")
def labeling_repair(spark, sf_dir):
    """Gaps with a likely space get one, unlikely spaces go: scores by language."""
    up = (F.col("o") > F.col("gap"), F.col("new") > F.col("gap"))
    down = (F.col("o") < F.col("gap"), F.col("new") < F.col("gap"))
    count = lambda c: F.sum(F.when(c, F.col("cnt")).otherwise(0))
    out = labelled(spark, sf_dir).groupBy("lang").agg(
        count((up[0] & up[1]) | (down[0] & down[1])).alias("tp"), count((up[1] & ~up[0]) | (down[1] & ~down[0])).alias("fp"), count((up[0] & ~up[1]) | (down[0] & ~down[1])).alias("fn"))
    return rounded(E.with_scores(out))


@query(f"{LABELED}, b as (select floor(p * 1000) / 1000.0 as t, sum((o > 0)::int) as pos, sum((o = 0)::int) as neg from lab where gap = 0 group by 1), w as (select t, cast(sum(pos) over (order by t desc) as bigint) as tp, cast(sum(neg) over (order by t desc) as bigint) as fp, cast(sum(pos) over () - sum(pos) over (order by t desc) as bigint) as fn from b) select t, tp, fp, fn, {SCORES} from w")
def threshold_sweep(spark, sf_dir):
    """F1 of putting spaces in, at each threshold."""
    cases = labelled(spark, sf_dir).where("gap = 0").select("p", (F.col("o") > 0).cast("long").alias("label"), "cnt")
    return rounded(E.threshold_sweep(cases))


@query(f"{LABELED}, s as (select seq_id, coalesce(max(case when o = 0 then cast(floor(p * 100) as bigint) end), -1) as lo, coalesce(min(case when o > 0 then cast(floor(p * 100) as bigint) end), 200) as hi from lab where gap = 0 group by 1), g as (select unnest(range(0, 101)) as i) select i / 100.0 as t, count(*) filter (where lo < i and i <= hi) as n_right from s, g group by 1")
def threshold_grid_accuracy(spark, sf_dir):
    """Sequences that a threshold repairs rightly: those whose interval of right thresholds holds it. Equal intervals are
    added up before they meet the grid."""
    rows = noisy(spark, sf_dir)

    def use(keys: pa.ChunkedArray, text: np.ndarray, k: np.ndarray, o: np.ndarray, gap: np.ndarray, p: np.ndarray) -> pa.Table:
        hundredths = np.floor(np.where(np.isnan(p), 0.2, p) * 100).astype(np.int64)
        lo, hi, seen = np.full(len(keys), -1), np.full(len(keys), 200), np.zeros(len(keys), np.bool_)
        for limit, best, some in ((np.maximum, lo, o == 0), (np.minimum, hi, o > 0)):
            at = np.flatnonzero((gap == 0) & some)
            limit.at(best, text[at], hundredths[at])
            seen[text[at]] = True
        pairs, n = np.unique(np.stack((lo[seen], hi[seen]), axis=1), axis=0, return_counts=True)
        return pa.table([pa.array(c, pa.int64()) for c in (pairs[:, 0], pairs[:, 1], n)], names=["lo", "hi", "count"])

    cases = L.by_context(rows, L.fit(rows, "correct"), "correct", "corrupt", "seq_id", use, "lo bigint, hi bigint, count bigint")
    intervals = cases.groupBy("lo", "hi").agg(F.sum("count").alias("count"))  # at most 103 * 103
    grid = intervals.select("*", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("i")).withColumn("t", F.col("i") / 100.0)
    return grid.groupBy("t").agg(F.sum(F.when((F.col("lo") < F.col("i")) & (F.col("i") <= F.col("hi")), F.col("count")).otherwise(0)).alias("n_right"))


APPROACHES = f"{BASE}, a as (select seq_id, lang, doc_id, 'rules' as approach, is_correct from counts union all select seq_id, lang, doc_id, 'nothing', corrupt = text from noise)"


def approaches(spark, sf_dir) -> DataFrame:
    """A row for each line and approach; both come from one run over the lines."""
    rows = noisy(spark, sf_dir).withColumn("unchanged", F.col("corrupt") == F.col("correct"))
    both = F.array(*[F.struct(F.lit(n).alias("approach"), F.col(c).alias("is_correct")) for n, c in (("rules", "is_correct"), ("nothing", "unchanged"))])
    return E.error_counts(rows, ["seq_id", "lang", "doc_id", "unchanged"]).select("seq_id", "lang", "doc_id", F.inline(both))


@query(f"{APPROACHES} select lang, round(avg(is_correct::int) filter (where approach = 'nothing'), 6) as nothing, round(avg(is_correct::int) filter (where approach = 'rules'), 6) as rules from a group by 1")
def approaches_pivot(spark, sf_dir):
    return rounded(approaches(spark, sf_dir).groupBy("lang").pivot("approach", ["nothing", "rules"]).agg(F.avg(F.col("is_correct").cast("int"))))


@query(f"{APPROACHES}, r as (select lang, approach, avg(is_correct::int) as acc from a group by 1, 2) select x.lang, x.approach, round(x.acc, 6) as acc, round(max(y.acc), 6) as best_other from r x join r y on x.lang = y.lang and x.approach <> y.approach group by 1, 2, 3")
def best_other(spark, sf_dir):
    r = checkpoint(approaches(spark, sf_dir).groupBy("lang", "approach").agg(F.avg(F.col("is_correct").cast("int")).alias("acc")))  # a few rows, used twice
    top = r.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("acc", "approach")), asc=False).alias("l"))  # a few approaches
    other = F.when(F.col("l")[0]["approach"] == F.col("approach"), F.col("l")[1]["acc"]).otherwise(F.col("l")[0]["acc"])
    return rounded(r.join(top, "lang").select("lang", "approach", "acc", other.alias("best_other")))


@query(f"{BASE}, b as (select count(*) filter (where r and not z) as n_a, count(*) filter (where z and not r) as n_b from (select is_correct as r, corrupt = text as z from counts join noise using (seq_id))), k as (select n_a, n_b, n_a + n_b as n, unnest(range(0, n_a + n_b + 1)) as k from b) select n_a, n_b, round(least(1.0, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))), 9) as p from k where abs(n - 2 * k) >= abs(n_a - n_b) group by 1, 2")
def significance_exact(spark, sf_dir):
    """Are the rules better than doing nothing?"""
    rows = noisy(spark, sf_dir)
    c = E.error_counts(rows, ["seq_id", "correct", "corrupt"])
    test = E.significance(c.select(F.col("is_correct").cast("int").alias("a"), (F.col("corrupt") == F.col("correct")).cast("int").alias("b")), "a", "b")
    return test.withColumn("p", F.round("p", 9))


@query(f"{BASE}, r as (select seq_id, (tp + fn) / length(text)::double as rate from counts join lines using (seq_id)) select case when rate = 0 then -1 else cast(floor(rate / 0.02) as bigint) end as bin, count(*) as n from r group by 1")
def histogram_error_rate(spark, sf_dir):
    sized = noisy(spark, sf_dir).withColumn("n_chars", F.length("correct"))
    rows = E.error_counts(sized, ["n_chars"]).withColumn("errors", F.col("tp_del") + F.col("tp_ins") + F.col("fn_del") + F.col("fn_ins"))
    rate = F.col("errors") / F.col("n_chars").cast("double")
    return rows.groupBy(F.when(rate == 0, -1).otherwise(F.floor(rate / 0.02)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("select user_id, event_id, round(min(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 6) as lowest, round(max(value) over (partition by user_id order by ts, event_id rows between 3 preceding and 3 following), 6) as window_max from events")
def running_min_and_window_max(spark, sf_dir):
    """Lowest confidence so far, and the highest in a window around each place, on the events table."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(e.select("user_id", "event_id", F.min("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("lowest"), F.max("value").over(w.rowsBetween(-3, 3)).alias("window_max")))
