"""Queries that score repairs and models, and what is fitted to the scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmend.functions import spaces as SP
from textmend.functions import text as T
from textmend.operators import evaluate as E
from textmend.operators import language_model as LM
from textmend.operators import stats as S
from textmend.operators.lineage import checkpoint
from textmend.plans.corpus import ITEM_LINES, LINES, documents, item_lines, lines
from textmend.plans.repair import APPROACHES, BASE, GAPS, LABELED, NOISE, PRED, SCORES, approaches, counts, labelled, noisy, rounded
from textmend.plans.search import GRAMS

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


EPS = "1e-6"


@query(f"""{BASE}, s as (select lang, tp, fp, fn, case when tp + fp + fn = 0 then 1 else (tp + {EPS}) / (tp + fp + {EPS}) end as p, case when tp + fp + fn = 0 then 1 else (tp + {EPS}) / (tp + fn + {EPS}) end as r from counts),
 m as (select lang, count(*) as n, avg(p) as macro_p, avg(r) as macro_r, avg(2 * p * r / (p + r)) as macro_f, (sum(tp) + {EPS}) / (sum(tp) + sum(fp) + {EPS}) as p, (sum(tp) + {EPS}) / (sum(tp) + sum(fn) + {EPS}) as r from s group by 1)
 select lang, n, round(macro_p, 6) as macro_precision, round(macro_r, 6) as macro_recall, round(macro_f, 6) as macro_f1, round(p, 6) as micro_precision, round(r, 6) as micro_recall, round(2 * p * r / (p + r), 6) as micro_f1 from m""")
def smoothed_scores(spark, sf_dir):
    """Scores with smoothed denominators, 1 where there is nothing to find: the mean of sequences, and of all errors."""
    return rounded(E.smoothed_summary(counts(spark, sf_dir), ["lang"]))


@query(f"""with {LINES}, {NOISE}, {PRED}, d as (select lang, list_sum(list_transform(range(1, len(o) + 1), lambda k: abs(o[k] - c[k]))) as before, list_sum(list_transform(range(1, len(o) + 1), lambda k: abs(o[k] - p[k]))) as after from gaps)
 select lang, round(avg(before), 6) as mean_before, round(avg(after), 6) as mean_after, round((sum(before) - sum(after)) / sum(before), 6) as resolved from d group by 1""")
def edits_resolved(spark, sf_dir):
    """Mean edit distances before and after the repair (spaces are all that differs), and the share of edits that is gone."""
    g = noisy(spark, sf_dir).select("lang", *[SP.gaps(F.col(c)).alias(n) for c, n in (("correct", "o"), ("corrupt", "c"), ("predicted", "p"))])
    d = g.select("lang", SP.distance(F.col("o"), F.col("c")).alias("before"), SP.distance(F.col("o"), F.col("p")).alias("after"))
    out = d.groupBy("lang").agg(F.avg("before").alias("mean_before"), F.avg("after").alias("mean_after"), ((F.sum("before") - F.sum("after")) / F.sum("before")).alias("resolved"))
    return rounded(out)


@query(f"""{APPROACHES}, r as (select lang, avg(is_correct::int) filter (where approach = 'nothing') as a, avg(is_correct::int) filter (where approach = 'rules') as b from a group by 1)
 select lang, round(1 - (1 - b) / (1 - a), 6) as relative, round(1 - ln(b + {EPS}) / ln(a + {EPS}), 6) as relative_log from r""")
def relative_improvement(spark, sf_dir):
    """How much of what was wrong the rules put right, as shares and on the logarithmic scale."""
    r = approaches(spark, sf_dir).groupBy("lang").pivot("approach", ["nothing", "rules"]).agg(F.avg(F.col("is_correct").cast("int")))
    return rounded(r.select("lang", E.relative_improvement(F.col("nothing"), F.col("rules")).alias("relative"), E.relative_log_improvement(F.col("nothing"), F.col("rules")).alias("relative_log")))


@query(f"with {LINES} select lang, round(avg(length(text)) * avg(length(text)) / var_samp(length(text)), 6) as shape, round(var_samp(length(text)) / avg(length(text)), 6) as scale, round(1 / avg(ln(length(text))), 6) as pareto from lines group by 1")
def length_distribution(spark, sf_dir):
    """Gamma and Pareto distributions of line lengths, by moments."""
    return rounded(E.fitted_distribution(lines(spark, sf_dir).select("lang", F.length("text").alias("x")), "x", ["lang"]))


PLACED = """k as (select seq_id, unnest(o) as o, unnest({0}) as c, generate_subscripts(o, 1) as k from g), s as (select *, k - 1 + coalesce(sum({1}) over (partition by seq_id order by k rows between unbounded preceding and 1 preceding), 0) as s from k)"""


@query(f"""with {LINES}, {NOISE}, g as (select seq_id, {GAPS.format('text')} as o, {GAPS.format('corrupt')} as c from noise), {PLACED.format('c', 'o')}
 select seq_id, cast(s + c as int) as position, 'DELETION' as type from s where o > c union all select seq_id, cast(s + o as int), 'INSERTION' from s where c > o""")
def corruptions_in_true_places(spark, sf_dir):
    """Where the true text lost spaces, and where it got some, in its own places."""
    g = noisy(spark, sf_dir).select("seq_id", SP.gaps(F.col("correct")).alias("o"), SP.gaps(F.col("corrupt")).alias("c"))
    return g.select("seq_id", F.inline(SP.true_places(F.col("o"), F.col("c"))))


FOUND = f"""with {LINES}, {NOISE}, {PRED}, k as (select seq_id, unnest(o) as o, unnest(c) as c, unnest(p) as p, generate_subscripts(o, 1) as k from gaps)"""


@query(f"""{FOUND} select type, in_truth, by_rules, by_nothing, count(*) as n from (select case when o > c or (o = c and p > c) then 'DELETION' else 'INSERTION' end as type, o <> c as in_truth, p <> c as by_rules, false as by_nothing from k where o <> c or p <> c) group by 1, 2, 3, 4""")
def confusion_by_approach(spark, sf_dir):
    """Errors and repairs of all approaches by type, and which approach has them."""
    g = noisy(spark, sf_dir).select(F.arrays_zip(*[SP.gaps(F.col(c)).alias(n) for c, n in (("correct", "o"), ("corrupt", "c"), ("predicted", "p"))]).alias("g"))
    k = g.select(F.inline(F.filter("g", lambda x: (x["o"] != x["c"]) | (x["p"] != x["c"]))))
    kind = F.when((F.col("o") > F.col("c")) | ((F.col("o") == F.col("c")) & (F.col("p") > F.col("c"))), "DELETION").otherwise("INSERTION")
    return k.groupBy(kind.alias("type"), (F.col("o") != F.col("c")).alias("in_truth"), (F.col("p") != F.col("c")).alias("by_rules"), F.lit(False).alias("by_nothing")).agg(F.count("*").alias("n"))


@query(f"""{FOUND}, e as (select seq_id, k, case when p > c then 'DELETION' when p < c then 'INSERTION' end as type from k where p <> c)
 select type, count(*) as n from e where not exists (select 1 from e f where f.seq_id = e.seq_id and f.type <> e.type and f.k = e.k + case when e.type = 'DELETION' then -1 else 1 end) group by 1""")
def inverse_pairs_cancelled(spark, sf_dir):
    """Repairs without those that undo each other: a deletion cancels an insertion one place before."""
    g = noisy(spark, sf_dir).select("seq_id", SP.gaps(F.col("corrupt")).alias("c"), SP.gaps(F.col("predicted")).alias("p"))
    kinds = F.zip_with("c", "p", lambda c, p: F.when(p > c, 1).when(p < c, -1).otherwise(0))
    return E.without_inverse_pairs(g.select(kinds.alias("kinds"))).groupBy("type").agg(F.count("*").alias("n"))


@query(f"""{LABELED}, b as (select lang, floor(p * 1000) / 1000.0 as t, sum((o > 0)::int) as pos, sum((o = 0)::int) as neg from lab where gap = 0 group by 1, 2),
 w as (select lang, t, cast(sum(pos) over x as bigint) as tp, cast(sum(neg) over x as bigint) as fp, cast(sum(pos) over (partition by lang) - sum(pos) over x as bigint) as fn from b window x as (partition by lang order by t desc)), f as (select lang, t, tp, fp, fn, {SCORES} from w)
 select lang, t, tp, fp, fn, f1 from f qualify row_number() over (partition by lang order by f1 desc, t desc) = 1""")
def thresholds_by_language(spark, sf_dir):
    """The best threshold for each language, all from one run."""
    cases = labelled(spark, sf_dir).where("gap = 0").select("lang", "p", (F.col("o") > 0).cast("long").alias("label"), "cnt")
    swept = rounded(E.threshold_sweep(cases, by=["lang"]))
    best = swept.groupBy("lang").agg(F.max_by(F.struct("t", "tp", "fp", "fn", "f1"), F.struct("f1", "t")).alias("b"))
    return best.select("lang", "b.*")


PENALTY = "floor(10 * (ln(p) - ln(1 - p))) / 10.0"


@query(f"""{LABELED}, b as (select gap > 0 as is_space, case when gap > 0 then -{PENALTY} else {PENALTY} end as t, sum(case when gap > 0 then (o < gap)::int else (o > gap)::int end) as pos, count(*) as n from lab group by 1, 2),
 w as (select is_space, t, cast(sum(pos) over x as bigint) as tp, cast(sum(n - pos) over x as bigint) as fp, cast(sum(pos) over (partition by is_space) - sum(pos) over x as bigint) as fn from b window x as (partition by is_space order by t desc)), f as (select *, {SCORES} from w where t >= 0)
 select case when is_space then 'deletion' else 'insertion' end as penalty, round(t, 6) as t, tp, fp, fn, f1 from f qualify row_number() over (partition by is_space order by f1 desc, t desc) = 1""")
def penalties(spark, sf_dir):
    """Penalties in logarithms of odds that a repair must overcome: for spaces put in and left out, those of the best F1."""
    logit = F.floor(10 * (F.log("p") - F.log(1 - F.col("p")))) / 10.0
    rows = labelled(spark, sf_dir)
    cases = rows.select((F.col("gap") > 0).alias("is_space"), F.when(F.col("gap") > 0, -logit).otherwise(logit).alias("p"), F.when(F.col("gap") > 0, F.col("o") < F.col("gap")).otherwise(F.col("o") > F.col("gap")).cast("long").alias("label"), "cnt")
    swept = rounded(E.threshold_sweep(cases, digits=None, by=["is_space"]).where("t >= 0"))
    best = swept.groupBy("is_space").agg(F.max_by(F.struct("t", "tp", "fp", "fn", "f1"), F.struct("f1", "t")).alias("b"))
    return best.select(F.when(F.col("is_space"), "deletion").otherwise("insertion").alias("penalty"), "b.*")


@query(f"with {LINES}, {GRAMS}, r as (select substr(gram, 4, 1) as ch, cnt, first_value(substr(gram, 4, 1)) over (partition by substr(gram, 1, 3) order by cnt desc, gram) as guess from c4) select cast(sum(cnt) filter (where ch = ' ' and guess = ' ') as bigint) as tp, cast(sum(cnt) filter (where ch <> ' ' and guess = ' ') as bigint) as fp, cast(sum(cnt) filter (where ch = ' ' and guess <> ' ') as bigint) as fn from r")
def spaces_predicted(spark, sf_dir):
    """How well the model's first guess tells spaces from other characters."""
    w = Window.partitionBy(F.substring("gram", 1, 3)).orderBy(F.desc("cnt"), "gram")
    r = LM.counts(lines(spark, sf_dir)).select("cnt", (F.substring("gram", 4, 1) == " ").alias("is_space"), (F.first(F.substring("gram", 4, 1)).over(w) == " ").alias("guessed"))
    n = lambda c, name: F.sum(F.when(c, F.col("cnt")).otherwise(0)).alias(name)
    return r.agg(n(F.col("is_space") & F.col("guessed"), "tp"), n(~F.col("is_space") & F.col("guessed"), "fp"), n(F.col("is_space") & ~F.col("guessed"), "fn"))


FIVE = "g5 as (select lang, substr(t, i, 5) as gram, count(*) as cnt from (select lang, t, unnest(range(1, length(t) - 3)) as i from (select lang, repeat(chr(2), 2) || text || repeat(chr(3), 2) as t from lines)) group by 1, 2), a5 as (select gram, sum(cnt) as cnt from g5 group by 1)"


@query(f"""with {LINES}, {FIVE}, l as (select substr(gram, 1, 3) as g, sum(cnt) as n from a5 group by 1), lc as (select substr(gram, 1, 2) as g, sum(cnt) as n from a5 group by 1), r as (select substr(gram, 3, 3) as g, sum(cnt) as n from a5 group by 1), rc as (select substr(gram, 4, 2) as g, sum(cnt) as n from a5 group by 1),
 p as (select lang, cnt, l.n / lc.n as f, r.n / rc.n as b from g5 join l on l.g = substr(gram, 1, 3) join lc on lc.g = substr(gram, 1, 2) join r on r.g = substr(gram, 3, 3) join rc on rc.g = substr(gram, 4, 2))
 select lang, cast(sum(cnt) as bigint) as n, round(-sum(cnt * log2(f)) / sum(cnt), 4) as forward, round(-sum(cnt * log2(b)) / sum(cnt), 4) as backward, round(-sum(cnt * log2(f * b)) / sum(cnt), 4) as both, round(-sum(cnt * log2(f + b - f * b)) / sum(cnt), 4) as either, round(-sum(cnt * log2((f + b) / 2)) / sum(cnt), 4) as mean from p group by 1""")
def combined_models(spark, sf_dir):
    """Bits a character of a model of what stands before, one of what stands behind, and of both combined."""
    p = LM.two_sided(checkpoint(LM.gram_counts(lines(spark, sf_dir), "lang")))
    bits = lambda c, name: F.round(-F.sum(F.col("cnt") * F.log2(c)) / F.sum("cnt"), 4).alias(name)
    return p.groupBy("lang").agg(F.sum("cnt").alias("n"), bits(F.col("forward"), "forward"), bits(F.col("backward"), "backward"), *[bits(c, n) for n, c in LM.combinations(F.col("forward"), F.col("backward")).items()])


@query(f"with {LINES}, {ITEM_LINES}, t as (select translate(text, ' -', '') as key, max(id) as true_id from items group by 1) select l.seq_id as input_id, t.true_id from (select seq_id, translate(text, ' -', '') as key from lines) l join t using (key)")
def match_by_key(spark, sf_dir):
    """Lines of documents that are a benchmark line but for spaces and hyphens."""
    return S.matched_lines(item_lines(spark, sf_dir), lines(spark, sf_dir).select(F.col("seq_id").alias("id"), "text"), T.match_key)


SPANS = f"""d as (select doc_id, seq_id, replace(text, ' ', '') as m from lines), o as (select *, coalesce(sum(length(m)) over (partition by doc_id order by seq_id rows between unbounded preceding and 1 preceding), 0) as b, sum(length(m)) over (partition by doc_id order by seq_id) as e from d),
 whole as (select doc_id, string_agg(m, '' order by seq_id) as w from d group by 1), t as (select replace(text, ' ', '') as key, max(id) as true_id from items where replace(text, ' ', '') <> '' group by 1)"""


@query(f"""with {LINES}, {ITEM_LINES}, {SPANS}, p as (select x.doc_id, x.seq_id as first, y.seq_id as last, substr(w, cast(x.b + 1 as bigint), cast(y.e - x.b as bigint)) as key from o x join o y on x.doc_id = y.doc_id and y.seq_id >= x.seq_id and y.e - x.b in (select length(key) from t) join whole on whole.doc_id = x.doc_id where x.m <> '' and y.m <> '')
 select true_id, first as seq_id, last as last_seq_id from p join t using (key) qualify row_number() over (partition by true_id order by first) = 1""")
def span_match(spark, sf_dir):
    """For each benchmark line the first run of lines of a document that, joined, is the line but for spaces."""
    return S.matched_spans(item_lines(spark, sf_dir), lines(spark, sf_dir))


@query("with f as (select doc_id, ('0x' || substr(md5('51:' || doc_id), 1, 8))::bigint % 5 as fold from documents), l as (select distinct doc_id from labels) select fold, count(*) as n, count(*) filter (where doc_id in (select doc_id from l)) as n_labelled, count(*) filter (where doc_id not in (select doc_id from l)) as n_other from f group by 1")
def folds(spark, sf_dir):
    """Documents by fold, those that are labelled and those that are not."""
    fold = F.conv(F.substring(S.seeded_order(51, "doc_id"), 1, 8), 16, 10).cast("long") % 5
    known = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct().withColumn("known", F.lit(True))
    rows = documents(spark, sf_dir).select("doc_id", fold.alias("fold")).join(known, "doc_id", "left")
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.count("known").alias("n_labelled"), F.count_if(F.col("known").isNull()).alias("n_other"))


@query("select md5(text) as text_md5, count(*) as n, round(avg(('0x' || substr(md5('61:' || src || ':' || id), 1, 8))::bigint / 4294967296.0), 6) as place from (select 'd' as src, doc_id as id, text from documents union all select 'b', item_id, text from benchmark) group by 1")
def dataset_mix(spark, sf_dir):
    """Two corpora dealt into each other: each row's place is a random number of its own, so no order of all is needed."""
    rows = documents(spark, sf_dir).select(F.lit("d").alias("src"), F.col("doc_id").alias("id"), "text").unionAll(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.lit("b"), "item_id", "text"))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("61"), "src", F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return rows.groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"), F.round(F.avg(place), 6).alias("place"))
