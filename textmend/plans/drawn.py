"""Queries on noise from tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmend.functions.rng import uniform_sql
from textmend.operators import edits as D
from textmend.operators import noise as N
from textmend.operators import span_noise as SN
from textmend.operators import stats as S
from textmend.operators import table_noise as TN
from textmend.plans.corpus import LINES, ONE_EDIT, STUMPED, TOKENS, UNI, documents, lines
from textmend.plans.preparation import draw, pick

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


#: (correct, wrong): what is misread, up to three characters.
MISREAD = N.OCR + [("ing", "mg"), ("tio", "bo"), ("ffi", "fi"), ("the", "tlie")]


def scanner_table(docs: DataFrame) -> DataFrame:
    """(wrong, correct, freq): each misreading as often as the documents have the characters, each letter put in as often as they
    have it."""
    n = [F.coalesce(F.sum(((F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))) / len(c)).cast("long")), F.lit(0)) for c, _ in MISREAD]
    rows = F.array(*[F.struct(F.lit(w).alias("wrong"), F.lit(c).alias("correct"), k.alias("freq")) for (c, w), k in zip(MISREAD, n)])
    letters = S.character_frequencies(docs).where("ch rlike '^[a-z]$'").select(F.col("ch").alias("wrong"), F.lit("").alias("correct"), F.col("cnt").alias("freq"))
    return docs.agg(rows.alias("r")).select(F.inline("r")).unionAll(letters)


def tabulated(name: str, table: str) -> str:
    """name(key, v, lo, hi): a table (key, v, w) with running sums of the weights; name_n(key, total)."""
    return f"{name} as (select key, v, cast(sum(w) over (partition by key order by v) - w as bigint) as lo, cast(sum(w) over (partition by key order by v) as bigint) as hi from ({table}) where w > 0), {name}_n as (select key, max(hi) as total from {name} group by 1)"


#: The changes of e(seq_id, pos, size, new) that stay, in kept where ok; noisy(seq_id, noisy, n_edits) for units that are characters.
SETTLED = """isl as (select *, sum(begins) over (partition by seq_id order by pos) as island from (select *, case when pos >= coalesce(max(pos + size) over (partition by seq_id order by pos rows between unbounded preceding and 1 preceding), 0) then 1 else 0 end as begins from e)),
 num as (select *, row_number() over (partition by seq_id, island order by pos) as k from isl),
 kept as (select seq_id, island, k, pos, size, new, pos + size as stop, true as ok from num where k = 1 union all select n.seq_id, n.island, n.k, n.pos, n.size, n.new, case when n.pos >= s.stop then n.pos + n.size else s.stop end, n.pos >= s.stop from kept s join num n on n.seq_id = s.seq_id and n.island = s.island and n.k = s.k + 1)"""
WRITTEN = """pieces as (select seq_id, pos, stop, new, coalesce(lag(stop) over (partition by seq_id order by pos), 0) as before from kept where ok),
 noisy as (select seq_id, string_agg(substr(text, cast(before + 1 as bigint), cast(pos - before as bigint)) || new, '' order by pos) || substr(any_value(text), cast(max(stop) + 1 as bigint)) as noisy, count(*) as n from pieces join lines using (seq_id) group by 1)
 select seq_id, md5(coalesce(noisy, text)) as noisy_md5, coalesce(n, 0) as n_edits from lines left join noisy using (seq_id)"""
P, Q = 0.05, 0.2079


def at_sql(seed: int, k: int) -> str:
    return uniform_sql(seed, "seq_id", f"(pos * 4 + {k})")


_ERRORS = " union all ".join(f"select '{c}' as key, '{w}' as v, coalesce(sum(cast(floor((length(text) - length(replace(text, '{c}', ''))) / {len(c)}) as bigint)), 0) as w from documents" for c, w in MISREAD)
_INSERTED = "select '' as key, ch as v, count(*) as w from (select unnest(string_split(text, '')) as ch from documents) where regexp_matches(ch, '^[a-z]$') group by 2"
_CHAR = "coalesce(nullif(substr(text, pos + {0}, 1), ''), ' ')"


@query(f"""with recursive {LINES}, {tabulated('iv', _ERRORS + ' union all ' + _INSERTED)},
 hits as (select seq_id, text, pos, {at_sql(51, 0)} as u0, {at_sql(51, 1)} as u1, {at_sql(51, 2)} as u from (select seq_id, text, unnest(range(0, length(text) + 1)) as pos from lines) where {at_sql(51, 0)} < {P}),
 chars as (select seq_id, pos, u0, u1, u, case when pos > 0 then substr(text, pos, 1) else ' ' end as z, {_CHAR.format(1)} as a, {_CHAR.format(2)} as b, {_CHAR.format(3)} as c from hits),
 ins as (select *, case when a = ' ' then z <> ' ' and u0 < cast({P * Q / (1 - P + P * Q)!r} as double) else u1 < {Q} end as i from chars),
 spots as (select seq_id, pos, u, case when i then '' when a <> ' ' then a end as one, case when not i and a <> ' ' and b <> ' ' then a || b end as two, case when not i and a <> ' ' and b <> ' ' and c <> ' ' then a || b || c end as three from ins),
 x as (select s.*, coalesce(x.total, 0) as n1, coalesce(y.total, 0) as n2, coalesce(z.total, 0) as n3 from spots s left join iv_n x on x.key = one left join iv_n y on y.key = two left join iv_n z on z.key = three where one is not null),
 y as (select seq_id, pos, u * (n1 + n2 + n3) as x, n1, n2, one, two, three from x),
 w as (select seq_id, pos, case when x < n1 then one when x < n1 + n2 then two else three end as key, case when x < n1 then x when x < n1 + n2 then x - n1 else x - n1 - n2 end as x from y),
 e as (select seq_id, pos, length(w.key) as size, v as new from w join iv on iv.key = w.key and w.x >= lo and w.x < hi),
 {SETTLED}, {WRITTEN}""")
def weighted_ocr_noise(spark, sf_dir):
    """Lines with a scanner's errors, drawn by frequency from a table of what the corpus has."""
    noisy = TN.weighted_errors(lines(spark, sf_dir).select("seq_id", "text"), scanner_table(documents(spark, sf_dir)), P, Q, 51)
    return noisy.select("seq_id", F.md5("noisy").alias("noisy_md5"), "n_edits")


_ANY = "'" + TN.ANY.replace("'", "''") + "'"
_CONF = "conf as (select * from (values " + ", ".join(f"('{k}', {i}, '{w}', {len(v)})" for k, v in TN.CONFUSED.items() for i, w in enumerate(v)) + ") t(key, idx, wrong, n))"


@query(f"""with recursive {LINES}, {_CONF}, cn as (select distinct key, n from conf),
 hits as (select seq_id, substr(text, pos + 1, 1) as c, case when pos + 1 < length(text) then substr(text, pos + 1, 2) end as cc, pos, cast(floor({at_sql(52, 1)} * 3) as int) as kind, {at_sql(52, 2)} as u from (select seq_id, text, unnest(range(0, length(text))) as pos from lines) where {at_sql(52, 0)} < 0.03),
 p as (select h.*, coalesce(a.n, 0) as n1, coalesce(b.n, 0) as n2 from hits h left join cn a on a.key = c left join cn b on b.key = cc),
 q as (select *, cast(floor(u * (94 + n1 + n2)) as int) as spot from p),
 e as (select seq_id, pos, 0 as size, substr({_ANY}, cast(floor(u * 94) as int) + 1, 1) as new from q where kind = 0 union all select seq_id, pos, 1, '' from q where kind = 1 and c <> ' '
  union all select seq_id, pos, 1, substr({_ANY}, spot + 1, 1) from q where kind = 2 and c <> ' ' and spot < 94
  union all select seq_id, pos, case when spot < 94 + n1 then 1 else 2 end, wrong from q join conf on conf.key = case when spot < 94 + n1 then c else cc end and idx = case when spot < 94 + n1 then spot - 94 else spot - 94 - n1 end where kind = 2 and c <> ' ' and spot >= 94),
 {SETTLED}, {WRITTEN}""")
def scanner_noise(spark, sf_dir):
    """Lines with marks put in, taken out and misread, several in a token."""
    changes = D.settled(TN.scanner_errors(F.col("text"), F.col("seq_id"), 0.03, 52))
    rows = lines(spark, sf_dir).select("seq_id", "text", changes.alias("e"))
    return rows.select("seq_id", F.md5(D.applied(F.split("text", ""), F.col("e"))).alias("noisy_md5"), F.size("e").cast("long").alias("n_edits"))


_L = N.LETTERS + N.LETTERS.upper()
_AT = pick(53, 2, f"length(t) + case {pick(53, 1, '4')} when 0 then 1 when 3 then -1 else 0 end")
_HEAD, _HERE, _REST = f"substr(t, 1, {_AT})", f"substr(t, {_AT} + 1, 1)", f"substr(t, {_AT} + 2)"
_OTHERS = f"replace('{_L}', {_HERE}, '')"
_TYPO = f"""case when {draw(53, 0)} >= 0.1 then t else case {pick(53, 1, '4')} when 0 then {_HEAD} || substr('{_L}', {pick(53, 3, '52')} + 1, 1) || {_HERE} || {_REST} when 1 then case when length(t) > 1 then {_HEAD} || {_REST} else t end
 when 2 then case when t <> '' then {_HEAD} || substr({_OTHERS}, {pick(53, 3, f'length({_OTHERS})')} + 1, 1) || {_REST} else t end else case when length(t) > 1 then {_HEAD} || substr({_REST}, 1, 1) || {_HERE} || substr({_REST}, 2) else t end end end"""


@query(f"""with {LINES}, w as (select seq_id, list_transform(string_split(text, ' '), lambda t, i: {_TYPO}) as ts, list_transform(string_split(text, ' '), lambda t, i: {draw(53, 0)} < 0.1) as hit from lines)
 select seq_id, md5(array_to_string(ts, ' ')) as noisy_md5, md5(array_to_string(list_transform(ts, lambda t, i: repeat(case when hit[i] then '0' else '1' end, length(t))), '1')) as mask_md5, cast(len(list_filter(hit, lambda h: h)) as bigint) as n_edits from w""")
def masked_typo_noise(spark, sf_dir):
    """Lines with typos, and the mask of the characters that no typo touched."""
    rows = lines(spark, sf_dir).select("seq_id", TN.masked_typos(F.col("text"), F.col("seq_id"), 0.1, 53).alias("m"))
    return rows.select("seq_id", F.md5("m.text").alias("noisy_md5"), F.md5("m.mask").alias("mask_md5"), F.col("m.n_edits").cast("long").alias("n_edits"))


def misspelt(rows: DataFrame) -> DataFrame:
    """(correct, misspelling, freq): rare words an edit from frequent ones, as often as the lines have them."""
    words = S.merged_unigrams(S.unigrams(rows)).where(r"token rlike '^\\p{L}+$'")
    rare = words.where("cnt < 20").select(F.col("token").alias("query"), F.col("cnt").alias("freq"))
    return S.fuzzy_join(rare.select("query"), words.where("cnt >= 100").select("token")).join(rare, "query").select(F.col("token").alias("correct"), F.col("query").alias("misspelling"), "freq")


_EAT, _KIND = pick(54, 2, "length(t) + 1"), pick(54, 1, "4")
_EHEAD, _EHERE, _EREST, _ELETTER = f"substr(t, 1, {_EAT})", f"substr(t, {_EAT} + 1, 1)", f"substr(t, {_EAT} + 2)", f"substr('{N.LETTERS}', {pick(54, 3, '26')} + 1, 1)"
_RANDOM = f"""case {_KIND} when 0 then {_EHEAD} || {_ELETTER} || {_EHERE} || {_EREST} when 1 then {_EHEAD} || {_EREST} when 2 then case when {_EHERE} <> '' then {_EHEAD} || {_ELETTER} || {_EREST} else t end
 else case when {_EREST} <> '' then {_EHEAD} || substr({_EREST}, 1, 1) || {_EHERE} || substr({_EREST}, 2) else t end end"""


@query(f"""with {LINES}, {TOKENS}, {UNI}, words as (select token from uni where cnt < 20 and regexp_matches(token, '^\\p{{L}}+$')), dict as (select token from uni where cnt >= 100 and regexp_matches(token, '^\\p{{L}}+$')),
 {STUMPED.format('qs', 'words')}, {STUMPED.format('ds', 'dict')}, pairs as (select distinct a.token as v, b.token as key from qs a join ds b using (stump) where {ONE_EDIT}), {tabulated('iv', 'select key, v, cnt as w from pairs join uni on uni.token = v')},
 t as (select seq_id, unnest(string_split(text, ' ')) as t, unnest(range(1, len(string_split(text, ' ')) + 1)) as i from lines), h as (select *, {draw(54, 0)} < 0.1 as hit, {draw(54, 4)} > 0.5 as by_table, {draw(54, 5)} as u from t),
 n as (select seq_id, i, hit, case when not hit then t else coalesce(iv.v, {_RANDOM}) end as t from h left join iv_n on h.hit and h.by_table and iv_n.key = h.t left join iv on iv.key = iv_n.key and h.u * iv_n.total >= lo and h.u * iv_n.total < hi)
 select seq_id, md5(string_agg(t, ' ' order by i)) as noisy_md5, cast(count(*) filter (where hit) as bigint) as n_edits from n group by 1""")
def misspelling_noise(spark, sf_dir):
    """Lines with the corpus' own misspellings, and random errors in words that have none."""
    rows = lines(spark, sf_dir).select("seq_id", "text")
    return TN.misspellings(rows, misspelt(rows), 0.1, 0.5, 54).select("seq_id", F.md5("noisy").alias("noisy_md5"), "n_edits")


# -- spans of tokens
_TOKENS = "t as (select seq_id, unnest(string_split(text, ' ')) as t, unnest(range(0, len(string_split(text, ' ')))) as j from lines), n as (select seq_id, count(*) as n from t group by 1)"
_RATES = "rates as (select length(regexp_replace(text, '[A-Za-z ]', '', 'g')) * 1.0::double / length(text) as x from lines)"


def span_noise_sql(seed: int, rate: str, head: str = "") -> str:
    """Spans with rates: rate is SQL of the draws u and v."""
    length, at = f"5 + cast(floor({uniform_sql(seed + 1, 'seq_id', 'k')} * 6) as bigint)", lambda k: uniform_sql(seed, "seq_id", f"(j * {SN.STRIDE} + {k})")
    return f"""with {LINES}, {head}{_TOKENS}, l as (select seq_id, n, k, {length} as size from (select seq_id, n, unnest(range(0, cast(floor((n - 1) / 5) + 1 as bigint))) as k from n)),
 b as (select seq_id, n, k, cast(sum(size) over (partition by seq_id order by k) as bigint) as stop, cast(sum(size) over (partition by seq_id order by k) - size as bigint) as start from l),
 s as (select seq_id, k, start, least(stop, n) as stop, {rate} as p from (select *, {uniform_sql(seed + 2, 'seq_id', 'k')} as u, {uniform_sql(seed + 3, 'seq_id', 'k')} as v from b where start < n)),
 w as (select t.seq_id, j, n, stop, p, t.t, coalesce(lead(t.t) over (partition by t.seq_id order by j), '') as following from t join s on s.seq_id = t.seq_id and j >= start and j < stop join n on n.seq_id = t.seq_id),
 o as (select seq_id, j, case when t = '' then '' else array_to_string(list_transform(string_split(t, ''), lambda c, i: case when i < length(t) and {at('(i - 1)')} < p then c || ' ' else c end), '') end || case when j + 1 = n or following <> '' and j + 1 < stop and {at(SN.STRIDE - 1)} < p then '' else ' ' end as x from w),
 r as (select seq_id, count(*) as n_spans, round(sum(p), 4) as rates from s group by 1)
 select seq_id, md5(string_agg(x, '' order by j)) as noisy_md5, any_value(n_spans) as n_spans, any_value(rates) as rates from o join r using (seq_id) group by 1"""


def span_rows(noisy: DataFrame) -> DataFrame:
    return noisy.select("seq_id", F.md5("noisy").alias("noisy_md5"), F.size("rates").cast("long").alias("n_spans"), F.round(F.aggregate("rates", F.lit(0.0), lambda a, x: a + x), 4).alias("rates"))


_LAW = f"{_RATES}, law as (select round(-count(x) filter (where x > 0) / sum(ln(x)) filter (where x > 0), 6) as exponent, round(avg(cast(x = 0 as int)), 6) as p_zero from rates), "


@query(span_noise_sql(61, "(select case when v < p_zero or exponent is null then 0.0::double else pow(u, 1 / exponent) end from law)", _LAW))
def power_law_span_noise(spark, sf_dir):
    """Lines with space errors in spans, at rates of a power law with a share of zeros, fitted to what part of each line is no letter."""
    rows = lines(spark, sf_dir).select("seq_id", "text")
    law = SN.fitted_power_law(rows.select((F.length(F.regexp_replace("text", "[A-Za-z ]", "")) / F.length("text")).alias("x")), "x")
    rate = lambda u, v: F.when((v < F.col("p_zero")) | F.col("exponent").isNull(), 0.0).otherwise(SN.power_law(F.col("exponent"), u))
    return span_rows(SN.fitted_spans(rows.crossJoin(F.broadcast(law)), rate, 61))  # law: one row


GAMMA = SN.gamma_quantiles(0.6, 0.06)
_GRID = "[" + ", ".join(f"{g!r}::double" for g in GAMMA) + "]"


@query(span_noise_sql(65, "grid[cast(floor(u * 256) as bigint) + 1] + (u * 256 - floor(u * 256)) * (grid[cast(floor(u * 256) as bigint) + 2] - grid[cast(floor(u * 256) as bigint) + 1])".replace("grid", "(select g from grid)"), f"grid as (select {_GRID} as g), "))
def gamma_span_noise(spark, sf_dir):
    """Lines with space errors in spans, at rates of a gamma distribution."""
    return span_rows(SN.fitted_spans(lines(spark, sf_dir).select("seq_id", "text"), lambda u, v: SN.from_quantiles(GAMMA, u), 65))


def _percent(x: str) -> str:
    return f"lpad(cast(cast(round({x} * 100) as int) as varchar), 3, '0')"


_MARKS, _DIGITS = "length(regexp_replace(text, '[A-Za-z0-9 ]', '', 'g')) * 1.0::double / length(text)", "length(regexp_replace(text, '[^0-9]', '', 'g')) * 1.0::double / length(text)"
_NAMED = f"select '' as key, v, count(*) as w from (select lpad(cast(len(string_split(text, ' ')) as varchar), 2, '0') || {_percent(_MARKS)} || {_percent(_DIGITS)} as v from lines where len(string_split(text, ' ')) <= 10) group by 2"
_OTHER = lambda k: uniform_sql(72, "seq_id", f"(j * {SN.STRIDE} + {k})")


@query(f"""with recursive {LINES}, {tabulated('iv', _NAMED)}, {_TOKENS},
 h as (select seq_id, j, {uniform_sql(71, 'seq_id', '(j * 4 + 1)')} * (select total from iv_n) as x from t where {uniform_sql(71, 'seq_id', '(j * 4)')} < cast({SN.P_ERRONEOUS!r} as double)),
 e as (select seq_id, j as pos, cast(substr(v, 1, 2) as bigint) as size, v as new from h join iv on x >= lo and x < hi), {SETTLED},
 s as (select seq_id, pos, size, cast(substr(new, 3, 3) as int) / 100 as p_insert, cast(substr(new, 6, 3) as int) / 100 as p_delete from kept where ok),
 w as (select t.seq_id, t.j, t.t, n.n, s.pos, j + 1 = s.pos + s.size or j + 1 = n.n as last, p_insert, p_delete from t join n using (seq_id) left join s on s.seq_id = t.seq_id and j >= pos and j < pos + size),
 o as (select seq_id, j, pos, case when pos is null or t = '' then t else array_to_string(list_transform(string_split(t, ''), lambda c, i: case when (i > 1 or j > pos) and (i < length(t) or last) and {_OTHER('(i - 1)')} < p_insert then ' ' || c else c end), '') end
  || case when j + 1 = n or pos is not null and not last and {_OTHER(SN.STRIDE - 1)} < p_delete then '' else ' ' end as x from w)
 select seq_id, md5(trim(regexp_replace(string_agg(x, '' order by j), ' +', ' ', 'g'))) as noisy_md5, count(distinct pos) as n_spans from o group by 1""")
def empirical_span_noise(spark, sf_dir):
    """Lines with erroneous spans whose lengths and rates are those of the corpus' short lines: their shares of marks and digits."""
    rows = lines(spark, sf_dir).select("seq_id", "text")
    share = lambda pattern: F.length(F.regexp_replace("text", pattern, "")) / F.length("text")
    rates = rows.select(F.size(F.split("text", " ")).alias("n_tokens"), share("[A-Za-z0-9 ]").alias("p_insert"), share("[^0-9]").alias("p_delete"))
    return SN.empirical_spans(rows, rates, 71).select("seq_id", F.md5("noisy").alias("noisy_md5"), "n_spans")
