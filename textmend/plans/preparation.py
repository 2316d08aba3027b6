"""Queries that prepare texts: normalisation, sentences, tokens, training examples, noise, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmend.functions import spaces as SP
from textmend.functions import text as T
from textmend.functions.rng import at_place, row_seed, uniform, uniform_sql
from textmend.operators import noise as N
from textmend.operators import stats as S
from textmend.plans.corpus import LINES, TOKENS, UNI, VOCAB, documents, lines
from textmend.plans.repair import GAPS

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


OLD_PRINT = "replace(replace(replace(text, 'ss', 'ſs'), 'fi', 'ﬁ'), ', ', ' , ')"
LIGATURES = "replace(replace(replace(replace(t, 'ſ', 's'), 'ﬁ', 'fi'), 'ﬀ', 'ff'), 'ﬃ', 'ffi')"


@query(rf"""with p as (select doc_id, replace({OLD_PRINT}, 'n d', 'n- d') || ' “ so ” ‘it’' as t from documents)
 select doc_id, md5(translate(t, '‘’“”', '''''""')) as quotes, md5(regexp_replace(regexp_replace({LIGATURES}, '[ ]+([,;?!:)”])', '\1', 'g'), '([(“])[ ]+', '\1', 'g')) as modern,
 md5(regexp_replace(regexp_replace(t, '(\p{{L}})[-‑] (\p{{L}})', '\1\2', 'g'), '(\p{{L}})[-‑] (\p{{L}})', '\1\2', 'g')) as joined from p""")
def print_normalisation(spark, sf_dir):
    """Quotation marks, long s and ligatures, and hyphenation of texts that get some first."""
    t = documents(spark, sf_dir).select("doc_id", F.expr(f"replace({OLD_PRINT}, 'n d', 'n- d') || ' “ so ” ‘it’'").alias("t"))
    return t.select("doc_id", F.md5(T.unify_quotes(F.col("t"))).alias("quotes"), F.md5(T.fix_old_print(F.col("t"))).alias("modern"), F.md5(T.remove_hyphenation(F.col("t"))).alias("joined"))


SENTENCES = rf"sentences as (select seq_id, doc_id, trim(replace(unnest(string_split(regexp_replace(regexp_replace(text, '{T.ABBREVIATED}', '\1' || chr(1), 'g'), '([.!?]) ', '\1' || chr(10), 'g'), chr(10))), chr(1), ' ')) as s from lines)"


@query(f"with {LINES}, {SENTENCES} select seq_id, count(*) as n, md5(string_agg(s, '|' order by s)) as sentences_md5 from sentences where s <> '' group by 1")
def sentences_with_abbreviations(spark, sf_dir):
    """Sentences end at marks before spaces, but not after abbreviations."""
    s = lines(spark, sf_dir).select("seq_id", F.explode(T.sentences(F.col("text"))).alias("s")).where("s <> ''")
    return s.groupBy("seq_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("s")), "|")).alias("sentences_md5"))


@query(f"with {LINES}, {SENTENCES}, g as (select doc_id, seq_id, s from sentences where length(s) > 1 and not regexp_matches(s, ' [.,;:!?)] |[(] |<|>|\"\"|\\(\\)| '' |\\([,;]|colspan')) select doc_id, md5(min_by(s, md5('13:' || seq_id || ':' || s))) as sentence_md5 from g group by 1")
def random_sentence_per_document(spark, sf_dir):
    """One sentence of each document, of those that are prose: of the least hash with the seed."""
    s = lines(spark, sf_dir).select("doc_id", "seq_id", F.explode(T.sentences(F.col("text"))).alias("s")).where((F.length("s") > 1) & ~F.col("s").rlike(T.BAD_SENTENCE))
    return s.groupBy("doc_id").agg(F.md5(F.min_by("s", F.md5(F.concat_ws(":", F.lit("13"), F.col("seq_id").cast("string"), "s")))).alias("sentence_md5"))


@query(r"""select conv_id, turn, cast(len(runs) as bigint) as n_runs, cast(len(sets) as bigint) as n_sets, md5(array_to_string(sets, '|')) as sets_md5
 from (select conv_id, turn, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+(?: [\p{L}\p{N}]+)*') as runs, regexp_extract_all(coalesce(text, ''), '(?:[A-Za-z]+|[0-9]+|[^A-Za-z0-9 ]+) ?| ') as sets from conversations)""")
def editable_runs_and_character_sets(spark, sf_dir):
    """Runs of words that single spaces part, and tokens that end where the set of characters changes."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    sets = T.character_set_tokens(F.col("t"))
    return t.select("conv_id", "turn", F.size(T.editable_runs(F.col("t"))).cast("long").alias("n_runs"), F.size(sets).cast("long").alias("n_sets"), F.md5(F.array_join(sets, "|")).alias("sets_md5"))


@query(r"""with t as (select distinct unnest(string_split(text, ' ')) as token from documents), p as (select token, regexp_extract(token, '^([^\p{L}\p{N}]*)((?s:.*?))([^\p{L}\p{N}]*)$', ['a', 'b', 'c']) as g from t where token <> '')
 select token, g.a as prefix, g.b as word, g.c as suffix, length(regexp_replace(g.b, '[^\p{L}]', '', 'g')) >= 0.6 * length(g.b) and g.b <> '' as is_word, case when rtrim(token, '-') = '' then left(token, 1) else rtrim(token, '-') end as trimmed from p""")
def stripped_tokens(spark, sf_dir):
    """Each distinct token without the marks around it, whether what is left is a word, and without hyphens at its end."""
    t = documents(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("token")).where("token <> ''").distinct()
    return t.select("token", *[c.alias(n) for n, c in T.stripped(F.col("token")).items()], T.without_end_hyphens(F.col("token")).alias("trimmed"))


@query(f"""with {LINES}, {VOCAB}, known as (select list(ch order by rank) as k from vocab where rank < 40), c as (select seq_id, k, list_transform(list_filter(string_split(text, ''), lambda x: x <> ''), lambda x: coalesce(list_position(k, x), 0) + 2) as codes from lines, known)
 select seq_id, md5(array_to_string([1] || codes || [0], ',')) as codes_md5, md5(array_to_string(list_transform(codes, lambda x: case when x = 2 then '?' else k[x - 2] end), '')) as decoded_md5,
 md5(array_to_string((codes[1:64] || [0 for _ in range(64)])[1:64], ',')) as head_md5, md5(array_to_string(([1 for _ in range(64)] || codes)[-64:], ',')) as tail_md5, cast(least(len(codes), 64) as bigint) as n_unmasked from c""")
def encoded_batches(spark, sf_dir):
    """Lines as codes between a begin and an end, back again, and cut or padded to 64: heads before ends, tails after begins."""
    vocab = S.top(S.character_frequencies(documents(spark, sf_dir)), 40, "ch", key_descending=True)
    known = vocab.agg(F.transform(F.sort_array(F.collect_list(F.struct("cnt", "ch")), asc=False), lambda x: x["ch"]).alias("k"))  # one row of 40 characters
    rows = lines(spark, sf_dir).crossJoin(F.broadcast(known)).select("seq_id", "k", T.encoded(F.col("text"), F.col("k")).alias("codes"))
    csv = lambda codes: F.md5(F.array_join(F.transform(codes, lambda x: x.cast("string")), ","))
    one = F.array(F.lit(1).cast("long"))
    return rows.select(
        "seq_id", csv(F.concat(one, "codes", F.array(F.lit(0).cast("long")))).alias("codes_md5"), F.md5(T.decoded(F.col("codes"), F.col("k"))).alias("decoded_md5"),
        csv(T.padded(F.col("codes"), 64, 0)).alias("head_md5"), csv(T.padded(F.col("codes"), 64, 1, front=True)).alias("tail_md5"), F.least(F.size("codes"), F.lit(64)).cast("long").alias("n_unmasked"))


@query(f"with {LINES}, g as (select seq_id, replace(text, ' ', '') as x, {GAPS.format('text')} as o from lines) select seq_id, md5(x) as x_md5, md5(array_to_string(list_transform(o, lambda n: (n > 0)::int), ',')) as y_md5 from g")
def labeling_examples(spark, sf_dir):
    """What a labeler learns from: the characters, and for each gap and the end whether a space stands there."""
    y = F.transform(SP.gaps(F.col("text")), lambda n: (n > 0).cast("int").cast("string"))
    return lines(spark, sf_dir).select("seq_id", F.md5(SP.merged(F.col("text"))).alias("x_md5"), F.md5(F.array_join(y, ",")).alias("y_md5"))


WINDOW = f"cast(floor({uniform_sql(17, 'seq_id', 'k')} * length(text)) as int)"


@query(f"""with {LINES}, w as (select seq_id, text, k, {WINDOW} as spot from lines, (select unnest([0, 1]) as k))
 select seq_id, cast(k as int) as k, lpad(substr(text, greatest(spot - 7, 1), least(spot, 8)), 8, '#') || '|' || substr(text, spot + 1, 1) || '|' || rpad(substr(text, spot + 2, 8), 8, '#') as context from w""")
def context_windows(spark, sf_dir):
    """Two random places of each line with up to eight characters on each side, padded."""
    rows = lines(spark, sf_dir).select("seq_id", "text", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k"))
    at = F.floor(at_place(row_seed(17, F.col("seq_id")), F.col("k")) * F.length("text")).cast("int")
    rows = rows.withColumn("at", at)
    left = F.lpad(F.substring("text", F.greatest(F.col("at") - 7, F.lit(1)), F.least(F.col("at"), F.lit(8))), 8, "#")
    return rows.select("seq_id", "k", F.concat_ws("|", left, F.substring("text", F.col("at") + 1, F.lit(1)), F.rpad(F.substring("text", F.col("at") + 2, F.lit(8)), 8, "#")).alias("context"))


# -- noise in SQL: per token t at place i (from 1), draw k
def draw(seed: int, k: int) -> str:
    return uniform_sql(seed, "seq_id", f"((i - 1) * 8 + {k})")


def pick(seed: int, k: int, n: str) -> str:
    return f"cast(floor({draw(seed, k)} * ({n})) as int)"


def tokens_sql(text: str, change: str) -> str:
    return f"array_to_string(list_transform(string_split({text}, ' '), lambda t, i: {change}), ' ')"


def typo_sql(seed: int, p: float, letters: str = N.LETTERS) -> str:
    at, letter = pick(seed, 2, "length(t) - 1"), f"substr('{letters}', {pick(seed, 3, str(len(letters)))} + 1, 1)"
    head, here, rest = f"substr(t, 1, {at})", f"substr(t, {at} + 1, 1)", f"substr(t, {at} + 2)"
    kind = pick(seed, 1, "4")
    return rf"case when length(t) > 1 and regexp_matches(t, '^\p{{L}}+$') and {draw(seed, 0)} < {p} then case {kind} when 0 then {head} || {letter} || {here} || {rest} when 1 then {head} || {rest} when 2 then {head} || {letter} || {rest} else {head} || substr({rest}, 1, 1) || {here} || substr({rest}, 2) end else t end"


def hyphen_sql(seed: int, p: float) -> str:
    at = f"(2 + {pick(seed, 1, 'length(t) - 3')})"
    return rf"case when length(t) >= 4 and regexp_matches(t, '^\p{{L}}+$') and {draw(seed, 0)} < {p} then substr(t, 1, {at}) || '- ' || substr(t, {at} + 1) else t end"


def ocr_sql(seed: int, p: float) -> str:
    cases = " ".join(f"when {k} then case when instr(t, '{wrong}') > 0 then substr(t, 1, instr(t, '{wrong}') - 1) || '{seen}' || substr(t, instr(t, '{wrong}') + {len(wrong)}) else t end" for k, (wrong, seen) in enumerate(N.OCR))
    return f"case when {draw(seed, 0)} < {p} then case {pick(seed, 1, str(len(N.OCR)))} {cases} else t end else t end"


def noise_query(name: str, sql: str, make) -> None:
    """Lines with spelling noise: the noisy text, and how many of its tokens no longer are the line's."""
    changed = "len(list_filter(list_zip(string_split(noisy, ' '), string_split(text, ' ')), lambda z: z[1] is distinct from z[2]))"

    def run(spark, sf_dir) -> DataFrame:
        rows = lines(spark, sf_dir).select("seq_id", "text", make(F.col("text"), F.col("seq_id")).alias("noisy"))
        pairs = F.zip_with(F.split("noisy", " "), F.split("text", " "), lambda a, b: ~a.eqNullSafe(b))
        return rows.select("seq_id", F.md5("noisy").alias("noisy_md5"), F.size(F.filter(pairs, lambda x: x)).cast("long").alias("n_changed"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = f"with {LINES}, n as (select seq_id, text, {sql} as noisy from lines) select seq_id, md5(noisy) as noisy_md5, cast({changed} as bigint) as n_changed from n"


MARKS = N.LETTERS + "ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:-"
noise_query("typo_noise", tokens_sql("text", typo_sql(21, 0.1)), lambda t, i: N.typos(t, i, 0.1, 21))
noise_query("typo_and_punctuation_noise", tokens_sql("text", typo_sql(25, 0.2, MARKS)), lambda t, i: N.typos(t, i, 0.2, 25, MARKS))
noise_query("hyphen_noise", tokens_sql("text", hyphen_sql(22, 0.1)), lambda t, i: N.hyphens(t, i, 0.1, 22))
noise_query("ocr_noise", tokens_sql("text", ocr_sql(23, 0.1)), lambda t, i: N.ocr_errors(t, i, 0.1, 23))
_HYPHENED = tokens_sql("text", hyphen_sql(24, 0.0114))
noise_query("mixed_noise", f"case when {uniform_sql(25, 'seq_id')} < 0.5 then {tokens_sql(_HYPHENED, ocr_sql(26, 0.1))} else {tokens_sql(_HYPHENED, typo_sql(27, 0.1))} end", lambda t, i: N.mixed(t, i, 0.0114, 0.1, 0.1, 0.5, 24))


def characters_sql(text: str, change: str) -> str:
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c, i: {change}), '')"


_U, _V = uniform_sql(28, "seq_id", "(i - 1)"), uniform_sql(29, "seq_id", "(i - 1)")
noise_query("character_noise", characters_sql("text", f"case when {_U} < 0.02 then '' when {_U} < 0.04 then substr('{N.LETTERS}', cast(floor({_V} * 26) as int) + 1, 1) || c else c end"), lambda t, i: N.characters(t, i, 0.04, 28))
_RATE = f"(case when {uniform_sql(33, 'seq_id')} < 1 / 3.0 then 0.0 when {uniform_sql(33, 'seq_id')} < 2 / 3.0 then 0.01 + 0.09 * {uniform_sql(34, 'seq_id')} else 0.1 + 0.9 * {uniform_sql(34, 'seq_id')} end)"
_W = uniform_sql(35, "seq_id", "(i - 1)")


@query(f"""with {LINES}, r as (select seq_id, text, string_split(text, '') as ch, {_RATE} as rate from lines), n as (select seq_id, rate, array_to_string(list_transform(ch, lambda c, i: case when c = ' ' then case when {_W} < rate then '' else ' ' end when i > 1 and ch[i - 1] <> ' ' and {_W} < rate / 5 then ' ' || c else c end), '') as noisy from r)
 select seq_id, round(rate, 6) as rate, md5(noisy) as noisy_md5 from n""")
def three_regime_noise(spark, sf_dir):
    """A third of the lines stays as it is, a third loses one to ten, a third ten to a hundred percent of its spaces, and gets
    a fifth as many where none belong."""
    u, v = uniform(33, F.col("seq_id")), uniform(34, F.col("seq_id"))
    rows = lines(spark, sf_dir).withColumn("rate", F.when(u < 1 / 3.0, 0.0).when(u < 2 / 3.0, 0.01 + 0.09 * v).otherwise(0.1 + 0.9 * v))
    return rows.select("seq_id", F.round("rate", 6).alias("rate"), F.md5(SP.corrupt(F.col("text"), F.col("seq_id"), F.col("rate") / 5, F.col("rate"), 35)).alias("noisy_md5"))


_X = uniform_sql(36, "seq_id", "(i - 1)")


@query(f"""with {LINES}, c as (select seq_id, text, {_X} as u, i from (select seq_id, text, unnest(range(1, length(text) + 1)) as i from lines) where substr(text, i, 1) = ' '), k as (select seq_id, i from c qualify row_number() over (partition by seq_id order by u, i) <= 3)
 select seq_id, coalesce(string_agg(cast(i - 1 as varchar), ',' order by i), '') as places, md5(any_value(d)) as corrupt_md5 from (select l.seq_id, k.i, array_to_string(list_filter(list_transform(string_split(l.text, ''), lambda c, j: case when list_contains(p.ps, j) then '' else c end), lambda c: c <> ''), '') as d from lines l left join (select seq_id, list(i) as ps from k group by 1) p using (seq_id) left join k using (seq_id)) group by 1""")
def three_spaces_fewer(spark, sf_dir):
    """Each line without three of its spaces, drawn at random, and the places of those."""
    chars = F.split("text", "")
    seeded = lines(spark, sf_dir).select("seq_id", "text", row_seed(36, F.col("seq_id")).alias("seed"), chars.alias("ch"))
    drawn = F.filter(F.transform("ch", lambda c, i: F.when(c == " ", F.struct(at_place(F.col("seed"), i).alias("u"), i.alias("i")))), lambda x: x.isNotNull())
    rows = seeded.select("seq_id", "ch", F.sort_array(F.transform(F.slice(F.sort_array(drawn), 1, 3), lambda x: x["i"])).alias("gone"))
    left = F.array_join(F.transform("ch", lambda c, i: F.when(F.array_contains("gone", i), "").otherwise(c)), "")
    return rows.select("seq_id", F.array_join(F.transform("gone", lambda i: i.cast("string")), ",").alias("places"), F.md5(left).alias("corrupt_md5"))


@query(f"with {LINES}, {TOKENS}, {UNI} select token, cnt, case when cnt >= 100 then 'frequent' when length(token) = 1 and not regexp_matches(token, '^[aAI0-9]$') then 'single' when cnt > 2 then 'known' else 'rare' end as kind from uni")
def dictionary_lookups(spark, sf_dir):
    """Counts as a dictionary gives them: single characters other than a, A, I and digits are no words."""
    u = S.merged_unigrams(S.unigrams(lines(spark, sf_dir)))
    single = (F.length("token") == 1) & ~F.col("token").rlike("^[aAI0-9]$")
    return u.select("token", "cnt", F.when(F.col("cnt") >= 100, "frequent").when(single, "single").when(F.col("cnt") > 2, "known").otherwise("rare").alias("kind"))
