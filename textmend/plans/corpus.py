"""Queries on corpus statistics, cleaning, matching and splitting, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmend.functions import text as T
from textmend.functions.rng import uniform, uniform_sql
from textmend.operators import stats as S

QUERIES, ORACLE_SQL = {}, {}
#: The lines of all documents, as ``text.lines`` makes them.
LINES = """lines as (select doc_id * 1000000 + i - 1 as seq_id, doc_id, lang, source, l as text from (select doc_id, lang, source, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where l <> '')"""
#: White space and tokens in RE2's spelling.
WS2 = r"[\s\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TOKENS = r"""tokens as (select seq_id, ltrim(t) as token, i = 1 or starts_with(t, ' ') as delimiter_before, i from (select seq_id, unnest(regexp_extract_all(text, '\s?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}])')) as t, generate_subscripts(regexp_extract_all(text, '\s?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}])'), 1) as i from lines))"""
UNI = "uni as (select token, count(*) as cnt from tokens group by 1)"
BI = "bi as (select a.token as l, b.token as r, count(*) as cnt from tokens a join tokens b on a.seq_id = b.seq_id and b.i = a.i + 1 group by 1, 2)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lines(documents(spark, sf_dir))


@query("select ch, count(*) as cnt from (select unnest(string_split(text, '')) as ch from documents) where ch <> '' group by 1")
def char_frequencies(spark, sf_dir):
    return S.character_frequencies(documents(spark, sf_dir))


@query(rf"select token, count(*) as cnt from (select unnest(regexp_split_to_array(text, '{WS2}+')) as token from documents) where token <> '' group by 1 order by 2 desc, 1 limit 100")
def token_frequencies_topn(spark, sf_dir):
    return S.top(S.token_frequencies(documents(spark, sf_dir)), 100, "token")


@query(f"with {LINES}, {TOKENS} select token, delimiter_before, count(*) as cnt from tokens group by 1, 2")
def unigrams_by_delimiter(spark, sf_dir):
    return S.unigrams(lines(spark, sf_dir))


@query(f"with {LINES}, {TOKENS} select token, cast(count(*) as bigint) as cnt from tokens group by 1")
def unigrams_merged(spark, sf_dir):
    return S.merged_unigrams(S.unigrams(lines(spark, sf_dir)))


@query(f'with {LINES}, {TOKENS}, {BI} select l as "left", r as "right", cnt from bi')
def bigram_counts(spark, sf_dir):
    return S.bigrams(lines(spark, sf_dir))


@query(f'with {LINES}, {TOKENS}, {UNI}, {BI} select l as "left", r as "right", round(0.5 * b.cnt / a.cnt + 0.5 * c.cnt / (select sum(cnt) from uni), 6) as p from bi b join uni a on a.token = b.l join uni c on c.token = b.r')
def bigram_interpolated(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return S.interpolated(S.bigrams(rows), S.merged_unigrams(S.unigrams(rows))).select("left", "right", F.round("p", 6).alias("p"))


@query(r"select word, count(*) as freq from (select unnest(regexp_extract_all(text, '[\p{L}\p{N}_][\p{L}\p{N}_'']*')) as word from (select text from documents union all select text from conversations)) group by 1 having count(*) > 2")
def vocabulary_gt2(spark, sf_dir):
    both = documents(spark, sf_dir).select("text").unionAll(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text"))
    return S.vocabulary(both)


VOCAB = "chars as (select ch, count(*) as cnt from (select unnest(string_split(text, '')) as ch from documents) where ch <> '' group by 1), vocab as (select ch, cnt, row_number() over (order by cnt desc, ch desc) - 1 as rank from chars)"


@query(f"with {VOCAB} select ch, cnt, rank from vocab where rank < 200")
def char_encoder(spark, sf_dir):
    return S.ranked(S.character_frequencies(documents(spark, sf_dir)), "ch", most=200)


@query(f"with {LINES}, {VOCAB}, known as (select string_agg(ch, '') as k from vocab where rank < 40) select seq_id, cast(length(text) + 2 as bigint) as n_codes, cast(length(translate(text, k, '')) as bigint) as n_unknown from lines, known")
def encoded_lengths(spark, sf_dir):
    """Codes of each line with its begin and end, and how many are unknown to an encoder of 40 characters."""
    vocab = S.top(S.character_frequencies(documents(spark, sf_dir)), 40, "ch", key_descending=True)
    known = vocab.agg(F.array_join(F.collect_list("ch"), "").alias("k"))  # one row of 40 characters
    joined = lines(spark, sf_dir).crossJoin(F.broadcast(known))
    return joined.select("seq_id", (F.length("text") + 2).cast("long").alias("n_codes"), F.length(F.expr("translate(text, k, '')")).cast("long").alias("n_unknown"))


@query(f"""with {LINES}, {TOKENS} select lang, count(*) as n_lines, cast(sum(length(text)) as bigint) as n_chars, cast(sum(len(string_split(text, ' '))) as bigint) as n_tokens, round(avg(length(text)), 6) as mean_chars,
 cast(sum(length(text) - 2 * (length(text) - length(replace(text, ' ', ''))) - 1) as bigint) as insert_positions, (select count(distinct w) from (select lang as g, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_'']*')) as w from documents) where g is not distinct from lang) as unique_words from lines group by 1""")
def dataset_statistics(spark, sf_dir):
    rows = lines(spark, sf_dir)
    spaces = F.length("text") - F.length(F.translate("text", " ", ""))
    by_lang = rows.groupBy("lang").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.size(F.split("text", " "))).alias("n_tokens"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"), F.sum(F.length("text") - 2 * spaces - 1).alias("insert_positions"))
    words = rows.select("lang", F.explode(T.words(F.col("text"))).alias("w")).distinct().groupBy("lang").agg(F.count("*").alias("unique_words"))
    words = words.withColumnRenamed("lang", "_lang")
    return by_lang.join(words, by_lang["lang"].eqNullSafe(words["_lang"]), "left").drop("_lang").na.fill(0, ["unique_words"])


NOISY = "replace(replace(text, ' the ', '  the' || chr(160)), ' de ', ' ' || chr(8201) || 'de  ')"


@query(rf"""select doc_id, md5(trim(regexp_replace(t, '{WS2}+', ' ', 'g'))) as unified, md5(regexp_replace(trim(translate(t, chr(160), ' ')), ' {{2,}}', ' ', 'g')) as preprocessed, length(replace(t, ' ', ''))::bigint as n_merged, md5(translate(t, ' -', '')) as match_key,
 md5(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) as ascii from (select doc_id, {NOISY} as t from documents)""")
def clean_text(spark, sf_dir):
    t = F.replace(F.replace("text", F.lit(" the "), F.lit("  the\u00a0")), F.lit(" de "), F.lit(" \u2009de  "))
    rows = documents(spark, sf_dir).select("doc_id", t.alias("t"))
    t = F.col("t")
    return rows.select("doc_id", F.md5(T.unify_spaces(t)).alias("unified"), F.md5(T.preprocess(t)).alias("preprocessed"), F.length(T.remove_spaces(t)).cast("long").alias("n_merged"), F.md5(T.match_key(t)).alias("match_key"), F.md5(T.ascii_only(t)).alias("ascii"))


@query("""select lang, count(*) as n_paragraphs, count(distinct doc_id) as n_docs, max(n) as most, cast(sum(is_table) as bigint) as n_tables from (select lang, doc_id, count(*) over (partition by doc_id) as n, (contains(l, '|'))::int as is_table
 from (select lang, doc_id, unnest(string_split(text, chr(10))) as l from documents) where trim(l) <> '' and l <> '<onlyinclude></onlyinclude>') group by 1""")
def paragraph_stats(spark, sf_dir):
    p = documents(spark, sf_dir).select("lang", "doc_id", F.explode(F.split("text", "\n")).alias("l")).where("trim(l) <> '' and l <> '<onlyinclude></onlyinclude>'")
    by_doc = p.groupBy("lang", "doc_id").agg(F.count("*").alias("n"), F.sum(F.contains("l", F.lit("|")).cast("long")).alias("t"))
    return by_doc.groupBy("lang").agg(F.sum("n").alias("n_paragraphs"), F.count("*").alias("n_docs"), F.max("n").alias("most"), F.sum("t").alias("n_tables"))


@query(f"""with {LINES}, s as (select seq_id, trim(unnest(string_split(regexp_replace(text, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)))) as s from lines) select seq_id, count(*) as n_kept from s where length(s) > 1 and not regexp_matches(s, ' [.,;:!?)] |[(] |<|>|""|\\(\\)| '' |\\([,;]|colspan') and length(s) - length(replace(s, '?', '')) < 4 and s <> '[formula]' group by 1""")
def sentence_filter(spark, sf_dir):
    s = lines(spark, sf_dir).select("seq_id", F.explode(F.split(F.regexp_replace("text", r"([.!?]) ", "$1\n"), "\n")).alias("s")).withColumn("s", F.trim("s"))
    good = (F.length("s") > 1) & ~F.col("s").rlike(T.BAD_SENTENCE) & (F.length("s") - F.length(F.translate("s", "?", "")) < 4) & (F.col("s") != "[formula]")
    return s.where(good).groupBy("seq_id").agg(F.count("*").alias("n_kept"))


HYPHENS = f"h as (select doc_id, seq_id, case when {uniform_sql(11, 'seq_id')} < 0.3 then text || '-' else text end as text from lines), m as (select *, 1 - coalesce(lag((text like '%-')::int) over (partition by doc_id order by seq_id), 0) as b from h), n as (select *, sum(b) over (partition by doc_id order by seq_id) as island from m)"


@query(f"with {LINES}, {HYPHENS} select doc_id, cast(island as bigint) as island, min(seq_id) as first, count(*) as n_lines, md5(string_agg(text, '' order by seq_id)) as text_md5, cast(sum(length(replace(text, ' ', ''))) as bigint) as n_characters from n group by 1, 2")
def hyphen_islands(spark, sf_dir):
    """Some lines get a hyphen at their end; islands of continued lines are joined."""
    t = F.when(uniform(11, F.col("seq_id")) < 0.3, F.concat("text", F.lit("-"))).otherwise(F.col("text"))
    rows = lines(spark, sf_dir).select("doc_id", "seq_id", t.alias("text"))
    out = T.hyphen_islands(rows, "doc_id", "seq_id")
    return out.select("doc_id", "island", "first", "n_lines", F.md5("text").alias("text_md5"), F.aggregate("sizes", F.lit(0), lambda a, x: a + x).cast("long").alias("n_characters"))


@query(f"""with {LINES}, b as (select doc_id, seq_id, case when {uniform_sql(12, 'seq_id')} < 0.3 then '' else text end as text from lines), p as (select *, sum((text = '')::int) over (partition by doc_id order by seq_id) as para from b)
 select doc_id, cast(para as bigint) as para, md5(string_agg(text, ' ' order by seq_id)) as text_md5 from p where text <> '' group by 1, 2""")
def blank_line_paragraphs(spark, sf_dir):
    """Some lines are blanked; the lines between blank ones are joined."""
    rows = lines(spark, sf_dir).select("doc_id", "seq_id", F.when(uniform(12, F.col("seq_id")) < 0.3, "").otherwise(F.col("text")).alias("text"))
    return T.paragraphs(rows, "doc_id", "seq_id").select("doc_id", "para", F.md5("text").alias("text_md5"))


@query(r"""select conv_id, turn, cast(len(p) as bigint) as n_pretokens, cast(len(list_filter(p, lambda x: regexp_matches(x, '^[\p{L}\p{N}]'))) as bigint) as n_words, cast(len(list_filter(p, lambda x: regexp_matches(x, '^\s'))) as bigint) as n_spaces
 from (select conv_id, turn, regexp_extract_all(text, '\p{N}+(?:[.,]\p{N}+)*|\p{L}+(?:-\p{L}+)*(?:[''’][stm]\b)?|\s+|[^\s\p{L}\p{N}]') as p from conversations)""")
def pretokenize_counts(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", T.pretokens(F.col("text")).alias("p"))
    return p.select("conv_id", "turn", F.size("p").cast("long").alias("n_pretokens"), F.size(F.filter("p", lambda x: x.rlike(r"^[\p{L}\p{N}]"))).cast("long").alias("n_words"), F.size(F.filter("p", lambda x: x.rlike(r"^\s"))).cast("long").alias("n_spaces"))


SHARE = "('0x' || substr(md5('42:' || doc_id), 1, 8))::bigint / 4294967296.0"


@query(f"select doc_id, case when {SHARE} < 0.8 then 'training' when {SHARE} < 0.9 then 'development' else 'test' end as split from documents")
def split_datasets(spark, sf_dir):
    return S.split_names(documents(spark, sf_dir), "doc_id", {"training": 0.8, "development": 0.1, "test": 0.1}, 42).select("doc_id", "split")


@query("select doc_id, md5('7:' || doc_id) as place from documents order by 2 limit 100")
def seeded_sample(spark, sf_dir):
    """A random subset of 100, the same for a seed everywhere."""
    return documents(spark, sf_dir).select("doc_id", S.seeded_order(7, "doc_id").alias("place")).orderBy("place").limit(100)


@query(f"with {LINES} select doc_id, max_by(seq_id, md5('9:' || seq_id)) as seq_id from lines where length(text) > 1 group by 1")
def random_line_per_document(spark, sf_dir):
    rows = lines(spark, sf_dir).where("length(text) > 1")
    return rows.groupBy("doc_id").agg(F.max_by("seq_id", S.seeded_order(9, "seq_id")).alias("seq_id"))


ITEM_LINES = "items as (select item_id * 1000 + i - 1 as id, l as text from (select item_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from benchmark))"


def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return split.select((F.col("item_id") * 1000 + F.col("line")).alias("id"), "text")


@query(f"with {LINES}, {ITEM_LINES}, t as (select replace(text, ' ', '') as key, max(id) as true_id from items group by 1) select l.seq_id as input_id, t.true_id from (select seq_id, replace(text, ' ', '') as key from lines) l join t using (key)")
def match_by_nospace(spark, sf_dir):
    """Lines of documents that are a benchmark line but for spaces."""
    return S.matched_lines(item_lines(spark, sf_dir), lines(spark, sf_dir).select(F.col("seq_id").alias("id"), "text"))


@query(f"with {LINES}, {ITEM_LINES} select id, min(seq_id) as seq_id, count(*) as n from items b join lines d on starts_with(replace(d.text, ' ', ''), substr(replace(b.text, ' ', ''), 1, 30)) where length(replace(b.text, ' ', '')) >= 30 group by 1")
def prefix_span_match(spark, sf_dir):
    """Lines that begin as a benchmark line does, but for spaces: an equi-join on the first 30 characters."""
    keyed = lambda df, i: df.select(i, F.substring(T.remove_spaces(F.col("text")), 1, 30).alias("key")).where("length(key) = 30")
    joined = keyed(item_lines(spark, sf_dir), "id").join(keyed(lines(spark, sf_dir), "seq_id"), "key")
    return joined.groupBy("id").agg(F.min("seq_id").alias("seq_id"), F.count("*").alias("n"))


@query("select doc_id, length(text)::bigint as n from documents where doc_id not in (select doc_id from labels)")
def resume_anti_join(spark, sf_dir):
    done = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    return documents(spark, sf_dir).join(done, "doc_id", "left_anti").select("doc_id", F.length("text").cast("long").alias("n"))


@query("select doc_id, quality, length(text)::bigint as n from documents join labels using (doc_id)")
def positional_join(spark, sf_dir):
    return documents(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("doc_id", "quality", F.length("text").cast("long").alias("n"))


ABBREVIATION = r"with t as (select unnest(regexp_split_to_array(text, '\s+')) as t from documents), s as (select regexp_replace(t, '\.$', '') as token, (t like '%.')::int as dot from t where regexp_matches(t, '\p{L}') and length(t) <= 6) select token, cast(sum(dot) as bigint) as with_dot, cast(sum(1 - dot) as bigint) as without_dot from s where token <> '' and not contains(token, '.') group by 1 having sum(dot) >= 3 and (sum(1 - dot) = 0 or sum(dot) > 2.0 * sum(1 - dot))"


@query(ABBREVIATION)
def abbreviation_stats(spark, sf_dir):
    return S.abbreviations(documents(spark, sf_dir))


#: Stumps of a table of words: the word (i = 0) and it without its i-th character. Pairs that share one are an edit apart if one
#: is the other's stump, both lack the same place, or they lack neighbouring places and an equal character (an exchange).
STUMPED = "{0} as (select distinct token, i, case when i = 0 then token else substr(token, 1, i - 1) || substr(token, i + 1) end as stump from (select token, unnest(range(0, length(token) + 1)) as i from {1}))"
ONE_EDIT = "(a.i = 0 or b.i = 0 or a.i = b.i or abs(a.i - b.i) = 1 and substr(a.token, a.i, 1) = substr(b.token, b.i, 1))"


@query(f"with {LINES}, {TOKENS}, {UNI}, dict as (select token from uni where cnt >= 20 and regexp_matches(token, '^\\p{{L}}+$')) select stump, count(*) as n_tokens from (select distinct token, stump from (select token, case when i = 0 then token else substr(token, 1, i - 1) || substr(token, i + 1) end as stump from (select token, unnest(range(0, length(token) + 1)) as i from dict))) group by 1 having count(*) > 1")
def stump_index(spark, sf_dir):
    """Stumps that several frequent words share."""
    words = S.merged_unigrams(S.unigrams(lines(spark, sf_dir))).where(r"cnt >= 20 and token rlike '^\\p{L}+$'").select("token")
    return S.stumps(words).groupBy("stump").agg(F.count("*").alias("n_tokens")).where("n_tokens > 1")


@query(f"with {LINES}, {TOKENS}, {UNI}, words as (select token from uni where regexp_matches(token, '^\\p{{L}}+$')), dict as (select token from uni where cnt >= 100 and regexp_matches(token, '^\\p{{L}}+$')), {STUMPED.format('qs', 'words')}, {STUMPED.format('ds', 'dict')} select distinct a.token as query, b.token from qs a join ds b using (stump) where {ONE_EDIT}")
def fuzzy_join_one_edit(spark, sf_dir):
    """Every alphabetic word with the frequent ones that it is at most an edit apart from."""
    words = S.merged_unigrams(S.unigrams(lines(spark, sf_dir))).where(r"token rlike '^\\p{L}+$'")
    return S.fuzzy_join(words.select("token"), words.where("cnt >= 100").select("token"))


@query(f"""with {LINES}, {TOKENS}, {UNI}, {BI}, c as (select token, i, substr(token, 1, i) as l, substr(token, i + 1) as r from (select token, unnest(range(1, length(token))) as i from uni where length(token) > 1)),
 s as (select c.token, c.i, c.l, c.r, bi.cnt, least(a.cnt, b.cnt) as least from c join bi on bi.l = c.l and bi.r = c.r join uni a on a.token = c.l join uni b on b.token = c.r)
 select token, l as "left", r as "right", cnt from s qualify row_number() over (partition by token order by cnt desc, least desc, i) = 1""")
def best_split_per_token(spark, sf_dir):
    rows = lines(spark, sf_dir)
    u = S.merged_unigrams(S.unigrams(rows))
    return S.best_splits(u.select("token"), u, S.bigrams(rows))
