"""Personal data replaced by surrogates.

Detected mentions get keyed replacements of the same type, script, gender and format: digits for digits, letters of the
same case and script for letters, valid octets for addresses, card numbers of the same Luhn and account numbers of the
same check-digit validity, names of the title's gender. A replacement depends on the key and on the mention's canonical
value alone, so the same person or number is replaced alike in every document, whatever its punctuation. A name that a
title introduces is replaced wherever the document has it, with and without title; surnames carry no gender, so couples
keep a common one.

All distinct values are then checked: a surrogate must differ from every real value and from every other surrogate of
its type; values that collide try again with a new attempt number until none does, and only those exceptions are joined
back to the documents that mention them. Names have as many syllables as a hundred times the distinct names need, so
that exceptions stay rare; e-mail addresses and hosts too short for their number grow from the eighth attempt on. The
fixed formats (numbers, addresses) can run out: then, after 30 rounds without progress, an error says so.

Built-in functions only: no Python runs on the executors. The documents are read twice and never shuffled, unless the
exceptions are too many to broadcast.

Edge cases: null texts stay null, empty texts stay empty; mentions never overlap (leftmost wins); repeated rows are
replaced alike; rows with a null id are replaced like others; columns are kept as they are but for the text; a name
that stands in a document without any title is not known to be one and stays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmend.functions.arrays import let
from textmend.llm.common import checkpoint, small_side

#: Titles by gender (and of either), syllables by script, endings by script and gender.
MALE, FEMALE = "Mr Herr Monsieur Señor Sr Господин Κύριος".split(), "Mrs Ms Miss Frau Madame Mme Señora Sra Госпожа Κυρία".split()
NEUTRAL = "Dr dr Prof prof Professor Doctor Docteur Doctora Доктор".split()
SYLLABLES = {
    "latin": "bal cor den fal gar hol jan kel lor mar nel por quin ral sol tam ul vel war yor zan bri dra fen".split(),
    "cyrillic": "бал вор ган дол жар зел кор лен мар нов пол рад сол тим ул фед хор цар чер шал бри дра глу кле".split(),
    "greek": "βαλ γαρ δελ ζαν θεο καλ λαμ μαρ νικ παρ ραν σολ ταμ φιλ χαρ ψαλ αλκ ευρ ιων κλε πρι στα τρι φρα".split(),
}
ENDINGS = {"latin": ("o", "a"), "cyrillic": ("ов", "ова"), "greek": ("ος", "η")}

_TITLE = rf"(?:{'|'.join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))})\.? "
_WORD = r"\p{Lu}[\p{L}'’-]+"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+){1,8}",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\p{L}\p{N}])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE}){{1,2}}{_WORD}(?: {_WORD}){{0,2}}",
}
#: All mentions; and, where a title introduces a name, all words that may repeat it.
ANY = "|".join(PATTERNS.values())
ANY_NAME = rf"{ANY}|(?<![\p{{L}}\p{{N}}]){_WORD}"
#: Cheap test that every mention passes: three digits, an at sign or a title.
_HINT = rf"@|\d[\d .()-]{{2}}|(?=[{''.join(sorted({t[0] for t in MALE + FEMALE + NEUTRAL}))}]){_TITLE}"
_SEP = "\x1f"


def kind_of(e: Column) -> Column:
    return (
        F.when(F.contains(e, F.lit("@")), "email").when(e.rlike("^" + _TITLE), "person").when(e.rlike(r"^[A-Z]{2}\d"), "iban").when(e.rlike(r"^\p{L}"), "name")
        .when(e.rlike(r"^\d+\.\d+\.\d+\.\d+$") & ~e.rlike(r"\d{4}"), "ip").when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.startswith("+") | e.startswith("(") | (F.length(F.regexp_replace(e, r"\D", "")) < 13), "phone").otherwise("card")
    )


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def keys_of(e: Column, kind: Column) -> Column:
    """The canonical values a mention stands for, each with its type: one, an e-mail address also its host; none for names,
    which ``names_of`` has."""
    joined = F.regexp_replace(e, r"[^\p{L}\p{N}]", "")
    country = F.regexp_replace(F.regexp_extract(e, r"^\+\d{1,3}(?=[ .-])", 0), r"\D", "")  # kept apart: it stays
    phone = F.when(country == "", joined).otherwise(F.concat(F.lit("+"), country, F.lit("-"), F.substring(joined, F.length(country) + 1, F.length(joined))))
    plain = F.when(kind.isin("email", "ip"), F.lower(e)).when(kind == "phone", phone).otherwise(joined)
    own = F.array(F.concat(kind, F.lit(_SEP), plain))
    host = F.array(F.concat(F.lit("domain" + _SEP), F.regexp_extract(F.lower(e), _HOST, 1)))
    return F.when(kind.isin("person", "name"), F.array().cast("array<string>")).when(kind == "email", F.concat(own, host)).otherwise(own)


_HOST, _TOP, _TAIL = r"@(.*)\.[^.]*$", r"\.[^.]*$", r"(['’]s|['’-]+)$"


def _plain(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, _TAIL, ""))


def names_of(text: Column) -> Column:
    """map<word, key> of the names that titles introduce: the last word of a mention is a surname, those before it are given
    names of the title's gender. A word that is both is a given name."""

    def parts(e: Column) -> Column:
        title = F.regexp_extract(e, f"^(?:{_TITLE})+", 0)
        gender = F.when(title.rlike(rf"(?:^| )(?:{'|'.join(FEMALE)})\b"), "f").when(title.rlike(rf"(?:^| )(?:{'|'.join(MALE)})\b"), "m").otherwise("u")

        def entry(m: Column, w: Column, i: Column) -> Column:
            word = _plain(w)
            surname = F.concat(F.lit("surname-"), _script(w), F.lit(_SEP), F.regexp_replace(word, "(ов|ев|ин)а$", "$1"))
            given = F.concat(F.lit("given-"), m["gender"], F.lit("-"), _script(w), F.lit(_SEP), word)
            last = i == F.size(m["words"]) - 1
            return F.struct(word.alias("word"), F.when(last, 2).when(m["gender"] == "u", 1).otherwise(0).alias("order"), F.when(last, surname).otherwise(given).alias("key"))

        return let(F.struct(F.split(F.substring(e, F.length(title) + 1, F.length(e)), " ").alias("words"), gender.alias("gender")), lambda m: F.transform(m["words"], lambda w, i: entry(m, w, i)))

    entries = F.sort_array(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PATTERNS["person"]), F.lit(0)), parts)))
    first = lambda es: F.filter(es, lambda x, i: (i == 0) | (x["word"] != F.get(es, i - 1)["word"]))
    return let(let(entries, first), lambda es: F.map_from_arrays(F.transform(es, lambda x: x["word"]), F.transform(es, lambda x: x["key"])))


def _number(seed: Column, i) -> Column:
    """A keyed number for place i."""
    place = F.lit(str(i)) if isinstance(i, int) else i.cast("string")
    return F.conv(F.substring(F.sha2(F.concat(seed, F.lit(":"), place), 256), 1, 8), 16, 10).cast("long")


def _pick(letters: str, r: Column) -> Column:
    return F.substring(F.lit(letters), (F.pmod(r, F.lit(len(letters))) + 1).cast("int"), F.lit(1))


def _like(c: Column, r: Column) -> Column:
    """A letter or digit of the class of c."""
    return (
        F.when(c.rlike(r"\d"), _pick("0123456789", r)).when(c.rlike(r"\p{IsCyrillic}"), _pick("абвгдежзиклмнопрстуфхцчшэюя", r))
        .when(c.rlike(r"\p{IsGreek}"), _pick("αβγδεζηθικλμνξοπρστυφχψω", r)).when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", r)).otherwise(c)
    )


def _each(text: Column, seed: Column) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: let(_number(seed, i), lambda r: _like(c, r))), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a digit string whose last digit is the check digit."""
    twice = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    from_right = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 1, F.element_at(twice, c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.pmod(F.aggregate(from_right, F.lit(0), lambda a, x: a + x), F.lit(10))


def _name(k: Column, script: str, attempt: Column, syllables: int) -> Column:
    pool = F.array(*[F.lit(s) for s in SYLLABLES[script]])
    made = F.transform(F.sequence(F.lit(0), attempt + (syllables - 1)), lambda i: F.element_at(pool, (F.pmod(_number(k["seed"], i), F.lit(len(SYLLABLES[script]))) + 1).cast("int")))
    male, female = ENDINGS[script]
    ending = F.when(k["kind"].startswith("given-f"), female).when(k["kind"].startswith("given-m"), male).otherwise("" if script == "latin" else male)
    return F.concat(F.array_join(made, ""), ending)


def _iban(k: Column) -> Column:
    """Country and the validity of the check digits as they were."""
    value = k["value"]
    rest = F.upper(_each(F.substring(value, F.lit(5), F.length(value)), k["seed"]))
    valid = _mod97(F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))) == 1
    spoiled = F.when(valid, 0).otherwise(F.pmod(_number(k["seed"], 98), F.lit(95)) + 1)
    # 98 minus the remainder under check digits 00 makes the whole leave 1; anything else from 2 to 98 does not
    checked = lambda r: F.pmod(98 - _mod97(F.concat(r, F.substring(value, 1, 2), F.lit("00"))) - 2 + spoiled, F.lit(97)) + 2
    return let(rest, lambda r: F.concat(F.substring(value, 1, 2), F.lpad(checked(r).cast("string"), 2, "0"), r))


def _mod97(code: Column) -> Column:
    """Letters count from 10 for A; the number they spell, modulo 97."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.pmod(a * 10 + c.try_cast("int"), F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97)))
    return F.aggregate(F.split(code, ""), F.lit(0), step)


def _card(k: Column) -> Column:
    """First digit and Luhn validity as they were."""
    digits = F.concat(F.substring(k["value"], 1, 1), _each(F.substring(k["value"], F.lit(2), F.length(k["value"]) - 2), k["seed"]))
    off = F.when(_luhn(k["value"]) == 0, 0).otherwise(F.pmod(_number(k["seed"], 99), F.lit(9)) + 1)
    return let(digits, lambda d: F.concat(d, F.pmod(10 - _luhn(F.concat(d, F.lit("0"))) + off, F.lit(10)).cast("string")))


def _grown(text: Column, k: Column, attempt: Column) -> Column:
    """Like the text; longer from the eighth attempt on, as the space of a short one can be full."""
    return F.concat(_each(text, k["seed"]), F.when(attempt < 8, "").otherwise(_each(F.repeat(F.lit("a"), attempt - 7), F.reverse(k["seed"]))))


def core(key: Column, attempt: Column, secret: str, syllables: int = 3) -> Column:
    """Surrogate of a canonical value, in canonical form; an e-mail address keeps its host, whose surrogate is another
    key's. The secret is only hashed."""

    def of(k: Column) -> Column:
        kind, value, seed = k["kind"], k["value"], k["seed"]
        ip = F.concat_ws(".", *[(F.pmod(_number(seed, i), F.lit(254)) + 1).cast("string") for i in range(4)])
        country = F.regexp_extract(value, r"^\+\d+-", 0)
        phone = F.concat(country, _each(F.substring(value, F.length(country) + 1, F.length(value)), seed))
        email = F.concat(_grown(F.substring_index(value, "@", 1), k, attempt), F.lit("@"), F.substring_index(value, "@", -1))
        names = F.when(kind.endswith("cyrillic"), _name(k, "cyrillic", attempt, syllables)).when(kind.endswith("greek"), _name(k, "greek", attempt, syllables)).otherwise(_name(k, "latin", attempt, syllables))
        return (F.when(kind == "email", email).when(kind == "domain", _grown(value, k, attempt)).when(kind == "ip", ip).when(kind == "card", _card(k)).when(kind == "iban", _iban(k))
                .when(kind.isin("phone", "ssn"), phone).otherwise(names))

    seed = F.sha2(F.concat_ws(_SEP, F.lit(secret), key, attempt.cast("string")), 256)
    return let(F.struct(F.substring_index(key, _SEP, 1).alias("kind"), F.substring_index(key, _SEP, -1).alias("value"), seed.alias("seed")), of)


def _pour(mention: Column, new: Column) -> Column:
    """Letters and digits of new, in turn, for those of the mention; its punctuation and its case stay."""

    def fill(chars: Column) -> Column:
        def step(a: Column, c: Column) -> Column:
            n = F.get(chars, a["i"])
            put = F.when(~c.rlike(r"[\p{L}\p{N}]"), c).when(c.rlike(r"\p{Lu}"), F.upper(n)).otherwise(n)
            return F.struct(F.concat(a["out"], put).alias("out"), (a["i"] + c.rlike(r"[\p{L}\p{N}]").cast("int")).alias("i"))

        return F.aggregate(F.split(mention, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step, lambda a: a["out"])

    return let(F.split(new, ""), fill)


def _cased(old: Column, new: Column) -> Column:
    """new with old's case: all capitals, a first capital, or, of equal length, letter by letter."""
    letters = F.array_join(F.zip_with(F.split(old, ""), F.split(new, ""), lambda o, n: F.when(o.rlike(r"\p{Lu}"), F.upper(n)).otherwise(n)), "")
    return F.when((F.length(old) > 1) & (old == F.upper(old)), F.upper(new)).when(F.length(old) == F.length(new), letters).when(
        old.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)


def surrogate(e: Column, names: Column, secret: str, attempts: Column | None = None, syllables: int = 3) -> Column:
    """The replacement of a mention. names: the document's names (word, key); attempts maps the keys of exceptions to their
    attempt."""

    def new_of(key: Column) -> Column:
        return core(key, F.lit(0), secret, syllables) if attempts is None else let(F.coalesce(F.try_element_at(attempts, key), F.lit(0)), lambda n: core(key, n, secret, syllables))

    def name(w: Column) -> Column:
        def renamed(m: Column) -> Column:
            # a Slavic surname has its bearer's gender in its ending
            new = F.concat(new_of(m["key"]), F.when(m["key"].startswith("surname-cyrillic") & m["stem"].rlike("(?i)(ов|ев|ин)а$"), "а").otherwise(""))
            put = let(new, lambda n: F.when((F.length(m["stem"]) > 1) & (m["stem"] == F.upper(m["stem"])), F.upper(n)).otherwise(F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, F.lit(2), F.length(n)))))
            return F.when(m["key"].isNull(), w).otherwise(F.concat(put, F.regexp_extract(w, _TAIL, 0)))

        return let(F.struct(F.regexp_replace(w, _TAIL, "").alias("stem"), F.try_element_at(names, _plain(w)).alias("key")), renamed)

    def of(m: Column) -> Column:
        kind, new = m["kind"], m["new"]
        title = F.regexp_extract(e, f"^(?:{_TITLE})+", 0)
        person = F.concat(title, F.array_join(F.transform(F.split(F.substring(e, F.length(title) + 1, F.length(e)), " "), name), " "))
        local, host = F.substring_index(e, "@", 1), F.regexp_extract(e, _HOST, 1)
        email = F.concat(_cased(local, F.substring_index(new[0], "@", 1)), F.lit("@"), _cased(host, F.get(new, F.lit(1))), F.regexp_extract(e, _TOP, 0))
        return F.when(kind == "person", person).when(kind == "name", name(e)).when(kind == "ip", new[0]).when(kind == "email", email).otherwise(_pour(e, F.regexp_replace(new[0], r"\W", "")))

    return let(kind_of(e), lambda kind: let(F.struct(kind.alias("kind"), F.transform(keys_of(e, kind), new_of).alias("new")), of))


def _names(text: Column) -> Column:
    """The document's names; an empty map for most documents at little cost."""
    return F.when(text.rlike(PATTERNS["person"]), names_of(text)).otherwise(F.create_map().cast("map<string,string>"))


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key): the canonical values each document mentions."""
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(_HINT))
    others = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), lambda e: let(kind_of(e), lambda kind: keys_of(e, kind))))
    return found.select("id", F.explode(F.array_distinct(F.concat(others, F.map_values(_names(F.col("text")))))).alias("key"))


def syllables_for(n_names: int) -> int:
    """Syllables of a name, so that a hundred times as many names as there are could be made."""
    return max(3, math.ceil(math.log(max(1, 100 * n_names), len(SYLLABLES["latin"]))))


def exceptions(keys: DataFrame, secret: str, syllables: int = 3, patience: int = 30) -> DataFrame:
    """(key, attempt) of the values whose first surrogate would collide. keys: distinct (key), materialised."""
    kind = lambda k: F.substring_index(k, _SEP, 1)
    real = keys.select(F.col("key").alias("as_key"))
    now, fewest, waited = keys.withColumn("attempt", F.lit(0)), None, 0
    while True:
        made = checkpoint(now.withColumn("as_key", F.concat(kind(F.col("key")), F.lit(_SEP), core(F.col("key"), F.col("attempt"), secret, syllables))))
        shared = made.groupBy("as_key").agg(F.min_by("key", F.struct("attempt", "key")).alias("owner"), F.count("*").alias("n")).where("n > 1").select("as_key", "owner")
        # the host of an e-mail address is replaced by another host's surrogate, which is no real one
        hits = made.where(~F.col("key").startswith("email" + _SEP)).join(real, "as_key", "left_semi").select("as_key").distinct().withColumn("is_real", F.lit(True))
        shared, hits = checkpoint(shared), checkpoint(hits)
        if shared.isEmpty() and hits.isEmpty():
            return made.where("attempt > 0").select("key", "attempt")
        again = made.join(small_side(shared), "as_key", "left").join(small_side(hits), "as_key", "left")
        lost = F.coalesce("is_real", F.lit(False)) | (F.col("owner").isNotNull() & (F.col("owner") != F.col("key")))
        now = checkpoint(again.select("key", (F.col("attempt") + lost.cast("int")).alias("attempt"), lost.alias("lost")))
        n_lost = now.where("lost").count()
        now, waited = now.drop("lost"), 0 if fewest is None or n_lost < fewest else waited + 1
        fewest = n_lost if fewest is None else min(fewest, n_lost)
        if waited >= patience:
            raise RuntimeError(f"{fewest} values find no surrogate of their format that is free")


def replace(docs: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with surrogates in the text column."""
    found = checkpoint(mentions(docs, id_col, text_col))
    keys = checkpoint(found.select("key").distinct())
    syllables = syllables_for(keys.where(F.col("key").rlike("^(given|surname)-")).count())
    rare = checkpoint(exceptions(keys, secret, syllables))
    attempts = None
    if not rare.isEmpty():
        by_doc = checkpoint(found.join(small_side(rare), "key").groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("key", "attempt"))).alias("_attempts")))
        docs = docs.join(small_side(by_doc), docs[id_col].eqNullSafe(by_doc["id"]), "left").drop(by_doc["id"])
        attempts = F.coalesce("_attempts", F.create_map().cast("map<string,int>"))
    text = F.col(text_col)

    def rewritten(names: Column) -> Column:
        # where a title introduces a name, every capitalised word is looked up; the text after the last mention has none: its partner is null
        pattern = F.when(F.size(names) > 0, ANY_NAME).otherwise(ANY)
        gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
        return F.array_join(F.zip_with(gaps, found, lambda gap, e: F.concat(gap, F.when(e.isNull(), "").otherwise(surrogate(e, names, secret, attempts, syllables)))), "")

    out = docs.withColumn(text_col, F.when(text.rlike(_HINT), let(_names(text), rewritten)).otherwise(text))
    return out.drop("_attempts") if attempts is not None else out
