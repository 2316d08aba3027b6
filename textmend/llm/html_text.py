"""Main text of web pages by deducing each host's template from equivalence classes.

Tokens are tags with their path of containers, and text blocks with theirs. Tokens of a host that occur equally often on
each of its pages, that is, whose occurrence vectors are equal, form a class. A class that is large and frequent and is
built of tags can be part of the template. On each page the classes are put in order and nested: a class counts only if
its tokens stand there in the host's order, and if, from the widest class to the narrowest, it lies within one gap of
every wider one or has it within one of its own; classes that cross are dropped. Text that belongs to a nested class is
the template's own, and what is left in the gaps are the slots. Slots in containers of menus, headers, footers, sidebars,
notices, adverts, forms and comments are passed over. A page's article (or main) element is one slot, whatever its blocks
repeat; where there is none, all other slots make the main text.

A container's class or id names boilerplate only if all its parts do, or say nothing: ``site-nav`` is a menu,
``with-sidebar``, ``search-methods`` and ``related-work`` are not.

Occurrence vectors are never gathered: equal vectors have equal sums of a hash of (page, count), so classes come from one
aggregation with partial sums, however many pages a host has. Paths are numbers, so deep pages take no more memory than
flat ones.

Edge cases: null html counts as empty and has an empty text; broken markup (unclosed or cut tags, comments and elements)
never loses text that stands before the break, and a cut ``</`` at the end of a page is markup, not text; a host has a
template from ``MIN_PAGES`` pages of at least ``MIN_CONTENTS`` different contents on, before that only containers decide; a null url is a host like any other;
repeated rows yield repeated result rows.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmend.llm.common import checkpoint

#: A host's template: pages and different contents it takes, share of the pages, tokens of a class.
MIN_PAGES, MIN_CONTENTS, MIN_SHARE, MIN_CLASS = 8, 6, 0.6, 3
#: Bytes of templates up to which they are broadcast; beyond, pages and templates are joined by host.
BROADCAST_BYTES = 32 << 20
#: What elements are and what containers' names say.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td template tfoot th thead title tr ul".split())
VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SKIP = frozenset("head title script style noscript template iframe nav aside footer form button select textarea dialog menu svg math canvas audio video object applet datalist noembed noframes search".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promoted promotion banner nav navbar navigation navi menu menus menubar sidebar side aside footer foot header masthead topbar "
    "breadcrumb breadcrumbs crumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets pagination pager "
    "comment comments commentlist disqus replies reply respond toolbar search skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
FIRM = frozenset("comment comments commentlist disqus replies reply respond related recommended recommendations".split())

#: Parts of names that say nothing.
PLAIN = frozenset("site page main global primary secondary top bottom left right upper lower inner outer block box area section container wrapper wrap list item items row col column content body text bar link links title heading button icon logo group panel first last new post posts article articles story stories more news author count form input field id js is has no the".split())

_LEX = re.compile(r"""<!--(?:.*?--!?>|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)(?:>|(?=<)|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|</\Z""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', text, ''), ('open', name, attributes) and ('close', name, '') in order; raw elements' contents are skipped."""
    at, n = 0, len(page)
    while at < n:
        tag = _LEX.search(page, at)
        if tag is None:
            yield "text", page[at:], ""
            return
        if tag.start() > at:
            yield "text", page[at : tag.start()], ""
        at = tag.end()
        if tag[0] == "</":
            return
        name, attributes, closes = (tag[2] or tag[5] or "").lower(), tag[3] or tag[6] or "", tag[1] or tag[4]
        if not name:
            if tag[0].startswith("<![CDATA["):
                yield "text", entities.escape(tag[0][9:].removesuffix("]]>")), ""
            continue
        if closes:
            yield "close", name, ""
            continue
        yield "open", name, attributes
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            yield "close", name, ""
        elif attributes.endswith("/") and name not in BLOCKS and name not in VOID:
            yield "close", name, ""


def _container(name: str, attributes: str, in_article: bool) -> tuple[str, int]:
    """Label of an element for paths, and 0: content, 1: passed over if anything else holds text, 2: passed over unless an article
    lies inside, 3: passed over."""
    label, kind = name, 0
    if name in SKIP:
        kind = {"form": 1, "aside": 2, "noscript": 2}.get(name, 3)
    elif name == "header" and not in_article:
        kind = 2
    if attributes and name not in ("html", "body", "main"):
        said: list[str] = []
        for key, value in _ATTR.findall(attributes):
            key, value = key.lower(), value.strip("\"' ")
            if key in ("class", "id"):
                said += [value] if key == "id" else value.split()
                label += "." + value if key == "class" else ""
            elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                kind = max(kind, 2)
        words = [w for w in ({p.lower() for p in _PART.findall(x)} for x in said) if w & NAMES and w <= NAMES | PLAIN]
        if any(w & FIRM for w in words):
            kind = 3
        elif words and not (name == "article" or in_article and any({"article", "post", "entry", "content", "story"} & w for w in words)):
            kind = max(kind, 1 if all("content" in w for w in words) else 2)
    return label, kind


class Page:
    """Tokens and text blocks of a page in order."""

    def __init__(self, page: str):
        self.tokens: list[int] = []  # hashes of tags and texts with their paths; those of texts are odd
        self.blocks: list[tuple[int, str, int, bool]] = []  # token, text, how passed over, in an article
        stack: list[tuple[str, int, int, int]] = []  # name, hash of the path, passed over, in articles
        containers: list[int] = []  # places in the stack of the open blocks
        opened: Counter[str] = Counter()
        words: list[str] = []

        def flush() -> None:
            text = _SPACE.sub(" ", entities.unescape("".join(words))).strip()
            words.clear()
            if text:
                _, path, skip, articles = stack[containers[-1]] if containers else ("", 0, 0, 0)
                token = hashed(f"{path}\x1f{text}") | 1
                self.tokens.append(token)
                self.blocks.append((token, text, skip, articles > 0))

        def close_from(at: int) -> None:
            opened.subtract(s[0] for s in stack[at:])
            del stack[at:]
            while containers and containers[-1] >= at:
                containers.pop()

        for what, name, attributes in events(page):
            if what == "text":
                if not stack or stack[-1][2] < 3:
                    words.append(name)
                continue
            block = name in BLOCKS
            if what == "open":
                if name in VOID:
                    words.append(" ")
                    if name == "hr":
                        flush()
                    continue
                if block:
                    flush()
                    # a block ends an open paragraph and what is open in it
                    if opened["p"] and containers and stack[containers[-1]][0] == "p":
                        close_from(containers[-1])
                    if name in ("li", "dt", "dd", "tr", "td", "th", "option") and opened[name]:
                        same = next((k for k in reversed(containers) if stack[k][0] == name or stack[k][0] in ("ul", "ol", "dl", "table")), None)
                        if same is not None and stack[same][0] == name:
                            close_from(same)
                _, path, skip, articles = stack[-1] if stack else ("", 0, 0, 0)
                label, kind = _container(name, attributes, articles > 0)
                if name in ("article", "main") and kind < 3 and skip < 3:
                    skip, articles = kind, articles + 1
                else:
                    skip = max(skip, kind)
                if block:
                    path = hashed(f"{path}/{label}")
                    containers.append(len(stack))
                    self.tokens.append(hashed(f"<{path}") & ~1)
                stack.append((name, path, skip, articles))
                opened[name] += 1
                continue
            if block:
                flush()
            if not opened[name]:
                continue
            at = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
            if block or not containers or containers[-1] < at:
                if block:
                    self.tokens.append(hashed(f">{stack[at][1]}") & ~1)
                close_from(at)
        flush()

    def template(self, classes: list[list[int]]) -> set[int]:
        """Tokens of the classes that are valid here: in order, and nested."""
        first: dict[int, int] = {}
        for place, token in enumerate(self.tokens):
            first.setdefault(token, place)
        ordered = []
        for tokens in classes:
            places = [first[t] for t in tokens if t in first]
            if len(places) == len(tokens) and all(a < b for a, b in zip(places, places[1:])):
                ordered.append((places, tokens))
        ordered.sort(key=lambda c: (c[0][0] - c[0][-1], c[0]))
        kept: list[tuple[list[int], list[int]]] = []
        for places, tokens in ordered:
            if all(_within(places, wider) or _within(wider, places) for wider, _ in kept):
                kept.append((places, tokens))
        return {t for _, tokens in kept for t in tokens}

    def main_text(self, classes: list[list[int]]) -> str:
        """The blocks in slots. In a page's article every block is content, however many pages of the host have it, as they do
        with copies of articles; elsewhere the template's own text is not. A page whose only text is in a form or in a container
        that calls itself some boilerplate's content has that text."""
        article = any(in_article for _, _, skip, in_article in self.blocks if not skip)
        template = self.template(classes) if classes and not article else set()
        for most in (0, 1):
            out = [text for token, text, skip, in_article in self.blocks if skip <= most and (in_article or not article) and token not in template]
            if out:
                break
        return "\n\n".join(out)


def _within(inner: list[int], outer: list[int]) -> bool:
    """Does all of inner stand in one gap of outer, or beside it?"""
    return bisect(outer, inner[0]) == bisect(outer, inner[-1])


def hashed(token: str) -> int:
    x = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 7)
    return x - (1 << 64) if x >> 63 else x


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, html, host): host is the hash of the url's host name."""
    url = F.col(url_col).cast("string")
    host = F.xxhash64(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))))
    return pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, pages, vector, first, last, place): sums over a batch. vector adds up a hash of page and count; first and
    last are the least and greatest of the pages' contents, and contents has a bit for each 64th of them, to tell copies of one content
    from many; place is the token's on the page of the least content. The token 0 stands for the host itself."""
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    names = ["host", "token", "pages", "vector", "first", "last", "place", "contents"]
    for batch in batches:
        sums: dict[tuple[int, int], list[int]] = {}
        for k, (page, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            parsed = Page(page or "")
            content = hashed("\n".join(b[1] for b in parsed.blocks if not b[2]))
            mark = f"{batch.column(0)[k]}\x1f{content}\x1f"
            places: dict[int, int] = {}
            for place, token in enumerate(parsed.tokens):
                places.setdefault(token, place)
            for token, n in [*Counter(parsed.tokens).items(), (0, 1)]:
                key, value = (host, token), hashed(mark + str(n))
                s = sums.get(key)
                if s is None:
                    sums[key] = [1, value, content, content, places.get(token, 0), 1 << (content & 63)]
                else:
                    s[4] = places.get(token, 0) if content < s[2] else s[4]
                    s[5] |= 1 << (content & 63)
                    s[0], s[1], s[2], s[3] = s[0] + 1, wrap(s[1] + value), min(s[2], content), max(s[3], content)
        columns = list(zip(*((*k, *v[:5], signed(v[5])) for k, v in sums.items()), strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_class: int = MIN_CLASS, min_contents: int = MIN_CONTENTS) -> DataFrame:
    """(host, classes): the classes of a host that hold text, each in the order in which its tokens stand. Together they have at
    most 1 / min_share times the tokens of a page of the host."""
    rows = _rows(pages, id_col, url_col, html_col)
    seen = rows.mapInArrow(_occurrences, "host bigint, token bigint, pages bigint, vector bigint, first bigint, last bigint, place bigint, contents bigint")
    # sums of hashes wrap on purpose: the two halves are added apart and put together again
    halves = seen.withColumns({"low": F.col("vector").bitwiseAND(F.lit(0xFFFFFFFF)), "high": F.shiftright("vector", 32)})
    tokens = halves.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last"), F.bit_or("contents").alias("contents"), F.min_by("place", "first").alias("place"))
    frequent = checkpoint(tokens.where(F.col("pages") >= min_pages))
    hosts = frequent.where("token = 0").select("host", F.col("pages").alias("host_pages"))
    common = frequent.where("token <> 0").join(hosts, "host").where(F.col("pages") >= min_share * F.col("host_pages"))
    vector = [F.pmod("low", F.lit(1 << 32)).alias("l"), F.pmod(F.col("high") + F.shiftright("low", 32), F.lit(1 << 32)).alias("h")]
    is_text = F.pmod("token", F.lit(2)) == 1
    classes = common.groupBy("host", "pages", *vector).agg(
        F.count_if(is_text & (F.bit_count("contents") >= min_contents)).alias("texts"), F.count_if(~is_text).alias("tags"), F.count("*").alias("size"), F.sort_array(F.collect_list(F.struct("place", "token"))).alias("tokens"))
    valid = classes.where((F.col("size") >= min_class) & (F.col("tags") >= 2) & (F.col("texts") > 0))
    return valid.groupBy("host").agg(F.collect_list(F.transform("tokens", lambda t: t["token"])).alias("classes"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row."""
    found = checkpoint(templates(pages, id_col, url_col, html_col))
    size = found.agg(F.sum(F.aggregate("classes", F.lit(32), lambda n, c: n + 8 * F.size(c) + 16))).first()[0]
    rows = _rows(pages, id_col, url_col, html_col)
    if size is None:
        joined = rows.withColumn("classes", F.lit(None).cast("array<array<bigint>>"))
    else:
        joined = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")
    joined = joined.select("page_id", "url", "html", "classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(page or "").main_text(classes or []) for page, classes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars bigint")
