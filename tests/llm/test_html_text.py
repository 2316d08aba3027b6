import html
import re
from collections import Counter

from textmend.llm import html_text as ht


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, tokens string, host string")
    return {r.page_id: (r.text, r.n_chars) for r in ht.extract(df).collect()}


def test_article_without_its_surroundings(spark):
    page = """<!doctype html><html><head><title>T &amp; t</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- x > y --><div id="content"><article>
    <h1>Head&shy;line</h1><p>One <b>bold</b>&nbsp;word<br>next   line &lt;tag&gt; &#233;<p>Two<ul><li>a<li>b</ul><form>Name <input></form><div class="ad">Buy</div>
    <aside>Related</aside><blockquote>Quote</blockquote></article></div><section id="comments"><article class="comment"><p>First!</p></article></section>
    <div class="sidebar"><p>side</p></div><footer>(c) all</footer></body></html>"""
    assert extracted(spark, [(1, "http://a.example/x", page, "", "")])[1][0] == "Head\xadline\n\nOne bold word next line <tag> é\n\nTwo\n\na\n\nb\n\nQuote"


def test_odd_pages(spark):
    rows = [(1, None, None, "", ""), (2, "::bad url", "", "", ""), (3, "http://x.example", "plain < text & more", "", ""), (4, "http://x.example", "<article><p>cut <b>off</", "", ""), (5, "http://x.example", "<p>a<script>never closed", "", ""),
            (6, "http://x.example", "<div>" * 3000 + "deep", "", ""), (6, "http://x.example", "<a title='x>y'>l</a> <img alt=\"<p>\"> r", "", ""), (7, "http://x.example", "<p>" + "long text " * 50_000, "", "")]
    got = extracted(spark, rows)
    assert got[1] == got[2] == ("", 0)
    assert [got[k][0] for k in (3, 4, 5)] == ["plain < text & more", "cut off", "a"]
    assert got[6][0] in ("deep", "l r") and got[7][1] == 499_999


def test_template_text_of_a_host_goes(spark):
    rows = [(i, f"http://www.host.example/{i}?q=1", f"<html><body><div class=x><span>Welcome to our pages</span></div><div class=y><p>Own text number {i} and words {i * 7}</p></div><div class=z>Made by host</div></body></html>", "", "") for i in range(12)]
    rows += [(100 + i, "http://few.example/", "<body><div>Same</div><p>text</p></body>", "", "") for i in range(3)]
    got = extracted(spark, rows)
    assert all(got[i][0] == f"Own text number {i} and words {i * 7}" for i in range(12))
    assert got[100][0] == "Same\n\ntext"


def test_every_block_of_an_article_stays(spark):
    """Hosts of few and many pages, with copies of an article, near copies, and blocks that all articles have."""
    rows, want = [], {}
    for host, n in (("two", 2), ("three", 3), ("fifty", 50)):
        for i in range(n):
            blocks = ["Title", "Short para one.", "Short para two.", f"own {i % 25}", "alpha", "beta", "x" * 79, "y" * 80]
            if i % 10 == 3:
                blocks[2] = f"changed {i}"
            page = f"<nav>Menu</nav><div>Welcome</div><article><h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:4]) + f"<ul><li>{blocks[4]}</li><li>{blocks[5]}</li></ul><div>{blocks[6]}</div><p>{blocks[7]}</article><div>Goodbye</div>"
            rows.append((len(rows), f"http://{host}.example/{i}", page, "", ""))
            want[len(rows) - 1] = "\n\n".join(blocks)
    for i in range(2):
        rows.append((len(rows), "http://bare.example", f"<div><p>Intro.</p><p>same short</p><p>Own {i}</p></div>", "", ""))
        want[len(rows) - 1] = f"Intro.\n\nsame short\n\nOwn {i}"
    got = extracted(spark, rows)
    assert {k: got[k][0] for k in want} == want


def test_only_what_is_passed_over_holds_text(spark):
    pages = ['<div class="menu-content"><p>Text</p></div>', '<div class="header-content">Text</div>', '<form><h1>Text</h1></form>', '<section class="social-content-section">Text</section>', '<article><p class="byline">Text</p></article>']
    mixed = '<form>Search</form><div class="footer-content">No</div><p>Text</p>'
    got = extracted(spark, [(i, f"http://h{i}.example", x, "", "") for i, x in enumerate([*pages, mixed])])
    assert [got[i][0] for i in range(len(got))] == ["Text"] * 6


def test_classes_equal_brute_force(spark):
    """Vectors written out page by page, for one host."""
    pages = [f"<body><div>Menu text</div><p>p{i}</p>" + "<p>twice</p>" * (1 + i % 2) + ("<h2>often</h2>" if i % 3 else "") + "<div>End</div></body>" for i in range(9)]
    parsed = [ht.Page(p) for p in pages]
    vectors = {}
    for k, p in enumerate(parsed):
        for token, n in Counter(p.tokens).items():
            vectors.setdefault(token, [0] * 9)[k] = n
    classes = {}
    for token, v in vectors.items():
        if sum(x > 0 for x in v) >= max(ht.MIN_PAGES, ht.MIN_SHARE * 9):
            classes.setdefault(tuple(v), []).append(token)
    want = set()
    for tokens in classes.values():
        texts = [t for t in tokens if t % 2]
        if len(tokens) >= ht.MIN_CLASS and texts and len(tokens) - len(texts) >= 2:
            page = min((p for p in parsed if tokens[0] in p.tokens), key=lambda p: ht.hashed("\n".join(b[1] for b in p.blocks)))
            want.add(tuple(sorted(tokens, key=page.tokens.index)))
    df = spark.createDataFrame([(i, "http://h.example", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(5)
    got = ht.templates(df).collect()
    assert len(got) == 1 and {tuple(c) for c in got[0].classes} == want and want


def test_names_of_containers(spark):
    keep = ['<div class="page with-sidebar"><p>Text</p></div>', '<div id="side-by-side">Text</div>', '<article><section class="search-methods">Text</section></article>', '<article><div class="related-work"><p>Text</p></div></article>', '<div class="menu-planning">Text</div>']
    drop = ['<div class="site-nav">x</div>', '<div id="leftSidebar">x</div>', '<div class="post-comments">x</div>', '<div class="related-posts">x</div>', '<div class="cookie-notice box">x</div>', '<div id="comment-42">x</div>']
    got = extracted(spark, [(i, f"http://h{i}.example", x, "", "") for i, x in enumerate(keep + drop)])
    assert [got[i][0] for i in range(len(got))] == ["Text"] * len(keep) + [""] * len(drop)


def test_classes_are_put_in_order_and_nested():
    page = ht.Page("<body><div>One</div><div>Two</div><h2>A</h2><p>own</p><h2>B</h2><div>Three</div></body>")
    a, b, c, x, y = (next(t for t, text, *_ in page.blocks if text == w) for w in ("One", "Two", "Three", "A", "B"))
    assert page.template([[a, b, c], [x, y]]) == {a, b, c, x, y}  # the second within a gap of the first
    assert page.template([[c, a]]) == set()  # not the host's order
    assert page.template([[a, b, c], [b, x]]) in ({a, b, c}, {a, b, c, x})
    assert page.template([[a, x, c], [b, y]]) == {a, x, c}  # crossing: the narrower one is dropped


def test_deep_pages_in_bounded_memory():
    import tracemalloc

    tracemalloc.start()
    page = ht.Page("<div class=a>" * 200_000 + "deep" + "</b>" * 1000 + "</div>" * 200_000 + "<p>after")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [b[1] for b in page.blocks] == ["deep", "after"] and peak < 200 << 20


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in ht.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", x))).strip() for x in re.split("</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_empty_table(spark):
    assert extracted(spark, []) == {}
