from __future__ import annotations

import pytest

from lexloom.llm import html as h


def main_text(page: str) -> str:
    return "\n".join(t for _, t in h._candidates(h.blocks_of(page))[1])


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("<p>a &amp; b&nbsp;&lt;c&gt; &eacute; &#233;</p>", "a & b <c> é é"),
        ("<html><head><title>T &am</title><style>p{}</style></head><body><nav>menu</nav><article><h1>H</h1><p>a<br>b<p>c  \n d</article><footer>f</footer>", "H\na b\nc d"),
        ("<body><div class='ad'>x</div><main><p>a</p><aside>s</aside><form>f</form><div id=comments><p>c</p></div><p>b</p></main>", "a\nb"),
        ("<article><p>a</p><script>var t='</p>';</script><!-- <p>no</p> --><p>b</p></article>", "a\nb"),
        ("<article><p>cut off in a ta<b", "cut off in a ta"),
        ("<article><p title='x > y'>a</p><p hidden>n</p><p style='display: none'>n</p><p aria-hidden=true>n</p></article>", "a"),
        ("<nav><ul><li>x<article><p>a</p></article>", "a"),
        ("<article><p>a</p><article class=comment><p>reader</p></article></article>", "a"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table></article>", "one\ntwo\n1 2\n3"),
        ("<article><div class='share-buttons'>s</div><span class='advert'>x</span>t<b>bo</b>ld</article>", "s\ntbold"),
        ("<article><p class='notice'>a</p><div class='form-group'>b</div><section class='search-results'>c</section><p class='promotion'>d</p></article>", "a\nb\nc\nd"),
        ("<article><p>a</p><div class='user-feedback'>u</div><ul class='commentList'><li>c</ul><div data-id='comments'>b</div></article>", "a\nb"),
        ("<main><p>crumbs</p><article><p>the article itself</p></article><div class='sidebar'>s</div><p>next</p></main>", "the article itself"),
        ("<main><h1>H</h1><p>the text of the page</p><div class='related'><article><p>teaser</p></article></div></main>", "H\nthe text of the page"),
        ("<main><header><h1>H</h1></header><p>the text of the page</p><div class='page-header'>d</div></main>", "H\nthe text of the page\nd"),
        ("<main><h1>H</h1><p>the text of the page</p><article class='comment'><p>reader</p></article></main>", "H\nthe text of the page"),
        ("<article><p>a</p></article><section class='comments'><article class='comment'><p>reader</p></article></section>", "a"),
        ("<body class='no-sidebar'><header><h1>site</h1></header><p>a</p></body>", "a"),
        ("a < b and <p>c</p>", "a < b and\nc"),
        ("<article><header><h1>H</h1></header><p>a</p></article>", "H\na"),
        ('<article><p class="x>a</p><p>b</p></article>', "a\nb"),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


PROSE = " ".join(f"Sentence {i} of the text says what word{i} means here." for i in range(12))

#: Pages without an article element, each with the text that it is about.
UNMARKED = [
    (f'<body><div class="layout-sidebar-right"><h1>Head</h1><p>{PROSE}</p></div></body>', f"Head\n{PROSE}"),
    (f'<body><div id="content-with-menu"><p>{PROSE}</p><ul class="menu"><li>one</li></ul></div></body>', PROSE),
    (f'<div class="page-wrapper has-sidebar"><div class="sidebar"><p>links</p></div><p>{PROSE}</p></div>', PROSE),
    (f'<div class="widget-area-off site"><div class="post"><p>{PROSE}</p></div></div>', PROSE),
    (f'<p>{PROSE}</p><pre><code><span class="hljs-comment"># set x</span>\nx = 1</code></pre>', f"{PROSE}\n# set x x = 1"),
    (f'<p>{PROSE}</p><div class="highlight"><pre><span class="token comment">// y</span> y();</pre></div>', f"{PROSE}\n// y y();"),
    (f'<p>{PROSE}</p><p>Call <code class="comment">f</code> once.</p>', f"{PROSE}\nCall f once."),
    (f'<p class="ad-hoc">An ad-hoc query.</p><p>{PROSE}</p>', f"An ad-hoc query.\n{PROSE}"),
    (f'<p id="ad-1">Article one, 1 AD.</p><p>{PROSE}</p>', f"Article one, 1 AD.\n{PROSE}"),
    (f'<div class="ad">buy</div><div class="ad-slot">buy</div><div class="top-ad">buy</div><div class="google-ads">buy</div><div class="sponsored-post">buy</div><p>{PROSE}</p>', PROSE),
    (f"<p>{PROSE}</p><p>So <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds.</p>", f"{PROSE}\nSo a=b holds."),
    (f'<p>{PROSE}</p><p>So <math><semantics><mi>a</mi><annotation encoding="application/x-tex">\\a</annotation></semantics></math> holds.</p>', f"{PROSE}\nSo a holds."),
    (f'<p>{PROSE}</p><div class="post-reactions"><p>reader one</p></div>', PROSE),
    (f'<p>{PROSE}</p><section class="discussion"><p>reader one</p><p>reader two</p></section>', PROSE),
    (f'<p>{PROSE}</p><ol class="comment-list"><li>reader</li></ol><div id="disqus_thread">load</div>', PROSE),
    (f'<p>{PROSE}</p><div class="user-reviews"><p>five stars</p></div>', PROSE),
    (f'<div class="cookie-consent">We use cookies. Accept.</div><p>{PROSE}</p>', PROSE),
    (f'<div class="newsletter-signup"><p>Join us!</p></div><p>{PROSE}</p>', PROSE),
    (f'<div class="breadcrumbs"><a href="/">Home</a> / <a href="/x">X</a></div><p>{PROSE}</p>', PROSE),
    (f'<p>{PROSE}</p><div class="related-posts"><a href="/1">Other one.</a> <a href="/2">Other two.</a></div>', PROSE),
    (f'<p>{PROSE}</p><div class="pagination"><a>1</a><a>2</a></div>', PROSE),
    (f'<p>{PROSE}</p><div class="social share"><a>Post</a></div>', PROSE),
    (f'<p>{PROSE}</p><div class="notice"><p>{PROSE.replace("word", "term")}</p></div>', f"{PROSE}\n{PROSE.replace('word', 'term')}"),
    (f'<p>{PROSE}</p><p>The <span class="menu">File</span> menu and the <b class="search">Find</b> box.</p>', f"{PROSE}\nThe File menu and the Find box."),
    (f'<header><p>Site</p></header><nav><a>x</a></nav><div><p>{PROSE}</p></div><footer><p>(c)</p></footer>', PROSE),
    (f'<div role="banner"><p>Site</p></div><div role="main"><p>{PROSE}</p></div><div role="contentinfo">(c)</div>', PROSE),
    (f"<main><p>{PROSE}</p><div class='sidebar'><a>x</a> <a>y</a></div></main>", PROSE),
    (f"<main><div class='search-results-page'><p>{PROSE}</p></div></main>", PROSE),
    (f"<table><tr><td><div class='menu'><a>a</a></div></td><td><p>{PROSE}</p></td></tr></table>", PROSE),
    (f"<dialog open>Sale</dialog><aside>aside</aside><form><p>field</p></form><noscript>on</noscript><p>{PROSE}</p>", PROSE),
    (f"<div class='modal-open'><div class='overlay'>Wait</div><p>{PROSE}</p></div>", PROSE),
    (f"<p>{PROSE}</p><p hidden>no</p><div style='display:none'>no</div><template><p>no</p></template>", PROSE),
]


@pytest.mark.parametrize("page,want", UNMARKED)
def test_pages_without_an_article_element(page, want):
    assert main_text(page) == want


def test_they_come_through_the_operator(spark):
    rows = [(i, f"http://host{i}.example/", page) for i, (page, _) in enumerate(UNMARKED)]
    got = {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(UNMARKED)}


def test_parts_of_articles_that_are_named_like_boilerplate_stay():
    page = f"<div class='layout-sidebar-right'><article><p>{PROSE}</p><section class='discussion' id='discussion'><p>We discuss.</p></section><p>f<code class='comment'>x</code></p></article><div class='post-reactions'>r</div></div>"
    assert main_text(page) == f"{PROSE}\nWe discuss.\nfx"


def test_repeated_ids_and_clashing_columns_together(spark):
    from pyspark.sql import functions as F

    rows = [(1, "u", f"<p>{PROSE}</p>"), (1, "u", f"<p>{PROSE}</p>"), (1, "u", None), (None, None, "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("HTML"), F.lit(2).alias("row"), F.lit(3).alias("Page_Id"), F.lit("t").alias("text"))
    assert sorted((r["page_id"] or 0, r["text"]) for r in h.extract(pages).collect()) == [(0, "x"), (1, ""), (1, PROSE), (1, PROSE)]


def test_long_and_hostile_pages_end():
    for page in ("<div class=menu>" * 30_000 + "x", "<" * 200_000, "<a " * 100_000, '<p class="' * 50_000, "<div>" * 20_000 + "x", "<!--" * 50_000, "&" * 100_000, "<p>" + "w " * 300_000):
        h.blocks_of(page)


def test_repeated_runs_go_where_nothing_marks_an_article(spark):
    menu = " ".join(f"menu{i}" for i in range(12))
    rows = [(i, f"http://a.example/{i}", f"<div>{menu}</div><div>{' '.join(f'own{i}w{j}' for j in range(15))}</div><div>short {i}</div>") for i in range(5)]
    copies = [(10 + i, "http://b.example/", f"<p>{' '.join(f'copy{j}' for j in range(15))}</p>") for i in range(3)]
    other = [(20, "http://c.example/", f"<div>{menu}</div><div>else</div>"), (21, None, "<p>x</p>"), (22, "http://c.example/", None), (None, None, "")]
    pages = spark.createDataFrame(rows + copies + other, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r for r in h.extract(pages).collect()}
    for i in range(5):
        assert got[i]["text"] == f"{' '.join(f'own{i}w{j}' for j in range(15))}\nshort {i}" and got[i]["n_repeated"] == 12
    # Copies are one page, and another host's menu is seen only once there.
    assert all(got[10 + i]["text"].startswith("copy0") for i in range(3))
    assert got[20]["text"] == f"{menu}\nelse" and got[21]["text"] == "x" and got[22]["text"] == "" and got[None]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_doubtful_blocks_of_articles_go_where_they_repeat(spark):
    notice = " ".join(f"notice{i}" for i in range(14))
    rows = [(i, f"http://a.example/{i}", f"<article><p>text {i}</p><p class=notice>{notice if i < 3 else f'important words of page {i} alone'}</p><p>{notice}</p></article>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r["page_id"]: r for r in h.extract(pages).collect()}
    for i in range(5):
        kept = [f"text {i}", *([f"important words of page {i} alone"] if i >= 3 else []), notice]
        assert got[i]["text"] == "\n".join(kept) and got[i]["n_repeated"] == (14 if i < 3 else 0)


def streams(rows, least):
    """Per row: how many tokens of its stream are in windows that another page (by all that it shows) of its host has too."""
    pages = []
    for k, url, page in rows:
        found = h.blocks_of(page or "")
        tokens = [w.lower() for t in h._candidates(found)[0] for w in t.split()]
        windows = [(h.host_of(url), tuple(tokens[i : i + least])) for i in range(max(1, len(tokens) - least + 1))] if tokens else []
        pages.append((str(found), tokens, windows))
    seen = {}
    for sign, _, windows in pages:
        for w in windows:
            seen.setdefault(w, set()).add(sign)
    out = []
    for _, tokens, windows in pages:
        covered = {k for i, w in enumerate(windows) if len(seen[w]) > 1 for k in range(i, min(i + least, len(tokens)))}
        out.append(len(covered))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_repeated_runs_like_brute_force(spark, parts):
    import random

    r = random.Random(9)
    runs = [" ".join(r.choice("abcdefgh") + str(r.randrange(3)) for _ in range(r.randint(3, 40))) for _ in range(12)]
    rows = []
    for i in range(120):
        page = "".join(f"<{t}>{r.choice(runs) if r.random() < 0.6 else ' '.join(r.choice('xyz') + str(r.randrange(50)) for _ in range(r.randint(1, 20)))}</{t}>" for t in r.choices(["nav", "div", "p", "footer"], k=r.randint(0, 5)))
        rows.append((i % 100, r.choice(["http://a.example/x", "http://B.example", None]), page))
    rows += [r.choice(rows) for _ in range(10)] + [(1, None, None), (1, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    got = sorted((r["page_id"], r["url"] or "", r["n_repeated"]) for r in h.extract(pages).collect())
    want = streams(rows, h.LEAST_RUN)
    assert got == sorted((k, u or "", n) for (k, u, _), n in zip(rows, want)) and 0 < sum(map(bool, want)) < len(want)


def test_block_at_the_covered_share_goes(spark):
    run = " ".join(f"r{i}" for i in range(12))
    rows = [(i, "http://a.example/", f"<div>{run} own{i}a own{i}b own{i}c</div>") for i in range(2)] + [(9, "http://a.example/", f"<div>{run} x y z w</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in h.extract(pages, covered=0.8).collect()}
    assert got[0] == got[1] == "" and got[9].endswith("x y z w")
    assert spark.createDataFrame([], pages.schema).count() == h.extract(pages.filter("false")).count() == 0


def test_suffix_array_orders_like_tokens():
    import random

    import numpy as np

    r = random.Random(4)
    sizes = [r.randint(1, 30) for _ in range(20)]
    pages = [[r.randint(0, 3) for _ in range(n)] for n in sizes]
    tokens = np.array([t for p in pages for t in p], np.uint64)
    left = np.concatenate([np.arange(n, 0, -1) for n in sizes])
    order, rank = h.suffix_array(tokens, left, 10)
    flat = [tuple(p[i : i + 10]) for p in pages for i in range(len(p))]
    assert [flat[i] for i in order] == sorted(flat)
    assert all((rank[a] == rank[b]) == (flat[a] == flat[b]) for a in range(0, len(flat), 7) for b in range(len(flat)))


def test_columns_and_empty_table(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "u", "<p>a</p>")], "page_id long, url string, html string").select("*", F.lit(1).alias("HTML"), F.lit(2).alias("host"))
    assert h.extract(pages).first()["text"] == "a"
    assert h.extract(pages.filter("false")).count() == 0


def test_self_closed_foreign_elements_are_empty():
    for icon in ("<svg/>", '<svg class="icon" />', "<math/>"):
        page = f"<article><p>before {icon} after</p><p>more <svg><path/></svg> text</p></article>"
        assert [t for _, t in h.blocks_of(page)] == ["before after", "more text"], icon
