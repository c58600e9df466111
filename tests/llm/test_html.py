import pytest

from burnline.llm import html_wrapper
from burnline.llm.dom import Dom

from .helpers import as_rows, words

SCHEMA = "page_id long, url string, html string"


def page(body, i=0, foot="Foot of the site"):
    nav = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in words(4, i))
    return (f"<html><head><title>T {i}</title><script>var t='</p>';</script></head><body><nav><ul>{nav}</ul></nav><!-- x -->"
            f"<div class='ad'>Buy {i}</div>{body}<footer>{foot}</footer></body></html>")


def texts(spark, rows, **kw):
    return {r["page_id"]: r["text"] for r in html_wrapper.extract(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


def test_article_in_broken_markup(spark):
    html = page("<article><h1>A &amp; B</h1><p><b>One\n  two.<br><p>Three&nbsp;<i>fo</i>ur &lt;x&gt; &copy;</p>loose<p></p>end</article>")
    assert texts(spark, [(1, "http://a.b/c", html)]) == {1: "A & B\nOne two.\nThree four <x> ©\nloose\nend"}


@pytest.mark.parametrize("part", ["<aside>no</aside>", "<form><p>no</p></form>", "<div id='comments'><article><p>no</p></article></div>",
                                  "<div role='alert'>no</div>", "<section class='cookie-notice'><p>no</p></section>", "<style>no</style>",
                                  "<header><h2>no</h2></header>", "<select><option>no</select>", "<noscript>no</noscript>",
                                  "<div class='sidebar'>no</div>", "<!-- no -->", "<button>no</button>"])
def test_other_parts_are_left_out(spark, part):
    rows = [(1, "http://a.b/c", page(part + "<article><p>Yes</p></article>" + part)),
            (2, "http://a.c/c", page(part + "<div id='x'><p>Yes</p><p>and more of it</p></div>" + part))]
    assert texts(spark, rows) == {1: "Yes", 2: "Yes\nand more of it"}


@pytest.mark.parametrize("html", ["<body class='no-sidebar comments-open'><article><p>Yes</p></article>",
                                  "<main class='has-sidebar'><p>Yes</p></main>", "<article class='post share-enabled'><p>Yes</p></article>",
                                  "<div class='content-ads'><article><p>Yes</p></article></div>", "<html class='header'><div><p>Yes</p></div>",
                                  "<body class='sidebar'><p>Yes</p><div class='ad'>Buy</div>", "<div class='content-ads'><p>Yes</p></div>",
                                  "<div class='promo'><p>Yes</p></div>", "<div class='page no-sidebar'><p>Yes</p></div><div class='share-box'>a</div>"])
def test_names_of_whole_pages_and_articles_drop_nothing(spark, html):
    assert texts(spark, [(1, "http://a.b/c", html)]) == {1: "Yes"}


def test_title_and_lead_beside_a_long_block_stay(spark):
    def body(i):
        long = "".join(f"<p>{' '.join(words(40, 10 * i + k))}</p>" for k in range(4))
        return f"<div><h1>Title {i}</h1><p>Lead {i}</p><div class='body'><p>By {i}</p><div>{long}</div></div></div>"

    got = texts(spark, [(i, f"http://h.x/{i}", page(body(i), i)) for i in range(8)] + [(9, "http://alone.x/", page(body(9), 9))])
    assert got == {i: "\n".join([f"Title {i}", f"Lead {i}", f"By {i}", *(" ".join(words(40, 10 * i + k)) for k in range(4))])
                   for i in [*range(8), 9]}


def test_constant_nodes_of_a_host_are_template(spark):
    rows = [(i, f"https://Site.example/{i}", page(f"<div><div><p>Share this page with friends</p><p>{' '.join(words(30, i))}</p>"
                                                  f"<p>{' '.join(words(20, 50 + i))}</p></div></div>", i)) for i in range(12)]
    got = texts(spark, rows)
    assert got == {i: " ".join(words(30, i)) + "\n" + " ".join(words(20, 50 + i)) for i in range(12)}
    alone = texts(spark, rows[:3])  # too few pages for a template
    assert all("Share this page" in t for t in alone.values())


def test_copies_of_a_page_are_no_template(spark):
    body = "<article><h1>Head</h1><p>The same text on many pages.</p></article>"
    rows = [(i, "http://h.x/1", page(body, i)) for i in range(30)] + [(100 + i, "http://h.x/2", page(f"<article><p>{' '.join(words(9, i))}</p></article>", i)) for i in range(4)]
    got = texts(spark, rows)
    assert all(got[i] == "Head\nThe same text on many pages." for i in range(30))
    assert got[101] == " ".join(words(9, 1))


def brute_weight(a, b, x=0, y=0):
    """Simple tree matching by the plain recursion."""
    if a.tag[x] != b.tag[y]:
        return 0
    xs, ys = a.children[x], b.children[y]
    m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i in range(1, len(xs) + 1):
        for j in range(1, len(ys) + 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + brute_weight(a, b, xs[i - 1], ys[j - 1]))
    return 1 + m[-1][-1]


def test_tree_matching_is_as_large_as_plain_recursion():
    import random
    rng = random.Random(4)

    def markup(depth=0):
        return "".join(f"<{t}>{'w' if rng.random() < 0.5 else ''}{markup(depth + 1) if depth < 3 else ''}</{t}>"
                       for t in rng.choices(["div", "b", "section", "i"], k=rng.randint(0, 4)))

    for _ in range(150):
        a, b = (html_wrapper.Tree.of(Dom(markup()))[0] for _ in range(2))
        pairs = html_wrapper.Matching(a, b).pairs
        assert len(pairs) == brute_weight(a, b)
        assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)
        assert all(a.tag[x] == b.tag[y] and ((x, y) == (0, 0) or (a.parent[x], b.parent[y]) in set(pairs)) for x, y in pairs)


def test_edge_cases(spark):
    rows = [(1, None, None), (2, None, ""), (3, "", "plain text"), (None, "x", "<p>a<p>b"), (4, "http://q", "<div>" * 5000 + "deep"),
            (5, "http://q", "<article>" + "<p>x y</p>" * 20_000), (6, "http://q", "<article><p>Same</p></article>"),
            (6, "http://q", "<article><p>Same</p></article>"), (7, "http://q", "<script>x"), (8, "http://q", "<![CDATA[z]]><p>ok</p><?pi?>")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as host", "2 as text", "3 as reference")
    got = as_rows(html_wrapper.extract(frame))
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0)) == [
        (1, None, ""), (2, None, ""), (3, "", "plain text"), (4, "http://q", "deep"), (5, "http://q", "\n".join(["x y"] * 20_000)),
        (6, "http://q", "Same"), (6, "http://q", "Same"), (7, "http://q", ""), (8, "http://q", "ok"), (None, "x", "a\nb")]
    assert html_wrapper.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_the_article_element(spark):
    import html
    import re

    from burnline.llm import queries

    from .helpers import SMALL
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in queries.op9_html(spark, SMALL).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        parts = [re.sub(r"</?b>", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:h1|p)>", inner)]
        expected = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert (r["text"], r["n_chars"]) == (expected, len(expected))


def test_deep_pages_lose_no_text():
    for depth in (100, 200, 5_000):
        html = f"<body><article><p>Start</p>{'<div>' * depth}deep{'</div>' * depth}<p>After it</p></article><footer>f</footer></body>"
        dom = Dom(html)
        assert html_wrapper.article(dom, set()) == ["Start", "deep", "After it"]
        tree, nodes = html_wrapper.Tree.of(dom)
        assert len(html_wrapper.Matching(tree, tree).pairs) == len(nodes)
    menu = f"<body><article>{'<div>' * 300}<nav>menu</nav>text{'</div>' * 300}</article></body>"
    assert html_wrapper.article(Dom(menu), set()) == ["text"]


def test_deep_pages_match_without_deep_recursion():
    pages = [f"<body>{'<div><b>x</b>' * 400}{'<p>more</p>' * n}{'</div>' * 400}</body>" for n in (1, 3)]
    (a, _), (b, _) = (html_wrapper.Tree.of(Dom(p)) for p in pages)
    assert len(html_wrapper.Matching(a, b).pairs) > 800


def test_title_of_main_stands_above_its_article():
    page = "<body><header><h1>Site</h1></header><main><h1>Title</h1><article><p>Text</p></article><h2>More</h2></main><h1>Outside</h1></body>"
    assert html_wrapper.article(Dom(page), set()) == ["Title", "Text"]


def test_every_layout_of_a_host_has_its_template(spark):
    def first(i):
        return page(f"<main><p>Read on paper too</p><p>{' '.join(words(30, i))}</p></main>", i)

    def second(i):
        return page(f"<div><section><p>Members write here</p><p>{' '.join(words(25, 500 + i))}</p></section></div>", i)

    rows = [(i, f"http://two.x/{i}", first(i) if i < 40 else second(i)) for i in range(70)]
    rows += [(100 + i, f"http://two.x/{100 + i}", page(f"<table><tr><td><p>{' '.join(words(9, 900 + i))}</p></td></tr></table>", i)) for i in range(3)]
    want = {i: " ".join(words(30, i)) for i in range(40)} | {i: " ".join(words(25, 500 + i)) for i in range(40, 70)}
    assert texts(spark, rows) == want | {100 + i: " ".join(words(9, 900 + i)) for i in range(3)}


@pytest.mark.parametrize("part, stays", [("<div id='share-prices'>Yes</div>", True), ("<p class='comment'>Yes</p>", True),
                                         ("<h2 id='related'>Yes</h2>", True), ("<li class='notice'>Yes</li>", True),
                                         ("<div class='share-buttons'>no</div>", False), ("<p class='ad'>no</p>", False),
                                         ("<div class='related-posts'><p>no</p></div>", False), ("<div class='comments'>no</div>", False),
                                         ("<div class='ad-slot-3'>no</div>", False), ("<p class='sponsored'>no</p>", False)])
def test_names_within_an_article(part, stays):
    dom = Dom(f"<body><article><p>Start</p>{part}<p>End</p></article></body>")
    assert html_wrapper.article(dom, set()) == ["Start", *(["Yes"] if stays else []), "End"]
    again = html_wrapper.Nodes(html_wrapper.Nodes.dumps(dom, dom.outside()))
    assert html_wrapper.article(again, set()) == html_wrapper.article(dom, set())


def test_long_lists_are_matched_in_halves_as_well_as_in_one_table(monkeypatch):
    import random
    rng = random.Random(8)
    for _ in range(40):
        a, b = (html_wrapper.Tree.of(Dom("".join(rng.choice(["<div><b>x</b></div>", "<ul><li>x<li>y</ul>", "<p>z</p>", "<hr>", "<div></div>"])
                                                 for _ in range(rng.randint(1, 40)))))[0] for _ in range(2))
        monkeypatch.setattr(html_wrapper, "MAX_CELLS", 1_000_000)
        whole = html_wrapper.Matching(a, b).pairs
        monkeypatch.setattr(html_wrapper, "MAX_CELLS", rng.choice([0, 3, 20]))
        halved = html_wrapper.Matching(a, b).pairs
        assert len(halved) == len(whole) == len(set(halved)) == len({y for _, y in halved})
        assert all((x, y) == (0, 0) or (a.parent[x], b.parent[y]) in set(halved) for x, y in halved)


def test_an_inserted_block_does_not_shift_the_matches_of_a_long_page():
    kinds = ["<div><b>x</b></div>", "<ul><li>x</ul>", "<p>z</p>"]
    blocks = [kinds[i * i % 7 % 3] for i in range(3_000)]
    a, b = (html_wrapper.Tree.of(Dom("<h1>t</h1>" + "".join(p) + "<h2>t</h2>"))[0]
            for p in (["<h3>new</h3>", *blocks, "<pre>p</pre>"], ["<pre>p</pre>", *blocks, "<h3>old</h3>"]))
    pairs = html_wrapper.Matching(a, b).pairs
    assert len(pairs) == len(a.tag) - 4
