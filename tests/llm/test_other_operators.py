"""Main-text extraction, URL judgement, exact top-k search."""

import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import hamming_topk, html_extract, link_rank

W = html_extract.DEFAULT_WEIGHTS


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 7).flatmap(lambda n: st.tuples(st.lists(st.integers(-5, 5), min_size=n, max_size=n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(1, 4)), max_size=9))))
def test_min_cut_is_minimal(case):
    costs, edges = case
    edges = [e for e in edges if e[0] != e[1]]

    def total(label):
        return sum(abs(c) for c, keep in zip(costs, label, strict=True) if (c > 0) != keep and c != 0) + sum(w for a, b, w in edges if label[a] != label[b])

    label = html_extract.min_cut([float(c) for c in costs], edges)
    assert total(label) == min(total(x) for x in itertools.product([False, True], repeat=len(costs)))


def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body><!-- <p>no</p> -->
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>About</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <div id="content"><h2>Head &amp; tail</h2><p>First   paragraph,\n with <b>bold</b> and&nbsp;a <a href=z>link</a>.<p>Second &lt;one&gt; &#233;.<br>More.</p><ul><li>Item one is here.</li></ul></div>
    <div id="comments"><p>I liked this very much, thank you all for the long read.</p></div><aside>Related: much else to read here.</aside><form><p>Mail us</p><input></form><div hidden>Secret text</div><footer>&copy; 2024"""
    assert html_extract.main_text(page, W) == "Head & tail\nFirst paragraph, with bold and a link.\nSecond <one> é. More.\nItem one is here."
    assert html_extract.main_text("", W) == "" and html_extract.main_text("<script>x", W) == "" and html_extract.main_text("<p", W) is not None


def test_extract_table(spark):
    rows = [(1, "http://a/", "<article><p>Hello there, this is text.</p></article><footer>f</footer>"), (2, None, None), (None, "u", ""), (1, "http://a/", "<article><p>Hello there, this is text.</p></article><footer>f</footer>"), (3, "v", "<article>" + "<p>Words in a long page.</p>" * 4000 + "</article>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert [r.text for r in got[:4]] == ["Hello there, this is text.", "", "", "Hello there, this is text."]
    assert got[4].n_chars == 4000 * 22 - 1 and [r.n_chars for r in got[:2]] == [26, 0]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_extract_keeps_the_article(spark, sf):
    import html
    import re

    for r in html_extract.extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"(?s)<article>(.*?)(</article>|$)", r.html)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for x in blocks if x)


def test_url_rules(spark):
    rows = {
        "https://WWW.Shop.Com/en/1?x": ("www.shop.com", "/en/1", "com/en/", "block"),
        "http://a.example.com/en/77#t": ("a.example.com", "/en/77", "example.com/en/7", "allow"),
        "http://example.net/de/8/x": ("example.net", "/de/8/x", "example.net/de/8", "block"),
        "http://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/", "allow"),
        "ftp://x.org/es/": ("x.org", "/es/", "org/es/", "block"),
        "http://com?/en/": ("com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(rows)] + [(None, "http://q.io/", "", "x")] * 2, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in link_rank.judge_urls(df).collect()}
    for i, (host, path, rule, verdict) in enumerate(rows.values()):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            assert r.verdict == verdict
    assert got[None].verdict == "allow"
    assert link_rank.judge_urls(df.limit(0)).count() == 0


def test_propagation_matches_dense_iteration(spark):
    from loomspan.llm.common import Scratch

    rng = random.Random(2)
    edges = sorted({(f"h{rng.randrange(12)}", f"h{rng.randrange(12)}") for _ in range(40)})
    edges = [e for e in edges if e[0] != e[1]]
    seeds = {"h0": 0.75, "h3": 0.25}
    table = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(list(seeds.items()), "host string, weight double")
    got = dict(link_rank.propagate(*table, Scratch(spark, "t"), "p").collect())
    salted = dict(link_rank.propagate(*table, Scratch(spark, "t"), "p", hub_links=2).collect())
    assert salted.keys() == got.keys() and all(abs(salted[h] - got[h]) < 1e-12 for h in got)
    score = dict(seeds)
    out = {s: sum(e[0] == s for e in edges) for s, _ in edges}
    for _ in range(link_rank.ROUNDS):
        new = {h: 0.15 * w for h, w in seeds.items()}
        for s, d in edges:
            if s in score:
                new[d] = new.get(d, 0) + 0.85 * score[s] / out[s]
        score = new
    assert got.keys() == score.keys() and all(abs(got[h] - score[h]) < 1e-12 for h in got)


def test_distrust_flows_back_to_linking_hosts(spark):
    rows = [(1, "http://bad.com/en/x", ""), (2, "http://feeder.io/", '<a href="http://bad.com/">x</a>'), (3, "http://good.example.com/en/7", '<a href="//fine.io/">y</a>'), (4, "http://fine.io/", "")]
    got = {r.page_id: r.verdict for r in link_rank.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_only_links_join_hosts_unless_asked(spark):
    rows = [(1, "http://shop.com/en/x", "<a href='/in'>x</a>"), (2, "http://a.shop.com/", "<a href='b.html'>x</a>"), (3, "http://a.shop.com/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in link_rank.judge_urls(pages).collect()} == {1: "block", 2: "allow", 3: "allow"}
    assert {r.page_id: r.verdict for r in link_rank.judge_urls(pages, parent_links=True).collect()} == {1: "block", 2: "block", 3: "block"}


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 64))
    vectors = [(int(i), (centers[i % 6] + rng.normal(size=64) * 0.7).tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(60)] + [(2000, None), (2020, [1.0] * 3), (5, vectors[5][1]), (None, [1.0] * 64)]
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, distance string")
    codes = {i: [bool(v is not None and k < len(v) and v[k] > 0) for k in range(64)] for i, v in vectors if i is not None}
    want = set()
    for q, c in codes.items():
        if q % 20 == 0:
            near = sorted((sum(a != b for a, b in zip(c, d, strict=True)), i) for i, d in codes.items() if i != q)[:10]
            want |= {(q, r + 1, i, n) for r, (n, i) in enumerate(near)}
    assert {tuple(r) for r in hamming_topk.top_k(df).collect()} == want
    assert hamming_topk.top_k(df.limit(0)).count() == 0
    few = hamming_topk.top_k(df.where("vec_id in (0, 1, 2)")).collect()
    assert [r.rank for r in few] == [1, 2]


def test_pages_without_optional_end_tags():
    prose = "Some long prose, with commas, and a full stop at the end of it."
    for before in ("<select><option>A<option>B</select>", "<select><option>A<option>B", "<datalist><option>A<option>B</datalist>", "<div><button>Go</div>", "<button>Go", "<svg><path d='m'>", "<div><button><div>Go</div></button></div>", "<object data=x>"):
        got = html_extract.main_text(f"<body>{before}<article><p>{prose}</p></article></body>", W)
        assert got.split("\n")[-1] == prose and "Go" not in got, before
    assert html_extract.main_text(f"<head><title>T</title><p>{prose}", W) == html_extract.main_text(f"<head><meta charset=x><title>T</title>{prose}", W) == prose
    inline = "<p>One, two <svg><g><text>no</text></g></svg>three <math><mi>x</mi><mo>+</mo><mi>y</mi></math> and <object>four</object> <button>no</button>five.</p>"
    assert html_extract.main_text(f"<article>{inline}</article>", W) == "One, two three x+y and four five."


def test_boilerplate_inside_nested_wrappers():
    prose = "Some long prose, with commas, and a full stop at the end of it, as an article has it."
    advert = "Buy this now, said the advert, which reads like prose, and has a full stop. And then another sentence follows."
    for wraps in range(5):
        for inside in ("<div class=ad>{}</div>", "<aside>{}</aside>", "<div class=notice><div class=content><div class=text>{}</div></div></div>", "<div class=comments><article class=post>{}</article></div>"):
            page = "<main class=content><article class=post>" + "<div class=entry-content>" * wraps + f"<p>{prose}</p>" + inside.format(f"<p>{advert}</p>") + f"<p>{prose}</p>" + "</div>" * wraps + "</article></main>"
            assert html_extract.main_text(page, W) == f"{prose}\n{prose}", (wraps, inside)
    for name in ("no-sidebar", "post tag-search", "category-legal"):
        assert html_extract.main_text(f'<article class="{name}"><p>{prose}</p></article>', W) == prose
    assert html_extract.main_text(f"<article class=comment><p>{prose}</p></article>", W) == ""
