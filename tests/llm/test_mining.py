"""Collocations, page text and spelling variants against brute force on awkward inputs."""

import os
import random
import re
import sys

import html as markup
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute

from rulegauge.llm import collocations, spelling, wrappers

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string"
CLASHES = ("phrase", "head", "last", "n", "size", "word", "form", "root", "near", "code", "reduced", "_host", "tree", "slot",
           "fixed", "menus", "print", "rank", "score", "first", "at")


def with_clashes(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES if c not in df.columns]).repartition(3)


def same(df, want):
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# ---- collocations ------------------------------------------------------------------------------------

def speech(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        pieces = [" ".join(rng.choice("new york city the a of red blue ñ É".split()) for _ in range(rng.randint(1, 12))) for _ in range(6)]
        texts.append(rng.choice([". ", "\n", "; ", "!?"]).join(pieces))
    texts += [None, "", " \t ", "...", "one", "New York City new york city", "x " * 500, "the  long\tfixed phrase of many words\r\n" * 9,
              "word joined here too", "a b c d e f g h"]
    texts += [texts[3]] * 5
    return [(i, t, rng.choice(["en", "de", None, "", "a\tb"])) for i, t in enumerate(texts)] + [(1, "the of the of", "en")] * 2


@pytest.mark.parametrize("seed, least", [(1, 3), (2, 8), (3, 1)])
def test_collocations(spark, seed, least):
    docs = speech(seed)
    got = collocations.collocations(with_clashes(spark.createDataFrame(docs, DOCS)), least=least, top=40, most=50)
    same(got, brute.collocations([d[1:] for d in docs], least, 40))


def test_graph_counts_every_length(spark):
    docs = speech(4)
    counts = collocations.graph(spark.createDataFrame(docs, DOCS), least=2)
    want = [(f"{lang}\t{' '.join(p)}", len(p), n) for lang, found in brute.phrase_counts([d[1:] for d in docs]).items()
            for p, n in found.items() if n >= 2 or len(p) == 1]
    same(counts, want)


def test_bigram_graph(spark):
    docs = speech(5)
    got = collocations.collocations(spark.createDataFrame(docs, DOCS), least=3, longest=2)
    same(got, brute.collocations([d[1:] for d in docs], 3, 2000, 2))


def test_paths_are_whole(spark):
    docs = [(1, "p q r s t u v w. p q r s t u v w", "en"), (2, "b q r s z", "en"), (3, "b q r s z", "en"), (4, "k l", "en")]
    counts = collocations.graph(spark.createDataFrame(docs, DOCS), least=2)
    got = collocations.phrases(collocations.paths(counts))
    # the node q r s joins two ways, so it ends the paths on both sides
    same(got, [("en", "p q r s", 4, 2), ("en", "q r s t u v w", 7, 2), ("en", "b q r s", 4, 2), ("en", "q r s z", 4, 2)])


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0


# ---- spelling ----------------------------------------------------------------------------------------

def misspelt(seed):
    rng = random.Random(seed)
    base = ["receive", "separate", "definitely", "abcdefghijkl", "straße" + "nbahn", "aaaaaaa", "ÉCOLEées"]
    texts = []
    for i in range(120):
        words = []
        for _ in range(25):
            w = rng.choice(base[:1 + i % len(base)])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abxéÀ×") + w[at:], w[:at] + rng.choice("abxé÷") + w[at + 1:]])
            words.append(rng.choice([w, w, w.title()]))
        texts.append(rng.choice([" ", "-", "1"]).join(words))
    texts += [None, "", "x" * 3000, "x" * 2999 + "y", "x" * 3000 + " " + "x" * 2999 + "y", "abcdefg abcdefh bbcdefg"] * 2
    return [(None if i == 5 else i, t) for i, t in enumerate(texts)] + [(7, texts[7])]


@pytest.mark.parametrize("seed, symbols", [(1, 2), (2, 6), (3, 20)])
def test_spelling(spark, seed, symbols):
    docs = misspelt(seed)
    df = with_clashes(spark.createDataFrame(docs, "doc_id bigint, text string"))
    same(spelling.variants(df, symbols=symbols), brute.spelling(docs))


def test_roots_of_long_chains(spark):
    steps = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(19)], "word string, root string")
    assert {r.root for r in spelling._roots(steps).collect()} == {"w19"}


def test_spelling_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# ---- pages -------------------------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string"


def said(html):
    page = wrappers.Page(html)
    tree, place = wrappers.shape(page.root)
    assert wrappers.encoded(wrappers.decoded(wrappers.encoded(tree))) == wrappers.encoded(tree)
    return wrappers.extracted(page, place, {}, set(), set())


@pytest.mark.parametrize("html, text", [
    ("", ""), ("plain  text", "plain text"), ("<p>cut <a href='x", "cut"), ("<p>x < y &lt; z &#233;&eacute;</p>", "x < y < z éé"),
    ('<p>a <a href="x" title="open>b</a> c', "a b c"), ("<p>one<br>two<p>th<b>re</b>e<!-- no > --></p>", "one two three"),
    ("<script>var t='</p>'; if (a<b) {}</script><p>x</p><style>p{}</style>", "x"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"), ("<ul><li>x<li>y<ul><li>z</ul><li>w</ul>", "x y z w"),
    ("<nav>m</nav><div class=post><h2>H</h2><p>P</p></div><div role=complementary>C</div><noscript>n</noscript>", "H P"),
    ('<div style="display: none">h</div><span hidden>i</span><p>v <span class="ad">AD</span></p>', "v"),
    ('<article class=comment>c c c c c c c</article><article><p>real</p></article><article class="related">r</article>', "real"),
    ('<div id="cookie-banner">c</div><header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>One</p>'
     '<aside>s</aside><form><label>Mail</label></form><section id="comments"><p>nice</p></section><footer>f</footer></article></main>', "T One"),
    ('<body class="has-sidebar"><div class="page-with-sidebar"><h1>T</h1><p>Long text.</p></div><div class="siteSidebar">s</div></body>',
     "T Long text."),
    ('<form id="all"><h1>T</h1><p>text text</p><input></form>', "T text text"),
    ("<div>" * 3000 + "deep", "deep"), ("<article></article><p>x</p>", "x"), ("<main><h1>T</h1><article>A</article></main>", "T A")])
def test_article_of_a_page(html, text):
    assert said(html) == text


def site(n, host="a.example"):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rng = random.Random(host)
    out = []
    for i in range(n):
        paragraphs = [" ".join(rng.choice(words) + str(rng.randrange(999)) for _ in range(12)) for _ in range(rng.randint(1, 4))]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        extra = "<div class=x5><b>Mid-page strip</b></div>" if i % 3 else ""
        links = "".join(f"<div><a href='/{rng.randrange(999)}'>{rng.choice(words)}{i}</a></div>" for _ in range(4))
        page = (f"<html><body><div class=x1>Welcome to the site</div><div class=x2>{links}</div>"
                f"<div class=x3 id=p{i}><h1>Title {i}</h1>{extra}{body}<p>Published by the desk</p></div><div class=x4>All rights kept</div></body></html>")
        out.append((i, f"https://{host}/{i}", page, " ".join([f"Title {i}", *paragraphs])))
    return out


def test_wrapper_finds_unnamed_template(spark):
    pages = site(30) + site(12, "b.example:80")
    pages += [(900 + i, "https://c.example/x", pages[5][2], None) for i in range(8)]      # copies of one page have no template
    df = with_clashes(spark.createDataFrame([p[:3] for p in pages], PAGES))
    got = [(r.page_id, r.url, r.text) for r in wrappers.main_text(df).collect()]
    want = [(p[0], p[1], p[3]) for p in pages if p[3] is not None]
    assert sorted(g for g in got if g[0] < 900) == sorted(want)
    alone = {g[2] for g in got if g[0] >= 900}
    assert len(alone) == 1 and "Published by the desk" in alone.pop()


def test_groups_of_any_size_give_one_wrapper(spark):
    pages = site(60)
    hosts = wrappers._hosts(spark.createDataFrame([p[:3] for p in pages], PAGES).withColumn(
        "html", F.concat(F.lit("<i class=cue>"), "html", F.expr("repeat('<div><section>', cast(page_id % 7 AS int))"))))
    seen = wrappers.seen_pages(hosts)
    for group in (2, 3, 50):
        trees = wrappers.induced(seen, group=group, share=0.0).collect()
        assert len(trees) == 1 and wrappers.decoded(trees[0].tree)[1] == 60


def test_matching_keeps_order():
    def tree(text):
        return [text[0], 1, [[c, 1, []] for c in text[1:]]]
    assert wrappers.match(tree("rabc"), tree("racb")) == 3 * 3
    merged = wrappers.merge(tree("rabc"), tree("raxc"))
    assert [(c[0], c[1]) for c in merged[2]] in ([("a", 2), ("b", 1), ("x", 1), ("c", 2)], [("a", 2), ("x", 1), ("b", 1), ("c", 2)])


def test_pages_without_anything(spark):
    rows = [(1, None, None), (2, "no address", ""), (None, "https://a/b", "<p>x</p>"), (3, "https://a/b", "<p>x</p>"), (3, "https://a/b", "<p>x</p>")]
    got = wrappers.main_text(spark.createDataFrame(rows, PAGES))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    same(got, [(1, None, "", 0), (2, "no address", "", 0), (None, "https://a/b", "x", 1), (3, "https://a/b", "x", 1), (3, "https://a/b", "x", 1)])
    assert wrappers.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in wrappers.main_text(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        text = " ".join(markup.unescape(re.sub("</?b>", "", re.sub("</?(p|h1|br)>", " ", inside))).split())
        assert got[r.page_id].text == text and got[r.page_id].n_chars == len(text)
