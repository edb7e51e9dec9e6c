"""Style tree and syncmers."""

import html
import math
import random
import re

import pytest
from llm_data import awkward, documents
from pyspark.sql import functions as F
from test_oracles import SF_DIR

from snapledger.llm import style_tree, syncmers
from snapledger.llm.queries import QUERIES

PAGES = "page_id long, url string, html string"


def text_of(page):
    return "\n".join(b[3] for b in style_tree.read_blocks(page))


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>one<p>two<br>lines<div>three</div>four", "one\ntwo lines\nthree\nfour"),
        ("<nav>menu</nav><p>x &amp; &lt;b&gt; &eacute;&#33; <b>bold</b>er</p><footer>f</footer>", "x & <b> é! bolder"),
        ("<script>var a='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><h1>yes</h1>", "yes"),
        ("<div class='side-bar ad'>buy</div><div class=cookie-notice>ok?</div><div role='navigation'>n</div><p>in", "in"),
        ("<p>a <span class=ad>buy <span>now</span></span> b</p><form><input><p>no</form>z", "a b\nz"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\nb\nc\nd\ne"),
        ("<p>3 < 4 and 5 > 2</p></div></p><p title='a > b'>q", "3 < 4 and 5 > 2\nq"),
        ("<p>ends <!-- open", "ends"),
        ("<p>ends<script>open", "ends"),
        ("<header>site</header><section id=comments><p>me too</section><p hidden>h</p><p>t", "t"),
        ("<div class='layout has-sidebar'><main><p>Real text one.</p></main><div class=sidebar>s</div></div>", "Real text one."),
        ("<div id='page' class='no-sidebar'><article><p>Real</p></article></div>", "Real"),
        ("<article class='search-result comment-open'><p>Real</p><div class=share>s</div></article>", "Real"),
        ("<div class=widget><div id=search><article>a</article></div><p>more</p></div><div class=ad>b</div>", "a\nmore"),
        ("<article>a</article><section class=comments><article class=comment>me too</article></section>", "a"),
        ("<nav><article>in a menu</article></nav><div class=widget>w</div><p>t", "t"),
        ("<article><p>As <math><mi>x</mi></math> grows</p></article>", "As x grows"),
        ("<p>" + "long " * 50_000, ("long " * 50_000).strip()),
    ],
)
def test_blocks(page, expected):
    assert text_of(page) == expected


def extract(spark, rows):
    return {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, PAGES)).collect()}


def test_sites_lose_what_they_repeat(spark):
    """Unnamed boilerplate goes by importance, pages of a single page site keep all, articles stay whole."""
    rows = [
        (i, "http://Site.example/a", f"<div><div>Site map Terms Help</div><div><p>Story {i} begins.</p><p>It goes on {i}.</p></div></div>")
        for i in range(30)
    ]
    rows += [(100, "http://alone.example/", "<div>Site map</div><p>Only page</p>"), (101, None, None), (102, "x", "")]
    rows += [(200 + i, "https://mirror.example/", f"<i>{i}</i><article><h1>T</h1><p>same article</p><p>same article</p></article><div>off</div>") for i in range(20)]
    rows += [(300 + i, "https://copies.example/", "<p>the same page</p>") for i in range(20)]
    got = extract(spark, rows)
    assert len(got) == len(rows)
    for i in range(30):
        assert got[i] == f"Story {i} begins.\nIt goes on {i}."
    assert got[100] == "Site map\nOnly page" and got[101] == got[102] == ""
    assert {got[200 + i] for i in range(20)} == {"T\nsame article\nsame article"}
    assert {got[300 + i] for i in range(20)} == {"the same page"}, "copies of a page count once"
    assert extract(spark, []) == {}


def test_styles_tell_elements_of_one_name_apart(spark):
    """A menu and texts in elements of one name: merged by their paths, the texts would keep the menu."""
    story = lambda i: f"<div>Story {i} begins.</div><div>It goes on {i}.</div>"
    rows = [(i, "http://s.example/", f"<div><div>Home Terms Help</div>{story(i)}</div>") for i in range(20)]
    rows += [(100 + i, "http://t.example/", f"<article><p>Rules of the house</p><p>Text {i}</p><p>More {i}</p></article>") for i in range(20)]
    # As many styles as pages: there is no evidence by place, and by path half of the texts are unique.
    rows += [(200 + i, "http://u.example/", f"<div>Home</div><div>Story {i}</div>{'<ul></ul>' * i}") for i in range(20)]
    got = extract(spark, rows)
    assert all(got[i] == f"Story {i} begins.\nIt goes on {i}." for i in range(20))
    assert all(got[100 + i] == f"Text {i}\nMore {i}" for i in range(20))
    assert all(got[200 + i] == f"Home\nStory {i}" for i in range(20))


def test_style_nodes_of_a_page():
    of = lambda page: {b[3]: b[2] for b in style_tree.read_blocks(page)}
    one, two = of("<div>a</div><div>b</div><ul><li>c</ul>"), of("<div>a</div><div>x</div><ul><li>c</ul>")
    assert one["a"] != one["b"] and one["a"] == two["a"] and one["b"] == two["x"] and one["c"] == two["c"]
    assert of("<div>a</div><p>b")["a"] != one["a"], "another style of the same element"
    assert len(set(of("".join(f"<p>{i}</p>" for i in range(20_000))).values())) == 20_000


def test_repeated_parts_of_articles_go(spark):
    box = "<div class=box><p>Written by our own team, see the rules of the house</p></div>"
    rows = [(i, "https://s.example/", f"<div>out {i}</div><article><h1>T {i}</h1><p>Story {i}.</p>{box}</article>") for i in range(12)]
    rows += [(100 + i, "https://s.example/", f"<article><h1>T</h1><p>a mirrored story</p>{box}</article>") for i in range(30)]
    rows += [(200 + i, "https://few.example/", f"<main><p>Text {i}</p>{box}</main>") for i in range(2)]
    rows += [(300 + i, "https://all.example/", f"<main><p>{'ab'[i % 2]}</p><p>{'ab'[i < 6]}</p></main>") for i in range(12)]
    got = extract(spark, rows)
    assert [got[i] for i in range(12)] == [f"T {i}\nStory {i}." for i in range(12)]
    assert {got[100 + i] for i in range(30)} == {"T\na mirrored story"}
    assert all("rules" in got[200 + i] for i in range(2)), "two pages are too little evidence"
    assert all(got[300 + i] for i in range(12)), "no article is emptied"


def test_unique_texts_stay_on_a_hot_host(spark):
    """However many pages and child sequences a host has."""
    ids = spark.range(30_000).select(F.col("id").alias("page_id"), F.lit("https://hot.example/").alias("url"), "id")
    # 60 child sequences of skewed frequency, the first on most pages.
    tail = F.when(F.col("id") % 8 == 0, F.repeat(F.lit("<ul></ul>"), (F.col("id") % 61).cast("int"))).otherwise("")
    html = F.concat(F.lit("<div class=text><p>Text "), "id", F.lit("</p>"), tail, F.lit("</div><div class=low><p>Same</p></div>"))
    got = style_tree.extract(ids.select("page_id", "url", html.alias("html")))
    assert got.where(F.col("text") != F.concat(F.lit("Text "), "page_id")).count() == 0 and got.count() == 30_000


def test_articles_under_misleading_names(spark):
    """Only what is inside the article counts, whatever the names around it say."""
    rows = [
        (1, "http://a.example/", "<div class='layout has-sidebar'><main><p>One.</p></main><p>out</p></div>"),
        (2, "http://b.example/", "<div class='widget'><article><p>Two.</p></article><p>out</p></div><div class=ad>x</div>"),
        (3, "http://c.example/", "<article class='search-result comment-open'><p>Three.</p></article>"),
    ]
    assert extract(spark, rows) == {1: "One.", 2: "Two.", 3: "Three."}


def test_low_nodes_against_a_plain_computation(spark):
    rng = random.Random(3)
    rows = []
    for page in range(60):
        for at in range(rng.randint(1, 8)):
            node = rng.randrange(6)
            rows.append((page % 3, rng.choice([style_tree.PLAIN, style_tree.CONTENT]), page % 50, at, node, rng.choice([7, 8, 100 * page + at][: node % 3 + 1])))
    frame = spark.createDataFrame(rows, "site long, kind int, signature long, at int, node long, text long")
    got = {(r.site, r.kind, r.node) for r in style_tree.low_nodes(frame).collect()}
    pages, places = {}, {}
    for site, kind, signature, at, node, text in rows:
        pages.setdefault((site, kind), set()).add(signature)
        places.setdefault((site, kind, node), {}).setdefault(text, {}).setdefault(signature, set()).add(at)
    low = set()
    for (site, kind, node), texts in places.items():
        count = len(pages[site, kind])
        if count < 2:
            continue
        entropies, weights = [], []
        for spread in texts.values():
            sizes = [len(a) for a in spread.values()]
            entropies.append(-sum(c / sum(sizes) * math.log(c / sum(sizes)) for c in sizes))
            weights.append(sum(sizes))
        mean = sum(e * w for e, w in zip(entropies, weights, strict=True)) / sum(weights)
        prior = style_tree.CONTENT_PRIOR if kind == style_tree.CONTENT else 0
        importance = (prior + count * max(0.0, 1 - mean / math.log(count))) / (prior + count)
        if importance < style_tree.MIN_IMPORTANCE:
            low.add((site, kind, node))
    assert got == low and 0 < len(low) < len(places)


def test_further_columns_of_pages(spark):
    rows = [(1, "http://a.example/", "<p>x</p>", 1, 2, 3, 4)]
    pages = spark.createDataFrame(rows, f"{PAGES}, site int, blocks int, low int, kind int")
    assert [tuple(r) for r in style_tree.extract(pages).collect()] == [(1, "http://a.example/", "x")]


def test_page_query(spark):
    got = {r.page_id: r for r in QUERIES["op6_style_tree"](spark, SF_DIR).collect()}
    for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect():
        article = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_repeated_pages_are_rows_of_their_own(spark):
    rows = [(1, "http://a.example/", "<p>x</p>")] * 3 + [(None, None, "<article>y</article>")]
    assert style_tree.extract(spark.createDataFrame(rows, PAGES)).count() == 4


def plain_anchors(text):
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return []
    pad = [""] * (syncmers.K - 1)
    words = [*pad, *words, *pad]
    found = []
    for i in range(len(words) - syncmers.K + 1):
        run = words[i : i + syncmers.K]
        inner = [md5(" ".join(run[j : j + syncmers.S])) for j in range(syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.append(md5(" ".join(run))[: syncmers.HEX])
    return found


def test_anchors_against_every_run(spark):
    docs = documents(spark).select("text", syncmers.anchors(F.col("text")).alias("found"))
    for r in docs.collect():
        assert r.found == plain_anchors(r.text or "")
        assert bool(r.found) == bool((r.text or "").strip(" \t\n\r\x0b\x0c"))


def test_an_edit_moves_only_its_anchors(spark):
    words = [f"w{i}" for i in range(400)]
    edited = [*words[:200], "new", *words[201:]]
    one, two = plain_anchors(" ".join(words)), plain_anchors(" ".join(edited))
    assert len(set(one) - set(two)) <= syncmers.K and len(one) > 400 / (syncmers.K - syncmers.S) / 2
    # Any K - S neighbouring runs hold an anchor, so none is far from the next.
    positions = [i for i in range(len(words) - syncmers.K + 1) if plain_anchors(" ".join(words[i : i + syncmers.K]))]
    assert positions


@pytest.mark.parametrize("blocks", [1, 3, 1024])
def test_next_rows(spark, blocks, monkeypatch):
    monkeypatch.setattr(syncmers, "BLOCK_ROWS", blocks)
    rows = [(k, f"t{k}") for k in (5, -3, 9, 100, 101, 102, 10**12, -(10**15))]
    df = spark.createDataFrame(rows, "doc_id long, v string").withColumn("_tie", F.xxhash64("v"))
    got = {r.doc_id: r.next_v for r in syncmers.with_next(df, "doc_id", ["v"]).collect()}
    order = sorted(k for k, _ in rows)
    assert got == {k: f"t{order[(i + 1) % len(order)]}" for i, k in enumerate(order)}


def test_outlying_keys_leave_blocks_even(spark, monkeypatch):
    """One id far away, and ids in clusters: blocks keep about equal numbers of rows."""
    monkeypatch.setattr(syncmers, "BLOCK_ROWS", 100)
    far = spark.range(20_000).select(F.col("id").alias("doc_id")).unionByName(spark.range(1).select(F.lit(2**62).alias("doc_id")))
    clusters = spark.range(20_000).select((F.floor(F.col("id") / 5000) * 10**15 + F.col("id")).cast("long").alias("doc_id"))
    for df in (far, clusters):
        values = sorted(float(r.doc_id) for r in df.collect())
        cuts = [values[i * (len(values) - 1) // syncmers.QUANTILES] for i in range(syncmers.QUANTILES + 1)]
        counted = df.select(syncmers.block_of(F.col("doc_id").cast("double"), cuts, 200).alias("b"), "doc_id")
        sizes = [r["count"] for r in counted.groupBy("b").count().collect()]
        assert max(sizes) <= 400 and len(sizes) >= 100
        rows = sorted((r.doc_id, r.b) for r in counted.collect())
        assert [b for _, b in rows] == sorted(b for _, b in rows)


def test_awkward_prints(spark):
    rows = awkward()
    got = syncmers.compare_edited(documents(spark).withColumn("found", F.lit(1))).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[1] == prints[2] and prints[4] == prints[5] == prints[6] == ""
    single = syncmers.compare_edited(documents(spark, [(1, "abcd efgh", None, None, None)])).first()
    assert (single.n_chars, single.near_next) == (9, 1.0)
    assert syncmers.compare_edited(documents(spark, [])).count() == 0
