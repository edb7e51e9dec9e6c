"""Main text of web pages by a site style tree.

Pages are parsed into blocks of text, each with its place among the elements above it. Pages of one
host are merged into a style tree: below an element stand its styles, the sequences of child elements
it has on some page, and below a style its elements, each a node of its own. So a menu and a text in
elements of one name are told apart by their places in the style of what holds them. The contents of
a node are the texts of its blocks. Importance follows the published measure. There a branch goes if
it and all below it are unimportant, so whether a text goes is up to its leaf, and a leaf counts by
how unevenly its texts are spread over the host's pages: one minus the entropy of every text over the
pages, weighted by how often it occurs. Presentation entropy is the measure of nodes with styles, which
hold no text of their own: it says which branch a leaf goes with, not whether it goes. Leaves below
``MIN_IMPORTANCE`` go, at every size of the host. A host of one page has no evidence and keeps all.

Styles that differ from page to page leave a node few pages. So a leaf is judged a second time with
all styles merged, where a node is the path of names, and goes if either says so.

Some nodes declare what they are. Elements, roles and class names for menus, adverts, forms and the
like have importance 0. A name alone, unlike an element, can mislead: ``has-sidebar`` names a state and
declares nothing, and where names would leave a page without the ``article`` or ``main`` it has, they
are disbelieved for these elements and what holds them. A page with an ``article`` or ``main`` gives only what is inside; there the
same measure decides, with ``CONTENT_PRIOR`` pages' worth of importance 1 added to the evidence.
Articles of equal texts count once, so mirrored articles are contents all the same, and an article
of which nothing would be left is left whole.

A page of a host with many pages is never gathered with the others: the tree is a table of counts,
aggregated before its shuffle, and pages of equal text count once.

Defined results: a null or empty page has an empty text; unclosed and crossed elements end where
HTML implies it, else with what holds them; an unclosed comment or script lasts to the end; pages
that repeat are rows of their own; a url without a host belongs to the host of the empty name; an
empty table gives an empty result. Very long pages are parsed in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import attach, is_small
from ..session import stage
from .common import modest_batches

MIN_IMPORTANCE = 0.3
CONTENT_PRIOR = 1.0

# Elements of HTML and names that sites give to boilerplate.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
NOISE_TAGS = set(
    "applet aside audio button canvas datalist dialog fieldset footer form frameset head iframe map menu nav "
    "noframes noscript object optgroup option script search select style svg template textarea title video xmp".split()
)
NOISE_NAMES = set(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer discussion footer form login menu modal nav navbar navigation newsletter notice pagination "
    "popup promo promoted promotion related reply replies respond search share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription toolbar widget".split()
)
STATE_PREFIXES = set("has have is no not with without".split())
NOISE_ROLES = set(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
CONTENT_TAGS = {"article", "main"}
CLOSED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tr": {"tr", "td", "th"},
    "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"},
    "option": {"option"},
}
SCOPES = set("ul ol menu dl table body article section div nav aside td th".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)""", re.I)

PLAIN, NOISE, CONTENT = 0, 1, 2


def names_noise(value: str) -> bool:
    """Whether a class or id has a word for boilerplate, other than as a state of something else."""
    for name in value.split():
        words = re.split(r"[_-]+", name)
        if words[0] not in STATE_PREFIXES and not NOISE_NAMES.isdisjoint(words):
            return True
    return False


@lru_cache(maxsize=4096)
def declared(tag: str, attributes: str) -> tuple[int, str, bool]:
    """What an element says it is, its name in a path, and whether it is noise by a name alone."""
    names: list[str] = []
    noise = tag in NOISE_TAGS or bool(HIDDEN.search(attributes))
    named = False
    for key, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if key.lower() == "role":
            noise = noise or value.strip() in NOISE_ROLES
            continue
        if key.lower() == "class":
            names += value.split()
        named = named or names_noise(value)
    name = ".".join([tag, *sorted(names)])
    if tag in ("html", "body"):  # states of the whole page, not parts of it
        return PLAIN, tag, False
    kind = CONTENT if tag in CONTENT_TAGS else PLAIN
    return NOISE if noise or named else kind, name, named and not noise


def read_blocks(page: str) -> list[tuple[str, int, int, str]]:
    """(path, kind, style node, text) of every block outside declared boilerplate.

    The style node is the place of the block's container in the style tree. A page whose articles all
    lie in elements that are boilerplate by their names, or are such themselves, is read again without
    believing these names.
    """
    blocks, doubted = read_once(page, frozenset())
    return read_once(page, doubted)[0] if doubted else blocks


def read_once(page: str, trusted: frozenset[int]) -> tuple[list[tuple[str, int, int, str]], frozenset[int]]:
    """Blocks of a page, and the elements, by number, whose names hide all its articles from view.

    Elements in ``trusted`` are not boilerplate by their names.
    """
    number, named_open = 0, []  # open elements that are noise: their number if by a name, else -1
    hiding: set[int] = set()
    seen_article = False
    stack: list[tuple[str, int, str]] = []  # tag, kind, name
    children: list[list[str]] = [[]]
    elements: list[tuple[int, list[str], int]] = []  # the element above, its children, place among them
    holders = [-1]  # the open elements
    blocks: list[tuple[str, int, int, str]] = []
    held: list[str] = []
    noise = content = 0

    def flush() -> None:
        if held:
            if not noise:
                text = " ".join(unescape("".join(held)).split())
                if text:
                    blocks.append(("/".join(s[2] for s in stack), CONTENT if content else PLAIN, holders[-1], text))
            held.clear()

    def pop() -> None:
        nonlocal noise, content
        _, kind, _ = stack.pop()
        children.pop()
        holders.pop()
        noise -= kind == NOISE
        if kind == NOISE:
            named_open.pop()
        content -= kind == CONTENT

    def close(tags: set[str], scopes: set[str]) -> None:
        """End the innermost open element of ``tags`` unless a scope lies between."""
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in tags:
                flush()
                while len(stack) > depth:
                    pop()
                return
            if stack[depth][0] in scopes:
                return

    at, size = 0, len(page)
    while at < size:
        found = TOKEN.search(page, at)
        if found is None:
            held.append(page[at:])
            break
        if found.start() > at:
            held.append(page[at : found.start()])
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag, attributes, ending = tag.lower(), found[3] or found[6] or "", bool(found[1] or found[4])
        if ending:
            if any(s[0] == tag for s in stack):
                close({tag}, set())
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img"):
                held.append(" ")
            continue
        kind, name, by_name = declared(tag, attributes if ("=" in attributes or "idden" in attributes) else "")
        number += 1
        if by_name and number in trusted:
            kind, by_name = CONTENT if tag in CONTENT_TAGS else PLAIN, False
        if tag in CONTENT_TAGS:
            around = [*named_open, number] if by_name else named_open
            if not around and kind == CONTENT:
                seen_article = True
            elif -1 not in around and (by_name or kind == CONTENT):
                hiding.update(around)
        if tag == "header" and not content and kind == PLAIN:
            kind = NOISE  # of the page; a header inside the article belongs to it
        if tag not in BLOCKS and kind != NOISE:
            continue
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag in BLOCKS:
            flush()
            close({"p"}, SCOPES)
            if tag in CLOSED_BY:
                close(CLOSED_BY[tag], {"ul", "ol", "menu", "dl", "table"})
            children[-1].append(name)
        if kind == NOISE and tag not in BLOCKS:
            at = skip_inline(page, at, tag)
            continue
        stack.append((tag, kind, name))
        if kind == NOISE:
            named_open.append(number if by_name else -1)
        elements.append((holders[-1], children[-1], len(children[-1]) - 1))
        holders.append(len(elements) - 1)
        children.append([])
        noise += kind == NOISE
        content += kind == CONTENT
    flush()
    nodes = style_nodes(elements)
    found = [(path, kind, nodes[holder], text) for path, kind, holder, text in blocks]
    return found, frozenset() if seen_article else frozenset(hiding)


def style_nodes(elements: list[tuple[int, list[str], int]]) -> list[int]:
    """The node of every element in the style tree; the last one is that of the page.

    A node follows from the node above, that node's style and the place in it.
    """
    styles: dict[int, int] = {}
    nodes = [0] * (len(elements) + 1)
    for at, (above, siblings, place) in enumerate(elements):
        if id(siblings) not in styles:  # hashed once, however long
            styles[id(siblings)] = node_of(" ".join(siblings))
        nodes[at] = node_of(f"{nodes[above]} {styles[id(siblings)]} {place}")
    return nodes


def skip_inline(page: str, at: int, tag: str) -> int:
    """The place after the end of an inline element of boilerplate, or ``at`` if it has none."""
    depth = 1
    for found in re.compile(rf"<(/?){re.escape(tag)}\b[^>]*>", re.I).finditer(page, at):
        depth += -1 if found[1] else 1
        if not depth:
            return found.end()
    return at


PARSED = "page_id long, url string, site long, blocks array<struct<node:long,style:long,kind:int,text:string>>"


def node_of(path: str) -> int:
    return int.from_bytes(blake2b(path.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64()), ("kind", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        rows = []
        for page in batch.column("html"):
            blocks = read_blocks(page.as_py() or "")
            rows.append([{"node": node_of(p), "style": s, "kind": k, "text": t} for p, k, s, t in blocks])
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("page_id", "url", "site")], pa.array(rows, kind)],
            names=["page_id", "url", "site", "blocks"],
        )


def log_of(value):
    return F.log(value.cast("double"))


def low_nodes(blocks: DataFrame) -> DataFrame:
    """(site, kind, node) of the text leaves whose importance is too low.

    ``blocks`` has site, kind, signature of the page's texts, place in the page, node and hash of the
    text. Pages of equal texts count once.
    """
    branch = ["site", "kind", "node"]
    pages = blocks.groupBy("site", "kind").agg(F.count_distinct("signature").alias("pages")).where("pages > 1")
    per_page = blocks.groupBy(*branch, "text", "signature").agg(F.count_distinct("at").alias("c"))
    spread = per_page.groupBy(*branch, "text").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * log_of(F.col("c"))).alias("s")
    )
    contents = (
        spread.withColumn("entropy", log_of(F.col("n")) - F.col("s") / F.col("n"))
        .groupBy(*branch)
        .agg((F.sum(F.col("entropy") * F.col("n")) / F.sum("n")).alias("entropy"))
    )
    joined = contents.join(pages, ["site", "kind"])
    content = F.greatest(F.lit(0.0), 1 - F.col("entropy") / log_of(F.col("pages")))
    prior = F.when(F.col("kind") == CONTENT, F.lit(CONTENT_PRIOR)).otherwise(0)
    return joined.where((prior + F.col("pages") * content) / (prior + F.col("pages")) < MIN_IMPORTANCE).select(*branch)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page; ``pages`` has page_id, url and html."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.xxhash64(host).alias("site"), "html")
    # Staged, so that parsing happens once.
    parsed = stage(modest_batches(rows).mapInArrow(parse, PARSED), "blocks")
    of_kind = lambda kind: F.filter("blocks", lambda b: b["kind"] == kind)

    def evidence(kind: int) -> DataFrame:
        own = parsed.select("site", of_kind(kind).alias("own")).where(F.size("own") > 0)
        nodes = lambda b: F.array(b["node"], b["style"])
        hashed = own.select("site", F.transform("own", lambda b: F.struct(nodes(b).alias("nodes"), F.xxhash64(b["text"]).alias("text"))).alias("own"))
        signature = F.xxhash64(F.transform("own", lambda b: b["text"]))
        placed = hashed.select("site", F.lit(kind).alias("kind"), signature.alias("signature"), F.posexplode("own").alias("at", "b"))
        return placed.select("site", "kind", "signature", "at", F.explode("b.nodes").alias("node"), "b.text")

    # A low branch is on many pages of its site, so a site has no more of them than some pages have blocks.
    low = low_nodes(evidence(PLAIN).unionByName(evidence(CONTENT))).groupBy("site", "kind").agg(F.collect_set("node").alias("low"))
    sizes = parsed.groupBy("site").agg(F.count(F.lit(1)).alias("size"))
    low = stage(low.join(sizes, "site"), "low")
    kind = F.when(F.exists("blocks", lambda b: b["kind"] == CONTENT), CONTENT).otherwise(PLAIN)
    judged = parsed.withColumn("kind", kind)
    if is_small(low):
        judged = judged.join(F.broadcast(low.drop("size")), ["site", "kind"], "left")
    else:
        judged = attach(judged.withColumn("tie", F.xxhash64("page_id", "url")), low, ["site", "kind"], ["tie"], "size")
    own = judged.select("page_id", "url", "kind", "low", F.filter("blocks", lambda b: b["kind"] == F.col("kind")).alias("own"))
    bad = F.coalesce("low", F.array().cast("array<bigint>"))
    kept = F.filter("own", lambda b: ~(F.array_contains(bad, b["node"]) | F.array_contains(bad, b["style"])))
    # Whatever declares itself the article is never lost as a whole.
    kept = F.when((F.size(kept) == 0) & (F.col("kind") == CONTENT), F.col("own")).otherwise(kept)
    return own.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"))
