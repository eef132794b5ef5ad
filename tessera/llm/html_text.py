"""Main text of web pages by site style trees.

Each page is parsed once into its blocks of text and the elements that hold them.  The pages of a
host are merged: elements with the same path of tags and class names are one node of the
host's tree.  A node that looks alike on all pages (presentation: which children it has) and says the same on all (content: its texts)
tells nothing about a page: both are measured by entropy over the host's different
pages.  Nodes of low importance are removed from every page.  What the markup itself names (menus, adverts, forms ...)
and nodes that are nearly all links weigh less in the tree.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .arrays import pieces
from .common import dealt, table, written

#: Nodes below this importance go; the weight of nodes that markup names, or that are nearly all links.
THRESHOLD, NAMED, LINKED = 0.3, 0.2, 0.8
#: A node's importance counts with as many pages of importance 1 in addition, so few pages decide nothing.
PRIOR = 4.0
#: Up to this many removed nodes of all hosts (some 30 bytes each) are sent to every executor; beyond, they meet pages by host, node and part.
BROADCAST_NODES, SALTS = 200_000, 32

# ---- fixed values: elements and names ----
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes plaintext".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main math menu nav noscript object ol optgroup option p pre section select summary svg table tbody td template tfoot th thead tr ul video audio".split()
)
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre section summary table ul".split())
SCOPE = frozenset("button caption html object table td template th".split())
#: What a start tag closes, and where the search for it ends.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
ASIDE_TAGS = frozenset("aside audio button canvas dialog fieldset footer form head math menu nav noscript object select svg template video".split())
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
ASIDE_NAMES = frozenset(
    "ad ads adsbygoogle adsense advert advertisement advertisements advertising adverts alert aside banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies respond search share sharing sidebar signup social sponsor sponsored sponsors subscribe subscription syndication toolbar topbar widget widgets".split()
)
NOT_NAMES = frozenset("allowed closed disabled enabled has no non not open with without".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply".split())
# ---- end of fixed values ----

TAG = re.compile(r"""<(?:!--(?:.*?)(?:-->|--!>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|$)""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
PARSED = "page_id long, url string, host string, page long, blocks array<struct<node:long,main:boolean,text:string>>, facts array<struct<node:long,parent:long,kind:int,feature:long,chars:long,linked:long,named:boolean>>"


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _marks(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """An element's label in the tree, and whether its markup names it as aside, as reader comments, as main text."""
    label, aside, main, names, comments = tag, tag in ASIDE_TAGS, tag in ("article", "main"), set(), False
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), entities.unescape((m[2] or "").strip("\"'"))
        if key in ("class", "id"):
            label += "." + re.sub(r"\d+", "#", value.strip().lower())
            for name in value.split():
                found = [p.lower() for p in PARTS.findall(name)]
                if not NOT_NAMES & set(found):
                    names |= set(found)
                comments = comments or name.lower() in COMMENTS
        elif key == "role":
            aside, main = aside or value.strip().lower() in ASIDE_ROLES, main or value.strip().lower() in ("main", "article")
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            aside = True
    if tag not in ("html", "body", "main", "article"):
        aside = aside or bool(names & ASIDE_NAMES)
    # an article is aside only where its whole name says that it is a comment
    return label, aside or (comments and tag == "article"), tag == "header" or "header" in names, main


class Page:
    """One page's blocks in order and what it adds to its host's tree.

    Markup is read as browsers do, as far as text goes: raw elements, void elements, paragraphs and list items that the next
    one ends, stray end tags, comments and tags that aren't closed.  Inline elements are part of the block that holds them.
    """

    def __init__(self, text: str):
        self.blocks: list[tuple[int, bool, str]] = []
        self.nodes: dict[int, list] = {}  # parent, children's labels, characters, of these in links, named
        self.texts: set[tuple[int, int]] = set()
        self.stack: list[tuple] = []  # tag, node, aside, main, the text around an inline element
        self.open: dict[str, int] = {}
        self.text: list[str] = []
        self.linked, self.link = 0, None
        self._push("", "", False, False, None)
        self._read(text)
        while self.stack:
            self._pop()

    def _push(self, tag: str, label: str, aside: bool, main: bool, around) -> None:
        parent = self.stack[-1][1] if self.stack else 0
        node = _hash(str(parent), label)
        self.nodes.setdefault(node, [parent, [], 0, 0, aside])
        self.stack.append((tag, node, aside, main, around))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _pop(self) -> None:
        self._flush()
        tag, *_, around = self.stack.pop()
        self.open[tag] -= 1
        if around is not None:
            self.text = around
        if self.link is not None and len(self.stack) < self.link:
            self.link = None

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, node, _, main, _ = self.stack[-1]
            self.blocks.append((node, main, text))
            self.texts.add((node, _hash(text)))
            held = self.nodes[node]
            held[2] += len(text)
            held[3] += min(self.linked, len(text))
        self.text, self.linked = [], 0

    def _say(self, text: str) -> None:
        self.text.append(text)
        if self.link is not None:
            self.linked += len(text)

    def _close(self, tags, ends) -> bool:
        """Close elements from the top down to the nearest one of tags, unless one of ends comes first."""
        if not any(self.open.get(t) for t in tags):
            return False
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in tags:
                while len(self.stack) > k:
                    self._pop()
                return True
            if self.stack[k][0] in ends:
                return False
        return False

    def _read(self, text: str) -> None:
        at, marks = 0, {}
        while m := TAG.search(text, at):
            if m.start() > at:
                self._say(entities.unescape(text[at : m.start()]))
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            key = (tag, m[3])
            if key not in marks:
                marks[key] = _marks(*key)
            self._start(tag, *marks[key])
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(text, at)
                at = end.start() if end else len(text)
        if at < len(text):
            self._say(entities.unescape(text[at:]))

    def _start(self, tag: str, label: str, aside: bool, header: bool, main: bool) -> None:
        if tag in RAW:
            return
        if self.open.get("head") and tag not in IN_HEAD:
            self._close({"head"}, ())
        if tag in CLOSE_P:
            self._close({"p"}, SCOPE)
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        self.nodes[self.stack[-1][1]][1].append(label)
        _, _, within, in_main, _ = self.stack[-1]
        if tag in VOID:
            self._flush() if tag == "hr" else self.text.append(" ")
            return
        # a header within the main text holds its title; elsewhere it is the page's
        aside = within or aside or (header and not in_main)
        if tag in BLOCKS:
            self._flush()
            self._push(tag, label, aside, not aside and (in_main or main), None)
        elif aside and not within:  # an inline element that is named, such as an advert in a paragraph
            around, self.text, self.linked = self.text, [], 0
            self._push(tag, label, True, False, around)
        elif tag == "a":
            self.link = len(self.stack)

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.link = None
        if tag == "br":
            self.text.append(" ")
        if tag in ("html", "body") or not self.open.get(tag):
            if tag in BLOCKS:
                self._flush()
            return
        self._close({tag}, () if tag in SCOPE or tag in ("tr", "tbody", "thead", "tfoot") else SCOPE)

    def facts(self) -> list[tuple]:
        """The page's part of the tree: a row of kind 1 for each node (its children), of kind 0 for each text of a node."""
        found = [(node, parent, 1, _hash(*labels), chars, linked, named) for node, (parent, labels, chars, linked, named) in self.nodes.items()]
        return found + [(node, 0, 0, feature, 0, 0, False) for node, feature in self.texts]


def host(url: Column) -> Column:
    """A URL's host in small letters; null if it has none."""
    found = F.lower(F.regexp_extract(url, r"^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(found != "", found)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, page (a hash of the html), blocks and facts of each row; a page without a host is a site of its own."""
    kinds = (pa.int64(), pa.bool_(), pa.string()), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    names = ("node", "main", "text"), ("node", "parent", "kind", "feature", "chars", "linked", "named")

    def lists(rows: list[list[tuple]], k: int):
        flat = [x for row in rows for x in row]
        columns = list(zip(*flat, strict=True)) or [()] * len(names[k])
        ends = [0]
        for row in rows:
            ends.append(ends[-1] + len(row))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds[k], strict=True)], list(names[k])))

    def parse(batches):
        for batch in pieces(batches, "html", 4 << 20):
            found = [Page(x or "") for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host", "page")), lists([p.blocks for p in found], 0), lists([p.facts() for p in found], 1)], ["page_id", "url", "host", "page", "blocks", "facts"])

    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = F.xxhash64(text)
    rows = pages.select("page_id", "url", F.coalesce(host(F.col("url")), F.concat(F.lit("#"), page.cast("string"))).alias("host"), page.alias("page"), text.alias("html"))
    kind = PARSED.replace("page_id long", f"page_id {pages.schema['page_id'].dataType.simpleString()}")
    return written(rows.mapInArrow(parse, kind), "parsed")


def style_tree(rows: DataFrame) -> DataFrame:
    """host, node, pages, content, presentation and importance of the nodes of every host's tree, from parsed pages.

    A host's pages with equal html count once.  A text that n of a node's m pages have has the entropy ln n / ln m (it is as likely on each of them);
    a node's content is 1 less the mean of its texts' entropies, its presentation the entropy of its children's sequences, in units of ln m.
    Importance is the mean of both and of the parent's presentation, drawn to 1 by PRIOR pages, times the weight of what markup says.
    """
    once = rows.groupBy("host", "page").agg(F.first("facts").alias("facts"))
    fact = once.select("host", F.explode("facts").alias("f")).select("host", "f.*")
    seen = fact.groupBy("host", "node", "kind", "feature").agg(F.count(F.lit(1)).alias("n"), F.max("parent").alias("parent"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.max("named").alias("named"))
    style = F.col("kind") == 1
    nodes = seen.groupBy("host", "node").agg(
        F.sum(F.when(style, F.col("n")).otherwise(0)).alias("pages"),
        F.sum(F.when(style, F.col("n") * F.log("n")).otherwise(0.0)).alias("spread"),
        F.avg(F.when(~style, F.log("n"))).alias("repeated"),
        F.max(F.when(style, F.col("parent"))).alias("parent"),
        F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"),
        F.max("named").alias("named"),
    )
    whole = F.log(F.col("pages").cast("double"))
    nodes = nodes.withColumn("presentation", F.when(F.col("pages") > 1, 1 - F.col("spread") / F.col("pages") / whole).otherwise(1.0))
    nodes = written(nodes.withColumn("content", F.when(F.col("pages") > 1, 1 - F.col("repeated") / whole).otherwise(F.when(F.col("repeated").isNotNull(), 1.0))), "tree")
    above = nodes.select("host", F.col("node").alias("parent"), F.col("presentation").alias("around"))
    # only nodes that hold texts decide
    told = nodes.where(F.col("content").isNotNull()).join(above, ["host", "parent"], "left")
    mean = (F.col("content") + F.col("presentation") + F.coalesce("around", F.col("presentation"))) / 3
    drawn = (F.col("pages") * mean + PRIOR) / (F.col("pages") + PRIOR)
    weight = F.when(F.col("named") | (F.col("linked") >= LINKED * F.col("chars")), NAMED).otherwise(1.0)
    return told.select("host", "node", "pages", "content", "presentation", (drawn * weight).alias("importance"))


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url and text (blocks joined by two line feeds) of every row of pages (page_id, url, html).

    Where article or main elements hold at least half of what is left of a page, only they are kept.  A null or empty html has an empty
    text, a page whose URL is null or has no host is judged by its markup alone, repeated rows and null ids stay rows of their own,
    further columns are ignored, an empty table gives an empty result.  Whole pages are read, whatever their length.
    """
    ship(pages.sparkSession)
    rows = parsed(pages).withColumn("row", F.monotonically_increasing_id())
    low = written(style_tree(rows).where(F.col("importance") < threshold).select("host", "node"), "removed")
    if low.count() <= BROADCAST_NODES:
        gone = low.groupBy("host").agg(F.collect_list("node").alias("gone"))
        rows = rows.join(F.broadcast(gone), "host", "left")
    else:
        # each page asks for its own nodes; a host's pages are dealt to many tasks
        asked = rows.select("row", "host", F.explode(F.array_distinct("blocks.node")).alias("node")).withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
        low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(asked.join(low, ["host", "node", "salt"]).groupBy("row").agg(F.collect_list("node").alias("gone")), "row", "left")
    kept = F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~F.array_contains(F.col("gone"), b["node"])))
    rows = rows.select("page_id", "url", kept.alias("kept"))
    chars = lambda blocks: F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + F.length(b["text"]))
    rows = rows.withColumn("inside", F.filter("kept", lambda b: b["main"]))
    best = F.when(2 * chars(F.col("inside")) >= chars(F.col("kept")), F.col("inside")).otherwise(F.col("kept"))
    return rows.select("page_id", "url", F.array_join(best.getField("text"), "\n\n").alias("text"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page and its length."""
    return extract(dealt(table(spark, sf_dir, "pages"))).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op11_html_text": op11_html_text}
