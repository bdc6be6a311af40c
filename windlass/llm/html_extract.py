"""Main text of web pages, with site template removal.

Element subtrees are hashed; a Spark aggregation counts on how many different
pages of its host each subtree stands, and subtrees that recur across many of
them are the site's template and are deleted.  What is left of the article
(or of the body, if there is none) without menus, headers, footers, sidebars,
notices, adverts, forms, scripts and reader comments is the main text.

Prose inside an article (paragraphs, headings, list items, quotes) is never a
template by itself: a sentence may well stand in many articles.  Boxes, lists,
tables and sections in an article are, if they recur in many different articles
and are at most half of each.  Copies of one page, or of one article, count as
one.
"""

from __future__ import annotations

import hashlib
import html
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, with_workers
from .url_filter import HOST

#: A subtree is a template if it stands on at least MIN_PAGES different pages
#: of the host and on this share of them, or on MANY_PAGES, however large the
#: host is.
MIN_PAGES, MIN_SHARE, MANY_PAGES = 5, 0.3, 30
#: So many template hashes are sent to every task; more are joined by page.
BROADCAST_TEMPLATES = 200_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)>"
                    r"|<[!?][^>]*(?:>|\Z)|<(?=[a-zA-Z/])[^<>]*\Z", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object",
        "canvas", "video", "audio", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
             "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
             "option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_DROP = set("head nav aside footer form button select fieldset menu dialog search option label input".split())
_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|sidebar|"
                    r"breadcrumbs?|footer|masthead|cookies?|consent|notice|notification|popup|modal|newsletter|"
                    r"subscribe|share|sharing|social|related|recommended|comments?|disqus|replies|respond|reactions|"
                    r"widget|toolbar|pagination|skip|login|signup|paywall)(?:$|[\s_-])", re.I)
_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "alert", "alertdialog",
          "dialog", "menu", "menubar", "toolbar"}
_ARTICLE = {"article", "main"}
_PROSE = set("p h1 h2 h3 h4 h5 h6 li dt dd tr td th blockquote pre caption figcaption summary".split())
# Start tags that end an open element of these kinds.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_SCOPE = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "nav", "aside", "td", "th"}


class Node:
    __slots__ = ("tag", "drop", "article", "start", "kids", "digest", "end", "inside")

    def __init__(self, tag, drop, article, start):
        self.tag, self.drop, self.article, self.start = tag, drop, article, start
        self.kids, self.digest, self.end = hashlib.blake2b(tag.encode(), digest_size=8), 0, start
        self.inside = None                 # the outermost article around it


def _attributes(raw: str) -> tuple[str, str, bool]:
    names, role = [], ""
    for m in _ATTR.finditer(raw):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            role = value.lower().strip()
        elif m[1].lower() in ("class", "id"):
            names.append(value)
    return " ".join(names), role, bool(re.search(r"\bhidden(?:\s|=|$)", raw))


class Page:
    """Blocks of a page, and its subtrees: ``blocks`` are (text, in article?,
    dropped?), ``nodes`` the subtrees that may be templates, with the blocks
    they span; what is dropped anyway is none."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, bool]] = []
        self.nodes: list[Node] = []
        self.stack: list[Node] = []
        self.text: list[str] = []
        last, n = 0, len(source)
        pos = 0
        while pos < n:
            m = _TOKEN.search(source, pos)
            if m is None:
                break
            if m.start() > last:
                self.text.append(source[last:m.start()])
            pos = last = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self.close(tag)
                continue
            if tag in _RAW and not m[3].endswith("/"):
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(source, pos)
                pos = last = end.end() if end else n
                continue
            self.open(tag, m[3])
        if last < n:
            self.text.append(source[last:])
        while self.stack:
            self.pop()
        self.flush()
        ends = [0, *itertools.accumulate(len(t) for t, _, _ in self.blocks)]
        size = lambda x: ends[x.end] - ends[x.start]
        self.nodes = [x for x in self.nodes if x.inside is None or 2 * size(x) <= size(x.inside)]

    def flush(self):
        if not self.text:
            return
        text = "".join(self.text)
        self.text = []
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if text:
            drop = any(x.drop for x in self.stack)
            self.blocks.append((text, any(x.article for x in self.stack), drop))
            if self.stack:
                self.stack[-1].kids.update(b"\0" + text.encode("utf-8", "surrogatepass"))

    def open(self, tag, raw):
        if tag in ("br", "wbr", "img", "input"):
            if tag == "br":
                self.text.append(" ")
            return
        if tag not in _BLOCK:
            if tag not in _DROP or tag in _VOID:
                return
        self.flush()
        if tag in _VOID:
            return
        if self.stack and self.stack[-1].tag == "p":
            self.pop()
        ends = _ENDS.get(tag)
        if ends:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].tag in ends:
                    while len(self.stack) > i:
                        self.pop()
                    break
                if self.stack[i].tag in _SCOPE and self.stack[i].tag not in ends:
                    break
        names, role, hidden = _attributes(raw) if raw else ("", "", False)
        article = tag in _ARTICLE or role in ("main", "article")
        inside = any(x.article for x in self.stack)
        drop = not article and tag not in ("html", "body") and (
            tag in _DROP or hidden or role in _ROLES or tag == "header" and not inside
            or bool(names) and tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and bool(_NAMES.search(names)))
        # An article inside the comments of another is a comment.
        node = Node(tag, drop, article and not any(x.drop for x in self.stack), len(self.blocks))
        node.kids.update(names.encode("utf-8", "surrogatepass"))
        self.stack.append(node)

    def close(self, tag):
        if tag not in _BLOCK and tag not in _DROP:
            return
        self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self.flush()
                    self.pop()
                return

    def pop(self):
        self.flush()
        node = self.stack.pop()
        node.end = len(self.blocks)
        raw = node.kids.digest()
        node.digest = int.from_bytes(raw, "little", signed=True)
        if self.stack:
            self.stack[-1].kids.update(raw)
        node.inside = next((x for x in self.stack if x.article), None)
        whole = node.tag in ("html", "body", "head") or node.article
        if node.end > node.start and not whole and not node.drop and not any(x.drop for x in self.stack) and not (
                node.inside is not None and node.tag in _PROSE):
            self.nodes.append(node)

    def main_text(self, templates=frozenset()) -> str:
        gone = [drop for _, _, drop in self.blocks]
        for node in self.nodes:
            if node.digest in templates:
                gone[node.start:node.end] = [True] * (node.end - node.start)
        article = any(a and not d for _, a, d in self.blocks)
        return "\n\n".join(text for (text, a, _), d in zip(self.blocks, gone) if not d and (a or not article))


def _subtrees(batches):
    """(host, page, unit, subtree) of every subtree that may be a template,
    once per page.  It is counted by its unit, the page or the article it
    stands in (a hash of either); subtree is null for the page itself."""
    for batch in batches:
        out = set()
        for host, page, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
            out.add((host, page, page, None))
            out.update((host, page, page if x.inside is None else x.inside.digest, x.digest) for x in Page(source).nodes)
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))],
                ["host", "page", "unit", "subtree"])


_NODES = "host string, page long, unit long, subtree long"


def templates(nodes: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
              many_pages: int = MANY_PAGES) -> DataFrame:
    """(host, subtree) of the template subtrees among ``nodes`` (host, page,
    unit, subtree).  Units are counted by host and subtree, map-side first, so
    a hot host is spread over its subtrees."""
    seen = (nodes.select("host", "unit", "subtree").distinct()
            .groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")))
    seen = materialise(seen.where(f"n >= {int(min_pages)} or subtree is null"), "subtrees")
    total = seen.where("subtree is null").select(F.col("host").alias("of"), F.col("n").alias("pages"))
    enough = F.least(F.lit(min_share) * F.col("pages"), F.lit(many_pages))
    often = seen.where(f"subtree is not null and n >= {int(min_pages)}")
    # Beyond MANY_PAGES the size of the host does not matter.
    return often.where(F.col("n") >= many_pages).select("host", "subtree").unionByName(
        often.where(F.col("n") < many_pages).join(total, F.col("host") == F.col("of"))
        .where(F.col("n") >= enough).select("host", "subtree"))


def _texts(known):
    """The text of each page without the templates ``known`` of its host, or
    those in a fourth column."""
    def f(batches):
        for batch in batches:
            sources = batch.column(2).to_pylist()
            of = ([known.value.get(h, ()) for h in batch.column(3).to_pylist()] if known is not None
                  else [frozenset(x or ()) for x in batch.column(3).to_pylist()])
            out = [Page(source).main_text(gone) for source, gone in zip(sources, of)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()),
                 pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])
    return f


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    A null or empty html gives an empty text; a null URL, or one without
    host, belongs to the host named by the empty string; repeated rows stay
    and count as one page, a null id stays null, no rows give none, other
    columns are ignored."""
    spark = with_workers(pages.sparkSession)
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                     F.coalesce(F.col(html_col), F.lit("")).alias("html"),
                     ascii_lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1)).alias("host"))
    p = p.withColumn("page", F.xxhash64("html"))
    nodes = p.select("host", "page", "html").mapInArrow(_subtrees, _NODES)
    known = materialise(templates(nodes, min_pages, min_share, many_pages), "templates")
    out = "page_id long, url string, text string, n_chars long"
    if known.count() <= BROADCAST_TEMPLATES:
        of: dict[str, set[int]] = {}
        for r in known.collect():
            of.setdefault(r.host, set()).add(r.subtree)
        return p.select("page_id", "url", "html", "host").mapInArrow(_texts(spark.sparkContext.broadcast(of)), out)
    # Each page's own templates: at most its subtrees.
    mine = (nodes.where("subtree is not null").select("host", "page", "subtree").distinct().join(known, ["host", "subtree"])
            .groupBy("host", "page").agg(F.collect_list("subtree").alias("subtrees")))
    return (p.join(materialise(mine, "page-templates"), ["host", "page"], "left")
            .select("page_id", "url", "html", "subtrees").mapInArrow(_texts(None), out))
