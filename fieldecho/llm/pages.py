"""Main text of web pages by consensus: pages of a host vote on the container that holds the article.

A page is read into a tree of elements and blocks of text. What is not the article by its tag,
role or class (menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments) is set aside. Every container is scored by the share of the remaining text it
holds outside links; the deepest one with most of it, lifted to its article element if it has one,
is the page's choice. Its path of generalised tags and classes gets the page's vote, weighted by
the text it holds. The votes are summed per host, and every page is extracted again with its
host's winning path; a page without that path keeps its own choice.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed
and joined by a line feed. A null page, or one without text, gives an empty text. Pages without a
host share the empty host. An empty table gives no rows; repeated rows come out alike; other
columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_batches

TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)
    | <(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^'">])*+)>
    | <(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)>
    | <[!?/][^>]*>
    | <[A-Za-z!?/][^>]*\Z""", re.DOTALL | re.VERBOSE)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
CLOSES_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "iframe", "noframes", "xmp")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text; any other is part of the block around it.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead
    title tr ul""".split())
#: Elements that a new one of their own kind (or group) closes.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl select".split())
#: End tags do not reach out of a cell, those of table parts not out of their table, inline ones not out of a block.
CELLS, TABLE = frozenset(("td", "th")), frozenset("table thead tbody tfoot tr td th html body".split())
FOREIGN = frozenset("svg path use g circle rect line polygon math".split())
NOT_CONTAINERS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd a pre figcaption tr summary caption".split())
ASIDE = frozenset("""head script style noscript template nav aside footer form button select textarea input iframe object embed svg canvas audio video
    dialog menu fieldset title noframes xmp map datalist""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
#: Words in class and id that mark what is not the article.
WORDS = frozenset("""nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement advertising adsense
    sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay toast alert comment comments commentlist disqus respond
    reply replies share sharing social related recommended recommendations newsletter subscribe subscription signup login widget pagination pager toolbar
    masthead skip hidden form search searchform copyright""".split())
#: Words that do so only outside the article: inside it they may mark its own title.
OUTSIDE = frozenset("header topbar masthead".split())
#: Names that say what a layout has or lacks, not what it is.
NEGATED = re.compile(r"(?:^|[-_])(?:with|has|no|without)(?:[-_]|$)")
#: Share of a page's text that a container must hold to be chosen.
MOST = 0.7
#: Winning paths are broadcast up to so many hosts and characters; beyond it they are joined by shuffle.
BROADCAST_HOSTS, BROADCAST_CHARS = 100_000, 32_000_000


class Node:
    """An element. ``path`` is a number that elements with the same tags and classes from the root on share."""
    __slots__ = ("tag", "label", "path", "parent", "block", "aside", "article", "text", "link", "depth")

    def __init__(self, tag: str, marks: list[str], parent: Node | None, aside: bool, known: dict[tuple[int, str], int]):
        self.tag, self.parent, self.aside, self.text, self.link = tag, parent, aside, 0, 0
        self.label = ".".join([tag, *sorted({re.sub(r"\d+", "#", m) for m in marks})])
        self.path = known.setdefault((parent.path if parent else -1, self.label), len(known))
        self.depth = parent.depth + 1 if parent else 0
        self.article = tag == "article" or tag == "main" or bool(parent and parent.article)
        self.block = self if tag in BLOCK or parent is None else parent.block


def full_path(node: Node | None) -> str:
    labels = []
    while node:
        labels.append(node.label)
        node = node.parent
    return "/".join(reversed(labels))


def _words(names: list[str]) -> set[str]:
    return {w.lower() for n in names for w in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", n) if w}


def _is_aside(tag: str, attrs: dict[str, str], names: list[str], inside: bool) -> bool:
    if tag in ASIDE or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.IGNORECASE):
        return True
    if tag in ("html", "body", "main"):
        return False
    words = _words([n for n in names if not NEGATED.search(n)])
    return bool(words & WORDS) or not inside and (tag == "header" or bool(words & OUTSIDE))


class _Open:
    """The open elements, and where those of each tag stand, so that no end tag searches the stack."""

    def __init__(self, root: Node):
        self.stack, self.of, self.block = [root], {}, []

    def push(self, node: Node) -> None:
        self.of.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.block.append(len(self.stack))
        self.stack.append(node)

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element with one of the tags, 0 for none."""
        return max((self.of[t][-1] for t in tags if self.of.get(t)), default=0)

    def last_block(self) -> int:
        return self.block[-1] if self.block else 0

    def cut(self, k: int) -> int:
        """Close everything from place k on; how many links were among it."""
        links = 0
        while len(self.stack) > k:
            tag = self.stack.pop().tag
            self.of[tag].pop()
            links += tag == "a"
        while self.block and self.block[-1] >= k:
            self.block.pop()
        return links


def blocks(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """All elements, parents before their children, and the page's blocks of text in order, each with the element it stands in.
    Set-aside elements give no text. The work grows with the page and not with how deep it is nested."""
    known: dict[tuple[int, str], int] = {}
    root = Node("#", [], None, False, known)
    nodes, out, parts = [root], [], []
    held = _Open(root)
    at, links = 0, 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                node = held.stack[-1].block
                out.append((node, text))
                node.text += len(text)
                node.link += min(sum(len(p) for p, is_link in parts if is_link), len(text))
            parts.clear()

    def close(tags: Iterable[str], stop: int) -> None:
        """Close the innermost element with one of the tags, unless it stands outside place ``stop``."""
        nonlocal links
        k = held.last(tags)
        if k and k >= stop:
            if held.last_block() >= k:
                flush()
            links -= held.cut(k)

    while at < len(page):
        m = TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not held.stack[-1].aside:
            parts.append((page[at:end], links > 0))
        if not m:
            break
        at = m.end()
        tag, rest = (m["tag"] or m["tag2"] or "").lower(), m["rest"] or m["rest2"] or ""
        if not tag:
            continue
        if m["end"] or m["end2"]:
            close((tag,), held.last(("table",)) if tag in TABLE else held.last(CELLS) if tag in BLOCK else held.last_block())
            continue
        if tag in BLOCK and tag not in ("option", "optgroup") and held.of.get("p"):
            close(("p",), held.last(("td", "th", "table", "button")))
        if tag in ENDS:
            close(ENDS[tag], held.last(SCOPE))
        if tag == "a":
            close(("a",), held.last_block())
        if tag in BLOCK:
            flush()
        if tag == "br":
            if not held.stack[-1].aside:
                parts.append((" ", False))
            continue
        if tag in VOID:
            continue
        attrs = {a[1].lower(): html.unescape(next((g for g in a.groups()[1:] if g is not None), "")) for a in ATTRIBUTE.finditer(rest)}
        names = [*attrs.get("class", "").split(), *attrs.get("id", "").split()]
        parent = held.stack[-1]
        node = Node(tag, attrs.get("class", "").split(), parent, parent.aside or _is_aside(tag, attrs, names, parent.article), known)
        if tag in CLOSES_RAW:
            raw = CLOSES_RAW[tag].search(page, at)
            at = raw.end() if raw else len(page)
            continue
        if rest.endswith("/") and tag in FOREIGN:
            continue
        nodes.append(node)
        held.push(node)
        links += tag == "a"
    flush()
    for node in reversed(nodes):  # what children hold, parents hold
        if node.parent:
            node.parent.text += node.text
            node.parent.link += node.link
    return nodes, out


def choice(nodes: list[Node]) -> Node | None:
    """The page's own container."""
    fit = [n for n in nodes if n.tag not in NOT_CONTAINERS and n.text]
    total = max((n.text - n.link for n in fit), default=0)
    own = [n for n in fit if n.text - n.link >= MOST * total and n.text > n.link] or [n for n in fit if n.parent is None]
    if not own:
        return None
    best = node = max(own, key=lambda n: n.depth)
    lifted = None
    while node:
        if node.tag == "article" or node.tag == "main" and lifted is None:
            lifted = node
        node = node.parent
    return lifted or best


def _inside(nodes: list[Node], path: int) -> set[int]:
    """The elements with the path, and all in them."""
    found: set[int] = set()
    for n in nodes:
        if n.path == path or n.parent and id(n.parent) in found:
            found.add(id(n))
    return found


def _number_of(nodes: list[Node], winner: str) -> int | None:
    """The number of a written path: elements whose own path begins it say how much of it they reach."""
    reach: dict[int, int] = {}
    for n in nodes:
        if n.parent is None:
            done = len(n.label) if winner.startswith(n.label) else None
        else:
            before = reach.get(id(n.parent))
            done = None if before is None or not winner.startswith("/" + n.label, before) else before + 1 + len(n.label)
        if done is not None:
            if done == len(winner):
                return n.path
            reach[id(n)] = done
    return None


def extract(page: str | None, winner: str | None) -> str:
    """Text of the winning container; the page's own choice if it has no such container."""
    nodes, found = blocks(page or "")
    path = _number_of(nodes, winner) if winner else None
    inside = _inside(nodes, path) if path is not None else set()
    kept = [t for n, t in found if id(n) in inside]
    if not kept and found:
        own = choice(nodes)
        if own:
            inside = _inside(nodes, own.path)
            kept = [t for n, t in found if id(n) in inside]
    return "\n".join(kept)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, weight, pages): summed votes. What a batch adds up per host and path is one row."""
    def cast(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            weight: Counter = Counter()
            n: Counter = Counter()
            for h, page in zip(part["host"], part["html"]):
                own = choice(blocks(page or "")[0])
                if own:
                    path = full_path(own)
                    weight[h, path] += own.text - own.link
                    n[h, path] += 1
            yield pd.DataFrame([(h, p, w, n[h, p]) for (h, p), w in weight.items()], columns=["host", "path", "weight", "pages"])

    cast_votes = pages.select(host(F.col("url")).alias("host"), "html").mapInPandas(cast, "host string, path string, weight long, pages long")
    return cast_votes.groupBy("host", "path").agg(F.sum("weight").alias("weight"), F.sum("pages").alias("pages"))


def winners(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the most weight; ties go to the path that sorts first."""
    best = F.min(F.struct((-F.col("weight")).alias("w"), "path"))
    return votes(pages).groupBy("host").agg(best.alias("b")).select("host", "b.path")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, path, text) of every page; ``path`` is the host's winning path."""
    text_batches(pages.sparkSession)
    won = stored(winners(pages), "paths-of-hosts").withColumnRenamed("host", "_host")
    n, chars = won.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("path") + F.length("_host")), F.lit(0))).first()
    if n <= BROADCAST_HOSTS and chars <= BROADCAST_CHARS:
        won = F.broadcast(won)

    @F.pandas_udf("string")
    def text_of(html_: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([extract(h, p) for h, p in zip(html_, path)])

    met = pages.select("page_id", "url", "html").join(won, host(F.col("url")) == F.col("_host"), "left")
    return met.select("page_id", "url", "path", text_of("html", "path").alias("text"))
