"""Main text of HTML by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, the nearest most; a container's points are
discounted by the share of its text that is in links.  The best container is kept, with siblings that score or read
like it.  Parts that never are main text (navigation, forms, notices, comments, ...) are left out by their tags,
roles and the words of their classes and ids.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
NEXT = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "xmp", "noembed", "noframes", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LEFT_OUT = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "head", "datalist", "label", "option"}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | LEFT_OUT
#: A start tag here ends an open paragraph; those in SAME end an open element of their own group.
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "caption", "head", "label", "option", "button", "select"}
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = {"table", "td", "th", "button", "caption", "object"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
#: Words of classes and ids, cut at other characters and at capitals.
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navigation", "navbar", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget", "footer",
    "header", "masthead", "comment", "comments", "respond", "disqus", "reply", "replies", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
    "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "pagination", "pager", "toolbar", "search", "form", "hidden", "copyright", "disclaimer", "toc", "tags", "metadata",
}
#: Words that begin a class which tells of a page's layout, not of the part itself.
LAYOUT = {"has", "no", "with", "without"}
MAIN = {"article", "main"}
POSITIVE = {"article", "body", "content", "entry", "main", "post", "story", "text", "page"}
#: Parts that in an article hold its headline, which is kept without them.
HEADERS, HEADLINES = {"header", "masthead"}, {"h1", "h2", "h3"}
SPACES = re.compile(r"\s+")
LEAST_LENGTH = 25
#: Ancestors that a block passes points to; the next would get less than a hundredth of them.
LEVELS = 32


#: Groups of elements that end an open one of their own, by the tag that asks: (the group's tags, what bounds the search).
GROUPS = list(SAME.items())


class Node:
    __slots__ = ("tag", "words", "parent", "children", "out", "wraps", "heads", "holds", "score", "text", "linked", "block", "tops")

    def __init__(self, tag: str, words: set[str], parent: Node | None, out: bool) -> None:
        self.tag, self.words, self.parent, self.out = tag, words, parent, out
        self.children: list[Node | str] = []
        #: wraps: left out, but an article in it is not, as some pages are one form; heads: left out, but a headline in it
        #: is not; holds: a part that isn't left out is in it.
        self.wraps = self.heads = self.holds = False
        self.score, self.text, self.linked = 0.0, 0, 0
        #: The nearest block, itself or around it; and for each of GROUPS the outermost open element since its bound.
        self.block: Node | None = self if tag in BLOCKS else parent.block if parent else None
        above = parent.tops if parent else (None,) * len(GROUPS)
        if any(tag in own or tag in bound for _, (own, bound) in GROUPS):
            above = tuple(None if tag in bound else self if top is None and tag in own else top for top, (_, (own, bound)) in zip(above, GROUPS))
        self.tops: tuple[Node | None, ...] = above


class Open:
    """The open element and how many of each tag are open, in all and since the last cell, so that no search is in vain."""

    def __init__(self, root: Node) -> None:
        self.node, self.all, self.scopes = root, {}, [{}]

    def enter(self, child: Node) -> None:
        self.node = child
        if child.tag in SCOPE:
            self.scopes.append({})
        for counts in (self.all, self.scopes[-1]):
            counts[child.tag] = counts.get(child.tag, 0) + 1

    def leave(self, upto: Node) -> None:
        """Closes all elements within upto, which is around the open one."""
        while self.node is not upto:
            for counts in (self.all, self.scopes[-1]):
                counts[self.node.tag] -= 1
            if self.node.tag in SCOPE:
                self.scopes.pop()
            self.node = self.node.parent

    def end(self, tag: str) -> None:
        """An end tag: the nearest open element of the name is closed; one that isn't open, or an inline one across a cell's border, is not."""
        if not self.all.get(tag) or (tag not in BLOCKS | SCOPE and not self.scopes[-1].get(tag)):
            return
        up = self.node
        while up.tag != tag:
            up = up.parent
        if up.parent is not None:
            self.leave(up.parent)


def _words(attributes: str) -> tuple[set[str], bool]:
    """(words of class and id, whether the attributes mark a part to leave out)."""
    words: set[str] = set()
    out = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name in ("class", "id"):
            for name in value.split():
                cut = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]
                words |= set() if LAYOUT & set(cut[:1]) else set(cut)
        elif name == "role":
            out |= value.strip().lower() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out = True
    return words, out


def tokens(page: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, where it ends): text, cdata, other, or a tag, whose text is what stands between its brackets.

    A bracket in quotes doesn't end a tag, as long as the page's quotes end; after one that doesn't, quotes mean
    nothing.  So every character is looked at a bounded number of times.
    """
    at, n, last, quoted = 0, len(page), page.rfind(">"), True
    while at < n:
        begin = page.find("<", at)
        name = NAME.match(page, begin + 1) if begin >= 0 else None
        while begin >= 0 and not page.startswith(("<!", "<?"), begin) and (name is None or begin > last):
            begin = page.find("<", begin + 1) if begin < last else -1
            name = NAME.match(page, begin + 1) if begin >= 0 else None
        if begin < 0:
            yield "text", page[at:], n
            return
        if begin > at:
            yield "text", page[at:begin], begin
        for start, stop in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if page.startswith(start, begin):
                end = page.find(stop, begin + len(start))
                at = n if end < 0 else end + len(stop)
                yield ("cdata" if start[2] == "[" else "other"), page[begin + len(start) : n if end < 0 else end], at
                break
        else:
            if name is None:
                end = page.find(">", begin)
                at = n if end < 0 else end + 1
                yield "other", "", at
                continue
            end = begin + 1 + len(name[0])
            while quoted:
                m = NEXT.search(page, end)
                if not m or m[0] == ">":
                    quoted, end = m is not None, m.start() if m else n
                    break
                close = page.find(m[0], m.end())
                quoted, end = close >= 0, close + 1
            if not quoted:
                end = page.find(">", begin)
            at = end + 1
            yield "tag", page[begin + 1 : end], at


def parsed(page: str) -> Node:
    """A tree of the page; unclosed and misnested tags are mended as browsers do in the common cases.  Time is linear."""
    root = Node("html", set(), None, False)
    opened = Open(root)
    skip = 0
    for kind, text, at in tokens(page):
        node = opened.node
        if at <= skip:  # within an element whose content is no markup
            continue
        if kind == "text":
            node.children.append(text[-(at - skip) :] if at - len(text) < skip else text)
            continue
        if kind != "tag":
            if kind == "cdata":
                node.children.append(text.replace("&", "&amp;"))
            continue
        name = NAME.match(text)[0]
        tag, rest = name.lstrip("/").lower(), text[len(name) :]
        if name[0] == "/":
            if tag == "br":
                node.children.append(" ")
            elif tag not in ("html", "body"):
                opened.end(tag)
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            close = page.find(">", end.end()) if end else -1
            skip = close + 1 if close >= 0 else len(page)
            node.children.append(" ")
            continue
        if tag in VOID:
            node.children.append(Node("hr", set(), node, False) if tag == "hr" else " " if tag == "br" else "")
            continue
        if node.tag == "head":  # its end tag may be left out
            opened.leave(node.parent or node)
        if tag in ("html", "body"):
            continue
        if tag in ENDS_P:
            block = opened.node.block
            if block is not None and block.tag == "p" and block.parent is not None:
                opened.leave(block.parent)
        for k, (asks, _) in enumerate(GROUPS):
            if tag == asks and (top := opened.node.tops[k]) is not None and top.parent is not None:
                opened.leave(top.parent)
        node = opened.node
        words, marked = _words(rest) if rest.strip() else (set(), False)
        named = words & WORDS if tag not in MAIN else set()
        left_out = marked or tag in LEFT_OUT or bool(named)
        spared = node.out and ((node.wraps and tag in MAIN) or (node.heads and tag in HEADLINES))
        child = Node(tag, words, node, left_out or (node.out and not spared and tag != "main"))
        child.wraps = child.out and (node.wraps or not node.out) and not (left_out and tag != "form")
        in_article = node.tag in MAIN or node.block is not None and node.block.tag in MAIN or any("article" in w for w in node.words)
        child.heads = child.out and not marked and ((node.heads and not left_out) or (not node.out and in_article and (tag == "header" or bool(named)) and not named - HEADERS and tag in ("header", "div", "section", "hgroup")))
        if node.out and not child.out:
            up: Node | None = node
            while up is not None and up.out and not up.holds:
                up.holds, up = True, up.parent
        node.children.append(child)
        if not rest.endswith("/") or tag in BLOCKS:
            opened.enter(child)
    return root


def blocks(node: Node, whole: bool = False) -> list[tuple[str, Node, int]]:
    """(text, the block element that holds it, linked characters) of a part, in page order, without what is left out."""
    out: list[tuple[str, Node, int]] = []
    run: list[str] = []
    linked = [0]

    def flush(holder: Node) -> None:
        if run:
            text = SPACES.sub(" ", html.unescape("".join(run))).strip()
            if text:
                out.append((text, holder, min(linked[0], len(text))))
            run.clear()
            linked[0] = 0

    stack: list[tuple[Node, int, Node, bool]] = [(node, 0, node, False)]
    while stack:
        at, k, holder, link = stack.pop()
        if k == len(at.children):
            if at is holder:
                flush(at)
            continue
        stack.append((at, k + 1, holder, link))
        child = at.children[k]
        if isinstance(child, str):
            if at.out and not whole:
                continue
            run.append(child)
            if link:
                linked[0] += len(child)
        elif child.out and not child.holds and not whole:
            run.append(" ")
            if child.tag in BLOCKS:
                flush(holder)
        elif child.tag in BLOCKS:
            flush(holder)
            stack.append((child, 0, child, link))
        else:
            stack.append((child, 0, holder, link or child.tag == "a"))
    flush(node)
    return out


def _summed(root: Node, found: list[tuple[str, Node, int]]) -> list[Node]:
    """The nodes that hold any text, parents first, with their text's length, linked characters and score."""
    order, at = [root], 0
    while at < len(order):
        order += [x for x in order[at].children if isinstance(x, Node)]
        at += 1
    for text, holder, linked in found:
        holder.text += len(text)
        holder.linked += linked
        if len(text) < LEAST_LENGTH:
            continue
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(3, len(text) // 100)
        node, level = (holder.parent or holder) if holder.tag in LEAVES else holder, 0
        while node is not None and level < LEVELS:
            node.score += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            node, level = node.parent, level + 1
    for node in reversed(order):
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.linked += node.linked
    return [x for x in order if x.text]


#: Elements of a single paragraph, whose points go to what is around them.
LEAVES = {"p", "pre", "li", "td", "blockquote", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6"}


def main_blocks(page: str) -> list[str]:
    """The texts of the main part's blocks, in page order; none for a page without any."""
    root = parsed(page)
    found = blocks(root)
    if not found:
        return []
    final = {}
    nodes = _summed(root, found)
    for node in nodes:
        bonus = 25 if node.tag in MAIN else 5 if node.words & POSITIVE else 0
        final[node] = ((node.score + bonus) if node.score else bonus / 25) * (1 - node.linked / node.text)
    best = max(nodes, key=lambda x: (final[x], x.text))
    if best.parent is None:
        return [text for text, _, _ in found]
    least = max(2.0, 0.2 * (best.score if best.tag in MAIN else final[best]))
    kept = []
    for x in best.parent.children:
        if not isinstance(x, Node) or (x.out and not x.holds) or not x.text:
            continue
        light = x.linked / x.text < 0.25
        prose = x.tag in ("p", "blockquote", "pre", "h1", "h2", "h3") and light and (x.text > 80 or x.tag[0] == "h")
        if x is best or (x.tag in MAIN and final[x] > 0) or (final[x] >= least and light) or (prose and best.tag not in MAIN):
            kept.append(x)
    return [text for x in kept for text, _, _ in blocks(x)]


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row: its blocks joined by line breaks, and the text's code points.

    A null or empty page, or one without main text, has an empty text.  Nothing is cut for length.  Repeated rows
    give repeated results; other columns are not read; an empty table gives an empty result.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = ["\n".join(main_blocks(x)) if x else "" for x in part.column("html").to_pylist()]
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(kernel, "page_id long, url string, text string, n_chars long")
