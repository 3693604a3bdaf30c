"""Operator 10: main text of HTML pages by a tree-structured graphical model.

A page's block elements form a tree; each node is content or not. A node's evidence (tag, class and id words, role,
link density, text size) gives its local potentials, an edge gives a potential of parent state, child state
and child tag. Sum-product messages pass upward and then downward and give each node's exact content marginal; the
text of nodes above one half is the page's main text. Both kinds of potentials are counted, with smoothing, on labelled
pages that this module writes from templates (article parts and furniture in many arrangements and vocabularies).

Script, style and similar elements, comments and markup never hold text. Character references are decoded; white space
inside a block, ``br`` included, is one space; blocks are trimmed and joined by one newline.

Defined cases: null, empty or broken html gives what text it holds (the empty string if none); unclosed elements
close with their parents or as the HTML rules for p, li, options and table parts say; pages are independent of each
other, so repeated rows give repeated rows; no part of a page is capped.
"""

from __future__ import annotations

import html as references
import math
import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import byte_column, record_batch, slices, tidy

#: HTML's own element lists (fixed values).
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
SILENT = {"script", "style", "head", "template", "noscript", "iframe", "object", "svg", "canvas", "audio", "video", "noembed", "noframes", "select", "datalist", "textarea", "title", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label", "input", "embed"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
#: What no element holds: comments, declarations, instructions and end tags without a name.
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>a-zA-Z][^>]*+>?|<![^>]*+>?|<\?[^>]*+>?", re.S)
#: Possessive throughout: a tag that doesn't end fails at once, after one look at what follows.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"\"[^\"]*+\"|'[^']*+'|([^\s\"'=/>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?")
WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "marks", "size", "linked", "kids", "silent", "label")

    def __init__(self, tag: str, parent: Node | None, marks: tuple, silent: bool, label: bool | None = None):
        self.tag, self.parent, self.marks, self.silent, self.label = tag, parent, marks, silent, label
        self.size = self.linked = self.kids = 0
        if parent:
            parent.kids += 1


def _marks(raw: str) -> tuple[tuple, bool]:
    """Words of class, id and role; whether the element is hidden."""
    found, hidden = [], False
    if raw and not raw.isspace():
        for name, value in ATTRIBUTE.findall(raw):
            name, value = name.lower(), value[:1] in ("'", '"') and value[1:-1].lower() or value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
            elif name in ("class", "id", "role"):
                found += WORD.findall(value)
    return tuple(found), hidden


class Broken:
    """The tags of a page that has an unclosed one, each found in a time that doesn't grow with what follows.

    A tag ends at the first ``>`` outside quotes. What that is for each quote and ``>`` follows from the next ones, so
    one pass from the page's end knows it for all.
    """

    NAME = re.compile(r"<(/?)([a-zA-Z])")
    NAME_END = re.compile(r"[\s/>]")

    def __init__(self, page: str):
        self.page, self.name = page, (0, 0)
        self.marks = [m.start() for m in re.finditer(r"[\"'>]", page)]
        self.ends = [-1] * (len(self.marks) + 1)
        following = {}
        for i in range(len(self.marks) - 1, -1, -1):
            c = page[self.marks[i]]
            if c == ">":
                self.ends[i] = self.marks[i]
            else:
                j = following.get(c)
                self.ends[i] = -1 if j is None else self.ends[j + 1]
                following[c] = i

    def tag(self, at: int) -> tuple[str, str, str, int] | None:
        m = self.NAME.match(self.page, at)
        if not m:
            return None
        if not self.name[0] <= m.end() <= self.name[1]:
            found = self.NAME_END.search(self.page, m.end())
            self.name = m.end(), found.start() if found else len(self.page)
        stop = self.name[1]
        end = self.ends[bisect_left(self.marks, stop)]
        return None if end < 0 else (m[1], self.page[m.start(2) : stop], self.page[stop:end], end + 1)


def markup(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start, end, "/" of an end tag, name and attributes of each piece of markup; comments and the like have no name."""
    at, broken = page.find("<"), None
    while at >= 0:
        if m := OTHER.match(page, at):
            found = "", "", "", m.end()
        elif broken:
            found = broken.tag(at)
        elif m := TAG.match(page, at):
            found = m[1], m[2], m[3], m.end()
        else:
            found = None
            if Broken.NAME.match(page, at):
                broken = Broken(page)
        if found:
            at_end = yield (at, found[3], *found[:3])
            at = page.find("<", max(found[3], at_end or 0))
        else:
            at = page.find("<", at + 1)


class Open:
    """The open elements, and where those of each tag are."""

    def __init__(self, root: Node):
        self.nodes, self.where = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.where[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, n: int) -> None:
        """Closes all but the first n."""
        while len(self.nodes) > n:
            self.where[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """Where the innermost of these tags is, 0 if none is open."""
        return max((self.where[t][-1] for t in tags if self.where[t]), default=0)


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Block nodes, parents first, and the text runs (blocks) in page order."""
    root = Node("html", None, (), False)
    nodes, blocks, open_ = [root], [], Open(root)
    stack = open_.nodes
    inline: dict[str, list[bool]] = defaultdict(list)  # open inline elements by tag: whether each is silent
    links = mute = 0
    run: list[str] = []

    def flush():
        if run:
            text = " ".join("".join(run).split())
            if text:
                blocks.append((stack[-1], text))
            run.clear()

    def text(piece: str):
        if piece and not mute and not stack[-1].silent:
            run.append(references.unescape(piece) if "&" in piece else piece)
            n = len(piece.strip())
            stack[-1].size += n
            if links:
                stack[-1].linked += n

    at, end = 0, len(page)
    pieces = markup(page)
    piece = next(pieces, None)
    while piece:
        start, stop, ending, tag, raw = piece
        text(page[at:start])
        at, skip = stop, None
        tag = tag.lower()
        if not tag:
            pass
        elif ending:
            if tag in INLINE:
                if inline[tag]:
                    mute -= inline[tag].pop()
                    links -= tag == "a"
            elif open_.where[tag]:
                flush()
                open_.cut(open_.where[tag][-1])
                inline.clear()
                links = mute = 0
        elif tag == "br":
            text(" ")
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif tag in INLINE:
            if not raw.rstrip().endswith("/") or tag == "a":
                _, hidden = _marks(raw)
                inline[tag].append(hidden)
                mute += hidden
                links += tag == "a"
        elif tag in ("html", "body"):
            flush()
            if tag == "body":
                while stack[-1].tag == "head":
                    open_.cut(len(stack) - 1)
        else:
            flush()
            if tag not in CLOSES:  # a block ends an open paragraph
                if stack[-1].tag == "p":
                    open_.cut(len(stack) - 1)
            else:
                before = open_.last(CLOSES[tag])
                if before > open_.last(SCOPE[tag]):
                    open_.cut(before)
            if links or mute or inline:  # inline elements end with their block, so a lost end tag reaches no further
                links = mute = 0
                inline.clear()
            marks, hidden = _marks(raw)
            node = Node(tag, stack[-1], marks, stack[-1].silent or hidden or tag in SILENT)
            nodes.append(node)
            open_.push(node)
            if tag in RAW:
                found = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = skip = found.start() if found else end
            if raw.rstrip().endswith("/") and tag not in ("p", "div", "li"):
                open_.cut(len(stack) - 1)
        try:
            piece = pieces.send(skip)
        except StopIteration:
            piece = None
    text(page[at:])
    flush()
    return nodes, blocks


def evidence(node: Node) -> list[str]:
    out = [f"tag {node.tag}"]
    out += [f"mark {w}" for w in node.marks]
    if node.size:
        share = node.linked / node.size
        out.append("links " + ("most" if share > 0.6 else "some" if share > 0.2 else "few"))
        out.append("text " + ("long" if node.size > 200 else "middle" if node.size > 60 else "short"))
    return out


class Model:
    """Counted potentials: log P(evidence | state) against the other state, log P(state | parent state, tag)."""

    def __init__(self, pages: list[str]):
        seen: dict[str, Counter] = defaultdict(Counter)
        edges: dict[tuple, Counter] = defaultdict(Counter)
        for page in pages:
            nodes, _ = parse(page)
            for node in nodes:
                node.label = node.parent.label if node.parent and node.parent.label is not None else None
                if "labelcontent" in node.marks or "labelother" in node.marks:
                    node.label = "labelcontent" in node.marks
            for node in nodes:
                state = bool(node.label)
                for e in set(evidence(node)):
                    if not e.startswith("mark label"):
                        seen[e][state] += 1
                if node.parent:
                    edges[bool(node.parent.label), node.tag][state] += 1
                    edges[bool(node.parent.label), ""][state] += 1
        total = Counter()
        for e, n in seen.items():
            if e.startswith("tag "):
                total.update(n)
        self.local = {e: self._odds(n, total, 0.25 if e.startswith("text") or e.startswith("links") else 1.0) for e, n in seen.items()}
        self.edges = {}
        for key, n in edges.items():
            p = (n[True] + 0.5) / (n[True] + n[False] + 1)
            self.edges[key] = (1 - p, p)

    @staticmethod
    def _odds(n: Counter, total: Counter, weight: float) -> float:
        return weight * (math.log((n[True] + 0.5) / (total[True] + 1)) - math.log((n[False] + 0.5) / (total[False] + 1)))

    def edge(self, parent: bool, tag: str) -> tuple[float, float]:
        return self.edges.get((parent, tag)) or self.edges.get((parent, "")) or (0.5, 0.5)

    def marginals(self, nodes: list[Node]) -> dict[int, float]:
        """P(content) of each node by one upward and one downward pass."""
        local, up, product = {}, {}, {}
        for node in nodes:
            odds = max(-30.0, min(30.0, sum(self.local.get(e, 0.0) for e in evidence(node))))
            p = 1 / (1 + math.exp(-odds))
            local[id(node)] = product[id(node)] = (1 - p, p)
        root = nodes[0]
        for node in reversed(nodes):  # children come after their parents
            if node is root:
                continue
            no, yes = product[id(node)]
            e0, e1 = self.edge(False, node.tag), self.edge(True, node.tag)
            message = (e0[0] * no + e0[1] * yes, e1[0] * no + e1[1] * yes)
            up[id(node)] = message
            a, b = product[id(node.parent)]
            a, b = a * message[0], b * message[1]
            product[id(node.parent)] = (a / (a + b), b / (a + b))
        prior = (0.9, 0.1)
        belief = {}
        for node in nodes:
            if node is root:
                a, b = product[id(root)][0] * prior[0], product[id(root)][1] * prior[1]
            else:
                p0, p1 = belief[id(node.parent)]
                u0, u1 = up[id(node)]
                p0, p1 = p0 / max(u0, 1e-300), p1 / max(u1, 1e-300)  # the parent's belief without this child
                e0, e1 = self.edge(False, node.tag), self.edge(True, node.tag)
                no, yes = product[id(node)]
                a, b = no * (p0 * e0[0] + p1 * e1[0]), yes * (p0 * e0[1] + p1 * e1[1])
            belief[id(node)] = (a / (a + b), b / (a + b)) if a + b > 0 else (0.5, 0.5)
        return {k: v[1] for k, v in belief.items()}

    def extract(self, page: str) -> str:
        nodes, blocks = parse(page)
        if not blocks:
            return ""
        content = self.marginals(nodes)
        return "\n".join(text for node, text in blocks if content[id(node)] > 0.5)


@cache
def labelled_pages(n: int = 240, seed: int = 7) -> tuple[str, ...]:
    """Pages from templates; class words labelcontent and labelother mark what is what and are no evidence."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'

    def element(tag: str, label: str, marks: list[str], inner: str) -> str:
        return f'<{tag} class="label{label} {r.choice([*marks, ""]) if marks else ""}">{inner}</{tag}>'

    def furniture() -> str:
        menu = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8))) + "</ul>"
        kind = r.randrange(10)
        if kind == 0:
            return element(r.choice(["nav", "nav", "div"]), "other", [], menu()) if r.random() < 0.7 else element("div", "other", ["menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc"], menu())
        if kind == 1:
            return element("header", "other", ["header", "top", "masthead", "banner"], f"<h1>{words(1, 4)}</h1>" * r.randint(0, 1) + menu() * r.randint(0, 1) + f"<p>{words(2, 9)}</p>" * r.randint(0, 1))
        if kind == 2:
            return element("footer", "other", ["footer", "bottom", "copyright"], f"<p>&copy; {words(2, 12)}</p>" if r.random() < 0.5 else f"&copy; {words(2, 14)}")
        if kind == 3:
            return element("aside", "other", ["sidebar", "related", "widget", "side"], f"<h3>{words(1, 3)}</h3>{menu()}" + f"<p>{words(4, 40)}</p>" * r.randint(0, 2))
        if kind == 4:
            return f'<div class="labelother {r.choice(["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner"])}">' + (words(3, 25) if r.random() < 0.6 else f"<p>{words(4, 30)}</p>") + "</div>"
        if kind == 5:
            return f'<{(t := r.choice(["div", "section", "div"]))} class="labelother {r.choice(["cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "gdpr", "message"])}">' + (f"<p>{words(5, 30)}</p>" if r.random() < 0.7 else words(5, 30)) + f"<button>{words(1, 2)}</button></{t}>"
        if kind == 6:
            return element("form", "other", ["search", "login", "newsletter", "signup", "subscribe"], f"<label>{words(1, 3)}</label><input><p>{words(2, 9)}</p><button>{words(1, 2)}</button>")
        if kind == 7:
            one = lambda: f'<{r.choice(["li", "div"])} class="{r.choice(["comment", "reply", ""])}"><p>{words(4, 60)}</p>'
            t = r.choice(["section", "div", "ol"])
            return f'<{t} class="labelother {r.choice(["comments", "comment", "discussion", "replies", "responses", "disqus", "commentlist"])}"><h3>{words(1, 3)}</h3>' + "".join(one() for _ in range(r.randint(1, 5))) + f"</{t}>"
        if kind == 8:
            return f'<div class="labelother {r.choice(["share", "social", "sharing", "related", "recommended", "pagination", "tags", "meta", "sidebar", "widget", "footer", "header", "newsletter", "subscribe", "promo"])}">' + (menu() if r.random() < 0.5 else f"<p>{words(2, 12)}</p>") + "</div>"
        return f'<div class="labelother">{menu()}</div>'

    def article() -> str:
        def part() -> str:
            k = r.randrange(12)
            if k == 0:
                return f"<h{(h := r.randint(2, 4))}>{words(2, 7)}</h{h}>"
            if k == 1:
                t = r.choice(["ul", "ol"])
                return f"<{t}>" + "".join(f"<li>{words(2, 20)}</li>" for _ in range(r.randint(2, 5))) + f"</{t}>"
            if k == 2:
                return f"<blockquote>{words(5, 40)}</blockquote>" if r.random() < 0.5 else f"<blockquote><p>{words(5, 40)}</p></blockquote>"
            if k == 3:
                return f"<pre>{words(3, 20)}</pre>"
            if k == 4:
                return "<table>" + "".join("<tr>" + "".join(f"<{c}>{words(1, 3)}</{c}>" for c in (r.choice(["td", "th"]),) * 2) + "</tr>" for _ in range(3)) + "</table>"
            if k == 5:
                return f"<figure><figcaption>{words(3, 12)}</figcaption></figure>"
            if k == 6:
                return f"<div>{words(10, 80)}</div>"
            if k == 7:
                return f"<section><h2>{words(1, 5)}</h2><p>{words(10, 60)}</p></section>"
            if k == 8:
                return f"<dl><dt>{words(1, 2)}</dt><dd>{words(3, 12)}</dd></dl>"
            return f"<p>{words(1, 90)}{' ' + link() if r.random() < 0.3 else ''}</p>"

        parts = [f"<h1>{words(2, 9)}</h1>"] * (r.random() < 0.8) + [part() for _ in range(r.randint(1, 9))]
        if r.random() < 0.45:
            parts.insert(r.randint(1, len(parts)), furniture())
        inner = "".join(parts)
        if r.random() < 0.6:
            inner = element("article", "content", ["post", "article", "entry", "story"], inner)
            return f"<main>{inner}</main>".replace("<main>", '<main class="labelcontent">') if r.random() < 0.3 else inner
        if r.random() < 0.4:
            return element("main", "content", ["content", "main"], inner)
        return f'<div class="labelcontent {r.choice(["content", "article", "post", "entry", "main", "body", "story", "text"])}">{inner}</div>'

    pages = []
    for _ in range(n):
        rest = [furniture() for _ in range(r.randint(1, 7))]
        rest.insert(r.randint(0, len(rest)), article())
        pages.append(f"<html><head><title>{words(2, 6)}</title></head><body>{''.join(rest)}</body></html>")
    return tuple(pages)


@cache
def model() -> Model:
    return Model(list(labelled_pages()))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        fitted = model()
        for batch in slices(batches, "html", 1 << 22):
            texts = [fitted.extract(x.decode("utf-8", "replace")) for x in byte_column(batch, "html")]
            yield record_batch(out, [batch.column("page_id"), batch.column("url"), texts, [len(x) for x in texts]])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
