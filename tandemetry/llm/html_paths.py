"""Main text of web pages by tag-path ratios.

A page is read once into text blocks.  Each block belongs to the path of block
tags, with their classes, from the root; paths are the nodes of a trie, so a
block costs the same at any depth.  Per path, text length outside links and
punctuation are aggregated over its blocks:

    ratio = (characters - link characters) / blocks * (1 + punctuation / blocks)

Markup names enter as one weight: a path through an element whose tag or class
speaks of a menu, header, footer, sidebar, notice, advert, form or of reader
comments, or one outside the article element that holds the densest path, counts
for less.  No name can drop the densest path: what is said on the way to it does
not count, for any path.  Weighted ratios are smoothed along the page, averaged
again per path, fused with the path's own ratio (geometric mean) and its share of
link text, and compared with the densest path.  Paths at CUT or above are content; so are those
with enough weight inside the element that holds a content path, or in the
article element, for headings and short blocks have low ratios of their own.

Defined results: a null or empty page, and one of links alone, has the empty text
and 0 characters.  A page without markup is one block.  Unclosed and stray tags
are tolerated as browsers do; an unclosed quote, comment or CDATA section ends
with the page.  Time is linear in the page, however deep or broken it is.  Nothing
is capped; repeated rows give repeated results, an empty table an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from math import exp, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemetry.llm.common import tidied

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*+(?:=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
PUNCTUATION = re.compile(r"[.,;:!?、。，！？]")
LETTERS = re.compile(r"[a-z]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

# Element names by their role in HTML, and words that name page furniture in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside audio blockquote body button canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main math menu nav "
    "noscript object ol optgroup option p pre section select summary svg table tbody td template tfoot th thead tr ul video".split()
)
FURNITURE = frozenset("aside audio button canvas dialog fieldset footer form math menu nav noscript object select svg template video".split())
SEMANTIC = frozenset("article main".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote pre figcaption summary tr tbody thead tfoot table ul ol dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("audio body button canvas head html math noscript object optgroup option select svg template video".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "option": ("option", ("select",))}
P_STOPS, P_ENDS = ("button", "table", "td", "th"), ("div", "article", "section", "td", "body")
WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toolbar topbar skip header masthead footer copyright colophon contentinfo sidebar complementary widget related recommended trending teaser "
    "notice notices notification notifications alert banner cookie cookies consent gdpr privacy popup modal overlay toast dialog ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion "
    "login signup search newsletter subscribe subscription comment comments disqus reply replies respond share sharing social".split()
)
#: Share of the densest path's fused ratio at which a path is content.
CUT = 0.25
#: Weight of a path through page furniture, or outside the article element: in the ratios, and in the choice of the densest path.
WEIGHT, DOUBT = 0.2, 0.3
#: Share of the densest path's text that a content path needs for its element to lend its weight to what else it holds.
HOLDS = 0.25
KERNEL = tuple(exp(-(d * d) / 2) for d in range(3))


class Block:
    __slots__ = ("links", "path", "text")

    def __init__(self, text: str, path: int, links: int):
        self.text, self.path, self.links = text, path, links


class Paths:
    """A trie of block tags with their classes.  A node's parent has a smaller number; node 0 is the root."""

    def __init__(self) -> None:
        self.parent, self.tag, self.furniture, self.article = [0], [""], [False], [0]
        self.container = [0]  # the element that a path's text stands in: above the tags that hold one piece of text each
        self.known: dict[tuple[int, str, bool], int] = {}

    def child(self, parent: int, tag: str, label: str, furniture: bool) -> int:
        key = (parent, label, furniture)
        node = self.known.get(key)
        if node is None:
            node = self.known[key] = len(self.tag)
            self.parent.append(parent)
            self.tag.append(tag)
            self.furniture.append(furniture)
            self.article.append(node if tag in SEMANTIC else self.article[parent])
            self.container.append(self.container[parent] if tag in LEAVES else node)
        return node

    def above(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(node)
            node = self.parent[node]
        return out


def _described(tag: str, attrs: str, inside: bool) -> tuple[str, bool]:
    """The label of an element, and whether its markup speaks of page furniture."""
    furniture = tag in FURNITURE or tag == "header" and not inside
    label = tag
    if attrs and tag not in ("html", "body"):
        for name, value in ATTRIBUTE.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                words = LETTERS.findall(value)
                furniture = furniture or tag not in HEADINGS and not WORDS.isdisjoint(words)
                if name == "class" and tag not in LEAVES:
                    label += "." + " ".join(words)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and UNSEEN.search(value):
                furniture = True
    return label, furniture


class _Reader:
    """One pass over a page's markup."""

    def __init__(self, page: str):
        self.page, self.paths, self.blocks = page, Paths(), []
        self.stack: list[tuple[str, int]] = []  # tag and path
        self.open: dict[str, list[int]] = defaultdict(list)  # places in the stack of each tag
        self.parts: list[str] = []
        self.linked = 0
        self.quotes, self.last = True, page.rfind(">")
        self.ends: dict[str, re.Pattern] = {}

    def at(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.at(), min(self.linked, len(text))))
            self.parts.clear()
        self.linked = 0

    def say(self, text: str) -> None:
        if text:
            if "&" in text:
                text = html.unescape(text)
            self.parts.append(text)
            if self.open["a"]:
                self.linked += len(" ".join(text.split()))

    def close(self, tag: str, stops: tuple[str, ...] = ()) -> bool:
        places = self.open[tag]
        if not places or any(self.open[s] and self.open[s][-1] > places[-1] for s in stops):
            return False
        k = places[-1]
        if any(t in BLOCK for t, _ in self.stack[k:]):
            self.flush()
        while len(self.stack) > k:
            self.open[self.stack.pop()[0]].pop()
        return True

    def tag_end(self, at: int) -> int:
        """Place after the `>` that ends a tag, -1 if none does; quotes hide it while they can be closed."""
        if at > self.last:
            return -1
        k = at
        while self.quotes:
            k = PLAIN.match(self.page, k).end()
            if k >= len(self.page):
                self.quotes = False  # this tag would swallow the page: from here on quotes hide nothing
                break
            if self.page[k] == ">":
                return k + 1
            end = self.page.find(self.page[k], k + 1)
            if end < 0:
                self.quotes = False
                break
            k = end + 1
        return self.page.index(">", at) + 1

    def read(self) -> tuple[list[Block], Paths]:
        page, at = self.page, 0
        while (lt := page.find("<", at)) >= 0:
            if m := NAME.match(page, lt):
                end = self.tag_end(m.end())
                if end < 0:
                    break
                self.say(page[at:lt])
                at = self.element(m[1].lower(), page[lt + 1] == "/", page[m.end() : end - 1], end)
            elif page.startswith("<!--", lt) or page.startswith("<![CDATA[", lt):
                self.say(page[at:lt])
                data = page[lt + 2] == "["
                end = page.find("]]>" if data else "-->", lt + 4)
                if data:
                    self.say(html.escape(page[lt + 9 : end if end >= 0 else len(page)]))
                at = end + 3 if end >= 0 else len(page)
            elif page[lt + 1 : lt + 2] in ("!", "?", "/") and page[lt + 1 :]:
                end = page.find(">", lt) if lt < self.last else -1
                if end < 0:
                    break
                self.say(page[at:lt])
                at = end + 1
            else:
                self.say(page[at : lt + 1])
                at = lt + 1
        self.say(page[at:])
        self.flush()
        return self.blocks, self.paths

    def element(self, tag: str, closing: bool, attrs: str, at: int) -> int:
        """Take one tag in; the place to go on from."""
        if closing:
            if tag == "p":
                if not self.close("p", P_ENDS):
                    self.flush()
            elif tag == "br":
                self.parts.append(" ")
            else:
                self.close(tag)
        elif tag in VOID:
            if tag == "hr":
                self.close("p", P_ENDS)
                self.flush()
            elif tag == "br":
                self.parts.append(" ")
        elif tag in RAW:
            if not attrs.rstrip().endswith("/"):
                end = self.ends.get(tag) or self.ends.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I))
                found = end.search(self.page, at)
                return found.end() if found else len(self.page)
        else:
            if tag in CLOSES_P:
                self.close("p", P_STOPS)
            if tag in SIBLINGS:
                tags, stops = SIBLINGS[tag]
                for t in tags.split():
                    self.close(t, stops)
            node = self.at()
            if tag in BLOCK:
                self.close("head")
                self.flush()
                label, furniture = _described(tag, attrs, bool(self.paths.article[node]))
                node = self.paths.child(node, tag, label, furniture)
            self.open[tag].append(len(self.stack))
            self.stack.append((tag, node))
        return at


def blocks(page: str) -> tuple[list[Block], Paths]:
    """Text blocks in page order, and the trie of their paths."""
    return _Reader(page).read()


def ratios(found: list[Block]) -> dict[int, tuple[float, float, float]]:
    """For each path: its ratio, its share of link text, and its characters outside links."""
    sums: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for b in found:
        s = sums[b.path]
        s[0] += len(b.text)
        s[1] += b.links
        s[2] += len(PUNCTUATION.findall(b.text))
        s[3] += 1
    return {p: ((chars - links) / n * (1 + punctuation / n), links / chars, chars - links) for p, (chars, links, punctuation, n) in sums.items()}


def smoothed(values: list[float]) -> list[float]:
    """Weighted means with the two neighbours on either side."""
    out = []
    for i in range(len(values)):
        near = range(max(0, i - 2), min(len(values), i + 3))
        out.append(sum(values[j] * KERNEL[abs(i - j)] for j in near) / sum(KERNEL[abs(i - j)] for j in near))
    return out


def content(found: list[Block], paths: Paths) -> list[Block]:
    """Blocks of the paths that are content."""
    measured = ratios(found)
    nodes = range(1, len(paths.tag))
    # the densest path: most text, doubted where markup speaks against it
    doubted = [False] * len(paths.tag)
    for node in nodes:
        doubted[node] = doubted[paths.parent[node]] or paths.furniture[node]
    semantic = any(paths.article[p] and not doubted[p] for p in measured)
    mass = {p: chars * (DOUBT if doubted[p] else 1.0) * (DOUBT if semantic and not paths.article[p] else 1.0) for p, (_, _, chars) in measured.items()}
    densest = max(mass, key=mass.__getitem__, default=None)
    if densest is None or not mass[densest]:
        return []
    spine = set(paths.above(densest)) | {0}
    article = paths.article[densest]
    outer = next((n for n in reversed(paths.above(densest)) if paths.tag[n] in SEMANTIC), 0)
    inside, within = [not article] * len(paths.tag), [not outer] * len(paths.tag)
    off = [False] * len(paths.tag)
    for node in nodes:
        up = paths.parent[node]
        off[node] = off[up] or paths.furniture[node] and node not in spine
        inside[node], within[node] = inside[up] or node == article, within[up] or node == outer
    weight = {p: WEIGHT if off[p] or not (within[p] if paths.tag[p] == "h1" else inside[p]) else 1.0 for p in measured}
    # ratios smoothed along the page and fused per path, as a share of the densest path's
    own = {p: ratio * weight[p] for p, (ratio, _, _) in measured.items()}
    along: dict[int, list[float]] = defaultdict(list)
    for b, v in zip(found, smoothed([own[b.path] for b in found]), strict=True):
        along[b.path].append(v)
    fused = {p: sqrt(own[p] * sum(v) / len(v)) for p, v in along.items()}
    best = fused[densest]
    score = {p: weight[p] * (1 - measured[p][1]) * min(1.0, fused[p] / best) for p in measured}
    chosen = {p for p in measured if p == densest or score[p] >= CUT}
    # what else stands in an element that holds content, by its weight and links alone
    holders = {paths.container[p] for p in chosen if measured[p][2] >= HOLDS * measured[densest][2]} | ({article} if article else set())
    held = [0 in holders] * len(paths.tag)
    for node in nodes:
        held[node] = held[paths.parent[node]] or node in holders
    title = not any(paths.tag[p] == "h1" and held[p] for p in measured)
    for p in measured:
        heads = title and paths.tag[p] == "h1" and (paths.parent[p] in spine or bool(outer) and within[p])
        if (held[p] or heads) and weight[p] * (1 - measured[p][1]) >= CUT:
            chosen.add(p)
    return [b for b in found if b.path in chosen]


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in content(*blocks(page or "")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def run(batches):
        for batch in batches:
            text = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(tidied(run), "page_id long, url string, text string, n_chars long")
