"""Main text of web pages by tag-path ratios.

A page becomes a run of text nodes, each with its root-to-leaf path of tags. Three ratios are taken per path: all its
text that isn't linked (in characters, over the page's greatest), punctuation marks to a node, and unlinked text to all
text. They are fused by multiplication, smoothed along the page with a Gaussian window, and averaged per path. The paths
that reach a share of the page's highest are content, and every node of theirs is output. Landmark tags, class names, ids
and roles are a prior: they multiply the ratios of the paths they stand over and so decide only where these are close.

Ratios can't see short blocks of the article, so the selected text then places the article: its article or main
elements, or else the smallest element that holds nearly all of it. Inside, unmarked blocks are output too, and blocks
under words that can mean either if they are headings or read like sentences. A heading such as "Comments" marks what
follows it in its element. Where no such element marks the article, unmarked paragraphs of sentences that stand directly
in an element around it are output as well: its lead, for instance.

Every page is a row of its own, so pages are read where they lie and nothing is shuffled. A page is read in time
proportional to its length, however deep its elements nest.

Defined results: null or empty html, or html without any text of content, gives an empty text and n_chars 0; html
without tags is one block; pages of any length are read whole; of paths with the same ratio all or none are selected;
repeated rows give repeated results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id bigint, url string, text string, n_chars bigint"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style title noscript template iframe textarea select option button svg math canvas audio video object datalist dialog".split())
LANDMARK = frozenset("nav header footer aside form".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose start ends an open element of these tags, unless an element of the bounds was opened after it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
    "article": (LANDMARK, set()), "main": (LANDMARK, set()), "footer": (LANDMARK, {"article", "main"}),
}
PARAGRAPH = ({"p"}, {"article", "main", "section", "div", "body", "table", "td", "th", "blockquote", "li", "form", "ul", "ol", "dl"})
#: Blocks that are output inside the article even if their path's ratio is low.
CONTENT = frozenset("article main p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption blockquote pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE_TAGS = ("article", "main")
#: Words of class names, ids and roles that name what is not the article, and words that can mean either.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo navbar navigation breadcrumb breadcrumbs sidebar masthead cookie cookies consent gdpr popup modal newsletter subscribe comments disqus pagination pager contentinfo".split()
)
MAYBE_WORDS = frozenset("promotion banner nav menu aside header footer notice alert overlay subscription signup login comment respond responses related recommended share sharing social widget toolbar search complementary dialog".split())
#: Words of names that say nothing about what they name.
PLAIN_WORDS = frozenset("section area list box container wrapper block item items inner outer content main top bottom left right page site post entry article text id the a my new".split())
#: What a ratio is multiplied by under landmark tags and such words.
OUTSIDE, NOISE, MAYBE = 0.02, 0.1, 0.5
#: The share of the page's highest ratio that selects a path, and the weight of the smoothed ratios.
SHARE, SMOOTHED = 0.4, 0.3
#: A page whose highest ratio, times its marks, is below this share of the highest without them has no content at all.
FLOOR = 0.1
#: Words that make a block under a doubtful mark read like a sentence.
SENTENCE_WORDS = 8

_open_tag = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_stop = re.compile(r"""[>"']""")
_attribute = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_name_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall
_marks = re.compile(r"[.,;:!?…。，！？、；：]").findall
_comments = re.compile(r"(?:\d+\s+)?(?:reader |user |leave (?:a|your) |add (?:a|your) |post (?:a|your) )?(?:comments?|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d+\)?)?\s*:?|(?:what|from) (?:our |the |your )?readers?(?: say| think| write| wrote)?\s*:?|reader reactions?", re.I).fullmatch
_responses = re.compile(r"(?:\d+\s+)?(?:responses|reply|replies)(?:\s*\(?\d+\)?)?\s*:?", re.I).fullmatch
_by_reader = re.compile(r"(?:posted|written|commented|comment) by (?:a |an )?(?:reader|user|guest|visitor|member|anonymous)\b", re.I).match


class Node(NamedTuple):
    """A run of text: the number of its path, its innermost element, its block, that block's tag, how much of its ratio
    its marks leave, and whether it is a link."""

    path: int
    element: int
    block: int
    tag: str
    worth: float
    linked: bool
    text: str


class Element(NamedTuple):
    """An element and the number of the one around it, -1 for none; elements are numbered as they open."""

    tag: str
    parent: int


def _worth(attributes: str) -> float:
    """What the attributes of an element leave of the ratios inside it; 0 hides it."""
    worth = 1.0
    for name, a, b, c in _attribute.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return 0.0
        if name in ("class", "id", "role"):
            worth = min([worth, *(_name_worth(x) for x in value.split())])
    return worth


def _name_worth(name: str) -> float:
    """What one name leaves: a word of noise counts in full where the name has little more to say, and else as doubtful."""
    words = [w.lower() for w in _name_words(name)]
    noise = sum(w in NOISE_WORDS for w in words)
    if noise and 2 * noise >= sum(w not in PLAIN_WORDS for w in words):
        return NOISE
    return MAYBE if noise or not MAYBE_WORDS.isdisjoint(words) else 1.0


class _Tags:
    """The tags of a page, in order: (start, end, closes, name, attributes); comments and declarations have no name.

    A tag ends at the first > outside quotes, or, where there is none, at the first one. A search for it that reaches the
    page's end is remembered by its quoted stretches: a later tag that lies outside these would end as it did, so there are
    no more such searches than ways to be inside quotes."""

    def __init__(self, page: str):
        self.page = page
        self.lost: list[tuple[int, list[int], list[int]]] = []

    def _end(self, start: int) -> int:
        """Where the attributes from start on end; -1 without any >."""
        page = self.page
        first = page.find(">", start)
        if first < 0:
            return -1
        for since, opens, closes in self.lost:
            k = bisect_right(opens, start) - 1
            if start >= since and (k < 0 or closes[k] < start):
                return first
        opens, closes, at = [], [], start
        while m := _stop.search(page, at):
            if m[0] == ">":
                return m.start()
            close = page.find(m[0], m.end())
            if close < 0:
                break
            opens.append(m.start())
            closes.append(close)
            at = close + 1
        self.lost.append((start, opens, closes))
        return first

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        page, at = self.page, 0
        while m := _open_tag.search(page, at):
            start = m.start()
            if m[2]:
                end = self._end(m.end())
                if end < 0:
                    return
                self.at = end + 1
                yield start, self.at, bool(m[1]), m[2].lower(), page[m.end() : end]
            else:
                close = page.find("-->", m.end()) if m[0] == "<!--" else page.find(">", m.end())
                self.at = len(page) if close < 0 else close + (3 if m[0] == "<!--" else 1)
                yield start, self.at, False, "", ""
            at = self.at  # the reader may have moved it


class _Open:
    """An open element. ends: for each kind of implied end, the place on the stack of the element that it would end."""

    __slots__ = ("tag", "element", "path", "block_tag", "worth", "seen", "linked", "ends")

    def __init__(self, tag, element, path, block_tag, worth, seen, linked, ends):
        self.tag, self.element, self.path, self.block_tag = tag, element, path, block_tag
        self.worth, self.seen, self.linked, self.ends = worth, seen, linked, ends


_KINDS = {**ENDS, "": PARAGRAPH}
_TURNS = {tag: [kind for kind, (names, bounds) in _KINDS.items() if tag in names or tag in bounds] for tag in {t for names, bounds in _KINDS.values() for t in {*names, *bounds}}}


def nodes_of(page: str) -> tuple[list[Node], list[Element]]:
    """The text nodes of a page and its elements."""
    root = _Open("", -1, 0, "", 1.0, True, False, {})
    stack = [root]
    count: dict[str, int] = {}
    elements: list[Element] = []
    nodes: list[Node] = []
    paths: dict[tuple[int, str], int] = {}
    block = at = 0
    low = None

    def text(s: str) -> None:
        top = stack[-1]
        if not s or not top.seen or not top.worth:
            return
        s = entities.unescape(s)
        plain = s.strip()
        if plain and (_by_reader(plain) or (len(plain) < 60 and (_comments(plain) or _responses(plain)))):
            around = stack[-2] if len(stack) > 1 and (stack[-2].tag not in ARTICLE_TAGS or not _by_reader(plain)) else top
            worth = MAYBE if _responses(plain) else NOISE
            around.worth, top.worth = min(around.worth, worth), min(top.worth, worth)
        nodes.append(Node(top.path, top.element, block, top.block_tag, top.worth, top.linked, s))

    def cut(size: int) -> None:
        for o in stack[size:]:
            count[o.tag] -= 1
        del stack[size:]

    def end(kind: str) -> None:
        if found := stack[-1].ends.get(kind, 0):
            cut(found)

    tags = _Tags(page)
    for start, end_of_tag, closes, name, attributes in tags:
        text(page[at:start])
        at = end_of_tag
        if not name:
            continue
        if name not in INLINE:
            block += 1
        if closes:
            if count.get(name):
                size = len(stack) - 1
                while stack[size].tag != name:
                    size -= 1
                cut(size)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name not in INLINE:
            end("")
        if name in ENDS:
            end(name)
        around = stack[-1]
        element = len(elements)
        elements.append(Element(name, around.element))
        if name in RAW:
            low = page.lower() if low is None and len(page) == len(page.lower()) else low
            close = (low or page).find(f"</{name}", at)
            tags.at = len(page) if close < 0 else close
            if name in UNSEEN:
                close = page.find(">", tags.at)
                at = tags.at = len(page) if close < 0 else close + 1
                continue
        worth = OUTSIDE if name in LANDMARK else 1.0 if name in ("html", "body", *ARTICLE_TAGS) else _worth(attributes) if attributes else 1.0
        inline = name in INLINE
        path = around.path if inline and worth == 1.0 else paths.setdefault((around.path, f"{name}*{worth}"), len(paths) + 1)
        ends = around.ends
        if turns := _TURNS.get(name):
            ends = ends | {kind: len(stack) if name in _KINDS[kind][0] else 0 for kind in turns}
        stack.append(_Open(name, element, path, around.block_tag if inline else name, min(worth, around.worth), around.seen and name not in UNSEEN, around.linked or name == "a", ends))
        count[name] = count.get(name, 0) + 1
    text(page[at:])
    return nodes, elements


def _smooth(x: np.ndarray, width: int = 2) -> np.ndarray:
    kernel = np.exp(-(np.arange(-width, width + 1) ** 2) / 2.0)
    return np.convolve(x, kernel, "same") / np.convolve(np.ones(len(x)), kernel, "same") if len(x) > width else x


def ratios(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Each node's path, and each path's fused and smoothed ratio, without marks."""
    _, path = np.unique([(n.path, n.worth) for n in nodes], axis=0, return_inverse=True)
    path = path.ravel()
    count = np.bincount(path)
    per_path = lambda x: np.bincount(path, np.array(x, float))
    bare = per_path([0 if n.linked else len(n.text.strip()) for n in nodes])
    every = per_path([len(n.text.strip()) for n in nodes])
    marks = per_path([0 if n.linked else len(_marks(n.text)) for n in nodes])
    fused = (bare / max(bare.max(), 1.0) * np.sqrt(1.0 + marks / count) * bare / np.maximum(every, 1))[path]
    if len(nodes) >= 5:
        fused = fused ** (1 - SMOOTHED) * _smooth(fused) ** SMOOTHED
    return path, np.bincount(path, fused) / count


def selected(nodes: list[Node]) -> np.ndarray:
    """Which nodes have a path whose ratio, times what its marks leave, reaches the share of the highest."""
    path, ratio = ratios(nodes)
    worth = np.empty(len(ratio))
    worth[path] = [n.worth for n in nodes]
    held = ratio * worth
    return (held >= SHARE * max(held.max(), FLOOR * ratio.max()))[path] & ((held > 0) | (ratio.max() == 0))[path]


def _sentences(text: str) -> bool:
    return len(text.split()) >= SENTENCE_WORDS and _marks(text) != []


def main_text(page: str | None) -> str:
    nodes, elements = nodes_of(page or "")
    solid = [n for n in nodes if n.text.strip()]
    if not solid:
        return ""
    chosen = [n for n, on in zip(solid, selected(solid), strict=True) if on]
    if not chosen:
        return ""
    held = [0] * (len(elements) + 1)  # the last is for what stands in no element
    for n in chosen:
        held[n.element] += len(n.text)
    for k in range(len(elements) - 1, -1, -1):
        held[elements[k].parent] += held[k]
    total = held[-1]
    inside = {tag: [False] * (len(elements) + 1) for tag in ARTICLE_TAGS}
    for k, e in enumerate(elements):
        for tag, marked in inside.items():
            marked[k] = marked[e.parent] or e.tag == tag
    scope = next((marked for marked in inside.values() if 2 * sum(len(n.text) for n in chosen if marked[n.element]) >= total), None)
    around: set[int] = set()  # elements that the scope lies in
    if scope is None:
        top = max((k for k in range(len(elements)) if held[k] >= 0.9 * total), default=-1)
        scope = [False] * len(elements) + [top < 0]
        for k, e in enumerate(elements):
            scope[k] = k == top or scope[e.parent]
        while top >= 0:
            top = elements[top].parent
            around.add(top)
    paths = {(n.path, n.worth) for n in chosen}
    named = any(e.tag in ARTICLE_TAGS and scope[k] for k, e in enumerate(elements))
    whole: dict[int, list[Node]] = {}
    for n in nodes:
        whole.setdefault(n.block, []).append(n)
    out: list[str] = []
    for block in whole.values():
        bare = "".join(n.text for n in block if not n.linked)
        fits = {0: False}  # by what a node's marks leave
        kept = []
        for n in block:
            if (n.path, n.worth) in paths:
                kept.append(n.text)
            elif scope[n.element] and n.worth not in fits:
                content = n.tag in CONTENT
                if n.worth == 1.0:
                    fits[n.worth] = content or (named and bool(bare.strip()))
                else:
                    fits[n.worth] = n.worth >= MAYBE and (n.tag in HEADINGS or _sentences(bare))
            if (n.path, n.worth) not in paths and scope[n.element] and fits.get(n.worth):
                kept.append(n.text)
            elif (n.path, n.worth) not in paths and not scope[n.element] and n.tag == "p" and n.worth == 1.0 and around & {n.element, elements[n.element].parent} and _sentences(bare):
                kept.append(n.text)  # a paragraph in front of or behind the scope
        out.append(" ".join("".join(kept).split()))
    return " ".join(t for t in out if t)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(work, SCHEMA)
