"""Main text of web pages as the maximum-scoring run of blocks.

A page is read as words and tags. Words score by the block they stand in, by whether they are link
text and by whether they lie inside the page's article, tags score negative; the weights are
log-odds counted on labelled pages, which are those that mark their article themselves (``article``
or ``main``), at most ``SAMPLE`` of them. One pass over the blocks finds the contiguous region with
the largest sum. Blocks of menus, forms, notices and the like score ``OUTSIDE`` a word and are left
out of the text even within the region. They are told by their element, or by a class word.

A class word is a whole class or id, or a part of one that names no state of the layout
(``has-sidebar`` says nothing about its element). A marked element that holds more than ``HALF`` of
the page's plain words is no such part after all, unless an article stands outside of it or readers'
comments are what it is marked as; words of such comments are not counted here. An ``article`` counts as the page's only where all of them hold
``TEASER`` of its plain words or more; with less they are teasers, and blocks score by their own.

Defined cases: null and empty pages have the empty text; unclosed elements end with their parent;
pages without an article are scored by their blocks alone; the first of equal regions is taken;
without labelled pages every word of a block scores 1 and every tag ``TAG``; extra columns and
repeated rows do not matter; an empty table gives an empty result; long pages are read whole in
linear time. Dropped parts within a line (a button, a marked ``span``) do not cut the line.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages at most; bounds of a learned weight; weight of the article; of dropped words; of tags.
SAMPLE, MOST, ARTICLE, OUTSIDE, TAG = 500, 3.0, 6.0, -3.0, -0.1
#: Shares of the page's plain words.
HALF, TEASER = 0.5, 0.25

#: Elements by what they are for.
BLOCKS = frozenset("address article blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
                   "h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("aside audio button canvas dialog fieldset footer form head header iframe input label legend map menu nav "
                    "noscript object option script select style svg template textarea title video".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a b code em i img small span strong sub sup u".split())
#: Dropped elements that stand within a line.
WITHIN = frozenset("audio button canvas input label map object option select video".split())
ARTICLES = frozenset(("article", "main"))
NEVER_BY_CLASS = frozenset(("html", "body", "main"))
#: Class and id words, and roles, of parts that are not the article.
CLASS_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie cookies footer "
    "gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager "
    "popup promo recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Parts of a class that tell a state of the layout.
STATES = frozenset("has no not with without layout is enabled disabled".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Tags that an opening tag of the key ends where they are open.
_ENDS = {"p": {"p"}, "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "tr", "td", "th"},
         "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"option"}}
_ENDS |= {t: {"p"} for t in BLOCKS if t not in _ENDS and t not in ("html", "body")}
_SCOPE = frozenset("ul ol table article section div body html main td th blockquote nav footer header aside form".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)"""
                    r"""(?P<attrs>(?:[^>"']|"[^"]*+"|'[^']*+')*+)>""", re.DOTALL)
_ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
_LETTERS = re.compile(r"[a-z]+")


@dataclass
class Block:
    """Text between two block borders, with what its score needs."""

    kind: str
    node: int  # innermost marked element or article around it, 0 if none
    dropped: bool
    place: str = "none"  # inside or outside the article, none where the page has none
    words: int = 0
    link_words: int = 0
    tags: Counter = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


@dataclass
class Node:
    """An element that its class marks, or an article."""

    up: int
    mark: str
    article: bool
    words: int = 0
    articles: int = 0  # articles within it


def _mark(name: str, attrs: str) -> str:
    """drop for elements that never count, else class or comment for those with such a class, or nothing."""
    if name in DROPPED:
        return "drop"
    if not attrs or name in NEVER_BY_CLASS:
        return ""
    mark = ""
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if (key == "role" and value in ROLES) or key == "hidden" or (key == "aria-hidden" and value == "true") or (
                key == "style" and "display:none" in value.replace(" ", "")):
            return "drop"
        if key in ("class", "id"):
            for whole in value.split():
                parts = _LETTERS.findall(whole)
                if whole not in CLASS_WORDS and not STATES.isdisjoint(parts):
                    continue
                if not COMMENT_WORDS.isdisjoint(parts):
                    mark = "comment"
                elif not CLASS_WORDS.isdisjoint(parts):
                    mark = mark or "class"
    return mark


def _judge(out: list[Block], nodes: list[Node]) -> None:
    """Settle which marked elements are dropped, and which blocks lie in the page's article."""
    for b in out:
        if not b.dropped:
            nodes[b.node].words += b.words - b.link_words
    for n in reversed(nodes[1:]):  # inner ones come later
        if n.mark != "comment":  # comments may be longer than all else
            nodes[n.up].words += n.words
            nodes[n.up].articles += n.articles + n.article
    total, articles = nodes[0].words, nodes[0].articles
    gone, inside = [False] * len(nodes), [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        kept = n.words > HALF * total and n.articles + n.article == articles and n.mark == "class"
        gone[i] = gone[n.up] or (n.mark != "" and not kept)
        inside[i] = not gone[i] and (inside[n.up] or n.article)
    plain = held = 0
    for b in out:
        b.dropped |= gone[b.node]
        if not b.dropped:
            plain += b.words - b.link_words
            held += (b.words - b.link_words) * inside[b.node]
    if any(inside) and held >= TEASER * plain:
        for b in out:
            b.place = "inside" if inside[b.node] else "outside"


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, str, int]] = []  # name, what it does, the node around it
    opened: Counter = Counter()
    nodes = [Node(0, "", False)]
    dropped = links = muted = node = 0
    block = Block("body", 0, False)

    def border() -> None:
        nonlocal block
        if block.words or block.tags:
            out.append(block)
        kind = next((n for n, _, _ in reversed(stack) if n in BLOCKS), "body")
        block = Block(kind, node, dropped > 0)

    def leave() -> bool:
        """Close the innermost element; whether that ends a block."""
        nonlocal dropped, links, muted, node
        name, does, node = stack.pop()
        opened[name] -= 1
        dropped -= does == "drop"
        muted -= does == "mute"
        links -= name == "a"
        return does != "mute" and (name in BLOCKS or does != "")

    def say(raw: str) -> None:
        if muted:
            block.parts.append(" ")
            return
        text = html.unescape(raw)
        n = len(text.split())
        block.parts.append(text)
        block.words += n
        if links:
            block.link_words += n

    at = 0
    while True:
        found = _TOKEN.search(page, at)
        if found is None:
            break
        if found.start() > at:
            say(page[at:found.start()])
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            block.parts.append(" ")
            continue
        if found["close"]:
            if opened[name]:
                ends = False
                last = None
                while last != name:
                    last = stack[-1][0]
                    ends |= leave()
                if ends:
                    border()
            block.tags[name] += 1
            continue
        if name in RAW:
            if not found["attrs"].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            block.parts.append(" " if name in BLOCKS else "")
            continue
        if name in _ENDS:
            closing = len(stack)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _ENDS[name]:
                    closing = i
                elif stack[i][0] in _SCOPE:
                    break
            while len(stack) > closing:
                leave()
        if name == "body":  # an unclosed head ends here
            while stack and stack[-1][0] == "head":
                leave()
        mark = _mark(name, found["attrs"])
        does = mark
        if name in WITHIN or (mark and name in INLINE):
            does = "mute"
        if name not in VOID and not found["attrs"].endswith("/"):
            stack.append((name, does, node))
            opened[name] += 1
            dropped += does == "drop"
            muted += does == "mute"
            links += name == "a"
            if not dropped and not muted and (mark or name in ARTICLES):
                nodes.append(Node(node, mark, name in ARTICLES))
                node = len(nodes) - 1
        if does != "mute" and (name in BLOCKS or does):
            border()
        block.tags[name] += 1
    if at < len(page):
        say(page[at:])
    border()
    _judge(out, nodes)
    return out


@dataclass(frozen=True)
class Weights:
    """Log-odds by feature; a feature that labelled pages never showed has the default."""

    learned: dict[str, float]

    def word(self, kind: str, link: bool) -> float:
        return self.learned.get(f"word {kind} {'link' if link else 'plain'}", -1.0 if link else 1.0)

    def tag(self, name: str) -> float:
        # marks within a line say little, and there may be many
        return self.learned.get(f"tag {name}", TAG) * (0.01 if name in INLINE else 1.0)

    def score(self, b: Block) -> float:
        tags = sum(self.tag(t) * n for t, n in b.tags.items())
        if b.dropped:
            return OUTSIDE * b.words + tags
        place = {"inside": ARTICLE, "outside": -ARTICLE, "none": 0.0}[b.place]
        plain = b.words - b.link_words
        return plain * (self.word(b.kind, False) + place) + b.link_words * (self.word(b.kind, True) + place) + tags


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum; empty if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str, weights: Weights) -> str:
    held = blocks(page)
    a, b = best_region([weights.score(x) for x in held])
    texts = (x.text() for x in held[a:b] if not x.dropped)
    return "\n".join(t for t in texts if t)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, inside, outside) of labelled pages."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for page in batch.column(0):
            for b in blocks(page.as_py() or ""):
                if b.place == "none":
                    continue
                side = 0 if b.place == "inside" and not b.dropped else 1
                known = b.kind if b.kind in BLOCKS else "other"
                marks = [] if b.dropped else [(f"word {known} plain", b.words - b.link_words), (f"word {known} link", b.link_words)]
                marks += [(f"tag {t}", n) for t, n in b.tags.items() if t in BLOCKS or t in DROPPED or t in INLINE]
                for mark, n in [x for x in marks if x[1]]:
                    counts.setdefault(mark, [0, 0])[side] += n
        if counts:
            names = sorted(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([counts[x][0] for x in names], pa.int64()), pa.array([counts[x][1] for x in names], pa.int64())],
                names=["feature", "inside", "outside"])


def fit(pages: DataFrame, column: str = "html") -> Weights:
    """Weights from at most SAMPLE labelled pages; one row per known feature comes to the driver."""
    labelled = pages.filter(F.lower(F.col(column)).rlike("<(?:article|main)[\\s>]"))
    digest = F.md5(F.col(column).cast("binary"))
    # a share by digest first, so that ordering the sample never gathers more than about its size
    share = 0.8 * SAMPLE / max(labelled.count(), 1)
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    sample = labelled.select(column).filter(place < share).orderBy(digest).limit(SAMPLE)
    rows = (sample.mapInArrow(_counts, "feature string, inside bigint, outside bigint")
            .groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect())
    return Weights({r.feature: _weight(r.feature, r.inside, r.outside) for r in rows})


def _weight(feature: str, inside: int, outside: int) -> float:
    odds = max(-MOST, min(MOST, math.log((inside + 1) / (outside + 1))))
    return odds if feature.startswith("word") else min(TAG, odds * -TAG)


def extract(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text and n_chars, one row per page."""
    weights = fit(pages, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", weights) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)
    return pages.select(*keep, column).mapInArrow(run, f"{kinds}, text string, n_chars bigint")
