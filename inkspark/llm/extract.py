"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of each page's tree.

A page is read once into leaf blocks, the runs of text between the edges of
block-level elements, each with the elements around it. A block's features are
the names, classes and ids of those elements and what its text is like (length,
words, share of link text, punctuation); words themselves are none. Two states
(article or not) are chained by transitions that depend on whether the block
before stands in the same element, in the same container, or elsewhere. Weights
maximise the conditional likelihood of labelled pages (``pagemaker``); a page is
decoded by Viterbi. Kept blocks are joined in page order by a line break.

Character references are decoded, white space in a block is one space, and a
``br`` is white space. Text of ``head``, ``script``, ``style`` and the like is
never a block.

Defined results: a null or empty page, and one without an article, has an empty
text; broken markup (unclosed elements, missing ends, stray signs) is read on
as text and elements as far as it goes; equal pages get equal texts, repeated
rows stay rows of their own; a null id or URL is kept; a very long page is read
whole, in memory in proportion to it; an empty table gives an empty result;
other columns are not read, whatever their names. Ties go to "not article".
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pagemaker

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*+/?(?=>)|[^>]*)(?:>|\Z)""",
    re.DOTALL,
)
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# fixed values: elements of HTML by their kind
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
UNSEEN = {"head", "svg", "math", "select", "button", "object", "video", "audio", "canvas", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
LANDMARKS = {"article", "main", "nav", "header", "footer", "aside", "form", "section", "dialog", "menu"}
#: Elements that an opening one ends if they are open, up to an element of the third kind.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}


@dataclass
class Block:
    """A leaf block: its text, how many of its characters are in links, and the elements around it."""

    text: str
    linked: int
    around: tuple[str, ...]


def leaf_blocks(html: str) -> list[Block]:
    """The page's leaf blocks in order. Elements are written ``name class and id``."""
    blocks: list[Block] = []
    stack: list[str] = []  # open elements, block-level and others
    marks: list[str] = []  # the same, as written in ``around``; '' for inline ones
    held: list[str] = []
    linked, unseen, in_link, at = 0, 0, 0, 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not unseen:
            plain = unescape(raw) if "&" in raw else raw
            held.append(plain)
            if in_link:
                linked += len(plain.strip())

    def flush() -> None:
        nonlocal linked
        if held:
            words = "".join(held).split()
            held.clear()
            if words:
                blocks.append(Block(" ".join(words), linked, tuple(filter(None, marks))))
        linked = 0

    def close(depth: int) -> None:
        nonlocal unseen, in_link
        while len(stack) > depth:
            name = stack.pop()
            marks.pop()
            unseen -= name in UNSEEN
            in_link -= name == "a"

    def find(names: set[str], until: set[str] = frozenset()) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in names:
                return i
            if stack[i] in until:
                return -1
        return -1

    n = len(html)
    while at < n:
        m = _TAG.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name in BLOCK:
                flush()
            if name == "br":
                held.append(" ")
            depth = find({name}, set() if name in BLOCK else {"p", "div", "li", "td", "th", "article", "section"})
            if depth >= 0:
                close(depth)
        elif m[2]:
            name, rest = m[2].lower(), m[3] or ""
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                at = end.end() if end else n
                continue
            if name == "br":
                held.append(" ")
            if name in BLOCK:
                flush()
                if (depth := find({"p"}, {"table", "td", "th", "button", "li", "div", "article", "section"})) >= 0:
                    close(depth)
                if name in ENDS and (depth := find(*ENDS[name])) >= 0:
                    close(depth)
                elif name == "body" and "head" in stack:
                    close(stack.index("head"))
            elif name == "a" and in_link and (depth := find({"a"})) >= 0:
                close(depth)
            if name in VOID or rest.endswith("/"):
                continue
            stack.append(name)
            marks.append(_mark(name, rest) if name in BLOCK else "")
            unseen += name in UNSEEN
            in_link += name == "a"
    flush()
    return blocks


@lru_cache(maxsize=1 << 14)
def _mark(name: str, rest: str) -> str:
    found = {part.lower() for m in _NAMES.finditer(rest) for part in _PART.findall(m[2] or m[3] or m[4] or "")} if "=" in rest else set()
    if rest and _HIDDEN.search(rest):
        found.add("hidden")
    return " ".join([name, *sorted(found)])


@lru_cache(maxsize=1 << 14)
def _around(around: tuple[str, ...]) -> tuple[str, ...]:
    """Features of the elements around a block."""
    found = {"always"}
    for mark in around:
        name, *parts = mark.split(" ")
        found.add(f"in {name}")
        found.update(f"named {p}" for p in parts)
    own = [m.split(" ")[0] for m in around]
    near = next((e for e in reversed(own) if e in LANDMARKS), "none")
    found.add(f"near {near}")
    found.add(f"{own[-1] if own else ''} near {near}")
    found.add("is " + (own[-1] if own else ""))
    found.add("under " + (own[-2] if len(own) > 1 else ""))
    found.add(f"depth {min(len(own), 8)}")
    return tuple(sorted(found))


def _text(b: Block) -> list[str]:
    """Features of a block's text."""
    t, n = b.text, len(b.text)
    words = t.count(" ") + 1
    share = 4 * min(b.linked, n) // n
    return [
        f"length {min(n.bit_length(), 10)}",
        f"words {min(words.bit_length(), 8)}",
        f"linked {share}",
        "ends as a sentence" if t[-1] in ".!?…:;\"'»”)" else "ends otherwise",
        "begins " + ("high" if t[0].isupper() else "low" if t[0].islower() else "otherwise"),
        f"commas {min(t.count(',') + t.count('.'), 3)}",
        f"word length {min(n // words, 10)}",
        "sign" if "©" in t or "|" in t or "·" in t or "»" in t else "no sign",
    ]


def _places(blocks: list[Block]) -> list[str]:
    """Whether a block is in an ``article`` or ``main``, where the page has such an element."""
    names = [{m.split(" ")[0] for m in b.around} for b in blocks]
    inside = ["article" if "article" in n else "main" if "main" in n else "" for n in names]
    most = "article" if "article" in inside else "main" if "main" in inside else ""
    return [f"the page's {most}" if i == most else f"beside the page's {most}" if most else "no article element" for i in inside]


#: How a block stands to the one before: in an element of the same kind and place, in the same container, elsewhere.
SAME, BESIDE, APART = 0, 1, 2


def _edge(a: Block, b: Block) -> int:
    return SAME if a.around == b.around else BESIDE if a.around[:-1] == b.around[:-1] else APART


def features(blocks: list[Block]) -> list[list[str]]:
    return [[*_around(b.around), *_text(b), place] for b, place in zip(blocks, _places(blocks))]


@dataclass
class Model:
    """Weights of the article state for each feature, and of the states' pairs for each kind of edge."""

    weights: dict[str, float]
    edges: np.ndarray  # [edge, state before, state]
    scores: dict[tuple[str, ...], float] = field(default_factory=dict)

    def score(self, b: Block, place: str) -> float:
        w = self.weights.get
        known = self.scores.get(b.around)
        if known is None:
            if len(self.scores) > 1 << 14:
                self.scores.clear()
            known = self.scores[b.around] = sum(w(f, 0.0) for f in _around(b.around))
        return known + sum(w(f, 0.0) for f in _text(b)) + w(place, 0.0)

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The likeliest states, by Viterbi."""
        if not blocks:
            return []
        edges, places = self.edges.tolist(), _places(blocks)
        no, yes = 0.0, self.score(blocks[0], places[0])
        back: list[tuple[int, int]] = []
        for a, b, place in zip(blocks, blocks[1:], places[1:]):
            (nn, ny), (yn, yy) = edges[_edge(a, b)]
            s = self.score(b, place)
            to_no = (no + nn, 0) if no + nn >= yes + yn else (yes + yn, 1)
            to_yes = (no + ny, 0) if no + ny >= yes + yy else (yes + yy, 1)
            back.append((to_no[1], to_yes[1]))
            no, yes = to_no[0], to_yes[0] + s
        state = int(yes > no)
        states = [state]
        for step in reversed(back):
            state = step[state]
            states.append(state)
        return [bool(s) for s in reversed(states)]

    def text(self, html: str | None) -> str:
        blocks = leaf_blocks(html or "")
        return "\n".join(b.text for b, keep in zip(blocks, self.decode(blocks)) if keep)


def _both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(x, y)


def train(pages: list[list[tuple[Block, bool]]], steps: int = 150, l2: float = 5e-5, rate: float = 0.15) -> Model:
    """Weights that maximise the labels' conditional likelihood less ``l2`` times their squares, by Adam."""
    pages = [p for p in pages if p]
    if not pages:
        return Model({"always": -1.0}, np.zeros((3, 2, 2)))
    names: dict[str, int] = {}
    size, longest = len(pages), max(map(len, pages))
    labels, real, edge = np.zeros((size, longest)), np.zeros((size, longest), bool), np.full((size, longest), APART)
    cell, which = [], []
    for i, page in enumerate(pages):
        blocks = [b for b, _ in page]
        for j, found in enumerate(features(blocks)):
            labels[i, j], real[i, j] = page[j][1], True
            if j:
                edge[i, j] = _edge(blocks[j - 1], blocks[j])
            for f in found:
                cell.append(i * longest + j)
                which.append(names.setdefault(f, len(names)))
    cell_at, which_at = np.array(cell), np.array(which)
    state = labels.astype(int)
    count, total = len(names), int(real.sum())
    follows = real.copy()
    follows[:, 0] = False
    seen = np.zeros((3, 2, 2))
    np.add.at(seen, (edge[:, 1:][follows[:, 1:]], state[:, :-1][follows[:, 1:]], state[:, 1:][follows[:, 1:]]), 1)
    theta = np.zeros(count + 12)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    last = real.sum(1) - 1
    for step in range(1, steps + 1):
        w, e = theta[:count], theta[count:].reshape(3, 2, 2)
        local = np.bincount(cell_at, w[which_at], size * longest).reshape(size, longest)
        score = np.stack([np.zeros_like(local), local], 2)
        fore, back = np.zeros((size, longest, 2)), np.zeros((size, longest, 2))
        fore[:, 0] = score[:, 0]
        for t in range(1, longest):
            x = fore[:, t - 1, :, None] + e[edge[:, t]]
            fore[:, t] = _both(x[:, 0], x[:, 1]) + score[:, t]
        for t in range(longest - 2, -1, -1):
            x = e[edge[:, t + 1]] + (score[:, t + 1] + back[:, t + 1])[:, None, :]
            back[:, t] = np.where(real[:, t + 1, None], _both(x[:, :, 0], x[:, :, 1]), 0.0)
        end = fore[np.arange(size), last]
        z = _both(end[:, 0], end[:, 1])
        yes = np.exp(fore[:, :, 1] + back[:, :, 1] - z[:, None]) * real
        pair = np.exp(fore[:, :-1, :, None] + e[edge[:, 1:]] + (score + back)[:, 1:, None, :] - z[:, None, None, None]) * follows[:, 1:, None, None]
        expected = np.zeros((3, 2, 2))
        for kind in range(3):
            expected[kind] = pair[edge[:, 1:] == kind].sum(0)
        slope = np.concatenate([np.bincount(which_at, (yes - labels).reshape(-1)[cell_at], count), (expected - seen).reshape(-1)]) / total + l2 * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        theta = theta - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model({f: float(theta[i]) for f, i in names.items()}, theta[count:].reshape(3, 2, 2))


def labelled(prose: list[str], pages: int, seed: int = 13) -> list[list[tuple[Block, bool]]]:
    """Leaf blocks of composed pages with their labels.

    The composer marks the words of article blocks with a private sign, which is taken off again.
    """
    out = []
    for html in pagemaker.pages(prose, pages, seed):
        found = []
        for b in leaf_blocks(html):
            marks = b.text.count(pagemaker.MARK)
            plain = " ".join(b.text.replace(pagemaker.MARK, "").split())
            if plain:
                found.append((Block(plain, min(b.linked, len(plain)), b.around), bool(marks)))
        out.append(found)
    return out


def fit(docs: DataFrame, pages: int = 800, sample: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model trained on ``pages`` composed pages, whose prose is from at most ``sample`` documents of 200 to 4,000 characters.

    The documents are those whose ids have the least hashes, so the choice does
    not depend on partitioning; a threshold from their number leaves little more
    than the sample to be sent to the driver.
    """
    text = F.col(text_col).cast("string")
    fitting = docs.where(F.length(text).between(200, 4000)).select(F.col(id_col).cast("string").alias("id"), text.alias("text"))
    count = fitting.count()
    few = fitting.where(F.coalesce(F.pmod(F.xxhash64("id"), F.lit(1 << 40)), F.lit(0)) <= min(1 << 40, 3 * sample * (1 << 40) // (2 * max(count, 1))))
    chosen = few.orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 40)), "id", "text").limit(sample)
    return train(labelled([r.text for r in chosen.collect()], pages))


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [own.text(html.as_py()) for html in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
