"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: stretches of text without block-level markup inside. Each block has features from the tags, classes
and ids of its ancestors and from its text (length, links, punctuation, position, what stands next to it). The field labels
the sequence of blocks as main text or not; weights come from labelled pages by maximum likelihood, and Viterbi picks the
best sequence.

Labelled pages are a bounded, documented sample: the ``sample`` pages with the smallest hash that mark their
main text with ``article`` or ``main``; blocks inside it and outside menus, forms, comments and the like are main text. Each also
serves once more with its blocks put into another page frame, so that no single mark-up decides.

Where no page of the table marks any text, a fixed prior field stands in: blocks in menus, forms, comments and the like
(``OFF_TAGS``, ``OFF_NAMES``), blocks of mostly links and very short ones are off, all others are main text.

Defined results: null and empty pages, and pages without text, give the empty string. Unclosed and stray tags are closed as
browsers do in the common cases; a tag that is cut off at the end of the page is dropped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without end tag, with raw text that is no page text, and inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike
strong sub sup time tt u var wbr noscript iframe object svg math mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded
mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics annotation""".split())
#: A start tag closes an open element of its own kind.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
#: Block starts that end a paragraph.
ENDS_P = frozenset("""address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section
table ul""".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    tags: tuple[str, ...]
    names: frozenset[str]
    text: list[str] = field(default_factory=list)
    linked: int = 0
    body: str = ""


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    current: Block | None = None
    at, end = 0, len(page)

    def add(text: str) -> None:
        nonlocal current
        if not text:
            return
        if current is None:
            current = Block(tuple(t for t, _ in stack), frozenset().union(*(n for _, n in stack)))
            out.append(current)
        plain = entities.unescape(text)
        current.text.append(plain)
        if any(t == "a" for t, _ in stack):
            current.linked += len(plain)

    while at < end:
        tag = _TAG.search(page, at)
        if tag is None:
            add(page[at:])
            break
        add(page[at:tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            current = None
        elif name == "br" and current is not None:
            current.text.append(" ")
        if tag[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        # Inside svg and math a slash closes any element.
        if name in RAW and not (tag[3].endswith("/") and any(t in ("svg", "math") for t, _ in stack)):
            close = re.compile(f"</{re.escape(name)}[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in CLOSES.get(name, ()) or (stack[i][0] == "p" and name in ENDS_P):
                del stack[i:]
                break
            if stack[i][0] not in INLINE and stack[i][0] not in ("td", "th", "tr"):
                break
        if name not in VOID and not tag[3].endswith("/"):
            names = frozenset(_PART.findall(" ".join(a or b or c for a, b, c in _ATTR.findall(tag[3])).lower())) if tag[3] else frozenset()
            stack.append((name, names))
    kept = []
    for block in out:
        block.body = " ".join("".join(block.text).split())
        if block.body:
            kept.append(block)
    return kept


def _steps(value: float, cuts: tuple[float, ...]) -> int:
    return sum(value >= c for c in cuts)


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block; neighbours' lengths and links count too."""
    own = []
    for i, b in enumerate(blocks):
        n = len(b.body)
        words = b.body.count(" ") + 1
        link = b.linked / n
        shape = (_steps(words, (3, 6, 12, 25, 60)), _steps(link, (0.1, 0.5, 0.9)))
        own.append(shape)
    out = []
    for i, b in enumerate(blocks):
        n = len(b.body)
        names = [f"words={own[i][0]}", f"links={own[i][1]}", f"parent={b.tags[-1] if b.tags else ''}",
                 f"stops={_steps((b.body.count('. ') + b.body.count(', ')) / (n / 40 + 1), (0.3, 0.8))}",
                 f"ends={b.body[-1] in '.!?:;…'}", f"place={_steps(i / len(blocks), (0.1, 0.3, 0.6, 0.9))}",
                 f"digits={_steps(sum(map(str.isdigit, b.body[:400])) / min(n, 400), (0.1, 0.4))}"]
        names += {f"in={t}" for t in b.tags if t not in ("html", "body")}
        names += {f"class={t}" for t in b.names}
        names += [f"before={own[i - 1][0]},{own[i - 1][1]}" if i else "first",
                  f"after={own[i + 1][0]},{own[i + 1][1]}" if i + 1 < len(blocks) else "last"]
        if b.body[:1] in "©" or "©" in b.body[:80]:
            names.append("copyright")
        out.append(names)
    return out


#: Marks of what is no main text even inside an article: tags, and parts of class names.
OFF_TAGS = frozenset("nav aside footer header form button select label figcaption menu dialog".split())
OFF_NAMES = frozenset("""ad ads advert advertisement banner sponsor promo nav menu breadcrumb sidebar side widget related share social
comment comments reply replies disqus cookie consent notice popup modal newsletter subscribe signup login form footer header copyright
toolbar pagination pager""".split())


def teacher_labels(blocks: list[Block]) -> list[bool]:
    """Labels of a page that marks its main text with ``article`` or ``main``."""
    return [("article" in b.tags or "main" in b.tags) and not OFF_TAGS.intersection(b.tags)
            and not OFF_NAMES.intersection(b.names) for b in blocks]


#: Page frames for the second copy of a labelled page: containers of main text, and of everything else.
MAIN_FRAMES = ((("main",), ()), (("article",), ("post",)), (("div",), ("content",)), (("div",), ("entry", "content")),
               (("section",), ("article", "body")), (("div", "div"), ("main",)), (("div",), ("story", "text")), (("div",), ()))
OTHER_FRAMES = ((("nav",), ()), (("div",), ("menu",)), (("header",), ()), (("footer",), ()), (("aside",), ("sidebar",)),
                (("div",), ("sidebar",)), (("div",), ("ad",)), (("div",), ("advert", "banner")), (("div",), ("cookie", "notice")),
                (("form",), ()), (("section",), ("comments",)), (("div",), ("comment",)), (("div",), ("related",)),
                (("div",), ("footer",)), (("div",), ("header",)), (("article",), ("comment",)), (("ul",), ("breadcrumb",)),
                (("article", "aside"), ()), (("main", "form"), ("newsletter",)), (("article", "section"), ("comments",)),
                (("article", "footer"), ()), (("article", "div"), ("share",)), (("main", "div"), ("ad",)), (("div",), ("popup", "modal")))


#: Leaf elements of main text in a reframed page: its first block, and the others.
HEADS = ("h1", "h2", "h3")
LEAVES = (*["p"] * 12, "li", "li", "blockquote", "h2", "h3", "td", "div", "pre")


def reframed(blocks: list[Block], labels: list[bool], rng: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """The page in another frame: one container for its main text, others around and sometimes inside it. Readers'
    comments take text of the page itself, since they read like it."""
    tags, names = MAIN_FRAMES[rng.integers(len(MAIN_FRAMES))]

    def put(b: Block, frame: tuple[tuple[str, ...], tuple[str, ...]], leaf: str) -> Block:
        made = Block(("html", "body", *frame[0], leaf), frozenset(frame[1]))
        made.body, made.linked = b.body, b.linked
        return made

    main, rest = [b for b, y in zip(blocks, labels) if y], [b for b, y in zip(blocks, labels) if not y]
    out, marks = [], []
    for place in range(3):
        if place == 1:
            inside = [(put(b, (tags, names), LEAVES[rng.integers(len(LEAVES))] if i else HEADS[rng.integers(3)]), True)
                      for i, b in enumerate(main)]
            if main and rest and rng.random() < 0.5:
                frame = OTHER_FRAMES[rng.integers(len(OTHER_FRAMES))]
                extra = put(rest[rng.integers(len(rest))], ((*tags, *frame[0]), (*names, *frame[1])), "p")
                inside.insert(int(rng.integers(1, len(inside) + 1)), (extra, False))
        else:
            inside = []
            for _ in range(int(rng.integers(0, 4))):
                frame = OTHER_FRAMES[rng.integers(len(OTHER_FRAMES))]
                source = main if main and ("comment" in frame[1] or "comments" in frame[1] or rng.random() < 0.3) else rest
                for _ in range(int(rng.integers(1, 4)) if source else 0):
                    leaf = ("li", "p", "div", "a")[rng.integers(4)]
                    inside.append((put(source[rng.integers(len(source))], frame, leaf), False))
        out += [b for b, _ in inside]
        marks += [y for _, y in inside]
    return out, marks


@dataclass
class Field:
    """Weights of the random field: per feature and label, per pair of labels, and at the start."""
    index: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray
    start: np.ndarray


def train(pages: list[tuple[list[list[str]], list[bool]]], rounds: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by gradient ascent (Adam) over all sequences at once, padded to the longest."""
    pages = [p for p in pages if p[1]]
    index: dict[str, int] = {}
    for rows, _ in pages:
        for row in rows:
            for name in row:
                index.setdefault(name, len(index))
    n, longest = len(pages), max((len(y) for _, y in pages), default=0)
    cell, name = [], []
    gold, real = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (rows, y) in enumerate(pages):
        gold[i, :len(y)], real[i, :len(y)] = y, True
        for t, row in enumerate(rows):
            cell += [i * longest + t] * len(row)
            name += [index[f] for f in row]
    cell, name = np.array(cell, int), np.array(name, int)
    w, steps, start = np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, steps, start)]
    onehot = np.eye(2)[gold] * real[..., None]
    pairs = real[:, 1:, None, None] * np.einsum("nti,ntj->ntij", onehot[:, :-1], onehot[:, 1:])
    for round_ in range(1, rounds + 1 if n else 1):
        score = np.stack([np.bincount(cell, w[name, k], n * longest) for k in (0, 1)], 1).reshape(n, longest, 2)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0] + start
        for t in range(1, longest):
            step = np.logaddexp.reduce(forward[:, t - 1, :, None] + steps, axis=1) + score[:, t]
            forward[:, t] = np.where(real[:, t, None], step, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(steps + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(real[:, t + 1, None], step, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        state = np.exp(forward + backward - total[:, None, None]) * real[..., None]
        edge = np.exp(forward[:, :-1, :, None] + steps + (score + backward)[:, 1:, None, :] - total[:, None, None, None])
        edge *= real[:, 1:, None, None]
        off = (onehot - state).reshape(-1, 2)
        grads = (np.stack([np.bincount(name, off[cell, k], len(index)) for k in (0, 1)], 1) / n - ridge * w,
                 (pairs - edge).sum((0, 1)) / n, (onehot[:, 0] - state[:, 0]).sum(0) / n)
        for p, g, (m, v) in zip((w, steps, start), grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**round_)) / (np.sqrt(v / (1 - 0.99**round_)) + 1e-8)
    return Field(index, w, steps, start)


def viterbi(model: Field, rows: list[list[str]]) -> list[bool]:
    if not rows:
        return []
    index, w = model.index, model.weights
    (aa, ab), (ba, bb) = model.steps.tolist()
    back, low, high = [], *model.start.tolist()
    for t, row in enumerate(rows):
        known = [index[f] for f in row if f in index]
        off, on = w[known].sum(0).tolist() if known else (0.0, 0.0)
        if t:
            from_low, from_high = (low + aa, low + ab), (high + ba, high + bb)
            back.append((from_high[0] > from_low[0], from_high[1] > from_low[1]))
            low, high = max(from_low[0], from_high[0]), max(from_low[1], from_high[1])
        low, high = low + off, high + on
    out = [high > low]
    for step in reversed(back):
        out.append(step[out[-1]])
    return [bool(y) for y in reversed(out)]


def prior() -> Field:
    """The field for tables without any labelled page: weights of the marks of other text, of links and of length."""
    off = {f"in={t}": 4.0 for t in OFF_TAGS} | {f"class={t}": 4.0 for t in OFF_NAMES} | {
        "links=2": 2.0, "links=3": 3.0, "words=0": 1.0, "words=1": 0.5, "copyright": 4.0}
    on = {"words=2": 0.5, "words=3": 1.0, "words=4": 2.0, "words=5": 3.0, "parent=p": 1.0, "parent=h1": 2.0, "parent=h2": 1.5,
          "parent=h3": 1.5}
    names = [*off, *on]
    weights = np.array([[off.get(n, 0.0), on.get(n, 0.0)] for n in names])
    return Field({n: i for i, n in enumerate(names)}, weights, np.array([[0.25, 0.0], [0.0, 0.25]]), np.zeros(2))


def fit(pages: DataFrame, sample: int = 300, page_id: str = "page_id", html: str = "html") -> Field:
    """The field learnt from the bounded sample of pages that mark their main text."""
    marked = pages.where(F.col(html).rlike(r"(?i)<(?:article|main)[\s>]")).select(
        F.col(html).alias("html"), F.xxhash64(html).alias("hash"))
    # Hashes alone are ordered; then only the sampled pages travel, copies of a page once.
    last = marked.select("hash").distinct().orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    chosen = marked.where(F.col("hash") <= last) if last is not None else marked.limit(0)
    rows = sorted(chosen.groupBy("hash").agg(F.first("html").alias("html")).collect())
    rng = np.random.default_rng(11)
    labelled = []
    for row in rows:
        blocks = blocks_of(row["html"])
        labels = teacher_labels(blocks)
        for b, y in ((blocks, labels), reframed(blocks, labels, rng)):
            labelled.append((features(b), y))
    return train(labelled) if any(any(y) for _, y in labelled) else prior()


def main_text(model: Field, page: str | None) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b.body for b, y in zip(blocks, viterbi(model, features(blocks))) if y)


def _extract(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    own = model.value
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            texts = [main_text(own, t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                  sample: int = 300) -> DataFrame:
    """page_id, url, text, n_chars."""
    model = pages.sparkSession.sparkContext.broadcast(fit(pages, sample, page_id, html))
    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.col(html).cast("string").alias("html")).mapInArrow(
        partial(_extract, model=model), "page_id long, url string, text string, n_chars long")
