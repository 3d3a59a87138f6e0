"""Main text of web pages as the maximum-scoring run of their tokens.

A page is read as a row of words and tags.  Each gets a weight learnt from labelled pages
(log odds of lying in the main text): words by the block element around them or the
name of their box, whichever weighs less; tags by name and never positive.  The run of tokens with the largest sum, found in one
scan, is the content; what never belongs to an article (menus, forms, notices, comments,
...) is passed over inside it.  A box is passed over by its element, or by a whole class
name, id or role; one word of a compound ("has-sidebar") has a learnt weight only.  Ids of
headings, and of sections in the main part, are anchors and say nothing.  Where every
article (or every main) of a page lies in such boxes, those boxes are not passed over.

Labelled pages are those whose markup names its main part (an ``article`` or ``main``
element); about ``labelled`` of them, chosen by a hash of the id, are counted.

Defined cases: null or empty html has the empty text; a page without words has the empty
text; of equal runs the first wins; unclosed elements end with their parent; repeated
pages are read one by one; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship

#: Pages counted for weights (about), at most.
LABELLED = 400

# Attributes: a quote counts behind an equals sign only; what ends nowhere ends with the page, so
# no character is tried again for each tag before it.
_ATTRIBUTES = r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|title|textarea|noscript|template|svg|iframe|select)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("nav aside footer form button menu dialog head fieldset".split())
_NEVER_NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal newsletter subscribe sidebar side menu nav navbar navigation navigate breadcrumb breadcrumbs header footer comment comments commentlist disqus reply replies respond share sharing social related recommended widget search login masthead pagination pager complementary contentinfo toolbar".split()
)
_WITH_ID = frozenset("div section ul ol table td".split())
_GENERIC = frozenset("div section a td dd dt".split())
_CLOSES_P = _BLOCKS - {"body", "html"}
_SPLIT = re.compile(r"[^a-z0-9]+")


def _judged(name: str, attributes: str, main: bool) -> tuple[bool, frozenset]:
    """Whether a box is passed over by a whole name, and the listed words in its names."""
    whole, words = False, set()
    for kind, *groups in _NAMES.findall(attributes):
        if kind.lower() == "id" and (name not in _WITH_ID or (name == "section" and main)):
            continue
        for one in "".join(groups).lower().split():
            whole = whole or (one in _NEVER_NAMED and not (one == "header" and main))
            words.update(w for w in _SPLIT.split(one) if w in _NEVER_NAMED)
    return whole, frozenset(words)


def tokens_of(page: str):
    """(kind, value, main, out): kind 't' for a tag (its name), 'w' for text (with the block
    element around it and the listed words of its boxes' names); main: inside article or main;
    out: inside what is never content."""
    stack: list[tuple[str, int, str]] = []  # name, box, nearest block or link
    opened: Counter = Counter()  # open elements by name
    boxes: list[tuple[int, bool, frozenset]] = [(0, False, frozenset())]  # parent, main, words
    cut, parts, found = [False], [], []
    at = 0

    def here() -> int:
        return stack[-1][1] if stack else 0

    def around() -> str:
        return stack[-1][2] if stack else "body"

    def close_from(k: int) -> None:
        opened.subtract(n for n, _, _ in stack[k:])
        del stack[k:]

    def close_open(names: tuple, limits) -> None:
        """Close the nearest open element of some names, within the nearest of the limits."""
        if not any(opened[n] > 0 for n in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                close_from(k)
                return
            if stack[k][0] in limits:
                return

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            found.append(("w", (around(), page[at : m.start()]), here()))
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            if opened[name] > 0:
                box, k = here(), len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close_from(k)
                found.append(("t", "/" + name, box))
            continue
        if name in _CLOSES_P:
            close_open(("p",), _BLOCKS)  # a block begins: an open paragraph ends
        if name in ("li", "td", "th", "tr", "dt", "dd", "option"):
            close_open((name,), ("ul", "ol", "table", "dl"))
        parent = here()
        _, main, words = boxes[parent]
        never = name in _NEVER or (name == "header" and not main)
        if name in ("article", "main"):
            parts.append((name, len(boxes)))
            main, words = True, frozenset()
        elif name not in ("html", "body") and m[4]:
            whole, own = _judged(name, m[4], main)
            never, words = never or whole, words | own
        box = len(boxes)
        boxes.append((parent, main, words))
        cut.append(never)
        found.append(("t", name, box))
        if name not in _VOID and not m[4].rstrip().endswith("/"):
            stack.append((name, box, name if name in _BLOCKS or name == "a" else around()))
            opened[name] += 1
    if at < len(page):
        found.append(("w", (around(), page[at:]), here()))
    out = _passed_over(boxes, cut)
    for kind in ("article", "main"):
        held = [box for name, box in parts if name == kind]
        if held and all(out[box] for box in held):
            seen: set[int] = set()
            for box in held:  # boxes around the only ones of the page hold its main part
                while box and box not in seen:
                    seen.add(box)
                    cut[box], box = False, boxes[box][0]
            out = _passed_over(boxes, cut)
    for kind, value, box in found:
        yield kind, value if kind == "t" else (*value, boxes[box][2]), boxes[box][1], out[box]


def _passed_over(boxes: list[tuple[int, bool, frozenset]], cut: list[bool]) -> list[bool]:
    out: list[bool] = []
    for (parent, _, _), never in zip(boxes, cut):
        out.append(never or (bool(out) and out[parent]))
    return out


def labels_of(page: str) -> Counter:
    """Counts of (feature, inside main) for one labelled page."""
    counts: Counter = Counter()
    for kind, value, main, out in tokens_of(page):
        inside = main and not out
        if out and (kind == "t" or value[0] not in _GENERIC):
            continue  # passed over by name anyway; only unnamed boxes like these are learnt from
        if kind == "t":
            counts["<" + value, inside] += 1
        else:
            n = len(value[1].split())
            counts["w " + value[0], inside] += n
            for word in value[2]:
                counts["n " + word, inside] += n
    return counts


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds by feature, smoothed; a word of an unseen element counts a little in favour.  Names
    of boxes only count against."""
    out = {}
    for feature in {f for f, _ in counts}:
        odds = math.log((counts.get((feature, True), 0) + 0.5) / (counts.get((feature, False), 0) + 0.5))
        odds = max(-3.0, min(3.0, odds))
        out[feature] = odds if feature[0] in "wn" else min(-0.05, 0.25 * odds)
    return out


def best_run(weights: list[float]) -> tuple[int, int]:
    """Begin and end of the run with the largest positive sum, the first of equal ones."""
    best, total, begin, span = 0.0, 0.0, 0, (0, 0)
    for k, weight in enumerate(weights):
        if total <= 0:
            total, begin = 0.0, k
        total += weight
        if total > best:
            best, span = total, (begin, k + 1)
    return span


def text_of(page: str | None, weights: dict[str, float]) -> str:
    """The text of the best run: blocks in order, joined by two line ends."""
    if not page:
        return ""
    sequence = []
    for kind, value, _, out in tokens_of(page):
        if kind == "t":
            sequence.append((0.0 if out else weights.get("<" + value, -0.1), value, None))
        elif not out:
            n = len(value[1].split())
            weight = weights.get("w " + value[0], 0.5)
            against = [w for word in value[2] if (w := weights.get("n " + word, 0.0)) < 0]
            sequence.append((n * min(weight, *against) if against else n * weight, None, value[1]))
    span = best_run([weight for weight, _, _ in sequence])
    blocks, held = [], []

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            blocks.append(text)
        held.clear()

    for _, tag, text in sequence[span[0] : span[1]]:
        if text is not None:
            held.append(text)
        elif tag.lstrip("/") in _BLOCKS:
            close()
        elif tag == "br":
            held.append(" ")
    close()
    return "\n\n".join(blocks)


def _counter(batches):
    for batch in batches:
        total: Counter = Counter()
        for page in batch.column("html").to_pylist():
            total += labels_of(page)
        rows = [(f, i, n) for (f, i), n in total.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64())], names=["feature", "inside", "n"]
        )


def learn(pages: DataFrame, labelled: int = LABELLED, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    """Weights from pages that mark their main part.  Features go to the driver, the 4000
    commonest counts at most (a bound of the classifier); the rest keep the default weight."""
    ship(pages.sparkSession)
    marked = pages.select(F.col(id_col).alias("i"), F.col(html_col).cast("string").alias("html")).where("html rlike '(?i)<(article|main)[\\\\s>]'")
    total = marked.count()
    share = min(1_000_000, int(1_000_000 * labelled / max(total, 1)) + 1)
    some = marked.where(F.pmod(F.xxhash64("i"), F.lit(1_000_000)) < share).select("html")
    counted = some.mapInArrow(_counter, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "feature", "inside").limit(4000).collect()
    return weights_of({(r[0], r[1]): r[2] for r in rows})


def _extractor(weights: dict[str, float]):
    def run(batches):
        for batch in batches:
            texts = [text_of(p, weights) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return run


def extract(pages: DataFrame, labelled: int = LABELLED, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for every page; no shuffle."""
    weights = learn(pages, labelled, id_col, html_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extractor(weights), f"page_id {kind}, url string, text string, n_chars long")
