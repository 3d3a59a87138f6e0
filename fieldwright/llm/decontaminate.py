"""Benchmark decontamination by winnowing.

Benchmark texts and documents are cut into k-grams of words.  Of every ``window``
consecutive k-gram hashes only the smallest is a fingerprint, so two texts that share
``k + window - 1`` words share a fingerprint.  Document fingerprints are looked up among
the benchmark's, and every hit is extended to the whole spans of ``span`` words around
it, which are compared byte by byte: hashes only choose where to look.

The benchmark is the query set.  It is laid out in blocks of about ``block_bytes`` of text
(of one item at least), which bounds what the driver and a worker hold by that or the longest
item; documents are scanned and written once for each block and never shuffled, so a benchmark
of many blocks costs as many scans.

Defined cases: null or empty texts have no words; an item of fewer words than ``span``
(but not none) is one span of all its words; items that repeat count by distinct id; a
null item id can mark words as hit but is not listed; repeated documents are judged row
by row; an empty benchmark hits nothing; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop_staged, fresh, ship, staged, steps, trimmed
from .words import ALNUM, Words

SPAN, GRAM = 10, 5
BLOCK_BYTES = 16 << 20
_TABLE_BITS = 20

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("item_ids", T.ArrayType(T.LongType())),
    ]
)
_ARROW = pa.struct(
    [("n_words", pa.int64()), ("hit_spans", pa.list_(pa.list_(pa.int64()))), ("item_ids", pa.list_(pa.int64()))]
)


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the fingerprints: the last smallest of every ``window`` hashes in a row."""
    n = len(grams)
    if n < window:
        return np.zeros(0, np.int64)
    count = n - window + 1
    least, at = grams[:count].copy(), np.arange(count)
    for j in range(1, window):
        nearer = grams[j : j + count] <= least
        least = np.where(nearer, grams[j : j + count], least)
        at = np.where(nearer, np.arange(count) + j, at)
    return np.unique(at)


class _Set:
    """Sorted 64-bit keys behind a bit table of their leading bits."""

    def __init__(self, keys):
        self.keys = np.unique(np.asarray(keys, np.uint64))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.keys >> np.uint64(64 - _TABLE_BITS)] = True

    def found(self, x: np.ndarray) -> np.ndarray:
        """Indexes of the members among x."""
        maybe = np.flatnonzero(self.table[x >> np.uint64(64 - _TABLE_BITS)])
        if not len(maybe):
            return maybe
        at = np.searchsorted(self.keys, x[maybe])
        return maybe[self.keys[np.minimum(at, len(self.keys) - 1)] == x[maybe]]


@dataclass
class Index:
    """Fingerprints and exact spans of one block of the benchmark."""

    prints: _Set
    short: dict[int, _Set]
    spans: dict[bytes, tuple]
    span: int
    gram: int

    @classmethod
    def of(cls, items: list[tuple], span: int = SPAN, gram: int = GRAM) -> Index:
        spans: dict[bytes, set] = {}
        prints: list[np.ndarray] = []
        short: dict[int, list[np.ndarray]] = {}
        for item_id, text in items:
            for _, values in steps(pa.array([text], pa.large_string())):
                words = Words(values, ALNUM)
                n = len(words.hashes)
                if not n:
                    continue
                size = min(n, span)
                for i in range(n - size + 1):
                    spans.setdefault(words.phrase(i, size), set()).add(item_id)
                if size == span:
                    grams = words.grams(gram)
                    prints.append(grams[winnowed(grams, span - gram + 1)])
                else:
                    short.setdefault(size, []).append(words.grams(size))
        join = lambda xs: _Set(np.concatenate(xs) if xs else [])
        return cls(join(prints), {n: join(x) for n, x in short.items()}, {k: tuple(v) for k, v in spans.items()}, span, gram)

    def hits(self, words: Words) -> dict[int, tuple[list[tuple[int, int]], set]]:
        """By text of the slice: verified spans as (first word, words) and the items they come from."""
        at: list[tuple[int, int]] = []
        if len(self.prints.keys):
            grams = words.grams(self.gram)
            # a window that reaches into the next text only adds places: each text keeps its own
            places = winnowed(grams, self.span - self.gram + 1)
            for p in places[self.prints.found(grams[places])].tolist():
                at += [(i, self.span) for i in range(p - self.span + self.gram, p + 1)]
        for n, keys in self.short.items():
            at += [(p, n) for p in keys.found(words.grams(n)).tolist()]
        out: dict[int, tuple[list, set]] = {}
        for i, n in sorted(set(at)):
            if i < 0 or i + n > len(words.hashes):
                continue
            text = int(np.searchsorted(words.first, i, "right")) - 1
            if i + n > words.first[text + 1]:
                continue
            if (items := self.spans.get(words.phrase(i, n))) is not None:
                spans, ids = out.setdefault(text, ([], set()))
                spans.append((i - int(words.first[text]), n))
                ids.update(items)
        return out


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Union of (first, count) spans as [first, end) pairs in order."""
    out: list[list[int]] = []
    for first, count in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], first + count)
        else:
            out.append([first, first + count])
    return out


def _marker(index: Index, text_col: str, names: list[str], out: str, before: str | None):
    def run(batches):
        for batch in batches:
            texts = batch.column(text_col)
            earlier = batch.column(before).to_pylist() if before else None
            rows = []
            for first, values in steps(texts):
                words = Words(values, ALNUM)
                hits = index.hits(words)
                counts = np.diff(words.first).tolist()
                for k, n in enumerate(counts):
                    spans, ids = hits.get(k, ((), ()))
                    spans = list(spans)
                    ids = {x for x in ids if x is not None}
                    if earlier:
                        old = earlier[first + k]
                        spans += [(a, b - a) for a, b in old["hit_spans"]]
                        ids |= set(old["item_ids"])
                    rows.append({"n_words": n, "hit_spans": merged(spans), "item_ids": sorted(ids)})
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, _ARROW)], names=[*names, out])

    return run


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The benchmark in blocks of about ``block_bytes``, one in the driver's memory at a time."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).head()[0] or 0
    n = -(-2 * total // block_bytes) if total > block_bytes else 1
    if n == 1:
        yield [tuple(r) for r in items.collect()]
        return
    parts = staged(items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n))), "benchmark")
    for k in range(n):
        yield [tuple(r) for r in parts.where(F.col("b") == k).select("i", "t").collect()]


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, str]:
    """``docs`` with one more struct column (n_words, hit_spans, item_ids), and its name.

    hit_spans are the [first, end) word positions that lie in a span of the benchmark."""
    ship(docs.sparkSession)
    names, out, before, written = list(docs.columns), fresh(docs, "contamination"), None, None
    for k, items in enumerate(blocks_of(benchmark, item_id_col, item_text_col, block_bytes)):
        if k:  # each further block adds to what the earlier ones found
            docs = staged(docs, f"contamination-{k}")
            if written is not None:
                drop_staged(written)
            written = docs
        before = out if k else None
        schema = T.StructType([*[docs.schema[c] for c in names], T.StructField(out, RESULT)])
        docs = docs.mapInArrow(trimmed(_marker(Index.of(items, span, gram), text_col, names, out, before)), schema)
    return docs, out


def hit_words(found: str):
    """Number of hit words, as a Column over the struct that ``mark`` adds."""
    return F.aggregate(F.col(found)["hit_spans"], F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Only the documents in which no benchmark span occurs, with their own columns."""
    marked, found = mark(docs, benchmark, **options)
    return marked.where(F.size(F.col(found)["hit_spans"]) == 0).drop(found)


def digest(item_ids: list[int]) -> str:
    """Lowercase sha256 of the ids, sorted as strings and joined by commas (for tests)."""
    return hashlib.sha256(",".join(sorted(map(str, item_ids))).encode()).hexdigest()
