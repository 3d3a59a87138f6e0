"""Source divergence audit: how far each source's words lie from its language's and from other sources'.

Terms are runs of ASCII letters and of anything beyond ASCII, only A-Z lower-cased.  A language
keeps the terms that at least ``least_docs`` of its documents hold.  The way there:

1. Each task adds the document frequencies of its terms to a count-min sketch over (language,
   term), sent as sparse blocks; blocks are merged where Spark shuffles them to, and of every
   cell one bit is left: has it reached ``least_docs``?  A cell never holds less than any of its
   terms, so a term with an unset bit cannot be kept.
2. A second scan drops such terms inside the tasks; only the rest is shuffled and counted exactly.
3. Shares are whole numbers.  The distance of two sources over all kept terms comes from the
   terms that they hold: what neither holds differs by one constant, what one holds is summed
   from a histogram of that source, and a sparse join on (language, term) adds what both hold.

The sketch grows with the bytes of text (a cell for every ``BYTES_A_CELL``) up to ``most_cells``
a row; beyond it fewer terms are dropped early and results stay the same.  As bits it is at most
2 * most_cells / 8 bytes, the bound of what is broadcast.

Defined cases: null text, language or source is the empty string; a group without terms counts
0 of each kept term; a language without kept terms has distances 0 and no term rows; equal
values rank by the bytes of their item; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_staged, ship, staged, steps, trimmed
from .words import _BYTE, LOWER, _power_tables, mixed

LEAST_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
BYTES_A_CELL, MOST_CELLS = 32, 1 << 28
#: Rows of the sketch, cells of one block, and bytes of text between two sendings of a task's blocks.
ROWS, BLOCK, FLUSH = 2, 1 << 14, 1 << 25
STEP = 1 << 23

_TERM = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


class Terms:
    """The terms of a slice of texts: distinct ones, and the number and the text of each occurrence."""

    def __init__(self, values: pa.Array):
        offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        whole = values.buffers()[2]
        data = bytes(memoryview(whole)[int(offsets[0]) : int(offsets[-1])]) if whole is not None else b""
        raw = np.frombuffer(data.translate(LOWER), np.uint8)
        offs = offsets - offsets[0]
        inside = _TERM[raw]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = offs[(offs > 0) & (offs < len(raw))]
        begin[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
        starts = np.flatnonzero(begin)
        lengths = np.flatnonzero(end) + 1 - starts
        self.text = np.searchsorted(offs[1:], starts, side="right")
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw[inside])])
        coded = terms.dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def hashes(self) -> np.ndarray:
        """A 64-bit number of each distinct term."""
        n = len(self.words)
        offs = np.frombuffer(self.words.buffers()[1], np.int64)[self.words.offset : self.words.offset + n + 1]
        if not n:
            return np.zeros(0, np.uint64)
        raw = np.frombuffer(self.words.buffers()[2], np.uint8)[offs[0] : offs[-1]]
        offs = offs - offs[0]
        power, inverse = _power_tables(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
        return mixed((total[offs[1:]] - total[offs[:-1]]) * inverse[offs[:-1]])

    def counted(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text group and term: the group, the term, its occurrences and its texts."""
        k = max(1, len(self.words))
        pairs, often = np.unique(self.text * k + self.code, return_counts=True)  # one of a text and a term
        key = group[pairs // k] * k + pairs % k
        order = np.argsort(key, kind="stable")
        key, often = key[order], often[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        n = np.add.reduceat(often, first) if len(key) else often
        return key[first] // k, key[first] % k, n, np.diff(np.append(first, len(key)))


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.sha256(lang.encode("utf-8", "surrogatepass")).digest()[:8], "little")


def _cells(hashes: np.ndarray, seeds: np.ndarray, bits: int) -> np.ndarray:
    """Cell numbers of (language, term) pairs, one line for each row of the sketch."""
    found = np.empty((ROWS, len(hashes)), np.int64)
    for r in range(ROWS):
        h = mixed(mixed(hashes ^ seeds) + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % 2**64))
        found[r] = (h >> np.uint64(64 - bits)).astype(np.int64) + (r << bits)
    return found


def _names(column: pa.Array) -> tuple[list[str], np.ndarray]:
    coded = pc.dictionary_encode(column)
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _sketcher(bits: int):
    def sent(held: list) -> pa.RecordBatch:
        cells, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        counts = np.minimum(np.bincount(at, weights=np.concatenate([n for _, n in held])), 255).astype(np.uint8)
        blocks, first = np.unique(cells // BLOCK, return_index=True)
        inner, ends = (cells % BLOCK).astype(np.uint16), np.append(first, len(cells))
        spans = list(zip(ends, ends[1:]))
        return pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int64()), pa.array([inner[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())],
            names=["block", "cells", "counts"],
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            langs, lang = _names(batch.column("lang"))
            seeds = np.array([_seed(x) for x in langs], np.uint64)
            for at, values in steps(batch.column("text"), STEP):
                terms = Terms(values)
                of, code, _, docs = terms.counted(lang[at : at + len(values)])
                if len(of):
                    cells = _cells(terms.hashes()[code], seeds[of], bits)
                    held.append((cells.ravel(), np.tile(docs, ROWS)))
                size += values.nbytes
                if size > FLUSH and held:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)

    return run


def _merger(least: int):
    def run(batches):
        block, total = None, None
        for batch in batches:
            for b, cells, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "cells", "counts"))):
                if b != block:
                    if block is not None:
                        yield _bits(block, total, least)
                    block, total = b, np.zeros(BLOCK, np.int64)
                total[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.uint8)
        if block is not None:
            yield _bits(block, total, least)

    return run


def _bits(block: int, total: np.ndarray, least: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["block", "bits"])


def _counter(shipped, bits: int):
    def run(batches):
        reached = np.frombuffer(shipped.value, np.uint8)
        for batch in batches:
            (langs, lang), (sources, source) = _names(batch.column("lang")), _names(batch.column("source"))
            seeds = np.array([_seed(x) for x in langs], np.uint64)
            for at, values in steps(batch.column("text"), STEP):
                terms = Terms(values)
                here = slice(at, at + len(values))
                of, code, n, docs = terms.counted(lang[here] * len(sources) + source[here])
                cells = _cells(terms.hashes()[code], seeds[of // len(sources)], bits)
                keep = np.flatnonzero((reached[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).all(axis=0))
                of, code = of[keep], code[keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(langs, pa.string()).take(pa.array(of // len(sources))),
                        pa.array(sources, pa.string()).take(pa.array(of % len(sources))),
                        terms.words.take(pa.array(code)).cast(pa.large_string()).cast(pa.string()),
                        pa.array(n[keep], pa.int64()),
                        pa.array(docs[keep], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

    return run


def possible(rows: DataFrame, bits: int, least_docs: int) -> bytes:
    """One bit for each cell of the merged sketch: whether it has reached ``least_docs``."""
    if least_docs > 255:
        raise ValueError("cells of a task hold up to 255, so least_docs can be 255 at most")
    parts = rows.select("lang", "text").mapInArrow(trimmed(_sketcher(bits)), "block long, cells binary, counts binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(trimmed(_merger(least_docs)), "block long, bits binary")
    out = bytearray(ROWS * (1 << bits) // 8)
    got = merged.toArrow()
    for block, found in zip(got.column("block").to_pylist(), got.column("bits").to_pylist()):
        out[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = found
    return bytes(out)


def term_counts(rows: DataFrame, least_docs: int = LEAST_DOCS, size: int = 0, most_cells: int = MOST_CELLS) -> DataFrame:
    """Exact (lang, source, term, n, docs) of all terms that the sketch cannot rule out."""
    spark = rows.sparkSession
    ship(spark)
    bits = max(BLOCK.bit_length() - 1, min(max(1, size // BYTES_A_CELL).bit_length(), most_cells.bit_length() - 1))
    shipped = spark.sparkContext.broadcast(possible(rows, bits, least_docs))
    found = rows.mapInArrow(trimmed(_counter(shipped, bits)), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * wide(n + PRIOR)
    return (F.lit(1) + F.call_function("div", above, wide(total + PRIOR * terms))).cast("long")


def audit(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
    most_cells: int = MOST_CELLS,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part ``pair`` has every other source of the
    language with its distance, part ``term`` the terms a source uses more than its language does."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).alias("text"))
    sizes = staged(rows.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("bytes")), "divergence-groups")
    size = sizes.agg(F.sum("bytes")).head()[0] or 0
    counts = staged(term_counts(rows, least_docs, size, most_cells), "divergence-counts")

    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
    kept = staged(kept.drop("docs"), "divergence-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    found = counts.drop("docs").join(kept, ["lang", "term"])
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("long")
    groups = sizes.drop("bytes").join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["terms", "lang_total", "total"])
    groups = groups.withColumn("zero", F.when(F.col("terms") > 0, share(none, F.col("total"), F.col("terms"))).otherwise(none))
    groups = staged(groups, "divergence-shares")
    found = found.join(groups, ["lang", "source"])
    found = found.select(
        "lang",
        "source",
        "term",
        "zero",
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    found = staged(found, "divergence-rows")
    drop_staged(counts)
    drop_staged(kept)
    return _pairs(groups, found).unionByName(_terms(found, top))


def _ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    out = rows.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= top) if top else out


def _terms(found: DataFrame, top: int) -> DataFrame:
    more = found.where(F.col("p") > F.col("q"))
    return _ranked(more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), top)


def _pairs(groups: DataFrame, found: DataFrame) -> DataFrame:
    """Distance of each ordered pair of sources of a language (these pairs are the result)."""
    mine, other = groups.select("lang", "source", "terms", "zero"), groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    apart = F.abs(F.col("zero") - F.col("other"))
    both = mine.join(other, "lang").where(F.col("source") != F.col("item"))
    neither = both.select("lang", "source", "item", (F.col("terms") * apart).alias("value"))
    held = found.groupBy("lang", "source", "zero", "p").agg(F.count(F.lit(1)).alias("m")).join(other, "lang").where(F.col("source") != F.col("item"))
    held = held.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (F.abs(F.col("p") - F.col("other")) - apart)).alias("value"))
    a, b = found.select("lang", "term", "source", "zero", "p"), found.select("lang", "term", F.col("source").alias("item"), F.col("zero").alias("other"), F.col("p").alias("r"))
    shared = F.abs(F.col("p") - F.col("r")) - F.abs(F.col("p") - F.col("other")) - F.abs(F.col("zero") - F.col("r")) + apart
    met = a.join(b, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(shared).alias("value"))
    turned = lambda d: d.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = neither.unionByName(held).unionByName(turned(held)).unionByName(met).unionByName(turned(met))
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
