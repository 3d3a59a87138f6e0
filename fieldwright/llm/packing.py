"""Packing documents into fixed-length sequences by cutting-stock column generation.

1. Every document is encoded once; full-length pieces are cut off its front, so that one
   remainder per document is shorter than a sequence.  The pieces (no ids) are stored with
   a checksum of each prefix, every ``GRAIN`` ids, from which the checksum of any later cut
   follows.
2. A histogram of piece lengths in ``unit``-sized classes (at most capacity / unit numbers)
   goes to the driver.  Column generation solves the cutting-stock linear program: its
   columns are patterns (how many pieces of each class share a sequence), priced by a
   knapsack dynamic program against the dual prices of the classes.
3. Rounded-down multiplicities of the patterns plus first-fit patterns for the rest give
   exact places for every rank of every class.  A piece's rank (its part's offset in its
   class plus its rank in the part) thus tells its sequence without any search.
4. Sequences are finished in blocks of consecutive numbers, a few hundred a task: the last
   sequences of a block are taken apart and cut to fill the room that the rounding of
   lengths to classes has left in the others.  A sequence so lacks less than ``GRAIN``
   ids, but for one of each block.

Defined cases: a null or empty text is the end id alone; equal rows are packed one by one;
a null doc_id stays null; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, staged, steps, text_rows, trimmed
from .tokenize import END, path_of, word_encoder

CAPACITY, UNIT = 4096, 32
#: Ids between stored checksums; cuts are made at these places only.
GRAIN = 16
#: Sequences finished together in one task's memory.
BLOCK = 512

PIECES = "doc_id long, start long, length long, doc_tokens long, kind int, part int, rank long, crcs binary"
_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("rank", pa.int64()), ("crcs", pa.binary())]
)
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_RESULT = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


# Checksums of cuts ---------------------------------------------------------------------

_POLY = 0xEDB88320


def _times(matrix: list[int], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


def _zero_operators() -> list[list[int]]:
    """Operators that move a crc32 past 2**k zero bytes."""
    bit = [_POLY, *[1 << k for k in range(31)]]
    double = lambda m: [_times(m, m[k]) for k in range(32)]
    byte = double(double(double(bit)))
    out = [byte]
    for _ in range(40):
        out.append(double(out[-1]))
    return out


_ZEROS = _zero_operators()


def crc_between(before: int, until: int, n_bytes: int) -> int:
    """crc32 of the n_bytes between two prefixes, from the prefixes' own."""
    k = 0
    while n_bytes:
        if n_bytes & 1:
            before = _times(_ZEROS[k], before)
        n_bytes >>= 1
        k += 1
    return until ^ before


def prefix_crcs(ids: np.ndarray) -> np.ndarray:
    """crc32 after every GRAIN ids, and after the last."""
    raw, step, out, crc = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), 4 * GRAIN, [], 0
    for lo in range(0, len(raw), step):
        crc = zlib.crc32(raw[lo : lo + step], crc)
        out.append(crc)
    return np.array(out, "<u4")


# Encoding and cutting off full pieces --------------------------------------------------


def _cutter(vocabulary: str, capacity: int, unit: int):
    def run(batches):
        encoder, part, ranks = word_encoder(vocabulary), TaskContext.get().partitionId(), {}
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for at, values in steps(batch.column("text")):
                ids, offsets = encoder.encode(values, END)
                rows = []
                for k in range(len(values)):
                    own = ids[offsets[k] : offsets[k + 1]]
                    for start in range(0, len(own), capacity):
                        piece = own[start : start + capacity]
                        kind = -(-len(piece) // unit)
                        ranks[kind] = rank = ranks.get(kind, -1) + 1
                        # full pieces stay whole unless a block's last sequences are taken apart
                        rows.append((ids_of[at + k], start, len(piece), len(own), kind, part, rank, prefix_crcs(piece).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    return run


# The cutting-stock program --------------------------------------------------------------


def priced_pattern(prices: np.ndarray, room: int) -> tuple[np.ndarray, float]:
    """The most valuable pattern: an unbounded knapsack over classes 1..len(prices)."""
    n = len(prices)
    best, last = np.zeros(room + 1), np.zeros(room + 1, int)
    for r in range(1, room + 1):
        most = min(n, r)
        values = prices[:most] + best[r - 1 :: -1][:most]
        k = int(np.argmax(values))
        best[r], last[r] = (values[k], k + 1) if values[k] > best[r - 1] else (best[r - 1], 0)
    pattern, r = np.zeros(n, np.int64), room
    while r > 0:
        if last[r]:
            pattern[last[r] - 1] += 1
            r -= last[r]
        else:
            r -= 1
    return pattern, float(best[room])


def relaxed_patterns(demand: np.ndarray, room: int, most_columns: int = 3000, patience: int = 150, tolerance: float = 1e-6) -> list[tuple[np.ndarray, float]]:
    """Patterns and multiplicities of the linear program min sum(x), A x = demand, x >= 0.

    Revised simplex from the one-class patterns; each entering column is the knapsack's.
    Demands are shifted by less than a piece so that no step is void.  Stopping early (after
    ``most_columns``, or ``patience`` columns without gain) leaves a feasible, only dearer,
    solution."""
    present = np.flatnonzero(demand)
    if not len(present):
        return []
    m = len(present)
    counts = [room // (c + 1) for c in present]
    basis = np.diag(np.array(counts, float))
    inverse = np.diag(1.0 / np.array(counts, float))
    wanted = demand[present] + 1e-3 * (1 + np.random.default_rng(1).random(m))
    x = wanted / np.array(counts, float)
    best, since = x.sum(), 0
    for _ in range(most_columns):
        duals = inverse.sum(axis=0)
        prices = np.zeros(len(demand))
        prices[present] = duals
        pattern, value = priced_pattern(np.maximum(prices, 0), room)
        if value <= 1 + tolerance:
            break
        column = pattern[present].astype(float)
        direction = (inverse * column).sum(axis=1)  # small: no threaded product
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, direction, 1), np.inf)
        leave = int(np.argmin(ratio))
        amount = ratio[leave]
        x = np.maximum(x - amount * direction, 0)
        x[leave] = amount
        basis[:, leave] = column
        pivot = inverse[leave] / direction[leave]
        inverse -= direction[:, None] * pivot
        inverse[leave] = pivot
        since = 0 if x.sum() < best * (1 - 1e-6) else since + 1
        best = min(best, x.sum())
        if since > patience:
            break
    out = []
    for j in range(m):
        if x[j] > 0:
            pattern = np.zeros(len(demand), np.int64)
            pattern[present] = np.rint(basis[:, j]).astype(np.int64)
            out.append((pattern, float(x[j])))
    return out


def whole_patterns(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole multiplicities whose places are exactly the demanded pieces."""
    left, out = demand.astype(np.int64).copy(), []
    for pattern, x in relaxed_patterns(demand, room):
        fits = left[pattern > 0] // pattern[pattern > 0]
        times = min(int(x), int(fits.min()))
        if times > 0:
            out.append((pattern, times))
            left -= times * pattern
    # few pieces of each class are left: fill sequences largest first
    while left.any():
        pattern, r = np.zeros(len(demand), np.int64), room
        for c in np.flatnonzero(left)[::-1]:
            n = min(int(left[c]), r // (c + 1))
            pattern[c], r = n, r - n * (c + 1)
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        out.append((pattern, times))
        left -= times * pattern
    return out


def places(patterns: list[tuple[np.ndarray, int]]) -> dict[int, list[tuple[int, int, int]]]:
    """By class: (first rank, first sequence, sequences), in rank order; a run of ranks is dealt
    round the sequences of its pattern."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        for c in np.flatnonzero(pattern).tolist():
            first = used.get(c, 0)
            out.setdefault(c + 1, []).append((first, sequence, times))
            used[c] = first + times * int(pattern[c])
        sequence += times
    return out


# Finishing blocks of sequences ------------------------------------------------------------


def finished(rows: list[tuple], block: int, capacity: int) -> list[tuple]:
    """Final pieces of a block.  rows: (sequence, doc_id, start, length, doc_tokens, crcs)."""
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r[0], []).append(r)
    kept = []
    for members in sequences.values():
        members.sort(key=lambda r: (-r[3], r[1] is None, r[1] or 0, r[2], r[5]))
        kept.append((sum(r[3] for r in members), members))
    kept.sort(key=lambda s: (s[0], s[1][0][3], s[1][0][1] is None, s[1][0][1] or 0, s[1][0][2]))
    # take apart the least filled sequences until their ids fit the others' room
    room = sum(capacity - n for n, _ in kept)
    spare: list[tuple] = []
    have, cut = 0, 0
    while cut < len(kept) and have < room:
        room -= capacity - kept[cut][0]
        have += kept[cut][0]
        spare += kept[cut][1]
        cut += 1
    out: list[tuple] = []
    pool = [(r, 0) for r in sorted(spare, key=lambda r: (r[3], r[1] is None, r[1] or 0, r[2], r[5]))]
    number = 0

    def emit(piece, first: int, end: int, offset: int) -> None:
        _, doc_id, start, length, doc_tokens, crcs = piece
        crc = np.frombuffer(crcs, "<u4")
        at = lambda i: 0 if i == 0 else int(crc[-(-i // GRAIN) - 1])
        value = crc_between(at(first), at(end), 4 * (end - first)) if first else at(end)
        out.append((doc_id, start + first, end - first, value, doc_tokens, block * 2 * BLOCK + number, offset))

    def fill(offset: int, limit: int) -> int:
        """Lay spare pieces from offset on, cutting the last where it does not fit."""
        while pool and offset < limit:
            piece, first = pool.pop()
            free = limit - offset
            rest = piece[3] - first
            if rest <= free:
                emit(piece, first, piece[3], offset)
                offset += rest
                continue
            n = free // GRAIN * GRAIN
            if n:
                emit(piece, first, first + n, offset)
                offset += n
                pool.append((piece, first + n))
                break
            pool.append((piece, first))
            break
        return offset

    for _, members in kept[cut:]:
        offset = 0
        for r in members:
            emit(r, 0, r[3], offset)
            offset += r[3]
        fill(offset, capacity)
        number += 1
    while pool:
        fill(0, capacity)
        number += 1
    return out


def _finisher(capacity: int):
    def run(key, table):
        cols = [table.column(c).to_pylist() for c in ("sequence", "doc_id", "start", "length", "doc_tokens", "crcs")]
        rows = finished(list(zip(*cols)), key[0].as_py(), capacity)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT)], schema=_RESULT)

    return run


def pack(
    docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces with their sequence and place there: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.  Every id of every document is in exactly one piece."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = vocabulary or path_of("word_bpe_49k.json")
    rows = text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    pieces = staged(rows.mapInArrow(trimmed(_cutter(vocabulary, capacity, unit)), PIECES), "pieces")
    by_part = pieces.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n"))
    # at most capacity / unit classes, whatever the data
    demand = np.zeros(capacity // unit, np.int64)
    for kind, n in by_part.groupBy("kind").agg(F.sum("n")).collect():
        demand[kind - 1] = n
    runs = places(whole_patterns(demand, capacity // unit))
    before = F.sum("n").over(Window.partitionBy("kind").orderBy("part")) - F.col("n")
    base = by_part.select("kind", "part", before.alias("base"))
    plan = spark.createDataFrame([(k, [list(r) for r in v]) for k, v in runs.items()], "kind int, runs array<array<long>>")
    # the run that holds a rank is the last that begins at or before it
    run = F.element_at(F.filter("runs", lambda r: r[0] <= F.col("at")), -1)
    placed = (
        pieces.join(base, ["kind", "part"])
        .join(F.broadcast(plan), "kind")  # one row per class
        .withColumn("at", F.col("base") + F.col("rank"))
        .withColumn("run", run)
        .withColumn("sequence", F.col("run")[1] + (F.col("at") - F.col("run")[0]) % F.col("run")[2])
        .select(F.floor(F.col("sequence") / BLOCK).cast("long").alias("block"), "sequence", "doc_id", "start", "length", "doc_tokens", "crcs")
    )
    return placed.groupBy("block").applyInArrow(_finisher(capacity), RESULT)
