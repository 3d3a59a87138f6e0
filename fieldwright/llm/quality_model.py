"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Words are runs of letters, digits and anything beyond ASCII, or runs of other signs.  Features
are hashed words and pairs of words (A-Z lower-cased), and the same of their shapes: letter case,
digits, length class, first sign, and whether a word repeats the one before it.  A text's counts
are scaled to length one; the last features tell the length class of the whole text.

Training reads about ``most_rows`` labelled documents outside the held-out fold (the documented
bound; chosen by a hash of the id, one text for an id).  They lie in ``shards``; in each round
every shard goes on from the common state over its own rows, one update after the other, and the
changes of the state (z and n of each feature) are averaged.  So a round is one Spark job without
a shuffle, and the driver gets two numbers for each of 2**BITS features from each shard at most,
however many rows there are.

A score is a sparse dot product with the weights, a table of 2**BITS numbers that is broadcast.

Defined cases: a null text counts as empty and is scored by its length class; a null id is not
held out and not learnt from; null labels teach nothing; of several labels of one id the
majority counts (a tie is 1), of several texts the first in order; without labels every score is
0.5; columns of any other name are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop_staged, fresh, ship, staged_by, steps, trimmed
from .words import _BYTE, LOWER, _power_tables, mixed

BITS, LENGTHS = 18, 40
SIZE = (1 << BITS) + LENGTHS
MOST_ROWS, SHARDS, ROUNDS = 20_000, 8, 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.0, 0.1

#: Classes of bytes: 0 white space and control, 1 parts of words, 2 other signs.
_CLASS = np.array([0 if b <= 0x20 or b == 0x7F else 1 if b >= 0x80 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
_STEP = np.uint64(0xD1342543DE82EF95)


def is_held_out(id_col: str = "doc_id") -> Column:
    """The fold whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Features:
    """Feature numbers of every n-gram of a slice of texts, and the text each lies in."""

    def __init__(self, values: pa.Array):
        offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        whole = values.buffers()[2]
        data = bytes(memoryview(whole)[int(offsets[0]) : int(offsets[-1])]) if whole is not None else b""
        offs, raw, low = offsets - offsets[0], np.frombuffer(data, np.uint8), np.frombuffer(data.translate(LOWER), np.uint8)
        kind = _CLASS[raw]
        begin, end = kind > 0, kind > 0
        begin[1:] &= kind[1:] != kind[:-1]
        end[:-1] &= kind[:-1] != kind[1:]
        edges = offs[(offs > 0) & (offs < len(raw))]
        begin[edges] = kind[edges] > 0
        end[edges - 1] = kind[edges - 1] > 0
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        power, inverse = _power_tables(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[low] * power[: len(raw)], out=total[1:])
        words = mixed((total[ends] - total[starts]) * inverse[starts])
        of = np.searchsorted(offs[1:], starts, side="right")
        held = lambda mask: np.concatenate([[0], np.cumsum(mask[raw])])
        upper, digit = held(_UPPER), held(_DIGIT)
        n, uppers, digits = ends - starts, upper[ends] - upper[starts], digit[ends] - digit[starts]
        shape = np.where(kind[starts] == 2, 16 + raw[starts].astype(np.int64), _UPPER[raw[starts]] + 2 * (uppers > 1) + 4 * (uppers == n) + 8 * (digits > 0))
        shape = (shape * 8 + np.minimum(n // 4, 7)).astype(np.uint64) + np.uint64(1)
        near = of[1:] == of[:-1]
        again = (words[1:] == words[:-1]).astype(np.uint64)
        pairs, shapes = mixed(words[:-1] * _STEP + words[1:])[near], mixed((shape[:-1] * np.uint64(8192) + shape[1:]) * np.uint64(2) + again + np.uint64(1 << 40))[near]
        self.number = (np.concatenate([words, pairs, mixed(shape), shapes]) >> np.uint64(64 - BITS)).astype(np.int64)
        self.text = np.concatenate([of, of[1:][near], of, of[1:][near]])
        self.texts = len(values)
        self.length = np.minimum(np.ceil(np.log2(np.bincount(of, minlength=self.texts) + 1)), LENGTHS - 1).astype(np.int64) + (1 << BITS)

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct features of each text, in order: the text, the number and the scaled count."""
        key, n = np.unique((self.text << BITS) | self.number, return_counts=True)
        text = key >> BITS
        norm = np.sqrt(np.bincount(text, weights=n.astype(np.float64) ** 2, minlength=self.texts))
        return text, key & ((1 << BITS) - 1), n / norm[text]

    def dots(self, weights: np.ndarray) -> np.ndarray:
        text, number, value = self.counted()
        return np.bincount(text, weights=weights[number] * value, minlength=self.texts) + weights[self.length]


def chance(dots: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(dots, -35, 35)))


def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the regularised leader for a state."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def follow(z: np.ndarray, n: np.ndarray, at: np.ndarray, value: np.ndarray, label: int) -> None:
    """One row's update of the state, in place."""
    w = leader(z[at], n[at])
    g = (chance(w @ value) - label) * value
    z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
    n[at] += g * g


def _featurer(batches):
    for batch in batches:
        labels, ranks = batch.column("label"), batch.column("rank")
        for at, values in steps(batch.column("text")):
            features = Features(values)
            text, number, value = features.counted()
            ends = np.searchsorted(text, np.arange(len(values) + 1))
            numbers = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(number, pa.int32()))
            shares = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value, pa.float32()))
            here = slice(at, at + len(values))
            yield pa.RecordBatch.from_arrays([ranks[here], labels[here], numbers, shares, pa.array(features.length, pa.int32())], names=["rank", "label", "numbers", "shares", "length"])


def _follower(state):
    def run(batches):
        z0, n0 = state.value
        z, n, shard = z0.copy(), n0.copy(), None
        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("shard", "label", "numbers", "shares", "length")))
            for which, label, numbers, shares, length in rows:
                if shard is not None and which.as_py() != shard:
                    yield _change(shard, z, n, z0, n0)
                    z, n = z0.copy(), n0.copy()
                shard = which.as_py()
                at = np.append(numbers.values.to_numpy(), length.as_py())
                follow(z, n, at, np.append(shares.values.to_numpy().astype(np.float64), 1.0), label.as_py())
        if shard is not None:
            yield _change(shard, z, n, z0, n0)

    return run


def _change(shard: int, z, n, z0, n0) -> pa.RecordBatch:
    moved = np.flatnonzero((n != n0) | (z != z0))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(moved), shard), pa.int8()), pa.array(moved, pa.int32()), pa.array((z - z0)[moved].astype(np.float32)), pa.array((n - n0)[moved].astype(np.float32))],
        names=["shard", "number", "z", "n"],
    )


def labelled(docs: DataFrame, labels: DataFrame, most_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(rank, label, text): one text of about ``most_rows`` labelled ids, in the order of a hash."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("double").alias("label")).where(F.col("i").isNotNull() & F.col("label").isNotNull())
    known = known.where(~is_held_out("i")).groupBy("i").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    total = known.count()
    if total > most_rows:
        known = known.where(F.pmod(F.xxhash64("i"), F.lit(1_000_000)) < max(1, 1_000_000 * most_rows // total))
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chosen = rows.join(F.broadcast(known), "i")  # about most_rows small rows, whatever the tables hold
    chosen = chosen.groupBy("i").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return chosen.select(F.xxhash64("i", F.lit("order")).alias("rank"), "label", "text")


def train(
    docs: DataFrame,
    labels: DataFrame,
    most_rows: int = MOST_ROWS,
    shards: int = SHARDS,
    rounds: int = ROUNDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> np.ndarray:
    """Weights of all features, from labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    ship(spark)
    rows = labelled(docs, labels, most_rows, id_col, text_col, label_col)
    rows = rows.mapInArrow(trimmed(_featurer), "rank long, label int, numbers array<int>, shares array<float>, length int")
    rows = rows.withColumn("shard", F.pmod("rank", F.lit(shards)).cast("int")).repartition(shards, "shard")
    path = staged_by(rows.sortWithinPartitions("shard", "rank"), "quality-rows", "shard")
    each = [path.where(F.col("shard") == k).coalesce(1) for k in range(shards)]  # a shard is one task, without a shuffle
    in_order = reduce(DataFrame.unionByName, each).sortWithinPartitions("shard", "rank")
    z, n = np.zeros(SIZE), np.zeros(SIZE)
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((z, n))
        got = in_order.mapInArrow(trimmed(_follower(state)), "shard byte, number int, z float, n float").toArrow().sort_by("shard")
        at = got.column("number").to_numpy()
        for total, name in ((z, "z"), (n, "n")):  # added in the order of shards, so that sums repeat
            total += np.bincount(at, weights=got.column(name).to_numpy(), minlength=SIZE) / shards
        del got, at
        state.unpersist()
    drop_staged(path)
    return leader(z, n).astype(np.float32)


def _scorer(weights, text_col: str, names: list[str], out: str):
    def run(batches):
        for batch in batches:
            scores = [chance(Features(values).dots(weights.value)) for _, values in steps(batch.column(text_col).cast(pa.large_string()))]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(scores, pa.float64())], names=[*names, out])

    return run


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, the chance of label 1, and its name; no shuffle."""
    ship(docs.sparkSession)
    names, out = list(docs.columns), fresh(docs, "quality")
    shipped = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.mapInArrow(trimmed(_scorer(shipped, text_col, names, out)), T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])), out
