"""Jaccard self-join on word shingles, with count-vector R-trees.

A document's set holds the hashes of its distinct shingles; documents with one set form a
class (named by 128 bits), and the join runs over classes, the nodes.  Shingles are hashed
into ``GROUPS`` groups and the group counts of a set are a point.  For two points the sum of
coordinate minima bounds the overlap, and for a box of points the minima against its upper
corner do, so an R-tree over points prunes whole subtrees of a search.

To deal the work out, nodes meet in blocks: two sets with Jaccard t share a shingle among
the first n - ceil(t n) + 1 of each in any one order (shingles of rare words are ordered first,
frequent shingles last), so every link lies inside the block of some shingle.  The blocks with one least node are
one group, where a node lists the shingles by which it belongs there.  Groups can be huge
(near copies), hence two passes, exact together:

1. every member of a group is verified against two pivots, the group's least node and the
   one whose shingles the most others share; the links found join most of a near-copy group;
2. groups whose other members still lie in different components are searched with R-trees,
   large ones in tiles of about ``TILE`` nodes a side.  A node brings the shingles of all its
   open groups (of its one group, if those would take more than ``LISTED``), so that a pair is
   returned only if what both list and the rests beyond the prefixes allow the overlap; it is
   verified on the whole sets.  A tile with more than ``DENSE`` such pairs a node returns none:
   its members' whole sets are compared in one task, which returns a forest of the links
   between roots.  So no tile returns more than a multiple of its members.

Pairs inside one component are not looked at again, and no link that would join two
components is missed, so the components are those of all links.

Defined cases: a null text, or one without words, has an empty set and links with nothing;
fewer than ``SHINGLE`` words are one shingle; equal rows share a class; rows with a null
doc_id are returned and link with nothing; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import drop_staged, fresh, release_shuffles, ship, staged, steps, text_rows, trimmed
from .words import NOT_SPACE, Words, mixed

SHINGLE, PERCENT = 5, 80
GROUPS = 64
TILE = 512
#: Pairs a member that a tile returns; beyond them it is compared on whole sets.
DENSE = 4
#: Shingles that one node brings to all its groups together, but for those of each group.
LISTED = 1 << 16
#: Shingles of whole sets that one tile compares, about; one with more is cut into cells.
SHINGLES = 1 << 20
#: Rows of tiles that one call of the searcher holds, about.
GROUP_ROWS = 4096
#: Documents (about) from which frequent shingles are learnt, at least and as a share of all, and how
#: many are kept; they only order shingles and change no result.  A passage in a fixed share of the
#: documents makes groups that grow with them, and tiles with the square, unless it is learnt: so
#: the sample grows too.
SAMPLE, SAMPLED, FREQUENT = 2000, 16, 65_536
#: Slots of the table of word frequencies learnt from the same documents; it only orders shingles,
#: too.  Unlike texts share shingles of common words, the more of them the more texts there are, so
#: a prefix of rare words keeps their number in blocks from growing faster than the texts.
WORD_SLOTS = 1 << 18
#: Columns of one product when listed shingles are counted.
SLICE = 2048
#: Size of the bit table that may be broadcast (2 MB), and an eighth of it the most ids it stands for.
BITS = 1 << 24

_SALT = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(values: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice."""
    return _sets_of(Words(values, NOT_SPACE), size)


def _word_slots(words: Words) -> np.ndarray:
    return (words.hashes >> np.uint64(64 - WORD_SLOTS.bit_length() + 1)).astype(np.int64)


def _weighed_sets(values: pa.Array, size: int, weights: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """``shingle_sets``, and for each shingle the summed weights of its words."""
    words = Words(values, NOT_SPACE)
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(weights[_word_slots(words)], dtype=np.int64)])
    scores = []
    sets = _sets_of(words, size, sums[size:] - sums[:-size] if len(sums) > size else sums[:0], scores)
    return sets, scores


def _sets_of(words: Words, size: int, score: np.ndarray | None = None, scores: list[np.ndarray] | None = None) -> list[np.ndarray]:
    grams, first = words.grams(size), words.first.tolist()
    out = []
    for lo, hi in zip(first, first[1:]):
        if hi - lo >= size and score is not None:
            tokens, at = np.unique(grams[lo : hi - size + 1], return_index=True)
            out.append(tokens)
            scores.append(score[lo + at])
            continue
        if hi - lo >= size:
            out.append(np.unique(grams[lo : hi - size + 1]))
        elif hi > lo:
            whole = np.full(1, hi - lo, np.uint64)
            for k in range(lo, hi):
                whole = mixed((whole ^ words.hashes[k : k + 1]) * _SALT)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        if score is not None:
            scores.append(np.zeros(len(out[-1]), np.int64))
    return out


def point_of(tokens: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Group counts of a set; groups are the leading bits of the hashes."""
    shift = np.uint64(64 - groups.bit_length() + 1)
    return np.bincount((tokens >> shift).astype(np.int64), minlength=groups).astype("<i4")


def class_of(tokens: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of the set, for grouping equal sets."""
    sums = np.array([tokens.sum(dtype=np.uint64), mixed(tokens ^ _SALT).sum(dtype=np.uint64), len(tokens)], np.uint64)
    names = (np.bitwise_xor.reduce(mixed(sums * salt + np.arange(3, dtype=np.uint64))) for salt in (_SALT, _SALT + np.uint64(2)))
    first, second = (int(x.view(np.int64)) for x in names)
    return first, second


def _prefix(tokens: np.ndarray, frequent: np.ndarray, percent: int, score: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The first of a set's shingles: rare words first, then frequent shingles by their ``levels``."""
    n = len(tokens)
    keep = n - -(-percent * n // 100) + 1
    at = np.searchsorted(frequent, tokens)
    at = np.minimum(at, len(frequent) - 1)
    late = frequent[at] == tokens if len(frequent) else np.zeros(n, bool)
    if late.any():
        score = np.where(late, levels[at], score)
    # last an order of hashes other than their size, so that prefixes do not crowd into the first groups
    place = (late.astype(np.uint64) << np.uint64(63)) | (np.minimum(score, 2047).astype(np.uint64) << np.uint64(52)) | (mixed(tokens ^ _SALT) >> np.uint64(12))
    order = np.argsort(place, kind="stable")
    return tokens[order[:keep]]


_SKETCH = "doc_id long, tag long, n long, c1 long, c2 long, prefix array<long>, point array<int>"


def _names(sets: list[np.ndarray]) -> list[pa.Array]:
    names = np.array([class_of(s) for s in sets], np.int64).reshape(len(sets), 2)
    return [pa.array(names[:, 0]), pa.array(names[:, 1])]


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([np.zeros(0, values[0].dtype), *values]))) if values else pa.array([], pa.large_list(pa.int64()))


def _sketcher(size: int, percent: int, frequent, weights):
    """Prefix and point are given with the first of a task's equal sets only."""

    def run(batches):
        (often, levels), heavy, met = frequent.value, weights.value, set()
        for batch in batches:
            ids, tags = batch.column("doc_id"), batch.column("tag")
            for at, values in steps(batch.column("text")):
                sets, scores = _weighed_sets(values, size, heavy)
                held, c1, c2 = ids.slice(at, len(values)), *_names(sets)
                first = []
                for s, name, known in zip(sets, zip(c1.to_numpy(), c2.to_numpy()), held.is_valid().to_pylist()):
                    first.append(bool(len(s)) and known and name not in met)
                    if first[-1]:
                        met.add(name)
                none = np.zeros(0, np.int64)
                prefixes = _lists([_prefix(s, often, percent, score, levels).view(np.int64) if own else none for s, score, own in zip(sets, scores, first)])
                points = _lists([point_of(s) if own else none.astype("<i4") for s, own in zip(sets, first)])
                yield pa.RecordBatch.from_arrays(
                    [held, tags.slice(at, len(values)), pa.array([len(s) for s in sets], pa.int64()), c1, c2, prefixes.cast(pa.list_(pa.int64())), points.cast(pa.list_(pa.int32()))],
                    names=["doc_id", "tag", "n", "c1", "c2", "prefix", "point"],
                )

    return run


def _token_lister(size: int):
    def run(batches):
        for batch in batches:
            for _, values in steps(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(values, size)).view(np.int64))], names=["token"])

    return run


def _word_counter():
    """How many words of the texts fall into each slot, for slots that have some."""

    def run(batches):
        found = np.zeros(WORD_SLOTS, np.int64)
        for batch in batches:
            for _, values in steps(batch.column("text")):
                found += np.bincount(_word_slots(Words(values, NOT_SPACE)), minlength=WORD_SLOTS)
        slots = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(found[slots])], names=["slot", "n"])

    return run


def _word_weights(texts: DataFrame) -> np.ndarray:
    """By slot, four times the binary logarithm of how often its words are in the texts."""
    counted = texts.mapInArrow(trimmed(_word_counter()), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # at most WORD_SLOTS rows of two numbers
    weights = np.zeros(WORD_SLOTS, np.uint8)
    weights[got.column("slot").to_numpy()] = np.rint(4 * np.log2(1 + got.column("n").to_numpy())).astype(np.uint8)
    return weights


def _set_lister(size: int, wanted):
    """Sets of the documents whose id is in a bit table (of all, without one)."""

    def run(batches):
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(_in_bits(wanted.value, batch.column("slot").to_numpy())))
            for _, values in steps(batch.column("text")):
                sets = shingle_sets(values, size)
                tokens = _lists([s.view(np.int64) for s in sets]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*_names(sets), tokens], names=["c1", "c2", "tokens"])

    return run


def _in_bits(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _noded(named: DataFrame, clashes: DataFrame) -> DataFrame:
    """(c1, c2, ...) with the node of each: the first half of its name, but for classes that share
    this half.  Of n classes n * n / 2**65 are expected to do so; only they are broadcast."""
    other = F.col("kept").isNotNull() & (F.col("kept") != F.col("c2"))
    return named.join(F.broadcast(clashes), "c1", "left").withColumn("node", F.when(other, F.xxhash64("c1", "c2")).otherwise(F.col("c1"))).drop("kept")


def _sets_for(pairs: DataFrame, nodes: DataFrame, clashes: DataFrame, rows: DataFrame, size: int, bits: int) -> DataFrame:
    """(node, tokens): shingle sets of the nodes in some pairs, from one document each.

    Up to ``bits`` / 8 nodes their ids are sent as a bit table of ``bits`` bits, and the texts
    are scanned where they are (a few more sets than asked for do no harm); beyond that the
    texts are joined with the ids."""
    spark = rows.sparkSession
    ids = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(nodes, "node").select("doc_id").distinct()
    ids = staged(ids, "wanted")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    kind = "c1 long, c2 long, tokens array<long>"
    if ids.count() <= bits // 8:
        spots = ids.select(slot.alias("s")).selectExpr("cast(shiftright(s, 3) as int) as byte", "shiftleft(1, cast(s % 8 as int)) as bit")
        parts = spots.groupBy("byte").agg(F.bit_or("bit").alias("bits"))
        table = np.zeros(max(1, bits // 8), np.uint8)
        got = parts.toArrow()  # at most bits / 8 rows of two numbers
        table[got.column("byte").to_numpy()] = got.column("bits").to_numpy().astype(np.uint8)
        shipped = spark.sparkContext.broadcast(table)
        found = rows.select("text", slot.alias("slot")).mapInArrow(trimmed(_set_lister(size, shipped)), kind)
    else:
        found = rows.join(ids, "doc_id", "left_semi").select("text").mapInArrow(trimmed(_set_lister(size, None)), kind)
    return staged(_noded(found, clashes).select("node", "tokens"), "sets")


class RTree:
    """A packed R-tree over count vectors, searched by the overlap bound."""

    def __init__(self, points: np.ndarray, leaf: int = 16, fan: int = 8):
        order = np.arange(len(points))
        parts = [order]
        while max(map(len, parts), default=0) > leaf:  # halve by the widest coordinate
            halves = []
            for p in parts:
                if len(p) <= leaf:
                    halves.append(p)
                    continue
                axis = int(np.argmax(np.ptp(points[p], axis=0)))
                p = p[np.argsort(points[p, axis], kind="stable")]
                halves += [p[: len(p) // 2], p[len(p) // 2 :]]
            parts = halves
        sizes = points.sum(axis=1)
        self.points, self.sizes = points, sizes
        # levels from the leaves up: children, upper corner, least size
        level = [(p, points[p].max(axis=0), sizes[p].min()) for p in parts if len(p)]
        self.levels = [level]
        while len(level) > fan:
            level = [
                (np.arange(i, min(i + fan, len(self.levels[-1]))), np.max([n[1] for n in self.levels[-1][i : i + fan]], axis=0), min(n[2] for n in self.levels[-1][i : i + fan]))
                for i in range(0, len(self.levels[-1]), fan)
            ]
            self.levels.append(level)
        self.corners = [np.array([n[1] for n in lv]) for lv in self.levels]
        self.least = [np.array([n[2] for n in lv]) for lv in self.levels]

    def near(self, q: np.ndarray, percent: int) -> np.ndarray:
        """Points whose overlap bound with q allows ``percent`` Jaccard."""
        n = int(q.sum())
        nodes = np.arange(len(self.levels[-1])) if self.levels[-1] else np.zeros(0, int)
        for k in range(len(self.levels) - 1, -1, -1):
            bound = np.minimum(self.corners[k][nodes], q).sum(axis=1)
            nodes = nodes[(100 + percent) * bound >= percent * (n + self.least[k][nodes])]
            if not len(nodes):
                return nodes
            nodes = np.concatenate([self.levels[k][i][0] for i in nodes])
        bound = np.minimum(self.points[nodes], q).sum(axis=1)
        return nodes[(100 + percent) * bound >= percent * (n + self.sizes[nodes])]


#: A block of at most so many classes is compared directly, without a tree.
SMALL = 48


def _candidates(points: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int):
    """Pairs (index, indexes) of two sides whose bound allows the Jaccard."""
    if len(left) * len(right) <= SMALL * SMALL:
        bound = np.minimum(points[left][:, None, :], points[right][None, :, :]).sum(axis=2)
        sizes = points.sum(axis=1)
        near = (100 + percent) * bound >= percent * (sizes[left][:, None] + sizes[right][None, :])
        for k, i in enumerate(left):
            yield i, right[near[k]]
        return
    tree = RTree(points[right])
    for i in left:
        yield i, right[tree.near(points[i], percent)]


def _shared(lists: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many listed shingles each pair of different rows of two sides has in common."""
    same = np.array_equal(left, right)
    rows = left if same else np.concatenate([left, right])
    _, columns, times = np.unique(np.concatenate([lists[i] for i in rows]), return_inverse=True, return_counts=True)
    often = times > 1  # others are shared by no two rows
    ends, at = np.cumsum([0, *(len(lists[i]) for i in rows)]), np.flatnonzero(often[columns])
    of, columns = np.searchsorted(ends, at, "right") - 1, (np.cumsum(often) - 1)[columns[at]]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(often.sum()), SLICE):
        part = np.zeros((len(rows), SLICE), np.float32)
        inside = (columns >= low) & (columns < low + SLICE)
        part[of[inside], columns[inside] - low] = 1
        out += part[: len(left)] @ (part if same else part[len(left) :]).T
    return out.astype(np.int64)


def _lists_of(table: pa.Table) -> list[np.ndarray]:
    tokens = table.column("tokens").combine_chunks()
    held, ends = tokens.flatten().to_numpy(), np.cumsum([0, *pc.list_value_length(tokens).to_pylist()])
    return [held[a:b] for a, b in zip(ends, ends[1:])]


def _tile_searcher(percent: int):
    """Each call holds whole tiles of many groups and returns (u, v, tile_id): pairs whose bound
    allows the Jaccard, or one row without a pair for a tile that has too many of them."""

    def run(table):
        tile = np.array(table.column("tile_id").to_numpy())
        names, roots, sides, sizes, all_open = (np.array(table.column(c).to_numpy()) for c in ("node", "root", "side", "n", "n_open"))
        flat = table.column("point").combine_chunks().flatten().to_numpy()
        points = flat.reshape(len(names), -1).astype(np.int64) if len(names) else np.zeros((0, 1), np.int64)
        lists = _lists_of(table)
        rest = -(-percent * sizes // 100) - 1
        unlisted = all_open - np.fromiter(map(len, lists), np.int64, len(lists))
        order = np.argsort(tile, kind="stable")
        cuts = np.flatnonzero(np.diff(tile[order])) + 1
        found, dense = [], []
        for rows in np.split(order, cuts):
            left, right = rows[sides[rows] != 1], rows[sides[rows] != 0]
            if not len(left) or not len(right) or (roots[rows] == roots[rows[0]]).all():
                continue
            shared, at = _shared(lists, left, right), {int(j): k for k, j in enumerate(right)}
            own, n_own = [], 0
            for k, (i, hit) in enumerate(_candidates(points, left, right, percent)):
                met = shared[k, [at[int(j)] for j in hit]]
                # where both list this group only, the rest of either; else that of the one that does
                less, more = np.minimum(unlisted[hit], unlisted[i]), np.maximum(unlisted[hit], unlisted[i])
                most = met + np.where(less > 0, less, more) + np.maximum(rest[hit], rest[i])
                keep = (met > 0) & (roots[hit] != roots[i]) & ((sides[hit] != 2) | (names[hit] > names[i]))
                keep &= (100 + percent) * most >= percent * (sizes[hit] + sizes[i])
                hit = hit[keep]
                if len(hit):
                    own.append(np.stack([np.minimum(names[i], names[hit]), np.maximum(names[i], names[hit]), np.full(len(hit), tile[i])]))
                    n_own += len(hit)
                if n_own > DENSE * len(rows):
                    break
            if n_own > DENSE * len(rows):
                dense.append(tile[rows[0]])
            else:
                found += own
        u, v, of = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
        none = pa.nulls(len(dense), pa.int64())
        return pa.table({"u": pa.concat_arrays([pa.array(u), none]), "v": pa.concat_arrays([pa.array(v), none]), "tile_id": np.concatenate([of, np.array(dense, np.int64)])})

    return run


def _tile_verifier(percent: int):
    """Links between the roots of one tile, by its members' whole sets: a forest."""

    def run(table):
        roots, sides, lists = np.array(table.column("root").to_numpy()), np.array(table.column("side").to_numpy()), _lists_of(table)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
        both = _shared(lists, left, right)
        i, j = np.nonzero((100 + percent) * both >= percent * (sizes[left][:, None] + sizes[right][None, :]))
        a, b = roots[left[i]], roots[right[j]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
        over: dict[int, int] = {}

        def top(x: int) -> int:
            while x in over:
                over[x] = x = over.get(over[x], over[x])
            return x

        out = []
        for a, b in pairs.T.tolist():
            x, y = top(a), top(b)
            if x != y:
                over[y] = x
                out.append((a, b))
        return pa.table({"u": pa.array([a for a, _ in out], pa.int64()), "v": pa.array([b for _, b in out], pa.int64())})

    return run


def _spots(side: Column) -> Column:
    """Where the node of a square cut into ``tiles`` x ``tiles`` stands: in its row (a left side, 0),
    its column (a right one, 1) or, of a square over the diagonal (2), in what lies over it."""
    at = F.col("tile")
    return F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1),
        lambda k: F.struct(
            F.when(side == 2, F.least(k, at)).when(side == 0, at).otherwise(k).alias("i"),
            F.when(side == 2, F.greatest(k, at)).when(side == 0, k).otherwise(at).alias("j"),
            F.when(side != 2, side).when(k == at, 2).when(k > at, 0).otherwise(1).alias("side"),
        ),
    )


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v, most: shingles that both prefixes share at most) whose summed coordinate
    minima, and whose prefixes and rests, allow the Jaccard.  Only pairs that the numbers allow meet
    the points, as these are long."""
    side = lambda name, *held: points.select(*[F.col(c).alias(f"{c}{name}" if c != "node" else name) for c in ("node", *held)])
    bound = F.aggregate(F.zip_with("pointu", "pointv", lambda x, y: F.least(x, y)), F.lit(0), lambda acc, x: acc + x)
    rest = lambda n: F.ceil(F.col(n) * percent / 100) - 1
    # shared in the group, and at most what the one with less elsewhere has there
    met = F.least("ku", "kv") + F.least(F.col("filedu") - F.col("ku"), F.col("filedv") - F.col("kv"))
    allowed = lambda most: (100 + percent) * most >= percent * (F.col("nu") + F.col("nv"))
    some = pairs.join(side("u", "n", "filed"), "u").join(side("v", "n", "filed"), "v")
    some = some.where(allowed(F.least("nu", "nv", met + F.greatest(rest("nu"), rest("nv"))))).select("u", "v", "nu", "nv").distinct()
    some = staged(some, "bounded")
    both = some.join(side("u", "point"), "u").join(side("v", "point"), "v")
    return both.where(allowed(bound)).select("u", "v")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets have the Jaccard.  Both joins read one shuffle of the sets; a node with
    many pairs is split by Spark's skew join, for only pairs are many of a key, never sets."""
    a = sets.select(F.col("node").alias("u"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("node").alias("v"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(a, "u").join(b, "v").where((100 + percent) * both >= percent * (F.size("ta") + F.size("tb"))).select("u", "v")


def _linked(rows: DataFrame, size: int, percent: int, bits: int) -> DataFrame:
    """rows (doc_id, tag, text) -> doc_id, tag, n, root, component_id; a root is a node, null
    where the set is empty or the id null."""
    spark = rows.sparkSession
    ship(spark)
    total = rows.count()
    share = min(1_000_000, max(int(1_000_000 * SAMPLE / max(total, 1)) + 1, 1_000_000 // SAMPLED))
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    often = some.select("text").mapInArrow(trimmed(_token_lister(size)), "token long").groupBy("token").count().where("count >= 5")
    often = often.orderBy(F.desc("count"), "token").limit(FREQUENT).toArrow()
    tokens = often.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    levels = np.rint(16 * np.log2(often.column("count").to_numpy()[order])).astype(np.int64)
    frequent = spark.sparkContext.broadcast((tokens[order], levels))
    weights = spark.sparkContext.broadcast(_word_weights(some.select("text")))
    sketches = staged(rows.mapInArrow(trimmed(_sketcher(size, percent, frequent, weights)), _SKETCH), "sketches")
    frequent.destroy()
    weights.destroy()

    named = sketches.where("n > 0 and doc_id is not null")
    clashes = named.groupBy("c1").agg(F.min("c2").alias("kept"), F.max("c2").alias("last")).where("kept != last").select("c1", "kept")
    clashes = staged(clashes, "clashes")
    nodes = staged(_noded(named.select("c1", "c2", "doc_id"), clashes).groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
    firsts = _noded(named.where(F.size("point") > 0), clashes)
    release_shuffles(spark)
    filed = firsts.select("node", F.explode("prefix").alias("token"))
    blocks = filed.groupBy("token").agg(F.min("node").alias("u"), F.max("node").alias("last"), F.count(F.lit(1)).alias("m"))
    blocks = staged(blocks.where("u != last").select("token", "u", "m"), "blocks")
    release_shuffles(spark)
    # equal sets of several tasks stand in a block more than once
    members = staged(filed.join(blocks, "token").select("u", "node", "token", "m").distinct(), "members")
    points = staged(firsts.select("node", "n", "point").dropDuplicates(["node"]), "points")
    slim = staged(sketches.select("doc_id", "tag", "n", "c1", "c2"), "documents")
    drop_staged(blocks)
    drop_staged(sketches)
    release_shuffles(spark)

    # pass 1: two pivots a group
    shares = staged(members.groupBy("u", "node").agg(F.sum("m").alias("weight"), F.count(F.lit(1)).alias("k")), "shares")
    pivots = shares.groupBy("u").agg(F.max(F.struct("weight", F.col("node").alias("p"), F.col("k").alias("kp"))).alias("best"), F.max(F.when(F.col("u") == F.col("node"), F.col("k"))).alias("ku"))
    pivots = staged(pivots.select("u", "best.p", "best.kp", "ku"), "pivots")
    described = points.join(shares.groupBy("node").agg(F.sum("k").alias("filed")), "node")
    release_shuffles(spark)
    paired = shares.join(pivots, "u")
    star = paired.select("u", F.col("node").alias("v"), "ku", F.col("k").alias("kv"))
    star = star.union(paired.select(F.col("p").alias("u"), F.col("node").alias("v"), F.col("kp").alias("ku"), F.col("k").alias("kv"))).where("u != v")
    star = _bounded(star, described, percent).groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min("u").alias("u"))
    star = staged(star.select("u", F.when(F.col("u") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("v")), "star-pairs")
    release_shuffles(spark)
    sets = _sets_for(star, nodes, clashes, rows, size, bits)
    links = staged(_verified(star, sets, percent), "star-links")
    drop_staged(sets)
    release_shuffles(spark)
    roots = components(links)
    release_shuffles(spark)

    # pass 2: the other members of groups that are not one component yet
    others = shares.join(pivots, "u").where("node != u and node != p").select("u", "node")
    others = others.join(roots, "node", "left").select("u", "node", F.coalesce("root", "node").alias("root"))
    others = staged(others, "others")
    open_groups = others.groupBy("u").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("m"))
    open_groups = open_groups.where("a != b").select("u", F.ceil(F.col("m") / TILE).cast("long").alias("tiles"))
    listed = members.join(others.join(open_groups, "u"), ["u", "node"]).groupBy("u", "node", "root", "tiles").agg(F.collect_list("token").alias("tokens"))
    listed = staged(listed, "listed")  # a list is no longer than its node's prefix
    # a node lists everything in each of its groups, where that is little
    whole = listed.groupBy("node").agg(F.count(F.lit(1)).alias("n_groups"), F.sum(F.size("tokens")).alias("n_open"), F.flatten(F.collect_list("tokens")).alias("all"))
    whole = whole.withColumn("all", F.when(F.col("n_groups") * F.col("n_open") <= LISTED, F.col("all")))
    described = points.select("node", "n", "point").join(whole, "node")
    laid = listed.join(described, "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles"))).withColumn("spot", F.explode(_spots(F.lit(2))))
    laid = laid.select(F.xxhash64("u", "spot.i", "spot.j").alias("tile_id"), "spot.side", "node", "root", "n", "n_open", "point", F.coalesce("all", "tokens").alias("tokens"))
    laid = staged(laid, "tiles")
    calls = laid.count() // GROUP_ROWS + 1
    found = laid.withColumn("work", F.pmod("tile_id", F.lit(calls))).groupBy("work").applyInArrow(_tile_searcher(percent), "u long, v long, tile_id long")
    found = staged(found, "found")
    release_shuffles(spark)
    pairs, dense = found.where("v is not null").select("u", "v").distinct(), found.where("v is null").select("tile_id")
    final, more = roots, []
    if not pairs.isEmpty():
        pairs = staged(pairs, "tree-pairs")
        more.append(staged(_verified(pairs, _sets_for(pairs, nodes, clashes, rows, size, bits), percent), "tree-links"))
    if not dense.isEmpty():
        inside = laid.join(dense, "tile_id", "left_semi").select("tile_id", "side", "node", "root", "n")
        cells = inside.groupBy("tile_id").agg(F.ceil(F.sum("n") / SHINGLES).cast("long").alias("tiles"))
        inside = inside.join(cells, "tile_id").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles"))).withColumn("spot", F.explode(_spots(F.col("side"))))
        inside = staged(inside.select(F.xxhash64("tile_id", "spot.i", "spot.j").alias("tile_id"), "spot.side", "node", "root"), "dense-tiles")
        sets = _sets_for(inside.select(F.col("node").alias("u"), F.col("node").alias("v")).distinct(), nodes, clashes, rows, size, bits)
        known = sets.dropDuplicates(["node"])  # equal rows of one id are read each
        more.append(staged(inside.join(known, "node").groupBy("tile_id").applyInArrow(_tile_verifier(percent), "u long, v long"), "dense-links"))
    release_shuffles(spark)
    if more:
        links = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        for some in more:
            links = links.union(some)
        final = components(links)
        release_shuffles(spark)
    least = nodes.join(final, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    component = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = staged(least.select("node", "root").join(component, "root"), "components")
    for used in (points, members, shares, pivots, others, listed, laid, found):
        drop_staged(used)
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = _noded(slim, clashes).join(of_node, "node", "left")
    return out.select("doc_id", "tag", "n", F.when(linked, F.col("root")).alias("root"), F.when(linked, F.col("component_id")).alias("component_id"))


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links
    reach; a document's own where it has none)."""
    rows = text_rows(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tag"), "text")
    out = _linked(rows, size, percent, bits)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row of every component, with its own columns: that of the smallest id, then of the
    smallest hash of the row; a null id comes last and links like others here.  Rows without
    words stay, each."""
    did, tag = fresh(docs, "did"), fresh(docs, "tag")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    own = docs.withColumns({did: F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), tag: F.xxhash64(*hashed)})
    found = _linked(own.select(F.col(did).alias("doc_id"), F.col(tag).alias("tag"), F.col(text_col).cast("string").alias("text")), size, percent, bits)
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "tag")).alias("first"))
    first = staged(first.select(F.col("first.doc_id").alias(did), F.col("first.tag").alias(tag)), "kept")
    words = F.coalesce(F.col(text_col).cast("string").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    kept = own.where(words).join(first, [did, tag], "left_semi").dropDuplicates([did, tag])
    return kept.select(*docs.columns).unionByName(own.where(~words).select(*docs.columns))
