"""A trie of conversations by their turns, built level by level.

Every node is a distinct sequence of first turns.  Construction goes down one depth at a time:
live conversations are grouped by (parent node, next turn) and the group's least conv_id names
the node.  A group whose conversations are alike to their ends (one conversation, or copies of
one) is a chain: its nodes are known at once and its conversations leave the loop, so the number
of levels is the depth at which different conversations still agree, not the longest one.  Then
the levels are joined in reverse and add up leaves and savings.

A turn is carried as half a SHA-256 of (role, text) and its bytes; texts are not shuffled.  A
conversation is one row of such digests.  Whether groups are alike is told by two 64-bit sums
over (place, turn).

Hot nodes: members meet the nodes of their level by a broadcast of those that hold a thousandth
of all conversations or more (a thousand rows at most), and by a shuffled join for the rest, so
no key of a shuffle holds more than a thousandth.  Ends of a node are put together from pieces
of 4096 ids each, then hashed in order as a stream.

Defined cases: turns go by ``turn``, null first, then by role and by the digest; null role or
text is empty; rows without conv_id belong to no conversation; repeated rows are repeated turns;
an empty table has no node; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import ship, staged, trimmed

#: Part of all conversations that makes a node hot, and ids in one piece of a node's ends.
HOT, PIECE = 1000, 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (key, bytes)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), F.unhex(F.substring(F.sha2(named, 256), 1, 32)).alias("key"), F.octet_length(text).cast("long").alias("bytes")).alias("t"),
    )
    in_order = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(in_order.alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["bytes"].alias("bytes"))).alias("turns"))


def with_shared_starts(convs: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % group and goes on with its
    own turns after its first h, where h is crc32 of the decimal c, modulo ``most``."""
    convs = staged(convs, "trie-turns")
    first = F.col("conv_id") - F.col("conv_id") % group
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, most - 1).alias("head"))
    rows = convs.select("conv_id", "turns", first.alias("first"), h.alias("h")).join(heads, "first", "left")
    taken = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", 1, F.col("h")))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.select("conv_id", F.concat(taken, own).alias("turns"))


def _mark(place: Column, key: Column, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), place, key)


def _rest(turns: str, salt: int) -> Column:
    """A sum over the places, from the end, and keys of all turns."""
    n = F.size(turns)
    marks = F.transform(turns, lambda t, i: _mark(n - i, t["key"], salt))
    return F.aggregate(marks, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)).alias(f"x{salt}")


def _level(live: DataFrame, total: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """The nodes one deeper than ``live`` rows stand, and the rows with the node each goes to."""
    n, first = F.size("turns"), F.col("turns")[0]
    going = live.where(n > 0).select(
        "conv_id",
        F.col("node").alias("parent"),
        first["key"].alias("key"),
        first["bytes"].alias("bytes"),
        F.slice("turns", 2, n).alias("turns"),
        *[F.col(f"x{s}").bitwiseXOR(_mark(n, first["key"], s)).alias(f"x{s}") for s in (1, 2)],
    )
    rest = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["bytes"])
    grouped = going.withColumns({"n": F.size("turns"), "rest": rest}).groupBy("parent", "key")
    alike = [F.min(c).alias(f"least_{c}") for c in ("x1", "x2", "n")] + [F.max(c).alias(f"most_{c}") for c in ("x1", "x2", "n")]
    nodes = grouped.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"), F.min("rest").alias("rest_bytes"), *alike)
    chain = (F.col("least_x1") == F.col("most_x1")) & (F.col("least_x2") == F.col("most_x2")) & (F.col("least_n") == F.col("most_n"))
    nodes = staged(nodes.select("parent", "key", "conv_id", "n_convs", "bytes", "rest_bytes", F.col("least_n").alias("rest"), chain.alias("chain")), f"trie-nodes-{depth}")
    named = nodes.where("n_convs > 1").select("parent", "key", F.col("conv_id").alias("node"), "n_convs", "chain")
    most = max(2, -(-total // HOT))
    hot, cold = named.where(F.col("n_convs") >= most), named.where(F.col("n_convs") < most)
    renamed = hot.select("parent", "key", *[F.col(c).alias(f"hot_{c}") for c in ("node", "n_convs", "chain")])
    met = going.join(F.broadcast(renamed), ["parent", "key"], "left")
    found = met.where(F.col("hot_node").isNotNull()).withColumnsRenamed({f"hot_{c}": c for c in ("node", "n_convs", "chain")})
    others = met.where(F.col("hot_node").isNull()).drop("hot_node", "hot_n_convs", "hot_chain").join(cold, ["parent", "key"], "left")
    others = others.withColumns({"node": F.coalesce("node", "conv_id"), "n_convs": F.coalesce("n_convs", F.lit(1).cast("long")), "chain": F.coalesce("chain", F.lit(True))})
    columns = ["conv_id", "parent", "node", "n_convs", "chain", "bytes", "turns", "x1", "x2"]
    return nodes, staged(found.select(columns).unionByName(others.select(columns)), f"trie-members-{depth}")


def _stream(batches):
    """SHA-256 of each node's pieces, comma-joined in the order they come."""
    at, held = None, None
    for batch in batches:
        for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids"))):
            if (depth, node) != at:
                if at is not None:
                    yield _hashed(at, held)
                at, held = (depth, node), hashlib.sha256(ids.encode())
            else:
                held.update(b",")
                held.update(ids.encode())
    if at is not None:
        yield _hashed(at, held)


def _hashed(at, held) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([held.hexdigest()], pa.string())], names=["depth", "node", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """(depth, node, conv_id) of conversations that end at a node, as one hash a node."""
    ship(rows.sparkSession)
    piece = F.floor(F.col("conv_id") / PIECE)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    pieces = rows.groupBy("depth", "node", piece.alias("piece")).agg(ids.alias("ids"))
    in_order = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "piece").select("depth", "node", "ids")
    return in_order.mapInArrow(trimmed(_stream), "depth long, node long, ends_sha256 string")


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def trie(convs: DataFrame) -> DataFrame:
    """One row for every node of the trie over (conv_id, turns)."""
    spark: SparkSession = convs.sparkSession
    start = convs.select("conv_id", "turns", _rest("turns", 1), _rest("turns", 2))
    live = staged(start, "trie-conversations")
    total, least = live.agg(F.count(F.lit(1)), F.min("conv_id")).head()
    whole = lambda c: F.col(c).cast("long")
    if not total:
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in NODE) + ", ends_sha256 string")
    live = live.withColumn("node", F.lit(least).cast("long"))
    over = [live.where(F.size("turns") == 0).select(F.lit(0).cast("long").alias("depth"), "node", "conv_id")]
    levels, members, depth = [], [], 0
    while not live.where(F.size("turns") > 0).isEmpty():
        depth += 1
        nodes, met = _level(live, total, depth)
        levels.append(nodes)
        members.append(met)
        end = F.when(F.col("chain"), F.size("turns")).otherwise(0) + F.lit(depth)
        over.append(met.where((F.col("n_convs") > 1) & (F.col("chain") | (F.size("turns") == 0))).select(end.cast("long").alias("depth"), "node", "conv_id"))
        live = met.where(~F.col("chain")).select("conv_id", "turns", "x1", "x2", "node")

    # the levels in reverse: what the nodes below a parent add up to
    below, tops = None, []
    sums = [F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")]
    for d in range(depth, -1, -1):
        under = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(*sums) if below is not None else None
        if d:
            here = levels[d - 1].select("conv_id", F.col("parent").alias("parent_conv_id"), "n_convs", "bytes", "rest_bytes", "rest", "chain")
        else:
            here = spark.range(1).select(F.lit(least).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("bytes"), F.lit(False).alias("chain"))
        open_ones = here.where(~F.col("chain")).select("conv_id", "parent_conv_id", "n_convs", "bytes")
        own = (F.col("n_convs") - 1) * F.col("bytes")
        if under is None:
            level = open_ones.select("conv_id", "parent_conv_id", "n_convs", F.lit(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), own.alias("saved_tokens"))
        else:
            level = open_ones.join(under, "conv_id", "left").select(
                "conv_id",
                "parent_conv_id",
                "n_convs",
                F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
                (own + F.coalesce("saved_tokens", F.lit(0))).alias("saved_tokens"),
            )
        if d:
            chained = here.where("chain").select(
                "conv_id",
                "parent_conv_id",
                "n_convs",
                (F.col("rest") > 0).cast("long").alias("n_children"),
                F.lit(1).cast("long").alias("n_leaves"),
                ((F.col("n_convs") - 1) * (F.col("bytes") + F.col("rest_bytes"))).alias("saved_tokens"),
            )
            level = level.unionByName(chained)
        below = staged(level.withColumn("depth", F.lit(d).cast("long")), f"trie-level-{d}")
        tops.append(below)

    # the nodes of chains below their first: the first member's turns say how many and how long
    shared, alone = tops, []
    for d, met in enumerate(members, start=1):
        firsts = met.where(F.col("chain") & (F.col("conv_id") == F.col("node")) & (F.size("turns") > 0))
        laid = firsts.select("conv_id", "n_convs", F.size("turns").alias("n"), F.posexplode(F.col("turns.bytes")).alias("i", "bytes"))
        rows = laid.where("n_convs > 1")
        onward = Window.partitionBy("conv_id").orderBy(F.desc("i"))
        rows = rows.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.sum("bytes").over(onward)).unionByName(laid.where("n_convs = 1").withColumn("saved_tokens", F.lit(0).cast("long")))
        alone.append(
            rows.select(
                "conv_id",
                (F.col("i") + F.lit(d + 1)).cast("long").alias("depth"),
                F.col("conv_id").alias("parent_conv_id"),
                "n_convs",
                (F.col("i") + 1 < F.col("n")).cast("long").alias("n_children"),
                F.lit(1).cast("long").alias("n_leaves"),
                "saved_tokens",
            )
        )
    nodes = shared[0].select(*NODE)
    for part in (*shared[1:], *alone):
        nodes = nodes.unionByName(part.select(*NODE))
    ended = over[0]
    for part in over[1:]:
        ended = ended.unionByName(part)
    several = (F.col("n_convs") > 1) | (F.col("depth") == 0)
    hashes = ends(ended).withColumnRenamed("node", "conv_id")
    joined = nodes.where(several).join(hashes, ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    last = F.when(F.col("n_children") == 0, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY)
    single = nodes.where(~several).withColumn("ends_sha256", last)
    out = [*[whole(c).alias(c) for c in NODE], "ends_sha256"]
    return joined.select(out).unionByName(single.select(out))
