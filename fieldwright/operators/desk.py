"""People's decisions on the review queue, and the gate that says whether any are left.

Decisions come as rows (source, external_id, action, player_id, force), one for a key, and are taken
together: rejections first, as they free slots, then the rest against what these left.

| action | does | refused |
|-|-|-|
| verify | the mapping counts from now on; its queue entry is closed | ``missing``; ``rejected`` (a tombstone does not come back) |
| reject | the pairing stays as a tombstone at 0.0; the id is queued with what was known of it | ``missing`` |
| map | the id belongs to this player, by hand, at 1.0; its queue entry is closed | ``no_such_player``; ``source_player_clash`` (another id holds the slot) |
| mark | the queue entry is closed | ``missing``; ``still_mapped`` (a live mapping is in dispute), unless forced |

Of several ids mapped to one slot the least counts.  A null or unknown action, or a key with two
decisions, is an error."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import written
from ..sources.lake import State
from . import identity as i
from .idfile import FileConflict, tables
from .ladder import KEY, RAW, _one_id_a_slot, queue_after
from .relational import ContractError, duplicates

DECISION = "source string, external_id string, action string, player_id string, force boolean"
ACTIONS = ("verify", "reject", "map", "mark")
GREEN, RED, CONFLICT, OPERATIONAL = 0, 1, 2, 3


def decide(decisions: DataFrame, players: DataFrame, mappings: DataFrame, queue: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, action, outcome; mappings after; queue after)."""
    if not decisions.where(F.col("action").isNull() | ~F.col("action").isin(*ACTIONS)).isEmpty():
        raise ContractError(f"an action is none of {ACTIONS}")
    if not duplicates(decisions, KEY).isEmpty():
        raise ContractError("a key has two decisions")
    stored = mappings.select(*KEY, F.col("player_id").alias("old"), "method")
    said = decisions.select(*KEY, "action", "player_id", F.coalesce("force", F.lit(False)).alias("force")).join(stored, KEY, "left")
    said = said.join(queue.select(*KEY, F.lit(True).alias("queued")), KEY, "left")
    said = said.join(players.select("player_id", F.lit(True).alias("known")), "player_id", "left")

    rejected_now = decisions.where("action = 'reject'").select(KEY)
    live = mappings.where(i.is_live()).join(rejected_now, KEY, "left_anti")
    slots = live.select("source", "player_id", F.col("external_id").alias("holder"))
    maps = said.where("action = 'map' and known").select(*KEY, "player_id")
    first = maps.groupBy("source", "player_id").agg(F.min("external_id").alias("first"))
    held = maps.join(first, ["source", "player_id"]).join(slots, ["source", "player_id"], "left")
    clash = (F.col("first") != F.col("external_id")) | (F.col("holder").isNotNull() & (F.col("holder") != F.col("external_id")))
    said = said.join(held.select(*KEY, clash.alias("clash")), KEY, "left")

    has, tomb = F.col("old").isNotNull(), F.coalesce(F.col("method") == i.REJECTED, F.lit(False))
    action = F.col("action")
    outcome = (
        F.when((action == "verify") & ~has, "missing")
        .when((action == "verify") & tomb, "rejected")
        .when(action == "verify", "verified")
        .when((action == "reject") & ~has, "missing")
        .when(action == "reject", "tombstone")
        .when((action == "map") & F.col("known").isNull(), "no_such_player")
        .when((action == "map") & F.col("clash"), "source_player_clash")
        .when((action == "map") & has, "replaced")
        .when(action == "map", "created")
        .when(F.col("queued").isNull(), "missing")
        .when(has & ~tomb & ~F.col("force"), "still_mapped")
        .otherwise("closed")
    )
    ruled = written(said.select(*KEY, "action", "player_id", outcome.alias("outcome")), "desk-ruled")

    mark = ruled.where("outcome in ('verified', 'tombstone')").select(*KEY, "outcome")
    changed = mappings.join(mark, KEY, "left")
    tombstone, seen = F.coalesce(F.col("outcome") == "tombstone", F.lit(False)), F.coalesce(F.col("outcome") == "verified", F.lit(False))
    changed = changed.select(
        *KEY,
        "player_id",
        F.when(tombstone, i.REJECTED).otherwise(F.col("method")).alias("method"),
        F.when(tombstone, 0.0).otherwise(F.col("confidence")).cast("float").alias("confidence"),
        (F.when(tombstone, False).otherwise(F.col("verified")) | seen).alias("verified"),
    )
    by_hand = ruled.where("outcome in ('created', 'replaced')").select(*KEY, "player_id", F.lit(i.MANUAL).alias("method"), F.lit(1.0).cast("float").alias("confidence"), F.lit(True).alias("verified"))
    after = changed.join(by_hand.select(KEY), KEY, "left_anti").unionByName(by_hand)

    told = ruled.where("outcome = 'tombstone'").select(*KEY, *[F.lit(None).cast("string").alias(c) for c in RAW], F.lit("rejected").alias("reason"), F.lit(True).alias("carried"))
    closed = ruled.where("outcome in ('verified', 'created', 'replaced', 'closed')").select(KEY)
    return ruled.select(*KEY, "action", "outcome"), after, queue_after(queue, told, closed, now)


def commit_decisions(state: State, decisions: DataFrame, now: datetime) -> dict[tuple[str, str], str]:
    """Take decisions in one commit; what became of each."""
    version, held = state.version(), tables(state)
    ruled, mappings, queue = decide(decisions, held["players"], held["mappings"], held["queue"], now)
    state.commit({"mappings": mappings, "queue": queue}, expected=version, check=_one_id_a_slot)
    return {(r.source, r.external_id): r.outcome for r in ruled.collect()}


def report(players: DataFrame, mappings: DataFrame, queue: DataFrame, most: int = 1000) -> dict:
    """Counts, and what waits for a person: pending guesses and open entries, the first ``most`` of each
    listed and all counted."""
    pending = mappings.where(i.is_live() & ~i.is_usable()).join(players.select("player_id", "name", "position"), "player_id", "left")
    waiting = queue.where("not resolved")
    methods: dict = {}
    for r in mappings.groupBy("source", "method").agg(F.count(F.lit(1)).alias("n")).orderBy("source", "method").collect():
        methods.setdefault(r.source, {})[r.method] = r.n
    positions = {r.position: r.n for r in players.groupBy("position").agg(F.count(F.lit(1)).alias("n")).orderBy("position").collect()}
    return {
        "players_total": sum(positions.values()),
        "players_by_position": positions,
        "ids_by_source": {s: sum(m.values()) for s, m in methods.items()},
        "ids_by_source_method": methods,
        "pending": pending.count(),
        "pending_rows": [r.asDict() for r in pending.orderBy(*KEY).select(*KEY, "player_id", "name", "position", F.round("confidence", 4).alias("confidence")).limit(most).collect()],
        "unmatched": waiting.count(),
        "unmatched_rows": [r.asDict() for r in waiting.orderBy(*KEY).select(*KEY, *RAW, "reason").limit(most).collect()],
    }


def gate(told: dict, allow_empty: bool = False) -> int:
    """Green only if nothing waits and, unless allowed, something is there at all."""
    seeded = told["players_total"] > 0 and bool(told["ids_by_source"])
    return GREEN if (seeded or allow_empty) and not told["pending"] and not told["unmatched"] else RED


def exit_code(run, *args, **kw) -> tuple[int, object]:
    """(code, result or error): a gate state, a conflict that a person must rule on, or a run that
    never happened, so that a scheduler can tell them apart.  run returns (code, result)."""
    try:
        return run(*args, **kw)
    except FileConflict as e:
        return CONFLICT, str(e)
    except Exception as e:
        return OPERATIONAL, str(e)
