"""The ladder as a write: a batch of ids goes through the rungs, and what follows from it for
the mappings and for the review queue becomes visible in one commit.

A slot is (source, player): a player holds one live id per source.  Facts (a registry id) are
settled first, as sets: every fact claims its slot, of several claims the id that holds a
mapping already goes first, then the lesser id; a guess that holds the slot is evicted, anything
else keeps it.  Guesses (names) then see the mappings as the facts left them.

| Stored mapping | The batch says | What happens |
|-|-|-|
| rejected | anything | unmatched, queued (``rejected``) |
| sure, verified or by hand | another player's fact | stays and is returned; queued (``human_decision_conflict``) |
| a guess | a fact of the same player | becomes the fact |
| a guess | another player's fact | moves there; if that slot is held: stays, unmatched, queued (``upgrade_conflict``) |
| none | a fact | inserted; if the slot is held: unmatched, queued (``duplicate_for_source``) |
| none | a name | inserted as exact or pending guess, or queued with the ladder's reason |

The queue keeps when an id was first and last seen, what was said of it, why it is there and
whether it is resolved.  An entry that is seen again is open again only if its description
changed; one whose id gets a mapping is resolved; an evicted id keeps the description it had.

Groups: slots are settled by aggregates (a least struct), so a slot that a third of the batch
claims costs one row for each task.  Defined cases: repeats of a key keep the first; a null key
is refused; an empty batch changes nothing.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.scratch import written as written_down
from ..sources.lake import State, StateChanged
from . import identity as i
from .relational import ContractError, keep_first

INPUT = ("source", "external_id", "raw_name", "raw_position", "raw_team", "gsis_id")
RAW = ("raw_name", "raw_position", "raw_team")
KEY = ["source", "external_id"]
QUEUE = "source string, external_id string, raw_name string, raw_position string, raw_team string, reason string, first_seen timestamp, last_seen timestamp, resolved boolean"
RESULT = ("source", "external_id", "player_id", "guess", "method", "confidence", "outcome", "reason")


def _text(c: str | None) -> Column:
    return F.lit(c).cast("string")


def _batch(inputs: DataFrame, players: DataFrame, mappings: DataFrame) -> DataFrame:
    """Each key once, with the mapping it has and the player its registry id names."""
    if not inputs.where(F.col("source").isNull() | F.col("external_id").isNull()).isEmpty():
        raise ContractError("an id to resolve needs a source and an external id")
    batch = keep_first(inputs, KEY, [F.col("gsis_id").desc_nulls_last(), "raw_name", "raw_position", "raw_team"])
    batch = batch.withColumn("registry_id", F.coalesce("gsis_id", F.when(F.col("source") == i.GSIS, F.col("external_id"))))
    facts = players.where("gsis_id is not null").select(F.col("gsis_id").alias("registry_id"), F.col("player_id").alias("fact"))
    stored = mappings.select(*KEY, F.col("player_id").alias("old"), "method", "confidence", "verified")
    return batch.join(facts, "registry_id", "left").join(stored, KEY, "left")


def _claims(batch: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts that want a slot, with the one that gets it; and the mappings that stand in their way."""
    guess = F.col("old").isNotNull() & i.is_displaceable()
    wants = F.col("fact").isNotNull() & (F.col("source") != i.GSIS) & (F.col("old").isNull() | guess)
    claims = batch.where(wants).select(*KEY, "old", F.col("fact").alias("player_id"))
    order = F.struct(~F.col("player_id").eqNullSafe(F.col("old")), F.col("old").isNull(), "external_id")
    first = claims.groupBy("source", "player_id").agg(F.min_by("external_id", order).alias("first"))
    holders = mappings.where(i.is_live()).select(
        "source", "player_id", F.col("external_id").alias("holder"), i.is_displaceable().alias("displaceable")
    )
    met = claims.join(first, ["source", "player_id"]).join(holders, ["source", "player_id"], "left")
    other = F.col("holder").isNotNull() & (F.col("holder") != F.col("external_id"))
    wins = (F.col("first") == F.col("external_id")) & (~other | F.col("displaceable"))
    return met.select(*KEY, "player_id", "old", wins.alias("wins")), met.where(wins & other).select("source", F.col("holder").alias("external_id"))


def _fact(player: Column) -> list[Column]:
    return [*KEY, player.alias("player_id"), F.lit(i.GSIS).alias("method"), F.lit(1.0).cast("float").alias("confidence"), F.lit(False).alias("verified")]


def persist(proposed: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write proposals (source, external_id, player_id, method, confidence) under the slot rule:
    (mappings after it, proposals with ``written`` and ``reason``, ids that were evicted).

    A rejected pairing is never made again, but the id may go to another player in its place; a
    1.0 fact evicts a guess, anything else yields to who holds the slot.  Of several proposals for
    a slot the surest counts, then the lesser id."""
    stored = mappings.select(*KEY, F.col("player_id").alias("old"), F.col("method").alias("old_method"))
    holders = mappings.where(i.is_live()).select("source", "player_id", F.col("external_id").alias("holder"), i.is_displaceable().alias("displaceable"))
    order = F.struct(-F.col("confidence").cast("double"), F.col("external_id"))
    first = proposed.groupBy("source", "player_id").agg(F.min_by("external_id", order).alias("first"))
    met = proposed.join(first, ["source", "player_id"]).join(stored, KEY, "left").join(holders, ["source", "player_id"], "left")
    again = F.coalesce((F.col("old_method") == i.REJECTED) & (F.col("old") == F.col("player_id")), F.lit(False))
    taken = F.col("holder").isNotNull() & (F.col("holder") != F.col("external_id"))
    yields = taken & ~(F.col("displaceable") & i.is_authoritative())
    kept = F.coalesce(F.col("old_method") != i.REJECTED, F.lit(False))
    reason = F.when(again, "rejected").when(yields | (F.col("first") != F.col("external_id")), "duplicate_for_source").when(kept, "mapped_already")
    ruled = met.withColumn("reason", reason).withColumn("written", F.col("reason").isNull())
    evicted = ruled.where(F.col("written") & taken).select("source", F.col("holder").alias("external_id"))
    new = ruled.where("written").select(*KEY, "player_id", "method", F.col("confidence").cast("float").alias("confidence"), F.lit(False).alias("verified"))
    rest = mappings.join(new.select(KEY), KEY, "left_anti").join(evicted, KEY, "left_anti")
    return rest.select(*new.columns).unionByName(new), ruled.select(*KEY, "player_id", "method", "confidence", "written", "reason"), evicted


def queue_after(queue: DataFrame, seen: DataFrame, mapped: DataFrame, now: datetime) -> DataFrame:
    """The queue once ``seen`` (key, raw fields, reason, carried) has been told and ``mapped`` keys
    have got a mapping.  carried: the row brings no description of its own, the stored one stays."""
    at = F.lit(now).cast("timestamp")
    told = seen.select(*KEY, *[F.col(c).alias(f"_{c}") for c in (*RAW, "reason")], "carried", F.lit(True).alias("_seen"))
    both = queue.join(told, KEY, "full").join(mapped.select(KEY).distinct().withColumn("_mapped", F.lit(True)), KEY, "left")
    new, again = F.col("first_seen").isNull(), F.col("_seen").isNotNull()
    own = again & ~F.coalesce("carried", F.lit(False))
    changed = F.lit(False)
    for c in RAW:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    evicted = again & F.coalesce("carried", F.lit(False))
    resolved = F.when(F.col("_mapped"), True).when(new, False).when(evicted | (own & changed), False).otherwise(F.col("resolved"))
    return both.select(
        *KEY,
        *[F.when(own, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in RAW],
        F.when(again, F.col("_reason")).otherwise(F.col("reason")).alias("reason"),
        F.coalesce("first_seen", at).alias("first_seen"),
        F.when(again, at).otherwise(F.col("last_seen")).alias("last_seen"),
        resolved.alias("resolved"),
    )


def resolve_batch(inputs: DataFrame, players: DataFrame, mappings: DataFrame, queue: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, mappings after, queue after).  A result's player_id is null until it may be used;
    a pending one stands in ``guess``.  outcome: resolved, pending_review or unmatched."""
    batch = written_down(_batch(inputs, players, mappings), "ladder-batch")
    rejected, has = F.col("method") == i.REJECTED, F.col("old").isNotNull()
    claims, evicted = _claims(batch, mappings)
    ruled = batch.join(claims.select(*KEY, "wins"), KEY, "left")
    goes = ruled.join(evicted.withColumn("evicted", F.lit(True)), KEY, "left").withColumn("evicted", F.coalesce("evicted", F.lit(False)))
    dispute = has & ~rejected & ~i.is_displaceable() & (F.col("fact") != F.col("old"))
    kind = (
        F.when(rejected, "rejected")
        .when(F.col("wins"), "fact")
        .when((F.col("wins") == False) & has & ~F.col("evicted"), "upgrade_conflict")  # noqa: E712
        .when(F.col("wins") == False, "duplicate_for_source")  # noqa: E712
        .when(has & dispute, "human_decision_conflict")
        .when(has & ~F.col("evicted"), "stored")
        .when((F.col("source") == i.GSIS) & F.col("fact").isNotNull(), "registry")
    )
    settled = written_down(goes.withColumn("kind", kind), "ladder-settled")
    evicted = written_down(evicted, "ladder-evicted")

    # facts are in place before any name is looked at
    new = settled.where("kind = 'fact'").select(*_fact(F.col("fact")))
    rest = mappings.join(new.select(KEY), KEY, "left_anti").join(evicted, KEY, "left_anti")
    sure = written_down(rest.select(*new.columns).unionByName(new), "ladder-sure")

    third = F.when(names.normalize_position(F.col("raw_position")) == "DST", F.when(names.normalize_team(F.col("raw_team")).isNull(), F.col("external_id")))
    named = settled.where("kind is null").drop("old", "method", "confidence", "verified", "fact", "registry_id", "kind", "wins", "evicted")
    named = named.withColumn("raw_team", F.coalesce(third, F.col("raw_team"))).withColumn("gsis_id", _text(None))
    guessed = written_down(i.resolve_many(named, players, sure), "ladder-guessed")
    written = guessed.where(F.col("player_id").isNotNull())
    after = sure.unionByName(written.select(*KEY, "player_id", "method", F.col("confidence").cast("float").alias("confidence"), F.lit(False).alias("verified")))

    usable = F.col("confidence").cast("double") >= i.USABLE - i.EPSILON
    known = settled.where("kind is not null")
    returned = F.col("kind").isin("stored", "human_decision_conflict")
    pending = returned & ~i.is_usable()
    fact = F.col("kind").isin("fact", "registry")
    results = known.select(
        *KEY,
        F.when(fact, F.col("fact")).when(returned & ~pending, F.col("old")).alias("player_id"),
        F.when(pending, F.col("old")).alias("guess"),
        F.when(fact, i.GSIS).when(returned, F.col("method")).otherwise("unmatched").alias("method"),
        F.when(fact, 1.0).when(returned, F.col("confidence").cast("double")).otherwise(0.0).alias("confidence"),
        F.when(pending, "pending_review").when(fact | returned, "resolved").otherwise("unmatched").alias("outcome"),
        F.when(~F.col("kind").isin("fact", "registry", "stored"), F.col("kind")).alias("reason"),
    )
    by_name = guessed.select(
        *KEY,
        F.when(usable, F.col("player_id")).alias("player_id"),
        F.when(~usable, F.col("player_id")).alias("guess"),
        "method",
        "confidence",
        F.when(F.col("player_id").isNull(), "unmatched").when(usable, "resolved").otherwise("pending_review").alias("outcome"),
        F.when(F.col("player_id").isNull(), F.col("reason")).alias("reason"),
    )
    results = results.unionByName(by_name)

    # disputes of sure rows are queued too, though their mapping is returned
    told = results.where("reason is not null").select(*KEY, "reason").join(batch.select(*KEY, *RAW), KEY)
    seen = told.select(*KEY, *RAW, "reason", F.lit(False).alias("carried"))
    mapped = new.select(KEY).union(written.select(KEY)).union(settled.where("kind = 'registry'").select(KEY))
    out = evicted.join(mapped, KEY, "left_anti").join(seen, KEY, "left_anti")
    out = out.select(*KEY, *[_text(None).alias(c) for c in RAW], F.lit("displaced").alias("reason"), F.lit(True).alias("carried"))
    return results, after, queue_after(queue, seen.unionByName(out), mapped, now)


def counts(results: DataFrame) -> DataFrame:
    """How many ended by which method; pending guesses and unmatched ids under names of their own."""
    kind = F.when(F.col("outcome") == "pending_review", "fuzzy_pending").when(F.col("outcome") == "unmatched", "unmatched").otherwise(F.col("method"))
    return results.groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def tables(state: State) -> tuple[DataFrame, DataFrame]:
    """Mappings and queue of a state, empty where nothing was committed."""
    spark, held = state.spark, state.names()
    return tuple(state.read(n) if n in held else spark.createDataFrame([], s) for n, s in (("mappings", i.MAPPINGS), ("queue", QUEUE)))


def commit_batch(state: State, inputs: DataFrame, players: DataFrame, now: datetime, tries: int = 5) -> DataFrame:
    """Resolve and write a batch; mappings, queue and results change together or not at all.  A
    writer that comes in between makes the batch be read, decided and written again."""
    for left in reversed(range(tries)):
        seen = state.version()
        mappings, queue = tables(state)
        results, after, queued = resolve_batch(inputs, players, mappings, queue, now)
        try:
            state.commit({"mappings": after, "queue": queued, "results": results}, expected=seen, check=_one_id_a_slot)
            return state.read("results")
        except StateChanged:
            if not left:
                raise
    raise AssertionError("unreachable")


def _one_id_a_slot(written: dict[str, DataFrame]) -> None:
    """The written snapshot is looked at before it counts."""
    if not i.broken_invariants(written["mappings"]).isEmpty():
        raise ContractError("a player would hold two live ids of one source")


def resolve(inputs: DataFrame, players: DataFrame, mappings: DataFrame) -> DataFrame:
    """What the ladder says of single ids, without writing: (source, external_id, player_id, ...)."""
    queue = inputs.sparkSession.createDataFrame([], QUEUE)
    return resolve_batch(inputs, players, mappings, queue, datetime(1970, 1, 1))[0]
