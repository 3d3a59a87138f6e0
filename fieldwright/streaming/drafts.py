"""A live board from polls of drafts: what changed, who stands where, and whether anybody looks.

A poll brings a cursor (the time of the last pick, as the platform tells it) and what it saw.  A
draft has changed when its cursor differs from the stored one, in either direction: an undone pick
moves it back.  Only then the poll is compared with the board, which lies in the stream's state,
and the differences go out as numbered deltas:

| kind | holder | what it says |
|-|-|-|
| pick | who | an empty slot was filled |
| repick | who | a slot has another holder |
| undo | null | a slot was emptied |
| stale | null | no poll came for ``stale_after`` since ``at`` |
| fresh | null | polls are back |

``seq`` counts a draft's deltas from 1 without gaps, so a reader that has seen up to n asks for
what is above n, and one that connects late replays from 1 (``board``).  A poll that is not later
than the last one says nothing.

State and work of a key: the slots of one draft, and its polls of one micro-batch, which the
source's own options (files or offsets for a trigger) bound.  State lies in RocksDB, not on the heap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.scratch import new_folder
from ..functions.workers import ship

POLL = "draft string, at timestamp, no long, cursor string, whole boolean, slots array<struct<slot:int,holder:string>>"
DELTA = "draft string, seq long, at timestamp, kind string, slot int, holder string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def same_cursor(stored: str | None, seen: str | None) -> tuple[bool, str]:
    """(is it the stored one, the cursor to store): none counts as 0, one that is no number as another."""
    new = str(int(seen)) if seen and seen.lstrip("-").isdigit() else "0"
    return stored == new, new


class Board(StatefulProcessor):
    """The board of one draft."""

    def __init__(self, stale_after: int, timers: bool):
        self.stale_after, self.timers = stale_after, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "cursor string, at long, no long, seq long, stale boolean")
        self.slots = handle.getMapState("slots", "slot int", "holder string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        polls = pd.concat(list(rows)).sort_values(["at", "no"])
        cursor, last, number, seq, stale = self.head.get() if self.head.exists() else (None, None, None, 0, False)
        board = {k[0]: v[0] for k, v in self.slots.iterator()}
        before, out = dict(board), []

        def tell(at, kind, slot=None, holder=None):
            nonlocal seq
            seq += 1
            out.append((key[0], seq, at, kind, slot, holder))

        for at, no, seen, whole, slots in polls[["at", "no", "cursor", "whole", "slots"]].itertuples(index=False, name=None):
            now = at.value // 1000
            if last is not None and (now, no) <= (last, number):
                continue
            if last is not None and not stale and now - last > self.stale_after * 1000:
                tell(pd.Timestamp(last, unit="us"), "stale")
                stale = True
            if stale:
                tell(at, "fresh")
                stale = False
            last, number = now, no
            same, cursor = same_cursor(cursor, seen)
            if same:
                continue
            found = {int(s["slot"]): s["holder"] for s in slots}
            if whole:
                found = dict.fromkeys(board) | found
            for slot in sorted(found):
                held, holder = board.get(slot), found[slot]
                if held == holder:
                    continue
                tell(at, "undo" if holder is None else "pick" if held is None else "repick", slot, holder)
                board[slot] = holder
                if holder is None:
                    del board[slot]
        for slot in before.keys() - board.keys():
            self.slots.removeKey((slot,))
        for slot, holder in board.items():
            if before.get(slot) != holder:
                self.slots.updateValue((slot,), (holder,))
        if last is not None:
            self.head.update((cursor, last, number, seq, stale))
        if self.timers:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stale_after)
        yield _deltas(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cursor, last, number, seq, stale = self.head.get()
        if stale:
            return
        self.head.update((cursor, last, number, seq + 1, True))
        yield _deltas([(key[0], seq + 1, pd.Timestamp(last, unit="us"), "stale", None, None)])

    def close(self) -> None:
        pass


def _deltas(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["draft", "seq", "at", "kind", "slot", "holder"])
    return out.astype({"draft": "object", "seq": "int64", "at": "datetime64[us]", "kind": "object", "slot": "Int32", "holder": "object"})


def deltas(polls: DataFrame, stale_after: int, timers: bool = False) -> DataFrame:
    """The deltas of streamed polls (columns of ``POLL``).  stale_after: milliseconds between polls;
    with timers a draft goes stale by the clock too, when nothing comes at all."""
    ship(polls.sparkSession)
    keyed = polls.where("draft is not null and at is not null").withColumns({"slots": F.coalesce("slots", F.array().cast("array<struct<slot:int,holder:string>>")), "whole": F.coalesce("whole", F.lit(True)), "no": F.coalesce("no", F.lit(0).cast("long"))})
    return keyed.groupBy("draft").transformWithStateInPandas(Board(stale_after, timers), DELTA, "Append", "ProcessingTime" if timers else "None")


def _start(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Deltas as files whose log makes each batch count once."""
    spark = df.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def watch(polls: DataFrame, path: str, checkpoint: str, stale_after: int, every: str = "2 seconds") -> StreamingQuery:
    """Follow polls for as long as the query runs, with staleness by the clock."""
    return _start(deltas(polls, stale_after, timers=True), path, checkpoint, processingTime=every)


def replay(polls: DataFrame, stale_after: int, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Deltas of all that is there; with a path and a checkpoint a later call goes on from there."""
    spark: SparkSession = polls.sparkSession
    path, checkpoint = path or new_folder(spark, "deltas"), checkpoint or new_folder(spark, "deltas-state")
    _start(deltas(polls, stale_after), path, checkpoint, availableNow=True).awaitTermination()
    return read(spark, path)


def read(spark: SparkSession, path: str, above: int = 0) -> DataFrame:
    """Written deltas, for a reader that has seen up to ``above``."""
    return spark.read.schema(DELTA).parquet(path).where(F.col("seq") > above)


def board(told: DataFrame) -> DataFrame:
    """What a reader knows after all deltas: each draft's held slots and whether it is stale."""
    slots = told.where(F.col("slot").isNotNull()).groupBy("draft", "slot").agg(F.max_by("holder", "seq").alias("holder"), F.max("seq").alias("seq"))
    stale = told.groupBy("draft").agg((F.coalesce(F.max_by("kind", F.when(F.col("kind").isin("stale", "fresh"), F.col("seq"))), F.lit("fresh")) == "stale").alias("stale"))
    return slots.where(F.col("holder").isNotNull()).join(stale, "draft")


def gaps(told: DataFrame) -> DataFrame:
    """Drafts whose numbers do not run from 1 without a gap; empty unless deltas were lost or doubled."""
    return told.groupBy("draft").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("distinct"), F.max("seq").alias("last")).where("n != last or distinct != n")


def batch_deltas(polls: DataFrame) -> DataFrame:
    """What ``deltas`` finds for partial polls (``whole`` false), as windows over a whole table."""
    by = Window.partitionBy("draft").orderBy("at", "no")
    cursor = F.when(F.col("cursor").rlike("^-?[0-9]+$"), F.col("cursor").cast("long")).otherwise(0)
    rows = polls.withColumn("cursor", cursor).withColumn("before", F.lag("cursor").over(by)).where("before is null or before != cursor")
    rows = rows.select("draft", "at", "no", F.explode("slots").alias("s")).select("draft", "at", "no", "s.slot", "s.holder")
    held = F.lag("holder").over(Window.partitionBy("draft", "slot").orderBy("at", "no"))
    rows = rows.withColumn("held", held).where(~F.col("holder").eqNullSafe(F.col("held")))
    kind = F.when(F.col("holder").isNull(), "undo").when(F.col("held").isNull(), "pick").otherwise("repick")
    seq = F.row_number().over(Window.partitionBy("draft").orderBy("at", "no", "slot")).cast("long")
    return rows.select("draft", seq.alias("seq"), "at", kind.alias("kind"), "slot", "holder")
