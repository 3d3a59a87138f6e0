"""The live board: deltas of many micro-batches against a replay, and staleness."""

import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwright.streaming import drafts, events

T0 = datetime(2026, 9, 1, 12)
YEAR = 365 * 86_400_000


def poll(draft, second, cursor, slots, whole=True, no=0):
    return draft, T0 + timedelta(seconds=second), no, cursor, whole, slots


def folder(spark, path, batches):
    """One file for each micro-batch, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, drafts.POLL).coalesce(1).write.parquet(f"{path}/{k:03d}")
        time.sleep(0.02)  # files are taken by their time
    return spark.readStream.schema(drafts.POLL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


def told(df):
    return [(r.draft, r.seq, int((r.at - T0).total_seconds()), r.kind, r.slot, r.holder) for r in df.orderBy("draft", "seq").collect()]


@pytest.mark.parametrize("stored,seen,out", [("5", "5", (True, "5")), ("5", "4", (False, "4")), ("4", "5", (False, "5")), (None, "0", (False, "0")), ("0", None, (True, "0")), ("x", "7", (False, "7"))])
def test_a_cursor_differs_in_either_direction(stored, seen, out):
    assert drafts.same_cursor(stored, seen) == out


def test_deltas_over_micro_batches(spark, tmp_path):
    stream = folder(
        spark,
        tmp_path / "in",
        [
            [poll("a", 0, "100", [(1, "p1")]), poll("b", 0, None, [])],
            [poll("a", 1, "100", [(1, "p1"), (2, "unseen")]), poll("a", 2, "200", [(1, "p1"), (2, "p2")])],
            [poll("a", 4, "150", [(1, "p1")]), poll("a", 3, "170", [(1, "p1"), (2, "p3")]), poll("a", 2, "999", [])],  # an undo moves the cursor back; a late poll
            [poll("b", 5, "300", [(1, "q")]), poll(None, 6, "1", []), poll("b", 6, "300", None), poll("b", 6, "400", [(2, "r")], whole=False, no=1)],
            [poll("a", 500, "150", [(9, "unseen")]), poll("a", 501, "160", [])],
        ],
    )
    out = drafts.replay(stream, 60_000, str(tmp_path / "out"), str(tmp_path / "state"))
    assert told(out) == [
        ("a", 1, 0, "pick", 1, "p1"),
        ("a", 2, 2, "pick", 2, "p2"),
        ("a", 3, 3, "repick", 2, "p3"),
        ("a", 4, 4, "undo", 2, None),
        ("a", 5, 4, "stale", None, None),
        ("a", 6, 500, "fresh", None, None),
        ("a", 7, 501, "undo", 1, None),
        ("b", 1, 5, "pick", 1, "q"),
        ("b", 2, 6, "pick", 2, "r"),
    ]
    assert drafts.gaps(out).isEmpty()
    assert {(r.draft, r.slot, r.holder, r.stale) for r in drafts.board(out).collect()} == {("b", 1, "q", False), ("b", 2, "r", False)}
    # a restart goes on from its state: nothing comes twice, numbers go on
    again = folder(spark, tmp_path / "in" / "more", [[poll("b", 7, "500", [(1, "q")])]])
    del again
    later = drafts.replay(stream, 60_000, str(tmp_path / "out"), str(tmp_path / "state"))
    assert told(later)[-1] == ("b", 3, 7, "undo", 2, None) and later.count() == 10
    assert told(drafts.read(spark, str(tmp_path / "out"), above=2).where("draft = 'b'")) == [("b", 3, 7, "undo", 2, None)]


def test_many_batches_equal_one_table(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [poll(f"d{0 if rng.random() < 0.4 else rng.integers(1, 8)}", k // 2, str(rng.integers(0, 4)), [(int(rng.integers(0, 5)), [None, "x", "y"][rng.integers(0, 3)])], False, k) for k in range(240)]
    stream = folder(spark, tmp_path / "in", [rows[k : k + 40] for k in range(0, 240, 40)])
    out = drafts.replay(stream, YEAR)
    assert told(out) == told(drafts.batch_deltas(spark.createDataFrame(rows, drafts.POLL))) and out.count() > 30
    assert drafts.gaps(out).isEmpty()
    assert not drafts.gaps(out.where("seq != 2")).isEmpty()


def test_a_silent_draft_goes_stale_by_the_clock(spark, tmp_path):
    stream = folder(spark, tmp_path / "in", [[poll("a", 0, "1", [(1, "p")])]])
    query = drafts.watch(stream, str(tmp_path / "out"), str(tmp_path / "state"), stale_after=1500, every="500 milliseconds")
    try:
        for _ in range(120):
            time.sleep(0.5)
            if (tmp_path / "out" / "_spark_metadata").exists() and (seen := told(drafts.read(spark, str(tmp_path / "out")))) and len(seen) > 1:
                break
    finally:
        query.stop()
    assert seen == [("a", 1, 0, "pick", 1, "p"), ("a", 2, 0, "stale", None, None)]
    assert [r.stale for r in drafts.board(drafts.read(spark, str(tmp_path / "out"))).collect()] == [True]


def test_repeated_batches_change_nothing(spark, tmp_path):
    spark.range(30).withColumn("v", F.col("id") % 3).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    order, fail = [], [True]

    def persist(batch, number):
        order.append(("persist", number))
        batch.write.mode("overwrite").parquet(str(tmp_path / f"state/batch={number}"))

    def land(batch, number):
        if number == 1 and fail:
            fail.clear()
            raise RuntimeError("lost between state and lake")
        order.append(("land", number))
        batch.write.mode("overwrite").parquet(str(tmp_path / f"lake/batch={number}"))

    with pytest.raises(Exception, match="lost between"):
        events.apply_batches(stream, persist, land, str(tmp_path / "cp"))
    events.apply_batches(stream, persist, land, str(tmp_path / "cp"))
    assert order == [("persist", 0), ("land", 0), ("persist", 1), ("persist", 1), ("land", 1), ("persist", 2), ("land", 2)]
    for side in ("state", "lake"):
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / side)).collect()) == list(range(30))
