"""What a free player adds to a roster over the weeks that are left, and whom to drop for that.

A week's lineup is the best ``n`` of each position among those who play.  So a week's worth of a roster
needs two numbers a position: the ``n``-th best (what a newcomer must beat) and the next one (who
steps in when a starter goes).  Gains and losses are differences to these, so no lineup is ever solved
again for a candidate:

* add a, drop d of another position: sum over weeks of (a above the n-th) less (d above the next);
* add a, drop d of the same position: the better of a and the next one steps in for a starter d.

Rows: the drops of other positions come down to one a (team, position) before they meet the
candidates; of the same position a candidate meets the few that the roster holds there.  A week in
which a player has no row (a bye) counts 0 points.  Ids are of any type.

Defined cases: a roster with fewer players than slots counts 0 for the empty ones; equal gains drop
the least id; a position without slots is never in a lineup; a team without players gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slots(slots: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in slots.items() for x in kv]), F.col("position"))


def thresholds(roster: DataFrame, points: DataFrame, slots: dict[str, int]) -> DataFrame:
    """(team, position, week, place of each player that week, nth, next): every team and slotted
    position has a row for each week, with nulls where it holds nobody."""
    weeks = points.select("week").distinct()
    held = roster.select("team", "player", "position").join(weeks, how="cross")  # a roster's players times the season's weeks
    rows = held.join(points.select("player", "week", "points"), ["player", "week"], "left").fillna(0.0, ["points"])
    order = Window.partitionBy("team", "position", "week").orderBy(F.desc("points"), F.asc("player"))
    rows = rows.withColumns({"place": F.row_number().over(order), "n": F.coalesce(_slots(slots), F.lit(0))})
    whole = Window.partitionBy("team", "position", "week")
    at = lambda k: F.coalesce(F.max(F.when(F.col("place") == k, F.col("points"))).over(whole), F.lit(0.0))
    return rows.withColumns({"nth": F.when(F.col("n") > 0, at(F.col("n"))), "next": at(F.col("n") + 1)})


def add_drop_weeks(roster: DataFrame, free: DataFrame, points: DataFrame, slots: dict[str, int]) -> DataFrame:
    """(team, add, drop, gain): for every team and free player the best drop and what it brings over
    all weeks of ``points`` (player, week, points).  roster: team, player, position; free: player, position."""
    known = thresholds(roster, points, slots)
    marks = known.where("n > 0").groupBy("team", "position", "week").agg(F.max("nth").alias("nth"), F.max("next").alias("next"))
    starts = F.col("place") <= F.col("n")
    costs = known.groupBy("team", "position", "player").agg(F.sum(F.when(starts, F.col("points") - F.col("next")).otherwise(0.0)).alias("cost"))
    cheapest = costs.groupBy("team", "position").agg(F.min(F.struct("cost", "player")).alias("least"))
    # the cheapest drop outside a position: the least of the others, of which there are as many as positions
    elsewhere = F.col("o.position") != F.col("c.position")
    wanted = free.select("position").distinct().alias("c")
    outside = cheapest.alias("o").join(F.broadcast(wanted), elsewhere).groupBy(F.col("o.team").alias("team"), F.col("c.position").alias("position")).agg(F.min("least").alias("least"))

    teams = roster.select("team").distinct()
    adds = free.select(F.col("player").alias("add"), "position").join(points.select("week").distinct(), how="cross")  # times the season's weeks
    weekly = adds.join(points.select(F.col("player").alias("add"), "week", F.col("points").alias("x")), ["add", "week"], "left").fillna(0.0, ["x"])
    slotted = weekly.where(F.coalesce(_slots(slots), F.lit(0)) > 0)
    # the marks of all teams meet the candidates of a position week by week; adds are summed before teams fan out further
    met = slotted.join(marks, ["position", "week"])
    plain = met.groupBy("team", "add", "position").agg(F.sum(F.greatest(F.col("x") - F.col("nth"), F.lit(0.0))).alias("above"))
    everyone = free.select(F.col("player").alias("add"), "position").join(teams, how="cross")  # one row a team and free player, as the result has
    plain = everyone.join(plain, ["team", "add", "position"], "left").join(_new_here(slotted, marks, teams), ["team", "add"], "left")
    above = F.coalesce("above", "alone", F.lit(0.0))
    by_other = plain.join(outside, ["team", "position"]).select("team", "add", F.col("least.player").alias("drop"), (above - F.col("least.cost")).alias("gain"))

    mine = known.select("team", "position", "week", F.col("player").alias("drop"), F.col("points").alias("d"), "nth", "next", starts.alias("starts"))
    same = slotted.join(mine, ["position", "week"])
    swap = F.when(F.col("starts"), F.greatest("x", "next") - F.col("d")).otherwise(F.greatest(F.col("x") - F.col("nth"), F.lit(0.0)))
    by_same = same.groupBy("team", "add", "drop").agg(F.sum(swap).alias("gain"))
    bench = everyone.join(known.where("n = 0").select("team", "position", F.col("player").alias("drop")).distinct(), ["team", "position"]).select("team", "add", "drop", F.lit(0.0).alias("gain"))
    every = by_other.unionByName(by_same).unionByName(bench)
    best = every.groupBy("team", "add").agg(F.min(F.struct((-F.round("gain", 6)).alias("loss"), F.col("drop"))).alias("b"))
    return best.select("team", "add", F.col("b.drop").alias("drop"), (-F.col("b.loss") + F.lit(0.0)).alias("gain"))


def _new_here(slotted: DataFrame, marks: DataFrame, teams: DataFrame) -> DataFrame:
    """(team, add, alone): all points of adds at a slotted position where a team holds nobody."""
    empty = teams.join(slotted.select("position").distinct(), how="cross").join(marks.select("team", "position").distinct(), ["team", "position"], "left_anti")
    return slotted.groupBy("add", "position").agg(F.sum(F.greatest("x", F.lit(0.0))).alias("alone")).join(empty, "position").select("team", "add", "alone")
