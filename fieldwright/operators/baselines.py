"""Replacement baselines of a league: which rank is replacement level, and what it scores.

Only the best ``n`` of a position can matter, n being set by the league and not by the data, so a
position is never sorted as a whole: every task keeps its own best n and these meet (Spark's
window limit runs before the shuffle), a position being at most n rows of each task then."""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How flexible slots are used, and how many of a position are held on benches.
FLEX_USE = {"RB": 0.45, "WR": 0.45, "TE": 0.10}
BENCH_HELD = {"RB": 2.5, "WR": 2.5, "TE": 0.5, "QB": 0.5, "K": 0.0, "DST": 0.2}


def starters(slots: dict[str, float], flex: dict[str, tuple[float, dict[str, float]]] | None = None) -> dict[str, float]:
    """Starters of each position in a team, flexible slots split by use: {slot: (how many, {position: share})}."""
    out = {p: float(n) for p, n in slots.items()}
    for n, use in (flex or {}).values():
        for p, share in use.items():
            out[p] = out.get(p, 0.0) + n * share
    return out


def last_starter(teams: int, slots: dict[str, float], flex=None) -> dict[str, int]:
    """Rank of the last starter of each position."""
    return {p: max(1, floor(teams * n + 1e-9)) for p, n in starters(slots, flex).items()}


def replacement(teams: int, slots: dict[str, float], flex=None, held: dict[str, float] | None = None) -> dict[str, int]:
    """Rank of the best player that nobody holds, by position; benches as in ``held``, else the usual."""
    held = BENCH_HELD if held is None else held
    return {p: max(1, floor(teams * (n + held.get(p, 0.0)) + 1e-9)) for p, n in starters(slots, flex).items()}


def best(board: DataFrame, most: int, position: str = "position", points: str = "points", player: str = "player") -> DataFrame:
    """The best ``most`` of every position with their place; nulls are no players."""
    order = Window.partitionBy(position).orderBy(F.desc(points), F.asc(player))
    known = board.where(F.col(position).isNotNull() & F.col(points).isNotNull())
    return known.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def baselines(board: DataFrame, ranks: dict[str, int], position: str = "position", points: str = "points", player: str = "player") -> DataFrame:
    """(position, rank, baseline): points at the rank, of the last player where there are fewer.  One
    row for each position of ``ranks`` that has players."""
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    top = best(board.where(F.col(position).isin(*ranks)), max(ranks.values()), position, points, player)
    top = top.withColumn("rank", F.element_at(rank, F.col(position))).where(F.col("place") <= F.col("rank"))
    return top.groupBy(position, "rank").agg(F.max_by(points, "place").alias("baseline"))


def values(board: DataFrame, ranks: dict[str, int], position: str = "position", points: str = "points", player: str = "player") -> DataFrame:
    """Every player with the baseline of the position and the value over it; the baselines, one row a
    position of the league, are broadcast."""
    found = F.broadcast(baselines(board, ranks, position, points, player))
    return board.join(found, position).withColumn("value", F.col(points) - F.col("baseline"))


def seats(board: DataFrame, teams: int, slots: dict[str, int], flex: dict[str, tuple[int, list[str]]], position: str = "position", points: str = "points", player: str = "player") -> DataFrame:
    """(position, starters): how many of a position start when every flexible seat goes to the best
    player left, slots of fewer positions first.  What is looked at is bounded by the league: of a
    position no more than its own seats and all flexible ones."""
    spare = sum(teams * n for n, _ in flex.values())
    top = best(board.where(F.col(position).isin(*slots)), max(teams * n for n in slots.values()) + spare, position, points, player)
    fixed = F.create_map(*[F.lit(x) for p, n in slots.items() for x in (p, teams * n)])
    left = top.withColumn("starts", F.col("place") <= F.element_at(fixed, F.col(position)))
    for _, (n, eligible) in sorted(flex.items(), key=lambda kv: (len(kv[1][1]), kv[0])):
        free = ~F.col("starts") & F.col(position).isin(*eligible)
        turn = F.row_number().over(Window.partitionBy(free).orderBy(F.desc(points), F.asc(player)))
        left = left.withColumn("starts", F.col("starts") | (free & (turn <= teams * n)))
    return left.groupBy(position).agg(F.count_if("starts").alias("starters"))
