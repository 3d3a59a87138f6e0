"""Schedules, standings, luck, holes and seeded season simulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def all_play(df: DataFrame, team: str, week: str, points: str) -> DataFrame:
    """Record against every other team of each week, by ranks instead of pairs."""
    w = Window.partitionBy(week)
    below = F.rank().over(w.orderBy(points)) - 1
    alike = F.count(F.lit(1)).over(Window.partitionBy(week, points)) - 1
    rows = df.select(team, below.alias("wins"), alike.alias("ties"), (F.count(F.lit(1)).over(w) - 1).alias("games"))
    sums = rows.groupBy(team).agg(*[F.sum(c).cast("long").alias(c) for c in ("wins", "ties", "games")])
    return sums.where("games > 0")


def pair_up(df: DataFrame, team: str, week: str) -> DataFrame:
    """Matchups of neighbours in team order; an odd team has a bye."""
    w = Window.partitionBy(week).orderBy(team)
    return df.select(team, week, F.floor((F.row_number().over(w) + 1) / 2).alias("matchup"))


def luck(df: DataFrame, schedule: DataFrame, team: str, week: str, points: str) -> DataFrame:
    """Actual win share less the all-play share."""
    rows = df.join(schedule, [team, week])
    pair = Window.partitionBy(week, "matchup")
    best, least, n = F.max(points).over(pair), F.min(points).over(pair), F.count(F.lit(1)).over(pair)
    won = F.when(best == least, 0.5).when(F.col(points) == best, 1.0).otherwise(0.0)
    actual = rows.select(team, won.alias("won"), n.alias("n")).where("n = 2").groupBy(team).agg(F.avg("won").alias("actual"))
    share = all_play(df, team, week, points).select(team, ((F.col("wins") + 0.5 * F.col("ties")) / F.col("games")).alias("share"))
    return actual.join(share, team).select(team, (F.col("actual") - F.col("share")).alias("luck"))


def standings(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rank of a league's teams (few rows by nature) by several keys, best first."""
    return df.withColumn("place", F.rank().over(Window.orderBy(*[F.desc(k) for k in keys])))


def byes(teams: DataFrame, games: DataFrame, team: str, week: str) -> DataFrame:
    """Team-weeks without a game; both sides are small dimensions."""
    grid = teams.select(team).crossJoin(F.broadcast(games.select(week).distinct()))
    return grid.join(games.select(team, week).distinct(), [team, week], "left_anti")


def holes(df: DataFrame, team: str, slot: str, value: str) -> DataFrame:
    """Slots in which a team is under the median."""
    v = F.col(value).cast("double")
    mid = df.groupBy(slot).agg(F.median(v).alias("_m"))
    return df.join(F.broadcast(mid), slot).groupBy(team).agg(F.count_if(v < F.col("_m")).alias("holes"))


def round_robin(n: int, weeks: int) -> np.ndarray:
    """(week, game, 2) places of a league: one stays, the others turn round it, so all pairs meet
    once before any meets again; with an odd number one team rests each week."""
    even = n + n % 2
    out = []
    for w in range(weeks):
        turn = np.roll(np.arange(1, even), w)
        order = np.concatenate([[0], turn])
        games = np.stack([order[: even // 2], order[::-1][: even // 2]], axis=1)
        out.append(games[(games < n).all(axis=1)])
    return np.array(out, np.int64).reshape(weeks, -1, 2)


def monte_carlo(teams: DataFrame, sims: int, chunk: int, weeks: int, playoffs: int, schedule: DataFrame | None = None, rho: float = 0.0) -> DataFrame:
    """Playoff, bye and title chances over seeded seasons; a chunk of seasons is a row of work and
    counts are summed, so the numbers do not depend on partitions.

    teams: all of a league (team, mean, sd).  schedule: (week from 0, home, away), all of a
    season, else a round robin.  rho: correlation of the scores of one week."""
    spark = teams.sparkSession
    rows = teams.orderBy("team").toPandas()
    place = {t: k for k, t in enumerate(rows["team"])}
    games = round_robin(len(rows), weeks).reshape(-1, 2)
    week_of = np.repeat(np.arange(weeks), len(games) // max(weeks, 1))
    if schedule is not None:
        played = schedule.where(F.col("week") < weeks).select("week", "home", "away").toPandas()
        week_of, games = played["week"].to_numpy(np.int64), np.array([[place[a], place[b]] for a, b in zip(played["home"], played["away"])], np.int64).reshape(-1, 2)
    league = spark.sparkContext.broadcast((rows, week_of, games))

    def bracket(rng, mean, sd, seeds):
        alive = list(seeds)
        while len(alive) > 1:
            rest = 1 << (len(alive) - 1).bit_length()
            idle, play = alive[: rest - len(alive)], alive[rest - len(alive) :]
            draw = np.maximum(rng.normal(mean, sd), 0)
            through = [a if draw[a] >= draw[b] else b for a, b in zip(play[: len(play) // 2], play[::-1])]
            alive = sorted([*idle, *through], key=list(seeds).index)
        return alive[0]

    def run(batches):
        local, weeks_of, pairs = league.value
        mean, sd = local["mean"].to_numpy(float), local["sd"].fillna(0).to_numpy(float)
        n = len(mean)
        for pdf in batches:
            counts = np.zeros((n, 3), np.int64)
            for block in pdf["id"]:
                rng, size = np.random.default_rng(int(block)), min(chunk, sims - int(block) * chunk)
                common = rng.normal(size=(size, weeks, 1))
                scores = np.maximum(mean + sd * (np.sqrt(rho) * common + np.sqrt(1 - rho) * rng.normal(size=(size, weeks, n))), 0)
                home, away = scores[:, weeks_of, pairs[:, 0]], scores[:, weeks_of, pairs[:, 1]]
                winners = np.where(home >= away, pairs[:, 0], pairs[:, 1])
                wins = np.zeros((size, n), np.int64)
                np.add.at(wins, (np.arange(size)[:, None], winners), 1)
                order = np.lexsort((np.broadcast_to(np.arange(n), wins.shape), -scores.sum(axis=1), -wins), axis=1)
                for seeds in order[:, :playoffs]:
                    counts[seeds, 0] += 1
                    counts[seeds[:2], 1] += 1
                    counts[bracket(rng, mean, sd, seeds.tolist()), 2] += 1
            yield pd.DataFrame({"team": local["team"], "playoffs": counts[:, 0], "bye": counts[:, 1], "title": counts[:, 2]})

    blocks = -(-sims // chunk)  # the last one may be shorter
    kind = teams.schema["team"].dataType.simpleString()
    found = spark.range(0, blocks, 1, min(blocks, 64)).mapInPandas(run, f"team {kind}, playoffs long, bye long, title long")
    return found.groupBy("team").agg(*[(F.sum(c) / sims).alias(c) for c in ("playoffs", "bye", "title")])
