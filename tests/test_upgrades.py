"""Adds and drops over the remaining weeks against solved lineups."""

import numpy as np

from fieldwright.operators import upgrades


def worth(players, weekly, weeks, slots):
    total = 0.0
    for w in weeks:
        for p, n in slots.items():
            total += sum(sorted((weekly.get((k, w), 0.0) for k, q in players if q == p), reverse=True)[:n])
    return total


def check(spark, roster, free, weekly, slots):
    weeks = sorted({w for _, w in weekly})
    r = spark.createDataFrame(roster, "team string, player string, position string")
    f = spark.createDataFrame(free, "player string, position string")
    p = spark.createDataFrame([(k, w, x) for (k, w), x in weekly.items()], "player string, week int, points double")
    got = {(x.team, x.add): (x["drop"], x.gain) for x in upgrades.add_drop_weeks(r, f, p, slots).collect()}
    want = {}
    for team in {t for t, *_ in roster}:
        mine = [(k, q) for t, k, q in roster if t == team]
        now = worth(mine, weekly, weeks, slots)
        for add, q in free:
            options = [(round(worth([x for x in mine if x[0] != d] + [(add, q)], weekly, weeks, slots) - now, 6), d) for d, _ in mine]
            gain = max(g for g, _ in options)
            want[team, add] = (min(d for g, d in options if g == gain), gain)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert got == want


def test_every_add_and_drop(spark):
    rng = np.random.default_rng(12)
    slots = {"QB": 1, "RB": 2, "WR": 2, "DST": 1}
    for size in (5, 9):
        players = [(f"p{k:02d}", ["QB", "RB", "WR", "K"][rng.integers(0, 4)]) for k in range(40)] + [("KC", "DST"), ("x", "RB")]
        weekly = {(k, w): float(rng.integers(0, 12)) for k, _ in players if k != "x" for w in range(1, 5) if rng.random() > 0.2}
        roster = [(f"t{k // size}", p, q) for k, (p, q) in enumerate(players[: 2 * size])]
        check(spark, roster, players[2 * size :], weekly, slots)


def test_byes_and_equal_gains(spark):
    weekly = {("a", 1): 10.0, ("b", 2): 4.0, ("n", 1): 12.0, ("n", 2): 3.0, ("m", 2): 9.0}
    check(spark, [("t", "a", "QB"), ("t", "b", "QB"), ("t", "z", "RB")], [("n", "QB"), ("m", "QB"), ("q", "QB"), ("k", "K")], weekly, {"QB": 1, "RB": 1})
