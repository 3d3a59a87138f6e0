"""Boards, slates and positions that do not fit into one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwright.functions import chances
from fieldwright.functions import chances
from fieldwright.functions.workers import ship
from fieldwright.operators import features, relational, valuation


def test_a_draft_board_of_any_size(spark, monkeypatch):
    """Players without a chance of their own are not sent anywhere, and results are those of the whole board."""
    ship(spark)
    monkeypatch.setattr(valuation, "MOST_BOARD", 1000)
    n, picks, sims = 3000, 8, 40
    board = spark.range(n).select(
        F.col("id").alias("player"), F.when(F.col("id") % 3 == 0, "A").when(F.col("id") < 2900, "B").otherwise("C").alias("position"), (n - F.col("id")).cast("double").alias("points")
    )
    got = {r.player: r.vona for r in valuation.next_available(relational.numbered(board, [F.desc("points"), "player"], "adp"), sims, picks, chunk=25).collect()}
    adp = np.arange(n) + 1.0
    position = np.where(np.arange(n) % 3 == 0, "A", np.where(np.arange(n) < 2900, "B", "C"))
    later = dict.fromkeys("ABC", 0.0)
    for block, size in enumerate((25, 15)):
        gone = valuation._drawn(adp, 6 + 0.1 * adp, range(2, 2 + picks), size, np.random.default_rng(block))
        for p in later:
            later[p] += valuation._best_left(n - np.arange(n) * 1.0, np.flatnonzero(position == p), gone).sum() / sims
    assert len(got) == n and all(got[k] == pytest.approx(n - k - later[position[k]], abs=1e-5) for k in range(n))
    # a crowd of others counts by its weight
    gone = valuation._drawn(np.array([2.0]), np.array([1.0]), range(2, 4), 4000, np.random.default_rng(1), [0.0, 0.0])
    assert (gone[:, 0] == 1).mean() == pytest.approx(0.5, abs=0.04) and (gone[:, 1] == 1).sum() > 2000


def test_places_of_a_total_order(spark):
    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), (F.col("id") % 7).alias("v"))
    got = relational.numbered(rows, [F.desc("v"), "k"], "place").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 501))
    assert [(r.v, r.k) for r in got] == sorted(((r.v, r.k) for r in got), key=lambda x: (-x[0], x[1]))


def test_slates_are_drawn_in_blocks(spark, monkeypatch):
    """Means, spreads and the total's spread are those of the copula, for slates of any number."""
    ship(spark)
    monkeypatch.setattr(features, "DRAWN", 8)
    monkeypatch.setattr(chances, "positive_semidefinite", lambda m: pytest.fail("a matrix of all players"))
    players = spark.range(60).select((F.col("id") % 2).alias("slate"), F.col("id").alias("player"), (10.0 + F.col("id") % 2 * 10).alias("mean"), F.lit(5.0).alias("sd"))
    got = features.slate_draws(players, "slate", 0.2, 4000).collect()
    assert len(got) == 60
    assert [r["mean"] for r in got] == pytest.approx([10.0 + r.slate * 10 for r in got], abs=0.5)
    assert features.slate_draws(players.repartition(3), "slate", 0.2, 4000).exceptAll(spark.createDataFrame(got)).isEmpty()
    for r in got:  # variance of a sum of 30 with pairwise correlation just under 0.2
        assert r.total_sd == pytest.approx(5 * np.sqrt(30 + 30 * 29 * 0.19), rel=0.08)
    assert features.slate_draws(players, "slate", -1 / 29, 2000).head().total_sd < 15  # sums hardly move
    own, both = chances.equal_correlation(-0.3, 3)
    e = np.random.default_rng(1).standard_normal((200_000, 3))
    assert np.corrcoef((own * e + both * e.mean(axis=1, keepdims=True)).T)[0, 1] == pytest.approx(-0.3, abs=0.01)


def test_gamma_quantiles_take_few_steps():
    p = np.concatenate([np.random.default_rng(0).random(2000), [1e-9, 1e-3, 1 - 1e-9]])
    shape = 10 ** np.random.default_rng(1).uniform(-0.5, 3, len(p))
    q = chances.gamma_ppf(p, shape, 2.0)
    assert chances.gamma_cdf(q / 2, shape) == pytest.approx(p, abs=1e-11)


def test_tiers_of_equal_values_are_counted_once(spark):
    """A mixture over distinct values gives the tiers of one over all players; a lone player has one too."""
    own = valuation.weighted_tiers
    rng = np.random.default_rng(4)
    x = np.sort(np.round(np.concatenate([rng.normal(m, 2, 400) for m in (20, 50, 90)]), 0))[::-1]
    tiers = valuation.mixture_tiers(x)
    values, times = np.unique(x, return_counts=True)
    assert len(tiers) == 1200 and (own(values[::-1], times[::-1]) == tiers[np.searchsorted(-x, -values[::-1])]).all()
    assert len(set(tiers[:400]) & set(tiers[400:800])) == 0 and (np.diff(tiers) >= 0).all()
    board = spark.createDataFrame([(k, "A", float(v)) for k, v in enumerate(x)] + [(5000, "B", 1.0)], "player long, position string, points double")
    got = {r.player: r.tier for r in valuation.tiers(board, "position", "player", "points").collect()}
    assert got.pop(5000) == 1 and [got[k] for k in range(1200)] == tiers.tolist()


def test_swaps_are_not_shuffled_once_more(spark):
    """Pairs meet once; only a player who is on a team twice makes swaps that must be made distinct."""
    rows = [(1, 1, "A", 1.0), (2, 2, "B", 1.01), (3, 2, "A", 1.0), (4, 3, "C", 0.99), (5, 1, "B", 3.0)]
    board = spark.createDataFrame(rows, "player long, team long, position string, value double")
    swaps = valuation.fair_trades(board, 0.02)
    assert sorted((r.a_player, r.b_player) for r in swaps.collect()) == [(1, 2), (1, 4), (3, 4)]
    assert "Aggregate" not in swaps._jdf.queryExecution().optimizedPlan().toString()
    twice = board.union(board).union(spark.createDataFrame([(1, 1, "C", 1.0)], board.schema))
    assert sorted((r.a_player, r.b_player) for r in valuation.fair_trades(twice, 0.02).collect()) == [(1, 2), (1, 3), (1, 4), (3, 4)]
