"""Valuation, win chances, bids, projections and simulations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chances
from ..operators import features, season, valuation
from ..operators import relational as rel
from .ranking import _MONTHLY, monthly, weekly
from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

_SCORED = "SELECT l_partkey AS player, sum(CAST(l_quantity AS DECIMAL(18,4)) * CAST(0.04 AS DECIMAL(4,2)) + CAST(l_discount AS DECIMAL(18,4)) * CAST(6.00 AS DECIMAL(4,2)) - CAST(l_tax AS DECIMAL(18,4)) * CAST(2.00 AS DECIMAL(4,2))) AS points FROM lineitem GROUP BY l_partkey"
#: Points by statistic of the demonstration league.
SCORING = {"l_quantity": "0.04", "l_discount": "6.00", "l_tax": "-2.00"}


def _scored(t):
    return valuation.score(t.lineitem.select(F.col("l_partkey").alias("player"), *SCORING), ["player"], SCORING)


def _board(t):
    return _scored(t).join(t.part.select(F.col("p_partkey").alias("player"), F.substring("p_brand", 1, 7).alias("position")), "player")


@query("q_scoring_map", _SCORED, decimals=("points",))
def scoring_map(t):
    return _scored(t)


_RANKED = f"SELECT player, substr(p_brand, 1, 7) AS position, points, row_number() OVER (PARTITION BY substr(p_brand, 1, 7) ORDER BY points DESC, player) AS place FROM ({_SCORED}) JOIN part ON p_partkey = player"


@query("q_vorp", f"WITH r AS ({_RANKED}), b AS (SELECT position, points AS baseline FROM r WHERE place = 30) SELECT player, position, place, points, points - baseline AS value FROM r JOIN b USING (position)", decimals=("points", "value"))
def vorp(t):
    return valuation.over_baseline(_board(t), "position", "points", "player", F.lit(30)).select("player", "position", F.col("place").cast("long").alias("place"), "points", F.col("value"))


@query(
    "q_rank_baseline",
    f"WITH r AS ({_RANKED}), n AS (SELECT DISTINCT position, CASE WHEN position IN ('Brand#1', 'Brand#2') THEN 12 * 2 ELSE 12 END AS k FROM r) SELECT r.position, r.points AS baseline FROM r JOIN n ON n.position = r.position AND n.k = r.place",
    decimals=("baseline",),
)
def rank_baseline(t):
    starters = F.when(F.col("position").isin("Brand#1", "Brand#2"), 2).otherwise(1)
    return valuation.baseline(_board(t), "position", "points", "player", 12 * starters)


@query("q_implied_totals", "SELECT o_orderkey, round(t / 2 + s / 2, 6) AS home, round(t / 2 - s / 2, 6) AS away FROM (SELECT o_orderkey, o_totalprice / 1000 AS t, (o_custkey % 15) - 7.0e0 AS s FROM orders)")
def implied_totals(t):
    total, spread = F.col("o_totalprice") / 1000, (F.col("o_custkey") % 15) - 7.0
    home, away = valuation.implied_totals(total, spread)
    return t.orders.select("o_orderkey", F.round(home, 6).alias("home"), F.round(away, 6).alias("away"))


@query(
    "q_gamma_params",
    "SELECT l_partkey, round(m * m / (s * s), 6) AS shape, round(s * s / m, 6) AS scale FROM (SELECT l_partkey, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem GROUP BY 1) WHERE s > 0",
)
def gamma_params(t):
    g = t.lineitem.groupBy("l_partkey").agg(F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s")).where("s > 0")
    m, s = F.col("m"), F.col("s")
    return g.select("l_partkey", F.round(chances.gamma_shape(m, s), 6).alias("shape"), F.round(chances.gamma_scale(m, s), 6).alias("scale"))


@query(
    "q_faab",
    "SELECT l_orderkey, l_linenumber, round(b, 6) AS base, round(b * (n - 1) / n, 6) AS bid FROM (SELECT l_orderkey, l_linenumber, 100 * l_quantity / (l_quantity + l_extendedprice / 1000) AS b, 2 + l_linenumber AS n FROM lineitem)",
)
def faab(t):
    base = valuation.faab_base(F.lit(100), F.col("l_quantity"), F.col("l_extendedprice") / 1000)
    bid = valuation.shaded(base, 2 + F.col("l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(base, 6).alias("base"), F.round(bid, 6).alias("bid"))


_MARGIN = "(o_totalprice / 10000 - 15) / (20 + o_custkey % 11)"


@query("q_win_prob", f"SELECT o_orderkey, round({chances.phi_sql(_MARGIN)}, 6) AS p FROM orders")
def win_prob(t):
    x = (F.col("o_totalprice") / 10000 - 15) / (20 + F.col("o_custkey") % 11)
    return t.orders.select("o_orderkey", F.round(chances.phi(x), 6).alias("p"))


@query("q_posture", f"SELECT o_orderkey, CASE WHEN p < 0.45 THEN 'underdog' WHEN p > 0.55 THEN 'favourite' ELSE 'tossup' END AS posture FROM (SELECT o_orderkey, {chances.phi_sql(_MARGIN)} AS p FROM orders)")
def posture(t):
    x = (F.col("o_totalprice") / 10000 - 15) / (20 + F.col("o_custkey") % 11)
    return t.orders.select("o_orderkey", valuation.posture(chances.phi(x)).alias("posture"))


@query(
    "q_bid_curve",
    "WITH g AS (SELECT unnest(range(0, 51, 5)) AS bid) SELECT l_returnflag, bid, round(count(*) FILTER (WHERE l_quantity < bid) / count(*), 6) AS p FROM lineitem CROSS JOIN g GROUP BY ALL",
)
def bid_curve(t):
    return valuation.bid_curve(t.lineitem.select("l_returnflag", F.col("l_quantity").alias("bid")), ["l_returnflag"], "bid", 0, 50, 5).select(
        "l_returnflag", "bid", F.round("p", 6).alias("p")
    )


@query(
    "q_picks_until_next",
    "SELECT s AS slot, r AS round, CASE WHEN r % 2 = 1 THEN 2 * (12 - s) ELSE 2 * (s - 1) END AS between_picks FROM range(1, 13) a(s) CROSS JOIN range(1, 5) b(r)",
)
def picks_until_next(t):
    grid = t.spark.range(12 * 4).select((F.col("id") % 12 + 1).alias("slot"), (F.floor(F.col("id") / 12) + 1).alias("round"))
    return grid.select("slot", "round", valuation.picks_between(F.col("slot"), F.col("round"), 12).alias("between_picks"))


@query(
    "q_draft_score",
    f"WITH r AS ({_RANKED}), b AS (SELECT position, points AS baseline FROM r WHERE place = 30) SELECT player, round(CAST(points - baseline AS DOUBLE) * 0.5e0 + (p_retailprice / 1000) * 0.3e0 - place * 0.2e0, 6) AS score FROM r JOIN b USING (position) JOIN part ON p_partkey = player",
)
def draft_score(t):
    rows = valuation.over_baseline(_board(t), "position", "points", "player", F.lit(30)).join(t.part, F.col("player") == F.col("p_partkey"))
    parts = {"value": (F.col("value").cast("double"), 0.5), "market": (F.col("p_retailprice") / 1000, 0.3), "place": (F.col("place"), -0.2)}
    return rows.select("player", F.round(valuation.weighted(parts), 6).alias("score"))


@query("q_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY 1")
def regression(t):
    return features.script_slope(t.lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity").select("l_returnflag", F.round("slope", 4).alias("slope"))


@query(
    "q_usage_share",
    "SELECT l_orderkey, l_linenumber, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 9) AS share FROM lineitem",
)
def usage_share(t):
    return features.shares(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", F.round("share", 9).alias("share"))


@query(
    "q_shrunk_sigma",
    f"WITH a AS ({_MONTHLY}), g AS (SELECT k, count(*) AS n, var_samp(CAST(v AS DOUBLE)) AS v FROM a GROUP BY k HAVING count(*) > 1), p AS (SELECT avg(v) AS prior FROM g) SELECT k, round(sqrt((n * v + 8 * prior) / (n + 8)), 3) AS sigma FROM g CROSS JOIN p",
)
def shrunk_sigma(t):
    return features.shrunk_sigma(monthly(t).withColumn("v", F.col("v").cast("double")), ["k"], [], "v", 8).select("k", F.round("sigma", 3).alias("sigma"))


@query(
    "q_injury",
    "SELECT c_custkey, round(a * e, 6) AS expectation, a AS p_active FROM (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 0.0e0 WHEN 1 THEN 0.25e0 WHEN 2 THEN 0.7e0 ELSE 1.0e0 END AS a, 0.5e0 + (c_custkey % 50) / 100.0e0 AS e FROM customer)",
)
def injury(t):
    status = F.element_at(F.array(*[F.lit(x) for x in ("Out", "Doubtful", "Questionable")], F.lit(None)), (F.col("c_nationkey") % 4 + 1).cast("int"))
    active = features.p_active(status)
    return t.customer.select("c_custkey", F.round(active * (0.5 + (F.col("c_custkey") % 50) / 100.0), 6).alias("expectation"), active.alias("p_active"))


@query(
    "q_context",
    "SELECT s_suppkey, round(CASE WHEN s_nationkey % 3 = 0 THEN 1.0e0 ELSE 1 - 0.004e0 * (s_suppkey % 30) * abs(sin(radians((s_suppkey * 37) % 360 - (s_nationkey * 11) % 360))) END, 9) AS multiplier FROM supplier",
)
def context(t):
    wind, toward, heading = F.col("s_suppkey") % 30, (F.col("s_suppkey") * 37) % 360, (F.col("s_nationkey") * 11) % 360
    return t.supplier.select("s_suppkey", F.round(features.wind_multiplier(wind, toward, heading, F.col("s_nationkey") % 3 == 0), 9).alias("multiplier"))


@query(
    "q_rival_needs",
    "WITH s AS (SELECT c_nationkey AS team, c_mktsegment AS slot, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS v FROM customer GROUP BY ALL), m AS (SELECT slot, median(CAST(v AS DOUBLE)) AS med FROM s GROUP BY slot) SELECT team, count(*) FILTER (WHERE CAST(v AS DOUBLE) < med) AS holes FROM s JOIN m USING (slot) GROUP BY team",
)
def rival_needs(t):
    s = t.customer.groupBy(F.col("c_nationkey").alias("team"), F.col("c_mktsegment").alias("slot")).agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("v"))
    return season.holes(s, "team", "slot", "v")


@query(
    "q_consensus_bucket",
    "SELECT CASE WHEN l_discount * 10 >= 0.8e0 THEN 'strong' WHEN l_discount * 10 >= 0.5e0 THEN 'split' ELSE 'weak' END AS bucket, l_linestatus, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0e0 ELSE 0.0e0 END), 6) AS hit_rate, sum(CAST(l_tax AS DECIMAL(10,6))) AS cost FROM lineitem GROUP BY ALL",
    decimals=("cost",),
)
def consensus_bucket(t):
    from ..operators.debates import value_report

    rows = t.lineitem.select((F.col("l_discount") * 10).alias("score"), "l_linestatus", (F.col("l_returnflag") == "R").alias("hit"), F.col("l_tax").cast("decimal(10,6)").alias("cost"))
    return value_report(rows, ["l_linestatus"])


@query("q_trade_packages")
def trade_packages(t):
    rows = _board(t).select("player", (F.col("player") % 12).alias("team"), "position", F.col("points").cast("double").alias("value"))
    return valuation.fair_trades(rows, 0.02)


@query("q_vona")
def vona(t):
    board = _board(t).select("player", "position", F.col("points").cast("double").alias("points"))
    board = rel.numbered(board, [F.desc("points"), F.col("player")], "adp")
    return valuation.next_available(board, sims=5000, picks=20)


@query("q_season_mc")
def season_mc(t):
    teams = weekly(t).groupBy("team").agg(F.avg(F.col("pts").cast("double")).alias("mean"), F.stddev_samp(F.col("pts").cast("double")).alias("sd"))
    return season.monte_carlo(teams, sims=10_000, chunk=250, weeks=14, playoffs=6)


@query("q_copula")
def copula(t):
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("player")).agg(F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("sd"))
    return features.slate_draws(g.withColumn("slate", F.col("player") % 5), "slate", rho=0.2, sims=500)


@query("q_tiers_gmm")
def tiers_gmm(t):
    return valuation.tiers(_board(t).select("player", "position", F.col("points").cast("double").alias("points")), "position", "player", "points")


@query("q_lineup_topn")
def lineup_topn(t):
    rows = _board(t).select((F.col("player") % 3).alias("team"), "player", "position", F.col("points").cast("double").alias("points"))
    return valuation.best_lineups(rows, "team", {"Brand#1": 1, "Brand#2": 1, "Brand#3": 1, "FLEX": 2}, {"FLEX": ["Brand#4", "Brand#5", "Brand#1"]}, top=10)


@query("q_quantiles")
def quantiles(t):
    g = t.lineitem.groupBy("l_partkey").agg(F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("sd")).where("sd > 0")
    return features.gamma_quantiles(g, "mean", "sd").select("l_partkey", F.round("p10", 6).alias("p10"), F.round("p90", 6).alias("p90"))


@query("q_add_drop")
def add_drop(t):
    # a fiftieth of the players is on rosters, all others are free
    rows = _board(t).where("player % 50 = 0").select((F.col("player") % 4).alias("team"), "player", "position", F.col("points").cast("double").alias("points"))
    free = _board(t).where("player % 50 <> 0").select("player", "position", F.col("points").cast("double").alias("points"))
    return valuation.add_drop(rows, free, {"Brand#1": 1, "Brand#2": 1, "Brand#3": 1, "Brand#4": 1, "Brand#5": 1})


@query("q_identity_ladder")
def identity_ladder(t):
    from ..operators.identity import resolve_many

    players = t.part.select(F.col("p_partkey").cast("string").alias("player_id"), F.concat(F.lit("00-"), F.col("p_partkey").cast("string")).alias("gsis_id"), F.col("p_name").alias("name"), F.lit("WR").alias("position"), F.col("p_brand").alias("team"))
    inputs = t.part.select(
        F.lit("feed").alias("source"), F.concat(F.lit("x"), F.col("p_partkey").cast("string")).alias("external_id"), F.concat(F.col("p_name"), F.lit(" Jr")).alias("raw_name"), F.lit("WR").alias("raw_position"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("raw_team"), F.when(F.col("p_partkey") % 15 == 0, F.concat(F.lit("00-"), F.col("p_partkey").cast("string"))).alias("gsis_id"),
    )
    return resolve_many(inputs, players, None)
