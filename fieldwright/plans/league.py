"""League baselines and the walk-forward backtest bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baselines as base
from ..operators import leagues, upgrades, walkforward
from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

SLOTS = {"QB": 1, "RB": 2, "WR": 2, "TE": 1, "K": 1, "DST": 1}
FLEX = {"FLEX": (1, base.FLEX_USE)}
_POSITIONS = ("QB", "RB", "WR", "TE", "K", "DST")
_BOARD = "b AS (SELECT p_partkey AS player, ['QB', 'RB', 'WR', 'TE', 'K', 'DST'][p_size % 6 + 1] AS position, p_retailprice AS points FROM part), o AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY points DESC, player) AS place FROM b)"


def _board(t):
    position = F.element_at(F.array(*map(F.lit, _POSITIONS)), F.col("p_size") % 6 + 1)
    return t.part.select(F.col("p_partkey").alias("player"), position.alias("position"), F.col("p_retailprice").alias("points"))


def _ranks(ranks: dict) -> str:
    return "(VALUES " + ", ".join(f"('{p}', {r})" for p, r in ranks.items()) + ") k(position, rank)"


VOLS, VORP = base.last_starter(12, SLOTS, FLEX), base.replacement(12, SLOTS, FLEX)


def _baseline_sql(ranks: dict) -> str:
    return f"WITH {_BOARD} SELECT o.position, CAST(k.rank AS INTEGER) AS rank, arg_max(points, place) AS baseline FROM o JOIN {_ranks(ranks)} ON k.position = o.position AND place <= k.rank GROUP BY ALL"


@query("q_vols_flex", _baseline_sql(VOLS))
def vols_flex(t):
    return base.baselines(_board(t), VOLS)


@query("q_vorp_bench", _baseline_sql(VORP))
def vorp_bench(t):
    return base.baselines(_board(t), VORP)


@query("q_vorp_values", f"SELECT player, b.position, CAST(rank AS INTEGER) AS rank, points, baseline, points - baseline AS value FROM ({_baseline_sql(VORP)}) JOIN (WITH {_BOARD} SELECT player, position, points FROM b) b USING (position)")
def vorp_values(t):
    return base.values(_board(t), VORP)


@query(
    "q_flex_seats",
    f"""WITH {_BOARD}, s AS (SELECT o.*, place <= 12 * n AS starts FROM o JOIN (VALUES ('QB', 1), ('RB', 2), ('WR', 2), ('TE', 1), ('K', 1), ('DST', 1)) k(position, n) USING (position)),
f AS (SELECT *, starts OR (position IN ('RB', 'WR', 'TE') AND row_number() OVER (PARTITION BY NOT starts AND position IN ('RB', 'WR', 'TE') ORDER BY points DESC, player) <= 12) AS s2 FROM s),
g AS (SELECT *, s2 OR (position IN ('QB', 'RB', 'WR', 'TE') AND row_number() OVER (PARTITION BY NOT s2 AND position IN ('QB', 'RB', 'WR', 'TE') ORDER BY points DESC, player) <= 12) AS s3 FROM f)
SELECT position, count(*) FILTER (s3) AS starters FROM g GROUP BY position""",
)
def flex_seats(t):
    return base.seats(_board(t), 12, SLOTS, {"FLEX": (1, ["RB", "WR", "TE"]), "SUPER_FLEX": (1, ["QB", "RB", "WR", "TE"])})


def _fit_sql(by: str) -> str:
    k, on, part = (f"{by}, ", f"AND f.{by} = r.{by}", f"PARTITION BY {by} ") if by else ("", "", "")
    g = f"r.{by}, " if by else ""
    return f"""
WITH r AS (SELECT {k}date_trunc('month', l_shipdate) AS month, CAST(l_quantity AS DECIMAL(12,2)) AS x, CAST(l_extendedprice AS DECIMAL(14,2)) AS y FROM lineitem),
s AS (SELECT {k}month, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM r GROUP BY ALL),
w AS (SELECT {k}month, CAST(sum(n) OVER b AS DOUBLE) AS n, CAST(sum(sx) OVER b AS DOUBLE) AS sx, CAST(sum(sy) OVER b AS DOUBLE) AS sy, CAST(sum(sxx) OVER b AS DOUBLE) AS sxx, CAST(sum(sxy) OVER b AS DOUBLE) AS sxy
  FROM s WINDOW b AS ({part}ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CASE WHEN n * sxx - sx * sx > 0 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE 0 END AS slope FROM w WHERE n > 0)
SELECT {g}CAST(r.month AS TIMESTAMP) AS month, CAST(any_value(f.n) AS BIGINT) AS n_before, count(*) AS n, round(avg(abs(y - ((sy - slope * sx) / f.n + slope * x))), 4) AS mae, round(avg(abs(y - sy / f.n)), 4) AS mae_mean, round(avg(y - ((sy - slope * sx) / f.n + slope * x)), 4) AS bias
FROM r JOIN f ON f.month = r.month {on} GROUP BY {g}r.month"""


def _sales(t):
    return t.lineitem.select(
        "l_returnflag", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month"), F.col("l_quantity").cast("decimal(12,2)").alias("x"), F.col("l_extendedprice").cast("decimal(14,2)").alias("y")
    )


def _rounded(df):
    return df.withColumns({c: F.round(c, 4) for c in ("mae", "mae_mean", "bias")})


@query("q_walk_forward", _fit_sql(""))
def walk_forward(t):
    return _rounded(walkforward.backtest(_sales(t), "month", "x", "y"))


@query("q_walk_forward_by", _fit_sql("l_returnflag"))
def walk_forward_by(t):
    return _rounded(walkforward.backtest(_sales(t), "month", "x", "y", "l_returnflag"))


def _season(t):
    """Parts are players; a brand's eight dearest are its roster, all others are free; a quarter of the
    year is a week, its quantity the points."""
    part = t.part.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("player"), F.element_at(F.array(*map(F.lit, _POSITIONS[:3])), F.col("p_size") % 3 + 1).alias("position"), F.col("p_brand").alias("team"), "p_retailprice"
    )
    roster = base.best(part, 8, "team", "p_retailprice").select("team", "player", "position")
    points = t.lineitem.groupBy(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("player"), F.quarter("l_shipdate").alias("week")).agg(F.sum("l_quantity").alias("points"))
    return roster, part.join(roster, "player", "left_anti").select("player", "position"), points


@query(
    "q_add_drop_weeks",
    """
WITH p AS (SELECT 'p' || p_partkey AS player, ['QB', 'RB', 'WR'][p_size % 3 + 1] AS position, p_brand AS team, p_retailprice FROM part),
r AS (SELECT team, player, position FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY p_retailprice DESC, player) AS k FROM p) WHERE k <= 8),
f AS (SELECT player, position FROM p WHERE player NOT IN (SELECT player FROM r)),
s AS (SELECT * FROM (VALUES ('QB', 1), ('RB', 2), ('WR', 2)) k(position, n)),
x AS (SELECT 'p' || l_partkey AS player, quarter(l_shipdate) AS week, sum(l_quantity) AS x FROM lineitem GROUP BY ALL),
w AS (SELECT DISTINCT week FROM x),
c AS (SELECT r.team, f.player AS a, f.position AS q, r.player AS d FROM f CROSS JOIN r),
m AS (SELECT c.team, c.a, c.d, r.player, r.position FROM c JOIN r ON r.team = c.team AND r.player <> c.d UNION ALL SELECT team, a, d, a, q FROM c UNION ALL SELECT team, NULL, NULL, player, position FROM r),
v AS (SELECT m.*, w.week, coalesce(x.x, 0) AS x FROM m CROSS JOIN w LEFT JOIN x ON x.player = m.player AND x.week = w.week),
o AS (SELECT *, row_number() OVER (PARTITION BY team, a, d, week, position ORDER BY x DESC, player) AS k FROM v),
t AS (SELECT team, a, d, sum(CASE WHEN k <= n THEN x ELSE 0 END) AS worth FROM o JOIN s USING (position) GROUP BY ALL),
g AS (SELECT t.team, t.a, t.d, round(t.worth - n.worth, 6) AS gain FROM t JOIN t n ON n.team = t.team AND n.a IS NULL WHERE t.a IS NOT NULL)
SELECT team, a AS "add", d AS "drop", gain + 0.0::DOUBLE AS gain FROM (SELECT *, row_number() OVER (PARTITION BY team, a ORDER BY gain DESC, d) AS k FROM g) WHERE k = 1
""",
)
def add_drop_weeks(t):
    roster, free, points = _season(t)
    return upgrades.add_drop_weeks(roster, free, points, {"QB": 1, "RB": 2, "WR": 2})


def _leagues(t):
    """A nation is a league, its suppliers are the teams and its customers the picks of its draft; an
    older load had every customer as a keeper, the newer one tells of those without debts."""
    text = lambda c: F.col(c).cast("string")
    key = [F.lit("p").alias("platform"), text("nation").alias("league"), F.lit(2026).alias("season")]
    supplier = t.supplier.withColumn("nation", F.col("s_nationkey"))
    size = supplier.groupBy("nation").agg(F.count(F.lit(1)).cast("int").alias("num_teams"), F.min("s_suppkey").cast("string").alias("first"))
    customer = t.customer.withColumn("nation", F.col("c_nationkey")).join(size, "nation")
    player = F.concat(F.lit("x"), text("c_custkey"))
    pick = lambda df, keeper: df.select(*key, F.lit("D").alias("draft"), F.col("c_custkey").alias("pick_no"), F.when(F.col("c_acctbal") < 5000, F.col("first")).alias("team"), player.alias("player"), F.lit(keeper).alias("is_keeper"))
    base_load = {
        "leagues": size.join(t.nation.select(F.col("n_nationkey").alias("nation"), "n_name"), "nation").select(*key, F.col("n_name").alias("name"), "num_teams"),
        "teams": supplier.select(*key, text("s_suppkey").alias("team"), F.col("s_name").alias("display_name"), (F.lit(False)).alias("is_me")),
        "drafts": size.select(*key, F.lit("D").alias("draft"), F.lit("complete").alias("status")),
    }
    roster = lambda df, week: df.select(*key, F.lit(week).alias("week"), F.col("first").alias("team"), player.alias("player"), F.lit("BN").alias("slot"))
    mappings = t.customer.where("c_mktsegment != 'BUILDING'").select(
        F.lit("p").alias("source"), player.alias("external_id"), F.concat(F.lit("c"), text("c_custkey")).alias("player_id"), F.lit("dynastyprocess").alias("method"), F.lit(1.0).cast("float").alias("confidence"), F.lit(False).alias("verified")
    )
    held, _ = leagues.upsert(base_load | {"picks": pick(customer, True), "rosters": roster(customer, 1)}, {}, mappings)
    clear = customer.where("c_acctbal >= 0")
    return leagues.upsert(base_load | {"picks": pick(clear, False), "rosters": roster(clear, 1)}, held, mappings)[0]


_LEAGUE_SQL = "WITH s AS (SELECT s_nationkey AS k, min(s_suppkey) AS first FROM supplier GROUP BY 1), c AS (SELECT * FROM customer JOIN s ON k = c_nationkey)"


@query(
    "q_league_picks",
    f"""{_LEAGUE_SQL} SELECT n_name AS name, c_custkey AS pick_no, s_name AS display_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'c' || c_custkey END AS player_id, c_acctbal < 0 AS is_keeper
FROM c JOIN nation ON n_nationkey = c_nationkey LEFT JOIN supplier ON s_suppkey = first AND c_acctbal < 5000""",
)
def league_picks(t):
    held = _leagues(t)
    picks = held["picks"].join(held["drafts"].select("draft_id", "league_id"), "draft_id").join(held["leagues"].select("league_id", "name"), "league_id")
    return picks.join(held["teams"].select("team_id", "display_name"), "team_id", "left").select("name", "pick_no", "display_name", "player_id", "is_keeper")


@query("q_league_slots", f"{_LEAGUE_SQL} SELECT s_name AS display_name, 1 AS week, 'c' || c_custkey AS player_id, 'BN' AS slot FROM c JOIN supplier ON s_suppkey = first WHERE c_mktsegment <> 'BUILDING' AND (c_acctbal >= 0 OR NOT EXISTS (SELECT 1 FROM c o WHERE o.k = c.k AND o.c_acctbal >= 0))")
def league_slots(t):
    held = _leagues(t)
    return held["slots"].join(held["teams"].select("team_id", "display_name"), "team_id").select("display_name", "week", "player_id", "slot")
