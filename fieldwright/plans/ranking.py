"""Ranks, running values and aggregates over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as rel
from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)


@query(
    "q_latest_partition",
    "WITH y AS (SELECT o_orderkey, year(o_orderdate) AS season, CAST(o_orderdate AS DATE) AS scrape_date FROM orders) SELECT o_orderkey, season, scrape_date FROM y WHERE (season, scrape_date) IN (SELECT season, max(scrape_date) FROM y GROUP BY season)",
)
def latest_partition(t):
    y = t.orders.select("o_orderkey", F.year("o_orderdate").cast("long").alias("season"), F.to_date("o_orderdate").alias("scrape_date"))
    newest = y.groupBy("season").agg(F.max("scrape_date").alias("scrape_date"))
    return y.join(newest, ["season", "scrape_date"]).select("o_orderkey", "season", "scrape_date")


@query(
    "q_latest_success",
    "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END DESC NULLS LAST, event_id DESC) AS n FROM events WHERE event_type = 'view') WHERE n = 1",
)
def latest_success(t):
    done = F.when(F.col("event_id") % 5 != 0, F.col("ts"))
    rows = t.events.where("event_type = 'view'").withColumn("done", done)
    return rel.newest(rows, ["user_id"], [F.col("done").desc_nulls_last(), F.desc("event_id")]).select("user_id", "event_id")


@query("q_keep_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def keep_first(t):
    return rel.keep_first(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query(
    "q_points_allowed",
    "SELECT s_nationkey, p_type, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS points FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    decimals=("points",),
)
def points_allowed(t):
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("s_nationkey", "p_type").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).alias("points"))


@query(
    "q_success_rate",
    "SELECT s_nationkey, l_returnflag, count(*) AS plays, round(avg(CASE WHEN l_discount >= 0.05 THEN 1.0e0 ELSE 0.0e0 END), 6) AS rate FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
)
def success_rate(t):
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rate = F.round(F.avg(F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0)), 6)
    return rows.groupBy("s_nationkey", "l_returnflag").agg(F.count(F.lit(1)).alias("plays"), rate.alias("rate"))


_MONTHLY = "SELECT o_custkey AS k, date_diff('month', TIMESTAMP '1992-01-01', o_orderdate) AS m, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY ALL"


def monthly(t, key: str = "o_custkey"):
    m = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1
    return t.orders.groupBy(F.col(key).alias("k"), m.cast("long").alias("m")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))


@query(
    "q_ewma",
    f"WITH a AS ({_MONTHLY}), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY m) AS n FROM a) SELECT x.k, x.m, round(sum(pow(0.5e0, (x.n - y.n) / 4.0e0) * CAST(y.v AS DOUBLE)) / sum(pow(0.5e0, (x.n - y.n) / 4.0e0)), 4) AS blend FROM r x LEFT JOIN r y ON x.k = y.k AND y.n < x.n GROUP BY x.k, x.m",
)
def ewma(t):
    from ..operators.features import recency_blend

    return recency_blend(monthly(t), ["k"], "m", "v").select("k", "m", F.round("blend", 4).alias("blend"))


@query(
    "q_percentile_gap",
    "WITH r AS (SELECT p_partkey, p_brand, p_retailprice, coalesce(v, 0) AS v FROM part LEFT JOIN (SELECT l_partkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY 1) ON l_partkey = p_partkey) SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY v) - percent_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice), 9) AS gap FROM r",
)
def percentile_gap(t):
    v = t.lineitem.groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("v"))
    r = t.part.join(v, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("v", F.coalesce("v", F.lit(0)))
    by = Window.partitionBy("p_brand")
    return r.select("p_partkey", F.round(F.percent_rank().over(by.orderBy("v")) - F.percent_rank().over(by.orderBy("p_retailprice")), 9).alias("gap"))


@query(
    "q_open_close",
    "SELECT user_id, CAST(ts AS DATE) AS day, arg_min(value, (ts, event_id)) AS opened, arg_max(value, (ts, event_id)) AS closed FROM events WHERE value IS NOT NULL GROUP BY ALL",
)
def open_close(t):
    at = F.struct("ts", "event_id")
    rows = t.events.where("value is not null").groupBy("user_id", F.to_date("ts").alias("day"))
    return rows.agg(F.min_by("value", at).alias("opened"), F.max_by("value", at).alias("closed"))


@query(
    "q_tier_cliff",
    "WITH r AS (SELECT p_partkey, p_brand, ntile(6) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS tier FROM part) SELECT p_partkey, tier, count(*) OVER (PARTITION BY p_brand, tier) AS remaining, count(*) OVER (PARTITION BY p_brand, tier) <= 13 AS cliff FROM r",
)
def tier_cliff(t):
    r = t.part.select("p_partkey", "p_brand", F.ntile(6).over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")).alias("tier"))
    n = F.count(F.lit(1)).over(Window.partitionBy("p_brand", "tier"))
    return r.select("p_partkey", F.col("tier").cast("long").alias("tier"), n.alias("remaining"), (n <= 13).alias("cliff"))


_REV = "SELECT c_nationkey AS team, date_diff('month', TIMESTAMP '1992-01-01', o_orderdate) AS wk, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS pts FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"


def weekly(t):
    return monthly_of(t).select(F.col("k").alias("team"), F.col("m").alias("wk"), F.col("v").alias("pts"))


def monthly_of(t):
    m = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_nationkey").alias("k"), m.cast("long").alias("m")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))


@query(
    "q_all_play",
    f"WITH w AS ({_REV}) SELECT a.team, count(*) FILTER (WHERE a.pts > b.pts) AS wins, count(*) FILTER (WHERE a.pts = b.pts) AS ties, count(*) AS games FROM w a JOIN w b ON a.wk = b.wk AND a.team <> b.team GROUP BY a.team",
)
def all_play(t):
    from ..operators.season import all_play as of

    return of(weekly(t), "team", "wk", "pts")


@query(
    "q_schedule_luck",
    f"WITH w AS ({_REV}), p AS (SELECT team, wk, pts, row_number() OVER (PARTITION BY wk ORDER BY team) AS n, count(*) OVER (PARTITION BY wk) AS c FROM w), g AS (SELECT a.team, a.wk, CASE WHEN a.pts > b.pts THEN 1.0e0 WHEN a.pts = b.pts THEN 0.5e0 ELSE 0.0e0 END AS won FROM p a JOIN p b ON a.wk = b.wk AND (a.n + 1) // 2 = (b.n + 1) // 2 AND a.n <> b.n), al AS (SELECT a.team, sum(CASE WHEN a.pts > b.pts THEN 1.0e0 WHEN a.pts = b.pts THEN 0.5e0 ELSE 0 END) / count(*) AS share FROM w a JOIN w b ON a.wk = b.wk AND a.team <> b.team GROUP BY a.team) SELECT g.team, round(avg(won) - max(share), 6) AS luck FROM g JOIN al ON g.team = al.team GROUP BY g.team",
)
def schedule_luck(t):
    from ..operators.season import luck, pair_up

    w = weekly(t)
    return luck(w, pair_up(w, "team", "wk"), "team", "wk", "pts").select("team", F.round("luck", 6).alias("luck"))


@query(
    "q_standings",
    f"WITH w AS ({_REV}), s AS (SELECT team, count(*) FILTER (WHERE pts > 2000000) AS wins, sum(pts) AS pts FROM w GROUP BY team) SELECT team, wins, pts, rank() OVER (ORDER BY wins DESC, pts DESC) AS place FROM s",
    decimals=("pts",),
)
def standings(t):
    from ..operators.season import standings as of

    s = weekly(t).groupBy("team").agg(F.count_if(F.col("pts") > 2_000_000).alias("wins"), F.sum("pts").alias("pts"))
    return of(s, ["wins", "pts"])


@query("q_median_gap", "SELECT c_custkey, round(c_acctbal - median(c_acctbal) OVER (PARTITION BY c_mktsegment), 6) AS gap FROM customer")
def median_gap(t):
    # the median is an aggregate joined back: a window would sort and hold each whole segment
    m = t.customer.groupBy("c_mktsegment").agg(F.median("c_acctbal").alias("m"))
    return t.customer.join(F.broadcast(m), "c_mktsegment").select("c_custkey", F.round(F.col("c_acctbal") - F.col("m"), 6).alias("gap"))


@query("q_top3", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 3")
def top3(t):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return t.part.select("p_brand", "p_partkey", F.row_number().over(w).alias("n")).where("n <= 3").drop("n")


@query("q_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50")
def page(t):
    return t.orders.where("o_orderkey > 1000").orderBy("o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query(
    "q_last_run",
    "SELECT event_type, max(ts) AS last_run, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE AS stale FROM events WHERE event_id % 3 = 0 GROUP BY event_type",
)
def last_run(t):
    now = t.events.agg(F.max("ts").alias("now"))
    runs = t.events.where("event_id % 3 = 0").groupBy("event_type").agg(F.max("ts").alias("last_run"))
    return runs.crossJoin(F.broadcast(now)).select("event_type", "last_run", (F.col("last_run") < F.col("now") - F.expr("INTERVAL 10 MINUTES")).alias("stale"))


@query(
    "q_bye_weeks",
    "WITH g AS (SELECT DISTINCT c_nationkey AS team, CAST(date_trunc('week', o_orderdate) AS DATE) AS wk FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'), w AS (SELECT DISTINCT wk FROM g) SELECT n_nationkey AS team, wk FROM nation CROSS JOIN w WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.team = n_nationkey AND g.wk = w.wk)",
)
def bye_weeks(t):
    from ..operators.season import byes

    rows = t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    games = rows.select(F.col("c_nationkey").alias("team"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("wk"))
    return byes(t.nation.select(F.col("n_nationkey").alias("team")), games, "team", "wk")
