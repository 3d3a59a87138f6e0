"""Joins: coverage, look-ups, similarity, as-of, pairs, merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import relational as rel
from ..operators.closeness import close_pairs
from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)


@query("q_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("q_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(
    "q_coverage",
    "SELECT count(*) AS n, count(o_custkey) AS matched, count(*) - count(o_custkey) AS unmatched FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey",
)
def coverage(t):
    other = t.orders.where("o_orderstatus = 'P'").select("o_custkey").distinct()
    met = F.col("o_custkey").isNotNull()
    return t.customer.join(other, F.col("c_custkey") == F.col("o_custkey"), "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(met).alias("matched"), F.count_if(~met).alias("unmatched"))


@query("q_foreign_keys", "SELECT o_orderkey FROM orders ANTI JOIN customer ON o_custkey = c_custkey")
def foreign_keys(t):
    return rel.orphans(t.orders.withColumnRenamed("o_custkey", "c_custkey"), t.customer, ["c_custkey"]).select("o_orderkey")


@query("q_inner_report", "SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def inner_report(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("q_lookup_left", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 40) ON l_partkey = p_partkey")
def lookup_left(t):
    return t.lineitem.join(t.part.where("p_size < 40"), F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "p_brand")


@query(
    "q_first_hit_priority",
    "WITH k AS (SELECT c_custkey, 1 AS pr, CAST(c_custkey * 2 AS VARCHAR) AS id FROM customer UNION ALL SELECT c_custkey, 2, CAST(c_custkey AS VARCHAR) FROM customer), m AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id, o_custkey AS player FROM orders) SELECT c_custkey, arg_min(player, pr) AS player FROM k JOIN m USING (id) GROUP BY c_custkey",
)
def first_hit_priority(t):
    ids = t.customer.select("c_custkey", F.explode(F.array(F.struct(F.lit(1).alias("pr"), (F.col("c_custkey") * 2).cast("string").alias("id")), F.struct(F.lit(2).alias("pr"), F.col("c_custkey").cast("string").alias("id")))).alias("k"))
    known = t.orders.select(F.col("o_custkey").cast("string").alias("id"), F.col("o_custkey").alias("player")).distinct()
    return ids.select("c_custkey", "k.pr", "k.id").join(known, "id").groupBy("c_custkey").agg(F.min_by("player", "pr").alias("player"))


_WILD = """
WITH i AS (SELECT o_orderkey, c_mktsegment AS seg, c_nationkey AS nat, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(round(c_acctbal / 1000) AS BIGINT) END AS team FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT c_custkey, c_mktsegment AS seg, c_nationkey AS nat, CAST(round(c_acctbal / 1000) AS BIGINT) AS team FROM customer)
SELECT o_orderkey, CASE WHEN count(c_custkey) FILTER (WHERE i.team IS NULL OR i.team = c.team) = 1 THEN max(c_custkey) FILTER (WHERE i.team IS NULL OR i.team = c.team) END AS player
FROM i JOIN c USING (seg, nat) GROUP BY o_orderkey
"""


@query("q_exact_wildcard", _WILD)
def exact_wildcard(t):
    # namesakes are counted once, with and without the team, so no item meets its candidates
    team = F.round(F.col("c_acctbal") / 1000).cast("long")
    c = t.customer.select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat"), team.alias("team"))
    i = t.orders.join(c.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    i = i.select("o_orderkey", "seg", "nat", F.when(F.col("o_orderkey") % 3 != 0, F.col("team")).alias("team"))
    only = F.when(F.count(F.lit(1)) == 1, F.max("c_custkey"))
    named, exact = c.groupBy("seg", "nat").agg(only.alias("any_team")), c.groupBy("seg", "nat", "team").agg(only.alias("same_team"))
    met = i.join(named, ["seg", "nat"]).join(exact, ["seg", "nat", "team"], "left")
    return met.select("o_orderkey", F.when(F.col("team").isNull(), F.col("any_team")).otherwise(F.col("same_team")).alias("player"))


_FUZZY = """
WITH q AS (SELECT p_partkey AS id, p_type, p_brand, lower(substr(p_name, 1, 3) || substr(p_name, 5)) AS name FROM part),
c AS (SELECT p_partkey, p_type, p_brand, lower(p_name) AS name FROM part),
s AS (SELECT id, p_partkey, jaro_winkler_similarity(q.name, c.name) AS sim FROM q JOIN c USING (p_type, p_brand)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, p_partkey) AS rn, lead(sim) OVER (PARTITION BY id ORDER BY sim DESC, p_partkey) AS nxt FROM s WHERE sim >= 0.92)
SELECT id, p_partkey AS match, round(least(sim, 0.89), 6) AS confidence FROM r WHERE rn = 1 AND (nxt IS NULL OR sim - nxt >= 0.01)
"""


@query("q_fuzzy_block", _FUZZY)
def fuzzy_block(t):
    # a pair of names is scored once, whatever block it is in; a name with several parts has no clear winner
    block = ["p_type", "p_brand"]
    q = t.part.select(F.col("p_partkey").alias("id"), *block, F.lower(F.concat(F.substring("p_name", 1, 3), F.substring("p_name", 5, 1000))).alias("a"))
    c = t.part.groupBy(*block, F.lower("p_name").alias("b")).agg(F.min("p_partkey").alias("match"), F.count(F.lit(1)).alias("n"))
    near = close_pairs(q, t.part.select(F.lower("p_name").alias("b")), "a", "b")
    scored = q.select(*block, "a").distinct().join(near, "a").join(c, [*block, "b"])
    w = Window.partitionBy(*block, "a").orderBy(F.desc("sim"), "match")
    top = scored.select(*block, "a", "match", "n", "sim", F.row_number().over(w).alias("rn"), F.lead("sim").over(w).alias("next"))
    clear = top.where((F.col("rn") == 1) & (F.col("n") == 1) & (F.col("next").isNull() | (F.col("sim") - F.col("next") >= 0.01)))
    return q.join(clear, [*block, "a"]).select("id", "match", F.round(F.least("sim", F.lit(0.89)), 6).alias("confidence"))


@query("q_not_mapped", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def not_mapped(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("q_key_intersection", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def key_intersection(t):
    return t.lineitem.where("l_returnflag = 'R'").join(t.part.where("p_size = 1"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_partkey").distinct()


@query("q_zip_slots", "SELECT l_orderkey, n AS slot, l_partkey AS player FROM (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) WHERE n <= 3")
def zip_slots(t):
    starters = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"])
    g = t.lineitem.groupBy("l_orderkey").agg(starters.alias("p"))
    z = F.arrays_zip(F.slice(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)]), 1, F.least(F.size("p"), F.lit(3))).alias("slot"), F.slice("p", 1, 3).alias("player"))
    return g.select("l_orderkey", F.explode(z).alias("z")).select("l_orderkey", "z.slot", "z.player")


_PAIR = """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'P'),
m AS (SELECT o_custkey, (n + 1) // 2 AS matchup, min(o_orderkey) AS home, CASE WHEN count(*) = 2 THEN max(o_orderkey) END AS away FROM r GROUP BY 1, 2)
SELECT o_custkey, matchup, home, away FROM m
"""


@query("q_pairing", _PAIR)
def pairing(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    r = t.orders.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey", F.floor((F.row_number().over(w) + 1) / 2).alias("matchup"))
    return r.groupBy("o_custkey", "matchup").agg(F.min("o_orderkey").alias("home"), F.when(F.count(F.lit(1)) == 2, F.max("o_orderkey")).alias("away"))


@query("q_free_agents", "SELECT p_partkey FROM part ANTI JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) ON l_partkey = p_partkey")
def free_agents(t):
    held = t.lineitem.where("l_quantity > 45").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("roster")).select(F.explode("roster").alias("p_partkey"))
    return t.part.join(held, "p_partkey", "left_anti").select("p_partkey")


@query("q_team_names", "SELECT o_orderkey, coalesce(nullif(c_mktsegment, 'BUILDING'), c_name) AS team FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def team_names(t):
    c = t.customer.where("c_acctbal > 0")
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), "c_name").alias("team"))


@query(
    "q_crosswalk_join",
    "SELECT o_orderpriority, sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0 GROUP BY ALL",
    decimals=("qty",),
)
def crosswalk_join(t):
    usable = t.customer.where("c_acctbal >= 0")
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(usable, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("o_orderpriority").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty"))


@query(
    "q_backtest",
    "SELECT p_brand, count(*) AS n, round(avg(abs(p_retailprice - a)), 6) AS mae FROM part JOIN (SELECT l_partkey, avg(l_extendedprice / l_quantity) AS a FROM lineitem GROUP BY 1) ON l_partkey = p_partkey GROUP BY p_brand",
)
def backtest(t):
    actual = t.lineitem.groupBy("l_partkey").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("a"))
    rows = t.part.join(actual, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("p_retailprice") - F.col("a"))), 6).alias("mae"))


@query(
    "q_asof_status",
    "WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) SELECT p.event_id, v.view_id AS asof_view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts",
)
def asof_status(t):
    p = t.events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    v = t.events.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("vts")).agg(F.max("event_id").alias("view_id"))
    return rel.as_of(p, v, ["user_id"], "ts", "vts", ["view_id"]).select("event_id", "asof_view_id")


@query("q_conditional_join", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_orderstatus <> 'F'")
def conditional_join(t):
    return t.orders.join(t.customer, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderstatus") != "F"), "left").select("o_orderkey", "c_name")


@query("q_ordered_pairs", "SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) > 1")
def ordered_pairs(t):
    # lines of one order are few by nature, so the pairs per order stay bounded
    a = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("a"))
    b = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("b"))
    return a.join(b, "l_orderkey").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("q_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -c_custkey, 0.0 FROM customer WHERE c_custkey % 500 = 0")
def upsert(t):
    target = t.customer.select("c_custkey", "c_acctbal")
    changed = target.where("c_custkey % 7 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    new = target.where("c_custkey % 500 = 0").select((-F.col("c_custkey")).alias("c_custkey"), F.lit(0.0).alias("c_acctbal"))
    return rel.merge(target, changed.union(new), ["c_custkey"])


@query("q_insert_absent", "SELECT n_nationkey AS k FROM nation UNION SELECT n_nationkey + 10 FROM nation")
def insert_absent(t):
    target = t.nation.select(F.col("n_nationkey").alias("k"))
    return rel.insert_absent(target, target.select((F.col("k") + 10).alias("k")), ["k"])


@query("q_replace_slice", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT o_custkey, -o_orderkey FROM orders WHERE o_custkey % 10 = 0")
def replace_slice(t):
    target = t.orders.select("o_custkey", "o_orderkey")
    return rel.replace_slice(target, target.where("o_custkey % 10 = 0").select("o_custkey", (-F.col("o_orderkey")).alias("o_orderkey")), ["o_custkey"])


@query(
    "q_review_queue",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '*' ELSE c_name END AS raw_name, CASE WHEN c_custkey % 3 = 0 THEN 'open' WHEN c_custkey % 2 = 0 THEN 'resolved' ELSE 'open' END AS status FROM customer",
)
def review_queue(t):
    from ..operators.identity import refresh_queue

    queue = t.customer.select("c_custkey", F.col("c_name").alias("raw_name"), F.when(F.col("c_custkey") % 2 == 0, "resolved").otherwise("open").alias("status"))
    seen = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")).alias("raw_name"))
    return refresh_queue(queue, seen, ["c_custkey"], ["raw_name"])
