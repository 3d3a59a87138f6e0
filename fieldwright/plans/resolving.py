"""The ladder and the bulk id file bound to the test tables: customers are people, orders and
customers bring outside ids."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import idfile, ladder
from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)
NOW = datetime(2026, 1, 1)


def _people(t, only=None):
    rows = t.customer.where(only) if only is not None else t.customer
    return idfile._as_players(
        rows.select(
            F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("player_id"),
            F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("gsis_id"),
            F.col("c_name").alias("name"),
            F.lit("WR").alias("position"),
        )
    )


def _batch(t):
    """Orders bring ids of their priority's source.  Open ones are mapped already, the first of a
    customer as a guess or, for a customer in debt, by hand; done ones come in as facts, the others
    without a name."""
    first = t.orders.where("o_orderstatus = 'O'").groupBy("o_orderpriority", "o_custkey").agg(F.min(F.col("o_orderkey").cast("string")).alias("external_id"))
    held = first.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    owes = F.col("c_acctbal") < 0
    mappings = held.select(
        F.col("o_orderpriority").alias("source"),
        "external_id",
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("player_id"),
        F.when(owes, "manual").otherwise("exact_name").alias("method"),
        F.when(owes, 1.0).otherwise(0.95).cast("float").alias("confidence"),
        owes.alias("verified"),
    )
    none = F.lit(None).cast("string")
    inputs = t.orders.where("o_orderstatus != 'O'").select(
        F.col("o_orderpriority").alias("source"),
        F.col("o_orderkey").cast("string").alias("external_id"),
        none.alias("raw_name"),
        none.alias("raw_position"),
        F.col("o_orderstatus").alias("raw_team"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("g"), F.col("o_custkey").cast("string"))).alias("gsis_id"),
    )
    queue = t.spark.createDataFrame([], ladder.QUEUE)
    return ladder.resolve_batch(inputs, _people(t), mappings, queue, NOW)


_SQL = """
WITH held AS (SELECT o_orderpriority AS source, min(CAST(o_orderkey AS VARCHAR)) AS external_id, o_custkey AS c, any_value(c_acctbal) < 0 AS owes
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY o_orderpriority, o_custkey),
i AS (SELECT o_orderpriority AS source, CAST(o_orderkey AS VARCHAR) AS external_id, o_custkey AS c, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'O'),
f AS (SELECT i.*, min(external_id) OVER (PARTITION BY source, c) = external_id AS first FROM i WHERE s = 'F' AND c IN (SELECT c_custkey FROM customer)),
r AS (SELECT i.*, h.owes, CASE WHEN f.source IS NULL THEN 'no_name_or_position' WHEN f.first AND NOT coalesce(h.owes, false) THEN NULL ELSE 'duplicate_for_source' END AS reason
  FROM i LEFT JOIN f USING (source, external_id) LEFT JOIN held h ON h.source = i.source AND h.c = i.c AND f.source IS NOT NULL)
"""


@query(
    "q_ladder_results",
    _SQL
    + """SELECT source, external_id, CASE WHEN reason IS NULL THEN 'c' || c END AS player_id, CASE WHEN reason IS NULL THEN 'gsis' ELSE 'unmatched' END AS method,
  CASE WHEN reason IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN reason IS NULL THEN 'resolved' ELSE 'unmatched' END AS outcome, reason FROM r""",
)
def ladder_results(t):
    return _batch(t)[0].drop("guess")


@query(
    "q_ladder_mappings",
    _SQL
    + """, won AS (SELECT source, external_id, c FROM r WHERE reason IS NULL)
SELECT source, external_id, 'c' || c AS player_id, 'gsis' AS method, false AS verified FROM won UNION ALL
SELECT source, external_id, 'c' || c, CASE WHEN owes THEN 'manual' ELSE 'exact_name' END, owes FROM held WHERE NOT EXISTS (SELECT 1 FROM won WHERE won.source = held.source AND won.c = held.c)""",
)
def ladder_mappings(t):
    return _batch(t)[1].drop("confidence")


@query(
    "q_ladder_queue",
    _SQL
    + """, won AS (SELECT source, c FROM r WHERE reason IS NULL)
SELECT source, external_id, s AS raw_team, reason, false AS resolved FROM r WHERE reason IS NOT NULL UNION ALL
SELECT source, external_id, NULL, 'displaced', false FROM held WHERE EXISTS (SELECT 1 FROM won WHERE won.source = held.source AND won.c = held.c)""",
)
def ladder_queue(t):
    return _batch(t)[2].select("source", "external_id", "raw_team", "reason", "resolved")


def _file(t):
    """A row for each customer; builders are not in the registry yet, machinists play no position that
    counts, debtors hold another sleeper id by a guess, households are mapped less surely."""
    key = F.col("c_custkey").cast("string")
    none = F.lit(None).cast("string")
    rows = t.customer.select(
        F.col("c_custkey").alias("row_no"),
        F.concat(F.lit("m"), key).alias("mfl_id"),
        F.concat(F.lit("g"), key).alias("gsis_id"),
        F.concat(F.lit("s"), key).alias("sleeper_id"),
        F.concat(F.lit("e"), F.col("c_nationkey").cast("string")).alias("espn_id"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("y"), key)).alias("yahoo_id"),
        *[none.alias(c) for c in ("sportradar_id", "fantasypros_id", "pfr_id", "rotowire_id", "team", "birthdate", "draft_year", "college")],
        F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "LB").otherwise("WR").alias("position"),
    )
    person = F.concat(F.lit("c"), key).alias("player_id")
    guess = lambda source, ext, method, sure: [F.lit(source).alias("source"), ext.alias("external_id"), person, F.lit(method).alias("method"), F.lit(sure).cast("float").alias("confidence"), F.lit(False).alias("verified")]
    known = t.customer.where("c_mktsegment != 'BUILDING'")
    mappings = known.where("c_acctbal < 0").select(guess("sleeper", F.concat(F.lit("old"), key), "fuzzy", 0.89))
    mappings = mappings.unionByName(known.where("c_mktsegment = 'HOUSEHOLD'").select(guess("yahoo", F.concat(F.lit("y"), key), "exact_name", 0.95)))
    return idfile.apply(rows, _people(t, "c_mktsegment != 'BUILDING'"), mappings, t.spark.createDataFrame([], ladder.QUEUE), NOW)


@query(
    "q_id_file_report",
    """
WITH r AS (SELECT *, c_mktsegment = 'BUILDING' AS new FROM customer WHERE c_mktsegment <> 'MACHINERY'),
shared AS (SELECT c_nationkey FROM r GROUP BY c_nationkey HAVING count(*) > 1),
n AS (
  SELECT 'inserted' AS field, (SELECT count(*) FROM r) + (SELECT count(*) FROM r WHERE c_acctbal > 0 AND c_mktsegment <> 'HOUSEHOLD') + (SELECT count(*) FROM r WHERE c_nationkey NOT IN (SELECT c_nationkey FROM shared)) AS n
  UNION ALL SELECT 'updated', (SELECT count(*) FROM r WHERE c_acctbal > 0 AND c_mktsegment = 'HOUSEHOLD')
  UNION ALL SELECT 'created_players', (SELECT count(*) FROM r WHERE new)
  UNION ALL SELECT 'skipped_position', (SELECT count(*) FROM customer WHERE c_mktsegment = 'MACHINERY')
  UNION ALL SELECT unnest(['unchanged', 'merged_placeholders', 'skipped_no_ids', 'skipped_dst', 'skipped_no_person_key']), 0
  UNION ALL SELECT 'ambiguous_in_file', (SELECT count(*) FROM shared)
  UNION ALL SELECT 'displaced', (SELECT count(*) FROM r WHERE c_acctbal < 0 AND NOT new)
)
SELECT field, CAST(n AS BIGINT) AS n FROM n
""",
)
def id_file_report(t):
    _, counts, listed = _file(t)
    return counts.unionByName(listed.groupBy("field").agg(F.count(F.lit(1)).alias("n")))


@query(
    "q_id_file_mappings",
    """
WITH r AS (SELECT *, 'g' || c_custkey AS g, c_mktsegment = 'BUILDING' AS new FROM customer WHERE c_mktsegment <> 'MACHINERY'),
p AS (SELECT *, CASE WHEN new THEN 'p-' || substr(sha256('gsis:' || g), 1, 32) ELSE 'c' || c_custkey END AS player_id FROM r),
o AS (SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT 'sleeper' AS source, 's' || c_custkey AS external_id, player_id, 'dynastyprocess' AS method FROM p
UNION ALL SELECT 'yahoo', 'y' || c_custkey, player_id, 'dynastyprocess' FROM p WHERE c_acctbal > 0
UNION ALL SELECT 'yahoo', 'y' || c_custkey, player_id, 'exact_name' FROM p WHERE c_acctbal <= 0 AND c_mktsegment = 'HOUSEHOLD'
UNION ALL SELECT 'espn', 'e' || c_nationkey, player_id, 'dynastyprocess' FROM p WHERE c_nationkey IN (SELECT c_nationkey FROM r GROUP BY 1 HAVING count(*) = 1)
UNION ALL SELECT 'sleeper', 'old' || c_custkey, 'c' || c_custkey, 'fuzzy' FROM o WHERE c_acctbal < 0
""",
)
def id_file_mappings(t):
    return _file(t)[0]["mappings"].select("source", "external_id", "player_id", "method")
