"""Projections, predicates, reshapes, counts, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import relational as rel
from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)


@query("q_blank_to_null", "SELECT c_custkey, CASE WHEN trim(s) <> '' THEN s END AS segment FROM (SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN '  ' ELSE c_mktsegment END AS s FROM customer)")
def blank_to_null(t):
    s = F.when(F.col("c_nationkey") % 3 == 0, "  ").otherwise(F.col("c_mktsegment"))
    return t.customer.select("c_custkey", rel.blank_to_null(s).alias("segment"))


@query("q_case_map", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'REG' ELSE 'POST' END AS kind FROM orders")
def case_map(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "REG").otherwise("POST").alias("kind"))


@query("q_derived_bool", "SELECT o_orderkey, nullif(o_orderstatus, 'P') = 'F' AS closed, o_orderkey % 2 = 1 AS odd FROM orders")
def derived_bool(t):
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return t.orders.select("o_orderkey", (status == "F").alias("closed"), (F.col("o_orderkey") % 2 == 1).alias("odd"))


@query("q_season_filter", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1996")
def season_filter(t):
    # a range of the raw column reaches the Parquet scan; a function of it would not
    d = F.col("o_orderdate")
    return t.orders.where((d >= F.lit("1996-01-01").cast("timestamp_ntz")) & (d < F.lit("1997-01-01").cast("timestamp_ntz"))).select("o_orderkey", "o_custkey", "o_totalprice")


@query("q_null_safe_membership", "SELECT p_partkey, coalesce(b IN ('Brand#12', 'Brand#23'), false) AS kept FROM (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_brand END AS b FROM part)")
def null_safe_membership(t):
    brand = F.when(F.col("p_size") > 10, F.col("p_brand"))
    return t.part.select("p_partkey", rel.is_member(brand, ["Brand#12", "Brand#23"]).alias("kept"))


@query(
    "q_row_accounting",
    "SELECT p_type, count(*) AS n, count(*) FILTER (WHERE p_size <= 25) AS kept, count(*) FILTER (WHERE NOT coalesce(p_size <= 25, false)) AS dropped FROM part GROUP BY p_type",
)
def row_accounting(t):
    kept = F.coalesce(F.col("p_size") <= 25, F.lit(False))
    return t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


_NULLED = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS b, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey END AS c FROM orders"


def _nulled(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", *[F.when(k % m == 0, F.col("o_custkey")).alias(c) for m, c in ((2, "a"), (3, "b"), (5, "c"))])


@query("q_any_not_null", f"SELECT o_orderkey FROM ({_NULLED}) WHERE coalesce(a, b, c) IS NOT NULL")
def any_not_null(t):
    return _nulled(t).where(rel.any_not_null("a", "b", "c")).select("o_orderkey")


@query("q_horizontal_count", f"SELECT o_orderkey, CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT) AS n FROM ({_NULLED})")
def horizontal_count(t):
    return _nulled(t).select("o_orderkey", rel.count_not_null("a", "b", "c").alias("n"))


@query("q_prefix_predicate", "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'STANDARD') OR starts_with(p_type, 'ECONOMY') OR starts_with(p_type, 'P')")
def prefix_predicate(t):
    return t.part.where(rel.starts_with_any(F.col("p_type"), ["STANDARD", "ECONOMY", "P"])).select("p_partkey", "p_type")


@query(
    "q_null_safe_equality",
    "SELECT o_orderkey, a IS NOT DISTINCT FROM b AS same, a IS DISTINCT FROM b AS other FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS b FROM orders)",
)
def null_safe_equality(t):
    k = F.col("o_orderkey")
    df = t.orders.select("o_orderkey", F.when(k % 2 == 0, F.col("o_orderstatus")).alias("a"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("b"))
    same = F.col("a").eqNullSafe(F.col("b"))
    return df.select("o_orderkey", same.alias("same"), (~same).alias("other"))


_MAPPED = "SELECT l_orderkey, l_linenumber, CAST(0.8 + l_discount * 2 AS FLOAT) AS confidence, CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'exact_name' ELSE 'fuzzy' END AS method, l_linestatus = 'F' AS verified FROM lineitem"


def _mapped(t):
    method = F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "exact_name").otherwise("fuzzy")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", (0.8 + F.col("l_discount") * 2).cast("float").alias("confidence"), method.alias("method"), (F.col("l_linestatus") == "F").alias("verified")
    )


@query("q_usable_mapping", f"SELECT l_orderkey, l_linenumber FROM ({_MAPPED}) WHERE method <> 'rejected' AND (CAST(confidence AS DOUBLE) >= 0.9e0 - 1e-6 OR verified)")
def usable_mapping(t):
    from ..operators.identity import is_usable

    return _mapped(t).where(is_usable()).select("l_orderkey", "l_linenumber")


@query(
    "q_authority",
    f"SELECT l_orderkey, l_linenumber, CAST(confidence AS DOUBLE) >= 1.0e0 - 1e-6 AND method IN ('gsis', 'dynastyprocess', 'manual') AS authoritative, NOT verified AND method NOT IN ('dynastyprocess', 'manual', 'rejected') AND CAST(confidence AS DOUBLE) < 1.0e0 - 1e-6 AS displaceable FROM ({_MAPPED})",
)
def authority(t):
    from ..operators.identity import is_authoritative, is_displaceable

    return _mapped(t).select("l_orderkey", "l_linenumber", is_authoritative().alias("authoritative"), is_displaceable().alias("displaceable"))


@query(
    "q_unpivot_ids",
    "SELECT c_custkey, source, external_id FROM (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nat, c_mktsegment AS seg, CASE WHEN c_acctbal > 0 THEN c_name END AS nam FROM customer) UNPIVOT (external_id FOR source IN (nat AS 'nation', seg AS 'segment', nam AS 'name'))",
)
def unpivot_ids(t):
    wide = t.customer.select("c_custkey", F.col("c_nationkey").cast("string").alias("nat"), F.col("c_mktsegment").alias("seg"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("nam"))
    return rel.unpivot(wide, ["c_custkey"], {"nat": "nation", "seg": "segment", "nam": "name"}, "source", "external_id")


@query("q_name_split", "SELECT p_partkey, regexp_extract(trim(p_name), '^(\\S+)', 1) AS first_name, nullif(regexp_replace(trim(p_name), '^\\S+\\s*', ''), '') AS last_name FROM part")
def name_split(t):
    first, rest = names.name_parts(F.col("p_name"))
    return t.part.select("p_partkey", first.alias("first_name"), rest.alias("last_name"))


@query(
    "q_lenient_date",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders",
)
def lenient_date(t):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    broken = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("x"), text)).otherwise(text)
    return t.orders.select("o_orderkey", F.try_to_date(broken, "yyyy-MM-dd").alias("d"))


@query("q_group_count", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def group_count(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("q_ambiguous_keys", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 3")
def ambiguous_keys(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n")).where("n > 3")


@query("q_dups_having", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dups_having(t):
    return rel.duplicates(t.lineitem, ["l_orderkey", "l_partkey"])


@query(
    "q_rollup_counts",
    "SELECT event_type, d AS day, count(*) AS n FROM (SELECT event_type, CAST(ts AS DATE) AS d FROM events) GROUP BY ROLLUP (event_type, d)",
)
def rollup_counts(t):
    return t.events.select("event_type", F.to_date("ts").alias("day")).rollup("event_type", "day").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q_totals",
    "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders, count(*) - count(nullif(l_linenumber, 1)) AS nulls, coalesce(CAST(sum(CASE WHEN l_discount > 1 THEN 1 END) AS BIGINT), 0) AS none FROM lineitem",
)
def totals(t):
    return t.lineitem.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("l_orderkey").alias("orders"),
        F.count_if(F.nullif(F.col("l_linenumber"), F.lit(1)).isNull()).alias("nulls"),
        F.coalesce(F.sum(F.when(F.col("l_discount") > 1, 1)), F.lit(0)).cast("long").alias("none"),
    )


@query("q_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("q_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def difference(t):
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.where("o_orderstatus = 'F'").select("o_custkey"))


@query("q_intersection", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def intersection(t):
    return t.customer.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")).intersect(t.supplier.where("s_acctbal > 5000").select("s_nationkey"))


@query("q_deterministic_sort", "SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_nationkey, s_name, s_suppkey) AS place FROM supplier ORDER BY place LIMIT 20")
def deterministic_sort(t):
    # the first few by a total order: a bounded heap per task, no global sort
    top = t.supplier.orderBy("s_nationkey", "s_name", "s_suppkey").limit(20).select("s_suppkey", "s_name", "s_nationkey")
    from pyspark.sql import Window

    return top.select("s_suppkey", "s_name", F.row_number().over(Window.orderBy("s_nationkey", "s_name", "s_suppkey")).alias("place"))


_NAME_SQL = """
WITH n AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(x), '[.''’\\-]', '', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS s
           FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Mike ' || p_name || ' Jr.' WHEN 1 THEN 'D.J. ' || p_name || ' III' WHEN 2 THEN 'Ja''Marr ' || p_name ELSE p_name || ' Sr' END AS x FROM part)),
m AS (SELECT p_partkey, regexp_replace(s, '( (jr|sr|ii|iii|iv|v))+$', '') AS s FROM n)
SELECT p_partkey, CASE WHEN s = 'mike' OR starts_with(s, 'mike ') THEN 'michael' || substr(s, 5) ELSE s END AS name FROM m
"""


@query("q_normalize_name", _NAME_SQL)
def normalize_name(t):
    k = F.col("p_partkey") % 4
    x = F.when(k == 0, F.concat(F.lit("Mike "), "p_name", F.lit(" Jr."))).when(k == 1, F.concat(F.lit("D.J. "), "p_name", F.lit(" III")))
    x = x.when(k == 2, F.concat(F.lit("Ja'Marr "), "p_name")).otherwise(F.concat("p_name", F.lit(" Sr")))
    return t.part.select("p_partkey", names.normalize_name(x).alias("name"))


@query(
    "q_normalize_position",
    "SELECT c_custkey, CASE c_nationkey % 6 WHEN 0 THEN 'K' WHEN 1 THEN 'RB' WHEN 2 THEN 'DST' WHEN 3 THEN 'DST' WHEN 4 THEN NULL ELSE 'QB' END AS position FROM customer",
)
def normalize_position(t):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("pk", "F.B.", "D/ST", "def", "CB", "qb")]), (F.col("c_nationkey") % 6 + 1).cast("int"))
    return t.customer.select("c_custkey", names.normalize_position(raw).alias("position"))


@query(
    "q_college_agree",
    "SELECT p_partkey, contains(a, b) OR contains(b, a) OR len(list_intersect(list_filter(string_split(a, ' '), lambda x: x NOT IN ('state', 'of')), string_split(b, ' '))) > 0 AS agree FROM (SELECT p_partkey, lower(p_name) AS a, lower(p_type) || ' ' || split_part(lower(p_name), ' ', 1 + CAST(p_partkey % 5 AS INT)) AS b FROM part)",
)
def college_agree(t):
    part = F.coalesce(F.get(F.split(F.lower("p_name"), " "), (F.col("p_partkey") % 5).cast("int")), F.lit(""))
    return t.part.select("p_partkey", names.schools_agree(F.col("p_name"), F.concat(F.col("p_type"), F.lit(" "), part)).alias("agree"))


@query("q_fold_accents", "SELECT doc_id, strip_accents(text) AS folded FROM documents")
def fold_accents(t):
    return t.documents.select("doc_id", names.fold_accents(F.col("text")).alias("folded"))


@query(
    "q_team_lookup",
    "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'KC' WHEN 1 THEN 'LA' WHEN 2 THEN 'NYJ' WHEN 3 THEN NULL ELSE 'SF' END AS team, CASE n_nationkey % 5 WHEN 0 THEN 'kc dst' WHEN 1 THEN 'la dst' WHEN 2 THEN 'nyj dst' WHEN 3 THEN NULL ELSE 'sf dst' END AS key FROM nation",
)
def team_lookup(t):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("Chiefs D/ST", "St. Louis Rams", "NY Jets", "New York", "san francisco")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return t.nation.select("n_nationkey", names.normalize_team(raw).alias("team"), names.defence_key(F.lit(None).cast("string"), raw).alias("key"))


@query("q_kickoff_utc", "SELECT o_orderkey, timezone('UTC', timezone('America/New_York', date_trunc('day', o_orderdate) + INTERVAL (12 + o_orderkey % 10) HOUR)) AS kickoff FROM orders")
def kickoff_utc(t):
    hour = F.concat(F.lpad((12 + F.col("o_orderkey") % 10).cast("string"), 2, "0"), F.lit(":00"))
    at = rel.kickoff_utc(F.date_format("o_orderdate", "yyyy-MM-dd"), hour)
    return t.orders.select("o_orderkey", at.cast("timestamp_ntz").alias("kickoff"))


@query("q_hash_tag", "SELECT page_id, sha256(html) AS etag FROM pages")
def hash_tag(t):
    return t.pages.select("page_id", F.sha2("html", 256).alias("etag"))


@query(
    "q_json_props",
    "SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS name FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)",
)
def json_props(t):
    rows = t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))
    return rows.select("event_id", "value", "name")


@query(
    "q_feet",
    "SELECT s_suppkey, CAST(round_even(s_acctbal * 3.280839895e0, 0) AS BIGINT) AS feet FROM supplier",
)
def feet(t):
    return t.supplier.select("s_suppkey", F.bround(F.col("s_acctbal") * 3.280839895, 0).cast("long").alias("feet"))


@query("q_epoch_millis", "SELECT event_id, date_trunc('millisecond', ts) AS at FROM events")
def epoch_millis(t):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", F.timestamp_millis(millis).cast("timestamp_ntz").alias("at"))


@query("q_placeholder_key", "SELECT c_custkey, coalesce('gsis:' || CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) END, 'mfl:' || CAST(c_nationkey AS VARCHAR)) AS key FROM customer")
def placeholder_key(t):
    first = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_custkey").cast("string"))
    return t.customer.select("c_custkey", F.coalesce(F.concat(F.lit("gsis:"), first), F.concat(F.lit("mfl:"), F.col("c_nationkey").cast("string"))).alias("key"))


@query("q_integral_ids", "SELECT s_suppkey, CAST(CAST(s_suppkey AS BIGINT) AS VARCHAR) AS id FROM supplier")
def integral_ids(t):
    return t.supplier.select("s_suppkey", rel.integral_text(F.col("s_suppkey").cast("double")).alias("id"))


@query("q_report_json", "SELECT n_regionkey, '{\"region\":' || n_regionkey || ',\"nations\":' || count(*) || '}' AS report FROM nation GROUP BY n_regionkey")
def report_json(t):
    rows = t.nation.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("n_regionkey", F.to_json(F.struct(F.col("n_regionkey").alias("region"), F.col("n").alias("nations"))).alias("report"))


@query("q_error_text", "SELECT doc_id, substr(text, 1, 2000) AS error FROM documents")
def error_text(t):
    return t.documents.select("doc_id", F.substring("text", 1, 2000).alias("error"))


@query("q_scoring_format", "SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'ppr' WHEN 1 THEN 'half' WHEN 2 THEN 'standard' ELSE 'custom' END AS format FROM customer")
def scoring_format(t):
    from ..operators.platform import scoring_format as of

    rec = F.element_at(F.array(*[F.lit(x) for x in (1.0, 0.5, 0.0, 0.3)]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return t.customer.select("c_custkey", of(F.create_map(F.lit("rec"), rec)).alias("format"))


@query(
    "q_evidence_packet",
    "SELECT o_custkey, '[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) || ']' AS packet FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey",
)
def evidence_packet(t):
    rows = t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    return rows.select("o_custkey", F.to_json("k").alias("packet"))
