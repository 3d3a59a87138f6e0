"""Relational building blocks: guards, merges, picks and reshapes as DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import written


class ContractError(ValueError):
    """A source or state table breaks its contract."""


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def is_member(c: Column, values: Sequence) -> Column:
    """Membership in which null counts as outside."""
    return F.coalesce(c.isin(*values), F.lit(False))


def any_not_null(*cols: str) -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull()


def count_not_null(*cols: str) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols])


def starts_with_any(c: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])


def unpivot(df: DataFrame, keys: Sequence[str], names: dict[str, str], name: str, value: str) -> DataFrame:
    """Wide id columns to long rows without nulls; columns are renamed by ``names``."""
    long = df.unpivot(list(keys), list(names), name, value).where(F.col(value).isNotNull())
    return long.withColumn(name, F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(name)))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of every key in a stated order (never in DataFrame order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def numbered(df: DataFrame, order: Sequence, name: str) -> DataFrame:
    """``df`` with each row's place (from 1) in a total order.  Rows are dealt by range and places
    are those of a range after the rows of the ranges before it, so no task sorts all rows."""
    rows = written(df, "unnumbered")  # the bounds of ranges are sampled, which reads the rows once more
    ranges = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")  # one row a range
    places = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    met = ranges.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return met.withColumn(name, F.col("_before") + places).drop("_range", "_before")


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """Upsert as a new snapshot: rows of the source replace or join those of the target.

    A null key matches nothing, so such a row is inserted.  With ``update`` only these
    columns change on rows that match."""
    if update is None:
        return target.join(source, list(keys), "left_anti").select(*target.columns).unionByName(source.select(*target.columns))
    s = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in update], F.lit(True).alias("_hit"))
    kept = target.join(s, list(keys), "left")
    changed = [F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in target.columns]
    new = source.join(target, list(keys), "left_anti")
    return kept.select(*changed).unionByName(new.select(*target.columns))


def insert_absent(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.unionByName(source.join(target, list(keys), "left_anti").select(*target.columns))


def replace_slice(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete every row whose key slice the source covers, then insert the source."""
    return target.join(source.select(*keys).distinct(), list(keys), "left_anti").unionByName(source.select(*target.columns))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (nulls equal each other)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a partner; must be empty where a foreign key is meant."""
    return df.join(other, list(on), "left_anti")


def newest(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    return keep_first(df, keys, order)


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """The latest right row at or before each left row's time, by one sort per key.

    Both sides are laid in one row and a running last value is taken, so no pair of rows is
    ever formed and a key is read once."""
    empty = [F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values]
    l = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), *empty)
    blank = [F.lit(None).cast(left.schema[c].dataType).alias(c) if c not in by else F.col(c) for c in left.columns]
    r = right.select(*blank, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), *[F.col(v).alias(f"_{v}") for v in values])
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r)
    return both.select("*", *[F.last(f"_{v}", ignorenulls=True).over(w).alias(f"asof_{v}") for v in values]).where("_side = 1").drop("_t", "_side", *[f"_{v}" for v in values])


def checked(df: DataFrame, required: Sequence[str] = (), key: str | None = None, floor: int = 1, text_ids: Sequence[str] = ()) -> DataFrame:
    """Contract of a landed table in one aggregate: columns, row floor, unique key, text ids."""
    missing = set(required) - set(df.columns)
    if missing:
        raise ContractError(f"missing columns {sorted(missing)}")
    wrong = [c for c in text_ids if dict(df.dtypes)[c] != "string"]
    if wrong:
        raise ContractError(f"ids that are not text: {wrong}")
    aggs = [F.count(F.lit(1)).alias("n")]
    if key:
        aggs += [F.count_distinct(key).alias("keys"), F.count_if(F.col(key).isNull()).alias("nulls")]
    row = df.agg(*aggs).head()
    if row["n"] < floor:
        raise ContractError(f"{row['n']} rows, {floor} needed")
    if key and (row["nulls"] or row["keys"] != row["n"]):
        raise ContractError(f"{key} is not a key")
    return df


def accounted(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Rows kept and dropped by a predicate in which null counts as dropped; together all rows."""
    keep = F.coalesce(keep, F.lit(False))
    return df.where(keep), df.where(~keep)


def integral_text(c: Column) -> Column:
    """Whole floating ids as text; others are an error."""
    good = c.isNull() | (~F.isnan(c) & (F.rint(c) == c))
    return F.when(good, c.cast("bigint").cast("string")).otherwise(F.raise_error(F.lit("an id is not a whole number")))


def kickoff_utc(day: Column, time: Column, zone: str = "America/New_York") -> Column:
    """Wall-clock text to UTC; the earlier instant on an overlap, an error in a gap."""
    wall = F.to_timestamp_ntz(F.concat_ws(" ", day, time), F.lit("yyyy-MM-dd HH:mm"))
    at = F.to_utc_timestamp(wall.cast("timestamp"), zone)
    back = F.from_utc_timestamp(at, zone).cast("timestamp_ntz")
    return F.when(wall.isNull() | (back == wall), at).otherwise(F.raise_error(F.lit("a wall-clock time that does not exist")))
