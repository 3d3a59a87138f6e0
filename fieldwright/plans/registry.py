"""Registration of queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.workers import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """Tables of a folder by attribute: t.orders, t.lineitem, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def registrar(found: dict):
    """A decorator that files a query of Tables under a name with its SQL."""

    def query(name: str, sql: str | None = None, decimals: tuple[str, ...] = ()):
        """decimals: exact sums that are returned as doubles, on both sides."""

        def wrap(f):
            def run(spark, sf_dir):
                out = f(Tables(spark, sf_dir))
                return out.withColumns({c: out[c].cast("double") for c in decimals})

            cast = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in decimals)
            found[name] = (run, f"SELECT * REPLACE ({cast}) FROM ({sql})" if sql and decimals else sql)
            return f

        return wrap

    return query
