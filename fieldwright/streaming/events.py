"""Streams over the events table.  Each runs what is there and stops; the result is read from
the files or table the sink wrote, and equals the batch query over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import new_folder


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream; event time is a timestamp, as watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    path = f"{sf_dir}/events.parquet"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else files.parquet(path)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def finished(df: DataFrame, keys: list[str], mode: str = "complete") -> DataFrame:
    """Run an aggregate over all that is there.  Each micro-batch writes its rows, from the
    executors, to a folder of its number, which a repeated batch overwrites; the result is the
    newest row of each key.  update: only changed keys are written; complete: for aggregates
    that Spark does not run in update mode."""
    spark, path, numbers = df.sparkSession, new_folder(df.sparkSession, "stream"), []

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows/batch={number}")
        numbers.append(number)

    run = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(each)
    run.trigger(availableNow=True).start().awaitTermination()
    if not numbers:
        return spark.createDataFrame([], df.schema)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])).option("basePath", f"{path}/rows")
    if mode == "complete":
        return rows.parquet(f"{path}/rows/batch={max(numbers)}").drop("batch")
    rest = [c for c in df.columns if c not in keys]
    newest = rows.parquet(f"{path}/rows").groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return newest.select(*keys, "_r.*")


def tumbling(spark: SparkSession, sf_dir: str, width: str) -> DataFrame:
    rows = source(spark, sf_dir).withWatermark("at", "1 hour").groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select(F.col("window.start").alias("start"), "event_type", "n")
    return finished(rows, ["start", "event_type"], "update").withColumn("start", F.col("start").cast("timestamp_ntz"))


def sessions(spark: SparkSession, sf_dir: str, gap: str) -> DataFrame:
    rows = source(spark, sf_dir).withWatermark("at", "1 hour").groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("user_id", F.col("session_window.start").alias("start"), "n")
    return finished(rows, ["user_id", "start"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated observations are dropped in the stream, which appends every first one as it comes and
    forgets what the watermark has passed; what it wrote is counted."""
    rows = source(spark, sf_dir).withWatermark("at", "30 days").dropDuplicates(["user_id", "event_type", "at"]).select("user_id", "event_type", "at")
    path = new_folder(spark, "distinct")
    rows.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of every user and how many there were: a live board's replay."""
    rows = source(spark, sf_dir).groupBy("user_id")
    latest = rows.agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.count(F.lit(1)).alias("n"))
    return finished(latest, ["user_id"], "update")


def apply_batches(stream: DataFrame, persist, land, checkpoint: str) -> None:
    """Each micro-batch is persisted first and landed second; both must be idempotent by batch id."""

    def each(batch: DataFrame, number: int) -> None:
        persist(batch, number)
        land(batch, number)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
