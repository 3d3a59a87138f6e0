"""Scratch tables, column helpers and Arrow plumbing shared by the operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workers import ship  # noqa: F401

#: Bytes of text handled by one vectorised step; a longer text is a step of its own.
STEP_BYTES = 1 << 20

_fallback: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset and
    driver and executors are one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _fallback[app] = tempfile.mkdtemp(prefix="fieldwright-")
        spark.sparkContext.setCheckpointDir(_fallback[app])
    return _fallback[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from the
    files, so a lost executor costs one task and no stage is computed twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fieldwright/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def staged_by(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """``staged``, in a folder for each value of the keys."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fieldwright/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*keys).option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a staged table that no later plan reads."""
    _delete(df.sparkSession, df.staged_at)
    _written.remove((df.sparkSession, df.staged_at))


def trimmed(run):
    """``run`` over Arrow batches; at its end the process gives back what it has freed, as Python
    workers outlive a task and share their executor's memory with all later stages."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit
            return


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, whatever else the table holds."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def steps(texts: pa.Array, most: int = STEP_BYTES):
    """Cut a string array into slices of about ``most`` bytes; yields (first row, values as bytes)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    values = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    values = pc.fill_null(values, b"")
    n = len(values)
    sizes = pc.binary_length(values).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i in range(n):
        if held and held + sizes[i] > most:
            yield first, values.slice(first, i - first)
            first, held = i, 0
        held += int(sizes[i])
    if n > first:
        yield first, values.slice(first, n - first)
