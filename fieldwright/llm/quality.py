"""Quality rules with cross-document line frequency, in DataFrame functions only.

Per document: size, symbols, repeated lines and repeated 8-word windows (base rules).
Across documents: a normalised line (lower case, white space squeezed) that stands in more
than ``MOST_DOCS`` documents of one host is boilerplate there and removed from all of them
but the first (by doc_id); a document that is left with fewer than ``MIN_LEFT`` words, or
with less than ``MIN_SHARE`` percent of its words, is depleted and rejected.

The texts are read once; what is stored and shuffled afterwards are hashes and counts of
lines.  The counting is a partial aggregate, so a line or host of a third of all rows is
one row per task; documents and counted lines meet in a join that may be split for skew.

Defined cases: a null or empty text has no words and fails the base rules; a null host is
the empty name; equal rows count as separate documents; ties of doc_id go by the row's
own number; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged

MIN_WORDS, MOST_REPEATED = 20, 30
WINDOW = 8
MOST_DOCS, MIN_LEFT, MIN_SHARE = 20, 20, 20

_SPACE = "[ \\t\\n\\x0B\\f\\r]"


def _repeat_positions(hashes: Column) -> Column:
    """Ascending positions of the window hashes that occur twice or more."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return ordered


def _windows(words: Column, n: Column) -> Column:
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))
    return F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<long>"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document with its counts, distinct line hashes, and words by line."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))
    rows = base.select(
        "doc_id",
        "host",
        "text",
        F.filter(F.split("text", f"{_SPACE}+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \\t\\n\\x0B\\f\\r]")).alias("lines"),
    )
    rows = rows.withColumn("n", F.size("words")).withColumn("windows", _windows(F.col("words"), F.col("n")))
    rows = rows.withColumn("again", F.size(F.array_distinct("windows")) < F.size("windows"))
    # only documents with a repeated window are looked at further
    ordered = F.when(F.col("again"), _repeat_positions(F.col("windows")))
    rows = rows.withColumn("ordered", ordered)
    same = lambda k, j: F.coalesce(F.get("ordered", k)["h"] == F.get("ordered", j)["h"], F.lit(False))
    found = F.transform(
        F.sequence(F.lit(0), F.size("ordered") - 1), lambda k: F.when(same(k, k - 1) | same(k, k + 1), F.get("ordered", k)["i"])
    )
    rows = rows.withColumn("places", F.when(F.col("again"), F.sort_array(F.filter(found, lambda p: p.isNotNull()))))
    covered = F.aggregate(
        F.col("places"),
        F.struct(F.lit(0).alias("until"), F.lit(0).alias("n")),
        lambda acc, p: F.struct((p + WINDOW).alias("until"), (acc["n"] + p + WINDOW - F.greatest(acc["until"], p)).alias("n")),
    )["n"]
    squeezed = F.transform("lines", lambda line: F.trim(F.regexp_replace(F.lower(line), f"{_SPACE}+", " ")))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "host",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        squeezed.alias("lines"),
    )
    line = F.transform("lines", lambda s: F.struct(F.xxhash64(s).alias("h"), (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1).alias("n")))
    rows = rows.withColumn("lines", line)
    return rows.withColumn("hashes", F.array_distinct(F.transform("lines", lambda s: s["h"])))


def assess(
    docs: DataFrame,
    most_docs: int = MOST_DOCS,
    min_left: int = MIN_LEFT,
    min_share: int = MIN_SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Counts, base_failed and kept for every document, and the words its frequent lines hold."""
    rows = staged(measures(docs, id_col, text_col, host_col), "quality")
    filed = rows.select("host", F.explode("hashes").alias("h"), "doc_id", "row")
    often = filed.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") > most_docs)
    lines = rows.select("host", "doc_id", "row", F.explode("lines").alias("line")).select("host", "doc_id", "row", "line.h", "line.n")
    met = lines.join(often, ["host", "h"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    removed = met.groupBy("row").agg(F.sum("n").cast("long").alias("n_removed"))
    out = rows.drop("lines", "hashes").join(removed, "row", "left")
    gone = F.coalesce("n_removed", F.lit(0).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = F.col("n_words") - gone
    depleted = (gone > 0) & ((left < min_left) | (100 * left < min_share * F.col("n_words")))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), gone.alias("n_removed_words")
    )
