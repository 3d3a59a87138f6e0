"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared after white space is squeezed.  The unit of an edit is a word and the
bound is one: lines are near when one word inserted, deleted or replaced makes them equal
and leaves them alike by ``SIMILAR`` or more: one word does where both have ``MIN_WORDS``
words or more; shorter lines are near only when they are equal.  Of near or equal lines the earliest
stays (by doc_id, then a hash of the text, then line number), the others are removed.

1. Equal lines meet by two hashes; the least place of each is kept (a partial aggregate, so
   a line in a third of all documents is one row per task).
2. A near pair agrees in the first or second half of the shorter line, so only lines that
   share a half with another line go on; their words are stored.
3. For these every variant with one word deleted becomes a hashed key.  Equal variants at
   one place mean a replaced word, a variant equal to a whole line an inserted one.  Each
   key keeps its earliest line, so large groups meet in one row instead of in pairs.
4. The edit distance of each line and its key's earliest is verified on the words.

The hash of a word sequence is the sum of the hashes of its neighbouring pairs (its ends
have a neighbour too), so a word's deletion changes three terms: a line of n words yields n
variants and one key for the whole line with n steps of work, however long it is.

Defined cases: lines without a word (blank lines) and null texts stay as they are; rows
equal in id and text count as one document and keep the same lines; a null id sorts first;
a document that loses all its words stays with the empty text here, and the pipeline stage
drops it; other columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_staged, fresh, release_shuffles, staged

SIMILAR = 0.8
#: One word of so many is the first that leaves SIMILAR of a line.
MIN_WORDS = 5
_SPACE = "[ \\t\\x0B\\f\\r]"
_FIRST_ID = -(2**63)
#: What half of which line a key stands for: first or second half of a core as long as the
#: line (it is equally long or the shorter one), or shorter by a word (it has the inserted one).
_EQUAL_A, _EQUAL_Z, _LONGER_A, _LONGER_Z = range(4)


def squeezed(line: Column) -> Column:
    """White space squeezed to single spaces and trimmed."""
    odd = line.rlike("[\\t\\x0B\\f\\r]|  ")
    return F.trim(F.when(odd, F.regexp_replace(line, f"{_SPACE}+", " ")).otherwise(line))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Text with the document's place in the order: (did, th)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))


def _lines(keyed: DataFrame) -> DataFrame:
    """did, th, no, line, and two hashes of the line."""
    lines = keyed.select("did", "th", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    lines = lines.select("did", "th", "no", squeezed(F.col("line")).alias("line")).where("line != ''")
    return lines.withColumns({"h": F.xxhash64("line"), "c": F.hash("line")})


def _half_keys(lines: DataFrame, min_words: int) -> DataFrame:
    """Four more columns: the keys of both halves of the cores a line stands for."""
    lines = lines.withColumn("n", F.length("line") - F.length(F.translate("line", " ", "")) + 1)

    def half(longer: int) -> list[Column]:
        m = F.col("n") - longer
        cut = F.shiftright(m, 1)
        fore, back = (F.call_function("substring_index", F.col("line"), F.lit(" "), k) for k in (cut, cut - m))
        return [F.when(F.col("n") >= min_words, F.xxhash64(F.lit(side), m, part)) for side, part in enumerate((fore, back))]

    keys = dict(zip(("equal_a", "equal_z", "longer_a", "longer_z"), half(0) + half(1)))
    return lines.withColumns(keys)


def _pairs(words: Column) -> Column:
    """Hash of each word with the one before it; the last stands for the end alone."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    bare = F.lit(0).cast("long")
    return F.zip_with(F.concat(F.array(bare), hashed), F.concat(hashed, F.array(bare)), _pair)


def _pair(a: Column, b: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(a, b), 24)  # 40 bits: sums stay within a long


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by at most one replaced, inserted or deleted word."""
    na, nb = F.size(a), F.size(b)
    short = F.least(na, nb)
    differ = F.transform(F.slice(F.arrays_zip(a.alias("x"), b.alias("y")), F.lit(1), short), lambda p: p["x"] != p["y"])
    back = F.transform(
        F.slice(F.arrays_zip(F.reverse(a).alias("x"), F.reverse(b).alias("y")), F.lit(1), short), lambda p: p["x"] != p["y"]
    )
    same = lambda d: F.when(F.array_position(d, True) == 0, short).otherwise(F.array_position(d, True) - 1)
    replaced = (na == nb) & (F.size(F.filter(differ, lambda d: d)) <= 1)
    inserted = (F.abs(na - nb) == 1) & (same(differ) + same(back) >= short)
    return replaced | inserted


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, th, nos): the line numbers each document loses."""
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    halves = ["equal_a", "equal_z", "longer_a", "longer_z"]
    lines = staged(_half_keys(_lines(keyed), min_words).select("did", "th", "no", "h", "c", *halves), "lines")
    place = F.struct("did", "th", "no")
    first = lines.groupBy("h", "c").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), *[F.min(k).alias(k) for k in halves])
    first = staged(first, "first-lines")
    release_shuffles(spark)

    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(k).alias("key")) for kind, k in enumerate(halves)])
    filed = first.where("equal_a is not null").select("h", F.inline(kinds))
    equal = F.col("kind") <= _EQUAL_Z
    shared = filed.groupBy("key").agg(
        F.min(F.when(equal, F.col("h"))).alias("a"), F.max(F.when(equal, F.col("h"))).alias("b"), F.max(F.when(~equal, F.lit(True))).alias("inserted")
    )
    shared = shared.select("key", (F.col("a") != F.col("b")).alias("replaced"), (F.col("a").isNotNull() & F.col("inserted")).alias("inserted"))
    shared = staged(shared.where("replaced or inserted"), "shared-halves")
    release_shuffles(spark)
    uses = {"replace": ("replaced", _EQUAL_A), "whole": ("inserted", _EQUAL_A), "delete": ("inserted", _LONGER_A)}
    met = {f"{use}_{side}": F.max(F.col(c) & (F.col("kind") == kind + k)) for use, (c, kind) in uses.items() for k, side in enumerate("az")}
    met = {flag: F.coalesce(found, F.lit(False)).alias(flag) for flag, found in met.items()}
    near = filed.join(shared, "key").groupBy("h").agg(*met.values())
    near = staged(near.where(" or ".join(met)), "near-lines")
    release_shuffles(spark)
    # the words of each candidate, from its first place: only the documents that hold one are read again
    spots = staged(near.join(first.select("h", "c", "first.*"), "h").select("did", "th", "no", "h", "c", *met), "near-places")
    own = keyed.join(spots.select("did", "th").distinct(), ["did", "th"], "left_semi").dropDuplicates(["did", "th"])
    cut = own.select("did", "th", F.split("text", "\n").alias("lines")).join(spots, ["did", "th"])
    texts = cut.select("h", "c", F.struct("did", "th", "no").alias("first"), *met, F.split(squeezed(F.get("lines", F.col("no"))), " ").alias("words"))
    texts = staged(texts, "near-words")
    release_shuffles(spark)

    n = F.size("words")
    hashed = texts.select("h", "c", "first", *met, n.alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("w"), _pairs(F.col("words")).alias("pairs"))
    hashed = hashed.withColumn("total", F.aggregate("pairs", F.lit(0).cast("long"), lambda acc, x: acc + x))
    bare = F.lit(0).cast("long")
    without = lambda i: (
        F.col("total") - F.get("pairs", i) - F.get("pairs", i + 1)
        + _pair(F.coalesce(F.get("w", i - 1), bare), F.coalesce(F.get("w", i + 1), bare))
    )

    def variants(use: str, core: Column, key) -> Column:
        """One key for each place of the core where the edit can be: behind its first half where
        the first halves agree, in or at the end of the first half where the second ones do."""
        half, last = F.shiftright(core, 1), F.col("n") - 1
        low, high = F.when(F.col(f"{use}_z"), 0).otherwise(half), F.when(F.col(f"{use}_a"), last).otherwise(F.least(half, last))
        keys = F.transform(F.sequence(low, high), lambda i: F.struct(F.lit(use).alias("use"), key(i).alias("key")))
        return F.when(F.col(f"{use}_a") | F.col(f"{use}_z"), keys).otherwise(F.array().cast("array<struct<use:string,key:bigint>>"))

    count = F.col("n")
    whole = F.when(F.col("whole_a") | F.col("whole_z"), F.array(F.struct(F.lit("whole").alias("use"), F.xxhash64(count, "total").alias("key"))))
    emitted = F.concat(
        variants("replace", count, lambda i: F.xxhash64(count, i, without(i))),
        variants("delete", count - 1, lambda i: F.xxhash64(count - 1, without(i))),
        F.coalesce(whole, F.array().cast("array<struct<use:string,key:bigint>>")),
    )
    keys = staged(hashed.select("h", "first", F.inline(emitted)), "variant-keys")
    earliest = lambda use: F.min(F.when(F.col("use") == use, F.struct("first", "h")))
    # a replaced word's variants meet their like, an inserted one's the whole lines and the other way round
    meets = {"replace": "replace", "delete": "whole", "whole": "delete"}
    best = keys.groupBy("key").agg(*[earliest(other).alias(use) for use, other in meets.items()])
    chosen = reduce(lambda found, use: F.when(F.col("use") == use, F.col(use)).otherwise(found), meets, F.lit(None))
    met_lines = keys.join(best, "key").withColumn("best", chosen)
    pairs = met_lines.where("best.first < first").select("h", F.col("best.h").alias("rep")).distinct()
    other = texts.select(F.col("h").alias("rep"), F.col("words").alias("rep_words"))
    checked = pairs.join(texts.select("h", "c", "words"), "h").join(other, "rep").where(within_one_edit(F.col("words"), F.col("rep_words")))
    near_dropped = staged(checked.select("h", "c").distinct().withColumn("gone", F.lit(True)), "near-dropped")
    release_shuffles(spark)

    verdict = first.join(near_dropped, ["h", "c"], "left").where("n > 1 or gone").select("h", "c", "first", "gone")
    lost = lines.select("did", "th", "no", "h", "c").join(verdict, ["h", "c"]).where((F.col("gone") == True) | (F.struct("did", "th", "no") != F.col("first")))  # noqa: E712
    lost = staged(lost.groupBy("did", "th").agg(F.collect_set("no").alias("nos")), "lost-lines")
    for used in (lines, first, shared, near, spots, texts, keys):
        drop_staged(used)
    release_shuffles(spark)
    return lost


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with removed lines cut out of the text, and one more column (its name is
    returned) that counts them; a text that loses lines is rejoined with its line ends."""
    lost = removed_lines(docs, min_words, id_col, text_col)
    gone, did, th = fresh(docs, "lines_removed"), fresh(docs, "did"), fresh(docs, "th")
    lost = lost.select(F.col("did").alias(did), F.col("th").alias(th), F.col("nos").alias(gone))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumn(did, F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST_ID))).withColumn(th, F.xxhash64(text))
    joined = keyed.join(lost, [did, th], "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(F.col(gone), i)), "\n")
    out = [F.when(F.col(gone).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*out, F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(gone)), gone


def dedup_stage(docs: DataFrame) -> DataFrame:
    """Documents with repeated lines removed; those that lose all their words go."""
    out, gone = dedup(docs)
    return out.where((F.col(gone) == 0) | F.col("text").rlike("[^\\s]")).drop(gone)
