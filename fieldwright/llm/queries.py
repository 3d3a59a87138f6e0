"""The operators bound to the tables of a folder: one query each, with production settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, conversation_trie, decontaminate, divergence, html_text, language, line_dedup, ngram_join, packing, pii, quality, quality_model, token_counts
from .shared import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked, found = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"))
    ids = F.col(found)["item_ids"]
    listed = F.array_join(F.array_sort(F.transform(ids, lambda i: i.cast("string"))), ",")
    hits = decontaminate.hit_words(found)
    return marked.select(
        "doc_id",
        F.col(found)["n_words"].alias("n_words"),
        hits.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.read(bitpack.write(table(spark, sf_dir, "documents")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, gone = line_dedup.dedup(docs)
    return out.select("doc_id", F.col(gone).alias("n_removed"), "text")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.size(k.name).cast("long").alias(f"n_{k.name}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(pii.BASE), 256).alias("base_sha256"), pii.spans_text((*pii.BASE, *pii.FURTHER)).alias("spans"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found, name = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", language.is_held_out().alias("held_out"), F.col(name)["lang_pred"].alias("lang_pred"), F.col(name)["score"].alias("score"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, name = quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality_model.is_held_out().alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.conversations(table(spark, sf_dir, "conversations"))
    return conversation_trie.trie(conversation_trie.with_shared_starts(turns))


def queries() -> dict:
    import corpus_pipeline

    own = (
        op1_decontamination,
        op2_token_store,
        op3_line_dedup,
        op4_packing,
        op5_quality,
        op6_token_counts,
        op7_ngram_join,
        op8_pii,
        op9_language,
        op10_html_extraction,
        op11_divergence,
        op12_quality_model,
        op13_conversation_trie,
    )
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}
