"""Registered queries of the corpus operators, over their whole tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork.llm import chat, collocations, consistent, dartminhash, decontamination, factoring, mixing, quality
from platwork.llm import ranking, repetition, secrets, sharding, toxicity
from platwork.llm.frames import table
from platwork.llm.oracle import ORACLE


def op1_sampled_splitters(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard (0 to 15) and slot, by sizes near equal."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    docs = table(spark, folder, "documents").select("doc_id", "text", crc.cast("long").alias("text_crc32"))
    return sharding.shard_by_ranges(docs, keep=["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_repetition_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Words, symbols and repetition of every whole text, and whether it is kept."""
    return repetition.repetition(table(spark, folder, "documents"))


def op3_random_fourier(spark: SparkSession, folder: str) -> DataFrame:
    """A quality score for every whole text, learned from labels outside the held-out fold."""
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's near-duplicate class and whether it stands for it."""
    return dartminhash.near_classes(table(spark, folder, "documents"))


def op5_suffix_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that benchmark windows cover, and the items they come from."""
    found = decontamination.find_leaks(
        table(spark, folder, "documents").select("doc_id", "text"),
        table(spark, folder, "benchmark"),
        keep=["doc_id"],
    )
    n_hit = F.aggregate("leak_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_sort(F.array_distinct(F.filter(F.col("leak_matches.item_id"), lambda i: i.isNotNull())))
    return found.select(
        "doc_id", F.col("leak_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op6_relative_factors(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that windows of earlier documents cover, removed."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return factoring.factored(docs, keep=["doc_id"]).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text_kept").cast("binary"), 256).alias("kept_sha256")
    )


def op7_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score for every whole text, learned from labels outside the held-out fold."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_transcript_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Turns recovered from the plain transcripts of all conversations; the model is counted on those not held out."""
    lines = chat.transcripts(table(spark, folder, "conversations"))
    model = chat.fit(lines.where(~chat.held_out(F.col("conv_id"))))
    found = chat.recovered_lines(lines.select("conv_id", "line_no", "i", "line"), model)
    return chat.turns(found).withColumn("held_out", chat.held_out(F.col("conv_id")))


def op9_trigram_index(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every whole text: base kinds counted and hashed, all spans written out."""
    found = secrets.secrets(table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])

    def of(place) -> Column:
        return F.filter("secret_spans", lambda s: place(s["place"]))

    counts = [F.size(of(lambda p, i=i: p == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(secrets.BASE)]
    base = secrets.written_spans(of(lambda p: p < len(secrets.BASE)))
    return found.select(
        "doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        secrets.written_spans(F.col("secret_spans")).alias("spans"),
    )


def op10_pareto_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix of all documents by source weights takes of each."""
    return mixing.mixed(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op11_locally_consistent(spark: SparkSession, folder: str) -> DataFrame:
    """Every document beside its edited text and the next document, by phrase names."""
    near = consistent.with_next(table(spark, folder, "documents"))
    return near.select(
        "doc_id", "n_chars", "edited_sha256", consistent.hexed(F.col("fingerprint")).alias("fingerprint"),
        consistent.hexed(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op12_itemset_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 phrases of each language that hang together most, by dynamic itemset counting."""
    return collocations.collocations(table(spark, folder, "documents"))


def op13_reversed_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item, documents streaming past an index of items."""
    return ranking.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {"pipeline": corpus_pipeline.run} | {
    f.__name__: f
    for f in (
        op1_sampled_splitters,
        op2_repetition_coverage,
        op3_random_fourier,
        op4_dart_minhash,
        op5_suffix_arrays,
        op6_relative_factors,
        op7_kneser_ney,
        op8_transcript_roles,
        op9_trigram_index,
        op10_pareto_mixing,
        op11_locally_consistent,
        op12_itemset_phrases,
        op13_reversed_search,
    )
}

__all__ = ["ORACLE", "QUERIES"]
