"""Queries of the training-data operators, at production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, capfilter, langid, lm, minhash, mixing, packing, quality, sharding, warc
from tessera.llm.common import checkpointed, shared_folder, table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains equally, English half of each domain, sources equally; at most two epochs. Other languages get nothing."""
    rows = checkpointed(mixing.leaves(table(spark, sf_dir, "documents")))  # texts are read once
    plan = mixing.budgets(rows, weights={"lang": {"en": 3.0, "de": 1.0, "fr": 1.0, "es": 1.0}})
    return mixing.mix(rows, plan)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses_from_pages(table(spark, sf_dir, "pages")))
    h = F.col("headers")
    return made.select(
        "record_id", "warc_type", "refers_to", "target_uri", "content_type", F.col("block").cast("string").alias("block"), h["WARC-Block-Digest"].alias("block_digest"),
        h["WARC-Source-Payload-Digest"].alias("source_digest"), h["Content-Length"].cast("long").alias("content_length"),
    )


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are rounded to what two engines' orders of summing leave equal."""
    scored = lm.score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", *[(F.round(c, 6) + 0.0).alias(c) for c in ("log_score", "mean_log_score")])


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run starts a map of its own in the shared folder; sizes and checksums are taken before anything moves."""
    columns = ("doc_id", sharding.record_size("text").alias("size"), F.crc32("text").alias("text_crc32"), sharding.mark_of().alias("mark"))
    records = table(spark, sf_dir, "documents").select(*columns)
    path = f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    placed = sharding.shard_by_stored_map(records, path, 24, size=F.col("size"), mark=F.col("mark"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", F.col("place").alias("slot"), grown, "vslot", "map_version")


def op8_capfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.vector_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.resample(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenized(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_ann, op2_minhash, op3_langid, op4_mixing, op5_warc, op6_lm, op7_sharding, op8_capfilter, op9_quality, op10_packing)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}
