"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the columns of documents; the last returns packed pieces. Empty
tables pass through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import langid, minhash, mixing, packing, quality
from tessera.llm.common import checkpointed, shared_folder, table, unused_name

#: Least posterior of a document's language.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null texts and those without letters go, and so do undecided ones.

    Texts of no learned language go as well: those with too few words known in
    the language found, by a bound that training texts set.
    """
    model = langid.train(docs)
    guess = langid.language_of(model, spark)(F.col("text"))
    name = unused_name(docs, "guess")
    sure = (F.col(name)["lang"] != "und") & (F.col(name)["score"] >= SURE) & (F.col(name)["share"] >= model.least_share)
    return docs.withColumn(name, guess).filter(sure).select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones draws."""
    return quality.drawn(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), the one with the smallest id.

    Of rows that repeat that id the one with the longest text stays. Rows
    without an id are linked with nothing and all kept.
    """
    kept = minhash.near_duplicates(docs, words=5, percent=80).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    place = unused_name(docs, "place")
    # The first of an id's rows is found before the shuffle, too, so a much repeated id isn't gathered.
    order = Window.partitionBy("doc_id").orderBy(F.length(F.btrim("text", F.lit(" \t\n\r\x0b\x0c"))).desc_nulls_last(), "text")
    one = docs.filter("doc_id IS NOT NULL").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).join(kept, "doc_id", "left_semi")
    return one.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of one epoch of the mixture: equal domains, languages and sources, as far as they reach.

    Each row is drawn by itself, whether its id is null or repeated; one that
    crosses the end of its leaf's budget is kept whole.
    """
    counted = checkpointed(mixing.leaves(docs))
    rows = mixing.leaves(docs, F.struct("*").alias("row"))
    return mixing.mix(rows, mixing.budgets(counted, budget=0.8, epochs=1), epochs=1, counted=counted).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in their sequences."""
    return packing.pack(packing.tokenized(docs))


STAGES = [("language", language), ("quality", good), ("near_dedup", deduplicated), ("mixing", mixed), ("packing", packed)]
#: SQL can't express the classifiers, MinHash signatures or the tokenizer: tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _reread(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def _reread(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return spark.read.parquet(path)
