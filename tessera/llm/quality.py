"""Quality selection by importance resampling.

Two generative models over hashed word n-grams, one of target text and one of
all raw text, give each document the log weight sum(log p_target - log p_raw).
Adding Gumbel noise and keeping the k largest keys draws k documents without
replacement in proportion to their weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed

#: Buckets of the n-gram hash; labelled documents that the target model and the cut are fitted on at most.
BUCKETS, LABELLED = 1 << 14, 10_000
#: N-grams that are counted at a time.
TOGETHER = 1 << 18
#: Share of labelled target documents that k may leave out.
LOSS = 0.002
_AGAIN = np.uint64(0xA0761D6478BD642F)
_TOKENS = re.compile(r"\w+|[^\w\s]+")


def features(text: str | None) -> np.ndarray:
    """Buckets of the text's unigrams and bigrams, repeated as they occur; none for a null or blank text.

    A token that repeats the one before it counts as one symbol, whatever it is.
    """
    found = _TOKENS.findall(text) if text else []
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    one[1:][one[1:] == one[:-1]] = _AGAIN
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (np.concatenate([one, two]) >> np.uint64(50)).astype(np.int64)


@dataclass(frozen=True)
class Resampler:
    """Log ratio of each bucket, and the log weight that all but LOSS of the labelled target documents reach."""

    ratio: np.ndarray
    cut: float
    seed: int = 0

    def weight(self, text: str | None) -> float:
        return float(self.ratio[features(text)].sum())


def _labelled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, good) of at most `limit` labelled documents: of bounded size."""
    known = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("label_id"), (F.col("quality") == 1).alias("good"))
    known = known.groupBy("label_id").agg(F.min("good").alias("good"))
    return known.orderBy(F.xxhash64("label_id"), "label_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> Resampler:
    """Counts n-grams of all documents for the raw model, and of labelled good ones for the target model.

    Without labelled good documents all weights are 0 and everything is kept.
    Only BUCKETS sums and the weights of `limit` labelled documents reach the driver.
    """
    sample = F.broadcast(_labelled(docs, labels, limit))
    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text"))

    def add(sums: np.ndarray, held: list[list[np.ndarray]]) -> None:
        for good, found in enumerate(held):
            f = np.bincount(np.concatenate([*found, np.zeros(0, np.int64)]), minlength=BUCKETS)
            sums[: 1 + good] += f
            found.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            held: list[list[np.ndarray]] = [[], []]  # of other and of good documents
            size = 0
            for text, good in zip(batch.column("text"), batch.column("good"), strict=True):
                held[good.as_py()].append(features(text.as_py()))
                size += len(held[good.as_py()][-1])
                if size > TOGETHER:
                    add(sums, held)
                    size = 0
            add(sums, held)
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[0, used]), pa.array(sums[1, used])], ["bucket", "raw", "target"])

    marked = texts.join(sample, "label_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    sums = marked.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[sums["bucket"]], target[sums["bucket"]] = sums["raw"], sums["target"]
    if not target.sum():
        return Resampler(np.zeros(BUCKETS), 0.0, seed)
    # The target model is smoothed by the raw one, so a bucket that few documents use keeps a ratio near 1.
    prior, pseudo = raw / raw.sum(), 0.01 * BUCKETS
    p = (target + pseudo * prior) / (target.sum() + pseudo)
    ratio = np.log(np.divide(p, prior, out=np.ones(BUCKETS), where=prior > 0))
    model = Resampler(ratio, 0.0, seed)
    weights = texts.join(sample.filter("good"), "label_id").select("label_id", _weights(model, docs.sparkSession)("text").alias("w"))
    good = weights.groupBy("label_id").agg(F.min("w").alias("w")).toPandas()["w"]  # one of each labelled id
    return Resampler(model.ratio, float(np.quantile(good, LOSS, method="lower")), seed)


def _weights(model: Resampler, spark):
    """A column function text -> log weight."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def weights(texts: pa.Array) -> pa.Array:
        return pa.array([sent.value.weight(t.as_py()) for t in texts], pa.float64())

    return weights


def kth_largest(rows: DataFrame, col: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a double column without sorting it: histograms that close in on it. None if there are fewer rows."""
    lo, hi = rows.agg(F.min(col), F.max(col)).first()
    if lo is None or k <= 0:
        return None
    while lo < hi:
        width = (hi - lo) / bins
        at = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        inside = rows.filter(F.col(col).between(lo, hi)).groupBy((at if width else F.lit(0)).alias("bin"))
        found = inside.agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).orderBy(F.desc("bin")).collect()  # at most `bins` rows
        for r in found:
            if r["n"] >= k:
                break
            k -= r["n"]
        else:
            return None
        if (r["lo"], r["hi"]) == (lo, hi):
            break
        lo, hi = r["lo"], r["hi"]
    return lo


def _keyed(docs: DataFrame, model: Resampler, id_col: str, text_col: str) -> DataFrame:
    weight = _weights(model, docs.sparkSession)(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), weight.alias("log_weight"))
    return checkpointed(rows.withColumn("sample_key", F.col("log_weight") + gumbel(F.col("doc_id"), model.seed)))


def _edge(keyed: DataFrame, model: Resampler, k: int | None) -> float:
    """The least key that is drawn."""
    k = keyed.filter(F.col("log_weight") >= model.cut).count() if k is None else k
    edge = kth_largest(keyed, "sample_key", k)
    return (-np.inf if k > 0 else np.inf) if edge is None else edge


def resample(docs: DataFrame, model: Resampler, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight, sample_key, kept for each row of docs; kept marks the k largest keys.

    By default k is the number of documents whose log weight reaches the model's
    cut. Ties at the k-th key are all kept. Null and blank texts weigh 0; rows
    that repeat an id share its noise, rows without an id that of 0; other
    columns are ignored, whatever their names; an empty table gives an empty
    result.
    """
    keyed = _keyed(docs, model, id_col, text_col)
    return keyed.withColumn("kept", F.col("sample_key") >= F.lit(float(_edge(keyed, model, k))))


def drawn(docs: DataFrame, model: Resampler, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that resample() keeps, with all their columns. Texts are weighed again, which is cheaper than joining them."""
    edge = float(_edge(_keyed(docs, model, id_col, text_col), model, k))
    weight = _weights(model, docs.sparkSession)(F.col(text_col).cast("string"))
    return docs.filter(weight + gumbel(F.col(id_col).cast("long"), model.seed) >= edge)


def gumbel(ids, seed: int):
    """Gumbel noise that id and seed decide, in (-4, 44)."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(ids, F.lit(0))), 11) + 0.5) / F.lit(2.0**53)
    return -F.log(-F.log(u))
