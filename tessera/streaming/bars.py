"""Bars that arrive as a stream: late corrections replace what is stored, watermarked sums watch the flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.schemas import PRICES
from tessera.sources.store import PriceStore


def read(spark: SparkSession, path: str, schema: str = PRICES, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, store: PriceStore, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Upserts every micro-batch; of bars for one key in a batch the last one by `seq` stays, or without that column the greatest. Replays are harmless."""

    def upsert(batch: DataFrame, _: int) -> None:
        if "seq" in batch.columns:
            batch = batch.groupBy("symbol", "date").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "seq"]), "seq").alias("b")).select("b.*")
        else:  # without an order among them, the greatest
            batch = batch.groupBy("symbol", "date").agg(F.max(F.struct(*batch.columns)).alias("b")).select("b.*")
        store.store(batch)

    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def volumes(stream: DataFrame, late: str = "3 days", span: str = "7 days") -> DataFrame:
    """Traded volume and number of bars of each symbol in tumbling windows; later rows than the watermark are dropped."""
    timed = stream.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", span), "symbol").agg(F.sum("volume").alias("volume"), F.count("*").alias("bars"))
