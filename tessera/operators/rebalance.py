"""Trades from a current book to a target, with a band around each weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import RebalanceError

ON_TARGET = 1e-9


def plan(current: DataFrame, target: DataFrame, nav: float | None, band: float = 0.05, cost_bps: float = 2.0, min_trade: float = 0.0) -> DataFrame:
    """symbol, before, target, drift, dollars, action ('trade' or 'skip'), cost, after; trades by size, then skips by drift.

    A drift within the band or a trade below min_trade is skipped; symbols on
    target don't appear. A symbol that only one book has counts as 0 in the other.
    """
    if nav is None:
        raise RebalanceError("the book has no value in money; give shares or cash")
    if band < 0 or cost_bps < 0 or min_trade < 0:
        raise RebalanceError("band, costs and the least trade can't be negative")
    a, b = current.select("symbol", F.col("weight").alias("before")), target.select("symbol", F.col("weight").alias("target"))
    both = a.join(b, "symbol", "full").na.fill(0.0, ["before", "target"]).withColumn("drift", F.col("target") - F.col("before"))
    both = both.filter(F.abs("drift") >= ON_TARGET).withColumn("dollars", F.col("drift") * nav)
    skip = (F.abs("drift") <= band) | (F.abs("dollars") < min_trade)
    out = both.withColumn("action", F.when(skip, "skip").otherwise("trade"))
    out = out.withColumn("cost", F.when(skip, 0.0).otherwise(F.abs("dollars") * cost_bps / 10_000)).withColumn("after", F.when(skip, F.col("before")).otherwise(F.col("target")))
    return out.orderBy(F.desc("action"), F.desc(F.abs("dollars")))


def totals(rows: DataFrame, current: DataFrame) -> DataFrame:
    """One row: traded dollars, cost, n_trades, n_skipped and the cash weight after."""
    moved = rows.agg(
        F.coalesce(F.sum(F.when(F.col("action") == "trade", F.abs("dollars"))), F.lit(0.0)).alias("traded"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.count_if(F.col("action") == "trade").alias("n_trades"), F.count_if(F.col("action") == "skip").alias("n_skipped"), F.coalesce(F.sum(F.col("after") - F.col("before")), F.lit(0.0)).alias("change"),
    )
    held = current.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("held"))
    return moved.crossJoin(held).select("traded", "cost", "n_trades", "n_skipped", (1 - F.col("held") - F.col("change")).alias("cash_after"))
