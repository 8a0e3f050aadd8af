"""Own factor returns against published ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Own factor, published series, expected sign; the correlation asked for; the least periods.
PAIRS = (("market", "mkt_rf", 1), ("value", "hml", 1), ("size", "smb", -1), ("momentum", "mom", 1))
BAR, LEAST = 0.8, 8


def compounded(daily: DataFrame, edges: DataFrame, cols: Sequence[str]) -> DataFrame:
    """as_of and the compound return of each column over (as_of, next as_of]; a missing day counts as no change.

    Each day looks up its period in the sorted union of days and edges, so no range join is needed.
    """
    marks = edges.select(F.col("as_of").alias("date")).distinct().withColumn("mark", F.lit(1))
    days = daily.select("date", *cols).withColumn("mark", F.lit(0))
    run = Window.partitionBy(F.lit(0)).orderBy("date", "mark").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    placed = days.unionByName(marks, allowMissingColumns=True).withColumn("as_of", F.max(F.when(F.col("mark") == 1, F.col("date"))).over(run)).filter("mark = 0 and as_of is not null")
    last = marks.agg(F.max("date").alias("last"))
    inside = placed.crossJoin(F.broadcast(last)).filter("as_of < last")  # one row
    return inside.groupBy("as_of").agg(*[(F.coalesce(F.product(1 + F.col(c)), F.lit(1.0)) - 1).alias(c) for c in cols])


def cross_check(own: DataFrame, daily: DataFrame, pairs: Sequence[tuple[str, str, int]] = PAIRS, bar: float = BAR, least: int = LEAST) -> DataFrame:
    """factor, series, sign, correlation, periods, passed. own has (as_of, factor, value)."""
    cols = sorted({s for _, s, _ in pairs})
    outside = compounded(daily, own.select("as_of").distinct(), cols)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(s).alias("series"), F.lit(k).alias("sign"), F.col(s).alias("there")) for f, s, k in pairs]))
    both = outside.select("as_of", each.alias("e")).select("as_of", "e.*").join(own, ["as_of", "factor"]).na.drop(subset=["there", "value"])
    g = both.groupBy("factor", "series", "sign").agg(F.try_divide(F.covar_pop("value", "there"), F.stddev_pop("value") * F.stddev_pop("there")).alias("c"), F.count("*").alias("periods"))
    corr = F.when(F.col("periods") >= least, F.col("c"))
    return g.select("factor", "series", "sign", corr.alias("correlation"), "periods", F.coalesce(corr * F.col("sign") >= bar, F.lit(False)).alias("passed"))
