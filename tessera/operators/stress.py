"""Replays of past crises and shocks to factors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import StressError

#: Name, first and last day, what happened; days that a window's edges may be short of.
SCENARIOS = (
    ("gfc2008", "2008-09-01", "2009-03-09", "banking crisis, autumn to the low"),
    ("covid2020", "2020-02-19", "2020-03-23", "pandemic crash"),
    ("rates2022", "2022-01-03", "2022-10-14", "rate shock"),
)
EDGE_DAYS = 7


def replay(weights: DataFrame, prices: DataFrame, start: str, end: str, check: bool = False) -> DataFrame:
    """symbol, weight, ret, contribution over the window; worst first. Symbols without bars near both edges have a null return; with check, that is an error."""
    px = prices.select("symbol", "date", F.coalesce("adj_close", "close").alias("px")).filter("px is not null")
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    edges = px.filter(F.col("date").between(lo, hi)).groupBy("symbol").agg(F.min("date").alias("d0"), F.max("date").alias("d1"), F.min_by("px", "date").alias("p0"), F.max_by("px", "date").alias("p1"))
    whole = (F.datediff("d0", lo) <= EDGE_DAYS) & (F.datediff(hi, "d1") <= EDGE_DAYS)
    out = weights.join(edges, "symbol", "left").select("symbol", "weight", F.when(whole, F.try_divide("p1", "p0") - 1).alias("ret"))
    if check and (bad := sorted(r["symbol"] for r in out.filter("ret is null").collect())):
        raise StressError(f"no prices from {start} to {end} for {bad}")
    return out.withColumn("contribution", F.col("weight") * F.col("ret")).orderBy("contribution")


def factor_shock(weights: DataFrame, exposures: DataFrame, shocks: dict[str, float], styles: tuple[str, ...], check: bool = True) -> DataFrame:
    """factor, exposure, shock, contribution; the market's exposure is what is invested. Worst first.

    With check, holdings without all exposures are errors; without, an exposure
    that is unknown counts as 0, the holding still as invested.
    """
    if not shocks or not all(math.isfinite(x) for x in shocks.values()):
        raise StressError(f"finite shocks are needed, got {shocks}")
    if odd := sorted(set(shocks) - {"market", *styles}):
        raise StressError(f"unknown factors {odd}")
    held = weights.join(exposures, "symbol", "left")
    if check:
        if weights.isEmpty():
            raise StressError("no positions")
        if holes := sorted(r["symbol"] for r in held.filter(" or ".join(f"{s} is null" for s in styles)).select("symbol").collect()):
            raise StressError(f"no whole exposures for {holes}")
    sums = held.agg(F.sum("weight").alias("market"), *[F.coalesce(F.sum(F.col("weight") * F.col(s)), F.lit(0.0)).alias(s) for s in styles])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("exposure"), F.lit(float(s)).alias("shock")) for f, s in shocks.items()]))
    return sums.select(each.alias("e")).select("e.*").withColumn("contribution", F.col("exposure") * F.col("shock")).orderBy("contribution")
