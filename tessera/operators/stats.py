"""Statistics of return series. `by` names the columns that tell series apart; none means one series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import StatsError

YEAR = 252


def over(by: Sequence[str]):
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy("date")


def blended(returns: DataFrame, weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """date, r of portfolios with constant weights; what isn't invested earns nothing."""
    return returns.join(weights, "symbol").groupBy(*by, "date").agg(F.sum(F.col("weight") * F.col("r")).alias("r"))


def missing_symbols(returns: DataFrame, weights: DataFrame) -> DataFrame:
    return weights.select("symbol").join(returns.select("symbol").distinct(), "symbol", "left_anti")


def cagr(r: str = "r") -> Column:
    return F.when(F.count(r) >= 2, F.pow(F.product(1 + F.col(r)), F.lit(float(YEAR)) / F.count(r)) - 1)


def annual_vol(r: str = "r") -> Column:
    return F.stddev_samp(r) * F.sqrt(F.lit(float(YEAR)))


def sharpe(r: str = "r") -> Column:
    return F.try_divide(F.avg(r), F.stddev_samp(r)) * F.sqrt(F.lit(float(YEAR)))


def equity(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The series with equity (from 1 before the first row), peak so far and drawdown; the peak starts at the first row."""
    run = over(by).rowsBetween(Window.unboundedPreceding, 0)
    out = series.withColumn("equity", F.product(1 + F.col("r")).over(run))
    out = out.withColumn("peak", F.max("equity").over(run))
    return out.withColumn("drawdown", F.try_divide("equity", "peak") - 1)


def beta(series: DataFrame, benchmark: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Covariance with the benchmark over its variance on shared dates; null for fewer than two or a flat benchmark."""
    both = series.join(benchmark.select("date", F.col("r").alias("m")), "date")
    return both.groupBy(*by).agg(F.try_divide(F.covar_samp("r", "m"), F.var_samp("m")).alias("beta"))


def summary(series: DataFrame, by: Sequence[str] = (), check: bool = False) -> DataFrame:
    """n, cagr, vol, sharpe and max_drawdown of each series."""
    if check and series.limit(2).count() < 2:
        raise StatsError("two returns are needed at least")
    return equity(series, by).groupBy(*by).agg(F.count("r").alias("n"), cagr().alias("cagr"), annual_vol().alias("vol"), sharpe().alias("sharpe"), F.min("drawdown").alias("max_drawdown"))


def compute_stats(returns: DataFrame, weights: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """summary() of a book at today's weights, with beta to a benchmark series if there is one."""
    series = blended(returns, weights)
    out = summary(series)
    return out.crossJoin(F.broadcast(beta(series, benchmark))) if benchmark is not None else out  # one row
