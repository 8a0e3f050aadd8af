"""Covariance estimators in long form: (sym_i, sym_j, cov) for sym_i <= sym_j, in units of the period."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import CovarianceError

YEAR = 252


def check(returns: DataFrame) -> None:
    """Two rows of finite numbers at least."""
    g = returns.agg(F.count_if(F.col("r").isNull() | F.isnan("r") | (F.abs("r") == float("inf"))).alias("bad"), F.countDistinct("date").alias("n")).first()
    if g["bad"] or g["n"] < 2:
        raise CovarianceError(f"{g['bad']} returns aren't finite; {g['n']} dates")


def pairs(returns: DataFrame) -> DataFrame:
    """sym_i, sym_j, date, ri, rj: all pairs of a date, which is the size of what a covariance sums up."""
    a = returns.select("date", F.col("symbol").alias("sym_i"), F.col("r").alias("ri"))
    b = returns.select("date", F.col("symbol").alias("sym_j"), F.col("r").alias("rj"))
    return a.join(b, "date").filter("sym_i <= sym_j")


def sample(returns: DataFrame) -> DataFrame:
    return pairs(returns).groupBy("sym_i", "sym_j").agg(F.covar_samp("ri", "rj").alias("cov"))


def ewma(returns: DataFrame, lam: float = 0.94) -> DataFrame:
    """Weights lam^age that add up to 1, means taken as zero."""
    days = returns.select("date").distinct()
    age = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("date"))) - 1  # one row a date
    aged = returns.join(days.withColumn("w", F.pow(F.lit(lam), age)), "date")
    a = aged.select("date", F.col("symbol").alias("sym_i"), F.col("r").alias("ri"), "w")
    b = aged.select("date", F.col("symbol").alias("sym_j"), F.col("r").alias("rj"))
    both = a.join(b, "date").filter("sym_i <= sym_j").groupBy("sym_i", "sym_j")
    return both.agg((F.sum(F.col("w") * F.col("ri") * F.col("rj")) / F.sum("w")).alias("cov"))


def _empirical(returns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Biased covariances s with m = mean of squared products, and one row of what shrinkage needs: n, t, trace, squares, fourth."""
    mean = F.avg("r").over(Window.partitionBy("symbol"))
    x = pairs(returns.withColumn("r", F.col("r") - mean)).groupBy("sym_i", "sym_j")
    prod = F.col("ri") * F.col("rj")
    emp = x.agg(F.avg(prod).alias("s"), F.avg(prod * prod).alias("m"), F.count("*").alias("t"))
    twice = F.when(F.col("sym_i") == F.col("sym_j"), 1.0).otherwise(2.0)
    own = F.col("sym_i") == F.col("sym_j")
    facts = emp.agg(
        F.count_if(own).cast("double").alias("n"), F.max("t").cast("double").alias("t"), F.sum(F.when(own, F.col("s")).otherwise(0.0)).alias("trace"),
        F.sum(twice * F.col("s") * F.col("s")).alias("squares"), F.sum(twice * F.col("m")).alias("fourth"),
    )
    return emp.drop("t"), facts


def _shrunk(emp: DataFrame, facts: DataFrame) -> DataFrame:
    target = F.when(F.col("sym_i") == F.col("sym_j"), F.col("trace") / F.col("n")).otherwise(0.0)
    return emp.crossJoin(F.broadcast(facts)).select("sym_i", "sym_j", ((1 - F.col("k")) * F.col("s") + F.col("k") * target).alias("cov"))  # facts: one row


def ledoit_wolf(returns: DataFrame) -> DataFrame:
    """Shrinkage towards the average variance, by the intensity that minimises expected squared error."""
    emp, facts = _empirical(returns)
    delta = F.col("squares") / F.col("n") - F.pow(F.col("trace") / F.col("n"), F.lit(2.0))
    noise = (F.col("fourth") - F.col("squares")) / (F.col("n") * F.col("t"))
    return _shrunk(emp, facts.withColumn("k", F.coalesce(F.try_divide(F.least(noise, delta), delta), F.lit(0.0))))


def oas(returns: DataFrame) -> DataFrame:
    """The oracle-approximating intensity for normal returns, at most 1, with the same target."""
    emp, facts = _empirical(returns)
    square = F.col("trace") * F.col("trace")
    top = (1 - 2 / F.col("n")) * F.col("squares") + square
    low = (F.col("t") + 1 - 2 / F.col("n")) * (F.col("squares") - square / F.col("n"))
    return _shrunk(emp, facts.withColumn("k", F.when(low <= 0, 1.0).otherwise(F.least(F.try_divide(top, low), F.lit(1.0)))))


def annualized(cov: DataFrame, periods: int = YEAR) -> DataFrame:
    return cov.withColumn("cov", F.col("cov") * periods)


# The same estimators of a dense window (dates x symbols), for functions of groups.


def dense_sample(x: np.ndarray) -> np.ndarray:
    return np.atleast_2d(np.cov(x, rowvar=False, ddof=1))


def dense_ewma(x: np.ndarray, lam: float = 0.94) -> np.ndarray:
    w = lam ** np.arange(len(x) - 1, -1, -1.0)
    return (x.T * (w / w.sum())) @ x


def dense_ledoit_wolf(x: np.ndarray) -> np.ndarray:
    t, n = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / t
    mu = np.trace(s) / n
    delta = ((s - mu * np.eye(n)) ** 2).sum() / n
    noise = min((((x**2).T @ x**2 / t).sum() - (s**2).sum()) / (n * t), delta)
    k = noise / delta if delta > 0 else 0.0
    return (1 - k) * s + k * mu * np.eye(n)


def dense_oas(x: np.ndarray) -> np.ndarray:
    t, n = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / t
    squares, square = (s**2).sum(), np.trace(s) ** 2
    low = (t + 1 - 2 / n) * (squares - square / n)
    k = 1.0 if low <= 0 else min(((1 - 2 / n) * squares + square) / low, 1.0)
    return (1 - k) * s + k * np.trace(s) / n * np.eye(n)


DENSE = {"sample": dense_sample, "ewma": dense_ewma, "ledoit_wolf": dense_ledoit_wolf, "oas": dense_oas}
