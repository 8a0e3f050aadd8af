"""Value at risk and expected shortfall, as positive fractions of value lost."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.errors import VaRError
from tessera.functions.special import cornish_fisher, pdf, ppf
from tessera.operators.stats import over

LAMBDA, BURN = 0.94, 30
METHODS = ("parametric", "historical", "filtered_historical")


def needed(confidence: float) -> int:
    return math.ceil(1 / (1 - confidence))


def check(confidence: float, horizon: int = 1, series: DataFrame | None = None, rows: int | None = None) -> None:
    """Refuses confidences outside (0.5, 1), horizons below 1 and, given a series, too few or non-finite returns."""
    if not 0.5 < confidence < 1:
        raise VaRError(f"confidence must be between 0.5 and 1, got {confidence}")
    if horizon < 1:
        raise VaRError(f"the horizon is a day at least, got {horizon}")
    if series is not None:
        g = series.agg(F.count("*").alias("n"), F.count_if(F.col("r").isNull() | F.isnan("r") | (F.abs("r") == float("inf"))).alias("bad")).first()
        least = max(needed(confidence), rows or 0)
        if g["bad"] or g["n"] < least:
            raise VaRError(f"{least} finite returns are needed, got {g['n']} with {g['bad']} bad ones")


def _named(df: DataFrame, by: Sequence[str], method: str, confidence: float, horizon: int) -> DataFrame:
    return df.select(*by, F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), F.lit(horizon).alias("horizon"), "var", "es")


def parametric(series: DataFrame, confidence: float = 0.99, horizon: int = 1, by: Sequence[str] = ()) -> DataFrame:
    check(confidence, horizon)
    z, root = ppf(1 - confidence), math.sqrt(horizon)
    g = series.groupBy(*by).agg(F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"))
    out = g.select(*by, (-(F.col("mu") * horizon + F.col("sd") * (z * root))).alias("var"), (F.col("sd") * (root * pdf(z) / (1 - confidence)) - F.col("mu") * horizon).alias("es"))
    return _named(out, by, "parametric", confidence, horizon)


def sample_moments(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, mu, sd, and skewness and excess kurtosis corrected for sample size."""
    g = series.groupBy(*by).agg(F.count("r").cast("double").alias("n"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("g1"), F.kurtosis("r").alias("g2"))
    n = F.col("n")
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3))
    return g.select(*by, "n", "mu", "sd", skew.alias("skew"), kurt.alias("kurt"))


def cornish_fisher_var(series: DataFrame, confidence: float = 0.99, horizon: int = 1, by: Sequence[str] = (), steps: int = 200) -> DataFrame:
    """The normal quantile corrected by sample skewness and kurtosis; ES averages the corrected quantile over `steps` midpoints of the tail."""
    check(confidence, horizon)
    # The correction is linear in skew, kurt and skew^2, and so is its average over the tail.
    basis = [np.array([cornish_fisher(z, *k) for z in (ppf(1 - confidence), *[ppf((1 - confidence) * (i + 0.5) / steps) for i in range(steps)])]) for k in ((0, 0), (1, 0), (0, 1), (-1, 0))]
    one = basis[0]
    lin, quad, kur = (basis[1] - basis[3]) / 2, (basis[1] + basis[3]) / 2 - one, basis[2] - one
    s, k = F.col("skew"), F.col("kurt")
    at = lambda f: F.lit(float(f(one))) + s * float(f(lin)) + s * s * float(f(quad)) + k * float(f(kur))
    root = math.sqrt(horizon)
    loss = lambda z: -(F.col("mu") * horizon + z * F.col("sd") * root)
    out = sample_moments(series, by).select(*by, loss(at(lambda v: v[0])).alias("var"), loss(at(lambda v: v[1:].mean())).alias("es"))
    return _named(out, by, "cornish_fisher", confidence, horizon)


def _tail(df: DataFrame, by: Sequence[str], col: str, confidence: float) -> DataFrame:
    """q, the quantile at 1 - confidence, and tail, the mean of what isn't above it."""
    edge = F.broadcast(df.groupBy(*by).agg(F.percentile(col, 1 - confidence).alias("q"))) if not by else df.groupBy(*by).agg(F.percentile(col, 1 - confidence).alias("q"))
    cut = df.join(edge, list(by)) if by else df.crossJoin(edge)  # without groups: one row
    return cut.groupBy(*by).agg(F.max("q").alias("q"), F.avg(F.when(F.col(col) <= F.col("q"), F.col(col))).alias("tail"))


def historical(series: DataFrame, confidence: float = 0.99, horizon: int = 1, by: Sequence[str] = ()) -> DataFrame:
    check(confidence, horizon)
    root = math.sqrt(horizon)
    out = _tail(series, by, "r", confidence).select(*by, (-F.col("q") * root).alias("var"), (-F.col("tail") * root).alias("es"))
    return _named(out, by, "historical", confidence, horizon)


def ewma_sigma(series: DataFrame, lam: float = LAMBDA, burn: int = BURN, by: Sequence[str] = ()) -> DataFrame:
    """The series with row (from 0), sigma (of the day, by returns before it; null in the burn-in) and next_sigma (of the day after).

    The recursion s' = lam s + (1 - lam) r^2 from the mean square of the burn-in
    is folded in logarithmic steps of its closed form: a running sum of
    r^2 lam^-row. Blocks of rows, the shorter the smaller lam, keep lam^-row in range.
    """
    if not 0 < lam < 1:
        raise VaRError(f"lambda must be between 0 and 1, got {lam}")
    block = max(1, min(2000, int(600 / -math.log(lam))))
    rows = series.withColumn("row", F.row_number().over(over(by)) - 1)
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    seed = F.avg(F.when(F.col("row") < burn, F.col("r") * F.col("r"))).over(whole)
    rows = rows.withColumn("seed_", seed).withColumn("k_", F.floor(F.greatest(F.col("row") - burn, F.lit(0)) / block)).withColumn("i_", F.col("row") - burn - F.col("k_") * block)
    part = F.when(F.col("row") >= burn, (1 - lam) * F.col("r") * F.col("r") * F.pow(F.lit(lam), -F.col("i_").cast("double"))).otherwise(0.0)
    inside = Window.partitionBy(*by, "k_").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run_", F.sum(part).over(inside))
    # Variance at the end of each block, folded over the few blocks of a series.
    ends = rows.groupBy(*by, "k_").agg(F.max("i_").alias("last_"), F.max_by("run_", "row").alias("sum_"), F.max("seed_").alias("seed_"))
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("k_").rowsBetween(Window.unboundedPreceding, -1)
    steps = F.collect_list(F.struct("last_", "sum_")).over(order)
    fold = F.aggregate(steps, F.col("seed_"), lambda acc, e: F.pow(F.lit(lam), e["last_"].cast("double")) * (F.lit(lam) * acc + e["sum_"]))
    starts = ends.withColumn("start_", fold).select(*by, "k_", "start_")
    rows = rows.join(starts, [*by, "k_"])
    power = lambda x: F.pow(F.lit(lam), x.cast("double"))
    after = power(F.col("i_")) * (F.lit(lam) * F.col("start_") + F.col("run_"))
    rows = rows.withColumn("next_sigma", F.when(F.col("row") >= burn, F.sqrt(after)))
    before = F.coalesce(F.lag("next_sigma").over(over(by)), F.sqrt("seed_"))
    return rows.withColumn("sigma", F.when(F.col("row") >= burn, before)).drop("seed_", "k_", "i_", "run_", "start_")


def filtered_historical(series: DataFrame, confidence: float = 0.99, horizon: int = 1, lam: float = LAMBDA, burn: int = BURN, by: Sequence[str] = ()) -> DataFrame:
    """The quantile of returns in units of their own day's volatility, at tomorrow's volatility; null unless enough days follow the burn-in."""
    check(confidence, horizon)
    s = ewma_sigma(series, lam, burn, by)
    z = s.filter(F.col("row") >= burn).select(*by, F.try_divide("r", "sigma").alias("z"), "row", "next_sigma")
    last = z.groupBy(*by).agg(F.when(F.count("z") > needed(confidence), F.max_by("next_sigma", "row")).alias("next"))
    tail = _tail(z, by, "z", confidence)
    both = tail.join(last, list(by)) if by else tail.crossJoin(F.broadcast(last))  # one row
    scale = F.col("next") * math.sqrt(horizon)
    return _named(both.select(*by, (-F.col("q") * scale).alias("var"), (-F.col("tail") * scale).alias("es")), by, "filtered_historical", confidence, horizon)


def monte_carlo(spark: SparkSession, weights: np.ndarray, cov: np.ndarray, confidence: float = 0.99, horizon: int = 1, n_sims: int = 100_000, seed: int = 0, parts: int = 16) -> DataFrame:
    """Simulated zero-mean normal returns of a book; the draws of each part are seeded, so the result doesn't depend on the cluster."""
    check(confidence, horizon)
    if n_sims < 10 * needed(confidence):
        raise VaRError(f"{n_sims} draws can't resolve that tail")
    values, vectors = np.linalg.eigh((cov + cov.T) / 2 * horizon)
    root = (vectors * np.sqrt(np.maximum(values, 0))).T @ weights

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in pdf["id"]:
                n = (n_sims - int(part) + parts - 1) // parts
                yield pd.DataFrame({"r": np.random.default_rng([seed, int(part)]).standard_normal((n, len(root))) @ root})

    sims = spark.range(parts).mapInPandas(draw, "r double")
    return _named(_tail(sims, (), "r", confidence).select((-F.col("q")).alias("var"), (-F.col("tail")).alias("es")), (), "monte_carlo", confidence, horizon)


def rolling(series: DataFrame, method: str = "historical", confidence: float = 0.99, window: int = 750, lam: float = LAMBDA, by: Sequence[str] = ()) -> DataFrame:
    """date, var, realized, breach of each day with a full window before it; a day never takes part in its own estimate. A series of fewer than window + 2 days has none."""
    check(confidence)
    if method not in METHODS:
        raise VaRError(f"method must be one of {METHODS}, got {method!r}")
    past = over(by).rowsBetween(-window, -1)
    full = F.count("x").over(past) >= window
    if method == "filtered_historical":
        rows = ewma_sigma(series, lam, min(30, window // 4), by).withColumn("x", F.try_divide("r", "sigma"))
        var = -F.percentile("x", 1 - confidence).over(past) * F.col("sigma")
    elif method == "historical":
        rows, var = series.withColumn("x", F.col("r")), -F.percentile("x", 1 - confidence).over(past)
    else:
        rows = series.withColumn("x", F.col("r"))
        var = -(F.avg("x").over(past) + F.lit(ppf(1 - confidence)) * F.stddev_samp("x").over(past))
    long = F.count("*").over(Window.partitionBy(*(by or [F.lit(0)]))) >= window + 2
    out = rows.withColumn("full_", full & long).withColumn("var", var).filter("full_ and var is not null")
    return out.select(*by, "date", "var", F.col("r").alias("realized"), (F.col("r") < -F.col("var")).alias("breach"))
