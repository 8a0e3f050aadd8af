"""Tests that could reject a VaR model: number of breaches, their independence, both, and regulatory zones."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.special import binom_cdf, chi2_sf, xlogy
from tessera.operators.materialize import materialized
from tessera.operators.stats import over

ALPHA = 0.05


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, 0.0).otherwise(x * F.ln(y))


def transitions(rolled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, breaches and the counts of consecutive days n00, n01, n10, n11."""
    hit = rolled.withColumn("b", F.col("breach").cast("int")).withColumn("a", F.lag("b").over(over(by)))
    pair = lambda a, b: F.count_if((F.col("a") == a) & (F.col("b") == b)).alias(f"n{a}{b}")
    return hit.groupBy(*by).agg(F.count("*").alias("n"), F.sum("b").alias("breaches"), *[pair(a, b) for a in (0, 1) for b in (0, 1)])


def kupiec_lr(counts: DataFrame, confidence: float = 0.99) -> Column:
    """Likelihood ratio of the claimed breach probability against the observed one."""
    n, x, p = F.col("n").cast("double"), F.col("breaches").cast("double"), 1 - confidence
    seen = x / n
    return -2 * ((_xlogy(n - x, F.lit(1 - p)) + _xlogy(x, F.lit(p))) - (_xlogy(n - x, 1 - seen) + _xlogy(x, seen)))


def independence_lr() -> Column:
    """Likelihood ratio of one breach probability against one after calm and one after breach days; null for fewer than three days or two breaches."""
    a, b, c, d = (F.col(k).cast("double") for k in ("n00", "n01", "n10", "n11"))
    pi = (b + d) / (a + b + c + d)
    calm, hit = F.coalesce(F.try_divide(b, a + b), F.lit(0.0)), F.coalesce(F.try_divide(d, c + d), F.lit(0.0))
    one = _xlogy(b + d, pi) + _xlogy(a + c, 1 - pi)
    two = _xlogy(a, 1 - calm) + _xlogy(b, calm) + _xlogy(c, 1 - hit) + _xlogy(d, hit)
    return F.when((F.col("n") >= 3) & (F.col("breaches") >= 2), -2 * (one - two))


def likelihood_ratios(rolled: DataFrame, confidence: float = 0.99, by: Sequence[str] = ()) -> DataFrame:
    """Transition counts with lr_pof, lr_ind and p_cc, the p-value of both together (chi-square, 2 degrees)."""
    counts = transitions(rolled, by)
    out = counts.withColumn("lr_pof", kupiec_lr(counts, confidence)).withColumn("lr_ind", independence_lr())
    return out.withColumn("p_cc", F.exp(-(F.col("lr_pof") + F.col("lr_ind")) / 2))


def kupiec_pof(breaches: int, n: int, confidence: float) -> float:
    """p-value of the number of breaches."""
    if n <= 0 or not 0 <= breaches <= n or not 0.5 < confidence < 1:
        raise ValueError(f"can't test {breaches} of {n} at {confidence}")
    p, seen = 1 - confidence, breaches / n
    h0, h1 = (xlogy(n - breaches, 1 - q) + xlogy(breaches, q) for q in (p, seen))
    return chi2_sf(-2 * (h0 - h1), 1)


def traffic_light(breaches: int, n: int, confidence: float) -> str:
    """The zone of the number of breaches; the thresholds are fixed values."""
    if n <= 0:
        raise ValueError("no observations")
    p = binom_cdf(breaches, n, 1 - confidence)
    return "green" if p < 0.95 else "yellow" if p < 0.9999 else "red"


def worst_breach(rolled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The breach whose loss was the largest multiple of its VaR."""
    ratio = F.try_divide(-F.col("realized"), F.col("var"))
    hits = rolled.filter("breach").withColumn("w", F.struct(ratio.alias("worst_ratio"), F.col("date").alias("worst_date"), (-F.col("realized")).alias("worst_loss"), F.col("var").alias("worst_var")))
    return hits.groupBy(*by).agg(F.max("w").alias("w")).select(*by, "w.*")


def validate(rolled: DataFrame, confidence: float = 0.99, by: Sequence[str] = ()) -> DataFrame:
    """One row for each series: counts, p-values, zone, expected breaches and the worst breach. The series is computed once."""
    rolled = materialized(rolled)
    tests = likelihood_ratios(rolled, confidence, by).filter("n > 0")

    @F.pandas_udf("p_pof double, p_ind double, zone string")
    def verdict(n: pd.Series, x: pd.Series, ind: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "p_pof": [kupiec_pof(int(b), int(a), confidence) for a, b in zip(n, x, strict=True)],
                "p_ind": [None if v is None or v != v else chi2_sf(float(v), 1) for v in ind],
                "zone": [traffic_light(int(b), int(a), confidence) for a, b in zip(n, x, strict=True)],
            }
        )

    out = tests.withColumn("v", verdict("n", "breaches", "lr_ind")).select("*", "v.*").drop("v").withColumn("expected", F.col("n") * (1 - confidence))
    worst = worst_breach(rolled, by)
    return out.join(worst, list(by), "left") if by else out.join(F.broadcast(worst), F.lit(True), "left")  # worst: one row
