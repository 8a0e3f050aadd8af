"""Expected returns from market weights and views on them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import OptimizationError


@dataclass(frozen=True)
class View:
    """A combination of assets, the return expected of it, and how sure that is (0 to 1)."""

    assets: tuple[tuple[str, float], ...]
    value: float
    confidence: float

    def __post_init__(self) -> None:
        if not self.assets or not 0 < self.confidence <= 1 or not np.isfinite(self.value):
            raise OptimizationError(f"not a view: {self}")


def absolute_view(symbol: str, value: float, confidence: float) -> View:
    return View(((symbol, 1.0),), value, confidence)


def relative_view(better: str, worse: str, value: float, confidence: float) -> View:
    return View(((better, 1.0), (worse, -1.0)), value, confidence)


def full(cov: DataFrame) -> DataFrame:
    """Both halves of a long covariance."""
    return cov.unionByName(cov.filter("sym_i < sym_j").select(F.col("sym_j").alias("sym_i"), F.col("sym_i").alias("sym_j"), "cov"))


def implied_returns(cov: DataFrame, market: DataFrame, risk_aversion: float = 2.5) -> DataFrame:
    """symbol, implied: the returns that make the (normalised) market weights optimal."""
    w = market.select(F.col("symbol").alias("sym_j"), (F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0)))).alias("w"))
    return full(cov).join(w, "sym_j").groupBy(F.col("sym_i").alias("symbol")).agg((risk_aversion * F.sum(F.col("cov") * F.col("w"))).alias("implied"))


def views_from_scores(scores: DataFrame, cov: DataFrame, market: DataFrame, ic: float = 0.05, confidence: float = 0.3, risk_aversion: float = 2.5) -> DataFrame:
    """symbol, value, confidence: the implied return and ic * volatility * z-score of each scored symbol."""
    if not 0 < ic <= 1:
        raise OptimizationError(f"ic must be above 0 and at most 1, got {ic}")
    whole = Window.partitionBy(F.lit(0))
    z = F.try_divide(F.col("score") - F.avg("score").over(whole), F.stddev_pop("score").over(whole))
    vol = cov.filter("sym_i = sym_j").select(F.col("sym_i").alias("symbol"), F.sqrt("cov").alias("vol"))
    rows = scores.withColumn("z", z).join(vol, "symbol").join(implied_returns(cov, market, risk_aversion), "symbol")
    return rows.select("symbol", (F.col("implied") + ic * F.col("vol") * F.col("z")).alias("value"), F.lit(confidence).alias("confidence"))


def black_litterman(cov: pd.DataFrame, market: pd.Series, views: Sequence[View] = (), risk_aversion: float = 2.5, tau: float = 0.05) -> pd.Series:
    """Posterior expected returns. A view's variance is (1 / confidence - 1) times that of its combination under the prior."""
    names, sigma = list(cov.columns), cov.to_numpy(dtype=float)
    w = market.reindex(names).to_numpy(dtype=float)
    if not np.isfinite(w).all() or (w <= 0).any():
        raise OptimizationError("market weights must be positive for every symbol")
    prior = risk_aversion * sigma @ (w / w.sum())
    if not views:
        return pd.Series(prior, index=names)
    if odd := sorted({s for v in views for s, _ in v.assets} - set(names)):
        raise OptimizationError(f"views on {odd}, which the covariance lacks")
    p = np.array([[dict(v.assets).get(s, 0.0) for s in names] for v in views])
    q = np.array([v.value for v in views])
    spread = p @ (tau * sigma) @ p.T
    noise = np.diag((1 / np.array([v.confidence for v in views]) - 1) * np.diag(spread))
    return pd.Series(prior + tau * sigma @ p.T @ np.linalg.lstsq(spread + noise, q - p @ prior, rcond=None)[0], index=names)


def posterior(cov: DataFrame, market: DataFrame, views: DataFrame, risk_aversion: float = 2.5, tau: float = 0.05) -> DataFrame:
    """symbol, prior, posterior for absolute views (symbol, value, confidence), solved in one group."""
    rows = full(cov).select(F.col("sym_i").alias("a"), F.col("sym_j").alias("b"), F.col("cov").alias("v"), F.lit(None).cast("double").alias("c"))
    rows = rows.unionByName(market.select(F.lit("w").alias("a"), F.col("symbol").alias("b"), F.col("weight").alias("v"), F.lit(None).cast("double").alias("c")).withColumn("kind", F.lit("w")), allowMissingColumns=True)
    rows = rows.unionByName(views.select(F.lit("view").alias("a"), F.col("symbol").alias("b"), F.col("value").alias("v"), F.col("confidence").alias("c")).withColumn("kind", F.lit("v")), allowMissingColumns=True)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf[pdf["kind"].isna()].pivot(index="a", columns="b", values="v").sort_index().sort_index(axis=1)
        w = pdf[pdf["kind"] == "w"].set_index("b")["v"]
        seen = [absolute_view(s, float(v), float(c)) for s, v, c in pdf.loc[pdf["kind"] == "v", ["b", "v", "c"]].itertuples(index=False)]
        prior, post = black_litterman(m, w, (), risk_aversion, tau), black_litterman(m, w, seen, risk_aversion, tau)
        return pd.DataFrame({"symbol": m.columns, "prior": prior.to_numpy(), "posterior": post.to_numpy()})

    return rows.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(solve, "symbol string, prior double, posterior double")
