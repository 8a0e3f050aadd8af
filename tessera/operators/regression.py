"""Cross-sectional factor model: one regression for each date, in parallel."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import RegressionError
from tessera.operators import covariance, exposures
from tessera.operators.materialize import materialized
from tessera.schemas import STYLES

#: Weekly decay, periods of a year, least residuals of a specific variance, share of periods that may be too thin.
LAMBDA, YEAR, LEAST_OBS, MAX_SKIP = 0.97, 52, 20, 0.2
FACTORS = ("market", *STYLES)
FIT = "as_of date, kind string, name string, value double"


def fit_one(x: np.ndarray, r: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients with the market first, residuals, unweighted R squared) of a weighted least-squares fit of least norm."""
    n, k = x.shape
    if n < k + 3:
        raise RegressionError(f"{n} symbols can't carry {k + 1} factors")
    full = np.column_stack([np.ones(n), x])
    root = np.ones(n) if w is None else np.sqrt(w)
    coef = np.linalg.lstsq(full * root[:, None], r * root, rcond=None)[0]
    rest = r - full @ coef
    spread = float(((r - r.mean()) ** 2).sum())
    return coef, rest, 0.0 if spread == 0 else 1 - float((rest**2).sum()) / spread


@dataclass(frozen=True)
class FactorModel:
    """Frames by period and factor, in units of the period."""

    factor_returns: DataFrame  # as_of, factor, value
    factor_cov: DataFrame  # sym_i, sym_j, cov
    residuals: DataFrame  # as_of, symbol, value
    specific: DataFrame  # symbol, specific
    fits: DataFrame  # as_of, r2, n_obs
    periods: int = YEAR


#: Trading days that a panel spans at least.
LEAST_DAYS = 10


def panel(prices: DataFrame, facts: DataFrame, sectors: DataFrame | None = None, check: bool = False, start: str | None = None, end: str | None = None, **bars: int) -> DataFrame:
    """(as_of, symbol, STYLES, r): exposures at each week end from start to end and the return from it to the next one.

    Bars before the start count for what looks back. With check, too few days or
    no rows are errors.
    """
    prices = prices if end is None else prices.filter(F.col("date") <= F.lit(end).cast("date"))
    span = prices if start is None else prices.filter(F.col("date") >= F.lit(start).cast("date"))
    if check and (n := span.filter("close is not null").select("date").distinct().limit(LEAST_DAYS).count()) < LEAST_DAYS:
        raise RegressionError(f"{n} trading days make no panel")
    days = exposures.week_ends(span)
    ordered = days.withColumn("next", F.lead("as_of").over(Window.partitionBy(F.lit(0)).orderBy("as_of"))).filter("next is not null")  # a row a week
    px = prices.select("symbol", "date", F.coalesce("adj_close", "close").alias("px")).filter("px is not null")
    a = px.select("symbol", F.col("date").alias("as_of"), F.col("px").alias("p0"))
    b = px.select("symbol", F.col("date").alias("next"), F.col("px").alias("p1"))
    moves = a.join(ordered, "as_of").join(b, ["symbol", "next"]).select("as_of", "symbol", (F.try_divide("p1", "p0") - 1).alias("r"))
    styles = exposures.clean(exposures.raw_characteristics(prices, facts, days, **bars), sectors)
    out = styles.join(moves, ["as_of", "symbol"])
    if check and out.isEmpty():
        raise RegressionError("the panel is empty")
    return out


def fit(rows: DataFrame, lam: float = LAMBDA, periods: int = YEAR, least_obs: int = LEAST_OBS, max_skip: float = MAX_SKIP, styles: tuple[str, ...] = STYLES, check: bool = False) -> FactorModel:
    """The model of a panel (as_of, symbol, styles, r and maybe w). Rows with a hole are left out, periods too thin are skipped.

    With check, more than max_skip of skipped periods is an error.
    """
    has_w = "w" in rows.columns
    used = rows.select("as_of", "symbol", *styles, "r", *(["w"] if has_w else [])).na.drop()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("symbol")
        at = pdf["as_of"].iloc[0]
        try:
            coef, rest, r2 = fit_one(pdf[list(styles)].to_numpy(), pdf["r"].to_numpy(), pdf["w"].to_numpy() if has_w else None)
        except RegressionError:
            return pd.DataFrame([(at, "skipped", None, float(len(pdf)))], columns=["as_of", "kind", "name", "value"])
        out = [(at, "factor", n, float(c)) for n, c in zip(("market", *styles), coef, strict=True)]
        out += [(at, "residual", s, float(e)) for s, e in zip(pdf["symbol"], rest, strict=True)]
        return pd.DataFrame([*out, (at, "r2", None, r2), (at, "n_obs", None, float(len(pdf)))], columns=["as_of", "kind", "name", "value"])

    fitted = materialized(used.groupBy("as_of").applyInPandas(solve, FIT))
    if check:
        n = {r["kind"]: r["n"] for r in fitted.filter("kind in ('skipped', 'r2')").groupBy("kind").agg(F.count("*").alias("n")).collect()}
        holes = rows.select("as_of").distinct().join(used.select("as_of").distinct(), "as_of", "left_anti").count()
        bad, good = n.get("skipped", 0) + holes, n.get("r2", 0)
        if not good or bad / (bad + good) > max_skip:
            raise RegressionError(f"{bad} of {bad + good} periods are too thin to fit")
    factors = fitted.filter("kind = 'factor'").select("as_of", F.col("name").alias("factor"), "value")
    residuals = fitted.filter("kind = 'residual'").select("as_of", F.col("name").alias("symbol"), "value")
    cov = covariance.ewma(factors.select(F.col("as_of").alias("date"), F.col("factor").alias("symbol"), F.col("value").alias("r")), lam)
    specific = residuals.groupBy("symbol").agg(F.when(F.count("*") >= least_obs, F.var_samp("value")).alias("specific"))
    fits = fitted.filter("kind in ('r2', 'n_obs')").groupBy("as_of").pivot("kind", ["r2", "n_obs"]).agg(F.first("value"))
    return FactorModel(factors, cov, residuals, specific, fits, periods)
