"""Where a book's risk comes from: factors, single names, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import DecompositionError
from tessera.operators.materialize import materialized
from tessera.operators.views import full
from tessera.schemas import STYLES


def _long(exposures: DataFrame, styles: tuple[str, ...]) -> DataFrame:
    """symbol, factor, b: with 1 for the market."""
    each = F.explode(F.array(F.struct(F.lit("market").alias("factor"), F.lit(1.0).alias("b")), *[F.struct(F.lit(s).alias("factor"), F.col(s).alias("b")) for s in styles]))
    return exposures.select("symbol", each.alias("e")).select("symbol", "e.*")


def check(weights: DataFrame, exposures: DataFrame, specific: DataFrame, styles: tuple[str, ...] = STYLES) -> None:
    """There must be positions, and every one needs all exposures and a specific variance."""
    if weights.isEmpty():
        raise DecompositionError("no positions")
    holes = exposures.filter(" or ".join(f"{s} is null" for s in styles)).select("symbol")
    for what, missing in (
        ("exposures", weights.join(exposures, "symbol", "left_anti")),
        ("whole exposures", weights.join(holes, "symbol", "left_semi")),
        ("specific variance", weights.join(specific.filter("specific is not null"), "symbol", "left_anti")),
    ):
        if names := sorted(r["symbol"] for r in missing.select("symbol").collect()):
            raise DecompositionError(f"no {what} for {names}")


def decompose(weights: DataFrame, exposures: DataFrame, factor_cov: DataFrame, specific: DataFrame, periods: int = 52, styles: tuple[str, ...] = STYLES, check_first: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals: one row, factors, positions) of w'(BFB' + D)w, annualised. The symbols' own covariance is never formed.

    What the three results share, one row a position and factor, is computed once.
    With check_first, positions that lack something are an error; without, they
    are left out.
    """
    if check_first:
        check(weights, exposures, specific, styles)
    b = materialized(_long(exposures, styles).join(weights, "symbol"))
    x = b.groupBy("factor").agg(F.sum(F.col("weight") * F.col("b")).alias("x"))
    fx = full(factor_cov).join(x.select(F.col("factor").alias("sym_j"), "x"), "sym_j").groupBy(F.col("sym_i").alias("factor")).agg(F.sum(F.col("cov") * F.col("x")).alias("fx"))
    parts = materialized(x.join(fx, "factor").withColumn("part", F.col("x") * F.col("fx")))
    own = materialized(weights.join(specific, "symbol").withColumn("own", F.col("weight") * F.col("specific")))
    marginal = b.join(parts, "factor").groupBy("symbol").agg(F.sum(F.col("b") * F.col("fx")).alias("common"))
    held = own.join(marginal, "symbol").withColumn("part", F.col("weight") * (F.col("common") + F.col("own")))
    sums = parts.agg(F.sum("part").alias("factor_var")).crossJoin(own.agg(F.sum(F.col("weight") * F.col("own")).alias("specific_var")))  # one row each
    sums = sums.withColumn("total", F.col("factor_var") + F.col("specific_var"))
    share = lambda c: F.try_divide(F.col(c), F.col("total"))
    positions = held.crossJoin(F.broadcast(sums)).select("symbol", "weight", (F.col("part") * periods).alias("variance"), share("part").alias("share"))
    bets = positions.agg(F.when(F.min("share") >= 0, F.try_divide(F.lit(1.0), F.sum(F.col("share") * F.col("share")))).alias("effective_bets"), F.count("*").alias("n_positions"))
    year = lambda c: F.sqrt(F.col(c) * periods)
    totals = sums.crossJoin(bets).select(
        year("total").alias("total_vol"), year("factor_var").alias("factor_vol"), year("specific_var").alias("specific_vol"),
        share("factor_var").alias("factor_share"), share("specific_var").alias("specific_share"), "effective_bets", "n_positions",
    )
    factors = parts.crossJoin(F.broadcast(sums)).select("factor", F.col("x").alias("exposure"), (F.col("part") * periods).alias("variance"), (F.signum("part") * F.sqrt(F.abs("part") * periods)).alias("vol"), share("part").alias("share"))
    return totals, factors, positions.orderBy(F.desc("share"))
