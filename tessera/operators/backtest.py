"""Walk-forward backtests. A strategy's targets depend on the trailing window alone, so all windows of all
strategies are solved at once; between rebalances a book is bought and held, so its path is a running product."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import BacktestError, RiskError
from tessera.operators import stats
from tessera.operators.materialize import materialized

WeightsFn = Callable[[pd.DataFrame], pd.Series]
TARGETS = "strategy string, k int, symbol string, weight double, note double, error string"


def calendar(returns: DataFrame, window: int, step: int) -> DataFrame:
    """Returns with row (of the date, from 0) and k, the rebalance that the row belongs to (from 0 at row `window`; null before)."""
    if window < 2 or step < 1:
        raise BacktestError(f"a window of {window} and a step of {step} make no backtest")
    row = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1  # one row a date
    days = returns.select("date").distinct().withColumn("row", row)
    k = F.when(F.col("row") >= window, F.floor((F.col("row") - window) / step)).cast("int")
    return materialized(returns.join(days.withColumn("k", k), "date"))


def check(returns: DataFrame, window: int) -> None:
    g = returns.agg(F.countDistinct("date").alias("n"), F.count_if(F.col("r").isNull() | F.isnan("r") | (F.abs("r") == float("inf"))).alias("bad")).first()
    if g["bad"] or g["n"] < window + 1:
        raise BacktestError(f"{window + 1} dates of finite returns are needed, got {g['n']} with {g['bad']} bad values")


def equal_targets(rows: DataFrame, strategy: str = "equal_weight") -> DataFrame:
    """1/N at every rebalance."""
    n = rows.filter("k is not null").groupBy("k").agg(F.countDistinct("symbol").alias("n"))
    held = rows.filter("k is not null").select("k", "symbol").distinct().join(n, "k")
    return held.select(F.lit(strategy).alias("strategy"), "k", "symbol", (1.0 / F.col("n")).alias("weight"), F.lit(None).cast("double").alias("note"), F.lit(None).cast("string").alias("error"))


def validated(w: pd.Series, symbols: list[str], name: str) -> pd.Series:
    if not isinstance(w, pd.Series) or set(w.index) != set(symbols):
        raise BacktestError(f"{name}: weights must be a Series over all symbols")
    if not np.isfinite(w.to_numpy(dtype=float)).all() or abs(float(w.sum()) - 1) > 1e-6:
        raise BacktestError(f"{name}: weights must be finite and add up to 1, not {float(w.sum()):.6f}")
    return w


def solved_targets(rows: DataFrame, strategies: Mapping[str, WeightsFn], window: int, step: int, note: Callable[[str, pd.DataFrame], float] | None = None) -> DataFrame:
    """TARGETS of every strategy and rebalance, each from the window of rows before it; a failure is a row with its error.

    A row of returns goes to the windows that hold it, which are known from its
    number: at most window / step + 1 of them. A window is sent once and solved
    by all strategies.
    """
    last = rows.agg(F.max("k").alias("last"))
    lo, hi = F.greatest(F.floor((F.col("row") - window) / step) + 1, F.lit(0)), F.least(F.floor(F.col("row") / step), F.col("last"))
    # Row r is in the window of rebalance k, [k step, k step + window), for these k.
    spread = rows.crossJoin(F.broadcast(last)).withColumn("at", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>"))))  # last: one row
    windows = spread.select(F.col("at").cast("int").alias("k"), "row", "symbol", "r")

    def solve_all(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="row", columns="symbol", values="r").sort_index().sort_index(axis=1)
        found = [row for strategy in strategies for row in solve(strategy, int(pdf["k"].iloc[0]), x)]
        return pd.DataFrame(found, columns=[c.split()[0] for c in TARGETS.split(", ")])

    def solve(strategy: str, k: int, x: pd.DataFrame) -> list[tuple]:
        try:
            w = validated(strategies[strategy](x), list(x.columns), strategy)
            extra = note(strategy, x) if note else None
        except (RiskError, np.linalg.LinAlgError) as e:
            return [(strategy, k, None, None, None, str(e))]
        return [(strategy, k, symbol, float(v), extra, None) for symbol, v in w.items()]

    return windows.groupBy("k").applyInPandas(solve_all, TARGETS)


def walk(rows: DataFrame, targets: DataFrame, cost_bps: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(days: strategy, date, row, k, gross, net; trades: strategy, k, traded). Strategies with an error row are left out.

    Within a segment value is the sum of targets times running products of
    1 + r; the weights it drifts to are what the next rebalance trades from.
    """
    targets = materialized(targets)
    failed = targets.filter("error is not null").select("strategy").distinct()
    held = targets.join(failed, "strategy", "left_anti").select("strategy", "k", "symbol", "weight")
    grow = Window.partitionBy("symbol", "k").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    paths = rows.filter("k is not null").withColumn("growth", F.product(1 + F.col("r")).over(grow))
    worth = materialized(paths.join(held, ["k", "symbol"]).select("strategy", "k", "symbol", "date", "row", (F.col("weight") * F.col("growth")).alias("worth")))
    total = worth.groupBy("strategy", "k", "date", "row").agg(F.sum("worth").alias("value"))
    inside = Window.partitionBy("strategy", "k").orderBy("row")
    gross = total.withColumn("gross", F.try_divide(F.col("value"), F.coalesce(F.lag("value").over(inside), F.lit(1.0))) - 1)
    end = worth.groupBy("strategy", "k", "symbol").agg(F.max_by("worth", "row").alias("worth"))
    whole = Window.partitionBy("strategy", "k")
    drifted = end.select("strategy", (F.col("k") + 1).alias("k"), "symbol", F.try_divide(F.col("worth"), F.sum("worth").over(whole)).alias("had"))
    both = held.join(drifted, ["strategy", "k", "symbol"], "full").join(held.select("strategy", "k").distinct(), ["strategy", "k"], "left_semi")
    trades = both.groupBy("strategy", "k").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("had", F.lit(0.0)))).alias("traded"))
    first = F.row_number().over(inside) == 1
    days = gross.withColumn("first", first).join(trades, ["strategy", "k"])
    net = F.col("gross") - F.when(F.col("first"), F.col("traded") * cost_bps / 10_000).otherwise(0.0)
    return days.select("strategy", "date", "row", "k", "gross", net.alias("net")), trades


def results(days: DataFrame, trades: DataFrame) -> DataFrame:
    """A row for each strategy: ann_return, vol, sharpe, max_drawdown (all net), avg_turnover, cost_drag, n_rebalances, wiped_out."""
    by = ["strategy"]
    net = stats.summary(days.select("strategy", "date", F.col("net").alias("r")), by)
    gross = days.groupBy(*by).agg(stats.cagr("gross").alias("gross_cagr"), F.max(F.col("gross") <= -1).alias("wiped_out"))
    turn = trades.groupBy(*by).agg(F.avg(F.col("traded") / 2).alias("avg_turnover"), F.count("*").alias("n_rebalances"))
    out = net.join(gross, by).join(turn, by)
    return out.select("strategy", "n", F.col("cagr").alias("ann_return"), "vol", "sharpe", "max_drawdown", "avg_turnover", (F.col("gross_cagr") - F.col("cagr")).alias("cost_drag"), "n_rebalances", "wiped_out")


def failures(targets: DataFrame, outcome: DataFrame) -> DataFrame:
    """strategy, error of those that couldn't be walked: the first error of their targets, or a day that lost everything."""
    failed = targets.filter("error is not null").groupBy("strategy").agg(F.min_by("error", "k").alias("error"))
    return failed.unionByName(outcome.filter("wiped_out").select("strategy", F.lit("wiped out: a day lost everything").alias("error")))


def run(returns: DataFrame, strategies: Mapping[str, WeightsFn], window: int = 252, step: int = 21, cost_bps: float = 2.0, check_first: bool = True) -> tuple[DataFrame, DataFrame]:
    """(results, days) of a backtest of each strategy; with check_first, bad input and wiped-out books are errors."""
    if check_first:
        check(returns, window)
    rows = calendar(returns, window, step)
    days, trades = walk(rows, solved_targets(rows, strategies, window, step), cost_bps)
    out = results(days, trades)
    if check_first and (gone := [r["strategy"] for r in out.filter("wiped_out").collect()]):
        raise BacktestError(f"{gone}: a day lost everything")
    return out, days
