"""Commands over a price store: python -m tessera.cli COMMAND ... Expected failures print a line and exit with 1."""

from __future__ import annotations

import argparse
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import reports
from tessera.config import Settings
from tessera.errors import CovarianceError, PriceDataError, RiskError, VaRError
from tessera.operators import backtest, covariance, coverage, crosscheck, decompose, optimize, rebalance, regression, returns, stats, stress, var, views
from tessera.schemas import FACTOR_DAYS, STYLES
from tessera.operators.materialize import materialized
from tessera.sources import filings, scores, spec
from tessera.sources.store import PriceStore, csv_frames

VERSION = "0.1.0"


def _book(prices: DataFrame, path: str) -> tuple[spec.Portfolio, DataFrame]:
    book = spec.load(path)
    names = [p.symbol for p in book.positions]
    return book, spec.resolve_weights(book.frame(prices.sparkSession), returns.latest_prices(prices, names, check=True), book.cash)


def _series(prices: DataFrame, path: str) -> DataFrame:
    book, weights = _book(prices, path)
    return stats.blended(returns.load_returns(prices, [p.symbol for p in book.positions], check=True), weights)


def value_at_risk(prices: DataFrame, path: str, confidence: float, horizon: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """method, confidence, horizon, var, es, money and reason: a method that can't answer has a reason alone. Simulation takes its scale from the trailing year."""
    spark, (book, weights) = prices.sparkSession, _book(prices, path)
    nav = (weights.first() or {"nav": None})["nav"]
    r = materialized(returns.load_returns(prices, [p.symbol for p in book.positions], start, end, check=True))
    s = materialized(stats.blended(r, weights))
    short = f"more than {var.BURN + var.needed(confidence)} returns are needed" if 0.5 < confidence < 1 else ""

    def simulated() -> DataFrame:
        days = r.select("date").distinct().orderBy(F.desc("date")).limit(stats.YEAR)
        cov = views.full(covariance.ledoit_wolf(r.join(days, "date", "left_semi"))).toPandas()  # of one book
        m = cov.pivot(index="sym_i", columns="sym_j", values="cov").sort_index().sort_index(axis=1)
        held = {w["symbol"]: w["weight"] for w in weights.collect()}
        return var.monte_carlo(spark, np.array([held[x] for x in m.columns]), m.to_numpy(), confidence, horizon)

    def enough(f) -> DataFrame:
        var.check(confidence, horizon, s)
        return f(s, confidence, horizon)

    rows: list[tuple] = []
    methods = {"parametric": var.parametric, "cornish_fisher": var.cornish_fisher_var, "historical": var.historical, "filtered_historical": var.filtered_historical}
    for name, compute in [*((n, lambda f=f: enough(f)) for n, f in methods.items()), ("monte_carlo", simulated)]:
        try:
            found = compute().first()
            ok = found is not None and found["var"] is not None
            rows.append((name, confidence, horizon, found["var"], found["es"], found["var"] * nav if nav else None, None) if ok else (name, None, None, None, None, None, short))
        except (VaRError, CovarianceError) as e:
            rows.append((name, None, None, None, None, None, str(e)))
    return spark.createDataFrame(rows, "method string, confidence double, horizon int, var double, es double, money double, reason string")


def _panel(spark: SparkSession, prices: DataFrame, a) -> DataFrame:
    return materialized(regression.panel(prices, spark.read.parquet(a.fundamentals), check=True, start=a.start, end=a.end))


def run(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    if a.command == "version":
        return [VERSION]
    store = PriceStore(spark, a.store)
    if a.command == "ingest":
        n = store.ingest(a.symbols, csv_frames(spark, a.source), a.start)
        return [f"{s}: {k} bars" for s, k in n.items()]
    if a.command == "filings":
        ciks = filings.cik_map(spark, a.ciks)
        return [f"{filings.store(spark, a.fundamentals, filings.read_facts(spark, a.source, ciks), ciks, a.symbols)} new filings"]
    if a.command == "import":
        return [f"{store.import_from(spark.read.parquet(a.source))} new bars"]
    prices = store.read()
    if prices.isEmpty():
        raise PriceDataError("the store is empty")
    if a.command == "stats":
        book, weights = _book(prices, a.portfolio)
        r = returns.load_returns(prices, [p.symbol for p in book.positions] + ([a.benchmark] if a.benchmark else []), check=True)
        bench = r.filter(F.col("symbol") == a.benchmark).select("date", "r") if a.benchmark else None
        return [reports.text(stats.compute_stats(r, weights, bench), book.name), reports.text(weights, "weights")]
    if a.command == "cov-compare":
        return [reports.text(optimize.estimator_race(returns.load_returns(prices, a.symbols, check=True), None, a.window, a.step, a.cost_bps), "estimators by realised volatility")]
    if a.command == "optimize-compare":
        rows, failed = optimize.race(returns.load_returns(prices, a.symbols, check=True), optimize.OPTIMIZERS, a.window, a.step, a.cost_bps)
        return [reports.text(rows, "optimisers by Sharpe ratio"), reports.text(failed, "failed")]
    if a.command == "optimize-views":
        wanted = scores.load(spark, a.scores)
        names = [r["symbol"] for r in wanted.collect()]  # a screen's list
        cov = covariance.annualized(covariance.ledoit_wolf(returns.load_returns(prices, names, check=True)))
        market = wanted.select("symbol", F.lit(1.0 / len(names)).alias("weight"))
        post = views.posterior(cov, market, views.views_from_scores(wanted, cov, market))
        mu = post.toPandas().set_index("symbol")["posterior"]
        target = optimize.weights_by(cov, lambda m: optimize.mean_variance(m, mu, a.risk_aversion))
        if a.out:
            with open(a.out, "w") as f:
                f.write(spec.dump_targets({r["symbol"]: r["weight"] for r in target.orderBy("symbol").collect()}))
        return [reports.text(reports.with_tilt(post.join(target, "symbol")), "targets")]
    if a.command == "var":
        return [reports.text(value_at_risk(prices, a.portfolio, a.confidence, a.horizon, a.start, a.end), "value at risk and expected shortfall")]
    if a.command == "validate-var":
        s = _series(prices, a.portfolio)
        var.check(a.confidence, 1, s, a.window + 2)
        out = []
        for m in var.METHODS:
            try:
                out.append(reports.text(coverage.validate(var.rolling(s, m, a.confidence, a.window), a.confidence), m))
            except VaRError as e:
                out.append(f"{m}: {e}")
        return out
    if a.command == "validate-factors":
        own = regression.fit(_panel(spark, prices, a), check=True).factor_returns
        return [reports.text(crosscheck.cross_check(own, spark.read.schema(FACTOR_DAYS).parquet(a.published)), "factors against published ones")]
    if a.command == "decompose":
        panel = _panel(spark, prices, a)
        model = regression.fit(panel, check=True)
        last = panel.agg(F.max("as_of")).first()[0]
        x, (_, weights) = panel.filter(F.col("as_of") == last).select("symbol", *STYLES), _book(prices, a.portfolio)
        total, factors, positions = decompose.decompose(weights, x, model.factor_cov, model.specific)
        return [reports.text(total, "risk"), reports.text(factors, "factors"), reports.text(reports.flagged(positions), "positions")]
    if a.command == "stress":
        _, weights = _book(prices, a.portfolio)
        if a.shock:
            x = _panel(spark, prices, a)
            x = x.filter(F.col("as_of") == x.agg(F.max("as_of")).first()[0])
            return [reports.text(stress.factor_shock(weights, x, {k: float(v) for k, _, v in (s.partition("=") for s in a.shock)}, STYLES), "shock")]
        known = {n: (s, e) for n, s, e, _ in stress.SCENARIOS}
        return [reports.text(stress.replay(weights, prices, *known[a.scenario], check=True), a.scenario)]
    book, now = _book(prices, a.portfolio)
    _, target = _book(prices, a.target)
    plan = rebalance.plan(now, target, now.first()["nav"] if book.positions else book.cash, a.band, a.cost_bps, a.min_trade)
    return [reports.text(rebalance.totals(plan, now), "rebalance"), reports.text(plan, "trades and skips")]


def parser() -> argparse.ArgumentParser:
    s, p = Settings.load(), argparse.ArgumentParser(prog="tessera")
    p.add_argument("--store", default=s.store)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: tuple) -> None:
        c = sub.add_parser(name)
        for flag, kw in flags:
            c.add_argument(flag, **kw)

    walk = [("--window", {"type": int, "default": s.window}), ("--step", {"type": int, "default": s.step}), ("--cost-bps", {"type": float, "default": s.cost_bps})]
    book, sure = ("portfolio", {}), ("--confidence", {"type": float, "default": s.confidence})
    facts, many = ("--fundamentals", {"default": "warehouse/fundamentals"}), ("symbols", {"nargs": "+"})
    command("version")
    command("ingest", many, ("--source", {"required": True}), ("--start", {}))
    command("filings", many, ("--source", {"required": True}), ("--ciks", {"required": True}), facts)
    command("import", ("source", {}))
    command("stats", book, ("--benchmark", {}))
    command("cov-compare", many, *walk)
    command("optimize-compare", many, *walk)
    command("optimize-views", ("scores", {}), ("--risk-aversion", {"type": float, "default": 2.5}), ("--out", {}))
    command("var", book, sure, ("--horizon", {"type": int, "default": 1}), ("--start", {}), ("--end", {}))
    command("validate-var", book, sure, ("--window", {"type": int, "default": 750}))
    span = [("--start", {}), ("--end", {})]
    command("validate-factors", facts, ("--published", {"required": True}), *span)
    command("decompose", book, facts, *span)
    command("stress", book, facts, *span, ("--scenario", {"default": "covid2020", "choices": [x[0] for x in stress.SCENARIOS]}), ("--shock", {"nargs": "*"}))
    command("rebalance", book, ("target", {}), ("--band", {"type": float, "default": 0.05}), ("--cost-bps", {"type": float, "default": s.cost_bps}), ("--min-trade", {"type": float, "default": 0.0}))
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print("\n\n".join(run(SparkSession.builder.appName("tessera").getOrCreate(), args)))
    except (RiskError, FileNotFoundError, backtest.BacktestError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
