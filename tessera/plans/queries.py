"""Queries of every operator over the market derived from the trade tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import backtest, covariance, coverage, crosscheck, decompose, exposures, optimize, rebalance, regression, returns, stats, stress, var, views
from tessera.operators.materialize import materialized, shared_folder
from tessera.schemas import STYLES
from tessera.sources import factorlib, filings, market, spec, store
from tessera.sources import scores as score_files

#: Weekly series are about 350 bars long: their windows.
WINDOW, STEP, COST = 104, 13, 2.0
BARS = {"skip": 4, "long": 52, "vol": 52, "least": 20}
CONFIDENCE, ROLL = 0.99, 750
AS_OF, CRISIS = "2000-06-30", ("1998-03-02", "1998-09-28")
NAV = 1_000_000.0
#: Days that prices are moved by to span the scenario of 2008: 11 years, whole weeks.
SHIFT = 4018
Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}


def query(f: Query) -> Query:
    _all[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_all)


def rounded(df: DataFrame, places: int = 8) -> DataFrame:
    """Doubles rounded, minus zero as zero: what two engines' summing orders leave equal."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def weekly(spark: SparkSession, sf_dir: str, symbol: str = "p_type") -> DataFrame:
    return market.prices(spark, sf_dir, symbol, "week")


def equal(rows: DataFrame) -> DataFrame:
    """symbol, weight: 1/N over the symbols of rows."""
    names = rows.select("symbol").distinct()
    return names.crossJoin(F.broadcast(names.agg((1.0 / F.count("*")).alias("weight"))))  # one row


def graded(rows: DataFrame) -> DataFrame:
    """symbol, weight in proportion to the symbol's place in alphabetical order."""
    whole = Window.partitionBy(F.lit(0))
    names = rows.select("symbol").distinct().withColumn("i", F.row_number().over(whole.orderBy("symbol")))
    return names.select("symbol", (F.col("i") / F.sum("i").over(whole)).alias("weight"))


def week_returns(spark: SparkSession, sf_dir: str, symbol: str = "p_type") -> DataFrame:
    return returns.load_returns(weekly(spark, sf_dir, symbol))


def day_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = returns.load_returns(market.prices(spark, sf_dir, "p_type", "day"))
    return stats.blended(r, equal(r))


def week_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = week_returns(spark, sf_dir)
    return stats.blended(r, graded(r))


@query
def portfolio_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = week_returns(spark, sf_dir)
    return rounded(stats.compute_stats(r, graded(r), stats.blended(r, equal(r))))


@query
def latest_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(returns.latest_prices(weekly(spark, sf_dir, "p_brand"), as_of=AS_OF), 4)


@query
def list_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.list_symbols(weekly(spark, sf_dir, "p_brand"))


@query
def prices_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(returns.load_prices(weekly(spark, sf_dir, "p_brand"), start="1996-01-01", end=AS_OF), 4)


@query
def prices_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vendor frame with two deliveries a day, of which the later stays."""
    lines = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = lines.select(F.col("ts").alias("Date"), F.col("value").alias("Close"), (F.col("value") * 1.01).alias("High"), "event_id")
    return rounded(store.normalize(raw, "EVT", "event_id").select("symbol", "date", "open", "high", "close", "adj_close"), 6)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    px = weekly(spark, sf_dir, "p_brand")
    changed = px.withColumns({c: F.col(c) * 1.1 for c in ("open", "high", "low", "close", "adj_close")})
    return px.filter("date < '1999-01-01'"), changed.filter("date >= '1998-01-01'")


@query
def prices_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(store.upserted(*_halves(spark, sf_dir)).select("symbol", "date", "close", "adj_close"), 4)


@query
def prices_import_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(store.imported(*_halves(spark, sf_dir)).select("symbol", "date", "close", "adj_close"), 4)


#: Names as somebody types them: blanks, cases, one twice.
ASKED = ("  brand#4 ", "BRAND#11", "", "Brand#4", "brand#7")


def _upper(df: DataFrame) -> DataFrame:
    return df.withColumn("symbol", F.upper("symbol"))


@query
def prices_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw closes of the symbols asked for."""
    px = _upper(weekly(spark, sf_dir, "p_brand"))
    return rounded(returns.load_prices(px, store.symbols_of(ASKED), "1996-01-01", AS_OF, adjusted=False), 4)


@query
def store_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new store that takes the bars asked for from 1996 on, then imports others, at twice the price, where it has none."""
    px = materialized(_upper(weekly(spark, sf_dir, "p_brand")))
    own = store.PriceStore(spark, f"{shared_folder(spark)}/prices-{uuid.uuid4().hex}")
    brought = own.ingest(ASKED, lambda s: px.filter(F.col("symbol") == s).select(F.col("date").alias("Date"), F.col("close").alias("Close")), "1996-01-01")
    added = own.import_from(px.filter(F.col("date") < "1997-01-01").withColumns({c: F.col(c) * 2 for c in ("close", "adj_close")}))
    counts = spark.createDataFrame(list(brought.items()), "symbol string, brought long")  # the symbols asked for
    rows = own.read().join(F.broadcast(counts), "symbol", "left")
    return rounded(rows.select("symbol", "date", "close", "adj_close", F.coalesce("brought", F.lit(0)).alias("brought"), F.lit(added).cast("long").alias("added")), 4)


@query
def scores_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking written as CSV and read again."""
    path = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    scores(weekly(spark, sf_dir, "p_brand")).coalesce(1).write.csv(path, header=True)  # a row a symbol
    return rounded(score_files.load(spark, path))


@query
def filings_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company facts (nested JSON) as rows."""
    return rounded(filings.extract(market.company_facts(spark, sf_dir)), 7)


@query
def filings_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the symbols asked for, beside stored rows that win."""
    facts = _upper(market.fundamentals(spark, sf_dir))
    stored = facts.filter("filed < '1998-01-01'").withColumn("value", F.lit(1.0))
    ciks = facts.select("symbol", F.regexp_extract("symbol", r"(\d+)", 1).cast("long").alias("cik")).distinct()
    return rounded(filings.ingest(stored, market.company_facts(spark, sf_dir), ciks, list(ASKED)), 7)


@query
def returns_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(week_returns(spark, sf_dir, "p_brand"))


@query
def blended_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(week_series(spark, sf_dir))


@query
def equity_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.equity(week_series(spark, sf_dir)).select("date", "equity", "peak", "drawdown"))


@query
def beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every symbol against the equal-weight series."""
    r = week_returns(spark, sf_dir, "p_brand")
    return rounded(stats.beta(r, stats.blended(r, equal(r)), ["symbol"]), 6)


@query
def cov_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(covariance.sample(week_returns(spark, sf_dir)), 10)


@query
def cov_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(covariance.ewma(week_returns(spark, sf_dir)), 10)


@query
def cov_ledoit_wolf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(covariance.ledoit_wolf(week_returns(spark, sf_dir)), 10)


@query
def cov_oas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(covariance.oas(week_returns(spark, sf_dir)), 10)


@query
def cov_annualized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(covariance.annualized(covariance.sample(week_returns(spark, sf_dir)), 52))


def _positions(prices: DataFrame) -> DataFrame:
    """Every other symbol by shares, the others by weight."""
    i = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("symbol"))
    names = prices.select("symbol").distinct().withColumn("i", i)
    return names.select("symbol", F.when(F.col("i") % 2 == 1, F.col("i") * 10.0).alias("shares"), F.when(F.col("i") % 2 == 0, F.lit(0.1)).alias("weight"), F.col("i").cast("int").alias("ord"))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = weekly(spark, sf_dir)
    return spec.resolve_weights(_positions(px), returns.latest_prices(px), cash=50_000.0, check=False)


@query
def resolve_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(book(spark, sf_dir), 6)


@query
def var_parametric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(var.parametric(day_series(spark, sf_dir), CONFIDENCE, 10))


@query
def var_cornish_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(var.cornish_fisher_var(day_series(spark, sf_dir), CONFIDENCE))


@query
def return_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(var.sample_moments(day_series(spark, sf_dir)))


@query
def var_historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(var.historical(day_series(spark, sf_dir), CONFIDENCE))


@query
def var_fhs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(var.filtered_historical(day_series(spark, sf_dir), CONFIDENCE))


@query
def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's volatility by the days before it, with a quick decay."""
    return rounded(var.ewma_sigma(day_series(spark, sf_dir), 0.6).select("date", "sigma", "next_sigma"))


@query
def var_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = week_returns(spark, sf_dir)
    cov = views.full(covariance.sample(r)).orderBy("sym_i", "sym_j").toPandas()  # a small universe's matrix
    m = cov.pivot(index="sym_i", columns="sym_j", values="cov").to_numpy()
    return var.monte_carlo(spark, np.full(len(m), 1 / max(1, len(m))), m, CONFIDENCE)


def _rolled(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(var.rolling(day_series(spark, sf_dir), method, CONFIDENCE, ROLL))

    return run


_all["rolling_var_hist"] = _rolled("historical")
_all["rolling_var_param"] = _rolled("parametric")
_all["rolling_var_fhs"] = _rolled("filtered_historical")


@query
def breach_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.transitions(var.rolling(day_series(spark, sf_dir), "historical", CONFIDENCE, ROLL))


@query
def coverage_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kupiec's and Christoffersen's likelihood ratios and the p-value of both."""
    rolled = var.rolling(day_series(spark, sf_dir), "parametric", CONFIDENCE, ROLL)
    return rounded(coverage.likelihood_ratios(rolled, CONFIDENCE), 6)


@query
def worst_breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coverage.worst_breach(var.rolling(day_series(spark, sf_dir), "parametric", CONFIDENCE, ROLL)), 6)


@query
def validate_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coverage.validate(var.rolling(day_series(spark, sf_dir), "filtered_historical", CONFIDENCE, ROLL), CONFIDENCE), 9)


@query
def pit_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(returns.latest_fundamentals(market.fundamentals(spark, sf_dir), AS_OF), 2)


def characteristics(spark: SparkSession, sf_dir: str, last: bool = False) -> DataFrame:
    px = weekly(spark, sf_dir, "p_brand")
    days = exposures.week_ends(px)
    days = days.agg(F.max("as_of").alias("as_of")) if last else days
    return exposures.raw_characteristics(px, market.fundamentals(spark, sf_dir), days, **BARS)


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand's maker, but none for those of the fifth."""
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("symbol")).distinct()
    return brands.withColumn("sector", F.substring("symbol", 7, 1)).filter("sector <> '5'")


@query
def raw_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(characteristics(spark, sf_dir), 6)


@query
def clean_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exposures.clean(characteristics(spark, sf_dir)), 5)


@query
def sector_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exposures.clean(characteristics(spark, sf_dir), sectors(spark, sf_dir)), 5)


@query
def week_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposures.week_ends(market.prices(spark, sf_dir, "p_type", "day"))


def _named(df: DataFrame, names: tuple[str, ...], to: str) -> DataFrame:
    """The symbols of df, in alphabetical order, under other names."""
    i = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("symbol"))
    known = df.select("symbol").distinct().withColumn(to, F.element_at(F.array(*[F.lit(n) for n in names]), F.least(i, F.lit(len(names)))))
    return df.join(known, "symbol")


def own_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for factor returns: the weekly series of the six part types, as of the bar before."""
    r = _named(week_returns(spark, sf_dir), regression.FACTORS, "factor")
    return r.select("date", "factor", F.col("r").alias("value"))


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for published daily factors."""
    names = ("mkt_rf", "hml", "mom", "smb", "rf", "rf")
    r = _named(returns.load_returns(market.prices(spark, sf_dir, "p_type", "day")), names, "series").filter("series <> 'rf'")
    return r.groupBy("date").pivot("series", ["hml", "mkt_rf", "mom", "smb"]).agg(F.first("r"))


@query
def period_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = exposures.week_ends(market.prices(spark, sf_dir, "p_type", "day"))
    return rounded(crosscheck.compounded(published(spark, sf_dir), ends, ["hml", "mkt_rf", "mom", "smb"]))


@query
def factor_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = own_factors(spark, sf_dir).withColumnRenamed("date", "as_of")
    return rounded(crosscheck.cross_check(own, published(spark, sf_dir)), 6)


def _zipped(rows: pd.DataFrame, names: dict[str, str]) -> bytes:
    """A factor file as published: prose, a header, days in percent with -99.99 for holes, more prose."""
    table = "\n".join(",".join([f"{r.date:%Y%m%d}", *[f"{-99.99 if getattr(r, c) is None else 100 * getattr(r, c):10.4f}" for c in names]]) for r in rows.itertuples())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("factors.csv", f"Made from trade tables\n\n,{','.join(names.values())}\n{table}\n\nEnd, of the table\n")
    return out.getvalue()


@query
def factor_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of published factors, written and parsed: holes on each month's 13th, momentum on working days up to Thursday."""
    rows = published(spark, sf_dir).orderBy("date").toPandas()  # a row a day
    rows["rf"] = [None if d.day == 13 else 0.0001 for d in rows["date"]]
    three = _zipped(rows, {"mkt_rf": "Mkt-RF", "smb": "SMB", "hml": "HML", "rf": "RF"})
    momentum = _zipped(rows[[d.weekday() < 4 for d in rows["date"]]], {"mom": "Mom   "})
    return rounded(factorlib.daily(spark, three, momentum, "1996-01-01").select("date", "mkt_rf", "smb", "hml", "rf", "mom"))


def _shares(x: pd.Series) -> pd.Series:
    return 1 / x / (1 / x).sum()


_INVERSE = {"inverse_variance": lambda w: _shares(w.var()), "inverse_volatility": lambda w: _shares(w.std())}


@query
def trailing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two strategies' weights at every rebalance, each from its trailing window, with the window's length."""
    rows = backtest.calendar(week_returns(spark, sf_dir), WINDOW, STEP)
    return rounded(backtest.solved_targets(rows, _INVERSE, WINDOW, STEP, note=lambda name, w: float(len(w))))


@query
def backtest_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their walks: targets that change at every rebalance, traded from where the book drifted to."""
    rows = backtest.calendar(week_returns(spark, sf_dir), WINDOW, STEP)
    return rounded(backtest.results(*backtest.walk(rows, backtest.solved_targets(rows, _INVERSE, WINDOW, STEP), COST)), 6)


@query
def backtest_equal_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = backtest.calendar(week_returns(spark, sf_dir), WINDOW, STEP)
    days, _ = backtest.walk(rows, backtest.equal_targets(rows), COST)
    return rounded(days.select("strategy", "date", "gross", "net"))


@query
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = backtest.calendar(week_returns(spark, sf_dir), WINDOW, STEP)
    return rounded(backtest.results(*backtest.walk(rows, backtest.equal_targets(rows), COST)), 6)


@query
def implied_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = week_returns(spark, sf_dir)
    return rounded(views.implied_returns(covariance.annualized(covariance.sample(r), 52), graded(r)))


def scores(rows: DataFrame) -> DataFrame:
    """symbol, score: a ranking that leaves the first symbol out."""
    i = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("symbol"))
    return rows.select("symbol").distinct().withColumn("i", i).filter("i > 1").select("symbol", ((F.col("i") * 7) % 5 + F.col("i") / 10.0).alias("score"))


@query
def views_from_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = week_returns(spark, sf_dir)
    return rounded(views.views_from_scores(scores(r), covariance.annualized(covariance.sample(r), 52), graded(r)))


@query
def stress_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = weekly(spark, sf_dir)
    return rounded(stress.replay(graded(px), px, *CRISIS))


@query
def stress_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named scenario, on prices whose days are moved so that they span it."""
    name, start, end, _ = stress.SCENARIOS[0]
    px = weekly(spark, sf_dir).withColumn("date", F.date_add("date", SHIFT))
    return rounded(stress.replay(graded(px), px, start, end).select(F.lit(name).alias("scenario"), "*"))


def last_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(exposures.clean(characteristics(spark, sf_dir, last=True)).select("symbol", *STYLES))


@query
def factor_shock(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = last_exposures(spark, sf_dir)
    return rounded(stress.factor_shock(graded(x), x, {"market": -0.2, "value": 0.05, "momentum": -0.1}, STYLES, check=False), 5)


@query
def rebalance_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = week_returns(spark, sf_dir)
    return rounded(rebalance.plan(graded(r).filter("weight < 0.25"), equal(r), NAV, 0.03, 10.0), 6)


@query
def rebalance_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = week_returns(spark, sf_dir)
    now = graded(r).filter("weight < 0.25")
    return rounded(rebalance.totals(rebalance.plan(now, equal(r), NAV, 0.03, 10.0), now), 6)


def _risk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = own_factors(spark, sf_dir).select("date", F.col("factor").alias("symbol"), F.col("value").alias("r"))
    r = week_returns(spark, sf_dir, "p_brand")
    specific = r.groupBy("symbol").agg(F.var_samp("r").alias("specific"))
    return decompose.decompose(graded(r), last_exposures(spark, sf_dir), covariance.ewma(f, 0.97), specific, check_first=False)


@query
def decompose_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_risk(spark, sf_dir)[0], 6)


@query
def decompose_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_risk(spark, sf_dir)[1], 6)


@query
def decompose_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_risk(spark, sf_dir)[2], 6)


def _model(spark: SparkSession, sf_dir: str) -> regression.FactorModel:
    px = weekly(spark, sf_dir, "p_brand")
    return regression.fit(regression.panel(px, market.fundamentals(spark, sf_dir), **BARS))


@query
def fit_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor returns of every week."""
    return rounded(_model(spark, sf_dir).factor_returns, 6)


@query
def panel_factor_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_model(spark, sf_dir).factor_cov, 8)


@query
def panel_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_model(spark, sf_dir).residuals, 6)


@query
def panel_specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_model(spark, sf_dir).specific, 8)


@query
def panel_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit and size of every week's regression."""
    return rounded(_model(spark, sf_dir).fits, 6)


@query
def cov_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(optimize.estimator_race(week_returns(spark, sf_dir), window=WINDOW, step=STEP), 6)


@query
def optimizer_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum expected shortfall needs 200 scenarios at 95 %, so the window is longer here."""
    return optimize.race(week_returns(spark, sf_dir), optimize.OPTIMIZERS, 208, STEP)[0]


def _solved(method) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(optimize.weights_by(covariance.ledoit_wolf(week_returns(spark, sf_dir)), method), 6)

    return run


_all["min_variance"] = _solved(optimize.min_variance)
_all["mvo"] = _solved(lambda m: optimize.mean_variance(m, max_weight=0.5))
_all["hrp"] = _solved(optimize.hierarchical)
_all["risk_parity"] = _solved(optimize.risk_parity)


@query
def min_cvar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = week_returns(spark, sf_dir).withColumn("g", F.lit(0))

    def solve(pdf):
        w = optimize.min_cvar(pdf.pivot(index="date", columns="symbol", values="r").sort_index())
        return w.rename_axis("symbol").rename("weight").reset_index()

    return rows.groupBy("g").applyInPandas(solve, "symbol string, weight double")


@query
def black_litterman(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = week_returns(spark, sf_dir)
    cov, held = covariance.annualized(covariance.sample(r), 52), graded(r)
    return rounded(views.posterior(cov, held, views.views_from_scores(scores(r), cov, held)))
