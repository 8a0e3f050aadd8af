"""Queries that SQL can't express, against plain loops, closed forms and conditions of optimality."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from tessera import errors
from tessera.operators import backtest, covariance, decompose, optimize, regression, stress, var, views
from tessera.plans import oracle
from tessera.plans import queries as core

SF = "/root/testdata/sf0.01"


def test_what_has_no_sql():
    """Each of these has a test here."""
    assert set(core.queries()) - set(oracle.oracle_sql()) == {"var_monte_carlo", "optimizer_race", "min_cvar"}


@pytest.fixture(scope="module")
def weekly(spark):
    return core.week_returns(spark, SF).toPandas().pivot(index="date", columns="symbol", values="r").sort_index()


@pytest.fixture(scope="module")
def shrunk(spark):
    m = views.full(covariance.ledoit_wolf(core.week_returns(spark, SF))).toPandas().pivot(index="sym_i", columns="sym_j", values="cov")
    return m.sort_index().sort_index(axis=1)


def weights(spark, name):
    return core.queries()[name](spark, SF).toPandas().set_index("symbol")["weight"].sort_index()


def test_mvo_meets_its_conditions(spark, shrunk):
    w = weights(spark, "mvo")
    slope = shrunk.to_numpy() @ w.to_numpy()
    free = (w > 1e-5) & (w < 0.5 - 1e-5)
    level = slope[free].mean()
    assert w.sum() == pytest.approx(1, abs=1e-5) and w.between(0, 0.5).all()
    assert np.ptp(slope[free]) < 1e-3 * level and (slope[w <= 1e-5] >= level * 0.999).all() and (slope[w >= 0.5 - 1e-5] <= level * 1.001).all()


def test_risk_parity_has_equal_shares(spark, shrunk):
    w = weights(spark, "risk_parity")
    part = w * (shrunk.to_numpy() @ w.to_numpy())
    assert w.sum() == pytest.approx(1, abs=1e-5) and (part / part.sum()).tolist() == pytest.approx([1 / len(w)] * len(w), abs=1e-4)
    names, budgets = list(shrunk.columns), np.arange(1.0, len(shrunk) + 1)
    own = optimize.risk_parity(shrunk, dict(zip(names, budgets, strict=True)))
    part = own * (shrunk.to_numpy() @ own.to_numpy())
    assert (part / part.sum()).tolist() == pytest.approx((budgets / budgets.sum()).tolist(), abs=1e-9)


def test_hrp_against_a_recursion_on_sets(spark, shrunk):
    v = np.diag(shrunk)
    distance = np.sqrt(np.clip((1 - shrunk / np.sqrt(np.outer(v, v))) / 2, 0, None)).to_numpy()
    clusters = [([i], i) for i in range(len(v))]
    for made in range(len(v), 2 * len(v) - 1):
        _, a, b = min((min(distance[i][j] for i in x[0] for j in y[0]), p, q) for p, x in enumerate(clusters) for q, y in enumerate(clusters) if p < q)
        left, right = sorted((clusters[a], clusters[b]), key=lambda c: c[1])
        clusters = [c for k, c in enumerate(clusters) if k not in (a, b)] + [(left[0] + right[0], made)]

    def risk(at):
        inverse = 1 / v[at]
        inverse = inverse / inverse.sum()
        return inverse @ shrunk.to_numpy()[np.ix_(at, at)] @ inverse

    def split(at, budget):
        if len(at) == 1:
            return {at[0]: budget}
        a, b = at[: len(at) // 2], at[len(at) // 2 :]
        share = risk(b) / (risk(a) + risk(b))
        return split(a, budget * share) | split(b, budget * (1 - share))

    want = split(clusters[0][0], 1.0)
    assert weights(spark, "hrp").tolist() == pytest.approx([want[i] for i in range(len(v))], abs=1e-6)


def test_min_cvar_can_not_be_bettered(spark, weekly):
    w, x, rng = weights(spark, "min_cvar"), weekly.to_numpy(), np.random.default_rng(2)
    best = optimize.expected_shortfall(w.to_numpy(), x)
    for far in (1e-3, 0.03, 0.5):
        for _ in range(150):
            other = (1 - far) * w.to_numpy() + far * rng.dirichlet(np.full(len(w), 0.5))
            assert optimize.expected_shortfall(other / other.sum(), x) >= best - 1e-6


def test_monte_carlo_near_its_closed_form(spark, weekly):
    got = core.var_monte_carlo(spark, SF).first()
    sd = np.full(weekly.shape[1], 1 / weekly.shape[1]) @ weekly.cov().to_numpy() @ np.full(weekly.shape[1], 1 / weekly.shape[1])
    assert got["var"] == pytest.approx(2.3263 * math.sqrt(sd), rel=0.03) and got["es"] == pytest.approx(2.6652 * math.sqrt(sd), rel=0.03)


def test_validation_against_its_series(spark):
    rolled = core.queries()["rolling_var_fhs"](spark, SF).toPandas().sort_values("date")
    got = core.validate_var(spark, SF).first()
    hits = rolled["breach"].to_numpy()
    n, x, p = len(hits), int(hits.sum()), 1 - core.CONFIDENCE
    ll = lambda q: (n - x) * math.log(1 - q) + (x * math.log(q) if x else 0)
    assert (got["n"], got["breaches"]) == (n, x) and got["expected"] == pytest.approx(n * p)
    assert got["p_pof"] == pytest.approx(math.erfc(math.sqrt(max(0, -2 * (ll(p) - ll(x / n))) / 2)), abs=1e-9)
    upto = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))
    assert got["zone"] == ("green" if upto < 0.95 else "yellow" if upto < 0.9999 else "red")
    assert got["n11"] == int((hits[1:] & hits[:-1]).sum()) and got["worst_ratio"] == pytest.approx((-rolled["realized"] / rolled["var"])[hits].max(), rel=1e-6)


def walked(x, fn, window, step, cost_bps):
    """Volatility, Sharpe ratio, turnover and drawdown by one loop over days."""
    held, net, turns = np.zeros(x.shape[1]), [], []
    for t in range(window, len(x)):
        cost = 0.0
        if (t - window) % step == 0:
            target = fn(x.iloc[t - window : t]).reindex(x.columns).to_numpy()
            turns.append(np.abs(target - held).sum() / 2)
            cost, held = 2 * turns[-1] * cost_bps / 10_000, target
        day = x.iloc[t].to_numpy()
        gross = float(held @ day)
        net.append(gross - cost)
        held = held * (1 + day) / (1 + gross)
    net = np.array(net)
    equity = np.cumprod(1 + net)
    return net.std(ddof=1) * math.sqrt(252), net.mean() / net.std(ddof=1) * math.sqrt(252), np.mean(turns), (equity / np.maximum.accumulate(equity) - 1).min()


@pytest.mark.parametrize(("name", "window", "strategies"), [("cov_race", core.WINDOW, optimize.ESTIMATORS), ("optimizer_race", 208, optimize.OPTIMIZERS)])
def test_races_against_a_loop_over_days(spark, weekly, name, window, strategies):
    got = core.queries()[name](spark, SF).toPandas().set_index("strategy")
    assert set(got.index) == set(strategies)
    for s, fn in strategies.items():
        if s == "min_cvar" and window * 0.05 < 10:
            continue
        want = walked(weekly, fn, window, core.STEP, 2.0)
        assert got.loc[s, ["vol", "sharpe", "avg_turnover", "max_drawdown"]].astype(float).tolist() == pytest.approx(list(want), rel=1e-4, abs=1e-6), s


def days(spark, values):
    dates = pd.date_range("2000-01-03", periods=len(values), freq="D").date
    return spark.createDataFrame(list(zip(dates, map(float, values), strict=True)), "date date, r double")


def test_volatility_recursion_of_quick_decay(spark):
    rng = np.random.default_rng(4)
    r = rng.normal(0, 0.01, 2500)
    for lam in (0.6, 0.05):
        got = var.ewma_sigma(days(spark, r), lam).toPandas().sort_values("row")
        s, want = float(np.mean(r[:30] ** 2)), []
        for x in r[30:]:
            want.append(math.sqrt(s))
            s = lam * s + (1 - lam) * x * x
        assert got["sigma"].iloc[30:].tolist() == pytest.approx(want, rel=1e-9)
        assert np.isfinite(var.filtered_historical(days(spark, r), lam=lam).first()["var"])


def test_too_short_series_have_no_answer(spark):
    r = np.random.default_rng(5).normal(0, 0.01, 131)
    assert var.filtered_historical(days(spark, r[:130])).first()["var"] is None
    assert var.filtered_historical(days(spark, r)).first()["var"] is not None
    assert var.rolling(days(spark, r[:101]), "historical", 0.99, 100).count() == 0
    assert var.rolling(days(spark, r[:102]), "historical", 0.99, 100).count() == 2


def test_scenarios_are_the_fixed_windows():
    assert {n: (a, b) for n, a, b, _ in stress.SCENARIOS} == {"gfc2008": ("2008-09-01", "2009-03-09"), "covid2020": ("2020-02-19", "2020-03-23"), "rates2022": ("2022-01-03", "2022-10-14")}


def test_incomplete_books_are_refused(spark):
    held = spark.createDataFrame([("A", 0.5), ("B", 0.4)], "symbol string, weight double")
    some = spark.createDataFrame([("A", 1.0), ("B", None)], "symbol string, value double")
    for x in (some, some.filter("symbol = 'A'")):
        with pytest.raises(errors.StressError, match="B"):
            stress.factor_shock(held, x, {"market": -0.1}, ("value",))
    assert {r["factor"]: r["contribution"] for r in stress.factor_shock(held, some, {"market": -0.1, "value": 1.0}, ("value",), check=False).collect()} == pytest.approx({"market": -0.09, "value": 0.5})
    for bad in ({}, {"market": float("nan")}):
        with pytest.raises(errors.StressError):
            stress.factor_shock(held, some, bad, ("value",))
    cov = spark.createDataFrame([("market", "market", 1e-4), ("market", "value", 0.0), ("value", "value", 1e-4)], "sym_i string, sym_j string, cov double")
    own = spark.createDataFrame([("A", 1e-5), ("B", 1e-5)], "symbol string, specific double")
    with pytest.raises(errors.DecompositionError, match="B"):
        decompose.decompose(held, some, cov, own, styles=("value",))
    with pytest.raises(errors.DecompositionError):
        decompose.decompose(held.limit(0), some, cov, own, styles=("value",))


def test_races_tell_what_failed(spark):
    rows = [(d, s, x) for i, d in enumerate(pd.date_range("2001-01-01", periods=40).date) for s, x in (("A", 0.01 * (-1) ** i), ("B", 0.02 * (-1) ** (i // 2)), ("C", -1.0 if i == 30 else 0.0))]
    df = spark.createDataFrame(rows, "date date, symbol string, r double")

    def broken(window):
        raise errors.OptimizationError("no answer")

    def all_in(window):
        return pd.Series([0.0, 0.0, 1.0], index=window.columns)

    entrants = {"ok": optimize.equal_weight, "broken": broken, "ruined": all_in}
    done, failed = optimize.race(df, entrants, 10, 5)
    assert [r["strategy"] for r in done.collect()] == ["ok"]
    told = {r["strategy"]: r["error"] for r in failed.collect()}
    assert told["broken"] == "no answer" and "lost everything" in told["ruined"]
    both = {r["strategy"]: r for r in optimize.estimator_race(df, entrants, 10, 5).collect()}
    assert both["ok"]["error"] is None and both["broken"]["error"] == "no answer" and both["broken"]["vol"] is None and "ruined" in both
    with pytest.raises(backtest.BacktestError, match="ruined"):
        backtest.run(df, {"ruined": all_in}, 10, 5)


def test_guards_of_optimisers_and_panels(spark):
    m = pd.DataFrame(np.diag([1.0, 2.0, 3.0]), index=list("abc"), columns=list("abc"))
    mu = pd.Series([0.1, 0.1, 0.1], index=list("abc"))
    for bad in ({"max_weight": 0.0}, {"max_weight": 1.5}, {"mu": mu, "risk_aversion": 0.0}, {"sector_caps": {"x": 0.5}}, {"sectors": {"a": "x"}, "sector_caps": {"y": 0.5}}):
        with pytest.raises(errors.OptimizationError):
            optimize.mean_variance(m, **bad)
    x = pd.DataFrame(np.random.default_rng(1).normal(0, 0.01, (400, 3)), columns=list("abc"))
    for bad in ({"confidence": 0.4}, {"max_weight": 0.0}, {"max_weight": 0.2}):
        with pytest.raises(errors.OptimizationError):
            optimize.min_cvar(x, **bad)
    hedge = pd.DataFrame({"a": x["a"], "b": x["a"] * 0.5 + 0.1 * x["b"]})
    short = optimize.min_cvar(hedge, long_only=False)
    assert short["a"] < 0 and optimize.expected_shortfall(short.to_numpy(), hedge.to_numpy()) < optimize.expected_shortfall(optimize.min_cvar(hedge).to_numpy(), hedge.to_numpy())
    px = spark.createDataFrame([("A", d, 1.0, 1.0) for d in pd.date_range("2001-01-01", periods=9).date], "symbol string, date date, close double, adj_close double")
    with pytest.raises(errors.RegressionError, match="9 trading days"):
        regression.panel(px, px, check=True)
