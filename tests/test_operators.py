"""Operators on hand-computed cases and against plain restatements."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import errors, reports
from tessera.functions import solve, special
from tessera.operators import backtest, covariance, coverage, crosscheck, decompose, exposures, optimize, rebalance, regression, returns, stats, stress, var, views

DAY0 = dt.date(2020, 1, 1)


def day(i):
    return DAY0 + dt.timedelta(days=i)


def series(spark, values):
    return spark.createDataFrame([(day(i), float(v)) for i, v in enumerate(values)], "date date, r double")


def long(spark, x):
    return spark.createDataFrame([(f"S{j:02d}", day(i), float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "symbol string, date date, r double")


def dense(cov):
    c = cov.toPandas()
    m = c.pivot(index="sym_i", columns="sym_j", values="cov")
    return m.combine_first(m.T).to_numpy()


def book(spark, **w):
    return spark.createDataFrame(list(w.items()), "symbol string, weight double")


def test_alignment_takes_shared_dates_and_returns_span_gaps(spark):
    rows = [("A", day(0), 100.0, None), ("A", day(1), 110.0, None), ("A", day(2), 121.0, 242.0), ("B", day(0), 50.0, None), ("B", day(2), 60.0, None)]
    px = spark.createDataFrame(rows, "symbol string, date date, close double, adj_close double")
    got = {(r["symbol"], r["date"]): r["r"] for r in returns.load_returns(px, check=True).collect()}
    assert got == {("A", day(2)): pytest.approx(1.42), ("B", day(2)): pytest.approx(0.2)}
    with pytest.raises(errors.PriceDataError, match="C"):
        returns.load_returns(px, ["A", "C"], check=True)
    latest = {r["symbol"]: (r["date"], r["close"]) for r in returns.latest_prices(px, as_of=day(1)).collect()}
    assert latest == {"A": (day(1), 110.0), "B": (day(0), 50.0)}
    with pytest.raises(errors.PriceDataError, match="ISO"):
        returns.load_prices(px, start="yesterday")


def test_stats_by_hand(spark):
    s = stats.summary(series(spark, [0.1, -0.5, 0.2])).first()
    assert s["max_drawdown"] == pytest.approx(-0.5)
    assert stats.summary(series(spark, [0.01, -0.01] * 2)).first()["vol"] == pytest.approx(0.18330, abs=1e-5)
    assert stats.summary(series(spark, [0.1])).first()["cagr"] is None
    b = stats.beta(series(spark, [0.02, 0.04, -0.02]), series(spark, [0.01, 0.02, -0.01])).first()
    assert b["beta"] == pytest.approx(2.0)
    assert stats.beta(series(spark, [0.1, 0.2]), series(spark, [0.0, 0.0])).first()["beta"] is None


def test_covariances_equal_their_dense_twins(spark):
    x = np.random.default_rng(0).multivariate_normal([0, 0, 0], [[4e-4, 1e-4, 0], [1e-4, 2e-4, 5e-5], [0, 5e-5, 1e-4]], 150)
    df = long(spark, x).cache()
    for name in ("sample", "ewma", "ledoit_wolf", "oas"):
        np.testing.assert_allclose(dense(getattr(covariance, name)(df)), covariance.DENSE[name](x), rtol=1e-9, atol=1e-15)
    tiny = long(spark, [[0.01, 0.02], [0.02, 0.01], [0.04, 0.03]])
    assert dense(covariance.sample(tiny))[0, 0] == pytest.approx(2.3333e-4, rel=1e-4)
    assert dense(covariance.ewma(long(spark, [[0.01], [0.02]])))[0, 0] == pytest.approx(2.54639e-4, rel=1e-5)
    with pytest.raises(errors.CovarianceError):
        covariance.check(long(spark, [[float("nan")], [0.1]]))


def test_var_by_hand_and_against_normal_theory(spark):
    h = var.historical(series(spark, [-0.1, -0.01] + [0.01] * 98)).first()
    assert (h["var"], h["es"]) == (pytest.approx(0.0109), pytest.approx(0.1))
    r = np.random.default_rng(5).standard_normal(20_000) * 0.01
    s = series(spark, r).cache()
    p = var.parametric(s).first()
    assert p["var"] == pytest.approx(-(r.mean() + special.ppf(0.01) * r.std(ddof=1)))
    assert p["es"] == pytest.approx(0.01 * special.pdf(special.ppf(0.01)) / 0.01, rel=0.02)
    skew, kurt = pd.Series(r).skew(), pd.Series(r).kurt()
    c = var.cornish_fisher_var(s).first()
    z = [special.cornish_fisher(special.ppf(0.01 * (i + 0.5) / 200), skew, kurt) for i in range(200)]
    assert c["var"] == pytest.approx(-(r.mean() + special.cornish_fisher(special.ppf(0.01), skew, kurt) * r.std(ddof=1)))
    assert c["es"] == pytest.approx(-(r.mean() + np.mean(z) * r.std(ddof=1)))
    m = var.monte_carlo(spark, np.array([0.5, 0.5]), np.diag([4e-4, 4e-4]), n_sims=50_000).first()
    assert m["var"] == pytest.approx(2.326 * math.sqrt(2e-4), rel=0.03)
    for bad in (0.4, 1.0):
        with pytest.raises(errors.VaRError):
            var.parametric(s, bad)
    with pytest.raises(errors.VaRError):
        var.check(0.99, 1, series(spark, [0.1] * 99))


def loop_sigma(r, lam, burn):
    s2, out = np.mean(r[:burn] ** 2), np.full(len(r), np.nan)
    for t in range(burn, len(r)):
        out[t] = s2
        s2 = lam * s2 + (1 - lam) * r[t] ** 2
    return np.sqrt(out), math.sqrt(s2)


def test_filtered_var_equals_the_recursion_on_a_long_series(spark):
    r = np.random.default_rng(9).standard_normal(4500) * np.where(np.arange(4500) % 900 < 450, 0.005, 0.03)
    sigma, after = loop_sigma(r, 0.94, 30)
    got = var.ewma_sigma(series(spark, r)).orderBy("date").toPandas()
    np.testing.assert_allclose(got["sigma"].to_numpy(float), sigma, rtol=1e-10)
    z = r[30:] / sigma[30:]
    q = np.quantile(z, 0.01)
    f = var.filtered_historical(series(spark, r)).first()
    assert f["var"] == pytest.approx(-q * after) and f["es"] == pytest.approx(-z[z <= q].mean() * after)


@pytest.mark.parametrize("method", var.METHODS)
def test_rolling_var_equals_pandas_and_never_sees_its_own_day(spark, method):
    r = pd.Series(np.random.default_rng(2).standard_normal(260) * 0.01)
    got = var.rolling(series(spark, r), method, 0.95, 100).orderBy("date").toPandas()
    if method == "historical":
        want = -r.rolling(100).quantile(0.05).shift(1)
    elif method == "parametric":
        want = -(r.rolling(100).mean().shift(1) + special.ppf(0.05) * r.rolling(100).std().shift(1))
    else:
        sigma = pd.Series(loop_sigma(r.to_numpy(), 0.94, 25)[0])
        want = -(r / sigma).rolling(100).quantile(0.05).shift(1) * sigma
    np.testing.assert_allclose(got["var"], want.dropna(), rtol=1e-9)
    changed = r.copy()
    changed.iloc[200] = -0.5
    again = var.rolling(series(spark, changed), method, 0.95, 100).orderBy("date").toPandas()
    upto = [d <= day(200) for d in got["date"]]
    np.testing.assert_allclose(got["var"][upto], again["var"][upto], rtol=1e-12)
    assert again.set_index("date").loc[day(200), "breach"]


def test_coverage_by_hand(spark):
    assert coverage.kupiec_pof(3, 250, 0.99) == pytest.approx(0.758, abs=1e-3)
    zones = [coverage.traffic_light(k, 250, 0.99) for k in (0, 4, 5, 9, 10)]
    assert zones == ["green", "green", "yellow", "yellow", "red"]
    flags = [i in range(100, 110) for i in range(500)]
    rolled = spark.createDataFrame([(day(i), 0.02, -0.03 if b else 0.01, b) for i, b in enumerate(flags)], "date date, var double, realized double, breach boolean")
    v = coverage.validate(rolled).first()
    assert (v["n01"], v["n10"], v["n11"], v["breaches"]) == (1, 1, 9, 10)
    assert v["p_ind"] < 1e-6 and v["worst_ratio"] == pytest.approx(1.5)
    assert v["p_pof"] == pytest.approx(coverage.kupiec_pof(10, 500, 0.99))
    calm = coverage.validate(rolled.withColumn("breach", F.lit(False))).first()
    assert calm["p_ind"] is None and calm["p_cc"] is None and calm["worst_date"] is None


def loop_backtest(x, fn, window, step, bps):
    held, net, gross, turns = np.zeros(x.shape[1]), [], [], []
    for t in range(window, len(x)):
        cost = 0.0
        if (t - window) % step == 0:
            target = fn(x[t - window : t])
            turns.append(np.abs(target - held).sum() / 2)
            cost, held = turns[-1] * 2 * bps / 1e4, target
        g = held @ x[t]
        gross.append(g)
        net.append(g - cost)
        held = held * (1 + x[t]) / (1 + g)
    return np.array(gross), np.array(net), turns


def test_backtest_equals_a_day_by_day_loop(spark):
    x = np.random.default_rng(1).standard_normal((90, 3)) * [0.01, 0.02, 0.015]
    df = long(spark, x)

    def gmv(window):
        return optimize.min_variance(pd.DataFrame(np.cov(window.to_numpy(), rowvar=False), index=window.columns, columns=window.columns))

    out, days = backtest.run(df, {"gmv": gmv, "eq": optimize.equal_weight}, 40, 7, 10.0)
    plain = {"gmv": lambda w: gmv(pd.DataFrame(w)).to_numpy(), "eq": lambda w: np.full(3, 1 / 3)}
    d = days.orderBy("date").toPandas()
    for r in out.collect():
        gross, net, turns = loop_backtest(x, plain[r["strategy"]], 40, 7, 10.0)
        own = d[d["strategy"] == r["strategy"]]
        np.testing.assert_allclose(own["gross"], gross, atol=1e-12)
        np.testing.assert_allclose(own["net"], net, atol=1e-12)
        assert r["avg_turnover"] == pytest.approx(np.mean(turns)) and r["n_rebalances"] == len(turns)
        assert not r["wiped_out"]
    with pytest.raises(errors.BacktestError):
        backtest.run(df, {"eq": optimize.equal_weight}, 90, 7)


def test_backtest_windows_hold_only_the_past_and_failures_are_recorded(spark):
    df = long(spark, np.arange(60).reshape(30, 2) / 1e4)

    def last(window):
        w = window.iloc[-1] / window.iloc[-1].sum()
        if len(window) != 10:
            raise errors.OptimizationError("short")
        return w

    rows = backtest.calendar(df, 10, 5)
    got = {(r["k"], r["symbol"]): r["weight"] for r in backtest.solved_targets(rows, {"last": last}, 10, 5).collect()}
    for k in range(4):
        v = np.array([2 * (9 + 5 * k), 2 * (9 + 5 * k) + 1.0])
        assert [got[k, "S00"], got[k, "S01"]] == pytest.approx((v / v.sum()).tolist())

    def broken(window):
        raise errors.OptimizationError("no")

    rows, failed = optimize.race(df, {"ok": optimize.equal_weight, "bad": broken}, 10, 5)
    assert [r["strategy"] for r in rows.collect()] == ["ok"] and failed.first()["error"] == "no"


def frame(m):
    names = [f"S{i}" for i in range(len(m))]
    return pd.DataFrame(np.array(m, float), index=names, columns=names)


def test_optimisers_on_known_answers():
    d = frame(np.diag([1.0, 4.0]))
    for f in (optimize.min_variance, optimize.hierarchical, optimize.mean_variance):
        assert f(d).tolist() == pytest.approx([0.8, 0.2], abs=1e-5)
    assert optimize.risk_parity(d).tolist() == pytest.approx([2 / 3, 1 / 3])
    rng = np.random.default_rng(0)
    for _ in range(5):
        a = rng.standard_normal((30, 6))
        m = frame(a.T @ a / 30)
        w = optimize.risk_parity(m)
        parts = w * (m.to_numpy() @ w)
        assert (parts / parts.sum()).tolist() == pytest.approx([1 / 6] * 6, abs=1e-6)
        q = optimize.mean_variance(m, max_weight=0.4)
        assert q.sum() == pytest.approx(1) and q.min() >= 0 and q.max() <= 0.4 + 1e-6
        best = q @ m.to_numpy() @ q
        for _ in range(200):
            v = rng.dirichlet(np.ones(6))
            if v.max() <= 0.4:
                assert v @ m.to_numpy() @ v >= best - 1e-7
        for kind in optimize.LINKAGES:
            h = optimize.hierarchical(m, kind)
            assert h.sum() == pytest.approx(1) and (h > 0).all()
    free = optimize.mean_variance(frame([[2.0, 0.5], [0.5, 1.0]]), long_only=False)
    assert free.tolist() == pytest.approx(optimize.min_variance(frame([[2.0, 0.5], [0.5, 1.0]])).tolist(), abs=1e-6)
    capped = optimize.mean_variance(frame(np.diag([1.0, 1.0, 9.0])), sectors={"S0": "x", "S1": "x", "S2": "y"}, sector_caps={"x": 0.5})
    assert capped.tolist() == pytest.approx([0.25, 0.25, 0.5], abs=1e-5)
    for bad in ({"max_weight": 0.3}, {"long_only": False, "fully_invested": False}):
        with pytest.raises(errors.OptimizationError):
            optimize.mean_variance(d, **bad)
    with pytest.raises(errors.OptimizationError):
        optimize.risk_parity(frame(np.diag([1.0, 0.0])))


def test_least_shortfall_avoids_the_crash():
    crash = [0.004 if i % 25 else -0.098 for i in range(500)]
    smooth = [0.02 if i % 2 else -0.02 for i in range(500)]
    x = pd.DataFrame({"crash": crash, "smooth": smooth})
    w = optimize.min_cvar(x)
    got = optimize.expected_shortfall(w.to_numpy(), x.to_numpy())
    assert all(optimize.expected_shortfall(np.array([a, 1 - a]), x.to_numpy()) >= got - 1e-6 for a in np.linspace(0, 1, 201))
    with pytest.raises(errors.OptimizationError):
        optimize.min_cvar(x.head(100))


def test_solver_refuses_what_has_no_answer():
    with pytest.raises(errors.OptimizationError):
        solve.quadratic(np.eye(2), np.zeros(2), -np.eye(2), np.zeros(2), np.ones((1, 2)), np.array([-1.0]))
    assert np.linalg.eigvalsh(solve.psd(np.array([[1.0, 2.0], [2.0, 1.0]])))[0] >= -1e-12
    assert solve.linkage_order(np.array([[0, 9, 1], [9, 0, 8], [1, 8, 0.0]])) == [1, 0, 2]


def test_views(spark):
    cov = spark.createDataFrame([("A", "A", 0.04), ("A", "B", 0.0), ("B", "B", 0.01)], "sym_i string, sym_j string, cov double")
    half = book(spark, A=0.5, B=0.5)
    pi = {r["symbol"]: r["implied"] for r in views.implied_returns(cov, half, 2.0).collect()}
    assert pi == {"A": pytest.approx(0.04), "B": pytest.approx(0.01)}
    m = pd.DataFrame(np.diag([0.04, 0.01]), index=["A", "B"], columns=["A", "B"])
    w = pd.Series({"A": 0.5, "B": 0.5})
    sure = views.black_litterman(m, w, [views.absolute_view("A", 0.1, 1.0)], 2.0)
    assert sure.tolist() == pytest.approx([0.1, 0.01])
    apart = views.black_litterman(m, w, [views.relative_view("A", "B", 0.0, 1.0)], 2.0)
    assert apart["A"] == pytest.approx(apart["B"])
    scored = spark.createDataFrame([("A", 1.0), ("B", 3.0)], "symbol string, score double")
    v = {r["symbol"]: r["value"] for r in views.views_from_scores(scored, cov, half, 0.05, 0.3, 2.0).collect()}
    assert v == {"A": pytest.approx(0.04 - 0.05 * 0.2), "B": pytest.approx(0.01 + 0.05 * 0.1)}
    post = {r["symbol"]: r["prior"] for r in views.posterior(cov, half, views.views_from_scores(scored, cov, half), 2.0).collect()}
    assert post == pi
    with pytest.raises(errors.OptimizationError):
        views.absolute_view("A", 0.1, 0.0)


def test_point_in_time_facts(spark):
    d = dt.date
    rows = [("A", "assets", 1.0, d(2023, 12, 31), d(2024, 2, 1), "Q4"), ("A", "assets", 2.0, d(2023, 12, 31), d(2024, 6, 1), "Q4"), ("A", "assets", 3.0, d(2023, 9, 30), d(2024, 7, 1), "Q3"), ("A", "revenue", 9.0, d(2024, 3, 31), d(2024, 5, 1), "Q1"), ("A", "revenue", 7.0, d(2023, 12, 31), d(2024, 2, 1), "FY")]
    facts = spark.createDataFrame(rows, "symbol string, field string, value double, period_end date, filed date, fiscal_period string")
    want = {d(2024, 1, 1): None, d(2024, 2, 1): 1.0, d(2024, 5, 31): 1.0, d(2024, 6, 1): 2.0, d(2024, 8, 1): 2.0}
    days = spark.createDataFrame([(k,) for k in want], "as_of date")
    panel = {r["as_of"]: (r["assets"], r["revenue"]) for r in returns.fundamentals_panel(facts, days).collect()}
    for k, v in want.items():
        one = returns.latest_fundamentals(facts, k).collect()
        assert [(r["assets"], r["revenue"]) for r in one] == ([] if v is None else [(v, 7.0)])
        assert panel.get(k) == (None if v is None else (v, 7.0))


def test_exposures(spark):
    n = 300
    px = [("A", day(i), 100 + i, None) for i in range(n)] + [("B", day(i), 50.0 + i % 7, None) for i in range(n)] + [("C", day(n - 1), 10.0, None)]
    prices = spark.createDataFrame([(s, d_, float(c), a) for s, d_, c, a in px], "symbol string, date date, close double, adj_close double")
    facts = spark.createDataFrame([("B", f, v, day(0), day(5), "FY") for f, v in (("shares_outstanding", 10.0), ("book_equity", 250.0), ("net_income", 50.0), ("assets", 0.0), ("gross_profit", 1.0))], "symbol string, field string, value double, period_end date, filed date, fiscal_period string")
    days = spark.createDataFrame([(day(n - 1),), (day(2),)], "as_of date")
    raw = {(r["as_of"], r["symbol"]): r for r in exposures.raw_characteristics(prices, facts, days).collect()}
    b = raw[day(n - 1), "B"]
    close = 50.0 + (n - 1) % 7
    assert b["bp"] == pytest.approx(250 / (10 * close)) and b["log_mcap"] == pytest.approx(math.log(10 * close))
    assert b["gp_assets"] is None and raw[day(2), "B"]["bp"] is None and raw[day(n - 1), "C"]["vol"] is None
    a = raw[day(n - 1), "A"]
    assert a["momentum"] == pytest.approx((100 + n - 1 - 21) / (100 + n - 1 - 252) - 1)
    rng = np.random.default_rng(7)
    v = pd.DataFrame(rng.standard_normal((20, 7)), columns=exposures.RAW)
    v.iloc[3, 0] = v.iloc[4, 0] = v.iloc[4, 1] = np.nan
    wide = spark.createDataFrame([(day(0), f"S{i:02d}", *[None if x != x else float(x) for x in row]) for i, row in enumerate(v.to_numpy())], "as_of date, symbol string, " + ", ".join(f"{c} double" for c in exposures.RAW))
    zs = lambda s: (s - s.mean()) / s.std(ddof=0)
    z = v.apply(lambda s: zs(s.clip(s.quantile(0.01), s.quantile(0.99))))
    want = pd.DataFrame({"value": zs(z[["bp", "ep"]].mean(axis=1)), "momentum": z["momentum"], "size": z["log_mcap"], "quality": zs(pd.concat([z["gp_assets"], -z["leverage"]], axis=1).mean(axis=1)), "low_vol": -z["vol"]})
    got = exposures.clean(wide).orderBy("symbol").toPandas()[list(want)]
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(), atol=1e-12)
    sectors = spark.createDataFrame([(f"S{i:02d}", "even" if i % 2 == 0 else "odd") for i in range(18)], "symbol string, sector string")
    neutral = exposures.clean(wide, sectors).orderBy("symbol").toPandas()
    even = want["momentum"][[i for i in range(0, 18, 2)]]
    np.testing.assert_allclose(neutral["momentum"].to_numpy(float)[0:18:2], even - even.mean(), atol=1e-12)
    np.testing.assert_allclose(neutral["momentum"].to_numpy(float)[18:], want["momentum"][18:], atol=1e-12)


def test_factor_model_recovers_what_made_the_returns(spark):
    rng = np.random.default_rng(5)
    b, f = rng.standard_normal((40, 5)), rng.standard_normal((60, 5)) * 0.01
    names = ("value", "momentum", "size", "quality", "low_vol")
    rows = [(day(7 * t), f"S{i:02d}", *map(float, b[i]), float(0.001 + b[i] @ f[t] + rng.standard_normal() * 0.001)) for t in range(60) for i in range(40)]
    rows.append((day(7 * 60), "S00", *map(float, b[0]), 0.0))
    panel = spark.createDataFrame(rows, "as_of date, symbol string, " + ", ".join(f"{n} double" for n in names) + ", r double")
    model = regression.fit(panel, check=True)
    got = model.factor_returns.toPandas().pivot(index="as_of", columns="factor", values="value").sort_index()
    assert len(got) == 60 and all(np.corrcoef(got[n], f[:, k])[0, 1] > 0.99 for k, n in enumerate(names))
    assert model.specific.agg(F.avg("specific")).first()[0] == pytest.approx(1e-6, rel=0.3)
    weights = spark.createDataFrame([(f"S{i:02d}", 1 / 40) for i in range(40)], "symbol string, weight double")
    x = panel.filter(F.col("as_of") == day(0))
    decompose.check(weights, x, model.specific)
    total, factors, positions = decompose.decompose(weights, x, model.factor_cov, model.specific)
    t = total.first()
    assert t["factor_share"] + t["specific_share"] == pytest.approx(1)
    assert positions.agg(F.sum("share")).first()[0] == pytest.approx(1)
    assert factors.agg(F.sum("share")).first()[0] == pytest.approx(t["factor_share"])
    with pytest.raises(errors.DecompositionError, match="ZZ"):
        decompose.check(book(spark, ZZ=1.0), x, model.specific)
    with pytest.raises(errors.RegressionError):
        regression.fit(panel.filter("symbol < 'S05'"), check=True)
    coef, _, r2 = regression.fit_one(np.zeros((10, 2)), np.arange(10.0))
    assert coef.tolist() == pytest.approx([4.5, 0, 0]) and r2 == pytest.approx(0)


def test_decomposition_by_hand(spark):
    cov = spark.createDataFrame([("market", "market", 4e-4), ("market", "value", 0.0), ("value", "value", 1e-4)], "sym_i string, sym_j string, cov double")
    x = spark.createDataFrame([("A", 1.0), ("B", -1.0)], "symbol string, value double")
    d = spark.createDataFrame([("A", 5e-5), ("B", 5e-5)], "symbol string, specific double")
    t, _, p = decompose.decompose(book(spark, A=0.5, B=0.5), x, cov, d, 52, ("value",))
    assert t.first()["total_vol"] == pytest.approx(math.sqrt(4.25e-4 * 52))
    assert [r["share"] for r in p.collect()] == pytest.approx([0.5, 0.5]) and t.first()["effective_bets"] == pytest.approx(2)


def test_crosscheck_of_perfect_factors(spark):
    rng = np.random.default_rng(3)
    edges = [day(7 * i) for i in range(12)]
    daily = [(day(i), *map(float, rng.standard_normal(4) * 0.01)) for i in range(7 * 11 + 1)]
    cols = ["mkt_rf", "hml", "smb", "mom"]
    df = spark.createDataFrame(daily, "date date, " + ", ".join(f"{c} double" for c in cols))
    p = pd.DataFrame(daily, columns=["date", *cols])
    rows = []
    for a, b in zip(edges, edges[1:], strict=False):
        inside = p[(p["date"] > a) & (p["date"] <= b)]
        for f, s, k in crosscheck.PAIRS:
            rows.append((a, f, float(k * (np.prod(1 + inside[s]) - 1))))
    rows += [(edges[-1], "market", 0.5)]
    got = crosscheck.cross_check(spark.createDataFrame(rows, "as_of date, factor string, value double"), df).collect()
    assert len(got) == 4 and all(r["correlation"] == pytest.approx(r["sign"]) and r["passed"] and r["periods"] == 11 for r in got)


def test_stress_by_hand(spark):
    d = dt.date
    rows = [("DOWN", d(2020, 2, 20), 100.0), ("DOWN", d(2020, 3, 20), 80.0), ("UP", d(2020, 2, 20), 50.0), ("UP", d(2020, 3, 20), 55.0), ("LATE", d(2020, 3, 15), 1.0), ("LATE", d(2020, 3, 20), 1.0)]
    px = spark.createDataFrame([(*r, None) for r in rows], "symbol string, date date, close double, adj_close double")
    got = stress.replay(book(spark, DOWN=0.5, UP=0.3), px, "2020-02-19", "2020-03-23", check=True)
    assert got.agg(F.sum("contribution")).first()[0] == pytest.approx(-0.07) and got.first()["symbol"] == "DOWN"
    with pytest.raises(errors.StressError, match="LATE"):
        stress.replay(book(spark, LATE=1.0), px, "2020-02-19", "2020-03-23", check=True)
    x = spark.createDataFrame([("DOWN", 1.0), ("UP", -2.0)], "symbol string, value double")
    s = {r["factor"]: r["contribution"] for r in stress.factor_shock(book(spark, DOWN=0.5, UP=0.3), x, {"market": -0.1, "value": 0.2}, ("value",)).collect()}
    assert s == {"market": pytest.approx(-0.08), "value": pytest.approx(-0.02)}
    with pytest.raises(errors.StressError):
        stress.factor_shock(book(spark, UP=1.0), x, {"odd": 1.0}, ("value",))


def test_rebalance_by_hand(spark):
    now = book(spark, A=0.64, B=0.20)
    plan = rebalance.plan(now, book(spark, A=0.40, B=0.40), 12_500, 0.05, 10.0)
    assert [(r["symbol"], r["action"], round(r["dollars"], 6)) for r in plan.collect()] == [("A", "trade", -3000.0), ("B", "trade", 2500.0)]
    t = rebalance.totals(plan, now).first()
    assert (t["cost"], t["cash_after"]) == (pytest.approx(5.5), pytest.approx(0.2))
    mixed = rebalance.plan(book(spark, A=0.5, OLD=0.5), book(spark, A=0.47, NEW=0.53), 100, 0.05, 0, 60.0)
    assert {r["symbol"]: r["action"] for r in mixed.collect()} == dict.fromkeys(("A", "OLD", "NEW"), "skip")
    with pytest.raises(errors.RebalanceError):
        rebalance.plan(now, now, None)


def test_reports_print_every_row(spark):
    book = spark.range(450).select(F.concat(F.lit("N"), F.col("id").cast("string")).alias("symbol"), F.lit(0.25).alias("weight"))
    lines = reports.text(book, "weights").split("\n")
    assert len(lines) == 3 + 450 and lines[-1].split() == ["N449", "25.00%"]
