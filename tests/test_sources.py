"""Sources and sinks, the stream, commands, and the registered queries against SQL."""

from __future__ import annotations

import datetime as dt
import io
import json
import zipfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera import cli, errors
from tessera.plans import oracle
from tessera.plans import queries as core
from tessera.schemas import FACTOR_DAYS, FUNDAMENTALS, PRICES
from tessera.sources import factorlib, filings, market, scores, spec, store
from tessera.sources.store import PriceStore
from tessera.streaming import bars

SF = "/root/testdata/sf0.01"
D = dt.date


def bar(s, d, c):
    return (s, d, c, c, c, c, c, 1.0)


def test_vendor_frames(spark):
    rows = [("2024-01-02 00:00:00", 10.0, 9.8, 1), ("2024-01-02 00:00:00", 11.0, 10.8, 2), ("2024-01-03 00:00:00", None, None, 3)]
    raw = spark.createDataFrame(rows, "Date string, Close double, `Adj Close` double, seq int")
    assert [tuple(r) for r in store.normalize(raw, "X", "seq").collect()] == [("X", D(2024, 1, 2), None, None, None, 11.0, 10.8, None)]
    assert store.normalize(raw.drop("Adj Close"), "X", "seq").first()["adj_close"] == 11.0
    with pytest.raises(errors.PriceDataError):
        store.normalize(raw.drop("Close"), "X")
    assert store.symbols_of([" b", "A", "", "B "]) == ["B", "A"]


def test_store_upserts_and_imports(spark, tmp_path):
    s = store.PriceStore(spark, str(tmp_path / "px"))
    make = lambda *rows: spark.createDataFrame(list(rows), PRICES)
    s.store(make(bar("A", D(2024, 1, 1), 1.0), bar("A", D(2024, 1, 2), 2.0), bar("B", D(2024, 1, 1), 5.0)))
    s.store(make(bar("A", D(2024, 1, 2), 3.0)))
    assert s.import_from(make(bar("A", D(2024, 1, 1), 9.0), bar("C", D(2024, 1, 1), 9.0))) == 1
    got = {(r["symbol"], r["date"].day): r["close"] for r in s.read().collect()}
    assert got == {("A", 1): 1.0, ("A", 2): 3.0, ("B", 1): 5.0, ("C", 1): 9.0}
    with pytest.raises(errors.ImportSourceError):
        s.import_from(make(bar("A", D(2024, 1, 1), 9.0)).withColumnRenamed("open", "o"))
    assert store.PriceStore(spark, s.path).read().count() == 4


def test_filings(spark, tmp_path):
    item = lambda v, end, filed, form="10-K": {"val": v, "end": end, "filed": filed, "form": form, "fy": 2023, "fp": "FY"}
    usd = lambda *items: {"units": {"USD": list(items)}}
    facts = {"facts": {
        "us-gaap": {
            "Assets": usd(item(1500.0, "2023-12-31", "2024-02-01"), item(1400.0, "2023-12-31", "2024-06-01", "10-K/A"), item(1.0, "2023-12-31", "2024-06-01", "8-K"), item(None, "2023-12-31", "2024-07-01")),
            "Revenues": {"units": {"EUR": [item(1.0, "2023-12-31", "2024-02-01")]}},
            "RevenueFromContractWithCustomerExcludingAssessedTax": usd(item(700.0, "2023-12-31", "2024-02-01")),
            "SalesRevenueNet": usd(item(600.0, "2023-12-31", "2024-02-01")),
        },
        "dei": {"EntityCommonStockSharesOutstanding": {"units": {"shares": [item(10.0, "2024-01-31", "2024-02-01")]}}},
    }}
    df = spark.createDataFrame([("A", json.dumps(facts)), ("B", '{"facts": {}}')], "symbol string, json string")
    got = sorted((r["field"], r["value"], str(r["filed"])) for r in filings.extract(df).collect())
    assert got == [("assets", 1400.0, "2024-06-01"), ("assets", 1500.0, "2024-02-01"), ("revenue", 700.0, "2024-02-01"), ("shares_outstanding", 10.0, "2024-02-01")]
    (tmp_path / "cik.json").write_text(json.dumps({"0": {"cik_str": 1, "ticker": "a"}, "1": {"cik_str": 2, "ticker": "B"}}))
    ciks = filings.cik_map(spark, str(tmp_path / "cik.json"))
    empty = spark.createDataFrame([], FUNDAMENTALS)
    once = filings.ingest(empty, df, ciks, ["A"])
    assert once.count() == 4 and filings.ingest(once, df, ciks, ["A"]).count() == 4
    for names in (["A", "Z"], ["B"]):
        with pytest.raises(errors.FilingsError, match=names[-1]):
            filings.ingest(empty, df, ciks, names)


def zipped(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x.csv", text)
    return out.getvalue()


def test_factor_library(spark):
    three = zipped("Some prose, with commas\n\n,Mkt-RF,SMB,HML,RF\n20240102,1.00,-99.99,0.5,0.01\n20240103,2.00,0.1,0.2,0.01\n\nCopyright, someone\n20240104,9,9,9,9\n")
    mom = zipped("prose\n,Mom\n20240103, 0.30\n20240104,0.1\n")
    p = factorlib.parse(three)
    assert p["mkt_rf"].tolist() == [0.01, 0.02] and pd.isna(p["smb"][0]) and len(p) == 2
    got = factorlib.daily(spark, three, mom, "2024-01-01").collect()
    assert [(r["date"], r["hml"], r["mom"]) for r in got] == [(D(2024, 1, 3), 0.002, 0.003)]
    with pytest.raises(errors.FactorLibraryError):
        factorlib.parse(zipped("nothing\n"))


@pytest.mark.parametrize(("body", "ok"), [("symbol,score\na,1\nB,2.5\n", True), ("sym,score\nA,1\nB,2\n", False), ("symbol,score\nA,1\na,2\n", False), ("symbol,score\nA,1\nB,x\n", False), ("symbol,score\nA,1\nB,1\n", False), ("symbol,score\nA,1\n", False), ("symbol,score\nA,1\nB,NaN\n", False)])
def test_scores(spark, tmp_path, body, ok):
    (tmp_path / "s.csv").write_text(body)
    if ok:
        assert {tuple(r) for r in scores.load(spark, str(tmp_path / "s.csv")).collect()} == {("A", 1.0), ("B", 2.5)}
    else:
        with pytest.raises(errors.ScoresError):
            scores.load(spark, str(tmp_path / "s.csv"))


def test_portfolio_specs(spark):
    p = spec.parse("name: x\ncash: 2000\npositions:\n- {symbol: a, shares: 80}\n- {symbol: B, weight: 0.2}\n")
    latest = spark.createDataFrame([("A", 100.0), ("B", 7.0)], "symbol string, close double")
    got = {r["symbol"]: r for r in spec.resolve_weights(p.frame(spark), latest, p.cash).collect()}
    assert got["A"]["nav"] == pytest.approx(12_500) and got["A"]["weight"] == pytest.approx(0.64) and got["B"]["cash_weight"] == pytest.approx(0.16)
    free = spec.parse("positions: [{symbol: B, weight: 0.2}]")
    row = spec.resolve_weights(free.frame(spark), latest).first()
    assert row["nav"] is None and row["cash_weight"] == pytest.approx(0.8)
    with pytest.raises(errors.PriceDataError, match="A"):
        spec.resolve_weights(p.frame(spark), latest.filter("symbol = 'B'"), p.cash)
    full = spec.parse("cash: 5\npositions: [{symbol: B, weight: 1.0}]")
    with pytest.raises(errors.PortfolioSpecError):
        spec.resolve_weights(full.frame(spark), latest, full.cash)


@pytest.mark.parametrize("body", ["[]", "odd: 1", "positions: 3", "positions: [{symbol: A}]", "positions: [{symbol: A, shares: 1, weight: 0.1}]", "positions: [{symbol: A, shares: yes}]", "positions: [{symbol: A, shares: '5'}]", "positions: [{symbol: A, shares: -1}]", "positions: [{symbol: A, weight: 1.1}]", "positions: [{symbol: A, weight: 0.6}, {symbol: B, weight: 0.6}]", "positions: [{symbol: A, weight: 0.1}, {symbol: a, weight: 0.1}]", "cash: -1", "cash: 0", "positions: [{symbol: A B, weight: 0.1}]", "positions: [{symbol: A, weight: 0.1, note: x}]", "a: [", "positions: [{weight: 0.1}]", "name: ''\ncash: 1", "name: 3\ncash: 1", "cash: yes", "cash: .nan", "positions: [{symbol: 3, weight: 0.1}]", "positions: [{symbol: A, weight: .nan}]"])
def test_bad_specs(body):
    with pytest.raises(errors.PortfolioSpecError):
        spec.parse(body)


def test_targets_survive_rounding():
    back = spec.parse(spec.dump_targets({"A": 0.3333335, "B": 0.3333335, "C": 0.333334, "D": 1e-9}))
    assert [p.symbol for p in back.positions] == ["A", "B", "C"] and sum(p.weight for p in back.positions) <= 1 + 1e-12


def test_stream_of_corrections(spark, tmp_path):
    s, source = store.PriceStore(spark, str(tmp_path / "px")), str(tmp_path / "in")
    for i, rows in enumerate(([(*bar("A", D(2024, 1, 1), 1.0), 1), (*bar("A", D(2024, 1, 1), 2.0), 2)], [(*bar("A", D(2024, 1, 1), 3.0), 3), (*bar("B", D(2024, 1, 9), 4.0), 4)])):
        spark.createDataFrame(rows, PRICES + ", seq long").coalesce(1).write.mode("append").parquet(source)
        stream = bars.read(spark, source, PRICES + ", seq long")
        bars.ingest(stream, s, str(tmp_path / "ck")).awaitTermination()
        assert s.read().filter("symbol = 'A'").first()["close"] == (2.0, 3.0)[i]
    q = bars.volumes(bars.read(spark, source, PRICES + ", seq long")).writeStream.format("memory").queryName("flow").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["symbol"], r["bars"]) for r in spark.table("flow").collect()} == {("A", 3), ("B", 1)}


def test_commands(spark, tmp_path, capsys):
    core.weekly(spark, SF).write.parquet(str(tmp_path / "in"))
    (tmp_path / "p.yaml").write_text("positions: [{symbol: ECONOMY, weight: 0.5}, {symbol: LARGE, shares: 10}]\ncash: 1000\n")
    (tmp_path / "t.yaml").write_text("positions: [{symbol: ECONOMY, weight: 0.2}, {symbol: SMALL, weight: 0.7}]\n")
    (tmp_path / "s.csv").write_text("symbol,score\nECONOMY,1\nLARGE,2\nSMALL,5\n")
    run = lambda *a: cli.main(["--store", str(tmp_path / "px"), *map(str, a)])
    assert run("version") == 0
    assert run("stats", tmp_path / "p.yaml") == 1
    assert run("import", tmp_path / "in") == 0
    p = tmp_path / "p.yaml"
    for args in (["stats", p, "--benchmark", "SMALL"], ["var", p, "--start", "1996-01-01", "--end", "2000-12-31"], ["validate-var", p, "--window", "200"], ["rebalance", p, tmp_path / "t.yaml"], ["optimize-views", tmp_path / "s.csv", "--out", tmp_path / "o.yaml"], ["cov-compare", "ECONOMY", "LARGE", "SMALL", "--window", "104"]):
        assert run(*args) == 0, capsys.readouterr().err
    assert run("stress", p) == 1
    assert run("optimize-compare", "ECONOMY", "LARGE", "SMALL", "--window", "104", "--step", "52") == 0
    out = capsys.readouterr()
    assert "monte_carlo" in out.out and "money" in out.out and "scenarios have fewer than 10" in out.out
    assert run("var", p, "--start", "2001-06-01") == 0
    out2 = capsys.readouterr().out
    assert "monte_carlo" in out2 and "finite returns are needed" in out2
    assert "new bars" in out.out and "cagr" in out.out and "cash_after" in out.out and "error:" in out.err
    assert spec.load(str(tmp_path / "o.yaml")).positions


def test_commands_on_files_of_vendors(spark, tmp_path, capsys):
    """Bars from CSV files from a day on, filings from JSON files, and the commands that need both."""
    px = core.weekly(spark, SF, "p_brand").toPandas()
    names = sorted(px["symbol"].unique())
    place, facts = ["--store", str(tmp_path / "px")], ["--fundamentals", str(tmp_path / "facts")]
    run = lambda *a: cli.main([*place, *map(str, a)])
    (tmp_path / "v").mkdir()
    for n in names[:2]:
        px[px["symbol"] == n].rename(columns={"date": "Date", "close": "Close"})[["Date", "Close"]].to_csv(tmp_path / "v" / f"{n.upper()}.csv", index=False)
    assert run("ingest", names[0], names[1], "--source", tmp_path / "v", "--start", "2000-01-01") == 0
    assert PriceStore(spark, place[1]).read().agg(F.min("date")).first()[0] >= dt.date(2000, 1, 1)
    assert run("ingest", names[0], "--source", tmp_path / "v", "--start", "2030-01-01") == 1
    upper = lambda df: df.withColumn("symbol", F.upper("symbol"))
    upper(market.prices(spark, SF, "p_brand", "day")).write.parquet(str(tmp_path / "in"))
    assert run("import", tmp_path / "in") == 0
    (tmp_path / "j").mkdir()
    (tmp_path / "ciks.json").write_text(json.dumps({"0": {"cik_str": 7, "ticker": "seven"}, "1": {"cik_str": 8, "ticker": "EIGHT"}}))
    item = {"val": 5.0, "end": "2020-03-31", "filed": "2020-05-05", "form": "10-Q", "fy": 2020, "fp": "Q1"}
    (tmp_path / "j" / "CIK0000000007.json").write_text(json.dumps({"facts": {"us-gaap": {"Assets": {"units": {"USD": [item]}}}}}))
    ask = ("--source", tmp_path / "j", "--ciks", tmp_path / "ciks.json")
    assert run("filings", "Seven", *ask, *facts) == 0 and run("filings", "seven", *ask, *facts) == 0
    out = capsys.readouterr().out
    assert "1 new filings" in out and "0 new filings" in out
    assert run("filings", "EIGHT", *ask, *facts) == 1 and run("filings", "NINE", *ask, *facts) == 1
    upper(market.fundamentals(spark, SF)).write.mode("overwrite").parquet(facts[1])
    (tmp_path / "p.yaml").write_text("positions: [{symbol: %s, weight: 0.5}, {symbol: %s, weight: 0.3}]" % (names[5], names[6]))
    days = core.weekly(spark, SF).select("date").distinct().toPandas()["date"]
    spark.createDataFrame([(d, 0.01, 0.0, 0.0, 0.0, 0.0) for d in days], FACTOR_DAYS).write.parquet(str(tmp_path / "published"))
    assert run("validate-factors", *facts, "--start", "1999-01-01", "--published", tmp_path / "published") == 0
    assert run("stress", tmp_path / "p.yaml", *facts, "--start", "2000-01-01", "--shock", "market=-0.2", "momentum=0.1") in (0, 1)
    assert run("decompose", tmp_path / "p.yaml", *facts, "--start", "1999-01-01") in (0, 1)
    told = capsys.readouterr()
    assert "correlation" in told.out and ("effective_bets" in told.out and "contribution" in told.out or "whole exposures for ['BRAND" in told.err)
    (tmp_path / "q.yaml").write_text("positions: [{symbol: NOBODY, weight: 0.5}]")
    assert run("decompose", tmp_path / "q.yaml", *facts) == 1 and run("stress", tmp_path / "p.yaml", "--scenario", "covid2020") == 1


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "part", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(oracle.oracle_sql()))
def test_query_against_sql(spark, con, name):
    want, got = con.execute(oracle.oracle_sql()[name]).df(), core.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns) and len(want) == len(got) > 0
    text = [c for c in cols if want[c].dtype.kind != "f"]
    for d in (want, got):
        for c in text:
            d[c] = [str(x)[:10] if isinstance(x, dt.date) else x for x in d[c]]
    order = text or cols
    a, b = (d[cols].sort_values(order, ignore_index=True) for d in (got, want))
    for c in cols:
        if b[c].dtype.kind == "f":
            assert a[c].astype(float).tolist() == pytest.approx(b[c].tolist(), nan_ok=True, rel=1e-6, abs=1e-7), c
        else:
            assert a[c].tolist() == b[c].tolist(), c


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
