"""Reading prices and filings: aligned returns, latest prices, point-in-time cross-sections."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import PriceDataError
from tessera.schemas import ANNUAL_ONLY, FIELDS


def iso(day: str | date | None) -> str | None:
    if day is None or isinstance(day, date):
        return day.isoformat() if day else None
    try:
        return date.fromisoformat(day).isoformat()
    except ValueError as e:
        raise PriceDataError(f"not an ISO date: {day!r}") from e


def adjusted_price() -> Column:
    return F.coalesce("adj_close", "close")


def _slice(prices: DataFrame, symbols: Sequence[str] | None, start: str | date | None, end: str | date | None) -> DataFrame:
    out = prices.filter(F.col("symbol").isin(list(symbols))) if symbols else prices
    lo, hi = iso(start), iso(end)
    out = out.filter(F.col("date") >= F.lit(lo).cast("date")) if lo else out
    return out.filter(F.col("date") <= F.lit(hi).cast("date")) if hi else out


def load_prices(prices: DataFrame, symbols: Sequence[str] | None = None, start: str | date | None = None, end: str | date | None = None, adjusted: bool = True, check: bool = False) -> DataFrame:
    """symbol, date, px of the given symbols and days, holes left as absent rows."""
    px = adjusted_price() if adjusted else F.col("close")
    out = _slice(prices, symbols, start, end).select("symbol", "date", px.alias("px")).filter("px is not null")
    if check and out.isEmpty():
        raise PriceDataError("no prices at all for that selection")
    return out


def aligned(px: DataFrame) -> DataFrame:
    """Rows of the dates on which every symbol has a price."""
    n = px.agg(F.countDistinct("symbol").alias("n_"))
    full = px.groupBy("date").agg(F.countDistinct("symbol").alias("c_")).join(F.broadcast(n), F.col("c_") == F.col("n_")).select("date")  # n: one row
    return px.join(full, "date", "left_semi")


def simple_returns(px: DataFrame) -> DataFrame:
    """symbol, date, r: change over the symbol's previous row."""
    before = F.lag("px").over(Window.partitionBy("symbol").orderBy("date"))
    return px.select("symbol", "date", (F.try_divide(F.col("px"), before) - 1).alias("r")).filter("r is not null")


def load_returns(prices: DataFrame, symbols: Sequence[str] | None = None, start: str | date | None = None, end: str | date | None = None, check: bool = False) -> DataFrame:
    """Returns between consecutive dates that all symbols share; with check, missing symbols and fewer than two shared dates are errors."""
    px = load_prices(prices, symbols, start, end)
    if check:
        if symbols and (missing := sorted(set(symbols) - {r[0] for r in px.select("symbol").distinct().collect()})):
            raise PriceDataError(f"no prices for {missing}")
        if aligned(px).select("date").distinct().limit(2).count() < 2:
            raise PriceDataError("fewer than two dates are shared by all symbols")
    return simple_returns(aligned(px))


def list_symbols(prices: DataFrame) -> DataFrame:
    return prices.select("symbol").distinct().orderBy("symbol")


def latest_prices(prices: DataFrame, symbols: Sequence[str] | None = None, as_of: str | date | None = None, check: bool = False) -> DataFrame:
    """symbol, date, close: the last raw close on or before as_of; with check, a symbol without one is an error."""
    known = _slice(prices, symbols, None, as_of).filter("close is not null")
    out = known.groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    if check and symbols and (missing := sorted(set(symbols) - {r["symbol"] for r in out.collect()})):
        raise PriceDataError(f"no price for {missing}")
    return out


def visible_facts(facts: DataFrame) -> DataFrame:
    return facts.filter(~F.col("field").isin(*ANNUAL_ONLY) | (F.col("fiscal_period") == "FY"))


def latest_fundamentals(facts: DataFrame, as_of: str | date) -> DataFrame:
    """One row for each symbol with the value of each field that was known on as_of: the newest period, in its newest filing."""
    known = visible_facts(facts).filter(F.col("filed") <= F.lit(iso(as_of)).cast("date"))
    best = known.groupBy("symbol", "field").agg(F.max_by("value", F.struct("period_end", "filed")).alias("value"))
    return best.groupBy("symbol").pivot("field", list(FIELDS)).agg(F.first("value"))


def fundamentals_panel(facts: DataFrame, days: DataFrame) -> DataFrame:
    """latest_fundamentals for every date of days (column as_of) in one job: (as_of, symbol, fields).

    A fact and the dates meet through the validity of facts, not by a range
    join: each symbol and field's filings in filing order carry the newest
    (period, filing) so far, and each date takes the last one at or before it
    out of a union sorted by date.
    """
    known = visible_facts(facts).select("symbol", "field", "filed", "period_end", "value")
    run = Window.partitionBy("symbol", "field").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    pairs = known.select("symbol", "field").distinct().crossJoin(days.select("as_of").distinct())  # dates x symbols x fields is the size of the result
    events = known.select("symbol", "field", F.col("filed").alias("at"), F.lit(0).alias("kind"), F.struct("period_end", "filed", "value").alias("fact"))
    asks = pairs.select("symbol", "field", F.col("as_of").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(events.schema["fact"].dataType).alias("fact"))
    answered = events.unionByName(asks).withColumn("best", F.max("fact").over(run)).filter("kind = 1 and best is not null")
    return answered.groupBy(F.col("at").alias("as_of"), "symbol").pivot("field", list(FIELDS)).agg(F.first("best.value"))
