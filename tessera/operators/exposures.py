"""Style exposures of every symbol on every date, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.returns import fundamentals_panel
from tessera.schemas import STYLES

#: Bars skipped and looked back for momentum, bars of the volatility window and the least that it takes.
SKIP, LONG, VOL, VOL_LEAST = 21, 252, 252, 60
RAW = ("bp", "ep", "log_mcap", "gp_assets", "leverage", "momentum", "vol")


def price_features(prices: DataFrame, skip: int = SKIP, long: int = LONG, vol: int = VOL, least: int = VOL_LEAST) -> DataFrame:
    """symbol, date, momentum and vol of each bar with an adjusted price, by the symbol's own bars."""
    order = Window.partitionBy("symbol").orderBy("date")
    px = prices.select("symbol", "date", F.coalesce("adj_close", "close").alias("px")).filter("px is not null")
    px = px.withColumn("r", F.try_divide(F.col("px"), F.lag("px").over(order)) - 1)
    back = order.rowsBetween(1 - vol, 0)
    spread = F.when(F.count("r").over(back) >= least, F.stddev_samp("r").over(back))
    return px.select("symbol", "date", (F.try_divide(F.lag("px", skip).over(order), F.lag("px", long).over(order)) - 1).alias("momentum"), spread.alias("vol"))


def as_of_bars(rows: DataFrame, days: DataFrame, cols: list[str]) -> DataFrame:
    """(as_of, symbol, cols of the symbol's last row at or before as_of) by one sorted pass over rows and dates."""
    events = rows.select("symbol", F.col("date").alias("at"), F.lit(0).alias("kind"), F.struct(*cols).alias("bar"))
    asks = rows.select("symbol").distinct().crossJoin(days.select(F.col("as_of").alias("at")).distinct()).select("symbol", "at", F.lit(1).alias("kind"), F.lit(None).cast(events.schema["bar"].dataType).alias("bar"))  # the size of the result
    last = Window.partitionBy("symbol").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = events.unionByName(asks).withColumn("bar", F.last("bar", ignorenulls=True).over(last)).filter("kind = 1 and bar is not null")
    return found.select(F.col("at").alias("as_of"), "symbol", "bar.*")


def raw_characteristics(prices: DataFrame, facts: DataFrame, days: DataFrame, **bars: int) -> DataFrame:
    """(as_of, symbol, RAW): what prices and filings known on each date say; null where they say nothing."""
    features = as_of_bars(price_features(prices, **bars), days, ["momentum", "vol"])
    closes = as_of_bars(prices.filter("close is not null"), days, ["close"])
    known = fundamentals_panel(facts, days)
    both = features.join(closes, ["as_of", "symbol"], "left").join(known, ["as_of", "symbol"], "left")
    cap = F.col("close") * F.col("shares_outstanding")
    both = both.withColumn("mcap", F.when(cap > 0, cap)).withColumn("held", F.when(F.col("assets") > 0, F.col("assets")))
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return both.select(
        "as_of", "symbol", ratio("book_equity", "mcap").alias("bp"), ratio("net_income", "mcap").alias("ep"), F.ln("mcap").alias("log_mcap"),
        ratio("gross_profit", "held").alias("gp_assets"), ratio("liabilities", "held").alias("leverage"), "momentum", "vol",
    )


def _z(x: Column, whole) -> Column:
    sd = F.stddev_pop(x).over(whole)
    return F.when(sd == 0, x * 0).otherwise((x - F.avg(x).over(whole)) / sd)


def clean(raw: DataFrame, sectors: DataFrame | None = None, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(as_of, symbol, STYLES): winsorised, standardised, composed, standardised again, and with sectors demeaned within them."""
    whole = Window.partitionBy("as_of")
    clip = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.percentile(c, low).over(whole)), F.percentile(c, high).over(whole))).alias(c)
    z = raw.select("as_of", "symbol", *[clip(c) for c in RAW])
    z = z.select("as_of", "symbol", *[_z(F.col(c), whole).alias(c) for c in RAW])

    def mean(a: Column, b: Column) -> Column:
        return F.try_divide(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)), a.isNotNull().cast("int") + b.isNotNull().cast("int"))

    z = z.withColumn("v_", mean(F.col("bp"), F.col("ep"))).withColumn("q_", mean(F.col("gp_assets"), -F.col("leverage")))
    out = z.select("as_of", "symbol", _z(F.col("v_"), whole).alias("value"), "momentum", F.col("log_mcap").alias("size"), _z(F.col("q_"), whole).alias("quality"), (-F.col("vol")).alias("low_vol"))
    if sectors is None:
        return out
    known = out.join(sectors.select("symbol", "sector"), "symbol", "left")
    peers = Window.partitionBy("as_of", "sector")
    return known.select("as_of", "symbol", *[F.when(F.col("sector").isNull(), F.col(c)).otherwise(F.col(c) - F.avg(c).over(peers)).alias(c) for c in STYLES])


def week_ends(prices: DataFrame) -> DataFrame:
    """as_of, the last trading day of each ISO week."""
    return prices.filter("close is not null").groupBy(F.date_trunc("week", "date").alias("w")).agg(F.max("date").alias("as_of")).select("as_of")
