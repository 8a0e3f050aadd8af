"""A market derived from trade tables: prices and filings with the schemas of stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bars that a price averages, and how often an adjusted price is missing.
SMOOTH, GAP = 21, 7


def prices(spark: SparkSession, sf_dir: str, symbol: str = "p_type", period: str = "week") -> DataFrame:
    """Bars of each value of a part's attribute: the average extended price of its lines by ship date, smoothed over 21 bars.

    Prices are summed in whole cents, so that the order of rows can't tip a rounded average.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col(symbol).alias("symbol"))
    day = F.to_date(F.date_trunc(period, "l_shipdate"))
    bars = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy("symbol", day.alias("date"))
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    bars = bars.agg(F.try_divide(cents.cast("double"), 100.0 * F.count("l_extendedprice")).alias("px"), F.sum("l_quantity").alias("volume"))
    order = Window.partitionBy("symbol").orderBy("date")
    bars = bars.withColumn("close", F.avg("px").over(order.rowsBetween(1 - SMOOTH, 0))).withColumn("row", F.row_number().over(order))
    adjusted = F.when(F.col("row") % GAP != 0, F.col("close"))
    return bars.select("symbol", "date", F.col("close").alias("open"), (F.col("close") * 1.01).alias("high"), (F.col("close") * 0.99).alias("low"), "close", adjusted.alias("adj_close"), "volume")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings of each brand and quarter: filed 45 days after the quarter ends, amended 75 days later, annual in the fourth."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("symbol"), "p_retailprice")
    quarter = F.to_date(F.date_trunc("quarter", "l_shipdate"))
    sums = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy("symbol", quarter.alias("q")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.sum("l_quantity").alias("shares_outstanding"),
        F.sum("p_retailprice").alias("assets"),
    )
    values = sums.withColumns({
        "net_income": F.col("revenue") * 0.1, "gross_profit": F.col("revenue") * 0.4,
        "book_equity": F.col("assets") * 0.6, "liabilities": F.col("shares_outstanding") * 20.0,
    })
    fields = ("book_equity", "net_income", "revenue", "gross_profit", "assets", "liabilities", "shares_outstanding")
    long = values.select("symbol", "q", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("e"))
    filing = F.explode(F.array(*[F.struct(F.lit(d).alias("days"), F.lit(form).alias("form"), F.lit(k).alias("factor")) for d, form, k in ((45, "10-Q", 1.0), (120, "10-Q/A", 1.02))]))
    end = F.date_sub(F.add_months("q", 3), 1)
    return long.select("symbol", "q", "e.field", "e.value", filing.alias("f")).select(
        "symbol", "field", (F.col("value") * F.col("f.factor")).alias("value"), end.alias("period_end"), F.date_add(end, F.col("f.days")).alias("filed"),
        F.col("f.form").alias("form"), F.year("q").alias("fiscal_year"), F.when(F.quarter("q") == 4, "FY").otherwise(F.concat(F.lit("Q"), F.quarter("q"))).alias("fiscal_period"),
    )


#: Tags under which the market's companies file; revenue under two, of which the one that comes first among the candidates counts.
FILED_TAGS = {
    "book_equity": ("StockholdersEquity",), "net_income": ("NetIncomeLoss",), "gross_profit": ("GrossProfit",), "assets": ("Assets",), "liabilities": ("Liabilities",),
    "revenue": ("SalesRevenueNet", "RevenueFromContractWithCustomerExcludingAssessedTax"), "shares_outstanding": ("EntityCommonStockSharesOutstanding",),
}


def company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, json): the market's filings as nested company facts, with a form that doesn't count and an amount in another unit."""
    rows = fundamentals(spark, sf_dir).withColumn("symbol", F.upper("symbol"))
    tags = F.create_map(*[x for f, ts in FILED_TAGS.items() for x in (F.lit(f), F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(10.0**i).alias("times")) for i, t in enumerate(reversed(ts))]))])
    each = rows.select("*", F.explode(tags[F.col("field")]).alias("t"))
    amount = F.struct((F.col("value") * F.col("t.times")).alias("val"), F.col("period_end").cast("string").alias("end"), F.col("filed").cast("string").alias("filed"), "form", F.col("fiscal_year").alias("fy"), F.col("fiscal_period").alias("fp"))
    other = F.transform("items", lambda i: i.withField("form", F.lit("8-K")).withField("val", F.lit(-1.0)))
    shares = F.col("field") == "shares_outstanding"
    units = F.create_map(F.when(shares, "shares").otherwise("USD"), F.concat("items", F.slice(other, 1, 1)), F.lit("EUR"), other)
    facts = each.groupBy("symbol", "field", F.col("t.tag").alias("tag")).agg(F.collect_list(amount).alias("items"))
    facts = facts.select("symbol", F.when(shares, "dei").otherwise("us-gaap").alias("book"), F.struct("tag", F.struct(units.alias("units")).alias("fact")).alias("e"))
    books = facts.groupBy("symbol", "book").agg(F.map_from_entries(F.collect_list("e")).alias("tags"))  # a company's quarters: bounded
    whole = books.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("book", "tags"))).alias("facts"))
    return whole.select("symbol", F.to_json(F.struct("facts")).alias("json"))
