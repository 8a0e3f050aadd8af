"""Company facts (nested JSON) as point-in-time rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.errors import FilingsError
from tessera.operators.materialize import materialized
from tessera.schemas import FUNDAMENTALS
from tessera.sources.store import symbols_of

FACT = "struct<units:map<string,array<struct<val:double,`end`:string,filed:string,form:string,fy:int,fp:string>>>>"
FACTS = f"struct<facts:map<string,map<string,{FACT}>>>"
KEY = ("symbol", "field", "period_end", "filed")
#: Candidate tags of each field, first choice first, and the forms that count.
TAGS = {
    "book_equity": ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
    "net_income": ("NetIncomeLoss",),
    "revenue": ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet"),
    "gross_profit": ("GrossProfit",),
    "assets": ("Assets",),
    "liabilities": ("Liabilities",),
}
SHARES = "EntityCommonStockSharesOutstanding"
FORMS = ("10-K", "10-Q", "10-K/A", "10-Q/A")


def extract(facts: DataFrame) -> DataFrame:
    """Rows of FUNDAMENTALS from (symbol, json): for each company and field the first candidate tag that has amounts in USD."""
    spark = facts.sparkSession
    choices = [(f, t, i, "us-gaap", "USD") for f, tags in TAGS.items() for i, t in enumerate(tags)] + [("shares_outstanding", SHARES, 0, "dei", "shares")]
    wanted = F.broadcast(spark.createDataFrame(choices, "field string, tag string, choice int, book string, unit string"))  # fixed values
    parsed = facts.select("symbol", F.explode(F.from_json("json", FACTS)["facts"]).alias("book", "tags"))
    tags = parsed.select("symbol", "book", F.explode("tags").alias("tag", "fact"))
    units = tags.join(wanted, ["book", "tag"]).select("symbol", "field", "choice", F.col("fact.units")[F.col("unit")].alias("items")).filter("items is not null")
    first = Window.partitionBy("symbol", "field").orderBy("choice")
    rows = units.withColumn("r", F.rank().over(first)).filter("r = 1").select("symbol", "field", F.explode("items").alias("i"))
    typed = rows.select("symbol", "field", F.col("i.val").alias("value"), F.to_date("i.end").alias("period_end"), F.to_date("i.filed").alias("filed"), F.col("i.form").alias("form"), F.col("i.fy").alias("fiscal_year"), F.col("i.fp").alias("fiscal_period"))
    return typed.filter(F.col("form").isin(*FORMS)).na.drop(subset=["value", "period_end", "filed"])


def cik_map(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, cik) from a JSON object of {cik_str, ticker} records."""
    raw = spark.read.text(path, wholetext=True)
    each = raw.select(F.explode(F.map_values(F.from_json("value", "map<string,struct<cik_str:long,ticker:string>>"))).alias("e"))
    return each.select(F.upper("e.ticker").alias("symbol"), F.col("e.cik_str").alias("cik"))


def read_facts(spark: SparkSession, folder: str, ciks: DataFrame) -> DataFrame:
    """(symbol, json) from one file of company facts each, whose name holds the CIK (CIK0000320193.json)."""
    number = F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1)
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(number.alias("n"), F.col("value").alias("json"))
    return raw.filter("n <> ''").withColumn("cik", F.col("n").cast("long")).join(ciks, "cik").select("symbol", "json")


def store(spark: SparkSession, path: str, facts: DataFrame, ciks: DataFrame, symbols: list[str]) -> int:
    """Adds the companies' new filings to the table at path; returns how many."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [c.split()[0] for c in FUNDAMENTALS.split(", ")]
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    stored = spark.read.schema(FUNDAMENTALS).parquet(path) if there else spark.createDataFrame([], FUNDAMENTALS)
    new = materialized(ingest(stored, facts, ciks, symbols).join(stored.select(*KEY), list(KEY), "left_anti").select(*names))
    new.write.mode("append").parquet(path)
    return new.count()


def appended(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored rows and those with new keys; of rows with one key in a delivery, one."""
    return stored.unionByName(rows.dropDuplicates(list(KEY)).join(stored.select(*KEY), list(KEY), "left_anti"))


def ingest(stored: DataFrame, facts: DataFrame, ciks: DataFrame, symbols: list[str]) -> DataFrame:
    """Adds the companies' filings; unknown companies and companies without rows are errors."""
    spark = facts.sparkSession
    if not (symbols := symbols_of(symbols)):
        raise FilingsError("no symbols given")
    asked = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    if unknown := sorted(r[0] for r in asked.join(ciks, "symbol", "left_anti").collect()):
        raise FilingsError(f"no CIK for {unknown}")
    rows = extract(facts.join(asked, "symbol", "left_semi"))
    if empty := sorted(r[0] for r in asked.join(rows, "symbol", "left_anti").collect()):
        raise FilingsError(f"no usable filings for {empty}")
    return appended(stored, rows.select(*[c.split()[0] for c in FUNDAMENTALS.split(", ")]))
