"""The price store: vendor frames made tidy, upserts, and imports that never overwrite."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.errors import ImportSourceError, PriceDataError
from tessera.operators.materialize import materialized
from tessera.schemas import PRICES

KEY = ("symbol", "date")
COLUMNS = tuple(c.split()[0] for c in PRICES.split(", "))


def symbols_of(names: Sequence[str]) -> list[str]:
    """Names stripped, upper-cased, without blanks, once each in the order given."""
    return list(dict.fromkeys(n.strip().upper() for n in names if n.strip()))


def normalize(raw: DataFrame, symbol: str, seq: str | None = None) -> DataFrame:
    """A vendor's frame (Date, Open, High, Low, Close, Adj Close, Volume; missing ones become null) as tidy bars.

    Names of two levels are cut to the first. Rows without a close are dropped,
    a missing adjusted close is the close, zones are stripped to dates, and of
    bars for one date the last one (by seq, else by ingestion order) stays.
    """
    name = {c.lower().split(".")[0].strip("('\" ").split("',")[0].replace(" ", "_"): c for c in raw.columns}
    if "date" not in name or "close" not in name:
        raise PriceDataError(f"{symbol}: a frame needs Date and Close, got {raw.columns}")
    col = lambda n: F.col(f"`{name[n]}`").cast("double") if n in name else F.lit(None).cast("double")
    order = F.col(f"`{seq}`") if seq else F.monotonically_increasing_id()
    adjusted = F.coalesce(col("adj_close"), col("close")) if "adj_close" not in name else col("adj_close")
    tidy = raw.select(
        F.lit(symbol).alias("symbol"), F.to_date(F.col(f"`{name['date']}`")).alias("date"), *[col(c).alias(c) for c in ("open", "high", "low", "close")],
        adjusted.alias("adj_close"), col("volume").alias("volume"), order.alias("seq_"),
    ).filter("close is not null and not isnan(close)")
    last = Window.partitionBy("symbol", "date").orderBy(F.desc("seq_"))
    return tidy.withColumn("n_", F.row_number().over(last)).filter("n_ = 1").select(*COLUMNS)


def upserted(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows, replaced by incoming ones with their key."""
    if missing := [c for c in COLUMNS if c not in incoming.columns]:
        raise PriceDataError(f"incoming rows lack {missing}")
    return stored.select(*COLUMNS).join(incoming.select(*KEY), list(KEY), "left_anti").unionByName(incoming.select(*COLUMNS))


def imported(stored: DataFrame, foreign: DataFrame) -> DataFrame:
    """Stored rows and the foreign ones whose keys are new; own rows win. The foreign schema must match name by name and type by type."""
    want = [(f.name, f.dataType) for f in StructType.fromDDL(PRICES)]
    if (got := [(f.name, f.dataType) for f in foreign.schema]) != want:
        raise ImportSourceError(f"schema differs: wanted {want}, got {got}")
    return stored.select(*COLUMNS).unionByName(foreign.join(stored.select(*KEY), list(KEY), "left_anti").select(*COLUMNS))


class PriceStore:
    """A Parquet table partitioned by symbol; a write replaces the partitions of the symbols it brings."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        probe = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not probe.getFileSystem(spark._jsc.hadoopConfiguration()).exists(probe):
            self._write(spark.createDataFrame([], PRICES))

    def read(self) -> DataFrame:
        return self.spark.read.schema(PRICES).parquet(self.path).select(*COLUMNS)

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(self.path)

    def _replace(self, touched: DataFrame, merged: Callable[[DataFrame], DataFrame]) -> None:
        names = touched.select("symbol").distinct()
        kept = self.read().join(names, "symbol", "left_semi")
        # Kept in the shared folder before partitions are replaced, so that a lost executor doesn't read them again.
        self._write(materialized(merged(kept)))

    def store(self, tidy: DataFrame) -> int:
        """Upserts; returns the number of rows brought."""
        n = tidy.count()
        self._replace(tidy, lambda kept: upserted(kept, tidy))
        return n

    def import_from(self, foreign: DataFrame) -> int:
        """Adds rows with new keys; returns how many."""
        before = self.read().count()
        self._replace(foreign, lambda kept: imported(kept, foreign))
        return self.read().count() - before

    def ingest(self, names: Sequence[str], fetch: Callable[[str], DataFrame], start: str | None = None) -> dict[str, int]:
        """Fetches, tidies and stores one symbol after another, from `start` on; what came before a failure stays. No symbols, and symbols without bars, are errors."""
        if not (symbols := symbols_of(names)):
            raise PriceDataError("no symbols given")
        out = {}
        for s in symbols:
            tidy = normalize(fetch(s), s)
            tidy = tidy if start is None else tidy.filter(F.col("date") >= F.lit(start).cast("date"))
            out[s] = self.store(tidy)
            if not out[s]:
                raise PriceDataError(f"no bars for {s}")
        return out


def csv_frames(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    """A fetch for ingest(): a vendor's frame of a symbol from folder/SYMBOL.csv."""
    return lambda s: spark.read.csv(f"{folder}/{s}.csv", header=True, inferSchema=True)
