"""Scores of a screen: a CSV of symbol and score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import ScoresError
from tessera.schemas import SCORES


def load(spark: SparkSession, path: str) -> DataFrame:
    """symbol, score. The header must be exactly that; symbols are unique, scores finite, two or more and not all equal."""
    head = spark.read.text(path).first()
    if head is None or [c.strip() for c in head[0].split(",")] != ["symbol", "score"]:
        raise ScoresError(f"{path}: the header must be symbol,score")
    rows = spark.read.csv(path, header=True, schema=SCORES, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).withColumn("symbol", F.upper("symbol"))
    return checked(rows)


def checked(rows: DataFrame) -> DataFrame:
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    g = rows.agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("u"), F.count_if(bad).alias("bad"), F.countDistinct("score").alias("d")).first()
    if g["n"] != g["u"]:
        raise ScoresError("a symbol has two scores, or none")
    if g["bad"]:
        raise ScoresError(f"{g['bad']} scores aren't finite numbers")
    if g["n"] < 2 or g["d"] < 2:
        raise ScoresError("a ranking needs two different scores at least")
    return rows
