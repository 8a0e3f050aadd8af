"""Result frames as text. Nothing is computed here but tilts and the flag of oversized risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERCENT = {"cagr", "vol", "max_drawdown", "weight", "var", "es", "ann_return", "cost_drag", "avg_turnover", "share", "ret", "contribution", "before", "target", "after", "drift", "total_vol", "factor_vol", "specific_vol", "prior", "posterior", "tilt"}


def cell(name: str, value) -> str:
    if value is None:
        return "n/a"
    if isinstance(value, bool):
        return "pass" if value else "FAIL"
    if isinstance(value, float):
        return f"{value:.2%}" if name in PERCENT else f"{value:,.4f}"
    return str(value)


def text(df: DataFrame, title: str, columns: Sequence[str] | None = None) -> str:
    """A table of all rows."""
    columns = list(columns or df.columns)
    rows = [[cell(c, r[c]) for c in columns] for r in df.select(*columns).collect()]  # of a book, a list of symbols or scenarios
    widths = [max(map(len, col)) for col in zip(columns, *rows, strict=True)]
    line = lambda r: "  ".join(x.rjust(w) for x, w in zip(r, widths, strict=True))
    return "\n".join([title, line(columns), line(["-" * w for w in widths]), *map(line, rows)])


def with_tilt(weights: DataFrame) -> DataFrame:
    return weights.withColumn("tilt", F.col("posterior") - F.col("prior"))


def flagged(positions: DataFrame) -> DataFrame:
    """Marks positions whose share of risk is more than twice their weight."""
    return positions.withColumn("flag", F.when(F.col("share") > 2 * F.col("weight"), "!").otherwise(""))
