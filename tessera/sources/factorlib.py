"""Published daily factor returns: zipped CSV with prose around the table."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import FactorLibraryError

#: A fixed value: percentages at or below it mark missing days.
MISSING = -99.0


def parse(data: bytes) -> pd.DataFrame:
    """date and one column of decimal returns for each of the table's columns; missing days are null."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        lines = z.read(z.namelist()[0]).decode("latin-1").splitlines()
    header, rows = None, []
    for line in lines:
        cells = [c.strip() for c in line.split(",")]
        if re.fullmatch(r"\d{8}", cells[0]):
            rows.append(cells)
        elif rows:
            break
        elif len(cells) > 1:
            header = cells
    if not rows or header is None:
        raise FactorLibraryError("no dated rows under a header")
    names = [c.lower().replace("-", "_") for c in header[1:]]
    out = pd.DataFrame([[float(x) for x in r[1 : len(names) + 1]] for r in rows], columns=names)
    out = out.where(out > MISSING) / 100
    return out.assign(date=pd.to_datetime([r[0] for r in rows], format="%Y%m%d").date)[["date", *names]]


def daily(spark: SparkSession, three: bytes, momentum: bytes, start: str | None = None) -> DataFrame:
    """mkt_rf, smb, hml, rf and mom of the days that both files have."""
    a, b = (spark.createDataFrame(parse(x).astype(object).where(lambda d: d.notna(), None)) for x in (three, momentum))
    both = a.join(b, "date")
    return both.filter(F.col("date") >= F.lit(start).cast("date")) if start else both
