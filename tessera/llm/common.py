"""Pieces that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of bytes other than space and the controls 9 to 13, which is what bytes.split() splits on.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster shares: the one in spark.checkpoint.dir.

    Only a local session without that setting (tests) gets a temporary folder of
    its own; on a cluster, executors would write to their own disks there.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder that the cluster shares."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: smaller than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*checkpoints: DataFrame) -> None:
    """Removes the files of checkpoints that nothing reads any more."""
    for df in checkpoints:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a task, where partitions would hold fewer.
TASK_ROWS = 50_000


def in_tasks(df: DataFrame, rows: int | None) -> DataFrame:
    """df in as few tasks as its number of rows, if it is known, asks for: each task costs the driver memory."""
    return df if rows is None else df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS + 1))


#: Keys that are joined by broadcast at most, because each has more than its share of the rows.
HOT_KEYS = 1_000


def join_hot(rows: DataFrame, small: DataFrame, key: str, count: str, total: int, most: int | None = None) -> DataFrame:
    """rows joined with small on key, where `count` tells how many rows have the key, and `total` how many there are.

    `most` is the largest count, if it is known: without hot keys nothing is looked up. At most HOT_KEYS keys can have over total / HOT_KEYS rows each: those are
    broadcast, so that their rows stay where they are.
    """
    least = max(1_000, total // HOT_KEYS + 1)
    if most is not None and most < least:
        return rows.join(small, key)
    hot = F.broadcast(small.filter(F.col(count) >= least))
    cold = small.filter(F.col(count) < least)
    if hot.isEmpty():
        return rows.join(small, key)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


#: Stands for a null id on the way through pandas, where null would make a column of ids floating-point.
NO_ID = -(1 << 63)


def packed_id(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def unpacked_id(col: str) -> Column:
    return F.nullif(F.col(col), F.lit(NO_ID))


def unused_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of at least `rows` rows (but the last) that never split a run of equal keys.

    The input must be sorted by key within the partition; what is held back is
    one run, so the caller bounds the length of runs.
    """
    held: list[pa.Table] = []
    n = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n < rows:
            continue
        all_of = pa.concat_tables(held).combine_chunks()
        keys = all_of.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield all_of.slice(0, cut)
        held, n = [all_of.slice(cut)], all_of.num_rows - cut
    if n:
        yield pa.concat_tables(held).combine_chunks()


def run_starts(keys: np.ndarray) -> np.ndarray:
    """For each row, the index at which its run of equal keys starts."""
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    return np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))


def fixed_bytes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A binary column whose values all have `width` bytes, as a matrix of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that the links (i, j) reach."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
    return root
