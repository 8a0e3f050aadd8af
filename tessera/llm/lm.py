"""Stupid-backoff language-model scores of a corpus by its own n-gram counts, as joins and sums.

Texts become blocks of 64-bit word hashes once, kept in the shared folder in
files dealt by block. Order by order a block's n-grams are exploded, a row for
each distinct one with its number in the block, and travel as 64-bit hashes:

    dealt by hash they are added up over all blocks, and each row is joined with
    its n-gram's count; those with enough go back, dealt by block, and are joined
    with the block they came from.

A block then knows the counts of an order at all its places, so the next order
explodes only n-grams whose context (all words but the last) and tail (all but
the first) are in the table: any other can't be in it. After the last order each
word scores by the longest n-gram ending there that the corpus has often enough,
and documents, which lie within a block, sum their words.

Longer orders go over slices of the n-grams, one after another, so that the
shuffles on disk at a time are a fixed share of all n-grams. An n-gram has at most
one row a block, however frequent it is. The most frequent words, a bounded
number, go to the blocks by broadcast.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import packed_id, shared_folder, unpacked_id

#: Longest n-gram, weight of a backoff step, least count of an n-gram of two words or more that isn't backed off.
ORDER, BACKOFF, LEAST = 3, 0.4, 2
#: Bytes of texts in a block; a text isn't parted, so that the last one may go beyond.
CHUNK = 6 << 20
#: Parts of the n-grams that are shuffled one after another, by their last word: of two words, and of more, which are fewer.
SLICES, FEWER = 3, 2
#: Words that occur over FLOOR times and are over 1 / (2 * HOT) of all go to the blocks by broadcast, 2 * HOT at most.
HOT, FLOOR = 1 << 18, 64
_START = np.uint64(0x5851F42D4C957F2D)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CODEC = pa.Codec("zstd", compression_level=1)
_ROWS = "gram long not null, block long not null, n long not null"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of documents: its number, their ids, lengths, the places of their words in a list of hashes, and that list."""
    number = TaskContext.get().partitionId() << 40
    for block in _chunks(batches):
        words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(block.column("text"))))
        empty = pc.equal(pc.binary_length(flat := words.flatten()), 0)  # what a text without words is split into
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
        if pc.any(empty).as_py():
            of = pc.list_parent_indices(words).to_numpy()
            sizes -= np.bincount(of[empty.to_numpy(zero_copy_only=False)], minlength=len(sizes))
            flat = flat.filter(pc.invert(empty))
        known = flat.dictionary_encode()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known.dictionary.to_pylist()), np.uint64, len(known.dictionary))
        values = block.column("id").to_numpy(), sizes, known.indices.to_numpy(), hashes
        columns = [pa.array([number]), *map(_packed, values), pa.array([len(flat)]), pa.array([len(sizes)])]
        yield pa.RecordBatch.from_arrays(columns, ["block", *_STORED, "n_words", "n_docs"])
        number += 1


def _packed(values: np.ndarray) -> pa.Array:
    """One value: the array's type and size in bytes, and its bytes compressed, since a row of a block is copied whole on its way."""
    head = values.dtype.str.encode().ljust(8) + values.nbytes.to_bytes(8, "little")
    return pa.array([head + _CODEC.compress(np.ascontiguousarray(values), asbytes=True)], pa.binary())


def _unpacked(value: pa.Buffer) -> np.ndarray:
    head = value[:16].to_pybytes()
    return np.frombuffer(_CODEC.decompress(value[16:], int.from_bytes(head[8:], "little")), head[:8].decode().strip())


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(counts.max(initial=0)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, with about CHUNK bytes of text each."""
    held: list[pa.RecordBatch] = []
    room = CHUNK
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
        ends, start = np.cumsum(size), 0
        while start < batch.num_rows:
            before = ends[start] - size[start]
            stop = min(int(np.searchsorted(ends, before + room)) + 1, batch.num_rows)
            held.append(batch.slice(start, stop - start))
            room -= int(ends[stop - 1] - before)
            start = stop
            if room <= 0:
                yield pa.concat_batches(held)
                held, room = [], CHUNK
    if held:
        yield pa.concat_batches(held)


#: A block's columns of bytes. counts: of its words, then for each longer order that is known the counts at all places.
_STORED = "ids", "sizes", "codes", "words"
_KNOWN = *_STORED, "counts"
#: An n-gram's hash has its slice above this bit.
_LOW = np.uint64(62)


class Block:
    """The sequences of a block, each of which starts with order - 1 marks, and at each place the counts of the n-grams that end there.

    `real` tells where a word is. `n_docs` is that of the corpus; a count that isn't in the table is 0.
    """

    def __init__(self, row: pa.RecordBatch | pa.Table, order: int, n_docs: int):
        stored = {c: _unpacked(row.column(c)[0].as_buffer()) for c in _KNOWN if c in row.schema.names}
        self.ids, self.sizes, self.codes, self.words = (stored[c] for c in _STORED)
        self.order, self.n_docs, pad = order, n_docs, order - 1
        size = self.sizes + pad
        self.starts = np.cumsum(size) - size
        self.real = np.ones(int(size.sum()), bool)
        for i in range(pad):
            self.real[self.starts + i] = False
        self.of_words, self.counts = None, []
        if "counts" in stored:
            self.know_words(stored["counts"][: len(self.words)])
            self.counts += list(stored["counts"][len(self.words) :].reshape(-1, len(self.real)))

    def know_words(self, n: np.ndarray) -> None:
        self.of_words = n
        self.counts = [np.r_[n, _narrow(np.array([(self.order - 1) * self.n_docs]))][self._places()]]

    def know(self, least: int, known: np.ndarray, n: np.ndarray) -> None:
        """Takes the counts n of the n-grams `known`, of the order above; start marks alone have one a document and place."""
        o = len(self.counts) + 1
        counts = np.zeros(len(self.real), np.int64)
        for i in range(o - 1, self.order - 1):
            counts[self.starts + i] = (self.order - o) * self.n_docs
        for part, (at, grams) in enumerate(self.grams(least, range(_slices(o)))):
            own = known >> _LOW == part
            counts[at] = np.r_[n[own], 0][_found(grams, known[own])]
        self.counts.append(_narrow(counts))

    def _places(self) -> np.ndarray:
        """The code at each place; a mark's is the one after the last word's."""
        codes = np.full(len(self.real), len(self.words), np.int32)
        codes[self.real] = self.codes
        return codes

    def grams(self, least: int, parts: Iterable[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice, places and hashes of its n-grams of the order above that can occur `least` times: whose context and tail do."""
        o, much, codes, words = len(self.counts) + 1, self.counts[-1] >= least, self._places(), np.r_[self.words, _START]
        slices = (words >> np.uint64(32)) * np.uint64(_slices(o)) >> np.uint64(32)
        can = np.r_[False, self.real[1:] & much[1:] & much[:-1]]
        for part in parts:
            at = np.flatnonzero(can & (slices == part)[codes])
            h = words[codes[at - (o - 1)]]
            for i in range(2, o + 1):
                h = (h * _MIX ^ (h >> np.uint64(31))) + words[codes[at - (o - i)]] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(i)
            yield at, h >> np.uint64(2) | np.uint64(part) << _LOW

    def scores(self, n_words: int, backoff: float, least: int) -> np.ndarray:
        """What the words of each document score."""
        at = np.flatnonzero(self.real)
        score = np.log(self.counts[0][at] / max(n_words, 1)) + (self.order - 1) * math.log(backoff)
        for o in range(2, self.order + 1):
            n = self.counts[o - 1][at]
            much = np.flatnonzero((n >= least) & (n > 0))
            score[much] = np.log(n[much] / self.counts[o - 2][at[much] - 1]) + (self.order - o) * math.log(backoff)
        return np.bincount(np.repeat(np.arange(len(self.sizes)), self.sizes), weights=score, minlength=len(self.sizes)).astype(float)

    def row(self, number: int) -> pa.Table:
        values = self.ids, self.sizes, self.codes, self.words, np.concatenate([self.of_words, *self.counts[1:]])
        return pa.table([pa.array([number]), *map(_packed, values)], ["block", *_KNOWN])


def _slices(order: int) -> int:
    return SLICES if order == 2 else FEWER


def _found(grams: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The place of each in `among`, or -1."""
    return pc.fill_null(pc.index_in(pa.array(grams), pa.array(among)), -1).to_numpy()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, block and n: the words of each block, and how often they occur there."""
    for batch in batches:
        for i in range(batch.num_rows):
            block = Block(row := batch.slice(i, 1), 1, 0)
            yield _rows(block.words, row.column("block")[0].as_py(), np.bincount(block.codes, minlength=len(block.words)))


def _exploded(order: int, n_docs: int, least: int, part: int):
    """gram, block and n: a slice of the distinct n-grams of each block of the order above those that it knows, and how often they occur there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, grams = next(Block(row := batch.slice(i, 1), order, n_docs).grams(least, [part]))
                grams.sort()
                first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
                yield _rows(grams[first], row.column("block")[0].as_py(), np.diff(first, append=len(grams)))

    return run


def _rows(grams: np.ndarray, number: int, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.full(len(grams), number)), pa.array(n.astype(np.int64))], ["gram", "block", "n"])


def _joined(order: int, n_docs: int, n_words: int, backoff: float, least: int, often: tuple[np.ndarray, np.ndarray] | None):
    """A block that also knows the counts that came back to it; with the last order id, n_words and sum of its documents.

    often: frequent words and their counts, if the counts are those of words.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, order, n_docs)
        known, n = right.column("gram").to_numpy().view(np.uint64), right.column("n").to_numpy()
        if often is not None:
            place = _found(block.words, np.r_[known, often[0]])
            block.know_words(_narrow(np.r_[n, often[1], 1][place]))  # a word that isn't found occurs once
        else:
            block.know(least, known, n)
        if len(block.counts) < order:
            return block.row(left.column("block")[0].as_py())
        return pa.table([block.ids, block.sizes, block.scores(n_words, backoff, least)], ["id", "n_words", "sum"])

    return run


class _Folder:
    """Tables in the shared folder. The shuffles of a write go as soon as it is done."""

    #: Settings of a write: shuffles go with it, files of few buckets a task are written without sorting rows by them, and Python gets one block at a time.
    WRITING = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "8",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "100000",
    }
    #: Settings of Parquet for n-grams, whose hashes have no dictionary and don't get smaller.
    HASHES = {"parquet.enable.dictionary#gram": "false", "compression": "snappy"}
    #: Settings of Parquet by which each block is a row group, so that it is read alone; it is compressed already.
    ALONE = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}"

    def write(self, save: Callable[[], None]) -> None:
        before = {k: self.spark.conf.get(k, None) for k in self.WRITING}
        try:
            for k, v in self.WRITING.items():
                self.spark.conf.set(k, v)
            save()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def add(self, df: DataFrame, name: str) -> DataFrame:
        """The table `name` with the rows of df besides those that it has."""
        self.write(lambda: df.write.mode("append").option("compression", "zstd").parquet(f"{self.top}/{name}"))
        return self.spark.read.schema(df.schema).parquet(f"{self.top}/{name}")

    def deal(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """The table `name` with the rows of df besides those that it has, in files dealt by block, which joins needn't deal again."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        files = df.write.mode("append").format("parquet").options(**{"compression": "zstd", "path": f"{self.top}/{name}"} | options).bucketBy(n, "block")
        self.write(lambda: files.saveAsTable(self.known(name)))
        return self.spark.table(self.known(name))

    def undeal(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {self.known(name)}")
        self.drop(name)

    def known(self, name: str) -> str:
        return f"{self.top.rsplit('/', 1)[1]}_{name}".replace("-", "_")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def score_documents(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_score (natural log, summed over words) and mean_log_score for each row of docs.

    A word scores count(n-gram) / count(context) at the highest order whose
    n-gram the corpus has at least `least` times, times `backoff` for each order
    given up; a single word scores its share of all words. Sequences start with
    order - 1 start marks, which contexts count. Documents without words (null,
    blank) have n_words 0, log_score 0 and a null mean. Every row counts, however
    often it repeats, and is scored by itself. Other columns are ignored; an empty table gives an empty result.

    A document's block has all its words in memory, so a text does, too. The most frequent words
    (at most 2 * HOT) reach the driver.
    """
    rows = docs.select(packed_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    folder = _Folder(docs.sparkSession)
    parts = int(folder.spark.conf.get("spark.sql.shuffle.partitions"))
    stored = ", ".join(f"{c} binary" for c in _STORED)
    blocks = folder.deal(rows.mapInArrow(_hashed, f"block long, {stored}, n_words long, n_docs long"), "blocks-0", **folder.ALONE)
    total = blocks.agg(F.sum("n_words").alias("words"), F.sum("n_docs").alias("docs")).first()
    n_words, n_docs = total["words"] or 0, total["docs"] or 0
    bound = max(FLOOR, n_words // (2 * HOT))

    for o in range(1, order + 1):
        often, of_all = None, Window.partitionBy("gram")
        for part in range(_slices(o)) if o > 1 else (None,):
            exploded = blocks.mapInArrow(_words if part is None else _exploded(order, n_docs, least, part), _ROWS)
            counts = exploded.withColumn("n", F.sum("n").over(of_all))
            if part is None:  # of a frequent word one row stays, for all blocks
                counts = counts.withColumn("first", F.min("block").over(of_all)).filter((F.col("n") >= 2) & ((F.col("n") <= bound) | (F.col("block") == F.col("first"))))
            else:
                counts = counts.filter(F.col("n") >= least)
            found = folder.deal(counts.select("block", "gram", "n").repartition(parts, "block"), f"found-{o}", **folder.HASHES)
        if o == 1:
            heads = found.filter(F.col("n") > bound).select("gram", "n").toArrow()
            often = heads["gram"].to_numpy().view(np.uint64), heads["n"].to_numpy()
        join = _joined(order, n_docs, n_words, backoff, least, often)
        both = blocks.groupBy("block").cogroup(found.groupBy("block"))
        if o < order:
            blocks = folder.deal(both.applyInArrow(join, f"block long, {', '.join(f'{c} binary' for c in _KNOWN)}"), f"blocks-{o}", **folder.ALONE)
        else:
            scored = folder.add(both.applyInArrow(join, "id long, n_words long, sum double"), "scored")
        folder.undeal(f"blocks-{o - 1}")
        folder.undeal(f"found-{o}")
    scored = scored.withColumn("log_score", F.when(F.col("n_words") > 0, F.col("sum")).otherwise(F.lit(0.0)))
    return scored.select(unpacked_id("id").alias("doc_id"), "n_words", "log_score", F.try_divide("log_score", "n_words").alias("mean_log_score"))
