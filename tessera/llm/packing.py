"""Packing token sequences by best-two-fit, planned on the histogram of lengths.

Bins are filled greedily with the longest piece that fits; then the bin's
smallest piece gives way to two unpacked pieces that fill the gap it leaves more
tightly, if there are such. Only lengths matter to that, so the plan needs no
more than how many pieces have each length: CAPACITY numbers. A bin's pattern
stays the best choice until one of its lengths runs out, so it is applied as
often as the counts allow, and a corpus of any size takes at most a few thousand
patterns. Pieces then find their places by their rank among pieces of their
length, which Spark computes in parts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, packed_id, unpacked_id

CAPACITY = 2048


def best_two_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a bin, number of such bins)] that use up the histogram {length: pieces}; lengths are from 1 to capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out = []
    while left.any():
        used: Counter[int] = Counter()
        gap = capacity

        def take(length: int, n: int = 1) -> None:
            nonlocal gap
            used[length] += n
            left[length] -= n
            gap -= n * length

        while gap and len(fit := np.flatnonzero(left[: gap + 1])):
            take(int(fit[-1]))
        if gap:
            least = min(used)
            room = gap + least
            sizes = np.flatnonzero(left[: room + 1])
            if len(sizes):
                mates = np.searchsorted(sizes, room - sizes, side="right") - 1
                ok = mates >= 0
                first, second = sizes[ok], sizes[mates[ok]]
                # The same length twice needs two such pieces; else the next smaller one is the mate.
                short = (first == second) & (left[first] < 2)
                second = np.where(short, np.r_[0, sizes][mates[ok]], second)
                total = np.where(second > 0, first + second, 0)
                if len(total) and total.max() > least:
                    best = int(total.argmax())
                    take(least, -1)
                    take(int(first[best]))
                    take(int(second[best]))
        used = +used
        times = 1 + min(int(left[k]) // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * (times - 1)
        out.append((tuple(sorted(used.elements(), reverse=True)), times))
    return out


def tokenized(docs: DataFrame, tokenizer_dir: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each document; a null text is empty. Every document ends with id 0.

    Ids are those that the tokenizers library gives for byte_bpe_50k.json; all
    texts, of whatever length, get them from tiktoken over the same vocabulary,
    which is four times as fast (tests hold both against each other), and from
    tokenizers where that gives up on a run of blanks. A document of more than `capacity` ids is cut into pieces of that length, the first may
    be shorter.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer_dir)
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = np.array([*encode(text or ""), 0], "<u4")
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                out += [(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(packed_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long").withColumn("doc_id", unpacked_id("doc_id"))


def _encoder(folder: str | None):
    import base64
    import os

    import tiktoken
    from tokenizers import Tokenizer

    if folder is None:
        import public_tokenizers

        folder = os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))
    exact = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
    special = {t.content: i for i, t in exact.get_added_tokens_decoder().items()}
    with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # The vocabulary's split pattern, a fixed value, without needless backtracking.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:  # its regex gives up on a run of over a million blanks
            return exact.encode(text, add_special_tokens=False).ids

    return encode


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset: no sequence holds more than capacity tokens, offsets have no gaps.

    pieces needs doc_id, piece and length (1 to capacity) and keeps its columns.
    Repeated rows are packed each. An empty table gives an empty result.
    """
    pieces = checkpointed(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    spans: dict[int, list[tuple[int, int, int, tuple[int, ...]]]] = {}
    at, base = Counter(), 0
    for lengths, times in best_two_fit(histogram, capacity):
        offsets = np.r_[0, np.cumsum(lengths)[:-1]]
        for length in sorted(set(lengths)):
            places = tuple(int(o) for o, x in zip(offsets, lengths, strict=True) if x == length)
            spans.setdefault(length, []).append((at[length], base, len(places), places))
            at[length] += times * len(places)
        base += times

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n, rows in length.groupby(length).indices.items():
            own = spans[int(n)]
            r = rank.to_numpy()[rows]
            which = np.searchsorted([s[0] for s in own], r, side="right") - 1
            start, first, width = (np.array([s[k] for s in own])[which] for k in (0, 1, 2))
            sequence[rows] = first + (r - start) // width
            offset[rows] = [own[w][3][x] for w, x in zip(which, (r - start) % width, strict=True)]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    # Rank among pieces of one length: those in partitions of the checkpoint before, and the place in its own. Partitions are bounded whatever ids repeat.
    dealt = pieces.withColumn("part_", F.spark_partition_id())
    sizes = dealt.groupBy("length", "part_").agg(F.count("*").alias("n_"))
    upto = Window.partitionBy("length").orderBy("part_")
    before = sizes.select("length", "part_", (F.sum("n_").over(upto) - F.col("n_")).alias("before_"))
    order = Window.partitionBy("length", "part_").orderBy("doc_id", "piece")
    ranked = dealt.join(before, ["length", "part_"]).withColumn("rank_", F.col("before_") + F.row_number().over(order) - 1)
    placed = ranked.withColumn("place_", place("length", "rank_"))
    return placed.select(*pieces.columns, "place_.sequence_id", "place_.offset")
