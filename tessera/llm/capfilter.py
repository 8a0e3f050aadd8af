"""Near-duplicate vectors by spherical-cap filters from random product codes.

A filter is a direction u = (u1, u2): one of c code words for each half of the
(rotated) space, so c * c directions come from 2 * c random vectors. A vector
belongs to every filter with <x, u> >= alpha. List-decoding finds those without
trying all: for each first word that the best second word could lift to alpha,
the second words that reach the rest are a prefix of the sorted second products. Vectors within the angle of interest
share a filter with high probability; vectors of one filter are compared
exactly, in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, join_hot
from tessera.llm.components import connected_components

#: Filters of a vector on average, and at least; a pair at cosine 0.98 misses all common ones with a chance of about e^(-0.6 * FILTERS).
FILTERS = 20
#: Rows that one filter should hold of a group of unrelated vectors, and rows of one block of a fuller filter.
FILL, BLOCK = 64, 1024


class ProductCode:
    """The c * c filter directions of `dim` dimensions, made from a seed alone."""

    def __init__(self, dim: int, words: int, alpha: float, seed: int = 7):
        rng = np.random.default_rng([seed, dim, words])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.half, self.words, self.alpha = dim // 2 or 1, words, alpha
        sizes = (self.half, dim - self.half)
        self.codes = [_unit(rng.standard_normal((words, s))) * np.sqrt(s / dim) if s else np.zeros((words, 0)) for s in sizes]

    def decode(self, unit: np.ndarray, least: int = FILTERS) -> list[np.ndarray]:
        """For each row (a unit vector), the ascending ids of all filters that it exceeds by alpha, and of its `least` best ones in any case.

        The n-th best sum of two sorted lists is among the pairs of places (i, j) with (i + 1)(j + 1) <= n.
        """
        turned = unit @ self.rotation
        first, second = turned[:, : self.half] @ self.codes[0].T, turned[:, self.half :] @ self.codes[1].T
        order = np.argsort(-second, axis=1, kind="stable")
        least = min(least, self.words**2)
        a, b = np.array([(i, j) for i in range(min(least, self.words)) for j in range(min(least // (i + 1), self.words))]).T
        best = -np.sort(-first, axis=1)[:, a] + np.take_along_axis(second, order, axis=1)[:, b]
        cut = np.minimum(self.alpha, -np.partition(-best, least - 1, axis=1)[:, least - 1]) - 1e-12
        out = []
        for p, q, o, c in zip(first, second, order, cut, strict=True):
            able = np.flatnonzero(p >= c - q[o[0]])
            reach = np.searchsorted(-q[o], p[able] - c, side="right")
            place = np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach)
            out.append(np.sort(np.repeat(able * self.words, reach) + o[place]))
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid_vector(col: str):
    """True for a vector that isn't null, empty or zero and holds finite numbers only."""
    fine = F.forall(F.col(col), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(F.col(col).isNotNull() & fine & F.exists(F.col(col), lambda x: x != 0), F.lit(False))


def _narrow(df: DataFrame, col: str):
    """The vectors as they are if their components are floats, else as doubles; sums are always in doubles."""
    return F.col(col) if dict(df.dtypes)[col] == "array<float>" else F.col(col).cast("array<double>")


def vector_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Vectors are compared within equal labels that aren't null; a pair is linked
    if its cosine in double precision is at least `cosine`. n_links counts the
    other vectors linked directly, component_id is the smallest id reachable,
    kept marks that vector. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of different
    lengths. Equal vectors are decoded once and count as links of each other. A
    row whose id is null links with nothing and has a null component_id. Rows
    that repeat an id are judged each by its own vector, and their id joins
    nothing; a repeated vector counts as often as it occurs. Other columns are
    ignored. Empty tables give empty results.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), _narrow(vectors, vector_col).alias("x"), F.col(label_col).alias("label"))
    usable = valid_vector("x") & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = rows.withColumn("label", F.when(usable, F.col("label"))).withColumn("same", F.when(usable, F.struct("label", "x")))
    same = rows.filter("same is not null").groupBy("same").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    groups = checkpointed(same.select("id", "copies", "same", "same.*", F.size("same.x").alias("dim"), F.monotonically_increasing_id().alias("rep")))
    counts = groups.groupBy("label", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()
    codes: dict[int, tuple[int, float]] = {}
    for r in counts:  # a row per vector length
        p = min(0.02, FILL / r["n"])
        codes[r["dim"]] = (int(np.ceil((FILTERS / p) ** 0.5)), NormalDist().inv_cdf(1 - p) / r["dim"] ** 0.5)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, ProductCode] = {}
        for pdf in batches:
            lists: list = [None] * len(pdf)
            for dim, at in pdf.groupby("dim").indices.items():
                if dim not in made:
                    made[dim] = ProductCode(int(dim), *codes[int(dim)])
                for k in range(0, len(at), 512):
                    part = at[k : k + 512]
                    for i, ids in zip(part, made[dim].decode(_unit(np.stack(pdf["x"].iloc[part].to_numpy()).astype(float))), strict=True):
                        lists[i] = ids
            yield pdf[["rep"]].assign(filters=lists)

    kind = "int" if all(c * c < 1 << 31 for c, _ in codes.values()) else "long"
    decoded = checkpointed(groups.select("rep", "dim", "x").mapInPandas(decode, f"rep long, filters array<{kind}>"))
    dealt = decoded.join(groups, "rep").withColumn("filter", F.explode("filters")).withColumn("bucket", F.xxhash64("label", "dim", "filter"))
    fill = dealt.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    dealt = dealt.join(fill, "bucket")
    # A full filter is cut into parts; each pair of parts is a block of its own.
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "filter", "filters", "rep", "copies", "x")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, copies, part = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), pdf["part"].to_numpy()
        x = _unit(np.stack(pdf["x"].to_numpy()).astype(float))
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        linked[part[:, None] == part[None, :]] &= len(set(part)) == 1
        if not linked.any():
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        # A pair counts in the first of its common filters only.
        here = pdf["filter"].iloc[0]
        lower = [f[: np.searchsorted(f, here)] for f in pdf["filters"]]
        _, column = np.unique(np.concatenate(lower), return_inverse=True)
        if len(column):
            has = np.zeros((len(rep), column.max() + 1), np.float32)
            has[np.repeat(np.arange(len(rep)), [len(f) for f in lower]), column] = 1
            linked &= has @ has.T == 0
        n = linked @ copies
        a, b = _spanning(linked)
        own = np.flatnonzero(n)
        return pd.DataFrame({"a": np.r_[rep[own], rep[a]], "b": np.r_[np.full(len(own), -1), rep[b]], "n": np.r_[n[own], np.zeros(len(a), np.int64)]})

    # Rows of two kinds: (vector, -1, links that it gained) and (vector, vector, 0), a link needed to span its block.
    found = checkpointed(dealt.groupBy("bucket", "lo", "hi").applyInPandas(compare, "a long, b long, n long"))
    links = found.filter("n > 0").groupBy("a").agg(F.sum("n").alias("far"))
    comp = connected_components(found.filter("n = 0").select("a", "b"))
    named = groups.join(links, groups["rep"] == links["a"], "left").join(comp, groups["rep"] == comp["node"], "left")
    named = named.select("same", "id", "copies", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("comp"))
    least = named.groupBy("comp").agg(F.min("id").alias("component"))
    told = checkpointed(named.join(least, "comp").select("same", "copies", "n_links", "component"))
    linked = join_hot(rows.filter("same is not null").select("id", "same"), told, "same", "copies", rows.count()).select("id", "n_links", "component")
    alone = rows.filter("same is null").select("id", F.lit(0).alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col),
        F.col("n_links").cast("long").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"),
    )


def _spanning(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join the same rows as all links do, one for each row but one of a component."""
    a: list[int] = []
    b: list[int] = []
    new = linked.any(axis=1)
    for root in np.flatnonzero(new):
        if not new[root]:
            continue
        new[root] = False
        todo = [int(root)]
        while todo:
            at = todo.pop()
            got = np.flatnonzero(linked[at] & new)
            new[got] = False
            a += [at] * len(got)
            b += got.tolist()
            todo += got.tolist()
    return a, b
