"""Nearest neighbours by incremental search in a stable low-dimensional projection.

Vectors are projected on DIMS Gaussian directions, made orthonormal. For a vector
at true distance s, projected squared distance / s^2 (scaled by the dimensions)
has at most the spread of a chi-square distribution with DIMS degrees of freedom.
Neighbours are taken one after another in order of projected distance, a kd-tree
giving the next ones, and verified on the original vectors; the search stops once
the next projected distance belongs to something nearer than the current k-th
with a chance below 1 - CONFIDENCE only.

A coarse kd-tree, fitted on a bounded sample, cuts the projected space into
cells; every row is indexed in its cell, a full cell in several parts. A query
searches its own cell first, which bounds its k-th distance, and then only those
cells that the same test can't rule out. Cells and parts have local kd-trees.
Where many queries come to a cell, they are answered in several tasks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.capfilter import valid_vector
from tessera.llm.common import checkpointed

DIMS, CONFIDENCE = 24, 0.95
#: Rows that the coarse tree is fitted on at most, rows meant for one cell, rows of a part, rows of a leaf of the local trees, queries that one task answers about, and neighbours verified between two tests.
SAMPLE, CELL, PART, LEAF, QUERIES, STEP = 20_000, 8_192, 32_768, 256, 32_768, 64


def chi_square_cdf(x: np.ndarray, half_dims: int) -> np.ndarray:
    """P(chi-square with 2 * half_dims degrees of freedom <= x), in closed form for an even number."""
    y = np.asarray(x, float) / 2
    term, total = np.ones_like(y), np.ones_like(y)
    for i in range(1, half_dims):
        term = term * y / i
        total = total + term
    return 1 - np.exp(-np.minimum(y, 700)) * total


def stop_ratio(confidence: float = CONFIDENCE) -> float:
    """The least projected squared distance, in units of the k-th squared distance, at which a search stops."""
    lo, hi = 0.0, 1000.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(np.array(mid), DIMS // 2) < confidence else (lo, mid)
    return hi


def projection(dim: int, seed: int = 11) -> np.ndarray:
    """DIMS orthonormal directions of Gaussian origin, scaled so that squared lengths keep their mean times DIMS.

    Vectors of fewer dimensions count as filled up with zeros, and keep their distances.
    """
    size = max(dim, DIMS)
    return np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((size, size)))[0][:dim, :DIMS] * math.sqrt(size)


class Tree:
    """A balanced kd-tree as arrays: node i has children 2i + 1 and 2i + 2, the last level are leaves."""

    def __init__(self, points: np.ndarray, levels: int):
        self.levels, self.first_leaf = levels, (1 << levels) - 1
        self.axis, self.cut = np.zeros(self.first_leaf, np.int64), np.zeros(self.first_leaf)
        held = {0: points}
        for node in range(self.first_leaf):
            own = held.pop(node)
            if len(own):
                self.axis[node] = int(np.ptp(own, axis=0).argmax())
                self.cut[node] = np.median(own[:, self.axis[node]])
            right = own[:, self.axis[node]] > self.cut[node]
            held[2 * node + 1], held[2 * node + 2] = own[~right], own[right]

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - self.first_leaf

    def leaves(self, q: np.ndarray, within=lambda: math.inf) -> Iterator[tuple[float, int]]:
        """(least squared distance, leaf) in ascending order, as far as within() allows at that moment."""
        heap: list[tuple[float, int, tuple[float, ...]]] = [(0.0, 0, (0.0,) * len(q))]
        while heap:
            far, node, off = heapq.heappop(heap)
            if far > within():
                return
            if node >= self.first_leaf:
                yield far, node - self.first_leaf
                continue
            axis = int(self.axis[node])
            gap = float(q[axis] - self.cut[node])
            near = 2 * node + 1 + (gap > 0)
            heapq.heappush(heap, (far, near, off))
            there = far - off[axis] + gap * gap
            heapq.heappush(heap, (there, 4 * node + 3 - near, (*off[:axis], gap * gap, *off[axis + 1 :])))


class Index:
    """Rows of one cell or part: ids, vectors, their projections and a kd-tree over these."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.r = ids, x, projection(x.shape[1])
        flat = x @ self.r
        self.tree = Tree(flat, max(0, math.ceil(math.log2(max(1, len(x)) / LEAF))))
        leaf = self.tree.leaf_of(flat)
        self.order = np.argsort(leaf, kind="stable")
        self.edges = np.searchsorted(leaf[self.order], np.arange((1 << self.tree.levels) + 1))
        self.flat = flat[self.order]

    def neighbours(self, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(projected squared distances, rows) in ascending order, STEP at a time, for a projected query.

        What is nearer than the next leaf is settled; the rest waits for it.
        """
        waiting_d, waiting = np.zeros(0), np.zeros(0, np.int64)
        leaves = self.tree.leaves(p)
        following = next(leaves, None)
        while following is not None or len(waiting):
            while following is not None and not (len(waiting) and np.count_nonzero(waiting_d <= following[0]) >= STEP):
                at = slice(self.edges[following[1]], self.edges[following[1] + 1])
                waiting_d = np.r_[waiting_d, ((self.flat[at] - p) ** 2).sum(axis=1)]
                waiting = np.r_[waiting, self.order[at]]
                following = next(leaves, None)
            settled = math.inf if following is None else following[0]
            first = np.argpartition(waiting_d, STEP - 1)[:STEP] if len(waiting) > STEP else np.arange(len(waiting))
            first = first[np.argsort(waiting_d[first], kind="stable")]
            first = first[waiting_d[first] <= settled]
            yield waiting_d[first], waiting[first]
            waiting_d, waiting = np.delete(waiting_d, first), np.delete(waiting, first)

    def search(self, qid: int, q: np.ndarray, bound: float, k: int, ratio: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, squared distances) of the up to k nearest rows found within bound, and how many rows were verified."""
        best_d, best_i, kth, verified = np.zeros(0), np.zeros(0, np.int64), bound, 0
        for projected, rows in self.neighbours(q @ self.r):
            going = projected <= kth * ratio
            rows = rows[going]
            rows = rows[self.ids[rows] != qid]
            d = ((self.x[rows] - q) ** 2).sum(axis=1)
            verified += len(rows)
            near = d <= kth
            best_d, best_i = np.r_[best_d, d[near]], np.r_[best_i, self.ids[rows[near]]]
            if len(best_d) > k:
                top = np.lexsort((best_i, best_d))[:k]
                best_d, best_i = best_d[top], best_i[top]
            if len(best_d) == k:
                kth = min(kth, float(best_d.max()))
            if not going.all():
                break
        return best_i, best_d, verified


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score for the k nearest other rows found for each row that is_query (a Column) selects.

    Nearness is the Euclidean distance in double precision; ties go to the
    smaller id. Queries with fewer than k other rows get all of them. Vectors
    that are null, empty, zero or hold null or non-finite components take no
    part, nor do rows with a null id; a query meets vectors of its own length
    only. Rows that repeat an id are candidates each, and no query meets a row
    with its own id; an id that repeats asks once, with its least vector. Other
    columns are ignored. Tables without queries or candidates give an empty
    result.
    """
    return _searched(vectors, is_query, k, id_col, vector_col)[0]


def verified(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, verified: how many vectors were held against each query of nearest()."""
    return _searched(vectors, is_query, k, id_col, vector_col)[1]


def _searched(vectors: DataFrame, is_query, k: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & valid_vector("x")).withColumn("dim", F.size("x"))
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    trees: dict[int, Tree] = {}
    for dim, n in counts.items():
        sample = rows.filter(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").toPandas()["x"]
        levels = max(0, min(math.ceil(math.log2(n / CELL)), int(math.log2(max(1, len(sample) / 16)))))
        trees[dim] = Tree(np.stack(sample.to_numpy()) @ projection(dim), levels)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = np.zeros(len(pdf), np.int64)
            for dim, at in pdf.groupby("dim").indices.items():
                cell[at] = trees[dim].leaf_of(np.stack(pdf["x"].iloc[at].to_numpy()) @ projection(int(dim)))
            yield pdf.assign(cell=cell)

    indexed = checkpointed(rows.mapInPandas(place, "id long, x array<double>, asks boolean, dim int, cell long"))
    parts = {(r["dim"], r["cell"]): -(-r["n"] // PART) for r in indexed.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}
    if not parts:
        none = indexed.limit(0)
        return none.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score")), none.select(F.col("id").alias("query_id"), F.col("id").alias("verified"))

    def per_cell(numbers: dict[tuple[int, int], int]) -> Column:
        """The number of a row's cell, null for a cell without one; cells are bounded by the coarse tree."""
        known = F.create_map(*[F.lit(v) for (d, c), n in numbers.items() for v in (f"{d}:{c}", n)])
        return known[F.concat_ws(":", "dim", "cell")].cast("int")

    spread = per_cell(parts)
    stock = indexed.select("dim", "cell", F.pmod(F.xxhash64("id"), spread).cast("int").alias("part"), "id", "x")
    asked = indexed.filter("asks").groupBy("id").agg(F.min(F.struct("x", "dim", "cell")).alias("q")).select("id", "q.*", F.lit(float("inf")).alias("bound"))

    ratio = stop_ratio()

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Rows found, and for each query a row without an id whose d is the number of rows verified."""
        q, i, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(left) and len(right):
            index = Index(right["id"].to_numpy(), np.stack(right["x"].to_numpy()))
            for qid, x, bound in zip(left["id"], left["x"], left["bound"], strict=True):
                got, far, n = index.search(qid, x, bound, k, ratio)
                q.append(np.full(len(got) + 1, qid))
                i.append(np.r_[got, -1])
                d.append(np.r_[far, n])
        pdf = pd.DataFrame({"q": np.concatenate(q), "id": np.concatenate(i), "d": np.concatenate(d)})
        told = np.cumsum([len(x) for x in i]) - 1
        pdf["counts"] = np.isin(np.arange(len(pdf)), told[1:])
        return pdf

    def searched(routed: DataFrame) -> DataFrame:
        asks = {(r["dim"], r["cell"]): -(-r["n"] // QUERIES) for r in routed.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}
        if not asks:
            return stock.select(F.col("id").alias("q"), "id", F.lit(0.0).alias("d"), F.lit(False).alias("counts")).limit(0)
        chunks = per_cell(asks)
        left = routed.withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "id"), chunks).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), spread - 1)))
        right = stock.filter(chunks.isNotNull()).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        keys = ["dim", "cell", "part", "chunk"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(look, "q long, id long, d double, counts boolean")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, x, dim, cell, bound in pdf.itertuples(index=False):
                for _, at in trees[dim].leaves(x @ projection(dim), lambda: bound * ratio):  # noqa: B023
                    if at != cell and (dim, at) in parts:
                        out.append((i, x, dim, at, bound))
            yield pd.DataFrame(out, columns=["id", "x", "dim", "cell", "bound"])

    home = checkpointed(searched(asked))
    best = Window.partitionBy("q").orderBy("d", "id")
    kth = home.filter("not counts").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("q").alias("id"), F.col("d").alias("kth"))
    rest = asked.join(kth, "id", "left").select("id", "x", "dim", "cell", F.coalesce("kth", "bound").alias("bound"))
    away = searched(checkpointed(rest.mapInPandas(route, "id long, x array<double>, dim int, cell long, bound double")))
    both = home.unionByName(away)
    top = both.filter("not counts").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    held = both.filter("counts").groupBy(F.col("q").alias("query_id")).agg(F.sum("d").cast("long").alias("verified"))
    return top.select(F.col("q").alias("query_id"), "rank", F.col("id").alias(id_col), F.sqrt("d").alias("score")), held
