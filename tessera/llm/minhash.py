"""Near-duplicate documents by an LSH forest over MinHash signatures.

Each document's set of word shingles is summed up by TREES * DEPTH MinHash
values, dealt to TREES orders of DEPTH values each. An order is sorted by its
values; rows next to each other have a longest common prefix, and the runs of
rows with a common prefix of d values are the forest's nodes at depth d. Rows
that share ROOT values of some order are a region.

The depth adapts to the region. In one of at most BLOCK rows all rows are
candidates of each other, if 4-bit values of their whole signatures agree often
enough (five standard deviations below the threshold). A denser region descends
until its nodes hold at most BLOCK rows; since that separates rows which may be
linked, its rows also stay candidates as a whole, for an exact search.

Candidates travel as pairs of numbers, at most one for each row of a region, and
only the groups that they connect matter: a group's texts are fetched once, and
its links found on full shingle sets by their rarest shingles. (Of two sets that
are similar enough, each has a shingle of the other among its rarest
n - ceil(percent * n) + 1.) A group too large for a task is first cut by the same
rule, as joins: rows that share no rare shingle part. What is still too large is
a real crowd of near copies: the forest's nodes link most of it, and rows outside
its largest component are held against all others in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_LOWER, NO_ID, checkpointed, fixed_bytes, forget, in_tasks, join_hot, packed_id, roots, run_starts, unpacked_id, whole_groups
from tessera.llm.components import connected_components

TREES, DEPTH, ROOT = 16, 8, 3
VALUES = TREES * DEPTH
#: Rows of a node that are all held against each other; rows of a region that one task sorts.
BLOCK, HOT = 256, 8_192
#: Rows, and shingles, of a group of candidates that one task links; rows of either side of a block beyond that.
GROUP, GROUP_SHINGLES, SIDE = 8_192, 4_000_000, 512
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EMPTY = np.zeros(0, np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of `words` words.

    ASCII letters are lower-cased. A text of fewer words is one shingle, its
    whole sequence; a null text or one without words has none.
    """
    found = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []
    n = len(found)
    if not n:
        return _EMPTY
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    k = min(words, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h += each[j : n - k + 1 + j] * _PLACE[j]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return np.unique(h)


def signature(h: np.ndarray) -> np.ndarray:
    """The MinHash values (16 middle bits of each) of a set that isn't empty."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1024):
        part = h[None, i : i + 1024] * _MUL[:, None]
        part += _ADD[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return (low >> np.uint64(28) & np.uint64(0xFFFF)).astype(">u2")


def sketch(s: np.ndarray) -> bytes:
    """Four bits of each value of a signature."""
    bits = (s >> 4 & 15).astype(np.uint8)
    return (bits[::2] << 4 | bits[1::2]).tobytes()


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, mark, text in zip(pdf["id"], pdf["mark"], pdf["text"], strict=True):
                h = shingles(text, words)
                if len(h):
                    s = signature(h)
                    rows.append((i, mark, len(h), xxhash.xxh3_128_digest(h.tobytes()), s.tobytes(), sketch(s)))
                else:
                    rows.append((i, mark, 0, None, None, None))
            yield pd.DataFrame(rows, columns=["id", "mark", "n", "same", "minhash", "sketch"])

    return docs.mapInPandas(each, "id long, mark long, n long, same binary, minhash binary, sketch binary")


def _close(sketches: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, least: int, percent: int) -> np.ndarray:
    """Whether sizes allow a link and `least` values of the sketches agree, for each pair of rows (i, j)."""
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    close = 100 * small >= percent * large
    ok = np.flatnonzero(close)
    for at in range(0, len(ok), 1 << 16):
        part = ok[at : at + (1 << 16)]
        x = sketches[i[part]] ^ sketches[j[part]]
        close[part] = (x & 15 == 0).sum(axis=1) + (x >> 4 == 0).sum(axis=1) >= least
    return close


def _pairs_in_runs(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (earlier, later) index pairs within runs of equal keys, one distance at a time."""
    start = run_starts(keys)
    rows = np.arange(len(keys))
    place = rows - start
    step = 1
    later = rows[place >= 1]
    while len(later):
        yield later - step, later
        step += 1
        later = later[place[later] >= step]


def nodes(part: np.ndarray, key: np.ndarray, block: int) -> np.ndarray:
    """The node of each row of an order (sorted by part, key): of nodes with at most `block` rows the one nearest to the root.

    A node is the run of rows whose longest common prefix with the row before
    reaches its depth; a run that is too large even at full depth is cut.
    """
    rows = np.arange(len(part))
    prefix = np.zeros(len(part), np.int64)  # longest common prefix with the row before
    same = part[1:] == part[:-1]
    prefix[1:][same] = np.logical_and.accumulate(key[1:][same] == key[:-1][same], axis=1).sum(axis=1)
    start = np.full(len(part), -1)
    for depth in range(ROOT, DEPTH + 1):
        first = np.maximum.accumulate(np.where(prefix < depth, rows, 0))
        size = np.bincount(first, minlength=len(part))[first]
        fits = (start < 0) & (size <= block)
        start[fits] = first[fits]
    full = start < 0
    start[full] = first[full] + (rows - first)[full] // block * block
    return start


def _candidates(least: int, percent: int, block: int):
    """(a, b, null): rows that candidates connect; (row, null, node): the nodes of dense regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "part"):
            part, rep, n, g, anchor = (t.column(c).to_numpy() for c in ("part", "rep", "n", "g", "anchor"))
            sketches = fixed_bytes(t.column("sketch"), VALUES // 2)
            node = nodes(part, fixed_bytes(t.column("key"), 2 * DEPTH), block) if len(part) else part
            dense = g > block
            pairs = [(i[hit], j[hit]) for i, j in _pairs_in_runs(np.where(dense, -1 - np.arange(len(node)), node)) if (hit := _close(sketches, n, i, j, least, percent)).any()]
            i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*pairs, strict=True)) if pairs else (node[:0], node[:0])
            root = roots(len(rep), i, j)
            near, crowd = np.flatnonzero(root != np.arange(len(rep))), np.flatnonzero(dense)
            own = part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (node - run_starts(part)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            a = np.r_[rep[root[near]], anchor[crowd], rep[crowd]]
            b = np.r_[rep[near], rep[crowd], rep[crowd]]
            which = np.r_[np.zeros(len(near) + len(crowd), np.int64), own.astype(np.int64)[crowd]]
            told = np.r_[np.zeros(len(near) + len(crowd), bool), np.ones(len(crowd), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=told), pa.array(which, mask=~told)], ["a", "b", "node"])

    return run


def links_within(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of places in `sets` (sorted hashes, none empty) that link all that is linked: a spanning forest.

    Each set is looked up by its rarest shingles among those not yet reached.
    """
    n = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, value, times = np.unique(flat, return_inverse=True, return_counts=True)
    del flat
    edge = np.r_[0, np.cumsum(n)]
    order = np.lexsort((value, times[value], owner))
    rare = np.arange(len(value)) - edge[owner] < (n - -(-percent * n // 100) + 1)[owner]
    listed, holder = value[order][rare], owner[rare]
    probes = [listed[a:b] for a, b in zip(*(np.searchsorted(holder, np.arange(len(n)) + k) for k in (0, 1)), strict=True)]
    by = np.argsort(listed, kind="stable")
    listed, holder = listed[by], holder[by]
    seen, met, out, reached = np.zeros(len(n), bool), np.zeros(len(times), bool), [], 0
    for start in range(len(n)):
        if seen[start]:
            continue
        seen[start] = True
        todo = [start]
        while todo:
            i = todo.pop()
            reached += 1
            if reached * 2 > len(n) - reached and reached % 64 == 0:
                left = ~seen[holder]
                listed, holder = listed[left], holder[left]
            lo, hi = np.searchsorted(listed, probes[i], "left"), np.searchsorted(listed, probes[i], "right")
            size = hi - lo
            at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            found = np.unique(holder[at])
            found = found[~seen[found] & (100 * np.minimum(n[i], n[found]) >= percent * np.maximum(n[i], n[found]))]
            if not len(found):
                continue
            met[value[edge[i] : edge[i + 1]]] = True
            both = np.array([np.count_nonzero(met[value[edge[k] : edge[k + 1]]]) for k in found])
            met[value[edge[i] : edge[i + 1]]] = False
            new = found[100 * both >= percent * (n[i] + n[found] - both)]
            seen[new] = True
            out += [(i, int(k)) for k in new]
            todo += new.tolist()
    return out


def _linked(rows: DataFrame, key: str, words: int, percent: int) -> DataFrame:
    """(a, b): links that span what is linked in each group of rows (key, rep, text); groups have a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, key, 500):
            group, rep = t.column(key).to_numpy(), t.column("rep").to_numpy()
            first = np.flatnonzero(run_starts(group) == np.arange(len(group)))
            out = []
            for lo, hi in zip(first, [*first[1:], len(group)], strict=True):
                if hi - lo > 1:
                    sets = [shingles(x, words) for x in t.column("text").slice(lo, hi - lo).to_pylist()]
                    out += [(rep[lo + i], rep[lo + j]) for i, j in links_within(sets, percent)]
            a, b = np.array(out, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.select(key, "rep", "text").repartition(key).sortWithinPartitions(key, "rep").mapInArrow(run, "a long, b long")


def _parted(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(rep, comp): members (comp, rep) that share a rare shingle, directly or not; those that share none are gone."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [shingles(t, words) for t in pdf["text"]]
            yield pd.DataFrame({"comp": pdf["comp"], "rep": pdf["rep"], "n": [len(f) for f in found], "all": [f.view(np.int64) for f in found]})

    rows = members.select("comp", "rep").join(texts, "rep").select("comp", "rep", "text").mapInPandas(explode, "comp long, rep long, n long, all array<long>")
    each = checkpointed(rows.select("comp", "rep", "n", F.explode("all").alias("s")))
    often = each.groupBy("comp", "s").agg(F.count("*").alias("c")).filter("c > 1")
    own = each.join(often, ["comp", "s"]).groupBy("comp", "rep", "n").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("own"))  # of one document
    # Shingles that no other row has come first among the rarest.
    open_ = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("own"))
    rare = checkpointed(own.withColumn("open", open_.cast("int")).filter("open > 0").select("comp", "rep", F.explode(F.slice("own", F.lit(1), F.col("open"))).alias("x")).select("comp", "rep", "x.s"))
    least = rare.groupBy("comp", "s").agg(F.min("rep").alias("a"))
    found = connected_components(rare.join(least, ["comp", "s"]).select("a", F.col("rep").alias("b")))
    forget(each)
    return found.select(F.col("node").alias("rep"), F.col("component").alias("comp"))


def _crowds(members: DataFrame, crowd: DataFrame, texts: DataFrame, words: int, percent: int, side: int) -> DataFrame:
    """(a, b): links of groups (comp, rep) too large for a task: within the forest's nodes, then of what is still apart."""
    rows = members.select("rep", F.col("comp").alias("whole")).join(texts, "rep")
    first = checkpointed(_linked(crowd.join(rows, "rep").withColumn("key", F.xxhash64("node", "whole")), "key", words, percent))
    part = connected_components(first).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    placed = checkpointed(members.select("rep", F.col("comp").alias("whole")).join(part, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")))
    sizes = placed.groupBy("whole", "comp").agg(F.count("*").alias("c")).groupBy("whole").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"))
    apart = placed.join(sizes.select("whole", F.col("top.comp").alias("main"), "all", (F.col("all") - F.col("top.c")).alias("rest")).filter("rest > 0"), "whole")
    chunks, shelves = F.ceil(F.col("rest") / side).cast("int"), F.ceil(F.col("all") / side).cast("int")
    chunk, shelf = F.pmod(F.xxhash64(F.lit(1), "rep"), chunks).cast("int"), F.pmod(F.xxhash64(F.lit(2), "rep"), shelves).cast("int")
    probes = apart.filter("comp <> main").withColumn("chunk", chunk).withColumn("shelf", F.explode(F.sequence(F.lit(0), shelves - 1)))
    stock = apart.withColumn("shelf", shelf).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    sides = probes.withColumn("probe", F.lit(True)).unionByName(stock.withColumn("probe", F.lit(False)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["probe", "rep"], ascending=[False, True]).drop_duplicates("rep")
        ids, sets = pdf["rep"].to_numpy(), [shingles(t, words) for t in pdf["text"]]
        n = np.array([len(s) for s in sets])
        _, root = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(ids)), n)[order]
        out = []
        for i in np.flatnonzero(pdf["probe"].to_numpy()):
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            size = hi - lo
            at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            both = np.bincount(owner[at], minlength=len(ids))
            for j in np.flatnonzero((100 * both >= percent * (n[i] + n - both)) & (root != root[i])):
                if root[i] != root[j]:
                    root[root == root[j]] = root[i]
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    sides = sides.select(F.xxhash64("whole", "chunk", "shelf").alias("key"), "rep", "comp", "probe").join(texts, "rep")
    return first.unionByName(sides.groupBy("key").applyInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their
    sets of shingles; component_id is the smallest id that links reach, kept
    marks that document. Documents without words (null or blank texts) have an
    empty set and are linked with nothing. Rows that repeat an id share its
    component, which the links of all their texts make up. A row whose id is null
    is linked with nothing, has a null component_id and is kept. An empty table
    gives an empty result; other columns of docs are ignored.
    """
    agree = percent / 100 + (1 - percent / 100) / 16
    least = int(VALUES * (agree - 5 * (agree * (1 - agree) / VALUES) ** 0.5))
    own = docs.select(packed_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("mark", F.xxhash64("text"))  # tells the texts of one id apart
    signed = checkpointed(_signatures(own, words))
    usable = signed.filter((F.col("n") > 0) & (F.col("id") != NO_ID))
    # Equal sets are one vertex; one id may have several.
    same = usable.groupBy("same").agg(F.min(F.struct("id", "mark")).alias("first"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "minhash", "sketch")])
    vertex = checkpointed(same.select("same", "first.*", "copies", "n", "minhash", "sketch", F.monotonically_increasing_id().alias("rep")))

    # The forest: regions of an order, dealt whole unless one task shouldn't sort them.
    orders = F.array(*[F.substring("minhash", t * DEPTH * 2 + 1, DEPTH * 2) for t in range(TREES)])
    keyed = vertex.select("rep", F.posexplode(orders).alias("tree", "key")).withColumn("root", F.xxhash64("tree", F.substring("key", 1, 2 * ROOT)))
    regions = keyed.groupBy("root").agg(F.count("*").alias("g"), F.min("rep").alias("anchor")).filter("g > 1")
    part = F.xxhash64("root", F.pmod(F.xxhash64("rep"), F.ceil(F.col("g") / HOT)))
    forest = keyed.join(regions, "root").join(vertex.select("rep", "n", "sketch"), "rep").select(part.alias("part"), "key", "rep", "n", "g", "anchor", "sketch")
    found = forest.repartition("part").sortWithinPartitions("part", "key", "rep").mapInArrow(_candidates(least, percent, BLOCK), "a long, b long, node long")
    found = checkpointed(found)

    # Groups of candidates, and their links on full sets.
    group = connected_components(found.filter("node is null").select("a", "b")).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    need = checkpointed(group.join(vertex.select("rep", "id", "mark", "n"), "rep"))
    texts = checkpointed(own.join(need.select("id", "mark", "rep"), ["id", "mark"]).dropDuplicates(["id", "mark"]).select("rep", "text"))
    fits = (F.col("rows") <= GROUP) & (F.col("shingles") <= GROUP_SHINGLES)

    def by_size(members: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The members of groups that one task links, and those of larger groups, if there are any."""
        crowded = checkpointed(members.groupBy("comp").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).filter(~fits).select("comp"))
        if crowded.isEmpty():
            return members, None
        return members.join(crowded, "comp", "left_anti"), members.join(crowded, "comp", "left_semi")

    small, large = by_size(need)
    links = _linked(small.select("comp", "rep").join(texts, "rep"), "comp", words, percent)
    if large is not None:
        finer = checkpointed(_parted(large, texts, words, percent).join(need.select("rep", "n"), "rep"))
        small, large = by_size(finer)
        links = links.unionByName(_linked(small.select("comp", "rep").join(texts, "rep"), "comp", words, percent))
        if large is not None:
            crowd = found.filter("node is not null").select(F.col("a").alias("rep"), "node")
            links = links.unionByName(_crowds(large.select("comp", "rep"), crowd, texts, words, percent, SIDE))
    # The vertices of one id are one component.
    several = checkpointed(usable.groupBy("id").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).filter("lo < hi").select("id"))
    if not several.isEmpty():
        members = usable.join(several, "id", "left_semi").select("id", "same").distinct().join(vertex.select("same", "rep"), "same")
        links = links.unionByName(members.join(members.groupBy("id").agg(F.min("rep").alias("a")), "id").select("a", F.col("rep").alias("b")))
    final = connected_components(links)
    forget(found, texts, need)

    # A component's name is its smallest id; vertices of one row, linked with nothing, need none.
    vertices = vertex.select("rep", "same", "id", "copies").join(final.withColumnRenamed("node", "rep"), "rep", "left").filter("copies > 1 or component is not null")
    vertices = vertices.withColumn("component", F.coalesce("component", "rep"))
    names = checkpointed(vertices.join(vertices.groupBy("component").agg(F.min("id").alias("name")), "component").select("same", "copies", "name"))
    (seen,) = names.agg(F.count("*").alias("rows"), F.max("copies").alias("most")).collect()
    total = signed.count()
    named = join_hot(usable.select("id", "same"), in_tasks(names, seen["rows"]), "same", "copies", total, seen["most"])
    by_id = in_tasks(named.groupBy("id").agg(F.min("name").alias("name")), total)
    rows = signed.select("id", "n").filter(F.col("id") != NO_ID).join(by_id, "id", "left").withColumn("name", F.coalesce("name", "id"))
    rows = rows.unionByName(signed.filter(F.col("id") == NO_ID).select("id", "n", F.lit(None).cast("long").alias("name")))
    return rows.select(
        unpacked_id("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("name").alias("component_id"),
        F.coalesce(F.col("name") == F.col("id"), F.lit(True)).alias("kept"),
    )
