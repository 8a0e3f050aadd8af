"""Near duplicates and neighbours against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, capfilter, components, minhash

DOCS = "doc_id long, text string, kept string"


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def sets_of(text, k):
    ws = (text or "").lower().split()
    if not ws:
        return set()
    return {tuple(ws)} if len(ws) < k else {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}


def closure(ids, links):
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return comp


def brute(rows, k):
    s = {i: sets_of(t, k) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(s, 2) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    return {i: len(v) for i, v in s.items()}, closure(s, links)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = []
    for group in range(12):
        base = words(rng, rng.choice([3, 40, 120, 300]))
        rows += [" ".join(base)] * 2
        rows += [" ".join(edited(rng, base, rng.randrange(1, 3 + len(base) // 40))) for _ in range(12)]
    rows += [" ".join(words(rng, 60)) for _ in range(60)]
    passage = " ".join(words(rng, 60))
    rows += [passage + " " + " ".join(words(rng, rng.randrange(5, 60))) for _ in range(40)]
    rows += [None, "", "   \t\n", "one", "ONE", "one two", " ".join(words(rng, 30000))]
    rng.shuffle(rows)
    return list(enumerate(rows))


def limits(monkeypatch, block, group):
    """Nodes of `block` rows, regions dealt by 4 * block, groups of at most `group` rows in a task."""
    for name, value in (("BLOCK", block), ("HOT", 4 * block), ("GROUP", group), ("SIDE", 2 * block)):
        monkeypatch.setattr(minhash, name, value)


@pytest.mark.parametrize(("block", "group"), [(256, 8192), (8, 8192), (4, 6), (256, 1)])
def test_near_duplicates_are_those_of_brute_force(spark, corpus, monkeypatch, block, group):
    """With tiny limits every region is dense and every group too large for a task."""
    limits(monkeypatch, block, group)
    df = spark.createDataFrame([(i, t, "x") for i, t in corpus], DOCS).repartition(5)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, words=4).collect()}
    sizes, comp = brute(corpus, 4)
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert {i: r["component_id"] for i, r in got.items()} == comp
    assert all(r["kept"] == (i == comp[i]) for i, r in got.items())


def test_near_duplicates_of_a_star(spark):
    """Copies that are linked with their base only, in a region larger than a block."""
    rng = random.Random(9)
    base = words(rng, 400)
    rows = [(i, " ".join(edited(rng, base, 11))) for i in range(300)] + [(900, " ".join(base))]
    _, comp = brute(rows, 5)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == comp


def test_near_duplicates_edge_cases(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, None)]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [("1", 2, "1", True), ("1", 2, "1", True), ("2", 2, "1", False), ("3", 0, "3", True), ("None", 2, "None", True)]


@pytest.mark.parametrize(("block", "group"), [(256, 8192), (2, 2)])
def test_near_duplicates_of_ids_with_several_texts(spark, monkeypatch, block, group):
    """Every text of an id is linked, in whatever order the rows come."""
    limits(monkeypatch, block, group)
    rng = random.Random(11)
    a, b, c = (words(rng, 200) for _ in range(3))
    near = lambda base: " ".join(edited(rng, base, 2))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(b)), (3, near(a)), (4, " ".join(c)), (5, near(c)), (5, " ".join(a)), (6, " ".join(words(rng, 200))), (9, near(c)), (9, None), (8, None), (8, None)]
    want = {i: 1 for i in (1, 2, 3, 4, 5, 9)} | {6: 6, 8: 8}
    for order in (rows, rows[::-1]):
        got = minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert len(got) == len(rows) and {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(i, j, i == j) for i, j in want.items()}


def test_components_of_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3), (300, 299), (300, 299)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(50)} | {299: 299, 300: 299}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_take_as_many_tasks_as_their_rows_ask_for(spark):
    # The driver's memory follows the number of tasks: with 64 partitions these rounds once had 11,227.
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(1500)] + [(1699, 5000)]
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    sc, group = spark.sparkContext, "components-in-few-tasks"
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sc.setJobGroup(group, group)
        got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(41)} | {100: 100, 5000: 100} | {200 + i: 100 for i in range(1500)}
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := sc.statusTracker().getStageInfo(s)))
    assert tasks < 4_000


def vectors(rng, n, dim=16):
    x = rng.standard_normal((n, dim))
    for i in range(0, n // 2, 5):
        x[i + 1 : i + 4] = x[i] + rng.standard_normal((3, dim)) * rng.choice([0, 0.02, 0.12, 0.2])
    return x


ODD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [float("inf")] + [1.0] * 15, 1), (9005, [None] * 16, 1), (9006, [], 1), (9100, None, None)]


@pytest.mark.parametrize("block", [1024, 7])
def test_vector_links_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(capfilter, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = vectors(rng, 400)
    label = [None if i % 50 == 0 else i // 5 % 3 for i in range(400)]
    rows = [(i, [float(v) for v in x[i]], label[i]) for i in range(400)]
    got = {r["vec_id"]: r for r in capfilter.vector_duplicates(spark.createDataFrame(rows + ODD, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    links = [(i, j) for i, j in itertools.combinations(range(400), 2) if near[i, j] and label[i] is not None and label[i] == label[j]]
    n = np.bincount(np.array(links).ravel(), minlength=400)
    comp = closure(range(400), links)
    assert len(links) > 50
    assert [got[i]["n_links"] for i in range(400)] == n.tolist()
    assert {i: got[i]["component_id"] for i in range(400)} == comp
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, _, _ in ODD)


def test_vectors_of_repeated_ids_and_labels(spark):
    """Two unrelated vectors of one id: each has the links of its own vector, and what these reach stays apart."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = lambda x: [v + 0.01 for v in x]
    rows = [(1, a, 1, 0), (1, b, 1, 0), (2, near(a), 1, 0), (3, near(b), 1, 0), (4, a, 2, 0), (5, a, 2, 0), (5, a, 2, 0), (None, a, 1, 0)]
    for order in (rows, rows[::-1]):
        got = capfilter.vector_duplicates(spark.createDataFrame(order, "vec_id long, embedding array<double>, label int, kept int")).collect()
        told = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in got)
        assert told == [(0, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 2, 4, True), (5, 2, 4, False), (5, 2, 4, False)]


def test_list_decoding_against_all_filters():
    rng = np.random.default_rng(8)
    code = capfilter.ProductCode(12, 30, 0.55)
    x = rng.standard_normal((40, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned = x @ code.rotation
    every = (turned[:, :6] @ code.codes[0].T)[:, :, None] + (turned[:, 6:] @ code.codes[1].T)[:, None, :]
    for got, all_ in zip(code.decode(x, 5), every.reshape(40, -1), strict=True):
        cut = min(0.55, np.sort(all_)[-5])
        assert got.tolist() == np.flatnonzero(all_ >= cut - 1e-12).tolist()


def test_vector_duplicates_of_nothing(spark):
    assert capfilter.vector_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


@pytest.mark.parametrize("cell", [8192, 64])
def test_nearest_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(ann, "CELL", cell)
    monkeypatch.setattr(ann, "PART", cell)
    monkeypatch.setattr(ann, "LEAF", 16)
    rng = np.random.default_rng(4)
    x = vectors(rng, 900)
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(900)]
    odd = [(i + 99 - i % 100, v, 0) for i, v, _ in ODD[:-1]]
    monkeypatch.setattr(ann, "QUERIES", cell // 4)
    got = ann.nearest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 20 == 0).toPandas()
    hits = 0
    for i in range(0, 900, 20):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        best = np.lexsort((np.arange(900), d))[:10]
        own = got[got["query_id"] == i].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        np.testing.assert_array_equal(own["score"].to_numpy(), d[own["vec_id"]])
        hits += len(set(best) & set(own["vec_id"]))
    assert hits >= 0.95 * 450
    assert set(got["query_id"]) == set(range(0, 900, 20))


def test_nearest_verifies_few_and_finds_most(spark):
    """Vectors with close neighbours: the stop test fires, and recall stays."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 64))
    x[1::2] = x[::2] + 0.3 * rng.standard_normal((1500, 64))
    rows = spark.createDataFrame([(i, x[i].tolist(), "x", 0) for i in range(3000)], "vec_id long, embedding array<double>, rank string, d int")
    asks = F.col("vec_id") % 100 == 0
    held = ann.verified(rows, asks, k=1).toPandas()
    assert sorted(held["query_id"]) == list(range(0, 3000, 100)) and held["verified"].mean() < 0.1 * 3000
    got = {r["query_id"]: r["vec_id"] for r in ann.nearest(rows, asks, k=1).collect()}
    want = {i: int(np.argsort(((x - x[i]) ** 2).sum(axis=1))[1]) for i in range(0, 3000, 100)}
    assert sum(got[i] == want[i] for i in want) >= 0.9 * len(want)


def test_projected_neighbours_come_in_order():
    x = np.random.default_rng(7).standard_normal((2000, 40))
    index = ann.Index(np.arange(2000), x)
    d = np.concatenate([d for d, _ in index.neighbours(x[5] @ index.r)])
    np.testing.assert_allclose(d, np.sort(((x @ index.r - x[5] @ index.r) ** 2).sum(axis=1)))


def test_nearest_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 9.0]), (1, [1.0, 1.0]), (1, [1.0, 8.0]), (None, [1.0, 0.0])]
    for order in (rows, rows[::-1]):
        got = ann.nearest(spark.createDataFrame(order, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
        assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 2**0.5), (0, 1, 65**0.5)]


def test_nearest_of_few_and_of_ties(spark):
    schema = "vec_id long, embedding array<float>"
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (5, [1.0, 1.0]), (3, [1.0, 1.0])], schema), F.col("vec_id") == 0)
    assert [(r["rank"], r["vec_id"], r["score"]) for r in few.orderBy("rank").collect()] == [(1, 3, 1.0), (2, 5, 1.0)]
    assert ann.nearest(spark.createDataFrame([], schema), F.col("vec_id") == 0).collect() == []
    assert ann.nearest(spark.createDataFrame([(1, [1.0])], schema), F.col("vec_id") == 0).collect() == []
