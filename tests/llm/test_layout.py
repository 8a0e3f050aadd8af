"""Mixing, sharding and packing."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import mixing, packing, queries, sharding

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, tokens string"


def fill(budget, nodes):
    """[(cap, weight)] -> grants: raise a common level until the budget is spent or everything is full."""
    grant, open_ = [0.0] * len(nodes), {i for i, (c, w) in enumerate(nodes) if w > 0 and c > 0}
    while open_ and budget > 1e-9:
        level = budget / sum(nodes[i][1] for i in open_)
        full = {i for i in open_ if nodes[i][0] - grant[i] <= level * nodes[i][1]}
        for i in full or open_:
            add = nodes[i][0] - grant[i] if full else level * nodes[i][1]
            grant[i] += add
            budget -= add
        open_ = open_ - full if full else set()
    return grant


@pytest.mark.parametrize("budget", [0.05, 0.4, 0.9, 1.7, 3.0])
def test_budgets_fill_siblings_before_ancestors(spark, budget):
    rng = random.Random(1)
    leaf = {(f"d{d}", g, f"s{s}"): rng.choice([0, 5, 40, 300, 2000]) for d in range(3) for g in ("en", "de", "xx") for s in range(4)}
    rows = spark.createDataFrame([(i, *k, v) for i, (k, v) in enumerate(leaf.items())], "doc_id long, domain string, lang string, source string, tokens long")
    weights = {"lang": {"en": 3.0, "de": 1.0}, "domain": {"d0": 5.0, "d1": 1.0, "d2": 1.0}}
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(rows, budget, 2, weights).collect()}
    total = budget * sum(leaf.values())
    domains = ["d0", "d1", "d2"]
    cap = lambda d, g=None: sum(2 * v for (a, b, _), v in leaf.items() if a == d and b in (["en", "de"] if g is None else [g]) and b != "xx")
    for d, a in zip(domains, fill(total, [(cap(d), weights["domain"][d]) for d in domains]), strict=True):
        for g, b in zip(("en", "de"), fill(a, [(cap(d, g), weights["lang"][g]) for g in ("en", "de")]), strict=True):
            names = [f"s{s}" for s in range(4)]
            for s, c in zip(names, fill(b, [(2 * leaf[d, g, x], 1.0) for x in names]), strict=True):
                assert got[d, g, s] == pytest.approx(c, abs=1.001)
        assert all(got[d, "xx", f"s{s}"] == 0 for s in range(4))


def test_mixture_takes_whole_epochs_and_a_prefix(spark):
    rows = [(i, " ".join(["w"] * (i % 9)), "en", f"s{i % 2}", "x") for i in range(200)]
    leaves = mixing.leaves(spark.createDataFrame(rows, DOC)).cache()
    plan = mixing.budgets(leaves, 1.3, 2)
    got = mixing.mix(leaves, plan, 2, part_rows=7).toPandas()
    for r in plan.collect():
        own = got[(got["source"] == r["source"]) & (got["domain"] == r["domain"])]
        first, second = own[own["epoch"] == 0], own[own["epoch"] == 1]
        assert first["tokens"].sum() == r["supply"]
        assert second["tokens"].sum() == r["budget"] - r["supply"]
        s = second.sort_values("start")
        assert s["start"].tolist() == (s["tokens"].cumsum() - s["tokens"]).tolist()
    again = mixing.mix(leaves, plan, 2, part_rows=50).toPandas()
    key = ["doc_id", "epoch", "start"]
    assert sorted(got[key].itertuples(index=False)) == sorted(again[key].itertuples(index=False))


def test_mixture_edge_cases(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, " ", "en", "s", "y"), (None, "a b", None, "s", "y"), (3, "a " * 100_000, "en", "s", "z"), (3, "a", "en", "s", "z")]
    df = spark.createDataFrame(rows, DOC)
    leaves = mixing.leaves(df)
    got = mixing.mix(leaves, mixing.budgets(leaves, 5.0, 1), 1).collect()
    assert sorted((str(r["doc_id"]), r["lang"], r["tokens"]) for r in got) == [("3", "en", 1), ("3", "en", 100_000), ("None", "(none)", 2)]
    empty = mixing.leaves(df.limit(0))
    assert mixing.mix(empty, mixing.budgets(empty)).collect() == []


def test_mixture_reaches_its_budgets_with_the_crossing_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHELF", 3)
    monkeypatch.setattr(mixing, "LEAVES", 1)
    rows = [(i, "w " * (900 if i == 3 else 1 + i % 9), "en", f"s{i % 2}", "x") for i in range(200)] + [(900, "w " * 5000, "de", "long", "x")]
    leaves = mixing.leaves(spark.createDataFrame(rows, DOC))
    for share in (0.3, 1.3, 2.0):
        plan = mixing.budgets(leaves, share, 2)
        whole = mixing.achieved(plan, mixing.mix(leaves, plan, 2, part_rows=7, counted=leaves)).collect()
        assert len(whole) == 3 and all(r["taken"] == r["budget"] for r in whole)


def test_shards_have_equal_bytes_and_gapless_places(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "é" * rng.choice([0, 1, 10, 100, 900])) for i in range(1500)] + [(1501, "x" * 20_000), (1502, None), (7, "again"), (None, "none")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, shard int")
    placed, chosen = sharding.shard(df, 6)
    got = placed.toPandas()
    assert got.columns.tolist() == ["doc_id", "text", "shard", "vslot", "shard_", "place", "map_version"]
    got["size"] = [len((t or "").encode()) + 8 for t in got["text"]]
    sizes = got.groupby("shard_")["size"].sum()
    assert len(sizes) == 6 and sizes.max() - sizes.min() <= 64
    for _, own in got.groupby("shard_"):
        assert sorted(own["place"]) == list(range(len(own)))
    assert got.groupby("vslot")["shard_"].nunique().max() == 1
    path = str(tmp_path / "map")
    first = sharding.SlotMap.first(6)
    first.save(spark, path)
    chosen.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == chosen and sharding.SlotMap.load(spark, path, 1) == first
    # An edit of a balanced map leaves it; a grown one moves slots to the new shard.
    size, _ = sharding.slot_bytes(df.select(sharding.record_size().alias("size"), sharding.mark_of().alias("mark")))
    assert chosen.rebalanced(size).owner == chosen.owner
    grown = chosen.rebalanced(size, 7)
    load = np.bincount(grown.owner, size, 7)
    assert load.max() - load.min() <= 64


def test_shards_of_one_id_are_even_and_maps_are_stored(spark, tmp_path):
    df = spark.createDataFrame([(None if i % 3 else 7, f"t{i} " * (i % 40)) for i in range(2000)], "doc_id long, text string")
    path = str(tmp_path / "maps")
    for version in (2, 3):
        got = sharding.shard_by_stored_map(df, path, 8).toPandas()
        sizes = got.assign(size=[len(t) + 8 for t in got["text"]]).groupby("shard")["size"].sum()
        assert len(sizes) == 8 and sizes.max() - sizes.min() <= 64 and set(got["map_version"]) == {version}
    assert sharding.SlotMap.load(spark, path).version == 3


def test_sharding_query_against_its_contract(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op7_sharding(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(rows) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    for r in rows:
        data = (r["text"] or "").encode()
        assert got.at[r["doc_id"], "size"] == len(data) + 8
        assert r["text"] is None or got.at[r["doc_id"], "text_crc32"] == zlib.crc32(data)
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    sizes = got.groupby("shard")["size"].sum()
    assert sorted(sizes.index) == list(range(24)) and sizes.max() - sizes.min() <= 0.01 * sizes.mean()


def test_shards_of_nothing(spark):
    placed, chosen = sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 4)
    assert placed.collect() == [] and Counter(chosen.owner) == dict.fromkeys(range(4), sharding.SLOTS // 4)


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit_uses_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = Counter(min(100, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(rng.choice([1, 50, 3000])))
    used: Counter[int] = Counter()
    bins = 0
    for lengths, times in packing.best_two_fit(histogram, 100):
        assert sum(lengths) <= 100 and times > 0
        bins += times
        for x in lengths:
            used[x] += times
    assert used == histogram
    assert bins <= 1.02 * sum(k * v for k, v in histogram.items()) / 100 + 2
    # Applied one at a time, each bin is the same: the first is greedy, or better by its two smallest.
    assert packing.best_two_fit({60: 1, 35: 1, 30: 1, 10: 1}, 100) == [((60, 30, 10), 1), ((35,), 1)]


def test_packing_round_trip(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "Ünï", "x1", "\n\n", "a'll", "<|endoftext|>"]) for _ in range(rng.choice([0, 1, 9, 60, 700]))) for _ in range(80)]
    texts += [None, "", "word " * 30_000, "a" * 5000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0)], "doc_id long, text string, length int")
    got = packing.pack(packing.tokenized(df.repartition(7))).toPandas()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = got[got["doc_id"] == i].sort_values("piece").drop_duplicates("piece")
        assert own["start"].tolist() == (own["length"].cumsum() - own["length"]).tolist()
        assert own["length"].sum() == len(ids) and len(own) == -(-len(ids) // 2048)
        assert own["ids_crc32"].tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own["start"], own["length"], strict=True)]
    by = got.sort_values(["sequence_id", "offset"])
    assert (by["offset"] == by.groupby("sequence_id")["length"].cumsum() - by["length"]).all()
    assert by.groupby("sequence_id")["length"].sum().max() <= 2048
    # No fewer sequences than the tokens fill, nor than there are pieces of over half a sequence.
    assert by["sequence_id"].nunique() <= max(-(-by["length"].sum() // 2048), (by["length"] > 1024).sum()) + 1


def test_ids_are_those_of_the_named_library(spark):
    """All documents of sf0.01, and texts around and beyond two million characters."""
    exact, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing._encoder(None)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    prose = " ".join(texts)
    texts += [prose[:1_999_999], prose[:2_000_001], "a" * 2_000_100, " " * 2_000_100, "\n \n" * 700_000, "x<|endoftext|>" * 150_000, "½²Ⅷ\u0301é\U0001f600\ud7ff"]
    for t in texts:
        assert encode(t) == exact.encode(t, add_special_tokens=False).ids


def one_bin_at_a_time(lengths, capacity):
    """Best-two-fit without a histogram: the longest that fits until none does, then the smallest for the two that fill its gap best."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        own = []
        while fit := [x for x in left if x <= capacity - sum(own)]:
            own.append(fit[0])
            left.remove(fit[0])
        room = capacity - sum(own) + own[-1]
        if sum(own) < capacity:
            pairs = [(a + b, -a) for i, a in enumerate(left) for b in left[i + 1 :] if own[-1] < a + b <= room]
            if pairs:
                total, a = max((t, max(-x, t + x)) for t, x in pairs)
                best = max(t for t, _ in pairs)
                chosen = min((min(-x, t + x), max(-x, t + x)) for t, x in pairs if t == best)
                left.append(own.pop())
                for x in chosen:
                    own.append(x)
                    left.remove(x)
                left.sort(reverse=True)
        bins.append(tuple(sorted(own, reverse=True)))
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_patterns_are_those_of_one_bin_at_a_time(seed):
    rng = random.Random(seed)
    lengths = [min(60, max(1, int(rng.lognormvariate(2.5, 0.9)))) for _ in range(150)]
    plan = [b for b, times in packing.best_two_fit(Counter(lengths), 60) for _ in range(times)]
    brute = one_bin_at_a_time(lengths, 60)
    assert sorted(x for b in plan for x in b) == sorted(lengths)
    assert abs(len(plan) - len(brute)) <= 1
    assert plan[0] == brute[0] or sum(plan[0]) == sum(brute[0])


def test_packing_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.tokenized(df)).collect() == []
    assert packing.best_two_fit({}) == []
    pieces = spark.createDataFrame([(1, 0, 5), (1, 0, 5)], "doc_id long, piece int, length long").withColumn("extra", F.lit("x"))
    assert sorted((r["sequence_id"], r["offset"], r["extra"]) for r in packing.pack(pieces).collect()) == [(0, 0, "x"), (0, 5, "x")]
