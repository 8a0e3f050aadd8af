"""The pipeline against its stages, one at a time, and the registered queries against SQL."""

from __future__ import annotations

import random

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.llm import langid, minhash, mixing, packing, quality

SF = "/root/testdata/sf0.01"


def test_pipeline_against_decisions_made_in_one_place(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model, memory = langid.train(docs), {}
    kept = [r for r in rows.values() if model.predict(r["text"], memory)[0] != "und" and model.predict(r["text"], memory)[1] >= corpus_pipeline.SURE]
    frame = lambda rs: spark.createDataFrame(rs, docs.schema)
    m = quality.fit(frame(kept), spark.read.parquet(f"{SF}/labels.parquet"))
    k = sum(m.weight(r["text"]) >= m.cut for r in kept)
    keys = {r["doc_id"]: r["sample_key"] for r in quality.resample(frame(kept), m).collect()}
    kept = sorted(kept, key=lambda r: -keys[r["doc_id"]])[:k]
    sets = {r["doc_id"]: {*minhash.shingles(r["text"], 5).tolist()} for r in kept}
    ids, comp = sorted(sets), {}
    for i in ids:
        comp[i] = i
    changed = True
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    kept = [rows[i] for i in ids if comp[i] == i]
    leaves = mixing.leaves(frame(kept))
    taken = {r["doc_id"] for r in mixing.mix(leaves, mixing.budgets(leaves, 0.8, 1), 1).collect()}
    pieces = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in packing.tokenized(frame([r for r in kept if r["doc_id"] in taken])).collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in got} == pieces
    assert len(got) == len(pieces) > 200


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if n.startswith("op")])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    order = [c for c in cols if want[c].dtype.kind != "f"]
    a, b = (d[cols].sort_values(order, ignore_index=True) for d in (got, want))
    for c in cols:
        assert a[c].tolist() == (pytest.approx(b[c].tolist()) if b[c].dtype.kind == "f" else b[c].tolist())


def test_stages_pass_empty_tables_and_extra_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0).selectExpr("*", "1 AS guess", "2 AS kept", "3 AS Place")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_stages_decide_row_by_row(spark):
    """Null ids, and ids whose rows differ in text and source."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    full = lambda **r: tuple(r.get(f.name) for f in schema)
    texts = ["alpha beta gamma delta epsilon zeta eta", "one two three four five six seven eight nine", "red green blue white black brown grey"]
    docs = spark.createDataFrame([full(doc_id=None, text=t, lang="en", source="s") for t in texts], schema)
    stages = dict(corpus_pipeline.STAGES)
    assert sorted(r["text"] for r in stages["near_dedup"](spark, docs, SF).collect()) == sorted(texts)
    repeated = [(7, texts[0]), (7, texts[0]), (7, texts[1]), (8, texts[1]), (9, None), (9, "  "), (None, texts[0])]
    copies = spark.createDataFrame([full(doc_id=i, text=t, lang="en", source="s") for i, t in repeated], schema)
    assert sorted((str(r["doc_id"]), r["text"]) for r in stages["near_dedup"](spark, copies, SF).collect()) == [("7", texts[1]), ("9", "  "), ("None", texts[0])]
    # The null ids tie, so the short ones come first; the row that crosses 0.8 of all tokens is kept whole, what comes after it isn't.
    assert sorted(r["text"] for r in stages["mixing"](spark, docs, SF).collect()) == sorted(texts)
    docs = spark.createDataFrame([full(doc_id=1, text=" ".join(["w"] * n), lang="en", source="s") for n in range(30, 40)], schema)
    assert sorted(len(r["text"].split()) for r in stages["mixing"](spark, docs, SF).collect()) == list(range(30, 39))
    docs = spark.createDataFrame([full(doc_id=i, text=texts[0], lang="en", source="s") for i in (None, None, 4, 4)], schema)
    for name in ("language", "quality"):
        assert stages[name](spark, docs.withColumn("lang", F.lit("en")), SF).count() == 4, name
    assert stages["packing"](spark, docs, SF).count() == 4


FOREIGN = {
    "Polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Latin": "Gallia est omnis divisa in partes tres quarum unam incolunt Belgae aliam Aquitani tertiam qui ipsorum lingua Celtae nostra Galli appellantur",
    "letters": " ".join("".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=2 + i % 8)) for i in range(200)),
}


def test_language_stage_rejects_what_no_learned_language_has(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    low = docs.agg(F.min("doc_id")).first()[0]
    rows = [tuple({"doc_id": low - 1 - i, "text": t}.get(f.name) for f in docs.schema) for i, t in enumerate(FOREIGN.values())]
    out = dict(corpus_pipeline.STAGES)["language"](spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF)
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert not {low - 1 - i for i in range(len(FOREIGN))} & kept
    # All that the posterior lets pass, held-out rows among them, stays.
    model, memory = langid.train(docs), {}
    want = {r["doc_id"] for r in docs.collect() if model.predict(r["text"], memory)[1] >= corpus_pipeline.SURE}
    assert kept == want and len(want) > 900
