"""Language identification, quality, language-model scores, web archives."""

from __future__ import annotations

import gzip
import math
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, lm, quality, queries, warc

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 200
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_language_backoff_and_edge_cases(spark):
    model = langid.BackoffModel(iter([("en", "the cat sat on the mat " * 3), ("de", "der hund saß auf der matte über " * 3)]))
    assert model.predict("the", {})[0] == "en"
    assert model.predict("überhund", {})[0] == "de"
    assert model.predict(None, {}) == model.predict("12 34 !!", {}) == model.predict("½ ² Ⅷ ①", {}) == ("und", 0.0)
    assert langid.counted("Ab² ab½ab x_y") == {"ab": 3, "x": 1, "y": 1}
    rows = [(1, None, "en", "s"), (2, "", None, "s"), (3, "the cat", "de", "s"), (3, "the cat", "de", "s"), (4, "the cat " * 50_000, "de", "s"), (None, "der", "de", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(df, model).orderBy("doc_id").collect()]
    assert got == [(None, "de"), (1, "und"), (2, "und"), (3, "en"), (3, "en"), (4, "en")]
    empty = df.limit(0)
    assert langid.identify(empty, langid.train(empty)).collect() == []


def brute_language(samples, text):
    """Words first, then ever shorter n-grams, with plain dictionaries and loops."""
    langs = sorted({g for g, _ in samples})
    words = {g: Counter(w for h, t in samples if h == g for w in langid.counted(t).elements()) for g in langs}
    tables = [words]
    for size in range(1, 6):
        tables.append({g: Counter() for g in langs})
        for g in langs:
            for w, n in words[g].items():
                marked = f"^{w}$" if size > 1 else w
                for i in range(len(marked) - size + 1):
                    tables[-1][g][marked[i : i + size]] += n
    known = [{k for k, n in sum(t.values(), Counter()).items() if n >= 2} for t in tables]
    log = lambda level, k, g: math.log((tables[level][g][k] + 0.5) / (tables[level][g].total() + 0.5 * len(known[level])))
    total, n = dict.fromkeys(langs, 0.0), 0
    for w, c in langid.counted(text).items():
        for level in (0, 5, 4, 3, 2, 1):
            marked = w if level < 2 else f"^{w}$"
            keys = [w] if level == 0 else [marked[i : i + level] for i in range(len(marked) - level + 1)]
            found = [k for k in keys if k in known[level]]
            if found:
                for g in langs:
                    total[g] += c * sum(log(level, k, g) for k in found) / len(found)
                n += c
                break
    best = max(langs, key=lambda g: (total[g], -langs.index(g)))
    part = min(n, 50) / max(n, 1)
    return best, 1 / sum(math.exp(part * (x - total[best])) for x in total.values())


def test_language_against_brute_force(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(300).collect() if r["text"] and r["lang"]]
    samples = [(r["lang"], r["text"][:400]) for r in rows[:60]]
    model = langid.BackoffModel(iter(samples))
    for r in rows[60:120]:
        lang, score = model.predict(r["text"][:300], {})
        want, p = brute_language(samples, r["text"][:300])
        assert lang == want and score == pytest.approx(p, rel=1e-3)


def test_language_query_against_its_contract(spark):
    """Rows, the held-out mark, and that predictions of the query learn nothing from held-out rows."""
    got = queries.op3_langid(spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    assert len(got) == len(docs) and got["score"].between(0, 1).all()
    assert all(got.at[r["doc_id"], "held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in docs)
    model, memory = langid.BackoffModel((r["lang"], r["text"]) for r in docs if r["lang"] and r["text"] is not None and not got.at[r["doc_id"], "held_out"]), {}
    assert all(got.at[r["doc_id"], "lang_pred"] == model.predict(r["text"], memory)[0] for r in docs)


def test_language_learns_nothing_from_held_out_rows(spark):
    docs = spark.createDataFrame([(i, "abc def", "xx" if i % 2 else "yy") for i in range(400)], "doc_id long, text string, lang string")
    kept = langid.train(docs.filter(langid.held_out()))
    assert kept.langs == []


def test_quality_against_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = quality.resample(docs, model).join(labels, "doc_id").toPandas()
    assert got.loc[got["quality"] == 1, "kept"].mean() > 0.97
    assert got.loc[got["quality"] == 0, "kept"].mean() < 0.1
    assert quality.drawn(docs, model).count() == quality.resample(docs, model).filter("kept").count()


def test_quality_draws_the_k_largest_keys(spark):
    rows = [(i, t) for i, t in enumerate(["a b c", "x!! y!!", None, "", "a a a", "a b c"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (5, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    for k in (0, 1, 37, 120, 500):
        got = quality.resample(docs, model, k).toPandas().sort_values("sample_key", ascending=False)
        assert got["kept"].sum() == min(k, 120)
        assert got["kept"].tolist() == sorted(got["kept"], reverse=True)
    weights = {t: model.weight(t) for _, t in rows}
    assert weights[None] == weights[""] == 0 and weights["a b c"] > 0 > weights["x!! y!!"]
    assert quality.resample(docs.limit(0), model).collect() == []
    blind = quality.fit(docs, labels.limit(0))
    assert quality.resample(docs, blind).filter("kept").count() == 120


def test_quality_against_brute_force(spark):
    """Counts, ratios and weights by dictionaries; repeated ids, clashing names."""
    texts = ["a b c", "a b b b", "x!! y!!", None, " ", "a c x", "long " * 3000]
    rows = [(i % 6, t, 1.0, "k") for i, t in enumerate(texts * 3)] + [(None, "a b", 2.0, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, log_weight double, kept string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (5, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    count = lambda ts: Counter(f for t in ts for f in quality.features(t).tolist())
    raw, good = count(r[1] for r in rows), count(r[1] for r in rows if r[0] in (0, 5))
    pseudo = 0.01 * quality.BUCKETS
    ratio = {f: math.log((good[f] + pseudo * n / raw.total()) / (good.total() + pseudo) / (n / raw.total())) for f, n in raw.items()}
    got = quality.resample(docs, model).collect()
    assert len(got) == len(rows)
    want = sorted(sum(ratio[f] for f in quality.features(r[1]).tolist()) for r in rows)
    np.testing.assert_allclose(sorted(r["log_weight"] for r in got), want, rtol=1e-9, atol=1e-9)
    keys = sorted((r["sample_key"] for r in got), reverse=True)
    k = sum(r["log_weight"] >= model.cut for r in got)
    assert all(r["kept"] == (r["sample_key"] >= keys[k - 1]) for r in got)


def test_kth_largest_with_ties(spark):
    x = [1.0] * 50 + [2.0] * 3 + [float(i) / 7 for i in range(100)]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    for k in (1, 3, 55, 103, 153):
        assert quality.kth_largest(df, "v", k, bins=4) == sorted(x, reverse=True)[k - 1]
    assert quality.kth_largest(df, "v", 154) is None


def brute_scores(texts, order, backoff, least):
    docs = [["<s>"] * (order - 1) + (t or "").lower().split() for t in texts]
    n = [Counter(tuple(d[i : i + o]) for d in docs for i in range(len(d) - o + 1)) for o in range(1, order + 1)]
    total = sum(len(d) - order + 1 for d in docs)
    out = []
    for d in docs:
        s = 0.0
        for i in range(order - 1, len(d)):
            p = 0.0
            for o in range(order, 0, -1):
                g = tuple(d[i - o + 1 : i + 1])
                if o == 1:
                    s += p + math.log(n[0][g] / total)
                elif n[o - 1][g] >= least:
                    s += p + math.log(n[o - 1][g] / n[o - 2][g[:-1]])
                    break
                p += math.log(backoff)
        out.append(s)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores_against_brute_force(spark, order):
    rng = np.random.default_rng(order)
    texts = [" ".join(f"w{int(rng.integers(0, 30))}" for _ in range(int(rng.integers(0, 80)))) for _ in range(60)] + [None, "", " \n", "W1 w1 W2", "w1 " * 5000]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, log_score double")
    got = lm.score_documents(df, order).toPandas().sort_values("doc_id")
    np.testing.assert_allclose(got["log_score"], brute_scores(texts, order, 0.4, 2), rtol=1e-9, atol=1e-9)
    assert got["n_words"].tolist() == [len((t or "").split()) for t in texts]
    assert got.loc[got["n_words"] == 0, "mean_log_score"].isna().all()


def test_backoff_scores_of_nothing_and_of_repeats(spark):
    schema = "doc_id long, text string"
    assert lm.score_documents(spark.createDataFrame([], schema)).collect() == []
    texts = ["a b", "a b", "a b c", None, None, "b c"]
    df = spark.createDataFrame(list(zip([1, 1, 1, None, None, None], texts, strict=True)), schema)
    got = sorted((r["n_words"], r["log_score"]) for r in lm.score_documents(df).collect())
    want = sorted(zip((len((t or "").split()) for t in texts), brute_scores(texts, 3, 0.4, 2), strict=True))
    np.testing.assert_allclose(got, want)


@pytest.mark.parametrize("floor", [0, 1 << 40])
def test_backoff_scores_with_all_or_no_ngrams_by_broadcast(spark, monkeypatch, floor):
    monkeypatch.setattr(lm, "FLOOR", floor)
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{int(w)}" for w in rng.integers(0, 20, int(rng.integers(0, 60)))) for _ in range(50)] + [None, "", "w1 " * 300, "w1 " * 300]
    got = lm.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().sort_values("doc_id")
    np.testing.assert_allclose(got["log_score"], brute_scores(texts, 3, 0.4, 2), rtol=1e-9, atol=1e-9)


def test_backoff_scores_deal_each_ngram_once(spark):
    """Rows that shuffles write: an n-gram is dealt for its count and its gain together, three rows a word, and one of the word's sum."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(w)}" for w in rng.integers(0, 3000, 300)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    df.count()

    def written():
        store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        lm.score_documents(df).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = sum(n for stage, n in written().items() if stage not in before)
    assert rows < 4.5 * 300 * 300


PAGE = '<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><style>p{x}</style></head><body><!-- no --><p>Un <b>deux</b>&nbsp;trois</p><script>var t="</p>";</script><ul><li><a href="/x?a=1&amp;b=2">ici</a></li><li><a href=\'/y\'>là</a> <a href=/x?a=1&amp;b=2>again</a></ul></body></html>'


def test_page_text_and_fields():
    assert warc.page_text(PAGE) == "Un deux trois\nici\nlà again"
    assert warc.page_fields(PAGE) == [("title", "A & B"), ("language", "fr"), ("outlink", "/x?a=1&b=2"), ("outlink", "/y")]
    assert warc.page_text("") == warc.page_text("<p>") == "" and warc.page_text("a < b") == "a < b"


def test_text_of_pages_without_an_end_of_head_and_with_comparisons():
    assert warc.page_text("<html><head><title>x</title><body><p>Hello world") == "Hello world"
    head = "<head lang=en>\n<meta charset=a><script>if (a) { '<p>' }</script><!-- <body> --><link href=b><title>x</title>"
    for rest in ("<p>Hello", "Hello", "<body class=c>Hello", "</head><body>Hello", "</head>Hello"):
        assert warc.page_text(head + rest) == "Hello"
    assert warc.page_text("<head><title>x</title></head><header>top</header>") == "top"
    assert warc.page_text("<head><title>x</title><header>top</header>") == "top"
    assert warc.page_text("if a < b and c > d") == "if a < b and c > d"
    assert warc.page_text("1 <2 or 3> <!doctype html><?xml?><b>bold</b></p x><I>it</I>") == "1 <2 or 3> bold\nit"


def test_derivatives_refer_to_their_responses_and_survive_a_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", PAGE), (2, "http://b/", None), (3, "http://c/", "plain\r\n\r\ntext")], "page_id long, url string, html string")
    responses = warc.responses_from_pages(pages)
    made = responses.unionByName(warc.derive(responses))
    rows = {(r["warc_type"], r["target_uri"]): r for r in made.collect()}
    assert len(rows) == 9
    for kind in ("metadata", "conversion"):
        for uri, body in (("http://a/", PAGE), ("http://b/", ""), ("http://c/", "plain\r\n\r\ntext")):
            r, source = rows[kind, uri], rows["response", uri]
            assert r["refers_to"] == source["record_id"] and r["record_id"] != source["record_id"]
            assert r["headers"]["WARC-Source-Payload-Digest"] == warc.digest(body.encode())
            assert r["headers"]["WARC-Source-IP-Address"] == "0.0.0.0"
            assert r["headers"]["WARC-Block-Digest"] == warc.digest(r["block"])
            assert int(r["headers"]["Content-Length"]) == len(r["block"])
            assert r["headers"]["WARC-Refers-To-Target-URI"] == uri and r["headers"]["WARC-Refers-To-Date"] == source["date"]
    assert b"via-status: HTTP/1.1 200 OK\r\n" in rows["metadata", "http://a/"]["block"]
    path = str(tmp_path / "out")
    warc.write_warc(made.coalesce(2), path)
    back = {(r["warc_type"], r["target_uri"]): r for r in warc.read_warc(spark, path + "/*.gz").collect()}
    assert {k: (r["record_id"], r["refers_to"], r["block"]) for k, r in back.items()} == {k: (r["record_id"], r["refers_to"], r["block"]) for k, r in rows.items()}


def test_derivatives_carry_every_header_of_the_response():
    given = {"WARC-Concurrent-To": "<q>", "WARC-Warcinfo-ID": "<i>", "WARC-Truncated": "length", "WARC-Payload-Digest": "sha1:x", "Content-Length": "8"}
    record = {"record_id": "<r>", "target_uri": "u", "date": "d", "headers": given, "block": b"not http"}
    for made in warc.derivatives(record):
        assert {k: v for k, v in made[6].items() if k.startswith("WARC-Source-")} == {k.replace("WARC-", "WARC-Source-"): v for k, v in given.items() if k != "Content-Length"}
        assert made[6]["Content-Length"] == str(len(made[7]))


def test_derivatives_of_odd_records(spark):
    rows = [(None, "response", None, "u", None, None, None, None), ("<r>", "request", None, "u", None, None, None, b"x"), ("<r>", "response", None, None, None, None, {}, b"not http"), ("<r>", "response", None, None, None, None, {}, b"not http")]
    df = spark.createDataFrame(rows, warc.RECORD).withColumn("extra", F.lit(1))
    got = warc.derive(df).collect()
    assert len(got) == 6 and sum(r["refers_to"] is None for r in got) == 2
    assert {r["block"] for r in got if r["warc_type"] == "conversion"} == {b"", b"not http"}
    assert warc.derive(df.limit(0)).collect() == []
    assert [r[0] for r in warc.parse_warc(gzip.compress(b"WARC/1.1\r\nWARC-Record-ID: <a>\r\nContent-Length: 4\r\n\r\nWARC\r\n\r\nWARC/1.0\r\nWARC-Record-ID: <b>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))] == ["<a>", "<b>"]


def response(content, body):
    return {"record_id": "<r>", "target_uri": "u", "date": "d", "headers": {}, "block": b"HTTP/1.1 200 OK\r\nContent-Type: " + content + b"\r\n\r\n" + body}


def test_derivatives_follow_the_content_type():
    pdf = warc.derivatives(response(b"application/pdf", b"%PDF \xff"))
    assert [r[1] for r in pdf] == ["metadata"] and pdf[0][6]["WARC-Source-Payload-Digest"] == warc.digest(b"%PDF \xff")
    assert warc.derivatives(response(b"text/plain", b"a <b> c"))[1][7] == b"a <b> c"
    assert warc.derivatives(response(b"text/html; charset=ISO-8859-1", b"<p>caf\xe9"))[1][7].decode() == "café"
    assert warc.derivatives(response(b"text/html", b"<meta charset=windows-1252><p>\x80"))[1][7].decode() == "€"
    assert warc.derivatives(response(b"text/html; charset=none-such", b"<p>x\xff"))[1][7].decode() == "x\ufffd"
    long = warc.derivatives(response(b"text/html", b"<p>" + b"word " * 400_000))[1]
    assert len(long[7]) == 5 * 400_000 - 1


def test_archives_of_bytes_long_blocks_and_cut_off_files(spark, tmp_path):
    rows = [("<a>", "response", None, "u", "d", "x", {"k": "v"}, bytes(range(256)) * 20_000), ("<b>", "response", None, "u", "d", "x", {}, b"WARC/1.0\r\n\r\n")]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, warc.RECORD).coalesce(1), path)
    back = warc.read_warc(spark, path + "/*.gz").collect()
    assert [(r["record_id"], bytes(r["block"])) for r in back] == [(r[0], r[7]) for r in rows]
    record = lambda i, block: f"WARC/1.1\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    whole = b"".join(gzip.compress(record(i, b"x" * 10_000)) for i in range(3))
    assert [r[0] for r in warc.parse_warc(whole)] == ["<0>", "<1>", "<2>"]
    assert [r[0] for r in warc.parse_warc(whole[:-30])] == ["<0>", "<1>"]
    assert [r[0] for r in warc.parse_warc(record(1, b"ab") + record(2, b"cd")[:-6])] == ["<1>"]
    assert list(warc.parse_warc(b"")) == []


class Shown(HTMLParser):
    """The words that a page shows, by the standard library's parser."""

    HIDDEN, INLINE = {"head", "script", "style", "template", "noscript", "title"}, {"a", "b", "i", "em", "strong", "span", "u", "small", "code"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        self.out.append("" if tag in self.INLINE else "\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN
        self.out.append("" if tag in self.INLINE else "\n")

    def handle_data(self, data):
        self.out.append("" if self.hidden else data)


def test_query_against_another_parser(spark):
    """Every page of sf0.01: its conversion has the words that another parser finds, and its digests are those of its bytes."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {(r["target_uri"], r["warc_type"]): r for r in queries.op5_warc(spark, SF).collect()}
    assert len(got) == 2 * len({r["url"] for r in pages})
    for r in pages:
        html = r["html"] or ""
        made = got[r["url"], "conversion"]
        assert made["block"].split() == "".join(Shown(html).out).split()
        assert made["source_digest"] == got[r["url"], "metadata"]["source_digest"] == warc.digest(html.encode())
        assert made["refers_to"] == got[r["url"], "metadata"]["refers_to"] and made["block_digest"] == warc.digest(made["block"].encode())


@pytest.mark.parametrize(("order", "least"), [(4, 2), (3, 3), (2, 1)])
def test_backoff_scores_over_many_blocks(spark, order, least):
    rng = np.random.default_rng(order)
    texts = [" ".join(f"w{int(w)}" for w in rng.zipf(1.5, int(rng.integers(0, 60))) % 50) for _ in range(90)] + [None, "\t a\x0bB  b\x0c\r\n", "ä Ä\x1fé x"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    got = lm.score_documents(df, order, least=least).toPandas().sort_values("doc_id")
    words = [(t or "").encode().lower().split() for t in texts]
    want = brute_scores([" ".join(x.hex() for x in w) for w in words], order, 0.4, least)
    np.testing.assert_allclose(got["log_score"], want, rtol=1e-9, atol=1e-9)
    assert got["n_words"].tolist() == [len(w) for w in words]


def test_backoff_scores_deal_only_ngrams_that_can_be_in_the_table(spark):
    """Of random words few pairs occur twice, so that hardly any n-gram of three words can: shuffles write about a row a word."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{int(w)}" for w in rng.integers(0, 3000, 300)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    df.count()
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def written():
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    lm.score_documents(df).collect()
    rows = sum(n for stage, n in written().items() if stage not in before)
    assert 300 * 300 < rows < 1.6 * 300 * 300
