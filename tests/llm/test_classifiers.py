"""Held-out accuracy of the three classifiers, and what they make of odd rows."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex

from factloom.llm import quality, toxicity, url_filter
from factloom.llm.labels import labelled_sample

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    syllables = ["the", "on", "er", "ing", "at", "ion", "st", "ou", "ly", "nd"]
    known = ["".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5))) for _ in range(80)]
    word = lambda: rng.choice(known)
    docs, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randrange(5, 120))]
        good, toxic = rng.random() > 0.25, rng.random() < 0.3
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w + rng.choice(["###", "$$$"]) for w in words]
        for _ in range(rng.randrange(1, 4) * toxic):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["vermin", "scoundrel", "filthy"]))
        docs.append((i, " ".join(words), "en" if i % 3 else "de", "s", 0))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)


def odd(spark):
    long = "good word here " * 40_000
    rows = [(1, None, "en"), (2, "", None), (3, "   ", "xx"), (None, "a fine text", "en"), (4, "same", "en"), (4, "same", "en"), (5, long, "en")]
    return spark.createDataFrame([(i, t, g, None, None) for i, t, g in rows], SCHEMA).selectExpr("*", "0 as score", "1 as keep", "2 as toxic", "3 as y", "4 as h")


def test_quality_held_out(spark, corpus):
    docs, labels = corpus
    model = quality.fit_quality(docs.where("doc_id < 600"), labels, max_loss=0.03)
    got = quality.classify_quality(docs, model).join(labels, "doc_id").where("doc_id >= 600").toPandas()
    assert ((got.keep == 1) == (got.quality == 1)).mean() > 0.95
    assert model.held_out["rows"] > 100
    kept = {r["doc_id"] for r in quality.keep_quality(docs, model).collect()}
    assert kept >= set(got[got.keep].doc_id) and quality.keep_quality(docs, model).columns == docs.columns


def test_quality_odd_rows(spark, corpus):
    model = quality.fit_quality(*corpus)
    got = [tuple(r) for r in quality.classify_quality(odd(spark), model).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == 7 and None in by and by[1] == (1, None, False)
    assert by[2][1] == by[3][1] == pytest.approx(model.bias)
    assert 1 not in {r["doc_id"] for r in quality.keep_quality(odd(spark), model).collect()}


def test_quality_scores_whole_texts_as_python_does(spark, corpus):
    model = quality.fit_quality(*corpus)
    texts = ["one two two", "x " * 5000 + "END!!", ""]
    idx, off = quality.ngram_indicators(pa.array(texts))
    for i, t in enumerate(texts):
        own, o = quality.ngram_indicators(pa.array([t]))
        assert (idx[off[i] : off[i + 1]] == own).all()
        want = model.weights[own].sum(dtype=np.float64) / max(len(own), 1) ** 0.5 + model.bias
        assert quality.score_arrays(model.weights, model.bias, own, o)[0] == pytest.approx(want, rel=1e-6)


def test_models_without_labels(spark, corpus):
    none = spark.createDataFrame([(None, 1, None), (1, None, None)], LABELS)
    q, t = quality.fit_quality(corpus[0], none), toxicity.fit_toxicity(corpus[0], none)
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.classify_quality(corpus[0], q).where("not keep").count() == 0
    assert toxicity.classify_toxicity(corpus[0], t).where("toxic").count() == 0
    assert quality.classify_quality(empty, q).count() == quality.keep_quality(empty, q).count() == 0
    assert toxicity.classify_toxicity(empty, t).count() == toxicity.drop_toxic(empty, t).count() == 0


def test_contradicting_labels_and_repeated_documents(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (2, "b", "en", "s", 1)], SCHEMA)
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 0, 0)], LABELS)
    assert quality.fit_quality(docs, labels).weights.shape == (1 << quality.BITS,)
    many = docs.where("doc_id = 1").selectExpr("explode(sequence(1, 500)) AS n", "*").drop("n").unionByName(docs.where("doc_id = 2"))
    more = labels.unionByName(spark.createDataFrame([(i, 0, 0) for i in range(100, 400)], LABELS))
    got = sorted((r["doc_id"], r["y"], r["text"]) for r in labelled_sample(many, more, "quality", 4).collect())
    assert got == [(1, 1, "a"), (2, 0, "b")]


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    y = np.array([0, 1] * 30)
    rows = [np.unique(rng.choice(np.arange(40) + 40 * (rng.random() < 0.2 if k == 0 else rng.random() > 0.2), 6)) for k in y]
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    idx = np.concatenate(rows).astype(np.int64)
    short, long = (quality.fit_arrays(idx, off, y, epochs=e) for e in (60, 600))
    assert np.abs(short[0] - long[0]).max() < 0.05
    s = quality.score_arrays(*long, idx, off)
    assert ((s > 0) == (y == 1)).mean() > 0.8


def test_toxicity_held_out(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit_toxicity(docs.where("doc_id < 600"), labels)
    got = toxicity.classify_toxicity(docs, model).withColumnRenamed("toxic", "found").join(labels, "doc_id").where("doc_id >= 600").toPandas()
    assert got[got.toxic == 1].found.mean() > 0.9 and got[got.toxic == 0].found.mean() < 0.05
    assert set(model.thresholds) == {"en", "de"}
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == docs.count() - toxicity.classify_toxicity(docs, model).where("toxic").count()


def test_toxicity_odd_rows(spark, corpus):
    model = toxicity.fit_toxicity(*corpus)
    got = [tuple(r) for r in toxicity.classify_toxicity(odd(spark), model).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == 7 and by[1] == (1, "en", None, False) and by[2][3] is False and by[3][3] is False
    assert toxicity.drop_toxic(odd(spark), model).count() >= 5
    without = toxicity.classify_toxicity(odd(spark).drop("lang"), model)
    assert without.where("lang is null").count() == 7


def test_toxicity_pieces_equal_the_plain_network(corpus, spark):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 1 << toxicity.BITS, (700, 2)).astype(np.int32)
    off = np.array([0, 1, 1, 300, 700])
    model = toxicity.fit_arrays(ids, off, np.array([0, 1, 0, 1]))
    plain = model.plain()
    whole = toxicity.score_arrays(plain, ids, off, piece=1 << 20)
    assert np.allclose(whole, toxicity.score_arrays(plain, ids, off, piece=37), atol=1e-4)
    x, _ = toxicity._forward(model, *toxicity._padded(ids, off))
    assert np.allclose(whole, x @ model.out + model.bias, atol=1e-3)


def test_urls(spark):
    model = url_filter.fit_urls(url_filter.labelled_urls())
    rows = [(1, "https://m.roulette-fjord.example.org/en/1?x=2"), (2, "http://news.example.com/en/77"), (3, None), (4, ""), (None, "https://xanax-fjord.example.net"), (5, "no url at all"), (5, "no url at all"), (6, "https://a.example/" + "long/" * 20_000), (7, "HTTPS://User@Poker-Fjord.example.com:80/x")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as score", "2 as rejected")
    got = url_filter.filter_urls(df, model).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 9 and by[1]["rejected"] and by[7]["rejected"] and by[None]["rejected"]
    assert not by[2]["rejected"] and not by[3]["rejected"] and by[3]["score"] is None and by[4]["score"] is not None
    assert url_filter.filter_urls(df.limit(0), model).count() == 0
    # every score once more, with sets of strings
    weight = {}
    for r in got:
        if r["url"] is not None:
            own = gram_set(r["url"])
            for g in own - weight.keys():
                weight[g] = model.weights[bucket_of(*g)]
            buckets = {bucket_of(*g): weight[g] for g in own}
            logit = sum(map(float, buckets.values())) / max(1, len(buckets)) ** 0.5 + model.bias
            assert r["score"] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-5) and r["rejected"] == (r["score"] >= model.threshold)


def gram_set(url):
    bare = re.sub(r"^[a-z][a-z0-9+.\-]*://", "", url.lower())
    bare = re.split(r"[?#]", bare)[0]
    host, slash, path = bare.partition("/")
    host = re.sub(r"^www\.", "", re.sub(r":\d+$", "", host.rpartition("@")[2]))
    marked = [re.sub(r"\d", "0", f"^{t}$").encode() for t in (host, slash + path)]
    return {(part, t[i : i + n]) for part, t in enumerate(marked) for n in (3, 4, 5) for i in range(len(t) - n + 1)}


def bucket_of(part, gram):
    h = part * 8 + len(gram)
    for c in gram:
        h = (h * 0x100000001B3 + c) % 2**64
    return mixed(h) >> 64 - url_filter.BITS


def mixed(x):
    """SplitMix64's finaliser on Python's integers."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def word_hash(word):
    """The polynomial hash of a word's bytes."""
    h = sum((b + 1) * pow(0x5851F42D4C957F2D, k, 2**64) for k, b in enumerate(word.encode()))
    return mixed((h + len(word.encode()) * 0x9E3779B97F4A7C15) % 2**64)


TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\p{Z}\p{C}]+")


def indicator_set(text):
    h = [word_hash(w) for w in TOKEN.findall(text)]
    pairs = [0x1234567890ABCDEF if a == b else mixed((a * 0x9E3779B97F4A7C15 + b) % 2**64) for a, b in zip(h, h[1:])]
    return {x >> 64 - quality.BITS for x in h + pairs}


def test_quality_by_brute_force(spark, corpus):
    docs, labels = corpus
    model = quality.fit_quality(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.limit(200).collect()} | {-1: "Größe, «so» —  a a a b_1\n\tx!!", -2: "", -3: "?!"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in quality.classify_quality(df, model).collect():
        own = indicator_set(texts[r["doc_id"]])
        want = sum(float(model.weights[k]) for k in own) / max(1, len(own)) ** 0.5 + model.bias
        assert r["score"] == pytest.approx(want, abs=1e-4) and r["keep"] == (r["score"] >= model.threshold)


def test_dual_coordinate_descent_finds_what_another_method_does():
    """The same objective on dense rows: w'w/2 + sum of upper * hinge, by steps along its subgradient."""
    rng = np.random.default_rng(3)
    y = np.arange(40) % 2
    rows = [np.unique(rng.choice(np.arange(30) + 20 * k, 6)) for k in y]
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    idx = np.concatenate(rows).astype(np.int64)
    weights, bias = quality.fit_arrays(idx, off, y, epochs=3000, c=0.3)
    p, q = (1.0 + np.bincount(np.concatenate([r for r, k in zip(rows, y) if k == c]), minlength=1 << quality.BITS) for c in (1, 0))
    ratio = np.log(p / p.sum() / (q / q.sum()))
    x = np.zeros((40, 51))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / len(r) ** 0.5
        x[i, 50] = 1.0
    sign = 2.0 * y - 1
    loss = lambda w: w @ w / 2 + 0.3 * np.maximum(0, 1 - sign * (x @ w)).sum()
    w, best = np.zeros(51), np.inf
    for t in range(60_000):
        w -= (w - 0.3 * ((sign * (sign * (x @ w) < 1)) @ x)) / (t + 2)
        best = min(best, loss(w)) if t % 10 == 0 else best
    with np.errstate(divide="ignore", invalid="ignore"):
        found = np.append(np.where(ratio[:50] != 0, weights[:50] / ratio[:50], 0), bias)
    assert loss(found) <= best * 1.01 and loss(found) >= best * 0.98


def test_toxicity_by_brute_force(spark, corpus):
    """The network once more, word by word, from its tables."""
    docs, labels = corpus
    model = toxicity.fit_toxicity(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.limit(80).collect()} | {-1: "You FILTHY Größe vermin", -2: "", -3: "one"}

    def logit(text):
        words = [w.lower() for w in regex.findall(r"[\p{L}\p{M}\p{N}_]+", text)]
        spots = [tuple(word_hash_bytes(b) >> 64 - toxicity.BITS for b in (w.encode(), w.encode()[: toxicity.PREFIX])) for w in words]
        spots += [(toxicity.PAD, toxicity.PAD)] * max(toxicity.WIDTHS)
        e = [model.tables[0][a] + model.tables[1][b] for a, b in spots]
        pooled = []
        for width, bank, offset in zip(toxicity.WIDTHS, model.filters, model.offsets):
            for f in range(toxicity.FILTERS):
                acts = [sum(float(e[i + k] @ bank[k][:, f]) for k in range(width)) for i in range(len(e) - width + 1)]
                pooled.append(max(0.0, max(acts) + float(offset[f])))
        return float(np.array(pooled) @ model.out) + model.bias

    df = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    for r in toxicity.classify_toxicity(df, model).collect():
        assert r["score"] == pytest.approx(logit(texts[r["doc_id"]]), abs=2e-3)
        assert r["toxic"] == (r["score"] >= model.thresholds["en"])


def word_hash_bytes(data):
    h = sum((b + 1) * pow(0x5851F42D4C957F2D, k, 2**64) for k, b in enumerate(data))
    return mixed((h + len(data) * 0x9E3779B97F4A7C15) % 2**64)


def test_training_gradient_is_that_of_the_loss():
    """One step of the trainer lowers the loss of separable rows to near 0 in a few epochs."""
    rng = np.random.default_rng(4)
    rows = [rng.integers(0, 500, (rng.integers(5, 30), 2)) + (1000 if k else 0) for k in np.arange(60) % 2]
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    y = np.arange(60) % 2
    model = toxicity.fit_arrays(np.concatenate(rows).astype(np.int32), off, y, epochs=20)
    s = toxicity.score_arrays(model.plain(), np.concatenate(rows).astype(np.int32), off)
    assert np.log1p(np.exp(-np.where(y == 1, s, -s))).mean() < 0.05


def test_urls_of_hosts_that_the_table_has_not():
    rows = url_filter.labelled_urls()
    # another fold of hosts than the one that sets the threshold
    fold = np.array([zlib.crc32(b"fold" + h.encode()) % 5 for h in url_filter.host_and_path(pa.array([u for u, _ in rows]))[0].to_pylist()])
    model = url_filter.fit_urls([r for r, k in zip(rows, fold) if k])
    held = [r for r, k in zip(rows, fold) if not k]
    s = 1 / (1 + np.exp(-url_filter._logits(model.weights, model.bias, *url_filter.grams(pa.array([u for u, _ in held])))))
    y = np.array([y for _, y in held])
    assert (s >= model.threshold)[y == 1].mean() > 0.7 and (s >= model.threshold)[y == 0].mean() < 0.03


def test_url_table(spark):
    df = spark.createDataFrame([(u, y) for u, y in url_filter.labelled_urls()] + [(None, 1), ("http://x.example", None)], "url string, label int")
    model = url_filter.fit_url_table(df)
    assert model.weights.any()
    assert url_filter.fit_url_table(df.limit(0)).bias == -4.0


def test_any_number_of_languages(spark):
    model = toxicity.fit_arrays(np.zeros((0, 2), np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64))
    model.bias, model.default = 0.5, 0.0
    model.thresholds = {f"l{i}": float(i % 2) for i in range(3000)}
    rows = [(i, "a b", lang) for i, lang in enumerate(["l0", "l1", "l2", "l2999", "other", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {r[0] for r in rows if r[2] not in ("l1", "l2999")}
    assert {r["doc_id"] for r in toxicity.classify_toxicity(df, model).where("toxic").collect()} == want
    assert {r["doc_id"] for r in toxicity.drop_toxic(df, model).collect()} == {1, 3}


def test_toxicity_fit_gets_long_texts_in_pieces(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from factloom.llm import labels as samples

    rng = np.random.default_rng(5)
    texts = [(i, " ".join(rng.choice(["idiot", "stupid", "river", "stone"] if i % 2 else ["river", "stone", "meadow", "cloud"], 40 + 900 * (i % 7 == 0))), "en") for i in range(300)]
    documents = spark.createDataFrame([*texts, (300, "", "en")], "doc_id long, text string, lang string")
    given = spark.createDataFrame([(i, i % 2) for i in range(301)], "doc_id long, toxic int")
    whole = toxicity.fit_toxicity(documents, given)

    def refuse(self):
        raise AssertionError("a whole sample came to the driver")

    monkeypatch.setattr(Classic, "toArrow", refuse)
    monkeypatch.setattr(Classic, "collect", lambda self, own=Classic.collect: own(self) if len(self.columns) < 2 else refuse(self))
    monkeypatch.setattr(samples, "PART_BYTES", 1 << 15, raising=False)
    monkeypatch.setattr(toxicity, "PIECE", 700, raising=False)
    pieces = toxicity.fit_toxicity(documents, given)
    assert pieces.held_out == whole.held_out and pieces.held_out["rows"] == 75 and pieces.held_out["caught"] == 1.0
    for a, b in zip([*whole.tables, *whole.filters, whole.out], [*pieces.tables, *pieces.filters, pieces.out]):
        assert np.allclose(a, b, atol=1e-3)


def test_quality_fit_gets_long_texts_in_pieces(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from factloom.llm import labels as samples

    rng = np.random.default_rng(6)
    texts = [(i, " ".join(f"{'good' if i % 2 else 'junk'}{x}" for x in rng.integers(0, 60, 30 + 900 * (i % 7 == 0)))) for i in range(200)]
    documents = spark.createDataFrame([*texts, (200, "")], "doc_id long, text string")
    given = spark.createDataFrame([(i, i % 2) for i in range(201)], "doc_id long, quality int")
    whole = quality.fit_quality(documents, given)

    def refuse(self):
        raise AssertionError("a whole sample came to the driver")

    monkeypatch.setattr(Classic, "toArrow", refuse)
    monkeypatch.setattr(samples, "PART_BYTES", 1 << 13, raising=False)
    monkeypatch.setattr(quality, "PIECE", 300, raising=False)
    pieces = quality.fit_quality(documents, given)
    assert pieces.held_out == whole.held_out and whole.held_out["rows"] == 40 and whole.held_out["good_kept"] == 1.0
    assert np.array_equal(whole.weights, pieces.weights) and np.isclose(whole.threshold, pieces.threshold)
