"""Near-duplicates against brute force on shingle sets, and what happens to odd documents."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], SCHEMA)


def shingles(text):
    w = re.findall(r"\w+", text.lower())
    return frozenset(zip(w, w[1:], w[2:])) or frozenset([tuple(w)])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    docs = []
    for g in range(40):
        base = [word() for _ in range(rng.randrange(80, 300))]
        size = 70 if g == 0 else 130 if g == 1 else rng.choice([1, 1, 2, 3, 5])
        for _ in range(size):
            own = [word() if rng.random() < 0.03 else w for w in base]
            if g % 5 == 4:
                own = own[:30] + passage + own[30:] + [word() for _ in range(150)]
            docs.append(" ".join(own))
    docs += [docs[3], docs[3].replace(" ", "  "), docs[3].upper()]
    return list(enumerate(docs))


def groups_of(pairs, n):
    root = list(range(n))
    for a, b in pairs:
        root[max(a, b)] = min(a, b)
    return root


def test_recall_and_precision(spark, corpus):
    got = minhash.near_duplicates(frame(spark, corpus)).collect()
    kept = {r["doc_id"]: r["kept_doc_id"] for r in got}
    assert len(kept) == len(got) and all(b < a and b not in kept for a, b in kept.items())
    sets = [shingles(t) for _, t in corpus]
    near = total = 0
    for i, j in combinations(range(len(sets)), 2):
        together = kept.get(i, i) == kept.get(j, j)
        both = len(sets[i] & sets[j])
        s = both / (len(sets[i]) + len(sets[j]) - both)
        if s >= 0.5:
            total += 1
            near += together
        elif s < 0.3:
            assert not together, (i, j, s)
    assert total > 2000 and near / total >= 0.97


def test_shared_passages_join_by_exact_similarity_only(spark):
    rng = random.Random(7)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    docs = []
    # pairs within a part have similarities of about 0.45, 0.47 and 0.52
    for count, shared, own in ((70, 248, 150), (40, 200, 108), (12, 220, 98)):
        passage = words(shared)
        docs += [" ".join(passage + words(own)) for _ in range(count)]
    sets = [shingles(t) for t in docs]
    want = []
    for i, j in combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both / (len(sets[i]) + len(sets[j]) - both) >= 0.5:
            want.append((i, j))
    assert want and min(want)[0] >= 110
    kept = {r["doc_id"]: r["kept_doc_id"] for r in minhash.near_duplicates(frame(spark, list(enumerate(docs)))).collect()}
    assert kept == {i: 110 for i in range(111, 122)}


def roots_of(n, edges):
    root, changed = np.arange(n), True
    while changed:
        changed = False
        for x, y in edges:
            low = min(root[x], root[y])
            if root[x] != low or root[y] != low:
                root[x] = root[y] = low
                changed = True
    return root


@pytest.mark.parametrize("block", [64, 10_000])
def test_nodes_larger_than_a_block(monkeypatch, spark, corpus, block):
    monkeypatch.setattr(minhash, "SMALL", 8)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SAMPLE", 40)
    sets = [shingles(t) for _, t in corpus]
    near = [(i, j) for i, j in combinations(range(len(sets)), 2) if 2 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j])]
    kept = {r["doc_id"]: r["kept_doc_id"] for r in minhash.near_duplicates(frame(spark, corpus)).collect()}
    together = [kept.get(i, i) == kept.get(j, j) for i, j in near]
    assert np.mean(together) >= 0.97
    assert all(b < a for a, b in kept.items())


def test_a_dense_node_is_compared_at_once(monkeypatch, corpus):
    monkeypatch.setattr(minhash, "SMALL", 8)
    sig = minhash.signatures(*minhash.shingle_hashes(pa.array([t for i, t in corpus[:70]])))
    a, b, _, child, who = minhash.split_nodes(np.zeros(len(sig), np.uint64), np.arange(len(sig)), sig, 0.5)
    full = np.array([[(x == y).mean() for y in sig] for x in sig])
    assert (roots_of(70, np.argwhere(np.triu(full >= 0.5, 1))) == roots_of(70, np.stack([a, b], 1))).all()
    assert not len(child) and not len(who)


def test_trees_find_the_target_at_any_depth():
    rng = np.random.default_rng(5)
    for threshold in (0.4, 0.5, 0.8):
        k, found = minhash.branches(threshold), 0
        for _ in range(400):
            alive = [minhash.trees(threshold)]
            met = False
            for _ in range(alive[0]):
                here = 1
                for _ in range(12):
                    here = min(int(rng.binomial(k, threshold, here).sum()), 200)
                met |= here > 0
            found += met
        assert found / 400 >= minhash.TARGET - 0.03, threshold


def test_keeps_one_of_each(spark, corpus):
    df = frame(spark, corpus)
    kept = {r["doc_id"] for r in minhash.keep_one_of_each(df).collect()}
    gone = {r["doc_id"] for r in minhash.near_duplicates(df).collect()}
    assert kept == {i for i, _ in corpus} - gone


def odd():
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    return [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, None), (4, None), (5, ""), (6, ""), (7, "!!"), (8, "!!"), (9, "hi there"), (10, "Hi, there"), (11, "hi"), (12, long), (13, long + " end"), (14, "there hi")]


def test_odd_documents(spark):
    df = frame(spark, odd()).selectExpr("*", "0 as n", "1 as digest", "2 as rid", "'x' as sig", "3 as kept_doc_id")
    got = {tuple(r) for r in minhash.near_duplicates(df).collect()}
    assert got == {(2, 1), (6, 5), (8, 7), (10, 9), (13, 12)}
    left = minhash.keep_one_of_each(df)
    assert left.columns == df.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=lambda x: (x is None, x)) == [1, 3, 4, 5, 7, 9, 11, 12, 14]


def test_clashing_names(spark):
    rows = [(5, "a b c d", 1), (5, "a b c d", 0), (4, "a b c d", 9), (7, "x y z", 2), (7, None, 3)]
    names = ["id", "_id", "digest", "marked_id", "number", "kind", "place", "root", "rid", "sig", "least", "lost", "__n", "__digest", "__id", "a.b"]
    df = spark.createDataFrame([(*r[:2], *[r[2]] * len(names)) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    left = minhash.keep_one_of_each(df)
    assert left.columns == df.columns
    assert sorted((r[0], r[1] is None, r[2]) for r in left.collect()) == [(4, False, 9), (7, False, 2), (7, True, 3)]
    again = minhash.keep_one_of_each(df.where("doc_id = 5"))
    assert [(r[0], r[2]) for r in again.collect()] == [(5, 0)]
    renamed = df.withColumnRenamed("doc_id", "Digest.id").withColumnRenamed("text", "id text")
    assert minhash.keep_one_of_each(renamed, text_col="id text", id_col="Digest.id").columns == renamed.columns


def test_empty_table(spark):
    empty = frame(spark, [])
    assert minhash.near_duplicates(empty).count() == minhash.keep_one_of_each(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["root"] for r in minhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x != r}


def test_a_crowd_passes_its_pairs_on_in_pieces(monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS", 1000)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 16, minhash.SIZE).astype(np.uint16)
    sig = np.where(rng.random((400, minhash.SIZE)) < 0.65, base, rng.integers(0, 1 << 16, (400, minhash.SIZE))).astype(np.uint16)
    none = np.zeros(400, np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(400, 7)), pa.array(none + 1), pa.array(none), pa.array(none), pa.array(none), pa.array(np.arange(400)), minhash._binary(sig)], ["node", "blocks", "i", "j", "side", "rid", "sig"])
    got = list(minhash._splitter(0.5)(iter([batch])))
    assert max(b.num_rows for b in got) < 1000 + 400
    pairs = [frozenset(p) for b in got for p in zip(b["x"].to_pylist(), b["y"].to_pylist()) if len(set(p)) == 2]
    near = [frozenset((i, j)) for i in range(400) for j in range(i) if (sig[i] == sig[j]).mean() >= 0.5 - minhash.BELOW]
    assert len(pairs) == len(set(pairs)) and set(pairs) == set(near) and len(near) > 20_000
