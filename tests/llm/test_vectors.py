"""Range join and nearest neighbours against brute force."""

import numpy as np
import pytest

from factloom.llm import ann, embed_dedup, registry
from factloom.llm.vectors import unit

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(x, first=0):
    return [(first + i, [float(v) for v in row], 0) for i, row in enumerate(x)]


def brute_pairs(rows, cosine):
    ids = [r[0] for r in rows]
    x = unit(np.array([r[1] for r in rows], np.float32))
    c = x @ x.T
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(x)) for j in range(i) if c[i, j] >= cosine and ids[i] != ids[j]}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    return np.concatenate([c + 0.15 * rng.normal(size=(25, 16)) for c in centres]).astype(np.float32)


@pytest.mark.parametrize("cell, pivot_bytes, rows_of_a_block", [(40, 1 << 20, 1 << 16), (4096, 1 << 20, 1 << 16), (40, 1 << 20, 30), (10, 3 * 8 * 16, 25), (4096, 1 << 20, 7)])
def test_range_join_is_exact(spark, clustered, monkeypatch, cell, pivot_bytes, rows_of_a_block):
    monkeypatch.setattr(embed_dedup, "CELL", cell)
    monkeypatch.setattr(embed_dedup, "PIVOT_BYTES", pivot_bytes)
    monkeypatch.setattr(embed_dedup, "ROWS", rows_of_a_block)
    rows = rows_of(clustered)
    got = embed_dedup.range_join(spark.createDataFrame(rows, SCHEMA), 0.97).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_pairs(rows, 0.97) != set()


def test_large_cells_split_exactly(monkeypatch, clustered):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    x = unit(clustered).astype(np.float32)
    a, b = embed_dedup.join_cell(x[:200], x[200:], 0.97)
    c = x @ x.T
    want = {(i, j) for i in range(200) for j in range(len(x)) if (j >= 200 or i < j) and c[i, j] >= 0.97 - embed_dedup.MARGIN}
    assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())} == want


def test_large_cells_of_near_identical_vectors_split_exactly():
    rng = np.random.default_rng(1)
    centre = unit(rng.normal(size=(1, 64)))
    near = unit(centre + 1e-4 / 8 * rng.normal(size=(3000, 64)))
    spread = unit(centre + 0.25 / 8 * rng.normal(size=(3000, 64)))
    x = np.concatenate([near, spread])[rng.permutation(6000)].astype(np.float32)
    a, b = embed_dedup.join_cell(x, x[:0], 0.95)
    got = np.zeros((6000, 6000), bool)
    got[np.minimum(a, b), np.maximum(a, b)] = True
    want = np.triu(x.astype(np.float64) @ x.T.astype(np.float64) >= 0.95, 1)
    assert len(a) == got.sum() and not (want & ~got).any()


def odd_rows():
    good = [1.0, 0.0, 0.0]
    return [(1, good, 0), (2, good, 0), (2, good, 0), (3, [0.99, 0.01, 0.0], None), (None, good, 0), (4, None, 0), (5, [], 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, 0.0], 0), (8, [float("nan"), 1.0, 0.0], 0), (9, [1.0, None, 0.0], 0), (10, [0.0, 1e-30, 0.0], 0)]


def test_odd_vectors_have_no_pairs(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA).selectExpr("*", "1 as cell", "2 as vec_a", "3 as id")
    assert {tuple(r) for r in embed_dedup.range_join(df).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {tuple(r) for r in embed_dedup.near_duplicates(df).collect()} == {(2, 1), (3, 1)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert embed_dedup.range_join(empty).count() == 0
    assert ann.nearest(empty).count() == 0
    nothing = spark.createDataFrame([(1, None, 0)], SCHEMA)
    assert embed_dedup.range_join(nothing).count() == ann.nearest(nothing).count() == 0


def test_scan_without_abandoning_is_exact():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(200, 40)).astype(np.float32), rng.normal(size=(9, 40)).astype(np.float32)
    old = ann.EPSILON
    ann.EPSILON = 1e9
    try:
        a, b, d = ann.scan(x, ann._block_squares(x), np.arange(200), q, np.full(9, 1e9, np.float32), 5)
    finally:
        ann.EPSILON = old
    full = ((q[:, None] - x[None]) ** 2).sum(2)
    for i in range(9):
        assert set(b[a == i].tolist()) == set(np.argsort(full[i])[:5].tolist())


def test_recall_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    monkeypatch.setattr(ann, "LISTS_DIVISOR", 4)
    got = ann.nearest(spark.createDataFrame(rows_of(x), SCHEMA), k=10).collect()
    c = unit(x) @ unit(x).T
    np.fill_diagonal(c, -2)
    want = {i: set(np.argsort(-c[i])[:10].tolist()) for i in range(len(x))}
    hits = sum(r["neighbour_id"] in want[r["vec_id"]] for r in got)
    assert len(got) == 15000 and hits / 15000 >= 0.9
    for r in got[:200]:
        assert abs(c[r["vec_id"], r["neighbour_id"]] - r["cosine"]) < 1e-5


def test_ties_repeats_and_few_neighbours(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA).selectExpr("*", "1 as rank", "'x' as list")
    got = sorted((r["vec_id"], r["rank"], r["neighbour_id"]) for r in ann.nearest(df, k=10).collect())
    assert [g for g in got if g[0] == 1] == [(1, 1, 2), (1, 2, 3), (1, 3, 10)]
    assert [g for g in got if g[0] == 2] == [(2, 1, 1), (2, 2, 3), (2, 3, 10)]
    assert {g[0] for g in got} == {1, 2, 3, 10}


@pytest.mark.parametrize("part", [4096, 50])
def test_ties_go_by_id_whatever_the_order(spark, monkeypatch, part):
    monkeypatch.setattr(ann, "PART", part)
    monkeypatch.setattr(ann, "LISTS_DIVISOR", 4)
    rng = np.random.default_rng(2)
    rows = rows_of(np.full((500, 24), 0.3, np.float32)) + rows_of(rng.normal(size=(300, 24)), 1000)
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), list(map(float, v)), 0) for i, v, _ in rows], SCHEMA)
    got = [r for r in ann.nearest(df.repartition(5), k=3).collect() if r["vec_id"] < 1000]
    assert len(got) == 1500 and all(r["cosine"] > 0.999999 for r in got)
    for r in got:
        others = [i for i in range(4) if i != r["vec_id"]]
        assert r["neighbour_id"] == others[r["rank"] - 1]


@pytest.mark.parametrize("part", [4096, 3])
def test_queries_divisible_by_a_number_against_all_rows(spark, monkeypatch, part):
    monkeypatch.setattr(ann, "LISTS_DIVISOR", 4)
    monkeypatch.setattr(ann, "PART", part)
    x = np.random.default_rng(9).normal(size=(1500, 24)).astype(np.float32)
    df = spark.createDataFrame(rows_of(x, -100), SCHEMA)
    got = ann.nearest(df, k=10, every=50).collect()
    assert sorted((r["vec_id"], r["rank"]) for r in got) == [(i, k) for i in range(-100, 1400, 50) for k in range(1, 11)]
    c = unit(x) @ unit(x).T
    np.fill_diagonal(c, -2)
    assert sum(r["neighbour_id"] + 100 in np.argsort(-c[r["vec_id"] + 100])[:10] for r in got) / len(got) >= 0.9
    assert ann.nearest(df.where("vec_id % 50 <> 0"), every=50).count() == 0


def test_op2_asks_for_every_fiftieth_row(spark):
    folder = "/root/testdata/sf0.001"
    ids = [r["vec_id"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id % 50 = 0").collect()]
    got = registry.op2_ann(spark, folder).collect()
    assert sorted((r["vec_id"], r["rank"]) for r in got) == [(i, k) for i in sorted(ids) for k in range(1, 11)]


def brute_classes(rows, cosine):
    """Of rows (id, vector, label) whose vectors are all usable."""
    links = {r[0]: set() for r in rows}
    for a, b in brute_pairs(rows, cosine):
        links[a].add(b)
        links[b].add(a)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (min(seen), len(links[i]))
    return out


@pytest.mark.parametrize("cell, rows_of_a_block", [(40, 1 << 16), (4096, 1 << 16), (40, 30), (4096, 7)])
def test_classes_and_links_are_exact(spark, clustered, monkeypatch, cell, rows_of_a_block):
    monkeypatch.setattr(embed_dedup, "CELL", cell)
    monkeypatch.setattr(embed_dedup, "ROWS", rows_of_a_block)
    rows = rows_of(clustered)
    # copies under other ids, repeated rows, ids that have several vectors, and vectors by themselves
    rows += rows_of(np.random.default_rng(7).normal(size=(5, 16)), 3000) + rows_of(clustered[:60], 1000) + rows_of(clustered[:20], 2000) + rows[:30] + rows_of(clustered[100:130], 1040) + rows_of(clustered[5:15], 200)
    got = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in embed_dedup.classes(got, 0.97).collect()]
    want = brute_classes(rows, 0.97)
    assert sorted(got) == sorted((i, *x) for i, x in want.items())
    assert {x[1] for x in want.values()} >= {0, 1}


def test_classes_of_odd_vectors(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA).selectExpr("*", "1 as class_id", "2 as links", "3 as twice")
    alone = [(i, i, 0) for i in range(4, 11)]
    assert sorted(tuple(r) for r in embed_dedup.classes(df).collect()) == [(1, 1, 2), (2, 1, 2), (3, 1, 2), *alone]
    assert embed_dedup.classes(df.limit(0)).count() == 0


def test_op1_has_a_row_for_each_vector_and_agrees_with_its_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(6)
    x = np.concatenate([c + 0.02 * rng.normal(size=(9, 8)) for c in rng.normal(size=(5, 8))])
    spark.createDataFrame(rows_of(x), SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in registry.op1_embedding_near_dedup(spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(duck.execute(registry.OP1_SQL).fetchall()) and len(got) == 45 and max(r[2] for r in got) >= 8
