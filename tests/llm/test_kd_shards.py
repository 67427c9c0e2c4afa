"""K-d shards against a tree grown in plain Python."""

import random

import pytest

from factloom.llm import kd_shards
from factloom.llm.kd_shards import LOW

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, bytes int, d0 int"


def grown(points, weights, target):
    """Groups of row numbers, in the order of the tree."""
    spread = None

    def split(rows):
        nonlocal spread
        total = sum(weights[i] for i in rows)
        if total <= target:
            return [rows]
        extent = []
        for d in range(4):
            values = [points[i][d] for i in rows]
            real = [v for v in values if v > LOW]
            extent.append(0 if not real else max(real) - (min(real) - 1 if LOW in values else min(real)))
        spread = spread or [max(e, 1) for e in extent]
        d = max(range(4), key=lambda k: (extent[k] / spread[k], -k))
        if not extent[d]:
            return [rows]
        values = sorted({points[i][d] for i in rows})
        real = [v for v in values if v > LOW]
        lows = [real[0] - 1] if LOW in values else []
        for at in lows + real:
            if sum(weights[i] for i in rows if points[i][d] <= at) >= total / 2 or at == (lows + real)[-2]:
                break
        return split([i for i in rows if points[i][d] <= at]) + split([i for i in rows if points[i][d] > at])

    return split(list(range(len(points))))


def ranks(texts):
    order = {t: i for i, t in enumerate(sorted({t for t in texts if t is not None}, key=str.encode))}
    return [LOW if t is None else order[t] for t in texts]


def shards_of(got):
    sizes = {}
    for r in got:
        sizes.setdefault(r["shard"], []).append((r["doc_id"], r["bytes"]))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    return [sorted(sizes[k], key=key) for k in sorted(sizes)]


@pytest.mark.parametrize("rows_of_a_task", [1 << 16, 60, 1])
def test_equals_plain_tree(monkeypatch, spark, rows_of_a_task):
    monkeypatch.setattr(kd_shards, "ROWS", rows_of_a_task)
    rng = random.Random(6)
    rows = []
    for i in range(400):
        text = "é" * rng.randrange(0, 400) if rng.random() > 0.02 else None
        # the sources share their first signs
        rows.append((i if rng.random() > 0.02 else None, text, rng.choice(["en", "de", None]), rng.choice(["https://a"] * 5 + [f"https://b{k}" for k in range(9)]), len(text) if text is not None else None, 1, 2, 3))
    rows += [rows[10]] * 3
    got = kd_shards.assign_shards(spark.createDataFrame(rows, SCHEMA), target=9000).collect()
    assert len(got) == len(rows)
    weights = [2 * len(r[1] or "") for r in rows]
    points = list(zip([r[4] if r[4] is not None else LOW for r in rows], ranks([r[2] for r in rows]), ranks([r[3] for r in rows]), [r[0] if r[0] is not None else LOW for r in rows]))
    want = grown(points, weights, 9000)
    sizes = shards_of(got)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sizes == [sorted(((rows[i][0], weights[i]) for i in g), key=key) for g in want]
    assert len(sizes) > 10 and max(sum(b for _, b in v) for v in sizes) <= 9000


def test_sources_with_a_common_beginning_are_told_apart(spark):
    rows = [(1, "x" * 100, "en", f"commoncrawl-{k}", 100, 0, 0, 0) for k in range(16)]
    got = kd_shards.assign_shards(spark.createDataFrame(rows, SCHEMA), target=100).collect()
    assert sorted(r["shard"] for r in got) == list(range(16))


def test_ties_stay_together_and_empty_tables(spark):
    same = [(1, "x" * 100, "en", "s", 100, 0, 0, 0)] * 50
    got = kd_shards.assign_shards(spark.createDataFrame(same, SCHEMA), target=10).collect()
    assert {r["shard"] for r in got} == {0} and len(got) == 50
    assert kd_shards.assign_shards(spark.createDataFrame([], SCHEMA)).count() == 0
    bare = spark.createDataFrame([(i, "y" * 10) for i in range(20)], "doc_id long, text string")
    assert len({r["shard"] for r in kd_shards.assign_shards(bare, target=50).collect()}) == 4


def test_clashing_names(spark):
    names = ["doc_id", "node", "tree", "kind", "value", "place", "range", "rank_lang", "rank_source", "_d0"]
    df = spark.createDataFrame([(i, "y" * 10, "en", f"s{i % 3}", 10, 0, 0, 0, *[-i] * len(names)) for i in range(20)], SCHEMA.replace("doc_id", "`page id`") + "".join(f", {n} int" for n in names))
    got = kd_shards.assign_shards(df, target=50, id_col="page id").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(20)) and all(len(x) <= 5 for x in shards_of(got))


@pytest.mark.parametrize("rows_of_a_task", [1 << 16, 4])
def test_write_keeps_a_column_shard(monkeypatch, spark, tmp_path, rows_of_a_task):
    monkeypatch.setattr(kd_shards, "ROWS", rows_of_a_task)
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard int, node string"
    rows = [(i if i else None, "z" * 10, "en", "s", 10, 5, f"n{i}") for i in range(40)] + [(50, None, None, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, schema)
    name = kd_shards.write_shards(df, str(tmp_path / "out"), target=100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "_shard" and sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect()))
    assert back.groupBy(name).agg({"text": "count"}).where("`count(text)` > 10").count() == 0 < 3 < back.select(name).distinct().count()
    kd_shards.write_shards(df.limit(0), str(tmp_path / "none"), target=100)
