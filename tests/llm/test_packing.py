"""Windows against plain concatenation of what a public tokenizer gives."""

import random

import numpy as np
import pytest
import tiktoken

from factloom.llm import bpe, packing

SCHEMA = "doc_id long, text string, window_id int, pid int, place string, tokens int"
V = bpe.load_vocabulary()
KNOWN = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(V.tokens) if t is not None}, special_tokens={})
END = len(V.tokens)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "p", 3) for i, t in rows], SCHEMA)


def plain(spark, rows, length):
    """All tokens as (doc_id, number in the document, token), in windows. Documents of one doc_id
    are put in order by Spark's own hash."""
    own = [(i, KNOWN.encode_ordinary(t) + [END]) for i, t in rows if t]
    tokens = spark.createDataFrame([(k, bytearray(np.array(t, np.uint16).tobytes())) for k, (_, t) in enumerate(own)], "k int, t binary")
    place = {r[0]: r[1] for r in tokens.selectExpr("k", "shiftrightunsigned(xxhash64(t), 1)").collect()}
    stream = []
    for k in sorted(range(len(own)), key=lambda k: (own[k][0] is not None, own[k][0] or 0, place[k])):
        stream += [(own[k][0], n, x) for n, x in enumerate(own[k][1])]
    return [stream[k : k + length] for k in range(0, len(stream), length)]


@pytest.mark.parametrize("length, ranges, ids", [(4, 3, 60), (16, 7, 60), (1000, 3, 60), (7, 5, 2), (64, 1, 9)])
def test_equals_concatenation(spark, length, ranges, ids):
    rng = random.Random(length)
    rows = [(rng.choice([None, *range(ids)]), rng.choice([None, "", "  ", " ".join(rng.choice(["a", "bé", "c d", "e\n", "\tf", "日本語", "don't"]) for _ in range(rng.randrange(40)))])) for _ in range(150)]
    rows += [rows[0], (7, "xyz " * 5000), (7, "xyz " * 5000)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = packing.pack(frame(spark, rows), length).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = plain(spark, rows, length)
    assert sorted(r["window_id"] for r in got) == list(range(len(want)))
    for r in got:
        own = want[r["window_id"]]
        assert r["n_tokens"] == len(own) == sum(r["lengths"]) and r["tokens"] == [x for _, _, x in own]
        at = 0
        for d, s, n in zip(r["doc_ids"], r["doc_starts"], r["lengths"]):
            assert [x[:2] for x in own[at : at + n]] == [(d, s + k) for k in range(n)]
            at += n


def test_one_doc_id_holds_several_ranges():
    cuts = np.array([3, 5, 5, 5, 9])
    ids = np.array([1, 3, 4, 5, 5, 5, 6, 9, 10])
    places = np.array([0, 0, 0, 0, 1 << 62, (1 << 63) - 1, 0, 7, 0])
    assert packing.range_number(ids, places, cuts).tolist() == [0, 1, 1, 2, 3, 4, 4, 5, 5]


def test_empty_and_textless(spark):
    assert packing.pack(frame(spark, [])).count() == 0
    assert packing.pack(frame(spark, [(1, None), (None, "")])).count() == 0
    one = packing.pack(frame(spark, [(3, "a")])).collect()
    assert [tuple(r) for r in one] == [(0, 2, [3], [0], [2], [KNOWN.encode_ordinary("a")[0], END])]
