"""Byte-level BPE against tiktoken, and exact round trips."""

import random

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import bpe

SIGNS = "ab st'strevdml  \n\t'AZ09.,!?é½²中 ß🙂\x1c\x85́ "
V = bpe.load_vocabulary()
KNOWN = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(V.tokens) if t is not None}, special_tokens={})
SPLIT = regex.compile(bpe.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=SIGNS, max_size=30), st.text(max_size=12)), max_size=6))
def test_words_and_tokens(rows):
    array = pa.array(rows, pa.string())
    data, off = bpe.utf8(array)
    starts, at = bpe.words(data, off)
    tokens, cut = bpe.encode_arrays(V, array)
    for i, t in enumerate(rows):
        ends = [*starts[at[i] + 1 : at[i + 1]], off[i + 1]]
        assert [bytes(data[a:b]).decode() for a, b in zip(starts[at[i] : at[i + 1]], ends)] == SPLIT.findall(t or "")
        own = tokens[cut[i] : cut[i + 1]].tolist()
        assert own == KNOWN.encode_ordinary(t or "")
        assert bpe.decode_tokens(V, own) == (t or "")


def test_runs_of_one_letter():
    rows = ["a" * n for n in range(1, 70)] + ["=" * 300, "ababab" * 40]
    tokens, cut = bpe.encode_arrays(V, pa.array(rows))
    for i, t in enumerate(rows):
        assert tokens[cut[i] : cut[i + 1]].tolist() == KNOWN.encode_ordinary(t)


def test_words_known_from_batches_before(monkeypatch):
    real = bpe.hash_spans
    # few different first hashes: words are told apart by the second one
    monkeypatch.setattr(bpe, "hash_spans", lambda data, s, e, base=None: real(data, s, e) % np.uint64(5) if base is None else real(data, s, e, base))
    encoder, rng = bpe.Encoder(V), random.Random(1)
    for _ in range(60):
        rows = [rng.choice([None, "", " ".join(rng.choice(["ab", "don't", "Strauß", "x1", "12", "日本", "zz" * rng.randrange(5)]) + str(rng.randrange(40)) for _ in range(rng.randrange(30)))]) for _ in range(5)]
        tokens, cut = encoder(pa.array(rows, pa.string()))
        for i, t in enumerate(rows):
            assert tokens[cut[i] : cut[i + 1]].tolist() == KNOWN.encode_ordinary(t or "")
    assert len(encoder.first) < 500


def test_other_vocabulary():
    v = bpe.load_vocabulary("/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    known = tiktoken.Encoding("m", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(v.tokens) if t is not None}, special_tokens={})
    t = "Grüße, señor! 你好 мир 12345"
    assert bpe.encode_arrays(v, pa.array([t]))[0].tolist() == known.encode_ordinary(t)


def test_tables(spark):
    long = "Lorem ipsum dolor's " * 60_000
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "x y"), (4, "same"), (4, "same"), (5, long)]
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, tokens int, n_tokens string")
    got = bpe.encode(df, verify=True)
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert by[2][0]["tokens"] is None and by[2][0]["round_trip"] is None and by[3][0]["tokens"] == [] and len(by[4]) == 2
    for i, t in rows:
        if t is not None:
            assert by[i][0]["tokens"] == KNOWN.encode_ordinary(t) and by[i][0]["round_trip"]
    back = {(r["doc_id"], r["text"]) for r in bpe.decode(got).collect()}
    assert back == set(rows)
    assert bpe.encode(df.limit(0)).count() == bpe.decode(got.limit(0)).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [99_999_999])], "doc_id long, tokens array<int>")).collect()
