"""The pipeline on a small folder: each stage against what its operator says of the same rows."""

import pytest
import tiktoken

import corpus_pipeline
from factloom.llm import bpe, packing

DOCS = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    out = {"documents": docs}
    for name, f in corpus_pipeline.STAGES:
        docs = out[name] = f(spark, docs, DOCS).cache()
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "secrets", "packing"]
    for n in ("quality", "toxicity", "near_dedup", "secrets"):
        assert stages[n].columns == stages["documents"].columns
    ids = {n: {r["doc_id"] for r in stages[n].select("doc_id").collect()} for n in list(stages)[:-1]}
    assert ids["documents"] > ids["quality"] > ids["toxicity"] > ids["near_dedup"] == ids["secrets"]


def test_labelled_documents(spark, stages):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DOCS}/labels.parquet").collect()}
    all_ = {r["doc_id"] for r in stages["documents"].collect()}
    kept = {r["doc_id"] for r in stages["quality"].collect()}
    good = [i for i in all_ if i in labels and labels[i]["quality"] == 1]
    assert sum(i in kept for i in good) / len(good) > 0.95


def test_windows_hold_all_tokens(stages):
    v = bpe.load_vocabulary()
    known = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(v.tokens) if t is not None}, special_tokens={})
    rows = sorted(stages["secrets"].collect(), key=lambda r: r["doc_id"])
    want = [x for r in rows if r["text"] for x in (known.encode_ordinary(r["text"]) + [len(v.tokens)])]
    windows = sorted(stages["packing"].collect(), key=lambda r: r["window_id"])
    assert [x for r in windows for x in r["tokens"]] == want
    assert {len(r["tokens"]) for r in windows[:-1]} == {packing.LENGTH}


def test_run_is_the_stages(spark, stages):
    got = {r["window_id"]: r["tokens"] for r in corpus_pipeline.run(spark, DOCS).collect()}
    assert got == {r["window_id"]: r["tokens"] for r in stages["packing"].collect()}


def test_odd_documents_go_through(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    rows = [(None, "a b c", None, None, None, 1), (1, None, None, None, None, 2), (2, "", "en", "s", 0, 3), (3, "x " * 50_000, "en", "s", 100_000, 4), (3, "x " * 50_000, "en", "s", 100_000, 5)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, f in corpus_pipeline.STAGES:
            docs = f(spark, docs, DOCS).cache()
            docs.count()
            assert name == "packing" or docs.columns[-1] == "extra"
