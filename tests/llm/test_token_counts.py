import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from larkspur.llm import token_counts as C


@pytest.fixture(scope="module")
def lengths(spark):
    encode = C.encoder(public_tokenizers.path(C.VOCABULARY)).encode_ordinary
    return np.array([len(encode(r.text)) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_whole_table(spark, lengths, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 256)
    rows = C.op4_token_counts(spark, "/root/testdata/sf0.001").collect()
    asked = {(r.question, r["at"]): r.value for r in rows if r.question != "length"}
    assert asked == {("total", None): lengths.sum()} | {("truncated", float(x)): np.minimum(lengths, x).sum() for x in C.LIMITS} | {("quantile", q): np.sort(lengths)[int(np.ceil(q * len(lengths))) - 1] for q in C.QUANTILES}
    got = [r for r in rows if r.question == "length"]
    assert all((r["at"], r.value) == (r.n_tokens, r.tokens_truncated) for r in got)
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.n_tokens)] == sorted(set(lengths.tolist()))
    for r in got:
        longer = lengths[lengths >= r.n_tokens]
        assert (r.n_docs, r.docs_from, r.tokens_from) == ((lengths == r.n_tokens).sum(), len(longer), longer.sum())
        assert r.tokens_truncated == np.minimum(lengths, r.n_tokens).sum()


def test_answers(spark, lengths):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {(r.question, r["at"]): r.value for r in C.answers(C.length_histogram(docs), limits=(0, 100, 777, 10**6)).collect()}
    assert got["total", None] == lengths.sum()
    for limit in (0, 100, 777, 10**6):
        assert got["truncated", float(limit)] == np.minimum(lengths, limit).sum()
    for q in C.QUANTILES:
        assert got["quantile", q] == np.sort(lengths)[int(np.ceil(q * len(lengths))) - 1]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, None, 1), (None, "", 1), (2, "word", 1), (3, "a b " * 50_000, 1)], "doc_id long, text string, n_tokens int")
    got = {r.n_tokens: r.n_docs for r in C.length_histogram(docs).collect()}
    assert got[0] == 3 and sum(got.values()) == 5
    empty = C.length_histogram(docs.limit(0))
    assert C.suffix_sums(empty).count() == 0
    assert {(r.question, r.value) for r in C.answers(empty, limits=(5,)).collect()} == {("total", 0), ("truncated", 0), ("quantile", None)}


def test_documents_are_encoded_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    docs = spark.createDataFrame([(f"some words {i}",) for i in range(40)], "text string").withColumn("text", counted.asNondeterministic()("text"))
    assert C.answers(C.length_histogram(docs)).count() and seen.value == 40
