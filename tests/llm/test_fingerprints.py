import hashlib

import numpy as np
import pyarrow as pa

from larkspur.llm import fingerprints as P


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(a, b):
    half = len(a) // 2
    return a[: len(a) - half] + b[:half]


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 64)  # several buckets
    rows = sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in P.op7_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    errors, by_text = [], {}
    for r, after in zip(rows, rows[1:] + rows[:1]):
        g, e = got[r.doc_id], edited(r.text, after.text)
        assert g.n_chars == len(r.text) and g.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        errors += [abs(g.near_edited - jaccard(r.text, e)), abs(g.near_next - jaccard(r.text, after.text))]
        assert by_text.setdefault(r.text, g.fingerprint) == g.fingerprint
    assert np.mean(errors) < 0.03 and max(errors) < 0.2


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 3000, 6000)]
    a, b = words[:4000], words[2000:]
    one, two, all_ = P.sketches(pa.array([" ".join(a), " ".join(b), " ".join(words)]))
    assert np.array_equal(P.merged(one, two), all_)  # the overlap holds the seam's shingles
    sa, sb = shingles(" ".join(a)), shingles(" ".join(b))
    assert abs(P.resemblance(one, two) - len(sa & sb) / len(sa | sb)) < 0.15
    assert abs(P.containment(one, two) - len(sa & sb) / len(sa)) < 0.15
    assert abs(P.distinct_shingles(one) / len(sa) - 1) < 0.3
    small = P.sketches(pa.array(["a b c d e f g", "A b  c d e x", "", None, "one two"]))
    assert P.distinct_shingles(small[0]) == 3 and P.resemblance(small[0], small[1]) == 0.25 and len(small[2]) == len(small[3]) == 0 and len(small[4]) == 1
    assert P.resemblance(small[2], small[3]) == 1 and P.resemblance(small[2], small[0]) == 0
    assert np.array_equal(P.read(P.written(one)), one)


def test_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    marks = P.fingerprint(docs).join(docs.select("doc_id", "lang"), "doc_id").repartition(3)
    got = {r.lang: P.read(r.fingerprint) for r in P.merged_by(marks, "lang").collect()}
    for lang, sketch in got.items():
        whole = np.zeros(0, np.uint64)
        for r in docs.filter(docs.lang == lang).collect():
            whole = P.merged(whole, P.sketches(pa.array([r.text]))[0])
        assert np.array_equal(sketch, whole)


def test_edge_cases(spark):
    rows = [(5, "b b", 1), (5, "a", 1), (5, None, 1), (None, "null id é", 1), (9, "", 1), (9, "", 1), (7, "long text " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = sorted(str((r[0], len(r[1] or ""), hashlib.sha256(edited(r[1] or "", n[1] or "").encode()).hexdigest())) for r, n in zip(order, order[1:] + order[:1]))
    got = P.compare_with_edited(docs).collect()
    assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got) == want
    one = P.compare_with_edited(docs.filter("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(edited(rows[-1][1], rows[-1][1]).encode()).hexdigest()
    assert P.compare_with_edited(docs.limit(0)).count() == 0
