import numpy as np
import pytest

from larkspur.llm import neighbours as N


def brute(ids, vectors, queries, k=20):
    out = {}
    for q in queries:
        v = vectors[ids.index(q)]
        score = [(-float((np.array(w) * np.array(v)).sum()), i) for i, w in zip(ids, vectors) if i != q]
        out[q] = [(i, -s) for s, i in sorted(score)[:k]]
    return out


def listed(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_scores(spark, sf):
    """500 and 2,000 vectors: the same share is reranked as of larger tables."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    ids, vectors = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    got = listed(N.op3_neighbours(spark, f"/root/testdata/{sf}").collect())
    want = brute(ids, vectors.tolist(), [i for i in ids if i % 20 == 0])
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    at = {i: k for k, i in enumerate(ids)}
    assert all(abs(s - float(vectors[at[q]] @ vectors[at[i]])) < 1e-12 for q, x in got.items() for i, s in x)


def test_blocks_copies_and_ties(spark, monkeypatch):
    """If all is reranked the result is exact, over several blocks and chunks."""
    monkeypatch.setattr(N, "BLOCK", 64)
    monkeypatch.setattr(N, "CHUNK", 8)
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(300, 6)) * rng.uniform(0.1, 5, (300, 1))).round(3)
    vectors[50:150] = vectors[50]  # a third are copies
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    odd = [(1000, None, 0), (1020, [0.0] * 6, 0), (1040, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (1060, [float("nan")] + [1.0] * 5, 0), (1080, [float("inf")] + [1.0] * 5, 0), (1100, [1.0], 0), (None, [1.0] * 6, 0), (60, rows[60][1], 0)]
    given = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, id int")
    sound = N.usable(given, "vec_id", "embedding")
    got = listed(N.search(sound, sound.filter("id % 20 = 0"), depth=1.0).collect())
    want = brute(list(range(300)), vectors.tolist(), range(0, 300, 20))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    few = N.usable(given.filter("vec_id < 5 OR vec_id = 20"), "vec_id", "embedding")
    assert {q: len(x) for q, x in listed(N.search(few, few.filter("id % 20 = 0")).collect()).items()} == {0: 5, 20: 5}
    assert N.search(few.limit(0), few.limit(0)).count() == 0


def test_depth_is_measured_against_brute_force():
    """A block with more vectors than are reranked keeps the recall that the README states."""
    rng = np.random.default_rng(7)
    data = rng.normal(size=(8192, 64))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    pivots = N.lifted(data[:128], 1.0)
    block = N.Block(np.arange(8192), data, pivots, 1.0, 20)
    assert block.depth == 2048
    recalls = []
    for q in range(0, 8192, 200):
        ids, _ = block.best(q, data[q], N.places(np.r_[data[q], 0][None], pivots)[:, 0], 20)
        truth = np.argsort(-np.delete(data @ data[q], q), kind="stable")[:20]
        recalls.append(np.isin(np.delete(np.arange(8192), q)[truth], ids).mean())
    assert np.mean(recalls) >= 0.9
