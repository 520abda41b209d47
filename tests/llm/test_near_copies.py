import corpus_pipeline as C
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from larkspur.llm import near_copies as N
from larkspur.llm.fingerprints import sketches


def plain_shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def plain_kept(rows):
    """Ids of the least document of each component of Jaccard links."""
    sets, label = [plain_shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return {min(rows[i][0] for i in range(len(rows)) if label[i] == c) for c in set(label)}


def test_planted_copies_go(spark, monkeypatch):
    """Edited copies on both sides of the limit, in groups that are cut into chunks."""
    rng, rows = np.random.default_rng(5), []
    for size in (60, 200, 600):
        base = [f"w{x}" for x in rng.integers(0, 5000, size)]
        for edits in [0, 0, 1] + [max(1, round(size * share)) for share in (0.005, 0.01, 0.015, 0.02, 0.03, 0.05, 0.1)]:
            words = list(base)
            for at in rng.choice(size, edits, replace=False):
                words[at] = f"e{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(100, "a b"), (101, "A  b"), (102, ""), (103, " "), (104, "c d")]
    want = plain_kept(rows)
    assert 6 < len(want) < len(rows) - 15
    for cell in (N.CELL, 3):
        monkeypatch.setattr(N, "CELL", cell)
        docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
        assert sorted(r.doc_id for r in C.drop_near_duplicates(spark, docs, "").collect()) == sorted(want)


def test_close_simhashes_are_candidates(spark):
    """Points without a common band are candidates if their SimHashes differ in at most 3 bits, or in none."""
    rows = [(1, 0b1011 << 40, [1]), (2, 0b0011 << 40, [2]), (3, 0b0011 << 40, [3]), (4, -1, [4]), (5, None, []), (6, 0x7FFF << 40, [6])]
    points = spark.createDataFrame(rows, "fp long, sim long, bands array<long>")
    found = N.candidates(points).collect()
    assert {x for r in found for x in (r.u, r.v)} == {1, 2, 3} and len(found) >= 2


def met(cells):
    """Pairs of points that a task compares, and how many times each point is moved."""
    held, passing, moved = {}, {}, {}
    for r in cells.collect():
        (passing if r.side else held).setdefault((r.group, r.cell), set()).add(r.fp)
        moved[r.fp] = moved.get(r.fp, 0) + 1
    return {(min(a, b), max(a, b)) for c, xs in held.items() for a in xs for b in passing.get(c, ()) if a != b}, moved


def test_every_candidate_meets(spark, monkeypatch):
    """Leaders meet all of their bands; bands that aren't all linked go on, so that every pair of them that isn't linked meets."""
    monkeypatch.setattr(N, "CELL", 3)
    edges = spark.createDataFrame([(1, v) for v in range(2, 20)] + [(4, 5)], "u long, v long")
    pairs, moved = met(N.edge_cells(edges))
    assert pairs == {(1, v) for v in range(2, 20)} | {(4, 5)} and moved[1] == 6 and max(moved[v] for v in range(6, 20)) == 1
    rows = [(fp, 10, [7, 8] if fp < 30 else [7]) for fp in range(1, 40)] + [(100, 10, [9]), (101, 10, [9]), (102, 10, [9]), (200, 5, [11]), (201, 5, [11])]
    points = spark.createDataFrame(rows, "fp long, size long, bands array<long>")
    root = lambda fp: 55 if fp < 36 else fp
    linked = spark.createDataFrame([(fp, root(fp)) for fp in range(1, 40)], "node long, root long")
    pairs, _ = met(N.band_cells(points, linked))
    wanted = {(a, b) for a in range(2, 40) for b in range(a + 1, 40) if root(a) != root(b)} | {(101, 102)}
    assert wanted <= pairs and not any(a < 36 and b < 36 for a, b in pairs)  # band 8 and what is linked already stay at rest
    monkeypatch.setattr(N, "SHINGLES", 15)
    assert wanted <= met(N.band_cells(points, linked))[0]


def test_large_groups_move_each_text_a_few_times(spark):
    """20,000 near copies of one text: leaders link them all but five, which meet the others."""
    n = 20_000
    points = spark.range(n).select(F.col("id").alias("fp"), F.lit(300).cast("long").alias("size"), F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long")).alias("bands"))
    edges = spark.range(1, n).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    assert N.edge_cells(edges).count() <= n + n // N.CELL + 1
    linked = spark.range(n - 5).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("root"))
    moved = N.band_cells(points, linked).groupBy("fp").count().agg(F.max("count"), F.sum("count")).first()
    chunks = -(-n * 300 // N.SHINGLES) + n // N.CELL + 1
    assert moved[1] <= 3 * (n + 5 * chunks) and N.band_cells(points, linked).filter("side = 1").groupBy("fp").count().filter("count > 3").count() == 0


def test_comparison_links_what_is_connected():
    """Links of a cell connect what all pairs of held and passing sets connect, and are no more than points."""
    rng = np.random.default_rng(8)
    base = [[f"w{x}" for x in rng.integers(0, 10**6, 80)] for _ in range(6)]
    texts = [" ".join(w if rng.random() > 0.004 else f"e{rng.integers(10**9)}" for w in base[i % 6]) for i in range(60)]
    rows = [{"group": 1, "cell": 2, "side": int(i >= 25), "fp": i, "text": t} for i, t in enumerate(texts)] + [{"group": 1, "cell": 2, "side": 1, "fp": 3, "text": texts[3]}]
    out = [b for b in N._compared(iter([pa.RecordBatch.from_pylist(rows[:30]), pa.RecordBatch.from_pylist(rows[30:])]))]
    links = [(r["u"], r["v"]) for b in out for r in b.to_pylist()]
    sets = [plain_shingles(t) for t in texts]
    near = {(i, j) for i in range(25) for j in [*range(25, 60), 3] if i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}

    def groups(pairs):
        label = list(range(60))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return label

    same = lambda label: {(i, j) for i in range(60) for j in range(60) if label[i] == label[j]}
    assert set(links) <= near and same(groups(links)) == same(groups(near)) and len(links) < 70


def test_simhash_of_sets():
    [own] = sketches(pa.array([" ".join(f"w{i}" for i in range(300))]), N.ALL)
    bits = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in own) > len(own))
    assert N.sim(own) % 2**64 == bits and N.sim(own[:0]) is None
