import numpy as np
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import simhash as S


def plain_simhash(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, threshold=3):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def test_anchors_cover(rng=np.random.default_rng(1)):
    """Any two fingerprints within 3 bits share an anchor that is home to one of them."""
    for _ in range(300):
        x = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        y = x
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            y ^= 1 << int(b)
        index, anchor, home = S.anchors(np.array([x, y], np.uint64))
        sets = [set(anchor[index == i].tolist()) for i in (0, 1)]
        homes = [set(anchor[(index == i) & home].tolist()) for i in (0, 1)]
        assert homes[0] & sets[1] or homes[1] & sets[0]


def test_pieces_do_not_change_fingerprints(monkeypatch):
    text = "Ab cD\t" * 50 + "é ß\nzz " * 40
    whole = S.simhash(text)
    monkeypatch.setattr(S, "PIECE", 16)
    assert S.simhash(text) == whole == plain_simhash(text)


def test_same_as_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op9_simhash(spark, "/root/testdata/sf0.001").collect()}
    fps = [plain_simhash(r.text) for r in rows]
    want = plain_components([r.doc_id for r in rows], fps)
    assert got == {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, want)}


def test_chunked_anchor_and_chains(spark, monkeypatch):
    """A hot group of near fingerprints, cut into chunks, and a chain that only joins by steps."""
    monkeypatch.setattr(S, "CELL", 8)
    rng = np.random.default_rng(3)
    base, fps = 0x0123456789ABCDEF, [0]
    for _ in range(60):
        fps.append(base ^ (1 << int(rng.integers(64))))
    chain = 0xF0F0F0F0F0F0F0F0
    for i in range(20):
        chain ^= 7 << (3 * i)
        fps.append(chain)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    pairs = S.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    names = {r.node: r.root for r in S.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = plain_components(list(range(len(fps))), fps)
    for i in range(len(fps)):
        for j in range(i):
            same = i == j or (signed[i] in names and names.get(signed[i]) == names.get(signed[j]))
            assert same == (want[i] == want[j])


def test_edge_cases(spark):
    rows = [(1, None, 5), (2, "", 6), (None, "a b c d", 7), (None, "a b c d", 7), (3, "One two", 8), (3, "one TWO", 8), (4, "x " * 60_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in S.near_duplicates(docs).collect())
    assert len(got) == 7
    by = {}
    for i, fp, c in got:
        by.setdefault(i, set()).add((fp, c))
    assert by["1"] == by["2"] == {(0, "1")} and {c for _, c in by["None"]} == {"None"} and len(by["3"]) == 1
    kept = S.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]
    assert S.near_duplicates(docs.limit(0)).count() == 0
    assert docs.filter(F.lit(False)).count() == 0


def test_unlinked_texts_keep_a_row_whatever_their_ids(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (1, texts[2]), (7, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4]), (None, texts[5]), (9, texts[5])]
    for parts in (1, 3):
        kept = S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        want = [(None, texts[0]), (None, texts[1]), (1, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[5])]
        assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, want))
