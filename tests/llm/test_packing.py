import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import packing as P

PATH = public_tokenizers.path(P.VOCABULARY)


def plain_ids(text):
    return [*P.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids, P.END_ID]


def checked(rows, texts):
    """Each id in one piece, sequences without gaps, little padding; texts by doc_id."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        ids, at = plain_ids(texts[d]), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    open_ = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and len({r.window for r in own}) == 1
        open_ += at != own[0].window
    return open_


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert checked(P.op5_packing(spark, "/root/testdata/sf0.01").collect(), {r.doc_id: r.text for r in docs.collect()}) <= 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB é'ß́\n\t  Σ1.,-<|>s世İ\u0958\ufb2a\u0307!*", max_size=30), max_size=8))
def test_ids_are_the_tokenizers(texts):
    texts = texts + ["it's <|endoftext|> X", "ΟΔΟΣ ΟΔΟΣ"]
    assert [x.tolist() for x in P.encoded(pa.array(texts, pa.string()), PATH)] == [plain_ids(t) for t in texts]


def test_ids_are_the_tokenizers_for_every_letter():
    """Letters that end in a mark once normalised take punctuation with them."""
    letters = [c for c in map(chr, range(0x20000)) if c.isalpha()]
    texts = [f"x{c}, y{c}. {c}! ab{c}" for c in letters]
    for i in range(0, len(texts), 20_000):
        some = texts[i : i + 20_000]
        want = [[*e.ids, P.END_ID] for e in P.tokenizer(PATH).encode_batch_fast(some, add_special_tokens=False)]
        assert [x.tolist() for x in P.encoded(pa.array(some), PATH)] == want
    [got] = P.encoded(pa.array(["ALİ, VELİ. GELDİ, x"]), PATH)
    assert got.tolist() == plain_ids("ALİ, VELİ. GELDİ, x") and len(got) == 15


def test_other_tokenizers_get_texts_as_they_are():
    path, texts = public_tokenizers.path("byte_bpe_50k.json"), ["One  two,\n three. ", "", "Été, 12"]
    want = [[*P.tokenizer(path).encode(t, add_special_tokens=False).ids, P.END_ID] for t in texts]
    assert [x.tolist() for x in P.encoded(pa.array(texts), path)] == want


@pytest.mark.parametrize("seed", range(4))
def test_windows_are_full(seed):
    rng = np.random.default_rng(seed)
    rests = [(d, 0, int(n)) for d, n in enumerate(rng.integers(1, 2048, 700))]
    windows, left = P.pack_rests(rests)
    assert all(sum(n for _, _, n in pieces) == tier for tier, pieces in windows)
    assert sum(n for _, _, n in left) < 2048
    last = P.close(left)
    assert all(sum(n for _, _, n in pieces) == tier for tier, pieces in last[:-1])
    got = defaultdict(int)
    for _, pieces in windows + last:
        for d, _, n in pieces:
            got[d] += n
    assert got == {d: n for d, _, n in rests}


def test_every_tier_packs_its_own():
    rng = np.random.default_rng(9)
    sizes = [*rng.integers(1, 257, 900), *rng.integers(400, 513, 30), *rng.integers(900, 1025, 15), *rng.integers(1100, 2048, 5)]
    windows, _ = P.pack_rests([(d, 0, int(n)) for d, n in enumerate(sizes)])
    assert {t for t, _ in windows} == {256, 512, 1024, 2048}
    assert sum(len(pieces) for _, pieces in windows) <= len(sizes) + len(windows)  # a cut per window at most


def test_units_steps_and_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(P, "CACHE_BYTES", 500)
    rows = [(1, None, 0), (2, "", 0), (3, "a b c " * 30_000, 0), (4, "One two", 0)] + [(i, "word " * (i % 700), 0) for i in range(10, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").coalesce(2)
    got = P.pack(docs).collect()
    assert checked(got, {r[0]: r[1] for r in rows}) <= 2
    steps = defaultdict(set)
    for r in got:
        steps[r.step_group].add((r.window, r.sequence_id))
    short = Counter()
    for own in steps.values():
        [tier] = {w for w, _ in own}
        assert sum(w for w, _ in own) <= P.STEP_TOKENS
        short[tier] += sum(w for w, _ in own) < P.STEP_TOKENS
    assert len({r.sequence_id >> P.LOCAL_BITS for r in got}) == 2 and max(short.values()) == 1
    twice = spark.createDataFrame([(7, "x y"), (7, "x y"), (None, "z")], "doc_id long, text string")
    again = P.pack(twice).collect()
    assert sorted((str(r.doc_id), r.length) for r in again) == [("7", 3), ("7", 3), ("None", 2)]
    assert P.pack(docs.limit(0)).count() == 0
