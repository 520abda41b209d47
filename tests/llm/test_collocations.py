import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import collocations as C


def pieces(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(docs, least, first):
    f, n = Counter(), Counter()
    for lang, text in docs:
        for p in pieces(text):
            n[lang or "und"] += len(p)
            f.update((lang or "und", tuple(p[i : i + k])) for i in range(len(p)) for k in (1, 2, 3, 4) if i + k <= len(p))
    often, out = {x: c for x, c in f.items() if c >= least and len(x[1]) > 1}, {}
    for (lang, ws), a in often.items():
        if any(la == lang and len(w) > len(ws) and 100 * c >= 80 * a and any(w[i : i + len(ws)] == ws for i in range(len(w))) for (la, w), c in often.items()):
            continue
        score, _, le, r = min((2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), le, r))
    return sorted((lang, rank, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, xs in out.items() for rank, x in enumerate(sorted(xs)[:first], 1))


def mined(spark, docs, first=C.FIRST, **how):
    rows = spark.createDataFrame([(lang, text) for lang, text in docs], "lang string, text string")
    found = C.collocations(rows.selectExpr("coalesce(lang, 'und') AS lang", "text"), first, C.Settings(**how))
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found.collect())


@pytest.mark.parametrize("bits", [None, 6])
def test_same_as_brute_force(spark, bits):
    """Several shards and languages, one with nothing; with six bits nearly all counters collide, and results stay exact."""
    rng = np.random.default_rng(2)
    docs = []
    for i in range(120):
        words = rng.choice(["New", "york", "CITY", "de", "la", "É", "x y", "\x00", "日本", "a.b", "c!"], rng.integers(0, 40)).tolist()
        docs.append((["en", "fr", None, "und"][i % 4], rng.choice([" ", "  ", " \t"]).join(words) + ("" if i % 3 else "\r\nNew York City! new york")))
    docs += [("en", None), (None, None), ("de", ""), ("de", "one two"), *[("en", "the same line, again and again")] * 5]
    want = brute(docs, 3, 25)
    assert len(want) > 60 and mined(spark, docs, 25, least=3, bits=bits, shard_bytes=900) == want


def test_very_long_text_and_nothing(spark):
    docs = [("en", "ab cd ef. " * 200_000 + "z" * 1_000_000), ("en", "cd" * 3)]
    assert mined(spark, docs) == brute(docs, 30, 2000)
    assert mined(spark, []) == [] and mined(spark, [("en", None), (None, "a b")]) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB .\n\téあ", max_size=12)), max_size=6))
def test_words_and_pieces(texts):
    found = C.words(pa.array(texts, pa.string()))
    got, names = [], [x.decode() for x in found.names.to_pylist()]
    for code, begins, text in zip(found.code, found.begins, found.of_text):
        if begins:
            got.append((int(text), []))
        got[-1][1].append(names[code])
    assert got == [(i, p) for i, t in enumerate(texts) for p in pieces(t) if p]


def test_states_stand_for_runs_that_end_at_the_same_places():
    """Of the shard ``x a b, x a b, a c``: ``x a`` is the state of ``x a`` alone, ``x a b`` also that of ``a b`` and ``b``."""
    shard = C.Shard(pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["x a b, x a b, a c"]}))
    one = C.roots(shard.symbol)
    two = C.grown(one, one, shard.begins, 2)
    three = C.grown(two, one, shard.begins, 3)
    names = [shard.names[int(i)].as_py().decode() for i in shard.name]
    states = {}
    for level, (longest, low) in zip((one, two, three), C.shortest([one, two, three])):
        for i in np.flatnonzero(longest):
            place = int(np.flatnonzero(level.at == i)[0])
            k = 1 + (level is two) + 2 * (level is three)
            states[" ".join(names[s] for s in shard.symbol[place : place + k])] = (int(low[i]), int(level.count[i]))
    assert states == {"x": (1, 2), "a": (1, 3), "x a": (2, 2), "x a b": (1, 2), "a c": (1, 1)}
