import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from larkspur.llm import language as L


def plain_viterbi(scores, switch):
    """Every path, for a few words."""
    n, k = scores.shape
    cost = lambda p: sum(scores[i, c] for i, c in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))
    return max(cost(p) for p in itertools.product(range(k), repeat=n)), cost


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 0, 6, 1, 5, 6])
    scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32) * 3
    path, at = L.viterbi(scores, lengths, 2.0), 0
    for n in lengths:
        if n:
            best, cost = plain_viterbi(scores[at : at + n], 2.0)
            assert abs(cost(path[at : at + n].tolist()) - best) < 1e-4
        at += n


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = L.op1_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def small_model():
    rows, totals = [], {}
    for lang, words, script in (("en", "the cat sat", "latin"), ("ru", "мир", "cyrillic"), ("xx", "der hund lief", "latin")):
        items = [g for w in words.split() for g in L.grams(w)]
        rows += [(lang, "gram", g, items.count(g) * 50) for g in sorted(set(items))] + [(lang, "script", script, 100)]
        totals |= {(lang, "gram"): (50 * len(items), len(set(items))), (lang, "script"): (100, 1)}
    return L.model_of(totals, rows)


def test_scores_of_words():
    """Against one word at a time, in plain Python."""
    model = small_model()
    words = ["the", "hund", "мир", "zzz", "漢字", "a", "x" * 60, "éthe"]
    got = L.word_scores(words, model)
    weight = {int(k): model.missing.copy() for k in model.keys}
    for i, k in enumerate(model.keys):
        for e in range(model.starts[i], model.starts[i + 1]):
            weight[int(k)][model.of[e]] += model.gains[e]
    for w, row in zip(words, got):
        open_ = [True, False, True] if w.isascii() or w[0] == "é" else [False, True, False] if w == "мир" else None
        if open_ is None:
            assert row.tolist() == [0, 0, 0]
            continue
        mean = np.mean([weight.get(L.gram_key(g), model.missing) for g in L.grams(w[:40])], axis=0) * min(len(w) + 1, 6)
        best = max(m for m, o in zip(mean, open_) if o)
        assert np.allclose(row, [max(m - best, L.WORST) if o else 2 * L.WORST for m, o in zip(mean, open_)], atol=1e-4)


def test_scripts_and_spans():
    texts = pa.array(["the cat sat the cat sat der hund lief der hund lief der", "мир der мир мир", "1 2 !", None, "漢字"])
    langs, scores, spans = L.labelled(texts, small_model())
    assert langs == ["xx", "ru", "und", "und", "en"] and scores[2] == scores[3] == 0
    assert [(s["lang"], s["start"], s["words"]) for s in spans[0]] == [("en", 0, 6), ("xx", 6, 7)]


def test_edge_cases(spark):
    rows = [(i, "the quick brown fox and the dog" if i % 2 else "der schnelle braune fuchs und hund", "en" if i % 2 else "de", "x") for i in range(60)]
    rows += [(100, None, "en", "x"), (101, "", None, "x"), (None, "12 34", None, "x"), (1, "the dog", None, "x"), (1, "the dog", None, "x"), (102, "und der hund " * 40_000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = L.identify(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.lang_pred)
    assert by[100] == by[101] == by[None] == ["und"] and by[102] == ["de"] and by[1] == ["en"] * 3
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    unlabelled = docs.withColumn("lang", docs.lang.substr(1, 0)).filter("lang <> ''")
    assert L.identify(unlabelled).count() == 0


def test_unspaced_runs_count_whole():
    """A change of language or script after the first 40 letters of a run is seen, and weighs by its letters."""
    assert L.pieces("cat") == ["cat"] and L.pieces("x" * 90) == ["x" * 40, "x" * 40, "x" * 10]
    assert L.pieces("мирcatмир") == ["мир", "cat", "мир"] and "".join(L.pieces("漢字かなmir" * 40_000)) == "漢字かなmir" * 40_000
    texts = pa.array(["thecatsat" * 5 + "derhundlief" * 60, "thecatsat" * 5 + "мир" * 200, "catмирcatcatcat"])
    langs, _, spans = L.labelled(texts, small_model())
    assert langs == ["xx", "ru", "en"]
    assert [s["lang"] for s in spans[1]] == ["en", "ru"]


def test_training_reads_whole_runs():
    rows = pa.RecordBatch.from_pydict({"text": ["thecatsat" * 5 + "q" * 3 + "мир" * 20], "lang": ["en"]})
    items = {(r["kind"], r["item"]) for out in L._counted(iter([rows])) for r in out.to_pylist()}
    assert {("gram", "qqq"), ("gram", "мир"), ("script", "cyrillic"), ("script", "latin")} <= items


def test_training_against_brute_force(spark, monkeypatch):
    """Counts of n-grams and scripts, one word at a time, of all languages; a model beyond its bound is an error."""
    rows = [(i, "Der Hund, der Hund und der HUND 3x" if i % 3 else "chat мир Ⅷ çà", "de" if i % 3 else "fr") for i in range(90)] + [(500 + i, "few", "aa") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    grams, scripts = Counter(), Counter()
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 == 2:
            continue
        for word, n in Counter(regex.findall(r"\p{L}+", text.lower())).items():
            scripts[lang, "cyrillic" if word == "мир" else "latin"] += n * len(word)
            for g in L.grams(word):
                grams[lang, g] += n
    made = L.training_rows(docs).mapInArrow(L._counted, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").sum("n").collect()
    assert {(r.lang, r["item"]): r["sum(n)"] for r in made if r.kind == "gram"} == grams
    assert {(r.lang, r["item"]): r["sum(n)"] for r in made if r.kind == "script"} == scripts
    model = L.fit(docs)
    assert model.languages == ["aa", "de", "fr"]
    for (lang, g), n in grams.items():
        i, of = np.searchsorted(model.keys, L.gram_key(g)), model.languages.index(lang)
        [e] = [e for e in range(model.starts[i], model.starts[i + 1]) if model.of[e] == of]
        own = [k for (x, _), k in grams.items() if x == lang]
        assert np.isclose(model.missing[of] + model.gains[e], np.log((n + 0.5) / (sum(own) + len(own) + 1)), atol=1e-5)
    monkeypatch.setattr(L, "MODEL_GRAMS", 3)
    with pytest.raises(ValueError, match="n-grams"):
        L.fit(docs)
    monkeypatch.setattr(L, "LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        L.training_rows(docs)


def test_many_languages_take_sparse_scores():
    """A model of 300 languages: words of each are found, without a number for every pair of n-gram and language."""
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + x) for x in rng.integers(0, 26, 9)) for _ in range(300)]
    rows, totals = [], {}
    for i, w in enumerate(words):
        items = Counter(L.grams(w))
        rows += [(f"l{i:03}", "gram", g, n) for g, n in items.items()] + [(f"l{i:03}", "script", "latin", 9)]
        totals |= {(f"l{i:03}", "gram"): (sum(items.values()), len(items)), (f"l{i:03}", "script"): (9, 1)}
    model = L.model_of(totals, rows)
    assert len(model.gains) == len(model.of) < 300 * 30
    assert L.labelled(pa.array([f"{w} {w}" for w in words]), model)[0] == [f"l{i:03}" for i in range(300)]


def test_filter_labels_and_rejects(spark):
    rows = [(i, "the quick brown fox and the dog" if i % 2 else "der schnelle braune fuchs und hund", "en" if i % 2 else "de", "x") for i in range(60)]
    rows += [(100, "the dog and the fox", None, "x"), (101, "12 34", None, "x"), (102, "der hund und der fuchs", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, found string")
    got = {r.doc_id: r.lang for r in L.keep_identified(docs).collect()}
    assert got == {i: "en" if i % 2 else "de" for i in range(60)} | {100: "en", 102: "de"}
    assert {r.doc_id for r in L.keep_identified(docs, ["de"]).collect()} == {*range(0, 60, 2), 102}
    assert L.keep_identified(docs, least=1.1).count() == 0
