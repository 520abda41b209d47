import math
from collections import Counter, defaultdict
from hashlib import md5
from zlib import crc32

import regex
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline as C
from larkspur.llm import language, packing, pii
from larkspur.sources.storage import stored
from test_near_copies import plain_kept
from test_packing import checked, plain_ids
from test_pii import plain_base

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, []
    for name, stage in C.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        steps.append(docs)
    assert all(x.columns == columns for x in steps[:-1])
    given = spark.read.parquet(f"{SF}/documents.parquet").collect()

    one = {r.doc_id: r for r in steps[0].collect()}
    labels = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert set(one) == {r.doc_id for r in given if regex.search(r"\p{L}", r.text or "") and labels[r.doc_id][1] >= language.LEAST_SCORE}
    for r in given:
        assert r.doc_id not in one or one[r.doc_id] == Row(**r.asDict() | {"lang": r.lang or labels[r.doc_id][0]})

    two = {r.doc_id: r for r in steps[1].collect()}
    assert set(two) == plain_kept([(i, r.text) for i, r in one.items()]) and all(two[i] == one[i] for i in two)

    three = {r.doc_id: r for r in steps[2].collect()}
    assert set(three) == set(two)
    accepted = pii.fit(pii.vote_counts(steps[1]))
    for i, r in three.items():
        spans, text, at = pii.all_spans(two[i].text, accepted)[1], "", 0
        assert set(plain_base(two[i].text)) <= set(spans)
        for a, kind, b in spans:
            if a >= at:
                text += two[i].text[at:a] + f"<{pii.KINDS[kind].upper()}>"
            at = max(at, b)
        assert r.text == text + two[i].text[at:] and r.n_chars == len(r.text)

    sizes = Counter()
    for r in three.values():
        sizes[r.source] += len(r.text) + 1
    copies = {}
    for i, r in three.items():
        rate = sum(sizes.values()) / len(sizes) / sizes[r.source]
        u, n, cdf = int(md5(f"mix-1:{i}:1".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
        assert rate < 64
        while cdf <= u:
            n += 1
            cdf += math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))
        copies[i] = n
    four = Counter(r.doc_id for r in steps[3].collect())
    assert four == Counter({i: n for i, n in copies.items() if n})

    five, tokens = steps[4].collect(), defaultdict(int)
    for r in five:
        tokens[r.doc_id] += r.length
    assert dict(tokens) == {i: n * len(plain_ids(three[i].text)) for i, n in four.items()}
    single = steps[3].dropDuplicates(["doc_id"])
    checked(packing.pack(single).collect(), {i: three[i].text for i in four})


def test_odd_rows_pass_all_stages(spark):
    """Distinct texts of repeated or null ids all stay until mixing; rows without letters and equal texts go."""
    names = ["words of no id at all", "other words of no id", "the same words here and there", "unlike them: yet of that same id", "lang " * 30_000]
    rows = [(None, names[0], "en", "s", 5), (None, names[1], "en", "s", 5), (1, None, None, None, None), (2, "", "en", "s", 0), (3, names[2], "en", None, 3), (3, names[2], "en", None, 3), (3, names[3], None, "t", 3), (4, "1234 !!", "de", "t", 7), (5, names[4], None, "s", 150_000)]
    more = ["kept__id", "row__text", "doc", "found", "mix__rate", "copies", "start"]
    docs = spark.createDataFrame([(*r, *range(len(more))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in more))
    for given in (docs, docs.limit(0)):
        empty, given = given is not docs, given
        for name, stage in C.STAGES:
            given = stored(stage(spark, given, SF), name)
            if name != "packing":
                assert given.columns == docs.columns
            if empty:
                assert not given.count()
            elif name == "language_id":
                assert sorted(r.text for r in given.collect()) == sorted([*names, names[2]])
                assert {r.lang for r in given.collect()} == {"en"}
            elif name == "simhash_near_dedup":
                assert sorted(r.text for r in given.collect()) == sorted(names)
            elif name in ("pii", "mixing"):
                assert all(tuple(r)[5:] == tuple(range(len(more))) and r.text in names for r in given.collect())
        assert given.columns == packing.pack(docs).columns


def test_documents_of_a_table_without_languages_stay(spark):
    """No language is learned if ``lang`` is null everywhere, or only set in the held-out quarter."""
    held = next(i for i in range(100) if crc32(str(i).encode()) % 4 == 2)
    rows = [(held, "one of the held out texts", "s", 25), (200, "words about some other thing", "s", 28), (201, "12 !", "s", 4), (202, None, "s", None), (203, "漢字", "t", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    for lang in (F.lit(None).cast("string"), F.when(F.col("doc_id") == held, "en")):
        given = docs.withColumn("lang", lang)
        assert sorted(r.doc_id for r in C.identify_language(spark, given, SF).collect()) == sorted([held, 200, 203])
