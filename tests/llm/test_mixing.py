import math
from collections import Counter
from hashlib import md5

from pyspark.sql import functions as F

from larkspur.llm import mixing as M


def plain_copies(doc_id, rate, seed="mix-1"):
    """Copies by the inverse of the distribution, for means up to one table."""
    u, n, cdf = int(md5(f"{seed}:{'' if doc_id is None else doc_id}:1".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
    while cdf <= u:
        n += 1
        cdf += math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))
    return n


def test_edge_cases(spark):
    rows = [(i, f"text {i}", "a" if i % 3 else None, 1.5, i) for i in range(90)]
    rows += [(5, "text 5", "a", None, 0), (None, None, "a", None, 0), (200, "", "b", None, 0), (201, "long " * 50_000, "c", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate double, copies long")
    mixed = M.mix(docs)
    assert mixed.columns == [*docs.columns, "mix__rate", "mix__copies", "mix__copy", "mix__order"]
    got = mixed.collect()
    sizes = Counter()
    for _, text, source, *_ in rows:
        sizes[source] += len(text or "") + 1
    want = Counter()
    for doc_id, _, source, *_ in rows:
        rate = sum(sizes.values()) / 4 / sizes[source]
        if rate < M.STEP_RATE:
            want[doc_id, source] += plain_copies(doc_id, rate)
    assert Counter((r.doc_id, r.source) for r in got if r["mix__rate"] < M.STEP_RATE) == +want
    tiny = [r for r in got if r.source == "b"]  # over a thousand copies on average, in several steps
    rate = tiny[0]["mix__rate"]
    assert rate > 10_000 and abs(len(tiny) - rate) < 6 * math.sqrt(rate) and len({r["mix__copy"] for r in tiny}) == len(tiny)
    order = [r["mix__order"] for r in got]
    assert order == sorted(order)
    assert M.mix(docs.limit(0)).count() == 0


def test_weights_and_means(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.when(F.col("id") % 4 == 0, "x").when(F.col("id") % 4 == 1, "y").otherwise("z").alias("source"))
    n = {r.source: r["count"] for r in M.mix(docs, {"x": 3.0, "z": 1.0, "none": 2.0, "y": 0.0}, total=40_000 * 4).groupBy("source").count().collect()}
    assert set(n) == {"x", "z"}  # shares 1/2 and 1/6; the source that isn't there has its own
    assert abs(n["x"] - 20_000) < 800 and abs(n["z"] - 6_667) < 500


def test_same_over_any_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    one, two = (sorted((r.doc_id, r["mix__copy"]) for r in M.mix(d).collect()) for d in (docs, docs.repartition(7)))
    assert one == two


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "s", i, "x") for i in range(50)], "doc_id long, text string, source string, mix__rate long, `mix__order` string")
    got = M.mix(docs)
    assert got.columns == [*docs.columns, "mix___rate", "mix___copies", "mix___copy", "mix___order"]
    assert all(r["mix__rate"] == r.doc_id and r["mix__order"] == "x" for r in got.collect())


def test_partitions_are_ranges_of_the_order(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.lit("s").alias("source"))
    mixed = M.mix(docs, total=12_000.0 * 3)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = Counter(r.p for r in mixed.select(F.spark_partition_id().alias("p")).collect())
    assert len(sizes) == parts and max(sizes.values()) < 1.2 * min(sizes.values())
    order = [r["mix__order"] for r in mixed.collect()]
    assert order == sorted(order)
