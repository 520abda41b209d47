"""Mixing sources to target weights by Poisson replication.

A source of weight ``w`` and size ``s`` (characters, and one more for each document) is to fill the
share ``w`` of a total ``T``, so its documents are repeated ``w * T / s`` times on average. Each
document's number of copies is the inverse of that Poisson distribution at a uniform number hashed
from the seed and the document's id, so it depends on nothing else. Copies are then dealt in the
order of another hash, a shuffle over the whole cluster: as that hash is uniform, its leading bits say which
partition a copy goes to, and each partition is sorted for itself.

A Poisson variable of mean over ``STEP_RATE`` is the sum of several of equal, smaller means, each with a
hash of its own, so tables of the distribution stay short and rates have no bound.

Edge cases: null sources are one source; null ids hash as the empty string; rows that repeat an id get
equal numbers of copies, whose ties in the order go by copy and text; null and empty texts have size 1; sources without a weight, or of weight
0, give no copies; an empty table gives an empty one. Where a column of the documents begins like the added
ones, these get further underscores after ``mix__``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspur.sources.storage import stored, table

#: The largest mean that one table of the distribution has; its table has under 170 entries.
STEP_RATE = 64.0
#: Sources up to this number are broadcast (at 1.4 KB each); beyond, documents are shuffled by source.
BROADCAST_SOURCES = 2_000
SEED = "mix-1"
OWN = "mix__"  # of columns beside the document's own


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) of 52 bits, hashed from the parts."""
    text = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None) -> DataFrame:
    """``source, size, rate`` of each source with a weight; equal weights by default."""
    sizes = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit(""))) + F.lit(1)).alias("size"))
    sizes = stored(sizes, "sizes")
    sums = sizes.agg(F.sum("size").alias("all"), F.count(F.lit(1)).alias("n")).first()
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0 / max(1, sums.n)))
    else:
        kept = {k: float(w) for k, w in weights.items() if w > 0}
        given = docs.sparkSession.createDataFrame([(k, w / sum(kept.values())) for k, w in kept.items()], "name string, weight double")
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("name")))
    goal = F.lit(float((sums["all"] or 0) if total is None else total))
    return sizes.select("source", "size", (F.col("weight") * goal / F.col("size")).alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """``source, rate, steps, cdf``: each of ``steps`` parts has the cumulative distribution ``cdf``."""
    parts = rates.withColumn("steps", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP_RATE))).withColumn("mean", F.col("rate") / F.col("steps"))
    last = F.ceil(F.col("mean") + 10 * F.sqrt("mean") + 25).cast("int")
    by = W.partitionBy("source").orderBy("k")
    return (
        parts.select("source", "rate", "steps", "mean", F.explode(F.sequence(F.lit(0), last)).alias("k"))
        .withColumn("log_factorial", F.sum(F.when(F.col("k") > 0, F.log("k")).otherwise(0.0)).over(by))
        .withColumn("cdf", F.sum(F.exp(F.col("k") * F.log("mean") - F.col("mean") - F.col("log_factorial"))).over(by))
        .groupBy("source", "rate", "steps")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "cdf"))), lambda x: x["cdf"]).alias("cdf"))
    )


def prefix(columns: Sequence[str]) -> str:
    """What names of added columns begin with: OWN, lengthened until no column has it."""
    found = OWN
    while any(c.lower().startswith(found) for c in columns):
        found += "_"
    return found


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None, seed: str = SEED) -> DataFrame:
    """The documents' columns, ``mix__rate``, ``mix__copies``, ``mix__copy`` (from 1) and ``mix__order``,
    one row per copy, sorted by ``mix__order`` over all partitions."""
    rates = stored(poisson_tables(source_rates(docs, weights, total)), "rates")
    n, own = rates.count(), prefix(docs.columns)
    tables = rates.select(F.struct("source", "rate", "steps", "cdf").alias("given"))
    flat = {c: f"{own}{i}" for i, c in enumerate(docs.columns)}  # one by one, so that columns nobody asks for aren't shuffled
    rows = docs.select(*(F.col(f"`{c}`").alias(name) for c, name in flat.items()))
    joined = rows.join(F.broadcast(tables) if n <= BROADCAST_SOURCES else tables, F.col(flat["source"]).eqNullSafe(F.col("given.source")))
    key = F.coalesce(F.col(flat["doc_id"]).cast("string"), F.lit(""))
    below = lambda j: F.size(F.filter(F.col("given.cdf"), lambda c: c <= uniform(F.lit(seed), key, j.cast("string"))))
    copies = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("given.steps").cast("long")), F.lit(0).cast("long"), lambda a, j: a + below(j))
    counted = joined.select(*flat.values(), F.xxhash64(flat["text"]).alias("tie"), F.col("given.rate").alias("rate"), copies.alias("copies")).filter("copies > 0")
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    ordered = each.withColumn("order", F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), key, F.col("copy").cast("string"))), 1, 16))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leading = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    dealt = ordered.repartitionById(parts, F.floor(leading * F.lit(parts) / F.lit(2**32)).cast("int"))
    sorted_ = dealt.sortWithinPartitions("order", "copy", "tie")
    return sorted_.select(*(F.col(name).alias(c) for c, name in flat.items()), *(F.col(c).alias(f"{own}{c}") for c in ("rate", "copies", "copy", "order")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal shares for all sources at the corpus's own size."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", F.round(f"{OWN}rate", 6).alias("rate"), F.col(f"{OWN}copies").alias("copies"), F.col(f"{OWN}copy").alias("copy_no"), F.col(f"{OWN}order").alias("order_key"))


OP2_SQL = f"""
WITH s AS (SELECT source, sum(length(coalesce(text, '')) + 1)::BIGINT AS size FROM documents GROUP BY source),
r AS (SELECT source, (1.0::DOUBLE / count(*) OVER ()) * (sum(size) OVER ())::DOUBLE / size AS rate FROM s),
p AS (SELECT source, rate, greatest(1, ceil(rate / {STEP_RATE}::DOUBLE))::BIGINT AS steps FROM r),
m AS (SELECT source, rate, steps, rate / steps AS mean FROM p),
k AS (SELECT source, rate, steps, mean, unnest(generate_series(0, ceil(mean + 10 * sqrt(mean) + 25)::INT)) AS k FROM m),
f AS (SELECT *, sum(CASE WHEN k > 0 THEN ln(k::DOUBLE) ELSE 0.0::DOUBLE END) OVER (PARTITION BY source ORDER BY k) AS lf FROM k),
c AS (SELECT source, rate, steps, k, sum(exp(k * ln(mean) - mean - lf)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM f),
t AS (SELECT source, rate, steps, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source, rate, steps),
d AS (SELECT row_number() OVER () AS i, doc_id, d.source, rate, cdf, unnest(generate_series(1, steps)) AS j FROM documents d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT i, doc_id, source, rate, len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, ''), j::VARCHAR)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)) AS n FROM d),
n AS (SELECT doc_id, source, rate, sum(n)::BIGINT AS copies FROM u GROUP BY i, doc_id, source, rate),
e AS (SELECT doc_id, source, rate, copies, unnest(generate_series(1, copies)) AS copy_no FROM n)
SELECT doc_id, source, round(rate, 6) AS rate, copies, copy_no, substr(md5(concat_ws(':', '{SEED}-order', coalesce(doc_id::VARCHAR, ''), copy_no::VARCHAR)), 1, 16) AS order_key FROM e
"""

QUERIES = {"op2_mixing": op2_mixing}
ORACLE_SQL = {"op2_mixing": OP2_SQL}
