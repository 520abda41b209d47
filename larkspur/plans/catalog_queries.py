"""Thresholds, lookups, batches, roles and score tables over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import sequence as E
from larkspur.operators import intervals as I
from larkspur.operators import metrics as X
from larkspur.operators import motifs as M
from larkspur.operators import relational as R
from larkspur.operators import sequences as S
from larkspur.plans import proxies as P
from larkspur.sources.files import folder_names
from larkspur.sources.storage import table


def _sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("concept")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


def a10_missing_tracks(spark, sf_dir):
    """Regions without any signal have a null track."""
    points = P.table(spark, sf_dir, "events").select(F.concat(F.lit("chr"), (F.col("user_id") % 5 + 1).cast("string")).alias("chrom"), (F.col("event_id").cast("long") * 97).alias("pos"), F.col("value").cast("double").alias("value"))
    sums = I.range_join(P.regions(spark, sf_dir), points).groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))
    return P.regions(spark, sf_dir).select("region_id").join(sums, "region_id", "left")


def a14_merge_consensus(spark, sf_dir):
    rows = P.motifs(spark, sf_dir)
    return M.merged_consensus([rows, rows.withColumn("motif", F.concat("motif", F.lit("_b")))])


def a16_folder_names(spark, sf_dir):
    folder = F.concat(F.regexp_replace("source", "src", "control_rep1_insert_"), F.lit("_control_"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", *folder_names(folder))


def a17_glob_names(spark, sf_dir):
    return _sources(spark, sf_dir).filter(F.col("concept").like("src1%")).select("concept", "n")


def b3_expand_regions(spark, sf_dir):
    return I.center_windows(P.regions(spark, sf_dir).drop("strand"), 196608)


def b16_normalise_tracks(spark, sf_dir):
    stats = P.signal(spark, sf_dir).groupBy("chrom").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    z = P.signal(spark, sf_dir).join(stats, "chrom").withColumn("z", (F.col("value") - F.col("mean")) / F.col("std"))
    return z.groupBy("chrom", "pos").agg(F.round(F.sum("z"), 5).alias("z"))


def b21_letter_decode(spark, sf_dir):
    digits = F.split(F.conv(F.col("doc_id").cast("string"), 10, 4), "")
    letters = F.transform(digits, lambda d: F.element_at(F.array(*map(F.lit, "ACGT")), d.cast("int") + 1))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(letters, "").alias("seq"))


def b23_base64(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.regexp_replace(F.base64(F.encode("url", "utf-8")), r"\s", "")).alias("uri_md5"))


def c9_clean_region_sequences(spark, sf_dir):
    """Sequences of regions of 40 along whole texts: those of unknown bases or beyond their text are left out."""
    rows = P.sequences(spark, sf_dir).withColumn("seq", F.when(F.col("seq_id") % 7 == 0, F.concat(F.repeat(F.lit("ACGN"), 12), "seq")).otherwise(F.col("seq")))
    rows = rows.filter("seq <> ''").withColumn("chrom", F.col("seq_id").cast("string"))
    starts = F.sequence(F.lit(0).cast("long"), F.length("seq").cast("long"), F.lit(40).cast("long"))
    regions = rows.select("seq_id", "chrom", F.explode(starts).alias("start")).withColumn("stop", F.col("start") + 40)
    return S.drop_unclean(S.region_sequences(regions, P.genome(rows, 256), 256)).select("seq_id", "start", "seq")


def d4_motif_lookup(spark, sf_dir):
    covariates = M.covariates(P.pwm(spark, sf_dir))
    counts = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("motif")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(covariates, "motif").select("motif", "n", "len", F.round("ic", 6).alias("ic"))


def e10_line_or_zero(spark, sf_dir):
    """Lines of length by id; the sources whose name ends in 0 have one point of x only, and so no line."""
    x = F.when(F.endswith("source", F.lit("0")), F.lit(1.0)).otherwise(F.col("doc_id").cast("double"))
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("name"), x.alias("x"), F.col("n_chars").cast("double").alias("y"))
    return X.line_fit(rows, "x", "y", "name").select("name", *[F.round(c, 5).alias(c) for c in ("slope", "intercept", "r2")])


def e17_reduce_attributions(spark, sf_dir):
    """Means over baselines, then sums over four channels, then over length: vectors as four rows of a quarter each."""
    quarter = F.floor(F.size("embedding") / 4).cast("int")
    channel = F.transform(F.sequence(F.lit(0), quarter - 1), lambda i: sum(F.element_at(F.col("embedding"), i + 1 + quarter * k).cast("double") for k in range(4)))
    each = table(spark, sf_dir, "embeddings").select("label", F.aggregate(channel, F.lit(0.0), lambda a, x: a + x).alias("total"))
    return each.groupBy("label").agg(F.round(F.avg("total"), 6).alias("mean_total"))


def e18_mean_predictions(spark, sf_dir):
    return P.predictions(spark, sf_dir).groupBy("truth").agg(F.round(F.avg(F.col("pred").cast("double")), 6).alias("mean_pred"))


def f5_fscore_threshold(spark, sf_dir):
    scores = X.fscores(P.predictions(spark, sf_dir), "source")
    return scores.filter(F.coalesce("fscore", F.lit(0.0)) >= 0.9).select("source", F.round("fscore", 6).alias("fscore"))


def f6_any_threshold(spark, sf_dir):
    return _sources(spark, sf_dir).filter(F.greatest(F.col("n") * 100, F.col("longest")) > 10_000)


def f7_positive_similarity(spark, sf_dir):
    """Vectors whose halves point the same way."""
    half = F.floor(F.size("embedding") / 2).cast("int")
    dot = F.aggregate(F.zip_with(F.slice("embedding", F.lit(1), half), F.slice("embedding", half + 1, half), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(dot, 6).alias("similarity")).filter("similarity > 0")


def g1_sorted_scores(spark, sf_dir):
    rows = R.numbered(_sources(spark, sf_dir).withColumn("down", -F.col("chars")), "down", "concept")
    return rows.withColumn("place", F.col("ordinal") + 1).drop("down", "ordinal")


def g7_mini_batches(spark, sf_dir):
    rows = R.numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return rows.withColumn("batch", F.floor(F.col("ordinal") / 64)).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def g10_sample_cap(spark, sf_dir):
    """How many samples per concept a matrix of 2^31 - 1 elements would hold."""
    sizes = table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding")).alias("d"), F.countDistinct("label").alias("k"))
    return sizes.select(F.floor(F.lit(2**31 - 1) / (F.col("d") * F.col("k"))).alias("cap"))


def g11_argsort(spark, sf_dir):
    rows = R.numbered(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), "n_chars", "doc_id", by=["lang"])
    return rows.select("lang", "doc_id", (F.col("ordinal") + 1).alias("place"))


def g12_natural_order(spark, sf_dir):
    number = F.regexp_extract("concept", "([0-9]+)", 1).cast("int")
    rows = R.numbered(_sources(spark, sf_dir).select("concept", number.alias("number")), "number", "concept")
    return rows.select("concept", (F.col("ordinal") + 1).alias("place"))


def h3_roles(spark, sf_dir):
    role = F.when(F.col("lang") == "en", "control").when(F.col("lang") == "es", "permuted").otherwise("test")
    return table(spark, sf_dir, "documents").select("source", role.alias("role")).filter("role <> 'permuted'").groupBy("role").agg(F.countDistinct("source").alias("concepts"), F.count(F.lit(1)).alias("n"))


def k4_paired_streams(spark, sf_dir):
    """Sequences of one source with the tracks of another, by place."""
    left = R.numbered(table(spark, sf_dir, "documents").filter("lang = 'fr'").select("doc_id"), "doc_id")
    right = R.numbered(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    return R.zipped(left, right)


def k6_auc_table(spark, sf_dir):
    """F-scores at three levels, wide, with their area, a covariate, the residual from it and the rank."""
    pr = P.predictions(spark, sf_dir)
    levels = [X.fscores(pr.withColumn("pred", F.when(F.col("doc_id") % 3 <= k, F.col("pred")).otherwise(1 - F.col("pred"))), "source").select("source", F.lit(float(12 * (k + 1))).alias("x"), F.col("fscore_macro").alias("y")) for k in range(3)]
    long = levels[0].unionByName(levels[1]).unionByName(levels[2])
    wide = long.groupBy("source").pivot("x", [12.0, 24.0, 36.0]).agg(F.first("y")).toDF("source", "f12", "f24", "f36")
    table_ = wide.join(X.trapezoid_area(long, "source", "x", "y"), "source").join(_sources(spark, sf_dir).select(F.col("concept").alias("source"), F.col("chars").cast("double").alias("covariate")), "source")
    fitted = X.residuals(table_, "covariate", "area")
    return fitted.select("source", *[F.round(c, 6).alias(c) for c in ("f12", "f24", "f36", "area")], "covariate", F.round("residual", 5).alias("residual"))


SRC = "src AS (SELECT source AS concept, count(*) AS n, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM documents GROUP BY source)"
F1S = """f{k} AS (SELECT source, {x}::DOUBLE AS x, avg(f) AS y FROM (SELECT source, cls, coalesce(2.0::DOUBLE * count(*) FILTER (pred = cls AND truth = cls) / nullif(count(*) FILTER (pred = cls) + count(*) FILTER (truth = cls), 0), 0) AS f
  FROM (SELECT doc_id, source, truth, CASE WHEN doc_id % 3 <= {k} THEN pred ELSE 1 - pred END AS pred FROM pr) pr, (VALUES (0), (1)) v(cls) GROUP BY source, cls) GROUP BY source)"""
ORACLE_SQL = {
    "a10_missing_tracks": f"WITH {P.REGIONS}, pts AS (SELECT concat('chr', user_id % 5 + 1) AS chrom, event_id::BIGINT * 97 AS pos FROM events), s AS (SELECT region_id, count(*) AS n FROM iv JOIN pts ON iv.chrom = pts.chrom AND pos >= start AND pos < stop GROUP BY region_id) SELECT iv.region_id, n FROM iv LEFT JOIN s ON iv.region_id = s.region_id",
    "a14_merge_consensus": f"WITH {P.MOTIFS} SELECT motif, consensus FROM motifs UNION ALL SELECT motif || '_b', consensus FROM motifs",
    "a16_folder_names": "SELECT doc_id, replace(source, 'src', '') AS concept, lang AS control FROM documents",
    "a17_glob_names": f"WITH {SRC} SELECT concept, n FROM src WHERE concept GLOB 'src1*'",
    "b3_expand_regions": f"WITH {P.REGIONS} SELECT region_id, chrom, (start + stop) // 2 - 98304 AS start, (start + stop) // 2 + 98304 AS stop FROM iv",
    "b16_normalise_tracks": f"WITH {P.SIGNAL}, s AS (SELECT chrom, avg(value) AS mean, stddev_pop(value) AS std FROM sig GROUP BY chrom) SELECT sig.chrom, pos, round(sum((value - mean) / std), 5) AS z FROM sig JOIN s ON sig.chrom = s.chrom GROUP BY 1, 2",
    "b21_letter_decode": "SELECT doc_id, translate(to_base(doc_id, 4), '0123', 'ACGT') AS seq FROM documents",
    "b23_base64": "SELECT page_id, md5(to_base64(encode(url))) AS uri_md5 FROM pages",
    "c9_clean_region_sequences": f"""WITH {P.SEQUENCES}, w AS (SELECT seq_id, CASE WHEN seq_id % 7 = 0 THEN repeat('ACGN', 12) || seq ELSE seq END AS whole FROM seqs),
      r AS (SELECT seq_id, whole, unnest(generate_series(0, length(whole) - 40, 40)) AS start FROM w) SELECT seq_id, start, substr(whole, start + 1, 40) AS seq FROM r WHERE NOT contains(substr(whole, start + 1, 40), 'N')""",
    "d4_motif_lookup": f"WITH {P.PWM}, i AS (SELECT motif, count(*) AS len, sum(2.0::DOUBLE + " + " + ".join(f"CASE WHEN {b} > 0 THEN {b} * log2({b}) ELSE 0.0::DOUBLE END" for b in M.BASES) + ") AS ic FROM pwm GROUP BY motif), c AS (SELECT lang AS motif, count(*) AS n FROM documents GROUP BY lang) SELECT c.motif, n, len, round(ic, 6) AS ic FROM c JOIN i ON c.motif = i.motif",
    "e10_line_or_zero": "WITH p AS (SELECT source AS name, CASE WHEN source LIKE '%0' THEN 1.0::DOUBLE ELSE doc_id::DOUBLE END AS x, n_chars::DOUBLE AS y FROM documents), m AS (SELECT name, avg(x) AS mx, avg(y) AS my FROM p GROUP BY name), c AS (SELECT p.name, any_value(mx) AS mx, any_value(my) AS my, sum((x - mx) * (x - mx)) AS xx, sum((x - mx) * (y - my)) AS xy, sum((y - my) * (y - my)) AS yy FROM p JOIN m ON p.name = m.name GROUP BY p.name) SELECT name, round(coalesce(xy / nullif(xx, 0), 0), 5) AS slope, round(coalesce(my - xy / nullif(xx, 0) * mx, 0), 5) AS intercept, round(CASE WHEN xx = 0 THEN 0.0::DOUBLE WHEN yy = 0 THEN 1.0::DOUBLE ELSE xy * xy / (xx * yy) END, 5) AS r2 FROM c",
    "e17_reduce_attributions": "WITH t AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT label, vec_id, sum(v) AS total FROM t GROUP BY 1, 2) SELECT label, round(avg(total), 6) AS mean_total FROM s GROUP BY label",
    "e18_mean_predictions": f"WITH {P.PREDICTIONS} SELECT truth, round(avg(pred::DOUBLE), 6) AS mean_pred FROM pr GROUP BY truth",
    "f5_fscore_threshold": f"WITH {P.PREDICTIONS}, f AS (SELECT source, coalesce(2.0::DOUBLE * count(*) FILTER (pred = 1 AND truth = 1) / nullif(count(*) FILTER (pred = 1) + count(*) FILTER (truth = 1), 0), 0) AS f FROM pr GROUP BY source) SELECT source, round(f, 6) AS fscore FROM f WHERE f >= 0.9::DOUBLE",
    "f6_any_threshold": f"WITH {SRC} SELECT * FROM src WHERE greatest(n * 100, longest) > 10000",
    "f7_positive_similarity": "WITH a AS (SELECT vec_id, len(embedding) // 2 AS h, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT x.vec_id, round(sum(x.v * y.v), 6) AS similarity FROM a x JOIN a y ON x.vec_id = y.vec_id AND y.i = x.i + x.h GROUP BY 1) SELECT * FROM s WHERE similarity > 0",
    "g1_sorted_scores": f"WITH {SRC} SELECT *, row_number() OVER (ORDER BY chars DESC, concept) AS place FROM src",
    "g7_mini_batches": "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents) SELECT (o // 64)::BIGINT AS batch, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM n GROUP BY 1",
    "g10_sample_cap": "SELECT (2147483647 // (max(len(embedding)) * count(DISTINCT label)))::BIGINT AS cap FROM embeddings",
    "g11_argsort": "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS place FROM documents",
    "g12_natural_order": f"WITH {SRC} SELECT concept, row_number() OVER (ORDER BY regexp_extract(concept, '([0-9]+)', 1)::INT, concept) AS place FROM src",
    "h3_roles": "SELECT CASE WHEN lang = 'en' THEN 'control' ELSE 'test' END AS role, count(DISTINCT source) AS concepts, count(*) AS n FROM documents WHERE lang <> 'es' GROUP BY 1",
    "k4_paired_streams": "WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents WHERE lang = 'fr'), b AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS ordinal FROM events) SELECT a.ordinal, doc_id, event_id, event_type FROM a JOIN b ON a.ordinal = b.ordinal",
    "k6_auc_table": f"WITH {P.PREDICTIONS}, {SRC}, " + ", ".join(F1S.format(k=k, x=12 * (k + 1)) for k in range(3)) + """,
      t AS (SELECT f0.source, f0.y AS f12, f1.y AS f24, f2.y AS f36, (12 * (f0.y + f1.y) / 2 + 12 * (f1.y + f2.y) / 2) / 24 AS area, chars::DOUBLE AS covariate FROM f0 JOIN f1 ON f0.source = f1.source JOIN f2 ON f0.source = f2.source JOIN src ON f0.source = concept),
      l AS (SELECT coalesce(regr_slope(area, covariate), 0) AS slope, coalesce(regr_intercept(area, covariate), 0) AS cut FROM t)
      SELECT source, round(f12, 6) AS f12, round(f24, 6) AS f24, round(f36, 6) AS f36, round(area, 6) AS area, covariate, round(area - slope * covariate - cut, 5) AS residual FROM t, l""",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
