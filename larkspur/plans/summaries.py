"""What finished runs are summed up by: classifiers by their predictions, slopes over insertion counts, log ratios of several attributions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import metrics as X
from larkspur.operators import vectors as V
from larkspur.plans import proxies as P
from larkspur.plans.file_queries import _path
from larkspur.sources import files
from larkspur.sources.storage import table

#: Added to shares before their ratio.
PSEUDO = 0.01


def classifier_summary(predictions: DataFrame, *by: str) -> DataFrame:
    """``*by, fscore, precision_0, recall_0, support_0, precision_1, ...``: a row per classifier; ``fscore`` is the mean over both classes.

    ``predictions`` has ``pred, truth`` of 0 or 1, and ``by``, the columns that name a classifier; nulls there are a name like others.
    """
    each = X.class_scores(predictions.withColumn("of__", F.struct(*by)), "of__")
    wide = [F.max(F.when(F.col("cls") == cls, F.col(c))).alias(f"{c}_{cls}") for cls in (0, 1) for c in ("precision", "recall", "support")]
    return each.groupBy("of__").agg(F.avg("f1").alias("fscore"), *wide).select("of__.*", "fscore", *[f"{c}_{cls}" for cls in (0, 1) for c in ("precision", "recall", "support")])


def insertion_predictions(spark: SparkSession, folders: Mapping[int, str]) -> DataFrame:
    """``insertions, concept, control, pred, truth``: prediction folders of several runs, by their number of insertions."""
    return reduce(lambda a, b: a.unionByName(b), [files.read_prediction_folders(spark, p).withColumn("insertions", F.lit(n)) for n, p in sorted(folders.items())])


def insertion_slopes(summary: DataFrame, counts: list[int], above: float = 0.95) -> DataFrame:
    """``concept, fscore_<count> ..., best, slope, r2``: how F-scores change over insertion counts, for concepts with one beyond ``above``, flattest first.

    Concepts are those of the smallest count; of several controls the mean counts. A concept without a score at some count has no slope.
    """
    means = summary.groupBy("concept", "insertions").agg(F.avg("fscore").alias("fscore"))
    wide = means.groupBy("concept").pivot("insertions", sorted(counts)).agg(F.max("fscore"))
    wide = wide.select("concept", *[F.col(f"`{n}`").alias(f"fscore_{n}") for n in sorted(counts)])
    scores = [F.col(f"fscore_{n}") for n in sorted(counts)]
    lines = X.line_fit(means.filter(F.col("insertions").isin(counts)), "insertions", "fscore", "concept")
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    whole = reduce(lambda a, b: a & b, [s.isNotNull() for s in scores])
    kept = wide.filter(scores[0].isNotNull()).withColumn("best", best).filter(F.col("best") > above).withColumnRenamed("concept", "concept__")
    joined = kept.join(lines, kept["concept__"].eqNullSafe(lines["concept"])).drop("concept__")
    return joined.select("concept", *[f"fscore_{n}" for n in sorted(counts)], "best", F.when(whole, F.col("slope")).alias("slope"), F.when(whole, F.col("r2")).alias("r2")).orderBy("slope", "concept")


def attribution_ratios(scores: DataFrame) -> DataFrame:
    """``attribution, concept, target_share, control_share, log_ratio`` of ``attribution, concept, is_control, score``.

    For each set of attributions and concept: the shares of positive scores among target and control regions, and the natural logarithm of their ratio,
    null without scores of either. Scores that are null or not a number are left out.
    """
    usable = scores.filter("score IS NOT NULL AND NOT isnan(score) AND is_control IS NOT NULL")
    positive = (F.col("score") > 0).cast("double")
    shares = [F.avg(F.when(F.col("is_control") == of, positive)).alias(name) for of, name in ((False, "target_share"), (True, "control_share"))]
    return usable.groupBy("attribution", "concept").agg(*shares).withColumn("log_ratio", V.log_ratio(F.col("target_share"), F.col("control_share"), PSEUDO))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes])


def k11_classifier_summary(spark, sf_dir):
    return _rounded(classifier_summary(P.predictions(spark, sf_dir), "concept", "source"))


def k11_insertion_slopes(spark, sf_dir):
    """Predictions written as a folder of text files for each of three insertion counts, and read back."""
    rows = P.predictions(spark, sf_dir).select("doc_id", "concept", F.col("source").alias("control"), "pred", "truth")
    folders = {12 * (1 + i): _path(spark, f"insertions{i}") for i in range(3)}
    for i, path in enumerate(folders.values()):
        files.write_prediction_folders(rows.filter(F.col("doc_id") % 3 == i).drop("doc_id"), path)
    read = insertion_predictions(spark, {n: f"{path}/*" for n, path in folders.items()})
    return _rounded(insertion_slopes(classifier_summary(read, "concept", "control", "insertions"), list(folders), 0.3))


def k11_attribution_ratios(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return _rounded(attribution_ratios(lines.select(F.col("l_returnflag").alias("attribution"), F.col("l_suppkey").alias("concept"), (F.col("l_linestatus") == "O").alias("is_control"), (F.col("l_quantity").cast("double") - 25).alias("score"))))


def _classes(by: str) -> str:
    """SQL of precision, recall, F1 and support by class."""
    both, said, true = "sum((pred = cls AND truth = cls)::INT)", "sum((pred = cls)::INT)", "sum((truth = cls)::INT)"
    share = "coalesce({}::DOUBLE / nullif({}, 0), 0)".format
    return f"SELECT {by}, cls, {share(both, said)} AS p, {share(both, true)} AS r, {share(f'(2 * {both})', f'({said} + {true})')} AS f, {true}::BIGINT AS n FROM pr, (VALUES (0), (1)) v(cls) GROUP BY {by}, cls"


ORACLE_SQL = {
    "k11_classifier_summary": f"""WITH {P.PREDICTIONS}, c AS ({_classes("concept, source")})
      SELECT concept, source, round(avg(f), 6) AS fscore, {", ".join(f"round(max(p) FILTER (cls = {k}), 6) AS precision_{k}, round(max(r) FILTER (cls = {k}), 6) AS recall_{k}, max(n) FILTER (cls = {k}) AS support_{k}" for k in (0, 1))} FROM c GROUP BY concept, source""",
    "k11_insertion_slopes": f"""WITH p AS (WITH {P.PREDICTIONS} SELECT * FROM pr), pr AS (SELECT *, (12 * (1 + doc_id % 3))::INT AS insertions FROM p), c AS ({_classes("concept, source, insertions")}),
      s AS (SELECT concept, source, insertions, avg(f) AS f FROM c GROUP BY ALL), m AS (SELECT concept, insertions, avg(f) AS f FROM s GROUP BY ALL)
      SELECT concept, round(max(f) FILTER (insertions = 12), 6) AS fscore_12, round(max(f) FILTER (insertions = 24), 6) AS fscore_24, round(max(f) FILTER (insertions = 36), 6) AS fscore_36,
        round(max(f), 6) AS best, CASE WHEN count(*) = 3 THEN round(regr_slope(f, insertions), 6) END AS slope, CASE WHEN count(*) = 3 THEN round(regr_r2(f, insertions), 6) END AS r2
      FROM m GROUP BY concept HAVING max(f) > 0.3 AND count(*) FILTER (insertions = 12) > 0""",
    "k11_attribution_ratios": """WITH s AS (SELECT l_returnflag AS attribution, l_suppkey AS concept, avg((l_quantity > 25)::INT) FILTER (l_linestatus <> 'O') AS t, avg((l_quantity > 25)::INT) FILTER (l_linestatus = 'O') AS c FROM lineitem GROUP BY 1, 2)
      SELECT attribution, concept, round(t, 6) AS target_share, round(c, 6) AS control_share, round(ln((t + 0.01) / (c + 0.01)), 6) AS log_ratio FROM s""",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
