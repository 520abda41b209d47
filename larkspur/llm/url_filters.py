"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes.

Every URL is expanded into ``host suffix + path prefix`` expressions, only as deep as any rule
reaches. An expression meets a rule by an equi-join on the first 32 bits of its SHA-256 digest;
the whole digest then confirms the hit, and the rule of highest precedence wins: the longest, then
the one with the longer host, then ``block`` before ``allow``.

Edge cases: a null URL or one without ``://`` has an empty host and path and meets no rule; repeated
rows are judged each for itself; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.storage import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest that the join compares.
PREFIX_DIGITS = 8
#: Rules up to this number are broadcast (under 200 bytes each); beyond, both sides are shuffled.
BROADCAST_RULES = 50_000

Rule = tuple[str, str, str]  # verdict, host, path

#: The rules of the registered query.
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.regexp_replace(_after_scheme(url), r"^[^/?#]*", ""), r"^[^?#]*", 0)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """``rank, verdict, rule, digest``, a higher rank before a lower one."""
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or not host or "/" in host or not (path.startswith("/") and path.endswith("/")):
            raise ValueError(f"not a rule: {(verdict, host, path)}; paths begin and end with /")
    ordered = sorted(set(rules), key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "block", r[1], r[2]))
    rows = [(i, verdict, host + path) for i, (verdict, host, path) in enumerate(ordered)]
    return spark.createDataFrame(rows, "rank int, verdict string, rule string").withColumn("digest", F.sha2("rule", 256))


def expressions(host: Column, path: Column, max_labels: int, max_slashes: int) -> Column:
    """The host's last 1, 2, ... labels, each with the path up to its 1st, 2nd, ... slash."""
    labels, parts = F.split(host, r"\.", -1), F.split(path, "/", -1)
    n, slashes = F.size(labels), F.size(parts) - 1
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max_labels))), lambda d: F.array_join(F.slice(labels, n - d + 1, d), "."))
    prefixes = F.when(slashes > 0, F.transform(F.sequence(F.lit(1), F.least(slashes, F.lit(max_slashes))), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))
    made = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    return F.coalesce(made, F.array().cast("array<string>"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``id, host, path, rule, verdict`` of every row; ``default`` is the verdict where no rule fits."""
    spark, known = pages.sparkSession, rule_table(pages.sparkSession, rules)
    small = F.broadcast if len(rules) <= BROADCAST_RULES else lambda x: x
    depth = max((len(h.split(".")) for _, h, _ in rules), default=1), max((p.count("/") for _, _, p in rules), default=1)
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    asked = urls.withColumn("expression", F.explode_outer(expressions(F.col("host"), F.col("path"), *depth)))
    asked = asked.withColumn("digest", F.sha2("expression", 256)).drop("expression")
    hits = asked.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS)).join(
        small(known.select("rank", F.col("digest").alias("full"), F.substring("digest", 1, PREFIX_DIGITS).alias("prefix"))), "prefix", "left")
    best = hits.groupBy("row", "id", "host", "path").agg(F.max(F.when(F.col("digest") == F.col("full"), F.col("rank"))).alias("rank"))
    return best.join(small(known.select("rank", "rule", "verdict")), "rank", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


OP8_SQL = f"""
WITH r(verdict, host, path) AS (VALUES {", ".join(repr(r) for r in RULES)}),
a AS (SELECT row_number() OVER () AS i, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT i, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
p AS (SELECT i, page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT i, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(verdict, length(r.host || r.path)) AS verdict
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.i = m.i
"""

QUERIES = {"op8_url_filters": op8_url_filters}
ORACLE_SQL = {"op8_url_filters": OP8_SQL}
