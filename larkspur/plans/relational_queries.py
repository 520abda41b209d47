"""Pairing, set, sampling and metric operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions.hashing import uniform, uniform_sql
from larkspur.operators import metrics as X
from larkspur.operators import relational as R
from larkspur.plans import proxies as P
from larkspur.sources.storage import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


def _items(spark, sf_dir):
    return R.numbered(table(spark, sf_dir, "benchmark").select("item_id"), "item_id")


def d1_left_join_chain(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    first = docs.groupBy(F.col("source").alias("concept")).agg(F.count(F.lit(1)).alias("n"))
    second = docs.filter("lang = 'en'").groupBy(F.col("source").alias("concept")).agg(F.sum("n_chars").alias("en_chars"))
    third = P.predictions(spark, sf_dir).filter("pred = 0").groupBy(F.col("source").alias("concept")).agg(F.count(F.lit(1)).alias("n_flagged"))
    return R.left_joined([first, second, third], "concept")


def d2_zip_pairs(spark, sf_dir):
    return R.zipped(R.numbered(_docs(spark, sf_dir).select("doc_id"), "doc_id"), _items(spark, sf_dir))


def d3_cycle_pairs(spark, sf_dir):
    return R.cycled(R.numbered(_docs(spark, sf_dir).select("doc_id"), "doc_id"), _items(spark, sf_dir)).select("ordinal", "doc_id", "item_id")


def d5_baseline_repeat(spark, sf_dir):
    targets = R.repeated(R.numbered(_docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id"), 3).withColumn("ordinal", F.col("ordinal") * 3 + F.col("k"))
    baselines = R.numbered(_docs(spark, sf_dir).select(F.col("doc_id").alias("base_id"), F.col("n_chars").alias("base")), "base_id")
    return R.cycled(targets, baselines).groupBy("doc_id").agg(F.round(F.avg((F.col("n_chars") - F.col("base")).cast("double")), 6).alias("mean_diff"))


def d7_concept_control_pairs(spark, sf_dir):
    names = _docs(spark, sf_dir).select(F.col("source").alias("concept")).distinct()
    controls = _docs(spark, sf_dir).select(F.col("lang").alias("control")).distinct()
    return names.crossJoin(controls)


def d8_permuted_pairs(spark, sf_dir):
    own = P.motifs(spark, sf_dir).select(F.col("motif").alias("base"), "consensus")
    other = P.motifs(spark, sf_dir).select(F.concat(F.col("motif"), F.lit("_permuted")).alias("name"), F.reverse("consensus").alias("control"))
    return own.join(other.withColumn("base", F.regexp_replace("name", "_permuted$", "")), "base").select("base", "name", "consensus", "control")


def _frequent(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source").agg(F.sum("n_chars").alias("chars")).filter("chars % 2 = 0")


def d10_semi(spark, sf_dir):
    return P.predictions(spark, sf_dir).join(_frequent(spark, sf_dir), "source", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def d11_anti(spark, sf_dir):
    return P.predictions(spark, sf_dir).join(_frequent(spark, sf_dir), "source", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _by_lang(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return [docs.filter(F.col("lang") == x).groupBy(F.col("source").alias("concept")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least) for x, least in (("es", 5), ("fr", 2), ("en", 0))]


def d12_dedup_union(spark, sf_dir):
    return R.first_of_union(_by_lang(spark, sf_dir), "concept")


def h4_overlay_union(spark, sf_dir):
    return R.first_of_union(_by_lang(spark, sf_dir), "concept", latest=True)


def h1_union_blocks(spark, sf_dir):
    first, second, third = _by_lang(spark, sf_dir)
    return first.unionByName(second).unionByName(third).groupBy("concept").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("n"))


def h5_unpivot(spark, sf_dir):
    wide = _docs(spark, sf_dir).groupBy(F.col("source").alias("concept")).agg(F.sum("n_chars").alias("chars"), F.count(F.lit(1)).alias("docs"))
    return wide.unpivot("concept", ["chars", "docs"], "measure", "value")


def h6_pivot(spark, sf_dir):
    long = P.predictions(spark, sf_dir).groupBy("source", "truth").agg(F.count(F.lit(1)).alias("n"))
    return long.groupBy(F.col("source").alias("concept")).pivot("truth", [0, 1]).agg(F.first("n")).select("concept", F.col("0").alias("truth_0"), F.col("1").alias("truth_1"))


def h7_reshape(spark, sf_dir):
    """Vectors as two rows with these exchanged."""
    half = F.floor(F.size("embedding") / 2).cast("int")
    halves = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.slice("embedding", half + 1, half), F.slice("embedding", F.lit(1), half)).alias("e"))
    return halves.select("vec_id", F.posexplode("e").alias("place", "x")).select("vec_id", "place", F.round(F.col("x").cast("double"), 6).alias("x"))


def e3_accuracy_by_class(spark, sf_dir):
    return X.accuracy_by_class(P.predictions(spark, sf_dir), "concept").select("concept", "truth", "n", F.round("accuracy", 6).alias("accuracy"))


def e4_class_scores(spark, sf_dir):
    return X.class_scores(P.predictions(spark, sf_dir), "concept").select("concept", "cls", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def e4_prf_macro(spark, sf_dir):
    return X.fscores(P.predictions(spark, sf_dir), "source").select("source", F.round("fscore", 6).alias("fscore"), F.round("fscore_macro", 6).alias("fscore_macro"))


def e5_sign_counts(spark, sf_dir):
    scores = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("concept"), (F.col("l_quantity").cast("double") - 25).alias("score"))
    return X.sign_counts(scores, "concept").select("concept", "n_pos", "n_neg", F.round("pos_ratio", 6).alias("pos_ratio"), F.round("median", 6).alias("median"))


def e8_auc_trapezoid(spark, sf_dir):
    points = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("concept"), F.year("o_orderdate").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return X.trapezoid_area(points, "concept", "x", "y").select("concept", F.round("area", 6).alias("area"))


def _lengths(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"), F.col("p_brand").alias("brand"))


def e9_line_fit(spark, sf_dir):
    return X.line_fit(_lengths(spark, sf_dir), "x", "y", "brand").select("brand", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("r2", 6).alias("r2"))


def e9_p_values(spark, sf_dir):
    return X.line_fit(_lengths(spark, sf_dir), "x", "y", "brand", p_value=True).select("brand", "p")


def e9_residual_rank(spark, sf_dir):
    rows = X.residuals(_lengths(spark, sf_dir).groupBy("brand").agg(F.avg("x").alias("x"), F.avg("y").alias("y")), "x", "y")
    rounded = rows.select("brand", F.round("residual", 5).alias("residual")).withColumn("down", -F.col("residual"))
    return R.numbered(rounded, "down", "brand").select("brand", "residual", (F.col("ordinal") + 1).alias("rank"))


def e13_distinct_concepts(spark, sf_dir):
    return _docs(spark, sf_dir).select("source", "lang").distinct()


def e20_summary(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def f2_label_suffix(spark, sf_dir):
    rows = R.numbered(_docs(spark, sf_dir).select("doc_id", "lang", "source"), "doc_id", by=["lang", "source"])
    nth = F.col("ordinal") + 1
    named = F.concat(F.col("lang"), F.lit(" ("), F.col("source"), F.lit(")"), F.when(nth > 1, F.concat(F.lit("_"), nth.cast("string"))).otherwise(""))
    return rows.select("doc_id", named.alias("label"))


def f4_cumulative_shares(spark, sf_dir):
    counts = _docs(spark, sf_dir).groupBy("source").agg(F.sum("n_chars").alias("n"))
    every = F.broadcast(counts.agg(F.sum("n").alias("all")))
    return R.running_sum(counts, "source", "n").crossJoin(every).select("source", F.round(F.col("upto") / F.col("all"), 6).alias("upto"))


def g2_composite_order(spark, sf_dir):
    rows = _docs(spark, sf_dir).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    placed = rows.withColumns({"last": F.when(F.col("lang") == "en", 0).otherwise(1), "down": -F.col("n")})
    return R.numbered(placed, "last", "down", "source", "lang").withColumn("rank", F.col("ordinal") + 1).drop("last", "down", "ordinal")


def g3_top_concepts(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source").agg(F.sum("n_chars").alias("chars")).orderBy(F.desc("chars"), "source").limit(10)


def g5_first_n(spark, sf_dir):
    return R.first_n(_docs(spark, sf_dir), "source", "doc_id", 7).select("source", "doc_id", "nth")


def g5_whole_batches(spark, sf_dir):
    """The first batches of 4 that hold 7 rows of a source."""
    return R.first_batches(_docs(spark, sf_dir), "source", "doc_id", 7, 4).select("source", "doc_id", "nth")


def g6_drop_last(spark, sf_dir):
    return R.whole_batches(R.numbered(_docs(spark, sf_dir).select("doc_id"), "doc_id"), 48).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def g8_sample(spark, sf_dir):
    return R.sampled(_docs(spark, sf_dir).select("doc_id"), "doc_id", 100, "4")


def g9_stratified_split(spark, sf_dir):
    return R.split_by_hash(_docs(spark, sf_dir).select("doc_id", "lang"), "lang", F.col("doc_id"), 0.1, "42")


def b18_log_ratios(spark, sf_dir):
    counts = P.predictions(spark, sf_dir).groupBy("source").agg(F.sum("truth").alias("p"), F.sum(1 - F.col("truth")).alias("n"))
    share = F.col("p") / (F.col("p") + F.col("n"))
    return counts.select("source", F.round(F.log((F.col("p") + F.lit(1.0)) / (F.col("n") + F.lit(1.0))), 6).alias("of_counts"), F.round(F.log((share + 0.01) / (1 - share + 0.01)), 6).alias("of_ratios"))


def b20_name_parsing(spark, sf_dir):
    host = table(spark, sf_dir, "pages").select("page_id", "url")
    return host.select("page_id", F.regexp_extract("url", r"example\.([a-z]+)", 1).alias("top"), F.regexp_replace("url", r"[0-9]+", "_").alias("pattern"), F.startswith("url", F.lit("https")).alias("secure"))


def b19_uniforms(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(uniform("8", "u", F.col("doc_id")), 6).alias("u"))


def b22_escaped_json(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.replace("html", F.lit("<"), F.lit("\\u003c"))).alias("escaped"), F.regexp_replace("url", "[^a-zA-Z0-9_-]", "_").alias("safe_id"))


D = "docs AS (SELECT doc_id, lang, source, n_chars FROM documents)"
DN = "dn AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents)"
BN = "bn AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS ordinal FROM benchmark)"
FREQUENT = "fq AS (SELECT source FROM documents GROUP BY source HAVING sum(n_chars) % 2 = 0)"
BLOCKS = "u AS (" + " UNION ALL ".join(f"SELECT source AS concept, count(*) AS n, {i} AS src FROM documents WHERE lang = '{x}' GROUP BY source HAVING count(*) > {k}" for i, (x, k) in enumerate((("es", 5), ("fr", 2), ("en", 0)))) + ")"
FIT = "coalesce(regr_slope(y, x), 0) AS slope, coalesce(regr_intercept(y, x), 0) AS intercept"
PARTS = "p AS (SELECT p_size::DOUBLE AS x, p_retailprice::DOUBLE AS y, p_brand AS brand FROM part)"
CLASS = """k AS (SELECT {by}, cls, count(*) FILTER (pred = cls AND truth = cls) AS tp, count(*) FILTER (pred = cls) AS said, count(*) FILTER (truth = cls) AS support FROM pr, (VALUES (0), (1)) v(cls) GROUP BY {by}, cls),
  s AS (SELECT {by}, cls, coalesce(tp::DOUBLE / nullif(said, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(said + support, 0), 0) AS f1, support FROM k)"""
ORACLE_SQL = {
    "d1_left_join_chain": f"WITH {P.PREDICTIONS}, a AS (SELECT source AS concept, count(*) AS n FROM documents GROUP BY source), b AS (SELECT source AS concept, sum(n_chars)::BIGINT AS en_chars FROM documents WHERE lang = 'en' GROUP BY source), c AS (SELECT source AS concept, count(*) AS n_flagged FROM pr WHERE pred = 0 GROUP BY source) SELECT a.concept, n, en_chars, n_flagged FROM a LEFT JOIN b ON a.concept = b.concept LEFT JOIN c ON a.concept = c.concept",
    "d2_zip_pairs": f"WITH {DN}, {BN} SELECT dn.ordinal, doc_id, item_id FROM dn JOIN bn ON dn.ordinal = bn.ordinal",
    "d3_cycle_pairs": f"WITH {DN}, {BN} SELECT dn.ordinal, doc_id, item_id FROM dn JOIN bn ON dn.ordinal % (SELECT count(*) FROM bn) = bn.ordinal",
    "d5_baseline_repeat": f"WITH {DN}, r AS (SELECT doc_id, n_chars, ordinal * 3 + k AS o FROM dn, generate_series(0, 2) s(k)) SELECT r.doc_id, round(avg((r.n_chars - dn.n_chars)::DOUBLE), 6) AS mean_diff FROM r JOIN dn ON r.o % (SELECT count(*) FROM dn) = dn.ordinal GROUP BY r.doc_id",
    "d7_concept_control_pairs": "SELECT concept, control FROM (SELECT DISTINCT source AS concept FROM documents), (SELECT DISTINCT lang AS control FROM documents)",
    "d8_permuted_pairs": f"WITH {P.MOTIFS} SELECT motif AS base, motif || '_permuted' AS name, a.consensus, reverse(a.consensus) AS control FROM motifs a",
    "d10_semi": f"WITH {P.PREDICTIONS}, {FREQUENT} SELECT source, count(*) AS n FROM pr WHERE source IN (SELECT source FROM fq) GROUP BY source",
    "d11_anti": f"WITH {P.PREDICTIONS}, {FREQUENT} SELECT source, count(*) AS n FROM pr WHERE source NOT IN (SELECT source FROM fq) GROUP BY source",
    "d12_dedup_union": f"WITH {BLOCKS} SELECT concept, n, src FROM u QUALIFY row_number() OVER (PARTITION BY concept ORDER BY src) = 1",
    "h4_overlay_union": f"WITH {BLOCKS} SELECT concept, n, src FROM u QUALIFY row_number() OVER (PARTITION BY concept ORDER BY src DESC) = 1",
    "h1_union_blocks": f"WITH {BLOCKS} SELECT concept, count(*) AS blocks, sum(n)::BIGINT AS n FROM u GROUP BY concept",
    "h5_unpivot": "SELECT source AS concept, 'chars' AS measure, sum(n_chars)::BIGINT AS value FROM documents GROUP BY source UNION ALL SELECT source, 'docs', count(*) FROM documents GROUP BY source",
    "h6_pivot": f"WITH {P.PREDICTIONS} SELECT source AS concept, nullif(count(*) FILTER (truth = 0), 0) AS truth_0, nullif(count(*) FILTER (truth = 1), 0) AS truth_1 FROM pr GROUP BY source",
    "h7_reshape": "WITH e AS (SELECT vec_id, len(embedding) AS n, unnest(embedding) AS v, unnest(generate_series(0, len(embedding) - 1)) AS i FROM embeddings) SELECT vec_id, ((i + n // 2) % n)::INT AS place, round(v::DOUBLE, 6) AS x FROM e",
    "e3_accuracy_by_class": f"WITH {P.PREDICTIONS} SELECT concept, truth, count(*) AS n, round(avg((pred = truth)::INT::DOUBLE), 6) AS accuracy FROM pr GROUP BY ROLLUP (concept, truth)",
    "e4_class_scores": f"WITH {P.PREDICTIONS}, {CLASS.format(by='concept')} SELECT concept, cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM s",
    "e4_prf_macro": f"WITH {P.PREDICTIONS}, {CLASS.format(by='source')} SELECT source, round(max(f1) FILTER (cls = 1), 6) AS fscore, round(avg(f1), 6) AS fscore_macro FROM s GROUP BY source",
    "e5_sign_counts": "WITH s AS (SELECT l_suppkey AS concept, l_quantity::DOUBLE - 25 AS s FROM lineitem) SELECT concept, count(*) FILTER (s > 0) AS n_pos, count(*) FILTER (s < 0) AS n_neg, round(avg((s > 0)::INT::DOUBLE), 6) AS pos_ratio, round(median(s), 6) AS median FROM s GROUP BY concept",
    "e8_auc_trapezoid": "WITH p AS (SELECT o_custkey AS concept, year(o_orderdate) AS x, count(*)::DOUBLE AS y FROM orders GROUP BY 1, 2), s AS (SELECT concept, x, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS part FROM p WINDOW w AS (PARTITION BY concept ORDER BY x)) SELECT concept, round(sum(part) / nullif(max(x) - min(x), 0), 6) AS area FROM s GROUP BY concept",
    "e9_line_fit": f"WITH {PARTS} SELECT brand, round(coalesce(regr_slope(y, x), 0), 5) AS slope, round(coalesce(regr_intercept(y, x), 0), 5) AS intercept, round(coalesce(regr_r2(y, x), 0), 6) AS r2 FROM p GROUP BY brand",
    "e9_residual_rank": f"WITH {PARTS}, b AS (SELECT brand, avg(x) AS x, avg(y) AS y FROM p GROUP BY brand), f AS (SELECT {FIT} FROM b), r AS (SELECT brand, round(y - slope * x - intercept, 5) AS residual FROM b, f) SELECT brand, residual, row_number() OVER (ORDER BY residual DESC, brand) AS rank FROM r",
    "e13_distinct_concepts": "SELECT DISTINCT source, lang FROM documents",
    "e20_summary": "SELECT lang, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY lang",
    "f2_label_suffix": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k FROM documents) SELECT doc_id, lang || ' (' || source || ')' || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS label FROM r",
    "f4_cumulative_shares": "WITH c AS (SELECT source, sum(n_chars)::DOUBLE AS n FROM documents GROUP BY source) SELECT source, round(sum(n) OVER (ORDER BY source) / sum(n) OVER (), 6) AS upto FROM c",
    "g2_composite_order": "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) SELECT *, row_number() OVER (ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, n DESC, source, lang) AS rank FROM c",
    "g3_top_concepts": "SELECT source, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source ORDER BY chars DESC, source LIMIT 10",
    "g5_first_n": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents QUALIFY nth <= 7",
    "g5_whole_batches": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents QUALIFY nth <= 8",
    "g6_drop_last": f"WITH {DN} SELECT (ordinal // 48)::BIGINT AS batch, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM dn WHERE ordinal < (SELECT count(*) // 48 * 48 FROM dn) GROUP BY 1",
    "g8_sample": "SELECT doc_id FROM documents ORDER BY md5(concat_ws(':', '4', doc_id::VARCHAR)), doc_id LIMIT 100",
    "g9_stratified_split": "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws(':', '42', doc_id::VARCHAR)), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CASE WHEN k <= ceil(n * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r",
    "b18_log_ratios": f"WITH {P.PREDICTIONS}, c AS (SELECT source, sum(truth)::DOUBLE AS p, sum(1 - truth)::DOUBLE AS n FROM pr GROUP BY source) SELECT source, round(ln((p + 1) / (n + 1)), 6) AS of_counts, round(ln((p / (p + n) + 0.01::DOUBLE) / (1 - p / (p + n) + 0.01::DOUBLE)), 6) AS of_ratios FROM c",
    "b19_uniforms": f"SELECT doc_id, round({uniform_sql(chr(39) + '8' + chr(39), chr(39) + 'u' + chr(39), 'doc_id::VARCHAR')}, 6) AS u FROM documents",
    "b20_name_parsing": "SELECT page_id, regexp_extract(url, 'example\\.([a-z]+)', 1) AS top, regexp_replace(url, '[0-9]+', '_', 'g') AS pattern, starts_with(url, 'https') AS secure FROM pages",
    "b22_escaped_json": "SELECT page_id, md5(replace(html, '<', '\\u003c')) AS escaped, regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') AS safe_id FROM pages",
}
QUERIES = {name: globals()[name] for name in [*ORACLE_SQL, "e9_p_values"]}
