"""Sequence and motif operators over documents and benchmark items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from larkspur.functions import sequence as E
from larkspur.functions.hashing import uniform_sql
from larkspur.operators import motifs as M
from larkspur.operators import sequences as S
from larkspur.plans import proxies as P
from larkspur.sources.storage import table

MOTIF = "ACGTAC"


def b4_sequence_slice(spark, sf_dir):
    """Regions of 20 along every sequence, each on a strand, from a genome in chunks of 64."""
    seqs = P.sequences(spark, sf_dir).withColumn("chrom", F.col("seq_id").cast("string"))
    starts = F.sequence(F.lit(0).cast("long"), F.length("seq") - 20, F.lit(20).cast("long"))
    regions = seqs.filter("length(seq) >= 20").select("seq_id", "chrom", F.explode(starts).alias("start")).withColumn("stop", F.col("start") + 20)
    regions = regions.withColumn("strand", F.when((F.col("seq_id") + F.col("start") / 20) % 2 < 1, "-").otherwise("+"))
    cut = S.region_sequences(regions, P.genome(seqs, 64), 256)
    return cut.select("seq_id", "start", "strand", "seq")


def b5_reverse_complement(spark, sf_dir):
    return P.sequences(spark, sf_dir).select("seq_id", F.md5(E.reverse_complement(F.col("seq"))).alias("rc_md5"))


def b7_one_hot_counts(spark, sf_dir):
    total = lambda i: F.aggregate(F.col("x")[i], F.lit(0), lambda a, v: a + v)
    hot = P.sequences(spark, sf_dir).select("seq_id", E.one_hot(F.col("seq")).alias("x"))
    return hot.select("seq_id", *[total(i).alias(b) for i, b in enumerate(M.BASES)])


def b13_gc_content(spark, sf_dir):
    seqs = P.sequences(spark, sf_dir)
    n = E.letter_count(F.col("seq"), "GC")
    return seqs.select("seq_id", n.alias("gc_count"), F.round(n / F.nullif(F.length("seq"), F.lit(0)), 6).alias("gc"))


def f2_drop_unclean(spark, sf_dir):
    marked = P.sequences(spark, sf_dir).withColumn("seq", F.when(F.col("seq_id") % 5 == 0, F.concat("seq", F.lit("N"))).otherwise(F.col("seq")))
    return S.drop_unclean(marked).select("seq_id", F.length("seq").alias("n"))


def a20_synthetic_gc(spark, sf_dir):
    """For each item a sequence as long as its text, at five shares of G and C."""
    sizes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), F.length("text").alias("length"))
    made = reduce(lambda a, b: a.unionByName(b), [S.synthetic_gc(sizes, gc, "3") for gc in S.gc_grid(0.25)])
    return made.select("gc", "seq_id", F.md5("seq").alias("seq_md5"), E.letter_count(F.col("seq"), "GC").alias("n_gc"))


def c4_saturate_motif(spark, sf_dir):
    """The motif stands every 10 bases of whole texts; longer ones are written by the same rule."""
    return P.sequences(spark, sf_dir).select("seq_id", F.md5(S.saturated(F.col("seq"), F.lit(MOTIF), 3, 4)).alias("seq_md5"))


def c6_paired_motif(spark, sf_dir):
    """Two motifs in every sequence, as far as it has room for them."""
    return P.sequences(spark, sf_dir).select("seq_id", F.md5(S.paired(F.col("seq"), F.lit("AAAA"), F.lit("CCCC"), F.lit(5), 7)).alias("seq_md5"))


def c5_region_insert(spark, sf_dir):
    inserts = P.motifs(spark, sf_dir).select(F.col("motif").alias("insert_id"), F.col("consensus").alias("insert"))
    made = S.with_region_insert(P.sequences(spark, sf_dir), inserts, F.lit(4), "5")
    return made.select("seq_id", "insert_id", F.md5("seq").alias("seq_md5"))


def c11_mixed_variants(spark, sf_dir):
    variants = spark.createDataFrame([("a",), ("b",), ("c",)], "variant string")
    return S.mixed(P.sequences(spark, sf_dir).select("seq_id"), variants, 50, "9")


def b6_pwm_reverse_complement(spark, sf_dir):
    rows = M.pwm_reverse_complement(P.pwm(spark, sf_dir))
    return rows.select("motif", "pos", *[F.round(b, 6).alias(b) for b in M.BASES])


def b8_clean_motif_names(spark, sf_dir):
    return P.motifs(spark, sf_dir).select(E.clean_motif_name(F.col("motif")).alias("motif"), "consensus")


def b11_information_content(spark, sf_dir):
    return M.information(P.pwm(spark, sf_dir)).select("motif", "pos", F.round("ic", 6).alias("ic"))


def b12_letter_heights(spark, sf_dir):
    return M.heights(P.pwm(spark, sf_dir)).select("motif", "pos", *[F.round(b, 6).alias(b) for b in M.BASES])


def e11_motif_covariates(spark, sf_dir):
    return M.covariates(P.pwm(spark, sf_dir)).select("motif", "len", F.round("ic", 6).alias("ic"), F.round("ic_gc", 6).alias("ic_gc"))


def e12_consensus_means(spark, sf_dir):
    rows = P.motifs(spark, sf_dir).withColumn("name", F.substring("consensus", 1, 1))
    return rows.groupBy("name").agg(F.round(F.avg(F.length("consensus").cast("double")), 6).alias("len"), F.round(F.avg(E.letter_count(F.col("consensus"), "GC").cast("double")), 6).alias("gc"))


def a12_consensus_motifs(spark, sf_dir):
    """Names of up to eight strings, each with its reverse complement."""
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("M"), F.floor(F.col("item_id") / 8).cast("string")).alias("motif"), F.upper(F.regexp_replace("text", "[^acgtACGT]", "")).alias("consensus"))
    return M.consensus_table(M.with_reverse_complements(items))


def a13_merge_names(spark, sf_dir):
    rows = P.motifs(spark, sf_dir).select(F.substring("consensus", 1, 2).alias("name"), "motif")
    return M.merged_names(rows, "name", "motif").select("name", "motif", "unique_name")


def a11_meme_round_trip(spark, sf_dir):
    text = M.meme_text(P.pwm(spark, sf_dir)).select(F.col("text").alias("value"))
    return M.parsed_meme(text)


def a24_meme_text(spark, sf_dir):
    return M.meme_text(P.pwm(spark, sf_dir))


def c1_pwm_sample(spark, sf_dir):
    return M.sampled(P.pwm(spark, sf_dir), 50, "1")


def c7_permuted_motif(spark, sf_dir):
    return M.permuted(P.motifs(spark, sf_dir), 0.3, "2").select("motif", "consensus", "permuted", F.round("moved", 6).alias("moved"))


def c13_pssm_hits(spark, sf_dir):
    return M.pssm_hits(P.sequences(spark, sf_dir), P.pwm(spark, sf_dir), 4.0)


def _inserted(spark, sf_dir):
    matrix = [[0.97, 0.01, 0.01, 0.01], [0.01, 0.97, 0.01, 0.01], [0.01, 0.01, 0.97, 0.01], [0.01, 0.01, 0.01, 0.97]] * 2
    return S.with_motifs(P.sequences(spark, sf_dir), matrix, 3, 2, 2)


def c3_motif_insertion(spark, sf_dir):
    return _inserted(spark, sf_dir).select("seq_id", F.length("seq").alias("n"), F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"), F.md5("seq").alias("seq_md5"))


def c8_dinuc_shuffle(spark, sf_dir):
    return S.with_shuffles(P.sequences(spark, sf_dir), 2).select("seq_id", "copy", F.length("seq").alias("n"), F.md5("seq").alias("seq_md5"))


RC = "translate(reverse(seq), 'ACGT', 'TGCA')"
R6 = "round(a, 6) AS a, round(c, 6) AS c, round(g, 6) AS g, round(t, 6) AS t"
IC = "2.0::DOUBLE + " + " + ".join(f"CASE WHEN {b} > 0 THEN {b} * log2({b}) ELSE 0.0::DOUBLE END" for b in M.BASES)
LETTER = "CASE WHEN u < a THEN 'A' WHEN u < a + c THEN 'C' WHEN u < a + c + g THEN 'G' ELSE 'T' END"
MEME = f"""WITH {P.PWM}, l AS (SELECT motif, string_agg(printf('%.6f %.6f %.6f %.6f', a, c, g, t), chr(10) ORDER BY pos) AS body, count(*) AS w FROM pwm GROUP BY motif)
  SELECT motif, 'MOTIF ' || motif || chr(10) || 'letter-probability matrix: alength= 4 w= ' || w || ' nsites= 20 E= 0' || chr(10) || body || chr(10) AS text FROM l"""
ORACLE_SQL = {
    "b4_sequence_slice": f"""WITH {P.SEQUENCES}, r AS (SELECT seq_id, seq AS whole, unnest(generate_series(0, length(seq) - 20, 20)) AS start FROM seqs WHERE length(seq) >= 20),
      s AS (SELECT seq_id, start, CASE WHEN (seq_id + start // 20) % 2 = 0 THEN '-' ELSE '+' END AS strand, substr(whole, start + 1, 20) AS seq FROM r) SELECT seq_id, start, strand, CASE WHEN strand = '-' THEN {RC} ELSE seq END AS seq FROM s""",
    "b5_reverse_complement": f"WITH {P.SEQUENCES} SELECT seq_id, md5({RC}) AS rc_md5 FROM seqs",
    "b7_one_hot_counts": f"WITH {P.SEQUENCES} SELECT seq_id, " + ", ".join(f"length(seq) - length(replace(seq, '{b.upper()}', '')) AS {b}" for b in M.BASES) + " FROM seqs",
    "b13_gc_content": f"WITH {P.SEQUENCES}, n AS (SELECT seq_id, length(seq) AS n, length(seq) - length(translate(seq, 'GC', '')) AS k FROM seqs) SELECT seq_id, k AS gc_count, round(k::DOUBLE / nullif(n, 0), 6) AS gc FROM n",
    "f2_drop_unclean": f"WITH {P.SEQUENCES} SELECT seq_id, length(seq) AS n FROM seqs WHERE seq_id % 5 <> 0 AND seq <> ''",
    "a20_synthetic_gc": f"""WITH d AS (SELECT printf('%.2f', k / 4.0) AS gc, k / 4.0::DOUBLE AS p, item_id AS seq_id, j, {uniform_sql("'3'", "printf('%.2f', k / 4.0)", "item_id::VARCHAR", "j::VARCHAR")} AS u FROM benchmark, generate_series(0, 4) a(k), LATERAL (SELECT unnest(generate_series(0, length(text) - 1)) AS j) c),
      s AS (SELECT gc, seq_id, string_agg(CASE WHEN u < (1 - p) / 2 THEN 'A' WHEN u < 0.5::DOUBLE THEN 'C' WHEN u < 0.5::DOUBLE + p / 2 THEN 'G' ELSE 'T' END, '' ORDER BY j) AS seq FROM d GROUP BY gc, seq_id)
      SELECT gc, seq_id, md5(seq) AS seq_md5, length(seq) - length(translate(seq, 'GC', '')) AS n_gc FROM s""",
    "c4_saturate_motif": f"""WITH {P.SEQUENCES}, x AS (SELECT seq_id, seq, CASE WHEN length(seq) >= 9 THEN (length(seq) - 9) // 10 + 1 ELSE 0 END AS n FROM seqs),
      y AS (SELECT seq_id, CASE WHEN n = 0 THEN seq ELSE substr(seq, 1, 3) || array_to_string([ '{MOTIF}' || CASE WHEN i < n THEN substr(seq, 10 + 10 * (i - 1), 4) ELSE substr(seq, 10 + 10 * (i - 1)) END FOR i IN generate_series(1, n)], '') END AS s FROM x) SELECT seq_id, md5(s) AS seq_md5 FROM y""",
    "c6_paired_motif": f"WITH {P.SEQUENCES}, one AS (SELECT seq_id, substr(substr(seq, 1, 5) || 'AAAA' || substr(seq, 10), 1, length(seq)) AS s FROM seqs) SELECT seq_id, md5(substr(substr(s, 1, 16) || 'CCCC' || substr(s, 21), 1, length(s))) AS seq_md5 FROM one",
    "c5_region_insert": f"""WITH {P.SEQUENCES}, {P.MOTIFS}, m AS (SELECT motif, consensus, row_number() OVER (ORDER BY motif) - 1 AS pick, count(*) OVER () AS n FROM motifs),
      s AS (SELECT seq_id, seq, floor({uniform_sql("'5'", "'insert'", "seq_id::VARCHAR")} * (SELECT count(*) FROM motifs))::INT AS pick FROM seqs)
      SELECT seq_id, motif AS insert_id, md5(substr(substr(seq, 1, 4) || consensus || substr(seq, 5 + length(consensus)), 1, length(seq))) AS seq_md5 FROM s JOIN m ON s.pick = m.pick""",
    "c11_mixed_variants": f"WITH {P.SEQUENCES} SELECT seq_id, variant FROM seqs, (VALUES ('a'), ('b'), ('c')) v(variant) ORDER BY md5(concat_ws(':', '9', seq_id::VARCHAR, variant)) LIMIT 50",
    "b6_pwm_reverse_complement": f"WITH {P.PWM} SELECT motif, 13 - pos AS pos, round(t, 6) AS a, round(g, 6) AS c, round(c, 6) AS g, round(a, 6) AS t FROM pwm",
    "b8_clean_motif_names": f"WITH {P.MOTIFS} SELECT replace(motif, '/', '-') AS motif, consensus FROM motifs",
    "b11_information_content": f"WITH {P.PWM} SELECT motif, pos, round({IC}, 6) AS ic FROM pwm",
    "b12_letter_heights": f"WITH {P.PWM}, i AS (SELECT *, {IC} AS ic FROM pwm) SELECT motif, pos, round(a * ic, 6) AS a, round(c * ic, 6) AS c, round(g * ic, 6) AS g, round(t * ic, 6) AS t FROM i",
    "e11_motif_covariates": f"WITH {P.PWM}, i AS (SELECT *, {IC} AS ic FROM pwm) SELECT motif, count(*) AS len, round(sum(ic), 6) AS ic, round(sum((g + c) * ic), 6) AS ic_gc FROM i GROUP BY motif",
    "e12_consensus_means": f"WITH {P.MOTIFS} SELECT substr(consensus, 1, 1) AS name, round(avg(length(consensus)::DOUBLE), 6) AS len, round(avg((length(consensus) - length(translate(consensus, 'GC', '')))::DOUBLE), 6) AS gc FROM motifs GROUP BY 1",
    "a12_consensus_motifs": f"WITH b AS (SELECT concat('M', item_id // 8) AS motif, upper(regexp_replace(text, '[^acgtACGT]', '', 'g')) AS seq FROM benchmark), u AS (SELECT motif, seq FROM b UNION ALL SELECT motif, {RC} FROM b) SELECT motif, string_agg(seq, ',' ORDER BY seq) AS variants FROM u GROUP BY motif",
    "a13_merge_names": f"WITH {P.MOTIFS}, n AS (SELECT substr(consensus, 1, 2) AS name, motif FROM motifs), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY motif) - 1 AS k FROM n) SELECT name, motif, name || CASE WHEN k > 0 THEN '_' || k ELSE '' END AS unique_name FROM r",
    "a11_meme_round_trip": f"WITH {P.PWM} SELECT motif, pos, {R6} FROM pwm",
    "a24_meme_text": MEME,
    "c1_pwm_sample": f"""WITH {P.PWM}, d AS (SELECT motif, i AS draw, pos, a, c, g, {uniform_sql("'1'", "motif", "i::VARCHAR", "pos::VARCHAR")} AS u FROM pwm, generate_series(0, 49) s(i)) SELECT motif, draw, string_agg({LETTER}, '' ORDER BY pos) AS seq FROM d GROUP BY motif, draw""",
    "c7_permuted_motif": f"""WITH {P.MOTIFS}, t AS (SELECT motif, consensus, att, p - 1 AS pos, substr(consensus, p, 1) AS letter, md5(concat_ws(':', '2', motif, (p - 1)::VARCHAR, att::VARCHAR)) AS key FROM motifs, generate_series(0, 99) a(att), LATERAL (SELECT unnest(generate_series(1, length(consensus))) AS p) b),
      o AS (SELECT *, row_number() OVER (PARTITION BY motif, consensus, att ORDER BY key, pos) - 1 AS place FROM t),
      g AS (SELECT motif, consensus, att, string_agg(letter, '' ORDER BY place) AS permuted, avg((pos <> place)::INT::DOUBLE) AS moved FROM o GROUP BY motif, consensus, att)
      SELECT motif, consensus, arg_min(permuted, att) AS permuted, round(arg_min(moved, att), 6) AS moved FROM g WHERE moved >= 0.3::DOUBLE GROUP BY motif, consensus""",
}
QUERIES = {name: globals()[name] for name in [*ORACLE_SQL, "c3_motif_insertion", "c8_dinuc_shuffle", "c13_pssm_hits"]}
