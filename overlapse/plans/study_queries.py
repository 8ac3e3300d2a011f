"""Statistics over measured pairs, sequences, catalogues and interval evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse.operators import catalog, exact, sequences
from overlapse.operators import elements as E
from overlapse.operators import statistics as S
from overlapse.plans.session import load, written
from overlapse.plans.sketch_queries import K, MINIMIZERS, W, files_intervals
from overlapse.plans import hash_sql
from overlapse.plans.line_queries import CHECKED
from overlapse.sources.delimited import faults
from overlapse.sources.files import chunked

J, RE = "jaccard_similarity_ie", "reg_eq_similarity"


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pair_results")


def error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register equality against Jaccard, by mode and precision."""
    return _rounded(S.error_statistics(_pairs(spark, sf_dir), ["sketch_mode", "sketch_precision"], RE, J))


def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).where(f"{J} is not null and {RE} is not null")
    return _rounded(rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), S.pearson(F.col(J), F.col(RE)).alias("pearson")))


def spearman_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumns({"x": F.round(J, 2), "y": F.round(RE, 2)})
    return _rounded(S.spearman(rows, ["sketch_mode"], "x", "y"))


def kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.kendall(_pairs(spark, sf_dir), ["sketch_mode"], J, RE, 2))


def spearman_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the values as written; ``spearman_ties`` rounds them to two decimals, as its SQL does."""
    return _rounded(S.spearman(_pairs(spark, sf_dir), ["sketch_mode"], J, RE))


def kendall_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the values as written; ``kendall`` rounds them to two decimals, as its SQL does."""
    return _rounded(S.kendall(_pairs(spark, sf_dir), ["sketch_mode"], J, RE))


def binned_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.binned_errors(_pairs(spark, sf_dir), RE, J))


def jackknife_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute error of register equality with each file left out once."""
    return _rounded(S.jackknife(_pairs(spark, sf_dir), "file1", "file2", F.abs(F.col(RE) - F.col(J))))


def floor_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.floor_fits(_pairs(spark, sf_dir), ["sketch_precision"], J, RE), 8)


def unordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.unordered_pairs(_pairs(spark, sf_dir), "file1", "file2", RE))


def rescaled_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.rescaled_errors(_pairs(spark, sf_dir), RE, J), 8)


def replicate_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean floor of each mode with one run left out at a time."""
    return _rounded(S.replicate_spread(_pairs(spark, sf_dir), ["sketch_mode"], "run_id", F.col(RE) - F.col(J)))


def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deciles of Jaccard with the mean register equality in each."""
    return _rounded(S.quantile_bins(_pairs(spark, sf_dir), J, 10, RE))


def size_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.size_residuals(_pairs(spark, sf_dir), ["sketch_precision"], J, RE, "containment_ab", "containment_ba"), 8)


def zero_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.zero_share(_pairs(spark, sf_dir), ["sketch_mode", "sketch_precision"], J))


def interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far Jaccard of mode C lies from what modes B and D measured for the same pairs."""
    best = _pairs(spark, sf_dir).where(f"{J} is not null").groupBy("sketch_mode", "file1", "file2").agg(F.max(J).alias(J))
    mode = lambda m: best.where(F.col("sketch_mode") == m)
    return _rounded(S.interpolation(mode("C"), mode("B"), mode("D"), ["file1", "file2"], ["sketch_mode"], J))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.upper(F.regexp_replace("mark", "[^A-Za-z0-9]", ""))
    return load(spark, sf_dir, "sample_meta").select("sample_id", "tissue", mark.alias("mark"), "species", F.col("ref_name").alias("sample_ref"))


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "bed_files").join(_samples(spark, sf_dir), "sample_id")


def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted Rand index and mutual information of the files' tissues and marks."""
    return _rounded(S.label_agreement(_catalogue(spark, sf_dir), "tissue", "mark"))


def _labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _catalogue(spark, sf_dir).select("label", "tissue", "species")
    one, two = (known.select(F.col("label").alias(f"file{i}"), F.col("tissue").alias(f"t{i}"), F.col("species").alias(f"s{i}")) for i in (1, 2))
    return _pairs(spark, sf_dir).join(one, "file1").join(two, "file2")


def median_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the same tissue against pairs of different ones, by mode."""
    rows = _labelled_pairs(spark, sf_dir).where("t1 is not null and t2 is not null")
    return _rounded(S.stratum_medians(rows, ["sketch_mode"], F.col("t1") == F.col("t2"), J))


def matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean Jaccard by mode and precision in wide form."""
    rows = _pairs(spark, sf_dir).where("sketch_precision is not null").withColumn("p", F.concat(F.lit("p"), "sketch_precision"))
    return rows.groupBy("sketch_mode").pivot("p").agg(F.round(F.avg(J), 9))


def rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How register equality orders pairs, by mode, against Jaccard as the truth."""
    return _rounded(S.rank_agreement(_pairs(spark, sf_dir), ["sketch_mode"], J, RE))


def run_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.run_aggregates(_pairs(spark, sf_dir), ["sketch_mode", "sketch_precision"], J))


def paired_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard of mode C over that of mode B for the same pairs, by the first file's tissue."""
    rows = _labelled_pairs(spark, sf_dir)
    return _rounded(S.paired_ratios(rows, ["t1"], ["file1", "file2"], "sketch_mode", "C", "B", J), 8)


def first_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first measurement of each unordered pair."""
    return S.first_per_pair(_pairs(spark, sf_dir), "file1", "file2", ["written_at", "run_id"], ["run_id", RE])


def pair_set_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every mode and precision measured the pairs of the one that measured most."""
    return S.same_pair_sets(_pairs(spark, sf_dir), ["sketch_mode", "sketch_precision"], ["file1", "file2"])


def species_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the same species against pairs of different ones, by mode."""
    rows = _labelled_pairs(spark, sf_dir).where("s1 is not null and s2 is not null")
    return _rounded(S.stratum_medians(rows, ["sketch_mode"], F.col("s1") == F.col("s2"), J))


def element_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals and positions of each file, and what rates of 0.5 and 0.3 keep of them."""
    return E.counters(files_intervals(spark, sf_dir), ["file_id"], 0.5, 0.3)


def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each reason set lines of an export apart."""
    return catalog.reason_counts(faults(load(spark, sf_dir, "bed_lines")), ["file_name"], "fault")


#: Species and designated reference of the assemblies in the tables.
SPECIES_OF = {"asmA37": "human", "asmA38": "human", "asmT2T": "human"}
REFERENCE_OF = {"human": "asmA38"}


def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by species, as their assembly says, and the species' designated reference."""
    rows = catalog.looked_up(load(spark, sf_dir, "bed_files"), "ref_name", SPECIES_OF, "species", "unknown")
    named = catalog.looked_up(rows, "species", REFERENCE_OF, "reference", "none")
    return named.groupBy("species", "reference").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("ref_name") == F.col("reference")).alias("n_on_reference"))


def catalog_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and distinct samples by species and assembly, with totals and pairs within a group."""
    rows = _catalogue(spark, sf_dir).withColumns({"species": F.coalesce("species", F.lit("unknown")), "assembly": F.coalesce("ref_name", F.lit("unknown"))})
    return catalog.rollup_counts(rows, ["species", "assembly"], "sample_id").withColumn("n_pairs", catalog.pair_count(F.col("n_rows")))


def catalog_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five marks present on both sides with most pairs within a side."""
    return catalog.top_shared(_catalogue(spark, sf_dir), "mark", "list_side", ["list1", "list2"], 5)


def catalog_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of each sample and assembly that was listed last."""
    rows = _catalogue(spark, sf_dir).where("ref_name is not null").select("sample_id", "ref_name", "listed_at", "file_id", "label")
    return catalog.last_of(rows, ["sample_id", "ref_name"], ["listed_at", "file_id"]).select("sample_id", "ref_name", "file_id", "label")


def catalog_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per sample: of the sample's own assembly first, then by precision, date and id."""
    rows = _catalogue(spark, sf_dir)
    own = F.coalesce(F.col("ref_name") == F.col("sample_ref"), F.lit(False))
    best = catalog.best_of(rows, ["sample_id"], F.desc(own), F.desc("sketch_precision"), F.desc("listed_at"), F.asc("file_id"))
    return best.select("sample_id", "file_id", "ref_name", "sketch_precision")


def catalog_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and marks read from paths, with a slug."""
    rows = load(spark, sf_dir, "bed_files").select(F.regexp_extract("label", r"^[^_]+_([a-z]+)_([A-Za-z0-9-]+)\.bed$", 1).alias("tissue"))
    named = rows.where("tissue <> ''").groupBy("tissue").agg(F.count(F.lit(1)).alias("n_files"))
    return named.withColumn("slug", catalog.slug(F.concat(F.lit("Tissue: "), "tissue")))


def median_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median number of valid records per file, by assembly."""
    sizes = files_intervals(spark, sf_dir).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    files = load(spark, sf_dir, "bed_files").select("file_id", "ref_name")
    return files.join(sizes, "file_id").groupBy("ref_name").agg(F.count(F.lit(1)).alias("n_files"), F.median("n").alias("median_records"))


def load_factor_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected register equality of unrelated sketches of each interval file's size."""
    sizes = files_intervals(spark, sf_dir).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(S.load_factor(sizes, ["file_id"], "n", 12))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("file_id"), F.col("text").alias("seq"))


def exact_kmer_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact Jaccard of the canonical k-mers of the documents' sources."""
    sets = written(sequences.kmers(_texts(spark, sf_dir), ["file_id"], K), "kmers")
    return _rounded(exact.set_jaccard(sets, sets, ["file_id"], "kmer").where("file_id_1 < file_id_2"))


def minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct window minimizers of each document."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("seq"))
    found = sequences.minimizers(rows, ["doc_id"], K, W)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_minimizers"), F.min("h").alias("least"), F.max("h").alias("greatest"))


def bed_to_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as intervals on the documents' texts, cut out of a chunked reference."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("seq"))
    rows = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), F.col("l_orderkey").cast("string").alias("chrom"),
        (F.col("l_linenumber") * 37).cast("bigint").alias("start"), (F.col("l_linenumber") * 37 + F.col("l_quantity").cast("bigint")).alias("end"),
    ).distinct()
    return sequences.extract(rows, chunked(docs, width=64), ["file_id"], width=64).select(
        "file_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "seq"
    )


_V = """v AS (SELECT file_id, chrom, start_pos AS s, end_pos AS e FROM intervals
 WHERE file_id IS NOT NULL AND chrom IS NOT NULL AND start_pos >= 0 AND end_pos > start_pos)"""
_SM = "samples AS (SELECT sample_id, tissue, upper(regexp_replace(mark, '[^A-Za-z0-9]', '', 'g')) AS mark, species, ref_name AS sample_ref FROM sample_meta)"
_CAT = f"{_SM}, cat AS (SELECT b.*, tissue, mark, species, sample_ref FROM bed_files b JOIN samples USING (sample_id))"
_LP = f"""{_CAT}, lp AS (SELECT p.*, x.tissue AS t1, y.tissue AS t2, x.species AS s1, y.species AS s2 FROM pair_results p JOIN cat x ON x.label = file1 JOIN cat y ON y.label = file2)"""
_BOTH = f"{J} IS NOT NULL AND {RE} IS NOT NULL"


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN count(*) > 1 AND min({x}) < max({x}) AND min({y}) < max({y}) THEN round(corr({x}, {y}), 9) END"


SQL = {
    "error_stats": f"""SELECT sketch_mode, sketch_precision, count(*) AS n, round(avg(abs({RE} - {J})), 9) AS mae, round(sqrt(avg(({RE} - {J}) ^ 2)), 9) AS rmse,
 round(max(abs({RE} - {J})), 9) AS max_error, round(sqrt(sum(({RE} - {J}) ^ 2)), 9) AS frobenius, {_corr(RE, J)} AS pearson
 FROM pair_results WHERE {_BOTH} GROUP BY ALL""",
    "pearson": f"SELECT run_id, count(*) AS n, {_corr(J, RE)} AS pearson FROM pair_results WHERE {_BOTH} GROUP BY run_id",
    "spearman_ties": f"""WITH r AS (SELECT sketch_mode, round({J}, 2) AS x, round({RE}, 2) AS y FROM pair_results WHERE {_BOTH}),
k AS (SELECT sketch_mode, rank() OVER (PARTITION BY sketch_mode ORDER BY x) + (count(*) OVER (PARTITION BY sketch_mode, x) - 1) / 2 AS rx,
 rank() OVER (PARTITION BY sketch_mode ORDER BY y) + (count(*) OVER (PARTITION BY sketch_mode, y) - 1) / 2 AS ry FROM r)
SELECT sketch_mode, count(*) AS n, {_corr('rx', 'ry')} AS spearman FROM k GROUP BY sketch_mode""",
    "kendall": f"""WITH c AS (SELECT sketch_mode, round({J}, 2) AS x, round({RE}, 2) AS y, count(*) AS n FROM pair_results WHERE {_BOTH} GROUP BY ALL),
p AS (SELECT a.sketch_mode, sum(CASE WHEN b.y > a.y THEN a.n * b.n ELSE 0 END)::BIGINT AS concordant, sum(CASE WHEN b.y < a.y THEN a.n * b.n ELSE 0 END)::BIGINT AS discordant
 FROM c a JOIN c b ON a.sketch_mode = b.sketch_mode AND a.x < b.x GROUP BY a.sketch_mode)
SELECT *, CASE WHEN concordant + discordant > 0 THEN round((concordant - discordant) / (concordant + discordant), 9) END AS tau FROM p""",
    "spearman_raw": f"""WITH r AS (SELECT sketch_mode, {J} AS x, {RE} AS y FROM pair_results WHERE {_BOTH}),
k AS (SELECT sketch_mode, rank() OVER (PARTITION BY sketch_mode ORDER BY x) + (count(*) OVER (PARTITION BY sketch_mode, x) - 1) / 2 AS rx,
 rank() OVER (PARTITION BY sketch_mode ORDER BY y) + (count(*) OVER (PARTITION BY sketch_mode, y) - 1) / 2 AS ry FROM r)
SELECT sketch_mode, count(*) AS n, {_corr('rx', 'ry')} AS spearman FROM k GROUP BY sketch_mode""",
    "kendall_raw": f"""WITH c AS (SELECT sketch_mode, {J} AS x, {RE} AS y, count(*) AS n FROM pair_results WHERE {_BOTH} GROUP BY ALL),
p AS (SELECT a.sketch_mode, sum(CASE WHEN b.y > a.y THEN a.n * b.n ELSE 0 END)::BIGINT AS concordant, sum(CASE WHEN b.y < a.y THEN a.n * b.n ELSE 0 END)::BIGINT AS discordant
 FROM c a JOIN c b ON a.sketch_mode = b.sketch_mode AND a.x < b.x GROUP BY a.sketch_mode)
SELECT *, CASE WHEN concordant + discordant > 0 THEN round((concordant - discordant) / (concordant + discordant), 9) END AS tau FROM p""",
    "binned_errors": f"""SELECT CASE WHEN {J} >= 0.2 THEN 2 WHEN {J} >= 0.05 THEN 1 ELSE 0 END AS stratum, count(*) AS n, round(avg(abs({RE} - {J})), 9) AS mae,
 round(stddev_pop({RE} - {J}), 9) AS sd FROM pair_results WHERE {_BOTH} GROUP BY ALL""",
    "jackknife_se": f"""WITH r AS (SELECT file1, file2, abs({RE} - {J}) AS v FROM pair_results WHERE {_BOTH}),
o AS (SELECT file, sum(v) AS s, count(*) AS c FROM (SELECT file1 AS file, v FROM r UNION ALL SELECT file2, v FROM r WHERE file1 <> file2) GROUP BY file),
t AS (SELECT sum(v) AS big_s, count(*) AS big_n FROM r), m AS (SELECT (big_s - s) / (big_n - c) AS m, big_s, big_n FROM o, t WHERE big_n > c)
SELECT count(*) AS n_files, max(big_n) AS n_pairs, round(max(big_s / big_n), 9) AS mean, round(sqrt((count(*) - 1) * var_pop(m)), 9) AS se FROM m""",
    "floor_fits": f"""SELECT sketch_precision, count(*) AS n, round(regr_intercept({RE}, {J}), 8) AS intercept,
 round(sum((1 - {J}) * ({RE} - {J})) / sum((1 - {J}) * (1 - {J})), 8) AS constrained, round(avg(({RE} - {J}) / (1 - {J})), 8) AS pointwise
 FROM pair_results WHERE {_BOTH} AND {J} < 1 GROUP BY ALL""",
    "rescaled_errors": f"""WITH k AS (SELECT {J} AS j, {RE} AS r FROM pair_results WHERE {_BOTH}),
c AS (SELECT sum((1 - j) * (r - j)) / sum((1 - j) * (1 - j)) AS c FROM k WHERE j < 1),
b AS (SELECT CASE WHEN j >= 0.2 THEN 2 WHEN j >= 0.05 THEN 1 ELSE 0 END AS stratum, count(*) AS n, stddev_pop(r - j) AS sd FROM k GROUP BY ALL)
SELECT stratum, n, round(sd, 8) AS sd, CASE WHEN c < 1 THEN round(sd / (1 - c), 8) END AS sd_rescaled FROM b, c""",
    "replicate_spread": f"""WITH s AS (SELECT sketch_mode, run_id, sum({RE} - {J}) AS s, count(*) AS c FROM pair_results WHERE {_BOTH} GROUP BY ALL),
t AS (SELECT sketch_mode, sum(s) AS big_s, sum(c) AS big_n, count(*) AS n_replicates FROM s GROUP BY sketch_mode)
SELECT sketch_mode, n_replicates, round(max(big_s / big_n), 9) AS mean, round(min((big_s - s) / (big_n - c)), 9) AS least, round(max((big_s - s) / (big_n - c)), 9) AS most
FROM s JOIN t USING (sketch_mode) WHERE big_n > c GROUP BY ALL""",
    "quantile_bins": f"""WITH k AS (SELECT {J} AS j, {RE} AS r, rank() OVER (ORDER BY {J}) + (count(*) OVER (PARTITION BY {J}) - 1) / 2 AS rk, count(*) OVER () AS total
 FROM pair_results WHERE {J} IS NOT NULL)
SELECT CAST(least(10, ceil(rk / total * 10)) AS INTEGER) AS bin, count(*) AS n, round(min(j), 9) AS least, round(max(j), 9) AS most, round(avg(r), 9) AS mean FROM k GROUP BY ALL""",
    "size_residuals": f"""WITH k AS (SELECT sketch_precision, abs(ln(containment_ab / containment_ba)) AS s, {RE} - {J} - 0.17e0 * (1 - {J}) AS e, {J} AS t FROM pair_results
 WHERE containment_ab > 0 AND containment_ba > 0 AND {_BOTH})
SELECT sketch_precision, count(*) AS n, {_corr('e', 's').replace(', 9)', ', 8)')} AS residual_size, {_corr('t', 's').replace(', 9)', ', 8)')} AS truth_size,
 {_corr('t', 'e').replace(', 9)', ', 8)')} AS truth_residual FROM k GROUP BY ALL""",
    "zero_share": f"""SELECT sketch_mode, sketch_precision, count(*) AS n, round(avg(({J} = 0)::INT), 9) AS share_zero, round(avg(({J} > 1)::INT), 9) AS share_above_one
 FROM pair_results WHERE {J} IS NOT NULL GROUP BY ALL""",
    "interpolation": f"""WITH b AS (SELECT sketch_mode, file1, file2, max({J}) AS j FROM pair_results WHERE {J} IS NOT NULL GROUP BY ALL),
m AS (SELECT c.sketch_mode, abs(c.j - x.j) AS a, abs(c.j - y.j) AS b FROM b c
 LEFT JOIN b x ON x.file1 = c.file1 AND x.file2 = c.file2 AND x.sketch_mode = 'B'
 LEFT JOIN b y ON y.file1 = c.file1 AND y.file2 = c.file2 AND y.sketch_mode = 'D'
 WHERE c.sketch_mode = 'C' AND (x.j IS NOT NULL OR y.j IS NOT NULL))
SELECT sketch_mode, count(*) AS n, round(avg(a), 9) AS mean_a, round(quantile_cont(a, 0.25), 9) AS q1_a, round(quantile_cont(a, 0.75), 9) AS q3_a,
 round(avg(b), 9) AS mean_b, round(quantile_cont(b, 0.25), 9) AS q1_b, round(quantile_cont(b, 0.75), 9) AS q3_b FROM m GROUP BY sketch_mode""",
    "unordered_pairs": f"""SELECT least(file1, file2) AS a, greatest(file1, file2) AS b, count(*) AS n, round(min({RE}), 9) AS low, round(max({RE}), 9) AS high,
 max({RE}) - min({RE}) <= 0 AS agree
 FROM pair_results WHERE file1 <> file2 GROUP BY ALL""",
    "label_agreement": f"""WITH {_CAT}, x AS (SELECT tissue AS a, mark AS b, count(*) AS n FROM cat WHERE tissue IS NOT NULL AND mark IS NOT NULL GROUP BY ALL),
ra AS (SELECT a, sum(n) AS n FROM x GROUP BY a), rb AS (SELECT b, sum(n) AS n FROM x GROUP BY b),
s AS (SELECT (SELECT sum(n) FROM x)::DOUBLE AS n, (SELECT sum(n * (n - 1) / 2) FROM x) AS px, (SELECT sum(n * (n - 1) / 2) FROM ra) AS pa, (SELECT sum(n * (n - 1) / 2) FROM rb) AS pb,
 (SELECT sum(n * ln(n)) FROM x) AS ex, (SELECT sum(n * ln(n)) FROM ra) AS ea, (SELECT sum(n * ln(n)) FROM rb) AS eb),
h AS (SELECT *, ln(n) - ea / n AS ha, ln(n) - eb / n AS hb, ln(n) - ex / n AS hx, pa * pb / (n * (n - 1) / 2) AS ev, (pa + pb) / 2 AS top FROM s)
SELECT n::BIGINT AS n, round((px - ev) / (top - ev), 9) AS ari, round(2 * (ha + hb - hx) / (ha + hb), 9) AS nmi FROM h""",
    "median_strata": f"""WITH {_LP} SELECT sketch_mode, count(*) FILTER (t1 = t2) AS n_same, count(*) FILTER (t1 <> t2) AS n_different,
 round(median({J}) FILTER (t1 = t2), 9) AS median_same, round(median({J}) FILTER (t1 <> t2), 9) AS median_different,
 round(median({J}) FILTER (t1 = t2) - median({J}) FILTER (t1 <> t2), 9) AS delta, min({J}) FILTER (t1 = t2) > max({J}) FILTER (t1 <> t2) AS separated
 FROM lp WHERE t1 IS NOT NULL AND t2 IS NOT NULL AND {J} IS NOT NULL GROUP BY sketch_mode""",
    "matrix_pivot": f"PIVOT (SELECT sketch_mode, 'p' || sketch_precision AS p, {J} AS j FROM pair_results WHERE sketch_precision IS NOT NULL) ON p USING round(avg(j), 9) GROUP BY sketch_mode",
    "rank_agreement": f"""WITH k AS (SELECT row_number() OVER () AS i, sketch_mode, {J} AS x, {RE} AS y FROM pair_results WHERE {_BOTH}),
p AS (SELECT a.sketch_mode, count(*) AS n, sum((sign(a.x - b.x) * sign(a.y - b.y) < 0)::INT) AS d, sum((a.x = b.x OR a.y = b.y)::INT) AS t, sum((a.x = b.x)::INT) AS tx,
 sum((a.y = b.y)::INT) AS ty, max(CASE WHEN sign(a.x - b.x) * sign(a.y - b.y) < 0 THEN abs(a.x - b.x) ELSE 0.0 END) AS gap
 FROM k a JOIN k b ON a.sketch_mode = b.sketch_mode AND a.i < b.i GROUP BY a.sketch_mode), z AS (SELECT sketch_mode, sum((y = 0)::INT) AS z FROM k GROUP BY sketch_mode)
SELECT sketch_mode, n AS comparisons, d::BIGINT AS discordant, t::BIGINT AS tied, round((n - 2 * d - t) / n, 9) AS tau_a,
 CASE WHEN n > tx AND n > ty THEN round((n - 2 * d - t) / sqrt((n - tx)::DOUBLE * (n - ty)), 9) END AS tau_b, round(gap, 9) AS max_inverted_gap, z::BIGINT AS clamped_at_zero FROM p JOIN z USING (sketch_mode)""",
    "run_aggregates": f"""SELECT sketch_mode, sketch_precision, count(*) AS n, round(avg({J}), 9) AS mean, round(stddev_pop({J}), 9) AS std, round(min({J}), 9) AS least,
 round(max({J}), 9) AS most FROM pair_results WHERE {J} IS NOT NULL GROUP BY ALL""",
    "paired_ratios": f"""WITH {_LP}, b AS (SELECT t1, median({J}) FILTER (sketch_mode = 'C') AS c, median({J}) FILTER (sketch_mode = 'B') AS d FROM lp GROUP BY t1, file1, file2)
SELECT t1, count(*) AS n, round(median(c / d), 8) AS median, round(min(c / d), 8) AS least, round(max(c / d), 8) AS most FROM b WHERE c IS NOT NULL AND d <> 0 GROUP BY t1""",
    "first_pairs": f"""SELECT least(file1, file2) AS a, greatest(file1, file2) AS b, run_id, {RE} FROM pair_results
 QUALIFY row_number() OVER (PARTITION BY least(file1, file2), greatest(file1, file2) ORDER BY written_at NULLS FIRST, run_id NULLS FIRST, {RE} NULLS FIRST) = 1""",
    "pair_set_cover": """WITH e AS (SELECT DISTINCT sketch_mode, sketch_precision, file1, file2 FROM pair_results), n AS (SELECT sketch_mode, sketch_precision, count(*) AS n FROM e GROUP BY ALL),
w AS (SELECT * FROM n ORDER BY n DESC, sketch_mode NULLS FIRST, sketch_precision NULLS FIRST LIMIT 1),
m AS (SELECT DISTINCT file1, file2 FROM e JOIN w ON e.sketch_mode IS NOT DISTINCT FROM w.sketch_mode AND e.sketch_precision IS NOT DISTINCT FROM w.sketch_precision),
s AS (SELECT e.sketch_mode, e.sketch_precision, count(*) AS n FROM e SEMI JOIN m ON e.file1 IS NOT DISTINCT FROM m.file1 AND e.file2 IS NOT DISTINCT FROM m.file2 GROUP BY ALL)
SELECT n.sketch_mode, n.sketch_precision, n.n AS n_pairs, coalesce(s.n, 0) AS n_shared, n.n = w.n AND coalesce(s.n, 0) = w.n AS complete FROM n CROSS JOIN w
 LEFT JOIN s ON n.sketch_mode IS NOT DISTINCT FROM s.sketch_mode AND n.sketch_precision IS NOT DISTINCT FROM s.sketch_precision""",
    "species_strata": f"""WITH {_LP} SELECT sketch_mode, count(*) FILTER (s1 = s2) AS n_same, count(*) FILTER (s1 <> s2) AS n_different,
 round(median({J}) FILTER (s1 = s2), 9) AS median_same, round(median({J}) FILTER (s1 <> s2), 9) AS median_different,
 round(median({J}) FILTER (s1 = s2) - median({J}) FILTER (s1 <> s2), 9) AS delta, min({J}) FILTER (s1 = s2) > max({J}) FILTER (s1 <> s2) AS separated
 FROM lp WHERE s1 IS NOT NULL AND s2 IS NOT NULL AND {J} IS NOT NULL GROUP BY sketch_mode""",
    "element_counters": f"""WITH {_V}, t AS (SELECT *, {hash_sql.xxh32("chrom || chr(9) || s || chr(9) || e || chr(9) || 'A'")} <= {E.threshold(0.5)} AS kept FROM v),
d AS (SELECT chrom, CASE WHEN {hash_sql.xxh32("chrom")} / {float((1 << 32) - 1)} < {E.strides(0.3)[2]!r} THEN {E.strides(0.3)[1]} ELSE {E.strides(0.3)[0]} END AS stride FROM (SELECT DISTINCT chrom FROM v)),
r AS (SELECT chrom, stride, CAST({hash_sql.xxh32("chrom || '|res'")} % stride AS BIGINT) AS residue FROM d)
SELECT file_id, count(*) AS n_intervals, count(*) FILTER (kept) AS kept_intervals, sum(e - s)::BIGINT AS n_points,
 sum((e - 1 - residue + 1000 * stride) // stride - (s - 1 - residue + 1000 * stride) // stride)::BIGINT AS sampled_points FROM t JOIN r USING (chrom) GROUP BY file_id""",
    "failure_counts": CHECKED + "SELECT file_name, fault, count(*) AS n FROM c JOIN bed_lines USING (line_id) WHERE fault IS NOT NULL GROUP BY ALL",
    "catalog_lookup": """SELECT species, CASE WHEN species = 'human' THEN 'asmA38' ELSE 'none' END AS reference, count(*) AS n_files,
 count(*) FILTER (ref_name = CASE WHEN species = 'human' THEN 'asmA38' ELSE 'none' END) AS n_on_reference
 FROM (SELECT ref_name, CASE WHEN ref_name IN ('asmA37', 'asmA38', 'asmT2T') THEN 'human' ELSE 'unknown' END AS species FROM bed_files) GROUP BY ALL""",
    "catalog_rollup": f"""WITH {_CAT}, r AS (SELECT coalesce(species, 'unknown') AS species, coalesce(ref_name, 'unknown') AS assembly, sample_id FROM cat)
SELECT species, assembly, grouping(species, assembly)::BIGINT AS level, count(*) AS n_rows, count(DISTINCT sample_id) AS n_items,
 (count(*) * (count(*) - 1) / 2)::BIGINT AS n_pairs FROM r GROUP BY ROLLUP (species, assembly)""",
    "catalog_topn": f"""WITH {_CAT}, w AS (SELECT mark AS marker, count(*) FILTER (list_side = 'list1') AS a, count(*) FILTER (list_side = 'list2') AS b
 FROM cat WHERE mark IS NOT NULL GROUP BY mark) SELECT marker, (a * (a - 1) / 2)::BIGINT + (b * (b - 1) / 2)::BIGINT AS pairs, a + b AS total FROM w WHERE a > 0 AND b > 0
 ORDER BY pairs DESC, total DESC, marker DESC LIMIT 5""",
    "catalog_last": f"""WITH {_CAT} SELECT sample_id, ref_name, file_id, label FROM cat WHERE ref_name IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY sample_id, ref_name ORDER BY listed_at DESC NULLS LAST, file_id DESC) = 1""",
    "catalog_best": f"""WITH {_CAT} SELECT sample_id, file_id, ref_name, sketch_precision FROM cat
 QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY coalesce(ref_name = sample_ref, false) DESC, sketch_precision DESC NULLS LAST, listed_at DESC NULLS LAST, file_id) = 1""",
    "catalog_paths": r"""SELECT regexp_extract(label, '^[^_]+_([a-z]+)_([A-Za-z0-9-]+)\.bed$', 1) AS tissue, count(*) AS n_files,
 'tissue_' || regexp_extract(label, '^[^_]+_([a-z]+)_([A-Za-z0-9-]+)\.bed$', 1) AS slug FROM bed_files
 WHERE regexp_extract(label, '^[^_]+_([a-z]+)_([A-Za-z0-9-]+)\.bed$', 1) <> '' GROUP BY ALL""",
    "median_intervals": f"""WITH {_V}, n AS (SELECT file_id, count(*) AS n FROM v GROUP BY file_id)
SELECT ref_name, count(*) AS n_files, median(n) AS median_records FROM bed_files JOIN n USING (file_id) GROUP BY ref_name""",
    "load_factor_floor": f"""WITH {_V}, n AS (SELECT file_id, count(*) / 4096e0 AS load FROM v GROUP BY file_id),
k AS (SELECT file_id, load, unnest(range(1, 54)) AS k FROM n),
p AS (SELECT file_id, load, exp(-load / 2e0 ^ k) - exp(-load / 2e0 ^ (k - 1)) AS p FROM k)
SELECT file_id, round(load, 9) AS load, round(sum(p * p) / (1 - exp(-load) * exp(-load)), 9) AS floor FROM p GROUP BY file_id, load""",
    "exact_kmer_jaccard": f"""WITH d AS (SELECT source AS file_id, upper(text) AS s FROM documents WHERE source IS NOT NULL AND length(text) >= {K}),
r AS (SELECT file_id, substr(s, unnest(range(1, length(s) - {K - 2})), {K}) AS kmer FROM d),
c AS (SELECT DISTINCT file_id, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer FROM r WHERE NOT contains(kmer, 'N')),
n AS (SELECT file_id, count(*) AS n FROM c GROUP BY file_id),
i AS (SELECT a.file_id AS file_id_1, b.file_id AS file_id_2, count(*) AS intersection FROM c a JOIN c b USING (kmer) WHERE a.file_id < b.file_id GROUP BY ALL)
SELECT i.*, x.n + y.n - intersection AS union_size, round(intersection / (x.n + y.n - intersection), 9) AS jaccard
FROM i JOIN n x ON x.file_id = file_id_1 JOIN n y ON y.file_id = file_id_2""",
    "minimizers": "WITH docs AS (SELECT doc_id, text FROM documents), "
    + MINIMIZERS.replace("{key}", "doc_id")
    + " SELECT doc_id, count(*) AS n_minimizers, min(h) AS least, max(h) AS greatest FROM m GROUP BY doc_id",
    "bed_to_sequence": """WITH r AS (SELECT DISTINCT l_orderkey AS file_id, l_linenumber * 37 AS s, l_linenumber * 37 + CAST(l_quantity AS BIGINT) AS e FROM lineitem)
SELECT file_id, s AS start_pos, e AS end_pos, substr(text, s + 1, e - s) AS seq FROM r JOIN documents ON doc_id = file_id
WHERE ((s // 64) * 64 < length(text)) OR (s // 64 = 0)""",
}
QUERIES = {
    q.__name__: q
    for q in (
        error_stats, pearson, spearman_ties, kendall, spearman_raw, kendall_raw, rank_agreement, binned_errors, jackknife_se, floor_fits,
        rescaled_errors, replicate_spread, run_aggregates, paired_ratios, quantile_bins, size_residuals, zero_share, interpolation,
        unordered_pairs, first_pairs, pair_set_cover, label_agreement, median_strata, species_strata, matrix_pivot, catalog_rollup,
        catalog_topn, catalog_last, catalog_best, catalog_lookup, catalog_paths, failure_counts, median_intervals, element_counters,
        load_factor_floor, exact_kmer_jaccard, minimizers, bed_to_sequence,
    )
}
