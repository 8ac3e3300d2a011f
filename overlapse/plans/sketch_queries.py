"""Elements, samplers, sketches and pair metrics over the order lines, and over interval files.

An order line is read as an interval: its supplier is the file, its line number the chromosome, ten
times its part the start and its quantity the length.  The SQL computes XXH64 and XXH32 as well.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse.operators import elements as E
from overlapse.operators import exact, pairwise, sequences
from overlapse.operators import registers as R
from overlapse.plans import hash_sql
from overlapse.plans.session import load, written
from overlapse.sources.files import parse_records
from overlapse.streaming.sketching import run_registers

P, BITS, QUERY_STEP = 10, 64, 100
K, W = 8, 20


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("file_id"),
        F.concat(F.lit("chr"), F.col("l_linenumber")).alias("chrom"),
        (F.col("l_partkey") * 10).alias("start"),
        (F.col("l_partkey") * 10 + F.col("l_quantity").cast("bigint")).alias("end"),
    )


def files_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "intervals").where("file_id is not null and chrom is not null and start_pos >= 0 and end_pos > start_pos")
    return rows.select("file_id", "chrom", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))


def bed_parse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid records of raw lines, as an interval reader takes them."""
    return parse_records(load(spark, sf_dir, "bed_lines"), "line_text").select(
        "line_id", "chrom", F.col("start").alias("start_pos"), F.col("end").alias("end_pos")
    )


def _counted(elements: DataFrame) -> DataFrame:
    return elements.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_elements"), F.countDistinct("element").alias("n_distinct"), F.min("element").alias("least"), F.max("element").alias("greatest")
    )


def interval_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(E.interval_elements(files_intervals(spark, sf_dir), ["file_id"]))


def point_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(E.point_elements(lines(spark, sf_dir), ["file_id"]))


def hybrid_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(E.hybrid_elements(lines(spark, sf_dir), ["file_id"], 0.5, 1.0, 0.5))


def sampled(method: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(E.point_elements(lines(spark, sf_dir), ["file_id"], 0.3, method))


def _interval_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.registers(E.interval_elements(files_intervals(spark, sf_dir), ["file_id"]), ["file_id"], P)


def hll_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interval_registers(spark, sf_dir).withColumn("rho", F.col("rho").cast("int"))


def hll_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers of whole assemblies, from those of their files."""
    files = load(spark, sf_dir, "bed_files").select("file_id", "ref_name").where("ref_name is not null")
    merged = R.merge(_interval_registers(spark, sf_dir).join(files, "file_id"), ["ref_name"])
    return merged.withColumn("rho", F.col("rho").cast("int"))


def hll_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(_interval_registers(spark, sf_dir), ["file_id"]).withColumn("rho", F.col("rho").cast("int"))


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def hll_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates for every interval file, those without valid records included (exactly 0)."""
    every = load(spark, sf_dir, "bed_files").where("file_kind = 'interval'").select("file_id")
    return _rounded(R.cardinality(_interval_registers(spark, sf_dir), ["file_id"], P, BITS, every=every), 6)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth file against all files, over dense sketches."""
    sketches = written(R.point_sketches(lines(spark, sf_dir), ["file_id"], P), "sketches")
    return pairwise.dense_pairs(sketches.where(f"file_id % {QUERY_STEP} = 0"), sketches, ["file_id"], P, BITS)


def pair_metrics(columns: tuple[str, ...], spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_dense(spark, sf_dir).select("file_id_1", "file_id_2", *columns))


def pair_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval files of list 1 against those of list 2 that share a register, over sparse sketches."""
    sides = load(spark, sf_dir, "bed_files").where("file_kind = 'interval'").select("file_id", "list_side")
    regs = written(_interval_registers(spark, sf_dir).join(sides, "file_id"), "registers")
    one, two = (regs.where(F.col("list_side") == s).drop("list_side") for s in ("list1", "list2"))
    found = pairwise.sparse_pairs(one, two, ["file_id"], P, BITS)
    # ``round`` goes through decimal texts, which takes longer than the comparison.
    return found.select("file_id_1", "file_id_2", *((F.floor(F.col(c) * 1e9 + 0.5) / 1e9).alias(c) for c in pairwise.SHAPES["full"]))


def _listed(spark: SparkSession, sf_dir: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What belongs to interval files of list 1, and of list 2."""
    sides = load(spark, sf_dir, "bed_files").where("file_kind = 'interval'").select("file_id", "list_side")
    known = rows.join(sides, "file_id")
    return known.where("list_side = 'list1'").drop("list_side"), known.where("list_side = 'list2'").drop("list_side")


def _listed_pairs(spark: SparkSession, sf_dir: str, sketches: DataFrame, p: int) -> DataFrame:
    found = pairwise.dense_pairs(*_listed(spark, sf_dir, written(sketches, "sketches")), ["file_id"], p)
    return pairwise.shaped(found, "full", ["file_id_1", "file_id_2"])


def pair_points_xxh64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode B as run in production: fused point sketches by xxHash of the interval files, those of list 1
    with those of list 2, all metrics."""
    return _listed_pairs(spark, sf_dir, R.point_sketches(files_intervals(spark, sf_dir), ["file_id"], 14), 14)


def pair_hybrid_xxh64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode C in the same way: whole intervals and every position."""
    rows, p = files_intervals(spark, sf_dir), 14
    whole = R.dense(R.registers(E.interval_elements(rows, ["file_id"]), ["file_id"], p), ["file_id"], p)
    return _listed_pairs(spark, sf_dir, R.merged_sketches(whole.unionByName(R.point_sketches(rows, ["file_id"], p)), ["file_id"]), p)


def pair_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode D from sequences to metrics: minimizers of the documents' texts as sets of their sources, all sources
    with all."""
    rows = load(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("file_id"), F.col("text").alias("seq"))
    regs = R.registers_of_hashes(sequences.minimizers(rows, ["file_id"], K, W), ["file_id"], P)
    sketches = written(R.dense(regs, ["file_id"], P), "sketches")
    found = pairwise.dense_pairs(sketches, sketches, ["file_id"], P)
    return _rounded(found.where("file_id_1 < file_id_2").select("file_id_1", "file_id_2", "matching", "active", *pairwise.SHAPES["full"]))


def exact_files_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base-pair Jaccard of the interval files of list 1 with those of list 2 that overlap."""
    return _rounded(exact.interval_jaccard(*_listed(spark, sf_dir, files_intervals(spark, sf_dir)), ["file_id"]))


def exact_interval_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    return _rounded(exact.interval_jaccard(rows.where(f"file_id % {QUERY_STEP} = 0"), rows, ["file_id"]))


def exact_set_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact Jaccard of the parts that suppliers sell."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file_id"), "l_partkey")
    return _rounded(exact.set_jaccard(rows.where(f"file_id % {QUERY_STEP} = 0"), rows, ["file_id"], "l_partkey"))


def stream_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registers of a stream of interval records; the same as the batch ones."""
    schema = load(spark, sf_dir, "intervals").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/intervals.parquet*")
    rows = rows.where("file_id is not null and chrom is not null and start_pos >= 0 and end_pos > start_pos")
    flat = rows.select("file_id", "chrom", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
    found = run_registers(E.interval_elements(flat, ["file_id"]), ["file_id"], P)
    return found.withColumn("rho", F.col("rho").cast("int"))


_LINES = """lines AS (SELECT l_suppkey AS file_id, 'chr' || l_linenumber AS chrom, l_partkey * 10 AS s,
 l_partkey * 10 + CAST(l_quantity AS BIGINT) AS e FROM lineitem)"""
_POINTS = f"""{_LINES}, points AS (SELECT file_id, chrom, s, e, chrom || chr(9) || unnest(range(s, e)) AS element,
 unnest(range(s, e)) AS pos FROM lines)"""
_FILES = """files AS (SELECT file_id, chrom || chr(9) || start_pos || chr(9) || end_pos || chr(9) || 'A' AS element FROM intervals
 WHERE file_id IS NOT NULL AND chrom IS NOT NULL AND start_pos >= 0 AND end_pos > start_pos)"""
_COUNTED = "SELECT file_id, count(*) AS n_elements, count(DISTINCT element) AS n_distinct, min(element) AS least, max(element) AS greatest FROM {0} GROUP BY file_id"


_gate = hash_sql.xxh32


def _regs(source: str, key: str = "file_id", h: str = hash_sql.xxh64("element")) -> str:
    """CTE ``regs``: zeros at the end of the rest are found from its lowest set bit."""
    return f"""hashes AS (SELECT {key}, {h} AS h FROM {source}),
split AS (SELECT {key}, CAST(h & {(1 << P) - 1} AS INTEGER) AS idx, CAST(h >> {P} AS BIGINT) AS rest FROM hashes),
regs AS (SELECT {key}, idx, CAST(max(CASE WHEN rest = 0 THEN {BITS - P + 1} ELSE bit_count((rest & -rest) - 1) + 1 END) AS INTEGER) AS rho
         FROM split GROUP BY ALL)"""


def _ertl(counts: str, out: str) -> str:
    """CTEs that turn ``counts`` (k, c: list of q + 2 counts) into ``out`` (k, card)."""
    q, m = BITS - P, f"{1 << P}e0"
    blank = "list_transform(range(64), lambda i: {'x': 0.0::DOUBLE, 'y': 0.0::DOUBLE, 'z': 0.0::DOUBLE})"
    tau = f"list_reduce([{{'x': tx, 'y': 1.0::DOUBLE, 'z': 1 - tx}}] || {blank}, lambda a, b: {{'x': sqrt(a.x), 'y': a.y * 0.5, 'z': a.z - (1 - sqrt(a.x)) * (1 - sqrt(a.x)) * a.y * 0.5}}).z / 3"
    sigma = f"list_reduce([{{'x': sx, 'y': 1.0::DOUBLE, 'z': sx}}] || {blank}, lambda a, b: {{'x': a.x * a.x, 'y': a.y * 2, 'z': a.z + a.x * a.x * a.y}}).z"
    return f"""{out}_a AS (SELECT k, c, ({m} - c[{q + 2}]) / {m} AS tx, c[1] / {m} AS sx FROM {counts}),
{out}_b AS (SELECT k, c, sx, {m} * CASE WHEN tx = 0 OR tx = 1 THEN 0.0 WHEN tx = 0.5 THEN (1 - tx) / 3 ELSE {tau} END AS top,
           CASE WHEN sx = 1 THEN 0.0 ELSE {sigma} END AS s FROM {out}_a),
{out}_c AS (SELECT k, sx, list_reduce([top] || list_transform(list_reverse(c[2:{q + 1}]), lambda v: v::DOUBLE), lambda z, v: (z + v) * 0.5) + {m} * s AS z FROM {out}_b),
{out} AS (SELECT k, CASE WHEN sx = 1 THEN 0.0 ELSE {1 / (2 * 0.6931471805599453)}e0 * {m} * {m} / z END AS card FROM {out}_c)"""


_TOP = BITS - P + 1
_OWN_COUNTS = f"""hist AS (SELECT file_id, rho, count(*) AS n FROM regs GROUP BY ALL),
maps AS (SELECT file_id, map_from_entries(list((rho, n))) AS hm, sum(n) AS filled FROM hist GROUP BY file_id),
own_counts AS (SELECT file_id AS k, [{1 << P} - filled] || list_transform(range(1, {_TOP + 1}), lambda i: coalesce(hm[i::INTEGER], 0)) AS c, filled FROM maps)"""


def _pairs(one: str, two: str, every: bool) -> str:
    """CTE ``pairs`` with all metrics; ``every`` keeps pairs that share no register."""
    return f"""met AS (SELECT a.file_id AS k1, b.file_id AS k2, least(a.rho, b.rho) AS low, count(*) AS n, sum((a.rho = b.rho)::INT) AS eq
        FROM ({one}) a JOIN ({two}) b USING (idx) GROUP BY ALL),
sums AS (SELECT k1, k2, sum(n) AS both_n, sum(eq) AS matching, map_from_entries(list((low, n))) AS lm FROM met GROUP BY ALL),
grid AS ({"SELECT DISTINCT a.file_id AS k1, b.file_id AS k2 FROM (" + one + ") a CROSS JOIN (" + two + ") b" if every else "SELECT k1, k2 FROM sums"}),
full_counts AS (SELECT g.k1, g.k2, coalesce(both_n, 0) AS both_n, coalesce(matching, 0) AS matching, x.filled + y.filled - coalesce(both_n, 0) AS active,
   [{1 << P} - (x.filled + y.filled - coalesce(both_n, 0))] || list_transform(range(1, {_TOP + 1}),
      lambda i: x.c[i + 1] + y.c[i + 1] - coalesce(lm[i::INTEGER], 0)) AS c
   FROM grid g LEFT JOIN sums s ON s.k1 = g.k1 AND s.k2 = g.k2 JOIN own_counts x ON x.k = g.k1 JOIN own_counts y ON y.k = g.k2),
pair_counts AS (SELECT (k1, k2) AS k, c FROM full_counts),
{_ertl("own_counts", "own")},
{_ertl("pair_counts", "uni")},
base AS (SELECT f.k1 AS file_id_1, f.k2 AS file_id_2, matching, active, a.card AS card_1, b.card AS card_2, u.card AS card_union,
   greatest(a.card + b.card - u.card, 0.0) AS shared FROM full_counts f JOIN own a ON a.k = f.k1 JOIN own b ON b.k = f.k2 JOIN uni u ON u.k = (f.k1, f.k2)),
cont AS (SELECT *, CASE WHEN card_1 > 0 THEN shared / card_1 ELSE 0.0 END AS ab, CASE WHEN card_2 > 0 THEN shared / card_2 ELSE 0.0 END AS ba FROM base),
pairs AS (SELECT file_id_1, file_id_2, matching, active, round(card_union, 9) AS card_union, round(shared, 9) AS shared,
   round(matching / active, 9) AS reg_eq_similarity,
   round(CASE WHEN ab > 1e-300 AND ba > 1e-300 THEN 1 / (1 / least(ab, 1.0) + 1 / least(ba, 1.0) - 1) ELSE 0.0 END, 9) AS jaccard_similarity_ie,
   round(ab, 9) AS containment_ab, round(ba, 9) AS containment_ba, round(sqrt(greatest(ab * ba, 0)), 9) AS cosketch_geom,
   round((ab + ba) / 2, 9) AS cosketch_arith, round(greatest(ab, ba), 9) AS cosketch_max FROM cont)"""


_LINE_PAIRS = f"WITH {_POINTS}, {_regs('points')}, {_OWN_COUNTS}, " + _pairs(
    f"SELECT * FROM regs WHERE file_id % {QUERY_STEP} = 0", "SELECT * FROM regs", True
)
_SHAPE = {
    "pair_register_equality": ("matching", "active", "reg_eq_similarity"),
    "pair_union_cardinality": ("card_union",),
    "pair_intersection": ("shared",),
    "pair_containment": ("containment_ab", "containment_ba"),
    "pair_jaccard_ie": ("jaccard_similarity_ie",),
    "pair_cosketch": ("cosketch_geom", "cosketch_arith", "cosketch_max"),
    "pair_full": pairwise.SHAPES["full"],
}
_LOOSE = {
    **{c: f"round({c}, 6)" for c in ("card_union", "shared")},
    **{c: f"CAST({c} AS BIGINT)" for c in ("matching", "active")},
}


def _stride_sql() -> str:
    short, long, share = E.strides(0.3)
    return f"""WITH {_LINES}, names AS (SELECT DISTINCT chrom FROM lines),
strides AS (SELECT chrom, CASE WHEN {_gate('chrom')} / {float((1 << 32) - 1)} < {share!r} THEN {long} ELSE {short} END AS stride FROM names),
dim AS (SELECT chrom, stride, {_gate("chrom || '|res'")} % stride AS residue FROM strides),
picked AS (SELECT file_id, chrom || chr(9) || pos AS element FROM (SELECT file_id, chrom, unnest(range(s, e)) AS pos FROM lines)
           JOIN dim USING (chrom) WHERE pos % stride = residue) """


# Window minimizers of texts: CTE ``m`` ({key}, h) from ``docs`` ({key}, text).
MINIMIZERS = f"""d AS (SELECT {{key}}, row_number() OVER () AS no, upper(text) AS s FROM docs WHERE length(text) >= {K + W - 1}),
i AS (SELECT {{key}}, no, unnest(range(1, length(s) - {K - 2})) AS i, s FROM d),
r AS MATERIALIZED (SELECT {{key}}, no, i, substr(s, i, {K}) AS kmer FROM i),
h AS (SELECT {{key}}, no, i, CAST({hash_sql.xxh64("kmer")} & 4294967295 AS BIGINT) AS h FROM r),
w AS (SELECT {{key}}, i, min(h) OVER (PARTITION BY no ORDER BY i ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS h,
 count(*) OVER (PARTITION BY no ORDER BY i ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS n FROM h),
m AS (SELECT DISTINCT {{key}}, h FROM w WHERE n = {W}
 UNION SELECT {{key}}, {hash_sql.signed(hash_sql.xxh64("upper(text)", long_texts=True))} FROM docs WHERE length(text) < {K + W - 1} AND text <> '')"""
_T = E.threshold(0.3)
SQL = {
    "pair_sequences": "WITH docs AS (SELECT source AS file_id, text FROM documents WHERE source IS NOT NULL), "
    + MINIMIZERS.replace("{key}", "file_id")
    + f", {_regs('m', h='list_transform([h], lambda h_v: CASE WHEN h_v < 0 THEN CAST(h_v AS HUGEINT) + 18446744073709551616 ELSE CAST(h_v AS HUGEINT) END)[1]')}, {_OWN_COUNTS}, "
    + _pairs("SELECT * FROM regs", "SELECT * FROM regs", True)
    + f" SELECT file_id_1, file_id_2, matching::BIGINT AS matching, active::BIGINT AS active, {', '.join(pairwise.SHAPES['full'])} FROM pairs WHERE file_id_1 < file_id_2",
    "bed_parse_filter": r"""
WITH t AS (SELECT line_id, rtrim(line_text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS line FROM bed_lines),
m AS (SELECT line_id, regexp_extract(line, '^\s*(\S+)\s+([+-]?[0-9]+)(\s+[+-]?[0-9]+|[+-][0-9]+)', ['chrom', 's', 'e']) AS g FROM t
      WHERE line <> '' AND NOT regexp_matches(line, '^(#|@|track|browser)')
        AND regexp_matches(line, '^\s*(\S+)\s+([+-]?[0-9]+)(\s+[+-]?[0-9]+|[+-][0-9]+)')),
n AS (SELECT line_id, g.chrom AS chrom, try_cast(g.s AS BIGINT) AS start_pos,
             try_cast(trim(g.e, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS BIGINT) AS end_pos FROM m)
SELECT * FROM n WHERE start_pos >= 0 AND end_pos > start_pos""",
    "interval_elements": f"WITH {_FILES} " + _COUNTED.format("files"),
    "point_elements": f"WITH {_POINTS} " + _COUNTED.format("points"),
    "hybrid_elements": f"""WITH {_POINTS}, whole AS (SELECT file_id, chrom || chr(9) || s || chr(9) || e || chr(9) || 'A' AS element FROM lines),
kept AS (SELECT file_id, element || unnest(range(1, 4)) AS element FROM whole WHERE {_gate('element')} <= {E.threshold(0.5)}),
every AS (SELECT * FROM kept UNION ALL SELECT file_id, element FROM points) """
    + _COUNTED.format("every"),
    "sample_single_hash": f"WITH {_POINTS}, kept AS (SELECT * FROM points WHERE ({hash_sql.xxh64('element')} >> 32) <= {_T}) " + _COUNTED.format("kept"),
    "sample_hash_threshold": f"WITH {_POINTS}, kept AS (SELECT * FROM points WHERE {_gate('element')} <= {_T}) " + _COUNTED.format("kept"),
    "sample_mixed_stride": _stride_sql() + _COUNTED.format("picked"),
    "hll_registers": f"WITH {_FILES}, {_regs('files')} SELECT * FROM regs",
    "hll_merge": f"WITH {_FILES}, {_regs('files')} SELECT ref_name, idx, max(rho) AS rho FROM regs JOIN bed_files USING (file_id) WHERE ref_name IS NOT NULL GROUP BY ALL",
    "hll_histogram": f"WITH {_FILES}, {_regs('files')} SELECT file_id, rho, count(*) AS n FROM regs GROUP BY ALL",
    "hll_cardinality": f"""WITH {_FILES}, {_regs('files')}, {_OWN_COUNTS}, {_ertl("own_counts", "own")}
SELECT b.file_id, coalesce(round(card, 6), 0.0) AS cardinality FROM (SELECT DISTINCT file_id FROM bed_files WHERE file_kind = 'interval') b
LEFT JOIN own ON own.k = b.file_id""",
    "pair_sparse": f"WITH {_FILES}, {_regs('files')}, {_OWN_COUNTS}, "
    + _pairs(
        "SELECT r.* FROM regs r JOIN bed_files USING (file_id) WHERE file_kind = 'interval' AND list_side = 'list1'",
        "SELECT r.* FROM regs r JOIN bed_files USING (file_id) WHERE file_kind = 'interval' AND list_side = 'list2'",
        False,
    )
    + f" SELECT file_id_1, file_id_2, {', '.join(pairwise.SHAPES['full'])} FROM pairs",
    **{name: _LINE_PAIRS + f" SELECT file_id_1, file_id_2, {', '.join(f'{_LOOSE.get(c, c)} AS {c}' for c in cols)} FROM pairs" for name, cols in _SHAPE.items()},
    "exact_interval_jaccard": f"""WITH {_POINTS}, d AS (SELECT DISTINCT file_id, chrom, pos FROM points), n AS (SELECT file_id, count(*) AS n FROM d GROUP BY file_id),
m AS (SELECT a.file_id AS file_id_1, b.file_id AS file_id_2, chrom, pos, lag(pos) OVER (PARTITION BY a.file_id, b.file_id, chrom ORDER BY pos) AS before FROM d a JOIN d b USING (chrom, pos)
 WHERE a.file_id % {QUERY_STEP} = 0),
i AS (SELECT file_id_1, file_id_2, count(*) AS intersection, count(*) FILTER (before IS NULL OR before < pos - 1) AS n_intersections FROM m GROUP BY ALL)
SELECT file_id_1, file_id_2, intersection, n_intersections, x.n + y.n - intersection AS union_bases, round(intersection / (x.n + y.n - intersection), 9) AS jaccard
FROM i JOIN n x ON x.file_id = file_id_1 JOIN n y ON y.file_id = file_id_2""",
    "exact_files_jaccard": """WITH v AS (SELECT file_id, chrom, start_pos AS s, end_pos AS e FROM intervals
 WHERE file_id IS NOT NULL AND chrom IS NOT NULL AND start_pos >= 0 AND end_pos > start_pos),
r AS (SELECT *, max(e) OVER (PARTITION BY file_id, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
i AS (SELECT *, sum((reach IS NULL OR s > reach)::INT) OVER (PARTITION BY file_id, chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r),
m AS (SELECT i.file_id, list_side, chrom, min(s) AS s, max(e) AS e FROM i JOIN bed_files b ON b.file_id = i.file_id AND b.file_kind = 'interval' GROUP BY i.file_id, list_side, chrom, island),
n AS (SELECT file_id, sum(e - s)::BIGINT AS n FROM m GROUP BY file_id),
o AS (SELECT a.file_id AS file_id_1, b.file_id AS file_id_2, sum(least(a.e, b.e) - greatest(a.s, b.s))::BIGINT AS intersection, count(*) AS n_intersections
 FROM m a JOIN m b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e WHERE a.list_side = 'list1' AND b.list_side = 'list2' GROUP BY ALL)
SELECT o.*, x.n + y.n - intersection AS union_bases, round(intersection / (x.n + y.n - intersection), 9) AS jaccard
FROM o JOIN n x ON x.file_id = file_id_1 JOIN n y ON y.file_id = file_id_2""",
    "exact_set_jaccard": f"""WITH d AS (SELECT DISTINCT l_suppkey AS file_id, l_partkey FROM lineitem), n AS (SELECT file_id, count(*) AS n FROM d GROUP BY file_id),
i AS (SELECT a.file_id AS file_id_1, b.file_id AS file_id_2, count(*) AS intersection FROM d a JOIN d b USING (l_partkey) WHERE a.file_id % {QUERY_STEP} = 0 GROUP BY ALL)
SELECT i.*, x.n + y.n - intersection AS union_size, round(intersection / (x.n + y.n - intersection), 9) AS jaccard
FROM i JOIN n x ON x.file_id = file_id_1 JOIN n y ON y.file_id = file_id_2""",
    "stream_registers": f"WITH {_FILES}, {_regs('files')} SELECT * FROM regs",
}


def _pair_query(columns: tuple[str, ...], spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pair_metrics(columns, spark, sf_dir)
    return found.select(*(F.round(c, 6).alias(c) if c in ("card_union", "shared") else c for c in found.columns))


QUERIES = {
    "bed_parse_filter": bed_parse_filter,
    "interval_elements": interval_elements,
    "point_elements": point_elements,
    "hybrid_elements": hybrid_elements,
    **{f"sample_{m.replace('-', '_')}": partial(sampled, m) for m in E.SAMPLERS},
    "hll_registers": hll_registers,
    "hll_merge": hll_merge,
    "hll_histogram": hll_histogram,
    "hll_cardinality": hll_cardinality,
    "pair_sparse": pair_sparse,
    **{name: partial(_pair_query, cols) for name, cols in _SHAPE.items()},
    "pair_sequences": pair_sequences,
    "pair_points_xxh64": pair_points_xxh64,
    "pair_hybrid_xxh64": pair_hybrid_xxh64,
    "exact_files_jaccard": exact_files_jaccard,
    "exact_interval_jaccard": exact_interval_jaccard,
    "exact_set_jaccard": exact_set_jaccard,
    "stream_registers": stream_registers,
}
