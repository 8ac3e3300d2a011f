"""List files, interval files, sequence files and reference genomes as DataFrames."""

from __future__ import annotations

import gzip
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse.plans.session import on_one_machine

BLANKS = " \t\r\n\f\v"
HEADER = r"^(#|@|track|browser)"
# One record: any first token, then two whole numbers; what follows is ignored.
RECORD = r"^\s*(\S+)\s+([+-]?[0-9]+)(\s+[+-]?[0-9]+|[+-][0-9]+)"
#: Bases of one row of a chunked reference.
CHUNK = 1 << 16

# Suffixes by which files are told apart.
SEQUENCE_SUFFIXES = (".fa", ".fasta", ".fna", ".ffn", ".faa", ".frn")
INTERVAL_SUFFIXES = (".bed", ".bb", ".bigbed", ".narrowpeak", ".broadpeak", ".gappedpeak")
# First bytes of formats that aren't plain text.
MAGIC = {
    b"\x1f\x8b": "gzip",
    b"\x28\xb5\x2f\xfd": "zstd",
    b"\xfd7zXZ": "xz",
    b"\xeb\xf2\x89\x87": "BigBed",
    b"\x87\x89\xf2\xeb": "BigBed",
    b"\x26\xfc\x8f\x88": "BigWig",
    b"\x88\x8f\xfc\x26": "BigWig",
    **{b"BZh%d" % level: "bzip2" for level in range(1, 10)},
}
# Assembly names and what else they are called.
ASSEMBLIES = ("hg38", "hg19", "mm10", "mm39", "hs1")
ALIASES = {
    "grch38": "hg38", "gencode38": "hg38", "grch37": "hg19",
    "chm13": "hs1", "t2t": "hs1", "chm13v2": "hs1", "chm13v2.0": "hs1",
}


class InputError(ValueError):
    """An input that can't be used, with what to do about it."""


def read_list(path: str) -> list[str]:
    """The paths a list file names, in order, with repeats; blank lines and ``#`` lines don't count."""
    with open(path) as lines:
        return [p for p in (line.strip() for line in lines) if p and not p.startswith("#")]


def listing(spark: SparkSession, paths: list[str], side: int, full_paths: bool = False) -> DataFrame:
    """(side, ord, path, label): ``ord`` is the key, as a path may be listed twice."""
    rows = [(side, i, p, os.path.normpath(p) if full_paths else os.path.basename(p)) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, "side int, ord int, path string, label string")


def repeated_labels(files: DataFrame) -> DataFrame:
    """Labels that more than one listed file has."""
    return files.groupBy("side", "label").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _first_data_line(path: str) -> str | None:
    opened = gzip.open(path, "rt", errors="replace") if path.lower().endswith(".gz") else open(path, errors="replace")
    with opened as lines:
        for line in lines:
            s = line.strip()
            if s and not s.startswith(("#", "track", "browser")):
                return s
    return None


def content_kind(line: str | None) -> str | None:
    """``sequence``, ``interval`` or None, by the look of a first data line."""
    if not line:
        return None
    if line[0] in ">;":
        return "sequence"
    cells = line.split("\t")
    return "interval" if len(cells) > 2 and cells[1].isdigit() and cells[2].isdigit() else None


def file_kind(path: str) -> str | None:
    """``sequence``, ``interval`` or None: by suffix (beneath ``.gz``), else by content."""
    name = path.lower().removesuffix(".gz")
    suffix = os.path.splitext(name)[1]
    if suffix in SEQUENCE_SUFFIXES:
        return "sequence"
    if suffix in INTERVAL_SUFFIXES:
        return "interval"
    try:
        return content_kind(_first_data_line(path))
    except OSError:
        return None


def check_is_list(path: str, name: str) -> None:
    """Raises if an input file stands where a list of paths should."""
    try:
        with open(path, errors="replace") as lines:
            first = next((s for s in (line.strip() for line in lines) if s and not s.startswith(("#", "track", "browser"))), None)
    except OSError:
        return
    if kind := content_kind(first):
        raise InputError(f"{name} ({path}) holds {kind} data; pass a text file with one path per line instead")


def check_plain_text(paths: list[str], name: str) -> None:
    """Raises if a regular file starts like a compressed or binary one; pipes aren't touched."""
    for path in paths:
        if os.path.isfile(path):
            with open(path, "rb") as f:
                head = f.read(8)
            for magic, what in MAGIC.items():
                if head.startswith(magic):
                    raise InputError(f"{name} names {path}, which is {what}; interval files are read as plain text, so convert it first")


def mode_of(paths: list[str], mode: str | None, interval_rate: float, exponent: float) -> tuple[str, str]:
    """(mode, how it was found): given, or by the first listed file."""
    if mode:
        return mode, "given"
    kind = file_kind(paths[0]) if paths else None
    if kind == "sequence":
        return "D", "sequence input"
    if kind == "interval" and (interval_rate != 1.0 or exponent != 0):
        return "C", "interval input with options of whole intervals"
    return "B", "interval input" if kind == "interval" else "unknown input"


def parse_records(lines: DataFrame, text: str = "value") -> DataFrame:
    """Adds chrom, start and end to the lines that hold a valid record and drops the others.

    Headers, blank lines, lines of fewer than three fields, numbers beyond 64 bits, negative starts
    and ends not beyond the start give no record.  Names are kept as written.
    """
    line = F.rtrim(F.col(text), F.lit(BLANKS))
    found = lines.where((line != "") & ~line.rlike(HEADER) & line.rlike(RECORD))
    number = lambda i: F.trim(F.regexp_extract(line, RECORD, i), F.lit(BLANKS)).try_cast("bigint")
    return (
        found.withColumn("chrom", F.regexp_extract(line, RECORD, 1))
        .withColumn("start", number(2))
        .withColumn("end", number(3))
        .where("start >= 0 and end > start")
    )


def without_prefix(chrom: Column) -> Column:
    """A chromosome name without leading ``chr``; an option, not applied by any reader."""
    return F.regexp_replace(chrom, "^(?i)chr", "")


def located(spark: SparkSession, path: str) -> str:
    """A path as a URI: one without a scheme is taken from the working folder of this process, which only executors
    on the same machine see; on a cluster it is refused."""
    if "://" in path:
        return path
    if not on_one_machine(spark):
        raise InputError(f"{path} is a path of this machine; on a cluster give a URI that all executors can reach")
    return f"file://{os.path.abspath(path)}"


def _opened(spark: SparkSession, files: DataFrame, **options: str) -> tuple[DataFrame, DataFrame]:
    """(value, at) rows of the listed files' text, each distinct path read once, and (side, ord, at)
    of the listing; ``at`` is the file's URI as Spark reports it."""
    paths = [r.path for r in files.select("path").distinct().collect()]
    missing = [p for p in paths if "://" not in p and not os.path.exists(p)]
    if missing:
        raise InputError(f"no such file: {', '.join(sorted(missing))}")
    uris = spark.createDataFrame([(p, located(spark, p)) for p in paths], "path string, at string")
    plain = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    lines = spark.read.options(**options).text([located(spark, p) for p in paths])
    return lines.select("value", F.regexp_replace(plain, "^file:/+", "file:///").alias("at")), files.join(uris, "path").select("side", "ord", "at")


def read_intervals(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(side, ord, chrom, start, end) of all files of a ``listing``; each distinct path is read once."""
    lines, known = _opened(spark, files)
    records = parse_records(lines).select("at", "chrom", "start", "end")
    return records.join(F.broadcast(known), "at").select("side", "ord", "chrom", "start", "end")


def read_sequences(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(side, ord, rec_no, name, seq) of FASTA files, compressed or not.

    A file is split at record starts, not lines, so records may span blocks of it; ``rec_no`` orders
    the records of a file.  Text before the first record is ignored.
    """
    raw, known = _opened(spark, files, lineSep="\n>")
    raw = raw.withColumn("at_row", F.monotonically_increasing_id())
    body = F.regexp_replace("value", "^>", "")
    first = F.regexp_extract(body, r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(body, r"^[^\r\n]*", ""), r"\s+", "")
    rows = raw.select("at", "at_row", F.col("value").startswith(">").alias("opens"), first.alias("name"), seq.alias("seq"))
    # The first piece of a file opens with ">", or is text before the first record.
    firsts = raw.groupBy("at").agg(F.min("at_row").alias("first_row"))
    kept = rows.join(firsts, "at").where("opens or at_row > first_row").withColumnRenamed("at_row", "rec_no")
    return kept.join(F.broadcast(known), "at").select("side", "ord", "rec_no", "name", "seq")


def chunked(sequences: DataFrame, name: str = "name", seq: str = "seq", width: int = CHUNK) -> DataFrame:
    """(chrom, chunk_no, seq): a reference in rows of ``width`` bases; the name ends at the first blank."""
    chunks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(length({seq}) - 1) div {width}")).cast("int"))
    return (
        sequences.select(F.regexp_extract(name, r"^(\S+)", 1).alias("chrom"), F.col(seq).alias("_s"), F.explode(chunks).alias("chunk_no"))
        .select("chrom", "chunk_no", F.substring("_s", F.col("chunk_no") * width + 1, F.lit(width)).alias("seq"))
    )


def resolve_reference(spec: str, folder: str) -> str:
    """Where the chunked table of a reference lies: a local FASTA or table, or an assembly name that
    ``ingest_reference`` has put below ``folder``.  Nothing is downloaded."""
    if not spec:
        raise InputError("no reference was named")
    if os.path.exists(spec):
        return spec
    name = spec.strip().lower()
    name = ALIASES.get(name, name)
    table = os.path.join(folder, f"{name}.parquet")
    if os.path.exists(os.path.join(table, "_SUCCESS")):
        return table
    if name in ASSEMBLIES:
        raise InputError(f"{spec} isn't in {folder}; ingest its FASTA there once with `overlapse ingest-ref`")
    raise InputError(f"unknown reference {spec}; give a FASTA path or one of {', '.join(sorted({*ASSEMBLIES, *ALIASES}))}")


def ingest_reference(spark: SparkSession, fasta: str, name: str, folder: str) -> str:
    """Writes a FASTA file's chunked table below ``folder`` under an assembly's name."""
    files = listing(spark, [fasta], 1)
    target = os.path.join(folder, f"{ALIASES.get(name.lower(), name.lower())}.parquet")
    chunked(read_sequences(spark, files)).write.mode("overwrite").parquet(target)
    return target


def read_reference(spark: SparkSession, spec: str, folder: str) -> DataFrame:
    path = resolve_reference(spec, folder)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return chunked(read_sequences(spark, listing(spark, [path], 1)))
