"""Command line: similarities of all files of one list with all files of another.

``python -m overlapse.cli LIST1 LIST2`` sketches every listed file once and compares every file of
LIST1 with every file of LIST2; ``ingest-ref FASTA NAME`` prepares a reference genome.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse import __version__
from overlapse.functions.hashing import GATE_SEED, SEED
from overlapse.operators import elements as E
from overlapse.operators import pairwise, sequences
from overlapse.operators import registers as R
from overlapse.plans.session import drop_scratch, written
from overlapse.sources import files as S
from overlapse.sources.results import query_table, reference_tag, result_name, result_table, write_result

MODES = {
    "A": "A", "B": "B", "C": "C", "D": "D",
    "interval-string": "A", "interval": "B", "interval-points": "B", "interval-hybrid": "C", "sequence": "D",
}


#: Files whose extracted sequences have a larger share of N are warned of.
MOST_N = 0.5


def mode_name(text: str) -> str:
    found = MODES.get(text.upper() if len(text) == 1 else text.lower())
    if not found:
        raise argparse.ArgumentTypeError(f"unknown mode {text}; one of {', '.join(MODES)}")
    return found


def precision(text: str) -> int:
    try:
        return R.checked_precision(int(text))
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from None


def rate(text: str) -> float:
    try:
        return E.checked_rate(float(text), "a rate")
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="overlapse", description=__doc__)
    p.add_argument("--version", action="version", version=f"overlapse {__version__}")
    p.add_argument("list1", metavar="LIST1", help="text file with one path per line: file1, side A")
    p.add_argument("list2", metavar="LIST2", help="text file with one path per line: file2, side B")
    p.add_argument("--mode", type=mode_name, help="found from the first listed file if not given")
    p.add_argument("--ref", help="reference of both lists: interval files are compared by their sequences")
    p.add_argument("--ref1", help="reference of LIST1")
    p.add_argument("--ref2", help="reference of LIST2")
    p.add_argument("--ref-cache-dir", help="folder of ingested references")
    p.add_argument("-o", "--out", "--outprefix", dest="prefix", default="overlapse")
    p.add_argument("--full-paths", action="store_true", help="label files by path instead of name")
    p.add_argument("-p", "--precision", type=precision, default=18)
    p.add_argument("--subA", type=rate, default=1.0, help="mode C: share of whole intervals")
    p.add_argument("--subB", type=rate, default=1.0, help="modes B and C: share of positions")
    p.add_argument("--expA", type=float, default=0.0, help="mode C: repeat whole intervals 10^expA times")
    p.add_argument("--subB-method", choices=E.SAMPLERS, default=E.SAMPLERS[0])
    p.add_argument("-k", "--kmer_size", dest="k", type=int, default=8)
    p.add_argument("-w", "--window", "--window_size", dest="w", type=int, default=40)
    p.add_argument("--seed", type=int, default=SEED)
    p.add_argument("--gate-seed", type=int, default=GATE_SEED)
    p.add_argument("--separator", default="\t", help="between the fields of a hashed element")
    shape = p.add_mutually_exclusive_group()
    shape.add_argument("--metrics", dest="shape", action="store_const", const="full", help="all metrics")
    shape.add_argument("--re", "--register-equality", dest="shape", action="store_const", const="re", help="register equality only")
    p.add_argument("--format", choices=("csv", "tsv", "query-tsv", "parquet"), default="csv")
    p.add_argument("--verbose", action="store_true")
    p.set_defaults(shape="ie")
    return p


def checked(p: argparse.ArgumentParser, argv: list[str]) -> argparse.Namespace:
    a = p.parse_args(argv)
    if a.ref and (a.ref1 or a.ref2):
        p.error("--ref can't be combined with --ref1 or --ref2")
    a.ref1, a.ref2 = a.ref1 or a.ref, a.ref2 or a.ref
    if bool(a.ref1) != bool(a.ref2):
        p.error("references are needed for both lists: --ref, or --ref1 and --ref2")
    if a.ref1 and a.mode not in (None, "D"):
        p.error(f"references compare sequences, which mode {a.mode} doesn't")
    if a.ref1 and not a.ref_cache_dir:
        a.ref_cache_dir = "."
    elif a.ref_cache_dir and not a.ref1:
        p.error("--ref-cache-dir needs a reference")
    return a


def sketches(spark: SparkSession, listed: DataFrame, a: argparse.Namespace, refs: dict[int, str | None]) -> DataFrame:
    """Dense sketches (side, ord, sketch) of all listed files that have elements."""
    keys = ["side", "ord"]
    if a.mode == "B" and a.subB >= 1.0 and a.separator == "\t":
        return R.point_sketches(S.read_intervals(spark, listed), keys, a.precision, a.seed)
    return R.dense(sketch_registers(spark, listed, a, refs), keys, a.precision)


def sketch_registers(spark: SparkSession, listed: DataFrame, a: argparse.Namespace, refs: dict[int, str | None]) -> DataFrame:
    """Registers (side, ord, idx, rho) of all listed files."""
    keys = ["side", "ord"]
    if a.mode == "D":
        if refs[1]:
            parts = []
            for side, ref in refs.items():
                intervals = S.read_intervals(spark, listed.where(f"side = {side}"))
                genome = S.read_reference(spark, ref, a.ref_cache_dir)
                unknown = sequences.unknown_chromosomes(intervals, genome).limit(5).collect()
                if unknown:
                    raise S.InputError(f"{ref} lacks chromosomes of LIST{side}: {', '.join(r.chrom for r in unknown)}")
                beyond = sequences.extraction_faults(intervals, genome, keys).where("beyond > 0").join(listed, keys).limit(5).collect()
                if beyond:
                    raise S.InputError(f"intervals of LIST{side} reach beyond their chromosomes in {ref}: {', '.join(f'{r.label} ({r.beyond})' for r in beyond)}")
                parts.append(sequences.extract(intervals, genome, keys))
            records = written(parts[0].unionByName(parts[1]), "sequences")
            for r in sequences.share_of_n(records, keys).where(f"n_share > {MOST_N}").join(listed, keys).collect():
                print(f"overlapse: warning: {r.n_share:.0%} of the sequence of {r.label} is N, which makes files look alike", file=sys.stderr)
        else:
            records = S.read_sequences(spark, listed)
        return R.registers_of_hashes(sequences.minimizers(records, keys, a.k, a.w, seed=a.seed), keys, a.precision)
    intervals = S.read_intervals(spark, listed)
    if a.mode == "A":
        return R.registers(E.interval_elements(intervals, keys, sep=a.separator), keys, a.precision, seed=a.seed)
    options = {"sep": a.separator, "seed": a.seed, "gate_seed": a.gate_seed}
    if a.mode == "B":
        return R.registers(E.point_elements(intervals, keys, a.subB, a.subB_method, **options), keys, a.precision, seed=a.seed)
    found = E.hybrid_elements(intervals, keys, a.subA, a.subB, a.expA, a.subB_method, **options)
    return R.registers(found, keys, a.precision, seed=a.seed)


def compared(filled: DataFrame, listed: DataFrame, a: argparse.Namespace) -> DataFrame:
    """Every file of list 1 with every file of list 2; files without elements score 0."""
    filled = written(filled, "sketches")
    blank = listed.select("side", "ord").join(filled.select("side", "ord"), ["side", "ord"], "left_anti")
    every = filled.unionByName(blank.withColumn("sketch", F.lit(b"\x00" * (1 << a.precision))))
    one, two = (every.where(f"side = {s}").select("ord", "sketch") for s in (1, 2))
    pairs = pairwise.dense_pairs(one, two, ["ord"], a.precision, shape=a.shape)
    named = lambda s: listed.where(f"side = {s}").select(F.col("ord").alias(f"ord_{s}"), F.col("label").alias(f"label_{s}"))
    return pairs.join(named(1), "ord_1").join(named(2), "ord_2")


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    """Exit code 0, or 2 for inputs that can't be used."""
    a = checked(parser(), argv)
    say = lambda *x: print("overlapse:", *x, file=sys.stderr)
    try:
        for name, path in (("LIST1", a.list1), ("LIST2", a.list2)):
            S.check_is_list(path, name)
        lists = [S.read_list(a.list1), S.read_list(a.list2)]
        for name, paths in zip(("LIST1", "LIST2"), lists):
            if not paths:
                raise S.InputError(f"{name} names no files")
        a.mode, how = ("D", "references") if a.ref1 else S.mode_of(lists[0], a.mode, a.subA, a.expA)
        if how != "given":
            say(f"mode {a.mode} ({how})")
        if a.mode != "D" or a.ref1:
            for name, paths in zip(("LIST1", "LIST2"), lists):
                S.check_plain_text(paths, name)
        spark = spark or SparkSession.builder.appName("overlapse").getOrCreate()
        listed = S.listing(spark, lists[0], 1, a.full_paths).unionByName(S.listing(spark, lists[1], 2, a.full_paths)).cache()
        for r in S.repeated_labels(listed).collect():
            say(f"LIST{r.side} has {r.n} files labelled {r.label}; --full-paths tells them apart")
        filled = sketches(spark, listed, a, {1: a.ref1, 2: a.ref2})
        prefix = f"{a.prefix}_{reference_tag(a.ref1)}-vs-{reference_tag(a.ref2)}" if a.ref1 else a.prefix
        path = result_name(prefix, a.mode, a.precision, a.shape, a.subA, a.subB, a.expA, a.k, a.w) + f".{a.format.removeprefix('query-')}"
        pairs = compared(filled, listed, a)
        if a.format == "query-tsv":
            table = query_table(pairs, a.shape)
        else:
            table = result_table(pairs, a.mode, a.precision, a.shape, a.subA, a.subB, a.expA, a.k, a.w, (a.ref1 or "NA", a.ref2 or "NA"))
        write_result(table, path, a.format)
        drop_scratch(spark)
    except (S.InputError, OSError) as e:
        say(f"error: {e}")
        return 2
    if a.verbose:
        say(f"wrote {path}")
    return 0


def ingest(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="overlapse ingest-ref")
    p.add_argument("fasta")
    p.add_argument("name")
    p.add_argument("--ref-cache-dir", default=".")
    a = p.parse_args(argv)
    try:
        print(S.ingest_reference(SparkSession.builder.appName("overlapse").getOrCreate(), a.fasta, a.name, a.ref_cache_dir))
    except (S.InputError, OSError) as e:
        print(f"overlapse: error: {e}", file=sys.stderr)
        return 2
    return 0


def main() -> int:
    argv = sys.argv[1:]
    return ingest(argv[1:]) if argv[:1] == ["ingest-ref"] else run(argv)


if __name__ == "__main__":
    sys.exit(main())
