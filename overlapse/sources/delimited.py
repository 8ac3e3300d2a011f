"""Delimited lines under an explicit schema: valid rows on one side, faults with reasons on the other.

Lines are read permissively under a typed schema, and the raw text of those that the reader calls corrupt (by
their number of columns, or a cast that fails) is retained.  Corrupt lines are then reclassified by three
checks, in this order: quoting, number of columns, casts.  What the reader accepts is checked only where it is
lenient: it takes stray and open quotes, missing values, digits of other scripts and any range of numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("chrom", "start", "end", "name", "score", "strand")
BLANKS = " \t\r\n\f\v"
HEADER = r"^(#|@|track|browser)"

# A quoted field, from its start to a tab or the line's end.  Possessive, so that the matcher loops
# instead of recursing however long the field is.
_QUOTED = r'(?:^|(?<=\t))"[^"]*+(?:""[^"]*+)*+"(?=\t|$)'


def trimmed(line: Column) -> Column:
    """The line without white space at its end."""
    return F.rtrim(line, F.lit(BLANKS))


def is_header_or_blank(line: Column) -> Column:
    """Lines that hold no record, judged after ``trimmed``."""
    return (line == "") | line.rlike(HEADER)


def _masked(line: Column) -> Column:
    """The line with each well-formed quoted field replaced by ``q``."""
    return F.when(F.contains(line, F.lit('"')), F.regexp_replace(line, _QUOTED, "q")).otherwise(line)


def _plain_number(text: Column) -> Column:
    return text.rlike(r"\A[+-]?[0-9]+\z")


def parsed(lines: DataFrame, text: str = "line_text", fields: Sequence[str] = FIELDS) -> DataFrame:
    """Adds ``rec`` (the fields, start and end as bigint, and ``_corrupt``, the raw text of a line that the reader
    calls corrupt), ``is_record``, and ``fault``: null for a valid record, a header or a blank line, else
    ``quoting``, ``columns`` or ``values``.

    The fields named ``chrom``, ``start`` and ``end`` must be in ``fields``.  A null line counts as
    blank.  All columns of ``lines`` stay; ``rec``, ``fault`` and ``is_record`` must not be among them.
    """
    taken = {"rec", "fault", "is_record", "_line", "_mask"} & {*lines.columns}
    if taken:
        raise ValueError(f"columns clash with the result's own: {sorted(taken)}")
    schema = lambda number: ", ".join([*(f"`{f}` {number if f in ('start', 'end') else 'string'}" for f in fields), "`_corrupt` string"])
    options = {
        "sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1",
        "emptyValue": "", "nullValue": "\u0000", "lineSep": "\u0001",
    }
    line = trimmed(F.coalesce(F.col(text), F.lit("")))
    start, end = F.col("rec.start"), F.col("rec.end")
    corrupt = F.col("rec._corrupt").isNotNull()
    empty = F.trim(F.coalesce("rec.chrom", F.lit("")), F.lit(BLANKS)) == ""
    out_of_range = start.isNull() | end.isNull() | (start < 0) | (end <= start)
    # Digits of other scripts: looked for in lines that have more bytes than characters.
    as_text = F.from_csv("_line", F.lit(schema("string")), options)
    foreign = (F.octet_length("_line") > F.length("_line")) & ~(_plain_number(as_text["start"]) & _plain_number(as_text["end"]))
    count = F.length("_mask") - F.length(F.replace("_mask", F.lit("\t"), F.lit(""))) + 1
    fault = (
        F.when(~F.col("is_record"), None)
        .when(F.contains("_mask", F.lit('"')), "quoting")
        .when(count != len(fields), "columns")
        .when(corrupt | F.coalesce(empty | out_of_range | foreign, F.lit(True)), "values")
    )
    return (
        lines.withColumn("_line", line)
        .withColumn("is_record", ~is_header_or_blank(F.col("_line")))
        .withColumn("_mask", _masked(F.col("_line")))
        .withColumn("rec", F.from_csv("_line", F.lit(schema("bigint")), options))
        .withColumn("fault", fault)
        .drop("_line", "_mask")
    )


def faults(lines: DataFrame, text: str = "line_text", fields: Sequence[str] = FIELDS) -> DataFrame:
    """The failing lines with their raw text and the reason."""
    return parsed(lines, text, fields).where(F.col("fault").isNotNull()).drop("rec", "is_record")


def records(lines: DataFrame, text: str = "line_text", fields: Sequence[str] = FIELDS) -> DataFrame:
    """The valid record lines, with the parsed fields as columns (start and end as bigint)."""
    ok = parsed(lines, text, fields).where(F.col("is_record") & F.col("fault").isNull())
    return ok.select(*(c for c in lines.columns if c not in (text, *fields)), *(F.col(f"rec.{f}").alias(f) for f in fields))
