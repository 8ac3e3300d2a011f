"""Result files whose columns drift: one consistent table, and a report of every change.

A file is the text of one delimited table.  Its rows become path-value maps with the raw text of
every value; types are judged per file and path from those maps, and each file is compared with the
one before it in its feed.  The consistent table then projects typed columns from the maps and
reports the casts that failed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from overlapse.plans.session import written

MISSING = ("", "NA")
BOM = "﻿"
#: Tried in this order; the first that occurs in the header parts its columns.
SEPARATORS = ("\t", ",", ";", "|")

_INTEGER = r"\A[+-]?[0-9]+\z"
_REAL = r"\A[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(\.[0-9]*)?[eE][+-]?[0-9]+)([eE][+-]?[0-9]+)?\z"
_PERCENT = r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)%\z"


def _bare(c: Column) -> Column:
    """Without surrounding blanks, one pair of quotes and blanks inside them."""
    t = F.trim(F.replace(c, F.lit(BOM), F.lit("")), F.lit(" \t\r\f\v "))
    quoted = (F.length(t) >= 2) & F.substring(t, 1, 1).isin('"', "'") & (F.substring(t, 1, 1) == F.substring(t, -1, 1))
    inner = F.when(quoted, t.substr(F.lit(2), F.length(t) - 2)).otherwise(t)
    return F.trim(inner, F.lit(" \t\r\f\v "))


def value_type(v: Column) -> Column:
    """``integer``, ``real``, ``percentage`` or ``text``; null for a missing value."""
    return (
        F.when(v.isNull() | v.isin(*MISSING), None)
        .when(v.rlike(_INTEGER), "integer")
        .when(v.rlike(_REAL), "real")
        .when(v.rlike(_PERCENT), "percentage")
        .otherwise("text")
    )


def quantity(v: Column) -> Column:
    """A canonical text of the quantity a value writes: numbers and percentages by their value,
    all else as it stands; null where missing."""
    number = F.when(value_type(v) == "percentage", F.rtrim(v, F.lit("%")).try_cast("double") / 100).otherwise(v.try_cast("double"))
    return F.when(value_type(v).isNull(), None).when(value_type(v) == "text", v).otherwise(F.format_string("%.7e", number))


def path_values(dumps: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(id, header, row_no, values): the rows of each file as maps from column name to raw text.

    Names keep their case and lose surrounding blanks, quotes and a byte-order mark; of repeated
    names the first column counts, nameless columns are dropped.  Short rows lack their last
    columns, surplus cells are dropped.  A null, empty or header-only body gives its header (if
    any) and no rows: one row with a null ``row_no``.
    """
    lines = F.filter(
        F.split(F.replace(F.replace(F.coalesce(F.col(body_col), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n"),
        lambda x: F.trim(F.replace(x, F.lit(BOM), F.lit(""))) != "",
    )
    head = F.get(F.col("lines"), F.lit(0))
    sep = F.coalesce(*(F.when(F.contains(head, F.lit(s)), F.lit(s)) for s in SEPARATORS), F.lit(SEPARATORS[0]))
    cells = lambda line: F.split(line, F.concat(F.lit("\\Q"), F.col("sep"), F.lit("\\E")), -1)
    read = (
        dumps.select(F.col(id_col).alias("id"), lines.alias("lines"))
        .withColumn("sep", sep)
        .withColumn("header", F.coalesce(F.transform(cells(head), _bare), F.array().cast("array<string>")))
    )
    names = F.array_distinct(F.filter("header", lambda n: n != ""))
    rows = read.select(
        "id", "sep", "header", names.alias("names"), F.posexplode_outer(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("row_no", "line")
    )
    parts = F.transform(cells(F.col("line")), _bare)
    place = lambda n: F.array_position(F.col("header"), n).cast("int") - 1
    values = F.when(
        F.col("row_no").isNotNull(),
        F.map_from_arrays(F.col("names"), F.transform("names", lambda n: F.get(F.col("parts"), place(n)))),
    )
    return rows.withColumn("parts", parts).select("id", F.col("names").alias("header"), "row_no", values.alias("values"))


def type_statistics(rows: DataFrame) -> DataFrame:
    """(id, name, type, n_values): for every file and column name the judged type.

    One type of all values present is the column's; integers among reals are ``real``; any other
    mixture is ``text``.  A column without values has a null type.
    """
    declared = rows.groupBy("id").agg(F.first("header", ignorenulls=True).alias("header")).select("id", F.explode("header").alias("name"))
    seen = (
        rows.where("row_no is not null")
        .select("id", F.explode("values").alias("name", "v"))
        .select("id", "name", value_type(F.col("v")).alias("t"))
        .where("t is not null")
        .groupBy("id", "name")
        .agg(F.sort_array(F.collect_set("t")).alias("ts"), F.count(F.lit(1)).alias("n_values"))
    )
    kind = (
        F.when(F.size("ts") == 1, F.get("ts", F.lit(0)))
        .when(F.col("ts") == F.array(F.lit("integer"), F.lit("real")), "real")
        .when(F.size("ts") > 1, "text")
    )
    return declared.join(seen, ["id", "name"], "left").select(
        "id", "name", kind.alias("type"), F.coalesce("n_values", F.lit(0)).alias("n_values")
    )


def changes(dumps: DataFrame, id_col: str, feed_col: str, time_col: str, body_col: str, pair_cols: Sequence[str]) -> DataFrame:
    """(id, feed, name, kind, was): the changes of each file against the one before it in its feed.

    ``kind`` is ``renamed`` (``was`` is the lost name), ``added``, ``removed`` or ``type_changed``
    (``was`` is the earlier type).  A lost and a new name are one renamed column when, over the rows
    with equal ``pair_cols`` in both files, they hold equal quantities wherever both have one, and
    have at least one; where several fit, names pair off in both directions by most equal rows, then
    fewest distinct choices, then name.  A name lost and regained with all values missing has no
    type, and types are carried over such files.  The first file of a feed has no changes; a file
    whose id repeats counts once.
    """
    files = dumps.dropDuplicates([id_col])
    # Each step is written once, so that no body is parsed twice and plans stay small.
    rows = written(path_values(files, id_col, body_col), "rows")
    stats = written(type_statistics(rows), "types")
    order = Window.partitionBy("feed").orderBy("at", "id")
    chain = (
        files.select(F.col(id_col).alias("id"), F.col(feed_col).alias("feed"), F.col(time_col).alias("at"))
        .where("feed is not null")
        .withColumn("prev", F.lag("id").over(order))
        .withColumn("seq", F.row_number().over(order))
    )
    chain = written(chain, "chain")
    # The type a name had when it was last seen with a value, in this feed.
    known = stats.join(chain.select("id", "feed", "seq"), "id")
    held = known.withColumn("run", F.col("seq") - F.row_number().over(Window.partitionBy("feed", "name").orderBy("seq")))
    carried = Window.partitionBy("feed", "name", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    typed = held.withColumn("was", F.last("type", ignorenulls=True).over(carried))
    retyped = typed.where("type is not null and was is not null and type <> was").select(
        "id", "feed", "name", F.lit("type_changed").alias("kind"), "was"
    )
    pairs = chain.where("prev is not null").select("id", "prev", "feed")
    new = pairs.join(stats.select("id", "name"), "id")
    old = pairs.join(stats.select(F.col("id").alias("prev"), "name"), "prev").select("id", "prev", "feed", "name")
    gained = written(new.join(old.select("id", "name"), ["id", "name"], "left_anti"), "gained")
    lost = written(old.join(new.select("id", "name"), ["id", "name"], "left_anti"), "lost")
    keyed = rows.where("row_no is not null").select("id", F.array(*(F.element_at("values", c) for c in pair_cols)).alias("pair"), "values")
    only = lambda f, names: F.map_filter(f, lambda k, v: F.array_contains(names, k))
    both = (
        gained.groupBy("id", "prev").agg(F.collect_list("name").alias("gained"))
        .join(lost.groupBy("id").agg(F.collect_list("name").alias("lost")), "id")
        .join(keyed.select("id", "pair", F.col("values").alias("now")), "id")
        .join(keyed.select(F.col("id").alias("prev"), "pair", F.col("values").alias("then")), ["prev", "pair"])
        .select("id", only(F.col("now"), F.col("gained")).alias("now"), only(F.col("then"), F.col("lost")).alias("then"))
        .select("id", F.explode("now").alias("name", "v"), "then")
        .select("id", "name", quantity(F.col("v")).alias("v"), F.explode("then").alias("gone", "w"))
        .select("id", "name", "gone", (F.col("v") == quantity(F.col("w"))).alias("same"))
        .where("same is not null")
        .groupBy("id", "name", "gone")
        .agg(F.count_if("same").alias("n_same"), F.count_if(~F.col("same")).alias("n_other"))
        .where("n_same > 0 and n_other = 0")
    )
    by_name = Window.partitionBy("id", "name").orderBy(F.desc("n_same"), "gone")
    by_gone = Window.partitionBy("id", "gone").orderBy(F.desc("n_same"), "name")
    fitting = both.withColumns({"i": F.row_number().over(by_name), "j": F.row_number().over(by_gone)}).where("i = 1 and j = 1")
    matched = written(fitting, "matched")
    renamed = matched.join(pairs, "id").select("id", "feed", "name", F.lit("renamed").alias("kind"), F.col("gone").alias("was"))
    none = F.lit(None).cast("string")
    added = gained.join(matched, ["id", "name"], "left_anti").select("id", "feed", "name", F.lit("added").alias("kind"), none.alias("was"))
    removed = lost.join(matched.select("id", F.col("gone").alias("name")), ["id", "name"], "left_anti").select(
        "id", "feed", "name", F.lit("removed").alias("kind"), none.alias("was")
    )
    return retyped.unionByName(renamed).unionByName(added).unionByName(removed)


def name_classes(found: DataFrame, stats: DataFrame) -> dict[str, tuple[str, list[str]]]:
    """The columns of all files under one name each: {name: (Spark type, names it went by)}.

    Names that a rename links, in any feed, are one column, called by the name most files have (the
    lesser at a tie); its type is the widest judged for any of them.  Only the distinct renames and
    names come to the driver: as many as there are column names.
    """
    parent: dict[str, str] = {}

    def root(n: str) -> str:
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for r in found.where("kind = 'renamed'").select("name", "was").distinct().collect():
        parent[root(r["name"])] = root(r["was"])
    uses = stats.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.collect_set("type").alias("types")).collect()
    classes: dict[str, list] = {}
    for r in uses:
        classes.setdefault(root(r["name"]), []).append((-r["n"], r["name"], set(r["types"])))
    out = {}
    for rows in classes.values():
        rows.sort(key=lambda r: r[:2])
        types = set().union(*(t for _, _, t in rows))
        kind = "string" if "text" in types or not types else "double" if types != {"integer"} else "bigint"
        out[rows[0][1]] = (kind, [name for _, name, _ in rows])
    return dict(sorted(out.items()))


def held_beside(stats: DataFrame, classes: Mapping[str, tuple[str, Sequence[str]]]) -> set[str]:
    """The names that some file holds beside an earlier name of their class."""
    places = [(n, c, i) for c, (_, names) in classes.items() for i, n in enumerate(names) if len(names) > 1]
    if not places:
        return set()
    known = stats.sparkSession.createDataFrame(places, "name string, class string, place int")
    own = stats.select("id", "name").join(F.broadcast(known), "name")
    first = F.min("place").over(Window.partitionBy("id", "class"))
    later = own.withColumn("first", first).where("place > first").select("name").distinct()
    return {r["name"] for r in later.collect()}


def numeric_names(rows: DataFrame) -> set[str]:
    """The names under which some value is a number or a percentage."""
    seen = rows.where("row_no is not null").select(F.explode("values").alias("name", "v"))
    return {r["name"] for r in seen.where(value_type(F.col("v")) != "text").select("name").distinct().collect()}


def distinct_columns(names: Sequence[str], taken: Sequence[str]) -> list[str]:
    """``names`` made distinct whatever their case, from each other and from ``taken``, by a number at
    the end; a name that needs none keeps its own."""
    used, own = {n.lower() for n in taken}, {n.lower() for n in names}
    out = []
    for n in names:
        c, i = n, 2
        while c.lower() in used or (c != n and c.lower() in own):
            c, i = f"{n}_{i}", i + 1
        used.add(c.lower())
        out.append(c)
    return out


def consistent(
    rows: DataFrame, columns: Mapping[str, tuple[str, Sequence[str]]], beside: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """All rows in one table: id, row_no, the typed columns, ``failed_casts`` and ``failed_values``.

    ``columns`` maps a column to its Spark type and the names it went by, of which the first whose
    value is present and casts counts.  Columns in ``beside`` have values only in files that also hold
    one of the names given there.  Numbers written as percentages become fractions.  A value that
    doesn't cast is null; its column stands in ``failed_casts``, and ``failed_values`` has the column,
    the name and the raw text of each.
    """
    beside = beside or {}

    def raw(c: str, n: str) -> Column:
        v = F.element_at("values", n)
        if c in beside:
            v = F.when(F.arrays_overlap(F.col("header"), F.array(*map(F.lit, beside[c]))), v)
        return F.when(~v.isin(*MISSING), v)

    def cast(v: Column, kind: str) -> Column:
        if kind == "string":
            return v
        percent = F.rtrim(v, F.lit("%")).try_cast("double") / 100
        return F.when(v.endswith("%"), percent.cast(kind)).otherwise(v.try_cast(kind))

    out = {c: F.coalesce(*(cast(raw(c, n), kind) for n in names)).alias(c) for c, (kind, names) in columns.items()}
    failed = [
        F.when(raw(c, n).isNotNull() & cast(raw(c, n), kind).isNull(), F.struct(F.lit(c).alias("column"), F.lit(n).alias("name"), raw(c, n).alias("text")))
        for c, (kind, names) in columns.items()
        for n in names
        if kind != "string"
    ]
    none = F.array().cast("array<struct<column:string,name:string,text:string>>")
    values = F.array_compact(F.array(*failed)) if failed else none
    return (
        rows.where("row_no is not null")
        .select("id", "row_no", *out.values(), values.alias("failed_values"))
        .withColumn("failed_casts", F.array_distinct(F.transform("failed_values", lambda f: f["column"])))
    )
