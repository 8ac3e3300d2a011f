"""Statistics of estimates against truth, and agreement between labellings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def error_statistics(rows: DataFrame, by: Sequence[str], estimate: str, truth: str) -> DataFrame:
    """n, MAE, RMSE, largest error, Frobenius norm of the errors and Pearson correlation per group;
    rows without both values don't count."""
    d = F.col(estimate) - F.col(truth)
    known = rows.where(F.col(estimate).isNotNull() & F.col(truth).isNotNull())
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.max(F.abs(d)).alias("max_error"),
        F.sqrt(F.sum(d * d)).alias("frobenius"),
        pearson(F.col(estimate), F.col(truth)).alias("pearson"),
    )


def pearson(x: Column, y: Column) -> Column:
    """Correlation; null for fewer than two rows or no variance."""
    varied = (F.count(F.lit(1)) > 1) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varied, F.corr(x, y))


#: Slices of about equal numbers of distinct values that running counts go over.
RANK_SLICES = 256


def _sliced(counts: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """``counts``, of one row for each distinct value, with ``_below``: the weight of all smaller values of the group.

    Values are cut at their own quantiles, so skewed ones are spread as well; the running sum goes over each slice
    for itself, and the slices' totals are added.
    """
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, F.array(*(F.lit(i / RANK_SLICES) for i in range(1, RANK_SLICES))), 10 * RANK_SLICES).alias("_cuts"))
    part = counts.join(cuts, list(by)).withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = part.groupBy(*by, "_slice").agg(F.sum(weight).alias("_t"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.withColumn("_before", F.coalesce(F.sum("_t").over(earlier), F.lit(0))).drop("_t")
    within = Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    summed = part.join(first, [*by, "_slice"]).withColumn("_below", F.col("_before") + F.coalesce(F.sum(weight).over(within), F.lit(0)))
    return summed.drop("_slice", "_before")


def average_ranks(rows: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """(by, value, name): the average rank of each distinct value; from counts of distinct values, not rows."""
    keys = list(by) or ["_all"]
    known = rows.where(F.col(value).isNotNull())
    known = known if by else known.select(F.lit(0).alias("_all"), value)
    counts = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return _sliced(counts, keys, value, "_n").select(*by, value, (F.col("_below") + (F.col("_n") + 1) / 2).alias(name))


def spearman(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """n and Spearman correlation with average ranks for ties."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = known.join(average_ranks(known, by, x, "_rx"), [*by, x]).join(average_ranks(known, by, y, "_ry"), [*by, y])
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson(F.col("_rx"), F.col("_ry")).alias("spearman"))


def pair_counts(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[int, int]:
    """Concordant and discordant pairs of n rows each at (x, y); pairs equal in x or y are neither.

    Two places of y are told apart by the highest bit in which they differ: among rows that agree above
    it, in the order of x, the weights of those without the bit are summed up for those with it.
    """
    place = np.unique(y, return_inverse=True)[1].astype(np.int64)
    by_x = np.argsort(x, kind="stable")
    x, place, n = x[by_x], place[by_x], n[by_x].astype(np.int64)
    concordant = discordant = 0
    for bit in range(int(place.max(initial=0)).bit_length()):
        block = place >> (bit + 1)
        order = np.argsort(block, kind="stable")
        own, at, upper = block[order], x[order], (place[order] >> bit & 1).astype(bool)
        below = np.concatenate([[0], np.cumsum(np.where(upper, 0, n[order]))])
        new_block = np.concatenate([[True], own[1:] != own[:-1]])
        new_run = new_block | np.concatenate([[True], at[1:] != at[:-1]])
        bounds = lambda new: (np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(own)), np.cumsum(new) - 1)
        (b_from, b_to, b), (r_from, r_to, r) = bounds(new_block), bounds(new_run)
        weight = np.where(upper, n[order], 0)
        concordant += int((weight * (below[r_from[r]] - below[b_from[b]])).sum())
        discordant += int((weight * (below[b_to[b]] - below[r_to[r]])).sum())
    return concordant, discordant


def _rank_slices(cells: DataFrame, by: Sequence[str], value: str, name: str, slices: int) -> DataFrame:
    """(by, value, name): slices of about equal numbers of rows in the order of the values; a value
    that fills a slice by itself has an odd one to itself."""
    counts = cells.groupBy(*by, value).agg(F.sum("n").alias("_m"))
    whole = cells.groupBy(*by).agg(F.sum("n").alias("_rows"))
    ranked = _sliced(counts, by, value, "_m").join(whole, list(by))
    # Nothing starts in a slice after a value of more than its width, so that one is the slice's last.
    number = 2 * F.floor(F.col("_below") / F.col("_rows") * slices) + (F.col("_m") * slices > F.col("_rows")).cast("int")
    return ranked.select(*by, value, number.cast("long").alias(name))


def kendall(rows: DataFrame, by: Sequence[str], x: str, y: str, digits: int | None = None, slices: int = 256) -> DataFrame:
    """Concordant and discordant pairs, ties apart, and (C - D) / (C + D); of the values as they are, or
    rounded to ``digits``.

    No pair of rows is formed.  The rows are cut into slices of x and of y; pairs in one slice of x,
    pairs in one slice of y but none of x, and pairs in unlike slices of both (from the table of the
    slices' counts) are counted apart, so a task holds one slice, or 4 ``slices``^2 counts.
    """
    keys = list(by) or ["_all"]
    value = (lambda c: F.round(c, digits)) if digits is not None else F.col
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    known = known.select(*by, value(x).alias("x"), value(y).alias("y")) if by else known.select(F.lit(0).alias("_all"), value(x).alias("x"), value(y).alias("y"))
    cells = known.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.join(_rank_slices(cells, keys, "x", "xs", slices), [*keys, "x"]).join(_rank_slices(cells, keys, "y", "ys", slices), [*keys, "y"])
    kinds = dict(cells.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", c long, d long"

    def counted(part: DataFrame, group: Sequence[str], first: str, second: str) -> DataFrame:
        def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            met = pair_counts(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["n"].to_numpy())
            return pd.DataFrame([[*key[: len(keys)], *met]], columns=[*keys, "c", "d"])

        narrow = part.select(*group, F.col(first).alias("a"), F.col(second).alias("b"), "n")
        return narrow.groupBy(*group).applyInPandas(count, schema)

    table = cells.groupBy(*keys, "xs", "ys").agg(F.sum("n").alias("n"))
    # Odd slices hold one value, so no pairs that count.
    parts = counted(cells.where("xs % 2 = 0"), [*keys, "xs"], "x", "y").unionByName(counted(cells.where("ys % 2 = 0"), [*keys, "ys"], "xs", "y"))
    sums = parts.unionByName(counted(table, keys, "xs", "ys")).groupBy(*keys).agg(F.sum("c").alias("concordant"), F.sum("d").alias("discordant"))
    varied = known.groupBy(*keys).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi")).where("_lo < _hi").select(*keys)
    total = F.col("concordant") + F.col("discordant")
    found = sums.join(varied, keys).withColumn("tau", F.when(total > 0, (F.col("concordant") - F.col("discordant")) / total))
    return found.select(*by, "concordant", "discordant", "tau")


def rank_agreement(rows: DataFrame, by: Sequence[str], truth: str, estimate: str) -> DataFrame:
    """(by, comparisons, discordant, tied, tau_a, tau_b, max_inverted_gap, clamped_at_zero): over all pairs of a
    group's rows that have both values.  ``max_inverted_gap`` is the largest difference of the truth between two
    rows that the estimate puts the other way round (0 where there are none), ``clamped_at_zero`` the estimates of 0.
    """
    keys = list(by)
    known = rows.where(F.col(truth).isNotNull() & F.col(estimate).isNotNull()).select(*by, F.col(truth).alias("x"), F.col(estimate).alias("y"))
    pairs = lambda n: F.expr(f"{n} * ({n} - 1) div 2")
    ties = lambda c: known.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum(pairs("n")).alias(f"t{c}"))
    whole = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 0).alias("clamped_at_zero")).withColumn("comparisons", pairs("n"))
    # Of all rows with a larger estimate, the least truth: least of the slices above, and within the slice.
    each = known.groupBy(*keys, "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    cuts = each.groupBy(*keys).agg(F.percentile_approx("y", F.array(*(F.lit(i / RANK_SLICES) for i in range(1, RANK_SLICES))), 10 * RANK_SLICES).alias("_cuts"))
    part = each.join(cuts, keys).withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < F.col("y")))).drop("_cuts")
    above = Window.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    lows = part.groupBy(*keys, "_slice").agg(F.min("lo").alias("_lo")).withColumn("_over", F.min("_lo").over(above)).drop("_lo")
    inside = Window.partitionBy(*keys, "_slice").orderBy(F.desc("y")).rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("hi") - F.least(F.min("lo").over(inside), F.col("_over"))
    worst = part.join(lows, [*keys, "_slice"]).withColumn("gap", gap).groupBy(*keys).agg(F.greatest(F.coalesce(F.max("gap"), F.lit(0.0)), F.lit(0.0)).alias("max_inverted_gap"))
    counted = kendall(known, by, "x", "y").drop("tau")
    full = whole.join(ties("x"), keys).join(ties("y"), keys).join(worst, keys).join(counted, keys, "left")
    full = full.fillna(0, ["concordant", "discordant"]).withColumn("ahead", F.col("concordant") - F.col("discordant"))
    untied = F.sqrt((F.col("comparisons") - F.col("tx")).cast("double") * (F.col("comparisons") - F.col("ty")))
    return full.where("comparisons > 0").select(
        *by,
        "comparisons",
        "discordant",
        (F.col("comparisons") - F.col("concordant") - F.col("discordant")).alias("tied"),
        (F.col("ahead") / F.col("comparisons")).alias("tau_a"),
        F.when(untied > 0, F.col("ahead") / untied).alias("tau_b"),
        "max_inverted_gap",
        "clamped_at_zero",
    )


def run_aggregates(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, n, mean, std, least, most) of repeated runs; the deviation is the population's."""
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most")
    )


def paired_ratios(rows: DataFrame, by: Sequence[str], replicate: Sequence[str], arm: str, numerator: object, denominator: object, value: str) -> DataFrame:
    """(by, n, median, least, most): the ratio of two arms' medians within a replicate, over the replicates that have
    both (and a denominator other than 0)."""
    of = lambda a: F.median(F.when(F.col(arm) == F.lit(a), F.col(value)))
    both = rows.groupBy(*by, *replicate).agg(of(numerator).alias("_a"), of(denominator).alias("_b")).where("_a is not null and _b <> 0")
    ratio = F.col("_a") / F.col("_b")
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median(ratio).alias("median"), F.min(ratio).alias("least"), F.max(ratio).alias("most"))


def binned_errors(rows: DataFrame, estimate: str, truth: str, edges: Sequence[float] = (0.05, 0.2)) -> DataFrame:
    """n, MAE and standard deviation of the errors by stratum of the truth."""
    stratum = F.lit(0)
    for i, edge in enumerate(edges, 1):
        stratum = F.when(F.col(truth) >= edge, i).otherwise(stratum)
    d = F.col(estimate) - F.col(truth)
    known = rows.where(F.col(estimate).isNotNull() & F.col(truth).isNotNull())
    return known.groupBy(stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mae"), F.stddev_pop(d).alias("sd"))


def jackknife(pairs: DataFrame, a: str, b: str, value: Column) -> DataFrame:
    """(n_files, n_pairs, mean, se): the mean of ``value`` over pairs, and its standard error when one
    file at a time is left out.  Each file's pairs are summed once; nothing is paired with all files."""
    rows = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), value.alias("v")).where("v is not null")
    own = (
        rows.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("file"), "v")
        .groupBy("file")
        .agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("c"))
    )
    total = rows.agg(F.sum("v").alias("all_sum"), F.count(F.lit(1)).alias("all_n"))
    # One row of totals.
    left_out = own.join(F.broadcast(total)).where("all_n > c")
    left_out = left_out.withColumn("m", (F.col("all_sum") - F.col("s")) / (F.col("all_n") - F.col("c")))
    return left_out.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.max("all_n").alias("n_pairs"),
        F.max(F.col("all_sum") / F.col("all_n")).alias("mean"),
        F.sqrt((F.count(F.lit(1)) - 1) * F.var_pop("m")).alias("se"),
    )


def floor_fits(rows: DataFrame, by: Sequence[str], truth: str, register_equality: str) -> DataFrame:
    """The floor of register equality over the truth: intercept of the line, constrained fit through
    (1, 1), and mean of the points' own floors."""
    j, r = F.col(truth), F.col(register_equality)
    known = rows.where((j < 1) & r.isNotNull())
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_intercept(r, j).alias("intercept"),
        (F.sum((1 - j) * (r - j)) / F.sum((1 - j) * (1 - j))).alias("constrained"),
        F.avg((r - j) / (1 - j)).alias("pointwise"),
    )


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of rows that have both labels."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def label_agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, ari, nmi): adjusted Rand index (0 where it can't exceed chance) and normalised mutual
    information 2 I / (H_a + H_b) (0 where a labelling has one class) of two labellings."""
    cells = contingency(rows, a, b)
    rows_a, rows_b = cells.groupBy("a").agg(F.sum("n").alias("n")), cells.groupBy("b").agg(F.sum("n").alias("n"))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    plogp = F.sum(F.col("n") * F.ln("n"))
    each = lambda df, tag: df.agg(F.sum("n").alias(f"n{tag}"), pairs.alias(f"p{tag}"), plogp.alias(f"e{tag}"))
    # Three tables of one row each.
    one = each(cells, "x").join(each(rows_a, "a")).join(each(rows_b, "b"))
    n = F.col("nx")
    h = lambda tag: F.ln(n) - F.col(f"e{tag}") / n
    expected = F.col("pa") * F.col("pb") / (n * (n - 1) / 2)
    top = (F.col("pa") + F.col("pb")) / 2
    info = h("a") + h("b") - h("x")
    return one.where("nx > 1").select(
        n.alias("n"),
        F.when(F.abs(top - expected) < 1e-12, 0.0).otherwise((F.col("px") - expected) / (top - expected)).alias("ari"),
        F.when((h("a") < 1e-12) | (h("b") < 1e-12), 0.0).otherwise(2 * info / (h("a") + h("b"))).alias("nmi"),
    )


def stratum_medians(pairs: DataFrame, by: Sequence[str], same: Column, value: str) -> DataFrame:
    """Median of pairs within and across strata, their difference, and whether all of the one lie
    above all of the other."""
    v = F.col(value)
    return pairs.where(v.isNotNull()).groupBy(*by).agg(
        F.count_if(same).alias("n_same"),
        F.count_if(~same).alias("n_different"),
        F.median(F.when(same, v)).alias("median_same"),
        F.median(F.when(~same, v)).alias("median_different"),
        (F.median(F.when(same, v)) - F.median(F.when(~same, v))).alias("delta"),
        (F.min(F.when(same, v)) > F.max(F.when(~same, v))).alias("separated"),
    )


def unordered_pairs(pairs: DataFrame, a: str, b: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """One row per unordered pair without self pairs: rows, lowest and highest value, and whether all its values are
    equal within ``tolerance`` (null where it has none)."""
    kept = pairs.where(F.col(a) != F.col(b))
    return kept.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), (F.max(value) - F.min(value) <= tolerance).alias("agree")
    )


def first_per_pair(pairs: DataFrame, a: str, b: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(a, b, columns): of each unordered pair the row that comes first in ``order`` (nulls first), then by
    ``columns``; by partial aggregation."""
    first = F.min(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), *columns)).alias("_first")
    found = pairs.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(first)
    return found.select("a", "b", *(F.col(f"_first.{c}").alias(c) for c in columns))


def load_factor(sizes: DataFrame, keys: Sequence[str], n: str, precision: int, rate: float = 1.0) -> DataFrame:
    """(keys, load, floor): elements per register and the chance that two unrelated sketches of that
    load hold equal registers, among those filled in either."""
    load = F.col(n) * rate / float(1 << precision)
    # P(register <= k) = exp(-load / 2^k) for Poisson loads; k from 0.
    steps = F.sequence(F.lit(0), F.lit(64 - precision + 1))
    upto = F.transform(steps, lambda k: F.exp(-load / F.pow(F.lit(2.0), k)))
    mass = F.transform(upto, lambda p, i: p - F.when(i > 0, F.get(upto, i - 1)).otherwise(0.0))
    equal = F.aggregate(F.slice(mass, 2, 64 - precision + 1), F.lit(0.0), lambda s, p: s + p * p)
    none = F.get(upto, F.lit(0))
    return sizes.select(*keys, load.alias("load"), F.when(none < 1, equal / (1 - none * none)).otherwise(0.0).alias("floor"))


def power_law(rows: DataFrame, by: Sequence[str], size: str, cost: str) -> DataFrame:
    """Exponent and factor of cost ~ factor * size^exponent."""
    known = rows.where((F.col(size) > 0) & (F.col(cost) > 0))
    return known.groupBy(*by).agg(
        F.regr_slope(F.ln(cost), F.ln(size)).alias("exponent"), F.exp(F.regr_intercept(F.ln(cost), F.ln(size))).alias("factor")
    )


def persistent_crossover(rows: DataFrame, by: Sequence[str], size: str, ours: str, theirs: str) -> DataFrame:
    """The last size at which we become the faster one after having been slower."""
    order = Window.partitionBy(*by).orderBy(size)
    faster = rows.withColumn("_f", F.col(ours) < F.col(theirs)).withColumn("_was", F.lag("_f").over(order))
    return faster.where("_f and _was = false").groupBy(*by).agg(F.max(size).alias("crossover"))


def same_pair_sets(rows: DataFrame, cells: Sequence[str], pair: Sequence[str]) -> DataFrame:
    """(cells, n_pairs, n_shared, complete): whether every cell covers exactly the pairs of the widest one (the first
    in order of ``cells`` at a tie), with the pairs it shares with that."""
    each = rows.select(*cells, *pair).distinct()
    sizes = each.groupBy(*cells).agg(F.count(F.lit(1)).alias("n_pairs"))
    # One row: the widest cell.
    widest = sizes.agg(F.min(F.struct((-F.col("n_pairs")).alias("n"), *cells)).alias("w")).select((-F.col("w.n")).alias("_most"), *(F.col(f"w.{c}").alias(f"_w_{c}") for c in cells))
    same = [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in cells]
    model = each.join(F.broadcast(widest), same).select(*(F.col(c).alias(f"_p_{c}") for c in pair))
    met = each.join(model, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in pair], "left_semi").groupBy(*(F.col(c).alias(f"_c_{c}") for c in cells)).agg(F.count(F.lit(1)).alias("n_shared"))
    full = sizes.join(met, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in cells], "left").join(F.broadcast(widest))
    shared = F.coalesce("n_shared", F.lit(0))
    return full.select(*cells, "n_pairs", shared.alias("n_shared"), ((F.col("n_pairs") == F.col("_most")) & (shared == F.col("_most"))).alias("complete"))


def rescaled_errors(rows: DataFrame, estimate: str, truth: str, edges: Sequence[float] = (0.05, 0.2)) -> DataFrame:
    """(stratum, n, sd, sd_rescaled): spread of the errors by stratum of the truth, and what it is once
    the estimate's floor c, by the constrained fit over all rows, is taken out: sd / (1 - c)."""
    known = rows.where(F.col(estimate).isNotNull() & F.col(truth).isNotNull())
    fit = floor_fits(known, [], truth, estimate).select(F.col("constrained").alias("c"))
    # One row: the floor.
    each = binned_errors(known, estimate, truth, edges).join(F.broadcast(fit))
    return each.select("stratum", "n", "sd", F.when(F.col("c") < 1, F.col("sd") / (1 - F.col("c"))).alias("sd_rescaled"))


def replicate_spread(rows: DataFrame, by: Sequence[str], replicate: str, value: Column) -> DataFrame:
    """(by, n_replicates, mean, least, most): the mean, and its range when one replicate at a time is
    left out, from the replicates' own sums."""
    own = rows.select(*by, F.col(replicate).alias("r"), value.alias("v")).where("v is not null and r is not null")
    sums = own.groupBy(*by, "r").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("c"))
    total = sums.groupBy(*by).agg(F.sum("s").alias("all_sum"), F.sum("c").alias("all_n"), F.count(F.lit(1)).alias("n_replicates"))
    left = sums.join(total, list(by)).where("all_n > c").withColumn("m", (F.col("all_sum") - F.col("s")) / (F.col("all_n") - F.col("c")))
    return left.groupBy(*by, "n_replicates", (F.col("all_sum") / F.col("all_n")).alias("mean")).agg(F.min("m").alias("least"), F.max("m").alias("most"))


def quantile_bins(rows: DataFrame, value: str, bins: int, measure: str) -> DataFrame:
    """(bin, n, least, most, mean): rows parted by exact quantiles of ``value``; equal values share a
    bin.  Quantiles are those of the average ranks, so no window goes over all rows."""
    known = rows.where(F.col(value).isNotNull())
    ranked = average_ranks(known, [], value, "_rank")
    total = known.agg(F.count(F.lit(1)).alias("_total"))
    placed = known.join(ranked, value).join(F.broadcast(total))
    number = F.least(F.lit(bins), F.ceil(F.col("_rank") / F.col("_total") * bins)).cast("int")
    return placed.groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(measure).alias("mean")
    )


def size_residuals(rows: DataFrame, by: Sequence[str], truth: str, register_equality: str, ab: str, ba: str) -> DataFrame:
    """(by, n, residual_size, truth_size, truth_residual): correlations of the floor-corrected residual
    and of the truth with the log of the sets' size ratio, which the two containments give."""
    known = rows.where((F.col(ab) > 0) & (F.col(ba) > 0) & F.col(truth).isNotNull() & F.col(register_equality).isNotNull())
    size = F.abs(F.ln(F.col(ab) / F.col(ba)))
    residual = F.col(register_equality) - F.col(truth) - 0.17 * (1 - F.col(truth))
    flat = known.select(*by, size.alias("s"), residual.alias("e"), F.col(truth).alias("t"))
    return flat.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        pearson(F.col("e"), F.col("s")).alias("residual_size"),
        pearson(F.col("t"), F.col("s")).alias("truth_size"),
        pearson(F.col("t"), F.col("e")).alias("truth_residual"),
    )


def zero_share(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, n, share_zero, share_above_one): how many estimates are exactly 0 or exceed 1."""
    v = F.col(value)
    return rows.where(v.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((v == 0).cast("double")).alias("share_zero"), F.avg((v > 1).cast("double")).alias("share_above_one")
    )


def interpolation(rows: DataFrame, reference_a: DataFrame, reference_b: DataFrame, pair: Sequence[str], by: Sequence[str], value: str) -> DataFrame:
    """(by, n, and mean and quartiles of the absolute distance to A and to B): how far a mode's values
    lie from two others' for the same pairs.  A pair counts where either has it."""
    named = lambda df, n: df.select(*pair, F.col(value).alias(n))
    both = rows.join(named(reference_a, "_a"), list(pair), "left").join(named(reference_b, "_b"), list(pair), "left")
    both = both.where("_a is not null or _b is not null")
    out = [F.count(F.lit(1)).alias("n")]
    for tag in ("a", "b"):
        d = F.abs(F.col(value) - F.col(f"_{tag}"))
        out += [F.avg(d).alias(f"mean_{tag}"), F.percentile(d, F.lit(0.25)).alias(f"q1_{tag}"), F.percentile(d, F.lit(0.75)).alias(f"q3_{tag}")]
    return both.groupBy(*by).agg(*out)
