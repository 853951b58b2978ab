"""Distributed exact order statistics.

Rank-type results (prefix sums, mid-ranks, exact quantiles) are computed without gathering a
group's values into one task, by one path at every size:

1. rows are range-partitioned by (group, value), with a row number last so that a long run of ties
   spreads as well, and written to the checkpoint folder with their partition's number; a recomputation
   after an executor loss reads the same partitions;
2. each (partition, group) is prefix-summed by a window -- the ranges are balanced even when one group
   holds a third of all rows;
3. the totals of the (partition, group) pairs become offsets through a window over that small table.

Quantiles sort only the values near their order positions (`bracket_histogram`), equal values as one row with a count
(map-side combine), so long runs of tied values cost one row each. NULL is a group like any other. Everything is sort/shuffle
based and spills to disk.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aquifer.session import cut_lineage, write_down


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys come from the left side."""
    named = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(named, cond, how).drop(*[f"_k_{k}" for k in keys])


def _prefix(df: DataFrame, groups: list[str], order: Column, weights: list[Column], outs: list[str],
            slices: int | None) -> DataFrame:
    """Add `outs`: sums of `weights` over the rows before this one in (`groups`, `order`)."""
    n = slices or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = [f"_w{i}" for i in range(len(weights))]
    base = df.select("*", *[w.alias(c) for w, c in zip(weights, named)],
                     F.monotonically_increasing_id().alias("_tie"))
    ranged = cut_lineage(base.repartitionByRange(n, *groups, order, "_tie").withColumn("_pid", F.spark_partition_id()))
    local = Window.partitionBy("_pid", *groups).orderBy(order, "_tie").rowsBetween(Window.unboundedPreceding,
                                                                                  Window.currentRow)
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ranged.groupBy("_pid", *groups).agg(*[F.sum(c).alias(f"{c}_tot") for c in named])
    offsets = totals.select("_pid", *groups, *[(F.sum(f"{c}_tot").over(before) - F.col(f"{c}_tot")).alias(f"{c}_off")
                                               for c in named])
    # running sum including the current row minus the row itself: a streaming O(n) frame
    summed = ranged.select("*", *[(F.sum(c).over(local) - F.col(c)).alias(f"{c}_lr") for c in named])
    joined = null_safe_join(summed, offsets, ["_pid", *groups])
    return joined.select(*df.columns, *[(F.col(f"{c}_off") + F.col(f"{c}_lr")).alias(o) for c, o in zip(named, outs)])


def global_prefix(df: DataFrame, groups: list[str], order: str, weight: str | list[str] | None = None,
                  out: str | list[str] = "_rank", slices: int | None = None) -> DataFrame:
    """Add `out` = sum of `weight` (1 per row when None) over rows before this one in
    (`groups`, `order`) order -- a 0-based rank for unit weights. Several weights may be summed at
    once (lists of equal length). NULL/NaN `order` rows are dropped."""
    weights = [weight] if weight is None or isinstance(weight, str) else list(weight)
    outs = [out] if isinstance(out, str) else list(out)
    base = df.where(F.col(order).isNotNull() & ~F.isnan(F.col(order)))
    columns = [F.lit(1).cast("long") if w is None else F.col(w) for w in weights]
    return _prefix(base, groups, F.col(order), columns, outs, slices)


def sorted_ordinal(df: DataFrame, groups: list[str], order: str, out: str = "_ord", slices: int | None = None) -> DataFrame:
    """0-based position of each row in (`groups`, `order`) order for any orderable type (strings too);
    NULLs come last."""
    return _prefix(df, groups, F.col(order).asc_nulls_last(), [F.lit(1).cast("long")], [out], slices)


def global_rank(df: DataFrame, groups: list[str], value: str, slices: int | None = None) -> DataFrame:
    """Add `_rank` (0-based, ascending `value`) within each group."""
    return global_prefix(df, groups, value, None, "_rank", slices)


def value_histogram(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Distinct (groups, value, _c) counts (map-side combined), materialised once in the shared
    checkpoint folder so every later pass reads it instead of re-scanning the input."""
    base = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    return cut_lineage(base.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c")))


def value_counts_prefix(df: DataFrame, groups: list[str], value: str, hist: DataFrame | None = None) -> DataFrame:
    """Distinct (groups, value, _c) with `_below` = number of rows with a smaller value in the group."""
    h = hist if hist is not None else value_histogram(df, groups, value)
    return global_prefix(h, groups, value, "_c", "_below")


BRACKETED = 16  # probabilities up to which only the values near each order position are sorted
ACCURACY = 2000  # of the approximate bounds around a position


def bracket_histogram(df: DataFrame, groups: list[str], value: str, probs: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """Counts (groups, _o, _c) that determine the order positions of `probs`: `_o` = (interval, value), in order.

    Approximate quantiles around each position (one pass, small sketches) are the ends of a bracket that the position lies in.
    A second pass counts the rows between the brackets' ends; only rows inside a bracket keep their value, equal ones
    as one row, so about 6 / accuracy of the rows of each probability are sorted later."""
    margin = 3.0 / accuracy
    ends = [e for p in probs for e in (max(0.0, p - margin), min(1.0, p + margin))]
    base = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value))).select(*groups, F.col(value).cast("double").alias("_x"))
    bounds = write_down(base.groupBy(*groups).agg(F.percentile_approx("_x", ends, accuracy).alias("_b")))
    near = null_safe_join(base, bounds, groups)
    low = [F.lit(float("-inf")) if e == 0.0 else F.col("_b")[i] for i, e in enumerate(ends)]
    high = [F.lit(float("inf")) if e == 1.0 else F.col("_b")[i] for i, e in enumerate(ends)]
    at = sum((F.col("_x") > F.col("_b")[i]).cast("int") + (F.col("_x") >= F.col("_b")[i]).cast("int") for i in range(len(ends)))
    inside = functools.reduce(Column.__or__, [(F.col("_x") >= low[2 * k]) & (F.col("_x") <= high[2 * k + 1]) for k in range(len(probs))])
    order = F.struct(at.alias("at"), F.when(inside, F.col("_x")).alias("x"))
    return write_down(near.groupBy(*groups, order.alias("_o")).agg(F.count(F.lit(1)).alias("_c")))


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probs: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """Rows (groups..., p, q): linear-interpolated quantile (numpy default / quantile_cont / percentile). Up to `BRACKETED`
    probabilities are found in brackets, more (a grid of quantiles) in the histogram of all values. A position that no
    bracket holds would show as a missing value; then the histogram decides."""
    if not groups:
        return exact_quantiles(df.select(F.lit(0).alias("_g"), value), ["_g"], value, probs, accuracy).drop("_g")
    if len(probs) <= BRACKETED:
        got = write_down(_interpolated(bracket_histogram(df, groups, value, probs, accuracy), groups, probs))
        if got.where(F.col("q").isNull()).isEmpty():
            return got
    hist = value_histogram(df.select(*groups, F.col(value).cast("double").alias("_x")), groups, "_x")
    return _interpolated(hist.select(*groups, F.struct(F.lit(0).alias("at"), F.col("_x").alias("x")).alias("_o"), "_c"), groups, probs)


def _interpolated(hist: DataFrame, groups: list[str], probs: list[float]) -> DataFrame:
    """(groups..., p, q) from counts (groups, _o = (interval, value or NULL), _c)."""
    vc = _prefix(hist, groups, F.col("_o"), [F.col("_c")], ["_below"], None).select(
        *groups, F.col("_o.x").alias("_x"), "_c", "_below").where(F.col("_x").isNotNull())
    sizes = hist.groupBy(*groups).agg(F.sum("_c").alias("_n"))
    h = (F.col("_n") - 1) * F.col("p")
    plan = (
        sizes.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_h", h)
        .withColumn("_lo", F.floor("_h").cast("long"))
        .withColumn("_hi", F.ceil("_h").cast("long"))
    )
    need = plan.select(*groups, F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("_pos")).distinct()
    # interval stabbing as an equi-join: positions and histogram rows share position buckets of width
    # B = ceil(n / #positions), so each row spans few buckets (a long tie spans at most ~#positions)
    # and each bucket holds ~1 position -- linear in rows + positions, never rows x positions
    n_pos = 2 * len(probs)
    width = sizes.select(*groups, F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(n_pos))).cast("long").alias("_B"))
    v = null_safe_join(vc, width, groups).withColumn("_bk", F.explode(F.sequence(
        F.floor(F.col("_below") / F.col("_B")).cast("long"),
        F.floor((F.col("_below") + F.col("_c") - 1) / F.col("_B")).cast("long"))))
    n = null_safe_join(need, width, groups).select(*[F.col(g).alias(f"_n_{g}") for g in groups], "_pos",
                                        F.floor(F.col("_pos") / F.col("_B")).cast("long").alias("_nbk"))
    cond = [F.col(g).eqNullSafe(F.col(f"_n_{g}")) for g in groups] + [F.col("_bk") == F.col("_nbk"),
            F.col("_pos") >= F.col("_below"), F.col("_pos") < F.col("_below") + F.col("_c")]
    picked = v.join(n, cond).select(*groups, "_pos", "_x")
    # one row per group with its <= 2*len(probs) picked order statistics, read once for lo and hi
    pm = picked.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("_pos", "_x"))).alias("_m"))
    out = null_safe_join(plan, pm, groups, "left")
    xlo, xhi = F.element_at("_m", F.col("_lo")), F.element_at("_m", F.col("_hi"))
    between = xlo + (F.col("_h") - F.col("_lo")) * (xhi - xlo)
    q = F.when(xlo == xhi, xlo).otherwise(between)  # also where both are infinite
    return out.select(*groups, "p", q.alias("q"))


def quantiles_wide(df: DataFrame, groups: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """exact_quantiles pivoted to one column per named probability."""
    names = list(probs)
    q = exact_quantiles(df, groups, value, [probs[n] for n in names])
    exprs = [F.max(F.when(F.col("p") == float(probs[n]), F.col("q"))).alias(n) for n in names]
    return q.groupBy(*groups).agg(*exprs) if groups else q.agg(*exprs)


def to_long(df: DataFrame, cols: list[str], ids: list[str] | None = None, name: str = "col",
            value: str = "x") -> DataFrame:
    """Wide numeric columns -> (ids..., col, x) with x cast to DOUBLE; NULLs kept."""
    ids = ids or []
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(ids, cols, name, value)
