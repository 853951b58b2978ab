"""Site clustering end to end: guarded feature transform, a self-organising map, its units merged by average linkage on cosine
distance, size tiers, centroids and the assignment of new rows.

Nothing has a cap. The map's units, their sums and the groups are tables; the map's neighbourhood is smoothed along rows and
then columns of the grid, as far as its kernel reaches; merging keeps a sum of unit vectors for each group, because the mean
cosine between the members of two groups is the product of their sums over the product of their sizes.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aquifer.operators.blocks import pack
from aquifer.operators.cluster import apply_pca, fit_pca, som_grid, weight_features
from aquifer.operators.nearest import BOUND, match, match_blocks
from aquifer.operators.profile import column_variance
from aquifer.operators.stats import sorted_ordinal
from aquifer.session import spread, write_down


# ----------------------------------------------------------------------------- map
def reach(sigma: float, least: float = 1e-12) -> int:
    """Grid steps along an axis up to which a Gaussian kernel is at least `least`."""
    return int(math.floor(sigma * math.sqrt(-2 * math.log(least))))


def _added(vector: str, dim: int, weight: Column | None = None) -> Column:
    """Aggregate: the vectors' sum, component by component."""
    return F.array(*[F.sum(F.col(vector)[i] if weight is None else weight * F.col(vector)[i]) for i in range(dim)])


def smooth(units: DataFrame, grid: int, dim: int, sigma: float) -> DataFrame:
    """(unit, cnt, s) -> the same, each unit's values spread over the grid with a Gaussian kernel, rows and then columns."""
    far = reach(sigma)
    weights = F.array(*[F.lit(math.exp(-o * o / (2 * sigma * sigma))) for o in range(far + 1)])
    out = units
    for step, place in ((grid, F.floor(F.col("unit") / grid)), (1, F.col("unit") % grid)):
        near = out.withColumn("_at", place).withColumn("_o", F.explode(F.sequence(F.lit(-far), F.lit(far))))
        near = near.where((F.col("_at") + F.col("_o") >= 0) & (F.col("_at") + F.col("_o") < grid))
        near = near.withColumn("_w", F.element_at(weights, F.abs("_o") + 1))
        out = near.groupBy((F.col("unit") + step * F.col("_o")).alias("unit")).agg(
            F.sum(F.col("_w") * F.col("cnt")).alias("cnt"), _added("s", dim, F.col("_w")).alias("s"))
    return out


def _rounded(x: Column) -> Column:
    """`F.round(x, 6)`, which takes a decimal number a value, by a division wherever the sixth place is clear: a whole number over
    a million is the double nearest to that decimal."""
    y = x * 1e6
    clear = (F.abs(y) < 1e12) & (F.abs(y - F.floor(y) - 0.5) > 1e-3)
    return F.when(clear, F.rint(y) / 1e6).otherwise(F.round(x, 6))


def start_units(rows: DataFrame, vec: str, n_units: int, dim: int, seed: int) -> DataFrame:
    """(id, v): each unit starts at the first of the rows dealt to it by hash, in hash order; without rows near zero. Hashes are of
    rounded values, so that the last bits of a projection, which depend on the order of its sums, do not matter. One pass finds each
    unit's first hash, another its rows, so that no vector is sorted or shuffled but those."""
    rounded = F.array(*[_rounded(F.get(vec, F.lit(j))) for j in range(dim)])
    dealt = rows.select(F.pmod(F.xxhash64(F.lit(seed), rounded), F.lit(n_units)).alias("id"), F.xxhash64(F.lit(seed + 1), rounded).alias("_h"),
                        F.col(vec).alias("_v"))
    first = write_down(dealt.groupBy(F.col("id").alias("_id")).agg(F.min("_h").alias("_first")))
    dealt = dealt.join(first, (F.col("id") == F.col("_id")) & (F.col("_h") == F.col("_first"))).select("id", "_v").distinct()
    dealt = dealt.groupBy("id").agg(F.min("_v").alias("v"))
    noise = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda j: (
        F.pmod(F.xxhash64(F.lit(seed), F.col("id"), j), F.lit(20001)) - 10000) / 1e6)
    units = rows.sparkSession.range(n_units)
    return units.join(dealt, "id", "left").select("id", F.coalesce("v", noise).alias("v"))


def fit_map(rows: DataFrame, vec: str, grid: int | None = None, epochs: int = 10, sigma: float = 0.3, seed: int = 42,
            bound: int = BOUND, start: DataFrame | None = None, size: tuple[int, int] | None = None,
            stored: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
    """The map's units (id, v) on a grid x grid lattice (default: floor(sqrt(5 sqrt(rows)))) and the mean distance of the
    rows to their unit before each epoch. Batch training: every epoch moves all units at once. `stored`: the rows in blocks
    (`blocks.pack`) and `size`: their number and length, where the caller has them."""
    there = rows.where(F.col(vec).isNotNull()).select(vec)
    if stored is None:
        there = write_down(there)
    n, dim = size or there.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    if not n:
        return rows.sparkSession.createDataFrame([], "id long, v array<double>"), []
    grid = grid or som_grid(n)
    stored = pack(there, vec, n, dim) if stored is None else stored
    code = write_down(start if start is not None else start_units(there, vec, grid * grid, dim, seed))
    seen = []
    for epoch in range(epochs):
        won = match(stored, "x", code, bound=bound, size=(grid * grid, dim), summed=True)
        sums = write_down(won.groupBy(F.col("best").alias("unit")).agg(
            F.sum("cnt").alias("cnt"), F.sum("err").alias("err"), _added("s", dim).alias("s")))
        seen.append(sums.select(F.lit(epoch).alias("epoch"), "err", "cnt"))
        spread_out = smooth(sums.drop("err"), grid, dim, sigma).where(F.col("cnt") > 1e-12)
        moved = spread_out.select(F.col("unit").alias("id"), F.transform("s", lambda x: x / F.col("cnt")).alias("_v"))
        code = write_down(code.join(moved, "id", "left").select("id", F.coalesce("_v", "v").alias("v")))
    if not seen:
        return code, []
    mean = functools.reduce(DataFrame.unionByName, seen).groupBy("epoch").agg((F.sum("err") / F.sum("cnt")).alias("e"))
    by_epoch = {r["epoch"]: r["e"] for r in mean.collect()}  # a row for each epoch
    errors = [by_epoch.get(k) for k in range(epochs)]
    return code, errors


# -------------------------------------------------------------------------- merging
_PAIRS = 100_000_000  # products of two groups that a task of a merging round computes


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def merges(items: DataFrame, threshold: float | None = None, bound: int = BOUND) -> DataFrame:
    """C4: (round, a, b, dist, height): group b joins group a < b at mean cosine distance `dist`; a group is named by its
    smallest item. Rounds merge all pairs that are each other's nearest, which for average linkage gives the same
    groups as always merging the closest pair; they end when no pair is below `threshold` (None: one group is left).
    `items`: (item long, v array<double>); a zero vector has cosine 0 with all."""
    state = write_down(items.select(F.col("item").alias("grp"), F.lit(1).cast("long").alias("n"), _unit(F.col("v")).alias("s"),
                                    F.lit(0.0).alias("h")))
    size = state.agg(F.count(F.lit(1)), F.max(F.size("s"))).first()
    n, dim = size[0], size[1] or 0
    rounds: list[DataFrame] = []
    while True:
        mean = state.withColumn("mean", F.transform("s", lambda x: x / F.col("n")))
        near = match(mean, "mean", mean.select(F.col("grp").alias("id"), F.col("mean").alias("v")), "dot", own="grp", bound=bound,
                     size=(n, dim)).withColumn("dist", 1 - F.col("score"))
        # two groups that are each other's nearest get one key, every other group a key of its own or one that it has alone
        to = F.col("best") if threshold is None else F.when(F.col("dist") < threshold, F.col("best"))
        to = F.coalesce(to, F.col("grp"))
        keyed = near.select(F.least("grp", to).alias("_a"), F.greatest("grp", to).alias("_b"), F.struct("grp", "n", "s", "h", "dist").alias("_g"))
        met = keyed.repartition(1 + n * n // _PAIRS, "_a", "_b").groupBy("_a", "_b").agg(F.sort_array(F.collect_list("_g")).alias("_m"))
        a, b = F.get("_m", F.lit(0)), F.get("_m", F.lit(1))  # one group or two
        after = write_down(met.select(
            a["grp"].alias("grp"), (a["n"] + F.coalesce(b["n"], F.lit(0))).alias("n"),
            F.when(b.isNull(), a["s"]).otherwise(F.zip_with(a["s"], b["s"], lambda x, y: x + y)).alias("s"),
            F.when(b.isNull(), a["h"]).otherwise(F.greatest(a["dist"], a["h"], b["h"])).alias("h"),
            b["grp"].alias("b"), F.when(b.isNotNull(), a["dist"]).alias("dist")))
        pairs = after.where("b IS NOT NULL").select(F.lit(len(rounds)).alias("round"), F.col("grp").alias("a"), "b", "dist",
                                                    F.col("h").alias("height"))
        merged = pairs.count()
        if not merged:
            return functools.reduce(DataFrame.unionByName, rounds, pairs)
        rounds.append(pairs)
        n -= merged
        state = after.select("grp", "n", "s", "h")


def follow(items: DataFrame, merged: DataFrame) -> DataFrame:
    """(item, cluster) of every item after these merges: every group points at the one that it joined, and pointers are
    followed by doubling, so the steps grow with the logarithm of the rounds."""
    at = write_down(merged.select("b", F.col("a").alias("to")))
    while True:
        onward = at.select(F.col("b").alias("to"), F.col("to").alias("_next"))
        step = write_down(at.join(onward, "to", "left").select("b", F.coalesce("_next", "to").alias("to"), "_next"))
        at = step.select("b", "to")
        if step.where("_next IS NOT NULL").isEmpty():
            break
    return items.select("item").join(at.withColumnRenamed("b", "item"), "item", "left").select(
        "item", F.coalesce("to", "item").alias("cluster"))


def merge_groups(items: DataFrame, threshold: float | None = 0.6, n_groups: int | None = None, bound: int = BOUND) -> DataFrame:
    """C4: (item, cluster) by average linkage on cosine distance, cut at `threshold` or, with `n_groups`, where that many groups
    are left (the lowest merges of the whole tree are done; ties in the order of rounds and names). A cluster is named by its
    smallest item; every item is in one, items with a NULL vector each in their own."""
    there = write_down(items.where(F.col("v").isNotNull()).select("item", "v"))
    if n_groups is None:
        done = merges(there, threshold, bound)
    else:
        done = merges(there, None, bound)
        left = max(0, there.count() - n_groups)
        order = done.withColumn("_order", F.struct("height", "round", "a"))
        done = write_down(sorted_ordinal(order, [], "_order", "_rank").where(F.col("_rank") < left).drop("_rank", "_order"))
    alone = items.where(F.col("v").isNull()).select("item", F.col("item").alias("cluster"))
    return follow(there, done).unionByName(alone)


def group_similarity(items: DataFrame, group: str = "grp") -> DataFrame:
    """(a, b, sim), a < b: the mean cosine between the members of two groups, from one sum of unit vectors a group.
    The output is a row for each pair of groups."""
    dim = items.agg(F.max(F.size("v"))).first()[0] or 0
    sums = items.select(group, _unit(F.col("v")).alias("u")).groupBy(group).agg(F.count(F.lit(1)).alias("n"), _added("u", dim).alias("s"))
    mean = sums.select(group, F.posexplode(F.transform("s", lambda x: x / F.col("n"))).alias("at", "x"))
    a, b = (mean.select(F.col(group).alias(k), "at", F.col("x").alias(f"_{k}")) for k in ("a", "b"))
    return a.join(b, "at").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.sum(F.col("_a") * F.col("_b")).alias("sim"))


# ---------------------------------------------------------------------------- tiers
def size_tiers(labels: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(cluster, size, tier): tier 1 from the 0.66 quantile of cluster sizes up, 2 from the 0.33 quantile, else 3."""
    sizes = write_down(labels.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count(F.lit(1)).alias("size")))
    q = sizes.agg(F.percentile("size", F.array(F.lit(0.33), F.lit(0.66)))).first()[0] or [0.0, 0.0]  # a row for each cluster
    tier = F.when(F.col("size") >= q[1], 1).when(F.col("size") >= q[0], 2).otherwise(3)
    return sizes.select(cluster, "size", tier.alias("tier"))


# ------------------------------------------------------------------------ end to end
#: Why rows cannot be clustered.
NO_COLUMNS, STATIC, TOO_FEW = "no numeric columns", "too few varying columns", "too few rows"


@dataclass
class SiteClusters:
    """A fitted site clustering. `reason` is set where the rows could not be clustered: then every row is in
    cluster -1 and tier 3."""

    columns: list[str] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=dict)
    components: np.ndarray | None = None
    mean: np.ndarray | None = None
    units: DataFrame | None = None  # (id, v, cluster_id)
    tiers: DataFrame | None = None  # (cluster_id, size, tier)
    centroids: DataFrame | None = None  # (id, v)
    own: DataFrame | None = None  # the rows that were kept, in blocks, or as they came where there is a reason
    kept: StructType | None = None  # their kept columns
    reason: str | None = None
    bound: int = BOUND

    def reduce(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """Kept columns and the weighted, centred, projected vector; a missing column or value counts as 0."""
        filled = rows.select(*keep, *[(F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double")).alias(f"_f_{c}")
                                      for c in self.columns])
        named = [f"_f_{c}" for c in self.columns]
        weighted = weight_features(filled, named, {f"_f_{c}": w for c, w in self.weights.items()})
        pcs = apply_pca(weighted, named, self.components, self.mean, keep, out_prefix="_pc")
        return pcs.select(*keep, F.array(*[F.col(f"_pc{j}") for j in range(self.components.shape[1])]).alias("vec"))

    def label(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """Training rows: (keep..., neuron, cluster_id, node_tier) by their map unit."""
        if self.reason:
            return rows.select(*keep, F.lit(-1).cast("long").alias("neuron"), F.lit(-1).cast("long").alias("cluster_id"),
                               F.lit(3).alias("node_tier"))
        won = match(self.reduce(rows, keep), "vec", self.units.select("id", "v"), "euclidean", bound=self.bound)
        return self._named(won, keep)

    def label_own(self) -> DataFrame:
        """The training rows as `label` names them, with the columns that `fit_sites` was told to keep, read where they lie in blocks."""
        keep = self.kept.names
        if self.reason:
            return self.label(self.own, keep)
        size = self.units.count(), self.components.shape[1]
        return self._named(match_blocks(self.own, self.units, size, self.bound, self.kept), keep)

    def _named(self, won: DataFrame, keep: list[str]) -> DataFrame:
        groups = self.units.select(F.col("id").alias("neuron"), "cluster_id")
        tiers = self.tiers.select("cluster_id", F.col("tier").alias("node_tier"))
        named = won.withColumnRenamed("best", "neuron").join(groups, "neuron", "left")
        return named.join(tiers, "cluster_id", "left").select(*keep, "neuron", "cluster_id", "node_tier")

    def assign(self, rows: DataFrame, keep: list[str], low: float = 0.4) -> DataFrame:
        """New rows: (keep..., cluster_id, sim, low_confidence) by cosine to the clusters' centroids."""
        if self.reason:
            return rows.select(*keep, F.lit(-1).cast("long").alias("cluster_id"), F.lit(None).cast("double").alias("sim"),
                               F.lit(True).alias("low_confidence"))
        return nearest_centroid(self.reduce(rows, keep), "vec", self.centroids, low, self.bound).select(
            *keep, F.col("assigned").alias("cluster_id"), "sim", "low_confidence")


def nearest_centroid(rows: DataFrame, vec: str, centroids: DataFrame, low: float = 0.4, bound: int = BOUND) -> DataFrame:
    """The rows with `assigned`, the centroid of the highest cosine (a zero vector's is 0; ties: the smaller id; -1 without
    centroids), `sim` and `low_confidence` (below `low` or none). `centroids`: (id long, v array<double>)."""
    out = match(rows, vec, centroids, "cosine", bound=bound)
    return out.select(*rows.columns, F.coalesce("best", F.lit(-1)).alias("assigned"), F.col("score").alias("sim"),
                      (F.col("score").isNull() | (F.col("score") < low)).alias("low_confidence"))


def usable_columns(train: DataFrame, columns: list[str], min_var: float = 1e-8, min_columns: int = 5, min_rows: int = 75,
                   min_spread: float = 1e-6) -> tuple[list[str], str | None]:
    """Columns (zero-filled) whose sample variance exceeds `min_var`, or why the rows cannot be clustered: no numeric
    column, fewer than `min_columns` that vary, fewer than `min_rows` rows, deviations that add up to less than `min_spread`."""
    numeric = {c for c, t in train.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")}
    columns = [c for c in columns if c in numeric]
    if not columns:
        return [], NO_COLUMNS
    filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    got = {r["col"]: r for r in column_variance(filled, columns).collect()}  # a row for each column
    n = max(r["n"] for r in got.values())
    varying = [c for c in columns if (got[c]["variance"] or 0.0) > min_var]
    if len(varying) < min_columns:
        return varying, STATIC
    if n < min_rows:
        return varying, TOO_FEW
    if sum(math.sqrt(got[c]["variance"] * (n - 1) / n) for c in varying) < min_spread:
        return varying, STATIC
    return varying, None


def fit_sites(train: DataFrame, columns: list[str], weights: dict[str, float] | None = None, threshold: float = 0.6,
              grid: int | None = None, epochs: int = 10, seed: int = 42, bound: int = BOUND, keep: list[str] | tuple[str, ...] = (),
              dealt: bool = False) -> SiteClusters:
    """C1 + C2 + C4 + G8 + G10: fit on training rows. Features are zero-filled, filtered by variance, weighted by the root of
    their weight and projected on up to eight principal components; a map with a unit for about every sqrt(rows)/5 rows is
    fitted, its units are merged while their mean cosine distance is below `threshold`, clusters get size tiers and
    centroids in the reduced space. A cluster is named by its smallest unit. `keep`: columns that are stored with the rows, for
    `label_own`. `dealt`: the rows are a stored table in parts that are read as they are; others are written down and dealt first."""
    columns, keep = [c for c in columns if c in train.columns], list(keep)
    if columns and not dealt:
        train = spread(train.select(*dict.fromkeys([*keep, *columns])))  # read some times below
    kept = train.select(*keep).schema
    varying, reason = usable_columns(train, columns)
    if reason:
        return SiteClusters(reason=reason, own=train, kept=kept)
    fitted = SiteClusters(columns=varying, weights=weights or {}, kept=kept, bound=bound)
    filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in varying])
    fitted.components, fitted.mean, _ = fit_pca(weight_features(filled, varying, fitted.weights), varying)
    reduced, dim = write_down(fitted.reduce(train, keep)), fitted.components.shape[1]
    n = reduced.count()
    fitted.own = pack(reduced, "vec", n, dim, keep)
    code, _ = fit_map(reduced, "vec", grid, epochs, seed=seed, bound=bound, size=(n, dim), stored=fitted.own)
    groups = merge_groups(code.select(F.col("id").alias("item"), "v"), threshold, bound=bound)
    fitted.units = write_down(code.join(groups.select(F.col("item").alias("id"), F.col("cluster").alias("cluster_id")), "id"))
    won = match(fitted.own, "x", code, bound=bound, size=(fitted.units.count(), dim), summed=True)
    by_unit = won.groupBy(F.col("best").alias("id")).agg(F.sum("cnt").cast("long").alias("n"), _added("s", dim).alias("s"))
    by_cluster = write_down(by_unit.join(fitted.units.select("id", "cluster_id"), "id").groupBy("cluster_id").agg(
        F.sum("n").alias("size"), _added("s", dim).alias("s")))
    q = by_cluster.agg(F.percentile("size", F.array(F.lit(0.33), F.lit(0.66)))).first()[0]  # a row for each cluster
    tier = F.when(F.col("size") >= q[1], 1).when(F.col("size") >= q[0], 2).otherwise(3)
    fitted.tiers = by_cluster.select("cluster_id", "size", tier.alias("tier"))
    fitted.centroids = by_cluster.select(F.col("cluster_id").alias("id"), F.transform("s", lambda x: x / F.col("size")).alias("v"))
    return fitted
