"""Site clustering parts: feature weighting, centred PCA, linkage on a pair table, node fingerprints and prior matrices.
The map, merging without pairs and the whole clustering are in `sites`."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquifer.session import cut_lineage


# ------------------------------------------------------------------------ T14
def weight_features(df: DataFrame, cols: list[str], weights: dict[str, float]) -> DataFrame:
    """X * sqrt(w) (default weight 1)."""
    return df.select(*[(F.col(c) * math.sqrt(weights.get(c, 1.0))).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


# ------------------------------------------------------------------------ T15
def _merged(parts: list[tuple[int, np.ndarray, np.ndarray]], d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, sums of products of deviations) of parts of the rows together."""
    n, mean, m2 = 0, np.zeros(d), np.zeros((d, d))
    for k, part, own in parts:
        step = part - mean
        m2 += own + np.outer(step, step) * (n * k / (n + k))
        mean = mean + step * (k / (n + k))
        n += k
    return n, mean, m2


def co_moments(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sums of products of deviations of numeric columns (missing values count as 0), in one pass: each task
    hands in one row of sums around its own means."""
    d = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(batch):
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            mean = x.mean(0)
            x = x - mean
            return batch.num_rows, mean, x.T @ x

        n, mean, m2 = _merged([], d)
        for batch in batches:
            if batch.num_rows:
                n, mean, m2 = _merged([(n, mean, m2), part(batch)] if n else [part(batch)], d)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean], pa.list_(pa.float64())), pa.array(
                [m2.ravel()], pa.list_(pa.float64()))], ["n", "mean", "m2"])

    x = df.select(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_{i}") for i, c in enumerate(cols)])
    parts = x.mapInArrow(run, "n long, mean array<double>, m2 array<double>").collect()  # a row for each task
    return _merged([(r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(d, d)) for r in parts], d)


def fit_pca(df: DataFrame, cols: list[str], k: int | None = None):
    """Centred PCA with k = min(8, d, n-1); components sign-fixed (largest |loading| positive).
    Returns (components d x k as numpy, mean vector, explained variance ratio)."""
    n, mean, m2 = co_moments(df, cols)
    d = len(cols)
    k = k or max(1, min(8, d, n - 1))
    if n < 2 or k > d:
        raise ValueError(f"{k} components of {d} columns cannot be fitted on {n} rows")
    comps, s, _ = np.linalg.svd(m2 / (n - 1))
    comps = comps[:, :k]
    signs = np.sign(comps[np.abs(comps).argmax(axis=0), np.arange(comps.shape[1])])
    signs[signs == 0] = 1
    return comps * signs, mean, (s / s.sum())[:k]


def apply_pca(df: DataFrame, cols: list[str], comps: np.ndarray, mean: np.ndarray, keep: list[str],
              out_prefix: str = "pc") -> DataFrame:
    """Project rows with a fitted PCA (missing columns -> 0, centred with the training mean)."""
    exprs = []
    for j in range(comps.shape[1]):
        e = F.lit(0.0)
        for i, c in enumerate(cols):
            e = e + (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - float(mean[i])) * float(comps[i, j])
        exprs.append(e.alias(f"{out_prefix}{j}"))
    return df.select(*keep, *exprs)


# ----------------------------------------------------------------------- W12
def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per value, NULL kept as its own bucket, most frequent first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(col).asc_nulls_last())


# ------------------------------------------------------------------------ C1
def som_grid(n: int) -> int:
    return max(1, int(math.floor(math.sqrt(5 * math.sqrt(n)))))


# ------------------------------------------------------------------------ C4
def agglomerate(pairs: DataFrame, threshold: float, linkage: str = "average",
                n_clusters: int | None = None, items: DataFrame | None = None) -> DataFrame:
    """C4: agglomerative clustering on a pair-distance table (i < j, d) by reciprocal-nearest-neighbour
    merging (exact for reducible linkages: average, complete). Each round merges every reciprocal
    pair below `threshold` (or, with `n_clusters`, the closest pairs while more clusters remain),
    relabels to the smaller id and re-aggregates the pair state (sum_d, cnt) or max(d).
    Lineage is cut with a reliable checkpoint each round. Returns (item, cluster) with cluster = the
    smallest member id; `items` (item) adds those that are in no pair, each a cluster of its own. For cosine distance
    and average linkage `sites.merge_groups` needs no pairs."""
    state = pairs.select(F.col("i").cast("long"), F.col("j").cast("long"),
                         F.col("d").cast("double").alias("sd"), F.lit(1).cast("long").alias("cnt"))
    paired = state.select(F.col("i").alias("item")).union(state.select(F.col("j").alias("item")))
    if items is not None:
        paired = paired.union(items.select(F.col("item").cast("long")))
    labels = paired.distinct().withColumn("cluster", F.col("item"))
    labels, state = cut_lineage(labels), cut_lineage(state)
    while True:  # every round merges a pair or ends
        dist = (F.col("sd") / F.col("cnt")) if linkage == "average" else F.col("sd")
        cur = state.withColumn("dist", dist)
        both = cur.select(F.col("i").alias("a"), F.col("j").alias("b"), "dist").unionByName(
            cur.select(F.col("j").alias("a"), F.col("i").alias("b"), "dist"))
        nn = both.groupBy("a").agg(F.min_by(F.struct("b", "dist"), F.struct("dist", "b")).alias("_n"))
        nn = nn.select("a", F.col("_n.b").alias("b"), F.col("_n.dist").alias("dist"))
        recip = nn.alias("x").join(nn.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))) \
            .where(F.col("x.a") < F.col("x.b")).select(F.col("x.a").alias("a"), F.col("x.b").alias("b"),
                                                       F.col("x.dist").alias("dist"))
        if n_clusters is None:
            merges = recip.where(F.col("dist") < threshold)
        else:
            n_now = labels.select("cluster").distinct().count()
            room = n_now - n_clusters
            if room <= 0:
                break
            merges = recip.orderBy("dist", "a").limit(room)
        merges = cut_lineage(merges)
        if merges.count() == 0:
            break
        remap = merges.select(F.col("b").alias("old"), F.col("a").alias("new"))
        labels = cut_lineage(labels.join(remap, labels.cluster == remap.old, "left")
                             .select("item", F.coalesce("new", "cluster").alias("cluster")))
        s = state.join(remap.withColumnRenamed("old", "i").withColumnRenamed("new", "ni"), "i", "left") \
            .join(remap.withColumnRenamed("old", "j").withColumnRenamed("new", "nj"), "j", "left")
        s = s.select(F.coalesce("ni", "i").alias("i0"), F.coalesce("nj", "j").alias("j0"), "sd", "cnt")
        s = s.where(F.col("i0") != F.col("j0")).select(F.least("i0", "j0").alias("i"), F.greatest("i0", "j0").alias("j"),
                                                       "sd", "cnt")
        agg = F.sum("sd") if linkage == "average" else F.max("sd")
        state = cut_lineage(s.groupBy("i", "j").agg(agg.alias("sd"), F.sum("cnt").alias("cnt")))
    return labels


# ------------------------------------------------------------------------ C5
def zscore_columns(df: DataFrame, key: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """Standardise each feature column across nodes with the population std (0 std -> 0)."""
    st = df.groupBy(feature).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    j = df.join(st, feature)
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return j.select(key, feature, z.alias("z"))


def pair_distances(matrix: DataFrame, key: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """C11: Euclidean distance between the rows of a long matrix for pairs i < j (equi-join on feature)."""
    a = matrix.select(F.col(key).alias("i"), feature, F.col(value).alias("va"))
    b = matrix.select(F.col(key).alias("j"), feature, F.col(value).alias("vb"))
    j = a.join(b, feature).where(F.col("i") < F.col("j"))
    return j.groupBy("i", "j").agg(F.sqrt(F.sum((F.col("va") - F.col("vb")) ** 2)).alias("d"))
