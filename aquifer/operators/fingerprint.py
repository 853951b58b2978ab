"""Node fingerprints from covariates and model parameters: the parameters reduced by a PCA on whichever side is smaller.

A matrix of nodes x parameters has the same principal scores whether its parameter products or its node products are
decomposed. Only the products of the smaller side are added up and brought to the driver: with n nodes and d
parameters min(n, d)^2 numbers, which grow with neither the rows behind the parameters nor the longer side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aquifer.session import ship_package, write_down


def _numbered(df: DataFrame, col: str) -> DataFrame:
    """(col, _i): the distinct values of the smaller side, numbered from 0 in ascending order."""
    return df.select(col).distinct().withColumn("_i", F.row_number().over(Window.orderBy(col)) - 1)


def _vectors(long: DataFrame, row: str, numbered: DataFrame, col: str, value: str, width: int) -> DataFrame:
    """One dense vector (`_x`) for each `row`, over the numbered `col`; an entry that is not there is 0."""
    m = long.join(numbered, col).groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("_i", value))).alias("_m"))
    at = F.sequence(F.lit(0), F.lit(width - 1))
    return m.select(row, F.transform(at, lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0))).alias("_x"))


def _products(rows: DataFrame, width: int) -> np.ndarray:
    """The sum over rows of x x^T: a matrix for each task, its lines added up by Spark."""
    def run(batches):
        total = np.zeros((width, width))
        for b in batches:
            if len(b):
                x = np.stack(b["_x"].to_numpy())
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(width), "line": list(total)})

    lines = rows.select("_x").mapInPandas(run, "i int, line array<double>")
    added = lines.groupBy("i").agg(Summarizer.sum(array_to_vector("line")).alias("s"))
    out = np.zeros((width, width))
    for r in added.select("i", vector_to_array("s").alias("s")).collect():
        out[r["i"]] = r["s"]
    return out


def _leading(square: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (not below 0) and their vectors as columns."""
    values, vectors = np.linalg.eigh((square + square.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    return np.maximum(values[order], 0.0), vectors[:, order]


def principal_scores(long: DataFrame, node: str, param: str, value: str, components: int = 15) -> DataFrame:
    """Centred principal scores (node, component, value) of a long table with one value for each (node, param).

    Missing values are 0. There are min(components, n, d) components, in order of variance; the sign makes the score that is
    largest by absolute value positive. No nodes: no rows."""
    ship_package(long.sparkSession)
    t = write_down(long.select(F.col(node).alias("_node"), F.col(param).alias("_param"),
                               F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v")), "weights")
    n, d = t.agg(F.count_distinct("_node"), F.count_distinct("_param")).first()
    k = min(components, n, d)
    names = [F.col("_node").alias(node), "component", "value"]
    spark = long.sparkSession
    if d > n:  # products of nodes: a vector over the nodes for each parameter, centred by itself
        nodes = _numbered(t, "_node")
        x = _vectors(t, "_param", nodes, "_node", "_v", n)
        mean = F.aggregate("_x", F.lit(0.0), lambda a, b: a + b) / F.lit(float(max(n, 1)))
        x = x.withColumn("_mean", mean).select(F.transform("_x", lambda v: v - F.col("_mean")).alias("_x"))
        values, vectors = _leading(_products(x, n), k)
        scores = vectors * np.sqrt(values)
        cells = [(i, j, float(scores[i, j])) for i in range(n) for j in range(k)]
        s = spark.createDataFrame(cells, "_i int, component int, value double").join(nodes, "_i").select("_node", "component", "value")
    else:  # products of parameters: a vector over the parameters for each node, projected by a table of components
        params = _numbered(t, "_param")
        x = _vectors(t, "_node", params, "_param", "_v", d)
        total = t.groupBy("_param").agg(F.sum("_v").alias("_t"))
        sums = {r["_i"]: r["_t"] for r in total.join(params, "_param").collect()}  # one number for each of the fewer side
        mean = np.array([sums[i] for i in range(d)]) / max(n, 1)
        _, vectors = _leading(_products(x, d) - n * np.outer(mean, mean), k)
        cells = [(i, j, float(vectors[i, j])) for i in range(d) for j in range(k)]
        comp = spark.createDataFrame(cells, "_i int, component int, _c double").join(params, "_i")
        shift = spark.createDataFrame([(j, float(mean @ vectors[:, j])) for j in range(k)], "component int, _shift double")
        s = t.join(comp, "_param").groupBy("_node", "component").agg(F.sum(F.col("_v") * F.col("_c")).alias("_dot")) \
            .join(shift, "component").select("_node", "component", (F.col("_dot") - F.col("_shift")).alias("value"))
    sign = s.groupBy("component").agg(F.signum(F.max_by("value", F.struct(F.abs("value"), "value"))).alias("_sign"))
    s = s.join(sign, "component").withColumn("value", F.when(F.col("_sign") < 0, -F.col("value")).otherwise(F.col("value")))
    return s.select(*names)


def node_fingerprints(covariates: DataFrame, params: DataFrame, weights: dict[str, float] | None = None,
                      components: int = 15) -> DataFrame:
    """(node_id, feature, z) from covariate means (node_id, feature, value) and parameters (node_id, param, v).

    Means are stretched by their weights (default 1). All parameters count: as they are with at most `components` nodes, else
    as principal scores. Every feature is standardised over the nodes with the population deviation (no spread: 0)."""
    from aquifer.operators.cluster import zscore_columns

    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (weights or {"": 1.0}).items() for x in kv]),
                                     F.col("feature")), F.lit(1.0))
    env = covariates.select("node_id", F.concat(F.lit("env_"), "feature").alias("feature"), (F.col("value") * weight).alias("value"))
    if params.select("node_id").distinct().limit(components + 1).count() > components:
        s = principal_scores(params, "node_id", "param", "v", components)
        w = s.select("node_id", F.concat(F.lit("pc"), F.col("component").cast("string")).alias("feature"), "value")
    else:
        w = params.select("node_id", F.concat(F.lit("w"), F.col("param").cast("string")).alias("feature"), F.col("v").alias("value"))
    return zscore_columns(env.unionByName(w), "node_id")


def cluster_nodes(prints: DataFrame, cosine: float = 0.7) -> DataFrame:
    """(item, cluster): nodes merged by average linkage while the mean cosine distance of fingerprints is below 1 - cosine.

    A node whose fingerprint lacks a feature has 0 there."""
    from aquifer.operators.sites import merge_groups

    names = _numbered(prints, "feature")
    width = names.count()
    items = _vectors(prints, "node_id", names, "feature", "z", width)
    return merge_groups(items.select(F.col("node_id").cast("long").alias("item"), F.col("_x").alias("v")), 1.0 - cosine)
