"""Per-node multi-label chain models trained as distributed jobs.

Node models are rows of a small parameter table (nodes x links x inputs, held as numpy on the
driver and broadcast each step). One training step is ONE pass over the data for ALL nodes:
`mapInPandas` computes per-partition gradient sums of the masked, class-weighted logistic chain
keyed by (node, link); Spark sums those partials (map-side combine + shuffle of the small keys);
the driver applies clipping, the Gaussian-prior pull and the update to the small table.
Rounds with averaging between nodes keep the parameters as a table instead (`rounds`).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aquifer.functions import hash_uniform, sigmoid
from aquifer.session import write_down


@dataclass
class ChainSpec:
    features: list[str]
    targets: list[str]
    node: str = "node_id"
    pos_weight_cap: float = 10.0
    forcing: float | Callable[[int], float] = 1.0  # chance that a known label is chain context, or the chance by epoch
    flags: bool = False  # whether each feature's presence (0 or 1) is an input too
    seed: int = 42

    def width(self, k: int) -> int:
        return len(self.features) * (1 + self.flags) + k + 1  # features, their flags, previous links, bias

    def rate(self, epoch: int) -> float:
        return self.forcing(epoch) if callable(self.forcing) else self.forcing


def falling(first: float, last: float, epochs: int) -> Callable[[int], float]:
    """A forcing rate that falls in equal steps from the first to the last of so many epochs, and stays there."""
    return lambda epoch: first + (last - first) * min(1.0, epoch / max(1, epochs - 1))


@dataclass
class ChainModel:
    spec: ChainSpec
    weights: dict[int, list[np.ndarray]] = field(default_factory=dict)  # node -> per-link weights
    history: list[float] = field(default_factory=list)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(int(n), self.spec.targets[k], int(j), float(v))
                for n, ws in self.weights.items() for k, w in enumerate(ws) for j, v in enumerate(w)]
        return spark.createDataFrame(rows, "node_id long, analyte string, param long, v double")


def _sig(z):
    return 1.0 / (1.0 + np.exp(-z))


def _softplus(z):
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def _chain_pass(pdf: pd.DataFrame, spec: ChainSpec, weights: dict, pos_w: dict, rng_u: np.ndarray | None, rate: float | None = None):
    """Gradient/loss sums of one partition for every (node, link); `rate`: the forcing rate, the first epoch's by default."""
    rate = spec.rate(0) if rate is None else rate
    out = []
    raw = pdf[spec.features].to_numpy(dtype=float)
    x_all = np.nan_to_num(raw, nan=0.0)  # missing: masked out (P16)
    if spec.flags:
        x_all = np.hstack([x_all, (~np.isnan(raw)).astype(float)])
    y_all = pdf[spec.targets].to_numpy(dtype=float)
    nodes = pdf[spec.node].to_numpy()
    for n in np.unique(nodes):
        if int(n) not in weights:
            continue
        sel = nodes == n
        x, y = x_all[sel], y_all[sel]
        u = rng_u[sel] if rng_u is not None else None
        ctx = np.zeros((len(x), 0))
        for k, w in enumerate(weights[int(n)]):
            inp = np.hstack([x, ctx, np.ones((len(x), 1))])
            z = inp @ w
            p = _sig(z)
            yk = y[:, k]
            lab = ~np.isnan(yk)
            pw = pos_w.get((int(n), k), 1.0)
            yl = np.where(lab, yk, 0.0)
            cell = pw * yl * _softplus(-z) + (1 - yl) * _softplus(z)
            gz = np.where(lab, (1 - yl) * p - pw * yl * (1 - p), 0.0)
            grad = gz @ inp
            out.append((int(n), k, float(cell[lab].sum()), int(lab.sum()), grad.tolist()))
            use_true = lab if u is None else (lab & (u[:, k] < rate))
            ctx = np.hstack([ctx, np.where(use_true, yl, p)[:, None]])
    return out


def _gradient_sums(df: DataFrame, spec: ChainSpec, weights: dict, pos_w: dict, width: int, step: int = 0) -> list:
    """Gradient sums of every (node, link); with forcing below 1, each row's draws for the step come from a hash of
    the row, so a repeated task draws the same."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast((weights, pos_w))
    cols = [spec.node, *spec.features, *spec.targets]
    rate = spec.rate(step)
    draws = [f"_u{k}" for k in range(len(spec.targets))] if rate < 1 else []
    whole = spec if not callable(spec.forcing) else replace(spec, forcing=rate)  # what the tasks get holds no function

    def run(it, bc=bc):
        w, pw = bc.value
        for pdf in it:
            rows = _chain_pass(pdf, whole, w, pw, pdf[draws].to_numpy(dtype=float) if draws else None, rate)
            if rows:
                yield pd.DataFrame({
                    "node": [r[0] for r in rows], "link": [r[1] for r in rows], "loss": [r[2] for r in rows],
                    "cells": [r[3] for r in rows],
                    "g": [r[4] + [0.0] * (width - len(r[4])) for r in rows]})

    drawn = [hash_uniform(step * 1000 + k, *df.columns).alias(c) for k, c in enumerate(draws)]
    parts = df.select(*cols, *drawn).mapInPandas(run, "node long, link int, loss double, cells long, g array<double>")
    agg = parts.groupBy("node", "link").agg(
        F.sum("loss").alias("loss"), F.sum("cells").alias("cells"),
        F.array(*[F.sum(F.col("g")[i]) for i in range(width)]).alias("g"))
    res = agg.collect()  # bounded: nodes x links rows
    bc.unpersist()
    return res


def class_weights(df: DataFrame, spec: ChainSpec) -> dict:
    """G12 per (node, link): min(neg / max(pos, 1), cap)."""
    aggs = []
    for k, t in enumerate(spec.targets):
        aggs += [F.count_if(F.col(t) == 1.0).alias(f"p{k}"), F.count_if(F.col(t) == 0.0).alias(f"n{k}")]
    rows = df.groupBy(spec.node).agg(*aggs).collect()
    return {(int(r[spec.node]), k): min(r[f"n{k}"] / max(r[f"p{k}"], 1), spec.pos_weight_cap)
            for r in rows for k in range(len(spec.targets))}


def init_model(df: DataFrame, spec: ChainSpec, nodes: list[int] | None = None) -> ChainModel:
    nodes = nodes if nodes is not None else [int(r[0]) for r in df.select(spec.node).distinct().collect()]
    m = ChainModel(spec)
    for n in sorted(nodes):
        m.weights[n] = [np.zeros(spec.width(k)) for k in range(len(spec.targets))]
    return m


def train_steps(df: DataFrame, model: ChainModel, steps: int = 10, lr: float = 0.5, l2: float = 1e-3,
                clip: float = 1.0, nodes: list[int] | None = None) -> ChainModel:
    """M5: full-batch gradient steps of the masked logistic chain for all (or the given) nodes at once.
    The loss is the mean over labelled cells of all links of a node (G13); gradients are clipped by
    their global L2 norm per node (S10) and pulled towards 0 by `l2` (the Gaussian prior, G14). The rows are written once and
    read by every step; the forcing rate is that of the model's epoch, the number of steps it has seen."""
    spec = model.spec
    df = write_down(df)
    width = max(spec.width(k) for k in range(len(spec.targets)))
    pos_w = class_weights(df, spec)
    active = set(model.weights) if nodes is None else set(nodes) & set(model.weights)
    for step in range(steps):
        w_active = {n: w for n, w in model.weights.items() if n in active}
        rows = _gradient_sums(df, spec, w_active, pos_w, width, len(model.history))
        per_node: dict[int, dict] = {}
        for r in rows:
            per_node.setdefault(r["node"], {})[r["link"]] = r
        total_loss, total_cells = 0.0, 0
        for n, links in per_node.items():
            cells = sum(v["cells"] for v in links.values())
            if cells == 0:
                continue  # node without labels is skipped
            grads = [np.asarray(links[k]["g"][: spec.width(k)]) / cells if k in links else np.zeros(spec.width(k))
                     for k in range(len(spec.targets))]
            norm = np.sqrt(sum((g * g).sum() for g in grads))
            scale = min(1.0, clip / (norm + 1e-6))
            for k, g in enumerate(grads):
                model.weights[n][k] = model.weights[n][k] - lr * (g * scale + l2 * model.weights[n][k])
            total_loss += sum(v["loss"] for v in links.values())
            total_cells += cells
        model.history.append(total_loss / total_cells if total_cells else 0.0)
    return model


def score_chain(df: DataFrame, model: ChainModel, keep: list[str], use_known: bool = True) -> DataFrame:
    """Chain predictions as JVM expressions: per node weights are looked up from a broadcast literal map;
    the context of link k is the known label (when `use_known`) else the link's probability."""
    spec = model.spec
    out = df
    ctx_cols: list[Column] = []
    preds = []
    for k, t in enumerate(spec.targets):
        w = F.create_map(*[x for n, ws in model.weights.items()
                           for x in (F.lit(int(n)), F.array(*[F.lit(float(v)) for v in ws[k]]))])
        wk = w[F.col(spec.node)]
        values = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in spec.features]
        flags = [v.isNotNull().cast("double") for v in values] if spec.flags else []
        inputs = [F.coalesce(v, F.lit(0.0)) for v in values] + flags + ctx_cols + [F.lit(1.0)]
        z = sum((wk[i] * c for i, c in enumerate(inputs)), F.lit(0.0))
        p = sigmoid(z)
        out = out.withColumn(f"_p{k}", p)
        preds.append(F.struct(F.lit(t).alias("analyte"), F.col(t).alias("y"), F.col(f"_p{k}").alias("score")))
        ctx_cols.append(F.coalesce(F.col(t), F.col(f"_p{k}")) if use_known else F.col(f"_p{k}"))
    return out.select(*keep, F.inline(F.array(*preds)))


# ---------------------------------------------------------------- M7 / G19
def gaussian_draw(draw: int, j: int) -> float:
    """Standard normal number of draw and weight j: Box-Muller over two uniform numbers from an md5 of the pair,
    so that it needs no generator state and SQL can make the same."""
    h = hashlib.md5(f"{draw}|{j}".encode()).hexdigest()
    u1, u2 = (int(h[:12], 16) + 1) / (2 ** 48 + 1), int(h[12:24], 16) / 2 ** 48
    return math.sqrt(-2 * math.log(u1)) * math.cos(2 * math.pi * u2)


def fit_posteriors(df: DataFrame, features: list[str], targets: list[str], steps: int = 50, prior: float = 1.0) -> DataFrame:
    """M7: (analyte, weight, mu, sigma): a logistic link for each target with a Gaussian prior of that precision, fitted by
    damped diagonal Newton steps, and the diagonal Laplace approximation around the fit: 1 / sigma^2 = prior + sum of
    p (1 - p) x^2. The rows are written once; a step is one pass of numpy sums and one aggregate of the tasks' sums, which gives gradient and curvature of all targets (a few
    numbers for each). A step of 1 / (number of weights) never overshoots, as the curvature's diagonal bounds the whole by
    that factor. Missing inputs are 0, rows without a label do not count; without any, mu is 0 and sigma the prior's."""
    x = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)) for c in features]
    rows = write_down(df.select(*[v.alias(f"x{j}") for j, v in enumerate([*x, F.lit(1.0)])], *[F.col(t).cast("double").alias(f"y{k}") for k, t in enumerate(targets)]))
    d = len(features) + 1
    mu = np.zeros((len(targets), d))

    def sums() -> tuple[np.ndarray, np.ndarray]:
        at, k = mu.copy(), len(targets)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((k, 2, d))
            for batch in batches:
                x, y = (np.column_stack([batch.column(f"{c}{j}").to_numpy(zero_copy_only=False) for j in range(n)]).astype(float)
                        for c, n in (("x", d), ("y", k)))
                p = _sig(x @ at.T)
                there = ~np.isnan(y)
                out[:, 0] += np.where(there, p - y, 0.0).T @ x
                out[:, 1] += np.where(there, p * (1 - p), 0.0).T @ (x * x)
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], ["s"])

        got = rows.mapInArrow(run, "s array<double>").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(2 * k * d)]).first()
        both = np.array([0.0 if v is None else v for v in got]).reshape(k, 2, d)
        return both[:, 0], both[:, 1]

    for _ in range(steps):
        gradient, curvature = sums()
        mu = mu - (gradient + prior * mu) / (prior + curvature) / d
    _, curvature = sums()
    sigma = 1 / np.sqrt(prior + curvature)
    names = [*features, "bias"]
    return df.sparkSession.createDataFrame([(t, w, float(mu[k, j]), float(sigma[k, j])) for k, t in enumerate(targets) for j, w in enumerate(names)],
                                           "analyte string, weight string, mu double, sigma double")


def predictive_moments(df: DataFrame, features: list[str], mu: list[float], sigma: list[float],
                       n_draws: int = 50) -> DataFrame:
    """Predictive mean and sample std of sigmoid(x . w_d) over weight draws
    w_d = mu + sigma * z(d); computed per row with array functions (no shuffle, no Python)."""
    x = [F.col(c).cast("double") for c in features] + [F.lit(1.0)]

    weights = F.array(*[F.array(*[F.lit(mu[j] + sigma[j] * gaussian_draw(d, j)) for j in range(len(x))])
                        for d in range(n_draws)])  # n_draws x weights numbers

    def p_of(w):
        return sigmoid(sum((w[j] * x[j] for j in range(len(x))), F.lit(0.0)))

    ps = F.transform(weights, p_of)
    mean = F.aggregate(ps, F.lit(0.0), lambda s, v: s + v) / n_draws
    out = df.withColumn("_ps", ps).withColumn("pred_mean", mean)
    var = F.aggregate(F.col("_ps"), F.lit(0.0), lambda s, v: s + (v - F.col("pred_mean")) * (v - F.col("pred_mean")))
    return out.withColumn("pred_std", F.sqrt(var / (n_draws - 1))).drop("_ps")
