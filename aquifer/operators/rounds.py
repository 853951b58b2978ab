"""Training rounds of node models over a parameter table: local steps, averaging, phases, personalised tails.

The models are a table (node_id, analyte, param, i, v, g, loss, cells): one row for each number of a node's chain, `i` its place,
`g` the last step's mean gradient, `loss` and `cells` the node's sums in that step. No model is held by the driver. Rows
of the frame are written once as blocks (up to `block_rows` rows of one node as packed numbers), so a node's parameters
ride once with a block and not with each row. A step joins blocks with parameters, sums gradients in the tasks and adds
them up by (node, place); a node's blocks lie in slices, so that a node with a third of all rows is many tasks also
where the join shuffles. Every step's parameters are written down and read back.

Edge cases: rows without a node are left out; a node without labels keeps its parameters; missing features are 0
(and flagged, if the spec has flags); an empty frame gives an empty table; other columns of the frame are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aquifer.functions import sigmoid
from aquifer.operators import fingerprint, network
from aquifer.operators.federate import ChainSpec, _chain_pass
from aquifer.session import write_down
from aquifer.sources.ingest import checkpoint_params

BLOCKS_A_SLICE = 64
KEY = ["node_id", "analyte", "param"]


@dataclass
class Blocks:
    """A frame's rows as blocks, and the slices (node_id, slice) that hold them; both written tables."""

    spec: ChainSpec
    rows: DataFrame
    slices: DataFrame

    def of(self, nodes: DataFrame) -> Blocks:
        """The blocks of some nodes."""
        some = nodes.select("node_id")
        return Blocks(self.spec, self.rows.join(some, "node_id", "left_semi"), self.slices.join(some, "node_id", "left_semi"))


def _number(col: str) -> Column:
    return F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))


def pack_rows(df: DataFrame, spec: ChainSpec, block_rows: int = 2048) -> Blocks:
    """Blocks of a frame, with the class weights of their node (G12: min(neg / max(pos, 1), cap) for each link)."""
    n_x, n_y = len(spec.features), len(spec.targets)
    numbers = [*[_number(c).alias(f"x{j}") for j, c in enumerate(spec.features)], *[_number(c).alias(f"y{k}") for k, c in enumerate(spec.targets)]]
    rows = df.where(F.col(spec.node).isNotNull()).select(F.col(spec.node).cast("long").alias("node_id"), *numbers)
    rows = rows.withColumn("key", F.xxhash64(*rows.columns))
    dealt = rows.repartitionByRange(F.col("node_id"), F.col("key")).sortWithinPartitions("node_id", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, key = (b.column(c).to_numpy() for c in ("node_id", "key"))
            x, y = (np.column_stack([b.column(f"{c}{j}").to_numpy(zero_copy_only=False).astype(float) for j in range(n)]) for c, n in (("x", n_x), ("y", n_y)))
            edges = np.append(np.flatnonzero(np.diff(node, prepend=node[:1] - 1)), len(node))
            cuts = [(i, min(i + block_rows, hi)) for lo, hi in zip(edges, edges[1:]) for i in range(lo, hi, block_rows)]
            yield pa.RecordBatch.from_pylist([{"node_id": int(node[lo]), "x": x[lo:hi].tobytes(), "y": y[lo:hi].tobytes(), "key": key[lo:hi].tobytes(),
                                               "first": int(key[lo])} for lo, hi in cuts], schema)

    schema = pa.schema([("node_id", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("key", pa.binary()), ("first", pa.int64())])
    packed = write_down(dealt.mapInArrow(run, "node_id long, x binary, y binary, key binary, first long"), "blocks")
    weight = [F.least(F.count_if(F.col(f"y{k}") == 0.0) / F.greatest(F.count_if(F.col(f"y{k}") == 1.0), F.lit(1)), F.lit(float(spec.pos_weight_cap))) for k in range(n_y)]
    per_node = rows.groupBy("node_id").agg(F.array(*weight).alias("pos_weight")).join(
        packed.groupBy("node_id").agg(F.ceil(F.count(F.lit(1)) / BLOCKS_A_SLICE).alias("n")), "node_id")
    slices = write_down(per_node.select("node_id", "pos_weight", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slice")), "slices")
    own = slices.where("slice = 0").select("node_id", "n")
    placed = packed.join(own, "node_id").withColumn("slice", F.pmod(F.xxhash64("first"), "n")).drop("n", "first")
    return Blocks(spec, write_down(placed, "blocks"), slices)


def zero_params(blocks: Blocks) -> DataFrame:
    """The parameter table of every node, all 0."""
    spec = blocks.spec
    places = [F.struct(F.lit(t).alias("analyte"), F.lit(j).cast("long").alias("param")) for k, t in enumerate(spec.targets) for j in range(spec.width(k))]
    nodes = blocks.slices.where("slice = 0").select("node_id", F.posexplode(F.array(*places)).alias("i", "_p"))
    zero = F.lit(0.0)
    return write_down(nodes.select("node_id", "_p.analyte", "_p.param", "i", zero.alias("v"), zero.alias("g"), zero.alias("loss"), zero.alias("cells")), "params")


def _model(params: DataFrame) -> DataFrame:
    """(node_id, w): a node's numbers in order of their places; as many as a chain has."""
    return params.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("w"))


def _uniform(keys: np.ndarray, number: int) -> np.ndarray:
    """A row's draw in [0, 1) from its key and the draw's number; a repeated task draws the same."""
    h = keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(number + 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0 ** 53


def gradient_sums(blocks: Blocks, params: DataFrame, epoch: int = 0) -> DataFrame:
    """(node_id, i, s): sums over a node's rows; i = -2: loss, -1: labelled cells, from 0: gradients by place."""
    spec, rate = blocks.spec, blocks.spec.rate(epoch)
    whole = replace(spec, forcing=rate, node="node_id")  # what the tasks get holds no function
    ends = np.cumsum([spec.width(k) for k in range(len(spec.targets))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[int, np.ndarray] = {}
            for r in b.to_pylist():
                n, w = r["node_id"], np.array(r["w"])
                x = np.frombuffer(r["x"]).reshape(-1, len(spec.features))
                y = np.frombuffer(r["y"]).reshape(-1, len(spec.targets))
                pdf = pd.DataFrame(np.hstack([x, y]), columns=[*spec.features, *spec.targets])
                pdf["node_id"] = n
                key = np.frombuffer(r["key"], np.int64)
                draws = np.column_stack([_uniform(key, epoch * 1000 + k) for k in range(len(spec.targets))]) if rate < 1 else None
                got = _chain_pass(pdf, whole, {n: np.split(w, ends[:-1])}, {(n, k): p for k, p in enumerate(r["pos_weight"])}, draws, rate)
                line = np.concatenate([[sum(g[2] for g in got), sum(g[3] for g in got)], *[g[4] for g in got]])
                sums[n] = sums.get(n, 0.0) + line
            yield pa.RecordBatch.from_pylist([{"node_id": n, "s": s.tolist()} for n, s in sums.items()], schema)

    schema = pa.schema([("node_id", pa.int64()), ("s", pa.list_(pa.float64()))])
    sent = _model(params).join(blocks.slices.drop("n"), "node_id")
    parts = blocks.rows.join(sent, ["node_id", "slice"]).mapInArrow(run, "node_id long, s array<double>")
    return parts.select("node_id", F.posexplode("s").alias("i", "s")).groupBy("node_id", (F.col("i") - 2).alias("i")).agg(F.sum("s").alias("s"))


def step(blocks: Blocks, params: DataFrame, epoch: int = 0, lr: float = 0.5, l2: float = 1e-3, clip: float = 1.0) -> DataFrame:
    """M5 over tables: one full-batch step of every node with blocks: mean gradient over its labelled cells (G13), clipped by the
    node's norm (S10), pulled to 0 by `l2` (G14). Nodes without labels or blocks keep their parameters."""
    sums = gradient_sums(blocks, params, epoch)
    by = lambda i: F.max(F.when(F.col("i") == i, F.col("s")))
    own = F.collect_list(F.when(F.col("i") >= 0, F.struct("i", "s")))
    node = sums.groupBy("node_id").agg(by(-2).alias("_loss"), by(-1).alias("_cells"), F.map_from_entries(own).alias("_s"),
                                       F.sqrt(F.sum(F.when(F.col("i") >= 0, F.col("s") * F.col("s")))).alias("_norm")).where("_cells > 0")
    got = params.join(node, "node_id", "left")
    g = F.element_at("_s", F.col("i")) / F.col("_cells")
    scale = F.least(F.lit(1.0), clip / (F.col("_norm") / F.col("_cells") + 1e-6))
    moved = F.col("v") - lr * (g * scale + l2 * F.col("v"))
    keep = lambda new, old: F.coalesce(new, F.col(old)).alias(old)
    return write_down(got.select(*KEY, "i", keep(moved, "v"), keep(g, "g"), keep(F.col("_loss"), "loss"), keep(F.col("_cells"), "cells")), "params")


def train(blocks: Blocks, params: DataFrame, epochs: int, first: int = 0, **options: float) -> DataFrame:
    for e in range(epochs):
        params = step(blocks, params, first + e, **options)
    return params


def with_values(params: DataFrame, values: DataFrame) -> DataFrame:
    """The table with new values (node_id, i, v) where there are some."""
    new = values.select("node_id", "i", F.col("v").alias("_new"))
    got = params.join(new, ["node_id", "i"], "left").withColumn("v", F.coalesce("_new", "v"))
    return write_down(got.select(*params.columns), "params")


def chain_scores(df: DataFrame, params: DataFrame, spec: ChainSpec, use_known: bool = True) -> DataFrame:
    """`df` with p_<target> columns: link after link from the known label (when `use_known`), else the probability, as context.
    Rows of nodes without parameters get nulls."""
    out = df.join(_model(params).select(F.col("node_id").alias("_n"), F.col("w").alias("_w")), F.col(spec.node) == F.col("_n"), "left").drop("_n")
    values = [_number(c) for c in spec.features]
    inputs = [F.coalesce(v, F.lit(0.0)) for v in values] + ([v.isNotNull().cast("double") for v in values] if spec.flags else [])
    at = 0
    for t in spec.targets:
        terms = [*inputs, F.lit(1.0)]
        out = out.withColumn(f"p_{t}", sigmoid(sum((F.col("_w")[at + j] * x for j, x in enumerate(terms)), F.lit(0.0))))
        at += len(terms)
        inputs = [*inputs, F.coalesce(_number(t), F.col(f"p_{t}")) if use_known else F.col(f"p_{t}")]
    return out.drop("_w")


def covariate_means(df: DataFrame, spec: ChainSpec) -> DataFrame:
    """(node_id, feature, value): a node's mean of each feature."""
    means = df.where(F.col(spec.node).isNotNull()).groupBy(F.col(spec.node).cast("long").alias("node_id")).agg(*[F.avg(_number(c)).alias(c) for c in spec.features])
    stack = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in spec.features])
    return means.select("node_id", F.inline(stack)).where("value IS NOT NULL")


def run_rounds(df: DataFrame, spec: ChainSpec, tiers: DataFrame, rounds: int = 35, epochs: int = 10, every: int = 5, warmup: int = 5,
               conflict: float = 0.1, cosine: float = 0.7, save: str | None = None, run_id: str = "run") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(params, log, groups) after so many rounds of local epochs and averaging; `tiers`: (node_id, volume, tier).

    Warm-up: from the second round on, every `every` rounds the nodes of tier 1 and 2 take their average weighted by volume.
    From round `warmup` on, once the nodes' parameters diverge (C7) or the hubs' gradients disagree (C9, mean cosine below
    `conflict`), the phase is for good that of groups: at entry and every `every` rounds nodes are grouped by their fingerprints (C5),
    and each round every group averages (N5). The log has a row for each round: the mean loss of the nodes with labels, divergence,
    gradient similarity, what was averaged and the number of groups; `groups` has (round, node_id, cluster_label) of each
    grouping. With `save`, parameters are kept there every 5 rounds (A6)."""
    spark = df.sparkSession
    nodes = write_down(tiers.select("node_id", "volume", "tier"), "nodes")
    blocks = pack_rows(df, spec)
    params = zero_params(blocks)
    covariates = write_down(covariate_means(df, spec), "covariates")
    grouped, kept, seen, log = False, None, [], []
    name = F.concat_ws(":", "analyte", "param").alias("param")
    for r in range(rounds):
        params = train(blocks, params, epochs, r * epochs)
        loss = params.where("i = 0 AND cells > 0").agg(F.avg(F.col("loss") / F.col("cells"))).first()[0]
        far = network.network_divergence(network.similarity_pairs(params.select("node_id", name, "v")), nodes).first()
        trained = params.where("cells > 0").select("node_id", name, F.col("g").alias("v"))
        alike = network.gradient_conflict(trained, nodes).first()["grad_similarity"]
        grouped = grouped or (r >= warmup and (far["diverged"] or alike < conflict))
        kind, n_groups = "local", 0
        if not grouped and r > 0 and r % every == 0:
            kind = "global"
            new = network.pooled_average(params.select("node_id", "i", "v"), nodes.withColumn("_all", F.lit(0)), "_all", key="i")
            params = with_values(params, new)
        elif grouped:
            kind = "groups"
            if kept is None or r % every == 0:
                prints = fingerprint.node_fingerprints(covariates, params.select("node_id", F.col("i").alias("param"), "v"))
                kept = write_down(fingerprint.cluster_nodes(prints, cosine).select(F.col("item").alias("node_id"), F.col("cluster").cast("long").alias("cluster_label")), "groups")
                seen.append(kept.select(F.lit(r).alias("round"), "node_id", "cluster_label"))
            n_groups = kept.select("cluster_label").distinct().count()
            new = network.clustered_average(params.select("node_id", F.col("i").alias("param"), "v"), nodes.join(kept, "node_id"), "cluster_label")
            params = with_values(params, new.withColumnRenamed("param", "i"))
        if save and (r + 1) % 5 == 0:
            checkpoint_params(params.select(*KEY, "v"), save, run_id, r + 1)
        log.append((r, kind, loss, far["divergence"], bool(far["diverged"]), alike, n_groups))
    groups = spark.createDataFrame([], "round int, node_id long, cluster_label long")
    for s in seen:
        groups = groups.unionByName(s)
    return params, spark.createDataFrame(log, "round int, kind string, loss double, divergence double, diverged boolean, grad_similarity double, n_groups int"), groups


def personalize(df: DataFrame, global_params: DataFrame, global_spec: ChainSpec, targets: list[str], tiers: DataFrame, epochs: int = 15,
                small_steps: int = 5, small_lr: float = 0.01, rate: float = 0.1, min_share: float = 0.003, min_detections: int = 3) -> DataFrame:
    """M6: (node_id, analyte, param, v, tier) of each node's personalised tail over its features and the frozen global chain's context
    (the known label, else the chain's probability). A target counts only at nodes where a share of `min_share` of the rows
    is tested and `min_detections` are positive (G7). Tier 1 trains `epochs` steps; tier 2 takes `small_steps` small ones and then goes
    `rate` of the way (N7); tier 3 keeps its initial tail."""
    context = [f"g_{t}" for t in global_spec.targets]
    rows = chain_scores(df, global_params, global_spec)
    known = [F.coalesce(_number(t), F.col(f"p_{t}")).alias(c) for t, c in zip(global_spec.targets, context)]
    rows = rows.select(F.col(global_spec.node).alias("node_id"), *global_spec.features, *targets, *known)
    allowed = rows.groupBy("node_id").agg(*[((F.count(_number(t)) / F.count(F.lit(1)) >= min_share) & (F.count_if(F.col(t) == 1.0) >= min_detections)).alias(f"_may_{t}") for t in targets])
    masked = rows.join(allowed, "node_id").select("node_id", *global_spec.features, *context, *[F.when(F.col(f"_may_{t}"), F.col(t)).alias(t) for t in targets])
    spec = replace(global_spec, features=[*global_spec.features, *context], targets=targets, node="node_id")
    blocks = pack_rows(masked, spec)
    start = zero_params(blocks)
    of = lambda tier: tiers.where(F.col("tier") == tier).select("node_id")
    first, second, third = (start.join(of(t), "node_id", "left_semi") for t in (1, 2, 3))
    hubs = train(blocks.of(of(1)), first, epochs)
    taken = train(blocks.of(of(2)), second, small_steps, lr=small_lr)
    links = network.interpolate(second, taken, KEY, rate=rate)
    tails = hubs.select(*KEY, "v").unionByName(links.select(*KEY, "v")).unionByName(third.select(*KEY, "v"))
    return tails.join(tiers.select("node_id", "tier"), "node_id")
