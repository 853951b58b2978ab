"""Node network: size tiers, tier topology, node table, volume-weighted parameter averaging,
similarity of node parameter vectors, divergence checks, round-log analytics.

Nodes are clusters of sites, so node-level tables are bounded by the clustering, not by the
raw data; pairwise node work is expressed as equi-joins (on tier rules, cluster labels or
parameter index), never as cartesian products of data rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aquifer.functions import clamp

# ---------------------------------------------------------------- FIXED VALUES
# Tier topology edges (source tier, target tier, weight); hubs=1, links=2, satellites=3; no self-edges.
TIER_EDGES = [(1, 1, 1.0), (2, 1, 0.8), (1, 2, 1.0), (2, 2, 0.5), (1, 3, 1.0)]
# Outbound weight by source tier inside a cluster (unknown tier -> 0.5).
INTRA_WEIGHTS = {1: 1.0, 2: 0.8, 3: 0.0}
INTRA_DEFAULT = 0.5
# ------------------------------------------------------------ END FIXED VALUES


# ------------------------------------------------------------------- G8 / G9
def size_tiers(sizes: DataFrame, node: str = "node_id", size: str = "volume") -> DataFrame:
    """Tier 1 if size >= q66, 2 if >= q33, else 3 (linear-interpolated quantiles of node sizes).
    The node-size table is one row per node, so its exact percentile is small."""
    q = sizes.agg(F.percentile(F.col(size).cast("double"), 0.33).alias("q33"),
                  F.percentile(F.col(size).cast("double"), 0.66).alias("q66")).first()  # the two cut points
    tier = F.when(F.col(size) >= F.lit(q["q66"]), 1).when(F.col(size) >= F.lit(q["q33"]), 2).otherwise(3)
    return sizes.select(node, size, tier.alias("tier"))


def tier_distribution(tiers: DataFrame) -> DataFrame:
    return tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n_nodes"))


# ------------------------------------------------------------------- N1 / N2
def tier_topology(nodes: DataFrame, node: str = "node_id", tier: str = "tier") -> DataFrame:
    """Directed weighted edges from the tier rules (equi-joins on tier, no self-edges)."""
    spark = nodes.sparkSession
    rules = spark.createDataFrame(TIER_EDGES, "src_tier int, dst_tier int, weight double")
    a = nodes.select(F.col(node).alias("src"), F.col(tier).cast("int").alias("src_tier"))
    b = nodes.select(F.col(node).alias("dst"), F.col(tier).cast("int").alias("dst_tier"))
    e = a.join(F.broadcast(rules), "src_tier").join(b, "dst_tier").where(F.col("src") != F.col("dst"))
    return e.select("src", "dst", "weight")


def intra_cluster_topology(nodes: DataFrame, cluster: str, node: str = "node_id", tier: str = "tier") -> DataFrame:
    """Complete digraph inside each cluster, weight by the source node's tier."""
    wexpr = F.coalesce(*[F.when(F.col("src_tier") == t, F.lit(v)) for t, v in INTRA_WEIGHTS.items()],
                       F.lit(INTRA_DEFAULT))
    a = nodes.select(F.col(cluster).alias("_k"), F.col(node).alias("src"), F.col(tier).alias("src_tier"))
    b = nodes.select(F.col(cluster).alias("_k"), F.col(node).alias("dst"))
    e = a.join(b, "_k").where(F.col("src") != F.col("dst"))
    return e.select(F.col("_k").alias(cluster), "src", "dst", wexpr.alias("weight"))


# ------------------------------------------------------------------------ N3
def node_table(tiers: DataFrame, edges: DataFrame, node: str = "node_id") -> DataFrame:
    """Node id, volume, tier, is_hub and the sorted out-neighbour list."""
    nb = edges.groupBy(F.col("src").alias(node)).agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))
    j = tiers.join(nb, node, "left")
    return j.select(node, "volume", "tier", (F.col("tier") == 1).alias("is_hub"),
                    F.coalesce(F.col("neighbours"), F.array().cast("array<bigint>")).alias("neighbours"))


# ------------------------------------------------------------------- N4 / N5
def volume_weighted_average(params: DataFrame, nodes: DataFrame, edges: DataFrame, node: str = "node_id",
                            key: str = "param", value: str = "v") -> DataFrame:
    """Synchronous averaging over self + out-neighbours with tier != 3, weighted by volume;
    tier-3 nodes keep their parameters; edge weights are not used."""
    nt = nodes.select(node, "tier", "volume")
    self_e = nt.select(F.col(node).alias("src"), F.col(node).alias("dst"))
    contrib = edges.select("src", "dst").unionByName(self_e).distinct()
    src_t = nt.select(F.col(node).alias("src"), F.col("tier").alias("src_tier"))
    dst_t = nt.select(F.col(node).alias("dst"), F.col("tier").alias("dst_tier"), F.col("volume").alias("dst_vol"))
    c = contrib.join(src_t, "src").join(dst_t, "dst").where((F.col("src_tier") != 3) & (F.col("dst_tier") != 3))
    p = params.select(F.col(node).alias("dst"), key, value)
    j = c.join(p, "dst")
    avg = j.groupBy(F.col("src").alias(node), key).agg(
        (F.sum(F.col(value) * F.col("dst_vol")) / F.sum("dst_vol")).alias(value))
    keep = params.join(nt.where(F.col("tier") == 3).select(node), node, "left_semi").select(node, key, value)
    return avg.unionByName(keep)


def pooled_average(params: DataFrame, nodes: DataFrame, group: str, node: str = "node_id", key: str = "param",
                   value: str = "v", slices: int = 64) -> DataFrame:
    """N4/N5 where all nodes of a group with tier != 3 are linked with each other: they share one average, so it is one sum for
    each (group, param), added up before the shuffle, and not one for each pair of nodes. The averages go back to their nodes
    in `slices` of the parameters, so that one large group is several tasks. Tier-3 nodes keep their parameters."""
    sharing = nodes.where(F.col("tier") != 3).select(node, group, "volume")
    sums = params.join(sharing, node).groupBy(group, key).agg(
        (F.sum(F.col(value) * F.col("volume")) / F.sum("volume")).alias(value))
    sums = sums.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int"))
    homes = sharing.select(node, group, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"))
    avg = homes.join(sums, [group, "_slice"]).select(node, key, value)
    keep = params.join(nodes.where(F.col("tier") == 3).select(node), node, "left_semi").select(node, key, value)
    return avg.unionByName(keep)


def clustered_average(params: DataFrame, nodes: DataFrame, cluster: str, node: str = "node_id",
                      max_satellite_share: float = 0.95) -> DataFrame:
    """Per cluster with > 1 node and satellite share <= 0.95 the volume-weighted average of its nodes with tier != 3, all
    clusters in one job; nodes of skipped clusters keep their parameters."""
    stats = nodes.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"), F.avg((F.col("tier") == 3).cast("double")).alias("_s"))
    ok = stats.where((F.col("_n") > 1) & (F.col("_s") <= max_satellite_share)).select(cluster)
    active = nodes.join(ok, cluster, "left_semi")
    upd = pooled_average(params, active, cluster, node)
    rest = params.join(active.select(node), node, "left_anti")
    return upd.unionByName(rest.select(*upd.columns))


def interpolate(old: DataFrame, new: DataFrame, keys: list[str], value: str = "v", rate: float = 0.1) -> DataFrame:
    """Old + rate * (new - old); parameters missing from `new` stay."""
    n = new.select(*keys, F.col(value).alias("_new"))
    j = old.join(n, keys, "left")
    return j.select(*keys, (F.col(value) + rate * (F.coalesce(F.col("_new"), F.col(value)) - F.col(value))).alias(value))


def nonfinite_counts(params: DataFrame, node: str = "node_id", value: str = "v") -> DataFrame:
    """Non-finite parameters per node."""
    bad = F.isnan(value) | (F.abs(F.col(value)) == float("inf"))
    return params.groupBy(node).agg(F.count_if(bad).alias("n_nonfinite"), F.count(F.lit(1)).alias("n_params"))


# ------------------------------------------------------------- C3, C7, C8, C9
def similarity_pairs(params: DataFrame, node: str = "node_id", key: str = "param", value: str = "v",
                     floor: float = 1e-8) -> DataFrame:
    """Cosine similarity of node parameter vectors for pairs a < b (equi-join on parameter index,
    i.e. a distributed A*A^T); similarity 0 when either norm is below `floor`."""
    a = params.select(F.col(node).alias("a"), key, F.col(value).alias("va"))
    b = params.select(F.col(node).alias("b"), key, F.col(value).alias("vb"))
    dots = a.join(b, key).where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    norms = params.groupBy(node).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))
    na = norms.select(F.col(node).alias("a"), F.col("norm").alias("na"))
    nb = norms.select(F.col(node).alias("b"), F.col("norm").alias("nb"))
    j = dots.join(na, "a").join(nb, "b")
    sim = F.when((F.col("na") < floor) | (F.col("nb") < floor), F.lit(0.0)).otherwise(F.col("dot") / (F.col("na") * F.col("nb")))
    return j.select("a", "b", sim.alias("sim"))


def network_divergence(pairs: DataFrame, nodes: DataFrame, node: str = "node_id", threshold: float = 0.05) -> DataFrame:
    """1 - mean similarity over pairs of tier != 3 nodes; diverged when > threshold (false for < 2 nodes)."""
    ok = nodes.where(F.col("tier") != 3).select(node)
    p = pairs.join(ok.withColumnRenamed(node, "a"), "a", "left_semi").join(ok.withColumnRenamed(node, "b"), "b", "left_semi")
    d = p.agg(F.count(F.lit(1)).alias("n_pairs"), (1 - F.avg("sim")).alias("divergence"))
    return d.select("n_pairs", "divergence", F.coalesce(F.col("divergence") > threshold, F.lit(False)).alias("diverged"))


def intra_cluster_similarity(pairs: DataFrame, nodes: DataFrame, cluster: str, node: str = "node_id",
                             threshold: float = 0.8, exclude_satellites: bool = True) -> DataFrame:
    """Per cluster the mean pair similarity (tier 3 optionally excluded); flagged below threshold."""
    n = nodes if not exclude_satellites else nodes.where(F.col("tier") != 3)
    ka = n.select(F.col(node).alias("a"), F.col(cluster).alias("_ka"))
    kb = n.select(F.col(node).alias("b"), F.col(cluster).alias("_kb"))
    j = pairs.join(ka, "a").join(kb, "b").where(F.col("_ka") == F.col("_kb"))
    g = j.groupBy(F.col("_ka").alias(cluster)).agg(F.avg("sim").alias("mean_sim"), F.count(F.lit(1)).alias("n_pairs"))
    return g.withColumn("diverged", F.col("mean_sim") < threshold)


def gradient_conflict(grads: DataFrame, nodes: DataFrame, node: str = "node_id") -> DataFrame:
    """Mean cosine of hub gradient vectors (1.0 when fewer than two hubs have gradients)."""
    hubs = nodes.where(F.col("tier") == 1).select(node)
    g = grads.join(hubs, node, "left_semi")
    s = similarity_pairs(g, node)
    return s.agg(F.coalesce(F.avg("sim"), F.lit(1.0)).alias("grad_similarity"), F.count(F.lit(1)).alias("n_pairs"))


# ------------------------------------------------------------ round-log (FX7)
def momentum(log: DataFrame, node: str = "node_id", base: float = 0.7) -> DataFrame:
    """From each node's last two rounds: drop > 0.05 -> min(b+.15, .95); drop < 0.005 -> max(b-.2, .3)."""
    last2 = log.groupBy(node).agg(F.max_by(F.struct("round", "loss"), "round").alias("_l"),
                                  F.count(F.lit(1)).alias("_n"))
    prev = log.join(last2.select(node, F.col("_l.round").alias("_lr")), node).where(F.col("round") < F.col("_lr")) \
        .groupBy(node).agg(F.max_by("loss", "round").alias("_prev"))
    j = last2.join(prev, node, "left")
    drop = F.col("_prev") - F.col("_l.loss")
    m = (F.when(F.col("_n") < 2, F.lit(base)).when(drop > 0.05, F.least(F.lit(base + 0.15), F.lit(0.95)))
         .when(drop < 0.005, F.greatest(F.lit(base - 0.2), F.lit(0.3))).otherwise(F.lit(base)))
    return j.select(node, F.col("_n").alias("n_rounds"), drop.alias("drop"), m.alias("momentum"))


def membership_stability(log: DataFrame, node: str = "node_id", label: str = "cluster_label") -> DataFrame:
    """For every logged round, the share of nodes shared with the previous logged round that kept
    their label; NULL stability for the first round (prev_round = -1) or when no node is shared."""
    rounds = log.select("round").distinct()
    prev = rounds.withColumn("prev_round", F.lag("round").over(Window.orderBy("round")))  # distinct rounds: small
    cur = log.join(prev, "round")
    old = log.select(F.col("round").alias("prev_round"), node, F.col(label).alias("_prev_label"))
    j = cur.join(old, ["prev_round", node])
    st = j.groupBy("round").agg(
        F.avg((F.col(label) == F.col("_prev_label")).cast("double")).alias("stability"),
        F.count(F.lit(1)).alias("n_common"))
    out = prev.join(st, "round", "left")
    return out.select("round", F.coalesce(F.col("prev_round"), F.lit(-1)).alias("prev_round"), "stability",
                      F.coalesce(F.col("n_common"), F.lit(0)).alias("n_common"))


def round_trend(log: DataFrame, node: str = "node_id", label: str = "cluster_label") -> DataFrame:
    """Per round the number of clusters, mean cluster size and mean loss."""
    sizes = log.groupBy("round", label).agg(F.count(F.lit(1)).alias("_size"))
    per = sizes.groupBy("round").agg(F.count(F.lit(1)).alias("n_clusters"), F.avg("_size").alias("mean_size"))
    loss = log.groupBy("round").agg(F.avg("loss").alias("mean_loss"))
    return per.join(loss, "round")


def first_final_delta(log: DataFrame, node: str = "node_id") -> DataFrame:
    """Per node first and final loss and the change."""
    g = log.groupBy(node).agg(F.min_by("loss", "round").alias("first_loss"), F.max_by("loss", "round").alias("final_loss"))
    return g.withColumn("delta", F.col("final_loss") - F.col("first_loss"))


def nearest_hub(nodes: DataFrame, edges: DataFrame, node: str = "node_id") -> DataFrame:
    """First out-neighbour that is a hub (by neighbour id), else the first out-neighbour."""
    t = nodes.select(F.col(node).alias("dst"), (F.col("tier") == 1).alias("_hub"))
    e = edges.join(t, "dst")
    best = e.groupBy(F.col("src").alias(node)).agg(
        F.min_by("dst", F.struct((~F.col("_hub")).alias("h"), F.col("dst").alias("d"))).alias("nearest"))
    return best


def label_runs(log: DataFrame, by: str, order: str, label: str) -> DataFrame:
    """Contiguous runs of equal label in `order` within each `by` (gaps-and-islands)."""
    w = Window.partitionBy(by).orderBy(order)
    chg = (F.lag(label).over(w).isNull() | (F.lag(label).over(w) != F.col(label))).cast("int")
    x = log.withColumn("_chg", chg).withColumn("_run", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding,
                                                                                      Window.currentRow)))
    return x.groupBy(by, "_run", label).agg(F.min(order).alias("start"), F.max(order).alias("end"),
                                            F.count(F.lit(1)).alias("length")).drop("_run")


def kl_terms(params: DataFrame, node: str, mu: Column, logvar: Column) -> DataFrame:
    """KL(N(mu, e^lv) || N(0, 1)) per node with lv clamped to [-10, 5]."""
    lv = clamp(logvar, -10.0, 5.0)
    return params.groupBy(node).agg((-0.5 * F.sum(1 + lv - mu * mu - F.exp(lv))).alias("kl"))


def clip_by_norm(grads: DataFrame, node: str = "node_id", value: str = "v", max_norm: float = 1.0) -> DataFrame:
    """Scale each node's gradient by min(1, max_norm / (||g|| + 1e-6))."""
    n = grads.groupBy(node).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_norm"))
    j = grads.join(n, node)
    return j.withColumn(value, F.col(value) * F.least(F.lit(1.0), max_norm / (F.col("_norm") + 1e-6))).drop("_norm")
