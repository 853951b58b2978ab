"""Stage 6 queries: tiers, topology, averaging, similarity, divergence, round-log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquifer.functions import cosine, r6
from aquifer.operators import derive, network
from aquifer.plans import sql as S
from aquifer.plans.registry import query
from aquifer.sources import fixtures as fx


def _tiers(spark, d):
    return network.size_tiers(fx.node_volumes(spark, d))


def _edges(spark, d):
    return network.tier_topology(_tiers(spark, d))


def _cluster():
    return (F.col("node_id") % 3).alias("cluster")  # fixture cluster label of FX5 nodes

EDGES_SQL = """
, rules AS (SELECT * FROM (VALUES (1, 1, 1.0), (2, 1, 0.8), (1, 2, 1.0), (2, 2, 0.5), (1, 3, 1.0)) t(st, dt, weight))
, edges AS (SELECT a.node_id AS src, b.node_id AS dst, r.weight::DOUBLE AS weight FROM tiers a JOIN rules r ON a.tier = r.st
            JOIN tiers b ON b.tier = r.dt WHERE a.node_id <> b.node_id)
"""
AVG_SQL = """
, contrib AS (SELECT src, dst FROM edges UNION SELECT node_id, node_id FROM tiers)
, avg_p AS (SELECT c.src AS node_id, p.param, sum(p.v * t2.volume) / sum(t2.volume) AS v FROM contrib c
            JOIN tiers t1 ON t1.node_id = c.src JOIN tiers t2 ON t2.node_id = c.dst JOIN params p ON p.node_id = c.dst
            WHERE t1.tier <> 3 AND t2.tier <> 3 GROUP BY c.src, p.param
            UNION ALL SELECT p.node_id, p.param, p.v FROM params p JOIN tiers t USING (node_id) WHERE t.tier = 3)
"""
PAIRS_SQL = """
, norms AS (SELECT node_id, sqrt(sum(v*v)) AS nrm FROM params GROUP BY node_id)
, pairs AS (SELECT a.node_id AS a, b.node_id AS b, CASE WHEN na.nrm < 1e-8 OR nb.nrm < 1e-8 THEN 0.0
            ELSE sum(a.v * b.v) / (any_value(na.nrm) * any_value(nb.nrm)) END AS sim
            FROM params a JOIN params b ON a.param = b.param AND a.node_id < b.node_id
            JOIN norms na ON na.node_id = a.node_id JOIN norms nb ON nb.node_id = b.node_id
            GROUP BY a.node_id, b.node_id, na.nrm, nb.nrm)
"""


@query("g_tiers", S.with_(S.VOLUMES, S.TIERS) + "SELECT node_id, volume, tier FROM tiers")
def g_tiers(spark, d):
    """Node size tiers from the 0.33 / 0.66 quantiles of node volumes."""
    return _tiers(spark, d).withColumn("tier", F.col("tier").cast("int"))


@query("g_tier_dist", S.with_(S.VOLUMES, S.TIERS) + "SELECT tier, count(*) AS n_nodes FROM tiers GROUP BY tier")
def g_tier_dist(spark, d):
    return network.tier_distribution(_tiers(spark, d)).withColumn("tier", F.col("tier").cast("int"))


@query("c_centroids", S.with_(S.PARAMS) + "SELECT node_id, param, round(v, 6) AS v FROM params")
def c_centroids(spark, d):
    """Mean vector per cluster (per-position average of the member vectors)."""
    return fx.node_params(spark, d).select("node_id", F.col("param").cast("bigint").alias("param"), r6("v").alias("v"))


@query("f_env_fingerprint", S.with_(S.ENV, S.ENV_LONG) + """
, w AS (SELECT * FROM (VALUES ('TDS', 1.0), ('FE', 4.0), ('SO4', 3.0), ('MN', 2.0), ('NO3N', 1.0), ('heavy', 1.0))
        t(col, w))
SELECT node_id, col, round(avg(x) * any_value(w.w), 6) AS value FROM env_long JOIN w USING (col) GROUP BY node_id, col""")
def f_env_fingerprint(spark, d):
    """Weighted environmental mean vector per node (long form)."""
    from aquifer.operators.stats import to_long

    w = spark.createDataFrame([("TDS", 1.0), ("FE", 4.0), ("SO4", 3.0), ("MN", 2.0), ("NO3N", 1.0), ("heavy", 1.0)],
                              "col string, w double")
    long = to_long(fx.env_covariates(spark, d), fx.ENV_COLUMNS, ["node_id"])
    g = long.groupBy("node_id", "col").agg(F.avg("x").alias("m")).join(F.broadcast(w), "col")
    return g.select("node_id", "col", r6(F.col("m") * F.col("w")).alias("value"))


@query("n_topology", S.with_(S.VOLUMES, S.TIERS) + EDGES_SQL + "SELECT src, dst, weight FROM edges")
def n_topology(spark, d):
    """Tier topology edges."""
    return _edges(spark, d)


@query("n_intra", S.with_(S.VOLUMES, S.TIERS) + """
SELECT a.node_id % 3 AS cluster, a.node_id AS src, b.node_id AS dst,
  CASE a.tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 WHEN 3 THEN 0.0 ELSE 0.5 END::DOUBLE AS weight
FROM tiers a JOIN tiers b ON a.node_id % 3 = b.node_id % 3 AND a.node_id <> b.node_id""")
def n_intra(spark, d):
    """Complete digraph inside each cluster, outbound weight by source tier."""
    t = _tiers(spark, d).withColumn("cluster", _cluster())
    return network.intra_cluster_topology(t, "cluster")


@query("n_nodes", S.with_(S.VOLUMES, S.TIERS) + EDGES_SQL + """
SELECT t.node_id, t.volume, t.tier, t.tier = 1 AS is_hub,
  coalesce((SELECT string_agg(dst::VARCHAR, ',' ORDER BY dst) FROM edges e WHERE e.src = t.node_id), '') AS neighbours
FROM tiers t""")
def n_nodes(spark, d):
    """Node table with hub flag and out-neighbour list."""
    n = network.node_table(_tiers(spark, d), _edges(spark, d))
    return n.select("node_id", "volume", F.col("tier").cast("int").alias("tier"), "is_hub",
                    F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query("f_avg", S.with_(S.PARAMS, S.VOLUMES, S.TIERS) + EDGES_SQL + AVG_SQL + """
SELECT node_id, param, round(v, 6) AS v FROM avg_p""")
def f_avg(spark, d):
    """Volume-weighted averaging over the tier graph (tier-3 nodes keep their parameters)."""
    t = _tiers(spark, d)
    a = network.pooled_average(fx.node_params(spark, d), t.withColumn("pool", F.lit(0)), "pool")  # tiers 1 and 2 are all linked
    return a.select("node_id", F.col("param").cast("bigint").alias("param"), r6("v").alias("v"))


@query("f_cluster_avg", S.with_(S.PARAMS, S.VOLUMES, S.TIERS) + """
, tk AS (SELECT *, node_id % 3 AS cluster FROM tiers)
, ok AS (SELECT cluster FROM tk GROUP BY cluster HAVING count(*) > 1 AND avg((tier = 3)::INT) <= 0.95)
, act AS (SELECT * FROM tk WHERE cluster IN (SELECT cluster FROM ok))
, contrib AS (SELECT a.node_id AS src, b.node_id AS dst FROM act a JOIN act b ON a.cluster = b.cluster)
, upd AS (SELECT c.src AS node_id, p.param, sum(p.v * t2.volume) / sum(t2.volume) AS v FROM contrib c
          JOIN act t1 ON t1.node_id = c.src JOIN act t2 ON t2.node_id = c.dst JOIN params p ON p.node_id = c.dst
          WHERE t1.tier <> 3 AND t2.tier <> 3 GROUP BY c.src, p.param
          UNION ALL SELECT p.node_id, p.param, p.v FROM params p JOIN act USING (node_id) WHERE act.tier = 3
          UNION ALL SELECT p.node_id, p.param, p.v FROM params p WHERE p.node_id NOT IN (SELECT node_id FROM act))
SELECT node_id, param, round(v, 6) AS v FROM upd""")
def f_cluster_avg(spark, d):
    """Clustered averaging for every eligible cluster in one job."""
    t = _tiers(spark, d).withColumn("cluster", _cluster())
    a = network.clustered_average(fx.node_params(spark, d), t, "cluster")
    return a.select("node_id", F.col("param").cast("bigint").alias("param"), r6("v").alias("v"))


@query("f_interp", S.with_(S.PARAMS, S.VOLUMES, S.TIERS) + EDGES_SQL + AVG_SQL + """
SELECT p.node_id, p.param, round(p.v + 0.1 * (coalesce(a.v, p.v) - p.v), 6) AS v FROM params p
LEFT JOIN avg_p a USING (node_id, param)""")
def f_interp(spark, d):
    """Interpolated meta-update old + 0.1 * (new - old)."""
    t = _tiers(spark, d)
    old = fx.node_params(spark, d)
    new = network.pooled_average(old, t.withColumn("pool", F.lit(0)), "pool")
    i = network.interpolate(old, new, ["node_id", "param"])
    return i.select("node_id", F.col("param").cast("bigint").alias("param"), r6("v").alias("v"))


@query("n_nonfinite", S.with_(S.PARAMS) + """
SELECT node_id, count(CASE WHEN isnan(v) OR isinf(v) THEN 1 END) AS n_nonfinite, count(*) AS n_params
FROM params GROUP BY node_id""")
def n_nonfinite(spark, d):
    return network.nonfinite_counts(fx.node_params(spark, d))


@query("s_simmatrix", S.with_(S.PARAMS) + PAIRS_SQL + "SELECT a, b, round(sim, 6) AS sim FROM pairs")
def s_simmatrix(spark, d):
    """Pairwise cosine similarity of node parameter vectors (a < b)."""
    return network.similarity_pairs(fx.node_params(spark, d)).withColumn("sim", r6("sim"))


@query("s_cosine", S.with_(S.PARAMS) + """
, cen AS (SELECT node_id, list(v ORDER BY param) AS c FROM params GROUP BY node_id)
SELECT e.vec_id, e.label AS node_id, round(CASE WHEN sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x)))
  < 1e-8 OR sqrt(list_sum(list_transform(c, lambda x: x * x))) < 1e-8 THEN 0.0
  ELSE list_sum(list_transform(list_zip(e.embedding, c), lambda z: z[1]::DOUBLE * z[2]))
     / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(c, lambda x: x * x))))
  END, 6) AS sim FROM embeddings e JOIN cen ON e.label = cen.node_id""")
def s_cosine(spark, d):
    """Cosine of every embedding to its node centroid with array higher-order functions."""
    p = fx.node_params(spark, d)
    cen = p.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("param", "v"))).alias("_s")) \
        .select("node_id", F.transform("_s", lambda s: s["v"]).alias("c"))
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    j = e.join(cen, e.label == cen.node_id)
    emb = F.transform("embedding", lambda x: x.cast("double"))
    return j.select("vec_id", F.col("label").alias("node_id"), r6(cosine(emb, F.col("c"))).alias("sim"))


@query("s_divergence", S.with_(S.PARAMS, S.VOLUMES, S.TIERS) + PAIRS_SQL + """
, ok AS (SELECT node_id FROM tiers WHERE tier <> 3)
SELECT count(*) AS n_pairs, round(1 - avg(sim), 6) AS divergence, coalesce(1 - avg(sim) > 0.05, false) AS diverged
FROM pairs WHERE a IN (SELECT node_id FROM ok) AND b IN (SELECT node_id FROM ok)""")
def s_divergence(spark, d):
    """Network divergence among non-satellite nodes."""
    r = network.network_divergence(network.similarity_pairs(fx.node_params(spark, d)), _tiers(spark, d))
    return r.withColumn("divergence", r6("divergence"))


@query("s_intra", S.with_(S.PARAMS, S.VOLUMES, S.TIERS) + PAIRS_SQL + """
, k AS (SELECT node_id, node_id % 3 AS cluster FROM tiers WHERE tier <> 3)
SELECT ka.cluster, round(avg(sim), 6) AS mean_sim, count(*) AS n_pairs, avg(sim) < 0.8 AS diverged
FROM pairs JOIN k ka ON ka.node_id = a JOIN k kb ON kb.node_id = b WHERE ka.cluster = kb.cluster GROUP BY ka.cluster""")
def s_intra(spark, d):
    """Intra-cluster mean similarity with satellites excluded."""
    t = _tiers(spark, d).withColumn("cluster", _cluster())
    r = network.intra_cluster_similarity(network.similarity_pairs(fx.node_params(spark, d)), t, "cluster")
    return r.withColumn("mean_sim", r6("mean_sim"))


GRADS_SQL = """
, grads AS (SELECT node_id, param, avg(v) FILTER (WHERE vec_id % 2 = 0) - avg(v) AS v FROM (
   SELECT vec_id, label AS node_id, generate_subscripts(embedding, 1) - 1 AS param, unnest(embedding)::DOUBLE AS v
   FROM embeddings) GROUP BY node_id, param)
"""


def _grads(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    x = e.select("vec_id", F.col("label").alias("node_id"), F.posexplode("embedding").alias("param", "v"))
    x = x.withColumn("v", F.col("v").cast("double"))
    return x.groupBy("node_id", "param").agg(
        (F.avg(F.when(F.col("vec_id") % 2 == 0, F.col("v"))) - F.avg("v")).alias("v"))


@query("s_grad_conflict", S.with_(S.VOLUMES, S.TIERS) + GRADS_SQL + """
, hub AS (SELECT g.* FROM grads g JOIN tiers t USING (node_id) WHERE t.tier = 1)
, nrm AS (SELECT node_id, sqrt(sum(v*v)) AS n FROM hub GROUP BY node_id)
, pr AS (SELECT a.node_id AS a, b.node_id AS b, CASE WHEN any_value(na.n) < 1e-8 OR any_value(nb.n) < 1e-8 THEN 0.0
         ELSE sum(a.v*b.v) / (any_value(na.n) * any_value(nb.n)) END AS sim
         FROM hub a JOIN hub b ON a.param = b.param AND a.node_id < b.node_id JOIN nrm na ON na.node_id = a.node_id
         JOIN nrm nb ON nb.node_id = b.node_id GROUP BY a.node_id, b.node_id)
SELECT round(coalesce(avg(sim), 1.0), 6) AS grad_similarity, count(*) AS n_pairs FROM pr""")
def s_grad_conflict(spark, d):
    """Mean cosine between hub gradient vectors (gradient = even-half mean minus full mean)."""
    r = network.gradient_conflict(_grads(spark, d), _tiers(spark, d))
    return r.withColumn("grad_similarity", r6("grad_similarity"))


@query("m_clip", "WITH " + GRADS_SQL.strip().lstrip(",") + """
, nr AS (SELECT node_id, sqrt(sum(v*v)) AS n FROM grads GROUP BY node_id)
SELECT node_id, param, round(v * least(1.0, 1.0 / (n + 1e-6)), 6) AS v FROM grads JOIN nr USING (node_id)""")
def m_clip(spark, d):
    """Gradient clipping by global L2 norm per node."""
    c = network.clip_by_norm(_grads(spark, d))
    return c.select("node_id", F.col("param").cast("bigint").alias("param"), r6("v").alias("v"))


@query("m_kl", S.with_(S.PARAMS) + """
SELECT node_id, round(-0.5 * sum(1 + greatest(-10, least(5, ln(v*v + 1e-4))) - v*v
  - exp(greatest(-10, least(5, ln(v*v + 1e-4))))), 6) AS kl FROM params GROUP BY node_id""")
def m_kl(spark, d):
    """KL of a diagonal Gaussian (mu = v, log-variance = ln(v^2 + 1e-4)) to N(0, 1) per node."""
    p = fx.node_params(spark, d)
    r = network.kl_terms(p, "node_id", F.col("v"), F.log(F.col("v") * F.col("v") + 1e-4))
    return r.withColumn("kl", r6("kl"))


@query("f_momentum", S.with_(S.ROUNDLOG) + """
, lst AS (SELECT node_id, count(*) AS n, arg_max(loss, round) AS last_loss, max(round) AS lr FROM roundlog GROUP BY node_id)
, prv AS (SELECT r.node_id, arg_max(loss, round) AS prev_loss FROM roundlog r JOIN lst USING (node_id)
          WHERE r.round < lst.lr GROUP BY r.node_id)
SELECT node_id, n AS n_rounds, round(prev_loss - last_loss, 6) AS drop,
  CASE WHEN n < 2 THEN 0.7 WHEN prev_loss - last_loss > 0.05 THEN 0.85 WHEN prev_loss - last_loss < 0.005 THEN 0.5
  ELSE 0.7 END AS momentum FROM lst LEFT JOIN prv USING (node_id)""")
def f_momentum(spark, d):
    """Node momentum from the last two logged rounds."""
    m = network.momentum(fx.round_log(spark, d))
    return m.select("node_id", "n_rounds", r6("drop").alias("drop"), r6("momentum").alias("momentum"))


@query("f_stability", S.with_(S.ROUNDLOG) + """
, rr AS (SELECT round, lag(round) OVER (ORDER BY round) AS prev_round FROM (SELECT DISTINCT round FROM roundlog))
, st AS (SELECT c.round, avg((c.cluster_label = o.cluster_label)::INT::DOUBLE) AS stability, count(*) AS n_common
         FROM roundlog c JOIN rr USING (round) JOIN roundlog o ON o.round = rr.prev_round AND o.node_id = c.node_id
         GROUP BY c.round)
SELECT rr.round, coalesce(rr.prev_round, -1) AS prev_round, round(st.stability, 6) AS stability, coalesce(st.n_common, 0) AS n_common
FROM rr LEFT JOIN st USING (round)""")
def f_stability(spark, d):
    """Membership stability between consecutive rounds."""
    return network.membership_stability(fx.round_log(spark, d)).withColumn("stability", r6("stability"))


@query("f_round_trend", S.with_(S.ROUNDLOG) + """
SELECT round, count(*) AS n_clusters, round(avg(sz), 6) AS mean_size, round(any_value(ml), 6) AS mean_loss FROM (
  SELECT round, cluster_label, count(*) AS sz, any_value(ml) AS ml FROM (SELECT *, avg(loss) OVER (PARTITION BY round) AS ml
  FROM roundlog) GROUP BY round, cluster_label) GROUP BY round""")
def f_round_trend(spark, d):
    """Per-round cluster count, mean cluster size and mean loss."""
    t = network.round_trend(fx.round_log(spark, d))
    return t.select("round", "n_clusters", r6("mean_size").alias("mean_size"), r6("mean_loss").alias("mean_loss"))


@query("f_loss_delta", S.with_(S.ROUNDLOG) + """
SELECT node_id, round(arg_min(loss, round), 6) AS first_loss, round(arg_max(loss, round), 6) AS final_loss,
  round(arg_max(loss, round) - arg_min(loss, round), 6) AS delta FROM roundlog GROUP BY node_id""")
def f_loss_delta(spark, d):
    """First -> final loss per node."""
    t = network.first_final_delta(fx.round_log(spark, d))
    return t.select("node_id", *[r6(c).alias(c) for c in ["first_loss", "final_loss", "delta"]])


@query("f_round_loss", S.with_(S.ROUNDLOG) + """
SELECT round, round(avg(loss), 6) AS mean_loss, count(*) AS n_nodes FROM roundlog GROUP BY round""")
def f_round_loss(spark, d):
    """Mean loss per round over the nodes that logged one."""
    g = fx.round_log(spark, d).groupBy("round").agg(F.avg("loss").alias("mean_loss"), F.count(F.lit(1)).alias("n_nodes"))
    return g.withColumn("mean_loss", r6("mean_loss"))


@query("f_nearest_hub", S.with_(S.VOLUMES, S.TIERS) + EDGES_SQL + """
SELECT e.src AS node_id, arg_min(e.dst, (t.tier <> 1)::INT * 1000000 + e.dst) AS nearest
FROM edges e JOIN tiers t ON t.node_id = e.dst GROUP BY e.src""")
def f_nearest_hub(spark, d):
    """Nearest hub neighbour (else first neighbour)."""
    return network.nearest_hub(_tiers(spark, d), _edges(spark, d))


@query("w_runs", S.with_(S.ROUNDLOG) + """
SELECT round, cluster_label, min(node_id) AS start, max(node_id) AS "end", count(*) AS length FROM (
  SELECT *, sum(chg) OVER (PARTITION BY round ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM (SELECT *, CASE WHEN lag(cluster_label) OVER (PARTITION BY round ORDER BY node_id) IS NULL OR
        lag(cluster_label) OVER (PARTITION BY round ORDER BY node_id) <> cluster_label THEN 1 ELSE 0 END AS chg
        FROM roundlog)) GROUP BY round, run, cluster_label""")
def w_runs(spark, d):
    """Runs of equal cluster label along node order within each round (window per round)."""
    return network.label_runs(fx.round_log(spark, d), "round", "node_id", "cluster_label")


@query("c_map", S.with_(S.ROUNDLOG) + """
SELECT round, cluster_label, string_agg(node_id::VARCHAR, ',' ORDER BY node_id) AS nodes, count(*) AS n_nodes
FROM roundlog GROUP BY round, cluster_label""")
def c_map(spark, d):
    """Cluster label -> sorted member nodes per round."""
    g = fx.round_log(spark, d).groupBy("round", "cluster_label").agg(
        F.array_sort(F.collect_list("node_id")).alias("_n"), F.count(F.lit(1)).alias("n_nodes"))
    return g.select("round", "cluster_label", F.array_join(F.transform("_n", lambda x: x.cast("string")), ",")
                    .alias("nodes"), "n_nodes")


@query("c_meta_map", S.with_(S.ROUNDLOG) + """
, meta AS (SELECT node_id, cluster_label AS meta FROM roundlog WHERE round = (SELECT max(round) FROM roundlog))
SELECT user_id, (user_id % 20)::INT AS node_id, meta::VARCHAR AS meta FROM (SELECT DISTINCT user_id FROM events) u
LEFT JOIN meta ON meta.node_id = u.user_id % 20""")
def c_meta_map(spark, d):
    """Wells -> node -> meta-cluster of the final round (unmatched -> NULL)."""
    log = fx.round_log(spark, d)
    last = log.agg(F.max("round")).first()[0]
    meta = log.where(F.col("round") == last).select("node_id", F.col("cluster_label").alias("meta"))
    u = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct().withColumn(
        "node_id", (F.col("user_id") % 20).cast("int"))
    return u.join(meta, "node_id", "left").select("user_id", "node_id", F.col("meta").cast("string"))


@query("j_node_rows", S.with_(S.ENV, S.VOLUMES, S.TIERS) + """
SELECT node_id, count(*) AS n_rows, round(sum(TDS), 4) AS tds FROM env
WHERE node_id IN (SELECT node_id FROM tiers WHERE tier = 1) GROUP BY node_id""")
def j_node_rows(spark, d):
    """Rows of the hub nodes only (left-semi join to the node list)."""
    hubs = _tiers(spark, d).where(F.col("tier") == 1).select("node_id")
    e = fx.env_covariates(spark, d).join(hubs, "node_id", "left_semi")
    return e.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("TDS"), 4).alias("tds"))


@query("j_local_chain", """
SELECT DISTINCT event_type AS analyte FROM events WHERE event_type NOT IN ('click', 'view')""")
def j_local_chain(spark, d):
    """Observed analytes that are not in the global chain (left-anti join)."""
    g = spark.createDataFrame([("click",), ("view",)], "analyte string")
    obs = fx.obs_long(spark, d).select("analyte").distinct()
    return obs.join(g, "analyte", "left_anti")


@query("x_analytes", S.with_(S.OBS, S.THR, S.LABELLED) + """
SELECT DISTINCT analyte FROM labelled WHERE y IS NOT NULL""")
def x_analytes(spark, d):
    """Union of the labelled analytes of all nodes, de-duplicated."""
    lab = derive.label_exceedance(fx.obs_long(spark, d), fx.fx_thresholds(spark)).where(F.col("y").isNotNull())
    by_node = lab.select((F.col("well_id") % 10).alias("node_id"), "analyte").distinct()
    return by_node.select("analyte").distinct()
