"""Stage 7 queries: weighting, PCA, SOM, agglomeration, assignment, fingerprints, prior matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquifer.functions import r6
from aquifer.operators import cluster, fingerprint, profile, sites
from aquifer.operators.nearest import match
from aquifer.plans import sql as S
from aquifer.plans.registry import query
from aquifer.session import write_down
from aquifer.sources import fixtures as fx
from aquifer.sources.tables import read_table

W = {"TDS": 1.0, "FE": 4.0, "SO4": 3.0, "MN": 2.0}


@query("c_weighted", S.with_(S.ENV) + """
SELECT l_orderkey, l_linenumber, round(TDS * sqrt(1.0), 6) AS TDS, round(FE * sqrt(4.0), 6) AS FE,
  round(SO4 * sqrt(3.0), 6) AS SO4, round(MN * sqrt(2.0), 6) AS MN, round(NO3N, 6) AS NO3N, round(heavy, 6) AS heavy FROM env""")
def c_weighted(spark, d):
    """Features scaled by sqrt(weight) before PCA (unlisted -> weight 1)."""
    e = fx.env_covariates(spark, d).select("l_orderkey", "l_linenumber", *fx.ENV_COLUMNS)
    w = cluster.weight_features(e, fx.ENV_COLUMNS, W)
    return w.select("l_orderkey", "l_linenumber", *[r6(c).alias(c) for c in fx.ENV_COLUMNS])


@query("c_pca")
def c_pca(spark, d):
    """Centred PCA fitted on train rows, applied to all rows (rows-only; variance checked in tests)."""
    e = fx.env_covariates(spark, d)
    cols = fx.ENV_COLUMNS
    comps, mean, _ = cluster.fit_pca(e.where(F.col("l_orderkey") % 5 != 0), cols)
    return cluster.apply_pca(e, cols, comps, mean, ["l_orderkey", "l_linenumber", "node_id"])


def _node_vectors(spark, d):
    """(id, v): the nodes' parameter vectors, entries in the order of their number."""
    entries = F.array_sort(F.collect_list(F.struct("param", "v")))  # a node's parameters
    return fx.node_params(spark, d).groupBy(F.col("node_id").cast("bigint").alias("id")).agg(
        F.transform(entries, lambda e: e["v"]).alias("v"))


def _embedded(spark, d):
    return read_table(spark, d, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


ASSIGN_SQL = S.with_(S.PARAMS) + """
, cen AS (SELECT node_id, list(v ORDER BY param) AS c FROM params GROUP BY node_id)
, sims AS (SELECT e.vec_id, cen.node_id, CASE WHEN sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x)))
    < 1e-8 OR sqrt(list_sum(list_transform(c, lambda x: x * x))) < 1e-8 THEN 0.0
    ELSE list_sum(list_transform(list_zip(e.embedding, c), lambda z: z[1]::DOUBLE * z[2]))
     / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(c, lambda x: x * x))))
    END AS sim FROM embeddings e, cen)
, best AS (SELECT vec_id, node_id AS assigned, sim FROM sims
           QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, node_id) = 1)
"""


def _assigned(spark, d):
    return sites.nearest_centroid(_embedded(spark, d), "vec", write_down(_node_vectors(spark, d)))


@query("c_assign", ASSIGN_SQL + """
SELECT vec_id, assigned::INT AS assigned, round(sim, 6) AS sim, sim < 0.4 AS low_confidence FROM best""")
def c_assign(spark, d):
    """Nearest node centroid by cosine for every row (first on ties), low-confidence flag."""
    a = _assigned(spark, d)
    return a.select("vec_id", F.col("assigned").cast("int").alias("assigned"), r6("sim").alias("sim"), "low_confidence")


@query("w_assign_counts", ASSIGN_SQL + "SELECT assigned::INT AS assigned, count(*) AS n FROM best GROUP BY assigned")
def w_assign_counts(spark, d):
    """Assignment value counts, most frequent first."""
    return cluster.value_counts(_assigned(spark, d).withColumn("assigned", F.col("assigned").cast("int")), "assigned")


@query("c_som")
def c_som(spark, d):
    """A map of the embeddings on the default grid, then the winning unit per row (rows-only)."""
    e = _embedded(spark, d)
    code, _ = sites.fit_map(e, "vec")
    return match(e.select("vec_id", "vec"), "vec", code).select("vec_id", F.col("best").alias("neuron"))


@query("c_winner", S.with_(S.PARAMS) + """
, dist AS (SELECT vec_id, node_id, sum(pow(x - v, 2)) AS d2 FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x,
    generate_subscripts(embedding, 1) - 1 AS param FROM embeddings) e JOIN params USING (param) GROUP BY vec_id, node_id)
SELECT vec_id, node_id::BIGINT AS winner, round(sqrt(d2), 6) AS dist FROM dist
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, node_id) = 1""")
def c_winner(spark, d):
    """The winning unit of every row for a given codebook (the node vectors)."""
    won = match(_embedded(spark, d).select("vec_id", "vec"), "vec", write_down(_node_vectors(spark, d)))
    return won.select("vec_id", F.col("best").alias("winner"), r6(F.sqrt("score")).alias("dist"))


@query("c_group_sim", """
WITH n AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
, u AS (SELECT label, vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM n)
SELECT a.label::BIGINT AS a, b.label::BIGINT AS b, round(avg(list_sum(list_transform(list_zip(a.u, b.u), lambda z: z[1] * z[2]))), 6) AS sim
FROM u a JOIN u b ON a.label < b.label GROUP BY a.label, b.label""")
def c_group_sim(spark, d):
    """Mean cosine between the members of two groups, from one sum of unit vectors a group (SQL: from all pairs of members)."""
    items = _embedded(spark, d).select(F.col("label").cast("bigint").alias("grp"), F.col("vec").alias("v"))
    return sites.group_similarity(items).withColumn("sim", r6("sim"))


def _agglomeration_sql(steps: int = 12, threshold: float = 0.6, source: str | None = None, rows: str = "params") -> str:
    """Always the closest pair of groups by mean distance over all pairs of members, `steps` times at most."""
    sql = (source or S.with_(S.PARAMS)) + f"""
, norms AS (SELECT node_id, sqrt(sum(v * v)) AS nrm FROM {rows} GROUP BY node_id)
, dist AS MATERIALIZED (SELECT a.node_id AS i, b.node_id AS j, 1 - sum(a.v * b.v) / (any_value(x.nrm) * any_value(y.nrm)) AS d
    FROM {rows} a JOIN {rows} b ON a.param = b.param AND a.node_id <> b.node_id JOIN norms x ON x.node_id = a.node_id
    JOIN norms y ON y.node_id = b.node_id GROUP BY a.node_id, b.node_id)
, g0 AS (SELECT DISTINCT node_id AS item, node_id AS cluster FROM {rows})"""
    for k in range(steps):
        sql += f"""
, m{k} AS MATERIALIZED (SELECT a.cluster AS a, b.cluster AS b, avg(d) AS d FROM dist JOIN g{k} a ON a.item = i JOIN g{k} b ON b.item = j
    WHERE a.cluster < b.cluster GROUP BY a.cluster, b.cluster HAVING avg(d) < {threshold} ORDER BY avg(d), a.cluster LIMIT 1)
, g{k + 1} AS MATERIALIZED (SELECT item, coalesce(m{k}.a, cluster) AS cluster FROM g{k} LEFT JOIN m{k} ON cluster = m{k}.b)"""
    return sql + f"\nSELECT item::BIGINT AS item, cluster::BIGINT AS cluster FROM g{steps}"


@query("c_agglom", _agglomeration_sql())
def c_agglom(spark, d):
    """C4: average-linkage merging of the node vectors below a mean cosine distance, by sums of unit vectors."""
    return sites.merge_groups(_node_vectors(spark, d).withColumnRenamed("id", "item"), 0.6)


@query("t_corr_groups")
def t_corr_groups(spark, d):
    """Complete-linkage groups of analytes on the 1 - |spearman| distance, cut at 0.9 (rows-only)."""
    r = profile.spearman_pairs(fx.wide_samples(spark, d), fx.FX_ANALYTES)
    ids = {a: i for i, a in enumerate(fx.FX_ANALYTES)}
    m = F.create_map(*[x for a, i in ids.items() for x in (F.lit(a), F.lit(i))])
    pairs = r.select(m[F.col("a")].alias("i"), m[F.col("b")].alias("j"), (1 - F.abs("r")).alias("d"))
    alone = spark.createDataFrame([(i,) for i in ids.values()], "item long")
    lab = cluster.agglomerate(pairs, 0.9, "complete", items=alone)
    inv = F.create_map(*[x for a, i in ids.items() for x in (F.lit(i), F.lit(a))])
    return lab.select(inv[F.col("item")].alias("analyte"), inv[F.col("cluster")].alias("group"))


ENV_WEIGHTS = {"TDS": 2.0, "heavy": 0.5}

FP_SQL = S.with_(S.ENV, S.ENV_LONG, S.PARAMS) + """
, feat AS (SELECT node_id, 'env_' || col AS feature, avg(x) * CASE col WHEN 'TDS' THEN 2.0 WHEN 'heavy' THEN 0.5 ELSE 1.0 END AS value
           FROM env_long GROUP BY node_id, col
           UNION ALL SELECT node_id, 'w' || param::VARCHAR AS feature, v FROM params)
, st AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM feat GROUP BY feature)
, fp AS MATERIALIZED (SELECT node_id, f.feature AS param, CASE WHEN s > 0 THEN (value - m) / s ELSE 0.0 END AS v
                      FROM feat f JOIN st USING (feature))
"""


def _fingerprints(spark, d):
    from aquifer.operators.stats import to_long

    env = to_long(fx.env_covariates(spark, d), fx.ENV_COLUMNS, ["node_id"]).groupBy("node_id", F.col("col").alias("feature")).agg(
        F.avg("x").alias("value"))
    params = fx.node_params(spark, d).withColumn("node_id", F.col("node_id").cast("bigint"))
    return fingerprint.node_fingerprints(env, params, ENV_WEIGHTS)


@query("c_fingerprint", FP_SQL + "SELECT node_id, param AS feature, round(v, 6) AS z FROM fp")
def c_fingerprint(spark, d):
    """Node fingerprints = weighted env means || all parameters (principal scores above 15 nodes), z-scored per column."""
    return _fingerprints(spark, d).withColumn("z", r6("z"))


@query("c_node_clusters", _agglomeration_sql(9, 0.3, FP_SQL, "fp"))
def c_node_clusters(spark, d):
    """Nodes clustered on their fingerprints by average linkage below a mean cosine distance of 0.3."""
    return fingerprint.cluster_nodes(_fingerprints(spark, d))


@query("c_weight_scores")
def c_weight_scores(spark, d):
    """The principal scores of all node parameters, from node products (fewer nodes than parameters)."""
    s = fingerprint.principal_scores(fx.node_params(spark, d), "node_id", "param", "v")
    return s.withColumn("value", r6("value"))


PRIOR_SQL = S.with_(S.PRED) + """
, pm AS (SELECT node_id, analyte, greatest(0.0, least(1.0, avg(score) * 10)) AS value FROM pred WHERE mode = 'personalized'
         GROUP BY node_id, analyte)
"""


def _prior(spark, d):
    p = fx.predictions(spark, d).where(F.col("mode") == "personalized")
    g = p.groupBy("node_id", "analyte").agg(F.avg("score").alias("m"))
    return g.select("node_id", F.col("analyte").alias("feature"),
                    F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("m") * 10)).alias("value"))


@query("c_prior_matrix", PRIOR_SQL + """
SELECT node_id, round(coalesce(max(CASE WHEN analyte = 'A0' THEN value END), 0), 6) AS A0,
  round(coalesce(max(CASE WHEN analyte = 'A1' THEN value END), 0), 6) AS A1,
  round(coalesce(max(CASE WHEN analyte = 'A2' THEN value END), 0), 6) AS A2,
  round(coalesce(max(CASE WHEN analyte = 'A3' THEN value END), 0), 6) AS A3 FROM pm GROUP BY node_id""")
def c_prior_matrix(spark, d):
    """M9/C11: node x analyte prior matrix (clipped to [0, 1], missing -> 0)."""
    m = _prior(spark, d).groupBy("node_id").pivot("feature", ["A0", "A1", "A2", "A3"]).agg(F.max("value")).na.fill(0.0)
    return m.select("node_id", *[r6(c).alias(c) for c in ["A0", "A1", "A2", "A3"]])


@query("c_prior_dist", PRIOR_SQL + """
SELECT a.node_id AS i, b.node_id AS j, round(sqrt(sum(pow(a.value - b.value, 2))), 6) AS d
FROM pm a JOIN pm b ON a.analyte = b.analyte AND a.node_id < b.node_id GROUP BY a.node_id, b.node_id""")
def c_prior_dist(spark, d):
    """C11: Euclidean distances between node prior vectors."""
    return cluster.pair_distances(_prior(spark, d), "node_id").withColumn("d", r6("d"))


@query("c_prior_groups")
def c_prior_groups(spark, d):
    """C11: average-linkage order of the prior matrix cut to 3 groups (rows-only)."""
    return cluster.agglomerate(cluster.pair_distances(_prior(spark, d), "node_id"), float("inf"), "average",
                               n_clusters=3)


SITE_KEYS = ["l_orderkey", "l_linenumber"]


def _sites(spark, d, train_only):
    """The environment features scaled by a plan, and the clusters fitted on them (or on the training rows)."""
    from aquifer.operators import prepare

    e = write_down(fx.env_covariates(spark, d).select(*SITE_KEYS, *fx.ENV_COLUMNS))  # joined once, read some times
    train = e.where(F.col("l_orderkey") % 5 != 0) if train_only else e
    plan = prepare.fit_scalers(train, fx.ENV_COLUMNS)
    scaled = write_down(prepare.apply_scalers(e, plan, keep=SITE_KEYS))
    rows = scaled.where(F.col("l_orderkey") % 5 != 0) if train_only else scaled
    return scaled, sites.fit_sites(rows, fx.ENV_COLUMNS, {"TDS": 2.0, "heavy": 0.5}, keep=() if train_only else SITE_KEYS, dealt=True)


@query("c_site_labels")
def c_site_labels(spark, d):
    """C1 + C2 + C4 + G8 end to end: features scaled, weighted, projected, mapped to the units of the default grid, the units
    merged below a cosine distance of 0.6, clusters tiered by size; every row gets unit, cluster and tier (rows-only)."""
    _, fitted = _sites(spark, d, train_only=False)
    return fitted.label_own()


@query("c_site_test")
def c_site_test(spark, d):
    """J9 end to end: clusters fitted on the training rows, the other rows assigned to the nearest centroid (rows-only)."""
    scaled, fitted = _sites(spark, d, train_only=True)
    return fitted.assign(scaled.where(F.col("l_orderkey") % 5 == 0), SITE_KEYS)
