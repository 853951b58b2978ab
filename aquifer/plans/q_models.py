"""Stages 8-9 queries: spark.ml baselines, descriptor model, attributions, distributed chain training."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquifer.functions import r6
from aquifer.operators import evaluate, federate, models, network, partition, prepare, rounds, shapley
from aquifer.plans import sql as S
from aquifer.plans.q_prepare import PROFILE_SQL
from aquifer.plans.registry import query
from aquifer.sources import fixtures as fx

FEATS = fx.MODEL_FEATURES
TARGETS = [f"y_{a}" for a in fx.MODEL_TARGETS]


def _split(spark, d):
    m = fx.model_frame(spark, d)
    s = prepare.chronological_split(m, "day", "sample_id", 0.8)
    return s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")


@query("m_gbt_independent")
def m_gbt_independent(spark, d):
    """M1: guarded per-analyte boosted trees (spark.ml GBT, 10 trees), test AUROC/AUPRC (rows-only)."""
    tr, te = _split(spark, d)
    m, _ = models.independent_gbt(tr, te, FEATS, TARGETS, max_iter=10)
    return m


@query("m_importance")
def m_importance(spark, d):
    """Feature importances of the per-analyte trees, ranked (rows-only)."""
    tr, te = _split(spark, d)
    _, imp = models.independent_gbt(tr, te, FEATS, TARGETS, max_iter=10)
    from pyspark.sql import Window

    return imp.withColumn("rank", F.row_number().over(Window.partitionBy("analyte").orderBy(F.desc("importance"))))


@query("m_gbt_chain")
def m_gbt_chain(spark, d):
    """M4: boosted-tree classifier chain; each link adds the previous probability as a feature."""
    tr, te = _split(spark, d)
    return models.chain_gbt(tr, te, FEATS, TARGETS, max_iter=5)


@query("m_descriptors", """
WITH d AS (SELECT * FROM (VALUES ('click', 1, 0, 8, 0), ('error', 0, 1, 6, 0), ('purchase', 1, 0, 6, 1),
                                 ('signup', 0, 1, 4, 0)) t(analyte, is_pfca, is_pfsa, chain_len, ether))
SELECT e.event_id, e.event_type AS analyte, coalesce(is_pfca, 0)::DOUBLE AS is_pfca, coalesce(is_pfsa, 0)::DOUBLE AS is_pfsa,
  coalesce(chain_len, 0)::DOUBLE AS chain_len, coalesce(ether, 0)::DOUBLE AS ether
FROM events e LEFT JOIN d ON d.analyte = e.event_type""")
def m_descriptors(spark, d):
    """M8 input / FX9: descriptor join with zero row for an analyte without descriptors."""
    long = fx.obs_long(spark, d).select(F.col("sample_id").alias("event_id"), "analyte")
    return models.descriptor_rows(long, fx.fx_descriptors(spark))


@query("m_pooled")
def m_pooled(spark, d):
    """M8: pooled descriptor-conditioned logistic model over (sample x analyte) rows; test metrics."""
    tr, te = _split(spark, d)

    def long(df):
        stack = F.array(*[F.struct(F.lit(a).alias("analyte"), F.col(f"y_{a}").alias("y")) for a in fx.MODEL_TARGETS])
        return df.select("sample_id", *FEATS, F.inline(stack))

    desc = fx.fx_descriptors(spark)
    pred = models.pooled_descriptor_model(models.descriptor_rows(long(tr), desc),
                                          models.descriptor_rows(long(te), desc), FEATS)
    return evaluate.ranking_metrics(pred, ["analyte"])


_ATTR_W = {"f_well": 0.5, "f_dow": -0.2, "f_events": 0.1, "f_hour": 0.3}


@query("m_attrib", S.with_(S.OBS) + """
, mf AS (SELECT well_id * 100000 + date_diff('day', DATE '2024-01-01', ts::DATE) AS sample_id, (well_id % 7) / 6.0 AS f_well,
         dayofweek(ts::DATE) + 1 AS dw, ln(1 + count(*)) AS f_events, min(hour(ts)) / 23.0 AS f_hour
         FROM obs GROUP BY well_id, ts::DATE)
, mf2 AS (SELECT sample_id, f_well, dw / 7.0 AS f_dow, f_events, f_hour FROM mf)
, bg AS (SELECT avg(f_well) AS a, avg(f_dow) AS b, avg(f_events) AS c, avg(f_hour) AS e FROM
         (SELECT * FROM mf2 ORDER BY sample_id LIMIT 50))
SELECT sample_id, round(0.5 * (f_well - a), 6) AS phi_f_well, round(-0.2 * (f_dow - b), 6) AS phi_f_dow,
  round(0.1 * (f_events - c), 6) AS phi_f_events, round(0.3 * (f_hour - e), 6) AS phi_f_hour FROM mf2, bg""")
def m_attrib(spark, d):
    """Local attributions of a given logistic link against the first 50 samples as background."""
    m = fx.model_frame(spark, d).select("sample_id", *FEATS)
    bg = m.orderBy("sample_id").limit(50)  # the background sample is the feature
    a = models.logistic_attribution(m, FEATS, _ATTR_W, bg)
    return a.select("sample_id", *[r6(f"phi_{c}").alias(f"phi_{c}") for c in FEATS])


_SHAP_SQL = S.with_(S.OBS) + """
, mf AS (SELECT well_id * 100000 + date_diff('day', DATE '2024-01-01', ts::DATE) AS sample_id, (well_id % 7) / 6.0 AS a,
         (dayofweek(ts::DATE) + 1) / 7.0 AS b, ln(1 + count(*)) AS c, min(hour(ts)) / 23.0 AS e FROM obs GROUP BY well_id, ts::DATE)
, bg AS (SELECT a AS ba, b AS bb, c AS bc, e AS be FROM mf ORDER BY sample_id LIMIT 50)
, masks AS (SELECT m, bit_count(m::INT)::INT AS size, [m & 1, (m >> 1) & 1, (m >> 2) & 1, (m >> 3) & 1] AS on_ FROM range(16) r(m))
, kinds AS (SELECT DISTINCT a, b, c, e FROM mf)
, f AS (SELECT a, b, c, e, m, size, on_, avg(1 / (1 + exp(-(0.5 * CASE WHEN on_[1] = 1 THEN a ELSE ba END - 0.2 * CASE WHEN on_[2] = 1 THEN b ELSE bb END
        + 0.1 * CASE WHEN on_[3] = 1 THEN c ELSE bc END + 0.3 * CASE WHEN on_[4] = 1 THEN e ELSE be END)))) AS v
        FROM kinds, bg, masks GROUP BY a, b, c, e, m, size, on_)
, phi AS (SELECT a, b, c, e, sum(v * CASE WHEN on_[1] = 1 THEN w1 ELSE -w0 END) AS pa, sum(v * CASE WHEN on_[2] = 1 THEN w1 ELSE -w0 END) AS pb,
          sum(v * CASE WHEN on_[3] = 1 THEN w1 ELSE -w0 END) AS pc, sum(v * CASE WHEN on_[4] = 1 THEN w1 ELSE -w0 END) AS pe, sum(CASE WHEN m = 0 THEN v END) AS base
          FROM (SELECT *, CASE size WHEN 0 THEN 0 WHEN 1 THEN 0.25 WHEN 2 THEN 1 / 12.0 WHEN 3 THEN 1 / 12.0 ELSE 0.25 END AS w1,
                CASE size WHEN 0 THEN 0.25 WHEN 1 THEN 1 / 12.0 WHEN 2 THEN 1 / 12.0 WHEN 3 THEN 0.25 ELSE 0 END AS w0 FROM f)
          GROUP BY a, b, c, e)
SELECT sample_id, round(pa, 6) + 0.0 AS phi_f_well, round(pb, 6) + 0.0 AS phi_f_dow, round(pc, 6) + 0.0 AS phi_f_events, round(pe, 6) + 0.0 AS phi_f_hour,
  round(base, 6) AS base FROM mf JOIN phi USING (a, b, c, e)"""


@query("m_shap", _SHAP_SQL)
def m_shap(spark, d):
    """Shapley values of a given logistic model's probability for every sample, against the first 50 samples, over all
    orders of its four features (SQL: from the mean prediction of every subset of features)."""
    m = fx.model_frame(spark, d).select("sample_id", *FEATS)

    def probability(v):
        z = sum((F.lit(_ATTR_W[c]) * x for c, x in zip(FEATS, v)), F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    s = shapley.shapley_values(m, FEATS, probability, m.orderBy("sample_id"))  # 50 background rows are the feature
    return s.select("sample_id", *[(r6(f"phi_{c}") + 0.0).alias(f"phi_{c}") for c in FEATS], r6("base").alias("base"))


def _spec():
    return federate.ChainSpec(features=FEATS, targets=TARGETS)


EPOCHS = 50


def _scheduled():
    """Presence flags as inputs; known labels are context at a rate of 1 - epoch / EPOCHS."""
    return federate.ChainSpec(features=FEATS, targets=TARGETS, flags=True, forcing=federate.falling(1.0, 1.0 / EPOCHS, EPOCHS))


@query("m_chain_fit")
def m_chain_fit(spark, d):
    """M5: per-node logistic chains with missing labels, all nodes trained by the same Spark passes, 50 epochs with a falling
    forcing rate; returns the long parameter table (rows-only; loss decrease is tested)."""
    tr, _ = _split(spark, d)
    model = federate.train_steps(tr, federate.init_model(tr, _scheduled()), steps=EPOCHS)
    return model.to_frame(spark)


CHAIN_STEP_SQL = S.with_(S.OBS, S.THR, S.LABELLED) + """
, mf AS (SELECT well_id, ts::DATE AS day, well_id % 10 AS node_id, [(well_id % 7) / 6.0, (dayofweek(ts::DATE) + 1) / 7.0, ln(1 + count(*)), min(hour(ts)) / 23.0] AS f,
         [max(CASE WHEN analyte = 'click' THEN y END), max(CASE WHEN analyte = 'error' THEN y END),
          max(CASE WHEN analyte = 'purchase' THEN y END), max(CASE WHEN analyte = 'signup' THEN y END)] AS y
         FROM labelled GROUP BY well_id, ts::DATE)
, link AS (SELECT node_id, k, y[k + 1] AS y, list_concat(f, list_concat(list_transform(y[1:k], lambda v: coalesce(v, 0.5)), [1.0])) AS x FROM mf, range(4) r(k))
, pw AS (SELECT node_id, k, least(count(CASE WHEN y = 0 THEN 1 END) / greatest(count(CASE WHEN y = 1 THEN 1 END), 1), 10.0) AS pw FROM link GROUP BY node_id, k)
, cells AS (SELECT node_id, count(y) AS n FROM link GROUP BY node_id)
, g AS (SELECT node_id, k, i AS param, coalesce(sum(CASE WHEN y = 1 THEN -0.5 * pw * x[i + 1] WHEN y = 0 THEN 0.5 * x[i + 1] END), 0) / any_value(n) AS g
        FROM link JOIN pw USING (node_id, k) JOIN cells USING (node_id), range(8) r(i) WHERE i < 5 + k GROUP BY node_id, k, i)
, s AS (SELECT node_id, least(1.0, 1 / (sqrt(sum(g * g)) + 1e-6)) AS s FROM g GROUP BY node_id)
SELECT node_id::BIGINT AS node_id, ['y_click', 'y_error', 'y_purchase', 'y_signup'][k + 1] AS analyte, param::BIGINT AS param, round(-0.5 * g * s, 6) + 0.0 AS v
FROM g JOIN s USING (node_id)"""


@query("m_chain_step", CHAIN_STEP_SQL)
def m_chain_step(spark, d):
    """M5: every node's chain parameters after one step from zero: masked, class-weighted gradients with known labels (else 0.5)
    as context, clipped by the node's norm."""
    frame = fx.model_frame(spark, d)
    model = federate.train_steps(frame, federate.init_model(frame, _spec()), steps=1)
    return model.to_frame(spark).withColumn("v", r6("v") + 0.0)


@query("m_central")
def m_central(spark, d):
    """The centralised control = the same chain job with one node, 50 epochs; test AUROC per analyte."""
    tr, te = _split(spark, d)
    tr, te = tr.withColumn("node_id", F.lit(0).cast("long")), te.withColumn("node_id", F.lit(0).cast("long"))
    model = federate.train_steps(tr, federate.init_model(tr, _scheduled()), steps=EPOCHS)
    pred = federate.score_chain(te, model, ["node_id"], use_known=False)
    return evaluate.ranking_metrics(pred, ["analyte"])


@query("m_table_step", CHAIN_STEP_SQL)
def m_table_step(spark, d):
    """M5 over tables: the same first step with the parameters as a table joined to blocks of rows."""
    blocks = rounds.pack_rows(fx.model_frame(spark, d), _spec())
    return rounds.step(blocks, rounds.zero_params(blocks)).select("node_id", "analyte", "param", (r6("v") + 0.0).alias("v"))


def _volume_tiers(rows):
    return network.size_tiers(rows.groupBy("node_id").agg(F.count(F.lit(1)).cast("double").alias("volume")))


@query("f_rounds")
def f_rounds(spark, d):
    """The log of six rounds of two local epochs, averaged every second round in the warm-up and by groups of alike nodes once
    parameters or gradients part (rows-only: iterative; its first step is `m_table_step`)."""
    tr, _ = _split(spark, d)
    _, log, _ = rounds.run_rounds(tr, _spec(), _volume_tiers(tr), rounds=6, epochs=2, every=2)
    return log


@query("p_context_forcing")
def p_context_forcing(spark, d):
    """P22 with a forcing rate: a seeded, recomputation-stable half of the known labels is used as
    chain context, the rest take the model score (rows-only; edge rates property-tested)."""
    from aquifer.operators import derive

    p = fx.predictions(spark, d).where(F.col("mode") == "global")
    ctx = derive.known_label_context(p, "y", "score", ratio=0.5, seed=42,
                                     keys=["l_orderkey", "l_linenumber", "analyte"])
    return p.select("l_orderkey", "l_linenumber", "analyte", "y", "score", ctx.alias("context"))


@query("u_predictive", S.with_(S.OBS) + """
, mf AS (SELECT well_id * 100000 + date_diff('day', DATE '2024-01-01', ts::DATE) AS sample_id, (well_id % 7) / 6.0 AS x0,
         (dayofweek(ts::DATE) + 1) / 7.0 AS x1, ln(1 + count(*)) AS x2, min(hour(ts)) / 23.0 AS x3
         FROM obs GROUP BY well_id, ts::DATE)
, z AS (SELECT d, j, sqrt(-2 * ln((('0x' || h[1:12])::BIGINT + 1) / (2::DOUBLE ** 48 + 1)))
         * cos(2 * pi() * ('0x' || h[13:24])::BIGINT / 2::DOUBLE ** 48) AS g
         FROM (SELECT d, j, md5(d::VARCHAR || '|' || j::VARCHAR) AS h FROM range(50) t(d), range(5) u(j)))
, w AS (SELECT d, max(CASE WHEN j = 0 THEN 0.5 + 0.1 * g END) AS w0, max(CASE WHEN j = 1 THEN -0.2 + 0.1 * g END) AS w1,
        max(CASE WHEN j = 2 THEN 0.1 + 0.1 * g END) AS w2, max(CASE WHEN j = 3 THEN 0.3 + 0.1 * g END) AS w3,
        max(CASE WHEN j = 4 THEN -1.0 + 0.2 * g END) AS w4 FROM z GROUP BY d)
, dr AS (SELECT sample_id, d, 1 / (1 + exp(-(w0 * x0 + w1 * x1 + w2 * x2 + w3 * x3 + w4))) AS p FROM mf, w)
SELECT sample_id, round(avg(p), 6) AS pred_mean, round(stddev_samp(p), 6) AS pred_std,
  round(greatest(0.0, least(1.0, avg(p) - 2 * stddev_samp(p))), 6) AS lower,
  round(greatest(0.0, least(1.0, avg(p) + 2 * stddev_samp(p))), 6) AS upper FROM dr GROUP BY sample_id""")
def u_predictive(spark, d):
    """Predictive mean, sample std and clipped 2-sigma band over 50 weight draws."""
    m = fx.model_frame(spark, d).select("sample_id", *FEATS)
    pm = federate.predictive_moments(m, FEATS, [0.5, -0.2, 0.1, 0.3, -1.0], [0.1, 0.1, 0.1, 0.1, 0.2], 50)
    b = evaluate.uncertainty_band(pm, "pred_mean", "pred_std")
    return b.select("sample_id", *[r6(c).alias(c) for c in ["pred_mean", "pred_std", "lower", "upper"]])


LAPLACE_SQL = S.with_(S.OBS, S.THR, S.LABELLED) + """
, mf AS (SELECT well_id, ts::DATE AS day, [(well_id % 7) / 6.0, (dayofweek(ts::DATE) + 1) / 7.0, ln(1 + count(*)), min(hour(ts)) / 23.0, 1.0] AS x,
         max(CASE WHEN analyte = 'click' THEN y END) AS y_click, max(CASE WHEN analyte = 'error' THEN y END) AS y_error,
         max(CASE WHEN analyte = 'purchase' THEN y END) AS y_purchase, max(CASE WHEN analyte = 'signup' THEN y END) AS y_signup
         FROM labelled GROUP BY well_id, ts::DATE)
, l AS (SELECT well_id, day, analyte, y, j, x[j + 1]::DOUBLE AS x FROM mf UNPIVOT (y FOR analyte IN (y_click, y_error, y_purchase, y_signup)), range(5) r(j))
, w AS (SELECT analyte, j, -sum((0.5 - y) * x) / (1 + sum(0.25 * x * x)) / 5 AS mu FROM l GROUP BY analyte, j)
, p AS (SELECT well_id, day, analyte, 1 / (1 + exp(-sum(mu * x))) AS p FROM l JOIN w USING (analyte, j) GROUP BY well_id, day, analyte)
SELECT analyte, ['f_well', 'f_dow', 'f_events', 'f_hour', 'bias'][j + 1] AS weight, round(any_value(mu), 6) AS mu,
  round(1 / sqrt(1 + sum(p * (1 - p) * x * x)), 6) AS sigma
FROM l JOIN p USING (well_id, day, analyte) JOIN w USING (analyte, j) GROUP BY analyte, j"""


@query("m_laplace", LAPLACE_SQL)
def m_laplace(spark, d):
    """M7: posterior mean and deviation of every analyte's link after one step from zero."""
    post = federate.fit_posteriors(fx.model_frame(spark, d), FEATS, TARGETS, steps=1)
    return post.select("analyte", "weight", r6("mu").alias("mu"), r6("sigma").alias("sigma"))


@query("u_posterior")
def u_posterior(spark, d):
    """Bands of the test rows over draws from the posterior fitted on the training rows (rows-only, property-tested)."""
    tr, te = _split(spark, d)
    fitted = federate.fit_posteriors(tr, FEATS, TARGETS, steps=50).collect()  # analytes x weights
    out = []
    for t in TARGETS:
        own = [r for r in fitted if r["analyte"] == t]
        pm = federate.predictive_moments(te.select("sample_id", *FEATS), FEATS, [r["mu"] for r in own], [r["sigma"] for r in own], 50)
        out.append(evaluate.uncertainty_band(pm, "pred_mean", "pred_std").select(
            "sample_id", F.lit(t).alias("analyte"), "pred_mean", "pred_std", "lower", "upper"))
    return functools.reduce(DataFrame.unionByName, out)


@query("m_personalize")
def m_personalize(spark, d):
    """M6: every node's personalised tail (purchase, signup) over the context of a global chain (click, error) trained for 10 epochs;
    tier 1 trains 15 epochs, tier 2 five small steps and a tenth of the way, tier 3 not at all (rows-only, property-tested)."""
    tr, _ = _split(spark, d)
    spec = federate.ChainSpec(features=FEATS, targets=["y_click", "y_error"])
    blocks = rounds.pack_rows(tr, spec)
    chain = rounds.train(blocks, rounds.zero_params(blocks), 10)
    return rounds.personalize(tr, chain, spec, ["y_purchase", "y_signup"], _volume_tiers(tr))


@query("m_modes")
def m_modes(spark, d):
    """M1/M4: independent models, global chain (click, error) and local chain (purchase, signup) side by side, 10 trees each
    (rows-only, tested against the single operators)."""
    tr, te = _split(spark, d)
    classes = spark.createDataFrame([("y_click", "A", 0), ("y_error", "A", 1), ("y_purchase", "B", 2), ("y_signup", "B", 3)], "analyte string, class string, ord int")
    return models.compare_modes(tr, te, FEATS, TARGETS[:2], TARGETS[2:], classes, max_iter=10)


@query("m_tree_grid")
def m_tree_grid(spark, d):
    """Configuration grid -- the boosted-tree baseline repeated per tree count (rows-only)."""
    from pyspark.ml.tuning import ParamGridBuilder

    tr, te = _split(spark, d)
    base = models.gbt()
    grid = ParamGridBuilder().addGrid(base.maxIter, [3, 6]).build()
    out = []
    for cfg in grid:
        iters = cfg[base.maxIter]
        m, _ = models.independent_gbt(tr, te, FEATS, TARGETS, max_iter=iters)
        out.append(m.withColumn("n_trees", F.lit(iters)))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def _partition_rows(spark, d, heavy):
    """FX3 with analytes of the chain and of the classes, admin columns and a local category."""
    e = fx.env_covariates(spark, d, with_texture=True).withColumn("PFOA", F.col("FE") / 10).withColumn("PFOS", F.col("MN") * 2) \
        .withColumn("PFBS", F.col("SO4") + 1).withColumn("PFNA", F.when(F.col("l_linenumber") > 1, F.col("NO3N"))) \
        .withColumn("node_tier", F.col("node_id") % 3 + 1).withColumn("cluster_id", F.col("node_id")) \
        .withColumn("season", F.concat(F.lit("q"), F.quarter("date").cast("string"))) \
        .withColumn("load", F.col("TDS") / F.col("FE")).drop("date", "node_id")
    return e if heavy else e.drop("heavy")


KEYS = ["l_orderkey", "l_linenumber"]


def _fitted_partition(spark, d, heavy):
    e = _partition_rows(spark, d, heavy)
    return e, partition.fit_partition(e.where(F.col("l_orderkey") % 5 != 0), KEYS)


@query("t_partition")
def t_partition(spark, d):
    """All five parts of every row, train and test, from the partition fitted on the training rows (rows-only: the quantile
    scaler of `heavy` has no SQL; `t_blocks` holds the same without that column)."""
    e, fitted = _fitted_partition(spark, d, heavy=True)
    return fitted.apply(e).withColumn("split", F.when(F.col("l_orderkey") % 5 != 0, "train").otherwise("test"))


_COLS = "TDS, FE, SO4, MN, NO3N, load"
_BLOCKS_SQL = S.with_(S.ENV) + f"""
, all_ AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS TDS, l_quantity AS FE, l_discount * 100 AS SO4, l_tax * 100 AS MN, p_size::DOUBLE AS NO3N,
           l_suppkey % 10 AS node_id, p_type AS tex, 'q' || quarter(l_shipdate) AS season, l_extendedprice / l_quantity AS load
           FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
, env_long AS (SELECT * FROM (SELECT {_COLS} FROM all_ WHERE l_orderkey % 5 <> 0) UNPIVOT (x FOR col IN ({_COLS})))""" + PROFILE_SQL + f"""
, qs AS (SELECT col, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM env_long GROUP BY col)
, plan AS (SELECT c.col, CASE WHEN scaler = 'standard' THEN mean ELSE q2 END AS center,
           CASE WHEN scaler = 'standard' THEN (CASE WHEN std > 0 THEN std ELSE 1.0 END) ELSE (CASE WHEN q3 <> q1 THEN q3 - q1 ELSE 1.0 END) END AS scale
           FROM choice c JOIN qs USING (col))
, num AS (SELECT * FROM (SELECT l_orderkey, l_linenumber, {_COLS} FROM all_) UNPIVOT INCLUDE NULLS (x FOR col IN ({_COLS})))
, seen AS (SELECT DISTINCT tex FROM all_ WHERE l_orderkey % 5 <> 0)
, seasons AS (SELECT DISTINCT season FROM all_ WHERE l_orderkey % 5 <> 0)
, y AS (SELECT * FROM (SELECT l_orderkey, l_linenumber, FE / 10 AS PFOA, MN * 2 AS PFOS, SO4 + 1 AS PFBS, CASE WHEN l_linenumber > 1 THEN NO3N END AS PFNA,
        (node_id % 3 + 1)::DOUBLE AS node_tier, node_id::DOUBLE AS cluster_id FROM all_)
        UNPIVOT INCLUDE NULLS (x FOR col IN (PFOA, PFOS, PFBS, PFNA, node_tier, cluster_id)))
SELECT l_orderkey, l_linenumber, CASE WHEN col = 'load' THEN 'X_loc' ELSE 'X_glob' END AS block, col AS feature, round((x - center) / scale, 6) + 0.0 AS value
  FROM num JOIN plan USING (col)
UNION ALL SELECT l_orderkey, l_linenumber, 'X_glob', 'Texture_USDA_' || coalesce(a.tex, 'nan'), 1.0 FROM all_ a JOIN seen s ON a.tex IS NOT DISTINCT FROM s.tex
UNION ALL SELECT l_orderkey, l_linenumber, 'X_loc', 'season_' || coalesce(a.season, 'nan'), 1.0 FROM all_ a JOIN seasons s ON a.season IS NOT DISTINCT FROM s.season
UNION ALL SELECT l_orderkey, l_linenumber, CASE WHEN col IN ('PFOA', 'PFOS') THEN 'Y_glob' WHEN col IN ('PFBS', 'PFNA') THEN 'Y_loc' ELSE 'geo' END, col, round(x, 6) + 0.0 FROM y"""


@query("t_blocks", _BLOCKS_SQL)
def t_blocks(spark, d):
    """X_glob, X_loc, Y_glob, Y_loc and geo of every row by name, train and test, from the fitted partition."""
    e, fitted = _fitted_partition(spark, d, heavy=False)
    return partition.long_blocks(fitted.apply(e), fitted).withColumn("value", r6("value") + 0.0)
