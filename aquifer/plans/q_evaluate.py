"""Stage 4 queries: ranking metrics, prevalence, viability, summaries, loss terms (W2-W5, G7, G12-G18,
G21-G23, M2, M12, P18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquifer.functions import r6, sigmoid
from aquifer.operators import derive, evaluate
from aquifer.plans import sql as S
from aquifer.plans.registry import query
from aquifer.sources import fixtures as fx

K3 = ["mode", "node_id", "analyte"]
FX6_AN = ["A0", "A1", "A2", "A3"]

ST_SQL = """
, st AS (SELECT mode, node_id, analyte, score, count(CASE WHEN y = 1 THEN 1 END) AS pos,
         count(CASE WHEN y = 0 THEN 1 END) AS neg FROM pred WHERE y IS NOT NULL AND score IS NOT NULL
         GROUP BY mode, node_id, analyte, score)
, st2 AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY mode, node_id, analyte ORDER BY score
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
         coalesce(sum(pos) OVER (PARTITION BY mode, node_id, analyte ORDER BY score DESC
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tp_above,
         coalesce(sum(neg) OVER (PARTITION BY mode, node_id, analyte ORDER BY score DESC
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fp_above FROM st)
, tot AS (SELECT mode, node_id, analyte, sum(pos) AS P, sum(neg) AS N FROM st GROUP BY mode, node_id, analyte)
, met AS (SELECT s.mode, s.node_id, s.analyte, any_value(P)::BIGINT AS n_pos, any_value(N)::BIGINT AS n_neg,
         CASE WHEN any_value(P) > 0 AND any_value(N) > 0 THEN
           sum(pos * (neg_below + neg / 2.0)) / (any_value(P) * any_value(N)) END AS auroc,
         CASE WHEN any_value(P) > 0 AND any_value(N) > 0 THEN
           sum(CASE WHEN pos > 0 THEN pos / P * (tp_above + pos) / (tp_above + pos + fp_above + neg) ELSE 0 END) END
           AS auprc,
         CASE WHEN any_value(P) > 0 AND any_value(N) > 0 THEN
           sum(neg / N * ((tp_above + tp_above + pos) / P) / 2.0) END AS roc_area
         FROM st2 s JOIN tot t USING (mode, node_id, analyte) GROUP BY s.mode, s.node_id, s.analyte)
"""


def _metrics(spark, d):
    return evaluate.ranking_metrics(fx.predictions(spark, d), K3)


@query("e_auroc", S.with_(S.PRED) + ST_SQL + """
SELECT mode, node_id, analyte, n_pos, n_neg, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc,
       round(roc_area, 6) AS roc_area FROM met""")
def e_auroc(spark, d):
    """Exact AUROC, average precision and trapezoid ROC area per (mode, node, analyte)."""
    m = _metrics(spark, d)
    return m.select(*K3, "n_pos", "n_neg", r6("auroc").alias("auroc"), r6("auprc").alias("auprc"),
                    r6("roc_area").alias("roc_area"))


@query("e_roc_points", S.with_(S.PRED) + ST_SQL + """
SELECT s.mode, s.node_id, s.analyte, score AS threshold, round((fp_above + neg) / N, 6) AS fpr,
       round((tp_above + pos) / P, 6) AS tpr FROM st2 s JOIN tot USING (mode, node_id, analyte) WHERE P > 0 AND N > 0
UNION ALL SELECT mode, node_id, analyte, NULL, 0.0, 0.0 FROM tot WHERE P > 0 AND N > 0""")
def e_roc_points(spark, d):
    p = evaluate.roc_points(fx.predictions(spark, d), K3)
    return p.select(*K3, "threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query("e_best_node", S.with_(S.PRED) + ST_SQL + """
SELECT analyte, node_id, round(auroc, 6) AS auroc FROM met WHERE mode = 'global' AND auroc > 0
QUALIFY row_number() OVER (PARTITION BY analyte ORDER BY auroc DESC, node_id) = 1""")
def e_best_node(spark, d):
    m = _metrics(spark, d).where(F.col("mode") == "global")
    b = evaluate.best_node(m, ["analyte"])
    return b.select("analyte", "node_id", r6("auroc").alias("auroc"))


@query("e_prevalence", S.with_(S.PRED) + """
SELECT analyte, round(avg(prev), 6) AS mean_prevalence, count(*) AS n_nodes FROM (
  SELECT node_id, analyte, avg(y) AS prev FROM pred WHERE mode = 'global' GROUP BY node_id, analyte
  HAVING count(y) > 0) GROUP BY analyte""")
def e_prevalence(spark, d):
    """Prevalence per (node, analyte), averaged over nodes that have labels."""
    p = fx.predictions(spark, d).where(F.col("mode") == "global")
    per = evaluate.prevalence(p, ["node_id", "analyte"]).where(F.col("n_labelled") > 0)
    return per.groupBy("analyte").agg(r6(F.avg("prevalence")).alias("mean_prevalence"),
                                      F.count(F.lit(1)).alias("n_nodes"))


@query("g_pos_weight", S.with_(S.PRED) + """
SELECT node_id, analyte, count(CASE WHEN y = 1 THEN 1 END) AS n_pos, count(CASE WHEN y = 0 THEN 1 END) AS n_neg,
  round(CASE WHEN count(CASE WHEN y = 1 THEN 1 END) > 0 THEN count(CASE WHEN y = 0 THEN 1 END)
        / count(CASE WHEN y = 1 THEN 1 END) ELSE 1.0 END, 6) AS pos_weight,
  round(least(count(CASE WHEN y = 0 THEN 1 END) / greatest(count(CASE WHEN y = 1 THEN 1 END), 1), 10.0), 6)
    AS pos_weight_capped
FROM pred WHERE mode = 'global' GROUP BY node_id, analyte""")
def g_pos_weight(spark, d):
    p = fx.predictions(spark, d).where(F.col("mode") == "global")
    w = evaluate.pos_weight(p, ["node_id", "analyte"], cap=10.0)
    return w.select("node_id", "analyte", "n_pos", "n_neg", r6("pos_weight").alias("pos_weight"),
                    r6("pos_weight_capped").alias("pos_weight_capped"))


def _logit(c="score"):
    return (F.col(c) - 0.05) * 40.0


@query("m_masked_loss", S.with_(S.PRED) + """
, pw AS (SELECT node_id, analyte, least(count(CASE WHEN y = 0 THEN 1 END) / greatest(count(CASE WHEN y = 1 THEN 1 END), 1),
         10.0) AS w FROM pred WHERE mode = 'global' GROUP BY node_id, analyte)
, cell AS (SELECT p.node_id, y, (score - 0.05) * 40.0 AS z, w FROM pred p JOIN pw USING (node_id, analyte)
           WHERE mode = 'global')
SELECT node_id, round(coalesce(avg(w * y * (greatest(-z, 0) + ln(1 + exp(-abs(z))))
   + (1 - y) * (greatest(z, 0) + ln(1 + exp(-abs(z))))), 0.0), 6) AS loss, count(y) AS n_cells
FROM cell GROUP BY node_id""")
def m_masked_loss(spark, d):
    """Masked, positive-weighted BCE averaged over labelled cells of all analytes per node."""
    p = fx.predictions(spark, d).where(F.col("mode") == "global")
    pw = evaluate.pos_weight(p, ["node_id", "analyte"], cap=10.0).select("node_id", "analyte", "pos_weight_capped")
    j = p.join(pw, ["node_id", "analyte"])  # pw is bounded by nodes x analytes: AQE broadcasts it
    m = evaluate.masked_loss(j, ["node_id"], _logit(), F.col("pos_weight_capped"))
    return m.select("node_id", r6("loss").alias("loss"), "n_cells")


@query("m_recall_alpha", S.with_(S.PRED) + """
SELECT analyte, round(sum(y * ((1 / (1 + exp(-((score - 0.05) * 40.0)))) > 0.5)::INT) / sum(y), 6) AS recall,
  CASE WHEN sum(y * ((1 / (1 + exp(-((score - 0.05) * 40.0)))) > 0.5)::INT) / sum(y) < 0.5 THEN 1.1
       WHEN sum(y * ((1 / (1 + exp(-((score - 0.05) * 40.0)))) > 0.5)::INT) / sum(y) > 0.8 THEN 1.0 ELSE 1.0 END
       AS alpha_global,
  CASE WHEN sum(y * ((1 / (1 + exp(-((score - 0.05) * 40.0)))) > 0.5)::INT) / sum(y) < 0.4 THEN 1.1 ELSE 1.0 END
       AS alpha_local
FROM pred WHERE mode = 'global' GROUP BY analyte""")
def m_recall_alpha(spark, d):
    """Recall at 0.5 per analyte and the adaptive factor."""
    p = fx.predictions(spark, d).where(F.col("mode") == "global")
    r = evaluate.recall_alpha(p, ["analyte"], sigmoid(_logit()))
    return r.select("analyte", r6("recall").alias("recall"), r6("alpha_global").alias("alpha_global"),
                    r6("alpha_local").alias("alpha_local"))


@query("m_alpha", S.with_(S.PRED) + ST_SQL + """
, ma AS (SELECT analyte, avg(auprc) AS auprc FROM met WHERE mode = 'global' GROUP BY analyte)
, an AS (SELECT * FROM (VALUES ('A0'), ('A1'), ('A2'), ('A3'), ('A4')) t(analyte))
SELECT analyte, round(auprc, 6) AS auprc, CASE WHEN coalesce(auprc, 0.5) < 0.4 THEN 1.2
   WHEN coalesce(auprc, 0.5) > 0.7 THEN 1.0 ELSE 1.0 END AS alpha FROM an LEFT JOIN ma USING (analyte)""")
def m_alpha(spark, d):
    """AUPRC-driven per-analyte weights (A4 has no metric -> unchanged)."""
    m = _metrics(spark, d).where(F.col("mode") == "global").groupBy("analyte").agg(F.avg("auprc").alias("auprc"))
    an = spark.createDataFrame([(a,) for a in FX6_AN + ["A4"]], "analyte string")
    a = evaluate.auprc_alpha(an, m)
    return a.select("analyte", r6("auprc").alias("auprc"), r6("alpha").alias("alpha"))


@query("e_viability", S.with_(S.PRED) + """
, nodes AS (SELECT DISTINCT s_suppkey % 11 AS node_id FROM supplier)
, grid AS (SELECT node_id, analyte FROM nodes, (VALUES ('A0'), ('A1'), ('A2'), ('A3')) t(analyte))
, hr AS (SELECT DISTINCT node_id FROM pred)
, stt AS (SELECT node_id, analyte, count(y) AS lab, count(DISTINCT y) AS cls FROM pred GROUP BY node_id, analyte)
, cat AS (SELECT g.analyte, CASE WHEN hr.node_id IS NULL THEN 'no_rows' WHEN coalesce(lab, 0) = 0 THEN 'all_missing'
          WHEN cls < 2 THEN 'one_class' ELSE 'viable' END AS c FROM grid g LEFT JOIN hr USING (node_id)
          LEFT JOIN stt USING (node_id, analyte))
SELECT analyte, count(CASE WHEN c = 'viable' THEN 1 END) AS viable, count(CASE WHEN c = 'no_rows' THEN 1 END) AS no_rows,
  count(CASE WHEN c = 'all_missing' THEN 1 END) AS all_missing, count(CASE WHEN c = 'one_class' THEN 1 END) AS one_class
FROM cat GROUP BY analyte""")
def e_viability(spark, d):
    """Node viability breakdown per analyte."""
    return evaluate.viability(fx.predictions(spark, d), fx.eval_nodes(spark, d), FX6_AN)


LOCAL_CHAIN_SQL = """
, lc AS (SELECT node_id, analyte FROM pred WHERE mode = 'global' GROUP BY node_id, analyte
         HAVING count(y) / count(*) >= 0.003 AND count(CASE WHEN y = 1 THEN 1 END) >= 3)
, pm AS (SELECT mode, node_id, analyte, count(*) AS nv FROM pred WHERE y IS NOT NULL AND score IS NOT NULL
         GROUP BY mode, node_id, analyte)
, eall AS (SELECT m.* FROM met m JOIN pm USING (mode, node_id, analyte) LEFT JOIN lc USING (node_id, analyte)
           WHERE m.auroc IS NOT NULL AND (m.mode = 'global' OR (lc.analyte IS NOT NULL AND nv >= 2)))
"""


def _e_all(spark, d):
    """Global metrics where both classes exist; personalized also needs the analyte in the node's
    local chain (G7 rule on the node's labels) and >= 2 valid rows."""
    p = fx.predictions(spark, d)
    m = evaluate.ranking_metrics(p, K3)
    g = p.where(F.col("mode") == "global")
    lc = g.groupBy("node_id", "analyte").agg(
        (F.count("y") / F.count(F.lit(1))).alias("ratio"), F.count_if(F.col("y") == 1.0).alias("det")).where(
        (F.col("ratio") >= 0.003) & (F.col("det") >= 3)).select("node_id", "analyte", F.lit(True).alias("in_chain"))
    m = m.join(lc, ["node_id", "analyte"], "left")
    keep = F.col("auroc").isNotNull() & ((F.col("mode") == "global") | (
        F.col("in_chain") & ((F.col("n_pos") + F.col("n_neg")) >= 2)))
    return m.where(keep).drop("in_chain")


@query("e_all", S.with_(S.PRED) + ST_SQL + LOCAL_CHAIN_SQL + """
SELECT mode, node_id, analyte, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM eall""")
def e_all(spark, d):
    m = _e_all(spark, d)
    return m.select(*K3, r6("auroc").alias("auroc"), r6("auprc").alias("auprc"))


@query("e_summary", S.with_(S.PRED) + ST_SQL + LOCAL_CHAIN_SQL + """
, dim AS (SELECT * FROM (VALUES ('A0', 'A'), ('A1', 'A'), ('A2', 'B'), ('A3', 'C')) t(analyte, class))
, g AS (SELECT analyte, avg(auroc) AS ga, avg(auprc) AS gp, count(*) AS gn FROM eall WHERE mode = 'global' GROUP BY analyte)
, p AS (SELECT analyte, avg(auroc) AS pa, avg(auprc) AS pp, count(*) AS pn FROM eall WHERE mode = 'personalized'
        GROUP BY analyte)
SELECT class, analyte, round(ga, 6) AS g_auroc, round(pa, 6) AS p_auroc, round(pa - ga, 6) AS auroc_lift,
  round(gp, 6) AS g_auprc, round(pp, 6) AS p_auprc, round(pp - gp, 6) AS auprc_lift,
  greatest(coalesce(gn, 0), coalesce(pn, 0)) AS n_nodes
FROM g FULL JOIN p USING (analyte) LEFT JOIN dim USING (analyte)""")
def e_summary(spark, d):
    """Per class/analyte summary of node metrics by mode."""
    s = evaluate.summary_by_class(_e_all(spark, d), fx.fx6_analytes(spark))
    rc = ["g_auroc", "p_auroc", "auroc_lift", "g_auprc", "p_auprc", "auprc_lift"]
    return s.select("class", "analyte", *[r6(c).alias(c) for c in rc], "n_nodes")


@query("e_compare", S.with_(S.PRED) + ST_SQL + """
, dim AS (SELECT * FROM (VALUES ('A0', 'A', 0), ('A1', 'A', 1), ('A2', 'B', 2), ('A3', 'C', 3), ('A4', 'C', 4))
          t(analyte, class, ord))
, g AS (SELECT analyte, avg(auroc) AS a FROM met WHERE mode = 'global' AND auroc IS NOT NULL GROUP BY analyte)
, p AS (SELECT analyte, avg(auroc) AS a FROM met WHERE mode = 'personalized' AND auroc IS NOT NULL GROUP BY analyte)
SELECT dim.analyte, class, ord, round(g.a, 6) AS global_auroc, round(p.a, 6) AS personalized_auroc,
  CASE WHEN g.a IS NULL AND p.a IS NULL THEN NULL WHEN p.a > g.a THEN 'personalized' ELSE 'global' END AS best_mode
FROM dim LEFT JOIN g USING (analyte) LEFT JOIN p USING (analyte)""")
def e_compare(spark, d):
    """Mode comparison table over the analyte dimension (analytes without metrics kept)."""
    m = _metrics(spark, d).where(F.col("auroc").isNotNull())
    pv = m.groupBy("analyte").pivot("mode", ["global", "personalized"]).agg(F.avg("auroc"))
    dim = spark.createDataFrame([("A0", "A", 0), ("A1", "A", 1), ("A2", "B", 2), ("A3", "C", 3), ("A4", "C", 4)],
                                "analyte string, class string, ord int")
    j = dim.join(pv, "analyte", "left")
    best = F.when(F.col("global").isNull() & F.col("personalized").isNull(), F.lit(None).cast("string")).when(
        F.col("personalized") > F.col("global"), "personalized").otherwise("global")
    return j.select("analyte", "class", "ord", r6("global").alias("global_auroc"),
                    r6("personalized").alias("personalized_auroc"), best.alias("best_mode"))


@query("e_pooled_roc", S.with_(S.PRED) + """
, viable AS (SELECT node_id, analyte FROM pred WHERE mode = 'global' GROUP BY node_id, analyte
             HAVING count(DISTINCT y) = 2)
, pooled AS (SELECT p.* FROM pred p JOIN viable USING (node_id, analyte))
, st AS (SELECT mode, analyte, score, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg
         FROM pooled WHERE y IS NOT NULL GROUP BY mode, analyte, score)
, st2 AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY mode, analyte ORDER BY score
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM st)
SELECT mode, analyte, round(sum(pos * (nb + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auroc
FROM st2 GROUP BY mode, analyte""")
def e_pooled_roc(spark, d):
    """Predictions pooled over the viable nodes of each analyte."""
    p = fx.predictions(spark, d)
    viable = p.where(F.col("mode") == "global").groupBy("node_id", "analyte").agg(
        F.countDistinct("y").alias("k")).where(F.col("k") == 2).drop("k")
    pooled = p.join(viable, ["node_id", "analyte"], "left_semi")
    m = evaluate.ranking_metrics(pooled, ["mode", "analyte"])
    return m.select("mode", "analyte", r6("auroc").alias("auroc"))


@query("m_guard", S.with_(S.PRED) + """
SELECT analyte, count(y) AS n_labelled, count(DISTINCT y) AS n_classes, count(y) >= 10 AND count(DISTINCT y) = 2
  AS trainable FROM pred WHERE mode = 'global' GROUP BY analyte""")
def m_guard(spark, d):
    """M2: per-analyte training guard (>= 10 labelled rows and both classes)."""
    p = fx.predictions(spark, d).where(F.col("mode") == "global")
    g = p.groupBy("analyte").agg(F.count("y").alias("n_labelled"), F.countDistinct("y").alias("n_classes"))
    return g.withColumn("trainable", (F.col("n_labelled") >= 10) & (F.col("n_classes") == 2))


@query("u_band", S.with_(S.PRED) + """
SELECT node_id, analyte, round(avg(score * 10), 6) AS mean, round(stddev_samp(score * 10), 6) AS std,
  round(greatest(0.0, least(1.0, avg(score * 10) - 2 * stddev_samp(score * 10))), 6) AS lower,
  round(greatest(0.0, least(1.0, avg(score * 10) + 2 * stddev_samp(score * 10))), 6) AS upper
FROM pred WHERE mode = 'personalized' GROUP BY node_id, analyte""")
def u_band(spark, d):
    """+/-2 sigma band clipped to [0, 1] of the per-group score distribution."""
    p = fx.predictions(spark, d).where(F.col("mode") == "personalized")
    g = p.groupBy("node_id", "analyte").agg(F.avg(F.col("score") * 10).alias("mean"),
                                            F.stddev_samp(F.col("score") * 10).alias("std"))
    b = evaluate.uncertainty_band(g)
    return b.select("node_id", "analyte", *[r6(c).alias(c) for c in ["mean", "std", "lower", "upper"]])


@query("g_local_chain", S.with_(S.OBS, S.THR, S.LABELLED) + """
, tot AS (SELECT well_id % 10 AS node_id, count(DISTINCT sample_id) AS n FROM labelled GROUP BY well_id % 10)
SELECT l.well_id % 10 AS node_id, analyte, round(count(y) / any_value(n), 6) AS tested_ratio,
  count(CASE WHEN y = 1 THEN 1 END) AS detections FROM labelled l JOIN tot ON l.well_id % 10 = tot.node_id
GROUP BY l.well_id % 10, analyte HAVING count(y) / any_value(n) >= 0.003 AND count(CASE WHEN y = 1 THEN 1 END) >= 3""")
def g_local_chain(spark, d):
    """Personalised analytes per node: tested share >= 0.003 and >= 3 detections."""
    lab = derive.label_exceedance(fx.obs_long(spark, d), fx.fx_thresholds(spark)).withColumn(
        "node_id", F.col("well_id") % 10)
    tot = lab.groupBy("node_id").agg(F.countDistinct("sample_id").alias("n"))
    g = lab.groupBy("node_id", "analyte").agg(F.count("y").alias("t"), F.count_if(F.col("y") == 1.0).alias("detections"))
    j = g.join(tot, "node_id").withColumn("tested_ratio", F.col("t") / F.col("n"))
    j = j.where((F.col("tested_ratio") >= 0.003) & (F.col("detections") >= 3))
    return j.select("node_id", "analyte", r6("tested_ratio").alias("tested_ratio"), "detections")


@query("e_report", S.with_(S.PRED) + ST_SQL + LOCAL_CHAIN_SQL + """
, dim AS (SELECT * FROM (VALUES ('A0', 'A'), ('A1', 'A'), ('A2', 'B'), ('A3', 'C')) t(analyte, class))
, g AS (SELECT analyte, avg(auroc) AS ga, avg(auprc) AS gp, count(*) AS gn FROM eall WHERE mode = 'global' GROUP BY analyte)
, p AS (SELECT analyte, avg(auroc) AS pa, avg(auprc) AS pp, count(*) AS pn FROM eall WHERE mode = 'personalized'
        GROUP BY analyte)
SELECT class, analyte, coalesce(printf('%.4f', ga), '—') AS G_AUROC, coalesce(printf('%.4f', pa), '—') AS P_AUROC,
  coalesce(printf('%+.4f', pa - ga), '—') AS AUROC_Lift, coalesce(printf('%.4f', gp), '—') AS G_AUPRC,
  coalesce(printf('%.4f', pp), '—') AS P_AUPRC, coalesce(printf('%+.4f', pp - gp), '—') AS AUPRC_Lift,
  greatest(coalesce(gn, 0), coalesce(pn, 0)) AS N_Nodes
FROM g FULL JOIN p USING (analyte) LEFT JOIN dim USING (analyte)""")
def e_report(spark, d):
    """The per-class summary formatted as report strings (rows-only: display formatting)."""
    return evaluate.format_report(evaluate.summary_by_class(_e_all(spark, d), fx.fx6_analytes(spark)))
