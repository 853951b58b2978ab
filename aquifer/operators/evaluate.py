"""Evaluation: exact tie-aware ranking metrics per group, prevalence, viability, summaries,
class-balance weights, masked loss, adaptive weights and uncertainty bands.

Ranking metrics collapse each group to its distinct scores first (pos/neg counts per score,
map-side combined), then use the skew-safe distributed prefix sum, so a (node, analyte) group
holding a third of all rows never sorts in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aquifer.functions import clamp, softplus
from aquifer.operators.stats import global_prefix, null_safe_join
from aquifer.session import cut_lineage


def score_table(pred: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """Distinct scores per group with positive/negative counts, strictly-below and strictly-above sums
    and the group totals P, N.

    The distinct-score table is materialised once; totals come from it (a small aggregate) and one
    prefix pass gives the below-sums, so the prefix is computed exactly once. Rows without a label or with a NULL or NaN score
    count nowhere."""
    lab = pred.where(F.col(y).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    st = cut_lineage(lab.groupBy(*keys, score).agg(
        F.count_if(F.col(y) == 1.0).alias("pos"), F.count_if(F.col(y) == 0.0).alias("neg")))
    tot = st.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    pre = global_prefix(st, keys, score, ["pos", "neg"], ["pos_below", "neg_below"])
    j = null_safe_join(pre, tot, keys)  # one row per group: AQE broadcasts it
    j = j.withColumn("tp_above", F.col("P") - F.col("pos_below") - F.col("pos")) \
        .withColumn("fp_above", F.col("N") - F.col("neg_below") - F.col("neg"))
    return j.drop("pos_below")


def ranking_metrics(pred: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """AUROC (mid-rank ties), average precision (no interpolation) and trapezoid ROC area
    per group; NULL unless both classes are present."""
    j = score_table(pred, keys, y, score)
    tp = F.col("tp_above") + F.col("pos")
    fp = F.col("fp_above") + F.col("neg")
    auc_term = F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)
    ap_term = F.when(F.col("pos") > 0, F.try_divide(F.col("pos"), F.col("P")) * tp / (tp + fp)).otherwise(F.lit(0.0))
    trap = F.try_divide(F.col("neg"), F.col("N")) * F.try_divide(F.col("tp_above") + tp, F.col("P")) / 2.0
    agg = j.groupBy(*keys, "P", "N").agg(F.sum(auc_term).alias("_auc"), F.sum(ap_term).alias("_ap"),
                                         F.sum(trap).alias("_trap"))
    ok = (F.col("P") > 0) & (F.col("N") > 0)
    return agg.select(
        *keys, F.col("P").alias("n_pos"), F.col("N").alias("n_neg"),
        F.when(ok, F.col("_auc") / (F.col("P") * F.col("N"))).alias("auroc"),
        F.when(ok, F.col("_ap")).alias("auprc"),
        F.when(ok, F.col("_trap")).alias("roc_area"),
    )


def roc_points(pred: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """ROC curve points (fpr, tpr) per distinct threshold, plus the (0, 0) origin per group."""
    j = score_table(pred, keys, y, score).where((F.col("P") > 0) & (F.col("N") > 0))
    pts = j.select(*keys, F.col(score).alias("threshold"),
                   ((F.col("fp_above") + F.col("neg")) / F.col("N")).alias("fpr"),
                   ((F.col("tp_above") + F.col("pos")) / F.col("P")).alias("tpr"))
    origin = pts.groupBy(*keys).agg(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
                                    F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def best_node(metrics: DataFrame, by: list[str], node: str = "node_id", metric: str = "auroc") -> DataFrame:
    """Per `by` group the node with the largest positive metric; ties -> smallest node id."""
    m = metrics.where(F.col(metric) > 0)
    best = m.groupBy(*by).agg(F.max_by(F.struct(F.col(metric), -F.col(node)), F.struct(F.col(metric), -F.col(node)))
                              .alias("_b"))
    return best.select(*by, (-F.col("_b.col2")).alias(node), F.col(f"_b.{metric}").alias(metric))


def prevalence(pred: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """Mean label per group (NULL labels ignored)."""
    return pred.groupBy(*keys).agg(F.avg(y).alias("prevalence"), F.count(y).alias("n_labelled"))


def pos_weight(pred: DataFrame, keys: list[str], y: str = "y", cap: float = 10.0, alpha: float = 1.0) -> DataFrame:
    """neg/pos (1.0 without positives) and the capped batch form min(neg/max(pos,1), cap)*alpha."""
    g = pred.groupBy(*keys).agg(F.count_if(F.col(y) == 1.0).alias("n_pos"), F.count_if(F.col(y) == 0.0).alias("n_neg"))
    pw = F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")).otherwise(F.lit(1.0))
    capped = F.least(F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1)), F.lit(cap)) * F.lit(alpha)
    return g.withColumn("pos_weight", pw).withColumn("pos_weight_capped", capped)


def masked_bce_terms(y: Column, z: Column, pw: Column) -> Column:
    """G13 cell loss: pw*y*softplus(-z) + (1-y)*softplus(z); NULL when the label is missing."""
    return pw * y * softplus(-z) + (1 - y) * softplus(z)


def masked_loss(pred: DataFrame, keys: list[str], logit: Column, pw: Column, y: str = "y") -> DataFrame:
    """Mean cell loss over labelled cells of all analytes per group; 0 when nothing is labelled."""
    cell = masked_bce_terms(F.col(y), logit, pw)
    return pred.groupBy(*keys).agg(F.coalesce(F.avg(cell), F.lit(0.0)).alias("loss"), F.count(y).alias("n_cells"))


def kl_to_standard_normal(params: DataFrame, keys: list[str], mu: str = "mu", logvar: str = "logvar") -> DataFrame:
    """KL(N(mu, e^lv) || N(0,1)) summed per group, lv clamped to [-10, 5]."""
    lv = clamp(F.col(logvar), -10.0, 5.0)
    term = 1 + lv - F.col(mu) * F.col(mu) - F.exp(lv)
    return params.groupBy(*keys).agg((-0.5 * F.sum(term)).alias("kl"))


def recall_alpha(pred: DataFrame, keys: list[str], prob: Column, y: str = "y", base: float = 1.0) -> DataFrame:
    """Recall at 0.5 and the adaptive loss factor (global and local rules)."""
    hit = F.col(y) * (prob > 0.5).cast("double")
    # recall is undefined without positives (NULL): the factor then stays unchanged
    g = pred.groupBy(*keys).agg(F.try_divide(F.sum(hit), F.sum(F.col(y))).alias("recall"))
    r = F.col("recall")
    glob = F.when(r < 0.5, base + 0.1).when(r > 0.8, F.greatest(F.lit(1.0), F.lit(base - 0.05))).otherwise(base)
    loc = F.when(r < 0.4, base + 0.1).otherwise(base)
    return g.withColumn("alpha_global", glob).withColumn("alpha_local", loc)


def auprc_alpha(analytes: DataFrame, metrics: DataFrame, key: str = "analyte", base: float = 1.0) -> DataFrame:
    """AUPRC-driven weight (missing metric -> 0.5, i.e. unchanged), clamped to [1, 10]."""
    j = analytes.join(metrics.select(key, "auprc"), key, "left")
    a = F.coalesce(F.col("auprc"), F.lit(0.5))
    new = F.when(a < 0.4, base + 0.2).when(a > 0.7, base - 0.1).otherwise(base)
    return j.select(key, F.col("auprc"), clamp(new, 1.0, 10.0).alias("alpha"))


def viability(pred: DataFrame, nodes: DataFrame, analytes: list[str], node: str = "node_id", y: str = "y",
              analyte: str = "analyte") -> DataFrame:
    """Per analyte, how many nodes are viable / have no rows / all-missing labels / one class.

    nodes x analytes comes from exploding the (bounded) analyte catalog on the node table."""
    grid = nodes.select(node).distinct().withColumn(analyte, F.explode(F.array(*[F.lit(a) for a in analytes])))
    has_rows = pred.select(node).distinct().withColumn("_rows", F.lit(True))
    stats = pred.groupBy(node, analyte).agg(F.count(y).alias("_lab"), F.countDistinct(y).alias("_cls"))
    j = grid.join(has_rows, node, "left").join(stats, [node, analyte], "left")
    cat = (F.when(F.col("_rows").isNull(), "no_rows").when(F.coalesce(F.col("_lab"), F.lit(0)) == 0, "all_missing")
           .when(F.col("_cls") < 2, "one_class").otherwise("viable"))
    cats = ["viable", "no_rows", "all_missing", "one_class"]
    return j.withColumn("_cat", cat).groupBy(analyte).pivot("_cat", cats).count().na.fill(0, cats)


def summary_by_class(metrics: DataFrame, analyte_dim: DataFrame, key: str = "analyte", mode: str = "mode") -> DataFrame:
    """Per class and analyte the mean AUROC/AUPRC per mode, lifts and node count max(nG, nP)."""
    g = metrics.where(F.col("auroc").isNotNull()).groupBy(key).pivot(mode, ["global", "personalized"]).agg(
        F.avg("auroc").alias("auroc"), F.avg("auprc").alias("auprc"), F.count("auroc").alias("n"))
    j = g.join(analyte_dim, key, "left")
    return j.select(
        "class", key,
        F.col("global_auroc").alias("g_auroc"), F.col("personalized_auroc").alias("p_auroc"),
        (F.col("personalized_auroc") - F.col("global_auroc")).alias("auroc_lift"),
        F.col("global_auprc").alias("g_auprc"), F.col("personalized_auprc").alias("p_auprc"),
        (F.col("personalized_auprc") - F.col("global_auprc")).alias("auprc_lift"),
        F.greatest(F.coalesce(F.col("global_n"), F.lit(0)), F.coalesce(F.col("personalized_n"), F.lit(0))).alias(
            "n_nodes"),
    )


def uncertainty_band(df: DataFrame, mean: str = "mean", std: str = "std", k: float = 2.0) -> DataFrame:
    """Mean +/- k*std clipped to [0, 1]."""
    return df.withColumn("lower", clamp(F.col(mean) - k * F.col(std), 0.0, 1.0)).withColumn(
        "upper", clamp(F.col(mean) + k * F.col(std), 0.0, 1.0))


def format_report(summary: DataFrame) -> DataFrame:
    """Report strings of the class summary -- 4-decimal metrics, signed lifts, '—' when absent."""
    def fmt(c, signed=False):
        f = "%+.4f" if signed else "%.4f"
        return F.coalesce(F.format_string(f, F.col(c)), F.lit("—"))

    return summary.select(
        "class", "analyte", fmt("g_auroc").alias("G_AUROC"), fmt("p_auroc").alias("P_AUROC"),
        fmt("auroc_lift", True).alias("AUROC_Lift"), fmt("g_auprc").alias("G_AUPRC"), fmt("p_auprc").alias("P_AUPRC"),
        fmt("auprc_lift", True).alias("AUPRC_Lift"), F.col("n_nodes").alias("N_Nodes"))
