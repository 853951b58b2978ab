"""Supervised baselines with spark.ml: guarded per-analyte boosted trees, classifier chains,
descriptor-conditioned pooled logistic model, logistic attributions.

Fits are distributed by spark.ml; the driver only loops over the (bounded) analyte chain.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Interaction, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquifer.operators import evaluate


def _with_weights(df: DataFrame, y: str) -> DataFrame:
    """Class-balance weight neg/pos on positives (1.0 on negatives), as a sample weight column."""
    c = df.agg(F.count_if(F.col(y) == 1.0).alias("p"), F.count_if(F.col(y) == 0.0).alias("n")).first()
    pw = (c["n"] / c["p"]) if c["p"] else 1.0
    return df.withColumn("_w", F.when(F.col(y) == 1.0, F.lit(float(pw))).otherwise(F.lit(1.0)))


def gbt(max_iter: int = 10, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxDepth=4, stepSize=0.05,
                         subsamplingRate=0.8, featureSubsetStrategy="0.8", maxIter=max_iter, seed=seed)


def fill_medians(train: DataFrame, test: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Missing features take the train median (0 for a column without values) on both sides."""
    medians = train.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), 0.5, 100000).alias(c) for c in features]).first()
    filled = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(medians[c] or 0.0))).alias(c) for c in features]

    def fill(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c) for c in df.columns if c not in features], *filled)

    return fill(train), fill(test)


def independent_gbt(train: DataFrame, test: DataFrame, features: list[str], targets: list[str],
                    max_iter: int = 10, min_labelled: int = 10):
    """M1/M3: one boosted-tree model per target; skipped with < min_labelled rows or one class.
    Returns (metrics DataFrame rows, feature-importance rows)."""
    spark = train.sparkSession
    train, test = fill_medians(train, test, features)
    va = VectorAssembler(inputCols=features, outputCol="_x")
    metrics, imps = [], []
    for t in targets:
        tr = train.where(F.col(t).isNotNull()).withColumn("_y", F.col(t))
        te = test.where(F.col(t).isNotNull()).withColumn("_y", F.col(t))
        g = tr.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_y").alias("k")).first()
        if g["n"] < min_labelled or g["k"] < 2:
            continue
        model = gbt(max_iter).fit(va.transform(_with_weights(tr, "_y")))
        pred = model.transform(va.transform(te)).select(F.lit(t).alias("analyte"), F.col("_y").alias("y"),
                                                        vector_to_array("probability")[1].alias("score"))
        m = evaluate.ranking_metrics(pred, ["analyte"]).first()  # None: no labelled test row
        pos_rate = te.agg(F.avg("_y")).first()[0]
        metrics.append((t, m and m["auroc"], m and m["auprc"], int(g["n"]), int(te.count()), pos_rate))
        imps += [(t, f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    mdf = spark.createDataFrame(metrics, "analyte string, auroc double, auprc double, n_train long, n_test long, "
                                         "pos_rate double")
    idf = spark.createDataFrame(imps, "analyte string, feature string, importance double")
    return mdf, idf


def chain_gbt(train: DataFrame, test: DataFrame, features: list[str], chain: list[str], max_iter: int = 10,
              min_labelled: int = 10, key: str = "sample_id") -> DataFrame:
    """M4: classifier chain -- each link's predicted probability is appended as a feature of the next
    link (a skipped link contributes a constant 0 column). Returns per-link test metrics."""
    spark = train.sparkSession
    train, test = fill_medians(train, test, features)
    feats = list(features)
    out = []
    for t in chain:
        va = VectorAssembler(inputCols=feats, outputCol="_x")
        tr = train.where(F.col(t).isNotNull()).withColumn("_y", F.col(t))
        g = tr.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_y").alias("k")).first()
        col = f"p_{t}"
        if g["n"] < min_labelled or g["k"] < 2:
            train, test = train.withColumn(col, F.lit(0.0)), test.withColumn(col, F.lit(0.0))
        else:
            model = gbt(max_iter).fit(va.transform(_with_weights(tr, "_y")))
            prob = vector_to_array("probability")[1]
            train = model.transform(va.transform(train)).withColumn(col, prob).drop("_x", "rawPrediction",
                                                                                   "probability", "prediction")
            test = model.transform(va.transform(test)).withColumn(col, prob).drop("_x", "rawPrediction",
                                                                                 "probability", "prediction")
            from aquifer.session import cut_lineage

            train, test = cut_lineage(train), cut_lineage(test)  # chain lineage grows per link
            pred = test.where(F.col(t).isNotNull()).select(F.lit(t).alias("analyte"), F.col(t).alias("y"),
                                                           F.col(col).alias("score"))
            m = evaluate.ranking_metrics(pred, ["analyte"]).first()
            if m is not None:
                out.append((t, len(feats), m["auroc"], m["auprc"]))
        feats.append(col)
    return spark.createDataFrame(out, "analyte string, n_features int, auroc double, auprc double")


def compare_modes(train: DataFrame, test: DataFrame, features: list[str], global_chain: list[str], local_chain: list[str],
                  classes: DataFrame, local_features: list[str] | None = None, max_iter: int = 100) -> DataFrame:
    """M1/M4: a row for each analyte of `classes` (analyte, class, ord): test AUROC and AUPRC of its independent model and of its link
    in the global or the local chain, the best mode by AUROC (ties: in that order) and the rows the independent model learnt from.
    An analyte without a model, or without both classes in the test rows, has nulls."""
    alone, _ = independent_gbt(train, test, features, [*global_chain, *local_chain], max_iter)
    chains = {"global_chain": chain_gbt(train, test, features, global_chain, max_iter),
              "local_chain": chain_gbt(train, test, local_features or features, local_chain, max_iter)}
    out = classes.select("analyte", "class", "ord").join(alone.select(
        "analyte", F.col("auroc").alias("independent_auroc"), F.col("auprc").alias("independent_auprc"), "n_train"), "analyte", "left")
    for mode, m in chains.items():
        out = out.join(m.select("analyte", F.col("auroc").alias(f"{mode}_auroc"), F.col("auprc").alias(f"{mode}_auprc")), "analyte", "left")
    modes = ["independent", *chains]
    top = F.greatest(*[F.col(f"{m}_auroc") for m in modes])  # nulls are passed over
    return out.withColumn("best_mode", F.coalesce(*[F.when(F.col(f"{m}_auroc") == top, F.lit(m)) for m in modes]))


def descriptor_rows(long: DataFrame, descriptors: DataFrame, analyte: str = "analyte") -> DataFrame:
    """M8 input: long (sample x analyte) rows joined to descriptors; missing analyte -> zero row."""
    j = long.join(F.broadcast(descriptors), analyte, "left")
    return j.select(*long.columns, *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
                                     for c in ["is_pfca", "is_pfsa", "chain_len", "ether"]])


def pooled_descriptor_model(train_long: DataFrame, test_long: DataFrame, features: list[str], y: str = "y"):
    """M8: one pooled logistic model where descriptors modulate the environmental features
    (Interaction of env x descriptor vectors), class-balanced; returns test predictions."""
    env = VectorAssembler(inputCols=features, outputCol="_env")
    desc = VectorAssembler(inputCols=["is_pfca", "is_pfsa", "chain_len", "ether"], outputCol="_desc")
    inter = Interaction(inputCols=["_env", "_desc"], outputCol="_int")
    allf = VectorAssembler(inputCols=["_env", "_desc", "_int"], outputCol="_x")

    def prep(df):
        return allf.transform(inter.transform(desc.transform(env.transform(df))))

    tr = _with_weights(train_long.where(F.col(y).isNotNull()), y).withColumn("_y", F.col(y))
    lr = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=50, regParam=0.01)
    model = lr.fit(prep(tr))
    pred = model.transform(prep(test_long.where(F.col(y).isNotNull())))
    return pred.withColumn("score", vector_to_array("probability")[1]).drop("_env", "_desc", "_int", "_x",
                                                                             "rawPrediction", "probability",
                                                                             "prediction")


def logistic_attribution(df: DataFrame, features: list[str], weights: dict[str, float],
                         background: DataFrame) -> DataFrame:
    """Exact local attribution of a logistic link: w_j * (x_j - mean_background(x_j));
    the attributions sum to the logit difference from the background mean."""
    means = background.agg(*[F.avg(c).alias(c) for c in features]).first()
    return df.select(*[c for c in df.columns if c not in features],
                     *[(F.lit(weights[c]) * (F.col(c) - F.lit(means[c]))).alias(f"phi_{c}") for c in features])
