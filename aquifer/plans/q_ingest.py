"""Ingest, stage, registry and result queries (A1-A7): written to the shared folder, read back, compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquifer.plans import sql as S
from aquifer.plans.registry import query
from aquifer.session import scratch_path
from aquifer.sources import fixtures as fx
from aquifer.sources import ingest


def r6(c):
    return F.round(c, 6)


@query("a_csv", S.with_(S.OBS, S.WIDE) + """
SELECT sample_id, CASE WHEN well_id % 13 <> 0 THEN click END AS "PFOA", error AS "PFHXS" FROM wide""")
def a_csv(spark, d):
    """The wide samples as header CSV, with lab text in some cells and an admin column; read back typed."""
    path = scratch_path(spark, "a-csv")
    w = fx.wide_samples(spark, d)
    w.select("sample_id", F.when(F.col("well_id") % 13 == 0, F.lit("ND")).otherwise(F.col("click").cast("string")).alias("PFOA"),
             F.col("error").alias("PFHXS"), F.lit("lab").alias("gm_dataset_name")).write.option("header", True).csv(path)
    got = ingest.read_samples_csv(spark, path)
    return got.select(F.col("sample_id").cast("long").alias("sample_id"), "PFOA", "PFHXS")


@query("a_stage", S.with_(S.SITES) + "SELECT site_id, basin, county FROM sites")
def a_stage(spark, d):
    """A3: the first call builds the stage table, the second reads it without building."""
    path = scratch_path(spark, "a-stage")
    ingest.stage(spark, path, lambda: fx.sites(spark, d).select("site_id", "basin", "county"))

    def never():
        raise AssertionError("a complete stage is not built again")

    return ingest.stage(spark, path, never)


@query("a_registry", S.with_(S.PRED) + """
SELECT 'run_' || mode AS run_id, round(avg(score), 6) AS final_loss, count(y)::DOUBLE AS n_labelled FROM pred GROUP BY mode""")
def a_registry(spark, d):
    """A4: a registry row per run, appended run by run, with its figures from the data."""
    path = scratch_path(spark, "a-registry")
    runs = fx.predictions(spark, d).groupBy("mode").agg(F.avg("score").alias("loss"), F.count("y").alias("n"))
    for r in runs.collect():  # one row per mode
        ingest.append_registry(spark, path, f"run_{r['mode']}", {"mode": r["mode"]}, r["loss"], {"n_labelled": r["n"]})
    return spark.read.parquet(path).select("run_id", "final_loss", "n_labelled")


@query("a_run_config", S.with_(S.VOLUMES) + "SELECT 'cfg' AS run_id, 'volume_' || node_id AS key, volume::VARCHAR AS value FROM volumes")
def a_run_config(spark, d):
    """A5: a run folder with its configuration; here the nodes' volumes."""
    root = scratch_path(spark, "a-config")
    volumes = {f"volume_{r['node_id']}": r["volume"] for r in fx.node_volumes(spark, d).collect()}  # one per node
    ingest.write_run_config(spark, root, "cfg", volumes)
    return spark.read.parquet(f"{root}/runs").select("run_id", F.explode("config").alias("key", "value"))


@query("a_checkpoint", S.with_(S.PARAMS) + "SELECT node_id, param, round(v * 32, 6) AS v FROM params")
def a_checkpoint(spark, d):
    """Parameters doubled each round and written every fifth; the last rounds go on from the written copy."""
    root = scratch_path(spark, "a-params")
    params = fx.node_params(spark, d)
    for rnd in range(5):
        params = params.withColumn("v", F.col("v") * 2)
        params = ingest.checkpoint_params(params, root, "run", rnd)
    return params.select(F.col("node_id"), F.col("param"), r6("v").alias("v"))


@query("a_results", S.with_(S.PRED) + """
SELECT analyte, y, score, count(*) AS n FROM pred WHERE mode = 'global' GROUP BY ALL""")
def a_results(spark, d):
    """Predictions as Parquet, raw pairs as JSON lines by analyte; the pairs read back and counted."""
    path = scratch_path(spark, "a-results")
    ingest.write_results(fx.predictions(spark, d).where(F.col("mode") == "global"), path)
    pairs = spark.read.schema("y double, score double, analyte string").json(f"{path}/pairs_json")
    return pairs.groupBy("analyte", "y", "score").agg(F.count(F.lit(1)).alias("n"))
