"""CSV ingest, stage tables, run registry and parameter checkpoints.

All outputs are Parquet under a caller-given root (on a cluster: a shared folder); nothing is
written to machine-local temporary space.
"""

from __future__ import annotations

import json
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aquifer.operators import derive


def read_samples_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
                     drop: tuple[str, ...] = ("gm_dataset_name", "PFAS_total")) -> DataFrame:
    """Header CSV -> typed table. With a schema, junk cells become NULL (PERMISSIVE);
    without one every column is read as text and analyte columns are coerced. Admin columns dropped."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    df = derive.rename_columns(df)
    df = derive.coerce_analytes(df)
    return df.drop(*drop)


def stage(spark: SparkSession, path: str, build, complete_col: str | None = None,
          incomplete_values: tuple[str, ...] = ("unknown",)) -> DataFrame:
    """A3: reuse a stage table if present (and complete), else build it, write it, and read it back.
    Completeness = no row whose `complete_col` is still a sentinel."""
    try:
        cached = spark.read.parquet(path)
        if complete_col is None or cached.where(F.col(complete_col).isin(*incomplete_values)).limit(1).count() == 0:
            return cached
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise  # only an absent or empty stage is rebuilt
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_registry(spark: SparkSession, path: str, run_id: str, config: dict, final_loss: float,
                    metrics: dict[str, float] | None = None) -> None:
    """A4: append one run-summary row (created on first use), values rounded to 6 decimals."""
    row = {"run_id": run_id, "ts": time.strftime("%Y-%m-%d %H:%M:%S"), "config": json.dumps(config, sort_keys=True),
           "final_loss": round(float(final_loss), 6)}
    for k, v in (metrics or {}).items():
        row[k] = round(float(v), 6)
    spark.createDataFrame([row]).write.mode("append").option("mergeSchema", "true").parquet(path)


def write_run_config(spark: SparkSession, root: str, run_id: str, config: dict) -> str:
    """A5: run metadata row (run_id, config map) under root/runs, partitioned by run_id."""
    spark.createDataFrame([(run_id, {k: str(v) for k, v in config.items()})], "run_id string, config map<string,string>") \
        .write.mode("append").partitionBy("run_id").parquet(f"{root}/runs")
    return f"{root}/runs/run_id={run_id}"


def checkpoint_params(params: DataFrame, root: str, run_id: str, rnd: int, every: int = 5) -> DataFrame:
    """Every `every` rounds ((r+1) % every == 0) persist the parameter table partitioned by
    (run_id, round) and continue from the written copy (cuts lineage); otherwise pass through."""
    if (rnd + 1) % every != 0:
        return params
    out = f"{root}/params"
    params.withColumn("run_id", F.lit(run_id)).withColumn("round", F.lit(rnd)) \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "round").parquet(out)
    return params.sparkSession.read.parquet(f"{out}/run_id={run_id}/round={rnd}")


def write_results(pred: DataFrame, path: str, key: str = "analyte") -> None:
    """The long predictions table as Parquet plus the raw (y, score) pairs as JSON lines, one
    directory per key value -- never a per-key list gathered into one task."""
    pred.write.mode("overwrite").parquet(f"{path}/predictions")
    pred.select(key, "y", "score").write.mode("overwrite").partitionBy(key).json(f"{path}/pairs_json")
