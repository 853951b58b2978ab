"""The feature and target partition as one fitted object: roles, scalers and categories learned on training rows.

`fit_partition` stores what it learned as two tables: the columns of each block with their scalers, and the categories. `apply` gives
every row its five parts. Features are sparse arrays, so that a column with many categories adds no columns to the plan, and its
categories are joined as a table instead of being written into expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aquifer import catalog
from aquifer.operators.prepare import ScalerPlan, apply_scalers, column_roles, fit_categories, fit_scalers
from aquifer.session import write_down

PLAN = "block string, column string, kind string, pos int, scaler string, center double, scale double, quantiles array<double>"
BLOCKS = {"global": "X_glob", "local": "X_loc"}


def _present(names: list[str], columns: list[str]) -> list[str]:
    return [c for c in names if c in columns]


@dataclass
class Partition:
    """A fitted partition. `plan` has a row for each feature column (see PLAN) and one for each target and admin column;
    `categories` holds (column, value, idx) with the training values, idx by sorted value and NULL last."""

    plan: DataFrame
    categories: DataFrame
    keys: list[str]

    def save(self, path: str) -> None:
        """Write both tables below a shared path."""
        self.plan.write.mode("overwrite").parquet(f"{path}/plan")
        self.categories.write.mode("overwrite").parquet(f"{path}/categories")
        self.plan.sparkSession.createDataFrame([(k,) for k in self.keys], "key string").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/keys")

    def _widths(self) -> dict[str, int]:
        """Categories of each column: one number a column."""
        return {r["column"]: r["n"] for r in self.categories.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}

    def features(self) -> DataFrame:
        """(block, pos, feature): the name behind every position of the sparse arrays."""
        rows, start = [], {}
        width = self._widths()
        for r in sorted(self.plan.where("block in ('X_glob', 'X_loc')").collect(), key=lambda r: (r["block"], r["pos"])):
            at = start.get(r["block"], 0)
            rows.append((r["block"], r["column"], r["kind"], at))
            start[r["block"]] = at + (1 if r["kind"] == "num" else width.get(r["column"], 0))
        t = self.plan.sparkSession.createDataFrame(rows, "block string, column string, kind string, start int")
        named = t.where("kind = 'cat'").join(self.categories, "column").select(
            "block", (F.col("start") + F.col("idx")).cast("int").alias("pos"),
            F.concat("column", F.lit("_"), F.coalesce("value", F.lit("nan"))).alias("feature"))
        return t.where("kind = 'num'").select("block", F.col("start").alias("pos"), F.col("column").alias("feature")).unionByName(named)

    def apply(self, df: DataFrame) -> DataFrame:
        """Every row once: keys, X_glob, X_loc (struct of size, indices, values), Y_glob, Y_loc and geo (structs of columns).

        Numbers are scaled with the training plan; a missing number keeps its index with a NULL value. A category is 1 at its
        index; one that training did not have gives no entry. A block without columns is NULL (features: of size 0); a
        planned column that `df` lacks counts as missing, other columns of `df` are left out."""
        plan = sorted(self.plan.collect(), key=lambda r: (r["block"], r["pos"]))  # one row a column
        width = self._widths()
        planned = [r for r in plan if r["block"] in ("X_glob", "X_loc")]
        lacking = {r["column"]: "double" if r["kind"] == "num" else "string" for r in plan if r["column"] not in df.columns}
        t = df.select(*[F.col(f"`{c}`") for c in df.columns if c in self.keys or c in {r["column"] for r in plan}],
                      *[F.lit(None).cast(v).alias(c) for c, v in lacking.items()])
        scalers = ScalerPlan()
        for r in planned:
            if r["kind"] == "num":
                scalers.kind[r["column"]] = r["scaler"]
                if r["quantiles"]:
                    scalers.quantiles[r["column"]] = list(r["quantiles"])
                else:
                    scalers.center[r["column"]], scalers.scale[r["column"]] = r["center"], r["scale"]
        kept = [c for c in t.columns if c not in scalers.kind]
        t = apply_scalers(t, scalers, keep=kept)
        for i, r in enumerate([r for r in planned if r["kind"] == "cat"]):
            codes = self.categories.where(F.col("column") == r["column"]).select(F.col("value").alias("_value"), F.col("idx").alias(f"_code{i}"))
            t = t.join(codes, F.col(f"`{r['column']}`").cast("string").eqNullSafe(F.col("_value")), "left").drop("_value")
        blocks, code = [], 0
        for name in ("X_glob", "X_loc"):
            cells, at = [], 0
            for r in [r for r in planned if r["block"] == name]:
                if r["kind"] == "num":
                    cells.append(F.struct(F.lit(at).alias("i"), F.col(f"`{r['column']}`").cast("double").alias("v"), F.lit(True).alias("on")))
                    at += 1
                else:
                    here = F.col(f"_code{code}")
                    cells.append(F.struct((F.lit(at) + here).cast("int").alias("i"), F.lit(1.0).alias("v"), here.isNotNull().alias("on")))
                    at += width.get(r["column"], 0)
                    code += 1
            hot = F.filter(F.array(*cells), lambda c: c["on"]) if cells else None
            none = (F.array().cast("array<int>"), F.array().cast("array<double>"))
            blocks.append(F.struct(F.lit(at).alias("size"), (F.transform(hot, lambda c: c["i"]) if cells else none[0]).alias("indices"),
                                   (F.transform(hot, lambda c: c["v"]) if cells else none[1]).alias("values")).alias(name))
        for name in ("Y_glob", "Y_loc", "geo"):
            cols = [F.col(f"`{r['column']}`") for r in plan if r["block"] == name]
            blocks.append((F.struct(*cols) if cols else F.lit(None).cast("struct<none:double>")).alias(name))
        return t.select(*self.keys, *blocks)


def load_partition(spark: SparkSession, path: str) -> Partition:
    """A saved partition."""
    keys = [r["key"] for r in spark.read.parquet(f"{path}/keys").collect()]
    return Partition(spark.read.schema(PLAN).parquet(f"{path}/plan"), spark.read.parquet(f"{path}/categories"), keys)


def fit_partition(train: DataFrame, keys: list[str], global_feats: list[str] | None = None, chain: list[str] | None = None,
                  classes: dict[str, list[str]] | None = None) -> Partition:
    """Learn roles, scalers and categories from training rows.

    Roles come from the column names (P11): target-like names and admin columns are never features; of the others the global list
    makes X_glob and the rest X_loc, numbers before categories. Y_glob is the chain, Y_loc the other analytes of the classes
    that the table has, geo the admin columns it has. Key columns are kept beside them and are never features. A number that is
    always missing in training is left out; NaN is read as missing. Repeated rows count as often as they occur."""
    chain = catalog.GLOBAL_CHAIN if chain is None else chain
    classes = catalog.ANALYTE_CLASSES if classes is None else classes
    types = dict(train.dtypes)
    columns = [c for c in train.columns if c not in keys]
    roles = column_roles(columns, types, global_feats)
    num = [c for c in columns if roles[c][0] in BLOCKS and roles[c][1] == "num"]
    cat = [c for c in columns if roles[c][0] in BLOCKS and types[c] == "string"]
    train = write_down(train.select(*num, *cat), "train") if num or cat else train  # read four times, its joins run once
    learned = fit_scalers(train, num) if num else ScalerPlan()
    rows = []
    for role, block in BLOCKS.items():
        feats = [c for c in num if roles[c][0] == role and c in learned.kind] + [c for c in cat if roles[c][0] == role]
        for pos, c in enumerate(feats):
            kind = "num" if c in num else "cat"
            rows.append((block, c, kind, pos, learned.kind.get(c), learned.center.get(c), learned.scale.get(c), learned.quantiles.get(c)))
    others = [a for names in classes.values() for a in names if a not in chain]
    admin = [c for c in columns if roles[c][0] == "admin"]
    for block, names in (("Y_glob", _present(chain, columns)), ("Y_loc", _present(others, columns)), ("geo", admin)):
        rows += [(block, c, "asis", pos, None, None, None, None) for pos, c in enumerate(names)]
    spark = train.sparkSession
    empty = spark.createDataFrame([], "column string, value string, idx int")
    found = fit_categories(train, cat).select(F.col("col").alias("column"), "value", F.col("idx").cast("int").alias("idx")) if cat else empty
    return Partition(spark.createDataFrame(rows, PLAN), write_down(found, "categories"), list(keys))


def long_blocks(parts: DataFrame, fitted: Partition) -> DataFrame:
    """(keys, block, feature, value): each entry of each block as a row; targets and admin numbers as they are, names as text
    are not part of it."""
    def sparse(name: str) -> Column:
        return F.transform(F.arrays_zip(f"{name}.indices", f"{name}.values"), lambda e: F.struct(
            F.lit(name).alias("block"), e["indices"].alias("pos"), e["values"].alias("value")))

    cells, names = [sparse("X_glob"), sparse("X_loc")], []
    for r in fitted.plan.where("block NOT IN ('X_glob', 'X_loc')").collect():  # a row a column
        names.append((r["block"], r["pos"], r["column"]))
        cells.append(F.array(F.struct(F.lit(r["block"]).alias("block"), F.lit(r["pos"]).alias("pos"),
                                      F.col(r["block"])[r["column"]].cast("double").alias("value"))))
    named = fitted.features().unionByName(fitted.plan.sparkSession.createDataFrame(names, "block string, pos int, feature string"))
    entries = parts.select(*fitted.keys, F.explode(F.concat(*cells)).alias("_e")).select(*fitted.keys, "_e.*")  # one pass over the rows
    return entries.join(named, ["block", "pos"]).select(*fitted.keys, "block", "feature", "value")
