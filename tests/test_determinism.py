"""Recomputation stability: results must not depend on the number of shuffle partitions
(a proxy for tasks being re-run on other executors with other partitionings)."""

import pytest

import __spark_entry__ as E
from harness import SF_SMALL, _rows

NAMES = ["w_split", "e_auroc", "g_boxplot", "t_spearman", "p_impute", "j_basin", "t_label_encode"]


@pytest.mark.parametrize("name", NAMES)
def test_independent_of_shuffle_partitions(spark, name):
    q = E.queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = _rows(q(spark, SF_SMALL).toPandas())
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        b = _rows(q(spark, SF_SMALL).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b
