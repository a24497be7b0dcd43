"""Joins of voxel tables go through shuffles: Spark's estimates of exploded and written tables are far too small for broadcasts."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import morphology as M
from tessera.operators import thinning as S
from tessera.operators import vessels as V
from tessera.plans import fixtures as fx


def _bright(spark, sf_dir, level):
    return fx.vox(spark, sf_dir).filter(F.col("v") > level)


def _thinned(spark, sf_dir):
    return S.skeleton_radii(*S.thin(fx.slab(spark, sf_dir).withColumn("v", (F.col("v") > 97).cast("int")), 2))


QUERIES = {
    "centers_of_maxima": lambda s, d: M.centers_of_maxima(fx.vox(s, d), _bright(s, d, 112)),
    "clean_open_branches": lambda s, d: V.clean_open_branches(_bright(s, d, 110), 2),
    "skeleton_radii": _thinned,
}


@pytest.mark.parametrize("name", QUERIES)
def test_no_voxel_table_is_broadcast(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
