import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkiln.functions import ordering as O
from panelkiln.operators import features as X
from panelkiln.operators import panel as P
from panelkiln.operators import portfolio as Q

R = random.Random(12)


def table(spark, n=600):
    rows = [(k, R.choice(["a", "b", None, "c"]), R.choice([None, *map(float, range(9))]), R.choice([None, 0.5, -1.5, 2.25])) for k in range(n)]
    rows += [(9000, "alone", 1.0, None), (9001, "nothing", None, None)]
    return spark.createDataFrame(rows, "permno long, month string, x double, y double").repartition(7)


@pytest.fixture
def many_ranges(spark):
    """Small partitions stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.usefixtures("many_ranges")
def test_places_of_a_group_that_fills_many_ranges(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("g"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("v"), "id").union(spark.createDataFrame([(None, 5, -1), (2, None, -2), (2, 7, -3)], "g int, v long, id long"))
    placed = O.positions(rows, ["g"], ["v", "id"])
    found = placed.collect()
    own = sorted((r.v, r.id) for r in found if r.g == 1)
    assert {(r.v, r.id): r.place for r in found if r.g == 1} == {k: i + 1 for i, k in enumerate(own)}
    assert {(r.g, r.id): (r.place, r["size"]) for r in found if r.g != 1} == {(None, -1): (1, 1), (2, -2): (1, 2), (2, -3): (2, 2)}
    ranges = rows.repartitionByRange("g", "v", "id").withColumn("p", F.spark_partition_id()).where("g = 1").groupBy("p").count()
    assert ranges.count() >= 3  # one group over several tasks


@pytest.mark.parametrize("scale", ["pct", "minmax"])
def test_spread_ranks_equal_those_of_windows(spark, scale):
    df = table(spark)
    one, two = (sorted(map(repr, X.rank_columns(df, ["x", "y"], scale=scale, spread=s).collect())) for s in (False, True))
    assert one == two and len(one) == 602
    assert X.rank_columns(df.limit(0), ["x"], spread=True).count() == 0
    repeated = df.union(df)  # keys that repeat
    one, two = (sorted(map(repr, X.rank_columns(repeated, ["x"], scale=scale, spread=s).collect())) for s in (False, True))
    assert one == two


def test_spread_deciles_and_size_groups_equal_those_of_windows(spark):
    df = table(spark)
    for make in (lambda s: Q.assign_deciles(df, "x", spread=s), lambda s: P.by_size(df, 4, "x", spread=s)):
        assert sorted(map(repr, make(False).collect())) == sorted(map(repr, make(True).select(make(False).columns).collect()))


def test_spread_ranks_use_no_python(spark):
    plan = O.positions(table(spark, 20), ["month"], ["x"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quantiles_equal_numpy(spark):
    df, shares = table(spark), (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    rows = df.collect()
    for r in O.exact_quantiles(df, ["x", "y"], shares, ["month"]).collect():
        own = [row["xy"[r["__column"]]] for row in rows if row.month == r.month]
        own = [v for v in own if v is not None]
        assert r["__n"] == len(own) and np.allclose(r["__q"], np.quantile(own, shares))
    whole = {r["__column"]: r["__q"] for r in O.exact_quantiles(df, ["x", "y"], shares).collect()}
    assert np.allclose(whole[0], np.quantile([r.x for r in rows if r.x is not None], shares))
    assert O.exact_quantiles(df.limit(0), ["x"], shares).count() == 0
