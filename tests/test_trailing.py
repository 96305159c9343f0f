import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netwatch.operators import timeseries as ts

SCHEMA = "sensor long, sec long, value double, percentile double, samples string"


def rows_of(seed, n, span, distinct):
    """Ties, repeated rows, gaps, one hot key, null keys and null values; column names of the result are taken already."""
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, None]), rng.choice([rng.randrange(span), 7 * span + rng.randrange(9)]),
             None if rng.random() < 0.05 else float(rng.randrange(distinct)) / 3, 9.0, "x") for _ in range(n)]


def brute(rows, q, seconds):
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    out = set()
    for key, sec in {r[:2] for r in rows}:
        inside = [r[2] for r in rows if r[0] == key and sec - seconds <= r[1] <= sec]
        out.add((key, sec, round(float(np.percentile(inside, 100 * q)), 9), len(inside)))
    return out


@pytest.mark.parametrize("block,span,distinct,q", [(60, 500, 40, 0.95), (3600, 900, 3, 0.5), (100, 2000, 5000, 0.99)])
def test_trailing_percentile_equals_brute_force(spark, block, span, distinct, q):
    rows = rows_of(block, 900, span, distinct) + [(1, None, 4.0, 9.0, "x")]
    got = ts.trailing_percentile(spark.createDataFrame(rows, SCHEMA).repartition(5), ["sensor"], q, 60, block)
    assert got.columns == ["sensor", "sec", "percentile", "samples"]
    assert {(r[0], r[1], round(r[2], 9), r[3]) for r in got.collect()} == brute(rows, q, 60)


def test_trailing_percentile_of_many_values_of_a_second(spark):
    """More rows in a group than an Arrow batch holds."""
    df = spark.range(30000).select(F.lit(3).alias("sensor"), (F.col("id") % 20).alias("sec"), F.col("id").cast("double").alias("value"))
    got = {r.sec: (r.percentile, r.samples) for r in ts.trailing_percentile(df, ["sensor"], 0.95, 4).collect()}
    for sec in range(20):
        inside = [i for i in range(30000) if max(0, sec - 4) <= i % 20 <= sec]
        assert got[sec] == (pytest.approx(np.percentile(inside, 95)), len(inside))


def test_trailing_percentile_of_nothing(spark):
    assert ts.trailing_percentile(spark.createDataFrame([], SCHEMA), ["sensor"]).collect() == []
    assert ts.trailing_percentile(spark.createDataFrame([(1, 2, None, 0.0, "")], SCHEMA), ["sensor"]).collect() == []
