import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import percentiles as PC

SHARES = (0.0, 0.05, 0.5, 0.777, 0.95, 1.0)


@pytest.mark.parametrize("few, accuracy", [(4096, 10_000), (8, 50)])
def test_equals_numpy_whatever_the_distribution(spark, few, accuracy):
    draw = np.random.default_rng(3)
    hot = np.where(draw.random(3000) < 0.6, 7.5, draw.normal(size=3000))
    wide = np.exp(60 * draw.normal(size=3000))
    two = draw.integers(0, 2, 3000).astype(float)
    frame = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(hot, wide, two, strict=True)], "hot double, wide double, `two.x` double").repartition(6).cache()
    got = PC.exact_percentiles(frame, {"hot": SHARES, "wide": SHARES, "two.x": SHARES}, few, accuracy)
    for name, values in (("hot", hot), ("wide", wide), ("two.x", two)):
        np.testing.assert_allclose(got[name], np.quantile(values, SHARES), rtol=1e-12)


def test_nulls_nan_and_empty_columns(spark):
    frame = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None), (3.0, None)], "a double, b double")
    got = PC.exact_percentiles(frame, {"a": (0.0, 0.5, 1.0), "b": (0.5,)}, few=1)
    assert got["a"][:2] == [1.0, 3.0] and np.isnan(got["a"][2]) and got["b"] == [None]
    assert PC.exact_percentiles(frame.limit(0), {"a": (0.5,)}) == {"a": [None]}
    with pytest.raises(ValueError):
        PC.exact_percentiles(frame, {"a": (1.5,)})


def test_described(spark):
    frame = spark.range(101).select(F.col("id").cast("double").alias("x"))
    row = PC.described(frame, ["x"], (0.1, 0.5)).first()
    assert (row.column, row.n, row.mean, row.least, row.p10, row.p50, row.most) == ("x", 101, 50.0, 0.0, 10.0, 50.0, 100.0)


def test_a_hot_value_is_never_listed(spark):
    """Only parts of at most ``few`` values are collected, so the plan's listing pass has few of them."""
    frame = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).otherwise(-1.0).alias("x"))
    got = PC.exact_percentiles(frame, {"x": (0.5, 0.9)}, few=64, accuracy=200)
    want = np.quantile(np.where(np.arange(50_000) % 3 == 0, np.arange(50_000), -1.0), (0.5, 0.9))
    np.testing.assert_allclose(got["x"], want)
