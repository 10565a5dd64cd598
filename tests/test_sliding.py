import numpy as np
import pandas as pd
import pytest

from tidemark.operators.sliding import sliding_std


@pytest.mark.parametrize("window, least", [(2, None), (7, None), (7, 3), (63, None)])
def test_equals_a_rolling_deviation(spark, window, least):
    draw = np.random.default_rng(1)
    frame = pd.DataFrame({"k": np.repeat(["A", "B"], 200), "d": np.tile(np.arange(200), 2), "v": draw.normal(size=400)})
    frame.loc[draw.random(400) < 0.05, "v"] = np.nan
    rows = spark.createDataFrame([(k, int(d), None if np.isnan(v) else float(v)) for k, d, v in frame.itertuples(index=False)], "k string, d int, v double")
    got = sliding_std(rows, "v", window, ["k"], "d", "s", least).orderBy("k", "d").toPandas()
    want = frame.groupby("k").v.rolling(window, min_periods=least or window).std().to_numpy()
    np.testing.assert_allclose(got.s.astype(float), want, rtol=1e-9, atol=1e-12)
    assert list(got.columns) == ["k", "d", "v", "s"]


def test_large_means_and_equal_values(spark):
    draw = np.random.default_rng(2)
    values = 1e5 + 1e-3 * draw.normal(size=300)
    values[200:] = 0.1
    rows = spark.createDataFrame([("A", k, float(v)) for k, v in enumerate(values)], "k string, d int, v double")
    got = np.array([r.s for r in sliding_std(rows, "v", 40, ["k"], "d", "s").orderBy("d").collect()], float)
    for k in (39, 77, 120, 199):
        assert got[k] == pytest.approx(np.std(values[k - 39 : k + 1] - 1e5, ddof=1), rel=1e-7)
    assert (got[239:] == 0).all() and np.isnan(got[:39]).all()


def test_frames_are_carried_on_and_dealt_once(spark):
    rows = spark.createDataFrame([("A", 1, 1.0)], "k string, d int, v double")
    plan = sliding_std(rows, "v", 252, ["k"], "d", "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
