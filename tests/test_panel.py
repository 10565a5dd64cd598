import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import matrices as M
from tidemark.operators import crosssection as X
from tidemark.operators import ewm as E
from tidemark.operators import factors as FA
from tidemark.operators import features as FE
from tidemark.sources import panel as P


@pytest.fixture(scope="module")
def walk(spark):
    """Three walks; one has holes, one starts late."""
    rows = P.synthetic_panel(spark, ["SPY", "QQQ", "TLT"], 500).toPandas()
    rows["n"] = rows.groupby("ticker").cumcount()
    rows = rows[~((rows.ticker == "QQQ") & (rows.n % 7 == 3))]
    rows = rows[~((rows.ticker == "TLT") & (rows.n < 60))].drop(columns="n")
    return rows


def as_spark(spark, rows):
    return spark.createDataFrame(rows, P.PANEL)


@pytest.mark.parametrize("span", [3, 60, 250])
def test_ewm_moments_match_pandas(spark, walk, span):
    got = E.ewm_moments(as_spark(spark, walk), ["ticker"], "date", "close", "mean", "std", span=span).toPandas().sort_values(["ticker", "date"])
    want = walk.sort_values(["ticker", "date"])
    ewm = want.groupby("ticker").close.ewm(span=span, min_periods=span)
    np.testing.assert_allclose(got["mean"].to_numpy(float), ewm.mean().to_numpy(), rtol=1e-9)
    np.testing.assert_allclose(got["std"].to_numpy(float), ewm.std().to_numpy(), rtol=1e-6)


def test_ewm_covariance_decays_on_every_bar(spark, walk):
    panel = as_spark(spark, walk)
    rows = P.with_returns(panel).join(P.bar_numbers(panel), "date").select("bar", "ticker", F.col("log_return").alias("value"))
    got = E.ewm_covariance(rows, span=40, periods=20).toPandas()
    wide = rows.toPandas().pivot(index="bar", columns="ticker", values="value").astype(float)
    want = wide.ewm(span=40, min_periods=20).cov()
    for r in got[got["cov"].notna()].sample(200, random_state=1).itertuples():
        assert r.cov == pytest.approx(want.loc[(r.bar, r.i), r.j], rel=1e-8, abs=1e-15)


def test_alpha_needs_one_of_both():
    with pytest.raises(ValueError):
        E.alpha()
    with pytest.raises(ValueError):
        E.alpha(span=3, halflife=3)
    assert E.alpha(span=3) == 0.5
    assert E.alpha(halflife=1) == pytest.approx(0.5)


def test_trend_warm_up(spark):
    panel = P.synthetic_panel(spark, ["A"], 360)
    rows = FE.macd(panel).toPandas().sort_values("date").reset_index(drop=True)
    assert [rows[c].first_valid_index() + 1 for c in ("macd_8_24", "macd_16_48", "macd_32_96")] == [314, 314, 347]
    moments = FE.vol_scaled_momentum(panel).toPandas().sort_values("date").reset_index(drop=True)
    assert [moments[f"mom_{k}"].first_valid_index() + 1 for k in (1, 21, 63, 126, 252)] == [61, 61, 64, 127, 253]


def test_bars_without_spread_are_skipped_in_the_trend_window(spark):
    rows = P.synthetic_panel(spark, ["A"], 420).toPandas()
    rows.loc[100:170, "close"] = rows.close[100]
    got = FE.macd(as_spark(spark, rows), pairs=((8, 24),)).toPandas().sort_values("date")["macd_8_24"].astype(float)
    c = rows.close
    std = c.rolling(63).std()
    q = ((c.ewm(span=8, min_periods=8).mean() - c.ewm(span=24, min_periods=24).mean()) / std)[std > 1e-9]
    want = (q / q.rolling(252).std()).reindex(c.index)
    np.testing.assert_allclose(got.to_numpy()[-40:], want.to_numpy()[-40:], rtol=1e-5)


def test_winsorised_clips_an_outlier(spark):
    rows = pd.DataFrame({"date": pd.date_range("2020-01-01", periods=101), "ticker": "A", "close": [*np.random.default_rng(5).normal(size=100), 1000.0]})
    got = FE.winsorised(as_spark(spark, rows), "close", "clipped").orderBy("date").toPandas()
    assert got.clipped.iloc[-1] < 1000
    assert (got.clipped.iloc[:30] == got.close.iloc[:30]).all()


def test_bad_ticks_and_sticky_prices(spark):
    rows = pd.DataFrame({"date": pd.date_range("2020-01-01", periods=5), "ticker": "A", "close": [1.0, float("nan"), 0.0, -1.0, 2.0]})
    other = pd.DataFrame({"date": pd.date_range("2020-01-01", periods=5), "ticker": "B", "close": 3.0})
    panel = P.good_ticks(as_spark(spark, pd.concat([rows, other])))
    last = P.with_returns(panel).where("ticker = 'A'").orderBy("date").collect()[-1]
    assert last.log_return == pytest.approx(math.log(2))
    assert [r.sticky for r in P.dense_panel(panel).where("ticker = 'A'").orderBy("date").collect()] == [1, 1, 1, 1, 2]


def test_robust_zscore(spark):
    rows = spark.createDataFrame([("d", float(v)) for v in (1, 2, 3, 4, 100)] + [("e", 1.0), ("e", 2.0), ("f", 1.0), ("f", 1.0), ("f", 1.0)], "k string, v double")
    got = X.robust_zscore(rows, "v", "z", ["k"]).toPandas()
    d = got[got.k == "d"].sort_values("v").z.to_numpy(float)
    np.testing.assert_allclose(d, M.robust_scores(np.array([1.0, 2, 3, 4, 100])))
    assert got[got.k != "d"].z.isna().all()


def test_factor_legs_are_scaled_or_dropped(spark):
    factors = spark.createDataFrame([("L", {"A": 1.0, "B": 1.0, "C": -1.0}), ("S", {"C": 2.0})], "name string, weights map<string,double>")
    live = spark.createDataFrame([(1, "A"), (1, "C"), (2, "A")], "date int, ticker string")
    got = {(r.date, r["name"], r.ticker): r.weight for r in FA.factor_weights(factors, live).collect()}
    assert got == {(1, "L", "A"): 2.0, (1, "L", "C"): -1.0, (1, "S", "C"): 2.0}


def test_factor_file(spark, tmp_path):
    good = {"factors": [{"name": "b", "level": 2, "weights": {"A": 1.0}}, {"name": "a", "level": 1, "granular": True, "weights": {"B": 1.0}}]}
    path = tmp_path / "f.json"
    path.write_text(json.dumps(good))
    assert [r["name"] for r in P.read_factors(spark, str(path), True).collect()] == ["a", "b"]
    assert [r["name"] for r in P.read_factors(spark, str(path), False).collect()] == ["b"]
    path.write_text(json.dumps({"factors": [{"name": "b", "level": 2, "weights": {}}, {"name": "b", "level": 2, "weights": {"A": 1.0}}]}))
    with pytest.raises(ValueError, match="given twice.*no weights"):
        P.read_factors(spark, str(path), True)
    path.write_text('{"x": 1}')
    with pytest.raises(ValueError, match="unknown keys x"):
        P.read_config(str(path), {"y": 2})


def test_levels_become_orthogonal():
    draw = np.random.default_rng(0)
    a = draw.normal(size=(6, 6))
    cov = a @ a.T
    w = draw.normal(size=(6, 3))
    out = M.residual_weights(w, np.array([1, 1, 2]), cov)
    np.testing.assert_allclose(out[:, :2], w[:, :2])
    np.testing.assert_allclose(out[:, :2].T @ cov @ out[:, 2], 0, atol=1e-9)


def test_capped_rows_hold_their_own_variance():
    b, f, own = np.array([[1.0], [3.0]]), np.array([[0.04]]), np.array([0.05, 0.09])
    out, common = M.capped(b, f, own)
    np.testing.assert_allclose(common, [0.04, 0.09])
    assert out[0, 0] == 1.0


def test_eigen_bias_spreads_the_spectrum():
    weights = M.decay_weights(250, 750)
    v = M.eigen_bias(np.ones(18), weights, 40, 0)
    assert v[0] == pytest.approx(1.31, abs=0.04)
    assert v[-1] == pytest.approx(0.80, abs=0.04)
    f = np.diag([1.0, 2.0])
    np.testing.assert_allclose(M.eigen_adjusted(f, np.ones(2), 1.4), f, atol=1e-12)


def solver_case():
    draw = np.random.default_rng(0)
    b, f, d = draw.normal(size=(8, 2)), np.diag([1e-4, 5e-5]), np.full(8, 1e-4)
    return draw.normal(size=8) * 1e-3, b, f, d, b @ f @ b.T + np.diag(d)


def test_solver_closed_forms():
    alpha, b, f, d, cov = solver_case()
    w, status = M.optimal_weights(alpha, b, f, d, np.zeros(8), vol_limit=0.01, max_gross=100)
    x = np.linalg.solve(cov, alpha)
    np.testing.assert_allclose(w, x * 0.01 / math.sqrt(x @ cov @ x), rtol=1e-4)
    assert status == "optimal"
    w, _ = M.optimal_weights(alpha, b, f, d, np.zeros(8), vol_limit=0.5, max_gross=1000, aversion=5)
    np.testing.assert_allclose(w, x / 5, rtol=1e-2)
    held = x * 0.001
    w, _ = M.optimal_weights(alpha, b, f, d, held, vol_limit=0.01, max_gross=10, penalty=1.0)
    np.testing.assert_allclose(w, held, atol=1e-6)
    w, _ = M.optimal_weights(alpha, b, f, d, np.zeros(8), vol_limit=0.01, max_gross=2, bounds=[(b[:, 0], -0.05, 0.05)])
    assert abs(w @ b[:, 0]) <= 0.05 + 1e-4
    assert np.abs(w).sum() <= 2 + 1e-9
