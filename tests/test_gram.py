"""Covariances by blocks against pandas: several blocks and chunks, holes, late and silent tickers; what is shuffled grows with blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gram as G
from tidemark.plans import riskmodel as R

SCHEMA = "bar long, ticker string, value double"


def returns(seed, bars, tickers):
    draw = np.random.default_rng(seed)
    x = draw.normal(0, 0.01, (bars, tickers)) + draw.normal(0, 0.01, (bars, 1))
    x[draw.random(x.shape) < 0.2] = np.nan
    x[: bars // 2, 1] = np.nan
    x[bars // 3 :, 2] = np.nan
    return pd.DataFrame(x, index=np.arange(1, bars + 1), columns=[f"T{k:02d}" for k in draw.permutation(tickers)])


def as_spark(spark, wide):
    rows = wide.reset_index(names="bar").melt("bar", var_name="ticker", value_name="value")
    return spark.createDataFrame(rows.sample(frac=1, random_state=1), SCHEMA)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(G, "CHUNK", 32)
    monkeypatch.setattr(G, "WIDTH", 4)



def test_pairs_equal_pandas(spark):
    wide = returns(3, 600, 70)
    got = G.pair_covariances(as_spark(spark, wide), span=30, periods=20).toPandas()
    seen = wide.notna().to_numpy().astype(int)
    assert len(got) == sum((seen[:, i] & seen[:, j]).sum() for i in range(70) for j in range(i, 70))
    assert (got.i <= got.j).all() and not got.duplicated(["bar", "i", "j"]).any()
    want = wide.ewm(span=30, min_periods=20).cov()
    for r in got[got["cov"].notna()].sample(400, random_state=1).itertuples():
        assert r.cov == pytest.approx(want.loc[(r.bar, r.i), r.j], rel=1e-8, abs=1e-15)
    counts = (wide["T05"].notna() & wide["T44"].notna()).cumsum()
    of = got[(got.i == "T05") & (got.j == "T44")]
    assert (of.n.to_numpy() == counts[of.bar].to_numpy()).all() and (of["cov"].isna() == (of.n < 20)).all()


def test_packed_matrices_stay_known(spark):
    wide = returns(4, 300, 70)
    rows = as_spark(spark, wide)
    spec = G.Spec((25, 40), (10, 30))
    packed = G.by_bar(G.packed_covariances(rows, rows, spec, 300)).toPandas().set_index("bar")
    assert sorted(packed.index) == list(range(1, 301))
    for k, (s, periods) in enumerate(zip(spec.spans, spec.periods, strict=True)):
        want = wide[sorted(wide)].ewm(span=s, min_periods=periods).cov()
        for bar in (1, 9, 40, 256, 257, 300):
            got = G.unpacked([(b["lo"], b["hi"], b["cov"]) for b in packed.blocks[bar]], 2, 70)[k]
            np.testing.assert_allclose(got, want.loc[bar].to_numpy(), rtol=1e-7, atol=1e-14)


def test_chunks_and_blocks_of_any_size(small):
    """The kernels alone: sums of chunks carried by their decay give what one pass gives."""
    x, y = (returns(s, 96, 4).to_numpy() for s in (5, 6))
    spec = G.Spec((12,), (5,))
    whole = list(G.expanded(x, y, np.zeros((2, G.SUMS, 4, 4)), spec))
    held, fade = np.zeros((2, G.SUMS, 4, 4)), G._fades(spec.decays, 32)
    for c in range(3):
        own = slice(32 * c, 32 * c + 32)
        part = list(G.expanded(x[own], y[own], held, spec))
        for (b, n, v), (b2, n2, v2) in zip(part, whole[own], strict=True):
            assert (b == b2).all()
            np.testing.assert_allclose(n, n2)
            np.testing.assert_allclose(v[:, b], v2[:, b], rtol=1e-9)
        held = held * fade + G.chunk_sums(x[own], y[own], spec.decays)


def test_rows_before_the_last_step_grow_with_blocks(spark):
    """70 and 140 tickers over 300 bars: 2 and 3 blocks, so 3 and 6 pairs of blocks in each of 2 chunks; never pairs of tickers."""
    for tickers, blocks in ((70, 2), (140, 3)):
        rows = as_spark(spark, returns(7, 300, tickers))
        axis = G.axis_of(rows)
        assert axis.count() == tickers and axis.agg(F.max("block")).first()[0] == blocks - 1
        cells = G.value_blocks(G.finite_returns(rows), axis, 300)
        pairs = G.block_pairs(cells, blocks)
        assert cells.count() == 2 * blocks
        assert pairs.count() == G.inherited(pairs, G.Spec((30,), (20,))).count() == 2 * blocks * (blocks + 1) // 2


def test_nothing_and_bad_input(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert G.pair_covariances(none, span=5, periods=2).count() == 0
    with pytest.raises(ValueError):
        G.Spec((5,), (1,))
    one = spark.createDataFrame([(1, "a", float("nan")), (2, "a", float("inf")), (3, "a", 1.0), (4, "a", None)], SCHEMA)
    assert [tuple(r) for r in G.pair_covariances(one, span=5, periods=2).collect()] == [(3, "a", "a", 1, None)]


def test_spans_are_known_together():
    cov = np.array([[[1.0, 0.5], [0.5, 2.0]], [[1.0, np.nan], [np.nan, 2.0]]])
    got = R.both_spans([{"lo": 0, "hi": 0, "cov": cov.tobytes()}], ("b", "a"))
    assert got[0, 0, 0] == 2.0 and np.isnan(got[:, 0, 1]).all()


def test_one_factor_reads_the_covariances_once(spark):
    """three readings of the covariances made plans that filled the driver; the model by pandas, with a ticker that is not priced on every bar."""
    from tidemark.operators.ewm import ewm_covariance
    from tidemark.operators.factors import one_factor

    wide = returns(5, 200, 4)
    rows = as_spark(spark, wide).where("value is not null and not isnan(value)")
    weights = spark.createDataFrame([(c, 0.25) for c in wide.columns], "ticker string, weight double")
    model = one_factor(rows, weights, span=30, periods=20)
    kernels = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("MapInArrow")
    assert kernels(model) == kernels(ewm_covariance(rows, span=30, periods=20))
    both = wide.assign(**{" market": (wide * 0.25).sum(axis=1, min_count=1)})
    cov = {(r.bar, r.i, r.j): r["cov"] for r in ewm_covariance(as_spark(spark, both), span=30, periods=20).where("cov is not null").collect()}
    m = " market"
    want = {}
    for bar, t, j in cov:
        if t == j != m and (bar, m, t) in cov and cov.get((bar, m, m), 0) > 0:
            var, factor = cov[bar, t, t], cov[bar, m, m]
            beta = cov[bar, m, t] / factor
            beta = beta * min(1, (var / (beta * beta * factor)) ** 0.5)
            want[bar, t] = (beta, factor, var, beta * beta * factor, max(0.1 * var, var - beta * beta * factor))
    got = {(r.bar, r.ticker): (r.beta, r.factor_var, r["var"], r.common, r.specific) for r in model.collect()}
    assert got.keys() == want.keys() and len(got) > 300
    for k in got:
        assert got[k] == pytest.approx(want[k], rel=1e-9)
