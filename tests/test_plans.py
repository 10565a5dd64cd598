import json
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import matrices as M
from tidemark.operators.crosssection import column_correlation
from tidemark.operators.ewm import ewm_covariance
from tidemark.operators.features import clip_rates, feature_panel, macd_score, return_vol, winsorised
from tidemark.plans import attribution as A
from tidemark.plans import backtest as B
from tidemark.plans import riskmodel as R
from tidemark.sources import panel as P
from tidemark.plans.configs import read_backtest
from tidemark.plans.runner import optimised_snapshots, report_tables, run_backtest, sticky_panel, write_report
from tidemark.streaming.features import MOMENTS, TRENDS, TickerState, closed_bars, covariance_stream, feature_stream

NAMES = ("MKT", "A", "B", "C")
CONFIG = R.Config(NAMES, (("Market", 1, {"MKT": 1.0}),), vol_span=20, corr_span=40, corr_periods=30, lookback=20, skip=2, simulations=5, refresh=10)


@pytest.fixture(scope="module")
def prices():
    draw = np.random.default_rng(3)
    market = draw.normal(0, 0.01, 160)
    rows = []
    for name, beta in zip(NAMES, (1.0, 1.5, 0.5, -0.5), strict=True):
        r = beta * market + (draw.normal(0, 0.005, 160) if name != "MKT" else 0)
        rows.append(pd.DataFrame({"date": pd.date_range("2020-01-01", periods=160), "ticker": name, "close": 100 * np.exp(np.cumsum(r))}))
    rows = pd.concat(rows)
    return rows[~((rows.ticker == "C") & (rows.date.dt.dayofyear % 7 == 3))]


@pytest.fixture(scope="module")
def snaps(spark, prices):
    return R.snapshots(spark.createDataFrame(prices, P.PANEL), CONFIG).toPandas().sort_values("bar").set_index("bar")


def test_snapshots_are_positive_and_floored(snaps):
    assert len(snaps) > 100
    for r in snaps.itertuples():
        n, k = len(r.tickers), len(r.factors)
        cov = np.reshape(r.b, (n, k)) @ np.reshape(r.f, (k, k)) @ np.reshape(r.b, (n, k)).T + np.diag(r.d)
        assert np.linalg.eigvalsh(cov).min() > 0
        assert (np.array(r.d) >= 0.1 * np.array(r.sigma) ** 2 - 1e-15).all()
    assert R.MOMENTUM in list(snaps.factors.iloc[-1])


def test_snapshots_dont_know_the_future(spark, prices, snaps):
    early = R.snapshots(spark.createDataFrame(prices[prices.date < "2020-04-10"], P.PANEL), CONFIG).toPandas().set_index("bar")
    last = early.index.max()
    for c in ("b", "f", "d", "sigma"):
        np.testing.assert_allclose(early.loc[last, c], snaps.loc[last, c], rtol=1e-9)


def test_measured_variance_is_that_of_the_residuals(spark, prices, snaps):
    """A replay bar by bar gives the same specific variances."""
    wide = prices.pivot(index="date", columns="ticker", values="close").reset_index(drop=True)
    state, last = {}, {}
    for bar in range(1, len(wide) + 1):
        row = wide.iloc[bar - 1].dropna()
        r = {t: np.log(c / last[t]) for t, c in row.items() if t in last}
        last.update(row)
        if bar - 1 in snaps.index:
            s = snaps.loc[bar - 1]
            x = np.array([r.get(t, 0.0) for t in s.tickers])
            n = len(x)
            f = np.reshape(s.w, (n, -1)).T @ x
            if R.MOMENTUM in list(s.factors):
                m = np.array(s.m)
                f = np.append(f, m @ (x - np.reshape(s.beta, (n, -1)) @ f) / (m @ m))
            eps = x - np.reshape(s.b, (n, -1)) @ f
            for t, e in zip(s.tickers, eps, strict=True):
                if t in r:
                    state.setdefault(t, []).append(e)
    s = snaps.loc[len(wide)]
    for t, d, sigma in zip(s.tickers, s.d, s.sigma, strict=True):
        want = pd.Series(state[t]).ewm(span=20, min_periods=20).var().iloc[-1]
        assert d == pytest.approx(max(want, 0.1 * sigma**2), rel=1e-9)


def test_risk_shares_add_up(spark, snaps):
    frame = spark.createDataFrame(snaps.reset_index().tail(3)[["bar", "tickers", "factors", "b", "f", "d"]].map(lambda v: v.tolist() if isinstance(v, np.ndarray) else v), "bar long, tickers array<string>, factors array<string>, b array<double>, f array<double>, d array<double>")
    held = frame.select("bar", F.explode("tickers").alias("ticker")).withColumn("weight", F.lit(0.3))
    sums = R.risk(frame, held).groupBy("bar").agg(F.sum("share").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)


def test_legs_earn_their_weights(spark):
    panel = P.synthetic_panel(spark, ["SPY", "QQQ", "TLT"], 460)
    scores = macd_score(panel)
    run = B.run_legs(B.leg_inputs(panel, scores), [B.Leg("a"), B.Leg("b", "buy_hold"), B.Leg("c", "rescaled")]).toPandas()
    assert set(run.leg) == {"a", "b", "c"}
    for _, leg in run.groupby("leg"):
        wide = leg.pivot(index="date", columns="ticker", values="price")
        equity = leg.groupby("date").equity.first()
        earned = (leg.pivot(index="date", columns="ticker", values="weight") * wide.pct_change()).sum(axis=1)
        np.testing.assert_allclose(equity.pct_change().dropna(), earned.iloc[1:], atol=1e-9)
    assert (run[run.leg == "a"].quantity != 0).any()
    curve = B.equity_curve(spark.createDataFrame(run[["leg", "date", "equity"]]))
    assert {r.leg for r in B.metrics(curve).collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        B.Leg("x", "other")


def test_buckets_add_up_and_regression(spark):
    draw = np.random.default_rng(1)
    x, f, ret, own = draw.normal(size=(4, 50))
    days = list(range(50))
    table = lambda names, *cols: spark.createDataFrame([tuple(c.item() if hasattr(c, "item") else c for c in r) for r in zip(*cols, strict=True)], names)
    one = ["Equity"] * 50
    got = B.edge_buckets(table("date int, factor string, exposure double", days, one, x), table("date int, factor string, value double", days, one, f), table("date int, ret double", days, ret), table("date int, specific double", days, own)).toPandas().sort_values("date")
    np.testing.assert_allclose(got[list(B.BUCKETS)].sum(axis=1), ret)
    assert got.timing.sum() == pytest.approx(50 * np.cov(x, f, ddof=0)[0, 1])
    rows = table("y double, f double", 0.5 + 2 * f, f)
    found = {r.term: r for r in B.regression(rows, "y", ["f"]).collect()}
    assert found["f"].beta == pytest.approx(2) and found["alpha"].beta == pytest.approx(0.5) and found["f"].r2 == pytest.approx(1)
    assert B.regression(rows.limit(2), "y", ["f"]).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    panel = P.synthetic_panel(spark, ["A", "B"], 380)
    rows = panel.toPandas()
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for k, part in enumerate((rows[rows.date < "2020-09-01"], rows[rows.date >= "2020-09-01"])):
        spark.createDataFrame(part, P.PANEL).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(P.PANEL).option("maxFilesPerTrigger", 1).parquet(source)
        feature_stream(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(sink).toPandas().sort_values(["ticker", "date"])
    want = return_vol(panel).join(macd_score(panel), ["date", "ticker"], "left").join(feature_panel(panel), ["date", "ticker"]).toPandas().sort_values(["ticker", "date"])
    assert len(got) == len(want) == 760
    np.testing.assert_allclose(got.vol.astype(float), want.vol.astype(float), rtol=1e-7)
    for name in ("score", *MOMENTS, *TRENDS):
        np.testing.assert_allclose(got[name].astype(float), want[name].astype(float), rtol=1e-6, atol=1e-9)
        assert got[name].notna().any()


def test_covariance_stream_equals_batch(spark, tmp_path, prices):
    rows = prices[prices.date < "2020-04-01"]
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[rows.date < "2020-02-10"], rows[rows.date >= "2020-02-10"]):
        spark.createDataFrame(part, P.PANEL).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(P.PANEL).option("maxFilesPerTrigger", 1).parquet(source)
        covariance_stream(stream, span=20, periods=10).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    panel = spark.createDataFrame(rows, P.PANEL)
    bars = P.bar_numbers(panel)
    returns = P.with_returns(panel).join(bars, "date").select("bar", "ticker", F.col("log_return").alias("value"))
    want = ewm_covariance(returns, span=20, periods=10).join(bars, "bar").toPandas()
    got = spark.read.parquet(sink).toPandas()
    want = want[want.date < rows.date.max()]  # the last bar is still open
    both = want.merge(got, on=["date", "i", "j"], suffixes=("", "_stream"))
    assert len(both) == len(want) == len(got)
    assert (both.n == both.n_stream).all()
    np.testing.assert_allclose(both["cov"].astype(float), both.cov_stream.astype(float), rtol=1e-9)


def test_closed_bars_wait_for_their_rows(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda d, h: datetime(2020, 1, d, h)
    for part in ([(day(1, 1), "A", 1.0), (day(1, 5), "B", 3.0)], [(day(3, 1), "A", 5.0)], [(day(1, 9), "C", 9.0), (day(9, 1), "A", 1.0)], [(day(12, 1), "A", 1.0)]):
        spark.createDataFrame(part, P.PANEL).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(P.PANEL).parquet(source)
        closed_bars(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {r.bar.day: (r.tickers, r.mean_close) for r in spark.read.parquet(sink).collect()}
    assert got[1] == (2, 2.0) and got[3] == (1, 5.0)  # the late row of the closed first bar is dropped


def test_state_survives_storage():
    a = TickerState()
    for c in np.linspace(100, 120, 90):
        a.update(float(c))
    b = TickerState(a.stored())
    assert a.update(121.0) == b.update(121.0)


def test_scaled_weights_and_l1():
    w = np.array([[1.0, 1.0], [1.0, 0.0], [-1.0, 0.0]])
    np.testing.assert_allclose(M.scaled_weights(w, np.array([True, False, True])), [[2, 1], [0, 0], [-1, 0]])
    np.testing.assert_allclose(M.scaled_weights(w, np.array([True, True, False]))[:, 0], 0)
    assert np.abs(M.onto_l1(np.array([3.0, -2.0, 0.1]), 1.0)).sum() == pytest.approx(1)


def test_a_book_survives_negative_equity():
    """After a bar of negative equity no return is counted until there is a positive one, from the last positive one."""
    book = B.Book(B.Leg("x", "rescaled"))
    book.held, book.cash, book.counted = {"A": 2}, 100.0, 300.0
    bar = lambda p: [{"ticker": "A", "price": p, "score": None, "vol": None}]
    assert book.step(bar(100.0), None)["equity"] == 300.0 and book.own.n == 1
    book.held = {"A": -5}
    assert book.step(bar(90.0), None)["equity"] == -350.0 and book.own.n == 1 and book.counted == 300.0
    book.cash = 800.0
    assert book.step(bar(120.0), None)["equity"] == 200.0
    assert book.own.n == 2 and book.own.x == pytest.approx(math.log(200 / 300))


def test_binding_names_the_limit(spark):
    rows = spark.createDataFrame([(0.1, 1.0, "linear"), (0.1, 0.5, "linear"), (0.05, 1.0, "linear"), (0.05, 0.5, "linear"), (0.05, 0.5, "mean_variance"), (0.099995, 0.99995, "linear")], "v double, g double, o string")
    got = [r.b for r in rows.select(B.binding(F.col("v"), F.col("g"), F.lit(0.1), F.lit(1.0), F.col("o")).alias("b")).collect()]
    assert got == ["both", "vol", "leverage", "turnover", "interior", "both"]


FACTOR_FILE = {"factors": [{"name": "Market", "level": 1, "weights": {"MKT": 1.0}}, {"name": "Spread", "level": 2, "granular": True, "weights": {"A": 1.0, "B": -1.0}}]}


def config_file(tmp_path, **changes):
    (tmp_path / "factors.json").write_text(json.dumps(FACTOR_FILE))
    model = {"factors_file": str(tmp_path / "factors.json"), "granular": True, "vol_span": 20, "corr_span": 40, "corr_min_periods": 30, "momentum": {"lookback": 20, "skip": 2}, "eigen_adjustment": {"simulations": 5, "refresh_every": 10}}
    raw = {"name": "Trend", "data": str(tmp_path / "panel"), "tickers": ["A", "B", "C"], "portfolio": "optimized", "max_gross": 2.0, "factor_model": model, "optimizer": {"factor_bounds": {"Spread": [-0.3, 0.3]}}} | changes
    path = tmp_path / "config.json"
    path.write_text(json.dumps(raw))
    return path


@pytest.mark.parametrize(
    ("changes", "message"),
    [
        ({"portfolio": "other"}, "portfolio must be one of"),
        ({"factor_model": None}, "needs a factor_model"),
        ({"factor_model": {"factors_file": "x"}}, "granular true"),
        ({"factor_model": {"granular": True}}, "needs factors_file"),
        ({"factor_model": {"factors_file": "x", "idiosyncratic_risk": "none"}}, "idiosyncratic_risk must be one of"),
        ({"factor_model": {"factors_file": "x", "eigen_adjustment": {"scale": -1}}}, "scale must be at least 0"),
        ({"factor_model": {"factors_file": "x", "eigen_adjustment": {"window": 1}}}, "window must be at least 2"),
        ({"optimizer": {"objective": "mean_variance"}}, "risk_aversion must be positive"),
        ({"optimizer": {"objective": "cubic"}}, "objective must be one of"),
        ({"optimizer": {"factor_bounds": {"Market": [1]}}}, "two numbers"),
        ({"optimizer": 3}, "not an object"),
        ({"colour": 1}, "unknown keys colour"),
    ],
)
def test_configs_are_checked(tmp_path, changes, message):
    with pytest.raises(ValueError, match=message):
        read_backtest(config_file(tmp_path, **changes))


def test_broken_config_names_its_file(tmp_path):
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError, match="bad.json"):
        read_backtest(tmp_path / "bad.json")
    legs = read_backtest(config_file(tmp_path, portfolio="rescaled_target_vol", cost_bps=2.0)).legs()
    assert [(leg.kind, leg.max_gross, leg.cost_bps) for leg in legs] == [("rescaled", 2.0, 2.0), ("buy_hold", 1.0, 2.0)]


@pytest.fixture(scope="module")
def long_prices():
    draw = np.random.default_rng(8)
    market = draw.normal(0, 0.01, 440)
    rows = [pd.DataFrame({"date": pd.date_range("2020-01-01", periods=440), "ticker": n, "close": 100 * np.exp(np.cumsum(b * market + (draw.normal(0, 0.006, 440) if n != "MKT" else 0)))}) for n, b in zip(NAMES, (1.0, 1.5, 0.5, -0.5), strict=True)]
    rows = pd.concat(rows)
    return rows[~((rows.ticker == "C") & (rows.date.dt.dayofyear % 9 == 3))]


@pytest.fixture(scope="module")
def ran(spark, long_prices, tmp_path_factory):
    path = config_file(tmp_path_factory.mktemp("run"))
    config = read_backtest(path)
    return config, run_backtest(spark, config, spark.createDataFrame(long_prices, P.PANEL))


def test_an_optimised_run_stays_within_its_limits(ran):
    config, run = ran
    log = run.solves.toPandas()
    assert len(log) > 300 and (log.status == "optimal").mean() > 0.95
    assert (log.gross <= 2 + 1e-6).all() and (log.ex_ante_vol <= 0.15 * (1 + 1e-6)).all()
    assert set(log.binding) <= {"both", "vol", "leverage", "turnover", "none"}
    trades = run.trades.where(F.col("leg") == config.name).toPandas()
    assert len(trades) and (trades.quantity > 0).all() and set(trades.side) == {"BUY", "SELL"} and trades.note.str.startswith("weight=").all()


def test_bounds_hold_and_unknown_ones_fail(spark, ran, long_prices):
    config, run = ran
    panel = spark.createDataFrame(long_prices, P.PANEL)
    panel = panel.where(F.col("ticker").isin(config.tickers))
    factors = P.read_factors(spark, config.factor_model.factors_file, True)
    snaps = optimised_snapshots(panel, config.factor_model.model(config.tickers, factors)).toPandas()
    targets = {r.date: {h.ticker: h.target for h in r.held} for r in run.folded.where(F.col("leg") == config.name).collect()}
    seen = 0
    for s in snaps.itertuples():
        if "Spread" in list(s.factors) and all(targets[s.date.date()].get(t) is not None for t in s.tickers):
            b = np.reshape(s.b, (len(s.tickers), -1))[:, list(s.factors).index("Spread")]
            assert abs(sum(x * targets[s.date.date()][t] for x, t in zip(b, s.tickers, strict=True))) <= 0.3 + 1e-4
            seen += 1
    assert seen > 300
    frame = spark.createDataFrame([(["Market", "Spread"],), (["Market"],)], "factors array<string>")
    assert B.unknown_bounds(["Market"], frame) == [] and B.unknown_bounds(["Spread", "Gold", "Market"], frame) == ["Gold", "Spread"]
    with pytest.raises(ValueError, match="unknown factors: Gold"):
        B.fold_legs(spark.createDataFrame([], "date date, ticker string, price double, score double, vol double"), [B.Leg("x", "optimized", bounds={"Gold": (0, 1)})], frame)


def test_the_optimiser_sees_sticky_prices(spark, long_prices):
    panel = spark.createDataFrame(long_prices, P.PANEL)
    sticky = sticky_panel(panel)
    assert sticky.count() == 440 * 4 and panel.count() < 440 * 4
    ahead = P.with_returns(sticky).where("ticker = 'C' and log_return = 0").count()
    assert ahead == 440 * 4 - panel.count()


def test_attribution_adds_up(spark, ran, long_prices):
    config, run = ran
    found = run.attribution
    bars, rows = found.bars.toPandas(), found.factors.toPandas()
    assert set(bars.leg) == {config.name, "Buy & Hold"} and {"Market", "Spread", R.MOMENTUM} <= set(rows.factor)
    parts = A.contributions(found).toPandas()
    sums = parts.groupby(["leg", "date"]).value.sum()
    np.testing.assert_allclose(bars.set_index(["leg", "date"]).ret, sums.reindex(bars.set_index(["leg", "date"]).index), atol=1e-12)
    order = A.annual_contributions(found).toPandas()
    assert (order.groupby("leg").factor.last() == A.RESIDUAL).all()
    shares = rows.groupby(["leg", "date"]).share.sum() + bars.set_index(["leg", "date"]).own_share
    live = bars.set_index(["leg", "date"]).predicted > 0
    np.testing.assert_allclose(shares[live], 1)
    edge = A.buckets(found).toPandas().set_index(["leg", "date"])
    ret = bars.set_index(["leg", "date"]).ret.reindex(edge.index)
    np.testing.assert_allclose(edge[list(B.BUCKETS)].sum(axis=1), ret, atol=1e-12)
    # timing sums to T times the covariance of exposure and factor return
    leg = A.dense(found).where(F.col("leg") == config.name).toPandas()
    summary = A.factor_summary(found).where(F.col("leg") == config.name).toPandas().set_index("factor")
    for name, own in leg.groupby("factor"):
        assert summary.timing[name] / 252 * len(own) == pytest.approx(len(own) * np.cov(own.exposure, own.value, ddof=0)[0, 1], abs=1e-12)
    fit = A.factor_regression(found).toPandas()
    simple = np.expm1(bars[bars.leg == config.name].ret).mean() * 252
    assert fit[fit.leg == config.name].contribution.sum() == pytest.approx(simple, abs=1e-9)


def test_attribution_is_that_of_a_plain_replay(spark, ran, long_prices):
    """Snapshot of the bar before, weights and returns of the bar, one bar after the other."""
    config, run = ran
    panel = spark.createDataFrame(long_prices, P.PANEL)
    factors = P.read_factors(spark, config.factor_model.factors_file, True)
    names = P.universe(config.tickers, factors)
    assert names == ["A", "B", "C", "MKT"]
    snaps = {r.bar: r for r in R.snapshots(panel, config.factor_model.model(names, factors)).collect()}
    held = {(r.date, r.ticker): r.weight for r in B.holdings(run.folded).where("leg = 'Buy & Hold'").collect()}
    got = {r.date: r for r in run.attribution.bars.where("leg = 'Buy & Hold'").collect()}
    last, seen = {}, 0
    for bar, (date, day) in enumerate(long_prices.sort_values("date").groupby("date"), 1):
        closes = dict(zip(day.ticker, day.close, strict=True))
        r = {t: math.log(c / last[t]) for t, c in closes.items() if t in last}
        if bar - 1 in snaps and date.date() in got and R.MOMENTUM not in snaps[bar - 1].factors:
            s = snaps[bar - 1]
            w = np.array([held.get((date.date(), t), 0.0) for t in s.tickers])
            b, f = np.reshape(s.b, (len(w), -1)), np.reshape(s.f, (len(s.factors), -1))
            move = np.array([r.get(t, 0.0) for t in s.tickers])
            value = np.reshape(s.w, (len(w), -1)).T @ move
            assert got[date.date()].specific == pytest.approx(w @ move - (b.T @ w) @ value, abs=1e-12)
            assert got[date.date()].predicted == pytest.approx(math.sqrt((b.T @ w) @ f @ (b.T @ w) + np.array(s.d) @ w**2), rel=1e-9)
            seen += 1
        last.update(closes)
    assert seen > 20 and min(got) > min(long_prices.date).date()


def test_report_tables_are_written(spark, ran, tmp_path):
    config, run = ran
    tables = report_tables(run, True)
    wanted = {"metrics", "monthly", "correlation", "trades", "solves", "optimizer", "exposures", "risk", "volatility", "returns", "edge", "timing", "regression", "health", "rolling_bias", "factors"}
    assert set(tables) == wanted
    write_report({n: tables[n] for n in ("optimizer", "health", "factors", "correlation")}, str(tmp_path))
    cells = {(r.leg, r.metric): r.value for r in spark.read.parquet(f"{tmp_path}/optimizer").collect()}
    assert cells[config.name, "Max gross"].endswith("x") and any(k[1].startswith("Binding: ") for k in cells)
    assert {r.factor: r.weights for r in spark.read.parquet(f"{tmp_path}/factors").collect()}["Spread"] == "A +1.00, B -1.00"
    assert spark.read.parquet(f"{tmp_path}/correlation").count() == 1


def test_model_covariance_and_collinearity(spark, snaps):
    frame = snaps.reset_index().tail(2)
    frame = spark.createDataFrame(frame.map(lambda v: v.tolist() if isinstance(v, np.ndarray) else v)[["bar", "tickers", "factors", "b", "f", "d", "sigma", "beta", "m"]], "bar long, tickers array<string>, factors array<string>, b array<double>, f array<double>, d array<double>, sigma array<double>, beta array<double>, m array<double>")
    last = snaps.iloc[-1]
    b = np.reshape(last.b, (len(last.tickers), -1))
    want = b @ np.reshape(last.f, (b.shape[1], -1)) @ b.T + np.diag(last.d)
    got = {(r.i, r.j): r["cov"] for r in R.covariances(frame).where(f"bar = {snaps.index[-1]}").collect()}
    assert len(got) == len(last.tickers) * (len(last.tickers) + 1) // 2
    for i, x in enumerate(last.tickers):
        for j, y in enumerate(last.tickers):
            assert got[min(x, y), max(x, y)] == pytest.approx(want[i, j])
    rows = B.collinearity(frame).where(f"bar = {snaps.index[-1]}").collect()
    assert [r.factor for r in rows] == ["Market"]
    assert rows[0].corr == pytest.approx(np.corrcoef(last.m, np.reshape(last.beta, (len(last.tickers), -1))[:, 0])[0, 1])


def test_residual_correlations_may_exceed_one(spark):
    """A specific variance that is too small for the covariance beside the factors shows as a correlation beyond 1."""
    row = (1, ["A", "B", "C"], [0.0, 0.0, 1.0], [1.0], [0.04, 0.04, 0.01], [0.2, 0.2, 1.0])
    frame = spark.createDataFrame([row], "bar long, tickers array<string>, b array<double>, f array<double>, d array<double>, sigma array<double>")
    whole = [1.0, 0.0, 0.0, 0.0, 0.04, 0.05, 0.0, 0.05, 0.04]
    cov = spark.createDataFrame([(1, ["C", "A", "B"], whole)], "bar long, axis array<string>, s array<double>")
    assert [(r.i, r.j, r.corr) for r in B.residual_correlations(frame, cov).collect()] == [("A", "B", pytest.approx(1.25))]
    assert {(r.ticker, r.masked) for r in B.residual_shares(frame, cov).collect()} == {("A", False), ("B", False), ("C", True)}


def test_decayed_sums_read_their_input_once(spark):
    from tidemark.operators.ewm import ewm_moments

    spark.range(3000).selectExpr("cast(id % 3 as string) as ticker", "id as date", "sin(id) as v").write.mode("overwrite").saveAsTable("decayed_once")
    try:
        rows = ewm_moments(spark.table("decayed_once"), ["ticker"], "date", "v", "m", "s", span=20)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1
        want = pd.DataFrame({"t": np.arange(3000) % 3, "v": np.sin(np.arange(3000))}).groupby("t").v.apply(lambda v: v.ewm(span=20, min_periods=20).std())
        got = rows.toPandas().sort_values(["ticker", "date"])
        np.testing.assert_allclose(got.s.astype(float), want.to_numpy(), rtol=1e-8)
    finally:
        spark.sql("drop table decayed_once")


def test_buy_and_hold_in_windows_equals_a_replay(spark):
    """Against a plain loop: whole shares on the first bar, a ticker that starts later is not bought, gaps keep the last price."""
    draw = np.random.default_rng(5)
    rows = [(datetime(2020, 1, 1) + timedelta(days=d), t, 50.0 + 10 * k + float(draw.normal())) for d in range(30) for k, t in enumerate("ABC") if not (t == "C" and d < 4) and not (t == "B" and d in (7, 8))]
    leg = B.Leg("h", "buy_hold", cash=10_000.0, cost_bps=3.0)
    panel = spark.createDataFrame(rows, P.PANEL)
    folded = B.fold_legs(B.sticky_prices(panel), [leg])
    got = {(r.date, r.ticker): r for r in B.holdings(folded).collect()}
    days = sorted({r[0] for r in rows})
    last, cash, shares, before, equity_before = {}, leg.cash, {}, {}, None
    for day in days:
        last |= {t: c for d, t, c in rows if d == day}
        equity = cash + sum(n * last[t] for t, n in shares.items())
        weights = {t: shares.get(t, 0) * before[t] / equity_before if equity_before and t in before else 0.0 for t in last}
        ordered = {} if shares else {t: round(1 / len(last) * equity / c) for t, c in last.items()}
        for t, n in ordered.items():
            shares[t] = n
            cash -= n * last[t] + n * last[t] * 3e-4
        for t, c in last.items():
            r = got.pop((day.date(), t))
            assert (r.price, r.quantity, r.ordered) == (c, shares.get(t, 0), ordered.get(t, 0))
            assert (r.weight, r.equity, r.cash) == pytest.approx((weights[t], equity, cash))
        before, equity_before = dict(last), equity
    assert not got
    assert "MapInArrow" not in folded._jdf.queryExecution().toString()
    assert {r.ticker for r in B.trade_log(folded).collect()} == {"A", "B"}
    assert B.trade_log(B.fold_legs(B.sticky_prices(panel), [B.Leg("none", "buy_hold", cash=0.0)])).count() == 0
    both = B.fold_legs(B.leg_inputs(panel, macd_score(panel)), [B.Leg("t"), leg]).groupBy("leg").count().collect()
    assert {(r.leg, r["count"]) for r in both} == {("t", 30), ("h", 30)}


def test_volatility_counts_scored_or_held_bars(spark):
    """Scored on every second bar: until the 61st score only those bars count, then all."""
    draw = np.random.default_rng(6)
    closes = 100 + np.cumsum(draw.normal(size=200))
    days = [datetime(2020, 1, 1) + timedelta(days=d) for d in range(200)]
    panel = spark.createDataFrame([(d, "A", float(c)) for d, c in zip(days, closes, strict=True)], P.PANEL)
    scores = spark.createDataFrame([(d, "A", 0.5) for d in days[10::2]], "date timestamp, ticker string, score double")
    got = {r.date: r.vol for r in B.traded_vol(panel, scores).collect()}
    full = 10 + 2 * 60
    counted = [*range(10, full + 1, 2), *range(full + 1, 200)]
    r = pd.Series(np.diff(np.log(closes[counted])))
    want = r.ewm(span=60, min_periods=60).std()
    assert len(got) == len(counted) - 1
    for at, v in zip(counted[1:], want, strict=True):
        assert (got[days[at]] is None) == np.isnan(v)
        assert np.isnan(v) or got[days[at]] == pytest.approx(v)
    assert got[days[full]] is not None


def test_column_correlations_and_clip_rates(spark):
    draw = np.random.default_rng(7)
    frame = pd.DataFrame(draw.normal(size=(400, 3)), columns=list("abc"))
    frame.loc[:9, "b"] = np.nan
    frame.loc[200, "a"] = 60.0
    rows = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in frame.to_numpy()], "a double, b double, c double")
    got = {(r.i, r.j): (r["corr"], r.n) for r in column_correlation(rows, list("abc")).collect()}
    assert {k: n for k, (_, n) in got.items()} == {("a", "b"): 390, ("a", "c"): 400, ("b", "c"): 390}
    for (i, j), (corr, _) in got.items():
        assert corr == pytest.approx(frame[i].corr(frame[j]))
    long = spark.createDataFrame([(k, "T", c, float(v)) for c in "ac" for k, v in enumerate(frame[c])], "date int, ticker string, feature string, value double")
    rates = {(r.halflife, r.width, r.feature): r.rate for r in clip_rates(long, (21, 31), (2.0, 5.0)).collect()}
    for (h, w, c), rate in rates.items():
        clipped = winsorised(long.where(F.col("feature") == c), "value", "clipped", halflife=h, width=w, keys=("ticker", "feature")).where("clipped != value").count()
        assert rate == pytest.approx(clipped / 400)
    assert len(rates) == 8 and rates[21, 5.0, "a"] > 0
