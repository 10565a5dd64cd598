"""The factor risk model of every bar as a graph of parallel stages.

Covariances come from one scan by blocks for both spans; each later stage is a map over dates without state, joined with the results of the
bar before or with short series of scalars. No bar waits for another: no estimate feeds back into its own inputs.
Matrices are arrays of doubles, row by row, beside their axes; covariances of all tickers come as bytes, a row a pair of blocks and bar.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import matrices as M
from ..functions.lineage import settled
from ..operators import gram as G
from ..operators.eigen import draw_moments
from ..operators.ewm import alpha, ewm_moments
from ..sources.panel import bar_numbers, good_ticks, with_returns

MOMENTUM = "Momentum"


@dataclass(frozen=True)
class Config:
    tickers: tuple[str, ...]
    #: (name, level, weights by ticker), in the order of levels.
    factors: tuple[tuple[str, int, dict], ...]
    vol_span: int = 60
    corr_span: int = 250
    corr_periods: int = 250
    floor: float = 0.1
    measured: bool = True
    lookback: int = 252
    skip: int = 21
    eigen: bool = True
    eigen_scale: float = 1.4
    simulations: int = 200
    window: int | None = None
    refresh: int = 21
    seed: int = 0
    weights: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        levels = [level for _, level, _ in self.factors]
        if levels != sorted(levels) or len({n for n, _, _ in self.factors}) != len(levels) or not all(w for _, _, w in self.factors):
            raise ValueError("factors need names of their own, weights, and the order of their levels")
        object.__setattr__(self, "weights", np.array([[w.get(t, 0.0) for _, _, w in self.factors] for t in self.tickers]))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


def records(batch: pa.RecordBatch) -> list[dict]:
    """The rows of a batch; arrays of doubles are numpy views of its buffers."""
    columns = []
    for c in batch.columns:
        if c.type == _ARROW["array<double>"]:
            edges, flat, known = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False), c.is_valid().to_pylist()
            columns.append([flat[a:b] if k else None for a, b, k in zip(edges[:-1], edges[1:], known, strict=True)])
        else:
            columns.append(c.to_pylist())
    return [dict(zip(batch.schema.names, row, strict=True)) for row in zip(*columns, strict=True)]


def _fields(schema: str) -> tuple[list[str], list[pa.DataType]]:
    parts = [f.split() for f in schema.split(", ")]
    return [n for n, _ in parts], [_ARROW[t] for _, t in parts]


def _maps(frame: DataFrame, kernel, schema: str) -> DataFrame:
    """One output row, or none, for each input row."""

    def run(batches):
        names, kinds = _fields(schema)
        for part in batches:
            found = [r for r in map(kernel, records(part)) if r is not None]
            yield pa.record_batch([pa.array([r[n] for r in found], t) for n, t in zip(names, kinds, strict=True)], names)

    return frame.mapInArrow(run, schema)


def spread_rows(frame: DataFrame, kernel, schema: str) -> DataFrame:
    """Several output rows, as columns of equal length, for each input row; or none."""

    def run(batches):
        names, kinds = _fields(schema)
        for part in batches:
            for found in map(kernel, records(part)):
                if found is not None and len(found[0]):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(found, kinds, strict=True)], names)

    return frame.mapInArrow(run, schema)


def _matrix(values: np.ndarray, rows: int) -> np.ndarray:
    return np.asarray(values, dtype=float).reshape(rows, -1)


def _carried_on(rows: DataFrame, keys: list[str], last: int) -> DataFrame:
    """Each row on its own bar and on all later ones before the next row of its keys."""
    until = F.coalesce(F.lead("bar").over(Window.partitionBy(*keys).orderBy("bar")) - 1, F.lit(last))
    return rows.withColumn("__until", until).withColumn("bar", F.explode(F.sequence("bar", "__until"))).drop("__until")


def bar_inputs(panel: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """Returns (bar, ticker, value), and a row a bar: bar, blocks of covariances of both spans, raw momentum."""
    panel = good_ticks(panel.where(F.col("ticker").isin(list(config.tickers))))
    bars = settled(bar_numbers(panel))
    order = Window.partitionBy("ticker").orderBy("date")
    rows = with_returns(panel).withColumn("raw", F.log(F.lag("close", config.skip).over(order) / F.lag("close", config.lookback).over(order)))
    rows = rows.join(bars, "date").select("bar", "ticker", F.col("log_return").alias("value"), "raw")
    rows = settled(rows)
    returns = rows.select("bar", "ticker", "value").where("value is not null")
    last = bars.count()
    pairs = G.by_bar(packed_inputs(returns, config, last))
    raw = _carried_on(rows.where("raw is not null").select("bar", "ticker", "raw"), ["ticker"], last)
    raw = raw.groupBy("bar").agg(F.map_from_entries(F.collect_list(F.struct("ticker", "raw"))).alias("raw"))
    return returns, pairs.join(raw, "bar", "left")


def packed_inputs(returns: DataFrame, config: Config, last: int) -> DataFrame:
    """packed_covariances() of the config's tickers: correlation span, then volatility span."""
    tickers = returns.sparkSession.createDataFrame([(t,) for t in config.tickers], "ticker string")
    return G.packed_covariances(returns, tickers, G.Spec((config.corr_span, config.vol_span), (config.corr_periods, config.vol_span)), last)


def both_spans(blocks: list[dict], tickers: tuple[str, ...]) -> np.ndarray:
    """(correlation and volatility span, tickers, tickers) of a bar, in the order of ``tickers``; a pair is known by both spans or not at all."""
    place = np.argsort(np.argsort(np.array(tickers)))
    found = G.unpacked([(b["lo"], b["hi"], b["cov"]) for b in blocks], 2, len(tickers))[:, place[:, None], place[None]]
    return np.where(np.isnan(found).any(0), np.nan, found)


def correlation_inputs(panel: DataFrame, config: Config) -> DataFrame:
    """(bar, axis, s): the covariances of the correlation span of each bar over all tickers, a matrix row by row."""

    def kernel(row):
        return {"bar": row["bar"], "axis": list(config.tickers), "s": both_spans(row["blocks"], config.tickers)[0].ravel()}

    return _maps(bar_inputs(panel, config)[1].select("bar", "blocks"), kernel, "bar long, axis array<string>, s array<double>")


BLOCK = "bar long, tickers array<string>, factors array<string>, s array<double>, sigma array<double>, w array<double>, beta array<double>, f array<double>, g array<double>, m array<double>"


def macro_blocks(inputs: DataFrame, config: Config) -> DataFrame:
    """The live universe, residual factor weights, betas, factor covariance, vol ratios and momentum exposure of each bar."""

    def kernel(row):
        tickers = list(config.tickers)
        s, v = both_spans(row["blocks"], config.tickers)
        warm = np.flatnonzero((np.nan_to_num(np.diag(s)) > 0) & (np.nan_to_num(np.diag(v)) > 0))
        live = warm[np.isfinite(s[np.ix_(warm, warm)]).all(1)]
        if len(live) < 2:
            return None
        raw = M.scaled_weights(config.weights, np.isin(np.arange(len(tickers)), live))[live]
        active = np.flatnonzero((raw != 0).any(0))
        if not len(active):
            return None
        s, v = s[np.ix_(live, live)], v[np.ix_(live, live)]
        levels = np.array([config.factors[k][1] for k in active])
        w = M.residual_weights(raw[:, active], levels, s)
        f = M.positive(w.T @ s @ w)
        beta = s @ w @ np.linalg.pinv(f)
        g = M.vol_ratio(np.einsum("ik,ij,jk->k", w, v, w), np.diag(f))
        sigma, names = np.sqrt(np.diag(v)), [tickers[k] for k in live]
        known = dict(row["raw"]) if row["raw"] is not None else {}
        has = [k for k, t in enumerate(names) if t in known and sigma[k] > 0]
        m, scores = None, M.robust_scores(np.array([known[names[k]] / sigma[k] for k in has]))
        if scores is not None:
            exposure = np.zeros(len(names))
            exposure[has] = scores
            m = M.residual_exposure(exposure, beta, np.sqrt(np.diag(s)))
        return {"bar": row["bar"], "tickers": names, "factors": [config.factors[k][0] for k in active], "s": np.diag(s), "sigma": sigma, "w": w.ravel(), "beta": beta.ravel(), "f": f.ravel(), "g": g, "m": m}

    return _maps(inputs, kernel, BLOCK)


def _momentum_return(row, r: np.ndarray) -> float:
    m, beta, w = row["m"], _matrix(row["beta"], len(r)), _matrix(row["w"], len(r))
    size = m @ m
    return float(m @ (r - beta @ (w.T @ r)) / size) if size else 0.0


def _next_returns(frame: DataFrame, returns: DataFrame) -> DataFrame:
    """Each bar's row beside the returns of the bar after it, as ``next``; null if none traded."""
    maps = returns.groupBy("bar").agg(F.map_from_entries(F.collect_list(F.struct("ticker", "value"))).alias("next"))
    return frame.join(maps.withColumn("bar", F.col("bar") - 1), "bar", "left")


def _vector(row) -> np.ndarray:
    held = dict(row["next"]) if row["next"] is not None else {}
    return np.array([held.get(t, 0.0) for t in row["tickers"]])


def momentum_states(blocks: DataFrame, returns: DataFrame, bars: DataFrame, config: Config) -> DataFrame:
    """(bar, long, short): deviations of the momentum factor's return up to each bar, carried on."""
    rows = _next_returns(blocks.where("m is not null"), returns)
    last = bars.agg(F.max("bar").alias("last"))
    series = _maps(rows, lambda row: {"bar": row["bar"] + 1, "value": _momentum_return(row, _vector(row))}, "bar long, value double")
    series = series.join(last, F.col("bar") <= F.col("last")).select("bar", "value", F.lit(0).alias("one"))
    long = ewm_moments(series, ["one"], "bar", "value", "__a", "long", span=config.corr_span, periods=config.vol_span).select("bar", "long")
    short = ewm_moments(series, ["one"], "bar", "value", "__b", "short", span=config.vol_span, periods=config.vol_span).select("bar", "short")
    held = Window.orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.select("bar").join(long.join(short, "bar"), "bar", "left")
    return rows.select("bar", F.last("long", True).over(held).alias("long"), F.last("short", True).over(held).alias("short"))


LOADED = "bar long, tickers array<string>, factors array<string>, k int, sigma array<double>, w array<double>, beta array<double>, m array<double>, b array<double>, f array<double>, g array<double>, implied array<double>, spectrum array<double>"


def loadings(blocks: DataFrame, states: DataFrame, config: Config) -> DataFrame:
    """With momentum appended once its variance is warm, rows capped, and the implied specific variance."""

    def kernel(row):
        n = len(row["tickers"])
        b, f, g, names = _matrix(row["beta"], n), _matrix(row["f"], len(row["factors"])), row["g"], list(row["factors"])
        own, sigma, long = row["s"], row["sigma"], row["long"]
        if row["m"] is not None and long is not None and np.isfinite(long) and long > 0:
            b = np.column_stack((b, row["m"]))
            f = np.block([[f, np.zeros((len(f), 1))], [np.zeros((1, len(f))), np.array([[long**2]])]])
            short = row["short"]
            g = np.append(g, M.vol_ratio(np.array([short**2]), np.array([long**2])) if short is not None and np.isfinite(short) else 1.0)
            names.append(MOMENTUM)
        b, common = M.capped(b, f, own)
        scale = sigma / np.sqrt(own)
        implied = np.maximum(config.floor * own, own - common) * scale**2
        b = b * scale[:, None] / g
        return {"bar": row["bar"], "tickers": row["tickers"], "factors": names, "k": len(names), "sigma": sigma, "w": row["w"], "beta": row["beta"], "m": row["m"], "b": b.ravel(), "f": f.ravel(), "g": g, "implied": implied, "spectrum": np.linalg.eigvalsh(f)}

    return _maps(blocks.join(states, "bar"), kernel, LOADED)


def _bias(row: dict) -> dict:
    size = np.sqrt(np.maximum(row["spectrum"], 0.0))
    return {"island": row["island"], "turn": row["turn"], "bias": M.bias_of(row["spectrum"], row["draws"].reshape(-1, row["k"], row["k"]) * np.outer(size, size))}


def eigen_biases(loaded: DataFrame, config: Config) -> DataFrame:
    """(bar, bias): simulated at every ``refresh``-th ready bar and when the number of factors changes, and used until the next.

    The unit draws are summed up once for each number of factors and scaled for each bar's spectrum.
    """
    order = Window.orderBy("bar")
    rows = loaded.select("bar", "k").withColumn("new", (F.col("k") != F.lag("k", 1, -1).over(order)).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("island").orderBy("bar")) - 1
    rows = rows.withColumn("turn", F.floor(place / config.refresh)).withColumn("first", place % config.refresh == 0)
    spark, window = loaded.sparkSession, config.window or 3 * config.corr_span
    decay = 1 - alpha(span=config.corr_span)
    due = settled(rows.where("first").select("bar", "island", "turn", "k").join(loaded.select("bar", "spectrum"), "bar"))
    sizes = [r.k for r in due.select("k").distinct().collect()]  # a handful: factors, with momentum or without
    found = None
    for k in sizes:
        draws = draw_moments(spark, k, seed=config.seed, simulations=config.simulations, window=window, decay=decay)
        draws = draws.groupBy().agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("simulation", "s"))), lambda x: x["s"])).alias("draws"))
        spread = due.where(F.col("k") == k).repartition(max(2, spark.sparkContext.defaultParallelism), "bar").crossJoin(F.broadcast(settled(draws)))
        part = _maps(spread.select("island", "turn", "k", "spectrum", "draws"), _bias, "island long, turn long, bias array<double>")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("bar", F.lit(None).cast("array<double>").alias("bias"))
    return rows.join(found, ["island", "turn"]).select("bar", "bias")


def residuals(loaded: DataFrame, returns: DataFrame) -> DataFrame:
    """(bar, ticker, eps): returns less what the loadings of the bar before explain, for the tickers that traded."""

    def kernel(row):
        if row["next"] is None:
            return None
        r, traded = _vector(row), dict(row["next"])
        eps = r - _matrix(row["b"], len(r)) @ _factor_returns(row, r)
        own = [k for k, t in enumerate(row["tickers"]) if t in traded]
        return [row["bar"] + 1] * len(own), [row["tickers"][k] for k in own], eps[own]

    return spread_rows(_next_returns(loaded, returns), kernel, "bar long, ticker string, eps double")


def _factor_returns(row, r: np.ndarray) -> np.ndarray:
    f = _matrix(row["w"], len(r)).T @ r
    return np.append(f, _momentum_return(row, r)) if MOMENTUM in list(row["factors"]) else f


SNAPSHOT = "bar long, tickers array<string>, factors array<string>, b array<double>, f array<double>, d array<double>, sigma array<double>, w array<double>, beta array<double>, m array<double>"


def snapshots(panel: DataFrame, config: Config) -> DataFrame:
    """One row for each bar with a ready model: covariance is B F B' + diag(D)."""
    returns, inputs = bar_inputs(panel, config)
    bars = settled(bar_numbers(good_ticks(panel.where(F.col("ticker").isin(list(config.tickers))))))
    blocks = settled(macro_blocks(inputs, config))
    states = settled(momentum_states(blocks, returns, bars, config))
    loaded = settled(loadings(blocks, states, config))
    rows = loaded.join(eigen_biases(loaded, config), "bar") if config.eigen else loaded.withColumn("bias", F.lit(None).cast("array<double>"))
    eps = settled(residuals(loaded, returns))
    spread = ewm_moments(eps, ["ticker"], "bar", "eps", "__m", "std", span=config.vol_span, periods=config.vol_span).select("bar", "ticker", "std")
    grid = loaded.select("bar", F.explode("tickers").alias("ticker"))
    held = Window.partitionBy("ticker").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    state = grid.join(spread, ["bar", "ticker"], "full").withColumn("std", F.last("std", True).over(held)).where("std is not null")
    state = state.groupBy("bar").agg(F.map_from_entries(F.collect_list(F.struct("ticker", "std"))).alias("stds"))

    def kernel(row):
        f, g = _matrix(row["f"], row["k"]), row["g"]
        if row["bias"] is not None:
            f = M.eigen_adjusted(f, row["bias"], config.eigen_scale)
        d, sigma = row["implied"], row["sigma"]
        if config.measured and row["stds"] is not None:
            stds = dict(row["stds"])
            var = np.array([stds.get(t, np.nan) for t in row["tickers"]]) ** 2
            d = np.where(np.isnan(var), d, np.maximum(config.floor * sigma**2, var))
        return {"bar": row["bar"], "tickers": row["tickers"], "factors": row["factors"], "b": row["b"], "f": (f * np.outer(g, g)).ravel(), "d": d, "sigma": sigma, "w": row["w"], "beta": row["beta"], "m": row["m"]}

    return _maps(rows.join(state, "bar", "left"), kernel, SNAPSHOT)


def factor_returns(snaps: DataFrame, returns: DataFrame) -> DataFrame:
    """(bar, factor, value): the return of each factor of the snapshot before on the bar's returns."""

    def kernel(row):
        if row["next"] is None:
            return None
        return [row["bar"] + 1] * len(row["factors"]), row["factors"], _factor_returns(row, _vector(row))

    return spread_rows(_next_returns(snaps, returns), kernel, "bar long, factor string, value double")


def risk(snaps: DataFrame, holdings: DataFrame) -> DataFrame:
    """(bar, factor, exposure, share, variance) of (bar, ticker, weight); the specific part is the factor ``RESIDUAL``.

    Holdings outside a snapshot's universe are dropped; shares are 0 for a book without variance.
    """
    maps = holdings.groupBy("bar").agg(F.map_from_entries(F.collect_list(F.struct("ticker", "weight"))).alias("held"))

    def kernel(row):
        held = dict(row["held"])
        x = np.array([held.get(t, 0.0) for t in row["tickers"]])
        load = _matrix(row["b"], len(x)).T @ x
        parts = load * (_matrix(row["f"], len(load)) @ load)
        own = float(row["d"] @ x**2)
        total = float(parts.sum() + own)
        share = np.append(parts, own) / total if total > 0 else np.zeros(len(parts) + 1)
        return [row["bar"]] * len(share), [*row["factors"], "RESIDUAL"], np.append(load, 0.0), share, [total] * len(share)

    return spread_rows(snaps.join(maps, "bar"), kernel, "bar long, factor string, exposure double, share double, variance double")


def covariances(snaps: DataFrame) -> DataFrame:
    """(bar, i, j, cov) for i <= j: each snapshot's full covariance B F B' + diag(D)."""

    def kernel(row):
        names = np.array(row["tickers"])
        order = np.argsort(names)
        b = _matrix(row["b"], len(names))[order]
        cov = b @ _matrix(row["f"], b.shape[1]) @ b.T + np.diag(row["d"][order])
        i, j = np.triu_indices(len(names))
        return [row["bar"]] * len(i), names[order][i], names[order][j], cov[i, j]

    return spread_rows(snaps, kernel, "bar long, i string, j string, cov double")
