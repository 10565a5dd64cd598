"""Exponentially weighted covariances by blocks: decayed Gram matrices of (block, block, chunk), carried over chunks by their decay.

Tickers are dealt into blocks of at most WIDTH places of one sorted axis, bars into chunks of CHUNK. A block's values of a chunk are one row, and
each pair of blocks of a chunk is one row: no row is a pair of tickers before the last step. A chunk's sums are products of
matrices; what earlier chunks leave of them is added up along the chunks, and then every chunk is expanded bar by bar
beside what it inherits, all chunks and pairs of blocks at once. Matrices are bytes of doubles, row by row; nothing is NaN but what is unknown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ewm import alpha

CHUNK, WIDTH = 256, 64
#: Sums of a pair and decay: weights, squared weights, x, y, x y.
SUMS = 5


@dataclass(frozen=True)
class Spec:
    """Spans and the observations that each needs before a covariance is told; all are computed in one scan."""

    spans: tuple[float, ...]
    periods: tuple[int, ...]

    def __post_init__(self):
        if min(self.periods) < 2 or len(self.periods) != len(self.spans):
            raise ValueError("a covariance needs two observations, and each span its periods")

    @property
    def decays(self) -> list[float]:
        return [1 - alpha(span=s) for s in self.spans]


def finite_returns(returns: DataFrame) -> DataFrame:
    return returns.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def axis_of(tickers: DataFrame) -> DataFrame:
    """(ticker, block, place): the sorted tickers dealt into blocks as even as possible; a row a ticker, by way of one task."""
    rows = tickers.select("ticker").distinct()
    order = Window.orderBy("ticker")
    rows = rows.withColumn("k", F.row_number().over(order) - 1).withColumn("all", F.count("*").over(Window.partitionBy()))
    blocks = F.ceil(F.col("all") / WIDTH)
    width = F.ceil(F.col("all") / blocks)
    return rows.select("ticker", F.floor(F.col("k") / width).cast("int").alias("block"), (F.col("k") % width).cast("int").alias("place"))


def value_blocks(returns: DataFrame, axis: DataFrame, last: int) -> DataFrame:
    """(chunk, block, width, x): the values of each block and chunk as a (CHUNK, width) matrix; also for those without any."""
    cell = F.struct(((F.col("bar") - 1) % CHUNK).cast("int").alias("row"), "place", "value")
    held = returns.join(axis, "ticker").withColumn("chunk", F.floor((F.col("bar") - 1) / CHUNK).cast("int"))
    held = held.groupBy("chunk", "block").agg(F.collect_list(cell).alias("cells"))
    sizes = axis.groupBy("block").agg(F.count("*").cast("int").alias("width"))
    grid = sizes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((last - 1) // CHUNK))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, out = batch.column(3), []
            edges, flat = cells.offsets.to_numpy(), cells.values
            row, place, value = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            for k, width in enumerate(batch.column(2).to_pylist()):
                x = np.full((CHUNK, width), np.nan)
                if cells[k].is_valid:
                    own = slice(edges[k], edges[k + 1])
                    x[row[own], place[own]] = value[own]
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["chunk", "block", "width", "x"])

    return grid.join(held, ["chunk", "block"], "left").select("chunk", "block", "width", "cells").mapInArrow(run, "chunk int, block int, width int, x binary")


def block_pairs(blocks: DataFrame, count: int) -> DataFrame:
    """(chunk, lo, hi, n, m, x, y): each pair of blocks lo <= hi of a chunk; a block has as many rows as there are blocks."""
    a = blocks.withColumn("hi", F.explode(F.sequence("block", F.lit(count - 1)))).select("chunk", F.col("block").alias("lo"), "hi", F.col("width").alias("n"), "x")
    b = blocks.withColumn("lo", F.explode(F.sequence(F.lit(0), "block"))).select("chunk", "lo", F.col("block").alias("hi"), F.col("width").alias("m"), F.col("x").alias("y"))
    return a.join(b, ["chunk", "lo", "hi"]).select("chunk", "lo", "hi", "n", "m", "x", "y")


def chunk_sums(x: np.ndarray, y: np.ndarray, decays: Iterable[float]) -> np.ndarray:
    """(decays, SUMS, n, m) and, last, counts in the place of a further decay: the sums at the end of a chunk."""
    mx, my = np.isfinite(x), np.isfinite(y)
    vx, vy = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    mx, my, out = mx.astype(float), my.astype(float), []
    for d in decays:
        g = (d ** np.arange(len(x))[::-1])[:, None]
        out.append([(mx * g).T @ my, (mx * g * g).T @ my, (vx * g).T @ my, (mx * g).T @ vy, (vx * g).T @ vy])
    count = mx.T @ my
    return np.array([*out, [count, *[np.zeros_like(count)] * (SUMS - 1)]])


def _fades(decays: Iterable[float], bars: int) -> np.ndarray:
    """What is left of each sum after so many bars; counts stay."""
    return np.array([*[[d**bars, d ** (2 * bars), *[d**bars] * (SUMS - 2)] for d in decays], [1.0] * SUMS])[:, :, None, None]


def inherited(pairs: DataFrame, spec: Spec) -> DataFrame:
    """(chunk, lo, hi, sums): what the chunks before leave at the start of each; a row a pair of blocks and chunk."""
    decays = spec.decays
    fade = _fades(decays, CHUNK)

    def total(batches):
        for batch in batches:
            out = [chunk_sums(_values(x, n), _values(y, m), decays).tobytes() for n, m, x, y in zip(*(batch.column(k).to_pylist() for k in range(3, 7)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], names=["chunk", "lo", "hi", "n", "m", "sums"])

    def carry(batches):
        key, held = None, None
        for batch in batches:
            out = []
            for lo, hi, n, m, sums in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
                if key != (lo, hi):
                    key, held = (lo, hi), np.zeros((len(decays) + 1, SUMS, n, m))
                out.append(held.tobytes())
                held = held * fade + np.frombuffer(sums).reshape(held.shape)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["chunk", "lo", "hi", "sums"])

    key = "chunk int, lo int, hi int"
    totals = pairs.mapInArrow(total, f"{key}, n int, m int, sums binary")
    return totals.repartition("lo", "hi").sortWithinPartitions("lo", "hi", "chunk").mapInArrow(carry, f"{key}, sums binary")


def _values(x: bytes, width: int) -> np.ndarray:
    return np.frombuffer(x).reshape(CHUNK, width)


def expanded(x: np.ndarray, y: np.ndarray, sums: np.ndarray, spec: Spec) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(both observed, counts, covariances by span) after each bar of a chunk; covariances stay while a pair isn't observed."""
    state, fade = sums.copy(), _fades(spec.decays, 1)
    periods = np.array(spec.periods)[:, None, None]
    held = _covariances(state, periods)
    mx, my = np.isfinite(x), np.isfinite(y)
    vx, vy = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    for t in range(len(x)):
        both = mx[t][:, None] & my[t][None]
        state *= fade
        if both.any():
            one, a, b = both.astype(float), vx[t][:, None] * my[t][None], mx[t][:, None] * vy[t][None]
            state[:-1] += np.stack((one, one, a, b, a * b))
            state[-1, 0] += one
            held = np.where(both, _covariances(state, periods), held)
        yield both, state[-1, 0].copy(), held


def _covariances(state: np.ndarray, periods: np.ndarray) -> np.ndarray:
    w, w2, x, y, xy = np.moveaxis(state[:-1], 1, 0)
    below = w * w - w2
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((state[-1, 0] >= periods) & (below > 0), (w * xy - x * y) / below, np.nan)


def _expand(returns: DataFrame, axis: DataFrame, spec: Spec, last: int, emit: Callable, schema: str) -> DataFrame:
    """``emit(chunk, lo, hi, bars of expanded())`` over all chunks and pairs of blocks, given the names of both blocks."""
    count = axis.agg(F.max("block")).first()[0] + 1
    pairs = block_pairs(value_blocks(finite_returns(returns), axis, last), count)
    names = axis.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "ticker"))).alias("all")).select("block", F.col("all.ticker").alias("names"))
    rows = pairs.join(inherited(pairs, spec), ["chunk", "lo", "hi"])
    rows = rows.join(names.select(F.col("block").alias("lo"), F.col("names").alias("rows")), "lo").join(names.select(F.col("block").alias("hi"), F.col("names").alias("cols")), "hi")
    shape = len(spec.spans) + 1

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                sums = np.frombuffer(r["sums"]).reshape(shape, SUMS, r["n"], r["m"])
                yield from emit(r, expanded(_values(r["x"], r["n"]), _values(r["y"], r["m"]), sums, spec))

    return rows.select("chunk", "lo", "hi", "n", "m", "x", "y", "sums", "rows", "cols").mapInArrow(run, schema)


def pair_covariances(returns: DataFrame, *, span: float, periods: int) -> DataFrame:
    """(bar, i, j, n, cov) for i <= j from (bar, ticker, value), one row a bar and ticker: every pair decays on every bar.

    Rows are the bars where both have a finite value; on other bars the covariance is that of the last such bar.
    """
    spec = Spec((span,), (periods,))

    def emit(r, bars):
        upper = np.triu(np.ones((r["n"], r["m"]), bool)) if r["lo"] == r["hi"] else np.ones((r["n"], r["m"]), bool)
        names = pa.array(r["rows"]), pa.array(r["cols"])
        for t, (both, n, cov) in enumerate(bars):
            i, j = np.nonzero(both & upper)
            if len(i):
                bar = np.full(len(i), r["chunk"] * CHUNK + t + 1)
                value = cov[0][i, j]
                yield pa.record_batch([pa.array(bar), names[0].take(pa.array(i)), names[1].take(pa.array(j)), pa.array(n[i, j].astype(np.int64)), pa.array(value, mask=np.isnan(value))], ["bar", "i", "j", "n", "cov"])

    schema = "bar long, i string, j string, n long, cov double"
    last = returns.agg(F.max("bar")).first()[0]
    if last is None:
        return returns.sparkSession.createDataFrame([], schema)
    return _expand(returns, axis_of(returns), spec, last, emit, schema)


def packed_covariances(returns: DataFrame, tickers: DataFrame, spec: Spec, last: int) -> DataFrame:
    """(bar, lo, hi, cov) for every bar up to ``last``: a (spans, rows, columns) matrix a pair of blocks of the sorted axis of ``tickers``.

    NaN where a pair has too few observations; the last known covariance where it is not observed on a bar.
    """

    def emit(r, bars):
        first = r["chunk"] * CHUNK + 1
        out = [cov.tobytes() for t, (_, _, cov) in enumerate(bars) if first + t <= last]
        for k in range(0, len(out), 32):
            part = out[k : k + 32]
            bar = np.arange(first + k, first + k + len(part))
            yield pa.record_batch([pa.array(bar), pa.array([r["lo"]] * len(part), pa.int32()), pa.array([r["hi"]] * len(part), pa.int32()), pa.array(part, pa.binary())], ["bar", "lo", "hi", "cov"])

    return _expand(returns, axis_of(tickers), spec, last, emit, "bar long, lo int, hi int, cov binary")


def by_bar(packed: DataFrame) -> DataFrame:
    """(bar, blocks): a row a bar with all its pairs of blocks."""
    return packed.groupBy("bar").agg(F.collect_list(F.struct("lo", "hi", "cov")).alias("blocks"))


def unpacked(blocks: Iterable[tuple[int, int, bytes]], spans: int, tickers: int) -> np.ndarray:
    """(spans, tickers, tickers), symmetric, of one bar's pairs of blocks."""
    count = -(-tickers // WIDTH)
    width = -(-tickers // count)
    out = np.full((spans, tickers, tickers), np.nan)
    for lo, hi, cov in blocks:
        n, m = min(width, tickers - lo * width), min(width, tickers - hi * width)
        x = np.frombuffer(cov).reshape(spans, n, m)
        a, b = slice(lo * width, lo * width + n), slice(hi * width, hi * width + m)
        out[:, a, b] = x
        out[:, b, a] = np.swapaxes(x, 1, 2)
    return out
