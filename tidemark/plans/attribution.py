"""What earned a leg's returns: its weights of a bar against the risk model of the bar before.

All bars of all legs are independent rows: a snapshot joined with the weights and the returns of the next bar, then a map
without state. The summaries are aggregates over long tables, where a factor that is absent on a date counts 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settled
from ..operators.crosssection import TRADING_DAYS, calendar_vol, rolling, running_sum, t_stat
from ..sources.panel import bar_numbers, good_ticks, with_returns
from .backtest import edge_buckets, edge_summary, equity_curve, holdings, regression
from .riskmodel import MOMENTUM

RESIDUAL = "RESIDUAL"
BIAS_WINDOW, REALIZED_WINDOW, REALIZED_LEAST = 250, 60, 20
ROWS = "leg string, date date, ret double, predicted double, specific double, own_share double, parts array<struct<place: int, factor: string, exposure: double, share: double, value: double, simple: double, contribution: double>>"


@dataclass(frozen=True)
class Attribution:
    """``bars``: (leg, date, ret, predicted, specific, own_share), a row a bar: the leg's log return, its predicted daily volatility, the part
    that belongs to the tickers themselves, and that part's share of the predicted variance. ``factors``: (leg, date, place, factor,
    exposure, share, value, simple, contribution), a row a factor that the model had on the bar before, with its log and simple return."""

    bars: DataFrame
    factors: DataFrame


def _kernel(row: dict) -> dict:
    names, n, k = row["tickers"], len(row["tickers"]), len(row["factors"])
    b, f, weights = np.array(row["b"]).reshape(n, k), np.array(row["f"]).reshape(k, k), np.array(row["w"]).reshape(n, -1)
    held, moves = dict(row["weights"]), dict(row["moves"] or {})
    x = np.array([held.get(t, 0.0) for t in names])
    r = np.array([moves.get(t, 0.0) for t in names])

    def returns(of: np.ndarray) -> np.ndarray:
        macro = weights.T @ of
        if MOMENTUM not in row["factors"]:
            return macro
        m = np.array(row["m"])
        rest = of - np.array(row["beta"]).reshape(n, -1) @ macro
        return np.append(macro, m @ rest / (m @ m) if m @ m else 0.0)

    load, value, simple = b.T @ x, returns(r), returns(np.expm1(r))
    common, own = load * (f @ load), float(np.array(row["d"]) @ x**2)
    total = float(common.sum() + own)
    share = common / total if total > 0 else np.zeros(k)
    part = load * value
    columns = (load, share, value, simple, part)
    parts = [dict(zip(("place", "factor", "exposure", "share", "value", "simple", "contribution"), (j, name, *(float(c[j]) for c in columns)), strict=True)) for j, name in enumerate(row["factors"])]
    return {"leg": row["leg"], "date": row["date"], "ret": row["ret"], "predicted": max(total, 0.0) ** 0.5, "specific": float(x @ r - part.sum()), "own_share": own / total if total > 0 else 0.0, "parts": parts}


def attribute(folded: DataFrame, snaps: DataFrame, panel: DataFrame) -> Attribution:
    """Attribution of each leg of fold_legs() on each bar that has a return and a snapshot on the bar before.

    Weights of tickers outside a snapshot are left out; a ticker without a close on the bar has return 0. ``snaps``: by bar of ``panel``.
    """
    panel = good_ticks(panel)
    bars = bar_numbers(panel)
    moves = with_returns(panel).where("log_return is not null").groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("ticker", "log_return"))).alias("moves"))
    model = snaps.withColumn("bar", F.col("bar") + 1).join(bars, "bar").join(moves, "date", "left")
    model = model.withColumn("date", F.to_date("date")).select("date", "tickers", "factors", "b", "f", "d", "w", "beta", "m", "moves")
    weights = holdings(folded).groupBy("leg", "date").agg(F.map_from_entries(F.collect_list(F.struct("ticker", "weight"))).alias("weights"))
    curve = equity_curve(folded).where("log_return is not null").select("leg", "date", F.col("log_return").alias("ret"))
    rows = curve.join(weights, ["leg", "date"]).join(model, "date")
    part = pa.struct([("place", pa.int32()), ("factor", pa.string()), *[(c, pa.float64()) for c in ("exposure", "share", "value", "simple", "contribution")]])
    schema = pa.schema([("leg", pa.string()), ("date", pa.date32()), *[(c, pa.float64()) for c in ("ret", "predicted", "specific", "own_share")], ("parts", pa.list_(part))])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_kernel(row) for row in batch.to_pylist()], schema)

    found = settled(rows.mapInArrow(run, ROWS))
    return Attribution(found.drop("parts"), found.select("leg", "date", F.explode("parts").alias("p")).select("leg", "date", "p.*"))


def dense(found: Attribution) -> DataFrame:
    """``factors`` with a row for every bar of a leg and every factor that the leg ever had; absent ones are 0."""
    names = found.factors.groupBy("leg", "factor").agg(F.max("place").alias("place"))
    grid = found.bars.select("leg", "date").join(names, "leg")
    return grid.join(found.factors.drop("place"), ["leg", "date", "factor"], "left").fillna(0.0)


def contributions(found: Attribution) -> DataFrame:
    """(leg, date, place, factor, value): each factor's part of the return, and what is left, RESIDUAL, which comes last."""
    rows = dense(found).select("leg", "date", "place", "factor", F.col("contribution").alias("value"))
    explained = found.factors.groupBy("leg", "date").agg(F.sum("contribution").alias("explained"))
    left = found.bars.join(explained, ["leg", "date"], "left").select("leg", "date", F.lit(1 << 30).alias("place"), F.lit(RESIDUAL).alias("factor"), (F.col("ret") - F.coalesce("explained", F.lit(0.0))).alias("value"))
    return rows.unionByName(left)


def annual_contributions(found: Attribution) -> DataFrame:
    """(leg, place, factor, annual), in the order of factors."""
    rows = contributions(found).groupBy("leg", "factor").agg(F.max("place").alias("place"), (F.avg("value") * TRADING_DAYS).alias("annual"))
    return rows.select("leg", "place", "factor", "annual").orderBy("leg", "place", "factor")


def buckets(found: Attribution) -> DataFrame:
    """(leg, date, structural, timing, momentum, selection, other)."""
    exposures = found.factors.select("leg", "date", "factor", "exposure")
    returns = found.factors.select("leg", "date", "factor", "value")
    return edge_buckets(exposures, returns, found.bars.select("leg", "date", "ret"), found.bars.select("leg", "date", "specific"), ("leg",))


def bucket_summary(found: Attribution) -> DataFrame:
    return edge_summary(buckets(found), ("leg",))


def factor_summary(found: Attribution) -> DataFrame:
    """(leg, factor, structural, timing, t_timing): annual parts of the mean exposure and of the deviation from it, and the latter's t."""
    rows = dense(found)
    mean = rows.groupBy("leg", "factor").agg(F.avg("exposure").alias("mean"))
    rows = rows.join(mean, ["leg", "factor"])
    rows = rows.withColumn("structural", F.col("mean") * F.col("value")).withColumn("timing", (F.col("exposure") - F.col("mean")) * F.col("value"))
    return rows.groupBy("leg", "factor").agg((F.avg("structural") * TRADING_DAYS).alias("structural"), (F.avg("timing") * TRADING_DAYS).alias("timing"), t_stat("timing").alias("t_timing"))


def exposure_ranges(found: Attribution) -> DataFrame:
    return dense(found).groupBy("leg", "factor").agg(F.avg("exposure").alias("mean"), F.min("exposure").alias("least"), F.max("exposure").alias("most"))


def mean_shares(found: Attribution) -> DataFrame:
    """(leg, factor, share): mean share of the predicted variance, RESIDUAL for the tickers' own."""
    rows = dense(found).select("leg", "factor", "share").unionByName(found.bars.select("leg", F.lit(RESIDUAL).alias("factor"), F.col("own_share").alias("share")))
    return rows.groupBy("leg", "factor").agg(F.avg("share").alias("share"))


def standardized(found: Attribution) -> DataFrame:
    """(leg, date, u): returns in units of their predicted volatility, where that is positive."""
    return found.bars.where("predicted > 0").select("leg", "date", (F.col("ret") / F.col("predicted")).alias("u"))


def rolling_bias(found: Attribution, window: int = BIAS_WINDOW) -> DataFrame:
    return standardized(found).withColumn("bias", rolling("u", window, window // 2, ["leg"])).drop("u")


def volatilities(found: Attribution) -> DataFrame:
    """(leg, date, predicted, realized): a year's, the latter of the last bars."""
    scale = TRADING_DAYS**0.5
    return found.bars.select("leg", "date", (F.col("predicted") * scale).alias("predicted"), (rolling("ret", REALIZED_WINDOW, REALIZED_LEAST, ["leg"]) * scale).alias("realized"))


def health(found: Attribution) -> DataFrame:
    """(leg, bias, bars, predicted_vol, realized_vol): the deviation of standardised returns, ideally 1, and mean volatilities of a year."""
    bias = standardized(found).groupBy("leg").agg(F.stddev_samp("u").alias("bias"))
    rows = found.bars.groupBy("leg").agg(F.count("*").alias("bars"), (F.avg("predicted") * TRADING_DAYS**0.5).alias("predicted_vol"))
    vol = calendar_vol(found.bars, ["leg"], "ret").withColumnRenamed("vol", "realized_vol")
    return rows.join(bias, "leg", "left").join(vol, "leg").select("leg", "bias", "bars", "predicted_vol", "realized_vol")


def factor_regression(found: Attribution) -> DataFrame:
    """regression() of each leg's simple returns on the simple returns of its own factors; a bar without one of them counts 0.

    The names of the factors come from a config, so the driver knows them and the wide table has a column each.
    """
    names = [r.factor for r in found.factors.groupBy("factor").agg(F.max("place").alias("place")).orderBy("place", "factor").collect()]
    wide = dense(found).groupBy("leg", "date").pivot("factor", names).agg(F.first("simple"))
    return regression(wide.join(found.bars.select("leg", "date", F.expm1("ret").alias("__y")), ["leg", "date"]), "__y", names, by="leg")


def cumulative(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return rows.withColumn(value, running_sum(value, keys))
