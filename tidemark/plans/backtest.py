"""Backtest legs and diagnostics.

Everything that doesn't depend on a leg's own equity is a window plan, buy and hold included. Only integer shares against own equity make a fold
over bars; legs are folded side by side, so a sweep over settings scales by its legs. A task reads one bar at a time, as one row
with the bar's tickers in an array, and holds a leg's cash, shares and last prices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import matrices as M
from ..functions.lineage import settled
from ..operators.crosssection import TRADING_DAYS, pair_correlation, summary, value_shares
from ..operators.ewm import alpha, ewm_moments
from ..operators.features import VOL_SPAN, macd_score
from ..operators.leastsquares import regression as regression
from ..sources.panel import dense_panel
from .riskmodel import spread_rows

KINDS = ("target_vol", "rescaled", "buy_hold", "optimized")
OBJECTIVES = ("linear", "mean_variance")
MOMENTUM = "Momentum"
#: A limit binds within this share of it.
BINDING = 1e-4


@dataclass(frozen=True)
class Leg:
    name: str
    kind: str = "target_vol"
    target_vol: float = 0.15
    cash: float = 100_000.0
    cost_bps: float = 0.0
    max_gross: float = 1.0
    information: float = 0.05
    turnover_bps: float = 5.0
    objective: str = "linear"
    aversion: float | None = None
    #: Least and most exposure by factor name.
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        if self.objective not in OBJECTIVES:
            raise ValueError(f"objective must be one of {', '.join(OBJECTIVES)}, got {self.objective!r}")
        if self.objective == "mean_variance" and not (self.aversion is not None and self.aversion > 0):
            raise ValueError(f"objective mean_variance needs a positive aversion, got {self.aversion}")
        if crossed := sorted(n for n, (low, high) in self.bounds.items() if not low <= high):
            raise ValueError(f"bounds of {', '.join(crossed)} are no range")


def traded_vol(panel: DataFrame, scores: DataFrame) -> DataFrame:
    """(date, ticker, vol): deviation of log returns over the bars on which the ticker is scored or held.

    A ticker is held after its first scored bar with a known deviation, which needs VOL_SPAN returns between scored bars; until then only
    scored bars count. Holding is taken from that bar on, also where a book rounds to no share.
    """
    scored = scores.select("date", "ticker", F.lit(True).alias("__scored"))
    rows = dense_panel(panel).where("sticky is not null").join(scored, ["date", "ticker"], "left")
    seen = F.count("__scored").over(Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__seen", seen).where(F.col("__scored") | (F.col("__seen") > VOL_SPAN))
    last = F.lag("sticky").over(Window.partitionBy("ticker").orderBy("date"))
    rows = rows.withColumn("r", F.log(F.col("sticky") / last)).where("r is not null")
    return ewm_moments(rows, ["ticker"], "date", "r", "__m", "vol", span=VOL_SPAN, periods=VOL_SPAN).select("date", "ticker", "vol")


def sticky_prices(panel: DataFrame) -> DataFrame:
    """(date, ticker, price): the last close seen, of every bar since a ticker's first."""
    return dense_panel(panel).where("sticky is not null").select("date", "ticker", F.col("sticky").alias("price"))


def leg_inputs(panel: DataFrame, scores: DataFrame) -> DataFrame:
    """(date, ticker, price, score, vol): sticky prices of every bar, and scores and volatilities where they exist."""
    return sticky_prices(panel).join(scores, ["date", "ticker"], "left").join(traded_vol(panel, scores), ["date", "ticker"], "left")


SOLVE = "struct<status: string, vol: double, gross: double, turnover: double>"
FOLDED = f"leg string, date date, equity double, cash double, held array<struct<ticker: string, price: double, quantity: bigint, weight: double, ordered: bigint, target: double>>, solve {SOLVE}"


def unknown_bounds(names: list[str], snaps: DataFrame) -> list[str]:
    """The names of bounds that some snapshot has no factor for, sorted."""
    if not names:
        return []
    missing = snaps.select(F.explode(F.array_except(F.array(*map(F.lit, names)), "factors")).alias("name"))
    return sorted(r["name"] for r in missing.distinct().collect())


def hold_leg(prices: DataFrame, leg: Leg) -> DataFrame:
    """Buy and hold as fold_legs() gives it, from (date, ticker, price): equal parts of the cash on the first bar, in whole shares.

    Nothing depends on earlier equity, so it is aggregates by date and a window by ticker; only equities, a row a date, pass a window
    without keys. A leg without cash buys nothing.
    """
    prices = prices.select(F.to_date("date").alias("date"), "ticker", "price")
    first = prices.agg(F.min("date").alias("first"))  # one row, as is what is spent
    start = prices.join(F.broadcast(first), F.col("date") == F.col("first")).withColumn("target", 1 / F.count("*").over(Window.partitionBy("first")))
    shares = F.bround(F.col("target") * leg.cash / F.col("price")) if leg.cash > 0 else F.lit(0)
    start = start.select("ticker", F.col("price").alias("paid"), "target", shares.cast("long").alias("quantity"), "first")
    spent = start.groupBy("first").agg(F.sum(F.col("quantity") * F.col("paid") + F.abs("quantity") * F.col("paid") * (leg.cost_bps / 1e4)).alias("spent"))
    rows = prices.join(start.drop("first"), "ticker", "left").withColumn("quantity", F.coalesce("quantity", F.lit(0).cast("long")))
    rows = rows.withColumn("before", F.lag("price").over(Window.partitionBy("ticker").orderBy("date")))
    worth = rows.groupBy("date").agg(F.sum(F.col("quantity") * F.col("price")).alias("worth")).join(F.broadcast(spent), F.lit(True))
    fresh = F.col("date") == F.col("first")
    cash = F.lit(leg.cash) - F.col("spent")
    worth = worth.select("date", fresh.alias("fresh"), cash.alias("cash"), F.when(fresh, F.lit(leg.cash)).otherwise(cash + F.col("worth")).alias("equity"))
    worth = worth.withColumn("last", F.lag("equity").over(Window.orderBy("date")))
    bought = F.col("fresh") & F.lit(leg.cash > 0)
    weight = F.coalesce(F.try_divide(F.col("quantity") * F.col("before"), "last"), F.lit(0.0))
    one = F.struct("ticker", "price", "quantity", weight.alias("weight"), F.when(bought, F.col("quantity")).otherwise(0).alias("ordered"), F.when(bought, F.col("target")).alias("target"))
    held = rows.join(worth, "date").groupBy("date").agg(F.first("equity").alias("equity"), F.first("cash").alias("cash"), F.sort_array(F.collect_list(one)).alias("held"))
    return held.select(F.lit(leg.name).alias("leg"), "date", "equity", "cash", "held", F.lit(None).cast(SOLVE).alias("solve"))


def fold_legs(inputs: DataFrame, legs: list[Leg], snaps: DataFrame | None = None) -> DataFrame:
    """One row a leg and bar: equity before the bar's orders, and the holdings after them, filled at the bar's price.

    ``held`` has of each ticker the price, the quantity, the weight that earned the bar, the shares ordered and the target weight (null
    where there was none). ``snaps``: (date, tickers, factors, b, f, d, sigma) for optimised legs, which stay flat until there is one; ``solve`` is
    what their solver said. ValueError if a bound names a factor that a snapshot doesn't have.
    """
    plain = [hold_leg(inputs, leg) for leg in legs if leg.kind == "buy_hold"]
    legs = [leg for leg in legs if leg.kind != "buy_hold"]
    if not legs:
        return reduce(DataFrame.unionByName, plain)
    table = {leg.name: leg for leg in legs}
    bars = inputs.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("ticker", "price", "score", "vol"))).alias("rows"))
    if snaps is None:
        bars = bars.withColumn("snap", F.lit(None).cast("struct<tickers: array<string>>"))
    else:
        if unknown := unknown_bounds(sorted({n for leg in legs for n in leg.bounds}), snaps):
            raise ValueError(f"bounds of unknown factors: {', '.join(unknown)}")
        bars = bars.join(snaps.select("date", F.struct("tickers", "factors", "b", "f", "d", "sigma").alias("snap")), "date", "left")
    bars = bars.withColumn("date", F.to_date("date")).withColumn("leg", F.explode(F.array(*[F.lit(n) for n in table])))
    dealt = bars.repartition(max(2, len(legs)), "leg").sortWithinPartitions("leg", "date").select("leg", "date", "rows", "snap")
    item = pa.struct([("ticker", pa.string()), ("price", pa.float64()), ("quantity", pa.int64()), ("weight", pa.float64()), ("ordered", pa.int64()), ("target", pa.float64())])
    solve = pa.struct([("status", pa.string()), ("vol", pa.float64()), ("gross", pa.float64()), ("turnover", pa.float64())])
    schema = pa.schema([("leg", pa.string()), ("date", pa.date32()), ("equity", pa.float64()), ("cash", pa.float64()), ("held", pa.list_(item)), ("solve", solve)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = None
        for batch in batches:
            out = []
            for bar in batch.to_pylist():
                if book is None or book.leg.name != bar["leg"]:
                    book = Book(table[bar["leg"]])
                out.append({"leg": bar["leg"], "date": bar["date"], **book.step(bar["rows"], bar["snap"])})
            yield pa.RecordBatch.from_pylist(out, schema)

    return reduce(DataFrame.unionByName, plain, dealt.mapInArrow(run, FOLDED))


def holdings(folded: DataFrame) -> DataFrame:
    """One row a leg, bar and ticker."""
    return folded.select("leg", "date", "equity", "cash", F.explode("held").alias("h")).select("leg", "date", "h.ticker", "h.price", "h.quantity", "h.weight", "equity", "cash", "h.ordered")


def run_legs(inputs: DataFrame, legs: list[Leg], snaps: DataFrame | None = None) -> DataFrame:
    """The holdings of fold_legs()."""
    return holdings(fold_legs(inputs, legs, snaps))


def trade_log(folded: DataFrame) -> DataFrame:
    """(leg, date, ticker, side, quantity, price, note): one row an order."""
    rows = folded.select("leg", "date", F.explode("held").alias("h")).where("h.ordered != 0")
    side = F.when(F.col("h.ordered") > 0, "BUY").otherwise("SELL")
    return rows.select("leg", "date", "h.ticker", side.alias("side"), F.abs("h.ordered").alias("quantity"), "h.price", F.format_string("weight=%.5f", "h.target").alias("note"))


def binding(vol: Column, gross: Column, target_vol: Column, max_gross: Column, objective: Column) -> Column:
    """The limit that stopped the optimiser: both, vol, leverage, or neither, which the objective names."""
    at_vol, at_gross = vol >= target_vol * (1 - BINDING), gross >= max_gross * (1 - BINDING)
    rest = F.when(objective == "mean_variance", "interior").otherwise("turnover")
    return F.when(at_vol & at_gross, "both").when(at_vol, "vol").when(at_gross, "leverage").otherwise(rest)


def solve_log(folded: DataFrame, legs: list[Leg]) -> DataFrame:
    """(leg, date, status, binding, ex_ante_vol, gross, turnover): one row a bar on which a leg was optimised."""
    limits = folded.sparkSession.createDataFrame([(leg.name, leg.target_vol, leg.max_gross, leg.objective) for leg in legs], "leg string, target_vol double, max_gross double, objective string")
    rows = folded.where("solve is not null").select("leg", "date", "solve.*").join(limits, "leg")
    named = F.when(F.col("status") == "optimal", binding(F.col("vol"), F.col("gross"), F.col("target_vol"), F.col("max_gross"), F.col("objective"))).otherwise("none")
    return rows.select("leg", "date", "status", named.alias("binding"), F.col("vol").alias("ex_ante_vol"), "gross", "turnover")


def solver_summary(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The share of each binding limit; and failures, mean volatility, largest gross and annual turnover of each leg."""
    shares = value_shares(log, "binding", ["leg"])
    numbers = log.groupBy("leg").agg(F.count_if(F.col("status") != "optimal").alias("failures"), F.avg("ex_ante_vol").alias("mean_vol"), F.max("gross").alias("max_gross"), (F.avg("turnover") * TRADING_DAYS).alias("annual_turnover"))
    return shares, numbers


class Book:
    """One leg's cash and shares; step() takes the next bar."""

    def __init__(self, leg: Leg):
        self.leg, self.cash = leg, leg.cash
        self.held: dict[str, int] = {}
        self.own, self.counted = _Running(VOL_SPAN), None
        self.last_equity, self.before = None, {}

    def step(self, rows: list[dict], snap: dict | None) -> dict:
        leg, held = self.leg, self.held
        price = {r["ticker"]: r["price"] for r in rows}
        value = {t: q * price[t] for t, q in held.items()}
        equity = self.cash + sum(value.values())
        earned = {t: held.get(t, 0) * self.before[t] / self.last_equity if self.last_equity and t in self.before else 0.0 for t in price}
        weights, solve = {}, None
        if equity > 0:  # an insolvent book orders nothing and counts no return
            if any(held.values()) and self.counted is not None:
                self.own.update(math.log(equity / self.counted))
            self.counted = equity
            weights, solve = self.targets(rows, value, equity, snap)
        ordered = {t: round(w * equity / price[t]) - held.get(t, 0) for t, w in weights.items() if t in price}
        for t, n in ordered.items():
            held[t] = held.get(t, 0) + n
            self.cash -= n * price[t] + abs(n) * price[t] * leg.cost_bps / 1e4
        self.before, self.last_equity = price, equity
        return {"equity": equity, "cash": self.cash, "solve": solve, "held": [{"ticker": t, "price": p, "quantity": held.get(t, 0), "weight": earned[t], "ordered": ordered.get(t, 0), "target": weights.get(t)} for t, p in price.items()]}

    def targets(self, rows: list[dict], value: dict, equity: float, snap: dict | None) -> tuple[dict, dict | None]:
        leg = self.leg
        scores = {r["ticker"]: r["score"] for r in rows if r["score"] is not None}
        if leg.kind == "optimized":
            return _optimised(snap, scores, value, equity, leg) if snap is not None else ({}, None)
        vols = {r["ticker"]: r["vol"] * math.sqrt(TRADING_DAYS) for r in rows if r["score"] is not None and r["vol"]}
        weights = {t: scores[t] / len(vols) * leg.target_vol / v for t, v in vols.items()}
        vol = self.own.std() if leg.kind == "rescaled" else None
        scale = leg.target_vol / (vol * math.sqrt(TRADING_DAYS)) if vol else 1.0
        return {t: w * scale for t, w in weights.items()}, None


class _Running:
    """Exponentially weighted deviation of the values given so far."""

    def __init__(self, span: int):
        self.decay, self.least = 1 - alpha(span), span
        self.n = self.w = self.w2 = self.x = self.xx = 0.0

    def update(self, v: float) -> None:
        d = self.decay
        self.n, self.w, self.w2, self.x, self.xx = self.n + 1, self.w * d + 1, self.w2 * d * d + 1, self.x * d + v, self.xx * d + v * v

    def std(self) -> float | None:
        below = self.w**2 - self.w2
        return None if self.n < self.least or below <= 0 else math.sqrt(max(0.0, (self.w * self.xx - self.x**2) / below))


def _optimised(snap: dict, scores: dict, value: dict, equity: float, leg: Leg) -> tuple[dict, dict]:
    """Target weights, none if the solver failed, and what it said; volatility a year."""
    names = snap["tickers"]
    n, k = len(names), len(snap["factors"])
    b, f, d, sigma = np.array(snap["b"]).reshape(n, k), np.array(snap["f"]).reshape(k, k), np.array(snap["d"]), np.array(snap["sigma"])
    before = np.array([value.get(t, 0.0) / equity for t in names])
    gain = leg.information * sigma * np.array([scores.get(t, 0.0) for t in names])
    rows = [(b[:, snap["factors"].index(name)], low, high) for name, (low, high) in leg.bounds.items()]
    aversion = leg.aversion if leg.objective == "mean_variance" else 0.0
    w, status = M.optimal_weights(gain, b, f, d, before, vol_limit=leg.target_vol / math.sqrt(TRADING_DAYS), max_gross=leg.max_gross, penalty=leg.turnover_bps / 1e4, aversion=aversion, bounds=rows, tolerance=1e-7)
    if status != "optimal":
        return {}, {"status": status, "vol": 0.0, "gross": float(np.abs(before).sum()), "turnover": 0.0}
    load = b.T @ w
    vol = math.sqrt(float(load @ f @ load + d @ w**2) * TRADING_DAYS)
    return dict(zip(names, w.tolist(), strict=True)), {"status": status, "vol": vol, "gross": float(np.abs(w).sum()), "turnover": float(np.abs(w - before).sum())}


def macd_legs(panel: DataFrame, legs: list[Leg]) -> DataFrame:
    """Trend-scored legs over one panel; scores are computed once for all of them."""
    return run_legs(settled(leg_inputs(panel, settled(macd_score(panel)))), legs)


def equity_curve(run: DataFrame) -> DataFrame:
    """(leg, date, equity, log_return): one row a bar; the return is to the row before where both are positive."""
    rows = run.select("leg", "date", "equity").dropDuplicates(["leg", "date"])
    last = F.lag("equity").over(Window.partitionBy("leg").orderBy("date"))
    return rows.withColumn("log_return", F.when((F.col("equity") > 0) & (last > 0), F.log(F.col("equity") / last)))


def metrics(curve: DataFrame) -> DataFrame:
    """Total return, annual volatility, Sharpe ratio and deepest drawdown of each leg."""
    peak = F.max("equity").over(Window.partitionBy("leg").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    rows = curve.withColumn("fall", F.col("equity") / peak - 1)
    std = F.stddev_samp("log_return")
    return rows.groupBy("leg").agg(
        (F.max_by("equity", "date") / F.min_by("equity", "date") - 1).alias("total_return"),
        (std * math.sqrt(TRADING_DAYS)).alias("vol"),
        F.when(std > 0, F.avg("log_return") / std * math.sqrt(TRADING_DAYS)).otherwise(0.0).alias("sharpe"),
        F.min("fall").alias("drawdown"),
    )


def leg_correlation(curve: DataFrame) -> DataFrame:
    """(i, j, corr, n) of the legs' daily simple returns."""
    last = F.lag("equity").over(Window.partitionBy("leg").orderBy("date"))
    rows = curve.withColumn("value", F.when(last > 0, F.col("equity") / last - 1))
    return pair_correlation(rows, "value", "leg")


def contributions(exposures: DataFrame, returns: DataFrame, portfolio: DataFrame) -> DataFrame:
    """(date, factor, value): exposure times factor return, and RESIDUAL, what remains of the portfolio's return.

    ``exposures``: (date, factor, exposure); ``returns``: (date, factor, value); ``portfolio``: (date, ret).
    """
    parts = exposures.join(returns, ["date", "factor"]).select("date", "factor", (F.col("exposure") * F.col("value")).alias("value"))
    rest = portfolio.join(parts.groupBy("date").agg(F.sum("value").alias("explained")), "date").select("date", F.lit("RESIDUAL").alias("factor"), (F.col("ret") - F.col("explained")).alias("value"))
    return parts.unionByName(rest)


def edge_buckets(exposures: DataFrame, returns: DataFrame, portfolio: DataFrame, specific: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(date, structural, timing, momentum, selection, other), which add up to the portfolio's return.

    Structural: the mean exposure of all dates at the factor's return; timing: the deviation from it. A factor that is
    absent on a date counts 0 in its mean. Momentum is one bucket. ``specific``: (date, specific). ``by``: keys of several portfolios, which
    all tables have beside the date; a portfolio's dates are one group, a row each.
    """
    keys = [*by, "date"]
    portfolio = portfolio.withColumn("days", F.count("*").over(Window.partitionBy(*by)))
    rows = exposures.join(returns, [*keys, "factor"]).join(portfolio.select(*keys, "days"), keys)
    rows = rows.withColumn("mean", F.sum("exposure").over(Window.partitionBy(*by, "factor")) / F.col("days"))
    macro = F.col("factor") != MOMENTUM
    sums = rows.groupBy(*keys).agg(
        F.sum(F.when(macro, F.col("mean") * F.col("value")).otherwise(0.0)).alias("structural"),
        F.sum(F.when(macro, (F.col("exposure") - F.col("mean")) * F.col("value")).otherwise(0.0)).alias("timing"),
        F.sum(F.when(~macro, F.col("exposure") * F.col("value")).otherwise(0.0)).alias("momentum"),
    )
    sums = sums.join(portfolio, keys).join(specific, keys)
    other = F.col("ret") - F.col("structural") - F.col("timing") - F.col("momentum") - F.col("specific")
    return sums.select(*keys, "structural", "timing", "momentum", F.col("specific").alias("selection"), other.alias("other"))


BUCKETS = ("structural", "timing", "momentum", "selection", "other")


def edge_summary(buckets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    rows = buckets.unpivot([*by, "date"], list(BUCKETS), "bucket", "value")
    return summary(rows, [*by, "bucket"], "value")


def loading_drift(loads: DataFrame, every: int = 5) -> DataFrame:
    """(factor, change, size, ratio): median absolute change between sampled bars over the median absolute loading, the largest first."""
    rows = loads.where((F.col("bar") - 1) % every == 0)
    before = F.lag("value").over(Window.partitionBy("ticker", "factor").orderBy("bar"))
    rows = rows.withColumn("change", F.abs(F.col("value") - before))
    out = rows.groupBy("factor").agg(F.median("change").alias("change"), F.median(F.abs("value")).alias("size"))
    return out.withColumn("ratio", F.try_divide("change", "size")).orderBy(F.col("ratio").desc_nulls_last(), "factor")


def _scaled_residual(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A snapshot's tickers, the covariance rescaled to its volatilities less the factors' part, and its share of each own variance."""
    names, axis = np.array(row["tickers"]), np.array(row["axis"])
    order = np.argsort(axis)
    at = np.minimum(np.searchsorted(axis, names, sorter=order), len(axis) - 1)
    place, n = order[at], len(names)
    s = row["s"].reshape(len(axis), -1)[np.ix_(place, place)]
    missing = axis[place] != names
    s[missing] = s[:, missing] = np.nan
    own = np.diag(s)
    scale = row["sigma"] / np.sqrt(np.where(own > 0, own, np.nan))
    s = s * np.outer(scale, scale)
    b = row["b"].reshape(n, -1)
    rest = s - b @ row["f"].reshape(b.shape[1], -1) @ b.T
    with np.errstate(invalid="ignore", divide="ignore"):
        return names, rest, np.diag(rest) / np.diag(s)


def residual_shares(snaps: DataFrame, cov: DataFrame, least: float = 0.10) -> DataFrame:
    """(bar, ticker, share, masked): what part of each own variance the factors leave; ``least`` or less is masked."""

    def kernel(row):
        names, _, share = _scaled_residual(row)
        return [row["bar"]] * len(names), names, share, ~(share > least)

    return spread_rows(snaps.join(cov, "bar"), kernel, "bar long, ticker string, share double, masked boolean")


def residual_correlations(snaps: DataFrame, cov: DataFrame, least: float = 0.10) -> DataFrame:
    """(bar, i, j, corr) for i < j, by place in the snapshot, of what a covariance keeps beside the factors.

    ``cov``: (bar, axis array<string>, s array<double>), a matrix over the axis, rescaled to the snapshot's volatilities; tickers stay if their
    residual share of variance is above ``least``. A correlation beyond 1 says that specific variances are too small for it.
    """

    def kernel(row):
        names, rest, share = _scaled_residual(row)
        keep = np.flatnonzero(np.nan_to_num(share) > least)
        std = np.sqrt(np.maximum(np.diag(rest)[keep], M.VARIANCE_LEAST))
        corr = rest[np.ix_(keep, keep)] / np.outer(std, std)
        i, j = np.nonzero(np.triu(np.isfinite(corr), 1))
        return [row["bar"]] * len(i), names[keep][i], names[keep][j], corr[i, j]

    return spread_rows(snaps.join(cov, "bar"), kernel, "bar long, i string, j string, corr double")


def collinearity(snaps: DataFrame) -> DataFrame:
    """(bar, factor, corr): momentum's exposure against each factor's betas over the tickers, the largest first; no rows without momentum."""
    rows = snaps.where(F.col("m").isNotNull() & F.array_contains("factors", MOMENTUM)).select("bar", "m", "beta", F.array_remove("factors", MOMENTUM).alias("factors"))
    rows = rows.select("bar", "beta", "factors", F.posexplode("m").alias("row", "m"))
    rows = rows.select("bar", "m", "beta", "row", F.size("factors").alias("k"), F.posexplode("factors").alias("col", "factor"))
    rows = rows.select("bar", "factor", "m", F.get("beta", F.col("row") * F.col("k") + F.col("col")).alias("load"))
    return rows.groupBy("bar", "factor").agg(F.corr("m", "load").alias("corr")).orderBy("bar", F.abs("corr").desc(), "factor")


def worst_pairs(corr: DataFrame, n: int = 12) -> DataFrame:
    """The pairs of the largest absolute correlation; ties by name."""
    return corr.orderBy(F.abs("corr").desc(), "i", "j").limit(n)
