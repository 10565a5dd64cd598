"""Momentum and trend features of a panel of (date, ticker, close)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.panel import by_ticker, with_returns
from .ewm import alpha, decayed_sums, default_periods, ewm_moments, mean_column, observation_numbers, variance_column

# The look-backs, spans and windows of the features.
LOOKBACKS = (1, 21, 63, 126, 252)
MACD_PAIRS = ((8, 24), (16, 48), (32, 96))
VOL_SPAN = 60
WINSOR_HALFLIFE, WINSOR_WIDTH = 31.0, 5.0
PRICE_WINDOW, TREND_WINDOW = 63, 252
RESPONSE_SCALE = 0.89
MOMENTUM_LOOKBACK, MOMENTUM_SKIP = 252, 21


def response(y: Column) -> Column:
    return y * F.exp(-y * y / 4) / RESPONSE_SCALE


def rolling_std(value: str, window: int, order: str = "date") -> Column:
    """Sample deviation of the last ``window`` values; null until there are as many."""
    frame = by_ticker(order).rowsBetween(-(window - 1), 0)
    return F.when(F.count(value).over(frame) == window, F.stddev_samp(value).over(frame))


def lagged(value: str, by: int, order: str = "date") -> Column:
    return F.lag(value, by).over(by_ticker(order))


def momentum_12_1(close: str = "close", lookback: int = MOMENTUM_LOOKBACK, skip: int = MOMENTUM_SKIP) -> Column:
    return F.log(lagged(close, skip) / lagged(close, lookback))


def _trend_sums(panel: DataFrame, pairs) -> DataFrame:
    spans = sorted({s for pair in pairs for s in pair})
    rows = observation_numbers(panel, ["ticker"], "date")
    rows = decayed_sums(rows, ["ticker"], "n", {f"__m{s}": (F.col("close"), 1 - alpha(s)) for s in spans})
    return rows.withColumns({f"__m{s}": mean_column(1 - alpha(s), s, f"__m{s}") for s in spans})


def macd(panel: DataFrame, pairs=MACD_PAIRS, squash: bool = False) -> DataFrame:
    """(date, ticker, macd_short_long ...): the difference of two means over the price's deviation, over the deviation of that trend.

    The second deviation is over the rows where the trend has a value, so a bar without any spread of prices is skipped there.
    """
    rows = _trend_sums(panel, pairs).withColumn("__std", rolling_std("close", PRICE_WINDOW))
    rows = rows.withColumns({f"__q{s}_{l}": F.when(F.col("__std") > 0, (F.col(f"__m{s}") - F.col(f"__m{l}")) / F.col("__std")) for s, l in pairs})
    # the rows where a trend has a value are numbered by themselves and keep their place among all rows
    for s, l in pairs:
        q = f"__q{s}_{l}"
        own = Window.partitionBy("ticker", F.col(q).isNotNull()).orderBy("date").rowsBetween(-(TREND_WINDOW - 1), 0)
        spread = F.when(F.count(q).over(own) == TREND_WINDOW, F.stddev_samp(q).over(own))
        rows = rows.withColumn(f"__s{s}_{l}", spread)
    done = {f"macd_{s}_{l}": F.when(F.col(f"__s{s}_{l}") > 0, F.col(f"__q{s}_{l}") / F.col(f"__s{s}_{l}")) for s, l in pairs}
    return rows.select("date", "ticker", *[(response(c) if squash else c).alias(n) for n, c in done.items()])


def macd_score(panel: DataFrame, pairs=MACD_PAIRS) -> DataFrame:
    """(date, ticker, score): the mean of the squashed features, where all have a value."""
    names = [f"macd_{s}_{l}" for s, l in pairs]
    rows = macd(panel, pairs, squash=True).dropna(subset=names)
    return rows.select("date", "ticker", (sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).alias("score"))


def return_vol(panel: DataFrame, span: int = VOL_SPAN, out: str = "vol") -> DataFrame:
    """(date, ticker, close, log_return, vol): the deviation of log returns; the first row of a ticker has none."""
    d = 1 - alpha(span)
    rows = observation_numbers(with_returns(panel), ["ticker"], "date").withColumn("n", F.col("n") - 1)
    r = F.coalesce("log_return", F.lit(0.0))
    rows = decayed_sums(rows.withColumn("__p", F.col("n") + 1), ["ticker"], "__p", {"__x": (r, d), "__xx": (r * r, d)})
    return rows.withColumn(out, F.when(F.col("n") > 0, F.sqrt(variance_column(d, span, "__x", "__xx")))).drop("n", "__p", "__x", "__xx", "simple_return")


def vol_scaled_momentum(panel: DataFrame, lookbacks=LOOKBACKS) -> DataFrame:
    """(date, ticker, mom_k ...): log return over k bars in units of its expected deviation."""
    rows = return_vol(panel)
    found = {f"mom_{k}": F.when(F.col("vol") > 0, F.log(F.col("close") / lagged("close", k)) / (F.col("vol") * math.sqrt(k))) for k in lookbacks}
    return rows.select("date", "ticker", *[c.alias(n) for n, c in found.items()])


def winsorised(rows: DataFrame, value: str, out: str, *, halflife: float = WINSOR_HALFLIFE, width: float = WINSOR_WIDTH, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Clip to the running mean +- ``width`` deviations, the current value included; unchanged while these are cold."""
    rows = ewm_moments(rows, list(keys), "date", value, "__mean", "__dev", halflife=halflife)
    low, high = F.col("__mean") - width * F.col("__dev"), F.col("__mean") + width * F.col("__dev")
    return rows.withColumn(out, F.least(F.greatest(F.col(value), low), high)).drop("__mean", "__dev")


def clip_rates(rows: DataFrame, halflives: tuple[float, ...], widths: tuple[float, ...] = (WINSOR_WIDTH,)) -> DataFrame:
    """(halflife, width, feature, n, rate): the share of each feature's values that winsorised() would change, from (date, ticker, feature, value).

    One scan for all half-lives and widths; values without deviations yet count as unchanged.
    """
    keys = ["ticker", "feature"]
    rows = observation_numbers(rows.where("value is not null"), keys, "date")
    decays = {k: 1 - alpha(halflife=h) for k, h in enumerate(halflives)}
    v = F.col("value")
    rows = decayed_sums(rows, keys, "n", {f"__{s}{k}": (x, d) for k, d in decays.items() for s, x in (("x", v), ("y", v * v))})
    each = []
    for k, h in enumerate(halflives):
        d, least = decays[k], default_periods(halflife=h)
        off, dev = F.abs(v - mean_column(d, least, f"__x{k}")), F.sqrt(variance_column(d, least, f"__x{k}", f"__y{k}"))
        each += [(h, w, F.avg(F.coalesce(off > w * dev, F.lit(False)).cast("double"))) for w in widths]
    found = rows.groupBy("feature").agg(F.count("*").alias("n"), *[rate.alias(f"r{k}") for k, (_, _, rate) in enumerate(each)])
    grid = F.array(*[F.struct(F.lit(h).alias("halflife"), F.lit(w).alias("width"), F.col(f"r{k}").alias("rate")) for k, (h, w, _) in enumerate(each)])
    return found.select("feature", "n", F.inline(grid)).select("halflife", "width", "feature", "n", "rate")


def feature_panel(panel: DataFrame, squash_momentum: bool = False, squash_macd: bool = True, winsorise: bool = True) -> DataFrame:
    """(date, ticker, mom_1 ... mom_252, macd_8_24 ...): squashed where asked, then winsorised; null while warming up."""
    names = [*(f"mom_{k}" for k in LOOKBACKS), *(f"macd_{s}_{l}" for s, l in MACD_PAIRS)]
    rows = vol_scaled_momentum(panel).join(macd(panel), ["date", "ticker"])
    rows = rows.withColumns({n: response(F.col(n)) for n in names if (squash_momentum if n.startswith("mom") else squash_macd)})
    if not winsorise:
        return rows.select("date", "ticker", *names)
    # one scan for all features, keyed by ticker and feature
    long = rows.unpivot(["date", "ticker"], names, "feature", "value")
    clipped = winsorised(long.where("value is not null"), "value", "clipped", keys=("ticker", "feature"))
    wide = clipped.groupBy("date", "ticker").pivot("feature", names).agg(F.first("clipped"))
    return panel.select("date", "ticker").join(wide, ["date", "ticker"], "left").select("date", "ticker", *names)
