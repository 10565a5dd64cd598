"""Exponentially weighted sums, means, deviations and covariances as a scan in two levels.

A series is cut into chunks of CHUNK places. Within a chunk the weighted sum is a window sum with weights
relative to the chunk; each chunk's total is carried to the next ones with its decay, in a frame of as many chunks
as the decay leaves above 1e-18. Both levels are windows over the same key, so a long series is no single fold
and weights never overflow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 256


def alpha(span: float | None = None, halflife: float | None = None) -> float:
    if (span is None) == (halflife is None):
        raise ValueError("give either span or halflife")
    return 2 / (span + 1) if span is not None else 1 - math.exp(math.log(0.5) / halflife)


def default_periods(span: float | None = None, halflife: float | None = None) -> int:
    return int(math.ceil(halflife if halflife is not None else span))


def decayed_sums(df: DataFrame, keys: list[str], place: str, sums: dict[str, tuple[Column, float]], chunk: int = CHUNK) -> DataFrame:
    """Add a column for each of ``sums``, name -> (value, decay): the sum of value * decay^(distance in ``place``).

    ``place``: a long from 1, ascending within the keys, with or without gaps. Values may not be null.
    Two windows and no join, so the input is read once; rows that are already dealt by ``keys`` aren't moved again.
    """
    df = df.withColumn("__c", F.floor((F.col(place) - 1) / chunk)).withColumn("__l", (F.col(place) - 1) % chunk)
    df = df.withColumns({f"__x_{name}": value.cast("double") for name, (value, _) in sums.items()})
    inside = Window.partitionBy(*keys, "__c").orderBy(place)
    local = {f"__s_{name}": F.sum(F.col(f"__x_{name}") * F.pow(F.lit(d), -F.col("__l"))).over(inside) * F.pow(F.lit(d), F.col("__l")) for name, (_, d) in sums.items()}
    df = df.withColumns({**local, "__more": F.lead(place).over(inside)})
    # the last row of a chunk has its totals, carried to the chunk's end
    totals = F.struct("__c", *[(F.col(f"__s_{name}") * F.pow(F.lit(d), F.lit(chunk - 1) - F.col("__l"))).alias(name) for name, (_, d) in sums.items()])
    reach = max(max(1, math.ceil(-42 / (chunk * math.log(d)))) for _, d in sums.values())
    before = Window.partitionBy(*keys).orderBy("__c").rangeBetween(-reach, -1)
    df = df.withColumn("__t", F.when(F.col("__more").isNull(), totals)).withColumn("__past", F.collect_list("__t").over(before))
    df = df.withColumns({name: F.col(f"__s_{name}") + F.pow(F.lit(d), F.col("__l") + 1) * _carried(name, d, chunk) for name, (_, d) in sums.items()})
    return df.drop("__c", "__l", "__more", "__t", "__past", *[f"__{p}_{name}" for p in "xs" for name in sums])


def _carried(name: str, decay: float, chunk: int) -> Column:
    here = F.col("__c")
    return F.aggregate("__past", F.lit(0.0), lambda total, p: total + p[name] * F.pow(F.lit(decay**chunk), here - p["__c"] - 1))


def observation_numbers(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long"))


def mean_column(decay: float, periods: int, sum_x: str, n: str = "n") -> Column:
    weight = (1 - F.pow(F.lit(decay), F.col(n))) / (1 - decay)
    return F.when(F.col(n) >= periods, F.col(sum_x) / weight)


def variance_column(decay: float, periods: int, sum_x: str, sum_xx: str, n: str = "n") -> Column:
    """Bias-corrected; null before ``periods`` (two at least), never negative."""
    weight = (1 - F.pow(F.lit(decay), F.col(n))) / (1 - decay)
    squares = (1 - F.pow(F.lit(decay * decay), F.col(n))) / (1 - decay * decay)
    below = weight * weight - squares
    spread = weight * F.col(sum_xx) - F.col(sum_x) * F.col(sum_x)
    return F.when((F.col(n) >= max(periods, 2)) & (below > 0), F.greatest(F.try_divide(spread, below), F.lit(0.0)))


def ewm_mean(df: DataFrame, keys: list[str], order: str, value: str, out: str, *, span: float | None = None, halflife: float | None = None, periods: int | None = None) -> DataFrame:
    """Mean over the rows where ``value`` is not null; the other rows are dropped."""
    d = 1 - alpha(span, halflife)
    periods = default_periods(span, halflife) if periods is None else periods
    rows = observation_numbers(df.where(F.col(value).isNotNull()), keys, order)
    rows = decayed_sums(rows, keys, "n", {"__sx": (F.col(value), d)})
    return rows.withColumn(out, mean_column(d, periods, "__sx")).drop("n", "__sx")


def ewm_moments(df: DataFrame, keys: list[str], order: str, value: str, mean: str, std: str, *, span: float | None = None, halflife: float | None = None, periods: int | None = None) -> DataFrame:
    """Mean and bias-corrected deviation over the rows where ``value`` is not null; the other rows are dropped."""
    d = 1 - alpha(span, halflife)
    periods = default_periods(span, halflife) if periods is None else periods
    rows = observation_numbers(df.where(F.col(value).isNotNull()), keys, order)
    rows = decayed_sums(rows, keys, "n", {"__sx": (F.col(value), d), "__sxx": (F.col(value) * F.col(value), d)})
    rows = rows.withColumn(mean, mean_column(d, periods, "__sx")).withColumn(std, F.sqrt(variance_column(d, periods, "__sx", "__sxx")))
    return rows.drop("n", "__sx", "__sxx")


def ewm_covariance(returns: DataFrame, *, span: float, periods: int) -> DataFrame:
    """(bar, i, j, n, cov) for i <= j from (bar, ticker, value), by blocks of tickers and chunks of bars: gram.pair_covariances()."""
    from .gram import pair_covariances

    return pair_covariances(returns, span=span, periods=periods)
