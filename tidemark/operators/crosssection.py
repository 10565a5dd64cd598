"""Statistics of one date's cross-section, and sums over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRADING_DAYS = 252
# Robust sigma of a median deviation, the clip in such sigmas, the fewest names.
MAD_SCALE, STYLE_CLIP, FEWEST_NAMES = 1.4826, 3.0, 3


def robust_zscore(rows: DataFrame, value: str, out: str, keys: list[str]) -> DataFrame:
    """Clip at median +- 3 robust sigmas (unless that is 0), then the population z-score.

    Null where the clipped values have no spread or the keys have fewer than three rows. Null values are dropped.
    """
    rows = rows.where(F.col(value).isNotNull())
    middle = rows.groupBy(*keys).agg(F.median(value).alias("__mid"), F.count("*").alias("__n"))
    rows = rows.join(middle, keys)
    spread = rows.groupBy(*keys).agg((F.median(F.abs(F.col(value) - F.col("__mid"))) * MAD_SCALE).alias("__sigma"))
    rows = rows.join(spread, keys)
    low, high = F.col("__mid") - STYLE_CLIP * F.col("__sigma"), F.col("__mid") + STYLE_CLIP * F.col("__sigma")
    rows = rows.withColumn("__v", F.when(F.col("__sigma") > 0, F.least(F.greatest(F.col(value), low), high)).otherwise(F.col(value)))
    over = Window.partitionBy(*keys)
    std = F.stddev_pop("__v").over(over)
    score = F.when((F.col("__n") >= FEWEST_NAMES) & (std > 0), (F.col("__v") - F.avg("__v").over(over)) / std)
    return rows.withColumn(out, score).drop("__mid", "__n", "__sigma", "__v")


def momentum_exposure(raw: DataFrame, sigma: DataFrame) -> DataFrame:
    """(date, ticker, exposure) from raw momentum and positive deviations; three names at least."""
    rows = raw.join(sigma.where("sigma > 0"), ["date", "ticker"]).withColumn("ratio", F.col("raw") / F.col("sigma"))
    return robust_zscore(rows, "ratio", "exposure", ["date"]).where("exposure is not null").select("date", "ticker", "exposure")


def target_vol_weights(scores: DataFrame, vols: DataFrame, target: float = 0.15) -> DataFrame:
    """(date, ticker, weight): score / N * target / annual vol over the names with a positive vol."""
    rows = scores.join(vols.where("vol > 0").select("date", "ticker", "vol"), ["date", "ticker"])
    count = F.count("*").over(Window.partitionBy("date"))
    return rows.withColumn("weight", F.col("score") / count * (target / (F.col("vol") * TRADING_DAYS**0.5))).select("date", "ticker", "weight")


def t_stat(value: str) -> Column:
    """mean / sample deviation * sqrt(n); 0 where the deviation is 0 or null."""
    std = F.stddev_samp(value)
    return F.when(std > 0, F.avg(value) / std * F.sqrt(F.count(F.lit(1)))).otherwise(0.0)


def summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Annual mean, sample deviation and t-statistic of each key's values."""
    return rows.groupBy(*keys).agg((F.avg(value) * TRADING_DAYS).alias("annual_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), t_stat(value).alias("t"))


def calendar_vol(rows: DataFrame, keys: list[str], value: str, date: str = "date") -> DataFrame:
    """Sample deviation times the root of observations a calendar year; 0 for fewer than two or no time."""
    years = F.datediff(F.max(date), F.min(date)) / 365.25
    n = F.count(value)
    return rows.groupBy(*keys).agg(F.when((n >= 2) & (years > 0), F.stddev_samp(value) * F.sqrt(n / F.nullif(years, F.lit(0.0)))).otherwise(0.0).alias("vol"))


def rolling(value: str, window: int, least: int, keys: list[str], order: str = "date") -> Column:
    """Sample deviation of the last ``window`` rows with ``least`` values at least."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    return F.when(F.count(value).over(frame) >= least, F.stddev_samp(value).over(frame))


def running_sum(value: str, keys: list[str], order: str = "date") -> Column:
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def pair_correlation(rows: DataFrame, value: str, key: str = "ticker", on: str = "date") -> DataFrame:
    """(i, j, corr, n) for i < j over the dates that both have."""
    a = rows.select(on, F.col(key).alias("i"), F.col(value).alias("x"))
    b = rows.select(on, F.col(key).alias("j"), F.col(value).alias("y"))
    return a.join(b, on).where("i < j and x is not null and y is not null").groupBy("i", "j").agg(F.corr("x", "y").alias("corr"), F.count("*").alias("n"))


def column_correlation(rows: DataFrame, names: list[str]) -> DataFrame:
    """(i, j, corr, n) of the columns ``names``, i before j, over the rows where both have a value: one aggregate of the wide table."""
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    both = [F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs]
    found = rows.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)], *[F.count_if(c).alias(f"n{k}") for k, c in enumerate(both)])
    return found.select(F.inline(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"c{k}").alias("corr"), F.col(f"n{k}").alias("n")) for k, (a, b) in enumerate(pairs)])))


def value_shares(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    counts = rows.groupBy(*(by or []), column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*(by or []))))


def turnover(weights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, date, gross, turnover) from (keys, date, ticker, weight) on a full grid."""
    before = F.lag("weight", 1, 0.0).over(Window.partitionBy(*keys, "ticker").orderBy("date"))
    moved = weights.withColumn("__m", F.abs(F.col("weight") - before))
    return moved.groupBy(*keys, "date").agg(F.sum(F.abs("weight")).alias("gross"), F.sum("__m").alias("turnover"))


def monthly_returns(equity: DataFrame, keys: list[str]) -> DataFrame:
    """Return of each calendar month: its last equity over the month before's last, the first month's over its first."""
    month = F.trunc("date", "month")
    rows = equity.groupBy(*keys, month.alias("month")).agg(F.min_by("equity", "date").alias("first"), F.max_by("equity", "date").alias("last"))
    before = F.coalesce(F.lag("last").over(Window.partitionBy(*keys).orderBy("month")), F.col("first"))
    return rows.withColumn("ret", F.col("last") / before - 1).select(*keys, "month", "ret")
