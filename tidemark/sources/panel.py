"""Price panels: (date, ticker, close) rows read from Parquet or made from the star-schema tables."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PANEL = T.StructType([T.StructField("date", T.TimestampType()), T.StructField("ticker", T.StringType()), T.StructField("close", T.DoubleType())])

FACTOR_FILE = T.StructType([T.StructField("factors", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("granular", T.BooleanType()), T.StructField("weights", T.MapType(T.StringType(), T.DoubleType()))])))])


def read_panel(spark: SparkSession, path: str, tickers: list[str] | None = None) -> DataFrame:
    """Three columns of a Parquet panel; the ticker filter reaches the scan."""
    panel = spark.read.schema(PANEL).parquet(path)
    return panel if tickers is None else panel.where(F.col("ticker").isin(tickers))


def write_panel(panel: DataFrame, path: str) -> None:
    panel.select("date", "ticker", "close").write.mode("overwrite").parquet(path)


def lineitem_bars(spark: SparkSession, sf_dir: str, dimension: str = "r_name") -> DataFrame:
    """Daily unit price of the lines of each region (r_name), nation (n_name) or brand (p_brand)."""
    table = lambda name, *columns: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    lines = table("lineitem", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    if dimension == "p_brand":
        df = lines.join(table("part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    else:
        df = lines.join(table("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(table("nation", "n_nationkey", "n_name", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
        if dimension == "r_name":
            df = df.join(table("region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    return df.groupBy(F.to_date("l_shipdate").alias("date"), F.col(dimension).alias("ticker")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a tick of its type."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").alias("date"), F.col("event_type").alias("ticker"), F.col("value").alias("close"))


def good_ticks(panel: DataFrame) -> DataFrame:
    """Finite positive closes only."""
    return panel.where(~F.isnan("close") & (F.col("close") > 0) & (F.col("close") < float("inf")))


def by_ticker(order: str = "date"):
    return Window.partitionBy("ticker").orderBy(order)


def with_returns(panel: DataFrame, order: str = "date") -> DataFrame:
    """Log and simple return to the close seen before, however long ago."""
    before = F.lag("close").over(by_ticker(order))
    return panel.withColumn("log_return", F.log(F.col("close") / before)).withColumn("simple_return", F.try_divide("close", before) - 1)


def bar_numbers(panel: DataFrame) -> DataFrame:
    """(date, bar): the panel's dates numbered from 1. One row a date passes the ordered window."""
    return panel.select("date").distinct().withColumn("bar", F.row_number().over(Window.orderBy("date")).cast("long"))


def dense_panel(panel: DataFrame) -> DataFrame:
    """Every (date, ticker) from the first date on, with the last close seen as ``sticky``; the grid is the result, so it is a product."""
    grid = panel.select("date").distinct().crossJoin(panel.select("ticker").distinct())
    frame = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(panel, ["date", "ticker"], "left").withColumn("sticky", F.last("close", ignorenulls=True).over(frame))


def wide_panel(panel: DataFrame, tickers: list[str]) -> DataFrame:
    return panel.groupBy("date").pivot("ticker", tickers).agg(F.first("close"))


def read_factors(spark: SparkSession, path: str, granular: bool) -> DataFrame:
    """(name, level, granular, weights, ord) of a factor file, in a stable order of level.

    ValueError for a factor without weights or a name given twice.
    """
    file = spark.read.schema(FACTOR_FILE).option("multiLine", True).json(path)
    rows = file.select(F.posexplode("factors").alias("pos", "f")).select("pos", "f.*").withColumn("granular", F.coalesce("granular", F.lit(False)))
    twice = [r.name for r in rows.groupBy("name").count().where("count > 1").collect()]
    empty = [r.name for r in rows.where("weights is null or size(weights) = 0").select("name").collect()]
    if twice or empty:
        raise ValueError(f"{path}: " + "; ".join([*(f"factor {n} is given twice" for n in twice), *(f"factor {n} has no weights" for n in empty)]))
    rows = rows.where(F.col("granular") == F.lit(False)) if not granular else rows
    return rows.withColumn("ord", F.row_number().over(Window.orderBy("level", "pos"))).drop("pos").orderBy("ord")


def factor_tickers(factors: DataFrame) -> DataFrame:
    return factors.select(F.explode(F.map_keys("weights")).alias("ticker")).distinct()


def universe(tickers: list[str], factors: DataFrame) -> list[str]:
    """The traded tickers, then those that only factors name, in the factors' order; each once. The driver holds the names of a config."""
    named = factors.select("ord", F.posexplode(F.map_keys("weights")).alias("pos", "ticker")).groupBy("ticker").agg(F.min(F.struct("ord", "pos")).alias("at"))
    return list(dict.fromkeys([*tickers, *(r.ticker for r in named.orderBy("at").collect())]))


def read_config(path: str, allowed: dict) -> dict:
    """A JSON object with known keys over their defaults; ValueError names the path and what is wrong."""
    try:
        given = json.loads(Path(path).read_text())
    except (OSError, json.JSONDecodeError) as bad:
        raise ValueError(f"{path}: {bad}") from bad
    if not isinstance(given, dict):
        raise ValueError(f"{path}: not an object")
    if unknown := sorted(given.keys() - allowed.keys()):
        raise ValueError(f"{path}: unknown keys {', '.join(unknown)}")
    return allowed | given


def synthetic_panel(spark: SparkSession, tickers: list[str], bars: int, seed: int = 7) -> DataFrame:
    """Arithmetic walks from 100 over daily bars from 2020-01-01; the tickers draw one after another."""
    draw = np.random.default_rng(seed)
    days = np.datetime64("2020-01-01") + np.arange(bars)
    rows = [(d.astype("datetime64[us]").item(), t, float(c)) for t in tickers for d, c in zip(days, 100 + np.cumsum(draw.normal(size=bars)), strict=True)]
    return spark.createDataFrame(rows, PANEL)
