"""Factor weights over a changing universe, and the one-factor model in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ewm import ewm_covariance


def factor_weights(factors: DataFrame, universe: DataFrame) -> DataFrame:
    """(date, name, ticker, weight): both legs of a factor are scaled up to their full sums over the live tickers.

    A factor with a leg that has no live ticker has no row on that date.
    ``factors``: (name, weights map); ``universe``: (date, ticker).
    """
    legs = factors.select("name", F.explode("weights").alias("ticker", "w")).where("w != 0").withColumn("side", F.signum("w"))
    whole = legs.groupBy("name", "side").agg(F.sum("w").alias("leg"))
    wanted = whole.groupBy("name").agg(F.count("*").alias("legs"))
    live = universe.join(legs, "ticker")
    held = live.groupBy("date", "name", "side").agg(F.sum("w").alias("live_leg"))
    complete = held.groupBy("date", "name").agg(F.count("*").alias("live_legs")).join(wanted, "name").where("legs = live_legs").select("date", "name")
    rows = live.join(held, ["date", "name", "side"]).join(whole, ["name", "side"]).join(complete, ["date", "name"], "left_semi")
    return rows.select("date", "name", "ticker", (F.col("w") * F.col("leg") / F.col("live_leg")).alias("weight"))


def complete_universe(cov: DataFrame) -> DataFrame:
    """(bar, ticker) with a positive variance and a covariance with every such ticker of the bar; one pass.

    ``cov``: (bar, i, j, cov) for i <= j, null while cold, carried to every bar.
    """
    warm = cov.where("i = j and cov > 0").select("bar", F.col("i").alias("ticker"))
    both = cov.where("cov is not null")
    sides = both.select("bar", F.col("i").alias("ticker"), F.col("j").alias("other")).union(both.where("i != j").select("bar", "j", "i"))
    others = warm.withColumnRenamed("ticker", "other")
    held = sides.join(others, ["bar", "other"]).groupBy("bar", "ticker").agg(F.count("*").alias("n"))
    needed = warm.groupBy("bar").agg(F.count("*").alias("all"))
    return warm.join(held, ["bar", "ticker"]).join(needed, "bar").where("n = all").select("bar", "ticker")


def one_factor(returns: DataFrame, weights: DataFrame, *, span: float, periods: int, floor: float = 0.1) -> DataFrame:
    """(bar, ticker, beta, factor_var, var, common, specific) of a market factor with fixed weights, in closed form.

    The factor return is the weighted sum of the bar's returns, a missing one counting 0. Rows of higher common variance than their own
    are capped; the specific variance is what remains, ``floor`` of the own variance at least.
    ``returns``: (bar, ticker, value); ``weights``: (ticker, weight).
    """
    joined = returns.join(weights, "ticker", "left").where("value is not null")
    market = joined.groupBy("bar").agg(F.sum(F.col("value") * F.coalesce("weight", F.lit(0.0))).alias("value"))
    both = returns.select("bar", "ticker", "value").union(market.select("bar", F.lit(" market").alias("ticker"), "value"))
    cov = ewm_covariance(both, span=span, periods=periods).where("cov is not null")
    # a ticker's variance and its covariance with the market are two rows of one reading, the market's own variance a third; no joins
    rows = cov.where("i = j or i = ' market'").select("bar", F.when(F.col("i") == " market", F.col("j")).otherwise(F.col("i")).alias("ticker"), "i", "j", "cov").repartition("bar")
    rows = rows.groupBy("bar", "ticker").agg(F.max(F.when(F.expr("i = j"), F.col("cov"))).alias("var"), F.max(F.when(F.col("i") == " market", F.col("cov"))).alias("cross"))
    rows = rows.withColumn("factor_var", F.max(F.when(F.col("ticker") == " market", F.col("cross"))).over(Window.partitionBy("bar")))
    rows = rows.where("ticker != ' market' and var is not null and cross is not null and factor_var > 0")
    beta = F.col("cross") / F.col("factor_var")
    common = beta * beta * F.col("factor_var")
    capped = F.when(common > F.col("var"), beta * F.sqrt(F.col("var") / common)).otherwise(beta)
    rows = rows.withColumn("beta", capped).withColumn("common", F.col("beta") * F.col("beta") * F.col("factor_var"))
    return rows.withColumn("specific", F.greatest(floor * F.col("var"), F.col("var") - F.col("common"))).drop("cross")


def decompose(model: DataFrame, weights: DataFrame) -> DataFrame:
    """(bar, exposure, variance, factor_share, specific_share) of fixed holdings (ticker, weight) under one_factor()."""
    rows = model.join(weights, "ticker")
    sums = rows.groupBy("bar").agg(F.sum(F.col("beta") * F.col("weight")).alias("exposure"), F.sum(F.col("specific") * F.col("weight") * F.col("weight")).alias("own"), F.max("factor_var").alias("factor_var"))
    sums = sums.withColumn("factor", F.col("exposure") * F.col("exposure") * F.col("factor_var"))
    total = F.col("factor") + F.col("own")
    share = lambda c: F.when(total > 0, F.col(c) / total).otherwise(0.0)
    return sums.select("bar", "exposure", total.alias("variance"), share("factor").alias("factor_share"), share("own").alias("specific_share"))
