"""From a config to legs, logs, attribution and report tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import settled
from ..operators.crosssection import monthly_returns
from ..operators.features import macd_score
from ..sources import panel as P
from . import attribution as A
from . import backtest as B
from . import riskmodel as R
from .configs import Backtest


@dataclass(frozen=True)
class Run:
    legs: list[B.Leg]
    folded: DataFrame
    curve: DataFrame
    trades: DataFrame
    #: Rows for an optimised leg only.
    solves: DataFrame
    #: None without a factor model.
    attribution: A.Attribution | None
    factors: DataFrame | None


def sticky_panel(panel: DataFrame) -> DataFrame:
    """The last close seen of every ticker on every bar: what a live book sees, zero returns over holes included."""
    return P.dense_panel(panel).where("sticky is not null").select("date", "ticker", F.col("sticky").alias("close"))


def optimised_snapshots(panel: DataFrame, model: R.Config) -> DataFrame:
    """Snapshots with their dates, of the prices that a live book sees."""
    seen = settled(sticky_panel(panel))
    return settled(R.snapshots(seen, model)).join(P.bar_numbers(seen), "bar")


def run_backtest(spark: SparkSession, config: Backtest, panel: DataFrame | None = None) -> Run:
    """The strategy leg and the buy-and-hold leg of a config; ``panel`` in place of the config's data.

    The optimiser's model reads sticky prices of the traded tickers; attribution replays a model of the bars' own closes, over the traded tickers
    and those that factors name.
    """
    source = P.read_panel(spark, config.data) if panel is None else panel
    traded = settled(source.where(F.col("ticker").isin(config.tickers)))
    legs, snaps, factors = config.legs(), None, None
    if config.factor_model is not None:
        factors = P.read_factors(spark, config.factor_model.factors_file, config.factor_model.granular)
    if config.portfolio == "optimized":
        snaps = optimised_snapshots(traded, config.factor_model.model(config.tickers, factors))
    folded = settled(B.fold_legs(settled(B.leg_inputs(traded, settled(macd_score(traded)))), legs, snaps))
    found = None
    if factors is not None:
        names = P.universe(config.tickers, factors)
        whole = settled(source.where(F.col("ticker").isin(names)))
        found = A.attribute(folded, settled(R.snapshots(whole, config.factor_model.model(names, factors))), whole)
    definitions = None if factors is None else P.read_factors(spark, config.factor_model.factors_file, True)
    return Run(legs, folded, B.equity_curve(folded), B.trade_log(folded), B.solve_log(folded, legs), found, definitions)


def signed(column: str, places: int = 2) -> Column:
    return F.format_string(f"%+.{places}f", column)


def percent(column: str | Column, places: int = 2, sign: bool = True) -> Column:
    return F.format_string(f"%{'+' if sign else ''}.{places}f%%", (F.col(column) if isinstance(column, str) else column) * 100)


def factor_definitions(factors: DataFrame, granular: bool) -> DataFrame:
    """(factor, level, granular, active, weights) of all factors of a file, granular ones included, as text."""
    yes = lambda c: F.when(c, "yes").otherwise("no")
    weights = F.array_join(F.transform(F.map_entries("weights"), lambda e: F.format_string("%s %+.2f", e["key"], e["value"])), ", ")
    return factors.select(F.col("name").alias("factor"), F.col("level").cast("string").alias("level"), yes(F.col("granular")).alias("granular"), yes(F.lit(granular) | ~F.col("granular")).alias("active"), weights.alias("weights"))


def report_tables(run: Run, granular: bool = False) -> dict[str, DataFrame]:
    """The tables of a report by name; cells of the printed ones are text."""
    tables = {"metrics": B.metrics(run.curve), "monthly": monthly_returns(run.curve, ["leg"]), "correlation": B.leg_correlation(run.curve), "trades": run.trades}
    if any(leg.kind == "optimized" for leg in run.legs):
        shares, numbers = B.solver_summary(run.solves)
        rows = [shares.select("leg", F.concat(F.lit("Binding: "), "binding").alias("metric"), percent("share", 1, False).alias("value"))]
        for metric, value in (("Solver failures", F.format_number("failures", 0)), ("Mean ex-ante vol", percent("mean_vol", 2, False)), ("Max gross", F.format_string("%.2fx", "max_gross")), ("Annual turnover", F.format_string("%.1fx", "annual_turnover"))):
            rows.append(numbers.select("leg", F.lit(metric).alias("metric"), value.alias("value")))
        table = rows[0]
        for more in rows[1:]:
            table = table.unionByName(more)
        tables |= {"solves": run.solves, "optimizer": table}
    if (found := run.attribution) is not None:
        fit = A.factor_regression(found)
        tables |= {
            "exposures": A.exposure_ranges(found).select("leg", "factor", signed("mean").alias("mean"), signed("least").alias("min"), signed("most").alias("max")),
            "risk": A.mean_shares(found),
            "volatility": A.volatilities(found),
            "returns": A.annual_contributions(found).select("leg", "factor", percent("annual").alias("annualized")),
            "edge": A.bucket_summary(found).select("leg", "bucket", percent("annual_mean").alias("annualized"), signed("t").alias("t_stat")),
            "timing": A.factor_summary(found).select("leg", "factor", percent("structural").alias("structural"), percent("timing").alias("timing"), signed("t_timing").alias("t_timing")),
            "regression": fit.select("leg", "term", signed("beta").alias("beta"), signed("t").alias("t_stat"), percent("contribution").alias("contribution"), F.format_string("%.2f", "r2").alias("r2")),
            "health": A.health(found).select("leg", F.format_string("%.2f", "bias").alias("bias"), F.format_number("bars", 0).alias("bars"), percent("predicted_vol", 2, False).alias("predicted_vol"), percent("realized_vol", 2, False).alias("realized_vol")),
            "rolling_bias": A.rolling_bias(found),
            "factors": factor_definitions(run.factors, granular),
        }
    return tables


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
