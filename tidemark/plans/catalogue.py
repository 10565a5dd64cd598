"""The queries of the panel engine over the star-schema tables, and the SQL that gives the same rows.

Floats are rounded to six places in both, and -0 becomes 0; dates are given as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import scratch, settled
from ..operators import crosssection as X
from ..operators import eigen as EI
from ..operators import ewm as E
from ..operators import factors as FA
from ..operators import features as FE
from ..operators import percentiles as PC
from ..operators.sliding import sliding_std
from ..sources import panel as P
from . import attribution as A
from . import backtest as B
from . import riskmodel as R
from .runner import optimised_snapshots

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: dates_as_text(f(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.lineitem_bars(spark, sf_dir, "r_name")


# --- SQL building blocks -------------------------------------------------------------------

BARS = """bars as (
  select cast(l_shipdate as date) as date, r_name as ticker, sum(l_extendedprice) / sum(l_quantity) as close
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  group by all)"""
NATIONS = BARS.replace("bars as", "nations as").replace("r_name", "n_name").replace(" join region on n_regionkey = r_regionkey", "")
RETURNS = "rets as (select date, ticker, close, ln(close / lag(close) over (partition by ticker order by date)) as r from bars)"
NUMBERED = "numbered as (select date, row_number() over (order by date) as bar from (select distinct date from bars))"


def o6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 as {name}"


def sql_ewm(name: str, source: str, value: str, decay: float, periods: int, reach: int = 1500) -> str:
    """CTEs: ``name`` has every row of ``source`` (date, ticker, value) with n, mean and std."""
    return f"""{name}_n as (select *, row_number() over (partition by ticker order by date) as n from {source} where {value} is not null),
{name}_s as (
  select a.ticker, a.n, sum(b.{value} * pow({decay!r}, a.n - b.n)) as sx, sum(b.{value} * b.{value} * pow({decay!r}, a.n - b.n)) as sxx,
    sum(pow({decay!r}, a.n - b.n)) as sw, sum(pow({decay!r}, 2 * (a.n - b.n))) as sw2
  from {name}_n a join {name}_n b on a.ticker = b.ticker and b.n <= a.n and b.n > a.n - {reach} group by all),
{name} as (
  select s.*, case when s.n >= {periods} then sx / sw end as mean,
    case when s.n >= greatest({periods}, 2) then sqrt(greatest((sw * sxx - sx * sx) / nullif(sw * sw - sw2, 0), 0)) end as std
  from {name}_n join {name}_s s using (ticker, n))""".replace("select s.*,", f"select {name}_n.*,")


def span(s: float) -> float:
    return 1 - E.alpha(span=s)


def half(h: float) -> float:
    return 1 - E.alpha(halflife=h)


def sql_macd(squash: bool) -> str:
    """CTEs up to ``macd`` (date, ticker, macd_8_24 ...)."""
    out = []
    for s in sorted({x for p in FE.MACD_PAIRS for x in p}):
        out.append(sql_ewm(f"e{s}", "bars", "close", span(s), s))
    out.append("spread as (select date, ticker, case when count(close) over w = 63 then stddev_samp(close) over w end as s from bars window w as (partition by ticker order by date rows 62 preceding))")
    names = []
    for s, l in FE.MACD_PAIRS:
        name = f"macd_{s}_{l}"
        y = "q / nullif(sd, 0)"
        out.append(f"q{s} as (select date, ticker, (a.mean - b.mean) / nullif(s, 0) as q from e{s} a join e{l} b using (date, ticker) join spread using (date, ticker) where b.mean is not null and s > 0)")
        out.append(f"d{s} as (select *, case when count(q) over w = 252 then stddev_samp(q) over w end as sd from q{s} window w as (partition by ticker order by date rows 251 preceding))")
        value = f"({y}) * exp(-({y}) * ({y}) / 4) / 0.89" if squash else y
        out.append(f"f{s} as (select date, ticker, {value} as {name} from d{s})")
        names.append(name)
    joins = " ".join(f"left join f{s} using (date, ticker)" for s, _ in FE.MACD_PAIRS)
    out.append(f"macd as (select date, ticker, {', '.join(names)} from bars {joins})")
    return ",\n".join(out)


def sql_momentum() -> str:
    columns = ", ".join(f"ln(close / lag(close, {k}) over (partition by ticker order by date)) / nullif(v.std * sqrt({k}), 0) as mom_{k}" for k in FE.LOOKBACKS)
    return f"{RETURNS},\n{sql_ewm('v', 'rets', 'r', span(60), 60)},\nmom as (select date, ticker, {columns} from bars left join (select date, ticker, std from v) v using (date, ticker))"


COV = f"""{RETURNS}, {NUMBERED},
obs as (select bar, ticker, r from rets join numbered using (date) where r is not null),
pairs as (select a.bar, a.ticker as i, b.ticker as j, a.r as x, b.r as y, row_number() over (partition by a.ticker, b.ticker order by a.bar) as n
  from obs a join obs b on a.bar = b.bar and a.ticker <= b.ticker),
covs as (select a.i, a.j, a.bar, any_value(a.n) as n,
    case when any_value(a.n) >= 60 then (sum(w) * sum(w * b.x * b.y) - sum(w * b.x) * sum(w * b.y)) / nullif(sum(w) * sum(w) - sum(w * w), 0) end as cov
  from pairs a join (select * from pairs) b on a.i = b.i and a.j = b.j and b.bar <= a.bar and b.bar > a.bar - 1500, lateral (select pow({span(60)!r}, a.bar - b.bar) as w)
  group by a.i, a.j, a.bar)"""


# --- sources, returns ----------------------------------------------------------------------


@query(f"with {BARS} select date::varchar as date, ticker, {o6('ln(close)', 'log_close')} from bars")
def price_bars(spark, sf_dir):
    return regions(spark, sf_dir).select("date", "ticker", r6(F.log("close")).alias("log_close"))


@query(f"with {BARS} select date::varchar as date, ticker, {o6('ln(close)', 'log_close')} from bars where ticker in ('ASIA', 'EUROPE')")
def ticker_filter(spark, sf_dir):
    path = scratch(spark, "panel")
    P.write_panel(regions(spark, sf_dir).withColumn("date", F.col("date").cast("timestamp")), path)
    rows = P.read_panel(spark, path, ["ASIA", "EUROPE"])
    return rows.select(F.to_date("date").alias("date"), "ticker", r6(F.log("close")).alias("log_close"))


@query(f"with {BARS} select date::varchar as date, " + ", ".join(f"round(ln(max(close) filter (ticker = '{t}')), 6) + 0.0 as \"{t}\"" for t in REGIONS) + " from bars group by date")
def wide_panel(spark, sf_dir):
    wide = P.wide_panel(regions(spark, sf_dir), list(REGIONS))
    return wide.select("date", *[r6(F.log(t)).alias(t) for t in REGIONS])


@query(f"with {BARS}, {RETURNS} select date::varchar as date, ticker, {o6('r', 'log_return')}, {o6('close / lag(close) over (partition by ticker order by date) - 1', 'simple_return')} from rets")
def returns(spark, sf_dir):
    return rounded(P.with_returns(regions(spark, sf_dir)), "log_return", "simple_return").drop("close")


@query("select event_id, event_type as ticker, round(ln(value / lag(value) over (partition by event_type order by ts, event_id)), 6) + 0.0 as log_return from events where value > 0 and isfinite(value)")
def bad_tick_filter(spark, sf_dir):
    ticks = P.good_ticks(P.event_ticks(spark, sf_dir)).withColumn("place", F.struct("date", "event_id"))
    return rounded(P.with_returns(ticks, "place"), "log_return").select("event_id", "ticker", "log_return")


@query(f"""with {BARS}, grid as (select * from (select distinct date from bars), (select distinct ticker from bars))
select date::varchar as date, ticker, {o6('ln(close)', 'log_close')}, round(ln(last_value(close ignore nulls) over (partition by ticker order by date)), 6) + 0.0 as log_sticky from grid left join bars using (date, ticker)""")
def sticky_prices(spark, sf_dir):
    rows = P.dense_panel(regions(spark, sf_dir))
    return rows.select("date", "ticker", r6(F.log("close")).alias("log_close"), r6(F.log("sticky")).alias("log_sticky"))


@query(f"""with {BARS}, {RETURNS}, {NUMBERED}, grid as (select * from numbered, (select distinct ticker from bars))
select bar, ticker, round(coalesce(r, 0), 6) + 0.0 as r from grid left join rets using (date, ticker) where (bar - 1) % 5 = 0""")
def sampled_zero_filled(spark, sf_dir):
    panel = regions(spark, sf_dir)
    bars = P.bar_numbers(panel)
    grid = bars.crossJoin(panel.select("ticker").distinct()).where((F.col("bar") - 1) % 5 == 0)
    rows = grid.join(P.with_returns(panel), ["date", "ticker"], "left")
    return rows.select("bar", "ticker", r6(F.coalesce("log_return", F.lit(0.0))).alias("r"))


@query("select s.s_name as name, count(*) as bars, max(l_shipdate)::date::varchar as last from lineitem join supplier s on l_suppkey = s_suppkey where s_nationkey not in (select n_nationkey from nation where n_regionkey = 0) group by s.s_name")
def universe_anti_join(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    away = t("nation").where("n_regionkey = 0").select("n_nationkey")
    kept = t("supplier").join(away, F.col("s_nationkey") == F.col("n_nationkey"), "left_anti")
    return t("lineitem").join(kept, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_name").alias("name")).agg(F.count("*").alias("bars"), F.to_date(F.max("l_shipdate")).alias("last"))


# --- exponentially weighted and rolling ----------------------------------------------------


@query(f"with {BARS}, {sql_ewm('e', 'bars', 'close', span(60), 60)} select date::varchar as date, ticker, {o6('mean', 'mean')} from e")
def ewm_mean_span(spark, sf_dir):
    return rounded(E.ewm_mean(regions(spark, sf_dir), ["ticker"], "date", "close", "mean", span=60), "mean").drop("close")


@query(f"with {BARS}, {sql_ewm('e', 'bars', 'close', half(31), 31)} select date::varchar as date, ticker, {o6('mean', 'mean')} from e")
def ewm_mean_halflife(spark, sf_dir):
    return rounded(E.ewm_mean(regions(spark, sf_dir), ["ticker"], "date", "close", "mean", halflife=31), "mean").drop("close")


@query(f"with {BARS}, {RETURNS}, {sql_ewm('e', 'rets', 'r', span(60), 60)} select date::varchar as date, ticker, {o6('std', 'std')} from e")
def ewm_std_span(spark, sf_dir):
    rows = P.with_returns(regions(spark, sf_dir))
    return rounded(E.ewm_moments(rows, ["ticker"], "date", "log_return", "mean", "std", span=60), "std").select("date", "ticker", "std")


@query(f"with {BARS}, {RETURNS} select date::varchar as date, ticker, case when count(r) over w = 63 then round(stddev_samp(r) over w, 6) + 0.0 end as std from rets window w as (partition by ticker order by date rows 62 preceding)")
def rolling_std_63(spark, sf_dir):
    rows = P.with_returns(regions(spark, sf_dir))
    return sliding_std(rows, "log_return", 63, ["ticker"], "date", "std").select("date", "ticker", r6("std").alias("std"))


@query(f"with {BARS} select date::varchar as date, ticker, round(ln(lag(close, 252) over (partition by ticker order by date)), 6) + 0.0 as log_before from bars")
def lag_252(spark, sf_dir):
    return regions(spark, sf_dir).select("date", "ticker", r6(F.log(FE.lagged("close", 252))).alias("log_before"))


@query(f"with {BARS} select date::varchar as date, ticker, round(ln(lag(close, 21) over w / lag(close, 252) over w), 6) + 0.0 as raw from bars window w as (partition by ticker order by date)")
def mom_12_1(spark, sf_dir):
    return regions(spark, sf_dir).select("date", "ticker", r6(FE.momentum_12_1()).alias("raw"))


# --- features ------------------------------------------------------------------------------

MACD_NAMES = [f"macd_{s}_{l}" for s, l in FE.MACD_PAIRS]
MOM_NAMES = [f"mom_{k}" for k in FE.LOOKBACKS]


@query(f"with {BARS}, {sql_macd(False)} select date::varchar as date, ticker, {', '.join(o6(n, n) for n in MACD_NAMES)} from macd")
def macd_features(spark, sf_dir):
    return rounded(FE.macd(regions(spark, sf_dir)), *MACD_NAMES)


SCORE = f"({' + '.join(MACD_NAMES)}) / 3"


@query(f"with {BARS}, {sql_macd(True)} select date::varchar as date, ticker, {o6(SCORE, 'score')} from macd where {SCORE} is not null")
def macd_score(spark, sf_dir):
    return rounded(FE.macd_score(regions(spark, sf_dir)), "score")


@query(f"with {BARS}, {sql_momentum()} select date::varchar as date, ticker, {', '.join(o6(n, n) for n in MOM_NAMES)} from mom")
def vol_scaled_momentum(spark, sf_dir):
    return rounded(FE.vol_scaled_momentum(regions(spark, sf_dir)), *MOM_NAMES)


@query(f"with {BARS}, {RETURNS} select date::varchar as date, ticker, round(r * exp(-r * r / 4) / 0.89, 6) + 0.0 as squashed from rets")
def response_function(spark, sf_dir):
    return P.with_returns(regions(spark, sf_dir)).select("date", "ticker", r6(FE.response(F.col("log_return"))).alias("squashed"))


@query(f"""with {BARS}, {RETURNS}, {sql_ewm('e', 'rets', 'r', half(31), 31)} select date::varchar as date, ticker,
  case when std is null then round(r, 6) else round(least(greatest(r, mean - 5 * std), mean + 5 * std), 6) end + 0.0 as clipped from e""")
def winsorised_returns(spark, sf_dir):
    rows = P.with_returns(regions(spark, sf_dir))
    return FE.winsorised(rows, "log_return", "clipped").select("date", "ticker", r6("clipped").alias("clipped"))


@query(f"""with {BARS}, {RETURNS}, {sql_ewm('e', 'rets', 'r', half(31), 31)}
select ticker, count(*) as n, round(avg(case when abs(r - mean) > 2 * std then 1.0 else 0.0 end), 6) + 0.0 as rate from e where std is not null group by ticker""")
def winsor_clip_rate(spark, sf_dir):
    rows = E.ewm_moments(P.with_returns(regions(spark, sf_dir)), ["ticker"], "date", "log_return", "mean", "std", halflife=31).where("std is not null")
    return rows.groupBy("ticker").agg(F.count("*").alias("n"), r6(F.avg((F.abs(F.col("log_return") - F.col("mean")) > 2 * F.col("std")).cast("double"))).alias("rate"))


ALL_NAMES = [*MOM_NAMES, *MACD_NAMES]


def _sql_features() -> str:
    """CTEs up to ``feats`` (date, ticker, the eight features)."""
    ctes = ["raw as (select * from mom join macd using (date, ticker))"]
    for k, n in enumerate(ALL_NAMES):
        ctes.append(f"raw{k} as (select date, ticker, {n} from raw)")
        ctes.append(sql_ewm(f"w{k}", f"raw{k}", n, half(31), 31, 900))
        ctes.append(f"c{k} as (select date, ticker, case when std is null then {n} else least(greatest({n}, mean - 5 * std), mean + 5 * std) end as {n} from w{k})")
    joins = " ".join(f"left join c{k} using (date, ticker)" for k in range(len(ALL_NAMES)))
    ctes.append(f"feats as (select bars.date, bars.ticker, {', '.join(f'c{k}.{n}' for k, n in enumerate(ALL_NAMES))} from bars {joins})")
    return f"{BARS}, {sql_momentum()}, {sql_macd(True)}, {', '.join(ctes)}"


FEATURES = _sql_features()
FULL = f"({' + '.join(ALL_NAMES)}) is not null"


@query(f"with {FEATURES} select date::varchar as date, ticker, {', '.join(o6(n, n) for n in ALL_NAMES)} from feats")
def feature_panel(spark, sf_dir):
    return rounded(FE.feature_panel(settled(regions(spark, sf_dir))), *ALL_NAMES)


def _full_features(spark, sf_dir):
    """The rows where all eight features have a value."""
    return FE.feature_panel(settled(regions(spark, sf_dir))).dropna(subset=ALL_NAMES)


@query(f"with {FEATURES}, whole as (select * from feats where {FULL}) " + " union all ".join(f"select '{a}' as i, '{b}' as j, {o6(f'corr({a}, {b})', 'corr')}, count(*) as n from whole" for k, a in enumerate(ALL_NAMES) for b in ALL_NAMES[k + 1 :]))
def feature_correlation(spark, sf_dir):
    return rounded(X.column_correlation(_full_features(spark, sf_dir), ALL_NAMES), "corr")


@query(f"with {FEATURES} select ticker, count(*) as bars, " + ", ".join(f"count(*) filter ({n} is null) as null_{n}" for n in ALL_NAMES) + f", min(date) filter ({FULL})::varchar as first_full from feats group by ticker")
def feature_warmup(spark, sf_dir):
    rows = FE.feature_panel(settled(regions(spark, sf_dir)))
    full = F.array_position(F.transform(F.array(*ALL_NAMES), lambda x: x.isNull()), True) == 0
    return rows.groupBy("ticker").agg(F.count("*").alias("bars"), *[F.count_if(F.col(n).isNull()).alias(f"null_{n}") for n in ALL_NAMES], F.min(F.when(full, F.col("date"))).alias("first_full"))


QUARTERS = (0.25, 0.5, 0.75)


@query(f"with {FEATURES}, whole as (select * from feats where {FULL}) " + " union all ".join(
    f"select '{n}' as feature, count(*) as n, {o6(f'avg({n})', 'mean')}, {o6(f'stddev_samp({n})', 'std')}, {o6(f'min({n})', 'least')}, {', '.join(o6(f'quantile_cont({n}, {p})', f'p{int(100 * p)}') for p in QUARTERS)}, {o6(f'max({n})', 'most')} from whole" for n in ALL_NAMES))
def feature_summary(spark, sf_dir):
    """Count, moments, range and quartiles of each feature over the rows where all have a value."""
    return rounded(PC.described(settled(_full_features(spark, sf_dir)), ALL_NAMES, QUARTERS).withColumnRenamed("column", "feature"), "mean", "std", "least", "p25", "p50", "p75", "most")


# --- cross-sections ------------------------------------------------------------------------

EXPOSURE = f"""{RETURNS}, {sql_ewm('v', 'rets', 'r', span(60), 60)},
raws as (select date, ticker, ln(lag(close, 21) over w / lag(close, 252) over w) as raw from bars window w as (partition by ticker order by date)),
ratios as (select date, ticker, raw / std as x from raws join v using (date, ticker) where raw is not null and std > 0),
mids as (select *, median(x) over (partition by date) as mid, count(*) over (partition by date) as names from ratios),
sigmas as (select *, 1.4826 * median(abs(x - mid)) over (partition by date) as sigma from mids),
clipped as (select *, case when sigma > 0 then least(greatest(x, mid - 3 * sigma), mid + 3 * sigma) else x end as c from sigmas),
exposure as (select date, ticker, (c - avg(c) over (partition by date)) / nullif(stddev_pop(c) over (partition by date), 0) as z from clipped where names >= 3)"""


@query(f"with {BARS}, {EXPOSURE} select date::varchar as date, ticker, {o6('z', 'exposure')} from exposure where z is not null")
def momentum_exposure(spark, sf_dir):
    panel = settled(regions(spark, sf_dir))
    raw = panel.select("date", "ticker", FE.momentum_12_1().alias("raw")).where("raw is not null")
    sigma = FE.return_vol(panel, out="sigma").select("date", "ticker", "sigma")
    return rounded(X.momentum_exposure(raw, sigma), "exposure")


WEIGHTS = f"""{RETURNS}, {sql_ewm('v', 'rets', 'r', span(60), 60)}, {sql_macd(True)},
scored as (select date, ticker, {SCORE} as score from macd where {SCORE} is not null),
weights as (select date, ticker, score / count(*) over (partition by date) * (0.15 / (std * sqrt(252))) as weight from scored join v using (date, ticker) where std > 0)"""


def _panel_weights(panel):
    return X.target_vol_weights(FE.macd_score(panel), FE.return_vol(panel))


def _weights(spark, sf_dir):
    return _panel_weights(settled(regions(spark, sf_dir)))


@query(f"with {BARS}, {WEIGHTS} select date::varchar as date, ticker, {o6('weight', 'weight')} from weights")
def target_vol_weights(spark, sf_dir):
    return rounded(_weights(spark, sf_dir), "weight")


@query(f"with {BARS}, {WEIGHTS} select date::varchar as date, ticker, cast(round_even(weight * 1e6 / close, 0) as bigint) as shares from weights join bars using (date, ticker)")
def target_shares(spark, sf_dir):
    rows = _weights(spark, sf_dir).join(regions(spark, sf_dir), ["date", "ticker"])
    return rows.select("date", "ticker", F.rint(F.col("weight") * 1e6 / F.col("close")).cast("long").alias("shares"))


@query(f"""with {BARS}, {WEIGHTS}, grid as (select * from (select distinct date from weights), (select distinct ticker from weights)),
full_w as (select date, ticker, coalesce(weight, 0) as weight from grid left join weights using (date, ticker)),
moves as (select *, abs(weight - coalesce(lag(weight) over (partition by ticker order by date), 0)) as moved from full_w)
select date::varchar as date, round(sum(abs(weight)), 6) + 0.0 as gross, round(sum(moved), 6) + 0.0 as turnover from moves group by date""")
def gross_and_turnover(spark, sf_dir):
    w = _weights(spark, sf_dir)
    grid = w.select("date").distinct().crossJoin(w.select("ticker").distinct()).join(w, ["date", "ticker"], "left").fillna(0.0, ["weight"]).withColumn("one", F.lit(0))
    return rounded(X.turnover(grid, ["one"]), "gross", "turnover").drop("one")


@query(f"""with {BARS}, {RETURNS} select ticker, round(avg(r) * 252, 6) + 0.0 as annual_mean, round(stddev_samp(r), 6) + 0.0 as std,
  round(avg(r) / stddev_samp(r) * sqrt(count(*)), 6) + 0.0 as t from rets where r is not null group by ticker""")
def return_summary(spark, sf_dir):
    return rounded(X.summary(P.with_returns(regions(spark, sf_dir)).where("log_return is not null"), ["ticker"], "log_return"), "annual_mean", "std", "t")


@query(f"with {BARS}, {RETURNS} select ticker, round(stddev_samp(r) * sqrt(count(r) / (date_diff('day', min(date), max(date)) / 365.25)), 6) + 0.0 as vol from rets where r is not null group by ticker")
def calendar_vol(spark, sf_dir):
    return rounded(X.calendar_vol(P.with_returns(regions(spark, sf_dir)).where("log_return is not null"), ["ticker"], "log_return"), "vol")


@query(f"with {BARS}, {RETURNS} select date::varchar as date, ticker, case when count(r) over w >= 20 then round(stddev_samp(r) over w * sqrt(252), 6) + 0.0 end as vol from rets window w as (partition by ticker order by date rows 59 preceding)")
def realized_vol_60(spark, sf_dir):
    rows = P.with_returns(regions(spark, sf_dir))
    return rows.select("date", "ticker", r6(X.rolling("log_return", 60, 20, ["ticker"]) * 252**0.5).alias("vol"))


RATIO = f"{RETURNS}, {sql_ewm('v', 'rets', 'r', span(60), 60)}, ahead as (select date, ticker, r / nullif(lag(std) over (partition by ticker order by date), 0) as u from v)"


def _ahead(spark, sf_dir):
    rows = FE.return_vol(regions(spark, sf_dir))
    before = F.lag("vol").over(P.by_ticker())
    return rows.where("log_return is not null").withColumn("u", F.when(before > 0, F.col("log_return") / before)).select("date", "ticker", "u")


@query(f"with {BARS}, {RATIO} select ticker, round(stddev_samp(u), 6) + 0.0 as bias, count(u) as n from ahead group by ticker")
def bias_statistic(spark, sf_dir):
    return _ahead(spark, sf_dir).groupBy("ticker").agg(r6(F.stddev_samp("u")).alias("bias"), F.count("u").alias("n"))


@query(f"with {BARS}, {RATIO} select date::varchar as date, ticker, case when count(u) over w >= 125 then round(stddev_samp(u) over w, 6) + 0.0 end as bias from ahead where u is not null window w as (partition by ticker order by date rows 249 preceding)")
def rolling_bias(spark, sf_dir):
    rows = _ahead(spark, sf_dir).where("u is not null")
    return rows.select("date", "ticker", r6(X.rolling("u", 250, 125, ["ticker"])).alias("bias"))


@query(f"with {BARS}, {RETURNS} select date::varchar as date, ticker, round(sum(r) over (partition by ticker order by date rows unbounded preceding), 6) + 0.0 as total from rets where r is not null")
def cumulative_returns(spark, sf_dir):
    rows = P.with_returns(regions(spark, sf_dir)).where("log_return is not null")
    return rows.select("date", "ticker", r6(X.running_sum("log_return", ["ticker"])).alias("total"))


@query(f"""with {BARS}, months as (select ticker, date_trunc('month', date)::date as month, arg_min(close, date) as first, arg_max(close, date) as last from bars group by all)
select ticker, month::varchar as month, round(last / coalesce(lag(last) over (partition by ticker order by month), first) - 1, 6) + 0.0 as ret from months""")
def monthly_returns(spark, sf_dir):
    panel = regions(spark, sf_dir).withColumnRenamed("close", "equity")
    return rounded(X.monthly_returns(panel, ["ticker"]), "ret")


CORR = f"{RETURNS}, corrs as (select a.ticker as i, b.ticker as j, corr(a.r, b.r) as corr, count(*) as n from rets a join rets b using (date) where a.ticker < b.ticker and a.r is not null and b.r is not null group by all)"


@query(f"with {NATIONS}, {CORR.replace('bars', 'nations')} select i, j, {o6('corr', 'corr')}, n from corrs order by abs(corr) desc, i, j limit 12")
def worst_pairs_12(spark, sf_dir):
    rows = P.with_returns(P.lineitem_bars(spark, sf_dir, "n_name"))
    corr = X.pair_correlation(rows, "log_return")
    return rounded(B.worst_pairs(corr), "corr")


@query(f"with {NATIONS}, {CORR.replace('bars', 'nations')} select round(quantile_cont(abs(corr), 0.95), 6) + 0.0 as p95, round(avg(abs(corr)), 6) + 0.0 as mean, round(avg(case when abs(corr) > 0.05 then 1.0 else 0.0 end), 6) + 0.0 as high from corrs")
def correlation_spread(spark, sf_dir):
    corr = X.pair_correlation(P.with_returns(P.lineitem_bars(spark, sf_dir, "n_name")), "log_return")
    size = F.abs("corr")
    corr = settled(corr.select(size.alias("size")))
    p95 = PC.exact_percentiles(corr, {"size": (0.95,)})["size"][0]
    return corr.agg(r6(F.lit(p95)).alias("p95"), r6(F.avg("size")).alias("mean"), r6(F.avg((F.col("size") > 0.05).cast("double"))).alias("high"))


# --- covariances, one factor ---------------------------------------------------------------


def _observed(spark, sf_dir):
    return _observed_in(settled(regions(spark, sf_dir)))


def _observed_in(panel):
    return P.with_returns(panel).join(P.bar_numbers(panel), "date").select("bar", "ticker", F.col("log_return").alias("value")).where("value is not null")


@query(f"with {BARS}, {COV} select bar, i, j, n, {o6('cov', 'cov')} from covs")
def ewm_cov_pairs(spark, sf_dir):
    return rounded(E.ewm_covariance(_observed(spark, sf_dir), span=60, periods=60), "cov")


@query(f"""with {BARS}, {COV}, own as (select bar, i as ticker, cov from covs where i = j)
select c.bar, c.i, c.j, round(c.cov / sqrt(a.cov * b.cov), 6) + 0.0 as corr from covs c join own a on a.bar = c.bar and a.ticker = c.i join own b on b.bar = c.bar and b.ticker = c.j
where c.i < c.j and c.cov is not null and a.cov > 0 and b.cov > 0""")
def ewm_corr_pairs(spark, sf_dir):
    cov = E.ewm_covariance(_observed(spark, sf_dir), span=60, periods=60)
    own = cov.where("i = j and cov > 0")
    rows = cov.where("i < j and cov is not null").join(own.select("bar", "i", F.col("cov").alias("a")), ["bar", "i"]).join(own.select("bar", "j", F.col("cov").alias("b")), ["bar", "j"])
    return rows.select("bar", "i", "j", r6(F.col("cov") / F.sqrt(F.col("a") * F.col("b"))).alias("corr"))


@query(f"""with {BARS}, {COV}, warm as (select bar, i as ticker from covs where i = j and cov > 0),
sides as (select bar, i as ticker, j as other from covs where cov is not null union all select bar, j, i from covs where cov is not null and i != j),
held as (select s.bar, s.ticker, count(*) as n from sides s join warm w on w.bar = s.bar and w.ticker = s.other group by all)
select w.bar, w.ticker from warm w join held h using (bar, ticker) join (select bar, count(*) as a from warm group by bar) using (bar) where n = a""")
def complete_universe(spark, sf_dir):
    return FA.complete_universe(E.ewm_covariance(_observed(spark, sf_dir), span=60, periods=60))


FACTORS = (("World", {t: 0.2 for t in REGIONS}), ("East", {"ASIA": 1.0, "EUROPE": -0.5, "AMERICA": -0.5}), ("South", {"AFRICA": 1.0, "MIDDLE EAST": -1.0}))


@query(f"""with {BARS}, legs(name, ticker, w) as (values {', '.join(f"('{n}', '{t}', {w}::double)" for n, ws in FACTORS for t, w in ws.items())}),
whole as (select name, sign(w) as side, sum(w) as leg from legs group by all), wanted as (select name, count(*) as k from whole group by name),
live as (select date, ticker, name, w, sign(w) as side from bars join legs using (ticker)),
held as (select date, name, side, sum(w) as live_leg from live group by all),
good as (select date, name from held join wanted using (name) group by date, name, k having count(*) = k)
select date::varchar as date, name, ticker, round(w * leg / live_leg, 6) + 0.0 as weight from live join held using (date, name, side) join whole using (name, side) join good using (date, name)""")
def factor_weights(spark, sf_dir):
    factors = spark.createDataFrame([(n, w) for n, w in FACTORS], "name string, weights map<string,double>")
    return rounded(FA.factor_weights(factors, regions(spark, sf_dir).select("date", "ticker")), "weight")


ONE = f"""{COV.replace("pairs as (", "market as (select bar, sum(r) / 5 as r from obs group by bar), everyone as (select * from obs union all select bar, ' market', r from market), pairs as (").replace("obs a join obs b", "everyone a join everyone b")},
one as (select o.bar, o.i as ticker, o.cov as var, x.cov / f.cov as raw_beta, f.cov as factor_var from covs o
  join covs f on f.bar = o.bar and f.i = ' market' and f.j = ' market' and f.cov > 0
  join covs x on x.bar = o.bar and x.i = ' market' and x.j = o.i where o.i = o.j and o.i != ' market' and o.cov is not null and x.cov is not null),
capped as (select *, case when raw_beta * raw_beta * factor_var > var then raw_beta * sqrt(var / (raw_beta * raw_beta * factor_var)) else raw_beta end as beta from one),
model as (select *, beta * beta * factor_var as common, greatest(0.1 * var, var - beta * beta * factor_var) as specific from capped)"""


def _one_of(panel):
    w = panel.sparkSession.createDataFrame([(t, 0.2) for t in REGIONS], "ticker string, weight double")
    return FA.one_factor(_observed_in(panel), w, span=60, periods=60)


def _one(spark, sf_dir):
    return _one_of(settled(regions(spark, sf_dir)))


@query(f"with {BARS}, {ONE} select bar, ticker, {o6('beta', 'beta')}, {o6('common', 'common')}, {o6('specific', 'specific')} from model")
def one_factor_model(spark, sf_dir):
    return rounded(_one(spark, sf_dir), "beta", "common", "specific").select("bar", "ticker", "beta", "common", "specific")


@query(f"""with {BARS}, {ONE}, sums as (select bar, sum(beta) * 0.2 as x, sum(specific) * 0.04 as own, max(factor_var) as fv from model group by bar)
select bar, {o6('x', 'exposure')}, {o6('x * x * fv + own', 'variance')}, {o6('x * x * fv / (x * x * fv + own)', 'factor_share')}, {o6('own / (x * x * fv + own)', 'specific_share')} from sums""")
def risk_shares(spark, sf_dir):
    w = spark.createDataFrame([(t, 0.2) for t in REGIONS], "ticker string, weight double")
    return rounded(FA.decompose(_one(spark, sf_dir), w), "exposure", "variance", "factor_share", "specific_share")


MARKET = f"{RETURNS}, market as (select date, sum(r) / 5 as f from rets where r is not null group by date)"


@query(f"with {BARS}, {MARKET} select ticker, round(regr_slope(r, f), 6) + 0.0 as beta, round(regr_intercept(r, f), 6) + 0.0 as alpha, round(regr_r2(r, f), 6) + 0.0 as r2 from rets join market using (date) where r is not null group by ticker")
def market_regression(spark, sf_dir):
    rows = P.with_returns(regions(spark, sf_dir)).where("log_return is not null")
    market = rows.groupBy("date").agg((F.sum("log_return") / 5).alias("f"))
    rows = rows.join(market, "date")
    return rows.groupBy("ticker").agg(r6(F.regr_slope("log_return", "f")).alias("beta"), r6(F.regr_intercept("log_return", "f")).alias("alpha"), r6(F.regr_r2("log_return", "f")).alias("r2"))


EDGE = f"""{RETURNS}, {WEIGHTS.replace(RETURNS + ", ", "").replace("v_n as", "v_n as")},
f as (select date, sum(r) / 5 as f from rets where r is not null group by date),
held as (select date, ticker, lag(weight) over (partition by ticker order by date) as w from weights),
book as (select date, sum(w) as x, sum(w * r) as ret from held join rets using (date, ticker) where w is not null and r is not null group by date),
edge as (select date, x, f, ret, avg(x) over () as m from book join f using (date))"""


def _edge(spark, sf_dir):
    panel = settled(regions(spark, sf_dir))
    rows = P.with_returns(panel).where("log_return is not null")
    market = rows.groupBy("date").agg((F.sum("log_return") / 5).alias("value")).withColumn("factor", F.lit("Market"))
    held = _panel_weights(panel).withColumn("w", F.lag("weight").over(P.by_ticker())).where("w is not null")
    book = settled(held.join(rows, ["date", "ticker"]).groupBy("date").agg(F.sum("w").alias("exposure"), F.sum(F.col("w") * F.col("log_return")).alias("ret")))
    market = settled(market)
    exposures = book.select("date", F.lit("Market").alias("factor"), "exposure")
    specific = book.join(market, "date").select("date", (F.col("ret") - F.col("exposure") * F.col("value")).alias("specific"))
    return exposures, market, book.select("date", "ret"), specific


@query(f"with {BARS}, {EDGE} select date::varchar as date, 'Market' as factor, {o6('x * f', 'value')} from edge union all select date::varchar, 'RESIDUAL', {o6('ret - x * f', 'value')} from edge")
def contributions(spark, sf_dir):
    exposures, market, book, _ = _edge(spark, sf_dir)
    return rounded(B.contributions(exposures, market, book), "value")


@query(f"with {BARS}, {EDGE} select date::varchar as date, {o6('m * f', 'structural')}, {o6('(x - m) * f', 'timing')}, 0.0::double as momentum, {o6('ret - x * f', 'selection')}, 0.0::double as other from edge")
def edge_buckets(spark, sf_dir):
    return rounded(B.edge_buckets(*_edge(spark, sf_dir)), *B.BUCKETS)


@query(f"""with {BARS}, {EDGE}, long_b as (select unnest(['structural', 'timing', 'selection']) as bucket, unnest([m * f, (x - m) * f, ret - x * f]) as v from edge)
select bucket, round(avg(v) * 252, 6) + 0.0 as annual_mean, round(stddev_samp(v), 6) + 0.0 as std, round(avg(v) / stddev_samp(v) * sqrt(count(*)), 6) + 0.0 as t from long_b group by bucket""")
def edge_summary(spark, sf_dir):
    found = B.edge_summary(B.edge_buckets(*_edge(spark, sf_dir))).where("bucket not in ('momentum', 'other')")
    return rounded(found, "annual_mean", "std", "t")


@query(f"""with {BARS}, {ONE}, sampled as (select bar, ticker, beta, abs(beta - lag(beta) over (partition by ticker order by bar)) as change from model where (bar - 1) % 5 = 0)
select 'Market' as factor, round(median(change), 6) + 0.0 as change, round(median(abs(beta)), 6) + 0.0 as size, round(median(change) / median(abs(beta)), 6) + 0.0 as ratio from sampled""")
def loading_drift(spark, sf_dir):
    loads = _one(spark, sf_dir).select("bar", "ticker", F.lit("Market").alias("factor"), F.col("beta").alias("value"))
    return rounded(B.loading_drift(loads), "change", "size", "ratio")


BIND = """limits as (select date, sum(abs(weight)) as gross, sqrt(pow(sum(beta * weight), 2) * max(factor_var) + sum(specific * weight * weight)) * sqrt(252) as vol
  from weights join numbered using (date) join model using (bar, ticker) group by date),
named as (select case when vol >= 0.05 * (1 - 1e-4) and gross >= 0.5 * (1 - 1e-4) then 'both' when vol >= 0.05 * (1 - 1e-4) then 'vol' when gross >= 0.5 * (1 - 1e-4) then 'leverage' else 'turnover' end as binding from limits)"""


def _sql_ones_and_weights() -> str:
    """The CTEs of the one-factor model and of the sized book, whose common ones are named once."""
    return f"{ONE}, {sql_ewm('v', 'rets', 'r', span(60), 60)}, {WEIGHTS.split(sql_ewm('v', 'rets', 'r', span(60), 60) + ', ')[1]}"


@query(f"with {BARS}, {_sql_ones_and_weights()}, {BIND} select binding, count(*) as n, round(count(*) / sum(count(*)) over (), 6) + 0.0 as share from named group by binding")
def binding_shares(spark, sf_dir):
    panel = settled(regions(spark, sf_dir))
    rows = _panel_weights(panel).join(P.bar_numbers(panel), "date").join(_one_of(panel), ["bar", "ticker"])
    load, own = F.sum(F.col("beta") * F.col("weight")), F.sum(F.col("specific") * F.col("weight") * F.col("weight"))
    rows = rows.groupBy("date").agg(F.sum(F.abs("weight")).alias("gross"), (F.sqrt(load * load * F.max("factor_var") + own) * 252**0.5).alias("vol"))
    named = rows.select(B.binding(F.col("vol"), F.col("gross"), F.lit(0.05), F.lit(0.5), F.lit("linear")).alias("binding"))
    return rounded(X.value_shares(named, "binding"), "share")


@query(f"with {BARS}, {ONE} select a.bar, a.ticker as i, b.ticker as j, round(a.beta * b.beta * a.factor_var + case when a.ticker = b.ticker then a.specific else 0 end, 6) + 0.0 as cov from model a join model b on a.bar = b.bar and a.ticker <= b.ticker")
def model_covariance(spark, sf_dir):
    return rounded(R.covariances(_one_snapshots(_one(spark, sf_dir))), "cov")


@query(f"with {BARS}, {EXPOSURE.replace(RETURNS + ', ', '', 1).join([ONE + ', ', ''])} select bar, 'Market' as factor, round(corr(z, beta), 6) + 0.0 as corr from exposure join numbered using (date) join model using (bar, ticker) where z is not null group by bar having count(*) = 5")
def exposure_collinearity(spark, sf_dir):
    panel = settled(regions(spark, sf_dir))
    raw = panel.select("date", "ticker", FE.momentum_12_1().alias("raw")).where("raw is not null")
    exposure = X.momentum_exposure(raw, FE.return_vol(panel, out="sigma").select("date", "ticker", "sigma")).join(P.bar_numbers(panel), "date")
    rows = exposure.join(_one_of(panel), ["bar", "ticker"]).groupBy("bar").agg(F.collect_list(F.struct("exposure", "beta")).alias("rows")).where(F.size("rows") == 5)
    snaps = rows.select("bar", F.col("rows.exposure").alias("m"), F.col("rows.beta").alias("beta"), F.array(F.lit("Market"), F.lit(B.MOMENTUM)).alias("factors"))
    return rounded(B.collinearity(snaps), "corr")


# --- clip rates, correlations, bounds ------------------------------------------------------

HALFLIVES, WIDTHS = (21, 31, 63), (2.0, FE.WINSOR_WIDTH)


def _sql_clip_grid() -> str:
    ctes, rows = [], []
    for h in HALFLIVES:
        for n in ALL_NAMES:
            name, source = f"g{h}_{n}", "mom" if n in MOM_NAMES else "macd"
            ctes.append(f"{name}_in as (select date, ticker, {n} from {source} where {n} is not null), {sql_ewm(name, f'{name}_in', n, half(h), h, 30 * h)}")
            rows += [f"select {h} as halflife, {w}::double as width, '{n}' as feature, count(*) as n, round(avg(case when std is not null and abs({n} - mean) > {w} * std then 1.0 else 0.0 end), 6) + 0.0 as rate from {name}" for w in WIDTHS]
    return f"with {BARS}, {sql_momentum()}, {sql_macd(True)}, {', '.join(ctes)} {' union all '.join(rows)}"


@query(_sql_clip_grid())
def winsor_clip_grid(spark, sf_dir):
    """The share of each feature's values that a clip at two and at five running deviations would change, by half-life."""
    rows = FE.feature_panel(settled(regions(spark, sf_dir)), winsorise=False).unpivot(["date", "ticker"], ALL_NAMES, "feature", "value")
    return rounded(FE.clip_rates(rows, HALFLIVES, WIDTHS), "rate")


@query(f"with {NATIONS}, {CORR.replace('bars', 'nations')} select round(avg(abs(corr)), 6) + 0.0 as mean, round(avg(case when abs(corr) > 0.5 then 1.0 else 0.0 end), 6) + 0.0 as high from corrs")
def correlations_above_half(spark, sf_dir):
    corr = X.pair_correlation(P.with_returns(P.lineitem_bars(spark, sf_dir, "n_name")), "log_return")
    return corr.agg(r6(F.avg(F.abs("corr"))).alias("mean"), r6(F.avg((F.abs("corr") > 0.5).cast("double"))).alias("high"))


BOUNDED = ("East", "Gold", "South")


@query(f"""with {BARS}, legs(name, ticker, side) as (values {', '.join(f"('{n}', '{t}', {1 if w > 0 else -1})" for n, ws in FACTORS for t, w in ws.items())}),
wanted as (select name, count(distinct side) as k from legs group by name),
live as (select date, name, count(distinct side) as k from bars join legs using (ticker) group by all),
good as (select date, name from live join wanted using (name, k))
select date::varchar as date, name from (select distinct date from bars), (select unnest({list(BOUNDED)}) as name) where (date, name) not in (select (date, name) from good)""")
def unknown_factor_bounds(spark, sf_dir):
    """The bounded names that are no factor of a date: a leg with such bounds is refused."""
    panel = settled(regions(spark, sf_dir))
    factors = spark.createDataFrame([(n, w) for n, w in FACTORS], "name string, weights map<string,double>")
    live = FA.factor_weights(factors, panel.select("date", "ticker")).select("date", "name").distinct()
    bounded = panel.select("date").distinct().withColumn("name", F.explode(F.array(*map(F.lit, BOUNDED))))
    return bounded.join(live, ["date", "name"], "left_anti")


@query("select distinct ticker, min(ord) as ord from (select unnest(['ASIA', 'AFRICA']) as ticker, unnest([1, 2]) as ord union all select r_name, 3 + r_regionkey from region) group by ticker")
def universe_union(spark, sf_dir):
    """Traded tickers, then those that only factors name: each once, at its first place."""
    named = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("ticker"), (3 + F.col("r_regionkey")).cast("int").alias("ord"))
    traded = spark.createDataFrame([("ASIA", 1), ("AFRICA", 2)], "ticker string, ord int")
    return traded.unionByName(named).groupBy("ticker").agg(F.min("ord").alias("ord"))


TRADED = f"""{sql_macd(True)}, grid as (select date, ticker, last_value(close ignore nulls) over (partition by ticker order by date) as price
  from (select distinct date from bars) cross join (select distinct ticker from bars) left join bars using (date, ticker)),
seen as (select date, ticker, price, score is not null as scored, count(score) over (partition by ticker order by date) as k
  from grid left join (select date, ticker, {SCORE} as score from macd) using (date, ticker) where price is not null),
moved as (select date, ticker, ln(price / lag(price) over (partition by ticker order by date)) as r from seen where scored or k > 60),
{sql_ewm('v', 'moved', 'r', span(60), 60)}"""


@query(f"with {BARS}, {TRADED} select date::varchar as date, ticker, {o6('std', 'vol')} from v")
def traded_vol(spark, sf_dir):
    """Deviation over the bars on which a region is scored or held."""
    panel = settled(regions(spark, sf_dir))
    return rounded(B.traded_vol(panel, FE.macd_score(panel)), "vol")


# --- a leg and its attribution -------------------------------------------------------------

HOLD = B.Leg("buy and hold", "buy_hold", cost_bps=1.0)

HELD = """days as (select *, lag(date) over (order by date) as before from (select distinct date from bars)),
sticky as (select date, ticker, last_value(close ignore nulls) over (partition by ticker order by date) as price from (select distinct date from bars) cross join (select distinct ticker from bars) left join bars using (date, ticker)),
start as (select *, count(*) over () as k from sticky where date = (select min(date) from bars) and price is not null),
bought as (select ticker, price, cast(round_even(100000.0 / k / price, 0) as bigint) as q from start),
purse as (select 100000.0 - sum(q * price) - sum(abs(q) * price) * 1e-4 as cash from bought),
worth as (select date, case when date = (select min(date) from bars) then 100000.0 else (select cash from purse) + sum(q * s.price) end as equity from sticky s left join bought b using (ticker) group by date),
curve as (select date, equity, ln(equity / lag(equity) over (order by date)) as ret from worth),
held as (select d.date, b.ticker, b.q * s.price / w.equity as w from days d join sticky s on s.date = d.before join bought b on b.ticker = s.ticker join worth w on w.date = d.before)"""

ATTR = f"""{ONE}, {HELD},
parts as (select n.date, m.ticker, m.beta, m.specific, m.factor_var, coalesce(h.w, 0) as w, coalesce(r.r, 0) as r
  from model m join numbered n on n.bar = m.bar + 1 left join held h on h.date = n.date and h.ticker = m.ticker left join rets r on r.date = n.date and r.ticker = m.ticker),
attr as (select date, ret, sum(beta * w) as x, sum(0.2 * r) as f, sum(0.2 * (exp(r) - 1)) as fs, sum(w * r) as wr, sum(specific * w * w) as own, max(factor_var) as fv from parts join curve using (date) where ret is not null group by date, ret),
tied as (select *, avg(x) over () as m, ret - x * f - (wr - x * f) as other, sqrt(x * x * fv + own) as risk from attr)"""


def _held(panel):
    return B.hold_leg(settled(B.sticky_prices(panel)), HOLD)


def _one_snapshots(model):
    """one_factor() in the form of the risk model's snapshots, with one factor of fixed equal weights."""
    rows = model.groupBy("bar").agg(F.sort_array(F.collect_list(F.struct("ticker", "beta", "specific"))).alias("r"), F.max("factor_var").alias("v"))
    return rows.select("bar", F.col("r.ticker").alias("tickers"), F.array(F.lit("Market")).alias("factors"), F.col("r.beta").alias("b"), F.array("v").alias("f"), F.col("r.specific").alias("d"), F.transform("r", lambda _: F.lit(0.2)).alias("w"), F.col("r.beta").alias("beta"), F.lit(None).cast("array<double>").alias("m"))


def _attributed(spark, sf_dir):
    panel = settled(regions(spark, sf_dir))
    return A.attribute(settled(_held(panel)), settled(_one_snapshots(_one_of(panel))), panel)


@query(f"with {BARS}, {HELD} select date::varchar as date, round(equity, 4) + 0.0 as equity, {o6('ret', 'log_return')} from curve")
def buy_and_hold(spark, sf_dir):
    curve = B.equity_curve(_held(settled(regions(spark, sf_dir))))
    return curve.select("date", (F.round("equity", 4) + F.lit(0.0)).alias("equity"), r6("log_return").alias("log_return"))


@query(f"with {BARS}, {HELD} select 'BUY' as side, ticker, q as quantity, round(price, 6) + 0.0 as price, (select min(date) from bars)::varchar as date from bought where q > 0")
def trade_log(spark, sf_dir):
    log = B.trade_log(_held(settled(regions(spark, sf_dir))))
    return rounded(log.select("side", "ticker", "quantity", "price", "date"), "price")


@query(f"with {BARS}, {ATTR} select date::varchar as date, 'Market' as factor, {o6('x * f', 'value')} from tied union all select date::varchar, 'RESIDUAL', {o6('ret - x * f', 'value')} from tied")
def leg_contributions(spark, sf_dir):
    return rounded(A.contributions(_attributed(spark, sf_dir)).select("date", "factor", "value"), "value")


@query(f"with {BARS}, {ATTR} select date::varchar as date, {o6('m * f', 'structural')}, {o6('(x - m) * f', 'timing')}, 0.0::double as momentum, {o6('wr - x * f', 'selection')}, {o6('other', 'other')} from tied")
def leg_edge_buckets(spark, sf_dir):
    return rounded(A.buckets(_attributed(spark, sf_dir)).drop("leg"), *B.BUCKETS)


@query(f"""with {BARS}, {ATTR}, long_b as (select unnest(['structural', 'timing', 'momentum', 'selection', 'other']) as bucket, unnest([m * f, (x - m) * f, 0.0, wr - x * f, other]) as v from tied)
select bucket, round(avg(v) * 252, 6) + 0.0 as annual_mean, round(stddev_samp(v), 6) + 0.0 as std, round(case when stddev_samp(v) > 0 then avg(v) / stddev_samp(v) * sqrt(count(*)) else 0 end, 6) + 0.0 as t from long_b group by bucket""")
def leg_edge_summary(spark, sf_dir):
    return rounded(A.bucket_summary(_attributed(spark, sf_dir)).drop("leg"), "annual_mean", "std", "t")


@query(f"""with {BARS}, {ATTR} select 'Market' as factor, round(avg(m * f) * 252, 6) + 0.0 as structural, round(avg((x - m) * f) * 252, 6) + 0.0 as timing,
  round(avg((x - m) * f) / stddev_samp((x - m) * f) * sqrt(count(*)), 6) + 0.0 as t_timing from tied""")
def leg_factor_summary(spark, sf_dir):
    return rounded(A.factor_summary(_attributed(spark, sf_dir)).drop("leg"), "structural", "timing", "t_timing")


@query(f"with {BARS}, {ATTR} select 'Market' as factor, round(avg(x), 6) + 0.0 as mean, round(min(x), 6) + 0.0 as least, round(max(x), 6) + 0.0 as most from tied")
def leg_exposure_ranges(spark, sf_dir):
    return rounded(A.exposure_ranges(_attributed(spark, sf_dir)).drop("leg"), "mean", "least", "most")


@query(f"with {BARS}, {ATTR} select 'Market' as factor, round(avg(x * x * fv / (x * x * fv + own)), 6) + 0.0 as share from tied union all select 'RESIDUAL', round(avg(own / (x * x * fv + own)), 6) + 0.0 from tied")
def leg_mean_shares(spark, sf_dir):
    return rounded(A.mean_shares(_attributed(spark, sf_dir)).drop("leg"), "share")


@query(f"""with {BARS}, {ATTR} select round(stddev_samp(ret / risk), 6) + 0.0 as bias, count(*) as bars, round(avg(risk) * sqrt(252), 6) + 0.0 as predicted_vol,
  round(stddev_samp(ret) * sqrt(count(*) / (date_diff('day', min(date), max(date)) / 365.25)), 6) + 0.0 as realized_vol from tied""")
def leg_health(spark, sf_dir):
    return rounded(A.health(_attributed(spark, sf_dir)).drop("leg"), "bias", "predicted_vol", "realized_vol")


@query(f"with {BARS}, {ATTR} select date::varchar as date, case when count(ret / risk) over w >= 125 then round(stddev_samp(ret / risk) over w, 6) + 0.0 end as bias from tied where risk > 0 window w as (order by date rows 249 preceding)")
def leg_rolling_bias(spark, sf_dir):
    return rounded(A.rolling_bias(_attributed(spark, sf_dir)).drop("leg"), "bias")


def sql_regression(source: str, y: str, xs: list[str]) -> str:
    """SQL of regression() over the rows of ``source``: each variable is made orthogonal to all others, one after the other."""
    names = ["alpha", *xs]
    ctes = [f"x_obs as (select row_number() over () as id, {y}::double as y, 1.0::double as x0, {', '.join(f'"{x}"::double as x{k}' for k, x in enumerate(xs, 1))} from {source})"]
    out = []
    for k in range(len(names)):
        order, last = [j for j in range(len(names)) if j != k] + [k], "x_obs"
        for step, j in enumerate(order):
            made = " ".join(f"- z{i} * sum(x{j} * z{i}) over () / sum(z{i} * z{i}) over ()" for i in order[:step])
            # the projections are on orthogonal columns, so they may be taken off together
            ctes.append(f"r{k}_{step} as (select *, x{j} {made} as z{j} from {last})")
            last = f"r{k}_{step}"
        rest = "y " + " ".join(f"- z{i} * sum(y * z{i}) over () / sum(z{i} * z{i}) over ()" for i in order)
        ctes.append(f"s{k} as (select *, {rest} as e from {last})")
        beta, n = f"(sum(y * z{k}) / sum(z{k} * z{k}))", len(names)
        out.append(f"select '{names[k]}' as term, {o6(beta, 'beta')}, {o6(f'{beta} / sqrt(sum(e * e) / (count(*) - {n}) / sum(z{k} * z{k}))', 't')}, {o6('1 - sum(e * e) / (sum(y * y) - sum(y) * sum(y) / count(*))', 'r2')}, {o6(f'{beta} * avg(x{k}) * 252', 'contribution')} from s{k}")
    return f"{', '.join(ctes)} {' union all '.join(out)}"


@query(f"with {BARS}, {ATTR}, simple as (select exp(ret) - 1 as ret, fs as \"Market\" from tied), {sql_regression('simple', 'ret', ['Market'])}")
def leg_regression(spark, sf_dir):
    return rounded(A.factor_regression(_attributed(spark, sf_dir)).drop("leg"), "beta", "t", "r2", "contribution")


# --- the risk model with one factor, which SQL can express ---------------------------------

ONE_LEVEL = R.Config(REGIONS, (("World", 1, {t: 0.2 for t in REGIONS}),), vol_span=60, corr_span=60, corr_periods=60, lookback=1_000_000, eigen=False, measured=False)

LEVEL = f"""{COV},
known as (select n.bar, p.i, p.j, last_value(cov ignore nulls) over (partition by p.i, p.j order by n.bar) as s from numbered n cross join (select distinct i, j from covs) p left join covs c on c.bar = n.bar and c.i = p.i and c.j = p.j),
full_s as (select bar, i, j, s from known where s is not null union all select bar, j, i, s from known where s is not null and i != j),
warm as (select bar, i as ticker from known where i = j and s > 0),
needed as (select bar, count(*) as k from warm group by bar),
partners as (select w.bar, w.ticker, count(*) as k from warm w join full_s f on f.bar = w.bar and f.i = w.ticker join warm o on o.bar = f.bar and o.ticker = f.j group by all),
whole as (select bar, ticker from partners join needed using (bar, k)),
sized as (select *, 1.0 / count(*) over (partition by bar) as w from whole),
fvar as (select s.bar, sum(s.s * a.w * b.w) as f from full_s s join sized a on a.bar = s.bar and a.ticker = s.i join sized b on b.bar = s.bar and b.ticker = s.j group by s.bar having count(*) >= 4),
loads as (select s.bar, s.i as ticker, max(f.f) as f, sum(s.s * b.w) / max(f.f) as raw, max(case when s.i = s.j then s.s end) as own, max(a.w) as w
  from full_s s join fvar f on f.bar = s.bar join sized a on a.bar = s.bar and a.ticker = s.i join sized b on b.bar = s.bar and b.ticker = s.j group by all),
level as (select *, raw * case when raw * raw * f > own then sqrt(own / (raw * raw * f)) else 1 end as b, greatest(0.1 * own, own - least(raw * raw * f, own)) as d from loads)"""


def _level(spark, sf_dir):
    panel = settled(regions(spark, sf_dir))
    return panel, settled(R.snapshots(panel, ONE_LEVEL))


@query(f"with {BARS}, {LEVEL} select bar, ticker, {o6('w', 'w')}, {o6('b', 'b')}, {o6('f * 1e4', 'f')}, {o6('d * 1e4', 'd')}, {o6('sqrt(own) * 1e2', 'sigma')} from level")
def model_one_level(spark, sf_dir):
    snaps = _level(spark, sf_dir)[1]
    rows = snaps.select("bar", F.element_at("f", 1).alias("f"), F.explode(F.arrays_zip("tickers", "w", "b", "d", "sigma")).alias("r"))
    return rows.select("bar", F.col("r.tickers").alias("ticker"), r6("r.w").alias("w"), r6("r.b").alias("b"), r6(F.col("f") * 1e4).alias("f"), r6(F.col("r.d") * 1e4).alias("d"), r6(F.col("r.sigma") * 1e2).alias("sigma"))


@query(f"with {BARS}, {LEVEL} select l.bar + 1 as bar, 'World' as factor, round(sum(l.w * coalesce(o.r, 0)), 6) + 0.0 as value from level l left join obs o on o.bar = l.bar + 1 and o.ticker = l.ticker where l.bar + 1 in (select bar from obs) group by l.bar")
def model_one_level_returns(spark, sf_dir):
    panel, snaps = _level(spark, sf_dir)
    return rounded(R.factor_returns(snaps, R.bar_inputs(panel, ONE_LEVEL)[0]), "value")


@query(f"""with {BARS}, {LEVEL}, sums as (select bar, sum(b) * 0.2 as x, max(f) as f, sum(d) * 0.04 as own from level group by bar)
select bar, 'World' as factor, {o6('x', 'exposure')}, {o6('x * x * f / (x * x * f + own)', 'share')}, {o6('(x * x * f + own) * 1e4', 'variance')} from sums
union all select bar, 'RESIDUAL', 0.0::double, {o6('own / (x * x * f + own)', 'share')}, {o6('(x * x * f + own) * 1e4', 'variance')} from sums""")
def model_one_level_shares(spark, sf_dir):
    snaps = _level(spark, sf_dir)[1]
    held = snaps.select("bar", F.explode("tickers").alias("ticker")).withColumn("weight", F.lit(0.2))
    return R.risk(snaps, held).select("bar", "factor", r6("exposure").alias("exposure"), r6("share").alias("share"), r6(F.col("variance") * 1e4).alias("variance"))


# --- the model with two levels, decompositions and draws, which SQL can repeat -------------

EAST = {"ASIA": 1.0, "EUROPE": -0.5, "AMERICA": -0.5}
TWO_LEVELS = R.Config(REGIONS, (("World", 1, {t: 0.2 for t in REGIONS}), ("East", 2, EAST)), vol_span=60, corr_span=120, corr_periods=120, lookback=1_000_000, simulations=20, seed=7, measured=False)


def sql_draws(k: int, seed: int, simulations: int, window: int, decay: float) -> str:
    """CTEs up to ``sims`` (sim, s0_0, s0_1 ...): the moments of the hashed draws."""
    number = lambda j, at: f"cast(('0x' || substr(md5('{seed}:' || sim || ':' || r || ':{j}'), {at}, 12)) as bigint) / pow(16, 12)"
    z = ", ".join(f"sqrt(-2 * ln({number(j, 1)} + pow(16, -12))) * cos(2 * pi() * {number(j, 13)}) as z{j}" for j in range(k))
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    return f"""draws as (select sim, r, pow({decay!r}, {window} - 1 - r) as w, {z} from (select unnest(range({simulations})) as sim), (select unnest(range({window})) as r)),
mass as (select sum(w) as w, sum(w * w) / pow(sum(w), 2) as w2 from draws where sim = 0),
sims as (select sim, {", ".join(f"(sum(d.w * z{i} * z{j}) / max(m.w) - sum(d.w * z{i}) * sum(d.w * z{j}) / pow(max(m.w), 2)) / (1 - max(m.w2)) as s{i}_{j}" for i, j in upper)} from draws d, mass m group by sim)"""


def sql_bias(source: str, low: str, high: str) -> str:
    """CTEs up to ``biases`` (bar, v1, v2): of the two variances ``low`` <= ``high`` of each row of ``source``, in closed form."""
    return f"""ests as (select bar, {low} as l1, {high} as l2, {low} * s0_0 as a, sqrt({low} * {high}) * s0_1 as b, {high} * s1_1 as d from {source}, sims),
halves as (select *, (a + d) / 2 as mid, sqrt(pow((a - d) / 2, 2) + b * b) as half from ests),
shares as (select *, (mid + half - a) / (2 * half) as e from halves),
biases as (select bar, sqrt(avg((e * l1 + (1 - e) * l2) / (mid - half))) as v1, sqrt(avg(((1 - e) * l1 + e * l2) / (mid + half))) as v2 from shares group by bar)"""


LONG_COVS = COV[COV.index("covs as (select") :].replace("covs as", "longs as").replace(">= 60", ">= 120").replace(repr(span(60)), repr(span(120)))

LEVELS = f"""{COV}, {LONG_COVS},
known as (select n.bar, p.i, p.j, last_value(c.cov ignore nulls) over w as v, last_value(l.cov ignore nulls) over w as s
  from numbered n cross join (select distinct i, j from covs) p left join covs c on c.bar = n.bar and c.i = p.i and c.j = p.j left join longs l on l.bar = n.bar and l.i = p.i and l.j = p.j
  window w as (partition by p.i, p.j order by n.bar)),
sure as (select bar, i, j, s, v from known where s is not null and v is not null union all select bar, j, i, s, v from known where s is not null and v is not null and i != j),
warm as (select bar, i as ticker from sure where i = j and s > 0 and v > 0),
needed as (select bar, count(*) as k from warm group by bar),
partners as (select w.bar, w.ticker, count(*) as k from warm w join sure f on f.bar = w.bar and f.i = w.ticker join warm o on o.bar = f.bar and o.ticker = f.j group by all),
whole as (select bar, ticker from partners join needed using (bar, k)),
fixed(ticker, world, east) as (values {", ".join(f"('{t}', 0.2, {EAST.get(t, 0.0)})" for t in REGIONS)}),
sides as (select bar, sum(world) as world, sum(case when east > 0 then east end) as plus, sum(case when east < 0 then -east end) as minus from whole join fixed using (ticker) group by bar having plus > 0 and minus > 0),
raw as (select bar, ticker, f.world / s.world as a, case when east > 0 then east / plus when east < 0 then east / minus else 0 end as b from whole join fixed f using (ticker) join sides s using (bar)),
forms as (select x.bar, sum(x.s * p.a * q.a) as aa, sum(x.s * p.a * q.b) as ab, sum(x.s * p.b * q.b) as bb
  from sure x join raw p on p.bar = x.bar and p.ticker = x.i join raw q on q.bar = x.bar and q.ticker = x.j group by x.bar),
w as (select bar, ticker, a as w1, b - ab / aa * a as w2 from raw join forms using (bar)),
f0 as (select x.bar, sum(x.s * p.w1 * q.w1) as f1, sum(x.s * p.w2 * q.w2) as f2, sum(x.v * p.w1 * q.w1) as v1, sum(x.v * p.w2 * q.w2) as v2
  from sure x join w p on p.bar = x.bar and p.ticker = x.i join w q on q.bar = x.bar and q.ticker = x.j group by x.bar),
fs as (select bar, greatest(f1, 1e-8 * greatest(f1, f2)) as f1, greatest(f2, 1e-8 * greatest(f1, f2)) as f2, sqrt(v1 / f1) as g1, sqrt(v2 / f2) as g2, row_number() over (order by bar) - 1 as place from f0),
spectra as (select bar, place, least(f1, f2) as low, greatest(f1, f2) as high from fs where place % {TWO_LEVELS.refresh} = 0),
{sql_draws(2, TWO_LEVELS.seed, TWO_LEVELS.simulations, 3 * TWO_LEVELS.corr_span, span(120))},
{sql_bias("spectra", "low", "high")},
turned as (select f.*, b.v1, b.v2 from fs f join spectra s on s.place = f.place - f.place % {TWO_LEVELS.refresh} join biases b on b.bar = s.bar),
scaled as (select bar, g1, g2, f1, f2, f1 * pow(1 + 1.4 * (case when f1 < f2 then v1 else v2 end - 1), 2) * g1 * g1 as m1, f2 * pow(1 + 1.4 * (case when f1 < f2 then v2 else v1 end - 1), 2) * g2 * g2 as m2 from turned),
loads as (select x.bar, x.i as ticker, sum(x.s * q.w1) / max(t.f1) as b1, sum(x.s * q.w2) / max(t.f2) as b2, max(case when x.i = x.j then x.s end) as own, max(case when x.i = x.j then x.v end) as vol
  from sure x join scaled t on t.bar = x.bar join w q on q.bar = x.bar and q.ticker = x.j group by all),
shared as (select l.*, t.f1, t.f2, g1, g2, m1, m2, w1, w2, least(1, own / (b1 * b1 * f1 + b2 * b2 * f2)) as share, b1 * b1 * f1 + b2 * b2 * f2 as common from loads l join scaled t using (bar) join w using (bar, ticker))"""


@query(f"""with {BARS}, {LEVELS} select bar, ticker, {o6('w1', 'w1')}, {o6('w2', 'w2')}, {o6('b1 * sqrt(share) * sqrt(vol / own) / g1', 'b1')}, {o6('b2 * sqrt(share) * sqrt(vol / own) / g2', 'b2')},
  {o6('m1', 'f1')}, {o6('m2', 'f2')}, {o6('greatest(0.1 * own, own - common * share) * vol / own', 'd')}, {o6('sqrt(vol)', 'sigma')} from shared""")
def model_two_levels(spark, sf_dir):
    """The whole model with a residual level, two spans and simulated adjustment; bars on which both factors are active."""
    snaps = R.snapshots(settled(regions(spark, sf_dir)), TWO_LEVELS).where(F.size("factors") == 2)
    pair = lambda c, k: F.get(F.col(c), 2 * F.col("at") + k)
    rows = snaps.select("bar", "w", "b", "f", "d", "sigma", F.posexplode("tickers").alias("at", "ticker"))
    of = lambda c: F.get(F.col(c), F.col("at"))
    return rows.select("bar", "ticker", r6(pair("w", 0)).alias("w1"), r6(pair("w", 1)).alias("w2"), r6(pair("b", 0)).alias("b1"), r6(pair("b", 1)).alias("b2"), r6(F.get("f", F.lit(0))).alias("f1"), r6(F.get("f", F.lit(3))).alias("f2"), r6(of("d")).alias("d"), r6(of("sigma")).alias("sigma"))


FIXED_BIAS, SCALE = (1.2, 0.9), 1.4
TWO_FORMS = f"""{COV},
fixed(ticker, world, east) as (values {", ".join(f"('{t}', 0.2, {EAST.get(t, 0.0)})" for t in REGIONS)}),
sides as (select bar, i, j, cov from covs where cov is not null union all select bar, j, i, cov from covs where cov is not null and i != j),
forms as (select x.bar, sum(cov * p.world * q.world) as a, sum(cov * p.world * q.east) as b, sum(cov * p.east * q.east) as d from sides x join fixed p on p.ticker = x.i join fixed q on q.ticker = x.j group by x.bar having count(*) = 25),
roots as (select *, (a + d) / 2 - sqrt(pow((a - d) / 2, 2) + b * b) as l1, (a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b) as l2 from forms)"""


def _two_forms(spark, sf_dir):
    """(bar, f): covariance of the two factors as given, before the second is made residual, on bars where all regions traded."""
    weights = [("World", t, 0.2) for t in REGIONS] + [("East", t, w) for t, w in EAST.items()]
    cov = E.ewm_covariance(_observed(spark, sf_dir), span=60, periods=60)
    return EI.quadratic_forms(cov, spark.createDataFrame(weights, "name string, ticker string, weight double"), ["World", "East"]).where("n = 25").select("bar", "f")


@query(f"""with {BARS}, {TWO_FORMS}, low as (select *, greatest(l1, 1e-8 * l2, 1e-18) * pow(1 + {SCALE} * ({FIXED_BIAS[0]} - 1), 2) as h1, l2 * pow(1 + {SCALE} * ({FIXED_BIAS[1]} - 1), 2) as h2 from roots)
select bar, {o6('l1 * 1e4', 'least')}, {o6('l2 * 1e4', 'most')}, {o6('(h2 * (a - l1) + h1 * (l2 - a)) / (l2 - l1) * 1e4', 'f11')}, {o6('(h2 - h1) * b / (l2 - l1) * 1e4', 'f12')}, {o6('(h2 * (d - l1) + h1 * (l2 - d)) / (l2 - l1) * 1e4', 'f22')} from low""")
def adjusted_factor_covariance(spark, sf_dir):
    """Clipped and adjusted by given biases, decomposed in the plan."""
    rows = _two_forms(spark, sf_dir).withColumn("e", EI.jacobi(F.col("f"), 2)).withColumn("c", EI.clipped(F.col("f"), 2))
    rows = rows.withColumn("m", EI.adjusted(F.col("c"), F.array(*map(F.lit, FIXED_BIAS)), SCALE, 2))
    cell = lambda k: r6(F.get("m", F.lit(k)) * 1e4)
    return rows.select("bar", r6(F.get("e", F.lit(0))["value"] * 1e4).alias("least"), r6(F.get("e", F.lit(1))["value"] * 1e4).alias("most"), cell(0).alias("f11"), cell(1).alias("f12"), cell(3).alias("f22"))


@query(f"""with {BARS}, {TWO_FORMS}, {sql_draws(2, 3, 50, 180, span(60))}, spectra as (select * from roots where bar % 21 = 0), {sql_bias("spectra", "l1", "l2")} select bar, {o6('v1', 'v1')}, {o6('v2', 'v2')} from biases""")
def simulated_eigen_bias(spark, sf_dir):
    """The bias of every 21st bar, simulated in the plan by hashed draws."""
    spectra = _two_forms(spark, sf_dir).where("bar % 21 = 0").select(F.col("bar").alias("key"), F.transform(EI.jacobi(F.col("f"), 2), lambda x: x["value"]).alias("spectrum"))
    moments = settled(EI.draw_moments(spark, 2, seed=3, simulations=50, window=180, decay=span(60)))
    found = EI.simulated_bias(spectra, moments, 2)
    return found.select(F.col("key").alias("bar"), r6(F.get("bias", F.lit(0))).alias("v1"), r6(F.get("bias", F.lit(1))).alias("v2"))


# --- models and legs beyond SQL ------------------------------------------------------------

CONFIG = R.Config(REGIONS, (("World", 1, {t: 0.2 for t in REGIONS}), ("East", 2, {"ASIA": 1.0, "EUROPE": -0.5, "AMERICA": -0.5})))


@query()
def risk_model(spark, sf_dir):
    return R.snapshots(settled(regions(spark, sf_dir)), CONFIG)


@query()
def model_risk_shares(spark, sf_dir):
    panel = settled(regions(spark, sf_dir))
    snaps = settled(R.snapshots(panel, CONFIG))
    held = snaps.select("bar", F.explode("tickers").alias("ticker")).withColumn("weight", F.lit(0.2))
    return R.risk(snaps, held)


@query()
def model_factor_returns(spark, sf_dir):
    panel = settled(regions(spark, sf_dir))
    return R.factor_returns(settled(R.snapshots(panel, CONFIG)), R.bar_inputs(panel, CONFIG)[0])


@query()
def model_residual_correlations(spark, sf_dir):
    panel = settled(regions(spark, sf_dir))
    snaps = settled(R.snapshots(panel, CONFIG))
    return B.residual_correlations(snaps, R.correlation_inputs(panel, CONFIG))


@query()
def model_residual_shares(spark, sf_dir):
    panel = settled(regions(spark, sf_dir))
    return B.residual_shares(settled(R.snapshots(panel, CONFIG)), R.correlation_inputs(panel, CONFIG))


LEGS = [B.Leg("trend"), B.Leg("trend rescaled", "rescaled"), HOLD]


@query()
def backtest_legs(spark, sf_dir):
    return B.equity_curve(B.macd_legs(settled(regions(spark, sf_dir)), LEGS))


@query()
def leg_correlations(spark, sf_dir):
    return B.leg_correlation(B.equity_curve(settled(B.macd_legs(settled(regions(spark, sf_dir)), LEGS))))


@query()
def backtest_metrics(spark, sf_dir):
    return B.metrics(backtest_legs(spark, sf_dir))


OPTIMISED = B.Leg("optimised", "optimized", max_gross=2.0, bounds={"World": (-0.5, 0.5)})


def _optimised(spark, sf_dir):
    panel = settled(regions(spark, sf_dir))
    return settled(B.fold_legs(B.leg_inputs(panel, settled(FE.macd_score(panel))), [OPTIMISED], optimised_snapshots(panel, CONFIG)))


@query()
def backtest_optimized(spark, sf_dir):
    return B.equity_curve(_optimised(spark, sf_dir))


@query()
def solve_log(spark, sf_dir):
    return B.solve_log(_optimised(spark, sf_dir), [OPTIMISED])


@query()
def solver_summary(spark, sf_dir):
    shares, numbers = B.solver_summary(B.solve_log(_optimised(spark, sf_dir), [OPTIMISED]))
    return shares.join(numbers, "leg")


TREND = ("AFRICA", "AMERICA", "EUROPE")


@query(f"with {BARS}, {RETURNS}, moves as (select date, ticker, close / lag(close) over (partition by ticker order by date) - 1 as r from bars), wide as (select * from (pivot moves on ticker in ({', '.join(repr(t) for t in REGIONS)}) using first(r) group by date) where " + " and ".join(f'"{t}" is not null' for t in REGIONS) + f"), {sql_regression('wide', '"ASIA"', list(TREND))}")
def trend_regression(spark, sf_dir):
    rows = P.wide_panel(P.with_returns(regions(spark, sf_dir)).select("date", "ticker", F.col("simple_return").alias("close")), list(REGIONS)).dropna()
    return rounded(B.regression(rows, "ASIA", list(TREND)), "beta", "t", "r2", "contribution")
