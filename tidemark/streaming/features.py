"""Features, scores and covariances as streams: one state a ticker, or one a panel, updated in the order of dates.

Rows of a micro-batch are sorted within a key; rows that are not later than the last one of their key are dropped, so that
emitted values never change. Batch and stream give the same values.
"""

from __future__ import annotations

import io
import json
import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ewm import alpha, default_periods
from ..operators.features import LOOKBACKS, MACD_PAIRS, PRICE_WINDOW, RESPONSE_SCALE, TREND_WINDOW, VOL_SPAN, WINSOR_HALFLIFE, WINSOR_WIDTH

MOMENTS = tuple(f"mom_{k}" for k in LOOKBACKS)
TRENDS = tuple(f"macd_{s}_{l}" for s, l in MACD_PAIRS)
COLUMNS = ("ticker", "date", "close", "vol", "score", *MOMENTS, *TRENDS)
OUT = "ticker string, date timestamp, " + ", ".join(f"{c} double" for c in COLUMNS[2:])
STATE = "state string"


def squash(y: float) -> float:
    return y * math.exp(-y * y / 4) / RESPONSE_SCALE


class Moments:
    """Running decayed sums of the values given so far, as a list that can be stored."""

    def __init__(self, decay: float, least: int, stored: list | None = None):
        self.decay, self.least = decay, max(least, 2)
        self.sums = stored or [0, 0.0, 0.0]

    def update(self, v: float) -> tuple[float, float] | None:
        """Mean and deviation, this value included; None while there are too few."""
        d, (n, x, xx) = self.decay, self.sums
        n, x, xx = self.sums[:] = [n + 1, x * d + v, xx * d + v * v]
        if n < self.least:
            return None
        w, w2 = (1 - d**n) / (1 - d), (1 - d ** (2 * n)) / (1 - d * d)
        return x / w, math.sqrt(max(0.0, (w * xx - x * x) / (w * w - w2)))


class TickerState:
    """Everything that the next values need: running sums, and the last values of some windows."""

    def __init__(self, stored: str | None = None):
        d = json.loads(stored) if stored else {}
        self.date, self.n = d.get("date"), d.get("n", 0)
        self.sums = d.get("sums", {})
        self.returns = Moments(1 - alpha(VOL_SPAN), VOL_SPAN, d.get("returns"))
        self.closes = deque(d.get("closes", []), max(*LOOKBACKS, PRICE_WINDOW - 1) + 1)
        self.trends = {t: deque(d.get("trends", {}).get(t, []), TREND_WINDOW) for t in TRENDS}
        clips = d.get("clips", {})
        self.clips = {c: Moments(1 - alpha(halflife=WINSOR_HALFLIFE), default_periods(halflife=WINSOR_HALFLIFE), clips.get(c)) for c in (*MOMENTS, *TRENDS)}

    def stored(self) -> str:
        return json.dumps({"date": self.date, "n": self.n, "sums": self.sums, "returns": self.returns.sums, "closes": list(self.closes), "trends": {k: list(v) for k, v in self.trends.items()}, "clips": {k: v.sums for k, v in self.clips.items()}})

    def update(self, close: float) -> dict[str, float | None]:
        """Deviation of log returns, score and the winsorised features; None while warming up."""
        found = self.returns.update(math.log(close / self.closes[-1])) if self.closes else None
        vol = found[1] if found else None
        self.closes.append(close)
        self.n += 1
        raw: dict[str, float | None] = {}
        for name, k in zip(MOMENTS, LOOKBACKS, strict=True):
            raw[name] = math.log(close / self.closes[-1 - k]) / (vol * math.sqrt(k)) if vol and len(self.closes) > k else None
        trends = self._trends(close)
        score = sum(trends.values()) / len(TRENDS) if len(trends) == len(TRENDS) else None
        raw |= {t: trends.get(t) for t in TRENDS}
        return {"vol": vol, "score": score, **{c: None if v is None else self._clipped(c, v) for c, v in raw.items()}}

    def _clipped(self, name: str, value: float) -> float:
        found = self.clips[name].update(value)
        if found is None:
            return value
        mean, dev = found
        return min(max(value, mean - WINSOR_WIDTH * dev), mean + WINSOR_WIDTH * dev)

    def _trends(self, close: float) -> dict[str, float]:
        means = {}
        for span in {s for pair in MACD_PAIRS for s in pair}:
            d = 1 - alpha(span)
            self.sums[str(span)] = self.sums.get(str(span), 0.0) * d + close
            means[span] = self.sums[str(span)] * (1 - d) / (1 - d**self.n) if self.n >= span else None
        last = list(self.closes)[-PRICE_WINDOW:]
        spread = float(np.std(last, ddof=1)) if len(last) == PRICE_WINDOW else 0.0
        found = {}
        for name, (s, l) in zip(TRENDS, MACD_PAIRS, strict=True):
            if spread > 0 and means[l] is not None and means[s] is not None:
                own = self.trends[name]
                q = (means[s] - means[l]) / spread
                own.append(q)
                std = float(np.std(own, ddof=1)) if len(own) == TREND_WINDOW else 0.0
                if std > 0:
                    found[name] = squash(q / std)
        return found


def _advance(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    own = TickerState(state.get[0] if state.exists else None)
    rows = pd.concat(list(parts)).sort_values("date")
    out = []
    for date, close in zip(rows["date"], rows["close"], strict=True):
        if own.date is not None and date.value <= own.date or not (close > 0 and math.isfinite(close)):
            continue
        own.date = date.value
        out.append({"ticker": key[0], "date": date, "close": close, **own.update(float(close))})
    state.update((own.stored(),))
    yield pd.DataFrame(out, columns=list(COLUMNS)).astype(dict.fromkeys(COLUMNS[2:], float))


def feature_stream(panel: DataFrame) -> DataFrame:
    """(ticker, date, close, vol, score, mom_1 ..., macd_8_24 ...) of a stream of (date timestamp, ticker, close)."""
    return panel.groupBy("ticker").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


class PanelState:
    """Decayed sums of every pair of tickers, the last closes, and the rows of the bar that is still open."""

    def __init__(self, span: float, periods: int, stored: bytes | None = None):
        self.decay, self.periods = 1 - alpha(span), periods
        self.names, self.last, self.open, self.date = [], {}, {}, None
        self.sums = np.zeros((5, 0, 0))  # n, weights, squared weights, values, products
        if stored:
            with np.load(io.BytesIO(stored)) as held:
                self.sums = held["sums"]
                plain = json.loads(str(held["plain"]))
            self.names, self.last, self.open, self.date = plain["names"], plain["last"], plain["open"], plain["date"]

    def stored(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sums=self.sums, plain=np.array(json.dumps({"names": self.names, "last": self.last, "open": self.open, "date": self.date})))
        return out.getvalue()

    def add(self, date: int, ticker: str, close: float) -> list[tuple]:
        """The next row by date; a row of a later bar closes the open one, whose pairs (date, i, j, n, cov) are given."""
        out = []
        if self.date is not None and date < self.date:
            return out
        if self.date is not None and date > self.date:
            out = self.close()
        self.date = date
        self.open[ticker] = close
        return out

    def close(self) -> list[tuple]:
        returns = {t: math.log(c / self.last[t]) for t, c in self.open.items() if t in self.last}
        self.last.update(self.open)
        self.open = {}
        if fresh := sorted(self.last.keys() - set(self.names)):
            self.names += fresh
            grown = np.zeros((5, len(self.names), len(self.names)))
            old = self.sums.shape[1]
            grown[:, :old, :old] = self.sums
            self.sums = grown
        d = self.decay
        self.sums *= np.array([1.0, d, d * d, d, d])[:, None, None]
        at = np.array([k for k, t in enumerate(self.names) if t in returns], dtype=int)
        if not len(at):
            return []
        r = np.array([returns[self.names[k]] for k in at])
        cross = np.ix_(at, at)
        for k, more in enumerate((1.0, 1.0, 1.0, np.repeat(r[:, None], len(r), 1), np.outer(r, r))):
            self.sums[k][cross] += more
        n, w, w2, x, xy = (s[cross] for s in self.sums)
        below = w * w - w2
        cov = np.where((n >= self.periods) & (below > 0), (w * xy - x * x.T) / np.where(below > 0, below, 1), np.nan)
        names = [self.names[k] for k in at]
        return [(self.date, *sorted((names[a], names[b])), int(n[a, b]), float(cov[a, b])) for a in range(len(at)) for b in range(a, len(at))]


def covariance_stream(panel: DataFrame, *, span: float, periods: int) -> DataFrame:
    """(date, i, j, n, cov) for i <= j of a stream of (date timestamp, ticker, close): ewm_covariance() of its log returns.

    A bar is given when the first row of a later one is seen. The panel is one key, whose state grows with the square of
    its tickers; rows of bars that are closed are dropped. Every bar of the stream counts, also one without returns.
    """

    def advance(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = PanelState(span, periods, state.get[0] if state.exists else None)
        rows = pd.concat(list(parts)).sort_values(["date", "ticker"])
        out = []
        for date, ticker, close in zip(rows["date"], rows["ticker"], rows["close"], strict=True):
            if close > 0 and math.isfinite(close):
                out += own.add(date.value, ticker, float(close))
        state.update((own.stored(),))
        found = pd.DataFrame(out, columns=["date", "i", "j", "n", "cov"])
        found["date"] = pd.to_datetime(found["date"])
        yield found.astype({"n": "int64", "cov": float})

    keyed = panel.withColumn("panel", F.lit(0))
    return keyed.groupBy("panel").applyInPandasWithState(advance, "date timestamp, i string, j string, n long, cov double", "state binary", "append", GroupStateTimeout.NoTimeout)


def closed_bars(panel: DataFrame, late: str = "1 day") -> DataFrame:
    """Cross-sections of a stream, each given once no more of its rows are awaited: (bar, tickers, mean close)."""
    return panel.withWatermark("date", late).groupBy(F.window("date", "1 day")).agg(F.count("*").alias("tickers"), F.avg("close").alias("mean_close")).select(F.col("window.start").alias("bar"), "tickers", "mean_close")
