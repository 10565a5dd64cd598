"""Configs of backtests: JSON objects read into dataclasses, checked field by field and against each other.

Every fault is a ValueError that names the file, the section and what is wrong.
"""

from __future__ import annotations

import json
from dataclasses import MISSING, dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame

from . import backtest as B
from . import riskmodel as R

# The names that configs use.
PORTFOLIOS = {"target_vol": "target_vol", "rescaled_target_vol": "rescaled", "optimized": "optimized"}
SPECIFIC_RISKS = ("implied", "residual")


def _one_of(section: str, name: str, value, allowed) -> None:
    if value not in allowed:
        raise ValueError(f"{section}.{name} must be one of {', '.join(allowed)}, got {value!r}")


def _at_least(section: str, name: str, value, least) -> None:
    if value < least:
        raise ValueError(f"{section}.{name} must be at least {least}, got {value}")


@dataclass(frozen=True)
class Momentum:
    lookback: int = 252
    skip: int = 21


@dataclass(frozen=True)
class Eigen:
    enabled: bool = True
    scale: float = 1.4
    simulations: int = 200
    window: int | None = None
    refresh_every: int = 21
    seed: int = 0

    def __post_init__(self):
        for name, least in (("scale", 0), ("simulations", 1), ("refresh_every", 1)):
            _at_least("eigen_adjustment", name, getattr(self, name), least)
        if self.window is not None:
            _at_least("eigen_adjustment", "window", self.window, 2)


@dataclass(frozen=True)
class FactorModel:
    factors_file: str
    granular: bool = False
    vol_span: int = 60
    corr_span: int = 250
    corr_min_periods: int = 250
    residual_floor: float = 0.10
    idiosyncratic_risk: str = "residual"
    momentum: Momentum = field(default_factory=Momentum)
    eigen_adjustment: Eigen = field(default_factory=Eigen)

    def __post_init__(self):
        _one_of("factor_model", "idiosyncratic_risk", self.idiosyncratic_risk, SPECIFIC_RISKS)

    def model(self, tickers: list[str], factors: DataFrame) -> R.Config:
        """The risk model over ``tickers`` with the factors of read_factors(); the driver holds a config's factors."""
        eigen = self.eigen_adjustment
        rows = [(r["name"], r.level, dict(r.weights)) for r in factors.orderBy("ord").collect()]
        return R.Config(tuple(tickers), tuple(rows), vol_span=self.vol_span, corr_span=self.corr_span, corr_periods=self.corr_min_periods, floor=self.residual_floor, measured=self.idiosyncratic_risk == "residual", lookback=self.momentum.lookback, skip=self.momentum.skip, eigen=eigen.enabled, eigen_scale=eigen.scale, simulations=eigen.simulations, window=eigen.window, refresh=eigen.refresh_every, seed=eigen.seed)


@dataclass(frozen=True)
class Optimizer:
    information_coefficient: float = 0.05
    turnover_penalty_bps: float = 5.0
    factor_bounds: dict = field(default_factory=dict)
    objective: str = "linear"
    risk_aversion: float | None = None

    def __post_init__(self):
        _one_of("optimizer", "objective", self.objective, B.OBJECTIVES)
        if self.objective == "mean_variance" and not (self.risk_aversion or 0) > 0:
            raise ValueError(f"optimizer.risk_aversion must be positive for mean_variance, got {self.risk_aversion}")
        pairs = {}
        for name, pair in self.factor_bounds.items():
            if not isinstance(pair, (list, tuple)) or len(pair) != 2:
                raise ValueError(f"optimizer.factor_bounds of {name} must be two numbers, got {pair!r}")
            pairs[name] = float(pair[0]), float(pair[1])
        object.__setattr__(self, "factor_bounds", pairs)


@dataclass(frozen=True)
class Backtest:
    name: str
    data: str
    tickers: list
    target_vol: float = 0.15
    portfolio: str = "target_vol"
    optimizer: Optimizer | None = None
    initial_cash: float = 100_000.0
    max_gross: float = 1.0
    cost_bps: float = 0.0
    commission_bps: float = 0.0
    risk_free_rate: float = 0.0
    output_dir: str = "output"
    factor_model: FactorModel | None = None

    def __post_init__(self):
        _one_of("backtest", "portfolio", self.portfolio, PORTFOLIOS)
        if self.portfolio == "optimized":
            if self.factor_model is None:
                raise ValueError("portfolio optimized needs a factor_model")
            if not self.factor_model.granular:
                raise ValueError("portfolio optimized needs factor_model.granular true")

    def legs(self) -> list[B.Leg]:
        """The strategy under this config, and equal weights held at the same costs with a gross of 1."""
        own, costs = self.optimizer or Optimizer(), self.cost_bps + self.commission_bps
        strategy = B.Leg(self.name, PORTFOLIOS[self.portfolio], self.target_vol, self.initial_cash, costs, self.max_gross, own.information_coefficient, own.turnover_penalty_bps, own.objective, own.risk_aversion, own.factor_bounds)
        return [strategy, B.Leg("Buy & Hold", "buy_hold", self.target_vol, self.initial_cash, costs, 1.0)]


_SECTIONS = {"factor_model": FactorModel, "optimizer": Optimizer, "momentum": Momentum, "eigen_adjustment": Eigen}


def _filled(kind: type, given, section: str):
    if not isinstance(given, dict):
        raise ValueError(f"{section} is not an object")
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(given.keys() - known.keys()):
        raise ValueError(f"{section} has unknown keys {', '.join(unknown)}")
    missing = sorted(n for n, f in known.items() if n not in given and f.default is MISSING and f.default_factory is MISSING)
    if missing:
        raise ValueError(f"{section} needs {', '.join(missing)}")
    return kind(**{n: _filled(_SECTIONS[n], v, n) if n in _SECTIONS and v is not None else v for n, v in given.items()})


def read_backtest(path: str | Path) -> Backtest:
    """The config in a JSON file on the driver."""
    try:
        return _filled(Backtest, json.loads(Path(path).read_text()), "backtest")
    except (OSError, ValueError) as wrong:
        raise ValueError(f"{path}: {wrong}") from wrong
