"""A run as data: sections, defaults, checks, and YAML in and out."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

#: Letter of a rule -> its name in operators.align.
RULES = {"D": "daily", "W": "weekly", "M": "monthly", "Q": "quarterly", "A": "annual"}


# The names and defaults of a configuration's fields, which files of others use.


@dataclass
class Data:
    source: str = "yfinance"
    tickers: list[str] = field(default_factory=lambda: ["XIC.TO", "ZEB.TO", "XEI.TO"])
    start: str = "2010-01-01"
    end: str | None = None
    benchmark: str | None = "XIC.TO"
    cash_proxy: str | None = None
    price_field: str = "Close"
    fill_limit: int = 5
    min_history: int = 60
    adjusted: bool = True
    use_dividends: bool = False


@dataclass
class Exog:
    enabled: bool = False
    publication_lag_days: int = 1
    ffill_limit: int | None = None
    columns: list[str] = field(default_factory=list)
    note: str = ""


@dataclass
class Signal:
    mode: str = "builtin"
    name: str = "dual_momentum"
    params: dict = field(default_factory=dict)
    weights_normalize: str = "None"
    weights_calendar: str = "File dates"
    weights_source: str = ""


@dataclass
class Engine:
    initial_capital: float = 100_000.0
    rebalance: str = "M"
    execution_lag: int = 1
    max_leverage: float = 1.0
    min_trade_weight: float = 0.005
    periods_per_year: int = 252
    execute_at_open: bool = False
    trim_warmup: bool = True


@dataclass
class Costs:
    commission_bps: float = 5.0
    slippage_bps: float = 25.0
    cash_rate_pa: float = 0.0
    borrow_rate_pa: float = 0.0


_SECTIONS = {"data": Data, "exog": Exog, "strategy": Signal, "engine": Engine, "costs": Costs}


@dataclass
class Run:
    label: str = "Backtest"
    data: Data = field(default_factory=Data)
    exog: Exog = field(default_factory=Exog)
    strategy: Signal = field(default_factory=Signal)
    engine: Engine = field(default_factory=Engine)
    costs: Costs = field(default_factory=Costs)

    @classmethod
    def from_dict(cls, values: dict | None) -> Run:
        """Sections that are left out have their defaults; a name that a section doesn't know raises TypeError."""
        values = values or {}
        return cls(values.get("label", "Backtest"), **{k: kind(**(values.get(k) or {})) for k, kind in _SECTIONS.items()})

    @classmethod
    def from_yaml(cls, text: str) -> Run:
        import yaml

        return cls.from_dict(yaml.safe_load(text))

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(dataclasses.asdict(self), sort_keys=False, allow_unicode=True)

    def problems(self) -> list[str]:
        """What stands against a run, by section; a line that begins with WARNING doesn't."""
        found = {
            "data": {"no ticker": self.data.source == "yfinance" and not self.data.tickers, "adjusted prices hold the dividends already": self.data.use_dividends and self.data.adjusted},
            "exog": {"publication_lag_days is negative": self.exog.enabled and self.exog.publication_lag_days < 0},
            "strategy": {f"no strategy mode {self.strategy.mode!r}": self.strategy.mode not in ("builtin", "external_weights")},
            "engine": {
                "initial_capital must be positive": self.engine.initial_capital <= 0,
                "max_leverage is under 0.1": self.engine.max_leverage < 0.1,
                "execution_lag is negative": self.engine.execution_lag < 0,
                "WARNING: execution_lag 0 trades on what is known only at the close": self.engine.execution_lag == 0,
                f"no rebalance rule {self.engine.rebalance!r}": self.engine.rebalance not in RULES,
            },
        }
        return [said for section in found.values() for said, wrong in section.items() if wrong]
