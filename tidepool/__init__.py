"""Pair analytics on Spark: clean price panels, hedge ratios, unit-root tests, spreads, signals, backtests."""

from .operators.backtest import BacktestResult, backtest_spread, backtest_table, performance_metrics, train_test_split_by_date, walk_forward_backtest, walk_forward_many
from .operators.clean import align_and_clean, log_prices
from .operators.hedge import HedgeRatio, estimate_hedge_ratio, hedge_table, rolling_hedge_ratio
from .operators.ou import OUParams, fit_ou, half_life, ou_table, simulate_ou
from .operators.signals import generate_signals
from .operators.spread import compute_spread, zscore
from .operators.unitroot import CointegrationResult, adf_many, adf_test, engle_granger, engle_granger_many
from .session import session
from .sources.prices import DEFAULT_TICKERS, PROXY_TICKERS, fetch_databento, fetch_yfinance, generate_synthetic_pair, load_prices

__all__ = [
    "DEFAULT_TICKERS", "PROXY_TICKERS", "BacktestResult", "CointegrationResult", "HedgeRatio", "OUParams", "adf_many", "adf_test", "align_and_clean",
    "backtest_spread", "backtest_table", "compute_spread", "engle_granger", "engle_granger_many", "estimate_hedge_ratio", "fetch_databento", "fetch_yfinance", "fit_ou",
    "generate_signals", "generate_synthetic_pair", "half_life", "hedge_table", "load_prices", "log_prices", "ou_table", "performance_metrics",
    "rolling_hedge_ratio", "session", "simulate_ou", "train_test_split_by_date", "walk_forward_backtest", "walk_forward_many", "zscore",
]
