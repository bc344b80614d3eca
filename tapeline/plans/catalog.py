"""All registered queries of the trading side, with their oracle SQL."""

from __future__ import annotations

from . import filter_queries, portfolio_queries, profile_queries, regime_queries, resampling_queries, selector_queries, sequence_queries, series_queries, trade_queries, tuning_queries, volatility_queries, zone_queries  # noqa: F401  (each adds its queries)

FLAGSHIP = "a1_strategy_performance"
QUERIES = dict(trade_queries.QUERIES)
ORACLE_SQL = {k: (v.replace("WITH bars", "WITH RECURSIVE bars", 1).replace("RECURSIVE_MARK ", "")) if "RECURSIVE_MARK" in v else v for k, v in trade_queries.ORACLE_SQL.items()}
