"""The named queries over the driver's tables and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import archive, book, company, cross_section, editions, fundamentals, pages, periods, pit, prices, publishing, sources, standings, tables, walks

_PARTS = (standings, prices, periods, pit, cross_section, editions, tables, sources, company, walks, book, archive, fundamentals, pages, publishing)
#: Calendar dates leave a query as text (YYYY-MM-DD), since engines differ in how they hand a date to a client.
_DATES = {
    **dict.fromkeys(["daily_bars", "trading_calendar", "sma_20", "median_dollar_volume_60", "realised_vol_60", "momentum_12_1"], ["date"]),
    **dict.fromkeys(["trailing_return_with_dividends", "volume_and_high", "equity_curve", "position_returns"], ["date"]),
    "nearest_within_tolerance": ["day", "near"], "band_previous": ["day", "previous"], "split_adjust_product": ["day"], "snapshot_gate": ["day"],
}


def _dated(name: str, query: Callable) -> Callable:
    def run(spark, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("string") for c in _DATES[name]})

    return run


QUERIES = {name: _dated(name, query) if name in _DATES else query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {
    name: f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _DATES[name])}) FROM ({sql})" if name in _DATES else sql
    for part in _PARTS
    for name, sql in part.ORACLE_SQL.items()
}
