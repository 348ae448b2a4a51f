"""The ordered tests of a candidate on a decision date; those of the open book stand between the two lists (see book.walk)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ranking import first_failure

__all__ = ["Limits", "first_failure", "tests_after_book", "tests_before_book"]


@dataclass(frozen=True)
class Limits:
    """Fixed values of the rules; a quiet window is counted by whoever fills the column announced."""

    min_close: float = 5
    min_liquidity: float = 20_000_000
    min_sessions: int = 253
    max_financials_age: int = 200
    max_leverage: float = 6


def tests_before_book(limits: Limits) -> list[tuple[str, Column]]:
    """(test, whether it is passed) over sessions (null: no bar in the session), close, liquidity, sma200, period (of the last filing; null: none
    or not stated), announced (in the quiet window) and day."""
    age = F.datediff("day", "period")
    return [
        ("priced-at-T", F.col("sessions").isNotNull()), ("price", F.col("close") >= limits.min_close), ("history", F.col("sessions") >= limits.min_sessions),
        ("liquidity", F.col("liquidity") >= limits.min_liquidity), ("trend", F.col("close") >= F.col("sma200")), ("financials-on-file", F.col("period").isNotNull()),
        ("financials-recent", age.between(0, limits.max_financials_age)), ("just-announced", ~F.coalesce("announced", F.lit(False))),
    ]


def tests_after_book(limits: Limits, confirmed: Column | None = None) -> list[tuple[str, Column]]:
    """Over the company's figures (ok, grp, operating_cash_flow_ttm, leverage), and whether results are confirmed inside the holding window.

    A bank's cash flow statement says nothing of its debt, so finance is exempt.
    """
    finance = F.coalesce(F.col("grp") == "finance", F.lit(False))
    return [
        ("fundamentals", F.coalesce("ok", F.lit(False))), ("cash-flow", finance | (F.col("operating_cash_flow_ttm") > 0)),
        ("leverage", finance | F.col("leverage").isNull() | (F.col("leverage") <= limits.max_leverage)), ("earnings-in-window", F.lit(True) if confirmed is None else ~F.coalesce(confirmed, F.lit(False))),
    ]
