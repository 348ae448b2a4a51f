"""Column expressions for companies, filings and announcements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds (exclusive) of industry codes and the names of their divisions.
DIVISIONS = [
    (1000, "Agriculture, Forestry and Fishing"),
    (1500, "Mining"),
    (1800, "Construction"),
    (2000, "Unclassified"),
    (4000, "Manufacturing"),
    (5000, "Transportation, Communications and Utilities"),
    (5200, "Wholesale Trade"),
    (6000, "Retail Trade"),
    (6800, "Finance, Insurance and Real Estate"),
    (7000, "Unclassified"),
    (9000, "Services"),
]


def _code(sic: str | Column) -> Column:
    return F.try_to_number(F.trim(F.col(sic).cast("string") if isinstance(sic, str) else sic.cast("string")), F.lit("99999")).cast("int")


def sector_group(sic: str | Column) -> Column:
    n = _code(sic)
    energy = n.between(1200, 1399) | n.between(2900, 2999)
    return F.when(n.between(6000, 6999), "finance").when(n.between(4900, 4999), "utilities").when(energy, "energy").otherwise("operating")


def division(sic: str | Column) -> Column:
    n = _code(sic)
    out = F.when(n.isNull() | (n <= 0), "Unclassified")
    for below, name in DIVISIONS:
        out = out.when(n < below, name)
    return out.otherwise("Public Administration")


def major_group(sic: str | Column) -> Column:
    text = F.trim(F.col(sic).cast("string") if isinstance(sic, str) else sic.cast("string"))
    return F.when(text.rlike(r"^\d{3,4}$"), F.substring(F.lpad(text, 4, "0"), 1, 2))


def ratio(n: str, d: str) -> Column:
    """Null unless the denominator is positive."""
    return F.when(F.col(d) > 0, F.col(n) / F.col(d))


def clip(x: Column, least: float, most: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(most), F.greatest(F.lit(least), x)))


def short_id(*parts: str | Column, length: int = 12) -> Column:
    """The first characters of the sha1 of the parts."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, length)


def is_earnings_release(form: str, items: str) -> Column:
    return F.col(form).startswith("8-K") & F.array_contains(items, "2.02")


def is_material_event(form: str, items: str, material: list[str]) -> Column:
    return F.col(form).startswith("8-K") & F.arrays_overlap(F.col(items), F.array(*map(F.lit, material)))


def earnings_risk(expected: str, spread: str, entry: str, exit_: str) -> Column:
    """'in' where the expected day is in the holding window, 'near' where it is within its spread of it, else null."""
    near = F.col(expected).between(F.date_sub(F.col(entry), F.col(spread)), F.date_add(F.col(exit_), F.col(spread)))
    return F.when(F.col(expected).between(F.col(entry), F.col(exit_)), "in").when(near, "near")


# What a common share is called, and the instruments that are none.
COMMON = r"(?i)common stock|ordinary shares|common shares"
NOT_EQUITY = r"(?i)\b(warrants?|units?|rights?|preferred|depositary|debenture|notes?|subordinated)\b"
EXCHANGES = ["N", "Q", "A"]


def descriptor(name: str | Column) -> Column:
    """What a security's name says of the instrument: from a dash between spaces or the words for common shares on, whichever comes first;
    the whole name without either. A company may be called Rights or Unit; the instrument is described behind its name."""
    name = F.col(name) if isinstance(name, str) else name
    dash, common = (F.nullif(F.regexp_instr(name, F.lit(p)), F.lit(0)) for p in (r"\s[-–]\s", COMMON))
    first = F.least(dash, common)
    return F.when(first.isNull(), name).otherwise(F.substr(name, first))


def issuer_name(name: str | Column) -> Column:
    """The name without the description of the instrument."""
    name = F.col(name) if isinstance(name, str) else name
    cut = F.regexp_replace(name, r"\s[-–]\s.*$", "")
    plain = F.regexp_replace(name, r"(?i)\s+(Class [A-Z]\s+)?(Common Stock|Ordinary Shares|Common Shares)\b.*$", "")
    out = F.trim(F.when(cut == name, plain).otherwise(cut))
    return F.when(out == "", F.trim(name)).otherwise(out)


def ineligible_reason(exchanges: list[str] = EXCHANGES) -> Column:
    """The first reason for which a row of the traded universe is no common share of the exchanges, or null."""
    symbol, name, status, exchange = (F.coalesce(c, F.lit("")) for c in ("symbol", "name", "financial_status", "exchange"))
    return (
        F.when(F.trim(symbol) == "", "no symbol").when(symbol.rlike(r"[$.]"), "symbol carries a class or status suffix").when(F.col("test_issue") == "Y", "test issue")
        .when(F.col("etf") == "Y", "exchange-traded fund").when(F.col("next_shares") == "Y", "NextShares fund")
        .when(~exchange.isin(exchanges), F.concat(F.lit("exchange "), F.when(exchange == "", "(none)").otherwise(exchange), F.lit(" not accepted")))
        .when(~status.isin("", "N"), F.concat(F.lit("financial status "), status)).when(~name.rlike(COMMON), "not described as common or ordinary shares")
        .when(descriptor(name).rlike(NOT_EQUITY), "derivative or non-equity instrument")
    )
