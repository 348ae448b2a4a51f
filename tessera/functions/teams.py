"""What schedule pages print: team names, dates, clock times, results. All inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def _marked() -> tuple[str, str]:
    """Latin letters that are one plain letter with marks, and those letters, by Unicode's own decomposition."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        bare = "".join(p for p in parts if not unicodedata.combining(p))
        if len(parts) > 1 and len(bare) == 1 and bare.isascii():
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _marked()

# What pages print before a team's name (rankings, votes, divisions), each with the space behind it.
_BEFORE = [r"no\.\s*\d+", r"#\s*\d+", r"\(rv\)", r"rv(?=\s+[a-z])", r"\(t\)", r"\(d-?i{1,3}\)", r"\(rv/\d+\)", r"\(\d+\)"]
# Marks of games that do not count, behind a team's name.
_BEHIND = r"\((?:exhib?|exh|scrimmage)\.?\)"
# The abbreviations of states that qualify a team's name in brackets.
_STATES = (
    "ala alaska ariz ark calif colo conn del fla ga hawaii idaho ill ind iowa kan ky la maine md mass mich minn miss mo mont neb nev n.h n.j n.m n.y n.c n.d "
    "ohio okla ore pa r.i s.c s.d tenn texas utah vt va wash w.va wis wyo"
)
# Rows whose opponent is page furniture.
NON_TEAM = [
    r"\btournament\b", r"\bchampionships?\b", r"\binvitational\b", r"\bconference\b", r"\bregional(s)?\b", r"\bplay-?in\b", "^tba$", "^tbd$", "^opponent$", "^bye$", "^open$",
    r"\b(opening|first|second|third)\s+round\b", r"\b(semi|quarter)-?finals?\b", r"^ncaa\b", r"^(mawpc|nwpc|cwpa|wwpa|sciac|mpsf|wcc|big west|west coast)\b",
]
# Months as pages shorten them.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12}
# A final score as pages print it; words that say that there is none yet, and which of them mean what.
_RESULT = r"\b([WLT])\s*,?\s*(\d{1,3})\s*[-–]\s*(\d{1,3})\s*(\(?\s*\d?\s*(?:OT|ot)\s*\d?\s*\)?)?"
_NOT_FINAL = r"(?i)\b(postponed|cancell?ed|ppd|suspended|forfeit|in progress|live|halftime)\b"
_POSTPONED = r"(?i)\b(postponed|ppd|suspended)\b"
_CANCELLED = r"(?i)\b(cancell?ed|forfeit)\b"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bound(values: list[Column], use: Callable[..., Column]) -> Column:
    """As _once for several values."""
    return _once(F.struct(*[v.alias(f"_{i}") for i, v in enumerate(values)]), lambda x: use(*[x[f"_{i}"] for i in range(len(values))]))


def folded(text) -> Column:
    """Without space around it and with single spaces in it; null reads empty. Spaces that do not break are spaces."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(_c(text), F.lit("")), " ", " "), r"\s+", " "))


def team_name(raw) -> Column:
    """A printed name without marks on Latin letters, rankings and divisions before it, marks of exhibitions and one state behind it."""
    plain = F.regexp_replace(F.translate(F.translate(folded(raw), "‘’ʼ", "'''"), _MARKED, _PLAIN), "[̀-ͯ]", "")
    bare = F.regexp_replace(plain, rf"(?i)^(?:(?:{'|'.join(_BEFORE)})\s*)+", "")
    bare = F.regexp_replace(bare, rf"(?i)(?:\s*{_BEHIND}\s*)+$", "")
    states = "|".join(s.replace(".", r"\.") for s in _STATES.split())
    return F.trim(F.regexp_replace(F.trim(bare), rf"(?i)\s*\((?:{states})\.?\)\s*$", ""))


def names_no_team(name) -> Column:
    """Whether a team_name is page furniture."""
    return (_c(name) == "") | _c(name).rlike("(?i)" + "|".join(NON_TEAM))


def is_non_team(raw) -> Column:
    return _once(team_name(raw), names_no_team)


def name_words(raw) -> Column:
    """The words of a name, lower case, a-z and 0-9 only; a name without any has one empty word."""
    return F.split(F.trim(F.regexp_replace(F.lower(team_name(raw)), "[^a-z0-9]+", " ")), " ")


def spellings(name) -> Column:
    """Ever simpler spellings of a team_name, to be looked up among aliases: as it is, a campus of the University of California as uc, without a closing
    institutional word, without the, without a leading university of."""
    simpler = lambda base: F.array(
        base, F.trim(F.regexp_replace(base, r"^university of california\s*[-,]?\s*", "uc ")), F.regexp_replace(base, r"\s+(universities|university|colleges|college|academy)$", ""),
        F.regexp_replace(base, r"^the\s+", ""), F.regexp_replace(base, r"^(the\s+)?university of\s+", ""),
    )
    return _once(F.regexp_replace(F.lower(_c(name)), r"\.$", ""), simpler)


def team_slug(raw, aliases: dict[str, str], beginnings: dict[str, str] | None = None, most: int = 2000) -> Column:
    """The slug of a team: that of its first spelling among aliases, else that of the first pattern of beginnings which the name starts with, else one
    made of the name. aliases are a table kept by hand (at most `most`), so they are part of the expression and no join is needed."""
    if len(aliases) > most:
        raise ValueError(f"{len(aliases)} aliases, more than {most}: join them as a table")
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else F.lit(None).cast("map<string,string>")

    def slug(name):
        hit = F.get(F.array_compact(F.transform(spellings(name), lambda s: F.try_element_at(known, s))), F.lit(0))
        starts = [F.when(name.rlike(f"(?i)^{p}"), slug) for p, slug in (beginnings or {}).items()]
        made = F.regexp_replace(F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), "['’.]", ""), "[^a-z0-9]+", "-")
        return F.coalesce(hit, *starts, F.regexp_replace(made, "^-+|-+$", ""))

    return _once(team_name(raw), slug)


def clock(raw) -> Column:
    """The first time of day in a text as HH:MM of 24 hours, null without one."""

    def time(hour, minute, half):
        minute = F.coalesce(F.nullif(minute, F.lit("")).cast("int"), F.lit(0))
        hour = hour.try_cast("int") % F.when(hour == "12", 12).otherwise(100) + F.when(F.lower(F.substring(half, 1, 1)) == "p", 12).otherwise(0)
        return F.when((half != "") & (hour <= 23) & (minute <= 59), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0")))

    def read(text):
        at = lambda i: F.regexp_extract(text, r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*(a\.?m\.?|p\.?m\.?)", i)
        return _bound([at(1), at(2), at(3)], time)

    return _once(folded(raw), read)


def season_date(raw, season) -> Column:
    """The first "Sept. 12" of a text as YYYY-MM-DD: from August on in the year that the season begins in, else in the next. Null without a readable one;
    days are checked against 31 only."""
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])

    def date(month, day):
        year = _c(season).cast("int") + F.when(month >= 8, 0).otherwise(1)
        return F.when(month.isNotNull() & day.between(1, 31), F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0")))

    def read(text):
        at = lambda i: F.regexp_extract(text, r"\b([A-Za-z]{3,5})\.?\s+(\d{1,2})\b", i)
        return _bound([F.try_element_at(months, F.lower(at(1))), at(2).try_cast("int")], date)

    return _once(folded(raw), read)


def overtime(raw) -> Column:
    """OT, or 2OT and so on for more than one; null without any."""
    n = F.regexp_extract(_c(raw), r"(?i)(\d)?\s*OT", 1)
    return F.when(_c(raw).rlike("(?i)OT"), F.when(n.isin("", "1"), "OT").otherwise(F.concat(n, F.lit("OT"))))


def result(raw) -> Column:
    """outcome, us, them, ot of a result as the page's owner prints it; null without a final score, and where the letter and the score do not agree."""

    def score(outcome, us, them, more):
        sound = F.when(outcome == "W", us >= them).when(outcome == "L", us <= them).otherwise(us == them)
        return F.when(sound, F.struct(outcome.alias("outcome"), us.alias("us"), them.alias("them"), overtime(more).alias("ot")))

    def read(text):
        at = lambda i: F.regexp_extract(text, _RESULT, i)
        return F.when(text.rlike(_RESULT) & ~text.rlike(_NOT_FINAL), _bound([at(1), at(2).try_cast("int"), at(3).try_cast("int"), at(4)], score))

    return _once(folded(raw), read)


def game_status(text, scored: Column) -> Column:
    return F.when(scored, "final").when(_c(text).rlike(_POSTPONED), "postponed").when(_c(text).rlike(_CANCELLED), "cancelled").otherwise("scheduled")


def site_hint(href) -> Column:
    """https:// and the host of a link as pages write it, without www.; null for fragments, paths and hosts without a dot."""

    def read(raw):
        host = F.regexp_replace(F.lower(F.try_parse_url(F.when(raw.rlike("(?i)^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw)), F.lit("HOST"))), r"^www\.", "")
        return F.when((raw != "") & ~raw.rlike("^[#/]"), _once(host, lambda h: F.when(h.contains("."), F.concat(F.lit("https://"), h))))

    return _once(F.trim(_c(href)), read)


def absolute(link, page_url) -> Column:
    """A link of a page with its origin; null for links relative to the page's own folder."""
    u, page = _c(link), _c(page_url)
    origin = F.concat(F.try_parse_url(page, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(page, F.lit("AUTHORITY")))
    return F.when(u.rlike("(?i)^https?://"), u).when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/"), F.concat(origin, u))
