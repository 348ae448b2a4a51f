"""Games on web pages: conference schedules, schools' schedules in two markups, polls, and which games a conference claims.

A page is one row and is read whole by one task; pages meet only where fixtures of one key do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import teams as T
from ..sources import markup

# Words of a matchup that stands for a place in a bracket.
_PLACEHOLDER = r"(?i)\b(seed|winner|loser|tbd|tba|bye|consolation|championship|semifinal|quarterfinal)\b"
# The classes of a classic schedule, the test ids of a newer one, and the labels of links to a game's report.
CLASSIC = "sidearm-schedule-"
NEWER = "s-game-card-standard__"
_NEWER_PLACE = "s-game-card-facility-and-location__standard-location-details"
_NEWER_LOGO = "s-game-card-opponent-logo__link"
_DETAIL = r"(?i)^(box ?score|recap|stats|final stats|game ?story)$"
_NO_LOGO = r"(?i)/site\.(png|jpg|svg)|responsive_2018/images/.*generic"


def _place(head: Column, pattern: str) -> Column:
    """The index of the first cell of a header that matches, -1 without one."""
    return F.array_position(F.transform(head, lambda c: c.rlike(pattern)), True).cast("int") - 1


def _cell(row: Column, at: Column) -> Column:
    return F.when(at >= 0, T.folded(F.get(row, at))).otherwise("")


def _whole(text: Column, digits: str) -> Column:
    return F.when(text.rlike(rf"^\d{digits}$"), text.try_cast("int"))


def conference_rows(pages: DataFrame, html: str, page: list[str], season: str, slug) -> DataFrame:
    """The rows of each page's schedule: the first table whose first row has a matchup column.

    page columns, row (its number), date, time, teams (two slugs, sorted), names (as printed), scores (of the two as printed), why. why is null for a
    fixture, else says what is missing: of a row ('not two identifiable teams', 'no readable date') or of a page, with row null ('no schedule table
    found', 'no date or matchup column'). Rows without matchup and date are spacers and left out. slug makes a slug of a printed name.
    """
    found = F.filter(F.coalesce(markup.tables(F.col(html)), F.array().cast("array<array<array<string>>>")), lambda t: F.exists(F.coalesce(F.get(t, F.lit(0)), F.array().cast("array<string>")), lambda c: c.rlike("(?i)matchup")))
    x = pages.select(*page, F.col(season).alias("_season"), F.get(found, F.lit(0)).alias("_t"))
    x = x.withColumn("_head", F.get("_t", F.lit(0)))
    for name, pattern in (("date", "(?i)^date"), ("matchup", "(?i)matchup"), ("dark", "(?i)dark score"), ("white", "(?i)white score")):
        x = x.withColumn(f"_{name}", _place(F.col("_head"), pattern))
    x = x.withColumn("_bad", F.when(F.col("_t").isNull(), "no schedule table found").when(F.col("_date") < 0, "no date or matchup column"))
    body = F.when(F.col("_bad").isNull(), F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0)))).otherwise(F.array().cast("array<array<string>>"))
    x = x.select("*", F.posexplode_outer(body).alias("row", "_r")).where("_r is not null or _bad is not null")
    when, match = _cell(F.col("_r"), F.col("_date")), _cell(F.col("_r"), F.col("_matchup"))
    x = x.withColumns({"_when": when, "_match": match}).where("_bad is not null or _when <> '' or _match <> ''")
    sides = F.transform(F.split(F.regexp_replace("_match", r"(?i)\s*\(Game \d+\)\s*$", ""), r"(?i)\s+vs\.?\s+"), lambda s: T.folded(s))
    x = x.withColumn("names", sides).withColumns({"_a": F.get("names", F.lit(0)), "_b": F.get("names", F.lit(1))})
    x = x.withColumns({"_sa": slug(F.col("_a")), "_sb": slug(F.col("_b"))})
    two = (F.size("names") == 2) & ~F.col("_match").rlike(_PLACEHOLDER) & ~T.is_non_team(F.col("_a")) & ~T.is_non_team(F.col("_b")) & (F.col("_sa") != "") & (F.col("_sb") != "") & (F.col("_sa") != F.col("_sb"))
    date = T.season_date(F.col("_when"), F.col("_season"))
    why = F.coalesce("_bad", F.when(~F.coalesce(two, F.lit(False)), "not two identifiable teams"), F.when(date.isNull(), "no readable date"))
    time = F.when(F.col("_when").rlike(r"(?i)\bnoon\b"), "12:00").otherwise(T.clock(F.col("_when")))
    score = lambda c: _whole(_cell(F.col("_r"), F.col(c)), "{1,3}")
    scores = F.when((F.col("_dark") >= 0) & (F.col("_white") >= 0), F.array(score("_dark"), score("_white")))
    x = x.withColumn("why", why)
    good = lambda c: F.when(F.col("why").isNull(), c)
    return x.select(
        *page, F.when(F.col("_bad").isNull(), F.col("row") + 1).alias("row"), good(date).alias("date"), good(time).alias("time"), good(F.array_sort(F.array("_sa", "_sb"))).alias("teams"),
        good(F.col("names")).alias("names"), good(scores).alias("scores"), "why",
    )


def claimed_fixtures(rows: DataFrame, page: str, conference: str, url: str) -> DataFrame:
    """date, teams, conference, url of the fixtures that one conference claims once: those that a page lists twice, or that two conferences list, are
    out, since a game without a conference is right and a guessed one is not. On several pages of one conference, the last page's url counts."""
    a_page = rows.where("why is null").groupBy("date", "teams", page).agg(F.count("*").alias("_n"), F.min(conference).alias("_c"), F.max(url).alias("_u"))
    keys = a_page.groupBy("date", "teams").agg(F.max("_n").alias("_n"), F.min("_c").alias("conference"), F.max("_c").alias("_other"), F.max_by("_u", page).alias("url"))
    return keys.where("_n = 1 and conference = _other").drop("_n", "_other")


def classified(games: DataFrame, fixtures: DataFrame) -> DataFrame:
    """games (date, teams as a sorted pair, and more) with conference and conference_source, null for what no conference lists."""
    return games.join(fixtures.withColumnRenamed("url", "conference_source"), ["date", "teams"], "left")


def _first(parts: Column, test) -> Column:
    return F.get(F.filter(parts, test), F.lit(0))


def _details(parts: Column, url: str) -> Column:
    links = F.filter(parts, lambda p: (p["tag"] == "a") & p["text"].rlike(_DETAIL))
    return F.get(F.filter(F.transform(links, lambda p: T.absolute(p["href"], F.col(url))), lambda u: u.isNotNull()), F.lit(0))


def _games(x: DataFrame, page: list[str], scored: Column, said: Column, opponent: Column, day: Column, time: Column, more: dict[str, Column]) -> DataFrame:
    """The rows of cards with an opponent that is a team and a readable date."""
    # one row is exploded to itself, so that what decides about a card is worked out once and not again where cards are left out
    x = x.withColumn("_opp", opponent).select("*", F.explode(F.array(F.struct(day.alias("date"), T.team_name(F.col("_opp")).alias("name")))).alias("_g"))
    x = x.where(~T.names_no_team(F.col("_g.name")) & F.col("_g.date").isNotNull()).withColumns({"_scored": T.result(scored), "_blob": F.concat_ws(" ", scored, said)})
    return x.select(
        *page, F.col("_c.id").alias("game_id"), F.col("_g.date").alias("date"), time.alias("time"), F.col("_opp").alias("printed"), F.col("_g.name").alias("opponent"), T.game_status(F.col("_blob"), F.col("_scored").isNotNull()).alias("status"),
        *[F.col(f"_scored.{c}").alias(c) for c in ("us", "them", "outcome", "ot")], *[c.alias(n) for n, c in more.items()],
    )


def classic_schedule(pages: DataFrame, html: str, page: list[str], url: str, season: str) -> DataFrame:
    """The games of classic schedules, one a game id and page (pages repeat them), as the page's owner prints them: page columns, game_id, date, time,
    printed and opponent, status, us, them, outcome, ot, neutral, away, exhibition, venue, tournament, conference_marker, opponent_logo, opponent_site,
    detail_url. Cards without a team or a readable date are left out; null pages have none."""
    n = {k: CLASSIC + f"game-{k}" for k in ("result", "status", "opponent-name", "opponent-date", "location", "conference", "opponent-promotion", "note", "opponent-logo")}
    card = markup.cards(F.col(html), CLASSIC + "game", list(n.values()), "data-game-id", CLASSIC + "tournament")
    x = pages.select(*{*page, url, season}, F.explode(card).alias("_c")).withColumn("_p", F.col("_c.parts"))
    text = lambda k: F.coalesce(F.get("_c.first", F.lit(list(n).index(k)))["text"], F.lit(""))
    x = x.withColumn("_link", _first(F.col("_p"), lambda p: (p["tag"] == "a") & F.array_contains(p["within"], n["opponent-name"])))
    link = F.col("_link")
    logo = _first(F.col("_p"), lambda p: (p["tag"] == "img") & F.array_contains(p["within"], n["opponent-logo"]))["src"]
    badge = F.exists("_p", lambda p: (F.array_contains(p["names"], n["opponent-promotion"]) | F.array_contains(p["names"], n["note"])) & p["text"].rlike("(?i)exhibition|scrimmage"))
    marked = lambda kind: F.exists("_c.names", lambda c: c.contains(f"{CLASSIC}{kind}-game"))
    neutral, away = marked("neutral"), marked("away")
    when = text("opponent-date")
    more = {
        "neutral": neutral, "away": ~neutral & away, "exhibition": badge, "venue": F.nullif(text("location"), F.lit("")), "tournament": F.col("_c.around"),
        "conference_marker": F.nullif(text("conference"), F.lit("")), "opponent_logo": F.when(~logo.rlike(_NO_LOGO), T.absolute(logo, F.col(url))),
        "opponent_site": T.site_hint(link["href"]), "detail_url": _details(F.col("_p"), url),
    }
    opponent = F.coalesce(F.nullif(link["text"], F.lit("")), text("opponent-name"))
    return _games(x, page, text("result"), text("status"), opponent, T.season_date(when, F.col(season)), T.clock(when), more)


def newer_schedule(pages: DataFrame, html: str, page: list[str], url: str, season: str) -> DataFrame:
    """As classic_schedule for the newer markup, which has no game ids and does not mark neutral games (null). A conference's pill is no tournament."""
    conf, stamp, pill, state = "s-game-card__header__conf-text", "s-game-card__header__stamp", "s-descriptor__text", "s-game-card__header__status"
    badge = "s-game-card__promotion-btn-text"
    n = {k: NEWER + f"header-{k}" for k in ("game-team-score", "game-status", "team-opponent-link", "game-date-details", "game-date", "game-time")}
    names = [*n.values(), conf, stamp, pill, state, badge, _NEWER_PLACE, _NEWER_LOGO]
    card = markup.cards(F.col(html), NEWER + "root", names)
    x = pages.select(*{*page, url, season}, F.explode(card).alias("_c")).withColumn("_p", F.col("_c.parts"))
    part = lambda name: F.get("_c.first", F.lit(names.index(name)))
    said = lambda *names: F.coalesce(*[F.nullif(part(m)["text"], F.lit("")) for m in names], F.lit(""))
    when, hour = said(n["game-date-details"], n["game-date"]), said(n["game-time"])
    any_date = F.when(when != "", when).otherwise(hour)
    chip = _first(F.col("_p"), lambda p: F.array_contains(p["names"], pill) & ~F.array_contains(p["names"], conf) & ~F.array_contains(p["within"], conf) & (p["text"] != ""))["text"]
    logo = _first(F.col("_p"), lambda p: (p["tag"] == "img") & F.array_contains(p["within"], _NEWER_LOGO))["src"]
    more = {
        "neutral": F.lit(None).cast("boolean"), "away": F.lower(said(stamp)) == "at", "exhibition": F.exists("_p", lambda p: F.array_contains(p["names"], badge) & p["text"].rlike("(?i)exhibition|scrimmage")),
        "venue": F.nullif(said(_NEWER_PLACE), F.lit("")), "tournament": chip, "conference_marker": F.nullif(said(conf), F.lit("")), "opponent_logo": logo,
        "opponent_site": T.site_hint(F.coalesce(part(n["team-opponent-link"])["href"], part(_NEWER_LOGO)["href"])), "detail_url": _details(F.col("_p"), url),
    }
    return _games(x, page, said(n["game-team-score"]), said(n["game-status"], state), said(n["team-opponent-link"]), T.season_date(any_date, F.col(season)), F.coalesce(T.clock(any_date), T.clock(hour)), more)


def poll_rows(pages: DataFrame, html: str, page: list[str], title: str, slug, other: str = r"(?i)division\s*iii|conference") -> DataFrame:
    """The rows of each page's poll: the first table of two rows or more whose first row matches `title` and not `other`; its header is the first row with
    a cell Rank. page columns, week (of the title), previous_week (of the column that names the poll before), place (order on the page), rank, name,
    team, previous, points, points_text, all as printed. Pages without such a table, or without Rank, Team and Points, have one row with place null and why."""
    none = F.array().cast("array<array<array<string>>>")
    heading = lambda t: T.folded(F.array_join(F.get(t, F.lit(0)), ""))
    found = F.filter(F.coalesce(markup.tables(F.col(html)), none), lambda t: (F.size(t) >= 2) & heading(t).rlike(title) & ~heading(t).rlike(other))
    x = pages.select(*page, F.get(found, F.lit(0)).alias("_t")).withColumn("_title", heading(F.col("_t")))
    x = x.withColumn("_h", F.array_position(F.transform("_t", lambda r: F.exists(r, lambda c: T.folded(c).rlike("(?i)^rank$"))), True).cast("int")).withColumn("_head", F.get("_t", F.col("_h") - 1))
    for name, pattern in (("rank", "(?i)^rank$"), ("team", "(?i)^team$"), ("previous", "(?i)poll$"), ("points", "(?i)^points$")):
        x = x.withColumn(f"_{name}", _place(F.col("_head"), pattern))
    bad = F.when(F.col("_t").isNull(), "no table of that title").when(F.col("_h") == 0, "no header").when((F.col("_rank") < 0) | (F.col("_team") < 0) | (F.col("_points") < 0), "header of another shape")
    x = x.withColumn("why", bad)
    body = F.when(F.col("why").isNull(), F.slice("_t", F.col("_h") + 1, F.greatest(F.size("_t") - F.col("_h"), F.lit(0)))).otherwise(F.array().cast("array<array<string>>"))
    x = x.select("*", F.posexplode_outer(body).alias("_at", "_r"))
    at = lambda c: F.translate(_cell(F.col("_r"), F.col(c)), "‘’ʼ", "'''")
    x = x.withColumns({"rank": at("_rank"), "name": at("_team"), "previous": at("_previous"), "points_text": at("_points")}).where("why is not null or (rank <> '' and name <> '')")
    week = lambda c: F.regexp_extract(c, r"(?i)week\s*(\d+)", 1).try_cast("int")
    empty = lambda c: F.when(F.col("why").isNull(), F.nullif(F.col(c), F.lit("")))
    return x.select(
        *page, week(F.col("_title")).alias("week"), week(F.get("_head", F.when(F.col("_previous") >= 0, F.col("_previous")))).alias("previous_week"), F.when(F.col("why").isNull(), F.col("_at") + 1).alias("place"),
        empty("rank").alias("rank"), empty("name").alias("name"), F.when(F.col("why").isNull(), slug(F.col("name"))).alias("team"), empty("previous").alias("previous"),
        F.when(F.col("why").isNull(), _whole(F.col("points_text"), "+")).alias("points"), empty("points_text").alias("points_text"), "why",
    )


def poll_problems(rows: DataFrame, page: list[str], published: str, least: int = 15) -> DataFrame:
    """page columns and problems, what keeps a poll from being published: no week, too few rows or numbered ranks, rows without a team, no points at all,
    no date of publication; empty for one that can be."""
    real = F.col("place").isNotNull()
    g = rows.groupBy(*page).agg(
        F.max("week").alias("w"), F.count_if(real).alias("n"), F.count_if(real & F.col("rank").rlike(r"^\d")).alias("ranked"), F.count_if(real & (F.coalesce("team", F.lit("")) == "")).alias("unknown"),
        F.count("points").alias("p"), F.max(F.col(published).isNotNull()).alias("dated"),
    )
    tests = [
        (F.coalesce(F.col("w"), F.lit(0)) < 1, F.lit("no week number")), (F.col("n") < least, F.format_string("only %d rows", "n")), (F.col("ranked") < least, F.format_string("only %d numbered ranks", "ranked")),
        (F.col("unknown") > 0, F.lit("a row has no identifiable team")), (F.col("p") == 0, F.lit("no points were readable")), (~F.col("dated"), F.lit("no publication date")),
    ]
    return g.select(*page, F.array_compact(F.array(*[F.when(c, m) for c, m in tests])).alias("problems"))
