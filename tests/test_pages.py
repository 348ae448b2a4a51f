"""Schedules, polls and team names as pages print them, by hand cases."""

from pyspark.sql import functions as F

from tessera.functions import teams as T
from tessera.operators import fixtures, schedules
from tessera.sources import markup

ALIASES = {"long island": "liu", "liu": "liu", "naval academy": "navy", "navy": "navy", "u.s. naval academy": "navy", "la verne": "la-verne", "uc davis": "uc-davis", "iona universtiy": "iona", "brown": "brown"}
SAINTS = {r"m(?:oun)?t\.?\s+(?:st\.?|saint)\s+mary": "mount-st-marys", r"(?:st\.?|saint)\s+mary": "saint-marys-ca"}


def slug(raw):
    return T.team_slug(raw, ALIASES, SAINTS)


def values(spark, texts, of):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", of(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_names_and_slugs(spark):
    printed = ["No. 13 UC Davis", "#3 (D-III) Redlands", "(RV) LIU", "RV Wagner  College", "Biola (Calif.)", "San José State", "Navy (Exh.)", "  (RV/21) (T) O’Neil A&M ", None]
    assert values(spark, printed, T.team_name) == ["UC Davis", "Redlands", "LIU", "Wagner College", "Biola", "San Jose State", "Navy", "O'Neil A&M", ""]
    names = ["Long Island University", "Naval Academy", "Mt. St. Mary's (Md.)", "Saint Mary's College of California", "University of La Verne", "University of California - Davis", "Iona Universtiy", "A & M State", "rvx", None]
    assert values(spark, names, slug) == ["liu", "navy", "mount-st-marys", "saint-marys-ca", "la-verne", "uc-davis", "iona", "a-and-m-state", "rvx", ""]
    assert values(spark, ["NWPC Tournament", "TBA", "Semi-Finals", "NCAA First Round", "", None, "Princeton", "Openly"], T.is_non_team) == [True] * 6 + [False] * 2


def test_dates_times_results(spark):
    dates = ["Sat., Sept. 12", "Wed. Sept. 30", "Sat., Nov 7 (Noon)", "Jan. 5", "Foo 12", "Sept. 32", "TBD", None]
    assert values(spark, dates, lambda t: T.season_date(t, F.lit(2026))) == ["2026-09-12", "2026-09-30", "2026-11-07", "2027-01-05", None, None, None, None]
    assert values(spark, ["2 p.m.", "12:30 AM ET", "12 p.m.", "1 p.m. ET/10 a.m. PT", "25:00 a.m.", "7:99 pm", "noon", None], T.clock) == ["14:00", "00:30", "12:00", "13:00", None, None, None, None]
    got = values(spark, ["W, 16-15 2OT", "L, 15-16 (2 OT)", "T, 9–9 OT", "W, 9-16", "T, 9-8", "Postponed W, 3-2", "", None], T.result)
    assert [tuple(r) if r else None for r in got] == [("W", 16, 15, "2OT"), ("L", 15, 16, "2OT"), ("T", 9, 9, "OT"), None, None, None, None, None]
    assert values(spark, ["http://www.Example.com/", "example.com/x", "#", "/a", "localhost", " ", None], T.site_hint) == ["https://example.com"] * 2 + [None] * 5
    links = values(spark, ["https://a.b/c", "//a.b/c", "/c", "c", None], lambda t: T.absolute(t, F.lit("https://p.q:8/r")))
    assert links == ["https://a.b/c", "https://a.b/c", "https://p.q:8/c", None, None]


def test_tables_of_untidy_pages(spark):
    pages = [
        "<table><tr><td>a<td>b&nbsp; c<tr><th>d</th></table>", "<table><tr><td>x<table><tr><td>in</td></tr></table>y</td><td>z</td></tr></table>",
        "<script>'<table><tr><td>no'</script><!-- <table> --><p>text", "<table><tr><td>cut <b>of", "<td>alone</td><tr></table></table>", "", None,
    ]
    got = values(spark, pages, markup.tables)
    assert got == [[[["a", "b c"], ["d"]]], [[["xiny", "z"]], [["in"]]], [], [[["cut of"]]], [], [], []]


def conference(spark, pages):
    df = spark.createDataFrame(pages, "page string, conference string, html string").withColumns({"season": F.lit(2026), "url": F.concat(F.lit("https://"), "page")})
    return schedules.conference_rows(df, "html", ["page", "conference", "url"], "season", slug)


def page(*rows, head="<tr><th>Date</th><th>Matchup</th><th>Dark Score</th><th>White Score</th></tr>"):
    return "<table><tr><td>other</td></tr></table><table>" + head + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table><table><tr><th>Matchup</th></tr></table>"


def test_conference_schedules(spark):
    html = page(
        ("Sat., Sept. 5", "Mount St. Mary's University vs. U.S. Naval Academy", "9", "x"), ("", "&nbsp;"), ("Oct. 4 (Noon)", "Brown vs Iona Universtiy (Game 2)", "10", "7"), ("Nov. 1", "4th Seed vs. 5th Seed (Game 1)"),
        ("Nov. 2", "Navy vs. Naval Academy"), ("soon", "Navy vs. Brown"), ("Nov. 3", "Navy"), ("Nov. 4 7 p.m.",),
    )
    got = {(r.page, r.row): r for r in conference(spark, [("a", "X", html), ("b", "X", "<p>Coming soon</p>"), ("c", "X", page(("x", "y"), head="<tr><th>Matchup</th></tr>")), ("d", "X", None), ("e", "X", page())]).collect()}
    first = got[("a", 1)]
    assert (first.date, first.time, first.teams, first.scores) == ("2026-09-05", None, ["mount-st-marys", "navy"], [9, None])
    assert (got[("a", 3)].time, got[("a", 3)].teams, got[("a", 3)].names) == ("12:00", ["brown", "iona"], ["Brown", "Iona Universtiy"])
    assert {k: r.why for k, r in got.items() if r.why} == {
        ("a", 4): "not two identifiable teams", ("a", 5): "not two identifiable teams", ("a", 6): "no readable date", ("a", 7): "not two identifiable teams", ("a", 8): "not two identifiable teams",
        ("b", None): "no schedule table found", ("c", None): "no date or matchup column", ("d", None): "no schedule table found",
    }


def test_a_game_counts_only_where_one_conference_lists_it_once(spark):
    row, twice, both = ("Oct. 10", "Navy vs. Brown"), ("Oct. 11", "Navy vs. Brown"), ("Oct. 12", "Brown vs. Navy")
    rows = conference(spark, [("a", "X", page(row, twice, twice, both)), ("b", "Y", page(both)), ("c", "X", page(row))])
    games = spark.createDataFrame([(d, t) for d in ("2026-10-10", "2026-10-11", "2026-10-12") for t in (["brown", "navy"], ["iona", "navy"])], "date string, teams array<string>")
    got = {(r.date, r.teams[0]): (r.conference, r.conference_source) for r in schedules.classified(games, schedules.claimed_fixtures(rows, "page", "conference", "url")).collect()}
    assert got.pop(("2026-10-10", "brown")) == ("X", "https://c")
    assert len(got) == 5 and set(got.values()) == {(None, None)}


def test_classic_cards(spark):
    c = schedules.CLASSIC
    inner = f"""<div class="{c}game-opponent-logo"><img data-src="/logo.png"></div><div class="{c}game-opponent-name"><a href="http://www.bears.com/">No. 3 Brown</a></div>
      <div class="{c}game-opponent-date"><span>Aug 29</span><span>2 p.m.</span></div><div class="{c}game-result"><span>W,</span><span>16-15</span> OT</div><div class="{c}game-location"><span>City</span><span>Pool</span></div>
      <span class="{c}game-conference">CWPA</span><a href="/t">Tickets</a><a href="/box">Box Score</a><a href="/recap">Recap</a>"""
    card = lambda i, kind, body: f'<li class="{c}game {c}{kind}-game" data-game-id="{i}">{body}</li>'
    html = f'<ul><li class="{c}tournament"><p>Bruno Classic</p><ul>{card(1, "neutral", inner)}</ul></li>{card(1, "home", inner)}{card(2, "away", inner.replace("W,", "Canceled"))}'
    html += card(3, "home", inner.replace("No. 3 Brown", "TBA")) + card(4, "home", inner.replace("Aug 29", "soon")) + f'<li class="{c}game">{inner}</li></ul>'
    df = spark.createDataFrame([("p", html), ("q", None), ("r", "")], "page string, html string").withColumns({"season": F.lit(2026), "url": F.lit("https://own.com/x/y")})
    got = {r.game_id: r for r in schedules.classic_schedule(df, "html", ["page"], "url", "season").collect()}
    assert set(got) == {"1", "2"}
    g = got["1"]
    assert (g.date, g.time, g.opponent, g.status, g.us, g.them, g.ot) == ("2026-08-29", "14:00", "Brown", "final", 16, 15, "OT")
    assert (g.neutral, g.away, g.exhibition, g.venue, g.tournament, g.conference_marker) == (True, False, False, "City Pool", "Bruno Classic", "CWPA")
    assert (g.opponent_logo, g.opponent_site, g.detail_url) == ("https://own.com/logo.png", "https://bears.com", "https://own.com/box")
    assert (got["2"].status, got["2"].us, got["2"].away, got["2"].tournament) == ("cancelled", None, True, None)


def test_newer_cards(spark):
    n = schedules.NEWER
    part = lambda name, text: f'<div data-test-id="{n}header-{name}">{text}</div>'
    html = f"""<div data-test-id="{n}root"><span class="s-game-card__header__stamp">at</span><a data-test-id="{n}header-team-opponent-link" href="/x">Iona</a>{part("game-date", "Sep 4 (Fri)")}{part("game-time", "6:15 PM")}
      {part("game-team-score", "L, 3-4")}<div class="s-game-card__header__conf-text"><i data-test-id="s-descriptor__text">MAWPC</i></div><span class="s-game-card__promotion-btn-text">Scrimmage</span></div>"""
    df = spark.createDataFrame([("p", html + html.replace("L, 3-4", "Postponed").replace("Scrimmage", "Buy"))], "page string, html string").withColumns({"season": F.lit(2026), "url": F.lit("https://own.com/")})
    a, b = sorted(schedules.newer_schedule(df, "html", ["page"], "url", "season").collect(), key=lambda r: r.status)
    assert (a.date, a.time, a.opponent, a.status, a.them, a.away, a.neutral, a.exhibition, a.tournament, a.conference_marker, a.game_id) == ("2026-09-04", "18:15", "Iona", "final", 4, True, None, True, None, "MAWPC", None)
    assert (b.status, b.us, b.exhibition) == ("postponed", None, False)


def test_polls(spark):
    rows = "".join(f"<tr><td>{r}</td><td>{t}</td><td>{p}</td><td>{n}</td></tr>" for r, t, p, n in (("1", "Navy", "2", "99"), ("2 (T)", "Brown", "", "80"), ("RV", "St. Mary’s", "RV", "n/a"), ("", "", "", "")))
    table = "<table><tr><td>{}</td></tr><tr><th>Rank</th><th>Team</th><th>2026 Week 2 Poll</th><th>Points</th></tr>" + rows + "</table>"
    good = table.format("Division III Men's Varsity Top 20") + table.format("2026 Men's Varsity Top 20 (Week 3)")
    df = spark.createDataFrame([("a", good, "2026-09-16"), ("b", table.format("Top 5"), None), ("c", good.replace("Points", "Votes"), None), ("d", None, "2026-09-16")], "page string, html string, published string")
    out = schedules.poll_rows(df, "html", ["page", "published"], "(?i)men's varsity top 20", slug).cache()
    a = sorted((r for r in out.collect() if r.page == "a"), key=lambda r: r.place)
    assert [(r.rank, r.team, r.previous, r.points, r.points_text) for r in a] == [("1", "navy", "2", 99, "99"), ("2 (T)", "brown", None, 80, "80"), ("RV", "saint-marys-ca", "RV", None, "n/a")]
    assert {(r.week, r.previous_week, r.why) for r in a} == {(3, 2, None)}
    assert {r.page: (r.place, r.why) for r in out.collect() if r.page != "a"} == {"b": (None, "no table of that title"), "c": (None, "header of another shape"), "d": (None, "no table of that title")}
    gate = {r.page: r.problems for r in schedules.poll_problems(out, ["page"], "published", least=2).collect()}
    assert gate["a"] == [] and "no publication date" in gate["b"] and gate["d"] == ["no week number", "only 0 rows", "only 0 numbered ranks", "no points were readable"]
    assert {r.page: r.problems for r in schedules.poll_problems(out, ["page"], "published", least=3).collect()}["a"] == ["only 2 numbered ranks"]


def evidence(spark, rows):
    df = spark.createDataFrame(rows, "name string, slug string, host string")
    return fixtures.identity_evidence(df, "slug", "name", "host")


def test_evidence_for_one_team(spark):
    concordia = [("Concordia", "concordia", "cui.com"), ("Harvard", "harvard", "crimson.com"), ("Concordia Irvine", "concordia-irvine", "cui.com"), ("Concordia Irvine", "concordia-irvine", "cui.com"), (None, "concordia-irvine", "cui.com"), ("Concordia Wisconsin", "concordia-wisconsin", "cuw.com")]
    got = evidence(spark, concordia)
    row = got.collect()[0]
    assert got.count() == 1 and (row.host, row.slugs, row.links, row.merged, row.winner) == ("cui.com", ["concordia", "concordia-irvine"], [1, 3], True, "concordia-irvine")
    merges = fixtures.merges_of(got)
    names = spark.createDataFrame([(s, s) for s in ("concordia", "concordia-irvine", "concordia-wisconsin")], "slug string, was string")
    assert {r.was: r.slug for r in fixtures.canonical(names, merges, "slug").collect()} == {"concordia": "concordia-irvine", "concordia-irvine": "concordia-irvine", "concordia-wisconsin": "concordia-wisconsin"}
    link = evidence(spark, [("UC San Diego", "uc-san-diego", "toreros.com"), ("San Diego", "san-diego", "toreros.com"), ("San Diego State", "san-diego-state", "toreros.com"), (None, None, "x"), ("A", "a", None)])
    assert [(r.merged, r.winner, len(r.slugs)) for r in link.collect()] == [(False, None, 3)] and fixtures.merges_of(link).count() == 0
    own = evidence(spark, [("Pomona-Pitzer", "pomona-pitzer", "sage.com"), (None, "pomona-pitzer-colleges", "sage.com")]).collect()[0]
    assert (own.merged, own.winner) == (True, "pomona-pitzer-colleges")
    assert evidence(spark, []).count() == 0


def test_plain_pages_read_as_the_parser_reads_them():
    """Pages that the one expression reads equal the parser's elements; odd ones are left to the parser."""
    import random

    from tessera.sources.markup import _Elements

    pieces = [
        "<table>", "</table>", "<tr>", "</tr>", "<td class='a b'>", "</TD>", "<th>", "<b>", "</b>", "<li class=\"a\" data-game-id='7'>", "</li>", "<ul>", "</ul>", "<p>", "x y", " a&amp;b ", "<br/>", "<br>", "<img src='u' data-src=\"v\" alt>", "<a href='/x?y=1'>",
        "</a>", "<i/>", "<!-- <td> -->", "<script>var t = '<table>';</script>", "<style>td > b</style>", "<div data-test-id='root a'>", "</div>", "\n",
    ]
    odd = ["<td width=3>", "a < b", "<!doctype html>", "<a href='?a&amp;b'>", "<title>t</title>", "<!---->", "<!-->", "</ td>", "<td", "&amp", "<script>'</b>'</script>", "<script/>", "<td a='1'b='2'>", "<script><!-- <script> --></script>", "<textarea><td></textarea>", "&"]
    rng, plain = random.Random(5), 0
    for n in range(3000):
        html = "".join(rng.choice(pieces + odd * (n % 3 == 0)) for _ in range(rng.randint(0, 25)))
        want = _Elements({"table", "tr", "td", "th", "a", "img", "p"}, {"a", "root"})
        want.feed(html)
        want.close()
        got = _Elements({"table", "tr", "td", "th", "a", "img", "p"}, {"a", "root"})
        plain += got._read_plain(html)
        assert _Elements({"table", "tr", "td", "th", "a", "img", "p"}, {"a", "root"}).read(html) == want.found, html
    assert plain > 1500


def test_what_decides_about_a_card_is_worked_out_once(spark):
    """A card's date and name decide whether it is a game; the cards that stay do not have them read again."""
    df = spark.createDataFrame([("p", "", 2026, "https://own.com")], "page string, html string, season int, url string")
    for schedule in (schedules.classic_schedule, schedules.newer_schedule):
        plan = schedule(df, "html", ["page"], "url", "season")._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.split("\n") if "Filter" in line.split("(")[0]]
        assert filters and not any("regexp_extract" in line or "translate(" in line for line in filters)


def test_the_first_elements_of_a_card(spark):
    html = "<div class='root'><a class='x' href='/1'>one</a><b class='x y'>two</b><p class='z'></p></div><div class='root'></div>"
    cards = values(spark, [html, None], lambda t: markup.cards(t, "root", ["y", "x", "w", "z"]))
    firsts = [[f and (f.text, f.href) for f in c.first] for c in cards[0]]
    assert firsts == [[("two", None), ("one", "/1"), None, ("", None)], [None] * 4] and cards[1] == []
    assert [[(p.tag, p.text) for p in c.parts] for c in cards[0]] == [[("a", "one"), ("b", "two"), ("p", "")], []]


def test_rows_are_dealt_before_they_are_written_as_pages(spark):
    """Orders travel, not markup, and into a number of tasks that does not shrink with their bytes."""
    from tessera.plans import pages as plans

    for query, n in ((plans.school_schedules, 2), (plans.conference_schedule, 1)):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("\n")
        dealt = [i for i, line in enumerate(plan) if "Exchange" in line and "REPARTITION_BY_NUM" in line]
        assert len(dealt) == n and not any("collect_list" in line or "<td>" in line or "<li" in line for i in dealt for line in plan[i : i + 3])
