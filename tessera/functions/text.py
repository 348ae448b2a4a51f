"""Text and URL expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and what is left of them without.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
# Query parameters that only track a visit begin with one of these.
_TRACKING = "^(utm_|fbclid|gclid|ref|source|cmp|ns_|at_)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normal_title(title) -> Column:
    """Lower case, marks off Latin letters, everything but a-z, 0-9 to single spaces."""
    bare = F.translate(F.lower(F.coalesce(_c(title), F.lit(""))), _MARKED, _PLAIN)
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def title_tokens(title, longer_than: int = 2) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(normal_title(title), " "), lambda w: F.length(w) > longer_than)))


def jaccard(a: Column, b: Column) -> Column:
    """|A ∩ B| / |A ∪ B| of two distinct arrays, 0 if one is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def canonical_url(url) -> Column:
    """Without fragment, tracking parameters, leading www. and a closing slash; what is no URL stays as it is."""
    u = _c(url)
    host = F.try_parse_url(u, F.lit("HOST"))
    port = F.regexp_extract(F.try_parse_url(u, F.lit("AUTHORITY")), r":(\d+)$", 1)
    kept = F.filter(F.split(F.coalesce(F.try_parse_url(u, F.lit("QUERY")), F.lit("")), "&"), lambda p: (p != "") & ~F.lower(p).rlike(_TRACKING))
    path = F.try_parse_url(u, F.lit("PATH"))
    built = F.concat(
        F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))), F.lit("://"), F.regexp_replace(F.lower(host), r"^www\.", ""),
        F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path),
        F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""),
    )
    return F.when(host.isNull(), F.coalesce(u, F.lit(""))).otherwise(F.regexp_replace(built, "/$", ""))


def url_host(url) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(_c(url), F.lit("HOST"))), r"^www\.", "")


def truncated(text, most: int) -> Column:
    """The first `most` characters, cut at their last space if that is past 60 %, closing punctuation off, an ellipsis on."""
    t = _c(text)
    head = F.substring(t, 1, most)
    at_space = F.regexp_extract(head, "(?s)^(.*) ", 1)
    cut = F.when(F.length(at_space) > most * 0.6, at_space).otherwise(head)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(cut, r"[\s,;:.–-]+$", ""), F.lit("…")))


def plain_html(html) -> Column:
    """Visible text: scripts, styles, comments and tags out, the commonest entities decoded, white space folded."""
    t = _c(html)
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        t = F.regexp_replace(t, pattern, " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def html_links(html) -> Column:
    return F.regexp_extract_all(_c(html), F.lit(r'<a\s+href="([^"]*)"'), F.lit(1))


def first_rule(rules: list[tuple[str, Column]], otherwise: str = "Other") -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules], F.lit(otherwise))


def recency(published, now: Column, half_life_hours: float = 18) -> Column:
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp(_c(published))) / 3600)
    return F.pow(F.lit(0.5), age / half_life_hours)
