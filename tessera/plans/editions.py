"""Text queries over documents and pages: a document's first line is its title."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import selection, similarity
from .tables import scratch, stored

NOW = "2024-01-31 00:00:00"


def _read(spark, sf_dir, t):
    return spark.read.parquet(f"{sf_dir}/{t}.parquet")


def _titles(spark, sf_dir):
    title = F.substring_index("text", "\n", 1)
    return _read(spark, sf_dir, "documents").select("doc_id", "lang", "source", title.alias("title"), text.title_tokens(title).alias("tokens"))


def canonical_url(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", text.canonical_url("url").alias("canonical"))


def url_host(spark, sf_dir):
    return _read(spark, sf_dir, "pages").groupBy(text.url_host("url").alias("host")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


def html_text(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", text.plain_html("html").alias("text"))


def html_links(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.posexplode(text.html_links("html")).alias("pos", "href"))


def normal_titles(spark, sf_dir):
    return _titles(spark, sf_dir).select("doc_id", text.normal_title("title").alias("normal"), text.truncated("title", 60).alias("short"))


def title_jaccard_pairs(spark, sf_dir):
    """Pairs of distinct title token sets with a Jaccard over one half, by the smallest doc_id of each."""
    reps = stored(similarity.classes(_titles(spark, sf_dir), "doc_id", "tokens"), "titles")
    return similarity.similar_pairs(reps).withColumn("similarity", F.round("similarity", 6))


def title_classes(spark, sf_dir):
    """Each document with the class of its title's tokens and the number of other classes that are like it."""
    rows = _titles(spark, sf_dir)
    reps = stored(similarity.classes(rows, "doc_id", "tokens"), "titles")
    pairs = similarity.similar_pairs(reps)
    n = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return rows.join(reps, "tokens").join(n, "rep", "left").select("doc_id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def _nouns(spark, sf_dir):
    """Documents with the proper nouns of title and text; the source is the publisher."""
    d = _read(spark, sf_dir, "documents")
    title = F.substring_index("text", "\n", 1)
    return d.select("doc_id", "lang", selection.proper_nouns(title, F.substr("text", F.length(title) + 2), F.col("source")).alias("tokens"))


def rare_token_pairs(spark, sf_dir):
    """Pairs of classes of documents with the same proper nouns that share three of those in at most 15 % of the classes."""
    sorted_ = _nouns(spark, sf_dir).withColumn("tokens", F.array_sort("tokens"))
    return similarity.rare_token_pairs(similarity.classes(sorted_, "doc_id", "tokens"), "rep", "tokens")


def document_frequency(spark, sf_dir):
    """In how many documents of a language each proper noun stands."""
    return _nouns(spark, sf_dir).select("lang", F.explode("tokens").alias("token")).groupBy("lang", "token").agg(F.count("*").alias("df"))


def greedy_dedupe(spark, sf_dir):
    """Title classes, longest document first, without those like a class kept before."""
    d = _titles(spark, sf_dir).join(_read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    reps = stored(d.groupBy("tokens").agg(F.min("doc_id").alias("rep"), F.max("n_chars").alias("size")), "titles")
    # distinct ranks without a global sort: longer first, then the smaller id
    ranked = reps.withColumn("rank", F.struct((-F.col("size")).alias("size"), "rep"))
    kept = similarity.greedy_keep(ranked, similarity.similar_pairs(reps.select("rep", "tokens")), "rep", "rank", scratch(spark))
    return kept.select(F.col("rep").alias("doc_id"), "kept")


def topn_per_group(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.withColumn("place", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("n_chars"), "doc_id"))).where("place <= 3")


def recency_scores(spark, sf_dir):
    """Event scores: weight by kind, halved every 18 hours."""
    e = _read(spark, sf_dir, "events")
    weight = F.when(F.col("event_type") == "purchase", 1.5).when(F.col("event_type") == "error", 0.85).otherwise(1.0)
    return e.groupBy("user_id").agg(F.round(F.sum(weight * text.recency("ts", F.lit(NOW).cast("timestamp_ntz"))), 6).alias("score"))


def mentions(spark, sf_dir):
    """How often each word of a part's name occurs, and for how many brands."""
    p = _read(spark, sf_dir, "part")
    words = p.select(F.explode(F.split("p_name", " ")).alias("word"), "p_brand")
    return words.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"))


QUERIES = {
    f.__name__: f
    for f in (
        canonical_url, url_host, html_text, html_links, normal_titles, title_jaccard_pairs, title_classes, rare_token_pairs, document_frequency, greedy_dedupe,
        topn_per_group, recency_scores, mentions,
    )
}

_NORMAL = "trim(regexp_replace(translate(lower(split_part(text, chr(10), 1)), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g'))"
_TITLES = f"""t AS (SELECT doc_id, lang, n_chars, list_sort(list_distinct(list_filter(string_split({_NORMAL}, ' '), lambda x: length(x) > 2))) AS tokens FROM documents),
reps AS (SELECT tokens, min(doc_id) AS rep, count(*) AS copies FROM t GROUP BY tokens)"""
_PAIRS = """w AS (SELECT rep, len(tokens) AS n, unnest(tokens) AS token FROM reps),
met AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM w a JOIN w b ON a.token = b.token AND a.rep < b.rep GROUP BY a.rep, b.rep),
pairs AS (SELECT a, b, i / (na + nb - i) AS similarity FROM met WHERE i / (na + nb - i) > 0.5)"""
_WORDS = r"regexp_extract_all({}, '[A-Za-zÀ-ÖØ-öø-ÿ][0-9A-Za-z_À-ÖØ-öø-ÿ''’-]*|[.!?\n—]')"
_INSIDE = r"list_filter({0}, lambda w, i: i > 1 AND NOT regexp_matches({0}[i - 1], '^[.!?\n—]$') AND length(w) >= 4 AND regexp_matches(w, '^[A-ZÀ-Ö]'))"
_NOUNS = rf"""words AS (SELECT doc_id, lang, source, {_WORDS.format("split_part(text, chr(10), 1)")} AS tw, {_WORDS.format("substr(text, length(split_part(text, chr(10), 1)) + 2)")} AS xw FROM documents WHERE text IS NOT NULL),
nouns AS (SELECT doc_id, lang, list_filter(list_distinct(list_transform(list_concat({_INSIDE.format("tw")}, {_INSIDE.format("xw")}), lambda w: regexp_replace(lower(w), '[''’]s$', ''))),
    lambda w: NOT list_contains(regexp_split_to_array(lower(coalesce(source, '')), '[^a-z0-9]+'), w)) AS tokens FROM words
  UNION ALL SELECT doc_id, lang, [] FROM documents WHERE text IS NULL)"""
ORACLE_SQL = {
    "canonical_url": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www\.', '') AS host,
  regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages),
q AS (SELECT *, list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|fbclid|gclid|ref|source|cmp|ns_|at_)')) AS kept FROM p)
SELECT page_id, regexp_replace(scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END, '/$', '') AS canonical FROM q""",
    "url_host": r"SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\.', '') AS host, count(*) AS pages, min(page_id) AS first_page FROM pages GROUP BY 1",
    "html_text": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM a""",
    "html_links": """WITH l AS (SELECT page_id, regexp_extract_all(html, '<a\\s+href="([^"]*)"', 1) AS l FROM pages) SELECT page_id, CAST(u.i - 1 AS INTEGER) AS pos, l[u.i] AS href FROM l, unnest(range(1, len(l) + 1)) AS u(i)""",
    "normal_titles": f"""WITH t AS (SELECT doc_id, {_NORMAL} AS normal, split_part(text, chr(10), 1) AS title FROM documents),
c AS (SELECT *, left(title, 60) AS head, regexp_extract(left(title, 60), '(?s)^(.*) ', 1) AS space FROM t)
SELECT doc_id, normal, CASE WHEN length(title) <= 60 THEN title ELSE regexp_replace(CASE WHEN length(space) > 36 THEN space ELSE head END, '[\\s,;:.–-]+$', '') || '…' END AS short FROM c""",
    "title_jaccard_pairs": f"WITH {_TITLES}, {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs",
    "title_classes": f"""WITH {_TITLES}, {_PAIRS}, n AS (SELECT rep, count(*) AS links FROM (SELECT a AS rep FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY rep)
SELECT doc_id, rep AS class_id, coalesce(links, 0) AS links FROM t JOIN reps USING (tokens) LEFT JOIN n USING (rep)""",
    "rare_token_pairs": f"""WITH {_NOUNS}, reps AS (SELECT min(doc_id) AS rep, list_sort(tokens) AS tokens FROM nouns GROUP BY 2),
w AS (SELECT rep, unnest(tokens) AS token FROM reps), df AS (SELECT token FROM w GROUP BY token HAVING count(*) <= (SELECT greatest(2, floor(count(*) * 0.15)) FROM reps)),
r AS (SELECT w.* FROM w JOIN df USING (token)), n AS (SELECT rep, count(*) AS n FROM r GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS shared FROM r a JOIN r b ON a.token = b.token AND a.rep < b.rep GROUP BY ALL HAVING count(*) >= 3)
SELECT a, b, shared FROM p JOIN n x ON a = x.rep JOIN n y ON b = y.rep WHERE shared >= 0.25 * least(x.n, y.n)""",
    "document_frequency": f"WITH {_NOUNS} SELECT lang, token, count(*) AS df FROM (SELECT lang, unnest(tokens) AS token FROM nouns) GROUP BY ALL",
    "topn_per_group": "SELECT doc_id, lang, source, n_chars, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS place FROM documents QUALIFY place <= 3",
    "recency_scores": f"""SELECT user_id, round(sum(CASE event_type WHEN 'purchase' THEN 1.5 WHEN 'error' THEN 0.85 ELSE 1 END * pow(0.5, greatest(0, (epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 3600) / 18)), 6) AS score
FROM events GROUP BY 1""",
    "mentions": "SELECT word, count(*) AS n, count(DISTINCT p_brand) AS brands FROM (SELECT unnest(string_split(p_name, ' ')) AS word, p_brand FROM part) GROUP BY 1",
}
