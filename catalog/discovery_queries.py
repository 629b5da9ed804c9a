"""Robots, sitemap and URL-ranking queries over files derived from the fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import query, table
from doclake.functions.urls import base_url, url_path
from doclake.operators import discovery as D

_NS = f'xmlns="{D.SITEMAP_NAMESPACE}"'

# One robots file per host of the pages table. Its size does not grow with the number of pages of the host.
_HOSTS_SQL = """
  hosts AS (SELECT regexp_extract(url, '^[a-z]+://[^/?#]*') AS host, min(split_part(url, '/', 4)) AS seg,
            count(*) AS n FROM pages GROUP BY 1),
  robots AS (SELECT host, '# rules' || chr(10) || 'Sitemap: ' || host || '/sitemap.xml' || chr(10) || 'Disallow: /early'
    || chr(10) || 'User-agent: otherbot' || chr(10) || 'Disallow: /' || chr(10) || '  USER-AGENT:  * ' || chr(10)
    || 'Disallow: /' || seg || '/1' || chr(10) || 'Allow: /' || chr(10) || 'Disallow:' || chr(10) || 'Disallow: /' || seg
    || '/1' || chr(10) || 'Crawl-delay: ' || n || chr(10) || 'crawl-delay: soon' || chr(10) || 'disallow: /' || seg || '/2'
    AS text FROM hosts)
"""


def robots_files(spark, sf) -> DataFrame:
    hosts = (
        table(spark, sf, "pages")
        .groupBy(base_url("url").alias("host"))
        .agg(F.min(F.split_part("url", F.lit("/"), F.lit(4))).alias("seg"), F.count("*").cast("string").alias("n"))
    )
    ban = lambda i: F.concat(F.lit("isallow: /"), "seg", F.lit(f"/{i}"))
    text = F.concat(
        F.lit("# rules\nSitemap: "),
        "host",
        F.lit("/sitemap.xml\nDisallow: /early\nUser-agent: otherbot\nDisallow: /\n  USER-AGENT:  * \nD"),
        ban(1),
        F.lit("\nAllow: /\nDisallow:\nD"),
        ban(1),
        F.lit("\nCrawl-delay: "),
        "n",
        F.lit("\ncrawl-delay: soon\nd"),
        ban(2),
    )
    return hosts.select("host", text.alias("text"))


# The SQL finds the agent in force with a window over the lines, where the query cuts the file at its agent lines.
_RULES_SQL = f"""
{_HOSTS_SQL}, lines AS (
  SELECT host, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM robots
), named AS (
  SELECT host, pos, trim(raw) AS line, lower(split_part(trim(raw), ':', 1)) AS rule,
    trim(substr(trim(raw), instr(trim(raw), ':') + 1)) AS value FROM lines WHERE trim(raw) <> '' AND trim(raw) NOT LIKE '#%'
), scoped AS (
  SELECT *, last_value(CASE WHEN rule = 'user-agent' THEN value END IGNORE NULLS)
    OVER (PARTITION BY host ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS agent FROM named
), rules AS (
  SELECT DISTINCT host, rule, value FROM scoped WHERE rule = 'disallow' AND agent = '*' AND value <> ''
  UNION ALL
  SELECT host, rule, max_by(value, pos) FROM scoped WHERE rule = 'crawl-delay' AND agent = '*'
    AND try_cast(value AS DOUBLE) IS NOT NULL GROUP BY host, rule
  UNION ALL
  SELECT host, rule, value FROM scoped WHERE rule = 'sitemap'
)
"""


@query("robots_rules", f"WITH {_RULES_SQL} SELECT host, rule, value FROM rules")
def _robots_rules(spark, sf):
    return D.robots_rules(robots_files(spark, sf))


_ALLOWED_SQL = f"""
{_RULES_SQL}, ok AS (
  SELECT page_id, url FROM pages p WHERE NOT EXISTS (
    SELECT 1 FROM rules r WHERE r.rule = 'disallow' AND r.host = regexp_extract(p.url, '^[a-z]+://[^/?#]*')
      AND (r.value = '/' OR starts_with(regexp_extract(p.url, '^[a-z]+://[^/?#]*([^?#]*)', 1), r.value)))
)
"""


@query("robots_filter", f"WITH {_ALLOWED_SQL} SELECT page_id, url FROM ok")
def _robots_filter(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return D.robots_allowed(pages, D.robots_rules(robots_files(spark, sf)))


def sitemap_files(spark, sf) -> DataFrame:
    """Three sitemap levels per page: an index, an index of that index, and a list of two URLs."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("loc"))
    n = F.col("page_id").cast("string")
    index = lambda child: F.concat(
        F.lit(f'<?xml version="1.0"?><sitemapindex {_NS}><sitemap><loc>'),
        F.lit(child),
        n,
        F.lit("</loc><lastmod>2024-01-05</lastmod></sitemap></sitemapindex>"),
    )
    urls = F.concat(
        F.lit(f"<urlset {_NS}><url><loc>"),
        "loc",
        F.lit("</loc><priority>0."),
        (F.col("page_id") % 10).cast("string"),
        F.lit("</priority><lastmod>2024-01-05T10:20:30+02:00</lastmod></url><url><loc>"),
        "loc",
        F.lit("/docs/api/</loc><changefreq>daily</changefreq><priority>high</priority></url></urlset>"),
    )
    broken = F.concat(F.lit(f"<urlset {_NS}><url><loc>"), "loc", F.lit("</url>"))
    rows = F.array(
        F.struct(F.concat(F.lit("top-"), n).alias("sitemap"), index("mid-").alias("xml")),
        F.struct(F.concat(F.lit("mid-"), n).alias("sitemap"), index("low-").alias("xml")),
        F.struct(F.concat(F.lit("low-"), n).alias("sitemap"), urls.alias("xml")),
        F.struct(F.concat(F.lit("bad-"), n).alias("sitemap"), broken.alias("xml")),
    )
    return p.select(F.explode(rows).alias("f")).select("f.*")


_ENTRIES_SQL = """
  p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS loc FROM pages),
  entries AS (
    SELECT 'top-' || page_id AS sitemap, 'sitemap' AS kind, 'mid-' || page_id AS loc, CAST(NULL AS DOUBLE) AS priority,
      CAST(NULL AS VARCHAR) AS change_frequency, '2024-01-05 00:00:00' AS last_modified FROM p
    UNION ALL SELECT 'mid-' || page_id, 'sitemap', 'low-' || page_id, NULL, NULL, '2024-01-05 00:00:00' FROM p
    UNION ALL SELECT 'low-' || page_id, 'url', loc, CAST('0.' || page_id % 10 AS DOUBLE), NULL, '2024-01-05 08:20:30' FROM p
    UNION ALL SELECT 'low-' || page_id, 'url', loc || '/docs/api/', NULL, 'daily', NULL FROM p
  )
"""


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("last_modified", F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss"))


@query("sitemap_entries", f"WITH {_ENTRIES_SQL} SELECT * FROM entries")
def _sitemap_entries(spark, sf):
    return _shown(D.parse_sitemaps(sitemap_files(spark, sf)))


@query(
    "sitemap_expand",
    f"""
    WITH {_ENTRIES_SQL}, u AS (SELECT sitemap, loc AS url, priority, change_frequency, last_modified FROM entries
      WHERE kind = 'url'), start AS (SELECT 'top-' || page_id AS sitemap FROM p UNION ALL SELECT 'mid-' || page_id FROM p
      UNION ALL SELECT 'low-' || page_id FROM p)
    SELECT 'low-' || split_part(s.sitemap, '-', 2) AS sitemap,
      CAST(CASE split_part(s.sitemap, '-', 1) WHEN 'top' THEN 3 WHEN 'mid' THEN 2 ELSE 1 END AS INT) AS depth,
      url, priority, change_frequency, last_modified
    FROM start s JOIN u ON u.sitemap = 'low-' || split_part(s.sitemap, '-', 2)
    """,
)
def _sitemap_expand(spark, sf):
    files = sitemap_files(spark, sf)
    start = files.where(~F.col("sitemap").startswith("bad")).select("sitemap")
    return _shown(D.expand_sitemaps(start, D.parse_sitemaps(files), max_depth=3))


@query(
    "sitemaps_to_read",
    f"""
    WITH {_HOSTS_SQL}
    SELECT host, host || '/sitemap.xml' AS sitemap FROM hosts UNION ALL
    SELECT 'new.' || host, 'new.' || host || s FROM hosts,
      unnest(['/sitemap.xml', '/sitemap_index.xml', '/sitemaps.xml']) AS t(s)
    """,
)
def _sitemaps_to_read(spark, sf):
    files = robots_files(spark, sf)
    hosts = files.select("host").unionByName(files.select(F.concat(F.lit("new."), "host").alias("host")))
    return D.sitemaps_to_read(hosts, D.robots_rules(files))


@query(
    "lastmod_dates",
    """
    SELECT event_id, strftime(CASE event_id % 5 WHEN 0 THEN date_trunc('day', ts) WHEN 3 THEN
      date_trunc('second', ts) - INTERVAL 90 MINUTE WHEN 4 THEN NULL ELSE date_trunc('second', ts) END,
      '%Y-%m-%d %H:%M:%S') AS parsed FROM events
    """,
)
def _lastmod_dates(spark, sf):
    kind, ts = F.col("event_id") % 5, F.col("ts")
    text = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 3, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30")))
        .otherwise(F.date_format(ts, "dd/MM/yyyy"))
    )
    parsed = F.date_format(D.parse_lastmod(text), "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf, "events").select("event_id", parsed.alias("parsed"))


_URL_WORDS = ["en", "fr", "Example", "docs"]
_SCORE_SQL = (
    "round(least(("
    + " + ".join(f"CAST(contains(lower({{0}}), '{w.lower()}') AS INT)" for w in _URL_WORDS)
    + " + 0.5 * ("
    + " + ".join(f"CAST(regexp_matches(lower({{0}}), '{p}') AS INT)" for p in D.DOC_PATHS)
    + ")) / 4.0, 2.0), 6)"
)


@query("url_score", f"SELECT page_id, {_SCORE_SQL.format('url')} AS relevance_score FROM pages")
def _url_score(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return D.score_urls(pages, _URL_WORDS).select("page_id", F.round("relevance_score", 6).alias("relevance_score"))


@query(
    "url_rank",
    f"""
    WITH {_ALLOWED_SQL} SELECT url, {_SCORE_SQL.format('url')} AS relevance_score, round((page_id % 10) / 10.0, 6) AS priority
    FROM ok ORDER BY relevance_score DESC, priority DESC, url LIMIT 100
    """,
)
def _url_rank(spark, sf):
    pages = table(spark, sf, "pages").select("url", (F.col("page_id") % 10 / 10.0).alias("priority"))
    rules = D.robots_rules(robots_files(spark, sf))
    best = D.discover(pages, rules, _URL_WORDS, max_urls=100)
    return best.select("url", F.round("relevance_score", 6).alias("relevance_score"), F.round("priority", 6).alias("priority"))


@query(
    "url_path",
    "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages",
)
def _url_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", url_path("url").alias("path"))
