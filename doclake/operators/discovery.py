"""URL candidates from tables of fetched robots and sitemap files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.patterns import BLANK, column, jvm, let, strip
from doclake.functions.text import keyword_hits
from doclake.functions.urls import base_url, url_path
from doclake.session import stored

# Path parts that mark documentation, file names tried for a site without a sitemap line.
DOC_PATHS = [r"/docs?/", r"/guide/", r"/tutorial/", r"/api/", r"/reference/", r"/help/"]
COMMON_SITEMAPS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemaps.xml"]
SITEMAP_NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
# Date forms accepted in sitemaps.
DATE_FORMATS = ["yyyy-M-d", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s'Z'", "yyyy-M-d'T'H:m:sXXX", "yyyy-M-d'T'H:m:sXX"]
DATE_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}(T\d{1,2}:\d{1,2}:\d{1,2}(Z|[+\-]\d{2}:?\d{2})?)?$"


def robots_rules(df: DataFrame, agent: str = "*") -> DataFrame:
    """Rules of robots files (host, text) as rows (host, rule, value).

    A file is cut at its user-agent lines; each of them decides alone whether the lines up to the next one apply.
    ``Allow`` lines mean nothing, comment lines are skipped, sitemap lines always count, the last valid crawl delay
    wins. Everything happens inside the row that holds the file.
    """
    sections = F.split(F.concat(F.lit("\n"), F.col("text")), jvm(rf"\n[{BLANK}]*user-agent:", "i"), -1)

    def parse(section: Column, i: Column) -> Column:
        lines = F.transform(F.split(section, "\n", -1), strip)
        name = F.lower(F.get(lines, 0))
        applies = (i > 0) & ((name == "*") | (name == agent.lower()))
        body = F.filter(F.when(i > 0, F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines), lambda x: ~x.startswith("#"))

        def rule(x: Column) -> Column:
            kind = F.lower(F.regexp_extract(x, jvm(r"^(disallow|crawl-delay|sitemap):", "i"), 1))
            value = strip(F.regexp_replace(x, r"\A[^:]*:", ""))
            return F.struct(kind.alias("rule"), value.alias("value"))

        wanted = lambda r: (
            (r["rule"] == "sitemap")
            | (applies & (r["rule"] == "disallow") & (r["value"] != ""))
            | (applies & (r["rule"] == "crawl-delay") & r["value"].try_cast("double").isNotNull())
        )
        return F.filter(F.transform(body, rule), wanted)

    def tidy(rules: Column) -> Column:
        of = lambda kind: F.filter(rules, lambda r: r["rule"] == kind)
        delay = of("crawl-delay")
        return F.concat(F.array_distinct(of("disallow")), F.slice(delay, F.greatest(F.size(delay), F.lit(1)), 1), of("sitemap"))

    rules = let(F.flatten(F.transform(sections, parse)), tidy)
    return df.select("host", F.explode(rules).alias("_r")).select("host", "_r.rule", "_r.value")


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs whose path starts with no disallowed prefix of their host; "/" forbids everything.

    A path is cut to the lengths that the rules of its host have, and each beginning is looked up by host and text, so every
    join has a full key: a host with many rules and URLs is no list to walk through, and its rows are dealt by their paths.
    """
    path = F.when(F.col("value") == "/", "").otherwise(F.col("value"))
    banned = rules.where(F.col("rule") == "disallow").select(F.col("host").alias("_site"), path.alias("_beginning")).distinct()
    # One row per host, with as many numbers as its rules have different lengths.
    lengths = banned.groupBy("_site").agg(F.collect_set(F.length("_beginning")).alias("_lengths"))
    keyed = urls.withColumn("_site", base_url("url")).withColumn("_url_path", url_path("url"))
    paths = keyed.select("_site", "_url_path").where(F.col("_url_path").isNotNull()).distinct().join(lengths, "_site")
    fitting = F.filter("_lengths", lambda n: n <= F.length("_url_path"))
    beginnings = paths.select("_site", "_url_path", F.explode(fitting).alias("_n")).select(
        "_site", "_url_path", F.substring("_url_path", F.lit(1), F.col("_n")).alias("_beginning")
    )
    blocked = beginnings.join(banned, ["_site", "_beginning"], "left_semi").select("_site", "_url_path").distinct()
    return keyed.join(blocked, ["_site", "_url_path"], "left_anti").select(*urls.columns)


def parse_lastmod(c) -> Column:
    """Timestamp from one of four date forms, else NULL."""
    text = column(c)
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])
    return F.when(text.rlike(DATE_SHAPE), parsed)


def parse_sitemaps(df: DataFrame) -> DataFrame:
    """Entries of sitemap files (sitemap, xml): kind ("url" or "sitemap"), loc, priority, changefreq, lastmod.

    Files that are no XML, or whose root declares another namespace, contribute no rows; a bad priority is NULL.
    """
    entry = "struct<loc:string,lastmod:string,changefreq:string,priority:string>"
    shape = f"struct<url:array<{entry}>,sitemap:array<{entry}>>"
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "rowTag": "urlset"}
    root = F.regexp_extract("xml", r"(?s)\A\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*<(?:[\w.\-]+:)?(\w+)", 1)
    plain = F.regexp_replace("xml", r"(?s)\A\s*(?:<\?.*?\?>\s*)", "")
    parsed = df.where(F.col("xml").contains(SITEMAP_NAMESPACE)).select(
        "sitemap", root.alias("_root"), F.from_xml(plain, shape, options).alias("_x")
    )
    tagged = lambda field, kind: F.transform(
        F.coalesce(F.col("_x")[field], F.array().cast(f"array<{entry}>")),
        lambda e: F.struct(F.lit(kind).alias("kind"), e.alias("e")),
    )
    entries = F.when(F.col("_root").endswith("sitemapindex"), tagged("sitemap", "sitemap")).when(
        F.col("_root").endswith("urlset"), tagged("url", "url")
    )
    rows = parsed.select("sitemap", F.explode(entries).alias("_e"))
    priority = F.when(F.col("_e.e.priority").isNull(), 1.0).otherwise(F.col("_e.e.priority").try_cast("double"))
    return rows.where(F.col("_e.e.loc").isNotNull()).select(
        "sitemap",
        "_e.kind",
        F.col("_e.e.loc").alias("loc"),
        F.when(F.col("_e.kind") == "url", priority).alias("priority"),
        F.col("_e.e.changefreq").alias("change_frequency"),
        parse_lastmod("_e.e.lastmod").alias("last_modified"),
    )


def expand_sitemaps(start: DataFrame, entries: DataFrame, max_depth: int | None = None) -> DataFrame:
    """URLs reachable from the start sitemaps (column ``sitemap``) through sitemap files, with the depth of each file.

    Levels are followed until one names no file that was not seen before; a file counts at the first level that names it, so
    files that name each other end the search. With ``max_depth`` exactly that many levels are followed instead, and a file
    named at several levels counts at each.
    """
    children = entries.where(F.col("kind") == "sitemap").select("sitemap", F.col("loc").alias("child"))
    level = start.select("sitemap").withColumn("depth", F.lit(1))
    named = lambda depth: level.join(children, "sitemap").select(F.col("child").alias("sitemap"), F.lit(depth).alias("depth"))
    if max_depth is not None:
        levels = [level]
        for depth in range(2, max_depth + 1):
            level = named(depth)
            levels.append(level)
        reached = reduce(DataFrame.unionByName, levels)
    else:
        level, depth = stored(level.distinct(), "sitemap-level"), 1
        reached = level
        while not level.isEmpty():
            # Each level is written before the next is asked for, so plans do not grow with the depth.
            depth += 1
            level = stored(named(depth).distinct().join(reached, "sitemap", "left_anti"), "sitemap-level")
            reached = reached.unionByName(level)
    urls = entries.where(F.col("kind") == "url").drop("kind").withColumnRenamed("loc", "url")
    return reached.join(urls, "sitemap")


def sitemaps_to_read(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Sitemaps named by each host's robots file, or the usual names where it names none."""
    named = rules.where(F.col("rule") == "sitemap").select("host", F.col("value").alias("sitemap"))
    guesses = F.explode(F.array(*[F.concat("host", F.lit(p)) for p in COMMON_SITEMAPS]))
    return named.unionByName(hosts.select("host").join(named, "host", "left_anti").select("host", guesses.alias("sitemap")))


def url_score(url, keywords: list[str] | None) -> Column:
    """Keyword matches plus half a point for each documentation path part, per keyword, at most 2."""
    if not keywords:
        return F.lit(1.0)
    low = F.lower(column(url))
    paths = reduce(lambda a, b: a + b, [low.rlike(p).cast("int") for p in DOC_PATHS])
    return F.least((keyword_hits(url, keywords) + paths * F.lit(0.5)) / F.lit(float(len(keywords))), F.lit(2.0))


def score_urls(df: DataFrame, keywords: list[str] | None) -> DataFrame:
    return df.withColumn("relevance_score", url_score("url", keywords))


def discover(
    urls: DataFrame,
    rules: DataFrame | None = None,
    keywords: list[str] | None = None,
    max_urls: int | None = None,
    dedupe: bool = False,
) -> DataFrame:
    """Allowed URLs, best first, at most ``max_urls`` where that is given. Ties are broken by URL."""
    allowed = robots_allowed(urls, rules) if rules is not None else urls
    if dedupe:
        allowed = allowed.dropDuplicates(["url"])
    ranked = score_urls(allowed, keywords)
    ordered = ranked.orderBy(F.desc("relevance_score"), F.desc_nulls_last("priority"), "url")
    return ordered if max_urls is None else ordered.limit(max_urls)
