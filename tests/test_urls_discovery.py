from doclake.functions import urls as U
from doclake.operators import discovery as D

NS = f'xmlns="{D.SITEMAP_NAMESPACE}"'


def test_titles(one):
    assert one(U.url_title, "http://h/a/3d-x_y/?q=1#f") == "3D X Y"
    assert one(U.url_title, "https://h:80/") == "h:80"
    assert one(U.url_title, "https://h/straße") == "Straße"
    assert one(U.url_title, "https://h/o'neil") == "O'Neil"


def test_keys_and_parts(one):
    assert one(U.url_key, "http://a/b///") == "http://a/b"
    assert one(U.url_key, "//") == "//"
    assert one(U.base_url, "HTTPS://u@h:1/x") == "https://u@h:1"
    assert one(U.base_url, "h/x") == "://"
    assert one(U.normalize_scheme, "h/x") == "https://h/x"
    assert one(U.is_url, "mailto:x") is False


def robots(spark, *texts):
    return spark.createDataFrame([(f"http://h{i}", t) for i, t in enumerate(texts)], "host string, text string")


def test_stacked_agents_only_the_last_counts(spark):
    text = "User-agent: *\nUser-agent: other\nDisallow: /a\nSitemap: http://s\nUser-agent: *\nAllow: /\nDisallow: /b\nCrawl-delay: 2\nCrawl-delay: x"
    got = {(r["rule"], r["value"]) for r in D.robots_rules(robots(spark, text)).collect()}
    assert got == {("disallow", "/b"), ("crawl-delay", "2"), ("sitemap", "http://s")}
    mine = {(r["rule"], r["value"]) for r in D.robots_rules(robots(spark, text), agent="OTHER").collect()}
    assert ("disallow", "/a") in mine


def test_robots_filter(spark):
    rules = D.robots_rules(robots(spark, "User-agent: *\nDisallow: /p", "User-agent: *\nDisallow: /"))
    urls = spark.createDataFrame([(u,) for u in ("http://h0/p?x", "http://h0/q?/p", "http://h1", "http://h2/p")], "url string")
    assert {r["url"] for r in D.robots_allowed(urls, rules).collect()} == {"http://h0/q?/p", "http://h2/p"}


def test_sitemaps(spark):
    files = [
        ("top", f"<sitemapindex {NS}><sitemap><loc>mid</loc></sitemap><sitemap><loc>low</loc></sitemap></sitemapindex>"),
        ("mid", f"<sitemapindex {NS}><sitemap><loc>low</loc></sitemap></sitemapindex>"),
        ("low", f"<urlset {NS}><url><loc>u1</loc><priority>0.3</priority></url><url><loc>u2</loc><priority>bad</priority></url><url><lastmod>2024-01-01</lastmod></url></urlset>"),
        ("broken", f"<urlset {NS}><url><loc>u3</url>"),
        ("other", "<urlset><url><loc>u4</loc></url></urlset>"),
    ]
    entries = D.parse_sitemaps(spark.createDataFrame(files, "sitemap string, xml string"))
    urls = {(r["loc"], r["priority"]) for r in entries.where("kind = 'url'").collect()}
    assert urls == {("u1", 0.3), ("u2", None)}
    start = spark.createDataFrame([("top",)], "sitemap string")
    reached = D.expand_sitemaps(start, entries, 3).collect()
    assert sorted((r["url"], r["depth"]) for r in reached) == [("u1", 2), ("u1", 3), ("u2", 2), ("u2", 3)]
    chain = [(f"m{i}", "sitemap", f"m{i + 1}") for i in range(1, 6)] + [("m6", "sitemap", "m1"), ("m6", "url", "deep"), ("m1", "url", "top")]
    deep = D.expand_sitemaps(spark.createDataFrame([("m1",)], "sitemap string"), spark.createDataFrame(chain, "sitemap string, kind string, loc string"))
    assert sorted((r["url"], r["depth"]) for r in deep.collect()) == [("deep", 6), ("top", 1)]
    assert D.expand_sitemaps(start, entries, 1).count() == 0


def test_dates(one):
    assert str(one(D.parse_lastmod, "2024-1-5")) == "2024-01-05 00:00:00"
    assert str(one(D.parse_lastmod, "2024-01-05T01:02:03+0130")) == "2024-01-04 23:32:03"
    assert one(D.parse_lastmod, "5 Jan 2024") is None


def test_rank(spark):
    urls = spark.createDataFrame(
        [("http://x/docs/api/q", 0.1), ("http://x/b", 0.9), ("http://x/a", 0.9), ("http://x/b", 0.9)], "url string, priority double"
    )
    got = [r["url"] for r in D.discover(urls, None, ["api", "zzz"], 3).collect()]
    assert got == ["http://x/docs/api/q", "http://x/a", "http://x/b"]
    assert D.discover(urls, None, None, 10, dedupe=True).count() == 3


def test_one_host_with_many_rules_and_urls(spark):
    """All joins have full keys, and the rows of the one host are dealt over the tasks."""
    import random

    rng = random.Random(3)
    part = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    rules = [("http://h", "disallow", "/" + "/".join(part() for _ in range(rng.randint(1, 4)))) for _ in range(3000)]
    rules += [("http://other", "disallow", "/"), ("http://h", "sitemap", "/a")]
    urls = [("http://h/" + "/".join(part() for _ in range(rng.randint(1, 5))), i) for i in range(3000)]
    urls += [("http://other/x", 1), ("http://third/x", 2), ("http://h", 3), (urls[0][0], 4)]
    out = D.robots_allowed(spark.createDataFrame(urls, "url string, n int"), spark.createDataFrame(rules, "host string, rule string, value string"))
    paths = [v for h, r, v in rules if h == "http://h" and r == "disallow"]
    want = [(u, n) for u, n in urls if not u.startswith("http://other") and not (u.startswith("http://h/") and any(u[8:].startswith(p) for p in paths))]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    joins = [line for line in plan.split("Initial Plan")[-1].splitlines() if "Join" in line]
    assert len(joins) == 3 and not any("startswith" in line.lower() for line in joins)
