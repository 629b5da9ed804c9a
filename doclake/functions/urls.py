"""URL expressions. All are native column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions.patterns import column

# Leading C0 controls and blanks are dropped, tabs and line ends are removed anywhere.
_JUNK = r"^[\x00-\x20]+|[\t\r\n]"
_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_PARAMS = r";[^/]*$"


def _plain(url) -> Column:
    return F.regexp_replace(column(url), _JUNK, "")


def url_scheme(url) -> Column:
    return F.lower(F.regexp_extract(_plain(url), _SCHEME, 1))


def url_netloc(url) -> Column:
    """Host part with port and user info (``parse_url(..., 'HOST')`` drops both)."""
    return F.regexp_extract(_plain(url), _AUTHORITY, 1)


def url_path(url) -> Column:
    return F.regexp_replace(F.regexp_extract(_plain(url), _PATH, 1), _PARAMS, "")


def normalize_scheme(url) -> Column:
    """Add ``https://`` where neither http nor https is given."""
    u = column(url)
    return F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), u))


def base_url(url) -> Column:
    """``scheme://netloc``."""
    return F.concat(url_scheme(url), F.lit("://"), url_netloc(url))


def url_key(url) -> Column:
    """Key for duplicate detection: all trailing slashes removed, unless nothing would be left."""
    u = column(url)
    return F.coalesce(F.nullif(F.rtrim(u, F.lit("/")), F.lit("")), u)


def title_case(c) -> Column:
    """Upper-case the first letter of every run of cased letters, lower-case the rest (``3d-x`` becomes ``3D-X``)."""
    runs = F.regexp_extract_all(column(c), F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def url_title(url) -> Column:
    """Readable title: last path segment with ``-`` and ``_`` as blanks, in title case; without a path the host."""
    segment = F.element_at(F.split(F.trim(url_path(url), F.lit("/")), "/"), -1)
    words = title_case(F.translate(segment, "-_", "  "))
    return F.coalesce(F.nullif(words, F.lit("")), url_netloc(url))


def is_url(url) -> Column:
    """Scheme and host are both present."""
    return F.coalesce((url_scheme(url) != "") & (url_netloc(url) != ""), F.lit(False))


def page_title(title, url) -> Column:
    """The page's own title, else one made from its URL."""
    t = column(title)
    return F.when(t.isNull() | (t == ""), url_title(url)).otherwise(t)
