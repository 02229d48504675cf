"""Scalar URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import strip

#: RFC 3986, appendix B: scheme, authority, path.
SPLIT = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
#: Schemes whose last path segment may carry ``;parameters`` ('' = none given).
WITH_PARAMS = ("", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel")


def _clean(u: Column) -> Column:
    """What URL parsers drop first: leading control characters and blanks, tabs and line ends anywhere."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(u, F.lit("")), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def _malformed(u: Column) -> Column:
    """An authority with an unpaired bracket can't be parsed."""
    host = F.regexp_extract(u, SPLIT, 2)
    return host.contains("[") != host.contains("]")


def host_of(u: Column) -> Column:
    """Lower-case authority, with port and user; '' without one, for null, or if malformed."""
    x = _clean(u)
    return F.when(_malformed(x), F.lit("")).otherwise(F.lower(F.regexp_extract(x, SPLIT, 2)))


def canonicalize_url(u: Column) -> Column:
    """Lower-case authority plus path without trailing slashes; scheme, parameters, query and fragment are dropped.

    The path keeps its case; null gives ''. A malformed address falls back to its lower-case text.
    """
    x = _clean(u)
    path = F.regexp_extract(x, SPLIT, 3)
    bare = F.when(F.lower(F.regexp_extract(x, SPLIT, 1)).isin(*WITH_PARAMS), F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)
    joined = F.concat(F.lower(F.regexp_extract(x, SPLIT, 2)), F.regexp_replace(bare, r"/+$", ""))
    fallback = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(u, F.lit("")), r"(?U)^\s+|\s+$", "")), r"/+$", "")
    return F.when(_malformed(x), fallback).otherwise(joined)


def page_key(u: Column) -> Column:
    """One text per page, however its address is written; null where there is no address of a page.

    Letter case of scheme and host, the scheme itself, default ports, percent-encoded unreserved letters, doubled and
    trailing slashes, ``index.htm(l)``, fragments and tracking parameters (``utm_*``) make no difference; host, path and
    the other parameters (in order of their text) do.
    """
    # every step is taken only where the address shows a need for it
    x = F.substring_index(strip(F.coalesce(u, F.lit(""))), "#", 1)
    host = F.lower(F.regexp_extract(x, SPLIT, 2))
    host = F.when(host.contains(":"), F.regexp_replace(host, r":(80|443)$", "")).otherwise(host)
    host = F.when(host.endswith("."), F.regexp_replace(host, r"\.$", "")).otherwise(host)
    path = F.regexp_extract(x, SPLIT, 3)
    path = F.when(path.contains("%"), F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)).otherwise(path)
    path = F.when(path.contains("//"), F.regexp_replace(path, r"/{2,}", "/")).otherwise(path)
    path = F.when(F.lower(path).contains("/index.htm"), F.regexp_replace(path, r"/(?i:index\.html?)$", "")).otherwise(path)
    path = F.when(path.endswith("/"), F.regexp_replace(path, r"/+$", "")).otherwise(path)
    at = F.locate("?", x)
    kept = F.array_sort(F.filter(F.split(F.when(at > 0, F.substr(x, at + 1)), "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_")))
    query = F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when((host != "") & ((path != "") | (query != "")), F.concat(host, path, query))


def api_second_url(u: Column, base: str) -> Column:
    """Address of a second look-up, built from the last two path segments as ``base + origin,name``; null if fewer."""
    parts = F.split(F.regexp_replace(u, r"/+$", ""), "/")
    return F.when(F.size(parts) >= 2, F.concat(F.lit(base), F.element_at(parts, -2), F.lit(","), F.element_at(parts, -1)))
