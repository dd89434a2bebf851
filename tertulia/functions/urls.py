"""URL column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

URL = r"https?://[^\s]+"
_SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def find_urls(text) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(URL), F.lit(0))


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), _SHAPE, 1))


def host(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), _SHAPE, 2))


def full_path(url) -> Column:
    return F.regexp_extract(_c(url), _SHAPE, 3)


def query(url) -> Column:
    return F.regexp_extract(_c(url), _SHAPE, 4)


def fragment(url) -> Column:
    return F.regexp_extract(_c(url), _SHAPE, 5)


def path_params(url) -> Column:
    """Parameters of the last path segment, after its semicolon."""
    return F.regexp_extract(full_path(url), r"(?s);([^/]*)$", 1)


def path(url) -> Column:
    return F.regexp_replace(full_path(url), r"(?s);[^/]*$", "")


def path_parts(url) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def decode(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


def query_map(url) -> Column:
    """First value of each query key; blank values are left out."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: F.regexp_like(p, F.lit("^[^=]+=.+")))
    entries = F.transform(pairs, lambda p: F.struct(decode(F.regexp_extract(p, "^([^=]+)=", 1)).alias("k"), decode(F.regexp_extract(p, "^[^=]+=(.*)$", 1)).alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(entries, lambda e: e["k"] == k), F.lit(0))["v"]))


def param(query_text, key: str) -> Column:
    """First non-blank value of a query key, empty when there is none."""
    return decode(F.regexp_extract(_c(query_text), rf"(?:^|&){key}=([^&]+)", 1))


def normalize_domain(domain) -> Column:
    d = F.regexp_replace(_c(domain), r"^www\.", "")
    return F.get(F.split(F.regexp_replace(d, r"^https?://", ""), "/"), F.lit(0))
