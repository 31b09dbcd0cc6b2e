"""URL columns, split by pattern so that malformed input gives blanks instead of errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdictlake.functions.labels import text

# Query parameters that only track visitors.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid",
    "_ga", "_gid", "_hsenc", "_hsmi",
    "ref", "referrer", "source",
)
# Fixed value: what counts as a URL inside text.
URL_PATTERN = r'https?://[^\s<>"{}|\\^`\[\]]+'


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def is_web_url(url: Column | str) -> Column:
    u = text(url)
    return scheme(u).isin("http", "https") & (host(u) != "")


def domain_name(url: Column) -> Column:
    return F.replace(host(url), F.lit("www."), F.lit(""))


def last_segment(url: Column) -> Column:
    """Last non-blank part of the path, null when there is none."""
    return F.nullif(F.regexp_extract(path(url), r"([^/]+)/*$", 1), F.lit(""))


def is_pdf_url(url: Column | str) -> Column:
    """The URL looks like a PDF by its path."""
    u = F.lower(text(url))
    p = path(u)
    return p.endswith(".pdf") | p.contains("/pdf/") | p.endswith(".pdf/") | u.contains("arxiv.org/pdf/")


def is_pdf_url_simple(url: Column | str) -> Column:
    """The shorter test used when fetches are planned: case-sensitive, on the whole URL."""
    u = text(url)
    return u.endswith(".pdf") | u.contains("/pdf/")


def is_pdf_href(href: Column | str) -> Column:
    h = F.lower(text(href))
    return h.endswith(".pdf") | h.contains("/pdf/") | h.contains(".pdf?") | h.endswith(".pdf/")


def _recode(part: Column) -> Column:
    """Decode and encode again, so equal parameters are spelled alike."""
    decoded = F.coalesce(F.try_url_decode(part), part)
    encoded = F.replace(F.url_encode(decoded), F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column | str) -> Column:
    """URL without fragment and tracking parameters; equal parameter names are put together."""
    u = text(url)
    parts = F.filter(F.split(query_string(u), "&"), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(
        _recode(F.substring_index(p, "=", 1)).alias("k"),
        F.when(p.contains("="), _recode(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING))
    # Order by where the name first appears, then by place among its repeats.
    placed = F.transform(kept, lambda p, i: F.struct(
        F.array_position(F.transform(kept, lambda q: q["k"]), p["k"]).alias("first"), i.alias("i"),
        F.concat(p["k"], F.lit("="), p["v"]).alias("t")))
    joined = F.array_join(F.transform(F.sort_array(placed), lambda p: p["t"]), "&")
    query = F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")
    lowered = F.concat(scheme(u), F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*(:[^?#]*)", 1))
    base = F.when(scheme(u) != "", lowered).otherwise(F.regexp_extract(u, r"^([^?#]*)", 1))
    return F.concat(base, query)


def resolve(href: Column, base: Column) -> Column:
    """Absolute form of a link found on a page."""
    page = F.regexp_extract(base, r"^([^#]*)", 1)
    no_query = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.concat(origin(base), F.regexp_extract(path(base), r"^(.*/)", 1))
    folder = F.when(path(base) == "", F.concat(origin(base), F.lit("/"))).otherwise(folder)
    whole = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin(base), href))
        .when(href.startswith("?"), F.concat(no_query, href))
        .when(href.startswith("#"), F.concat(page, href))
        .when(href == "", page)
        .otherwise(F.concat(folder, href))
    )
    # `.` and `..` are taken out of the path of a web address.
    place = F.regexp_extract(whole, r"^https?://[^/?#]*(/[^?#]*)", 1)
    steps = F.aggregate(
        F.split(place, "/"), F.array().cast("array<string>"),
        lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(s == ".", kept).otherwise(
            F.concat(kept, F.array(s))))
    closed = F.when(place.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    plain = F.concat(
        F.regexp_extract(whole, r"^(https?://[^/?#]*)", 1), F.array_join(steps, "/"), closed, F.regexp_extract(whole, r"^[^?#]*(.*)$", 1))
    return F.when(place.rlike(r"/\.\.?(/|$)"), plain).otherwise(whole)
