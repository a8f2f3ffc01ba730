"""Column expressions that read an archived article URL.

An archived URL looks like
``<scheme>://<archive host>/<a>/<b>/<capture yyyymmddhhmmss>/<scheme>://<outlet host>/<path>``.
Split on ``/`` its parts are addressed 0-based; too-short URLs give null parts, never errors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 0-based positions of the '/'-separated parts of an archived URL.
CAPTURE_PART = 5  # capture time stamp, yyyymmdd...
ORIGINAL_FROM = 6  # the original URL starts here (scheme included)
HOST_PART = 8  # the outlet host


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_parts(url) -> Column:
    return F.split(_col(url), "/")


def url_segment(url, i: int) -> Column:
    """Part ``i`` (0-based) of the URL split on '/', null when the URL is shorter."""
    return F.get(url_parts(url), F.lit(i))


def capture_stamp(url) -> Column:
    return url_segment(url, CAPTURE_PART)


def capture_month(url) -> Column:
    """Capture month as ``YYYY/MM``."""
    s = capture_stamp(url)
    return F.concat(F.substring(s, 1, 4), F.lit("/"), F.substring(s, 5, 2))


def capture_date(url) -> Column:
    """Capture day as ``YYYY-MM-DD``."""
    s = capture_stamp(url)
    return F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 2), F.lit("-"), F.substring(s, 7, 2))


def capture_order(url) -> Column:
    """Capture time stamp as a number, for ordering; null when absent or not numeric."""
    return capture_stamp(url).try_cast("bigint")


def original_url(url) -> Column:
    """The unarchived URL: parts 6 and later joined again; null when there are none."""
    parts = url_parts(url)
    rest = F.slice(parts, ORIGINAL_FROM + 1, F.greatest(F.size(parts) - ORIGINAL_FROM, F.lit(0)))
    return F.nullif(F.array_join(rest, "/"), F.lit(""))


def outlet_host(url) -> Column:
    """Outlet host with every ``www.`` removed."""
    return F.replace(url_segment(url, HOST_PART), F.lit("www."), F.lit(""))


def url_slug(url) -> Column:
    """Last non-empty part: the last one, or the one before it when the URL ends in '/'."""
    parts = url_parts(url)
    last = F.element_at(parts, -1)
    return F.when(last != F.lit(""), last).otherwise(F.try_element_at(parts, F.lit(-2)))


def clean_title(slug) -> Column:
    """Slug cut at the first '?', then at the first '_', without a leading ``dddd-dd-dd-``."""
    s = F.substring_index(F.substring_index(_col(slug), "?", 1), "_", 1)
    return F.regexp_replace(s, r"^\d{4}-\d{2}-\d{2}-", "")


def article_title(url) -> Column:
    """Display title and de-duplication key of an article.

    A clean title containing '-' is lower-cased; otherwise the raw slug is kept.
    """
    slug = url_slug(url)
    clean = clean_title(slug)
    return F.when(clean.contains("-"), F.lower(clean)).otherwise(slug)
