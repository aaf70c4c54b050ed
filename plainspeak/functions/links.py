"""Functions on addresses: pick ids out of links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _part(text: Column, delimiter: str, number: int) -> Column:
    """n-th piece between delimiters; NULL when there are fewer."""
    piece = F.split_part(text, F.lit(delimiter), F.lit(number))
    return F.nullif(piece, F.lit(""))


def absolute_link(href: Column | str, page_url: Column | str) -> Column:
    """Resolve a root-relative link against the page it stands on."""
    href, page_url = _column(href), _column(page_url)
    site = F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    return F.when(href.startswith("/") & ~href.startswith("//"), F.concat(site, href)).otherwise(href)


def page_id(link: Column | str) -> Column:
    """First path segment, query cut off."""
    return _part(_part(_column(link), "/", 4), "?", 1)


def post_id(link: Column | str) -> Column:
    """Value after ``sid=``."""
    return _part(_part(_column(link), "sid=", 2), "&", 1)


def comment_token(link: Column | str) -> Column:
    """Value after ``ctoken=``."""
    return _part(_part(_column(link), "ctoken=", 2), "&", 1)


def comment_number(token: Column | str) -> Column:
    """Second half of a comment token."""
    return _part(_column(token), "_", 2)


def search_terms(phrase: Column | str) -> Column:
    """Words joined by plus signs, as in a search address."""
    parts = F.filter(F.split(_column(phrase), r"\s+"), lambda w: w != "")
    return F.array_join(parts, "+")
