"""Links, ids and text blocks of stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import links as L
from ..functions import text as X
from ..functions.fixed_values import RESERVED_PAGE_ID
from .frames import compute_once

_HREF = r'href="([^"]*)"'
_BLOCK = r"(?s)<p[^>]*>(.*?)</p>"


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, href, link: every link, resolved against its page."""
    found = F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)))
    return pages.select("page_id", "url", found.alias("href")).select(
        "page_id", "href", L.absolute_link("href", "url").alias("link")
    )


def link_ids(pages: DataFrame) -> DataFrame:
    """page_id, id: distinct ids picked from the links of each page, the reserved one left out."""
    links = page_links(pages).select("page_id", "link")
    return (
        compute_once(links, "id", L.page_id("link"))
        .select("page_id", "id")
        .filter(F.col("id").isNotNull() & (F.col("id") != RESERVED_PAGE_ID))
        .distinct()
    )


def post_ids(pages: DataFrame) -> DataFrame:
    """page_id, id: distinct post ids (``sid=``) of each page's links."""
    links = page_links(pages).select("page_id", "link")
    found = compute_once(links, "id", L.post_id("link")).select("page_id", "id")
    return found.filter(F.col("id").isNotNull()).distinct()


def comment_links(pages: DataFrame) -> DataFrame:
    """page_id, token, post, number: distinct comment tokens (``ctoken=``) of each page's links, with the
    post (first half) and the comment's number (second half)."""
    links = page_links(pages).select("page_id", "link")
    found = compute_once(links, "token", L.comment_token("link")).select("page_id", "token")
    return found.filter(F.col("token").isNotNull()).distinct().select(
        "page_id", "token", F.split_part("token", F.lit("_"), F.lit(1)).alias("post"), L.comment_number("token").alias("number")
    )


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, block: trimmed, non-blank text blocks, each once a page.

    A block's copies within a page are removed inside the row, so no shuffle is needed.
    """
    raw = F.regexp_extract_all("html", F.lit(_BLOCK), F.lit(1))
    blocks = F.array_distinct(
        F.filter(F.transform(raw, X.strip), lambda b: b != "")
    )
    return pages.select("page_id", F.explode(blocks).alias("block"))
