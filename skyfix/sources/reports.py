"""Facts from report pages by regular expressions on a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most links, dates and numbers kept of a page.
MOST_LINKS, MOST_TAGS = 12, 8


def scraped(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, language, first links and headings, and the length of the visible text."""
    one = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit(""))
    many = lambda p, n: F.slice(F.array_distinct(F.regexp_extract_all(html, F.lit(p), F.lit(1))), 1, n)
    return pages.withColumns({
        "title": one("(?s)<title>(.*?)</title>"), "lang": one('<html lang="([a-z]+)"'), "links": many('href="([^"]*)"', MOST_LINKS),
        "classes": many('class="([^"]*)"', MOST_TAGS), "n_text": F.length(visible(F.col(html))).cast("long"),
    })


def visible(html: Column) -> Column:
    without = F.regexp_replace(html, r"(?s)<(script|style)>.*?</(script|style)>|<[^>]*>", " ")
    return F.trim(F.regexp_replace(without, r"[ \n\r\t]+", " "))
