"""Items of stored web pages. Patterns are parameters: each site has its own."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nosoflow.functions.text import absolute_link, html_text

# Fixed value: items read per page.
MAX_ITEMS = 50


@dataclass(frozen=True)
class ItemPatterns:
    """Regular expressions, one group each. ``item`` is applied to the page, the others to one item."""

    item: str
    link: str
    title: str
    iso_date: str | None = None
    shown_date: str | None = None
    lead: str | None = None


# Markup of the list of news.
NEWS = ItemPatterns(
    item=r'(?s)<li class="item-news">(.*?)</li>',
    link=r'<a class="link-news" href="([^"]+)"',
    title=r'(?s)<h4 class="title-news">(.*?)</h4>',
    iso_date=r'class="date-display-single"[^>]*content="([^"]+)"',
    shown_date=r'<span class="date-display-single"[^>]*>([^<]+)</span>',
    lead=r'(?s)<h4 class="title-news">.*?</h4>\s*<p>(.*?)</p>',
)


def page_items(
    pages: DataFrame, key: str, html: str, patterns: ItemPatterns, base: str, max_items: int = MAX_ITEMS
) -> DataFrame:
    """First ``max_items`` items of each page, in page order; items without link or title are skipped."""
    blocks = F.slice(F.regexp_extract_all(F.col(html), F.lit(patterns.item), F.lit(1)), 1, max_items)
    rows = pages.select(key, F.posexplode(blocks).alias("rang", "_block"))
    block = F.col("_block")
    rows = rows.where(block.rlike(patterns.link) & block.rlike(patterns.title))

    def group(pattern: str | None) -> Column:
        return F.regexp_extract(block, pattern, 1) if pattern else F.lit("")

    return rows.select(
        key,
        (F.col("rang") + 1).cast("bigint").alias("rang"),
        F.substring(group(patterns.iso_date), 1, 10).alias("date_iso"),
        html_text(group(patterns.shown_date)).alias("date_affichee"),
        html_text(group(patterns.title)).alias("titre"),
        html_text(group(patterns.lead)).alias("chapo"),
        absolute_link(group(patterns.link), base).alias("url"),
    )


def items_per_page(pages: DataFrame, key: str, html: str, patterns: ItemPatterns) -> DataFrame:
    """Number of item blocks found on each page; zero tells that its structure changed."""
    return blocks_per_page(pages, key, html, {"n_blocs": patterns})


def blocks_per_page(pages: DataFrame, key: str, html: str, kinds: Mapping[str, ItemPatterns]) -> DataFrame:
    """Item blocks of several kinds on each page, one column per kind, in one pass."""
    return pages.select(key, *[F.regexp_count(F.col(html), F.lit(p.item)).cast("bigint").alias(name) for name, p in kinds.items()])


def unrecognised_pages(pages: DataFrame, key: str, html: str, patterns: ItemPatterns) -> DataFrame:
    """Pages without any complete item, with the reason: no block at all, or blocks that lack link or title."""
    blocks = F.regexp_extract_all(F.col(html), F.lit(patterns.item), F.lit(1))
    complete = F.exists(blocks, lambda b: b.rlike(patterns.link) & b.rlike(patterns.title))
    reason = F.when(F.col(html).isNull() | (F.size(blocks) == 0), F.lit("structure de page non reconnue")).otherwise(F.lit("blocs incomplets"))
    return pages.where(F.col(html).isNull() | ~complete).select(key, reason.alias("erreur"))
