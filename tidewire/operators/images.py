"""Images of items: the feed's own, the article page's, a drawn tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import constants as C
from tidewire.functions.text import og_image, tile_svg, tile_url
from tidewire.session import small


def missing(items: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Items of the window without an image of their own."""
    return items.filter((F.col("published_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")) & ((F.col("image_url") == "") | (F.col("image_kind") == "tile")))


def bare() -> Column:
    return (F.col("image_url") == "") | (F.col("image_kind") == "tile")


def asks(items: DataFrame, cache: DataFrame, budget: int) -> DataFrame:
    """canonical_url, id of the pages to look at: the first ``budget`` by id of items without an image, whose page was not looked at before and whose source allows it."""
    new = items.filter(bare() & ~F.col("no_scrape")).join(cache.select("canonical_url"), "canonical_url", "left_anti")
    return new.select("canonical_url", "id").orderBy("id").limit(budget)


def looked(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """canonical_url, image_url of pages that were looked at; empty for those that told no image or nothing at all."""
    return asked.select("canonical_url").join(pages.select("canonical_url", og_image(F.coalesce("html", F.lit(""))).alias("og")), "canonical_url", "left").select("canonical_url", F.coalesce("og", F.lit("")).alias("image_url"))


def forbidden(items: DataFrame, cache: DataFrame) -> DataFrame:
    """canonical_url, image_url (empty) of items whose source forbids to look, as far as the cache lacks them."""
    new = items.filter(bare() & F.col("no_scrape")).join(cache.select("canonical_url"), "canonical_url", "left_anti")
    return new.select("canonical_url", F.lit("").alias("image_url"))


def assign(items: DataFrame, cache: DataFrame) -> DataFrame:
    """id, image_url, image_kind (feed, og or tile): an item's own image, that of its page as the cache has it, else a tile."""
    known = items.join(cache.select("canonical_url", F.nullif("image_url", F.lit("")).alias("cached")), "canonical_url", "left")
    url = F.when(~bare(), F.col("image_url")).otherwise(F.coalesce("cached", tile_url(F.col("id"), F.col("source_name"), F.col("topic"))))
    kind = F.when(~bare(), F.col("image_kind")).when(F.col("cached").isNotNull(), "og").otherwise("tile")
    return known.select("id", url.alias("image_url"), kind.alias("image_kind"))


def backfill(items: DataFrame, cache: DataFrame, pages: DataFrame, budget: int) -> DataFrame:
    """id, image_url, image_kind, with ``pages`` (canonical_url, html) at hand.

    ``cache``: canonical_url, image_url of pages looked at before, misses with an empty image.
    """
    return assign(items, cache.select("canonical_url", "image_url").unionByName(looked(asks(items, cache, budget), pages)))


def export_path(url: Column, item: Column) -> Column:
    """A tile's place in a static export; other URLs stay."""
    return F.when(url.startswith("/tile/"), F.concat(F.lit("tiles/"), item, F.lit(".svg"))).otherwise(url)


def tiles(items: DataFrame, sources: DataFrame, as_of: Column, days: int = C.ARCHIVE_DAYS) -> DataFrame:
    """file, svg: the tiles that a static copy needs."""
    known = small(sources.select(F.col("key").alias("source_key"), F.col("name").alias("source_name")))
    rows = items.filter((F.col("published_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col("image_kind") == "tile")).join(known, "source_key")
    return rows.select(F.concat(F.lit("tiles/"), "id", F.lit(".svg")).alias("file"), tile_svg(F.col("id"), F.col("source_name"), F.col("topic")).alias("svg"))
