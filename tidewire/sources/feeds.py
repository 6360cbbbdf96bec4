"""Feeds: a raw log of responses, its XML as rows, and the batch source that fills the log."""

from __future__ import annotations

import html
import re
import time
from collections.abc import Iterator
from datetime import datetime, timezone
from hashlib import sha256
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidewire import constants as C
from tidewire.functions import text as X
from tidewire.functions.numeric import parse_date
from tidewire.operators.merge import clamp_future
from tidewire.session import small
from tidewire.sources.http import PoliteReader

RAW = "feed_url string, fetched_at timestamp, status int, etag string, last_modified string, sha256 string, body binary"
ENTRY = "feed_url string, fetched_at timestamp, position int, title string, link string, guid string, teaser string, date string, categories array<string>, author string, images array<struct<width:int,url:string>>"

_IMG, _SRCSET = (re.compile(p, re.I) for p in (C.IMAGE_TAG, C.IMAGE_SET))
_EXTENSION = re.compile(C.IMAGE_EXTENSION)


def _tag(node: ElementTree.Element) -> str:
    """The local name with a short prefix for the name spaces that matter: media:, dc:, content:, atom:."""
    space, _, name = node.tag.rpartition("}") if isinstance(node.tag, str) else ("", "", "")
    known = {"{http://search.yahoo.com/mrss/": "media:", "{http://purl.org/dc/elements/1.1/": "dc:", "{http://purl.org/rss/1.0/modules/content/": "content:", "{http://www.w3.org/2005/Atom": "atom:"}
    return known.get(space, "") + name


def _words(node: ElementTree.Element | None) -> str:
    return "".join(node.itertext()).strip() if node is not None else ""


def _first(by: dict[str, list], *names: str) -> str:
    """The first text that isn't empty among the children so named, in this order."""
    return next((t for n in names for node in by.get(n, []) if (t := _words(node))), "")


def _link(by: dict[str, list]) -> str:
    for node in by.get("link", [])[:1]:
        if found := _words(node) or (node.get("href") or "").strip():
            return found
    links = [(n.get("rel") or "alternate", (n.get("href") or "").strip()) for n in by.get("atom:link", [])]
    links = [x for x in links if x[1]]
    best = next((h for rel, h in links if rel == "alternate"), links[0][1] if links else "")
    guid = _first(by, "guid")
    return best or (guid if guid.startswith("http") else "")


def _images(by: dict[str, list]) -> list[dict]:
    found = []
    for node in (*by.get("media:content", []), *by.get("media:thumbnail", [])):
        kinds = ((node.get("medium") or "image").lower() == "image", (node.get("type") or "image").lower().startswith("image"))
        width = node.get("width") or "0"
        if node.get("url") and all(kinds):
            found.append((int(width) if width.isdigit() else 0, node.get("url").strip()))
    for node in by.get("enclosure", []):
        url = (node.get("url") or "").strip()
        if url and ((node.get("type") or "").lower().startswith("image") or _EXTENSION.search(url)):
            found.append((0, url))
    for node in (*by.get("atom:link", []), *by.get("link", [])):
        if node.get("rel") == "enclosure" and (node.get("type") or "").startswith("image") and node.get("href"):
            found.append((0, node.get("href").strip()))
    for name in ("content:encoded", "description", "atom:content", "atom:summary", "summary"):
        for node in by.get(name, [])[:1]:
            raw = "".join(node.itertext())
            if m := _SRCSET.search(raw):
                sized = [(p.split()[0], p.split()[1:]) for p in html.unescape(m[1]).split(",") if p.split()]
                wide = [(int(w[0][:-1]) if w and re.fullmatch(r"\d+w", w[0]) else -1, -i, u) for i, (u, w) in enumerate(sized)]
                found += [(0, max(wide)[2])] if wide else []
            found += [(0, html.unescape(u).strip()) for u in _IMG.findall(raw)]
    return [{"width": w, "url": html.unescape(u).strip()} for w, u in found]


def entries_of(body: bytes) -> list[dict]:
    """A feed's entries: RSS 2.0 or 1.0 items, else Atom entries; broken XML has none. Positions count skipped entries too."""
    try:
        root = ElementTree.fromstring((body or b"").strip().removeprefix(b"\xef\xbb\xbf").strip())
    except ElementTree.ParseError:
        return []
    nodes = [n for n in root.iter() if _tag(n) == "item"] or [n for n in root.iter() if _tag(n) == "atom:entry"] or [n for n in root.iter() if _tag(n).rpartition(":")[2] == "entry"]
    out = []
    for position, node in enumerate(nodes):
        by: dict[str, list] = {}
        for child in node:
            by.setdefault(_tag(child), []).append(child)
        title, link = _first(by, "title", "atom:title"), _link(by).strip()
        if not title or not link:
            continue
        categories = [(_words(c) or c.get("term") or "").strip() for c in (*by.get("category", []), *by.get("atom:category", []))]
        name = next((_words(n) for a in by.get("atom:author", []) for n in a if _tag(n) == "atom:name"), "")
        out.append({
            "position": position, "title": title, "link": link, "guid": _first(by, "guid", "atom:id"), "teaser": _first(by, "description", "atom:summary", "summary", "content:encoded", "atom:content"),
            "date": _first(by, "pubDate", "dc:date", "atom:published", "atom:updated", "published", "updated"), "categories": [c for c in categories if c],
            "author": _first(by, "dc:creator", "author", "dc:publisher") or name, "images": _images(by),
        })
    return out


_IMAGES = pa.list_(pa.struct([("width", pa.int32()), ("url", pa.string())]))
_FIELDS = {"position": pa.int32(), "title": pa.string(), "link": pa.string(), "guid": pa.string(), "teaser": pa.string(), "date": pa.string(), "categories": pa.list_(pa.string()), "author": pa.string(), "images": _IMAGES}


def scan(raw: DataFrame) -> DataFrame:
    """Entries of raw responses (feed_url, fetched_at, body), texts still as in the feed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, body in enumerate(batch.column("body")):
                found = entries_of(body.as_py())
                if found:  # a feed's entries at a time, so that memory is bounded by one response
                    same = [batch.column(c).slice(i, 1).take(pa.array([0] * len(found))) for c in ("feed_url", "fetched_at")]
                    yield pa.RecordBatch.from_arrays([*same, *(pa.array([e[k] for e in found], t) for k, t in _FIELDS.items())], names=["feed_url", "fetched_at", *_FIELDS])

    return raw.filter((F.col("status") == 200) & (F.octet_length("body") > 0)).select("feed_url", "fetched_at", "body").mapInArrow(run, ENTRY)


def best_image(images: Column) -> Column:
    """The widest plausible image, the first of equals; empty if there is none."""
    ok = F.filter(images, lambda x: X.plausible_image(x["url"]))
    return F.coalesce(F.array_max(F.transform(ok, lambda x, i: F.struct(x["width"].alias("w"), (-i).alias("i"), x["url"].alias("url"))))["url"], F.lit(""))


def feed_registry(sources: DataFrame) -> DataFrame:
    """feed_url, source_key, lang, topic, feed_rank from sources (pos, key, lang, feeds array<struct<url, topic>>): ranks in registry order."""
    from pyspark.sql.window import Window as W

    flat = sources.select("pos", F.col("key").alias("source_key"), "lang", F.posexplode("feeds").alias("nth", "feed"))
    rank = F.row_number().over(W.orderBy("pos", "nth")) - 1  # a registry: as many rows as there are feeds
    return flat.select(F.col("feed.url").alias("feed_url"), "source_key", "lang", F.col("feed.topic").alias("topic"), rank.alias("feed_rank"))


def observations(raw: DataFrame, feeds: DataFrame, entities=X.unescape) -> DataFrame:
    """What merge_items() folds: one row for each entry of each response of a known feed."""
    e = ranked(scan(raw).join(small(feeds.drop("feed_rank")), "feed_url"), feeds)
    clean = lambda c, n: X.clean_text(F.col(c), n, entities)
    out = e.withColumn("title", clean("title", 300)).withColumn("teaser", clean("teaser", 600)).withColumn("author", clean("author", 80)).withColumn("canonical_url", X.canonical_url(F.col("link")))
    out = out.filter((F.col("title") != "") & (F.col("canonical_url") != "")).withColumn("dated", parse_date(F.col("date"))).withColumn("image_url", best_image(F.col("images")))
    return out.select(
        X.item_id(F.col("canonical_url")).alias("id"), F.struct("fetched_at", "feed_rank", "position").alias("seq"), "source_key", "canonical_url", "lang", "fetched_at", "title", "teaser",
        X.agency_from(F.col("author"), F.col("teaser")).alias("agency"), clamp_future(F.col("dated"), F.col("fetched_at")).alias("published_at"), F.col("dated").isNotNull().alias("has_date"),
        X.topic_for_item(F.col("topic"), F.col("categories")).alias("topic"), "feed_url", "feed_rank", F.col("position").alias("feed_pos"), "image_url", F.when(F.col("image_url") != "", "feed").otherwise("").alias("image_kind"),
    )


def flags(known_sha: Column) -> dict[str, Column]:
    """What a response is: ``ok`` (200 with a body), ``not_modified`` (304), ``changed`` (ok, and another body than the one known)."""
    ok = (F.col("status") == 200) & (F.coalesce(F.octet_length("body"), F.lit(0)) > 0)
    return {"ok": ok, "not_modified": F.col("status") == 304, "changed": ok & ~F.col("sha256").eqNullSafe(known_sha)}


def ranked(observed: DataFrame, feeds: DataFrame) -> DataFrame:
    """``observed`` (feed_url, ...) with the feed's place in the registry; a feed that isn't in it comes last, at UNKNOWN_RANK."""
    return observed.join(small(feeds.select("feed_url", "feed_rank")), "feed_url", "left").withColumn("feed_rank", F.coalesce("feed_rank", F.lit(C.UNKNOWN_RANK)).cast("int"))


class FeedReader(PoliteReader):
    def answer(self, url: str, etag: str = "", modified: str = "") -> tuple:
        head = ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": modified} if modified else {})
        status, body, got = self.request(url, head)
        now = datetime.now(timezone.utc).replace(microsecond=0)
        return url, now, status, got.get("ETag"), got.get("Last-Modified"), sha256(body).hexdigest() if body else None, body


class FeedStream(DataSourceStreamReader):
    """The feeds asked once a poll; an offset is the number of the clock's slot of ``every`` seconds.

    Slots that pass while no batch runs are one poll, as a feed only tells its present state. A batch that is run again
    asks again, so a sink should overwrite its own part.
    """

    def __init__(self, options: dict):
        self.reader, self.every = FeedReader(options), float(options.get("every", 1800))

    def initialOffset(self) -> dict:
        return {"poll": -1}

    def latestOffset(self) -> dict:
        return {"poll": int(time.time() // self.every)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.reader.partitions() if end["poll"] > start["poll"] else []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """``format("tidewire_feeds").option("requests", "url<TAB>etag<TAB>last-modified lines")``: conditional requests, politely; as a stream one poll each ``every`` seconds.

    For the requests that a store's feeds need see engine.fetch_feeds.
    """

    @classmethod
    def name(cls) -> str:
        return "tidewire_feeds"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStream(self.options)
