"""From requests to a board: fetch, refresh, rebuild, markets, weather and export over a store. Nothing but the sources reads the clock: ``as_of`` is given.

What a refresh writes grows with the news, not with the store: items lie in parts by their id, of which it rewrites
those that it touches; postings are segments, one a refresh, merged now and then; the raw log lies in folders by day,
which go as they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import constants as C
from tidewire.functions import text as X
from tidewire.operators import board, cluster, images, merge, search, series
from tidewire.plans.store import Store, as_lines, by_second, write_json
from tidewire.session import release, small, written
from tidewire.sources import feeds, http, json_sources

RAW = feeds.RAW + ", batch long"
ITEM = (
    "id string, source_key string, canonical_url string, lang string, first_seen_at timestamp, title string, teaser string, agency string, published_at timestamp, topic string, "
    "feed_url string, feed_rank int, feed_pos int, image_url string, image_kind string"
)
STATE = "item_id string, field string, on boolean, ts timestamp, seq long, batch long"
SOURCE = "key string, name string, tier int, lang string, no_scrape boolean"
FEED = "feed_url string, source_key string, lang string, topic string, feed_rank int"
FEED_STATE = "feed_url string, etag string, last_modified string, sha256 string, fetched_at timestamp, status int"
CACHE = "canonical_url string, image_url string, at timestamp, batch long"
MEMBER = "cluster_id string, lead_id string, item_id string, topic string, lang string, source_key string"
SUMMARY = "cluster_id string, lead_id string, size long, source_count long, topic string, lang string"
POSTING = "id string, length int, token string, tf_title long, tf_teaser long, batch long"
DEAD, FIGURES = "id string, below long, batch long", "n long, words long"
SECURITY, CITY = "symbol string, kind string", "city string, lat double, lon double, pos int"
MARKET = "symbol string, kind string, name string, price double, currency string, change_pct double, change_pct_daily double, spark array<double>, fetched_at timestamp"
DAY = "city string, day date, code int, hi double, lo double, sunrise string, sunset string, fetched_at timestamp"
HOUR = "city string, hour timestamp_ntz, code int, temp double, precip double, fetched_at timestamp"

#: What one refresh writes and readers see together.
TOGETHER = ("item", "member", "summary", "posting", "dead", "figures", "feed_state")
#: Parts that items lie in: chosen for a store once, so that a part fits a task.
ITEM_PARTS = 64
#: Segments of postings, and commits of the page cache, before they are merged.
MOST_SEGMENTS, MOST_CACHE = 8, 32


def _filled(**values) -> Callable[[DataFrame], DataFrame]:
    """Columns that older files lack."""
    return lambda rows: rows.withColumns({c: F.coalesce(c, F.lit(v).cast(rows.schema[c].dataType)) for c, v in values.items()})


def _without_pairs(rows: DataFrame) -> DataFrame:
    """Securities are told apart by symbol and kind; rows from before were by symbol alone, without a kind."""
    rows = rows.withColumns({"kind": F.coalesce("kind", F.lit("stock")), "spark": F.coalesce("spark", F.array().cast("array<double>"))})
    return merge.replace_by_key(rows, ["symbol", "kind"], ["fetched_at"])


#: What is done, in this order, with what older versions wrote, whenever it is read.
MIGRATIONS: dict[str, list[Callable[[DataFrame], DataFrame]]] = {
    "item": [_filled(feed_rank=C.UNKNOWN_RANK)],
    "market": [_filled(change_pct_daily=0.0), _without_pairs],
    "day": [_filled(sunrise="", sunset="")],
    "hour": [_filled(precip=0.0)],
}
SCHEMAS = {"item": ITEM, "market": MARKET, "day": DAY, "hour": HOUR}


def open_store(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, TOGETHER)


def stored(store: Store, name: str, upto: int | None = None) -> DataFrame:
    """A table as this version has it."""
    rows = store.read(name, SCHEMAS[name], upto)
    for step in MIGRATIONS[name]:
        rows = step(rows)
    return rows


def _one(spark: SparkSession, value: Column):
    return spark.range(1).select(value).first()[0]


def sync_sources(store: Store, sources: DataFrame, feed_table: DataFrame) -> None:
    """The registry: sources and feeds, replaced as a whole."""
    store.replace("source", sources)
    store.replace("feed", feed_table)


# --- fetching
def fetch_feeds(store: Store, force: bool = False, **options) -> DataFrame:
    """The answers of all registered feeds, asked with the validators that their last answers gave (``force``: without).

    Feeds are asked when the result is evaluated: refresh() does that once. Options: see http.PoliteReader.
    """
    state = store.read("feed_state", FEED_STATE).select("feed_url", "etag", "last_modified")
    known = store.read("feed", FEED).select("feed_url").distinct().join(state, "feed_url", "left")
    if force:
        known = known.select("feed_url")
    return http.ask(known, feeds.FeedReader, feeds.RAW, **options)


def page_reader(**options) -> Callable[[DataFrame], DataFrame]:
    """What refresh() asks pages with: canonical_url in, canonical_url and html out."""
    return lambda asked: http.ask(asked, http.PageReader, http.PAGE, **options)


# --- items
def _part() -> Column:
    return F.pmod(F.crc32("id"), F.lit(ITEM_PARTS)).cast("int").alias("part")


def folded(old: DataFrame, observed: DataFrame) -> DataFrame:
    """Items and new observations as items. What is stored counts as observed before all that is new, by its first sight."""
    order = F.struct(F.col("first_seen_at").alias("fetched_at"), F.lit(-1).alias("feed_rank"), F.lit(-1).alias("position"))
    seen = old.select(
        "id", order.alias("seq"), "source_key", "canonical_url", "lang", F.col("first_seen_at").alias("fetched_at"), "title", "teaser", "agency", "published_at", F.lit(True).alias("has_date"),
        "topic", "feed_url", "feed_rank", "feed_pos", "image_url", "image_kind",
    )
    return merge.merge_items(seen.unionByName(observed)).select(*(x.split()[0] for x in ITEM.split(", ")))


def _images(store: Store, number: int, missing: DataFrame, as_of: Column, budget: int, pages: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """id, image_url, image_kind of the board's items that had no image; what was looked up is logged first, misses and forbidden pages too."""
    named = small(store.read("source", SOURCE).select(F.col("key").alias("source_key"), F.col("name").alias("source_name"), F.coalesce("no_scrape", F.lit(False)).alias("no_scrape")))
    asked_for = missing.join(named, "source_key")
    cache = merge.latest_per_key(store.read("og_cache", CACHE), ["canonical_url"], ["batch"])
    new = images.forbidden(asked_for, cache)
    if pages is not None and budget > 0:
        asked = written(images.asks(asked_for, cache, budget), "asked")
        new = new.unionByName(images.looked(asked, pages(asked.select("canonical_url"))))
    store.append("og_cache", new.withColumn("at", as_of), number)
    if len(store.segments("og_cache")) > MOST_CACHE:
        every = merge.latest_per_key(store.read("og_cache", CACHE), ["canonical_url"], ["batch"])
        store.merge("og_cache", every.select(*(x.split()[0] for x in CACHE.split(", "))), 0, number)
    cache = merge.latest_per_key(store.read("og_cache", CACHE), ["canonical_url"], ["batch"])
    return written(images.assign(asked_for, cache), "images")


def _index(store: Store, number: int, old: DataFrame, items: DataFrame) -> None:
    """A segment of postings for items that are new or were edited; what edited ones had before is dead; the collection's figures move by the difference."""
    before = old.select("id", F.col("title").alias("__title"), F.col("teaser").alias("__teaser"), F.lit(True).alias("__known"))
    edited = items.select("id", "title", "teaser").join(before, "id", "left").filter(F.col("__known").isNull() | ~F.col("title").eqNullSafe(F.col("__title")) | ~F.col("teaser").eqNullSafe(F.col("__teaser")))
    edited = written(edited, "edited")
    store.append("posting", search.ranged(search.postings(edited)), number)
    known = edited.filter("__known")
    store.append("dead", known.select("id", F.lit(number).cast("long").alias("below")), number)
    words = lambda df: search.lengths(df).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
    now, then = words(edited), words(known.select("id", F.col("__title").alias("title"), F.col("__teaser").alias("teaser")))
    last = store.read("figures", FIGURES).first() or (0, 0)
    store.replace("figures", store.spark.createDataFrame([(last[0] + now.n - then.n, last[1] + now.words - then.words)], FIGURES), number)
    release(edited)
    _merge_segments(store, number)


def _merge_segments(store: Store, number: int) -> None:
    """Too many segments become one: all of them once the later ones have as many rows as the first, else these alone, without what is dead."""
    segments = store.segments("posting", number)
    if len(segments) <= MOST_SEGMENTS:
        return
    load = lambda some: store.load([f"posting/c{a}-{b}" for a, b in some], POSTING)
    dead = merge.latest_per_key(store.read("dead", DEAD, number), ["id"], ["below"])
    alive = lambda rows: rows.join(small(dead.select("id", "below")), "id", "left").filter(F.col("below").isNull() | (F.col("batch") >= F.col("below"))).drop("below")
    whole = load(segments[1:]).count() >= load(segments[:1]).count()
    some = segments if whole else segments[1:]
    store.merge("posting", search.ranged(alive(load(some))), some[0][0], number)
    if whole:
        store.replace("dead", dead.limit(0), number)


def _written(store: Store, number: int, observed: DataFrame, as_of: Column, budget: int, pages, stopwords: Sequence[str], whole: bool) -> dict:
    """Fold ``observed`` into the items, write the parts that this touches once, index and cluster; figures of all."""
    observed = written(observed.withColumn("part", _part()), "observed")
    parts = list(range(ITEM_PARTS)) if whole else sorted(r[0] for r in observed.select("part").distinct().collect())  # numbers of parts
    every = stored(store, "item").withColumn("part", _part())
    old, others = every.filter(F.col("part").isin(parts)), every.filter(~F.col("part").isin(parts))
    if not whole:
        old = store.read_parts("item", ITEM, parts)
        for step in MIGRATIONS["item"]:
            old = step(old)
    old = old.drop("part")
    fresh = written(folded(old, observed.drop("part")), "items")
    missing = images.missing(fresh.unionByName(others.drop("part")), as_of, C.BOARD_HOURS)
    found = _images(store, number, missing, as_of, budget, pages).withColumn("part", _part())
    # items of other parts whose image is another one now
    now = found.join(others.select("id", F.col("image_url").alias("__url")), "id").filter("image_url <> __url")
    more = sorted(r[0] for r in now.select("part").distinct().collect())
    rows = fresh.unionByName(others.filter(F.col("part").isin(more)).drop("part")) if more else fresh
    seen = found.select("id", F.col("image_url").alias("__url"), F.col("image_kind").alias("__kind"))
    rows = rows.join(seen, "id", "left").withColumn("image_url", F.coalesce("__url", "image_url")).withColumn("image_kind", F.coalesce("__kind", "image_kind")).drop("__url", "__kind")
    if parts or more:
        store.put("item", rows.withColumn("part", _part()).repartition("part"), "part", number)
    if whole:
        posts = store.replace("posting", search.ranged(search.postings(fresh)).withColumn("batch", F.lit(number).cast("long")), number)
        store.replace("dead", store.read("dead", DEAD).limit(0), number)
        store.replace("figures", search.figures(fresh, posts).select("n", "words"), number)
    else:
        _index(store, number, old, fresh)
    out = {"items": store.read("figures", FIGURES, number).first().n, "clusters": rebuild_clusters(store, as_of, number, stopwords)}
    release(observed, fresh, found)
    return out


def rebuild_clusters(store: Store, as_of: Column, number: int, stopwords: Sequence[str] = C.STOPWORDS) -> dict[str, int]:
    """Stories of the cluster window, replaced as a whole; their counts."""
    tiers = small(store.read("source", SOURCE).select(F.col("key").alias("source_key"), F.col("tier").alias("source_tier")))
    recent = stored(store, "item", number).filter(F.col("published_at") >= as_of - F.expr(f"INTERVAL {C.CLUSTER['window_hours']} HOURS"))
    docs = recent.join(tiers, "source_key").withColumn("tokens", X.tokens(F.col("title"), stopwords))
    members = store.replace("member", cluster.build(docs).select(*(x.split()[0] for x in MEMBER.split(", "))), number)
    summary = store.replace("summary", cluster.summarise(members).select(*(x.split()[0] for x in SUMMARY.split(", "))), number)
    return cluster.stats(summary).first().asDict()


def refresh(
    store: Store, fetched: DataFrame, as_of: Column, image_budget: int = 40, pages: Callable[[DataFrame], DataFrame] | None = None, stopwords: Sequence[str] = C.STOPWORDS
) -> dict:
    """Log ``fetched`` responses, fold those that changed, find images, index, cluster, drop old days of the log; what was done.

    ``fetched`` has RAW's columns, as fetch_feeds gives them. It is evaluated once, into the log: all else is made from
    what the log holds. Of responses of one feed and second one counts. A failed or unchanged response changes no item;
    one of a feed that the registry doesn't know stays in the log only. ``pages``: how pages are asked for images
    (page_reader); without it none is. A refresh that fails leaves readers at the one before, and the next one folds
    again what it had logged but not taken in, as far as feeds still tell it.
    """
    number = store.begin("raw", "og_cache")
    batch = store.append("raw", fetched.withColumn("day", F.date_format("fetched_at", "yyyy-MM-dd")), number, by="day")
    batch = by_second(batch, ("batch", "status", "sha256")).withColumn("seq", F.col("batch"))
    state = store.read("feed_state", FEED_STATE)
    new = merge.followed(batch, state)
    new = new.withColumns(feeds.flags(F.col("known")))
    done = new.agg(F.count(F.lit(1)).alias("feeds"), F.count_if("ok").alias("ok"), F.count_if("not_modified").alias("not_modified"), F.count_if("changed").alias("changed")).first().asDict()
    observed = feeds.observations(new.filter("changed"), store.read("feed", FEED))
    out = {"fetched": done, **_written(store, number, observed, as_of, image_budget, pages, stopwords, False)}
    store.replace("feed_state", merge.feed_state(batch, state).select(*(x.split()[0] for x in FEED_STATE.split(", "))), number)
    store.finish(number, store.spark.createDataFrame([(json.dumps(out),)], "done string").withColumn("at", as_of))
    prune(store, as_of)
    store.set_meta("last_fetch_at", json.dumps(str(_one(store.spark, as_of.cast("string")))), as_of)
    return out


def full_log(store: Store) -> DataFrame:
    """All responses with a body that the log holds, those kept beyond its days included."""
    raw = store.read("raw", RAW).unionByName(store.read("kept", RAW))
    return by_second(raw.filter((F.col("status") == 200) & F.col("sha256").isNotNull()))


def rebuild(store: Store, as_of: Column, stopwords: Sequence[str] = C.STOPWORDS) -> dict:
    """All again from the log, without a network: the newest full response of each known feed, no page is looked at."""
    log = full_log(store)
    number = store.begin("raw", "og_cache")
    newest = merge.latest_per_key(log, ["feed_url"], ["fetched_at", "batch"]).select(*log.columns)
    out = _written(store, number, feeds.observations(newest.drop("batch"), store.read("feed", FEED)), as_of, 0, None, stopwords, True)
    store.finish(number, store.spark.createDataFrame([(json.dumps(out),)], "done string").withColumn("at", as_of))
    return out


def prune(store: Store, as_of: Column, days: int = C.RAW_DAYS) -> list[str]:
    """Drop the log's days that ended before the last ``days``; the days.

    A feed's newest full response stays however old it is: those of days that go move to a table of their own, which
    holds a row for each feed that is silent since. No other body is read or moved, and nothing at all but once a day.
    """
    before = _one(store.spark, F.date_format(as_of - F.expr(f"INTERVAL {days} DAYS"), "yyyy-MM-dd"))
    by_day = [(d, f"raw/{c}/{d}") for c, d in store._glob("raw/c*/day=*", 2)]
    gone, stay = ([p for d, p in by_day if (d.partition("=")[2] < before) == old] for old in (True, False))
    if not gone:
        return []
    full = (F.col("status") == 200) & F.col("sha256").isNotNull()
    aside = store.read("kept", RAW).unionByName(store.load(gone, RAW).filter(full))
    heard = store.load(stay, RAW).filter(full).select("feed_url").distinct()
    key = ["feed_url", "fetched_at", "batch"]
    newest = merge.latest_per_key(aside.select(*key).join(heard, "feed_url", "left_anti"), ["feed_url"], ["fetched_at", "batch"])
    store.replace("kept", aside.join(small(newest), key, "left_semi").dropDuplicates(key))
    return store.drop_days("raw", before)


def user_state(store: Store) -> DataFrame:
    return merge.user_state(store.log("state", STATE))


def found(store: Store, as_of: Column) -> DataFrame:
    """All entries of the board, without filters or cap."""
    seen = board.visible(stored(store, "item"), store.read("source", SOURCE), user_state(store), store.read("member", MEMBER), store.read("summary", SUMMARY), as_of)
    return board.entries(seen, as_of)


def search_items(store: Store, query: str, saved_only: bool = False, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """The client's fields of the items that match, by the stored index."""
    dead = merge.latest_per_key(store.read("dead", DEAD), ["id"], ["below"]).select("id", "below")
    return search.found(
        stored(store, "item"), store.read("source", SOURCE), user_state(store), query, saved_only, posts=store.read("posting", POSTING), size=store.read("figures", FIGURES), dead=dead, weights=weights
    )


# --- markets and weather
def save_weather(store: Store, name: str, rows: DataFrame) -> DataFrame:
    """Days or hours: each city's rows replaced where there are new ones."""
    cities = [[r[0]] for r in rows.select("city").distinct().collect()]
    return store.replace_groups(name, rows, "city", cities)


def save_markets(store: Store, rows: DataFrame) -> DataFrame:
    """ETFs and stocks replaced together, the search index apart; a kind without news keeps its rows."""
    return store.replace_groups("market", rows, "kind", [["etf", "stock"], ["search"]])


def _age(fetched: DataFrame, as_of: Column) -> DataFrame:
    return fetched.agg(((F.unix_micros(as_of) - F.unix_micros(F.max("fetched_at"))) / F.lit(60e6)).alias("age"))


def refresh_markets(store: Store, securities: DataFrame, url: str, as_of: Column, force: bool = False, **options) -> dict:
    """Charts of ``securities`` (symbol, kind: etf, stock or search) asked, measured and saved, unless the last are fresh enough.

    ``url`` has ``{symbol}`` where the symbol goes. Securities without an answer, with too short a history or (but for
    the search index) with dividends are left out. Where nothing at all comes back, all is kept as it was.
    """
    age = _age(stored(store, "market"), as_of).first().age
    if not force and age is not None and age < C.MARKET_TTL_MINUTES:
        return {"refreshed": False, "age_minutes": round(age, 1)}
    head, _, tail = url.partition("{symbol}")
    asked = securities.select("symbol").distinct().select(F.concat(F.lit(head), "symbol", F.lit(tail)).alias("url"), F.col("symbol").alias("key"), F.lit(f"range={C.LOOKBACK_YEARS}y\tinterval=1d\tevents=div,splits").alias("parameters"))
    answers = written(http.ask(asked, http.JsonReader, http.JSON, **options), "charts")
    rows = written(series.market_rows(json_sources.charts(answers.withColumnRenamed("key", "symbol")), securities).withColumn("fetched_at", as_of).select(*(x.split()[0] for x in MARKET.split(", "))), "market")
    counts = {"etf": 0, "stock": 0, "search": 0} | {r[0]: r[1] for r in rows.groupBy("kind").count().collect()}  # three kinds
    if any(counts.values()):
        store.replace("market", merge.keep_last_good(stored(store, "market"), rows, "kind", [["etf", "stock"], ["search"]]))
    out = {"refreshed": any(counts.values()), "etfs": counts["etf"], "stocks": counts["stock"], "search": counts["search"]}
    release(answers, rows)
    return out if out["refreshed"] else out | {"failed": True}


def refresh_weather(store: Store, cities: DataFrame, url: str, as_of: Column, force: bool = False, days: int = 3, **options) -> dict:
    """Forecasts of all ``cities`` (city, lat, lon, pos) by one request, saved city by city, unless those of all are fresh enough.

    A city for which no days (hours) come back keeps those it had; so do all if there is no answer.
    """
    known = [r.asDict() for r in cities.orderBy("pos").collect()]  # a registry
    ages = series.stale(stored(store, "day"), "city", as_of, C.WEATHER_TTL_MINUTES)
    fresh = {r.city for r in ages.filter("NOT stale").collect()}
    if not force and all(c["city"] in fresh for c in known):
        return {"cities": 0, "cached": len(known)}
    asked = {
        "latitude": ",".join(str(c["lat"]) for c in known), "longitude": ",".join(str(c["lon"]) for c in known), "daily": "weather_code,temperature_2m_max,temperature_2m_min,sunrise,sunset",
        "hourly": "temperature_2m,weather_code,precipitation", "forecast_days": max(days, 1), "timezone": C.TIME_ZONE,
    }
    request = store.spark.createDataFrame([(url, "weather", "\t".join(f"{k}={v}" for k, v in asked.items()))], "url string, key string, parameters string")
    answer = written(http.ask(request, http.JsonReader, http.JSON, **options).filter("body IS NOT NULL"), "forecast")
    if answer.isEmpty():
        return {"cities": 0, "error": 1}
    blocks = json_sources.forecast_blocks(answer, [c["city"] for c in known])
    day = written(json_sources.forecast_days(blocks).withColumn("fetched_at", as_of).select(*(x.split()[0] for x in DAY.split(", "))), "days")
    hour = json_sources.forecast_hours(blocks).withColumn("fetched_at", as_of).select(*(x.split()[0] for x in HOUR.split(", ")))
    for name, rows in (("day", day), ("hour", hour)):
        store.replace(name, merge.keep_last_good(stored(store, name), rows, "city", [[c["city"]] for c in known]))
    return {"cities": day.select("city").distinct().count()}


# --- export
def export(store: Store, as_of: Column, path: str, facts: DataFrame, market: DataFrame, days: DataFrame, hours: DataFrame, cities: list[str]) -> None:
    """A static copy under ``path``: ``data/*.json`` (board, search index, markets, weather, brief, meta) and ``tiles/*.svg``.

    The board has all entries, without what a reader keeps for itself (read, saved); the index and the tiles are those
    of the last days. Tiles that are there aren't drawn again, and those that nothing needs any more go. Documents are
    put together from sorted parts, so no task holds one; each is replaced as a whole.
    """
    http.register(store.spark)
    entries = board.exported(found(store, as_of)).withColumn("__at", F.col("published_at"))
    write_json(as_lines(entries.drop("__at", "published_at"), [-F.col("score"), F.col("id")]), f"{path}/data/board.json")
    index = search.exported(stored(store, "item"), store.read("source", SOURCE), as_of)
    write_json(as_lines(index, [-F.unix_micros(F.col("publishedAt")), F.col("id")]), f"{path}/data/search.json")
    tiles = images.tiles(stored(store, "item"), store.read("source", SOURCE), as_of).select(F.col("file").alias("path"), F.col("svg").alias("content"))
    tiles.write.format("tidewire_files").option("existing", "keep").option("clean", "tiles").mode("overwrite").save(path)
    write_json(as_lines(series.market_payload(market), [F.col("kind"), F.col("nth")]), f"{path}/data/markets.json")
    wx = None
    for city in cities:
        one = series.weather_payload(days, hours, city, cities, as_of).withColumn("city", F.lit(city))
        wx = one if wx is None else wx.unionByName(one)
    write_json(as_lines(wx, [F.col("city"), F.col("day")]), f"{path}/data/weather.json")
    top = series.brief_top(board.ranked(found(store, as_of)))
    write_json(series.brief_payload(top, facts, market, as_of), f"{path}/data/brief.json", "object")
    write_json(as_lines(store.meta().unionByName(store.spark.range(1).select(F.lit("mode").alias("key"), F.lit('"static"').alias("value"), as_of.alias("at"))), [F.col("key")]), f"{path}/data/meta.json")
