"""Markets, weather, the daily brief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire import constants as C
from tidewire.functions.numeric import describe, fixed, py_round, ratio, weekday_label
from tidewire.functions.text import simplify_name
from tidewire.session import small, written


def market_metrics(closes: DataFrame, min_history: int = C.MARKET_HISTORY, dividend_free: bool = True, points: int = C.SPARK_POINTS) -> DataFrame:
    """symbol, n, price, change_pct, change_pct_daily, spark from (symbol, seq, close, pays); null closes don't count.
    A change from a close of zero is infinite, or not a number.

    Closes are sorted over all tasks by symbol and seq, so a place in a symbol's series is a place in a range of the
    table. Each symbol asks for the few places that it needs (both ends, the last but one, ``points`` evenly spread);
    no task holds a series, however long one is.
    """
    used = closes.filter(F.col("close").isNotNull())
    at = F.monotonically_increasing_id()  # the number of the range, and the row's place in it below
    ordered = used.select("symbol", "seq", "close").repartitionByRange("symbol", "seq").sortWithinPartitions("symbol", "seq").withColumn("at", at)
    ordered = written(ordered.select("symbol", "at", "close"), "closes")
    runs = ordered.groupBy("symbol", F.shiftright("at", 33).alias("range")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    base = runs.withColumn("upto", F.sum("n").over(W.partitionBy("symbol").orderBy("range")))
    pays = closes.groupBy("symbol").agg(F.bool_or("pays").alias("pays"))
    total = runs.groupBy("symbol").agg(F.sum("n").alias("n")).join(pays, "symbol").filter((F.col("n") >= min_history) & (~F.coalesce("pays", F.lit(False)) if dividend_free else F.lit(True)))
    step = (F.col("n") - 1) / F.lit(points - 1.0)
    spread = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.rint(i * step).cast("long"))
    spread = F.when(F.col("n") <= points, F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(spread)
    ends = F.filter(F.array(F.lit(0).cast("long"), F.col("n") - 1, F.col("n") - 2), lambda p: p >= 0)
    wanted = total.select("symbol", "n", F.explode(F.array_distinct(F.concat(spread, ends))).alias("place"), spread.alias("spread"))
    # where each place lies: in the range that reaches up to it
    there = wanted.join(base.select("symbol", "first", "upto", F.col("n").alias("held")), "symbol").filter((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("held")))
    there = there.select("symbol", "n", "place", "spread", (F.col("first") + F.col("place") - (F.col("upto") - F.col("held"))).alias("at"))
    got = ordered.select("at", "close").join(small(there), "at")
    of = got.groupBy("symbol", "n").agg(F.map_from_entries(F.collect_list(F.struct("place", "close"))).alias("c"), F.first("spread").alias("spread"))  # points + 3 at most
    last, first = F.element_at("c", F.col("n") - 1), F.element_at("c", F.lit(0).cast("long"))
    daily = F.when(F.col("n") >= 2, (ratio(last, F.try_element_at("c", F.col("n") - 2)) - 1) * 100).otherwise(0.0)
    line = F.transform("spread", lambda p: py_round(F.element_at(F.col("c"), p), 2))
    return of.select("symbol", F.col("n").cast("int").alias("n"), py_round(last, 2).alias("price"), py_round((ratio(last, first) - 1) * 100, 1).alias("change_pct"), py_round(daily, 1).alias("change_pct_daily"), line.alias("spark"))


def market_rows(charts: DataFrame, securities: DataFrame) -> DataFrame:
    """symbol, kind, name, price, currency, change_pct, change_pct_daily, spark of ``securities`` (symbol, kind) by their charts(); the search index takes short histories and dividends too."""
    known = charts.groupBy("symbol").agg(F.first("name").alias("raw_name"), F.first("price").alias("quoted"), F.first("currency").alias("currency"))
    growth, index = market_metrics(charts), market_metrics(charts, C.SEARCH_HISTORY, False)
    kinds = securities.select("symbol", "kind").distinct()
    rows = growth.join(kinds.filter("kind <> 'search'"), "symbol").unionByName(index.join(kinds.filter("kind = 'search'"), "symbol"))
    price = F.coalesce(py_round(F.col("quoted"), 2), F.col("price"))
    return rows.join(known, "symbol").select("symbol", "kind", simplify_name(F.col("raw_name")).alias("name"), price.alias("price"), "currency", "change_pct", "change_pct_daily", "spark")


def market_top(rows: DataFrame, top: int = C.MARKET_TOP) -> DataFrame:
    """The best of each kind by the rounded change, then the symbol."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("change_pct"), "symbol"))).filter(F.col("nth") <= top)


def market_payload(rows: DataFrame, top: int = C.MARKET_TOP) -> DataFrame:
    """``rows`` (symbol, kind, change_pct, ...) as a client gets them, with ``nth``: the best ETFs and stocks, and the whole search index by symbol."""
    by = W.partitionBy("kind").orderBy(F.when(F.col("kind") != "search", -F.col("change_pct")), "symbol")
    return rows.withColumn("nth", F.row_number().over(by)).filter((F.col("kind") == "search") | (F.col("nth") <= top))


def spark_line(values: Column) -> Column:
    """A line's points ``x,y`` on 100 by 30, the least value at the bottom; empty for fewer than two values."""
    low, last = F.array_min(values), F.size(values) - 1
    span = F.coalesce(F.nullif(F.array_max(values) - low, F.lit(0.0)), F.lit(1.0))
    point = F.transform(values, lambda v, i: F.concat(fixed(i / last * 100.0, 1), F.lit(","), fixed(F.lit(28.0) - (v - low) / span * 26.0, 1)))
    return F.when(F.size(values) < 2, "").otherwise(F.array_join(point, " "))


def market_query(rows: DataFrame, index: DataFrame, text: str) -> DataFrame:
    """Rows whose name or symbol holds ``text``, with hits of the search index that aren't among them; best day first."""
    hit = lambda df: df.filter(F.lower("name").contains(text.lower()) | F.lower("symbol").contains(text.lower()))
    more = hit(index).join(rows.select("symbol"), "symbol", "left_anti")
    return hit(rows).withColumn("from_index", F.lit(False)).unionByName(more.withColumn("from_index", F.lit(True))).orderBy(F.desc("change_pct_daily"), "symbol")


def finance_stat(rows: DataFrame, as_of: Column) -> DataFrame:
    """The best security of the day (even day of the year) or of the years (odd), first of equals by ``pos``."""
    even = F.dayofyear(as_of) % 2 == 0
    value = F.when(even, F.col("change_pct_daily")).otherwise(F.col("change_pct"))
    best = rows.agg(F.max_by(F.struct("symbol", value.alias("value")), F.struct(F.coalesce(value, F.lit(0.0)), -F.col("pos"))).alias("b"))
    label = F.when(even, "Bester Tages-Gewinner").otherwise(f"Bester {C.LOOKBACK_YEARS}J-Wachstumstitel")
    return best.filter(F.col("b").isNotNull()).select(label.alias("label"), F.col("b.symbol").alias("symbol"), F.col("b.value").alias("change"), F.when(even, "heute").otherwise(f"{C.LOOKBACK_YEARS} Jahre").alias("period"))


def fact_of_the_day(facts: DataFrame, as_of: Column) -> DataFrame:
    """The fact whose number is the day of the year modulo their count; ``facts``: nth (from 0), title, text."""
    n = facts.agg(F.count(F.lit(1)).alias("n"))
    return facts.join(F.broadcast(n)).filter(F.col("nth") == F.dayofyear(as_of) % F.col("n")).select("title", "text")


def brief_top(board: DataFrame, limit: int = C.BRIEF_LIMIT) -> DataFrame:
    return board.orderBy(F.desc("score"), "published_at", "id").limit(limit).select("id", "title", F.col("source_name").alias("source"), F.col("canonical_url").alias("url"))


def brief_payload(top: DataFrame, facts: DataFrame, market: DataFrame, as_of: Column) -> DataFrame:
    """One row ``json``: the brief's top entries (in their order), the fact of the day, and the best of the market's top rows (null without any)."""
    listed = top.select(F.monotonically_increasing_id().alias("nth"), F.struct("id", "title", "source", "url").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "row"))), lambda x: x["row"]).alias("top5"))
    pool = market_payload(market.filter("kind <> 'search'")).withColumn("pos", F.col("nth") + F.when(F.col("kind") == "stock", 1_000_000).otherwise(0))
    stat = finance_stat(pool, as_of).agg(F.first(F.struct("change", "label", "period", "symbol")).alias("financeStat"))
    fact = fact_of_the_day(facts, as_of).agg(F.first(F.struct(F.col("text").alias("extract"), "title")).alias("fact"))
    return listed.join(F.broadcast(fact)).join(F.broadcast(stat)).select(F.to_json(F.struct("fact", "financeStat", "top5"), {"ignoreNullFields": "false"}).alias("json"))


def stale(fetched: DataFrame, key: str, as_of: Column, minutes: int) -> DataFrame:
    """key, age (minutes), stale: older than ``minutes``; an age of exactly 0 counts as unknown."""
    age = (F.unix_micros(as_of) - F.unix_micros(F.max("fetched_at").cast("timestamp"))) / F.lit(60e6)
    return fetched.groupBy(key).agg(age.alias("age")).withColumn("stale", F.coalesce(F.nullif("age", F.lit(0.0)), F.lit(1e9)) > minutes)


def weather_days(hours: DataFrame) -> DataFrame:
    """city, day, hours, hot_hour, hot_temp, cold_hour, cold_temp: the first of equal extremes; temperatures rounded half to even."""
    day = F.to_date("hour")
    return hours.groupBy("city", day.alias("day")).agg(
        F.count(F.lit(1)).alias("hours"), F.min_by("hour", F.struct(-F.col("temp"), F.col("hour"))).alias("hot"), F.max("temp").alias("hot_temp"), F.min_by("hour", F.struct("temp", "hour")).alias("cold"), F.min("temp").alias("cold_temp"),
    ).select("city", "day", "hours", F.date_format("hot", "HH:mm").alias("hot_hour"), F.rint("hot_temp").alias("hot_temp"), F.date_format("cold", "HH:mm").alias("cold_hour"), F.rint("cold_temp").alias("cold_temp"))


def weather_strip(hours: DataFrame, now: Column) -> DataFrame:
    """Each hour as a client sees it."""
    d = describe(F.col("code"))
    precip = F.when(F.coalesce("precip", F.lit(0.0)) != 0, py_round(F.col("precip"), 1)).otherwise(0.0)
    return hours.select("city", F.to_date("hour").alias("day"), F.date_format("hour", "HH:mm").alias("hour"), d["icon"].alias("icon"), d["label"].alias("label"), F.rint("temp").alias("temp"), precip.alias("precip"), (F.col("hour") == F.date_trunc("hour", now)).alias("is_now"))


def weather_payload(days: DataFrame, hours: DataFrame, city: str, cities: list[str], now: Column) -> DataFrame:
    """The days of ``city`` (the first of ``cities`` if unknown) with labels, extremes and their hours in order."""
    city = city if city in cities else cities[0]
    own = weather_strip(hours.filter(F.col("city") == city), now).groupBy("day").agg(F.array_sort(F.collect_list(F.struct("hour", "icon", "label", "temp", "precip", "is_now"))).alias("strip"))
    ext = weather_days(hours.filter(F.col("city") == city)).drop("city", "hours")
    d = describe(F.col("code"))
    base = days.filter(F.col("city") == city).select("city", "day", weekday_label(F.col("day"), F.to_date(now)).alias("name"), d["icon"].alias("icon"), d["label"].alias("label"), F.rint("hi").alias("hi"), F.rint("lo").alias("lo"), "sunrise", "sunset")
    return base.join(ext, "day", "left").join(own, "day", "left").orderBy("day")
