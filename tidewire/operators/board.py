"""The board: one entry a story, ranked; filters, strip, counts, brief, fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire import constants as C
from tidewire.functions.numeric import local, score
from tidewire.session import small


def topic_label(topic: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for kv in C.TOPIC_LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(labels, topic), topic)


def meta_line(source: Column, published: Column, agency: Column, zone: str = C.TIME_ZONE) -> Column:
    base = F.concat_ws(" · ", source, local(published, "dd.MM.yyyy", zone), local(published, "HH:mm", zone))
    return F.when(F.coalesce(agency, F.lit("")) != "", F.concat(base, F.lit(" · "), agency)).otherwise(base)


def payload(items: DataFrame, zone: str = C.TIME_ZONE, more: tuple[Column | str, ...] = ()) -> DataFrame:
    """The fields that a client sees, and ``more``."""
    return items.select(
        "id", "title", "teaser", F.col("canonical_url").alias("url"), F.col("source_name").alias("source"), F.coalesce("agency", F.lit("")).alias("agency"), "topic",
        topic_label(F.col("topic")).alias("topicLabel"), F.upper(topic_label(F.col("topic"))).alias("kicker"), F.col("image_url").alias("image"), F.col("image_kind").alias("imageKind"),
        meta_line(F.col("source_name"), F.col("published_at"), F.col("agency"), zone).alias("meta"), local(F.col("published_at"), "dd.MM.", zone).alias("dateShort"),
        local(F.col("published_at"), "HH:mm", zone).alias("time"), F.col("read_at").isNotNull().alias("read"), F.col("saved_at").isNotNull().alias("saved"), *more,
    )


def visible(items: DataFrame, sources: DataFrame, state: DataFrame, members: DataFrame, summary: DataFrame, as_of: Column, hours: int = C.BOARD_HOURS) -> DataFrame:
    """Items of the last ``hours`` with their source, state and story; an item without a cluster is a story of its own.

    ``members`` and ``summary`` as from cluster.build() and cluster.summarise(); dimension tables are broadcast if small.
    """
    story = members.select("cluster_id", F.col("item_id").alias("id")).join(small(summary.select("cluster_id", F.col("topic").alias("cluster_topic"))), "cluster_id")
    out = (
        items.filter(F.col("published_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))
        .join(small(sources.select(F.col("key").alias("source_key"), F.col("name").alias("source_name"), F.col("tier").alias("source_tier"))), "source_key")
        .join(state.select(F.col("item_id").alias("id"), "read_at", "saved_at"), "id", "left")
        .join(story, "id", "left")
    )
    return out.withColumn("topic", F.coalesce("cluster_topic", "topic")).withColumn("story", F.coalesce("cluster_id", F.concat(F.lit("solo:"), F.col("id"))))


def entries(seen: DataFrame, as_of: Column) -> DataFrame:
    """One row a story: its lead's columns, size, source_count, sources (in order), others, score.

    The lead is least in (tier, published, id). Sources are counted by name among what is visible.
    """
    key = F.struct("source_tier", "published_at", "id")
    ordered = W.partitionBy("story").orderBy("source_tier", "published_at", "id")
    placed = seen.withColumn("nth", F.row_number().over(ordered))
    group = placed.groupBy("story").agg(
        F.array_sort(F.collect_list(F.struct("nth", "id", "title", "source_name", "canonical_url"))).alias("all"), F.count(F.lit(1)).alias("size"), F.min_by(F.struct("*"), key).alias("lead"),
    )
    lead = [c for c in seen.columns if c != "story"]
    out = group.select(
        "story", "size", *(F.col("lead")[c].alias(c) for c in lead), F.array_distinct(F.transform("all", lambda x: x["source_name"])).alias("sources"),
        F.transform(F.slice("all", 2, 100_000_000), lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["source_name"].alias("source"), x["canonical_url"].alias("url"))).alias("others"),
    ).withColumn("source_count", F.size("sources"))
    value = score(tier=F.col("source_tier"), sources=F.col("source_count"), pos=F.col("feed_pos"), published=F.col("published_at"), topic=F.col("topic"), as_of=as_of)
    return out.withColumn("score", value)


def leads(seen: DataFrame, as_of: Column) -> DataFrame:
    """entries() without sizes, sources' names and others: a story's rows are folded one by one, so a story may have any number."""
    lead = F.min_by(F.struct("*"), F.struct("source_tier", "published_at", "id")).alias("lead")
    found = seen.groupBy("story", "source_name").agg(lead).groupBy("story").agg(F.min_by("lead", F.struct("lead.source_tier", "lead.published_at", "lead.id")).alias("lead"), F.count("source_name").alias("source_count"))
    out = found.select("story", "source_count", *(F.col("lead")[c].alias(c) for c in seen.columns if c != "story"))
    value = score(tier=F.col("source_tier"), sources=F.col("source_count"), pos=F.col("feed_pos"), published=F.col("published_at"), topic=F.col("topic"), as_of=as_of)
    return out.withColumn("score", value)


def ranked(found: DataFrame, topic: str = "", cluster: str = "", hide_read: bool = False, source: str = "", limit: int | None = C.BOARD_LIMIT) -> DataFrame:
    """Filters, then the board's order, then the cap."""
    if cluster:
        found = found.filter(F.col("cluster_id") == cluster)
    if topic:
        found = found.filter(F.col("topic") == topic)
    if hide_read:
        found = found.filter(F.col("read_at").isNull())
    if source:
        found = found.filter(F.col("source_name") == source)
    found = found.orderBy(F.desc("score"), "published_at", "id")
    return found.limit(limit) if limit is not None else found


def parted(shown: DataFrame, leads: int = C.LEADS) -> DataFrame:
    """The capped board with ``nth`` (from 1) and ``part``: the first are ``lead``, the rest ``brief``."""
    nth = F.row_number().over(W.orderBy(F.desc("score"), "published_at", "id"))  # the cap's rows at most
    return shown.withColumn("nth", nth).withColumn("part", F.when(F.col("nth") <= leads, "lead").otherwise("brief"))


def page(found: DataFrame, number: int, size: int = C.PAGE) -> DataFrame:
    """The board's entries of page ``number`` (from 0)."""
    return found.orderBy(F.desc("score"), "published_at", "id").offset(number * size).limit(size)


def source_chips(found: DataFrame) -> DataFrame:
    """``found`` with ``chips``: of each further source of a story the first entry, in order; null for stories of one source."""
    others = F.filter("others", lambda x: x["source"] != F.col("source_name"))
    names = F.transform(others, lambda x: x["source"])
    first = F.filter(others, lambda x, i: F.array_position(names, x["source"]) == i + 1)
    return found.withColumn("chips", F.when((F.col("source_count") >= 2) & (F.size(first) > 0), first))


def source_picker(found: DataFrame) -> DataFrame:
    """The sources that a reader may choose from, in German order: case and accents tell names apart only where all else is equal."""
    return found.select(F.col("source_name").alias("source")).distinct().orderBy(F.collate("source", "de_CI_AI"), "source")


def relative_age(at: Column, now: Column) -> Column:
    """How long ago the last fetch was, in minutes or hours rounded half up; a dash if there was none."""
    minutes = F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(at)) / 60e6 + 0.5))
    hours = F.floor(minutes / 60 + 0.5)
    return F.when(at.isNull(), "–").when(minutes < 1, "GERADE").when(minutes < 60, F.format_string("VOR %d MIN", minutes)).otherwise(F.format_string("VOR %d STD", hours))


def exported(found: DataFrame) -> DataFrame:
    """All entries as a static copy has them: without read and saved, tiles by their place in the copy, the story nested."""
    story = F.struct(
        F.coalesce("cluster_id", F.lit("")).alias("id"), F.col("size").alias("size"), F.col("source_count").alias("sourceCount"), F.col("sources").alias("sources"), F.col("others").alias("others"),
    ).alias("cluster")
    tile = F.when((F.col("image_kind") == "tile") | F.col("image_url").startswith("/tile/"), F.concat(F.lit("tiles/"), F.col("id"), F.lit(".svg"))).otherwise(F.col("image_url"))
    return payload(found.withColumn("image_url", tile), more=(story, "score", "published_at")).drop("read", "saved")


def strip(found: DataFrame, limit: int = C.STRIP_LIMIT) -> DataFrame:
    """The largest stories of several sources, of the filtered and uncapped entries."""
    return found.filter("source_count > 1").orderBy(F.desc("source_count"), F.desc("score"), "id").limit(limit)


def topic_counts(found: DataFrame) -> DataFrame:
    """key, label, count for every topic, of all entries before filters."""
    spark = found.sparkSession
    topics = spark.createDataFrame([(t, C.TOPIC_LABELS[t], i) for i, t in enumerate(C.TOPICS)], "key string, label string, pos int")
    counts = found.groupBy(F.col("topic").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(topics).join(counts, "key", "left").select("key", "label", F.coalesce("n", F.lit(0)).alias("count"), "pos")


def state_counts(state: DataFrame) -> DataFrame:
    return state.agg(F.count("read_at").alias("read"), F.count("saved_at").alias("saved"))


def stats(found: DataFrame, shown: DataFrame, state: DataFrame) -> DataFrame:
    """total (before filters), shown (after the cap), read, saved (everywhere), sources (of the leads): one row of five scalars."""
    a = found.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("source_name").alias("sources"))
    return a.join(F.broadcast(shown.agg(F.count(F.lit(1)).alias("shown")))).join(F.broadcast(state_counts(state))).select("total", "shown", "read", "saved", "sources")


def digest(board: DataFrame, volatile: tuple[str, ...] = ("score", "generatedAt", "lastFetchAt")) -> DataFrame:
    """One row ``digest``: SHA-256 over the board's rows without what time changes, in the board's order.

    Rows are hashed where they are; only the capped board's hashes are put in order.
    """
    kept = [c for c in sorted(board.columns) if c not in volatile]
    by = board.select(F.row_number().over(W.orderBy(F.desc("score"), "published_at", "id")).alias("nth"), F.sha2(F.to_json(F.struct(*kept)), 256).alias("h"))
    return by.agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("nth", "h"))), lambda x: x["h"])), 256).alias("digest"))
