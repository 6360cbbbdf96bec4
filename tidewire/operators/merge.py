"""Folds over ordered logs, in place of row updates.

Each is one aggregation with map-side parts, in any order of the input: ``seq`` (a total order, such as a struct of
fetch time, feed rank and position) tells first from last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire import constants as C
from tidewire.session import small


def merge_items(obs: DataFrame) -> DataFrame:
    """One row an item from its observations.

    First: source_key, canonical_url, lang, first_seen_at. Last: title, teaser, agency. Last dated, else first:
    published_at. Of the least feed_rank, the earliest: topic, feed_url. Least: feed_rank, feed_pos. Last that isn't
    empty: image_url, image_kind. ``obs``: id, seq, has_date and those columns. Folding a folded table with what came
    later gives the same, if its rows have the earliest seq of their item.
    """
    first = lambda c: F.min_by(c, "seq").alias(c)
    last = lambda c: F.max_by(c, "seq").alias(c)
    best = lambda c: F.min_by(c, F.struct("feed_rank", "seq")).alias(c)
    imaged = F.when(F.col("image_url") != "", F.col("seq"))
    dated = F.when(F.col("has_date"), F.col("seq"))
    return obs.groupBy("id").agg(
        first("source_key"), first("canonical_url"), first("lang"), F.min_by("fetched_at", "seq").alias("first_seen_at"), last("title"), last("teaser"), last("agency"),
        F.coalesce(F.max_by("published_at", dated), F.min_by("published_at", "seq")).alias("published_at"), best("topic"), best("feed_url"),
        F.min("feed_rank").alias("feed_rank"), F.min("feed_pos").alias("feed_pos"),
        F.coalesce(F.max_by("image_url", imaged), F.lit("")).alias("image_url"), F.coalesce(F.max_by("image_kind", imaged), F.lit("")).alias("image_kind"),
    )


def clamp_future(published: Column, fetched: Column) -> Column:
    """A missing date is the fetch's, and so is one more than six hours ahead of it."""
    return F.when(published.isNull() | (published > fetched + F.expr(f"INTERVAL {C.FUTURE_HOURS} HOURS")), fetched).otherwise(published)


def latest_per_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by an aggregation that keeps one row a key and task (no sort of a key's whole history)."""
    rest = [c for c in log.columns if c not in keys]
    one = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return log.groupBy(*keys).agg(one).select(*keys, *(F.col("__row")[c].alias(c) for c in rest))


def replace_by_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """INSERT OR REPLACE: the row written last for each key."""
    return latest_per_key(log, keys, order).select(*log.columns)


def prune_keep_latest(raw: DataFrame, as_of: Column, key: str = "feed_url", at: str = "fetched_at", tie: str = "seq", days: int = C.RAW_DAYS) -> DataFrame:
    """Rows of the last ``days``, and the newest of each key however old it is.

    Only keys without a recent row need their newest looked up, so the common case is a filter.
    """
    cutoff = as_of - F.expr(f"INTERVAL {days} DAYS")
    recent = raw.filter(F.col(at) >= cutoff)
    old = raw.filter(F.col(at) < cutoff).join(recent.select(key).distinct(), key, "left_anti").select(*raw.columns)
    return recent.unionByName(latest_per_key(old, [key], [at, tie]).select(*raw.columns))


def changed(raw: DataFrame, key: str = "feed_url", order: tuple[str, ...] = ("fetched_at", "seq"), sha: str = "sha256", status: str = "status") -> DataFrame:
    """Fetches to process: status 200 with a body other than that of the previous successful fetch (A, B, A are three)."""
    w = W.partitionBy(key).orderBy(*order)
    return raw.filter(F.col(status) == 200).withColumn("__prev", F.lag(sha).over(w)).filter(~F.col(sha).eqNullSafe(F.col("__prev"))).drop("__prev")


def followed(raw: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """``raw`` with ``known``: the sha256 of the feed's last full response (200 with a body) before each row, in ``raw`` or else in ``state``."""
    w = W.partitionBy("feed_url").orderBy("fetched_at", "seq").rowsBetween(W.unboundedPreceding, -1)
    out = raw.withColumn("known", F.last(F.when(F.col("status") == 200, F.col("sha256")), ignorenulls=True).over(w))
    if state is None:
        return out
    old = small(state.select("feed_url", F.col("sha256").alias("__sha")))
    return out.join(old, "feed_url", "left").withColumn("known", F.coalesce("known", "__sha")).drop("__sha")


def feed_state(raw: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """feed_url, etag, last_modified, sha256, fetched_at, status after all of ``raw``, from ``state`` on.

    A changed response brings its own validators. One that is unchanged (304, or the known body) keeps those that it
    doesn't name. A failure forgets them, and keeps the sha256. Folding a state with what came later gives the same as
    folding all at once.
    """
    seq = F.struct("fetched_at", "seq")
    full = (F.col("status") == 200) & F.col("sha256").isNotNull()
    ok = full | (F.col("status") == 304)
    anew = ~ok | (full & ~F.col("sha256").eqNullSafe(F.col("known")))
    named = lambda c: F.max(F.when(ok & F.col(c).isNotNull(), F.struct(seq.alias("at"), F.col(c).alias("is")))).alias(f"__{c}")
    new = followed(raw, state).groupBy("feed_url").agg(
        F.max(F.when(anew, seq)).alias("__anew"), named("etag"), named("last_modified"), F.max_by("sha256", F.when(full, seq)).alias("__sha"),
        F.max("fetched_at").alias("__at"), F.max_by("status", seq).alias("__status"),
    )
    if state is None:
        none = F.lit(None).cast("string")
        both = new.withColumns({"etag": none, "last_modified": none, "sha256": none, "fetched_at": F.col("__at"), "status": F.col("__status")})
    else:
        both = state.join(new, "feed_url", "full")
    kept = lambda c: F.when(F.col("__anew").isNull(), F.coalesce(F.col(f"__{c}")["is"], F.col(c))).when(F.col(f"__{c}")["at"] >= F.col("__anew"), F.col(f"__{c}")["is"]).alias(c)
    return both.select("feed_url", kept("etag"), kept("last_modified"), F.coalesce("__sha", "sha256").alias("sha256"), F.coalesce("__at", "fetched_at").alias("fetched_at"), F.coalesce("__status", "status").alias("status"))


def user_state(events: DataFrame) -> DataFrame:
    """item_id, read_at, saved_at from events (item_id, field read|saved, on, ts, seq): the last event of each field decides."""
    at = lambda f: F.max_by(F.when(F.col("on"), F.col("ts")), F.when(F.col("field") == f, F.struct("ts", "seq")))
    return events.groupBy("item_id").agg(at("read").alias("read_at"), at("saved").alias("saved_at"))


def keep_last_good(old: DataFrame, new: DataFrame, group: str, together: list[list[str]]) -> DataFrame:
    """Groups replaced as ``together`` says; nothing new at all, or an empty lot, keeps the old rows of that lot."""
    present = {r[0] for r in new.select(group).distinct().collect()}  # the kinds of securities: a handful
    replaced = [g for lot in together if present & set(lot) for g in lot]
    return old.filter(~F.col(group).isin(*replaced)).unionByName(new) if replaced else old
