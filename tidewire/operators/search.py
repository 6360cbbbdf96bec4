"""Search: prefix terms ranked by BM25 over postings, and plain substrings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import constants as C
from tidewire.functions.text import fold, folded, words
from tidewire.operators.board import payload
from tidewire.operators.images import export_path
from tidewire.session import small, written

K1, B = 1.2, 0.75


def postings(items: DataFrame) -> DataFrame:
    """id, length (the document's words), token, tf_title, tf_teaser."""
    t, b = words(F.coalesce("title", F.lit(""))), words(F.coalesce("teaser", F.lit("")))
    split = items.select("id", t.alias("t"), b.alias("b")).withColumn("length", F.size("t") + F.size("b"))
    tagged = split.select("id", "length", F.explode(F.concat(F.transform("t", lambda w: F.struct(w.alias("token"), F.lit(1).alias("x"))), F.transform("b", lambda w: F.struct(w.alias("token"), F.lit(0).alias("x"))))).alias("w"))
    return tagged.groupBy("id", "length", F.col("w.token").alias("token")).agg(F.sum("w.x").alias("tf_title"), F.sum(1 - F.col("w.x")).alias("tf_teaser"))


def query_words(query: str) -> list[str]:
    """The folded query's words; quotes, operators and other signs have no meaning."""
    return re.findall(r"[a-z0-9]+", folded(query))


def lengths(items: DataFrame) -> DataFrame:
    """id, length: each item's words."""
    return items.select("id", (F.size(words(F.coalesce("title", F.lit("")))) + F.size(words(F.coalesce("teaser", F.lit(""))))).cast("long").alias("length"))


def figures(items: DataFrame, posts: DataFrame) -> DataFrame:
    """One row n (items), words (of all): what BM25 needs of the collection, from postings without another look at texts."""
    return items.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(posts.agg(F.coalesce(F.sum(F.col("tf_title") + F.col("tf_teaser")), F.lit(0)).alias("words"))))


def bm25(posts: DataFrame, size: DataFrame, query: str, weights: tuple[float, float] = (1.0, 1.0), dead: DataFrame | None = None) -> DataFrame:
    """id, score (negative, best first) of items in which every word of ``query`` begins a token.

    Postings are filtered by prefix before anything is shuffled; of postings that are sorted by token only row groups
    that may hold a prefix are read. ``size``: figures() of the collection. ``dead``: id, below: postings of these items
    in batches before that number don't count any more.
    """
    terms = query_words(query)
    if not terms:
        return posts.select("id", F.lit(0.0).alias("score")).limit(0)
    hit = posts.filter(" OR ".join(f"startswith(token, '{t}')" for t in terms))
    if dead is not None:
        hit = hit.join(small(dead), "id", "left").filter(F.col("below").isNull() | (F.col("batch") >= F.col("below")))
    tagged = hit.withColumn("term", F.explode(F.filter(F.array(*map(F.lit, sorted(set(terms)))), lambda t: F.col("token").startswith(t))))
    per = tagged.groupBy("id", "term").agg(F.max("length").alias("d"), F.sum(F.col("tf_title") * weights[0] + F.col("tf_teaser") * weights[1]).alias("f"))
    df = per.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row a query word
    both = per.join(F.broadcast(df), "term").join(F.broadcast(size.select("n", (F.col("words") / F.col("n")).alias("avg"))))
    times = F.element_at(F.create_map(*(F.lit(x) for t in set(terms) for x in (t, float(terms.count(t))))), F.col("term"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = times * idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("d") / F.col("avg")))
    return both.groupBy("id").agg(F.sum(part).alias("s"), F.count(F.lit(1)).alias("k")).filter(F.col("k") == len(set(terms))).select("id", (-F.col("s")).alias("score"))


def ranged(posts: DataFrame) -> DataFrame:
    """``posts`` sorted over all tasks by token, so that a file, and in it a row group, holds one range of tokens."""
    return posts.repartitionByRange("token", "id").sortWithinPartitions("token", "id")


def search(items: DataFrame, query: str, limit: int = C.SEARCH_LIMIT, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """``items`` that match, best first, newest first among equals."""
    posts = written(postings(items), "postings")
    return items.join(bm25(posts, figures(items, posts), query, weights), "id").orderBy("score", F.desc("published_at"), "id").limit(limit)


def found(
    items: DataFrame, sources: DataFrame, state: DataFrame, query: str, saved_only: bool = False, posts: DataFrame | None = None, size: DataFrame | None = None, dead: DataFrame | None = None,
    limit: int = C.SEARCH_LIMIT, weights: tuple[float, float] = (1.0, 1.0),
) -> DataFrame:
    """The client's fields of matching items with their source and state, in order. ``weights``: of a word in the title and in the teaser.

    A blank query finds what is saved, last saved first, if only that is asked for, and else nothing. ``posts``, ``size``
    and ``dead``: a stored index (see bm25); without it postings are made from ``items``.
    """
    known = sources.select(F.col("key").alias("source_key"), F.col("name").alias("source_name"))
    state = state.select(F.col("item_id").alias("id"), "read_at", "saved_at")
    if not query.strip():
        rows = items.join(state.filter(F.col("saved_at").isNotNull()), "id").orderBy(F.desc("saved_at"), "id").limit(limit if saved_only else 0)
        return payload(rows.join(small(known), "source_key").orderBy(F.desc("saved_at"), "id"))
    if posts is None:
        posts = written(postings(items), "postings")
    hits = bm25(posts, figures(items, posts) if size is None else size, query, weights, dead)
    rows = items.join(hits, "id").join(state, "id", "left").join(small(known), "source_key")
    rows = rows.filter(F.col("saved_at").isNotNull()) if saved_only else rows
    return payload(rows.orderBy("score", F.desc("published_at"), "id").limit(limit))


def exported(items: DataFrame, sources: DataFrame, as_of: Column, days: int = C.ARCHIVE_DAYS) -> DataFrame:
    """The index of a static copy: items of the last ``days`` as a client sees them, tiles by their place in the copy."""
    known = small(sources.select(F.col("key").alias("source_key"), F.col("name").alias("source_name")))
    rows = archive(items, as_of, days).join(known, "source_key").withColumn("read_at", F.lit(None).cast("timestamp")).withColumn("saved_at", F.lit(None).cast("timestamp"))
    seen = payload(rows, more=(F.col("published_at").alias("publishedAt"),)).withColumn("image", export_path(F.col("image"), F.col("id")))
    return seen.select("id", "title", "teaser", "url", "source", "topic", "topicLabel", "kicker", "image", "meta", "dateShort", "time", "publishedAt")


def contains(items: DataFrame, query: str, limit: int = C.SEARCH_LIMIT) -> DataFrame:
    """``items`` whose title and teaser hold the query, both folded as the client does; a blank query finds all."""
    where = fold(F.concat_ws(" ", "title", "teaser"), nordic=False)
    return items.filter(where.contains(fold(F.lit(query.strip()), nordic=False))).orderBy(F.desc("published_at"), "id").limit(limit)


def saved(items: DataFrame, state: DataFrame) -> DataFrame:
    return items.join(state.filter(F.col("saved_at").isNotNull()).select(F.col("item_id").alias("id"), "saved_at"), "id").orderBy(F.desc("saved_at"), "id")


def archive(items: DataFrame, as_of: Column, days: int = C.ARCHIVE_DAYS) -> DataFrame:
    return items.filter(F.col("published_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")).orderBy(F.desc("published_at"), "id")
