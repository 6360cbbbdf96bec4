"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

A document's set holds its distinct word shingles. Its sketch comes from rounds of hashed bin placement: in round i each
shingle falls into one hashed bin with the value (i, hash), rounds from t on put all of them into bin i - t, and a bin
keeps its least value; so every coordinate is filled after a few rounds, and the share of agreeing coordinates is
concentrated about the Jaccard similarity. Bands of coordinates give candidates, chosen so that a pair at the threshold
is missed with a chance of at most MISS. Nothing else is left to chance: candidates are confirmed on their full sets.

Equal sets are one node from the start, so copies are never paired. Pairs are never listed as rows. Nodes that share a
bucket gather about a home (the least node of their buckets, passed on once more from bucket to bucket), and a task
compares a block of a home's nodes on their full sets. It handles sets as differences to the block's majority set: two
nodes whose differences have nothing in common are judged by sizes alone, and the others are found by an inverted index
on the differing shingles. Only links that join components leave the task, fewer than it has nodes. Homes of several
blocks then compare the nodes outside their largest component with all their blocks, and buckets whose nodes ended at
different homes and in different components are compared in the same way. So each pair of a bucket is either in one
component already, or judged exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm._shared import BROADCAST_ROWS, hashed_words, lookup, materialize, mixed, release, small_batches, table, text_of
from tidewire.operators.components import connected

#: Chance that banding misses a pair at the threshold; most coordinates.
MISS, COORDINATES = 1e-7, 512
#: Nodes and shingles that a task compares at once, roughly.
ROWS, SHINGLES = 512, 1 << 21
#: Elements that are looked up in another set at once.
LOOKED_UP = 1 << 20

_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows of each): as many rows as COORDINATES allow at MISS."""
    best = (1, 1)
    for rows in range(1, 33):
        bands = ceil(log(MISS) / log(1 - (percent / 100) ** rows))
        if bands * rows <= COORDINATES:
            best = (bands, rows)
    return best


def shingles(texts: list[str], size: int) -> list[np.ndarray]:
    """Of each text the sorted 64-bit hashes of its distinct shingles; fewer words than ``size`` are one shingle; no words, none."""
    found = [*hashed_words([t.encode("utf-8", "replace").lower() for t in texts])]  # bytes: A-Z and ASCII white space only
    owner, words = (np.concatenate(x) if x else np.empty(0, np.int64) for x in ([o for o, _ in found], [h for _, h in found]))
    ends = np.searchsorted(owner, np.arange(len(texts)), side="right").tolist()

    def hashed(ids: np.ndarray, k: int) -> np.ndarray:
        h = np.full(max(0, len(ids) - k + 1), k, np.uint64)
        for j in range(k):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + ids[j : len(ids) - k + 1 + j])
        return h

    every, out, at = hashed(words, size), [], 0
    for end in ends:
        n = end - at
        out.append(np.unique(every[at : end - size + 1]) if n >= size else hashed(words[at:end], n) if n else np.empty(0, np.uint64))
        at = end
    return out


def sketch(s: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates of a set that isn't empty."""
    out = np.full(t, _MAX)
    step = max(1, min(2 * t, int(1.5 * t * log(t)) // len(s)))
    for i in range(0, 2 * t, step):
        rounds = np.arange(i, min(2 * t, i + step), dtype=np.uint64)
        h = mixed(s[None, :] ^ mixed(rounds + np.uint64(1))[:, None])
        bins = np.where((rounds < t)[:, None], ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32), (rounds - np.uint64(t))[:, None])
        np.minimum.at(out, bins.ravel().astype(np.int64), ((rounds << np.uint64(44))[:, None] | (mixed(h) >> np.uint64(20))).ravel())
        if out.max() != _MAX:
            break
    return out


def sketched(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node (128-bit hash of the set), bands, and further columns of ``docs``; node and bands null for empty sets."""
    bands, rows = bands_for(percent)
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for s in shingles(batch.column("text").to_pylist(), size):
                sizes.append(len(s))
                if not len(s):
                    nodes.append(None)
                    keys.append(None)
                    continue
                own = sketch(s, bands * rows)
                h = np.arange(bands, dtype=np.uint64)
                for column in own.reshape(bands, rows).T:
                    h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + column)
                nodes.append(blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), *map(batch.column, more)],
                names=["doc_id", "n_shingles", "node", "bands", *more],
            )

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, k) for c, k in (("n_shingles", T.LongType()), ("node", T.BinaryType()), ("bands", T.ArrayType(T.LongType())))), *(docs.schema[c] for c in more)])
    return docs.select("doc_id", text_of().alias("text"), *more).mapInArrow(run, schema)


class _Joined:
    """Union-find over places, each path halved as it is walked."""

    def __init__(self, labels: np.ndarray):
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels.tolist())]

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def n_common(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted sets share; a bounded part of the smaller one is looked up at a time."""
    x, y = (x, y) if len(x) > len(y) else (y, x)
    parts = (y[i : i + LOOKED_UP] for i in range(0, len(y), LOOKED_UP))
    return sum(int((x[np.minimum(np.searchsorted(x, p), len(x) - 1)] == p).sum()) for p in parts)


def spanning(sets: list[np.ndarray], labels: np.ndarray, askers: np.ndarray, percent: int, main: int | None = None) -> list[tuple[int, int]]:
    """Links between the ``sets`` (sorted, not empty), enough to join all that links join; ``labels``: what is one already.

    Links are looked for that have one of ``askers`` (places of sets) at an end and different labels. An asker that is
    found to be one with ``main`` (a place; if all ask, the asker nearest the majority) asks no more: its links to what
    is not are seen from there. With c the majority set and d(x) what x and c don't share, the symmetric difference of x and y has
    |d(x)| + |d(y)| - 2 |d(x) and d(y)| shingles; the last term is counted by an inverted index.
    """
    n = len(sets)
    if n == 2:
        both = n_common(*sets)
        return [(0, 1)] if labels[0] != labels[1] and 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both) else []
    size = np.fromiter(map(len, sets), np.int64, n)
    _, element, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    common = 2 * held > n
    lacks = np.ones((n, int(common.sum())), bool)
    column = np.cumsum(common) - 1
    here = common[element]
    lacks[owner[here], column[element[here]]] = False
    without, what = np.nonzero(lacks)
    apart = np.bincount(owner[~here], minlength=n) + np.bincount(without, minlength=n)
    shared = ~here & (held[element] > 1)
    owner, element = np.concatenate([owner[shared], without]), np.concatenate([element[shared], np.flatnonzero(common)[what]])
    del lacks, here, shared, without, what
    order = np.argsort(element, kind="stable")
    holders, starts = owner[order], np.searchsorted(element[order], np.arange(len(held) + 1))
    order = np.argsort(owner, kind="stable")
    own, own_at = element[order], np.searchsorted(owner[order], np.arange(n + 1))
    joined, links = _Joined(labels), []
    # those near the majority come first: what they link needs no look of its own
    askers = askers[np.argsort(((100 + percent) * apart - (100 - percent) * size)[askers], kind="stable")].tolist()
    if main is None and len(askers) == n:
        main = askers[0]
    for x in askers:
        if main is not None and x != main and joined.root(x) == joined.root(main):
            continue
        e = own[own_at[x] : own_at[x + 1]]
        length = starts[e + 1] - starts[e]
        ends = np.cumsum(length)
        both = np.bincount(holders[np.arange(ends[-1]) + np.repeat(starts[e] - ends + length, length)], minlength=n) if len(e) else 0
        differ, sizes = apart[x] + apart - 2 * both, size[x] + size
        for y in np.flatnonzero(100 * (sizes - differ) >= percent * (sizes + differ)).tolist():
            if joined.join(x, y):
                links.append((x, y))
    return links


def _cells(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b: roots) that the cells of ``rows`` need to be joined: group, block, part, rid, root, asks, main, set.

    Those that ask are compared with all of their cell. main: the group's root of the largest component, if it has one.
    """

    def run(cell: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        roots, asks = cell.column("root").to_numpy(), cell.column("asks").to_numpy()
        if len(roots) > 1 and roots.min() != roots.max() and asks.any():
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in cell.column("set")]
            main = np.flatnonzero(cell.column("main").to_numpy() == roots)
            out = [(int(roots[x]), int(roots[y])) for x, y in spanning(sets, roots, np.flatnonzero(asks), percent, int(main[0]) if len(main) else None)]
        a, b = zip(*out, strict=True) if out else ([], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("group", "block", "part").applyInArrow(run, "a long, b long")


def _blocks(groups: DataFrame, rows: int, shingles: int) -> DataFrame:
    """``groups`` (n, shingles, ...) with the number of their blocks."""
    return groups.withColumn("blocks", F.greatest(F.ceil(F.col("n") / rows), F.ceil(F.col("shingles") / shingles)).cast("int"))


def _block(rid: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(rid, F.lit(3)), F.col(blocks)).cast("int")


def _crossed(own: DataFrame, sets: DataFrame, percent: int, rows: int, shingles: int) -> DataFrame:
    """Links (a, b: roots) between the nodes of each group of ``own`` (group, rid, root, n): those outside the group's largest component against all.

    Blocks of askers meet blocks of all, so rows are nodes times blocks of askers and askers times blocks.
    """
    parts = own.groupBy("group", "root").agg(F.count(F.lit(1)).alias("of"), F.sum("n").alias("shingles"))
    most = F.max_by("root", F.struct("of", -F.col("root")))
    stats = parts.groupBy("group").agg(most.alias("main"), F.count(F.lit(1)).alias("kinds"), F.sum("of").alias("n"), F.sum("shingles").alias("shingles"), F.max(F.struct("of", -F.col("root"), "shingles")).alias("top")).filter("kinds > 1")
    stats = _blocks(stats, rows, shingles).withColumn("asking", F.greatest(F.ceil((F.col("n") - F.col("top.of")) / rows), F.ceil((F.col("shingles") - F.col("top.shingles")) / shingles)).cast("int"))
    stats = materialize(stats.select("group", "main", "n", "blocks", "asking"), "groups")
    if stats.isEmpty():
        return own.sparkSession.createDataFrame([], "a long, b long")
    placed = lookup(own.select("group", "rid", "root"), stats, "group", "n", own.count()).filter("main is not null")
    every = placed.select("group", "rid", "root", "main", F.lit(False).alias("asks"), _block("rid", "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("part"))
    asking = placed.filter("root <> main").select("group", "rid", "root", "main", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), _block("rid", "asking").alias("part"))
    return _cells(every.unionByName(asking).join(sets, "rid"), percent)


def groups(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = ROWS, shingles: int = SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    component_id is the least doc_id reachable over links of at least ``percent`` per cent Jaccard similarity between
    sets of ``size``-word shingles; kept: it is the row's own. Rows without words (null, empty) link with nothing.
    Repeated rows are one node; a row with a null doc_id takes part but never names a component of others. Texts of any
    length are used whole; an empty table gives no rows. ``rows`` and ``shingles`` bound what a task compares at once and
    change no result.
    """
    return _grouped(docs, size, percent, rows, shingles).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, size: int, percent: int, rows: int = ROWS, shingles: int = SHINGLES) -> DataFrame:
    """groups() with root (one for each component, null without words) and further columns of ``docs``."""
    made = materialize(sketched(docs, size, percent), "sketches")
    reps = made.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    reps = materialize(reps.withColumn("rid", F.monotonically_increasing_id()), "reps")

    placed = reps.select("rid", F.posexplode("bands").alias("band", "h")).select("rid", F.xxhash64("band", "h").alias("key"))
    buckets = materialize(placed.groupBy("key").agg(F.min("rid").alias("a"), F.max("rid").alias("z"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    large = buckets.filter("n > 2").select("key", "a", "n")
    n_large = large.count()
    members = placed.join(F.broadcast(large), "key") if n_large <= BROADCAST_ROWS else lookup(placed, large, "key", "n", reps.count() * bands_for(percent)[0]).filter("a is not null")
    pairs = buckets.filter("n = 2").select("key", F.explode(F.array("a", "z")).alias("rid"), "a", "n")
    members = materialize(members.select("key", "rid", "a", "n").unionByName(pairs), "members")

    # homes: the least node of a node's buckets, and what is least among those of its buckets' nodes
    total = members.count()
    first = members.groupBy("rid").agg(F.min("a").alias("first"))
    least = members.join(first, "rid").groupBy("key").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n"))
    homes = lookup(members.select("key", "rid"), materialize(least, "least"), "key", "n", total).groupBy("rid").agg(F.min("least").alias("home"))
    homes = materialize(homes.join(reps.select("rid", "n"), "rid"), "homes")
    stats = materialize(_blocks(homes.groupBy("home").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).withColumnRenamed("members", "n"), rows, shingles).select("home", F.col("n").alias("members"), "blocks"), "groups")
    sets = materialize(_sets(docs, homes.select("rid").join(reps.select("rid", "first", "node"), "rid"), size), "sets")

    # a block of a home's nodes and the home itself in a task
    own = lookup(homes, stats, "home", "members", homes.count())
    own = own.filter("rid <> home").select(F.col("home").alias("group"), _block("rid", "blocks").alias("block"), "rid")
    hubs = stats.select(F.col("home").alias("group"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("home").alias("rid"))
    cells = own.unionByName(hubs).join(sets, "rid").select("group", "block", F.lit(0).alias("part"), "rid", F.col("rid").alias("root"), F.lit(True).alias("asks"), F.lit(None).cast("long").alias("main"), "set")
    labels = _relabel(None, materialize(_cells(cells, percent), "links"))

    # homes of several blocks, then buckets with several homes: what is in different components still
    wide = stats.filter("blocks > 1")
    if not wide.isEmpty():
        own = _rooted(lookup(homes, wide, "home", "members", homes.count()).filter("blocks is not null").select(F.col("home").alias("group"), "rid", "n"), labels)
        labels = _relabel(labels, materialize(_crossed(own, sets, percent, rows, shingles), "links"))
    own = members.select(F.col("key").alias("group"), "rid").join(homes, "rid")
    several = own.groupBy("group").agg(F.min("home").alias("h0"), F.max("home").alias("h1"), F.count(F.lit(1)).alias("members")).filter("h0 <> h1").select("group", "members")
    own = materialize(lookup(own, materialize(several, "several"), "group", "members", total).filter("members is not null").select("group", "rid", "n"), "mixed")
    if not own.isEmpty():
        labels = _relabel(labels, materialize(_crossed(_rooted(own, labels), sets, percent, rows, shingles), "links"))

    named = reps.select("rid", "node", "first", "copies")
    named = named.join(labels.withColumnRenamed("v", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    # most nodes are alone and need no second look
    least = named.join(labels.select(F.col("v").alias("rid")), "rid", "left_semi").groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("of"))
    named = lookup(named, materialize(least, "least"), "root", "of", reps.count()).withColumn("component_id", F.coalesce("least", "first"))
    named = materialize(named.select("node", "component_id", "copies", "root"), "named")
    release(reps, buckets, members, homes, stats, sets, labels)
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = lookup(made.select("doc_id", "n_shingles", "node", *more), named, "node", "copies", made.count()).withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "root", *more)


def _rooted(own: DataFrame, labels: DataFrame) -> DataFrame:
    """``own`` with each node's root."""
    return materialize(own.join(labels.withColumnRenamed("v", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid")), "rooted")


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """v, root (the least node reachable), after ``links`` (a, b) between roots: components of the contracted graph."""
    more = connected(links).withColumnRenamed("id", "v")
    if labels is None:
        return materialize(more, "labels")
    if links.isEmpty():
        return labels
    next_ = more.select(F.col("v").alias("root"), F.col("root").alias("next"))
    sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("of"))
    new = lookup(labels, next_.join(sizes, "root"), "root", "of", labels.count()).select("v", F.coalesce("next", "root").alias("root"))
    alone = more.join(labels.select("v"), "v", "left_anti")
    return materialize(new.unionByName(alone), "labels")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """rid, set (sorted hashes) of the ``wanted`` nodes (rid, first, node), from the text of a document that has that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = [], []
            for rid, node, found in zip(batch.column("rid"), batch.column("node"), shingles(batch.column("text").to_pylist(), size), strict=True):
                s = found.tobytes()
                if blake2b(s, digest_size=16).digest() == node.as_py():  # a doc_id may stand for several texts
                    ids.append(rid.as_py())
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["rid", "set"])

    rows = docs.select(F.col("doc_id").alias("d"), text_of().alias("text")).join(wanted, F.col("d").eqNullSafe(F.col("first")))
    return rows.select("rid", "node", "text").mapInArrow(run, "rid long, set binary").dropDuplicates(["rid"])


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, that with the least doc_id; of rows that repeat it one; all columns of ``docs``.

    Rows with a null doc_id stay, as nothing tells them apart. The kept rows come back by a join on doc_id and a digest
    of the text, as a doc_id may stand for several texts.
    """
    docs = docs.withColumn("__tw_d", F.unhex(F.md5(text_of().cast("binary"))))
    found = _grouped(docs.select("doc_id", "text", "__tw_d"), size, percent).filter(F.col("doc_id").isNotNull() & F.col("kept"))
    own = found.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct("doc_id", "__tw_d")).alias("k")).select("k.*")
    stay = own.unionByName(found.filter(F.col("root").isNull()).select("doc_id", "__tw_d")).distinct()
    rest = docs.filter(F.col("doc_id").isNotNull()).join(stay, ["doc_id", "__tw_d"], "left_semi").dropDuplicates(["doc_id", "__tw_d"])
    return rest.unionByName(docs.filter(F.col("doc_id").isNull())).drop("__tw_d")


def op8_near_dup(spark, sf_dir: str) -> DataFrame:
    """Every document's component at three-word shingles and 85 per cent."""
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w),
g AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 85 * (len(x.sh) + len(y.sh) - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM s JOIN r ON a = doc_id GROUP BY doc_id, sh
"""
