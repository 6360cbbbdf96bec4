"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected onto several random sets of orthogonal directions, shifted at random, and put on a Hilbert curve
each time. Neighbours tend to be near each other on one of the curves. Spark orders each curve by ranges of the key;
a vector's rank tells its block, a query goes to the blocks that its window of ranks touches, and there the nearest are
found. The curves' lists are merged at the end, with exact distances. Vectors of each length are searched among their own.

How far apart on the curves neighbours lie depends on the table, so the windows are measured on it: the true neighbours
of a sample of queries are found by comparing all, and for each number of curves the window is the one within which
RECALL of them lie on one of these curves. The number of curves is taken that looks at the fewest ranks. There is one way
at every size: where neighbours have no contrast, windows are wide.

Windows are searched in two steps. Blocks hold one byte a component with the length of what rounding took away, which
bounds each distance from both sides; only points that may be among the nearest by these bounds meet the full vectors.
A block that many queries ask is searched in parts, each with a bounded number of them.

Equal vectors are one point with its smallest ids, so a vector that a third of the rows share is looked at once, and
asked for once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidewire.llm._shared import lookup, materialize, maybe_broadcast, release, table

#: Neighbours; curves; dimensions and bits of each; ranks of a block, at least and at most.
K, CURVES, DIMENSIONS, BITS, BLOCK, LARGEST_BLOCK = 10, 20, 8, 7, 2000, 20_000
#: Share of the sampled queries' neighbours that the window must hold; queries of the sample.
RECALL, PROBES = 0.95, 256
#: Fewest curves, if so many are allowed.
FEWEST_CURVES = 4
#: Queries that are multiplied with a block at once; queries of a task, at most.
QUERIES, ASKERS = 128, 4096
SEED = 20240131
#: Points that the projections' scales are taken from, at most.
SAMPLE = 20_000


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Keys on the Hilbert curve of points with unsigned coordinates of ``bits`` bits (rows x dimensions)."""
    x = x.astype(np.uint32).copy()
    n, d = x.shape
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        low = q - np.uint32(1)
        for i in range(d):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
        q >>= np.uint32(1)
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.uint32)
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        flip ^= np.where((x[:, d - 1] & q) != 0, q - np.uint32(1), 0).astype(np.uint32)
        q >>= np.uint32(1)
    x ^= flip[:, None]
    key = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << np.uint64(1)) | ((x[:, i] >> np.uint32(b)) & np.uint32(1)).astype(np.uint64)
    return key


def projections(dim: int, curves: int) -> np.ndarray:
    """curves x dim x DIMENSIONS: orthonormal directions, from a fixed seed."""
    rng = np.random.default_rng(SEED)
    return np.stack([np.linalg.qr(rng.normal(size=(dim, max(dim, DIMENSIONS))))[0][:, :DIMENSIONS] if dim >= DIMENSIONS else rng.normal(size=(dim, DIMENSIONS)) for _ in range(curves)])


def components(vectors: DataFrame) -> Column:
    """The vectors, as floats if they are stored so (half the shuffle; distances are exact in double all the same), with 0 for -0."""
    kind = vectors.schema["embedding"].dataType
    kind = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    return F.transform(F.col("embedding").cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (see components) of the rows that take part: no null ids and vectors, no zero vector, no null or non-finite component."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), components(vectors).alias("vec")).filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    )


def points(rows: DataFrame, keep: int) -> DataFrame:
    """vec (its components as they are, floats or doubles), ids (the ``keep`` smallest ids): one row for each different vector of usable().

    Tasks first cut the ids of their own equal vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[bytes, list[int]] = {}
            ids = batch.column("vec_id").to_pylist()
            for i, x in zip(ids, batch.column("vec"), strict=True):
                own.setdefault(np.asarray(x.values).tobytes(), []).append(i)
            kind = batch.column("vec").type.value_type
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.frombuffer(x, kind.to_pandas_dtype()) for x in own], pa.list_(kind)), pa.array([sorted(set(i))[:keep] for i in own.values()], pa.list_(pa.int64()))], names=["vec", "ids"]
            )

    cut = rows.mapInArrow(run, T.StructType([rows.schema["vec"], T.StructField("ids", T.ArrayType(T.LongType()))]))
    some = cut.select("vec", F.explode("ids").alias("id")).withColumn("nth", F.row_number().over(W.partitionBy("vec").orderBy("id"))).filter(F.col("nth") <= keep)
    return some.groupBy("vec").agg(F.array_sort(F.array_distinct(F.collect_list("id"))).alias("ids"))


class Nearest:
    """The ``k`` nearest points of each of ``queries`` (rows x dimensions) among those looked at, with all ties to the smaller id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k, self.squares = queries, k, (queries**2).sum(1)
        self.score = np.full((len(queries), k), np.inf)
        self.point, self.first = np.zeros((2, len(queries), k), np.int64)

    def look(self, points: np.ndarray, first: np.ndarray, vectors: np.ndarray) -> None:
        """``first``: the points' ids."""
        norms = (vectors**2).sum(1)
        if not len(norms):
            return
        slack = 1e-9 * (1 + norms.max())
        k = self.k
        for at in range(0, len(self.q), QUERIES):
            s = slice(at, at + QUERIES)
            rough = norms - 2 * (self.q[s] @ vectors.T)
            bound = self.score[s, -1] ** 2 - self.squares[s]
            if not np.isfinite(bound).all() and len(norms) > k:
                bound = np.minimum(bound, np.partition(rough, k - 1, axis=1)[:, k - 1])
            near, col = np.nonzero(rough <= (bound + slack + 1e-9 * self.squares[s])[:, None])
            d = np.sqrt(((vectors[col] - self.q[s][near]) ** 2).sum(1))
            n = len(self.score[s])
            of = np.concatenate([np.repeat(np.arange(n), k), near])
            d, p, f = (np.concatenate([x[s].ravel(), y]) for x, y in ((self.score, d), (self.point, points[col]), (self.first, first[col])))
            order = np.lexsort((f, d, of))
            place = np.arange(len(order)) - np.searchsorted(of[order], of[order])
            order = order[place < k]
            self.score[s], self.point[s], self.first[s] = d[order].reshape(n, k), p[order].reshape(n, k), f[order].reshape(n, k)

    def found(self, asked: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, col = np.nonzero(np.isfinite(self.score))
        for at in range(0, len(row), 100_000):
            r, c = row[at : at + 100_000], col[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(asked[r]), pa.array(self.point[r, c]), pa.array(self.first[r, c]), pa.array(self.score[r, c])], names=["asked", "point", "first", "score"])


FOUND = "asked long, point long, first long, score double"


def _matrix(vectors: pa.Array) -> np.ndarray:
    return np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)


def scan(base: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """asked, point, first (its least id), score: of ``asked`` (point, vec; few rows) the ``k`` nearest points among those of each task."""
    own = asked.select("point", "vec").toArrow().combine_chunks()
    shared = base.sparkSession.sparkContext.broadcast((own.column("point").to_numpy(), _matrix(own.column("vec").combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best = Nearest(q, k)
        for batch in batches:
            best.look(batch.column("point").to_numpy(), batch.column("first").to_numpy(), _matrix(batch.column("vec")))
        yield from best.found(ids)

    return base.select("point", F.element_at("ids", 1).alias("first"), "vec").mapInArrow(run, FOUND)


def _first(found: DataFrame, k: int, of: str, then: str) -> DataFrame:
    """The ``k`` rows of each ``of`` with the least score, with their rank; ties go to the smaller ``then``."""
    return found.withColumn("rank", F.row_number().over(W.partitionBy(of).orderBy("score", then))).filter(F.col("rank") <= k)


def reach(base: DataFrame, asked: DataFrame, ranked: DataFrame, k: int, curves: int, n: int) -> tuple[int, int]:
    """(curves, window) of the fewest ranks to look at: the window holds RECALL of the neighbours of about PROBES points asked for on one of the curves."""
    some = asked.filter(F.pmod(F.xxhash64("point", F.lit(5)), F.lit(max(1, asked.count() // PROBES))) == 0).limit(2 * PROBES)
    some = some if not some.isEmpty() else asked.limit(PROBES)
    pairs = materialize(_first(scan(base, some, k + 1), k + 1, "asked", "first").filter("point <> asked").select("asked", "point"), "probes")
    mine = ranked.join(F.broadcast(pairs.select(F.col("asked").alias("point")).distinct()), "point").select(F.col("point").alias("asked"), "curve", F.col("rank").alias("mine"))
    there = ranked.join(F.broadcast(pairs), "point").join(mine, ["asked", "curve"])
    gaps = there.select("asked", "point", "curve", F.abs(F.col("rank") - F.col("mine")).alias("gap")).toPandas()  # at most 2 x PROBES x k x curves rows
    if not len(gaps):
        return min(FEWEST_CURVES, curves), n
    table_ = gaps.pivot(index=["asked", "point"], columns="curve", values="gap").to_numpy()
    windows = np.ceil(np.quantile(np.minimum.accumulate(table_, axis=1), RECALL, axis=0))
    least = min(FEWEST_CURVES, curves) - 1
    best = least + int(np.argmin((windows * np.arange(1, curves + 1))[least:]))
    return best + 1, max(1, int(windows[best]))


NEAREST = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, every: int = 100, k: int = K, curves: int = CURVES, window: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by ``every`` its ``k`` nearest found, by Euclidean distance.

    A ``window`` that is given is used as it is on all ``curves``; else both are measured (``reach``).

    Ties go to the smaller vec_id; a query isn't its own neighbour, though a row with an equal vector is. Rows that
    repeat a vec_id with another vector count as rows of their own. Null, zero and non-finite vectors take no part (see
    usable). Vectors of each length are searched among their own, one length after another, as distances between lengths
    have no meaning. Columns but vec_id and embedding are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    lengths = sorted(r[0] for r in rows.select(F.size("vec").alias("d")).distinct().collect())
    found = [_nearest(rows.filter(F.size("vec") == d), every, k, curves, window, block) for d in lengths]
    out = spark.createDataFrame([], NEAREST)
    for one in found:
        out = one if len(found) == 1 else out.unionByName(one)
    return out


def _rounded(base: DataFrame, sample: np.ndarray) -> DataFrame:
    """point, first, code (a byte a component), off (how far the rounded vector is from the vector), and the frame to read codes by."""
    low = sample.min(0)
    step = np.maximum(sample.max(0) - low, 1e-12) / 255

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            code = np.clip(np.round((x - low) / step), 0, 255).astype(np.uint8)
            off = np.sqrt(((x - (low + step * code)) ** 2).sum(1)) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("point"), batch.column("first"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(off)], names=["point", "first", "code", "off"])

    return base.select("point", F.element_at("ids", 1).alias("first"), "vec").mapInArrow(run, "point long, first long, code binary, off double"), low, step


def _may_be_near(q: np.ndarray, x: np.ndarray, off: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, place, least distance, largest distance) of points at places ``low`` to ``high`` that may be among a query's ``k`` nearest of these."""
    norms, squares, places = (x**2).sum(1), (q**2).sum(1), np.arange(len(x))
    for at in range(0, len(q), QUERIES):
        s = slice(at, at + QUERIES)
        square = norms + squares[s, None] - 2 * (q[s] @ x.T)
        slack = 1e-12 * x.shape[1] * (norms + squares[s, None])
        outside = (places < low[s, None]) | (places >= high[s, None])
        least, most = np.sqrt(np.maximum(square - slack, 0)) - off, np.sqrt(np.maximum(square + slack, 0)) + off
        least[outside] = most[outside] = np.inf
        bound = np.partition(most, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(most), np.inf)
        near, col = np.nonzero((least <= bound[:, None]) & ~outside)
        yield near + at, col, least[near, col], most[near, col]


def _nearest(rows: DataFrame, every: int, k: int, curves: int, window: int | None, block: int) -> DataFrame:
    """nearest() of vectors of one length."""
    spark = rows.sparkSession
    base = points(rows, k + 1)
    base = materialize(base.withColumn("point", F.monotonically_increasing_id()), "points")
    n = base.count()
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec")
    asked = materialize(base.join(queries.groupBy("vec").agg(F.count(F.lit(1)).alias("queries")), "vec").select("point", "vec", "queries"), "asked")
    queries = lookup(queries, asked, "vec", "queries", asked.agg(F.coalesce(F.sum("queries"), F.lit(0))).first()[0])
    queries = materialize(queries.select("query_id", "point").distinct(), "queries")

    sample = base.select("vec").filter(F.pmod(F.xxhash64("point"), F.lit(max(1, n // SAMPLE))) == 0).limit(2 * SAMPLE).toPandas()["vec"]
    sample = np.stack((sample if len(sample) else base.select("vec").limit(1).toPandas()["vec"]).to_numpy()).astype(np.float64)
    matrix = projections(sample.shape[1], curves)
    shifts = np.random.default_rng(SEED + 1).random((curves, DIMENSIONS))
    ranges = [np.quantile(sample @ m, [0.001, 0.999], axis=0) for m in matrix]
    low, wide = np.stack([r[0] for r in ranges]), np.stack([np.maximum(r[1] - r[0], 1e-12) for r in ranges])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            for c in range(curves if len(x) else 0):
                y = (x @ matrix[c] - low[c] + shifts[c] * wide[c]) / (2 * wide[c])
                h = hilbert(np.clip(y * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint32), BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), c, np.int32)), pa.array(h.astype(np.int64)), batch.column("point")], names=["curve", "key", "point"])

    placed = base.select("point", "vec").mapInArrow(keys, "curve int, key long, point long")
    # ranks on each curve: ranges of keys are sorted, numbered, and moved by the sizes of the ranges before them
    ordered = placed.repartitionByRange(F.col("curve"), F.col("key"), F.col("point")).sortWithinPartitions("curve", "key", "point")
    ordered = materialize(ordered.withColumn("range", F.spark_partition_id()), "curves")
    before = ordered.groupBy("curve", "range").count().withColumn("base", F.sum("count").over(W.partitionBy("curve").orderBy("range")) - F.col("count")).drop("count")
    ranked = ordered.join(F.broadcast(before), ["curve", "range"]).withColumn("rank", F.col("base") + F.row_number().over(W.partitionBy("curve", "range").orderBy("key", "point")) - 1).select("curve", "point", "rank")
    ranked = materialize(ranked, "ranks")
    release(ordered)
    if window is None:
        curves, window = reach(base, asked, ranked, k, curves, n)
        block = max(block, min(window, LARGEST_BLOCK))
    ranked = ranked.filter(F.col("curve") < curves)

    codes, origin, step = _rounded(base, sample)
    windows = F.sequence(F.floor(F.greatest(F.col("rank") - window, F.lit(0)) / block), F.floor(F.least(F.col("rank") + window, F.lit(n - 1)) / block))
    asks = asked.select("point", "vec").join(ranked, "point").select("curve", F.explode(windows).alias("block"), "point", "rank", "vec")
    # blocks that are asked, each in as many parts as its askers need
    load = materialize(asks.groupBy("curve", "block").agg(F.ceil(F.count(F.lit(1)) / ASKERS).alias("parts")), "load")
    load = maybe_broadcast(load, load.count())
    asks = asks.join(load, ["curve", "block"]).select("curve", "block", F.pmod(F.xxhash64("point", F.lit(3)), F.col("parts")).alias("part"), F.lit(True).alias("asks"), "point", F.lit(0).cast("long").alias("first"), "rank", "vec", F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("off"))
    held = ranked.withColumn("block", F.floor(F.col("rank") / block)).join(load, ["curve", "block"]).join(codes, "point")
    held = held.select("curve", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), "point", "first", "rank", F.lit(None).cast(base.schema["vec"].dataType).alias("vec"), "code", "off")

    def search(cell: pa.Table) -> pa.Table:
        ask = cell.column("asks").to_numpy(zero_copy_only=False)
        own, there = cell.filter(pa.array(ask)), cell.filter(pa.array(~ask)).sort_by("rank")
        schema = pa.schema([("asked", pa.int64()), ("point", pa.int64()), ("first", pa.int64()), ("least", pa.float64()), ("most", pa.float64())])
        if not len(own) or not len(there):
            return schema.empty_table()
        q, rank, mine = _matrix(own.column("vec").combine_chunks()), there.column("rank").to_numpy(), own.column("rank").to_numpy()
        code = np.frombuffer(b"".join(there.column("code").to_pylist()), np.uint8).reshape(len(there), -1)
        names = own.column("point").to_numpy(), there.column("point").to_numpy(), there.column("first").to_numpy()
        near = _may_be_near(q, origin + step * code, there.column("off").to_numpy(), np.searchsorted(rank, mine - window), np.searchsorted(rank, mine + window, side="right"), k + 1)
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(names[0][i]), pa.array(names[1][j]), pa.array(names[2][j]), pa.array(a), pa.array(b)], schema=schema) for i, j, a, b in near], schema)

    found = held.unionByName(asks).groupBy("curve", "block", "part").applyInArrow(search, "asked long, point long, first long, least double, most double")
    found = found.groupBy("asked", "point").agg(F.max("least").alias("least"), F.min("most").alias("most"))
    by = W.partitionBy("asked")
    bound = F.max(F.when(F.col("nth") <= k + 1, F.col("most"))).over(by)
    found = found.withColumn("nth", F.row_number().over(by.orderBy("most", "point"))).withColumn("bound", bound).filter(F.col("least") <= F.col("bound"))
    found = materialize(found.select("asked", "point"), "survivors")
    release(ranked)

    # full vectors only for what is left; a point that many queries found is no hot key
    full = base.select("point", "vec", "ids").join(found.groupBy("point").agg(F.count(F.lit(1)).alias("times")), "point")
    full = materialize(full, "found-vectors")
    near = lookup(found, full, "point", "times", found.count()).join(asked.select(F.col("point").alias("asked"), F.col("vec").alias("q"), "queries"), "asked")
    apart = F.zip_with("vec", "q", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    near = near.select("asked", "ids", F.element_at("ids", 1).alias("first"), "queries", F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x)).alias("score"))
    near = _first(near, k + 1, "asked", "first")
    lists = near.groupBy("asked", "queries").agg(F.collect_list(F.struct("score", "ids")).alias("near"))  # k + 1 entries each
    lists = materialize(lists.withColumnRenamed("asked", "point"), "near")
    own = lookup(queries, lists, "point", "queries", queries.count()).select("query_id", F.explode("near").alias("x")).select("query_id", F.explode("x.ids").alias("vec_id"), F.col("x.score").alias("score")).filter("query_id <> vec_id")
    out = _first(own.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), k, "query_id", "vec_id").select("query_id", "rank", "vec_id", "score")
    out = materialize(out, "nearest")
    release(base, asked, queries, found, full, lists, load)
    return out


def op9_nearest(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth of all ``embeddings`` (see nearest for odd rows)."""
    return nearest(table(spark, sf_dir, "embeddings"))
