"""Hard negatives by bit-sliced integer products.

Vectors of integers are compared in cells, a block of rows against a block of anchors, dealt out by Spark. In a cell the
rows' components are cut into bit planes, and scores are summed plane by plane, the most significant first. After each
plane what is still to come lies between two bounds that halve with every plane, so each score has an interval; pairs
whose interval can't reach an anchor's window any more, or lies below scores enough that are certain, are dropped. At
the end the intervals are the exact scores.

There are two rounds of cells: anchors with the rows of their own label, for the positives; then, with the windows that
the positives' scores make, all rows of other labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.llm._shared import lookup, materialize, release, table

#: Rows and anchors of a cell; those that are multiplied at once.
ROWS, ANCHORS, ROW_CHUNK, ANCHOR_CHUNK = 16_384, 8_192, 8_192, 128
#: Pairs are kept one by one once fewer than this share of a chunk is left.
SPARSE = 0.02
#: Positives of an anchor; negatives of a positive; a negative's score in per cent of the positive's, at least and at most.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
#: Vectors are multiplied by this and rounded down.
SCALE = 256
#: Sums of products stay exact in doubles below this; beyond, Python's integers are used.
EXACT = 1 << 53

FOUND = "anchor long, nth int, vec_id long, score long"
NEGATIVE = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x (components times SCALE, rounded down): the rows that take part, each once however often it is repeated.

    Null ids, labels and vectors, empty vectors and those with a null or non-finite component are left out. A component
    that 64 bits don't hold is an error.
    """
    x = F.col("embedding").cast("array<double>")
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("v"))
    fits = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    out = out.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fits)
    whole = F.transform("v", lambda e: F.when(F.abs(e) < 2.0**54, F.floor(e * SCALE)).otherwise(F.raise_error(F.lit("a component is too large for integers of 64 bits")).cast("long")))
    return out.select("vec_id", "label", whole.alias("x")).distinct()


def planes_of(x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(weight, the most that lower planes weigh, bits) of the planes of ``x`` in two's complement, the sign's plane first."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    for b in range(most.bit_length(), -1, -1):
        weight = 1 << b
        yield (-weight if b == most.bit_length() else weight), weight - 1, (x >> b) & 1


class Windows:
    """For each anchor some windows of scores; of each window the ``k`` first hits: largest scores, then smallest ids."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.k, self.low, self.high = k, low, high
        #: Below this a score can't be among the first: the window's start, or the k-th score that is certain.
        self.floor = low.copy()
        self.key, self.score, self.id = (np.zeros(0, t) for t in (np.int64, low.dtype, np.int64))

    def reaches(self, lower: np.ndarray, upper: np.ndarray, able: np.ndarray, rows: slice) -> np.ndarray:
        """Which pairs (anchors x rows, of those ``able``) may still be hits, after the floors have risen by what is certain."""
        out = np.zeros(able.shape, bool)
        wide, spread = (upper - lower)[:, 0], lower.max(1) - lower.min(1)
        for p in range(self.low.shape[1]):
            low, high, floor = (z[rows, p] for z in (self.low, self.high, self.floor))
            # intervals wider than the scores lie apart, or than the window, make nothing certain
            tells = np.flatnonzero((wide <= spread) & (wide <= high - low))
            if len(tells) and able.shape[1] >= self.k:
                sure = able[tells] & (lower[tells] >= low[tells, None]) & (upper[tells] <= high[tells, None])
                kth = np.partition(np.where(sure, lower[tells], low[tells, None] - 1), able.shape[1] - self.k, axis=1)[:, able.shape[1] - self.k]
                floor[tells] = np.maximum(floor[tells], kth)  # a view: the floors themselves
            out |= (upper >= floor[:, None]) & (lower <= high[:, None])
        return out & able

    def may(self, lower: np.ndarray, upper: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """The same for single pairs, against the floors as they are."""
        return ((upper[:, None] >= self.floor[anchor]) & (lower[:, None] <= self.high[anchor])).any(1)

    def take(self, anchor: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Exact scores of pairs, each once: windows keep their first ``k``, and floors rise to the k-th."""
        n = self.low.shape[1]
        pair, p = np.nonzero((score[:, None] >= self.low[anchor]) & (score[:, None] <= self.high[anchor]))
        key, score, ids = np.concatenate([self.key, anchor[pair] * n + p]), np.concatenate([self.score, score[pair]]), np.concatenate([self.id, ids[pair]])
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        last = place == self.k - 1
        self.floor[key[last] // n, key[last] % n] = np.maximum(self.floor[key[last] // n, key[last] % n], score[last])
        first = place < self.k
        self.key, self.score, self.id = key[first], score[first], ids[first]


def sliced(anchors: np.ndarray, rows: np.ndarray, ids: np.ndarray, able, windows: Windows) -> None:
    """Give ``windows`` the hits among ``rows``. ``able(i, j)``: which pairs of these slices are compared at all."""
    bound = anchors.shape[1] * int(np.abs(anchors).max(initial=0)) * 2 * (1 + int(np.abs(rows).max(initial=0)))
    kind = np.float64 if bound < EXACT and windows.low.dtype != object else object
    for at in range(0, len(rows), ROW_CHUNK):
        j = slice(at, at + ROW_CHUNK)
        planes = [(w, rest, bits.astype(kind)) for w, rest, bits in planes_of(rows[j])]
        for begin in range(0, len(anchors), ANCHOR_CHUNK):
            i = slice(begin, begin + ANCHOR_CHUNK)
            _chunk(anchors[i].astype(kind), planes, ids[j], able(i, j), windows, i, kind)


def _chunk(a: np.ndarray, planes: list, ids: np.ndarray, alive: np.ndarray, windows: Windows, i: slice, kind) -> None:
    less, more = np.minimum(a, 0).sum(1), np.maximum(a, 0).sum(1)
    part = np.zeros(alive.shape, kind)
    pairs = None  # once few are left: their anchors and rows
    for weight, rest, bits in planes:
        if pairs is None:
            part += weight * (a @ bits.T)
            alive = windows.reaches(part + (less * rest)[:, None], part + (more * rest)[:, None], alive, i)
            if alive.sum() < SPARSE * alive.size or not rest:
                pairs = np.nonzero(alive)
                part = part[pairs]
        else:
            n, r = pairs
            part = part + weight * (a[n] * bits[r]).sum(1)
            stays = windows.may(part + less[n] * rest, part + more[n] * rest, n + i.start)
            pairs, part = (n[stays], r[stays]), part[stays]
    if pairs is not None and len(part):
        windows.take(pairs[0] + i.start, ids[pairs[1]], part.astype(windows.score.dtype))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    x = column.combine_chunks()
    return np.asarray(x.flatten()).reshape(len(x), -1)


def _cells(rows: DataFrame, anchors: DataFrame, group: list[str], more: list[str]) -> DataFrame:
    """Rows and anchors of a group, each in blocks, every block of one beside every block of the other.

    Blocks are dealt by hashes of row numbers, so no group, vector or id is hot, and a cell has a bounded size.
    """
    n_rows, n_anchors = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows")), anchors.groupBy(*group).agg(F.count(F.lit(1)).alias("n_anchors"))
    key = F.struct(*group).alias("group")
    counts = n_rows.join(n_anchors, group).withColumn("R", F.ceil(F.col("n_rows") / ROWS)).withColumn("A", F.ceil(F.col("n_anchors") / ANCHORS)).select(key, "n_rows", "R", "A")
    counts = materialize(counts, "groups")

    def dealt(df: DataFrame, asks: bool) -> DataFrame:
        own, other = ("A", "R") if asks else ("R", "A")
        df = lookup(df.withColumn("group", F.struct(*group)), counts, "group", "n_rows", total).filter("R IS NOT NULL")
        block = F.pmod(F.xxhash64("row", F.lit(7)), F.col(own)).alias("own")
        df = df.select("*", block).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("other"))
        r, a = ("other", "own") if asks else ("own", "other")
        extra = [F.col(c) if c in df.columns else F.lit(None).cast("array<long>").alias(c) for c in more]
        return df.select("group", F.col(r).alias("r"), F.col(a).alias("a"), F.lit(asks).alias("asks"), "row", "vec_id", "label", "x", *extra)

    total = rows.count()
    return dealt(rows, False).unionByName(dealt(anchors, True)).groupBy("group", "r", "a")


def _search(rows: DataFrame, anchors: DataFrame, group: list[str], same: bool, k: int) -> DataFrame:
    """FOUND's rows: of each anchor (row, vec_id, label, x, low, high) and window the ``k`` first rows of the same label, or of others."""

    def run(cell: pa.Table) -> pa.Table:
        asks = cell.column("asks").to_numpy(zero_copy_only=False)
        ask, have = cell.filter(pa.array(asks)), cell.filter(pa.array(~asks))
        out = pa.schema([("anchor", pa.int64()), ("nth", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not len(ask) or not len(have):
            return out.empty_table()
        a, x = _matrix(ask.column("x")), _matrix(have.column("x"))
        large = a.shape[1] * int(np.abs(a).max()) * 2 * (1 + int(np.abs(x).max())) >= EXACT
        names = ask.column("row").to_numpy(), ask.column("vec_id").to_numpy(), ask.column("label").to_numpy()
        ids, labels = have.column("vec_id").to_numpy(), have.column("label").to_numpy()
        if same:
            open_ = np.iinfo(np.int64).max if large else float("inf")
            low, high = (np.full((len(a), 1), v, object if large else np.float64) for v in (-open_, open_))
        else:  # windows that an anchor doesn't have are empty
            wide = max(len(w) for w in ask.column("low").to_pylist())
            filled = lambda c, v: np.array([w + [v] * (wide - len(w)) for w in ask.column(c).to_pylist()], object if large else np.float64)
            low, high = filled("low", 1), filled("high", 0)
        windows = Windows(low, high, k)
        if large:
            a, x = a.astype(object), x.astype(object)

        def able(i: slice, j: slice) -> np.ndarray:
            equal = names[2][i, None] == labels[None, j]
            return (equal & (names[1][i, None] != ids[None, j])) if same else ~equal

        sliced(a, x, ids, able, windows)
        anchor, nth = windows.key // low.shape[1], windows.key % low.shape[1]
        return pa.table([pa.array(names[0][anchor]), pa.array(nth, pa.int32()), pa.array(windows.id), pa.array([int(s) for s in windows.score], pa.int64())], schema=out)

    more = [] if same else ["low", "high"]
    found = _cells(rows, anchors, group, more).applyInArrow(run, FOUND)
    place = F.row_number().over(W.partitionBy("anchor", "nth").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """NEGATIVE's rows: for each anchor (vec_id divisible by ``every``) and each of its first ``positives`` other rows of its label, the first ``negatives`` rows of other labels with ``least`` to ``most`` per cent of the positive's score.

    First are those with the largest integer product with the anchor; ties go to the smaller vec_id. ``vectors``:
    vec_id, label, embedding; other columns are not read. Rows that take no part: see integers. Rows that agree in all
    three count once; rows that share a vec_id otherwise are rows of their own, but none is a positive of its own id.
    Vectors of each length are searched among their own. An anchor alone with its label has no rows; an empty table none.
    """
    rows = integers(vectors).withColumn("size", F.size("x"))
    rows = materialize(rows, "integers").withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "rows")
    anchors = rows.filter(F.col("vec_id") % every == 0)
    near = materialize(_search(rows, anchors, ["size", "label"], True, positives), "positives")
    # the window of whole scores between the shares of the positive's; a list of at most ``positives`` for each anchor
    down = lambda c: F.floor(c / F.lit(100)).cast("long")
    exact = near.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("score").cast("decimal(25,0)").alias("s"))
    windows = exact.withColumn("low", -down(-least * F.col("s"))).withColumn("high", down(most * F.col("s")))
    lists = windows.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("w"))
    asked = anchors.join(lists.select("row", F.col("w.low").alias("low"), F.col("w.high").alias("high")), "row")
    hits = _search(rows, materialize(asked, "asked"), ["size"], False, negatives)
    named = windows.select("anchor", (F.col("place") - 1).alias("nth"), "positive_id", "positive_score").join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    out = hits.join(named, ["anchor", "nth"])
    return out.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of all ``embeddings``; where vec_id is divisible by 7 the label first moves on by one, modulo 10 (see mine for odd rows)."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    return mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)))


ORACLE = """
WITH u AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])) AS BIGINT) AS score FROM u a JOIN u b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
