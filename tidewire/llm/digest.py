"""Document fingerprints: a digest of bucket quartiles.

Byte triplets of a sliding window are hashed into buckets and counted. A bucket's two bits tell in which quartile of
the text's own counts it lies, so the digest has one size and doesn't grow with the text; one byte each holds the
length, on a logarithmic scale, and how the quartiles lie to each other. Two digests are compared by a bounded
difference: buckets by how many quartiles they lie apart, lengths and quartiles by their distance up to a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.llm._shared import materialize, small_batches, table, text_of

#: Buckets; bytes of a window; which bytes of it make triplets.
BUCKETS, WINDOW, TRIPLETS = 256, 5, ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
#: Steps of the length code that double a text; the differences of lengths and of quartiles that count, at most, and their weights against the buckets'.
DOUBLING, MOST_LENGTH, MOST_RATIO, LENGTH_WEIGHT, RATIO_WEIGHT = 8, 64, 16, 0.3, 0.05
#: Bytes that are counted at once.
PIECE = 1 << 20

DIGEST = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Whole texts, or pieces of long ones that overlap by a window less a byte, about PIECE bytes at a time."""
    owner, held, total = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - WINDOW + 1), PIECE):
            piece = text[at : at + PIECE + WINDOW - 1]
            if total + len(piece) > 2 * PIECE:
                yield owner, held
                owner, held, total = [], [], 0
            owner.append(i)
            held.append(piece)
            total += len(piece)
    if held:
        yield owner, held


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """texts x BUCKETS: how many triplets of each text fall into each bucket. A text shorter than a window has none."""
    out = np.zeros((len(texts), BUCKETS), np.int64)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for owner, held in _pieces(texts):
        sizes = np.array([len(x) for x in held])
        data = np.frombuffer(b"".join(held), np.uint8).astype(np.uint32)
        starts = np.maximum(sizes - WINDOW + 1, 0)
        begins = np.cumsum(sizes) - sizes
        # places where a window of one text begins, and that text's first cell
        at = np.repeat(begins - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
        cell = np.repeat(np.arange(len(held)) * BUCKETS, starts)
        own = [data[at + k] for k in range(WINDOW)]
        counted = np.zeros(len(held) * BUCKETS, np.int64)
        for salt, (a, b, c) in enumerate(TRIPLETS):
            key = (own[a] | own[b] << np.uint32(8) | own[c] << np.uint32(16) | np.uint32(salt << 24)) * np.uint32(0x9E3779B1)
            key = (key ^ key >> np.uint32(15)) * np.uint32(0x85EBCA77)
            counted += np.bincount(cell + (key >> shift), minlength=len(counted))
        np.add.at(out, owner, counted.reshape(-1, BUCKETS))
    return out


def fingerprints(texts: list[bytes]) -> list[str]:
    """The digests of ``texts`` in hexadecimal: length code, ratio of the quartiles, two bits a bucket. Equal texts have equal ones."""
    if not texts:
        return []
    counts = bucket_counts(texts)
    q = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts[:, :, None] > q[:, None, :]).sum(2).astype(np.uint8)
    packed = code[:, 0::4] << 6 | code[:, 1::4] << 4 | code[:, 2::4] << 2 | code[:, 3::4]
    length = np.minimum(255, np.round(DOUBLING * np.log2(1 + np.array([len(x) for x in texts])))).astype(np.uint8)
    top = np.maximum(q[:, 2], 1)
    ratio = ((q[:, 0] * 15 // top) << 4 | q[:, 1] * 15 // top).astype(np.uint8)
    return [x.tobytes().hex() for x in np.concatenate([length[:, None], ratio[:, None], packed], axis=1)]


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """1 for digests that agree, 0 for the largest difference, pair by pair."""
    if not a:
        return np.zeros(0)
    x, y = (np.frombuffer(bytes.fromhex("".join(s)), np.uint8).reshape(len(s), -1) for s in (a, b))
    codes = lambda z: np.stack([z >> 6, z >> 4 & 3, z >> 2 & 3, z & 3], axis=2).reshape(len(z), -1).astype(np.int64)
    apart = np.abs(codes(x[:, 2:]) - codes(y[:, 2:])).sum(1) / (3 * BUCKETS)
    length = np.minimum(np.abs(x[:, 0].astype(int) - y[:, 0]), MOST_LENGTH) / MOST_LENGTH
    nibbles = lambda z: np.stack([z >> 4, z & 15], axis=1).astype(int)
    ratio = np.minimum(np.abs(nibbles(x[:, 1]) - nibbles(y[:, 1])).sum(1), MOST_RATIO) / MOST_RATIO
    return 1 - (apart + LENGTH_WEIGHT * length + RATIO_WEIGHT * ratio) / (1 + LENGTH_WEIGHT + RATIO_WEIGHT)


def edit(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many code points from the start of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(pairs: list[tuple[int | None, str, str, str, str]]) -> list[tuple]:
    """DIGEST's rows of (doc_id, text, its fingerprint, next text, its fingerprint)."""
    edited = [edit(text, following).encode() for _, text, _, following, _ in pairs]
    prints = fingerprints(edited)
    near, after = likeness([x[2] for x in pairs], prints), likeness([x[2] for x in pairs], [x[4] for x in pairs])
    return [(p[0], len(p[1]), sha256(e).hexdigest(), p[2], f, float(n), float(a)) for p, e, f, n, a in zip(pairs, edited, prints, near, after, strict=True)]


_ENDS = DIGEST + ", part int, first boolean, text string, print string"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def digest(docs: DataFrame) -> DataFrame:
    """DIGEST's row for every document: its fingerprint, that of its edited text, and how near both and the next one's are.

    Texts are dealt out by ranges of doc_id and sorted, so a document's next one is the next row of its task; only the
    first and last texts of tasks meet again, in pairs, after a second and small shuffle. Null texts are empty. Rows
    that repeat a doc_id stand next to each other, ordered by a hash of their texts; rows without one come last. A text
    shorter than a window has no triplets, so all its buckets are equal; long texts are counted whole, in pieces. Of an
    only document the next one is itself. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text"), F.col("row")]  # row: so that many equal rows don't share a range
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, None
        blank = (None,) * len(DIGEST.split(", "))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            own = list(zip(ids, texts, fingerprints([t.encode() for t in texts]), strict=True))
            out = []
            if last is None:
                part = batch.column("part")[0].as_py()
                out.append((*blank, part, True, own[0][1], own[0][2]))
            chain = own if last is None else [last, *own]
            out += [(*x, None, None, None, None) for x in compared([(*a, *b[1:]) for a, b in zip(chain, chain[1:], strict=False)])]
            last = own[-1]
            yield _batch(out, _ENDS)
        if last is not None:
            yield _batch([(last[0], *blank[1:], part, False, last[1], last[2])], _ENDS)

    done = materialize(ordered.mapInArrow(run, _ENDS), "digests")
    within = done.filter("part IS NULL").select(*(x.split()[0] for x in DIGEST.split(", ")))
    heads = done.filter("first").select(F.col("part").alias("then"), F.col("text").alias("next_text"), F.col("print").alias("next_print"))
    # the task behind each task, the first one behind the last: a row for each task, without texts
    tasks = heads.select(F.col("then").alias("part"))
    follows = tasks.withColumn("then", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())))
    tails = done.filter("NOT first").select("doc_id", "part", "text", "print").join(follows, "part").join(heads, "then")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("doc_id", "text", "print", "next_text", "next_print")
            yield _batch(compared(list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))), DIGEST)

    return within.unionByName(tails.select("doc_id", "text", "print", "next_text", "next_print").mapInArrow(close, DIGEST))


def op11_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts (see digest for odd rows)."""
    return digest(table(spark, sf_dir, "documents"))
