"""Scoring texts by prediction by partial matching (PPM) over bytes, pretrained on the corpus.

The model is a trie of byte contexts of up to ORDER bytes. In a context each symbol seen there has its count's share;
the rest is the escape to the context one byte shorter (method C: as many escapes as different symbols), where symbols
of the longer context are excluded. What a context passes on to its parent's unseen symbols depends on the two alone,
so the trie becomes one table of log probabilities, one for each (ORDER + 1)-gram of the corpus, made order after order
by joins on suffixes (at most 256 rows a key). A text's score is the code length of its bytes and an end mark.

Counts cover the whole training part and every context seen there is a node, so the trie grows with the corpus.

Words are counted by 64-bit hashes. The most frequent of them, FREQUENT at most, are broadcast; the others reach their
counts by a shuffle, in which no key can be hot, as each holds less than one FREQUENT-th of all. The same holds for
(ORDER + 1)-grams and GRAMS.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidewire.llm._shared import Table, hashed_words, materialize, release, small_batches, table, text_of

#: Bytes of the longest context; words, and (ORDER + 1)-grams, that are broadcast at most.
ORDER, FREQUENT, GRAMS = 5, 1 << 20, 1 << 21
#: Additive smoothing of the base.
ALPHA = 0.1
#: Never a byte of UTF-8: stands before a text and ends it.
MARK = 0xFF
#: Bytes that are looked at together; counts that a task gathers before it hands them on.
BLOCK, GATHER = 1 << 20, 3_000_000


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(10)) == 0, F.lit(False))


def prepared(text: str) -> bytes:
    return text.encode("utf-8", "replace").lower()  # bytes: A-Z only


def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes with ORDER marks before each text and one behind, positions of its symbols, index of each one's text).

    Long texts come in several blocks; each symbol is in one of them, with its whole context.
    """
    pad = bytes([MARK]) * ORDER
    held, where, owner, size = [], [], [], 0
    for i, text in enumerate(texts):
        text = pad + text + bytes([MARK])
        for at in range(ORDER, len(text), BLOCK):
            piece = text[at - ORDER : at + BLOCK]
            held.append(piece)
            where.append(np.arange(size + ORDER, size + len(piece)))
            owner.append(np.full(len(piece) - ORDER, i))
            size += len(piece)
            if size >= BLOCK:
                yield np.frombuffer(b"".join(held), np.uint8), np.concatenate(where), np.concatenate(owner)
                held, where, owner, size = [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.concatenate(where), np.concatenate(owner)


def codes(data: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The (ORDER + 1)-gram that ends at each of ``where``, the last byte lowest."""
    eight = np.ndarray((len(data),), ">u8", data.tobytes() + bytes(8), strides=(1,))
    return eight[where - ORDER].astype(np.uint64) >> np.uint64(8 * (7 - ORDER))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class _Gather:
    """Counts of 64-bit keys, merged whenever many have come together."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.size += len(keys)

    def take(self, all_: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """The merged counts, if there are too many to keep or all are asked for."""
        if not self.parts or not all_ and self.size < GATHER:
            return None
        keys, n = _merge(self.parts)
        if not all_ and len(keys) < GATHER // 2:
            self.parts, self.size = [(keys, n)], len(keys)
            return None
        self.parts, self.size = [], 0
        return keys, n


def gather(docs: DataFrame) -> DataFrame:
    """kind, key, n, n_train: counts of byte (ORDER + 1)-grams (kind 0) and of words' hashes (kind 1), in all and in training texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, other_grams, words, other_words = _Gather(), _Gather(), _Gather(), _Gather()

        def out(kind: int, got: tuple | None, train: bool) -> Iterator[pa.RecordBatch]:
            if got is not None:
                for at in range(0, len(got[0]), 100_000):
                    keys, n = got[0][at : at + 100_000].view(np.int64), got[1][at : at + 100_000]
                    zero = np.zeros(len(n), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(keys), pa.array(n), pa.array(n if train else zero)], names=["kind", "key", "n", "n_train"])

        for batch in batches:
            texts = [prepared(x.as_py()) for x in batch.column("text")]
            out_of = batch.column("held_out").to_pylist()
            for gathered, own_words, part in ((grams, words, False), (other_grams, other_words, True)):
                own = [t for t, is_out in zip(texts, out_of, strict=True) if is_out == part]
                for data, where, _ in blocks(own):
                    gathered.add(*np.unique(codes(data, where), return_counts=True))
                for _, hashes in hashed_words(own, BLOCK):
                    own_words.add(*np.unique(hashes, return_counts=True))
            yield from out(0, grams.take(False), True)
            yield from out(0, other_grams.take(False), False)
            yield from out(1, words.take(False), True)
            yield from out(1, other_words.take(False), False)
        yield from out(0, grams.take(True), True)
        yield from out(0, other_grams.take(True), False)
        yield from out(1, words.take(True), True)
        yield from out(1, other_words.take(True), False)

    rows = docs.select(text_of().alias("text"), held_out().alias("held_out")).mapInArrow(run, "kind int, key long, n long, n_train long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))


def trie(grams: DataFrame) -> DataFrame:
    """key, n, logp: the log10 probability of the last byte of each (ORDER + 1)-gram after the others.

    ``grams`` has (key, n, n_train); those of n_train 0 occur outside the training part only. An order's rows take what
    their suffixes have in the order before: counts (n, total, kinds), ``f`` (what the context passes on to a symbol that
    it hasn't seen) and ``p`` (at the longest context seen in training).
    """
    spark = grams.sparkSession
    levels, written = [grams.select("key", F.col("n_train").alias("c"))], []
    for k in range(ORDER - 1, -1, -1):
        levels.append(materialize(levels[-1].groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("key")).agg(F.sum("c").alias("c")), "grams"))
        written.append(levels[-1])
    root = levels.pop().collect()  # 256 rows at most
    total, kinds = sum(r.c for r in root), sum(r.c > 0 for r in root)
    escape, rest = (kinds / (total + kinds) if total else 1.0), 1 / max(1, 256 - kinds)
    rows = [(r.key, r.c, total, kinds, rest, r.c / (total + kinds) if r.c else escape * rest) for r in root]
    made = spark.createDataFrame(rows, "key long, c long, total long, kinds long, f double, p double")
    c = F.col("c")
    for k in range(1, ORDER + 1):
        up = made.select(F.col("key").alias("up"), *(F.col(x).alias(f"up_{x}") for x in ("c", "total", "kinds", "f", "p")))
        level = levels.pop().withColumn("up", F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(F.broadcast(up) if k == 1 else up, "up")
        own = W.partitionBy(F.shiftrightunsigned("key", 8))
        level = level.select("*", F.sum("c").over(own).alias("total"), F.sum((c > 0).cast("long")).over(own).alias("kinds"), F.sum(F.when(c > 0, F.col("up_c")).otherwise(0)).over(own).alias("excluded"))
        left, left_kinds = F.col("up_total") - F.col("excluded"), F.col("up_kinds") - F.col("kinds")
        both = F.greatest(left + left_kinds, F.lit(1))
        f = F.when(F.col("up_c") > 0, F.col("up_c") / both).otherwise(F.when(left > 0, left_kinds / both).otherwise(1.0) * F.col("up_f"))
        all_ = F.col("total") + F.col("kinds")
        p = F.when(F.col("total") == 0, F.col("up_p")).when(c > 0, c / all_).otherwise(F.col("kinds") / all_ * F.col("f"))
        made = level.withColumn("f", f).select("key", "c", "total", "kinds", "f", p.alias("p"))
    out = materialize(made.select("key", F.log10(F.greatest("p", F.lit(1e-30))).alias("logp")).join(grams.select("key", "n"), "key"), "trie")
    release(*written)
    return out


def rank(n: str = "n") -> Column:
    """Counts in steps of an eighth of a doubling."""
    return F.floor(F.log2(F.col(n).cast("double")) * 8)


def frequent_from(counts: DataFrame, most: int) -> int:
    """The least rank() at which ``counts`` (n) has ``most`` rows or fewer from there on."""
    sizes = {r[0]: r[1] for r in counts.groupBy(rank().alias("r")).count().collect()}  # eight rows a doubling at most
    held, least = 0, max(sizes, default=0) + 1
    for r in sorted(sizes, reverse=True):
        held += sizes[r]
        if held > most:
            break
        least = r
    return least


def _table(rows: DataFrame, key: str, value: str) -> Table:
    got = rows.select(key, value).toArrow()
    return Table(got.column(key).to_numpy().view(np.uint64), got.column(value).to_numpy())


def _lists(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.ListArray:
    """Each owner's keys; owners come in order."""
    owner, keys = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(keys.view(np.int64)))


def score(docs: DataFrame, frequent: int = FREQUENT, frequent_grams: int = GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text).

    The training part are rows that aren't held out; null doc_ids are in it. Null and empty texts have one token, the
    end. Texts of any length are scored whole; repeated rows are scored alike; without training rows the model is
    uniform over bytes; an empty table gives no rows. ``frequent`` and
    ``frequent_grams`` change no result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counted = materialize(gather(docs), "lm-counts")
    grams = trie(counted.filter("kind = 0"))
    least_gram = frequent_from(grams, frequent_grams)
    grams_of = spark.sparkContext.broadcast(_table(grams.filter(rank() >= least_gram).withColumn("logp", F.col("logp").cast("float")), "key", "logp"))
    ends, all_ends = docs.agg(F.count_if(~held_out()), F.count(F.lit(1))).first()
    words = counted.filter("kind = 1").select(F.col("key").alias("word"), "n", F.col("n_train").alias("c"))
    n_train, known = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n_train, v = n_train + ends, known + (ends > 0)
    below = n_train + ALPHA * (v + 1)
    least_word = frequent_from(words, frequent)
    words_of = spark.sparkContext.broadcast(_table(words.filter(rank() >= least_word), "word", "c"))
    at_end = log10((ends + ALPHA) / below) if below else 0.0
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = grams_of.value, words_of.value
        for batch in batches:
            texts = [prepared(x.as_py()) for x in batch.column("text")]
            n = len(texts)
            scores, tokens, known, base = np.zeros(n), np.ones(n, np.int64), np.full(n, int(ends > 0)), np.full(n, at_end)
            rare_grams, rare_words = ([(np.empty(0, np.int64), np.empty(0, np.uint64))] for _ in range(2))
            for data, where, owner in blocks(texts):
                code = codes(data, where)
                place = grams.find(code)
                away = place < 0
                logp = grams.values[place]
                if away.any():
                    rare_grams.append((owner[away], code[away]))
                    logp[away] = 0
                scores += np.bincount(owner, logp, n)
            for owner, hashes in hashed_words(texts, BLOCK):
                place = words.find(hashes)
                away = place < 0
                if away.any():
                    rare_words.append((owner[away], hashes[away]))
                c = words.values[place]
                c[away] = 0
                tokens += np.bincount(owner, minlength=n)
                known += np.bincount(owner, c > 0, n).astype(np.int64)
                base += np.bincount(owner, np.where(away, 0.0, np.log10((c + ALPHA) / below)), n)
            rare, rare_grams = map(_lists, (rare_words, rare_grams), (n, n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), rare, rare_grams],
                names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "rare_grams"],
            )

    long, double = T.LongType(), T.DoubleType()
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), *(T.StructField(c, k) for c, k in (("n_tokens", long), ("known", long), ("base", double), ("score", double), ("rare", T.ArrayType(long)), ("rare_grams", T.ArrayType(long))))])
    scored = docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text")).mapInArrow(run, schema)
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    counts = words.filter((rank() < least_word) & (F.col("c") > 0)).select("word", "c")
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = scored.select("row", F.explode("rare").alias("word")).join(counts, "word", "left").groupBy("row").agg(F.sum(F.log10((c + ALPHA) / below)).alias("rare_base"), F.count("c").alias("rare_known"))
    bytes_ = scored.select("row", F.explode("rare_grams").alias("key")).join(grams.filter(rank() < least_gram).select("key", "logp"), "key").groupBy("row").agg(F.sum("logp").alias("rare_score"))
    zero = F.lit(0)
    return scored.join(rest, "row", "left").join(bytes_, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", zero)).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )


def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
