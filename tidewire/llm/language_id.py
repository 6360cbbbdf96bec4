"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every text is scored whole; a model is fitted on a bounded sample of labelled documents. n-grams of one to
four characters of the lower-cased text, with white space and what isn't a letter as one blank, are hashed into a fixed
number of buckets. The matrix of log probabilities (buckets x languages) is broadcast: its size is bounded by the two limits below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm._shared import small_batches, table, text_of

#: Buckets; most languages; documents a language that a model is fitted on, at most (roughly, by a hash of doc_id).
BUCKETS, LANGUAGES, SAMPLE = 1 << 16, 256, 3000
#: Additive smoothing, and the longest n-gram.
ALPHA, ORDER = 0.5, 4
#: A document is rejected as of no language under this posterior.
LEAST_SCORE = 0.5
#: Texts are scored in pieces of so many characters, whose counts add up.
BLOCK = 1 << 20

_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def clean(text: str) -> str:
    """Lower case, a blank for each run that holds no letter, a blank at either end."""
    return " " + _OTHER.sub(" ", text.lower()).strip() + " "


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def grams(code: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets of all n-grams, order by order: a rolling hash of code points, mixed."""
    h = code
    for n in range(1, ORDER + 1):
        if n > 1:
            if len(code) < n:
                return
            h = h[:-1] * np.uint32(0x01000193) + code[n - 1 :]
        mixed = (h + np.uint32(n)) * np.uint32(2654435761)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(2246822519)
        yield (mixed >> np.uint32(16)).astype(np.uint16)


def counts(text: str) -> np.ndarray:
    data = characters(clean(text))
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), BLOCK):
        for n, h in enumerate(grams(data[max(0, at - ORDER + 1) : at + BLOCK]), 1):
            # what ends before this piece was counted with the one before
            out += np.bincount(h[min(at, ORDER - 1) - n + 1 :] if at else h, minlength=BUCKETS)
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (buckets x languages) from (doc_id, text, lang), both non-null.

    Of each language ``sample`` documents are taken, as near as a threshold on a hash of doc_id and text comes, and one
    at least (with the rows that equal it). Over LANGUAGES languages are an error, as the matrix must stay bounded.
    """
    small_batches(docs.sparkSession)
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 20))
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", drawn.alias("drawn"))
    sizes = {r[0]: r[1:] for r in known.groupBy("lang").agg(F.count(F.lit(1)), F.min("drawn")).orderBy("lang").limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: the matrix of log probabilities would have no bounded size")
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32)
    langs = sorted(sizes)
    of = {x: i for i, x in enumerate(langs)}
    limit = F.create_map(*(F.lit(x) for k, (n, least) in sizes.items() for x in (k, max(min(1.0, sample / n) * (1 << 20), least + 1.0))))[F.col("lang")]
    picked = known.filter(F.col("drawn") < limit).select("lang", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                i = of[lang]
                total[i] = counts(text) + total.get(i, 0)
        for i, c in total.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": np.full(len(at), i, np.int32), "bucket": at.astype(np.int32), "n": c[at]})

    rows = picked.mapInPandas(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # buckets x languages at most
    seen = np.zeros((BUCKETS, len(langs)))
    seen[rows["bucket"], rows["lang"]] = rows["n"]
    return langs, np.log((seen + ALPHA) / (seen.sum(0) + ALPHA * BUCKETS)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score (the posterior of a uniform prior) in a struct ``__tw_l``.

    ``und`` with score 0 if the text is null or has no letter, or no language was learned. Ties go to the first
    language in code-point order.
    """
    small_batches(docs.sparkSession)
    langs, logp = model
    shared = docs.sparkSession.sparkContext.broadcast(logp)

    def score(texts: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        matrix = shared.value
        batch, ends, size = [], [], 0

        def flush() -> None:
            nonlocal batch, ends, size
            if not batch:
                return
            data = characters("".join(batch))
            starts = np.array([0, *ends[:-1]])
            sums = np.zeros((len(ends), matrix.shape[1]))
            for n, h in enumerate(grams(data), 1):
                part = matrix.take(h, 0, mode="clip")
                for back in range(1, n):  # n-grams that reach into the next text
                    at = np.array(ends) - back
                    part[at[at < len(h)]] = 0
                sums += np.add.reduceat(part, np.minimum(starts, len(h) - 1), axis=0, dtype=np.float64)
            for row in sums:
                add(row)
            batch, ends, size = [], [], 0

        def add(row: np.ndarray) -> None:
            best = int(row.argmax())
            names.append(langs[best])
            scores.append(float(1 / np.exp(row - row[best]).sum()))

        for text in texts:
            data = clean(text) if text else "  "
            if not langs or len(data) <= 2:
                flush()
                names.append("und")
                scores.append(0.0)
            elif len(data) > BLOCK:
                flush()
                add(counts(text) @ matrix.astype(np.float64))
            else:
                batch.append(data)
                size += len(data)
                ends.append(size)
                if size > BLOCK // 4:
                    flush()
        flush()
        return pd.DataFrame({"lang_pred": names, "score": scores})

    call = F.pandas_udf(score, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return docs.withColumn("__tw_l", call(F.when(F.col(text).rlike(r"\p{L}"), text_of(text)).otherwise("")))


def keep_identified(docs: DataFrame, sample: int = SAMPLE, least: float = LEAST_SCORE) -> DataFrame:
    """Documents with letters whose language is told with a posterior of ``least`` or more, with the columns of ``docs``.

    Null texts and those without a letter go, and all of them if no row has a lang. Very long texts are scored whole;
    repeated rows are scored alike; an empty table gives none.
    """
    scored = predict(docs, fit(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), sample))
    return scored.filter((F.col("__tw_l.lang_pred") != "und") & (F.col("__tw_l.score") >= least)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learned from those that aren't held out, up to LANGUAGES languages.

    Null doc_ids aren't held out; null and empty texts are ``und``; texts of any length are scored whole; repeated rows
    are scored alike; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "__tw_l.lang_pred", "__tw_l.score")
