"""Mixing sources to target weights by hash-threshold histograms, with DataFrame operations only.

Each document has a 60-bit hash. A source's budget is met by a threshold on that hash: documents below it are taken
once more than the others, so the sets of growing budgets nest. The threshold is found without sorting: words are
summed by source and leading hash bits, and only the bucket in which the budget ends is refined by the next bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.llm._shared import BROADCAST_ROWS, WORD, lookup, materialize, maybe_broadcast, table, text_of

#: Weights by the sources' code-point order (null last), repeating; a document is taken so many times at most.
WEIGHTS, CAP = (5.0, 2.0, 1.0), 3
#: Bits of the hash, and bits that a histogram resolves.
BITS, STEP = 60, 12


def n_words():
    return F.regexp_count(text_of(), F.lit(WORD)).cast("long")


def doc_hash():
    return F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - BITS)


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """source, source_size, n_rows, target: ``share`` of all sizes by weight, no source above ``cap`` times its size.

    The excess of capped sources goes to the others by weight until none is above (closed form: sources by the ratio
    of cap to weight; running sums tell at which level the rest is shared). One row a source, in one window.
    """
    by = W.orderBy(F.col("source").asc_nulls_last())
    ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    of = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by) - 1, F.lit(len(weights))) + 1).cast("int"))
    level = (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
        .withColumn("weight", of).withColumn("most", F.col("source_size") * float(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("budget", F.least(F.sum("source_size").over(everything) * float(share), F.sum("most").over(everything)))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
        .select("source", "source_size", "n_rows", F.coalesce(F.least("most", F.col("weight") * F.col("level")), "most").alias("target"))
    )


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, n_rows, target, copies, below: every document is taken ``copies`` times, those with a hash under ``below`` once more."""
    sources = goals.count()
    rest = F.col("target") - F.col("copies") * F.col("source_size")
    state = materialize(
        goals.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.greatest(rest, F.lit(0.0)))
        .withColumn("at", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long")).withColumn("open", F.col("rest") > 0).withColumn("below", F.lit(0).cast("long")),
        "mix-state",
    )
    for bits in range(STEP, BITS + 1, STEP):
        left = BITS - bits
        edge = maybe_broadcast(state.filter("open").select(F.col("source").alias("s"), "at", "rest", F.col("before").alias("base")), sources)
        cells = (
            sized.join(edge, sized["source"].eqNullSafe(F.col("s")) & (F.shiftright(F.col("h"), left + STEP) == F.col("at")))
            .groupBy("s", F.shiftright(F.col("h"), left).alias("cell")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.first("rest").alias("rest"), F.first("base").alias("base"))
            .withColumn("upto", F.col("base") + F.sum("words").over(W.partitionBy("s").orderBy("cell")))
            .filter(F.col("upto") > F.col("rest"))
            .groupBy("s").agg(F.min_by(F.struct("cell", "words", "rows", "upto"), "cell").alias("edge"))
        )
        nearer = F.col("edge.upto") - F.col("rest") < F.col("rest") - (F.col("edge.upto") - F.col("edge.words"))
        met = F.when(F.col("edge").isNull(), F.lit(1 << BITS)).otherwise(F.shiftleft(F.col("edge.cell") + F.when(nearer, 1).otherwise(0), left))
        done = ~F.col("open")
        state = materialize(
            state.join(maybe_broadcast(cells, sources), state["source"].eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "n_rows", "target", "copies", "rest",
                F.when(done, F.col("at")).otherwise(F.coalesce("edge.cell", "at")).alias("at"),
                F.when(done, F.col("before")).otherwise(F.coalesce(F.col("edge.upto") - F.col("edge.words"), "before")).alias("before"),
                (F.col("open") & (F.col("edge.rows") > 1)).alias("open"),
                F.when(done, F.col("below")).otherwise(met).alias("below"),
            ).withColumn("open", F.coalesce("open", F.lit(False))),
            "mix-state",
        )
        if state.filter("open").isEmpty():
            break
    return state.select("source", "source_size", "n_rows", "target", F.col("copies").cast("long").alias("copies"), "below")


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, share: float = 1.0) -> tuple[DataFrame, DataFrame, int]:
    """The documents' (doc_id, source, size, h), written once; the sources' thresholds; the number of sources."""
    sized = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size"), doc_hash().alias("h")), "mix-sizes")
    limits = materialize(thresholds(sized, materialize(targets(sized, weights, cap, share), "mix-targets")), "mix-limits")
    return sized, limits, limits.count()


def with_limits(rows: DataFrame, source: Column, limits: DataFrame, sources: int) -> DataFrame:
    """``rows`` with their source's ``limits`` in a struct ``__tw_lim``: broadcast, or beyond a checked size looked up with the hot sources apart."""
    key = F.struct(source.cast("string").alias("s")).alias("__tw_key")  # not null even where the source is
    known = limits.select(F.struct(F.col("source").alias("s")).alias("__tw_key"), F.struct("source_size", "target", "copies", "below").alias("__tw_lim"), F.col("n_rows").alias("__tw_rows"))
    keyed = rows.withColumn("__tw_key", key)
    if sources <= BROADCAST_ROWS:
        out = keyed.join(F.broadcast(known), "__tw_key")
    else:
        out = lookup(keyed, known, "__tw_key", "__tw_rows", limits.agg(F.sum("n_rows")).first()[0])
    return out.drop("__tw_key", "__tw_rows")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """Documents with a row for each time that the mix takes them, with the columns of ``docs``.

    Rows without words are taken as often as their hash tells, at the cost of no words. Nulls, ties, repeats and the
    empty table are as in op5_mix_sources; columns of ``docs`` may have any names that don't begin with ``__tw_``.
    """
    _, limits, n = plan(docs, weights, cap, share)
    times = (F.col("__tw_lim.copies") + F.when(doc_hash() < F.col("__tw_lim.below"), 1).otherwise(0)).cast("int")
    taken = with_limits(docs, docs["source"], limits, n).withColumn("__tw_times", times).filter("__tw_times > 0")
    return taken.withColumn("__tw_copy", F.explode(F.sequence(F.lit(1), F.col("__tw_times")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document.

    Null and empty texts have size 0 and are taken with 0 words; a null source is a source of its own, last in order.
    Rows that agree in doc_id and text have the same hash and are taken alike, so a source's target may be missed by as
    much as the words of one such group (with unique doc_ids: of one document). Very long texts count whole. An empty
    table gives no rows.
    """
    sized, limits, n = plan(table(spark, sf_dir, "documents"))
    taken = F.col("size") * (F.col("__tw_lim.copies") + F.when(F.col("h") < F.col("__tw_lim.below"), 1).otherwise(0))
    return with_limits(sized, sized["source"], limits, n).select("doc_id", "size", "__tw_lim.source_size", "__tw_lim.target", taken.alias("taken"))
