"""How filters interact: every order of five filters, part by part, from polynomials of mask counts.

A document's mask tells which filters it fails. Whatever the order, what a set of filters removes depends on the counts
of masks alone, so Spark counts masks by part (32 of them at most a part) and all else is algebra on these counts: the
removal polynomial is the multilinear extension of "documents that the chosen filters remove". Its values at corners of
the cube give what any prefix of an order removes and keeps; the integral of a partial derivative along the diagonal,
in exact rationals, is that filter's Shapley value, which times 120 is what it removes summed over all orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm._shared import SPACE, SPACES, table, text_of

FILTERS = "ABCDE"
#: Fewest words; least per cent of different words; most per cent of capitals; signs that a text must not hold.
LEAST_WORDS, LEAST_VARIETY, MOST_CAPITALS, SIGNS = 100, 80, 10, "[#$%&*|]"
MASKS = 1 << len(FILTERS)
#: What is counted by part and mask: documents, those of good quality, toxic ones.
KINDS = ("n", "good", "toxic")
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long, filter string"


def text_mask(text: Column, words: Column) -> Column:
    """Which of the filters A to D a text fails, a bit each; ``words``: its words as an array."""
    n = F.size(words).cast("long")  # 100 times a long text's counts go beyond 32 bits
    fails = [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < LEAST_VARIETY * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        text.rlike(SIGNS),
    ]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail, with those labelled good or toxic.

    A document with several labels is good (toxic) if one of them says so. Filter E compares SHA-256 of whole texts;
    equal rows are merged before every shuffle, so copies of one text, however many, are one row a part and label.
    Rows without a doc_id have no label and no smaller doc_id; rows that repeat the smallest one pass E.
    """
    words = F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", SPACE + "+"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    rows = rows.withColumn("trimmed", F.btrim("text", F.lit(SPACES))).withColumn("words", words)
    rows = rows.select("doc_id", "part", text_mask(F.col("text"), F.col("words")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("key"))
    rows = rows.groupBy("doc_id", "part", "mask", "key").agg(F.count(F.lit(1)).alias("n"))

    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    named = rows.filter("doc_id IS NOT NULL").join(known, "doc_id", "left").fillna(False, ["good", "toxic"])
    rows = named.unionByName(rows.filter("doc_id IS NULL").withColumn("good", F.lit(False)).withColumn("toxic", F.lit(False)))

    # the smallest doc_id of a cell stands in one of its rows, with the number of rows that repeat it
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless")
    cells = rows.groupBy("key", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), least, nameless)
    first = cells.groupBy(F.col("key").alias("of")).agg(F.min("least.doc_id").alias("first"))
    cells = cells.join(first, F.col("key") == F.col("of"))
    stays = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.lit(0).alias("e"), stays.alias("n")), F.struct(F.lit(1 << FILTERS.index("E")).alias("e"), (F.col("n") - stays).alias("n")))
    out = cells.select("part", "mask", "good", "toxic", F.explode(both).alias("x")).select("part", (F.col("mask") + F.col("x.e")).alias("mask"), "good", "toxic", F.col("x.n").alias("n"))
    return out.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(k), F.col("n")).otherwise(0)).alias(k) for k in KINDS[1:]))


def removal_polynomial(counts: list[int]) -> list[int]:
    """Coefficients, by set of variables, of the multilinear extension of "documents removed by a set of filters".

    A document of mask m is removed with 1 - prod(1 - x_i) over the filters i of m, so a set S has, with the sign of its
    size, the documents whose masks hold all of S.
    """
    return [0] + [(-1) ** (s.bit_count() + 1) * sum(n for m, n in enumerate(counts) if m & s == s) for s in range(1, len(counts))]


def at_corner(polynomial: list[int], chosen: int) -> int:
    """The polynomial's value where the variables of ``chosen`` are one and the others zero."""
    return sum(c for s, c in enumerate(polynomial) if s & chosen == s)


def shapley(polynomial: list[int], i: int) -> Fraction:
    """The partial derivative in variable ``i``, integrated along the diagonal from 0 to 1."""
    return sum((Fraction(c, s.bit_count()) for s, c in enumerate(polynomial) if s >> i & 1), Fraction(0))


def audit_of(part: str, counts: dict[str, list[int]]) -> Iterator[tuple]:
    """The rows of one part: all orders of the filters, five steps each."""
    of = {k: removal_polynomial(v) for k, v in counts.items()}
    corner = {k: [at_corner(p, s) for s in range(MASKS)] for k, p in of.items()}
    value = [shapley(of["n"], i) * factorial(len(FILTERS)) for i in range(len(FILTERS))]
    total, every = sum(counts["n"]), MASKS - 1
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            gone = {k: corner[k][after] - corner[k][before] for k in KINDS}
            yield (
                part, name, step, total - corner["n"][after], gone["n"], corner["n"][1 << i] - gone["n"], corner["n"][every] - corner["n"][every ^ 1 << i],
                gone["good"], gone["toxic"], int(value[i]), FILTERS[i],
            )
            before = after


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """AUDIT's rows, zeros included: part, filter_order, step, what the step does, and its filter's Shapley sum.

    Null texts are empty, null and empty lang are one part; texts of any length are counted whole; an empty table gives
    no rows. Of ``docs`` only doc_id, text and lang are read, of ``labels`` doc_id, quality and toxic.
    """
    sums = [F.sum(F.when(F.col("mask") == m, F.col(k)).otherwise(0)) for k in KINDS for m in range(MASKS)]
    counts = mask_counts(docs, labels).groupBy("part").agg(F.array(*sums).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        names, types = zip(*((x.split()[0], kinds[x.split()[1]]) for x in AUDIT.split(", ")), strict=True)
        for batch in batches:
            for part, own in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                rows = audit_of(part, {k: own[MASKS * j : MASKS * (j + 1)] for j, k in enumerate(KINDS)})
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return counts.mapInArrow(run, AUDIT)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The audit of all ``documents`` with ``labels`` (see audit for odd rows)."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH RECURSIVE
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM m GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || f FROM o, f WHERE NOT contains(filter_order, f)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, left(filter_order, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(filter_order) = 5),
x AS (SELECT part, n, n_good, n_toxic, filter_order, step, filter, contains(fails, filter) AS hit, translate(fails, before, '') <> fails AS gone, fails = filter AS alone FROM c, s),
r AS (
  SELECT part, filter_order, step, filter, sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed, sum(n) FILTER (hit AND gone) AS redundant,
    sum(n) FILTER (alone) AS unique_fails, sum(n_good) FILTER (hit AND NOT gone) AS good_lost, sum(n_toxic) FILTER (hit AND NOT gone) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""
