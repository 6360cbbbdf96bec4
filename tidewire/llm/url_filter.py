"""URL filters as a sort-merge range join.

A host is keyed by its labels in reverse order (``www.a.org`` -> ``org.a.www.``), so a rule on a host and its
subdomains is one interval of keys, and intervals of different rules nest or are disjoint. Pages and rules are dealt
to the same key ranges, sorted, and swept once; a stack holds the rules whose intervals are open at the sweep's place.

Ranges are cut at sampled keys. The sample decides only where a range ends, never which rule a page gets. A page's
place in the order has a salt behind its key, so that one URL with a third of all rows still falls into many ranges.
A rule goes to each range that its interval touches: rows of rules are at most rules x ranges, and only for rules as
wide as a whole top-level domain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm._shared import table

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The verdict where no rule fits.
DEFAULT = "allow"
#: Rows a range should hold, most ranges, and sampled keys a range.
RANGE_ROWS, MOST_RANGES, SAMPLES = 200_000, 4096, 40


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    """Labels in reverse order, a dot behind each: ``a.org`` -> ``org.a.``; all below it start so."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, list[tuple[str, str, str]]]] = []  # open intervals: key prefix, its (path, rule, verdict)
        at = None
        for batch in batches:
            rules, verdicts, pages = [], [], []
            for i, (part, key, path, is_rule, rule, verdict) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "key", "path", "is_rule", "rule", "verdict")), strict=True)):
                if part != at:
                    at, stack = part, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if is_rule:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append((path, rule, verdict))
                    continue
                best = None
                for _, own in stack:
                    for prefix, name, what in own:
                        # the longest rule wins; of two as long the one with the longer host, which lies deeper
                        if path.startswith(prefix) and (best is None or len(name) >= len(best[0])):
                            best = (name, what)
                pages.append(i)
                rules.append(best[0] if best else None)
                verdicts.append(best[1] if best else default)
            own = pa.array(pages, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in ("page_id", "host", "path")), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return run


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Judge each page's URL by the longest fitting rule: page_id, host, path, rule, verdict.

    ``rules``: host, path, verdict (a table of any size). A rule fits its host and all subdomains where the path starts
    with its path. Null URLs and those without ``://`` have empty host and path and fall to ``default``; an empty page
    table gives no rows; repeated pages are judged alike, row by row; rules that are given twice count once, with the
    smallest verdict. Other columns of ``pages`` are neither read nor returned.
    """
    spark = pages.sparkSession
    u = F.col(url).cast("string")
    keyed = (
        pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), F.xxhash64(page_id, url, F.monotonically_increasing_id()).alias("salt"))
        .withColumn("key", key_of(F.col("host")))
        .withColumn("sort_key", F.concat("key", F.lit("\x01"), F.lpad(F.hex("salt"), 16, "0")))
    )
    n = keyed.count()
    ranges = max(1, min(MOST_RANGES, max(n // RANGE_ROWS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) if n > 2000 else 1)))
    wanted = SAMPLES * ranges
    sample = sorted(r[0] for r in keyed.select("sort_key").filter(F.pmod(F.xxhash64("salt", F.lit(7)), F.lit(max(1, n // wanted))) == 0).limit(4 * wanted).collect()) if ranges > 1 else []
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    borders = np.array(cuts, object)

    def place(side: str, end: bool = False):
        """The range of each key; with ``end`` of the last key below it ('/' is next to '.', so this ends the interval)."""
        return F.pandas_udf(lambda s: pd.Series(np.searchsorted(borders, (s.str[:-1] + "/" if end else s).to_numpy(object), side).astype(np.int32)), "int")

    where, first, last = place("right"), place("left"), place("right", True)
    own = (
        rules.select(ascii_lower(F.col("host")).alias("host"), F.col("path"), F.col("verdict"))
        .groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
        .withColumn("key", key_of(F.col("host")))
        .select(F.explode(F.sequence(first("key"), last("key"))).alias("part"), "key", F.col("key").alias("sort_key"), F.lit(None).cast(keyed.schema["page_id"].dataType).alias("page_id"), F.lit("").alias("host"), "path", F.lit(True).alias("is_rule"), F.concat("host", "path").alias("rule"), "verdict")
    )
    both = keyed.select(where("sort_key").alias("part"), "key", "sort_key", "page_id", "host", "path", F.lit(False).alias("is_rule"), F.lit("").alias("rule"), F.lit("").alias("verdict")).unionByName(own)
    schema = T.StructType([keyed.schema["page_id"], *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])
    return both.repartition(ranges, "part").sortWithinPartitions("part", "sort_key", F.desc("is_rule"), "path").mapInArrow(_sweep(default), schema)


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every ``pages`` URL against the four fixed rules."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


ORACLE = """
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(rh, rp, rv) AS (VALUES ('net','/','block'),('example.net','/en/','allow'),('example.com','/de/','block'),('org','/fr/','allow')),
hit AS (
  SELECT u.*, (SELECT arg_max(rh || rp, length(rh || rp)) FROM r WHERE (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp)) AS rule FROM u)
SELECT page_id, host, path, hit.rule AS rule, coalesce(rv, 'allow') AS verdict FROM hit LEFT JOIN r ON rh || rp = hit.rule
"""
