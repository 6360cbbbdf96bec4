"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire import session
from tidewire.session import lookup, release, written


def connected(edges: DataFrame) -> DataFrame:
    """id, root (the least id reachable) for each end of ``edges`` (a, b).

    Each round takes the neighbours' least label and jumps along it, so long chains need few rounds. Rounds are written,
    so the plan doesn't grow and a lost executor costs one round; nothing but counts and a flag comes to the driver. A
    node with many neighbours and a label with many nodes are hot keys: lookup() takes them apart.
    """
    pairs = edges.select(F.col("a").alias("id"), F.col("b").alias("other"))
    both = written(pairs.unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct(), "edges")
    labels = written(both.groupBy("id").agg(F.least("id", F.min("other")).alias("root"), F.count(F.lit(1)).alias("degree")), "labels")
    ends, nodes = both.count(), labels.count()
    while True:
        seen = labels.select(F.col("id").alias("other"), F.col("root").alias("seen"), "degree")
        near = lookup(both, seen, "other", "degree", ends).groupBy("id").agg(F.min("seen").alias("seen"))
        step = labels.join(near, "id").select("id", "degree", F.col("root").alias("was"), F.least("root", "seen").alias("root"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("next"))
        if nodes > session.KEY_ROWS:  # else no label can be hot
            step = written(step, "labels")
            jump = jump.join(step.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root")
        new = written(lookup(step, jump, "root", "size", nodes).select("id", "degree", "was", F.least("root", "next").alias("root")), "labels")
        release(step, labels)
        if new.filter("was <> root").isEmpty():
            release(both)
            return new.select("id", "root")
        labels = new
