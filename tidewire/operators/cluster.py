"""Headlines about one event: inverse document frequency, candidate pairs, two similarity tests, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import constants as C
from tidewire import session
from tidewire.functions.numeric import score
from tidewire.operators.components import connected
from tidewire.session import lookup, small, written


def idf_table(docs: DataFrame) -> DataFrame:
    """token, df, idf = ln((n + 1) / (df + 1)) + 1 over all documents (id, tokens), short ones too."""
    df = docs.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.select("token", "df", (F.log(F.lit(docs.count() + 1.0) / (F.col("df") + 1)) + 1).alias("idf"))


def numbered(idf: DataFrame, cap: int = C.CLUSTER["df_cap"]) -> DataFrame:
    """``idf`` with ``number``: one for each token, not negative for those in 2 to ``cap`` documents. Written, as another run would number anew."""
    n = idf.withColumn("number", F.monotonically_increasing_id())
    return written(n.withColumn("number", F.when(F.col("df").between(2, cap), F.col("number")).otherwise(-1 - F.col("number"))), "idf")


def weighted(docs: DataFrame, idf: DataFrame) -> DataFrame:
    """``docs`` with ``numbers`` and ``weights`` of their tokens, in the tokens' order; ``idf`` as from numbered(). Tokens too many to broadcast are looked up, the frequent ones apart."""
    by, known = docs.select("id", F.explode("tokens").alias("token")), idf.select("token", "number", "idf", "df")
    if known.limit(session.BROADCAST_ROWS + 1).count() <= session.BROADCAST_ROWS:
        by = by.join(F.broadcast(known), "token")
    else:
        by = lookup(by, known, "token", "df", known.agg(F.sum("df")).first()[0])
    lists = by.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("token", "number", "idf"))).alias("l"))
    lists = lists.select("id", F.col("l.number").alias("numbers"), F.col("l.idf").alias("weights"))
    return docs.join(lists, "id", "left")


def candidates(docs: DataFrame, idf: DataFrame, cap: int = C.CLUSTER["df_cap"], min_tokens: int = C.CLUSTER["min_tokens"], window_hours: int = C.CLUSTER["window_hours"]) -> DataFrame:
    """Pairs a < b of one language, within the window, both with enough tokens, that share a token in at most ``cap`` documents.

    The cap is part of the semantics and bounds a token's pairs by cap * (cap - 1) / 2, so no token is hot in the join.
    """
    rare = idf.filter(F.col("df").between(2, cap)).select("token")
    post = docs.filter(F.size("tokens") >= min_tokens).select("id", "lang", "published_at", F.explode("tokens").alias("token")).join(small(rare), "token")
    a, b = (post.select("token", "lang", F.col("id").alias(k), F.col("published_at").alias(f"t{k}")) for k in "ab")
    near = F.abs(F.unix_micros("ta") - F.unix_micros("tb")) <= window_hours * 3600 * 1_000_000
    return a.join(b, ["token", "lang"]).filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once a row: filters on them are not pushed below, where they would compute them again."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def total(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)


def similarity(docs: DataFrame, min_tokens: int = C.CLUSTER["min_tokens"], window_hours: int = C.CLUSTER["window_hours"]) -> DataFrame:
    """The candidates() among ``docs`` (as from weighted(), with the cap of numbered()) with shared, similarity (idf-weighted Jaccard), containment and whether they match.

    A headline's numbers and weights (of at most 300 characters) go with each of its rare tokens, so a pair is judged where
    it is found, at the first rare token that it shares: pairs are neither shuffled nor joined with what judges them. Both
    sides have the same columns, so headlines are shuffled once for the two.
    """
    rare = F.explode(F.filter("numbers", lambda n: n >= 0)).alias("number")
    post = docs.filter(F.size("tokens") >= min_tokens).select("id", "lang", "published_at", "source_key", "numbers", "weights", rare)
    side = lambda k: post.select("number", "lang", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "published_at", "source_key", "numbers", "weights")))
    near = F.abs(F.unix_micros("published_at_a") - F.unix_micros("published_at_b")) <= window_hours * 3600 * 1_000_000
    both = side("a").join(side("b"), ["number", "lang"]).filter((F.col("id_a") < F.col("id_b")) & near)
    both = once(both, same=F.array_intersect("numbers_a", "numbers_b")).filter(F.get(F.filter("same", lambda n: n >= 0), F.lit(0)) == F.col("number"))
    weight = lambda n: F.element_at(F.col("weights_a"), F.array_position(F.col("numbers_a"), n).cast("int"))
    out = once(both, i=F.aggregate("same", F.lit(0.0), lambda s, n: s + weight(n)), total_a=total(F.col("weights_a")), total_b=total(F.col("weights_b")))
    shared, union, least = F.size("same"), F.col("total_a") + F.col("total_b") - F.col("i"), F.least("total_a", "total_b")
    out = once(out, shared=shared, similarity=F.when(union > 0, F.col("i") / union).otherwise(0.0), containment=F.when(least > 0, F.col("i") / least).otherwise(0.0))
    k = C.CLUSTER
    threshold = F.when(F.col("source_key_a") == F.col("source_key_b"), k["same_source"]).otherwise(k["threshold"])
    sizes = F.least(F.size("numbers_a"), F.size("numbers_b"))
    contained = (F.col("shared") >= k["min_shared"]) & (sizes >= 4) & (F.col("containment") >= k["containment"]) & (F.col("similarity") >= k["floor"])
    return out.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "shared", "similarity", "containment", ((F.col("similarity") >= threshold) | contained).alias("matches"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, root (the least id reachable) for every node."""
    return nodes.select("id").join(connected(edges), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


#: Token sets that meet in one task for a token: a more frequent token's are dealt over pairs of blocks.
BLOCK = 2000
_SLACK = 1 - 1e-9


def nodes(docs: DataFrame, min_tokens: int = C.CLUSTER["min_tokens"], window_hours: int = C.CLUSTER["window_hours"]) -> tuple[DataFrame, DataFrame]:
    """Documents (id, group), and their groups: one language, the same tokens, and published in one stretch of the window's length, so any two match.

    A group has ``node``, its least id, ``n``, its documents, and ``first`` and ``last``, the earliest and the latest time
    of two sources at most: whether a document of it matches one of another group depends on nothing else. Documents that
    match none by rule (too short, no language or time) have no group.
    """
    start, width = docs.agg(F.min(F.unix_micros("published_at"))).first()[0] or 0, window_hours * 3600 * 1_000_000
    cell = F.expr(f"(unix_micros(published_at) - {start}L) div {width}L").alias("cell")
    may = (F.size("tokens") >= min_tokens) & F.col("lang").isNotNull() & F.col("published_at").isNotNull()
    of = docs.select("id", "source_key", F.unix_micros("published_at").alias("at"), F.when(may, F.struct("lang", F.array_sort("tokens").alias("tokens"), cell)).alias("group"))
    by = of.filter("group IS NOT NULL").groupBy("group", "source_key").agg(F.min("id").alias("id"), F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    ends = lambda at, sign: F.slice(F.array_sort(F.collect_list(F.struct((sign * F.col(at)).alias("at"), "source_key"))), 1, 2).alias(at)
    return of.select("id", "group"), by.groupBy("group").agg(F.min("id").alias("node"), F.sum("n").alias("n"), ends("first", 1), ends("last", -1))


def kinds(groups: DataFrame, idf: DataFrame) -> DataFrame:
    """A row for each language and token set among nodes(): kind (the least id), nodes, size, weight, and numbers and weights of its tokens, in the tokens' order, but those that no other kind of the language has.

    ``rests``: number, kinds (how many have the token) and rest, the weight from that token on, the rarest first. Numbers
    ascend with kinds, so of two kinds' shared tokens the one of the least number is where their rests bound what they share.
    """
    k = groups.groupBy("group.lang", "group.tokens").agg(F.min("node").alias("kind"), F.collect_list(F.struct("group.cell", F.col("node").alias("id"), "first", "last")).alias("nodes"))
    k = written(k, "kinds")
    words = k.select("kind", "lang", F.explode("tokens").alias("token")).select("kind", F.struct("lang", "token").alias("word"))
    known = words.groupBy("word").agg(F.count(F.lit(1)).alias("kinds")).join(idf.select("token", "idf"), F.col("word.token") == F.col("token")).orderBy("kinds", "word")
    number = F.monotonically_increasing_id()
    known = written(known.select("word", "kinds", "idf", F.when(F.col("kinds") > 1, number).otherwise(-1 - number).alias("number")), "words")
    if known.limit(session.BROADCAST_ROWS + 1).count() <= session.BROADCAST_ROWS:
        by = words.join(F.broadcast(known), "word")
    else:
        by = lookup(words, known, "word", "kinds", known.agg(F.sum("kinds")).first()[0])
    by = by.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct(F.col("word.token").alias("token"), "number", "idf", "kinds"))).alias("l"))
    by = by.select("kind", F.size("l").alias("size"), total(F.col("l.idf")).alias("weight"), F.filter("l", lambda x: x["number"] >= 0).alias("l"))
    frequent_first = F.reverse(F.array_sort(F.transform("l", lambda x: F.struct(x["number"].alias("number"), x["kinds"].alias("kinds"), x["idf"].alias("idf")))))
    none = F.struct(F.lit(0.0).alias("rest"), F.array().cast("array<struct<number:bigint,kinds:bigint,rest:double>>").alias("l"))
    longer = lambda s, x: F.struct((s["rest"] + x["idf"]).alias("rest"), F.concat(s["l"], F.array(F.struct(x["number"].alias("number"), x["kinds"].alias("kinds"), (s["rest"] + x["idf"]).alias("rest")))).alias("l"))
    rests = F.aggregate(frequent_first, none, longer, lambda s: s["l"])
    by = by.select("kind", "size", "weight", F.col("l.number").alias("numbers"), F.col("l.idf").alias("weights"), rests.alias("rests"))
    return written(by.join(k.select("kind", "nodes"), "kind"), "kinds")


def alike(kinds: DataFrame) -> DataFrame:
    """Pairs a, b of kinds() whose documents match, whatever their tokens' frequency; ``always``: of one source too.

    A match shares at least a part of both weights, so two kinds are compared only at the rarest token that they share, if
    what follows it suffices in both: frequent tokens come last and mostly need not be looked at, without loss. Rounding is
    allowed for. A pair (a the lighter) is judged where it is found.
    """
    c = C.CLUSTER
    apart, floor = min(c["threshold"], c["same_source"]), c["floor"]
    light, heavy = min(2 * apart / (1 + apart), max(2 * floor / (1 + floor), c["containment"])), min(apart, floor)
    post = kinds.select("kind", "size", "weight", "numbers", "weights", F.inline(F.filter("rests", lambda x: x["rest"] >= heavy * _SLACK * F.col("weight"))))
    blocks = F.ceil(F.col("kinds") / BLOCK).cast("int")
    post = post.withColumn("own", F.pmod(F.hash("kind"), blocks)).select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    post = post.select("number", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "kind", "size", "weight", "numbers", "weights", "rest")
    side = lambda k: post.select("number", "x", "y", *(F.col(n).alias(f"{n}_{k}") for n in ("own", "kind", "size", "weight", "numbers", "weights", "rest")))
    a, b = F.col("weight_a"), F.col("weight_b")
    order = (a < b) | ((a == b) & (F.col("kind_a") < F.col("kind_b")))
    once_met = (F.col("own_a") != F.col("own_b")) | (F.col("x") == F.col("y"))
    least = F.least((a + b) * (apart / (1 + apart)), F.greatest((a + b) * (floor / (1 + floor)), a * c["containment"]))
    may = (F.col("rest_a") >= light * _SLACK * a) & (a >= heavy * _SLACK * b) & (F.least("rest_a", "rest_b") >= _SLACK * least)
    both = side("a").join(side("b"), ["number", "x", "y"]).filter(order & once_met & may)
    both = once(both, same=F.array_intersect("numbers_a", "numbers_b")).filter(F.array_min("same") == F.col("number"))
    weight = lambda n: F.element_at(F.col("weights_a"), F.array_position(F.col("numbers_a"), n).cast("int"))
    out = once(both, i=F.aggregate("same", F.lit(0.0), lambda s, n: s + weight(n)))
    out = once(out, similarity=F.col("i") / (a + b - F.col("i")), containment=F.col("i") / a)
    contained = (F.size("same") >= c["min_shared"]) & (F.least("size_a", "size_b") >= 4) & (F.col("containment") >= c["containment"]) & (F.col("similarity") >= floor)
    out = once(out, always=contained | (F.col("similarity") >= max(c["threshold"], c["same_source"])))
    return out.filter(F.col("always") | (F.col("similarity") >= c["threshold"])).select(F.col("kind_a").alias("a"), F.col("kind_b").alias("b"), "always")


def ties(kinds: DataFrame, pairs: DataFrame, window_hours: int = C.CLUSTER["window_hours"]) -> DataFrame:
    """Pairs a, b of nodes of the kinds in ``pairs`` and of one kind with documents that match: near in time and, if not ``always``, of two sources."""
    pairs = pairs.unionByName(kinds.filter(F.size("nodes") > 1).select(F.col("kind").alias("a"), F.col("kind").alias("b"), F.lit(True).alias("always")))
    few = kinds.limit(session.BROADCAST_ROWS + 1).count() <= session.BROADCAST_ROWS
    for k in "ab":
        found = kinds.select(F.col("kind").alias(k), F.col("nodes").alias(f"nodes_{k}"))
        if few:
            pairs = pairs.join(F.broadcast(found), k)
        else:
            met = pairs.groupBy(k).agg(F.count(F.lit(1)).alias("met"))
            pairs = lookup(pairs, found.join(met, k), k, "met", pairs.count()).drop("met")
    width = window_hours * 3600 * 1_000_000

    def meet(early, late):
        one = lambda p: lambda q: (q["at"] + p["at"] <= width) & (F.col("always") | F.coalesce(p["source_key"] != q["source_key"], F.lit(True)))  # noqa: E731  (p's time is negative)
        return (late["cell"] - early["cell"]).isin(0, 1) & F.exists(early["last"], lambda p: F.exists(late["first"], one(p)))

    met = F.transform("nodes_a", lambda x: F.transform(F.filter("nodes_b", lambda y: meet(x, y) | meet(y, x)), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b"))))
    return pairs.select(F.inline(F.flatten(met))).filter("a <> b")


def roots(docs: DataFrame) -> DataFrame:
    """id, root (the least id reachable) for every document, by all pairs that match, however frequent the tokens that they share."""
    of, groups = nodes(docs)
    groups = written(groups, "groups")
    k = kinds(groups, idf_table(docs))
    links = written(ties(k, written(alike(k), "alike")), "links")
    root = components(groups.select(F.col("node").alias("id")), links).withColumnRenamed("id", "node")
    found = written(groups.select("group", "node", "n").join(root, "node").select("group", "n", "root"), "roots")
    return lookup(of, found, "group", "n", of.count()).select("id", F.coalesce("root", "id").alias("root"))


def build(docs: DataFrame, cap: int | None = C.CLUSTER["df_cap"]) -> DataFrame:
    """Members: cluster_id, item_id, root for every document (id, lang, topic, source_key, source_tier, published_at, tokens). Without a cap, pairs that share none but frequent tokens are judged too."""
    if cap is None:
        found = roots(docs)
    else:
        w = written(weighted(docs.select("id", "lang", "published_at", "source_key", "tokens"), numbered(idf_table(docs), cap)), "weighted")
        found = components(docs, written(similarity(w).filter("matches").select("a", "b"), "links"))
    rooted = written(docs.select("id", "topic", "lang", "source_key", "source_tier", "published_at").join(found, "id"), "rooted")
    leads = rooted.groupBy("root").agg(F.min_by("id", F.struct("source_tier", "published_at", "id")).alias("lead_id"), F.count(F.lit(1)).alias("n"))
    members = lookup(rooted, leads, "root", "n", rooted.count())
    return members.select(F.concat(F.lit("c"), F.substring("lead_id", 1, 16)).alias("cluster_id"), "lead_id", F.col("id").alias("item_id"), "topic", "lang", "source_key")


def majority_topic(members: DataFrame) -> DataFrame:
    """cluster_id, topic: the most frequent, of several the first in topic order, unknown ones last."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, C.TOPICS)), F.col("topic")), F.lit(0)), F.lit(99))
    counts = members.groupBy("cluster_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("cluster_id").agg(F.min_by("topic", F.struct(-F.col("n"), order, F.col("topic"))).alias("topic"))


def summarise(members: DataFrame) -> DataFrame:
    """cluster_id, lead_id, size, source_count, topic, lang."""
    base = members.groupBy("cluster_id", "lead_id").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("source_key").alias("source_count"), F.min("lang").alias("lang"))
    return base.join(majority_topic(members), "cluster_id")


def scored(summary: DataFrame, docs: DataFrame, as_of: Column) -> DataFrame:
    """``summary`` with the score that its lead has with the cluster's topic and sources."""
    lead = docs.select(F.col("id").alias("lead_id"), "source_tier", "feed_pos", "published_at")
    value = score(tier=F.col("source_tier"), sources=F.col("source_count"), pos=F.col("feed_pos"), published=F.col("published_at"), topic=F.col("topic"), as_of=as_of)
    return summary.join(lead, "lead_id").withColumn("score", value).drop("source_tier", "feed_pos", "published_at")


def stats(summary: DataFrame) -> DataFrame:
    """items, clusters, multi_source, max_sources."""
    return summary.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("items"), F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("source_count") > 1).alias("multi_source"), F.coalesce(F.max("source_count"), F.lit(0)).alias("max_sources"),
    )
