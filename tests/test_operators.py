import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewire import constants as C
from tidewire.functions import numeric as N
from tidewire.functions import text as X
from tidewire.operators import board, cluster, merge, search, series
from tidewire.sources import feeds, json_sources
from tidewire.streaming import ingest

NOW = datetime(2024, 1, 31, 12)
OBS = "id string, n int, source_key string, canonical_url string, lang string, fetched_at timestamp, title string, teaser string, agency string, published_at timestamp, has_date boolean, topic string, feed_url string, feed_rank int, feed_pos int, image_url string, image_kind string"


def observed(n, rank, dated=True, image="", title="t"):
    return ("i", n, "s", "u", "de", NOW + timedelta(minutes=n), f"{title}{n}", "", "", NOW - timedelta(hours=n), dated, C.TOPICS[rank % 5], f"f{rank}", rank, n, image, "feed" if image else "")


def fold(spark, rows):
    return merge.merge_items(spark.createDataFrame(rows, OBS).withColumn("seq", F.col("n"))).collect()


def test_merge_rules_in_any_order(spark):
    rows = [observed(1, 3), observed(2, 1, dated=False, image="a"), observed(3, 1, dated=True), observed(4, 2, dated=False)]
    want = fold(spark, rows)
    assert len(want) == 1
    r = want[0]
    assert (r.title, r.topic, r.feed_url, r.feed_rank, r.feed_pos, r.image_url) == ("t4", C.TOPICS[1], "f1", 1, 1, "a") and r.published_at == NOW - timedelta(hours=3)
    for seed in range(3):
        shuffled = rows * 2
        random.Random(seed).shuffle(shuffled)
        assert fold(spark, shuffled) == want  # replay changes nothing


def test_undated_item_keeps_its_first_date(spark):
    assert fold(spark, [observed(1, 0, False), observed(2, 0, False)])[0].published_at == NOW - timedelta(hours=1)


def test_change_detection_sees_a_b_a(spark):
    raw = spark.createDataFrame([("f", i, i, 200, s) for i, s in enumerate("AABBA")] + [("f", 9, 9, 500, "X")], "feed_url string, fetched_at int, seq int, status int, sha256 string")
    assert [r.sha256 for r in merge.changed(raw).orderBy("seq").collect()] == ["A", "B", "A"]


def test_groups_without_news_are_kept(spark):
    schema = "kind string, symbol string"
    old = spark.createDataFrame([("etf", "a"), ("stock", "b"), ("search", "c")], schema)
    new = spark.createDataFrame([("stock", "d")], schema)
    lots = [["etf", "stock"], ["search"]]
    assert sorted(r.symbol for r in merge.keep_last_good(old, new, "kind", lots).collect()) == ["c", "d"]
    assert merge.keep_last_good(old, new.limit(0), "kind", lots).count() == 3


def heads(spark, rows):
    df = spark.createDataFrame([(f"{i:02d}", s, t, "de" if len(r) < 1 else r[0], C.TOPICS[i % 5], title, NOW - timedelta(minutes=m), i) for i, (s, t, title, m, *r) in enumerate(rows)], "id string, source_key string, source_tier int, lang string, topic string, title string, published_at timestamp, feed_pos int")
    return df.withColumn("tokens", X.tokens(F.col("title")))


EVENT = [
    ("a", 2, "Schweres Erdbeben erschüttert Küste von Chile", 10), ("b", 1, "Erdbeben erschüttert die Küste Chiles schwer", 30), ("c", 3, "Chile: Erdbeben an der Küste erschüttert Region", 50),
    ("d", 1, "Bundestag beschließt Haushalt nach langer Debatte", 20), ("a", 1, "Fußballverein verpflichtet neuen Trainer aus Spanien", 20),
    ("e", 1, "Schweres Erdbeben erschüttert Küste von Chile", 60 * 40), ("f", 1, "Schweres Erdbeben erschüttert Küste von Chile", 12, "en"),
]


def test_clusters(spark):
    docs = heads(spark, EVENT)
    got = {r.item_id: r.cluster_id for r in cluster.build(docs).collect()}
    assert got["00"] == got["01"] == got["02"] == "c01"  # tier 1 leads
    assert len({got[k] for k in ("00", "03", "04", "05", "06")}) == 5  # other events, other times, other languages
    again = {r.item_id: r.cluster_id for r in cluster.build(docs.orderBy(F.desc("id")).repartition(3)).collect()}
    assert again == got


def test_components_agree_with_a_plain_closure(spark):
    random.seed(5)
    nodes, edges = list(range(60)), [(random.randrange(60), random.randrange(60)) for _ in range(45)]
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = cluster.components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long"))
    assert {r.id: r.root for r in got.collect()} == root


def test_components_of_a_star_with_hot_keys(spark, monkeypatch):
    """A hub of 20,000 leaves, a chain and a ring, with every hot key taken apart."""
    from tidewire import session
    from tidewire.operators.components import connected

    monkeypatch.setattr(session, "KEY_ROWS", 0)
    star = spark.range(1, 20_001).selectExpr("id AS a", "0L AS b")
    chain = spark.range(30_000, 30_300).selectExpr("id AS a", "id + 1 AS b")
    ring = spark.range(40_000, 40_050).selectExpr("id AS a", "CASE WHEN id = 40049 THEN 40000 ELSE id + 1 END AS b")
    got = connected(star.unionByName(chain).unionByName(ring))
    assert {r.root: r["count"] for r in got.groupBy("root").count().collect()} == {0: 20_001, 30_000: 301, 40_000: 50}


def test_lookup_takes_hot_keys_apart(spark, monkeypatch):
    from tidewire import session

    monkeypatch.setattr(session, "KEY_ROWS", 0)
    rows = spark.createDataFrame([(1, i) for i in range(5000)] + [(k, 0) for k in range(2, 800)] + [(None, 7)], "k int, v int")
    found = spark.createDataFrame([(1, 5000, "hot"), (2, 1, "cold"), (9999, 3, "none")], "k int, n int, w string")
    got = session.lookup(rows, found, "k", "n", rows.count())
    assert got.count() == rows.count() and {r.w: r["count"] for r in got.groupBy("w").count().collect()} == {"hot": 5000, "cold": 1, None: 798}


def test_candidates_have_no_product(spark):
    docs = heads(spark, EVENT)
    plan = cluster.candidates(docs, cluster.idf_table(docs))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pairs_are_judged_where_they_are_found(spark):
    """The same as by plain loops, and nothing is shuffled but rare tokens before they meet."""
    random.seed(4)
    words = [f"{a}{b}" for a in "bcdfgklm" for b in ("ando", "erti", "ilmo", "ofan", "unke")]
    rows = [(random.choice("xyz"), 1, " ".join(random.choices(words, weights=range(1, 41), k=random.randint(1, 9))), random.choice((5, 90, 2900)), random.choice(("de", "en"))) for _ in range(120)]
    docs, cap = heads(spark, rows), 20
    w = cluster.written(cluster.weighted(docs, cluster.numbered(cluster.idf_table(docs), cap)), "weighted")
    got = {(r.a, r.b): r for r in cluster.similarity(w).collect()}
    assert len(got) == cluster.similarity(w).count()
    df, idf = {r.token: r.df for r in cluster.idf_table(docs).collect()}, {r.token: r.idf for r in cluster.idf_table(docs).collect()}
    every, want = sorted(docs.collect(), key=lambda r: r.id), {}
    for n, a in enumerate(every):
        for b in every[n + 1 :]:
            same = set(a.tokens) & set(b.tokens)
            if a.lang == b.lang and min(len(a.tokens), len(b.tokens)) >= 3 and abs(a.published_at - b.published_at) <= timedelta(hours=36) and any(df[t] <= cap for t in same):
                x, y, i = (sum(idf[t] for t in k) for k in (a.tokens, b.tokens, same))
                similar, contained = i / (x + y - i), i / min(x, y)
                matches = similar >= (0.55 if a.source_key == b.source_key else 0.34) or (len(same) >= 3 and min(len(a.tokens), len(b.tokens)) >= 4 and contained >= 0.62 and similar >= 0.26)
                want[a.id, b.id] = (len(same), round(similar, 9), round(contained, 9), matches)
    assert {k: (r.shared, round(r.similarity, 9), round(r.containment, 9), r.matches) for k, r in got.items()} == want
    assert {k for k, r in got.items()} == {(r.a, r.b) for r in cluster.candidates(docs, cluster.idf_table(docs), cap).collect()} and 0 < sum(r.matches for r in got.values()) < len(got)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = cluster.similarity(w).filter("matches")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(") == plan.count("Exchange hashpartitioning(number#") == 2 and "Aggregate" not in plan


def test_headlines_are_shuffled_once_for_both_sides(spark):
    docs = heads(spark, [("x", 1, "Zoll auf Stahl steigt erneut", 5, "de"), ("y", 1, "Zoll auf Stahl steigt wieder", 5, "de"), ("z", 1, "Regen im Norden", 5, "de")])
    w = cluster.written(cluster.weighted(docs, cluster.numbered(cluster.idf_table(docs))), "weighted")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pairs = cluster.similarity(w)
        assert len(pairs.collect()) == 1
        plan = pairs._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("ReusedExchange") == 1


def test_frequent_tokens_link_too(spark, monkeypatch):
    """Without a cap, the same groups as by plain loops over all pairs: many copies, several stretches of time, frequent tokens in blocks, all keys hot."""
    from tidewire import session

    random.seed(8)
    words = [f"{a}{b}" for a in "bcdfgklm" for b in ("ando", "erti", "ilmo", "ofan", "unke")]
    titles = [" ".join(random.choices(words, weights=range(1, 41), k=random.randint(1, 9))) for _ in range(70)] + [" ".join(random.sample(words[30:], 6) + ["gleich", "immer", "wieder"]) for _ in range(5)]
    rows = [(random.choice("xyz"), 1, random.choice(titles), random.choice((5, 1900, 2900, 4300, 6100, 9000)) + random.randint(0, 400), random.choice(("de", "de", "en"))) for _ in range(170)]
    rows += [("x", 1, "Immer wieder dieselbe Nachricht", 60 * n) for n in range(70)] + [("x", 1, "Immer wieder dieselbe alte Nachricht", 60 * 200 + n) for n in range(3)]
    docs = heads(spark, rows).withColumn("source_key", F.when(F.col("feed_pos") % 11 > 0, F.col("source_key"))).cache()
    idf, every = {r.token: r.idf for r in cluster.idf_table(docs).collect()}, sorted(docs.collect(), key=lambda r: r.id)
    root = {r.id: r.id for r in every}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(every):
        for b in every[n + 1 :]:
            same = set(a.tokens) & set(b.tokens)
            if same and a.lang == b.lang and min(len(a.tokens), len(b.tokens)) >= 3 and abs(a.published_at - b.published_at) <= timedelta(hours=36):
                x, y, i = (sum(idf[t] for t in k) for k in (a.tokens, b.tokens, same))
                similar, contained = i / (x + y - i), i / min(x, y)
                if similar >= (0.55 if a.source_key == b.source_key and a.source_key else 0.34) or (len(same) >= 3 and min(len(a.tokens), len(b.tokens)) >= 4 and contained >= 0.62 and similar >= 0.26):
                    low, high = sorted((find(a.id), find(b.id)))
                    root[high] = low
    want = {r.id: find(r.id) for r in every}
    assert len(set(want.values())) < len({r.root for r in cluster.components(docs, cluster.similarity(cluster.written(cluster.weighted(docs, cluster.numbered(cluster.idf_table(docs))), "weighted")).filter("matches").select("a", "b")).collect()})  # the cap misses some
    assert {r.id: r.root for r in cluster.roots(docs).collect()} == want
    monkeypatch.setattr(cluster, "BLOCK", 7)
    monkeypatch.setattr(session, "KEY_ROWS", 0)
    monkeypatch.setattr(session, "BROADCAST_ROWS", 20)
    assert {r.id: r.root for r in cluster.roots(docs.repartition(5)).collect()} == want
    assert cluster.roots(docs.limit(0)).count() == 0


def test_a_headline_of_many_copies_is_one_story_of_the_brief(spark, tmp_path):
    """daily_brief_top: over 60 copies of a headline from six sources are one story, the first; other tables as in the test data."""
    from tidewire.plans.queries import QUERIES

    rows = [(n, "Immer wieder dieselbe Nachricht\nText" if n < 200 else f"Etwas anderes{n} passiert{n} heute{n}", "de", f"src{n % 6}") for n in range(210)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    events = [(n, NOW, 1, "click", 1.0, '{"k": 1}') for n in range(3)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    near = [n for n in range(200) if n * 37 % 4320 <= 36 * 60]
    lead = min((1 + n % 6 % 3, -(n * 37 % 4320), n) for n in near)[2]
    got = [int(r.url.rsplit("/", 1)[1]) for r in QUERIES["daily_brief_top"](spark, str(tmp_path)).collect()]
    assert len(near) > 60 and len(got) == 5 and got[0] == lead and not set(got[1:]) & set(near)


def test_board_and_its_fingerprint(spark):
    docs = heads(spark, EVENT)
    members = cluster.build(docs).cache()
    summary = cluster.summarise(members)
    sources = spark.createDataFrame([(k, k.upper(), t) for k, t in zip("abcdef", (1, 2, 3, 1, 1, 1), strict=True)], "key string, name string, tier int")
    state = spark.createDataFrame([("03", NOW, None)], "item_id string, read_at timestamp, saved_at timestamp")
    items = docs.drop("tokens", "source_tier").withColumns({c: F.lit("") for c in ("teaser", "canonical_url", "agency", "image_url", "image_kind")})
    at = F.lit(NOW)

    def made(items):
        return board.entries(board.visible(items, sources, state, members, summary, at), at)

    found = made(items)
    assert found.count() == 5 and board.ranked(found, hide_read=True).count() == 4
    top = board.strip(found).collect()
    assert len(top) == 1 and top[0].source_count == 3 and top[0].sources[0] == "A"  # tier decides
    assert board.stats(found, board.ranked(found), state).first().asDict() == {"total": 5, "shown": 5, "read": 1, "saved": 0, "sources": 4}
    assert {r.key: r["count"] for r in board.topic_counts(found).collect()}.keys() == set(C.TOPICS)
    assert board.digest(board.ranked(found)).first() == board.digest(board.ranked(made(items.repartition(7)))).first()


def test_search(spark):
    items = spark.createDataFrame([("1", "Zölle steigen", "Handel", NOW), ("2", "Handel", "mit Zoellen", NOW), ("3", "Wetter", "", NOW)], "id string, title string, teaser string, published_at timestamp")
    assert {r.id for r in search.search(items, 'ZÖLLE "AND').collect()} == set()
    assert {r.id for r in search.search(items, "zölle*").collect()} == {"1", "2"} and search.search(items, ' "* ').count() == 0
    assert [r.id for r in search.contains(items, "Zöllen").collect()] == ["2"]


def test_market_history_and_dividends(spark):
    rows = [("a", i, float(10 + i), False) for i in range(5)] + [("b", i, 1.0, i == 2) for i in range(5)] + [("c", 0, 1.0, False), ("a", 9, None, False)]
    got = series.market_metrics(spark.createDataFrame(rows, "symbol string, seq int, close double, pays boolean"), 2).collect()
    assert len(got) == 1 and (got[0].n, got[0].price, got[0].change_pct, got[0].change_pct_daily) == (5, 14.0, 40.0, 7.7)


def test_long_series_are_not_held(spark):
    """Places of long and short series over many ranges: the same as by lists, and no list of a series in the plan."""
    from tidewire.operators.series import market_metrics

    random.seed(2)
    sizes = {"a": 20_000, "b": 23, "c": 24, "d": 25, "e": 2, "f": 1, "g": 600}
    closes = {s: [round(random.uniform(1, 500), 3) for _ in range(n)] for s, n in sizes.items()}
    rows = [(s, i, c, False) for s, own in closes.items() for i, c in enumerate(own)] + [(s, 100_000 + i, None, False) for s in sizes for i in range(2)] + [("h", 0, None, False)]
    df = spark.createDataFrame(rows, "symbol string, seq int, close double, pays boolean").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", 11)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {r.symbol: r for r in market_metrics(df, 1).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == set(sizes)
    for s, own in closes.items():
        n = len(own)
        line = own if n <= 24 else [own[round(i * (n - 1) / 23)] for i in range(24)]
        want = (n, round(own[-1], 2), round((own[-1] / own[0] - 1) * 100, 1), round((own[-1] / own[-2] - 1) * 100, 1) if n > 1 else 0.0, [round(v, 2) for v in line])
        assert (got[s].n, got[s].price, got[s].change_pct, got[s].change_pct_daily, got[s].spark) == want


def test_changes_from_a_close_of_zero(spark):
    """As IEEE 754 has them, also as the best of the day in the brief."""
    closes = {"a": [0.0, 1.0, 2.0], "b": [1.0, 0.0, 2.0], "c": [0.0, 0.0, 0.0], "d": [2.0, 3.0, 0.0]}
    df = spark.createDataFrame([(s, i, c, False) for s, own in closes.items() for i, c in enumerate(own)], "symbol string, seq int, close double, pays boolean")
    got = series.market_metrics(df, 2)
    inf = float("inf")
    assert {r.symbol: (str(r.change_pct), str(r.change_pct_daily), r.price) for r in got.collect()} == {"a": ("inf", "100.0", 2.0), "b": ("100.0", "inf", 2.0), "c": ("nan", "nan", 0.0), "d": ("-100.0", "-100.0", 0.0)}
    rows = got.filter("symbol <> 'c'").withColumn("kind", F.lit("etf"))
    best = series.finance_stat(series.market_top(rows).withColumn("pos", F.col("nth")), F.lit(NOW)).first()
    assert (best.symbol, best.change) == ("a", inf)
    top = spark.createDataFrame([("1", "t", "s", "u")], "id string, title string, source string, url string")
    brief = series.brief_payload(top, spark.createDataFrame([(31 % 1, "f", "x")], "nth int, title string, text string"), rows, F.lit(NOW))
    assert brief.select(F.from_json("json", "financeStat struct<symbol: string, change: double>").alias("j")).first().j.financeStat.change == inf
    assert [str(r.x) for r in spark.createDataFrame([(-inf,), (inf,), (float("nan"),), (-2.25,), (None,)], "x double").select(N.py_round(F.col("x"), 1).alias("x")).collect()] == ["-inf", "inf", "nan", "-2.2", "None"]


def test_changes_from_a_close_of_negative_zero(spark):
    """Zeros keep their sign, so the infinities over them do."""
    closes = {"a": [-0.0, 1.0], "b": [-0.0, -1.0], "c": [0.0, -1.0], "d": [0.0, 1.0], "e": [-0.0, 0.0]}
    df = spark.createDataFrame([(s, i, c, False) for s, own in closes.items() for i, c in enumerate(own)], "symbol string, seq int, close double, pays boolean")
    got = {r.symbol: (str(r.change_pct), str(r.change_pct_daily)) for r in series.market_metrics(df, 2).collect()}
    assert got == {"a": ("-inf", "-inf"), "b": ("inf", "inf"), "c": ("-inf", "-inf"), "d": ("inf", "inf"), "e": ("nan", "nan")}


def test_spark_line_rounds_the_binary_value(spark):
    """Python's and SQL's formatting: 27.15 is a little less than that, 27.25 and 27.75 are exact ties."""
    values = [0.0, 0.25, 0.75, 0.85, 26.0, 25.95]
    want = " ".join(f"{i / 5 * 100.0:.1f},{28.0 - v / 26.0 * 26.0:.1f}" for i, v in enumerate(values))
    assert spark.createDataFrame([(values,)], "v array<double>").select(series.spark_line(F.col("v")).alias("l")).first().l == want


RSS = b"""\xef\xbb\xbf<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>
<item><title>Ohne Link</title></item>
<item><title>Eins &amp;amp; zwei</title><link>http://www.x.org/1?utm_a=b</link><description>dpa meldet</description><pubDate>Tue, 30 Jan 2024 10:00:00 GMT</pubDate><category>Wirtschaft</category><enclosure type="image/jpeg" url="https://x/a.jpg"/></item>
<item><title>Drei</title><guid>https://x.org/3</guid><content:encoded><![CDATA[<img src="https://x/img/3">]]></content:encoded></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="https://x/s"/><link href="https://x/a"/><id>7</id><updated>2024-01-30T10:00:00Z</updated><summary>S</summary></entry></feed>"""
RDF = b"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><item><title>R</title><link>https://x/r</link><dc:date>2024-01-30</dc:date></item></rdf:RDF>"""


def test_feed_entries():
    rss = feeds.entries_of(RSS)
    assert [(e["position"], e["link"]) for e in rss] == [(1, "http://www.x.org/1?utm_a=b"), (2, "https://x.org/3")] and rss[1]["images"][0]["url"] == "https://x/img/3"
    assert feeds.entries_of(ATOM)[0]["link"] == "https://x/a" and feeds.entries_of(RDF)[0]["date"] == "2024-01-30"
    assert feeds.entries_of(b"<rss><item>") == [] and feeds.entries_of(b"") == []


def known(spark):
    return spark.createDataFrame([("f", "s", "de", "welt", 0), ("g", "s", "de", "politik", 1)], "feed_url string, source_key string, lang string, topic string, feed_rank int")


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    raw = spark.createDataFrame([("f", NOW, 200, None, None, "1", RSS), ("g", NOW + timedelta(hours=1), 200, None, None, "2", RSS), ("x", NOW, 200, None, None, "3", ATOM)], feeds.RAW)
    raw.filter("feed_url <> 'g'").write.mode("append").parquet(f"{tmp_path}/raw")
    folder = [f"{tmp_path}/{x}" for x in ("raw", "observed", "checkpoint")]
    ingest.start(ingest.raw_stream(spark, folder[0]), known(spark), *folder[1:]).awaitTermination()
    raw.filter("feed_url = 'g'").write.mode("append").parquet(folder[0])
    ingest.start(ingest.raw_stream(spark, folder[0]), known(spark), *folder[1:]).awaitTermination()
    want = {r.id: r for r in merge.merge_items(feeds.observations(raw, known(spark))).collect()}
    assert {r.id: r for r in ingest.items(spark, folder[1]).collect()} == want and len(want) == 2
    one = next(r for r in want.values() if r.title.startswith("Eins"))
    assert (one.canonical_url, one.topic, one.agency, one.image_url, one.feed_rank) == ("https://x.org/1", "wirtschaft", "DPA", "https://x/a.jpg", 0)


def test_json_sources(spark):
    body = '{"chart":{"result":[{"meta":{"longName":"L","currency":"EUR"},"indicators":{"quote":[{"close":[1.0,null,2.0]}]},"events":{"dividends":{"1":{"amount":1}}}}]}}'
    rows = json_sources.charts(spark.createDataFrame([("s", body), ("t", "{}")], "symbol string, body string")).collect()
    assert [(r.symbol, r.seq, r.close, r.pays, r.name) for r in rows] == [("s", 0, 1.0, True, "L"), ("s", 1, None, True, "L"), ("s", 2, 2.0, True, "L")]
    body = '{"daily":{"time":["2024-01-30","2024-01-31"],"weather_code":[1],"temperature_2m_max":[5,6],"temperature_2m_min":[1,2],"sunrise":["2024-01-30T08:00"],"sunset":["2024-01-30T17:00"]},"hourly":{"time":["2024-01-30T01:00"],"weather_code":[3],"temperature_2m":[2.5],"precipitation":[0.2]}}'
    r = spark.createDataFrame([("m", body)], "city string, body string")
    assert json_sources.forecast_days(r).count() == 1 and json_sources.forecast_hours(r).first().temp == 2.5
    days, hours = json_sources.forecast_days(r), json_sources.forecast_hours(r)
    got = series.weather_payload(days, hours, "unbekannt", ["m"], F.lit("2024-01-30 01:10:00").cast("timestamp")).first()
    assert got.name == "HEUTE" and got.strip[0].hour == "01:00" and got.hot_hour == "01:00"


def test_board_score_ranks_the_items_of_all_sources(spark, tmp_path):
    from tidewire.functions import numeric as N
    from tidewire.plans import views as V
    from tidewire.plans.queries import QUERIES

    spark.range(20_000).selectExpr("id AS doc_id", "concat('Titel ', id) AS text", "concat('src', id) AS source", "'de' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    every = V.items(spark, str(tmp_path)).withColumn("tier", 1 + F.substring("source_key", 4, 10).cast("int") % 3)
    s = N.score(tier=F.col("tier"), sources=F.lit(1), pos=F.col("feed_pos"), published=F.col("published_at"), topic=F.col("topic"), as_of=V.as_of())
    want = every.withColumn("s", s).orderBy(F.desc("s"), "published_at", "id").limit(C.BOARD_LIMIT).collect()
    assert [r.id for r in QUERIES["board_score"](spark, str(tmp_path)).collect()] == [r.id for r in want]
