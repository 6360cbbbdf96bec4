"""The store, refresh, rebuild and export, and the data sources against a server of our own."""

import hashlib
import json
import threading
import time
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tidewire import constants as C
from tidewire.functions import text as X
from tidewire.operators import merge, search, series
from tidewire.plans import engine
from tidewire.plans.store import Store, as_lines, by_second, write_json
from tidewire.plans.views import as_of
from tidewire.sources import feeds, http, json_sources
from tidewire.streaming import ingest, state

def rss(*entries):
    rows = "".join(f"<item><title>{t}</title><link>https://x.org/{u}</link><description>{t} teaser</description><pubDate>Tue, 30 Jan 2024 {h:02d}:00:00 GMT</pubDate></item>" for u, t, h in entries)
    return f"<rss><channel>{rows}</channel></rss>".encode()


def response(feed, second, body, status=200):
    return (feed, datetime(2024, 1, 30, 20, 0, second), status, None, None, hashlib.sha256(body).hexdigest() if body else None, body)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = engine.open_store(spark, f"file://{tmp_path_factory.mktemp('store')}")
    sources = spark.createDataFrame([("a", "Blatt A", 1, "de", True), ("b", "Blatt B", 2, "de", False)], engine.SOURCE)
    engine.sync_sources(s, sources, spark.createDataFrame([("fa", "a", "de", "politik", 0), ("fb", "b", "de", "welt", 1)], engine.FEED))
    return s


def test_refresh_then_rebuild_then_export(spark, store, tmp_path):
    line = "Grosses Hochwasser trifft viele Orte am Fluss"
    first = spark.createDataFrame([response("fa", 1, rss(("1", line, 10), ("2", "Neue Brücke im Norden eröffnet gestern", 11))), response("fb", 1, rss(("3", line + " erneut", 12))), response("gone", 1, rss(("9", "Niemand kennt diese Quelle mehr heute", 9)))], feeds.RAW)
    done = engine.refresh(store, first, as_of())
    assert done["fetched"] == {"feeds": 3, "ok": 3, "not_modified": 0, "changed": 3} and done["items"] == 3 and done["clusters"]["multi_source"] == 1
    second = spark.createDataFrame([response("fa", 2, b"", 304), response("fb", 2, rss(("3", line + " erneut", 12)))], feeds.RAW)
    assert engine.refresh(store, second, as_of())["fetched"] == {"feeds": 2, "ok": 1, "not_modified": 1, "changed": 0}
    items = {r.id: r for r in store.read("item", engine.ITEM).collect()}
    assert len(items) == 3 and {r.image_kind for r in items.values()} == {"tile"}
    before = sorted(map(tuple, engine.found(store, as_of()).select("id", "story", "size", "source_count", F.round("score", 9)).collect()))
    assert [x[2:4] for x in sorted(before, key=lambda x: -x[2])] == [(2, 2), (1, 1)]
    engine.rebuild(store, as_of())  # once more gives the same
    assert sorted(map(tuple, engine.found(store, as_of()).select("id", "story", "size", "source_count", F.round("score", 9)).collect())) == before
    assert [r.title for r in engine.search_items(store, "BRÜCK").collect()] == ["Neue Brücke im Norden eröffnet gestern"]
    assert engine.search_items(store, " ").count() == 0
    store.append("state", spark.createDataFrame([(next(i for i, r in items.items() if "Brücke" in r.title), "saved", True, datetime(2024, 1, 30), 1, 0)], engine.STATE))
    assert engine.search_items(store, "", saved_only=True).count() == 1 and engine.search_items(store, "hochwasser", saved_only=True).count() == 0

    market = spark.createDataFrame([("E", "etf", 1.5, 2.0), ("S", "stock", 2.5, -1.0), ("Q", "search", 0.5, 0.0)], "symbol string, kind string, change_pct double, change_pct_daily double")
    facts = spark.createDataFrame([(0, "t0", "x0"), (1, "t1", "x1")], "nth int, title string, text string")
    days = spark.createDataFrame([("Rom", datetime(2024, 1, 31).date(), 0, 10.4, 2.5, "07:00", "18:00")], "city string, day date, code int, hi double, lo double, sunrise string, sunset string")
    hours = spark.createDataFrame([("Rom", datetime(2024, 1, 31, h), 0, float(h), 0.0) for h in range(3)], "city string, hour timestamp, code int, temp double, precip double")
    engine.export(store, as_of(), f"file://{tmp_path}/out", facts, market, days, hours, ["Rom"])
    read = lambda name: json.loads((tmp_path / f"out/data/{name}.json").read_text("utf-8"))
    full = read("board")
    assert len(full) == 2 and full[0]["score"] >= full[1]["score"] and "read" not in full[0] and all(x["image"] == f"tiles/{x['id']}.svg" for x in full)
    assert {len(x["cluster"]["others"]) for x in full} == {0, 1} and list(full[0]) == sorted(full[0])
    assert [x["publishedAt"] for x in read("search")] == sorted((x["publishedAt"] for x in read("search")), reverse=True) and len(read("search")) == 3
    assert {f.name for f in (tmp_path / "out/tiles").iterdir()} == {f"{i}.svg" for i in items}
    brief = read("brief")
    assert len(brief["top5"]) == 2 and brief["fact"] == {"extract": "x1", "title": "t1"} and brief["financeStat"]["symbol"] == "S" and brief["financeStat"]["change"] == 2.5
    assert read("weather")[0]["hot_hour"] == "02:00" and {x["key"] for x in read("meta")} == {"last_fetch_at", "mode"}
    assert [(x["kind"], x["nth"]) for x in read("markets")] == [("etf", 1), ("search", 1), ("stock", 1)]


def test_a_response_of_the_same_second_is_replaced(spark, store):
    log = spark.createDataFrame([("f", datetime(2024, 1, 1, 0, 0, 0, 5), 0), ("f", datetime(2024, 1, 1, 0, 0, 0, 9), 1), ("f", datetime(2024, 1, 1, 0, 0, 1), 2)], "feed_url string, fetched_at timestamp, batch long")
    assert sorted(r.batch for r in by_second(log).collect()) == [1, 2]


def test_older_files_lack_new_columns(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.append("log", spark.range(2))
    s.append("log", spark.range(2, 3).withColumn("more", F.lit("x")))
    assert sorted((r.id, r.more) for r in s.log("log", "id long, more string, batch long").collect()) == [(0, None), (1, None), (2, "x")]
    s.replace("t", spark.range(3))
    s.replace("t", s.read("t", "id long").filter("id > 0"))  # reads what it replaces
    assert s.read("t", "id long").count() == 2 and s.read("none", "id long").count() == 0


def test_spark_line_points(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0],), ([5.0, 5.0],), ([1.0],), ([],)], "v array<double>").select(series.spark_line(F.col("v")).alias("p"))
    assert [r.p for r in rows.collect()] == ["0.0,28.0 50.0,15.0 100.0,2.0", "0.0,28.0 100.0,28.0", "", ""]


def test_tiles_are_escaped_and_depend_on_the_id(spark):
    rows = spark.createDataFrame([("00000001ab", 'A & <B> "C"', "welt"), ("00000002ab", "A", "welt"), ("", "A", "welt")], "id string, s string, t string").select(X.tile_svg(F.col("id"), F.col("s"), F.col("t")).alias("x"))
    import xml.etree.ElementTree as E

    got = [r.x for r in rows.collect()]
    assert len(set(got)) == 3 and all(E.fromstring(x) is not None for x in got) and any(p[0] in got[0] for p in C.TILE_PALETTE)


class Answers(BaseHTTPRequestHandler):
    asked: list = []
    #: What tests put there: path -> (status, headers, body); times and validators of requests.
    served: dict = {}
    seen: list = []

    def do_GET(self):
        self.asked.append(self.path)
        self.seen.append((self.path.partition("?")[0], time.monotonic(), self.headers.get("Host"), self.headers.get("If-None-Match"), self.path))
        if (own := self.served.get(self.path.partition("?")[0])) is not None:
            self.send_response(own[0])
            for k, v in own[1].items():
                self.send_header(k, v)
            self.send_header("Content-Length", str(len(own[2])))
            self.end_headers()
            self.wfile.write(own[2])
            return
        if self.path.startswith("/feed") and self.headers.get("If-None-Match") == "v1":
            self.send_response(304)
            self.end_headers()
            return
        status = 500 if self.path == "/broken" else 404 if self.path == "/gone" else 200
        body = json.dumps({"q": self.path}).encode() if self.path.startswith("/api") else ("ü" * 200_000).encode() if self.path == "/long" else b"<rss/>"
        self.send_response(status)
        self.send_header("ETag", "v1")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        try:
            self.wfile.write(body)
        except OSError:
            pass

    def log_message(self, *args):
        pass


@pytest.fixture
def server(spark):
    http.register(spark)
    own = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    Answers.served.clear()
    Answers.seen.clear()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()
    Answers.served.clear()


def registry(spark, root, at, feeds_of):
    """A store whose sources have a feed each: (key, path, no_scrape)."""
    store = engine.open_store(spark, f"file://{root}")
    sources = spark.createDataFrame([(k, k.upper(), 1, "de", closed) for k, _, closed in feeds_of], engine.SOURCE)
    engine.sync_sources(store, sources, spark.createDataFrame([(f"{at}{p}", k, "de", "welt", n) for n, (k, p, _) in enumerate(feeds_of)], engine.FEED))
    return store


def items_of(store):
    return sorted(map(tuple, engine.stored(store, "item").drop("first_seen_at").collect()))


QUICK = {"delay": 0, "tries": 1}


def test_each_feed_is_asked_once_a_refresh(spark, server, tmp_path):
    store = registry(spark, tmp_path, server, [("a", "/fa", True), ("b", "/fb", True), ("c", "/fc", True)])
    count = lambda: {p: sum(x[0] == p for x in Answers.seen) for p in ("/fa", "/fb", "/fc")}
    body = rss(("1", "Neue Brücke im Norden eröffnet gestern", 10))
    Answers.served |= {"/fa": (200, {"ETag": "e1", "Last-Modified": "m1"}, body), "/fb": (200, {}, rss(("2", "Zug fährt wieder durch das Tal", 11))), "/fc": (500, {}, b"")}
    done = engine.refresh(store, engine.fetch_feeds(store, **QUICK), as_of())
    assert count() == {"/fa": 1, "/fb": 1, "/fc": 1} and done["fetched"] == {"feeds": 3, "ok": 2, "not_modified": 0, "changed": 2} and done["items"] == 2
    # what the log holds is what items were made of
    assert {r.feed_url.rpartition("/")[2]: r.status for r in store.read("raw", engine.RAW).collect()} == {"fa": 200, "fb": 200, "fc": 500}
    before = items_of(store)
    # a 304 that names no validators keeps those known; an unchanged body changes nothing
    Answers.served["/fa"] = (304, {}, b"")
    assert engine.refresh(store, engine.fetch_feeds(store, **QUICK), as_of())["fetched"] == {"feeds": 3, "ok": 1, "not_modified": 1, "changed": 0}
    assert [x[3] for x in Answers.seen if x[0] == "/fa"] == [None, "e1"] and count() == {"/fa": 2, "/fb": 2, "/fc": 2}
    assert {r.feed_url.rpartition("/")[2]: (r.etag, r.last_modified, r.status) for r in store.read("feed_state", engine.FEED_STATE).collect()} == {"fa": ("e1", "m1", 304), "fb": (None, None, 200), "fc": (None, None, 500)}
    assert items_of(store) == before
    engine.rebuild(store, as_of())
    assert items_of(store) == before and sum(count().values()) == 6
    Answers.served["/fa"] = (200, {"ETag": "e2"}, rss(("1", "Neue Brücke im Norden ist offen", 10), ("3", "Wetter bleibt trocken und warm", 12)))
    done = engine.refresh(store, engine.fetch_feeds(store, **QUICK), as_of())
    assert [x[3] for x in Answers.seen if x[0] == "/fa"][2] == "e1" and done["items"] == 3 and done["fetched"]["changed"] == 1
    assert {r.title for r in engine.stored(store, "item").collect()} == {"Neue Brücke im Norden ist offen", "Zug fährt wieder durch das Tal", "Wetter bleibt trocken und warm"}
    assert len([x for x in Answers.seen if x[3]]) == 2 and engine.fetch_feeds(store, force=True, **QUICK).filter("status = 200").count() == 2
    assert not [x for x in Answers.seen[-3:] if x[3]]


def test_hosts_are_asked_in_turns_with_pauses(spark, server):
    port = server.rpartition(":")[2]
    hosts = [f"http://127.0.0.1:{port}", f"http://localhost:{port}"]
    Answers.served |= {f"/p{i}": (200, {}, b"x") for i in range(3)}
    asked = spark.createDataFrame([(f"{h}/p{i}",) for h in hosts for i in range(3)] + [(None,), ("no url",)], "canonical_url string")
    began = time.monotonic()
    got = http.ask(asked, http.PageReader, http.PAGE, parts=1, delay=0.6, tries=1).collect()
    took = time.monotonic() - began
    assert len(got) == 7 and sum(r.html == "x" for r in got) == 6
    for host in ("127.0.0.1", "localhost"):
        times = sorted(x[1] for x in Answers.seen if x[2].startswith(host))
        assert len(times) == 3 and all(b - a >= 0.4 for a, b in zip(times, times[1:], strict=False))
    assert took >= 1.2  # two pauses of each host


def test_pages_are_looked_at_once(spark, server, tmp_path):
    """Misses count as looked at, forbidden sources are never asked, and the budget moves on to further pages."""
    store = registry(spark, tmp_path, server, [("a", "/fa", False), ("b", "/fb", True)])
    entry = lambda host, i: f"<item><title>Nummer {i} von vielen Meldungen</title><link>{host}/page{i}</link><pubDate>Tue, 30 Jan 2024 10:00:00 GMT</pubDate></item>"
    Answers.served |= {"/fa": (200, {}, f"<rss><channel>{''.join(entry(server, i) for i in range(4))}</channel></rss>".encode()), "/fb": (200, {}, f"<rss><channel>{entry(server, 9)}</channel></rss>".encode())}
    ask = lambda pages: http.ask(pages.select(F.regexp_replace("canonical_url", "^https", "http").alias("canonical_url")), http.PageReader, http.PAGE, **QUICK).withColumn("canonical_url", F.regexp_replace("canonical_url", "^http:", "https:"))
    Answers.served["/page2"] = (200, {}, b'<meta property="og:image" content="https://x/i.jpg">')
    kinds = lambda: sorted((r.canonical_url[-5:], r.image_kind) for r in engine.stored(store, "item").collect())
    looked = lambda: sorted(x[0] for x in Answers.seen if x[0].startswith("/page"))
    for n, budget in enumerate((3, 3)):  # three pages, then the last one: misses aren't asked again
        engine.refresh(store, engine.fetch_feeds(store, **QUICK), as_of(), image_budget=budget, pages=ask)
        assert len(looked()) == (3, 4)[n]
    assert looked() == ["/page0", "/page1", "/page2", "/page3"]
    assert kinds() == [("page0", "tile"), ("page1", "tile"), ("page2", "og"), ("page3", "tile"), ("page9", "tile")]
    cache = {r.canonical_url[-5:]: r.image_url for r in store.read("og_cache", engine.CACHE).collect()}
    assert cache == {"page0": "", "page1": "", "page2": "https://x/i.jpg", "page3": "", "page9": ""}


def batch_of(spark, feed, second, *entries):
    return spark.createDataFrame([response(feed, second, rss(*entries))], feeds.RAW)


def many(start, n, word="Meldung"):
    return [(f"{i}", f"{word} Nummer {i} über Ereignis {i % 7} heute", i % 20) for i in range(start, start + n)]


def parts_of(store, root, name="item"):
    commit = max((root / name).glob("c*"), key=lambda p: int(p.name.split("-")[1]))
    return {p.name for p in commit.glob("part=*")}


def test_a_refresh_rewrites_what_it_touches(spark, tmp_path):
    store = registry(spark, tmp_path, "", [("a", "fa", True), ("b", "fb", True)])
    engine.refresh(store, batch_of(spark, "fa", 1, *many(0, 120)).unionByName(batch_of(spark, "fb", 1, *many(500, 5))), as_of())
    assert len(parts_of(store, tmp_path)) > 40
    board, hits = engine.found(store, as_of()), engine.search_items(store, "nummer")
    engine.refresh(store, batch_of(spark, "fb", 2, *many(500, 5), ("600", "Ganz neues Ereignis im Hafen", 3), ("500", "Berichtigt Nummer 500 im Hafen", 2)), as_of())
    assert 0 < len(parts_of(store, tmp_path)) <= 6
    items = engine.stored(store, "item")
    assert items.count() == 126 and items.select("id").distinct().count() == 126
    # a board and a search that began before the refresh can still be read, as they were
    assert board.count() > 0 and board.agg(F.sum("size")).first()[0] == 125 and hits.count() == 60
    # equal to folding all that was observed
    observed = feeds.observations(engine.full_log(store), store.read("feed", engine.FEED))
    want = {r.id: (r.title, r.published_at, r.feed_url) for r in merge.merge_items(observed).collect()}
    assert {r.id: (r.title, r.published_at, r.feed_url) for r in items.collect()} == want


def test_a_failed_refresh_leaves_readers_where_they_were(spark, tmp_path, monkeypatch):
    store = registry(spark, tmp_path, "", [("a", "fa", True)])
    engine.refresh(store, batch_of(spark, "fa", 1, *many(0, 10)), as_of())
    before = items_of(store)
    monkeypatch.setattr(engine, "rebuild_clusters", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        engine.refresh(store, batch_of(spark, "fa", 2, *many(0, 10), ("77", "Neues aus dem Hafen von heute", 3)), as_of())
    assert items_of(store) == before and engine.search_items(store, "hafen").count() == 0
    monkeypatch.undo()
    engine.refresh(store, batch_of(spark, "fa", 3, *many(0, 10), ("77", "Neues aus dem Hafen von heute", 3)), as_of())
    assert len(items_of(store)) == 11 and engine.search_items(store, "hafen").count() == 1 and store.read("figures", engine.FIGURES).first().n == 11


def test_index_segments(spark, tmp_path, monkeypatch):
    """Edits make earlier postings dead; segments merge; scores are those of an index made anew; files hold ranges of tokens."""
    monkeypatch.setattr(engine, "MOST_SEGMENTS", 2)
    store = registry(spark, tmp_path, "", [("a", "fa", True)])
    sizes = []
    for n in range(3):
        engine.refresh(store, batch_of(spark, "fa", n, *many(0, 30 + 4 * n, f"Bericht{n // 2}"), ("x", f"Hafen Stand {n}", 4)), as_of())
        sizes.append(len(store.segments("posting")))
        items = engine.stored(store, "item")
        size, dead = store.read("figures", engine.FIGURES), merge.latest_per_key(store.read("dead", engine.DEAD), ["id"], ["below"])
        for query in ("bericht nummer", f"hafen {n}"):
            got = search.bm25(store.read("posting", engine.POSTING), size, query, dead=dead.select("id", "below"))
            posts = search.postings(items)
            want = search.bm25(posts, search.figures(items, posts), query)
            assert sorted((r.id, round(r.score, 9)) for r in got.collect()) == sorted((r.id, round(r.score, 9)) for r in want.collect()) != []
    assert max(sizes) == 2 and sizes[0] == 1
    plan = search.bm25(store.read("posting", engine.POSTING), size, "hafen")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,hafen)" in plan
    posts = search.ranged(search.postings(items)).repartitionByRange(4, "token", "id").sortWithinPartitions("token", "id")
    posts.write.parquet(f"{tmp_path}/ranged")
    files = spark.read.parquet(f"{tmp_path}/ranged").groupBy(F.input_file_name().alias("f")).agg(F.min("token").alias("a"), F.max("token").alias("b")).orderBy("a").collect()
    assert len(files) > 1 and all(x.b <= y.a for x, y in zip(files, files[1:], strict=False))


def test_old_days_of_the_log_go_as_folders(spark, tmp_path):
    store = registry(spark, tmp_path, "", [("a", "fa", True), ("b", "fb", True)])
    at = lambda day: F.lit(f"2024-02-{day:02d} 12:00:00").cast("timestamp")

    def answers(day, *feeds_of):
        rows = [response(f, 0, body, status) for f, body, status in feeds_of]
        return spark.createDataFrame([(r[0], datetime(2024, 2, day, 11), *r[2:]) for r in rows], feeds.RAW)

    old = rss(("1", "Alter Bericht aus dem Archiv der Stadt", 10))
    engine.refresh(store, answers(1, ("fa", old, 200), ("fb", rss(("2", "Zweiter Bericht aus der Stadt", 9)), 200)), at(1))
    engine.refresh(store, answers(9, ("fa", b"", 304), ("fb", rss(("2", "Bericht vom Tag 9 aus der Stadt", 9)), 200)), at(9))
    assert {p.name for p in (tmp_path / "raw").glob("c*/day=*")} == {"day=2024-02-09"}
    # the silent feed's body stays, once; the other's old one is gone
    assert [(r.feed_url, bytes(r.body)) for r in store.read("kept", engine.RAW).collect()] == [("fa", old)]
    kept = sorted((tmp_path / "kept").glob("c*"))
    assert engine.prune(store, at(10)) == [] and sorted((tmp_path / "kept").glob("c*")) == kept  # nothing expired, nothing moved
    engine.rebuild(store, at(10))
    assert {r.title for r in engine.stored(store, "item").collect()} == {"Alter Bericht aus dem Archiv der Stadt", "Bericht vom Tag 9 aus der Stadt"}
    store.append("raw", answers(20, ("fa", old, 200)).withColumn("day", F.lit("2024-02-20")), by="day")
    assert engine.prune(store, at(20)) == ["2024-02-09"] and {r.feed_url for r in store.read("kept", engine.RAW).collect()} == {"fb"}


def test_older_markets_get_their_kind(spark, tmp_path):
    store = engine.open_store(spark, f"file://{tmp_path}")
    store.replace("market", spark.createDataFrame([("AMZN", "Amazon", 200.0, "USD", 30.0, datetime(2024, 1, 1))], "symbol string, name string, price double, currency string, change_pct double, fetched_at timestamp"))
    row = engine.stored(store, "market").first()
    assert (row.kind, row.spark, row.change_pct_daily) == ("stock", [], 0.0)
    new = spark.createDataFrame([("AMZN", "search", "Amazon", 200.0, "USD", 0.0, 0.0, [1.0], datetime(2024, 1, 2))], engine.MARKET)
    store.replace("market", merge.keep_last_good(engine.stored(store, "market"), new, "kind", [["etf", "stock"], ["search"]]))
    assert sorted((r.symbol, r.kind) for r in engine.stored(store, "market").collect()) == [("AMZN", "search"), ("AMZN", "stock")]
    store.replace("day", spark.createDataFrame([("Rom", datetime(2024, 1, 1).date(), 1, 2.0, 1.0)], "city string, day date, code int, hi double, lo double"))
    assert engine.stored(store, "day").first().sunrise == ""


def chart(closes, dividends=None, **meta):
    return json.dumps({"chart": {"result": [{"meta": meta, "indicators": {"quote": [{"close": closes}]}, "events": {"dividends": dividends} if dividends else {}}]}}).encode()


def test_markets_are_refreshed_when_stale(spark, server, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "MARKET_TTL_MINUTES", 720)
    store = engine.open_store(spark, f"file://{tmp_path}")
    long = [100.0 + i for i in range(500)]
    Answers.served |= {
        "/c/E1": (200, {}, chart(long, shortName="Welt UCITS ETF (Acc)", currency="EUR", regularMarketPrice=612.345)), "/c/S1": (200, {}, chart([*long, None], longName="Firma Inc.")),
        "/c/S2": (200, {}, chart(long, {"1": {"amount": 1.0}}, shortName="Zahlt AG")), "/c/S3": (200, {}, chart(long[:10])), "/c/S4": (404, {}, b""),
    }
    kinds = [("E1", "etf"), ("S1", "stock"), ("S2", "stock"), ("S3", "stock"), ("S4", "stock"), ("S2", "search"), ("S3", "search"), ("S1", "search")]
    securities = spark.createDataFrame(kinds, engine.SECURITY)
    now = lambda h: F.lit(datetime(2024, 1, 31) + timedelta(hours=h)).cast("timestamp")
    ask = lambda h, **more: engine.refresh_markets(store, securities, server + "/c/{symbol}", now(h), **QUICK, **more)
    assert ask(0) == {"refreshed": True, "etfs": 1, "stocks": 1, "search": 3}
    assert len(Answers.seen) == 5 and "range=3y&interval=1d&events=div%2Csplits" in Answers.seen[0][4]
    rows = {(r.symbol, r.kind): r for r in engine.stored(store, "market").collect()}
    assert rows["E1", "etf"].name == "Welt" and rows["E1", "etf"].price == 612.35 and rows["E1", "etf"].currency == "EUR"
    assert (rows["S1", "stock"].name, rows["S1", "stock"].price, rows["S1", "stock"].change_pct, rows["S1", "stock"].change_pct_daily, len(rows["S1", "stock"].spark)) == ("Firma", 599.0, 499.0, 0.2, 24)
    assert rows["S3", "search"].spark == long[:10]
    assert ask(11) == {"refreshed": False, "age_minutes": 660.0} and len(Answers.seen) == 5
    Answers.served.clear()
    Answers.served |= {f"/c/{s}": (500, {}, b"") for s in ("E1", "S1", "S2", "S3", "S4")}
    assert ask(13) == {"refreshed": False, "etfs": 0, "stocks": 0, "search": 0, "failed": True} and len(engine.stored(store, "market").collect()) == 5
    Answers.served["/c/S3"] = (200, {}, chart([1.0, 2.0]))
    assert ask(14)["search"] == 1 and {r.symbol for r in engine.stored(store, "market").filter("kind = 'search'").collect()} == {"S3"}
    assert {(r.symbol, r.kind) for r in engine.stored(store, "market").filter("kind <> 'search'").collect()} == {("E1", "etf"), ("S1", "stock")}


def test_weather_is_refreshed_when_stale(spark, server, tmp_path):
    store = engine.open_store(spark, f"file://{tmp_path}")
    cities = spark.createDataFrame([("Rom", 41.9, 12.5, 0), ("Oslo", 59.9, 10.7, 1)], engine.CITY)
    block = lambda t, **more: {"daily": {"time": ["2024-01-31", "2024-02-01"], "weather_code": [1, 3], "temperature_2m_max": [t, t + 1], "temperature_2m_min": [0.0, 1.0], **more}, "hourly": {"time": ["2024-01-31T01:00"], "weather_code": [3], "temperature_2m": [t]}}
    Answers.served["/w"] = (200, {}, json.dumps([block(9.0, sunrise=["2024-01-31T07:10"], sunset=["2024-01-31T17:20"]), block(2.0)]).encode())
    now = lambda m: F.lit(datetime(2024, 1, 31, 10) + timedelta(minutes=m)).cast("timestamp")
    ask = lambda m: engine.refresh_weather(store, cities, server + "/w", now(m), **QUICK)
    assert ask(0) == {"cities": 2} and len(Answers.seen) == 1 and "latitude=41.9%2C59.9" in Answers.seen[0][4]
    days = {(r.city, str(r.day)): r for r in engine.stored(store, "day").collect()}
    assert set(days) == {("Rom", "2024-01-31"), ("Oslo", "2024-01-31"), ("Oslo", "2024-02-01")}  # to the shortest; what is missing is blank
    assert days["Rom", "2024-01-31"].sunrise == "07:10" and days["Oslo", "2024-02-01"].sunrise == "" and {r.precip for r in engine.stored(store, "hour").collect()} == {0.0}
    assert ask(59) == {"cities": 0, "cached": 2} and len(Answers.seen) == 1
    Answers.served["/w"] = (500, {}, b"")
    assert ask(61) == {"cities": 0, "error": 1} and len(engine.stored(store, "day").collect()) == 3
    Answers.served["/w"] = (200, {}, json.dumps(block(20.0)).encode())  # one object: the first city's
    assert ask(61) == {"cities": 1} and {(r.city, r.hi) for r in engine.stored(store, "day").collect()} == {("Rom", 20.0), ("Rom", 21.0), ("Oslo", 2.0), ("Oslo", 3.0)}


def test_files_are_written_as_a_whole_or_not_at_all(spark, tmp_path):
    http.register(spark)
    put = lambda rows, **o: spark.createDataFrame(rows, "path string, content string").repartition(3).write.format("tidewire_files").options(**o).mode("overwrite").save(f"file://{tmp_path}/out")
    read = lambda: {f.name: f.read_text("utf-8") for f in (tmp_path / "out/t").iterdir()}
    put([(f"t/{i}.svg", f"ä{i}") for i in range(5)], existing="keep", clean="t")
    put([("t/1.svg", "another"), ("t/9.svg", "new")], existing="keep", clean="t")
    assert read() == {"1.svg": "ä1", "9.svg": "new"}  # kept as it is, added, and the others gone
    bad = spark.createDataFrame([("t/1.svg", "broken"), ("t/2.svg", "x")], "path string, content string").withColumn("content", F.when(F.col("path") == "t/2.svg", F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception):
        bad.repartition(2).write.format("tidewire_files").option("clean", "t").mode("overwrite").save(f"file://{tmp_path}/out")
    assert read() == {"1.svg": "ä1", "9.svg": "new"}


def test_documents_are_put_together_from_sorted_parts(spark, tmp_path):
    http.register(spark)
    rows = spark.range(0, 5000, 1, 6).select(F.col("id").alias("z"), F.lit("ü").alias("a"), F.lit(None).cast("string").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        write_json(as_lines(rows, [-F.col("z")]), f"file://{tmp_path}/d/x.json")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = json.loads((tmp_path / "d/x.json").read_text("utf-8"))
    assert [r["z"] for r in got] == list(range(4999, -1, -1)) and list(got[0]) == ["a", "n", "z"] and got[0]["a"] == "ü"
    write_json(as_lines(rows.limit(0), [F.col("z")]), f"file://{tmp_path}/d/x.json")
    assert json.loads((tmp_path / "d/x.json").read_text("utf-8")) == []
    with pytest.raises(Exception):
        write_json(rows.select(F.when(F.col("z") == 4000, F.raise_error(F.lit("no"))).otherwise("{}").cast("string").alias("json")), f"file://{tmp_path}/d/x.json")
    assert json.loads((tmp_path / "d/x.json").read_text("utf-8")) == []


def test_polls_are_a_stream(spark, server, tmp_path):
    """A poll a slot of the clock; a restart goes on with the next slot, without loss or repeats."""
    Answers.served |= {"/f1": (200, {"ETag": "a"}, rss(("1", "Eins zwei drei vier", 1))), "/f2": (200, {}, b"<rss/>")}
    raw = lambda: ingest.polled(spark, f"{server}/f1\n{server}/f2", every=1, **QUICK)

    def run():
        raw().writeStream.format("parquet").option("path", f"{tmp_path}/raw").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination(60)

    run()
    assert len(Answers.seen) == 2
    time.sleep(1.1)
    run()
    got = spark.read.parquet(f"{tmp_path}/raw").collect()
    assert len(Answers.seen) == 4 and sorted(r.feed_url[-3:] for r in got) == ["/f1", "/f1", "/f2", "/f2"] and {r.status for r in got} == {200}


def test_ticks_refresh_a_store(spark, server, tmp_path):
    """Polls by the clock: each tick asks all feeds with what the store knows, until the stream is stopped."""
    store = registry(spark, tmp_path / "s", server, [("a", "/fa", True)])
    Answers.served["/fa"] = (200, {"ETag": "e1"}, rss(("1", "Neue Brücke im Norden eröffnet gestern", 10)))
    stream = ingest.poll(store, f"file://{tmp_path}/ticks", every="1 second", **QUICK)
    until = time.monotonic() + 120
    while store.finished() < 0 and stream.exception() is None and time.monotonic() < until:
        time.sleep(0.5)
    stream.stop()
    assert stream.exception() is None and engine.stored(store, "item").count() == 1 and Answers.seen[0][3] is None


def test_feeds_state_in_a_stream(spark, tmp_path):
    """A, B, A are three changes, over batches and restarts; changes and states equal those of the batch folds."""
    state.use_state_store(spark)
    at = lambda n: datetime(2024, 1, 30, 20, 0, n)
    row = lambda feed, n, sha, status=200, etag=None: (feed, at(n), status, etag, None, sha, (sha or "").encode())
    batches = [
        [row("f", 1, "A", etag="e1"), row("g", 1, "X", etag="g1")], [row("f", 2, "B", etag="e2"), row("f", 3, "B"), row("g", 2, None, 304)], [row("f", 4, "A"), row("g", 3, None, 500), row("h", 1, "H")],
        [row("f", 5, None, 304, "e9"), row("g", 4, "X", etag="g2")],
    ]
    seen, states = [], {}

    def put(rows, number):
        if rows.columns[-1] == "body":
            seen.extend((r.feed_url, r.fetched_at, r.sha256) for r in rows.collect())
        else:
            states.update({r.feed_url: tuple(r) for r in rows.collect()})

    for n, rows in enumerate(batches):  # each a restart
        spark.createDataFrame(rows, feeds.RAW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/raw")
        for kind, mode in (("changes", "append"), ("states", "update")):
            stream = getattr(state, kind)(ingest.raw_stream(spark, f"{tmp_path}/raw"))
            stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{kind}").trigger(availableNow=True).start().awaitTermination(60)
    raw = spark.createDataFrame([r for b in batches for r in b], feeds.RAW).withColumn("seq", F.lit(0))
    assert sorted(seen) == sorted((r.feed_url, r.fetched_at, r.sha256) for r in merge.changed(raw).collect()) and [x[2] for x in sorted(seen) if x[0] == "f"] == ["A", "B", "A"]
    assert states == {r.feed_url: tuple(r) for r in merge.feed_state(raw).collect()}
    assert states["f"][1] == "e9" and states["g"][1] == "g2"


def test_feed_state_moves_on(spark):
    """In two steps the same as at once; a 304 keeps the validators, a changed body brings its own, a failure forgets."""
    at = lambda n: datetime(2024, 1, 30, 20, 0, n)
    schema = "feed_url string, fetched_at timestamp, seq int, status int, etag string, last_modified string, sha256 string"
    rows = [("f", at(1), 1, 200, "e1", "m1", "A"), ("f", at(2), 2, 304, None, None, None), ("g", at(1), 1, 200, "e1", "m1", "A"), ("g", at(2), 2, 200, None, "m2", "B"), ("h", at(1), 1, 200, "e1", None, "A"), ("h", at(2), 2, 500, None, None, None), ("i", at(1), 1, 200, "e1", "m1", "A"), ("i", at(2), 2, 200, None, "m3", "A")]
    state_of = lambda df, old=None: merge.feed_state(df, old)
    every = spark.createDataFrame(rows, schema)
    want = {r.feed_url: tuple(r)[1:4] for r in state_of(every).collect()}
    assert want == {"f": ("e1", "m1", "A"), "g": (None, "m2", "B"), "h": (None, None, "A"), "i": ("e1", "m3", "A")}
    early = state_of(every.filter("seq = 1"))
    assert {tuple(r) for r in state_of(every.filter("seq = 2"), early).collect()} == {tuple(r) for r in state_of(every).collect()}
    assert {tuple(r) for r in state_of(every.limit(0), early).collect()} == {tuple(r) for r in early.collect()}


def test_data_sources_over_http(spark):
    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    http.register(spark)
    try:
        load = lambda kind, lines: spark.read.format(kind).option("requests", "\n".join(lines)).option("delay", "0").option("tries", "2").load().collect()
        got = {r.feed_url.rpartition("/")[2]: r for r in load("tidewire_feeds", [f"{at}/feed", f"{at}/feed2\tv1", f"{at}/gone", f"{at}/broken"])}
        assert {k: r.status for k, r in got.items()} == {"feed": 200, "feed2": 304, "gone": 404, "broken": 500} and got["feed"].etag == "v1" and bytes(got["feed"].body) == b"<rss/>"
        assert Answers.asked.count("/broken") == 2 and Answers.asked.count("/gone") == 1
        pages = {r.canonical_url.rpartition("/")[2]: r.html for r in load("tidewire_pages", [f"{at}/long", f"{at}/gone"])}
        assert pages["long"].strip("�") == "ü" * 125_000 and pages["gone"] == ""
        answers = {r.key: r.body for r in load("tidewire_json", [f"{at}/api\ta\trange=3y\tq=ä b", f"{at}/gone\tb"])}
        assert json.loads(answers["a"]) == {"q": "/api?range=3y&q=%C3%A4+b"} and answers["b"] is None
        assert json_sources.charts(spark.createDataFrame([("a", answers["a"]), ("b", None)], "symbol string, body string")).count() == 0
    finally:
        server.shutdown()
