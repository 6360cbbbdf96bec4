import html
import html.entities
import random
import unicodedata
from urllib.parse import parse_qsl, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from tidewire import constants as C
from tidewire.functions import numeric as N
from tidewire.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_fold_agrees_with_the_unicode_data(spark):
    """Every character of the basic plane, and marks within words: what compatibility decomposition without marks gives."""
    letters = [chr(c) for c in range(0x20, 0x10000) if not 0xD800 <= c < 0xE000]
    texts = [*letters, *(f"a{c}b" for c in letters if unicodedata.combining(c)), "Ｆｕｌｌ ½ ﬁn ﬀ ǆ", "한국어 뉴스", "İstanbul ΣΑΣ ς", "Straße Ångström – „Zitat“ …", "", "plain"]
    rows = spark.createDataFrame([(c,) for c in texts], "x string").select("x", X.fold(F.col("x")).alias("a"), F.lower("x").alias("low")).collect()
    assert [r for r in rows if r.a != X.folded(r.x) and r.low == r.x.lower()] == []
    assert sum(r.low != r.x.lower() for r in rows) < 20  # letters whose lower case is newer than the JVM
    assert one(spark, "Öl Æ å", lambda c: X.fold(c, nordic=False)) == "oel æ a" and one(spark, None, X.fold) is None


def test_entities_agree_with_the_standard_library(spark):
    names = list(html.entities.html5)
    texts = [*(f"a &{n} b" for n in names), *(f"&{n}x" for n in names), *(f"&{n.rstrip(';')}zz;" for n in names)]
    texts += [f"&#{n};" for n in (*range(300), 0xD800, 0xDFFF, 0xFFFE, 0xFFFF, 0xFDD0, 0x10FFFF, 0x110000, 0x1F600, 10**12, 10**30)] + [f"&#x{n:x}" for n in (*range(300), 0x1F600)] + ["&#X41;y", "&#x0000000041;"]
    texts += ["", "&", "&&", "& ", "&#", "&#x", "&#xg;", "&;", "a&b&amp;c&amp;amp;", "&notit;", "&notin;", "&AMPx", "&unknown;", "&ampamp;", "no entity", "x" * 5000 + "&lt;"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", X.unescape(F.col("x")).alias("y"))
    assert [r for r in rows.collect() if r.y != html.unescape(r.x)] == []
    assert one(spark, None, X.unescape) is None and "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def plain_canonical(url):
    """The rules in plain Python, by the standard library's own splitting and decoding."""
    url = url.strip()
    try:
        p = urlsplit(url)
    except ValueError:
        return url
    host = p.netloc.lower().removeprefix("www.").replace(":443", "").replace(":80", "")
    kept = sorted((k, v) for k, v in parse_qsl(p.query) if not k.lower().startswith("utm_") and k not in C.TRACKING_PARAMETERS)
    path = p.path[:-1] if len(p.path) > 1 and p.path.endswith("/") else p.path
    return urlunsplit(({"": "https", "http": "https"}.get(p.scheme.lower(), p.scheme.lower()), host, path, "&".join(f"{k}={v}" for k, v in kept), "")) if url else ""


def test_canonical_urls_agree_with_plain_rules(spark):
    random.seed(7)
    pieces = ["%", "%2", "%zz", "%41", "%C3%A4", "%ff", "+", "=", "&", "q", "utm_x", "UTM_y=1", "ref=a", "b=2", "a=%", "ä", "100%", "%%41", "%2541"]
    hosts = ["a.org", "www.A.org:443", "WWW.b.de:80", "x:8080", "[::1]", "u@h.org"]
    urls = [f"{random.choice(['http', 'https', 'HTTP', 'ftp'])}://{random.choice(hosts)}{random.choice(['', '/', '/p/', '/p/q', '//x/'])}?{''.join(random.choices(pieces, k=random.randint(0, 7)))}{random.choice(['', '#f', '#'])}" for _ in range(1500)]
    urls += ["https://a.org/x?q=100%&b=2", "https://a.org/x?q=50%zz", " https://a.org/ ", "//a.org/p?x=1", "/only/path?x=%", "mailto:a@b", "http://[broken/p", "https://a.org/a\nb?x=\t1", "https://a.org?", "a b", "\x01http://a.org/"]
    got = spark.createDataFrame([(u,) for u in urls], "x string").select("x", X.canonical_url(F.col("x")).alias("y")).collect()
    assert [(r.x, r.y, plain_canonical(r.x)) for r in got if r.y != plain_canonical(r.x)] == []


def test_stopwords_are_folded(spark, tmp_path):
    (tmp_path / "words").write_text("# comment\nfür\nDas\n\n", "utf-8")
    stop = X.load_stopwords(str(tmp_path / "words"))
    assert stop == ["das", "fuer"] and one(spark, "Geld für das Dorf", lambda c: X.tokens(c, stop)) == ["dorf", "geld"]


@pytest.mark.parametrize(
    "title, want",
    [
        ("Zölle: Die Union plant ab Montag neue Abgaben", "Die Union plant ab Montag neue Abgaben"),
        ("Kanzler: Bleiben dabei", "Kanzler: Bleiben dabei"),
        ("Brände im Süden Europas: Mehr als tausend Menschen evakuiert", "Brände im Süden Europas: Mehr als tausend Menschen evakuiert"),
        ("Liveblog: Regen | tagesschau.de", "Regen"),
        ("Live", "Live"),
    ],
)
def test_strip_kicker(spark, title, want):
    assert one(spark, title, X.strip_kicker) == want


def test_tokens_are_stemmed_and_sorted(spark):
    assert one(spark, "Die Waldbränden und Waldbrände in Griechenland", X.tokens) == ["griechenland", "waldbraend"]
    assert one(spark, "", X.tokens) == []


@pytest.mark.parametrize(
    "url, want",
    [
        ("http://www.Example.org/a/?utm_source=x&b=2&a=1&ref=q#top", "https://example.org/a?a=1&b=2"),
        ("https://example.org:443/", "https://example.org/"),
        ("https://example.org/p?q=a%20b&leer=", "https://example.org/p?q=a b"),
        ("", ""),
        (None, ""),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, url, X.canonical_url) == want


def test_topic_and_agency(spark):
    df = spark.createDataFrame([("welt", ["Finanzen"]), ("welt", ["Italien"]), ("welt", [])], "t string, c array<string>")
    assert [r[0] for r in df.select(X.topic_for_item(F.col("t"), F.col("c"))).collect()] == ["wirtschaft", "technologie", "welt"]
    df = spark.createDataFrame([("dpa-AFX", ""), ("", "Berlin (AFP) - Text"), ("", "Kapitel"), (None, None)], "a string, t string")
    assert [r[0] for r in df.select(X.agency_from(F.col("a"), F.col("t"))).collect()] == ["DPA", "AFP", "", ""]


def test_clean_text_cuts_at_a_blank(spark):
    assert one(spark, "<p>Ein&nbsp;&amp; zwei</p>  drei", X.clean_text) == "Ein & zwei drei"
    assert one(spark, "abc def ghi", lambda c: X.clean_text(c, 8)) == "abc def…" and one(spark, "abc defg", lambda c: X.clean_text(c, 6)) == "abc…"
    assert one(spark, None, X.clean_text) == ""


def test_clean_text_query_reads_whole_pages(spark, tmp_path):
    from tidewire.plans.queries import QUERIES

    html = ["<i class='leer'></i>" * 400 + "<p>Text hinter viel Markup</p>", "x " * 2499 + "<a href='geteilt'>y</a>"]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in QUERIES["clean_text"](spark, str(tmp_path)).collect()}
    assert got == {0: "Text hinter viel Markup", 1: ("x " * 299 + "x") + "…"}


@pytest.mark.parametrize("name, want", [("Muster UCITS ETF USD (Acc)", "Muster"), ("Beispiel AG (BSP)", "Beispiel"), ("ETF", "ETF"), ("Firma, Inc.", "Firma")])
def test_simplify_name(spark, name, want):
    assert one(spark, name, X.simplify_name) == want


def test_images(spark):
    assert one(spark, "a.jpg 320w, b.jpg 640w, c.jpg 640w", X.best_from_srcset) == "b.jpg"
    assert one(spark, "https://x/pixel.gif", X.plausible_image) is False and one(spark, "https://x/a.jpg?w=1", X.plausible_image) is True
    assert one(spark, '<meta content="//c/x.png" property="og:image">', X.og_image) == "https://c/x.png"
    assert one(spark, "<p>", X.og_image) == ""


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Tue, 30 Jan 2024 10:00:00 +0100", "2024-01-30 09:00:00"), ("30 Jan 2024 10:00:00 GMT", "2024-01-30 10:00:00"), ("2024-01-30T10:00:00Z", "2024-01-30 10:00:00"),
        ("2024-01-30T10:00:00+02:00", "2024-01-30 08:00:00"), ("2024-01-30", "2024-01-30 00:00:00"), ("2024-01-30 etwas", "2024-01-30 00:00:00"), ("Unsinn", None), (None, None),
    ],
)
def test_parse_date(spark, raw, want):
    assert one(spark, raw, lambda c: N.parse_date(c).cast("string")) == want


def test_round_is_pythons(spark):
    import random

    random.seed(3)
    xs = [random.uniform(-1000, 1000) for _ in range(2000)] + [0.125, 2.675, 0.5, 1.5, -0.005]
    for digits in (1, 2):
        got = spark.createDataFrame([(x,) for x in xs], "x double").select(N.py_round(F.col("x"), digits)).collect()
        assert [r[0] for r in got] == [round(x, digits) for x in xs]


def test_describe_has_an_answer_for_every_code(spark):
    rows = spark.range(100).select("id", N.describe(F.col("id")).alias("d")).collect()
    assert rows[0].d.label == "klar" and rows[4].d.label == "wechselhaft" and rows[95].d.icon == "storm" and all(r.d.label for r in rows)
