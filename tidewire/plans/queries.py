"""One query for each operator on the driver tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import constants as C
from tidewire.functions import numeric as N
from tidewire.functions import text as X
from tidewire.operators import board, cluster, images, merge, search, series
from tidewire.plans import engine
from tidewire.plans import views as V
from tidewire.plans.store import Store, by_second
from tidewire.plans.views import AS_OF, as_of, with_views
from tidewire.session import new_path, small, written
from tidewire.sources import feeds, json_sources

QUERIES, ORACLES = {}, {}
_STOP = "[" + ",".join(f"'{w}'" for w in C.STOPWORDS) + "]"
_TOPICS = "[" + ",".join(f"'{t}'" for t in C.TOPICS) + "]"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- text -------------------------------------------------------------------------------------------------------------
def _fold_sql(x: str) -> str:
    for a, b in X._PAIRS:
        x = f"replace({x}, '{a}', '{b}')" if "lower(" in x else f"replace(lower({x}), '{a}', '{b}')"
    return f"strip_accents({x})"


_STRIP1 = f"trim(regexp_replace(regexp_replace(trim(title), '{C.SOURCE_SUFFIX.replace('(?iu)', '(?i)')}', ''), '{C.LIVE_PREFIX.replace('(?iu)', '(?i)')}', ''))"
TOKENS = f"""
v_k AS (SELECT *, {_STRIP1} AS s FROM v_item),
v_k2 AS (SELECT *, regexp_extract(s, '^([^:]{{2,28}}):\\s+', 1) AS kicker, regexp_replace(s, '^[^:]{{2,28}}:\\s+', '') AS rest FROM v_k),
v_k3 AS (SELECT *, CASE WHEN kicker <> '' AND len(regexp_split_to_array(trim(kicker), '\\s+')) <= 2 AND length(rest) >= 24 THEN trim(rest) ELSE s END AS o FROM v_k2),
v_k4 AS (SELECT * EXCLUDE (s, kicker, rest, o), CASE WHEN o = '' THEN trim(title) ELSE o END AS stripped FROM v_k3),
v_tok AS (SELECT *, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all({_fold_sql('stripped')}, '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w)),
  lambda w: CASE WHEN length(w) < 6 THEN w {' '.join(f"WHEN ends_with(w, '{s}') AND length(w) - {len(s)} >= 4 THEN substr(w, 1, length(w) - {len(s)})" for s in C.STEM_SUFFIXES)} ELSE w END))) AS tokens FROM v_k4)"""


@query("fold_text", f"{with_views('v_item')} SELECT id, {_fold_sql('title')} AS folded FROM v_item")
def fold_text(spark, d):
    return V.items(spark, d).select("id", X.fold(F.col("title")).alias("folded"))


@query("title_tokens", f"{with_views('v_item')}, {TOKENS} SELECT id, stripped, array_to_string(tokens, ' ') AS tokens FROM v_tok")
def title_tokens(spark, d):
    return V.items(spark, d).select("id", X.strip_kicker(F.col("title")).alias("stripped"), F.array_join(X.tokens(F.col("title")), " ").alias("tokens"))


@query(
    "canonical_url",
    f"""WITH p AS (SELECT page_id, regexp_extract(trim(url), '^([a-z]+)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?', ['s','h','p','q']) AS m FROM pages),
    c AS (SELECT page_id, 'https://' || regexp_replace(lower(m.h), '^www\\.', '') || CASE WHEN length(m.p) > 1 AND ends_with(m.p, '/') THEN m.p[:-2] ELSE m.p END AS base,
      list_sort(list_filter(string_split(m.q, '&'), lambda x: regexp_matches(x, '^[^=]*=.') AND NOT starts_with(lower(x), 'utm_') AND NOT list_contains([{','.join(f"'{t}'" for t in C.TRACKING_PARAMETERS)}], split_part(x, '=', 1)))) AS q FROM p)
    SELECT page_id, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url, substr(sha256(base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END), 1, 32) AS id FROM c""",
)
def canonical_url(spark, d):
    u = V.table(spark, d, "pages").select("page_id", X.canonical_url(F.col("url")).alias("url"))
    return u.withColumn("id", X.item_id(F.col("url")))


_CATS = "string_split('Reise,Wirtschaft & Finanzen,Klima,IT-Sicherheit,World News,Wahl 2024,Italien,Sport', ',')"


@query(
    "topic_rules",
    f"""{with_views('v_item')}, c AS (SELECT id, topic, {_fold_sql(f"{_CATS}[doc_id % 8 + 1] || ' ' || source_key")} AS j FROM v_item)
    SELECT id, CASE {' '.join(f"WHEN regexp_matches(j, '\\b({'|'.join(n)})') THEN '{t}'" for t, n in C.CATEGORY_RULES)} ELSE topic END AS topic FROM c""",
)
def topic_rules(spark, d):
    cats = F.split(F.lit("Reise,Wirtschaft & Finanzen,Klima,IT-Sicherheit,World News,Wahl 2024,Italien,Sport"), ",")
    i = V.items(spark, d)
    return i.select("id", X.topic_for_item(F.col("topic"), F.array(F.element_at(cats, (F.col("doc_id") % 8 + 1).cast("int")), F.col("source_key"))).alias("topic"))


_AUTHORS = "string_split('Anna Beispiel|dpa|(AFP)|Reuters/AP|epd-Bericht|KNA|sid|Bloomberg News|dpa-AFX', '|')"


@query(
    "agency",
    f"""{with_views('v_item')}, c AS (SELECT id, {_fold_sql(f"{_AUTHORS}[doc_id % 9 + 1] || ' ' || substr(teaser, 1, 120)")} AS j FROM v_item)
    SELECT id, CASE {' '.join(f"WHEN regexp_matches(j, '\\b{a}\\b') THEN '{a.upper() if len(a) <= 3 else a.capitalize()}'" for a in C.AGENCIES)} ELSE '' END AS agency FROM c""",
)
def agency(spark, d):
    authors = F.split(F.lit("Anna Beispiel|dpa|(AFP)|Reuters/AP|epd-Bericht|KNA|sid|Bloomberg News|dpa-AFX"), r"\|")
    return V.items(spark, d).select("id", X.agency_from(F.element_at(authors, (F.col("doc_id") % 9 + 1).cast("int")), F.col("teaser")).alias("agency"))


@query(
    "clean_text",
    """WITH a AS (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS t FROM pages),
    b AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), chr(173), ''), '[\\s\\x{00A0}]+', ' ', 'g')) AS t FROM a)
    SELECT page_id, CASE WHEN length(t) > 600 THEN regexp_replace(substr(t, 1, 600), ' [^ ]*$', '') || '…' ELSE t END AS text FROM b""",
)
def clean_text(spark, d):
    return V.table(spark, d, "pages").select("page_id", X.clean_text(F.col("html"), 600).alias("text"))


def _og_sql(page: str) -> str:
    steps = []
    for pattern in C.OG_PATTERNS:
        found = f"""replace(trim(regexp_extract({page}, '{pattern.replace("'", "''")}', 1)), '&amp;', '&')"""
        steps.append(f"(SELECT CASE WHEN regexp_matches(u, '^https?://') THEN u END FROM (SELECT CASE WHEN starts_with(x, '//') THEN 'https:' || x ELSE x END AS u FROM (SELECT {found} AS x)))")
    return f"coalesce({', '.join(steps)}, '')"


_HEADS = [
    """<meta property="og:image" content="//cdn/i/ID.jpg?a=1&amp;b=2">""", """<meta name='twitter:image' content='https://cdn/t/ID'>""", """<meta property="og:image" content="/relative/ID.png"><META name="twitter:image:src" content=" https://cdn/s/ID ">""",
    """<meta content="http://cdn/c/ID.gif" property="og:image:url"/>""", """<link rel="image_src" href="https://cdn/l/ID"/>""", """<meta property="og:image" content="data:ID"><link rel="image_src" href="ID.png"/>""", "",
]


@query(
    "og_image",
    f"""WITH h AS (SELECT page_id, replace([{', '.join("'" + h.replace("'", "''") + "'" for h in _HEADS)}][page_id % {len(_HEADS)} + 1], 'ID', CAST(page_id AS VARCHAR)) || coalesce(html, '') AS page FROM pages)
    SELECT page_id, {_og_sql('page')} AS image FROM h""",
)
def og_image(spark, d):
    head = F.replace(F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("page_id") % len(_HEADS) + 1).cast("int")), F.lit("ID"), F.col("page_id").cast("string"))
    return V.table(spark, d, "pages").select("page_id", X.og_image(F.concat(head, F.coalesce("html", F.lit("")))).alias("image"))


@query("tile_url", f"""{with_views('v_item')} SELECT id, '/tile/' || id || '.svg?s=Source%20' || source_key || '&t=' || topic AS url, (('0x' || substr(id,1,8))::BIGINT % 4)::INT AS palette FROM v_item""")
def tile_url(spark, d):
    i = V.items(spark, d)
    return i.select("id", X.tile_url(F.col("id"), F.concat(F.lit("Source "), "source_key"), F.col("topic")).alias("url"), (F.conv(F.substring("id", 1, 8), 16, 10).cast("long") % 4).cast("int").alias("palette"))


def _ring_sql(shift: int) -> str:
    return f"""'<circle cx="' || ((seed >> {shift}) % 640) || '" cy="' || ((seed >> {shift + 3}) % 400) || '" r="' || ((seed >> {shift + 6}) % 90 + 60) || '"/>'"""


@query(
    "tile_svg",
    f"""{with_views('v_item')}, t AS (SELECT id, source_key, topic, ('0x' || substr(id, 1, 8))::BIGINT AS seed FROM v_item),
    p AS (SELECT *, [{', '.join(f"'{a}'" for a, _ in C.TILE_PALETTE)}][seed % {len(C.TILE_PALETTE)} + 1] AS ground, [{', '.join(f"'{b}'" for _, b in C.TILE_PALETTE)}][seed % {len(C.TILE_PALETTE)} + 1] AS tone FROM t)
    SELECT id, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 640 400"><title>' || source_key || '</title><path d="M0 0H640V400H0z" fill="' || ground || '"/><g fill="' || tone || '">' || {_ring_sql(0)} || {_ring_sql(5)} || {_ring_sql(10)}
      || '</g><g font-family="sans-serif" fill="#444"><text x="24" y="40">' || topic || '</text><text x="24" y="376">' || source_key || '</text></g></svg>' AS svg FROM p""",
)
def tile_svg(spark, d):
    return V.items(spark, d).select("id", X.tile_svg(F.col("id"), F.col("source_key"), F.col("topic")).alias("svg"))


_ENDINGS = [" Inc.", " Corp", " Corporation.", " AG", " UCITS ETF (Acc)", " Co", " plc PLC", " Ltd. (AAPL)", "", " Common Stock", " USD Acc  - X", " SE,", "Inc", " ETF"]


def _plain_name(name: str) -> str:
    """The patterns one after another; a closing look ahead becomes a group that is put back."""
    for pattern in C.NAME_BOILERPLATE:
        back = r"(\s|$)" in (own := pattern.replace(r"(?=\s|$)", r"(\s|$)").replace("(oration)?", "(?:oration)?"))
        name = f"regexp_replace({name}, '{own}', '{chr(92) + '1' if back else ''}', 'g')"
    return name


@query(
    "simplify_name",
    f"""WITH n AS (SELECT p_partkey, p_brand || [{', '.join(f"'{e}'" for e in _ENDINGS)}][p_partkey % {len(_ENDINGS)} + 1] AS raw FROM part),
    s AS (SELECT p_partkey, raw, trim(regexp_replace({_plain_name('raw')}, '\\s{{2,}}', ' ', 'g'), ' -,') AS short FROM n) SELECT p_partkey, CASE WHEN short = '' THEN raw ELSE short END AS name FROM s""",
)
def simplify_name(spark, d):
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("p_partkey") % len(_ENDINGS) + 1).cast("int"))
    return V.table(spark, d, "part").select("p_partkey", X.simplify_name(F.concat("p_brand", ending)).alias("name"))


@query("parse_date", "SELECT event_id, CASE event_id % 4 WHEN 3 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS at FROM events")
def parse_date(spark, d):
    e, ts = V.table(spark, d, "events"), F.col("ts")
    mail = F.concat(F.date_format(ts, "EEE, "), F.date_format(ts, "d MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    shifted = F.concat(F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    raw = F.when(F.col("event_id") % 4 == 0, mail).when(F.col("event_id") % 4 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 4 == 2, shifted).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    return e.select("event_id", N.parse_date(raw).alias("at"))


# --- rank and clusters ---------------------------------------------------------------------------------------------------
def _score_sql(sources: str, tier: str = "tier", topic: str = "topic") -> str:
    boost = f"CASE {topic} WHEN 'welt' THEN 1.0 WHEN 'wirtschaft' THEN 1.0 WHEN 'wissenschaft' THEN 1.0 WHEN 'politik' THEN 0.7 WHEN 'technologie' THEN 0.6 ELSE 0.5 END"
    return (
        f"((3 - greatest(1, least(3, {tier}))) / 2.0::DOUBLE + 1.6::DOUBLE * least(1.0::DOUBLE, ln(greatest(1, {sources})) / ln(6.0::DOUBLE)) + 0.8::DOUBLE / (1 + greatest(0, feed_pos) / 5.0::DOUBLE)"
        f" + 1.2::DOUBLE * pow(0.5::DOUBLE, greatest(0, epoch(TIMESTAMP '{AS_OF}' - published_at)) / 21600.0::DOUBLE) + 0.4::DOUBLE * ({boost})::DOUBLE)"
    )


@query("board_score", f"{with_views('v_source', 'v_item')} SELECT id, title, source_key, topic, round({_score_sql('1')}, 9) AS score FROM v_item JOIN v_source ON key = source_key ORDER BY {_score_sql('1')} DESC, published_at, id LIMIT 120")
def board_score(spark, d):
    i = V.items(spark, d).join(small(V.sources(spark, d).select(F.col("key").alias("source_key"), "tier")), "source_key")
    s = N.score(tier=F.col("tier"), sources=F.lit(1), pos=F.col("feed_pos"), published=F.col("published_at"), topic=F.col("topic"), as_of=as_of())
    return i.withColumn("s", s).orderBy(F.desc("s"), "published_at", "id").limit(C.BOARD_LIMIT).select("id", "title", "source_key", "topic", F.round("s", 9).alias("score"))


@query(
    "rank_explain",
    f"""{with_views('v_source', 'v_item')} SELECT id, (3 - tier) / 2.0::DOUBLE AS source, 0.0::DOUBLE AS cluster, CAST(printf('%.4f', 0.8::DOUBLE / (1 + feed_pos / 5.0::DOUBLE)) AS DOUBLE) AS position,
    CAST(printf('%.4f', {_score_sql('1')}) AS DOUBLE) AS total FROM v_item JOIN v_source ON key = source_key""",
)
def rank_explain(spark, d):
    i = V.items(spark, d).join(V.sources(spark, d).select(F.col("key").alias("source_key"), "tier"), "source_key")
    e = N.explain(tier=F.col("tier"), sources=F.lit(1), pos=F.col("feed_pos"), published=F.col("published_at"), topic=F.col("topic"), as_of=as_of())
    return i.select("id", *(e[k].alias(k) for k in ("source", "cluster", "position", "total")))


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the cluster window with their tokens, written once: counts, weights and pairs all read them."""
    i = V.items(spark, d).filter(F.col("published_at") >= as_of() - F.expr(f"INTERVAL {C.CLUSTER['window_hours']} HOURS"))
    tiers = small(V.sources(spark, d).select(F.col("key").alias("source_key"), F.col("tier").alias("source_tier")))
    return written(i.select("id", "title", "lang", "source_key", "topic", "published_at", "feed_pos").join(tiers, "source_key").withColumn("tokens", X.tokens(F.col("title"))), "tokens")


_DOCS = f"""{with_views('v_source', 'v_item')}, {TOKENS},
v_doc AS (SELECT t.*, tier FROM v_tok t JOIN v_source ON key = source_key WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 36 HOURS),
v_t AS (SELECT id, unnest(tokens) AS token FROM v_doc),
v_idf AS (SELECT token, count(*) AS df, ln(((SELECT count(*) FROM v_doc) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM v_t GROUP BY token)"""


def _pairs(cap: int | None) -> str:
    rare = "" if cap is None else f" JOIN v_idf i ON i.token = a.token AND i.df <= {cap}"
    return f"""{_DOCS},
v_p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM v_t a JOIN v_t b ON a.token = b.token AND a.id < b.id{rare}
  JOIN v_doc x ON x.id = a.id JOIN v_doc y ON y.id = b.id WHERE x.lang = y.lang AND len(x.tokens) >= 3 AND len(y.tokens) >= 3 AND abs(epoch(x.published_at - y.published_at)) <= 36 * 3600),
v_w AS (SELECT id, sum(idf) AS w, count(*) AS n FROM v_t JOIN v_idf USING (token) GROUP BY id),
v_i AS (SELECT a, b, sum(idf) AS i, count(*) AS shared FROM v_p JOIN v_t ta ON ta.id = a JOIN v_t tb ON tb.id = b AND tb.token = ta.token JOIN v_idf f ON f.token = ta.token GROUP BY a, b),
v_s AS (SELECT v_i.*, i / (x.w + y.w - i) AS similarity, i / least(x.w, y.w) AS containment, least(x.n, y.n) AS m, dx.source_key = dy.source_key AS same FROM v_i JOIN v_w x ON x.id = a JOIN v_w y ON y.id = b JOIN v_doc dx ON dx.id = a JOIN v_doc dy ON dy.id = b),
v_m AS (SELECT *, similarity >= (CASE WHEN same THEN 0.55 ELSE 0.34 END)::DOUBLE OR (shared >= 3 AND m >= 4 AND containment >= 0.62::DOUBLE AND similarity >= 0.26::DOUBLE) AS matches FROM v_s)"""


@query("idf_table", f"{_DOCS} SELECT token, df, round(idf, 9) AS idf FROM v_idf")
def idf_table(spark, d):
    return cluster.idf_table(docs(spark, d)).select("token", "df", F.round("idf", 9).alias("idf"))


def _similar(spark, d, cap):
    x = docs(spark, d)
    return cluster.similarity(cluster.weighted(x.select("id", "lang", "published_at", "source_key", "tokens"), cluster.numbered(cluster.idf_table(x), cap)))


_PAIR = "SELECT a, b, shared, round(similarity, 9) AS similarity, round(containment, 9) AS containment, matches FROM v_m"


@query("pair_similarity", f"{_pairs(60)} {_PAIR}")
def pair_similarity(spark, d):
    return _similar(spark, d, 60).withColumn("similarity", F.round("similarity", 9)).withColumn("containment", F.round("containment", 9))


@query("pair_similarity_cap20", f"{_pairs(20)} {_PAIR}")
def pair_similarity_cap20(spark, d):
    return _similar(spark, d, 20).withColumn("similarity", F.round("similarity", 9)).withColumn("containment", F.round("containment", 9))


_CLUSTERED = f"""
v_e AS (SELECT a AS x, b AS y FROM v_m WHERE matches UNION SELECT b, a FROM v_m WHERE matches),
v_r AS (SELECT id AS x, id AS r FROM v_doc UNION SELECT v_e.y, v_r.r FROM v_r JOIN v_e ON v_e.x = v_r.x),
v_root AS (SELECT x AS id, min(r) AS root FROM v_r GROUP BY x),
v_lead AS (SELECT root, first(id ORDER BY tier, published_at, id) AS lead_id FROM v_root JOIN v_doc USING (id) GROUP BY root),
v_mem AS (SELECT 'c' || substr(lead_id, 1, 16) AS cluster_id, lead_id, id AS item_id, topic, lang, source_key FROM v_root JOIN v_lead USING (root) JOIN v_doc USING (id)),
v_mt AS (SELECT cluster_id, first(topic ORDER BY n DESC, list_position({_TOPICS}, topic)) AS topic FROM (SELECT cluster_id, topic, count(*) AS n FROM v_mem GROUP BY ALL) GROUP BY cluster_id),
v_sum AS (SELECT cluster_id, lead_id, count(*) AS size, count(DISTINCT source_key) AS source_count, min(lang) AS lang, any_value(v_mt.topic) AS topic FROM v_mem JOIN v_mt USING (cluster_id) GROUP BY cluster_id, lead_id)"""
_CLUSTERS = f"{_pairs(60)},{_CLUSTERED}"


def _clusters(spark, d, cap=C.CLUSTER["df_cap"]):
    members = written(cluster.build(docs(spark, d), cap), "members")
    return members, written(cluster.summarise(members), "summary")


@query("clusters", f"{_CLUSTERS} SELECT cluster_id, item_id, lead_id FROM v_mem")
def clusters(spark, d):
    return _clusters(spark, d)[0].select("cluster_id", "item_id", "lead_id")


@query("cluster_summary", f"{_CLUSTERS} SELECT cluster_id, size, source_count, s.topic, s.lang, round({_score_sql('source_count', 'tier', 's.topic')}, 9) AS score FROM v_sum s JOIN v_doc ON id = lead_id")
def cluster_summary(spark, d):
    return cluster.scored(_clusters(spark, d)[1], docs(spark, d), as_of()).select("cluster_id", "size", "source_count", "topic", "lang", F.round("score", 9).alias("score"))


@query("cluster_stats", f"{_CLUSTERS} SELECT sum(size)::BIGINT AS items, count(*) AS clusters, count(*) FILTER (source_count > 1) AS multi_source, max(source_count) AS max_sources FROM v_sum")
def cluster_stats(spark, d):
    return cluster.stats(_clusters(spark, d)[1])


@query("cluster_members", f"{_CLUSTERS} SELECT cluster_id, item_id, row_number() OVER (PARTITION BY cluster_id ORDER BY tier, published_at, id) AS nth FROM v_mem JOIN v_doc ON id = item_id")
def cluster_members(spark, d):
    from pyspark.sql.window import Window as W

    x = _clusters(spark, d)[0].select("cluster_id", "item_id").join(docs(spark, d).select(F.col("id").alias("item_id"), "source_tier", "published_at"), "item_id")
    return x.select("cluster_id", "item_id", F.row_number().over(W.partitionBy("cluster_id").orderBy("source_tier", "published_at", "item_id")).alias("nth"))


# --- board -----------------------------------------------------------------------------------------------------------------
_BOARDED = f""", v_ev_state AS ({V.SQL['v_ev_state']}), v_state AS ({V.SQL['v_state']}),
v_vis AS (SELECT i.* EXCLUDE (topic), coalesce(s.topic, i.topic) AS topic, v_source.name AS source_name, tier, read_at, saved_at, m.cluster_id, coalesce(m.cluster_id, 'solo:' || i.id) AS story
  FROM v_item i JOIN v_source ON key = source_key LEFT JOIN v_state st ON st.item_id = i.id LEFT JOIN v_mem m ON m.item_id = i.id LEFT JOIN v_sum s ON s.cluster_id = m.cluster_id WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOURS),
v_rn AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY tier, published_at, id) AS nth, count(*) OVER (PARTITION BY story) AS size FROM v_vis),
v_g AS (SELECT story, count(DISTINCT source_name) AS source_count FROM v_vis GROUP BY story),
v_sc AS (SELECT story, list(source_name ORDER BY n) AS sources FROM (SELECT story, source_name, min(nth) AS n FROM v_rn GROUP BY ALL) GROUP BY story),
v_b AS (SELECT v_rn.*, source_count, array_to_string(sources, '|') AS sources, {_score_sql('source_count')} AS score FROM v_rn JOIN v_g USING (story) JOIN v_sc USING (story) WHERE nth = 1)"""
_BOARD = f"{_CLUSTERS}{_BOARDED}"
_SHOW = "id, title, story, topic, size, source_count, sources, round(score, 9) AS score, read_at IS NOT NULL AS is_read"


def _seen(spark, d, cap=C.CLUSTER["df_cap"]):
    members, summary = _clusters(spark, d, cap)
    state = merge.user_state(V.state_events(spark, d))
    return board.visible(V.items(spark, d), V.sources(spark, d), state, members, summary, as_of()), state


def _board(spark, d):
    seen, state = _seen(spark, d)
    return written(board.entries(seen, as_of()), "board"), state


def _shown(df):
    return df.select("id", "title", "story", "topic", F.col("size"), "source_count", F.array_join("sources", "|").alias("sources"), F.round("score", 9).alias("score"), F.col("read_at").isNotNull().alias("is_read"))


@query("board_full", f"{_BOARD} SELECT {_SHOW} FROM v_b ORDER BY v_b.score DESC, published_at, id LIMIT 120")
def board_full(spark, d):
    return _shown(board.ranked(_board(spark, d)[0]))


@query("board_filtered", f"{_BOARD} SELECT {_SHOW} FROM v_b WHERE topic = 'wirtschaft' AND read_at IS NULL ORDER BY v_b.score DESC, published_at, id LIMIT 120")
def board_filtered(spark, d):
    return _shown(board.ranked(_board(spark, d)[0], topic="wirtschaft", hide_read=True))


@query("board_by_source", f"{_BOARD} SELECT {_SHOW} FROM v_b WHERE source_name = 'Source src3' ORDER BY v_b.score DESC, published_at, id LIMIT 120")
def board_by_source(spark, d):
    return _shown(board.ranked(_board(spark, d)[0], source="Source src3"))


@query("board_leads", f"{_BOARD}, v_top AS (SELECT id, title, story, row_number() OVER (ORDER BY v_b.score DESC, published_at, id) AS nth FROM v_b) SELECT *, CASE WHEN nth <= 3 THEN 'lead' ELSE 'brief' END AS part FROM v_top WHERE nth <= 120")
def board_leads(spark, d):
    return board.parted(board.ranked(_board(spark, d)[0])).select("id", "title", "story", "nth", "part")


@query("board_page", f"{_BOARD} SELECT {_SHOW} FROM v_b ORDER BY v_b.score DESC, published_at, id LIMIT 10 OFFSET 20")
def board_page(spark, d):
    return _shown(board.page(_board(spark, d)[0], 2))


@query(
    "source_chips",
    f"""{_BOARD}, v_o AS (SELECT r.story, r.id, r.source_name, r.nth FROM v_rn r JOIN v_b USING (story) WHERE r.nth > 1 AND r.source_name <> v_b.source_name),
    v_c AS (SELECT * FROM v_o QUALIFY row_number() OVER (PARTITION BY story, source_name ORDER BY nth) = 1) SELECT story, string_agg(id, '|' ORDER BY nth) AS chips FROM v_c GROUP BY story""",
)
def source_chips(spark, d):
    return board.source_chips(_board(spark, d)[0]).filter("chips IS NOT NULL").select("story", F.array_join(F.transform("chips", lambda x: x["id"]), "|").alias("chips"))


@query("source_picker", f"{_BOARD} SELECT DISTINCT source_name AS source FROM v_b")
def source_picker(spark, d):
    return board.source_picker(_board(spark, d)[0])


@query(
    "relative_age",
    """WITH m AS (SELECT event_id, greatest(0, floor(epoch(TIMESTAMP '2024-01-20 00:00:00' - ts) / 60.0::DOUBLE + 0.5)) AS m FROM events)
    SELECT event_id, CASE WHEN m < 1 THEN 'GERADE' WHEN m < 60 THEN 'VOR ' || m::INT || ' MIN' ELSE 'VOR ' || floor(m / 60 + 0.5)::INT || ' STD' END AS age FROM m""",
)
def relative_age(spark, d):
    return V.table(spark, d, "events").select("event_id", board.relative_age(F.col("ts").cast("timestamp"), F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("age"))


_META = "name || ' · ' || strftime(published_at + INTERVAL 1 HOUR, '%d.%m.%Y · %H:%M') || CASE WHEN agency <> '' THEN ' · ' || agency ELSE '' END"


@query(
    "export_board",
    f"""{_BOARD} SELECT id, title, canonical_url AS url, source_name AS source, upper(topic) AS kicker, CASE WHEN doc_id % 4 = 0 THEN 'tiles/' || id || '.svg' ELSE image_url END AS image, coalesce(cluster_id, '') AS cluster, size, source_count, sources FROM v_b""",
)
def export_board(spark, d):
    found = _board(spark, d)[0].withColumn("image_kind", F.when(F.col("doc_id") % 4 == 0, "tile").otherwise(F.col("image_kind")))
    c = F.col("cluster")
    return board.exported(found).select("id", "title", "url", "source", "kicker", "image", c["id"].alias("cluster"), c["size"].alias("size"), c["sourceCount"].alias("source_count"), F.array_join(c["sources"], "|").alias("sources"))


@query(
    "export_index",
    f"""{with_views('v_source', 'v_item')} SELECT id, title, canonical_url AS url, name AS source, topic, upper(topic) AS kicker, {_META} AS meta, strftime(published_at + INTERVAL 1 HOUR, '%d.%m.') AS "dateShort", strftime(published_at + INTERVAL 1 HOUR, '%H:%M') AS time,
      CASE WHEN image_url = '' THEN 'tiles/' || id || '.svg' ELSE image_url END AS image, published_at AS "publishedAt" FROM v_item JOIN v_source ON key = source_key WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS""",
)
def export_index(spark, d):
    i = V.items(spark, d).withColumn("image_url", F.when(F.col("image_url") == "", X.tile_url(F.col("id"), F.col("source_key"), F.col("topic"))).otherwise(F.col("image_url")))
    return search.exported(i, V.sources(spark, d), as_of()).select("id", "title", "url", "source", "topic", "kicker", "meta", "dateShort", "time", "image", "publishedAt")


@query("board_others", f"{_BOARD} SELECT story, string_agg(id, '|' ORDER BY nth) AS others FROM v_rn WHERE nth > 1 GROUP BY story")
def board_others(spark, d):
    return _board(spark, d)[0].filter("size > 1").select("story", F.array_join(F.transform("others", lambda x: x["id"]), "|").alias("others"))


@query("cluster_strip", f"{_BOARD} SELECT story, title, topic, source_count, sources FROM v_b WHERE source_count > 1 ORDER BY source_count DESC, v_b.score DESC, id LIMIT 8")
def cluster_strip(spark, d):
    return board.strip(_board(spark, d)[0]).select("story", "title", "topic", "source_count", F.array_join("sources", "|").alias("sources"))


@query("board_topic_counts", f"{_BOARD} SELECT t.key, (SELECT count(*) FROM v_b WHERE topic = t.key) AS count FROM (SELECT unnest({_TOPICS}) AS key) t")
def board_topic_counts(spark, d):
    return board.topic_counts(_board(spark, d)[0]).select("key", "count")


@query("board_stats", f"{_BOARD} SELECT count(*) AS total, least(120, count(*)) AS shown, (SELECT count(read_at) FROM v_state) AS read, (SELECT count(saved_at) FROM v_state) AS saved, count(DISTINCT source_name) AS sources FROM v_b")
def board_stats(spark, d):
    found, state = _board(spark, d)
    return board.stats(found, board.ranked(found), state)


@query(
    "board_digest",
    f"""{_BOARD}, v_top AS (SELECT row_number() OVER (ORDER BY v_b.score DESC, published_at, id) AS nth, sha256(CAST(json_object('id', id, 'size', size, 'source_count', source_count, 'story', story, 'title', title, 'topic', topic) AS VARCHAR)) AS h
      FROM v_b ORDER BY v_b.score DESC, published_at, id LIMIT 120) SELECT sha256(string_agg(h, '' ORDER BY nth)) AS digest FROM v_top""",
)
def board_digest(spark, d):
    top = board.ranked(_board(spark, d)[0])
    return board.digest(top.select("id", "size", "source_count", "story", "title", "topic", "score", "published_at"), volatile=("score", "published_at"))


@query("daily_brief_top", f"{_pairs(None)},{_CLUSTERED}{_BOARDED} SELECT id, title, source_name AS source, canonical_url AS url FROM v_b ORDER BY v_b.score DESC, published_at, id LIMIT 5")
def daily_brief_top(spark, d):
    """Over stories of all headlines that match: no token is too frequent."""
    return series.brief_top(board.ranked(board.leads(_seen(spark, d, None)[0], as_of())))


@query(
    "item_payload",
    f"""{with_views('v_source', 'v_item')} SELECT id, name || ' · ' || strftime(published_at + INTERVAL 1 HOUR, '%d.%m.%Y · %H:%M') || CASE WHEN agency <> '' THEN ' · ' || agency ELSE '' END AS meta,
    strftime(published_at + INTERVAL 1 HOUR, '%d.%m.') AS "dateShort", upper(topic) AS kicker FROM v_item JOIN v_source ON key = source_key""",
)
def item_payload(spark, d):
    i = V.items(spark, d).join(V.sources(spark, d).select(F.col("key").alias("source_key"), F.col("name").alias("source_name")), "source_key")
    return board.payload(i.withColumn("read_at", F.lit(None).cast("timestamp")).withColumn("saved_at", F.lit(None).cast("timestamp"))).select("id", "meta", "dateShort", "kicker")


# --- logs and state ----------------------------------------------------------------------------------------------------------
@query(
    "item_merge",
    f"""{with_views('v_event')}, o AS (SELECT CAST(user_id AS VARCHAR) AS id, row_number() OVER (ORDER BY ts, event_id) AS seq, k, event_type || k AS title, event_type <> 'error' AS has_date, ts - to_minutes(k::BIGINT) AS published_at, {_TOPICS}[k % 5 + 1] AS topic, k % 47 AS feed_rank, event_id % 40 AS feed_pos, ts,
      CASE WHEN k % 3 = 0 THEN '' ELSE 'https://x/' || k || '.jpg' END AS image_url, CASE WHEN k % 7 = 0 THEN 'dpa' ELSE '' END AS agency FROM v_event)
    SELECT id, arg_min('s' || (k % 5), seq) AS source_key, arg_max(title, seq) AS title, arg_max(agency, seq) AS agency, coalesce(arg_max(published_at, seq) FILTER (has_date), arg_min(published_at, seq)) AS published_at, min(ts) AS first_seen_at,
      first(topic ORDER BY feed_rank, seq) AS topic, min(feed_rank) AS feed_rank, min(feed_pos) AS feed_pos, coalesce(arg_max(image_url, seq) FILTER (image_url <> ''), '') AS image_url FROM o GROUP BY id""",
)
def item_merge(spark, d):
    return merge.merge_items(V.observations(spark, d)).select("id", "source_key", "title", "agency", "published_at", "first_seen_at", "topic", "feed_rank", "feed_pos", "image_url")


@query("latest_per_key", f"{with_views('v_event', 'v_raw')} SELECT feed_url, fetched_at, seq, status, sha256 FROM v_raw QUALIFY row_number() OVER (PARTITION BY feed_url ORDER BY fetched_at DESC, seq DESC) = 1")
def latest_per_key(spark, d):
    return merge.latest_per_key(V.raw(spark, d), ["feed_url"], ["fetched_at", "seq"]).select("feed_url", "fetched_at", "seq", "status", "sha256")


@query("raw_append", f"{with_views('v_event', 'v_raw')} SELECT feed_url, fetched_at, seq, status FROM v_raw QUALIFY row_number() OVER (PARTITION BY feed_url, date_trunc('second', fetched_at) ORDER BY seq DESC) = 1")
def raw_append(spark, d):
    return by_second(V.raw(spark, d), ("seq",)).select("feed_url", "fetched_at", "seq", "status")


@query("fetch_flags", f"""{with_views('v_event', 'v_raw')}, b AS (SELECT v_raw.*, CASE WHEN k % 3 = 0 THEN '' ELSE props END AS body FROM v_raw JOIN v_event ON event_id = seq)
    SELECT seq, status = 200 AND body <> '' AS ok, status = 304 AS not_modified, status = 200 AND body <> '' AND sha256 <> '1' AS changed FROM b""")
def fetch_flags(spark, d):
    e = V.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.encode(F.when(V.k() % 3 == 0, "").otherwise(F.col("props")), "utf-8").alias("body"))
    return V.raw(spark, d).join(e, "seq").select("seq", *(f.alias(k) for k, f in feeds.flags(F.lit("1")).items()))


@query("feed_rank", "SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN user_id % 47 ELSE 9999 END::INT AS feed_rank FROM events")
def feed_rank(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("feed_url"))
    registry = e.select("feed_url").distinct().filter("cast(feed_url AS int) % 3 <> 0").withColumn("feed_rank", (F.col("feed_url").cast("int") % 47))
    return feeds.ranked(e, registry).select("event_id", "feed_rank")


@query("meta_latest", "SELECT event_type AS key, arg_max(props, event_id) AS value FROM events GROUP BY event_type")
def meta_latest(spark, d):
    return merge.latest_per_key(V.table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("props").alias("value"), F.col("event_id").alias("batch")), ["key"], ["batch"]).select("key", "value")


@query("og_cache", f"{with_views('v_event')} SELECT user_id AS page, arg_max('https://og/' || k, event_id) AS image FROM v_event GROUP BY user_id")
def og_cache(spark, d):
    log = V.table(spark, d, "events").select(F.col("user_id").alias("page"), F.concat(F.lit("https://og/"), V.k()).alias("image"), F.col("event_id").alias("batch"))
    return merge.replace_by_key(log, ["page"], ["batch"]).select("page", "image")


@query("prune_keep_latest", f"{with_views('v_event', 'v_raw')} SELECT feed_url, seq FROM v_raw QUALIFY fetched_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS OR row_number() OVER (PARTITION BY feed_url ORDER BY fetched_at DESC, seq DESC) = 1")
def prune_keep_latest(spark, d):
    return merge.prune_keep_latest(V.raw(spark, d), as_of()).select("feed_url", "seq")


@query("change_detect", f"{with_views('v_event', 'v_raw')} SELECT feed_url, seq, sha256 FROM v_raw WHERE status = 200 QUALIFY sha256 IS DISTINCT FROM lag(sha256) OVER (PARTITION BY feed_url ORDER BY fetched_at, seq)")
def change_detect(spark, d):
    return merge.changed(V.raw(spark, d)).select("feed_url", "seq", "sha256")


def _answers(spark, d):
    """Responses of which some are 304 without validators or full ones without some of them."""
    n, r = F.col("seq"), V.raw(spark, d)
    unchanged = (F.col("status") == 200) & (n % 5 == 0)
    return r.select(
        "feed_url", "fetched_at", "seq", F.when(unchanged, 304).otherwise(F.col("status")).alias("status"), F.when(n % 5 != 0, F.col("etag")).alias("etag"),
        F.when(n % 10 != 0, F.col("last_modified")).alias("last_modified"), F.when(~unchanged & (F.col("status") == 200), F.col("sha256")).alias("sha256"),
    )


_STATE = f"""{with_views('v_event', 'v_raw')},
v_a AS (SELECT feed_url, fetched_at, seq, CASE WHEN status = 200 AND seq % 5 = 0 THEN 304 ELSE status END AS status, CASE WHEN seq % 5 <> 0 THEN etag END AS etag, CASE WHEN seq % 10 <> 0 THEN last_modified END AS last_modified,
  CASE WHEN status = 200 AND seq % 5 <> 0 THEN sha256 END AS sha256 FROM v_raw),
v_b AS (SELECT *, last_value(sha256 IGNORE NULLS) OVER (PARTITION BY feed_url ORDER BY fetched_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM v_a),
v_c AS (SELECT *, sum(CASE WHEN status NOT IN (200, 304) OR (status = 200 AND sha256 IS DISTINCT FROM known) THEN 1 ELSE 0 END) OVER (PARTITION BY feed_url ORDER BY fetched_at, seq) AS run FROM v_b),
v_d AS (SELECT *, max(run) OVER (PARTITION BY feed_url) AS last_run, row_number() OVER (PARTITION BY feed_url ORDER BY fetched_at, seq) AS n FROM v_c)"""


@query(
    "feed_state",
    f"""{_STATE} SELECT feed_url, arg_max(etag, n) FILTER (run = last_run AND status IN (200, 304) AND etag IS NOT NULL) AS etag, arg_max(last_modified, n) FILTER (run = last_run AND status IN (200, 304) AND last_modified IS NOT NULL) AS last_modified,
    arg_max(sha256, n) FILTER (sha256 IS NOT NULL) AS sha256, max(fetched_at) AS fetched_at, arg_max(status, n) AS status FROM v_d GROUP BY feed_url""",
)
def feed_state(spark, d):
    return merge.feed_state(_answers(spark, d))


@query("feed_requests", f"""{_STATE}, v_s AS (SELECT feed_url, arg_max(etag, n) FILTER (run = last_run AND status IN (200, 304) AND etag IS NOT NULL) AS etag FROM v_d GROUP BY feed_url) SELECT feed_url, etag FROM v_s""")
def feed_requests(spark, d):
    """The state kept in two steps, as a store does: what the earlier half left, moved on by the later one."""
    every = _answers(spark, d)
    early, late = every.filter("fetched_at < TIMESTAMP '2024-01-16'"), every.filter("fetched_at >= TIMESTAMP '2024-01-16'")
    return merge.feed_state(late, written(merge.feed_state(early), "state")).select("feed_url", "etag")


@query("feed_problems", f"{with_views('v_event', 'v_raw')}, l AS (SELECT * FROM v_raw QUALIFY row_number() OVER (PARTITION BY feed_url ORDER BY fetched_at DESC, seq DESC) = 1) SELECT feed_url, status FROM l WHERE status NOT IN (200, 304)")
def feed_problems(spark, d):
    return merge.feed_state(V.raw(spark, d)).filter(~F.col("status").isin(200, 304)).select("feed_url", "status")


@query("fetch_stats", f"{with_views('v_event', 'v_raw')} SELECT count(*) FILTER (status = 200) AS ok, count(*) FILTER (status NOT IN (200, 304)) AS failed, count(DISTINCT feed_url) AS feeds FROM v_raw")
def fetch_stats(spark, d):
    return V.raw(spark, d).agg(F.count_if(F.col("status") == 200).alias("ok"), F.count_if(~F.col("status").isin(200, 304)).alias("failed"), F.countDistinct("feed_url").alias("feeds"))


@query("user_state", f"{with_views('v_ev_state', 'v_state')} SELECT * FROM v_state")
def user_state(spark, d):
    return merge.user_state(V.state_events(spark, d))


@query("state_counts", f"{with_views('v_ev_state', 'v_state')} SELECT count(read_at) AS read, count(saved_at) AS saved FROM v_state")
def state_counts(spark, d):
    return board.state_counts(merge.user_state(V.state_events(spark, d)))


@query("items_in_window", f"{with_views('v_source', 'v_item')} SELECT id, tier, published_at FROM v_item JOIN v_source ON key = source_key WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 36 HOURS")
def items_in_window(spark, d):
    i = V.items(spark, d).filter(F.col("published_at") >= as_of() - F.expr("INTERVAL 36 HOURS"))
    return i.join(V.sources(spark, d).select(F.col("key").alias("source_key"), "tier"), "source_key").select("id", "tier", "published_at")


@query("feed_registry", f"{with_views('v_source')} SELECT key AS source_key, n AS nth, row_number() OVER (ORDER BY key, n) - 1 AS feed_rank FROM v_source, (SELECT unnest([0,1]) AS n)")
def feed_registry(spark, d):
    s = V.sources(spark, d).select(F.col("key").alias("pos"), "key", F.lit("de").alias("lang"), F.array(*(F.struct(F.concat(F.lit(f"https://feeds/{n}/"), "key").alias("url"), F.lit(t).alias("topic")) for n, t in enumerate(C.TOPICS[:2]))).alias("feeds"))
    return feeds.feed_registry(s).select("source_key", F.substring("feed_url", 15, 1).cast("int").alias("nth"), "feed_rank")


# --- search -----------------------------------------------------------------------------------------------------------------
@query("bm25_search", f"""{with_views('v_item')},
v_w AS (SELECT id, regexp_extract_all({_fold_sql('title')}, '[a-z0-9]+') AS t, regexp_extract_all({_fold_sql('teaser')}, '[a-z0-9]+') AS b FROM v_item),
v_l AS (SELECT id, len(t) + len(b) AS d, list_concat(t, b) AS w FROM v_w), v_avg AS (SELECT count(*) AS n, avg(d) AS a FROM v_l),
v_q AS (SELECT unnest(['ther', 'on']) AS term), v_f AS (SELECT id, d, term, len(list_filter(w, lambda x: starts_with(x, term))) AS f FROM v_l, v_q), v_h AS (SELECT * FROM v_f WHERE f > 0),
v_df AS (SELECT term, count(*) AS df FROM v_h GROUP BY term)
SELECT id, round(-sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / a))), 9) AS score FROM v_h JOIN v_df USING (term), v_avg GROUP BY id HAVING count(*) = 2""")
def bm25_search(spark, d):
    i = V.items(spark, d)
    posts = written(search.postings(i), "postings")
    return search.bm25(posts, search.figures(i, posts), 'Ther* "ON"').select("id", F.round("score", 9).alias("score"))


@query("search_full", f"""{with_views('v_ev_state', 'v_state', 'v_source', 'v_item')},
v_w AS (SELECT id, regexp_extract_all({_fold_sql('title')}, '[a-z0-9]+') AS t, regexp_extract_all({_fold_sql('teaser')}, '[a-z0-9]+') AS b FROM v_item),
v_l AS (SELECT id, len(t) + len(b) AS d, t, b FROM v_w), v_avg AS (SELECT count(*) AS n, avg(d) AS a FROM v_l),
v_q AS (SELECT unnest(['ther', 'on']) AS term), v_f AS (SELECT id, d, term, len(list_filter(t, lambda x: starts_with(x, term))) + len(list_filter(b, lambda x: starts_with(x, term))) AS f FROM v_l, v_q), v_h AS (SELECT * FROM v_f WHERE f > 0),
v_df AS (SELECT term, count(*) AS df FROM v_h GROUP BY term),
v_s AS (SELECT id, -sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / a))) AS score FROM v_h JOIN v_df USING (term), v_avg GROUP BY id HAVING count(*) = 2)
SELECT id, title, name AS source, {_META} AS meta, read_at IS NOT NULL AS is_read, saved_at IS NOT NULL AS is_saved FROM v_s JOIN v_item USING (id) JOIN v_source ON key = source_key LEFT JOIN v_state ON item_id = id
ORDER BY round(v_s.score, 9), published_at DESC, id LIMIT 60""")
def search_full(spark, d):
    i = V.items(spark, d)
    shown = search.found(i, V.sources(spark, d), merge.user_state(V.state_events(spark, d)), 'Ther* "ON"', posts=written(search.ranged(search.postings(i)), "postings"))
    return shown.select("id", "title", "source", "meta", F.col("read").alias("is_read"), F.col("saved").alias("is_saved"))


@query("substring_search", f"{with_views('v_item')} SELECT id FROM v_item WHERE contains({_fold_sql('''title || ' ' || teaser''')}, 'einver') ORDER BY published_at DESC, id LIMIT 60")
def substring_search(spark, d):
    return search.contains(V.items(spark, d), "Einver").select("id")


@query("saved_list", f"{with_views('v_ev_state', 'v_state', 'v_item')} SELECT id, saved_at FROM v_item JOIN v_state ON item_id = id WHERE saved_at IS NOT NULL")
def saved_list(spark, d):
    return search.saved(V.items(spark, d), merge.user_state(V.state_events(spark, d))).select("id", "saved_at")


@query("archive_window", f"{with_views('v_item')} SELECT id, published_at FROM v_item WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS")
def archive_window(spark, d):
    return search.archive(V.items(spark, d), as_of()).select("id", "published_at")


# --- images -----------------------------------------------------------------------------------------------------------------
@query("missing_images", f"{with_views('v_item')} SELECT id FROM v_item WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOURS AND (image_url = '' OR image_kind = 'tile')")
def missing_images(spark, d):
    return images.missing(V.items(spark, d), as_of(), 48).select("id")


@query(
    "image_stage",
    f"""{with_views('v_item')}, b AS (SELECT *, doc_id % 11 = 0 AS cached, doc_id % 4 = 1 AS no_scrape FROM v_item),
    r AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM b WHERE image_url = '' AND NOT cached AND NOT no_scrape)
    SELECT b.id, CASE WHEN image_url <> '' THEN 'feed' WHEN cached OR rn <= 40 THEN 'og' ELSE 'tile' END AS image_kind,
      CASE WHEN image_url <> '' THEN image_url WHEN cached THEN 'https://c/' || doc_id WHEN rn <= 40 THEN 'https://og/' || doc_id ELSE '/tile/' || b.id || '.svg?s=' || source_key || '&t=' || topic END AS image_url FROM b LEFT JOIN r USING (id)""",
)
def image_stage(spark, d):
    i = V.items(spark, d).withColumn("no_scrape", F.col("doc_id") % 4 == 1).withColumn("source_name", F.col("source_key"))
    cache = i.filter("doc_id % 11 = 0").select("canonical_url", F.concat(F.lit("https://c/"), "doc_id").alias("image_url"))
    pages = i.select("canonical_url", F.concat(F.lit('<meta property="og:image" content="https://og/'), "doc_id", F.lit('">')).alias("html"))
    return images.backfill(i, cache, pages, 40)


# --- markets and weather ---------------------------------------------------------------------------------------------------
HISTORY = 20
_MARKET = f"""{with_views('v_event', 'v_close')}, c AS (SELECT symbol, list(close ORDER BY ts, event_id) AS c, bool_or(pays) AS pays FROM v_close GROUP BY symbol),
r AS (SELECT * FROM c WHERE len(c) >= {HISTORY} AND NOT pays),
m AS (SELECT symbol, len(c) AS n, CAST(printf('%.2f', c[-1]) AS DOUBLE) AS price, CAST(printf('%.1f', (c[-1] / c[1] - 1) * 100) AS DOUBLE) AS change_pct, CAST(printf('%.1f', (c[-1] / c[-2] - 1) * 100) AS DOUBLE) AS change_pct_daily, c FROM r)"""


def _metrics(spark, d):
    """The dividend flag belongs to all of a symbol's rows, so null closes may go before the fold."""
    return series.market_metrics(V.closes(spark, d), HISTORY)


@query("market_metrics", f"{_MARKET} SELECT symbol, n, price, change_pct, change_pct_daily FROM m")
def market_metrics(spark, d):
    return _metrics(spark, d).drop("spark")


@query("spark_downsample", f"""{_MARKET} SELECT symbol, array_to_string(list_transform(CASE WHEN len(c) <= 24 THEN c ELSE list_transform(range(24), lambda i: c[round_even(i * ((len(c) - 1) / 23.0::DOUBLE), 0)::INT + 1]) END, lambda v: printf('%.2f', v)), ' ') AS points FROM m""")
def spark_downsample(spark, d):
    return _metrics(spark, d).select("symbol", F.array_join(F.transform("spark", lambda v: F.format_string("%.2f", v)), " ").alias("points"))


@query("spark_line", f"""{_MARKET}, s AS (SELECT symbol, list_transform(CASE WHEN len(c) <= 24 THEN c ELSE list_transform(range(24), lambda i: c[round_even(i * ((len(c) - 1) / 23.0::DOUBLE), 0)::INT + 1]) END, lambda v: CAST(printf('%.2f', v) AS DOUBLE)) AS v FROM m),
    b AS (SELECT *, list_min(v) AS low, coalesce(nullif(list_max(v) - list_min(v), 0), 1) AS span FROM s)
    SELECT symbol, array_to_string(list_transform(range(len(v)), lambda i: printf('%.1f,%.1f', i / (len(v) - 1)::DOUBLE * 100.0::DOUBLE, 28.0::DOUBLE - (v[i + 1] - low) / span * 26.0::DOUBLE)), ' ') AS points FROM b""")
def spark_line(spark, d):
    return _metrics(spark, d).select("symbol", series.spark_line(F.col("spark")).alias("points"))


@query("chart_source", f"""{with_views('v_event')} SELECT CAST(user_id AS VARCHAR) AS symbol, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, CASE WHEN k % 10 <> 0 THEN value END AS close, user_id % 4 = 0 AS pays,
    CASE WHEN user_id % 3 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'N' || user_id END AS name, CASE WHEN user_id % 2 = 0 THEN user_id + 0.5::DOUBLE END AS price, CASE WHEN user_id % 5 = 0 THEN '' ELSE 'EUR' END AS currency FROM v_event""")
def chart_source(spark, d):
    """Each user's values as an API's answer, read back."""
    u = F.col("symbol").cast("long")
    listed = V.closes(spark, d).groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "close"))), lambda x: x["close"]).alias("close"))
    dividends = F.when(u % 4 == 0, F.create_map(F.lit("1"), F.struct(F.lit(0.5).alias("amount"))))
    name = F.when(u % 3 == 0, "").otherwise(F.concat(F.lit("N"), "symbol"))
    meta = F.struct(name.alias("shortName"), F.when(u % 2 == 0, u + 0.5).alias("regularMarketPrice"), F.when(u % 5 != 0, F.lit("EUR")).alias("currency"))
    one = F.struct(meta.alias("meta"), F.struct(F.array(F.struct("close")).alias("quote")).alias("indicators"), F.struct(dividends.alias("dividends")).alias("events"))
    body = F.to_json(F.struct(F.struct(F.array(one).alias("result")).alias("chart")))
    return json_sources.charts(listed.select("symbol", body.alias("body"))).select("symbol", "seq", "close", "pays", "name", "price", "currency")


@query("market_keep", f"{_MARKET} SELECT symbol, ['etf', 'stock', 'search'][CAST(symbol AS INT) % 3 + 1] AS kind, price FROM m")
def market_keep(spark, d):
    """No news of any kind: all stays as it was."""
    old = _metrics(spark, d).select("symbol", F.element_at(F.array(*map(F.lit, ("etf", "stock", "search"))), (F.col("symbol").cast("int") % 3 + 1).cast("int")).alias("kind"), "price")
    store = Store(spark, new_path(spark, "store"))
    engine.save_markets(store, old)
    return engine.save_markets(store, old.filter("price IS NULL"))


@query("market_top", f"{_MARKET}, t AS (SELECT *, CASE WHEN CAST(symbol AS INT) % 2 = 0 THEN 'etf' ELSE 'stock' END AS kind FROM m) SELECT kind, symbol, change_pct, row_number() OVER (PARTITION BY kind ORDER BY change_pct DESC, symbol) AS nth FROM t QUALIFY nth <= 5")
def market_top(spark, d):
    rows = _metrics(spark, d).withColumn("kind", F.when(F.col("symbol").cast("int") % 2 == 0, "etf").otherwise("stock"))
    return series.market_top(rows).select("kind", "symbol", "change_pct", "nth")


@query("market_payload", f"""{_MARKET}, t AS (SELECT *, ['etf', 'stock', 'search'][CAST(symbol AS INT) % 3 + 1] AS kind FROM m)
    SELECT kind, symbol, price, change_pct, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind <> 'search' THEN -change_pct END, symbol) AS nth FROM t QUALIFY kind = 'search' OR nth <= 5""")
def market_payload(spark, d):
    rows = _metrics(spark, d).withColumn("kind", F.element_at(F.array(*map(F.lit, ("etf", "stock", "search"))), (F.col("symbol").cast("int") % 3 + 1).cast("int")))
    return series.market_payload(rows).select("kind", "symbol", "price", "change_pct", "nth")


@query("market_replace", f"""{_MARKET} SELECT symbol, kind, price FROM (SELECT symbol, ['etf', 'stock', 'search'][CAST(symbol AS INT) % 3 + 1] AS kind, price FROM m) WHERE kind = 'search'
    UNION ALL SELECT symbol, 'stock', price + 1 FROM m WHERE CAST(symbol AS INT) % 3 = 1""")
def market_replace(spark, d):
    """News of stocks only: ETFs go with them, the search index stays."""
    old = _metrics(spark, d).select("symbol", F.element_at(F.array(*map(F.lit, ("etf", "stock", "search"))), (F.col("symbol").cast("int") % 3 + 1).cast("int")).alias("kind"), "price")
    new = old.filter("kind = 'stock'").withColumn("price", F.col("price") + 1)
    store = Store(spark, new_path(spark, "store"))
    engine.save_markets(store, old)
    return engine.save_markets(store, new)


@query("weather_replace", f"{with_views('v_event', 'v_hour')} SELECT city, hour, CASE WHEN city = 'click' THEN temp + 1 ELSE temp END AS temp FROM v_hour WHERE city <> 'click' OR day(hour) < 10")
def weather_replace(spark, d):
    """News of one city's first days: its other days go, other cities stay."""
    old = V.hours(spark, d).select("city", "hour", "temp")
    store = Store(spark, new_path(spark, "store"))
    engine.save_weather(store, "hour", old)
    return engine.save_weather(store, "hour", old.filter("city = 'click' AND day(hour) < 10").withColumn("temp", F.col("temp") + 1))


@query("market_query", f"{_MARKET} SELECT symbol, change_pct_daily, CAST(symbol AS INT) % 3 <> 0 AS from_index FROM m WHERE contains(symbol, '1')")
def market_query(spark, d):
    m = _metrics(spark, d).withColumn("name", F.concat(F.lit("N"), "symbol"))
    return series.market_query(m.filter(F.col("symbol").cast("int") % 3 == 0), m, "1").select("symbol", "change_pct_daily", "from_index")


@query("finance_stat", f"""{_MARKET} SELECT 'Bester 3J-Wachstumstitel' AS label, symbol, change_pct AS change, '3 Jahre' AS period FROM m ORDER BY change_pct DESC, CAST(symbol AS INT) LIMIT 1""")
def finance_stat(spark, d):
    return series.finance_stat(_metrics(spark, d).withColumn("pos", F.col("symbol").cast("int")), as_of())


@query("weather_extremes", f"""{with_views('v_event', 'v_hour')} SELECT city, CAST(hour AS DATE) AS day, count(*) AS hours, strftime(first(hour ORDER BY temp DESC, hour), '%H:%M') AS hot_hour, round_even(max(temp), 0) AS hot_temp, strftime(first(hour ORDER BY temp, hour), '%H:%M') AS cold_hour, round_even(min(temp), 0) AS cold_temp FROM v_hour GROUP BY ALL""")
def weather_extremes(spark, d):
    return series.weather_days(V.hours(spark, d))


_DESCRIBE = " ".join(f"WHEN code BETWEEN {a} AND {b} THEN '{label}'" for a, b, _, label in C.WEATHER_CODES)


@query("weather_strip", f"""{with_views('v_event', 'v_hour')} SELECT city, CAST(hour AS DATE) AS day, strftime(hour, '%H:%M') AS hour, CASE {_DESCRIBE} ELSE 'wechselhaft' END AS label, round_even(temp, 0) AS temp, CAST(printf('%.1f', precip) AS DOUBLE) AS precip, hour = TIMESTAMP '2024-01-15 12:00:00' AS is_now FROM v_hour""")
def weather_strip(spark, d):
    return series.weather_strip(V.hours(spark, d), F.lit("2024-01-15 12:34:00").cast("timestamp")).drop("icon")


def _forecast(spark, d):
    """The hours of all cities as one answer of an API, and the cities in its order; one city's has no precipitation."""
    hours = V.hours(spark, d)
    cities = sorted(r[0] for r in hours.select("city").distinct().collect())  # a handful
    listed = hours.groupBy("city").agg(F.array_sort(F.collect_list(F.struct("hour", "code", "temp", "precip"))).alias("h"))
    of = lambda c: F.transform("h", lambda x: x[c])
    hourly = F.struct(F.transform("h", lambda x: F.date_format(x["hour"], "yyyy-MM-dd'T'HH:mm")).alias("time"), of("code").alias("weather_code"), of("temp").alias("temperature_2m"), F.when(F.col("city") != "click", of("precip")).alias("precipitation"))
    bodies = listed.select("city", F.to_json(F.struct(hourly.alias("hourly"))).alias("body"))
    whole = bodies.agg(F.array_sort(F.collect_list(F.struct("city", "body"))).alias("all")).select(F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["body"]), ","), F.lit("]")).alias("body"))
    return json_sources.forecast_hours(json_sources.forecast_blocks(whole, cities)), cities


@query("forecast_source", f"{with_views('v_event', 'v_hour')} SELECT city, hour, code, temp, CASE WHEN city = 'click' THEN 0 ELSE precip END AS precip FROM v_hour")
def forecast_source(spark, d):
    return _forecast(spark, d)[0].select("city", F.col("hour").cast("timestamp").alias("hour"), "code", "temp", "precip")


@query(
    "weather_payload",
    f"""{with_views('v_event', 'v_hour')}, h AS (SELECT *, CAST(hour AS DATE) AS day, CASE {_DESCRIBE} ELSE 'wechselhaft' END AS label FROM v_hour),
    g AS (SELECT city, day, max(temp) AS hi, min(temp) AS lo, min(code) AS code, strftime(first(hour ORDER BY temp DESC, hour), '%H:%M') AS hot_hour, strftime(first(hour ORDER BY temp, hour), '%H:%M') AS cold_hour, string_agg(strftime(hour, '%H:%M') || ' ' || label, '|' ORDER BY hour) AS strip FROM h GROUP BY ALL)
    SELECT city, day, CASE WHEN day = DATE '2024-01-15' THEN 'HEUTE' ELSE ['MO','DI','MI','DO','FR','SA','SO'][isodow(day)] END AS name, CASE {_DESCRIBE} ELSE 'wechselhaft' END AS label, round_even(hi, 0) AS hi, round_even(lo, 0) AS lo, hot_hour, cold_hour, strip FROM g""",
)
def weather_payload(spark, d):
    hours = V.hours(spark, d)
    days = hours.groupBy("city", F.to_date("hour").alias("day")).agg(F.max("temp").alias("hi"), F.min("temp").alias("lo"), F.min("code").alias("code")).withColumns({"sunrise": F.lit("07:00"), "sunset": F.lit("17:00")})
    cities = sorted(r[0] for r in hours.select("city").distinct().collect())  # a handful
    out = None
    for city in cities:
        one = series.weather_payload(days, hours, city, cities, F.lit("2024-01-15 12:34:00").cast("timestamp")).withColumn("city", F.lit(city))
        out = one if out is None else out.unionByName(one)
    return out.select("city", "day", "name", "label", "hi", "lo", "hot_hour", "cold_hour", F.array_join(F.transform("strip", lambda x: F.concat(x["hour"], F.lit(" "), x["label"])), "|").alias("strip"))


@query(
    "brief_payload",
    f"""{_BOARD}, {_MARKET.partition(', c AS')[0].removeprefix("WITH RECURSIVE ")}, c AS{_MARKET.partition(', c AS')[2]},
    v_top AS (SELECT id, row_number() OVER (ORDER BY v_b.score DESC, published_at, id) AS n FROM v_b ORDER BY n LIMIT 5),
    v_pool AS (SELECT *, row_number() OVER (PARTITION BY CAST(symbol AS INT) % 2 ORDER BY -change_pct, symbol) AS nth FROM m QUALIFY nth <= 5)
    SELECT (SELECT string_agg(id, '|' ORDER BY n) FROM v_top) AS top5, (SELECT n_name FROM nation WHERE n_nationkey = 31 % (SELECT count(*) FROM nation)) AS fact,
      (SELECT symbol FROM v_pool ORDER BY change_pct DESC, nth + CASE WHEN CAST(symbol AS INT) % 2 = 1 THEN 1000000 ELSE 0 END LIMIT 1) AS best, (SELECT max(change_pct) FROM v_pool) AS change""",
)
def brief_payload(spark, d):
    facts = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("nth"), F.col("n_name").alias("title"), F.col("n_regionkey").cast("string").alias("text"))
    market = _metrics(spark, d).withColumn("kind", F.when(F.col("symbol").cast("int") % 2 == 0, "etf").otherwise("stock"))
    whole = series.brief_payload(series.brief_top(board.ranked(_board(spark, d)[0])), facts, market, as_of())
    got = F.from_json("json", "fact struct<title:string>, financeStat struct<symbol:string, change:double>, top5 array<struct<id:string>>")
    return whole.select(got.alias("j")).select(F.array_join(F.transform("j.top5", lambda x: x["id"]), "|").alias("top5"), F.col("j.fact.title").alias("fact"), F.col("j.financeStat.symbol").alias("best"), F.col("j.financeStat.change").alias("change"))


@query("weekday_label", f"""SELECT event_id, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-15' THEN 'HEUTE' ELSE ['MO','DI','MI','DO','FR','SA','SO'][isodow(ts)] END AS label FROM events""")
def weekday_label(spark, d):
    return V.table(spark, d, "events").select("event_id", N.weekday_label(F.to_date("ts"), F.lit("2024-01-15").cast("date")).alias("label"))


@query("stale_feeds", f"""{with_views('v_event', 'v_raw')} SELECT feed_url, round(epoch(TIMESTAMP '{AS_OF}' - max(fetched_at)) / 60.0::DOUBLE, 6) AS age, epoch(TIMESTAMP '{AS_OF}' - max(fetched_at)) / 60.0::DOUBLE > 720 AS stale FROM v_raw GROUP BY feed_url""")
def stale_feeds(spark, d):
    return series.stale(V.raw(spark, d), "feed_url", as_of(), C.MARKET_TTL_MINUTES).withColumn("age", F.round("age", 6))


_CANONICAL = ORACLES["canonical_url"].rpartition("SELECT page_id, base")[0]


@query(
    "feed_scan",
    f"""{_CANONICAL}, u AS (SELECT page_id, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM c)
    SELECT substr(sha256(url), 1, 32) AS id, url AS canonical_url, 'Seite & ' || max(page_id) AS title, 's' || arg_min(page_id % 5, page_id) AS source_key, min(page_id % 5)::INT AS feed_rank, {_TOPICS}[min(page_id % 5) + 1] AS topic, TIMESTAMP '2024-01-30 10:00:00' AS published_at FROM u GROUP BY url""",
)
def feed_scan(spark, d):
    """Pages wrapped as one RSS entry each, fetched one a second, scanned and folded into items."""
    p = V.table(spark, d, "pages")
    body = F.concat(F.lit("<rss><channel><item><title>Seite &amp;amp; "), F.col("page_id"), F.lit("</title><link>"), X.escape_xml(F.col("url")), F.lit("</link><pubDate>Tue, 30 Jan 2024 10:00:00 GMT</pubDate></item></channel></rss>"))
    at = F.timestamp_micros(F.unix_micros(as_of()) + F.col("page_id") * 1_000_000)
    raw = p.select(F.concat(F.lit("f"), F.col("page_id") % 5).alias("feed_url"), at.alias("fetched_at"), F.lit(200).alias("status"), F.encode(body, "utf-8").alias("body"))
    known = spark.createDataFrame([(f"f{i}", f"s{i}", "de", C.TOPICS[i], i) for i in range(5)], "feed_url string, source_key string, lang string, topic string, feed_rank int")
    return merge.merge_items(feeds.observations(raw, known)).select("id", "canonical_url", "title", "source_key", "feed_rank", "topic", "published_at")


@query(
    "refresh_items",
    f"""{_CANONICAL}, u AS (SELECT page_id, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM c)
    SELECT substr(sha256(url), 1, 32) AS id, url, 'Seite ' || max(page_id) AS title, min(page_id)::INT AS feed_rank, {_TOPICS}[min(page_id) % 5 + 1] AS topic, 'tile' AS image_kind, TIMESTAMP '2024-01-30 10:00:00' AS published_at FROM u GROUP BY url""",
)
def refresh_items(spark, d):
    """The whole engine: pages as one feed each are logged, folded, given images, clustered, and read back from the store."""
    p = V.table(spark, d, "pages")
    store = engine.open_store(spark, new_path(spark, "store"))
    n = F.col("page_id")
    url = F.concat(F.lit("https://feeds/"), n)
    sources = p.select(F.concat(F.lit("s"), n).alias("key"), F.concat(F.lit("S"), n).alias("name"), (n % 3 + 1).cast("int").alias("tier"), F.lit("de").alias("lang"), F.lit(True).alias("no_scrape"))
    topic = F.element_at(F.array(*map(F.lit, C.TOPICS)), (n % 5 + 1).cast("int"))
    engine.sync_sources(store, sources, p.select(url.alias("feed_url"), F.concat(F.lit("s"), n).alias("source_key"), F.lit("de").alias("lang"), topic.alias("topic"), n.cast("int").alias("feed_rank")))
    body = F.concat(F.lit("<rss><channel><item><title>Seite "), n, F.lit("</title><link>"), X.escape_xml(F.col("url")), F.lit("</link><pubDate>Tue, 30 Jan 2024 10:00:00 GMT</pubDate></item></channel></rss>"))
    none = F.lit(None).cast("string")
    fetched = p.select(url.alias("feed_url"), as_of().alias("fetched_at"), F.lit(200).alias("status"), none.alias("etag"), none.alias("last_modified"), F.sha2(body, 256).alias("sha256"), F.encode(body, "utf-8").alias("body"))
    engine.refresh(store, fetched, as_of())
    return engine.stored(store, "item").select("id", F.col("canonical_url").alias("url"), "title", "feed_rank", "topic", "image_kind", "published_at")
