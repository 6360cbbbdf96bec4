"""Domain views on the driver tables, in Spark and as SQL with the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import constants as C

AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("key")).distinct().select("key", F.concat(F.lit("Source "), F.col("key")).alias("name"), (1 + F.substring("key", 4, 10).cast("int") % 3).alias("tier"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("doc_id"), F.substring(F.sha2(d.cast("string"), 256), 1, 32).alias("id"), F.substring(F.substring_index("text", "\n", 1), 1, 300).alias("title"), F.substring("text", 1, 600).alias("teaser"),
        F.col("source").alias("source_key"), "lang", F.element_at(F.array(*map(F.lit, C.TOPICS)), (d % 5 + 1).cast("int")).alias("topic"),
        (as_of() - F.make_interval(mins=((d * 37) % 4320).cast("int"))).alias("published_at"), (d % 40).cast("int").alias("feed_pos"), (d % 47).cast("int").alias("feed_rank"),
        F.concat(F.lit("https://example.org/"), d.cast("string")).alias("canonical_url"), F.when(d % 9 == 0, "dpa").otherwise("").alias("agency"),
        F.when(d % 3 == 0, F.concat(F.lit("https://x/image/"), d.cast("string"))).otherwise("").alias("image_url"), F.when(d % 3 == 0, "feed").otherwise("").alias("image_kind"),
    )


def state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view", "purchase", "signup")).join(F.broadcast(n))
    return e.select(
        F.substring(F.sha2((F.col("event_id") % F.col("n")).cast("string"), 256), 1, 32).alias("item_id"), F.when(F.col("event_type").isin("click", "view"), "read").otherwise("saved").alias("field"),
        F.col("event_type").isin("click", "purchase").alias("on"), "ts", F.col("event_id").alias("seq"),
    )


def k():
    return F.get_json_object("props", "$.k").cast("int")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("feed_url"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (k() % 4).cast("string").alias("sha256"), F.concat(F.lit("e"), k()).alias("etag"), F.concat(F.lit("m"), k()).alias("last_modified"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        u.alias("id"), F.struct("ts", "event_id").alias("seq"), F.concat(F.lit("s"), k() % 5).alias("source_key"), F.concat(F.lit("https://x/"), u).alias("canonical_url"), F.lit("de").alias("lang"), F.col("ts").alias("fetched_at"),
        F.concat("event_type", k().cast("string")).alias("title"), F.concat(F.lit("t"), k()).alias("teaser"), F.when(k() % 7 == 0, "dpa").otherwise("").alias("agency"), (F.col("ts") - F.make_interval(mins=k())).alias("published_at"),
        (F.col("event_type") != "error").alias("has_date"), F.element_at(F.array(*map(F.lit, C.TOPICS)), (k() % 5 + 1).cast("int")).alias("topic"), F.concat(F.lit("f"), k() % 47).alias("feed_url"), (k() % 47).alias("feed_rank"), (F.col("event_id") % 40).cast("int").alias("feed_pos"),
        F.when(k() % 3 == 0, "").otherwise(F.concat(F.lit("https://x/"), k(), F.lit(".jpg"))).alias("image_url"), F.when(k() % 3 == 0, "").otherwise("feed").alias("image_kind"),
    )


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq is a total order, not a count: the metrics need no numbering of rows."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("symbol"), F.struct("ts", "event_id").alias("seq"), F.when(k() % 10 != 0, F.col("value")).alias("close"), (F.col("user_id") % 4 == 0).alias("pays"))


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("city"), F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.avg("value"), 6).alias("temp"), F.min(k()).alias("code"), F.round(F.max("value"), 6).alias("precip"))


# --- the same views as SQL ---------------------------------------------------------------------------------------------
_T = "[" + ",".join(f"'{t}'" for t in C.TOPICS) + "]"
SQL = {
    "v_source": "SELECT key, 'Source ' || key AS name, 1 + CAST(substr(key,4) AS INT) % 3 AS tier FROM (SELECT DISTINCT source AS key FROM documents)",
    "v_item": f"""SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)),1,32) AS id, substr(split_part(text, chr(10), 1),1,300) AS title, substr(text,1,600) AS teaser, source AS source_key, lang,
        {_T}[doc_id % 5 + 1] AS topic, TIMESTAMP '{AS_OF}' - to_minutes(((doc_id*37) % 4320)::BIGINT) AS published_at, doc_id % 40 AS feed_pos, doc_id % 47 AS feed_rank,
        'https://example.org/' || doc_id AS canonical_url, CASE WHEN doc_id % 9 = 0 THEN 'dpa' ELSE '' END AS agency,
        CASE WHEN doc_id % 3 = 0 THEN 'https://x/image/' || doc_id ELSE '' END AS image_url, CASE WHEN doc_id % 3 = 0 THEN 'feed' ELSE '' END AS image_kind FROM documents""",
    "v_event": "SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "v_ev_state": """SELECT substr(sha256(CAST(event_id % (SELECT count(*) FROM documents) AS VARCHAR)),1,32) AS item_id, CASE WHEN event_type IN ('click','view') THEN 'read' ELSE 'saved' END AS field,
        event_type IN ('click','purchase') AS is_on, ts, event_id AS seq FROM events WHERE event_type IN ('click','view','purchase','signup')""",
    "v_state": """SELECT item_id, max(CASE WHEN field='read' AND is_on THEN ts END) AS read_at, max(CASE WHEN field='saved' AND is_on THEN ts END) AS saved_at FROM
        (SELECT *, row_number() OVER (PARTITION BY item_id, field ORDER BY ts DESC, seq DESC) AS rn FROM v_ev_state) WHERE rn = 1 GROUP BY item_id""",
    "v_raw": "SELECT CAST(user_id AS VARCHAR) AS feed_url, ts AS fetched_at, event_id AS seq, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status, CAST(k % 4 AS VARCHAR) AS sha256, 'e' || k AS etag, 'm' || k AS last_modified FROM v_event",
    "v_close": "SELECT CAST(user_id AS VARCHAR) AS symbol, ts, event_id, value AS close, user_id % 4 = 0 AS pays FROM v_event WHERE k % 10 <> 0",
    "v_hour": "SELECT event_type AS city, date_trunc('hour', ts) AS hour, round(avg(value), 6) AS temp, min(k) AS code, round(max(value), 6) AS precip FROM v_event GROUP BY ALL",
}


def with_views(*names: str) -> str:
    """A WITH clause of the named views."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
