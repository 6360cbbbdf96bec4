"""Feeds as a stream: raw responses in, folded items out; polls that refresh a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.operators.merge import merge_items
from tidewire.plans import engine
from tidewire.plans.store import Store
from tidewire.sources.feeds import RAW, observations


def raw_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(spark.createDataFrame([], RAW).schema).parquet(path)


def polled(spark: SparkSession, requests: str, every: float, **options) -> DataFrame:
    """Responses of the feed source, asked once each ``every`` seconds."""
    reader = spark.readStream.format("tidewire_feeds").option("requests", requests).option("every", str(every))
    return reader.options(**{k: str(v) for k, v in options.items()}).load()


def start(raw: DataFrame, feeds: DataFrame, observed: str, checkpoint: str, once: bool = True, every: str = "30 minutes") -> StreamingQuery:
    """Append what each micro-batch observes to ``observed``; a batch that is run again overwrites its own part.

    Items are a fold over that log (:func:`items`), so late, repeated and reordered responses change nothing else.
    """

    def put(batch: DataFrame, number: int) -> None:
        observations(batch, feeds).write.mode("overwrite").parquet(f"{observed}/batch={number}")

    stream = raw.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime=every)).start()


def items(spark: SparkSession, observed: str) -> DataFrame:
    return merge_items(spark.read.parquet(observed).drop("batch"))


def poll(store: Store, checkpoint: str, every: str = "30 minutes", pages=None, **options) -> StreamingQuery:
    """Refresh ``store`` each ``every``: all feeds asked with the validators that it holds; as of the tick's own time.

    Ticks are a rate stream; a tick that is run again asks again, and folding what was seen before changes nothing.
    """

    def tick(batch: DataFrame, number: int) -> None:
        at = batch.agg(F.max("timestamp")).first()[0]
        if at is not None:
            engine.refresh(store, engine.fetch_feeds(store, **options), F.lit(at).cast("timestamp"), pages=pages)

    ticks = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
