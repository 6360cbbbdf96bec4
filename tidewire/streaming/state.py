"""Feeds' responses as a stateful stream: what changed, and each feed's state, kept between batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STATE = "etag string, last_modified string, sha256 string, fetched_at timestamp, status int"
#: Feeds that no answer came from for so long are forgotten, milliseconds.
EXPIRY = 30 * 24 * 3600 * 1000


def use_state_store(spark: SparkSession) -> None:
    """The state store that processors need; timers are looked at when a batch has data, so that a stream which takes what is there also ends."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Follow(StatefulProcessor):
    """Keyed by feed_url. Emits the responses that changed (``emit``: changes), or the feed's state after each batch (state).

    State and changes are those of merge.feed_state and merge.changed over all responses so far: a changed response
    brings its own validators, an unchanged one keeps those that it doesn't name, a failure forgets them. A timer moves
    on with every answer; when it runs out the feed is forgotten, and its next full response counts as changed. A
    batch's responses of one feed, few of them, are put in order first.
    """

    def __init__(self, emit: str, columns: list[str], expiry: int):
        self.emit, self.columns, self.expiry = emit, columns, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.known = handle, handle.getValueState("feed", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        etag = modified = sha = at = status = None
        if self.known.exists():
            etag, modified, sha, at, status = self.known.get()
        for r in sorted(rows, key=lambda r: (r["fetched_at"], r["status"], r["sha256"] or "")):
            full = r["status"] == 200 and r["sha256"] is not None
            changed = full and r["sha256"] != sha
            if changed or not (full or r["status"] == 304):
                etag = modified = None
            if full or r["status"] == 304:
                etag, modified = r["etag"] if r["etag"] is not None else etag, r["last_modified"] if r["last_modified"] is not None else modified
            sha, at, status = r["sha256"] if full else sha, r["fetched_at"], r["status"]
            if changed and self.emit == "changes":
                yield Row(**{c: r[c] for c in self.columns})
        self.known.update((etag, modified, sha, at, status))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expiry)
        if self.emit == "state":
            yield Row(feed_url=key[0], etag=etag, last_modified=modified, sha256=sha, fetched_at=at, status=status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def _follow(raw: DataFrame, emit: str, out: StructType | str, mode: str, expiry: int) -> DataFrame:
    return raw.groupBy("feed_url").transformWithState(statefulProcessor=Follow(emit, raw.columns, expiry), outputStructType=out, outputMode=mode, timeMode="processingTime")


def changes(raw: DataFrame, expiry: int = EXPIRY) -> DataFrame:
    """The responses of a stream whose body is another one than the feed's last (A, B, A are three)."""
    return _follow(raw, "changes", raw.schema, "Append", expiry)


def states(raw: DataFrame, expiry: int = EXPIRY) -> DataFrame:
    """feed_url and STATE: after each batch the state of every feed that it had answers of."""
    return _follow(raw, "state", "feed_url string, " + STATE, "Update", expiry)
