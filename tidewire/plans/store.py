"""Tables under one folder that any Spark file system holds, written by numbered commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.operators.merge import keep_last_good, latest_per_key

META = "key string, value string, at timestamp"


class Store:
    """A commit is a folder ``name/c<first>-<last>`` that counts once Spark has committed it: what the table's commits from ``first`` to ``last`` told.

    So an appended batch spans its own number, and a commit with a wider span hides all inside of it. A commit may hold
    some parts of a table only (``part=...``); of each part the newest counts. A log's commits may lie in folders by day
    (``day=...``), which all count. What a commit hides stays until the next one of that table, so plans that began
    before it can end. One writer at a time.

    Tables named in ``together`` are written by one refresh after another: readers see them as they were when the last
    refresh ended (see begin and finish), all of one refresh.
    """

    def __init__(self, spark: SparkSession, root: str, together: tuple[str, ...] = ()):
        self.spark, self.root, self.together = spark, root.rstrip("/"), together

    # --- folders
    def _path(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _glob(self, pattern: str, depth: int) -> list[list[str]]:
        """The last ``depth`` names of each path that fits."""
        files, where = self._path(pattern)
        return sorted(str(f.getPath()).rsplit("/", depth)[1:] for f in files.globStatus(where) or [])

    def _delete(self, path: str) -> None:
        files, where = self._path(path)
        files.delete(where, True)

    def _commits(self, name: str) -> list[tuple[int, int]]:
        return [tuple(map(int, c[1:].split("-"))) for c, _ in self._glob(f"{name}/c*/_SUCCESS", 2)]

    def _shown(self, name: str, upto: int | None) -> list[tuple[int, int]]:
        """The commits up to a number that no other of these hides, oldest first."""
        out, least = [], None
        for first, last in sorted(self._commits(name), key=lambda c: (-c[1], c[0])):
            if (upto is None or last <= upto) and (least is None or first < least):
                out.append((first, last))
                least = first
        return out[::-1]

    def paths(self, name: str, upto: int | None = None) -> list[str]:
        """Folders, below the root, of what counts."""
        if upto is None and name in self.together:
            upto = self.finished()
        shown = [f"c{a}-{b}" for a, b in self._shown(name, upto)]
        folders: dict[str, list[str]] = {}
        for commit, folder in self._glob(f"{name}/c*/*=*", 2):
            folders.setdefault(commit, []).append(folder)
        newest = {p: f"{name}/{c}/{p}" for c in shown for p in folders.get(c, []) if p.startswith("part=")}
        days = [f"{name}/{c}/{d}" for c in shown for d in folders.get(c, []) if not d.startswith("part=")]
        return [*(f"{name}/{c}" for c in shown if c not in folders), *days, *(newest[p] for p in sorted(newest))]

    def _hidden(self, name: str) -> list[str]:
        shown, counts = {f"c{a}-{b}" for a, b in self._shown(name, None)}, set(self.paths(name, 1 << 62))
        old = [f"{name}/c{a}-{b}" for a, b in self._commits(name) if f"c{a}-{b}" not in shown]
        return old + [p for c, part in self._glob(f"{name}/c*/part=*", 2) if c in shown and (p := f"{name}/{c}/{part}") not in counts]

    # --- reading
    def exists(self, name: str) -> bool:
        return bool(self.paths(name))

    def load(self, paths: list[str], schema: str | T.StructType) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        if not paths:
            return empty
        return self.spark.read.schema(empty.schema).parquet(*(f"{self.root}/{p}" for p in paths)).select(*empty.columns)

    def read(self, name: str, schema: str | T.StructType, upto: int | None = None) -> DataFrame:
        """All that counts (up to a number); columns that older files lack are null; an empty table of ``schema`` if there is nothing."""
        return self.load(self.paths(name, upto), schema)

    log = read

    def read_parts(self, name: str, schema: str | T.StructType, parts: list[int], upto: int | None = None) -> DataFrame:
        """Some parts only."""
        wanted = {f"part={p}" for p in parts}
        return self.load([p for p in self.paths(name, upto) if p.rpartition("/")[2] in wanted], schema)

    def segments(self, name: str, upto: int | None = None) -> list[tuple[int, int]]:
        """The commits that count, by their spans."""
        return self._shown(name, self.finished() if upto is None and name in self.together else upto)

    # --- writing
    def _commit(self, name: str, rows: DataFrame, first: int, last: int, by: str | None) -> DataFrame:
        hidden = self._hidden(name)
        path = f"{name}/c{first}-{last}"
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{path}")
        for old in hidden:
            self._delete(old)
        return self.load([path], T.StructType([f for f in rows.schema if f.name != by]))

    def next(self, *names: str) -> int:
        return 1 + max((last for n in names for _, last in self._commits(n)), default=-1)

    def replace(self, name: str, rows: DataFrame, number: int | None = None, by: str | None = None) -> DataFrame:
        """The whole table; ``rows`` may read what is replaced. ``by``: the column that names parts."""
        return self._commit(name, rows, 0, self.next(name) if number is None else number, by)

    def replace_groups(self, name: str, rows: DataFrame, group: str, together: list[list[str]]) -> DataFrame:
        """Rows of the groups that ``rows`` has, with those that go ``together`` with them; other groups stay (see keep_last_good)."""
        old = self.read(name, rows.schema)
        return self.replace(name, keep_last_good(old, rows, group, together))

    def put(self, name: str, rows: DataFrame, by: str, number: int) -> DataFrame:
        """The parts that ``rows`` has, each as a whole; other parts stay as they are."""
        return self._commit(name, rows, number, number, by)

    def append(self, name: str, rows: DataFrame, number: int | None = None, by: str | None = None) -> DataFrame:
        """A log's next batch, numbered in ``batch``, as it was written: what is made from it agrees with the log, whatever ``rows`` would give a second time."""
        number = self.next(name) if number is None else number
        return self._commit(name, rows.drop("batch").withColumn("batch", F.lit(number).cast("long")), number, number, by)

    def merge(self, name: str, rows: DataFrame, first: int, last: int) -> DataFrame:
        """One commit in place of those from ``first`` to ``last``; rows keep the numbers of their batches."""
        return self._commit(name, rows, first, last, None)

    def drop_days(self, name: str, before: str) -> list[str]:
        """Delete a log's day folders before a day; the days."""
        days = [(c, d) for c, d in self._glob(f"{name}/c*/day=*", 2) if d.partition("=")[2] < before]
        for c, d in days:
            self._delete(f"{name}/{c}/{d}")
        left = {c for c, _ in self._glob(f"{name}/c*/day=*", 2)}
        for c in {c for c, _ in days} - left:
            self._delete(f"{name}/{c}")
        return sorted({d.partition("=")[2] for _, d in days})

    # --- refreshes
    def finished(self) -> int:
        """The number of the last refresh that ended."""
        return max((last for _, last in self._commits("refresh")), default=-1)

    def begin(self, *logs: str) -> int:
        """The next refresh's number; what one that never ended wrote to tables of ``together`` is taken back."""
        done = self.finished()
        for name in self.together:
            for first, last in self._commits(name):
                if last > done:
                    self._delete(f"{name}/c{first}-{last}")
        return self.next("refresh", *self.together, *logs)

    def finish(self, number: int, rows: DataFrame) -> None:
        self.append("refresh", rows, number)

    def set_meta(self, key: str, value: str, at: Column) -> None:
        """The key's entry; ``value`` is JSON."""
        new = self.spark.range(1).select(F.lit(key).alias("key"), F.lit(value).alias("value"), at.cast("timestamp").alias("at"))
        self.replace("meta", self.meta().filter(F.col("key") != key).unionByName(new).coalesce(1))

    def meta(self) -> DataFrame:
        """key, value, at."""
        return self.read("meta", META)


def by_second(raw: DataFrame, order: tuple[str, ...] = ("batch",)) -> DataFrame:
    """A raw log in which the row written last of each feed and second of ``fetched_at`` counts."""
    second = raw.withColumn("__second", F.date_trunc("second", "fetched_at"))
    return latest_per_key(second, ["feed_url", "__second"], list(order)).select(*raw.columns)


def as_lines(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``json``: each row as an object with its fields in the order of names, sorted over all tasks."""
    body = F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns)))
    keys = {f"__o{i}": c for i, c in enumerate(order)}
    return rows.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("json"), *(c.alias(k) for k, c in keys.items())).orderBy(*keys).select("json")


def write_json(lines: DataFrame, path: str, form: str = "array") -> None:
    """The ``json`` column as one document: an array of all rows in their order, or (``form``: object) the only row."""
    lines.select("json").write.format("tidewire_document").option("form", form).mode("overwrite").save(path)
