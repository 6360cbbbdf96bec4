"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import BROADCAST_ROWS, lookup, new_path, release  # noqa: F401
from tidewire.session import written as materialize  # noqa: F401

#: What separates words: ASCII white space only, as ``bytes.split()`` has it.
SPACE = r"[\x20\x09-\x0D]"
#: One word.
WORD = r"[^\x20\x09-\x0D]+"
#: The separators themselves, for btrim() and translate().
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Texts go to Python in batches of few bytes, so that long ones fit a worker's memory. Other operators may keep the setting: it bounds, and changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only for a side of checked size."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


_GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")
#: Bytes that separate words.
SEPARATES = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
#: Words of more bytes are hashed one by one.
_LONG_WORD = 256
#: Masks that keep the first bytes of eight, lowest first.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def pieces_of(text: bytes, size: int) -> Iterator[bytes]:
    """``text`` in pieces of about ``size`` bytes that end at white space, with a blank behind each."""
    at = 0
    while len(text) - at > 2 * size:
        end = next((m.end() for m in _GAP.finditer(text, at + size)), len(text))
        yield text[at:end] + b" "
        at = end
    yield text[at:] + b" "


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes_at(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of ``data`` that start there and have that many bytes, by chunks of eight bytes."""
    eight = np.ndarray((len(data),), "<u8", data + bytes(8), strides=(1,))
    out, at, own = size.astype(np.uint64), np.arange(len(start)), start
    for k in range(-(-min(int(size.max(initial=0)), _LONG_WORD) // 8)):
        if k:
            at = at[size[at] > 8 * k]
            own = start[at] + 8 * k
        chunk = eight[own] & _FIRST[np.minimum(size[at] - 8 * k, 8)]
        out[at] = mixed(out[at] * np.uint64(0x9E3779B97F4A7C15) + chunk)
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]])
    return out


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The starts of the words of ``data`` (ends in white space), and their hashes."""
    gap = SEPARATES[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1))
    start, end = edge[::2], edge[1::2]
    return start, hashes_at(data, start, end - start)


def hashed_words(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, hash of the word) for all words of ``texts``, about ``size`` bytes at a time."""
    held, owner, total = [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces_of(text, size):
            held.append(piece)
            owner.append(i)
            total += len(piece)
            if total > size:
                yield _hashed(held, owner)
                held, owner, total = [], [], 0
    if held:
        yield _hashed(held, owner)


def _hashed(held: list[bytes], owner: list[int]) -> tuple[np.ndarray, np.ndarray]:
    start, hashes = word_hashes(b"".join(held))
    ends = np.cumsum([len(x) for x in held])
    return np.array(owner)[np.searchsorted(ends, start, side="right")], hashes


class Table:
    """Values by 64-bit keys in open slots, for many keys at once. All ones is no key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        self.keys, self.values = np.full(1 << self.bits, ~np.uint64(0)), np.zeros(1 << self.bits, values.dtype)
        place = self._slot(keys)
        while len(keys):
            free = self.keys[place] == ~np.uint64(0)
            self.keys[place[free]] = keys[free]
            here = self.keys[place] == keys  # of those that want one slot the last stays
            self.values[place[here]] = values[here]
            keys, values, place = keys[~here], values[~here], (place[~here] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those that aren't there."""
        place = self._slot(wanted)
        seen = self.keys[place]
        out = np.where(seen == wanted, place, -1)
        left = np.flatnonzero((seen != wanted) & (seen != ~np.uint64(0)))
        place = place[left]
        while len(left):
            place = (place + 1) & (len(self.keys) - 1)
            seen = self.keys[place]
            hit = seen == wanted[left]
            out[left[hit]] = place[hit]
            on = ~hit & (seen != ~np.uint64(0))
            left, place = left[on], place[on]
        return out
