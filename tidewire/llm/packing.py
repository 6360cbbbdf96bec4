"""Best-fit packing by minimum bin slack.

Each bin takes the longest piece left and, of all combinations of the other pieces left, one that fills it best: a
bitset subset-sum over the available lengths finds it. The combination depends on lengths only, so the search runs
over the histogram of lengths (at most ``capacity`` numbers, whatever the corpus), and a combination is repeated while
the counts allow it, just as bin after bin would choose it again. Pieces then find their places by their rank among
the pieces of the same length.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidewire.llm._shared import SEPARATES, hashes_at, materialize, pieces_of, small_batches, table, text_of

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: A worker keeps the ids of this many different words; longer words (bytes) are encoded each time.
CACHE, LONG = 400_000, 64
#: Bytes that are encoded together.
BLOCK = 1 << 21
#: Marks a run of which is a token or tokens of its own behind a letter and before a separator.
MARKS, LETTERS = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", b"abcdefghijklmnopqrstuvwxyz"))
#: A letter of Latin-1 is this byte and one from 0x80 on; all but these two (the signs for times and divided by) are letters.
LATIN, NO_LETTER = 0xC3, (0x97, 0xB7)
NEVER = np.int32(2**31 - 1)
#: Ranks are counted in so many rows a group at most, roughly.
RANK_ROWS = 200_000
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


class WordPieces:
    """Byte-pair encoding of many short words at once, from the tokenizer's own merges.

    Each round joins, in every word that has one, the leftmost of its best-ranked pairs, as the tokenizer does one by one.
    """

    PAD = 65535

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([(vocab[a] << 16) | vocab[b] for a, b in pairs], np.uint32)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.uint16)
        # bytes stand for themselves if they print, the others come in order from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.inner = np.array([vocab[names[b]] for b in range(256)], np.uint16)
        self.last = np.array([vocab[names[b] + end] for b in range(256)], np.uint16)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint32) << np.uint32(16)) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NEVER)

    def encode(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that stand one behind the other in ``flat``, and their numbers. Words of like length go together."""
        starts, number, parts = np.cumsum(size) - size, np.zeros(len(size), np.int64), []
        for least, most in itertools.pairwise((0, 5, 7, 9, 11, 14, 20, 1 << 30)):
            for at in _split(np.flatnonzero((size > least) & (size <= most)), 20_000):
                ids, number[at] = self._encode(flat[spread(starts[at], size[at])], size[at])
                parts.append((at, ids))
        ends = np.cumsum(number)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for at, ids in parts:
            out[spread(ends[at] - number[at], number[at])] = ids
        return out, number

    def _encode(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = int(size.max())
        inside = np.arange(wide) < size[:, None]
        ids = np.full((len(size), wide + 1), self.PAD, np.uint16)
        ids[:, :wide][inside] = self.inner[flat]
        ids[np.arange(len(size)), size - 1] = self.last[flat[np.cumsum(size) - 1]]
        out = ids.copy()
        rows, ranks = np.arange(len(size)), np.full((len(size), wide), NEVER)
        pairs = inside[:, 1:]
        ranks[:, : wide - 1][pairs] = self._ranks(ids[:, : wide - 1][pairs], ids[:, 1:wide][pairs])
        steps = np.arange(wide + 1)
        while len(rows):
            at = ranks.argmin(1)
            each = np.arange(len(rows))
            best = ranks[each, at]
            going = best != NEVER
            if not going.all():
                out[rows[~going]] = ids[~going]
                rows, ids, ranks, at, best = rows[going], ids[going], ranks[going], at[going], best[going]
                each = each[: len(rows)]
                if not len(rows):
                    break
            moves = steps > at[:, None]
            ids[:, :-1] = np.where(moves[:, :-1], ids[:, 1:], ids[:, :-1])
            ids[:, wide] = self.PAD
            ids[each, at] = self.joined[best]
            ranks[:, :-1] = np.where(moves[:, :-2], ranks[:, 1:], ranks[:, :-1])
            ranks[:, wide - 1] = NEVER
            before = np.maximum(at - 1, 0)
            new = self._ranks(np.concatenate([ids[each, at], ids[each, before]]), np.concatenate([ids[each, np.minimum(at + 1, wide)], ids[each, at]]))
            ranks[each, at] = new[: len(at)]
            ranks[each, before] = np.where(at > 0, new[len(at) :], ranks[each, before])
        kept = out != self.PAD
        return out[kept].astype(np.int32), kept.sum(1)


def _split(at: np.ndarray, most: int) -> list[np.ndarray]:
    return [at[i : i + most] for i in range(0, len(at), most)]


def spread(starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of ranges, one range behind the other."""
    ends = np.cumsum(length)
    return np.repeat(starts - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Ids of whole texts, as the tokenizer gives them.

    The tokenizer drops white space and case and never joins across white space, so words can be encoded one by one,
    and a run of marks between a letter and white space is a word of its own. A block of texts is cut into words, which are told
    apart by 64-bit hashes and checked byte by byte; only those not seen before are encoded. What goes through the
    tokenizer itself, as it is: words with other characters than letters of Latin-1, and whole texts with what may be a
    special token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.pieces = Tokenizer.from_file(path), WordPieces(path)
        self.mark = self.tok.encode("\x01", add_special_tokens=False).ids[0]
        self.forget()

    def forget(self) -> None:
        self.keys, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.bytes, self.byte_ends = np.empty(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.id_ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def plain(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, np.int32)

    def _other(self, words: list[bytes]) -> list[np.ndarray]:
        """Words that the merges here don't cover: many at a time, with a mark between them; those that hold the mark go alone."""
        texts = [w.decode() for w in words]
        out = {i: self.plain(t) for i, t in enumerate(texts) if "\x01" in t}
        rest = [i for i in range(len(texts)) if i not in out]
        groups = [rest[i : i + 1000] for i in range(0, len(rest), 1000)]
        for group, many in zip(groups, self.tok.encode_batch_fast([" \x01 ".join(texts[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(many.ids, np.int32)
            out |= dict(zip(group, np.split(ids, np.flatnonzero(ids == self.mark)), strict=True))
            out |= {i: out[i][1:] for i in group[1:]}
        return [out[i] for i in range(len(texts))]

    def _learn(self, x: np.ndarray, good: np.ndarray, start: np.ndarray, size: np.ndarray, keys: np.ndarray) -> None:
        """Keep the words of ``x`` at ``start``; ``good``: the bytes of letters before each place."""
        flat, first, number = x[spread(start, size)], np.cumsum(size) - size, np.zeros(len(size), np.int64)
        simple = good[start + size] - good[start] == size
        at = np.flatnonzero(simple)
        ids, number[at] = self.pieces.encode(flat[spread(first[at], size[at])], size[at])
        others = np.flatnonzero(~simple)
        data = flat.tobytes()
        own = self._other([data[a : a + n] for a, n in zip(first[others].tolist(), size[others].tolist(), strict=True)])
        number[others] = [len(i) for i in own]
        ends = np.cumsum(number)
        made = np.empty(int(ends[-1]), np.int32)
        made[spread(ends[at] - number[at], number[at])] = ids
        if own:
            made[spread(ends[others] - number[others], number[others])] = np.concatenate(own)
        slot = len(self.id_ends) - 1 + np.arange(len(size))
        self.bytes, self.byte_ends = np.concatenate([self.bytes, flat]), np.concatenate([self.byte_ends, self.byte_ends[-1] + np.cumsum(size)])
        self.ids, self.id_ends = np.concatenate([self.ids, made]), np.concatenate([self.id_ends, self.id_ends[-1] + ends])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, place, keys), np.insert(self.slot, place, slot)

    def _words(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and sizes of the words, and the number of letters' bytes before each place. ``x`` ends in a separator; its case is dropped."""
        letter = LETTERS[x]
        lead = np.flatnonzero(x == LATIN)
        behind = x[lead + 1]
        capital = (behind >= 0x80) & (behind < 0x9F) & (behind != NO_LETTER[0])
        x[lead[capital] + 1] += 0x20
        lead = lead[(behind >= 0x80) & (behind != NO_LETTER[0]) & (behind != NO_LETTER[1])]
        letter[lead] = letter[lead + 1] = True
        gap = SEPARATES[x]
        marks = np.diff(MARKS[x].astype(np.int8), prepend=0)  # the last byte is a separator
        run, behind = np.flatnonzero(marks == 1), np.flatnonzero(marks == -1)
        alone = np.zeros(len(x), bool)
        alone[run[(run > 0) & letter[run - 1] & gap[behind]]] = True
        starts = ~gap
        starts[1:] &= gap[:-1]
        ends = gap.copy()
        ends[1:] &= ~gap[:-1]
        ends[0] = False
        start, end = np.flatnonzero(starts | alone), np.flatnonzero(ends | alone)
        return start, end - start, np.append(0, np.cumsum(letter))

    def block(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of the words of ``data``, their ids one behind the other, the ids' numbers); ``data`` ends in a separator."""
        x = np.frombuffer(bytearray(data.lower()), np.uint8)  # bytes: A-Z only
        start, size, good = self._words(x)
        if not len(start):
            return start, np.empty(0, np.int32), start
        keys = hashes_at(x.tobytes(), start, size)
        if len(self.keys) > CACHE:
            self.forget()
        order = np.argsort(keys)
        ordered = keys[order]
        fresh = np.append(True, ordered[1:] != ordered[:-1])
        uniq, first = ordered[fresh], order[fresh]
        inverse = np.empty(len(keys), np.int64)
        inverse[order] = np.cumsum(fresh) - 1
        known = self._known(uniq)
        unknown = np.flatnonzero(known < 0)
        if len(unknown):
            at = first[unknown]
            self._learn(x, good, start[at], size[at], uniq[unknown])
            known = self._known(uniq)
        word = known[inverse]
        if not self._same(x, start, size, word):  # two words with one hash
            self.forget()
            ids = [self.plain(data[a : a + n].decode()) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
            return start, np.concatenate(ids), np.array([len(i) for i in ids])
        number = self.id_ends[word + 1] - self.id_ends[word]
        ids = self.ids[spread(self.id_ends[word], number)]
        if size.max() > LONG:
            self._drop_long()
        return start, ids, number

    def _known(self, keys: np.ndarray) -> np.ndarray:
        """The slots of ``keys``, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slot[at], -1)

    def _same(self, x: np.ndarray, start: np.ndarray, size: np.ndarray, word: np.ndarray) -> bool:
        if not np.array_equal(self.byte_ends[word + 1] - self.byte_ends[word], size):
            return False
        return np.array_equal(x[spread(start, size)], self.bytes[spread(self.byte_ends[word], size)])

    def _drop_long(self) -> None:
        """Words over LONG bytes are forgotten by their key; all go once what they hold outweighs the others."""
        size = self.byte_ends[1:] - self.byte_ends[:-1]
        short = size[self.slot] <= LONG
        self.keys, self.slot = self.keys[short], self.slot[short]
        if int(size[size > LONG].sum()) > 4 * BLOCK:
            self.forget()

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each of ``texts``, in order."""
        held: list[tuple[int, bytes]] = []
        got: dict[int, list[np.ndarray]] = {}
        size = done = 0

        def flush() -> None:
            ends = np.cumsum([len(d) for _, d in held])
            start, ids, number = self.block(b"".join(d for _, d in held))
            cuts = np.append(0, np.cumsum(number))[np.searchsorted(start, ends)]
            for (i, _), a, b in zip(held, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                got.setdefault(i, []).append(ids[a:b])
            held.clear()

        for i, text in enumerate(texts):
            if b"<|" in text:
                got[i] = [self.plain(text.decode())]
                continue
            for piece in pieces_of(text, BLOCK):
                held.append((i, piece))
                size += len(piece)
                if size > BLOCK:
                    flush()
                    size = 0
                    while done < i:
                        yield np.concatenate(got.pop(done))
                        done += 1
        if held:
            flush()
        while done < len(texts):
            yield np.concatenate(got.pop(done))
            done += 1


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for each worker process, which tasks share one after another."""
    return Encoder(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each document's ids and a final 0; null text is empty."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            rows = []
            for i, ids in enumerate(encoder.encode([x.as_buffer().to_pybytes() for x in batch.column("text").cast(pa.binary())])):
                ids = np.append(ids, np.int32(0)).astype("<u4").tobytes()
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    rows.append((i, k, at, len(part) // 4, zlib.crc32(part)))
            own = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own[0], pa.int64())), pa.array(own[1], pa.int32()), *(pa.array(x, pa.int64()) for x in own[2:])], names=COLUMNS)

    schema = T.StructType([docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in COLUMNS[2:])])
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def fill(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Combinations in order: (times, [(length, pieces of it a bin)]). ``counts``: pieces by length."""
    left = {x: n for x, n in counts.items() if n > 0}
    out = []
    while left:
        longest = max(left)
        room, mask = capacity - longest, (1 << (capacity - longest + 1)) - 1
        left[longest] -= 1  # the bin's first piece
        reach, steps = 1, []
        for x in sorted((x for x in left if x <= room and left[x]), reverse=True):
            n, k = min(left[x], room // x), 1
            while n > 0:  # binary splitting of the count
                k = min(k, n)
                steps.append((x, k, reach))
                reach |= (reach << (x * k)) & mask
                n -= k
                k *= 2
            if reach >> room & 1:
                break
        at, took = reach.bit_length() - 1, {longest: 1}
        for x, k, before in reversed(steps):
            if not before >> at & 1:
                took[x] = took.get(x, 0) + k
                at -= x * k
        left[longest] += 1
        times = min(left[x] // k for x, k in took.items())
        for x, k in took.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]
        out.append((times, sorted(took.items(), reverse=True)))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32 and row, a number that tells repeated rows apart; written before) with sequence_id and offset."""
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, took in fill(counts, capacity):
        offset = 0
        for x, k in took:
            first = used.get(x, 0)
            places.setdefault(x, []).append((first, k, sequence, offset))
            used[x] = first + times * k
            offset += x * k
        sequence += times
    plan = {x: tuple(np.array(c, np.int64) for c in zip(*p, strict=True)) for x, p in places.items()}
    shared = pieces.sparkSession.sparkContext.broadcast(plan)  # grows with capacity, not with the pieces

    # rank within a length: groups of (length, salt) are numbered, and small counts tell where each group starts
    salts = max(16, sum(counts.values()) // RANK_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(salts)).cast("int"))
    base = (
        salted.groupBy("length", "salt").count()
        .withColumn("base", F.sum("count").over(W.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    )
    group = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "row")
    ranked = salted.withColumn("place", F.row_number().over(group) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for x in np.unique(lengths):
                at = np.flatnonzero(lengths == x)
                first, each, start, off = shared.value[int(x)]
                i = np.searchsorted(first, ranks[at], side="right") - 1
                nth = ranks[at] - first[i]
                sequence[at], offset[at] = start[i] + nth // each[i], off[i] + nth % each[i] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in COLUMNS), pa.array(sequence), pa.array(offset)], names=[*COLUMNS, "sequence_id", "offset"])

    schema = T.StructType([*(pieces.schema[c] for c in COLUMNS), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*COLUMNS, "rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack all documents.

    A null text is one piece with the single id 0, and so is an empty one. Repeated rows have their own pieces; pieces
    that agree in all columns may swap places. An empty table gives no rows. Other columns are not read.
    """
    pieces = cut(docs, path or tokenizer_path(), capacity).withColumn("row", F.monotonically_increasing_id())
    return pack(materialize(pieces, "pieces"), capacity)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 2048 tokens (see pack_documents for odd rows)."""
    return pack_documents(table(spark, sf_dir, "documents"))
