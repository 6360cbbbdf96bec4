"""Fingerprints, the audit of filters and hard negatives against plain Python, on tables with odd rows."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import digest, filter_audit, hard_negatives

random.seed(5)
WORDS = ["karo", "lomi", "rentu", "shavel", "orin", "GROSS", "Wort", "a#b", "x"]


def text(n):
    return " ".join(random.choice(WORDS) + str(random.randint(0, n)) for _ in range(n))


TEXTS = [text(random.randint(1, 300)) for _ in range(60)] + [None, "", " \t\n", "é" * 4001, "ab", "x y " * 50, text(20_000), "GROSS " * 120]
DOCS = "text string, part string, key string, lang string, doc_id long, n long, mask int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(t, "clash", "k", ["de", None, "", "en"][i % 4], 3 * i, 1, 2) for i, t in enumerate(TEXTS)]
    copies = [("hot text " * 5, "p", "k", "de", 1000 + i, 1, 2) for i in range(120)]
    odd = [rows[0], rows[0], (TEXTS[3], "", "", "en", 9, 0, 0), ("other text of one id", "", "", "en", 9, 0, 0), (TEXTS[5], "", "", "fr", None, 0, 0), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows + copies + odd, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3 * i, i % 3 and 1, i % 5 == 0 and 1 or 0, "clash") for i in range(50)] + [(0, 1, None, ""), (None, 1, 1, ""), (1000, None, 1, ""), (77777, 1, 1, "")], "doc_id long, quality int, toxic int, lang string")


def plain_audit(docs, labels):
    first = {}
    for d in docs:
        t = d.text or ""
        if d.doc_id is not None:
            first[t] = min(first.get(t, d.doc_id), d.doc_id)
    good, toxic = ({x.doc_id for x in labels if x.doc_id is not None and x[c] == 1} for c in ("quality", "toxic"))
    seen = []
    for d in docs:
        t = d.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d.doc_id is not None and d.doc_id > first[t],
        }
        seen.append((d.lang or "", fails, d.doc_id in good, d.doc_id in toxic))
    out, sums = {}, Counter()
    for part in {s[0] for s in seen}:
        own = [s for s in seen if s[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [s for s in left if s[1][f]]
                left = [s for s in left if not s[1][f]]
                failing = [s for s in own if s[1][f]]
                alone = [s for s in failing if sum(s[1].values()) == 1]
                sums[part, f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), len(alone), sum(s[2] for s in gone), sum(s[3] for s in gone)]
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_by_brute_force(docs, labels):
    got = filter_audit.audit(docs, labels)
    assert got.columns == [x.split()[0] for x in filter_audit.AUDIT.split(", ")]
    found = {(r.part, r.filter_order, r.step): tuple(r[3:10]) for r in got.collect()}
    assert found == plain_audit(docs.collect(), labels.collect())
    assert len(found) == 600 * len({k[0] for k in found}) and "" in {k[0] for k in found}


def test_audit_of_empty_tables(docs, labels):
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    bare = filter_audit.audit(docs, labels.limit(0))
    assert bare.count() > 0 and bare.filter("good_lost + toxic_lost > 0").isEmpty()


def test_audit_of_very_long_texts(spark):
    """Counts whose hundredfold 32 bits don't hold."""
    some = spark.range(2).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.when(F.col("id") == 0, F.expr("concat('a ', repeat('A', 22000000))")).otherwise("a a").alias("text"))
    got = filter_audit.mask_counts(some, spark.createDataFrame([], "doc_id long, quality int, toxic int")).filter("n > 0")
    assert sorted(tuple(r) for r in got.collect()) == [("en", 1 | 2, 1, 0, 0), ("en", 1 | 4, 1, 0, 0)]


def test_removal_polynomial():
    counts = [random.randint(0, 9) for _ in range(32)]
    p = filter_audit.removal_polynomial(counts)
    for chosen in range(32):
        assert filter_audit.at_corner(p, chosen) == sum(n for m, n in enumerate(counts) if m & chosen)
    assert sum(filter_audit.shapley(p, i) for i in range(5)) == sum(counts[1:])


def plain_counts(t):
    out = Counter()
    for at in range(len(t) - digest.WINDOW + 1):
        for salt, own in enumerate(digest.TRIPLETS):
            a, b, c = (t[at + k] for k in own)
            key = (a | b << 8 | c << 16 | salt << 24) * 0x9E3779B1 % 2**32
            out[(key ^ key >> 15) * 0x85EBCA77 % 2**32 >> 24] += 1
    return [out[k] for k in range(digest.BUCKETS)]


def plain_print(t):
    counts = plain_counts(t)
    q = [sorted(counts)[digest.BUCKETS * k // 4 - 1] for k in (1, 2, 3)]
    codes = [sum(c > x for x in q) for c in counts]
    length = min(255, round(8 * float(np.log2(1 + len(t)))))
    top = max(q[2], 1)
    return bytes([length, (q[0] * 15 // top) << 4 | q[1] * 15 // top, *(int("".join(f"{c:02b}" for c in codes[i : i + 4]), 2) for i in range(0, len(codes), 4))]).hex()


def test_digest_by_brute_force(docs):
    got = digest.digest(docs).collect()
    assert len(got) == docs.count() and got[0].__fields__ == [x.split()[0] for x in digest.DIGEST.split(", ")]
    # rows that share a doc_id stand in an order of their own, so each may be followed by any of the next
    by = {}
    for r in docs.collect():
        by.setdefault((r.doc_id is None, r.doc_id or 0), []).append(r.text or "")
    keys = sorted(by)
    for r in got:
        at = keys.index((r.doc_id is None, r.doc_id or 0))
        texts = [t for t in by[keys[at]] if plain_print(t.encode()) == r.fingerprint and len(t) == r.n_chars]
        nexts = by[keys[at]] + by[keys[(at + 1) % len(keys)]] if len(by[keys[at]]) > 1 else by[keys[(at + 1) % len(keys)]]
        fits = []
        for t in texts:
            for n in nexts:
                half = len(t) // 2
                e = (t[: len(t) - half] + n[:half]).encode()
                fits.append(hashlib.sha256(e).hexdigest() == r.edited_sha256 and plain_print(e) == r.edited_fingerprint)
        assert any(fits)
        assert 0 <= r.near_next <= 1 and abs(r.near_edited - digest.likeness([r.fingerprint], [r.edited_fingerprint])[0]) < 1e-12


def test_digest_chains_partitions(spark):
    """Every document has the next one by doc_id, across tasks, and the last one the first."""
    texts = [text(random.randint(3, 60)) for _ in range(300)]
    some = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {r.doc_id: r for r in digest.digest(some).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    prints = digest.fingerprints([t.encode() for t in texts])
    for i, t in enumerate(texts):
        then = (i + 1) % len(texts)
        assert got[i].edited_sha256 == hashlib.sha256(digest.edit(t, texts[then]).encode()).hexdigest()
        assert got[i].fingerprint == prints[i] and got[i].near_next == digest.likeness([prints[i]], [prints[then]])[0]
    assert sum(got[i].near_edited > got[i].near_next for i in got) > 0.9 * len(got)


def test_digest_of_few_rows(spark):
    assert digest.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = digest.digest(spark.createDataFrame([(4, "only one text here")], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(digest.edit("only one text here", "only one text here").encode()).hexdigest()


def test_long_texts_are_counted_whole(monkeypatch):
    t = text(3000).encode()
    whole = digest.bucket_counts([t, b"abc", b"", t])
    monkeypatch.setattr(digest, "PIECE", 1000)
    assert (digest.bucket_counts([t, b"abc", b"", t]) == whole).all()
    assert whole[0].tolist() == plain_counts(t) and whole[1].sum() == 0


def test_likeness_is_bounded():
    some = digest.fingerprints([b"", b"a" * 10, text(500).encode(), bytes(range(256)) * 40])
    for a in some:
        assert digest.likeness([a], [a])[0] == 1
        assert all(0 <= digest.likeness([a], [b])[0] == digest.likeness([b], [a])[0] <= 1 for b in some)


def plain_negatives(rows, every=100):
    own = sorted({(i, l, tuple(int(np.floor(256 * np.float64(x))) for x in v)) for i, v, l in rows if None not in (i, l, v) and len(v) and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for i, l, a in own:
        if i % every:
            continue
        scores = [(-sum(x * y for x, y in zip(a, v, strict=True)), j, m) for j, m, v in own if len(v) == len(a)]
        for s, p, _ in sorted(x for x in scores if x[2] == l and x[1] != i)[:5]:
            hits = sorted(x for x in scores if x[2] != l and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(i, p, k, x[1], -s, -x[0]) for k, x in enumerate(hits, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, row string, x int, size int"


def vectors(n, dim, spread=1.0):
    rng = np.random.default_rng(dim)
    centre = rng.normal(size=(4, dim)) * 0.4
    return [(i, (centre[i % 3] + rng.normal(size=dim) * spread).round(1).tolist(), i % 4) for i in range(n)]


def mined(spark, rows, **more):
    table = spark.createDataFrame([(i, v, l, "c", 1, 1) for i, v, l in rows], VECTORS).repartition(3)
    got = hard_negatives.mine(table, **more)
    assert got.columns == [x.split()[0] for x in hard_negatives.NEGATIVE.split(", ")]
    return sorted(map(tuple, got.collect()))


def test_hard_negatives_by_brute_force(spark, monkeypatch):
    rows = vectors(900, 8, 0.3)
    rows += [(i, rows[5][1], 2) for i in range(2000, 2300)]  # one vector and label in many rows: ties
    rows += [rows[0], rows[0], (100, rows[7][1], 3), (None, rows[0][1], 1), (1, None, 1), (2, rows[0][1], None), (3, [], 0), (200, [float("nan")] * 8, 0), (4, [0.0] * 8, 1), (5, [None, *rows[0][1][1:]], 1)]
    rows += [(100 * i, v[:3], l) for i, v, l in vectors(40, 3)] + [(99, [1.0, -2.0], 7), (700, [5.0, 5.0], 9)]
    want = plain_negatives([(i, None if v is None else [None if x is None else np.float32(x) for x in v], l) for i, v, l in rows])
    assert len(want) > 100 and mined(spark, rows) == want
    monkeypatch.setattr(hard_negatives, "ROWS", 130)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    assert mined(spark, rows) == want


def test_hard_negatives_of_large_integers(spark):
    rows = [(i, [x * 1e5 for x in v], l) for i, v, l in vectors(300, 4)]
    assert mined(spark, rows) == plain_negatives([(i, [np.float32(x) for x in v], l) for i, v, l in rows])
    huge = [(i, [x * 2e6 for x in v], l) for i, v, l in vectors(300, 4)]  # products beyond what doubles hold exactly
    assert mined(spark, huge) == plain_negatives([(i, [np.float32(x) for x in v], l) for i, v, l in huge])


def test_hard_negatives_of_few_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(100, [1.0], 1)]) == [] and mined(spark, [(100, [1.0], 1), (1, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1), (1, [2.0], 1), (2, [0.75], 2), (3, [1.8], 2), (5, [1.9], 2), (4, [0.5], 2)]) == [(100, 1, 1, 3, 131072, 117760), (100, 1, 2, 2, 131072, 49152)]


@pytest.mark.parametrize("chunk", [(7, 3, 0.5), (64, 128, 0.0), (1000, 1000, 1.0)])
def test_bit_slices(monkeypatch, chunk):
    for name, value in zip(("ROW_CHUNK", "ANCHOR_CHUNK", "SPARSE"), chunk, strict=True):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    a, x, ids = rng.integers(-90, 80, (20, 5)), rng.integers(-40, 130, (300, 5)), rng.permutation(300)
    low, high = rng.integers(-9000, 0, (20, 3)).astype(float), rng.integers(0, 9000, (20, 3)).astype(float)
    found = hard_negatives.Windows(low.copy(), high.copy(), 4)
    hard_negatives.sliced(a, x, ids, lambda i, j: (np.arange(20)[i, None] + np.arange(300)[None, j]) % 3 > 0, found)
    got = {(int(k) // 3, int(k) % 3): [] for k in found.key}
    for k, s, i in zip(found.key, found.score, found.id, strict=True):
        got[int(k) // 3, int(k) % 3].append((-int(s), int(i)))
    scores = a @ x.T
    for i in range(20):
        for p in range(3):
            want = sorted((-int(scores[i, j]), int(ids[j])) for j in range(300) if (i + j) % 3 and low[i, p] <= scores[i, j] <= high[i, p])[:4]
            assert got.get((i, p), []) == want
    assert sum(w * bits for w, _, bits in hard_negatives.planes_of(x)).tolist() == x.tolist()
