"""The training-data operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tidewire.llm import _shared, language_id, lm_score, mixing, near_dup, neighbours, packing, quality, token_counts, url_filter, warc

random.seed(11)
SYLLABLES = ["ka", "lo", "mi", "ren", "tu", "sha", "vel", "or", "in"]


def word():
    return "".join(random.choice(SYLLABLES) for _ in range(random.randint(1, 3)))


def prose(n):
    return " ".join(word() + random.choice(["", "", ",", "."]) for _ in range(n))


BASE = [prose(random.randint(3, 120)) for _ in range(40)]
TEXTS = [*BASE, BASE[0], BASE[1] + " zusatz", BASE[2].upper(), None, "", " \n\t", "x", "a b", "wort " * 3000, prose(4000), "1 2 3 !!", "Zeile eins hier\nZeile eins hier\n\nzwei", "é" * 5000]
DOCS = "doc_id long, text string, lang string, source string, size string, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["de", "en", None][i % 3], ["a", "b", None, "ä"][i % 4], "clash", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None, BASE[3], "de", "a", "", 0), (None, None, None, None, None, None)], DOCS).repartition(3).cache()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert quality.keep_good(none).count() == language_id.keep_identified(none).count() == near_dup.keep_one(none).count() == mixing.mix(none).count() == packing.pack_documents(none).count() == 0
    assert lm_score.score(none).count() == token_counts.token_counts(none).count() == 0
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_columns_and_clean_rows_stay(docs):
    for out in (quality.keep_good(docs), language_id.keep_identified(docs), near_dup.keep_one(docs), mixing.mix(docs)):
        assert out.columns == docs.columns and out.count() > 10


def test_url_rules(spark):
    urls = ["http://a.net/x", "http://example.net/en/1", "https://sub.EXAMPLE.net/en/", "http://notexample.net/en/", "http://x.org/fr/1?q#", "http://x.org", "http://y.net", None, "kein", "http://a.example.com/de/?x", "http://a.b.c.org/fr/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls * 400)], "page_id long, url string, key string")

    def brute(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit, key=lambda x: len(x[0])) if fit else (None, "allow")))

    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = url_filter.filter_urls(pages, rules).collect()
    assert len(got) == len(urls) * 400 and all((r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id % len(urls)]) for r in got)


def test_token_counts_agree_with_plain_dynamic_programming(docs):
    scores, byte = token_counts.unigrams(token_counts.vocabulary_path())
    longest = max(map(len, scores))

    def plain(w):
        t = token_counts.MARK + w
        best = [(0.0, 0)]
        for end in range(1, len(t) + 1):
            options = [(best[s][0] + scores[t[s:end]], -best[s][1] - 1) for s in range(max(0, end - longest), end) if t[s:end] in scores]
            if t[end - 1] not in scores:
                n = len(t[end - 1].encode())
                options.append((best[end - 1][0] + n * byte, -best[end - 1][1] - n))
            s, n = max(options)
            best.append((s, -n))
        return best[-1][1], best[-1][0]

    known = {}
    got = token_counts.token_counts(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    for r in got:
        own = words(TEXTS[r.doc_id])
        known |= {w: plain(w) for w in set(own) - set(known)}
        assert r.n_words == len(own) and r.n_tokens == sum(known[w][0] for w in own) and math.isclose(r.log_score, sum(known[w][1] for w in own), rel_tol=1e-9, abs_tol=1e-9)


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    random.seed(21)
    letters = "abcXYZéÉß×÷ÿŸ’“”.,;:!?'-_()[]<|>/\\@#0123456789 \t\n\r\x0b\x0c\x01  İıΣσςǅΩ日本ﬁ€$$%"
    odd = ["".join(random.choices(letters, k=random.randint(0, 60))) for _ in range(400)] + ["x" * 5000 + " y", "ab " * 40_000, "<|endoftext|> a", "don't É, ß! n° l'eau,"]
    odd += ["a\x01b c", "Abc, abc. x's <|endoftext|> <|ENDOFTEXT|>,", "ΣΑΣ, İ ǅ ½. ²,", "x \t a\r\nb", "日本語、テスト。", " lead  double "]
    some = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = packing.pack_documents(some).collect()
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.piece), []).append((r.start, r.length, r.ids_crc32))
    for i, t in [*enumerate(TEXTS), *((1000 + i, t) for i, t in enumerate(odd))]:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            assert set(by[i, k // 2048]) == {(k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))}
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= -(-sum(r.length for r in got) // 2048) + 1


def test_fill_is_the_fullest_choice():
    random.seed(2)
    for _ in range(30):
        counts = Counter(random.randint(1, 50) for _ in range(random.randint(1, 25)))
        left = dict(counts)
        for times, took in packing.fill(dict(counts), 50):
            top = max(x for x, n in left.items() if n)
            sums = {0}
            rest = dict(left)
            rest[top] -= 1
            for x, n in rest.items():
                for _ in range(n):
                    sums |= {s + x for s in sums if s + x <= 50 - top}
            assert top in dict(took) and sum(x * k for x, k in took) == top + max(sums)
            for x, k in took:
                left[x] -= times * k
        assert not any(left.values())


def test_language_held_out_accuracy(spark):
    random.seed(4)
    de, en = "der die und nicht ist ein haus straße über mit schule".split(), "the and not is a house street over with school".split()
    rows = [(i, " ".join(random.choices(de if i % 2 else en, k=12)), "de" if i % 2 else "en") for i in range(400)] + [(900, None, "de"), (901, "12 !", "en"), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(df, language_id.fit(df.filter(~language_id.held_out()))).select("doc_id", language_id.held_out().alias("h"), "__tw_l.*").collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:400]) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert all(got[i].h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)


def test_languages_over_the_sample_without_ids(spark):
    """Null doc_ids, one doc_id and one text in many rows: each language is learned from some of them, not from all or none."""
    random.seed(8)
    words_of = {"de": "der die und nicht ist ein haus".split(), "en": "the and not is house with school".split(), "fr": "le la et dans une avec pour".split()}
    rows = [(None, " ".join(random.choices(words_of["de"], k=9)), "de") for _ in range(400)] + [(7, " ".join(random.choices(words_of["en"], k=9)), "en") for _ in range(400)] + [(None, "le la et dans une avec pour", "fr")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, sample=10)
    assert model[0] == ["de", "en", "fr"] and (model[1].std(0) > 0.01).all()
    asked = spark.createDataFrame([(i, " ".join(random.choices(words_of[k], k=9)), k) for i, k in enumerate(["de", "en", "fr"] * 9)], "doc_id long, text string, want string")
    assert language_id.predict(asked, model).filter("__tw_l.lang_pred <> want").isEmpty()
    assert not language_id.predict(asked, language_id.fit(df.limit(0))).filter("__tw_l.lang_pred = 'und'").isEmpty()


def test_language_scores_are_each_texts_own(spark, monkeypatch):
    """Naive Bayes in plain Python, text by text, whatever the neighbours and the pieces of long texts."""
    random.seed(5)
    texts = ["a", "xy", "é", "der", "a", "the zug", "x", prose(30), "ü b", "日本語 テスト", "привет мир", prose(400), "q" * 3000]
    matrix = np.random.default_rng(5).normal(size=(language_id.BUCKETS, 3)).astype(np.float32)

    def plain(text):
        t, sums = [ord(c) for c in language_id.clean(text)], np.zeros(3)
        for n in range(1, 5):
            for i in range(len(t) - n + 1):
                h = 0
                for c in t[i : i + n]:
                    h = (h * 0x01000193 + c) & 0xFFFFFFFF
                h = (h + n) * 2654435761 & 0xFFFFFFFF
                h ^= h >> 15
                sums += matrix[(h * 2246822519 & 0xFFFFFFFF) >> 16].astype(np.float64)
        return sums

    for block, order in ((language_id.BLOCK, texts), (64, texts[::-1])):
        monkeypatch.setattr(language_id, "BLOCK", block)
        assert all(np.allclose(language_id.counts(t) @ matrix.astype(np.float64), plain(t), rtol=1e-9) for t in texts)
        df = spark.createDataFrame([(i, t) for i, t in enumerate(order)], "doc_id long, text string").coalesce(1)
        for r in language_id.predict(df, (["de", "en", "fr"], matrix)).select("text", "__tw_l.*").collect():
            own = plain(r.text)
            assert r.lang_pred == ["de", "en", "fr"][own.argmax()] and math.isclose(r.score, 1 / np.exp(own - own.max()).sum(), rel_tol=1e-9)


def test_mix_meets_its_targets(docs):
    sized, limits, _ = mixing.plan(docs)
    size = {}
    for r in sized.collect():
        size[r.source] = size.get(r.source, 0) + r.size
    assert sum(size.values()) == sum(len(words(t)) for t in TEXTS) + len(words(TEXTS[0])) + len(words(BASE[3]))
    # water filling, round by round
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    want, free, budget = {}, set(size), sum(size.values())
    while free:
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        if not over:
            want |= {s: weight[s] * level for s in free}
            break
        want |= {s: 3.0 * size[s] for s in over}
        budget -= sum(3 * size[s] for s in over)
        free -= over
    lim = {r.source: r for r in limits.collect()}
    taken = Counter()
    for r in sized.collect():
        times = lim[r.source].copies + (r.h < lim[r.source].below)
        assert times <= 3
        taken[r.source] += r.size * times
    largest = max(len(words(t)) for t in TEXTS)
    for s in size:
        assert math.isclose(lim[s].target, want[s]) and abs(taken[s] - want[s]) <= largest


def test_mix_of_many_sources(spark, docs, monkeypatch):
    """Above the bound of broadcasts, with hot sources apart, the mix is the same."""
    from tidewire import session

    want = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(session, "KEY_ROWS", 0)
    assert sorted(map(str, mixing.mix(docs).collect())) == want and len(want) > 20


def test_url_rules_of_equal_length_and_empty_tables(spark):
    rules = spark.createDataFrame([("a.org", "/xy", "block"), ("b.a.org", "/", "allow"), ("A.org", "/xy", "allow"), ("org", "/xy/z", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://b.a.org/xy/z"), (2, "http://a.org/xy/z"), (3, "http://c.org/xy/z")], "page_id long, url string")
    # of two rules as long the one with the longer host wins; a rule that is given twice has the smallest verdict
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()} == {1: ("b.a.org/", "allow"), 2: ("a.org/xy", "allow"), 3: ("org/xy/z", "block")}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.rule for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {None}


def test_warc_round_trip(spark, tmp_path):
    big = "ü" * 700
    html = [big, big, "<p>klein", "<p>klein", None, "x" * 300_000, "\r\n\r\nWARC/1.1\r\n\r\n" * 200, big, *("".join(map(chr, np.random.default_rng(i).integers(32, 2000, 4000))) for i in range(60))]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\n" if i else None, h, 1) for i, h in enumerate(html)], "page_id long, url string, html string, size int")
    warc.write_warc(pages, str(tmp_path / "w"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        read = warc.read_warc(spark, str(tmp_path / "w"), payload=True)
        got = {r.page_id: r for r in read.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    import hashlib

    assert len(got) == len(html)
    for i, h in enumerate(html):
        data = (h or "").encode()
        revisit = i in (0, 1)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None)
        assert revisit or bytes(got[i].payload) == data


def test_warc_odd_tables(spark, tmp_path):
    schema = "page_id long, url string, html string, digest string, size string, main long"
    warc.write_warc(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0
    big, other = "a" * 1500, "b" * 1500
    rows = [(1, None, big), (1, None, big), (1, None, other), (2, None, other), (None, None, big), (3, None, big), (3, None, big), (4, None, "x" * 999), (5, None, "x" * 999)]
    warc.write_warc(spark.createDataFrame([(*r, "d", "s", 7) for r in rows], schema), str(tmp_path / "some"))
    got = sorted(((r.page_id if r.page_id is not None else -1), r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.read_warc(spark, str(tmp_path / "some")).collect())
    want = [(-1, 1500, "revisit", 3), (1, 1500, "revisit", 2), (1, 1500, "revisit", 3), (1, 1500, "revisit", 3), (2, 1500, "response", 0), (3, 1500, "response", 0), (3, 1500, "response", 0), (4, 999, "response", 0), (5, 999, "response", 0)]
    assert got == want


def test_warc_ids_of_64_bits(spark, tmp_path):
    ids = [1234567890123456789, 10**18, 2**63 - 1, -(2**63), -1, 5]
    warc.write_warc(spark.createDataFrame([(i, None, "a" * 1500) for i in ids], "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == {i: ("response", None) if i == 2**63 - 1 else ("revisit", 2**63 - 1) for i in ids}
    assert warc._number(f"<urn:x-page:{2**63}>") is None and warc._number("<urn:x-page:-9223372036854775809>") is None and warc._number("<urn:x-page:>") is None


def test_foreign_records_are_read():
    head = lambda *lines: "\r\n".join(("WARC/1.0", *lines)).encode() + b"\r\n\r\n"
    digest = "da39a3ee5e6b4b0d3255bfef95601890afd80709"
    assert warc.parse(head("WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:12-ab>", f"WARC-Payload-Digest: sha1:{digest.upper()}"))[:5] == (None, "revisit", None, digest, None)
    assert warc.parse(head("WARC-Type: revisit", "WARC-Payload-Digest: md5:abc"))[3] is None and warc.parse(head("WARC-Type: revisit"))[3] is None
    got = warc.parse(head("warc-type: resource", "Content-Length: viele", "WARC-Record-ID: <urn:uuid:1>") + b"abc\r\n\r\n")
    assert got[1:3] == ("resource", 3) and got[-1] == b"abc" and got[6] == "<urn:uuid:1>"
    assert warc.parse(b"HTTP/1.1 200 OK\r\n\r\n") is None and warc.parse(b"") is None


def test_walk_survives_a_magic_inside_a_member():
    payload = b"a" * 20
    inner = warc.record(1, None, payload, "00" * 20, None)
    fake = inner[:10] + warc.MAGIC + inner[10:]  # not a valid member any more, but a candidate cut in two
    stream = (inner + warc.record(2, None, b"b", "00" * 20, None)).split(warc.MAGIC)[1:]
    out = [r for r, *_ in warc._walk(iter(stream), True) if r]
    assert [r[0] for r in out] == [1, 2] and warc.members(fake)[2]


class PlainPPM:
    """PPM as it is defined: method C, full exclusion, contexts of up to ORDER bytes; a byte that no context has seen shares the root's escape."""

    def __init__(self, texts):
        self.seen = {}
        for t in texts:
            t = bytes([lm_score.MARK]) * lm_score.ORDER + t + bytes([lm_score.MARK])
            for i in range(lm_score.ORDER, len(t)):
                for k in range(lm_score.ORDER + 1):
                    c = self.seen.setdefault(t[i - k : i], {})
                    c[t[i]] = c.get(t[i], 0) + 1

    def probability(self, context, symbol):
        mass, excluded = 1.0, set()
        for k in range(lm_score.ORDER, -1, -1):
            own = {s: n for s, n in self.seen.get(context[lm_score.ORDER - k :], {}).items() if s not in excluded}
            if own:
                below = sum(own.values()) + len(own)
                if symbol in own:
                    return mass * own[symbol] / below
                mass *= len(own) / below
                excluded |= set(own)
        return mass / max(1, 256 - len(excluded))

    def score(self, text):
        t = bytes([lm_score.MARK]) * lm_score.ORDER + text + bytes([lm_score.MARK])
        return sum(math.log10(self.probability(t[i - lm_score.ORDER : i], t[i])) for i in range(lm_score.ORDER, len(t)))


def test_lm_scores_agree_with_plain_ppm_and_base_is_exact(docs):
    rows = docs.select("doc_id", "text").collect()
    train = [r for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10]
    c = Counter(w for r in train for w in (r.text or "").encode().lower().split())
    n, v = sum(c.values()) + len(train), len(c) + 1
    lg = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    plain = PlainPPM([(r.text or "").encode().lower() for r in train])
    want = {i: plain.score((t or "").encode().lower()) for i, t in enumerate(TEXTS)}
    for frequent in (1 << 21, 50):  # with hardly any frequent words and grams the others come by the shuffle
        got = lm_score.score(docs, frequent, frequent).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                continue
            own = (TEXTS[r.doc_id] or "").encode().lower().split()
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own) + 1, sum(w in c for w in own) + 1, n)
            assert math.isclose(r.base_score, sum(lg(c.get(w, 0)) for w in own) + lg(len(train)), rel_tol=1e-9)
            assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-5, abs_tol=1e-5)


def test_word_hashes_and_tables():
    random.seed(33)
    texts = [bytes(random.choices(b"ab\xc3\xa9 \t\n\x0b", k=random.randint(0, 300))) for _ in range(60)] + [b"", b"  ", b"x" * 700 + b" " + b"x" * 701, (b"y" * 8 + b" ") * 50]
    seen = {}
    for size in (1 << 20, 50):
        got = {i: [] for i in range(len(texts))}
        for owner, hashes in _shared.hashed_words(texts, size):
            for o, h in zip(owner.tolist(), hashes.tolist(), strict=True):
                got[o].append(h)
        for t, own in zip(texts, got.values(), strict=True):
            assert len(own) == len(t.split()) and all(seen.setdefault(w, h) == h for w, h in zip(t.split(), own, strict=True))
    assert len(set(seen.values())) == len(seen)
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 48, 5000).astype(np.uint64))
    for n in (0, 1, 5000):
        t = _shared.Table(keys[:n], np.arange(n))
        place = t.find(keys)
        assert (place[: len(keys[:n])] >= 0).all() and (t.values[place[: len(keys[:n])]] == np.arange(len(keys[:n]))).all() and (place[len(keys[:n]) :] == -1).all()


def test_blocks_of_long_texts_hold_each_symbol_once(monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK", 64)
    random.seed(12)
    texts = [prose(random.randint(0, 40)).encode() for _ in range(20)] + [b""]
    whole = [bytes([lm_score.MARK]) * lm_score.ORDER + t + bytes([lm_score.MARK]) for t in texts]
    want = Counter((i, t[k - lm_score.ORDER : k + 1]) for i, t in enumerate(whole) for k in range(lm_score.ORDER, len(t)))
    got = Counter()
    for data, where, owner in lm_score.blocks(texts):
        got.update((int(i), int(c).to_bytes(lm_score.ORDER + 1, "big")) for i, c in zip(owner, lm_score.codes(data, where), strict=True))
    assert got == want


def test_near_duplicates_against_all_pairs(docs):
    for size, percent in ((3, 85), (5, 80)):
        own = {i: {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set() for i, t in enumerate(TEXTS) for w in [(t or "").encode().lower().split()]}
        root = {i: i for i in own}
        for _ in range(5):
            for a in own:
                for b in own:
                    if own[a] and own[b] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b]):
                        root[a] = root[b] = min(root[a], root[b])
        for r in near_dup.groups(docs, size, percent).filter("doc_id is not null").collect():
            assert (r.n_shingles, r.component_id, r.kept) == (len(own[r.doc_id]), root[r.doc_id], r.doc_id == root[r.doc_id])


def test_one_doc_id_with_several_texts(spark):
    random.seed(9)
    a, b, c = prose(60), prose(60), prose(60)
    rows = [(1, a), (5, a), (5, b), (5, b), (7, c), (7, c + " zusatz"), (7, a.upper()), (8, b)]
    got = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted((r.doc_id, r.text) for r in got)
    assert len(kept) == 3 and kept[:2] == [(1, a), (5, b)] and kept[2][0] == 7 and kept[2][1] in (c, c + " zusatz")


def test_near_copies_in_a_dense_group(spark):
    random.seed(8)
    base = [word() + str(i) for i in range(90)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(random.randint(0, 4)):
            w[random.randrange(90)] = word() + "x" + str(random.random())
        texts.append(" ".join(w))
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (t.split() for t in texts)]
    root = list(range(150))
    for _ in range(10):
        for a in range(150):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = near_dup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))


def test_dense_group_in_small_blocks(spark):
    """A group just under and above the threshold: blocks of few nodes take all ways of comparing, and lose no link."""
    random.seed(18)
    bases = [[word() + str(i) for i in range(100)] for _ in range(3)]
    texts = []
    for _ in range(600):
        w = list(random.choice(bases))
        for _ in range(random.randint(0, 6)):
            w[random.randrange(100)] = word() + random.choice("xyz")
        texts.append(" ".join(w))
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (t.split() for t in texts)]
    root = list(range(600))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(600):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: top(i) for i in range(600)}
    for rows_, shingles in ((40, 1 << 21), (4096, 2500)):
        assert {r.doc_id: r.component_id for r in near_dup.groups(rows, 3, 85, rows_, shingles).collect()} == want
    assert 3 < len(set(want.values())) < 590


def test_spanning_links_join_what_all_links_join():
    rng = np.random.default_rng(4)
    for n in (2, 3, 9, 60):
        base = np.sort(rng.choice(1 << 40, 60, replace=False)).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(44, 60)), replace=False), rng.integers(0, 30, int(rng.integers(0, 6))).astype(np.uint64)])) for _ in range(n)]
        labels = rng.integers(0, max(2, n // 2), n)
        for percent in (70, 80, 90):
            join, span = near_dup._Joined(labels), near_dup._Joined(labels)
            for x in range(n):
                for y in range(x):
                    both = len(np.intersect1d(sets[x], sets[y]))
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        join.join(x, y)
            links = near_dup.spanning(sets, labels, np.arange(n), percent)
            assert all(span.join(x, y) for x, y in links)
            assert [join.root(i) for i in range(n)] == [span.root(i) for i in range(n)]


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:300] = x[0]  # a hundred equal vectors, the query's own
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [1.0, 2.0]), (9400, [None] + [1.0] * 15)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=50, window=200, block=300).collect()
    hits = 0
    for q in range(0, 1500, 50):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        order = np.lexsort((np.arange(1500), d))[:10]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-12 for r in own)
        hits += len({r.vec_id for r in own} & set(order.tolist()))
        if q == 0:
            assert [r.vec_id for r in own] == list(range(200, 210))
    assert {r.query_id for r in got} == set(range(0, 1500, 50)) and hits >= 0.9 * 300


def test_nearest_with_measured_windows(spark):
    rng = np.random.default_rng(3)
    flat, grouped = rng.normal(size=(6000, 24)), (rng.normal(size=(250, 1, 24)) * 4 + rng.normal(size=(250, 40, 24)) * 0.3).reshape(-1, 24)
    for x, curves in ((flat, 2), (grouped, 5)):  # neighbours without contrast, where windows are wide, and with it
        n = len(x)
        rows = spark.createDataFrame([(i, [float(v) for v in r], 0, 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, point int, rank int")
        got = neighbours.nearest(rows, every=100, curves=curves).collect()
        hits = 0
        for q in range(0, n, 100):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            d[q] = np.inf
            own = {r.vec_id for r in got if r.query_id == q}
            assert len(own) == 10
            hits += len(own & set(np.argsort(d)[:10].tolist()))
        assert hits >= 0.9 * 10 * len(range(0, n, 100))


def test_nearest_of_every_length(spark, monkeypatch):
    """Vectors of several lengths, each searched among its own; few askers a part; one vector that a third of the rows share."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=(2, 2, 2, 5, 9)[i % 5]).round(2).tolist()) for i in range(1500)] + [(i, [0.5, 0.25]) for i in range(2000, 2800)] + [(30_000, [3.0]), (40_000, [4.0, 1.0, 0.0])]
    monkeypatch.setattr(neighbours, "ASKERS", 3)
    got = neighbours.nearest(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, vec string"), every=20, window=100_000, curves=2, block=170).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    for i, v in rows:
        if i % 20 == 0:
            own = [(j, np.float32(w).astype(float)) for j, w in rows if len(w) == len(v) and j != i]
            want = sorted((math.dist(np.float32(v).astype(float), w), j) for j, w in own)[:10]
            assert found.get(i, []) == [(j, round(d, 9)) for d, j in want]


def test_rounded_vectors_bound_distances():
    rng = np.random.default_rng(9)
    x, q = rng.normal(size=(400, 6)), rng.normal(size=(30, 6))
    code = x.round(1)
    off = np.sqrt(((x - code) ** 2).sum(1))
    low, high = np.zeros(30, int), np.full(30, 400)
    d = np.sqrt(((x[None] - q[:, None]) ** 2).sum(2))
    kept = [set() for _ in q]
    for i, j, least, most in neighbours._may_be_near(q, code, off, low, high, 5):
        assert (least <= d[i, j]).all() and (d[i, j] <= most).all()
        for a, b in zip(i, j, strict=True):
            kept[a].add(int(b))
    assert all(set(np.argsort(d[i])[:5].tolist()) <= kept[i] and len(kept[i]) < 60 for i in range(30))


def test_many_ties_go_to_the_smaller_ids(spark):
    """A hundred different vectors at one distance from the query, far from the origin."""
    rows = [(0, [1000.0] * 60)] + [(1 + i, [1000.0 + (2.0 if j == i % 60 else 0.0) * (1 if i < 60 else -1) for j in range(60)]) for i in range(119, -1, -1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, every=1000, curves=2, window=200).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 11)) and all(r.score == 2.0 for r in got)


def test_quality_features_and_verdicts(docs):
    judged = quality.judge(quality.features(docs.select("doc_id", "text")).checkpoint()).filter("doc_id is not null").collect()
    for r in judged:
        t = TEXTS[r.doc_id] or ""
        w = words(t)
        window = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if window[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        f, v = r["__tw_f"], r["__tw_v"]
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert v.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (v.base_failed and v.kept)


def test_low_variety_is_seen_at_any_length(spark):
    random.seed(6)
    few = [f"wort{i}" for i in range(40)]
    texts = [" ".join(random.choices(few, k=k)) for k in (1999, 2000, 20_000)] + [" ".join(f"w{int(random.paretovariate(0.3))}" for _ in range(20_000)), prose(400)]
    rows = quality.features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = rows.select("doc_id", quality.votes(lambda k: F.col(f"__tw_f.{k}"))[7].alias("vote"), F.col("__tw_f.n_repeat_words").alias("again")).orderBy("doc_id").collect()
    assert [r.vote for r in got] == [-1, -1, -1, 0, 0] and all(r.again == 0 for r in got[:2])


def test_em_tells_junk_from_prose():
    junk, good = (-1, 0, 0), (0, 0, 1)
    post = quality.fit([(good, 900), (junk, 60), ((0, -1, 0), 40), ((0, 0, 0), 5)])
    assert post[good] > 0.9 and post[junk] < 0.1 and quality.fit([]) == {}


def plain_features(t):
    w = words(t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    count = lambda p: len(regex.findall(p, t or ""))
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": count(r"[#*$%&|<>]"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_upper": count(r"\p{Lu}"), "n_letters": count(r"\p{L}"), "n_bang": count("!"), "n_distinct": len(set(w)),
    }


def plain_votes(f):
    n, size = max(f["n_words"], 1), f["word_chars"] / max(f["n_words"], 1)
    letters, upper = f["n_letters"] / max(f["word_chars"], 1), f["n_upper"] / max(f["n_letters"], 1)
    symbols, bang = f["n_symbols"] / n, f["n_bang"] / n
    junk = [
        symbols > 0.1, upper > 0.35, bang > 0.3, f["n_repeat_words"] / n > 0.15, f["n_dup_lines"] / n > 0.05, f["n_words"] < 20, size > 14 or size < 2,
        f["n_distinct"] < 0.25 * min(n, math.sqrt(n * 2000)), letters < 0.7,
    ]
    prose_ = symbols <= 0.05 and upper <= 0.2 and bang <= 0.1 and 2.5 <= size <= 12 and letters > 0.65
    return (*(-int(x) for x in junk), int(prose_))


def plain_posteriors(votes):
    """EM document by document."""
    v, n = np.array(votes), len(votes)
    start = {True: np.array([[0.01, 0.989, 0.001]] * 9 + [[0.001, 0.1, 0.899]]), False: np.array([[0.2, 0.799, 0.001]] * 9 + [[0.001, 0.8, 0.199]])}
    chance, share = dict(start), 0.85
    rules = np.arange(v.shape[1])
    for _ in range(60):
        like = {y: np.log(chance[y][rules, v + 1]).sum(1) for y in chance}
        good = 1 / (1 + np.exp(-np.clip(like[True] - like[False] + math.log(share / (1 - share)), -60, 60)))
        for y, of in ((True, good), (False, 1 - good)):
            prior = 0.05 * n * (0.85 if y else 0.15)
            seen = np.stack([[of[v[:, j] == k].sum() for k in (-1, 0, 1)] for j in rules])
            chance[y] = (seen + prior * start[y]) / (of.sum() + prior)
        share = (good.sum() + 0.05 * n * 0.85) / (n * 1.05)
    return good


def test_quality_posteriors_agree_with_plain_em(docs):
    rows = docs.select("doc_id", "text").collect()
    want = plain_posteriors([plain_votes(plain_features(r.text)) for r in rows])
    by = {(r.doc_id, r.text): x for r, x in zip(rows, want, strict=True)}
    for r in quality.judge(quality.features(docs.select("doc_id", "text")).checkpoint()).collect():
        assert math.isclose(r["__tw_v"].posterior, by[r.doc_id, r.text], rel_tol=1e-6, abs_tol=1e-9)


def test_pipeline_stage_by_stage_in_plain_python(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    random.seed(44)
    vocabulary = {"de": "der die und nicht ist ein haus strasse mit schule garten wetter", "en": "the and not is a house street with school garden weather"}
    say = lambda lang, n: " ".join(random.choice(vocabulary[lang].split()) + str(random.choice(["", "", word()])) for _ in range(n))
    rows = []
    for i in range(90):
        lang = "de" if i % 3 else "en"
        rows.append((i, say(lang, random.randint(25, 160)), lang if i % 4 else None, ["a", "b", "c", None][i % 4]))
    rows += [(100 + i, rows[i][1] + " zusatz", "de", "b") for i in range(8)] + [(200 + i, rows[i][1].upper(), "de", "c") for i in range(3)] + [rows[5]]
    rows += [(300, None, "de", "a"), (301, "", "en", "b"), (302, "$$$ ### !!! " * 40, "de", "a"), (303, "zu kurz", "de", "a"), (304, "12 34 56 78 " * 30, None, "a"), (305, "eine zeile hier\n" * 40, "de", "a"), (306, say("en", 6000), "en", "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept, here = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, here, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, here = here, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = here.collect()
        if name != "packing":
            assert here.columns == before.columns and {tuple(r) for r in kept[name]} <= {tuple(r) for r in before.collect()}
    ids = lambda name: sorted(r.doc_id for r in kept[name])

    found = [plain_features(r[1]) for r in rows]
    good = plain_posteriors([plain_votes(f) for f in found])
    failed = [f["n_words"] < 20 or 100 * f["n_repeat_words"] > 30 * f["n_words"] for f in found]
    assert ids("quality_rules") == sorted(r[0] for r, bad, g in zip(rows, failed, good, strict=True) if not bad and g >= 0.5)

    stay = kept["quality_rules"]
    langs = sorted({r.lang for r in stay if r.lang})
    counts = {x: sum((language_id.counts(r.text) for r in stay if r.lang == x), np.zeros(language_id.BUCKETS)) for x in langs}
    logp = {x: np.log((c + 0.5) / (c.sum() + 0.5 * language_id.BUCKETS)) for x, c in counts.items()}
    odds = lambda t: sorted(language_id.counts(t) @ logp[x] for x in langs)
    assert ids("language") == sorted(r.doc_id for r in stay if regex.search(r"\p{L}", r.text) and 1 / sum(np.exp(o - odds(r.text)[-1]) for o in odds(r.text)) >= 0.5)

    stay = sorted({(r.doc_id, r.text) for r in kept["language"]})
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.encode().lower().split() for _, t in stay)]
    root = list(range(len(stay)))
    for _ in range(6):
        for x in range(len(stay)):
            for y in range(len(stay)):
                if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    root[x] = root[y] = min(root[x], root[y])
    assert ids("near_duplicates") == sorted(stay[i][0] for i in set(root)) and len(set(root)) < len(stay)

    hashes = {r.doc_id: r.h for r in spark.read.parquet(f"{tmp_path}/near_duplicates").select("doc_id", mixing.doc_hash().alias("h")).collect()}
    size = {r.doc_id: len(words(r.text)) for r in kept["near_duplicates"]}
    by_source = {}
    for r in kept["near_duplicates"]:
        by_source.setdefault(r.source, []).append(r.doc_id)
    names = sorted(by_source, key=lambda x: (x is None, x or ""))
    weight, total = {x: (5, 2, 1)[i % 3] for i, x in enumerate(names)}, {x: sum(size[i] for i in by_source[x]) for x in names}
    want, free, budget = {}, set(names), sum(total.values())
    while free:
        level = budget / sum(weight[x] for x in free)
        over = {x for x in free if weight[x] * level > 3 * total[x]}
        want |= {x: 3.0 * total[x] for x in over} or {x: weight[x] * level for x in free}
        budget -= sum(3 * total[x] for x in over)
        free = free - over if over else set()
    times = Counter(r.doc_id for r in kept["source_mix"])
    for x in names:
        copies = int(want[x] // total[x])
        rest, best, held = want[x] - copies * total[x], 0, 0
        order = sorted(by_source[x], key=hashes.get)
        options = [0] + [sum(size[i] for i in order[: k + 1]) for k in range(len(order))]
        best = min(range(len(options)), key=lambda k: (abs(options[k] - rest), k)) if copies < 3 else 0
        for k, i in enumerate(order):
            assert times[i] == copies + (k < best)

    tok = Tokenizer.from_file(packing.tokenizer_path())
    pieces, texts = Counter(), {r.doc_id: r.text for r in kept["source_mix"]}
    for i, n in times.items():
        own = tok.encode(texts[i], add_special_tokens=False).ids + [0]
        for k in range(0, len(own), 2048):
            pieces[i, k // 2048, k, len(own[k : k + 2048]), zlib.crc32(np.array(own[k : k + 2048], "<u4").tobytes())] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in kept["packing"]) == pieces
    sequences = {}
    for r in kept["packing"]:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048
    assert len(sequences) <= -(-sum(r.length for r in kept["packing"]) // 2048) + 1
