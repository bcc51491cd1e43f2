"""The dealt operators against brute force and on edge cases: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import chat_format, decontaminate, html_extract, jpeg, license_scan, media, mixing, quality, sharding, simhash_dedup, similar_texts, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, size bigint, score double, k string"  # extra columns whose names operators use inside
LONG = "word " * 60_000


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, 1, 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def random_text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


# 1: URL filters

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
URLS = [
    "http://a.Example.ORG/es/1?x", "https://example.org/en/12#t", "http://example.org", "http://x.org/q", "http://com/fr/", "http://notcom/fr/", "http://b.com/de/?a/fr/",
    "ftp://b.com?/fr/", None, "", "no scheme", "http://", "http:///fr/", "http://ÄB.com/fr/x://y", "http://example.org/es/" * 2000,
]


def judge(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, default))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("max_bits", [url_filter.MAX_FILTER_BITS, 8])
def test_url_filter(spark, max_bits):
    urls = URLS + URLS[:2]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id bigint, url string, key string")
    rules = spark.createDataFrame(RULES + RULES[:1], "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.url_filter(pages, rules, max_filter_bits=max_bits).collect()}
    assert got == {i: judge(u, RULES) for i, u in enumerate(urls)}
    assert url_filter.url_filter(pages.limit(0), rules, max_filter_bits=max_bits).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_cascade_is_exact_with_many_keys(spark):
    universe = spark.range(6000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id"))
    listed = universe.filter("id % 3 = 0").select("key")
    cascade = url_filter.build_cascade(listed, lambda level: universe.select("key").filter(level.contains(F.col("key"))), rate=0.3)
    assert len(cascade.levels) > 2
    wrong = universe.select("id", cascade.contains(F.col("key")).alias("c")).filter("c <> (id % 3 = 0)")
    assert wrong.count() == 0


def test_urls_without_a_host_have_no_rule(spark):
    rules = spark.createDataFrame([(f"h{i}.com", "/" + "x" * (i % 5), "block") for i in range(1000)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"file:///{i}/page") for i in range(3000)], "page_id bigint, url string")
    got = url_filter.url_filter(pages, rules)
    assert {(r.rule, r.verdict) for r in got.collect()} == {(None, "allow")}


@pytest.mark.parametrize("max_bits", [url_filter.MAX_FILTER_BITS, 8])
def test_rules_of_one_length_and_urls_without_a_host(spark, max_bits):
    rules = [("a.com", "/", "block"), ("com", "/ab", "allow"), ("b.com", "/x", "allow"), ("com", "/xyzz", "block"), *((f"h{i}.com", "/" + "x" * (i % 5), "block") for i in range(200))]
    urls = [f"file:///lt{i}" for i in range(20_000)] + ["http://a.com/ab", "http://b.com/xyzz", "http://h7.com/xx", *(f"http://h{i % 300}.com/{'x' * (i % 7)}{i}" for i in range(20_000))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), max_filter_bits=max_bits).collect()}
    by_key = {h + p: v for h, p, v in rules}

    def brute(url):
        host, path, *_ = judge(url, [])
        parts = host.split(".")
        fit = [k for n in range(len(parts)) for m in range(len(path) + 1) if (k := ".".join(parts[n:]) + path[:m]) in by_key]
        rule = min(fit, key=lambda k: (-len(k), k), default=None)
        return host, path, rule, by_key.get(rule, "allow")

    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert got[20_000][2:] == ("a.com/", "block")


# 2: media columns


def test_jpeg_round_trip_and_restart_free_colour():
    rng = np.random.default_rng(1)
    payloads = [bytes(64), b"\xff" * 640, b"\x80" * 64, *(rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 2, 7, 64, 200))]
    sparse = rng.integers(0, 256, 64 * 30, dtype=np.uint8)
    sparse[rng.random(len(sparse)) < 0.97] = 0
    payloads.append(sparse.tobytes())
    files = [(jpeg.parse(j), j) for j in jpeg.encode_payloads(payloads)]
    for p, (f, _), c in zip(payloads, files, jpeg.decode(files)):
        assert jpeg.payload_of(f, c) == p
        assert jpeg.thumbnail(f, c).shape == (f.height // 8, f.width // 8)


def colour_file(width, height, dc):
    """A 4:2:0 file without restart markers: DC only, from the given differences per component in scan order."""
    bits = ""
    for v in dc:
        size = abs(v).bit_length()
        code, length = int(jpeg.DC[2][size]), int(jpeg.DC[3][size])
        bits += format(code, f"0{length}b") + (format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else "")
        bits += format(int(jpeg.AC[2][0]), f"0{int(jpeg.AC[3][0])}b")
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = jpeg._segment
    return (b"\xff\xd8" + seg(0xDB, b"\x00" + b"\x08" + b"\x01" * 63) + seg(0xC0, bytes([8, height >> 8, height & 255, width >> 8, width & 255, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
            + seg(0xC4, b"\x00" + jpeg.DC[0] + jpeg.DC[1]) + seg(0xC4, b"\x10" + jpeg.AC[0] + jpeg.AC[1]) + seg(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + data + b"\xff\xd9")


def test_jpeg_colour_thumbnail():
    # two MCUs of 4 luminance blocks and 2 colour blocks: luminance DC sums to 10, 20, 30, 40 | 50, 60, 70, 80
    data = colour_file(32, 16, [10] * 4 + [1, -1] + [10] * 4 + [2, -2])
    f = jpeg.parse(data)
    (c,) = jpeg.decode([(f, data)])
    assert jpeg.thumbnail(f, c).tolist() == [[138, 148, 178, 188], [158, 168, 198, 208]]


def test_media_columns(spark):
    texts = ["", None, "a", "b" * 64, "é" * 33, "x\0y", LONG, "a"]
    stored = media.store_texts(docs_of(spark, texts))
    out = {r.doc_id: r for r in media.media_features(stored, with_payload=True).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        assert bytes(out[i].payload) == media.padded(data) and out[i].n_bytes == len(data)
    assert out[2].features == out[7].features and out[0].features == out[1].features
    damaged = spark.createDataFrame([(1, b"no jpeg"), (2, None), (3, jpeg.encode_payloads([bytes(64)])[0][:60])], "id int, media binary")
    assert [r.features for r in media.media_features(damaged).collect()] == [None] * 3
    assert media.store_texts(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_damaged_jpegs_have_no_features(spark):
    good = jpeg.encode_payloads([bytes(range(256))])[0]
    at = good.index(b"\xff\xc0")
    files = {
        "cut frame header": good[:at] + b"\xff\xc0\x00\x05\x08\x00\x08" + good[at + 13 :], "zero sampling": good[: at + 11] + b"\x00" + good[at + 12 :], "huge": good[: at + 5] + b"\xff\xff\xff\xff" + good[at + 9 :],
        "no tables": good.replace(b"\xff\xc4", b"\xff\xe1"), "wrong length": good.replace(b"payload-bytes=256", b"payload-bytes=-56"), "cut": good[:-40],
    }
    rng = random.Random(6)
    for k in range(300):
        x = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            x[rng.randrange(len(x))] = rng.randrange(256)
        files[f"random {k}"] = bytes(x[: rng.choice((len(x), rng.randrange(len(x))))])
    out = {r.k: r for r in media.media_features(spark.createDataFrame([*files.items(), ("good", good)], "k string, media binary"), with_payload=True).collect()}
    assert len(out) == len(files) + 1 and bytes(out["good"].payload) == bytes(range(256))
    for k in list(files)[:6]:
        assert out[k].features is None and out[k].features_error, k


def test_media_query_on_the_driver_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = media.op2_media_columns(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        stored = data + bytes(-len(data) % 64 or 64 * (not data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:]))


# 3: decontamination


def brute_hits(text, items, window):
    w = decontaminate.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        iw = decontaminate.words_of(t)
        size = min(window, len(iw))
        grams = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if iw else set()
        for i in range(len(w) - size + 1 if size else 0):
            if tuple(w[i : i + size]) in grams:
                hit.update(range(i, i + size))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark):
    rng = random.Random(3)
    for window in (1, 2, 4, 10):
        items = [(i, random_text(rng, "aà b9 C ddd".split(), rng.randint(0, 14))) for i in range(6)] + [(None, "z z z"), (9, None), (10, "!!")]
        texts = [random_text(rng, "aà b9 c ddd e z".split(), rng.randint(0, 60)) for _ in range(40)] + ["", None, "A.À b9", LONG, "z z z"]
        docs = docs_of(spark, texts + texts[:2])
        bench = spark.createDataFrame(items, "item_id bigint, text string")
        for max_words in (10, 10_000):
            got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(docs, bench, window, max_words=max_words).collect()}
            assert got == {i: brute_hits(t, items, window) for i, t in enumerate(texts + texts[:2])}
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_one_automaton_is_alive_at_a_time(spark, monkeypatch):
    import gc
    import weakref

    alive, most, build = [], [], decontaminate.build_index

    def counted(*args):
        gc.collect()
        most.append(sum(a() is not None for a in alive))
        index = build(*args)
        alive.append(weakref.ref(index))
        return index

    monkeypatch.setattr(decontaminate, "build_index", counted)
    bench = spark.createDataFrame([(i, f"w{i} x{i} y{i} z{i}") for i in range(5)], "item_id bigint, text string")
    docs = docs_of(spark, [f"so w{i} x{i} y{i} z{i} it is" for i in range(5)])
    assert sorted(tuple(r["items"]) for r in decontaminate.decontaminate(docs, bench, 4, max_words=4).collect()) == [(str(i),) for i in range(5)]
    assert len(most) == 5 and max(most) == 0


def test_decontamination_cuts_spans(spark):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id bigint, text string")
    docs = docs_of(spark, ["say: One, two three four! and many other words follow here", "one two three four", "clean", None, ""])
    got = [(r.clean, r.n_hit) for r in decontaminate.decontaminate(docs, bench, 4).orderBy("doc_id").collect()]
    assert got == [("say: ! and many other words follow here", 4), (None, 4), ("clean", 0), (None, 0), ("", 0)]


def test_automaton_lengths():
    rng = random.Random(5)
    for _ in range(200):
        items = [[rng.randrange(3) for _ in range(rng.randint(0, 10))] for _ in range(4)]
        a = decontaminate.Automaton()
        for i in items:
            a.add(i)
        grams = {tuple(i[x:y]) for i in items for x in range(len(i)) for y in range(x + 1, len(i) + 1)}
        text = [rng.randrange(4) for _ in range(30)]
        assert list(a.matches(text)) == [max((n for n in range(1, e + 1) if tuple(text[e - n : e]) in grams), default=0) for e in range(1, 31)]


# 4: quality


def test_quality(spark):
    rng = random.Random(7)
    good = [random_text(rng, "the of and river stone calm light".split(), rng.randint(5, 80)) + "." for _ in range(150)]
    bad = [random_text(rng, "BUY!! NOW!! $$$ | ### WIN!!".split(), rng.randint(5, 80)) for _ in range(150)]
    texts = good + bad + ["", None, LONG, LONG]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1 if i < 150 else 0, "x") for i in range(300)] + [(None, 1, "x"), (5, None, "x"), (99999, 1, "x")], "doc_id bigint, quality int, text string")
    model = quality.fit(docs, labels)
    learnt = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(300))
    assert len(model.labels) == learnt
    rows = {r.doc_id: r.s for r in quality.score(docs, model, out="s").collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((rows[i] >= quality.THRESHOLD) == (i < 150) for i in held)
    assert all(0 <= s <= 1 for s in rows.values()) and rows[300] == rows[301] and rows[302] == rows[303]
    assert len(quality.fit(docs, labels, fit_rows=20).labels) == 20
    empty = quality.fit(docs, labels.limit(0))
    assert {r.s for r in quality.score(docs, empty, out="s").collect()} == {0.5}
    assert quality.score(docs.limit(0), model, out="s").count() == 0


@pytest.mark.parametrize("text", ["", "a", "word and word. " * 300, "x" * 9000 + " y", "a\n\tb  c é " * 2000])
def test_block_size_changes_no_count(text):
    whole = quality.count_terms([text.encode()])
    for size in (5, 64, 1000):
        assert (quality.count_terms([text.encode()], size) == whole).all()


def test_terms_of_a_text_of_three_megabytes():
    rng = random.Random(17)
    text = random_text(rng, [f"wörd{i}" for i in range(3000)] + ["x\n"], 400_000).encode()
    assert len(text) > 3_000_000 and (quality.count_terms([text]) == quality.count_terms([text], len(text) + 1)).all()


def test_repeated_ids_are_learnt_once(spark):
    texts = [f"text number {i} of many" for i in range(100)]
    docs = docs_of(spark, texts * 32, list(range(100)) * 32)
    labels = spark.createDataFrame([(i, q) for i in range(100) for q in (1, i % 2)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels, fit_rows=40)
    once = quality.fit(docs_of(spark, texts), labels.groupBy("doc_id").agg(F.min("quality").alias("quality")), fit_rows=40)
    assert len(model.labels) == 40 and (model.labels == once.labels).all() and (model.vectors == once.vectors).all()


def test_quality_query_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in quality.op4_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    known = [(rows[r.doc_id], r.quality) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in known) and sum(r.predicted == q for r, q in known) >= 0.95 * len(known)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in rows.items())


def test_quality_vote_is_exact():
    rng = np.random.default_rng(2)
    z = rng.standard_normal((40, 4))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    model = quality.Model(np.ones(quality.TERMS), rng.standard_normal((quality.TERMS, 4)), z, (np.arange(40) % 3 > 0).astype(float))
    counts = rng.integers(0, 3, (7, quality.TERMS)).astype(np.float32)
    q = model.project(counts)
    for i in range(7):
        cosine = z @ q[i]
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        w = np.exp(quality.SHARPNESS * (cosine - cosine.max())) * model.lift
        vote = lambda at: (w[at] * model.labels[at]).sum() / w[at].sum()
        assert model.score(counts, block=3)[i] == pytest.approx(0.9 * vote(near) + 0.1 * vote(np.arange(40)))


# 5: mixing


def test_rates_solve_the_constrained_least_squares(spark):
    rng = np.random.default_rng(4)
    n = rng.integers(1, 200, 300)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens bigint, p array<double>")
    target = np.array([0.8, 0.15, 0.05])
    v, info = mixing.fit_rates(members, target)
    r = np.maximum(0, 1 + p @ np.array(v))
    assert np.allclose((r * n) @ p / n.sum(), target, atol=1e-6) and info["residual"] < 1e-6
    # nearest to 1 among all exact rates: projected gradient on the primal, from 1, ends there too
    x, a = np.sqrt(n), (p * np.sqrt(n)[:, None]).T / n.sum()
    x0, step = x.copy(), 1 / np.linalg.norm(a, 2) ** 2
    lam = np.zeros(3)
    for _ in range(200_000):
        x = np.maximum(0, x0 - a.T @ lam)
        lam += step * (a @ x - target)
        if np.abs(a @ x - target).max() < 1e-10:
            break
    assert np.allclose(r, x / np.sqrt(n), atol=1e-4)
    assert mixing.fit_rates(members.limit(0), target)[0] == [0.0] * 3


def test_mixing(spark):
    rng = random.Random(8)
    texts = [random_text(rng, "calm river stone".split(), 20) if i % 2 else random_text(rng, "calm river moron idiot".split(), 20) for i in range(400)] + ["", None, LONG]
    docs = docs_of(spark, texts)
    labelled = spark.createDataFrame([(i, "clean" if i % 2 else "toxic") for i in range(300)], "doc_id bigint, domain string")
    out = {r.doc_id: r for r in mixing.mix(docs, labelled, {"clean": 0.9, "toxic": 0.1}).collect()}
    assert all(out[i].p[1] < 0.2 if i % 2 else out[i].p[1] > 0.8 for i in range(400))
    total = sum(r.n_tokens for r in out.values())
    assert sum(r.rate * r.n_tokens * r.p[0] for r in out.values()) / total == pytest.approx(0.9, abs=1e-5)
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in out.values())
    assert out[400].n_tokens == out[401].n_tokens == 0 and out[400].p == out[401].p
    again = mixing.resample(docs, labelled, {"clean": 0.9, "toxic": 0.1})
    assert again.columns == docs.columns
    count = Counter(r.doc_id for r in again.collect())
    assert {i: count.get(i, 0) for i in out} == {i: r.copies for i, r in out.items()}
    assert mixing.mix(docs, labelled.limit(0), {"clean": 0.9, "toxic": 0.1}).count() == len(texts)
    assert mixing.mix(docs.limit(0), labelled, {"clean": 0.9, "toxic": 0.1}).count() == 0


def test_targets_out_of_reach(spark):
    docs = docs_of(spark, [f"calm river stone {i}" for i in range(200)] * 2, list(range(200)) * 2)
    labelled = spark.createDataFrame([(i, "clean") for i in range(100)] * 2, "doc_id bigint, domain string")
    targets = {"clean": 0.1, "toxic": 0.9}
    with pytest.raises(ValueError, match="not reached"):
        mixing.mix(docs, labelled, targets, strict=True)
    rates = [r.rate for r in mixing.mix(docs, labelled, targets).collect()]
    assert len(rates) == 400 and 0 <= min(rates) <= max(rates) <= mixing.MAX_RATE
    assert mixing.resample(docs, labelled, targets).count() <= 400 * (mixing.MAX_RATE + 1)


def test_mixing_query_meets_its_targets(spark):
    rows = mixing.op5_source_mixing(spark, "/root/testdata/sf0.01").collect()
    total = sum(r.n_tokens for r in rows)
    assert len(rows) == 1000 and all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    for d, share in mixing.TARGETS.items():
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) / total == pytest.approx(share, abs=1e-5)


# 6: SimHash


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    first = {}
    values = sorted(set(prints.values()))
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    for d in sorted(prints):
        first.setdefault(find(prints[d]), d)
    return {d: first[find(p)] for d, p in prints.items()}


def test_fingerprints_and_components(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = [random_text(rng, words, 120) for _ in range(30)]
    texts = base + [b.upper() for b in base[:5]] + [b + " tail" for b in base] + ["", None, " \t\n\x0b", "a", "A b", "\u00a0x", LONG, LONG]
    texts += [" ".join(w if rng.random() > 0.01 else "new" for w in b.split()) for b in base * 3]
    out = {r.doc_id: r for r in simhash_dedup.near_duplicates(docs_of(spark, texts)).collect()}
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    assert {i: r.fp & (1 << 64) - 1 for i, r in out.items()} == prints
    assert {i: r.component_id for i, r in out.items()} == brute_components(prints)
    assert simhash_dedup.near_duplicates(docs_of(spark, ["a"]).limit(0)).count() == 0
    nulls = simhash_dedup.near_duplicates(docs_of(spark, ["a", "a", "b"], [None, 7, None])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in nulls if r.component_id) == [(False, 7), (True, 7)]


@pytest.mark.parametrize("max_posting", [2, 64])
def test_links_keep_components(spark, max_posting):
    rng = random.Random(10)
    values = set()
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(25):
            values.add(v)
            v ^= rng.choice([1 << rng.randrange(64), (1 << rng.randrange(64)) | (1 << rng.randrange(64)), rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)])
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash_dedup.links(spark.createDataFrame(signed, "fp bigint"), max_posting)
    comp = {r.node: r.root for r in simhash_dedup.components(edges).collect()}
    groups = defaultdict(set)
    for (v,) in signed:
        groups[comp.get(v, v)].add(v & (1 << 64) - 1)
    want = defaultdict(set)
    for d, c in brute_components({v: v for v in values}).items():
        want[c].add(d)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_keep_one(spark):
    rows = docs_of(spark, ["a b c", "a b c", None, "", "other text here", "a b c", "a b c"], [3, 2, 9, 8, 5, None, 2])
    kept = simhash_dedup.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 8]


def test_keep_one_of_rows_that_differ_in_other_columns(spark):
    rows = spark.createDataFrame([(1, "same text of words", k) for k in "abc"] * 2, "doc_id bigint, text string, h string")
    got = [simhash_dedup.keep_one(x).collect() for x in (rows, rows.orderBy(F.desc("h")))]
    assert got[0] == got[1] and len(got[0]) == 1


def shingle_set(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def test_shingle_blocks():
    texts = ["", "a", "A b  c", "a b c d e", "a b c d e f\x0ba b c d e", "é\u00a0x y z w v u " * 40, LONG]
    hashes, at = similar_texts.shingle_block([t.encode() for t in texts])
    found = [set(hashes[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    assert [len(x) for x in found] == [len(shingle_set(t)) for t in texts]
    for i, t in enumerate(texts):
        assert found[i] == set(similar_texts.shingle_hashes(t).tolist())
        for j, u in enumerate(texts):
            assert len(found[i] & found[j]) == len(shingle_set(t) & shingle_set(u))
    assert (similar_texts.band_block(hashes, at)[4] == similar_texts.band_block(*similar_texts.shingle_block([texts[4].encode()]))[0]).all()


def near_copy(rng, text, edits):
    w = text.split()
    for i in rng.sample(range(len(w)), edits):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


SIZES = [{}, {"max_posting": 3, "max_work": 10_000}, {"max_posting": 3, "max_whole": 8, "max_work": 1}]


@pytest.mark.parametrize("sizes", SIZES)
def test_similar_links(spark, sizes):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(25):
        base = random_text(rng, words, 150)
        texts += [base, *(near_copy(rng, base, e) for e in (1, 2, 3, 8, 20))]
    base = random_text(rng, words, 150)  # a cluster that is beyond max_work beside those that are not
    texts += ["", "a b", "short text of few words here", base, *(near_copy(rng, base, 2) for _ in range(40))]
    got, want = similar_groups(spark, texts, **sizes)
    assert got == want and 40 < len(want) < len(texts)


def similar_groups(spark, texts, brute=True, **sizes):
    """The components of similar_links, as sorted lists of places; and, if brute, those of all pairs at 0.8."""
    rows = spark.createDataFrame(list(enumerate(texts)), "h bigint, __text string")
    found = similar_texts.similar_links(similar_texts.text_bands(rows), lambda wanted: similar_texts.text_sets(rows.join(wanted, "h")), **sizes)
    sets = [shingle_set(t) for t in texts]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    every = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if near(sets[i], sets[j])] if brute else []
    out = []
    for edges in ([(r.a, r.b) for r in found.collect()], every):
        lab = list(range(len(texts)))
        for a, b in edges:
            x, y = lab[a], lab[b]
            lab = [x if v == y else v for v in lab] if x != y else lab
        groups = defaultdict(list)
        for i, v in enumerate(lab):
            groups[v].append(i)
        out.append(sorted(groups.values()))
    return out if brute else out[0]


def test_large_hub_group_is_one_component(spark):
    rng = random.Random(21)
    base = random_text(rng, [f"w{i}" for i in range(5000)], 200)
    texts = [near_copy(rng, base, 3) for _ in range(1050)]
    texts.insert(700, base)
    got, want = similar_groups(spark, texts, max_work=10_000)
    assert got == want == [list(range(1051))] and similar_groups(spark, texts, brute=False) == got


def test_long_postings_keep_components(spark):
    rng = random.Random(22)
    words = [f"w{i}" for i in range(5000)]
    base = random_text(rng, words, 200)
    texts = []
    for _ in range(12):  # chains and hubs around relatives of one text: several components in the same long postings
        hub = near_copy(rng, base, 5)
        texts += [hub, *(near_copy(rng, hub, 3) for _ in range(12))]
        for _ in range(6):
            texts.append(near_copy(rng, texts[-1], 3))
    for sizes in SIZES:
        got, want = similar_groups(spark, texts, **sizes)
        assert got == want and len(want) > 1, sizes


def test_keep_one_of_similar_texts(spark):
    rng = random.Random(14)
    base = random_text(rng, [f"w{i}" for i in range(300)], 200)
    texts = [near_copy(rng, base, 2), base, near_copy(rng, base, 3), random_text(rng, ["x", "y", "z"], 50), near_copy(rng, base, 60)]
    kept = sorted(r.doc_id for r in simhash_dedup.keep_one(docs_of(spark, texts, [9, 4, 6, 7, 8])).collect())
    assert kept == [4, 7, 8]
    assert simhash_dedup.keep_one(docs_of(spark, texts).limit(0)).count() == 0


def test_links_of_a_removed_text_count(spark):
    rng = random.Random(31)
    base = random_text(rng, [f"w{i}" for i in range(5000)], 400)
    fp = simhash_dedup.fingerprint
    near = next(c for c in (near_copy(rng, base, 1) for _ in range(20_000)) if (fp(c) ^ fp(base)).bit_count() <= 2)
    far = (near_copy(rng, base, 8) for _ in range(1000))
    texts = [x for x in far if jaccard(x, base) >= 0.8 > jaccard(x, near) and (fp(x) ^ fp(near)).bit_count() > 2][:5]
    docs = docs_of(spark, [base, near, *texts], [10, 5, *range(20, 20 + len(texts))])
    assert len(texts) == 5 and [r.doc_id for r in simhash_dedup.keep_one(docs).collect()] == [5]


# 7: HTML


PAGE = "<html><body><div class='top x{i}'>Shared banner</div><div><p>Menu one</p></div><div><h2>Title {i}</h2><p>Body text {i} &amp; more</p></div><div>Copyright line</div></body></html>"


def test_html_templates(spark):
    pages = [(i, f"http://h.com/{i}", PAGE.replace("{i}", str(i)), "h") for i in range(6)] + [(100, None, None, "h"), (101, "x", "", "h"), (102, "http://o.com/", PAGE.replace("{i}", "9"), "h")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, host string")
    for most in (0, 1000):
        out = {r.page_id: r.text for r in html_extract.extract(df, max_broadcast=most).collect()}
        assert out == {**{i: f"Title {i} Body text {i} & more" for i in range(6)}, 100: "", 101: "", 102: "Shared banner Menu one Title 9 Body text 9 & more Copyright line"}
    assert html_extract.extract(df.limit(0)).count() == 0


def test_templates_decide(spark):
    pages = spark.createDataFrame([(i, f"http://h.com/{i}", PAGE.replace("{i}", str(i))) for i in range(6)], "page_id bigint, url string, html string")
    with_, without = ({r.page_id: r.text for r in html_extract.extract(pages, min_pages=n).collect()} for n in (3, 7))
    assert with_ == {i: f"Title {i} Body text {i} & more" for i in range(6)}
    assert without == {i: f"Shared banner Menu one Title {i} Body text {i} & more Copyright line" for i in range(6)}


def test_template_counts(spark):
    rng = random.Random(19)
    part = lambda: f"<div class='c{rng.randrange(9)}'><p>{rng.choice('abcd')}</p><ul><li>{rng.choice('xyz')}</ul></div>"
    rows = [(f"http://h{i % 3}.com/", "<nav>" + rng.choice("mn") + "</nav>" + part() + part() + f"<p>page {rng.randrange(30)}</p>") for i in range(120)]
    got = {(r.host, r.h) for r in html_extract.host_templates(spark.createDataFrame(rows, "url string, html string"), min_pages=4, min_share=0.2).collect()}
    texts, pages = defaultdict(set), defaultdict(set)
    for url, page in rows:
        host, (hashes, text) = url[7:-1], html_extract.page_hashes(page)
        texts[host].add(text)
        for h in hashes:
            pages[host, h].add(text)
    want = {(host, html_extract._signed(h)) for (host, h), of in pages.items() if len(of) >= max(4, 0.2 * len(texts[host]))}
    assert got == want and want


@pytest.mark.parametrize("page, text", [
    ("x<a " * 100_000, "x"), ("x<a b=\"" * 100_000, "x"), ("<b>" * 100_000 + "x" + "</i>" * 100_000, "x"), ("<i><div>" + "<b>" * 100_000 + "x" + "</i>" * 100_000, "x"), ("x<!--" * 200_000, "x"), ("<div>" * 200_000 + "x", "x"),
    ("<p title='a>b'>x<a href=\"y>z</a> w</p>", "xz w"), ("<p>a < b <3 c</p>", "a < b <3 c"),
], ids=range(8))
def test_malformed_pages_are_read_in_one_pass(page, text):
    began = time.time()
    assert html_extract.main_text(page) == text and time.time() - began < 20


@pytest.mark.parametrize("page, text", [
    ("<article><h1>A</h1><p>b <b>c</b>d<p>e<br>f<ul><li>1<li>2</ul></article><footer>x</footer>", "A b cd e f 1 2"),
    ("<nav>n</nav><header>h</header><main>m<aside>a</aside><form>f</form><script>if (a<b) '</p>'</script><style>s</style></main>", "m"),
    ("<article>t<div class=comments><article>c</article></div><div id='cookie-notice'>k</div><section class='has-sidebar'>s</section></article>", "t s"),
    ("<body><div role='navigation'>r</div><div class='Cookie-Notice'>c</div><article>t<div class='adsbygoogle'>a</div><p>u</p><section id='comments'><p>x</p></section></article><div class='sidebar'>s</div></body>", "t u"),
    ("<div hidden>h</div><div style='display: none'>d</div><noscript>n</noscript><template>t</template><p>p</p><select><option>o</select><button>b</button>", "p"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table><pre>x\n  y</pre><blockquote>q</blockquote><h2>h</h2></article>", "a b c x y q h"),
    ("<article>a &lt;b&gt; &#233;&eacute; &am &amp", "a <b> éé &am &"),
    ("plain\n\n text &nbsp; x", "plain text x"), ("", ""), ("<p", ""), ("<!-- <p>x</p> -->y", "y"), ("<div>a<div>b</div>c", "a b c"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
])
def test_html_text(page, text):
    assert html_extract.main_text(page) == text


def test_repeated_article_paragraphs_stay(spark):
    page = "<nav>m</nav><article><h1>T</h1><p>Same paragraph</p></article>"
    df = spark.createDataFrame([(i, "http://h.com/", page) for i in range(20)], "page_id bigint, url string, html string")
    assert {r.text for r in html_extract.extract(df).collect()} == {"T Same paragraph"}


@pytest.mark.parametrize("page, text", [
    ("<article><div><p>text</p></div><ul><li>a</ul></article>", "text a"),
    ("<div><p>Long body of the page</p></div><p>more</p>", "Long body of the page more"),
])
def test_copies_of_a_page_are_no_template(spark, page, text):
    others = [f"<div><p>Other page {i}</p></div>" for i in range(5)]
    rows = [(i, f"http://h.com/?q={i}", page if i < 20 else others[i - 20]) for i in range(25)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for most in (0, 1000):
        out = {r.page_id: r.text for r in html_extract.extract(df, max_broadcast=most).collect()}
        assert out == {i: text if i < 20 else f"Other page {i - 20}" for i in range(25)}


@pytest.mark.parametrize("page", ["<article><div><p>First part</p></div><div><p>Second part</p></div><i>{i}</i></article>", "<div><p>First part</p><p>Second part</p></div><p>{i}</p>"])
def test_most_of_an_article_is_no_template(spark, page):
    df = spark.createDataFrame([(i, "http://h.com/", page.replace("{i}", str(i))) for i in range(8)], "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == {i: f"First part Second part {i}" for i in range(8)}


@pytest.mark.parametrize("page, text", [
    ("<div class='content-sidebar-wrap'><article><p>main text</p></article></div>", "main text"),
    ("<div id='layout-sidebar-right'><main>m<div class='sidebar'>s</div></main></div>", "m"),
    ("<div class='sidebar'><article>whole text of the page</article></div><p>x</p>", "whole text of the page"),
    ("<div class='sidebar'><article>teaser</article></div><p>the longer text of the page</p>", "the longer text of the page"),
    ("<article>t<div class='ad-hoc'>a</div><p class='search-results'>r</p><div class='ad-container'>c</div><div class='top-ad'>d</div><ul class='share-links'>l</ul></article>", "t a r"),
])
def test_names_of_wrappers(page, text):
    assert html_extract.main_text(page) == text


def test_template_inside_a_named_wrapper(spark):
    page = "<div class='sidebar'><article><div>Share this</div><p>Text number {i} of the site</p></article></div>"
    df = spark.createDataFrame([(i, "http://h.com/", page.replace("{i}", str(i))) for i in range(8)], "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == {i: f"Text number {i} of the site" for i in range(8)}


def test_template_of_a_part_of_a_large_host(spark):
    rows = [(i, f"http://h.com/{i}", f"<div>Section notice</div><p>Body {i} of a page</p>" if i < 110 else f"<p>Text {i}</p>") for i in range(6000)]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert {out[i] for i in range(110)} == {f"Body {i} of a page" for i in range(110)}


@pytest.mark.parametrize("page, text", [
    ("<article><h1>T</h1><p>Intro text.</p><section id='discussion'><p>Main finding</p></section></article>", "T Intro text. Main finding"),
    ("<article>t<p class='privacy'>p</p><section class='chapter alert'>c</section><div class='panel-discussion'>d</div><i>x <span class='search'>s</span></i></article>", "t p c d x s"),
    ("<article><p>first text</p></article><div>between</div><article><p>second</p></article><article class='comment'>c</article>", "first text second"),
    ("<div>" * 600 + "<nav>MENU</nav>text", "text"),
    ("<div><span>" * 600 + "<nav>MENU</nav><p>text" + "</span></div>" * 600 + "<nav>m</nav>", "text"),
])
def test_parts_of_articles_and_depth(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("part", ["<div>", "<main>", "<div class='notice'>", "<b>", "<li>", "<ul><li>"])
def test_any_depth_takes_one_pass(part):
    began = time.time()
    assert html_extract.main_text(part * 100_000 + "t" + "</p></i></q>" * 100_000) in ("t", "")
    assert time.time() - began < 30


def test_structure_that_recurs_in_articles(spark):
    """A notice in an article goes where its structure recurs on the host, whatever its text; a discussion with a heading is text."""
    page = "<article><p>Body {i}</p><div class='notice'><b>N{i}</b></div><div class='discussion'><h2>D</h2><p>found {i}</p></div></article>"
    rows = [(i, f"http://{'h' if i < 6 else i}.com/", page.replace("{i}", str(i))) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for most in (0, 1000):
        out = {r.page_id: r.text for r in html_extract.extract(df, max_broadcast=most).collect()}
        assert out == {i: f"Body {i} D found {i}" if i < 6 else f"Body {i} N{i} D found {i}" for i in range(8)}
    without = {r.page_id: r.text for r in html_extract.extract(df, min_pages=100).collect()}
    assert without == {i: f"Body {i} N{i} D found {i}" for i in range(8)}


class ArticleText(HTMLParser):
    """Another reader of the same pages: everything inside article elements, with white space at block tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.parts += [" "] * (tag in html_extract.BLOCK)

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.parts += [" "] * (tag in html_extract.BLOCK)

    def handle_data(self, data):
        self.parts += [data] * (self.depth > 0)


def test_extracted_pages_by_another_parser(spark):
    got = {r.page_id: r for r in html_extract.op7_html_extraction(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        reader = ArticleText()
        reader.feed(r.html or "")
        reader.close()
        want = " ".join("".join(reader.parts).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


# 8: sharding


def check_shards(rows, texts, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    sizes = [len((t or "").encode()) + 1 for t in texts]
    assert sorted(r["size"] for r in rows) == sorted(sizes)
    got = [sum(r["size"] for r in by.get(s, ())) for s in range(shards)]
    assert max(got) - min(got) <= 2 * max(sizes)
    assert sorted(r.text_crc32 for r in rows) == sorted(zlib.crc32((t or "").encode()) for t in texts)


def test_sharding(spark):
    rng = random.Random(11)
    texts = [rng.choice("abcé") * rng.randint(0, 300) for _ in range(900)] + ["hot text"] * 600 + [None, "", ""]
    ids = [None if i % 50 == 0 else i // 2 for i in range(len(texts))]
    docs = docs_of(spark, texts, ids)
    rows = sharding.shard_by_bytes(docs).collect()
    check_shards(rows, texts, 16)
    wide = sharding.shard_by_bytes(docs, keep=("text", "k")).collect()
    check_shards(wide, texts, 16)
    assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in wide) == Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in rows)
    assert Counter((r.doc_id, zlib.crc32((r.text or "").encode()), r.k) for r in wide) == Counter((i, zlib.crc32((t or "").encode()), "x") for i, t in zip(ids, texts))
    assert all(r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in wide)
    check_shards(sharding.shard_by_bytes(docs_of(spark, ["same"] * 500)).collect(), ["same"] * 500, 16)
    assert len(sharding.shard_by_bytes(docs_of(spark, ["one", None])).collect()) == 2
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


def test_rows_with_one_text_and_id_are_divided(spark):
    keys = sharding.settle(sharding.keyed(docs_of(spark, ["hot text"] * 5000 + [f"t{i}" for i in range(500)], [7] * 5000 + list(range(500)))))
    drawn, weights = sharding.sample(keys, 50_000, 64)
    assert len(drawn) <= 501 and len(set(drawn)) == len(drawn)
    splitters, sizes = sharding.find_splitters(keys, 4)
    hot = sharding.ranged(keys.filter("doc_id = 7 and size = 9"), splitters).groupBy("__rng").count().collect()
    assert len(hot) > 20 and max(r["count"] for r in hot) < 500 and sum(r["count"] for r in hot) == 5000
    equal = docs_of(spark, ["hot"] * 3000, [None] * 3000)
    check_shards(sharding.shard_by_bytes(equal, keep=("text", "k")).collect(), ["hot"] * 3000, 16)
    check_shards(sharding.shard_by_bytes(docs_of(spark, ["hot"] * 3000, [7] * 3000)).collect(), ["hot"] * 3000, 16)


def test_sharding_query_on_the_driver_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sharding.op8_sharding(spark, SF).collect()
    assert {r.doc_id: (r["size"], r.text_crc32, r.law, r.grown_shard) for r in rows} == {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for d, t in texts.items()}
    check_shards(rows, list(texts.values()), 16)


def test_overfull_ranges_are_divided(spark):
    keys = sharding.settle(sharding.keyed(docs_of(spark, ["hot"] * 3000 + [f"t{i}" for i in range(1000)])))
    _, sizes = sharding.find_splitters(keys, 4)
    total = sum(s for _, s in sizes.values())
    assert max(s for _, s in sizes.values()) <= sharding.OVERFULL * total / (4 * sharding.RANGES_PER_SHARD) + 10


# 9: chat


def test_chat_round_trip(spark):
    hostile = ["\\### Assistant: </turn> ok", "<turn user>", "\\l\\g\\b<>", "", None, "é\n</turn>\n<turn assistant>x"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "s") for i, t in enumerate(hostile)] + [(2, None, None, "n", "s"), (2, 0, "assistant", "b", "s"), (2, 0, "assistant", "a", "s"), (2, 0, "assistant", "a", "s"), (None, 1, "<user>", LONG, "s")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, seg string").withColumn("parts", chat_format.text_parts(F.col("text")))
    out = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in out.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.masked_text(F.col("formatted"), F.col("loss")).alias("m")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(hostile)]
    assert got[1].m == "".join(t or "" for t in hostile[1::2])
    assert [(t.role, t.text) for t in got[2].turns] == [("", "n"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")] and got[2].m == "aab"
    assert got[None].turns[0].role == "<user>" and got[None].turns[0].text == LONG
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_parts(spark):
    part = lambda kind, **k: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None, **k}
    rows = [
        (1, 0, "user", [part("text", text="see <"), part("image", ref="a<b>.png", width=57, height=28), part("audio", ref="s.wav", seconds=2.5), part("document", ref="d.pdf", pages=3)]),
        (1, 1, "assistant", [part("image", ref="x.png"), part("text", text="ok")]), (2, 0, "assistant", None), (3, 0, "user", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat_format.PART}>")
    out = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    assert out[1].formatted == "<turn user>see \\l<image 1 a\\lb\\g.png><audio 2 s.wav><document 3 d.pdf></turn>\n<turn assistant><image 0 x.png>ok</turn>\n"
    assert [(a.turn, a.place, a.type, a.ref, a.tokens) for a in out[1].attachments] == [(0, 1, "image", "a<b>.png", 3), (0, 2, "audio", "s.wav", 63), (0, 3, "document", "d.pdf", 1536), (1, 0, "image", "x.png", 256)]
    assert out[1].attachment_tokens == 3 + 63 + 1536 + 256
    assert out[2].formatted == "<turn assistant></turn>\n" and out[3].attachments == []


# 10: licences


def dice(a, b):
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))


def brute_licenses(text, threshold=license_scan.THRESHOLD):
    normal = [" ".join(re.findall("[a-z0-9]+", x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))) for x in (text or "").split("\n")]
    units = {*normal, " ".join(x for x in normal if x)} | {" ".join(b.split()) for b in re.split("\n\n+", "\n".join(normal))}
    found, n = [], 0
    for u in units:
        own = license_scan.bigram_counts(u)
        hits = [(dice(own, license_scan.bigram_counts(t)), name) for name, ts in license_scan.TEMPLATES.items() for t in ts if own]
        hits = [h for h in hits if h[0] >= threshold]
        found += hits
        n += bool(hits)
    words = " ".join(x for x in normal if x).split()
    grams, windows = [f"{a} {b}" for a, b in zip(words, words[1:])], 0
    for name, ts in license_scan.TEMPLATES.items():
        for t in ts:
            of = license_scan.bigram_counts(t)
            m = sum(of.values())
            every = range(len(grams) - m + 1) if not of.keys().isdisjoint(grams) else ()
            hits = [(d, name) for i in every if (d := dice(Counter(grams[i : i + m]), of)) >= threshold]
            found += hits
            windows += bool(hits)
    best = max((d for d, _ in found), default=None)
    return n, windows, sorted({name for _, name in found}), min((name for d, name in found if d == best), default=None), best


def test_license_scan(spark):
    rng = random.Random(12)
    texts = ["", None, LONG, "no licence here", "Released under the MIT License.", "RELEASED!! UNDER!! THE!! MIT!! LICENSE!!\nfoo", "the license the license the license"]
    for ts in license_scan.TEMPLATES.values():
        for t in ts:
            words = t.split()
            texts += [t, "intro line\n" + t + "\noutro", "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)), "x\n\n" + t.replace(" ", "\n", 5) + "\n\ny"]
            for rate in (0.05, 0.1, 0.2, 0.4):
                texts.append(" ".join(w if rng.random() > rate else "zzz" for w in words))
            texts.append(" ".join(words + words[:6]))
    docs = docs_of(spark, texts + texts[:8])
    got = {r.doc_id: (r.n_units, len(r.windows), r.licenses, r.best_license, r.best_dice) for r in license_scan.scan_licenses(docs).collect()}
    want = {i: brute_licenses(t) for i, t in enumerate(texts + texts[:8])}
    assert got == want and sum(w[0] > 0 for w in want.values()) > 30
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def test_notices_inside_other_text(spark):
    """A header in three paragraphs above code, a notice inside a sentence, two notices in one text, one at its very end."""
    mit, isc = license_scan.TEMPLATES["MIT"][1], license_scan.TEMPLATES["ISC"][0]
    header = "\n".join("# " + x for x in mit.replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS").split("\n"))
    code = "\n".join(f"    value_{i} = call(value_{i - 1}, {i})" for i in range(120))
    texts = [
        f"# Copyright (c) 2020 A. Person\n#\n{header}\n\nimport x\n{code}", "Written by A. Person and many contributors. Released under the MIT License. See the site.",
        f"{code} {mit} {code} {isc}", code,
    ] + [f"{code}\n/* {t} */\n{code}" for ts in license_scan.TEMPLATES.values() for t in ts]
    rows = {r.doc_id: r for r in license_scan.scan_licenses(docs_of(spark, texts)).collect()}
    assert [rows[i].licenses for i in range(4)] == [["MIT"], ["MIT"], ["ISC", "MIT"], []]
    assert rows[1].windows[0].asDict() == {"name": "MIT", "start": 7, "dice": 1.0} and [w.dice for w in rows[2].windows] == [1.0, 1.0]
    names = [name for name, ts in license_scan.TEMPLATES.items() for _ in ts]
    assert all(name in rows[i + 4].licenses and rows[i + 4].best_dice == 1.0 for i, name in enumerate(names))


def test_items_digest():
    assert decontaminate.items_digest(["10", "9"]) == hashlib.sha256(b"10,9").hexdigest()
