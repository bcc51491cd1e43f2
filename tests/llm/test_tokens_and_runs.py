"""op11 to op13 against the public libraries and brute force, and their defined results for odd inputs."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quire.llm import byte_bpe, periodic_runs, token_alignment

SF = "/root/testdata/sf0.001"
RANKS, LEVEL, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
PATTERN = public_tokenizers.PATTERN
ODD = ["", " ", "\x1c a\x1d\x85b  c    d", "a" * 5000, "ab" * 3000 + " " * 1000 + "\n\n x", "̈é ² ½ Ⅷ 𝒳 日本語 'S 's 'Re", "<|endoftext|> x<s></s>", "\x00\x01", "tab\tand\r\nlines\n", "▁ a▁b  ▁", "<0x41> 👩‍👩‍👧"]


def sha(data):
    return hashlib.sha256(data).hexdigest()


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()


# Byte-level BPE


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 3, 10, 1000):
        keys = [b"%d" % i for i in range(n)]
        h = byte_bpe.PerfectHash(keys)
        assert sorted(map(h.slot, keys)) == list(range(n))
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash([b"a", b"a"])


def test_bpe_as_the_library(spark, reference):
    rng = random.Random(3)
    texts = [*ODD, *("".join(rng.choice("abcdehinorst  ,.'\n0é日") for _ in range(rng.randint(0, 200))) for _ in range(300))]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (-1, None, None), (None, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids string").repartition(3)
    encoded = byte_bpe.encode(df, RANKS, PATTERN, ids="packed")
    assert encoded.columns == ["doc_id", "ids", "packed"]
    back = byte_bpe.decode(encoded.withColumn("again", F.col("packed")), RANKS, PATTERN, ids="again").collect()
    want = collections.Counter((i, tuple(reference.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, tuple(byte_bpe.unpacked(r.packed)), bytes(r.data)) for r in back) == want
    assert byte_bpe.encode(df.limit(0), RANKS, PATTERN).count() == 0


def test_bpe_memory_is_bounded(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    encoder = byte_bpe.Encoder(byte_bpe.ByteBpe(byte_bpe.read_ranks(RANKS), PATTERN))
    text = " ".join(f"wo{i % 17}rd" for i in range(200))
    assert byte_bpe.unpacked(encoder.encode(text)) == reference.encode_ordinary(text) and len(encoder) <= 5 and len(encoder.older) <= 5


def test_bpe_needs_all_bytes(tmp_path):
    (tmp_path / "v").write_bytes(b"YQ== 0\nYg== 1\n")
    with pytest.raises(ValueError):
        byte_bpe.ByteBpe(byte_bpe.read_ranks(tmp_path / "v"), PATTERN)


def test_op11(spark, reference):
    got = {r.doc_id: tuple(r) for r in __spark_entry__.queries()["op11_byte_bpe"](spark, SF).collect()}
    docs = documents(spark)
    assert len(got) == len(docs)
    for r in docs:
        ids = reference.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode()))


# Periodic runs


def brute_runs(w, least, times):
    """All runs by trying every period; those whose period is a multiple of a smaller one that holds are not of their smallest period."""
    w, found = np.asarray(w), []
    for p in range(1, len(w) // times + 1):
        step = np.diff(np.concatenate([[0], (w[:-p] == w[p:]).astype(np.int8), [0]]))
        found += [(int(s), int(e - s + p), p) for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)) if e - s + p >= max(least, times * p)]
    return sorted((x for x in found if not any(y[2] < x[2] and x[2] % y[2] == 0 and y[0] <= x[0] and y[0] + y[1] >= x[0] + x[1] for y in found)), key=lambda x: (x[0], x[2]))


def test_runs_by_brute_force():
    rng = np.random.default_rng(1)
    for it in range(400):
        sequences = []
        for _ in range(rng.integers(0, 6)):
            n = int(rng.integers(0, 60))
            w = rng.integers(0, rng.integers(1, 4), n)
            if n and rng.random() < 0.6:
                t, p = int(rng.integers(0, n)), 1 + int(rng.integers(0, 12))
                w[t:] = w[t + np.arange(n - t) % p]
            sequences.append(w)
        least, times = [(24, 3), (1, 2), (2, 2), (6, 3)][it % 4]
        words = np.concatenate([np.zeros(0, np.int64), *sequences]).astype(np.int64)
        got = periodic_runs.runs_of(words, np.array([len(s) for s in sequences], np.int64), least, times)
        assert [[tuple(x) for x in g.tolist()] for g in got] == [brute_runs(s, least, times) for s in sequences]


def test_runs_of_long_texts():
    n = 300_000
    assert periodic_runs.runs_of(np.zeros(n, np.int64), np.array([n]))[0].tolist() == [[0, n, 1]]
    period = np.random.default_rng(5).integers(0, 5000, 20_000)
    assert periodic_runs.runs_of(np.tile(period, 4), np.array([80_000]))[0].tolist() == [[0, 80_000, 20_000]]
    with pytest.raises(ValueError):
        periodic_runs.runs_of(period, np.array([len(period)]), 2, 1)


def test_runs_of_odd_rows(spark, monkeypatch):
    line = "one two three " * 9
    rows = [(1, line, "x"), (1, line, "x"), (2, None, None), (3, "", None), (4, " \t\n ", None), (5, "a a a " * 30, None), (None, "b " * 50 + "c", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, runs string")
    monkeypatch.setattr(periodic_runs, "BLOCK_WORDS", 40)
    out = periodic_runs.word_runs(df)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in out.collect())
    assert got == collections.Counter([
        (1, 27, ((0, 27, 3),), "one two three"), (1, 27, ((0, 27, 3),), "one two three"), (2, 0, (), ""), (3, 0, (), ""), (4, 0, (), ""),
        (5, 30, ((0, 30, 1),), "a a a"), (None, 51, ((0, 50, 1),), "b c")])
    assert periodic_runs.word_runs(df.limit(0)).count() == 0


def test_op12(spark):
    got = {r.doc_id: tuple(r) for r in __spark_entry__.queries()["op12_periodic_runs"](spark, SF).collect()}
    docs, some = documents(spark), 0
    assert len(got) == len(docs)
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        known: dict[str, int] = {}
        runs = brute_runs([known.setdefault(x, len(known)) for x in w], 24, 3)
        dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        shown = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want = (r.doc_id, len(runs), *shown, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()), sha(" ".join(x for i, x in enumerate(w) if i not in dropped).encode()))
        assert got[r.doc_id] == want
        some += bool(runs)
    assert some > 5


# Alignment


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(LEVEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def brute_alignment(tokenizers, texts, overlap=False):
    """Rows of n_a, n_b, n_groups, n_links, n_best, count_sum and groups, by walking both token sequences byte by byte."""
    a_model, b_model = tokenizers
    alphabet = token_alignment.byte_alphabet()
    a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in a_model.get_vocab().items() if t != "<|endoftext|>"}

    def b_bytes(i):
        p = b_model.id_to_piece(i)
        m = re.fullmatch("<0x(..)>", p)
        return bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()

    rows, counts = [], collections.Counter()
    for t in texts:
        raw, a, b = b" " + (t or "").encode(), a_model.encode(" " + (t or ""), add_special_tokens=False).ids, b_model.encode(t or "")
        if not t or b"".join(a_bytes[i] for i in a) != raw or b"".join(map(b_bytes, b)) != raw:
            rows.append(None)
            continue
        of_a, of_b = [k for k, i in enumerate(a) for _ in a_bytes[i]], [k for k, i in enumerate(b) for _ in b_bytes(i)]
        cuts = [x for x in range(len(raw)) if x + 1 == len(raw) or of_a[x] != of_a[x + 1] and of_b[x] != of_b[x + 1]]
        links = sorted({(of_a[x], of_b[x]) for x in range(len(raw))}) if overlap else [(of_a[x], of_b[x]) for x in cuts]
        links = [(a[i], b[j]) for i, j in links]
        counts.update(links)
        groups, start = [], 0
        for x in cuts:
            part = lambda ids, of: ",".join(str(ids[k]) for k in dict.fromkeys(of[start : x + 1]))  # noqa: E731, B023
            groups.append(part(a, of_a) + "|" + part(b, of_b))
            start = x + 1
        rows.append((len(a), len(b), links, groups))
    best = collections.Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = [(0, 0, 0, 0, 0, 0, "") if r is None else (r[0], r[1], len(r[3]), len(r[2]), sum(counts[x] == best[x[1]] for x in r[2]), sum(counts[x] for x in r[2]), ";".join(r[3])) for r in rows]
    return out, counts


def test_components_are_those_of_the_graph():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        u, v = rng.integers(0, n, (2, int(rng.integers(0, 30))))
        want = list(range(n))
        for _ in range(n):
            for x, y in zip(u.tolist(), v.tolist()):
                low = min(want[x], want[y])
                want = [low if w in (want[x], want[y]) else w for w in want]
        assert token_alignment.components(n, u, v).tolist() == want


@pytest.mark.parametrize("links", token_alignment.LINKS)
def test_alignment_by_brute_force(spark, tokenizers, links, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 300)
    monkeypatch.setattr(token_alignment, "PART_BYTES", 100)
    rng = random.Random(4)
    texts = [*ODD, None, *("".join(rng.choice("abcdehinorst  ,.'\n0é日▁") for _ in range(rng.randint(0, 60))) for _ in range(120)), "the same text", "the same text"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, n_a string").repartition(3)
    parts = token_alignment.aligned(df, LEVEL, PIECES, PATTERN, links=links, with_groups=True)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in token_alignment.link_scores(parts).collect()}
    want, counts = brute_alignment(tokenizers, texts, links == "overlap")
    assert [got[i] for i in range(len(texts))] == want and sum(w[0] == 0 for w in want) >= 3
    assert {(r.id_a, r.id_b): r["count"] for r in token_alignment.pair_counts(parts).collect()} == dict(counts)
    with pytest.raises(ValueError):
        token_alignment.align(np.array([1]), np.array([1]), "near")


def test_alignment_without_documents(spark):
    parts = token_alignment.aligned(spark.createDataFrame([(1, None), (None, "")], "doc_id int, text string"), LEVEL, PIECES, PATTERN)
    assert {(r.doc_id, r.n_a, r.count_sum, r.groups_sha256) for r in token_alignment.link_scores(parts).collect()} == {(1, 0, 0, ""), (None, 0, 0, "")}
    none = token_alignment.aligned(spark.createDataFrame([], "doc_id int, text string"), LEVEL, PIECES, PATTERN)
    assert token_alignment.link_scores(none).count() == 0


def test_op13(spark, tokenizers):
    docs = documents(spark)
    got = {r.doc_id: tuple(r) for r in __spark_entry__.queries()["op13_token_alignment"](spark, SF).collect()}
    want, _ = brute_alignment(tokenizers, [r.text for r in docs])
    assert len(got) == len(docs)
    for r, w in zip(docs, want):
        assert got[r.doc_id] == (r.doc_id, *w[:6], sha(w[6].encode()) if w[0] else "")
