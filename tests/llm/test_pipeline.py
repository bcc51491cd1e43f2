"""The corpus pipeline against a brute-force version on a small fixture."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from quire.llm import decontaminate, mixing, quality
from tests.llm.test_operators import brute_components, brute_print, shingle_set

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def cut(text, items, window=10):
    """The text without spans of words in 10-word windows of items, by regular expressions; None if they are most of it."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))]
    w = [x.decode() for x in decontaminate.words_of(text)]
    hit = set()
    for t in items:
        iw = [x.decode() for x in decontaminate.words_of(t)]
        size = min(window, len(iw))
        grams = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if iw else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in grams:
                hit.update(range(i, i + size))
    if len(hit) * 2 > len(w):
        return None
    out, at, i = "", 0, 0
    while i < len(w):
        if i not in hit:
            i += 1
            continue
        j = i
        while j in hit:
            j += 1
        out, at, i = out + text[at : words[i][0]], words[j - 1][1], j
    return out + text[at:]


def without_similar(texts, least=0.8):
    """Of each component of texts with that Jaccard similarity over five-word shingles, the smallest id."""
    sets = {d: shingle_set(t or "") for d, t in texts.items()}
    ids = sorted(texts)
    first = {d: d for d in ids}

    def find(d):
        while first[d] != d:
            d = first[d]
        return d

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common >= least * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                first[y] = x
    return {d: t for d, t in texts.items() if find(d) == d}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {d: t for d, t in texts.items() if model.score(quality.count_terms([(t or "").encode()]))[0] >= quality.THRESHOLD}
    groups = brute_components({d: brute_print(t) for d, t in texts.items()})
    texts = {d: t for d, t in texts.items() if groups[d] == d}
    texts = without_similar(texts)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {d: c for d, t in texts.items() if (c := cut(t, items)) is not None}
    left = spark.createDataFrame(sorted(texts.items()), "doc_id bigint, text string")
    labels = mixing.labelled_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    _, v, members = mixing.mix_rates(left, labels, corpus_pipeline.TARGETS, anchor="clean")
    rates = {r.doc_id: max(0.0, 1 + sum(a * b for a, b in zip(r.p, v))) for r in members.collect()}

    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in rows}.items() <= texts.items()
    copies = Counter(r.doc_id for r in rows)
    assert all(copies.get(d, 0) in (int(rate), int(rate) + 1, round(rate)) for d, rate in rates.items())
    expected = sum(rates.values())
    assert abs(len(rows) - expected) < 4 * len(rates) ** 0.5
    assert all(r.n_chars == len(r.text) for r in rows)
    by = defaultdict(list)
    for r in rows:
        assert r.size == len(r.text.encode()) + 1
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    bytes_ = [sum(r.size for r in v) for v in by.values()]
    assert len(by) == 16 and max(bytes_) - min(bytes_) <= 2 * max(r.size for r in rows)


def test_stages_keep_columns_and_edge_rows(spark):
    rows = [(1, None, "en", "s", None, 5), (None, "", "en", "s", 0, 5), (2, "calm words in a short text", None, None, 26, 5), (2, "calm words in a short text", None, None, 26, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            assert out.count() <= frame.count() * 3, name
            if name != "sharding":
                assert out.columns == docs.columns, name
