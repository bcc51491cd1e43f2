"""Mixing sources to target weights by soft membership.

1. A softmax regression on the presence of hashed words and word endings learns domains from a labelled table.
2. Every document gets domain posteriors p and its number of tokens n.
3. Nonnegative document rates r solve  min |A r - T|^2  from the base rate 1, where (A r)_k = sum of r n p_k over all documents is
   the expected number of tokens of domain k and T the target. The iteration is projected gradient with a preconditioner, in
   lazy form: steps add up in a vector v of one number per domain, and the rate of a document is the projection
   min(MAX_RATE, max(0, 1 + p . v)). So the state is v alone, each step is one distributed sum of K + K (K + 1) / 2 numbers, and nothing per
   document is stored or lost with an executor. Among all exact rates it ends at those nearest to 1 in the token-weighted norm.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import settle, unit_hash

LOG = logging.getLogger(__name__)

BUCKETS = 8192
#: Bound of the labelled sample on which the classifier is fitted.
FIT_ROWS = 4000
#: Weights are fixed-point numbers of 1/SCALE, cut at +-CLIP, so that sums do not depend on order.
SCALE, CLIP = 64, 8
#: A feature counts if a domain's share of its documents is so many standard deviations from the domain's share of all.
MIN_Z = 4.0
#: At most so many features have a weight, those farthest from chance.
MAX_FEATURES = 512
#: No document is taken more often than this, so that a target that cannot be reached does not repeat rows without bound.
MAX_RATE = 16.0
#: A mix whose greatest error of a domain's share is above this counts as not reached.
REACHED = 1e-3
#: Sums of weights are cut at +-CERTAIN: no membership is nearer to 0 or 1.
CERTAIN = 6.0


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), lambda w: w != "")


def _bucket(w: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(w, F.lit(salt)), F.lit(BUCKETS)).cast("int")


def features_of(words: Column) -> Column:
    """The distinct features of a text: its words and their last three characters, hashed."""
    return F.array_distinct(F.concat(F.transform(words, lambda w: _bucket(w, 1)), F.transform(words, lambda w: _bucket(F.right(w, F.lit(3)), 2) + BUCKETS)))


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: Sequence[str], fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Weights of features against the first domain: array of (2 * BUCKETS + 1, len(domains) - 1); the last row has the intercepts.

    labelled: doc_id, domain. The fit_rows rows of smallest hash are used (a documented bound), so the broadcast and what reaches the
    driver are bounded. An id counts once: of several domains the first by name, of several documents the least text. Features are chosen by how far their documents' domains are from chance; softmax regression on their presence
    gives calibrated posteriors.
    """
    sample = labelled.filter(F.col("domain").isin(list(domains)) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    rows = settle(rows.select("doc_id", "domain", features_of(tokens_of(F.col("text"))).alias("f")))
    counts = np.zeros((2 * BUCKETS, len(domains)))
    for r in rows.select("domain", F.explode("f").alias("f")).groupBy("domain", "f").count().collect():  # at most 2 * BUCKETS * domains rows
        counts[r["f"], domains.index(r["domain"])] = r["count"]
    per = np.zeros(len(domains))
    for r in rows.groupBy("domain").count().collect():
        per[domains.index(r["domain"])] = r["count"]
    out = np.zeros((2 * BUCKETS + 1, len(domains) - 1))
    total = per.sum()
    if not total:
        return out
    both, p = counts.sum(axis=1, keepdims=True), per / total
    z = np.abs((counts - both * p) / np.sqrt(np.maximum(both * p * (1 - p), 1e-9))).max(axis=1)
    chosen = np.sort(np.argsort(-z, kind="stable")[:MAX_FEATURES])
    chosen = chosen[z[chosen] >= MIN_Z]
    place = {int(f): i for i, f in enumerate(chosen)}
    got = rows.select("doc_id", "domain", F.array_intersect("f", F.array(*[F.lit(int(f)) for f in chosen]).cast("array<int>")).alias("f")).collect()
    got.sort(key=lambda r: (r["doc_id"], r["domain"], sorted(r["f"])))
    x, y = np.zeros((len(got), len(chosen) + 1)), np.zeros((len(got), len(domains)))
    x[:, -1] = 1
    for i, r in enumerate(got):
        x[i, [place[f] for f in r["f"]]] = 1
        y[i, domains.index(r["domain"])] = 1
    w = _softmax_regression(x, y)
    w = np.clip(w[:, 1:] - w[:, :1], -CLIP, CLIP)
    out[chosen], out[-1] = w[:-1], w[-1]
    return out


def _softmax_regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 400) -> np.ndarray:
    """Weights by accelerated gradient descent on the penalised log loss; the last column of x, the intercept, is not penalised."""
    w = z = np.zeros((x.shape[1], y.shape[1]))
    rate = 1 / (0.5 * np.linalg.norm(x, 2) ** 2 + ridge)
    penalty = np.full((x.shape[1], 1), ridge)
    penalty[-1] = 0
    for t in range(steps):
        e = x @ z
        e = np.exp(e - e.max(axis=1, keepdims=True))
        new = z - rate * (x.T @ (e / e.sum(axis=1, keepdims=True) - y) + penalty * z)
        w, z = new, new + t / (t + 3) * (new - w)
    return w


def posteriors(docs: DataFrame, model: np.ndarray, id_cols: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """id_cols, n_tokens and p (array of double, one per domain). Sums of weights are cut at +-CERTAIN: soft membership.

    Null and empty texts have no tokens; their posterior is the prior.
    """
    k = model.shape[1]
    fixed = np.rint(model[:-1] * SCALE).astype(np.int64)
    shift = CLIP * SCALE
    feats = F.col("__f")

    def total(values: np.ndarray) -> Column:
        table = F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>")
        return F.aggregate(feats, F.lit(0).cast("bigint"), lambda acc, f: acc + F.get(table, f))

    rows = docs.select(*id_cols, tokens_of(F.col(text)).alias("__words"))
    rows = rows.select(*id_cols, F.size("__words").cast("bigint").alias("n_tokens"), features_of(F.col("__words")).alias("__f"))
    # Two sums share one 64-bit number: at most 2 * BUCKETS distinct features of at most 2 * CLIP * SCALE each fit in 32 bits.
    packed = [total((fixed[:, i] + shift) * (1 << 32) + (fixed[:, i + 1] + shift if i + 1 < k else shift)) for i in range(0, k, 2)]
    rows = rows.select(*id_cols, "n_tokens", F.size("__f").alias("__m"), *[c.alias(f"__s{i}") for i, c in enumerate(packed)])
    sums = []
    for i in range(k):
        both = F.col(f"__s{i // 2}")
        one = F.shiftright(both, 32) if i % 2 == 0 else both.bitwiseAND(F.lit((1 << 32) - 1))
        sums.append((one - F.col("__m") * shift) / float(SCALE) + float(model[-1, i]))
    soft = [F.lit(0.0)] + [F.greatest(F.lit(-CERTAIN), F.least(F.lit(CERTAIN), x)) for x in sums]
    rows = rows.select(*id_cols, "n_tokens", F.array(*soft).alias("__z"))
    rows = rows.select(*id_cols, "n_tokens", F.transform("__z", lambda z: F.exp(z - F.array_max("__z"))).alias("__e"))
    norm = F.aggregate("__e", F.lit(0.0), lambda a, x: a + x)
    return rows.select(*id_cols, "n_tokens", norm.alias("__n"), "__e").select(*id_cols, "n_tokens", F.transform("__e", lambda x: x / F.col("__n")).alias("p"))


def rate_of(p: Column, v: Sequence[float]) -> Column:
    dot = F.lit(1.0)
    for k, x in enumerate(v):
        dot = dot + F.get(p, F.lit(k)) * F.lit(float(x))
    return F.least(F.lit(MAX_RATE), F.greatest(F.lit(0.0), dot))


def fit_rates(members: DataFrame, targets: Sequence[float], anchor: int | None = None, max_steps: int = 40, tolerance: float = 1e-9) -> tuple[list[float], dict]:
    """members: n_tokens, p. targets: expected tokens by domain as shares. They are shares of all tokens, or with an anchor scaled so
    that this domain keeps its tokens. Returns v and what was reached.

    Each step projects (rates below 0 are 0), measures the residual over all documents, and moves v along the gradient, with the
    Gram matrix of the rows at positive rates as preconditioner; a step that does not lower the residual is halved.
    """
    k = len(targets)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    p = lambda i: F.get(F.col("p"), F.lit(i))
    n = F.col("n_tokens").cast("double")
    whole = float(members.agg(F.sum("n_tokens")).first()[0] or 0)
    if not whole:
        return [0.0] * k, {"steps": 0, "residual": 0.0}
    t = np.asarray(targets, dtype=float)
    t = t / t.sum()

    def measure(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = rate_of(F.col("p"), v)
        sums = [F.sum(r * n * p(i)) for i in range(k)] + [F.sum(F.when((r > 0) & (r < MAX_RATE), n * p(i) * p(j))) for i, j in pairs]
        got = [x or 0.0 for x in members.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
        gram = np.zeros((k, k))
        for (i, j), x in zip(pairs, got[k:]):
            gram[i, j] = gram[j, i] = x / whole
        return np.asarray(got[:k]) / whole - t, gram

    v = np.zeros(k)
    residual, gram = measure(v)
    if anchor is not None:  # at rate 1 the domain has residual + t of all tokens
        scaled = t * (residual[anchor] + t[anchor]) / max(t[anchor], 1e-12)
        residual, t = residual + t - scaled, scaled
    step, done = 1.0, 0
    for done in range(1, max_steps + 1):
        if np.abs(residual).max() < tolerance or step < 1e-3:
            break
        move = np.linalg.solve(gram + 1e-9 * max(np.trace(gram), 1e-12) * np.eye(k), residual)
        new = v - step * move
        new_residual, new_gram = measure(new)
        if np.linalg.norm(new_residual) < np.linalg.norm(residual):
            v, residual, gram, step = new, new_residual, new_gram, min(1.0, 2 * step)
        else:
            step /= 2
    return v.tolist(), {"steps": done, "residual": float(np.abs(residual).max()), "reached": (residual + t).tolist()}


def copies_of(rate: Column, *key: Column) -> Column:
    """A whole number of copies whose expectation is the rate; decided by the key alone."""
    return F.floor(rate + unit_hash(*key, F.lit("copies"))).cast("int")


def mix_rates(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], fit_rows: int = FIT_ROWS, anchor: str | None = None, strict: bool = False) -> tuple[np.ndarray, list[float], DataFrame]:
    """The classifier, v, and the posteriors of all documents (doc_id, n_tokens, p).

    A mix that rates from 0 to MAX_RATE cannot reach (a domain without labelled rows, or with too few tokens) ends at the nearest
    found; the shares that it has are logged, or with strict an error tells them."""
    domains = list(targets)
    model = fit_domains(docs, labelled, domains, fit_rows)
    members = settle(posteriors(docs, model))
    v, found = fit_rates(members.select("n_tokens", "p"), [targets[d] for d in domains], domains.index(anchor) if anchor else None)
    if found["residual"] > REACHED:
        total = sum(found["reached"]) or 1.0
        said = "the mix is not reached: " + ", ".join(f"{d} {x / total:.4f} of {targets[d] / sum(targets.values()):.4f}" for d, x in zip(domains, found["reached"]))
        if strict:
            raise ValueError(said)
        LOG.warning(said)
    return model, v, members


def resample(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], fit_rows: int = FIT_ROWS, anchor: str | None = None,
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each row as often as its rate says: the whole part always, one more with the rest's probability, by id. All columns
    stay; posteriors are computed once more in place, so that texts are never shuffled."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    model, v, _ = mix_rates(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labelled, targets, fit_rows, anchor)
    rows = posteriors(docs.toDF(*names), model, names, at[text])
    copies = copies_of(F.round(rate_of(F.col("p"), v), 9), F.col(at[doc_id]))
    return rows.select(*names, F.explode(F.array_repeat(F.lit(0), copies)).alias("__copy")).select(*[F.col(n).alias(c) for c, n in at.items()])


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], fit_rows: int = FIT_ROWS, strict: bool = False) -> DataFrame:
    """docs: doc_id, text. labelled: doc_id, domain. targets: share of all tokens by domain; the first is the classifier's base.

    Returns one row per input row: doc_id, n_tokens, p, rate, copies. Repeated rows have equal values; a null doc_id counts as a
    key of its own; other columns are ignored. Without labelled rows all posteriors are equal, so no target but equal shares can be
    reached. Targets out of reach: see mix_rates().
    """
    _, v, members = mix_rates(docs, labelled, targets, fit_rows, strict=strict)
    rate = F.round(rate_of(F.col("p"), v), 9)
    return members.select("doc_id", "n_tokens", "p", rate.alias("rate")).withColumn("copies", copies_of(F.col("rate"), F.col("doc_id")))


#: Domains of the labelled table and their target shares in the registered query and in the pipeline.
TARGETS = {"clean": 0.88, "poor": 0.08, "toxic": 0.04}


def labelled_domains(labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).filter("domain is not null")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs, labelled_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS)
    p = [F.round(F.get("p", F.lit(i)), 9).alias(f"p_{d}") for i, d in enumerate(TARGETS)]
    return out.select("doc_id", "n_tokens", *p, "rate", "copies")
