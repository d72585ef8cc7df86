"""Operator 3: mixing to target weights by soft domain membership.

Domains are read from the labelled table: "toxic" (toxic = 1), "high" and "low"
(quality 1 or 0, not toxic). A multinomial logistic classifier, trained in numpy on
at most TRAIN_ROWS labelled rows (and TRAIN_LETTERS code points of text) of each domain, predicts every document's domain
posteriors p from hashed words and the shape of its text.

With n tokens in a document and share w = n / total, rates r >= 0 are fitted so
that the expected domain shares sum(w r p) meet the targets t: projected gradient
descent on

    1/2 e' M^-1 e + RIDGE/2 sum(w (r - 1)^2),   e = sum(w r p) - t,   M = sum(w p p') + 1e-6 I

M^-1 makes all directions equally steep, RIDGE bounds the curvature from below, and
with both bounds known constant (Nesterov) momentum converges in few steps. A step
moves r by a function of p alone, so the state between steps is one vector of length
domains: executors replay the steps from the stored posteriors and send back only
sums. RIDGE keeps rates near 1 where the targets leave a choice and makes the optimum
unique. Targets more extreme than any document's posteriors are met as nearly as the
least squares allow.

Result: (doc_id, source, tokens, p_<domain>..., rate) for every row of documents.

Defined cases: null or empty text: 0 tokens, so it weighs nothing; its rate follows
from its posteriors as any other. Null doc_id or source: kept as any row. Labels with
null id or null classes are ignored; of several labels for one doc_id the greatest
toxic and then the least quality counts. Domains without a target or without labelled
rows are left out, and the targets are scaled to sum to 1 over the others. Fewer than two domains: all
rates are 1. Repeated rows get equal rates and count as often as they occur. An empty
table gives no rows. Texts of any length are read whole. Ties: equal posteriors give
equal rates; of labelled rows with equal hashes the least doc_id is trained on first.
Other columns are not read by mixture_rates and pass through mixed whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as K
from lexiloom.llm.common import arrow, bounded, cut
from lexiloom.shipping import ship

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.9, "low": 0.05, "toxic": 0.05}
TRAIN_ROWS = 2500
#: Code points of the training texts of one domain.
TRAIN_LETTERS = 32_000_000
BUCKETS = 1 << 15
EPOCHS, BATCH, RATE = 8, 64, 0.3
RIDGE = 0.02
STEPS, TOLERANCE = 120, 1e-8
MOMENTUM = ((1 + RIDGE) ** 0.5 - RIDGE**0.5) / ((1 + RIDGE) ** 0.5 + RIDGE**0.5)
SHAPES = 7

_kinds: list[np.ndarray] = []


def _kind_table() -> np.ndarray:
    """Code point -> 0 other, 1 upper case, 2 lower case or caseless letter, 3 digit, 4 space, 5 line end."""
    if not _kinds:
        fold = K.fold_table()
        table = np.zeros(len(fold), np.uint8)
        table[fold != 0] = 2
        table[(fold != 0) & (fold != np.arange(len(fold)))] = 1
        table[48:58] = 3
        table[[9, 11, 12, 13, 32, 160]] = 4
        table[10] = 5
        _kinds.append(table)
    return _kinds[0]


def features(texts: list[str]) -> tuple[K.Tokens, np.ndarray, np.ndarray]:
    """Tokens, the bucket of each, and (texts, SHAPES) shape features between about 0 and 1."""
    tokens, cps, _, bounds = K.tokenize_points(texts)
    kinds = _kind_table()[cps]
    n = np.maximum(np.diff(bounds) - 1, 0)
    ends = bounds[1:] - 1

    def count(kind: int) -> np.ndarray:
        sums = np.zeros(len(kinds) + 1, np.int64)
        np.cumsum(kinds == kind, out=sums[1:])
        return sums[ends] - sums[bounds[:-1]]

    per = [count(k) for k in range(6)]
    size = np.maximum(n, 1)
    words = tokens.counts()
    letters = per[1] + per[2]
    new = np.zeros(len(tokens.hashes) + 1, np.int64)
    new[2:] = np.cumsum(tokens.hashes[1:] == tokens.hashes[:-1]) if len(tokens.hashes) else 0
    again = new[tokens.offsets[1:]] - new[np.minimum(tokens.offsets[:-1] + 1, len(tokens.hashes))]
    shape = np.stack(
        [
            per[1] / np.maximum(letters, 1),
            per[0] / size,
            per[3] / size,
            np.minimum(letters / np.maximum(words, 1) / 12, 2),
            np.log1p(words) / 10,
            np.minimum(per[5] / np.maximum(words, 1) * 10, 2),
            np.maximum(again, 0) / np.maximum(words, 1),
        ],
        axis=1,
    ).astype(np.float32)
    return tokens, (tokens.hashes % np.uint64(BUCKETS)).astype(np.int64), shape


def _logits(model: tuple, tokens: K.Tokens, buckets: np.ndarray, shape: np.ndarray) -> np.ndarray:
    words, dense, bias = model
    n = tokens.counts()
    sums = np.zeros((len(n), len(bias)), np.float32)
    some = n > 0
    if some.any():
        sums[some] = np.add.reduceat(words[buckets], tokens.offsets[:-1][some], axis=0)
    return sums / np.sqrt(np.maximum(n, 1))[:, None] + shape @ dense + bias


def posteriors(model: tuple, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token counts, and posteriors that sum to 1."""
    tokens, buckets, shape = features(texts)
    z = _logits(model, tokens, buckets, shape).astype(np.float64)
    z = np.exp(z - z.max(1, keepdims=True))
    return tokens.counts(), z / z.sum(1, keepdims=True)


def train(texts: list[str] | pa.ChunkedArray, domain: np.ndarray, prior: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> tuple:
    """Softmax regression by Adagrad; prior: each domain's share of all labels, to which the bias is set back."""
    rng = np.random.default_rng(seed)
    k = len(prior)
    words, dense, bias = np.zeros((BUCKETS, k), np.float32), np.zeros((SHAPES, k), np.float32), np.zeros(k, np.float32)
    past = [np.full((BUCKETS, 1), 1e-4, np.float32), np.full_like(dense, 1e-4), np.full_like(bias, 1e-4)]
    order = rng.permutation(len(texts))
    parts = [order[lo : lo + BATCH] for lo in range(0, len(order), BATCH)]
    ready = []
    for own in parts:
        tokens, buckets, shape = features(K.chosen(texts, own))
        # Training asks for no more of the tokens than where texts begin.
        ready.append((tokens._replace(hashes=None, starts=None, ends=None), buckets.astype(np.int32), shape))
    for _ in range(epochs):
        for at in rng.permutation(len(parts)):
            own, (tokens, buckets, shape) = parts[at], ready[at]
            z = _logits((words, dense, bias), tokens, buckets, shape)
            z = np.exp(z - z.max(1, keepdims=True))
            error = z / z.sum(1, keepdims=True)
            error[np.arange(len(own)), domain[own]] -= 1
            error /= len(own)
            n = tokens.counts()
            scaled = error / np.sqrt(np.maximum(n, 1))[:, None]
            slots, inverse = np.unique(buckets, return_inverse=True)
            doc = tokens.doc()
            step = np.stack([np.bincount(inverse, scaled[doc, c], len(slots)) for c in range(k)], axis=1).astype(np.float32)
            step += 1e-6 * words[slots]
            past[0][slots] += (step**2).mean(1, keepdims=True)
            words[slots] -= 0.3 * RATE * step / np.sqrt(past[0][slots])
            for p, h, g in ((dense, past[1], shape.T @ error), (bias, past[2], error.sum(0))):
                h += g**2
                p -= RATE * g / np.sqrt(h)
    seen = np.bincount(domain, minlength=k) / len(domain)
    return words, dense, bias + np.log(prior / seen).astype(np.float32)


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, domains: tuple[str, ...] = DOMAINS) -> tuple[tuple[str, ...], tuple | None]:
    """Those of domains that have labelled rows, and the classifier between them (None for fewer than two)."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").cast("int").alias("t"), F.col("quality").cast("int").alias("q"))
    rows = rows.where("id is not null and t in (0, 1) and q in (0, 1)").groupBy("id").agg(F.max("t").alias("t"), F.min("q").alias("q"))
    rows = rows.select("id", F.expr("case when t = 1 then 'toxic' when q = 1 then 'high' else 'low' end").alias("d"))
    ids = documents.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text")).where("text is not null")
    sized = ids.groupBy("id").agg(F.max(F.length("text")).alias("size"))
    there = cut(sized.join(rows, "id"))
    totals = {r["d"]: r["count"] for r in there.groupBy("d").count().collect()}
    names = tuple(d for d in domains if d in totals)
    if len(names) < 2:
        return names, None
    sample = None
    for d in names:
        part = bounded(there.where(F.col("d") == d), train_rows, TRAIN_LETTERS)
        sample = part if sample is None else sample.union(part)
    # At most train_rows ids of each domain, and TRAIN_LETTERS code points; rows that repeat an id count once.
    found = ids.join(F.broadcast(sample), "id").groupBy("id", "d").agg(F.min("text").alias("text")).toArrow()
    order = pa.array(np.argsort(found.column("id").to_numpy(), kind="stable"))
    prior = np.array([totals[d] for d in names], float)
    domain = np.array([names.index(d) for d in found.column("d").take(order).to_pylist()])
    found = found.column("text").take(order)
    model = train(found, domain, prior / prior.sum())
    del found
    K.release()
    return names, model


def replayed(p: np.ndarray, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rates of documents with posteriors p after the steps whose whitened residuals are in history, and the point from which the next step starts."""
    r = z = np.ones(len(p))
    for y in history:
        new = np.maximum(0.0, z - (p @ y + RIDGE * (z - 1)) / (1 + RIDGE))
        r, z = new, new + MOMENTUM * (new - r)
    return r, z


def rates(p: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    return replayed(p, history)[0]


def solve(shares: DataFrame, targets: np.ndarray, steps: int = STEPS) -> list[np.ndarray]:
    """The steps of the projected gradient; shares has (n double, p array<double>), stored."""
    k = len(targets)
    p = [F.col("p")[i] for i in range(k)]
    sums = [F.sum(F.col("n") * a * b).alias(f"m{i}_{j}") for i, a in enumerate(p) for j, b in enumerate(p)]
    first = shares.agg(F.sum("n").alias("n"), *sums).first()
    total = float(first["n"] or 0)
    if not total:
        return []
    moment = np.array([[first[f"m{i}_{j}"] for j in range(k)] for i in range(k)], float) / total
    inverse = np.linalg.inv(moment + 1e-6 * np.eye(k))
    history: list[np.ndarray] = []
    held = moment.sum(1)  # the posteriors sum to 1, so this is sum(w p) at rates of 1
    still = 0
    for _ in range(steps):
        y = inverse @ (held - targets)
        history.append(y)

        def part(batches: Iterator[pa.RecordBatch], past: tuple = tuple(history)) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k)
            for batch in batches:
                if batch.num_rows:
                    post = batch.column(1).flatten().to_numpy().reshape(-1, k)
                    out += (batch.column(0).to_numpy() * replayed(post, past)[1]) @ post
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in out], names=[f"s{i}" for i in range(k)])

        got = arrow(shares.select("n", "p"), part, ", ".join(f"s{i} double" for i in range(k))).collect()
        new = np.array([[r[i] for i in range(k)] for r in got], float).sum(0) / total
        moved, held = np.abs(new - held).max(), new
        still = still + 1 if moved < TOLERANCE else 0
        if still == 3:  # momentum can stand still for a moment as it turns
            break
    return history


def _posterior_udf(documents: DataFrame, model: tuple):
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a fixed size

    @F.arrow_udf("n bigint, p array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            counts, post = _of_column(shared.value, texts)
            k = post.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(post) + 1, dtype=np.int32) * k), pa.array(post.ravel()))
            yield pa.StructArray.from_arrays([pa.array(counts), lists], names=["n", "p"])
        K.release()

    return run


def _rate_udf(documents: DataFrame, model: tuple, history: list[np.ndarray]):
    """The rate straight from the text, in one pass through Python."""
    shared = documents.sparkSession.sparkContext.broadcast((model, history))  # a fixed size

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            own, past = shared.value
            yield pa.array(np.round(rates(_of_column(own, texts)[1], past), 6))
        K.release()

    return run


def _of_column(model: tuple, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [posteriors(model, part) for _, _, part in K.chunks(texts)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros((0, len(model[2])))
    return np.concatenate([a for a, _ in parts]).astype(np.int64), np.round(np.concatenate([b for _, b in parts]), 6)


class _Fitted(NamedTuple):
    names: tuple[str, ...]
    model: tuple | None
    history: list[np.ndarray]
    known: DataFrame | None


def _fitted(documents: DataFrame, labels: DataFrame, keep: list[str], x: str, targets: dict[str, float], train_rows: int, steps: int) -> _Fitted:
    """known is stored and has the columns keep, {x}n tokens and {x}p posteriors."""
    names, model = fit(documents, labels, train_rows, tuple(d for d in DOMAINS if d in targets))
    if model is None:
        return _Fitted(names, None, [], None)
    wanted = np.array([max(0.0, targets[d]) for d in names])
    if not wanted.sum():
        raise ValueError("no target is above 0 for a domain that has labelled documents")
    found = documents.select(*keep, _posterior_udf(documents, model)(F.col("text")).alias(f"{x}u"))
    known = cut(found.select(*keep, F.col(f"{x}u.n").alias(f"{x}n"), F.col(f"{x}u.p").alias(f"{x}p")))
    history = solve(known.select(F.col(f"{x}n").cast("double").alias("n"), F.col(f"{x}p").alias("p")), wanted / wanted.sum(), steps)
    return _Fitted(names, model, history, known)


def mixture_rates(
    documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, train_rows: int = TRAIN_ROWS, steps: int = STEPS
) -> DataFrame:
    fitted = _fitted(documents, labels, ["doc_id", "source"], "lx_", targets, train_rows, steps)
    names, history = fitted.names, fitted.history
    if fitted.model is None:
        words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != ""))
        return documents.select(
            "doc_id", "source", words.cast("bigint").alias("tokens"), *[F.lit(1.0).alias(f"p_{d}") for d in names], F.lit(1.0).alias("rate")
        )

    @F.arrow_udf("double")
    def rate(p: pa.Array) -> pa.Array:
        return pa.array(np.round(rates(p.flatten().to_numpy().reshape(-1, len(names)), history), 6))

    each = [F.col("lx_p")[i].alias(f"p_{d}") for i, d in enumerate(names)]
    return fitted.known.select("doc_id", "source", F.col("lx_n").alias("tokens"), *each, rate("lx_p").alias("rate"))


def mixed(
    documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, train_rows: int = TRAIN_ROWS, steps: int = STEPS
) -> DataFrame:
    """All documents with their rate as a last column: "rate", or where that is taken (in any case) "mixing_rate", "mixing_rate_2", ...

    A rate of 0 is a decision for whoever samples; the row stays.
    """
    taken = {c.lower() for c in documents.columns}
    names = itertools.chain(("rate", "mixing_rate"), (f"mixing_rate_{i}" for i in itertools.count(2)))
    name = next(n for n in names if n not in taken)
    fitted = _fitted(documents, labels, [], "lx_", targets, train_rows, steps)
    rate = F.lit(1.0) if fitted.model is None else _rate_udf(documents, fitted.model, fitted.history)(F.col("text"))
    return documents.withColumn(name, rate)
