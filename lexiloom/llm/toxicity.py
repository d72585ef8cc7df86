"""Operator 10: toxicity by a convolutional text classifier trained in numpy.

A word's vector sums hashed embeddings of the word and of its first letters (several
lengths, as stems), so unseen inflections of a known word are understood. Filters of
several widths slide over the words, each keeps its maximum over the document, and a
logistic layer reads the maxima. Training is minibatch Adagrad on the driver, with a
random part of the words left out of the maxima each time (else a document teaches its
strongest word alone),
over at most TRAIN_TOXIC toxic and TRAIN_CLEAN clean labelled rows (those with the
least hash of doc_id, as long as the texts of a class have TRAIN_LETTERS code points at
most), less a quarter that is held out. All labelled rows that
aren't trained on are scored in Spark and, weighted back to the shares of all labels,
set one decision threshold for each language: the one with the best F1. Scores are
counted in STEPS steps of the log-odds, so the driver gets as many rows as there are
steps, whatever the labels' number. A language with fewer than least_held such rows
of either class takes the threshold of all languages.

Scoring is one pass over whole texts. For each batch the filters are multiplied
with the distinct words' vectors once, and a document gathers and adds rows.

Result: (doc_id, lang, score, toxic) for every row of documents.

Defined cases: null text or no words: score 0, not toxic. Null doc_id: scored like
any row. Null or unlabelled lang: the threshold of all languages. Labels with a null
id or class are ignored; of several labels for one doc_id toxic wins. Without
labelled rows of both classes nothing can be learned: all scores are 0, nothing is
toxic. Rows that repeat get equal scores. Texts of any length are scored whole. Ties: a
score that equals the threshold isn't toxic. An empty table gives no rows. Other columns are not read by
toxicity_scores, and pass through drop_toxic whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as K
from lexiloom.llm.common import bounded, cut, fresh, maybe_in
from lexiloom.shipping import ship

TRAIN_TOXIC, TRAIN_CLEAN = 3000, 6000
#: Code points of the training texts of either class.
TRAIN_LETTERS = 48_000_000
BUCKETS, DIM = 1 << 16, 16
WIDTHS, FILTERS = (1, 2, 3), 8
STEMS = (4, 5, 6, 7)
EPOCHS, BATCH, RATE = 8, 32, 0.1
DROPOUT = 0.3
LEAST_HELD = 10
#: Steps of the log-odds from -LIMIT to LIMIT.
STEPS, LIMIT = 4096, 16
SMALL = 0.001
SEED = 7


class Model(NamedTuple):
    words: np.ndarray  # (buckets, dim)
    filters: list[np.ndarray]  # for each width: (width, dim, filters)
    bias: list[np.ndarray]
    out: np.ndarray
    offset: float


class _Batch:
    """Distinct words of some texts, and the texts as word numbers with padding between."""

    def __init__(self, texts: list[str], buckets: int):
        tokens, _, folded, bounds = K.tokenize_points(texts)
        _, which, inverse = np.unique(tokens.hashes, return_index=True, return_inverse=True)
        doc = tokens.doc()
        starts = tokens.starts[which] + bounds[doc[which]]
        ends = tokens.ends[which] + bounds[doc[which]]
        self.buckets = K.stems(tokens.hashes[which], folded, starts, ends, STEMS, buckets).astype(np.int32)
        self.counts = tokens.counts()
        pad = max(WIDTHS) - 1
        self.firsts = tokens.offsets[:-1] + pad * np.arange(len(texts))
        self.row = np.full(len(tokens.hashes) + pad * len(texts), len(which), np.int32)
        self.at = (np.arange(len(tokens.hashes)) + pad * doc).astype(np.int32)
        self.row[self.at] = inverse

    def vectors(self, words: np.ndarray) -> np.ndarray:
        """(distinct words + 1, dim); the last is the padding's."""
        out = np.zeros((len(self.buckets) + 1, words.shape[1]), np.float32)
        for j in range(self.buckets.shape[1]):
            out[:-1] += words[self.buckets[:, j]]
        return out


def _pooled(batch: _Batch, vectors: np.ndarray, filters: np.ndarray, bias: np.ndarray, dropped: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Maxima by document, and the convolution at every word; dropped words can't be the maximum."""
    width = len(filters)
    conv = (vectors @ filters[0])[batch.row[batch.at]]
    for j in range(1, width):
        conv += (vectors @ filters[j])[batch.row[batch.at + j]]
    if dropped is not None:
        conv[dropped] = -1e9
    some = batch.counts > 0
    top = np.zeros((len(batch.counts), filters.shape[2]), np.float32)
    firsts = np.cumsum(batch.counts) - batch.counts
    if some.any():
        top[some] = np.maximum.reduceat(conv, firsts[some], axis=0)
    return np.maximum(top + bias, 0) * some[:, None], conv


def score(model: Model, texts: list[str]) -> np.ndarray:
    batch = _Batch(texts, len(model.words))
    vectors = batch.vectors(model.words)
    maxima = [_pooled(batch, vectors, f, b)[0] for f, b in zip(model.filters, model.bias)]
    logit = np.concatenate(maxima, axis=1) @ model.out + model.offset
    return np.where(batch.counts > 0, 1 / (1 + np.exp(-np.clip(logit, -30, 30))), 0.0)


def train(texts: list[str] | pa.ChunkedArray, toxic: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Minimises class-weighted cross entropy; the same input gives the same model."""
    rng = np.random.default_rng(seed)
    words = rng.normal(0, SMALL, (BUCKETS, DIM)).astype(np.float32)
    filters = [rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out = np.full(FILTERS * len(WIDTHS), 0.5, np.float32)
    offset = np.full(1, -2.0, np.float32)
    dense = [*filters, *bias, out, offset]
    past = [np.full_like(p, 1e-3) for p in dense]
    past_words = np.full(BUCKETS, 1e-3, np.float32)
    share = float(toxic.mean())
    balance = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    order = rng.permutation(len(texts))
    parts = [order[lo : lo + BATCH] for lo in range(0, len(order), BATCH)]
    batches = [_Batch(K.chosen(texts, own), BUCKETS) for own in parts]
    for _ in range(epochs):
        for at in rng.permutation(len(parts)):
            own, batch = parts[at], batches[at]
            vectors = batch.vectors(words)
            dropped = rng.random(len(batch.at)) < DROPOUT
            pools = [_pooled(batch, vectors, f, b, dropped) for f, b in zip(filters, bias)]
            top = np.concatenate([p[0] for p in pools], axis=1)
            logit = np.clip(top @ out + offset[0], -30, 30)
            error = (1 / (1 + np.exp(-logit)) - toxic[own]) * balance[own] / len(own)
            back = error[:, None] * out * (top > 0)
            grads = [np.zeros_like(f) for f in filters]
            touched, deltas = [], []
            firsts = np.cumsum(batch.counts) - batch.counts
            for x, (w, (_, conv)) in enumerate(zip(WIDTHS, pools)):
                part = back[:, x * FILTERS : (x + 1) * FILTERS]
                d, f = np.nonzero(part)
                g = part[d, f]
                best = np.zeros((len(own), FILTERS), np.int64)
                for i in np.unique(d):
                    best[i] = conv[firsts[i] : firsts[i] + batch.counts[i]].argmax(0) + firsts[i]
                where = best[d, f]
                for j in range(w):
                    row = batch.row[batch.at[where] + j]
                    np.add.at(grads[x][j].T, f, vectors[row] * g[:, None])
                    touched.append(row)
                    deltas.append(filters[x][j][:, f].T * g[:, None])
            dense_grads = [*grads, *(back[:, x * FILTERS : (x + 1) * FILTERS].sum(0) for x in range(len(WIDTHS))), top.T @ error, np.array([error.sum()])]
            rows, delta = np.concatenate(touched), np.concatenate(deltas)
            rows, delta = rows[rows < len(vectors) - 1], delta[rows < len(vectors) - 1]
            if len(rows):
                unique, inverse = np.unique(rows, return_inverse=True)
                summed = np.zeros((len(unique), DIM), np.float32)
                np.add.at(summed, inverse, delta)
                flat = batch.buckets[unique]
                slots, inverse = np.unique(flat.ravel(), return_inverse=True)
                step = np.zeros((len(slots), DIM), np.float32)
                np.add.at(step, inverse, np.repeat(summed, flat.shape[1], axis=0))
                past_words[slots] += (step**2).mean(1)
                words[slots] -= RATE * step / np.sqrt(past_words[slots])[:, None]
            for p, h, g in zip(dense, past, dense_grads):
                h += g**2
                p -= (RATE * g / np.sqrt(h)).astype(np.float32)
            np.maximum(out, 0, out=out)  # a maximum is evidence for toxicity, never against
    return Model(words, filters, bias, out, float(offset[0]))


def threshold(scores: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> float:
    """The cut with the best weighted F1; of equal ones the middle of the widest gap."""
    order = np.argsort(-scores, kind="stable")
    s, y, w = scores[order], toxic[order], weights[order]
    hits = np.cumsum(y * w)
    f1 = 2 * hits / (np.cumsum(w) + hits[-1])
    follow = np.append(s[1:], 0.0)
    f1 = np.where(s > follow, f1, -1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    pick = best[np.argmax((s - follow)[best])]
    return float((s[pick] + follow[pick]) / 2)


class Classifier(NamedTuple):
    model: Model | None
    overall: float
    by_language: dict[str, float]


def fit(documents: DataFrame, labels: DataFrame, toxic_rows: int = TRAIN_TOXIC, clean_rows: int = TRAIN_CLEAN, least_held: int = LEAST_HELD) -> Classifier:
    rows = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").cast("int").alias("y"))
    rows = rows.where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("id"), "text", "lang").where("text is not null and id is not null")
    # Labels without a document have no part.
    labelled = cut(rows.join(texts.groupBy("id").agg(F.max(F.length("text")).alias("size")), "id"))
    totals = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    first = lambda y, n: bounded(labelled.where(F.col("y") == y), n, TRAIN_LETTERS)
    sample = first(1, toxic_rows).union(first(0, clean_rows))
    # At most toxic_rows + clean_rows ids, and twice TRAIN_LETTERS code points; rows that repeat an id count once.
    found = texts.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("text").alias("text")).toArrow()
    order = np.argsort(found.column("id").to_numpy(), kind="stable")
    y = found.column("y").to_numpy()[order].astype(np.float32)
    if len(set(y.tolist())) < 2:
        return Classifier(None, 1.0, {})
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        held[own[3::4]] = True
    own = pa.array(order[~held])
    trained = documents.sparkSession.createDataFrame(found.select(["id"]).take(own))
    found = found.column("text").take(own)
    model = train(found, y[~held])
    del found
    K.release()
    # Texts stay where they are: those that may be labelled are scored, and the scores joined with labels.
    maybe = maybe_in(texts, "id", labelled.select("id"), "maybe").where("maybe").select("id", "text", "lang")
    marks = scored(maybe, Classifier(model, 0.5, {}), "score").select("id", F.coalesce("lang", F.lit("")).alias("lang"), "score")
    rest = marks.join(labelled.join(F.broadcast(trained), "id", "left_anti"), "id")
    # Rows that repeat a doc_id count once.
    rest = rest.groupBy("id").agg(F.min(F.struct("lang", "score", "y")).alias("r")).select("r.*")
    odds = F.least(F.greatest(F.log(F.col("score") / (1 - F.col("score"))), F.lit(-LIMIT)), F.lit(LIMIT))
    odds = F.when(F.col("score") <= 0, -LIMIT).when(F.col("score") >= 1, LIMIT).otherwise(odds)
    step = F.floor((odds + LIMIT) * (STEPS / (2 * LIMIT))).cast("int")
    counts = rest.groupBy("lang", "y", step.alias("step")).agg(F.count("*").alias("n"), F.avg("score").alias("s")).collect()
    return Classifier(model, *_thresholds(counts, totals, least_held))


def _thresholds(counts: list, totals: dict[int, int], least_held: int = LEAST_HELD) -> tuple[float, dict[str, float]]:
    """The overall threshold and those by language, from (lang, y, s, n) rows of n documents about score s."""
    y, n = np.array([r["y"] for r in counts]), np.array([r["n"] for r in counts], float)
    each = [n[y == c].sum() for c in (0, 1)]
    if not all(each):
        return 0.5, {}
    weights = n * np.where(y == 1, totals[1] / each[1], totals[0] / each[0])
    scores, langs = np.array([r["s"] for r in counts]), np.array([r["lang"] for r in counts])
    per = {}
    for lang in sorted(set(langs.tolist()) - {""}):
        own = langs == lang
        if min(n[own & (y == 1)].sum(), n[own & (y == 0)].sum()) >= least_held:
            per[lang] = threshold(scores[own], y[own], weights[own])
    return threshold(scores, y, weights), per


def scored(documents: DataFrame, classifier: Classifier, name: str) -> DataFrame:
    """documents with the score in a new column."""
    if classifier.model is None:
        return documents.withColumn(name, F.lit(0.0))
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(classifier.model)  # a fixed size

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [score(shared.value, part) for _, _, part in K.chunks(texts)]
            yield pa.array(np.round(np.concatenate(parts).astype(np.float64), 6) if parts else np.zeros(0))
        K.release()

    return documents.withColumn(name, F.when(F.col("text").isNull(), F.lit(0.0)).otherwise(run("text")))


def _cut(classifier: Classifier):
    if not classifier.by_language:
        return F.lit(classifier.overall)
    table = F.create_map(*[F.lit(x) for pair in sorted(classifier.by_language.items()) for x in pair])
    return F.coalesce(table[F.col("lang")], F.lit(classifier.overall))


def toxicity_scores(documents: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    classifier = fit(documents, labels, **bounds)
    out = scored(documents.select("doc_id", "lang", "text"), classifier, "score")
    return out.select("doc_id", "lang", "score", (F.col("score") > _cut(classifier)).alias("toxic"))


def drop_toxic(documents: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    name = f"{fresh(documents)}score"
    classifier = fit(documents, labels, **bounds)
    return scored(documents, classifier, name).where(F.col(name) <= _cut(classifier)).drop(name)
