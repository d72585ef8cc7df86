"""Operator 2: language-model scores by a log-bilinear neural model.

The context vector of a word is a sum, over the CONTEXT words before it, of their
vectors weighted by one diagonal matrix per distance; the score of a word is the
inner product of its output vector with the context vector, plus a bias.

1. Words are counted over all documents. The HEAD most frequent ones that occur LEAST
   times are known to every worker, the most frequent of these (as many as the square
   root of the distinct words, within SYMBOLS) as symbols of the network; the others
   share one symbol for each power of two of their count, and have within it the
   probability of their count. All words beyond the head share a symbol for each class of
   length, and within it have the probability of their count, which a join with the
   table of counts tells; words under LEAST are spelled: the probability of each letter
   after the one before, and of the word's end. The symbols' counts are the noise
   distribution.
2. Training, in numpy by noise-contrastive estimation: each partition of the corpus
   trains on all its own words from one common start; the models are averaged,
   weighted by their words, by a Spark aggregation over parameter slots. Every word
   of the corpus is a training target. The letters of words beyond the head are counted.
3. Scoring: each distinct context of a task is multiplied with all output vectors
   once; its log-sum-of-exponentials, kept in a table of all contexts, normalises the
   log-probability of every symbol that follows it; the word within its symbol is added, for words beyond the head by document
   and word after a shuffle of these alone. No approximation is left in the scores.

Result: (doc_id, tokens, unknown, log_prob, perplexity) for every row of documents;
log_prob is the natural log-probability of all its words, unknown counts those spelled.

Defined cases: null text or no words: 0 tokens, log_prob 0, perplexity null. Null
doc_id: scored like any row. Ties in word counts: the lesser hash comes first.
Repeated rows count as often as they occur and get equal scores. Texts of any length are
scored whole, the context going on over their pieces. A corpus without words gives 0
tokens everywhere; an empty table gives no rows. Other columns are not read. What the
driver and each worker hold is bounded: HEAD words of 16 bytes, the model, and letter
pairs. The averaged model depends on how the input is split into partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as K
from lexiloom.llm.common import arrow, cut

#: Words with symbols of their own: at least, and at most.
SYMBOLS = (1024, 4096)
DIM, CONTEXT = 16, 2
#: Words that every worker knows.
HEAD = 1 << 17
#: Grades of counts for each doubling, by which words that can't be in the head are left out.
GRADES = 64
#: Words that occur less often are spelled.
LEAST = 2
#: Longest words of the classes of words beyond the head; the last class has no end.
LENGTHS = np.array([4, 6, 8, 10, 12, 15])
CLASSES = len(LENGTHS) + 1
#: Letter pairs are counted as left << SHIFT | right; EDGE stands before and after a word.
SHIFT, EDGE = 21, 0
NOISE, BATCH, RATE = 64, 1024, 0.1
HELD_WORDS = 2_000_000
#: Code points scored at a time: the more, the more words share a context.
CHUNK = 1 << 21
#: Contexts whose sums each worker keeps, at most: a table of 4 bytes each.
TABLE = 1 << 25
#: Words at a time, and scores that stay in the cache while they are summed.
STEP, CACHED = 1 << 16, 1 << 17
#: Scores nearer to 0 than this are summed as they are.
UNSHIFTED = 60.0
SEED = 5


class Model(NamedTuple):
    inner: np.ndarray  # (vocabulary + 1, dim): context vectors; the last is the text's beginning
    scale: np.ndarray  # (context, dim): the diagonal for each distance
    outer: np.ndarray  # (vocabulary, dim)
    bias: np.ndarray  # (vocabulary,)


class Words(NamedTuple):
    hashes: np.ndarray  # of the head, sorted
    ids: np.ndarray  # from CLASSES on by falling frequency, then one for each power of two of the count; lower ones are classes of length
    share: np.ndarray  # unigram share by id
    within: np.ndarray | None = None  # log-probability of the word given its id, 0 where it has its own

    def find(self, hashes: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and log-probabilities within them (0 for words beyond the head: those come from the table of counts)."""
        classes = length_class(sizes) if sizes is not None else np.zeros(len(hashes), np.int64)
        if not len(self.hashes):
            return classes, np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        return np.where(known, self.ids[at], classes).astype(np.int64), np.zeros(len(hashes)) if self.within is None else np.where(known, self.within[at], 0.0)


class Tail(NamedTuple):
    counts: DataFrame  # (h, n) of the words beyond the head that occur LEAST times
    mass: list[int]  # words of each class of length beyond the head
    single: list[int]  # those of them that are spelled


def length_class(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, sizes, "left")


class Letters(NamedTuple):
    pairs: np.ndarray  # sorted
    counts: np.ndarray
    lefts: np.ndarray  # letters with followers, sorted
    left_counts: np.ndarray
    rights: np.ndarray  # letters that follow, sorted
    right_counts: np.ndarray


def _counted(keys: np.ndarray, counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(of))
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    return np.where(keys[at] == of, counts[at], 0.0)


def letters(pairs: np.ndarray, counts: np.ndarray) -> Letters:
    order = np.argsort(pairs)
    pairs, counts = pairs[order], counts[order].astype(float)
    sides = []
    for side in (pairs >> SHIFT, pairs & ((1 << SHIFT) - 1)):
        keys, inverse = np.unique(side, return_inverse=True)
        sides += [keys, np.bincount(inverse, counts, len(keys))]
    return Letters(pairs, counts, *sides)


def letter_pairs(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letter pairs of words, edges included, word by word, and each word's first pair."""
    n = ends - starts
    firsts = np.cumsum(n + 1) - (n + 1)
    word = np.repeat(np.arange(len(n)), n + 1)
    at = np.arange(len(word)) - firsts[word] + starts[word]
    left = np.where(at > starts[word], folded[np.maximum(at - 1, 0)], EDGE).astype(np.int64)
    right = np.where(at < ends[word], folded[np.minimum(at, len(folded) - 1)], EDGE).astype(np.int64)
    return left << SHIFT | right, firsts


def spelled(model: Letters, pairs: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The log-probability of each word's letters; letters never seen share one count with all code points."""
    if not len(firsts):
        return np.zeros(0)
    one = (_counted(model.rights, model.right_counts, pairs & ((1 << SHIFT) - 1)) + 1 / (1 << SHIFT)) / (model.counts.sum() + 1)
    both = (_counted(model.pairs, model.counts, pairs) + one) / (_counted(model.lefts, model.left_counts, pairs >> SHIFT) + 1)
    return np.add.reduceat(np.log(both), firsts)


def _symbols(texts: list[str], words: Words) -> tuple[K.Tokens, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Tokens, their ids, log-probabilities within these; the places and letter pairs of words beyond the head."""
    tokens, _, folded, bounds = K.tokenize_points(texts)
    ids, within = words.find(tokens.hashes, tokens.ends - tokens.starts)
    odd = np.flatnonzero(ids < CLASSES)
    base = bounds[np.searchsorted(tokens.offsets, odd, "right") - 1]
    return tokens, ids, within, odd, letter_pairs(folded, tokens.starts[odd] + base, tokens.ends[odd] + base)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c, n): words, their classes of length, and how often they occur in a part of the corpus."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values, first, inverse = np.unique(np.concatenate([h for h, _, _ in held]), return_index=True, return_inverse=True)
        return values, np.concatenate([c for _, c, _ in held])[first], np.bincount(inverse, np.concatenate([n for _, _, n in held]), len(values)).astype(np.int64)

    def pack(values: np.ndarray, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n)], names=["h", "c", "n"])

    size = 0
    for batch in batches:
        for _, _, texts in K.chunks(batch.column(0)):
            tokens = K.tokenize(texts)
            values, first, n = np.unique(tokens.hashes, return_index=True, return_counts=True)
            held.append((values, length_class((tokens.ends - tokens.starts)[first]), n))
            size += len(values)
            if size > HELD_WORDS:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD_WORDS // 2:
                    yield pack(*held[0])
                    held, size = [], 0
    if held:
        yield pack(*merged())


def _frequent(counts: DataFrame, head: int) -> DataFrame:
    """The words among which the head must be: without the others, which each partition would send to the one task that sorts, if it has few words of the head."""
    grade = F.floor(F.log2(F.col("n").cast("double")) * GRADES)
    words = {r["g"]: r["c"] for r in counts.where(F.col("n") >= LEAST).groupBy(grade.alias("g")).agg(F.count("*").alias("c")).collect()}
    above, least = 0, None
    for g in sorted(words, reverse=True):
        above, least = above + words[g], g
        if above >= head:
            break
    some = counts.where(F.col("n") >= LEAST)
    return some if least is None else some.where(grade >= least)


def vocabulary(documents: DataFrame, size: int | None = None, head: int = HEAD) -> tuple[Words, Tail]:
    """The head of all words that occur LEAST times, size of them with ids of their own at most; and the table of the others."""
    counts = arrow(documents.select("text").where("text is not null"), _count, "h bigint, c int, n bigint")
    counts = cut(counts.groupBy("h").agg(F.max("c").alias("c"), F.sum("n").alias("n")))
    distinct = counts.count()
    size = size or min(max(SYMBOLS[0], math.isqrt(distinct)), SYMBOLS[1])
    known = _frequent(counts, head).orderBy(F.desc("n"), "h").limit(head).toArrow()
    hashes, n = (known.column(c).to_numpy() for c in ("h", "n"))
    beyond = f"n < {n[-1]} or (n = {n[-1]} and h > {hashes[-1]})" if len(n) else "true"
    rest = {r["c"]: r for r in counts.where(beyond).groupBy("c").agg(F.sum("n").alias("mass"), F.sum(F.when(F.col("n") < LEAST, F.col("n")).otherwise(0)).alias("single")).collect()}
    tail = Tail(counts.where(beyond).where(F.col("n") >= LEAST).select("h", "n"), *([rest[c][k] if c in rest else 0 for c in range(CLASSES)] for k in ("mass", "single")))
    own, m = min(size, len(n)), n[size:]
    powers, band = np.unique(np.frexp(m)[1], return_inverse=True)
    mass = np.bincount(band, m, len(powers))
    share = np.array([*tail.mass, *n[:own], *mass], float)
    ids = CLASSES + np.concatenate([np.arange(own), own + band]).astype(np.int32)
    within = np.concatenate([np.zeros(own), np.log(m / mass[band])]).astype(np.float32)
    hashes = hashes.view(np.uint64)
    order = np.argsort(hashes)
    return Words(hashes[order], ids[order], (share + 1) / (share + 1).sum(), within[order]), tail


def start(words: Words, dim: int = DIM, seed: int = SEED) -> Model:
    """The common start: small vectors, and biases at which the model is the unigram one."""
    rng = np.random.default_rng(seed)
    n = len(words.share)
    inner = rng.normal(0, 0.3, (n + 1, dim)).astype(np.float32)
    scale = np.ones((CONTEXT, dim), np.float32) / np.arange(1, CONTEXT + 1, dtype=np.float32)[:, None]
    outer = rng.normal(0, 0.05, (n, dim)).astype(np.float32)
    return Model(inner, scale, outer, np.log(words.share).astype(np.float32))


def contexts(ids: np.ndarray, offsets: np.ndarray, beginning: int) -> np.ndarray:
    """(words, CONTEXT): the ids before each word, nearest first; beginning before the first word of a text."""
    at = np.arange(len(ids)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = np.full((len(ids), CONTEXT), beginning, np.int64)
    for d in range(1, CONTEXT + 1):
        far = np.flatnonzero(at >= d)
        out[far, d - 1] = ids[far - d]
    return out


class Trainer:
    """Noise-contrastive estimation by Adagrad; noise words are drawn once for each minibatch."""

    def __init__(self, model: Model, share: np.ndarray, seed: int = SEED):
        self.parts = [p.copy() for p in model]
        self.past = [np.full(p.shape, 0.1, np.float32) for p in self.parts]
        self.log_noise = np.log(share * NOISE).astype(np.float32)
        self.edges = np.cumsum(share)
        self.rng = np.random.default_rng(seed)
        self.seen, self.place = np.zeros(len(model.inner), bool), np.zeros(len(model.inner), np.int64)
        self.words = 0

    def feed(self, ids: np.ndarray, before: np.ndarray) -> None:
        for lo in range(0, len(ids), BATCH):
            self._step(ids[lo : lo + BATCH], before[lo : lo + BATCH])
        self.words += len(ids)

    def _step(self, target: np.ndarray, before: np.ndarray) -> None:
        inner, scale, outer, bias = self.parts
        n, dim = len(target), outer.shape[1]
        vectors = [inner[before[:, d]] for d in range(CONTEXT)]
        q = vectors[0] * scale[0]
        for d in range(1, CONTEXT):
            q += vectors[d] * scale[d]
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), len(self.edges) - 1)
        out = outer[target]
        real = np.einsum("ij,ij->i", q, out) + bias[target] - self.log_noise[target]
        fake = q @ outer[noise].T + (bias[noise] - self.log_noise[noise])
        g = -1 / (1 + np.exp(np.clip(real, -30, 30)))
        m = 1 / (1 + np.exp(-np.clip(fake, -30, 30)))
        dq = g[:, None] * out + m @ outer[noise]
        cells = np.arange(dim)

        def spread(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
            at = (rows[:, None] * dim + cells).ravel()
            return np.bincount(at, values.ravel(), size * dim).reshape(size, dim)

        # Rows that the minibatch doesn't meet have no gradient, and Adagrad leaves them as they are.
        met, at = self._met(np.concatenate([target, noise]))
        d_outer = spread(at, np.concatenate([g[:, None] * q, m.T @ q]), len(met))
        d_bias = np.bincount(at, np.concatenate([g, m.sum(0)]), len(met))
        came, at = self._met(before.T.ravel())
        d_inner = spread(at, np.concatenate([dq * x for x in scale]), len(came))
        d_scale = np.stack([np.einsum("ij,ij->j", dq, x) for x in vectors])
        for p, h, x, rows in zip(self.parts, self.past, (d_inner, d_scale, d_outer, d_bias), (came, slice(None), met, met)):
            x = (x / n).astype(np.float32) * 64
            past = h[rows] + x * x
            h[rows] = past
            p[rows] -= RATE * x / np.sqrt(past)

    def _met(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct rows, sorted, and the place of each among them."""
        self.seen[rows] = True
        met = np.flatnonzero(self.seen)
        self.seen[met] = False
        self.place[met] = np.arange(len(met))
        return met, self.place[rows]

    def model(self) -> Model:
        return Model(*self.parts)


def _flat(model: Model) -> np.ndarray:
    return np.concatenate([p.ravel() for p in model]).astype(np.float64)


def _shaped(flat: np.ndarray, like: Model) -> Model:
    parts, at = [], 0
    for p in like:
        parts.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
        at += p.size
    return Model(*parts)


def _trainer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = shared.value
        trainer = Trainer(model, words.share)
        pairs, counts = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            for _, _, texts in K.chunks(batch.column(0)):
                tokens, ids, _, _, (own, _) = _symbols(texts, words)
                trainer.feed(ids, contexts(ids, tokens.offsets, len(words.share)))
                own, n = np.unique(own, return_counts=True)
                pairs, inverse = np.unique(np.concatenate([pairs, own]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([counts, n]), len(pairs))
        if trainer.words:
            flat = _flat(trainer.model()) * trainer.words
            slots = np.concatenate([np.arange(len(flat) + 1, dtype=np.int64), -1 - pairs])
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.concatenate([flat, [trainer.words], counts]))], names=["slot", "x"])

    return run


def fitted(documents: DataFrame, words: Words) -> tuple[Model, Letters]:
    """One model from all documents, the average of what their partitions learn; and the letters of words beyond the head."""
    model = start(words)
    shared = documents.sparkSession.sparkContext.broadcast((words, model))
    sums = arrow(documents.select("text").where("text is not null"), _trainer(shared), "slot bigint, x double")
    # As many rows as the model has parameters and the corpus pairs of letters; slots of pairs are negative.
    rows = sums.groupBy("slot").agg(F.sum("x").alias("x")).toArrow()
    slot, x = (rows.column(c).to_numpy() for c in ("slot", "x"))
    own = slot >= 0
    spelling = letters(-1 - slot[~own], x[~own])
    if not own.any():
        return model, spelling
    flat = np.zeros(int(own.sum()))
    flat[slot[own]] = x[own]
    return _shaped(flat[:-1] / flat[-1], model), spelling


def fit(documents: DataFrame, words: Words) -> Model:
    return fitted(documents, words)[0]


class Norms:
    """The logarithms of the sums of exponentials of contexts, each computed once as long as the table of all contexts has TABLE cells at most."""

    def __init__(self, model: Model):
        self.model, self.base = model, len(model.inner)
        cells = self.base**CONTEXT
        self.known = np.zeros(cells, np.float32) if cells <= TABLE else None  # 0: not yet known, or computed again
        self.outer = np.ascontiguousarray(np.concatenate([model.outer, model.bias[:, None]], 1).T)
        self.reach = float(np.sqrt((model.outer.astype(float) ** 2).sum(1)).max()), float(np.abs(model.bias).max())

    def of(self, before: np.ndarray) -> np.ndarray:
        key = before[:, 0].copy()
        for d in range(1, CONTEXT):
            key = key * self.base + before[:, d]
        if self.known is None:
            distinct, which = np.unique(key, return_inverse=True)
            return self.computed(distinct)[which]
        new = np.unique(key[self.known[key] == 0])
        self.known[new] = self.computed(new)
        return self.known[key]

    def computed(self, keys: np.ndarray) -> np.ndarray:
        norm = np.empty(len(keys), np.float32)
        step = max(16, CACHED // self.outer.shape[1])
        room, ones = np.empty((step, self.outer.shape[1]), np.float32), np.ones(self.outer.shape[1], np.float32)
        for from_ in range(0, len(keys), STEP):
            rest = keys[from_ : from_ + STEP]
            q = np.ones((len(rest), len(self.outer)), np.float32)
            q[:, :-1] = 0
            for d in range(CONTEXT - 1, -1, -1):
                q[:, :-1] += self.model.inner[rest % self.base] * self.model.scale[d]
                rest = rest // self.base
            # No score is further from 0 than this; where exponentials can't leave the range of float32, none is shifted by its row's largest.
            far = math.sqrt(float((q[:, :-1].astype(float) ** 2).sum(1).max())) * self.reach[0] + self.reach[1]
            for lo in range(0, len(q), step):
                part = q[lo : lo + step]
                s = np.matmul(part, self.outer, out=room[: len(part)])
                top = s.max(1) if far > UNSHIFTED else np.float32(0)
                if far > UNSHIFTED:
                    s -= top[:, None]
                np.exp(s, out=s)
                norm[from_ + lo : from_ + lo + len(part)] = np.log(s @ ones) + top
        return norm


def log_probs(model: Model, ids: np.ndarray, before: np.ndarray, norms: Norms | None = None) -> np.ndarray:
    """The normalised log-probability of each word; norms has those of the contexts that were met before."""
    norms = norms or Norms(model)
    out = np.zeros(len(ids))
    for lo in range(0, len(ids), STEP):
        own, b = ids[lo : lo + STEP], before[lo : lo + STEP]
        q = sum(model.inner[b[:, d]] * model.scale[d] for d in range(CONTEXT))
        out[lo : lo + STEP] = (q * model.outer[own]).sum(1) + model.bias[own] - norms.of(b)
    return out


def _scorer(shared):
    """(row, doc_id, tokens, base, tail): the log-probability of the symbols, and the words beyond the head, each once in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (model, spelling) = shared.value
        norms = Norms(model)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, texts in K.chunks(batch.column(1), CHUNK):
                tokens, own, within, odd, parts = _symbols(texts, words)
                each = log_probs(model, own, contexts(own, tokens.offsets, len(words.share)), norms) + within
                sums = np.concatenate([[0], np.cumsum(each, dtype=np.float64)])
                base = sums[tokens.offsets[1:]] - sums[tokens.offsets[:-1]]
                letters = spelled(spelling, *parts)
                doc, h = np.searchsorted(tokens.offsets, odd, "right") - 1, tokens.hashes[odd].view(np.int64)
                order = np.lexsort((h, doc))
                new = np.ones(len(odd), bool)
                new[1:] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1])
                firsts = np.flatnonzero(new)
                at = order[firsts]
                tail = pa.StructArray.from_arrays(
                    [pa.array(h[at]), pa.array(own[odd][at].astype(np.int32)), pa.array(np.diff(np.append(firsts, len(odd)))), pa.array(letters[at])], names=["h", "c", "k", "spelled"]
                )
                offsets = np.searchsorted(doc[at], np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + hi - lo)), ids.slice(lo, hi - lo), pa.array(tokens.counts().astype(np.int64)), pa.array(base), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), tail)],
                    names=["row", "doc_id", "tokens", "base", "tail"],
                )
                row += hi - lo

    return run


def _scored(docs: DataFrame, words: Words, tail: Tail, model: Model, spelling: Letters) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((words, (model, spelling)))
    parts = arrow(docs, _scorer(shared), "row bigint, doc_id bigint, tokens bigint, base double, tail array<struct<h:bigint,c:int,k:bigint,spelled:double>>")
    parts = cut(parts)  # rows are numbered once
    log = lambda values: F.array(*[F.lit(math.log(v) if v else 0.0) for v in values])
    each = parts.select("row", F.inline("tail")).join(tail.counts, "h", "left")
    alone = F.col("n").isNull()
    within = F.when(alone, F.get(log(tail.single), "c") + F.col("spelled")).otherwise(F.log(F.col("n").cast("double"))) - F.get(log(tail.mass), "c")
    sums = each.groupBy("row").agg(F.sum(F.col("k") * within).alias("more"), F.sum(F.when(alone, F.col("k")).otherwise(0)).alias("unknown"))
    total = F.round(F.col("base") + F.coalesce("more", F.lit(0.0)), 4) + F.lit(0.0)
    whole = parts.select("row", "doc_id", "tokens", "base").join(sums, "row", "left").select("doc_id", "tokens", F.coalesce("unknown", F.lit(0)).alias("unknown"), total.alias("log_prob"))
    return whole.withColumn("perplexity", F.when(F.col("tokens") > 0, F.round(F.exp(-F.col("log_prob") / F.col("tokens")), 4)))


def lm_scores(documents: DataFrame, head: int = HEAD) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    words, tail = vocabulary(docs, head=head)
    return _scored(docs, words, tail, *fitted(docs, words))
