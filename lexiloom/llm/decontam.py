"""Operator 7: benchmark decontamination by SimHash over item-sized windows.

A shingle is two consecutive words and weighs the number of their letters. An item
of L words is compared with the windows of L words at every position of a document
(the whole document where that is shorter).

1. Exact screen: weighted Jaccard similarity of at least t needs shared weight of
   at least t / (1 + t) times both weights. Prefix sums of the weight that items of
   L words know bound what a window can share, so windows below the bound are
   dropped without loss. Only the rest are fingerprinted.
2. 64-bit SimHash of each remaining window, by prefix sums; multi-index blocks: the
   fingerprint is cut into BLOCKS blocks, and an item is met where one block of the
   two differs by RADIUS // BLOCKS bits at most. By the pigeonhole principle no item
   within RADIUS bits is missed; those beyond it are dropped by their whole distance.
3. The items within the radius are verified by exact weighted Jaccard similarity of
   the two bags of shingles.

The benchmark is broadcast in slices of at most about SLICE_WORDS words (some 100 MB),
one pass over the documents for each, so what is broadcast doesn't grow with it. A pass
is one narrow stage: windows live and die in the task that made them, and only
matches leave it, the best of each document and item.

Result: (doc_id, item_id, start, similarity), the best window for each pair, the
first of equal ones; start counts words from 0.

Defined cases: null doc_id, item_id or text: not compared. An item of one word has no
shingle, so it is in no document; any other is searched (min_words is a parameter).
decontaminate drops no document for an item of fewer than DROP_WORDS words, which any
text may hold. Repeated rows give one result row; different texts under one id are all
compared, and their best window counts. Texts of any length are compared whole. Empty
tables give no rows. Other columns are not read by contaminated and pass through
decontaminate, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as K
from lexiloom.llm.common import arrow, cut, without

SHINGLE = 2
BLOCKS, RADIUS = 4, 19
THRESHOLD = 0.5
MIN_WORDS, DROP_WORDS = 1, 5
SLICE_WORDS = 2_000_000
#: Cells of the table of windows and items that are compared at a time.
CELLS = 1 << 22


_BLOCK = np.dtype(f"<u{8 // BLOCKS}")


def weighted_grams(tokens: K.Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash and weight of the k words at each token; runs that leave the text weigh 0."""
    n = len(tokens.hashes)
    hashes, weights = np.zeros(n, np.uint64), np.zeros(n, np.int32)
    if n >= k:
        rolled = tokens.hashes[: n - k + 1].copy()
        letters = (tokens.ends - tokens.starts).astype(np.int32)
        total = letters[: n - k + 1].copy()
        for j in range(1, k):
            rolled *= np.uint64(0xD6E8FEB86659FD93)
            rolled += tokens.hashes[j : n - k + 1 + j]
            total += letters[j : n - k + 1 + j]
        hashes[: n - k + 1] = K.mix(rolled)
        weights[: n - k + 1] = total
    for j in range(1, k):
        at = tokens.offsets[1:] - j
        weights[at[(at >= tokens.offsets[:-1]) & (at >= 0)]] = 0
    return hashes, weights


def simhash(hashes: np.ndarray, weights: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows [first, last) of shingles; ties count as 1.

    A window's sum for each bit is a difference of two prefix sums over the shingles
    that any window covers, so it costs the same for windows of any length.
    """
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, firsts, 1)
    np.add.at(cover, lasts, -1)
    inside = np.cumsum(cover[:-1]) > 0
    place = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(inside, out=place[1:])
    a, b = place[firsts], place[lasts]
    octets = hashes[inside].view(np.uint8).reshape(-1, 8)
    own = weights[inside].astype(np.int64)[:, None]
    out = np.empty((len(firsts), 8), np.uint8)
    for j in range(8):
        sums = np.zeros((len(own) + 1, 8), np.int64)
        bits = np.unpackbits(octets[:, j : j + 1], axis=1, bitorder="little").astype(np.int64)
        np.cumsum((2 * bits - 1) * own, axis=0, out=sums[1:])
        out[:, j] = np.packbits(sums[b] >= sums[a], axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64).ravel()


def bag(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and the weight of all their occurrences."""
    keep = weights > 0
    values, first, counts = np.unique(hashes[keep], return_index=True, return_counts=True)
    return values, weights[keep][first] * counts


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum())
    total = float(a[1].sum() + b[1].sum()) - shared
    return shared / total if total else 0.0


class _Items:
    """One slice of the benchmark: the shingles, fingerprints and bags of its items, by length of item."""

    def __init__(self, ids: list[int], texts: list[str], shingle: int, threshold: float, radius: int):
        tokens = K.tokenize(texts)
        hashes, weights = weighted_grams(tokens, shingle)
        lengths = tokens.counts()
        firsts, lasts = tokens.offsets[:-1], tokens.offsets[1:]
        self.shingle, self.threshold, self.radius = shingle, threshold, radius
        self.ids = np.array(ids, np.int64)
        self.lengths, classes = np.unique(lengths, return_inverse=True)
        self.of_class = [np.flatnonzero(classes == x) for x in range(len(self.lengths))]
        whole = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
        sums = whole[lasts] - whole[firsts]
        self.least = [int(sums[own].min()) for own in self.of_class]
        self.prints = simhash(hashes, weights, firsts, np.maximum(lasts - (shingle - 1), firsts + 1))
        self.bags = [bag(hashes[a:b], weights[a:b]) for a, b in zip(firsts.tolist(), lasts.tolist())]
        known, of = hashes[weights > 0], np.repeat(classes, lengths)[weights > 0]
        order = np.lexsort((of, known))
        known, of = known[order], of[order]
        new = np.ones(len(known), bool)
        new[1:] = (known[1:] != known[:-1]) | (of[1:] != of[:-1])
        self.hashes, self.classes = known[new], of[new]
        self.mask = np.uint64((1 << min(max((8 * len(self.hashes)).bit_length(), 20), 26)) - 1)
        self.screen = np.zeros(int(self.mask) + 1, bool)
        self.screen[(self.hashes & self.mask).astype(np.int64)] = True

    def near(self, prints: np.ndarray, x: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of the items of class x within the radius of each fingerprint, through blocks."""
        own = self.of_class[x]
        theirs = self.prints[own]
        rows, items = [], []
        for lo in range(0, len(prints), max(1, CELLS // len(own))):
            part = prints[lo : lo + max(1, CELLS // len(own))]
            met = np.zeros((len(part), len(own)), bool)
            blocks, reach = np.ascontiguousarray(part).view(_BLOCK).reshape(-1, BLOCKS), self.radius // BLOCKS
            for b in range(BLOCKS):
                values, which = np.unique(blocks[:, b], return_inverse=True)
                met |= (np.bitwise_count(values[:, None] ^ theirs.view(_BLOCK).reshape(-1, BLOCKS)[:, b]) <= reach)[which]
            w, i = np.nonzero(met)
            within = np.bitwise_count(part[w] ^ theirs[i]) <= self.radius
            rows.append(w[within] + lo)
            items.append(own[i[within]])
        return (np.concatenate(rows), np.concatenate(items)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def windows(self, tokens: K.Tokens, hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, first token, last + 1, length class) of the windows that pass the bound."""
        at = np.flatnonzero(self.screen[(hashes & self.mask).astype(np.int64)] & (weights > 0))
        lo = np.searchsorted(self.hashes, hashes[at], "left")
        n = np.searchsorted(self.hashes, hashes[at], "right") - lo
        at = np.repeat(at, n)
        ends = np.cumsum(n)
        classes = self.classes[np.arange(len(at)) + np.repeat(lo - (ends - n), n)]
        order = np.argsort(classes, kind="stable")
        at, classes = at[order], classes[order]
        cuts = np.searchsorted(classes, np.arange(len(self.lengths) + 1))
        whole = np.zeros(len(weights) + 1, np.int64)
        np.cumsum(weights, out=whole[1:])
        found = []
        share = self.threshold / (1 + self.threshold)
        doc_of = lambda x: np.searchsorted(tokens.offsets, x, "right") - 1
        for x, length in enumerate(self.lengths.tolist()):
            hits = at[cuts[x] : cuts[x + 1]]
            if not len(hits):
                continue
            known = np.zeros(len(weights) + 1, np.int64)
            known[hits + 1] = weights[hits]
            np.cumsum(known, out=known)
            # Starts whose window holds a hit: up to length - 1 tokens before one.
            begin = hits - (length - 1)
            begin[1:] = np.maximum(begin[1:], hits[:-1] + 1)
            n = hits - begin + 1
            ends = np.cumsum(n)
            first = np.arange(ends[-1]) + np.repeat(begin - (ends - n), n)
            near = np.repeat(doc_of(hits), n)
            low = tokens.offsets[near]
            high = np.maximum(tokens.offsets[near + 1] - length, low)
            # Windows that would leave the text move to its ends.
            first = np.minimum(np.maximum(first, low), high)
            key, which = np.unique(first, return_index=True)
            first, near = key, near[which]
            last = np.minimum(first + length, tokens.offsets[near + 1])
            inner = np.maximum(last - (self.shingle - 1), first)
            shared = known[inner] - known[first]
            good = shared >= share * (whole[inner] - whole[first] + self.least[x]) - 1e-9
            found.append((near[good], first[good], last[good], np.full(int(good.sum()), x)))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def similarities(item: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """similarity() of an item's bag with each of several windows, whose shingles follow one another."""
    known, mass = item
    row = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(row, weights, len(sizes))
    if not len(known):
        return np.zeros(len(sizes))
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = (known[at] == hashes) & (weights > 0)
    key, inverse = np.unique(row[hit] * len(known) + at[hit], return_inverse=True)
    both = np.minimum(np.bincount(inverse, weights[hit], len(key)), mass[key % len(known)])
    shared = np.bincount(key // len(known), both, len(sizes))
    return shared / np.maximum(total + mass.sum() - shared, 1)


def matches(items: _Items, tokens: K.Tokens) -> tuple[np.ndarray, ...]:
    """(text, item, first token, similarity): the best window of each text and item, among those that reach the threshold."""
    k = items.shingle
    hashes, weights = weighted_grams(tokens, k)
    doc, first, last, x = items.windows(tokens, hashes, weights)
    inner = np.maximum(last - (k - 1), first + 1)
    prints = simhash(hashes, weights, first, inner)
    found = []
    cuts = np.searchsorted(x, np.arange(len(items.lengths) + 1))  # windows come class by class
    for c in np.flatnonzero(np.diff(cuts)).tolist():
        w, i = items.near(prints[cuts[c] : cuts[c + 1]], c)
        w += cuts[c]
        order = np.argsort(i, kind="stable")
        w, i = w[order], i[order]
        edges = np.flatnonzero(np.diff(i)) + 1
        for own in np.split(np.arange(len(i)), edges) if len(i) else ():
            rows = w[own]
            n = inner[rows] - first[rows]
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(first[rows] - (ends - n), n)
            s = similarities(items.bags[i[own[0]]], hashes[at], weights[at], n)
            good = s >= items.threshold - 1e-12
            found.append((doc[rows[good]], i[own[good]], first[rows[good]] - tokens.offsets[doc[rows[good]]], s[good]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    doc, item, start, s = (np.concatenate([f[j] for f in found]) for j in range(4))
    order = np.lexsort((start, -s, item, doc))
    doc, item, start, s = doc[order], item[order], start[order], s[order]
    best = np.ones(len(doc), bool)
    best[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    return doc[best], item[best], start[best], s[best]


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _, texts in K.chunks(batch.column(1)):
                doc, item, start, s = matches(items, K.tokenize(texts))
                if len(doc):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[lo + doc]), pa.array(items.ids[item]), pa.array(start), pa.array(s)], names=["doc_id", "item_id", "start", "similarity"]
                    )

    return run


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    threshold: float = THRESHOLD,
    radius: int = RADIUS,
    min_words: int = MIN_WORDS,
    slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """(doc_id, item_id, start, similarity) of every document and item that it holds."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")
    items = items.distinct()
    letters = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, -(-letters // (slice_words * 4)))
    out = None
    for s in range(slices):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s) if slices > 1 else items
        rows = own.orderBy("item_id", "text").collect()  # at most about slice_words words
        counts = K.tokenize([r[1] for r in rows]).counts() if rows else []
        rows = [r for r, n in zip(rows, counts) if n >= max(min_words, 1)]
        if not rows:
            continue
        known = spark.sparkContext.broadcast(_Items([r[0] for r in rows], [r[1] for r in rows], SHINGLE, threshold, radius))
        good = arrow(docs, _finder(known), "doc_id bigint, item_id bigint, start bigint, similarity double")
        out = good if out is None else out.union(good)
    if out is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, start bigint, similarity double")
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.s")).alias("start"), F.col("b.similarity").alias("similarity"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, min_words: int = DROP_WORDS, **parameters) -> DataFrame:
    """The documents that hold no benchmark item; all columns, rows with null doc_id included."""
    held = cut(contaminated(documents, benchmark, min_words=min_words, **parameters).select("doc_id").distinct())
    return without(documents, "doc_id", held)
