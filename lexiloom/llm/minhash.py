"""Operator 1: near-duplicate groups by circulant MinHash.

Two fixed permutations of the 2^32 numbers: sigma scatters a document's word shingles,
and coordinate k of the signature is min over shingles of pi(sigma(s) + k), so one
circularly shifted pi gives all coordinates. Both are bijective mixers, so they take no
tables, and no text can have so many shingles that it fills their range.

1. One pass over the texts gives a 128-bit identity of the word sequence and
   BANDS band hashes. Copies with equal words collapse to their least doc_id here,
   so a group of any number of exact copies costs one row from now on.
2. Documents that share a band hash are linked to the least doc_id of that band:
   as many links as members. Connected components of the links bound where
   verification must look.
3. Only documents of such components send their shingle sets. Within a component
   a breadth-first search verifies exact Jaccard similarity of pairs that share a
   band; documents already reached need no further pairs, so tight groups take
   one round. Components of more than LOCAL_SHINGLES shingles or LOCAL_DOCUMENTS
   documents are verified by joins instead, with the same result: each band's members
   against its least one, then those that aren't similar to it against the others. A pair
   whose similarities to that one differ by more than the threshold allows can't be
   similar (one less Jaccard is a metric), and pairs that it links both are connected, so
   the members of a tight group are never paired with each other.

Result: (doc_id, group_id, keep) for every document of a group of two or more;
group_id is the least doc_id, which is the one kept.

Defined cases: null doc_id: never grouped. Null or word-less text: never grouped.
Texts shorter than a shingle: one shingle of all their words. Texts of any length are
hashed whole. Rows that repeat a doc_id are one document: they share its decision; they
are never paired with each other, but the shingles that the rows of one doc_id had before
a cut are held by one task (near_dedup with before). Ties
cannot arise: groups are connected components. An empty table gives no rows. Other
columns are not read by near_duplicate_groups and pass through near_dedup, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as K
from lexiloom.llm.common import arrow, components, cut, maybe_in, without

SHINGLE = 3
#: Pairs of the threshold share a band with probability 1 - (1 - 0.5 ** 4) ** 40 = 0.92.
BANDS, ROWS = 40, 4
THRESHOLD = 0.5
#: Share of shingles that a cut text has in common with what it was cut from.
DERIVED = 0.8
#: Shingles and documents of a component that one task verifies, at most.
LOCAL_SHINGLES, LOCAL_DOCUMENTS = 10_000_000, 50_000
#: Shingles whose coordinates are made at a time, so that they stay in the cache.
STEP = 1024
SEED = 20_240_229


def sigma(values: np.ndarray) -> np.ndarray:
    """The first permutation, on the upper half of mixed shingle hashes."""
    return (K.mix(values ^ np.uint64(SEED)) >> np.uint64(32)).astype(np.uint32)


def pi(x: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
    """The second permutation, a bijective mixer of 32 bits; changes x in place and returns it."""
    spare = np.empty_like(x) if spare is None else spare
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1)):
        np.right_shift(x, np.uint32(shift), out=spare)
        x ^= spare
        if factor > 1:
            x *= np.uint32(factor)
    return x


def signatures(values: np.ndarray, offsets: np.ndarray, width: int = BANDS * ROWS) -> np.ndarray:
    """(documents, width) minima; documents without shingles get the largest value."""
    n = np.diff(offsets)
    out = np.full((len(n), width), np.uint32(0xFFFFFFFF))
    at, shifts = sigma(values), np.arange(width, dtype=np.uint32)
    room, spare = np.empty((STEP, width), np.uint32), np.empty((STEP, width), np.uint32)
    for lo in range(0, len(at), STEP):
        hi = min(lo + STEP, len(at))
        x = np.add(at[lo:hi, None], shifts, out=room[: hi - lo])
        first = np.searchsorted(offsets, lo, "right") - 1
        last = np.searchsorted(offsets, hi, "left") - 1
        docs = np.arange(first, last + 1)
        docs = docs[n[docs] > 0]
        cuts = np.maximum(offsets[docs], lo) - lo
        low = np.minimum.reduceat(pi(x, spare[: hi - lo]), cuts, axis=0)
        out[docs] = np.minimum(out[docs], low)
    return out


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    s = signature.astype(np.uint64).reshape(len(signature), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(48), s.shape[:2]).copy()
    for r in range(rows):
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h += s[:, :, r]
        K.mix(h)
    return h.view(np.int64)


def _identity(tokens: K.Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    n = tokens.counts()
    at = (np.arange(len(tokens.hashes)) - np.repeat(tokens.offsets[:-1], n)).astype(np.uint64)
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        sums = np.zeros(len(at) + 1, np.uint64)
        np.cumsum(K.mix(tokens.hashes ^ K.mix(at + np.uint64(salt))), out=sums[1:])
        out.append(K.mix(sums[tokens.offsets[1:]] - sums[tokens.offsets[:-1]] + n.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _signer(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, texts in K.chunks(batch.column(1)):
                tokens = K.tokenize(texts)
                some = tokens.counts() > 0
                values, offsets = K.distinct(*K.grams(tokens, shingle))
                hashes = band_hashes(signatures(values, offsets, bands * rows), bands, rows)[some]
                a, b = _identity(tokens)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo).filter(pa.array(some)),
                        pa.array(a[some]),
                        pa.array(b[some]),
                        pa.array(np.diff(offsets)[some]),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(hashes) + 1, dtype=np.int32) * bands), pa.array(hashes.ravel())),
                    ],
                    names=["id", "fa", "fb", "n", "bands"],
                )

    return run


def _set_maker(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, texts in K.chunks(batch.column(1)):
                tokens = K.tokenize(texts)
                values, offsets = K.distinct(*K.grams(tokens, shingle))
                data = values.tobytes()
                sets = [data[8 * x : 8 * y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *map(pa.array, _identity(tokens)), pa.array(sets, pa.binary())], names=["id", "fa", "fb", "words"])

    return run


def verified(ids: np.ndarray, sets: list[np.ndarray], bands: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """(id, least id of its group) for groups of two or more, by breadth-first search."""
    order = np.argsort(ids, kind="stable")
    sizes = np.array([len(s) for s in sets])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    local, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(local), bool)
    left = np.ones(len(ids), bool)
    _, bucket = np.unique(bands.ravel(), return_inverse=True)
    bucket = bucket.reshape(bands.shape)
    listed = np.argsort(bucket.ravel(), kind="stable")
    members = np.split(listed // bands.shape[1], np.cumsum(np.bincount(bucket.ravel()))[:-1])
    out = []
    for start in order.tolist():
        if not left[start]:
            continue
        left[start] = False
        group, queue = [start], [start]
        while queue:
            p = queue.pop()
            for b in bucket[p].tolist():  # members that are reached are dropped for good
                members[b] = members[b][left[members[b]]]
            near = np.unique(np.concatenate([members[b] for b in bucket[p].tolist()]))
            near = near[np.minimum(sizes[near], sizes[p]) >= threshold * np.maximum(sizes[near], sizes[p])]
            if not len(near):
                continue
            own = flat[offsets[p] : offsets[p + 1]]
            mark[own] = True
            n = sizes[near]
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(offsets[near] - (ends - n), n)
            common = np.add.reduceat(mark[flat[at]].astype(np.int64), ends - n)
            mark[own] = False
            hit = near[common >= threshold * (n + sizes[p] - common) - 1e-9]
            left[hit] = False
            group += hit.tolist()
            queue += hit.tolist()
        if len(group) > 1:
            root = int(ids[group].min())
            out += [(int(ids[g]), root) for g in group]
    return out


def _local(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        out: list[tuple[int, int]] = []

        def close() -> None:
            nonlocal held
            if len(held) > 1:
                out.extend(
                    verified(
                        np.array([h[0] for h in held]),
                        [np.frombuffer(h[1], np.uint64) for h in held],
                        np.array([h[2] for h in held]),
                        threshold,
                    )
                )
            held = []

        def flush():
            rows = out[:]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["id", "root"])

        for batch in batches:
            roots, ids, words = (batch.column(i).to_pylist() for i in (0, 1, 2))
            bands = batch.column(3).flatten().to_numpy().reshape(len(ids), -1) if len(ids) else []
            for r, i, w, b in zip(roots, ids, words, bands):
                if r != now:
                    close()
                    now = r
                if not held or held[-1][:2] != (i, w):  # equal rows follow one another
                    held.append((i, w, b.copy()))
            if len(out) > 10_000:
                yield flush()
        close()
        yield flush()

    return run


def near_duplicate_groups(
    documents: DataFrame,
    *,
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    threshold: float = THRESHOLD,
    local_shingles: int = LOCAL_SHINGLES,
    local_documents: int = LOCAL_DOCUMENTS,
) -> DataFrame:
    """(doc_id, group_id, keep) of every document in a near-duplicate group."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("id"), "text").where("id is not null and text is not null")
    signed = cut(arrow(docs, _signer(shingle, bands, rows), "id bigint, fa bigint, fb bigint, n bigint, bands array<bigint>"))
    same = signed.groupBy("fa", "fb").agg(
        F.min("id").alias("rep"), F.count_distinct("id").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    same = cut(same)

    keyed = same.select("rep", F.explode("bands").alias("h")).repartition("h")
    hubs = keyed.groupBy("h").agg(F.min("rep").alias("hub"), F.count("*").alias("c")).where("c > 1").select("h", "hub")
    links = keyed.join(hubs, "h").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    found = cut(components(links).withColumnRenamed("node", "id"))

    flagged = maybe_in(docs, "id", found.select("id"), "maybe").where("maybe").select("id", "text")
    sets = arrow(flagged, _set_maker(shingle), "id bigint, fa bigint, fb bigint, words binary")
    info = same.select(F.col("rep").alias("id"), "fa", "fb", "n", "bands").join(found, "id")
    sums = info.groupBy("root").agg(F.sum("n").alias("s"), F.count("*").alias("c"))
    big = cut(sums.where((F.col("s") > local_shingles) | (F.col("c") > local_documents)).select("root"))
    is_big = big.limit(1).count() > 0
    small_info = info.join(big, "root", "left_anti") if is_big else info
    # A row goes with the bands of its own text: with those of all texts of its doc_id, rows that repeat one would multiply.
    gathered = sets.join(small_info, ["id", "fa", "fb"]).repartition("root").sortWithinPartitions("root", "id", "fa", "fb")
    near = arrow(gathered.select("root", "id", "words", "bands"), _local(threshold), "id bigint, root bigint")
    if is_big:
        near = near.union(_by_pairs(sets.select("id", "words").distinct(), info.join(big, "root", "left_semi"), threshold))
    near = near.groupBy("id").agg(F.min("root").alias("root"))

    groups = same.join(near, same["rep"] == near["id"], "left").where("copies > 1 or root is not null")
    groups = groups.select("fa", "fb", F.coalesce("root", "rep").alias("group_id"))
    return (
        signed.select("id", "fa", "fb")
        .join(groups, ["fa", "fb"])
        .groupBy(F.col("id").alias("doc_id"))
        .agg(F.min("group_id").alias("group_id"))
        .withColumn("keep", F.col("doc_id") == F.col("group_id"))
    )


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, s): the pairs with their exact Jaccard similarity."""
    one = sets.select(F.col("id").alias("a"), F.col("words").alias("wa"))
    two = sets.select(F.col("id").alias("b"), F.col("words").alias("wb"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, (wa, wb) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(wa.as_buffer(), np.uint64), np.frombuffer(wb.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                out[i] = common / (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).append_column("s", pa.array(out))

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "wa", "wb")
    return cut(arrow(both, judge, "a bigint, b bigint, s double"))


def _by_pairs(sets: DataFrame, info: DataFrame, threshold: float) -> DataFrame:
    """The same verification for components too large for one task: pairs through joins."""
    keyed = info.select("id", F.explode("bands").alias("h"))
    heads = keyed.groupBy("h").agg(F.min("id").alias("head"), F.count("*").alias("c")).where("c > 1").select("h", "head")
    star = keyed.join(heads, "h")
    judged = _similar(star.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), sets)
    known = star.join(judged.select(F.col("a").alias("head"), F.col("b").alias("id"), "s"), ["head", "id"], "left")
    known = cut(known.select("h", "id", "s", (F.col("id") == F.col("head")).alias("is_head")))
    near = f"s >= {threshold} - 1e-9"
    # Those that their band's head doesn't link, with all others of the band but the head that may be similar.
    far = known.where(f"not is_head and not {near}").select("h", F.col("id").alias("x"), F.col("s").alias("t"))
    rest = far.join(known.where("not is_head"), "h").where(f"abs(s - t) <= 1 - {threshold} + 1e-9 and (x < id or (x > id and {near}))")
    more = _similar(rest.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct(), sets)
    return components(judged.union(more).where(near).select("a", "b")).select(F.col("node").alias("id"), "root")


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of (id, fresh, text), sorted by id and fresh, of which a fresh text holds little but what one of the others had.

    The texts of an id are compared until one is found, so rows that repeat it are never paired in a table.
    """
    now, done, before = None, False, {}
    for batch in batches:
        ids, fresh, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for lo, _, texts in K.chunks(batch.column(2)):
            values, offsets = K.distinct(*K.grams(K.tokenize(texts), SHINGLE))
            for i in range(len(texts)):
                x, own = ids[lo + i], values[offsets[i] : offsets[i + 1]]
                if x != now:
                    now, done, before = x, False, {}
                if not fresh[lo + i]:
                    before.setdefault(own.tobytes())
                elif not done and any(np.isin(own, np.frombuffer(b, np.uint64), assume_unique=True).sum() >= DERIVED * len(own) for b in before):
                    done = True
                    out.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["id"])


def _copies_before(documents: DataFrame, before: DataFrame, parameters: dict) -> DataFrame:
    """(doc_id) of documents that were near duplicates of a document of a lesser id which is still there, before both were cut."""
    then = cut(near_duplicate_groups(before, **parameters).select("doc_id", "group_id"))
    texts = lambda d: d.select(F.col("doc_id").cast("bigint").alias("id"), "text").where("id is not null and text is not null")
    some = lambda d, fresh: maybe_in(texts(d), "id", then.select("doc_id"), "maybe").where("maybe").select("id", F.lit(fresh).alias("fresh"), "text")
    both = some(documents, 1).union(some(before, 0)).repartition("id").sortWithinPartitions("id", "fresh")
    there = cut(arrow(both, _derived, "id bigint").join(then.withColumnRenamed("doc_id", "id"), "id").select("id", "group_id"))
    least = there.groupBy("group_id").agg(F.min("id").alias("least"))
    return there.join(least, "group_id").where("id <> least").select(F.col("id").alias("doc_id"))


def near_dedup(documents: DataFrame, before: DataFrame | None = None, **parameters) -> DataFrame:
    """The documents, one of each near-duplicate group: the one with the least doc_id.

    before has the documents as they were before an earlier step cut their texts. A near
    copy of which only its edited lines are left isn't like the text that it was copied
    from any more; it goes as well if its text before was a near duplicate of one that is
    still there, and what it has now comes from that text (at least DERIVED of its
    shingles). All columns are kept. Rows with a null doc_id, a null text or no words stay.
    """
    gone = near_duplicate_groups(documents, **parameters).where("not keep").select("doc_id")
    if before is not None:
        gone = gone.union(_copies_before(documents, before, parameters)).distinct()
    return without(documents, "doc_id", cut(gone))
