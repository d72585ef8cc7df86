"""Tokens and postings of whole Arrow batches in numpy, for the Python workers.

A piece of about CHUNK bytes of texts is folded through a table of bytes, cut into
tokens and dictionary-coded at once; one sort of (term, place) pairs then brings each
term's places together, document by document. Nothing is done for a single token or a
single posting.

Where only sizes are wanted, a posting is three ints: its document within its block, its
frequency, and the bytes of its coded frequency and positions. All postings that a term
has in a piece and a block are one row of (term, block, listed), so that a frequent term
costs a row for each piece instead of one for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are cut into tokens at a time; a longer text is one piece.
CHUNK = 4 << 20
#: Postings in an output batch, about.
ROWS = 1 << 17
#: Postings that a task gathers, at least, before their lists go out.
HELD = 1 << 20
_SIZES = tuple(range(7, 63, 7))


def _fold() -> np.ndarray:
    """Byte -> its lower-case ASCII letter or its digit, or 0. No byte of a longer character is either."""
    table = np.zeros(256, np.uint8)
    for c in map(chr, range(128)):
        if c.isalnum():
            table[ord(c)] = ord(c.lower())
    return table


FOLD = _fold()


def encoded_size(values: np.ndarray) -> np.ndarray:
    """functions.sizes.encoded_size for an array."""
    size, top = np.ones(len(values), np.int64), int(values.max(initial=0))
    for bits in _SIZES:
        if top < 1 << bits:
            break
        size += values >= 1 << bits
    return size


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each text starts and ends there; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets else np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def _chunks(at: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
        yield lo, hi
        lo = hi


def _cut(data: np.ndarray, at: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts lo to hi: the letters of all tokens, where each token starts among them, and the first token of each text."""
    own = at[lo : hi + 1] - at[lo]
    folded = FOLD[data[at[lo] : at[hi]]]
    inside = folded != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = own[:-1][own[:-1] < len(inside)]
    first[begins] = inside[begins]  # a token ends with its text
    texts = np.searchsorted(np.flatnonzero(first), own)
    return folded[inside], np.flatnonzero(first[inside]), texts


def lengths(texts: pa.Array) -> np.ndarray:
    """The number of tokens of each text."""
    data, at = _bytes_of(texts)
    out = np.zeros(len(texts), np.int32)
    for lo, hi in _chunks(at):
        out[lo:hi] = np.diff(_cut(data, at, lo, hi)[2])
    return out


class Piece:
    """The postings of some texts, by term and then by text.

    terms has each term once, code is each posting's term, doc its text; its places are
    places[starts[i]:starts[i + 1]], counted from its text's first token.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, lo: int, hi: int, only: pa.Array | None):
        letters, begins, firsts = _cut(data, at, lo, hi)
        n = len(begins)
        self.lengths = np.diff(firsts)
        wide = len(letters) > 2**31 - 1
        kind, array = (np.int64, pa.LargeStringArray) if wide else (np.int32, pa.StringArray)
        offsets = np.append(begins, len(letters)).astype(kind)
        coded = array.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
        self.terms = coded.dictionary.cast(pa.string())
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        nth = np.arange(n)
        if only is not None:
            keep = pc.is_in(self.terms, value_set=only).to_numpy(zero_copy_only=False)[code] if n else np.zeros(0, bool)
            code, nth = code[keep], nth[keep]
        bits = max(1, n.bit_length())
        order = (code << bits) | nth
        order.sort()
        code, nth = order >> bits, order & ((1 << bits) - 1)
        doc = np.repeat(np.arange(hi - lo), self.lengths)[nth]
        edge = np.ones(len(nth), bool)
        edge[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(edge)
        self.edge, self.places = edge, (nth - firsts[doc]).astype(np.int32)
        self.starts, self.code, self.doc = np.append(starts, len(nth)), code[starts], doc[starts]
        self.tf = np.diff(self.starts).astype(np.int32)

    def __len__(self) -> int:
        return len(self.code)

    def position_bytes(self) -> np.ndarray:
        """Bytes of each posting's places, each coded as the gap to the one before."""
        if not len(self):
            return np.zeros(0, np.int64)
        gaps = self.places.copy()
        gaps[1:] -= np.where(self.edge[1:], 0, self.places[:-1])
        return np.add.reduceat(encoded_size(gaps), self.starts[:-1])


def pieces(texts: pa.Array, only: list[str] | None = None) -> Iterator[tuple[int, int, Piece]]:
    data, at = _bytes_of(texts)
    wanted = None if only is None else pa.array(only, pa.string())
    for lo, hi in _chunks(at):
        yield lo, hi, Piece(data, at, lo, hi, wanted)


def poster(only: list[str] | None):
    """(doc_id, text) -> (term, doc_id, tf, positions, doc_len, position_bytes)."""
    names = ["term", "doc_id", "tf", "positions", "doc_len", "position_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, piece in pieces(batch.column(1), only):
                sizes, doc = piece.position_bytes().astype(np.int32), piece.doc
                for a in range(0, len(piece), ROWS):
                    b = min(a + ROWS, len(piece))
                    s = piece.starts[a : b + 1]
                    places = pa.ListArray.from_arrays(pa.array((s - s[0]).astype(np.int32)), pa.array(piece.places[s[0] : s[-1]]))
                    columns = [
                        piece.terms.take(pa.array(piece.code[a:b])), pa.array(ids[lo + doc[a:b]]), pa.array(piece.tf[a:b]), places,
                        pa.array(piece.lengths[doc[a:b]].astype(np.int32)), pa.array(sizes[a:b]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _binary(rows: np.ndarray, edges: np.ndarray) -> pa.Array:
    """rows[edges[i]:edges[i + 1]] as the bytes of a binary column's i-th value."""
    offsets = edges * (rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1))
    if offsets[-1] > 2**31 - 1:
        return pa.array([rows[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.large_binary()).cast(pa.binary())
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] to starts[i] + sizes[i] - 1, one i after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _grouped(term: np.ndarray, terms: pa.Array, ids: np.ndarray, ints: list[np.ndarray], block: int, places: np.ndarray | None = None) -> pa.RecordBatch:
    """(term, block, listed) of postings in any order; a posting is its document in the block, then its ints.

    block is the number of documents in one, a power of two. places, of all postings one after
    the other and as many as ints[0] tells for each, go into a column of their own.
    """
    bits = max(1, len(term).bit_length())
    order = np.sort((term.astype(np.int64) << bits) | np.arange(len(term))) & ((1 << bits) - 1)
    same = term[order][1:] == term[order][:-1]
    if (same & (ids[order][1:] < ids[order][:-1])).any():  # else the documents come in their order
        order = np.lexsort((ids, term))
    sorted_term, of = term[order], ids[order] >> (block.bit_length() - 1)
    rows = np.stack([ids[order] & (block - 1), *[x[order] for x in ints]], axis=1).astype(np.int32)
    edge = np.ones(len(of), bool)
    edge[1:] = (sorted_term[1:] != sorted_term[:-1]) | (of[1:] != of[:-1])
    starts = np.flatnonzero(edge)
    edges = np.append(starts, len(of))
    columns = [terms.take(pa.array(sorted_term[starts])), pa.array(of[starts]), _binary(rows, edges)]
    if places is None:
        return pa.RecordBatch.from_arrays(columns, names=["term", "block", "listed"])
    tf = ints[0].astype(np.int64)
    moved = places[_spread((np.cumsum(tf) - tf)[order], tf[order])]
    columns.append(_binary(moved, np.append(0, np.cumsum(tf[order]))[edges]))
    return pa.RecordBatch.from_arrays(columns, names=["term", "block", "listed", "places"])


def packer(block: int, placed: bool = False):
    """(doc_id, text) -> (term, block, listed); with placed the postings have their documents' lengths as well, and places are beside them."""

    def closed(held: list[tuple]) -> pa.RecordBatch:
        coded = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        base = np.cumsum([0, *[len(h[0]) for h in held]])
        term = np.concatenate([index[base[i] + h[1]] for i, h in enumerate(held)])
        ids, *rest = (np.concatenate([h[k] for h in held]) for k in range(2, len(held[0])))
        return _grouped(term, coded.dictionary, ids, rest[:-1], block, rest[-1]) if placed else _grouped(term, coded.dictionary, ids, rest, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, p in pieces(batch.column(1)):
                sizes = p.position_bytes() + (0 if placed else encoded_size(p.tf))
                more = (p.lengths[p.doc].astype(np.int32), p.places) if placed else ()
                held.append((p.terms, p.code, ids[lo + p.doc], p.tf, sizes.astype(np.int32), *more))
                n += len(p) + len(p.places) // 4 * placed
                if n >= HELD:
                    yield closed(held)
                    held, n = [], 0
        if held:
            yield closed(held)

    return run


def repacker(block: int):
    """(term, doc_id, tf, bytes) of postings -> (term, block, listed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            ids, *ints = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            yield _grouped(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, ids, ints, block)

    return run


class Groups:
    """Whole groups of (term, block, listed, ...) rows: their postings by group and document.

    rows has each group's first row, starts and ends its postings. known is a posting's
    bytes; the first one of a group counts without its gap, which depends on the block before.
    """

    def __init__(self, batch: pa.RecordBatch, edge: np.ndarray, block: int):
        self.rows = np.flatnonzero(edge)
        data, at = _bytes_of(batch.column(2))
        flat = np.frombuffer(data[at[0] : at[-1]], np.int32).reshape(-1, 3)
        group = np.repeat(np.cumsum(edge) - 1, np.diff(at) // 12)
        key = group * block + flat[:, 0]
        if len(key) and (key[1:] < key[:-1]).any():  # a term's documents of several pieces
            order = np.argsort(key, kind="stable")
            flat, group = flat[order], group[order]
        self.group, self.tf = group, flat[:, 1]
        self.starts = np.searchsorted(group, np.arange(len(self.rows) + 1))
        self.starts, self.ends = self.starts[:-1], self.starts[1:]
        self.block = batch.column(1).to_numpy(zero_copy_only=False)[self.rows]
        self.docs = self.block[group] * block + flat[:, 0]
        self.known = flat[:, 2].astype(np.int64)
        gap = np.diff(self.docs, prepend=0)
        gap[self.starts] = 0
        size = encoded_size(gap)
        size[self.starts] = 0
        self.known += size
        self.gap = gap

    def check(self, n: np.ndarray) -> None:
        if (self.ends - self.starts != n).any():
            raise RuntimeError("the postings of a term and block came to more than one task")


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by term and block, and which of them begin a group; no group is cut by the end of a batch."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = _edges(batch)
        edge[0] = (batch.column(0)[0].as_py(), batch.column(1)[0].as_py()) != now
        now = batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py()
        if edge.any():
            last = int(np.flatnonzero(edge)[-1])
            held.append(batch.slice(0, last))
            yield from _closed(held)
            held, batch = [], batch.slice(last)
        held.append(batch)
    yield from _closed(held)


def _edges(batch: pa.RecordBatch) -> np.ndarray:
    term = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    of = batch.column(1).to_numpy(zero_copy_only=False)
    edge = np.ones(batch.num_rows, bool)
    edge[1:] = (term[1:] != term[:-1]) | (of[1:] != of[:-1])
    return edge


def _closed(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    held = [b for b in held if b.num_rows]
    if held:
        batch = held[0] if len(held) == 1 else pa.concat_batches(held)
        yield batch, _edges(batch)


def blocker(block: int):
    """Sorted (term, block, listed) -> (term, block, n, first, last, bytes, tokens)."""
    names = ["term", "block", "n", "first", "last", "bytes", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edge in whole(batches):
            g = Groups(batch, edge, block)
            sums = [np.add.reduceat(x, g.starts) for x in (g.known, g.tf.astype(np.int64))]
            columns = [g.block, g.ends - g.starts, g.docs[g.starts], g.docs[g.ends - 1], *sums]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(g.rows)), *map(pa.array, columns)], names=names)

    return run


def gapper(block: int):
    """Sorted (term, block, listed, n, carried) -> (term, doc_id, gap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edge in whole(batches):
            g = Groups(batch, edge, block)
            g.check(_of_groups(batch, g, "n"))
            gap = g.gap
            gap[g.starts] = g.docs[g.starts] - _of_groups(batch, g, "carried")
            terms = batch.column(0).take(pa.array(g.rows))
            for a in range(0, len(gap), ROWS):
                own = slice(a, a + ROWS)
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(g.group[own])), pa.array(g.docs[own]), pa.array(gap[own])], names=["term", "doc_id", "gap"])

    return run


def _of_groups(batch: pa.RecordBatch, g: Groups, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)[g.rows]


def skipper(block: int, sums: bool):
    """Sorted (term, block, listed, n, carried, rows_before, bytes_before, doc_freq) -> (term, nth, skip_doc, skip_offset); with sums (term, skips, skip_bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edge in whole(batches):
            g = Groups(batch, edge, block)
            n, carried, rows_before, bytes_before, freq = (_of_groups(batch, g, c) for c in ("n", "carried", "rows_before", "bytes_before", "doc_freq"))
            g.check(n)
            row = np.arange(len(g.group)) - (g.starts - rows_before)[g.group]
            step = np.floor(np.sqrt(freq.astype(np.float64))).astype(np.int64)
            at = np.flatnonzero((row > 0) & (row % step[g.group] == 0))
            own = g.group[at]
            first = at == g.starts[own]
            before = np.where(first, carried[own], g.docs[at - 1])
            upto = np.cumsum(g.known) - g.known
            lead = encoded_size(g.docs[g.starts] - carried)
            # What lies before in the block leaves out its first gap, which all later postings come after.
            offset = bytes_before[own] + upto[at] - upto[g.starts][own] + np.where(first, 0, lead[own])
            terms = batch.column(0).take(pa.array(g.rows))
            if sums:
                some, starts = np.unique(own, return_index=True)
                size = np.add.reduceat(encoded_size(before) + encoded_size(offset), starts) if len(own) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(some)), pa.array(np.diff(np.append(starts, len(own)))), pa.array(size)], names=["term", "skips", "skip_bytes"])
            else:
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(own)), *map(pa.array, (row[at], before, offset))], names=["term", "nth", "skip_doc", "skip_offset"])

    return run


def unpacker(block: int):
    """Sorted (term, block, listed, places, bucket) -> the postings as they are stored."""
    names = ["term", "doc_id", "tf", "positions", "doc_len", "position_bytes", "bucket"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edge in whole(batches):
            data, at = _bytes_of(batch.column(2))
            flat = np.frombuffer(data[at[0] : at[-1]], np.int32).reshape(-1, 4)
            row = np.repeat(np.arange(batch.num_rows), np.diff(at) // 16)
            data, at = _bytes_of(batch.column(3))
            places = np.frombuffer(data[at[0] : at[-1]], np.int32)
            tf = flat[:, 1].astype(np.int64)
            starts = np.cumsum(tf) - tf
            key = np.cumsum(edge)[row] * block + flat[:, 0]
            if (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                flat, row, starts = flat[order], row[order], starts[order]
            docs = batch.column(1).to_numpy(zero_copy_only=False)[row] * block + flat[:, 0]
            for a in range(0, len(flat), ROWS):
                own, at_row = flat[a : a + ROWS], pa.array(row[a : a + ROWS])
                n = own[:, 1].astype(np.int64)
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(places[_spread(starts[a : a + ROWS], n)]))
                ints = [pa.array(np.ascontiguousarray(own[:, k])) for k in (1, 3, 2)]
                columns = [batch.column(0).take(at_row), pa.array(docs[a : a + ROWS]), ints[0], listed, ints[1], ints[2], batch.column(4).take(at_row)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run
