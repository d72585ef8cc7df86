"""Operator 9: removal of repeated passages by overlapping three-line windows.

A line that isn't blank is one unit of text, or several: it is cut behind marks that end
sentences and clauses, and pieces of more than LONG characters without such marks behind
words that end in some letters. Cuts depend on the text beside them alone, so a passage
is cut the same way wherever it stands, and one that lies within a line has units of its
own. Every three consecutive units are a window; it counts if they are three whole lines
or have LEAST characters together. Windows are hashed to 128 bits in numpy, from cumulative sums over whole batches. The
least (doc_id, position) of each hash is its first occurrence; windows found elsewhere
are later ones. The units that later windows cover are merged into passages, and a
passage goes if it has RUN characters; shorter ones, such as a sentence or two between
two edits of a near copy, stay. Three whole lines go whatever their length. A removed unit
always has an equal one that stays, earlier in the order.

Windows are counted by one half of their hash, combined before the shuffle; only those
that occur again are looked at further. A passage that occurs any number of times is
aggregated, never listed in one row. Only the texts that lose units are joined with what
they lose.

Defined cases: null text: no windows, stays null. Null doc_id: left alone and not
counted. Fewer than three units: left alone. Blank lines have no part in windows and stay
where they are; white space at the ends of units doesn't count. A line that loses every
unit goes, one that loses some keeps the others. Rows that repeat a doc_id are one
document and don't repeat each other. Ties: of equal windows the least doc_id, then the
least position is the first. Lines end at "\\n" alone. Texts of any length are read
whole. An empty table gives no rows. Other columns pass through, whatever their names;
n_chars is counted anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as K
from lexiloom.llm.common import arrow, cut, fresh, maybe_in
from lexiloom.shipping import ship

LINES = 3
#: Characters of a window that isn't made of whole lines, at least; and of a piece that is cut again, more than.
LEAST, LONG = 60, 200
#: Characters of a passage that goes, at least: some 20 words.
RUN = 120
#: One piece of a line; one piece of a long piece. Python and DuckDB read them alike.
PIECE = r"(?s).*?(?:[.!?…;:|]+ +|[。！？]+ *)|.+"
SHORTER = r"(?s).*?[dghou37] +|.+"
_OTHER, _MARK, _FULL, _SPACE, _END, _LETTER = range(6)
_kinds: list[np.ndarray] = []


def _kind_table() -> np.ndarray:
    """Code point -> what it means for cuts."""
    if not _kinds:
        table = np.zeros(0x110000, np.uint8)
        for chars, kind in ((".!?…;:|", _MARK), ("。！？", _FULL), (" ", _SPACE), ("\n", _END), ("dghou37", _LETTER)):
            table[[ord(c) for c in chars]] = kind
        _kinds.append(table)
    return _kinds[0]


def _spans(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, line) of every unit, without spaces at its ends; lines are numbered over all texts, which "\n" separates."""
    n = len(cps)
    kind = np.full(n + 2, _END, np.uint8)
    kind[1:-1] = _kind_table()[cps]
    space = kind == _SPACE
    gaps = np.flatnonzero(space[1:] & ~space[:-1]), np.flatnonzero(space[:-1] & ~space[1:])  # code points from, to
    before = kind[gaps[0]]  # kind is shifted by one
    full = kind[1:-1] == _FULL
    cuts = np.concatenate([gaps[1][(before == _MARK) | (before == _FULL)], np.flatnonzero(full & (kind[2:] != _FULL) & (kind[2:] != _SPACE)) + 1])
    ends = np.flatnonzero(kind[1:-1] == _END)
    starts = np.unique(np.concatenate([[0], cuts, ends + 1]))
    edges = np.append(starts[1:], n + 1)
    edges = edges - np.isin(edges - 1, ends, assume_unique=True) - (edges == n + 1)  # line ends belong to no piece
    long = edges - starts > LONG
    if long.any():
        more = gaps[1][before == _LETTER]
        at = np.searchsorted(starts, more, "right") - 1
        more = more[long[at] & (more < edges[at])]
        edges = np.sort(np.concatenate([edges, more]))
        starts = np.sort(np.concatenate([starts, more]))
    lines = np.searchsorted(ends, starts, "left")
    within = lambda at: np.maximum(np.searchsorted(gaps[0], at, "right") - 1, 0)
    if len(gaps[0]):
        at = within(starts)
        starts = np.where((starts >= gaps[0][at]) & (starts < gaps[1][at]), gaps[1][at], starts)
        at = within(edges - 1)
        edges = np.where((edges > gaps[0][at]) & (edges <= gaps[1][at]), gaps[0][at], edges)
    some = starts < edges
    return starts[some], edges[some], lines[some]


def _hashed(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of each span, from one wrapped cumulative sum for each stretch of spans."""
    out = np.empty(len(starts), np.uint64)
    at, inverse = 0, pow(base, -1, 1 << 64)
    while at < len(starts):
        lo = int(starts[at])
        to = max(int(np.searchsorted(ends, lo + K.SEGMENT, "right")), at + 1)
        part = cps[lo : int(ends[to - 1])].astype(np.uint64)
        part += np.uint64(1)
        part *= K.power(base, len(part))[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        a, b = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = K.mix((sums[b] - sums[a]) * K.power(inverse, len(part))[a])
        at = to
    return out


_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93)


def _window_maker(lines: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _, texts in K.chunks(batch.column(1)):
                cps = K.codepoints("\n".join(texts))
                bounds = np.cumsum([len(t) + 1 for t in texts])
                starts, ends, line = _spans(cps)
                doc = np.searchsorted(bounds, starts, "right")
                first = np.searchsorted(doc, doc, "left")
                n = len(starts) - lines + 1
                if n <= 0:
                    continue
                whole = np.ones(len(starts), bool)
                whole[1:] &= line[1:] != line[:-1]
                whole[:-1] &= line[1:] != line[:-1]
                size = np.concatenate([[0], np.cumsum(ends - starts)])
                full = np.concatenate([[0], np.cumsum(whole)])
                at = np.arange(n)
                good = doc[:n] == doc[lines - 1 :]
                whole = full[at + lines] - full[at] == lines
                good &= whole | (size[at + lines] - size[at] >= least)
                at, whole = at[good], whole[good]
                out = []
                for base in _BASES:
                    one = _hashed(cps, starts, ends, base)
                    rolled = one[at].copy()
                    for j in range(1, lines):
                        rolled *= np.uint64(base)
                        rolled += one[at + j]
                    out.append(pa.array(K.mix(rolled).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*out, pa.array(ids[lo + doc[at]]), pa.array((2 * (at - first[at]) + whole).astype(np.int32))], names=["ha", "hb", "id", "w"])

    return run


def windows(documents: DataFrame, lines: int = LINES, least: int = LEAST) -> DataFrame:
    """(ha, hb, id, w) of every window that counts; w is twice the number of its first unit, and 1 more for whole lines."""
    some = documents.select(F.col("doc_id").cast("bigint").alias("id"), "text").where("id is not null and text is not null")
    return arrow(some, _window_maker(lines, least), "ha bigint, hb bigint, id bigint, w int")


def covered(documents: DataFrame, lines: int = LINES, least: int = LEAST) -> DataFrame:
    """(id, later): the windows of each document that repeat an earlier one."""
    keyed = cut(windows(documents, lines, least))
    again = cut(keyed.groupBy("ha").agg(F.count("*").alias("c")).where("c > 1").select("ha"))
    some = maybe_in(keyed, "ha", again, "again").where("again").select("ha", "hb", "id", "w")
    first = some.groupBy("ha", "hb").agg(F.min(F.struct("id", "w")).alias("first"), F.max(F.struct("id", "w")).alias("last"))
    first = first.where(F.col("first") < F.col("last")).select("ha", "hb", "first")
    # A window that very many documents hold makes a partition of some that AQE splits: first has one row of it.
    later = some.join(first, ["ha", "hb"]).where(F.struct("id", "w") > F.col("first"))
    return later.groupBy("id").agg(F.collect_set("w").alias("later"))


_PIECE, _SHORTER = re.compile(PIECE), re.compile(SHORTER)


def pieces_of(line: str) -> list[str]:
    return [x for p in _PIECE.findall(line) for x in (_SHORTER.findall(p) if len(p) > LONG else [p])]


def passages(later: set[int], sizes: list[int], lines: int, run: int) -> set[int]:
    """The units of the passages that go; sizes has the characters of each unit."""
    gone = {w // 2 + j for w in later if w % 2 for j in range(lines)}
    covered = sorted({w // 2 + j for w in later for j in range(lines)})
    at = 0
    for i in range(1, len(covered) + 1):
        if i == len(covered) or covered[i] != covered[i - 1] + 1:
            own = covered[at:i]
            if sum(sizes[u] for u in own) >= run:
                gone.update(own)
            at = i
    return gone


def without_windows(text: str, later: set[int], lines: int = LINES, run: int = RUN) -> tuple[str, int]:
    """The text without the passages that the windows make up, and how many units these have."""
    listed = [(line, pieces_of(line)) for line in text.split("\n")]
    gone = passages(later, [len(x.strip(" ")) for _, own in listed for x in own if x.strip(" ")], lines, run)
    kept, seen, removed = [], 0, 0
    for line, own in listed:
        stay, units = [], 0
        for piece in own:
            if piece.strip(" "):
                units += 1
                seen += 1
                if seen - 1 in gone:
                    continue
            stay.append(piece)
        lost = len(own) - len(stay)
        removed += lost
        if not lost:
            kept.append(line)
        elif lost < units:
            kept.append("".join(stay).rstrip(" "))
    return "\n".join(kept), removed


def _cutter(lines: int):
    def rewrite(text: pd.Series, later: pd.Series) -> pd.DataFrame:
        done = [without_windows(t, set(ws), lines) for t, ws in zip(text, later)]
        return pd.DataFrame({"text": [t for t, _ in done], "removed": [n for _, n in done]})

    return F.pandas_udf(rewrite, "text string, removed bigint")


def rewritten(documents: DataFrame, removed: str, lines: int = LINES) -> DataFrame:
    """documents with repeated lines cut from text, and how many, in a column named by removed."""
    ship(documents.sparkSession)
    p = fresh(documents, [removed])
    columns = documents.columns
    q = lambda c: F.col(f"`{c}`")
    lost = cut(covered(documents, lines)).select(F.col("id").alias(f"{p}id"), F.col("later").alias(f"{p}later"))
    flagged = maybe_in(documents, "doc_id", lost.select(f"{p}id"), f"{p}f")
    clear = flagged.where(~F.col(f"{p}f")).select(*map(q, columns), F.lit(0).cast("bigint").alias(removed))
    joined = flagged.where(f"{p}f").join(lost, F.col("doc_id") == F.col(f"{p}id"), "left")
    kept = joined.where(F.col(f"{p}later").isNull() | F.col("text").isNull())
    kept = kept.select(*map(q, columns), F.lit(0).cast("bigint").alias(removed))
    changed = joined.where(F.col(f"{p}later").isNotNull() & F.col("text").isNotNull())
    changed = changed.withColumn(f"{p}new", _cutter(lines)(F.col("text"), F.col(f"{p}later")))
    new = {"text": F.col(f"{p}new.text")}
    if "n_chars" in columns:
        new["n_chars"] = F.length(f"{p}new.text").cast(documents.schema["n_chars"].dataType)
    changed = changed.select(*[new.get(c, q(c)).alias(c) for c in columns], F.col(f"{p}new.removed").alias(removed))
    return clear.unionByName(kept).unionByName(changed)


def deduplicated_lines(documents: DataFrame, lines: int = LINES) -> DataFrame:
    """(doc_id, text, removed) of every document: its text without repeated passages, and how many units went."""
    return rewritten(documents.select("doc_id", "text"), "removed", lines)


def line_dedup(documents: DataFrame, lines: int = LINES) -> DataFrame:
    """The documents with repeated passages cut; those that lose every unit go."""
    p = fresh(documents)
    done = rewritten(documents, f"{p}removed", lines)
    gone = (F.col(f"{p}removed") > 0) & (F.length(F.trim(F.translate("text", "\n", ""))) == 0)
    return done.where(~F.coalesce(gone, F.lit(False))).drop(f"{p}removed")


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p
  FROM {{documents}} WHERE text IS NOT NULL
), listed AS (
  SELECT doc_id, p, flatten(list_transform(regexp_extract_all(line, '{PIECE}'),
    lambda x: CASE WHEN length(x) > {LONG} THEN regexp_extract_all(x, '{SHORTER}') ELSE [x] END)) AS l FROM lines
), pieces AS (
  SELECT doc_id, p, unnest(l) AS piece, generate_subscripts(l, 1) AS q FROM listed
), units AS (
  SELECT doc_id, p, q, trim(piece) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY p, q) - 1 AS w,
         count(*) OVER (PARTITION BY doc_id, p) = 1 AS whole
  FROM pieces WHERE length(trim(piece)) > 0
), win AS (
  SELECT doc_id, w, s AS a, lead(s, 1) OVER o AS b, lead(s, 2) OVER o AS c,
         whole AND lead(whole, 1) OVER o AND lead(whole, 2) OVER o AS lines
  FROM units WINDOW o AS (PARTITION BY doc_id ORDER BY w)
), seen AS (
  SELECT doc_id, w, lines, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, w) AS nth
  FROM win WHERE c IS NOT NULL AND (lines OR length(a) + length(b) + length(c) >= {LEAST})
), covered AS (
  SELECT doc_id, w + j AS w, bool_or(lines) AS lines FROM seen, (VALUES (0), (1), (2)) t(j) WHERE nth > 1 GROUP BY doc_id, w + j
), runs AS (
  SELECT c.doc_id, c.w, c.lines, length(u.s) AS n, c.w - row_number() OVER (PARTITION BY c.doc_id ORDER BY c.w) AS run
  FROM covered c JOIN units u ON c.doc_id = u.doc_id AND c.w = u.w
), gone AS (
  SELECT doc_id, w FROM runs QUALIFY lines OR sum(n) OVER (PARTITION BY doc_id, run) >= {RUN}
), marked AS (
  SELECT x.doc_id, x.p, x.q, x.piece, u.w IS NOT NULL AS unit, g.w IS NOT NULL AS cut
  FROM pieces x LEFT JOIN units u ON x.doc_id = u.doc_id AND x.p = u.p AND x.q = u.q
  LEFT JOIN gone g ON u.doc_id = g.doc_id AND u.w = g.w
), changed AS (
  SELECT doc_id, p, count(*) FILTER (WHERE unit) AS units, count(*) FILTER (WHERE cut) AS lost,
         rtrim(string_agg(piece, '' ORDER BY q) FILTER (WHERE NOT cut), ' ') AS rest
  FROM marked GROUP BY doc_id, p HAVING bool_or(cut)
), done AS (
  SELECT l.doc_id, coalesce(string_agg(CASE WHEN c.p IS NULL THEN line ELSE rest END, chr(10) ORDER BY l.p)
           FILTER (WHERE c.p IS NULL OR c.lost < c.units), '') AS text,
         CAST(coalesce(sum(c.lost), 0) AS BIGINT) AS removed
  FROM lines l LEFT JOIN changed c ON l.doc_id = c.doc_id AND l.p = c.p GROUP BY l.doc_id
)
SELECT doc_id, text, removed FROM done
"""
