"""Operator 5: near-duplicate embeddings by randomly rotated binary codes.

1. Equal vectors are collapsed by a 128-bit hash: a group of any number of copies is
   one vector from now on.
2. A vector of unit length is rotated by one fixed random orthogonal matrix and coded
   by the signs of its coordinates. Beside the code a correction factor is stored: the
   inner product of the rotated vector with its own code, which makes
   <query, code> / factor an unbiased estimate of the true inner product, with an error
   bound that follows from the factor alone. The query side is carried as one byte per
   dimension. Every vector is a query.
3. Candidates share a bucket of one of several tables of random hyperplanes; the number
   of planes follows the number of vectors, and the number of tables follows from the
   planes, so that a pair at the threshold is met with probability RECALL at least. In a
   bucket all pairs are estimated by one matrix product of codes; a pair whose confidence
   interval (Z standard errors) lies below the threshold is decided by that. Of the
   others the bytes of both give a second, narrower interval (FINE standard errors), and
   only pairs whose interval holds the threshold are recomputed exactly, from vectors.
4. A pair that meets in several tables counts in the first of them. A bucket gives each
   vector's number of links and the least vector it is connected with, so no pair leaves
   it but those to be recomputed. Buckets of more than HOT vectors are cut into blocks,
   and each pair of blocks is a task of its own.

Result: (vec_id, class_id, links), one row for each vec_id. Two vectors are linked where
their cosine similarity is at least THRESHOLD; links counts the different vectors that
are linked with it (copies of one count once, its own not at all), and class_id is the
least vec_id of all that are connected by links or equal.

Defined cases: null vec_id: no row. Null or empty embedding, null or not finite
elements, length 0: no link, class_id is its vec_id. Finite elements of any size are
compared. Vectors of several dimensions: each dimension is searched by itself, links
exist within one only. Equal vectors are one class. A vec_id with several different
vectors has the links of all of them and the least of their classes; these don't link
with each other. Ties: a similarity of exactly THRESHOLD is a link. An empty table gives
no rows. Vectors of any length are compared whole. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as K
from lexiloom.llm.common import arrow, components, cut, maybe_in

THRESHOLD = 0.9
RECALL = 0.95
Z, FINE = 4.0, 6.0
#: Vectors that a bucket holds where they are spread evenly; vectors beyond which one is cut into blocks.
PER_BUCKET, HOT = 512, 8192
#: Hot buckets that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000
SEED = 31


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def plan(rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(planes in a table, tables)."""
    planes = int(np.clip(math.ceil(math.log2(max(rows, 1) / PER_BUCKET + 1)), 2, 32))
    meet = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 1


def encode(vectors: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors, their packed sign codes and the correction factors."""
    y = vectors @ rot.T
    bits = y >= 0
    factor = np.abs(y).sum(1) / math.sqrt(y.shape[1])
    return y, np.packbits(bits, axis=1), factor.astype(np.float32)


def estimates(y: np.ndarray, signs: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """[i, j]: the unbiased estimate of the inner product of i, known as y, and j, known as a code."""
    return (y @ signs.T) / (math.sqrt(y.shape[1]) * factor)


def error(factor: np.ndarray, dim: int, threshold: float) -> np.ndarray:
    """The standard error of an estimate where the true inner product is the threshold."""
    f2 = np.minimum(factor.astype(float) ** 2, 1.0)
    return np.sqrt((1 - f2) / np.maximum(f2, 1e-9) / max(dim - 1, 1) * (1 - threshold**2))


def _record(dim: int, tables: int) -> np.dtype:
    """What a bucket knows of a vector."""
    return np.dtype([("id", "<i8"), ("low", "<f4"), ("step", "<f4"), ("factor", "<f4"), ("keys", "<u4", (tables,)), ("quant", "u1", (dim,)), ("code", "u1", ((dim + 7) // 8,))])


class _Tables:
    """The hyperplanes of each dimension, made when first asked for."""

    def __init__(self, plans: dict[int, tuple[int, int]]):
        self.plans = plans
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        if dim not in self.made:
            planes, tables = self.plans[dim]
            normals = np.random.default_rng(SEED + 1).normal(size=(tables * planes, dim)).astype(np.float32)
            self.made[dim] = rotation(dim), normals
        return self.made[dim]

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(vectors, tables): the side of each plane, as one number for each table."""
        dim = vectors.shape[1]
        planes, tables = self.plans[dim]
        side = (vectors @ self.of(dim)[1].T >= 0).reshape(len(vectors), tables, planes)
        return (side * (1 << np.arange(planes, dtype=np.int64))).sum(2).astype(np.uint32)


def _bucket(keys: np.ndarray, dim: int) -> np.ndarray:
    """One long for each (dimension, table, key); different ones of one dimension never meet."""
    return (keys.astype(np.int64) << 16 | np.arange(keys.shape[1])) ^ np.int64(dim * 0x2C28FA16A64ABF97 & (1 << 63) - 1)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(dimension, ids, vectors) of parts of a batch whose second column has the vectors."""
    sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        for lo in range(0, len(at), 4096):
            part = batch.take(pa.array(at[lo : lo + 4096]))
            own = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
            yield dim, part.column(0), own


def _keyer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _Tables(shared.value)
        for batch in batches:
            for dim, _, v in _by_dim(batch):
                yield pa.RecordBatch.from_arrays([pa.array(_bucket(tables.keys(v), dim).ravel())], names=["key"])

    return run


def _coder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _Tables(shared.value)
        for batch in batches:
            for dim, ids, v in _by_dim(batch):
                y, code, factor = encode(v, tables.of(dim)[0])
                keys = tables.keys(v)
                out = np.zeros(len(v), _record(dim, keys.shape[1]))
                low = y.min(1)
                step = np.maximum((y.max(1) - low) / 255, 1e-12)
                out["id"], out["low"], out["step"], out["factor"] = ids.to_numpy(), low, step, factor
                out["keys"], out["code"] = keys, code
                out["quant"] = np.rint((y - low[:, None]) / step[:, None])
                n, many = keys.shape
                packed = pa.Array.from_buffers(pa.binary(out.itemsize), n, [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())
                wide = pa.array(np.repeat(np.arange(n), many))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_bucket(keys, dim).ravel()), ids.take(wide), pa.array(np.full(n * many, dim, np.int32)), pa.array(np.tile(np.arange(many, dtype=np.int32), n)), packed.take(wide)],
                    names=["key", "id", "dim", "t", "body"],
                )

    return run


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least number of each one's connected component, of n numbers with links (u, v)."""
    at = np.arange(n)
    while True:
        low = np.minimum(at[u], at[v])
        new = at.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == at).all():
            return at
        at = new


class _Bucket:
    def __init__(self, rows: list[bytes], own: np.ndarray, dim: int, tables: int, table: int, threshold: float, z: float):
        x = np.frombuffer(b"".join(rows), _record(dim, tables))
        order = np.lexsort((x["id"], own))
        x, self.own = x[order], own[order]
        self.ids, self.keys, self.dim, self.table, self.threshold, self.z = x["id"], x["keys"], dim, table, threshold, z
        self.step, self.factor = x["step"], np.maximum(x["factor"], 1e-6)
        self.y = x["quant"].astype(np.float32) * x["step"][:, None] + x["low"][:, None]
        self.signs = np.unpackbits(x["code"], axis=1)[:, :dim].astype(np.float32) * 2 - 1
        self.slack = z * error(self.factor, dim, threshold) + self.step / 2 / self.factor

    def compared(self, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(u, v, sure) of the pairs between two slices that aren't decided against; sure is whether the bytes decide for them."""
        both = (estimates(self.y[a], self.signs[b], self.factor[b]) + estimates(self.y[b], self.signs[a], self.factor[a]).T) / 2
        u, v = np.nonzero(both + (self.slack[a][:, None] + self.slack[b][None, :]) / 2 >= self.threshold)
        u, v = u + a.start, v + b.start
        keep = self.ids[u] != self.ids[v]
        if a == b:
            keep &= u < v
        u, v = u[keep], v[keep]
        near = np.empty(len(u), np.float32)
        for lo in range(0, len(u), 65536):
            part = slice(lo, lo + 65536)
            near[part] = np.einsum("ij,ij->i", self.y[u[part]], self.y[v[part]])
        # Rounding to bytes is off by up to half a step, evenly, in each dimension of a vector of length 1.
        width = FINE * np.sqrt((self.step[u] ** 2 + self.step[v] ** 2) / 12) + 1e-5
        keep = near + width >= self.threshold
        u, v, near, width = u[keep], v[keep], near[keep], width[keep]
        if self.table:
            earlier = (self.keys[u, : self.table] == self.keys[v, : self.table]).any(1)
            u, v, near, width = u[~earlier], v[~earlier], near[~earlier], width[~earlier]
        return u, v, near - width >= self.threshold

    def judged(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, n): a has n links here and is connected with b at least; or n is -1, and the pair is to be recomputed."""
        split = int(np.searchsorted(self.own, self.own[-1]))  # two blocks of a hot bucket are compared across alone
        n, block = len(self.ids), 1024
        spans = lambda lo, hi: [slice(i, min(i + block, hi)) for i in range(lo, hi, block)]
        if split:
            tasks = [(a, b) for a in spans(0, split) for b in spans(split, n)]
        else:
            tasks = [(a, b) for a in spans(0, n) for b in spans(0, n) if a.start <= b.start]
        links, root = np.zeros(n, np.int64), np.arange(n)
        for a, b in tasks:
            u, v, sure = self.compared(a, b)
            if not len(u):
                continue
            yield np.minimum(self.ids[u], self.ids[v])[~sure], np.maximum(self.ids[u], self.ids[v])[~sure], np.full(int((~sure).sum()), -1)
            u, v = u[sure], v[sure]
            links += np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
            if len(u):
                own = np.arange(n)
                root = roots(n, np.concatenate([u, own]), np.concatenate([v, root]))
        some = np.flatnonzero(links)
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, root, self.ids)
        yield self.ids[some], least[root[some]], links[some]


def _judge(shared, threshold: float, z: float):
    names = ["a", "b", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = shared.value
        held: list[pa.RecordBatch] = []
        out: list[tuple] = []

        def work(table: pa.Table) -> None:
            key, part, dim, t, own = (table.column(c).to_numpy() for c in ("key", "part", "dim", "t", "own"))
            edges = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (dim[1:] != dim[:-1])) + 1
            bounds = np.concatenate([[0], edges, [len(key)]])
            bodies = table.column("body")
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if hi - lo > 1:
                    d = int(dim[lo])
                    bucket = _Bucket(bodies.slice(lo, hi - lo).to_pylist(), own[lo:hi], d, plans[d][1], int(t[lo]), threshold, z)
                    out.extend(x for x in bucket.judged() if len(x[0]))

        def emit() -> pa.RecordBatch:
            rows = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, part = batch.column("key").to_numpy(), batch.column("part").to_numpy()
            new = (key != key[-1]) | (part != part[-1])
            # The last bucket may go on in the next batch.
            last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            if last:
                work(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif held and (held[-1].column("key")[-1].as_py() != key[0] or held[-1].column("part")[-1].as_py() != part[0]):
                work(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(last))
            yield emit()
        if held:
            work(pa.Table.from_batches(held))
        yield emit()

    return run


def _exact(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("xa").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                x, y = (part.column(c).flatten().to_numpy().reshape(part.num_rows, dim).astype(np.float64) for c in ("xa", "xb"))
                s = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
                yield part.select(["a", "b"]).filter(pa.array(s >= threshold - 1e-12))

    return run


def _hash(values: np.ndarray, salt: int) -> np.ndarray:
    """One long for each row of doubles."""
    bits = np.ascontiguousarray(values).view(np.uint64) ^ K.mix(np.arange(values.shape[1], dtype=np.uint64) + np.uint64(salt))
    return K.mix(K.mix(bits).sum(1, dtype=np.uint64)).view(np.int64)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, u, ha, hb) of the usable rows of (id, e): unit vectors, and the hash of the vector as it is."""
    for batch in batches:
        for dim, ids, e in _by_dim(batch):
            good = np.isfinite(e).all(1) & (e != 0).any(1)  # a null reads as nan
            ids, e = ids.filter(pa.array(good)), e[good] + 0.0  # -0.0 equals 0.0
            # First to a largest element of 1, so that no square overflows or vanishes.
            u = e / np.abs(e).max(1, keepdims=True)
            u /= np.sqrt((u * u).sum(1, keepdims=True))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * dim), pa.array(u.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([ids, lists, pa.array(_hash(e, 0)), pa.array(_hash(e, 1))], names=["id", "u", "ha", "hb"])


def _usable(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    return cut(arrow(rows.where("id is not null and e is not null and size(e) > 0"), _units, "id bigint, u array<float>, ha bigint, hb bigint"))


def near_duplicate_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, z: float = Z, hot: int = HOT) -> DataFrame:
    spark = embeddings.sparkSession
    usable = _usable(embeddings)
    ids = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id")).where("vec_id is not null")

    multi = cut(usable.groupBy("ha", "hb").agg(F.count("*").alias("c"), F.min("id").alias("node")).where("c > 1").select("ha", "hb", "node"))
    flagged = maybe_in(usable, "ha", multi.select("ha"), "copied")
    alone = flagged.where("not copied").select("id", "u")
    copied = flagged.where("copied").groupBy("ha", "hb").agg(F.min("id").alias("id"), F.first("u").alias("u")).select("id", "u")
    nodes = alone.union(copied)
    dims = {r["d"]: r["count"] for r in nodes.groupBy(F.size("u").alias("d")).count().collect()}  # a row for each dimension
    plans = spark.sparkContext.broadcast({d: plan(n, threshold, recall) for d, n in dims.items()})

    keys = arrow(nodes.select("id", "u"), _keyer(plans), "key bigint")
    busy = cut(keys.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("key", F.ceil(F.col("c") / hot).cast("int").alias("s")))
    n_busy = busy.count()
    coded = arrow(nodes, _coder(plans), "key bigint, id bigint, dim int, t int, body binary")
    placed = coded.select("key", F.lit(0).alias("part"), "dim", "t", F.lit(0).alias("own"), "body")
    if n_busy:
        split = coded.join(F.broadcast(busy) if n_busy <= BROADCAST_ROWS else busy, "key", "left")
        own = F.coalesce(F.pmod(F.xxhash64("id"), F.col("s")).cast("int"), F.lit(0))
        split = split.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("s", F.lit(1)) - 1)))
        part = F.least("own", "other") * F.coalesce("s", F.lit(1)) + F.greatest("own", "other")
        placed = split.select("key", part.alias("part"), "dim", "t", "own", "body")
    placed = placed.repartition("key", "part").sortWithinPartitions("key", "part", "dim")
    marks = cut(arrow(placed, _judge(plans, threshold, z), "a bigint, b bigint, n bigint"))

    open_pairs = marks.where("n = -1").select("a", "b").distinct()
    one, two = (nodes.select(F.col("id").alias(c), F.col("u").alias(f"x{c}")) for c in ("a", "b"))
    both = open_pairs.join(one, "a").join(two, "b").select("a", "b", "xa", "xb")
    exact = cut(arrow(both, _exact(threshold), "a bigint, b bigint").distinct())
    counted = marks.where("n > 0").select(F.col("a").alias("node"), "n")
    one_each = lambda c: exact.select(F.col(c).alias("node"), F.lit(1).cast("bigint").alias("n"))
    links = counted.union(one_each("a")).union(one_each("b")).groupBy("node").agg(F.sum("n").alias("links"))
    edges = marks.where("n > 0").select("a", "b").union(exact)
    linked = cut(links.join(components(edges).withColumnRenamed("node", "other"), F.col("node") == F.col("other"), "left").select("node", "root", "links"))

    named = flagged.where("copied").select("id", "ha", "hb").join(multi, ["ha", "hb"], "left")
    named = flagged.where("not copied").select("id", F.col("id").alias("node")).union(named.select("id", F.coalesce("node", "id").alias("node")))
    found = named.distinct().join(linked, "node", "left").select(F.col("id").alias("vec_id"), F.coalesce("root", "node").alias("root"), "links")
    found = found.union(ids.select("vec_id", F.lit(None).cast("bigint"), F.lit(None).cast("bigint")))
    least = F.coalesce(F.min("root"), F.col("vec_id")).alias("class_id")
    return found.groupBy("vec_id").agg(least, F.coalesce(F.sum("links"), F.lit(0)).alias("links"))


ORACLE = f"""
WITH RECURSIVE usable AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), nodes AS (SELECT e, min(vec_id) AS node FROM usable GROUP BY e),
pairs AS (
  SELECT a.node AS x, b.node AS y FROM nodes a JOIN nodes b ON a.node <> b.node AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach AS (
  SELECT node, node AS other FROM nodes UNION SELECT r.node, p.y FROM reach r JOIN pairs p ON p.x = r.other
), classes AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
counts AS (SELECT x AS node, count(*) AS links FROM pairs GROUP BY x),
named AS (
  SELECT DISTINCT u.vec_id, n.node FROM usable u JOIN nodes n USING (e)
), found AS (
  SELECT vec_id, root, links FROM named JOIN classes USING (node) LEFT JOIN counts USING (node)
  UNION ALL SELECT vec_id, NULL, NULL FROM embeddings WHERE vec_id IS NOT NULL
)
SELECT vec_id, coalesce(min(root), vec_id) AS class_id, CAST(coalesce(sum(links), 0) AS BIGINT) AS links FROM found GROUP BY vec_id
"""
