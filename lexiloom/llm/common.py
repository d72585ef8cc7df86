"""Spark plumbing that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.textkernel import release
from lexiloom.shared import cut
from lexiloom.shipping import ship

#: Slots of the id filter for each id, and the least and most slots: 0.5 MB to 16 MB of bits.
FILTER_SHARE, FILTER_LEAST, FILTER_MOST = 16, 1 << 22, 1 << 27


def fresh(*frames: DataFrame | list[str]) -> str:
    """A column prefix that no column of the frames has."""
    names = {c.lower() for f in frames for c in (f.columns if isinstance(f, DataFrame) else f)}
    prefix = "lx_"
    while any(c.startswith(prefix) for c in names):
        prefix = f"lx{uuid.uuid4().hex[:6]}_"
    return prefix


def arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow, with this package sent to the workers, which release memory after each task."""
    ship(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(tidy, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filter_slots(ids: int) -> int:
    """A power of two, FILTER_SHARE for each id within the bounds."""
    return min(max(FILTER_LEAST, 1 << (ids * FILTER_SHARE - 1).bit_length() if ids else 0), FILTER_MOST)


def maybe_in(df: DataFrame, key: str, ids: DataFrame, flag: str) -> DataFrame:
    """df with a boolean column flag: false only where df[key] is surely not in ids.

    ids has one column and is stored, as it is read twice. A bitmap is built with bit_or
    and broadcast; it grows with the number of ids, so that one row in FILTER_SHARE is
    flagged for nothing, up to FILTER_MOST slots. When ids outgrow that, more rows are
    flagged and go the exact way, but none is missed. Null keys are never flagged.
    """
    p = fresh(df, [flag])
    [name] = ids.columns
    slots = F.lit(filter_slots(ids.count()))
    slot = F.pmod(F.xxhash64(F.col(name).cast("bigint")), slots)
    words = (
        ids.select(slot.alias("s"))
        .groupBy(F.shiftright("s", 6).alias(f"{p}w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias(f"{p}b"))
    )
    at = F.pmod(F.xxhash64(F.col(key).cast("bigint")), slots)
    hit = F.expr(f"(({p}b >> cast({p}s & 63 as int)) & 1L) = 1L")
    return (
        df.withColumn(f"{p}s", F.when(F.col(key).isNotNull(), at))
        .withColumn(f"{p}w", F.shiftright(f"{p}s", 6))
        .join(F.broadcast(words), f"{p}w", "left")
        .withColumn(flag, F.coalesce(hit, F.lit(False)))
        .drop(f"{p}w", f"{p}s", f"{p}b")
    )


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose key is not in ids; null keys stay.

    Only rows that the id filter flags are shuffled for the exact anti join.
    """
    p = fresh(df)
    columns = df.columns
    [name] = ids.columns
    flagged = maybe_in(df, key, ids, f"{p}f")
    clear = flagged.where(~F.col(f"{p}f")).select(*[F.col(f"`{c}`") for c in columns])
    other = ids.select(F.col(name).alias(f"{p}id"))
    unsure = flagged.where(f"{p}f").join(other, F.col(key) == F.col(f"{p}id"), "left_anti")
    return clear.unionByName(unsure.select(*[F.col(f"`{c}`") for c in columns]))


def bounded(ids: DataFrame, rows: int, letters: int) -> DataFrame:
    """A fixed sample of (id, size, ...): at most rows rows, those with the least hash of id, as long as their sizes sum to letters at most."""
    some = ids.orderBy(F.xxhash64("id"), "id").limit(rows)  # so many rows at most are in the window's one task
    order = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("id"), "id")
    return some.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= letters).drop("upto", "size")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) edges of longs: (node, root), root the least node.

    Alternating large-star and small-star rounds, each two aggregations by node and
    one checkpoint, until every node points at a root that points nowhere. Nulls and
    loops are dropped; no edges give no rows.
    """
    e = cut(edges.where("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct())
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(linked.union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether each u of the (u, v) edges has one v, and no v is a u."""
    seen = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    seen = seen.union(e.select("v", F.lit(0), F.lit(1)))
    per = seen.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not per.where("up > 1 or (up = 1 and down = 1)").limit(1).count()
