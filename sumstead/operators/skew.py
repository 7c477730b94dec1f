"""Joins to unique keys that stay even when one key holds much of the data.

A side is broadcast only if the optimizer's size estimate is under a bound.
Beyond it, the heaviest join keys (found by a frequent-items sketch, so the
list has a fixed maximum length) are spread over many slots and the one row
that matches each of them is copied to every slot.  All keys stay exact: the
sketch only decides where rows go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
IN_MEMORY = 4
HOT_KEYS = 4096
SKETCH_ITEMS = 40_000
HOT_ROWS = 200_000
SLOTS = 256


def planned_bytes(df: DataFrame) -> int | None:
    """Bytes in memory of all tables a frame reads, after pruning; None where the plan can't be seen, as through Spark Connect.

    The optimizer multiplies its estimates at every join.  The frames checked
    here have one row per key, so what they read bounds them far better.  Files
    are compressed, so their bytes count IN_MEMORY times.
    """
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return None
    leaves = plan.queryExecution().optimizedPlan().collectLeaves()
    return IN_MEMORY * sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def fits_broadcast(df: DataFrame, bound: int | None = None) -> bool:
    size = planned_bytes(df)
    return size is not None and size <= (BROADCAST_BYTES if bound is None else bound)


def hot_hashes(rows: DataFrame, key_hash: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hashes of the keys with at least ``hot_rows`` rows: HOT_KEYS at most."""
    sketch = rows.select(key_hash.alias("_hash")).agg(
        F.expr(f"approx_top_k(_hash, {HOT_KEYS}, {SKETCH_ITEMS})").alias("_top")
    )
    return (
        sketch.select(F.explode("_top").alias("_item"))
        .where(F.col("_item.count") >= hot_rows)
        .select(F.col("_item.item").alias("_hash"), F.lit(True).alias("_hot"))
    )


def mark_hot(rows: DataFrame, hot: DataFrame, key_hash: Column) -> DataFrame:
    """Adds ``_hash`` and ``_hot``; ``hot`` has HOT_KEYS rows at most."""
    return rows.withColumn("_hash", key_hash).join(F.broadcast(hot), "_hash", "left")


def slot_of(spread_by: list[str]) -> Column:
    """Slot of a hot row by its own content, the same on every retry."""
    return F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(SLOTS)).cast("int")).otherwise(0)


def join_one(rows: DataFrame, one: DataFrame, key: str, how: str = "inner",
             spread_by: list[str] | None = None, bound: int | None = None,
             hot_rows: int = HOT_ROWS, sketched: DataFrame | None = None) -> DataFrame:
    """Joins many rows to at most one row per key ("inner" or "left").

    ``key`` may be a struct column, whose nulls then match each other.
    ``spread_by`` names columns that tell the rows of one key apart;
    ``sketched`` is a cheaper frame with the same heavy keys.  If ``one`` can
    have more rows than what it reads, it must be a stored table.
    """
    if fits_broadcast(one, bound):
        return rows.join(F.broadcast(one), key, how)
    spread_by = spread_by or [c for c in rows.columns if c != key]
    key_hash = F.xxhash64(key)
    hot = hot_hashes(rows if sketched is None else sketched, key_hash, hot_rows)
    # Null keys match nothing; in a left join they are spread like a hot key.
    marked = mark_hot(rows, hot, key_hash).withColumn("_hot", F.col("_hot") | F.col(key).isNull())
    left = marked.withColumn("_slot", slot_of(spread_by)).drop("_hash", "_hot")
    slots = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SLOTS - 1))).otherwise(F.array(F.lit(0)))
    right = mark_hot(one, hot, key_hash).withColumn("_slot", F.explode(slots)).drop("_hash", "_hot")
    return left.join(right, [key, "_slot"], how).drop("_slot")
