"""What each turn of a conversation inherits from the one before.

A turn maps the context before it to the context after it.  Such maps compose,
and a composed map stays small, so a conversation of any length is folded in
chunks: maps are composed within chunks, chunk maps within chunks of chunks,
and contexts are handed back down.  No group holds more than CHUNK rows, save
the top one, which holds one row per CHUNK ** (levels - 1) turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumstead.operators.questions import (
    AOV_TREND,
    CATEGORY_LEADER,
    PRODUCT_RANKING,
    PRODUCT_REVENUE,
    STORE_COMPARISON,
)
from sumstead.session import cut_lineage

CHUNK = 32
LEVELS = 4

STATE = "struct<intent:string,product:string,month:int>"
# after[0]: from no context, after[1..4]: from each intent without a product;
# from a product: the same product in ``month`` if ``keep``, else ``product``.
MAP = f"struct<after:array<{STATE}>,keep:boolean,product:{STATE},month:int>"
PLAIN_INTENTS = (CATEGORY_LEADER, PRODUCT_RANKING, AOV_TREND, STORE_COMPARISON)


def state(intent: Column | str, product: Column | None, month: Column) -> Column:
    return F.struct(
        (F.lit(intent) if isinstance(intent, str) else intent).alias("intent"),
        (F.lit(None).cast("string") if product is None else product).alias("product"),
        month.cast("int").alias("month"),
    ).cast(STATE)


def _no_state() -> Column:
    return F.lit(None).cast(STATE)


def apply_map(f: Column, s: Column) -> Column:
    """The context after, given the context before."""
    position = F.lit(1)
    for i, intent in enumerate(PLAIN_INTENTS):
        position = F.when(s["intent"] == intent, i + 2).otherwise(position)
    kept = F.when(f["keep"], state(PRODUCT_REVENUE, s["product"], f["month"])).otherwise(f["product"])
    return F.when(s["intent"] == PRODUCT_REVENUE, kept).otherwise(F.element_at(f["after"], position))


def compose(f: Column, g: Column) -> Column:
    """First f, then g."""
    return F.struct(
        F.transform(f["after"], lambda s: apply_map(g, s)).alias("after"),
        (f["keep"] & g["keep"]).alias("keep"),
        F.when(f["keep"], g["product"]).otherwise(apply_map(g, f["product"])).alias("product"),
        g["month"].alias("month"),
    ).cast(MAP)


def turn_map(row: Column, kept: Column) -> Column:
    """A turn's map from its row, its own reading.

    ``own_state`` is what the turn yields by itself; a turn with a month that
    reads as a follow-up changes the month of the context instead.  ``kept``
    says for each of PLAIN_INTENTS whether its answer in ``month`` leaves a
    context.
    """
    carries = row["follow_up"] & row["month"].isNotNull()
    own, month = row["own_state"], row["month"]
    after = [own] + [
        F.when(carries, F.when(kept[i], state(intent, None, month))).otherwise(own) for i, intent in enumerate(PLAIN_INTENTS)
    ]
    renamed = F.when(row["match_count"] == 1, state(PRODUCT_REVENUE, row["matched"], month))
    return F.struct(
        F.array(*after).alias("after"),
        (carries & (row["match_count"] == 0)).alias("keep"),
        F.when(carries, renamed).otherwise(own).alias("product"),
        month.cast("int").alias("month"),
    ).cast(MAP)


def _entries(items: DataFrame, level: int, chunk: int) -> DataFrame:
    """items (conv, pos, map, row) with ``before``, the context before each.

    Turns come with ``kept`` instead of a map: a map is many times as large as
    what it follows from, so it is made behind the shuffle.
    """
    top, turns = level == 1, "kept" in items.columns
    key = ["conv"] if top else ["conv", "chunk"]
    grouped = (
        items.withColumn("chunk", F.lit(0).cast("bigint") if top else F.floor(F.col("pos") / chunk))
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "kept" if turns else "map", "row"))).alias("items"))
    )
    if turns:
        grouped = grouped.withColumn("items", F.transform("items", lambda t: F.struct(
            t["pos"].alias("pos"), turn_map(t["row"], t["kept"]).alias("map"), t["row"].alias("row"))))
    if top:
        entered = grouped.withColumn("entry", _no_state())
    else:
        # Only conversations with a second chunk need the level above.
        long = grouped.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv")
        maps = cut_lineage(grouped.join(long, "conv", "left_semi").select(
            "conv", F.col("chunk").alias("pos"),
            F.aggregate(
                F.slice("items", F.lit(2), F.size("items")),
                F.element_at("items", 1)["map"],
                lambda f, item: compose(f, item["map"]),
            ).alias("map"),
            F.lit(None).cast("string").alias("row"),
        ))
        above = _entries(maps, level - 1, chunk).select(
            "conv", F.col("pos").alias("chunk"), F.col("before").alias("entry")
        )
        entered = grouped.join(above, ["conv", "chunk"], "left")
    states = F.aggregate(
        "items",
        F.array(F.col("entry")),
        lambda seen, item: F.concat(seen, F.array(apply_map(item["map"], F.element_at(seen, -1)))),
    )
    return (
        entered.withColumn("_states", states)
        .select("conv", F.inline(F.arrays_zip("items", F.slice("_states", F.lit(1), F.size("items")).alias("before"))))
        .select("conv", "items.pos", "items.map", "items.row", "before")
    )


def contexts(turns: DataFrame, kept: dict[str, Column], conversation: str = "conv_id", order: str = "turn",
             longest: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Adds ``before``: the context each turn can continue, or null.

    ``turns`` has one row per (conversation, order) with the columns of
    ``read_questions`` and ``link_products`` and ``own_state``.  ``longest``
    is the largest order number, if known to be below ``chunk`` one level is
    enough.
    """
    names = [c for c in turns.columns]
    levels = 1 if longest is not None and longest < chunk else LEVELS
    items = turns.select(
        F.struct(conversation).alias("conv"), F.col(order).cast("bigint").alias("pos"),
        F.array(*[kept[i] for i in PLAIN_INTENTS]).alias("kept"), F.struct(*names).alias("row"),
    )
    if levels > 1:
        items = cut_lineage(items)
    return _entries(items, levels, chunk).select("row.*", "before")
