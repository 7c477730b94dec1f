"""From raw sales rows to accepted facts and the quality ledger.

Raw rows are grouped by their canonical content first (a map-side combined
hash aggregate), so copies vanish before anything else is shuffled; every
later step works on one row per distinct content.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumstead.functions import values
from sumstead.functions.display import acceptance_rate
from sumstead.operators.skew import HOT_ROWS, fits_broadcast, hot_hashes, join_one, mark_hot, slot_of
from sumstead.session import cut_lineage

# The canonical content of a row: two rows that agree here are copies.
CONTENT = (
    "order_id", "sale_date", "bad_date", "store_id", "product_id",
    "quantity", "bad_quantity", "amount_cents", "bad_amount", "payment_method",
)
RAW_CELLS = ("order_id", "date", "store_id", "product_id", "qty", "amount", "payment")
REPAIR_FIELDS = ("date", "store_id", "product_id", "amount")
LEDGER = ("source_name", "source_row_number", "record_key", "action", "reason_code", "details")
ACCEPTED = (
    "source_row_number", "order_id", "sale_date", "store_id", "product_id",
    "quantity", "amount_cents", "payment_method",
)
REPAIR_REASONS = (values.DATE_REPAIRED, values.IDENTIFIER_REPAIRED, values.CURRENCY_REPAIRED)


class DimensionError(ValueError):
    """A dimension table breaks its contract; the run must not be published."""


def row_surrogate(order_id: Column, row_number: Column) -> Column:
    """A row without an order id gets one no other row has."""
    return F.coalesce(order_id, F.concat(F.lit("missing-row-"), row_number.cast("string")))


def _invalid(value: Column, raw: Column) -> Column:
    """The raw cell, where it could not be read (null prints as None)."""
    return F.when(value.isNull(), F.concat(F.lit("invalid:"), F.coalesce(raw, F.lit("None"))))


def normalize_sales(raw: DataFrame) -> DataFrame:
    """Q2: seven text cells to typed values, with the repairs made."""
    parsed = values.parse(
        raw.select("source_row_number", *RAW_CELLS),
        identifier=("order_id", "store_id", "product_id"),
        text=("payment",), date=("date",), whole=("qty",), money=("amount",),
    )
    repairs = [
        F.when(
            F.col(f"{name}_reason").isNotNull(),
            F.struct(
                F.col(f"{name}_reason").alias("reason_code"),
                F.lit(name).alias("field"),
                F.col(name).alias("original"),
            ),
        )
        for name in REPAIR_FIELDS
    ]
    return parsed.select(
        "source_row_number",
        row_surrogate(F.col("order_id_value"), F.col("source_row_number")).alias("order_id"),
        F.col("date_value").alias("sale_date"),
        _invalid(F.col("date_value"), F.col("date")).alias("bad_date"),
        F.col("store_id_value").alias("store_id"),
        F.col("product_id_value").alias("product_id"),
        F.col("qty_value").alias("quantity"),
        _invalid(F.col("qty_value"), F.col("qty")).alias("bad_quantity"),
        F.col("amount_value").alias("amount_cents"),
        _invalid(F.col("amount_value"), F.col("amount")).alias("bad_amount"),
        F.col("payment_value").alias("payment_method"),
        F.array_compact(F.array(*repairs)).alias("repairs"),
    )


def canonicalize_stores(raw: DataFrame) -> DataFrame:
    """Q1 for stores."""
    texts = ("store_name", "category", "district")
    return values.parse(raw, identifier=("store_id",), text=texts).select(
        "source_row_number", *[F.col(f"{c}_value").alias(c) for c in ("store_id", *texts)]
    )


def canonicalize_products(raw: DataFrame) -> DataFrame:
    """Q1 for products."""
    texts = ("product_name", "product_category")
    return values.parse(raw, identifier=("product_id",), text=texts, money=("unit_price",)).select(
        "source_row_number",
        *[F.col(f"{c}_value").alias(c) for c in ("product_id", *texts)],
        F.col("unit_price_value").alias("unit_price_cents"),
    )


def dimension_violations(table: DataFrame, key: str) -> DataFrame:
    """Rows with an empty field and surplus rows of a key, as one row of counts."""
    fields = [c for c in table.columns if c != "source_row_number"]
    incomplete = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in fields])
    return (
        table.groupBy(key)
        .agg(
            F.count_if(incomplete).alias("_incomplete"),
            F.when(F.col(key).isNotNull(), F.count(F.lit(1)) - 1).otherwise(0).alias("_surplus"),
        )
        .agg(
            F.coalesce(F.sum("_incomplete"), F.lit(0)).alias("incomplete_rows"),
            F.coalesce(F.sum("_surplus"), F.lit(0)).alias("repeated_keys"),
        )
    )


def require_valid_dimension(table: DataFrame, key: str) -> DataFrame:
    """Fails the whole run, before anything is written, on any violation."""
    bad = dimension_violations(table, key).first()
    if bad["incomplete_rows"] or bad["repeated_keys"]:
        raise DimensionError(
            f"{key}: {bad['incomplete_rows']} incomplete rows, {bad['repeated_keys']} repeated keys"
        )
    return table


def distinct_contents(candidates: DataFrame) -> DataFrame:
    """One row per canonical content; the first source row is the one kept."""
    reasons = F.col("repairs.reason_code")
    repaired = [
        F.sum(F.size(reasons) - F.size(F.array_remove(reasons, reason))).cast("bigint").alias(reason)
        for reason in REPAIR_REASONS
    ]
    return candidates.groupBy(*CONTENT).agg(
        F.min("source_row_number").alias("source_row_number"),
        F.count(F.lit(1)).alias("copies"),
        *repaired,
    )


def _order_hash() -> Column:
    return F.xxhash64("order_id")


def flag_conflicts(candidates: DataFrame, contents: DataFrame, hot_rows: int = HOT_ROWS,
                   bound: int | None = None) -> DataFrame:
    """``is_conflict`` where an order id has more than one content.

    Order ids that hold very many rows are judged by comparing their smallest
    and largest content, which combines map-side; all others are counted in a
    window whose groups are small.
    """
    by_order = Window.partitionBy("order_id")
    if fits_broadcast(candidates, bound):
        return contents.withColumn("is_conflict", F.count(F.lit(1)).over(by_order) > 1)
    hot = hot_hashes(candidates, _order_hash(), hot_rows)
    content = F.struct(*CONTENT)
    hot_conflicts = (
        candidates.withColumn("_hash", _order_hash())
        .join(F.broadcast(hot), "_hash")
        .groupBy("order_id")
        .agg((F.min(content) != F.max(content)).alias("_hot_conflict"))
    )
    spread = mark_hot(contents, hot, _order_hash()).withColumn("_slot", slot_of(["source_row_number"]))
    others = Window.partitionBy("order_id", "_slot")
    # At most HOT_KEYS hashes are hot, so few order ids can be.
    return (
        spread.withColumn("_contents", F.count(F.lit(1)).over(others))
        .join(F.broadcast(hot_conflicts), "order_id", "left")
        .withColumn("is_conflict", F.coalesce("_hot_conflict", F.col("_contents") > 1))
        .drop("_hash", "_hot", "_slot", "_contents", "_hot_conflict")
    )


def quarantine_reason() -> Column:
    """The first rule that applies; null is accepted."""
    cents = F.col("amount_cents")
    expected = F.try_multiply(F.col("quantity"), F.col("unit_price_cents"))
    matches = F.coalesce((cents == expected) | (cents == -expected), F.lit(False))
    return (
        F.when(F.col("is_conflict"), "conflicting_order_id")
        .when(F.col("sale_date").isNull(), "invalid_date")
        .when(F.col("known_store").isNull(), "unknown_store")
        .when(F.col("unit_price_cents").isNull(), "unknown_product")
        .when(F.col("quantity").isNull() | (F.col("quantity") <= 0), "invalid_quantity")
        .when(cents.isNull(), "missing_or_invalid_amount")
        .when(~matches, "amount_unit_price_mismatch")
        .when(F.col("payment_method").isNull(), "missing_payment_method")
    )


def add_references(contents: DataFrame, stores: DataFrame, products: DataFrame, candidates: DataFrame,
                   hot_rows: int = HOT_ROWS, bound: int | None = None) -> DataFrame:
    """Is the store known, and what does the product cost."""
    known = stores.select("store_id", F.lit(True).alias("known_store"))
    priced = products.select("product_id", "unit_price_cents")
    how = {"how": "left", "spread_by": ["source_row_number"], "sketched": candidates,
           "hot_rows": hot_rows, "bound": bound}
    return join_one(join_one(contents, known, "store_id", **how), priced, "product_id", **how)


def judge(candidates: DataFrame, stores: DataFrame, products: DataFrame, hot_rows: int = HOT_ROWS,
          bound: int | None = None) -> DataFrame:
    """One row per distinct content with ``reason_code`` (null: accepted)."""
    flagged = flag_conflicts(candidates, distinct_contents(candidates), hot_rows, bound)
    referred = add_references(flagged, stores, products, candidates, hot_rows, bound)
    return referred.withColumn("reason_code", quarantine_reason())


def accepted_sales(judged: DataFrame) -> DataFrame:
    """Q6"""
    return judged.where(F.col("reason_code").isNull()).select(*ACCEPTED)


def repair_events(candidates: DataFrame) -> DataFrame:
    """Repairs of all candidates, also of rows that are dropped later."""
    # The outer form keeps the optimizer from copying the whole parse into a filter.
    exploded = candidates.select(
        F.lit("sales").alias("source_name"),
        "source_row_number",
        F.col("order_id").alias("record_key"),
        F.lit("repaired").alias("action"),
        F.explode_outer("repairs").alias("_repair"),
    )
    return exploded.where(F.col("_repair").isNotNull()).select(
        "source_name", "source_row_number", "record_key", "action",
        F.col("_repair.reason_code").alias("reason_code"),
        F.to_json(F.struct("_repair.field", "_repair.original")).alias("details"),
    )


def duplicate_events(candidates: DataFrame, hot_rows: int = HOT_ROWS, bound: int | None = None,
                     contents: DataFrame | None = None) -> DataFrame:
    """W1's dropped rows, each with the row number that was kept; ``contents`` are the distinct ones, if they are there already."""
    content = F.struct(*CONTENT).alias("_content")
    kept = (
        (distinct_contents(candidates) if contents is None else contents)
        .where(F.col("copies") > 1)
        .select(content, F.col("source_row_number").alias("kept_source_row_number"))
    )
    rows = candidates.select(content, "source_row_number")
    if not fits_broadcast(kept, bound):
        # Few contents have copies: rows of others go by a hash before anything is shuffled.
        mark = F.xxhash64("_content").alias("_mark")
        kept = cut_lineage(kept, "kept")
        marks = cut_lineage(kept.select(mark).distinct(), "marks")
        if fits_broadcast(marks, bound):
            rows = rows.withColumn("_mark", mark).join(F.broadcast(marks), "_mark", "left_semi").drop("_mark")
    return (
        join_one(rows, kept, "_content", "inner", ["source_row_number"], hot_rows=hot_rows, bound=bound)
        .where(F.col("source_row_number") != F.col("kept_source_row_number"))
        .select(
            F.lit("sales").alias("source_name"),
            "source_row_number",
            F.col("_content.order_id").alias("record_key"),
            F.lit("deduplicated").alias("action"),
            F.lit("canonical_duplicate").alias("reason_code"),
            F.to_json(F.struct("kept_source_row_number")).alias("details"),
        )
    )


def outcome_events(judged: DataFrame) -> DataFrame:
    """Quarantined rows, and Q4: accepted refunds."""
    refund = F.col("reason_code").isNull() & (F.col("amount_cents") < 0)
    return judged.where(F.col("reason_code").isNotNull() | refund).select(
        F.lit("sales").alias("source_name"),
        "source_row_number",
        F.col("order_id").alias("record_key"),
        F.when(F.col("reason_code").isNotNull(), "quarantined").otherwise("classified").alias("action"),
        F.coalesce("reason_code", F.lit("refund_preserved")).alias("reason_code"),
        F.when(F.col("reason_code").isNotNull(), "{}")
        .otherwise(F.to_json(F.struct("amount_cents")))
        .alias("details"),
    )


def ledger(candidates: DataFrame, judged: DataFrame) -> DataFrame:
    """Every decision, one row each."""
    return (
        repair_events(candidates)
        .unionByName(duplicate_events(candidates, contents=judged))
        .unionByName(outcome_events(judged))
    )


def run_summary(judged: DataFrame) -> DataFrame:
    """A7 in one aggregate over the judged contents."""
    accepted = F.col("reason_code").isNull()
    repairs = reduce(lambda a, b: a + b, [F.col(reason) for reason in REPAIR_REASONS])

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    return judged.agg(
        total(F.col("copies")).alias("raw_sales_records"),
        F.count_if(accepted).alias("accepted_sales_records"),
        total(F.col("copies") - 1).alias("deduplicated_records"),
        F.count_if(~accepted).alias("quarantined_records"),
        total(repairs).alias("repair_events"),
        F.count_if(accepted & (F.col("amount_cents") < 0)).alias("refund_records"),
    )


def quality_breakdown(judged: DataFrame) -> DataFrame:
    """Events per action and reason, without building the events."""
    refund = F.col("reason_code").isNull() & (F.col("amount_cents") < 0)
    entries = [
        F.struct(F.lit("repaired").alias("action"), F.lit(reason).alias("reason_code"), F.col(reason).alias("n"))
        for reason in REPAIR_REASONS
    ] + [
        F.struct(F.lit("deduplicated").alias("action"), F.lit("canonical_duplicate").alias("reason_code"),
                 (F.col("copies") - 1).alias("n")),
        F.struct(F.lit("classified").alias("action"), F.lit("refund_preserved").alias("reason_code"),
                 F.when(refund, 1).otherwise(0).cast("bigint").alias("n")),
        F.struct(F.lit("quarantined").alias("action"), F.coalesce("reason_code", F.lit("")).alias("reason_code"),
                 F.when(F.col("reason_code").isNotNull(), 1).otherwise(0).cast("bigint").alias("n")),
    ]
    return (
        judged.select(F.inline(F.filter(F.array(*entries), lambda e: e["n"] > 0)))
        .groupBy("action", "reason_code")
        .agg(F.sum("n").cast("bigint").alias("event_count"))
    )


def quality_summary(summary: DataFrame, by_reason: DataFrame) -> DataFrame:
    """Q8: a run's counts, its acceptance rate and its events per action and reason, a dozen at most."""
    listed = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("action", "reason_code", "event_count"))),
            lambda e: F.concat_ws("/", e["action"], e["reason_code"], e["event_count"].cast("string")),
        ), ";",
    )
    rate = acceptance_rate(F.col("accepted_sales_records"), F.col("raw_sales_records"))
    return summary.withColumns({"acceptance_rate": rate, "reasons": by_reason.agg(listed).scalar()})


def conflict_keys(contents: DataFrame) -> DataFrame:
    """Order ids with several contents."""
    return contents.groupBy("order_id").agg(F.count(F.lit(1)).alias("contents")).where(F.col("contents") > 1)


@dataclass(frozen=True)
class CleanRun:
    """Everything one cleaning run yields, all lazy; what several branches use is stored by ``stored``."""

    candidates: DataFrame
    judged: DataFrame
    stores: DataFrame
    products: DataFrame

    def stored(self) -> CleanRun:
        """The run with its candidates and judged rows written once."""
        candidates = cut_lineage(self.candidates, "candidates")
        return CleanRun(candidates, cut_lineage(judge(candidates, self.stores, self.products), "judged"), self.stores, self.products)

    @property
    def accepted(self) -> DataFrame:
        return accepted_sales(self.judged)

    @property
    def events(self) -> DataFrame:
        """Repairs, duplicates and outcomes start from the same rows, so these are stored first."""
        run = self.stored()
        return ledger(run.candidates, run.judged)

    @property
    def summary(self) -> DataFrame:
        return run_summary(self.judged)


def clean(raw_sales: DataFrame, raw_stores: DataFrame, raw_products: DataFrame) -> CleanRun:
    stores = canonicalize_stores(raw_stores)
    products = canonicalize_products(raw_products)
    candidates = normalize_sales(raw_sales)
    return CleanRun(candidates, judge(candidates, stores, products), stores, products)


def restaurant_processor(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The processor of the sales domain."""
    # Checked, joined and written: parsed once.
    stores = require_valid_dimension(cut_lineage(canonicalize_stores(raw["stores"]), "stores"), "store_id")
    products = require_valid_dimension(cut_lineage(canonicalize_products(raw["products"]), "products"), "product_id")
    candidates = normalize_sales(raw["sales"])
    # Accepted rows, events and the summary all start from the judged rows.
    run = CleanRun(candidates, judge(candidates, stores, products), stores, products).stored()
    return {
        "sales": run.accepted,
        "stores": stores.drop("source_row_number"),
        "products": products.drop("source_row_number"),
        "events": ledger(run.candidates, run.judged),
        "judged": run.judged,
    }
