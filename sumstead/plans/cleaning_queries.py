"""Registered queries of the raw layer, the cell parsers and the cleaning."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumstead.functions import values
from sumstead.functions.display import acceptance_rate
from sumstead.functions.hashing import fingerprint
from sumstead.functions.text import entity_key
from sumstead.model import Source
from sumstead.operators import cleaning as c
from sumstead.operators.skew import fits_broadcast
from sumstead.plans import views as v
from sumstead.session import cut_lineage, new_folder
from sumstead.sources import runs as r
from sumstead.sources import scans

def write_csv(frame: DataFrame, path: str) -> str:
    frame.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                    ignoreTrailingWhiteSpace=False)
    return path


def raw_store(spark: SparkSession, sf_dir: str) -> r.RunStore:
    """The raw tables as CSV files, taken in twice."""
    base = new_folder(spark, "run")
    ordered = v.raw_sales(spark, sf_dir).orderBy("source_row_number")
    frames = {
        "sales": ordered, "stores": v.raw_stores(spark, sf_dir), "products": v.raw_products(spark, sf_dir)
    }
    sources = tuple(
        Source(name, write_csv(frame.drop("source_row_number"), f"{base}/csv/{name}"),
               role="fact" if name == "sales" else "dimension")
        for name, frame in frames.items()
    )
    store = r.RunStore(spark, base, replace(v.STAR_MODEL, slug="shop", sources=sources))
    store.ingest(replace=False)
    store.ingest(replace=True)
    return store


def run_store(spark: SparkSession, sf_dir: str) -> r.RunStore:
    """The raw tables taken in twice and processed twice."""
    store = raw_store(spark, sf_dir)
    store.process(c.restaurant_processor)
    store.process(c.restaurant_processor)
    return store


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = v.raw_sales(spark, sf_dir).drop("source_row_number")
    return scans.scan(spark, Source("sales", write_csv(raw, f"{new_folder(spark, "run")}/sales")))


def s1_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv(spark, sf_dir).select(*v.RAW_SALES_COLUMNS)


def s2_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = raw_store(spark, sf_dir)
    return scans.unpack(store.raw("sales"), ("order_id", "date", "amount"))


def s2_quoted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as CSV with line breaks, quotes and separators in each text, numbered as they were written."""
    rows = v.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit('\n"'), F.coalesce("role", F.lit("")), F.lit('",\n')).alias("text"))
    path = write_csv(rows.orderBy("conv_id", "turn", "text"), f"{new_folder(spark, "run")}/quoted")
    placed = cut_lineage(scans.scan(spark, Source("conversations", path, quoted_newlines=True)), "placed")
    return scans.number_rows(placed, scans.source_splits(placed)).select("source_row_number", "conv_id", "turn", "text", "malformed")


def s3_ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    line = (
        F.when(k % 4 == 0, F.concat(k, F.lit(",x,"), F.col("o_orderstatus")))
        .when(k % 4 == 1, F.concat(k, F.lit(",\"a, b\"")))
        .when(k % 4 == 2, F.concat(k, F.lit(",,")))
        .otherwise(F.concat(k, F.lit(",1,2,3")))
    )
    path = f"{new_folder(spark, "run")}/ragged"
    # One column whose name is the header line and whose values are the lines.
    v.table(spark, sf_dir, "orders").select(line.alias("k,first,second")).write.csv(
        path, header=True, sep="\t", quote="", escapeQuotes=False
    )
    return scans.scan(spark, Source("ragged", path)).select("k", "first", "second", "malformed")


def s4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.raw_sales(spark, sf_dir).select(
        "source_row_number", fingerprint(list(v.RAW_SALES_COLUMNS)).alias("fingerprint")
    )


def s5_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = v.RAW_SALES_COLUMNS
    payload = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names]))
    return v.raw_sales(spark, sf_dir).select("source_row_number", F.to_json(payload).alias("payload"))


def s6_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [
        frame.select(F.lit(name).alias("source_name"))
        for name, frame in (
            ("sales", v.raw_sales(spark, sf_dir)), ("stores", v.raw_stores(spark, sf_dir)),
            ("products", v.raw_products(spark, sf_dir)),
        )
    ]
    counts = r.source_counts(named[0].unionByName(named[1]).unionByName(named[2]))
    return counts.select(F.coalesce("source_name", F.lit("total")).alias("source_name"), "record_count")


def s7_replaced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = raw_store(spark, sf_dir)
    visible = store.raw_all().groupBy("run_id").agg(F.count(F.lit(1)).alias("visible_records"))
    return store.ingestion_runs().join(visible, "run_id", "left").select(
        "run_id", "status", F.coalesce("visible_records", F.lit(0)).cast("bigint").alias("visible_records")
    )


def s8_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.latest_completed(v.run_log(spark, sf_dir))


def s9_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.with_status(v.run_log(spark, sf_dir)).select("run_id", "workspace_slug", "status")


def s10_clean_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_store(spark, sf_dir).clean("sales").select(*c.ACCEPTED)


def s11_event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_store(spark, sf_dir).events().select(*c.LEDGER)


def q9_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = run_store(spark, sf_dir)
    summary = (
        "raw_sales_records bigint, accepted_sales_records bigint, deduplicated_records bigint, "
        "quarantined_records bigint, repair_events bigint, refund_records bigint"
    )
    return store.processing_runs().select("run_id", "status", F.from_json("detail", summary).alias("s")).select(
        "run_id", "status", "s.*"
    )


def _parsed(spark: SparkSession, sf_dir: str, **cells: tuple[str, ...]) -> DataFrame:
    return values.parse(v.raw_sales(spark, sf_dir), **cells)


def n1_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, identifier=("store_id", "order_id")).select(
        "source_row_number", "store_id_value", "store_id_reason", "order_id_value", "order_id_reason"
    )


def n2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, text=("payment",)).select("source_row_number", "payment_value")


def n3_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, date=("date",)).select("source_row_number", "date_value", "date_reason")


def n4_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, whole=("qty",)).select("source_row_number", "qty_value")


def n5_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, money=("amount",)).select("source_row_number", "amount_value", "amount_reason")


def n6_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("source_row_number", "order_id")


def n7_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.repair_events(candidates(spark, sf_dir)).drop("source_name")


def n8_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("source_row_number", *c.CONTENT)


def n22_entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts; their keys are compared by hash and length."""
    keys = v.table(spark, sf_dir, "documents").select("doc_id", entity_key(F.col("text")).alias("entity_key"))
    return keys.select("doc_id", F.md5("entity_key").alias("key_md5"), F.char_length("entity_key").alias("key_chars"))


def n23_acceptance_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).summary.select(
        acceptance_rate(F.col("accepted_sales_records"), F.col("raw_sales_records")).alias("acceptance_rate")
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.normalize_sales(v.raw_sales(spark, sf_dir))


def run(spark: SparkSession, sf_dir: str) -> c.CleanRun:
    return c.clean(v.raw_sales(spark, sf_dir), v.raw_stores(spark, sf_dir), v.raw_products(spark, sf_dir))


def f5_quarantine_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).judged.where(F.col("reason_code").isNotNull()).select(
        "source_row_number", "order_id", "reason_code"
    )


def _referred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with what their keys refer to; parsed once, also where products are too large to broadcast and keys are counted first."""
    rows = candidates(spark, sf_dir).select("source_row_number", "store_id", "product_id", "quantity", "amount_cents")
    products = c.canonicalize_products(v.raw_products(spark, sf_dir))
    if not fits_broadcast(products):
        rows = cut_lineage(rows, "candidates")
    return c.add_references(rows, c.canonicalize_stores(v.raw_stores(spark, sf_dir)), products, rows)


def j3_unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    referred = _referred(spark, sf_dir)
    return referred.where(F.col("known_store").isNull() | F.col("unit_price_cents").isNull()).select(
        "source_row_number", "store_id", "product_id",
        F.col("known_store").isNull().alias("unknown_store"), F.col("unit_price_cents").isNull().alias("unknown_product"),
    )


def j4_price_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    referred = _referred(spark, sf_dir)
    return referred.where(F.col("unit_price_cents").isNotNull()).select(
        "source_row_number", "unit_price_cents",
        (F.abs("amount_cents") == F.try_multiply(F.col("quantity"), F.col("unit_price_cents"))).alias("price_matches"),
    )


def a6_quality_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.quality_breakdown(run(spark, sf_dir).judged)


def a7_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = run(spark, sf_dir)
    return clean.summary.select(
        "*",
        clean.stores.agg(F.count(F.lit(1))).scalar().alias("store_records"),
        clean.products.agg(F.count(F.lit(1))).scalar().alias("product_records"),
    )


def a8_conflict_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.conflict_keys(c.distinct_contents(candidates(spark, sf_dir)))


def w1_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.duplicate_events(cut_lineage(candidates(spark, sf_dir), "candidates")).drop("source_name")


def w2_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)
    flagged = c.flag_conflicts(rows, c.distinct_contents(rows))
    return flagged.where("is_conflict").select("source_row_number", "order_id")


def u1_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).events


def q1_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of both dimension tables, and of one that breaks its contract."""
    clean = run(spark, sf_dir)
    broken = v.table(spark, sf_dir, "part").select(
        F.lit(1).alias("source_row_number"), F.nullif(F.col("p_brand"), F.lit("Brand#1")).alias("product_id"), "p_name"
    )
    frames = [
        c.dimension_violations(clean.stores, "store_id").withColumn("table_name", F.lit("stores")),
        c.dimension_violations(clean.products, "product_id").withColumn("table_name", F.lit("products")),
        c.dimension_violations(broken, "product_id").withColumn("table_name", F.lit("broken")),
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def q2_normalized_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)
    return rows.select("source_row_number", *c.CONTENT, F.size("repairs").alias("n_repairs"))


def q3_quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = run(spark, sf_dir).judged
    return judged.where(F.col("reason_code").isNotNull()).groupBy("reason_code").agg(
        F.count(F.lit(1)).alias("quarantined")
    )


def q4_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.outcome_events(run(spark, sf_dir).judged).where("action = 'classified'").drop("source_name")


def q5_ledger_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u1_ledger(spark, sf_dir).groupBy("source_row_number").agg(F.count(F.lit(1)).alias("event_count"))


def q6_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).accepted


def q7_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows are counted where they come from, not from what was judged."""
    raw = v.raw_sales(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    total = F.col("accepted_sales_records") + F.col("deduplicated_records") + F.col("quarantined_records")
    return run(spark, sf_dir).summary.select(
        raw.alias("raw_sales_records"), total.alias("accounted_records"), (raw == total).alias("conserved")
    )


def q8_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = run(spark, sf_dir).stored()
    return c.quality_summary(clean.summary, c.quality_breakdown(clean.judged))


def q8_stored_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the current stored run, with its store and product counts."""
    return run_store(spark, sf_dir).quality_summary()


def e1_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = c.restaurant_processor({
        "sales": v.raw_sales(spark, sf_dir), "stores": v.raw_stores(spark, sf_dir),
        "products": v.raw_products(spark, sf_dir),
    })
    return tables["sales"].groupBy("store_id").agg(F.sum("amount_cents").cast("bigint").alias("revenue"))


QUERIES = {
    f"q_{f.__name__}": f
    for f in (
        s1_text_scan, s2_row_numbers, s2_quoted_rows, s3_ragged_rows, s4_fingerprints, s5_payloads, s6_source_counts,
        s7_replaced_runs, s8_latest_run, s9_run_status, s10_clean_tables, s11_event_table,
        n1_identifiers, n2_texts, n3_dates, n4_integers, n5_money, n6_missing_keys, n7_repairs, n8_contents,
        n22_entity_keys, n23_acceptance_rate, f5_quarantine_rules, j3_unknown_keys, j4_price_lookup,
        a6_quality_breakdown, a7_run_summary, a8_conflict_keys, w1_duplicates, w2_conflicts, u1_ledger,
        q1_dimensions, q2_normalized_facts, q3_quarantined, q4_refunds, q5_ledger_by_row, q6_accepted,
        q7_conservation, q8_quality_summary, q8_stored_quality_summary, q9_end_to_end, e1_processor,
    )
}
