"""The cleaning rules once more, as SQL over ``raw_sales``."""

from sumstead.plans.views import RAW_SALES_SQL, RUN_LOG_SQL

NORMALIZED_SQL = """
trimmed AS (
  SELECT *, nullif(regexp_replace(order_id, '^\\s+|\\s+$', '', 'g'), '') AS o,
    nullif(regexp_replace(date, '^\\s+|\\s+$', '', 'g'), '') AS d,
    nullif(upper(regexp_replace(store_id, '^\\s+|\\s+$', '', 'g')), '') AS s,
    nullif(upper(regexp_replace(product_id, '^\\s+|\\s+$', '', 'g')), '') AS p,
    nullif(regexp_replace(qty, '^\\s+|\\s+$', '', 'g'), '') AS qt,
    nullif(regexp_replace(amount, '^\\s+|\\s+$', '', 'g'), '') AS a,
    nullif(regexp_replace(payment, '^\\s+|\\s+$', '', 'g'), '') AS payment_method
  FROM raw_sales),
typed AS (
  SELECT *,
    CASE WHEN regexp_full_match(d, '\\d{4}-\\d{2}-\\d{2}') THEN cast(try_strptime(d, '%Y-%m-%d') AS DATE)
         WHEN regexp_full_match(d, '\\d{4}/\\d{2}/\\d{2}') THEN cast(try_strptime(d, '%Y/%m/%d') AS DATE)
         WHEN regexp_full_match(d, '\\d{2}-\\d{2}-\\d{4}') THEN cast(try_strptime(d, '%d-%m-%Y') AS DATE) END AS sale_date,
    CASE WHEN regexp_full_match(qt, '-?\\d+') THEN try_cast(qt AS BIGINT) END AS quantity,
    try_cast(trim(replace(replace(a, '¥', ''), ',', '')) AS DECIMAL(28, 10)) AS units
  FROM trimmed),
cand AS (
  SELECT source_row_number, coalesce(upper(o), 'missing-row-' || source_row_number) AS order_id,
    sale_date, CASE WHEN sale_date IS NULL THEN 'invalid:' || coalesce(date, 'None') END AS bad_date,
    s AS store_id, p AS product_id,
    quantity, CASE WHEN quantity IS NULL THEN 'invalid:' || coalesce(qty, 'None') END AS bad_quantity,
    CASE WHEN units * 100 = floor(units * 100) THEN cast(units * 100 AS BIGINT) END AS amount_cents,
    CASE WHEN units IS NULL OR units * 100 <> floor(units * 100) THEN 'invalid:' || coalesce(amount, 'None') END AS bad_amount,
    payment_method,
    CASE WHEN sale_date IS NOT NULL AND NOT regexp_full_match(d, '\\d{4}-\\d{2}-\\d{2}') THEN date END AS date_repair,
    CASE WHEN s <> store_id THEN store_id END AS store_repair,
    CASE WHEN p <> product_id THEN product_id END AS product_repair,
    CASE WHEN starts_with(a, '¥') AND units * 100 = floor(units * 100) THEN amount END AS amount_repair
  FROM typed)"""

JUDGED_SQL = """
stores AS (SELECT store_id, store_name, category, district FROM raw_stores),
products AS (
  SELECT product_id, product_name, product_category, cast(cast(unit_price AS DECIMAL(28, 10)) * 100 AS BIGINT) AS unit_price_cents
  FROM raw_products),
ranked AS (
  SELECT *, first_value(source_row_number) OVER same_content AS kept_row,
    row_number() OVER same_content AS copy_number
  FROM cand
  WINDOW same_content AS (PARTITION BY order_id, sale_date, bad_date, store_id, product_id, quantity, bad_quantity,
    amount_cents, bad_amount, payment_method ORDER BY source_row_number)),
counted AS (SELECT *, count(*) OVER (PARTITION BY order_id) AS contents FROM ranked WHERE copy_number = 1),
judged AS (
  SELECT counted.*, unit_price_cents,
    CASE WHEN contents > 1 THEN 'conflicting_order_id'
         WHEN sale_date IS NULL THEN 'invalid_date'
         WHEN stores.store_id IS NULL THEN 'unknown_store'
         WHEN products.product_id IS NULL THEN 'unknown_product'
         WHEN quantity IS NULL OR quantity <= 0 THEN 'invalid_quantity'
         WHEN amount_cents IS NULL THEN 'missing_or_invalid_amount'
         WHEN abs(amount_cents) <> quantity * unit_price_cents THEN 'amount_unit_price_mismatch'
         WHEN payment_method IS NULL THEN 'missing_payment_method' END AS reason_code
  FROM counted
  LEFT JOIN stores ON stores.store_id = counted.store_id
  LEFT JOIN products ON products.product_id = counted.product_id),
repairs AS (
  SELECT source_row_number, order_id, 'date_format_normalized' AS reason_code, 'date' AS field, date_repair AS original FROM cand WHERE date_repair IS NOT NULL
  UNION ALL SELECT source_row_number, order_id, 'identifier_normalized', 'store_id', store_repair FROM cand WHERE store_repair IS NOT NULL
  UNION ALL SELECT source_row_number, order_id, 'identifier_normalized', 'product_id', product_repair FROM cand WHERE product_repair IS NOT NULL
  UNION ALL SELECT source_row_number, order_id, 'currency_symbol_removed', 'amount', amount_repair FROM cand WHERE amount_repair IS NOT NULL),
events AS (
  SELECT source_row_number, order_id AS record_key, 'repaired' AS action, reason_code,
    '{"field":"' || field || '","original":"' || original || '"}' AS details FROM repairs
  UNION ALL
  SELECT source_row_number, order_id, 'deduplicated', 'canonical_duplicate', '{"kept_source_row_number":' || kept_row || '}'
  FROM ranked WHERE copy_number > 1
  UNION ALL
  SELECT source_row_number, order_id, 'quarantined', reason_code, '{}' FROM judged WHERE reason_code IS NOT NULL
  UNION ALL
  SELECT source_row_number, order_id, 'classified', 'refund_preserved', '{"amount_cents":' || amount_cents || '}'
  FROM judged WHERE reason_code IS NULL AND amount_cents < 0),
accepted AS (
  SELECT source_row_number, order_id, sale_date, store_id, product_id, quantity, amount_cents, payment_method
  FROM judged WHERE reason_code IS NULL),
summary AS (
  SELECT cast((SELECT count(*) FROM cand) AS BIGINT) AS raw_sales_records,
    (SELECT count(*) FROM accepted) AS accepted_sales_records,
    (SELECT count(*) FROM ranked WHERE copy_number > 1) AS deduplicated_records,
    (SELECT count(*) FROM judged WHERE reason_code IS NOT NULL) AS quarantined_records,
    (SELECT count(*) FROM repairs) AS repair_events,
    (SELECT count(*) FROM accepted WHERE amount_cents < 0) AS refund_records)"""

CANDIDATES = f"WITH {RAW_SALES_SQL},{NORMALIZED_SQL}"
CLEANED = f"{CANDIDATES},{JUDGED_SQL}"

# The same rows as CSV files number them: from 2, in row order.
RENUMBERED = CLEANED.replace("raw_sales AS (", "raw_rows AS (", 1).replace(
    "raw_stores AS (",
    "raw_sales AS (SELECT * REPLACE (cast(1 + row_number() OVER (ORDER BY source_row_number) AS BIGINT) AS source_row_number) "
    "FROM raw_rows),\nraw_stores AS (", 1,
)

_JSON_CELLS = " || ', ' || ".join(
    f"'\"{c}\": \"' || {c} || '\"'" for c in ("amount", "date", "order_id", "payment", "product_id", "qty", "store_id")
)
_PAYLOAD_CELLS = " || ',' || ".join(
    f"'\"{c}\":\"' || {c} || '\"'" for c in ("order_id", "date", "store_id", "product_id", "qty", "amount", "payment")
)
_RATE = "format('{:.2f}', accepted_sales_records / raw_sales_records * 100)::DOUBLE"
_CONTENT = (
    "order_id, sale_date, bad_date, store_id, product_id, quantity, bad_quantity, amount_cents, bad_amount, payment_method"
)

ORACLES = {
    "q_s1_text_scan": f"{CANDIDATES} SELECT * EXCLUDE (source_row_number) FROM raw_sales",
    "q_s2_row_numbers": f"{RENUMBERED} SELECT source_row_number, order_id, date, amount FROM raw_sales",
    "q_s2_quoted_rows": """
        WITH rows AS (SELECT conv_id, turn, coalesce(text, '') || chr(10) || '"' || coalesce(role, '') || '",' || chr(10) AS text FROM conversations)
        SELECT row_number() OVER (ORDER BY conv_id, turn, text) + 1 AS source_row_number, cast(conv_id AS VARCHAR) AS conv_id,
          cast(turn AS VARCHAR) AS turn, text, FALSE AS malformed FROM rows""",
    "q_s3_ragged_rows": """
        SELECT cast(o_orderkey AS VARCHAR) AS k,
          CASE o_orderkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'a, b' WHEN 2 THEN '' ELSE '1' END AS first,
          CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 2 THEN '' WHEN 3 THEN '2' END AS second,
          o_orderkey % 4 = 3 AS malformed
        FROM orders""",
    "q_s4_fingerprints": f"{CANDIDATES} SELECT source_row_number, sha256('{{' || {_JSON_CELLS} || '}}') AS fingerprint FROM raw_sales",
    "q_s5_payloads": f"{CANDIDATES} SELECT source_row_number, '{{' || {_PAYLOAD_CELLS} || '}}' AS payload FROM raw_sales",
    "q_s6_source_counts": f"""{CANDIDATES}, named AS (
        SELECT 'sales' AS source_name FROM raw_sales UNION ALL SELECT 'stores' FROM raw_stores UNION ALL SELECT 'products' FROM raw_products)
        SELECT coalesce(source_name, 'total') AS source_name, count(*) AS record_count FROM named GROUP BY ROLLUP (source_name)""",
    "q_s7_replaced_runs": f"""{CANDIDATES}
        SELECT cast(1 AS BIGINT) AS run_id, 'superseded' AS status, cast(0 AS BIGINT) AS visible_records
        UNION ALL SELECT 2, 'completed',
          (SELECT count(*) FROM raw_sales) + (SELECT count(*) FROM raw_stores) + (SELECT count(*) FROM raw_products)""",
    "q_s8_latest_run": f"""WITH {RUN_LOG_SQL}
        SELECT workspace_slug, run_id AS latest_run_id FROM runs WHERE status = 'completed'
        QUALIFY row_number() OVER (PARTITION BY workspace_slug ORDER BY run_id DESC) = 1""",
    "q_s9_run_status": f"""WITH {RUN_LOG_SQL}
        SELECT run_id, workspace_slug,
          CASE WHEN status = 'completed' AND run_id < max(CASE WHEN status = 'completed' THEN run_id END) OVER (PARTITION BY workspace_slug)
               THEN 'superseded' ELSE status END AS status FROM runs""",
    "q_s10_clean_tables": f"{RENUMBERED} SELECT * FROM accepted",
    "q_s11_event_table": f"{RENUMBERED} SELECT 'sales' AS source_name, * FROM events",
    "q_n1_identifiers": f"""{CANDIDATES}
        SELECT source_row_number, s AS store_id_value, CASE WHEN s <> store_id THEN 'identifier_normalized' END AS store_id_reason,
          upper(o) AS order_id_value, CASE WHEN upper(o) <> order_id THEN 'identifier_normalized' END AS order_id_reason FROM trimmed""",
    "q_n2_texts": f"{CANDIDATES} SELECT source_row_number, payment_method AS payment_value FROM trimmed",
    "q_n3_dates": f"""{CANDIDATES}
        SELECT source_row_number, sale_date AS date_value, CASE WHEN date_repair IS NOT NULL THEN 'date_format_normalized' END AS date_reason
        FROM cand""",
    "q_n4_integers": f"{CANDIDATES} SELECT source_row_number, quantity AS qty_value FROM typed",
    "q_n5_money": f"""{CANDIDATES}
        SELECT source_row_number, amount_cents AS amount_value,
          CASE WHEN amount_repair IS NOT NULL THEN 'currency_symbol_removed' END AS amount_reason FROM cand""",
    "q_n6_missing_keys": f"{CANDIDATES} SELECT source_row_number, order_id FROM cand",
    "q_n7_repairs": f"{CLEANED} SELECT * FROM events WHERE action = 'repaired'",
    "q_n8_contents": f"{CANDIDATES} SELECT source_row_number, {_CONTENT} FROM cand",
    "q_n22_entity_keys": """
        WITH keys AS (
          SELECT doc_id, replace(replace(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')), 'ß', 'ss'), 'ς', 'σ') AS entity_key
          FROM documents)
        SELECT doc_id, md5(entity_key) AS key_md5, cast(length(entity_key) AS INTEGER) AS key_chars FROM keys""",
    "q_n23_acceptance_rate": f"{CLEANED} SELECT {_RATE} AS acceptance_rate FROM summary",
    "q_f5_quarantine_rules": f"{CLEANED} SELECT source_row_number, order_id, reason_code FROM judged WHERE reason_code IS NOT NULL",
    "q_j3_unknown_keys": f"""{CLEANED}
        SELECT source_row_number, cand.store_id, cand.product_id, stores.store_id IS NULL AS unknown_store, products.product_id IS NULL AS unknown_product
        FROM cand LEFT JOIN stores ON stores.store_id = cand.store_id LEFT JOIN products ON products.product_id = cand.product_id
        WHERE stores.store_id IS NULL OR products.product_id IS NULL""",
    "q_j4_price_lookup": f"""{CLEANED}
        SELECT source_row_number, unit_price_cents, abs(amount_cents) = quantity * unit_price_cents AS price_matches
        FROM cand JOIN products ON products.product_id = cand.product_id""",
    "q_a6_quality_breakdown": f"{CLEANED} SELECT action, reason_code, count(*) AS event_count FROM events GROUP BY ALL",
    "q_a7_run_summary": f"""{CLEANED}
        SELECT *, (SELECT count(*) FROM stores) AS store_records, (SELECT count(*) FROM products) AS product_records FROM summary""",
    "q_a8_conflict_keys": f"""{CLEANED}
        SELECT order_id, count(*) AS contents FROM ranked WHERE copy_number = 1 GROUP BY order_id HAVING count(*) > 1""",
    "q_w1_duplicates": f"{CLEANED} SELECT * FROM events WHERE action = 'deduplicated'",
    "q_w2_conflicts": f"{CLEANED} SELECT source_row_number, order_id FROM counted WHERE contents > 1",
    "q_u1_ledger": f"{CLEANED} SELECT 'sales' AS source_name, * FROM events",
    "q_q1_dimensions": """
        SELECT cast(0 AS BIGINT) AS incomplete_rows, cast(0 AS BIGINT) AS repeated_keys, 'stores' AS table_name
        UNION ALL SELECT 0, 0, 'products'
        UNION ALL SELECT count(*) FILTER (p_brand = 'Brand#1'),
          count(*) FILTER (p_brand <> 'Brand#1') - count(DISTINCT p_brand) FILTER (p_brand <> 'Brand#1'), 'broken' FROM part""",
    "q_q2_normalized_facts": f"""{CANDIDATES}
        SELECT source_row_number, {_CONTENT},
          cast((date_repair IS NOT NULL)::INT + (store_repair IS NOT NULL)::INT + (product_repair IS NOT NULL)::INT
               + (amount_repair IS NOT NULL)::INT AS INTEGER) AS n_repairs FROM cand""",
    "q_q3_quarantined": f"{CLEANED} SELECT reason_code, count(*) AS quarantined FROM judged WHERE reason_code IS NOT NULL GROUP BY 1",
    "q_q4_refunds": f"{CLEANED} SELECT * FROM events WHERE action = 'classified'",
    "q_q5_ledger_by_row": f"{CLEANED} SELECT source_row_number, count(*) AS event_count FROM events GROUP BY 1",
    "q_q6_accepted": f"{CLEANED} SELECT * FROM accepted",
    "q_q7_conservation": f"""{CLEANED}
        SELECT raw_sales_records, accepted_sales_records + deduplicated_records + quarantined_records AS accounted_records,
          raw_sales_records = accepted_sales_records + deduplicated_records + quarantined_records AS conserved FROM summary""",
    "q_q8_quality_summary": f"""{CLEANED}, reasons AS (SELECT action, reason_code, count(*) AS n FROM events GROUP BY ALL)
        SELECT summary.*, {_RATE} AS acceptance_rate,
          (SELECT string_agg(action || '/' || reason_code || '/' || n, ';' ORDER BY action, reason_code) FROM reasons) AS reasons
        FROM summary""",
    "q_q8_stored_quality_summary": f"""{RENUMBERED}, reasons AS (SELECT action, reason_code, count(*) AS n FROM events GROUP BY ALL)
        SELECT summary.*, (SELECT count(*) FROM stores) AS store_records, (SELECT count(*) FROM products) AS product_records,
          {_RATE} AS acceptance_rate,
          (SELECT string_agg(action || '/' || reason_code || '/' || n, ';' ORDER BY action, reason_code) FROM reasons) AS reasons
        FROM summary""",
    "q_q9_end_to_end": f"""{RENUMBERED}
        SELECT cast(1 AS BIGINT) AS run_id, 'superseded' AS status, * FROM summary UNION ALL SELECT 2, 'completed', * FROM summary""",
    "q_e1_processor": f"{CLEANED} SELECT store_id, cast(sum(amount_cents) AS BIGINT) AS revenue FROM accepted GROUP BY 1",
}
