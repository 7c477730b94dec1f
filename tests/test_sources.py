import csv
import hashlib
import io
import json
from dataclasses import replace

import pytest

from sumstead.model import GovernanceError, Source
from sumstead.operators.cleaning import DimensionError, restaurant_processor
from sumstead.operators.metrics import check_keys
from sumstead.plans import cleaning_queries as cq
from sumstead.plans.views import STAR_MODEL, star_workspace
from sumstead.sources import scans
from sumstead.sources.runs import RunStore

TEXT = (
    '﻿order_id,date,note\r\n1,2026-01-01,"a, b"\r\n\r\n2,,"line\nbreak ""q"""\r\n3\r\n4,x\r\n'
    '  ,  ,é\x0b"\\\r\n5,"",z\r\n6,,\r\n'
)


def test_csv_rows_numbers_and_fingerprints_match_python(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(TEXT.encode())
    expected = [
        (n, row, hashlib.sha256(json.dumps(row, ensure_ascii=False, sort_keys=True).encode()).hexdigest())
        for n, row in enumerate(csv.DictReader(io.StringIO(TEXT.lstrip("﻿"), newline="")), start=2)
    ]
    stored = str(tmp_path / "raw")
    scans.raw_records(scans.scan(spark, Source("sales", str(path), quoted_newlines=True))).write.parquet(stored)
    rows = spark.read.parquet(stored)
    numbered = scans.number_rows(rows, scans.source_splits(rows)).orderBy("source_row_number").collect()
    assert [(r.source_row_number, dict(r.payload), r.fingerprint) for r in numbered] == expected


def test_long_rows_are_marked_and_an_empty_file_is_an_error(spark, tmp_path):
    (tmp_path / "b.csv").write_text('a,b\n1,2\n"x,y","2,3",4\n')
    rows = scans.scan(spark, Source("sales", str(tmp_path / "b.csv"))).orderBy("a").collect()
    assert [(r.a, r.b, r.malformed) for r in rows] == [("1", "2", False), ("x,y", "2,3", True)]
    (tmp_path / "c.csv").write_text("")
    with pytest.raises(scans.SourceError):
        scans.scan(spark, Source("sales", str(tmp_path / "c.csv")))


def test_runs_replace_supersede_and_repeat(spark):
    store = cq.run_store(spark, "/root/testdata/sf0.001")
    statuses = {r.run_id: r.status for r in store.ingestion_runs().collect()}
    assert statuses == {1: "superseded", 2: "completed"}
    assert store.summary(1) == store.summary(2)
    assert store.clean("sales", 1).count() == store.clean("sales", 2).count() == store.summary()["accepted_sales_records"]

    def broken(raw):
        raise ValueError("stop")

    with pytest.raises(ValueError):
        store.process(broken)
    assert {r.run_id: r.status for r in store.processing_runs().collect()} == {1: "superseded", 2: "completed"}
    assert restaurant_processor is not broken


def test_raw_rows_do_not_wait_for_processing(spark):
    store = cq.raw_store(spark, "/root/testdata/sf0.001")
    assert store.processing_runs().count() == 0 and store.raw("sales").count() > 0


FILES = {
    "sales": ("order_id,date,store_id,product_id,qty,amount,payment", ["A1,2031-03-04,K1,G1,2,6.00,card", "A2,2031-03-05,K1,G1,1,3.00,card"]),
    "stores": ("store_id,store_name,category,district", ["K1,North,Grill,Hill"]),
    "products": ("product_id,product_name,product_category,unit_price", ["G1,Tea,Drinks,3.0"]),
}


def _store(spark, tmp_path, longer=None):
    sources = []
    for name, (head, rows) in FILES.items():
        extra = [rows[0].replace("A1", "A9").replace("K1", "K9").replace("G1", "G9") + ",one cell too many"] if name == longer else []
        path = tmp_path / f"{name}.csv"
        path.write_text("\n".join([head, *rows, *extra]) + "\n")
        sources.append(Source(name, str(path), role="fact" if name == "sales" else "dimension"))
    store = RunStore(spark, str(tmp_path / "runs"), replace(STAR_MODEL, slug="tea", sources=tuple(sources)))
    store.ingest()
    return store


def test_malformed_sales_are_logged_and_counted(spark, tmp_path):
    store = _store(spark, tmp_path, "sales")
    store.process(restaurant_processor)
    assert [r.reason_code for r in store.events().collect()] == ["malformed_row"]
    summary = store.summary()
    assert (summary["raw_sales_records"], summary["accepted_sales_records"], summary["quarantined_records"]) == (3, 2, 1)
    assert (summary["store_records"], summary["product_records"]) == (1, 1)
    row = store.quality_summary().first()
    assert row.reasons == "quarantined/malformed_row/1" and row.raw_sales_records == 3


@pytest.mark.parametrize("table", ["stores", "products"])
def test_a_malformed_dimension_row_fails_the_run(spark, tmp_path, table):
    store = _store(spark, tmp_path, table)
    with pytest.raises(DimensionError):
        store.process(restaurant_processor)
    assert store.processing_runs().count() == 0


def test_very_long_quoted_cells_in_ragged_rows(spark, tmp_path):
    cells = ("x" * 1_000_000, '""' * 100_000, "a, b")
    for cell in cells:
        (tmp_path / "long.csv").write_text(f'a,b\n1,"{cell}",3\n')
        row = scans.scan(spark, Source("sales", str(tmp_path / "long.csv"))).first()
        assert row.malformed and row.b == cell.replace('""', '"')


def test_a_broken_run_table_is_no_empty_one(spark, tmp_path):
    store = _store(spark, tmp_path)
    before = {p: p.read_bytes() for p in (tmp_path / "runs").rglob("*.parquet") if "run_id=1" in str(p)}
    for path in (tmp_path / "runs" / "tea" / "ingestion_runs").glob("*.parquet"):
        path.write_bytes(b"nothing")
    with pytest.raises(Exception):
        store.ingest()
    assert before and all(p.read_bytes() == data for p, data in before.items())


def test_a_failed_run_keeps_its_id(spark, tmp_path):
    store = _store(spark, tmp_path)

    def broken(raw):
        raise ValueError("stop")

    with pytest.raises(ValueError):
        store.process(broken)
    assert store.process(restaurant_processor) == 2


def test_repeated_dimension_keys_are_refused(spark):
    workspace = star_workspace(spark, "/root/testdata/sf0.001")
    check_keys(workspace)
    twice = workspace.tables["store"].union(workspace.tables["store"])
    with pytest.raises(GovernanceError):
        check_keys(replace(workspace, tables={**workspace.tables, "store": twice}))
