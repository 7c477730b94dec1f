"""The raw layer, clean tables and ledger of successive runs.

Every run writes below its own id; its row in the run table is written last.
A run that fails leaves no row, so readers never see its files.  Nothing is
updated in place: whether a run is superseded is derived from the run table.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumstead.model import Processor, SemanticModel, Source, Workspace
from sumstead.operators.cleaning import RAW_CELLS, DimensionError, quality_summary, run_summary
from sumstead.operators.metrics import check_keys
from sumstead.operators.skew import join_one
from sumstead.sources.scans import number_rows, raw_records, scan, source_splits, unpack

RUNS = (
    "run_id bigint, workspace_slug string, status string, raw_run_id bigint, replaces boolean, "
    "detail string, started_at timestamp, finished_at timestamp"
)
CELLS = {
    "sales": RAW_CELLS,
    "stores": ("store_id", "store_name", "category", "district"),
    "products": ("product_id", "product_name", "product_category", "unit_price"),
}


class NoRunError(LookupError):
    """There is no completed run to read."""


def latest_completed(runs: DataFrame) -> DataFrame:
    """The largest completed run id of each workspace."""
    return (
        runs.where(F.col("status") == "completed").groupBy("workspace_slug").agg(F.max("run_id").alias("latest_run_id"))
    )


def with_status(runs: DataFrame) -> DataFrame:
    """Completed runs before the latest are superseded.

    The one latest id per workspace is joined back; a workspace with very many
    runs is not gathered in one place.
    """
    joined = join_one(runs, latest_completed(runs), "workspace_slug", "left", ["run_id"])
    superseded = (F.col("status") == "completed") & (F.col("run_id") < F.col("latest_run_id"))
    return joined.withColumn("status", F.when(superseded, "superseded").otherwise(F.col("status"))).drop("latest_run_id")


def source_counts(records: DataFrame) -> DataFrame:
    """Rows per source and their total (source null)."""
    return records.rollup("source_name").agg(F.count(F.lit(1)).alias("record_count"))


@dataclass(frozen=True)
class RunStore:
    """Runs of one workspace below a folder all executors share."""

    spark: SparkSession
    base: str
    model: SemanticModel

    def _path(self, *parts: object) -> str:
        return "/".join([self.base.rstrip("/"), self.model.slug, *map(str, parts)])

    def _table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(RUNS).parquet(self._path(name))
        except AnalysisException as error:
            # Only a table that was never written is empty; any other trouble must not look like one.
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], RUNS)

    def ingestion_runs(self) -> DataFrame:
        """All ingestion runs; a replacing run supersedes those before it."""
        runs = self._table("ingestion_runs")
        last = runs.where("replaces").agg(F.max("run_id")).scalar()
        return runs.withColumn(
            "status", F.when(F.col("run_id") < last, "superseded").otherwise(F.col("status"))
        )

    def processing_runs(self) -> DataFrame:
        return with_status(self._table("processing_runs"))

    def _latest(self, name: str) -> int:
        found = latest_completed(self._table(name)).first()
        if found is None:
            raise NoRunError(f"workspace {self.model.slug} has no completed run in {name}")
        return found["latest_run_id"]

    def _claim(self, name: str) -> int:
        """An id that no other run has or had: a claim is a folder that can be made once.

        A run that failed keeps its claim, so its files are never mistaken for another's.
        """
        run_id = (self._table(name).agg(F.max("run_id")).first()[0] or 0) + 1
        while True:
            try:
                self.spark.range(1).write.mode("errorifexists").parquet(self._path("claims", name, f"run_id={run_id}"))
                return run_id
            except AnalysisException as error:
                if error.getCondition() != "PATH_ALREADY_EXISTS":
                    raise
                run_id += 1

    def _publish(self, name: str, run_id: int, started: dt.datetime, detail: dict, raw_run_id: int | None = None,
                 replaces: bool = False) -> None:
        row = (run_id, self.model.slug, "completed", raw_run_id, replaces, json.dumps(detail, sort_keys=True),
               started, dt.datetime.now(dt.UTC))
        self.spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(self._path(name))

    def ingest(self, replace: bool = True, sources: tuple[Source, ...] | None = None) -> int:
        """Copies all sources into the raw layer; returns the run id.

        ``replace`` hides all earlier raw rows, else they stay readable.
        """
        started, run_id = dt.datetime.now(dt.UTC), self._claim("ingestion_runs")
        counts = {}
        for source in sources or self.model.sources:
            rows = self._path("raw", f"run_id={run_id}", f"source_name={source.name}")
            splits = self._path("splits", f"run_id={run_id}", f"source_name={source.name}")
            raw_records(scan(self.spark, source)).write.parquet(rows)
            source_splits(self.spark.read.parquet(rows)).coalesce(1).write.parquet(splits)
            counts[source.name] = self.spark.read.parquet(splits).agg(F.sum("records")).first()[0] or 0
        self._publish("ingestion_runs", run_id, started, counts, replaces=replace)
        return run_id

    def raw(self, source: str, run_id: int | None = None) -> DataFrame:
        """Numbered raw records of a source: number, payload, fingerprint, malformed."""
        run_id = run_id or self._latest("ingestion_runs")
        part = (f"run_id={run_id}", f"source_name={source}")
        rows = self.spark.read.parquet(self._path("raw", *part))
        return number_rows(rows, self.spark.read.parquet(self._path("splits", *part)))

    def raw_all(self) -> DataFrame:
        """Raw records of every run that no later run replaced."""
        visible = self.ingestion_runs().where("status = 'completed'").select("run_id")
        frames = self.spark.read.parquet(self._path("raw")).join(visible, "run_id", "left_semi")
        return frames.drop("source_file", "source_block", "source_position")

    def process(self, processor: Processor) -> int:
        """Cleans the latest raw run; repeating it repeats the result."""
        started, raw_run_id = dt.datetime.now(dt.UTC), self._latest("ingestion_runs")
        run_id = self._claim("processing_runs")
        malformed = self._malformed_events(raw_run_id)
        counts = {r["source_name"]: r["n"] for r in malformed.groupBy("source_name").agg(F.count(F.lit(1)).alias("n")).collect()}
        bad = {name: n for name, n in counts.items() if name != "sales"}
        if bad:
            raise DimensionError(f"malformed rows: {bad}")
        raw = {
            name: unpack(self.raw(name, raw_run_id).where(~F.col("malformed")), cells) for name, cells in CELLS.items()
        }
        tables = processor(raw)
        for name in ("stores", "products", "sales"):
            frame = tables[name]
            if name == "sales":
                month = F.date_format("sale_date", "yyyy-MM").alias("sale_month")
                # Ranges keep a month in few files and split a month that is very large.
                ranged = frame.select("*", month).repartitionByRange("sale_month", "source_row_number")
                ranged.write.partitionBy("sale_month").parquet(
                    self._path("clean", f"run_id={run_id}", name)
                )
            else:
                frame.write.parquet(self._path("clean", f"run_id={run_id}", name))
        tables["events"].unionByName(malformed).write.parquet(
            self._path("events", f"processing_run_id={run_id}")
        )
        summary = run_summary(tables["judged"]).first().asDict()
        # Malformed rows were never judged; they are raw and quarantined all the same.
        summary["raw_sales_records"] += counts.get("sales", 0)
        summary["quarantined_records"] += counts.get("sales", 0)
        summary |= {f"{name}_records": tables[f"{name}s"].count() for name in ("store", "product")}
        self._publish("processing_runs", run_id, started, summary, raw_run_id=raw_run_id)
        return run_id

    def _malformed_events(self, raw_run_id: int) -> DataFrame:
        """An event for every row of any source with more cells than its header."""
        found = [
            self.raw(name, raw_run_id).where("malformed").select(
                F.lit(name).alias("source_name"), "source_row_number",
                F.lit(None).cast("string").alias("record_key"), F.lit("quarantined").alias("action"),
                F.lit("malformed_row").alias("reason_code"), F.to_json("payload").alias("details"),
            )
            for name in CELLS
        ]
        return reduce(DataFrame.unionByName, found)

    def quality_summary(self, run_id: int | None = None) -> DataFrame:
        """Q8 of the current run, from its stored counts and events: one row."""
        run_id = run_id or self._latest("processing_runs")
        counts = self.summary(run_id)
        run = self.spark.createDataFrame([counts], ", ".join(f"{name} bigint" for name in counts))
        by_reason = self.events(run_id).groupBy("action", "reason_code").agg(F.count(F.lit(1)).alias("event_count"))
        return quality_summary(run, by_reason)

    def events(self, run_id: int | None = None) -> DataFrame:
        run_id = run_id or self._latest("processing_runs")
        return self.spark.read.parquet(self._path("events", f"processing_run_id={run_id}"))

    def summary(self, run_id: int | None = None) -> dict:
        run_id = run_id or self._latest("processing_runs")
        return json.loads(self._table("processing_runs").where(F.col("run_id") == run_id).first()["detail"])

    def clean(self, table: str, run_id: int | None = None) -> DataFrame:
        run_id = run_id or self._latest("processing_runs")
        return self.spark.read.parquet(self._path("clean", f"run_id={run_id}", table))

    def workspace(self) -> Workspace:
        """The model bound to the clean tables of the latest run."""
        run_id = self._latest("processing_runs")
        bound = Workspace(
            self.model, self.clean("sales", run_id),
            {"store": self.clean("stores", run_id), "product": self.clean("products", run_id)}, run_id,
        )
        check_keys(bound)
        return bound
