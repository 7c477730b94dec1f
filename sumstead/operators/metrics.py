"""Governed metric queries as DataFrames.

The builder joins only the dimension tables a query names.  Small tables are
broadcast and the facts aggregated once by name.  If a table is too large for
that, the facts are aggregated by its key first, so that what is shuffled to
the join holds one row per key (and order id, for distinct counts).
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumstead.functions.display import grain_text, guarded_ratio
from sumstead.model import (
    AGGREGATE_KINDS,
    Evidence,
    GovernanceError,
    Metric,
    MetricQuery,
    MetricResult,
    SemanticModel,
    Workspace,
)
from sumstead.operators.skew import fits_broadcast, join_one
from sumstead.session import cut_lineage


def metric_value(model: SemanticModel, key: str) -> Column:
    """A metric from the columns of its primitives."""
    values: list[Column] = []
    for metric, operands in model.expansion(key):
        if operands:
            denominator, numerator = values.pop(), values.pop()
            values.append(guarded_ratio(numerator, denominator))
        else:
            values.append(F.col(metric.key))
    return values.pop()


def _month_range(value: str) -> tuple[dt.date, dt.date] | None:
    if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", value, re.ASCII) or value[:4] == "0000":
        return None
    year, month = int(value[:4]), int(value[5:])
    return dt.date(year, month, 1), dt.date(year, month, calendar.monthrange(year, month)[1])


def _day_range(value: str) -> tuple[dt.date, dt.date] | None:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value, re.ASCII):
        return None
    try:
        day = dt.date.fromisoformat(value)
    except ValueError:
        return None
    return day, day


def date_filter(column: str, values: tuple[str, ...], grain: str) -> Column:
    """formatted dates as ranges of the date column, which reach the scan."""
    ranges = [(_month_range if grain == "month" else _day_range)(v) for v in values]
    tests = [F.col(column).between(F.lit(a), F.lit(b)) for a, b in filter(None, ranges)]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _filtered_facts(workspace: Workspace, query: MetricQuery) -> DataFrame:
    """F1, F3 and filters on other fact columns, before any join."""
    facts, day = workspace.facts, workspace.model.date_column
    if query.date_from:
        facts = facts.where(F.col(day) >= F.lit(query.date_from))
    if query.date_to:
        facts = facts.where(F.col(day) <= F.lit(query.date_to))
    for key, values in query.filters.items():
        dim = workspace.model.dimension(key)
        if dim.table is None and dim.data_type == "date":
            facts = facts.where(date_filter(dim.column, tuple(values), query.grain))
        elif dim.table is None:
            facts = facts.where(F.col(dim.column).isin(*values))
    return facts


def _used_tables(workspace: Workspace, query: MetricQuery) -> dict[str, DataFrame]:
    """Each table a query needs, with its key, its grouped columns and F2 applied."""
    model, used = workspace.model, {}
    for key in dict.fromkeys((*query.group_by, *query.filters)):
        name = model.dimension(key).table
        if name is None or name in used:
            continue
        frame = workspace.tables[name]
        for other, values in query.filters.items():
            if model.dimension(other).table == name:
                frame = frame.where(F.col(model.dimension(other).column).isin(*values))
        grouped = [model.dimension(g) for g in query.group_by if model.dimension(g).table == name]
        used[name] = frame.select(
            F.col(model.relation(name).table_key).alias(f"_key_{name}"),
            *[F.col(d.column).alias(d.key) for d in grouped],
        )
    return used


def _plain_dimensions(workspace: Workspace, query: MetricQuery) -> dict[str, Column]:
    """Grouped dimensions that are fact columns."""
    plain = {}
    for key in query.group_by:
        dim = workspace.model.dimension(key)
        if dim.table is None:
            # Dates are grouped as dates and become text afterwards.
            by_month = dim.data_type == "date" and query.grain == "month"
            plain[key] = F.trunc(dim.column, "month") if by_month else F.col(dim.column)
    return plain


def _dimension_text(model: SemanticModel, key: str, grain: str) -> Column:
    """N9 and N10"""
    dim = model.dimension(key)
    if dim.table is None and dim.data_type == "date":
        return grain_text(F.col(key), grain)
    return F.col(key).cast("string")


def aggregate(workspace: Workspace, query: MetricQuery, primitives: dict[str, Metric],
              bound: int | None = None) -> DataFrame:
    """A1, A2 and A4: grouped dimensions (text) and one column per primitive."""
    facts = _filtered_facts(workspace, query)
    tables = _used_tables(workspace, query)
    plain = _plain_dimensions(workspace, query)
    fields = list(dict.fromkeys(m.field for m in primitives.values()))
    rows = facts.select(
        *[F.col(workspace.model.relation(t).fact_key).alias(f"_key_{t}") for t in tables],
        *[c.alias(key) for key, c in plain.items()],
        *[F.col(f).alias(f"_field_{f}") for f in fields],
    )
    large = [t for t, frame in tables.items() if not fits_broadcast(frame, bound)]
    distinct = [f"_field_{m.field}" for m in primitives.values() if AGGREGATE_KINDS[m.kind].distinct]
    if large:
        keys = [f"_key_{t}" for t in tables] + list(plain) + sorted(set(distinct))
        sums = sorted({f"_field_{f}" for f in fields} - set(distinct))
        rows = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(c) for c in sums])
    for name, frame in tables.items():
        rows = join_one(rows, frame, f"_key_{name}", "inner", bound=bound)
    measures = []
    for key, metric in primitives.items():
        kind = AGGREGATE_KINDS[metric.kind]
        measures.append((kind.merge if large else kind.whole)(f"_field_{metric.field}").alias(key))
    grouped = rows.groupBy(*query.group_by).agg(*measures)
    texts = [_dimension_text(workspace.model, g, query.grain).alias(g) for g in query.group_by]
    return grouped.select(*texts, *primitives)


def metric_points(workspace: Workspace, query: MetricQuery, bound: int | None = None) -> DataFrame:
    """M1: checked, aggregated, ordered by dimension, limited, then valued."""
    query.check(workspace.model)
    primitives = workspace.model.primitives(query.metric)
    groups = aggregate(workspace, query, primitives, bound)
    if query.group_by:
        groups = groups.orderBy(*[F.col(g).asc_nulls_first() for g in query.group_by])
    return groups.limit(query.limit).select(
        *query.group_by, metric_value(workspace.model, query.metric).alias("value")
    )


def metric_result(workspace: Workspace, query: MetricQuery) -> MetricResult:
    """M1 with its evidence; the points, MAX_LIMIT rows at most, are stored and counted."""
    points = cut_lineage(metric_points(workspace, query), "points")
    model, metric = workspace.model, workspace.model.metric(query.metric)
    evidence = Evidence(
        row_count=points.count(), evidence_id=query.evidence_id(model.slug, workspace.run_id),
        processing_run_id=workspace.run_id, metric_definition=metric.description, scope=query.scope(),
    )
    currency = model.currency if metric.format == "currency" else None
    return MetricResult(model.slug, metric.key, metric.label, metric.format, currency, points, evidence)


def check_keys(workspace: Workspace) -> None:
    """Refuses a workspace in which a key of a dimension table occurs twice: joins would count facts twice."""
    for relation in workspace.model.relations:
        if relation.table in workspace.tables:
            keys = workspace.tables[relation.table].groupBy(relation.table_key).count()
            repeated = keys.where("count > 1").agg(F.count(F.lit(1))).first()[0]
            if repeated:
                raise GovernanceError(f"{repeated} keys of {relation.table} are not unique")


def coverage(workspace: Workspace) -> DataFrame:
    """A5: first and last day of the facts, one row."""
    day = workspace.model.date_column
    return workspace.facts.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def metric_table(workspace: Workspace, metrics: tuple[str, ...], query: MetricQuery) -> DataFrame:
    """Several metrics over one scope in one aggregate, aligned by group."""
    primitives: dict[str, Metric] = {}
    for key in metrics:
        primitives.update(workspace.model.primitives(key))
    groups = aggregate(workspace, query, primitives)
    return groups.select(*query.group_by, *[metric_value(workspace.model, m).alias(m) for m in metrics])


def top_groups(points: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n largest values, smallest key first among equals.

    ``position`` numbers n rows at most, whatever the number of groups.
    """
    order = (F.col("value").desc(), F.col(key).asc())
    return points.orderBy(*order).limit(n).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def relative_to_leader(groups: DataFrame, value: str) -> DataFrame:
    """Share of the largest value in percent; the groups are stored, as they are needed twice."""
    groups = cut_lineage(groups, "groups")
    top = groups.agg(F.max(value)).scalar()
    divisor = F.when(F.coalesce(top, F.lit(0)) == 0, F.lit(1)).otherwise(top)
    return groups.withColumn("share", F.col(value).cast("double") / divisor.cast("double") * 100)
