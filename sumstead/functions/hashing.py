"""Canonical JSON texts and their hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _json_literal(value: Column) -> Column:
    wrapped = F.to_json(F.struct(value.alias("v")))
    return wrapped.substr(F.lit(6), F.char_length(wrapped) - 6)


def json_text(value: Column) -> Column:
    """One string as a JSON literal, non-ASCII kept; null becomes ``null``."""
    # Control characters print lower-case hex digits here, upper-case in to_json.
    by_char = F.concat(
        F.lit('"'),
        F.array_join(
            F.transform(
                F.split(value, ""),
                lambda ch: F.when(ch < " ", F.lower(_inner(_json_literal(ch)))).otherwise(
                    _inner(_json_literal(ch))
                ),
            ),
            "",
        ),
        F.lit('"'),
    )
    rare = value.rlike(r"[\x0B\x0E\x0F\x1A-\x1F]")
    return F.when(value.isNull(), F.lit("null")).when(rare, by_char).otherwise(_json_literal(value))


def _inner(literal: Column) -> Column:
    return literal.substr(F.lit(2), F.char_length(literal) - 2)


def canonical_row(columns: list[str]) -> Column:
    """A row of strings as JSON: sorted keys, ``", "`` and ``": "``."""
    cells = [F.col(f"`{name}`") for name in sorted(columns)]

    def row(texts: list[Column]) -> Column:
        members = [F.concat(F.lit(_json_key(name) + ": "), text) for name, text in zip(sorted(columns), texts, strict=True)]
        return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))

    # Most rows have nothing to escape; one look at all their cells tells.
    plain = [F.coalesce(F.concat(F.lit('"'), cell, F.lit('"')), F.lit("null")) for cell in cells]
    escapes = F.concat_ws("", *cells).rlike(r"[^\x20\x21\x23-\x5B\x5D-\x7E]")
    return F.when(escapes, row([json_text(cell) for cell in cells])).otherwise(row(plain))


def _json_key(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False)


def fingerprint(columns: list[str]) -> Column:
    """S4"""
    return F.sha2(canonical_row(columns), 256)


def ascii_json_text(value: Column) -> Column:
    """One string as an ASCII JSON literal: ``\\uXXXX`` for everything else."""
    plain = json_text(value)
    units = F.regexp_extract_all(F.hex(F.encode(plain, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    escaped = F.array_join(
        F.transform(
            units,
            lambda u: F.when(
                (u >= "0020") & (u <= "007E"), F.chr(F.conv(u, 16, 10).cast("bigint"))
            ).otherwise(F.concat(F.lit("\\u"), F.lower(u))),
        ),
        "",
    )
    return F.when(plain.rlike(r"[^\x20-\x7E]"), escaped).otherwise(plain)


def json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, ascii_json_text), ", "), F.lit("]"))


def _date_json(day: Column) -> Column:
    return F.coalesce(F.concat(F.lit('"'), day.cast("string"), F.lit('"')), F.lit("null"))


def evidence_id(workspace: Column, run_id: Column, metric: Column, group_by: Column, filters: Column,
                date_from: Column, date_to: Column, grain: Column, limit: Column) -> Column:
    """N21 over a table of queries: 16 hex digits naming query, run and workspace."""
    filter_members = F.transform(
        F.array_sort(F.map_entries(filters)),
        lambda e: F.concat(ascii_json_text(e["key"]), F.lit(": "), json_list(e["value"])),
    )
    query = F.concat(
        F.lit('{"date_from": '), _date_json(date_from),
        F.lit(', "date_grain": '), ascii_json_text(grain),
        F.lit(', "date_to": '), _date_json(date_to),
        F.lit(', "filters": {'), F.array_join(filter_members, ", "),
        F.lit('}, "group_by": '), json_list(group_by),
        F.lit(', "limit": '), limit.cast("string"),
        F.lit(', "metric": '), ascii_json_text(metric), F.lit("}"),
    )
    payload = F.concat(
        F.lit('{"processing_run_id": '), run_id.cast("string"),
        F.lit(', "query": '), query,
        F.lit(', "workspace": '), ascii_json_text(workspace), F.lit("}"),
    )
    return F.substring(F.sha2(payload, 256), 1, 16)
