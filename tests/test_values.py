import datetime as dt

import pytest

from sumstead.fixed_values import SCOPE_ALL
from sumstead.functions import values
from sumstead.functions.text import casefold, entity_key, strip_or_null
from sumstead.model import GovernanceError, Metric, MetricQuery
from sumstead.plans.views import STAR_MODEL
from pyspark.sql import functions as F

DATES = [
    ("2031-11-28", dt.date(2031, 11, 28), None),
    ("\t2031/11/28", dt.date(2031, 11, 28), "date_format_normalized"),
    ("28-11-2031 ", dt.date(2031, 11, 28), "date_format_normalized"),
    ("２０３１-11-28", dt.date(2031, 11, 28), None),
    ("2031-11-31", None, None), ("28-11-31", None, None), ("", None, None), (None, None, None),
    ("0000-01-01", None, None), ("2031-1-8", None, None), ("2031-11-28x", None, None),
]
MONEY = [
    ("7", 700, None), ("-0.25", -25, None), ("¥98,765.4", 9876540, "currency_symbol_removed"),
    ("0.125", None, None), ("seven", None, None), (None, None, None), ("¥x", None, None), ("1e3", 100000, None),
    ("1_000", 100000, None), ("10.0000000001", None, None), ("1.000000000000000000001", None, None),
    ("1.5000000000000000000000000", 150, None), ("Infinity", None, None), ("NaN", None, None), (".5", 50, None),
    ("5.", 500, None), ("＋5", None, None), ("５", 500, None), (" 7　", 700, None), ("5¥", None, None),
]
IDENTIFIERS = [("q7b ", "Q7B", "identifier_normalized"), ("Q7B", "Q7B", None), ("  ", None, None), (None, None, None),
               ("\x1cß", "SS", "identifier_normalized")]
INTEGERS = [("40", 40), ("-6", -6), ("4.0", None), ("+3", None), ("９", 9), (" 4 ", 4), ("99999999999999999999", None), (None, None)]


def _rows(spark, cases, **cells):
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, cell string")
    return [r.asDict() for r in values.parse(frame, **cells).orderBy("i").collect()]


@pytest.mark.parametrize("cases,kind", [(DATES, "date"), (MONEY, "money"), (IDENTIFIERS, "identifier")])
def test_cells_with_repairs(spark, cases, kind):
    got = [(r["cell"], r["cell_value"], r["cell_reason"]) for r in _rows(spark, cases, **{kind: ("cell",)})]
    assert got == cases


def test_integers(spark):
    assert [(r["cell"], r["cell_value"]) for r in _rows(spark, INTEGERS, whole=("cell",))] == INTEGERS


def test_text_agrees_with_python(spark):
    texts = [" a ", "\x1f b\x85", "Straße ΑΣ ﬁ ŉ İ", "Foo_Bar-1２é½", "牛肉 poke！", "ꭰᏸ", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select("t", strip_or_null(F.col("t")), casefold(F.col("t")), entity_key(F.col("t"))).collect()
    for text, stripped, folded, key in rows:
        assert stripped == (text.strip() or None)
        assert folded == text.casefold()
        assert key == "".join(ch for ch in text if ch.isalnum()).casefold()


@pytest.mark.parametrize("query", [
    MetricQuery("profit"), MetricQuery("revenue", ("weather",)), MetricQuery("revenue", ("store", "store")),
    MetricQuery("revenue", ("store", "date", "product")), MetricQuery("revenue", limit=501), MetricQuery("revenue", limit=0),
    MetricQuery("revenue", filters={"store": ()}), MetricQuery("revenue", grain="year"),
    MetricQuery("revenue", date_from=dt.date(2026, 2, 1), date_to=dt.date(2026, 1, 1)),
])
def test_queries_outside_the_contract_are_refused(query):
    with pytest.raises(GovernanceError):
        query.check(STAR_MODEL)


def test_declarations_are_checked():
    with pytest.raises(GovernanceError):
        Metric("m", "m", "sum", "integer")
    with pytest.raises(GovernanceError):
        Metric("m", "m", "ratio", "integer", numerator="a")
    assert MetricQuery("revenue").scope() == SCOPE_ALL
