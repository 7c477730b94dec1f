"""Line breaks inside quotes: files cut anywhere give the rows of a reader that goes from front to back."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from sumstead.model import Source
from sumstead.sources import quoted, scans

CELLS = ["a", "", " ", '"x,y"', '"l\nm"', '"q""q"', '""', '5" pipe', '"\r\nz\n\n"', "é牛", '"""\n"""', '","', '"\n,\n"', "b" * 40]


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "48")
    spark.conf.set(names[1], "1")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def made(seed, rows=60):
    rng = random.Random(seed)
    end = rng.choice(["\n", "\r\n"])
    lines = ["k,l,m"] + [",".join([f"r{i}", *(rng.choice(CELLS) for _ in range(rng.choice([0, 1, 2, 2, 2, 3])))]) for i in range(rows)]
    return ("﻿" if seed % 2 else "") + "".join(line + end * rng.choice([1, 1, 1, 2]) for line in lines)


def plain_rows(text):
    """Number, cells (absent ones are None) and whether there are too many."""
    header, *rows = [r for r in csv.reader(io.StringIO(text.lstrip("﻿"), newline="")) if r]
    return [(n, *(row + [None] * 3)[:3], len(row) > len(header)) for n, row in enumerate(rows, 2)]


def numbered(spark, source):
    rows = scans.cut_lineage(scans.scan(spark, source))
    found = scans.number_rows(rows, scans.source_splits(rows)).select("source_row_number", "k", "l", "m", "malformed")
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("seed", range(4))
def test_files_cut_anywhere_give_the_same_rows(spark, tmp_path, small_splits, seed):
    text = made(seed)
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode())
    assert numbered(spark, Source("s", str(path), quoted_newlines=True)) == plain_rows(text)
    lines = spark.read.text(str(path), lineSep="\n")
    assert lines.rdd.getNumPartitions() > 10


def test_records_longer_than_splits_and_open_ends(spark, tmp_path, small_splits):
    text = 'k,l,m\n1,"' + "line\n" * 60 + '",x\n2,"' + "\n" * 100 + '"\n3,y\n4,"never closed\nend'
    path = tmp_path / "b.csv"
    path.write_text(text)
    found = sorted(map(tuple, quoted.records(spark, str(path)).select(F.struct("source_block", "source_position"), "record", "header").collect()))
    assert [r[1] for r in found] == ["k,l,m", '1,"' + "line\n" * 60 + '",x', '2,"' + "\n" * 100 + '"', "3,y", '4,"never closed\nend']
    assert [r[2] for r in found] == [True, False, False, False, False]


def test_files_of_one_source_follow_each_other(spark, tmp_path, small_splits):
    texts = [made(11, 20), made(12, 20)]
    for n, text in enumerate(texts):
        (tmp_path / f"{n}.csv").write_bytes(text.encode())
    first, second = map(plain_rows, texts)
    wanted = first + [(n + len(first), *rest) for n, *rest in second]
    assert numbered(spark, Source("s", str(tmp_path), quoted_newlines=True)) == wanted


def test_effects_of_lines_compose(spark):
    """Every line's effect against a machine that reads one character at a time."""
    rng = random.Random(3)
    lines = {"".join(rng.choice('a,"') for _ in range(rng.randrange(9))) for _ in range(3000)}

    def after(line, inside):
        state, i = ("in" if inside else "start"), 0
        while i < len(line):
            c = line[i]
            if state == "in":
                if c == '"' and line[i + 1 : i + 2] == '"':
                    i += 1
                elif c == '"':
                    state = "rest"
            elif c == ",":
                state = "start"
            elif state == "start" and c == '"':
                state = "in"
            else:
                state = "rest"
            i += 1
        return state == "in"

    frame = spark.createDataFrame([(t,) for t in sorted(lines)], "t string")
    for row in quoted._effects(frame, F.col("t")).collect():
        assert (row["_out"], row["_in"]) == (after(row["t"], False), after(row["t"], True)), row["t"]


def test_another_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,l,m\n1,2,3\n")
    (tmp_path / "b.csv").write_text("k,m,l\n1,2,3\n")
    with pytest.raises(scans.SourceError):
        scans.scan(spark, Source("s", str(tmp_path), columns=("k", "l", "m"), quoted_newlines=True)).collect()


def test_an_empty_file_has_no_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert quoted.records(spark, str(tmp_path / "a.csv")).isEmpty()
