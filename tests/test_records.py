"""Records of CSV files with line breaks inside quotes, against Spark's own reader of whole files."""

import random

import pytest

from evenkeel.sources import tables as src
from evenkeel.sources.records import csv_records, ends_inside


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "40b", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def whole_files(spark, path):
    return spark.read.options(**src.CSV).option("header", True).option("multiLine", True).csv(path)


def ordered(df):
    return sorted(map(str, df.collect()))


def test_state_at_the_end_of_a_line():
    cases = [("", 0, 1), ("a,b", 0, 1), ('"', 1, 0), ('"a', 1, 0), ('a"b', 0, 0), ('""', 0, 1), ('x,"y""', 1, 0), ('"a"b"c,d', 0, 0),
             ('a,"b",c', 0, 0), ('a",b', 0, 0), ('a","b', 1, 1), ('" ""x"" ","', 1, 1), (' "a', 0, 0), ('"""', 1, 0)]
    for line, outside, inside in cases:
        assert (ends_inside(line, False), ends_inside(line, True)) == (bool(outside), bool(inside)), line


@pytest.mark.parametrize("seed", range(4))
def test_random_files_give_the_rows_of_the_whole_file_reader(small_splits, tmp_path, seed):
    draw = random.Random(seed)

    def value():
        text = "".join(draw.choice(['a', 'bc', ' ', 'é', ',', '"', '\n', '\n\n', 'long words here ']) for _ in range(draw.randint(0, 7)))
        kind = draw.random()
        if kind < 0.6 or any(c in text for c in ',"\n'):
            return '"' + text.replace('"', '""') + '"'
        return text or "x"

    folder = tmp_path / "t"
    folder.mkdir()
    for k in range(3):
        rows = [f"{k}{i},{value()},{value()}" for i in range(30)] + [f'{k}99,5" pipe,end', f'{k}98,"tail\n\n{"far " * 60}\nend",z']
        draw.shuffle(rows)
        (folder / f"{k}.csv").write_text('id,"two\nlines",c\n' + "\n".join(rows) + "\n", encoding="utf-8")
    path = str(folder)
    assert small_splits.read.text(path).rdd.getNumPartitions() > 20
    expected = whole_files(small_splits, path)
    assert expected.count() == 96
    got = src._csv_text(small_splits, path)
    assert got.columns == expected.columns == ["id", "two\nlines", "c"]
    assert ordered(got) == ordered(expected)
    assert got.rdd.getNumPartitions() > 3                        # more tasks than files


def test_windows_line_ends_lone_returns_and_an_open_end(small_splits, tmp_path):
    (tmp_path / "crlf.csv").write_bytes('﻿a,b\r\n1,"x\r\ny"\r\n\r\n2,z\r\n'.encode())
    got = src.read_table(small_splits, str(tmp_path / "crlf.csv"), "csv")
    assert got.columns == ["a", "b"] and sorted(map(tuple, got.collect())) == [(1, "x\r\ny"), (2, "z")]
    (tmp_path / "lone.csv").write_bytes(b'a,b\n1,"x\ry\nw"\n2,z\n')
    assert sorted(r["a"] for r in src.read_table(small_splits, str(tmp_path / "lone.csv"), "csv").collect()) == [1, 2]
    (tmp_path / "open.csv").write_text('a,b\n1,x\n2,"' + "never closed\n" * 20 + "3,y\n")
    assert [r["value"] for r in csv_records(small_splits, str(tmp_path / "open.csv")).collect() if r["value"][0] != "1"] == [
        '2,"' + "never closed\n" * 20 + "3,y"]
    (tmp_path / "empty.csv").write_text('a,"b\n"\n')
    assert src.read_table(small_splits, str(tmp_path / "empty.csv"), "csv").count() == 0


def test_a_header_that_crosses_splits_is_no_row(small_splits, tmp_path):
    (tmp_path / "h.csv").write_text('id,"' + "name\n" * 30 + '"\n1,"a\nb"\n2,c\n')
    df = src.read_table(small_splits, str(tmp_path / "h.csv"), "csv")
    assert sorted(map(tuple, df.collect())) == [(1, "a\nb"), (2, "c")]


def test_lines_do_not_move_between_tasks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n')
    plan = csv_records(spark, str(tmp_path / "t.csv"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
