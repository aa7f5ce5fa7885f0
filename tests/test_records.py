import csv
import io
import random

import pytest

from kerbside.sources import tables as T
from kerbside.sources.records import _lines, read_records


@pytest.fixture
def small_chunks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def written(path, rows, end):
    text = io.StringIO()
    csv.writer(text, lineterminator=end).writerows(rows)
    path.write_bytes(text.getvalue().encode())


def table(seed, n, long):
    draw = random.Random(seed)
    pieces = ["plain", "", 'said "no"', "a,b", "line\nbreak", '"', "\n\n", "é😀", " spaced ", "x" * 30]
    if long:
        pieces.append("\n".join(f"line {i}, of \"many\"" for i in range(60)))  # over many chunks
    return [[str(i), *("".join(draw.choices(pieces, k=2)) for _ in range(2))] for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("long", [False, True])
def test_equals_plain_parser(spark, small_chunks, tmp_path, end, long):
    rows = table(1, 100, long)
    written(tmp_path / "a.csv", [["id", "some, name", "b"], *rows], end)
    written(tmp_path / "b.csv", [["id", "some, name", "b"], *[[f"b{r[0]}", *r[1:]] for r in table(2, 20, long)]], end)
    df = read_records(spark, str(tmp_path))
    assert df.columns == ["id", "some, name", "b"]
    assert _lines(spark, str(tmp_path)).select("file", "start").distinct().count() > 8
    expected = {r[0]: tuple(r) for r in rows} | {f"b{r[0]}": (f"b{r[0]}", *r[1:]) for r in table(2, 20, long)}
    got = {r[0]: tuple(v or "" for v in r) for r in df.collect()}
    assert got == expected


def test_header_over_chunks_blank_lines_and_open_quote(spark, small_chunks, tmp_path):
    head = '"' + "long\n" * 400 + 'name",b\n'
    (tmp_path / "u.csv").write_text("\n" + head + '1,2\n\n \n3,"open\nto the end\n')
    df = read_records(spark, str(tmp_path / "u.csv"))
    got = df.collect()
    assert sorted(tuple(r) for r in got) == [("1", "2"), ("3", "open\nto the end")]
    (tmp_path / "empty.csv").write_text("")
    assert read_records(spark, str(tmp_path / "empty.csv")).count() == 0


def test_upload_with_breaks_and_declared_types(spark, small_chunks, tmp_path):
    rows = [[i, f"a\nb{i}", i / 2] for i in range(60)]
    written(tmp_path / "u.csv", [["n", "text", "x"], *rows], "\n")
    upload = T.read_upload(spark, str(tmp_path / "u.csv"), multi_line=True)
    assert dict(upload.dtypes) == {"n": "bigint", "text": "string", "x": "double"}
    typed = T.read_accidents(spark, str(tmp_path / "u.csv"), "n INT, text STRING, x DOUBLE", multi_line=True)
    for df in (upload, typed):
        assert sorted(tuple(r) for r in df.collect()) == [tuple(r) for r in rows]


def test_only_numbers_become_numbers(spark, tmp_path):
    columns = {
        "suffix": (["1d", "2f", "3D"], "string"), "hexadecimal": (["0x1p3", "0x2p1", "1"], "string"),
        "exponent": (["1e3", "-2.5E-2", "+.5"], "double"), "whole": (["1", "-2", "+3"], "bigint"),
        "endless": (["inf", "-Infinity", "1"], "double"), "gap": (["1", "NA", "3"], "double"), "code": (["1L", "2", "3"], "string"),
        "far": (["99999999999999999999", "1", "2"], "double"), "point": (["1.", "2", "3"], "double"), "dot": ([".", "1", "2"], "string"),
    }
    rows = [list(columns), *zip(*[values for values, _ in columns.values()])]
    written(tmp_path / "u.csv", rows, "\n")
    upload = T.read_upload(spark, str(tmp_path / "u.csv"))
    assert dict(upload.dtypes) == {c: kind for c, (_, kind) in columns.items()}
    assert [r["suffix"] for r in upload.collect()] == ["1d", "2f", "3D"]
