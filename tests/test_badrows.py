import re

import pytest

from dotframe.operators.badrows import clean_cells, rejected_lines

SCHEMA = "raw_id long, file_path string, fmt string, line_no int, raw_line string"
NUM = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")


def split_csv(line, sep):
    """Character by character; None where the quoting fails."""
    fields, i = [], 0
    while True:
        while i < len(line) and line[i] in " \t":
            i += 1
        if i < len(line) and line[i] == '"':
            value, i = "", i + 1
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        value, i = value + '"', i + 2
                        continue
                    i += 1
                    break
                value, i = value + line[i], i + 1
            while i < len(line) and line[i] in " \t":
                i += 1
            if i < len(line) and line[i] != sep:
                return None
        else:
            j = line.find(sep, i)
            j = len(line) if j < 0 else j
            value, i = line[i:j].strip(" \t"), j
            if '"' in value:
                return None
        fields.append(value)
        if i >= len(line):
            return fields
        i += 1


def integer(s, lo, hi):
    return bool(re.fullmatch("[0-9]+", s)) and lo <= int(s) <= hi


def brute(rows):
    """{raw_id: reason} by plain loops."""
    def text(r):
        t = r[4] or ""
        t = t[:-1] if t.endswith("\r") else t
        return t[1:] if r[3] == 1 and t.startswith("﻿") else t

    heads = {}
    for r in rows:
        if r[2] == "grid_txt" and r[3] in (2, 3):
            heads[r[1], r[3]] = len(text(r).split())
    out = {}
    for r in rows:
        t = text(r)
        if not t.strip() or r[3] <= {"cell_csv": 0, "grid_txt": 3, "manifest_csv": 1}.get(r[2], 0):
            continue
        if r[2] == "grid_txt":
            f = re.split("[ \t]+", t.strip(" \t"))
            bad = "column_count" if len(f) != 8 else None
            if not bad:
                rows_, cols = heads.get((r[1], 3), 0) // 3, heads.get((r[1], 2), 0) // 2
                ok = integer(f[0], 1, rows_) and integer(f[1], 1, cols) and all(x in ("0", "1") for x in f[2:])
                bad = None if ok else "value"
        elif r[2] in ("cell_csv", "manifest_csv"):
            f = split_csv(t, ";" if r[2] == "cell_csv" else ",")
            n = 5 if r[2] == "cell_csv" else 4
            bad = "quoting" if f is None else "column_count" if len(f) != n else None
            if not bad and n == 5:
                ok = all(NUM.fullmatch(x) for x in f[:4]) and integer(f[4], 1, 63)
                if ok:
                    x0, y0, x1, y1 = map(float, f[:4])
                    ok = 0 <= x0 < x1 <= 1 and 0 <= y0 < y1 <= 1
                bad = None if ok else "value"
            elif not bad:
                ok = f[0] in ("train", "val", "test") and f[1] and re.fullmatch("[01]{6}", f[2]) and integer(f[3], 1, 63)
                bad = None if ok and int(f[2][::-1], 2) == int(f[3]) else "value"
        else:
            bad = "format"
        if bad:
            out[r[0]] = bad
    return out


LINES = [
    ("c", "cell_csv", 1, "﻿0.1;0.2;0.3;0.4;5\r"),
    ("c", "cell_csv", 2, '"0.1";0.2;0.3;0.4;007'),
    ("c", "cell_csv", 3, ' 0.1 ; "0.2" ;+0.3;4e-1;5'),
    ("c", "cell_csv", 4, '0.1";0.2;0.3;0.4;5'),
    ("c", "cell_csv", 5, '"0.1;0.2;0.3;0.4;5'),
    ("c", "cell_csv", 6, '"0.1"x;0.2;0.3;0.4;5'),
    ("c", "cell_csv", 7, "0.1;0.2;0.3;0.4"),
    ("c", "cell_csv", 8, "0.3;0.2;0.3;0.4;5"),
    ("c", "cell_csv", 9, "0.1;0.2;0.3;0.4;64"),
    ("c", "cell_csv", 10, "0.1;0.2;0.3;0.4;١٢"),
    ("c", "cell_csv", 11, "nan;0.2;0.3;0.4;5"),
    ("c", "cell_csv", 12, "0.1;0.2;1e999;0.4;5"),
    ("c", "cell_csv", 13, '"";0.2;0.3;0.4;5'),
    ("c", "cell_csv", 14, ""),
    ("c", "cell_csv", 15, " \t \r"),
    ("c", "cell_csv", 16, None),
    ("c", "cell_csv", 17, "0.1;0.2;0.3;0.4;99999999999999999999999"),
    ("c", "cell_csv", 18, "﻿0.1;0.2;0.3;0.4;5"),
    ("g", "grid_txt", 1, "0.5"),
    ("g", "grid_txt", 2, "1 2 3 4"),
    ("g", "grid_txt", 3, "1 2 3\r"),
    ("g", "grid_txt", 4, " 1\t2 0 1 0 1 0 1 "),
    ("g", "grid_txt", 5, "2 1 0 1 0 1 0 1"),
    ("g", "grid_txt", 6, "1 3 0 1 0 1 0 1"),
    ("g", "grid_txt", 7, "1 1 0 1 0 1 0"),
    ("g", "grid_txt", 8, '1 1 0 1 0 1 0 "1"'),
    ("g2", "grid_txt", 9, "1 1 0 1 0 1 0 1"),
    ("m", "manifest_csv", 1, "split,path,bits6,label_int"),
    ("m", "manifest_csv", 2, 'train,"a, ""b"" c",100000,1'),
    ("m", "manifest_csv", 3, 'train,"a ""b"" c"x,100000,1'),
    ("m", "manifest_csv", 4, "Train,a,100000,1"),
    ("m", "manifest_csv", 5, "val,,100000,1"),
    ("m", "manifest_csv", 6, 'val," ",100000,1'),
    ("m", "manifest_csv", 7, "test,a,100000,2"),
    ("m", "manifest_csv", 8, 'test,a,"100000",01'),
    ("m", "manifest_csv", 9, 'test,a"b",100000,1'),
    ("m", "manifest_csv", 10, 'test,"""",100000,1'),
    ("m", "manifest_csv", 11, 'test,"a" "b",100000,1'),
    ("m", "manifest_csv", 12, "test,a\u0001s,100000,1"),
    ("m", "manifest_csv", 13, "test," + '"' + '""' * 5000 + '"' + ",100000,1"),
    ("x", "other", 1, "1"),
]


@pytest.fixture(scope="module")
def rows():
    return [(i, *x) for i, x in enumerate(LINES)]


def test_rejects_as_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.raw_id: r.reason for r in rejected_lines(df).collect()}
    assert got == brute(rows)


def test_every_data_line_is_on_one_side(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    bad = brute(rows)
    clean = {r.raw_id: r for r in clean_cells(df).collect()}
    heads = [i for i, f, fmt, n, t in rows if not (t or "").strip() or (fmt == "grid_txt" and n <= 3) or (fmt == "manifest_csv" and n == 1)]
    assert set(clean) == {r[0] for r in rows} - set(bad) - set(heads)
    assert clean[1].label == 7 and clean[1].bits6 == "111000"
    by_line = {r[3]: clean[r[0]] for r in rows if r[2] == "manifest_csv" and r[0] in clean}
    assert by_line[2].path == 'a, "b" c' and by_line[6].path == " " and by_line[12].path == "a\u0001s"


def test_repeated_rows_nulls_and_extra_columns(spark):
    rows = [(None, "f", "cell_csv", 2, "x;y"), (None, "f", "cell_csv", 2, "x;y"), (1, None, None, None, "z")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as value", "2 as key", "3 as reason", "4 as fields")
    got = sorted((r.raw_id or 0, r.reason) for r in rejected_lines(df).collect())
    assert got == [(0, "column_count"), (0, "column_count"), (1, "format")]
    assert clean_cells(df).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rejected_lines(df).count() == 0 and clean_cells(df).count() == 0
