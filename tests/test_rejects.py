from __future__ import annotations

import datetime

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.functions import buffers as B
from sylva.operators import rejects
from sylva.operators.rejects import DESCRIPTION_FIELDS, Field, index_lines, parse_batch

GOOD = "7|Fam|Gen|sp|A. B.|||var|1903|2|15||some text|Land|1950-02-28|-6.5|12.25|1200|3|12|ok|dunes"


def line(**change):
    f = GOOD.split("|")
    names = [x.name for x in DESCRIPTION_FIELDS]
    for k, v in change.items():
        f[names.index(k)] = v
    return "|".join(f)


def reason(*lines):
    return list(parse_batch(pa.array(lines, pa.string()), DESCRIPTION_FIELDS)[0])


def test_reasons():
    assert reason(
        GOOD, line(description='"a|b ""c"" d"'), line(description='5" long'), line(description='"open'), line(description='"a" b'), line(id=""), line(id="0"), line(id="x1"),
        line(genus=" "), line(year="1699"), line(year="190"), line(year=""), line(volume="0"), line(page="1-2"), line(coll_date="1950-02-30"), line(coll_date="1950"),
        line(lat="91"), line(lat="9,5"), line(lon="-180"), line(alt_m="-501"), line(fl_month="13"), line(fr_month="VII"), GOOD + "|", "a|b", "", None, line(id=" 7 ") + "\r",
    ) == [
        "", "", "", "broken_quote", "broken_quote", "bad_value", "bad_value", "bad_value", "bad_value", "bad_value", "bad_value", "", "bad_value", "bad_value", "bad_value",
        "bad_value", "bad_value", "bad_value", "", "bad_value", "bad_value", "bad_value", "column_count", "column_count", "column_count", "column_count", "",
    ]


def test_values():
    _, cols = parse_batch(pa.array([line(description=' "a|b ""c"""'), "bad"]), DESCRIPTION_FIELDS)
    row = {f.name: c.to_pylist() for f, c in zip(DESCRIPTION_FIELDS, cols, strict=True)}
    assert row["description"] == ['a|b "c"', None]
    assert row["id"] == [7, None] and row["coll_date"] == [datetime.date(1950, 2, 28), None]
    assert row["lat"] == [-6.5, None] and row["subspecies"] == [None, None]


def plain(text):
    """(broken, number of fields), character by character."""
    i, n, fields = 0, len(text), 0
    while True:
        j = i
        while j < n and text[j] in " \r\t":
            j += 1
        if j < n and text[j] == '"':
            k = j + 1
            while True:
                k = text.find('"', k)
                if k < 0:
                    return True, 0
                if text[k + 1 : k + 2] == '"':
                    k += 2
                    continue
                break
            e = k + 1
            while e < n and text[e] in " \r\t":
                e += 1
            if e < n and text[e] != "|":
                return True, 0
        else:
            e = text.find("|", i)
            e = n if e < 0 else e
        fields += 1
        if e >= n:
            return False, fields
        i = e + 1


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet='a| "\r', max_size=16), min_size=1, max_size=5))
def test_structure_equals_plain_scan(lines):
    buf, off, _ = B.view(pa.array(lines, pa.string()))
    broken, _, of, _ = index_lines(buf, off)
    count = np.bincount(of, minlength=len(lines)) + 1
    for i, t in enumerate(lines):
        bad, n = plain(t)
        assert bool(broken[i]) == bad
        if not bad:
            assert count[i] == n


def test_operator(spark):
    rows = [(1, GOOD, "x"), (2, "a|b", None), (3, None, "y"), (4, line(description="d" * 300000), "z"), (2, "a|b", None)]
    df = spark.createDataFrame(rows, "line_id long, line string, Reason string")
    parsed = rejects.parse_lines(df, "line", ["line_id", "Reason"])
    good, bad = rejects.split_rejects(parsed)
    assert sorted(r["line_id"] for r in good.collect()) == [1, 4]
    assert sorted((r["line_id"], r["reason"]) for r in bad.collect()) == [(2, "column_count"), (2, "column_count"), (3, "column_count")]
    assert "Reason_in" in parsed.columns
    assert rejects.parse_lines(df.limit(0), "line", ["line_id"]).count() == 0


def test_other_records(spark):
    fields = (Field("a", "whole", 0, 9, True), Field("b", "decimal"))
    df = spark.createDataFrame([("1|2.5",), ("10|1",), ("99999999999999999999|",)], "v string")
    got = [(r["reason"], r["a"], r["b"]) for r in rejects.parse_lines(df, "v", [], fields).collect()]
    assert got == [(None, 1, 2.5), ("bad_value", None, None), ("bad_value", None, None)]


def test_record_ends():
    cases = {
        "a|b\nc|d": ["a|b", "c|d"],
        'a|"b\nc"|d\ne|f\n': ['a|"b\nc"|d', "e|f"],
        '"x ""y\n\nz"""|w\r\nq': ['"x ""y\n\nz"""|w', "q"],
        'a|b "plain\nc" d|e': ['a|b "plain', 'c" d|e'],
        'a|"never closed\nb|c\nd|e': ['a|"never closed', "b|c", "d|e"],
        'a|"never closed\nb|"c"|d\ne|f': ['a|"never closed', 'b|"c"|d', "e|f"],
        '""|a\n""\n"b"': ['""|a', '""', '"b"'],
        "\n\na\n": ["a"],
        "": [],
    }
    for raw, want in cases.items():
        buf = np.frombuffer(raw.encode(), np.uint8)
        ends = [*rejects.record_ends(buf).tolist(), len(buf)]
        starts = [0, *[e + 1 for e in ends[:-1]]]
        got = [t for a, z in zip(starts, ends, strict=True) if (t := raw.encode()[a:z].decode().rstrip("\r"))]
        assert got == want, raw


def test_records_of_raw_files(spark):
    line = lambda i, text: "|".join([str(i), "", "Genus", *[""] * 9, text, *[""] * 9])
    raw = "\r\n".join([line(1, '"two\nlines"'), line(2, "plain"), line("x", "bad"), "too|few"])
    df = spark.createDataFrame([("f1", raw), ("f2", None), ("f3", "")], "file string, content string")
    cut = rejects.records(df, "content", ["file"])
    assert [r["record_no"] for r in cut.orderBy("record_no").collect()] == [0, 1, 2, 3]
    got = {r["record_no"]: (r["reason"], r["description"]) for r in rejects.parse_lines(cut, "record", ["file", "record_no"]).collect()}
    assert got == {0: (None, "two\nlines"), 1: (None, "plain"), 2: ("bad_value", None), 3: ("column_count", None)}


def test_dates_of_the_calendar():
    days = ["2000-02-29", "1900-02-29", "2023-04-31", "1999-12-31", "0000-01-01", "2024-13-01", ""]
    assert [d.isoformat() if d else None for d in rejects._dates(pa.array(days)).to_pylist()] == ["2000-02-29", None, None, "1999-12-31", None, None, None]
