from __future__ import annotations

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.operators import packed
from sylva.operators.packed import DELIMITERS, _scan_row, _unquoted, split_array


def plain(text):
    """Character by character, without buffers."""
    if text is None:
        return []
    out = [_unquoted(p.strip(" \t\r\n\x0b\x0c 　  ")) for p in _scan_row(text, frozenset(DELIMITERS))]
    return [v for v in out if v]


def test_cases():
    cases = {
        "a; b,c": ["a", "b", "c"],
        "3/5-clasping; 2,8-nerved / x": ["3/5-clasping", "2,8-nerved", "x"],
        '"a; b"; "so ""c"" d, e"': ["a; b", 'so "c" d, e'],
        "“a / b” / c": ["a / b", "c"],
        "x (rare, old); y [in part, young]": ["x (rare, old)", "y [in part, young]"],
        " ; a;;a ;": ["a", "a"],
        "a、b，c；d": ["a", "b", "c", "d"],
        "a • b|c=d\te\nf": ["a", "b", "c", "d", "e", "f"],
        "shepherd's-x, y": ["shepherd's-x", "y"],
        'open "x; y': ['open "x', "y"],
        "(open; x": ["(open", "x"],
        '""; b': ["b"],
        "": [],
        "  ": [],
    }
    got = split_array(pa.array([*cases, None])).to_pylist()
    assert got == [*cases.values(), []]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet='ab12 ;,/|=\t\n•、；，“”()[]"é', max_size=14)), max_size=6))
def test_buffers_equal_plain_scan(texts):
    # A mark inside a bracket or a quotation mark inside the other kind is read alike only where all marks pair.
    texts = [t for t in texts if t is None or sum(c in t for c in "“([\"") <= 1]
    assert split_array(pa.array(texts, pa.string())).to_pylist() == [plain(t) for t in texts]


def test_sliced_arrays():
    arr = pa.array(["x;y", "a;b", None, "c"]).slice(1)
    assert split_array(arr).to_pylist() == [["a", "b"], [], ["c"]]


def test_operator(spark):
    long = "; ".join(f"v{i}" for i in range(20000))
    rows = [(1, "a; b", "p"), (2, None, "q"), (3, "", None), (4, "one", "r"), (5, long, "s"), (1, "a; b", "p")]
    df = spark.createDataFrame(rows, "id long, names string, POS string")
    out = packed.unpack(df, "names", ["id", "POS"], "value", "pos", min_values=2)
    assert out.columns == ["id", "POS_in", "pos", "value"]
    got = sorted(tuple(r) for r in out.filter("id < 5").collect())
    assert got == [(1, "p", 0, "a"), (1, "p", 0, "a"), (1, "p", 1, "b"), (1, "p", 1, "b")]
    assert out.filter("id = 5").count() == 20000
    assert packed.unpack(df.limit(0), "names", ["id"]).count() == 0


def test_delimiters_of_any_width():
    for mark in ("·", "§", "•", "\U0001f33f", "::", "<->"):
        got = split_array(pa.array([f"a{mark}b {mark} c", None, f"{mark}", f'"x{mark}y"{mark}z', f"é{mark}“p{mark}q”"]), (mark,))
        assert got.to_pylist() == [["a", "b", "c"], [], [], [f"x{mark}y", "z"], ["é", f"p{mark}q"]]


def test_unpaired_marks_keep_their_place():
    got = split_array(pa.array(["a; b", 'c"; d', "e; (f; g", "h", "", '"i; j"; k']))
    assert got.to_pylist() == [["a", "b"], ['c"', "d"], ["e", "(f", "g"], ["h"], [], ["i; j", "k"]]
