from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.llm import canon

TERMS = [
    ("T:1", "leaf blade width", ["lamina width", "QZTKH"], False, None),
    ("T:2", "petal colour", ["petal hue"], False, None),
    ("T:3", "petiole shape", [], False, None),
    ("T:4", "petiole odour", None, False, None),
    ("T:5", "spikelet number", [], False, None),
    ("T:6", "petal shape", [], False, None),
    ("T:7", "old tint of petal", [], True, "T:2"),
    ("T:8", "gone", [], True, None),
]
CASES = {
    "Leaf Blade Width": "T:1", "LeafBladeWidth": "T:1", "leaf_blade-width:": "T:1", "width of the leaf blade (mm)": "T:1", "leaf blade wdth": "T:1", "lf. blade width": "T:1", "laminas width": "T:1",
    "qztkh": "T:1", "petal color": "T:2", "pétal colour": "T:2", "petla colour": "T:2", "petal col.": "T:2", "Petal Hue ?": "T:2", "old tints of petal": "T:2", "pet. shape": "T:3", "petal shape": "T:6",
    "spikelet no.": "T:5", "spklt numbre": "T:5", "petal odour": "NONE", "petal": "NONE", "qztkx": "NONE", "?": "NONE", "soil reaction": "NONE", "gone": "NONE", "leaf blade width shape": "NONE",
}


def test_mapping(spark):
    terms = spark.createDataFrame(TERMS, "term_id string, name string, synonyms array<string>, is_obsolete boolean, replaced_by string")
    rows = [(v, i) for i, v in enumerate(CASES)] + [(None, 90), ("", 91), ("  ", 92), ("petal hue", 93), ("petal hue", 94), ("x" * 100000, 95)]
    df = spark.createDataFrame(rows, "cclass string, VALUE long")
    got = {r["value"]: r["goal"] for r in canon.map_to_list(df, "cclass", canon.reference_entries(terms)).collect()}
    assert {v: got[v] for v in CASES} == CASES
    assert "" not in got and "  " not in got and got["x" * 100000] == "NONE"
    assert canon.map_to_list(df.limit(0), "cclass", canon.reference_entries(terms)).count() == 0
    none = canon.map_to_list(df, "cclass", canon.reference_entries(terms.limit(0)))
    assert {r["goal"] for r in none.collect()} == {"NONE"}


def brute(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


words = st.text(alphabet="abcde", max_size=8)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_edit_distance(a, b):
    assert canon.osa(a, b, 99) == brute(a, b)
    assert canon.osa(a, b, 2) == min(brute(a, b), 3)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abeilnst", min_size=1, max_size=9), st.text(alphabet="abeilnst", min_size=1, max_size=9))
def test_keys_lose_no_similar_pair(t, ref):
    if canon.similarity(t, ref) > 0:
        assert canon.keys(t, False) & canon.keys(ref, True)
