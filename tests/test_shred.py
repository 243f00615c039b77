from __future__ import annotations

import xml.etree.ElementTree as ET

from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.operators import shred
from sylva.operators.shred import Columns, _tables, treatment_schema


def plain(xml):
    out = []
    root = ET.fromstring(xml)
    for t, taxon in enumerate(root.findall("taxon")):
        noms = [n for a in taxon.findall("nomenclature") for h in a.findall("homotypes") for n in h.findall("nom")]
        for i, n in enumerate(noms):
            out.append((t, "nom", t, i, n.get("class", "")))
            out += [(t, "name", i, k, x.get("class", "")) for k, x in enumerate(n.findall("name"))]
        for i, f in enumerate(taxon.findall("feature")):
            out.append((t, "feature", t, i, f.get("class", "")))
            out += [(t, "char", i, k, x.get("class", "")) for k, x in enumerate(f.findall("char"))]
    return sorted(out)


def shredded(*texts):
    root = treatment_schema()
    cols = Columns(root, "class", False)
    for i, x in enumerate(texts):
        cols.add(x, i)
    out = [[] for _ in texts]
    for node, above in _tables(root, root):
        for k, o, u, n in zip(*cols.rebuild(node, above), strict=True):
            out[cols.record[node.column][k]].append((int(o), node.table, int(u), int(n), cols.value[node.column][k] or ""))
    return [sorted(x) for x in out]


name = st.sampled_from(['<name class="g"/>', "<name/>", "<ref><name/></ref>"])
nom = st.lists(name, max_size=3).map(lambda x: f"<nom class='a'>{''.join(x)}</nom>")
homo = st.lists(nom, max_size=2).map(lambda x: f"<homotypes>{''.join(x)}</homotypes>")
nomen = st.lists(homo, max_size=2).map(lambda x: f"<nomenclature>{''.join(x)}</nomenclature>")
char = st.sampled_from(["<char class='leaf'>x <b>y</b></char>", "<char/>", "<heading/>"])
feat = st.lists(char, max_size=3).map(lambda x: f"<feature>{''.join(x)}</feature>")
taxon = st.lists(st.one_of(nomen, feat, st.just("<figure><name/></figure>")), max_size=4).map(lambda x: f"<taxon>{''.join(x)}</taxon>")
body = st.lists(taxon, max_size=3).map(lambda x: f"<treatment>{''.join(x)}</treatment>")


@settings(max_examples=200, deadline=None)
@given(st.lists(body, min_size=1, max_size=3))
def test_rebuilt_tables_equal_walk(bodies):
    assert shredded(*bodies) == [plain(b) for b in bodies]


def test_operator(spark):
    big = "<treatment>" + "<taxon><feature><char class='a'>t</char></feature></taxon>" * 3000 + "</treatment>"
    rows = [(1, "<treatment><taxon><feature class='d'><char class='c'>a &lt; <i>b</i><![CDATA[ c]]></char></feature></taxon></treatment>", 1), (2, None, 2), (3, "<treatment", 3), (4, "", 4), (5, big, 5), (6, "<treatment/>", 6)]
    df = spark.createDataFrame(rows, "treatment_id long, body string, Node int")
    out = shred.shred(df, "body", ["treatment_id", "Node"], text=True)
    assert "Node_in" in out.columns
    got = sorted((r["treatment_id"], r["node"], r["node_class"], r["node_text"]) for r in out.filter("treatment_id = 1").collect())
    assert got == [(1, "char", "c", "a < b c"), (1, "feature", "d", "")]
    assert {r[0] for r in out.select("treatment_id").distinct().collect()} == {1, 5}
    assert out.filter("treatment_id = 5 and node = 'char'").count() == 3000
    assert shred.shred(df.limit(0), "body", ["treatment_id"]).count() == 0


def test_malformed_records_are_reported(spark):
    rows = [(1, "<treatment><taxon><feature class='a'/></taxon></treatment>"), (2, "<treatment><taxon>"), (3, None), (4, ""), (5, "<other/>")]
    df = spark.createDataFrame(rows, "id long, body string")
    got = {r["id"]: r for r in shred.shred(df, "body", ["id"], malformed="malformed").collect()}
    assert sorted(got) == [1, 2, 4, 5] and got[1]["node"] == "feature"
    assert all(got[k]["node"] == "malformed" and got[k]["node_class"] and got[k]["node_no"] is None for k in (2, 4, 5))
    assert [r["id"] for r in shred.shred(df, "body", ["id"]).collect()] == [1]
