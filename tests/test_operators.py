from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sylva.functions import names as N
from sylva.functions import text as X
from sylva.operators import cooccur, enrichment, gazetteer, graph, matching, matrix, ontology, taxonomy
from sylva.tables import names_apart, once, pick


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_leftmost_longest(spark):
    gaz = spark.createDataFrame([(n, n, "k") for n in ("of the", "in the", "the of", "in the of", "the", "of")], "name string, id string, kind string")
    df = spark.createDataFrame([(1, "In the of the"), (2, None), (3, "")], "doc long, t string")
    m = matching.dictionary_match(df, ["doc"], "t", gazetteer.dictionary(gaz, 2))
    assert rows(m.select("doc", "pos", "n", "name")) == [(1, 0, 3, "in the of"), (1, 3, 1, "the")]


def test_clauses(spark):
    df = spark.createDataFrame([("a; b;;; c;",), ("",)], "t string")
    assert [r[0] for r in df.select(X.clauses(F.col("t"))).collect()] == [["a", "b", "c"], []]
    assert [r[0] for r in df.select(X.first_clause(F.col("t"))).collect()] == ["a", ""]


def test_french(spark):
    df = spark.createDataFrame([("L'arbre aux chevaux feuillages glabres",)], "t string")
    assert df.select(X.french_tokens(F.col("t"))).first()[0] == ["arbre", "cheval", "feuillag", "glabr"]


def test_closure_with_cycle_and_diamond(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "d"), (None, "x")], "child string, parent string")
    c = rows(graph.closure(e))
    assert ("a", "d", 2) in c and ("a", "e", 3) in c and ("d", "e", 1) in c and len(c) == len({x[:2] for x in c})
    assert rows(graph.closure(e.limit(0))) == []


def test_nearest_stops_at_target(spark):
    e = spark.createDataFrame([("q", "m"), ("m", "attr1"), ("attr1", "attr2"), ("z", "y")], "child string, parent string")
    n = spark.createDataFrame([("q",), ("attr2",), ("z",)], "node string")
    t = spark.createDataFrame([("attr1",), ("attr2",)], "id string")
    assert rows(graph.nearest(n, e, t)) == [("attr2", "attr2", 0), ("q", "attr1", 2)]


def test_within_hops(spark):
    e = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3)], "s int, gov int, dep int")
    s = spark.createDataFrame([(1, 0)], "s int, src int")
    assert rows(graph.within_hops(e, "s", s)) == [(1, 0, 0, 0), (1, 0, 1, 1), (1, 0, 2, 2)]


def test_rank_fill_clears_lower_ranks(spark):
    df = spark.createDataFrame([(1, "G1", None, None), (2, None, "S1", None), (3, None, None, "a"), (4, "G2", None, None), (5, None, None, "b")], "o int, genus string, subgenus string, species string")
    df = df.withColumn("f", F.lit("x"))
    got = rows(taxonomy.fill_ranks(df, ["f"], ["o"], ["genus", "subgenus", "species"]).select("o", "genus_filled", "subgenus_filled", "species_filled"))
    assert got[2] == (3, "G1", "S1", "a") and got[3] == (4, "G2", None, None) and got[4] == (5, "G2", None, "b")
    kept = rows(taxonomy.fill_ranks(df, ["f"], ["o"], ["genus", "subgenus", "species"], keep_stale=True).select("o", "subgenus_filled"))
    assert kept[4] == (5, "S1")


def test_gazetteer(spark):
    terms = spark.createDataFrame(
        [("A:1", "leaf", ["blade of leaf"], [], False, None), ("A:2", "old leaf", [], ["x"], True, "A:1")],
        "id string, name string, synonyms array<string>, xrefs array<string>, is_obsolete boolean, replaced_by string",
    )
    g = gazetteer.from_terms(terms, {"A": "thing"})
    assert rows(g.select("name", "id")) == [("blade of leaf", "A:1"), ("leaf", "A:1"), ("old leaf", "A:1"), ("x", "A:2")]
    base = spark.createDataFrame([("similar to", "A:3", "k", "s"), ("leaf to", "A:4", "k", "s"), ("leaf", "A:1", "k", "s")], "name string, id string, kind string, source string")
    assert ("similar", "A:3") in rows(gazetteer.add_to_aliases(base).select("name", "id")) and ("leaf", "A:4") not in rows(gazetteer.add_to_aliases(base).select("name", "id"))
    groups = spark.createDataFrame([(1, "leaf"), (1, " frond"), (1, ""), (2, "unknown")], "group_id int, name string")
    assert ("frond", "A:1") in rows(gazetteer.merge_synonyms(base, groups).select("name", "id"))
    assert rows(gazetteer.coverage(base, groups, "A")) == [(1, "frond", ""), (2, "unknown", "")]


def test_fragments(spark):
    df = spark.createDataFrame([(1, "Blue leaf, red leaf")], "id long, t string")
    spans = spark.createDataFrame([(1, 5, 4, "leaf", "entity"), (1, 0, 4, "blue", "quality"), (1, 5, 4, "leaf", "quality")], "id long, start int, length int, name string, kind string")
    assert [r["fragment"] for r in cooccur.tagged_fragments(df, "id", "t", spans).collect()] == ["<Q>Blue</Q> <E>leaf</E>, red leaf"]


def test_matrix(spark):
    cells = spark.createDataFrame([("t1", "c", f"v{i:02d}") for i in range(52)] + [("t2", "d", "x")], "taxon string, character string, value string")
    s = {r["value"]: r["symbol"] for r in matrix.with_symbols(cells).collect()}
    assert s["v00"] == "A" and s["v25"] == "Z" and s["v26"] == "a" and s["v51"] == "z"
    with pytest.raises(Exception, match="52"):
        matrix.with_symbols(cells.union(spark.createDataFrame([("t1", "c", "v99")], cells.schema))).collect()
    again = spark.createDataFrame([("t", "c", "a", 1), ("t", "c", "b", 2)], "taxon string, character string, value string, o int")
    assert rows(matrix.last_values(again, "o")) == [("t", "c", "b")]
    ten = spark.createDataFrame([("t1", f"c{i}", "v") for i in range(10)] + [("t2", f"c{i}", "v") for i in range(9)], cells.schema)
    assert {r[0] for r in matrix.taxa_with(ten, 10).select("taxon").collect()} == {"t1"}
    doc = [r["line"] for r in matrix.nexus(matrix.with_symbols(ten)).orderBy("ord").collect()]
    assert doc[0] == "#NEXUS" and doc[-1] == "END;" and "DIMENSIONS NCHAR=10;" in doc and "t2 AAAAAAAAA?" in doc


def test_classes(spark):
    eq = spark.createDataFrame([("t", "E1", "Q1"), ("t", "E1", "Q2"), ("u", "E1", "Q1")], "taxon string, e_id string, q_id string")
    names = spark.createDataFrame([("E1", "leaf"), ("Q1", "blue")], "id string, name string")
    traits = spark.createDataFrame([("Q1", "Q2"), ("Q2", "T")], "q_id string, trait string")
    c = ontology.phenotype_classes(eq, names, traits)
    assert rows(c) == [("E1", "Q1", "eq", "leaf blue"), ("E1", "Q2", "eq", "leaf Q2"), ("E1", "T", "trait", "leaf T"), ("E1", None, "entity", "leaf phenotype")]
    c = ontology.numbered(c.withColumn("_q", F.coalesce("q", F.lit(""))), ["e", "_q"], "P:", "class_id")
    a = ontology.annotations(eq, c)
    assert a.count() == 3 and ontology.taxon_intersections(a).count() == 1
    lines = [r["axiom"] for r in ontology.axioms(c.withColumn("deprecated", F.col("q") == "Q2"), "http://x/").orderBy("ord").collect()]
    assert sum("EquivalentClasses" in x for x in lines) == 3 and sum("deprecated" in x for x in lines) == 1


def test_enrichment(spark):
    r = spark.createDataFrame([("g", 0.05, 0.5), ("g", 0.04, 0.9), ("g", 0.9, 0.01)], "group string, over double, under double")
    assert enrichment.significant(r).count() == 2
    assert rows(enrichment.enriched_counts(r)) == [("g", 1, 1)]
    h = enrichment.hypergeometric(spark.createDataFrame([(2, 2, 2, 4)], "k long, n long, marked long, total long")).first()
    assert h["over"] == pytest.approx(1 / 6) and h["under"] == pytest.approx(1.0)


def test_names(spark):
    df = spark.createDataFrame([("<http://x/obo/PO_12>", "Leaves", "blue-3")], "i string, c string, v string")
    assert tuple(df.select(N.curie(F.col("i")), N.strip_iri(F.col("i")), N.singular(F.col("c")), N.without_index(F.col("v"))).first()) == ("PO:12", "PO_12", "leaf", "blue")


def test_pick_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id long, text string, other string").toDF("id", "text", "TEXT")
    assert tuple(pick(df, ["TEXT", "id"]).first()) == ("b", 1)
    assert once(df, "id", ["text"]).first()["text"] == "a"
    none = spark.createDataFrame([(None, "a"), (None, "b"), (None, "a"), (1, "c"), (1, "c")], "id long, text string")
    assert rows(once(none, "id", ["text"])) == [(1, "c"), (None, "a"), (None, "b")]
    assert names_apart(["pos", "Pos_in"], ["pos"]) == {"pos": "pos_in", "Pos_in": "Pos_in_in"}


def test_external_model(spark):
    from pyspark.sql import types as T

    from sylva.operators.external import apply_model

    def load():
        return lambda texts: [[(i, w) for i, w in enumerate((t or "").split())] for t in texts]

    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc long, t string")
    cols = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("word", T.StringType())])
    assert rows(apply_model(df, "t", ["doc"], load, cols)) == [(1, 0, "a"), (1, 1, "b")]
