from __future__ import annotations

from pyspark.sql import functions as F

from sylva import streaming
from sylva.sinks import writers as W
from sylva.sources import readers as R

OBO = """format-version: 1.2
subsetdef: attribute_slim "a"

[Term]
id: A:1
name: leaf
synonym: "a "quoted" blade" EXACT []
xref: X:1 "leaf blade"
xref: X:2
is_a: A:0 ! organ
is_a: A:9
subset: attribute_slim
relationship: part_of A:5 ! plant

[Term]
id: A:2
name: old leaf
is_obsolete: true
replaced_by: A:1

[Typedef]
id: part_of
name: part of
"""


def test_obo(spark, tmp_path):
    (tmp_path / "a.obo").write_text(OBO)
    t = {r["id"]: r for r in R.obo_terms(spark, str(tmp_path)).collect()}
    assert set(t) == {"A:1", "A:2"}
    assert t["A:1"]["synonyms"] == ['a "quoted" blade'] and t["A:1"]["xrefs"] == ["leaf blade"] and t["A:1"]["is_a"] == ["A:0"] and t["A:1"]["is_attribute"]
    assert t["A:2"]["is_obsolete"] and t["A:2"]["replaced_by"] == "A:1"
    assert [tuple(r) for r in R.obo_relations(spark, str(tmp_path)).collect()] == [("A:1", "part_of", "A:5")]
    assert R.obo_labels(R.obo_terms(spark, str(tmp_path))).count() == 3
    assert R.obo_names(R.obo_terms(spark, str(tmp_path))).count() == 2


def test_markup(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        "<publication><treatment><taxon><feature class='description'><char class='leaves'>L <b>blue</b>; x.</char></feature><feature class='uses'/></taxon></treatment></publication>"
    )
    got = R.taxon_characters(R.flora_treatments(spark, str(tmp_path / "f.xml"))).collect()
    assert [(r["feature_class"], r["char_class"], r["text"]) for r in got] == [("description", "leaves", "L blue; x.")]


def test_species_list(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<r><Specieslist><Name.family>F</Name.family><Name.genus>G</Name.genus><description>d1</description><description>d2</description></Specieslist></r>")
    r = R.species_list(spark, str(tmp_path / "s.xml")).first()
    assert (r["family"], r["genus"], r["species"], r["description"]) == ("F", "G", None, "d1")


def test_delimited(spark, tmp_path):
    (tmp_path / "p.csv").write_text("1|Fam|Gen\n")
    r = R.pipe_descriptions(spark, str(tmp_path / "p.csv")).first()
    assert r["_c1"] == "Fam" and r["_c21"] is None
    (tmp_path / "h.csv").write_text('Taxon Name,Description\n"A, b","x ""y"" z"\n')
    assert tuple(R.csv_descriptions(spark, str(tmp_path / "h.csv"), "taxon string, description string").first()) == ("A, b", 'x "y" z')
    (tmp_path / "g.csv").write_text('# comment line\nab,c\n"leaf",x,PO:1\n')
    assert [tuple(r) for r in R.comma_glossary(spark, str(tmp_path / "g.csv")).collect()] == [("leaf", "PO:1")]
    (tmp_path / "l.tsv").write_text("1\tleaf\tfeuille\tFeuille\n")
    assert tuple(R.lexicon(spark, str(tmp_path / "l.tsv")).first()) == ("leaf", "feuille", "Feuille")
    (tmp_path / "v.vocab").write_text(" Leaf Types |a|| Ovate; Oval |def\n")
    v = R.vocabulary(spark, str(tmp_path / "v.vocab")).first()
    assert (v["category"], v["names"], v["definition"], v["vocab_file"]) == ("leaf types", "ovate; oval", "def", "v.vocab")
    (tmp_path / "t.tbl").write_text("PO:1\tleaf\ta def\nover two lines\tblade;frond\nPO:2\troot\td\t\n")
    t = R.term_table(spark, str(tmp_path / "t.tbl")).orderBy("id").collect()
    assert [(x["id"], x["label"], x["synonyms"]) for x in t] == [("PO:1", "leaf", ["blade", "frond"]), ("PO:2", "root", [])]


def test_results_and_owl(spark, tmp_path):
    (tmp_path / "r" / "g1").mkdir(parents=True)
    (tmp_path / "r" / "g1" / "groups.txt").write_text("a\tb\tE:1\t+\t\t\t\t\t\t0.9\t0.01\na\tb\tE:2\t+\t\t\t\t\t\tbad\t0.01\n")
    assert [tuple(x) for x in R.enrichment_results(spark, str(tmp_path / "r")).collect()] == [("g1", "E:1", "+", 0.9, 0.01)]
    (tmp_path / "o.owl").write_text('<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s"><owl:Class rdf:about="http://x/A_1"><rdfs:label>leaf</rdfs:label><rdfs:subClassOf rdf:resource="http://x/A_0"/></owl:Class></rdf:RDF>')
    c = R.owl_classes(spark, str(tmp_path / "o.owl")).first()
    assert (c["id"], c["label"], c["parents"]) == ("http://x/A_1", "leaf", ["http://x/A_0"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "k string, v string, n int")
    W.write_tsv(df, str(tmp_path / "t"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["a\tnull\t1", "b\tx\t2"]
    W.write_per_key(df, "k", str(tmp_path / "k"))
    assert spark.read.text(str(tmp_path / "k") + "/k=b").first()[0] == "x\t2"
    W.write_index(df, str(tmp_path / "i"), "k")
    assert spark.read.parquet(str(tmp_path / "i")).count() == 2
    W.write_document(spark.createDataFrame([(2, "z"), (1, "y")], "ord long, line string"), str(tmp_path / "d"))
    doc = W.owl_document(spark.createDataFrame([(1, "A")], "ord long, axiom string"), "http://x")
    assert [r["line"] for r in doc.orderBy("ord").collect()] == ["Ontology(<http://x>", "A", ")"]


def test_stream_drops_repeats(spark, tmp_path):
    df = spark.createDataFrame([(1,), (1,), (2,)], "id int").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    s = streaming.first_arrivals(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "id")
    q = s.writeStream.format("memory").queryName("arrivals").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("arrivals").count() == 2
