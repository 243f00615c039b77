"""Queries over gazetteers, hierarchies, ranks, derived classes, matrices, enrichment, markup and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva import streaming
from sylva.functions import names as N
from sylva.operators import cooccur, enrichment, gazetteer, graph, matching, matrix, ontology, shred, taxonomy
from sylva.plans.text_queries import described, phrases, term_gazetteer
from sylva.session import cut, shared_dir
from sylva.tables import once, table

#: Colours, below one node of a small quality hierarchy.
COLOURS = ("azure", "crimson", "maroon", "orange", "purple", "violet", "white", "yellow")
COLOUR = "PATO:COLOUR"


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "trait_terms").withColumnRenamed("term_id", "id")


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).select(F.col("id").alias("child"), F.explode("is_a").alias("parent"))


def gazetteer_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Names, synonyms and references with the ids they lead to."""
    return gazetteer.from_terms(_terms(spark, folder), {"TRX": "trait"}).select("name", "id", "kind")


def ids_per_name(spark: SparkSession, folder: str) -> DataFrame:
    both = gazetteer.union(gazetteer.from_terms(_terms(spark, folder), {"TRX": "trait"}), term_gazetteer(spark, folder))
    return gazetteer.ids_per_name(both).select("name", F.array_join("ids", ",").alias("ids"))


def name_per_id(spark: SparkSession, folder: str) -> DataFrame:
    """The name an id was given last."""
    rows = _terms(spark, folder).select("id", F.posexplode(F.concat(F.array("name"), "synonyms")).alias("ord", "name"))
    return gazetteer.name_per_id(rows, "ord")


def alias_to_insert(spark: SparkSession, folder: str) -> DataFrame:
    """Names ending in " to" also without it, where the shorter name is free."""
    r = table(spark, folder, "region").select(F.concat(F.lower("r_name"), F.lit(" to")).alias("name"), F.concat(F.lit("R:"), "r_regionkey").alias("id"))
    n = table(spark, folder, "nation").select(F.lower("n_name").alias("name"), F.concat(F.lit("N:"), "n_nationkey").alias("id"))
    gaz = r.unionByName(n).select("name", "id", F.lit("place").alias("kind"), F.lit("tables").alias("source"))
    return gazetteer.add_to_aliases(gaz).select("name", "id", "source")


def lexicon_union(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers of English names for their translations."""
    words = spark.createDataFrame([("petal", "pétale", "pétales"), ("sepal", "sépale", "x"), ("winged", "ailé", "ailée"), ("unknown", "inconnu", "inconnue")], "english string, french string, french_pretty string")
    return gazetteer.add_lexicon(term_gazetteer(spark, folder), words).select("name", "id", "source")


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    t = _terms(spark, folder)
    return t.select(F.col("id").alias("group_id"), F.explode(F.concat(F.array("name"), "synonyms")).alias("name"))


def synonym_merge(spark: SparkSession, folder: str) -> DataFrame:
    """All names of a group share the union of their ids."""
    gaz = _terms(spark, folder).filter(~F.col("is_obsolete")).select("name", "id", F.lit("trait").alias("kind"), F.lit("terms").alias("source"))
    return gazetteer.merge_synonyms(gaz, _groups(spark, folder)).select("name", "id", "source")


def coverage_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Glossary names without a wanted id."""
    gaz = _terms(spark, folder).filter(~F.col("is_obsolete")).select("name", "id")
    return gazetteer.coverage(gaz, _groups(spark, folder), "TRX:000")


def isa_closure(spark: SparkSession, folder: str) -> DataFrame:
    return graph.closure(_edges(spark, folder))


def nearest_attribute(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest organ term of every term."""
    t = _terms(spark, folder)
    return graph.nearest(t.select(F.col("id").alias("node")), _edges(spark, folder), t.filter(F.col("name").endswith(" trait")).select("id"))


def rank_forward_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse values carried forward per user; a higher rank's new value clears the lower ones."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k")
    cols = {"family": "signup", "genus": "purchase", "species": "click"}
    rows = e.select("event_id", "user_id", "ts", *[F.when(F.col("event_type") == t, k).alias(c) for c, t in cols.items()])
    out = taxonomy.fill_ranks(rows, ["user_id"], ["ts", "event_id"], list(cols))
    return out.select("event_id", *[F.col(f"{c}_filled").alias(c) for c in cols])


def rank_forward_fill_plain(spark: SparkSession, folder: str) -> DataFrame:
    """The same with stale lower ranks kept."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k")
    cols = {"family": "signup", "genus": "purchase", "species": "click"}
    rows = e.select("event_id", "user_id", "ts", *[F.when(F.col("event_type") == t, k).alias(c) for c, t in cols.items()])
    out = taxonomy.fill_ranks(rows, ["user_id"], ["ts", "event_id"], list(cols), keep_stale=True)
    return out.select("event_id", *[F.col(f"{c}_filled").alias(c) for c in cols])


def rank_string(spark: SparkSession, folder: str) -> DataFrame:
    a = once(table(spark, folder, "accounts"), "account_id", ["family", "genus", "species", "infraepi", "source"])
    return a.select(
        "account_id",
        N.rank_string([(c, F.col(c)) for c in ("family", "genus", "species")], F.col("infraepi"), F.col("source")).alias("ranked"),
        N.name_template(("Family", F.col("family")), ("Genus", F.col("genus")), ("Species", F.col("species")), ("Sub", F.col("infraepi"))).alias("label"),
    )


def rank_inherit(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of a family, of a genus and of a species that hold for each species."""
    a = once(table(spark, folder, "accounts"), "account_id", ["family", "genus", "species", "source", "lang"]).filter(F.col("family").isNotNull())
    rows = a.select("family", F.concat_ws(" ", "genus", "species").alias("node"), F.lit(7).alias("rank_pos"))
    facts = a.groupBy("family").agg(F.min("source").alias("value")).withColumn("rank_pos", F.lit(1))
    late = a.groupBy("family").agg(F.max("genus").alias("value")).withColumn("rank_pos", F.lit(9))
    return taxonomy.inherit(rows, facts.unionByName(late), ["family"], "value")


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    s = described(spark, folder)
    hits = matching.phrase_hits(s, ["sent_id"], "description", phrases(spark, folder))
    return cooccur.pairs(hits, "sent_id").join(s.select("sent_id", "taxon"), "sent_id").filter(F.col("taxon").isNotNull()).select("taxon", "e_id", "q_id").distinct()


def _quality_edges(spark: SparkSession, folder: str) -> DataFrame:
    return term_gazetteer(spark, folder).filter(F.col("name").isin(*COLOURS)).select(F.col("id").alias("child"), F.lit(COLOUR).alias("parent"))


def _classes(spark: SparkSession, folder: str, facts: DataFrame) -> DataFrame:
    names = term_gazetteer(spark, folder).select("id", "name").unionByName(spark.createDataFrame([(COLOUR, "colour")], "id string, name string"))
    q = facts.select(F.col("q_id").alias("node")).distinct()
    traits = graph.nearest(q, _quality_edges(spark, folder), spark.createDataFrame([(COLOUR,)], "id string")).select(F.col("node").alias("q_id"), F.col("target").alias("trait"))
    made = ontology.phenotype_classes(facts, names, traits).withColumn("_q", F.coalesce("q", F.lit("")))
    return ontology.numbered(made, ["e", "_q", "kind"], "PHE:", "class_id").drop("_q")


def phenotype_classes(spark: SparkSession, folder: str) -> DataFrame:
    return _classes(spark, folder, cut(_facts(spark, folder)))


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Taxa with the class of each of their facts and the class's label."""
    facts = cut(_facts(spark, folder))
    classes = _classes(spark, folder, facts)
    a = ontology.annotations(facts, classes)
    return enrichment.labelled(a, ontology.labels(classes).select("id", F.col("label").alias("name")), "class_id", "label")


def taxon_intersections(spark: SparkSession, folder: str) -> DataFrame:
    facts = cut(_facts(spark, folder))
    t = ontology.taxon_intersections(ontology.annotations(facts, _classes(spark, folder, facts)))
    return t.select("taxon", F.array_join("classes", ",").alias("classes"))


def deprecated_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Classes, with those whose quality lies below the seed marked."""
    facts = cut(_facts(spark, folder))
    classes = cut(_classes(spark, folder, facts))
    bad = ontology.unsatisfiable(classes, graph.closure(_quality_edges(spark, folder)), COLOUR)
    return ontology.deprecate(classes, bad).select("class_id", "label", "deprecated")


def class_axioms(spark: SparkSession, folder: str) -> DataFrame:
    """The ontology as ordered lines in functional syntax."""
    facts = cut(_facts(spark, folder))
    classes = cut(_classes(spark, folder, facts))
    bad = ontology.unsatisfiable(classes, graph.closure(_quality_edges(spark, folder)), COLOUR)
    return ontology.axioms(ontology.deprecate(classes, bad), "http://example.org/")


def known_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Facts both of whose terms exist and aren't obsolete."""
    t = term_gazetteer(spark, folder).select("id", F.col("name").isin(*COLOURS).alias("is_obsolete"))
    return ontology.known_pairs(_facts(spark, folder), t)


def replaced_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Obsolete terms with the name of their replacement, if any."""
    t = _terms(spark, folder)
    gone = t.filter("is_obsolete").select("id", "name", "replaced_by")
    return enrichment.labelled(gone, t.select("id", "name"), "replaced_by", "new_name")


def stripped_iris(spark: SparkSession, folder: str) -> DataFrame:
    iri = F.concat(F.lit("<http://example.org/obo/"), F.replace("id", F.lit(":"), F.lit("_")), F.lit(">"))
    t = _terms(spark, folder)
    return t.select("id", N.strip_iri(iri).alias("short"), N.curie(iri).alias("curie"), N.singular(F.col("name")).alias("singular"))


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(
        F.concat(F.lit("TAXON"), "user_id").alias("taxon"), F.col("event_type").alias("character"),
        F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("string").alias("value"), F.struct("ts", "event_id").alias("o"),
    )
    return matrix.last_values(e, "o")


def char_last_value(spark: SparkSession, folder: str) -> DataFrame:
    return _cells(spark, folder)


def char_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.with_symbols(_cells(spark, folder))


def min_chars_taxa(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.taxa_with(_cells(spark, folder), 5).select("taxon").distinct()


def char_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.matrix_rows(matrix.taxa_with(matrix.with_symbols(cut(_cells(spark, folder))), 4))


def nexus_document(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.nexus(cut(matrix.taxa_with(matrix.with_symbols(_cells(spark, folder)), 4)))


def func_input(spark: SparkSession, folder: str) -> DataFrame:
    """Membership of customers in priorities, with their segment as environment."""
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("taxon"), F.col("o_orderpriority").alias("phenotype"))
    env = table(spark, folder, "customer").select(F.col("c_custkey").alias("taxon"), F.col("c_mktsegment").alias("env"))
    return enrichment.membership(o, env)


def _results(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    over = F.expr("try_cast(get_json_object(props, '$.k') as double)") / 100
    return e.select(F.col("event_type").alias("group"), F.col("event_id").alias("id"), over.alias("over"), F.round(1 - over, 6).alias("under"))


def enriched_rows(spark: SparkSession, folder: str) -> DataFrame:
    return enrichment.significant(_results(spark, folder))


def enriched_counts(spark: SparkSession, folder: str) -> DataFrame:
    return enrichment.enriched_counts(_results(spark, folder))


def enrichment_test(spark: SparkSession, folder: str) -> DataFrame:
    """Hypergeometric test of each priority in each segment."""
    g = func_input(spark, folder).filter("member = 1 or member = 0")
    per = g.groupBy("phenotype", "env").agg(F.sum("member").alias("k"), F.count("*").alias("n"))
    w = Window.partitionBy("phenotype")
    counts = per.select("phenotype", "env", "k", "n", F.sum("k").over(w).alias("marked"), F.sum("n").over(w).alias("total"))
    return enrichment.hypergeometric(counts).select("phenotype", "env", "k", "n", F.round("over", 6).alias("over"), F.round("under", 6).alias("under"))


def _markup(spark: SparkSession, folder: str) -> DataFrame:
    rows = once(table(spark, folder, "treatments"), "treatment_id", ["flora_file", "body"])
    return shred.shred(rows, "body", ["flora_file", "treatment_id"], text=True)


def flora_characters(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of the described features with their class in the singular and all their text."""
    m = cut(_markup(spark, folder))
    f = m.filter("node = 'feature' and node_class in ('description', 'habitatecology')").select("treatment_id", "taxon_no", F.col("node_no").alias("feature_no"), F.col("node_class").alias("feature_class"))
    c = m.filter("node = 'char'").select("treatment_id", "taxon_no", F.col("parent_no").alias("feature_no"), F.col("node_no").alias("char_no"), N.singular(F.col("node_class")).alias("char_class"), F.col("node_text").alias("text"))
    return c.join(f, ["treatment_id", "taxon_no", "feature_no"])


def feature_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of a feature's characters, in order, as one; a group is one feature of one record."""
    c = flora_characters(spark, folder).groupBy("treatment_id", "taxon_no", "feature_no", "feature_class")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_no", "text"))), lambda x: x["text"]), " ")
    return c.agg(joined.alias("text"))


def flora_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Rank names of accepted names, carried down each flora file in document order."""
    m = cut(_markup(spark, folder))
    acc = m.filter("node = 'nom' and node_class = 'accepted'").select("treatment_id", "taxon_no", F.col("node_no").alias("nom_no"))
    n = m.filter("node = 'name'").select("flora_file", "treatment_id", "taxon_no", F.col("parent_no").alias("nom_no"), F.col("node_class").alias("rank"), "node_text", "node_no")
    ranks = ["family", "genus", "species"]
    wide = n.join(acc, ["treatment_id", "taxon_no", "nom_no"]).groupBy("flora_file", "treatment_id", "taxon_no").agg(
        *[F.min_by(F.when(F.col("rank") == r, F.trim("node_text")), F.when(F.col("rank") == r, F.struct("nom_no", "node_no"))).alias(r) for r in ranks]
    )
    out = taxonomy.fill_ranks(wide.withColumn("flora_file", F.coalesce("flora_file", F.lit(""))), ["flora_file"], ["treatment_id", "taxon_no"], ranks)
    return out.select("flora_file", "treatment_id", "taxon_no", N.rank_string([(r, F.col(f"{r}_filled")) for r in ranks]).alias("taxon"))


def flora_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of a character's class and text with the qualities of its text."""
    c = flora_characters(spark, folder).filter("feature_class = 'description'")
    key = ["treatment_id", "taxon_no", "feature_no", "char_no"]
    c = cut(c.select(*key, "char_class", "text"))
    p = phrases(spark, folder)
    e = matching.dictionary_match(c, key, "char_class", p).unionByName(matching.dictionary_match(c, key, "text", p)).filter("kind = 'entity'")
    q = matching.dictionary_match(c, key, "text", p).filter("kind = 'quality'")
    return e.select(*key, F.col("id").alias("e_id")).distinct().join(q.select(*key, F.col("id").alias("q_id")).distinct(), key).select("treatment_id", "taxon_no", "e_id", "q_id").distinct()


def _streamed(spark: SparkSession, folder: str, name: str, make: Callable[[DataFrame], DataFrame], mode: str, schema: str) -> DataFrame:
    """Runs a stream over a table to its end; the result is a table in the shared folder."""
    at = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    source = table(spark, folder, name)
    path = f"{folder}/{name}.parquet"
    single = not path.endswith("/") and not source.inputFiles()[0].rstrip("/").rpartition("/")[0].endswith(f"{name}.parquet")
    reader = spark.readStream.schema(source.schema)
    stream = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(path)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")

    spark.createDataFrame([], schema).write.mode("append").parquet(f"{at}/out")
    q = make(stream).writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/state").foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")


def stream_annotation(spark: SparkSession, folder: str) -> DataFrame:
    """Phrase hits of arriving sentences."""
    p = phrases(spark, folder)
    make = lambda s: streaming.annotate(s.filter(F.col("description").isNotNull()), ["sent_id"], "description", p).select("sent_id", "pos", "name")
    return _streamed(spark, folder, "sentences", make, "append", "sent_id long, pos int, name string")


def stream_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events per hour and type."""
    make = lambda s: streaming.windowed_counts(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return _streamed(spark, folder, "events", make, "complete", "start timestamp, event_type string, n long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        gazetteer_terms, ids_per_name, name_per_id, alias_to_insert, lexicon_union, synonym_merge, coverage_missing, isa_closure, nearest_attribute,
        rank_forward_fill, rank_forward_fill_plain, rank_string, rank_inherit, phenotype_classes, annotations, taxon_intersections, deprecated_classes,
        class_axioms, known_pairs, replaced_terms, stripped_iris, char_last_value, char_symbols, min_chars_taxa, char_matrix, nexus_document, func_input,
        enriched_rows, enriched_counts, enrichment_test, flora_characters, feature_texts, flora_ranks, flora_facts, stream_annotation, stream_window_counts,
    )
}

_GAZ = """
gaz AS (
  SELECT name, coalesce(replaced_by, term_id) AS id FROM trait_terms
  UNION SELECT unnest(list_concat(synonyms, xrefs)) AS name, term_id FROM trait_terms)
"""
_PAIRS = r"""
toks AS (SELECT sent_id, taxon, regexp_extract_all(lower(description), '[\p{L}\p{N}]+') AS w FROM sentences WHERE description IS NOT NULL AND taxon IS NOT NULL),
ph AS (SELECT DISTINCT term_id AS id, kind, regexp_extract_all(lower(name), '[\p{L}\p{N}]+') AS phrase FROM term_list WHERE length(trim(name)) >= 3),
place AS (SELECT sent_id, taxon, w, unnest(range(1, len(w) + 1)) AS i FROM toks),
m AS (SELECT DISTINCT sent_id, taxon, id, kind FROM place JOIN ph ON w[i] = phrase[1] AND w[i:i + len(phrase) - 1] = phrase),
facts AS (SELECT DISTINCT e.taxon, e.id AS e_id, q.id AS q_id FROM m e JOIN m q ON e.sent_id = q.sent_id WHERE e.kind = 'entity' AND q.kind = 'quality')
"""
_IN = ", ".join(f"'{c}'" for c in COLOURS)
_CLASSES = f"""
{_PAIRS},
pairs AS (SELECT DISTINCT e_id AS e, q_id AS q FROM facts),
traits AS (SELECT DISTINCT e, '{COLOUR}' AS q FROM pairs JOIN term_list ON q = term_id WHERE name IN ({_IN})),
made AS (
  SELECT DISTINCT e, NULL AS q, 'entity' AS kind FROM pairs UNION ALL SELECT e, q, 'eq' FROM pairs
  UNION ALL SELECT e, q, 'trait' FROM traits WHERE (e, q) NOT IN (SELECT e, q FROM pairs)),
names AS (SELECT term_id AS id, name FROM term_list UNION ALL SELECT '{COLOUR}', 'colour'),
classes AS (
  SELECT e, q, kind, coalesce(a.name, e) || ' ' || CASE WHEN kind = 'entity' THEN 'phenotype' ELSE coalesce(b.name, q) END AS label,
    'PHE:' || row_number() OVER (ORDER BY e, coalesce(q, ''), kind) AS class_id
  FROM made LEFT JOIN names a ON a.id = e LEFT JOIN names b ON b.id = q),
noted AS (SELECT DISTINCT taxon, class_id FROM facts JOIN classes ON e = e_id AND q = q_id)
"""
_FILLED = """
r AS (
  SELECT event_id, user_id, ts, CASE WHEN event_type = 'signup' THEN k END AS family, CASE WHEN event_type = 'purchase' THEN k END AS genus, CASE WHEN event_type = 'click' THEN k END AS species
  FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events))
"""
_W = "OVER (PARTITION BY user_id{} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_CELLS = """
cells AS (
  SELECT 'TAXON' || user_id AS taxon, event_type AS character,
    arg_max(CAST(CAST(floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 10.0) AS INTEGER) AS VARCHAR), (ts, event_id)) AS value
  FROM events GROUP BY 1, 2),
sym AS (
  SELECT character, value, chr(CAST(CASE WHEN r <= 26 THEN 64 + r ELSE 70 + r END AS INTEGER)) AS symbol
  FROM (SELECT character, value, row_number() OVER (PARTITION BY character ORDER BY value) AS r FROM (SELECT DISTINCT character, value FROM cells)))
"""

SQL: dict[str, str] = {
    "gazetteer_terms": f"WITH {_GAZ} SELECT DISTINCT name, id, 'trait' AS kind FROM gaz WHERE trim(name) <> ''",
    "ids_per_name": f"""
WITH {_GAZ}, b AS (SELECT name, id FROM gaz WHERE trim(name) <> '' UNION SELECT name, term_id FROM term_list)
SELECT name, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM b GROUP BY name""",
    "name_per_id": "SELECT term_id AS id, CASE WHEN len(synonyms) > 0 THEN synonyms[len(synonyms)] ELSE name END AS name FROM trait_terms",
    "alias_to_insert": """
WITH g AS (SELECT lower(r_name) || ' to' AS name, 'R:' || r_regionkey AS id, 'tables' AS source FROM region UNION ALL SELECT lower(n_name), 'N:' || n_nationkey, 'tables' FROM nation)
SELECT DISTINCT * FROM g UNION SELECT replace(name, ' to', ''), id, 'alias' FROM g WHERE name LIKE '% to' AND replace(name, ' to', '') NOT IN (SELECT name FROM g)""",
    "lexicon_union": """
WITH w(english, other) AS (VALUES ('petal', 'pétale'), ('petal', 'pétales'), ('sepal', 'sépale'), ('winged', 'ailé'), ('winged', 'ailée'))
SELECT DISTINCT name, term_id AS id, 'terms' AS source FROM term_list UNION SELECT other, term_id, 'lexicon' FROM w JOIN term_list ON name = english""",
    "synonym_merge": """
WITH gaz AS (SELECT name, term_id AS id FROM trait_terms WHERE NOT is_obsolete),
groups AS (SELECT DISTINCT term_id AS group_id, lower(trim(name)) AS name FROM (SELECT term_id, unnest(list_concat([name], synonyms)) AS name FROM trait_terms) WHERE trim(name) <> ''),
shared AS (SELECT DISTINCT group_id, id FROM groups JOIN gaz ON groups.name = lower(gaz.name))
SELECT DISTINCT name, id, 'terms' AS source FROM gaz UNION SELECT name, id, 'glossary' FROM groups JOIN shared USING (group_id)""",
    "coverage_missing": """
WITH gaz AS (SELECT DISTINCT lower(name) AS name, term_id AS id FROM trait_terms WHERE NOT is_obsolete),
groups AS (SELECT DISTINCT term_id AS group_id, lower(trim(name)) AS name FROM (SELECT term_id, unnest(list_concat([name], synonyms)) AS name FROM trait_terms) WHERE trim(name) <> '')
SELECT group_id, name, coalesce(string_agg(DISTINCT id, ',' ORDER BY id), '') AS ids FROM groups LEFT JOIN gaz USING (name)
GROUP BY 1, 2 HAVING NOT coalesce(bool_or(starts_with(id, 'TRX:000')), false)""",
    "isa_closure": """
WITH RECURSIVE e AS (SELECT DISTINCT term_id AS child, unnest(is_a) AS parent FROM trait_terms),
c AS (SELECT child, parent AS ancestor, 1 AS depth FROM e WHERE child <> parent
  UNION SELECT c.child, e.parent, c.depth + 1 FROM c JOIN e ON c.ancestor = e.child WHERE c.depth < 30 AND c.child <> e.parent)
SELECT child, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM c GROUP BY 1, 2""",
    "nearest_attribute": """
WITH RECURSIVE e AS (SELECT DISTINCT term_id AS pt, unnest(is_a) AS parent FROM trait_terms),
t AS (SELECT term_id AS id FROM trait_terms WHERE name LIKE '% trait'),
w AS (SELECT term_id AS node, term_id AS pt, 0 AS depth FROM trait_terms
  UNION SELECT w.node, e.parent, w.depth + 1 FROM w JOIN e USING (pt) WHERE w.pt NOT IN (SELECT id FROM t) AND w.depth < 30)
SELECT node, target, CAST(depth AS INTEGER) AS depth FROM (SELECT node, pt AS target, depth, row_number() OVER (PARTITION BY node ORDER BY depth, pt) AS r FROM w WHERE pt IN (SELECT id FROM t)) WHERE r = 1""",
    "rank_forward_fill": f"""
WITH {_FILLED}, a AS (SELECT *, sum(CASE WHEN family IS NOT NULL THEN 1 ELSE 0 END) {_W.format("")} AS g1, sum(CASE WHEN family IS NOT NULL OR genus IS NOT NULL THEN 1 ELSE 0 END) {_W.format("")} AS g2 FROM r)
SELECT event_id, last_value(family IGNORE NULLS) {_W.format("")} AS family, last_value(genus IGNORE NULLS) {_W.format(", g1")} AS genus, last_value(species IGNORE NULLS) {_W.format(", g2")} AS species FROM a""",
    "rank_forward_fill_plain": f"WITH {_FILLED} SELECT event_id, " + ", ".join(f"last_value({c} IGNORE NULLS) {_W.format('')} AS {c}" for c in ("family", "genus", "species")) + " FROM r",
    "rank_string": """
WITH a AS (SELECT DISTINCT account_id, family, genus, species, infraepi, source FROM accounts)
SELECT account_id, CASE WHEN family <> '' THEN 'family: ' || family || '; ' ELSE '' END || CASE WHEN genus <> '' THEN 'genus: ' || genus || '; ' ELSE '' END
    || CASE WHEN species <> '' THEN 'species: ' || species || '; ' ELSE '' END || concat_ws('; ', nullif(infraepi, ''), nullif(source, '')) AS ranked,
  'Family: ' || coalesce(family, 'null') || ', Genus: ' || coalesce(genus, 'null') || ', Species: ' || coalesce(species, 'null') || ', Sub: ' || coalesce(infraepi, 'null') AS label FROM a""",
    "rank_inherit": """
SELECT DISTINCT family, concat_ws(' ', genus, species) AS node, value FROM (SELECT DISTINCT family, genus, species FROM accounts WHERE family IS NOT NULL)
JOIN (SELECT family, min(source) AS value FROM accounts WHERE family IS NOT NULL GROUP BY 1) USING (family)""",
    "phenotype_classes": f"WITH {_CLASSES} SELECT e, q, kind, label, class_id FROM classes",
    "annotations": f"WITH {_CLASSES} SELECT taxon, class_id, label FROM noted JOIN classes USING (class_id)",
    "taxon_intersections": f"WITH {_CLASSES} SELECT taxon, string_agg(class_id, ',' ORDER BY class_id) AS classes FROM noted GROUP BY taxon HAVING count(*) > 1",
    "deprecated_classes": f"WITH {_CLASSES} SELECT class_id, label, coalesce(q = '{COLOUR}' OR q IN (SELECT term_id FROM term_list WHERE name IN ({_IN})), false) AS deprecated FROM classes",
    "known_pairs": f"WITH {_PAIRS} SELECT taxon, e_id, q_id FROM facts WHERE e_id IN (SELECT term_id FROM term_list WHERE name NOT IN ({_IN})) AND q_id IN (SELECT term_id FROM term_list WHERE name NOT IN ({_IN}))",
    "replaced_terms": "SELECT a.term_id AS id, a.name, a.replaced_by, b.name AS new_name FROM trait_terms a LEFT JOIN trait_terms b ON b.term_id = a.replaced_by WHERE a.is_obsolete",
    "stripped_iris": "SELECT term_id AS id, replace(term_id, ':', '_') AS short, term_id AS curie, regexp_replace(replace(lower(name), 'leaves', 'leaf'), 's$', '') AS singular FROM trait_terms",
    "char_last_value": f"WITH {_CELLS} SELECT taxon, character, value FROM cells",
    "char_symbols": f"WITH {_CELLS} SELECT taxon, character, value, symbol FROM cells JOIN sym USING (character, value)",
    "min_chars_taxa": f"WITH {_CELLS} SELECT taxon FROM cells GROUP BY 1 HAVING count(*) >= 5",
    "char_matrix": f"""
WITH {_CELLS}, ok AS (SELECT taxon FROM cells GROUP BY 1 HAVING count(*) >= 4), s AS (SELECT taxon, character, symbol FROM cells JOIN sym USING (character, value) SEMI JOIN ok USING (taxon)),
grid AS (SELECT taxon, character FROM ok, (SELECT DISTINCT character FROM s))
SELECT taxon, string_agg(coalesce(symbol, '?'), '' ORDER BY character) AS states FROM grid LEFT JOIN s USING (taxon, character) GROUP BY 1""",
    "func_input": """
WITH p AS (SELECT DISTINCT o_custkey AS taxon, o_orderpriority AS phenotype FROM orders)
SELECT x.phenotype, c_custkey AS taxon, c_mktsegment AS env, CAST(p.taxon IS NOT NULL AS INTEGER) AS member
FROM (SELECT DISTINCT phenotype FROM p) x, customer LEFT JOIN p ON p.taxon = c_custkey AND p.phenotype = x.phenotype""",
    "enriched_rows": """
SELECT * FROM (SELECT event_type AS "group", event_id AS id, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS over, round(1 - CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100, 6) AS under FROM events) WHERE over < 0.05 OR under < 0.05""",
    "enriched_counts": """
SELECT "group", count_if(over < 0.05) AS n_over, count_if(under < 0.05) AS n_under FROM
(SELECT event_type AS "group", CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS over, round(1 - CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100, 6) AS under FROM events) GROUP BY 1""",
    "stream_annotation": r"""
WITH toks AS (SELECT sent_id, regexp_extract_all(lower(description), '[\p{L}\p{N}]+') AS w FROM sentences WHERE description IS NOT NULL),
ph AS (SELECT DISTINCT lower(trim(name)) AS name, regexp_extract_all(lower(name), '[\p{L}\p{N}]+') AS phrase FROM term_list WHERE length(trim(name)) >= 3),
place AS (SELECT sent_id, w, unnest(range(1, len(w) + 1)) AS i FROM toks)
SELECT sent_id, CAST(i - 1 AS INTEGER) AS pos, name FROM place JOIN ph ON w[i] = phrase[1] AND w[i:i + len(phrase) - 1] = phrase""",
    "stream_window_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
