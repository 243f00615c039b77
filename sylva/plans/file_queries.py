"""Queries over files: each writes its files from the tables to the shared folder, in the layout the source is in, and reads them back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.operators import external, index
from sylva.plans.text_queries import described
from sylva.session import shared_dir
from sylva.sinks import writers as W
from sylva.sources import readers as R
from sylva.tables import once, table


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/files-{name}-{uuid.uuid4().hex}"


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "trait_terms").withColumnRenamed("term_id", "id")


def _obo(spark: SparkSession, folder: str) -> str:
    at = _place(spark, "obo")
    W.write_obo(_terms(spark, folder), at)
    return at


def obo_terms_read(spark: SparkSession, folder: str) -> DataFrame:
    """Terms with synonyms, references, parents and marks."""
    joined = lambda c: F.array_join(c, "|").alias(c)
    return R.obo_terms(spark, _obo(spark, folder)).select("id", "name", joined("synonyms"), joined("xrefs"), joined("is_a"), joined("subsets"), "is_obsolete", "replaced_by", "is_attribute", "is_value")


def obo_names_read(spark: SparkSession, folder: str) -> DataFrame:
    """Names with ids."""
    return R.obo_names(R.obo_terms(spark, _obo(spark, folder)))


def obo_labels_read(spark: SparkSession, folder: str) -> DataFrame:
    """S3: a row per name and synonym."""
    return R.obo_labels(R.obo_terms(spark, _obo(spark, folder)))


def obo_single_read(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and names of one file."""
    at = _place(spark, "obo-one")
    W.write_obo(_terms(spark, folder).filter("is_obsolete"), at)
    return R.obo_names(R.obo_terms(spark, at))


def obo_relations_read(spark: SparkSession, folder: str) -> DataFrame:
    """Relationship lines."""
    return R.obo_relations(spark, _obo(spark, folder))


def flora_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Treatments of marked-up files by their number of taxa."""
    at = _place(spark, "flora")
    W.write_elements(once(table(spark, folder, "treatments"), "treatment_id", ["body"]).select(F.regexp_replace("body", "^\\s*<[?]xml[^>]*>", "")), at, "publication")
    return R.flora_treatments(spark, at).select(F.coalesce(F.size("taxon"), F.lit(0)).alias("taxa")).select(F.greatest("taxa", F.lit(0)).alias("taxa")).groupBy("taxa").agg(F.count("*").alias("treatments"))


def species_list_read(spark: SparkSession, folder: str) -> DataFrame:
    """Flat species records."""
    at = _place(spark, "species")
    a = table(spark, folder, "accounts").select("account_id", "family", "genus", "species", "infraepi").distinct()
    tags = {"Name.family": "family", "Name.genus": "genus", "Name.species": "species", "infraepi": "infraepi", "habitat": "account_id"}
    W.write_elements(a.select(W.xml_record("Specieslist", {t: F.col(c).cast("string") for t, c in tags.items()})), at, "list")
    return R.species_list(spark, at).select(F.col("habitat").cast("bigint").alias("account_id"), "family", "genus", "species", "infraepi")


def pipe_read(spark: SparkSession, folder: str) -> DataFrame:
    """Pipe-delimited records without header."""
    at = _place(spark, "pipe")
    a = table(spark, folder, "accounts").select("account_id", "family", "genus", "species").distinct()
    W.write_raw(a.select(F.concat_ws("|", F.col("account_id").cast("string"), F.coalesce("family", F.lit("")), "genus", "species")), at)
    return R.pipe_descriptions(spark, at).select(F.col("_c0").cast("bigint").alias("account_id"), F.col("_c1").alias("family"), F.col("_c2").alias("genus"), F.col("_c3").alias("species"), F.col("_c21").alias("habitat"))


def csv_read(spark: SparkSession, folder: str) -> DataFrame:
    """Quoted CSV with a header, under an explicit schema."""
    at = _place(spark, "csv")
    rows = table(spark, folder, "part").select("p_partkey", F.concat(F.lit('a, "'), "p_name", F.lit('"\nb')).alias("p_name"))
    rows.write.csv(at, header=True, quote='"', escape='"', quoteAll=True)
    return R.csv_descriptions(spark, at, "p_partkey bigint, p_name string")


def comma_glossary_read(spark: SparkSession, folder: str) -> DataFrame:
    """The first and last token of each line that is no comment."""
    at = _place(spark, "commas")
    t = table(spark, folder, "term_list")
    W.write_raw(t.select(F.concat(F.lit('"'), "name", F.lit('",'), "kind", F.lit(", "), "term_id").alias("v")).unionByName(t.select(F.concat(F.lit("# "), "name").alias("v"))), at)
    return R.comma_glossary(spark, at)


def lexicon_read(spark: SparkSession, folder: str) -> DataFrame:
    """A bilingual word list."""
    at = _place(spark, "lexicon")
    t = table(spark, folder, "term_list")
    W.write_tsv(t.select("term_id", "name", F.concat(F.lit("le "), "name").alias("f"), F.upper("name").alias("p")), at)
    return R.lexicon(spark, at)


_FLAT = "[|\\r\\n\\t]+"


def vocabulary_read(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of glossary files."""
    at = _place(spark, "vocab")
    v = table(spark, folder, "vocab")
    flat = [F.regexp_replace(F.coalesce(c, F.lit("")), _FLAT, " ") for c in ("category", "sub1", "sub2", "names", "definition")]
    W.write_raw(v.select(F.concat_ws(" | ", *flat)), at)
    return R.vocabulary(spark, at).drop("vocab_file")


def eq_read(spark: SparkSession, folder: str) -> DataFrame:
    """Entity-quality rows."""
    at = _place(spark, "eq")
    t = _terms(spark, folder)
    W.write_tsv(t.select("name", F.lower("name").alias("e"), "id", F.upper("name").alias("q"), F.concat("id", F.lit("x")).alias("q_id"), (F.length("name") / 4).alias("score"), F.concat(F.lit("The "), "name").alias("text")), at)
    return R.eq_table(spark, at)


def trait_read(spark: SparkSession, folder: str) -> DataFrame:
    """Trait rows of seven columns."""
    at = _place(spark, "trait")
    t = _terms(spark, folder)
    W.write_tsv(t.select("name", F.col("name").alias("n2"), "id", F.col("id").alias("e2"), F.col("id").alias("q"), F.col("replaced_by").alias("t"), F.upper("name").alias("l")), at)
    return R.trait_table(spark, at)


def annotation_read(spark: SparkSession, folder: str) -> DataFrame:
    """Annotations of taxa joined with their environments and labels, each from its own file."""
    a, e, n = (_place(spark, k) for k in ("annotations", "environments", "labels"))
    c = table(spark, folder, "customer")
    iri = lambda k: F.concat(F.lit("http://example.org/"), F.col(k).cast("string"))
    W.write_tsv(c.select(iri("c_custkey").alias("i"), "c_name", iri("c_nationkey").alias("c")), a)
    W.write_tsv(c.select("c_name", F.upper("c_name").alias("l"), "c_mktsegment"), e)
    W.write_tsv(table(spark, folder, "nation").select(iri("n_nationkey").alias("i"), "n_name"), n)
    rows = R.annotation_table(spark, a).join(R.environment_table(spark, e).select("taxon", "env"), "taxon")
    return rows.join(R.label_table(spark, n).select(F.col("id").alias("class_iri"), F.col("label").alias("class_label")), "class_iri", "left").select("taxon_iri", "taxon", "env", "class_label")


def results_read(spark: SparkSession, folder: str) -> DataFrame:
    """Result rows of a folder of folders; rows without numbers are dropped."""
    at = _place(spark, "results")
    n = table(spark, folder, "nation")
    blank = [F.lit("-").alias(f"b{i}") for i in range(5)]
    for region in range(5):  # the folders of the layout
        rows = n.filter(F.col("n_regionkey") == region)
        bad = F.when(F.col("n_nationkey") % 7 == 0, F.lit("none")).otherwise((F.col("n_nationkey") / 100).cast("string"))
        W.write_tsv(rows.select(F.lit("x"), F.lit("y").alias("y"), "n_name", F.lit("+").alias("s"), *blank, bad.alias("u"), (1 - F.col("n_nationkey") / 100).alias("o")), f"{at}/region{region}/groups.txt")
    return R.enrichment_results(spark, at)


def owl_read(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of an RDF/XML document with label, deprecation, parents and equivalences."""
    at = _place(spark, "owl")
    spaces = ' xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#"'
    W.write_elements(W.rdf_classes(_terms(spark, folder), "http://example.org/"), at, "rdf:RDF", spaces)
    c = R.owl_classes(spark, at)
    return c.select("id", "label", F.coalesce("deprecated", F.lit(False)).alias("deprecated"), *[F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c) for c in ("parents", "equivalents")])


def term_table_read(spark: SparkSession, folder: str) -> DataFrame:
    """Term tables whose definitions may hold line breaks."""
    at = _place(spark, "tbl")
    t = table(spark, folder, "term_list")
    W.write_raw(t.select(F.concat_ws("\t", "term_id", "name", F.concat(F.lit("A "), "kind", F.lit("\nover two lines")), F.concat("name", F.lit("; other")))), at)
    return R.term_table(spark, at).select("id", "label", "definition", F.array_join("synonyms", "|").alias("synonyms"))


def index_postings(spark: SparkSession, folder: str) -> DataFrame:
    """The stored index, opened again: every token of every description with position and offsets."""
    at = _place(spark, "index")
    index.write(described(spark, folder), "sent_id", "description", at)
    return index.postings(index.open_index(spark, at)).select("term", "sent_id", "pos", "start", "end")


def index_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Exact phrases looked up in the stored index, with their places in the text."""
    at = _place(spark, "index")
    index.write(described(spark, folder), "sent_id", "description", at)
    names = table(spark, folder, "term_list").select(F.lower(F.trim("name")).alias("name"))
    return index.find(index.open_index(spark, at), "sent_id", names)


def tsv_written(spark: SparkSession, folder: str) -> DataFrame:
    """K2, K7: lines of tab-separated values, nulls as ``null``."""
    at = _place(spark, "tsv")
    W.write_tsv(_terms(spark, folder).select("id", "name", "replaced_by"), at)
    return spark.read.text(at)


def per_key_written(spark: SparkSession, folder: str) -> DataFrame:
    """K3: one folder per key."""
    at = _place(spark, "keys")
    W.write_per_key(table(spark, folder, "term_list").select("kind", "term_id", "name"), "kind", at)
    return spark.read.text(f"{at}/kind=entity").select("value", F.lit("entity").alias("kind")).unionByName(spark.read.text(f"{at}/kind=quality").select("value", F.lit("quality").alias("kind")))


def model_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Texts run through a model that each task loads once; the model here gives (governor, dependent) edges of a chain."""

    def load() -> Callable[[list[str | None]], list[list[tuple]]]:
        return lambda texts: [[(i, i + 1, w) for i, w in enumerate((t or "").split(" ")[1:])] for t in texts]

    columns = T.StructType([T.StructField("gov", T.IntegerType()), T.StructField("dep", T.IntegerType()), T.StructField("word", T.StringType())])
    return external.apply_model(described(spark, folder), "description", ["sent_id"], load, columns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        obo_terms_read, obo_names_read, obo_labels_read, obo_single_read, obo_relations_read, flora_scan, species_list_read, pipe_read, csv_read, comma_glossary_read, lexicon_read,
        vocabulary_read, eq_read, trait_read, annotation_read, results_read, owl_read, term_table_read, index_postings, index_phrases, tsv_written, per_key_written, model_rows,
    )
}

_DESCRIBED = "described AS (SELECT sent_id, description FROM sentences WHERE description IS NOT NULL)"
_TOKENS = f"""{_DESCRIBED},
tok AS (
  SELECT sent_id, description, regexp_extract_all(description, '[^\\p{{L}}\\p{{N}}]*[\\p{{L}}\\p{{N}}]+') AS piece FROM described),
placed AS (
  SELECT sent_id, description, i - 1 AS pos, piece[i] AS p, length(array_to_string(piece[1:i], '')) AS "end",
    regexp_extract(piece[i], '[\\p{{L}}\\p{{N}}]+$') AS word
  FROM (SELECT *, unnest(range(1, len(piece) + 1)) AS i FROM tok)),
postings AS (SELECT lower(word) AS term, sent_id, CAST(pos AS INTEGER) AS pos, CAST("end" - length(word) AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", description FROM placed)
"""

SQL: dict[str, str] = {
    "obo_terms_read": """SELECT term_id AS id, name, array_to_string(synonyms, '|') AS synonyms, array_to_string(xrefs, '|') AS xrefs, array_to_string(is_a, '|') AS is_a,
  coalesce(array_to_string(subsets, '|'), '') AS subsets, is_obsolete, replaced_by, coalesce(list_contains(subsets, 'attribute_slim'), false) AS is_attribute,
  coalesce(list_contains(subsets, 'value_slim'), false) AS is_value FROM trait_terms""",
    "obo_names_read": "SELECT name, term_id AS id FROM trait_terms",
    "obo_labels_read": "SELECT term_id AS id, unnest([name] || synonyms) AS label FROM trait_terms",
    "obo_single_read": "SELECT name, term_id AS id FROM trait_terms WHERE is_obsolete",
    "obo_relations_read": "SELECT term_id AS id, 'part_of' AS relation, unnest(is_a) AS target FROM trait_terms",
    "flora_scan": """SELECT CAST(taxa AS INTEGER) AS taxa, count(*) AS treatments FROM (
  SELECT len(regexp_extract_all(regexp_replace(regexp_replace(b, '(?s)<!\\[CDATA\\[.*?\\]\\]>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<taxon[\\s/>]')) AS taxa
  FROM (SELECT treatment_id, min(body) AS b FROM treatments GROUP BY 1)) GROUP BY 1""",
    "species_list_read": "SELECT DISTINCT account_id, nullif(family, '') AS family, nullif(genus, '') AS genus, nullif(species, '') AS species, nullif(infraepi, '') AS infraepi FROM accounts",
    "pipe_read": "SELECT DISTINCT account_id, nullif(family, '') AS family, genus, species, CAST(NULL AS VARCHAR) AS habitat FROM accounts",
    "csv_read": "SELECT p_partkey, 'a, \"' || p_name || '\"' || chr(10) || 'b' AS p_name FROM part",
    "comma_glossary_read": "SELECT name AS term, term_id AS id FROM term_list",
    "lexicon_read": "SELECT name AS english, 'le ' || name AS french, upper(name) AS french_pretty FROM term_list",
    "vocabulary_read": r"""WITH v AS (SELECT regexp_replace(coalesce(category, ''), '[|\r\n\t]+', ' ', 'g') AS c, regexp_replace(coalesce(sub1, ''), '[|\r\n\t]+', ' ', 'g') AS s1,
  regexp_replace(coalesce(sub2, ''), '[|\r\n\t]+', ' ', 'g') AS s2, regexp_replace(coalesce(names, ''), '[|\r\n\t]+', ' ', 'g') AS n, regexp_replace(coalesce(definition, ''), '[|\r\n\t]+', ' ', 'g') AS d FROM vocab)
SELECT lower(trim(c)) AS category, trim(s1) AS sub1, trim(s2) AS sub2, lower(trim(n)) AS names, trim(d) AS definition FROM v""",
    "eq_read": "SELECT name AS taxon, lower(name) AS e_name, term_id AS e_id, upper(name) AS q_name, term_id || 'x' AS q_id, length(name) / 4.0 AS score, 'The ' || name AS text FROM trait_terms",
    "trait_read": "SELECT name, name AS name2, term_id AS e1, term_id AS e2, term_id AS q, coalesce(replaced_by, 'null') AS trait, upper(name) AS label FROM trait_terms",
    "annotation_read": "SELECT 'http://example.org/' || c_custkey AS taxon_iri, c_name AS taxon, c_mktsegment AS env, n_name AS class_label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "results_read": "SELECT 'region' || n_regionkey AS \"group\", n_name AS id, '+' AS sign, n_nationkey / 100.0 AS under, 1 - n_nationkey / 100.0 AS over FROM nation WHERE n_nationkey % 7 <> 0",
    "owl_read": """SELECT 'http://example.org/' || replace(term_id, ':', '_') AS id, name AS label, is_obsolete AS deprecated,
  array_to_string(list_transform(is_a, lambda p: 'http://example.org/' || replace(p, ':', '_')), '|') AS parents,
  coalesce('http://example.org/' || replace(replaced_by, ':', '_'), '') AS equivalents FROM trait_terms""",
    "term_table_read": "SELECT term_id AS id, name AS label, 'A ' || kind || chr(10) || 'over two lines' AS definition, name || '|other' AS synonyms FROM term_list",
    "index_postings": f"WITH {_TOKENS} SELECT term, sent_id, pos, \"start\", \"end\" FROM postings",
    "index_phrases": f"""WITH {_TOKENS},
names AS (SELECT DISTINCT lower(trim(name)) AS name, regexp_extract_all(lower(trim(name)), '[\\p{{L}}\\p{{N}}]+') AS p FROM term_list),
runs AS (SELECT a.sent_id, a.pos, n.name, n.p, a."start" FROM postings a JOIN names n ON a.term = n.p[1])
SELECT r.sent_id, r.name, r.pos, r."start", max(b."end") AS "end"
FROM runs r JOIN postings b ON b.sent_id = r.sent_id AND b.pos >= r.pos AND b.pos < r.pos + len(r.p) AND b.term = r.p[b.pos - r.pos + 1]
GROUP BY r.sent_id, r.name, r.pos, r."start", r.p HAVING count(*) = len(r.p)""",
    "tsv_written": "SELECT term_id || chr(9) || name || chr(9) || coalesce(replaced_by, 'null') AS value FROM trait_terms",
    "per_key_written": "SELECT term_id || chr(9) || name AS value, kind FROM term_list",
    "model_rows": f"""WITH {_DESCRIBED}, w AS (SELECT sent_id, string_split(description, ' ') AS w FROM described)
SELECT sent_id, CAST(i - 2 AS INTEGER) AS gov, CAST(i - 1 AS INTEGER) AS dep, w[i] AS word FROM (SELECT *, unnest(range(2, len(w) + 1)) AS i FROM w)""",
}
