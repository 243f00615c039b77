"""Readers of the file formats descriptions, glossaries and term hierarchies come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva import schemas
from sylva.tables import quoted


def _tag(name: str, tail: str = "(.*)") -> Column:
    """All values of a tag of a term stanza."""
    return F.regexp_extract_all("stanza", F.lit(f"(?m)^{name}: *{tail}$"), F.lit(1))


def _one(name: str, tail: str = "(.*)") -> Column:
    """The first value of a tag, trimmed, or null."""
    v = F.trim(F.get(_tag(name, tail), F.lit(0)))
    return F.when(v != "", v)


def obo_terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms of hierarchy files, one row per ``[Term]`` stanza.

    Synonyms and cross references are the text between the first and last quote
    of their line; a parent counts only where its line gives its name after ``!``.
    """
    raw = spark.read.option("lineSep", "\n\n").text(path).select(F.regexp_replace("value", "\r", "").alias("stanza"))
    return raw.filter(F.col("stanza").rlike("(?m)^\\[Term\\]")).select(
        _one("id").alias("id"),
        _one("name").alias("name"),
        _tag("synonym", '[^"\\n]*"(.*)"[^"\\n]*').alias("synonyms"),
        _tag("xref", '[^"\\n]*"(.*)"[^"\\n]*').alias("xrefs"),
        F.transform(_tag("is_a", "([^!\\n]*?) *!.*"), lambda p: F.trim(p)).alias("is_a"),
        F.transform(_tag("subset"), lambda s: F.trim(F.regexp_replace(s, "[ {].*", ""))).alias("subsets"),
        F.col("stanza").rlike("(?m)^is_obsolete: *true").alias("is_obsolete"),
        _one("replaced_by").alias("replaced_by"),
        F.col("stanza").rlike("(?m)^.*attribute_slim").alias("is_attribute"),
        F.col("stanza").rlike("(?m)^.*value_slim").alias("is_value"),
    ).filter(F.col("id").isNotNull())


def obo_relations(spark: SparkSession, path: str) -> DataFrame:
    """(id, relation, target) of the ``relationship`` lines."""
    raw = spark.read.option("lineSep", "\n\n").text(path).select(F.regexp_replace("value", "\r", "").alias("stanza"))
    pairs = F.regexp_extract_all("stanza", F.lit("(?m)^relationship: *([^!\\n]*)"), F.lit(1))
    p = raw.select(_one("id").alias("id"), F.explode(pairs).alias("p")).select("id", F.split(F.trim("p"), " +").alias("p"))
    return p.select("id", F.get("p", F.lit(0)).alias("relation"), F.get("p", F.lit(1)).alias("target")).filter(F.col("target").isNotNull())


def obo_names(terms: DataFrame) -> DataFrame:
    """(name, id) of the names only."""
    return terms.select("name", "id").filter(F.col("name").isNotNull())


def obo_labels(terms: DataFrame) -> DataFrame:
    """(id, label): a row per name and synonym."""
    labels = F.concat(F.filter(F.array("name"), lambda x: x.isNotNull()), F.coalesce("synonyms", F.array().cast("array<string>")))
    return terms.select("id", F.explode(labels).alias("label"))


def flora_treatments(spark: SparkSession, path: str) -> DataFrame:
    """Treatments of marked-up floras: file and the raw inner markup of each taxon, in order."""
    rows = spark.read.format("xml").option("rowTag", "treatment").schema("taxon array<string>").load(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), "taxon")


def taxon_characters(treatments: DataFrame) -> DataFrame:
    """(file, taxon_no, feature_no, feature_class, char_no, char_class, text) of flat ``char`` elements."""
    taxa = treatments.select("file", F.posexplode("taxon").alias("taxon_no", "raw"))
    fx = F.regexp_extract_all("raw", F.lit("(?s)(<feature\\b[^>]*>.*?</feature>)"), F.lit(1))
    feats = taxa.select("file", "taxon_no", F.posexplode(fx).alias("feature_no", "fx"))
    cx = F.regexp_extract_all("fx", F.lit("(?s)(<char\\b[^>]*>.*?</char>)"), F.lit(1))
    chars = feats.select("file", "taxon_no", "feature_no", F.expr("xpath_string(fx, 'feature/@class')").alias("feature_class"), F.posexplode(cx).alias("char_no", "cx"))
    return chars.select("file", "taxon_no", "feature_no", "feature_class", "char_no", F.expr("xpath_string(cx, 'char/@class')").alias("char_class"), F.expr("xpath_string(cx, 'char')").alias("text"))


def species_list(spark: SparkSession, path: str) -> DataFrame:
    """Flat species records: the first occurrence of each element."""
    names = ["Name.family", "Name.genus", "Name.species", "infraepi", "description", "habitat"]
    schema = ", ".join(f"`{n}` array<string>" for n in names)
    rows = spark.read.format("xml").option("rowTag", "Specieslist").schema(schema).load(path)
    return rows.select(*[F.get(quoted(n), F.lit(0)).alias(n.rpartition(".")[2]) for n in names])


def pipe_descriptions(spark: SparkSession, path: str, width: int = 22) -> DataFrame:
    """Pipe-delimited records without header; missing trailing columns are null."""
    schema = ", ".join(f"_c{i} string" for i in range(width))
    return spark.read.csv(path, sep="|", schema=schema, quote="")


def csv_descriptions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with a header, read under an explicit schema."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, quote='"', escape='"')


def comma_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(term, id): first and last comma token; comments and lines of up to five characters are skipped."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.length("value") > 5))
    parts = F.transform(F.split("value", ","), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    return lines.select(parts.alias("p")).select(F.get("p", F.lit(0)).alias("term"), F.element_at("p", -1).alias("id"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Bilingual word list: English, French, French as printed."""
    return spark.read.csv(path, sep="\t", schema=schemas.LEXICON, quote="").drop("_c0")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Glossary rows: category, names and definition, trimmed, categories and names in lower case."""
    p = F.split("value", "[|]")
    col = lambda i: F.trim(F.get("p", F.lit(i)))
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("vocab_file"), p.alias("p")).filter(F.size("p") >= 4)
    return rows.select(
        "vocab_file", F.lower(col(0)).alias("category"), col(1).alias("sub1"), col(2).alias("sub2"), F.lower(col(3)).alias("names"), col(4).alias("definition")
    )


def term_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, definition, synonyms) of tab-separated term tables whose records may hold line breaks."""
    raw = spark.read.text(path, wholetext=True)
    records = F.split("value", "(?:^|\\r?\\n)(?=[A-Z]+:[0-9]+\\t)")
    rows = raw.select(F.explode(records).alias("r")).filter(F.trim("r") != "").select(F.split(F.regexp_replace("r", "\\s+$", ""), "\t").alias("p"))
    get = lambda i: F.trim(F.get("p", F.lit(i)))
    return rows.select(get(0).alias("id"), get(1).alias("label"), get(2).alias("definition"), F.filter(F.split(F.coalesce(get(3), F.lit("")), " *; *"), lambda x: x != "").alias("synonyms"))


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, quote="")


def eq_table(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, schemas.EQ)


def trait_table(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, schemas.TRAIT)


def annotation_table(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, schemas.ANNOTATION)


def environment_table(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, schemas.TAXON_ENV)


def label_table(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, schemas.LABEL)


def enrichment_results(spark: SparkSession, folder: str) -> DataFrame:
    """(group, id, sign, under, over) of ``*/groups.txt``; the group is the folder's name and rows without numbers are dropped."""
    schema = ", ".join(f"_c{i} string" for i in range(11))
    rows = spark.read.csv(f"{folder}/*/groups.txt", sep="\t", schema=schema, quote="")
    group = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/groups[.]txt(?:/[^/]+)?$", 1)
    num = lambda c: F.expr(f"try_cast(trim({c}) as double)")
    return rows.select(group.alias("group"), F.col("_c2").alias("id"), F.col("_c3").alias("sign"), num("_c9").alias("under"), num("_c10").alias("over")).filter(
        F.col("under").isNotNull() & F.col("over").isNotNull()
    )


def owl_classes(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, deprecated, parents, equivalents) of the classes of an RDF/XML document; unnamed classes are left out."""
    schema = "`_rdf:about` string, `rdfs:label` array<string>, `owl:deprecated` array<string>, `rdfs:subClassOf` array<struct<`_rdf:resource`:string>>, `owl:equivalentClass` array<struct<`_rdf:resource`:string>>"
    rows = spark.read.format("xml").option("rowTag", "owl:Class").schema(schema).load(path)
    return rows.filter(quoted("_rdf:about").isNotNull()).select(
        quoted("_rdf:about").alias("id"),
        F.get(quoted("rdfs:label"), F.lit(0)).alias("label"),
        (F.lower(F.trim(F.get(quoted("owl:deprecated"), F.lit(0)))) == "true").alias("deprecated"),
        F.filter(F.transform(quoted("rdfs:subClassOf"), lambda s: s["_rdf:resource"]), lambda x: x.isNotNull()).alias("parents"),
        F.filter(F.transform(quoted("owl:equivalentClass"), lambda s: s["_rdf:resource"]), lambda x: x.isNotNull()).alias("equivalents"),
    )
