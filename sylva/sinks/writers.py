"""Writers of tables and text documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_index(df: DataFrame, path: str, *partition_by: str) -> None:
    """A table written anew; each table has one writer, so none empties another's."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def as_lines(df: DataFrame, null: str = "null") -> DataFrame:
    """Rows as tab-separated lines, nulls printed as ``null``."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null)) for c in df.columns]).alias("value"))


def write_tsv(df: DataFrame, path: str) -> None:
    as_lines(df).write.mode("overwrite").text(path)


def write_per_key(df: DataFrame, key: str, path: str) -> None:
    """One folder of tab-separated lines per value of ``key``."""
    rest = [c for c in df.columns if c != key]
    lines = df.select(key, F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in rest]).alias("value"))
    lines.repartition(key).write.mode("overwrite").partitionBy(key).text(path)


def write_document(lines: DataFrame, path: str) -> None:
    """Lines (``ord``, ``line``) as one ordered text document."""
    lines.repartitionByRange("ord").sortWithinPartitions("ord").select("line").write.mode("overwrite").text(path)


def owl_document(axioms: DataFrame, iri: str) -> DataFrame:
    """(ord, line) of an ontology in functional syntax from (ord, axiom) rows."""
    spark = axioms.sparkSession
    head = spark.createDataFrame([(-1, f"Ontology(<{iri}>")], "ord long, line string")
    foot = spark.createDataFrame([(2**62, ")")], "ord long, line string")
    return head.unionByName(axioms.select(F.col("ord").cast("long").alias("ord"), F.col("axiom").alias("line"))).unionByName(foot)


def write_raw(df: DataFrame, path: str, separator: str = "\n") -> None:
    """A one-column table as text; records may hold line breaks of their own."""
    df.select(F.col(f"`{df.columns[0]}`").cast("string").alias("value")).write.mode("overwrite").option("lineSep", separator).text(path)


def write_elements(df: DataFrame, path: str, root: str, attributes: str = "") -> None:
    """A one-column table of XML elements as documents, one per task, each under a root of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            values = [v for v in batch.column(0).to_pylist() if v is not None]
            if first and values:
                values.insert(0, f"<{root}{attributes}>")
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array([f"</{root}>"])], names=["value"])

    write_raw(df.select(F.col(f"`{df.columns[0]}`").cast("string").alias("value")).mapInArrow(run, "value string"), path)


def write_obo(terms: DataFrame, path: str) -> None:
    """Term stanzas, parted by blank lines. ``terms``: id, name, synonyms, xrefs, is_a, subsets, is_obsolete, replaced_by."""
    lines = lambda c, make: F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), make), "")
    stanza = F.concat(
        F.lit("[Term]\nid: "), "id", F.concat(F.lit("\nname: "), F.coalesce("name", F.lit(""))),
        lines("synonyms", lambda x: F.concat(F.lit('\nsynonym: "'), x, F.lit('" EXACT []'))),
        lines("xrefs", lambda x: F.concat(F.lit('\nxref: X:1 "'), x, F.lit('"'))),
        lines("is_a", lambda x: F.concat(F.lit("\nis_a: "), x, F.lit(" ! parent"))),
        lines("is_a", lambda x: F.concat(F.lit("\nrelationship: part_of "), x, F.lit(" ! parent"))),
        lines("subsets", lambda x: F.concat(F.lit("\nsubset: "), x)),
        F.when(F.col("is_obsolete"), F.lit("\nis_obsolete: true")).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit("\nreplaced_by: "), "replaced_by"), F.lit("")),
    )
    write_raw(terms.select(stanza), path, "\n\n")


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_record(tag: str, values: dict[str, Column]) -> Column:
    """A flat element with one child for each value that isn't null."""
    kids = [F.coalesce(F.concat(F.lit(f"<{t}>"), _escaped(c), F.lit(f"</{t}>")), F.lit("")) for t, c in values.items()]
    return F.concat(F.lit(f"<{tag}>"), *kids, F.lit(f"</{tag}>"))


def rdf_classes(terms: DataFrame, base: str) -> DataFrame:
    """Classes as RDF/XML elements: label, parents, deprecation, and the replacement as an equivalent class."""
    iri = lambda c: F.concat(F.lit(base), F.replace(c, F.lit(":"), F.lit("_")))
    parents = F.array_join(F.transform("is_a", lambda p: F.concat(F.lit('<rdfs:subClassOf rdf:resource="'), iri(p), F.lit('"/>'))), "")
    return terms.select(F.concat(
        F.lit('<owl:Class rdf:about="'), iri(F.col("id")), F.lit('"><rdfs:label>'), _escaped(F.col("name")), F.lit("</rdfs:label>"), parents,
        F.coalesce(F.concat(F.lit('<owl:equivalentClass rdf:resource="'), iri(F.col("replaced_by")), F.lit('"/>')), F.lit("")),
        F.when(F.col("is_obsolete"), F.lit("<owl:deprecated>true</owl:deprecated>")).otherwise(F.lit("")), F.lit("</owl:Class>"),
    ))
