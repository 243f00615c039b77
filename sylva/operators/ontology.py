"""Phenotype classes derived from entity-quality facts, their annotations and axioms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str], prefix: str, column: str) -> DataFrame:
    """Identifiers ``prefix + n`` in a fixed order. For class tables, bounded by the term lists; never for facts."""
    return df.withColumn(column, F.concat(F.lit(prefix), F.row_number().over(Window.orderBy(*order)).cast("string")))


def known_pairs(eq: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs whose two identifiers exist as terms that aren't obsolete."""
    live = terms.filter(~F.coalesce("is_obsolete", F.lit(False))).select("id").distinct()
    e = live.select(F.col("id").alias("e_id"))
    q = live.select(F.col("id").alias("q_id"))
    return eq.join(e, "e_id", "left_semi").join(q, "q_id", "left_semi")


def phenotype_classes(eq: DataFrame, names: DataFrame, traits: DataFrame | None = None) -> DataFrame:
    """(e, q, kind, label): a class per entity, per pair and, with ``traits`` (q_id, trait), per
    entity and nearest trait, unless that pair is a class already.

    ``names``: id, name.
    """
    n = names.select("id", "name")
    en = n.select(F.col("id").alias("e"), F.col("name").alias("_en"))
    qn = n.select(F.col("id").alias("q"), F.col("name").alias("_qn"))
    pairs = eq.select(F.col("e_id").alias("e"), F.col("q_id").alias("q")).distinct()
    entities = pairs.select("e").distinct().select("e", F.lit(None).cast("string").alias("q"), F.lit("entity").alias("kind"))
    out = entities.unionByName(pairs.withColumn("kind", F.lit("eq")))
    if traits is not None:
        made = pairs.join(traits.select(F.col("q_id").alias("q"), "trait"), "q").select("e", F.col("trait").alias("q")).distinct()
        out = out.unionByName(made.join(pairs, ["e", "q"], "left_anti").withColumn("kind", F.lit("trait")))
    labelled = out.join(en, "e", "left").join(qn, "q", "left")
    label = F.concat(F.coalesce("_en", F.col("e")), F.lit(" "), F.when(F.col("kind") == "entity", F.lit("phenotype")).otherwise(F.coalesce("_qn", F.col("q"))))
    return labelled.select("e", "q", "kind", label.alias("label"))


def annotations(eq: DataFrame, classes: DataFrame) -> DataFrame:
    """(taxon, class_id) for each fact, by entity and quality."""
    c = classes.filter(F.col("q").isNotNull()).select(F.col("e").alias("e_id"), F.col("q").alias("q_id"), "class_id")
    return eq.select("taxon", "e_id", "q_id").distinct().join(c, ["e_id", "q_id"]).select("taxon", "class_id").distinct()


def taxon_intersections(annotated: DataFrame) -> DataFrame:
    """(taxon, classes): taxa with more than one class, as the intersection of their classes."""
    g = annotated.groupBy("taxon").agg(F.array_sort(F.collect_set("class_id")).alias("classes"))
    return g.filter(F.size("classes") > 1)


def unsatisfiable(classes: DataFrame, closure: DataFrame, seed: str) -> DataFrame:
    """Classes whose quality lies below ``seed`` (or is it): they can't have instances."""
    below = closure.filter(F.col("ancestor") == seed).select(F.col("child").alias("q")).unionByName(classes.sparkSession.createDataFrame([(seed,)], "q string"))
    return classes.join(below.distinct(), "q", "left_semi")


def deprecate(classes: DataFrame, bad: DataFrame) -> DataFrame:
    """Every class with ``deprecated``; a deprecated class has no equivalence."""
    marks = bad.select("class_id").distinct().withColumn("deprecated", F.lit(True))
    return classes.join(marks, "class_id", "left").withColumn("deprecated", F.coalesce("deprecated", F.lit(False)))


def axioms(classes: DataFrame, base: str, root: str = "ROOT", has_part: str = "has-part", part_of: str = "part-of", has_quality: str = "has-quality", any_quality: str = "QUALITY") -> DataFrame:
    """(ord, axiom) lines in functional syntax: property axioms, then for each class its declaration,
    parent, equivalence (unless deprecated), label and deprecation."""
    spark = classes.sparkSession
    iri = lambda c: F.concat(F.lit(f"<{base}"), F.replace(c, F.lit(":"), F.lit("_")), F.lit(">"))
    fixed = [f"TransitiveObjectProperty(<{base}{p}>)" for p in (has_part, part_of)] + [f"ReflexiveObjectProperty(<{base}{p}>)" for p in (has_part, part_of)]
    head = spark.createDataFrame([(i, a) for i, a in enumerate(fixed)], "ord long, axiom string")
    c, e = iri(F.col("class_id")), iri(F.col("e"))
    part = lambda x: F.concat(F.lit(f"ObjectSomeValuesFrom(<{base}{has_part}> "), x, F.lit(")"))
    some = lambda x: F.concat(F.lit(f"ObjectSomeValuesFrom(<{base}{has_quality}> "), x, F.lit(")"))
    whole = F.concat(F.lit("ObjectIntersectionOf("), F.lit(f"ObjectSomeValuesFrom(<{base}{part_of}> "), e, F.lit(") "), some(F.lit(f"<{base}{any_quality}>")), F.lit(")"))
    pair = F.concat(F.lit("ObjectIntersectionOf("), e, F.lit(" "), some(iri(F.coalesce("q", F.lit("")))), F.lit(")"))
    body = F.when(F.col("kind") == "entity", part(whole)).otherwise(part(pair))
    dep = F.coalesce(F.col("deprecated"), F.lit(False)) if "deprecated" in classes.columns else F.lit(False)
    lines = F.array(
        F.concat(F.lit("Declaration(Class("), c, F.lit("))")),
        F.concat(F.lit("SubClassOf("), c, F.lit(f" <{base}{root}>)")),
        F.when(~dep, F.concat(F.lit("EquivalentClasses("), c, F.lit(" "), body, F.lit(")"))),
        F.concat(F.lit("AnnotationAssertion(rdfs:label "), c, F.lit(' "'), F.replace("label", F.lit('"'), F.lit("'")), F.lit('")')),
        F.when(dep, F.concat(F.lit("AnnotationAssertion(owl:deprecated "), c, F.lit(' "true"^^xsd:boolean)'))),
    )
    number = F.regexp_extract("class_id", "([0-9]+)$", 1).cast("long")
    rows = classes.select(number.alias("n"), F.posexplode(lines).alias("k", "axiom")).filter(F.col("axiom").isNotNull())
    return head.unionByName(rows.select((F.col("n") * 10 + F.col("k") + 100).alias("ord"), "axiom"))


def labels(axiom_classes: DataFrame) -> DataFrame:
    return axiom_classes.select(F.col("class_id").alias("id"), "label").filter(F.col("label").isNotNull())
