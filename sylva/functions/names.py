"""Names, identifiers and small text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def curie(iri: Column) -> Column:
    """Identifier of the form ``PREFIX:number`` from an IRI."""
    return F.replace(F.regexp_replace(iri, "^.*[/#]|[<>]", ""), F.lit("_"), F.lit(":"))


def strip_iri(iri: Column) -> Column:
    """What follows the last slash or hash, without angle brackets."""
    return F.regexp_replace(F.regexp_replace(iri, "[<>]", ""), "^.*[/#]", "")


def iri_of(identifier: Column, base: str) -> Column:
    return F.concat(F.lit(base), F.replace(identifier, F.lit(":"), F.lit("_")))


def singular(c: Column) -> Column:
    """Plain singular of a character class: ``leaves`` is ``leaf``, one trailing s is dropped."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("leaves"), F.lit("leaf")), "s$", "")


def without_index(c: Column) -> Column:
    """A vertex label without its ``-number`` suffix."""
    return F.regexp_replace(c, "-[^-]*$", "")


def filled(c: Column) -> Column:
    """Neither null nor empty."""
    return c.isNotNull() & (c != "")


def kind_of(identifier: Column, prefixes: dict[str, str]) -> Column:
    """``kind`` by identifier prefix; null for none."""
    out = F.lit(None).cast("string")
    for prefix, kind in prefixes.items():
        out = F.when(identifier.startswith(prefix), F.lit(kind)).otherwise(out)
    return out


def rank_string(pairs: list[tuple[str, Column]], author: Column | None = None, year: Column | None = None) -> Column:
    """``rank: value; `` for each rank that is there, then author and year."""
    parts = [F.when(filled(c), F.concat(F.lit(f"{name}: "), c, F.lit("; "))).otherwise(F.lit("")) for name, c in pairs]
    tail = F.concat_ws("; ", *[F.when(filled(c), c) for c in (author, year) if c is not None]) if author is not None or year is not None else F.lit("")
    return F.concat(*parts, tail)


def name_template(*pairs: tuple[str, Column]) -> Column:
    """``Label: value, Label: value`` with ``null`` for what is missing."""
    bits: list[Column] = []
    for i, (label, c) in enumerate(pairs):
        bits += [F.lit((", " if i else "") + label + ": "), F.coalesce(c, F.lit("null"))]
    return F.concat(*bits)


def symbol(rank: Column) -> Column:
    """Character-state symbol of a rank from 1: A to Z, then a to z; more than 52 states are an error."""
    return (
        F.when(rank <= 26, F.char(rank + 64))
        .when(rank <= 52, F.char(rank + 70))
        .otherwise(F.raise_error(F.lit("more than 52 states in one character")).cast("string"))
    )
