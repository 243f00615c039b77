"""Tokens, sentences and clauses as column expressions that run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The usual 33 English stop words of text search.
STOP_EN = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
#: French function words.
STOP_FR = "au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma mais me même mes mon ne nos notre nous on ou où par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous est sont".split()
#: Elided articles and pronouns.
ELISION = "(^|[^\\p{L}])(?:l|m|t|qu|n|s|j|d|c|jusqu|quoiqu|lorsqu|puisqu)['’]"


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(" \u00a0"))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))


def content_tokens(c: Column, stop: list[str]) -> Column:
    """(pos, term) of the tokens that are no stop words; positions count every token."""
    placed = F.transform(tokens(c), lambda t, i: F.struct(i.alias("pos"), t.alias("term")))
    return F.filter(placed, lambda x: ~x["term"].isin(stop))


def french_stem(t: Column) -> Column:
    """Minimal French stem: plural, feminine and infinitive endings of words of six letters or more."""
    cut = F.when(t.rlike("aux$"), F.regexp_replace(t, "aux$", "al")).otherwise(F.regexp_replace(t, "x$", ""))
    tail = t
    for end in ("s$", "r$", "e$", "é$"):
        tail = F.regexp_replace(tail, end, "")
    tail = F.regexp_replace(tail, "(.)\\1$", "$1")
    return F.when(F.length(t) < 6, t).when(t.endswith("x"), cut).otherwise(tail)


def french_tokens(c: Column) -> Column:
    """Tokens without elided articles and stop words, stemmed."""
    plain = F.regexp_replace(F.lower(c), ELISION, "$1")
    kept = F.filter(tokens(plain), lambda t: ~t.isin(STOP_FR))
    return F.transform(kept, french_stem)


def sentence_pieces(c: Column) -> Column:
    """Pieces between end marks followed by blanks, or line breaks; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, "[.!?]\\s+|\\n+"), _trim), lambda x: x != "")


def clauses(c: Column, mark: str = ";") -> Column:
    """Clauses of a sentence, trimmed, without empty ones; ``mark`` is a regular expression."""
    return F.filter(F.transform(F.split(c, mark), _trim), lambda x: x != "")


def first_clause(c: Column, mark: str = ";") -> Column:
    return _trim(F.get(F.split(c, mark), F.lit(0)))


def measurement_spans(c: Column) -> Column:
    """Number ranges with a metric unit, as written."""
    return F.regexp_extract_all(c, F.lit("([0-9]+(?:[.,][0-9]+)?(?:\\s?[-–]\\s?[0-9]+(?:[.,][0-9]+)?)?\\s?(?:mm|cm|dm|m))\\b"), F.lit(1))
