"""Free-entered values mapped to the entry of a reference list they mean.

Token-level repair. Values are cut into tokens (letter case, accents, word
order, connecting words, punctuation and bracketed remarks don't count); each
distinct token is joined to the tokens of the reference list by edit distance.
The join runs on keys: deletion variants for misspellings, stems for plurals,
prefixes and consonant skeletons for abbreviations; the exact similarity is
then computed for each joined pair. Corrected tokens are combined with soft
TF-IDF, which ranks the complete entries that hold them.

An entry is acceptable if the tokens of value and entry pair off one to one
without rest. That makes one token of the value enough to find all acceptable
entries: each value looks up entries by its most selective token only, and
loses none. No part is broadcast by hand; the reference list is joined.

Defined results: null and blank values are left out; a value that means no
entry, or only an obsolete one without replacement, gets ``unmatched``; equal
scores are settled by entry text, then identifier.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.session import cut
from sylva.tables import inputs, pick

#: Connecting words that carry no meaning of their own, and abbreviations no rule gives.
STOP = frozenset("of the a an in for and".split())
SHORT = {"no": "number", "nr": "number", "qty": "quantity", "wt": "weight"}

_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-Z][a-zà-ÿ])")
_BRACKETS = re.compile(r"[(\[{][^()\[\]{}]*[)\]}]")
_VOWELS = re.compile("[aeiouy]")


def tokens(value: str) -> list[str]:
    """The tokens of a value, in order."""
    v = _CAMEL.sub(" ", _BRACKETS.sub(" ", value))
    v = "".join(c for c in unicodedata.normalize("NFKD", v.lower()) if not unicodedata.combining(c))
    found = re.findall(r"[^\W_]+", v)
    kept = [t for t in found if t not in STOP]
    return kept or found


def stem(t: str) -> str:
    if len(t) > 4 and t.endswith("ies"):
        return t[:-3] + "y"
    if len(t) > 4 and t.endswith("ves"):
        return t[:-3] + "f"
    return t[:-1] if len(t) > 2 and t.endswith("s") and not t.endswith("ss") else t


def skeleton(t: str) -> str:
    return t[:1] + _VOWELS.sub("", t[1:])


def is_code(t: str) -> bool:
    """Codes (no vowel, or with digits) are compared exactly."""
    return not _VOWELS.search(t) or any(c.isdigit() for c in t)


def edits(t: str) -> int:
    return 0 if len(t) < 4 else 1 if len(t) < 6 else 2


def _deletions(t: str, k: int) -> set[str]:
    out, layer = {t}, {t}
    for _ in range(k):
        layer = {s[:i] + s[i + 1 :] for s in layer for i in range(len(s))}
        out |= layer
    return out


def keys(t: str, reference: bool) -> set[str]:
    """Join keys: a pair that may be similar shares at least one."""
    out = {"=" + t, "=" + stem(t)}
    if reference and is_code(t):
        return {"=" + t}
    if not is_code(t):
        out |= {"d" + s for s in _deletions(t, 2 if len(t) >= 5 else 1)}
        out |= {"d" + s for s in _deletions(stem(t), 1)}
    if reference:
        out |= {"p" + t[:i] for i in range(2, len(t))}
        k = skeleton(t)
        out |= {"k" + s for s in (_deletions(k, 1) if len(k) >= 4 else {k})}
    else:
        out |= {"p" + t}
        if len(t) >= 2:
            out |= {"k" + s for s in (_deletions(skeleton(t), 1) if len(t) >= 4 else {skeleton(t)})}
        if t in SHORT:
            out.add("=" + SHORT[t])
    return out


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; ``most + 1`` if larger than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def similarity(t: str, ref: str) -> float:
    """How well a typed token may stand for a reference token; 0 if it may not."""
    if t == ref:
        return 1.0
    if is_code(ref):
        return 0.0
    if stem(t) == ref or stem(t) == stem(ref):
        return 0.98
    if SHORT.get(t) == ref:
        return 0.95
    best = 0.0
    if not is_code(t) or len(t) > 5:
        most = edits(ref)
        if most:
            for form in {t, stem(t)}:
                d = osa(form, ref, most)
                if d <= most:
                    best = max(best, 1.0 - d / max(len(form), len(ref)) - (0.02 if form != t else 0.0))
    cut = len(ref) - len(t)
    if cut > 0 and len(t) >= 2 and ref.startswith(t):
        best = max(best, 0.88 if cut >= 3 else 0.8)
    elif cut > 0 and len(t) >= 2 and t[0] == ref[0] and is_code(t):
        k, own = skeleton(ref), skeleton(t)
        if own == k:
            best = max(best, 0.86)
        elif len(own) >= 3 and len(k) >= 4 and osa(own, k, 1) <= 1:
            best = max(best, 0.8)
    return best


def pair_off(candidates: list[dict[str, float]], entry: list[str], weight: dict[str, float]) -> float:
    """Soft TF-IDF of the best one-to-one pairing of value tokens and entry tokens; 0 if tokens are left."""
    if len(candidates) != len(entry):
        return 0.0
    norm = sum(weight[e] ** 2 for e in entry)

    def best(i: int, left: list[str]) -> float:
        if i == len(candidates):
            return 0.0
        top = -1.0
        for e in set(left):
            s = candidates[i].get(e)
            if s is not None:
                rest = list(left)
                rest.remove(e)
                tail = best(i + 1, rest)
                if tail >= 0:
                    top = max(top, s * weight[e] ** 2 + tail)
        return top

    total = best(0, list(entry))
    return total / norm if total > 0 else 0.0


def _keys_of(tokens_df: DataFrame, reference: bool) -> DataFrame:
    name = "ref" if reference else "tok"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for t in batch.column(0).to_pylist():
                for k in keys(t, reference):
                    a.append(t)
                    b.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=[name, "key"])

    return tokens_df.mapInArrow(run, f"{name} string, key string")


def _tokenised(df: DataFrame, column: str, out: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vals = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tokens(v) for v in vals], pa.list_(pa.string()))], names=[column, out])

    return df.select(column).mapInArrow(run, f"{column} string, {out} array<string>")


def reference_entries(terms: DataFrame) -> DataFrame:
    """(entry, goal): each name and synonym with the term it leads to; null for a term without replacement."""
    goal = F.when(F.coalesce(F.col("is_obsolete"), F.lit(False)), F.col("replaced_by")).otherwise(F.col("term_id"))
    terms = pick(terms, ["term_id", "name", "synonyms", "is_obsolete", "replaced_by"])
    texts = F.concat(F.array("name"), F.coalesce(F.col("synonyms"), F.array().cast("array<string>")))
    return terms.select(F.explode(texts).alias("entry"), goal.alias("goal")).filter(F.trim("entry") != "").distinct()


def map_to_list(values: DataFrame, column: str, entries: DataFrame, threshold: float = 0.72, margin: float = 0.12, unmatched: str = "NONE") -> DataFrame:
    """(value, goal, score) for each distinct non-blank value of ``column``.

    ``entries``: columns ``entry`` and ``goal``. ``threshold``: least soft TF-IDF; ``margin``: how far below a token's best
    similarity other repairs of it stay in play.
    """
    entries = pick(entries, ["entry", "goal"])
    v = inputs(values, [], [column]).select(F.col("t0").alias("value")).filter(F.trim(F.regexp_replace("value", "\\s+", " ")) != "").distinct()
    everything = cut(_tokenised(v, "value", "toks"))  # read four times below
    typed = everything.filter(F.size("toks") > 0)
    refs = _tokenised(entries.select("entry").distinct(), "entry", "etoks").filter(F.size("etoks") > 0)
    df_ref = refs.select(F.explode(F.array_distinct("etoks")).alias("ref")).groupBy("ref").agg(F.count("*").alias("df"))
    n_ref = max(refs.count(), 1)
    vocabulary = df_ref.select("ref", "df", (F.lit(1.0) + F.log(F.lit(n_ref) / F.col("df"))).alias("w"))

    distinct_tokens = typed.select(F.explode("toks").alias("tok")).distinct()
    near = _keys_of(distinct_tokens, False).join(_keys_of(vocabulary.select("ref"), True), "key").select("tok", "ref").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, r = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(a, b, s) for a, b in zip(t, r, strict=True) if (s := similarity(a, b)) > 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in rows], ty) for i, ty in enumerate((pa.string(), pa.string(), pa.float64()))], names=["tok", "ref", "sim"]
            )

    repaired = near.mapInArrow(verify, "tok string, ref string, sim double").join(vocabulary, "ref")
    # A token that is in the list, or a plural of one, is no misspelling of another; others keep repairs near their best.
    top = F.max("sim").over(Window.partitionBy("tok"))
    repaired = repaired.withColumn("top", top).filter((F.col("top") < 0.97) & (F.col("sim") >= F.col("top") - margin) | (F.col("sim") >= 0.97))
    by_token = repaired.groupBy("tok").agg(F.collect_list(F.struct("ref", "sim", "w", "df")).alias("cands"), F.sum("df").alias("reach"))

    # Every token needs a repair; the one whose repairs reach the fewest entries finds them.
    places = typed.select("value", F.size("toks").alias("n_tok"), F.posexplode("toks").alias("place", "tok"))
    known = places.join(by_token, "tok").groupBy("value", "n_tok").agg(
        F.collect_list(F.struct("place", "cands")).alias("all"), F.min(F.struct("reach", "place", "cands")).alias("pivot")
    )
    complete = known.filter(F.size("all") == F.col("n_tok"))
    probes = complete.select("value", "n_tok", "all", F.explode(F.col("pivot.cands.ref")).alias("ref"))
    index = refs.select("entry", "etoks", F.size("etoks").alias("n_tok"), F.explode(F.array_distinct("etoks")).alias("ref"))
    found = probes.join(index, ["ref", "n_tok"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, everything, entry, etoks = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for v1, places1, e1, t1 in zip(value, everything, entry, etoks, strict=True):
                cands = [{c["ref"]: c["sim"] for c in p["cands"]} for p in places1]
                weight = {c["ref"]: c["w"] for p in places1 for c in p["cands"]}
                if all(t in weight for t in t1) and (s := pair_off(cands, t1, weight)) >= threshold:
                    out.append((v1, e1, s))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], ty) for i, ty in enumerate((pa.string(), pa.string(), pa.float64()))], names=["value", "entry", "score"]
            )

    ranked = found.select("value", "all", "entry", "etoks").mapInArrow(score, "value string, entry string, score double")
    goals = entries.groupBy("entry").agg(F.min("goal").alias("goal"))
    best = (
        ranked.join(goals, "entry")
        .groupBy("value")
        .agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "entry", "goal")).alias("b"))
        .select("value", F.col("b.goal").alias("goal"), (-F.col("b.s")).alias("score"))
    )
    return everything.join(best, "value", "left").select("value", F.coalesce("goal", F.lit(unmatched)).alias("goal"), "score")

