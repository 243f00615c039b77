"""Evaluation texts inside training text: documents that hold passages of test items.

A passage leaks if ``span`` or more consecutive words of an item stand
consecutively in a document. The search is a size-partitioned MinHash
containment search. Every window of ``span`` words has a signature: for each of
``hashes`` hash functions the least hash of its ``k``-word shingles. Neighbouring
windows mostly share it, so a text has few distinct signatures; they are its
sketch. Items are partitioned by size: a partition holds items of up to twice
the words of the one before, and is searched with document segments of twice its
upper size that overlap by half, so any passage of an item lies within one
segment. The containment of the item in a segment is estimated as the share of
the item's signatures that stand there. A single leaked passage is a smaller part
of a long item than of a short one, so each partition has its own least
containment: that of one passage in its largest item. ``least`` asks for more.

Equal windows have equal signatures, so the search loses no passage whatever the
number of hashes; more of them only keep out chance hits. What passes is verified
by exact containment of ``span``-word shingles.

The sketch of the items stays a table. All that is broadcast are two bitmaps of
at most ``MOST_SLOTS`` slots: of the items' words and of their signatures. They
let a document skip all windows that can't be in any item; a hit in them by
chance costs work, never a row. Documents are read once and are not shuffled,
only their few surviving windows are.

Defined results: one row per distinct pair; null and empty texts hold nothing; an
item shorter than ``span`` words has no passages; whole texts are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.session import cut
from sylva.tables import inputs, kinds

_WORDS = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
MOST_SLOTS = 1 << 26
_KEPT_WORDS = 500_000  # hashes of words a task keeps at hand


def words(text: str) -> list[str]:
    """Runs of letters or digits, without case and accents."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORDS.findall(text.casefold())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(found: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64)


def signatures(ids: np.ndarray, span: int, k: int, hashes: int) -> np.ndarray:
    """[window, hash function]: the MinHash over the ``k``-word shingles of each window of ``span`` words."""
    h = np.zeros(len(ids) - k + 1, np.uint64)
    out = np.empty((len(ids) - span + 1, hashes), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * _MIX + ids[i : i + len(h)]
        for j in range(hashes):
            g = _mixed(h + np.uint64(j + 1) * _MIX)
            out[:, j] = np.lib.stride_tricks.sliding_window_view(g, span - k + 1).min(axis=1)
    return out


def _one(sigs: np.ndarray) -> np.ndarray:
    """One key for each signature."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(sigs), np.uint64)
        for j in range(sigs.shape[1]):
            h = _mixed(h * _MIX + sigs[:, j])
    return h


def size_class(n_words: int, span: int) -> int:
    """0 for items of up to 2 ``span`` words, then one more for each doubling."""
    return max(0, (max(n_words, 1) - 1) // span).bit_length() - (n_words > span)


def upper_size(klass: int, span: int) -> int:
    return span << (klass + 1)


def item_sketch(items: DataFrame, span: int, k: int, hashes: int) -> DataFrame:
    """(item, klass, n_sigs, sig, passage): a row per window of each item. ``items``: item, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, klass, many, sig, passage = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(text or "")
                if len(found) < span:
                    continue
                own = _one(signatures(word_hashes(found), span, k, hashes)).astype(np.int64).tolist()
                n, c = len(set(own)), size_class(len(found), span)
                for w, s in enumerate(own):
                    item.append(i)
                    klass.append(c)
                    many.append(n)
                    sig.append(s)
                    passage.append(" ".join(found[w : w + span]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), pa.array(klass, pa.int32()), pa.array(many, pa.int32()), pa.array(sig, pa.int64()), pa.array(passage, pa.string())],
                names=["item", "klass", "n_sigs", "sig", "passage"],
            )

    return items.mapInArrow(run, "item long, klass int, n_sigs int, sig long, passage string")


def _bitmap(slots: DataFrame, size: int) -> np.ndarray:
    """The slots of a one-column table as a mask; at most ``size`` rows come back."""
    out = np.zeros(size, bool)
    got = slots.distinct().toArrow().column(0).to_numpy()
    out[got] = True
    return out


def _size(n: int) -> int:
    """A power of two with at least 16 slots a key, within the bound."""
    return min(MOST_SLOTS, 1 << max(12, (16 * max(n, 1) - 1).bit_length()))


def survivors(documents: DataFrame, known: np.ndarray, marked: np.ndarray, span: int, k: int, hashes: int) -> DataFrame:
    """(doc, at, sig, passage): the windows of the documents whose words and signature may be an item's. Narrow."""
    schema = T.StructType([
        T.StructField("doc", documents.schema.fields[0].dataType), T.StructField("at", T.IntegerType()), T.StructField("sig", T.LongType()), T.StructField("passage", T.StringType())
    ])
    sent = documents.sparkSession.sparkContext.broadcast((known, marked))  # two masks of at most MOST_SLOTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word, by_sig = sent.value
        word_mask, sig_mask = len(by_word) - 1, np.uint64(len(by_sig) - 1)
        memo: dict[str, int] = {}

        def hashed(w: str) -> int:
            """The hash of a word that an item may hold, else 0."""
            h = xxhash.xxh3_64_intdigest(w)
            h = h if by_word[h & word_mask] else 0
            if len(memo) < _KEPT_WORDS:
                memo[w] = h
            return h

        for batch in batches:
            rows, at, sig, passage = [], [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                found = words(text)
                if len(found) < span:
                    continue
                ids = np.array([h if (h := memo.get(w)) is not None else hashed(w) for w in found], np.uint64)
                # Only runs of words that items hold can be a passage.
                edges = np.flatnonzero(np.diff(np.concatenate(([False], ids != 0, [False])).astype(np.int8)))
                for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    if z - a < span:
                        continue
                    own = _one(signatures(ids[a:z], span, k, hashes))
                    for w in np.flatnonzero(by_sig[own & sig_mask]).tolist():
                        rows.append(r)
                        at.append(a + w)
                        sig.append(int(own[w].astype(np.int64)))
                        passage.append(" ".join(found[a + w : a + w + span]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(sig, pa.int64()), pa.array(passage, pa.string())], names=schema.fieldNames()
            )

    return documents.mapInArrow(run, schema)


def find_leaks(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    span: int = 12, k: int = 5, hashes: int = 3, least: float = 0.0,
) -> DataFrame:
    """(doc_id, item_id, containment) for each document that holds a passage of an item.

    ``containment``: the largest estimate over the document's segments. ``least``: the least
    containment asked for, where it is more than one passage gives.
    """
    given = inputs(items, [item_id], [item_text]).select(F.col("k0").cast("bigint").alias("item"), F.col("t0").alias("words"))
    sketch = cut(item_sketch(given, span, k, hashes))
    kind = kinds(documents, [doc_id])[doc_id]
    source = inputs(documents, [doc_id], [text]).filter("t0 is not null").select(F.col("k0").cast(kind).alias("doc"), "t0")
    n = sketch.count()
    by_word, by_sig = _size(4 * n), _size(n)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {w for p in batch.column(0).to_pylist() for w in p.split(" ")}
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(w) & (by_word - 1) for w in found], pa.int64())], names=["slot"])

    known = _bitmap(sketch.select("passage").mapInArrow(slots, "slot long"), by_word)
    marked = _bitmap(sketch.select(F.col("sig").bitwiseAND(F.lit(by_sig - 1)).alias("slot")), by_sig)
    near = survivors(source, known, marked, span, k, hashes)
    hit = near.join(sketch.withColumnRenamed("passage", "_own"), "sig")
    # Each place lies in two of the overlapping segments of the item's partition.
    upper = F.shiftleft(F.lit(span), 1) * F.pow(F.lit(2), F.col("klass")).cast("int")
    place = F.floor(F.col("at") / upper)
    seen = hit.select("doc", "item", "klass", "n_sigs", "sig", (F.col("passage") == F.col("_own")).alias("exact"), F.explode(F.array(place - 1, place)).alias("segment"))
    judged = seen.groupBy("doc", "item", "klass", "n_sigs", "segment").agg(F.count_distinct("sig").alias("shared"), F.bool_or("exact").alias("exact"))
    one_passage = F.lit(1.0) / (upper - span + 1)
    kept = judged.withColumn("containment", F.col("shared") / F.col("n_sigs")).filter((F.col("containment") >= F.greatest(one_passage, F.lit(least))) & F.col("exact"))
    return kept.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(F.round(F.max("containment"), 6).alias("containment"))
