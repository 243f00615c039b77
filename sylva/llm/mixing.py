"""Sources mixed to target shares of tokens, small ones repeated up to a cap, in curriculum order.

Tokens are counted once per document with a public tokenizer whose path is a
parameter. A text that stands in several documents is used through its
smallest id only, so that no text exceeds its cap. The total is the largest at
which every source that has text reaches its share; with a larger
``total_tokens`` sources are used up to their caps and fall short, which the
report shows.

Every source has a weight schedule over training time t in [0, 1],
``share * (1 + ramp * (2t - 1))``; the ramps sum to zero over the shares, so the
weights sum to the same at any time and each integrates to its share. The
integral ``share * (t + ramp * (t^2 - t))`` is the source's cumulative token
demand. Inverting it at the cumulative tokens of each use of a document gives
the use its training position; a range sort by position is the training order.

Cumulative sums run in two levels: totals of hash blocks of bounded size, then
sums inside each block, so that a source with a third of all rows never meets
one task.

Defined results: null sources and sources without a target are left out, also
null and empty texts; a source without text has actual share 0; source names
match ignoring case, outer blanks and blank against underscore.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.session import cut
from sylva.tables import pick

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Where the vocabulary lies unless another path is given.
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def source_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, "[_\\s]+", " ")))


def count_tokens(df: DataFrame, text: str, keep: list[str], tokenizer: str) -> DataFrame:
    """``keep`` and ``n_tokens`` of every row with a non-empty text."""
    types = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField(k, types[k]) for k in keep] + [T.StructField("n_tokens", T.LongType())])
    width = len(keep)
    # The vocabulary goes to every executor with the job, so the path need only exist where the job is started.
    df.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(t) for t in enc.encode_ordinary_batch(batch.column(width).to_pylist(), num_threads=1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(width)], pa.array(n, pa.int64())], names=schema.fieldNames())

    return df.filter(F.length(text) > 0).select(*keep, text).mapInArrow(run, schema)


def _usable(documents: DataFrame, targets: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, n_tokens): one document per distinct text of the wanted sources."""
    documents, targets = pick(documents, ["doc_id", "source", "text"]), pick(targets, ["source", "target_share", "max_repeats"])
    wanted = targets.select(source_key(F.col("source")).alias("key"), F.col("source").alias("name")).groupBy("key").agg(F.min("name").alias("name"))
    rows = documents.select("doc_id", source_key(F.col("source")).alias("key"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    rows = rows.join(wanted, "key").select("doc_id", F.col("name").alias("source"), "text", F.sha2("text", 256).alias("digest"))
    # Copies are counted too: telling them apart first would move whole texts, this moves digests and counts.
    counted = count_tokens(rows, "text", ["doc_id", "source", "digest"], tokenizer)
    return counted.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("d")).select("d.*")


class Plan:
    """What each source is to give: computed from one row per source."""

    def __init__(self, documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, total_tokens: int | None = None, slope: float = 0.8) -> None:
        self.docs = cut(_usable(documents, targets, tokenizer or DEFAULT_TOKENIZER))
        have = {r["source"]: (r["n"], r["tokens"]) for r in self.docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).collect()}
        given = pick(targets, ["source", "target_share", "max_repeats"]).groupBy("source").agg(F.first("target_share").alias("s"), F.first("max_repeats").alias("m")).filter("source is not null").orderBy("source").collect()
        shares = {r["source"]: float(r["s"] or 0.0) for r in given}
        caps = {r["source"]: int(r["m"] or 0) for r in given}
        room = {s: have.get(s, (0, 0))[1] * caps[s] for s in shares}
        able = [s for s in shares if shares[s] > 0 and room[s] > 0]
        largest = min((room[s] / shares[s] for s in able), default=0.0)
        self.total = float(largest if total_tokens is None else total_tokens)
        mean = sum(v * v for v in shares.values())
        reach = max((abs(mean - v) for v in shares.values()), default=0.0) or 1.0
        self.sources: list[dict] = []
        for s in shares:
            n, tokens = have.get(s, (0, 0))
            use = min(shares[s] * self.total, room[s])
            self.sources.append({
                "source": s, "share": shares[s], "cap": caps[s], "n": n, "tokens": tokens, "use": use,
                "ramp": slope * (mean - shares[s]) / reach,
            })

    @staticmethod
    def demand(p: dict, t: float) -> float:
        """Tokens a source has to have given at time t: the integral of its weight schedule."""
        return p["use"] * (t + p["ramp"] * (t * t - t))

    def chosen(self, block: int = 50_000) -> DataFrame:
        """(doc_id, source, n_tokens, repeats, mid): the used documents; ``mid`` is the place of a
        document's middle among the tokens of its source, in hash order.

        A use of a document has a training position where the demand reaches its tokens; it is chosen if
        that is within [0, 1], that is, if the demand at the end of training lies beyond them.
        """
        spark = self.docs.sparkSession
        # One row per listed source: a table of the size of the target list.
        table = spark.createDataFrame(
            [(p["source"], max(1, -(-p["n"] // block)), float(p["tokens"]), float(self.demand(p, 1.0)), int(p["cap"])) for p in self.sources],
            "source string, blocks long, all_tokens double, wanted double, cap long",
        )
        h = F.xxhash64("doc_id", F.lit(17))
        rows = self.docs.join(F.broadcast(table), "source").withColumn("h", h).withColumn("block", F.pmod(F.shiftrightunsigned("h", 20), F.col("blocks")))
        sums = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block"))
        before = sums.withColumn("before", F.sum("in_block").over(Window.partitionBy("source").orderBy("block")) - F.col("in_block")).drop("in_block")
        inside = Window.partitionBy("source", "block").orderBy("h", "doc_id")
        placed = rows.withColumn("upto", F.sum("n_tokens").over(inside)).join(before, ["source", "block"])
        mid = F.col("before") + F.col("upto") - F.col("n_tokens") / 2
        repeats = F.least(F.ceil((F.col("wanted") - mid) / F.col("all_tokens")), F.col("cap"))
        return placed.select("doc_id", "source", "n_tokens", repeats.cast("int").alias("repeats"), mid.cast("double").alias("mid")).filter("repeats > 0")

    def report(self, chosen: DataFrame) -> DataFrame:
        """(source, target_share, actual_share, n_docs, n_tokens, capped) for every listed source."""
        spark = self.docs.sparkSession
        plan = spark.createDataFrame(
            [(p["source"], p["share"], bool(p["use"] + 0.5 < p["share"] * self.total)) for p in self.sources], "source string, target_share double, capped boolean"
        )
        used = chosen.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"))
        whole = F.sum(F.coalesce("n_tokens", F.lit(0))).over(Window.partitionBy())  # over the rows of the target list
        return plan.join(used, "source", "left").select(
            "source", "target_share", F.round(F.coalesce(F.col("n_tokens") / whole, F.lit(0.0)), 6).alias("actual_share"),
            F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "capped",
        )

    def schedule(self, chosen: DataFrame) -> DataFrame:
        """(doc_id, source, use_no, n_tokens, position): every use at its training position, range-sorted."""
        spark = self.docs.sparkSession
        table = spark.createDataFrame([(p["source"], float(p["tokens"]), float(max(p["use"], 1e-9)), p["ramp"]) for p in self.sources], "source string, all_tokens double, used double, ramp double")
        uses = chosen.join(F.broadcast(table), "source").select("*", F.posexplode(F.sequence(F.lit(1), F.col("repeats"))).alias("use_no", "_"))
        part = F.least(F.lit(1.0), (F.col("use_no") * F.col("all_tokens") + F.col("mid")) / F.col("used"))
        # ramp t^2 + (1 - ramp) t = part, solved for t in the form that stays exact for small ramps
        b = 1 - F.col("ramp")
        t = 2 * part / (b + F.sqrt(F.greatest(F.lit(0.0), b * b + 4 * F.col("ramp") * part)))
        placed = uses.select("doc_id", "source", F.col("use_no").cast("int").alias("use_no"), "n_tokens", F.least(F.lit(1.0), t).alias("position"))
        return placed.repartitionByRange("position").sortWithinPartitions("position", "doc_id", "use_no")
