"""A stored inverted index: postings with positions and character offsets, and exact phrases looked up in it.

The index is one table of postings (term, text, position, offsets) in buckets of
its term, so that a lookup reads only the files of its terms' buckets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.functions.text import tokens
from sylva.tables import inputs, kinds, names_apart

_TOKEN = re.compile(r"[^\W_]+")
BUCKETS = 64


def token_spans(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """``key, pos, start, end, term``: every token with its place in characters, end exclusive. Narrow: no shuffle.

    Null and empty texts have no tokens; texts are read whole.
    """
    produced = ["pos", "start", "end", "term"]
    names = names_apart(key, produced)
    types = kinds(df, key)
    schema = T.StructType([T.StructField(names[k], types[k]) for k in key] + [T.StructField(n, T.IntegerType()) for n in produced[:3]] + [T.StructField("term", T.StringType())])
    width = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pos, start, end, term = [], [], [], [], []
            for r, t in enumerate(batch.column(width).to_pylist()):
                for p, m in enumerate(_TOKEN.finditer(t or "")):
                    rows.append(r)
                    pos.append(p)
                    start.append(m.start())
                    end.append(m.end())
                    term.append(m[0].lower())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(width)], *[pa.array(x, pa.int32()) for x in (pos, start, end)], pa.array(term, pa.string())], names=schema.fieldNames())

    return inputs(df, key, [text]).mapInArrow(run, schema)


def bucket(term) -> object:  # noqa: ANN001
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write(df: DataFrame, key: str, text: str, path: str) -> None:
    """Writes the postings anew; this table has this one writer."""
    rows = token_spans(df, [key], text).withColumn("bucket", bucket(F.col("term")))
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def postings(opened: DataFrame) -> DataFrame:
    return opened.drop("bucket")


def find(opened: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """``key, name, pos, start, end`` of every place where the tokens of a ``name`` stand one after another.

    Each token of a name is looked up by its term; places agree on where the name would begin, so the
    join needs no order and a name is found where all its tokens are.
    """
    wanted = names.select("name").distinct().withColumn("_p", tokens(F.col("name"))).filter(F.size("_p") > 0)
    parts = wanted.select("name", F.size("_p").alias("_n"), F.posexplode("_p").alias("_i", "term")).withColumn("bucket", bucket(F.col("term")))
    hit = opened.join(parts, ["bucket", "term"]).select(key, "name", "_n", "_i", (F.col("pos") - F.col("_i")).alias("pos"), "start", "end")
    whole = hit.groupBy(key, "name", "_n", "pos").agg(F.count("*").alias("_k"), F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.filter(F.col("_k") == F.col("_n")).select(key, "name", "pos", "start", "end")
