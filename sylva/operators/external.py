"""Texts run through a model of the caller: sentence splitters, taggers, dependency parsers.

The engine brings no such models. ``load`` is called once per task, not per row,
and its result maps a batch of texts to lists of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sylva.tables import inputs, kinds, names_apart


def apply_model(
    df: DataFrame, text: str, keep: Sequence[str], load: Callable[[], Callable[[list[str | None]], list[list[tuple]]]], columns: T.StructType
) -> DataFrame:
    """``keep`` and the model's ``columns``, a row for each row the model gives. No shuffle."""
    names = names_apart(keep, columns.fieldNames())
    types = kinds(df, keep)
    schema = T.StructType([T.StructField(names[k], types[k]) for k in keep] + list(columns.fields))
    made = [pa.field(f.name, _ARROW[type(f.dataType)]) for f in columns.fields]
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            given = model(batch.column(width).to_pylist())
            take = pa.array([i for i, rows in enumerate(given) for _ in rows], pa.int64())
            flat = [row for rows in given for row in rows]
            cols = [pa.array([row[k] for row in flat], f.type) for k, f in enumerate(made)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(width)], *cols], names=schema.fieldNames())

    return inputs(df, keep, [text]).mapInArrow(run, schema)


_ARROW = {T.StringType: pa.string(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_()}
