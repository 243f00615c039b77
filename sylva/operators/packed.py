"""Several values packed in one field: one row per value, with its position.

The field's Arrow buffer is scanned as a whole. Byte masks mark delimiters;
the parity of ``"`` and the depth of curly quotes and brackets, counted from
the start of each row, tell which delimiters lie inside a quotation or bracket.
The remaining ones give the child offsets of a list array, which is flattened
with the parent ordinals. Rows whose quotes or brackets don't pair are the
exception; a small state machine reads them (an unpaired mark is plain text).

Defined results: a null or blank field has no values; empty values are skipped
and not counted; repeated values stay; a field of any length is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sylva.functions import buffers as B
from sylva.tables import inputs, kinds, names_apart

#: The delimiters that part values.
DELIMITERS = (";", ",", "/", "|", "=", "\t", "\n", "\r", "•", "、", "；", "，")
#: Delimiters that belong to the value between two digits.
BETWEEN_DIGITS = (",", "/")

_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”"}
_ENCLOSED = re.compile(r'"(?:[^"]|"")*"\Z|“[^“”]*”\Z', re.S)


def _scan_row(text: str, delimiters: frozenset[str]) -> list[str]:
    """The pieces of one text whose quotes or brackets don't pair."""
    out, start, i, n = [], 0, 0, len(text)
    while i < n:
        ch = text[i]
        if ch == '"':
            j = i + 1
            while (j := text.find('"', j)) >= 0 and text[j + 1 : j + 2] == '"':
                j += 2
            if j >= 0:
                i = j
        elif ch in _PAIRS:
            depth, j = 0, i
            for j in range(i, n):
                depth += (text[j] == ch) - (text[j] == _PAIRS[ch])
                if depth == 0:
                    break
            if depth == 0:
                i = j
        elif ch in delimiters and not (ch in BETWEEN_DIGITS and text[i - 1 : i].isdigit() and text[i + 1 : i + 2].isdigit()):
            out.append(text[start:i])
            start = i + 1
        i += 1
    return [*out, text[start:]]


def split_array(arr: pa.Array, delimiters: Sequence[str] = DELIMITERS) -> pa.ListArray:
    """The values of each row of a string array, as a list array without nulls."""
    buf, off, valid = B.view(arr)
    n = len(off) - 1
    if n == 0:
        return pa.array([], pa.list_(pa.string()))
    row = np.repeat(np.arange(n), np.diff(off))

    def level(step: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(step)))
        return total[1:] - total[off[:-1]][row]

    quote = buf == 0x22
    inside = level(quote.astype(np.int32)) & 1
    odd = np.zeros(n, bool)
    closed = np.zeros(len(buf), bool)
    for a, z in _PAIRS.items():
        up, down = B.places(buf, a), B.places(buf, z)
        if not (up.any() or down.any()):
            continue
        depth = level(up.astype(np.int32) - down.astype(np.int32))
        odd[row[depth < 0]] = True
        ends = off[1:] - 1
        has = np.diff(off) > 0
        odd[has] |= depth[ends[has]] != 0
        closed |= depth > 0
    last = (off[1:] - 1)[np.diff(off) > 0]
    odd[np.flatnonzero(np.diff(off) > 0)] |= inside[last] == 1

    digit = (buf >= 0x30) & (buf <= 0x39)
    near = np.zeros(len(buf), bool)
    if len(buf) > 2:
        near[1:-1] = digit[:-2] & digit[2:] & (row[:-2] == row[2:])
    cut = np.zeros(len(buf), bool)
    width = np.ones(len(buf), np.int64)
    for d in delimiters:
        m = B.places(buf, d)
        if d in BETWEEN_DIGITS:
            m &= ~near
        width[m] = np.maximum(width[m], len(d.encode()))
        cut |= m
    cut &= (inside == 0) & ~closed
    at = np.flatnonzero(cut)
    at = at[np.diff(at, prepend=-(1 << 40)) >= width[np.roll(at, 1)]] if len(at) and width[at].max() > 4 else at  # a mark of several characters is one
    at = at[valid[row[at]] & ~odd[row[at]]]

    # The piece that ends at the j-th delimiter has the index j plus the rows before it.
    of = row[at]
    index = np.arange(len(at)) + of
    pieces = n + len(at)
    parent = np.empty(pieces, np.int64)
    counts = 1 + np.bincount(of, minlength=n)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    parent = np.repeat(np.arange(n), counts)
    starts, ends = np.empty(pieces, np.int64), np.empty(pieces, np.int64)
    starts[first] = off[:-1]
    starts[index + 1] = at + width[at]
    ends[first + counts - 1] = off[1:]
    ends[index] = at
    starts, ends = B.trim(B.blanks(buf), starts, ends)
    keep = (ends > starts) & valid[parent] & ~odd[parent]
    starts, ends, parent = starts[keep], ends[keep], parent[keep]

    values = B.gather(buf, starts, ends)
    head, tail = buf[np.minimum(starts, max(len(buf) - 1, 0))] if len(buf) else starts, buf[ends - 1] if len(buf) else ends
    maybe = np.flatnonzero((head == 0x22) & (tail == 0x22) | (head == 0xE2) & (tail == 0x9D))
    # Only quoted values and rows with unpaired marks are touched one by one.
    plain = [_unquoted(values[int(k)].as_py()) for k in maybe]
    if len(maybe):
        mask = np.zeros(len(values), bool)
        mask[maybe] = True
        values = pc.replace_with_mask(values, pa.array(mask), pa.array(plain, pa.string()))
        if "" in plain:
            full = np.asarray(pc.greater(pc.binary_length(values), 0))
            values, parent = values.filter(pa.array(full)), parent[full]
    if odd.any():
        marks, extra, extra_parent = frozenset(delimiters), [], []
        for r in np.flatnonzero(odd & valid):
            found = [v for p in _scan_row(buf[off[r] : off[r + 1]].tobytes().decode(), marks) if p.strip() and (v := _unquoted(p.strip()))]
            extra += found
            extra_parent += [r] * len(found)
        parent = np.concatenate((parent, np.array(extra_parent, np.int64)))
        order = np.argsort(parent, kind="stable")
        values, parent = pa.concat_arrays([values, pa.array(extra, pa.string())]).take(pa.array(order)), parent[order]
    per_row = np.bincount(parent, minlength=n)
    bounds = np.concatenate(([0], np.cumsum(per_row))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), values)


def _unquoted(v: str) -> str:
    if not _ENCLOSED.match(v):
        return v
    return v[1:-1].replace('""', '"') if v[0] == '"' else v[1:-1]


def unpack(
    df: DataFrame, column: str, keep: Sequence[str], value: str = "value", pos: str = "pos",
    min_values: int = 1, delimiters: Sequence[str] = DELIMITERS,
) -> DataFrame:
    """One row per value of ``column`` with the ``keep`` columns and the position from 0.

    Rows with fewer than ``min_values`` values give none. A kept column whose
    name clashes with an output gets the suffix ``_in``. Narrow: no shuffle.
    """
    names = names_apart(keep, [value, pos])
    fields = kinds(df, keep)
    schema = T.StructType([T.StructField(names[k], fields[k]) for k in keep] + [T.StructField(pos, T.IntegerType()), T.StructField(value, T.StringType())])
    source = inputs(df, keep, [column])
    marks, width = tuple(delimiters), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in B.slices(whole, width)):
            lists = split_array(batch.column(width), marks)
            counts = np.asarray(pc.list_value_length(lists))
            if (counts < min_values).any():
                ok = pa.array(counts >= min_values)
                lists, batch = lists.filter(ok), batch.filter(ok)
            parents = pc.list_parent_indices(lists)
            values = lists.flatten()
            ordinal = np.asarray(parents).astype(np.int64)
            begin = np.searchsorted(ordinal, np.arange(len(lists)))
            at = np.arange(len(ordinal)) - begin[ordinal] if len(ordinal) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(parents) for i in range(width)], pa.array(at.astype(np.int32)), values],
                names=schema.fieldNames(),
            )

    return source.mapInArrow(run, schema)
