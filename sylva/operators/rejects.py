"""Rows that fail to parse: typed rows on one side, reasoned rejects on the other.

Structural indexing: the lines of a batch are one byte buffer. numpy masks find
the quotes and delimiters; runs of quotes and their parity give, for every
field that opens with a quote, the place where it closes, all lines at once.
Delimiters inside quoted fields are masked out; the rest are the field ends.
Fields become Arrow columns, and count and type checks give each line either
its typed values or the first reason that holds. Raw text is cut into records
first (``records``): line breaks inside quoted fields do not end one.

Defined results: a null line counts as an empty one (``column_count``); blanks
and carriage returns around a field are ignored; repeated lines are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.functions import buffers as B
from sylva.tables import inputs, kinds, names_apart


@dataclass(frozen=True)
class Field:
    """A column of the record: ``kind`` is text, whole, decimal or date."""

    name: str
    kind: str = "text"
    low: float | None = None
    high: float | None = None
    required: bool = False
    pattern: str | None = field(default=None)

    def spark_type(self) -> T.DataType:
        return {"text": T.StringType(), "whole": T.LongType(), "decimal": T.DoubleType(), "date": T.DateType()}[self.kind]


#: The fields of a pipe-delimited description record.
DESCRIPTION_FIELDS = (
    Field("id", "whole", 1, None, True),
    Field("family"),
    Field("genus", required=True),
    Field("species"),
    Field("authority"),
    Field("subspecies"),
    Field("subsp_authority"),
    Field("variety"),
    Field("year", "whole", 1700, 2026, pattern=r"^[0-9]{4}$"),
    Field("volume", "whole", 1),
    Field("page", "whole", 1),
    Field("collector_no"),
    Field("description"),
    Field("country"),
    Field("coll_date", "date"),
    Field("lat", "decimal", -90, 90),
    Field("lon", "decimal", -180, 180),
    Field("alt_m", "decimal", -500, 9000),
    Field("fl_month", "whole", 1, 12),
    Field("fr_month", "whole", 1, 12),
    Field("status"),
    Field("habitat"),
)
_FORM = {"whole": r"^[0-9]+$", "decimal": r"^[+-]?[0-9]+(\.[0-9]+)?$", "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"}


def index_lines(buf: np.ndarray, off: np.ndarray, delimiter: int = 0x7C) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(broken mask per line, delimiter positions outside quotes, their lines, quoted field starts)."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    pipe = np.flatnonzero(buf == delimiter)
    broken = np.zeros(n, bool)
    quote = np.flatnonzero(buf == 0x22)
    opened = np.zeros(0, np.int64)
    if len(quote):
        solid = np.flatnonzero(~B.blanks(buf))
        before = np.searchsorted(solid, quote) - 1
        prev = np.where(before >= 0, solid[np.maximum(before, 0)], -1)
        # A quote may open a field if only blanks part it from a delimiter or the line's start.
        may = (prev < off[row[quote]]) | (buf[np.maximum(prev, 0)] == delimiter)
        starts = quote[may]
        # Runs of adjacent quotes of one line.
        fresh = np.ones(len(quote), bool)
        fresh[1:] = (np.diff(quote) != 1) | (row[quote[1:]] != row[quote[:-1]])
        run_at = quote[fresh]
        run_len = np.diff(np.append(np.flatnonzero(fresh), len(quote)))
        odd = run_len % 2 == 1
        odd_at, odd_len = run_at[odd], run_len[odd]
        where = off[:-1].copy()  # per line: the place up to which quotes are settled
        live = np.unique(row[starts])
        spans_a, spans_z = [], []
        while len(live):
            k = np.searchsorted(starts, where[live])
            there = (k < len(starts)) & (row[starts[np.minimum(k, len(starts) - 1)]] == live)
            live, k = live[there], k[there]
            if not len(live):
                break
            a = starts[k]
            r = np.searchsorted(run_at, a, side="right") - 1
            own = run_len[r] - (a - run_at[r])
            # The opening run closes its own field if it has an even length: the first quote opens, the rest pair but the last.
            nxt = np.searchsorted(odd_at, run_at[r] + run_len[r])
            found = (nxt < len(odd_at)) & (row[odd_at[np.minimum(nxt, max(len(odd_at) - 1, 0))]] == live) if len(odd_at) else np.zeros(len(live), bool)
            far = (odd_at + odd_len - 1)[np.minimum(nxt, max(len(odd_at) - 1, 0))] if len(odd_at) else np.zeros(len(live), np.int64)
            z = np.where(own % 2 == 0, run_at[r] + run_len[r] - 1, np.where(found, far, -1))
            s = np.searchsorted(solid, z + 1)
            after = np.where(s < len(solid), solid[np.minimum(s, len(solid) - 1)], len(buf))
            ends = off[live + 1]
            bad = (z < 0) | (after < ends) & (buf[np.minimum(after, len(buf) - 1)] != delimiter)
            broken[live[bad]] = True
            spans_a.append(a[~bad])
            spans_z.append(z[~bad])
            where[live] = z + 1
            live = live[~bad]
        if spans_a:
            a, z = np.concatenate(spans_a), np.concatenate(spans_z)
            delta = np.zeros(len(buf) + 1, np.int32)
            np.add.at(delta, a, 1)
            np.add.at(delta, z, -1)
            pipe = pipe[np.cumsum(delta)[pipe] == 0]
            opened = np.sort(a)
    return broken, pipe, row[pipe] if len(pipe) else pipe, opened


def record_ends(buf: np.ndarray, delimiter: int = 0x7C) -> np.ndarray:
    """Places of the line feeds that end a record of one raw text: those outside quoted fields.

    Masks and the parity of quote runs settle all lines without a field that stays open;
    only where one does is the text walked on, from quote run to quote run. A quote that
    never closes ends with its line, so a broken record doesn't swallow the rest.
    """
    feeds = np.flatnonzero(buf == 0x0A)
    if not (buf == 0x22).any():
        return feeds
    off = np.concatenate(([0], feeds + 1, [len(buf)]))
    quote = np.flatnonzero(buf == 0x22)
    solid = np.flatnonzero(~B.blanks(buf))
    before = np.searchsorted(solid, quote) - 1
    prev = np.where(before >= 0, solid[np.maximum(before, 0)], -1)
    line = np.searchsorted(off, quote, side="right") - 1
    may = (prev < off[line]) | (buf[np.maximum(prev, 0)] == delimiter)
    runs = np.concatenate(([0], np.flatnonzero(np.diff(quote) != 1) + 1, [len(quote)]))
    run_at, run_len = quote[runs[:-1]], np.diff(runs)
    odd = run_len % 2 == 1
    inner = np.zeros(len(feeds), bool)
    k = 0  # the next quote run to look at
    while k < len(run_at):
        if not may[runs[k]]:
            k += 1
            continue
        if run_len[k] % 2 == 0:
            k += 1
            continue
        close = k + 1
        while close < len(run_at) and not odd[close]:
            close += 1
        if close == len(run_at):
            k += 1
            continue
        a, z = np.searchsorted(feeds, [run_at[k], run_at[close]])
        after = np.searchsorted(solid, run_at[close] + run_len[close])
        follows = solid[after] if after < len(solid) else len(buf)
        # A closing quote is followed by a delimiter or the end of its line; else the field is broken and ends with its line.
        stop = feeds[z] if z < len(feeds) else len(buf)
        if a < z and follows < stop and buf[follows] != delimiter:
            k = int(np.searchsorted(run_at, feeds[a]))
            continue
        inner[a:z] = True
        k = close + 1
    return feeds[~inner]


def records(df: DataFrame, column: str, keep: Sequence[str], record: str = "record", number: str = "record_no") -> DataFrame:
    """One row per non-empty record of each raw text: ``keep``, its number from 0 and the record without its line end.

    A text is a whole file, or a part of one cut at record ends. Narrow: no shuffle.
    """
    names = names_apart(keep, [number, record])
    types = kinds(df, keep)
    schema = T.StructType([T.StructField(names[k], types[k]) for k in keep] + [T.StructField(number, T.IntegerType()), T.StructField(record, T.StringType())])
    source = inputs(df, keep, [column])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                raw = batch.column(width)[r].as_buffer()
                if raw is None or raw.size == 0:
                    continue
                buf = np.frombuffer(raw, np.uint8)
                ends = np.append(record_ends(buf), len(buf))
                starts = np.concatenate(([0], ends[:-1] + 1))
                ends = ends - ((ends > starts) & (buf[np.maximum(ends - 1, 0)] == 0x0D))
                full = ends > starts
                at = np.flatnonzero(full)
                take = pa.array(np.full(len(at), r))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(width)], pa.array(np.arange(len(at)).astype(np.int32)), B.gather(buf, starts[full], ends[full])], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def _dates(values: pa.Array) -> pa.Array:
    """Dates of the form YYYY-MM-DD; null for what isn't one in the calendar."""
    part = lambda a, z: pc.utf8_slice_codeunits(values, a, z)
    full = pc.equal(pc.utf8_length(values), 10)
    y, m, d = (pc.if_else(full, part(a, z), None).cast(pa.int32()).to_numpy(zero_copy_only=False) for a, z in ((0, 4), (5, 7), (8, 10)))
    y, m, d = (np.nan_to_num(np.asarray(x, float), nan=0).astype(np.int64) for x in (y, m, d))
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    days = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + ((m == 2) & leap)
    good = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= days)
    return pc.if_else(pa.array(good), values, None).cast(pa.date32())


def parse_batch(lines: pa.Array, fields: Sequence[Field]) -> tuple[np.ndarray, list[pa.Array]]:
    """(reason per line, '' if it parses; one typed array per field, null where the line fails)."""
    buf, off, _ = B.view(lines)
    n, width = len(off) - 1, len(fields)
    broken, pipe, of, opened = index_lines(buf, off)
    count = np.bincount(of, minlength=n)
    right = (count == width - 1) & ~broken
    reason = np.where(broken, "broken_quote", np.where(right, "", "column_count")).astype(object)
    rows = np.flatnonzero(right)
    pipe = pipe[right[of]].reshape(len(rows), width - 1)
    starts = np.concatenate((off[rows][:, None], pipe + 1), axis=1)
    ends = np.concatenate((pipe, off[rows + 1][:, None]), axis=1)
    blank = B.blanks(buf)
    bad = np.zeros(len(rows), bool)
    columns: list[pa.Array] = []
    for i, f in enumerate(fields):
        s, e = B.trim(blank, starts[:, i], ends[:, i])
        wrapped = np.isin(s, opened) & (e > s)
        s2, e2 = np.where(wrapped, s + 1, s), np.where(wrapped, e - 1, e)
        v = B.gather(buf, s2, e2)
        if wrapped.any():
            v = pc.if_else(pa.array(wrapped), pc.replace_substring(v, '""', '"'), v)
            trimmed = pc.utf8_trim_whitespace(v)
            v = v if f.kind == "text" and not f.required else trimmed
        full = np.asarray(pc.greater(pc.binary_length(v), 0))
        if f.required:
            bad |= ~full
        if f.kind == "text":
            columns.append(pc.if_else(pa.array(full), v, None))
            continue
        fits = np.asarray(pc.match_substring_regex(v, f.pattern or _FORM[f.kind]))
        if f.kind == "date":
            made = _dates(pc.if_else(pa.array(full & fits), v, ""))
            good = np.asarray(made.is_valid())
            bad |= full & ~good
            columns.append(made)
            continue
        num = pc.if_else(pa.array(full & fits), v, None).cast(pa.float64())
        x = num.to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore"):
            inside = np.ones(len(x), bool)
            if f.low is not None:
                inside &= x >= f.low
            if f.high is not None:
                inside &= x <= f.high
            small = x < 2**63  # a longer whole number is valid but has no typed value
        bad |= full & ~(fits & inside)
        if f.kind == "whole":
            columns.append(pc.if_else(pa.array(full & fits & inside & small), v, None).cast(pa.int64()))
        else:
            columns.append(num)
    reason[rows[bad]] = "bad_value"
    place = np.full(n, -1)
    good = np.flatnonzero(~bad)
    place[rows[good]] = good
    take = pa.array(np.where(place < 0, 0, place), mask=place < 0)
    return reason, [c.take(take) if len(c) else pa.nulls(n, c.type) for c in columns]


def parse_lines(df: DataFrame, column: str, keep: Sequence[str], fields: Sequence[Field] = DESCRIPTION_FIELDS, reason: str = "reason") -> DataFrame:
    """Every line with its typed fields, or with ``reason`` set and the fields null. No shuffle."""
    produced = [reason, *[f.name for f in fields]]
    names = names_apart(keep, produced)
    types = kinds(df, keep)
    schema = T.StructType(
        [T.StructField(names[k], types[k]) for k in keep] + [T.StructField(reason, T.StringType())] + [T.StructField(f.name, f.spark_type()) for f in fields]
    )
    source = inputs(df, keep, [column])
    width, spec = len(keep), tuple(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in B.slices(whole, width)):
            why, cols = parse_batch(batch.column(width), spec)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(width)], pa.array([w or None for w in why], pa.string()), *cols], names=schema.fieldNames()
            )

    return source.mapInArrow(run, schema)


def split_rejects(parsed: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(valid typed rows, rejects) of :func:`parse_lines`."""
    return parsed.filter(F.col(reason).isNull()).drop(reason), parsed.filter(F.col(reason).isNotNull())
