"""Deeply nested records turned into flat tables that keep parent-child links.

Each record is shredded into columns, one per leaf path. An entry of a column
is (repetition level, definition level, value): the repetition level says at
which repeated ancestor the path starts anew, the definition level how much of
the path is there. The tables are then rebuilt from these level sequences
alone, with running counts over a whole batch of records: an ancestor's number
is the count of entries that start one since its own parent started.

Defined results: a null record has no rows; a malformed one has a single row if
``malformed`` names it, with the parser's message; a missing level has no rows; a missing attribute is ``''``; attribute
values are as the XML parser gives them; records of any size are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from dataclasses import field as dfield
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sylva.tables import inputs, kinds, names_apart


@dataclass(eq=False)
class Node:
    """A repeated element of the schema. ``table``: name under which its rows are given."""

    tag: str
    children: list[Node] = dfield(default_factory=list)
    table: str | None = None
    level: int = 0
    column: int = -1

    def number(self, level: int, columns: list[Node]) -> None:
        self.level, self.column = level, len(columns)
        columns.append(self)
        for c in self.children:
            c.number(level + 1, columns)


def treatment_schema() -> Node:
    """Treatment > taxon > nomenclature > homotypes > nom > name, and taxon > feature > char."""
    return Node("treatment", [
        Node("taxon", [
            Node("nomenclature", [Node("homotypes", [Node("nom", [Node("name", table="name")], table="nom")])]),
            Node("feature", [Node("char", table="char")], table="feature"),
        ]),
    ])


class Columns:
    """Level sequences and values of every path of a schema, over a batch of records."""

    def __init__(self, root: Node, attribute: str, text: bool) -> None:
        self.root, self.attribute, self.text = root, attribute, text
        self.nodes: list[Node] = []
        root.number(0, self.nodes)
        self.rep: list[list[int]] = [[] for _ in self.nodes]
        self.define: list[list[int]] = [[] for _ in self.nodes]
        self.value: list[list[str | None]] = [[] for _ in self.nodes]
        self.body: list[list[str | None]] = [[] for _ in self.nodes]
        self.record: list[list[int]] = [[] for _ in self.nodes]
        self.malformed: list[tuple[int, str]] = []  # record, message

    def _read(self, xml: str, record: int) -> list | None:
        """The elements of the schema as nested lists [attribute, text parts, children by place]."""
        attribute, text = self.attribute, self.text
        stack: list[tuple[Node | None, list | None]] = []
        top: list[list] = []

        def start(tag: str, attrs: dict[str, str]) -> None:
            if not stack:
                node = self.root if tag == self.root.tag else None
                made = [attrs.get(attribute), [], [[] for _ in node.children]] if node else None
                if made:
                    top.append(made)
                stack.append((node, made))
                return
            parent, held = stack[-1]
            if parent is not None:
                for i, c in enumerate(parent.children):
                    if c.tag == tag:
                        made = [attrs.get(attribute), [], [[] for _ in c.children]]
                        held[2][i].append(made)
                        stack.append((c, made))
                        return
            stack.append((None, held))

        def end(_: str) -> None:
            stack.pop()

        p = expat.ParserCreate("UTF-8")
        p.StartElementHandler, p.EndElementHandler = start, end
        if text:
            p.buffer_text = True
            p.CharacterDataHandler = lambda s: stack[-1][1][1].append(s) if stack[-1][1] is not None else None
        try:
            p.Parse(xml.encode("utf-8", "surrogatepass"), True)
        except (expat.ExpatError, UnicodeError) as e:
            self.malformed.append((record, str(e)))
            return None
        if not top:
            self.malformed.append((record, f"no {self.root.tag}"))
        return top[0] if top else None

    def _write(self, node: Node, element: list | None, rep: int, define: int, record: int) -> None:
        c = node.column
        self.rep[c].append(rep)
        self.define[c].append(define)
        self.value[c].append(element[0] if element else None)
        self.record[c].append(record)
        if self.text:
            self.body[c].append("".join(element[1]) if element else None)
        for i, child in enumerate(node.children):
            kids = element[2][i] if element else ()
            if not kids:
                self._write(child, None, rep, define, record)
            for k, kid in enumerate(kids):
                self._write(child, kid, child.level if k else rep, child.level, record)

    def add(self, xml: str | None, record: int) -> None:
        if xml is None:
            return
        tree = self._read(xml, record)
        if tree is not None:
            self._write(self.root, tree, 0, 0, record)

    def rebuild(self, node: Node, parent: Node) -> tuple[np.ndarray, ...]:
        """(entry index, number of the level-1 ancestor, number of the parent row, own number) of each row of ``node``."""
        rep = np.array(self.rep[node.column], np.int64)
        there = np.array(self.define[node.column], np.int64) >= node.level

        def since(start: np.ndarray, counted: np.ndarray) -> np.ndarray:
            """Running count of ``counted`` since the last ``start``, from 0."""
            total = np.cumsum(counted)
            group = np.maximum.accumulate(np.where(start, np.arange(len(rep)), 0))
            return total - (total - counted)[group] - 1

        outer = since(rep < 1, (rep <= 1).astype(np.int64))
        if parent.level <= 1:
            up, own = outer, since(rep <= 1, there.astype(np.int64))
        else:
            define = np.array(self.define[node.column], np.int64)
            up = since(rep <= 1, ((rep <= parent.level) & (define >= parent.level)).astype(np.int64))
            own = since(rep <= parent.level, there.astype(np.int64))
        at = np.flatnonzero(there)
        return at, outer[at], up[at], own[at]


def _tables(node: Node, above: Node) -> Iterator[tuple[Node, Node]]:
    for c in node.children:
        if c.table:
            yield c, above
            yield from _tables(c, c)
        else:
            yield from _tables(c, above if c.level > 1 else c)


def shred(df: DataFrame, column: str, keep: Sequence[str], root: Node | None = None, attribute: str = "class", text: bool = False, malformed: str | None = None) -> DataFrame:
    """One row per element of each table of the schema: ``taxon_no, node, parent_no,
    node_no, node_class`` (and ``node_text``), after the ``keep`` columns.

    ``taxon_no`` numbers the outermost repeated element of the record;
    ``node_no`` counts within the outermost element for tables that have no table
    above them, else within the parent row. ``node_text`` is the text of an element
    outside its listed children. With ``malformed`` each record that can't be read
    gives one row: that name as ``node``, the message as ``node_class``, the numbers
    null. Narrow: no shuffle.
    """
    root = root or treatment_schema()
    produced = ["taxon_no", "node", "parent_no", "node_no", "node_class", *(["node_text"] if text else [])]
    names = names_apart(keep, produced)
    types = kinds(df, keep)
    schema = T.StructType(
        [T.StructField(names[k], types[k]) for k in keep]
        + [T.StructField(n, T.IntegerType() if n.endswith("_no") else T.StringType()) for n in produced]
    )
    source = inputs(df, keep, [column])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                cols = Columns(root, attribute, text)
                for i, xml in enumerate(batch.column(width).to_pylist()):
                    cols.add(xml, i)
                if malformed and cols.malformed:
                    record = np.array([r for r, _ in cols.malformed])
                    out = [batch.column(i).take(pa.array(record)) for i in range(width)]
                    none = pa.nulls(len(record), pa.int32())
                    out += [none, pa.array([malformed] * len(record), pa.string()), none, none, pa.array([m for _, m in cols.malformed], pa.string())]
                    yield pa.RecordBatch.from_arrays([*out, *([pa.nulls(len(record), pa.string())] if text else [])], names=schema.fieldNames())
                for node, above in _tables(root, root):
                    rows, outer, up, own = cols.rebuild(node, above)
                    if not len(rows):
                        continue
                    record = np.array(cols.record[node.column])[rows]
                    values = pa.array([cols.value[node.column][k] or "" for k in rows], pa.string())
                    out = [batch.column(i).take(pa.array(record)) for i in range(width)]
                    out += [pa.array(outer.astype(np.int32)), pa.array([node.table] * len(rows), pa.string()), pa.array(up.astype(np.int32)), pa.array(own.astype(np.int32)), values]
                    if text:
                        out.append(pa.array([cols.body[node.column][k] for k in rows], pa.string()))
                    yield pa.RecordBatch.from_arrays(out, names=schema.fieldNames())

    return source.mapInArrow(run, schema)
