"""Deeply nested JSON turned into related flat tables by shared inlining (problem 4)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.functions.strictjson import kind_of, tolerant_loads
from rillstone.runtime import materialise

#: A schema graph with more edges than this is no schema but data used as names.
MAX_SCHEMA_EDGES = 100_000


@dataclass
class SchemaGraph:
    """Edges ``(parent element, name, kind)`` as seen in the data; an element is a field name that holds objects or arrays of them."""

    root: str
    edges: set[tuple[str, str, str]] = field(default_factory=set)

    def children(self, element: str) -> set[str]:
        return {n for p, n, k in self.edges if p == element and k in ("object", "objects")}

    def tables(self) -> set[str]:
        """The root, and elements that are repeated, shared by several parents, or recursive; all others are inlined."""
        parents: dict[str, set[str]] = {}
        repeated, out = set(), {self.root}
        for p, n, k in self.edges:
            if k in ("object", "objects"):
                parents.setdefault(n, set()).add(p)
                if k == "objects":
                    repeated.add(n)
        for n, above in parents.items():
            reach, todo = set(), [n]
            while todo:
                for c in self.children(todo.pop()):
                    if c not in reach:
                        reach.add(c)
                        todo.append(c)
            if n in repeated or len(above) > 1 or n in reach:
                out.add(n)
        return out


def _graph_reader(root: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: set[tuple[str, str, str]] = set()

        def visit(element: str, value: dict) -> None:
            for name, child in value.items():
                kind = kind_of(child)
                if kind == "object":
                    edges.add((element, name, "object"))
                    visit(name, child)
                elif kind == "array" and any(isinstance(x, dict) for x in child):
                    edges.add((element, name, "objects"))
                    for x in child:
                        if isinstance(x, dict):
                            visit(name, x)
                else:
                    edges.add((element, name, "scalars" if kind == "array" else "scalar"))

        for batch in batches:
            for text in batch.column(0).to_pylist():
                value = tolerant_loads(text)
                for x in value if isinstance(value, list) else [value]:
                    if isinstance(x, dict):
                        visit(root, x)
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*sorted(edges))], names=["parent", "name", "kind"])

    return read


def analyse(rows: DataFrame, json_col: str, root: str) -> SchemaGraph:
    """The schema graph of all values of ``json_col``; text that is no JSON adds nothing."""
    found = rows.select(json_col).mapInArrow(_graph_reader(root), "parent string, name string, kind string").distinct().limit(MAX_SCHEMA_EDGES + 1).collect()
    if len(found) > MAX_SCHEMA_EDGES:
        raise ValueError(f"more than {MAX_SCHEMA_EDGES} schema edges: names carry data")
    return SchemaGraph(root, {tuple(r) for r in found})


def _shredder(root: str, tables: set[str], key_field: str | None, fields: set[str] | None, names: list[str]):
    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []

            def emit(table: str, value: dict, doc: str, key: str | None, parent: str | None, parent_path: str | None, path: str, anchored: str) -> None:
                cells: list[tuple[str, str]] = []

                def inline(prefix: str, obj: dict) -> None:
                    for name, child in obj.items():
                        if isinstance(child, dict):
                            if name in tables:
                                emit(name, child, doc, key, table, path, f"{path}.{name}", f"{anchored}.{name}" if anchored else name)
                            else:
                                inline(f"{prefix}{name}.", child)
                        elif isinstance(child, list) and name in tables and any(isinstance(x, dict) for x in child):
                            for i, x in enumerate(child):
                                if isinstance(x, dict):
                                    emit(name, x, doc, key, table, path, f"{path}.{i}", f"{anchored}.{i}" if anchored else str(i))
                            rest = [None if isinstance(x, dict) else x for x in child]
                            if (fields is None or prefix + name in fields) and any(x is not None for x in rest):
                                cells.append((prefix + name, json.dumps(rest, ensure_ascii=False)))
                        elif fields is None or prefix + name in fields:
                            cells.append((prefix + name, json.dumps(child, ensure_ascii=False)))

                if table == root and key_field is not None:
                    k = value.get(key_field)
                    key, anchored = (k if isinstance(k, str) else None if k is None else json.dumps(k)), ""
                inline("", value)
                out.append((table, doc, key, parent, parent_path, path, anchored, cells))

            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = tolerant_loads(text)
                for i, x in enumerate(value if isinstance(value, list) else [value]):
                    if isinstance(x, dict):
                        emit(root, x, doc, doc, None, None, str(i), str(i))
            for start in range(0, len(out), 20_000):
                cols = list(zip(*out[start : start + 20_000]))
                arrays = [pa.array(c, pa.string()) for c in cols[:7]] + [pa.array(cols[7], pa.map_(pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return shred


def shred(rows: DataFrame, doc_key: str, json_col: str, root: str, key_field: str | None = None, fields: list[str] | None = None, graph: SchemaGraph | None = None) -> DataFrame:
    """All tables' rows: ``element, doc_key, parent_key, parent_element, parent_path, path, anchored_path, cells``.

    ``path`` (positions from the document's root) identifies a row within its document and, with ``doc_key``, is its primary key;
    ``parent_element`` and ``parent_path`` are the foreign key. ``parent_key`` is the natural key that children carry: ``key_field`` of the
    root element, else ``doc_key``; ``anchored_path`` holds the positions below the row that has that key, and the name instead of a position
    where a single object stands in place of an array. ``cells`` maps columns to JSON
    values; ``fields`` prunes them. Text that is no JSON, an empty array and array elements that are no objects give no rows, but such
    elements count as positions. Of names that occur twice in an object the last counts. Rows with a null ``doc_key`` are kept.
    """
    g = graph or analyse(rows, json_col, root)
    names = ["element", "doc_key", "parent_key", "parent_element", "parent_path", "path", "anchored_path", "cells"]
    schema = ", ".join(f"{n} string" for n in names[:-1]) + ", cells map<string,string>"
    return rows.select(F.col(doc_key).cast("string"), json_col).mapInArrow(_shredder(root, g.tables(), key_field, set(fields) if fields else None, names), schema)


def flat_tables(rows: DataFrame, doc_key: str, json_col: str, root: str, key_field: str | None = None) -> dict[str, DataFrame]:
    """Each element's table with one column per inlined scalar, read from one materialised pass."""
    g = analyse(rows, json_col, root)
    tables = g.tables()
    long = materialise(shred(rows, doc_key, json_col, root, key_field, graph=g), "shredded")

    def columns(element: str, prefix: str, depth: int) -> set[str]:
        out = set()
        for p, n, k in g.edges:
            if p == element:
                if k in ("scalar", "scalars"):
                    out.add(prefix + n)
                elif n not in tables and depth < 32:
                    out |= columns(n, f"{prefix}{n}.", depth + 1)
        return out

    out = {}
    for t in tables:
        own = [F.element_at("cells", n).alias(n.replace(".", "_") if n.replace(".", "_") not in ("doc_key", "parent_key", "parent_element", "parent_path", "path") else f"v_{n}") for n in sorted(columns(t, "", 0))]
        out[t] = long.filter(F.col("element") == t).select("doc_key", "parent_key", "parent_element", "parent_path", "path", *own)
    return out


#: What counts as blank, as a regular expression's class.
BLANKS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def non_blank_string(cell: Column) -> Column:
    """Whether a cell holds a JSON string with more than blanks."""
    value = F.get_json_object(F.concat(F.lit('{"v":'), cell, F.lit("}")), "$.v")
    return F.coalesce(cell.startswith('"') & value.rlike(f"[^{BLANKS}]"), F.lit(False))
