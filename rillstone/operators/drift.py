"""Schemas that drift between files: one table in one shape, and a report of each change (problem 5)."""

from __future__ import annotations

import difflib
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.functions.strictjson import kind_of, tolerant_loads
from rillstone.runtime import materialise

SKETCH = 32
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Shape:
    """The shape files ought to have: JSON types of the paths that each file needs, and of those it may have."""

    prefix: str
    required: dict[str, str]
    optional: dict[str, str]


def message_shape() -> Shape:
    """The base shape of chat messages; blocks may hold blocks, three levels deep."""
    required = {"uuid": "string", "sender": "string", "created_at": "string", "text": "string", "content": "array", "content.type": "string", "content.text": "string"}
    block = {"type": "string", "text": "string", "id": "string", "name": "string", "mime_type": "string", "byte_count": "number", "content": "array"}
    optional = {}
    for depth in (1, 2, 3):
        for name, kind in block.items():
            path = "content." * depth + name
            if path not in required and not (depth == 3 and name == "content"):
                optional[path] = kind
    return Shape("chat_messages", required, optional)


def _profiler(sketched: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple, int] = {}
            words: dict[tuple, set[int]] = {}
            lengths: dict[tuple, int] = {}

            def visit(file: str, path: str, value: object) -> None:
                kind = kind_of(value)
                key = (file, path, kind)
                counts[key] = counts.get(key, 0) + 1
                if kind == "object":
                    for n, x in value.items():
                        visit(file, f"{path}.{n}", x)
                elif kind == "array":
                    for x in value:
                        if isinstance(x, dict):
                            for n, y in x.items():
                                visit(file, f"{path}.{n}", y)
                elif kind in ("string", "number"):
                    text = str(value)
                    lengths[key] = lengths.get(key, 0) + len(text)
                    if sketched:
                        words.setdefault(key, set()).update(_WORD.findall(text))

            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[(file, "", "file")] = counts.get((file, "", "file"), 0) + 1
                value = tolerant_loads(text)
                for m in value if isinstance(value, list) else ():
                    if isinstance(m, dict):
                        for n, x in m.items():
                            visit(file, n, x)
            keys = list(counts)
            sketch = [sorted({zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words.get(k, ())})[:SKETCH] for k in keys]
            cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
            cols += [pa.array([counts[k] for k in keys], pa.int64()), pa.array([lengths.get(k, 0) for k in keys], pa.int64()), pa.array(sketch, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["file", "path", "kind", "n", "chars", "sketch"])

    return read


def profile(rows: DataFrame, file_col: str, json_col: str, sketched: bool = True) -> DataFrame:
    """``file, path, kind, n, chars, sketch``: per file, path and JSON type the number of values, their characters and the smallest hashes of
    their words. Each file has a row with an empty path. Batches are aggregated before anything is shuffled."""
    raw = rows.select(file_col, json_col).mapInArrow(_profiler(sketched), "file string, path string, kind string, n bigint, chars bigint, sketch array<bigint>")
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, SKETCH)
    return raw.groupBy("file", "path", "kind").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), smallest.alias("sketch"))


def assign(cost: list[list[float]]) -> list[int]:
    """Column of each row in a cheapest perfect matching of the rows (rows <= columns): shortest augmenting paths with potentials."""
    n, m = len(cost), len(cost[0]) if cost else 0
    inf = float("inf")
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        best, back, done = [inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while match[j0]:
            done[j0] = True
            i0, delta, j1 = match[j0], inf, 0
            for j in range(1, m + 1):
                if not done[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < best[j]:
                        best[j], back[j] = c, j0
                    if best[j] < delta:
                        delta, j1 = best[j], j
            for j in range(m + 1):
                if done[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    best[j] -= delta
            j0 = j1
        while j0:
            match[j0] = match[back[j0]]
            j0 = back[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def similarity(path_a: str, path_b: str, kind_ok: bool, length_a: float, length_b: float, sketch_a: list[int], sketch_b: list[int]) -> float:
    """Between 0 and 1, from names, types, mean lengths and value sketches; paths below different parents have none."""
    parent_a, _, a = path_a.rpartition(".")
    parent_b, _, b = path_b.rpartition(".")
    if parent_a != parent_b:
        return 0.0
    union = sorted(set(sketch_a) | set(sketch_b))[:SKETCH]
    common = set(sketch_a) & set(sketch_b)
    values = sum(x in common for x in union) / len(union) if union else 0.0
    name = difflib.SequenceMatcher(None, a.lower().replace("_", ""), b.lower().replace("_", "")).ratio()
    name = max(name, 0.8 if a.lower() in b.lower() or b.lower() in a.lower() else 0.0)
    length = min(length_a, length_b) / max(length_a, length_b) if max(length_a, length_b) > 0 else 0.0
    return 0.35 * name + 0.25 * kind_ok + 0.2 * length + 0.2 * min(1.0, 2 * values)


def matched(profiled: DataFrame, shape: Shape, threshold: float = 0.6) -> DataFrame:
    """``file, path, change, kinds, renamed_to, score`` of the paths at which a file deviates from the shape.

    The fields of each file are matched with those of the shape: fields of the same name first, the required fields and the file's other fields by
    a cheapest bipartite matching on names, types, lengths and value sketches. A required field without a partner of its name that has a
    non-null value is ``missing``, also in a file without messages; a field of the file in neither list is ``added``, and has a new name of the
    required field it is matched with; a listed field with a value of another type is ``retyped``. A required path's profile is taken over all
    files that have it. Files are compared each by itself, and only their profiles, which have a row per path and type.
    """
    listed = F.col("path").isin([*shape.required])
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("sketch")))), 1, SKETCH)
    known = profiled.filter(listed & (F.col("kind") != "null")).groupBy("path").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), smallest.alias("sketch"))
    base = {r["path"]: (r["chars"] / r["n"], list(r["sketch"])) for r in known.collect()}  # one row per required path
    required, wanted = dict(shape.required), {**shape.required, **shape.optional}

    def match(group: pd.DataFrame) -> pd.DataFrame:
        file, fields = group["file"].iloc[0], {}
        for path, kind, n, chars, sketch in zip(group["path"], group["kind"], group["n"], group["chars"], group["sketch"]):
            if path and kind != "null":
                kinds, total, length, words = fields.get(path, ((), 0, 0, frozenset()))
                fields[path] = ((*kinds, kind), total + n, length + chars, words | frozenset(sketch))
        old, new = sorted(required), sorted(p for p in fields if p not in wanted)
        partner: dict[str, tuple[str, float]] = {}
        if new:
            scores = []
            for p in old:
                length, sketch = base.get(p, (0.0, []))
                of = [similarity(p, q, required[p] in fields[q][0], length, fields[q][2] / fields[q][1], sketch, sorted(fields[q][3])[:SKETCH]) for q in new]
                scores.append([x + 0.1 * (p not in fields and x > 0) for x in of])
            # a required field may stay alone at the cost of no likeness
            for i, j in enumerate(assign([[1 - x for x in row] + [1.0] * len(old) for row in scores])):
                if j < len(new) and scores[i][j] >= threshold:
                    partner[new[j]] = (old[i], float(scores[i][j]))
        out = [(file, p, "missing", [], None, None) for p in old if p not in fields]
        for p, (kinds, *_) in fields.items():
            if p not in wanted:
                out.append((file, p, "added", sorted(kinds), *partner.get(p, (None, None))))
            elif set(kinds) != {wanted[p]}:
                out.append((file, p, "retyped", sorted(kinds), None, None))
        return pd.DataFrame(out, columns=["file", "path", "change", "kinds", "renamed_to", "score"])

    return profiled.groupBy("file").applyInPandas(match, "file string, path string, change string, kinds array<string>, renamed_to string, score double")


def drift_report(rows: DataFrame, file_col: str, json_col: str, shape: Shape) -> DataFrame:
    """``file, path, change, kinds, renamed_to, score``: every deviation of every file, added paths with what they are a new name of. A null file
    name is a file of its own."""
    return matched(materialise(profile(rows, file_col, json_col), "profile"), shape)


def _as_text(value: object) -> str | None:
    """A text in whatever wrapping it came: string, number, list of parts, or an object holding one."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(t for t in map(_as_text, value) if t is not None)
    if isinstance(value, dict):
        for k in ("value", "text", "parts"):
            if k in value:
                return _as_text(value[k])
        return json.dumps(value, ensure_ascii=False, sort_keys=True)
    return json.dumps(value)


_BLOCK = pa.struct([*[(n, pa.string()) for n in ("path", "type", "text", "id", "name", "mime_type")], ("byte_count", pa.int64()), ("extras", pa.map_(pa.string(), pa.string()))])
_BLOCK_SQL = "struct<path:string,type:string,text:string,id:string,name:string,mime_type:string,byte_count:bigint,extras:map<string,string>>"


def _levels(mapping: dict[str, str]) -> dict[int, dict[str, str]]:
    """New names of fields with their base names, by level: 0 for messages, 1 for their blocks and so on."""
    out: dict[int, dict[str, str]] = {}
    for path, to in sorted(mapping.items()):
        level = path.count(".")
        if to.rpartition(".")[0] == ".".join(["content"] * level):
            out.setdefault(level, {})[path.rpartition(".")[2]] = to.rpartition(".")[2]
    return out


def _names_at(levels: dict[int, dict[str, str]], level: int) -> dict[str, str]:
    """The renames of a level; blocks inside blocks are called what the blocks of their file are called, unless they have names of their own."""
    if level < 2:
        return levels.get(level, {})
    return {k: v for k, v in levels.get(0, {}).items() if v == "content"} | levels.get(1, {}) | levels.get(level, {})


def _renamed(fields: dict, names: dict[str, str]) -> dict:
    """The fields under their base names; one whose base name has a value already keeps its own."""
    out = dict(fields)
    for k in fields:
        if k in names and out.get(names[k]) is None:
            out[names[k]] = out.pop(k)
    return out


def _split(fields: dict, texts: tuple[str, ...]) -> tuple[dict, list, dict[str, str]]:
    """``(values, inner, extras)``: the texts as strings, the elements of ``content``, and as JSON all that neither holds as it came."""
    fields = dict(fields)
    values, extras = {}, {}
    for name in texts:
        value = fields.pop(name, None)
        values[name] = _as_text(value)
        if isinstance(value, (dict, list)):
            extras[name] = json.dumps(value)
    inner = fields.pop("content", None)
    if inner is not None and not isinstance(inner, (dict, str, list)):
        extras["content"] = json.dumps(inner)
    inner = [inner] if isinstance(inner, (dict, str)) else inner if isinstance(inner, list) else []
    return values, inner, extras | {k: json.dumps(v) for k, v in fields.items() if k not in extras}


def _blocks(content: list, levels: dict[int, dict[str, str]]) -> list[dict]:
    """Blocks at every depth, outermost first, each with its path of positions."""
    out, todo = [], [(str(i), 1, b) for i, b in enumerate(content)][::-1]
    while todo:
        path, level, block = todo.pop()
        fields = _renamed(block, _names_at(levels, level)) if isinstance(block, dict) else {"type": "text", "text": block}
        size = fields.get("byte_count")
        whole = isinstance(size, int) and not isinstance(size, bool) and abs(size) < 2**63
        if whole or size is None:
            fields = {k: v for k, v in fields.items() if k != "byte_count"}
        values, inner, extras = _split(fields, ("type", "text", "id", "name", "mime_type"))
        out.append({"path": path, **values, "byte_count": size if whole else None, "extras": list(extras.items())})
        todo += [(f"{path}.{i}", level + 1, b) for i, b in enumerate(inner)][::-1]
    return out


def _unifier(names: list[str]):
    flat = pa.struct([("type", pa.string()), ("text", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, file, text, mapping in zip(*(c.to_pylist() for c in batch.columns)):
                levels = _levels(dict(mapping or ()))
                value = tolerant_loads(text)
                for i, m in enumerate(value if isinstance(value, list) else ()):
                    if not isinstance(m, dict):
                        continue
                    values, content, extras = _split(_renamed(m, _names_at(levels, 0)), ("uuid", "sender", "created_at", "text"))
                    blocks = _blocks(content, levels)
                    first = [{"type": b["type"], "text": b["text"]} for b in blocks if "." not in b["path"]]
                    out.append((key, file, i, *values.values(), first, blocks, list(extras.items())))
            types = [pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.list_(flat), pa.list_(_BLOCK), pa.map_(pa.string(), pa.string())]
            cols = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return read


def unify_messages(rows: DataFrame, row_key: str, file_col: str, json_col: str, report: DataFrame) -> DataFrame:
    """``row_key, file, position, uuid, sender, created_at, text, content, blocks, extras``: all messages in the base shape, renamed fields
    under their base name.

    ``content`` holds type and text of the first-level blocks, ``blocks`` all fields of the blocks of every depth with their ``path`` of
    positions (``2``, ``0.1``). Texts in other wrappings become strings. ``extras`` of messages and blocks hold, as JSON by name, added fields
    and what was unwrapped or does not fit its type. Elements that are no objects give no rows, an empty table none.
    """
    mapping = report.filter("renamed_to IS NOT NULL").groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("path", "renamed_to"))).alias("__map"))
    joined = rows.select(F.col(row_key).alias("row_key"), F.col(file_col).alias("file"), F.col(json_col).alias("__json")).join(mapping, "file", "left").select("row_key", "file", "__json", "__map")
    names = ["row_key", "file", "position", "uuid", "sender", "created_at", "text", "content", "blocks", "extras"]
    return joined.mapInArrow(_unifier(names), f"row_key bigint, file string, position bigint, uuid string, sender string, created_at string, text string, content array<struct<type:string,text:string>>, blocks array<{_BLOCK_SQL}>, extras map<string,string>")
