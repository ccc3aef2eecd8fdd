"""Nested records to flat tables through interval labels.

Every node of a record gets its pre-order and post-order number by one depth-first traversal.
Nodes of a kind form a table; a child belongs to the innermost node of its parent kind whose
interval contains it: ``parent.pre < child.pre and parent.post > child.post``.

Defined cases
* A null, empty or cut-off payload, or one nested too deeply to read, has no nodes and gives no rows.
* A lone object and an array of objects are the same thing: the lone object has position 0, the
  elements of an array count from 0, null and blank nodes included.
* A field that is missing, null or an object without text is null; ``{"#text": v}`` means ``v``.
* Repeated payloads under other keys are other records; the record key is carried, never interpreted.
* An empty input gives an empty table; columns of the input other than key and payload are not read,
  so clashing names cannot occur.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import spread


@dataclass(frozen=True)
class NodeKind:
    """A kind of node: the names of the node and of the object that holds it, and its fields by dotted path."""

    holder: str
    name: str
    fields: dict[str, str] = field(default_factory=dict)


@dataclass
class Node:
    pre: int
    post: int
    pos: int
    value: object


def label(record: object, wanted: dict[tuple[str, str], str]) -> dict[str, list[Node]]:
    """The nodes of the wanted kinds, by kind and in pre-order; every node of the record is numbered."""
    out: dict[str, list[Node]] = {k: [] for k in wanted.values()}
    pre = post = 0
    # entries: (holder name, own name, position, value) to enter, or a Node (None: not wanted) to leave
    todo: list = [("", "", 0, record)]
    while todo:
        top = todo.pop()
        if top is None or isinstance(top, Node):
            if top is not None:
                top.post = post
            post += 1
            continue
        holder, name, pos, value = top
        kind = wanted.get((holder, name))
        node = None
        if kind is not None:
            node = Node(pre, -1, pos, value)
            out[kind].append(node)
        pre += 1
        if isinstance(value, dict):
            todo.append(node)
            below = []
            for key, child in value.items():
                if isinstance(child, list):
                    below += [(name, key, i, x) for i, x in enumerate(child)]
                else:
                    below.append((name, key, 0, child))
            todo.extend(reversed(below))
        elif isinstance(value, list):  # an array inside an array: its elements keep the name
            todo.append(node)
            todo.extend((holder, name, i, x) for i, x in reversed(list(enumerate(value))))
        else:
            if node is not None:
                node.post = post
            post += 1
    return out


def containers(children: list[Node], parents: list[Node]) -> list[Node | None]:
    """For each child the innermost parent whose interval contains it; both lists are in pre-order."""
    out: list[Node | None] = []
    open_: list[Node] = []
    k = 0
    for child in children:
        while k < len(parents) and parents[k].pre < child.pre:
            open_.append(parents[k])
            k += 1
        while open_ and open_[-1].post < child.post:
            open_.pop()
        out.append(open_[-1] if open_ else None)
    return out


def _text(value: object) -> str | None:
    if isinstance(value, dict):
        value = value.get("#text")
    if value is None or isinstance(value, (dict, list)):
        return None
    return value if isinstance(value, str) else json.dumps(value)


def leaf(value: object, path: list[str]) -> str | None:
    """The scalar at a path below a node; of an array on the way the first element counts."""
    for step in path:
        while isinstance(value, list):
            value = value[0] if value else None
        if not isinstance(value, dict):
            return None
        value = value.get(step)
    while isinstance(value, list):
        value = value[0] if value else None
    return _text(value)


def parse(payload: str | None) -> object:
    """The record of a payload, or None where it isn't complete JSON."""
    if not payload:
        return None
    try:
        return json.loads(payload)
    except (ValueError, RecursionError):
        return None


def _long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def node_table(df: DataFrame, key: str, payload: str, kind: NodeKind) -> DataFrame:
    """One row per node of a kind: key, pre, post, pos and the kind's fields as text."""
    return _flat(df, key, payload, kind, None)


def linked_table(df: DataFrame, key: str, payload: str, child: NodeKind, parent: NodeKind) -> DataFrame:
    """One row per child node inside a parent node, linked by interval containment within the record.

    Columns: key, pre, post, pos and fields of the child; the same of the parent with the prefix
    ``parent_``. All labels of a record come from one row, so the link needs no shuffle.
    """
    return _flat(df, key, payload, child, parent)


def _flat(df: DataFrame, key: str, payload: str, child: NodeKind, parent: NodeKind | None) -> DataFrame:
    src = spread(df.select(F.col(key), F.col(payload).cast("string").alias("__payload")))
    sides = [("", child)] + ([("parent_", parent)] if parent else [])
    schema = T.StructType([src.schema[key]])
    for prefix, kind in sides:
        for name in ("pre", "post", "pos"):
            schema.add(_long(prefix + name))
        for name in kind.fields:
            schema.add(T.StructField(prefix + name, T.StringType()))
    wanted = {(child.holder, child.name): "child"}
    if parent:
        wanted[(parent.holder, parent.name)] = "parent"
    paths = [[p.split(".") for p in kind.fields.values()] for _, kind in sides]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            cols: list[list] = [[] for _ in range(len(schema) - 1)]
            for i, text in enumerate(batch.column(1).to_pylist()):
                record = parse(text)
                if record is None:
                    continue
                nodes = label(record, wanted)
                found = nodes["child"]
                if not found:
                    continue
                owners = containers(found, nodes["parent"]) if parent else [None] * len(found)
                for node, owner in zip(found, owners):
                    if parent and owner is None:
                        continue
                    rows.append(i)
                    k = 0
                    for one, way in zip((node, owner) if parent else (node,), paths):
                        for x in (one.pre, one.post, one.pos):
                            cols[k].append(x)
                            k += 1
                        for path in way:
                            cols[k].append(leaf(one.value, path))
                            k += 1
            arrays = [batch.column(0).take(pa.array(rows, pa.int64()))]
            for values, f in zip(cols, schema.fields[1:]):
                arrays.append(pa.array(values, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return src.mapInArrow(run, schema)


def link_by_containment(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Stored node tables joined: each child with the innermost parent of its record that contains it.

    For tables kept from ``node_table``. The record key is the equi-join key, the interval the
    residual condition; labels of one record are bounded by the record. Columns of the parent get
    the prefix ``parent_``.
    """
    right = parents.select(F.col(key).alias("__key"), *[F.col(c).alias(f"parent_{c}") for c in parents.columns if c != key])
    inside = (
        (F.col(key) == F.col("__key"))
        & (F.col("parent_pre") < F.col("pre"))
        & (F.col("parent_post") > F.col("post"))
    )
    rest = [c for c in right.columns if c != "__key"]
    joined = children.join(right, inside, "inner")
    return (
        joined.groupBy(*children.columns)
        .agg(F.max_by(F.struct(*rest), F.col("parent_pre")).alias("__p"))
        .select(*children.columns, *[F.col("__p")[c].alias(c) for c in rest])
    )
