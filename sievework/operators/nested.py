"""Nested JSON records to flat, linked tables by Dewey labelling.

Every JSON value gets the ordinal path from the record's root as its label
(member number below an object, position below a list). A label's prefix is
the label of an ancestor, so parent links need no join: they are found by
truncation. Nodes with the same schema path (`$.sources[].spans[]`) form one
flat table.

Defined results: null, blank, cut-off or otherwise invalid JSON has no nodes;
scalars at the root have none; a string that as a whole is a JSON list or
object counts as that list or object; null list elements keep their position;
of repeated keys in one object the last counts, as in most JSON readers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "source_table string, record_id bigint, dewey array<int>, schema_path string, path string, "
    "position int, is_element boolean, members map<string,string>, parent_depth int, parent_schema_path string"
)
_ARROW = pa.schema(
    [
        ("source_table", pa.string()),
        ("record_id", pa.int64()),
        ("dewey", pa.list_(pa.int32())),
        ("schema_path", pa.string()),
        ("path", pa.string()),
        ("position", pa.int32()),
        ("is_element", pa.bool_()),
        ("members", pa.map_(pa.string(), pa.string())),
        ("parent_depth", pa.int32()),
        ("parent_schema_path", pa.string()),
    ]
)
#: Rows of one Arrow batch on the way out, so that long records can't fill a worker.
BATCH_ROWS = 8192


#: Where a word begins in a name like documentId; the same for Python and Java.
_HUMP = "([a-z0-9])([A-Z])"


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


_decoder = json.JSONDecoder(parse_constant=_no_constant)


def _read(text: str | None):
    """The list or object that `text` is as a whole, else None."""
    if text is None:
        return None
    body = text.strip(" \t\r\n")
    if body[:1] not in ("[", "{"):
        if body[:1] != '"':
            return None
        try:  # a record may be a JSON string that holds JSON
            inner = _decoder.decode(body)
        except (ValueError, RecursionError):
            return None
        return _read(inner) if isinstance(inner, str) and len(inner) < len(body) else None
    try:
        return _decoder.decode(body)
    except (ValueError, RecursionError):
        return None


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _container(value):
    if isinstance(value, (list, dict)):
        return value
    if isinstance(value, str) and value.lstrip(" \t\r\n")[:1] in ("[", "{", '"'):
        return _read(value)
    return None


def merge_spellings(members: list[tuple]) -> list[tuple]:
    """The members under one spelling of their names: documentId and document_id are both document_id.

    No value is lost: of two members that share a name, the one spelt so keeps
    it, else the first; the other keeps its own spelling. Null gives way.
    """
    merged: dict = {}
    for key, value in sorted(members, key=lambda m: (m[1] is None, m[0] != snake(m[0]))):
        name = snake(key)
        if name not in merged:
            merged[name] = value
        elif value is not None:
            merged[key] = value
    return list(merged.items())


def snake(key: str) -> str:
    return re.sub(_HUMP, r"\1_\2", key).lower()


def merged_path(schema_path):
    """`snake` for a column of schema paths."""
    return F.lower(F.regexp_replace(schema_path, _HUMP, "$1_$2"))


def label_nodes(text: str | None, members: bool = True, scalars: bool = False) -> Iterator[tuple]:
    """(dewey, schema path, path, position, is_element, members, parent's depth, parent's schema path) of each object.

    The parent is the nearest enclosing object, or the record ("$", depth 0). Objects come in document order. The walk keeps its own stack, so depth is
    bounded by the JSON reader only. With scalars, the listed values that are neither objects nor lists nor null come too, with
    themselves as their only member, `value`; they are no elements.
    """
    root = _read(text)
    if root is None:
        return
    stack = [(root, (), "$", "$", None, False, None, None)]
    while stack:
        node, label, schema, path, position, element, depth, owner = stack.pop()
        below = []
        if isinstance(node, dict):
            own = []
            for n, (key, value) in enumerate(node.items()):
                inner = _container(value)
                if inner is None:
                    if members:
                        own.append((key, _text(value)))
                else:
                    below.append((inner, (*label, n), f"{schema}.{key}", f"{path}.{key}", None, False, len(label), schema))
            yield list(label), schema, path, position, element, own, depth, owner
        else:
            for n, value in enumerate(node):
                inner = _container(value)
                at = (depth, owner) if owner else (0, "$")
                if inner is None:
                    if scalars and value is not None:
                        yield [*label, n], f"{schema}[]", f"{path}[{n}]", n, False, [("value", _text(value))], *at
                else:
                    below.append((inner, (*label, n), f"{schema}[]", f"{path}[{n}]", n, isinstance(inner, dict), *at))
        stack.extend(reversed(below))


def shred(df: DataFrame, source_table: str, record_id: str, json_column: str, members: bool = True, whole: bool = False) -> DataFrame:
    """Label every object of `json_column`; one row per object.

    Columns: NODE_SCHEMA, with `parent_dewey` in place of parent_depth: the
    label of the nearest enclosing object by truncation (null for the root
    object; below a root list the record itself is the parent, label []). With
    members=False the scalar members are left out, for queries that need
    places only; with whole=True the listed scalars are rows too, and member
    names have one spelling. Narrow: no shuffle, records are walked where they are read.
    """

    def walk(batches):
        columns: list[list] = [[] for _ in _ARROW]

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW
            )
            for c in columns:
                c.clear()
            return batch

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in label_nodes(text.as_py(), members, scalars=whole):
                    if whole:
                        row = (*row[:5], merge_spellings(row[5]), *row[6:])
                    for c, v in zip(columns, (source_table, key, *row)):
                        c.append(v)
                    if len(columns[0]) >= BATCH_ROWS:
                        yield flush()
        if columns[0]:
            yield flush()

    picked = df.select(F.col(record_id).cast("bigint").alias("_id"), F.col(json_column).alias("_json"))
    nodes = picked.where(F.col("_json").isNotNull()).mapInArrow(walk, NODE_SCHEMA)
    parent = F.slice("dewey", F.lit(1), F.col("parent_depth"))
    return nodes.withColumn("parent_dewey", F.when(F.col("parent_depth").isNotNull(), parent)).drop("parent_depth")


def list_elements(nodes: DataFrame) -> DataFrame:
    """The nodes that are elements of a list: the rows of the child tables."""
    return nodes.where("is_element")


def flat_table(nodes: DataFrame, schema_path: str, fields: dict[str, str]) -> DataFrame:
    """One schema path as a flat table with typed columns.

    fields: column name to DDL type of the wanted members; members that a
    record lacks or that don't convert are null. Keys: (source_table,
    record_id, dewey) and (source_table, record_id, parent_dewey).
    """
    keys = ["source_table", "record_id", "dewey", "parent_dewey", "position", "path"]
    return nodes.where(F.col("schema_path") == schema_path).select(
        *keys, *[F.try_element_at("members", F.lit(k)).try_cast(t).alias(k) for k, t in fields.items()]
    )


def schema_tables(nodes: DataFrame) -> DataFrame:
    """The tables the nodes fall into: rows, records and member names of each schema path, all exact.

    Each record is summed by itself first, so a hot schema path is no hot key.
    """
    keys = ["source_table", "schema_path", "parent_schema_path"]
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("names"))))
    by_record = (
        nodes.withColumn("names", F.map_keys("members"))
        .groupBy(*keys, "record_id")
        .agg(F.count("*").alias("rows"), names.alias("names"))
    )
    return by_record.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.count("*").alias("records"), names.alias("member_names"))
