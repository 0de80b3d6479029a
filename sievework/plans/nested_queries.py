"""Queries over the service's JSON fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import nested
from sievework.sources.tables import delivered_once, table

#: Table and JSON field of the records that are taken apart.
FIELDS = [("eval_case_result", "retrieved_chunks"), ("eval_case", "golden_chunks"), ("eval_run", "config_snapshot")]


def _nodes(spark: SparkSession, sf_dir: str, members: bool, whole: bool = False) -> DataFrame:
    # records once, before the walk: their texts are smaller than their nodes
    parts = [nested.shred(delivered_once(table(spark, sf_dir, t), c), t, "id", c, members, whole) for t, c in FIELDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all list elements, taken from the rows of the flat tables."""
    return nested.list_elements(_nodes(spark, sf_dir, members=True, whole=True)).select("source_table", "record_id", "path")


def p1_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.schema_tables(_nodes(spark, sf_dir, members=True)).withColumn(
        "member_names", F.array_join("member_names", ",")
    )


def _dotted(label: str) -> Column:
    return F.array_join(F.transform(label, lambda x: x.cast("string")), ".")


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list element with its own and its parent's label as dotted text."""
    return nested.list_elements(_nodes(spark, sf_dir, members=False)).select(
        "source_table",
        "record_id",
        "schema_path",
        _dotted("dewey").alias("dewey"),
        _dotted("parent_dewey").alias("parent_dewey"),
        "position",
    )


def p1_retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top-level list elements of retrieved_chunks as one typed table."""
    once = delivered_once(table(spark, sf_dir, "eval_case_result"), "retrieved_chunks")
    nodes = nested.shred(once, "eval_case_result", "id", "retrieved_chunks")
    fields = {"documentId": "bigint", "chunkIndex": "int", "similarityScore": "double", "finalScore": "double"}
    flat = nested.flat_table(nodes, "$[]", fields)
    return flat.select(
        "record_id",
        "position",
        F.col("documentId").alias("document_id"),
        F.col("chunkIndex").alias("chunk_index"),
        F.round("similarityScore", 6).alias("similarity"),
        F.round("finalScore", 6).alias("final_score"),
    )


def p1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all flat tables of the three fields, with all members; (source_table, schema_path) names the table.

    Objects outside lists are rows too, as parents, and so are listed scalars. Schema paths and member names have one
    spelling, `path` the record's. An empty parent_dewey is the root object, or the record if its root is a list; null: no parent.
    """
    return _nodes(spark, sf_dir, members=True, whole=True).select(
        "source_table",
        "record_id",
        nested.merged_path("schema_path").alias("schema_path"),
        nested.merged_path("parent_schema_path").alias("parent_schema_path"),
        _dotted("dewey").alias("dewey"),
        _dotted("parent_dewey").alias("parent_dewey"),
        "path",
        "position",
        "members",
    )


#: Typed members of a chunk, in the merged spelling.
CHUNK = {
    "citation_index": "int", "document_id": "bigint", "chunk_index": "int", "content": "string", "similarity_score": "double", "keyword_score": "double",
    "final_score": "double", "weight": "double", "retrieve_source": "string", "vector_retrieve_source": "string",
}


def p1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object with a document id as one typed table: all shapes and spellings of retrieved and golden chunks, alternatives included.

    p1_retrieved is the part of it that its SQL twin defines: top-level elements in one spelling.
    """
    rows = p1_rows(spark, sf_dir).where("source_table <> 'eval_run' and map_contains_key(members, 'document_id')")
    member = lambda k, t: F.try_element_at("members", F.lit(k)).try_cast(t)
    return rows.select(
        "source_table",
        "record_id",
        "path",
        "position",
        *[(F.round(member(k, t), 6) if t == "double" else member(k, t)).alias(k) for k, t in CHUNK.items()],
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_tables, p1_links, p1_retrieved, p1_rows, p1_chunks)}

_NORM = """case when json_type({x}) = 'VARCHAR' and json_valid(json_extract_string({x}, '$'))
  and json_type(json_extract_string({x}, '$')) in ('ARRAY', 'OBJECT') then json_extract_string({x}, '$')::json else {x} end"""
_SOURCES = " union all ".join(
    f"select '{t}' as source_table, id as record_id, {c}::json as j from (select distinct on (id) id, {c} from {t}) where json_valid({c})"
    for t, c in FIELDS
)
_WALK = f"""with recursive src as ({_SOURCES}),
walk as (
  select source_table, record_id, '$' as path, {_NORM.format(x='j')} as node, false as element from src
  union all
  select source_table, record_id, path || (c).s, {_NORM.format(x='(c).v')}, (c).e from (
    select source_table, record_id, path, unnest(case json_type(node)
      when 'ARRAY' then list_transform(range(0, json_array_length(node)::bigint), lambda i: {{'s': '[' || i || ']', 'v': json_extract(node, '$[' || i || ']'), 'e': true}})
      when 'OBJECT' then list_transform(json_keys(node), lambda k: {{'s': '.' || k, 'v': json_extract(node, '$."' || k || '"'), 'e': false}}) end) as c
    from walk where json_type(node) in ('ARRAY', 'OBJECT')))
"""


def _member_sql(name: str, kind: str) -> str:
    first, *rest = name.split("_")
    spelt = [name, first + "".join(w.capitalize() for w in rest)]
    value = f"coalesce({', '.join(f"json_extract_string(node, '$.{k}')" for k in dict.fromkeys(spelt))})"
    if kind == "string":
        return f"{value} as {name}"
    return f"round(try_cast({value} as double), 6) as {name}" if kind == "double" else f"try_cast({value} as {kind}) as {name}"


#: Every node with its labels: `owner` and `owner_schema` are those of the nearest enclosing object, null for a root object.
_LABELS = f"""with recursive src as ({_SOURCES}),
walk as (
  select source_table, record_id, '' as dewey, '$' as schema, {_NORM.format(x='j')} as node, false as element, null::int as position,
    null::varchar as owner, null::varchar as owner_schema from src
  union all
  select source_table, record_id, case when dewey = '' then '' else dewey || '.' end || (c).n, schema || (c).s, {_NORM.format(x='(c).v')}, (c).e,
    case when (c).e then (c).n end, case when is_object then dewey else coalesce(owner, '') end, case when is_object then schema else coalesce(owner_schema, '$') end
  from (
    select source_table, record_id, dewey, schema, owner, owner_schema, json_type(node) = 'OBJECT' as is_object, unnest(case json_type(node)
      when 'ARRAY' then list_transform(range(0, json_array_length(node)::bigint), lambda i: {{'n': i::int, 's': '[]', 'v': json_extract(node, '$[' || i || ']'), 'e': true}})
      when 'OBJECT' then list_transform(json_keys(node), lambda k, i: {{'n': (i - 1)::int, 's': '.' || k, 'v': json_extract(node, '$."' || k || '"'), 'e': false}}) end) as c
    from walk where json_type(node) in ('ARRAY', 'OBJECT')))
"""

ORACLE: dict[str, str] = {
    "p1_links": _LABELS
    + """select source_table, record_id, schema as schema_path, dewey, owner as parent_dewey, position from walk where element and json_type(node) = 'OBJECT'""",
    "p1_tables": _LABELS
    + f""", objects as (select source_table, record_id, schema, owner_schema, node from walk where json_type(node) = 'OBJECT'),
names as (select source_table, schema, owner_schema, list(distinct k) as ks from (
  select source_table, schema, owner_schema, k from (select *, unnest(json_keys(node)) as k from objects)
  where json_type({_NORM.format(x="json_extract(node, '$.\"' || k || '\"')")}) not in ('ARRAY', 'OBJECT')) group by all)
select o.source_table, o.schema as schema_path, o.owner_schema as parent_schema_path, count(*) as rows, count(distinct record_id) as records,
  coalesce(array_to_string(list_sort(any_value(ks)), ','), '') as member_names
from objects o left join names n on n.source_table = o.source_table and n.schema = o.schema and n.owner_schema is not distinct from o.owner_schema group by 1, 2, 3""",
    "p1_found": _WALK + "select source_table, record_id, path from walk where element and json_type(node) = 'OBJECT'",
    "p1_chunks": _WALK
    + r"select source_table, record_id, path, try_cast(regexp_extract(path, '\[(\d+)\]$', 1) as int) as position, "
    + ", ".join(_member_sql(k, t) for k, t in CHUNK.items())
    + " from walk where source_table <> 'eval_run' and json_type(node) = 'OBJECT' and (json_exists(node, '$.documentId') or json_exists(node, '$.document_id'))",
    "p1_retrieved": _WALK
    + r"""select record_id, regexp_extract(path, '(\d+)', 1)::int as position, try_cast(json_extract_string(node, '$.documentId') as bigint) as document_id,
  try_cast(json_extract_string(node, '$.chunkIndex') as int) as chunk_index, round(try_cast(json_extract_string(node, '$.similarityScore') as double), 6) as similarity,
  round(try_cast(json_extract_string(node, '$.finalScore') as double), 6) as final_score
  from walk where source_table = 'eval_case_result' and regexp_full_match(path, '\$\[\d+\]') and json_type(node) = 'OBJECT'""",
}
