import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import nested
from sievework.plans import nested_queries


def brute(value, path="$"):
    """Paths of objects that are list elements, by plain recursion."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return
        if not isinstance(value, (list, dict)):
            return
    if isinstance(value, dict):
        for k, v in value.items():
            yield from brute(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            inner = v
            if isinstance(v, str):
                try:
                    inner = json.loads(v)
                except ValueError:
                    continue
            if isinstance(inner, dict):
                yield f"{path}[{i}]"
            if isinstance(inner, (dict, list)):
                yield from brute(inner, f"{path}[{i}]")


CASES = [
    '[{"a":[{"b":1},null,{"c":[[{"d":2}]]}],"r":{"x":[{}]}}]',
    '{"s":[{"spans":"[{\\"start\\": 0}]"}],"n":[1,"none",null]}',
    '"[{\\"q\\":1}]"',
    "[ {} , {} ]\n",
    "{}",
]


@pytest.mark.parametrize("text", CASES)
def test_paths_equal_plain_recursion(text):
    found = [r[2] for r in nested.label_nodes(text) if r[4]]
    assert sorted(found) == sorted(brute(json.loads(text)))


@pytest.mark.parametrize("text", [None, "", "  ", '{"a":1', "[NaN,{}]", "5", '"plain"', "null", "[{}] x"])
def test_unreadable_has_no_nodes(text):
    assert list(nested.label_nodes(text)) == []


def test_parents_by_truncation_and_tables(spark):
    rows = [(1, CASES[0], "x"), (2, None, "y"), (2, None, "y"), (3, "[" * 50 + "{}" + "]" * 50, "z")]
    df = spark.createDataFrame(rows, "id long, j string, path string")  # a column name that clashes with the result
    nodes = nested.shred(df, "t", "id", "j").cache()
    links = {r["path"]: (r["dewey"], r["parent_dewey"], r["parent_schema_path"]) for r in nodes.collect()}
    assert links["$[0]"] == ([0], [], "$")
    assert links["$[0].a[2].c[0][0]"][1] == links["$[0].a[2]"][0]
    assert links["$[0].a[2].c[0][0]"][2] == "$[].a[]"
    flat = nested.flat_table(nodes, "$[].a[]", {"b": "int", "missing": "string"}).orderBy("position").collect()
    assert [(r["position"], r["b"], r["missing"]) for r in flat] == [(0, 1, None), (2, None, None)]
    assert {r["schema_path"] for r in nested.schema_tables(nodes).collect()} >= {"$[]", "$[].a[]"}
    assert nodes.where(F.col("record_id") == 3).count() == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, j string")
    assert nested.shred(df, "t", "id", "j").count() == 0


def test_spellings_are_merged_without_loss():
    assert nested.merge_spellings([("documentId", "1"), ("chunkIndex", None)]) == [("document_id", "1"), ("chunk_index", None)]
    assert dict(nested.merge_spellings([("aB", "1"), ("a_b", "2")])) == {"a_b": "2", "aB": "1"}
    assert dict(nested.merge_spellings([("a_b", None), ("aB", "1")])) == {"a_b": "1"}


def test_rows_of_all_fields_with_values(spark, tmp_path):
    records = {
        "eval_case_result": ("retrieved_chunks", '{"groups":[{"via":"X","chunks":[{"document_id":7,"chunk_index":1,"spans":[{"start":0}]}]}],"notes":["n",null,{"code":7}]}'),
        "eval_case": ("golden_chunks", '{"goldenChunks":[{"documentId":8,"chunkIndex":2,"weight":0.5}]}'),
        "eval_run": ("config_snapshot", '{"filter":{"knowledgeBaseIds":[3,4]},"stages":[{"name":"s","fallbacks":[{"waitMs":5}]}]}'),
    }
    for t, (c, j) in records.items():
        spark.createDataFrame([(1, j), (1, j)], f"id long, {c} string").write.parquet(f"{tmp_path}/{t}.parquet")  # delivered twice
    rows = nested_queries.p1_rows(spark, str(tmp_path)).collect()
    found = {(r["source_table"], r["schema_path"], r["position"]): r for r in rows}
    assert len(found) == len(rows) == 14
    values = {(t[5:], p, n): r["members"] for (t, p, n), r in found.items() if r["members"]}
    assert values == {
        ("case_result", "$.groups[]", 0): {"via": "X"},
        ("case_result", "$.groups[].chunks[]", 0): {"document_id": "7", "chunk_index": "1"},
        ("case_result", "$.groups[].chunks[].spans[]", 0): {"start": "0"},
        ("case_result", "$.notes[]", 0): {"value": "n"},
        ("case_result", "$.notes[]", 2): {"code": "7"},
        ("case", "$.golden_chunks[]", 0): {"document_id": "8", "chunk_index": "2", "weight": "0.5"},
        ("run", "$.filter.knowledge_base_ids[]", 0): {"value": "3"},
        ("run", "$.filter.knowledge_base_ids[]", 1): {"value": "4"},
        ("run", "$.stages[]", 0): {"name": "s"},
        ("run", "$.stages[].fallbacks[]", 0): {"wait_ms": "5"},
    }
    labels = {(r["source_table"], r["dewey"]) for r in rows}
    assert all(r["parent_dewey"] is None or (r["source_table"], r["parent_dewey"]) in labels for r in rows)
    assert found["eval_run", "$.filter.knowledge_base_ids[]", 0]["parent_dewey"] == found["eval_run", "$.filter", None]["dewey"]
    chunks = nested_queries.p1_chunks(spark, str(tmp_path)).collect()
    assert {(r["path"], r["document_id"], r["chunk_index"]) for r in chunks} == {("$.groups[0].chunks[0]", 7, 1), ("$.goldenChunks[0]", 8, 2)}


def test_records_of_a_table_are_counted_exactly(spark):
    df = spark.range(20_000).selectExpr("id", """'[{"a":1},{"b":2}]' as j""")
    (row,) = nested.schema_tables(nested.shred(df, "t", "id", "j")).collect()
    assert (row["rows"], row["records"], row["member_names"]) == (40_000, 20_000, ["a", "b"])
