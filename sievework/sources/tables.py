"""Typed access to the service's tables (one Parquet file or folder each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: DDL of every table of the retrieval service; nothing is inferred.
SCHEMAS = {
    "knowledge_base": "id bigint, user_id bigint, name string, description string, create_time timestamp_ntz",
    "document": (
        "id bigint, name string, file_url string, storage_type string, object_key string, bucket_name string, "
        "file_size bigint, content_type string, file_hash string, type string, user_id bigint, "
        "knowledge_base_id bigint, status int, process_error string, create_time timestamp_ntz, "
        "update_time timestamp_ntz"
    ),
    "document_chunk": (
        "id bigint, document_id bigint, content string, chunk_index int, content_hash string, vector_id string"
    ),
    "eval_dataset": "id bigint, name string, description string, knowledge_base_id bigint, create_time timestamp_ntz",
    "eval_case": (
        "id bigint, dataset_id bigint, question string, expected_answer string, golden_chunks string, "
        "required_keywords string, question_type string, difficulty string, enabled int, create_time timestamp_ntz"
    ),
    "eval_run": (
        "id bigint, dataset_id bigint, run_name string, config_snapshot string, case_count int, "
        "avg_recall_at_5 double, hit_rate_at_5 double, avg_mrr double, citation_valid_rate double, "
        "missing_citation_rate double, avg_latency_ms double, avg_correctness_score double, "
        "avg_completeness_score double, avg_faithfulness_score double, avg_relevance_score double, "
        "avg_citation_quality_score double, avg_judge_score double, create_time timestamp_ntz"
    ),
    "eval_case_result": (
        "id bigint, run_id bigint, case_id bigint, answer string, retrieved_chunks string, recall_at_5 double, "
        "hit_at_5 int, mrr double, citation_valid int, missing_citation int, invalid_citations string, "
        "latency_ms bigint, error_message string, correctness_score double, completeness_score double, "
        "faithfulness_score double, relevance_score double, citation_quality_score double, judge_score double, "
        "judge_reason string, judge_raw_response string, judge_error_message string, create_time timestamp_ntz"
    ),
    "documents": (
        "doc_id bigint, text string, lang string, source string, n_chars bigint, kb_id bigint, "
        "create_time timestamp_ntz"
    ),
    "mix_target": "source string, target_weight double, max_repeats int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read table `name`; the schema is fixed for the service's own tables."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def delivered_once(df: DataFrame, *columns: str, key: str = "id") -> DataFrame:
    """Keep one of the rows that were delivered more than once.

    Rows that share `key` have the same values, so any of them will do. Name
    the columns that are needed: only they cross the shuffle on `key`, and the
    result stays partitioned by it.
    """
    wanted = [c for c in dict.fromkeys(columns or df.columns) if c != key]
    return df.select(key, *wanted).dropDuplicates([key])
