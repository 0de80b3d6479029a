"""Queries over evaluation runs: metrics, summaries, judge replies, diagnosis; events and ingest as streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import evaluate, rewrite
from sievework.plans import sql as q
from sievework.session import scratch
from sievework.sources import files
from sievework.sources.tables import delivered_once, table
from sievework.streaming import ingest

RETRIEVED = "array<struct<documentId:bigint,chunkIndex:int>>"


def results(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return delivered_once(table(spark, d, "eval_case_result"), *columns)


def e01_retrieval_metrics(spark, d):
    """Metrics of each result's retrieved list (lists of source objects only) against its case's golden chunks."""
    cases = delivered_once(table(spark, d, "eval_case"), "golden_chunks").select(F.col("id").alias("case_id"), "golden_chunks")
    rows = results(spark, d, "case_id", "retrieved_chunks").join(cases, "case_id")
    key = lambda g: F.concat(g["documentId"].cast("string"), F.lit(":"), g["chunkIndex"].cast("string"))
    found = F.transform(F.coalesce(F.from_json("retrieved_chunks", RETRIEVED), F.array().cast(RETRIEVED)), key)
    rows = rows.select("id", evaluate.golden_keys(F.col("golden_chunks")).alias("g"), found.alias("r"))
    m = evaluate.retrieval_metrics(F.col("g"), F.col("r"), 5)
    return rows.select("id", F.round(m["recall"], 6).alias("recall"), m["hit"].alias("hit"), F.round(m["mrr"], 6).alias("mrr"))


def e03_golden(spark, d):
    rows = delivered_once(table(spark, d, "eval_case"), "golden_chunks")
    return rows.select("id", F.size(evaluate.golden_keys(F.col("golden_chunks"))).alias("n_golden"))


_SUMMARY = ["recall_at_5", "hit_at_5", "mrr", "citation_valid", "missing_citation", "latency_ms", "correctness_score", "completeness_score", "faithfulness_score", "relevance_score", "citation_quality_score", "judge_score"]


def e04_run_summary(spark, d):
    out = evaluate.run_summary(results(spark, d, "run_id", *_SUMMARY))
    return out.select("run_id", "case_count", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def e05_judge(spark, d):
    rows = results(spark, d, "judge_raw_response").where("judge_raw_response is not null")
    s = evaluate.judge_scores(F.col("judge_raw_response"))
    return rows.select("id", *[F.round(v, 6).alias(f"{k.lower()}_value") for k, v in s.items()])


_CASE = ["run_id", "case_id", "invalid_citations", *_SUMMARY]


def g09_diagnosis(spark, d):
    runs = delivered_once(table(spark, d, "eval_run"))
    return evaluate.diagnose(runs, results(spark, d, *_CASE))


def g09_primary(spark, d):
    runs = delivered_once(table(spark, d, "eval_run"))
    return evaluate.primary(evaluate.diagnose(runs, results(spark, d, *_CASE)))


def a06_evidence(spark, d):
    return evaluate.evidence(results(spark, d, *_CASE))


def f09_enabled_cases(spark, d):
    rows = delivered_once(table(spark, d, "eval_case"), "dataset_id", "enabled")
    return rows.where("enabled = 1").select("id", "dataset_id").orderBy("id")


def f10_run_results(spark, d):
    """The results of every run in order."""
    return results(spark, d, "run_id", "case_id").select("run_id", "id", "case_id").orderBy("run_id", "id")


def f15_run_list(spark, d):
    runs = delivered_once(table(spark, d, "eval_run"), "run_name", "case_count", "avg_judge_score")
    return runs.select("id", "run_name", "case_count", F.round("avg_judge_score", 6).alias("avg_judge_score"))


def k09_datasets(spark, d):
    return table(spark, d, "eval_dataset").select("id", "name", "knowledge_base_id").orderBy(F.desc("id"))


def e02_failed_cases(spark, d):
    """Results of failed cases as they are stored: zero metrics and the message."""
    rows = results(spark, d, "error_message", "recall_at_5", "mrr", "missing_citation")
    zero = lambda c: F.when(F.col("error_message").isNotNull() & F.col(c).isNull(), F.lit(0)).otherwise(F.col(c))
    return rows.select("id", F.round(zero("recall_at_5").cast("double"), 6).alias("recall"), F.round(zero("mrr").cast("double"), 6).alias("mrr"), "error_message")


def s17_synonyms(spark, d):
    rows = [(i, k, "|".join(v)) for i, (k, v) in enumerate(rewrite.SYNONYMS.items())]
    return spark.createDataFrame(rows, "pos int, word string, synonyms string")


def st_event_windows(spark, d):
    out = ingest.event_windows(table(spark, d, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def st_ingest(spark, d):
    """documents landed as a stream, split, deduplicated and stored; the stored chunks."""
    base = scratch(spark, "ingest")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    rows.write.parquet(f"{base}/landing")
    ingest.ingest_stream(spark, f"{base}/landing", "id bigint, text string", f"{base}/store", f"{base}/checkpoint").awaitTermination()
    return files.current_chunks(spark, f"{base}/store", ingest.CHUNKS).select("document_id", "chunk_index", "content_hash")


QUERIES = {
    f.__name__: f
    for f in (
        e01_retrieval_metrics, e02_failed_cases, e03_golden, e04_run_summary, e05_judge, g09_diagnosis, g09_primary,
        a06_evidence, f09_enabled_cases, f10_run_results, f15_run_list, k09_datasets, s17_synonyms, st_event_windows, st_ingest,
    )
}

_N = lambda c: f"coalesce({c}::double, 0)"
_LOW = lambda c: f"({c} is not null and {c} < 3)"
_FLAGS = {
    "RETRIEVAL_RECALL": f"{_N('hit_at_5')} = 0 or {_N('recall_at_5')} < 0.5",
    "RETRIEVAL_RANKING": f"{_N('hit_at_5')} = 1 and {_N('mrr')} < 0.5",
    "CONTEXT_COMPRESSION": f"{_N('recall_at_5')} > 0 and {_LOW('completeness_score')} and {_N('correctness_score')} >= 3",
    "GENERATION": f"{_N('recall_at_5')} >= 0.8 and {_N('mrr')} >= 0.5 and {_LOW('correctness_score')}",
    "FAITHFULNESS": _LOW("faithfulness_score"),
    "CITATION": f"{_N('citation_valid')} = 0 or {_N('missing_citation')} = 1 or coalesce(regexp_replace(invalid_citations, '\\s+', '', 'g'), '[]') not in ('[]', '') or {_LOW('citation_quality_score')}",
    "LATENCY": f"{_N('latency_ms')} > 5000",
}
_A = lambda c: f"coalesce({c}, 0)"
_RATE = lambda b: f"coalesce(n_{b} / nullif(n_cases, 0), 0)"
_SCORES = {
    "RETRIEVAL_RECALL": f"greatest(0, least(1, (1 - {_A('hit_rate_at_5')}) * 0.6 + (1 - {_A('avg_recall_at_5')}) * 0.4))",
    "RETRIEVAL_RANKING": f"greatest(0, least(1, case when {_A('hit_rate_at_5')} >= 0.8 then 1 - {_A('avg_mrr')} else (1 - {_A('avg_mrr')}) * 0.5 end))",
    "CONTEXT_COMPRESSION": _RATE("CONTEXT_COMPRESSION"),
    "GENERATION": _RATE("GENERATION"),
    "FAITHFULNESS": _RATE("FAITHFULNESS"),
    "CITATION": f"greatest(0, least(1, (1 - {_A('citation_valid_rate')}) * 0.7 + {_A('missing_citation_rate')} * 0.3))",
    "LATENCY": f"case when {_A('avg_latency_ms')} > 5000 then greatest(0, least(1, {_A('avg_latency_ms')} / 10000)) else {_RATE('LATENCY')} end",
}
_DIAGNOSIS = (
    f"with {q.RESULTS}, {q.RUNS}, counts as (select run_id, count(*) as n_cases, "
    + ", ".join(f"count(*) filter ({f}) as n_{b}" for b, f in _FLAGS.items())
    + " from results group by run_id), j as (select runs.id as rid, runs.*, counts.* exclude (run_id) from runs left join counts on counts.run_id = runs.id), items as ("
    + " union all ".join(
        f"select rid as run_id, '{b}' as bottleneck, {i} as ord, {s} as raw, coalesce(n_{b}, 0) as affected_cases, coalesce(n_cases, 0) as n_cases from j"
        for i, (b, s) in enumerate(_SCORES.items())
    )
    + """), scored as (select *, floor(raw * 10000 + 0.5) / 10000 as problem_score,
  case when raw >= 0.5 then 'HIGH' when raw >= 0.25 then 'MEDIUM' else 'LOW' end as priority from items),
ranked as (select run_id, bottleneck, problem_score, affected_cases, n_cases, priority, row_number() over (partition by run_id order by problem_score desc, ord) as rank from scored) """
)
_JUDGE = lambda n: f"greatest(0.0, least(5.0, coalesce(try_cast(json_extract_string(b, '$.{n}') as double), 0.0)))"
_LIST = lambda c: f"case when json_valid({c}) and json_type({c}) = 'ARRAY' then json_extract({c}, '$[*]') else []::json[] end"
_KEY = lambda x: (
    f"case when json_type({x}, '$.documentId') in ('UBIGINT', 'BIGINT') and json_type({x}, '$.chunkIndex') in ('UBIGINT', 'BIGINT') "
    f"then json_extract_string({x}, '$.documentId') || ':' || json_extract_string({x}, '$.chunkIndex') end"
)
_GOLDEN = f"golden as (select id as case_id, list_distinct(list_filter(list_transform({_LIST('golden_chunks')}, lambda x: {_KEY('x')}), lambda k: k is not null)) as g from cases)"
ORACLE = {
    "e03_golden": f"with {q.CASES}, {_GOLDEN} select case_id as id, len(g)::int as n_golden from golden",
    "e01_retrieval_metrics": f"""with {q.CASES}, {q.RESULTS}, {_GOLDEN},
r as (select id, g, list_transform({_LIST('retrieved_chunks')}, lambda x: {_KEY('x')})[1:5] as r from results join golden using (case_id)),
m as (select id, g, len(list_filter(list_distinct(r), lambda x: list_contains(g, x))) as f,
  list_position(list_transform(r, lambda x: coalesce(list_contains(g, x), false)), true) as p from r)
select id, round(case when len(g) > 0 then f / len(g) else 0.0 end, 6) as recall, (f > 0)::int as hit, round(case when f > 0 then 1.0 / p else 0.0 end, 6) as mrr from m""",
    "e02_failed_cases": f"""with {q.RESULTS} select id, round(case when error_message is not null and recall_at_5 is null then 0 else recall_at_5 end, 6) as recall,
  round(case when error_message is not null and mrr is null then 0 else mrr end, 6) as mrr, error_message from results""",
    "e04_run_summary": f"with {q.RESULTS} select run_id, count(*) as case_count, "
    + ", ".join(
        f"round(avg(coalesce({c}::double, 0)), 6) as {n}"
        for c, n in (
            ("recall_at_5", "avg_recall_at_5"), ("hit_at_5", "hit_rate_at_5"), ("mrr", "avg_mrr"), ("citation_valid", "citation_valid_rate"),
            ("missing_citation", "missing_citation_rate"), ("latency_ms", "avg_latency_ms"),
        )
    )
    + ", "
    + ", ".join(
        f"round(coalesce(avg(coalesce({c}_score, 0)) filter (judge_score is not null), 0), 6) as avg_{c}_score"
        for c in ("correctness", "completeness", "faithfulness", "relevance", "citation_quality", "judge")
    )
    + " from results group by run_id",
    "e05_judge": rf"""with {q.RESULTS}, r as (select id, regexp_extract(judge_raw_response, '(?s)(\{{.*\}})', 1) as x from results where judge_raw_response is not null),
b as (select id, case when json_valid(x) then x end as b from r),
v as (select id, {_JUDGE('correctness')} as c, {_JUDGE('completeness')} as m, {_JUDGE('faithfulness')} as f, {_JUDGE('relevance')} as r, {_JUDGE('citationQuality')} as q from b)
select id, round(c, 6) as correctness_value, round(m, 6) as completeness_value, round(f, 6) as faithfulness_value, round(r, 6) as relevance_value,
  round(q, 6) as citationquality_value, round(0.30 * c + 0.25 * f + 0.20 * m + 0.15 * r + 0.10 * q, 6) as judge_value from v""",
    "g09_diagnosis": _DIAGNOSIS + "select * from ranked",
    "g09_primary": _DIAGNOSIS
    + "select run_id, bottleneck, bottleneck || ': ' || priority || ' priority, ' || affected_cases || ' of ' || n_cases || ' cases' as summary from ranked where rank = 1",
    "a06_evidence": f"with {q.RESULTS}, x as ("
    + " union all ".join(f"select run_id, case_id, id, '{b}' as bottleneck from results where {f}" for b, f in _FLAGS.items())
    + ") select run_id, bottleneck, row_number() over (partition by run_id, bottleneck order by id) as place, case_id from x",
    "f09_enabled_cases": f"with {q.CASES} select id, dataset_id from cases where enabled = 1",
    "f10_run_results": f"with {q.RESULTS} select id, run_id, case_id from results",
    "f15_run_list": f"with {q.RUNS} select id, run_name, case_count, round(avg_judge_score, 6) as avg_judge_score from runs",
    "k09_datasets": "select id, name, knowledge_base_id from eval_dataset",
    "s17_synonyms": "select * from (values "
    + ", ".join(f"({i}, '{k}', '{'|'.join(v)}')" for i, (k, v) in enumerate(rewrite.SYNONYMS.items()))
    + ") t(pos, word, synonyms)",
    "st_event_windows": "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
}
