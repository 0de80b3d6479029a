"""Retrieval metrics, judge replies, run summaries and bottleneck diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# --- Fixed values: thresholds and weights of the evaluation ----------------------
LOW_RECALL = 0.5
LOW_MRR = 0.5
LOW_SCORE = 3.0
SLOW_MS = 5000
JUDGE_WEIGHTS = {"correctness": 0.30, "faithfulness": 0.25, "completeness": 0.20, "relevance": 0.15, "citationQuality": 0.10}
BOTTLENECKS = [
    "RETRIEVAL_RECALL", "RETRIEVAL_RANKING", "CONTEXT_COMPRESSION", "GENERATION", "FAITHFULNESS", "CITATION", "LATENCY",
]
# ----------------------------------------------------------------------------------

GOLDEN = "array<struct<documentId:bigint,chunkIndex:int>>"


def golden_keys(json_text: Column) -> Column:
    """array<string> of document:chunk keys; unreadable text and incomplete entries give none."""
    parsed = F.coalesce(F.from_json(json_text, GOLDEN), F.array().cast(GOLDEN))
    whole = F.filter(parsed, lambda g: g["documentId"].isNotNull() & g["chunkIndex"].isNotNull())
    return F.array_distinct(F.transform(whole, lambda g: F.concat_ws(":", g["documentId"].cast("string"), g["chunkIndex"].cast("string"))))


def retrieval_metrics(golden: Column, retrieved: Column, k: int) -> dict[str, Column]:
    """recall, hit and mrr of ordered retrieved keys against distinct golden keys, among the first k."""
    top = F.slice(retrieved, 1, k) if k > 0 else F.array().cast("array<string>")
    n = F.size(golden)
    found = F.size(F.array_intersect(F.array_distinct(top), golden))
    places = F.filter(F.transform(top, lambda x, i: F.when(F.array_contains(golden, x), i + 1)), lambda i: i.isNotNull())
    first = F.get(places, F.lit(0))
    return {
        "recall": F.when(n > 0, found / n).otherwise(0.0),
        "hit": F.when(found > 0, 1).otherwise(0),
        "mrr": F.when(first.isNotNull(), F.lit(1.0) / first).otherwise(0.0),
    }


def judge_scores(raw: Column) -> dict[str, Column]:
    """The five scores of a judge's reply within 0..5 (0 where unreadable) and their weighted sum."""
    body = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)(\{.*\})", 1)
    tree = F.when(body != "", body)
    scores = {}
    for name in ("correctness", "completeness", "faithfulness", "relevance", "citationQuality"):
        value = F.get_json_object(tree, f"$.{name}").try_cast("double")
        scores[name] = F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))))
    scores["judge"] = sum((scores[n] * w for n, w in JUDGE_WEIGHTS.items()), F.lit(0.0))
    return scores


def run_summary(results: DataFrame) -> DataFrame:
    """One row per run: averages over all cases (null counts 0) and over judged cases only (0 without any)."""
    zero = lambda c: F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    judged = F.col("judge_score").isNotNull()
    over = lambda c: F.coalesce(F.avg(F.when(judged, F.coalesce(F.col(c), F.lit(0.0)))), F.lit(0.0))
    return results.groupBy("run_id").agg(
        F.count("*").alias("case_count"),
        zero("recall_at_5").alias("avg_recall_at_5"),
        zero("hit_at_5").alias("hit_rate_at_5"),
        zero("mrr").alias("avg_mrr"),
        zero("citation_valid").alias("citation_valid_rate"),
        zero("missing_citation").alias("missing_citation_rate"),
        zero("latency_ms").alias("avg_latency_ms"),
        *[
            over(f"{n}_score").alias(f"avg_{n}_score")
            for n in ("correctness", "completeness", "faithfulness", "relevance", "citation_quality", "judge")
        ],
    )


def _below(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) < LOW_SCORE)


def affected() -> dict[str, Column]:
    """For each bottleneck, whether a case shows it."""
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    invalid = F.coalesce(F.regexp_replace("invalid_citations", r"\s+", ""), F.lit("[]"))
    return {
        "RETRIEVAL_RECALL": (n("hit_at_5") == 0) | (n("recall_at_5") < LOW_RECALL),
        "RETRIEVAL_RANKING": (n("hit_at_5") == 1) & (n("mrr") < LOW_MRR),
        "CONTEXT_COMPRESSION": (n("recall_at_5") > 0) & _below("completeness_score") & (n("correctness_score") >= LOW_SCORE),
        "GENERATION": (n("recall_at_5") >= 0.8) & (n("mrr") >= LOW_MRR) & _below("correctness_score"),
        "FAITHFULNESS": _below("faithfulness_score"),
        "CITATION": (n("citation_valid") == 0)
        | (n("missing_citation") == 1)
        | ~invalid.isin("[]", "")
        | _below("citation_quality_score"),
        "LATENCY": n("latency_ms") > SLOW_MS,
    }


def diagnose(runs: DataFrame, results: DataFrame) -> DataFrame:
    """(run_id, bottleneck, problem_score, affected_cases, priority, rank) of all seven bottlenecks of each run.

    Scores come from the run's stored averages (null counts 0), counts from its
    results. Conditions are counted in one aggregation with partial sums; a run
    without results has rates of 0.
    """
    flags = affected()
    counts = results.groupBy("run_id").agg(
        F.count("*").alias("n_cases"), *[F.count_if(flags[b]).alias(f"n_{b}") for b in BOTTLENECKS]
    )
    joined = runs.withColumnRenamed("id", "run_id").join(counts, "run_id", "left")
    avg = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    count = lambda b: F.coalesce(f"n_{b}", F.lit(0))
    rate = lambda b: F.coalesce(F.try_divide(count(b), F.col("n_cases")), F.lit(0.0))
    rank_gap = 1.0 - avg("avg_mrr")
    scores = {
        "RETRIEVAL_RECALL": clamp((1.0 - avg("hit_rate_at_5")) * 0.6 + (1.0 - avg("avg_recall_at_5")) * 0.4),
        "RETRIEVAL_RANKING": clamp(F.when(avg("hit_rate_at_5") >= 0.8, rank_gap).otherwise(rank_gap * 0.5)),
        "CONTEXT_COMPRESSION": rate("CONTEXT_COMPRESSION"),
        "GENERATION": rate("GENERATION"),
        "FAITHFULNESS": rate("FAITHFULNESS"),
        "CITATION": clamp((1.0 - avg("citation_valid_rate")) * 0.7 + avg("missing_citation_rate") * 0.3),
        "LATENCY": F.when(avg("avg_latency_ms") > SLOW_MS, clamp(avg("avg_latency_ms") / 10000.0)).otherwise(rate("LATENCY")),
    }
    items = F.array(
        *[
            F.struct(F.lit(b).alias("bottleneck"), F.lit(i).alias("ord"), scores[b].alias("raw"), count(b).alias("affected_cases"))
            for i, b in enumerate(BOTTLENECKS)
        ]
    )
    rows = joined.select("run_id", F.coalesce("n_cases", F.lit(0)).alias("n_cases"), F.explode(items).alias("x")).select("run_id", "n_cases", "x.*")
    rows = rows.withColumn("problem_score", F.floor(F.col("raw") * 10000 + 0.5) / 10000)
    order = Window.partitionBy("run_id").orderBy(F.desc("problem_score"), "ord")
    priority = F.when(F.col("raw") >= 0.5, "HIGH").when(F.col("raw") >= 0.25, "MEDIUM").otherwise("LOW")
    return rows.select(
        "run_id", "bottleneck", "problem_score", "affected_cases", "n_cases", priority.alias("priority"), F.row_number().over(order).alias("rank")
    )


def evidence(results: DataFrame, stretch: int = 100_000) -> DataFrame:
    """(run_id, bottleneck, place, case_id): the affected cases of each run in order of their results, one row per result.

    Rows, not lists, since a run may hold a third of all results; they are
    numbered within stretches of result ids, whose counts are summed up first.
    """
    flags = affected()
    shown = F.array_compact(F.array(*[F.when(flags[b], F.lit(b)) for b in BOTTLENECKS]))
    rows = results.select("run_id", "case_id", "id", F.floor(F.col("id") / stretch).alias("_s"), F.explode(shown).alias("bottleneck"))
    keys = ["run_id", "bottleneck", "_s"]
    before = Window.partitionBy("run_id", "bottleneck").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    counts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    numbered = rows.withColumn("_i", inside).join(counts, same)
    return numbered.select("run_id", "bottleneck", (F.col("_before") + F.col("_i")).alias("place"), "case_id")


def primary(diagnosis: DataFrame) -> DataFrame:
    """(run_id, bottleneck, summary) of each run's first bottleneck."""
    first = diagnosis.where("rank = 1")
    words = F.format_string("%s: %s priority, %d of %d cases", F.col("bottleneck"), F.col("priority"), F.col("affected_cases"), F.col("n_cases"))
    return first.select("run_id", "bottleneck", words.alias("summary"))
