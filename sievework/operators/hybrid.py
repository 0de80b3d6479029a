"""Merging vector and keyword candidates, final scores, thresholds."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.config import Retrieval
from sievework.operators.documents import Scope


def hybrid_score(similarity: Column, keyword_score: Column, config: Retrieval) -> Column:
    """Weighted sum of the similarity within 0..1 and kw / (1 + kw); nulls count 0."""
    v, k = config.weights()
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(similarity, F.lit(0.0))))
    kw = F.coalesce(keyword_score, F.lit(0.0))
    return near * v + kw / (kw + 1.0) * k


def merge(vectors: DataFrame, keywords: DataFrame, config: Retrieval = Retrieval()) -> DataFrame:
    """One row per query and chunk of either list, ranked and cut to hybrid_top_k.

    A chunk of both lists is HYBRID and its similarity at least the keyword
    list's 0. Ties keep list order: vector list first, then keyword list.
    """
    joined = vectors.join(keywords, ["query_id", "id"], "full_outer")
    both = F.col("vector_rank").isNotNull() & F.col("keyword_rank").isNotNull()
    similarity = F.when(F.col("keyword_rank").isNotNull(), F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(0.0))).otherwise(
        F.col("similarity")
    )
    merged = joined.select(
        "query_id", "id", similarity.alias("similarity"), "keyword_score", "vector_rank", "keyword_rank",
        F.when(both, "HYBRID").when(F.col("vector_rank").isNotNull(), "VECTOR").otherwise("KEYWORD").alias("source"),
    )
    merged = merged.withColumn("hybrid_score", hybrid_score(F.col("similarity"), F.col("keyword_score"), config))
    order = Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), F.asc_nulls_last("vector_rank"), "keyword_rank")
    ranked = merged.withColumn("hybrid_rank", F.row_number().over(order))
    return ranked.where(F.col("hybrid_rank") <= config.hybrid_top_k) if config.hybrid_top_k > 0 else ranked


def rerank(merged: DataFrame, relevance: DataFrame | None = None) -> DataFrame:
    """final_score: the model's relevance where every chunk of the query has one, else the hybrid score.

    relevance: (query_id, id, relevance). With a model's scores the keyword
    score no longer applies; on fallback it is kept.
    """
    if relevance is None:
        return merged.withColumn("final_score", F.coalesce("hybrid_score", F.lit(0.0)))
    joined = merged.join(relevance, ["query_id", "id"], "left")
    complete = F.bool_and(F.col("relevance").isNotNull()).over(Window.partitionBy("query_id"))
    scored = joined.withColumn("_all", complete)
    return scored.select(
        *[c for c in merged.columns if c != "keyword_score"],
        F.when(~F.col("_all"), F.col("keyword_score")).alias("keyword_score"),
        F.when(F.col("_all"), F.col("relevance")).otherwise(F.coalesce("hybrid_score", F.lit(0.0))).alias("final_score"),
    )


def cut_off(scored: DataFrame, config: Retrieval = Retrieval()) -> DataFrame:
    """Threshold first (off at 0 and below, nulls stay then), then the final_top_k best per query."""
    kept = scored.where(F.col("final_score") >= config.min_final_score) if config.min_final_score > 0 else scored
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "hybrid_rank")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.final_top_k)


def funnel(vectors: DataFrame, keywords: DataFrame, merged: DataFrame, final: DataFrame) -> DataFrame:
    """(query_id, n_vector, n_keyword, n_merged, n_final) in one aggregation over flagged rows."""
    parts = [d.select("query_id", F.lit(i).alias("stage")) for i, d in enumerate((vectors, keywords, merged, final))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    names = ["n_vector", "n_keyword", "n_merged", "n_final"]
    return rows.groupBy("query_id").agg(*[F.count_if(F.col("stage") == i).alias(n) for i, n in enumerate(names)])


def cache_key(question: Column, scope: Scope | dict[str, Column], config: Retrieval = Retrieval()) -> Column:
    """SHA-256 over everything that changes a question's sources: question, whole scope, limits and weights.

    scope: fixed values, or columns for its fields where they differ by row. Lists count as sets, absent values as such.
    """
    fields = ("user_id", "knowledge_base_id", "knowledge_base_ids", "document_id", "document_ids", "status", "type", "types")
    parts = {"question": question}
    for f in fields:
        value = scope.get(f) if isinstance(scope, dict) else getattr(scope, f)
        if isinstance(value, (tuple, list)):
            value = F.lit(",".join(str(x) for x in sorted(set(value))))
        parts[f] = value if isinstance(value, Column) else F.lit(value)
    for f in dataclasses.fields(config):
        parts[f.name] = F.lit(str(getattr(config, f.name)))
    # names and lengths keep neighbouring values apart
    text = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{n}="), text(c)) for n, c in parts.items()]), 256)
