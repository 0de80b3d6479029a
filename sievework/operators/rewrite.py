"""Rule-based query rewriting: normalisation, synonym expansion, fallback reasons; parsing of a model's rewrite."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.config import Rewrite
from sievework.functions import text as tx

# --- Fixed values ---------------------------------------------------------------
QUESTION_NOISE = ["什么", "怎么", "如何", "为什么", "是否", "请问", "这个", "那个", "有哪些", "多少", "以及", "的", "是", "吗", "呢", "啊"]
GENERIC_WORDS = ["缓存", "key", "数据库", "索引", "事务", "相似度", "问题", "内容"]
SYNONYMS = {
    "redis": ["redis", "缓存", "key"],
    "缓存击穿": ["缓存击穿", "热点key", "互斥锁", "逻辑过期"],
    "缓存穿透": ["缓存穿透", "布隆过滤器", "缓存空值"],
    "缓存雪崩": ["缓存雪崩", "过期时间随机化", "多级缓存", "限流降级"],
    "mysql": ["mysql", "数据库", "索引", "事务"],
    "rag": ["rag", "检索增强生成", "embedding", "rerank", "chunk"],
    "向量检索": ["向量检索", "embedding", "相似度", "qdrant"],
    "重排序": ["重排序", "rerank", "finalScore"],
}
# --------------------------------------------------------------------------------


def load_synonyms(path: str | None) -> dict[str, list[str]]:
    """A JSON dictionary in file order (a byte-order mark is fine); the built-in one if it can't be read."""
    if path is None:
        return SYNONYMS
    try:
        with open(path, encoding="utf-8-sig") as f:
            return {str(k): list(map(str, v)) for k, v in json.load(f).items()}
    except (OSError, ValueError, AttributeError, TypeError):
        return SYNONYMS


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def normalize(question: Column) -> Column:
    """Lower case, punctuation and noise words to blanks, single blanks."""
    q = F.regexp_replace(F.lower(question), r"[\r\n\t]+", " ")
    q = F.trim(F.regexp_replace(F.regexp_replace(q, "[?？!！,，。；;：:]+", " "), tx.BLANKS, " "))
    for w in QUESTION_NOISE:
        q = F.replace(q, F.lit(w), F.lit(" "))
    return F.trim(F.regexp_replace(q, tx.BLANKS, " "))


def expand(normalized: Column, config: Rewrite = Rewrite(), synonyms: dict[str, list[str]] | None = None) -> Column:
    """Synonyms of the dictionary's keys that occur, in dictionary order, the first max_expanded distinct ones."""
    if not config.expand_keywords:
        return _array([])
    none = _array([])
    parts = [
        F.when(F.contains(normalized, F.lit(k)), _array(v)).otherwise(none) for k, v in (synonyms or SYNONYMS).items()
    ]
    return F.slice(F.array_distinct(F.concat(*parts)), 1, config.max_expanded if config.max_expanded > 0 else 8)


def rewrite(df: DataFrame, question: str, config: Rewrite = Rewrite(), synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds original, normalized, keywords, rewritten and reason; a reason means the original is used as it is."""
    out = df.withColumn("original", tx.trim_all(F.coalesce(question, F.lit(""))))
    out = out.withColumn("normalized", normalize(F.col("original")))
    out = out.withColumn("_kw", expand(F.col("normalized"), config, synonyms))
    own = F.when(F.length("normalized") > 0, F.array("normalized")).otherwise(_array([]))
    out = out.withColumn("_q", F.array_join(F.array_distinct(F.concat(own, F.col("_kw"))), " "))
    generic = _array(GENERIC_WORDS)
    words = F.filter(F.split("normalized", tx.BLANKS), lambda w: F.length(w) > 0)
    reason = (
        F.when(F.lit(not config.enabled), "DISABLED")
        .when(F.length("original") == 0, "ORIGINAL_EMPTY")
        .when(F.length("normalized") == 0, "NORMALIZED_EMPTY")
        .when(F.length("_q") > F.length("original") * config.max_growth, "QUERY_TOO_LONG")
        .when(F.forall(words, lambda w: F.array_contains(generic, w)), "GENERIC_ONLY")
    )
    out = out.withColumn("reason", reason)
    kept = F.col("reason").isNull()
    return (
        out.withColumn("keywords", F.when(kept, F.col("_kw")).otherwise(_array([])))
        .withColumn("rewritten", F.when(kept, F.col("_q")).otherwise(F.col("original")))
        .drop("_kw", "_q")
    )


def model_rewrite(raw: Column, original: Column, config: Rewrite = Rewrite(), max_growth: int = 5) -> Column:
    """struct(vector_query, keyword_query, normalized, keywords) of a model's reply, JSON that may be fenced.

    Null where a query is missing, blank or more than max_growth times the
    original, so that the caller falls back to the rules.
    """
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    shape = "struct<vectorQuery:string,keywordQuery:string,normalizedQuestion:string,expandedKeywords:array<string>>"
    reply = F.from_json(F.when(body != "", body), shape)
    filled = lambda c: (F.length(F.trim(c)) > 0) & (F.length(c) <= F.length(original) * max_growth)
    normalized = F.when(F.length(F.trim(reply["normalizedQuestion"])) > 0, reply["normalizedQuestion"]).otherwise(original)
    keywords = F.slice(F.coalesce(reply["expandedKeywords"], _array([])), 1, config.max_expanded if config.max_expanded > 0 else 8)
    result = F.struct(
        reply["vectorQuery"].alias("vector_query"),
        reply["keywordQuery"].alias("keyword_query"),
        normalized.alias("normalized"),
        keywords.alias("keywords"),
    )
    return F.when(filled(reply["vectorQuery"]) & filled(reply["keywordQuery"]), result)
