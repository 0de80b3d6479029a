"""Where models plug in, with deterministic stand-ins that work without a network.

An embedder, reranker, answerer or judge is a function from columns to a
column (or a DataFrame of scores), so a real model is a pandas_udf with the
same shape. What the stand-ins return says nothing about real models.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as tx
from sievework.operators import context, keyword

Embedder = Callable[[Column], Column]


def embed_distinct(df: DataFrame, text: str, embed: Embedder, vector: str = "vector") -> DataFrame:
    """Adds the vector of each text; every distinct text is embedded once. Null texts have none."""
    texts = df.select(F.col(text).alias("_text")).where("_text is not null").distinct()
    # joined by digest: texts themselves cross the network once only
    vectors = texts.select(F.sha2("_text", 256).alias("_digest"), embed(F.col("_text")).alias(vector))
    return df.join(vectors, F.sha2(df[text], 256) == F.col("_digest"), "left").drop("_digest")


def seeded_embedding(key: Column, n: int = 10, seed: int = 1) -> Column:
    """n numbers in 0..1 that depend on key and seed only."""
    numbers = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(numbers, lambda i: F.pmod(F.xxhash64(key, i, F.lit(seed)), F.lit(1_000_000)) / 1_000_000)


def overlap_relevance(question: Column, content: Column) -> Column:
    """Stand-in reranker: share of the question's search terms that the text holds."""
    squashed = tx.squash(F.coalesce(content, F.lit("")))
    share = lambda terms: F.try_divide(F.size(F.filter(terms, lambda t: F.contains(squashed, t))), F.size(terms))
    return F.coalesce(tx.let(keyword.search_terms(question), share), F.lit(0.0))


def extractive_answer(content: Column, source: int = 1) -> Column:
    """Stand-in answerer: the first sentence of a source with its citation; empty without a source."""
    first = F.get(context.sentences(tx.clean(F.coalesce(content, F.lit("")))), F.lit(0))
    return F.coalesce(F.concat(first, F.lit(f" [{source}]")), F.lit(""))


def answer_prompt(question: Column, sources: Column) -> Column:
    """The prompt of an answer from numbered sources."""
    rules = "Answer from the numbered sources only and cite each statement as [n]. Say so if they hold no answer."
    return F.format_string("%s\n\nQuestion: %s\n\nSources:\n%s", F.lit(rules), question, sources)


def repair_prompt(answer: Column, sources: Column) -> Column:
    """The prompt that asks for the same answer with valid citations."""
    return F.format_string("Give the answer again with citations [n] of existing sources only.\n\nAnswer: %s\n\nSources:\n%s", answer, sources)


def coverage_judge(answer: Column, keywords: Column) -> Column:
    """Stand-in judge: a reply in the judge's JSON form, all scores from the share of required words in the answer."""
    squashed = tx.squash(F.coalesce(answer, F.lit("")))
    found = F.size(F.filter(keywords, lambda k: F.contains(squashed, tx.squash(k))))
    score = F.round(F.coalesce(F.try_divide(found, F.size(keywords)), F.lit(1.0)) * 5, 2).cast("string")
    names = ("correctness", "completeness", "faithfulness", "relevance", "citationQuality")
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), score) for n in names]), F.lit("}"))
