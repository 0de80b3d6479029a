"""Context compression, context assembly, citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.config import Compression
from sievework.functions import text as tx
from sievework.operators.keyword import ngram_terms

# --- Fixed values ---------------------------------------------------------------
NOISE = ["什么", "怎么", "如何", "为什么", "是否", "请问", "这个", "那个", "有哪些", "多少", "以及", "的", "是", "吗", "呢"]
SENTENCE = r"[^。！？.!?\n]+[。！？.!?]?"
CITATION = r"\[([0-9]+)\]"
# --------------------------------------------------------------------------------

_NONE = "array<string>"


def sentences(text: Column) -> Column:
    """Trimmed sentences without empty ones; the whole text if there are none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), tx.trim_all)
    found = F.filter(found, lambda s: F.length(s) > 0)
    whole = tx.trim_all(text)
    return F.when(F.size(found) > 0, found).when(F.length(whole) > 0, F.array(whole)).otherwise(F.array().cast(_NONE))


def title(text: Column) -> Column:
    """The first line anywhere that is a heading, else the empty string."""
    lines = F.transform(F.split(text, "\n"), tx.trim_all)
    return F.coalesce(F.get(F.filter(lines, tx.is_heading), F.lit(0)), F.lit(""))


def compression_terms(question: Column, config: Compression = Compression()) -> Column:
    """Terms a sentence is scored by: tokens or n-grams, then the phrase without noise words."""
    squashed = tx.squash(F.coalesce(question, F.lit("")))
    tokens = F.split(squashed, "[^a-z0-9一-龥]+")
    phrase = tx.without_words(squashed, NOISE)
    last = F.when(F.length(phrase) > 0, F.array(phrase)).otherwise(F.array().cast(_NONE))
    return F.array_distinct(F.concat(ngram_terms(tokens, max(1, config.min_keyword_length), NOISE), last))


def compress(df: DataFrame, question: str, content: str, config: Compression) -> DataFrame:
    """Adds compressed and ratio.

    The best sentences (terms found, 2 for the phrase, and 1 / position if any)
    in their own order below the title, cut to max_chars; without any match the
    head of the text. Disabled: the text as it is. Null and blank texts give
    the empty string, ratio 0 for empty texts. One row in, one row out: no shuffle.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    if not config.enabled:
        return df.withColumn("compressed", text).withColumn("ratio", F.when(F.length(text) > 0, 1.0).otherwise(0.0))
    out = df.withColumn("_t", tx.clean(text))
    out = out.withColumn("_title", title(F.col("_t"))).withColumn("_terms", compression_terms(F.col(question), config))
    out = out.withColumn("_phrase", tx.without_words(tx.squash(F.coalesce(question, F.lit(""))), NOISE))


    def score(s: Column, i: Column, q: Column) -> Column:
        def of(squashed: Column) -> Column:
            hits = F.size(F.filter(q["terms"], lambda t: (F.length(t) > 0) & F.contains(squashed, t))).cast("double")
            hits = hits + F.when((F.length(q["phrase"]) > 0) & F.contains(squashed, q["phrase"]), 2.0).otherwise(0.0)
            total = F.when((hits > 0) & (s != q["title"]), hits + F.lit(1.0) / (i + 1)).otherwise(0.0)
            return F.struct((-total).alias("order"), i.alias("i"), s.alias("s"))

        return tx.let(tx.squash(s), of)

    asked = F.struct(F.col("_terms").alias("terms"), F.col("_phrase").alias("phrase"), F.col("_title").alias("title"))
    found = tx.let(asked, lambda q: F.transform(sentences(F.col("_t")), lambda s, i: score(s, i, q)))
    picked = F.filter(found, lambda x: x["order"] < 0)
    best = F.slice(F.array_sort(picked), 1, max(1, config.max_sentences))
    in_order = F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    out = out.withColumn("_best", F.array_join(F.transform(in_order, lambda x: x["s"]), "\n"))
    limit = lambda c, n: F.when(F.length(c) > n, tx.trim_all(F.substring(c, 1, n))).otherwise(c)
    chars = config.max_chars if config.max_chars > 0 else 800
    head = limit(F.col("_t"), config.fallback_chars if config.fallback_chars > 0 else 200)
    titled = F.length("_title") > 0
    fallback = F.when(~titled | F.contains(head, F.col("_title")), head).otherwise(
        limit(F.concat("_title", F.lit("\n\n"), head), chars)
    )
    body = F.when(titled, F.concat("_title", F.lit("\n\n"), "_best")).otherwise(F.col("_best"))
    chosen = F.when(F.length("_best") > 0, limit(tx.trim_all(body), chars)).otherwise(fallback)
    out = out.withColumn("compressed", F.when(F.length(tx.trim_all(text)) > 0, chosen).otherwise(""))
    ratio = F.when(F.length(text) > 0, F.length("compressed") / F.length(text)).otherwise(0.0)
    return out.withColumn("ratio", ratio).drop("_t", "_title", "_terms", "_phrase", "_best")


def assemble(ranked: DataFrame) -> DataFrame:
    """(query_id, n_sources, context): numbered source blocks in rank order.

    ranked: query_id, rank, document_id, chunk_index, content; a query has as
    many rows as the final cut-off allows.
    """
    block = F.format_string(
        "[%d]\ndocumentId: %d\nchunkIndex: %d\ncontent:\n%s\n\n", F.col("rank"), F.col("document_id"), F.col("chunk_index"), F.col("content")
    )
    rows = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return ranked.groupBy("query_id").agg(
        F.count("*").alias("n_sources"), F.array_join(F.transform(rows, lambda r: r["block"]), "").alias("context")
    )


def cited(answer: Column) -> Column:
    """Distinct cited numbers in order; numbers too large for an int are left out."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda x: x.isNotNull()))


def check_citations(df: DataFrame, answer: str, sources: Column) -> DataFrame:
    """Adds cited, invalid, missing, valid. sources: array<int> of the numbers that exist."""
    out = df.withColumn("cited", cited(F.col(answer))).withColumn("_s", F.coalesce(sources, F.array().cast("array<int>")))
    out = out.withColumn("invalid", F.array_except("cited", "_s"))
    out = out.withColumn("missing", (F.size("_s") > 0) & (F.size("cited") == 0)).drop("_s")
    return out.withColumn("valid", ~F.col("missing") & (F.size("invalid") == 0))


def repaired(df: DataFrame, answer: str, repair: str, sources: Column) -> DataFrame:
    """Adds final_answer: an invalid answer gives way to its repair if that is valid."""
    first = check_citations(df, answer, sources).withColumnRenamed("valid", "_v1").drop("cited", "invalid", "missing")
    second = check_citations(first, repair, sources)
    use = ~F.col("_v1") & F.col("valid") & F.col(repair).isNotNull()
    return second.withColumn("final_answer", F.when(use, F.col(repair)).otherwise(F.col(answer))).drop(
        "_v1", "cited", "invalid", "missing", "valid"
    )
