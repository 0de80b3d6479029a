"""Queries of the training-data operators over the service's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import distinctive, markup, mixing, neighbours, pairs, ranking, repetition, splitting, tokenizer
from sievework.session import spread
from sievework.sources.tables import delivered_once, table

#: Pairs from this cosine on count as near.
NEAR = 0.97
#: z-score from which a term is characteristic of its record (two-sided 5 %).
CHARACTERISTIC = 1.96


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivered_once(table(spark, sf_dir, "document_chunk"), "content")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are characteristic of a chunk by their z-score, of those that it repeats and few other chunks have."""
    scored = distinctive.distinctive_terms(_chunks(spark, sf_dir), "id", "content")
    return scored.where(F.col("z") >= CHARACTERISTIC).where("tf >= 3 and df between 2 and 8").select(F.col("id").alias("chunk_id"), "term")


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's terms with their z-score."""
    scored = distinctive.distinctive_terms(_chunks(spark, sf_dir), "id", "content")
    return scored.select(F.col("id").alias("chunk_id"), "term", "tf", "cf", "df", F.round("z", 6).alias("z"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = delivered_once(table(spark, sf_dir, "eval_case_result"), "case_id", "answer", "error_message")
    return pairs.defective_pairs(results, delivered_once(table(spark, sf_dir, "eval_case"), "question"))


def p3_shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that another answer to the same question begins with."""
    results = delivered_once(table(spark, sf_dir, "eval_case_result"), "case_id", "answer")
    short = pairs.shortened_answers(results, "case_id", "answer")
    return results.join(short, ["case_id", "answer"], "left_semi").select(F.col("id").alias("result_id"), "case_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = neighbours.unit_vectors(table(spark, sf_dir, "document_chunk"), "id", "vector_id")
    near = neighbours.nearest(vectors, neighbours.Search(min_similarity=NEAR, probes=1))
    return near.select(
        F.least("query_id", "neighbour_id").alias("chunk_id"), F.greatest("query_id", "neighbour_id").alias("neighbour_id")
    ).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar chunks of every chunk whose id is divisible by 100."""
    vectors = neighbours.unit_vectors(table(spark, sf_dir, "document_chunk"), "id", "vector_id")
    search = neighbours.Search(k=5, tables=4, probes=12, projections=6)
    return neighbours.nearest(vectors, search, only="id % 100 = 0").withColumn("similarity", F.round("similarity", 6))


#: Scores of a result and whether higher is better.
SCORES = {"recall_at_5": True, "mrr": True, "judge_score": True, "latency_ms": False}


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = delivered_once(table(spark, sf_dir, "eval_case_result"), "run_id", *SCORES)
    valid = results.where("judge_score between 0 and 5 and latency_ms > 0")
    return ranking.fused_ranking(valid, "run_id", "id", SCORES)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.dominant(_ranking(spark, sf_dir), "run_id", "id", SCORES)
    return found.select("run_id", F.col("id").alias("result_id"))


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ranked result with its place in its run."""
    r = _ranking(spark, sf_dir)
    return r.select("run_id", F.col("id").alias("result_id"), F.round("projection", 6).alias("projection"), "rank", "tied")


def p5_score_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scaled average rank of each score, before they are weighed."""
    r = _ranking(spark, sf_dir)
    return r.select("run_id", F.col("id").alias("result_id"), *[F.round(f"z_{c}", 6).alias(f"z_{c}") for c in SCORES])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _chunks(spark, sf_dir).select("id", markup.clean_text(F.col("content")).alias("c"))
    return cleaned.select(F.col("id").alias("chunk_id"), F.explode("c.kinds").alias("kind"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean text of every chunk."""
    cleaned = _chunks(spark, sf_dir).select("id", markup.clean_text(F.col("content")).alias("c"))
    return cleaned.select(F.col("id").alias("chunk_id"), F.col("c.text").alias("text"))


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = delivered_once(
        table(spark, sf_dir, "document_chunk").where(F.char_length("content") > splitting.Limits().limit),
        "document_id",
        "chunk_index",
        "content",
    )
    return splitting.oversized(chunks, "content")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    forced = F.when(F.col("split.forced"), "forced").otherwise("natural")
    return _oversized(spark, sf_dir).select(F.col("id").alias("chunk_id"), forced.alias("cut"))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chunk, numbered within document and chunk index."""
    pieces = splitting.numbered_pieces(_oversized(spark, sf_dir), ["document_id", "chunk_index"], "id")
    return pieces.select("document_id", "chunk_index", F.col("id").alias("chunk_id"), "piece_no", "overlap", "piece")


def p7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each oversized chunk, and of its pieces without their overlaps."""
    rows = p7_pieces(spark, sf_dir).groupBy("chunk_id")
    return rows.agg(F.sum(F.char_length("piece") - F.col("overlap")).alias("n_chars"))


def _bpe() -> str:
    return tokenizer.place_of(tokenizer.BYTE_BPE_50K)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", tokenizer.token_ids(F.col("text"), _bpe()).alias("ids"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of what decoding the ids of each text gives (null counts as empty)."""
    decoded = tokenizer.decoded(F.col("text"), _bpe())
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.sha2(decoded, 256).alias("text_hash"))


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Plan:
    return mixing.plan(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_target"), _bpe())


def p9_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used."""
    return mixing.usage(_mix(spark, sf_dir), spark)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each listed source."""
    return mixing.actual_shares(_mix(spark, sf_dir), spark)


def p9_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and block of every slot of the mix."""
    return mixing.schedule(_mix(spark, sf_dir), spark)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that mostly say what they said before: within the tokens' bound, then by passages."""
    rows = spread(table(spark, sf_dir, "documents"))
    return repetition.repeated_documents(rows, "doc_id", "text").select("doc_id")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated share and tokeniser fertility of every document."""
    r = repetition.repetition(spread(table(spark, sf_dir, "documents")), "doc_id", "text")
    measures = ["entropy_loss", "repeated_share", "chars_per_token", "byte_share", "token_entropy"]
    return r.select("doc_id", *[F.round(c, 6).alias(c) for c in measures], "n_tokens", "script", "in_band")


QUERIES = {f.__name__: f for f in (p2_found, p2_scores, p3_found, p3_shortened, p4_found, p4_neighbours, p5_found, p5_ranking, p5_score_ranks, p6_found, p6_clean, p7_found, p7_pieces, p7_lengths, p8_ids, p8_round_trip, p9_usage, p9_shares, p9_schedule, p10_found, p10_shares)}

_TERMS = r"""
with chunks as (select id, any_value(content) as content from document_chunk group by id),
words as (select id, unnest(regexp_extract_all(lower(content), '[a-zß-öø-ÿ]{4,}')) as term from chunks),
counts as (select id, term, count(*) as tf from words group by id, term),
sizes as (select id, sum(tf) as n from counts group by id),
vocabulary as (select term, sum(tf) as cf, count(*) as df from counts group by term),
total as (select sum(cf) as t from vocabulary),
parts as (
  select id, term, tf, n, cf, df, t, tf + 1000.0 * cf / t as i, cf - tf + 1000.0 * cf / t as o
  from counts join sizes using (id) join vocabulary using (term) cross join total)
"""
_RANKED = """
with results as (
  select id, any_value(run_id) as run_id, any_value(recall_at_5) as recall_at_5, any_value(mrr) as mrr,
    any_value(judge_score) as judge_score, any_value(latency_ms) as latency_ms
  from eval_case_result group by id),
ranked as (
  select * from results where recall_at_5 is not null and mrr is not null and latency_ms > 0
    and judge_score between 0 and 5 and not isnan(recall_at_5) and not isnan(mrr) and not isnan(judge_score))
"""


def _rank_sql(column: str, order: str) -> str:
    share = f"(rank() over (partition by run_id order by {column} {order}) - 1 + (count(*) over (partition by run_id, {column}) - 1) / 2.0)"
    return f"case when count(*) over (partition by run_id) > 1 then round({share} / (count(*) over (partition by run_id) - 1), 6) else 1.0 end as z_{column}"


ORACLE: dict[str, str] = {
    "p4_found": f"""
with raw as (select id, any_value(vector_id) as v from document_chunk where vector_id is not null group by id),
split as (select id, list_transform(list_filter(list_transform(string_split(replace(replace(v, '[', ' '), ']', ' '), ','), lambda x: trim(x)),
  lambda x: length(x) > 0), lambda x: try_cast(x as double)) as v from raw),
usable as materialized (select id, case when len(list_filter(v, lambda x: x is null)) = 0 then v end as v from split
  where len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0)
select a.id as chunk_id, b.id as neighbour_id from usable a join usable b on len(a.v) = len(b.v) and a.id < b.id
where list_cosine_similarity(a.v, b.v) >= {NEAR}""",
    "p5_found": _RANKED
    + """select run_id, id as result_id from ranked a
  where exists (select 1 from ranked b where b.run_id = a.run_id and b.id <> a.id)
  and not exists (select 1 from ranked b where b.run_id = a.run_id and b.id <> a.id and not (
    a.recall_at_5 >= b.recall_at_5 and a.mrr >= b.mrr and a.judge_score >= b.judge_score and a.latency_ms <= b.latency_ms
    and (a.recall_at_5 > b.recall_at_5 or a.mrr > b.mrr or a.judge_score > b.judge_score or a.latency_ms < b.latency_ms)))""",
    "p5_score_ranks": _RANKED
    + "select run_id, id as result_id, "
    + ", ".join(_rank_sql(c, "asc" if up else "desc") for c, up in SCORES.items())
    + " from ranked",
    "p7_found": r"""
with chunks as (select id, any_value(content) as content from document_chunk group by id)
select id as chunk_id, case when len(list_filter(regexp_split_to_array(content, '[ \t\n\r　。！？]'), lambda x: length(x) > 800)) > 0
  then 'forced' else 'natural' end as cut from chunks where length(content) > 800""",
    "p7_lengths": """
select id as chunk_id, length(any_value(content)) as n_chars from document_chunk where length(content) > 800 group by id""",
    "p8_round_trip": "select doc_id, sha256(coalesce(text, '')) as text_hash from documents",
    "p3_shortened": """
with results as (select id, any_value(case_id) as case_id, any_value(answer) as answer from eval_case_result group by id)
select a.id as result_id, a.case_id from results a where length(a.answer) >= 16 and exists (
  select 1 from results b where b.case_id = a.case_id and b.answer <> a.answer and starts_with(b.answer, a.answer))""",
    "p2_found": _TERMS + "select id as chunk_id, term from parts where tf >= 3 and df between 2 and 8",
    "p2_scores": _TERMS
    + """select id as chunk_id, term, tf, cast(cf as bigint) as cf, df,
      round((ln(i / (n + 1000.0 - i)) - ln(o / (t - n + 1000.0 - o))) / sqrt(1.0 / i + 1.0 / o), 6) as z from parts""",
}
