"""Queries over questions and chunks: keyword, vector and hybrid retrieval, rewriting, context, citations.

Questions are the enabled cases of the evaluation sets; a question searches
the finished documents of its set's knowledge base. Without a model, the
vector of a text is its hashed stand-in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.config import Bm25, Compression, Retrieval, Rewrite
from sievework.functions import text as tx
from sievework.operators import context, evaluate, hybrid, keyword, models, rewrite, vector, vector_index
from sievework.plans import sql as q
from sievework.plans.document_queries import chunks, docs
from sievework.session import cut, spread
from sievework.sources.tables import delivered_once, table


def questions(spark: SparkSession, d: str) -> DataFrame:
    """query_id, scope, question of the enabled cases."""
    cases = delivered_once(table(spark, d, "eval_case"), "dataset_id", "question", "enabled").where("enabled = 1 and question is not null")
    sets = table(spark, d, "eval_dataset").select(F.col("id").alias("dataset_id"), F.col("knowledge_base_id").alias("scope"))
    return cases.join(sets, "dataset_id").where("scope is not null").select(F.col("id").alias("query_id"), "scope", "question")


#: Documents that are sent to every executor to find the chunks of a scope; more are joined.
SENT_DOCUMENTS = 1_000_000
#: Chunks that are sources of any question and are sent to every executor to find their texts; more are joined.
SENT_SOURCES = 1_000_000


def scoped_chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Chunks of finished documents with their base as scope."""
    return delivered_once(_delivered_chunks(spark, d, *columns), "document_id", "content", "scope", *columns)


def _delivered_chunks(spark: SparkSession, d: str, *columns: str, asked: DataFrame | None = None) -> DataFrame:
    """scoped_chunks() with the copies of rows, which have equal values: what isn't searched goes before anything is moved.

    asked: only chunks of its scopes.
    """
    done = docs(spark, d).where("status = 1 and knowledge_base_id is not null").select(F.col("id").alias("document_id"), F.col("knowledge_base_id").alias("scope"))
    if asked is not None:
        done = done.join(asked.select("scope").distinct(), "scope", "left_semi").select("document_id", "scope")
    done = cut(done)
    rows = spread(table(spark, d, "document_chunk").where("content is not null").select("id", *dict.fromkeys(("document_id", "content", *columns))))
    return rows.join(F.broadcast(done) if done.count() <= SENT_DOCUMENTS else done, "document_id")


def _vectors(spark, d):
    asked = questions(spark, d)
    held = _delivered_chunks(spark, d, "vector_id", asked=asked).where("vector_id is not null").select("id", "scope", "vector_id")
    held = delivered_once(held, "scope", "vector_id").select("id", "scope", vector.parse(F.col("vector_id")).alias("vector"))
    usable = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < 1e150))
    asked = asked.select("query_id", "scope", vector.hashed_embedding(F.col("question")).alias("vector"))
    return vector.top_k(asked, held.where("vector is not null").where(usable), Retrieval().vector_top_k)


def _keywords(spark, d):
    return keyword.bm25(questions(spark, d), scoped_chunks(spark, d))


def _keyword_top(spark, d):
    asked = questions(spark, d)
    return keyword.bm25_top_k(asked, _delivered_chunks(spark, d, asked=asked), Retrieval().keyword_top_k)


def _merged(spark, d):
    """Vector list, keyword list and merged list, for one reader each."""
    v, k = _vectors(spark, d), _keyword_top(spark, d)
    return v, k, hybrid.merge(v, k)


def _merged_once(spark, d):
    """The same, written, for queries that read them in several branches."""
    v, k = cut(_vectors(spark, d)), cut(_keyword_top(spark, d))
    return v, k, cut(hybrid.merge(v, k))


def v01_parse(spark, d):
    v = vector.parse(F.col("vector_id"))
    rows = chunks(spark, d, "vector_id").where("vector_id is not null")
    return rows.select("id", F.when(v.isNotNull(), F.size(v)).alias("dim"), F.round(F.get(v, F.lit(0)), 6).alias("first"))


def v02_cosine(spark, d):
    """Similarity of each embedding to the first one, in expressions."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = e.where("vec_id = 0").select(F.col("v").alias("w"))
    return e.crossJoin(F.broadcast(one.limit(1))).select("vec_id", F.round(vector.cosine(F.col("v"), F.col("w")), 6).alias("similarity"))


def v03_embedding_topk(spark, d):
    """The 10 nearest embeddings of the same label for every vector whose id is divisible by 100."""
    e = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("scope"), F.col("embedding").cast("array<double>").alias("vector")
    )
    asked = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "scope", "vector")
    return vector.top_k(asked, e, 10).withColumn("similarity", F.round("similarity", 6))


def _embeddings(spark, d):
    e = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("scope"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "scope", "vector"), e


def v04_indexed_topk(spark, d):
    """What v03_embedding_topk finds, through the index."""
    asked, e = _embeddings(spark, d)
    cells = vector_index.fit(e)
    return vector_index.top_k(asked, vector_index.build(e, cells), cells, 10).withColumn("similarity", F.round("similarity", 6))


def v04_recall(spark, d):
    """Whether the index finds at least nine tenths of the exact neighbours of all queries."""
    found, exact = v04_indexed_topk(spark, d).select("query_id", "id"), v03_embedding_topk(spark, d).select("query_id", "id")
    hits = found.join(exact, ["query_id", "id"]).agg(F.count("*").alias("hits"))
    every = exact.agg(F.count("*").alias("neighbours"))
    # two single rows
    return every.crossJoin(hits).select("neighbours", (F.col("hits") >= 0.9 * F.col("neighbours")).cast("int").alias("recalled"))


def v05_routed_topk(spark, d):
    """The nearest chunk texts by the router that is set to the exhaustive search."""
    asked, e = _embeddings(spark, d)
    return vector_index.routed_top_k(asked, e, 10, "IN_MEMORY").withColumn("similarity", F.round("similarity", 6))


def v03_vector_topk(spark, d):
    return _vectors(spark, d).withColumn("similarity", F.round("similarity", 6))


def a01_corpus_stats(spark, d):
    stats = keyword.scope_statistics(scoped_chunks(spark, d))
    return stats.select("scope", "n_chunks", F.round("avg_length", 6).alias("avg_length"))


def a02_document_frequency(spark, d):
    asked = questions(spark, d).select("scope", F.explode(keyword.search_terms(F.col("question"))).alias("term")).distinct()
    hits = keyword.match_terms(scoped_chunks(spark, d), asked).where("raw")
    return hits.groupBy("scope", "term").agg(F.count("*").alias("df"))


def b01_keywords(spark, d):
    rows = delivered_once(table(spark, d, "eval_case"), "question")
    return rows.select("id", F.array_join(keyword.search_terms(F.col("question")), "|").alias("terms"))


def b04_bm25(spark, d):
    return _keywords(spark, d).select("query_id", "id", F.round("score", 6).alias("score"))


def b07_keyword_topk(spark, d):
    return _keyword_top(spark, d).withColumn("keyword_score", F.round("keyword_score", 6))


def b08_rule_score(spark, d):
    """Rule score of every answer by its own question's terms."""
    cases = delivered_once(table(spark, d, "eval_case"), "question").where("question is not null")
    results = delivered_once(table(spark, d, "eval_case_result"), "case_id", "answer").where("answer is not null")
    asked = cases.select(
        F.col("id").alias("case_id"), keyword.score_terms(F.col("question")).alias("terms"),
        tx.without_words(tx.squash(F.col("question")), keyword.STOP_WORDS).alias("phrase"),
    )
    joined = results.join(asked, "case_id").withColumn("s", tx.squash(F.col("answer")))
    return joined.select("id", F.round(keyword.rule_score(F.col("terms"), F.col("phrase"), F.col("s")), 6).alias("score"))


def h03_hybrid(spark, d):
    m = _merged(spark, d)[2]
    return m.select(
        "query_id", "id", F.round("similarity", 6).alias("similarity"), F.round("keyword_score", 6).alias("keyword_score"),
        F.round("hybrid_score", 6).alias("hybrid_score"), "source", "hybrid_rank",
    )


def r03_retrieve(spark, d):
    """The final sources of every question: merge, fallback ranking, threshold, cut."""
    final = hybrid.cut_off(hybrid.rerank(_merged(spark, d)[2]))
    return final.select("query_id", "rank", "id", F.round("final_score", 6).alias("final_score"), "source")


def r02_model_rerank(spark, d):
    """Reranking by a stand-in model that has no score for chunks whose id is divisible by 7."""
    merged = _merged_once(spark, d)[2]
    scored = merged.where("id % 7 <> 0").select("query_id", "id", (F.pmod(F.col("id") * 37 + F.col("query_id"), F.lit(101)) / 101).alias("relevance"))
    out = hybrid.rerank(merged, scored)
    return out.select("query_id", "id", F.round("final_score", 6).alias("final_score"), F.col("keyword_score").isNull().cast("int").alias("no_keyword"))


def a12_funnel(spark, d):
    v, k, m = _merged_once(spark, d)
    return hybrid.funnel(v, k, m, hybrid.cut_off(hybrid.rerank(m)))


def r04_cache_key(spark, d):
    """Keys of every question as asked by the owner of its base, and by a second user with filters."""
    owners = table(spark, d, "knowledge_base").select(F.col("id").alias("scope"), "user_id")
    asked = questions(spark, d).join(owners, "scope", "left")
    own = hybrid.cache_key(F.col("question"), {"user_id": F.col("user_id"), "knowledge_base_id": F.col("scope"), "status": F.lit(1)})
    other = {"user_id": F.col("user_id") + 1, "knowledge_base_id": F.col("scope"), "document_ids": (7, 3, 7), "status": F.lit(1), "types": ("pdf", "md")}
    return asked.select("query_id", own.alias("cache_key"), hybrid.cache_key(F.col("question"), other).alias("filtered_key"))


def q01_normalize(spark, d):
    rows = delivered_once(table(spark, d, "eval_case"), "question").where("question is not null")
    return rows.select("id", rewrite.normalize(F.col("question")).alias("normalized"))


#: Inline questions that meet the dictionary, which the evaluation's questions don't.
REWRITES = ["Redis 是什么？", "MySQL 索引怎么建", "什么是RAG？", "缓存", "如何避免缓存击穿、缓存雪崩，以及重排序？", "是吗", "   ", "key 索引", "向量检索和重排序的相似度有哪些问题？"]


def q04_rewrite(spark, d):
    own = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(REWRITES)], "id bigint, question string")
    rows = delivered_once(table(spark, d, "eval_case"), "question").unionByName(own)
    out = rewrite.rewrite(rows, "question", Rewrite())
    return out.select("id", "rewritten", F.array_join("keywords", "|").alias("keywords"), "reason")


def q05_model_rewrite(spark, d):
    """Replies of a stand-in model to every question: fenced, plain, with a blank query, too long, or no JSON at all."""
    rows = delivered_once(table(spark, d, "eval_case"), "question").where("question is not null and length(question) > 0")
    answer = lambda v, k: F.to_json(F.struct(v.alias("vectorQuery"), k.alias("keywordQuery"), F.array(F.lit("a"), F.lit("b")).alias("expandedKeywords")))
    asked, kind = F.col("question"), F.pmod("id", F.lit(5))
    raw = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), answer(F.upper(asked), asked), F.lit("\n```")))
        .when(kind == 1, answer(asked, asked))
        .when(kind == 2, answer(F.lit("  "), asked))
        .when(kind == 3, answer(F.repeat(asked, 6), asked))
        .otherwise(F.lit("no JSON"))
    )
    reply = rewrite.model_rewrite(raw, asked)
    return rows.select("id", reply["vector_query"].alias("vector_query"), reply["keyword_query"].alias("keyword_query"), F.array_join(reply["keywords"], ",").alias("keywords"))


def r03_rewritten(spark, d):
    """Keyword top-k with the rewritten questions instead of the original ones."""
    asked = rewrite.rewrite(questions(spark, d), "question", Rewrite()).select("query_id", "scope", F.col("rewritten").alias("question"))
    top = keyword.keyword_top_k(keyword.bm25(asked, scoped_chunks(spark, d)), Retrieval().keyword_top_k)
    return top.withColumn("keyword_score", F.round("keyword_score", 6))


def x01_sentences(spark, d):
    rows = chunks(spark, d, "content").select("id", context.sentences(tx.clean(F.col("content"))).alias("s"))
    return rows.select("id", F.size("s").alias("n"), F.sha2(F.array_join("s", "\n"), 256).alias("text_hash"))


def x05_compress(spark, d):
    """Answers compressed by their question's terms."""
    cases = delivered_once(table(spark, d, "eval_case"), "question").select(F.col("id").alias("case_id"), "question")
    rows = delivered_once(table(spark, d, "eval_case_result"), "case_id", "answer").join(cases, "case_id", "left")
    out = context.compress(rows, "question", "answer", Compression(enabled=True))
    return out.select("id", "compressed", F.round("ratio", 6).alias("ratio"))


def x07_context(spark, d):
    out = context.assemble(_sources(spark, d))
    return out.select("query_id", "n_sources", F.sha2("context", 256).alias("context_hash"))


def x09_citations(spark, d):
    """Citations of every answer against sources 1 to 3."""
    rows = delivered_once(table(spark, d, "eval_case_result"), "answer")
    out = context.check_citations(rows, "answer", F.array(F.lit(1), F.lit(2), F.lit(3)))
    text = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ",")
    return out.select("id", text("cited").alias("cited"), text("invalid").alias("invalid"), F.col("missing").cast("int").alias("missing"), F.col("valid").cast("int").alias("valid"))


def x10_repair(spark, d):
    """Invalid answers with a repair that cites the first source."""
    rows = delivered_once(table(spark, d, "eval_case_result"), "answer").where("answer is not null")
    rows = rows.withColumn("repair", F.concat(F.regexp_replace("answer", context.CITATION, ""), F.lit(" [1]")))
    out = context.repaired(rows, "answer", "repair", F.array(F.lit(1), F.lit(2), F.lit(3)))
    return out.select("id", "final_answer")


def m01_embedding(spark, d):
    """Stand-in embedding of the distinct chunk texts."""
    rows = chunks(spark, d, "content").where("content is not null").select("content").distinct()
    v = vector.hashed_embedding(F.col("content"))
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return rows.select(F.sha2("content", 256).alias("text_hash"), F.size(v).alias("dim"), F.round(total, 6).alias("total"))


def _sources(spark, d):
    """Final sources of every question with their places and texts."""
    final = cut(hybrid.cut_off(hybrid.rerank(_merged(spark, d)[2])).select("query_id", "rank", "id"))
    found = final.select("id").distinct()
    found = F.broadcast(found) if found.count() <= SENT_SOURCES else found  # else every text would be moved to be matched
    held = _delivered_chunks(spark, d, "chunk_index", asked=questions(spark, d)).join(found, "id", "left_semi")
    return final.join(delivered_once(held, "document_id", "chunk_index", "content"), "id")


def e02_run_cases(spark, d):
    """A whole evaluation run: retrieve, answer from the first source, check citations, measure against the golden chunks."""
    golden = delivered_once(table(spark, d, "eval_case"), "golden_chunks").select(F.col("id").alias("query_id"), "golden_chunks")
    row = F.struct("rank", F.concat_ws(":", "document_id", "chunk_index").alias("k"), "content")
    listed = _sources(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("s"))
    cases = questions(spark, d).select("query_id").join(golden, "query_id").join(listed, "query_id", "left")
    cases = cases.withColumn("s", F.coalesce("s", F.array().cast(cases.schema["s"].dataType)))
    cases = cases.select(
        "query_id", evaluate.golden_keys(F.col("golden_chunks")).alias("g"), F.transform("s", lambda x: x["k"]).alias("r"),
        F.transform("s", lambda x: x["rank"]).alias("n"), models.extractive_answer(F.get("s", F.lit(0))["content"]).alias("answer"),
    )
    m = evaluate.retrieval_metrics(F.col("g"), F.col("r"), 5)
    out = context.check_citations(cases, "answer", F.col("n"))
    return out.select(
        "query_id", F.size("n").alias("n_sources"), F.round(m["recall"], 6).alias("recall"), m["hit"].alias("hit"),
        F.round(m["mrr"], 6).alias("mrr"), F.col("valid").cast("int").alias("citation_valid"),
    )


def x11_prompt(spark, d):
    sources = context.assemble(_sources(spark, d))
    rows = questions(spark, d).join(sources, "query_id")
    return rows.select("query_id", F.sha2(models.answer_prompt(F.col("question"), F.col("context")), 256).alias("prompt_hash"))


def m05_overlap_rerank(spark, d):
    """The merged list reranked by the stand-in reranker."""
    merged = _merged_once(spark, d)[2]
    texts = scoped_chunks(spark, d).select("id", "content")
    scored = merged.join(texts, "id").join(questions(spark, d).select("query_id", "question"), "query_id")
    relevance = scored.select("query_id", "id", models.overlap_relevance(F.col("question"), F.col("content")).alias("relevance"))
    return hybrid.rerank(merged, relevance).select("query_id", "id", F.round("final_score", 6).alias("final_score"))


def m07_judge(spark, d):
    """Expected answers judged by the stand-in judge against their required words."""
    rows = delivered_once(table(spark, d, "eval_case"), "expected_answer", "required_keywords").where("expected_answer is not null")
    words = F.coalesce(F.from_json("required_keywords", "array<string>"), F.array().cast("array<string>"))
    raw = models.coverage_judge(F.col("expected_answer"), F.filter(words, lambda w: w.isNotNull()))
    return rows.select("id", F.round(evaluate.judge_scores(raw)["judge"], 4).alias("judge"))


QUERIES = {
    f.__name__: f
    for f in (
        e02_run_cases, x11_prompt, m05_overlap_rerank, m07_judge, h03_hybrid, v01_parse, v02_cosine, v03_embedding_topk, v03_vector_topk, v04_indexed_topk, v04_recall, v05_routed_topk, a01_corpus_stats, a02_document_frequency, b01_keywords,
        b04_bm25, b07_keyword_topk, b08_rule_score, r02_model_rerank, r03_retrieve, r04_cache_key, a12_funnel, q01_normalize,
        q04_rewrite, q05_model_rewrite, r03_rewritten, x01_sentences, x05_compress, x07_context, x09_citations, x10_repair, m01_embedding,
    )
}

_SCOPED = f"""with recursive {q.CHUNKS}, {q.DOCS}, {q.CASES},
asked as (select c.id as query_id, s.knowledge_base_id as scope, question from cases c join eval_dataset s on s.id = c.dataset_id
  where enabled = 1 and question is not null and s.knowledge_base_id is not null),
held as (select c.*, d.knowledge_base_id as scope from chunks c join docs d on d.id = c.document_id where status = 1 and d.knowledge_base_id is not null and content is not null)
"""


def _terms_cte(source: str, key: str) -> str:
    """CTEs that list each question's search terms in order, in steps that DuckDB evaluates once."""
    stop = "[" + ",".join(f"'{w}'" for w in keyword.STOP_WORDS) + "]"
    return f"""sq as (select {key} as k, {q.squashed("coalesce(question, '')")} as s from {source}),
tok as (select k, s, unnest(regexp_split_to_array(s, '[^a-z0-9一-龥]+')) as t, generate_subscripts(regexp_split_to_array(s, '[^a-z0-9一-龥]+'), 1) as i from sq),
good as (select * from tok where length(t) >= 2 and not list_contains({stop}, t)),
gram as (
  select k, i, 0 as n, 0 as j, t as g from good where not regexp_matches(t, '[一-龥]')
  union all select k, i, 2, j, substr(t, j, 2) from (select *, unnest(range(1, length(t))) as j from good where regexp_matches(t, '[一-龥]'))
  union all select k, i, 3, j, substr(t, j, 3) from (select *, unnest(range(1, length(t) - 1)) as j from good where regexp_matches(t, '[一-龥]') and length(t) >= 3)),
every as (
  select k, i, n, j, g from gram where n = 0 or not list_contains({stop}, g)
  union all select k, 1000000, 0, 0, {q.without('s', keyword.STOP_WORDS)} from sq where length({q.without('s', keyword.STOP_WORDS)}) > 0),
firsts as (select k, g, min((i, n, j)) as o from every group by k, g),
listed as (select k, g, row_number() over (partition by k order by o) as pos from firsts
  union all select k, s, 1 from sq where length(s) > 0 and k not in (select k from firsts)),
score_terms as (select k, g as term, pos from listed),
search_terms as (select * from score_terms where pos <= 8)"""


_NOISE = q.without(q.squashed("question"), keyword.PHRASE_NOISE)
_BM25 = (
    _SCOPED
    + f""", {_terms_cte('asked', 'query_id')},
ht as (select id, scope, lower(content) as l, {q.squashed('content')} as s,
  {q.squashed(r"regexp_extract(content, '(?m)^[ \t\x0b\f]*([^ \t\n\x0b\f\r][^\n\r]*)', 1)")} as title from held),
stats as (select scope, count(*) as n, avg(length(regexp_replace(content, '{q.BLANK}', '', 'g'))) as a from held group by scope),
wanted as (select query_id, scope, term, {_NOISE} as phrase, count(*) over (partition by query_id) as nt from asked join search_terms on k = query_id),
dfs as (select w.scope, w.term, count(*) as df from (select distinct scope, term from wanted) w join ht on ht.scope = w.scope and contains(ht.l, w.term) group by 1, 2),
pair as (select w.*, ht.id, ht.s, ht.l, ht.title, (length(ht.s) - length(replace(ht.s, w.term, ''))) / length(w.term) as tf from wanted w join ht on ht.scope = w.scope
  where contains(ht.s, w.term) or contains(ht.l, w.term)),
part as (select p.*, greatest(coalesce(df, 0), 1) as f, st.n, st.a, greatest(length(s), 1) as len from pair p left join dfs using (scope, term) join stats st using (scope)),
scored as (select query_id, id,
  sum(case when tf > 0 then ln(1 + (n - f + 0.5) / (f + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a)) else 0 end)
  + case when bool_or(length(phrase) >= 2 and contains(s, phrase)) then 0.5 else 0 end
  + 0.3 * sum(case when contains(title, term) then 1 else 0 end) / max(nt) as score
  from part group by query_id, id having bool_or(contains(l, term))),
kw as (select query_id, id, score as keyword_score, row_number() over (partition by query_id order by score desc, id) as keyword_rank from scored where score > 0
  qualify keyword_rank <= 50)"""
)
_QV = """list_transform(range(0, 32), lambda i: (('0x' || substr(sha256(question), i * 2 + 1, 2))::int - 127.5) / 127.5)"""
_HYBRID = (
    _BM25
    + f""",
hv as (select id, scope, list_transform(list_filter(list_transform(string_split(vector_id, ','), lambda x: trim(x)), lambda x: length(x) > 0),
  lambda x: try_cast(x as double)) as v from held where vector_id is not null),
okv as materialized (select id, scope, case when len(list_filter(v, lambda x: x is null)) = 0 then v end as v from hv where len(v) = 32 and len(list_filter(v, lambda x: x is null or isnan(x) or abs(x) >= 1e150)) = 0),
qv as (select query_id, scope, {_QV}::double[] as w from asked),
vec as (select query_id, id, case when list_max(list_transform(v, lambda x: abs(x))) > 0 then list_cosine_similarity(v::double[], w) else 0.0 end as similarity,
  row_number() over (partition by query_id order by similarity desc, id) as vector_rank from qv join okv using (scope) qualify vector_rank <= 50),
both_ as (select query_id, id, case when keyword_rank is not null then greatest(coalesce(similarity, 0.0), 0.0) else similarity end as similarity, keyword_score, vector_rank, keyword_rank,
  case when vector_rank is not null and keyword_rank is not null then 'HYBRID' when vector_rank is not null then 'VECTOR' else 'KEYWORD' end as source
  from vec full outer join kw using (query_id, id)),
sh as (select *, greatest(0, least(1, coalesce(similarity, 0))) * 0.6 + coalesce(keyword_score, 0) / (1 + coalesce(keyword_score, 0)) * 0.4 as hybrid_score from both_),
merged as (select *, row_number() over (partition by query_id order by hybrid_score desc, vector_rank nulls last, keyword_rank) as hybrid_rank from sh qualify hybrid_rank <= 80),
final as (select *, row_number() over (partition by query_id order by hybrid_score desc, hybrid_rank) as rank from merged where hybrid_score >= 0.2 qualify rank <= 3)"""
)
_SENTENCES = rf"list_filter(list_transform(regexp_extract_all(c, '[^。！？.!?\n]+[。！？.!?]?'), lambda x: {q.trimmed('x')}), lambda x: length(x) > 0)"


def _rewrite_sql() -> str:
    n = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(o), '[\r\n\t]+', ' ', 'g'), '[?？!！,，。；;：:]+', ' ', 'g'), '{q.BLANK}', ' ', 'g'), ' ')"
    for w in rewrite.QUESTION_NOISE:
        n = f"replace({n}, '{w}', ' ')"
    n = f"trim(regexp_replace({n}, '{q.BLANK}', ' ', 'g'), ' ')"
    lists = " union all ".join(
        f"select id, {i} * 100 + unnest(range(0, {len(v)})) as p, unnest([{','.join(f"'{x}'" for x in v)}]) as w from nq where contains(n, '{k}')"
        for i, (k, v) in enumerate(rewrite.SYNONYMS.items())
    )
    own = ", ".join(f"({-i - 1}, '{t}')" for i, t in enumerate(REWRITES))
    generic = ",".join(f"'{w}'" for w in rewrite.GENERIC_WORDS)
    return f"""with {q.CASES}, own(id, question) as (values {own}),
oq as (select id, {q.trimmed("coalesce(question, '')")} as o from (select id, question from cases union all select * from own)),
nq as (select id, o, {n} as n from oq),
syn as ({lists}),
ded as (select id, w, p from (select id, w, min(p) as p from syn group by id, w) qualify row_number() over (partition by id order by p) <= 8),
kws as (select id, list(w order by p) as kw from ded group by id),
j as (select nq.*, coalesce(kw, []) as kw from nq left join kws using (id)),
e as (select *, array_to_string(case when n <> '' then [n] || list_filter(kw, lambda x: x <> n) else kw end, ' ') as eq from j),
r as (select *, case when o = '' then 'ORIGINAL_EMPTY' when n = '' then 'NORMALIZED_EMPTY' when length(eq) > 3 * length(o) then 'QUERY_TOO_LONG'
  when len(list_filter(string_split(n, ' '), lambda x: not list_contains([{generic}], x))) = 0 then 'GENERIC_ONLY' end as reason from e)
select id, case when reason is null then eq else o end as rewritten, case when reason is null then array_to_string(kw, '|') else '' end as keywords, reason from r"""


def _normalize_sql() -> str:
    n = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(question), '[\r\n\t]+', ' ', 'g'), '[?？!！,，。；;：:]+', ' ', 'g'), '{q.BLANK}', ' ', 'g'), ' ')"
    for w in rewrite.QUESTION_NOISE:
        n = f"replace({n}, '{w}', ' ')"
    return f"with {q.CASES} select id, trim(regexp_replace({n}, '{q.BLANK}', ' ', 'g'), ' ') as normalized from cases where question is not null"


def _key_sql(user: str, documents: str, types: str) -> str:
    value = lambda x: f"coalesce(length(({x})::varchar) || ':' || ({x})::varchar, '-')"
    parts = {
        "question": "question", "user_id": user, "knowledge_base_id": "scope", "knowledge_base_ids": "null", "document_id": "null",
        "document_ids": f"'{documents}'" if documents else "null", "status": "1", "type": "null", "types": f"'{types}'" if types else "null",
        "vector_top_k": "50", "keyword_top_k": "50", "hybrid_top_k": "80", "final_top_k": "3", "min_final_score": "'0.2'", "vector_weight": "'0.6'", "keyword_weight": "'0.4'",
    }
    return "sha256(" + " || '|' || ".join(f"'{n}=' || {value(x)}" for n, x in parts.items()) + ")"


_LIST = "case when json_valid(golden_chunks) and json_type(golden_chunks) = 'ARRAY' then json_extract(golden_chunks, '$[*]') else []::json[] end"
_GOLDEN_KEY = (
    "case when json_type(x, '$.documentId') in ('UBIGINT', 'BIGINT') and json_type(x, '$.chunkIndex') in ('UBIGINT', 'BIGINT') "
    "then json_extract_string(x, '$.documentId') || ':' || json_extract_string(x, '$.chunkIndex') end"
)
_BLOCKS = """blocks as (select query_id, rank, '[' || rank || ']' || chr(10) || 'documentId: ' || document_id || chr(10) || 'chunkIndex: ' || chunk_index || chr(10) ||
  'content:' || chr(10) || content || chr(10) || chr(10) as b from final join held using (id))"""
_CITED = r"list_filter(list_transform(regexp_extract_all(coalesce(answer, ''), '\[([0-9]+)\]', 1), lambda x: try_cast(x as int)), lambda x: x is not null)"
ORACLE = {
    "e02_run_cases": _HYBRID
    + f""", golden as (select id as query_id, list_distinct(list_filter(list_transform({_LIST}, lambda x: {_GOLDEN_KEY}), lambda k: k is not null)) as g from cases),
src as (select query_id, list(document_id || ':' || chunk_index order by rank) as r from final join held using (id) group by query_id),
j as (select asked.query_id, g, coalesce(r, []) as r from asked join golden using (query_id) left join src using (query_id)),
m as (select *, len(list_filter(r, lambda x: list_contains(g, x))) as f, list_position(list_transform(r, lambda x: list_contains(g, x)), true) as p from j)
select query_id, len(r)::int as n_sources, round(case when len(g) > 0 then f / len(g) else 0.0 end, 6) as recall, (f > 0)::int as hit,
  round(case when f > 0 then 1.0 / p else 0.0 end, 6) as mrr, 1 as citation_valid from m""",
    "x11_prompt": _HYBRID
    + f""", {_BLOCKS}, ctx as (select query_id, string_agg(b, '' order by rank) as c from blocks group by query_id)
select query_id, sha256('Answer from the numbered sources only and cite each statement as [n]. Say so if they hold no answer.' || chr(10) || chr(10) || 'Question: ' ||
  question || chr(10) || chr(10) || 'Sources:' || chr(10) || c) as prompt_hash from asked join ctx using (query_id)""",
    "m05_overlap_rerank": _HYBRID
    + f""" select m.query_id, m.id, round(coalesce(count(term) filter (contains({q.squashed('content')}, term)) / nullif(count(term), 0), 0), 6) as final_score
  from merged m join held using (id) left join search_terms on k = m.query_id group by m.query_id, m.id""",
    "m07_judge": f"""with {q.CASES}, w as (select id, {q.squashed('expected_answer')} as s, list_filter(case when json_valid(required_keywords)
  and json_type(required_keywords) = 'ARRAY' then from_json(required_keywords, '["VARCHAR"]') else []::varchar[] end, lambda x: x is not null) as kw from cases where expected_answer is not null)
select id, round(round(coalesce(len(list_filter(kw, lambda k: contains(s, {q.squashed('k')}))) / nullif(len(kw), 0), 1.0) * 5, 2), 4) as judge from w""",
    "v01_parse": f"""with {q.CHUNKS}, p as (select id, list_transform(list_filter(list_transform(string_split(vector_id, ','), lambda x: trim(x)), lambda x: length(x) > 0),
  lambda x: try_cast(x as double)) as v from chunks where vector_id is not null),
r as (select id, case when len(list_filter(v, lambda x: x is null)) = 0 then v end as v from p) select id, len(v)::int as dim, round(v[1], 6) as first from r""",
    "v02_cosine": """select e.vec_id, round(list_cosine_similarity(e.embedding::double[], o.embedding::double[]), 6) as similarity
  from embeddings e, embeddings o where o.vec_id = 0""",
    "v03_embedding_topk": """select a.vec_id as query_id, b.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity,
  row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.vec_id) as vector_rank
  from embeddings a join embeddings b using (label) where a.vec_id % 100 = 0 qualify vector_rank <= 10""",
    "v04_recall": """with exact as (select a.vec_id as q, b.vec_id as i from embeddings a join embeddings b using (label) where a.vec_id % 100 = 0
  qualify row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.vec_id) <= 10)
select count(*) as neighbours, 1 as recalled from exact""",
    "v05_routed_topk": """select a.vec_id as query_id, b.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity,
  row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.vec_id) as vector_rank, 'IN_MEMORY' as source
  from embeddings a join embeddings b using (label) where a.vec_id % 100 = 0 qualify vector_rank <= 10""",
    "v03_vector_topk": _HYBRID + " select query_id, id, round(similarity, 6) as similarity, vector_rank from vec",
    "a01_corpus_stats": _BM25 + " select scope, n as n_chunks, round(a, 6) as avg_length from stats",
    "a02_document_frequency": _BM25 + " select scope, term, df from dfs",
    "b01_keywords": f"""with {q.CASES}, {_terms_cte('cases', 'id')}
select id, coalesce(t, '') as terms from cases left join (select k, string_agg(term, '|' order by pos) as t from search_terms group by k) on k = id""",
    "b04_bm25": _BM25 + " select query_id, id, round(score, 6) as score from scored",
    "b07_keyword_topk": _BM25 + " select query_id, id, round(keyword_score, 6) as keyword_score, keyword_rank from kw",
    "b08_rule_score": f"""with {q.CASES}, {q.RESULTS}, {_terms_cte('cases', 'id')},
a as (select r.id, r.case_id, {q.squashed('answer')} as s, {q.without(q.squashed('question'), keyword.STOP_WORDS)} as p from results r join cases c on c.id = r.case_id
  where answer is not null and question is not null),
h as (select a.id, s, p, count(term) as n, count(*) filter (contains(s, term)) as h from a left join score_terms on k = case_id group by a.id, s, p)
select id, case when n > 0 and length(s) > 0 then round(least(1.0, 0.75 * h / n + case when length(p) > 0 and contains(s, p) then 0.25 else 0 end), 6) else 0.0 end as score from h""",
    "h03_hybrid": _HYBRID
    + """ select query_id, id, round(similarity, 6) as similarity, round(keyword_score, 6) as keyword_score, round(hybrid_score, 6) as hybrid_score, source, hybrid_rank from merged""",
    "r03_retrieve": _HYBRID + " select query_id, rank, id, round(hybrid_score, 6) as final_score, source from final",
    "r02_model_rerank": _HYBRID
    + """ select query_id, id, round(case when bool_and(id % 7 <> 0) over (partition by query_id) then ((id * 37 + query_id) % 101) / 101 else hybrid_score end, 6) as final_score,
  case when bool_and(id % 7 <> 0) over (partition by query_id) or keyword_score is null then 1 else 0 end as no_keyword from merged""",
    "a12_funnel": _HYBRID
    + """, ids as (select query_id from vec union select query_id from kw) select query_id, (select count(*) from vec where vec.query_id = ids.query_id) as n_vector,
  (select count(*) from kw where kw.query_id = ids.query_id) as n_keyword, (select count(*) from merged where merged.query_id = ids.query_id) as n_merged,
  (select count(*) from final where final.query_id = ids.query_id) as n_final from ids""",
    "r04_cache_key": _SCOPED
    + f"""select query_id, {_key_sql('k.user_id', '', '')} as cache_key, {_key_sql('k.user_id + 1', '3,7', 'md,pdf')} as filtered_key
  from asked left join knowledge_base k on k.id = asked.scope""",
    "q01_normalize": _normalize_sql(),
    "q04_rewrite": _rewrite_sql(),
    "q05_model_rewrite": f"""with {q.CASES}, asked as (select id, question, id % 5 as kind from cases where question is not null and length(question) > 0)
select id, case kind when 0 then upper(question) when 1 then question end as vector_query, case when kind < 2 then question end as keyword_query,
  case when kind < 2 then 'a,b' end as keywords from asked where length(trim(question, ' ')) > 0
union all select id, null, null, null from asked where length(trim(question, ' ')) = 0""",
    "x01_sentences": f"""with {q.CHUNKS}, cc as (select id, {q.cleaned('content')} as c from chunks), ss as (select id, c, {_SENTENCES} as s from cc),
t as (select id, case when len(s) > 0 then s when length({q.trimmed('c')}) > 0 then [{q.trimmed('c')}] else []::varchar[] end as s from ss)
select id, len(s)::int as n, sha256(array_to_string(s, chr(10))) as text_hash from t""",
    "x05_compress": f"""with {q.CASES}, {q.RESULTS}, r as (select r.id, coalesce(answer, '') as a, coalesce(question, '') as question from results r left join cases c on c.id = r.case_id),
t as (select id, question, a, {q.cleaned('a')} as t, {q.without(q.squashed('question'), context.NOISE)} as phrase from r),
asked as (select question, {q.terms('question', 2, context.NOISE)} as terms from (select distinct question from r)),
h as (select t.*, terms, coalesce(list_filter(list_transform(string_split(t, chr(10)), lambda l: {q.trimmed('l')}), lambda l: {q.heading('l')})[1], '') as title,
  {_SENTENCES.replace('regexp_extract_all(c,', 'regexp_extract_all(t,')} as found from t join asked using (question)),
s as (select *, case when len(found) > 0 then found when length({q.trimmed('t')}) > 0 then [{q.trimmed('t')}] else []::varchar[] end as ss from h),
e as (select id, terms, phrase, title, unnest(ss) as s, generate_subscripts(ss, 1) as i from s),
p as (select id, s, i, len(list_filter(terms, lambda x: length(x) > 0 and contains({q.squashed('s')}, x))) + case when length(phrase) > 0 and contains({q.squashed('s')}, phrase) then 2 else 0 end as hits,
  s <> title as other from e),
b as (select id, string_agg(s, chr(10) order by i) as best from (select * from p where hits > 0 and other qualify row_number() over (partition by id order by hits + 1.0 / i desc, i) <= 4) group by id),
f as (select s.id, a, t, title, coalesce(best, '') as best, case when length(t) > 200 then {q.trimmed('substr(t, 1, 200)')} else t end as head from s left join b using (id)),
g as (select *, title || chr(10) || chr(10) || head as th, {q.trimmed("case when title <> '' then title || chr(10) || chr(10) || best else best end")} as tb from f),
d as (select id, a, case when length({q.trimmed('a')}) = 0 then '' when best <> '' then case when length(tb) > 800 then {q.trimmed('substr(tb, 1, 800)')} else tb end
  when title = '' or contains(head, title) then head when length(th) > 800 then {q.trimmed('substr(th, 1, 800)')} else th end as compressed from g)
select id, compressed, round(case when length(a) > 0 then length(compressed) / length(a) else 0.0 end, 6) as ratio from d""",
    "x07_context": _HYBRID
    + """, blocks as (select query_id, rank, '[' || rank || ']' || chr(10) || 'documentId: ' || document_id || chr(10) || 'chunkIndex: ' || chunk_index || chr(10) ||
  'content:' || chr(10) || content || chr(10) || chr(10) as b from final join held using (id))
select query_id, count(*) as n_sources, sha256(string_agg(b, '' order by rank)) as context_hash from blocks group by query_id""",
    "x09_citations": f"""with {q.RESULTS}, c as (select id, list_distinct({_CITED}) as cited from results), i as (select *, list_filter(cited, lambda x: x not in (1, 2, 3)) as invalid from c)
select id, array_to_string(list_sort(list_transform(cited, lambda x: x::varchar)), ',') as cited,
  array_to_string(list_sort(list_transform(invalid, lambda x: x::varchar)), ',') as invalid,
  (len(cited) = 0)::int as missing, (len(cited) > 0 and len(invalid) = 0)::int as valid from i""",
    "x10_repair": rf"""with {q.RESULTS}, c as (select id, answer, list_distinct({_CITED}) as cited from results where answer is not null)
select id, case when len(cited) > 0 and len(list_filter(cited, lambda x: x not in (1, 2, 3))) = 0 then answer
  else regexp_replace(answer, '\[([0-9]+)\]', '', 'g') || ' [1]' end as final_answer from c""",
    "m01_embedding": f"""with {q.CHUNKS}, t as (select distinct content as question from chunks where content is not null)
select sha256(question) as text_hash, 32 as dim, round(list_sum({_QV}), 6) as total from t""",
}
