"""Keyword retrieval: query terms, corpus statistics, BM25 with boosts, top-k.

Queries are a DataFrame (query_id, scope, question), chunks one of (id, scope,
content); a query searches the chunks of its scope (a knowledge base). Terms
match as substrings of the squashed text, so all distinct terms and phrases are
looked for in one pass over each chunk by an automaton, in blocks of a bounded
number of terms; hits are flags and counts, so no text leaves that pass, and
everything after it is equi-joins on (scope, term).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.config import Bm25
from sievework.functions import text as tx
from sievework.session import cut

# --- Fixed values ---------------------------------------------------------------
#: Question words that are no search terms.
STOP_WORDS = [
    "什么", "怎么", "如何", "为什么", "是否", "请问", "一下", "一个", "这个", "那个",
    "的是", "是啥", "是什么", "有哪些", "多少", "以及", "和", "与", "的",
]
#: Words that are left out of a question before it is looked for as a phrase.
PHRASE_NOISE = ["什么", "怎么", "如何", "为什么", "是否", "请问", "这个", "那个", "有哪些", "多少", "以及", "和", "的", "是"]
# --------------------------------------------------------------------------------

#: Terms of one automaton at most; a hundred thousand short terms take some tens of MB of a worker.
TERM_BLOCK = 100_000
#: Chunks and queries of a scope that meet in one task, about.
CHUNK_BLOCK = 32_768
QUERY_BLOCK = 16_384


def _quoted(words: list[str]) -> str:
    return "array(" + ",".join(f"'{w}'" for w in words) + ")"


def ngram_terms(tokens: Column, shortest: int, stop_words: list[str]) -> Column:
    """Terms of squashed tokens: those with Chinese characters give their n-grams up to three, others themselves."""
    stop = F.expr(_quoted(stop_words))

    def grams(t: Column) -> Column:
        parts = [
            F.when(
                F.length(t) >= n,
                F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: t.substr(i, F.lit(n))),
            ).otherwise(F.array().cast("array<string>"))
            for n in range(shortest, 4)
        ]
        return F.filter(F.concat(*parts), lambda g: ~F.array_contains(stop, g))

    kept = F.filter(tokens, lambda t: (F.length(t) >= shortest) & ~F.array_contains(stop, t))
    return F.flatten(F.transform(kept, lambda t: F.when(tx.has_cjk(t), grams(t)).otherwise(F.array(t))))


def score_terms(question: Column) -> Column:
    """All terms of a question in order: tokens or n-grams, then the whole phrase; the question itself if none."""

    def of(squashed: Column) -> Column:
        tokens = F.split(squashed, "[^a-z0-9一-龥]+")
        phrase = tx.without_words(squashed, STOP_WORDS)
        last = F.when(F.length(phrase) > 0, F.array(phrase)).otherwise(F.array().cast("array<string>"))
        terms = F.array_distinct(F.concat(ngram_terms(tokens, 2, STOP_WORDS), last))
        return F.when(F.size(terms) > 0, terms).when(F.length(squashed) > 0, F.array(squashed)).otherwise(F.array().cast("array<string>"))

    return tx.let(tx.squash(F.coalesce(question, F.lit(""))), of)


def search_terms(question: Column, most: int = 8) -> Column:
    """The first `most` terms."""
    return F.slice(score_terms(question), 1, most)


def _counter(scopes_of: dict[str, set]):
    """Counts the terms in each chunk of one of the scopes that they are asked in."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in scopes_of:
            automaton.add_word(t, t)
        automaton.make_automaton()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for key, scope, squashed, lowered, title in zip(*(batch.column(i).to_pylist() for i in range(5))):
                found: dict[str, list[int]] = {}
                for end, t in automaton.iter(squashed):
                    hit = found.get(t)
                    if hit is None:
                        found[t] = [1, end]
                    elif end - len(t) >= hit[1]:
                        hit[0] += 1
                        hit[1] = end
                raw = {t for _, t in automaton.iter(lowered)}
                for t in found.keys() | raw:
                    if scope in scopes_of[t]:
                        row = (key, scope, t, found.get(t, (0,))[0], t in raw, t in title, max(len(squashed), 1))
                        for c, v in zip(out, row):
                            c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["id", "scope", "term", "tf", "raw", "titled", "len"])

    return count


def match_terms(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, scope, term, tf, raw, titled, len) of the terms (scope, term) found in the chunks (id, scope, content) of their scope.

    tf: non-overlapping occurrences in the squashed text, len its length;
    raw: whether the text as it is has the term; titled: whether the first line
    has. The distinct terms are taken in hash blocks of about TERM_BLOCK; only
    one block is on the driver at a time and travels with its pass over the chunks.
    """
    distinct = terms.where("length(term) > 0").groupBy("term").agg(F.collect_set("scope").alias("scopes"))
    n = distinct.count()
    blocks = max(1, -(-n // TERM_BLOCK))
    texts = chunks.where("content is not null").select(
        F.col("id").cast("bigint").alias("id"), F.col("scope").cast("bigint").alias("scope"), tx.squash(F.col("content")).alias("s"),
        F.lower("content").alias("l"), tx.squash(tx.first_filled_line(F.col("content"))).alias("t"),
    )
    schema = "id bigint, scope bigint, term string, tf bigint, raw boolean, titled boolean, len bigint"
    result = None
    for b in range(blocks):
        mine = {r["term"]: set(r["scopes"]) for r in distinct.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).collect()}
        found = (texts if mine else texts.limit(0)).mapInArrow(_counter(mine or {"\0": set()}), schema)
        result = found if result is None else result.unionByName(found)
    return result


def _packer(scopes_of: dict[str, set], ids: dict[str, int], part: int):
    """As _counter(), with a row for each chunk: its hits as the terms' numbers and 4 tf + 2 raw + titled."""
    schema = pa.schema([("id", pa.int64()), ("scope", pa.int64()), ("part", pa.int32()), ("size", pa.int32()), ("len", pa.int32()), ("terms", pa.list_(pa.int32())), ("marks", pa.list_(pa.int32()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sized(source):
            for batch in source:
                sizes.append(batch)
                yield pa.RecordBatch.from_arrays(batch.columns[:5], names=batch.schema.names[:5])

        sizes: list[pa.RecordBatch] = []
        for hits in _counter(scopes_of)(sized(batches)):
            batch = sizes.pop()
            row_of = {key: i for i, key in enumerate(batch.column(0).to_pylist())}
            terms: list[dict[int, int]] = [{} for _ in range(batch.num_rows)]
            for key, t, tf, raw, titled in zip(*(hits.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                terms[row_of[key]][ids[t]] = 4 * tf + 2 * raw + titled
            order = [sorted(x) for x in terms]
            first = [row_of[key] == i for i, key in enumerate(batch.column(0).to_pylist())]  # copies of a row may come along
            out = (
                batch.column(0), batch.column(1), pa.array([part] * batch.num_rows, pa.int32()), batch.column(5).cast(pa.int32()), batch.column(6).cast(pa.int32()),
                pa.array(order, pa.list_(pa.int32())), pa.array([[x[t] for t in o] for x, o in zip(terms, order)], pa.list_(pa.int32())),
            )
            yield pa.RecordBatch.from_arrays(list(out), schema=schema).filter(pa.array(first))

    return pack


def packed_hits(chunks: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, scope, part, size, len, terms, marks) of every chunk, written, and (term, number).

    What match_terms() finds in a row for each chunk and block of terms (part):
    numbers of the terms and 4 tf + 2 raw + titled, in order. size: characters
    without white space; len: of the squashed text, at least 1. Chunks delivered
    more than once count once.
    """
    spark = chunks.sparkSession
    distinct = terms.where("length(term) > 0").groupBy("term").agg(F.collect_set("scope").alias("scopes"))
    blocks = max(1, -(-distinct.count() // TERM_BLOCK))
    squashed = tx.squash(F.col("content"))
    texts = chunks.where("content is not null").select(
        F.col("id").cast("bigint").alias("id"), F.col("scope").cast("bigint").alias("scope"), squashed.alias("s"),
        F.lower("content").alias("l"), tx.squash(tx.first_filled_line(F.col("content"))).alias("t"),
        F.length(F.regexp_replace("content", tx.BLANKS, "")).alias("size"), F.greatest(F.length(squashed), F.lit(1)).alias("len"),
    )
    schema = "id bigint, scope bigint, part int, size int, len int, terms array<int>, marks array<int>"
    found = numbers = None
    n = 0
    for b in range(blocks):
        mine = {r["term"]: set(r["scopes"]) for r in distinct.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).collect()}
        ids = {t: n + i for i, t in enumerate(sorted(mine))}
        n += len(ids)
        hits = texts.mapInArrow(_packer(mine or {"\0": set()}, ids, b), schema)
        own = spark.createDataFrame(pa.table({"term": pa.array(ids.keys(), pa.string()), "number": pa.array(ids.values(), pa.int32())}))
        found, numbers = (hits, own) if found is None else (found.unionByName(hits), numbers.unionByName(own))
    return cut(found.dropDuplicates(["id", "part"])), numbers


def scope_statistics(chunks: DataFrame) -> DataFrame:
    """(scope, n_chunks, avg_length) of the chunks with content; length without white space."""
    return chunks.where("content is not null").groupBy("scope").agg(
        F.count("*").alias("n_chunks"), F.avg(F.length(F.regexp_replace("content", tx.BLANKS, ""))).alias("avg_length")
    )


def kept_statistics(chunks: DataFrame, path: str, ttl_seconds: int = 300) -> DataFrame:
    """scope_statistics() from the table at path where they are younger than ttl_seconds; others are counted and stored.

    The table has a folder for each time of counting, so what is stored never
    changes while it is read; the newest row of a scope counts.
    """
    spark = chunks.sparkSession
    schema = "scope bigint, n_chunks bigint, avg_length double, counted_at timestamp"
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)
    stored = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    fresh = stored.where(F.col("counted_at") > F.current_timestamp() - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    missing = chunks.join(fresh.select("scope").distinct(), "scope", "left_anti") if there else chunks
    counted = scope_statistics(missing).withColumn("counted_at", F.current_timestamp())
    counted.select("scope", "n_chunks", "avg_length", "counted_at").write.mode("append").parquet(path)
    newest = spark.read.schema(schema).parquet(path).groupBy("scope").agg(F.max_by(F.struct("n_chunks", "avg_length"), "counted_at").alias("s"))
    return newest.select("scope", "s.*")


def _wanted(queries: DataFrame) -> DataFrame:
    """(query_id, scope, n_terms, term, phrase) of all search terms and phrases."""
    asked = queries.select("query_id", "scope", "question", search_terms(F.col("question")).alias("terms"))
    phrase = tx.without_words(tx.squash(F.col("question")), PHRASE_NOISE)
    wanted = asked.select("query_id", "scope", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"), F.lit(False).alias("phrase"))
    phrases = asked.where("size(terms) > 0").select("query_id", "scope", F.size("terms").alias("n_terms"), phrase.alias("term"), F.lit(True).alias("phrase"))
    return wanted.unionByName(phrases.where("length(term) >= 2"))


def bm25(queries: DataFrame, chunks: DataFrame, config: Bm25 = Bm25()) -> DataFrame:
    """(query_id, id, bm25, phrase_hit, title_hits, score) of all chunks that hold a search term as it is.

    The prefilter is on the text as it is, term frequencies on the squashed
    one; document frequencies count texts as they are, at least 1.
    """
    c = config.checked()
    wanted = _wanted(queries)
    hits = cut(match_terms(chunks, wanted))  # read twice below
    frequency = hits.where("raw").groupBy("scope", "term").agg(F.count("*").alias("df"))
    stats = scope_statistics(chunks)
    pairs = wanted.join(hits, ["scope", "term"]).join(frequency, ["scope", "term"], "left").join(stats, "scope")
    df = F.greatest(F.coalesce("df", F.lit(0)), F.lit(1))
    n = F.greatest("n_chunks", F.lit(1))
    average = F.when(F.col("avg_length") > 0, F.col("avg_length")).otherwise(c.average_length)
    idf = F.ln(1 + (n - df + 0.5) / (df + 0.5))
    saturated = F.col("tf") * (c.k1 + 1) / (F.col("tf") + c.k1 * (1 - c.b + c.b * F.col("len") / average))
    is_term = ~F.col("phrase")
    return (
        pairs.groupBy("query_id", "id")
        .agg(
            F.sum(F.when(is_term & (F.col("tf") > 0), idf * saturated).otherwise(0.0)).alias("bm25"),
            F.bool_or(F.col("raw") & is_term).alias("raw"),
            F.bool_or(F.col("phrase") & (F.col("tf") > 0)).alias("phrase_hit"),
            F.sum((F.col("titled") & is_term).cast("int")).alias("title_hits"),
            F.max("n_terms").alias("n_terms"),
        )
        .where("raw")
        .withColumn(
            "score",
            F.col("bm25")
            + F.when(F.col("phrase_hit"), c.phrase_boost).otherwise(0.0)
            + c.title_boost * F.col("title_hits") / F.col("n_terms"),
        )
        .drop("raw")
    )


def keyword_top_k(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, id, keyword_score, keyword_rank) of the k best positive scores per query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        scored.where("score > 0")
        .withColumn("keyword_rank", F.row_number().over(order))
        .where(F.col("keyword_rank") <= k)
        .select("query_id", "id", F.col("score").alias("keyword_score"), "keyword_rank")
    )


def bm25_top_k(queries: DataFrame, chunks: DataFrame, k: int, config: Bm25 = Bm25()) -> DataFrame:
    """keyword_top_k() of bm25(), without a row for each pair of a query and a chunk that share a term.

    Hits are written once, in a row for each chunk. Queries and chunks of a scope
    meet in blocks of a bounded size; each pair of blocks keeps k per query, and
    the winners of the blocks are ranked last.
    """
    c = config.checked()
    wanted = cut(_wanted(queries))
    hits, numbers = packed_hits(chunks, wanted)
    stats = hits.where("part = 0").groupBy("scope").agg(F.count("*").alias("n_chunks"), F.avg("size").alias("avg_length"))
    each = hits.select("scope", F.explode(F.arrays_zip("terms", "marks")).alias("h")).where("h.marks & 2 = 2")
    frequency = each.groupBy("scope", F.col("h.terms").alias("number")).agg(F.count("*").alias("df"))
    df = F.greatest(F.coalesce("df", F.lit(0)), F.lit(1))
    n = F.greatest("n_chunks", F.lit(1))
    rated = wanted.join(numbers, "term").join(frequency, ["scope", "number"], "left").join(F.broadcast(stats), "scope").select(
        "query_id", "scope", "n_terms", "phrase", "number", F.ln(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"), "n_chunks",
        F.when(F.col("avg_length") > 0, F.col("avg_length")).otherwise(c.average_length).alias("average"),
    )
    term = F.when(~F.col("phrase"), F.struct("number", "idf"))
    asked = cut(
        rated.groupBy("query_id", "scope").agg(
            F.max("n_terms").alias("n_terms"), F.max("average").alias("average"), F.max("n_chunks").alias("n_chunks"),
            F.array_sort(F.collect_list(term)).alias("terms"), F.max(F.when(F.col("phrase"), F.col("number"))).alias("phrase"),
        )
    )
    grid = F.broadcast(
        asked.groupBy("scope").agg(F.ceil(F.max("n_chunks") / CHUNK_BLOCK).cast("int").alias("blocks"), F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("q_blocks"))
    )
    spread = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
    own = lambda key, x: F.pmod(F.xxhash64(key), F.col(x)).cast("int")
    left = asked.join(grid, "scope").select(
        "scope", spread("blocks").alias("b"), own("query_id", "q_blocks").alias("q"), "query_id", "n_terms", "average", "phrase",
        F.col("terms.number").alias("numbers"), F.col("terms.idf").alias("idfs"),
    )
    right = hits.where("size(terms) > 0").join(grid, "scope").select(
        "scope", own("id", "blocks").alias("b"), spread("q_blocks").alias("q"), "id", "len", "terms", "marks"
    )

    def block(lefts: pa.Table, rights: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
        if not lefts.num_rows or not rights.num_rows:
            return schema.empty_table()
        rights = rights.combine_chunks()
        listed = rights["terms"].combine_chunks()
        ids, chunk = np.unique(rights["id"].to_numpy(), return_inverse=True)  # a chunk has a row for each block of terms
        at = np.repeat(chunk, np.diff(listed.offsets.to_numpy()))
        numbers, marks = listed.flatten().to_numpy(), rights["marks"].combine_chunks().flatten().to_numpy()
        order = np.lexsort((at, numbers))
        at, numbers, marks = at[order], numbers[order], marks[order]
        lens = np.zeros(len(ids))
        lens[chunk] = rights["len"].to_numpy()
        tf = (marks >> 2).astype(np.float64)
        saturated = tf * (c.k1 + 1) / (tf + c.k1 * (1 - c.b + c.b * lens[at] / lefts["average"][0].as_py()))
        keys, starts = np.unique(numbers, return_index=True)
        span = {t: slice(x, y) for t, x, y in zip(keys.tolist(), starts.tolist(), [*starts[1:].tolist(), len(numbers)])}
        score, raw, titles, found = np.zeros(len(ids)), np.zeros(len(ids), bool), np.zeros(len(ids)), []
        for query, n_terms, phrase, terms, idfs in zip(*(lefts[x].to_pylist() for x in ("query_id", "n_terms", "phrase", "numbers", "idfs"))):
            score[:], raw[:], titles[:] = 0.0, False, 0.0
            for t, idf in zip(terms, idfs):
                if (s := span.get(t)) is not None:  # a chunk is once among a term's hits
                    i, m = at[s], marks[s]
                    score[i] += idf * saturated[s]
                    raw[i] |= (m & 2) > 0
                    titles[i] += m & 1
            if (s := span.get(phrase)) is not None:
                score[at[s]] += np.where(tf[s] > 0, c.phrase_boost, 0.0)
            some = np.flatnonzero(raw)
            value = score[some] + c.title_boost * titles[some] / n_terms
            some, value = some[value > 0], value[value > 0]
            if len(value) > k:
                good = value >= np.partition(value, len(value) - k)[len(value) - k]
                some, value = some[good], value[good]
            best = np.argsort(-value, kind="stable")[:k]  # ids ascend
            found.append((np.full(len(best), query), ids[some[best]], value[best]))
        return pa.table([np.concatenate(x) for x in zip(*found)], schema=schema)

    keys = ["scope", "b", "q"]
    return keyword_top_k(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, "query_id bigint, id bigint, score double"), k)


def rule_score(terms: Column, phrase: Column, squashed: Column) -> Column:
    """Share of terms found (0.6 and, as the text has no lines left, 0.15 for the title) and phrase (0.25), at most 1."""
    share = F.size(F.filter(terms, lambda t: F.contains(squashed, t))) / F.size(terms)
    said = F.when((F.length(phrase) > 0) & F.contains(squashed, phrase), 0.25).otherwise(0.0)
    score = F.least(F.lit(1.0), share * 0.6 + said + share * 0.15)
    return F.when((F.size(terms) > 0) & (F.length(squashed) > 0), score).otherwise(0.0)
