import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.config import Compression, Dedup, Retrieval, Rewrite, Splitting
from sievework.operators import context, dedup, evaluate, hybrid, keyword, rewrite, split, vector


def test_cosine_and_parse(spark):
    rows = [("1,2,", "2,4"), ("1,x", "1,2"), ("0,0", "1,1"), ("1", "1,1"), (None, "1"), ("", "1")]
    df = spark.createDataFrame(rows, "a string, b string").select(vector.parse(F.col("a")).alias("a"), vector.parse(F.col("b")).alias("b"))
    got = [r[0] for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1.0) and got[1:] == [0.0] * 5


def test_top_k_equals_brute_force(spark):
    random.seed(1)
    rows = [(i, i % 2, [random.gauss(0, 1) for _ in range(4 if i % 9 else 3)]) for i in range(120)] + [(500, 0, None), (501, 0, [])]
    df = spark.createDataFrame(rows, "id long, scope long, vector array<double>")
    asked = df.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["id"]): r["vector_rank"] for r in vector.top_k(asked, df, 3).collect()}

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    want = {}
    for q, s, v in rows[:120:10]:
        near = sorted((-cos(v, w), i) for i, t, w in rows[:120] if t == s and len(w) == len(v))[:3]
        want.update({(q, i): n + 1 for n, (_, i) in enumerate(near)})
    assert got == want


def test_search_terms(spark):
    rows = [("缓存击穿是什么？",), ("cache penetration, redis",), ("   ",), (None,), ("?",), ("是什么",)]
    got = [r[0] for r in spark.createDataFrame(rows, "q string").select(keyword.search_terms(F.col("q"))).collect()]
    assert got[0][:3] == ["缓存", "存击", "击穿"] and len(got[0]) == 8
    assert got[1] == ["cachepenetration", "redis", "cachepenetration,redis"]
    assert got[2] == [] and got[3] == [] and got[4] == ["?"] and got[5] == ["是"]


def test_term_matching_counts_without_overlap(spark, monkeypatch):
    rows = [(1, 7, "aaaa b\n a a"), (2, 7, None), (3, 7, ""), (4, 8, "aa"), (5, None, "aa")]
    chunks = spark.createDataFrame(rows, "id long, scope long, content string")
    terms = spark.createDataFrame([(7, "aa"), (7, "b"), (7, "ba"), (7, ""), (8, "b")], "scope long, term string")
    want = {(1, "aa"): (3, True, True, 7), (1, "b"): (1, True, True, 7), (1, "ba"): (1, False, False, 7)}
    for block in (100, 1):  # all terms at once, and one at a time
        monkeypatch.setattr(keyword, "TERM_BLOCK", block)
        got = {(r["id"], r["term"]): (r["tf"], r["raw"], r["titled"], r["len"]) for r in keyword.match_terms(chunks, terms).collect()}
        assert got == want
    assert keyword.match_terms(chunks, terms.limit(0)).count() == 0


def test_statistics_are_kept_until_they_are_old(spark, tmp_path):
    path = f"file://{tmp_path}/statistics"
    chunks = spark.createDataFrame([(1, 7, "ab c"), (2, 7, "abcde"), (3, 8, None)], "id long, scope long, content string")
    more = chunks.union(spark.createDataFrame([(4, 7, "x"), (5, 9, "xyz")], chunks.schema))
    read = lambda df, ttl=300: {r["scope"]: (r["n_chunks"], r["avg_length"]) for r in keyword.kept_statistics(df, path, ttl).collect()}
    assert read(chunks) == {7: (2, 4.0)}
    assert read(more) == {7: (2, 4.0), 9: (1, 3.0)}  # 7 is kept, 9 is new
    assert read(more, ttl=0)[7] == (3, 3.0)


def test_hybrid_merge_and_cut(spark):
    v = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, -0.5, 2)], "query_id long, id long, similarity double, vector_rank int")
    k = spark.createDataFrame([(1, 11, 3.0, 1), (1, 12, 1.0, 2)], "query_id long, id long, keyword_score double, keyword_rank int")
    m = {r["id"]: r for r in hybrid.merge(v, k).collect()}
    assert m[10]["hybrid_score"] == pytest.approx(0.54) and m[10]["source"] == "VECTOR"
    assert m[11]["similarity"] == 0.0 and m[11]["source"] == "HYBRID" and m[11]["hybrid_score"] == pytest.approx(0.3)
    merged = hybrid.merge(v, k)
    kept = hybrid.cut_off(hybrid.rerank(merged), Retrieval(min_final_score=0.25, final_top_k=5)).collect()
    assert [r["id"] for r in sorted(kept, key=lambda r: r["rank"])] == [10, 11]
    scores = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.9)], "query_id long, id long, relevance double")
    assert {r["id"]: r["keyword_score"] for r in hybrid.rerank(merged, scores).collect()}[11] == 3.0  # one is missing: fallback
    full = scores.union(spark.createDataFrame([(1, 12, 0.5)], scores.schema))
    assert {r["id"]: r["final_score"] for r in hybrid.rerank(merged, full).collect()} == {10: 0.1, 11: 0.9, 12: 0.5}


def test_rewrite(spark):
    df = spark.createDataFrame([("Redis 是什么？",), (" ",), ("是吗",), ("缓存",), (None,)], "q string")
    got = [(r["rewritten"], r["reason"]) for r in rewrite.rewrite(df, "q", Rewrite(max_growth=9)).collect()]
    assert got == [("redis 缓存 key", None), ("", "ORIGINAL_EMPTY"), ("是吗", "NORMALIZED_EMPTY"), ("缓存", "GENERIC_ONLY"), ("", "ORIGINAL_EMPTY")]
    off = rewrite.rewrite(df, "q", Rewrite(enabled=False)).first()
    assert off["reason"] == "DISABLED"
    raw = '```json\n{"vectorQuery":"a b","keywordQuery":"a","expandedKeywords":null}\n```'
    reply = spark.createDataFrame([(raw, "a?"), ("none", "a"), ('{"vectorQuery":"","keywordQuery":"x"}', "a")], "r string, o string")
    rows = [r[0] for r in reply.select(rewrite.model_rewrite(F.col("r"), F.col("o"))).collect()]
    assert rows[0]["vector_query"] == "a b" and rows[0]["normalized"] == "a?" and rows[1] is None and rows[2] is None
    assert rewrite.load_synonyms("/nowhere") == rewrite.SYNONYMS


def test_compression(spark):
    text = "第一章 总览\n缓存可以提速。天气很好。缓存会失效！"
    df = spark.createDataFrame([("缓存", text), ("缓存", None), ("缓存", " "), ("无关", "abc. def."), (None, "x.")], "q string, c string")
    got = [(r["compressed"], round(r["ratio"], 3)) for r in context.compress(df, "q", "c", Compression(enabled=True)).collect()]
    assert got[0][0] == "第一章 总览\n\n缓存可以提速。\n缓存会失效！"
    assert got[1] == ("", 0.0) and got[2] == ("", 0.0) and got[3][0] == "abc. def." and got[4][0] == "x."
    assert context.compress(df, "q", "c", Compression()).first()["compressed"] == text


@pytest.mark.parametrize(
    "answer,sources,want",
    [("a [1][2]", [1, 2], (True, False, [])), ("a", [1], (False, True, [])), ("a [1][3]", [1, 2], (False, False, [3])), ("a [1][1]", [1], (True, False, [])), ("a [99999999999]", [1], (False, True, [])), (None, None, (True, False, []))],
)
def test_citations(spark, answer, sources, want):
    df = spark.createDataFrame([(answer, sources)], "a string, s array<int>")
    r = context.check_citations(df, "a", F.col("s")).first()
    assert (r["valid"], r["missing"], r["invalid"]) == want


@pytest.mark.parametrize(
    "golden,found,k,want",
    [(["10:1", "20:2"], ["99:1", "10:1", "20:2"], 5, (1.0, 1, 0.5)), (["10:1", "20:2"], ["99:1", "10:1", "88:1", "20:2"], 3, (0.5, 1, 0.5)), (["10:1"], ["99:1"], 5, (0.0, 0, 0.0)), ([], ["1:1"], 5, (0.0, 0, 0.0)), (["1:1"], ["1:1"], 0, (0.0, 0, 0.0))],
)
def test_metrics(spark, golden, found, k, want):
    df = spark.createDataFrame([(golden, found)], "g array<string>, r array<string>")
    m = evaluate.retrieval_metrics(F.col("g"), F.col("r"), k)
    r = df.select(m["recall"], m["hit"], m["mrr"]).first()
    assert tuple(r) == want


def test_judge(spark):
    raws = ['{"correctness":5,"completeness":4,"faithfulness":3,"relevance":2,"citationQuality":1}', '```json\n{"correctness":9,"completeness":-2,"faithfulness":3}\n```', "none", None]
    df = spark.createDataFrame([(r,) for r in raws], "r string")
    s = evaluate.judge_scores(F.col("r"))
    got = df.select(*[v.alias(k) for k, v in s.items()]).collect()
    assert got[0]["judge"] == pytest.approx(3.45)
    assert (got[1]["correctness"], got[1]["completeness"], got[1]["faithfulness"]) == (5.0, 0.0, 3.0)
    assert got[2]["judge"] == 0.0 and got[3]["judge"] == 0.0


RUN = "id long, hit_rate_at_5 double, avg_recall_at_5 double, avg_mrr double, citation_valid_rate double, missing_citation_rate double, avg_latency_ms double"
CASE = (
    "id long, run_id long, case_id long, hit_at_5 int, recall_at_5 double, mrr double, citation_valid int, missing_citation int, invalid_citations string, "
    "latency_ms long, correctness_score double, completeness_score double, faithfulness_score double, relevance_score double, citation_quality_score double"
)


def test_diagnosis(spark):
    runs = spark.createDataFrame([(1, 0.25, 0.25, 0.1, 1.0, 0.0, 1200.0), (2, None, None, None, None, None, None)], RUN)
    miss = lambda i: (i, 1, i, 0, 0.0, 0.0, 1, 0, "[]", 100, 5.0, 5.0, 5.0, 5.0, 5.0)
    cases = spark.createDataFrame([miss(1), miss(2), (3, 1, 3, 1, 1.0, 1.0, 1, 0, "[]", 100, 5.0, 5.0, 5.0, 5.0, 5.0), miss(4)], CASE)
    d = {(r["run_id"], r["rank"]): r for r in evaluate.diagnose(runs, cases).collect()}
    assert d[1, 1]["bottleneck"] == "RETRIEVAL_RECALL" and d[1, 1]["priority"] == "HIGH" and d[1, 1]["affected_cases"] == 3
    assert d[2, 1]["bottleneck"] == "RETRIEVAL_RECALL" and d[2, 1]["problem_score"] == 1.0
    e: dict[str, list] = {}
    for r in evaluate.evidence(cases, stretch=2).orderBy("bottleneck", "place").collect():
        e.setdefault(r["bottleneck"], []).append(r["case_id"])
        assert r["place"] == len(e[r["bottleneck"]])
    assert e["RETRIEVAL_RECALL"] == [1, 2, 4]


def test_length_split():
    text = "第一句介绍基础内容。第二句继续补充上下文。第三句说明新的内容。第四句用于结束测试。"
    chunks = split.lengths(text, 24, 10)
    assert len(chunks) > 1 and chunks[1].startswith(("第二句", "第三句"))
    assert split.with_title("第二章 JVM\n\nbody", ["第二章 JVM\n\nx", "y"]) == ["第二章 JVM\n\nx", "第二章 JVM\n\ny"]
    assert split.rule_chunks(None) == [] and split.rule_chunks("") == []
    random.seed(2)
    for _ in range(300):
        t = "".join(random.choice("ab 。.\n") for _ in range(random.randint(1, 80)))
        size = random.randint(1, 20)
        for c in split.lengths(t, size, random.randint(0, 25)):
            assert 0 < len(c) <= size


def test_paragraphs_and_semantic(spark):
    long = "句子内容很多很多。" * 100
    parts = split.paragraphs("# T\n\nshort\n\n" + long, Splitting())
    assert parts[0] == "# T" and all(len(p) >= 80 for p in parts[1:-1]) and "".join(parts[1:]).replace("\n", "") == "short" + long
    df = spark.createDataFrame([(1, "第二章 JVM\n\nJVM运行时数据区包括堆和虚拟机栈。"), (2, None), (3, "")], "id long, t string")
    rows = split.semantic_chunks(df, "id", "t", vector.hashed_embedding).collect()
    assert [(r["id"], r["chunk_no"], r["chunk"]) for r in rows] == [(1, 1, "第二章 JVM\n\nJVM运行时数据区包括堆和虚拟机栈。")]


def test_dedup(spark):
    a, b = "x" * 40, "# head\n" + "x" * 40
    rows = [(1, 1, a), (2, 1, a + " "), (3, 1, b), (4, 1, "tiny"), (5, 1, "tiny"), (6, 2, a), (7, 1, None), (8, 1, " ")]
    df = spark.createDataFrame(rows, "id long, document_id long, content string")
    assert {r["id"]: r["kept"] for r in dedup.exact(df, ["id"]).collect()} == {1: True, 2: False, 3: False, 4: True, 5: True, 6: True}
    words = [f"w{i}" for i in range(100)]
    near = [(1, 1, " ".join(words)), (2, 1, " ".join(words[:-1] + ["q"])), (3, 1, " ".join(reversed(words))), (4, 2, " ".join(words)), (5, 1, None)]
    df = spark.createDataFrame(near, "id long, document_id long, content string")
    assert [(r["a"], r["b"]) for r in dedup.similar_pairs(df).collect()] == [(1, 2)]
    chain = spark.createDataFrame([(1, 1, 2), (1, 2, 3)], "document_id long, a long, b long")
    alone = spark.createDataFrame([(1, i, i) for i in (1, 2, 3)] + [(1, 9, 3), (2, 4, 4)], "document_id long, id long, rep long")
    assert sorted(r["id"] for r in dedup.greedy_kept(chain, alone).collect()) == [2, 9]


def test_greedy_rounds_and_classes_equal_brute_force(spark):
    rng = random.Random(17)
    words = [f"w{i}" for i in range(80)]
    rows, n = [], 0
    for doc in (1, 2, None):
        base = list(words)
        for _ in range(25):
            n += 1
            if rng.random() < 0.6:
                base[rng.randrange(80)] = rng.choice("xyz") * 2
            rows.append((n, doc, " ".join(base)))
    df = spark.createDataFrame(rows, "id long, document_id long, content string")
    grams = {i: {c[j : j + 5] for j in range(len(c) - 4)} for i, _, t in rows for c in [t.replace(" ", "")]}
    classes = dedup.body_classes(df)
    rep = {r["id"]: r["rep"] for r in classes.collect()}
    same = lambda i, d: min(k for k, e, _ in rows if e == d and grams[k] == grams[i])
    assert rep == {i: same(i, d) for i, d, _ in rows}
    near = lambda i, j: len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.9
    kept, gone = [], set()
    for i, d, _ in rows:
        if d is not None and any(e == d and near(i, k) for k, e in kept):
            gone.add(i)
        else:
            kept.append((i, d))
    got = {r["id"] for r in dedup.greedy_kept(dedup.similar_pairs(None, classes=classes), classes).where("document_id is not null").collect()}
    assert got == gone and len(gone) > 10


def test_reuse(spark):
    t = "same text that is long enough to be reused"
    chunks = spark.createDataFrame([(1, 1, t, "1,2"), (2, 2, t, None), (3, 3, t, "1,2"), (4, 4, t, "1,2")], "id long, document_id long, content string, vector_id string")
    docs = spark.createDataFrame([(1, 7, 1), (2, 7, 1), (3, 7, 2), (4, 8, 1)], "id long, knowledge_base_id long, status int")
    assert {r["id"]: r["source_id"] for r in dedup.reusable(chunks, docs).collect()} == {2: 1, 3: 1}


def _random_vectors(spark, n=1200, groups=30):
    import numpy as np

    rng = np.random.default_rng(21)
    x = rng.normal(size=(groups, 16))[rng.integers(0, groups, n)] + 0.3 * rng.normal(size=(n, 16))
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(x)] + [(9000, 0, [1.0, 2.0]), (9001, 1, None), (9002, 1, []), (9003, None, [1.0] * 16)]
    return spark.createDataFrame(rows, "id long, scope long, vector array<double>")


def test_indexed_top_k_has_the_recall(spark):
    from sievework.operators import vector, vector_index

    held = _random_vectors(spark)
    asked = held.where("id % 20 = 0").selectExpr("id as query_id", "scope", "vector")
    cells = vector_index.fit(held, vector_index.Index(sample=600))
    assert set(cells) == {2, 16} and cells[16].visits < len(cells[16].centroids) / 2
    found = {(r["query_id"], r["id"]) for r in vector_index.top_k(asked, vector_index.build(held, cells), cells, 5).collect()}
    exact = {(r["query_id"], r["id"]) for r in vector.top_k(asked, held, 5).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    none = held.limit(0)
    assert vector_index.fit(none) == {} and vector_index.build(none, {}).count() == 0


def test_router_falls_back(spark):
    from sievework.operators import vector, vector_index

    held = _random_vectors(spark, n=200, groups=4)
    asked = held.where("id in (0, 1, 9000)").selectExpr("id as query_id", "scope", "vector")
    routed = vector_index.routed_top_k(asked, held, 3).collect()
    source = {r["query_id"]: r["source"] for r in routed}
    assert source == {0: "INDEX", 1: "INDEX", 9000: "IN_MEMORY"}  # 9000 has fewer than three of its size
    plain = vector_index.routed_top_k(asked, held, 3, "IN_MEMORY").collect()
    assert {r["source"] for r in plain} == {"IN_MEMORY"} and len(plain) == 7
    assert vector_index.routed_top_k(asked, held.limit(0), 3).count() == 0
    assert vector.top_k(asked, held, 3).count() == 7


def test_index_upsert_delete_and_collection_check(spark):
    import pytest

    from sievework.operators import vector_index

    index = spark.createDataFrame([(1, 7, [1.0, 0.0]), (2, 7, [0.0, 1.0]), (3, 8, None)], "id long, document_id long, vector array<double>")
    fresh = spark.createDataFrame([(2, 7, [5.0, 5.0]), (4, 9, [2.0, 2.0])], "id long, document_id long, vector array<double>")
    after = {r["id"]: r["vector"] for r in vector_index.upsert(index, fresh).collect()}
    assert after == {1: [1.0, 0.0], 2: [5.0, 5.0], 3: None, 4: [2.0, 2.0]}
    gone = spark.createDataFrame([(7,), (7,)], "document_id long")
    assert [r["id"] for r in vector_index.delete_documents(index, gone).collect()] == [3]
    vector_index.create_or_check(index, 2)
    vector_index.create_or_check(index.limit(0), 1024)
    with pytest.raises(ValueError, match="configured=1024, actual=2"):
        vector_index.create_or_check(index, 1024)


def test_cache_keys_differ_by_user_and_filters(spark):
    from pyspark.sql import functions as F

    from sievework.config import Retrieval
    from sievework.operators.documents import Scope
    from sievework.operators.hybrid import cache_key

    one = spark.range(1)
    scopes = [Scope(), Scope(user_id=1), Scope(user_id=2), Scope(document_ids=(1, 2)), Scope(document_id=12), Scope(status=2), Scope(types=("pdf",)), Scope(type="pdf"), Scope(knowledge_base_id=1)]
    keys = [cache_key(F.lit("why"), s) for s in scopes] + [cache_key(F.lit("why"), Scope(), Retrieval(final_top_k=5)), cache_key(F.lit("how"), Scope()), cache_key(F.lit(None).cast("string"), Scope())]
    row = one.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).first()
    assert len(set(row)) == len(keys)
    same = one.select(cache_key(F.lit("why"), Scope(document_ids=(2, 1, 2))).alias("k")).first()[0]
    assert same == row["k3"]


def test_scratch_folders_are_deleted(spark, tmp_path):
    import os

    import pytest

    from sievework import session

    spark.range(5).transform(session.cut).count()
    path = session.scratch(spark, "cut").removeprefix("file://")
    assert os.path.isdir(path) and session.discard_scratch(spark) >= 2 and not os.path.exists(path)

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "applicationId": "a"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Elsewhere)


def test_similar_pairs_of_common_phrases_equal_brute_force(spark, monkeypatch):
    """Texts that share many shingles without being similar are no candidates, whatever the buckets and copies of rows."""
    rng = random.Random(5)
    phrases = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(40)]
    rows, n = [], 0
    for doc in (1, 2, 3):
        for _ in range(60):
            text = "".join(rng.choice(phrases) for _ in range(rng.choice([1, 4, 12, 40])))
            for _ in range(rng.choice([1, 1, 1, 3])):
                n += 1
                at = rng.randrange(len(text))
                rows.append((n, doc, text if rng.random() < 0.3 else text[:at] + "~" * rng.choice([1, 2, 4]) + text[at + 1 :]))
    df = spark.createDataFrame(rows + rows[::7], "id long, document_id long, content string")
    grams = {i: {c[j : j + 5] for j in range(max(1, len(c) - 4))} for i, _, c in rows}
    first = {i: min(k for k, e, _ in rows if e == d and grams[k] == grams[i]) for i, d, _ in rows}
    reps = [(i, d) for i, d, _ in rows if first[i] == i]
    jaccard = lambda i, j: len(grams[i] & grams[j]) / len(grams[i] | grams[j])
    for rows_each, t in ((16384, 0.9), (40, 0.75)):
        monkeypatch.setattr(dedup, "BUCKET_ROWS", rows_each)
        want = {(i, j): jaccard(i, j) for i, d in reps for j, e in reps if d == e and i < j and jaccard(i, j) >= t}
        got = {(r["a"], r["b"]): r["jaccard"] for r in dedup.similar_pairs(df, Dedup(threshold=t)).collect()}
        assert got == want and len(want) > 20
    sets = pa.RecordBatch.from_pylist([{"document_id": d, "id": i, "s": c} for i, d, c in rows])
    candidates = dedup._agreeing(pa.Table.from_batches(dedup._signatures(iter([sets]), 5, 0.9, {}, 1)), 0.9).num_rows
    every = [(jaccard(i, j), grams[i] & grams[j]) for i, d, _ in rows for j, e, _ in rows if d == e and i < j]
    assert sum(x >= 0.9 for x, _ in every) <= candidates < sum(bool(g) for _, g in every) / 20


def test_classes_carry_one_text_each_and_copies_of_rows_none(spark):
    """No shingle hashes are written: a class has the text of its first chunk, its other members have numbers only."""
    rows = [(1, 7, "some longer text"), (2, 7, "some longer  text"), (3, 7, "another text"), (4, None, "some longer text"), (5, 7, " ")]
    classes = dedup.body_classes(spark.createDataFrame(rows + rows, "id long, document_id long, content string"))
    assert not [t for _, t in classes.dtypes if t.startswith("array")]
    assert sorted((r["id"], r["rep"], r["s"]) for r in classes.collect()) == [(1, 1, "somelongertext"), (2, 1, None), (3, 3, "anothertext"), (4, 4, "somelongertext")]


def test_keyword_top_k_by_blocks_equals_ranking_all_pairs(spark, monkeypatch):
    """One row of hits for each chunk and k rows for each query and block, not one for each term or pair that meets."""
    rng = random.Random(3)
    words = ["缓存", "击穿", "redis", "index", "向量", "检索", "重排", "chunk", "query", "node"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, i % 3, text(rng.randint(1, 6)) + "\n" + text(rng.randint(1, 12))) for i in range(240)] + [(500, 0, None), (501, 1, " ")]
    chunks = spark.createDataFrame(rows, "id long, scope long, content string")
    queries = spark.createDataFrame([(i, i % 4, text(rng.randint(1, 4))) for i in range(40)] + [(90, 0, "?"), (91, 1, None)], "query_id long, scope long, question string")
    want = {(r["query_id"], r["id"]): (round(r["keyword_score"], 9), r["keyword_rank"]) for r in keyword.keyword_top_k(keyword.bm25(queries, chunks), 7).collect()}
    for terms, held, asked in ((100, 32768, 16384), (9, 20, 5)):
        monkeypatch.setattr(keyword, "TERM_BLOCK", terms)
        monkeypatch.setattr(keyword, "CHUNK_BLOCK", held)
        monkeypatch.setattr(keyword, "QUERY_BLOCK", asked)
        found = keyword.bm25_top_k(queries, chunks.union(chunks.where("id % 5 = 0")), 7).collect()
        assert {(r["query_id"], r["id"]): (round(r["keyword_score"], 9), r["keyword_rank"]) for r in found} == want and len(found) == len(want) > 150
    monkeypatch.setattr(keyword, "TERM_BLOCK", 100)
    hits, _ = keyword.packed_hits(chunks, queries.select("scope", F.explode(keyword.search_terms(F.col("question"))).alias("term")))
    assert hits.count() == 241


def test_vector_top_k_of_equal_vectors_keeps_id_order(spark, monkeypatch):
    rng = random.Random(8)
    same = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(7)]
    held = spark.createDataFrame([(i, 1, same[i % 7]) for i in range(333)], "id long, scope long, vector array<double>")
    asked = spark.createDataFrame([(q, 1, [rng.gauss(0, 1) for _ in range(32)]) for q in range(21)], "query_id long, scope long, vector array<double>")
    monkeypatch.setattr(vector, "CHUNK_BLOCK", 50)
    monkeypatch.setattr(vector, "PRODUCT_ROWS", 4, raising=False)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in b))
    best = {r["query_id"]: max(range(7), key=lambda j: cos(r["vector"], same[j])) for r in asked.collect()}
    got = {(r["query_id"], r["vector_rank"]): r["id"] for r in vector.top_k(asked, held, 30).collect()}
    assert got == {(q, n + 1): j + 7 * n for q, j in best.items() for n in range(30)}


def test_only_chunks_of_asked_scopes_are_read_on(spark):
    """Texts of sources come from chunks of the asked bases alone, which are chosen before copies of rows are dropped."""
    from sievework.plans import retrieval_queries as r

    d = "/root/testdata/sf0.001"
    asked = r.questions(spark, d).where("scope is not null").orderBy("scope").limit(1)
    scope = asked.first()["scope"]
    every = r.scoped_chunks(spark, d)
    got = {x["id"] for x in r._delivered_chunks(spark, d, asked=asked).collect()}
    assert got == {x["id"] for x in every.where(F.col("scope") == scope).collect()} and len(got) < every.count()
    assert {x["id"] for x in r._sources(spark, d).collect()} <= {x["id"] for x in every.collect()}


def test_vectors_move_in_their_blocks_alone(spark):
    """The grid of blocks is sent to the vectors; they aren't moved by scope to meet it, however large it is thought to be."""
    rows = [(i, i % 3, [float(i % 7 - 3), 1.0]) for i in range(60)]
    held = spark.createDataFrame(rows, "id long, scope long, vector array<double>")
    asked = held.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = vector.top_k(asked, held, 5)
        plan = found._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("BroadcastHashJoin") == 2 and found.count() == 15


def test_texts_of_sources_alone_are_moved(spark, monkeypatch):
    """Chunks are matched with the sources where they lie; with more sources than are sent, the same rows are found by a join."""
    from sievework.plans import retrieval_queries as r

    d = "/root/testdata/sf0.001"
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = r._sources(spark, d)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert not [x for x in plan.splitlines() if "SortMergeJoin" in x and "LeftSemi" in x]
        monkeypatch.setattr(r, "SENT_SOURCES", 0, raising=False)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, r._sources(spark, d).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_prompts_move_texts_of_their_sources_alone(spark):
    from sievework.plans import retrieval_queries as r

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = r.x11_prompt(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert not [x for x in plan.splitlines() if "SortMergeJoin" in x and "LeftSemi" in x]
