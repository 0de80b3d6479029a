import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import distinctive, markup, mixing, neighbours, pairs, ranking, repetition, splitting, tokenizer

BPE = tokenizer.place_of(tokenizer.BYTE_BPE_50K)


# --- distinctive terms ---------------------------------------------------------
def test_z_scores_equal_brute_force(spark):
    texts = {1: "alpha alpha alpha beta gamma", 2: "beta beta Straße straße÷x", 3: None, 4: "", 5: "abc", 6: "beta " * 50}
    df = spark.createDataFrame(list(texts.items()), "id long, content string")
    got = {(r["id"], r["term"]): r for r in distinctive.distinctive_terms(df, "id", "content", prior=10.0).collect()}
    counts = {k: Counter(re.findall("[a-zß-öø-ÿ]{4,}", (t or "").lower())) for k, t in texts.items()}
    cf = sum(counts.values(), Counter())
    total = sum(cf.values())
    assert set(got) == {(k, w) for k, c in counts.items() for w in c}
    for (k, w), r in got.items():
        n, a = sum(counts[k].values()), 10.0 * cf[w] / total
        i, o = counts[k][w] + a, cf[w] - counts[k][w] + a
        z = (math.log(i / (n + 10 - i)) - math.log(o / (total - n + 10 - o))) / math.sqrt(1 / i + 1 / o)
        assert r["z"] == pytest.approx(z) and r["df"] == sum(w in c for c in counts.values())
    assert distinctive.distinctive_terms(df.limit(0), "id", "content").count() == 0


def test_z_puts_planted_terms_first(spark):
    random.seed(13)
    common = [f"{a}{b}" for a in ("cache", "index", "queue", "table") for b in ("read", "write", "lock", "full", "cold")]
    texts = [[random.choice(common) for _ in range(random.randint(20, 60))] for _ in range(200)]
    planted = {(i, f"zeta{w}") for w in "abcde" for i in random.sample(range(200), 4)}
    for i, w in planted:
        texts[i] += [w] * random.randint(3, 5)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, content string")
    rows = distinctive.distinctive_terms(df, "id", "content").collect()
    z = {(r["id"], r["term"]): r["z"] for r in rows}
    for i, w in planted:
        rivals = [v for (k, t), v in z.items() if k == i and (k, t) not in planted]
        assert z[i, w] > max(rivals) and z[i, w] >= 1.96
    assert sum(v >= 1.96 for v in z.values()) < 0.05 * len(z)


def test_only_term_of_the_collection(spark):
    df = spark.createDataFrame([(1, "same same")], "id long, content string")
    assert distinctive.distinctive_terms(df, "id", "content").first()["z"] == 0.0


# --- defective pairs -----------------------------------------------------------
LONG = "The shared cache rejects the stale index. The broker signs the log"


@pytest.mark.parametrize(
    "question,answer,message,defect",
    [
        ("Why does the cache fail?", None, None, "empty"),
        ("Why does the cache fail?", " \u200b ", "stream closed early", "empty"),
        ("Why does the cache fail?", "[1][2]", None, "empty"),
        ("Why does the cache fail?", "N/A", None, "empty"),
        ("Why does the cache fail?", "21", None, None),
        ("Why does the cache fail?", "Port 80.", None, None),
        ("Why does the cache fail?", "why does the cache fail", None, "echo"),
        ("Why does the cache fail?", "> Why does the cache fail? [1]", None, "echo"),
        ("Why does the cache fail?", 'You asked "Why does the cache fail?" Here is the answer. The lock is full.', None, None),
        ("Why does the cache fail?", "Hello. I don't know. Please upload more material.", None, "refusal"),
        ("为什么缓存失效？", "感谢提问。抱歉，我无法回答这个问题。", None, "refusal"),
        ("Why does the cache fail?", 'The lock is full. The client then shows "I am sorry, I cannot help" at times.', None, None),
        ("Why does the cache fail?", LONG, None, "truncated"),
        ("Why does the cache fail?", LONG + ".", "finish reason length", "truncated"),
        ("Why does the cache fail?", LONG + ". The causes are:", None, "truncated"),
        ("Why does the cache fail?", "1. " + LONG + ".\n2.", None, "truncated"),
        ("Why does the cache fail?", "1. " + LONG + ".\n2. It is full in region 3.", None, None),
        ("Why does the cache fail?", LONG + ".\n```\nset a=1", None, "truncated"),
        ("Why does the cache fail?", LONG + ".\n```\nset a=1\n```", "judge skipped: slow model", None),
        ("Why does the cache fail?", "Der kalte Speicher füllt den Puffer und die Sperre ist voll.", None, "language"),
        ("Auf Englisch antworten bitte: Warum ist der Speicher voll?", "The cache is full and the lock is held.", None, None),
        ("请用英文回答：为什么缓存失效？", "因为锁已经满了，所以缓存不可用。", None, "language"),
        (None, "Der kalte Speicher füllt den Puffer und die Sperre ist voll.", None, None),
        ("", "x" * 100_000 + ".", None, None),
    ],
)
def test_defects(question, answer, message, defect):
    assert pairs.defect_of(question, answer, message, False, False) == defect


@pytest.mark.parametrize("shortened", [False, True])
@pytest.mark.parametrize("at_limit", [False, True])
@pytest.mark.parametrize("boilerplate", [False, True])
def test_evidence_decides(shortened, at_limit, boilerplate):
    def defect(answer):
        return pairs.defect_of("q", answer, None, shortened, at_limit, boilerplate)

    refused = "refusal" if boilerplate else None
    for answer in ("Zeitplan 2024", "stage 12 of (the plan)"):  # open ends
        assert defect(answer) == (refused or ("truncated" if shortened or at_limit else None))
    assert defect("The plan has twelve stages.") == (refused or ("truncated" if shortened and at_limit else None))
    assert defect(LONG) == (refused or "truncated") and defect("...") == "empty"


def _planted(spark):
    """Cases that only neighbours, only length limits, or only boilerplate can show."""
    words = "amber birch cedar delta ember flint grove heath inlet jetty knoll larch".split()
    rows = [(1, "Hirsagon stage 12345", None), (1, "Hirsagon stage 12345 is closed by the gate at night.", None)]
    rows += [(2 + i, f"The {w} gate is closed by the {v} valve at night {'x' * (40 + i)}.", None) for i, (w, v) in enumerate(zip(words, words[1:]))]
    rows += [(40 + i, "12345678 " * 12 + f"({i:02d}abcde)", None) for i in range(40)]  # all of one length
    rows += [(100 + i, "Ask the keeper of the tower. The tower is not mine to speak of.", None) for i in range(12)]
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "id long, case_id long, answer string, error_message string")


def test_each_step_of_the_evidence_changes_the_result(spark, monkeypatch):
    results = _planted(spark)
    cases = spark.createDataFrame([(i, "Which gate is it?") for i in range(200)], "id long, question string")
    full = {(r["result_id"], r["defect"]) for r in pairs.defective_pairs(results, cases).collect()}
    assert (0, "truncated") in full and sum(d == "refusal" for _, d in full) == 12 and sum(d == "truncated" for _, d in full) == 41
    none = {
        "shortened_answers": lambda df, *a: df.select("case_id", "answer").limit(0),
        "length_limits": lambda df, *a: df.selectExpr("length(answer) as length").limit(0),
        "boilerplate_answers": lambda df, *a: df.select("id").limit(0),
    }
    for step, lost in (("shortened_answers", 1), ("length_limits", 40), ("boilerplate_answers", 12)):
        with monkeypatch.context() as m:
            m.setattr(pairs, step, none[step])
            less = {(r["result_id"], r["defect"]) for r in pairs.defective_pairs(results, cases).collect()}
        assert less < full and len(full) - len(less) == lost, step


def test_boilerplate_needs_many_questions(spark):
    rows = [(i, i % 3, "Ask the keeper of the tower.") for i in range(30)] + [(50 + i, i, "192 ms") for i in range(30)] + [(90, 9, None), (91, 9, "")]
    df = spark.createDataFrame(rows, "id long, case_id long, answer string")
    assert pairs.boilerplate_answers(df, "id", "case_id", "answer").count() == 0
    assert pairs.boilerplate_answers(df, "id", "case_id", "answer", many=3).count() == 30


def test_rules_read_whole_texts():
    long = "a complete sentence stands here. " * 200
    assert not pairs.is_unfinished("{{{ " + long + "}}}")
    assert not pairs.is_unfinished("`x " + long.replace("\n", " ") + "`")
    filler = "The warm index keeps the old entries of the day. " * 3
    question = filler + "Please answer in German. " + filler
    assert pairs.wanted_language(question) == "de" and pairs.wanted_language(filler * 2) == "en"
    far = filler + "The text is in German. " + filler + "Please answer."
    assert pairs.wanted_language(far) == "en"


def test_shortened_versions_and_limits(spark):
    rows = [(1, LONG), (1, LONG + " of the day."), (2, LONG + " of the day."), (1, "short"), (1, None), (1, LONG)]
    df = spark.createDataFrame(rows, "case_id long, answer string")
    assert [tuple(r) for r in pairs.shortened_answers(df, "case_id", "answer").collect()] == [(1, LONG)]
    rows = [("a" * (100 + i),) for i in range(40)] + [("b" * 120,)] * 60
    assert [r[0] for r in pairs.length_limits(spark.createDataFrame(rows, "answer string"), "answer").collect()] == [120]


def test_pairs_with_clashing_columns_and_missing_cases(spark):
    results = spark.createDataFrame([(1, 1, None, None, 9), (2, 5, "Fine, it is the lock.", None, 9)], "id long, case_id long, answer string, error_message string, defect int")
    cases = spark.createDataFrame([(1, "Why?")], "id long, question string")
    assert [tuple(r) for r in pairs.defective_pairs(results, cases).collect()] == [(1, "empty")]
    assert pairs.defective_pairs(results.limit(0), cases.limit(0)).count() == 0


# --- nearest vectors -----------------------------------------------------------
def test_parse_vector():
    assert neighbours.parse_vector("[3, 4,]").tolist() == pytest.approx([0.6, 0.8])
    for bad in (None, "", ",", "0,0", "1,NaN", "1,inf", "a,b", "1_0,2", "1e999,1"):
        assert neighbours.parse_vector(bad) is None
    assert neighbours.parse_vector("1e300,1e300").tolist() == pytest.approx([0.5**0.5] * 2)


def _vectors(spark, rows):
    return neighbours.unit_vectors(spark.createDataFrame(rows, "id long, v string"), "id", "v")


def test_near_pairs_equal_brute_force_with_hot_bucket(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 16))
    base[:100] = base[0] + 0.001 * rng.normal(size=(100, 16))  # a hot bucket
    base[300:350] = base[250:300] + 0.02 * rng.normal(size=(50, 16))
    rows = [(i, ",".join(f"{x:.6f}" for x in v)) for i, v in enumerate(base)] + [(1000, None), (1001, "1,2,3"), (5, ",".join(f"{x:.6f}" for x in base[5]))]
    search = neighbours.Search(k=5, min_similarity=0.97, block_rows=32, bucket_rows=40)
    got = neighbours.nearest(_vectors(spark, rows), search).collect()
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -1)
    for q in (3, 50, 260, 320, 399):
        want = sorted(sim[q][sim[q] >= 0.97])[::-1][:5]
        mine = sorted((r["similarity"] for r in got if r["query_id"] == q), reverse=True)
        assert mine == pytest.approx(want, abs=1e-5)


def test_copies_are_neighbours_of_each_other(spark):
    rows = [(i, "1,2,3" if i % 2 else "[2, 4, 6]") for i in range(20)] + [(50, "1,2,3.01"), (51, "-1,0,0")]
    got = neighbours.nearest(_vectors(spark, rows), neighbours.Search(k=3, min_similarity=0.9))
    per = Counter(r["query_id"] for r in got.collect())
    assert all(per[i] == 3 for i in range(20)) and per[50] == 3 and 51 not in per


def test_queries_for_some_and_recall(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16))
    rows = [(i, ",".join(f"{c:.5f}" for c in v)) for i, v in enumerate(x)]
    search = neighbours.Search(k=5, tables=6, probes=16, projections=4)
    got = neighbours.nearest(_vectors(spark, rows), search, only="id % 50 = 0").collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = sum(r["neighbour_id"] in np.argsort(-(unit @ unit[r["query_id"]]))[1:6] for r in got)
    assert hits >= 0.9 * 5 * 30 and {r["query_id"] for r in got} == set(range(0, 1500, 50))


def test_recall_holds_at_every_size():
    search = neighbours.Search(min_similarity=0.97, probes=1)
    last = (0, 0)
    for n in (10**3, 10**5, 10**7, 10**9, 10**11):
        m = search.projections_for(n)
        tables = search.tables_for(m)
        missed = (1 - neighbours.success(neighbours.Search(probes=1, seed=99), m, 0.97)) ** tables if m else 0.0
        assert missed <= 0.07 and (m, tables) >= last
        last = (m, tables)
    assert last[1] > search.tables
    assert search.tables_for(20, all_ask=False) > search.tables_for(20)


def test_success_is_that_of_the_index(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.97 * x + (1 - 0.97**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(i, ",".join(f"{c:.7f}" for c in v)) for i, v in enumerate(np.concatenate([x, y]))]
    search = neighbours.Search(min_similarity=0.96, probes=1, tables=1, projections=12, recall=0.01)
    pairs_ = {(r["query_id"], r["neighbour_id"]) for r in neighbours.nearest(_vectors(spark, rows), search).collect()}
    found = sum((i, i + 600) in pairs_ for i in range(600)) / 600
    assert found == pytest.approx(neighbours.success(search, 12, 0.97), abs=0.12)
    exact = neighbours.Search(min_similarity=0.96, exact=True, block_rows=256)
    every = {(r["query_id"], r["neighbour_id"]) for r in neighbours.nearest(_vectors(spark, rows), exact).collect()}
    assert all((i, i + 600) in every and (i + 600, i) in every for i in range(600))


# --- rank fusion ---------------------------------------------------------------
def test_average_ranks(spark):
    random.seed(4)
    rows = [(random.choice("ab"), random.choice([-1e9, -0.5, 0.0, 1e-9, 0.3, 2.0, 1e12, random.random()])) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, v double")
    for r in ranking.average_ranks(df, ["g"], "v").collect():
        values = sorted(v for g, v in rows if g == r["g"])
        assert r["low"] == values.index(r["v"]) + 1 and r["high"] == r["low"] + values.count(r["v"]) - 1


SCORES = {"a": True, "b": False}


def test_dominant_items_lead(spark):
    rows = [(1, 1, 9.0, 1), (1, 2, 5.0, 1), (1, 3, 9.0, 7), (2, 4, 1.0, 1), (2, 5, 1.0, 1), (3, 6, 1.0, 1), (4, 7, None, 1), (4, 8, float("nan"), 2), (5, 9, 2.0, 5), (5, 10, 1.0, 1)]
    df = spark.createDataFrame(rows, "run long, id long, a double, b long")
    r = ranking.fused_ranking(df, "run", "id", SCORES)
    assert {(x["run"], x["id"]): x["rank"] for x in r.collect()} == {(1, 1): 1, (1, 2): 2, (1, 3): 2, (2, 4): 1, (2, 5): 1, (3, 6): 1, (5, 9): 1, (5, 10): 1}
    assert [tuple(x) for x in ranking.dominant(r, "run", "id", SCORES).collect()] == [(1, 1)]
    assert ranking.fused_ranking(df.limit(0), "run", "id", SCORES).count() == 0


def _correlation(ranks):
    c = np.corrcoef(ranks, rowvar=False)
    return np.where(np.isnan(c), 0.0, c)


def test_loadings_are_the_first_component_or_the_best_without_negative_ones():
    rng = np.random.default_rng(3)
    mixed = 0
    for _ in range(60):
        x = rng.normal(size=(30, 4)) + rng.normal(size=(30, 1)) * rng.choice([-1.0, 0.3, 1.0, 2.0], size=4)
        c = _correlation(x)
        got = ranking.oriented_component(c[None])[0]
        v = np.linalg.eigh(c)[1][:, -1]
        assert np.linalg.norm(got) == pytest.approx(1.0) and (got >= 0).all()
        if (v > 0).all() or (v < 0).all():
            assert got == pytest.approx(np.abs(v), abs=1e-6)
            continue
        mixed += 1
        tried = np.abs(rng.normal(size=(4000, 4))) * rng.integers(0, 2, size=(4000, 4))
        tried = tried[tried.any(1)]
        tried /= np.linalg.norm(tried, axis=1, keepdims=True)
        assert got @ c @ got >= np.einsum("ni,ij,nj->n", tried, c, tried).max() - 1e-9
    assert mixed > 5
    against = np.array([[1, 0.8, -0.7], [0.8, 1, -0.7], [-0.7, -0.7, 1]])
    assert ranking.oriented_component(against[None])[0] == pytest.approx([0.5**0.5, 0.5**0.5, 0])
    for same in (np.eye(3), np.array([[1.0, -1.0], [-1.0, 1.0]])):
        assert ranking.oriented_component(same[None])[0] == pytest.approx(len(same) ** -0.5)
    assert ranking.oriented_component(np.zeros((2, 3, 3))).tolist() == [[0.0] * 3] * 2


def test_ranking_equals_brute_force(spark):
    import pandas as pd

    rng = np.random.default_rng(4)
    rows = [(run, 100 * run + i, float(rng.integers(0, 6)), float(rng.normal()), int(rng.integers(1, 9))) for run in range(8) for i in range(int(rng.integers(1, 30)))]
    frame = pd.DataFrame(rows, columns=["run", "id", "a", "b", "c"])
    scores = {"a": True, "b": True, "c": False}
    made = ranking.fused_ranking(spark.createDataFrame(frame), "run", "id", scores)
    got = {r["id"]: r for r in made.collect()}
    leaders = {r["id"] for r in ranking.dominant(made, "run", "id", scores).collect()}
    want = set()
    for _, g in frame.groupby("run"):
        up = g[["a", "b"]].assign(c=-g["c"])
        z = ((up.rank() - 1) / (len(g) - 1)).to_numpy() if len(g) > 1 else np.ones((1, 3))
        w = ranking.oriented_component(_correlation(z)[None])[0] if len(g) > 1 else np.zeros(3)
        p = np.round(z @ w, 9)
        for i, key in enumerate(g["id"]):
            assert got[key]["projection"] == pytest.approx(p[i], abs=1e-8)
            assert got[key]["rank"] == (p > p[i]).sum() + 1 and got[key]["tied"] == (p == p[i]).sum()
        u = up.to_numpy()
        want |= {key for i, key in enumerate(g["id"]) if len(g) > 1 and all((u[i] >= u[j]).all() and (u[i] > u[j]).any() for j in range(len(g)) if j != i)}
    assert leaders == want


# --- markup --------------------------------------------------------------------
@pytest.mark.parametrize(
    "text,kinds",
    [
        ("<p>One</p>", ["html"]), ("Q&amp;A", ["html"]), ("&lt;p&gt;x&lt;/p&gt;", ["html"]), ("end. <sp", ["html"]), ('ss="lead">Each one.', ["html"]),
        ("## Title\n\ntext", ["markdown"]), ("Title\n-----\ntext", ["markdown"]), ("a [b](c.md) d", ["markdown"]), ("see[^3]", ["markdown"]), ("`code`", ["markdown"]),
        ("== T ==\nx", ["wiki"]), ("[[Some page|x]]", ["wiki"]), ("''i''", ["wiki"]), ("{{stub}}", ["wiki"]), ("__NOTOC__", ["wiki"]),
        ("\\section{A}", ["latex"]), ("$t_{6} = \\frac{n}{2}$", ["latex"]), ("\\( n \\to \\infty \\)", ["latex"]),
        ("while a < b and c > 66", []), ("Map<String, Long> or Optional<T>", []), ("Fill {id} and {lang} in.", []), ("C:\\logs\\new\\x", []), ("It costs $2 (about 5% of $3).", []),
        ("Pointers *head and *tail.", []), ("keys _id and _rev", []), ("row [1], [[1, 2], [3, 4]]", []), ("GET /kb/<id>/chunks", []), ("a_b_c d", []), ("A title line\n\nText.", []), ("", []), (None, []),
    ],
)
def test_kinds(text, kinds):
    assert markup.kinds_of(text) == kinds


def test_clean_text_keeps_structure():
    assert markup.clean("<h2>T &amp; U</h2><ul><li>a</li><li>b</li></ul><pre>x  = 1</pre>") == "## T & U\n\n- a\n- b\n\n```\nx = 1\n```"
    assert markup.clean("# T\n\n**bold** and [l](u) `c`\n\n1 & 2") == "# T\n\nbold and l `c`\n\n1 & 2"
    assert markup.clean("== T ==\n[[A|b]] {{x|y}}\n* i") == "## T\nb\n- i"
    assert "$ x^2 $" in markup.clean("\\section{S}\n\\begin{equation}x^2\\end{equation}") and "# S" in markup.clean("\\section{S}\nx")
    assert markup.clean(None) is None and markup.clean("") == "" and markup.clean("plain\r\ntext ") == "plain\ntext"
    assert len(markup.clean("<b>" + "wort " * 50_000)) > 200_000
    assert markup.content_blocks([0, 30, 20, 0, 0, 0, 5]) == [False, True, False, False, False, False, False]


PAGE = (
    '<div><a href="/">Home</a> / <a href="/a">About</a> / <a href="/l">Login</a></div><h1>Cache</h1>'
    "<p>The shared cache rejects the stale index while the broker signs the log.</p><p>It is full at night, when the queue drains.</p>{}"
    "<ul><li>one lock</li><li>two locks</li></ul><p>Notes on the queue</p><pre>x = 1</pre>"
    "<nav><ul><li>Next page</li><li><a href='/p'>Previous page</a></li></ul></nav><footer>Imprint and contact</footer><div>Copyright 2024 Example</div>"
)


def test_line_blocks_drop_menus_and_footers():
    clean = markup.clean(PAGE.format(""))
    for gone in ("Home", "Login", "Next page", "Previous", "Imprint", "Copyright"):
        assert gone not in clean, gone
    for kept in ("# Cache", "The shared cache", "It is full", "- one lock", "- two locks", "Notes on the queue", "```\nx = 1\n```"):
        assert kept in clean, kept
    # between surge and dive links stay, and a link alone is no menu
    between = '<p><a href="/b">the broker</a> <a href="/q">the queue</a></p><p>Each entry of the log is signed again as soon as the broker is back.</p>'
    assert "the broker the queue" in markup.clean(PAGE.format(between))
    assert markup.clean('<a href="/x">Only a link</a>') == "Only a link"
    own = "<p>\ue000x\ue001</p><footer>y</footer>"
    assert markup.clean(own) == "\ue000x\ue001\n\ny"


def test_long_constructs_are_recognised():
    long = "word " * 200 + "end"
    for text in (f"**{long}**", f"*{long}*", f"_{long}_", f"{long}](http://x)"):
        assert markup.kinds_of(text) == ["markdown"], text[:9]
    for text in (f"{long} --> rest", f'alt {long} title="x"> rest', f'title="{long}"> rest', f'{"x" * 90}" > rest'):
        assert markup.kinds_of(text) == ["html"], text[:9]
    for text in (long + "]] rest", long + "}} rest"):
        assert markup.kinds_of(text) == ["wiki"], text[-9:]
    began = time.time()
    for text in ("ab-" * 100_000 + ">", "*a" * 100_000, "**a " * 100_000, "_a " * 100_000, 'a="b" ' * 50_000 + ">"):
        markup.kinds_of(text)
    assert time.time() - began < 20


def test_markup_column(spark):
    df = spark.createDataFrame([(1, "<p>x</p>"), (2, None), (3, "")], "id long, c string")
    got = {r["id"]: (r["m"]["kinds"], r["m"]["text"]) for r in df.select("id", markup.clean_text(F.col("c")).alias("m")).collect()}
    assert got == {1: (["html"], "x"), 2: ([], None), 3: ([], "")}


# --- splitting -----------------------------------------------------------------
def test_pieces_make_up_the_text():
    random.seed(1)
    for _ in range(2000):
        t = "".join(random.choice("aaab  .。\n！ x\t# ") for _ in range(random.randint(0, 120)))
        lim = splitting.Limits(random.choice([5, 8, 13, 30]), random.choice([0, 2, 4]))
        pieces, forced = splitting.split(t, lim)
        assert "".join(t[n:e] for _, n, e in pieces) == t
        assert all(e - s <= lim.limit and 0 <= n - s <= lim.overlap for s, n, e in pieces)
        assert forced == bool(re.search(f"[^{splitting.BOUNDARIES}]{{{lim.limit + 1},}}", t))
    assert splitting.split(None) == ([], False)


def test_pieces_cut_between_characters_overlap():
    text = "".join(chr(0x4E00 + i % 5000) for i in range(2000))
    pieces, forced = splitting.split(text)
    assert forced and [n - a for a, n, _ in pieces] == [0, 100, 100]
    assert "".join(text[n:e] for _, n, e in pieces) == text and all(e - a <= 800 for a, _, e in pieces)
    assert splitting.split("x " + "y" * 750)[1] is False  # no cut inside a word that fits


def test_every_piece_repeats_the_end_of_the_one_before():
    random.seed(2)
    limits = splitting.Limits(80, 15)
    for _ in range(1500):
        words = ["".join(random.choice("abc") for _ in range(random.randint(1, 12))) for _ in range(random.randint(0, 120))]
        t = "".join(w + random.choice([" ", " ", ". ", "\n", "\n\n", "。", "\n# "]) for w in words)
        pieces, forced = splitting.split(t, limits)
        assert not forced
        for (before, _, _), (start, new, end) in zip(pieces, pieces[1:]):
            least = max(before, new - limits.overlap)
            starts = [i for i in range(least, new) if i == 0 or t[i - 1] in splitting.BOUNDARIES]
            assert start == (starts[0] if starts else new) and new - start >= 1


@pytest.mark.parametrize("unit", ["sentence of some words " * 32 + "ends here. ", "line of words " * 54 + "\n", "a paragraph with words " * 33 + "\n\n"])
def test_long_sentences_lines_and_paragraphs_leave_room_for_the_overlap(unit):
    assert 700 < len(unit) <= 800
    pieces, forced = splitting.split(unit * 6)
    assert not forced and all(85 <= n - a <= 100 for a, n, _ in pieces[1:]) and all(e - a <= 800 for a, _, e in pieces)


def test_numbered_pieces(spark):
    rows = [(1, 7, 0, "wort " * 300), (2, 7, 0, "x" * 900), (3, 8, 1, "short"), (4, None, None, None), (5, 9, 0, "y" * 800 + " ")]
    df = spark.createDataFrame(rows, "id long, document_id long, chunk_index int, content string")
    big = splitting.oversized(df, "content").cache()
    assert {r["id"]: r["split"]["forced"] for r in big.collect()} == {1: False, 2: True, 5: False}
    numbered = splitting.numbered_pieces(big, ["document_id", "chunk_index"], "id").where("document_id = 7").orderBy("piece_no").collect()
    assert [r["piece_no"] for r in numbered] == list(range(1, len(numbered) + 1)) and numbered[0]["overlap"] == 0


# --- tokeniser -----------------------------------------------------------------
def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer.place_of("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    mine = tokenizer.transducer(BPE)
    random.seed(3)
    texts = ["", " ", "<|endoftext|>", "a" * 3000, " " * 999 + "x", "ab" * 700, "你好" * 500, "🙂‍🔬 naïve İ\x00\ufeff", "don't we're\r\n\t12345678901234567890"]
    texts += ["".join(random.choice("aeéß <|endoftext|>'s 12\t\n中文🙂\u200b\x00z!?") for _ in range(random.randint(0, 60))) for _ in range(800)]
    for t in texts:
        ids = mine.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids, t[:40]
        assert "".join(tokenizer.decode(ids, mine.vocabulary)) == t


def test_states_are_bounded_and_decoder_is_incremental():
    small = tokenizer.Transducer(tokenizer.transducer(BPE).vocabulary, most_states=50, most_words=5)
    text = "several quite different words, one after another, 123 times"
    assert small.encode(text) == tokenizer.transducer(BPE).encode(text) and len(small._states) <= 200
    tight = tokenizer.Vocabulary(small.vocabulary.rank, most_pairs=3)
    assert tokenizer.Transducer(tight).encode(text) == small.encode(text) and len(tight._beside) <= 3
    d = tokenizer.Decoder()
    assert d.feed(b"\xf0\x9f") == "" and d.feed(b"\x99\x82a\xc3") == "🙂a" and d.end() == "�"
    assert tokenizer.Decoder().feed(b"\xed\xa0\x80") == "���"


def test_id_columns(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello world")], "doc_id long, text string")
    got = {r["doc_id"]: (r["ids"], r["n"], r["again"]) for r in df.select("doc_id", tokenizer.token_ids(F.col("text"), BPE).alias("ids"), tokenizer.token_count(F.col("text"), BPE).alias("n"), tokenizer.decoded(F.col("text"), BPE).alias("again")).collect()}
    assert got[1] == ([], 0, "") and got[2] == ([], 0, "") and got[3] == ([15496, 995], 2, "Hello world")


# --- mixing --------------------------------------------------------------------
def test_water_fill():
    assert mixing.water_fill({"a": 1.0, "b": 1.0}, {"a": 10.0, "b": 1000.0}, 100.0) == {"a": 10.0, "b": 90.0}
    assert mixing.water_fill({"a": 1.0, "b": 3.0}, {"a": 5.0, "b": 6.0}, 100.0) == {"a": 5.0, "b": 6.0}
    assert mixing.water_fill({}, {}, 5.0) == {}


def test_mix_shares_and_caps(spark):
    docs = [(i, f"text number {i} " * 30, "big") for i in range(300)] + [(1000 + i, f"small {i} " * 30, "small") for i in range(10)]
    docs += [(2000, "copy of it", "big"), (2001, "copy of it", "small"), (2002, None, "big"), (2003, "", None), (2004, "not listed", "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 3.0, 2), ("small", 1.0, 3), ("absent", 1.0, 9), (None, 1.0, 1)], "source string, target_weight double, max_repeats int")
    p = mixing.plan(df, targets, BPE, mixing.Mix(slot_tokens=64))
    use = {r["doc_id"]: (r["source"], r["tokens"], r["uses"]) for r in mixing.usage(p, spark).collect()}
    assert len(use) == len(docs) and all(use[i][2] <= (2 if s == "big" else 3) for i, _, s in docs if s in ("big", "small"))
    assert use[2001][2] == 0 and use[2002][2] == use[2003][2] == use[2004][2] == 0
    shares = {r["source"]: r for r in mixing.actual_shares(p, spark).collect()}
    assert shares["absent"]["actual_share"] == 0.0 and shares["big"]["target_share"] == pytest.approx(0.6)
    assert all(use[1000 + i][2] == 3 for i in range(10))  # the small source gives all it may
    assert shares["small"]["actual_share"] == pytest.approx(shares["small"]["planned_share"], abs=0.02)
    total = sum(t for _, t, _ in (use[i] for i, _, s in docs if s in ("big", "small")))
    assert sum(t * u for _, t, u in use.values()) == pytest.approx(total, rel=0.05)
    slots = mixing.schedule(p, spark, stretch=16).orderBy("slot").collect()
    seen: Counter = Counter()
    for r in slots:
        assert r["nth"] == seen[r["source"]]
        seen[r["source"]] += 1
    empty = mixing.plan(df.limit(0), targets.limit(0), BPE)
    assert mixing.usage(empty, spark).count() == 0


def test_tiny_sources_get_their_quota(spark):
    docs = [(i, f"text number {i} " * 30, "big") for i in range(100)] + [(1000, "tiny words " * 50, "tiny"), (1001, "more words " * 300, "small")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 1.0, 9), ("tiny", 1.0, 5), ("small", 1.0, 3)], "source string, target_weight double, max_repeats int")
    p = mixing.plan(df, targets, BPE)
    use = {r["doc_id"]: r for r in mixing.usage(p, spark).collect()}
    assert use[1000]["tokens"] < 512 < use[1001]["tokens"]
    assert (use[1000]["uses"], use[1001]["uses"]) == (5, 3)
    read = Counter(r["source"] for r in mixing.slot_sources(p, spark).collect())
    assert read == p.wanted and p.wanted["tiny"] == 5


def test_blocks_are_equal_and_long_texts_lie_in_several(spark):
    random.seed(12)
    docs = [(i, "word " * random.choice([3, 20, 90, 400, 1500]) + str(i), random.choice(["big", "big", "small"])) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 2.0, 3), ("small", 5.0, 2)], "source string, target_weight double, max_repeats int")
    p = mixing.plan(df, targets, BPE, mixing.Mix(slot_tokens=100, bucket_rows=10))
    parts = mixing.block_texts(p).collect()
    tokens = {r["doc_id"]: r["tokens"] for r in p.texts.collect()}
    for source, _, _, cap, blocks in p.shares:
        sizes = Counter()
        for r in parts:
            if r["source"] == source:
                sizes[r["block"]] += r["to_token"] - r["from_token"]
        assert set(sizes) == set(range(blocks)) and max(sizes.values()) - min(sizes.values()) <= 1 and max(sizes.values()) <= 100
    for doc, n in tokens.items():
        mine = sorted((r["from_token"], r["to_token"]) for r in parts if r["doc_id"] == doc)
        assert mine[0][0] == 0 and mine[-1][1] == n and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
    slots = mixing.schedule(p, spark).collect()
    caps = {s: c for s, _, _, c, _ in p.shares}
    assert all(r["pass"] < caps[r["source"]] for r in slots) and Counter(r["source"] for r in slots) == p.wanted
    got = Counter()
    for r in mixing.usage(p, spark).collect():
        assert r["uses"] <= caps[r["source"]]
        got[r["source"]] += r["uses"] * r["tokens"]
    whole = sum(tokens.values())
    for source, _, planned, _, _ in p.shares:  # as planned, to one slot and half the longest text
        assert abs(got[source] - planned * sum(got.values())) <= 100 + max(tokens.values()) / 2 + 1, (source, got, whole)


def test_golden_points_keep_their_digits(spark):
    from fractions import Fraction
    from math import isqrt

    golden = Fraction(isqrt(5 * 10**80) - 10**40, 2 * 10**40)
    x = F.floor(F.col("id") / mixing.STRIDE) * mixing.GOLDEN_STRIDE
    x = x - F.floor(x) + (F.pmod("id", F.lit(mixing.STRIDE)) + 0.5) * mixing.GOLDEN
    ids = [0, 1, 12345678, 5 * 10**10 + 7, 10**12 + 3]
    for r in spark.createDataFrame([(i,) for i in ids], "id long").select("id", (x - F.floor(x)).alias("x")).collect():
        assert abs(r["x"] - float((Fraction(2 * r["id"] + 1, 2) * golden) % 1)) < 1e-7


# --- repetition ----------------------------------------------------------------
def test_repeated_share():
    s = "The cold cache rejects the stale index now. "
    assert repetition.repeated_share(s) == 0.0
    assert repetition.repeated_share(s + "12) THE  COLD cache, rejects the stale index now!") == pytest.approx(0.5)
    assert repetition.repeated_share("judge " * 40) > 0.8
    assert repetition.repeated_share("缓存索引失效重试之后恢复。" * 3) == pytest.approx(2 / 3)
    for t in (None, "", "123 ...", "one two three"):
        assert repetition.repeated_share(t) == 0.0


def test_entropy_bound_and_fertility():
    random.seed(8)
    path = tokenizer.place_of(repetition.PIECES)
    words = ["cache", "index", "Puffer", "réplica", "索引", "缓存", "stale", "lock"]
    for _ in range(200):
        t = " ".join(random.choice(words) for _ in range(random.randint(1, 60)))
        units = repetition.units_of(t)
        assert repetition.fertility(units, path)[0] >= repetition.share_of(units) - 1e-9
    loss, per, fallback, entropy, n = repetition.fertility(repetition.units_of("The cache is full."), path)
    assert loss == 0.0 and per > 2 and fallback == 0.0 and entropy > 1 and n >= 4
    assert repetition.fertility([], path) == (0.0, None, 0.0, 0.0, 0)
    assert repetition.fertility(["\U000200a9"], path)[2] > 0
    assert repetition.in_band(repetition.fertility(["x"] * 500, path)[1:], "latin") is False


def test_bands_follow_the_script():
    scripts = {"The cache is full": "latin", "Größe für Straßen": "latin", "缓存索引失效 cache": "han", "кэш полон": "other", "": "latin"}
    for text, script in scripts.items():
        assert repetition.script_of(repetition.units_of(text)) == script, text
    assert repetition.in_band((2.0, 0.0, 9.0, 200), "han") and not repetition.in_band((1.2, 0.0, 9.0, 200), "latin")
    assert repetition.in_band((9.0, 1.0, 0.0, repetition.LEAST_TOKENS - 1), "latin")


def test_shares_of_words_and_characters_equal_brute_force():
    random.seed(9)
    for letters in (["ab", "cd", "ef"], list("缓存索"), ["ab", "cd", "缓", "存", "索"]):
        for _ in range(300):
            units = [random.choice(letters) for _ in range(random.randint(0, 40))]
            size = lambda u: 1 if len(u) == 1 else 2
            passages, marked = [], set()
            for i in range(len(units)):
                ends = [j for j in range(i + 1, len(units) + 1) if sum(map(size, units[i:j])) >= repetition.PASSAGE]
                if ends:
                    if units[i : ends[0]] in passages:
                        marked |= set(range(i, ends[0]))
                    passages.append(units[i : ends[0]])
            total = sum(map(len, units))
            assert repetition.share_of(units) == pytest.approx(sum(len(units[i]) for i in marked) / total if total else 0.0)


def test_remembered_words_are_bounded(monkeypatch):
    path = tokenizer.place_of(repetition.PIECES)
    monkeypatch.setattr(repetition, "MOST_WORDS", 3)
    words = "one two three four five six one".split()
    model, _ = repetition._pieces(path)
    assert repetition.token_counts(words, path) == Counter(i for w in words for i in model.encode(w))
    assert len(repetition._remembered(path)) <= 3


def test_repetition_column(spark):
    df = spark.createDataFrame([(1, "ab cd ef gh ij kl mn. " * 3, "en"), (2, None, None), (3, "", "zz")], "doc_id long, text string, script string")
    got = {r["doc_id"]: r["repeated_share"] for r in repetition.repetition(df, "doc_id", "text").collect()}
    assert got[1] == pytest.approx(2 / 3) and got[2] == 0.0 and got[3] == 0.0


# --- empty tables, nulls and clashing names --------------------------------------
def test_empty_and_null_inputs(spark):
    none = spark.createDataFrame([], "id long, v string")
    assert neighbours.nearest(neighbours.unit_vectors(none, "id", "v"), neighbours.Search()).count() == 0
    nulls = spark.createDataFrame([(None, "1,2"), (1, None), (2, "1,2")], "id long, v string")
    assert neighbours.nearest(neighbours.unit_vectors(nulls, "id", "v"), neighbours.Search()).count() == 0
    odd = spark.createDataFrame([(1, "word word", "x", 3)], "id long, term string, tf string, n int")
    assert [(r["term"], r["tf"]) for r in distinctive.distinctive_terms(odd, "id", "term").collect()] == [("word", 2)]
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert repetition.repetition(docs, "doc_id", "text").count() == 0
    assert repetition.repeated_documents(docs, "doc_id", "text").count() == 0
    assert docs.select(tokenizer.token_ids(F.col("text"), BPE)).count() == 0
    assert docs.select(markup.clean_text(F.col("text"))).count() == 0
    assert splitting.oversized(docs, "text").count() == 0


def test_repeated_documents(spark):
    rows = [(1, "The cold cache rejects the stale index now. " * 3), (2, "The cold cache rejects the stale index now."), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in repetition.repeated_documents(df, "doc_id", "text").collect()] == [1]
