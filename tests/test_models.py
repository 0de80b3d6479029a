import pytest
from pyspark.sql import functions as F

from sievework.operators import evaluate, models, vector


def test_stand_ins(spark):
    df = spark.createDataFrame([(1, "redis 缓存"), (2, None), (3, ""), (4, "redis 缓存")], "id long, t string")
    rows = {r["id"]: r for r in models.embed_distinct(df, "t", vector.hashed_embedding).collect()}
    assert rows[1]["vector"] == rows[4]["vector"] and len(rows[3]["vector"]) == 32 and rows[2]["vector"] is None
    a, b = df.select(models.seeded_embedding(F.col("id")).alias("a"), models.seeded_embedding(F.col("id"), seed=2).alias("b")).first()
    assert len(a) == 10 and a != b and all(0 <= x < 1 for x in a)
    got = [r[0] for r in df.select(models.overlap_relevance(F.lit("缓存, redis"), F.col("t"))).collect()]
    assert got[0] > 0.5 and got[1] == got[2] == 0.0
    assert df.select(models.extractive_answer(F.col("t"))).collect()[1][0] == ""
    raw = models.coverage_judge(F.lit("a b"), F.array(F.lit("a"), F.lit("z")))
    assert df.select(evaluate.judge_scores(raw)["judge"]).first()[0] == pytest.approx(2.5)
