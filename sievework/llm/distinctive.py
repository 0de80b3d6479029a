"""How characteristic each term of a record is against the whole collection.

Log-odds ratio of the record against the rest with an informative Dirichlet
prior that is proportional to the collection's counts, divided by its standard
error: common terms get small z-scores, rare ones that a record insists on
large ones.

Defined results: null, empty and termless texts have no rows; a record
delivered twice counts once; a term that makes up the whole collection (the
rest has no other) scores 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import cut

#: Longest runs of at least four letters, after lower-casing.
TERM = "[a-zß-öø-ÿ]{4,}"


def terms_of(text: Column, pattern: str = TERM) -> Column:
    """All terms of a text in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def term_counts(df: DataFrame, key: str, text: str, pattern: str = TERM) -> DataFrame:
    """(key, n, term, tf), n being the record's terms in all. No shuffle if df is partitioned by key."""
    words = df.select(key, terms_of(F.col(text), pattern).alias("words"))
    words = words.select(key, F.size("words").alias("n"), F.explode("words").alias("term"))
    return words.groupBy(key, "n", "term").agg(F.count("*").alias("tf"))


def collection_counts(counts: DataFrame) -> DataFrame:
    """(term, cf, df): occurrences and records of each term, by partial sums."""
    return counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def z_score(tf: Column, n: Column, cf: Column, total: Column, prior: float) -> Column:
    """z of the log-odds of a term in a record of n terms against the other total - n.

    The prior gives each term prior * cf / total pseudo-counts, `prior` in all.
    """
    a = F.lit(float(prior)) * cf / total
    inside = tf + a
    outside = (cf - tf) + a
    odds_in = F.ln(inside / (n + prior - inside))
    odds_out = F.ln(outside / (total - n + prior - outside))
    z = (odds_in - odds_out) / F.sqrt(1.0 / inside + 1.0 / outside)
    return F.when((n + prior > inside) & (total - n + prior > outside), z).otherwise(0.0)


def distinctive_terms(df: DataFrame, key: str, text: str, prior: float = 1000.0, pattern: str = TERM) -> DataFrame:
    """(key, term, tf, n, cf, df, z) for every term of every record.

    df must hold each key once. Counting is local to the record; only the
    summed vocabulary and the pairs cross the network. Frequent terms are hot
    keys of the join: adaptive execution splits them. Filters on tf and df
    move below the join. The counts are written once, so texts are read once.
    """
    counts = cut(term_counts(df, key, text, pattern))  # read three times
    vocabulary = collection_counts(counts)
    total = vocabulary.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("total")).scalar()
    joined = counts.join(vocabulary, "term").withColumn("total", total)
    z = z_score(F.col("tf"), F.col("n"), F.col("cf"), F.col("total"), prior)
    return joined.select(key, "term", "tf", "n", "cf", "df", z.alias("z"))
