"""One ranking from several scores on different scales.

Each score becomes its average rank within the group, so no score rules by its
range, and counts upwards in its declared direction. The first principal
component of the ranks, from the group's correlation matrix, weighs them; one
sign turns all its loadings towards the declared directions, and items are
sorted by their projection. Where the loadings have both signs, a score runs
against the others, and the component would reward what is declared worse:
then the component of most variance among those without negative loadings takes
its place, which leaves such a score out.

Ranks are distributed: values are counted first (equal ones collapse), a
monotone bucket of the value splits every group, and only the bucket totals of
a group are ever summed up in one place. The correlation matrix is six sums
per group.

Defined results: only rows with all scores present and valid are ranked; a
group of one has rank 1; a score that is constant in its group has no loading;
scores that explain equally much weigh the same; equal projections share a
rank; NaN counts as absent.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.session import cut

#: Scores at most: the components without negative loadings are sought among all subsets.
MOST_SCORES = 12


def value_bucket(value: Column, per_octave: int = 64) -> Column:
    """A bucket number that never falls as the value grows; bounded over all doubles."""
    v = value.cast("double")
    return (F.signum(v) * F.floor(F.log1p(F.abs(v) * 1e6) * per_octave)).cast("bigint")


def average_ranks(df: DataFrame, group: list[str], value: str, buckets: Column | None = None) -> DataFrame:
    """(group, value, low, high): rank range of each distinct value, ascending from 1.

    Shuffles distinct values only. No window holds more than the distinct
    values of one bucket or the buckets of one group.
    """
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    counts = counts.withColumn("_bucket", value_bucket(F.col(value)) if buckets is None else buckets)
    totals = counts.groupBy(*group, "_bucket").agg(F.sum("n").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*group, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.join(totals, [*group, "_bucket"]).withColumn("high", F.col("_before") + F.sum("n").over(inside))
    return upto.select(*group, value, (F.col("high") - F.col("n") + 1).alias("low"), "high")


def oriented_component(correlations: np.ndarray) -> np.ndarray:
    """Unit loadings of each of the (n, k, k) matrices: none negative, explaining most of the variance.

    That is the first principal component wherever its loadings have one sign.
    Otherwise its support is a subset whose own first component has one sign;
    the best subset is found by trying all. Scores with an empty row are constant.
    """
    n, k, _ = correlations.shape
    # among directions that explain the same, the one nearest to equal weights
    c = correlations + 1e-9 * np.einsum("ni,nj->nij", *[np.einsum("nii->ni", correlations) > 0] * 2)
    best, load = np.zeros(n), np.zeros((n, k))
    open_ = np.arange(n)
    for size in range(k, 0, -1):
        for chosen in map(list, itertools.combinations(range(k), size)):
            if not len(open_):
                return load
            values, vectors = np.linalg.eigh(c[np.ix_(open_, chosen, chosen)])
            v = vectors[:, :, -1]
            v = v * np.where(v.sum(1, keepdims=True) < 0, -1.0, 1.0)
            fits = (v >= -1e-9).all(1) & (values[:, -1] > 0)
            better, same = fits & (values[:, -1] > best[open_] + 1e-12), fits & (np.abs(values[:, -1] - best[open_]) <= 1e-12)
            load[open_[better]] = 0.0
            for rows in (better, same):
                load[np.ix_(open_[rows], chosen)] += np.maximum(v[rows], 0.0)
            best[open_[better]] = values[better, -1]
            if size == k:  # the principal component itself can't be beaten
                open_ = open_[~fits]
    norm = np.linalg.norm(load, axis=1, keepdims=True)
    return np.divide(load, norm, out=np.zeros_like(load), where=norm > 0)


def principal_weights(ranked: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(group, weights array) from the group's correlation matrix of `columns`."""
    k = len(columns)
    if k > MOST_SCORES:
        raise ValueError(f"at most {MOST_SCORES} scores, not {k}")
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    sums = [F.coalesce(F.covar_pop(columns[i], columns[j]), F.lit(0.0)).alias(f"_c{i}_{j}") for i, j in pairs]
    spread = [F.coalesce(F.var_pop(c), F.lit(0.0)).alias(f"_v{i}") for i, c in enumerate(columns)]
    stats = ranked.groupBy(*group).agg(*spread, *sums)

    @F.pandas_udf("array<double>")
    def weigh(moments: pd.DataFrame) -> pd.Series:
        m = moments.to_numpy(dtype=float)
        deviation = np.sqrt(np.where(m[:, :k] > 1e-12, m[:, :k], np.inf))
        c = np.zeros((len(m), k, k))
        for i in range(k):
            c[:, i, i] = np.isfinite(deviation[:, i])
        for x, (i, j) in zip(m[:, k:].T, pairs):
            c[:, i, j] = c[:, j, i] = x / (deviation[:, i] * deviation[:, j])
        return pd.Series(list(oriented_component(c)))

    moments = F.struct(*[f"_v{i}" for i in range(k)], *[f"_c{i}_{j}" for i, j in pairs])
    return stats.select(*group, weigh(moments).alias("weights"))


def fused_ranking(df: DataFrame, group: str, key: str, scores: dict[str, bool]) -> DataFrame:
    """(group, key, scores, z_<score>, weights, projection, rank, tied).

    scores: column to whether higher is better. z_<score> is the score's
    average rank in the group, scaled to 0..1, 1 being best. tied is the number
    of items with the same projection. df holds each key once.
    """
    present = df
    for c in scores:
        present = present.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    present = cut(present.select(group, key, *scores))
    sizes = present.groupBy(group).agg(F.count("*").alias("_size"))
    upwards = [F.struct(F.lit(i).alias("i"), (F.col(c).cast("double") * (1 if up else -1) + 0.0).alias("v")) for i, (c, up) in enumerate(scores.items())]
    long = present.select(group, key, F.explode(F.array(*upwards)).alias("_s")).select(group, key, "_s.i", "_s.v")
    place = average_ranks(long, [group, "i"], "v").join(sizes, group)
    share = ((F.col("low") + F.col("high")) / 2.0 - 1) / (F.col("_size") - 1)
    place = place.select(group, "i", "v", F.when(F.col("_size") > 1, share).otherwise(1.0).alias("z"))
    wide = long.join(place, [group, "i", "v"]).groupBy(group, key)
    names = [f"z_{c}" for c in scores]
    ranked = cut(wide.agg(*[F.max(F.when(F.col("i") == i, F.col("z"))).alias(n) for i, n in enumerate(names)]))
    weights = principal_weights(ranked, [group], names)
    total = sum((F.get("weights", F.lit(i)) * F.col(n) for i, n in enumerate(names)), F.lit(0.0))
    projected = cut(ranked.join(weights, group).withColumn("projection", F.round(total, 12)))
    # projections lie in 0..len(scores): even buckets
    buckets = F.floor(F.col("projection") * 4096).cast("bigint")
    order = average_ranks(projected, [group], "projection", buckets)
    order = order.join(sizes, group).select(
        group,
        "projection",
        (F.col("_size") - F.col("high") + 1).alias("rank"),
        (F.col("high") - F.col("low") + 1).alias("tied"),
    )
    return (
        projected.join(order, [group, "projection"])
        .join(present, [group, key])
        .select(group, key, *scores, *names, "weights", "projection", "rank", "tied")
    )


def dominant(ranking: DataFrame, group: str, key: str, scores: dict[str, bool]) -> DataFrame:
    """Items that are as good as every other of their group in all scores, and better than it in some.

    No loading is negative, so such an item leads the ranking, maybe beside
    others that are worse only in scores without a loading. Of the leaders,
    an exact check keeps one that is best in every score and the only such.
    """
    best = [(F.max(c) if up else F.min(c)).alias(f"_best_{c}") for c, up in scores.items()]
    tops = ranking.groupBy(group).agg(F.count("*").alias("_n"), *best).where("_n > 1")
    leaders = ranking.where("rank = 1").join(tops, group)
    for c in scores:
        leaders = leaders.where(F.col(c) == F.col(f"_best_{c}"))
    alone = leaders.groupBy(group).agg(F.count("*").alias("_leaders"), F.min(key).alias(key))
    return alone.where("_leaders = 1").select(group, key)
