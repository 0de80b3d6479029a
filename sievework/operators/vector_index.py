"""An index over vectors: cells around centroids, indexed top-k, upsert, deletion, and the check of a collection.

The index is a table (scope, dim, cell, id, vector). Centroids are fitted on a
bounded sample; every vector is filed in the cell of its nearest centroid. A
query visits the cells with the nearest centroids, and the exact top-k of
`operators.vector` ranks what lies there, so a hot cell is cut into blocks as a
hot scope is. How many cells that takes for the wanted recall is measured on
the sample: few where vectors form groups, most where they have no structure.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators import vector


@dataclass(frozen=True)
class Index:
    """sample: vectors of one size at most that centroids are fitted on; most_cells: centroids of one size at most;
    recall: share of the neighbours (tested ones of `tests` vectors) in the visited cells; rounds: of the fit."""

    sample: int = 20_000
    most_cells: int = 1024
    recall: float = 0.97
    tests: int = 500
    neighbours: int = 10
    rounds: int = 8
    seed: int = 5

    def cells_for(self, n: int) -> int:
        return max(1, min(self.most_cells, round(math.sqrt(n))))


@dataclass(frozen=True)
class Cells:
    """Unit centroids of one number of components, and how many cells a query visits."""

    centroids: np.ndarray
    visits: int


def _visits(x: np.ndarray, scope: np.ndarray, c: np.ndarray, config: Index) -> int:
    """Cells that hold the wanted share of the tested vectors' nearest vectors of their scope, of the sample itself."""
    tested = np.arange(len(x))[:: max(1, len(x) // config.tests)]
    near = x[tested] @ x.T
    near[scope[tested][:, None] != scope[None, :]] = -2.0
    near[np.arange(len(tested)), tested] = -2.0
    k = min(config.neighbours, len(x) - 1)
    if k < 1:
        return len(c)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    cell = np.argmax(x @ c.T, axis=1)
    place = np.argsort(np.argsort(-(x[tested] @ c.T), axis=1), axis=1)  # of each cell in a query's order
    reached = np.take_along_axis(place, cell[best], axis=1)[np.take_along_axis(near, best, axis=1) > -1.5]
    return min(len(c), int(np.quantile(reached, config.recall, method="higher")) + 1) if len(reached) else len(c)


def fit(vectors: DataFrame, config: Index = Index()) -> dict[int, Cells]:
    """Cells for each number of components, from a sample of at most config.sample vectors of each."""
    usable = vectors.where("vector is not null and size(vector) > 0").select("id", "scope", "vector", F.size("vector").alias("dim"))
    sizes = {r["dim"]: r["n"] for r in usable.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    out = {}
    for dim, n in sizes.items():
        mine = usable.where(F.col("dim") == dim)
        if n > config.sample:  # by hashed id: the same rows wherever they lie
            mine = mine.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(config.sample / n * (1 << 20)))
        rows = mine.select("vector", F.xxhash64("scope").alias("scope")).limit(config.sample).toArrow()
        x = _unit(np.asarray(rows["vector"].combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim))
        if not len(x):
            continue
        rng = np.random.default_rng([config.seed, dim])
        c = x[rng.choice(len(x), size=min(config.cells_for(n), len(x)), replace=False)]
        for _ in range(config.rounds):
            near = np.argmax(x @ c.T, axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), c)
        out[dim] = Cells(c, _visits(x, np.asarray(rows["scope"]), c, config))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _in_cells(df: DataFrame, key: str, cells_of: dict[int, Cells], asking: bool) -> DataFrame:
    """(key, scope, vector, cell): a row for the nearest cell or, asking, for each visited one; sizes that weren't fitted have cell 0."""

    def run(batches):
        for batch in batches:
            column = batch.column("vector")
            offsets, flat = np.asarray(column.offsets), np.asarray(column.values, dtype=np.float64)
            lengths = np.diff(offsets)
            rows, cells = [], []
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                fitted = cells_of.get(int(dim))
                if fitted is None:
                    rows.append(at)
                    cells.append(np.zeros(len(at), dtype=np.int32))
                    continue
                x = flat[offsets[at][:, None] + np.arange(dim)]
                c, n = fitted.centroids, fitted.visits if asking else 1
                near = x @ c.T
                best = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(len(c)), (len(at), 1))
                rows.append(np.repeat(at, best.shape[1]))
                cells.append(best.ravel().astype(np.int32))
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(take), batch.column("scope").take(take), column.take(take), pa.array(np.concatenate(cells))],
                    names=[key, "scope", "vector", "cell"],
                )

    picked = df.where("vector is not null and size(vector) > 0").select(
        F.col(key).cast("bigint").alias(key), F.col("scope").cast("bigint").alias("scope"), F.col("vector").cast("array<double>").alias("vector")
    )
    return picked.mapInArrow(run, f"{key} bigint, scope bigint, vector array<double>, cell int")


def build(chunks: DataFrame, cells_of: dict[int, Cells]) -> DataFrame:
    """(id, scope, vector, cell) of every chunk with a vector; write it to keep the index."""
    return _in_cells(chunks, "id", cells_of, asking=False)


def top_k(queries: DataFrame, index: DataFrame, cells_of: dict[int, Cells], k: int, config: Index = Index()) -> DataFrame:
    """(query_id, id, similarity, vector_rank) as of vector.top_k, from the cells nearest to each query."""
    asked = _in_cells(queries, "query_id", cells_of, asking=True)
    # cells of a scope take the place of the scope; a fixed factor keeps the pairs apart
    joint = (F.col("scope") * config.most_cells + F.col("cell")).alias("scope")
    return vector.top_k(asked.select("query_id", joint, "vector"), index.select("id", joint, "vector"), k)


def routed_top_k(queries: DataFrame, chunks: DataFrame, k: int, provider: str = "INDEX", index=None, config: Index = Index()) -> DataFrame:
    """The configured provider's top-k with its name as `source`: INDEX, or IN_MEMORY for the exhaustive search.

    index: (index table, cells) if there is one, else it is built. Queries that the index has fewer than k rows for,
    and all where it is missing or can't be fitted, are searched exhaustively.
    """
    exhaustive = lambda q: vector.top_k(q, chunks, k).withColumn("source", F.lit("IN_MEMORY"))
    if provider != "INDEX":
        return exhaustive(queries)
    if index is None:
        cells_of = fit(chunks, config)
        if not cells_of:
            return exhaustive(queries)
        index = build(chunks, cells_of), cells_of
    found = top_k(queries, *index, k, config).withColumn("source", F.lit("INDEX"))
    full = found.where(F.col("vector_rank") == k).select("query_id")
    rest = queries.join(full, "query_id", "left_anti")
    return found.join(full, "query_id", "left_semi").unionByName(exhaustive(rest))


def upsert(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index with the rows of `fresh` (same columns, each id once) in place of those with the same id, and new ones added."""
    return index.join(fresh.select("id"), "id", "left_anti").unionByName(fresh.select(*index.columns))


def delete_documents(index: DataFrame, documents: DataFrame) -> DataFrame:
    """The index without the rows of the documents (document_id)."""
    return index.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def collection_check(size: Column, configured: int) -> Column:
    """Null where the stored vectors' size is the configured one, else what differs."""
    return F.when(
        size != configured,
        F.concat(F.lit(f"vector size mismatch: configured={configured}, actual="), size.cast("string")),
    )


def create_or_check(vectors: DataFrame, configured: int) -> None:
    """Raise if stored vectors (column vector) have another size than configured; an empty collection is fine."""
    sizes = vectors.where("vector is not null").agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    for size in (sizes["low"], sizes["high"]):
        if size is not None and size != configured:
            raise ValueError(f"vector size mismatch: configured={configured}, actual={size}")
