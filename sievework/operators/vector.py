"""Vectors in text form, cosine similarity and exact top-k per query within a scope."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a chunk block and of a query block in one task, and queries of one product. Large blocks keep copies and winners few.
CHUNK_BLOCK = 32_768
QUERY_BLOCK = 16_384
PRODUCT_ROWS = 128


def parse(text: Column) -> Column:
    """array<double> of comma-separated numbers; empty entries are skipped, null if any other isn't a number."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    return F.when(F.forall(numbers, lambda x: x.isNotNull()), numbers)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for null, empty, unequal or zero vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    square = lambda v: F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    norms = F.sqrt(square(a)) * F.sqrt(square(b))
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits & (norms > 0), dot / norms).otherwise(0.0)


def hashed_embedding(text: Column, dim: int = 32) -> Column:
    """A deterministic stand-in for an embedding model: the bytes of SHA-256, centred (at most 32 components)."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    byte = lambda i: F.conv(digest.substr(i * 2 + F.lit(1), F.lit(2)), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (byte(i) - 127.5) / 127.5)


def top_k(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, id, similarity, vector_rank) of the k most similar chunks of each query's scope.

    queries: query_id, scope, vector; chunks: id, scope, vector (array<double>).
    Both sides are cut into blocks of bounded size within a scope (hashed ids,
    so a hot scope has many blocks); each pair of blocks is one matrix product
    that keeps k per query, and the winners of the blocks are ranked last.
    Chunks without a vector of the query's length are no candidates.
    """
    asked = queries.where("vector is not null and size(vector) > 0").withColumn("dim", F.size("vector"))
    held = chunks.where("vector is not null and size(vector) > 0").withColumn("dim", F.size("vector"))
    sizes = held.groupBy("scope", "dim").agg(F.ceil(F.count("*") / CHUNK_BLOCK).cast("int").alias("blocks"))
    q_sizes = asked.groupBy("scope", "dim").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("q_blocks"))
    grid = F.broadcast(sizes.join(q_sizes, ["scope", "dim"]))  # a row for each scope: vectors move once, in their blocks
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    # fresh names on both sides: they may come from one table
    renamed = lambda *names: [F.col(n).alias(n) for n in names]
    left = asked.join(grid, ["scope", "dim"]).select(
        *renamed("scope", "dim"), spread("blocks").alias("b"), own("query_id", "q_blocks").alias("q"), *renamed("query_id", "vector")
    )
    right = held.join(grid, ["scope", "dim"]).select(
        *renamed("scope", "dim"), own("id", "blocks").alias("b"), spread("q_blocks").alias("q"), *renamed("id", "vector")
    )

    def unit(column: pa.ChunkedArray, n: int) -> np.ndarray:
        flat = column.combine_chunks()
        x = np.asarray(flat.flatten() if isinstance(flat, pa.ListArray) else flat.values, dtype=np.float64).reshape(n, -1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def block(lefts: pa.Table, rights: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])
        if not lefts.num_rows or not rights.num_rows:
            return schema.empty_table()
        ids = np.asarray(rights["id"])
        by_id = np.argsort(ids, kind="stable")
        ids, held_units = ids[by_id], unit(rights["vector"], rights.num_rows)[by_id]
        asked_units, query = unit(lefts["vector"], lefts.num_rows), np.asarray(lefts["query_id"])
        n, found = min(k, len(ids)), []
        for at in range(0, len(query), PRODUCT_ROWS):
            s = asked_units[at : at + PRODUCT_ROWS] @ held_units.T
            # the last bits of a product depend on its shape: what is near the k-th is computed alike for all, so that equal vectors tie
            floor = np.partition(s, len(ids) - n, axis=1)[:, len(ids) - n] - 1e-12
            for i, row in enumerate(s):
                some = np.flatnonzero(row >= floor[i])
                value = (held_units[some] * asked_units[at + i]).sum(axis=1)
                best = np.argsort(-value, kind="stable")[:k]
                found.append((np.full(len(best), query[at + i]), ids[some[best]], value[best]))
        return pa.table([np.concatenate(x) for x in zip(*found)], schema=schema)

    keys = ["scope", "dim", "b", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, "query_id bigint, id bigint, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("vector_rank", F.row_number().over(order)).where(F.col("vector_rank") <= k)
