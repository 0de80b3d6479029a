"""Most similar vectors for every vector: multiprobe p-stable hashing.

Unit vectors are hashed by L tables of m projections on Gaussian directions,
h(x) = floor((a.x + b) / w). A vector is filed in its own bucket of each table
and, as a query, also visits the perturbed buckets that are likeliest to hold
near vectors, in order of estimated success (the sum of squared distances to
the bucket walls that are crossed). The candidates of all tables are merged,
and their exact distances rank them. m grows with the number of vectors so that
buckets do not, and L follows from m: the share of pairs at the least
similarity that one table finds is simulated with the very hash and probes, and
there are as many tables as the wanted recall needs. The exact mode is the same
plan with one bucket for all, in blocks.

Skew: vectors with equal components are one entry with a list of members, so
groups of copies never meet in a bucket; buckets above `block_rows` are cut
into blocks that every query of the bucket visits, so no task holds a whole
hot bucket and nothing is dropped.

Defined results: a vector is usable if all its entries are finite numbers, not
all zero (blanks, brackets and empty entries do not matter); null, empty and
unreadable ones have no neighbours. Only vectors with the same number of
components are compared. A row delivered twice counts once. Equal similarity
is ranked by the smaller id; a member of a large group of copies gets k other
members.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.session import cut

_VECTORS = "id bigint, dim int, code bigint, unit binary"
_PLACED = "place bigint, probe boolean, id bigint, dim int, short binary"
_FOUND = "query_id bigint, id bigint"


@dataclass(frozen=True)
class Search:
    """Parameters of the index.

    width: w of the hash; tables: L, or more where `recall` at min_similarity
    (if that is positive) needs more; probes: perturbed buckets each query
    visits per table besides its own; bucket_rows: rows a bucket should hold on
    average, from which m follows unless projections sets it; block_rows: rows
    of a block at most; exact: compare with all vectors instead.
    """

    k: int = 5
    min_similarity: float = -1.0
    width: float = 2.5
    tables: int = 4
    recall: float = 0.95
    probes: int = 2
    bucket_rows: int = 4000
    projections: int | None = None
    block_rows: int = 8192
    exact: bool = False
    seed: int = 7

    def projections_for(self, n: int) -> int:
        """m for n vectors."""
        if self.exact:
            return 0
        # collision of unrelated unit vectors in one projection is about 0.57 at w = 2.5
        apart = 1 - 0.7979 * 1.4142 / self.width * (1 - math.exp(-((self.width / 1.4142) ** 2) / 2))
        fit = max(1, round(math.log(max(n / self.bucket_rows, 1.0)) / -math.log(apart)))
        return self.projections or fit

    def tables_for(self, m: int, all_ask: bool = True) -> int:
        """L for m projections, never less than `tables`."""
        if not m:
            return 1
        if self.min_similarity <= 0:
            return self.tables
        found = success(self, m, self.min_similarity, all_ask)
        if found >= 1:
            return self.tables
        return max(self.tables, math.ceil(math.log(1 - self.recall) / math.log1p(-max(found, 1e-4))))


def success(search: Search, m: int, similarity: float, all_ask: bool = True, pairs: int = 20_000) -> float:
    """Share of pairs at this similarity that one table of m projections finds, simulated; either side may if all ask.

    A pair's projections depend on nothing but its similarity: two normal
    numbers with that correlation.
    """
    rng = np.random.default_rng([search.seed, m])
    a = rng.normal(size=(pairs, m))
    b = similarity * a + math.sqrt(1 - similarity**2) * rng.normal(size=(pairs, m))
    offset = rng.uniform(0, search.width, m)
    mult = rng.integers(1, 2**62, size=m, dtype=np.int64) | 1
    sides = []
    for x in (a, b):
        at = (x + offset) / search.width
        with np.errstate(over="ignore"):
            own = (np.floor(at).astype(np.int64) * mult).sum(1)
        sides.append((own, at - np.floor(at)))
    found = sides[0][0] == sides[1][0]
    for (own, inside), (other, _) in (sides, sides[::-1])[: 2 if all_ask else 1]:
        for shift in _shifts(inside, mult, search.probes):
            with np.errstate(over="ignore"):
                found |= own + shift == other
    return float(found.mean())


def parse_vector(text: str | None) -> np.ndarray | None:
    """The unit vector written in `text`, or None if it is unusable."""
    if not text or "_" in text:
        return None
    entries = [e for e in text.replace("[", " ").replace("]", " ").split(",") if e.strip()]
    try:
        v = np.array(entries, dtype=np.float64)
    except ValueError:
        return None
    top = np.abs(v).max() if v.size else 0.0
    if not np.isfinite(top) or top == 0.0:
        return None
    v = v / top
    return v / math.sqrt(float(v @ v))


def unit_vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Usable vectors once per id, written to the shared folder: id, dim, code, unit (float32 bytes).

    code is equal for vectors that agree to five decimals.
    """

    def parse(batches):
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            ids, dims, codes, units = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = parse_vector(text)
                if v is None or key is None:
                    continue
                ids.append(key)
                dims.append(v.size)
                rounded = np.round(v, 5) + 0.0
                codes.append(xxh3_64_intdigest(rounded.tobytes()) - (1 << 63))
                units.append(v.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(codes, pa.int64()), pa.array(units, pa.binary())],
                names=["id", "dim", "code", "unit"],
            )

    picked = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).alias("v"))
    return cut(picked.where(F.col("v").isNotNull()).mapInArrow(parse, _VECTORS).dropDuplicates(["id"]))


def _probe_sets(m: int, reach: int = 6) -> list[tuple[int, ...]]:
    """Subsets of the `reach` cheapest wall crossings, fewest first."""
    reach = min(reach, 2 * m)
    return [s for n in range(1, 4) for s in itertools.combinations(range(reach), n)]


def _placer(plan_of: dict[int, tuple[int, int]], search: Search, probing: bool, filing: bool):
    """Bucket places of each vector: its own (probe false) and the perturbed ones (probe true).

    plan_of: projections and tables for each number of components.
    """

    def place(batches):
        hashes: dict[int, list] = {}
        for batch in batches:
            ids = np.asarray(batch.column(0))
            dims = np.asarray(batch.column(1))
            units = batch.column(2).to_pylist()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(units[i] for i in rows), dtype=np.float32).reshape(len(rows), dim)
                short = _short(x)
                key = ids[rows]
                m, tables = plan_of[int(dim)]
                if dim not in hashes:
                    rng = np.random.default_rng([search.seed, int(dim)])
                    mult = rng.integers(1, 2**62, size=(tables, m), dtype=np.int64) | 1
                    hashes[dim] = [(rng.normal(size=(dim, m)), rng.uniform(0, search.width, m), mult[t]) for t in range(tables)]
                for t, (a, b, mult) in enumerate(hashes[dim]):
                    at = (x @ a + b) / search.width
                    cell = np.floor(at)
                    with np.errstate(over="ignore"):
                        own = (cell.astype(np.int64) * mult).sum(1) * 31 + t * 1_000_003 + int(dim)
                    if filing:
                        yield _batch(own, False, key, dim, short)
                    if probing:
                        if not filing:
                            yield _batch(own, True, key, dim, short)
                        for shift in _shifts(at - cell, mult, search.probes) if m else ():
                            with np.errstate(over="ignore"):
                                yield _batch(own + shift * 31, True, key, dim, short)

    return place


def _short(x: np.ndarray) -> list[bytes]:
    """The directions of the rows of x in one byte a component, for finding candidates."""
    top = np.abs(x).max(axis=1, keepdims=True)
    return [r.tobytes() for r in np.rint(x * (127 / top)).astype(np.int8)]


def _shifts(inside: np.ndarray, mult: np.ndarray, probes: int):
    """Hash differences of the `probes` likeliest perturbed buckets, likeliest first."""
    m = inside.shape[1]
    cost = np.concatenate([inside**2, (1 - inside) ** 2], axis=1)
    sets = _probe_sets(m)
    order = np.argsort(cost, axis=1)[:, : max(map(max, sets)) + 1]
    cheap = np.take_along_axis(cost, order, axis=1)
    step = np.where(order < m, -1, 1) * mult[order % m]
    score = np.stack([cheap[:, list(s)].sum(1) for s in sets], axis=1)
    same = np.stack(  # crossing both walls of one projection leads nowhere
        [
            np.any([order[:, i] % m == order[:, j] % m for i, j in itertools.combinations(s, 2)], axis=0)
            if len(s) > 1
            else np.zeros(len(order), bool)
            for s in sets
        ],
        axis=1,
    )
    score[same] = np.inf
    with np.errstate(over="ignore"):
        shift = np.stack([step[:, list(s)].sum(1) for s in sets], axis=1)
    best = np.argsort(score, axis=1, kind="stable")[:, :probes]
    for p in range(min(probes, len(sets))):
        yield np.take_along_axis(shift, best[:, p : p + 1], axis=1)[:, 0]


def _batch(place, probe, ids, dim, short):
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(place, pa.int64()),
            pa.array(np.full(n, probe)),
            pa.array(ids, pa.int64()),
            pa.array(np.full(n, dim, dtype=np.int32)),
            pa.array(short, pa.binary()),
        ],
        names=["place", "probe", "id", "dim", "short"],
    )


def _matcher(search: Search, all_query: bool):
    """Compare the queries of each block with its filed vectors; rows come sorted by block."""
    slack = 0.01  # one byte a component moves a cosine by less
    keep = search.k + 5

    def compare(filed, asking, out):
        fid, fx = filed
        qid, qx = asking
        if not len(fid) or not len(qid):
            return
        for at in range(0, len(qid), 1024):
            s = qx[at : at + 1024] @ fx.T
            q = qid[at : at + 1024]
            s[q[:, None] == fid[None, :]] = -2.0
            ok = s >= search.min_similarity - slack
            if s.shape[1] > keep:
                floor = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep]
                ok &= s >= floor[:, None] - slack / 2
            ok &= s > -1.5
            i, j = np.nonzero(ok)
            if len(i):
                out.append((q[i], fid[j]))
                if all_query:  # either side may have found the pair
                    out.append((fid[j], q[i]))

    def match(batches):
        held: list = []
        current = None

        def finish(parts, out):
            ids = np.concatenate([p[0] for p in parts])
            probe = np.concatenate([p[1] for p in parts])
            raw = b"".join(b for p in parts for b in p[2])
            x = np.frombuffer(raw, dtype=np.int8).reshape(len(ids), -1).astype(np.float32)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            filed = (ids[~probe], x[~probe])
            if all_query:
                if len(filed[0]) > 1:
                    compare(filed, filed, out)
                if probe.any():
                    compare(filed, (ids[probe], x[probe]), out)
            else:
                compare(filed, (ids[probe], x[probe]), out)

        for batch in batches:
            place = np.asarray(batch.column(0))
            block = np.asarray(batch.column(1))
            probe = np.asarray(batch.column(2).to_numpy(zero_copy_only=False)).astype(bool)
            ids = np.asarray(batch.column(3))
            short = batch.column(4).to_pylist()
            edges = np.flatnonzero((np.diff(place) != 0) | (np.diff(block) != 0)) + 1
            out: list = []
            for a, b in itertools.pairwise([0, *edges.tolist(), len(place)]):
                if a == b:
                    continue
                key = (place[a], block[a])
                if key != current:
                    if held:
                        finish(held, out)
                    held, current = [], key
                held.append((ids[a:b], probe[a:b], short[a:b]))
            yield from _pairs(out)
        out = []
        if held:
            finish(held, out)
        yield from _pairs(out)

    return match


def _pairs(out):
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([o[0] for o in out]), pa.int64()), pa.array(np.concatenate([o[1] for o in out]), pa.int64())],
            names=["query_id", "id"],
        )


def candidates(vectors: DataFrame, search: Search, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, id) that share a visited bucket and look near enough; each pair once.

    queries: (id, dim, unit) of the asking vectors, by default all of `vectors`.
    With all vectors asking, a vector filed in a bucket asks there as well and
    only its perturbed places are sent on top; either side may find a pair.
    """
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    m_of = {d: search.projections_for(n) for d, n in sizes.items()}
    plan_of = {d: (m, search.tables_for(m, queries is None)) for d, m in m_of.items()}
    rows = vectors.select("id", "dim", "unit")
    if queries is None:
        placed = rows.mapInArrow(_placer(plan_of, search, probing=True, filing=True), _PLACED)
    else:
        asking = queries.select("id", "dim", "unit")
        placed = rows.mapInArrow(_placer(plan_of, search, probing=False, filing=True), _PLACED).unionByName(
            asking.mapInArrow(_placer(plan_of, search, probing=True, filing=False), _PLACED)
        )
    hot = None
    if max(sizes.values(), default=0) > search.block_rows:
        hot = _hot_buckets(rows, plan_of, search)
    if hot is None:
        placed = placed.withColumn("block", F.lit(0))
    else:
        placed = _blocked(placed, hot)
    sorted_rows = (
        placed.select("place", "block", "probe", "id", "short")
        .repartition("place", "block")
        .sortWithinPartitions("place", "block")
    )
    return sorted_rows.mapInArrow(_matcher(search, queries is None), _FOUND).dropDuplicates(["query_id", "id"])


def _hot_buckets(rows: DataFrame, plan_of: dict[int, tuple[int, int]], search: Search) -> DataFrame | None:
    """(place, blocks) of the buckets above block_rows, or None if there are none."""
    filed = rows.mapInArrow(_placer(plan_of, search, probing=False, filing=True), _PLACED).select("place")
    hot = filed.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") > search.block_rows)
    hot = cut(hot.select("place", F.ceil(F.col("n") / (search.block_rows / 2)).cast("int").alias("blocks")))
    return None if hot.isEmpty() else hot


def _blocked(placed: DataFrame, hot: DataFrame) -> DataFrame:
    """Number the blocks of hot buckets: a filed vector stays in one block and asks in the others."""
    joined = placed.join(hot, "place", "left")
    every = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
    spread = joined.withColumn("block", F.explode(every))
    return spread.withColumn("probe", F.col("probe") | (F.col("block") != own))


def nearest(vectors: DataFrame, search: Search, only: str | None = None) -> DataFrame:
    """The k most similar other vectors: query_id, neighbour_id, similarity, rank.

    vectors: what unit_vectors() made. only: an SQL condition on id that says
    which vectors ask; by default all do.
    """
    groups = vectors.groupBy("dim", "code").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    members = vectors.select("id", "dim", "code").join(groups, ["dim", "code"]).select("id", "rep", "copies")
    members = cut(members)
    reps = vectors.join(members.where("id = rep").select("id"), "id", "left_semi")
    asking = None
    if only is not None:
        wanted = members.where(F.expr(only)).select(F.col("rep").alias("id")).distinct()
        asking = vectors.join(wanted, "id", "left_semi")
    near = candidates(reps, search, asking)
    exact = _exact(near, vectors).where(F.col("similarity") >= search.min_similarity)
    # From representatives to members: k entries of other groups are enough for each asking group ...
    by_rep = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    exact = exact.withColumn("r", F.row_number().over(by_rep)).where(F.col("r") <= search.k).drop("r")
    asks = members.select(F.col("id").alias("asker"), F.col("rep").alias("query_id"))
    if only is not None:
        asks = asks.where(F.expr(only.replace("id", "asker")))
    firsts = _first_members(members, search.k)
    others = exact.join(firsts.select(F.col("rep").alias("id"), "member"), "id").join(asks, "query_id")
    others = others.select(F.col("asker").alias("query_id"), F.col("member").alias("neighbour_id"), "similarity")
    # ... and members of the own group come first.
    twins = _twins(members, search.k)
    if only is not None:
        twins = twins.where(F.expr(only.replace("id", "query_id")))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    return (
        others.unionByName(twins)
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= search.k)
    )


def _exact(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Exact cosine of candidate pairs from the stored unit vectors."""

    @F.pandas_udf("double")
    def cosine(a, b):
        import pandas as pd

        out, size = np.empty(len(a)), a.map(len).to_numpy()
        for n in np.unique(size):  # one product for the pairs of each number of components
            rows = np.flatnonzero(size == n)
            u, v = (np.frombuffer(b"".join(c.iloc[rows]), dtype=np.float32).reshape(len(rows), -1) for c in (a, b))
            out[rows] = np.einsum("ij,ij->i", u, v, dtype=np.float64)
        return pd.Series(out)

    left = vectors.select(F.col("id").alias("query_id"), F.col("unit").alias("a"))
    right = vectors.select("id", F.col("unit").alias("b"))
    joined = pairs.join(left, "query_id").join(right, "id")
    return joined.select("query_id", "id", F.least(F.lit(1.0), cosine("a", "b")).alias("similarity"))


def _first_members(members: DataFrame, k: int) -> DataFrame:
    """Up to k members with the smallest ids of each group: rep, member."""
    # k + 1 smallest per group by partial aggregation; groups of one need none.
    alone = members.where("copies = 1").select("rep", F.col("id").alias("member"))
    twins = members.where("copies > 1")
    # two steps: a salt first, so that a hot group is never sorted in one task
    salted = Window.partitionBy("rep", "salt").orderBy("id")
    few = (
        twins.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
        .withColumn("r", F.row_number().over(salted))
        .where(F.col("r") <= k)
    )
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k)
    return alone.unionByName(few.select("rep", F.col("id").alias("member")))


def _twins(members: DataFrame, k: int) -> DataFrame:
    """Up to k other members of the own group for each member, by a ring over blocks of about 50,000 members."""
    twins = members.where("copies > 1").withColumn(
        "salt", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("copies") / 50000)))
    )
    ring = Window.partitionBy("rep", "salt").orderBy("id")
    whole = Window.partitionBy("rep", "salt")
    numbered = twins.withColumn("n", F.row_number().over(ring)).withColumn("size", F.count("*").over(whole))
    steps = numbered.withColumn("step", F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(F.col("size") - 1, F.lit(1))))))
    target = steps.withColumn("to", F.pmod(F.col("n") - 1 + F.col("step"), F.col("size")) + 1)
    other = numbered.select("rep", "salt", F.col("n").alias("to"), F.col("id").alias("neighbour_id"))
    return (
        target.join(other, ["rep", "salt", "to"])
        .where(F.col("id") != F.col("neighbour_id"))
        .select(F.col("id").alias("query_id"), "neighbour_id", F.lit(1.0).alias("similarity"))
    )
