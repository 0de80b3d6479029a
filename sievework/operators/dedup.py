"""Chunk deduplication inside documents and reuse of embeddings across them."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.config import Dedup
from sievework.functions import text as tx
from sievework.session import cut

#: Rows of signatures that one task matches at a time, about.
BUCKET_ROWS = 16384


def content_hash(text: Column) -> Column:
    """SHA-256 of the cleaned text; empty for null."""
    return F.when(text.isNull(), "").otherwise(F.sha2(tx.clean(text), 256))


def body(text: Column) -> Column:
    """The cleaned text with trimmed lines and without its first heading line, wherever that is."""
    lines = F.transform(F.split(tx.clean(text), "\n"), tx.trim_all)

    def rest(l: Column) -> Column:
        at = F.array_position(F.transform(l, tx.is_heading), F.lit(True))
        return tx.let(at, lambda n: F.array_join(F.filter(l, lambda _, i: (i + 1) != n), "\n"))

    return tx.clean(tx.let(lines, rest))


def body_hash(text: Column, config: Dedup = Dedup()) -> Column:
    """SHA-256 of the body; empty if it is shorter than min_length."""
    return tx.let(body(text), lambda b: F.when(F.length(b) < config.min_length, "").otherwise(F.sha2(b, 256)))


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct character n-grams of the body without white space; a shorter text is its own, an empty one has none."""

    def grams(c: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (size - 1), F.lit(1))), lambda i: c.substr(i, F.lit(size)))
        none = F.array().cast("array<string>")
        return F.when(F.length(c) == 0, none).when(F.length(c) < size, F.array(c)).otherwise(F.array_distinct(every))

    return tx.let(F.regexp_replace(text, tx.BLANKS, ""), grams)


def _mixed(z: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (splitmix64)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _gram_hashes(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text without white space; a shorter text is its own."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = min(size, len(c))
    h = np.full(len(c) - size + 1, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(size):
        h = _mixed(h + c[i : i + len(h)])
    return np.unique(h)


def compact_bodies(chunks: DataFrame, size: int = 5) -> DataFrame:
    """(document_id, id, s, code): the bodies without white space, where any is left, and a 128-bit hash of their shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            codes = [xxh3_128_digest(_gram_hashes(t, size).tobytes()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], names=["document_id", "id", "s", "code"])

    compact = F.regexp_replace(body(F.col("content")), tx.BLANKS, "")
    bodies = chunks.select(F.col("document_id").cast("bigint").alias("document_id"), F.col("id").cast("bigint").alias("id"), compact.alias("s"))
    return bodies.where("length(s) > 0").mapInArrow(run, "document_id bigint, id bigint, s string, code binary")


def exact(chunks: DataFrame, order: list[str], config: Dedup = Dedup()) -> DataFrame:
    """Adds hash, body_hash and kept: the first chunk of each content and of each body in its document.

    Blank chunks are dropped; those shorter than min_length bypass the checks
    and are kept. A chunk removed for its content has a kept twin with the same
    body, so both checks may look at all chunks at once. Windows are on
    (document, hash): a document's copies of one text, not a whole document.
    """
    out = chunks.where(F.length(tx.trim_all(F.coalesce("content", F.lit("")))) > 0)
    out = out.withColumn("_len", F.length(tx.clean(F.col("content")))).withColumn("hash", content_hash(F.col("content")))
    out = out.withColumn("body_hash", body_hash(F.col("content"), config))
    short = F.col("_len") < config.min_length
    first = F.row_number().over(Window.partitionBy("document_id", "hash", short).orderBy(*order)) == 1
    body_first = F.row_number().over(Window.partitionBy("document_id", "body_hash", short).orderBy(*order)) == 1
    unique_body = (F.col("body_hash") == "") | body_first if config.body_hash else F.lit(True)
    return out.withColumn("kept", short | (first & unique_body)).drop("_len")


def body_classes(chunks: DataFrame, config: Dedup = Dedup()) -> DataFrame:
    """(document_id, id, rep, s) written to the shared folder: chunks of one document with equal shingles share rep, their smallest id.

    s is the body without white space, null but for the representatives: a text
    is an eighth of the hashes of its shingles. Blank bodies are in no class.
    Rows delivered more than once may come along; the texts are moved once.
    """
    coded = compact_bodies(chunks, config.shingle_size).repartition("document_id", "code").dropDuplicates(["document_id", "code", "id"])
    found = coded.withColumn("rep", F.min("id").over(Window.partitionBy("document_id", "code")))
    return cut(found.select("document_id", "id", "rep", F.when(F.col("id") == F.col("rep"), F.col("s")).alias("s")))


def _signatures(batches: Iterator[pa.RecordBatch], size: int, t: float, split: dict[int, int], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, document_id, id, n, band, r, sigs) of the texts (document_id, id, s), as of similar_pairs()."""
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        sets = [_gram_hashes(x, size) for x in batch.column(2).to_pylist()]
        edges = [1]  # band k has the sizes from edges[k] to edges[k + 1] - 1; a set's size / t is in its band or the next
        while edges[-1] <= max(map(len, sets), default=0):
            edges.append(math.floor(edges[-1] / t + 1e-9) + 1)
        for document, key, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
            own, parts = bisect.bisect_right(edges, len(h)) - 1, split.get(document, 1)
            for band in range(max(0, own - 1), own + 1):
                p = math.floor((edges[band + 1] - 1) * (1 - t) / t + 1e-6) + 1
                ends = np.searchsorted((h >> np.uint64(32)) * np.uint64(p) >> np.uint64(32), np.arange(p + 1, dtype=np.uint64))
                sigs = (_mixed(sums[ends[1:]] - sums[ends[:-1]]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                for r in range(min(parts, p)):
                    row = (hash((document, band, r)) % buckets, document, key, len(h), band, r, sigs[r::parts])
                    for c, v in zip(out, row):
                        c.append(v)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["bucket", "document_id", "id", "n", "band", "r", "sigs"])


def _agreeing(rows: pa.Table, t: float) -> pa.Table:
    """(document_id, a, b) of the rows of _signatures() of one bucket that have a signature in common and sizes that fit."""
    schema = pa.schema([("document_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    rows = rows.combine_chunks()
    document, key, n, band, r = (rows[c].to_numpy() for c in ("document_id", "id", "n", "band", "r"))
    sigs = rows["sigs"].combine_chunks()
    each = np.diff(sigs.offsets.to_numpy())
    row = np.repeat(np.arange(len(key)), each)
    place = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    base = _mixed(_mixed(document.astype(np.uint64)) + (band.astype(np.uint64) << np.uint64(32)) + r.astype(np.uint64))
    keys = _mixed(base[row] + _mixed((place.astype(np.uint64) << np.uint64(32)) | sigs.flatten().to_numpy().view(np.uint32).astype(np.uint64)))
    order = np.argsort(keys)
    keys, row = keys[order], row[order]
    found, held, at, d = np.zeros(0, np.int64), [], np.arange(len(keys)), 1
    while len(at):  # the runs of equal keys, at a growing distance
        at = at[at + d < len(keys)]
        at = at[keys[at] == keys[at + d]]
        x, y = row[at], row[at + d]
        fit = (document[x] == document[y]) & (key[x] != key[y]) & (np.minimum(n[x], n[y]) >= t * np.maximum(n[x], n[y]) - 1e-6)
        held.append(np.minimum(x, y)[fit] * len(key) + np.maximum(x, y)[fit])
        d += 1
        if not len(at) or sum(map(len, held)) > 4_000_000:
            found, held = np.unique(np.concatenate([found, *held])), []
    x, y = np.divmod(found, max(len(key), 1))
    return pa.table([document[x], np.minimum(key[x], key[y]), np.maximum(key[x], key[y])], schema=schema)


def _jaccards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Adds the similarity of the two texts in the last two columns in their place."""
    grams = lambda c: {c[i : i + size] for i in range(max(1, len(c) - size + 1))}
    for batch in batches:
        both = [(grams(x), grams(y)) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
        shared = [len(x & y) for x, y in both]
        values = [s / (len(x) + len(y) - s) for s, (x, y) in zip(shared, both)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(values, pa.float64())], names=["document_id", "a", "b", "jaccard"])


def similar_pairs(chunks: DataFrame, config: Dedup = Dedup(), classes: DataFrame | None = None) -> DataFrame:
    """(document_id, a, b, jaccard) of classes of chunks of one document with at least the threshold.

    a and b are the classes' representatives, body_classes() tells the members;
    copies are in one class and no pair. Two sets above the threshold t differ in
    at most D = m (1 - t) / t shingles, m the smaller one's size; so of D + 1
    ranges of the hashes at least one holds the same shingles of both, and its
    sum is a signature that texts with common phrases don't share. D is that of
    a band of sizes, a set is in its own band and the one below. A row has all
    signatures of a set and band; a document of many sets has several rows, each
    with some of the ranges. Pairs that share a signature are compared by text.
    """
    t, size = config.threshold, config.shingle_size
    sets = (classes if classes is not None else body_classes(chunks, config)).where("s is not null and document_id is not null").select("document_id", "id", "s")
    n = sets.count()
    large = sets.groupBy("document_id").count().where(F.col("count") > BUCKET_ROWS)
    split, buckets = {r["document_id"]: -(-r["count"] // BUCKET_ROWS) for r in large.collect()}, max(1, -(-2 * n // BUCKET_ROWS))
    kinds = "bucket int, document_id bigint, id bigint, n int, band int, r int, sigs array<int>"
    signed = sets.mapInArrow(lambda batches: _signatures(batches, size, t, split, buckets), kinds)
    agreeing = signed.groupBy("bucket").applyInArrow(lambda rows: _agreeing(rows, t), "document_id bigint, a bigint, b bigint")
    pairs = cut(agreeing.distinct())
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = cut(sets.join(ids, "id", "left_semi"))
    left, right = texts.select(F.col("id").alias("a"), F.col("s").alias("sa")), texts.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("document_id", "a", "b", "sa", "sb")
    return both.mapInArrow(lambda batches: _jaccards(batches, size), "document_id bigint, a bigint, b bigint, jaccard double").where(F.col("jaccard") >= t)


def greedy_kept(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(document_id, id) of chunks dropped because an earlier retained chunk is similar.

    pairs and classes: of similar_pairs() and body_classes(). Chunks are
    retained or dropped in id order, dropped ones suppress nothing. A copy of an
    earlier chunk always goes: what retains or drops the first of a class drops
    the others. Among representatives, those without an undecided earlier one
    are retained, all similar to them dropped, and so on; the rounds are the
    longest chain of such decisions, and no group is gathered in one task.
    """
    dropped = classes.where("id <> rep").select("document_id", "id")
    open_ = cut(pairs.select("document_id", "a", "b"))
    while not open_.isEmpty():
        waiting = open_.select(F.col("b").alias("a"))
        firsts = open_.select("a").distinct().join(waiting, "a", "left_anti")
        gone = cut(open_.join(firsts, "a", "left_semi").select("document_id", "b").distinct())
        dropped = dropped.unionByName(gone.select("document_id", F.col("b").alias("id")))
        left = open_.join(gone.select("b"), "b", "left_anti")
        open_ = cut(left.join(gone.select(F.col("b").alias("a")), "a", "left_anti").select("document_id", "a", "b"))
    return dropped


def reusable(chunks: DataFrame, documents: DataFrame, min_length: int = 30) -> DataFrame:
    """(id, source_id): the first chunk with equal content and a vector in another finished document of the same base.

    Equal contents are grouped by (base, hash): per group the smallest source
    of the first document and of any other document are enough to serve all.
    """
    done = documents.select(F.col("id").alias("document_id"), "knowledge_base_id", "status")
    keyed = chunks.where(F.length(tx.trim_all(F.col("content"))) >= min_length).join(done, "document_id")
    keyed = keyed.select("id", "document_id", "knowledge_base_id", "status", content_hash(F.col("content")).alias("hash"), F.length(F.coalesce("vector_id", F.lit(""))).alias("_v"))
    group = ["knowledge_base_id", "hash"]
    sources = keyed.where("status = 1 and _v > 0").groupBy(*group, "document_id").agg(F.min("id").alias("source_id"))
    best = sources.groupBy(*group).agg(F.min(F.struct("source_id", "document_id")).alias("one"))
    second = sources.join(best, group).where(F.col("document_id") != F.col("one.document_id")).groupBy(*group).agg(F.min("source_id").alias("two"))
    offered = best.join(second, group, "left")
    served = keyed.join(offered, group)
    source = F.when(F.col("document_id") != F.col("one.document_id"), F.col("one.source_id")).otherwise(F.col("two"))
    return served.select("id", source.alias("source_id")).where("source_id is not null")
