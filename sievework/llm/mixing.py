"""Mix sources to target weights by a low-discrepancy schedule.

The texts of each source, shuffled by a keyed hash, are one stream of tokens
that is cut into blocks of equal size (to a token), at most a slot's; a long
text lies in several blocks. The mix is a sequence of slots, each of which
reads one block, and a source gets as many slots as its quota has blocks. Slot
i takes the point frac((i + 1/2) / golden ratio), which is mapped through the
cumulative weights to a source, so every stretch of the sequence has nearly the
target shares; the few last slots that a source has too many go to those that
lack some. The slots of a source are ranked and read its blocks in turn; after
the last block the source is repeated. A text is used as often as the block
with its middle token is read, so documents and slots agree to half a text.

A source that would have to be repeated more than its cap allows gives all it
may; what is missing goes to the other sources in proportion to their weights
(water filling), so that the total is reached wherever the caps allow it.

Defined results: only sources with a positive weight and a positive cap take
part, null sources and unlisted ones are used 0 times; repeated texts count as
one text, used through the document with the smallest id among those of listed
sources; null and empty texts have no tokens and are used 0 times; weights are
made to sum to 1 over all listed sources; a source listed twice has the sum of
its weights and the smaller cap.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.tokenizer import token_count
from sievework.session import cut

#: 1 / golden ratio, and the fraction of 2 ** 24 times it (2 ** 24 times the double would lose digits).
GOLDEN = 0.6180339887498949
STRIDE = 1 << 24
GOLDEN_STRIDE = float(STRIDE * ((Decimal(5).sqrt() - 1) / 2) % 1)


@dataclass(frozen=True)
class Mix:
    """slot_tokens: size of a slot; bucket_rows: texts of a source that are sorted together, on average; seed: of the shuffle."""

    slot_tokens: int = 512
    bucket_rows: int = 20_000
    seed: int = 11


def water_fill(weights: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Tokens of each source: shares of `total` by weight, none above its cap, the rest refilled."""
    quota = dict.fromkeys(weights, 0.0)
    open_ = {s for s in weights if weights[s] > 0 and caps.get(s, 0) > 0}
    left = total
    while open_ and left > 1e-9:
        weight = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / weight >= caps[s] - 1e-9}
        if not full:
            for s in open_:
                quota[s] = left * weights[s] / weight
            break
        for s in full:
            quota[s] = caps[s]
            left -= caps[s]
        open_ -= full
    return quota


def listed_targets(targets: DataFrame) -> DataFrame:
    """(source, weight, cap), each source once, weights summing to 1."""
    each = (
        targets.where("source is not null and target_weight > 0 and not isnan(target_weight)")
        .groupBy("source")
        .agg(F.sum("target_weight").alias("weight"), F.min(F.coalesce("max_repeats", F.lit(0))).alias("cap"))
    )
    whole = each.agg(F.sum("weight")).scalar()
    return each.withColumn("weight", F.col("weight") / whole)


def sized_texts(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, text_key, tokens), written once; the texts themselves stay behind."""
    return cut(
        documents.select(
            "doc_id",
            "source",
            F.unhex(F.sha2("text", 256)).alias("text_key"),
            token_count(F.col("text"), path).alias("tokens"),
        )
    )


@dataclass(frozen=True)
class Plan:
    """The mix of one corpus, from which usage(), actual_shares() and schedule() follow.

    sized: what sized_texts() made; texts: doc_id, source, tokens, start (the
    source's tokens before it), block (of its middle token) and the source's
    block sizes (size, longer) of each text that may be used; shares: (source, target share, planned share,
    cap, blocks) of each listed source; wanted: slots of each source that has any.
    """

    sized: DataFrame
    texts: DataFrame
    shares: list[tuple]
    wanted: dict[str, int]

    @property
    def slots(self) -> int:
        return sum(self.wanted.values())


def plan(documents: DataFrame, targets: DataFrame, path: str, mix: Mix = Mix()) -> Plan:
    """Work out quotas and blocks. Only per-source sums come to the driver, one row per listed source."""
    sized = sized_texts(documents, path)
    listed = listed_targets(targets)
    goals = {r["source"]: (r["weight"], r["cap"]) for r in listed.collect()}
    spark = sized.sparkSession
    names = spark.createDataFrame([(s,) for s in goals], "source string")
    mine = sized.join(F.broadcast(names), "source", "left_semi")
    total, rows = mine.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    first = mine.where("tokens > 0").groupBy("text_key").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("d")).select("d.*")
    size = mix.slot_tokens
    texts = cut(_in_blocks(first, size, mix.seed, max(1, -(-rows // mix.bucket_rows))))
    sums = texts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    supply = {r["source"]: (r["tokens"], -(-r["tokens"] // size)) for r in sums.collect()}
    caps = {s: float(supply.get(s, (0, 0))[0] * c) for s, (_, c) in goals.items()}
    quota = water_fill({s: w for s, (w, _) in goals.items()}, caps, float(total))
    filled = sum(quota.values())
    wanted = {s: min(round(q * supply[s][1] / supply[s][0]), goals[s][1] * supply[s][1]) for s, q in quota.items() if q > 0}
    shares = [
        (s, goals[s][0], quota[s] / filled if filled else 0.0, goals[s][1], supply.get(s, (0, 0))[1]) for s in sorted(goals)
    ]
    return Plan(sized, texts, shares, {s: n for s, n in sorted(wanted.items()) if n})


def _in_blocks(first: DataFrame, size: int, seed: int, buckets: int) -> DataFrame:
    """Shuffle each source's texts and place them in its stream of tokens and its blocks of at most `size` tokens.

    Running sums go over hash buckets of a source and inside each bucket, so no
    window holds a whole source. A source of T tokens has B = ceil(T / size)
    blocks, the first T mod B of them one token longer than the others.
    """
    keyed = first.withColumn("_k", F.xxhash64(F.lit(seed), "doc_id"))
    keyed = keyed.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(buckets)))
    sums = keyed.groupBy("source", "_bucket").agg(F.sum("tokens").alias("_sum"))
    over = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("_sum").over(Window.partitionBy("source"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(over), F.lit(0))).withColumn("_whole", whole).drop("_sum")
    inside = Window.partitionBy("source", "_bucket").orderBy("_k", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(sums, ["source", "_bucket"])
    placed = placed.withColumn("start", F.col("_before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    placed = placed.withColumn("_blocks", F.ceil(F.col("_whole") / size))
    placed = placed.withColumn("size", F.expr("_whole div _blocks")).withColumn("longer", F.expr("_whole % _blocks"))
    middle = F.col("start") + F.expr("tokens div 2")
    return placed.select("doc_id", "source", "tokens", "start", "size", "longer").withColumn("block", block_of(middle))


def block_of(token: Column) -> Column:
    """The block of a token of the source's stream, from the columns size and longer."""
    head = F.col("longer") * (F.col("size") + 1)
    late = F.try_divide(token - head, F.col("size"))
    return F.when(token < head, F.floor(token / (F.col("size") + 1))).otherwise(F.col("longer") + F.floor(late))


def block_texts(p: Plan) -> DataFrame:
    """(source, block, doc_id, from_token, to_token): which tokens of which texts make up each block, in order of `start`.

    Every block has as many tokens as the others of its source, give or take one.
    """
    end = F.col("start") + F.col("tokens")
    spread = p.texts.withColumn("block", F.explode(F.sequence(block_of(F.col("start")), block_of(end - 1))))
    begins = F.col("block") * F.col("size") + F.least("block", "longer")
    ends = begins + F.col("size") + (F.col("block") < F.col("longer")).cast("bigint")
    inside = [(F.greatest(begins, "start") - F.col("start")).alias("from_token"), (F.least(ends, end) - F.col("start")).alias("to_token")]
    return spread.select("source", "block", "doc_id", "start", *inside)


def slot_sources(p: Plan, spark) -> DataFrame:
    """(slot, source) of the whole schedule, in which each source has just the slots it wants."""
    ends, upto = [], 0
    for s, n in p.wanted.items():
        upto += n
        ends.append((s, upto / p.slots))
    if not ends:
        return spark.createDataFrame([], "slot bigint, source string")
    # frac(id / golden ratio) in two parts, so that no digits are lost at any id
    x = F.floor(F.col("id") / STRIDE) * GOLDEN_STRIDE
    x = x - F.floor(x) + (F.pmod("id", F.lit(STRIDE)) + 0.5) * GOLDEN
    x = x - F.floor(x)
    source = F.lit(ends[-1][0])
    for s, end in reversed(ends[:-1]):
        source = F.when(x < end, F.lit(s)).otherwise(source)
    slots = spark.range(p.slots).select(F.col("id").alias("slot"), source.alias("source"))
    got = {r["source"]: r["count"] for r in slots.groupBy("source").count().collect()}
    spare = []  # a few of each source, as the points are spread evenly
    for s, n in p.wanted.items():
        if got.get(s, 0) > n:
            spare += [r["slot"] for r in slots.where(F.col("source") == s).orderBy(F.desc("slot")).limit(got[s] - n).collect()]
    lacking = [s for s, n in p.wanted.items() for _ in range(n - got.get(s, 0))]
    moved = F.col("source")
    for s in dict.fromkeys(lacking):
        moved = F.when(F.col("slot").isin([i for i, x in zip(sorted(spare), lacking) if x == s]), F.lit(s)).otherwise(moved)
    return slots.withColumn("source", moved)


def schedule(p: Plan, spark, stretch: int = 65536) -> DataFrame:
    """(slot, source, nth, pass, block): the nth slot of a source reads its block nth modulo blocks."""
    slots = slot_sources(p, spark).withColumn("_stretch", F.floor(F.col("slot") / stretch))
    counts = slots.groupBy("source", "_stretch").agg(F.count("*").alias("_n"))
    over = Window.partitionBy("source").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(over), F.lit(0))).drop("_n")
    inside = Window.partitionBy("source", "_stretch").orderBy("slot")
    ranked = slots.join(counts, ["source", "_stretch"]).withColumn("nth", F.col("_before") + F.row_number().over(inside) - 1)
    sizes = spark.createDataFrame([(s, b) for s, _, _, _, b in p.shares if b], "source string, blocks bigint")
    joined = ranked.join(F.broadcast(sizes), "source")
    return joined.select(
        "slot",
        "source",
        "nth",
        F.floor(F.col("nth") / F.col("blocks")).alias("pass"),
        F.pmod("nth", "blocks").alias("block"),
    )


def usage(p: Plan, spark) -> DataFrame:
    """(doc_id, source, tokens, uses) of every document, by joining slots to the texts whose middle lies in their blocks.

    A source has at most cap slots for each of its blocks, so no text is used more often than that.
    """
    reads = schedule(p, spark).groupBy("source", "block").agg(F.count("*").alias("uses"))
    used = p.texts.join(reads, ["source", "block"]).select("doc_id", "uses")
    every = p.sized.select("doc_id", "source", "tokens").join(used, "doc_id", "left")
    return every.withColumn("uses", F.coalesce("uses", F.lit(0)))


def actual_shares(p: Plan, spark) -> DataFrame:
    """(source, target_share, planned_share, actual_share, tokens, documents) of each listed source."""
    goals = spark.createDataFrame([(s, w, q) for s, w, q, _, _ in p.shares], "source string, target_share double, planned_share double")
    used = usage(p, spark).where("uses > 0").groupBy("source").agg(
        F.sum(F.col("uses") * F.col("tokens")).alias("tokens"), F.count("*").alias("documents")
    )
    joined = goals.join(used, "source", "left")
    filled = joined.withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
    whole = filled.agg(F.sum("tokens")).scalar()
    return filled.withColumn("actual_share", F.coalesce(F.try_divide("tokens", whole), F.lit(0.0)))
