"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Rows first fall into blocks by a hash. For every block and shard the number of rows that the block sends to the
shard is drawn from the multivariate hypergeometric law, given the block sizes and the exact shard sizes: what a
uniform random assignment of all rows to the shards would give. Inside a block the rows are put in random order and
dealt to the shards by those counts (first permutation, on the rows' keys), the whole rows go to their shards (exchange), and
get a random order there (second permutation), so every assignment with these shard sizes and every order is equally likely.

All row work is built-in DataFrame functions. The driver only draws the matrix, one row of counts for each
block of about ``BLOCK_ROWS`` rows, ``MAX_BLOCKS`` at most. Random numbers are hashes of a row's values, its number among
equal rows, and the seed, so a lost task gives the same rows again.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bayesloom.llm.shared import materialise, numbered, renamed, row_key

SHARDS = 8
BLOCK_ROWS = 25_000
#: rows of the matrix that the driver draws; larger tables have larger blocks (of keys, not of whole rows)
MAX_BLOCKS = 40_000
#: equal rows that get their numbers in one task
COPIES = 10_000


def hypergeometric(good: int, total: int, draws: int, rng: random.Random) -> int:
    """Number of good ones among ``draws`` of ``total`` without putting back; by inversion from the mode outwards."""
    if good == total or not draws:
        return draws
    if not good:
        return 0
    if draws == total:
        return good
    low, high = max(0, draws - (total - good)), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at_mode = math.exp(log_choose(good, mode) + log_choose(total - good, draws - mode) - log_choose(total, draws))
    left = rng.random()
    if left < at_mode:
        return mode
    left -= at_mode
    up = down = mode
    p_up = p_down = at_mode
    while up < high or down > low:
        if up < high:
            p_up *= (good - up) / (up + 1) * (draws - up) / (total - good - draws + up + 1)
            up += 1
            if left < p_up:
                return up
            left -= p_up
        if down > low:
            p_down *= down / (good - down + 1) * (total - good - draws + down) / (draws - down + 1)
            down -= 1
            if left < p_down:
                return down
            left -= p_down
    return mode  # what rounding leaves


def communication_matrix(blocks: list[tuple[int, int]], shard_sizes: list[int], seed: int) -> Iterator[tuple[int, int, int, int]]:
    """(block, shard, first, end): the block's rows from ``first`` up to ``end`` go to the shard; empty cells are left out."""
    rng = random.Random(f"matrix/{seed}")
    free = list(shard_sizes)
    for block, n in blocks:
        first, left, open_ = 0, n, sum(free)
        for shard in range(len(free)):
            take = hypergeometric(free[shard], open_, left, rng)
            open_ -= free[shard]
            free[shard] -= take
            if take:
                yield block, shard, first, first + take
            first, left = first + take, left - take


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All columns of ``docs`` with ``shard`` (0 .. shards-1; counts at most one apart) and ``slot`` (0, 1, .. in each shard, a random order).

    The first ``n mod shards`` shards have one row more. Columns of those names in ``docs`` are replaced. Equal rows are
    told apart by a number; nulls, empty texts and empty tables need no special case (an empty table gives an empty one).
    """
    source, names = numbered(docs)
    columns = [f"c{i}" for i, name in enumerate(names) if name not in ("shard", "slot")]
    keys = ["__key1", "__key2"]
    source = source.select(*columns)
    keyed = source.select("*", *row_key(source))
    key = lambda k: F.xxhash64(F.lit(seed * 8 + k), "__key1", "__key2", "__copy")
    # the first permutation deals keys and numbers of copies; the rows themselves move when their shards are known
    copies = materialise(_number_copies(keyed))
    n = copies.count()
    n_blocks = min(MAX_BLOCKS, max(1, -(-n // block_rows)))
    placed = copies.withColumn("__block", F.pmod(key(0), F.lit(n_blocks)))
    sizes = [(r[0], r[1]) for r in placed.groupBy("__block").count().orderBy("__block").collect()]
    matrix = list(communication_matrix(sizes, [n // shards + (s < n % shards) for s in range(shards)], seed))
    spark = docs.sparkSession
    sent = spark.createDataFrame(matrix, "b long, shard int, lo long, hi long")
    in_block = Window.partitionBy("__block").orderBy(key(1), "__key1", "__key2", "__copy")
    dealt = placed.withColumn("__place", F.row_number().over(in_block) - 1)
    exchanged = dealt.join(sent, (F.col("__block") == F.col("b")) & (F.col("__place") >= F.col("lo")) & (F.col("__place") < F.col("hi")))
    # the order in a shard is that of a random key, whose top part names a stretch of the shard of about block_rows rows
    stretches = max(1, -(-n // (shards * block_rows)))
    ordered = exchanged.withColumn("__u", key(2)).withColumn("__stretch", F.pmod(F.shiftrightunsigned("__u", 8), F.lit(stretches)))
    held = materialise(ordered.select("shard", *keys, "__copy", "__u", "__stretch"))
    before = Window.partitionBy("shard").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (held.groupBy("shard", "__stretch").count()
               .select("shard", "__stretch", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset")))
    # equal rows meet the places of their copies as one row and lists of at most COPIES places, and go to their shards from there
    whole = keyed.groupBy(*keys).agg(*[F.first(c).alias(c) for c in columns])
    places = (held.groupBy(*keys, F.floor(F.col("__copy") / COPIES).alias("__chunk"))
              .agg(F.collect_list(F.struct("shard", "__copy", "__u", "__stretch")).alias("__places")))
    rows = whole.join(places, keys).withColumn("__at", F.explode("__places")).select(*columns, *keys, "__at.*")
    in_stretch = Window.partitionBy("shard", "__stretch").orderBy("__u", "__key1", "__key2", "__copy")
    return (rows.withColumn("__at", F.row_number().over(in_stretch) - 1).join(offsets, ["shard", "__stretch"])
            .select(*renamed(names, ("shard", "slot")), "shard", (F.col("__offset") + F.col("__at")).cast("long").alias("slot")))


def _number_copies(keyed: DataFrame) -> DataFrame:
    """Keys of equal rows with numbers 0, 1, ..: they are counted with partial sums first, so a row of any frequency is one row in the shuffle."""
    counted = keyed.groupBy("__key1", "__key2").agg(F.count("*").alias("__n"))
    chunks = counted.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / COPIES))))
    copies = F.sequence(F.col("__chunk") * COPIES, F.least((F.col("__chunk") + 1) * COPIES, F.col("__n")) - 1)
    return chunks.withColumn("__copy", F.explode(copies)).select("__key1", "__key2", "__copy")
