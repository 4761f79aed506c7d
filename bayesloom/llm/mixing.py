"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source has the same rate, target over size: its whole part is how often the document
is taken for certain, its fraction the probability of one time more. The cube method turns those
fractions into zeros and ones. Flight: three undecided documents at a time move along the null space of the
balancing constraints (number of documents, number of words) until one of them reaches 0 or 1, to either
side with the probabilities that keep every document's expectation. A few documents of a block stay undecided: up to ``TRIED`` that are kept
back in random order (a third of a small block), and at most two others. Documents too large for the landing to make up for are decided
before the others, by moves along the null space of the words alone.

Flights run in blocks of a source (by a hash of the row), so a source of any size spreads over tasks;
what the blocks leave undecided flies again in blocks of blocks, until one block per source is left. Landing:
the last undecided documents of a source are decided so that the words taken come nearest the balance.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bayesloom.llm.shared import materialise, numbered, renamed, row_key

#: expected rows of a block of the first flight, and blocks that one block of a later flight gathers
BLOCK_ROWS = 5_000
FAN_IN = 64
#: documents that a flight keeps back for the landing: one in so many of the block, no more than TRIED and no fewer than LEAST
SPARED, TRIED, LEAST = 3, 12, 6
#: equal rows that get their numbers in one task
COPIES = 10_000
MAX_REPEATS = 3
SPACE = r"[\x20\x09-\x0D]+"
# fixed values: weights of the sources in code-point order, repeating
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: str):
    """Words of a text (null: none), counted by the blanks between them; no array of the words is made."""
    single = F.trim(F.regexp_replace(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), SPACE, " "))
    blanks = F.length(single) - F.length(F.replace(single, F.lit(" "), F.lit("")))
    return F.when(single == "", 0).otherwise(blanks + 1).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size) with ``target``: all words shared by weight, none above ``repeats`` times its source's words.

    Weights go to sources in code-point order, null last, and repeat. The share level is found at once: in order of
    size per weight, the sources up to some place stop at their bound and the others share the rest. One row per source
    passes through one task.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    bound = repeats * F.col("source_size")
    by_level = Window.orderBy("level", "rank")
    ahead = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("level", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", weight)
            .withColumn("level", bound / F.col("weight"))
            .withColumn("total", F.sum("source_size").over(everything))
            .withColumn("rest", F.col("total") - F.coalesce(F.sum(bound).over(ahead), F.lit(0)))
            .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)))
            .withColumn("at", F.row_number().over(by_level)).withColumn("here", F.col("rest") / F.col("open"))
            .withColumn("share", F.min(F.when(F.col("level") >= F.col("here"), F.struct("at", "here"))).over(everything)["here"])
            .withColumn("target", F.least(bound.cast("double"), F.coalesce(F.col("share") * F.col("weight"), bound.cast("double"))))
            .select("source", "source_size", "target"))


def flight(p: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Move probabilities to 0 or 1 with the sums of ``p`` and of ``p * size`` kept, larger documents first, until at most two are between."""
    p = list(p)
    waiting = sorted((i for i, x in enumerate(p) if 0.0 < x < 1.0), key=lambda i: (size[i], -i))
    held: list[int] = []
    while len(held) + len(waiting) > 2:
        while len(held) < 3:
            held.append(waiting.pop())
        a, b, c = held
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for i, d in zip(held, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(held, u, strict=True):
            x = p[i] + step * d
            p[i] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
        held = [i for i in held if 0.0 < p[i] < 1.0]
        if len(held) == 3:  # rounding alone can keep all three; the one nearest its end goes there
            near = min(held, key=lambda i: min(p[i], 1 - p[i]))
            p[near] = float(p[near] > 0.5)
            held.remove(near)
    return p


def settle(p: np.ndarray, size: np.ndarray, large: float, rng: random.Random) -> np.ndarray:
    """Decide the documents above ``large`` words, the largest first, each by a move of its own along which the words of all stay the
    same: the others give way in proportion to their distance from 0 and 1, which doesn't use up any of them. The number of documents
    can't be balanced by so unequal partners and may move. A document that the others can't make up for stays undecided."""
    p = p.copy()
    order = np.argsort(-size, kind="stable")
    for i in order[size[order] > large]:
        if not 0.0 < p[i] < 1.0:
            continue
        room = np.minimum(p, 1 - p)
        room[i] = 0.0
        capacity = float(room @ size)
        if size[i] > capacity:
            continue
        step = 1 - p[i] if rng.random() < p[i] else -p[i]
        p -= step * size[i] / capacity * room
        p[i] = float(step > 0)
    return p


def landing(p: list[float], size: list[float], wanted: float, taken: float) -> list[float]:
    """Zeros and ones for the undecided. For the ``TRIED + 2`` smallest all outcomes are tried and that is taken whose words come nearest
    ``wanted``, where one document more or less than expected counts like one word; ties: the first. There are more only beside a
    document that all others couldn't make up for; the larger ones then go, largest first, where the words still wanted come
    nearest what the others are expected to give."""
    open_ = sorted((i for i, x in enumerate(p) if 0.0 < x < 1.0), key=lambda i: (-size[i], i))
    p = list(p)
    need, number = wanted - taken, math.fsum(p[i] for i in open_)
    rest = math.fsum(p[i] * size[i] for i in open_)
    cut = max(0, len(open_) - TRIED - 2)
    for i in open_[:cut]:
        rest -= p[i] * size[i]
        p[i] = float(abs(need - size[i] - rest) < abs(need - rest))
        need, number = need - p[i] * size[i], number - p[i]
    words, count = np.zeros(1), np.zeros(1)
    for i in open_[cut:]:
        words, count = np.concatenate([words, words + size[i]]), np.concatenate([count, count + 1])
    best = int((np.abs(words - need) + np.abs(count - number)).argmin())
    for k, i in enumerate(open_[cut:]):
        p[i] = float(best >> k & 1)
    return p


def reserve(n: int) -> int:
    """How many of ``n`` undecided documents, in their random order and whatever their sizes, a flight leaves for the landing."""
    return min(TRIED, max(n // SPARED, LEAST))


def _fly(rows: DataFrame, last: bool, seed: int) -> DataFrame:
    """One flight in every (source, block); with ``last`` the landing follows."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "size", "row"], kind="stable").reset_index(drop=True)
        p, size = pdf["p"].tolist(), pdf["size"].astype(float).tolist()
        rng = random.Random(f"{seed}/{key[0]!r}/{key[1]}")
        wanted = math.fsum(x * s for x, s in zip(p, size, strict=True))
        stay = reserve(sum(0 < x < 1 for x in p))
        large = 0.5 * math.fsum(size[:stay])  # what the landing could hardly make up for
        p[stay:] = settle(np.array(p[stay:]), np.array(size[stay:]), large, rng).tolist()
        alone = [i for i in range(stay, len(p)) if size[i] > large and 0 < p[i] < 1]
        if alone:  # the block hasn't the words for them: half of it waits for the next flight, or all for the landing
            stay = len(p) if last else max(stay, len(p) // 2)
        fly = [i for i in range(stay, len(p)) if i not in alone]
        for i, x in zip(fly, flight([p[i] for i in fly], [size[i] for i in fly], rng), strict=True):
            p[i] = x
        if last:
            sure = math.fsum(s for x, s in zip(p, size, strict=True) if x == 1.0)
            p = landing(p, size, wanted, sure)
        return pdf.assign(p=p)

    return rows.groupBy("source", "block").applyInPandas(run, rows.schema)


def _number_copies(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Rows whose ``row`` tells equal ones apart too. Equal rows are counted with partial sums, so that a third of a table being one
    row is one row in the shuffle; their numbers are made ``COPIES`` at a time."""
    counted = rows.groupBy("source", *carried, "size", "row").agg(F.count("*").alias("n"))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
    numbers = F.sequence(F.col("part") * COPIES, F.least((F.col("part") + 1) * COPIES, F.col("n")) - 1)
    return (parts.withColumn("number", F.explode(numbers))
            .select("source", *carried, "size", F.xxhash64("row", "number").alias("row")))


def mix(docs: DataFrame, carry: list[str], source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS,
        repeats: int = MAX_REPEATS, seed: int = 17, same: list[Column] | None = None) -> DataFrame:
    """``carry`` columns, ``size`` (words; null text: 0), ``source_size``, ``target``, ``times`` and ``taken`` = times * size of every row.

    No row is taken more than ``repeats`` times. Empty documents carry no words; they're taken like the others of their source, at
    no cost. A source without a word has target 0. Repeated rows are documents of their own. Reruns agree: rows are
    ordered by hashes of their values, and equal rows, which get a number each, are exchangeable. ``same`` are columns that tell which
    rows are equal, ``carry`` and the text if not given. An empty table gives an empty result.
    """
    alike = [F.col(f"`{c}`") for c in [*carry, text]] if same is None else same
    rows = docs.select(
        F.col(f"`{source}`").cast("string").alias("source"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)],
        word_count(text).alias("size"), F.xxhash64(*alike).alias("row"))
    rows = materialise(_number_copies(rows, [f"c{i}" for i in range(len(carry))]))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = materialise(targets(per_source.select("source", "source_size"), weights, repeats)
                       .join(per_source.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(repeats)))).otherwise(0.0)
    blocks = F.ceil(F.col("n") / BLOCK_ROWS)
    g = goal.select(F.col("source").alias("s"), "source_size", "target", rate.alias("rate"), blocks.alias("blocks"))
    start = (rows.join(g, F.col("source").eqNullSafe(F.col("s"))).drop("s")
             .withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.floor("rate"))
             .withColumn("u", F.xxhash64(F.lit(seed), "row"))
             .withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "u"), F.col("blocks")))
             .drop("rate", "blocks"))
    most = goal.agg(F.max(blocks)).first()[0] or 1
    decided, rest = [], start
    while True:
        last = most <= 1
        flown = materialise(_fly(rest, last, seed))
        if last:
            decided.append(flown)
            break
        decided.append(flown.filter("p = 0 or p = 1"))
        rest = flown.filter("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / FAN_IN))
        most = -(-most // FAN_IN)
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    times = (F.col("whole") + F.col("p")).cast("long")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "size", "source_size", "target",
                      times.alias("times"), (times * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS,
          repeats: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """The mix itself: the columns of ``docs``, whatever their names, each row as often as it's taken."""
    held, names = numbered(docs)
    # whole rows are written once with a number and meet their times in one join
    held = materialise(held.withColumn("__row", F.monotonically_increasing_id()))
    source_, text_ = (f"c{names.index(n)}" for n in (source, text))
    times = mix(held, ["__row"], source_, text_, weights, repeats, seed, same=row_key(held.drop("__row"))).filter("times > 0").select("__row", "times")
    return (held.join(times.hint("shuffle_hash"), "__row")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*renamed(names)))
