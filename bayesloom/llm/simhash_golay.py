"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each a word of the shortened perfect binary
Golay code [23, 12, 7], which decodes every 23-bit word to the one codeword within three bits.
Two words of one segment that differ in at most one bit share a codeword: the codeword of either
is among the codewords of the other and its one-bit neighbours (six at most). If two fingerprints
differ in at most three bits, at least two of their segments differ in at most one bit each, so
keys are pairs of codewords: an index row holds a fingerprint's own codewords, a probe row those
of its neighbourhood. One-error-in-both is only needed for one pair of segments, because any other
spread of three errors leaves some pair with an untouched segment. The join on keys therefore
finds every pair within three bits; the exact bit distance is checked in the join condition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayesloom.llm import bytesrows as br
from bayesloom.llm.shared import components, materialise, numbered, renamed, row_key

# fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1
GENERATOR = 0b110001110101
#: (lowest bit, bits) of the segments of a 64-bit fingerprint
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: pairs of segments; the last pair also takes one error in both
PAIRS = ((0, 1), (0, 2), (1, 2))
MAX_DISTANCE = 3


def _syndrome(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 11 and high 12 bits, and the error pattern of each syndrome."""
    unit = [_syndrome(1 << i) for i in range(23)]
    low, high = np.zeros(2048, np.int64), np.zeros(4096, np.int64)
    for i in range(11):
        low ^= np.where(np.arange(2048) >> i & 1, unit[i], 0)
    for i in range(12):
        high ^= np.where(np.arange(4096) >> i & 1, unit[11 + i], 0)
    error = np.zeros(2048, np.int64)
    for i in range(23):
        error[unit[i]] = 1 << i
        for j in range(i):
            error[unit[i] ^ unit[j]] = 1 << i | 1 << j
            for k in range(j):
                error[unit[i] ^ unit[j] ^ unit[k]] = 1 << i | 1 << j | 1 << k
    return low, high, error


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within three bits of each 23-bit word."""
    low, high, error = _tables()
    return (words ^ error[low[words & 2047] ^ high[words >> 11]]) >> 11


def nearby_codewords(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(own codeword, codewords of the word and its one-bit neighbours padded with -1), each row's distinct."""
    own = decode(words)
    near = np.empty((len(words), bits + 1), np.int64)
    near[:, 0] = own
    for i in range(bits):
        near[:, i + 1] = decode(words ^ (1 << i))
    near.sort(axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near = -np.sort(-near, axis=1)
    return own, near[:, :max(1, int((near >= 0).sum(axis=1).max(initial=1)))]


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, is_probe) of all index and probe keys of a batch of fingerprints (uint64)."""
    rows, keys, probe = [], [], []
    ids = np.arange(len(fp))
    parts = [nearby_codewords(((fp >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64), n) for lo, n in SEGMENTS]

    def add(pair: int, left: np.ndarray, right: np.ndarray, who: np.ndarray, is_probe: bool) -> None:
        rows.append(who)
        keys.append(pair << 24 | left << 12 | right)
        probe.append(np.full(len(who), is_probe))

    for pair, (i, j) in enumerate(PAIRS):
        (own_i, near_i), (own_j, near_j) = parts[i], parts[j]
        add(pair, own_i, own_j, ids, False)
        for x in range(near_i.shape[1]):
            for y in range(near_j.shape[1]):
                a, b = near_i[:, x], near_j[:, y]
                use = (a >= 0) & (b >= 0)
                if pair < 2:
                    use &= (a == own_i) | (b == own_j)
                if use.any():
                    add(pair, a[use], b[use], ids[use], True)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(probe)


def fingerprints(docs: DataFrame, carry: list[str], text: str = "text", words: int = 3, fp: str = "fp") -> DataFrame:
    """``carry`` columns and the 64-bit SimHash of every whole text.

    A-Z in lower case, white-space words, shingles of ``words`` words with repeats, XXH64 with seed 42;
    a bit is 1 if set in over half of the shingle hashes. Texts with fewer words have one shingle,
    texts without a word (null and empty ones too) fingerprint 0.
    """
    src = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = src.drop("__text").schema.add(fp, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            value = np.zeros(batch.num_rows, np.uint64)
            for lo, hi, raw, offs in br.text_slices(batch.column(at)):
                value[lo:hi] = _simhash(raw, offs, words)
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value.view(np.int64))], names=[*carry, fp])
        br.give_back()

    return src.mapInArrow(run, schema)


def _simhash(raw: np.ndarray, offs: np.ndarray, words: int) -> np.ndarray:
    n = len(offs) - 1
    joined, start, end, row = br.single_spaced(raw, offs)
    per_row = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    last_word = np.cumsum(per_row) - 1
    at = np.arange(len(start))
    stop = np.minimum(at + words - 1, last_word[row]) if len(at) else at
    use = (at + words - 1 <= last_word[row]) | ((per_row[row] < words) & (at == last_word[row] - per_row[row] + 1)) if len(at) else at.astype(bool)
    at, stop, row = at[use], stop[use], row[use]
    counts = br.bit_counts(br.xxh64(joined, start[at], end[stop]), row, n)
    total = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    bits = counts * 2 > total[:, None]
    return (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def links(prints: DataFrame, fp: str = "fp", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints that differ in at most ``max_distance`` (0 to 3) bits."""
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError("the Golay keys guarantee distances of 0 to 3 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fps), 20_000):
                part = fps[lo:lo + 20_000]
                row, key, probe = golay_keys(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.int32)), pa.array(part[row].view(np.int64)), pa.array(probe)], names=["k", "f", "probe"])

    keyed = prints.select(fp).distinct().mapInArrow(run, "k int, f long, probe boolean")
    probe = keyed.filter("probe").select("k", F.col("f").alias("a"))
    index = keyed.filter("not probe").select("k", F.col("f").alias("b"))
    return (probe.join(index, (probe.k == index.k) & (F.col("a") < F.col("b"))
                       & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance))
            .select("a", "b").distinct())


def near_duplicates(docs: DataFrame, carry: list[str], id_col: str = "doc_id", text: str = "text",
                    words: int = 3, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Every row's ``carry`` columns, ``fp``, ``root`` (the component's smallest fingerprint) and
    ``component_id``: the smallest id reachable over links.

    Copies share a fingerprint and are folded before the search, so groups of copies cost one row.
    Null ids get a component too; a component of null ids alone has a null id. Empty tables give empty results.
    """
    prints = materialise(fingerprints(docs, carry, text, words))
    groups = components(links(prints, "fp", max_distance))
    folded = prints.groupBy("fp").agg(F.min(id_col).alias("low")).join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    folded = folded.withColumn("root", F.coalesce("root", "fp"))
    smallest = folded.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = folded.join(smallest, "root").select("fp", "root", "component_id")
    return prints.join(classes, "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3,
             max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the smallest id (null ids last),
    among rows of that id that of the smallest row key; of identical rows one stays. All columns are kept, whatever their names.

    Whole rows are written once with a number and meet the numbers to keep in one join; no aggregate sees a text.
    """
    held, names = numbered(docs)
    id_, text_ = f"c{names.index(id_col)}", f"c{names.index(text)}"
    held = materialise(held.withColumn("__row", F.monotonically_increasing_id()))
    keys = row_key(held.drop("__row"))
    found = near_duplicates(held.select(id_, text_, "__row", *keys), [id_, "__row", "__key1", "__key2"], id_, text_, words, max_distance)
    first = F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("id"), "__key1", "__key2", "__row")
    kept = found.groupBy("root").agg(F.min(first).alias("w")).select("w.__row")
    return held.join(kept.hint("shuffle_hash"), "__row", "left_semi").select(*renamed(names))
