"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted shingles.

Words are runs of letters, digits and non-ASCII bytes with A-Z in lower case, shingles five words
(an item of fewer words is one shingle). Each item is compared with every window of as many words as
it has; a document with fewer words is one window. The similarity of window and item is that of their
shingle multisets: the sum of minimum counts over the sum of maximum counts.

1. A window can only reach the similarity s if at least s/(1+s) of both multisets together are common,
   so windows with fewer positions whose shingle any item has are left out; this loses no pair.
2. The 64-bit SimHash of each window left is looked up in a multi-index: eight blocks of eight bits,
   each probed within ``radius // 8`` bits, which by the pigeonhole principle meets every item of that
   size within ``radius`` bits. At similarity 0.8 two multisets differ by an angle of at most 27 degrees,
   9.7 bits on average with a deviation of 2.9, so the default radius of 24 bits lies five deviations away.
3. The exact similarity of the remaining pairs decides.

Items go to the tasks in groups of at most ``GROUP_BYTES`` of text; a larger benchmark takes several
passes over the documents, each with a bounded group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayesloom.llm import bytesrows as br

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24
GROUP_BYTES = 4 << 20
#: shingles of windows that are expanded at a time
EXPAND = 400_000
_BITMAP = 1 << 20


def _words(raw: np.ndarray, offs: np.ndarray):
    start, end, row = br.word_spans(raw, offs, ~br.ALNUM)
    return start, end, row, br.RollingHash(raw, br.LOWER).of(start, end)


def _simhash(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    total = np.bincount(owner, minlength=n)
    bits = br.bit_counts(h, owner, n) * 2 > total[:, None]
    return (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and position of every element of the ranges first .. first+count-1."""
    owner = np.repeat(np.arange(len(first)), count)
    return owner, np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class ItemIndex:
    """One group of items: shingle lookup, sizes, fingerprints and Hamming blocks."""

    def __init__(self, texts: list[str | None], similarity: float, radius: int):
        self.similarity, self.radius = similarity, radius
        raw, offs = br.text_bytes(pa.array(texts, pa.string()))
        _, _, row, words = _words(raw, offs)
        self.size = np.bincount(row, minlength=len(texts)).astype(np.int64) if len(row) else np.zeros(len(texts), np.int64)
        first = np.cumsum(self.size) - self.size
        length = np.minimum(self.size, SHINGLE)
        self.n_shingles = np.where(self.size > 0, self.size - length + 1, 0)
        item, hashes = [], []
        for k in range(1, SHINGLE + 1):
            own = np.flatnonzero((length == k) & (self.size > 0))
            if len(own):
                h = br.sequence_hash(words, k)
                who, at = _expand(first[own], self.n_shingles[own])
                item.append(own[who])
                hashes.append(_salted(h[at], k))
        self.item = np.concatenate(item) if item else np.zeros(0, np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(self.item, kind="stable")
        self.item, h = self.item[order], h[order]
        self.keys = np.unique(h)
        self.bitmap = np.zeros(_BITMAP, bool)
        self.bitmap[self.keys & np.uint64(_BITMAP - 1)] = True
        code, weight = np.unique(self.item * max(1, len(self.keys)) + np.searchsorted(self.keys, h), return_counts=True)
        self.code, self.weight = code, weight
        self.fp = _simhash(h, self.item, len(texts))
        self.sizes = np.unique(self.size[self.size > 0])
        self._blocks()

    def _blocks(self) -> None:
        """Items by (size, block, byte of the fingerprint): pointers by code and one item list."""
        live = np.flatnonzero(self.size > 0)
        place = np.searchsorted(self.sizes, self.size[live])
        codes = np.concatenate([
            (place * 8 + b) * 256 + ((self.fp[live] >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64) for b in range(8)
        ]) if len(live) else np.zeros(0, np.int64)
        order = np.argsort(codes, kind="stable")
        self.block_items = np.tile(live, 8)[order] if len(live) else live
        self.block_at = np.searchsorted(codes[order], np.arange(len(self.sizes) * 2048 + 1))
        reach = self.radius // 8
        self.flips = np.array([m for m in range(256) if bin(m).count("1") <= reach], np.int64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash among the items' shingles, -1 if no item has it."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.bitmap[(h & np.uint64(_BITMAP - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == h[maybe], at, -1)
        return out

    def near(self, fp: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of one size (``place`` in ``sizes``) within ``radius`` bits."""
        found = []
        for b in range(8):
            byte = ((fp >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)
            codes = ((place * 8 + b) * 256)[:, None] + (byte[:, None] ^ self.flips[None, :])
            first, count = self.block_at[codes], self.block_at[codes + 1] - self.block_at[codes]
            w, f = np.nonzero(count)
            owner, at = _expand(first[w, f], count[w, f])
            found.append(w[owner] * len(self.size) + self.block_items[at])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        w, item = pairs // max(1, len(self.size)), pairs % max(1, len(self.size))
        ok = np.bitwise_count(fp[w] ^ self.fp[item]) <= self.radius
        return w[ok], item[ok]

    def search(self, raw: np.ndarray, offs: np.ndarray):
        """Verified pairs of a slice: (row, item, first byte, end byte, similarity) arrays."""
        start, end, row, words = _words(raw, offs)
        parts = []
        if len(words) and len(self.keys):
            n_words = np.bincount(row, minlength=len(offs) - 1)
            first_word = np.cumsum(n_words) - n_words
            for k in sorted({int(min(x, SHINGLE)) for x in self.sizes}):
                places = np.flatnonzero(np.minimum(self.sizes, SHINGLE) == k)
                parts += self._search_length(k, places, words, row, n_words, first_word)
        if not parts:
            z = np.zeros(0, np.int64)
            return z, z, z, z, np.zeros(0)
        w_first, w_last, item, sim = (np.concatenate(x) for x in zip(*parts, strict=True))
        return row[w_first], item, start[w_first] - offs[row[w_first]], end[w_last] - offs[row[w_first]], sim

    def _search_length(self, k, places, words, row, n_words, first_word):
        """Windows of the sizes at ``places``, whose shingles have k words."""
        n = len(words) - k + 1
        if n <= 0:
            return []
        h = _salted(br.sequence_hash(words, k), k)
        known = self.lookup(h)
        known[row[:n] != row[k - 1:k - 1 + n]] = -1
        flagged = np.flatnonzero(known >= 0)
        if not len(flagged):
            return []
        total = np.zeros(n + 1, np.int64)
        np.cumsum(known >= 0, out=total[1:])
        widest = int(self.sizes[places].max()) - k + 1
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, np.maximum(flagged - widest + 1, 0), 1)
        np.add.at(change, flagged + 1, -1)
        near = np.flatnonzero(np.cumsum(change[:n]) > 0)
        ratio = self.similarity / (1 + self.similarity)
        out = []
        for place in places:
            size = int(self.sizes[place])
            m = size - k + 1
            p = near[near + m <= n]
            p = p[row[p] == row[np.minimum(p + size - 1, len(row) - 1)]]
            p = p[p + size <= first_word[row[p]] + n_words[row[p]]]
            p = p[total[p + m] - total[p] >= ratio * 2 * m - 1e-9]
            count = np.full(len(p), m)
            if k == SHINGLE:  # documents shorter than the item are one window
                short = np.unique(row[flagged])
                short = short[(n_words[short] < size) & (n_words[short] >= k)]
                at, own = first_word[short], n_words[short] - k + 1
                ok = total[at + own] - total[at] >= ratio * (m + own) - 1e-9
                p, count = np.concatenate([p, at[ok]]), np.concatenate([count, own[ok]])
            for lo in _chunks(count):
                found = self._verify(p[lo], count[lo], place, h, known)
                if len(found[0]):
                    w, item, sim = found
                    out.append((p[lo][w], p[lo][w] + count[lo][w] + k - 2, item, sim))
        return out

    def _verify(self, p, count, place, h, known):
        owner, at = _expand(p, count)
        fp = _simhash(h[at], owner, len(p))
        w, item = self.near(fp, np.full(len(p), place, np.int64))
        # distinct known shingles of each window, with counts
        has = known[at] >= 0
        code, times = np.unique(owner[has] * len(self.keys) + known[at][has], return_counts=True)
        own, key = code // len(self.keys), code % len(self.keys)
        first = np.searchsorted(own, np.arange(len(p)))
        n_known = np.searchsorted(own, np.arange(len(p)), "right") - first
        pair, element = _expand(first[w], n_known[w])
        wanted = item[pair] * len(self.keys) + key[element]
        there = np.minimum(np.searchsorted(self.code, wanted), len(self.code) - 1)
        common = np.where(self.code[there] == wanted, np.minimum(self.weight[there], times[element]), 0)
        common = np.bincount(pair, weights=common, minlength=len(w))
        sim = common / (count[w] + self.n_shingles[item] - common) if len(w) else common
        ok = sim >= self.similarity - 1e-12
        return w[ok], item[ok], sim[ok]


def _salted(h: np.ndarray, k: int) -> np.ndarray:
    return h if k == SHINGLE else br.mix(h + np.uint64(k))


def _chunks(count: np.ndarray) -> Iterator[slice]:
    ends = np.cumsum(count)
    lo = 0
    while lo < len(count):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + EXPAND, "right")))
        yield slice(lo, hi)
        lo = hi


def _groups(items: DataFrame, id_col: str, text: str) -> Iterator[list]:
    """Bounded groups of (id, text) rows; by their hash, so that no group depends on the order of the table."""
    narrow = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).distinct()
    size = narrow.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-size // GROUP_BYTES)
    for g in range(n):
        yield narrow.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == g).sort("id", "text").collect()


def matches(docs: DataFrame, items: DataFrame, carry: list[str], text: str = "text", item_id: str = "item_id",
            item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per document row and item it holds: ``carry``, ``item_id``, ``first_byte``, ``end_byte`` of the best window
    (ties: the first), ``similarity``, ``n_windows`` (windows that reach the similarity).

    Null and empty texts have no window and empty items match nothing; repeated document rows each give their rows, repeated
    items one. An empty table on either side gives an empty result.
    """
    src = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").cast("string").alias("__text"))
    id_type = items.schema[item_id].dataType
    schema = (src.drop("__text").schema.add("item_id", id_type).add("first_byte", "long").add("end_byte", "long")
              .add("similarity", "double").add("n_windows", "long"))

    def scan(group: list) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(([r["id"] for r in group], [r["text"] for r in group]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, texts = shared.value
            index, out_ids = ItemIndex(texts, similarity, radius), None
            for batch in batches:
                at = batch.schema.get_field_index("__text")
                for lo, _, raw, offs in br.text_slices(batch.column(at)):
                    row, item, first, end, sim = index.search(raw, offs)
                    if not len(row):
                        continue
                    order = np.lexsort((first, -sim, item, row))
                    row, item, first, end, sim = (x[order] for x in (row, item, first, end, sim))
                    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])))
                    n = np.diff(np.append(new, len(row)))
                    taken = batch.take(pa.array(row[new] + lo))
                    columns = [c for i, c in enumerate(taken.columns) if i != at]
                    out_ids = pa.array([ids[i] for i in item[new]])
                    yield pa.RecordBatch.from_arrays(
                        [*columns, out_ids, pa.array(first[new]), pa.array(end[new]), pa.array(sim[new]), pa.array(n)],
                        names=[f.name for f in schema])

        return src.mapInArrow(run, schema)

    parts = [scan(g) for g in _groups(items, item_id, item_text)]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
          similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``docs`` without the rows that hold an item; the others unchanged, in one pass per group of items and without a shuffle."""

    def scan(src: DataFrame, group: list) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast([r["text"] for r in group])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, similarity, radius)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                at = batch.schema.get_field_index(text)
                for lo, _, raw, offs in br.text_slices(batch.column(at).cast(pa.string())):
                    keep[index.search(raw, offs)[0] + lo] = False
                yield batch.filter(pa.array(keep))

        return src.mapInArrow(run, src.schema)

    return reduce(scan, _groups(items, item_id, item_text), docs)
