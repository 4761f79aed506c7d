"""Language-model scores by context-tree weighting over bytes.

The next byte is eight binary decisions (a path through a tree of 255 bit nodes); every bit node has its own context
tree over the preceding bytes, up to ``DEPTH`` of them. A node (context, bit node) holds counts of zeros and ones in the
training texts, whose Krichevsky-Trofimov block probability is Pe. From the deepest contexts up, the weighted probability is
Pw = Pe / 2 + (product of the Pw of the contexts one byte longer) / 2, and Pe alone at full depth. A prediction mixes the
estimates (ones + 1/2) / (all + 1) of all depths, the one at depth d with the posterior weight Pe / (2 Pw) of what the deeper ones
leave; below the deepest context seen in training nothing is mixed in. Texts start behind ``DEPTH`` zero bytes and end with
byte 0xFF, which no UTF-8 text holds, so the probabilities of all texts sum to one.

How it's spread: documents fall into blocks of about ``BLOCK_BYTES`` by a hash. A block gives its distinct strings of ``DEPTH`` + 1
bytes and distinct words with their training counts; sums over blocks are the corpus counts. Context trees are weighted in
groups by the last three context bytes (at most 256**3 strings at this depth), depths 0 to 2 in aggregations over the groups' roots. The
values of a block's own strings go back to the block, which scores its documents: no task holds more than a block and its strings,
however large the corpus or the model is, and nothing of the model passes through the driver but the at most 65,535 nodes of depth 0 and 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayesloom.llm import bytesrows as br
from bayesloom.llm.shared import materialise

DEPTH = 5
BLOCK_BYTES = 48 << 20
END = 0xFF
#: strings that a task weights at a time, in whole groups
GROUP_ROWS = 300_000
GRAM, WORD = 0, 1
#: key of the end that counts as a token behind each text's words
END_TOKEN = br.hash_word("\u0000end of text") >> 1
_U = np.uint64
_HALF = np.log(0.5)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series from x + 8."""
    y = x + 8.0
    shift = np.ones_like(y)
    for i in range(8):
        shift = shift * (x + i)
    r = 1.0 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov block probability of counts."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - np.log(np.pi)


def gram_keys(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of every byte and every end: the last DEPTH bytes, nearest first, above the byte itself."""
    n = len(offs) - 1
    size = np.diff(offs)
    step = size + DEPTH + 1
    new = np.cumsum(step) - step
    line = np.zeros(int(step.sum()), np.uint8)
    body = np.ones(len(line), bool)
    for k in range(DEPTH):
        body[new + k] = False
    body[new + step - 1] = False
    line[body] = br.LOWER[raw]
    line[new + step - 1] = END
    wide = line.astype(np.uint64)
    key = wide[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        key |= wide[DEPTH - k:len(line) - k] << _U(8 * (DEPTH + 1 - k))
    real = np.ones(len(key), bool)  # windows that end in the padding of a following text are not predictions
    for k in range(DEPTH):
        at = new[1:] + k - DEPTH
        real[at] = False
    return key[real], np.repeat(np.arange(n), size + 1)


def word_keys(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of every word in lower case."""
    start, end, row = br.word_spans(raw, offs)
    return br.RollingHash(raw, br.LOWER).of(start, end) >> _U(1), row


class _Tally:
    """Sums of counts by key, folded as they come."""

    def __init__(self):
        self.parts, self.rows, self.kept = [], 0, 0

    def add(self, keys: np.ndarray, train: np.ndarray) -> None:
        """``train`` (0 or 1) of every occurrence of a key below 2**63."""
        ordered = np.sort(keys << _U(1) | train.astype(np.uint64))
        keys, train = ordered >> _U(1), (ordered & _U(1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self._keep(keys[first], np.add.reduceat(train, first) if len(first) else train)

    def _keep(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.rows += len(keys)
        if self.rows > 1.5 * self.kept + 1_000_000:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([p[0] for p in self.parts]) if self.parts else np.zeros(0, np.uint64)
        counts = np.concatenate([p[1] for p in self.parts]) if self.parts else np.zeros(0, np.int64)
        self.parts.clear()
        order = np.argsort(keys, kind="stable")  # parts are sorted already
        keys, counts = keys[order], counts[order]
        del order
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        unique = keys[first]
        self.parts = [(unique, np.add.reduceat(counts, first) if len(first) else counts)]
        self.rows = self.kept = len(unique)
        return self.parts[0]


class _Values:
    """Values by key, in an open hash table: slots are probed for all keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            out = self.slot[at] != left
            left, at = left[out], (at[out] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys that are all there."""
        at = self._home(keys)
        found = self.slot[at]
        left = np.flatnonzero(self.keys[found] != keys)
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found[left] = self.slot[at[left]]
            left = left[self.keys[found[left]] != keys[left]]
        return self.values[found]


def _count_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, kind, key, n) of one block: its distinct strings and words, n occurrences in training texts."""
    tallies, block, ends = {GRAM: _Tally(), WORD: _Tally()}, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(0)[0].as_py()
        train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        ends += int(train.sum())
        for lo, hi, raw, offs in br.text_slices(batch.column(2)):
            for kind, of in ((GRAM, gram_keys), (WORD, word_keys)):
                keys, row = of(raw, offs)
                tallies[kind].add(keys, train[lo:hi][row] if len(row) else row)
    if block is None:
        return
    tallies[WORD]._keep(np.array([END_TOKEN], np.uint64), np.array([ends]))
    for kind, tally in tallies.items():
        keys, counts = tally.fold()
        for lo in range(0, len(keys), 100_000):
            k, c = keys[lo:lo + 100_000], counts[lo:lo + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(k), block, np.int32)), pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(c)],
                names=["block", "kind", "key", "n"])
    tallies.clear()
    br.give_back()


# ---- context trees -------------------------------------------------------------------------------------------------
# a node key is the context, nearest byte in front, above eight bits of the bit node

def _bit_nodes(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 8) bit nodes that a byte passes, and the bit it takes there."""
    j = np.arange(8, dtype=np.uint64)
    node = (_U(1) << j)[None, :] | (byte[:, None] >> (_U(8) - j)[None, :])
    return node, (byte[:, None] >> (_U(7) - j)[None, :]) & _U(1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(wanted.shape, -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def weigh(keys: np.ndarray, counts: np.ndarray, root: int):
    """Weight the context trees of whole groups of strings from full depth up to depth ``root``.

    Returns the root nodes (key, zeros, ones, log Pw) and for every string its eight mixed probabilities of the bits it takes,
    from ``root`` downwards (NaN where no training text has the context).
    """
    byte, context = keys & _U(255), keys >> _U(8)
    node, bit = _bit_nodes(byte)
    seen = counts > 0
    levels = {}
    at, back = np.unique(((context[seen] << _U(8))[:, None] | node[seen]).ravel(), return_inverse=True)
    n = np.repeat(counts[seen], 8).astype(float)
    ones = np.bincount(back, weights=n * bit[seen].ravel(), minlength=len(at))
    zeros = np.bincount(back, weights=n, minlength=len(at)) - ones
    pe = log_kt(zeros, ones)
    levels[DEPTH] = (at, zeros, ones, pe, pe)
    for depth in range(DEPTH - 1, root - 1, -1):
        below, zeros, ones, _, pw = levels[depth + 1]
        at, back = np.unique(below >> _U(16) << _U(8) | below & _U(255), return_inverse=True)
        zeros, ones, pw = (np.bincount(back, weights=x, minlength=len(at)) for x in (zeros, ones, pw))
        pe = log_kt(zeros, ones)
        levels[depth] = (at, zeros, ones, pe, np.logaddexp(pe, pw) + _HALF)
    mixed = np.full(node.shape, np.nan)
    for depth in range(DEPTH, root - 1, -1):
        at, zeros, ones, pe, pw = levels[depth]
        where = _find(at, (context >> _U(8 * (DEPTH - depth)) << _U(8))[:, None] | node)
        has = where >= 0
        kt = (np.where(bit == 1, ones[where], zeros[where]) + 0.5) / (zeros[where] + ones[where] + 1.0) if len(at) else mixed
        weight = np.exp(_HALF + pe[where] - pw[where]) if len(at) else mixed
        mixed = np.where(has, np.where(np.isnan(mixed), kt, weight * kt + (1 - weight) * mixed), mixed)
    at, zeros, ones, _, pw = levels[root]
    return at, zeros, ones, pw, mixed


def _weigh_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings in key order: root nodes of depth 3 (kind 0), and every string with its mixed probabilities (kind 1)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, zeros, ones, pw, mixed = weigh(keys, counts, 3)
        for kind, key, x in ((0, at, np.stack([zeros, ones, pw], axis=1)), (1, keys, mixed)):
            for lo in range(0, len(key), 50_000):
                k, v = key[lo:lo + 50_000], x[lo:lo + 50_000]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), lists], names=["kind", "key", "x"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)))
        if sum(len(k) for k, _ in held) >= GROUP_ROWS:
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            group = keys >> _U(8 * (DEPTH - 2))
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield from out(keys[:cut], counts[:cut])
            held = [(keys[cut:], counts[cut:])]
    if held:
        yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))
    br.give_back()


def _log_kt_column(zeros: str, ones: str) -> Column:
    @F.pandas_udf("double")
    def kt(z: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series(log_kt(z.to_numpy(float), o.to_numpy(float)))

    return kt(zeros, ones)


def _up(nodes: DataFrame) -> DataFrame:
    """Nodes one byte of context shorter."""
    parent = F.shiftleft(F.shiftright("key", 16), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))
    sums = nodes.groupBy(parent.alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("pw").alias("below"))
    sums = sums.withColumn("pe", _log_kt_column("zeros", "ones"))
    top = F.greatest("pe", "below")
    both = top + F.log1p(F.exp(F.least("pe", "below") - top)) + F.lit(float(_HALF))
    return sums.select("key", "zeros", "ones", both.alias("pw"), F.exp(F.lit(float(_HALF)) + F.col("pe") - both).alias("weight"),
                       ((F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)).alias("kt"))


def _down(nodes: DataFrame, above: DataFrame | None) -> DataFrame:
    """Nodes with ``acc`` and ``left``: what depths up to this one give to a one, and the share left to deeper ones; ``end``: the
    probability of a one where no deeper context is seen."""
    if above is None:
        led = nodes.withColumn("a", F.lit(0.0)).withColumn("l", F.lit(1.0))
    else:
        parent = F.shiftleft(F.shiftright("key", 16), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))
        led = nodes.withColumn("up", parent).join(above.select(F.col("key").alias("up"), F.col("acc").alias("a"), F.col("left").alias("l")), "up")
    return led.select("key", (F.col("a") + F.col("l") * F.col("weight") * F.col("kt")).alias("acc"),
                      (F.col("l") * (1 - F.col("weight"))).alias("left"), (F.col("a") + F.col("l") * F.col("kt")).alias("end"))


def _finish(short: dict[tuple[int, int], float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in order of (two context bytes, kind): depth-2 nodes, then the strings behind them. Gives (key, log10 probability)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, values = np.zeros(0, np.uint64), np.zeros((0, 3))
        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            key = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            x = batch.column(3)
            flat, width = x.flatten().to_numpy(zero_copy_only=False), np.diff(x.offsets.to_numpy())
            starts = np.cumsum(width) - width
            top = np.flatnonzero(kind == 0)
            if len(top):
                nodes = np.concatenate([nodes, key[top]])
                values = np.concatenate([values, flat[starts[top][:, None] + np.arange(3)]])
                order = np.argsort(nodes)
                nodes, values = nodes[order], values[order]
            rows = np.flatnonzero(kind == 1)
            if len(rows):
                k = key[rows]
                deep = flat[starts[rows][:, None] + np.arange(8)]
                node, bit = _bit_nodes(k & _U(255))
                context = k >> _U(8 * (DEPTH - 1))
                at = _find(nodes, (context << _U(8))[:, None] | node)
                acc, left, end = (np.where(at >= 0, values[at, i] if len(nodes) else np.nan, np.nan) for i in range(3))
                one = bit == 1
                p = np.where(one, acc, 1 - left - acc) + left * deep
                stop = np.where(one, end, 1 - end)
                p = np.where(np.isnan(deep), stop, p)
                for r, j in zip(*np.nonzero(np.isnan(p)), strict=True):  # not even two bytes of context seen: shorter ones, then a half
                    b = int(node[r, j])
                    q = short.get((1, (int(context[r]) >> 8) << 8 | b), short.get((0, b), 0.5))
                    p[r, j] = q if one[r, j] else 1 - q
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.log10(p).sum(axis=1))], names=["key", "value"])
            last = batch.column(0)[batch.num_rows - 1].as_py() if batch.num_rows else None
            if last is not None:
                same = (nodes >> _U(8)) == _U(last)
                nodes, values = nodes[same], values[same]

    return run


def string_scores(counts: DataFrame, parts: int) -> DataFrame:
    """(key, value): log10 probability of the last byte of every string in ``counts`` (key, n; n = 0 for strings only asked for)."""
    group = F.shiftright("key", 8 * (DEPTH - 2))
    weighed = materialise(counts.select("key", "n").repartition(parts, group).sortWithinPartitions("key")
                          .mapInArrow(_weigh_groups, "kind byte, key long, x array<double>"))
    roots = weighed.filter("kind = 0").select("key", F.col("x")[0].alias("zeros"), F.col("x")[1].alias("ones"), F.col("x")[2].alias("pw"))
    two = materialise(_up(roots))
    one = materialise(_up(two))
    none = materialise(_up(one))
    down0 = _down(none, None)
    down1 = materialise(_down(one, down0))
    down2 = _down(two, down1)
    # at most 255 + 256 * 255 rows
    short = {(d, r["key"]): r["end"] for d, nodes in ((0, down0), (1, down1)) for r in nodes.select("key", "end").collect()}
    top = down2.select(F.shiftright("key", 8).alias("c"), F.lit(0).cast("byte").alias("kind"), "key", F.array("acc", "left", "end").alias("x"))
    strings = weighed.filter("kind = 1").select(F.shiftright("key", 8 * (DEPTH - 1)).alias("c"), "kind", "key", "x")
    out = (top.union(strings).repartition(parts, "c").sortWithinPartitions("c", "kind")
           .mapInArrow(_finish(short), "key long, value double"))
    return out


# ---- scores -----------------------------------------------------------------------------------------------------------

def _score_block(total: int, distinct: int, carry: list[str], names: list[str]):
    """Rows of one block: values of its strings and words (kind 0, 1) and its documents (kind 2) in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_parts, held = [], []
        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            for k in (GRAM, WORD):
                at = np.flatnonzero(kind == k)
                if len(at):
                    value_parts.append((k, batch.column(2).to_numpy(zero_copy_only=False)[at], batch.column(3).to_numpy(zero_copy_only=False)[at]))
            if (kind == 2).any():
                held.append(batch.filter(pa.array(kind == 2)).select([f"c{i}" for i in range(len(carry))] + ["text"]))
        tables = {}
        for k in (GRAM, WORD):
            keys = np.concatenate([p[1] for p in value_parts if p[0] == k] or [np.zeros(0, np.int64)]).view(np.uint64)
            values = np.concatenate([p[2] for p in value_parts if p[0] == k] or [np.zeros(0)])
            tables[k] = _Values(keys, values)
        value_parts.clear()
        norm = total + 0.1 * (distinct + 1)

        def sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
            return np.bincount(row, weights=values, minlength=n) if len(row) else np.zeros(n)

        ends = tables[WORD].find(np.array([END_TOKEN], np.uint64))[0] if held else 0.0
        base = lambda c: np.log10((c + 0.1) / norm)
        for batch in held:
            for lo, hi, raw, offs in br.text_slices(batch.column(len(carry))):
                n = hi - lo
                g, g_row = gram_keys(raw, offs)
                w, w_row = word_keys(raw, offs)
                words = np.bincount(w_row, minlength=n) if len(w_row) else np.zeros(n, np.int64)
                count = tables[WORD].find(w)
                score = sums(tables[GRAM].find(g), g_row, n)
                known = sums(count > 0, w_row, n) + (ends > 0)
                plain = sums(base(count), w_row, n) + base(ends)
                size = np.diff(offs)
                part = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(carry)], pa.array(words.astype(np.int64) + 1), pa.array(known.astype(np.int64)), pa.array(np.full(n, total, np.int64)),
                     pa.array(plain), pa.array(score), pa.array(-score / np.log10(2) / np.maximum(size + 1, 1))], names=names)
        tables.clear()
        held.clear()
        br.give_back()

    return run


def score(docs: DataFrame, carry: list[str], train: Column, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``carry`` columns and the scores of every whole text (null: empty), from the texts of the rows where ``train`` holds (null: not).

    ``n_tokens`` (words and one end), ``n_known``, ``train_tokens``, ``base_score`` (smoothed unigram), ``score`` (log10 probability by context-tree
    weighting) and ``bits_per_byte`` (code length over bytes and end). A-Z count as a-z. Without training texts every bit has probability one
    half and the base gives every token probability one. Repeated rows each give a row; an empty table gives an empty one.
    """
    src = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.coalesce(train, F.lit(False)).alias("train"),
                      F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    size = src.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    spread = F.pmod(F.xxhash64(*[f"c{i}" for i in range(len(carry))], "text"), F.lit(blocks)).cast("int")
    src = src.withColumn("block", spread)
    asked = materialise(src.select("block", "train", "text").repartitionById(blocks, F.col("block"))
                        .mapInArrow(_count_block, "block int, kind byte, key long, n long"))
    counts = asked.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    words = counts.filter(F.col("kind") == WORD)
    total = words.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    strings = string_scores(counts.filter(F.col("kind") == GRAM), parts).select(F.lit(GRAM).cast("byte").alias("kind"), "key", "value")
    values = strings.union(words.select("kind", "key", F.col("n").cast("double").alias("value")))
    answers = asked.select("block", "kind", "key").join(values, ["kind", "key"]).select("block", "kind", "key", "value")
    documents = src.select("block", F.lit(2).cast("byte").alias("kind"), F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("value"),
                           *[f"c{i}" for i in range(len(carry))], "text")
    both = answers.unionByName(documents, allowMissingColumns=True).repartitionById(blocks, F.col("block"))
    schema = docs.select(*[F.col(f"`{c}`") for c in carry]).schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"), ("bits_per_byte", "double")):
        schema = schema.add(name, kind)
    return both.mapInArrow(_score_block(total["n"] or 0, total["v"], carry, [f.name for f in schema]), schema)
