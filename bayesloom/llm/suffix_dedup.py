"""Exact removal of repeated substrings through a distributed, sparse suffix array.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else. The strings to compare are all
suffixes cut at ``length`` bytes; sorted, equal ones are neighbours. To sort without moving every suffix:

1. Each string has a leading token: the smallest hash of its substrings of ``length // 2`` bytes. Equal strings have equal tokens, and
   consecutive starts mostly share theirs, so a text falls into *runs* of starts with one token, some hundred bytes each. Runs
   are known by (token, hash of their bytes). A token with one run in the corpus ends there; runs found twice are repeated as
   a whole. (Strings repeated close by, such as in periodic text, are found where they stand.)
2. What is left are tokens with different runs. The bytes of each different run go once into buckets by range of (token,
   share), with splitters that Spark samples; a token whose runs fill more than ``SORT_BYTES`` is cut into shares by their hash.
3. Each bucket sorts the suffixes of its runs by multikey quicksort: by the token, then block by block of ``length // 4`` bytes (known by
   64-bit hashes), only ties going on to the next block. Ties at full length are repeated.
4. The distinct strings of tokens that were cut (a bounded number per bucket) are compared across the boundaries of their
   shares by an aggregation.

Documents are spread over blocks of about ``BLOCK_BYTES`` by a hash, and what the corpus knows of a block's runs is sent
to the block, so that no task needs more than its block. Hash equality stands for equality of bytes (128 bits per run, 256 per string).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayesloom.llm import bytesrows as br
from bayesloom.llm.shared import materialise

LENGTH = 400
BLOCK_BYTES = 32 << 20
#: bytes of a bucket that are sorted at a time, in whole shares of tokens
SORT_BYTES = 4 << 20
#: bytes of runs for a bucket
BUCKET_BYTES = 16 << 20
_SLICE = 1 << 20
_U = np.uint64
ALL, COMPARE, OWNER = 1, 2, 4


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span:width - span + n])


class Runs:
    """Runs of a slice: first and last start, token, hash of the bytes; and the starts of strings repeated within the slice."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, length: int):
        self.raw, self.offs, self.length = raw, offs, length
        rolling = br.RollingHash(raw)
        n = len(raw) - length + 1
        if n <= 0:
            self.first = self.last = self.row = np.zeros(0, np.int64)
            self.token = self.content = np.zeros(0, np.uint64)
            self.near = np.zeros(0, bool)
            return
        half = length // 2
        token = sliding_min(rolling.windows(half), length - half + 1)
        ends = np.repeat(offs[1:], np.diff(offs))[:n]
        valid = np.arange(n) + length <= ends
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (token[1:] != token[:-1])
        stop = valid.copy()
        stop[:-1] &= ~valid[1:] | (token[1:] != token[:-1])
        if length == 1:  # texts follow one another without a gap
            edge = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < n)]
            new[edge] = True
            stop[edge - 1] = True
        self.first, self.last = np.flatnonzero(new), np.flatnonzero(stop)
        self.token = token[self.first]
        self.content = rolling.of(self.first, self.last + length)
        self.row = np.searchsorted(offs, self.first, "right") - 1
        whole = rolling.windows(length)
        ordered = np.sort(whole[valid])
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        self.near = valid & np.isin(whole, twice) if len(twice) else np.zeros(n, bool)


def _find_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(block, token, content, n) of every slice."""
    for batch in batches:
        block = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, _, raw, offs in br.text_slices(batch.column(1), _SLICE):
            runs = Runs(raw, offs, length)
            if not len(runs.first):
                continue
            own = block[lo + runs.row]
            _, at, n = np.unique(br.mix(runs.token ^ br.mix(runs.content + own.astype(np.uint64))), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[at], pa.int32()), pa.array(runs.token[at].view(np.int64)), pa.array(runs.content[at].view(np.int64)), pa.array(n)],
                names=["block", "h", "c", "n"])


def _spans(mark: np.ndarray) -> np.ndarray:
    """Starts and ends, alternating, of the runs of true values."""
    edge = np.diff(np.concatenate([[0], mark.view(np.int8), [0]]))
    return np.flatnonzero(edge)


def _cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:n]) > 0


def _result(raw: np.ndarray, spans: np.ndarray) -> tuple[int, int, int, str]:
    digest = hashlib.sha256()
    at = 0
    for a, b in spans.reshape(-1, 2):
        digest.update(raw[at:a].tobytes())
        at = b
    digest.update(raw[at:].tobytes())
    return len(raw), int((spans[1::2] - spans[::2]).sum()), len(spans) // 2, digest.hexdigest()


class _Answers:
    """What the corpus knows of a block's runs: a value for (token, content)."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def key(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return br.mix(h ^ br.mix(c))

    def add(self, h: np.ndarray, c: np.ndarray, value: np.ndarray) -> None:
        self.parts.append((self.key(h.view(np.uint64), c.view(np.uint64)), value))

    def close(self) -> None:
        keys = np.concatenate([p[0] for p in self.parts]) if self.parts else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = np.concatenate([p[1] for p in self.parts])[order] if self.parts else np.zeros(0, np.int64)

    def find(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        k = self.key(h, c)
        if not len(self.keys):
            return np.full(len(k), -1)
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, at, -1)


def _mark_block(length: int, carry: list[str], names: list[str]):
    """One block's documents (kind 1) and what is known of its runs (kind 0). Gives finished documents (kind 0), documents that wait (1),
    runs that wait (2) and the bytes of runs to sort (3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, block = _Answers(), [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0)[0].as_py()
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            if (kind == 0).any():
                facts = batch.filter(pa.array(kind == 0))
                known.add(*(facts.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3, 4)))
            if (kind == 1).any():
                held.append(batch.filter(pa.array(kind == 1)))
        known.close()
        shipped: set[int] = set()

        def table(kind: int, **columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays(
                [columns.get(f, pa.array(np.full(n, kind, np.int8)) if f == "kind" else pa.array(np.full(n, block, np.int32)) if f == "block" else
                             pa.nulls(n, types[f])) for f in names], names=names)

        types = {"h": pa.int64(), "c": pa.int64(), "s": pa.binary(), "text": pa.string(), "spans": pa.list_(pa.int64()), "starts": pa.list_(pa.int64()),
                 "hs": pa.list_(pa.int64()), "cs": pa.list_(pa.int64()), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "sha": pa.string()}
        for batch in held:
            own = {f"c{i}": batch.column(batch.schema.get_field_index(f"c{i}")) for i in range(len(carry))}
            types |= {k: v.type for k, v in own.items()}
            texts = batch.column(batch.schema.get_field_index("text"))
            for lo, hi, raw, offs in br.text_slices(texts, _SLICE):
                runs = Runs(raw, offs, length)
                at = known.find(runs.token, runs.content)
                flag = np.where(at >= 0, known.values[at], 0) if len(known.values) else np.zeros(len(at), np.int64)
                wait = (flag & COMPARE > 0) & (flag & ALL == 0)
                whole = flag & ALL > 0
                near = np.flatnonzero(runs.near)
                covered = _cover(np.concatenate([runs.first[whole], near]), np.concatenate([runs.last[whole] + length, near + length]), len(raw))
                send = np.flatnonzero(flag & OWNER > 0)
                send = [r for r in send if at[r] not in shipped]
                send = list({int(at[r]): r for r in send}.values())
                if send:
                    shipped.update(int(at[r]) for r in send)
                    yield table(3, h=pa.array(runs.token[send].view(np.int64)), c=pa.array(runs.content[send].view(np.int64)),
                                s=pa.array([raw[runs.first[r]:runs.last[r] + length].tobytes() for r in send], pa.binary()))
                if wait.any():
                    yield table(2, h=pa.array(runs.token[wait].view(np.int64)), c=pa.array(runs.content[wait].view(np.int64)))
                waits = np.zeros(hi - lo, bool)
                waits[runs.row[wait]] = True
                done, rows, spans, later = [], [], [], []
                first_run = np.searchsorted(runs.row, np.arange(hi - lo + 1))
                for r in range(hi - lo):
                    mark = covered[offs[r]:offs[r + 1]]
                    cut = _spans(mark) if mark.any() else np.zeros(0, np.int64)
                    if waits[r]:
                        mine = np.arange(first_run[r], first_run[r + 1])
                        mine = mine[wait[mine]]
                        later.append((r, cut, runs.first[mine] - offs[r], runs.token[mine].view(np.int64), runs.content[mine].view(np.int64)))
                    else:
                        done.append(_result(raw[offs[r]:offs[r + 1]], cut))
                        rows.append(lo + r)
                        spans.append(cut)
                if done:
                    take = pa.array(rows)
                    b, x, s, d = zip(*done, strict=True)
                    yield table(0, **{k: v.take(take) for k, v in own.items()}, n_bytes=pa.array(b, pa.int64()), n_removed=pa.array(x, pa.int64()),
                                n_spans=pa.array(s, pa.int64()), sha=pa.array(d), spans=pa.array(spans, pa.list_(pa.int64())))
                if later:
                    take = pa.array([lo + r for r, *_ in later])
                    lists = [pa.array([x[k] for x in later], pa.list_(pa.int64())) for k in range(1, 5)]
                    yield table(1, **{k: v.take(take) for k, v in own.items()}, text=texts.take(take), spans=lists[0], starts=lists[1], hs=lists[2], cs=lists[3])

    return run


def multikey_ties(group: np.ndarray, tokens: list[np.ndarray]) -> np.ndarray:
    """Multikey quicksort of suffixes by (group, tokens[0], tokens[1], ..), all partitions of a level at once: at each level only
    suffixes that tie so far are ordered by the next token. Returns a tie number per suffix, -1 for those without an equal one."""
    live, tie = np.arange(len(group), dtype=np.int32), group.astype(np.int32)
    for token in tokens:
        order = np.lexsort((token[live], tie))
        live, tie = live[order], tie[order]
        value = token[live]
        new = np.append(True, (tie[1:] != tie[:-1]) | (value[1:] != value[:-1])) if len(live) else np.zeros(0, bool)
        tie = np.cumsum(new, dtype=np.int32)
        several = np.bincount(tie, minlength=1)[tie] > 1
        live, tie = live[several], tie[several]
    out = np.full(len(group), -1, np.int32)
    out[live] = tie
    return out


def _sort_bucket(length: int, edges: np.ndarray):
    """Runs (h, c, s, share) of one bucket, by token and share. Gives (kind 0) the repeated starts of runs, and (kind 1) the distinct strings of the tokens in ``edges``."""

    def sort(h, c, s) -> Iterator[pa.RecordBatch]:
        raw, offs = br.text_bytes(s)
        n = np.diff(offs) - length + 1
        owner = np.repeat(np.arange(len(h), dtype=np.int32), n)
        start = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        cuts = np.linspace(0, length, 5).astype(int)
        tokens = [np.empty(len(owner), np.uint64) for _ in range(4)]
        for lo, hi in br.slices(offs, _SLICE):  # hashes take many times the bytes they stand for
            rolling = br.RollingHash(raw[offs[lo]:offs[hi]])
            at = slice(*np.searchsorted(owner, [lo, hi]))
            pos = (offs[:-1] - offs[lo])[owner[at]] + start[at]
            for token, x, y in zip(tokens, cuts[:-1], cuts[1:], strict=True):
                token[at] = rolling.of(pos + x, pos + y)
        _, group = np.unique(h, return_inverse=True)
        group = group.astype(np.int32)
        tie = multikey_ties(group[owner], tokens)
        twice = tie >= 0
        some = np.flatnonzero(np.bincount(owner[twice], minlength=len(h)))
        if len(some):
            at = np.searchsorted(owner[twice], np.arange(len(h) + 1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.diff(at)[some])), pa.int32()), pa.array(start[twice].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(some), np.int8)), pa.array(h[some].view(np.int64)), pa.array(c[some].view(np.int64)),
                                              lists, pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64())], names=names)
        edge = np.flatnonzero(np.isin(h, edges)[owner])
        if len(edge):
            one = br.mix(tokens[0][edge] + br.mix(tokens[1][edge]))
            two = br.mix(tokens[2][edge] + br.mix(tokens[3][edge]))
            _, first = np.unique(br.mix(one ^ br.mix(two)), return_index=True)
            for lo in range(0, len(first), 50_000):
                f = first[lo:lo + 50_000]
                e = edge[f]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(len(f), np.int8)), pa.array(h[owner[e]].view(np.int64)), pa.array(c[owner[e]].view(np.int64)),
                     pa.array(start[e].astype(np.int64)[:, None].tolist(), pa.list_(pa.int64())), pa.array(one[f].view(np.int64)), pa.array(two[f].view(np.int64))], names=names)

    names = ["kind", "h", "c", "starts", "one", "two"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(parts: list[pa.RecordBatch], last: bool) -> tuple[list[pa.RecordBatch], list]:
            t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            h = t.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            share = t.column(3).to_numpy(zero_copy_only=False)
            cut = len(h) if last else int(np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (share[1:] != share[:-1])))[-1])
            if not cut:
                return [t], []
            out = sort(h[:cut], t.column(1).to_numpy(zero_copy_only=False).view(np.uint64)[:cut], t.column(2).slice(0, cut))
            return ([] if last else [t.slice(cut)]), out

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(2).nbytes
            if size >= SORT_BYTES:
                held, out = flush(held, False)
                yield from out
                size = sum(b.column(2).nbytes for b in held) if out else 0
        if held:
            yield from flush(held, True)[1]

    return run


def _finish_block(length: int, carry: list[str], names: list[str]):
    """One block's waiting documents (kind 1) and the repeated starts of its runs (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lists, held = _Answers(), [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            if (kind == 0).any():
                facts = batch.filter(pa.array(kind == 0))
                h, c = (facts.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                known.add(h, c, np.arange(len(lists), len(lists) + facts.num_rows))
                lists += [np.array(x, np.int64) for x in facts.column(4).to_pylist()]
            if (kind == 1).any():
                held.append(batch.filter(pa.array(kind == 1)))
        known.close()
        for batch in held:
            column = lambda name, b=batch: b.column(b.schema.get_field_index(name))
            raw, offs = br.text_bytes(column("text"))
            done, spans = [], []
            for r in range(batch.num_rows):
                text = raw[offs[r]:offs[r + 1]]
                cut = np.array(column("spans")[r].as_py(), np.int64)
                starts, hs, cs = (np.array(column(k)[r].as_py(), np.int64) for k in ("starts", "hs", "cs"))
                # of one run there can be answers from several sorts
                found = []
                for k, s in zip(known.key(hs.view(np.uint64), cs.view(np.uint64)), starts, strict=True):
                    a, b = np.searchsorted(known.keys, [k, k + _U(1)])
                    found += [s + lists[i] for i in known.values[a:b]]
                at = np.concatenate(found) if found else np.zeros(0, np.int64)
                mark = _cover(np.concatenate([at, cut[::2]]), np.concatenate([at + length, cut[1::2]]), len(text))
                spans.append(_spans(mark))
                done.append(_result(text, spans[-1]))
            b, x, s, d = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays(
                [*(column(f"c{i}") for i in range(len(carry))), pa.array(b, pa.int64()), pa.array(x, pa.int64()), pa.array(s, pa.int64()), pa.array(d),
                 pa.array(spans, pa.list_(pa.int64()))], names=names)

    return run


def dedup(docs: DataFrame, carry: list[str], text: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES,
          bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``carry`` columns, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``spans`` (start and end of each removed stretch, alternating) of
    every whole text as UTF-8 bytes (null: empty).

    Strings never cross documents and are judged on the input. Texts shorter than ``length`` keep all; equal rows are copies of each
    other like any two documents; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    own = [f"c{i}" for i in range(len(carry))]
    src = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(carry, own, strict=True)], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    size = src.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    src = src.withColumn("block", F.pmod(F.xxhash64(*own, "text"), F.lit(blocks)).cast("int"))
    found = materialise(src.select("block", "text").mapInArrow(lambda b: _find_runs(b, length), "block int, h long, c long, n long"))
    # tokens found more than once, then their different runs
    often = found.groupBy("h").agg(F.sum("n").alias("times")).filter("times > 1").select("h")
    several = found.join(often, "h", "left_semi")
    runs = several.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min("block").alias("owner"))
    kinds = runs.groupBy("h").agg(F.count("*").alias("kinds"))
    runs = materialise(runs.join(kinds, "h").select("h", "c", "n", "owner", "kinds"))
    flag = (F.when(F.col("n") > 1, ALL).otherwise(0) + F.when(F.col("kinds") > 1, COMPARE).otherwise(0)
            + F.when((F.col("kinds") > 1) & (F.col("owner") == F.col("block")), OWNER).otherwise(0))
    known = (found.select("block", "h", "c").join(runs, ["h", "c"])
             .select("block", F.lit(0).cast("byte").alias("kind"), "h", "c", flag.cast("int").alias("flag")).distinct())
    documents = src.select("block", F.lit(1).cast("byte").alias("kind"), *own, "text")
    both = known.unionByName(documents, allowMissingColumns=True).repartitionById(blocks, F.col("block"))
    types = dict(src.dtypes)
    fields = {"kind": "byte", "block": "int", **{o: types[o] for o in own}, "h": "long", "c": "long", "s": "binary", "text": "string", "spans": "array<long>",
              "starts": "array<long>", "hs": "array<long>", "cs": "array<long>", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "sha": "string"}
    marked = materialise(both.mapInArrow(_mark_block(length, carry, list(fields)), ", ".join(f"{k} {v}" for k, v in fields.items())))
    answers = _compare(marked.filter("kind = 3").select("h", "c", "s"), length, bucket_bytes)
    waiting = marked.filter("kind = 2").select("block", "h", "c").distinct()
    back = waiting.join(answers, ["h", "c"]).select("block", F.lit(0).cast("byte").alias("kind"), "h", "c", "starts")
    later = marked.filter("kind = 1").select("block", "kind", *own, "text", "spans", "starts", "hs", "cs")
    rest = (back.unionByName(later.withColumn("h", F.lit(None).cast("long")).withColumn("c", F.lit(None).cast("long")), allowMissingColumns=True)
            .select("block", "kind", "h", "c", "starts", *own, "text", "spans", "hs", "cs").repartitionById(blocks, F.col("block")))
    names = [*own, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    finished = rest.mapInArrow(_finish_block(length, carry, names), ", ".join(
        [*(f"{o} {types[o]}" for o in own), "n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", "spans array<long>"]))
    out = marked.filter("kind = 0").withColumnRenamed("sha", "kept_sha256").select(*names).union(finished)
    return out.select(*[F.col(o).alias(c) for c, o in zip(carry, own, strict=True)], *names[len(own):])


def _shared_out(runs: DataFrame, bucket_bytes: int) -> tuple[DataFrame, list[int]]:
    """``runs`` with the share of each, and the tokens that have several (fewer than all bytes over ``SORT_BYTES``)."""
    limit = min(bucket_bytes, SORT_BYTES)
    heavy = materialise(runs.groupBy("h").agg(F.sum(F.length("s")).alias("bytes")).filter(F.col("bytes") > limit))
    shares = F.ceil(F.coalesce("bytes", F.lit(1)) / limit)
    placed = runs.join(F.broadcast(heavy), "h", "left").withColumn("share", F.pmod(F.xxhash64("c"), shares)).drop("bytes")
    return placed, [r["h"] for r in heavy.select("h").collect()]


def _compare(runs: DataFrame, length: int, bucket_bytes: int) -> DataFrame:
    """(h, c, starts): the starts in each run of strings that another run, or another place in it, has too."""
    size = runs.agg(F.sum(F.length("s"))).first()[0] or 0
    buckets = max(2, -(-size // bucket_bytes))
    placed, cut = _shared_out(runs, bucket_bytes)
    sorted_ = materialise(placed.select("h", "c", "s", "share").repartitionByRange(buckets, "h", "share").sortWithinPartitions("h", "share", "c").mapInArrow(
        _sort_bucket(length, np.array(cut, np.int64).view(np.uint64)), "kind byte, h long, c long, starts array<long>, one long, two long"))
    edge = sorted_.filter("kind = 1")
    shared = edge.groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1").select("one", "two")
    across = edge.join(shared, ["one", "two"], "left_semi").select("h", "c", "starts")
    return sorted_.filter("kind = 0").select("h", "c", "starts").union(across)
