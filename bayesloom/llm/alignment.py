"""Cross-tokenizer alignment with white-space tokens as anchors.

Every text is encoded whole by both tokenizers. A byte offset where a token ends in both, with tokens behind it that start
with a space in both, is an anchor; between anchors lie windows of token ids, mostly words, and a window's alignment (its
groups and links) depends on its two tuples of ids alone, so each different window is aligned once and remembered.

Encoding whole texts is done by parts too: neither tokenizer joins what is before a space behind a visible character
with what follows, so a text's ids are those of its pieces between such spaces, and each different piece is encoded
once and its tokens' bytes compared with its own. ``Vocabulary`` proves the first from the files.

How often a pair of ids is linked is a question to the corpus. Documents refer to the pairs of their block (a stretch of a
partition) by number; each block's pairs go out once, are counted by a shuffled aggregation and come back to
the block. No table of pairs is collected or broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bayesloom.llm import bytesrows as br
from bayesloom.llm.shared import materialise

#: bytes of text worked on at a time; a block ends after so many bytes or different pairs of ids
SLICE = 2 << 20
BLOCK, BLOCK_PAIRS = 64 << 20, 1 << 20
#: pieces and windows that a worker remembers
KNOWN = 1 << 20


class Numbering:
    """Numbers 64-bit keys from 0 as they first appear."""

    def __init__(self):
        self.keys, self.ids, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's number, and where the new ones first stand, in the order of their numbers."""
        code, key = pd.factorize(keys)
        order = np.argsort(key)
        key = key[order]
        place = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == key[inside]
        new = np.flatnonzero(~known)
        ids = np.empty(len(key), np.int64)
        ids[known] = self.ids[place[known]]
        ids[new] = self.n + np.arange(len(new))
        self.n += len(new)
        self.keys = np.insert(self.keys, place[new], key[new])
        self.ids = np.insert(self.ids, place[new], ids[new])
        first = np.empty(len(key), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        back = np.empty(len(key), np.int64)
        back[order] = ids
        return back[code], first[order][new]


class Ragged:
    """Lists of integers by number, appended and fetched many at a time."""

    def __init__(self):
        self.flat, self.at, self.count = (_Growing() for _ in range(3))

    def append(self, flat: np.ndarray, count: np.ndarray) -> None:
        self.at.append(self.flat.n + np.cumsum(count) - count)
        self.count.append(count)
        self.flat.append(flat)

    def fetch(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.count.values[ids]
        return self.flat.values[spread(self.at.values[ids], count)], count


class _Growing:
    def __init__(self):
        self.values, self.n = np.zeros(1 << 12, np.int64), 0

    def append(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros(max(len(self.values), len(more)), np.int64)])
        self.values[self.n:self.n + len(more)] = more
        self.n += len(more)


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each start, ``count`` of them, one after another."""
    return np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for U+0100 and on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer file's encoder and the bytes of its tokens: .json byte-level (tokenizers), .model (sentencepiece).

    ``encode`` takes texts without the space that stands before each of them.
    """

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            if any("▁" in p.lstrip("▁") for p in pieces):
                raise ValueError(f"{path}: a piece goes on over a space")
            self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            model.encode_special_tokens = True
            if type(model.pre_tokenizer).__name__ != "ByteLevel" or model.normalizer is not None:
                raise ValueError(f"{path}: not a plain byte-level tokenizer")
            byte = _byte_of_char()
            self.bytes = [b""] * model.get_vocab_size()
            for token, i in model.get_vocab().items():
                self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
            self.encode = lambda texts: [e.ids for e in model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.space = np.array([b[:1] == b" " for b in self.bytes])
        self.code = np.random.Generator(np.random.PCG64(12 if path.endswith(".model") else 11)).integers(1, 1 << 63, len(self.bytes), dtype=np.uint64) | np.uint64(1)


def stable_spaces(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Places of spaces behind a visible character, but for a text's last byte: no token of either kind goes over them.

    Visible are ASCII signs and characters whose first byte begins no white space (not C2, E1, E2, E3).
    """
    before = np.zeros(256, bool)
    before[0x21:0x7F] = True
    at = np.flatnonzero(raw[1:] == 0x20) + 1
    good = before[raw[at - 1]]
    tail = (raw[at - 1] & 0xC0) == 0x80
    if tail.any():
        lead = np.zeros(256, bool)
        lead[[*range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True
        for back in (2, 3, 4):
            there = tail & (at >= back)
            first = raw[np.maximum(at - back, 0)]
            found = there & (first >= 0xC0)
            good |= found & lead[first]
            tail &= ~found
    at = at[good]
    ends = np.zeros(len(raw) + 1, bool)
    ends[offs] = True
    return at[~ends[at] & ~ends[at + 1]]


class PiecePair:
    """Ids of pieces of text under two tokenizers, each different piece encoded once."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.a, self.b = a, b
        self.forget()

    def forget(self) -> None:
        self.names, self.ids_a, self.ids_b, self.good = Numbering(), Ragged(), Ragged(), _Growing()

    def of(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        piece, new = self.names.of(br.RollingHash(raw).of(start, end))
        if len(new):
            data = raw.tobytes()
            own = [data[s:e] for s, e in zip(start[new].tolist(), end[new].tolist())]
            texts = [x.decode("utf-8", "replace") for x in own]
            good = np.ones(len(new), bool)
            for vocabulary, store in ((self.a, self.ids_a), (self.b, self.ids_b)):
                ids = vocabulary.encode(texts)
                of = vocabulary.bytes.__getitem__
                good &= [b"".join(map(of, x)) == b" " + y for x, y in zip(ids, own)]
                store.append(np.fromiter((i for x in ids for i in x), np.int64), np.array([len(x) for x in ids], np.int64))
            self.good.append(good)
        return piece


def _span_hash(ids: np.ndarray, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of ids."""
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(codes[ids] * br.powers(len(ids)), out=sums[1:])
    inverse = br.powers(len(ids) + 1, br.BASE_INVERSE)
    return br.mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


class Windows:
    """Alignments of windows of ids, each different window aligned once: groups as text, links as numbers of id pairs."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.a, self.b = a, b
        self.forget()

    def forget(self) -> None:
        self.names, self.links, self.groups, self.texts = Numbering(), Ragged(), _Growing(), []
        self.pairs, self.pair_keys = Numbering(), _Growing()

    def of(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows of a stretch of tokens (the bytes of both are the same): their numbers, and the first A token of each."""
        end_a, end_b = np.cumsum(self.a.size[ids_a]), np.cumsum(self.b.size[ids_b])
        mark_a, mark_b = np.zeros(int(end_a[-1]) + 1, bool), np.zeros(int(end_a[-1]) + 1, bool)
        mark_a[end_a] = True
        mark_b[end_b] = True
        last_a, last_b = np.flatnonzero(mark_b[end_a]), np.flatnonzero(mark_a[end_b])  # last tokens of the groups
        anchor = np.ones(len(last_a), bool)
        anchor[:-1] = self.a.space[ids_a[last_a[:-1] + 1]] & self.b.space[ids_b[last_b[:-1] + 1]]
        cut = np.flatnonzero(anchor)  # last groups of the windows
        to_a, to_b = last_a[cut] + 1, last_b[cut] + 1
        from_a, from_b = np.concatenate([[0], to_a[:-1]]), np.concatenate([[0], to_b[:-1]])
        key = _span_hash(ids_a, self.a.code, from_a, to_a)
        key = br.mix(key * np.uint64(0x9E3779B97F4A7C15) + _span_hash(ids_b, self.b.code, from_b, to_b))
        window, new = self.names.of(key)
        if len(new):
            n_groups = np.diff(cut, prepend=-1)
            self.groups.append(n_groups[new])
            self._link(ids_a, ids_b, end_a, end_b, from_a[new], to_a[new])
            first_group = cut - n_groups + 1
            for w in new.tolist():
                a, b = ids_a[from_a[w]:to_a[w]].tolist(), ids_b[from_b[w]:to_b[w]].tolist()
                if n_groups[w] == 1:
                    self.texts.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
                    continue
                parts, i, j = [], 0, 0
                for g in range(first_group[w], cut[w] + 1):
                    k, m = int(last_a[g] + 1 - from_a[w]), int(last_b[g] + 1 - from_b[w])
                    parts.append(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}")
                    i, j = k, m
                self.texts.append(";".join(parts))
        return window, from_a

    def _link(self, ids_a, ids_b, end_a, end_b, from_a, to_a) -> None:
        """Pairs of tokens whose bytes overlap, of windows given by their A tokens."""
        token = spread(from_a, to_a - from_a)
        window = np.repeat(np.arange(len(from_a)), to_a - from_a)
        end = end_a[token]
        start = end - self.a.size[ids_a[token]]
        first = np.searchsorted(end_b, start, "right")
        last = np.searchsorted(end_b - self.b.size[ids_b], end, "left")
        keys = (np.repeat(ids_a[token], last - first) << 32 | ids_b[spread(first, last - first)]).astype(np.uint64)
        pair, new = self.pairs.of(keys)
        self.pair_keys.append(keys[new].astype(np.int64))
        self.links.append(pair, np.bincount(window, weights=last - first, minlength=len(from_a)).astype(np.int64))


class Block:
    """Pairs of ids that the documents of a block link, numbered, with the number of documents that do."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.place, self.docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.keys = _Growing()

    def refer(self, pair: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The block's numbers of the windows' pairs, one entry per document that links the pair."""
        if not len(pair):
            return pair
        if len(self.place) < len(keys):
            self.place = np.concatenate([self.place, np.full(len(keys) - len(self.place), -1)])
        new = np.unique(pair[self.place[pair] < 0])
        self.place[new] = self.keys.n + np.arange(len(new))
        self.keys.append(keys[new])
        out = self.place[pair]
        n = np.bincount(out, minlength=self.keys.n)
        n[:len(self.docs)] += self.docs
        self.docs = n
        return out


class Aligner:
    """Aligns batches of texts; documents of a slice at a time, a longer document piece by piece."""

    def __init__(self, path_a: str, path_b: str, keep: str):
        a, b = Vocabulary(path_a), Vocabulary(path_b)
        self.pieces, self.windows, self.keep = PiecePair(a, b), Windows(a, b), keep

    def aligned(self, raw: np.ndarray, offs: np.ndarray, block: Block) -> dict[str, np.ndarray | list]:
        """Columns of the documents of a slice."""
        n = len(offs) - 1
        sums = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
        digests = [hashlib.sha256() for _ in range(n)] if self.keep == "sha256" else None
        texts: list[list[str]] = [[] for _ in range(n)]
        bad = np.zeros(n, bool)
        doc_pair: list[np.ndarray] = []
        times: list[np.ndarray] = []
        for lo, hi in self._parts(raw, offs):
            inner = np.clip(offs, lo, hi) - lo
            part = raw[lo:hi]
            cuts = stable_spaces(part, inner)
            first = inner[:-1][np.diff(inner) > 0]
            start = np.sort(np.concatenate([cuts + 1, first]))  # the space before a piece is the tokens', not the key's
            if lo and hi - lo and lo not in offs:  # the part starts with the space of its first piece
                start[0] += 1
            at_start = np.zeros(len(part) + 1, bool)
            at_start[first] = True
            follows = np.append(start[1:], len(part))
            end = np.where(at_start[follows] | (follows == len(part)), follows, follows - 1)
            row = np.searchsorted(inner, np.minimum(start, len(part) - 1), "right") - 1
            piece = self.pieces.of(part, start, end)
            wrong = self.pieces.good.values[piece] == 0
            bad[row[wrong]] = True
            use = ~bad[row]
            if not use.any():
                continue
            piece, row = piece[use], row[use]
            ids_a, count_a = self.pieces.ids_a.fetch(piece)
            ids_b, count_b = self.pieces.ids_b.fetch(piece)
            window, at = self.windows.of(ids_a, ids_b)
            of = np.repeat(row, count_a)[at]  # each window's document
            sums["n_a"] += np.bincount(row, weights=count_a, minlength=n).astype(np.int64)
            sums["n_b"] += np.bincount(row, weights=count_b, minlength=n).astype(np.int64)
            sums["n_groups"] += np.bincount(of, weights=self.windows.groups.values[window], minlength=n).astype(np.int64)
            pair, links = self.windows.links.fetch(window)
            sums["n_links"] += np.bincount(of, weights=links, minlength=n).astype(np.int64)
            both, c = np.unique(np.repeat(of, links) * self.windows.pairs.n + pair, return_counts=True)
            doc_pair.append(np.stack([both // self.windows.pairs.n, both % self.windows.pairs.n]))
            times.append(c)
            text = self.windows.texts
            bounds = np.flatnonzero(np.diff(of, prepend=-1)).tolist() + [len(of)]
            words = window.tolist()
            for i, j in zip(bounds[:-1], bounds[1:]):
                d, said = int(of[i]), ";".join([text[w] for w in words[i:j]])
                if digests is None:
                    texts[d].append(said)
                else:
                    digests[d].update((";" if texts[d] else "").encode() + said.encode())
                    texts[d] = [""]
        doc, pair = np.concatenate(doc_pair, 1) if doc_pair else np.zeros((2, 0), np.int64)
        c = np.concatenate(times) if times else np.zeros(0, np.int64)
        if len(doc_pair) > 1:  # pairs of a document in several parts
            both, back = np.unique(doc * self.windows.pairs.n + pair, return_inverse=True)
            c = np.bincount(back, weights=c).astype(np.int64)
            doc, pair = both // self.windows.pairs.n, both % self.windows.pairs.n
        ok = ~bad[doc]
        doc, pair, c = doc[ok], pair[ok], c[ok]
        which = block.refer(pair, self.windows.pair_keys.values[:self.windows.pair_keys.n])
        offsets = np.searchsorted(doc, np.arange(n + 1)) * 4
        for column in sums.values():
            column[bad] = 0
        if digests is None:
            said = ["" if b else ";".join(t) for b, t in zip(bad.tolist(), texts)]
        else:
            said = [h.hexdigest() if t and not b else "" for b, t, h in zip(bad.tolist(), texts, digests)]
        block.bytes += len(raw)
        return {**sums, "groups": said, "which": _binary(which, offsets), "times": _binary(c, offsets)}

    @staticmethod
    def _parts(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int]]:
        """All of a slice; a single longer document in parts that start with a stable space."""
        if len(offs) > 2 or len(raw) <= SLICE:
            yield 0, len(raw)
            return
        places = stable_spaces(raw, offs)
        at = 0
        while at < len(raw):
            k = int(np.searchsorted(places, at + SLICE, "right")) - 1
            if k < 0 or places[k] <= at:
                k += 1
            to = int(places[k]) if k < len(places) else len(raw)
            to = len(raw) if len(raw) - at <= SLICE else to
            yield at, to
            at = to


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(values, "<i4")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def align(docs: DataFrame, path_a: str, path_b: str, carry: list[str], text: str = "text", keep: str = "groups") -> DataFrame:
    """Per document: ``carry`` columns, tokens ``n_a`` and ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, and
    ``groups`` as ``a1,a2|b1;a3|b2,b3``, or with ``keep="sha256"`` the digest of that text.

    A is a byte-level tokenizers file and encodes a space and the text; B is a sentencepiece file that puts a space before it.
    No special tokens: their strings inside texts are plain text. A null or empty text, and one whose tokens' bytes aren't a
    space and the text, has no tokens: zeros and an empty string. Repeated rows are documents of their own, in the counts too;
    an empty table gives an empty result; carried columns may have any name. A long document is worked on in parts; its task
    holds its different pairs and, with ``keep="groups"``, the text of its groups.
    """
    if keep not in ("groups", "sha256"):
        raise ValueError(keep)
    names = [f"__c{i}" for i in range(len(carry))]
    src = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = src.drop("__text").schema
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(name, "long")
    schema = schema.add("groups", "string").add("which", "binary").add("times", "binary")
    own = [f.name for f in schema]
    schema = schema.add("block", "long").add("kind", "integer").add("at", "long").add("pair", "long").add("docs", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = Aligner(path_a, path_b, keep)
        block = Block(TaskContext.get().partitionId() << 32)
        types: dict[str, pa.DataType] = {}

        def pairs(block: Block) -> Iterator[pa.RecordBatch]:
            for lo in range(0, block.keys.n, 1 << 16):
                n = min(1 << 16, block.keys.n - lo)
                filled = {"block": pa.array(np.full(n, block.number)), "kind": pa.array(np.zeros(n, np.int32)),
                          "at": pa.array(np.arange(lo, lo + n)), "pair": pa.array(block.keys.values[lo:lo + n]),
                          "docs": pa.array(block.docs[lo:lo + n])}
                yield pa.RecordBatch.from_arrays([filled[f.name] if f.name in filled else pa.nulls(n, types[f.name]) for f in schema],
                                                 names=[f.name for f in schema])

        for batch in batches:
            place = batch.schema.get_field_index("__text")
            raw, offs = br.text_bytes(batch.column(place))
            for lo, hi in br.slices(offs, SLICE):
                part = aligner.aligned(raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], block)
                n = hi - lo
                columns = [c.slice(lo, n) for i, c in enumerate(batch.columns) if i != place]
                columns += [part[c] if isinstance(part[c], pa.Array) else pa.array(part[c]) if c != "groups" else pa.array(part[c], pa.string())
                            for c in own[len(names):]]
                types = types or dict(zip(own, (c.type for c in columns)))
                columns += [pa.array(np.full(n, block.number)), pa.array(np.ones(n, np.int32)), pa.array(np.zeros(n, np.int64)),
                            pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])
                if block.bytes >= BLOCK or block.keys.n >= BLOCK_PAIRS:
                    yield from pairs(block)
                    block = Block(block.number + 1)
                    if aligner.windows.names.n > KNOWN:
                        aligner.windows.forget()
                if aligner.pieces.names.n > KNOWN:
                    aligner.pieces.forget()
        yield from pairs(block)

    table = materialise(src.mapInArrow(run, schema))
    asked = table.filter("kind = 0").select("block", "at", "pair", "docs")
    counts = (asked.groupBy("pair").agg(F.sum("docs").alias("count"))
              .withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))))
    answers = asked.join(counts, "pair").select("block", "at", "count", F.col("best").cast("long").alias("best"))
    told = table.filter("kind = 1").select(*own, "block")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[:len(own)]]
    stream = (told.select(*own, "block", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("best"))
              .unionByName(answers.select(*blank, "block", F.lit(0).alias("kind"), "at", "count", "best"))
              .repartition("block").sortWithinPartitions("block", "kind", "at"))
    out = src.drop("__text").schema
    for name in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"):
        out = out.add(name, "long")
    out = out.add("groups", "string")
    return stream.mapInArrow(_answered(len(own), [f.name for f in out]), out).select(
        *[F.col(n).alias(c) for c, n in zip(carry, names)], *[f.name for f in out.fields[len(names):]])


def _answered(n_own: int, names: list[str]):
    """Documents' sums over their links, from a stream of blocks: first the answers to a block's pairs, then its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, heard = None, []
        figures = np.zeros((2, 0), np.int64)
        for batch in batches:
            column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            block, kind = column["block"].to_numpy(), column["kind"].to_numpy()
            told = np.stack([column["count"].to_numpy(), column["best"].to_numpy()])
            bounds = np.flatnonzero((np.diff(block, prepend=block[0] - 1) != 0) | (np.diff(kind, prepend=0) != 0))
            for lo, hi in zip(bounds.tolist(), [*bounds[1:].tolist(), len(block)]):
                if block[lo] != here:
                    here, heard, figures = block[lo], [], np.zeros((2, 0), np.int64)
                if kind[lo] == 0:
                    heard.append(told[:, lo:hi])
                    continue
                if heard:
                    figures, heard = np.concatenate([figures, *heard], 1), []
                raw, offs = br.text_bytes(column["which"].slice(lo, hi - lo))
                which, times = raw.view("<i4"), br.text_bytes(column["times"].slice(lo, hi - lo))[0].view("<i4")
                offs = offs // 4
                sums = []
                for values in (figures[1], figures[0]):
                    total = np.concatenate([[0], np.cumsum(values[which] * times)])
                    sums.append(pa.array(total[offs[1:]] - total[offs[:-1]]))
                own = [batch.column(i).slice(lo, hi - lo) for i in range(n_own - 2)]
                yield pa.RecordBatch.from_arrays([*own[:-1], *sums, own[-1]], names=names)

    return run
