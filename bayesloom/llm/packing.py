"""Packing into token sequences by order-preserving dynamic programming.

The documents of a partition, in their order, are one stream of token ids. Sequences are windows of that stream, cut at
document ends, behind sentences, and, where a sentence is longer than ``gap`` tokens, inside it. The cuts minimise padding plus the
penalties of cuts inside documents plus a small charge per sequence. With f(j) the least cost up to cut j at place P(j),
the padded windows behind j cost ``f(i) + P(i) + size - P(j)``, so the best i is the head of a monotone queue over the last
``size`` tokens; windows of a power of two, which need no padding, are looked up by their start.

The stream isn't held: as soon as the best paths to all cuts that a later window can start at have met, everything up to
their meeting point is final and goes out. The result is the optimum of the whole partition all the same.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayesloom.llm import bytesrows as br

#: tokens of a sequence, and the costs in tokens of padding: a cut behind a sentence, one inside a sentence, a sequence
SIZE = 2048
SENTENCE_CUT, INNER_CUT, PER_SEQUENCE = 16, 128, 8
#: tokens after which a sentence may be cut inside
GAP = 512
#: bytes of text worked on at a time, and pieces whose ids a worker remembers
SLICE = 2 << 20
KNOWN = 1 << 21
#: sequence ids of a partition start at its number times this
PER_PARTITION = 1 << 40

_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[list(b"\"')]}*_")] = True


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True


def word_pieces(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of white-space words, cut once more before a punctuation mark behind an ASCII letter."""
    start, end, row = br.word_spans(raw, offs)
    if not len(start):
        return start, end, row
    begins = np.zeros(len(raw) + 1, bool)
    begins[1:-1] = _MARK[raw[1:]] & _LETTER[raw[:-1]]
    begins[start] = True
    first = np.flatnonzero(begins)
    first = first[first < len(raw)]
    new = np.zeros(len(raw), bool)
    new[start] = True
    word = np.cumsum(new[first]) - 1
    stop = end[word]
    same = word[1:] == word[:-1]
    stop[:-1][same] = first[1:][same]
    return first, stop, row[word]


def plain_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each piece has only ASCII and Latin-1 letters."""
    good = _LETTER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]  # not the signs for times and divided by
    good[lead] = good[lead + 1] = True
    bad = np.concatenate([[0], np.cumsum(~good)])
    return bad[end] == bad[start]


class WordIds:
    """Token ids of pieces of text (``word_pieces``); each different piece is encoded once.

    Needs a tokenizer for which a text's ids are its pieces' ids one after another: its normalizer works on characters, and its
    pre-tokenizer drops white space and tells letters and punctuation apart. A probe in ``__init__`` refuses others.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.forget()
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        self.ends = None  # of each id, whether it ends a word
        if suffix:
            self.ends = np.zeros(self.model.get_vocab_size(), bool)
            self.ends[[i for t, i in self.model.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        probe = "One's  two,\tthree!\n\n«Vier» 5.6 été <|x|>…\r\nＦull σς ﬁ ok. Éa÷b a×b, x.y?!"
        raw = np.frombuffer(probe.encode(), np.uint8)
        start, end, _ = word_pieces(raw, np.array([0, len(raw)]))
        if self.of(raw, start, end)[0].tolist() != self._ids([probe])[0]:
            raise ValueError(f"{path}: ids of a text are not those of its pieces")

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and each one's number. Words of letters are encoded many to a text and told
        apart by the ids that end a word."""
        data = raw.tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())]
        plain = plain_words(raw, start, end) if self.ends is not None else np.zeros(len(start), bool)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n = int(plain.sum())
        joined = self._ids([" ".join(texts[i] for i in order[lo:min(lo + 256, n)]) for lo in range(0, n, 256)])
        flat = np.fromiter((i for x in joined for i in x), np.uint32)
        stops = np.flatnonzero(self.ends[flat]) if n else np.zeros(0, np.int64)
        if len(stops) != n:
            raise ValueError("a word of letters has no single end")
        rest = self._ids([texts[i] for i in order[n:]])
        count = np.concatenate([np.diff(stops, prepend=-1), [len(x) for x in rest]]).astype(np.int64)
        flat = np.concatenate([flat, np.fromiter((i for x in rest for i in x), np.uint32)])
        back = np.argsort(order)
        at = (np.cumsum(count) - count)[back]
        count = count[back]
        return flat[np.arange(len(flat)) + np.repeat(at - (np.cumsum(count) - count), count)], count

    def of(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and each piece's number of ids."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        code, key = pd.factorize(br.RollingHash(raw).of(start, end))
        order = np.argsort(key)
        key = key[order]
        code = np.argsort(order)[code]
        if len(self.keys) + len(key) > KNOWN:
            self.forget()
        place = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == key[inside]
        new = np.flatnonzero(~known)
        if len(new):
            first = np.empty(len(key), np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            flat, count = self._encode(raw, start[first[new]], end[first[new]])
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used:self.used + len(flat)] = flat
            at = self.used + np.cumsum(count) - count
            self.used += len(flat)
            self.keys = np.insert(self.keys, place[new], key[new])
            self.at = np.insert(self.at, place[new], at)
            self.count = np.insert(self.count, place[new], count)
            place = np.searchsorted(self.keys, key)
        word = place[code]
        count = self.count[word]
        shift = self.at[word] - (np.cumsum(count) - count)
        return self.flat[np.arange(int(count.sum())) + np.repeat(shift, count)], count


def sentence_ends(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each piece ends a sentence: white space behind a stop, perhaps with a closing sign after it, or a line end."""
    last = raw[end - 1]
    before = raw[np.maximum(end - 2, start)]
    follows = np.append(raw, np.uint8(0x20))[end]
    wide = (end - start >= 3) & (before >= 0x80) & (last >= 0x80)
    if wide.any():  # the full-width stops
        third = raw[np.maximum(end - 3, start)].astype(np.int64) << 16 | before.astype(np.int64) << 8 | last
        wide &= np.isin(third, [0xE38082, 0xEFBC81, 0xEFBC9F])
    return (_STOP[last] | (_CLOSE[last] & _STOP[before]) | wide) & br.IS_SPACE[follows] | (follows == 0x0A)


def filled(places: np.ndarray, penalty: np.ndarray, gap: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut places (ascending, the first is the start) with more of them where two are over ``gap`` apart."""
    far = np.flatnonzero(np.diff(places) > gap)
    if not len(far):
        return places, penalty
    more = [np.arange(places[i] + gap, places[i + 1], gap) for i in far]
    where = np.repeat(far + 1, [len(m) for m in more])
    return np.insert(places, where, np.concatenate(more)), np.insert(penalty, where, inner)


def best_cuts(places: np.ndarray, penalty: np.ndarray, size: int, per_sequence: int) -> list[int]:
    """For each cut place, the place that the best window ending there starts at (their indices; the first has none)."""
    n = len(places)
    starts, ends = [], []
    power = 1
    while power <= size:
        at = np.searchsorted(places, places - power)
        hit = np.flatnonzero(places[at] == places - power)
        starts.append(at[hit])
        ends.append(hit)
        power *= 2
    ends_, starts_ = np.concatenate(ends), np.concatenate(starts)
    order = np.lexsort((starts_, ends_))
    bound = np.searchsorted(ends_[order], np.arange(n + 1)).tolist()
    starts_ = starts_[order].tolist()
    place, pen = places.tolist(), penalty.tolist()
    cost, back = [0] * n, [0] * n
    queue, rank, head = [0], [place[0]], 0  # cuts by rising cost + place, the cheapest first
    for j in range(1, n):
        here = place[j]
        low = here - size
        while place[queue[head]] < low:
            head += 1
        i, best = queue[head], rank[head] - low
        for k in starts_[bound[j]:bound[j + 1]]:  # longest window first
            if cost[k] < best or cost[k] == best and k < i:
                i, best = k, cost[k]
        best += per_sequence + pen[j]
        cost[j], back[j] = best, i
        best += here
        while len(queue) > head and rank[-1] > best:
            queue.pop()
            rank.pop()
        queue.append(j)
        rank.append(best)
        if head > 4096:
            del queue[:head], rank[:head]
            head = 0
    return back


def meeting_point(places: np.ndarray, back: list[int], size: int) -> int:
    """The last cut that the best paths to all cuts within ``size`` of the end go through."""
    live = [-i for i in range(int(np.searchsorted(places, places[-1] - size + 1)), len(places))]
    heapq.heapify(live)
    while len(live) > 1:
        top = heapq.heappop(live)
        while live and live[0] == top:
            heapq.heappop(live)
        if not live:
            return -top
        heapq.heappush(live, -back[-top])
    return -live[0]


class Stream:
    """The tokens and cut places of a partition that aren't packed yet; places count from the last final cut."""

    def __init__(self, words: WordIds, end_id: int, size: int, costs: tuple[int, int, int], gap: int, partition: int):
        self.words, self.end_id, self.size, self.gap = words, end_id, size, gap
        self.sentence, self.inner, self.per_sequence = costs
        self.ids = np.zeros(0, np.uint32)
        self.places, self.penalty = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.docs = np.zeros(0, np.int64)  # where documents start (at or before 0: one that an earlier window began)
        self.tokens = np.zeros(0, np.int64)
        self.carry: pa.Table | None = None
        self.sequence = partition * PER_PARTITION
        self.tried = 0

    def add(self, raw: np.ndarray, offs: np.ndarray, carry: pa.Table) -> None:
        """Documents behind the stream."""
        ids, places, penalty, docs, tokens = [self.ids], [self.places], [self.penalty], [], []
        at, parts = len(self.ids), _ranges(raw, offs)
        doc, begun = 0, at
        for lo, hi, first, ends in parts:  # rows first .. first + len(ends) - 1 of these bytes, and whether each ends in them
            inner = np.clip(offs[first:first + len(ends) + 1], lo, hi) - lo
            start, end, row = word_pieces(raw[lo:hi], inner)
            flat, count = self.words.of(raw[lo:hi], start, end)
            behind = np.cumsum(count)
            per_row = np.bincount(row, weights=count, minlength=len(ends)).astype(np.int64)
            finished = np.concatenate([[0], np.cumsum(ends)])  # end ids before each row
            cut = sentence_ends(raw[lo:hi], start, end)
            final = np.ones(len(row), bool)
            final[:-1] = row[1:] != row[:-1]
            cut &= ~(final & ends[row])  # the document's end is the better place
            row_end = np.cumsum(per_row)
            flat = np.insert(flat, row_end[ends], np.uint32(self.end_id))
            doc_ends = at + row_end[ends] + finished[1:][ends]
            here = np.concatenate([doc_ends, at + behind[cut] + finished[row[cut]]])
            cost = np.concatenate([np.zeros(len(doc_ends), np.int64), np.full(int(cut.sum()), self.sentence)])
            order = np.argsort(here, kind="stable")
            ids.append(flat)
            places.append(here[order])
            penalty.append(cost[order])
            starts = np.concatenate([[begun], doc_ends])
            docs.append(starts[:-1])
            tokens.append(np.diff(starts))
            begun = int(starts[-1])
            at += len(flat)
        self.ids = np.concatenate(ids)
        places, penalty = np.concatenate(places), np.concatenate(penalty)
        keep = np.ones(len(places), bool)
        keep[1:] = places[1:] > places[:-1]  # words without ids
        self.places, self.penalty = filled(places[keep], penalty[keep], self.gap, self.inner)
        self.docs, self.tokens = np.concatenate([self.docs, *docs]), np.concatenate([self.tokens, *tokens])
        self.carry = carry if self.carry is None else pa.concat_tables([self.carry, carry])

    def pack(self, last: bool) -> pa.Table | None:
        """Pieces of the sequences that nothing behind the stream can change any more; all of them at its ``last`` call."""
        if len(self.places) < 2 or not last and len(self.ids) < 2 * self.tried:
            return None
        back = best_cuts(self.places, self.penalty, self.size, self.per_sequence)
        node = len(back) - 1 if last else meeting_point(self.places, back, self.size)
        cuts = [node]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts = self.places[cuts[::-1]]
        self.tried = len(self.ids) - int(cuts[-1])  # paths that stay apart are tried again at twice the length
        if len(cuts) == 1:
            return None
        out = self._pieces(cuts)
        self._forget(int(cuts[-1]), node)
        return out

    def _pieces(self, cuts: np.ndarray) -> pa.Table:
        end = int(cuts[-1])
        inside = self.docs[(self.docs > 0) & (self.docs < end)]
        start = np.union1d(cuts[:-1], inside)
        stop = np.append(start[1:], end)
        doc = np.searchsorted(self.docs, start, "right") - 1
        window = np.searchsorted(cuts, start, "right") - 1
        data = np.ascontiguousarray(self.ids[:end], "<u4")
        ids = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((np.append(start, end) * 4).astype(np.int32)), pa.py_buffer(data)])
        out = self.carry.take(pa.array(doc))
        for name, column in (("start", start - self.docs[doc]), ("length", stop - start), ("doc_tokens", self.tokens[doc]),
                             ("sequence_id", self.sequence + window), ("offset", start - cuts[window])):
            out = out.append_column(f"__{name}", pa.array(column, pa.int64()))
        self.sequence += len(cuts) - 1
        return out.append_column("__ids", ids)

    def _forget(self, end: int, node: int) -> None:
        self.ids = self.ids[end:].copy()
        self.places, self.penalty = self.places[node:] - end, self.penalty[node:].copy()
        self.penalty[0] = 0
        open_ = int(np.searchsorted(self.docs, end, "right")) - 1  # it may have begun before the cut
        if open_ >= 0 and self.docs[open_] + self.tokens[open_] <= end:
            open_ += 1
        open_ = max(open_, 0)
        self.docs, self.tokens = self.docs[open_:] - end, self.tokens[open_:].copy()
        self.carry = self.carry.slice(open_)


def _ranges(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(from, to, first row, whether each row ends) of about SLICE bytes; a longer document is cut at white space."""
    for lo, hi in br.slices(offs, SLICE):
        if hi - lo > 1 or offs[hi] - offs[lo] <= SLICE:
            yield int(offs[lo]), int(offs[hi]), lo, np.ones(hi - lo, bool)
            continue
        at, end = int(offs[lo]), int(offs[hi])
        while at < end:
            to = min(end, at + SLICE)
            if to < end:
                back = np.flatnonzero(br.IS_SPACE[raw[at:to]])  # behind a white-space sign, which the word before it sees
                if len(back):
                    to = at + int(back[-1]) + 1
                else:
                    ahead = np.flatnonzero(br.IS_SPACE[raw[to:end]])
                    to = to + int(ahead[0]) + 1 if len(ahead) else end
            yield at, to, lo, np.array([to == end])
            at = to


def pack(docs: DataFrame, tokenizer: str, carry: list[str], text: str = "text", size: int = SIZE, end_id: int = 1,
         order: list[str] | None = None, sentence_cut: int = SENTENCE_CUT, inner_cut: int = INNER_CUT,
         per_sequence: int = PER_SEQUENCE, gap: int = GAP) -> DataFrame:
    """One row per piece of a document: ``carry`` columns, ``start`` (the document's ids before it), ``length``,
    ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence and ``ids`` (unsigned 32-bit, little-endian).

    A document is its text's ids, without added special tokens, and ``end_id``; a null text is empty, so its one id is the
    end. Every id is in exactly one piece; pieces of a sequence are in the order of the table, offsets from 0 without a gap.
    Sequences have ``size`` ids at most; shorter ones are padded unless their length is a power of two.

    The table's partitions are packed each for itself, in the order of their rows, without a shuffle: only a partition's last
    sequences know no followers. ``order`` names columns to sort by first; rows equal in them are dealt by a hash of the row,
    copies by chance of place. Without it the rows' order in a partition has to be the same in each run (files, written tables):
    sequence ids are numbers within a partition. A task holds a slice of text, the ids of a document, and the stream since the best
    paths last met. An empty table gives an empty result, repeated rows are documents of their own; carried columns
    may have any name.
    """
    names = [f"__c{i}" for i in range(len(carry))]
    src = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)], F.col(f"`{text}`").cast("string").alias("__text"),
                      *[F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(order or [])])
    if order:
        by = [F.col(f"__o{i}") for i in range(len(order))] + [F.xxhash64("__text")]
        src = src.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*by, "__tie").sortWithinPartitions(*by, "__tie")
        src = src.select(*names, "__text")
    schema = src.drop("__text").schema
    for name in ("start", "length", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(f"__{name}", "long")
    schema = schema.add("__ids", "binary")
    costs = (sentence_cut, inner_cut, per_sequence)
    if not 0 < gap <= size:
        raise ValueError("gap has to be from 1 to size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        stream = Stream(WordIds(tokenizer), end_id, size, costs, gap, TaskContext.get().partitionId())

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            pieces = stream.pack(last)
            if pieces is not None:
                yield from pieces.combine_chunks().to_batches(max_chunksize=2_000)

        for batch in batches:
            at = batch.schema.get_field_index("__text")
            raw, offs = br.text_bytes(batch.column(at))
            kept = pa.Table.from_batches([batch]).drop_columns(["__text"])
            for lo, hi in br.slices(offs, SLICE):
                stream.add(raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], kept.slice(lo, hi - lo))
                yield from out(False)
        yield from out(True)

    return src.mapInArrow(run, schema).select(
        *[F.col(n).alias(c) for c, n in zip(carry, names)],
        *[F.col(f"__{n}").alias(n) for n in ("start", "length", "doc_tokens", "sequence_id", "offset", "ids")])
