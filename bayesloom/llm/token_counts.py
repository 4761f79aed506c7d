"""Token counts by overlap resynchronisation.

A text longer than ``chunk`` characters is encoded in chunks that overlap, with offsets. Two
neighbouring encodings are spliced at a common boundary: a place inside the overlap where both
start a token, and which is proven stable because the library's pre-tokenizer always splits there,
whatever stands on either side. For the byte-level and white-space families that is a blank or line
end after a character that is not white space (no added token holds such a place); texts of other
tokenizers are encoded whole. Without such
a place the overlap is widened until there is one or the chunk reaches the end of the text, so the
counts are the library's own for the whole text. Only one chunk's encoding is held at a time.

Shorter texts are cut at all of their stable places; the pieces, mostly words, recur, so each different piece of a call is
encoded once and the pieces' counts add up to the text's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayesloom.llm import bytesrows as br

#: characters of a chunk (a text of more bytes is a long one), and of the first overlap tried
CHUNK = 1 << 14
OVERLAP = 256
#: bytes of text whose pieces are told apart at a time
CALL = 4 << 20
#: pieces whose counts a worker remembers
KNOWN = 1 << 19

_PLAIN = np.zeros(256, bool)  # bytes that end no white-space character: visible ASCII
_PLAIN[0x21:0x7F] = True
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True


def piece_starts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where texts and their pieces start: a blank or line end behind visible ASCII or a Latin-1 letter (lead byte C3)."""
    cut = np.zeros(len(raw), bool)
    cut[1:] = _BREAK[raw[1:]] & _PLAIN[raw[:-1]]
    cut[2:] |= _BREAK[raw[2:]] & (raw[:-2] == 0xC3) & (raw[1:-1] >= 0x80)
    first = offs[:-1]
    cut[first[first < len(raw)]] = True
    return np.flatnonzero(cut)


class Counter:
    """Counts of one tokenizer; ``path`` ends with .json (tokenizers) or .model (sentencepiece)."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.chunk, self.overlap = chunk, max(1, min(overlap, chunk // 2))
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if path.endswith(".model"):
            import sentencepiece

            # one sentence is one unit to this library, and its pieces may cross white space: whole texts only
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.splits, self.encode = False, None
            self.batch = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            kind = type(model.pre_tokenizer).__name__
            added = model.get_added_tokens_decoder().values()
            plain = not any(t.lstrip or t.rstrip or any(c.isspace() for c in t.content) for t in added)
            self.splits = kind in ("ByteLevel", "WhitespaceSplit") and model.normalizer is None and plain
            self.encode = lambda text: model.encode(text, add_special_tokens=False)
            self.batch = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text (null: none)."""
        raw, offs = br.text_bytes(texts)
        size = np.diff(offs)
        if not self.splits:
            return np.array(self.batch([x or "" for x in texts.to_pylist()]), np.int64) if len(size) else np.zeros(0, np.int64)
        n = np.zeros(len(size), np.int64)
        long = size > self.chunk
        for i in np.flatnonzero(long):
            n[i] = self.count_long(texts[i].as_py())
        short = texts.filter(pa.array(~long)) if long.any() else texts
        at = np.flatnonzero(~long)
        raw, offs = br.text_bytes(short)
        for lo, hi in br.slices(offs, CALL):
            part = offs[lo:hi + 1]
            n[at[lo:hi]] = self._count_pieces(raw[part[0]:part[-1]], part - part[0])
        return n

    def _count_pieces(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        start = piece_starts(raw, offs)
        if not len(start):
            return np.zeros(len(offs) - 1, np.int64)
        end = np.append(start[1:], len(raw))
        row = np.searchsorted(offs, start, "right") - 1
        rolling = br.RollingHash(raw)
        key, first, back = np.unique(rolling.of(start, end), return_index=True, return_inverse=True)
        counts = np.zeros(len(key), np.int64)
        place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        known = self.keys[place] == key if len(self.keys) else np.zeros(len(key), bool)
        counts[known] = self.counts[place[known]]
        new = np.flatnonzero(~known)
        data = raw.tobytes()
        counts[new] = self.batch([data[start[f]:end[f]].decode() for f in first[new]])
        if len(self.keys) + len(new) > KNOWN:
            self.keys, self.counts = key[:KNOWN], counts[:KNOWN]
        elif len(new):
            order = np.argsort(np.concatenate([self.keys, key[new]]))
            self.keys = np.concatenate([self.keys, key[new]])[order]
            self.counts = np.concatenate([self.counts, counts[new]])[order]
        return np.bincount(row, weights=counts[back], minlength=len(offs) - 1).astype(np.int64)

    def count_long(self, text: str) -> int:
        total, start = 0, 0
        skip = 0  # tokens of this chunk before its splice with the last one
        end = min(len(text), self.chunk)
        here = self._starts(text, start, end)
        while end < len(text):
            overlap = self.overlap
            while True:
                following = max(start + 1, end - overlap)
                stop = min(len(text), following + self.chunk)
                after = self._starts(text, following, stop)
                cut = self._splice(text, here, after, following, end)
                if cut is not None:
                    break
                if following == start + 1 or stop == len(text):  # as wide as it can get: one longer chunk instead
                    stop = min(len(text), end + self.chunk)
                    following, after, cut = start, self._starts(text, start, stop), None
                    break
                overlap *= 2
            if cut is None:
                here, end = after, stop
                continue
            total += int(np.searchsorted(here, cut)) - skip
            skip = int(np.searchsorted(after, cut))
            here, start, end = after, following, stop
        return total + len(here) - skip

    def _starts(self, text: str, lo: int, hi: int) -> np.ndarray:
        """Where each token of text[lo:hi] starts in the text."""
        return np.array([a for a, _ in self.encode(text[lo:hi]).offsets], np.int64) + lo

    def _splice(self, text: str, left: np.ndarray, right: np.ndarray, lo: int, hi: int) -> int | None:
        """The last stable place in (lo, hi) where both encodings start a token."""
        both = np.intersect1d(left[left > lo], right[(right > lo) & (right < hi)])
        for place in both[::-1]:
            if text[place] in " \n" and not text[place - 1].isspace():
                return int(place)
        return None


def token_counts(docs: DataFrame, tokenizer: str, carry: list[str], text: str = "text", limit: int = 1024,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``carry`` columns, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every whole text (null: empty).

    ``tokenizer`` is the path of a .json or .model file that every worker can read. No special tokens are
    added; their strings inside a text are handled as the library does by default. An empty table gives an
    empty result, repeated rows each a row.
    """
    src = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = src.drop("__text").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(tokenizer, chunk, overlap)
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            texts = batch.column(at)
            _, offs = br.text_bytes(texts)
            n = counter.count(texts)
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], names=[f.name for f in schema])

    return src.mapInArrow(run, schema)
