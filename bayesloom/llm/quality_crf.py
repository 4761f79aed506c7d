"""Quality rules by line labelling: a linear-chain conditional random field marks lines as content or boilerplate.

A document is the sequence of its lines that hold a word. The field has two states, weights for
features of a line and for the step from one line's state to the next one's; Viterbi decoding gives
the states, and the words in content lines as a share of all words decide whether a document stays.

Lines have no labels of their own, so the field learns from labelled documents: a line of a good
document is content unless it repeats an earlier line or holds licence terms, a line of a bad document
is boilerplate. It is fitted by maximum likelihood (forward-backward, Adam with a small L2 penalty) on
at most ``SAMPLE`` labelled documents with ``SAMPLE_LINES`` lines together, chosen by the hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayesloom.llm import bytesrows as br
from bayesloom.llm.shared import materialise, one_text_per_id, release

#: most labelled documents that the field is fitted on
SAMPLE = 2000
SAMPLE_LINES = 400_000
#: words in content lines a document must have, of all its words
CONTENT_SHARE = 0.5

# fixed values: terms of licence and site furniture lines
FURNITURE = ("license", "licensed", "licence", "copyright", "reserved", "warranty", "cookies", "cookie", "subscribe",
             "newsletter", "login", "javascript", "sitemap", "advertisement")

FEATURES = ("bias", "symbol_share", "many_symbols", "shouting", "digit_share", "table", "few_words", "many_words",
            "repeats_line", "repeated_words", "exclamations", "word_length", "sentence_end", "furniture", "first", "last")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL = _class("#*$%&|<>")
_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _class("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _class("0123456789")
_PIPE = _class("|")
_BANG = _class("!")
_END = _class(".?!:")
_FURNITURE = np.sort(np.array([br.hash_word(w, br.LOWER, br.ALNUM) for w in FURNITURE], np.uint64))


@dataclass
class Lines:
    """What a slice of documents holds: figures per document, and per line with a word."""

    words: np.ndarray
    word_chars: np.ndarray
    symbols: np.ndarray
    repeated_lines: np.ndarray
    repeated_words: np.ndarray
    row: np.ndarray
    line_words: np.ndarray
    x: np.ndarray


def _sums(mark: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mark) + 1, np.int64)
    np.cumsum(mark, out=out[1:])
    return out


def _seen(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: an equal one stands before it; an equal one stands anywhere else."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    before, other = np.zeros(len(key), bool), np.zeros(len(key), bool)
    before[order[1:]] = same
    other[order[1:]] |= same
    other[order[:-1]] |= same
    return before, other


def analyse(raw: np.ndarray, offs: np.ndarray) -> Lines:
    n = len(offs) - 1
    start, end, row = br.word_spans(raw, offs)
    lead = (raw & 0xC0) != 0x80
    marks = {name: _sums(table[raw]) for name, table in
             (("symbol", _SYMBOL), ("upper", _UPPER), ("letter", _LETTER), ("digit", _DIGIT), ("pipe", _PIPE), ("bang", _BANG))}
    chars = _sums(lead & ~br.IS_SPACE[raw])
    words = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)

    rolling = br.RollingHash(raw)
    h = rolling.of(start, end)
    windows = br.sequence_hash(h, 3)
    m = len(windows)
    inside = np.flatnonzero(row[:m] == row[2:2 + m]) if m else np.zeros(0, np.int64)
    _, twice = _seen(br.mix(windows[inside] + br.mix(row[inside].astype(np.uint64))))
    change = np.zeros(len(start) + 1, np.int64)
    np.add.at(change, inside[twice], 1)
    np.add.at(change, inside[twice] + 3, -1)
    covered = np.cumsum(change[:-1]) > 0
    repeated_words = np.bincount(row[covered], minlength=n) if len(row) else words

    # lines: from a document's start or behind a line end, up to the next
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[offs[:-1]] = True
    fresh[1:][raw == 10] = True
    line_start = np.flatnonzero(fresh[:-1])
    line_end = np.append(line_start[1:], len(raw))
    if len(line_start):
        line_end = line_end - (raw[line_end - 1] == 10)
        of_word = np.searchsorted(line_start, start, "right") - 1
        n_words = np.bincount(of_word, minlength=len(line_start))
        has = np.flatnonzero(n_words)
        covered_in = np.bincount(of_word, weights=covered, minlength=len(line_start))[has]
        terms = np.isin(br.RollingHash(raw, br.LOWER, br.ALNUM).of(start, end), _FURNITURE)
        furniture = np.bincount(of_word, weights=terms, minlength=len(line_start))[has] > 0
        a, b, n_words = line_start[has], line_end[has], n_words[has]
    else:
        a = b = n_words = covered_in = furniture = np.zeros(0, np.int64)
    line_row = np.searchsorted(offs, a, "right") - 1
    again, _ = _seen(br.mix(rolling.of(a, b) + br.mix(line_row.astype(np.uint64))))
    first, last = np.ones(len(a), bool), np.ones(len(a), bool)
    first[1:] = last[:-1] = line_row[1:] != line_row[:-1]
    size = np.maximum(chars[b] - chars[a], 1)
    share = {k: (s[b] - s[a]) / size for k, s in marks.items()}
    letters = np.maximum(marks["letter"][b] - marks["letter"][a], 1)
    final = end[np.searchsorted(start, b) - 1] - 1 if len(a) else a
    x = np.stack([
        np.ones(len(a)), np.minimum(share["symbol"] * 4, 1), share["symbol"] > 0.05,
        (marks["upper"][b] - marks["upper"][a]) / letters > 0.6, share["digit"], share["pipe"] > 0.02, n_words <= 3, n_words >= 8,
        again, covered_in / np.maximum(n_words, 1), np.minimum(share["bang"] * 10, 1), np.minimum(size / np.maximum(n_words, 1) / 10, 2),
        _END[raw[final]] if len(a) else a, furniture, first, last], axis=1).astype(float) if len(a) else np.zeros((0, len(FEATURES)))
    per_row = lambda s: s[offs[1:]] - s[offs[:-1]]
    return Lines(words, per_row(chars), per_row(marks["symbol"]), np.bincount(line_row[again], minlength=n) if len(a) else np.zeros(n, np.int64),
                 repeated_words, line_row, n_words, x)


class Chain:
    """A two-state linear-chain field: ``w`` scores content against boilerplate, ``step[i, j]`` the step from state i to j."""

    def __init__(self, w: np.ndarray, step: np.ndarray):
        self.w, self.step = w, step

    @staticmethod
    def _order(row: np.ndarray):
        """First line and length of each sequence, longest first."""
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        length = np.diff(np.append(first, len(row)))
        order = np.argsort(-length, kind="stable")
        return first[order], length[order]

    def viterbi(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        """State (1: content) of each line; a tie is content."""
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ self.w
        first, length = self._order(row)
        best, back = emit.copy(), np.zeros((len(x), 2), np.int8)
        state = np.zeros(len(x), np.int64)
        top = int(length[0]) if len(length) else 0
        live = [int(np.searchsorted(-length, -t)) for t in range(top)]  # sequences of more than t lines
        for t in range(1, top):
            at = first[:live[t]] + t
            score = best[at - 1][:, :, None] + self.step[None]
            back[at] = score[:, 1] >= score[:, 0]
            best[at] += score.max(axis=1)
        tail = first + length - 1
        state[tail] = best[tail, 1] >= best[tail, 0]
        for t in range(top - 1, 0, -1):
            at = first[:live[t]] + t
            state[at - 1] = back[at, state[at]]
        return state

    def gradient(self, x: np.ndarray, row: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean log-likelihood of a line, by forward-backward."""
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ self.w
        first, length = self._order(row)
        ahead, behind = emit.copy(), np.zeros((len(x), 2))
        top = int(length[0])
        live = [int(np.searchsorted(-length, -t)) for t in range(top)]
        for t in range(1, top):
            at = first[:live[t]] + t
            ahead[at] += np.logaddexp(ahead[at - 1, :1] + self.step[0], ahead[at - 1, 1:] + self.step[1])
        for t in range(top - 1, 0, -1):
            at = first[:live[t]] + t
            nxt = emit[at] + behind[at]
            behind[at - 1] = np.logaddexp(self.step[:, 0] + nxt[:, :1], self.step[:, 1] + nxt[:, 1:])
        total = ahead + behind
        norm = np.logaddexp(total[:, 0], total[:, 1])
        dw = x.T @ (y - np.exp(total[:, 1] - norm)) / len(x)
        later = np.flatnonzero(row[1:] == row[:-1]) + 1
        joint = np.exp(ahead[later - 1][:, :, None] + self.step[None] + (emit + behind)[later][:, None, :] - norm[later][:, None, None])
        dstep = -joint.sum(axis=0)
        np.add.at(dstep, (y[later - 1], y[later]), 1)
        return dw, dstep / len(x)

    @classmethod
    def fit(cls, x: np.ndarray, row: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, penalty: float = 1e-3) -> Chain:
        """Without a line: the field that calls every line content."""
        n = x.shape[1]
        theta = np.zeros(n + 4)
        if len(x):
            m, v = np.zeros_like(theta), np.zeros_like(theta)
            for i in range(1, rounds + 1):
                dw, dstep = cls(theta[:n], theta[n:].reshape(2, 2)).gradient(x, row, y)
                g = np.concatenate([dw, dstep.ravel()]) - penalty * theta
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        return cls(theta[:n], theta[n:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
        sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Chain:
    """The field of ``docs`` with ``labels`` (id, 1 good or 0 bad).

    Null ids and labels are left out; of labels of one id the lowest counts, of its rows the one whose text has the lowest hash. Documents whose
    lines would take the sample over ``sample_lines`` are left out of it, in the order of their ids' hash.
    """
    chosen = (labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("y")).dropna()
              .groupBy("__id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("__id"), "__id").limit(sample))
    src = one_text_per_id(docs, chosen, id_col, text).select("__id", "y", "text", F.xxhash64("__id").alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, _, raw, offs in br.text_slices(batch.column(2)):
                found = analyse(raw, offs)
                for r in np.unique(found.row):
                    mine = found.row == r
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([str(batch.column(0)[lo + r])]), pa.array([int(good[lo + r])], pa.int32()), batch.column(3).slice(lo + r, 1),
                         pa.array([int(mine.sum())], pa.int32()), pa.array([found.x[mine].astype(np.float32).tobytes()], pa.binary())],
                        names=["id", "y", "place", "lines", "x"])

    n = len(FEATURES)
    found = materialise(src.mapInArrow(run, "id string, y int, place long, lines int, x binary"))
    left, taken = sample_lines, []
    for r in sorted(found.select("id", "place", "lines").collect(), key=lambda r: (r["place"], r["id"])):  # a row per document of the sample
        if r["lines"] <= left:
            left -= r["lines"]
            taken.append(r["id"])
    rows = sorted(found.filter(F.col("id").isin(taken)).select("id", "y", "x").collect(), key=lambda r: r["id"])
    release(found)
    x = [np.frombuffer(r["x"], np.float32).astype(np.float64).reshape(-1, n) for r in rows]
    if not x:
        return Chain.fit(np.zeros((0, n)), np.zeros(0, np.int64), np.zeros(0, np.int64))
    row = np.repeat(np.arange(len(x)), [len(p) for p in x])
    x = np.concatenate(x)
    good = np.array([r["y"] for r in rows])[row]
    plain = (x[:, FEATURES.index("repeats_line")] == 0) & (x[:, FEATURES.index("furniture")] == 0)
    return Chain.fit(x, row, (good * plain).astype(np.int64))


def judge(docs: DataFrame, chain: Chain, carry: list[str], text: str = "text", content_share: float = CONTENT_SHARE) -> DataFrame:
    """``carry`` columns and the figures and verdict of every whole text (null: no words).

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed`` (fewer than
    50 words, or over half of them in repeated three-word windows), ``content_words`` and ``kept``: not ``base_failed`` and at
    least ``content_share`` of the words in content lines. Texts without a word fail. Repeated rows each give a row, an empty table none.
    """
    src = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = src.drop("__text").schema
    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean").add("content_words", "long").add("kept", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            for lo, hi, raw, offs in br.text_slices(batch.column(at)):
                f = analyse(raw, offs)
                content = np.zeros(hi - lo, np.int64)
                if len(f.row):
                    content += np.bincount(f.row, weights=f.line_words * chain.viterbi(f.x, f.row), minlength=hi - lo).astype(np.int64)
                failed = (f.words < 50) | (100 * f.repeated_words > 50 * f.words)
                kept = ~failed & (content >= content_share * f.words)
                part = batch.slice(lo, hi - lo)
                columns = [c for i, c in enumerate(part.columns) if i != at]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(pa.array(c.astype(np.int64)) for c in (f.words, f.word_chars, f.symbols, f.repeated_lines, f.repeated_words)),
                     pa.array(failed), pa.array(content), pa.array(kept)], names=[c.name for c in schema])

    return src.mapInArrow(run, schema)
