"""Arrow text columns as byte arrays: white-space words, rolling hashes and XXH64 for whole batches at once.

Used inside ``mapInArrow`` tasks. A batch is worked on in slices of whole documents of about
``SLICE_BYTES`` (a longer document is a slice of its own), so that a task's memory follows
the slice and the longest document, not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

# white space of the contracts: 0x20 and 0x09-0x0D
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after another, and each row's offset (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def give_back() -> None:
    """Hand freed memory back to the system at a task's end: workers stay for later tasks, beside the JVM that then needs it."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for each slice of a text column."""
    raw, offs = text_bytes(column)
    for lo, hi in slices(offs, limit):
        part = offs[lo:hi + 1]
        yield lo, hi, raw[part[0]:part[-1]], part - part[0]


def word_spans(raw: np.ndarray, offs: np.ndarray, space: np.ndarray = IS_SPACE):
    """Start, end and row of each maximal run of bytes that ``space`` doesn't mark; runs never cross rows."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~space[raw]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    first = offs[:-1]
    before[first[first < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    step = base & (2**64 - 1)
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * _U(step)
        done += more
        step = step * step & (2**64 - 1)
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits of the input."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class RollingHash:
    """64-bit hashes of any substrings of one byte array, from prefix sums.

    ``fold`` maps bytes first (such as to lower case); bytes that ``keep`` (by byte value) or ``mask``
    (by place) doesn't mark are left out.
    """

    def __init__(self, raw: np.ndarray, fold: np.ndarray | None = None, keep: np.ndarray | None = None, mask: np.ndarray | None = None):
        codes = _BYTE_CODE if fold is None else _BYTE_CODE[fold]
        value = codes[raw]
        if keep is None and mask is None:
            self.place = None
            weight = powers(len(raw) + 1)
            self.inverse = powers(len(raw) + 1, BASE_INVERSE)
        else:
            kept = keep[raw] if mask is None else mask
            place = np.zeros(len(raw) + 1, np.int64)
            np.cumsum(kept, out=place[1:])
            self.place = place
            table = powers(int(place[-1]) + 1)
            weight = table[place]
            value = np.where(kept, value, _U(0))
            self.inverse = powers(int(place[-1]) + 1, BASE_INVERSE)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(value * weight[:len(raw)], out=self.sums[1:])

    def length(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return end - start if self.place is None else self.place[end] - self.place[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        at = start if self.place is None else self.place[start]
        h = (self.sums[end] - self.sums[start]) * self.inverse[at]
        return mix(h + self.length(start, end).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all substrings of ``size`` bytes, by their start (no ``keep`` and no ``mask``)."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n] + _U(size)) if n > 0 else np.zeros(0, np.uint64)


def hash_word(word: str, fold: np.ndarray | None = None, keep: np.ndarray | None = None) -> int:
    """The hash that ``RollingHash`` gives for a whole string."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(RollingHash(raw, fold, keep).of(np.array([0]), np.array([len(raw)]))[0])


def sequence_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (len - size + 1 of them)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = (h ^ words[j:j + n]) * _U(0x9DDFEA08EB382D69) + _U(0x632BE59BD9B4E019)
        h ^= h >> _U(29)
    return mix(h)


def single_spaced(raw: np.ndarray, offs: np.ndarray, fold: np.ndarray = LOWER):
    """Words joined by one space: new bytes, and each word's start, end and row in them."""
    start, end, row = word_spans(raw, offs)
    size = end - start
    new_start = np.cumsum(size + 1) - (size + 1)
    out = np.full(int(size.sum() + len(size)), 0x20, np.uint8)
    inside = ~IS_SPACE[raw]
    body = np.ones(len(out), bool)
    body[new_start + size] = False
    out[body] = fold[raw[inside]]
    return out, new_start, new_start + size, row


# fixed values: the primes of XXH64
_P1, _P2, _P3, _P4, _P5 = (_U(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(acc, lane):
    return _turn(acc + lane * _P2, 31) * _P1


def xxh64(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each substring ``raw[start:end]``, all substrings at once."""
    seed_ = _U(seed)
    padded = np.zeros(len(raw) + 40, np.uint8)
    padded[:len(raw)] = raw
    wide = np.ndarray((len(raw) + 32,), "<u8", padded, strides=(1,))
    half = np.ndarray((len(raw) + 32,), "<u4", padded, strides=(1,))
    at, size = start.astype(np.int64), (end - start).astype(np.int64)
    h = np.full(len(at), seed_ + _P5, np.uint64)
    long = np.flatnonzero(size >= 32)
    if len(long):
        first = np.array([(seed + int(_P1) + int(_P2)) % 2**64, (seed + int(_P2)) % 2**64, seed, (seed - int(_P1)) % 2**64], np.uint64)
        acc = np.tile(first, (len(long), 1))
        left, pos = size[long] // 32, at[long].copy()
        live = np.arange(len(long))
        while len(live):
            for k in range(4):
                acc[live, k] = _round(acc[live, k], wide[pos[live] + 8 * k])
            pos[live] += 32
            left[live] -= 1
            live = live[left[live] > 0]
        v = _turn(acc[:, 0], 1) + _turn(acc[:, 1], 7) + _turn(acc[:, 2], 12) + _turn(acc[:, 3], 18)
        for k in range(4):
            v = (v ^ _round(_U(0), acc[:, k])) * _P1 + _P4
        h[long] = v
        at = at.copy()
        at[long] = pos
    h += size.astype(np.uint64)
    rest = end - at
    for _ in range(3):
        go = np.flatnonzero(rest >= 8)
        if not len(go):
            break
        h[go] = _turn(h[go] ^ _round(_U(0), wide[at[go]]), 27) * _P1 + _P4
        at[go] += 8
        rest[go] -= 8
    go = np.flatnonzero(rest >= 4)
    h[go] = _turn(h[go] ^ (half[at[go]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at[go] += 4
    rest[go] -= 4
    for _ in range(3):
        go = np.flatnonzero(rest > 0)
        if not len(go):
            break
        h[go] = _turn(h[go] ^ (padded[at[go]].astype(np.uint64) * _P5), 11) * _P1
        at[go] += 1
        rest[go] -= 1
    h ^= h >> _U(33)
    h *= _P2
    h ^= h >> _U(29)
    h *= _P3
    return h ^ (h >> _U(32))


def bit_counts(h: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """(n_rows, 64) counts of set bits; ``row`` is ascending. Bit 0 is the lowest."""
    out = np.zeros((n_rows, 64), np.int64)
    if not len(h):
        return out
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    first = np.flatnonzero(new)
    inside = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    block = np.flatnonzero(inside % 255 == 0)  # at most 255 rows, so that a count fits a byte
    owner = row[block]
    for k in range(8):
        plane = (h >> _U(k)) & _U(0x0101010101010101)
        sums = np.add.reduceat(plane, block).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            out[:, byte * 8 + k] = np.bincount(owner, weights=sums[:, byte], minlength=n_rows)
    return out
