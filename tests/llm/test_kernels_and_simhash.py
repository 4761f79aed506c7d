import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from bayesloom.llm import bytesrows as br
from bayesloom.llm import simhash_golay as sg
from bayesloom.llm.shared import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aB é\t\n ñ 𝄞", max_size=40), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    raw, offs = br.text_bytes(pa.array(texts, pa.string()))
    start, end, row = br.word_spans(raw, offs)
    got = [[] for _ in texts]
    for a, b, r in zip(start, end, row):
        got[r].append(raw[a:b].tobytes().decode())
    assert got == [WORD.findall(t or "") for t in texts]
    joined, a, b, _ = br.single_spaced(raw, offs)
    assert [joined[x:y].tobytes().decode() for x, y in zip(a, b)] == [w.translate(LOWER) for t in texts for w in WORD.findall(t or "")]


def test_xxh64_equals_the_library_at_all_lengths():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 4000, dtype=np.uint8)
    start = rng.integers(0, 3000, 500)
    end = start + rng.integers(0, 300, 500)
    assert br.xxh64(raw, start, end).tolist() == [xxhash.xxh64_intdigest(raw[a:b].tobytes(), 42) for a, b in zip(start, end)]


def test_rolling_hash_knows_equal_substrings_only():
    raw = np.frombuffer(b"abcabcabd ABC", np.uint8)
    h = br.RollingHash(raw)
    of = lambda a, b, x=h: int(x.of(np.array([a]), np.array([b]))[0])
    assert of(0, 3) == of(3, 6) != of(6, 9)
    assert of(0, 3, br.RollingHash(raw, br.LOWER)) == of(10, 13, br.RollingHash(raw, br.LOWER)) == br.hash_word("abc", br.LOWER)
    assert br.hash_word("a-b!", br.LOWER, br.ALNUM) == br.hash_word("AB", br.LOWER, br.ALNUM)
    assert h.windows(3).tolist() == [of(i, i + 3) for i in range(len(raw) - 2)]


def test_slices_cover_all_rows_and_long_rows_stand_alone():
    offs = np.array([0, 5, 5, 30, 31, 33])
    assert list(br.slices(offs, 6)) == [(0, 2), (2, 3), (3, 5)]


def test_golay_code_is_perfect():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 2000)
    low, high, error = sg._tables()
    code = words ^ error[low[words & 2047] ^ high[words >> 11]]
    assert (low[code & 2047] ^ high[code >> 11] == 0).all()
    assert (np.bitwise_count(words ^ code) <= 3).all()
    assert len(np.unique(error)) == 2048


def test_every_pair_within_three_bits_shares_a_key():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    row_a, key_a, probe_a = sg.golay_keys(a)
    row_b, key_b, probe_b = sg.golay_keys(b)
    probes = set(zip(row_a[probe_a].tolist(), key_a[probe_a].tolist()))
    met = {r for r, k in zip(row_b[~probe_b].tolist(), key_b[~probe_b].tolist()) if (r, k) in probes}
    assert met == set(range(len(a)))


def brute_components(rows):
    """rows of (id, text) -> {row index: (fingerprint, component id)}"""
    prints = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        shingles = [" ".join(w[j:j + 3]) for j in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                up[find(i)] = find(j)
    low = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            r = find(i)
            low[r] = min(low.get(r, id_), id_)
    return [("%016x" % prints[i], low.get(find(i))) for i in range(len(rows))]


def cases():
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 6))) for _ in range(300)]
    base = [" ".join(rng.choice(vocab, rng.integers(30, 200))) for _ in range(12)]
    texts = []
    for t in base:
        texts += [t, t, t.upper()]
        for _ in range(3):
            w = t.split()
            w[rng.integers(len(w))] = "changed"
            texts.append("\n ".join(w))
    texts += [None, "", "   ", "one", "one two", "ONE  two", "one two three", "x " * 5000]
    ids = [int(x) for x in rng.permutation(len(texts))]
    ids[3], ids[5] = ids[4], None
    return list(zip(ids, texts))


def test_near_duplicates_equal_brute_force(spark):
    rows = cases()
    df = spark.createDataFrame([(i, t, n, "a", "b") for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int, fp string, root string")
    got = {r["n"]: (format(r["fp"] % 2**64, "016x"), r["component_id"]) for r in sg.near_duplicates(df, ["doc_id", "n"]).collect()}
    assert [got[i] for i in range(len(rows))] == brute_components(rows)


def test_one_row_of_each_group_stays(spark):
    rows = cases()
    rows[3] = (1000, rows[3][1])  # here no two components share an id
    rows += [rows[0], (None, "alone null id")]
    df = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, lang string")
    kept = sg.keep_one(df).collect()
    want = brute_components(rows)
    groups = {(c, p if c is None else "") for p, c in want}
    assert len(kept) == len(groups)
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({c for _, c in want if c is not None})
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang"}


def test_empty_table_and_bad_distance(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sg.near_duplicates(df, ["doc_id"]).collect() == []
    assert sg.keep_one(df).collect() == []
    with pytest.raises(ValueError):
        sg.links(df, "doc_id", 4)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 200), (300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(20)} | {300: 300, 301: 300}
