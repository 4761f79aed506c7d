import collections
import random
import zlib

import numpy as np
import pytest

from bayesloom.llm import mixing, sharding


# ---- mixing ----------------------------------------------------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1), repeats=3):
    """Share by weight; stop sources above their bound and share their excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(repeats * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        target = {s: repeats * sizes[s] for s in stopped} | {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > repeats * sizes[s]}
        if not over:
            return target
        stopped |= over


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 500, None: 40}, {"a": 0, "b": 7}, {"a": 5}, {"é": 100, "z": 1, "Z": 1, "": 400, "zz": 90}, {f"s{i}": (i * 37) % 11 * 100 for i in range(20)},
])
def test_targets_equal_repeated_sharing(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


@pytest.mark.parametrize("seed", range(5))
def test_a_flight_keeps_words_and_documents(seed):
    rng = random.Random(seed)
    size = [float(rng.randint(0, 50)) for _ in range(200)] + [7.0] * 40
    p = [rng.random() for _ in size]
    q = mixing.flight(p, size, rng)
    assert sum(0 < x < 1 for x in q) <= 2
    assert sum(q) == pytest.approx(sum(p), abs=1e-6)
    assert sum(a * b for a, b in zip(q, size)) == pytest.approx(sum(a * b for a, b in zip(p, size)), abs=1e-5)


def test_flights_keep_every_expectation():
    size, p, n = [3.0, 8.0, 2.0, 9.0, 4.0, 1.0], [0.2, 0.5, 0.7, 0.4, 0.9, 0.3], 4000
    total = np.zeros(len(p))
    for seed in range(n):
        total += mixing.flight(p, size, random.Random(seed))
    assert np.abs(total / n - p).max() < 0.04


def documents(n=900, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(["w"] * int(rng.lognormal(3, 1))), ["a", "b", "c", "d", None][int(rng.integers(5))]) for i in range(n)]
    rows += [(n, "huge " * 3000, "a"), (n + 1, None, "b"), (n + 2, "", "empty"), (n + 3, " \t", "empty"), (5, rows[5][1], rows[5][2]), (None, "x y", "c")]
    return rows


def test_mix_reaches_targets_and_bounds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 60)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("doc_id", "size")
    out = mixing.mix(df, ["size"], "source").toDF("doc_id", "size", "source_size", "target", "times", "taken").collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    assert len(out) == len(rows)
    taken = collections.Counter()
    for r in out:
        assert 0 <= r["times"] <= 3 and r["taken"] == r["times"] * r["size"]
        taken[round(r["target"], 6), r["source_size"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[round(float(t), 6), sizes[s]] - t) <= 5
    again = mixing.mix(df.repartition(7), ["size"], "source").toDF("doc_id", "size", "source_size", "target", "times", "taken").collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixed_rows_stand_as_often_as_taken(spark):
    rows = documents(200)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = collections.Counter()
    for r in mixing.mix(df, ["doc_id"]).collect():
        times[r["doc_id"]] += r["times"]
    got = mixing.mixed(df)
    assert got.columns == df.columns
    rows_out = got.collect()
    by_id = collections.Counter(r["doc_id"] for r in rows_out)
    assert set(by_id) <= {r[0] for r in rows}
    assert sum(len((r["text"] or "").split()) for r in rows_out) == pytest.approx(sum(brute_targets(_sizes(rows)).values()), abs=30)
    assert all(tuple(r) in set(rows) for r in rows_out)


def _sizes(rows):
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    return sizes


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df, ["doc_id"]).collect() == [] and mixing.mixed(df).collect() == []


# ---- sharding --------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n, shards, block", [(0, 8, 10), (3, 8, 10), (1000, 8, 50), (997, 3, 1000), (500, 1, 7)])
def test_shards_have_exact_sizes_and_gapless_slots(spark, n, shards, block):
    rows = [(i % 400 if i % 7 else None, f"text {i % 50}" if i % 5 else None, "old") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sharding.shard(df, shards, block_rows=block).collect()
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in out])) == sorted(map(str, [r[:2] for r in rows]))
    for s in range(shards):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n // shards + (s < n % shards)))


def test_equal_rows_are_kept_and_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 37)
    df = spark.createDataFrame([(1, "same")] * 400 + [(i, "other") for i in range(100)], "doc_id long, text string")
    out = sharding.shard(df, 4, block_rows=40).collect()
    n = collections.Counter(r["shard"] for r in out if r["text"] == "same")
    assert len(out) == 500 and sum(n.values()) == 400 and min(n.values()) > 70


def test_reruns_agree_and_seeds_differ(spark):
    df = spark.createDataFrame([(i, "t") for i in range(300)], "doc_id long, text string")
    place = lambda d, seed: {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(d, 4, seed, 40).collect()}
    assert place(df, 1) == place(df.repartition(5), 1) != place(df, 2)


def test_draws_follow_the_hypergeometric_law():
    rng = random.Random(1)
    got = collections.Counter(sharding.hypergeometric(12, 30, 9, rng) for _ in range(20000))
    import math
    for k in range(10):
        p = math.comb(12, k) * math.comb(18, 9 - k) / math.comb(30, 9)
        assert abs(got[k] / 20000 - p) < 0.015
    assert sharding.hypergeometric(5, 5, 3, rng) == 3 and sharding.hypergeometric(0, 9, 3, rng) == 0 and sharding.hypergeometric(4, 9, 9, rng) == 4


def test_matrix_has_both_margins():
    blocks, shards = [(0, 70), (1, 0), (2, 31), (5, 99)], [50, 50, 50, 50]
    cells = list(sharding.communication_matrix(blocks, shards, 3))
    rows, columns = collections.Counter(), collections.Counter()
    for b, s, lo, hi in cells:
        rows[b] += hi - lo
        columns[s] += hi - lo
    assert rows == {0: 70, 2: 31, 5: 99} and [columns[s] for s in range(4)] == shards


def test_a_row_is_equally_likely_in_every_shard(spark):
    df = spark.createDataFrame([(i,) for i in range(64)], "doc_id long")
    where = collections.Counter()
    for seed in range(12):
        for r in sharding.shard(df, 4, seed, 16).collect():
            where[r["doc_id"] < 16, r["shard"]] += 1
    assert all(abs(where[True, s] - 48) < 24 for s in range(4))


def test_query_digest(spark):
    from bayesloom.llm.queries import REGISTRY

    out = REGISTRY["op4_sharding"](spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(out) == len(docs)
    for r in out:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_query_shards_the_whole_documents(spark):
    from bayesloom.llm.queries import REGISTRY
    sf = "/root/testdata/sf0.001"
    whole = sharding.shard(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    digest = lambda r: (r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"])
    out = REGISTRY["op4_sharding"](spark, sf).collect()
    assert sorted(map(digest, whole), key=str) == sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in out), key=str)
