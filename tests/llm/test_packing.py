"""Packing against the plain quadratic programme, the library's ids of whole texts, and itself in other slices."""

import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from bayesloom.llm import packing as pk

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def padded(n, size):
    return 0 if n & (n - 1) == 0 else size - n


def plain_cost(places, penalty, size, per_sequence):
    cost = [0]
    for j in range(1, len(places)):
        cost.append(min(cost[i] + padded(places[j] - places[i], size) + per_sequence + penalty[j]
                        for i in range(j) if places[j] - places[i] <= size))
    return cost


@pytest.mark.parametrize("seed", range(12))
def test_cuts_are_the_cheapest(seed):
    rng = random.Random(seed)
    size = rng.choice((8, 64, 60))
    places = np.cumsum([0] + [rng.choice((1, 1, 2, 3, 5, size // 2)) for _ in range(300)])
    penalty = np.array([0] + [rng.choice((0, 4, 30)) for _ in range(300)])
    back = pk.best_cuts(places, penalty, size, 2)
    want, got = plain_cost(places.tolist(), penalty.tolist(), size, 2), [0]
    for j in range(1, len(places)):
        n = int(places[j] - places[back[j]])
        assert 0 < n <= size
        got.append(got[back[j]] + padded(n, size) + 2 + int(penalty[j]))
    assert got == want


def texts(seed, n):
    rng = random.Random(seed)
    words = ["Hello", "world.", "What?\"", "3.14", "l'été", "naïve!", "x" * 40, "ＡＢＣ。", "<|endoftext|>", "don't", "ﬁn", "İı", "áb", "…",
             " nb", "one　two", "​", "é.", "😀😀"]
    out = ["", None, " \n ", "x" * 900, "Same text. " * 30]
    for _ in range(n):
        out.append("".join(rng.choice(words) + rng.choice((" ", "  ", "\n", "\t", "\r\n")) for _ in range(rng.choice((1, 5, 40, 400)))))
    return out


@lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def whole(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 1]


def stream(parts, size=64, gap=16):
    s = pk.Stream(pk.WordIds(PATH), 1, size, (3, 20, 2), gap, 0)
    out, at = [], 0
    for part in parts:
        column = pa.array(part, pa.string())
        raw, offs = pk.br.text_bytes(column)
        s.add(raw, offs, pa.table({"c": pa.array(range(at, at + len(part)))}))
        at += len(part)
        out.append(s.pack(False))
    out.append(s.pack(True))
    return pa.concat_tables([t for t in out if t is not None]).to_pylist()


def test_slices_give_the_same_pieces(monkeypatch):
    data = texts(3, 60)
    one = stream([data])
    assert one == stream([[t] for t in data])
    monkeypatch.setattr(pk, "SLICE", 100)
    monkeypatch.setattr(pk, "KNOWN", 7)
    assert one == stream([data[i:i + 7] for i in range(0, len(data), 7)])


def check(rows, data, size):
    """Pieces cover every document once, in order, and fill sequences without a gap."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(data)))
    for doc, pieces in by_doc.items():
        ids = []
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == len(ids) and p["length"] * 4 == len(p["ids"]) > 0
            ids += np.frombuffer(p["ids"], "<u4").tolist()
        assert ids == whole(data[doc]) and all(p["doc_tokens"] == len(ids) for p in pieces)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
    return by_sequence


def test_table(spark):
    data = texts(8, 80)
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in enumerate(data)], "doc int, text string, ids string, __text int").repartition(3)
    rows = [r.asDict() for r in pk.pack(df, PATH, ["doc"], size=128, gap=64).collect()]
    by_sequence = check(rows, data, 128)
    total = sum(len(whole(t)) for t in data)
    lengths = [sum(p["length"] for p in s) for s in by_sequence.values()]
    assert sum(padded(n, 128) for n in lengths) < 0.1 * total
    carried = pk.pack(df, PATH, ["doc", "ids", "__text"]).drop("ids")
    assert carried.columns[:2] == ["doc", "__text"]
    assert pk.pack(df.limit(0), PATH, ["doc"]).count() == 0


def test_order_and_repeated_rows(spark):
    data = ["Same text here. And there."] * 40 + ["Other."] * 20
    df = spark.createDataFrame([(i % 3 if i < 40 else None, t) for i, t in enumerate(data)], "doc int, text string").repartition(4)
    rows = pk.pack(df, PATH, ["doc"], size=64, gap=32, order=["doc"]).collect()
    n = {t: len(whole(t)) for t in set(data)}
    assert sum(r.length for r in rows) == 40 * n[data[0]] + 20 * n["Other."]
    assert sum(r.start == 0 for r in rows) == 60
    keys = [(-1 if r.doc is None else r.doc) for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert keys == sorted(keys)


def test_query_digests(spark):
    from bayesloom.llm.queries import REGISTRY

    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    seen = {}
    for r in REGISTRY["op11_packing"](spark, sf).collect():
        ids = whole(text[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids)
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {d: len(whole(t)) for d, t in text.items()}
