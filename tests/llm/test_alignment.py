"""Alignment against the definition on whole texts: both libraries, offsets, links and counts spelled out."""

import hashlib
import random
from collections import Counter
from functools import lru_cache

import pytest

from bayesloom.llm import alignment as al

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@lru_cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), {i: t for t, i in a.get_vocab().items()}


def spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def plain(texts):
    a, b, names = libraries()
    byte = al._byte_of_char()
    rows, counts = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [bytes(byte[c] for c in names[i]) if i != 50256 else b"<|endoftext|>" for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            rows.append(None)
            continue
        span_a, span_b = spans(bytes_a), spans(bytes_b)
        ends = sorted({e for _, e in span_a} & {e for _, e in span_b})
        groups, at = [], 0
        for e in ends:
            groups.append(",".join(str(i) for i, (s, f) in zip(ids_a, span_a) if at <= s and f <= e) + "|"
                          + ",".join(str(i) for i, (s, f) in zip(ids_b, span_b) if at <= s and f <= e))
            at = e
        links = [(i, j) for i, (s, f) in zip(ids_a, span_a) for j, (t, g) in zip(ids_b, span_b) if s < g and t < f]
        counts.update(set(links))
        rows.append((len(ids_a), len(ids_b), len(ends), links, ";".join(groups)))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((*r[:3], len(r[3]), sum(counts[x] == best[x[0]] for x in r[3]), sum(counts[x] for x in r[3]), r[4]))
    return out


def texts(seed, n):
    rng = random.Random(seed)
    words = ["Hello", "the", "the", "Wörter", "naïve!", "3.14", "don't", "<|endoftext|>", "<s>", "▁odd", "ＡＢ。", "”quoted”", "ñandú", " ", "x" * 50,
             "é", " em", "😀", "кот", "тут", "«a»", "ﬁ", "", "  ", "\t", "\n", "\x00", "<0x41>", "antidisestablishmentarianism"]
    out = [None, "", " ", "  ", "a", " a", "a ", "a  ", "▁", "\n", "x" * 300, "a  b", "é b", "” b", "<|endoftext|> <|endoftext|>"]
    for _ in range(n):
        use = [w for w in words if w != "▁odd" or rng.random() < 0.1]
        out.append("".join(rng.choice(use) + rng.choice((" ", " ", " ", "", "\n", "  ", ". ")) for _ in range(rng.choice((1, 4, 20, 120)))))
    return out


def compare(spark, data, **options):
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(data)], "id int, text string, block string, `at` int").repartition(3)
    got = sorted(map(tuple, al.align(df, A, B, ["id"], **options).collect()))
    assert [r[0] for r in got] == list(range(len(data)))
    return [r[1:] for r in got]


def test_equals_the_definition(spark):
    data = texts(1, 150)
    want = plain(data)
    assert sum(w[0] == 0 for w in want) < 40 < len(want)
    assert compare(spark, data) == want
    digests = [(*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in want]
    assert compare(spark, data, keep="sha256") == digests


@pytest.mark.parametrize("seed", [2, 3])
def test_small_slices_blocks_and_memories(seed, monkeypatch):
    """Parts of long documents, blocks and forgotten memories change nothing (within one worker)."""
    import numpy as np
    import pyarrow as pa

    data = [t for t in texts(seed, 60)] + ["The same words again and again. " * 40]
    want = plain(data)
    for size in (1 << 20, 64):
        monkeypatch.setattr(al, "SLICE", size)
        aligner = al.Aligner(A, B, "groups")
        raw, offs = al.br.text_bytes(pa.array(data, pa.string()))
        linked: Counter = Counter()
        rows = []
        block = al.Block(0)
        for lo, hi in al.br.slices(offs, size):
            part = aligner.aligned(raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], block)
            rows += list(zip(*(part[c].tolist() for c in ("n_a", "n_b", "n_groups", "n_links")), part["groups"]))
            if size == 64:
                for key, n in zip(block.keys.values[:block.keys.n], block.docs):
                    linked[int(key)] += int(n)
                block = al.Block(0)
                aligner.windows.forget()
                aligner.pieces.forget()
            assert part["which"].type == pa.binary() and len(part["times"]) == hi - lo
        assert rows == [(*w[:4], w[6]) for w in want]
        if size != 64:
            every = {int(k): int(n) for k, n in zip(block.keys.values[:block.keys.n], block.docs)}
        else:
            assert every == dict(linked)
    assert isinstance(np.sum(list(every.values())), np.integer)


def test_stable_spaces_are_stable():
    """Encoding the parts between stable spaces gives the ids of the whole."""
    import numpy as np

    a, b, _ = libraries()
    for text in texts(7, 200):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        if not len(raw):
            continue
        cuts = al.stable_spaces(raw, np.array([0, len(raw)])).tolist()
        parts = [raw.tobytes()[i:j].decode() for i, j in zip([0, *[c + 1 for c in cuts]], [*cuts, len(raw)])]
        assert [i for p in parts for i in a.encode(" " + p, add_special_tokens=False).ids] == a.encode(" " + text, add_special_tokens=False).ids
        assert [i for p in parts for i in b.encode(p)] == b.encode(text)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "one two")] * 5, "id int, text string")
    rows = al.align(df, A, B, ["id", "text"]).collect()
    assert len(rows) == 5 and len(set(rows)) == 1 and rows[0].count_sum == 5 * rows[0].n_links
    assert al.align(df.limit(0), A, B, ["id"]).count() == 0
