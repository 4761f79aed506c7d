import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bayesloom.llm import ctw, queries, suffix_dedup, token_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- repeated strings ----------------------------------------------------------------------------------------------

def brute_dedup(texts, length):
    data = [(t or "").encode() for t in texts]
    n = collections.Counter(b[p:p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if n[b[p:p + length]] > 1:
                mark[p:p + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(mark))]
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((len(b), sum(mark), len(spans), hashlib.sha256(kept).hexdigest(), [x for s in spans for x in s]))
    return out


def texts_with_repeats(seed, n=60):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abé "), rng.integers(1, 12)))
    passages = ["".join(word() for _ in range(12)) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [word() for _ in range(rng.integers(1, 12))]
        for _ in range(rng.integers(0, 3)):
            parts.insert(rng.integers(len(parts) + 1), passages[rng.integers(4)])
        texts.append("".join(parts))
    return texts + [None, "", "a" * 200, "abab" * 60, texts[0], texts[0], texts[1] + "x", "short"]


@pytest.mark.parametrize("length, block, bucket", [(16, 1 << 30, 1 << 30), (20, 500, 300), (33, 2000, 100), (4, 700, 200)])
def test_removed_bytes_equal_brute_force(spark, length, block, bucket):
    texts = texts_with_repeats(length)
    df = spark.createDataFrame([(i % 50, t, i, "x") for i, t in enumerate(texts)], "doc_id int, text string, n int, block string")
    got = {r["n"]: tuple(r[k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"))
           for r in suffix_dedup.dedup(df, ["n", "block"], length=length, block_bytes=block, bucket_bytes=bucket).collect()}
    assert [got[i] for i in range(len(texts))] == brute_dedup(texts, length)


def test_one_passage_in_every_document_over_many_buckets(spark):
    """The passage's token is frequent: its runs differ at their edges and spread over buckets, so the edges compare across buckets."""
    rng = np.random.default_rng(9)
    passage = "".join(rng.choice(list("abcdefgh"), 60))
    near = ["".join(rng.choice(list("ab"), 12)) for _ in range(150)]
    texts = [a + passage + b for a, b in zip(near, near[::-1])]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = {r["n"]: r["spans"] for r in suffix_dedup.dedup(df, ["n"], length=40, block_bytes=1500, bucket_bytes=200).collect()}
    assert [got[i] for i in range(len(texts))] == [x[4] for x in brute_dedup(texts, 40)]


def test_a_hot_token_below_a_bucket_is_cut_into_shares(spark, monkeypatch):
    """A megabyte of different runs around one passage: a sixteenth of a bucket, but more than is sorted at a time."""
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 256 << 10)
    rng = np.random.default_rng(3)
    passage = "".join(rng.choice(list("cdefghij"), 60))
    near = sorted({f"{k:016b}".replace("0", "a").replace("1", "b") for k in rng.integers(0, 1 << 16, 16000)})
    texts = [a + passage + b for a, b in zip(near, near[::-1])]
    written = []
    keep = suffix_dedup.materialise
    monkeypatch.setattr(suffix_dedup, "materialise", lambda df: written.append(keep(df)) or written[-1])
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(4)
    got = {r["n"]: r["spans"] for r in suffix_dedup.dedup(df, ["n"], length=64).collect()}
    assert [got[i] for i in range(len(texts))] == [x[4] for x in brute_dedup(texts, 64)]
    strings = next(t for t in written if "one" in t.columns).filter("kind = 1")
    assert strings.count() > 0  # those of cut tokens
    runs = next(t for t in written if "sha" in t.columns).filter("kind = 3").select("h", "c", "s")
    placed, cut = suffix_dedup._shared_out(runs, suffix_dedup.BUCKET_BYTES)
    shares = [r["bytes"] for r in placed.groupBy("h", "share").agg(F.sum(F.length("s")).alias("bytes")).collect()]
    assert cut and max(shares) < 1.2 * (256 << 10)


def test_shares_of_a_token_in_one_bucket_are_sorted_one_after_another(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 1000)
    rng = np.random.default_rng(4)
    runs = [(a + b"n" * 40 + a) for a in (rng.integers(97, 107, 10, dtype=np.uint8).tobytes() for _ in range(120))]
    bucket = [pa.RecordBatch.from_arrays([pa.array([7] * 20), pa.array(range(k, k + 20)), pa.array(runs[k:k + 20], pa.binary()), pa.array([k // 40] * 20)],
                                         names=["h", "c", "s", "share"]) for k in range(0, 120, 20)]
    out = pa.Table.from_batches(list(suffix_dedup._sort_bucket(40, np.array([7], np.uint64))(iter(bucket)))).to_pylist()
    passage = collections.Counter((r["one"], r["two"]) for r in out if r["kind"] == 1).most_common(1)[0]
    assert passage[1] == 3
    assert {r["c"]: r["starts"] for r in out if r["kind"] == 0}.keys() == set(range(120))


def test_the_query_removes_strings_of_400_bytes_and_no_shorter_passage(spark, tmp_path):
    """Every row of a small table as the brute force has it; with passages of 57 words in two documents each, one a byte too short."""
    rng = np.random.default_rng(7)
    letters = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    short, long = (" ".join([letters(6) for _ in range(56)] + [letters(n)]) for n in (7, 8))
    planted = [f"{letters(50)} {i}{x}{i} {letters(50)}" for x in (short, long) for i in range(2)]
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() + planted
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts))), "text": texts}), tmp_path / "documents.parquet")
    got = {r["doc_id"]: tuple(r[k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in queries.op2_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == [x[:4] for x in brute_dedup(texts, 400)]
    assert [len(short), len(long)] == [399, 400] and [got[i][1] for i in range(len(texts) - 4, len(texts))] == [0, 0, 400, 400]


def test_empty_table_of_texts(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.dedup(df, ["doc_id"]).collect() == []
    assert ctw.score(df, ["doc_id"], F.lit(True)).collect() == []


def test_multikey_ties_are_the_equal_suffixes():
    rng = np.random.default_rng(0)
    group, tokens = rng.integers(0, 3, 400), [rng.integers(0, 3, 400).astype(np.uint64) for _ in range(4)]
    tie = suffix_dedup.multikey_ties(group, tokens)
    keys = list(zip(group, *tokens))
    n = collections.Counter(keys)
    assert [t >= 0 for t in tie] == [n[k] > 1 for k in keys]
    by_tie = collections.defaultdict(set)
    for t, k in zip(tie, keys):
        if t >= 0:
            by_tie[t].add(k)
    assert all(len(v) == 1 for v in by_tie.values()) and len(by_tie) == sum(x > 1 for x in n.values())


# ---- context-tree weighting -------------------------------------------------------------------------------------------

def brute_ctw(train, texts):
    """Every probability by the recursive definition."""
    counts = collections.defaultdict(lambda: [0, 0])
    D = ctw.DEPTH

    def steps(text):
        b = b"\0" * D + (text or "").translate(LOWER).encode() + b"\xff"
        for i in range(D, len(b)):
            node = 1
            for j in range(7, -1, -1):
                bit = b[i] >> j & 1
                yield b[i - D:i], node, bit
                node = node << 1 | bit

    for t in train:
        for context, node, bit in steps(t):
            for d in range(D + 1):
                counts[context[D - d:], node][bit] += 1
    children = collections.defaultdict(set)
    for context, node in counts:
        if context:
            children[context[1:], node].add(context)

    def log_pe(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted = {}

    def log_pw(context, node):
        if (context, node) not in weighted:
            pe = log_pe(*counts[context, node])
            if len(context) < D:
                below = sum(log_pw(c, node) for c in children[context, node])
                top = max(pe, below)
                pe = top + math.log(math.exp(pe - top) + math.exp(below - top)) + math.log(.5)
            weighted[context, node] = pe
        return weighted[context, node]

    def p(context, node, bit):
        path = [d for d in range(D + 1) if (context[D - d:], node) in counts]
        out = None
        for d in reversed(path):
            c = context[D - d:]
            kt = (counts[c, node][bit] + .5) / (sum(counts[c, node]) + 1)
            w = math.exp(math.log(.5) + log_pe(*counts[c, node]) - log_pw(c, node))
            out = kt if out is None else w * kt + (1 - w) * out
        return .5 if out is None else out

    return [sum(math.log10(p(*s)) for s in steps(t)) for t in texts]


def test_scores_equal_the_recursive_definition(spark):
    texts = ["the cat sat on the mat", "The cat and the hat", "", None, "é ñ zz", "a\tb\n the the", "q" * 300, "the cat sat on the mat", "\0\0 \x7f", "only held out ünï"]
    train = [0, 1, 2, 3, 5, 6, 7]
    df = spark.createDataFrame([(i, t, i in train, "k") for i, t in enumerate(texts)], "n int, text string, t boolean, key string")
    rows = {r["n"]: r for r in ctw.score(df, ["n", "key"], F.col("t"), block_bytes=60).collect()}
    want = brute_ctw([texts[i] for i in train], texts)
    assert [rows[i]["score"] for i in range(len(texts))] == pytest.approx(want, rel=1e-9)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    tokens = [word.findall((t or "").translate(LOWER)) + ["\0end"] for t in texts]
    c = collections.Counter(w for i in train for w in tokens[i])
    n = sum(c.values())
    base = [sum(math.log10((c[w] + .1) / (n + .1 * (len(c) + 1))) for w in t) for t in tokens]
    assert [rows[i]["base_score"] for i in range(len(texts))] == pytest.approx(base, rel=1e-9)
    assert [(rows[i]["n_tokens"], rows[i]["n_known"], rows[i]["train_tokens"]) for i in range(len(texts))] == [
        (len(t), sum(c[w] > 0 for w in t), n) for t in tokens]


def test_without_training_every_bit_is_one_half(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "n int, text string")
    rows = {r["n"]: r for r in ctw.score(df, ["n"], F.lit(None).cast("boolean")).collect()}
    assert rows[1]["score"] == pytest.approx(32 * math.log10(.5)) and rows[2]["score"] == pytest.approx(8 * math.log10(.5))
    assert rows[1]["base_score"] == pytest.approx(0) and rows[1]["train_tokens"] == 0


def test_probabilities_of_next_bytes_sum_to_one():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 4, (400, ctw.DEPTH + 1)) @ (np.uint64(256) ** np.arange(ctw.DEPTH, -1, -1, dtype=np.uint64)).astype(np.int64)).astype(np.uint64)
    counts = rng.integers(1, 9, len(keys))
    context = keys[:1] >> np.uint64(8)
    asked = np.unique(np.concatenate([keys, (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)]))
    n = np.where(np.isin(asked, keys), counts[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)], 0)
    *_, mixed = ctw.weigh(asked, n, 0)
    mixed = np.where(np.isnan(mixed), 0.5, mixed)
    assert mixed[(asked >> np.uint64(8)) == context[0]].prod(axis=1).sum() == pytest.approx(1)


def test_lgamma():
    x = np.array([0.5, 1, 1.5, 10.5, 1e3, 1e7])
    assert ctw.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-11)


# ---- token counts -----------------------------------------------------------------------------------------------------

TEXTS = ["", "word", "two words", " lead and trail ", "a<|endoftext|>b <|endoftext|> c", "tabs\t\tand\n\n  lines \n", "x" * 700, "é ñ ß 日本語 テキスト " * 30,
         "don't we'll  they're 12345 3.14 !!! ??" * 20, " " * 500, "    mixed  spaces  " * 25, "line\nline\n" * 90, "end \x1c\x1d odd \x85 " * 30]


@pytest.mark.parametrize("chunk, overlap", [(40, 8), (64, 1), (200, 30), (16, 16)])
def test_spliced_counts_equal_whole_texts(chunk, overlap, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    counter = token_counts.Counter(path, chunk, overlap)
    assert counter.splits
    want = [len(whole.encode(t, add_special_tokens=False)) for t in TEXTS]
    assert counter.count(pa.array(TEXTS)).tolist() == want
    assert token_counts.Counter(path).count(pa.array([*TEXTS, None])).tolist() == [*want, 0]
    monkeypatch.setattr(token_counts, "CALL", 50)
    monkeypatch.setattr(token_counts, "KNOWN", 7)
    assert token_counts.Counter(path).count(pa.array(TEXTS)).tolist() == want
    assert [counter.count_long(t) for t in TEXTS if t] == [len(whole.encode(t, add_special_tokens=False)) for t in TEXTS if t]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_each_library(spark, name):
    public = pytest.importorskip("public_tokenizers")
    path = public.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        count = lambda t: len(whole.encode(t, add_special_tokens=False))
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    texts = TEXTS + [None, TEXTS[5]]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "n int, text string, n_tokens int")
    rows = {r["n"]: r for r in token_counts.token_counts(df, path, ["n"], limit=100, chunk=64, overlap=8).collect()}
    assert [rows[i]["n_tokens"] for i in range(len(texts))] == [count(t or "") for t in texts]
    assert [rows[i]["n_bytes"] for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in rows.values())
