"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features per document: densities of a learned lexicon (plain words, and words after undoing letter
swaps and stretched letters), hits close to second-person words, capitals, punctuation and obfuscation
rates. The label is only read for fitting. A sample of at most ``SAMPLE`` labelled documents, chosen by the
hash of their id, is cut in three by another hash: one part gives the lexicon, one the trees (Spark ML),
one the isotonic calibration, so that no part is fitted on words it helped to choose.

A word enters the lexicon by its log-odds between toxic and other documents of the first part, if it
follows at least ``MIN_CONTEXTS`` different words there (copies of one document give one context).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bayesloom.llm import bytesrows as br
from bayesloom.llm.shared import one_text_per_id

SAMPLE = 20_000
LEXICON = 300
MIN_CONTEXTS = 5
MIN_LOG_ODDS = 1.5
#: words between a lexicon hit and a second-person word
REACH = 5
TREES, DEPTH = 25, 4

# fixed values: second-person words of English, German, French and Spanish
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "euch", "ihr",
                 "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "usted", "ustedes", "vosotros")

FEATURES = ("hit_density", "weight_density", "hits", "distinct_hits", "burst", "hidden_density", "hidden_hits", "aimed_density", "aimed_hits",
            "second_person", "capitals", "shouted_words", "exclamations", "questions", "punctuation", "swapped_letters", "single_letters",
            "stretched_letters", "word_length", "words")

# fixed values: signs that stand for letters
SWAPS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LETTER = _ASCII_LETTER.copy()
_LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_INNER = np.zeros(256, bool)
_INNER[[ord(c) for c in "0134578@$*._-"]] = True
_UNSWAP = br.LOWER.copy()
for _sign, _letter in SWAPS.items():
    _UNSWAP[ord(_sign)] = ord(_letter)
_SECOND = np.sort(np.array([br.hash_word(w, br.LOWER, br.ALNUM) for w in SECOND_PERSON], np.uint64))


def _plain_hash(raw, start, end):
    return br.RollingHash(raw, br.LOWER, br.ALNUM).of(start, end)


def _core_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of words with swapped signs turned back into letters between letters, other signs dropped, and runs of a letter as one."""
    letter = _LETTER[raw]
    inner = np.zeros(len(raw), bool)
    inner[1:-1] = (_INNER[raw] & ~_LETTER[raw])[1:-1] & (letter[:-2] | _INNER[raw][:-2]) & (letter[2:] | _INNER[raw][2:])
    folded = _UNSWAP[raw]
    use = letter | (inner & _ASCII_LETTER[folded])
    same = np.zeros(len(raw), bool)
    same[1:] = (folded[1:] == folded[:-1]) & use[:-1] & (raw[1:] < 128)
    same[start] = False
    return br.RollingHash(folded, mask=use & ~same).of(start, end)


@dataclass
class Lexicon:
    plain: np.ndarray
    weight: np.ndarray
    core: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Lexicon:
        rows = sorted((np.uint64(r["h"] % 2**64), r["w"], np.uint64(r["core"] % 2**64)) for r in rows)
        return cls(np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], float), np.unique(np.array([r[2] for r in rows], np.uint64)))


def _member(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each hash in a sorted table, -1 if it isn't there."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def featurise(raw: np.ndarray, offs: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    n = len(offs) - 1
    start, end, row = br.word_spans(raw, offs)
    n_words = np.bincount(row, minlength=n).astype(float) if len(row) else np.zeros(n)
    per = np.maximum(n_words, 1)

    def rate(mark: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=mark, minlength=n) if len(row) else np.zeros(n)

    def bytes_of(mark: np.ndarray) -> np.ndarray:
        s = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(mark, out=s[1:])
        return s

    plain = _plain_hash(raw, start, end)
    at = _member(plain, lexicon.plain)
    hit = at >= 0
    weight = np.where(hit, lexicon.weight[at] if len(lexicon.weight) else 0.0, 0.0)
    hidden = (_member(_core_hash(raw, start, end), lexicon.core) >= 0) & ~hit if len(raw) else hit
    second = _member(plain, _SECOND) >= 0
    any_hit = hit | hidden
    close = np.zeros(len(row), bool)
    for d in range(1, REACH + 1):
        if len(row) > d:
            same = row[d:] == row[:-d]
            close[d:] |= second[:-d] & same
            close[:-d] |= second[d:] & same
    total = np.append(0, np.cumsum(any_hit))
    burst = np.zeros(n)
    if len(row):
        first = np.cumsum(n_words).astype(np.int64) - n_words.astype(np.int64)
        lo = np.maximum(np.arange(len(row)) - 9, first[row])
        np.maximum.at(burst, row[any_hit], (total[1:] - total[lo])[any_hit])
    distinct = np.zeros(n)
    if hit.any():
        pairs = np.unique(row[hit] * len(lexicon.plain) + at[hit]) // len(lexicon.plain)
        distinct = np.bincount(pairs, minlength=n).astype(float)

    letters, upper = bytes_of(_ASCII_LETTER[raw]), bytes_of(_UPPER[raw])
    word_letters, word_upper = letters[end] - letters[start], upper[end] - upper[start]
    inner = np.zeros(len(raw), bool)
    if len(raw) > 2:
        inner[1:-1] = _INNER[raw[1:-1]] & _LETTER[raw[:-2]] & _LETTER[raw[2:]]
    inner = bytes_of(inner)
    stretched = np.zeros(len(raw), bool)
    if len(raw) > 2:
        stretched[2:] = (br.LOWER[raw[2:]] == br.LOWER[raw[1:-1]]) & (br.LOWER[raw[1:-1]] == br.LOWER[raw[:-2]]) & _ASCII_LETTER[raw[2:]]
    stretched = bytes_of(stretched)
    single = (end - start == 1) & (word_letters == 1)
    run = np.zeros(len(row), bool)
    if len(row) > 2:
        three = single[:-2] & single[1:-1] & single[2:] & (row[:-2] == row[2:])
        run[:-2] |= three
        run[1:-1] |= three
        run[2:] |= three
    size = np.maximum(np.diff(offs), 1)
    share = lambda mark, of=size: (lambda s: (s[offs[1:]] - s[offs[:-1]]) / of)(bytes_of(mark))
    hits, hid, aimed = rate(hit), rate(hidden), rate(any_hit & close)
    return np.stack([
        hits / per, rate(weight) / per, np.log1p(hits), np.log1p(distinct), burst, hid / per, np.log1p(hid), aimed / per, np.log1p(aimed),
        rate(second) / per, share(_UPPER[raw], np.maximum(letters[offs[1:]] - letters[offs[:-1]], 1)), rate((word_upper >= 2) & (word_upper == word_letters)) / per,
        share(raw == 33), share(raw == 63), share(_PUNCTUATION[raw]), rate(inner[end] - inner[start] > 0) / per, rate(run) / per,
        rate((stretched[end] - stretched[np.minimum(start + 2, end)]) > 0) / per, rate(end - start) / per, np.log1p(n_words)], axis=1)


def _labelled(docs: DataFrame, chosen: DataFrame, id_col: str, text: str) -> DataFrame:
    """(__id, y, part, text), one row per id."""
    return one_text_per_id(docs, chosen, id_col, text).select("__id", "y", "part", "text")


def _learn_lexicon(src: DataFrame) -> Lexicon:
    """From rows (y, text); the words of toxic documents by what stands before them, those of the others as counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, raw, offs in br.text_slices(batch.column(1)):
                start, end, row = br.word_spans(raw, offs)
                h = _plain_hash(raw, start, end)
                core = _core_hash(raw, start, end)
                before = np.zeros(len(h), np.uint64)
                before[1:] = np.where(row[1:] == row[:-1], h[:-1], 0)
                toxic = y[lo:hi][row] == 1 if len(row) else row.astype(bool)
                one = np.unique(np.stack([row.astype(np.uint64), h, before, core], axis=1)[toxic], axis=0) if toxic.any() else np.zeros((0, 4), np.uint64)
                pairs = np.unique(np.stack([row.astype(np.uint64), h], axis=1)[~toxic], axis=0)[:, 1] if (~toxic).any() else np.zeros(0, np.uint64)
                other, count = np.unique(pairs, return_counts=True)
                new = np.append(True, (one[1:, :2] != one[:-1, :2]).any(axis=1)) if len(one) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([one[:, 1], other]).view(np.int64)), pa.array(np.concatenate([one[:, 2], np.zeros(len(other), np.uint64)]).view(np.int64)),
                    pa.array(np.concatenate([one[:, 3], np.zeros(len(other), np.uint64)]).view(np.int64)),
                    pa.array(np.concatenate([new, np.zeros(len(other), bool)]).astype(np.int64)), pa.array(np.concatenate([np.zeros(len(one), np.int64), count]))],
                    names=["h", "before", "core", "n1", "n0"])

    by_class = {r["y"]: r["n"] for r in src.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = by_class.get(0, 0), by_class.get(1, 0)
    found = src.select("y", "text").mapInArrow(run, "h long, before long, core long, n1 long, n0 long")
    # the words before a word, once each; documents of other classes have no such pairs
    pairs = found.groupBy("h", "before").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.max("core").alias("core_hi"), F.min("core").alias("core_lo"))
    words = pairs.groupBy("h").agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count(F.when(F.col("n1") > 0, 1)).alias("contexts"),
        F.max(F.when(F.col("core_hi") != 0, F.col("core_hi")).otherwise(F.col("core_lo"))).alias("core"))
    odds = (F.log((F.col("n1") + 0.5) / (n1 - F.col("n1") + 0.5)) - F.log((F.col("n0") + 0.5) / (n0 - F.col("n0") + 0.5)))
    rows = (words.filter(F.col("contexts") >= MIN_CONTEXTS).withColumn("w", odds).filter(F.col("w") >= MIN_LOG_ODDS)
            .orderBy(F.desc(F.col("w") * F.sqrt(F.least("contexts", "n1"))), "h").limit(LEXICON).collect())
    return Lexicon.of(rows)


def with_features(docs: DataFrame, lexicon: Lexicon, text: str, name: str = "__features") -> DataFrame:
    """All columns of ``docs`` and the feature vector."""
    schema = T.StructType([*docs.schema.fields, T.StructField("__x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for lo, hi, raw, offs in br.text_slices(batch.column(at).cast(pa.string())):
                x = featurise(raw, offs, lexicon)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, lists], names=[*batch.schema.names, "__x"])

    out = docs.mapInArrow(run, schema)
    return out.withColumn(name, array_to_vector("__x")).drop("__x")


@dataclass
class Model:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    constant: float

    def score(self, docs: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
        """All columns of ``docs`` and a score in 0 to 1; null texts count as empty, every row gets a score."""
        if self.trees is None:
            return docs.withColumn(score, F.lit(self.constant))
        out = self.trees.transform(with_features(docs, self.lexicon, text))
        out = out.withColumn("__p", vector_to_array("__probability")[1])
        if self.calibration is not None:
            out = self.calibration.transform(out)
            # isotonic steps leave ties; a hundredth of the trees' own probability orders them and keeps the side of one half
            near = 0.99 * F.col("__calibrated") + 0.01 * F.col("__p")
            out = out.withColumn(score, F.when(F.col("__calibrated") >= 0.5, F.greatest(near, F.lit(0.5))).otherwise(F.least(near, F.lit(0.4999999))))
        else:
            out = out.withColumn(score, F.col("__p"))
        return out.select(*[F.col(f"`{c}`") for c in docs.columns], score)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
        sample: int = SAMPLE, use=None) -> Model:
    """The model of the labelled documents whose id satisfies ``use`` (a condition on the id column).

    Null ids and labels are left out, of several labels of one id the highest counts, of several rows the one whose text has the lowest
    hash, so that the sample has at most ``sample`` rows. If a class is missing, every score is
    the share of label 1 (0 without any label).
    """
    ids = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("y")).dropna()
    if use is not None:
        ids = ids.filter(use(F.col("__id")))
    part = F.pmod(F.xxhash64(F.lit(7), F.col("__id")), F.lit(20))
    chosen = (ids.groupBy("__id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
              .withColumn("part", F.when(part < 9, "lexicon").when(part < 16, "trees").otherwise("calibration")))
    src = _labelled(docs, chosen, id_col, text).persist()
    try:
        counts = {(r["part"], r["y"]): r["n"] for r in src.groupBy("part", "y").agg(F.count("*").alias("n")).collect()}
        ones, zeros = (sum(n for (_, y), n in counts.items() if (y == 1) == want) for want in (True, False))
        if not all(counts.get(("trees", y)) for y in (0, 1)):
            return Model(Lexicon.of([]), None, None, ones / (ones + zeros) if ones + zeros else 0.0)
        lexicon = _learn_lexicon(src.filter("part = 'lexicon'").select("y", "text"))
        rows = with_features(src.filter("part != 'lexicon'"), lexicon, "text").select(
            "part", F.col("y").cast("double").alias("y"), "__features", "__id").persist()
        trees = GBTClassifier(featuresCol="__features", labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=11,
                              predictionCol="__class").setRawPredictionCol("__raw").setProbabilityCol("__probability").fit(
            rows.filter("part = 'trees'").select("y", "__features").coalesce(2))
        calibration = None
        if all(counts.get(("calibration", y)) for y in (0, 1)):
            held = trees.transform(rows.filter("part = 'calibration'")).withColumn("__p", vector_to_array("__probability")[1])
            calibration = IsotonicRegression(featuresCol="__p", labelCol="y", predictionCol="__calibrated").fit(held.select("y", "__p"))
        rows.unpersist()
    finally:
        src.unpersist()
    return Model(lexicon, trees, calibration, 0.0)
