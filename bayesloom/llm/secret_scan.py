"""Secret scans: a random forest removes false positives among candidate strings.

Candidates are runs of eight or more key characters that hold a digit or change case inside, each run of a word for itself, and whatever is
assigned to a credential's name, in the word (``"name":"value"``, ``?name=value``) or with blanks around the sign. Features of a candidate:
length and character classes, transitions between classes, how usual its letter pairs are (pair frequencies of the corpus dictionary), the
share of it that dictionary words cover, its path, and the words around it.
The dictionary are the words that the whole corpus has at least ``MIN_COUNT`` times.

All steps are DataFrame functions and Spark ML: no Python runs on the executors. The forest learns from labelled findings; a sample of
at most ``SAMPLE`` of them is used, chosen by hash.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayesloom.llm.shared import materialise

SAMPLE = 20_000
MIN_COUNT = 3
TREES, DEPTH = 30, 6
SPACE = r"[\x20\x09-\x0D]+"
CORE = r"[A-Za-z0-9+/_=.@-]{8,}"
SIGN = r"(?:=>|:=|==?|:)"
# fixed values: names that credentials are assigned to, paths of examples, and forms of findings that are no secrets
NAMES = r"(?i)(token|secret|passw(or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer)"
EXAMPLE_PATH = r"(?i)(test|example|sample|fixture|mock|docs?)"
OTHER_FORMS = (r"^[^@]+@[^@]+\.[A-Za-z]{2,}$", r"^\d{1,3}(\.\d{1,3}){3}$", r"^\+?[\d.-]+$", r"^[A-Za-z]+(-[A-Za-z]+)*\.?$", r"(?i)(example|placeholder|changeme|xxxx)")
_NAMED = r"(?<=" + NAMES.replace("(?i)", "(?i:") + r")[A-Za-z0-9_-]{0,16}[\\\"'`]{0,2}" + SIGN
# runs of a word: a value assigned to a credential's name, up to its quote or the next separator; else key characters, with = only as padding
RUN = (_NAMED + r"\\?[\"'`])[^\"'`\\]+|" + _NAMED + r")[^\"'`\\&,;{}()\[\]<>=:|#][^\"'`\\&,;{}()\[\]<>|]*"
       r"|[A-Za-z0-9+/_.@-]+(?:={1,2}(?=$|[,;&)}\]:]|\\?[\"'`](?![A-Za-z0-9+/_.@-])))?")
ASSIGNED = r"^[\\\"'`)\]]*(" + SIGN + r")[\\\"'`({\[<]*$"
_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"

FEATURES = ("f_length", "f_digits", "f_upper", "f_hex", "f_other", "f_distinct", "f_class_changes", "f_pairs", "f_dictionary", "f_example_path", "f_path_digits",
            "f_named", "f_assigned", "f_quoted", "f_before_length", "f_after_length", "f_after_word")


def candidates(docs: DataFrame, carry: list[str], text: str = "text", path: str | None = "source") -> DataFrame:
    """One row per candidate: ``carry``, ``path`` (null: empty), ``place`` (number of the word in the text), ``run`` (its number in the word), ``word``
    (the run and the signs about it), ``core`` and what is around: names and runs of the same word, else the words before and after."""
    has = F.col("__text").rlike(CORE) | F.col("__text").rlike(NAMES)
    kept = [F.col(f"`{c}`") for c in carry]
    src = docs.select(*kept, (F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path else F.lit("")).alias("path"),
                      F.col(f"`{text}`").cast("string").alias("__text")).filter(has)
    key = lambda c: c.rlike("[0-9]") | c.rlike("[a-z][A-Z]")
    told = lambda name, sign: sign.rlike("^(=|:|:=|=>)$") & name.rlike(NAMES)

    def wanted(w: Column, name: Column, sign: Column) -> Column:
        return (w.rlike(CORE) & key(w)) | told(name, sign) | w.rlike(NAMES + r"[^=:]*[=:].")

    words = F.split(F.trim(F.regexp_replace("__text", SPACE, " ")), " ")
    src = src.select("*", words.alias("__words")).drop("__text")
    at = lambda i: F.coalesce(F.get(F.col("__words"), i), F.lit(""))
    found = F.filter(
        F.transform("__words", lambda w, i: F.when(w.rlike("[0-9A-Z=:]") | at(i - 1).rlike("^(=|:|:=|=>)$"), F.struct(
            i.alias("place"), w.alias("word"), at(i - 2).alias("before2"), at(i - 1).alias("before1"), at(i + 1).alias("after1")))),
        lambda s: s.isNotNull() & wanted(s["word"], s["before2"], s["before1"]))
    rows = src.select(*kept, "path", F.explode(found).alias("s")).select(*kept, "path", "s.*")
    # a word that is assigned with blanks is read as token:word, so its runs are found as those of glued words; run 0 is then that name
    rows = rows.withColumn("__told", told(F.col("before2"), F.col("before1")))
    rows = rows.withColumn("__word", F.when(F.col("__told"), F.concat(F.lit("token:"), "word")).otherwise(F.col("word")))
    rows = rows.withColumn("__runs", F.regexp_extract_all("__word", F.lit(RUN), F.lit(0))).withColumn("__signs", F.split("__word", RUN, -1))

    def one(core: Column, i: Column) -> Column:
        first = F.when(F.col("__told"), i == 1).otherwise(i == 0)
        run = lambda k: F.coalesce(F.when(F.col("__told") & (k == 0), F.col("before2")).otherwise(F.get(F.col("__runs"), k)), F.lit(""))
        signs = F.get(F.col("__signs"), i)
        sign = F.regexp_extract(signs, ASSIGNED, 1)
        name = F.when(sign != "", run(i - 1)).otherwise(run(i - 2))
        whole = F.when(signs == "=", F.concat(run(i - 1), signs, core)).otherwise(core)
        return F.when(~(F.col("__told") & (i == 0)) & ((whole.rlike(CORE) & key(whole)) | (first & F.col("__told")) | ((sign != "") & run(i - 1).rlike(NAMES))), F.struct(
            F.when(F.col("__told"), i - 1).otherwise(i).alias("run"),
            F.concat(F.when(first & F.col("__told"), F.substr(signs, F.lit(2))).otherwise(signs), core, F.get(F.col("__signs"), i + 1)).alias("word"),
            F.when(first, F.col("before2")).otherwise(name).alias("before2"),
            F.when(first, F.col("before1")).when(sign != "", sign).otherwise(run(i - 1)).alias("before1"),
            F.coalesce(F.get(F.col("__runs"), i + 1), F.col("after1")).alias("after1"), core.alias("core")))

    each = F.filter(F.transform("__runs", one), lambda s: s.isNotNull())
    return rows.select(*kept, "path", "place", F.explode(each).alias("s")).select(*kept, "path", "place", "s.*")


def dictionary(docs: DataFrame, text: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(piece, n): runs of three to 24 letters that all texts together hold at least ``min_count`` times."""
    pieces = F.split(F.lower(F.col(f"`{text}`").cast("string")), r"[^\p{L}]+")
    return (docs.select(F.explode(pieces).alias("piece")).filter(F.length("piece").between(3, 24))
            .groupBy("piece").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count))


def pair_costs(words: DataFrame) -> list[float]:
    """Negative logarithms of the share of each sign after each sign (36 x 36, add one half) over the dictionary."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("piece") - 1), lambda i: F.substr("piece", i, F.lit(2))))
    rows = words.select(pair.alias("p")).filter(F.col("p").rlike("^[a-z]{2}$")).groupBy("p").count().collect()  # at most 26 * 26
    n = {r["p"]: r["count"] for r in rows}
    after = {a: sum(n.get(a + b, 0) for b in _SIGNS) for a in _SIGNS}
    return [-math.log((n.get(a + b, 0) + 0.5) / (after[a] + 0.5 * len(_SIGNS))) for a in _SIGNS for b in _SIGNS]


def featurise(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the feature columns."""
    costs = F.array(*[F.lit(x) for x in pair_costs(words)])
    small = F.regexp_replace(F.lower("core"), "[^a-z0-9]", "")
    place = lambda i: F.instr(F.lit(_SIGNS), F.substr("__small", i, F.lit(1)))
    cost = F.aggregate(F.sequence(F.lit(1), F.length("__small") - 1), F.lit(0.0),
                       lambda acc, i: acc + F.element_at("__costs", ((place(i) - 1) * len(_SIGNS) + place(i + 1)).cast("int")))
    cores = found.select("core").distinct()
    covered = (cores.select("core", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("core"), F.lit(r"(\p{L}{3,24})"), F.lit(1)))).alias("piece"))
               .join(words.select("piece"), "piece").groupBy("core").agg(F.sum(F.length("piece")).alias("__covered")))
    size = F.greatest(F.length("core"), F.lit(1))
    count = lambda pattern: F.regexp_count("core", F.lit(pattern))
    known = cores.join(covered, "core", "left").withColumn("__small", small).withColumn("__costs", costs)
    known = known.select(
        "core", F.length("core").cast("double").alias("f_length"), (count("[0-9]") / size).alias("f_digits"), (count("[A-Z]") / size).alias("f_upper"),
        F.col("core").rlike("^[0-9a-fA-F]+$").cast("double").alias("f_hex"), (count("[^A-Za-z0-9]") / size).alias("f_other"),
        (F.size(F.array_distinct(F.split("core", ""))) / size).alias("f_distinct"),
        (count("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / size).alias("f_class_changes"),
        F.when(F.length("__small") > 1, cost / (F.length("__small") - 1)).otherwise(0.0).alias("f_pairs"),
        (F.coalesce("__covered", F.lit(0)) / size).alias("f_dictionary"))
    named = F.col("before2").rlike(NAMES) | F.col("before1").rlike(NAMES) | F.col("word").rlike(NAMES)
    assigned = F.col("before1").rlike("[=:]>?$") | F.col("word").rlike("[=:][\"']?" + CORE)
    around = found.select(
        "*", F.col("path").rlike(EXAMPLE_PATH).cast("double").alias("f_example_path"), F.col("path").rlike("[0-9]").cast("double").alias("f_path_digits"),
        named.cast("double").alias("f_named"), assigned.cast("double").alias("f_assigned"),
        F.col("word").rlike("[\"'`].+[\"'`]").cast("double").alias("f_quoted"), F.length("before1").cast("double").alias("f_before_length"),
        F.length("after1").cast("double").alias("f_after_length"), F.col("after1").rlike(r"^\p{L}+[.,]?$").cast("double").alias("f_after_word"))
    return around.join(known, "core")


def format_labels(found: DataFrame) -> DataFrame:
    """``found`` with ``label`` by verifiable form, for corpora without reviewed findings: 1 for key material assigned to a credential's name, 0 for
    addresses, numbers, plain words and placeholders, else null."""
    other = F.lit(False)
    for form in OTHER_FORMS:
        other = other | F.col("core").rlike(form)
    named = F.col("before2").rlike(NAMES) & F.col("before1").rlike("^(=|:|:=|=>)$")
    return found.withColumn("label", F.when(other, 0).when(named & F.col("core").rlike("[0-9]") & (F.length("core") >= 16), 1))


def scan(docs: DataFrame, carry: list[str], text: str = "text", path: str | None = "source", labelled=format_labels, sample: int = SAMPLE) -> DataFrame:
    """All candidates: ``carry``, ``place``, ``run``, ``finding``, ``probability`` of a secret and ``is_secret`` (at least one half).

    ``labelled`` maps candidates to candidates with a ``label`` (1 secret, 0 false positive, null unknown), such as a join with reviewed findings.
    Null and empty texts have no candidates, repeated rows each theirs. If one of the classes is missing, the probability is the share of
    label 1 (one half without any label). An empty table gives an empty result.
    """
    words = materialise(dictionary(docs, text))
    found = materialise(featurise(materialise(candidates(docs, carry, text, path)), words))
    rows = labelled(found).filter("label is not null")
    train = (rows.select(F.col("label").cast("double").alias("label"), *FEATURES, F.xxhash64("core", "path", "place", "run", "before1", "after1").alias("u"))
             .orderBy("u", *FEATURES).limit(sample).drop("u").persist())
    classes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    columns = [*[F.col(f"`{c}`") for c in carry], "place", "run", F.col("core").alias("finding")]
    if len(classes) < 2:
        train.unpersist()
        share = classes.get(1.0, 0) / sum(classes.values()) if classes else 0.5
        return found.select(*columns, F.lit(share).alias("probability"), F.lit(share >= 0.5).alias("is_secret"))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="__x")
    forest = RandomForestClassifier(featuresCol="__x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=3, predictionCol="__class",
                                    probabilityCol="__probability", rawPredictionCol="__raw").fit(vectors.transform(train))
    train.unpersist()
    out = forest.transform(vectors.transform(found)).withColumn("probability", vector_to_array("__probability")[1])
    return out.select(*columns, "probability", (F.col("probability") >= 0.5).alias("is_secret"))
