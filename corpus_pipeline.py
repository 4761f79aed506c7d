"""Training-data pipeline: five stages over ``documents``, each an operator of ``bayesloom.llm``.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, written as Parquet in the shared folder and read again
as the next one's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bayesloom.llm import decontaminate, mixing, sharding, simhash_golay, toxicity
from bayesloom.llm.shared import materialise, table

#: SQL cannot express boosted trees, the cube method or the hypergeometric draws; tests compare with brute force
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't call toxic; the model is fitted on the labelled ones among them."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs, score="__score").filter("__score < 0.5").drop("__score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: three-word shingles, three bits."""
    return simhash_golay.keep_one(docs, words=3, max_distance=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at the sources' target weights; a document stands as often as it's taken."""
    return mixing.mixed(docs)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", to_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
