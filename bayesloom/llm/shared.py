"""Intermediate tables in the cluster's shared folder, and connected components over edge tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bayesloom.session import ensure_checkpoint_dir


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: one computation, no lineage, no executor holds the only copy."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_shared_path"] = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by ``materialise`` that nothing reads any more."""
    path = df.__dict__.get("_shared_path")
    if path:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected link table: (node, root), root the smallest node of the component.

    Alternating large-star and small-star steps, each an aggregation with partial sums, until a step
    changes nothing; the number of steps follows the logarithm of the longest chain. Self links and
    repeated links are harmless; nodes without a link to another node don't appear.
    """
    edges = materialise(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").filter("u != v").distinct())
        after = materialise(small)
        same = _signature(edges) == _signature(after)
        release(edges)
        edges = after
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
                    F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
    return tuple(row)


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns named c0, c1, .., so that no name of theirs meets one of an operator's own; and the old names."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), docs.columns


def renamed(names: list[str], skip: tuple[str, ...] = ()) -> list:
    """Columns c0, c1, .. under their old names, but for those in ``skip``."""
    return [F.col(f"c{i}").alias(name) for i, name in enumerate(names) if name not in skip]


def row_key(docs: DataFrame) -> list:
    """Columns ``__key1``, ``__key2``: 128 bits that tell rows with different values apart, in which columns are null too.

    Nested columns go in as JSON with its nulls, maps by sorted entries where their values have an order.
    """
    parts = []
    for field in docs.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            inner = c
            if isinstance(field.dataType, T.MapType) and isinstance(field.dataType.valueType, T.AtomicType):
                inner = F.array_sort(F.map_entries(c))
            c = F.when(c.isNotNull(), F.to_json(F.struct(inner), {"ignoreNullFields": "false"}))
        parts += [c.isNull(), c]
    return [F.xxhash64(*parts).alias("__key1"), F.xxhash64(F.lit(1), *parts).alias("__key2")]


def one_text_per_id(docs: DataFrame, chosen: DataFrame, id_col: str, text: str) -> DataFrame:
    """(__id, text, the columns of ``chosen``) of the documents whose id is in the bounded table ``chosen`` (__id, ..), one row per id.

    Of several rows of an id the one whose text has the lowest hash stays: found on numbers, then equal texts are folded
    before they're shuffled, so an id may hold any share of the rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("__h", F.xxhash64("text"))
    rows = rows.join(F.broadcast(chosen), "__id")
    lowest = rows.groupBy("__id").agg(F.min("__h").alias("__low"))
    same = rows.join(F.broadcast(lowest), "__id").filter("__h = __low").drop("__h", "__low")
    return same.dropDuplicates(["__id"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
