"""Generation.

``spark.range(n, numPartitions)`` makes the rows (batched generation is just the
partitioning); each node is drawn in topological order with a hash uniform of
(row id, node, seed), one size-checked broadcast equi-join on the packed parent configuration and a
search among the ends of its observed values.
No step shuffles the sample, and a re-executed task draws identical rows.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayesloom.functions import hash_uniform_block, pack_codes, probit
from bayesloom.operators.scores import parent_sets
from bayesloom.operators.structure import radix_code_expr, topological_order

#: largest lookup table that is broadcast, and rows of a sampled partition
BROADCAST_BYTES = 64 << 20
PARTITION_ROWS = 2_000_000
#: cards up to which a configuration's ends are stored for every value and compared one by one (two nodes of 80 values take the
#: comparisons over the size of a method that the JVM compiles)
UNROLL_LIMIT = 16


def fits_broadcast(rows: int, doubles: int, cells: int = 0) -> bool:
    """Whether a table of so many rows with a key, an array of ``doubles`` values each, and in all ``cells`` pairs of an int and a
    double, is small enough to broadcast."""
    return rows * (48 + 8 * doubles) + 12 * cells <= BROADCAST_BYTES


def sample_partitions(spark, n: int) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n) // PARTITION_ROWS))


def _pack(parents: Sequence[str], cards: dict):
    return pack_codes([(F.col(p), int(cards[p])) for p in parents])


def interval_tables(cpts: DataFrame, nodes: Sequence[str]) -> dict:
    """(configurations, observed values, most of them in one configuration) of each node's CPT; one aggregation for all nodes."""
    per = cpts.filter(F.col("child").isin(*nodes)).groupBy("child", "pa").agg(F.count(F.lit(1)).alias("m"))
    rows = per.groupBy("child").agg(F.count(F.lit(1)).alias("k"), F.sum("m").alias("cells"), F.max("m").alias("most")).collect()
    return {r["child"]: (int(r["k"]), int(r["cells"]), int(r["most"])) for r in rows}


def interval_lookup(cpts: DataFrame, node: str, parents: Sequence[str], cards: dict) -> DataFrame:
    """(__k, __v array<int>, __e array<double>) per observed parent configuration: its observed values in order and the upper ends
    of their intervals. What a configuration costs follows from the values seen in it, not from the node's card."""
    key = pack_codes([(F.get(F.col("pa"), i), int(cards[p])) for i, p in enumerate(parents)])
    cells = F.array_sort(F.collect_list(F.struct("value", "cum_hi")))
    t = cpts.filter(F.col("child") == node).groupBy(key.alias("__k")).agg(cells.alias("__c"))
    # arrays that can't hold nulls: asking for them would take a sample's generated code over the size that the JVM compiles
    return t.select("__k", F.transform("__c", lambda c: F.coalesce(c["value"], F.lit(0))).alias("__v"),
                    F.transform("__c", lambda c: F.coalesce(c["cum_hi"], F.lit(1.0))).alias("__e"))


def dense_lookup(cpts: DataFrame, node: str, parents: Sequence[str], cards: dict) -> DataFrame:
    """(__k, __e array<double>) for a node of few values: the upper end of every value's interval in order (a value that isn't seen
    repeats the end before it), so the drawn code is the number of ends at or below u."""
    card = int(cards[node])
    looked = interval_lookup(cpts, node, parents, cards)
    at = F.transform(F.sequence(F.lit(0), F.lit(card - 1)), lambda v: F.size(F.filter("__v", lambda x: x <= v)))
    return looked.select("__k", F.transform(at, lambda n: F.coalesce(F.get(F.col("__e"), n - 1), F.lit(0.0))).alias("__e"))


def _draw(ends, u, card: int):
    """Code = number of ends ≤ u; comparisons one after another keep the expression in generated code."""
    terms = [(F.get(ends, i) <= u).cast("int") for i in range(card - 1)]
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0)


def count_below(df: DataFrame, ends, u, most: int, out: str) -> DataFrame:
    """``out``: how many of up to ``most`` ascending ends are at or below ``u``. A search by digits of base 16, each a column of its own
    with 15 comparisons at most, in generated code: one for up to 15 ends, five for a million."""
    stride = 1
    while stride * 16 <= most:
        stride *= 16
    at = F.lit(0)
    while stride:
        hits = [F.when(F.get(ends, at + F.lit(i * stride - 1)) <= u, stride).otherwise(0) for i in range(1, 16) if i * stride <= most]
        df = df.withColumn(out, reduce(lambda a, b: a + b, hits, at))
        at, stride = F.col(out), stride // 16
    return df


def ancestral_sample(spark, cpts: DataFrame, edges, nodes: Sequence[str], cards: dict, n: int, seed=42,
                     num_partitions: int | None = None, key: str = "row_id", streams: dict | None = None) -> DataFrame:
    """N rows drawn parents-first; unseen parent configuration → uniform draw.

    Node i of ``nodes`` takes uniform i % 4 of digest i // 4 under ``seed``, so a row costs one md5 per four nodes;
    ``streams`` (node → (seed, position)) says otherwise, which lets several networks be drawn as one.
    """
    order = topological_order(edges, nodes)
    ps = parent_sets(edges, nodes)
    parts = num_partitions or sample_partitions(spark, n)
    tables = interval_tables(cpts, nodes)
    streams = streams or {node: (seed, i) for i, node in enumerate(nodes)}
    s = spark.range(0, int(n), 1, parts).withColumnRenamed("id", key)
    rid = F.col(key).cast("string")
    s = s.select("*", *[hash_uniform_block(rid, streams[node][1] // 4, streams[node][1] % 4, streams[node][0]).alias(f"__u{i}")
                        for i, node in enumerate(nodes)])
    place = {node: i for i, node in enumerate(nodes)}
    for node in order:
        u, card = F.col(f"__u{place[node]}"), int(cards[node])
        uniform = F.floor(u * F.lit(card)).cast("int")
        configurations, cells, most = tables.get(node, (0, 0, 0))
        small = card <= UNROLL_LIMIT
        look = dense_lookup(cpts, node, ps[node], cards) if small else interval_lookup(cpts, node, ps[node], cards)
        row = look.first() if small and not ps[node] and cells else None
        if row:  # the one configuration of a node without parents: literals, no join
            s = s.withColumn("__e", F.array(*[F.lit(float(e)) for e in row["__e"]]))
        else:
            fits = fits_broadcast(configurations, card) if small else fits_broadcast(configurations, 0, cells)
            look = F.broadcast(look) if fits else look
            s = s.withColumn("__pk", _pack(ps[node], cards)).join(look, F.col("__pk") == F.col("__k"), "left").drop("__pk", "__k")
        # no ends when the configuration is unseen: uniform over the domain
        if small:
            s = s.withColumn(node, F.coalesce(_draw(F.col("__e"), u, card), uniform).cast("int")).drop("__e")
        else:
            s = count_below(s, F.col("__e"), u, most - 1, "__at")  # the last end is 1
            s = s.withColumn(node, F.coalesce(F.get(F.col("__v"), F.col("__at")), uniform).cast("int")).drop("__v", "__e", "__at")
    return s.select(key, *nodes)


def sample(spark, cpts, edges, nodes, cards, n, encoder=None, seed=42, key="row_id", **kw) -> DataFrame:
    """Ancestral sample decoded back to original values (P3) when an encoder is given."""
    s = ancestral_sample(spark, cpts, edges, nodes, cards, n, seed, key=key, **kw)
    return encoder.inverse(s) if encoder is not None else s


def gaussian_nb_sample(spark, model, n: int, seed=42, num_partitions: int | None = None, key: str = "row_id") -> DataFrame:
    """Y from the prior's cumulative intervals, each feature ~ N(mean, var) given y."""
    parts = num_partitions or sample_partitions(spark, n)
    classes = model.classes
    # cumulative prior from integer counts: exact interval ends, last one is 1.0
    cum, acc = [], 0
    total = sum(model.counts[c] for c in classes)
    for c in classes:
        acc += model.counts[c]
        cum.append(acc / total)
    s = spark.range(0, int(n), 1, parts).withColumnRenamed("id", key)
    # uniforms: slot i of digest i // 4 for the columns (features…, label); one md5 per four columns
    cols = list(model.features) + [model.label]
    rid = F.col(key).cast("string")
    s = s.select("*", *[hash_uniform_block(rid, i // 4, i % 4, seed).alias(f"__u{i}") for i in range(len(cols))])
    u = F.col(f"__u{len(cols) - 1}")
    idx = None
    for c in cum[:-1]:
        term = (F.lit(c) <= u).cast("int")
        idx = term if idx is None else idx + term
    s = s.withColumn("__i", (idx if idx is not None else F.lit(0)).cast("int"))
    s = s.withColumns({f"__z{i}": probit(F.col(f"__u{i}")) for i in range(len(model.features))})
    out = [F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("__i") + 1).alias(model.label)]
    for i, f in enumerate(model.features):
        mu = F.element_at(F.array(*[F.lit(model.mean[c][f]) for c in classes]), F.col("__i") + 1)
        sd = F.element_at(F.array(*[F.lit(model.var[c][f] ** 0.5) for c in classes]), F.col("__i") + 1)
        out.append((mu + sd * F.col(f"__z{i}")).alias(f))
    return s.select(key, *out)


def union_labelled(real: DataFrame, syn: DataFrame, flag: str = "is_real") -> DataFrame:
    """Real rows (1) stacked on synthetic rows (0)."""
    cols = [c for c in real.columns if c in syn.columns]
    return real.select(*cols, F.lit(1).alias(flag)).unionByName(syn.select(*cols, F.lit(0).alias(flag)))
