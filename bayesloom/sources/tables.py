"""Discrete model views of the driver tables (FIXTURES §6).

Each view is (row_key string, int code features…, target int): numeric columns are
binned into 5 equal-width bins (P5), string columns get sorted-dictionary codes (P1).
Only the needed columns are read (the projection reaches the parquet scan).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayesloom.operators.discretise import UniformBins
from bayesloom.operators.encode import CategoryEncoder


@dataclass
class ModelView:
    name: str
    df: DataFrame
    features: list
    label: str
    bins: UniformBins
    encoder: CategoryEncoder
    raw: DataFrame

    @property
    def nodes(self) -> list:
        return list(self.features) + [self.label]

    def cards(self) -> dict:
        """Domain sizes: 5 per binned column (all bins), dictionary size per coded column."""
        spec = SPEC[self.name]
        out = {}
        for c in self.nodes:
            if c in spec["binned"]:
                out[c] = self.bins.n_bins
            elif c == self.label:
                out[c] = self.encoder.card(spec["label"][1])
            else:
                out[c] = self.encoder.card(spec["coded"][c])
        return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# name → raw select, binned columns (new name → source), coded columns (new name → source), label
SPEC = {
    "li": {
        "key": "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)",
        "binned": {"qty_b": "l_quantity", "price_b": "l_extendedprice", "disc_b": "l_discount", "tax_b": "l_tax"},
        "coded": {"status": "l_linestatus"},
        "label": ("target", "l_returnflag"),
    },
    "ord": {
        "key": "CAST(o_orderkey AS STRING)",
        "binned": {"price_b": "o_totalprice"},
        "coded": {"priority": "o_orderpriority"},
        "label": ("target", "o_orderstatus"),
    },
    "ev": {
        "key": "CAST(event_id AS STRING)",
        "binned": {"value_b": "value"},
        "coded": {"hour": "ev_hour"},
        "label": ("target", "event_type"),
    },
    "prt": {
        "key": "CAST(p_partkey AS STRING)",
        "binned": {"size_b": "p_size", "price_b": "p_retailprice"},
        "coded": {"brand": "p_brand"},
        "label": ("target", "p_type"),
    },
    "cust": {
        "key": "CAST(c_custkey AS STRING)",
        "binned": {"acctbal_b": "c_acctbal"},
        "coded": {"nation": "n_name", "region": "r_name"},
        "label": ("target", "c_mktsegment"),
    },
    "doc": {
        "key": "CAST(doc_id AS STRING)",
        "binned": {"n_chars_b": "n_chars"},
        "coded": {"lang": "lang", "source": "source"},
        "label": ("target", "quality"),
    },
}


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The source rows of a view, with derived source columns (hour, joins)."""
    if name == "li":
        return read(spark, sf_dir, "lineitem")
    if name == "ord":
        return read(spark, sf_dir, "orders")
    if name == "ev":
        return read(spark, sf_dir, "events").withColumn("ev_hour", F.hour("ts"))
    if name == "prt":
        return read(spark, sf_dir, "part")
    if name == "cust":
        # nation (25 rows) and region (5 rows) are dimension tables of fixed size
        nat = read(spark, sf_dir, "nation")
        reg = read(spark, sf_dir, "region")
        dim = nat.join(F.broadcast(reg), nat.n_regionkey == reg.r_regionkey).select("n_nationkey", "n_name", "r_name")
        cust = read(spark, sf_dir, "customer")
        return cust.join(F.broadcast(dim), cust.c_nationkey == dim.n_nationkey)
    if name == "doc":
        docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
        return docs.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    raise KeyError(name)


def model_view(spark: SparkSession, sf_dir: str, name: str = "li") -> ModelView:
    """Fit the encoders on the whole table and return the coded view."""
    spec = SPEC[name]
    raw = raw_table(spark, sf_dir, name)
    label, label_src = spec["label"]
    binned, coded = spec["binned"], spec["coded"]
    sel = raw.select(F.expr(spec["key"]).alias("row_key"), *set(binned.values()), *set(coded.values()), label_src)
    cat_cols = list(coded.values()) + [label_src]
    # one scan for the bin ranges, one for the dictionaries
    stats = sel.agg(*UniformBins.stat_aggs(list(binned.values()))).first()
    bins = UniformBins.fit(sel, list(binned.values()), stats=stats)
    enc = CategoryEncoder.fit(sel, cat_cols)
    coded_df = enc.transform(bins.transform(sel, suffix="__b"))
    out = coded_df.select(
        "row_key",
        *[F.col(src + "__b").alias(new) for new, src in binned.items()],
        *[F.col(src).alias(new) for new, src in coded.items()],
        F.col(label_src).alias(label),
    )
    feats = list(binned) + list(coded)
    return ModelView(name, out, feats, label, bins, enc, raw)
