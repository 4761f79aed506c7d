"""Encoding, scaling and cleaning operators.

Per-column moments live on the driver; dictionaries are tables, and encoding and decoding are joins with them
(broadcast by Spark while they are small).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bayesloom.session import cached, written

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def column_kinds(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric columns, categorical columns) from the schema."""
    num = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    cat = [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
    return num, cat


def rename_hyphens(df: DataFrame) -> DataFrame:
    """P14: '-' → '_' in column names."""
    return df.toDF(*[c.replace("-", "_") for c in df.columns])


def split_label(df: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Label by name, else the last column; returns (features, label, label name)."""
    name = target if target and target in df.columns else df.columns[-1]
    return df.drop(name), df.select(name), name


def align_columns(syn: DataFrame, real: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables in the real table's column order; on mismatch keep the shared columns."""
    shared = [c for c in real.columns if c in syn.columns]
    return syn.select(*shared), real.select(*shared)


def null_audit(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null count per column (one aggregation, long output)."""
    cols = cols or df.columns
    agg = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return agg.select(F.expr(f"stack({len(cols)}, {stack}) as (column, n_null)"))


def drop_null_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows with any null."""
    return df.na.drop(subset=cols)


def infer_discrete_columns(df: DataFrame, cols: list[str] | None = None, max_distinct: int = 10) -> DataFrame:
    """A column is discrete if it is not numeric or has fewer than ``max_distinct`` values.

    Exact distinct counts in one aggregation (each is a partial + final hash aggregate).
    """
    cols = cols or df.columns
    agg = df.agg(*[F.countDistinct(F.col(c)).alias(c) for c in cols])
    kinds = {f.name: is_numeric(f.dataType) for f in df.schema.fields}
    stack = ", ".join(f"'{c}', `{c}`, {str(kinds[c]).lower()}" for c in cols)
    out = agg.select(F.expr(f"stack({len(cols)}, {stack}) as (column, n_distinct, is_numeric)"))
    return out.withColumn("is_discrete", (~F.col("is_numeric")) | (F.col("n_distinct") < max_distinct))


def feature_cards(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct values per column, long (column, card)."""
    agg = df.agg(*[F.countDistinct(F.col(c)).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return agg.select(F.expr(f"stack({len(cols)}, {stack}) as (column, card)"))


def class_counts(df: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """Label frequencies (class, n) and share."""
    n = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    counts = df.groupBy(label).agg(n.cast("long").alias("n"))
    total = df.agg(n.alias("t")).first()["t"] or 0
    return counts.withColumn("share", F.col("n") / F.lit(float(total) if total else 1.0))


def bind_columns(x: DataFrame, y: DataFrame, key: str = "row_key") -> DataFrame:
    """P20: put label next to features by key (the only join shape of the reference)."""
    return x.join(y, on=key, how="inner")


# ---------------------------------------------------------------- category dictionaries


def ranked(values: DataFrame, group: str, order: list[str], rank: str) -> tuple[DataFrame, dict[int, int]]:
    """``values`` (different rows; ``group`` an int) with their rank 0, 1, .. by ``order`` in their group, and the groups' sizes.

    Rows are range-partitioned by (group, order); what reaches the driver is a count per part and group. No group has to fit
    a task. The result is a written table."""
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cached(values.repartitionByRange(parts, group, *order).withColumn("part", F.spark_partition_id()))
    counts = sorted(tuple(r) for r in placed.groupBy(group, "part").count().collect())
    offsets, sizes = [], {}
    for g, part, n in counts:
        offsets.append((g, part, sizes.get(g, 0)))
        sizes[g] = sizes.get(g, 0) + n
    start = values.sparkSession.createDataFrame(offsets, f"{group} int, part int, start int")
    within = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order))
    book = written(placed.join(start, [group, "part"]).withColumn(rank, F.col("start") + within - 1).drop("part", "start"))
    placed.unpersist()
    return book, sizes


@dataclass
class CategoryEncoder:
    """code = rank of the value among the sorted distinct values (0..k-1).

    The dictionaries of all columns are one table (col, value as text, code), made by a distinct and a rank over range
    partitions; encoding and decoding are joins with it (Spark broadcasts it while it's small), so the number of
    categories is not bounded by the driver or by one task.
    """

    columns: list[str]
    book: DataFrame | None = None
    cards: dict[str, int] = field(default_factory=dict)
    dtypes: dict[str, T.DataType] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> "CategoryEncoder":
        dtypes = {f.name: f.dataType for f in df.schema.fields if f.name in columns}
        if not columns:
            return cls([], None, {}, {})

        def entry(i: int, c: str) -> Column:
            # whole numbers and decimals are ordered exactly, floats (and decimals of more than nine places) as doubles
            kind = dtypes[c]
            exact = isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale <= 9 and kind.precision - kind.scale <= 29
            number = F.col(f"`{c}`") if is_numeric(kind) else F.lit(None)
            at, real = (number if exact else F.lit(None)).cast("decimal(38,9)"), (F.lit(None) if exact else number).cast("double")
            return F.struct(F.lit(i).alias("col"), at.alias("at"), real.alias("real"), F.col(f"`{c}`").cast("string").alias("value"))

        values = (df.select(F.inline(F.array(*[entry(i, c) for i, c in enumerate(columns)])))
                  .filter("value is not null").distinct())
        book, sizes = ranked(values, "col", ["at", "real", "value"], "code")
        cards = {c: sizes.get(i, 0) for i, c in enumerate(columns)}
        book = book.select("col", "value", "code")
        return cls(list(columns), book, cards, dtypes)

    @property
    def categories(self) -> dict[str, list]:
        """The sorted values of every column, on the driver: for columns known to have few."""
        out = {}
        for i, c in enumerate(self.columns):
            rows = self.book.filter(F.col("col") == i).orderBy("code").select(F.col("value").cast(self.dtypes[c])).collect()
            out[c] = [r[0] for r in rows]
        return out

    def card(self, col: str) -> int:
        return self.cards[col]

    def _page(self, i: int) -> DataFrame:
        return self.book.filter(F.col("col") == i).select(F.col("value").alias("__v"), F.col("code").alias("__code"))

    def transform(self, df: DataFrame, unknown: int = -1, suffix: str = "") -> DataFrame:
        """Values → int codes; unseen values → ``unknown``; nulls stay null."""
        for i, c in enumerate(self.columns):
            value = F.col(f"`{c}`")
            code = F.when(value.isNotNull(), F.coalesce("__code", F.lit(unknown))).cast("int")
            df = (df.join(self._page(i), value.cast(self.dtypes[c]).cast("string") == F.col("__v"), "left")
                  .withColumn(c + suffix, code).drop("__v", "__code"))
        return df

    def inverse(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Codes → original values (unknown codes → null)."""
        for i, c in enumerate(self.columns):
            df = (df.join(self._page(i), F.col(f"`{c}`").cast("int") == F.col("__code"), "left")
                  .withColumn(c + suffix, F.col("__v").cast(self.dtypes[c])).drop("__v", "__code"))
        return df

    def dictionary(self, spark) -> DataFrame:
        """Dictionary as a DataFrame (column, value, code); values rendered as strings."""
        names = spark.createDataFrame(list(enumerate(self.columns)), "col int, column string")
        return self.book.join(F.broadcast(names), "col").select("column", "value", "code")


def label_encode(df: DataFrame, columns: list[str]) -> tuple[DataFrame, CategoryEncoder]:
    """Fit and apply in one call."""
    enc = CategoryEncoder.fit(df, columns)
    return enc.transform(df), enc


# ---------------------------------------------------------------- scaling


@dataclass
class StandardScaler:
    """(x − mean) / population std (the reference's scaler); std 0 → 1."""

    columns: list[str]
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> "StandardScaler":
        aggs = []
        for c in columns:
            aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
        row = df.agg(*aggs).first()
        return cls(columns, {c: row[f"m_{c}"] for c in columns},
                   {c: (row[f"s_{c}"] or 1.0) or 1.0 for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(self.mean[c])) / F.lit(self.std[c]) for c in self.columns})


@dataclass
class MinMaxScaler:
    """X → (x − min)/(max − min) and back; constant column → 0; nulls stay null (a column of nulls too)."""

    columns: list[str]
    lo: dict[str, float] = field(default_factory=dict)
    hi: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> "MinMaxScaler":
        aggs = []
        for c in columns:
            aggs += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
        row = df.agg(*aggs).first()
        return cls(columns, {c: float(row[f"lo_{c}"] or 0.0) for c in columns}, {c: float(row[f"hi_{c}"] or 0.0) for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c in self.columns:
            span = self.hi[c] - self.lo[c]
            out[c] = F.when(F.col(c).isNotNull(), F.lit(0.0)) if span == 0 else (F.col(c) - F.lit(self.lo[c])) / F.lit(span)
        return df.withColumns(out)

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(self.hi[c] - self.lo[c]) + F.lit(self.lo[c]) for c in self.columns})


# ---------------------------------------------------------------- one-hot


def onehot(df: DataFrame, columns: list[str], encoder: CategoryEncoder, out_col: str = "features") -> DataFrame:
    """P10: one sparse vector over all columns' categories; unknown values → all-zero slot.

    Built with the ML ``OneHotEncoder`` on codes where unknown (−1) is moved to the
    dropped last slot, so it encodes to zeros, as ``handle_unknown='ignore'`` does.
    """
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    coded = encoder.transform(df.select(*[c for c in df.columns]), suffix="__code")
    idx_cols = []
    for c in columns:
        k = encoder.card(c)
        coded = coded.withColumn(c + "__idx", F.when(F.col(c + "__code") < 0, k).otherwise(F.col(c + "__code")).cast("double"))
        idx_cols.append(c + "__idx")
    ohe = OneHotEncoder(inputCols=idx_cols, outputCols=[c + "__vec" for c in columns], dropLast=True,
                        handleInvalid="keep")
    # fit on the category list itself (sizes come from the encoder, not from the data):
    # k categories; the unknown index k is "invalid", kept in the extra slot and dropped
    spark = df.sparkSession
    domain = spark.createDataFrame([tuple(float(max(encoder.card(c) - 1, 0)) for c in columns)], idx_cols)
    model = ohe.fit(domain)
    out = model.transform(coded)
    out = VectorAssembler(inputCols=[c + "__vec" for c in columns], outputCol=out_col).transform(out)
    drop = [c + s for c in columns for s in ("__code", "__idx", "__vec")]
    return out.drop(*drop)


def onehot_long(df: DataFrame, key: str, columns: list[str], encoder: CategoryEncoder) -> DataFrame:
    """P10 in long form: (key, slot) for each active one-hot slot; unknown values emit nothing."""
    offsets, off = {}, 0
    for c in columns:
        offsets[c] = off
        off += encoder.card(c)
    coded = encoder.transform(df.select(key, *columns))
    parts = ", ".join(f"'{c}', `{c}` + {offsets[c]}, `{c}`" for c in columns)
    long = coded.select(key, F.expr(f"stack({len(columns)}, {parts}) as (column, slot, code)"))
    return long.filter(F.col("code") >= 0).drop("code")


def category_union(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Sorted distinct values of both tables per column, long (column, value)."""
    def long(df):
        parts = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
        return df.select(F.expr(f"stack({len(columns)}, {parts}) as (column, value)"))
    return long(a).unionByName(long(b)).distinct()
