"""Readers and sinks.

Readers keep the reference's contract (last column is the label, renamed ``target``;
'-' in names becomes '_'), sinks write with the DataFrame writer. Export folders live
under the session's shared checkpoint folder unless a path is given.
"""

from __future__ import annotations

import os
import re
import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bayesloom.operators.encode import CategoryEncoder, rename_hyphens
from bayesloom.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder (never a machine-local temp dir on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "exports", f"{name}-{uuid.uuid4().hex[:12]}")


def _label_last(df: DataFrame, label_name: str = "target") -> DataFrame:
    df = rename_hyphens(df)
    last = df.columns[-1]
    return df.withColumnRenamed(last, label_name) if last != label_name else df


def read_csv_labelled(spark: SparkSession, path: str | Sequence[str], infer_schema: bool = True) -> DataFrame:
    """CSV with header; last column is the label (renamed ``target``), '-' → '_'."""
    df = spark.read.option("header", True).option("inferSchema", infer_schema).csv(path)
    return _label_last(df)


# one ARFF value: quoted with escapes, or anything up to the next comma
_ARFF_TOKEN = r"""\s*('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^,]*?)\s*(?:,|$)"""


def _unquote(token: str) -> str:
    token = token.strip()
    if len(token) >= 2 and token[0] in "'\"" and token[-1] == token[0]:
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r"}.get(m[1], m[1]), token[1:-1])
    return token


def _parse_arff_header(lines: list[str]):
    attrs = []
    for raw in lines:
        line = raw.strip()
        if not line.lower().startswith("@attribute"):
            continue
        rest = line[len("@attribute"):].strip()
        quoted = re.match(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")""", rest)
        name, spec = (quoted[0], rest[quoted.end():].strip()) if quoted else rest.split(None, 1)
        name = _unquote(name)
        if spec.startswith("{"):
            inner = spec[1:spec.rindex("}")]
            attrs.append((name, "nominal", [_unquote(m[1]) for m in re.finditer(_ARFF_TOKEN, inner) if m[0]]))
        else:
            attrs.append((name, spec.split()[0].lower(), None))
    return attrs


def _arff_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(value, file, at): every line with its place in its file."""
    return spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("at"))


def read_arff(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """ARFF files (same header) → DataFrame; nominal → string (domain kept in column
    metadata), numeric/real/integer → double. ``?`` is null; values may be quoted, with backslash escapes.

    The body of a file is what follows its first line that is ``@data`` alone, in any case (a file without one is all body); blank lines and
    unquoted comments (``%``) in it are skipped, every other line is a row. The header, of any length, is that of the first
    file that has one.
    """
    paths = [path] if isinstance(path, str) else list(path)
    lines = _arff_lines(spark, paths)
    v = F.trim(F.col("value"))
    starts = lines.filter(v.rlike(r"(?i)^@data\s*(%.*)?$")).groupBy("file").agg(F.min("at").alias("start"))
    first = starts.orderBy("file").first()
    if first is None:
        raise ValueError("no @data line in the files")
    end = F.struct(F.lit(first["start"]["block"]).alias("block"), F.lit(first["start"]["id"]).alias("id"))
    head = lines.filter((F.col("file") == first["file"]) & (F.col("at") < end)).orderBy("at").select("value").collect()
    attrs = _parse_arff_header([r["value"] for r in head])
    body = (lines.join(starts, "file", "left").filter(F.col("start").isNull() | (F.col("at") > F.col("start")))
            .filter((F.length(v) > 0) & ~v.startswith("%")))
    tokens = body.select(F.regexp_extract_all(v, F.lit(_ARFF_TOKEN), F.lit(1)).alias("t"))
    cols = []
    for i, (name, kind, domain) in enumerate(attrs):
        raw = F.get(F.col("t"), i)
        text = F.when(raw.rlike("^['\"]"), _unescape(F.substring(raw, F.lit(2), F.length(raw) - 2))).otherwise(raw)
        text = F.when((raw == "?") | (raw == ""), None).otherwise(text)
        if kind not in ("nominal", "string", "date"):
            text = text.cast("double")
        cols.append(text.alias(name.replace("-", "_"), metadata={"arff_domain": domain} if domain else {}))
    return tokens.select(*cols)


def _unescape(c):
    """Backslash escapes of a quoted value."""
    c = F.regexp_replace(c, r"\\\\", "\u0000")
    c = F.regexp_replace(F.regexp_replace(c, r"\\n", "\n"), r"\\r", "\r")
    return F.replace(F.regexp_replace(c, r"\\(.)", "$1"), F.lit("\u0000"), F.lit("\\"))


def _escape(c):
    """A value as an ARFF token: ? for null, quoted if it could be read as anything else."""
    q = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for plain, code in (("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
        q = F.replace(q, F.lit(plain), F.lit(code))
    return F.when(c.isNull(), "?").when(c.rlike(r"""[\s,'"{}%@?\\]|^$"""), F.concat(F.lit("'"), q, F.lit("'"))).otherwise(c)


def drop_label_by_name(df: DataFrame, label: str = "class", new_name: str = "target") -> DataFrame:
    """S3: features = all but ``label``; the label goes last as ``target``."""
    return df.select(*[c for c in df.columns if c != label], F.col(label).alias(new_name))


def load_dataset(spark: SparkSession, name: str, catalog: dict) -> DataFrame | None:
    """Dispatch on the catalog spec: ('csv', path) / ('arff', path, label) / ('table', fn); errors → None."""
    spec = catalog.get(name)
    try:
        if spec is None:
            raise KeyError(name)
        kind = spec[0]
        if kind == "csv":
            return read_csv_labelled(spark, spec[1])
        if kind == "arff":
            return drop_label_by_name(read_arff(spark, spec[1]), spec[2] if len(spec) > 2 else "class")
        if kind == "table":
            return spec[1](spark)
        raise ValueError(f"unknown dataset kind {kind}")
    except Exception as e:  # noqa: BLE001 - reported and skipped, as the reference does
        print(f"dataset {name!r} skipped: {e}")
        return None


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Header CSV (one folder of part files)."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_sample(df: DataFrame, path: str, n: int = 1000, order: str = "row_id") -> str:
    """The first ``n`` synthetic rows by row id (a top-n, not a full sort)."""
    return write_csv(df.orderBy(order).limit(n), path)


def write_results(results: DataFrame, prefix: str) -> list[str]:
    """One CSV per metric family."""
    out = []
    for m in sorted(r[0] for r in results.select("metric").distinct().collect()):
        p = f"{prefix}_{m}"
        write_csv(results.filter(F.col("metric") == m), p)
        out.append(p)
    return out


def append_run_log(spark: SparkSession, path: str, dataset: str, metrics: dict) -> None:
    """Append (dataset, metric, value, ts) rows to a results table."""
    rows = [(dataset, k, float(v) if v is not None else None) for k, v in metrics.items()]
    spark.createDataFrame(rows, "dataset string, metric string, value double") \
        .withColumn("ts", F.current_timestamp()).write.mode("append").parquet(path)


def export_ordinal_matrix(df: DataFrame, columns: Sequence[str], path: str) -> CategoryEncoder:
    """Ordinal-encode the columns and write the integer matrix as parquet."""
    enc = CategoryEncoder.fit(df, list(columns))
    enc.transform(df.select(*columns)).write.mode("overwrite").parquet(path)
    return enc


def write_arff(df: DataFrame, path: str, relation: str, domains: dict | None = None) -> str:
    """Write an ARFF file set (header file + body parts). Columns in ``domains`` are nominal, other strings are ``string``
    attributes; null is ``?``, and values that could be read as anything else are quoted."""
    spark = df.sparkSession
    domains = dict(domains or {})
    def token(value) -> str:
        text = str(value)
        if not text or re.search(r"""[\s,'"{}%@?\\]""", text):
            text = "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"
        return text

    lines = [f"@relation {token(relation)}", ""]
    for f in df.schema.fields:
        if f.name in domains:
            lines.append(f"@attribute {token(f.name)} {{{','.join(token(v) for v in domains[f.name])}}}")
        else:
            lines.append(f"@attribute {token(f.name)} {'string' if isinstance(f.dataType, T.StringType) else 'numeric'}")
    lines += ["", "@data"]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("overwrite").text(path + "/header")
    body = df.select(F.concat_ws(",", *[_escape(F.col(f"`{c}`").cast("string")) for c in df.columns]).alias("value"))
    body.write.mode("overwrite").text(path + "/body")
    return path
