"""Registered queries of the operators in this subpackage: callables (spark, sf_dir) and, where SQL can say it, oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayesloom.llm import alignment, conversation_repair, ctw, decontaminate, mixing, packing, quality_crf, secret_scan, sharding, simhash_golay, suffix_dedup, token_counts, toxicity
from bayesloom.llm.shared import table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def held_out(parts: int):
    """Whether crc32 of the id as text is divisible by ``parts``; a null id is not held out."""
    return lambda id_: F.coalesce(F.crc32(id_.cast("string")) % parts == 0, F.lit(False))


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), ["doc_id"])


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), ["doc_id"]).drop("spans")


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(5)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), use=lambda id_: ~out(id_))
    return model.score(docs.select("doc_id", "text")).select(
        "doc_id", out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(10)(F.col("doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", out.alias("held_out"), "text")
    return ctw.score(docs, ["doc_id", "held_out"], ~F.col("held_out"))


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", "size", "source_size", "target", "taken", "times")


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])


@query
def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = quality_crf.fit(docs, table(spark, sf_dir, "labels"))
    return quality_crf.judge(docs, chain, ["doc_id"])


@query
def op10_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = simhash_golay.near_duplicates(docs, ["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], keep="sha256")
    return found.withColumnRenamed("groups", "groups_sha256")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(rows), rows).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


#: one step of a recursion takes all conversations from their row n to n - 1: for each of the four states the cheapest rest
#: is one string of cost, audit and repaired lines, so that the least string is the cheapest and then the ASCII-least one
_STATES = (0, 1, 2, 3)
_NEXT, _NEXT_ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")


def _edit(cost: str, edit: str, after: str, line: str | None) -> str:
    """The rest ``after`` with an edit before it."""
    lines = f"substr({after}, strpos({after}, chr(1)) + 1)"
    if line is not None:
        lines = f"{line} || CASE WHEN {lines} = '' THEN '' ELSE chr(10) || {lines} END"
    return (f"lpad((substr({after}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || '{edit}' || "
            f"substr({after}, 13, strpos({after}, chr(1)) - 13) || chr(1) || {lines}")


def _conversation_oracle() -> str:
    moved = []
    for q in _STATES:
        keep = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[q]
        options = [_edit("4", "D", f"r{q}", None)]
        options.append(f"CASE WHEN fault IN ('blank', 'duplicate') THEN NULL ELSE "
                       f"{_edit('3 + late', 'R', f'r{_NEXT[q]}', chr(39) + _NEXT_ROLE[q] + ':' + chr(39) + ' || text')} END")
        options += [f"CASE WHEN fault IN ('blank', 'duplicate') OR role[1] <> '{i}' THEN NULL ELSE {_edit('late', 'K', f'r{to}', 'line')} END"
                    for i, to in keep.items()]
        moved.append(f"least({', '.join(options)}) AS r{q}")

    def inserted(source: str) -> str:
        return "SELECT conv_id, n, " + ", ".join(
            f"least(r{q}, {_edit('3', 'I', f'r{_NEXT[q]}', repr(_NEXT_ROLE[q] + ':'))}) AS r{q}" for q in _STATES) + f" FROM {source}"

    accepted = "'000000000000' || chr(1)"
    one = "'000000000003I' || chr(1) || 'assistant:'"
    two = "'000000000006II' || chr(1) || 'user:' || chr(10) || 'assistant:'"
    return f"""
WITH RECURSIVE bytes AS (SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END) AS v FROM range(256) r(i))),
keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT),
        lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295::BIGINT) % 20 AS kind FROM keyed, bytes),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
again AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM ordered),
faults AS (SELECT conv_id, turn, n, role, text, role || ':' || text AS line, before,
    CASE WHEN bare = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM again),
late AS (SELECT *, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late FROM faults),
rest AS (
    SELECT conv_id, max(n) AS n, {accepted} AS r0, {two} AS r1, {one} AS r2, {accepted} AS r3 FROM late GROUP BY conv_id
    UNION ALL
    SELECT * FROM (WITH moved AS (SELECT rest.conv_id, rest.n - 1 AS n, {', '.join(moved)}
        FROM rest JOIN late ON late.conv_id IS NOT DISTINCT FROM rest.conv_id AND late.n = rest.n),
        once AS ({inserted('moved')}), twice AS ({inserted('once')}) {inserted('twice')})),
figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM late GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    coalesce(substr(r0, 1, 12)::BIGINT, 0) AS cost, coalesce(substr(r0, 13, strpos(r0, chr(1)) - 13), '') AS audit,
    sha256(coalesce(substr(r0, strpos(r0, chr(1)) + 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN rest ON rest.conv_id IS NOT DISTINCT FROM c.conv_id AND rest.n = 0"""


ORACLE["op13_conversation_repair"] = _conversation_oracle()
