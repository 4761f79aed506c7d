"""Conversation structure repair by secondary-sorted streaming.

A repaired conversation has role initials ``(s?(ua)+)?``: an optional system row, then user and assistant by turns.
The cheapest edits come from a shortest path over four states (what the last kept role was) and the rows of a
conversation, taken from its last row to its first, so that ties go to the least edit at the earliest place. Rows are
repartitioned by conversation and sorted by turn; ``mapInPandas`` carries the four costs from batch to batch. Each row
leaves one byte: the best edit in each of the four states. Every ``chunk`` bytes go out as a row of a table in the
shared folder, so a conversation of any length holds one chunk in memory. A second stream, sorted the other way, reads
the bytes beside the rows and applies the edits.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bayesloom.llm.shared import materialise

#: costs of the edits; a truncated row that stays costs TRUNCATED besides
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: rows whose best edits are held before they are written out
CHUNK = 1 << 20

_EDITS = "DIKR"  # in the order of their characters, by their two-bit code
# states: nothing kept yet, system, user, assistant; what the next row has to be, and the state after it
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_ENDS = (True, False, False, True)
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

#: classes of rows: 0 has to go; else 1 + 2 * (index in "sua", 3 for another role) + 1 if truncated
_CLASSES = 9


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with planted faults, chosen by crc32 of ``conv:turn`` modulo 20: 0 dropped, 1 without text, 2 without
    ``.!?``, 3 twice, 4 with role user. A null counts as one space."""
    c, t, r, x = (F.col(f"`{n}`") for n in (conv, turn, role, text))
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(c.cast("string"), space), F.lit(":"), F.coalesce(t.cast("string"), space))) % 20
    said = F.coalesce(x.cast("string"), space)
    return (rows.select(c.alias("conv"), t.alias("turn"), kind.alias("kind"), F.coalesce(r.cast("string"), space).alias("role"), said.alias("text"))
            .filter("kind != 0")
            .select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text)))


class Steps:
    """Transitions of the four costs, less their least one, under each class of row; made as they come up."""

    def __init__(self):
        self.costs: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.after: list[list] = []
        far = 1 << 40
        self.start, _ = self._number(self._relaxed([0 if end else far for end in _ENDS]))

    @staticmethod
    def _relaxed(costs: list[int]) -> list[int]:
        for _ in range(3):  # insertions in a row
            costs = [min(c, INSERT + costs[_NEXT[q]]) for q, c in enumerate(costs)]
        return costs

    def _number(self, costs: list[int]) -> tuple[int, int]:
        low = min(costs)
        key = tuple(c - low for c in costs)
        if key not in self.known:
            self.known[key] = len(self.costs)
            self.costs.append(key)
            self.after.append([None] * _CLASSES)
        return self.known[key], low

    def step(self, at: int, row: int) -> tuple[int, int, int]:
        """From the costs behind a row of this class: number of the costs before it, what their least one grew by, byte of best edits."""
        got = self.after[at][row]
        if got is None:
            got = self.after[at][row] = self._make(self.costs[at], row)
        return got

    def _make(self, behind: tuple, row: int) -> tuple[int, int, int]:
        initial = None if row == 0 else "sua_"[(row - 1) // 2]
        stay = TRUNCATED if row and (row - 1) % 2 else 0
        moves = []
        for q in range(4):
            can = {"D": DELETE + behind[q]}
            if row:
                can["R"] = REROLE + stay + behind[_NEXT[q]]
                if (q, initial) in _KEEP:
                    can["K"] = stay + behind[_KEEP[q, initial]]
            moves.append(can)
        best = self._relaxed([min(can.values()) for can in moves])
        byte = 0
        for q, can in enumerate(moves):
            can["I"] = INSERT + best[_NEXT[q]]
            byte |= next(k for k, e in enumerate(_EDITS) if can.get(e) == best[q]) << 2 * q
        return *self._number(best), byte


_FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_PLACE = ["known", "turn", "role", "hash"]
_POINTERS = "conv string, known int, turn long, role string, hash long, number long, edits binary, " + ", ".join(f"{c} long" for c in _FIGURES)


def _back(chunk: int):
    """Streams rows sorted by conversation and then backwards into rows of pointers, in chunks, with sums of figures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = Steps()
        costs, held, sums, place, open_ = steps.start, bytearray(), np.zeros(6, np.int64), None, False
        number = 0  # falls with every chunk: chunks of rows that are equal in place sort forwards too

        def out(ends: bool) -> tuple:
            if ends:
                sums[5] += steps.costs[costs][0]
            nonlocal number
            number -= 1
            row = (*place, number, bytes(held[::-1]), *sums.tolist())
            held.clear()
            sums[:] = 0
            return row

        def table(rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["conv", *_PLACE, "number", "edits", *_FIGURES])

        for batch in batches:
            ready = []
            classes = batch["class"].tolist()
            figures = batch[["gap", "blank", "duplicate", "truncated", "illegal"]].to_numpy(np.int64)
            places = [batch["conv"], *(batch[c] for c in _PLACE)]
            starts = [*np.flatnonzero(batch["last"].to_numpy()).tolist(), len(batch)]
            lo, following = 0, 0
            while lo < len(batch):
                if lo == starts[following]:
                    if open_:
                        ready.append(out(True))
                    costs, open_, following = steps.start, True, following + 1
                hi = min(starts[following], lo + chunk - len(held))
                low = 0
                for row in classes[lo:hi]:
                    costs, more, byte = steps.step(costs, row)
                    low += more
                    held.append(byte)
                sums[:5] += figures[lo:hi].sum(0)
                sums[5] += low
                place = [column.iloc[hi - 1] for column in places]
                if len(held) >= chunk:
                    ready.append(out(False))
                lo = hi
            if ready:
                yield table(ready)
        if open_:
            yield table([out(True)])

    return run


class _Audit:
    """One row for a conversation: its figures, the edits' initials and the digest of the repaired rows."""

    schema = ", ".join(f"{c} long" for c in _FIGURES) + ", audit string, repaired_sha256 string"

    def __init__(self, conv: str | None):
        self.conv, self.sums, self.edits, self.digest, self.lines = conv, [0] * 6, bytearray(), hashlib.sha256(), 0

    def add(self, edit: str, role: str, text: str) -> None:
        self.edits += edit.encode()
        if edit != "D":
            self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def rows(self, ended: bool) -> list[tuple]:
        return [(self.conv, *self.sums, self.edits.decode(), self.digest.hexdigest())] if ended else []


class _Rows:
    """The repaired rows themselves, deleted ones left out."""

    schema = "place long, edit string, role string, text string"

    def __init__(self, conv: str | None):
        self.conv, self.sums, self.ready, self.place = conv, [0] * 6, [], 0

    def add(self, edit: str, role: str, text: str) -> None:
        if edit != "D":
            self.ready.append((self.conv, self.place, edit, role, text))
            self.place += 1

    def rows(self, ended: bool) -> list[tuple]:
        ready, self.ready = self.ready, []
        return ready


def _forward(fold: type, columns: list[str]):
    """Applies edits to rows sorted by conversation and turn; a chunk of pointers stands before the rows it covers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, here, chunks = 0, None, deque()

        def end() -> list[tuple]:
            nonlocal state
            while not _ENDS[state]:
                here.add("I", _ROLE[state], "")
                state = _NEXT[state]
            return here.rows(True)

        for batch in batches:
            ready: list[tuple] = []
            for conv, kind, role, text, edits, *figures in batch.itertuples(index=False, name=None):
                if kind == 0:  # a conversation starts
                    if here is not None:
                        ready += end()
                    here, state = fold(conv), 0
                    chunks.clear()
                    continue
                if kind == 1:
                    here.sums = [a + int(b) for a, b in zip(here.sums, figures)]
                    if edits:
                        chunks.append(iter(edits))
                    continue
                while (byte := next(chunks[0], None)) is None:
                    chunks.popleft()
                while (edit := _EDITS[byte >> 2 * state & 3]) == "I":
                    here.add("I", _ROLE[state], "")
                    state = _NEXT[state]
                if edit == "R":
                    role, state = _ROLE[state], _NEXT[state]
                elif edit == "K":
                    state = _KEEP[state, role[:1]]
                here.add(edit, role, text)
            if here is not None:
                ready += here.rows(False)
            yield pd.DataFrame(ready, columns=columns)
        if here is not None:
            yield pd.DataFrame(end(), columns=columns)

    return run


def _marked(rows: DataFrame) -> DataFrame:
    """Rows without their texts, with class and figures; ``last`` marks each conversation's last one."""
    place = [F.col("known"), F.col("turn"), F.col("role"), F.col("hash")]
    within = Window.partitionBy("conv").orderBy(*place, "again")
    alike = Window.partitionBy("conv", "hash", "role").orderBy("known", "turn")
    no_word, cut_off = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    return (rows.select("conv", *_PLACE, no_word.alias("blank"), cut_off.alias("cut"))
            .repartition("conv")
            .withColumn("again", ~F.col("blank") & (F.row_number().over(alike) > 1))
            .withColumn("pair", F.concat(F.lag(initial).over(within), initial))
            .withColumn("step", F.col("turn") - F.lag(F.when(F.col("known") == 1, F.col("turn"))).over(within))
            .withColumn("last", F.lead(F.lit(1)).over(within).isNull())
            .withColumn("cut", F.col("cut") & ~F.col("blank") & ~F.col("again"))
            .select("conv", *_PLACE, "last",
                    F.when(F.col("blank") | F.col("again"), 0).otherwise(
                        1 + 2 * F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
                        + F.col("cut").cast("int")).alias("class"),
                    F.when(F.col("step") > 0, F.col("step") - 1).otherwise(0).cast("long").alias("gap"),
                    F.col("blank").cast("long").alias("blank"), F.col("again").cast("long").alias("duplicate"),
                    F.col("cut").cast("long").alias("truncated"),
                    F.when(F.col("pair").isNotNull() & ~F.col("pair").isin("su", "ua", "au"), 1).otherwise(0).cast("long").alias("illegal")))


def repair(rows: DataFrame, conversations: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", chunk: int = CHUNK, output: str = "audit") -> DataFrame:
    """Cheapest repair of every conversation.

    ``output="audit"`` gives one row per conversation: gaps in its turns, blank, duplicate, truncated and illegal rows,
    the cost, the edits' initials and the SHA-256 of the repaired ``role:text`` lines. ``output="rows"`` gives the repaired
    rows with ``place`` and ``edit``. ``conversations`` (a table with the ``conv`` column) names conversations that come out
    even without a row: zeros, empty audit, digest of nothing.

    A null role or text is one space. Rows without a turn come first; rows of one turn go by role and then by a hash of the
    text, repeated rows are duplicates. Null ids are one conversation. A role without a letter (empty, a space) can't be
    kept. An empty table gives an empty result. Other columns are not read. A conversation is one task's stream, whatever its
    length: it holds a chunk of edits and a batch of rows, and, as the result does, its audit.
    """
    space = F.lit(" ")
    kind_of_id = rows.schema[conv].dataType
    # ids as strings, turns as two numbers: pandas has no nulls in columns of numbers
    key = F.col(f"`{conv}`").cast("string").alias("conv")
    base = rows.select(
        key, F.col(f"`{turn}`").isNotNull().cast("int").alias("known"), F.coalesce(F.col(f"`{turn}`").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), space).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), space).alias("text"),
    ).withColumn("hash", F.xxhash64("text"))
    backwards = [F.col("conv").desc(), *(F.col(c).desc() for c in _PLACE), F.col("duplicate").desc(), F.col("last").desc()]
    pointers = materialise(_marked(base).sortWithinPartitions(*backwards).mapInPandas(_back(chunk), _POINTERS))

    fold = {"audit": _Audit, "rows": _Rows}[output]
    known = (rows if conversations is None else conversations).select(key)
    none = [F.lit(0).cast("long").alias(c) for c in _FIGURES]
    empty = F.lit(None).cast("string")
    stream = (
        known.distinct().select("conv", F.lit(-1).alias("known"), F.lit(0).cast("long").alias("turn"), empty.alias("role"), F.lit(0).cast("long").alias("hash"),
                                F.lit(0).cast("long").alias("number"), F.lit(0).alias("kind"), empty.alias("text"), F.lit(None).cast("binary").alias("edits"), *none)
        .unionByName(pointers.withColumn("kind", F.lit(1)).withColumn("text", empty))
        .unionByName(base.withColumn("kind", F.lit(2)).withColumn("number", F.lit(0).cast("long")).withColumn("edits", F.lit(None).cast("binary")).select("*", *none))
        .repartition("conv").sortWithinPartitions("conv", *_PLACE, "kind", "number")
        .select("conv", "kind", "role", "text", "edits", *_FIGURES))
    schema = f"conv string, {fold.schema}"
    names = [part.split()[0] for part in schema.split(", ")]
    return stream.mapInPandas(_forward(fold, names), schema).withColumn("conv", F.col("conv").cast(kind_of_id)).withColumnRenamed("conv", conv)
