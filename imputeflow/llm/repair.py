"""Conversations repaired to alternating turns at least cost (operator 13).

A repaired conversation has the roles ``(s?(ua)+)?`` (initials of system, user, assistant). A row may be kept, given the role
user or assistant, or deleted, and empty turns may be inserted; blank and duplicate rows have to go, truncated rows cost extra
when they stay. Of the cheapest edits those come out whose initials (Delete, Insert, Keep, Rerole) are least in ASCII order.

Rows are repartitioned by conversation and sorted by turn, last turn first, and stream through ``mapInPandas``: the cost of repairing the
rest of the conversation from each of the grammar's four states is carried from row to row and over Arrow batches. What is best in each
state is one byte per row; these backpointers leave the task in chunks of ``CHUNK`` rows and are written to the shared
folder, so a giant conversation holds one chunk at a time. A second pass sorts rows and chunks together, first turn first, and
walks along the backpointers. The first pass moves no texts, only their digests and faults. Both passes stream: sorts spill, and a
conversation is never held as a whole; its audit in ``repair_report`` is one character per edit, as one row of the result has to be.

Ties: rows of one turn are ordered by role and then by the md5 of the text; equal rows are interchangeable. A null turn comes first. Null
roles and texts count as one space (and null conv_ids and turns as one space in the key of the damage). A null conv_id is a
conversation of its own. Repeated rows are duplicates. Empty texts are blank; long texts are only digested and passed on. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from imputeflow.llm.shared import write_table

CHUNK = 1 << 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # fixed values: costs of the edits, and of a truncated row that stays
START, AFTER_S, AFTER_U, AFTER_A = range(4)
EDITS = "DIKR"  # in ASCII order; a backpointer has two bits for each state
NEXT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}  # state after an inserted or reroled turn
KEPT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A,
        (AFTER_A, "u"): AFTER_U}
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
AT_END = (0, 2 * INSERT, INSERT, 0)  # cost of ending in each state: inserted turns up to an assistant's
LEGAL = {"su", "ua", "au"}

FAULTS = ("none", "truncated", "blank", "duplicate", "gone")  # gone: the conversation lost this row; it only names its conversation


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by a checksum of conversation and turn; dropped rows are marked."""
    one = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), one))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", one), F.coalesce("text", one)
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"), F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("__copy"))
    return rows.withColumn("__copy", F.explode("__copy")).drop("__copy")


def _ordered(turns: DataFrame) -> DataFrame:
    """The rows with what both passes sort by: turn (nulls first), role, md5 of the text."""
    return turns.select("conv_id", F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).cast("long").alias("at"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                        F.coalesce("gone", F.lit(False)).alias("gone")).withColumn("digest", F.md5("text"))


def _faults(rows: DataFrame) -> DataFrame:
    """conv_id, known, at, role, digest, initial, fault (place in FAULTS) of each row; no text."""
    inked = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    found = rows.select(
        "conv_id", "known", "at", "role", "digest", "gone", (F.length(inked) == 0).alias("blank"),
        (~F.substring(inked, -1, 1).isin(".", "!", "?")).alias("open"))
    found = found.repartition("conv_id")
    earlier = Window.partitionBy("conv_id", "gone", "role", "digest").orderBy("known", "at")
    again = F.row_number().over(earlier) > 1
    fault = F.when(F.col("gone"), 4).when(F.col("blank"), 2).when(again, 3).when(F.col("open"), 1).otherwise(0)
    return found.select("conv_id", "known", "at", "role", "digest", F.substring("role", 1, 1).alias("initial"),
                        fault.alias("fault"))


def step(rest: tuple, initial: str, fault: int) -> tuple[tuple, int]:
    """Costs from each state with one more row in front, given the costs without it; and the best edits, two bits a state."""
    must_go = FAULTS[fault] in ("blank", "duplicate")
    stays = TRUNCATED if FAULTS[fault] == "truncated" else 0
    options = []
    for state in range(4):
        found = {"D": DELETE + rest[state]}
        if not must_go:
            found["R"] = REROLE + stays + rest[NEXT[state]]
            if (state, initial) in KEPT:
                found["K"] = KEEP + stays + rest[KEPT[state, initial]]
        options.append(found)
    costs = [min(o.values()) for o in options]
    for _ in range(2):  # an inserted turn, or two of them, in front of this row
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    byte = 0
    for state, found in enumerate(options):
        found["I"] = INSERT + costs[NEXT[state]]
        best = min(e for e, c in found.items() if c == costs[state])
        byte |= EDITS.index(best) << 2 * state
    return tuple(costs), byte


TOTALS = ["blank", "duplicate", "truncated", "illegal", "gaps", "cost"]
CHUNK_SCHEMA = ("conv_id long, known boolean, at long, role string, digest string, part long, back binary, "
                + ", ".join(f"{t} long" for t in TOTALS))


class _Backward:
    """State of the conversation that is read, last row first."""

    def __init__(self, conv):
        self.conv, self.rest, self.floor = conv, AT_END, 0
        self.back, self.part, self.place, self.after = bytearray(), 0, (False, 0, "", ""), None
        self.seen = dict.fromkeys(FAULTS, 0)
        self.illegal, self.turns, self.high, self.low = 0, 0, None, None

    def row(self, known, at, role, digest, initial, fault, steps) -> None:
        if fault == 4:
            return
        key = (self.rest, initial if initial in "sua" else "", fault)
        found = steps.get(key)
        if found is None:
            costs, byte = step(*key)
            low = min(costs)  # costs are kept relative to the least one, so few different states occur
            found = steps[key] = (tuple(c - low for c in costs), low, byte)
        self.rest, moved, byte = found
        self.floor += moved
        self.back.append(byte)
        self.place = (known, at, role, digest)
        self.seen[FAULTS[fault]] += 1
        if self.after is not None and initial + self.after not in LEGAL:
            self.illegal += 1
        self.after = initial
        if known:
            if self.low != at:
                self.turns += 1
            self.high = at if self.high is None else self.high
            self.low = at

    def chunk(self, last: bool) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if last and self.turns else 0
        totals = (self.seen["blank"], self.seen["duplicate"], self.seen["truncated"], self.illegal, gaps,
                  self.floor + self.rest[START]) if last else (0,) * len(TOTALS)
        out = (self.conv, *self.place, self.part, bytes(self.back), *totals)
        self.back, self.part = bytearray(), self.part + 1
        return out


def _null(value):
    return None if value is None or value != value or value is pd.NA else value


def backpointers(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks of backpointers, each at the place of its first row; the first one of a conversation has its totals."""
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, steps = None, {}
        for pdf in batches:
            out = []
            for conv, *row in zip(pdf["conv"], pdf["known"], pdf["at"], pdf["role"], pdf["digest"], pdf["initial"],
                                  pdf["fault"], strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.chunk(True))
                    now = _Backward(conv)
                elif len(now.back) >= chunk:
                    out.append(now.chunk(False))
                now.row(*row, steps)
            if out:
                yield frame(out)
        if now is not None:
            yield frame([now.chunk(True)])

    def frame(out: list) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=names)
        made["conv_id"] = pd.array([None if c == "" else int(c) for c in made["conv_id"]], "Int64")
        return made

    # a null conv_id is an empty name inside the tasks, so that no number turns into a double
    found = _faults(rows).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    dealt = found.sortWithinPartitions("conv", F.desc("known"), F.desc("at"), F.desc("role"), F.desc("digest"), F.desc("fault"))
    return dealt.select("conv", "known", "at", "role", "digest", "initial", "fault").mapInPandas(run, CHUNK_SCHEMA)


class _Forward:
    """The walk along the backpointers of one conversation, first row first."""

    def __init__(self, conv, totals: dict):
        self.conv, self.totals, self.state = conv, totals, START
        self.back, self.at = b"", 0
        self.waiting: list[bytes] = []

    def more(self, back: bytes) -> None:
        self.waiting.append(back)

    def row(self) -> Iterator[tuple[str, str | None]]:
        """The edits up to and with this row's own: (edit, role that it gives)."""
        while self.at == len(self.back):
            self.back, self.at = self.waiting.pop(0)[::-1], 0
        byte = self.back[self.at]
        self.at += 1
        while (edit := EDITS[byte >> 2 * self.state & 3]) == "I":
            yield self.insert()
        yield edit, None

    def insert(self) -> tuple[str, str]:
        self.state = NEXT[self.state]
        return "I", ROLE[self.state]

    def end(self) -> Iterator[tuple[str, str]]:
        while AT_END[self.state]:
            yield self.insert()

    def edited(self, role: str):
        """(edit, role after it or None) for a row of this role and what is inserted in front of it."""
        for edit, given in self.row():
            if edit == "K":
                self.state, given = KEPT[self.state, role[:1]], role
            elif edit == "R":
                self.state = NEXT[self.state]
                given = ROLE[self.state]
            yield edit, given


def _walk(turns: DataFrame, sink, schema: str, chunk: int) -> DataFrame:
    """Both passes; ``sink(conversation)`` takes the edits of a conversation and yields the result's rows."""
    rows = _ordered(turns)
    chunks, _ = write_table(backpointers(rows, chunk), "backpointers")
    place = ["conv_id", "known", "at", "role", "digest"]
    both = rows.where("not gone").select(*place, "text", F.lit(0).cast("long").alias("part"),
                                         F.lit(None).cast("binary").alias("back"), F.lit(True).alias("row"), *[F.lit(0).cast("long").alias(t) for t in TOTALS]).unionByName(
        chunks.select(*place, F.lit("").alias("text"), "part", "back", F.lit(False).alias("row"), *TOTALS))
    named = both.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    # a chunk comes in front of the first row that it is about; of chunks at one place, that with the earlier rows comes first
    dealt = named.repartition("conv_id").sortWithinPartitions("conv", "known", "at", "role", "digest", "row", F.desc("part"))
    columns = ["conv", "role", "text", "known", "at", "back", "row", *TOTALS]

    def run(batches):
        now = out = None
        for pdf in batches:
            found = []
            for conv, role, text, known, at, back, is_row, *totals in zip(*[pdf[c] for c in columns], strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        found += out.close(now.end())
                    now = _Forward(conv, dict(zip(TOTALS, totals, strict=True)))
                    out = sink(now)
                if is_row:
                    found += out.row(at if known else None, role, text, now.edited(role))
                else:
                    now.more(back)
            if found:
                yield out.frame(found)
        if now is not None:
            last = out.close(now.end())
            if last:
                yield out.frame(last)

    return dealt.select(*columns).mapInPandas(run, schema)


def _id(conv: str):
    return None if conv == "" else int(conv)


class _Report:
    """One row per conversation: its totals, the audit and a digest of the repaired turns."""

    def __init__(self, walk: _Forward):
        self.walk, self.audit, self.hash, self.lines = walk, bytearray(), hashlib.sha256(), 0

    def _take(self, edits, text: str) -> None:
        for edit, role in edits:
            self.audit += edit.encode()
            if edit != "D":
                line = f"{role}:{'' if edit == 'I' else text}"
                self.hash.update((line if not self.lines else "\n" + line).encode())
                self.lines += 1

    def row(self, at, role, text, edits) -> list:
        self._take(edits, text)
        return []

    def close(self, edits) -> list:
        self._take(edits, "")
        return [(self.walk.conv, *self.walk.totals.values(), self.audit.decode(), self.hash.hexdigest())]

    @staticmethod
    def frame(found: list) -> pd.DataFrame:
        made = pd.DataFrame(found, columns=["conv_id", *TOTALS, "audit", "repaired_sha256"])
        made["conv_id"] = pd.array([_id(c) for c in made["conv_id"]], "Int64")
        return made


class _Turns:
    """The edits as rows: numbered in order, with the role and text that they give (null for a deleted row)."""

    def __init__(self, walk: _Forward):
        self.walk, self.n = walk, 0

    def _rows(self, edits, at, text) -> list:
        found = []
        for edit, role in edits:
            found.append((self.walk.conv, self.n, edit, None if edit == "I" else at, None if edit == "D" else role,
                          None if edit == "D" else "" if edit == "I" else text))
            self.n += 1
        return found

    def row(self, at, role, text, edits) -> list:
        return self._rows(edits, at, text)

    def close(self, edits) -> list:
        return self._rows(edits, None, "")

    @staticmethod
    def frame(found: list) -> pd.DataFrame:
        made = pd.DataFrame(found, columns=["conv_id", "n", "edit", "turn", "role", "text"])
        made["conv_id"] = pd.array([_id(c) for c in made["conv_id"]], "Int64")
        made["turn"] = pd.array(made["turn"].tolist(), "Int64")
        return made


def repair_report(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, gone): faults, cost, audit, digest of the repaired turns."""
    schema = "conv_id long, " + ", ".join(f"{t} long" for t in TOTALS) + ", audit string, repaired_sha256 string"
    return _walk(turns, _Report, schema, chunk)


def repaired_turns(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The edits of every conversation in order (n): edit, and the turn, role and text that they leave (null if deleted)."""
    return _walk(turns, _Turns, "conv_id long, n long, edit string, turn long, role string, text string", chunk)
