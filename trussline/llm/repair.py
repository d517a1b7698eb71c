"""Repair of conversations: the cheapest edits that make roles alternate, by products of 4x4 matrices.

A state tells what has been said so far: nothing (0), a system turn (1), a user turn last (2), an assistant turn last (3). Each row is
a matrix whose element (i, j) is the least (cost, audit) that leads from i to j by turns put in before the row and by
keeping, renaming or deleting it. Sums of costs with joined audits are the product, the least pair is the sum. Both audits of a
comparison cover the same rows, so of two with equal cost neither begins the other, and the product is associative.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trussline.llm.common import stored

Element = tuple[int, str]
Matrix = tuple[Element | None, ...]

STATES = 4
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States in which a conversation may end.
WHOLE = (0, 3)
#: (from, to) by a turn of each initial.
STEPS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
LEGAL = {"su", "ua", "au"}
#: Rows and characters of a chunk, about; a longer row has a chunk of its own.
CHUNK_ROWS, CHUNK_CHARS = 2048, 1 << 20
#: Chunks that one task multiplies in a round.
FAN_IN = 16
#: Characters of a text that the ranges of rows go by.
RANGE_CHARS = 32

_SPACE = r"\x20\x09-\x0D"
_SAID = re.compile(f"[^{_SPACE}]")
_ENDED = re.compile(f"[.!?][{_SPACE}]*\\Z")


def least(a: Element | None, b: Element | None) -> Element | None:
    return b if a is None else a if b is None else min(a, b)


def product(x: Matrix, y: Matrix) -> Matrix:
    out: list[Element | None] = []
    for i in range(STATES):
        for j in range(STATES):
            best = None
            for k in range(STATES):
                a, b = x[i * STATES + k], y[k * STATES + j]
                if a and b and (best is None or a[0] + b[0] <= best[0]):
                    best = least(best, (a[0] + b[0], a[1] + b[1]))
            out.append(best)
    return tuple(out)


def _matrix(entries: Iterable[tuple[int, int, Element]]) -> Matrix:
    out: list[Element | None] = [None] * (STATES * STATES)
    for i, j, e in entries:
        out[i * STATES + j] = least(out[i * STATES + j], e)
    return tuple(out)


IDENTITY = _matrix((i, i, (0, "")) for i in range(STATES))


def _closure() -> Matrix:
    """Any number of turns put in: the sum of all powers of the single insertion, which settles after as many as there are states."""
    once = _matrix([(i, i, (0, "")) for i in range(STATES)] + [(i, j, (INSERT, "I")) for initial in "ua" for i, j in STEPS[initial]])
    out = IDENTITY
    for _ in range(STATES):
        out = product(out, once)
    return out


CLOSURE = _closure()


@lru_cache(maxsize=None)
def turn_matrix(kind: str) -> Matrix:
    """The matrix of a row: the initial of its role (``?`` for all others), upper case if it is truncated, or ``-`` if it must go."""
    entries = [(i, i, (DELETE, "D")) for i in range(STATES)]
    if kind != "-":
        extra = TRUNCATED * kind.isupper()
        entries += [(i, j, (extra, "K")) for i, j in STEPS.get(kind.lower(), ())]
        entries += [(i, j, (RENAME + extra, "R")) for initial in "ua" for i, j in STEPS[initial]]
    return product(CLOSURE, _matrix(entries))


@lru_cache(maxsize=1 << 15)
def _short(kinds: str) -> Matrix:
    return _tree(kinds)


def _tree(kinds: str) -> Matrix:
    if not kinds:
        return IDENTITY
    if len(kinds) == 1:
        return turn_matrix(kinds)
    half = len(kinds) // 2
    part = _short if half <= 8 else _tree
    return product(part(kinds[:half]), part(kinds[half:]))


def rows_matrix(kinds: str) -> Matrix:
    """The product of the matrices of some rows, by halves."""
    return _short(kinds) if len(kinds) <= 8 else _tree(kinds)


def cheapest(matrix: Matrix) -> Element:
    """The least (cost, audit) of a whole conversation."""
    ended = product(matrix, CLOSURE)
    best = None
    for state in WHOLE:
        best = least(best, ended[state])
    return best


def kind_of(role: str, text: str, first: bool) -> tuple[str, str]:
    """(kind, fault) of a row; ``first``: no earlier row has its role and text."""
    if not _SAID.search(text):
        return "-", "blank"
    if not first:
        return "-", "duplicate"
    initial = role[:1] if role[:1] in STEPS else "?"
    if _ENDED.search(text):
        return initial, ""
    return {"s": "S", "u": "U", "a": "A"}.get(initial, "X"), "truncated"


def repaired_rows(rows: list[tuple[str, str | None]], audit: str, after: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that an audit leaves; ``after`` is the number of turns that follow them.

    The last turn of a repaired conversation is an assistant's, so the place from its end gives the role of a turn put in or renamed.
    """
    left, row = sum(c != "D" for c in audit) + after, 0
    for edit in audit:
        role, text = (None, "") if edit == "I" else rows[row]
        row += edit != "I"
        if edit != "D":
            left -= 1
            yield edit, role if edit == "K" else "user" if left % 2 else "assistant", text


# ---- tables

_ROW = pa.struct([("role", pa.string()), ("text", pa.string())])
_ELEMENT = pa.struct([("cost", pa.int64()), ("audit", pa.string())])
_STATS = ["n_rows", "blank", "duplicate", "truncated", "illegal", "n_turns"]
_CHUNK = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), ("open", pa.bool_())]
    + [(c, pa.int64()) for c in _STATS]
    + [("low", pa.int64()), ("high", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("matrix", pa.list_(_ELEMENT)), ("rows", pa.list_(_ROW))]
)
_CHUNK_SQL = ", ".join(["conv_id long, part long, chunk long, open boolean", *(f"{c} long" for c in _STATS), "low long, high long, head string, tail string, matrix array<struct<cost:bigint,audit:string>>, rows array<struct<role:string,text:string>>"])


class Chunk:
    """Rows of a conversation that follow each other, with what their neighbours must know of them."""

    def __init__(self, conv_id: int | None, part: int, number: int):
        self.key = {"conv_id": conv_id, "part": part, "chunk": number}
        self.kinds: list[str] = []
        self.rows: list[dict] = []
        self.stats = dict.fromkeys(_STATS, 0)
        self.low = self.high = self.head = self.tail = None
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str, n: int, first: bool) -> None:
        for copy in range(n):
            kind, fault = kind_of(role, text, first and not copy)
            self.kinds.append(kind)
            self.rows.append({"role": role, "text": None if kind == "-" else text})
            if fault:
                self.stats[fault] += 1
            self.stats["n_rows"] += 1
            self.stats["illegal"] += self.tail is not None and self.tail + role[:1] not in LEGAL
            self.tail = role[:1]
            self.head = self.tail if self.head is None else self.head
        if turn is not None and n:
            self.stats["n_turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.chars += len(text)

    @property
    def full(self) -> bool:
        return len(self.rows) >= CHUNK_ROWS or self.chars >= CHUNK_CHARS

    def record(self, is_open: bool) -> dict:
        matrix = [e and {"cost": e[0], "audit": e[1]} for e in rows_matrix("".join(self.kinds))]
        return {**self.key, "open": is_open, **self.stats, "low": self.low, "high": self.high, "head": self.head, "tail": self.tail, "matrix": matrix, "rows": self.rows}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of sorted rows. A conversation that has one chunk, and others before and behind it in the partition, is whole."""
    part, number, out, weight = TaskContext.get().partitionId(), 0, [], 0
    now: Chunk | None = None
    is_first, several = True, False

    def close(chunk: Chunk, is_open: bool) -> None:
        nonlocal weight
        out.append(chunk.record(is_open))
        weight += chunk.chars + 256

    for batch in batches:
        for conv_id, turn, role, text, n, first in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "first"))):
            if now is None or conv_id != now.key["conv_id"]:
                if now is not None:
                    close(now, is_first or several)
                    is_first = False
                now, several, number = Chunk(conv_id, part, number), False, number + 1
            while n or first is None:
                if now.full:
                    close(now, True)
                    now, several, number = Chunk(conv_id, part, number), True, number + 1
                some = min(n, CHUNK_ROWS)
                now.add(turn, role, text, some, bool(first))
                n, first = n - some, False
            if weight > 1 << 22:
                yield pa.RecordBatch.from_pylist(out, _CHUNK)
                out, weight = [], 0
    if now is not None:
        close(now, True)
    if out:
        yield pa.RecordBatch.from_pylist(out, _CHUNK)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of a test: by crc32 of ``conv_id:turn`` modulo 20, 0 drops a row, 1 empties it, 2 takes its ends of sentences, 3 repeats it, 4 makes it a user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _join_same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on equal values, null to null; the keys of ``left`` stay."""
    other = right.withColumnsRenamed({c: f"other_{c}" for c in names})
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"other_{c}"))
    return left.join(other, on, how).drop(*[f"other_{c}" for c in names])


def conversation_chunks(rows: DataFrame) -> DataFrame:
    """Chunks of (conv_id, turn, role, text, copies), written to the shared folder.

    Equal rows are counted before anything else. Whether a row is the first of its role and text is found by a grouped minimum and an equal join of
    keys that are unique on both sides, and rows are dealt by ranges, so that neither one conversation nor one text fills a task.
    """
    gone = F.col("copies") <= 0
    kept = rows.select(F.col("conv_id").cast("long").alias("conv_id"), *[F.when(~gone, F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in (("turn", None), ("role", ""), ("text", ""))], "copies")
    units = kept.groupBy("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").agg(F.sum("copies").alias("n")).withColumn("digest", F.md5("text"))
    seen = units.filter("n > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("told"), "turn"))["turn"].alias("turn")).withColumn("first", F.lit(True))
    told = _join_same(units, seen, ["conv_id", "turn", "role", "digest"], "left").select("conv_id", "turn", "role", "text", "n", F.when(F.col("n") > 0, F.coalesce("first", F.lit(False))).alias("first"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = told.repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return stored(ranged.mapInArrow(_chunks, _CHUNK_SQL), "repair-chunks")


_SUM = pa.schema([f for f in _CHUNK if f.name not in ("part", "chunk", "open", "rows")] + [("ord", pa.int64()), ("sizes", pa.list_(pa.int64()))])
_SUM_SQL = ", ".join(["conv_id long", *(f"{c} long" for c in _STATS), "low long, high long, head string, tail string, matrix array<struct<cost:bigint,audit:string>>, ord long, sizes array<bigint>"])


def _as_matrix(elements: list[dict | None]) -> Matrix:
    return tuple(e and (e["cost"], e["audit"]) for e in elements)


def _join(left: dict, right: dict) -> dict:
    out = {c: left[c] + right[c] for c in _STATS}
    out["illegal"] += left["tail"] is not None and right["head"] is not None and left["tail"] + right["head"] not in LEGAL
    out["n_turns"] -= left["high"] is not None and left["high"] == right["low"]
    ends = {"low": (left, right), "head": (left, right), "high": (right, left), "tail": (right, left)}
    out |= {c: a[c] if a[c] is not None else b[c] for c, (a, b) in ends.items()}
    return out | {"conv_id": left["conv_id"], "ord": left["ord"], "sizes": left["sizes"] + right["sizes"], "matrix": product(left["matrix"], right["matrix"])}


def _reduce(table: pa.Table) -> pa.Table:
    """One row of neighbouring chunks' rows, multiplied by halves."""
    level = sorted(({**r, "matrix": _as_matrix(r["matrix"])} for r in table.select(_SUM.names).to_pylist()), key=lambda r: r["ord"])
    while len(level) > 1:
        level = [_join(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    out = level[0]
    out["matrix"] = [e and {"cost": e[0], "audit": e[1]} for e in out["matrix"]]
    out["ord"] //= FAN_IN
    return pa.Table.from_pylist([out], _SUM)


def _split(audit: str, sizes: list[int]) -> list[tuple[str, int]]:
    """The audit's piece of each chunk, with the number of turns that the later pieces leave; what is put in goes with the row behind it."""
    pieces, at = [], 0
    for k, size in enumerate(sizes):
        end = at
        while size:
            size -= audit[end] != "I"
            end += 1
        if k == len(sizes) - 1:
            end = len(audit)
        pieces.append(audit[at:end])
        at = end
    after, out = 0, []
    for piece in reversed(pieces):
        out.append((piece, after))
        after += len(piece) - piece.count("D")
    return out[::-1]


_TOTAL_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<piece:string,after:bigint>>"
_TOTAL = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("pieces", pa.list_(pa.struct([("piece", pa.string()), ("after", pa.int64())])))])


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            cost, audit = cheapest(_as_matrix(r["matrix"]))
            gaps = 0 if r["low"] is None else r["high"] - r["low"] + 1 - r["n_turns"]
            pieces = [{"piece": p, "after": n} for p, n in _split(audit, r["sizes"])]
            out.append({c: r[c] for c in ("conv_id", "blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost, "audit": audit, "pieces": pieces})
        yield pa.RecordBatch.from_pylist(out, _TOTAL)


def conversation_totals(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, numbered chunks): one row a conversation (:data:`_TOTAL_SQL`) and the chunks with their place in it (``ord``).

    Only conversations that meet a partition's border or have several chunks are reduced, as a tree of ``FAN_IN`` chunks a step.
    """
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "chunk")).cast("long") - 1
    small = chunks.filter("open").select("conv_id", "part", "chunk", order.alias("ord"))
    numbered = chunks.alias("c").join(small.alias("s"), ["part", "chunk"], "left").select("c.*", F.coalesce("s.ord", F.lit(0).cast("long")).alias("ord"))
    sums = numbered.withColumn("sizes", F.array("n_rows")).select("open", *_SUM.names)
    now = sums.filter("open").drop("open")
    longest = small.agg(F.max("ord")).first()[0] or 0
    while longest:
        now = now.groupBy("conv_id", F.floor(F.col("ord") / FAN_IN).alias("step")).applyInArrow(_reduce, _SUM_SQL)
        longest //= FAN_IN
    whole = sums.filter("not open").drop("open").unionByName(now)
    return whole.mapInArrow(_total, _TOTAL_SQL), numbered


_TURNS_SQL = "conv_id long, ord long, turns array<struct<edit:string,role:string,text:string>>"
_TURNS = pa.schema([("conv_id", pa.int64()), ("ord", pa.int64()), ("turns", pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])))])


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            out = []
            for r in batch.slice(at, 64).to_pylist():
                rows = [(x["role"], x["text"]) for x in r["rows"]]
                turns = [{"edit": e, "role": role, "text": text} for e, role, text in repaired_rows(rows, r["piece"], r["after"])]
                out.append({"conv_id": r["conv_id"], "ord": r["ord"], "turns": turns})
            yield pa.RecordBatch.from_pylist(out, _TURNS)


def _repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, turns of chunks in order)."""
    totals, chunks = conversation_totals(conversation_chunks(rows))
    totals = stored(totals, "repair-totals")
    pieces = totals.select("conv_id", F.posexplode("pieces").alias("ord", "p")).select("conv_id", F.col("ord").cast("long").alias("ord"), "p.*")
    joined = _join_same(chunks, pieces, ["conv_id", "ord"]).select("conv_id", "ord", "rows", "piece", "after")
    return totals, joined.mapInArrow(_turns, _TURNS_SQL)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, chunk, place, edit, role, text): the turns of all repaired conversations, in the order of chunk and place; deleted ones are left out."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    _, turns = _repair(conversations.select("conv_id", "turn", said("role"), said("text"), F.lit(1).cast("long").alias("copies")))
    return turns.select("conv_id", F.col("ord").alias("chunk"), F.posexplode("turns").alias("place", "t")).select("conv_id", "chunk", "place", "t.*")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's sorted chunks, fed one chunk at a time."""
    now, digest, begun, done = None, None, False, []
    for batch in batches:
        for conv_id, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist()):
            if digest is None or conv_id != now:
                if digest is not None:
                    done.append((now, digest.hexdigest()))
                now, digest, begun = conv_id, hashlib.sha256(), False
            if lines is not None:
                digest.update((("\n" if begun else "") + lines).encode())
                begun = True
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], ["conv_id", "repaired_sha256"])
            done = []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])


def repair_report(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation after :func:`damage`.

    Null roles and texts are one space. Rows of one turn stand in the order of role and text, by code points; a null turn comes first. A null
    ``conv_id`` is a conversation of its own. One whose rows are all dropped has zeros, '' and the digest of nothing. Repeated
    rows count each. An empty table gives an empty table; other columns don't matter. A digest of SHA-256 is made in order, so a
    long conversation's chunks pass through one task one by one; nothing else of it meets in one place but its audit.
    """
    totals, turns = _repair(damage(conversations))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    lines = turns.select("conv_id", "ord", F.when(F.size("turns") > 0, F.array_join(said, "\n")).alias("lines"))
    digests = lines.repartition("conv_id").sortWithinPartitions("conv_id", "ord").select("conv_id", "lines").mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    return _join_same(totals, digests, ["conv_id"]).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


#: The same in DuckDB: rows are walked in order with the least (cost, audit) of each of the four states.
REPAIR_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
struck AS (
  SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, byte)),
    4294967295::BIGINT), 4294967295) % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM struck, (VALUES (1), (2)) c(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
faults AS (
  SELECT *, lag(role[:1]) OVER (PARTITION BY conv_id ORDER BY n) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
walk AS (
  SELECT conv_id, 0::BIGINT AS n, {'c': 0::BIGINT, 'a': ''} AS v0, {'c': 1000000000000::BIGINT, 'a': ''} AS v1, {'c': 1000000000000::BIGINT, 'a': ''} AS v2, {'c': 1000000000000::BIGINT, 'a': ''} AS v3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, {'c': w0.c + 2, 'a': w0.a || 'D'},
    list_min([{'c': w1.c + 2, 'a': w1.a || 'D'}, {'c': w0.c + CASE WHEN r = 's' THEN more ELSE 1000000000000 END, 'a': w0.a || 'K'}]),
    list_min([{'c': w2.c + 2, 'a': w2.a || 'D'}, {'c': to_u.c + more + (r <> 'u')::BIGINT, 'a': to_u.a || CASE r WHEN 'u' THEN 'K' ELSE 'R' END}]),
    list_min([{'c': w3.c + 2, 'a': w3.a || 'D'}, {'c': w2.c + more + (r <> 'a')::BIGINT, 'a': w2.a || CASE r WHEN 'a' THEN 'K' ELSE 'R' END}])
  FROM (SELECT *, list_min([w0, w1, w3]) AS to_u FROM (
    SELECT f.conv_id, f.n, f.role[:1] AS r, CASE f.fault WHEN '' THEN 0 WHEN 'truncated' THEN 5 ELSE 1000000000000 END::BIGINT AS more, v0 AS w0, v1 AS w1,
      list_min([v2, {'c': v0.c + 5, 'a': v0.a || 'I'}, {'c': v1.c + 5, 'a': v1.a || 'I'}, {'c': v3.c + 5, 'a': v3.a || 'I'}]) AS w2,
      list_min([v3, {'c': v2.c + 5, 'a': v2.a || 'I'}, {'c': v0.c + 10, 'a': v0.a || 'II'}, {'c': v1.c + 10, 'a': v1.a || 'II'}]) AS w3
    FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1))),
ends AS (
  SELECT conv_id, list_min([v0, v3, {'c': v2.c + 5, 'a': v2.a || 'I'}, {'c': v1.c + 10, 'a': v1.a || 'II'}]) AS best
  FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
letters AS (
  SELECT conv_id, p, best.a[p] AS e, len(regexp_replace(best.a[:p], 'I', '', 'g')) AS n, len(regexp_replace(best.a[p + 1:], 'D', '', 'g')) AS behind
  FROM ends, range(1, 1000000) r(p) WHERE p <= len(best.a)),
lines AS (
  SELECT l.conv_id, string_agg(CASE e WHEN 'K' THEN f.role ELSE CASE behind % 2 WHEN 0 THEN 'assistant' ELSE 'user' END END || ':' || CASE e WHEN 'I' THEN '' ELSE f.text END, chr(10) ORDER BY p) AS t
  FROM letters l LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.n = l.n WHERE e <> 'D' GROUP BY l.conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (n > 1 AND before || role[:1] NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT e.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
  coalesce(c.illegal, 0)::BIGINT AS illegal, e.best.c AS cost, e.best.a AS audit, sha256(coalesce(l.t, '')) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM e.conv_id
"""
