import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest

from trussline.llm import repair

CONV = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")


def plain(rows, most_inserts=2):
    """Cheapest edits of (role, text, fault) rows by trying all; returns (cost, audit, lines)."""
    best = None
    choices = []
    for role, text, fault in rows:
        own = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            extra = 5 * (fault == "truncated")
            own += [("K", extra, (role, text)), *[("R", 1 + extra, (r, text)) for r in ("user", "assistant")]]
        choices.append(own)
    slots = [[()] + [c for n in range(1, most_inserts + 1) for c in itertools.product(("user", "assistant"), repeat=n)]] * (len(rows) + 1)
    for edits in itertools.product(*choices):
        base = sum(e[1] for e in edits)
        for puts in itertools.product(*slots):
            cost = base + 5 * sum(map(len, puts))
            if best and cost > best[0]:
                continue
            audit, turns = "", []
            for k in range(len(rows) + 1):
                audit += "I" * len(puts[k])
                turns += [(r, "") for r in puts[k]]
                if k < len(rows):
                    audit += edits[k][0]
                    turns += [edits[k][2]] if edits[k][2] else []
            if GRAMMAR.fullmatch("".join(r[:1] for r, _ in turns)) and all(r for r, _ in turns) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, turns)
    return best


def by_sql(rows):
    """The whole contract over [(conv_id, turn, role, text)], by the SQL."""
    c = duckdb.connect()
    c.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: r[1:] for r in c.execute(f"select conv_id, {', '.join(names)} from ({repair.REPAIR_SQL})").fetchall()}


def as_report(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}


@pytest.mark.parametrize("seed", range(40))
def test_products_find_the_cheapest_edits(seed):
    draw = random.Random(seed)
    rows = [(draw.choice(["system", "user", "assistant", "tool", ""]), f"t{k}.", draw.choice(["", "", "", "truncated", "blank", "duplicate"])) for k in range(draw.randint(0, 3))]
    kinds = "".join("-" if f in ("blank", "duplicate") else {"s": "s", "u": "u", "a": "a"}.get(r[:1], "?") if not f else {"s": "S", "u": "U", "a": "A"}.get(r[:1], "X") for r, _, f in rows)
    cost, audit, turns = plain(rows)
    assert repair.cheapest(repair.rows_matrix(kinds)) == (cost, audit)
    assert [(r, t) for _, r, t in repair.repaired_rows([(r, t) for r, t, _ in rows], audit, 0)] == turns


def test_products_associate():
    draw = random.Random(5)
    for _ in range(200):
        kinds = "".join(draw.choice("suaSUA?X-") for _ in range(draw.randint(3, 40)))
        a, b = sorted(draw.sample(range(len(kinds) + 1), 2))
        x, y, z = (repair.rows_matrix(k) for k in (kinds[:a], kinds[a:b], kinds[b:]))
        one, two = repair.product(repair.product(x, y), z), repair.product(x, repair.product(y, z))
        folded = repair.IDENTITY
        for k in kinds:
            folded = repair.product(folded, repair.turn_matrix(k))
        assert one == two == folded


def cases():
    draw = random.Random(1)
    rows = []
    for conv in range(60):
        for turn in range(draw.randint(1, 3)):
            rows.append((conv, draw.choice([turn, turn, turn + 3, None]), draw.choice(["user", "assistant", "system", None, "tool", ""]), draw.choice(["Yes.", "Yes.", "no", None, " \t\n", "Why?  ", "é ", "日本。"])))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yo."), (None, None, None, None)]
    return rows


def test_report_equals_row_by_row(spark):
    assert as_report(repair.repair_report(spark.createDataFrame(cases(), CONV))) == by_sql(cases())


def long_conversation():
    draw = random.Random(2)
    return [(7, k // 2, draw.choice(["user", "assistant", "system"]), draw.choice(["Ja.", "Nein.", "so", f"t{k}."])) for k in range(300)]


def test_partitions_change_nothing(spark):
    rows = long_conversation() + [(c, 0, "user", "Hi.") for c in range(6)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert as_report(repair.repair_report(spark.createDataFrame(rows, CONV).repartition(5))) == by_sql(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("size", [1, 7, 50])
def test_chunks_multiply_to_the_whole(monkeypatch, size):
    monkeypatch.setattr(repair, "FAN_IN", 3)
    rows, seen = sorted(((t, r, x) for _, t, r, x in long_conversation())), set()
    whole, chunks = repair.Chunk(7, 0, 0), []
    for k, (turn, role, text) in enumerate(rows):
        if k % size == 0:
            chunks.append(repair.Chunk(7, 0, k))
        for chunk in (whole, chunks[-1]):
            chunk.add(turn, role, text, 1, (role, text) not in seen)
        seen.add((role, text))
    record = lambda c, k: {x: v for x, v in c.record(True).items() if x in repair._SUM.names} | {"ord": k, "sizes": [len(c.rows)]}
    level = [record(c, k) for k, c in enumerate(chunks)]
    while len(level) > 1:
        groups = {}
        for r in level:
            groups.setdefault(r["ord"] // 3, []).append(r)
        level = [repair._reduce(pa.Table.from_pylist(g[::-1], repair._SUM)).to_pylist()[0] for g in groups.values()]
    want = record(whole, 0)
    assert {k: v for k, v in level[0].items() if k not in ("sizes", "ord")} == {k: v for k, v in want.items() if k not in ("sizes", "ord")}
    cost, audit = repair.cheapest(repair._as_matrix(want["matrix"]))
    pieces = repair._split(audit, level[0]["sizes"])
    parts = [t for c, (piece, after) in zip(chunks, pieces) for t in repair.repaired_rows([(r["role"], r["text"]) for r in c.rows], piece, after)]
    assert parts == list(repair.repaired_rows([(r["role"], r["text"]) for r in whole.rows], audit, 0)) and len(parts) > 50


def test_repeated_rows_and_extra_columns(spark):
    rows = [(1, 0, "user", "Hi.")] * 40 + [(1, 1, "assistant", "Yo.")] + [(2, None, "x", "")] * 3
    frame = spark.createDataFrame([(*r, 5, "z") for r in rows], CONV + ", n long, digest string")
    got = as_report(repair.repair_report(frame))
    assert got[1][2] >= 39 and got[1][6].count("K") <= 2 and got[2][1] >= 3 and got[2][6] in ("DDD", "")


def test_dropped_conversations_and_empty_tables(spark):
    dropped = next((c, t) for c in range(50) for t in range(50) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = as_report(repair.repair_report(spark.createDataFrame([(*dropped, "user", "Hi.")], CONV)))
    assert got == {dropped[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repair_report(spark.createDataFrame([], CONV)).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Again."), (2, 0, "user", "Bye.")]
    got = repair.repair_conversations(spark.createDataFrame(rows, CONV)).orderBy("conv_id", "chunk", "place").drop("chunk", "place").collect()
    assert list(map(tuple, got)) == [(1, "K", "system", "Be kind."), (1, "R", "user", "Hello."), (1, "K", "assistant", "Again.")]


def test_very_long_texts(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "y" * 2_000_000 + "."), (1, 2, "user", "z.")]
    got = as_report(repair.repair_report(spark.createDataFrame(rows, CONV)))
    assert got == by_sql(rows)
