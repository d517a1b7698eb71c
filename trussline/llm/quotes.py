"""Chat formatting by quotation linking: quoted passages find their messages, and replies are put in order."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trussline.llm.common import drop_stored, map_rows, stored

_QUOTE = re.compile(r"(?:[ \t]*>)+[ \t]?")
_CREDIT = re.compile(r"(?:On .{4,200} wrote:|.{1,80} (?:wrote|said|writes):|-{2,} ?Original Message ?-{2,})[ \t]*")
_BLANKS = re.compile(r"\s+")
#: Turns of a stretch in which the turn before is looked up; stretches meet through their last turns.
STRETCH = 1024


def parse_quotes(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(the text without quotes, [(level, passage)]) of a message.

    A line's level is the number of ``>`` before it; lines of one level in a row are one passage. A line that credits the
    quote right below it goes with the quote. The rest keeps its line ends, without blank lines at either end.
    """
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        mark = _QUOTE.match(line)
        level = mark[0].count(">") if mark else 0
        if not level:
            own.append(line)
        elif level == last:
            passages[-1][1].append(line[mark.end() :])
        else:
            if not last:
                while own and not own[-1].strip():
                    own.pop()
                if own and _CREDIT.fullmatch(own[-1].strip()):
                    own.pop()
            passages.append((level, [line[mark.end() :]]))
        last = level
    return "\n".join(own).strip("\n"), [(level, "\n".join(lines)) for level, lines in passages]


def normalised(passage: str) -> str:
    """Lower case, white space as single spaces."""
    return _BLANKS.sub(" ", passage.lower()).strip()


#: Modulus (a prime) and base of the polynomials that stand for runs of lines.
_PRIME, _BASE = (1 << 127) - 1, 0x2545F4914F6CDD1D9E3779B97F4A7C15


def _lines(text: str) -> list[str]:
    return [n for line in text.split("\n") if (n := normalised(line))]


class Runs:
    """Names of runs of consecutive lines, each in constant time."""

    def __init__(self, lines: list[str]):
        self.sums, self.powers = [0], [1]
        for line in lines:
            self.sums.append((self.sums[-1] * _BASE + int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest())) % _PRIME)
            self.powers.append(self.powers[-1] * _BASE % _PRIME)

    def __len__(self) -> int:
        return len(self.sums) - 1

    def name(self, at: int, n: int) -> str:
        return f"{n}:{(self.sums[at + n] - self.sums[at] * self.powers[n]) % _PRIME:032x}"

    def of_size(self, n: int) -> Iterator[tuple[int, str]]:
        return ((k, self.name(k, n)) for k in range(len(self) - n + 1))


def half(n: int) -> int:
    """The largest power of two up to ``n``: a block of it at each end covers a run of ``n`` lines."""
    return 1 << (n.bit_length() - 1)


def held_runs(lines: list[str], asked: list[dict]) -> set[str]:
    """Names of the asked runs (lines, run, anchor, at) that these lines hold.

    ``anchor`` names the block that starts ``at`` lines into the run; only where it stands is the whole run compared.
    """
    runs = Runs(lines)
    places: dict[str, list[int]] = {}
    for n in {half(a["lines"]) for a in asked}:
        for k, name in runs.of_size(n):
            places.setdefault(name, []).append(k)
    fits = lambda k, a: 0 <= k and k + a["lines"] <= len(runs) and runs.name(k, a["lines"]) == a["run"]
    return {a["run"] for a in asked if any(fits(k - a["at"], a) for k in places.get(a["anchor"], ()))}


def _parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, quotes array<struct<level,text,lines,run,head,tail>>, parts array<string>) of each distinct message.

    ``parts`` holds the normalised body, its paragraphs and its lines: what others may quote of it. ``lines`` counts the
    lines of a passage that are not blank, ``run`` names them, ``head`` and ``tail`` their first and last :func:`half` (null
    for one line).
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    quote = pa.struct([("level", pa.int32()), ("text", pa.string()), ("lines", pa.int32()), ("run", pa.string()), ("head", pa.string()), ("tail", pa.string())])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            bodies, quotes, parts = [], [], []
            for text in batch.column(3).to_pylist():
                body, found = parse_quotes(text)
                bodies.append(body)
                own = []
                for level, p in found:
                    runs = Runs(_lines(p))
                    n = len(runs)
                    names = {"run": runs.name(0, n), "head": runs.name(0, half(n)), "tail": runs.name(n - half(n), half(n))} if n > 1 else {}
                    own.append({"level": level, "text": normalised(p), "lines": n} | names)
                quotes.append(own)
                parts.append(sorted({n for p in (body, *re.split(r"\n\s*\n", body), *body.split("\n")) if (n := normalised(p))}))
            cols = [pa.array(bodies, pa.string()), pa.array(quotes, pa.list_(quote)), pa.array(parts, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], ["conv_id", "turn", "role", "body", "quotes", "parts"])

        return work

    return map_rows(rows, "conv_id long, turn long, role string, body string, quotes array<struct<level:int,text:string,lines:int,run:string,head:string,tail:string>>, parts array<string>", make)


def _blocks(parsed: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv_id, turn, block): blocks of lines of each message that begin or end a passage of its conversation.

    A message names its blocks of the sizes asked for, powers of two, so a line is in a few names however many sizes passages have.
    """
    ends = asked.select("conv_id", F.explode(F.array("head", "tail")).alias("block")).distinct()
    sizes = asked.groupBy("conv_id").agg(F.collect_set("half").alias("sizes"))
    bodies = parsed.select("conv_id", "turn", "body").join(sizes, "conv_id")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            names = []
            for body, sizes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                runs = Runs(_lines(body))
                names.append(list({name for n in sizes for _, name in runs.of_size(n)}))
            return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(names, pa.list_(pa.string()))], ["conv_id", "turn", "names"])

        return work

    named = map_rows(bodies.select("conv_id", "turn", "body", "sizes"), "conv_id long, turn long, names array<string>", make, rows=64)
    return named.select("conv_id", "turn", F.explode("names").alias("block")).join(ends, ["conv_id", "block"], "left_semi")


def _held_runs(parsed: DataFrame, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(conv_id, turn, mark) of the runs of lines of each message that are passages of its conversation.

    A passage is looked for in the messages that have its head or its tail, whichever fewer have, and compared there.
    """
    counts = blocks.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    for end in ("head", "tail"):
        asked = asked.join(counts.select("conv_id", F.col("block").alias(end), F.col("n").alias(f"n_{end}")), ["conv_id", end])
    by_head = F.col("n_head") <= F.col("n_tail")
    anchored = asked.select("conv_id", "lines", "run", F.when(by_head, F.col("head")).otherwise(F.col("tail")).alias("block"), F.when(by_head, 0).otherwise(F.col("lines") - F.col("half")).alias("at"))
    wanted = blocks.join(anchored, ["conv_id", "block"]).groupBy("conv_id", "turn").agg(F.collect_list(F.struct("lines", "run", F.col("block").alias("anchor"), "at")).alias("asked"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            marks = [list(held_runs(_lines(body), asked)) for body, asked in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(marks, pa.list_(pa.string()))], ["conv_id", "turn", "marks"])

        return work

    bodies = parsed.select("conv_id", "turn", "body").join(wanted, ["conv_id", "turn"])
    return map_rows(bodies.select("conv_id", "turn", "body", "asked"), "conv_id long, turn long, marks array<string>", make, rows=64).select("conv_id", "turn", F.explode("marks").alias("mark"))


def quote_links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, level, place, origin): for each quoted passage the latest earlier turn of its conversation that holds it.

    A message holds a passage that is its whole body, a paragraph or a line, or a run of its lines. Both sides meet by
    conversation and hash, so a phrase that all conversations share stays apart. Runs are met by their rarer end first: rows
    grow with the lines of messages and the passages, not with their product. Nothing is paired: the latest turn is a
    running maximum over the turns of a conversation and hash, taken inside stretches of turns and carried from one to
    the next, so a line that fills an endless conversation costs a row each time. Passages that no earlier message
    holds get no row. A message of one repeated line takes time, though no rows, for each place of each run asked of it.
    """
    quoted = parsed.select("conv_id", F.explode("quotes").alias("quote")).filter("quote.lines > 1").select("conv_id", "quote.lines", "quote.run", "quote.head", "quote.tail").distinct()
    asked = stored(quoted.withColumn("half", F.expr("shiftleft(1, cast(floor(log2(lines)) as int))")), "quote-runs")
    blocks = stored(_blocks(parsed, asked), "quote-blocks")
    parts = parsed.select("conv_id", "turn", F.explode("parts").alias("part")).select("conv_id", "turn", F.sha2("part", 256).alias("mark"))
    held = parts.unionByName(_held_runs(parsed, asked, blocks)).distinct()
    passages = parsed.select("conv_id", "turn", F.posexplode("quotes").alias("place", "quote")).filter("quote.text <> ''")
    marks = F.explode(F.array_compact(F.array(F.sha2("quote.text", 256), "quote.run")))
    passages = passages.select("conv_id", "turn", "place", "quote.level", marks.alias("mark"))
    events = held.withColumn("origin", F.col("turn")).unionByName(passages, allowMissingColumns=True).withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    of_mark = ["conv_id", "mark", "stretch"]
    inside = F.max("origin").over(Window.partitionBy(*of_mark).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    ends = events.groupBy(*of_mark).agg(F.max("origin").alias("top"))
    ends = ends.select(*of_mark, F.max("top").over(Window.partitionBy("conv_id", "mark").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier")).filter("earlier is not null")
    met = events.withColumn("inside", inside).filter("place is not null").join(ends, of_mark, "left").withColumn("origin", F.coalesce("inside", "earlier"))
    links = stored(met.filter("origin is not null").groupBy("conv_id", "turn", "place", "level").agg(F.max("origin").alias("origin")), "quote-links")
    drop_stored(asked)
    drop_stored(blocks)
    return links


def _turn_before(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, before) with the turn before each of a conversation, null for the first.

    Looked up inside stretches of turns; the first of a stretch takes the last of the stretch before. So one endless
    conversation is many small windows.
    """
    cut = turns.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    ends = cut.groupBy("conv_id", "stretch").agg(F.max("turn").alias("last"))
    ends = ends.select("conv_id", "stretch", F.lag("last").over(Window.partitionBy("conv_id").orderBy("stretch")).alias("last"))
    inside = F.lag("turn").over(Window.partitionBy("conv_id", "stretch").orderBy("turn"))
    return cut.withColumn("inside", inside).join(ends, ["conv_id", "stretch"]).select("conv_id", "turn", F.coalesce("inside", "last").alias("before"))


def _branches(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, branch): the turn that heads the branch of each message, by doubling jumps to the head.

    The first reply to a message goes on in its branch, each later one heads a branch of its own.
    """
    nth = F.row_number().over(Window.partitionBy("conv_id", "reply_to").orderBy("turn"))
    heads = replies.withColumn("head", F.col("reply_to").isNull() | (nth > 1))
    forks = heads.filter("head and reply_to is not null").select("conv_id").distinct()
    plain = replies.join(forks, "conv_id", "left_anti").select("conv_id", "turn")
    first = replies.filter("reply_to is null").groupBy("conv_id").agg(F.min("turn").alias("branch"))
    jump = stored(heads.join(forks, "conv_id", "left_semi").select("conv_id", "turn", F.when(F.col("head"), F.col("turn")).otherwise(F.col("reply_to")).alias("branch")), "branches")
    while True:
        further = jump.select("conv_id", F.col("turn").alias("branch"), F.col("branch").alias("further"))
        after = stored(jump.join(further, ["conv_id", "branch"]).select("conv_id", "turn", F.col("further").alias("branch"), (F.col("further") != F.col("branch")).alias("moved")), "branches")
        drop_stored(jump)
        jump = after.drop("moved")
        if after.filter("moved").isEmpty():
            break
    return plain.join(first, "conv_id").select("conv_id", "turn", "branch").union(jump.select("conv_id", "turn", "branch"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """Messages without quotes, to be read by (conv_id, branch, turn).

    (conv_id, turn, branch, reply_to, role, text, n_quotes, n_linked, formatted). ``reply_to`` is the latest message that
    a passage of the lowest quote level comes from, else the turn before; ``branch`` is the turn that heads the branch, and
    branches in order of their heads, each by turn, put every reply behind what it answers. ``formatted`` is the chat
    template's piece. Repeated rows count once; messages of one turn share its place. Rows without a conversation or turn
    are kept, with no branch and no link; null texts are empty and null roles are "user". An empty table gives an empty
    table; other columns are ignored.
    """
    parsed = stored(_parsed(messages), "messages")
    placed = parsed.filter("conv_id is not null and turn is not null")
    links = quote_links(placed)
    lowest = links.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "origin"))["origin"].alias("quoted"), F.count("*").alias("n_linked"))
    turns = placed.select("conv_id", "turn").distinct()
    replies = _turn_before(turns).join(lowest, ["conv_id", "turn"], "left")
    replies = stored(replies.select("conv_id", "turn", F.coalesce("quoted", "before").alias("reply_to"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")), "replies")
    order = replies.join(_branches(replies), ["conv_id", "turn"])
    role = F.coalesce("role", F.lit("user"))
    return parsed.join(order, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "branch",
        "reply_to",
        role.alias("role"),
        F.col("body").alias("text"),
        F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), "body", F.lit("<|im_end|>\n")).alias("formatted"),
    )
