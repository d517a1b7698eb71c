"""Context selection: records in order of a profile, packed into chunks within token budgets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.functions.canon import token_estimate
from trussline.model import CONTEXT_ORDER, rank
from trussline.storage import in_runs


@dataclass(frozen=True)
class Budget:
    """Tokens of the whole context and of a chunk, and what the headers and the index cost in bytes.

    The index names every chunk and both counts, so its size is that of its other text (``index_bytes`` where the
    sections don't say) plus the link of each chunk and the digits of the counts.
    """

    tokens: int = 40_000
    chunk_tokens: int = 4_000
    header: str = "# Context chunk {}\n\n"
    index_bytes: int = 400
    link: str = "- [chunk-{0:03d}.md](chunk-{0:03d}.md)\n"
    no_link: str = "- No record chunks fit the selected budget.\n"


def priority(record_type: Column, profile: str = "agent") -> Column:
    """Place of a record type in a profile; types it doesn't name come last."""
    if profile not in CONTEXT_ORDER:
        raise ValueError(f"unknown context profile: {profile}")
    return rank(record_type, CONTEXT_ORDER[profile], other=9)


def section(record_id: Column, record_type: Column, path: Column, line: Column, canonical: Column) -> Column:
    """A record as Markdown, with where it stands in the package."""
    return F.format_string("## `%s` (%s)\n\nAuthority: `%s:%d`\n\n```json\n%s\n```\n", record_id, record_type, path, line, canonical)


class Packer:
    """Takes sections in order and admits those that fit; keeps sums only, so a package of any size is a stream.

    A section above the chunk budget is left out. Another is admitted if index and chunks with it stay within the
    budget; one that doesn't fit is left out, and later, smaller ones may still fit. A chunk ends where the next
    section would take it past its budget.
    """

    def __init__(self, budget: Budget, total: int, index_bytes: int | None = None):
        self.budget, self.total = budget, total
        self.index_bytes = budget.index_bytes if index_bytes is None else index_bytes
        self.admitted = self.chunk = self.closed_tokens = self.chunk_bytes = 0
        self.link_bytes = 0

    def _index(self, admitted: int, chunks: int, links: int) -> int:
        listed = links if chunks else len(self.budget.no_link)
        return self.index_bytes + listed + len(str(admitted)) + len(str(self.total - admitted))

    def offer(self, size: int) -> int | None:
        """The number of the chunk that takes a section of ``size`` bytes, or None."""
        b = self.budget
        if -(-size // 4) > b.chunk_tokens:
            return None
        chunk, closed, links = self.chunk, self.closed_tokens, self.link_bytes
        held = self.chunk_bytes + size
        if not chunk or -(-held // 4) > b.chunk_tokens:
            closed += -(-self.chunk_bytes // 4)
            chunk += 1
            links += len(b.link.format(chunk))
            held = len(b.header.format(chunk)) + size
        if -(-self._index(self.admitted + 1, chunk, links) // 4) + closed + -(-held // 4) > b.tokens:
            return None
        self.admitted, self.chunk, self.closed_tokens, self.chunk_bytes, self.link_bytes = self.admitted + 1, chunk, closed, held, links
        return chunk


def pack(sections: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(package_id, place, record_id, chunk) with a null chunk for sections left out.

    ``sections`` has package_id, place (the order), record_id, size (UTF-8 bytes), total (sections of the package) and, if
    it likes, index_bytes (the index of the package without links and counts).
    Packages meet in sorted runs and pass the packer row by row, so none is held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packer = None, None
        for batch in batches:
            chunks = []
            for package, size, total, index in zip(*(batch.column(c).to_pylist() for c in ("package_id", "size", "total", "index_bytes"))):
                if packer is None or package != now:
                    now, packer = package, Packer(budget, total, index)
                chunks.append(packer.offer(size))
            yield pa.RecordBatch.from_arrays([batch.column("package_id"), batch.column("place"), batch.column("record_id"), pa.array(chunks, pa.int64())], ["package_id", "place", "record_id", "chunk"])

    types = {f.name: f.dataType.simpleString() for f in sections.schema}
    index = "index_bytes" if "index_bytes" in sections.columns else F.lit(budget.index_bytes).alias("index_bytes")
    dealt = in_runs(sections.select("package_id", "place", "record_id", "size", "total", index), ["package_id"], F.col("place").asc_nulls_last())
    return dealt.mapInArrow(run, f"package_id {types['package_id']}, place {types['place']}, record_id {types['record_id']}, chunk long")


def index_text(packages: DataFrame, profile: str, budget: Budget, estimate: Column, included: Column, omitted: Column, links: Column) -> Column:
    """The index of a context; ``packages`` has package_id, logical_digest and, as JSON texts, capabilities and losses."""
    part = lambda name, value: F.concat(F.lit(f"- {name}: "), value.cast("string"), F.lit("\n"))
    quoted = lambda name: F.concat(F.lit("`"), F.coalesce(packages[name].cast("string"), F.lit("")), F.lit("`"))
    return F.concat(
        F.lit("# Context index\n\n"),
        part("Package", quoted("package_id")),
        part("Digest", quoted("logical_digest")),
        part("Profile", F.lit(profile)),
        part("Token budget", F.lit(budget.tokens)),
        part("Token estimate", estimate),
        part("Records in the context", included),
        part("Records left out", omitted),
        part("Capabilities", quoted("capabilities")),
        part("Losses", quoted("losses")),
        F.lit("\n## Chunks\n\n"),
        links,
        F.lit("\nThis is a selection; exact questions go to the records themselves.\n"),
    )


def render(sections: DataFrame, packages: DataFrame, profile: str = "agent", budget: Budget = Budget()) -> DataFrame:
    """(package_id, path, content, tokens): the index and the chunks of each package's context.

    ``sections`` is as for :func:`pack`, with the text as ``section``. Sections are admitted against the size of the
    package's own index with six digits for the estimate; the estimate itself then stands in it. What meets in one row is bounded
    by the budgets of a chunk and of the context. A package without sections has an index only. Sections of one place come
    by record id and text.
    """
    each = Window.partitionBy("package_id").orderBy("place", "record_id", "section")
    sections = sections.withColumn("place", F.row_number().over(each))
    blank = F.lit("")
    sized = packages.withColumn("index_bytes", F.octet_length(index_text(packages, profile, budget, F.lit("9" * 6), blank, blank, blank)).cast("long"))
    measured = sections.join(sized.select("package_id", "index_bytes"), "package_id")
    packed = pack(measured, budget)
    taken = packed.filter("chunk is not null").join(sections.select("package_id", "place", "section"), ["package_id", "place"])
    body = F.array_join(F.array_sort(F.collect_list(F.struct("place", "section")))["section"], "")
    header = F.replace(F.lit(budget.header), F.lit("{}"), F.col("chunk").cast("string"))
    number = F.when(F.col("chunk") < 1000, F.lpad(F.col("chunk").cast("string"), 3, "0")).otherwise(F.col("chunk").cast("string"))
    chunks = taken.groupBy("package_id", "chunk").agg(F.count("*").alias("n"), body.alias("body")).select("package_id", "n", F.concat(F.lit("chunk-"), number, F.lit(".md")).alias("name"), "chunk", F.concat(header, "body").alias("content"))
    chunks = chunks.withColumn("tokens", token_estimate(F.col("content")))
    link = F.concat(F.lit("- ["), F.col("name"), F.lit("]("), F.col("name"), F.lit(")\n"))
    links = F.array_join(F.array_sort(F.collect_list(F.struct("chunk", link.alias("link"))))["link"], "")
    sums = chunks.groupBy("package_id").agg(F.sum("n").alias("included"), F.sum("tokens").alias("chunk_tokens"), links.alias("links"))
    totals = sections.groupBy("package_id").agg(F.count("*").alias("total"))
    zero = F.lit(0).cast("long")
    whole = packages.join(totals, "package_id", "left").join(sums, "package_id", "left").withColumns({"included": F.coalesce("included", zero), "total": F.coalesce("total", zero), "chunk_tokens": F.coalesce("chunk_tokens", zero), "links": F.coalesce("links", F.lit(budget.no_link))})
    told = lambda estimate: index_text(whole, profile, budget, estimate, F.col("included"), F.col("total") - F.col("included"), F.col("links"))
    estimate = token_estimate(told(F.lit("9" * 6))) + F.col("chunk_tokens")
    index = whole.withColumn("estimate", estimate).select("package_id", F.lit("context/index.md").alias("path"), told(F.col("estimate")).alias("content"))
    index = index.withColumn("tokens", token_estimate(F.col("content")))
    return index.union(chunks.select("package_id", F.concat(F.lit("context/"), "name"), "content", "tokens"))
