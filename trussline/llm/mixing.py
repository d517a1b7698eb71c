"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from trussline.llm.common import drop_stored, stored

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all sizes that the mix takes, and how often a source may repeat.
SHARE, REPEATS = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source that are summed in one window, about.
BUCKET_ROWS = 65536
#: Copies of one row that a task counts up at once.
CHUNK = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _placed_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with non-null stand-ins of source (__src) and id (__key) and the number of words (__size)."""
    return docs.withColumns(
        {
            "__src": F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source"))),
            "__key": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))),
            "__size": word_count(F.col("text")),
        }
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets of a table (__src, source_size), one row a source.

    A source gets its weight's part of the total, but no more than ``REPEATS`` times its size; what is left over goes to
    the others by weight. In order of cap over weight, the full ones come first, so one pass of running sums finds the
    level at which the rest stays below its caps. The table has one row a source, whatever the corpus.
    """
    by_name = Window.orderBy(F.col("__src") == "", "__src")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    rows = sizes.select("__src", "source_size", weight.cast("double").alias("w"), (F.col("source_size") * REPEATS).cast("double").alias("cap"))
    filling = Window.orderBy(F.col("cap") / F.col("w"), "__src")
    full_before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(every)
    level = rows.withColumn("level", (SHARE * total - full_before) / open_weight)
    fits = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "__src", "level"))).over(every)
    first = level.withColumn("level", F.coalesce(fits["level"], F.lit(0.0)))
    return first.select("__src", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


@dataclass(frozen=True)
class _Queue:
    """The groups of equal (__src, __key, __size) with the words ``base`` of their source before them, and where the mix ends."""

    groups: DataFrame
    width: int
    bin: int | None
    last: Row | None

    def copies(self) -> DataFrame:
        """One row for each row of the table; large groups are dealt out in chunks before their copies are counted up."""
        few = self.groups.filter(F.col("n") <= CHUNK).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
        chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))
        many = self.groups.filter(F.col("n") > CHUNK).withColumn("chunk", chunk).repartition("__key", "chunk")
        first = F.col("chunk") * CHUNK
        return few.unionByName(many.withColumn("copy", F.explode(F.sequence(first + 1, F.least("n", first + CHUNK)))).drop("chunk"))

    def taken(self, k: int) -> Column:
        """1 where pass ``k`` of a copy is inside the mix, else 0."""
        if self.bin is None:
            return (F.col("__size") > 0).cast("int")
        finish = _finish(k)
        place = F.floor(finish * self.width)
        inside = place < F.lit(self.bin)
        if self.last:
            # written out, so that the plan shows the order
            tie = [finish, F.col("__src"), F.col("__key"), F.col("__size"), F.col("copy"), F.lit(k)]
            upto = F.lit(True)
            for value, bound in reversed(list(zip(tie, self.last))):
                upto = (value < F.lit(bound)) | ((value == F.lit(bound)) & upto)
            inside = inside | ((place == F.lit(self.bin)) & upto)
        return F.coalesce((inside & (F.col("__size") > 0)).cast("int"), F.lit(0))


def _finish(k: int) -> Column:
    """Virtual finish time of pass ``k`` of a copy."""
    done = F.col("base") + F.col("copy") * F.col("__size")
    return (done + k * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target"))


def _queue(docs: DataFrame) -> _Queue:
    keyed = _placed_keys(docs.select("doc_id", "source", "text"))
    sized = stored(keyed.groupBy("__src", "__key", "__size").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n")), "mix-sizes")
    rows = sized.agg(F.sum("n")).first()[0] or 0
    bits = max(6, math.ceil(math.log2(max(1, rows / BUCKET_ROWS))))
    place = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
    bucketed = sized.withColumns({"bucket": F.shiftright(place, 32 - bits), "words": F.col("__size") * F.col("n")})

    # running sums in two levels: over the buckets of a source, then inside a bucket
    buckets = stored(bucketed.groupBy("__src", "bucket").agg(F.sum("words").alias("words")), "mix-buckets")
    targets = source_targets(buckets.groupBy("__src").agg(F.sum("words").alias("source_size")))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("__src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = buckets.select("__src", "bucket", before.alias("before")).join(targets, "__src")
    inside = F.sum("words").over(Window.partitionBy("__src", "bucket").orderBy("__key", "__size").rowsBetween(Window.unboundedPreceding, 0))
    queued = bucketed.withColumn("inside", inside).join(offsets, ["__src", "bucket"]).withColumn("base", F.col("before") + F.col("inside") - F.col("words"))
    groups = stored(queued.select("__src", "__key", "__size", "doc_id", "n", "base", "source_size", "target"), "mix-queue")
    drop_stored(sized)
    drop_stored(buckets)

    # global order by finish time: bins, then the rows of the bin in which the budget ends
    budget = SHARE * (groups.agg(F.sum(F.col("__size") * F.col("n"))).first()[0] or 0)
    width = 1 << max(8, bits)
    each = _Queue(groups, width, None, None).copies().filter("__size > 0")
    each = each.select("__src", "__key", "__size", "copy", F.posexplode(F.array(*[_finish(k) for k in range(REPEATS)])).alias("pass", "finish"))
    each = each.withColumn("bin", F.floor(F.col("finish") * width))
    running = F.sum("words").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    ends = each.groupBy("bin").agg(F.sum("__size").alias("words")).withColumn("running", running).filter(F.col("running") > budget)
    cut = ends.orderBy("bin").select("bin", (F.col("running") - F.col("words")).alias("before")).first()
    if not cut:
        return _Queue(groups, width, None, None)
    order = ["finish", "__src", "__key", "__size", "copy", "pass"]
    inner = F.sum("__size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    tail = each.filter(F.col("bin") == cut["bin"]).withColumn("running", inner + F.lit(cut["before"]))
    last = tail.filter(F.col("running") <= budget).orderBy(*[F.desc(c) for c in order]).select(*order).first()
    return _Queue(groups, width, cut["bin"], last)


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row.

    Documents are shuffled by the md5 of their id; each of a document's two possible passes finishes at the words of its
    source so far over the source's target. All passes are ordered by finish time and cut where the words reach 150 % of
    the corpus. Null texts have size 0 and are not taken; null sources form a source of their own, last in order.
    Repeated rows queue one behind another, each with a finish of its own, so a source's words end within one row of its
    target. An empty table gives an empty table; other columns are ignored. The same rows give the same mix.
    """
    queue = _queue(docs)
    passes = sum((queue.taken(k) for k in range(1, REPEATS)), queue.taken(0))
    return queue.copies().select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * passes).alias("taken"))


_GROUP = ["__src", "__key", "__size"]


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with their number (__copy, from 1) in their group, in the order of a hash of all their columns.

    Equal rows are told apart by the partition that wrote them, which is as good as any other order of them. Counts of
    (hash, partition) are summed in ranges of hashes, so no window holds a whole group.
    """
    hashed = stored(rows.withColumns({"__hash": F.xxhash64(F.to_json("__row")), "__part": F.spark_partition_id()}), "mix-rows")
    cells = hashed.groupBy(*_GROUP, "__hash", "__part").agg(F.count("*").alias("__cell")).withColumn("__range", F.shiftright("__hash", 52))
    ranges = cells.groupBy(*_GROUP, "__range").agg(F.sum("__cell").alias("__held"))
    earlier = lambda held, by, order: F.coalesce(F.sum(held).over(Window.partitionBy(*_GROUP, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*_GROUP, "__range", earlier("__held", [], ["__range"]).alias("__ranges"))
    cells = cells.withColumn("__cells", earlier("__cell", ["__range"], ["__hash", "__part"])).join(ranges, [*_GROUP, "__range"])
    cells = cells.select(*_GROUP, "__hash", "__part", (F.col("__ranges") + F.col("__cells")).alias("__first"))
    nth = F.row_number().over(Window.partitionBy(*_GROUP, "__hash", "__part").orderBy("__hash"))
    return hashed.withColumn("__nth", nth).join(cells, [*_GROUP, "__hash", "__part"]).withColumn("__copy", F.col("__first") + F.col("__nth"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with their columns; a row taken twice comes twice.

    Where the mix ends inside a group of rows of one id, source and size, the first of them by a hash of all columns are taken.
    """
    queue = _queue(docs)
    counts = [F.sum(queue.taken(k)).alias(f"__pass{k}") for k in range(REPEATS)]
    single = queue.groups.filter("n = 1").withColumn("copy", F.lit(1).cast("long")).select(*_GROUP, "n", *[queue.taken(k).cast("long").alias(f"__pass{k}") for k in range(REPEATS)])
    repeated = _Queue(queue.groups.filter("n > 1"), queue.width, queue.bin, queue.last).copies().groupBy(*_GROUP, "n").agg(*counts)
    taken = single.unionByName(repeated).withColumnRenamed("n", "__n").filter("__pass0 > 0")
    # the caller's columns travel in a struct, so that none of them meets a name used here
    rows = _placed_keys(docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "source", "text")).join(taken, _GROUP)
    whole = " and ".join(f"__pass{k} in (0, __n)" for k in range(REPEATS))
    passes = lambda copy: sum(((copy <= F.col(f"__pass{k}")).cast("int") for k in range(1, REPEATS)), (copy <= F.col("__pass0")).cast("int"))
    plain = rows.filter(whole).select("__row", passes(F.lit(1)).alias("__passes"))
    parted = taken.filter(f"not ({whole})").limit(1).count()
    if parted:
        cut = _numbered(rows.filter(f"not ({whole})").select("__row", *_GROUP, *[f"__pass{k}" for k in range(REPEATS)]))
        plain = plain.unionByName(cut.select("__row", passes(F.col("__copy")).alias("__passes")).filter("__passes > 0"))
    return plain.withColumn("__pass", F.explode(F.sequence(F.lit(1), F.col("__passes")))).select("__row.*")


#: The same mix in DuckDB, over all documents.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS src, md5(coalesce(doc_id::VARCHAR, '-')) AS k
  FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY src, k, size) AS copy FROM sized),
total AS (SELECT src, sum(size)::BIGINT AS source_size FROM sized GROUP BY src),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY src = '', src) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         (2 * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS alls
  FROM total),
levels AS (
  SELECT *, (1.5::DOUBLE * alls - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT src, source_size, least(cap, coalesce((SELECT level FROM levels WHERE level <= cap / w ORDER BY cap / w, src LIMIT 1), 0) * w) AS target FROM levels),
queued AS (
  SELECT s.*, t.source_size, t.target, (sum(size) OVER (PARTITION BY s.src ORDER BY k, size, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS done
  FROM numbered s JOIN targets t ON s.src = t.src),
passes AS (
  SELECT *, (done + pass * source_size)::DOUBLE / nullif(target, 0) AS finish FROM queued, (VALUES (0), (1)) p(pass) WHERE size > 0),
cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, src, k, size, copy, pass ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM passes),
took AS (
  SELECT src, k, size, copy, count(*) AS n FROM cut WHERE running <= 1.5 * (SELECT sum(size) FROM sized) GROUP BY src, k, size, copy)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(t.n, 0))::BIGINT AS taken
FROM queued q LEFT JOIN took t ON q.src = t.src AND q.k = t.k AND q.size = t.size AND q.copy = t.copy
"""
