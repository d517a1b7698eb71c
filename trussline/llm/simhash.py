"""Near-duplicates by SimHash fingerprints, pigeonhole blocks and verified Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.llm.common import free_name, map_rows, stored
from trussline.llm.components import connected_components, local_components

#: Six blocks of the 64 bits. Fingerprints at distance 2 or less differ in at most two blocks, so four blocks agree.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
AGREE = 4
#: Groups of one key up to this size are compared pair by pair, larger ones by probing all near values of the free bits.
DIRECT = 128


def key_masks() -> list[int]:
    """Bits that form the key of each choice of agreeing blocks."""
    bits = [((1 << width) - 1) << start for start, width in BLOCKS]
    return [sum(chosen) for chosen in combinations(bits, AGREE)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(data: bytes | None) -> int:
    """Unsigned SimHash of the three-word shingles of a UTF-8 text; 0 for null and for texts without words."""
    words = data.lower().split() if data else []
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    if len(words) < 3:
        digests, n = digest(joined, 42), 1
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-3] + 1).tolist()]
        digests, n = b"".join([digest(joined[s:e], 42) for s, e in zip(starts, ends[2:].tolist())]), len(words) - 2
    raw = np.frombuffer(digests, np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(raw[at : at + 4096], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(fp, and all columns of ``docs`` but text) for every row; fp holds the 64 bits as a signed long."""
    keep = [c for c in docs.columns if c != "text"]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = [_signed(fingerprint(x)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], [*keep, "fp"])

        return work

    slim = docs.select(*keep, F.col("text").cast("binary").alias("text"))
    return map_rows(slim, slim.drop("text").withColumn("fp", F.lit(0).cast("long")).schema, make)


def near_edges(fps: np.ndarray, starts: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at distance 2 or less inside each run of ``fps``.

    ``starts`` holds the first index of each run; runs are sorted and distinct and agree outside the ``free`` bits.
    """
    sizes = np.diff(np.append(starts, len(fps)))
    left, right = [], []
    run = np.repeat(np.arange(len(starts)), sizes)
    direct = sizes <= DIRECT
    at = np.flatnonzero(direct[run])
    for d in range(1, int(sizes[direct].max(initial=0))):
        at = at[at + d < len(fps)]
        at = at[run[at] == run[at + d]]
        if not len(at):
            break
        hit = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= 2]
        left.append(hit)
        right.append(hit + d)
    bits = [1 << k for k in range(64) if free >> k & 1]
    flips = [np.uint64(m) for m in bits + [x | y for x, y in combinations(bits, 2)]]
    for s, size in zip(starts[~direct], sizes[~direct]):
        own = fps[s : s + size]
        for m in flips:
            near = own ^ m
            to = np.minimum(np.searchsorted(own, near), size - 1)
            hit = np.flatnonzero((own[to] == near) & (near > own))
            left.append(hit + s)
            right.append(to[hit] + s)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def link_blocks(fps: DataFrame) -> DataFrame:
    """Star edges (a, b) that connect all fingerprints at distance 2 or less of a table of distinct ones.

    Each fingerprint goes out under 15 keys of four agreeing blocks; rows of a key meet in one sorted run. A key leaves
    at most 22 bits open, so a run never exceeds 4 M fingerprints whatever the corpus, and copies were merged before.
    """
    masks = key_masks()
    keyed = fps.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("rule", "key"), "fp")
    dealt = keyed.repartition("rule", "key").sortWithinPartitions("rule", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

        def links(rule: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.ones(len(fp), bool)
            new[1:] = (rule[1:] != rule[:-1]) | (key[1:] != key[:-1])
            size = np.diff(np.append(np.flatnonzero(new), len(fp)))
            many = np.repeat(size > 1, size)
            rule, fp, new = rule[many], fp[many].view(np.uint64), new[many]
            for r in np.unique(rule):
                own, first = fp[rule == r], np.flatnonzero(new[rule == r])
                if not np.all(own[1:] > own[:-1]):  # signed order inside a run to unsigned order
                    run_of = np.cumsum(new[rule == r])
                    own = own[np.lexsort((own, run_of))]
                a, b = near_edges(own, first, ~masks[r] & (1 << 64) - 1)
                root = local_components(len(own), a, b)
                out = np.flatnonzero(root != np.arange(len(own)))
                if len(out):
                    yield pa.RecordBatch.from_arrays([pa.array(own[out].view(np.int64)), pa.array(own[root[out]].view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.concatenate([k, c.to_numpy()]) for k, c in zip(kept, batch.columns)]
            last = np.flatnonzero((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]))[0]
            yield from links(*(c[:last] for c in cols))
            kept = [c[last:] for c in cols]
        yield from links(*kept)

    return dealt.select("rule", "key", "fp").mapInArrow(run, "a long, b long")


def fingerprint_groups(fps: DataFrame) -> DataFrame:
    """(fp, component) of a table of distinct fingerprints; the component is the smallest of its fingerprints."""
    comp = connected_components(link_blocks(fps)).withColumnRenamed("node", "fp")
    return fps.join(comp, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """Near-duplicate groups of all documents: (doc_id long, fingerprint string, component_id long).

    Texts are lower-cased (A-Z only) and cut at ASCII white space; fingerprints of three-word shingles link at distance
    2 or less. Null and wordless texts have fingerprint zero and link like any other. Repeated rows each get a row;
    null ids keep their row and are never chosen as ``component_id`` unless all ids of the group are null. An empty table
    gives an empty table; other columns of ``docs`` are ignored.
    """
    per_doc = stored(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "simhash")
    distinct = stored(per_doc.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-fps")
    grouped = distinct.join(fingerprint_groups(distinct.select("fp")), "fp")
    ids = grouped.join(grouped.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("fp", "component_id")
    return per_doc.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group, with the columns of ``docs``: that of the smallest ``doc_id``, among its rows that of the
    smallest hash of the text, then of the other columns.

    So two rows of one id with unlike texts are each judged by their own text, and the order of rows doesn't matter. Rows
    without an id can't be told apart and all stay, beside their groups' choice among the others.
    """
    others = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")])) if len(docs.columns) > 2 else F.lit("")
    row, text = free_name(docs, "row"), free_name(docs, "mark")
    marked = docs.filter("doc_id is not null").withColumns({text: F.coalesce(F.sha2("text", 256), F.lit("")), row: F.md5(others)})
    per_row = stored(fingerprints(marked.select("doc_id", F.col(text).alias("mark"), F.col(row).alias("row"), "text")), "dedup-rows")
    # the least row of each fingerprint first, so that no group of copies meets in a join
    least = stored(per_row.groupBy("fp").agg(F.min(F.struct("doc_id", "mark", "row")).alias("kept")), "dedup-fps")
    chosen = least.join(fingerprint_groups(least.select("fp")), "fp").groupBy("component").agg(F.min("kept").alias("kept"))
    keys = ["doc_id", text, row]
    kept = chosen.select(F.col("kept.doc_id").alias("doc_id"), F.col("kept.mark").alias(text), F.col("kept.row").alias(row))
    one = marked.join(kept, keys, "left_semi").dropDuplicates(keys)
    return one.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
