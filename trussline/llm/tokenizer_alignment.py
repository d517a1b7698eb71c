"""Alignment of two tokenizers over the same bytes, by bitsets of token ends.

Texts are cut at single spaces between two other characters. Neither vocabulary joins such a space to what stands before it,
so both tokenizers end a token there and each part can be aligned once and looked up afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.llm.byte_pieces import BYTE_BPE_PATH, CUT, byte_pieces
from trussline.llm.common import stored
from trussline.llm.packed_ids import pack, unpack

#: Where the two public vocabularies lie; parameters of every entry point.
PIECE_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose links share a table of pairs; a longer document has one of its own.
TEXT_BYTES = 8 << 20
#: Parts whose alignments a worker keeps, and their characters.
KEPT_PARTS, KEPT_CHARS = 1 << 18, 1 << 24
A_SHIFT = 16


def set_bits(ends: np.ndarray, n: int) -> np.ndarray:
    """A bitset of ``n`` bytes of text, packed in 64-bit words, with the bits before each of ``ends`` set."""
    flags = np.zeros(-(-n // 64) * 64, bool)
    flags[ends - 1] = True
    return np.packbits(flags, bitorder="little").view("<u8")


class Ranks:
    """Rank and select on a bitset by popcounts of its words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        inside = np.append(self.words, np.uint64(0))[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)

    def places(self) -> np.ndarray:
        """The places of all set bits in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def align(a_ends: np.ndarray, b_ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two token sequences over the same ``n`` bytes, given the tokens' ends.

    Returns the numbers of A and of B tokens up to the end of each group, which lies where both end, and the A and B
    token of each link. The union of both bitsets cuts the bytes so that each piece lies in one token of either, and each overlapping
    pair shares exactly one piece.
    """
    a, b = set_bits(a_ends, n), set_bits(b_ends, n)
    a_ranks, b_ranks = Ranks(a), Ranks(b)
    shared, pieces = Ranks(a & b).places(), Ranks(a | b).places()
    return a_ranks.rank(shared + 1), b_ranks.rank(shared + 1), a_ranks.rank(pieces), b_ranks.rank(pieces)


class PiecePieces:
    """Ids of the second tokenizer and the bytes of each."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]
        self.lengths = np.array(list(map(len, self.bytes)), np.int64)
        # a piece with a space behind another character would join parts
        self.splits = not any(" " in n.replace("▁", " ").lstrip(" ") for n in names)


class Aligner:
    """Alignments of parts, kept by part: sizes, the written groups, and the links as pairs of ids."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = byte_pieces(a_path, True, 1 << 19), PiecePieces(b_path)
        self.a_bytes = self.a.token_bytes()
        self.a_lengths = np.array(list(map(len, self.a_bytes)), np.int64)
        within, between = {}, {}
        for side, n in (("a", len(self.a_bytes)), ("b", len(self.b.bytes))):
            numbers = [str(k).encode() for k in range(n)]
            within[side] = [x + b"," for x in numbers]
            between[side] = [x + (b"|" if side == "a" else b";") for x in numbers]
        self.written = [*within["a"], *between["a"], *within["b"], *between["b"]]
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.sizes: list[tuple[int, int, int, int]] = []
        self.groups: list[bytes] = []
        self.links: list[np.ndarray] = []
        self.chars = 0

    def cut(self, text: str) -> list[str]:
        return CUT.split(text) if self.b.splits else [text]

    def learn(self, parts: list[str]) -> None:
        """Align parts not seen yet, all in one pair of bitsets: parts end at shared cuts."""
        a_ids = [np.frombuffer(self.a.encode(" " + p), self.a.dtype) for p in parts]
        b_ids = [np.array(ids, np.int64) for ids in self.b.model.encode(parts, num_threads=1)]
        good = []
        for part, a, b in zip(parts, a_ids, b_ids):
            want = b" " + part.encode()
            good.append(b"".join(map(self.a_bytes.__getitem__, a.tolist())) == want and b"".join(map(self.b.bytes.__getitem__, b.tolist())) == want)
        kept = [k for k, g in enumerate(good) if g]
        if kept:
            a, b = (np.concatenate([ids[k] for k in kept]).astype(np.int64) for ids in (a_ids, b_ids))
            a_ends, b_ends = np.cumsum(self.a_lengths[a]), np.cumsum(self.b.lengths[b])
            a_cuts, b_cuts, link_a, link_b = align(a_ends, b_ends, int(a_ends[-1]))
            texts = self._write(a, b, a_cuts, b_cuts)
            pairs = (a[link_a] << A_SHIFT) + b[link_b]
            last_a = np.cumsum([len(a_ids[k]) for k in kept])
            group_ends = np.searchsorted(a_cuts, last_a, "right")
            link_ends = np.searchsorted(link_a, last_a, "left")
        at = group_at = link_at = 0
        for k, part in enumerate(parts):
            self.rows[part] = len(self.sizes)
            self.chars += len(part)
            if not good[k]:
                self.sizes.append((-1, -1, -1, -1))
                self.groups.append(b"")
                self.links.append(np.zeros(0, np.int64))
                continue
            group_to, link_to = int(group_ends[at]), int(link_ends[at])
            self.sizes.append((len(a_ids[k]), len(b_ids[k]), group_to - group_at, link_to - link_at))
            first = int(a_cuts[group_at - 1] + b_cuts[group_at - 1]) if group_at else 0
            self.groups.append(b"".join(texts[first : int(a_cuts[group_to - 1] + b_cuts[group_to - 1])]))
            self.links.append(pairs[link_at:link_to])
            at, group_at, link_at = at + 1, group_to, link_to

    def _write(self, a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> list[bytes]:
        """Each token's number with the sign behind it, in the order of the groups."""
        out = np.empty(len(a) + len(b), np.int64)
        n_a, n_b = len(self.a_bytes), len(self.b.bytes)
        for ids, cuts, other, base, n in ((a, a_cuts, np.concatenate([[0], b_cuts[:-1]]), 0, n_a), (b, b_cuts, a_cuts, 2 * n_a, n_b)):
            ends = np.zeros(len(ids), bool)
            ends[cuts - 1] = True
            out[np.arange(len(ids)) + np.repeat(other, np.diff(cuts, prepend=0))] = ids + base + n * ends
        return list(map(self.written.__getitem__, out.tolist()))

    def parts_of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The rows of each text's parts; null and empty texts have none."""
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.rows) > KEPT_PARTS or self.chars > KEPT_CHARS:
            self.clear()
        new = list({p: None for parts in cut for p in parts if p not in self.rows})
        if new:
            self.learn(new)
        return [np.fromiter(map(self.rows.__getitem__, parts), np.int64, len(parts)) for parts in cut]


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


_DOC = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("n_pairs", pa.int64())])
_DOC_SQL = "struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string,n_pairs:bigint>"
BLOCK_SCHEMA = f"block string, docs array<{_DOC_SQL}>, pairs array<bigint>, holders array<bigint>, places binary, times binary"


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[k] .. starts[k] + sizes[k] - 1 of all k, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _block(work: Aligner, name: str, doc_ids: list[int | None], texts: list[str | None]) -> pa.RecordBatch:
    """One row of some documents: their sizes, the distinct linked pairs of all with the number of documents that hold each, and each
    document's pairs as places among them (as steps) with how often each is linked."""
    rows = work.parts_of(texts)
    n_parts = np.array(list(map(len, rows)), np.int64)
    used, part = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]), return_inverse=True)
    links = [work.links[k] for k in used.tolist()]
    link_sizes = np.array(list(map(len, links)), np.int64)
    pairs, codes = np.unique(np.concatenate([np.zeros(0, np.int64), *links]), return_inverse=True)
    sizes = np.array([work.sizes[k] for k in used.tolist()], np.int64).reshape(-1, 4)
    begins = np.concatenate([[0], np.cumsum(n_parts)])
    docs, steps, times, holders = [], [], [], np.zeros(len(pairs), np.int64)
    link_starts = np.cumsum(link_sizes) - link_sizes
    for k, doc_id in enumerate(doc_ids):
        mine = part[begins[k] : begins[k + 1]]
        own = sizes[mine]
        if not len(mine) or own.min() < 0:
            docs.append({"doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "n_pairs": 0})
            continue
        n_a, n_b, n_groups, n_links = own.sum(axis=0).tolist()
        digest = hashlib.sha256(b"".join(map(work.groups.__getitem__, rows[k].tolist()))[:-1]).hexdigest()
        held, often = np.unique(codes[_expand(link_starts[mine], link_sizes[mine])], return_counts=True)
        holders[held] += 1
        steps.append(np.diff(held, prepend=0))
        times.append(often)
        docs.append({"doc_id": doc_id, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digest, "n_pairs": len(held)})
    none = np.zeros(0, np.int64)
    columns = [pa.array([name]), pa.array([docs], pa.list_(_DOC)), pa.array([pairs.tolist()], pa.list_(pa.int64())), pa.array([holders.tolist()], pa.list_(pa.int64())), pa.array([pack(np.concatenate([none, *steps]))]), pa.array([pack(np.concatenate([none, *times]))])]
    return pa.RecordBatch.from_arrays(columns, ["block", "docs", "pairs", "holders", "places", "times"])


def aligned_blocks(docs: DataFrame, a_path: str = BYTE_BPE_PATH, b_path: str = PIECE_PATH) -> DataFrame:
    """Blocks of aligned documents, :data:`BLOCK_SCHEMA`; a block holds about :data:`TEXT_BYTES` of text, or one longer document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, task, n = aligner(a_path, b_path), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        texts: list[str | None] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(doc_id)
                texts.append(text)
                size += len(text or "") + 64
                if size >= TEXT_BYTES:
                    yield _block(work, f"{task}-{n}", ids, texts)
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield _block(work, f"{task}-{n}", ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK_SCHEMA)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a_id, b_id, count, best) of every linked pair: the documents that hold it, and whether no pair of its A id has more."""
    held = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.holders").alias("n"))
    counts = held.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a_id", F.shiftright("pair", A_SHIFT))
    most = counts.groupBy("a_id").agg(F.max("count").alias("most"))
    return counts.join(most, "a_id").select("a_id", (F.col("pair") % (1 << A_SHIFT)).alias("b_id"), "pair", "count", (F.col("count") == F.col("most")).alias("best"))


OUT_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            docs = pa.RecordBatch.from_struct_array(batch.column("docs")[row].values)
            told = batch.column("told")[row].values
            counts, best = (np.asarray(told.field(name)).astype(np.int64) for name in ("count", "best"))
            n_pairs = docs.column("n_pairs").to_numpy()
            steps, times = (unpack(batch.column(name)[row].as_py()).astype(np.int64) for name in ("places", "times"))
            ends = np.cumsum(n_pairs)
            running = np.concatenate([[0], np.cumsum(steps)])
            places = running[1:] - np.repeat(running[ends - n_pairs], n_pairs)
            sums = [np.diff(np.concatenate([[0], np.cumsum(times * x[places])])[np.concatenate([[0], ends])]) for x in (best, counts)]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
            yield pa.RecordBatch.from_arrays([*map(docs.column, names), *map(pa.array, sums), docs.column("groups_sha256")], [*names, "n_best", "count_sum", "groups_sha256"])


def alignment_report(docs: DataFrame, a_path: str = BYTE_BPE_PATH, b_path: str = PIECE_PATH) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Documents are aligned once, in blocks. A block's distinct pairs, not its links, are shuffled: to be counted over all
    blocks, and with the counts back to the block; so a pair that all documents hold comes once a block. Null and empty texts,
    and those whose tokens don't give back their bytes, have zeros and ''. Each row is a document, repeated rows too; an
    empty table gives an empty table; other columns don't matter.
    """
    blocks = stored(aligned_blocks(docs, a_path, b_path), "aligned")
    counts = pair_counts(blocks).select("pair", "count", "best")
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(counts, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "count", "best"))).alias("told"))
    none = F.array().cast("array<struct<place:int,count:bigint,best:boolean>>")
    whole = blocks.select("block", "docs", "places", "times").join(told, "block", "left").withColumn("told", F.coalesce("told", none))
    return whole.select("docs", "places", "times", "told").mapInArrow(_digest, OUT_SCHEMA)


def aligned_groups(docs: DataFrame, a_path: str = BYTE_BPE_PATH, b_path: str = PIECE_PATH) -> DataFrame:
    """(doc_id, groups) of every row: the ids of A and of B in each group, as written text; '' without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(a_path, b_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows = [r.tolist() for r in work.parts_of(some.column("text").to_pylist())]
                texts = [b"".join(map(work.groups.__getitem__, r))[:-1].decode() if all(work.sizes[k][0] >= 0 for k in r) else "" for r in rows]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, groups string")
