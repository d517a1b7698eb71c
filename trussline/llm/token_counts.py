"""Token counts of edited documents: only the pre-tokens around an edit are encoded again."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussline.llm.common import map_rows

#: Where the public tokenizer files lie; a parameter of every entry point.
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A match reads at most this many characters behind its end (the look-ahead after a run of spaces).
LOOK = 2
#: Pre-tokens of a leaf when a tree is built.
LEAF = 32
CACHE_WORDS = 1 << 19


class Counter:
    """Tokens of a pre-token, with a cache of the frequent ones."""

    def __init__(self, ranks: bytes):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encode = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece
        self.pattern = regex.compile(PATTERN)
        self.cache: dict[str, int] = {}

    def __call__(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = len(self.encode(piece.encode()))
            if len(piece) <= 64:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                self.cache[piece] = n
        return n


@lru_cache(maxsize=1)
def counter(ranks: bytes) -> Counter:
    return Counter(ranks)


class TokenTree:
    """A segment tree over a text's pre-tokens: leaves of some pre-tokens each, sums of characters and tokens above.

    An edit is located by the character sums, its pre-tokens are matched anew from the last one that the edit can't have
    changed until a border falls on an old one, and the sums on the way up are brought up to date. ``encoded`` counts the
    pre-tokens that were encoded, the building included.
    """

    def __init__(self, text: str, count: Counter):
        self.text, self.count = text, count
        pieces = count.pattern.findall(text)
        cache = count.cache
        counts = [n if (n := cache.get(p)) is not None else count(p) for p in pieces]
        self.encoded = len(pieces)
        self._build(list(map(len, pieces)), counts)

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        self.leaves = [(lengths[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, len(lengths), LEAF)] or [([], [])]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        starts = np.arange(0, max(1, len(lengths)), LEAF)
        self.sums = []
        for values in (lengths, counts):
            level = np.zeros(self.size, np.int64)
            if values:
                level[: len(starts)] = np.add.reduceat(np.array(values, np.int64), starts)
            levels = [level]
            while len(level) > 1:
                level = level[::2] + level[1::2]
                levels.append(level)
            self.sums.append(np.concatenate([[0], *levels[::-1]]).tolist())

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    @property
    def pretokens(self) -> int:
        return sum(len(lengths) for lengths, _ in self.leaves)

    def _find(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) for a character's place."""
        node, start, chars = 1, 0, self.sums[0]
        while node < self.size:
            node *= 2
            if place >= start + chars[node] and chars[node + 1]:
                start += chars[node]
                node += 1
        return node - self.size, start

    def _update(self, leaf: int) -> None:
        for sums, values in zip(self.sums, self.leaves[leaf]):
            node, change = self.size + leaf, sum(values) - sums[self.size + leaf]
            while node:
                sums[node] += change
                node //= 2

    def edit(self, start: int, stop: int, put: str) -> None:
        """Replace the characters from ``start`` to before ``stop``; both are brought into the text's range."""
        start = min(max(start, 0), len(self.text))
        stop = min(max(stop, start), len(self.text))
        text = self.text[:start] + put + self.text[stop:]
        shift = len(text) - len(self.text)
        first, at = self._find(max(0, start - LOOK))
        lengths = self.leaves[first][0]
        keep = 0
        while keep < len(lengths) and at + lengths[keep] + LOOK <= start:
            at += lengths[keep]
            keep += 1
        if first and not keep and at >= start:  # the leaf before may end in what the edit continues
            first -= 1
            keep = len(self.leaves[first][0]) - 1 if self.leaves[first][0] else 0
            at -= sum(self.leaves[first][0][keep:])
        # borders of the old pre-tokens behind the edit, as they are reached
        leaf, inside, border = first, keep, at
        new: list[str] = []
        settled = len(text) == at
        for m in self.count.pattern.finditer(text, at):
            new.append(m[0])
            end = m.end()
            if end >= start + len(put):
                while border < end - shift and leaf < len(self.leaves):
                    if inside < len(self.leaves[leaf][0]):
                        border += self.leaves[leaf][0][inside]
                        inside += 1
                    else:
                        leaf, inside = leaf + 1, 0
                if border == end - shift >= stop:
                    settled = True
                    break
        if not settled or (not new and border < stop):
            leaf, inside = len(self.leaves), 0
        lengths, counts = self.leaves[first]
        tail_l, tail_c = ([], []) if leaf >= len(self.leaves) else (self.leaves[leaf][0][inside:], self.leaves[leaf][1][inside:])
        self.encoded += len(new)
        self.text = text
        self.leaves[first] = (lengths[:keep] + [*map(len, new)], counts[:keep] + [self.count(p) for p in new])
        for k in range(first + 1, min(leaf, len(self.leaves))):
            self.leaves[k] = ([], [])
        if leaf == first:
            self.leaves[first] = (self.leaves[first][0] + tail_l, self.leaves[first][1] + tail_c)
        elif leaf < len(self.leaves):
            self.leaves[leaf] = (tail_l, tail_c)
        if len(self.leaves[first][0]) > 8 * LEAF:
            self._build([x for own, _ in self.leaves for x in own], [x for _, own in self.leaves for x in own])
            return
        for k in range(first, min(leaf, len(self.leaves) - 1) + 1):
            self._update(k)


def read_ranks(path: str = RANKS_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def count_after_edits(docs: DataFrame, edits: Column, ranks: bytes) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, n_tokens_edited, n_encoded_again) of every row.

    ``edits`` is an array<struct<start:int,stop:int,put:string>> of a row, applied in order, each to the text that the one
    before left, in code points. Places beyond the text count as its end; null edits, and those with a null place, are
    passed over; a null ``put`` deletes. Null texts count as empty. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), edits.alias("edits"))
    names = ["doc_id", "n_tokens", "n_pretokens", "n_tokens_edited", "n_encoded_again"]

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        count = counter(ranks)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, todo in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tree = TokenTree(text, count)
                before = (tree.tokens, tree.encoded)
                for e in todo or ():
                    if e and e["start"] is not None and e["stop"] is not None:
                        tree.edit(e["start"], e["stop"], e["put"] or "")
                out.append((*before, tree.tokens, tree.encoded - before[1]))
            cols = list(zip(*out)) if out else [()] * 4
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names)

        return work

    return map_rows(rows, ", ".join(f"{n} long" for n in names), make)


def count_edit_stream(docs: DataFrame, edits: DataFrame, ranks: bytes) -> DataFrame:
    """(doc_id, n_tokens_edited) of documents that a table of edits (doc_id, seq, start, stop, put) touches.

    Edits of a document meet it in one sorted run and are applied as they come, so a document with very many edits needs
    no more memory than its text. Edits without a document are passed over, documents of one id take the edits each.
    """
    first = docs.select("doc_id", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"), F.coalesce("text", F.lit("")).alias("put"), F.lit(0).alias("kind"))
    touched = first.join(edits.select("doc_id").distinct(), "doc_id", "left_semi")
    more = edits.select("doc_id", F.col("seq").cast("long"), F.col("start").cast("int"), F.col("stop").cast("int"), F.coalesce("put", F.lit("")), F.lit(1))
    dealt = touched.union(more).filter("doc_id is not null").repartition("doc_id").sortWithinPartitions("doc_id", "kind", "seq", "start", "stop", "put")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, now, trees = counter(ranks), None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now] * len(trees), pa.int64()), pa.array([t.tokens for t in trees], pa.int64())], ["doc_id", "n_tokens_edited"])

        for batch in batches:
            for doc_id, start, stop, put, kind in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                if doc_id != now:
                    if trees:
                        yield done()
                    now, trees = doc_id, []
                if kind == 0:
                    trees.append(TokenTree(put, count))
                elif start is not None and stop is not None:
                    for tree in trees:
                        tree.edit(start, stop, put)
        if trees:
            yield done()

    return dealt.mapInArrow(run, "doc_id long, n_tokens_edited long")


def sample_edits(text: Column) -> Column:
    """Three edits placed by a text's length: a replacement at a third, an insertion at the middle, a cut near the end."""
    n = F.coalesce(F.length(text), F.lit(0))
    edit = lambda start, stop, put: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(put).alias("put"))
    third, middle, late = F.floor(n / 3), F.floor(n / 2), F.floor(n * 5 / 6)
    return F.array(edit(third, third + 9, "revised words"), edit(middle, middle, " (see the note of 2024)"), edit(late, late + 24, ""))


def token_report(docs: DataFrame, path: str = RANKS_PATH) -> DataFrame:
    """Token counts of every whole text before and after the edits of :func:`sample_edits`."""
    return count_after_edits(docs, sample_edits(F.col("text")), read_ranks(path))
