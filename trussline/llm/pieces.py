"""SentencePiece encoding by streaming Viterbi, and decoding back to the exact text."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator, MutableSequence, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trussline.llm.common import map_rows

#: Where the public tokenizer files lie; a parameter of every entry point.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a mark that the text itself holds, which bytes keep; no valid text has this character.
LITERAL = "\ud800"
#: Before the key of a stretch that no space precedes.
UNMARKED = "\ud801"
_SPACED = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Scores are whole numbers, this many to a unit of the natural logarithm, so that sums are exact and ties are ties.
UNIT = 1 << 20
#: An unknown character costs this much more than the rarest piece.
UNKNOWN = 10 * UNIT
NEVER = -(1 << 62)
#: Words of a worker's cache, about 200 bytes each, and the length up to which one is kept.
CACHE_WORDS, KEEP = 1 << 20, 64


class Pieces:
    """Pieces of a SentencePiece model file with their scores.

    The scores of a merge-ordered model are ranks and no log probabilities: as they stand, two frequent pieces outscore most words. A piece of
    rank r takes the score -log(r + 1) instead, as a frequency by Zipf's law has it. Scores of a unigram model count as they are.

    A piece that others spell at a higher total score is on no best path and is left out of the table. No piece may hold
    a space mark behind another character, so that all paths meet before every run of spaces.
    """

    def __init__(self, model: bytes):
        proc = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [proc.id_to_piece(k) for k in range(proc.vocab_size())]
        self.byte_ids = [proc.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unk_id = proc.unk_id()
        if any(k == self.unk_id for k in self.byte_ids):
            raise ValueError("the model has no byte pieces, so not every text can be encoded")
        plain = {name: k for k, name in enumerate(names) if not (proc.is_control(k) or proc.is_unknown(k) or proc.is_byte(k) or proc.is_unused(k))}
        given = {name: proc.get_score(k) for name, k in plain.items()}
        ranks = all(score <= 0 and score == int(score) for score in given.values())
        scores = {name: round(UNIT * (-math.log(1 - score) if ranks else score)) for name, score in given.items()}
        self.worst = min(scores.values()) - UNKNOWN
        self.longest = max(map(len, plain))
        for name in sorted(plain, key=len):
            if len(name) > 1:
                best = [0] + [NEVER] * len(name)
                for i in range(len(name)):
                    for j in range(i + 1, len(name) + (i > 0)):
                        score = scores.get(name[i:j], self.worst if j == i + 1 else None)
                        if score is not None:
                            best[j] = max(best[j], best[i] + score)
                if best[-1] > scores[name]:
                    del scores[name]
        if odd := [x for x in scores if SPACE in x.lstrip(SPACE)]:
            raise ValueError(f"pieces cross from a word to a space: {odd[:3]}")
        #: every piece and every prefix of one; prefixes that are no pieces have no entry in scores
        self.prefixes = {x[:n] for x in scores for n in range(1, len(x) + 1)}
        self.scores, self.ids = scores, {name: k for name, k in plain.items() if name in scores}
        self.surface = [name.replace(SPACE, " ").encode() for name in names]
        for b, k in enumerate(self.byte_ids):
            self.surface[k] = bytes([b])
        for k in range(len(names)):
            if proc.is_control(k) or proc.is_unknown(k):
                self.surface[k] = b""


@lru_cache(maxsize=2)
def load(model: bytes) -> tuple[Pieces, dict[str, bytes]]:
    """The table of a model and the cache of encoded words; one of each in a worker process."""
    return Pieces(model), {}


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def relax(pieces: Pieces, text: str, best: MutableSequence[int], back: MutableSequence[int], start: int, stop: int) -> None:
    """Extend the best paths from the positions from ``start`` to before ``stop``.

    Of equal scores the later start stays: in a run of one character all paths then share the boundaries of the
    longest piece, and what is left over stands at the end.
    """
    prefixes, scores, worst, size = pieces.prefixes, pieces.scores, pieces.worst, len(text) + 1
    for i in range(start, stop):
        base = best[i]
        for j in range(i + 1, size):
            part = text[i:j]
            if part not in prefixes:
                break
            score = scores.get(part)
            if score is not None and base + score >= best[j]:
                best[j] = base + score
                back[j] = i
        if base + worst > best[i + 1]:
            best[i + 1] = base + worst
            back[i + 1] = i


def follow(pieces: Pieces, text: str, back: Sequence[int], end: int) -> list[int]:
    """Ids on the best path to ``end``."""
    out: list[int] = []
    while end > 0:
        start = back[end]
        own = pieces.ids.get(part := text[start:end])
        if own is not None:
            out.append(own)
        else:
            out += [pieces.byte_ids[b] for b in reversed(part.replace(LITERAL, SPACE).encode())]
        end = start
    out.reverse()
    return out


class Viterbi:
    """Best segmentation of a stream of characters, committed as it becomes certain.

    Only starts in the last ``longest`` positions can still be extended. Once the backpointers of all of these lead to
    one boundary, nothing before it can change: its pieces are committed and forgotten. So the ids are those of the best
    path of the whole text, however the stream is cut into chunks. Nothing is committed before it is certain: periodic text can keep
    paths apart for as long as it goes on, and what is kept grows with it, by twelve bytes a character beside the text. Commits
    are tried when the window has doubled, so the time stays linear.
    """

    def __init__(self, pieces: Pieces, every: int = 256):
        self.pieces, self.every = pieces, every
        self.text, self.best, self.back, self.at = "", array("q", [0]), array("i", [0]), 0
        self.ahead, self.tried = "", 0

    def push(self, chars: str) -> list[int]:
        """Take more characters; the ids that became certain."""
        ids: list[int] = []
        self.ahead += chars
        taken = len(self.ahead) // self.every * self.every
        for k in range(0, taken, self.every):
            self._take(self.ahead[k : k + self.every])
            self._advance(max(self.at, len(self.text) - self.pieces.longest))
            if len(self.text) >= 2 * self.tried:
                ids += self._commit()
                self.tried = len(self.text)
        self.ahead = self.ahead[taken:]
        return ids

    def finish(self) -> list[int]:
        """The ids of what is left."""
        self._take(self.ahead)
        self._advance(len(self.text))
        return self._ids(len(self.text))

    def _take(self, more: str) -> None:
        self.text += more
        self.best += array("q", [NEVER]) * len(more)
        self.back += array("i", [-1]) * len(more)

    def _advance(self, stop: int) -> None:
        relax(self.pieces, self.text, self.best, self.back, self.at, stop)
        self.at = stop

    def _commit(self) -> list[int]:
        open_ends = [k for k in range(self.at, len(self.back)) if self.back[k] >= 0]
        live = set(open_ends)
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(self.back[last])
        edge = live.pop() if live else 0
        if not edge:
            return []
        ids, low, at = self._ids(edge), self.best[edge], self.at
        self.text = self.text[edge:]
        self.best, self.at = array("q", [x if x == NEVER else x - low for x in self.best[edge:]]), at - edge
        self.back = array("i", [0, *(k - edge if k >= 0 else -1 for k in self.back[edge + 1 :])])
        return ids

    def _ids(self, end: int) -> list[int]:
        return follow(self.pieces, self.text, self.back, end)


def encode_stream(pieces: Pieces, chunks: Iterable[str]) -> Iterator[int]:
    """Ids of a text given in chunks, in bounded memory; spaces become marks, with one more before the text."""
    run, begun = Viterbi(pieces), False
    for chunk in filter(None, chunks):
        if not begun:
            yield from run.push(SPACE)
            begun = True
        yield from run.push(chunk.replace(SPACE, LITERAL).replace(" ", SPACE))
    yield from run.finish()


def encode_text(pieces: Pieces, cache: dict[str, bytes], text: str) -> bytes:
    """Ids of a whole text as packed 32-bit integers.

    All paths meet before each run of spaces and at each side of an unknown character, so what lies between has the same
    ids wherever it stands. They are kept for the next time; the cache starts anew when full. Long stretches are streamed
    and not kept.
    """
    if not text:
        return b""
    if SPACE in text:
        text = text.replace(SPACE, LITERAL)
    if "  " in text or text[0] == " ":
        parts = _SPACED.findall(SPACE + text.replace(" ", SPACE))
        return b"".join([_stretch(pieces, cache, p[1:] if p[1:2] != SPACE else p) for p in parts])
    return b"".join([cache.get(word) or _stretch(pieces, cache, word) for word in text.split(" ")])


def _stretch(pieces: Pieces, cache: dict[str, bytes], key: str) -> bytes:
    """Ids of a word with one mark before it (not in the key) or several (in the key), with its line ends."""
    if key in cache:
        return cache[key]
    if "\n" not in key or "\n" in pieces.ids:
        return _kept(pieces, cache, key, key if key[:1] == SPACE else SPACE + key)
    newline = array("i", [pieces.byte_ids[10]]).tobytes()
    first, *rest = key.split("\n")
    out = [_stretch(pieces, cache, first)]
    for part in rest:
        out.append(newline)
        if part:
            out.append(cache.get(UNMARKED + part) or _kept(pieces, cache, UNMARKED + part, part))
    return b"".join(out)


def _kept(pieces: Pieces, cache: dict[str, bytes], key: str, marked: str) -> bytes:
    run = Viterbi(pieces)
    packed = array("i", run.push(marked) + run.finish()).tobytes()
    if len(marked) <= KEEP and key not in cache:
        if len(cache) >= CACHE_WORDS:
            cache.clear()
        cache[key] = packed
    return packed


def decode_ids(pieces: Pieces, ids: Iterable[int]) -> str:
    """The text of ids; the one space that encoding puts before the text is taken off."""
    data = b"".join(map(pieces.surface.__getitem__, ids))
    return data.removeprefix(b" ").decode("utf-8", "replace")


def encode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", verify: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text`` in an array<int> column, null for null texts and empty for empty ones.

    With ``verify`` a boolean column tells whether decoding these ids gives the same text again (true for null texts).
    Columns of these names are replaced; every row stays.
    """
    keep = [c for c in docs.columns if c not in (ids, verify)]
    at = keep.index(text)
    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(verify, T.BooleanType())] if verify else [])

    def make():
        pieces, cache = load(model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at).to_pylist()
            packed = [encode_text(pieces, cache, t or "") for t in texts]
            flat = np.frombuffer(b"".join(packed), np.int32)
            ends = np.cumsum([0, *map(len, packed)]) // 4
            gone = pa.array([t is None for t in texts] + [False])
            out = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.array(gone)), pa.array(flat, pa.int32()))
            columns = [*batch.columns, out]
            if verify:
                columns.append(pa.array([t is None or decode_ids(pieces, np.frombuffer(p, np.int32).tolist()) == t for t, p in zip(texts, packed)]))
            return pa.RecordBatch.from_arrays(columns, [*keep, *(f.name for f in added)])

        return work

    return map_rows(docs.select(*keep), T.StructType([*docs.select(*keep).schema, *added]), make, rows=256)


def decode(tokens: DataFrame, model: bytes, ids: str = "ids", text: str = "text") -> DataFrame:
    """``tokens`` with the decoded text in a column; null ids give null."""
    keep = [c for c in tokens.columns if c != text]
    at = keep.index(ids)

    def make():
        pieces, _ = load(model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [None if x is None else decode_ids(pieces, x) for x in batch.column(at).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*keep, text])

        return work

    return map_rows(tokens.select(*keep), T.StructType([*tokens.select(*keep).schema, T.StructField(text, T.StringType())]), make, rows=256)


def encoding_report(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip) of every whole text; null texts have null ids and n_ids 0."""
    done = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), read_model(path), verify="round_trip")
    return done.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids", "round_trip")
