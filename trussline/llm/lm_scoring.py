"""Language-model scores of whole texts: causal self-attention on subword ids, smoothed by word counts and a memory of phrases."""

from __future__ import annotations

import base64
import math
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, count, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussline.llm.common import in_fold, stored

#: Where the public tokenizer files lie; a parameter of every entry point.
RANKS_PATH = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Stands for the end of a text in word tables; no word holds a line end.
END = b"\n"
#: Before the hash of a phrase in word tables; no word holds a space.
PHRASE = b" "
#: Input rows of the model: the end, padding, and other pieces inside a word and at its start.
AT_END, PAD, OTHER, OTHER_START = range(4)
#: Windows worked on at a time.
CHUNK = 64


@dataclass(frozen=True)
class LmSettings:
    """Size of the model and shares of the mixture.

    The attention tables start from at most ``start_texts`` training texts, chosen by hash; then every training window
    teaches them, in steps of ``step_windows`` in each task, whose tables are averaged, and takes part in the estimate of
    what each class emits. Word and phrase counts cover the whole training part. Up to
    ``hot_words`` of the most frequent words of at most ``hot_bytes`` bytes go to every task; all others meet their counts in a join.
    ``shares`` are those of the attention model, the word counts and the words so far.
    """

    width: int = 16
    classes: int = 64
    window: int = 32
    stride: int = 24
    pieces: int = 4096
    start_texts: int = 1500
    batch: int = 256
    steps: int = 1500
    passes: int = 5
    rate: float = 0.05
    step_windows: int = 1024
    smooth: float = 50.0
    hot_words: int = 1 << 18
    hot_bytes: int = 64
    lexicon_words: int = 1 << 19
    lexicon_bytes: int = 1 << 25
    batch_bytes: int = 1 << 19
    shares: tuple[float, float, float] = (0.8, 0.15, 0.05)
    memory: float = 0.05
    phrase: int = 32
    longest_phrase: int = 96
    seed: int = 5


@lru_cache(maxsize=1)
def encoding(ranks: bytes) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("subwords", pat_str=" [^ ]+", mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=1)
def starting(ranks: bytes) -> np.ndarray:
    """Which ids start a word, or are the end."""
    pieces = encoding(ranks).token_byte_values()
    out = np.zeros(len(pieces) + 1, bool)
    out[[encoding(ranks).encode_single_token(p) for p in pieces if p[:1] == b" "]] = True
    out[-1] = True
    return out


class Lexicon:
    """Words met by a worker process, numbered in order: place among the frequent words, hash and subword ids."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.index: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.words: list[bytes] = []
        self.place, self.hashes, self.sizes, self.starts, self.pieces = array("i"), array("Q"), array("i"), array("l"), array("H")
        self.bytes = 0


@lru_cache(maxsize=1)
def lexicon(run_id: str) -> Lexicon:
    """Tasks of one run share it."""
    return Lexicon()


def words_of(text: bytes | None) -> list[bytes]:
    """Words with A-Z in lower case, cut at ASCII white space."""
    return text.lower().split() if text else []


class Coder:
    """Texts as numbered words and subword ids. The lexicon is to be cleared when :meth:`full`."""

    def __init__(self, ranks: bytes, settings: LmSettings, run_id: str, place: dict[bytes, int]):
        self.encoding, self.starting, self.settings, self.place, self.known = encoding(ranks), starting(ranks), settings, place, lexicon(run_id)
        self.end = len(ranks.splitlines())

    def full(self) -> bool:
        return len(self.known.words) >= self.settings.lexicon_words or self.known.bytes >= self.settings.lexicon_bytes

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(subword ids of all words, each behind a space; how many each has). Only a word's first id starts with a space."""
        try:
            ids = self.encoding.encode_to_numpy((b" " + b" ".join(words)).decode(), disallowed_special=())
        except UnicodeDecodeError:
            ids = np.array([*chain.from_iterable(self.encoding._core_bpe.encode_single_piece(b" " + word) for word in words)])
        first = np.flatnonzero(self.starting[ids])
        return ids.astype(np.uint16), np.diff(np.append(first, len(ids)))

    def _add(self, words: list[bytes]) -> None:
        """The fields of words that were numbered just now."""
        known, (ids, sizes) = self.known, self.encode(words)
        known.words += words
        known.place.extend(map(self.place.get, words, repeat(-1)))
        known.hashes.extend(map(xxhash.xxh64_intdigest, words))
        known.sizes.frombytes(sizes.astype(np.int32).tobytes())
        known.starts.frombytes((len(known.pieces) + np.cumsum(sizes) - sizes).astype(np.int64).tobytes())
        known.pieces.frombytes(ids.tobytes())
        known.bytes += sum(map(len, words))

    def __call__(self, data: list[bytes | None]) -> Coded:
        known, words, counts = self.known, [], []
        for text in data:
            own = words_of(text)
            counts.append(len(own))
            words += own
        numbers, n_words = np.fromiter(map(known.index.__getitem__, words), np.int64, len(words)), np.array(counts, np.int64)
        if new := len(known.index) - len(known.words):
            self._add([*islice(reversed(known.index), new)][::-1])
        view = lambda x, kind: np.frombuffer(x, kind)[numbers] if len(numbers) else np.zeros(0, kind)
        # an end behind each text
        ends = np.cumsum(n_words)
        place = np.insert(view(known.place, np.int32).astype(np.int64), ends, self.place.get(END, -1))
        hashes = np.insert(view(known.hashes, np.uint64), ends, np.uint64(1))
        bare, starts = view(known.sizes, np.int32).astype(np.int64), view(known.starts, np.int64)
        size, n_tokens = np.insert(bare, ends, 1), n_words + 1
        pieces = np.full(size.sum(), self.end, np.uint16)
        inside = np.ones(len(pieces), bool)
        inside[np.cumsum(size)[np.cumsum(n_tokens) - 1] - 1] = False
        if len(numbers):
            at = np.arange(bare.sum()) + np.repeat(starts - (np.cumsum(bare) - bare), bare)
            pieces[inside] = np.frombuffer(known.pieces, np.uint16)[at]
        return Coded(words, numbers, n_tokens, place, hashes, size, pieces)


@dataclass(frozen=True)
class Coded:
    """A batch of texts: words and their numbers without, all other fields with the ends; ``size`` counts the pieces of each token."""

    words: list[bytes]
    numbers: np.ndarray
    n_tokens: np.ndarray
    place: np.ndarray
    hashes: np.ndarray
    size: np.ndarray
    pieces: np.ndarray

    def doc_pieces(self) -> np.ndarray:
        return np.add.reduceat(self.size, np.cumsum(self.n_tokens) - self.n_tokens)

    def phrases(self, settings: LmSettings) -> tuple[np.ndarray, np.ndarray]:
        """(last token, hash) of each phrase. Phrases end where the hash of two words says so, so equal passages are cut
        at equal places, and no phrase is longer than ``longest_phrase``."""
        h, n = self.hashes, len(self.hashes)
        before = np.concatenate([[np.uint64(0)], h[:-1]])
        doc_ends = np.cumsum(self.n_tokens) - 1
        before[(doc_ends + 1)[:-1]] = 0
        mixed = (h ^ before * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        last = (mixed >> np.uint64(32)) % np.uint64(settings.phrase) == 0
        last[doc_ends] = True
        first = np.append(0, np.flatnonzero(last)[:-1] + 1)
        length = np.diff(np.append(first, n))
        place = np.arange(n) - np.repeat(first, length)
        last |= (place + 1) % settings.longest_phrase == 0
        ends = np.flatnonzero(last)
        starts = np.append(0, ends[:-1] + 1)
        # a polynomial of the words' hashes for each phrase
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(settings.longest_phrase, _FACTOR)]))
        place = np.arange(n) - np.repeat(starts, ends - starts + 1)
        return ends, np.add.reduceat(h * power[place], starts)


#: Base of the phrases' hashes, an odd number.
_FACTOR = np.uint64(0x2545F4914F6CDD1D)


def windows(inputs: np.ndarray, targets: np.ndarray, sizes: np.ndarray, settings: LmSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, at): each window holds ``window`` inputs, of which the last ``stride`` predict a target.

    Takes the inputs and targets of all texts one after the other and how many each text has. The first ``window -
    stride`` inputs of a window repeat the window before and only give context, so each target is scored once. ``at`` has
    the place of every target among the flattened ones.
    """
    w, s = settings.window, settings.stride
    counts = -(-sizes // s)
    rows = np.cumsum(counts) - counts
    at = np.arange(len(targets)) + np.repeat(rows * s - (np.cumsum(sizes) - sizes), sizes)
    here, want = np.full(counts.sum() * s, PAD, np.int32), np.zeros(counts.sum() * s, targets.dtype)
    here[at], want[at] = inputs, targets
    here = here.reshape(-1, s)
    before = np.full((len(here), w - s), PAD, np.int32)
    before[1:] = here[:-1, 2 * s - w :]
    before[rows] = PAD
    return np.concatenate([before, here], axis=1), want.reshape(-1, s), at


class AttentionModel:
    """One causal attention layer whose state mixes ``classes`` distributions of the next piece.

    Query, key, value and own tables hold a row for each input piece. A state is the tanh of the own row and the attended
    value rows; class shares are the softmax of a linear map of the state and a row of the current piece (``turn``); each
    class has a distribution over the pieces.
    """

    NAMES = ("query", "key", "value", "own", "turn", "near", "gate", "gate0", "emit")

    def __init__(self, pieces: int, settings: LmSettings):
        self.settings, d, k = settings, settings.width, settings.classes
        rng = np.random.default_rng(settings.seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.query, self.key, self.value, self.own = (draw(pieces, d) for _ in range(4))
        self.turn, self.near = np.zeros((pieces, k), np.float32), np.zeros(settings.window, np.float32)
        self.gate, self.gate0, self.emit = draw(d, k), np.zeros(k, np.float32), draw(pieces, k) * 0.1
        back = np.arange(settings.window - settings.stride, settings.window)[:, None] - np.arange(settings.window)[None, :]
        self.causal = back >= 0
        self.back = np.where(self.causal, back, 0)

    def bias(self) -> np.ndarray:
        """Of each query and key place."""
        return np.where(self.causal, self.near[self.back], np.float32(-1e9)).astype(np.float32)

    def emissions(self) -> np.ndarray:
        """Distribution of each class over the input pieces."""
        emit = np.exp(self.emit - self.emit.max(axis=0))
        emit[PAD] = 0
        return emit / emit.sum(axis=0)

    def forward(self, inputs: np.ndarray, targets: np.ndarray, bias: np.ndarray, emit: np.ndarray) -> dict[str, np.ndarray]:
        """Probability of each target, batch by batch, with what the gradient needs."""
        here = inputs[:, -self.settings.stride :]
        q, k, v = self.query[here], self.key[inputs], self.value[inputs]
        a = q @ k.transpose(0, 2, 1)
        a += bias
        a -= (inputs == PAD)[:, None, :] * np.float32(1e9)
        np.clip(a, None, 60, out=a)
        np.exp(a, out=a)
        a /= np.maximum(a.sum(axis=2, keepdims=True), 1e-30)
        state = a @ v
        state += self.own[here]
        np.tanh(state, out=state)
        share = state @ self.gate
        share += self.gate0
        share += self.turn[here]
        share -= share.max(axis=2, keepdims=True)
        np.exp(share, out=share)
        share /= share.sum(axis=2, keepdims=True)
        each = emit[targets]
        each *= share
        return {"here": here, "q": q, "k": k, "v": v, "a": a, "state": state, "share": share, "each": each, "p": each.sum(axis=2)}

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean loss in nats, gradient of each table)."""
        emit = self.emissions()
        f = self.forward(inputs, targets, self.bias(), emit)
        weight = (scored / max(1, scored.sum())).astype(np.float32)[..., None]
        post = f["each"] / np.maximum(f["p"], 1e-30)[..., None] * weight
        dz = f["share"] * weight - post
        flat = lambda x: x.reshape(-1, x.shape[-1])
        dstate = (dz @ self.gate.T) * (1 - f["state"] ** 2)
        da = dstate @ f["v"].transpose(0, 2, 1)
        ds = f["a"] * (da - (f["a"] * da).sum(axis=2, keepdims=True))
        gathered = lambda ids, rows: sums_by(ids.ravel(), flat(rows), np.zeros((len(self.emit), rows.shape[-1]), np.float32))
        grad = {
            "query": gathered(f["here"], ds @ f["k"]),
            "key": gathered(inputs, ds.transpose(0, 2, 1) @ f["q"]),
            "value": gathered(inputs, f["a"].transpose(0, 2, 1) @ dstate),
            "own": gathered(f["here"], dstate),
            "turn": gathered(f["here"], dz),
            "near": np.bincount(self.back.ravel(), (ds.sum(axis=0) * self.causal).ravel(), self.settings.window).astype(np.float32),
            "gate": flat(f["state"]).T @ flat(dz),
            "gate0": dz.sum(axis=(0, 1)),
            "emit": emit * post.sum(axis=(0, 1)) - gathered(targets, post),
        }
        loss = -float((np.log(np.maximum(f["p"], 1e-30)) * weight[..., 0]).sum())
        return loss, grad

    def train(self, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> list[float]:
        """Adam over random batches of windows; the losses of all steps."""
        rng = np.random.default_rng(self.settings.seed)
        count = np.bincount(targets[scored], minlength=len(self.emit))
        self.emit += np.log((count + 0.5) / (count.sum() + 1)).astype(np.float32)[:, None]
        first = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        second = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        losses = []
        steps = min(self.settings.steps, 1 + self.settings.passes * len(inputs) // self.settings.batch)
        for step in range(1, steps + 1):
            some = rng.integers(0, len(inputs), self.settings.batch)
            loss, grad = self.gradients(inputs[some], targets[some], scored[some])
            losses.append(loss)
            rate = self.settings.rate * min(1, 2 * (1 - step / (steps + 1)))
            for n in self.NAMES:
                first[n] += 0.1 * (grad[n] - first[n])
                second[n] += 0.01 * (grad[n] ** 2 - second[n])
                getattr(self, n)[...] -= rate * first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
        return losses


def rows_of(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.take(table, ids, axis=0, mode="clip")


def sums_by(ids: np.ndarray, rows: np.ndarray, out: np.ndarray, few: int = 16) -> np.ndarray:
    """Adds each row to the row of ``out`` that its id names: ids with more than ``few`` rows one by one, all others
    together, the first row of each, then the second of each that has one, and so on."""
    if len(ids):
        ids = ids.astype(np.uint16)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        size, rows = np.diff(np.append(first, len(ids))), rows_of(rows, order)
        many = size > few
        for at, n in zip(first[many].tolist(), size[many].tolist()):
            out[ids[at]] += np.add.reduce(rows[at : at + n], axis=0)
        first, size = first[~many], size[~many]
        by_size = np.argsort(-size, kind="stable")
        first, size = first[by_size], size[by_size]
        if len(first):
            sums = rows_of(rows, first)
            for k in range(1, int(size[0])):
                have = int(np.searchsorted(-size, -k, "left"))
                sums[:have] += rows_of(rows, first[:have] + k)
            out[ids[first]] += sums
    return out


class Scorer:
    """The model as the tasks use it: input rows of all subword ids, and class distributions over all of them.

    ``seen`` ids have rows of ``emit``; each other id has the row ``rest``.
    """

    def __init__(self, model: AttentionModel, fold: np.ndarray, seen: np.ndarray, emit: np.ndarray, rest: np.ndarray):
        self.model, self.fold, self.seen, self.emit, self.rest = model, fold, seen, emit.astype(np.float32), rest.astype(np.float32)

    def opened(self, starts: np.ndarray) -> Scorer:
        """With the full tables, as a task needs them."""
        m = self.model
        self.table = np.tile(self.rest, (len(self.fold), 1))
        self.table[self.seen] = self.emit
        begins = self.table[starts].sum(axis=0, dtype=np.float64).astype(np.float32)
        self.sides = np.stack([begins, np.ones_like(begins)], axis=1)
        # a column of ones sums the attention beside the values
        self.pair = np.concatenate([m.key, m.value, np.ones((len(m.key), 1), np.float32)], axis=1)
        turn = m.turn + m.gate0
        self.here = np.concatenate([m.query, m.own, turn - turn.max(axis=1, keepdims=True)], axis=1)  # shares don't change by it
        self.gate, self.near = m.gate.copy(), m.near.copy()
        self.bounded()
        return self

    def bounded(self) -> None:
        """Exponents are bounded by the tables' norms; only beyond that are they shifted."""
        d, m = self.model.settings.width, self.model
        norm = lambda x: float(np.linalg.norm(x, axis=1).max())
        self.bias = np.where(m.causal, self.near[m.back], np.float32(-1e9)).astype(np.float32)
        self.lean = np.exp(self.bias)
        self.steep = norm(self.here[:, :d]) * norm(self.pair[:, :d]) + float(self.near.max()) > 80
        self.wide = float(np.abs(self.gate).sum(axis=0).max() + np.abs(self.here[:, 2 * d :]).max()) > 80

    def forward(self, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair rows, here rows, attention, attended values and their weight, state, class weights), the last two by
        target; neither attention nor class weights are divided by their sums."""
        d, stride = self.model.settings.width, self.model.settings.stride
        pair, here = rows_of(self.pair, inputs), rows_of(self.here, inputs[:, -stride:])
        a = here[:, :, :d] @ pair[:, :, :d].transpose(0, 2, 1)
        if self.steep:
            a += self.bias
            np.minimum(a, 60, out=a)
            np.exp(a, out=a)
        else:
            np.exp(a, out=a)
            a *= self.lean
        padded = np.flatnonzero(inputs[:, 0] == PAD)  # a text's first window; padding behind its end is masked by place
        if len(padded):
            a[padded] *= (inputs[padded] != PAD)[:, None, :]
        met = a @ pair[:, :, d:]
        np.maximum(met[:, :, d:], 1e-30, out=met[:, :, d:])
        state = met[:, :, :d] / met[:, :, d:]
        state += here[:, :, d : 2 * d]
        np.tanh(state, out=state)
        state = state.reshape(-1, d)
        share = state @ self.gate
        share += here[:, :, 2 * d :].reshape(share.shape)
        if self.wide:
            share -= share.max(axis=1, keepdims=True)
        return pair, here, a, met, state, np.exp(share, out=share)

    def weights(self, inputs: np.ndarray) -> np.ndarray:
        """Class weights of each target, not yet divided by their sums: (targets, classes)."""
        return self.forward(inputs)[-1]

    def chunks(self, coded: Coded, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(inputs, targets, which of them count) of ``chunk`` windows at a time."""
        sizes = coded.doc_pieces()
        inputs = np.empty(len(coded.pieces), np.int32)
        inputs[1:] = self.fold[coded.pieces[:-1]]
        inputs[np.cumsum(sizes) - sizes] = AT_END
        inputs, targets, at = windows(inputs, coded.pieces, sizes, self.model.settings)
        counts = np.zeros(targets.size, bool)
        counts[at] = True
        step = self.model.settings.stride
        for low in range(0, len(inputs), chunk):
            yield inputs[low : low + chunk], targets[low : low + chunk].ravel(), counts[low * step : (low + chunk) * step]

    def log10_probs(self, coded: Coded, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probability of each piece, and of that of any piece that starts a word or ends the text."""
        piece, border = [], []
        for inputs, want, counts in self.chunks(coded, chunk):
            share = self.weights(inputs)
            sides = share @ self.sides
            share *= rows_of(self.table, want)
            piece.append((share @ self.sides[:, 1] / sides[:, 1])[counts])
            border.append((sides[:, 0] / sides[:, 1])[counts])
        with np.errstate(divide="ignore"):
            return np.log10(np.concatenate(piece)).astype(np.float64), np.log10(np.concatenate(border)).astype(np.float64)

    def expect(self, coded: Coded, mass: np.ndarray, shares: np.ndarray, chunk: int = CHUNK) -> None:
        """Adds what gives the expected uses of each class: the model's own shares, and by piece, to be multiplied by the
        class distributions in the end, the class weights over the probability of the piece."""
        for inputs, want, counts in self.chunks(coded, chunk):
            share = self.weights(inputs)
            if not counts.all():
                share, want = share[counts], want[counts]
            shares += (1 / share.sum(axis=1)) @ share
            share /= np.maximum(np.einsum("nk,nk->n", share, rows_of(self.table, want)), 1e-30)[:, None]
            sums_by(want, share, mass)


class Learner:
    """Teaches the tables of an opened scorer with the windows of one task, each once, by steps of Adagrad, and gathers the
    expected uses of the classes on the way; the class distributions stay as they are meanwhile.

    All tables but these are rows of an input piece (``here`` and ``pair``) or common to all (``gate`` and ``near``).
    """

    def __init__(self, scorer: Scorer):
        self.scorer, s = scorer, scorer.model.settings
        self.tables = [scorer.here, scorer.pair, scorer.gate, scorer.near]
        self.began = [t.copy() for t in self.tables]
        self.grads, self.squares = ([np.zeros_like(t) for t in self.tables] for _ in range(2))
        self.mass, self.shares = np.zeros((len(scorer.fold), s.classes)), np.zeros(s.classes)
        self.met = np.zeros(len(scorer.here), np.int64)
        # what a step adds up: rows by input piece, by attended piece and by target
        stride, d, n = s.stride, s.width, s.step_windows
        self.ids = [np.empty((n, k), np.uint16) for k in (stride, s.window, stride)]
        self.rows = [np.empty((n, *shape), np.float32) for shape in ((stride, 2 * d + s.classes), (s.window, 2 * d + 1), (stride, s.classes))]
        self.waiting, self.filled = 0, 0

    def __call__(self, coded: Coded, chunk: int = CHUNK) -> None:
        for inputs, want, counts in self.scorer.chunks(coded, min(chunk, len(self.ids[0]))):
            if self.filled + len(inputs) > len(self.ids[0]):
                self.step()
            self._add(inputs, want, counts)

    def _add(self, inputs: np.ndarray, want: np.ndarray, counts: np.ndarray) -> None:
        sc, d = self.scorer, self.scorer.model.settings.width
        at = slice(self.filled, self.filled + len(inputs))
        by_here, by_pair, by_want = (r[at] for r in self.rows)
        own = inputs[:, -by_here.shape[1] :]
        for ids, new in zip(self.ids, (own, inputs, want.reshape(own.shape))):
            ids[at] = new
        pair, here, a, met, state, share = sc.forward(inputs)
        total = 1 / (share @ sc.sides[:, 1])
        if not counts.all():
            total[~counts] = 0
        share *= total[:, None]
        self.shares += np.ones(len(share), np.float32) @ share
        post = rows_of(sc.table, want)
        post *= share
        p = 1 / np.maximum(post @ sc.sides[:, 1], 1e-30)[:, None]
        np.multiply(share, p, out=by_want.reshape(share.shape))
        post *= p
        share -= post  # now what the loss asks of the class logits
        by_here[:, :, 2 * d :] = share.reshape(*own.shape, -1)
        dstate = share @ sc.gate.T
        self.grads[2] += (share.T @ state).T
        state *= state
        dstate *= np.subtract(1, state, out=state)
        dstate = dstate.reshape(*own.shape, d)
        by_here[:, :, d : 2 * d] = dstate
        a /= met[:, :, d:]
        met[:, :, :d] /= met[:, :, d:]
        wants = dstate @ pair[:, :, d : 2 * d].transpose(0, 2, 1)
        wants -= np.einsum("nsd,nsd->ns", dstate, met[:, :, :d])[:, :, None]
        wants *= a
        by_here[:, :, :d] = wants @ pair[:, :, :d]
        by_pair[:, :, :d] = wants.transpose(0, 2, 1) @ here[:, :, :d]
        by_pair[:, :, d : 2 * d] = a.transpose(0, 2, 1) @ dstate
        by_pair[:, :, 2 * d] = 0
        self.grads[3] += np.bincount(sc.model.back.ravel(), (wants.sum(axis=0) * sc.model.causal).ravel(), len(self.grads[3])).astype(np.float32)
        self.met += np.bincount(own.ravel()[counts], minlength=len(self.met))
        self.filled += len(inputs)
        self.waiting += int(counts.sum())

    def step(self) -> None:
        """One step by the mean gradient of what was added since the last."""
        if not self.waiting:
            return
        for ids, rows, out in zip(self.ids, self.rows, (self.grads[0], self.grads[1], self.mass)):
            sums_by(ids[: self.filled].ravel(), rows[: self.filled].reshape(-1, rows.shape[-1]), out)
        for table, grad, square in zip(self.tables, self.grads, self.squares):
            grad /= self.waiting
            square += grad * grad
            grad /= np.sqrt(square) + 1e-12
            grad *= self.scorer.model.settings.rate
            table -= grad
            grad[...] = 0
        self.waiting, self.filled = 0, 0
        self.scorer.bounded()

    def learned(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, weights, changes): the changes by ``classes`` at a time, multiplied by their weights, which are the
        targets that the row took part in; places count input rows first, then what is common to all."""
        self.step()
        k = self.scorer.model.settings.classes
        here, pair, gate, near = (t - b for t, b in zip(self.tables, self.began))
        rows = cut(np.concatenate([here, pair[:, :-1]], axis=1), k)
        common = cut(np.concatenate([gate.ravel(), near])[None], k)[0]
        some = np.flatnonzero(self.met)
        places = (some[:, None] * rows.shape[1] + np.arange(rows.shape[1])).ravel()
        weights = np.repeat(self.met[some], rows.shape[1])
        places = np.append(places, rows.shape[0] * rows.shape[1] + np.arange(len(common)))
        weights = np.append(weights, np.full(len(common), self.met.sum()))
        return places, weights, np.concatenate([rows[some].reshape(-1, k), common]) * weights[:, None].astype(np.float64)


def cut(rows: np.ndarray, k: int) -> np.ndarray:
    """Each row in parts of ``k``, zeros behind its end."""
    parts = -(-rows.shape[1] // k)
    return np.pad(rows, ((0, 0), (0, parts * k - rows.shape[1]))).reshape(len(rows), parts, k)


def taught(model: AttentionModel, places: np.ndarray, weights: np.ndarray, changes: np.ndarray) -> None:
    """Adds the mean of all tasks' changes, each row weighed by the targets that it took part in."""
    d, k = model.settings.width, model.settings.classes
    parts = -(-(4 * d + k) // k)
    n, common = len(model.own), model.gate.size + len(model.near)
    mean = np.zeros((n * parts - (-common // k), k), np.float64)
    some = weights > 0
    mean[places[some]] = changes[some] / weights[some, None]
    rows = mean[: n * parts].reshape(n, -1)
    model.query += rows[:, :d]
    model.own += rows[:, d : 2 * d]
    model.turn += rows[:, 2 * d : 2 * d + k]
    model.key += rows[:, 2 * d + k : 3 * d + k]
    model.value += rows[:, 3 * d + k : 4 * d + k]
    rest = mean[n * parts :].ravel()
    model.gate += rest[: model.gate.size].reshape(model.gate.shape)
    model.near += rest[model.gate.size : common]


def start_sample(docs: DataFrame, train: Column, rows: int) -> list[bytes]:
    """At most ``rows`` training texts with a word, chosen by hash of the id."""
    count = docs.filter(train).count()
    parts = 1 << 24
    sent = docs.filter(train & (F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < min(parts, 1 + 2 * rows * parts // max(1, count))))
    texts = sent.filter("octet_length(text) > 0").orderBy(F.xxhash64("doc_id"), "text").limit(rows).select("text").collect()
    return [bytes(r.text) for r in texts if words_of(r.text)]


def start(texts: list[bytes], ranks: bytes, settings: LmSettings) -> Scorer:
    """The model after its start; the most frequent ids of these texts have input rows of their own."""
    coded = Coder(ranks, settings, uuid.uuid4().hex, {})(texts)
    size = len(ranks.splitlines())
    used = np.bincount(coded.pieces, minlength=size)[:size]
    known = np.sort(np.argsort(-used, kind="stable")[: min(settings.pieces, int((used > 0).sum()))])
    fold = np.where(starting(ranks), OTHER_START, OTHER).astype(np.int32)
    fold[known], fold[size] = np.arange(4, 4 + len(known)), AT_END
    model = AttentionModel(len(known) + 4, settings)
    if texts:
        sizes = coded.doc_pieces()
        inputs = np.concatenate([[AT_END], fold[coded.pieces[:-1]]])
        inputs[np.cumsum(sizes) - sizes] = AT_END
        rows, want, at = windows(inputs, fold[coded.pieces], sizes, settings)
        scored = np.zeros(want.size, bool)
        scored[at] = True
        model.train(rows, want, scored.reshape(want.shape))
    emit = model.emissions()
    named = np.append(known, size)
    return Scorer(model, fold, named, emit[fold[named]], (emit[OTHER] + emit[OTHER_START]) / max(1, size - len(known)))


def settled(scorer: Scorer, pieces: np.ndarray, mass: np.ndarray, shares: np.ndarray, lesson: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Scorer:
    """The model with the tables that the tasks taught, the class distributions that the expected uses give, smoothed by the
    pieces' own shares, and class offsets that meet the uses of the classes."""
    model, smooth = scorer.model, scorer.model.settings.smooth
    if not len(pieces):
        return scorer
    if lesson:
        taught(model, *lesson)
    ids = len(scorer.fold)
    own = mass.sum(axis=1)
    whole = own.sum() + 0.01 * ids
    uses = mass.sum(axis=0)
    emit = (mass + smooth * ((own + 0.01) / whole)[:, None]) / (uses + smooth)
    model.gate0 = (model.gate0 + np.log((uses + 1) / (shares + 1))).astype(np.float32)
    return Scorer(model, scorer.fold, pieces, emit, smooth * (0.01 / whole) / (uses + smooth))


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most 64 rows and, unless one text is longer, ``most`` bytes of text (the last column)."""
    for batch in batches:
        ends = np.cumsum([0 if n is None else n for n in pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist()])
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
            upto = min(max(upto, at + 1), at + 64, batch.num_rows)
            yield batch.slice(at, upto - at)
            at = upto


def phrase_keys(hashes: np.ndarray) -> list[bytes]:
    """The names of phrases in word tables."""
    data = hashes.tobytes()
    return [PHRASE + data[k : k + 8] for k in range(0, len(data), 8)]


def _gathered(docs: DataFrame, scorer: Scorer, ranks: bytes, settings: LmSettings) -> DataFrame:
    """What the training texts teach, in one pass: counts of words and phrases (word, c), as counted in each task; the
    expected uses of the classes by piece (piece, mass); at piece -1 the model's own shares, and below, with their weights c,
    the changes of the attention tables by the windows of each task."""
    run_id = uuid.uuid4().hex
    names = ["word", "c", "piece", "mass"]
    kind = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, learner = Coder(ranks, settings, run_id, {}), Learner(scorer.opened(starting(ranks)))
        uses, texts = np.zeros(0, np.int64), 0

        def counts(words: list[bytes], c: list[int] | np.ndarray) -> pa.RecordBatch:
            none = len(words)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, kind)], names)

        def sums(pieces: np.ndarray, weights: np.ndarray | None, rows: np.ndarray) -> pa.RecordBatch:
            none = len(pieces)
            lists = pa.ListArray.from_arrays(np.arange(0, (none + 1) * settings.classes, settings.classes, np.int32), pa.array(rows.ravel(), pa.float64()))
            return pa.RecordBatch.from_arrays([pa.nulls(none, pa.binary()), pa.nulls(none, pa.int64()) if weights is None else pa.array(weights), pa.array(pieces, pa.int32()), lists], names)

        def word_counts() -> pa.RecordBatch:
            some = np.flatnonzero(uses)
            return counts([coder.known.words[k] for k in some], uses[some])

        for batch in _batches(batches, settings.batch_bytes):
            if coder.full():
                yield word_counts()
                coder.known.clear()
                uses = np.zeros(0, np.int64)
            coded = coder(batch.column(0).to_pylist())
            learner(coded)
            if len(uses) < len(coder.known.words):
                uses = np.append(uses, np.zeros(2 * len(coder.known.words) - len(uses), np.int64))
            np.add.at(uses, coded.numbers, 1)
            texts += batch.num_rows
            _, hashes = coded.phrases(settings)
            hashes, c = np.unique(hashes, return_counts=True)
            yield counts(phrase_keys(hashes), c)
        yield word_counts()
        yield counts([END], [texts])
        places, weights, changes = learner.learned()
        yield sums(-2 - places, weights, changes)
        mass = learner.mass * learner.scorer.table
        some = np.flatnonzero(mass.sum(axis=1))
        yield sums(np.append(-1, some), None, np.concatenate([learner.shares[None], mass[some]]))

    return docs.select("text").mapInArrow(run, "word binary, c long, piece int, mass array<double>")


def expected_uses(gathered: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pieces, mass, shares, what :func:`taught` takes) over all tasks; a row for each subword id and each part of a
    table's row at most, whatever the corpus."""
    sums = [F.sum(F.get("mass", F.lit(k))).alias(f"m{k}") for k in range(classes)]
    table = gathered.filter("piece is not null").groupBy("piece").agg(F.sum("c").alias("c"), *sums).toArrow().sort_by("piece")
    mass = np.array([c.to_numpy() for c in table.columns[2:]], np.float64).T.reshape(table.num_rows, classes)
    pieces = table.column("piece").to_numpy()
    below = int(np.searchsorted(pieces, -1))
    lesson = -2 - pieces[:below], table.column("c").slice(0, below).to_numpy(), mass[:below]
    pieces, mass = pieces[below:], mass[below:]
    return pieces[1:], mass[1:], mass[0] if len(mass) else np.zeros(classes), lesson


def frequent_words(counts: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """Words (word, c) of at most ``most_bytes`` bytes and at least some count, as low as ``most`` words allow; found on a histogram, so nothing is sorted.

    Counts up to 1024 have a bucket each, larger ones eight to a doubling. Words of one bucket are in or out together.
    """
    words = counts.filter(~F.startswith("word", F.lit(PHRASE)) & (F.octet_length("word") <= most_bytes))
    bucket = F.when(F.col("c") < 1024, F.col("c")).otherwise(1024 + F.floor(8 * F.log2(F.col("c") / 1024))).cast("long")
    sizes = sorted(words.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect(), reverse=True)
    least, held = None, 0
    for size in sizes:
        held += size.n
        if held > most:
            break
        least = size.bucket
    return words.filter(bucket >= least) if least is not None else words.limit(0)


def _scored(docs: DataFrame, scorer: Scorer, ranks: bytes, hot: pa.Table, total: int, settings: LmSettings) -> DataFrame:
    """Three kinds of rows: of a text (word null), with its part of the base score; of each of its phrases, with the log10
    of the mixture of its words and how often the text itself taught it; and of each of its words that isn't frequent, with the log10 of its
    mixture without the corpus counts."""
    hot_words, hot_counts = hot.column("word").to_pylist(), hot.column("c").to_numpy()
    names = ["row_id", "doc_id", "phrase", "word", "n", "n_known", "base", "model", "part"]
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(ranks, settings, run_id, {word: k for k, word in enumerate(hot_words)})
        opened = scorer.opened(starting(ranks))
        logs = np.append(np.log10((hot_counts + 1) / total), 0.0)
        chance = np.append((hot_counts + 1) / total, 0.0)
        by_model, by_count, by_copy = settings.shares
        row_id = TaskContext.get().partitionId() << 36

        for batch in _batches(batches, settings.batch_bytes):
            if coder.full():
                coder.known.clear()
            coded = coder(batch.column(2).to_pylist())
            ids = row_id + np.arange(batch.num_rows)
            row_id += batch.num_rows
            n, place = coded.n_tokens, coded.place
            ends, starts = np.cumsum(n) - 1, np.cumsum(n) - n
            doc_of = np.repeat(np.arange(len(n)), n)
            # a word's own probability: given that a word starts, and with its end; over a text the borders cancel
            piece, border = opened.log10_probs(coded)
            first = np.cumsum(coded.size) - coded.size
            word = np.add.reduceat(piece, first) - border[first] + np.append(border[first[1:]], 0.0)
            word[ends] = piece[first[ends]] - border[first[ends]]
            # how often each word stood before in its text
            same = coded.hashes + doc_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            order = np.argsort(same, kind="stable")
            heads = np.flatnonzero(np.append(True, same[order][1:] != same[order][:-1]))
            before = np.empty(len(place))
            before[order] = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
            mixed = by_model * 10**word + by_count * chance[place] + by_copy * before / (np.arange(len(place)) - starts[doc_of] + 1)
            mixed = np.where(mixed > 1e-290, np.log10(np.maximum(mixed, 1e-300)), word + np.log10(by_model))
            known = place >= 0
            none = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), batch.column(0), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary()), pa.array(n), pa.array(np.add.reduceat(known, starts, dtype=np.int64)), pa.array(np.add.reduceat(np.where(known, logs[place], 0.0), starts)), pa.array(np.add.reduceat(word, starts)), pa.nulls(none, pa.float64())],
                names,
            )
            last, hashes = coded.phrases(settings)
            part = np.add.reduceat(mixed, np.append(0, last[:-1] + 1))
            of = doc_of[last]
            number = np.arange(len(last)) - np.searchsorted(of, of)
            _, which, own = np.unique(hashes + of.astype(np.uint64) * _FACTOR, return_inverse=True, return_counts=True)
            own = own[which] * np.array(batch.column(1).to_pylist(), np.int64)[of]
            rare = np.flatnonzero(~known)
            phrase_of = number[np.searchsorted(last, rare)]
            words = coded.words
            rare_words = [END if k == e else words[k - d] for k, d, e in zip(rare.tolist(), doc_of[rare].tolist(), ends[doc_of[rare]].tolist())]
            none = len(last) + len(rare)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids[of], ids[doc_of[rare]]])),
                    pa.nulls(none, pa.int64()),
                    pa.array(np.concatenate([number, phrase_of]), pa.int32()),
                    pa.array(phrase_keys(hashes) + rare_words, pa.binary()),
                    pa.array(np.concatenate([own, np.ones(len(rare), np.int64)])),
                    pa.nulls(none, pa.int64()),
                    pa.nulls(none, pa.float64()),
                    pa.nulls(none, pa.float64()),
                    pa.array(np.concatenate([part, mixed[rare]])),
                ],
                names,
            )

    return docs.select("doc_id", "train", "text").mapInArrow(run, "row_id long, doc_id long, phrase int, word binary, n long, n_known long, base double, model double, part double")


def score_texts(docs: DataFrame, train: Column, ranks_path: str = RANKS_PATH, settings: LmSettings = LmSettings()) -> DataFrame:
    """Scores of every row of ``docs``, learned from the rows where ``train`` holds.

    (doc_id, n_tokens, n_known, train_tokens, base_score, score, token_score, model_score, repeated).

    A text's tokens are its words, A-Z lowered, and an end. ``base_score`` sums the log10 of (c+1)/(N+V+1) with the
    counts of the whole training part. ``score`` is the log10 probability of the same words. Each word is a mixture by
    ``shares`` of the attention model on the subwords so far, the corpus counts of all words and the words so far; each
    phrase, a run of words up to a border that the words themselves set, is a mixture of these words and, by ``memory``,
    the share of this phrase among those of all other training texts. ``token_score`` is the score of a token,
    ``model_score`` that of the attention model alone, ``repeated`` the share of phrases that other training texts hold. Null texts count as empty: one end. Repeated rows
    get a row each; other columns are ignored; without training rows all counts are 0.
    """
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), train.alias("train"))
    taught = slim.filter("train")
    scorer = start(start_sample(slim, F.col("train"), settings.start_texts), ranks, settings)
    gathered = stored(_gathered(taught, scorer, ranks, settings), "lm-gathered")
    scorer = settled(scorer, *expected_uses(gathered, settings.classes))
    counts = stored(gathered.filter("word is not null").groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")
    is_phrase = F.startswith("word", F.lit(PHRASE))
    zero = F.lit(0).cast("long")
    train_tokens, types, phrases = counts.agg(F.coalesce(F.sum(F.when(~is_phrase, F.col("c"))), zero), F.count_if(~is_phrase), F.coalesce(F.sum(F.when(is_phrase, F.col("c"))), zero)).first()
    total = train_tokens + types + 1
    hot = frequent_words(counts, settings.hot_words, settings.hot_bytes).toArrow()
    rows = stored(_scored(slim, scorer, ranks, hot, total, settings), "lm-rows")

    c, log = F.coalesce("c", zero), lambda x: F.log10(F.nullif(x, F.lit(0.0)))
    added = lambda x, y: F.greatest(x, y) + F.coalesce(F.log10(1 + F.pow(F.lit(10.0), -F.abs(x - y))), F.lit(0.0))  # noqa: E731  log10(10^x + 10^y), y may be null
    chance = log(settings.shares[1] * (c + 1) / F.lit(float(total)))
    known = c > 0
    met = rows.filter("word is not null").join(counts, "word", "left").select(
        "row_id",
        "phrase",
        F.when(is_phrase, F.col("part")).otherwise(F.when(known, added(F.col("part"), chance) - F.col("part")).otherwise(0.0)).alias("part"),
        F.when(is_phrase, log(settings.memory * F.greatest(c - F.col("n"), zero) / F.lit(float(max(1, phrases))))).alias("memory"),
        F.when(~is_phrase & known, 1).otherwise(0).alias("known_rest"),
        F.when(~is_phrase, F.log10((c + 1) / F.lit(float(total)))).otherwise(0.0).alias("base_rest"),
    )
    by_phrase = met.repartition("row_id").groupBy("row_id", "phrase").agg(F.sum("part").alias("part"), F.max("memory").alias("memory"), F.sum("known_rest").alias("known_rest"), F.sum("base_rest").alias("base_rest"))
    score = added(F.col("part") + math.log10(1 - settings.memory), F.col("memory"))
    rest = by_phrase.groupBy("row_id").agg(F.sum(score).alias("score"), F.sum("known_rest").alias("known_rest"), F.sum("base_rest").alias("base_rest"), F.avg(F.col("memory").isNotNull().cast("double")).alias("repeated"))
    out = rows.filter("word is null").select("row_id", "doc_id", "n", "n_known", "base", "model").join(rest, "row_id", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("n_known") + F.col("known_rest")).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("base_rest")).alias("base_score"),
        "score",
        (F.col("score") / F.col("n")).alias("token_score"),
        F.col("model").alias("model_score"),
        "repeated",
    )


def lm_report(docs: DataFrame, settings: LmSettings = LmSettings()) -> DataFrame:
    """Scores of all rows with ``held_out``: a seventh of the ids, by crc32, takes no part in the learning."""
    held_out = in_fold(F.col("doc_id"), 7, 2)
    scored = score_texts(docs, ~held_out, settings=settings)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "token_score", "model_score", "repeated")
