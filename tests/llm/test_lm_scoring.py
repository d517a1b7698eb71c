import dataclasses
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trussline.llm import lm_scoring as lm

SMALL = lm.LmSettings(steps=30, start_texts=50, hot_words=200)
RANKS = open(lm.RANKS_PATH, "rb").read()


def code(texts, settings=SMALL, place=None):
    return lm.Coder(RANKS, settings, repr((texts, settings))[:200], place or {})(texts)


def test_windows_score_each_token_once():
    s = lm.LmSettings(window=8, stride=6)
    r = np.random.default_rng(1)
    streams = [r.integers(4, 50, n).tolist() for n in (0, 1, 4, 5, 6, 7, 30)]
    sizes = np.array([len(x) + 1 for x in streams])
    full = [[0, *x] for x in streams]
    inputs, targets, at = lm.windows(np.concatenate(full), np.concatenate([[*x, 99] for x in streams]), sizes, s)
    assert targets.ravel()[at].tolist() == [y for x in streams for y in (*x, 99)]
    flat = iter(at)
    for own in full:
        for k in range(len(own)):
            row, col = divmod(next(flat), s.stride)
            seen = inputs[row, : s.window - s.stride + col + 1]
            assert inputs[row, s.window - s.stride + col] == own[k]
            assert seen[seen != lm.PAD].tolist() == own[max(0, k - len(seen) + 1) : k + 1]


def test_targets_see_nine_to_thirty_two_inputs():
    inputs, _, at = lm.windows(np.arange(3, 203), np.zeros(200, int), np.array([200]), lm.LmSettings())
    first = 32 - 24
    seen = [(inputs[k // 24, : first + k % 24 + 1] != lm.PAD).sum() for k in at]
    assert seen[:9] == list(range(1, 10)) and min(seen[9:]) == 9 and max(seen) == 32


def some_windows(r, s, sizes=(3, 9, 14)):
    streams = [r.integers(4, 12, n) for n in sizes]
    inputs, targets, at = lm.windows(np.concatenate([[0, *x] for x in streams]), np.concatenate([[*x, 0] for x in streams]), np.array([n + 1 for n in sizes]), s)
    scored = np.zeros(targets.size, bool)
    scored[at] = True
    return inputs, targets, scored.reshape(targets.shape)


def test_gradients():
    s = lm.LmSettings(width=4, classes=5, window=6, stride=4)
    m = lm.AttentionModel(12, s)
    for n in m.NAMES:
        setattr(m, n, getattr(m, n).astype(np.float64))
    r = np.random.default_rng(0)
    inputs, targets, scored = some_windows(r, s)
    _, grad = m.gradients(inputs, targets, scored)
    for n in m.NAMES:
        table = getattr(m, n)
        for k in r.integers(0, table.size, 4):
            was, loss = table.flat[k], []
            for step in (1e-4, -1e-4):
                table.flat[k] = was + step
                loss.append(m.gradients(inputs, targets, scored)[0])
            table.flat[k] = was
            assert (loss[0] - loss[1]) / 2e-4 == pytest.approx(grad[n].flat[k], abs=2e-4), n


@pytest.fixture(scope="module")
def texts(tables):
    return [(r.doc_id, r.text) for r in tables("documents").limit(60).collect()]


@pytest.fixture(scope="module")
def started(texts):
    return lm.start([t.encode() for _, t in texts if t], RANKS, SMALL).opened(lm.starting(RANKS))


def plain_shares(scorer, coded):
    """Class shares of every piece by the model's own forward pass, one text at a time and without windows in batches."""
    m, s, out, at = scorer.model, scorer.model.settings, [], 0
    for n in coded.doc_pieces():
        own = [lm.AT_END, *scorer.fold[coded.pieces[at : at + n - 1]]]
        for k in range(n):
            low = max(0, k // s.stride * s.stride - (s.window - s.stride))
            seen = np.array(own[low : k + 1])
            a = np.exp(m.key[seen] @ m.query[own[k]] + m.near[k - low - np.arange(len(seen))])
            state = np.tanh(m.own[own[k]] + a @ m.value[seen] / a.sum())
            z = state @ m.gate + m.gate0 + m.turn[own[k]]
            out.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        at += n
    return np.array(out)


def test_batches_equal_the_plain_model(started, texts):
    coded = code([b"", None, *(t.encode()[:600] for _, t in texts[:8] if t)])
    share = plain_shares(started, coded)
    piece, border = started.log10_probs(coded)
    assert np.allclose(10**piece, (share * started.table[coded.pieces]).sum(axis=1), rtol=1e-3)
    assert np.allclose(10**border, share @ started.table[lm.starting(RANKS)].sum(axis=0, dtype=np.float64), rtol=1e-3)
    assert np.allclose(started.table.sum(axis=0, dtype=np.float64), 1, atol=1e-3)
    mass, shares = np.zeros((len(started.fold), SMALL.classes)), np.zeros(SMALL.classes)
    started.expect(coded, mass, shares)
    mass *= started.table
    want = np.zeros_like(mass)
    post = share * started.table[coded.pieces]
    np.add.at(want, coded.pieces, post / post.sum(axis=1, keepdims=True))
    assert np.allclose(mass, want, atol=1e-3) and np.allclose(shares, share.sum(axis=0), rtol=1e-3)


def test_the_estimate_from_all_windows_helps(started, texts):
    coded = code([t.encode() for _, t in texts if t])
    before = started.log10_probs(coded)[0].sum()
    mass, shares = np.zeros((len(started.fold), SMALL.classes)), np.zeros(SMALL.classes)
    started.expect(coded, mass, shares)
    mass *= started.table
    some = np.flatnonzero(mass.sum(axis=1))
    fresh = lm.start([t.encode() for _, t in texts if t], RANKS, SMALL)
    after = lm.settled(fresh, some, mass[some], shares).opened(lm.starting(RANKS))
    assert np.allclose(after.table.sum(axis=0, dtype=np.float64), 1, atol=1e-3)
    assert after.log10_probs(coded)[0].sum() > before


def test_attention_is_causal(started):
    one, two = (started.log10_probs(code([x]))[0] for x in (b"the end of a day and so on", b"the end of a day zq7"))
    assert np.allclose(one[:5], two[:5], rtol=1e-5)


def test_codes(texts):
    coded = code([b"A b", None, b"", b"b \xc3\x89" + b"x" * 5000], place={b"b": 7, lm.END: 0})
    assert coded.words[:3] == [b"a", b"b", b"b"] and coded.n_tokens.tolist() == [3, 1, 1, 3]
    assert coded.place.tolist() == [-1, 7, 0, 0, 0, 7, -1, 0] and len(coded.pieces) == coded.size.sum()
    assert (coded.pieces == 50256).sum() == 4 and coded.hashes[1] == coded.hashes[5]


@pytest.mark.parametrize("odd", [b"", b"\xff\xfe ok"])
def test_new_words_are_encoded_together_once(odd):
    """Each new word of a batch once, with the subword ids that it has alone, whatever stands in it."""
    data = ["a\u00a0b \x85c \x1cd x\u3000y <|endoftext|> don't Don't \u00e9\u00c9 12,5 don't".encode(), odd, ("w" * 3000 + " \U0001f600").encode()]
    coder, calls = lm.Coder(RANKS, SMALL, repr(odd), {}), []
    encode = coder.encode
    coder.encode = lambda words: calls.append(words) or encode(words)
    coded, again = coder(data), coder(data[::-1])
    words = [w for text in data for w in lm.words_of(text)]
    assert calls == [list(dict.fromkeys(words))] and coder.known.words == calls[0]
    single = lm.encoding(RANKS)._core_bpe.encode_single_piece
    want = [[k for w in lm.words_of(text) for k in single(b" " + w)] + [coder.end] for text in data]
    assert coded.pieces.tolist() == sum(want, []) and again.pieces.tolist() == sum(want[::-1], [])


def test_a_small_lexicon_changes_nothing(docs, texts):
    rows = texts[:30] + [(9003, "NEW new É " * 50)]
    one, two = ({r.doc_id: r.score for r in lm.lm_report(docs(rows), dataclasses.replace(SMALL, lexicon_words=n, batch_bytes=4000)).collect()} for n in (100, 1 << 19))
    assert one == pytest.approx(two, rel=1e-5)


def test_equal_passages_have_equal_phrases():
    s, r = SMALL, np.random.default_rng(2)
    passage = " ".join(f"w{k}" for k in r.integers(0, 500, 400)).encode()
    coded = code([b"x y z " + passage, passage + b" q", b"same " * 1000])
    last, hashes = coded.phrases(s)
    size = np.diff(np.append(-1, last))
    assert size.max() <= s.longest_phrase and last[-1] == len(coded.hashes) - 1
    of = np.searchsorted(np.cumsum(coded.n_tokens) - 1, last)
    one, two = set(hashes[of == 0].tolist()), set(hashes[of == 1].tolist())
    assert len(one & two) >= min(len(one), len(two)) - 2


def plain_base(rows, train):
    words = {k: [w for w in (t or "").encode().lower().split()] + [b"\n"] for k, t in rows}
    c = Counter(w for k, ws in words.items() if train(k) for w in ws)
    n, v = sum(c.values()), len(c)
    return n, {k: (len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for k, ws in words.items()}


@pytest.mark.parametrize("hot", [200, 3, 1])
def test_base_scores(docs, texts, hot):
    rows = texts + [(9001, None), (9002, ""), (9003, "NEW new\tÉ é\x0bx" * 50), (9004, "w" * 30000), (9005, "un " * 3000)]
    got = lm.lm_report(docs(rows, {"word": "a", "n": "b", "phrase": "c"}), dataclasses.replace(SMALL, hot_words=hot)).collect()
    train = lambda k: zlib.crc32(str(k).encode()) % 7 != 2
    n, want = plain_base(rows, train)
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (not train(r.doc_id)) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and r.base_score == pytest.approx(want[r.doc_id][2], rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score) and math.isfinite(r.model_score)


def plain_scores(rows, train, scorer, settings):
    """Scores word by word and phrase by phrase."""
    word_count, phrase_count, per_doc = Counter(), Counter(), []
    for k, text in rows:
        coded = code([(text or "").encode()], settings)
        last, hashes = coded.phrases(settings)
        words = [*coded.words, lm.END]
        per_doc.append((coded, last, hashes.tolist(), words))
        if train(k):
            word_count.update(words)
            phrase_count.update(hashes.tolist())
    n, v, m = sum(word_count.values()), len(word_count), sum(phrase_count.values())
    out = []
    for (k, _), (coded, last, hashes, words) in zip(rows, per_doc):
        piece, border = scorer.log10_probs(coded)
        edge = np.cumsum([0, *coded.size])
        model = [piece[a:b].sum() - border[a] + (border[b] if b < len(border) else 0) for a, b in zip(edge, edge[1:])]
        a, b, c = settings.shares
        each = [a * 10**x + (b * (word_count[w] + 1) / (n + v + 1) if word_count[w] else 0) + c * words[:i].count(w) / (i + 1) for i, (x, w) in enumerate(zip(model, words))]
        total, at = 0, 0
        for e, h in zip(last, hashes):
            others = phrase_count[h] - (hashes.count(h) if train(k) else 0)
            total += math.log10((1 - settings.memory) * math.prod(each[at : e + 1]) + settings.memory * others / m)
            at = e + 1
        out.append((total, sum(model)))
    return out


@pytest.mark.parametrize("hot", [1, 200, 1 << 18])
def test_scores_equal_the_plain_mixture(docs, texts, hot):
    rows = [(k, t) for k, t in texts[:25] if t and len(t) < 4000] + [(9001, None), (9003, "NEW new\tÉ é\x0bx " * 20), (9004, "once " * 30), (9005, "a b c d"), (9006, "a b c d")]
    s = dataclasses.replace(SMALL, hot_words=hot, longest_phrase=20)
    train = lambda k: zlib.crc32(str(k).encode()) % 7 != 2
    table = docs(rows)
    slim = table.select("doc_id", F.col("text").cast("binary").alias("text"))
    held = ~lm.in_fold(F.col("doc_id"), 7, 2)
    scorer = lm.start(lm.start_sample(slim, held, s.start_texts), RANKS, s)
    gathered = lm._gathered(slim.filter(held), scorer, RANKS, s)
    scorer = lm.settled(scorer, *lm.expected_uses(gathered, s.classes)).opened(lm.starting(RANKS))
    want = plain_scores(rows, train, scorer, s)
    got = {r.doc_id: (r.score, r.model_score) for r in lm.lm_report(table, s).collect()}
    for (k, _), w in zip(rows, want):
        assert got[k] == pytest.approx(w, rel=1e-4, abs=1e-4), k


def test_held_out_texts_score_above_the_base(spark):
    """Rows that took no part in the learning: above the base in all, and where no other text repeats them no more than
    three hundredths below it (the base charges every unseen word alike; the score spells it)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.lm_report(docs).filter("held_out and repeated < 0.2").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 1.03 * got[1]
    both = lm.lm_report(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert both[0] > both[1]


def test_texts_that_occur_twice_stand_out(docs, texts):
    r = np.random.default_rng(7)
    fresh = [(5000 + k, " ".join(f"{chr(97 + x % 26)}{x}" for x in r.integers(0, 5000, 200))) for k in range(20)]
    twice = [(k + 100, t) for k, t in fresh[:5]]
    got = {r.doc_id: r.token_score for r in lm.lm_report(docs(texts + fresh + twice), SMALL).collect()}
    taught = lambda k: zlib.crc32(str(k).encode()) % 7 != 2  # noqa: E731  only what was learned can be met again
    both = [got[k] for (one, _), (two, _) in zip(fresh, twice) for k, other in ((one, two), (two, one)) if taught(other)]
    assert len(both) > 5 and min(both) > max(got[k] for k, _ in fresh[5:])


def test_edges(docs):
    assert lm.lm_report(docs([]), SMALL).count() == 0
    rows = [(None, "a b", None, None), (None, "a b", None, None), (3, "a", None, None)]
    got = lm.score_texts(docs(rows), F.lit(False), settings=SMALL).collect()
    assert len(got) == 3 and {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)}
    assert all(math.isfinite(r.score) for r in got)


def test_frequent_words(spark):
    counts = spark.createDataFrame([(bytearray(f"w{k}".encode()), c) for k, c in enumerate([5000, 3000, 1500, 900, 7, 7, 7, 1, 1])], "word binary, c long")
    for most, want in ((0, 0), (1, 1), (3, 3), (4, 4), (6, 4), (7, 7), (100, 9)):
        got = lm.frequent_words(counts, most, 64).collect()
        assert len(got) == want and (not got or min(r.c for r in got) >= max([5000, 3000, 1500, 900, 7, 7, 7, 1, 1, 0][want:]))


def test_the_learner_takes_the_gradient_of_the_model(texts):
    own = [t.encode()[:900] for _, t in texts[:12] if t]
    scorer = lm.start(own, RANKS, SMALL)
    learner, coded, model = lm.Learner(scorer.opened(lm.starting(RANKS))), code(own), scorer.model
    learner.step = lambda: None
    learner(coded, chunk=7)
    grads = [np.zeros_like(g) for g in learner.grads[:2]]
    for ids, rows, out in zip(learner.ids, learner.rows, grads):
        np.add.at(out, ids[: learner.filled].ravel(), rows[: learner.filled].reshape(-1, rows.shape[-1]))
    inputs, want, counts = (np.concatenate(x) for x in zip(*scorer.chunks(coded, 100)))
    shape = (len(inputs), SMALL.stride)
    _, grad = model.gradients(inputs, scorer.fold[want].reshape(shape), counts.reshape(shape))
    got = np.concatenate([*grads, np.zeros((len(grads[0]), 0))], axis=1) / learner.waiting
    want = np.concatenate([grad[n] for n in ("query", "own", "turn", "key", "value")], axis=1)
    assert learner.waiting == len(coded.pieces) and np.allclose(got[:, :-1], want, atol=1e-6)
    assert np.allclose(learner.grads[2] / learner.waiting, grad["gate"], atol=1e-5) and np.allclose(learner.grads[3] / learner.waiting, grad["near"], atol=1e-5)


def test_sums_by(started):
    r = np.random.default_rng(3)
    ids, rows = np.minimum(r.zipf(1.4, 3000), 400), r.normal(size=(3000, 5)).astype(np.float32)
    want = np.ones((500, 5))
    np.add.at(want, ids, rows)
    assert np.allclose(lm.sums_by(ids, rows, np.ones((500, 5))), want, atol=1e-4)


def test_every_training_window_teaches_the_attention_tables(docs, texts):
    """The start sees twenty texts; all others change the tables, too, and what they teach helps texts that nobody saw."""
    s = dataclasses.replace(SMALL, start_texts=20, step_windows=64)
    slim = docs(texts).select("doc_id", F.col("text").cast("binary").alias("text")).repartition(3)
    held = ~lm.in_fold(F.col("doc_id"), 7, 2)
    sample = lm.start_sample(slim, held, s.start_texts)
    taught = [t.encode() for k, t in texts if t and zlib.crc32(str(k).encode()) % 7 != 2]
    coded, fresh = code(taught, s), code([t.encode() for k, t in texts if t and zlib.crc32(str(k).encode()) % 7 == 2], s)
    pieces, mass, shares, lesson = lm.expected_uses(lm._gathered(slim.filter(held), lm.start(sample, RANKS, s), RANKS, s), s.classes)
    empty = sum(not t for k, t in texts if zlib.crc32(str(k).encode()) % 7 != 2)
    assert lesson[1][lesson[0].argmax()] == len(coded.pieces) + empty  # targets behind the common tables: all of them
    plain = lm.start(sample, RANKS, s).opened(lm.starting(RANKS))
    before, after = np.zeros((len(plain.fold), s.classes)), np.zeros(s.classes)
    plain.expect(coded, before, after)
    before = (before * plain.table)[pieces]
    plain = lm.settled(lm.start(sample, RANKS, s), pieces, before, after).opened(lm.starting(RANKS))
    scorer = lm.settled(lm.start(sample, RANKS, s), pieces, mass, shares, lesson).opened(lm.starting(RANKS))
    used = np.unique(np.concatenate([[lm.AT_END], scorer.fold[coded.pieces]]))
    for n in ("query", "key", "value", "own", "turn"):
        changed = np.flatnonzero((getattr(scorer.model, n) != getattr(plain.model, n)).any(axis=1))
        assert len(np.setdiff1d(used, changed)) <= 1, n  # an end is no input but at the start
    assert scorer.log10_probs(fresh)[0].sum() > plain.log10_probs(fresh)[0].sum()


def test_tasks_are_averaged_by_the_targets_of_each_row():
    s = lm.LmSettings(width=2, classes=3, window=6, stride=4)
    model, zero = lm.AttentionModel(5, s), lm.AttentionModel(5, s)
    rows = np.arange(5 * 4 * 3, dtype=float).reshape(-1, 3)  # 4 * 2 + 3 columns in 4 parts
    places = np.array([4, 5, 6, 7, 20])
    weights = np.array([2, 2, 2, 2, 10])
    lm.taught(model, places, weights, np.concatenate([rows[4:8] * 2, [[10.0, 20, 30]]]))
    row = rows[4:8].ravel()
    for n, at in (("query", 0), ("own", 2), ("turn", 4), ("key", 7), ("value", 9)):
        change = getattr(model, n) - getattr(zero, n)
        assert np.allclose(change[1], row[at : at + change.shape[1]], atol=1e-5) and not change[[0, 2, 3, 4]].any()
    assert np.allclose((model.gate - zero.gate).ravel(), [1, 2, 3, 0, 0, 0], atol=1e-6) and np.allclose(model.near, zero.near)
