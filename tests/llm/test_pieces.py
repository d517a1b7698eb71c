import random

import numpy as np
import pytest
import sentencepiece

from trussline.llm import pieces as ps

MODEL = ps.read_model()


@pytest.fixture(scope="module")
def table():
    return ps.load(MODEL)


def ids(table, text):
    return np.frombuffer(ps.encode_text(*table, text), np.int32).tolist()


def whole_text(table, text):
    """Viterbi over the whole text at once, without windows, caches or borders."""
    p = table[0]
    if not text:
        return []
    return exact(p, ps.SPACE + text.replace(ps.SPACE, ps.LITERAL).replace(" ", ps.SPACE))


def exact(p, text):
    best, back = [0] + [ps.NEVER] * len(text), [0] * (len(text) + 1)
    ps.relax(p, text, best, back, 0, len(text))
    return ps.follow(p, text, back, len(text))


LETTERS = ["a", "th", "the", " ", "  ", "\n", "é", "▁", "漢", "x", "ing", "😀", "\x00", "1", "the▁x", " \n"]


def test_streams_equal_the_whole_text(table):
    r = random.Random(2)
    for n in range(400):
        text = "".join(r.choice(LETTERS) for _ in range(r.randrange(0, 900 if n % 20 == 0 else 30)))
        want = whole_text(table, text)
        assert ids(table, text) == want and ps.decode_ids(table[0], want) == text
        chunks, k = [], 0
        while k < len(text):
            chunks.append(text[k : k + (size := r.randrange(1, 50))])
            k += size
        assert list(ps.encode_stream(table[0], chunks)) == want


def test_the_window_stays_bounded(table):
    run, kept = ps.Viterbi(table[0]), []
    for _ in range(400):
        run.push("thentionerea" * 20)
        kept.append(len(run.text))
    assert max(kept) < 2000


def test_runs_of_one_unit_take_the_exact_path(table):
    for unit in ("a", " ", "-", "ab", "the", "é", "漢", "x1"):
        text = unit * (300_000 // len(unit))
        run, ids = ps.Viterbi(table[0]), []
        marked = ps.SPACE + text.replace(" ", ps.SPACE)
        for k in range(0, len(marked), 1000):
            ids += run.push(marked[k : k + 1000])
        ids += run.finish()
        assert ids == exact(table[0], marked) and ps.decode_ids(table[0], ids) == text


def test_periodic_texts_take_the_exact_path(table):
    r = random.Random(3)
    for n in range(60):
        unit = "".join(r.choice("nidaotre-xy=ab ") for _ in range(r.randint(1, 9))) if n else "nindaon"
        text = ps.SPACE + (unit * (17_000 // len(unit))).replace(" ", ps.SPACE)
        want = exact(table[0], text)
        for size in (37, 5000):
            run, ids = ps.Viterbi(table[0], every=16 if size == 37 else 256), []
            for k in range(0, len(text), size):
                ids += run.push(text[k : k + size])
            assert ids + run.finish() == want


def test_the_library_finds_the_same_scores():
    """The library as a unigram model over the same pieces and scores."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    proto.ParseFromString(MODEL)
    proto.trainer_spec.model_type = 1
    p = ps.load(MODEL)[0]
    for piece in proto.pieces:
        if piece.piece in p.scores:
            piece.score = p.scores[piece.piece] / ps.UNIT
        elif piece.type == piece.NORMAL:
            piece.score = -1000  # no best path has it
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    score = lambda x: sum(p.scores[library.id_to_piece(k)] for k in x)
    for word in ("the", "understanding", "Vergangenheit", "élève", "x1y2", "internationalisation", "eauouon", "thinhe and the tionor"):
        own, theirs = ids((p, {}), word), library.encode(word)
        assert score(own) == score(theirs) or abs(score(own) - score(theirs)) < 8
        assert library.decode(own) == word


def test_tables(docs):
    rows = [(1, "Hello world"), (2, None), (3, ""), (3, ""), (None, "a  b\n"), (4, "word" * 60000), (5, "▁ x ▁▁")]
    table = docs(rows, {"ids": "mine", "round_trip": "mine"})
    got = ps.encoding_report(table).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert {r.doc_id: r.ids is None for r in got}[2] and {r.doc_id: r.n_ids for r in got}[3] == 0
    back = ps.decode(ps.encode(table.drop("ids"), MODEL).withColumnRenamed("text", "was"), MODEL).collect()
    assert sorted((repr(r.was) for r in back)) == sorted(repr(r.text) for r in back)
    assert ps.encoding_report(docs([])).count() == 0
