import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trussline.llm import tokenizer_alignment as ta

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    """The report by both libraries on whole texts and a merge of byte ranges."""
    a_model, b_model = Tokenizer.from_file(ta.BYTE_BPE_PATH), sentencepiece.SentencePieceProcessor(model_file=ta.PIECE_PATH)
    a_model.encode_special_tokens = True
    work = ta.aligner(ta.BYTE_BPE_PATH, ta.PIECE_PATH)

    def one(text):
        if not text:
            return None
        a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
        whole = (" " + text).encode()
        sides = []
        for ids, table in ((a, work.a_bytes), (b, work.b.bytes)):
            if b"".join(table[i] for i in ids) != whole:
                return None
            ends = np.cumsum([len(table[i]) for i in ids]).tolist()
            sides.append(list(zip([0, *ends], ends, ids)))
        groups, links, i, j = [[[], []]], [], 0, 0
        while i < len(sides[0]):
            (s, e, x), (t, f, y) = sides[0][i], sides[1][j]
            links.append((x, y))
            if e <= f:
                groups[-1][0].append(x)
                i += 1
            if f <= e:
                groups[-1][1].append(y)
                j += 1
            if e == f:
                groups.append([[], []])
        return len(a), len(b), len(groups) - 1, links, ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups[:-1])

    def report(rows):
        found = [(k, one(t)) for k, t in rows]
        counts = Counter(pair for _, f in found if f for pair in set(f[3]))
        most = Counter()
        for (a, _), n in counts.items():
            most[a] = max(most[a], n)
        return sorted(((k, 0, 0, 0, 0, 0, 0, "") if f is None else (k, f[0], f[1], f[2], len(f[3]), sum(counts[p] == most[p[0]] for p in f[3]), sum(counts[p] for p in f[3]), hashlib.sha256(f[4].encode()).hexdigest()) for k, f in found), key=repr)

    return report


def got(frame):
    return sorted((tuple(r) for r in frame.select(COLUMNS).collect()), key=repr)


def test_whole_table(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(ta.alignment_report(docs)) == plain([(d.doc_id, d.text) for d in docs.collect()])


HARD = [None, "", " ", "  a  b ", "a b", "<|endoftext|> <s> </s> <unk>", "▁a b", "日本語 です", "👩‍👩‍👧 é é", "\n\na\n b", "x y", "a" * 20_000, "tab\t\ttab", "\u0000 nul", "1234567890 " * 50, "ñandú ½²", "=" * 999]


def test_hard_texts_blocks_and_repeats(spark, plain):
    rows = [(k, t) for k, t in enumerate(HARD)] + [(3, HARD[3]), (None, "none")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, pair long, block string")
    want = plain(rows)
    for n in (1, 7):  # each partition has a block of its own
        assert got(ta.alignment_report(docs.repartition(n))) == want


def test_empty_table_and_groups(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string")
    assert ta.alignment_report(docs.limit(0)).count() == 0
    texts = {r.doc_id: r.groups for r in ta.aligned_groups(docs).collect()}
    report = {r.doc_id: r for r in ta.alignment_report(docs).collect()}
    assert hashlib.sha256(texts[1].encode()).hexdigest() == report[1].groups_sha256 and texts[2] == ""


def test_rank_and_select():
    rng = np.random.default_rng(3)
    ends = np.unique(rng.integers(1, 1000, 200))
    ranks = ta.Ranks(ta.set_bits(ends, 1000))
    assert ranks.places().tolist() == (ends - 1).tolist()
    assert ranks.rank(np.arange(1001)).tolist() == [int((ends <= p).sum()) for p in range(1001)]


def test_pair_counts(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the dog"), (3, "the the")], "doc_id long, text string")
    counts = {(r.a_id, r.b_id): (r["count"], r.best) for r in ta.pair_counts(ta.aligned_blocks(docs)).collect()}
    assert max(counts.values()) == (3, True) and sum(n for n, _ in counts.values()) == 5
