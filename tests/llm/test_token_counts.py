import random

import pytest
from pyspark.sql import functions as F

from trussline.llm import token_counts as tc


@pytest.fixture(scope="module")
def count():
    return tc.counter(tc.read_ranks())


def full(count, text):
    return sum(len(count.encode(p.encode())) for p in count.pattern.findall(text))


def edited(text, start, stop, put):
    start = min(max(start, 0), len(text))
    stop = min(max(stop, start), len(text))
    return text[:start] + put + text[stop:]


def test_edits_equal_full_encoding(count):
    r = random.Random(3)
    letters = ["a", "b", "'", "s", "t", " ", "  ", "\n", "1", "23", ".", "!", "é", "the ", "\t", "'re", " x", "'ll"]
    for n in range(1500):
        text = "".join(r.choice(letters) for _ in range(r.choice([0, 1, 3, 10, 60, 400])))
        tree = tc.TokenTree(text, count)
        for _ in range(r.randrange(1, 6)):
            start = r.randrange(-1, len(text) + 3)
            edit = (start, start + r.choice([0, 0, 1, 2, 5, 50]), "".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 8, 300 if n % 20 == 0 else 3]))))
            tree.edit(*edit)
            text = edited(text, *edit)
            assert tree.text == text and tree.tokens == full(count, text)
            assert tree.sums[0][1] == len(text)


def test_only_the_touched_region_is_encoded(count):
    text = "some words of a long text, " * 2000
    tree = tc.TokenTree(text, count)
    before = tree.encoded
    tree.edit(30000, 30010, "other")
    assert tree.encoded - before < 12


def test_report_and_stream(spark, docs, count):
    rows = [(1, "It's one  two\nthree." * 9), (2, None), (3, ""), (3, "again"), (None, "lost words"), (4, "x" * 200000)]
    table = docs(rows, {"seq": "a", "put": "b"})
    got = tc.token_report(table).collect()
    assert len(got) == len(rows)
    want = []
    for k, text in rows:
        text = text or ""
        n = len(text)
        now = text
        for e in ((n // 3, n // 3 + 9, "revised words"), (n // 2, n // 2, " (see the note of 2024)"), (n * 5 // 6, n * 5 // 6 + 24, "")):
            now = edited(now, *e)
        want.append((k, full(count, text), full(count, now)))
    assert sorted(((r.doc_id, r.n_tokens, r.n_tokens_edited) for r in got), key=repr) == sorted(want, key=repr)
    edits = spark.createDataFrame([(1, 2, 0, 4, "Them"), (1, 1, 5, 5, "new "), (9, 1, 0, 0, "x"), (3, 1, 0, 1, None), (1, 3, None, 2, "z")], "doc_id long, seq int, start int, stop int, put string")
    stream = tc.count_edit_stream(table, edits, tc.read_ranks()).collect()
    first = edited(edited(rows[0][1], 5, 5, "new "), 0, 4, "Them")
    assert sorted(map(tuple, stream)) == sorted([(1, full(count, first)), (3, 0), (3, full(count, "gain"))])
    assert tc.token_report(docs([])).count() == 0
    odd = tc.count_after_edits(table.filter("doc_id = 1"), F.expr("array(null, struct(cast(null as int) as start, 1 as stop, 'x' as put), struct(0 as start, 1 as stop, cast(null as string) as put))"), tc.read_ranks())
    assert odd.first().n_tokens_edited == full(count, rows[0][1][1:])


def test_counts_equal_the_tokenizer(tables, count):
    import tiktoken  # noqa: F401

    for r in tables("documents").limit(40).collect():
        assert tc.TokenTree(r.text, count).tokens == full(count, r.text)
