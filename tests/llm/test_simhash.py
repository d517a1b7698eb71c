import random
import re

import numpy as np
import xxhash

from trussline.llm import simhash


def plain(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, ids):
    label = list(range(len(ids)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(least.get(root(k), i), i)
    return [least[root(k)] for k in range(len(ids))]


def test_fingerprints():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice(["Word ", "é\t", "ÀB ", "x", "\x0b", " \n", " "]) for _ in range(r.randrange(40)))
        assert simhash.fingerprint(text.encode()) == plain(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


def test_near_edges_both_ways():
    r = np.random.default_rng(2)
    free = ~simhash.key_masks()[3] & (1 << 64) - 1
    bits = [k for k in range(64) if free >> k & 1]
    own = np.unique(np.array([sum(1 << bits[b] for b in r.choice(len(bits), r.integers(0, 4), replace=False)) | 1 << 63 for _ in range(600)], np.uint64))
    assert len(own) > simhash.DIRECT
    want = {(a, b) for a in range(len(own)) for b in range(a + 1, len(own)) if int(own[a] ^ own[b]).bit_count() <= 2}
    a, b = simhash.near_edges(own, np.array([0]), free)
    assert set(zip(a.tolist(), b.tolist())) == want
    cut = np.arange(0, len(own), 100)
    a, b = simhash.near_edges(own, cut, free)
    assert set(zip(a.tolist(), b.tolist())) == {(x, y) for x, y in want if x // 100 == y // 100}


def test_links_of_flipped_fingerprints(spark):
    r = random.Random(3)
    prints = []
    for _ in range(60):
        x = r.getrandbits(64)
        prints += [x] + [x ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 3, 4]))) for _ in range(4)]
    base = r.getrandbits(64)
    prints += [base ^ sum(1 << b for b in r.sample(range(11, 20), r.randrange(5))) for _ in range(400)]  # one large bucket
    prints = sorted(set(prints))
    fps = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    label = {x: x for x in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for e in simhash.link_blocks(fps).collect():
        a, b = e.a % (1 << 64), e.b % (1 << 64)
        x, y = sorted((root(a), root(b)))
        label[y] = x
    got = {}
    for x in prints:
        got.setdefault(root(x), []).append(x)
    want = {}
    for k, g in enumerate(groups(prints, list(range(len(prints))))):
        want.setdefault(g, []).append(prints[k])
    assert sorted(map(tuple, got.values())) == sorted(map(tuple, want.values()))


def test_groups_of_documents(docs, tables):
    rows = [(r.doc_id, r.text) for r in tables("documents").collect()]
    rows += [(5000, None), (5001, " "), (4999, ""), (5002, "one two"), (5003, "one two"), (5003, "one two"), (5004, "w " * 50000)]
    got = simhash.simhash_groups(docs(rows, {"fp": "mine", "component": "mine"})).collect()
    prints = [plain(t) for _, t in rows]
    want = sorted((i, f"{p:016x}", g) for (i, _), p, g in zip(rows, prints, groups(prints, [i for i, _ in rows])))
    assert sorted(map(tuple, got)) == want


def test_deduplicate_and_edges(docs):
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "x y z"), (None, "a b c d"), (4, None)]
    table = docs(rows, {"first": "mine", "kept": "mine"})
    kept = simhash.deduplicate(table)
    assert kept.columns == table.columns and sorted((repr(r.doc_id) for r in kept.collect())) == ["1", "2", "4", "None"]
    assert simhash.simhash_groups(docs([])).count() == 0 and simhash.deduplicate(docs([])).count() == 0
    lost = simhash.simhash_groups(docs([(None, "q r s"), (7, "q r s"), (None, "alone here now")])).collect()
    assert sorted((repr(r.doc_id), r.component_id) for r in lost if r.component_id) == [("7", 7), ("None", 7)] and len(lost) == 3


def test_rows_of_one_id_are_judged_by_their_own_texts(docs):
    """No text is lost but copies, in whichever order the rows come."""
    rows = [(1, "a b c d e"), (1, "x y z u v"), (2, "x y z u v"), (3, "p q r s t"), (3, "p q r s t"), (None, "a b c d e")]
    for order in (rows, rows[::-1]):
        out = simhash.deduplicate(docs(order)).collect()
        assert sorted((repr(r.doc_id), r.text) for r in out) == [("1", "a b c d e"), ("1", "x y z u v"), ("3", "p q r s t"), ("None", "a b c d e")]
