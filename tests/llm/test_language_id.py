import zlib

import numpy as np
from pyspark.sql import functions as F

from trussline.llm import language_id as li


def test_spectrum_is_the_set_of_ngrams():
    def plain(text, n):
        text = " ab c "
        return {text[k : k + m] for m in range(1, n + 1) for k in range(len(text) - m + 1)}

    assert len(li.spectrum("Ab9--C!", 4)) == len(plain("", 4))
    for empty in (None, "", "12 !", "²"):
        assert len(li.spectrum(empty, 4)) == 0
    assert len(li.spectrum("𝒳", 2)) > 0 and len(li.spectrum("語", 2)) > 0


def test_kernel_equals_set_intersections():
    texts = ["the cat", "a cat sat", "der hund", "hund"]
    model = li.fit(texts, ["en", "en", "de", "de"])
    other = [li.spectrum(x, 4) for x in ("the dog", "ein hund", "cat cat cat")]
    got = li._kernel(model.grams, model.presence, other)
    marks = [set(li.spectrum(t, 4).tolist()) for t in ("der hund", "hund", "the cat", "a cat sat")]
    want = [[len(set(o.tolist()) & m) / np.sqrt(len(m) * len(o)) for m in marks] for o in other]
    assert np.allclose(got, want, atol=1e-6)
    share = li.scores(model, other)
    assert np.allclose(share.sum(axis=1), 1) and [model.languages[k] for k in share.argmax(axis=1)] == ["en", "de", "en"]


def test_held_out_accuracy(tables):
    docs = tables("documents")
    got = li.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_edges(docs):
    rows = [(k, f"the cat {k} sat on the mat and was happy", "en", "s") for k in range(12)] + [(k, f"der hund {k} lag auf der matte und schlief", "de", "s") for k in range(20, 32)]
    rows += [(50, None, "en", "s"), (51, "", "en", "s"), (52, "123 !!", "de", "s"), (None, "the cat", "en", None), (53, "the cat " * 20000, None, None), (1, "the cat 1 sat on the mat and was happy", "en", "s")]
    table = docs(rows, {"lang_pred": "mine", "score": "mine", "rank": "x"})
    got = {}
    for r in li.language_report(table).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.held_out))
    assert len(got[1]) == 2 and got[None] == [("en", False)] and got[53][0][0] == "en"
    assert {got[k][0][0] for k in (50, 51, 52)} == {"und"}
    kept = li.keep_identified(table)
    assert kept.columns == table.columns and kept.filter("score = 'mine' and lang_pred = 'mine'").count() == kept.count() == len(rows) - 3
    empty = docs([]).select("*")
    assert li.language_report(empty).count() == 0
    alone = docs([(1, "the cat", None, None)])
    assert [tuple(r) for r in li.language_report(alone).select("lang_pred", "score").collect()] == [("und", 0.0)]


def test_the_fit_is_bounded(docs):
    rows = [(k, f"word{k} again and again", "en", "s") for k in range(300)]
    texts, langs = li.fit_sample(docs(rows).withColumn("__train", F.lit(True)), F.col("__train"), li.KernelSettings(fit_rows=10))
    assert len(texts) == 10 and set(langs) == {"en"}


def test_predictions_equal_a_plain_ridge():
    """Kernel ridge regression in the landmarks' space with a dense target for each language."""
    r = np.random.default_rng(4)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop", "dd": "abijmnxy"}
    texts, langs = [], []
    for k in range(90):
        lang = sorted(letters)[k % 4 if k < 60 else 0]
        texts.append(" ".join("".join(r.choice(list(letters[lang]), r.integers(1, 6))) for _ in range(6)))
        langs.append(lang)
    s = li.KernelSettings(landmarks=5)
    model = li.fit(texts, langs, s)
    grams = [set(li.spectrum(t, 4).tolist()) for t in texts]
    names = sorted(letters)
    marks = [g for name in names for g in [g for g, lang in zip(grams, langs) if lang == name][:5]]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    between, features = (np.array([[kernel(a, b) for b in marks] for a in rows]) for rows in (marks, grams))
    values, vectors = np.linalg.eigh(between)
    whiten = vectors[:, values > 1e-6 * values[-1]] / np.sqrt(values[values > 1e-6 * values[-1]])
    x = features @ whiten
    y = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in langs])
    w = np.array([1 / (4 * langs.count(lang)) for lang in langs])
    x0, y0 = w @ x, w @ y
    beta = np.linalg.solve((x - x0).T @ (w[:, None] * (x - x0)) + s.ridge / len(texts) * np.eye(x.shape[1]), (x - x0).T @ (w[:, None] * (y - y0)))
    z = s.sharpness * ((x - x0) @ beta + y0)
    want = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(li.scores(model, [li.spectrum(t, 4) for t in texts]), want, atol=2e-3)


def test_many_languages_stay_in_bounds(docs):
    rows = [(k, f"{chr(97 + k % 40 % 26)}{k % 40 * 7919 % 1000}{chr(97 + k % 7)}zz" + f" {'abcdefghij'[k % 40 % 10] * 3}" * 3, f"l{k % 40}", "s") for k in range(400)] + [(1000, "x y " * 50000, "l99", "s")]
    s = li.KernelSettings(all_rows=80, all_bytes=4000, cells=2000)
    table = docs(rows)
    texts, langs = li.fit_sample(table.withColumn("t", F.lit(True)), F.col("t"), s)
    assert set(langs) == {r[2] for r in rows} and len(texts) <= 82
    model = li.fit(texts, langs, s)
    assert model.presence.size <= 2000 and len(model.languages) == 41


def test_nothing_to_learn_keeps_every_row(docs):
    rows = [(1, "the cat", None, None), (2, None, None, None), (None, "a", None, None)]
    assert li.keep_identified(docs(rows)).count() == 3
    one = [(k, f"the cat {k} sat on", "en", None) for k in range(20)] + [(50, "12", "en", None)]
    assert li.keep_identified(docs(one)).count() == 20
