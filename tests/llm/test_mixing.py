import random

from tests.oracle import as_set
from trussline.llm import mixing


def water(sizes):
    """Targets by sharing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        share = (left - sum(2 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in open_))
        over = [s for s in open_ if share * weight[s] > 2 * sizes[s]]
        if not over:
            return {s: 2 * sizes[s] if s in full else share * weight[s] for s in names}
        full |= set(over)


def duck(rows):
    import duckdb
    import pandas as pd

    c = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    c.execute("create table documents as select doc_id, text::varchar as text, source::varchar as source from documents")
    return c.execute(mixing.MIX_SQL).df()


def test_mix_equals_sql_and_comes_near_targets(docs):
    r = random.Random(1)
    rows = [(k, " ".join(["w"] * r.choice([0, 1, 5, 40])) if k % 50 else None, "en", r.choice(["a", "a", "a", "b", "c", "é", "~", None])) for k in range(900)]
    got = mixing.mix_report(docs(rows, {"size": "mine", "passes": "mine", "bucket": "mine"})).toPandas()
    assert as_set(got) == as_set(duck(rows))
    words = {k: len((t or "").split()) for k, t, _, _ in rows}
    source = {k: s for k, _, _, s in rows}
    sizes = {s: sum(words[k] for k in words if source[k] == s) for s in set(source.values())}
    want = water(sizes)
    taken = dict.fromkeys(sizes, 0)
    for x in got.itertuples():
        s = source[x.doc_id]
        assert x.size == words[x.doc_id] and x.source_size == sizes[s] and abs(x.target - want[s]) < 1e-6
        assert x.taken in (0, x.size, 2 * x.size)
        taken[s] += x.taken
    assert all(abs(taken[s] - want[s]) <= 80 for s in sizes) and sum(taken.values()) <= 1.5 * sum(sizes.values())


def test_reruns_and_orders_agree(docs):
    r = random.Random(2)
    rows = [(k, "w " * r.randrange(1, 30), "en", r.choice("abcd")) for k in range(300)]
    one = as_set(mixing.mix_report(docs(rows)).toPandas())
    r.shuffle(rows)
    assert as_set(mixing.mix_report(docs(rows).repartition(7)).toPandas()) == one


def test_documents_come_as_often_as_the_report_says(docs):
    rows = [(k, f"w{k} " * (k % 7), "en", "ab"[k % 2]) for k in range(200)] + [(3, "w3 w3 w3 ", "en", "b"), (None, "x y", None, None)]
    table = docs(rows, {"passes": "mine", "words": "mine"})
    out = mixing.mix_documents(table)
    assert out.columns == table.columns
    times = {}
    for x in out.collect():
        times[x.doc_id] = times.get(x.doc_id, 0) + len(x.text.split())
    want = {}
    for x in mixing.mix_report(table).collect():
        want[x.doc_id] = want.get(x.doc_id, 0) + x.taken
    assert {k: v for k, v in want.items() if v} == times


def test_edges(docs):
    assert mixing.mix_report(docs([])).count() == 0 and mixing.mix_documents(docs([])).count() == 0
    nothing = mixing.mix_report(docs([(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a")])).collect()
    assert sorted(map(tuple, nothing)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    one = mixing.mix_report(docs([(1, "a b", "en", "s")])).first()
    assert (one["size"], one.target) == (2, 3.0) and one.taken in (0, 2)


def test_no_python_in_the_plan(docs):
    plan = mixing.mix_report(docs([(1, "a b", "en", "s")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_columns_of_any_name_come_through(docs):
    rows = [(k, f"a b {k}", None, f"s{k % 3}") for k in range(30)]
    table = docs(rows, {"__src": "mine", "__key": "own", "__size": "kept", "__passes": "x", "__row": "y"})
    out = mixing.mix_documents(table)
    assert out.columns == table.columns and out.count() > 0
    assert {tuple(r)[5:] for r in out.collect()} == {("mine", "own", "kept", "x", "y")}


def test_copies_of_a_large_row_come_near_the_target(docs):
    copy = "w " * 1000
    rows = [(7, copy, "en", "a")] * 40 + [(100 + k, "x " * 10, "en", "a") for k in range(100)] + [(900 + k, "y " * 50, "en", "b") for k in range(300)]
    got = mixing.mix_report(docs(rows)).toPandas()
    assert as_set(got) == as_set(duck(rows))
    big = got[got["source_size"] == 41_000]
    assert abs(big["taken"].sum() - big["target"].iloc[0]) <= 1000
    taken = sorted(got[got["doc_id"] == 7]["taken"])
    assert len(set(taken)) > 1
    out = mixing.mix_documents(docs(rows))
    assert out.filter("doc_id = 7").count() * 1000 == sum(taken) and out.count() == (got["taken"] / got["size"]).sum()


def test_rows_of_one_id_and_size_are_told_apart_the_same_way_each_time(docs):
    rows = [(None, f"w{k} " * 100, "en", "b") for k in range(60)] + [(k, "y " * 50, "en", "a") for k in range(200)]
    one = sorted(r.text for r in mixing.mix_documents(docs(rows)).filter("doc_id is null").collect())
    two = sorted(r.text for r in mixing.mix_documents(docs(rows[::-1]).repartition(5)).filter("doc_id is null").collect())
    assert one == two and 0 < len(one) < 120 and max(map(one.count, one)) <= 2


def test_groups_above_a_chunk(docs, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 8)
    rows = [(1, "a b c", "en", "s")] * 100 + [(k, "d e", "en", "t") for k in range(50)] + [(2, None, "en", "s")] * 30
    assert as_set(mixing.mix_report(docs(rows)).toPandas()) == as_set(duck(rows))
