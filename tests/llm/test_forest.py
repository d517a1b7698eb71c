import numpy as np
import pytest

from trussline.llm import forest

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, bound=0.9):
    good = {k: v for k, (_, v) in enumerate(rows) if v is not None and len(v) and None not in v and np.isfinite(np.array(v, np.float64)).all() and any(v)}
    width = max(map(len, good.values()), default=0)
    unit = {k: np.pad(np.array(v, np.float32).astype(np.float64), (0, width - len(v))) for k, v in good.items()}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    label, links = {k: k for k in range(len(rows))}, {k: 0 for k in range(len(rows))}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in unit:
        for b in unit:
            if a < b and unit[a] @ unit[b] >= bound:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                label[y] = x
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(rows[k][0])
    return [(rows[k][0], links[k], min(groups[root(k)])) for k in range(len(rows))]


def recall(found, vectors, bound=0.9):
    """Links found, of all pairs of a table at the bound, told by the counts of both sides."""
    ids = [r.vec_id for r in vectors]
    width = max(len(r.embedding) for r in vectors if r.embedding)
    unit = np.array([np.pad(np.array(r.embedding, np.float64), (0, width - len(r.embedding))) if r.embedding and None not in r.embedding else np.zeros(width) for r in vectors])
    unit[~np.isfinite(unit).all(axis=1)] = 0
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    there = {}
    for k in range(0, len(unit), 512):
        for i, n in zip(ids[k : k + 512], (unit[k : k + 512] @ unit.T >= bound).sum(axis=1) - (np.abs(unit[k : k + 512]).sum(axis=1) > 0)):
            there[i] = there.get(i, 0) + int(n)
    got = {}
    for r in found:
        got[r.vec_id] = got.get(r.vec_id, 0) + r.n_links
    assert all(got[i] <= n for i, n in there.items())
    return sum(got.values()) / sum(there.values()) if any(there.values()) else 1.0


def table(spark, rows):
    return spark.createDataFrame([(k, v, 1) for k, v in rows], KIND)


def test_all_pairs_of_copies_and_neighbours(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 16))
    rows = [(k, base[k % 60].tolist() if k % 3 == 0 else (base[k % 60] + r.normal(size=16) * 0.12).tolist()) for k in range(400)]
    got = forest.vector_groups(table(spark, rows), forest.ForestSettings(leaf_rows=40, least_fit=8)).collect()
    want = {x[0]: x for x in brute(rows)}
    found, there = sum(g.n_links for g in got), sum(w[1] for w in want.values())
    assert len(got) == 400 and 0.97 * there <= found <= there
    assert all(g.n_links <= want[g.vec_id][1] for g in got)
    assert sum(g.component_id == want[g.vec_id][2] for g in got) >= 396 and all(g.kept == (g.vec_id == g.component_id) for g in got)


def test_large_leaves_are_compared_in_blocks(spark):
    r = np.random.default_rng(4)
    one = r.normal(size=24)
    rows = [(k, (one + r.normal(size=24) * 0.02).tolist()) for k in range(300)] + [(k, r.normal(size=24).tolist()) for k in range(300, 400)]
    got = forest.vector_groups(table(spark, rows), forest.ForestSettings(leaf_rows=16, trees=3)).collect()
    assert sorted((g.vec_id, g.n_links, g.component_id) for g in got) == sorted(brute(rows))


def test_edges(spark):
    rows = [(5, None), (6, []), (7, [0.0, 0.0]), (8, [1.0, None]), (9, [1.0, float("nan")]), (10, [float("inf"), 1.0]), (3, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (4, [1.0]), (11, [-1.0, 0.0]), (12, [1e-38, 0.0]), (13, [3e38, 3e37])]
    got = forest.vector_groups(table(spark, rows)).collect()
    assert sorted((g.vec_id, g.n_links, g.component_id) for g in got) == sorted(brute(rows))
    assert forest.vector_groups(table(spark, [])).count() == 0
    assert [tuple(g) for g in forest.vector_groups(table(spark, rows[:1])).collect()] == [(5, 0, 5, True)]
    # null ids linked to real ids with other vectors
    for seed in range(3):
        r = np.random.default_rng(seed)
        base = r.normal(size=(6, 8))
        rows = [(None if k >= 6 else 10 + k, (base[k % 6] + r.normal(size=8) * 0.02).tolist()) for k in range(18)] + [(None, (-base[0]).tolist())]
        got = forest.vector_groups(table(spark, rows)).collect()
        real = sorted((g.vec_id, g.n_links, g.component_id, g.kept) for g in got if g.vec_id is not None)
        assert real == [(10 + k, 2, 10 + k, True) for k in range(6)]
        rest = [(g.component_id, g.kept) for g in got if g.vec_id is None]
        assert sorted(x for x, _ in rest if x is not None) == sorted([10 + k for k in range(6)] * 2) and (None, True) in rest and not any(kept for x, kept in rest if x is not None)
    lost = forest.vector_groups(table(spark, [(None, [1.0, 0.0]), (7, [1.0, 0.0])])).collect()
    assert sorted((g.n_links, g.component_id) for g in lost) == [(1, 7), (1, 7)]


def test_tree_keeps_all_rows():
    r = np.random.default_rng(5)
    unit = r.normal(size=(500, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    tree = forest.grow(unit, 30, forest.ForestSettings(), 1)
    rows, leaves = forest.file_rows(tree, unit)
    assert set(rows) == set(range(500)) and leaves.max() == tree.leaves - 1 and np.bincount(leaves).max() <= 30


@pytest.mark.parametrize("pairs", [[(1, 2), (2, 3), (5, 4)], [(k, k + 1) for k in range(70)], [(0, k) for k in range(1, 50)] + [(99, 98)], [(1, 1), (None, 2)], []])
def test_components(spark, pairs):
    from trussline.llm.components import connected_components

    label = {x: x for p in pairs for x in p if None not in p and p[0] != p[1]}
    for _ in label:
        for a, b in pairs:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    edges = spark.createDataFrame(pairs, "a long, b long")
    assert dict(map(tuple, connected_components(edges).collect())) == label


def test_recall_on_the_whole_table(spark):
    """The table as it is (it may hold no link at all), then with near copies of its vectors and one loose group."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label")
    assert recall(forest.vector_groups(vectors).collect(), vectors.collect()) >= 0.97
    own = [r for r in vectors.collect() if r.embedding]
    r, width = np.random.default_rng(1), len(own[0].embedding)
    unit = lambda x: x / np.linalg.norm(x)
    near = [unit(unit(np.array(x.embedding)) + r.normal(size=width) * 0.4 / np.sqrt(width)) for x in own[:1500] for _ in range(2)]
    middle = unit(r.normal(size=width))
    loose = [unit(middle + r.normal(size=width) * 0.37 / np.sqrt(width)) for _ in range(4000)]
    more = spark.createDataFrame([(10**6 + k, x.tolist(), 0) for k, x in enumerate(near + loose)], "vec_id long, embedding array<double>, label int")
    both = vectors.withColumn("embedding", forest.F.col("embedding").cast("array<double>")).unionByName(more)
    assert recall(forest.vector_groups(both).collect(), both.collect()) >= 0.95


def test_leaves_are_split_by_the_tasks(spark):
    """With a small fit the leaves of the upper trees hold many rows; trees of their own bound them and keep the links."""
    r = np.random.default_rng(8)
    base = r.normal(size=(700, 24))
    rows = [(k, (base[k % 700] + r.normal(size=24) * 0.15).tolist()) for k in range(4200)]
    s = forest.ForestSettings(leaf_rows=40, fit_rows=100, split_rows=160, sub_rows=400, least_fit=16, part_rows=300)
    table_ = table(spark, rows)
    vectors = forest.usable(table_).selectExpr("vec_id as rep", "1L as n", "vec")
    trees, width = forest.fit_forest(vectors, s)
    filed = forest.split_leaves(forest.stored(forest.file_vectors(vectors, trees, width), "leaves"), vectors, width, s)
    sizes = [x["count"] for x in filed.groupBy("leaf").count().collect()]
    assert max(sizes) <= s.split_rows and filed.select("rep").distinct().count() == 4200
    assert len(trees) == 8 + 6
    got = forest.vector_groups(table_, s).collect()
    assert recall(got, table_.collect()) >= 0.95
