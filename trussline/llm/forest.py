"""Near-duplicate vectors by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.llm.common import drop_stored, stored
from trussline.llm.components import connected_components, local_components


@dataclass(frozen=True)
class ForestSettings:
    """The upper part of each tree is laid out on at most ``fit_rows`` vectors, chosen by hash; every vector is then filed
    in all trees. Leaves above ``split_rows`` get trees of their own, laid out by the tasks on ``sub_rows`` of their
    vectors, about, until none is left that can be split. There are ``trees`` trees, and one more for each doubling of
    the vectors beyond ``fit_rows``."""

    trees: int = 8
    leaf_rows: int = 512
    fit_rows: int = 65536
    split_rows: int = 4096
    sub_rows: int = 4096
    part_rows: int = 65536
    least_fit: int = 16
    spill: float = 0.02
    most_spill: float = 0.1
    tight: float = 0.95
    cosine: float = 0.9
    seed: int = 17


@dataclass(frozen=True)
class Tree:
    """Inner nodes in order of making: direction, range of the overlap, children (negative: leaf -1 - child)."""

    directions: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int


def _sparse_cut(spread: np.ndarray, spill: float) -> float:
    """The quantile to split at: near the middle, but not through a crowd.

    Each candidate costs its distance from the middle and the share of rows within twice ``spill`` of it, so evenly
    spread rows split at the median and a group of close copies stays on one side.
    """
    shares = np.concatenate([[0.02], np.arange(0.05, 0.96, 0.05), [0.98]])
    at = np.quantile(spread, shares)
    crowd = np.searchsorted(spread, at + 2 * spill) - np.searchsorted(spread, at - 2 * spill)
    return float(shares[np.argmin(crowd / len(spread) + np.abs(shares - 0.5))])


def grow(unit: np.ndarray, stop: int, settings: ForestSettings, seed: int) -> Tree:
    """Split along random directions, at the median or a sparser place, until ``stop`` rows are left.

    Rows within ``spill`` of the split go to both sides, but no more than ``most_spill`` of the rows on either side of
    it. A node of mutually similar rows (a long mean vector) is a leaf whatever its size: cutting it would lose links.
    """
    rng = np.random.default_rng(seed)
    directions, low, high, kids, leaves = [], [], [], [], 0
    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(unit)), -1, 0)]
    while todo:
        own, parent, side = todo.pop()
        spread = None
        if len(own) > stop and np.linalg.norm(unit[own].mean(axis=0)) < settings.tight:
            direction = rng.standard_normal(unit.shape[1])
            direction /= np.linalg.norm(direction)
            spread = unit[own] @ direction
            cut = _sparse_cut(np.sort(spread), settings.spill)
            q = np.quantile(spread, np.clip([cut - settings.most_spill, cut, cut + settings.most_spill], 0, 1))
            lo, hi = max(q[0], q[1] - settings.spill), min(q[2], q[1] + settings.spill)
            halves = [own[spread <= hi], own[spread >= lo]]
            if max(map(len, halves)) == len(own):
                spread = None
        if spread is None:
            leaves += 1
            name = -leaves
        else:
            name = len(directions)
            directions.append(direction)
            low.append(lo)
            high.append(hi)
            kids.append([0, 0])
            todo += [(halves[0], name, 0), (halves[1], name, 1)]
        if parent >= 0:
            kids[parent][side] = name
    left, right = np.array(kids, np.int64).reshape(-1, 2).T
    return Tree(np.array(directions).reshape(len(directions), unit.shape[1]), np.array(low), np.array(high), left, right, leaves)


def file_rows(tree: Tree, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf that a row is filed in; overlaps file a row more than once."""
    if not len(tree.directions):
        return np.arange(len(unit)), np.zeros(len(unit), np.int64)
    rows, leaves, todo = [], [], [(0, np.arange(len(unit)))]
    while todo:
        node, own = todo.pop()
        spread = unit[own] @ tree.directions[node]
        for child, part in ((tree.left[node], own[spread <= tree.high[node]]), (tree.right[node], own[spread >= tree.low[node]])):
            if not len(part):
                continue
            if child < 0:
                rows.append(part)
                leaves.append(np.full(len(part), -1 - child))
            else:
                todo.append((child, part))
    return np.concatenate(rows), np.concatenate(leaves)


def usable(vectors: DataFrame, settings: ForestSettings = ForestSettings()) -> DataFrame:
    """(vec_id, vec) with the vector as 64-bit floats in bytes; null for vectors that link with nothing.

    Null and empty vectors, zero ones and those with null or non-finite components link with nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64) + 0.0  # nulls become NaN
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            starts = np.append(0, ends[:-1])[: len(ends)]
            bad, some = (np.append(0, np.cumsum(x)) for x in (~np.isfinite(values), values != 0))
            good = (bad[ends] == bad[starts]) & (some[ends] > some[starts])
            data = values.tobytes()
            out = [data[8 * i : 8 * j] if ok else None for i, j, ok in zip(starts.tolist(), ends.tolist(), good.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])

    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return slim.mapInArrow(run, "vec_id long, vec binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of packed vectors, shorter ones with zeros behind, as unit vectors."""
    data = column.to_pylist()
    if any(len(x) < 8 * width for x in data):
        data = [x.ljust(8 * width, b"\0") for x in data]
    out = np.frombuffer(b"".join(data), np.float64).reshape(len(data), width)
    out = out / np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


def fit_forest(distinct: DataFrame, settings: ForestSettings) -> tuple[list[Tree], int]:
    """The trees and the vectors' width. ``distinct`` is a table (rep, vec); the sample is the smallest hashes of ids."""
    rows, width = distinct.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    if not rows:
        return [], 0
    share = min(1.0, 1.2 * settings.fit_rows / rows)
    sample = distinct if share == 1 else distinct.filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 24)) < int(share * (1 << 24)))
    vecs = sample.select("rep", "vec").toArrow().sort_by("rep").slice(0, settings.fit_rows)
    unit = _matrix(vecs.column("vec").combine_chunks(), width // 8)
    stop = max(settings.least_fit, settings.leaf_rows * len(unit) // rows)
    trees = settings.trees + max(0, math.ceil(math.log2(rows / settings.fit_rows)))
    return [grow(unit, stop, settings, settings.seed + t) for t in range(trees)], width // 8


def _filed(trees: list[Tree], width: int, batch: pa.RecordBatch) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    unit = _matrix(batch.column("vec"), width)
    starts = np.cumsum([0, *(t.leaves for t in trees)])
    return unit, [(rows, leaves + start) for tree, start in zip(trees, starts) for rows, leaves in [file_rows(tree, unit)]]


def file_vectors(distinct: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    """(rep, leaf, done) for every leaf of the upper trees that a vector is filed in; none is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, leaves = map(np.concatenate, zip(*_filed(trees, width, batch)[1]))
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(rows)), pa.array(leaves), pa.array(np.zeros(len(rows), bool))], ["rep", "leaf", "done"])

    return distinct.select("rep", "vec").mapInArrow(run, "rep long, leaf long, done boolean")


def split_leaves(filed: DataFrame, distinct: DataFrame, width: int, settings: ForestSettings) -> DataFrame:
    """(rep, leaf) with the leaves above ``split_rows`` split by trees of their own, round by round.

    The rows of a leaf come to tasks in parts, each behind a copy of the leaf's tree, so no task holds a leaf. Leaves of
    mutually similar vectors aren't split (see :func:`grow`).
    """

    def lay_out(group: pa.Table) -> pa.Table:
        leaf, rows = group.column("leaf")[0].as_py(), group.column("size")[0].as_py()
        unit = _matrix(group.sort_by("rep").column("vec").combine_chunks(), width)
        tree = grow(unit, max(settings.least_fit, settings.leaf_rows * len(unit) // rows), settings, settings.seed + leaf % (1 << 31))
        return pa.table([pa.array([leaf]), pa.array([rows]), pa.array([pickle.dumps(tree)], pa.binary())], ["leaf", "size", "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            own = batch.column("leaf").to_numpy()
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]) | batch.column("tree").is_valid().to_numpy(zero_copy_only=False)) if len(own) else []
            for at, end in zip(starts, np.append(starts[1:], len(own))):
                part = batch.slice(at, end - at)
                if part.column("tree")[0].is_valid:
                    tree = pickle.loads(part.column("tree")[0].as_py())
                    part = part.slice(1)
                if part.num_rows:
                    rows, leaves = file_rows(tree, _matrix(part.column("vec"), width))
                    # the leaf and its part make a name of 64 bits
                    names = (own[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + leaves.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                    names = np.full(len(rows), own[at]) if tree.leaves == 1 else names.view(np.int64)
                    yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(rows)), pa.array(names), pa.array(np.full(len(rows), tree.leaves == 1))], ["rep", "leaf", "done"])

    while True:
        large = stored(filed.filter("not done").groupBy("leaf").agg(F.count("*").alias("size")).filter(F.col("size") > settings.split_rows), "leaves-large")
        if large.isEmpty():
            return filed.select("rep", "leaf")
        members = filed.filter("not done").join(large, "leaf").join(distinct.select("rep", "vec"), "rep")
        parts = 1 << 24
        sample = members.filter(F.pmod(F.xxhash64("rep", "leaf"), F.lit(parts)) < F.lit(settings.sub_rows * parts) / F.col("size"))
        trees = stored(sample.groupBy("leaf").applyInArrow(lay_out, "leaf long, size long, tree binary"), "leaves-trees")
        last = F.floor(F.col("size") / settings.part_rows).cast("long")
        heads = trees.select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"), "tree")
        rows = members.join(trees.select("leaf"), "leaf", "left_semi").select("leaf", F.pmod(F.xxhash64("rep"), last + 1).alias("part"), "rep", "vec")
        both = heads.unionByName(rows, allowMissingColumns=True)
        dealt = both.repartition("leaf", "part").sortWithinPartitions("leaf", "part", F.col("tree").isNull())
        after = dealt.mapInArrow(run, "rep long, leaf long, done boolean")
        rest = filed.join(trees.select("leaf"), "leaf", "left_anti").select("rep", "leaf", "done")
        before, filed = filed, stored(rest.unionByName(after), "leaves")
        for table in (before, large, trees):
            drop_stored(table)


def _deal(distinct: DataFrame, filed: DataFrame, settings: ForestSettings) -> DataFrame:
    """Each vector to all its leaves; a leaf of several blocks is a triangle of block pairs, each a group of its own.

    ``home`` tells the block, ``seen`` lists all leaves of the vector, by which a pair is counted where it first meets.
    """
    sizes = filed.groupBy("leaf").agg(F.count("*").alias("size")).filter("size > 1")
    seen = filed.groupBy("rep").agg(F.sort_array(F.collect_list("leaf")).alias("seen"))
    vectors = distinct.select("rep", "n", "vec").join(seen, "rep")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / (2 * settings.leaf_rows))).cast("long")
    home = filed.join(sizes, "leaf").select("rep", "leaf", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).alias("home"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pairs = home.withColumn("other", other).select("rep", "leaf", "home", (F.least("home", "other") * (1 << 31) + F.greatest("home", "other")).alias("pair"))
    return pairs.join(vectors, "rep").select("leaf", "pair", "home", "rep", "n", "vec", "seen")


def _first_meeting(leaf: int, seen: pa.ListArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share no leaf before ``leaf``. The lists of leaves are sorted."""
    flat, ends = np.asarray(seen.flatten()), np.asarray(seen.offsets).astype(np.int64)
    ends -= ends[0]
    row = np.repeat(np.arange(len(seen)), np.diff(ends))
    column = np.arange(len(flat)) - ends[row]
    early = flat < leaf
    if not early.any():
        return np.ones(len(a), bool)
    # leaves by number, so that the table is narrow
    names, numbers = np.unique(flat[early], return_inverse=True)
    table = np.full((len(seen), column[early].max() + 1), -1, np.int32)
    table[row[early], column[early]] = numbers
    new = np.ones(len(a), bool)
    for k in range(0, len(a), 16384):
        one, two = table[a[k : k + 16384]], table[b[k : k + 16384]]
        for j in range(table.shape[1]):
            new[k : k + 16384] &= ~((one[:, j : j + 1] == two) & (two >= 0)).any(axis=1)
    return new


def compare_leaves(dealt: DataFrame, settings: ForestSettings, width: int) -> DataFrame:
    """(rep, links, root) of each group: links newly found, with copies counted, and one linked vector to hold on to."""
    names = ["rep", "links", "root"]

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        leaf, home = group.column("leaf")[0].as_py(), group.column("home").to_numpy()
        rep, n = group.column("rep").to_numpy(), group.column("n").to_numpy()
        unit = _matrix(group.column("vec").combine_chunks(), width)
        cross = len(np.unique(home)) > 1 or group.column("pair")[0].as_py() >> 31 != group.column("pair")[0].as_py() & (1 << 31) - 1
        a, b = [], []
        for k in range(0, len(unit), 512):
            near = unit[k : k + 512] @ unit.T >= settings.cosine
            x, y = np.nonzero(near)
            x += k
            good = (x < y) & ((home[x] != home[y]) if cross else True)
            a.append(x[good])
            b.append(y[good])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            new = _first_meeting(leaf, group.column("seen").combine_chunks(), a, b)
            a, b = a[new], b[new]
        links = np.bincount(a, n[b], len(rep)).astype(np.int64) + np.bincount(b, n[a], len(rep)).astype(np.int64)
        some = np.flatnonzero(links)
        root = local_components(len(rep), a, b)
        return pa.table([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[root[some]])], names)

    return dealt.groupBy("leaf", "pair").applyInArrow(work, "rep long, links long, root long")


def vector_groups(vectors: DataFrame, settings: ForestSettings = ForestSettings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links at cosine ``settings.cosine`` or more.

    Equal vectors become one before the trees and count as links of each other. In every tree a vector is filed in the
    leaves of both sides where it lies near a split; all pairs of a leaf are compared in double precision, so no link is
    below the bound, and a pair is counted in the first leaf that both share. Leaves above ``leaf_rows`` are compared in
    block pairs, so none is cut. Unusable vectors (see :func:`usable`) have no link and are kept. Vectors of different
    lengths compare as if the shorter had zeros behind. Repeated rows of an id count as vectors of their own; rows with
    a null id are counted but name no component; one whose ids are all null has a null ``component_id``, and rows with a
    null id are kept only there. Other columns are ignored.
    """
    rows = stored(usable(vectors, settings).withColumn("mark", F.sha2("vec", 256)), "vectors")
    distinct = stored(
        rows.filter("vec is not null").groupBy("mark").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("vec").alias("vec")).withColumn("rep", F.xxhash64("mark")),
        "vectors-distinct",
    )
    trees, width = fit_forest(distinct, settings)
    if not trees:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    filed = split_leaves(stored(file_vectors(distinct, trees, width), "leaves"), distinct, width, settings)
    found = stored(compare_leaves(_deal(distinct, filed, settings), settings, width), "vectors-links")
    drop_stored(filed)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(found, "rep", "root").withColumnRenamed("node", "rep")
    # groups are found over the vectors' names; a group is then called by the smallest id that it has
    named = distinct.select("mark", "rep", "first", "n").join(links, "rep", "left").join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    per_vec = named.join(least, "component").select("mark", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "mark").join(per_vec, "mark", "left")
    # a vector that links with nothing has its own id; one of a group whose ids are all null has null
    component = F.when(F.col("mark").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), component.isNull()).alias("kept"))
