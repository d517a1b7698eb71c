"""Relations of records: endpoints, dangling references, lineage, nested inserts, containment of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.storage import joined, stored


def entity_endpoints(endpoints: DataFrame, entities: DataFrame, on: str = "record_id") -> DataFrame:
    """Endpoints whose record is an entity."""
    return endpoints.join(entities.select(on).distinct(), on, "left_semi")


def dangling(references: DataFrame, targets: DataFrame, on: str | list[str]) -> DataFrame:
    """References to what isn't there."""
    return references.join(targets.select(*([on] if isinstance(on, str) else on)).distinct(), on, "left_anti")


def lineage(edges: DataFrame, roots: DataFrame, max_depth: int = 32) -> DataFrame:
    """(root, node, depth) for all descendants over edges (parent, child), roots included at depth 0.

    Breadth first: each round joins the newest nodes with the edges and keeps those not reached before, so cycles end and
    a node has its least depth. Rounds are bounded by ``max_depth``; going deeper is an error, not a cut.
    """
    front = stored(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct(), "lineage")
    reached, depth = front, 0
    while True:
        depth += 1
        step = front.join(edges, front["node"] == edges["parent"]).select("root", F.col("child").alias("node")).distinct()
        front = stored(step.join(reached.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "lineage")
        if front.isEmpty():
            return reached
        if depth > max_depth:
            raise ValueError(f"lineage is deeper than {max_depth}")
        reached = reached.unionByName(front)


def filed_boxes(boxes: DataFrame, cell: float, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Boxes (id, x0, y0, x1, y1) as outer ones and as inner ones, under the keys and cells (lx, ly, cx, cy) where they meet.

    Boxes have a level for each side: sizes double from an eighth of ``cell`` on, and a level's cells are a quarter of its
    size. A box is filed as an outer one in the grid of its levels, so under five cells a side at most. An inner box is
    filed under the cell of its lower corner, in the grids of no smaller levels that outer boxes have.
    """
    corners, least = ("x0", "y0", "x1", "y1"), cell / 8
    whole = boxes.filter(" and ".join(f"abs({c}) < double('infinity')" for c in corners))
    level = lambda low, high: F.least(F.lit(1100), F.ceil(F.log2(F.greatest(F.col(high) - F.col(low), F.lit(least)) / least))).cast("int")
    at = lambda c, level: F.floor(F.col(c) / (least / 4 * F.pow(F.lit(2.0), F.col(level)))).cast("long")
    levelled = whole.withColumns({"lx": level("x0", "x1"), "ly": level("y0", "y1")})
    holds = "x0 <= x1 and y0 <= y1"
    grids = [F.struct(F.lit(r.lx).alias("lx"), F.lit(r.ly).alias("ly")) for r in sorted(levelled.filter(holds).select("lx", "ly").distinct().collect())]
    grids = F.array(*grids or [F.struct(F.lit(0).alias("lx"), F.lit(0).alias("ly"))])
    dealt = levelled.repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    inner = dealt.withColumn("grid", F.explode(F.filter(grids, lambda g: (g["lx"] >= F.col("lx")) & (g["ly"] >= F.col("ly")))))
    inner = inner.select(*keys, F.col("id").alias("inner"), *[F.col(c).alias(f"i_{c}") for c in corners], "grid.lx", "grid.ly")
    inner = inner.withColumns({"cx": at("i_x0", "lx"), "cy": at("i_y0", "ly")})
    outer = dealt.filter(holds).select(*keys, F.col("id").alias("outer"), *corners, "lx", "ly")
    outer = outer.withColumn("cx", F.explode(F.sequence(at("x0", "lx"), at("x1", "lx")))).withColumn("cy", F.explode(F.sequence(at("y0", "ly"), at("y1", "ly"))))
    return outer, inner


def contained_boxes(boxes: DataFrame, cell: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, outer, inner) for boxes (id, x0, y0, x1, y1) inside others of the same keys, no box in itself.

    Boxes meet in the cells of :func:`filed_boxes`, where the inequalities are tested; pairs tested are a few times
    the pairs found, whatever the shape of the boxes. Boxes are dealt out before they are filed and by cell: few megabytes
    of them have many more of pairs. Boxes with a null or non-finite side are in none and hold none. ``cell`` should be about the size of a common box.
    """
    on = [*keys, "lx", "ly", "cx", "cy"]
    parts = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    outer, inner = (side.repartition(parts, *on) for side in filed_boxes(boxes, cell, keys))
    inside = "x0 <= i_x0 and y0 <= i_y0 and i_x1 <= x1 and i_y1 <= y1 and outer <> inner"
    return joined(outer, inner, on).filter(inside).select(*keys, "outer", "inner")
