"""Evidence of recognisers: layout of words, conflicts with native text, rules over rasters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType


def words_from_tsv(pages: DataFrame, minimum: float = 0.0) -> DataFrame:
    """Word rows of recogniser output (page_id, tsv): level-5 lines with text and enough confidence, in reading order."""
    rows = pages.select("page_id", F.posexplode(F.split("tsv", "\r?\n")).alias("place", "row")).withColumn("f", F.split("row", "\t", 12))
    num = lambda k, kind="int": F.try_element_at("f", F.lit(k)).try_cast(kind)
    words = rows.filter((F.size("f") == 12) & (F.element_at("f", 1) == "5")).select(
        "page_id", "place", num(3).alias("block"), num(4).alias("paragraph"), num(5).alias("line"), num(6).alias("word"), num(7).alias("left"), num(8).alias("top"), num(9).alias("width"), num(10).alias("height"), num(11, "double").alias("confidence"), F.element_at("f", 12).alias("text")
    )
    kept = words.filter((F.col("text") != "") & (F.col("confidence") >= minimum))
    return kept.withColumn("reading_order", F.row_number().over(Window.partitionBy("page_id").orderBy("place")) - 1)


def union_boxes(words: DataFrame, keys: list[str]) -> DataFrame:
    """Box that covers the words of each key, their number and mean confidence."""
    right, bottom = F.max(F.col("left") + F.col("width")), F.max(F.col("top") + F.col("height"))
    return words.groupBy(*keys).agg(
        F.min("left").alias("left"), F.min("top").alias("top"), (right - F.min("left")).alias("width"), (bottom - F.min("top")).alias("height"), F.count("*").alias("n_words"), F.avg("confidence").alias("confidence")
    )


def reading_order_state(words: DataFrame) -> DataFrame:
    """(page_id, state): known where blocks, paragraphs, lines and words come in order without repeats, else unknown."""
    now = F.struct("block", "paragraph", "line", "word")
    before = F.lag(now).over(Window.partitionBy("page_id").orderBy("reading_order"))
    return words.withColumn("bad", before.isNotNull() & (before >= now)).groupBy("page_id").agg(F.when(F.max("bad"), "unknown").otherwise("known").alias("state"))


def table_topology(words: DataFrame, spread: float = 12) -> DataFrame:
    """(page_id, state, columns): a table where two or more lines have the same 2 to 8 words with centres in columns."""
    line = ["page_id", "block", "paragraph", "line"]
    column = F.row_number().over(Window.partitionBy(*line).orderBy("reading_order"))
    placed = words.withColumns({"column": column, "centre": F.col("left") + F.col("width") / 2})
    lines = placed.groupBy(*line).agg(F.count("*").alias("n")).groupBy("page_id").agg(F.count("*").alias("lines"), F.min("n").alias("least"), F.max("n").alias("most"))
    wide = placed.groupBy("page_id", "column").agg((F.max("centre") - F.min("centre")).alias("wide")).groupBy("page_id").agg(F.max("wide").alias("wide"))
    known = (F.col("lines") >= 2) & (F.col("least") == F.col("most")) & F.col("least").between(2, 8) & (F.col("wide") <= spread)
    return lines.join(wide, "page_id").select("page_id", F.when(known, "known").otherwise("unknown").alias("state"), F.when(known, F.col("least")).alias("columns"))


def text_conflicts(native: DataFrame, recognised: DataFrame, key: str, normalise) -> DataFrame:
    """(key, state, native_text, recognised_text): conflicted where both are there and differ, with both kept."""
    joined = native.select(key, F.col("text").alias("native_text")).join(recognised.select(key, F.col("text").alias("recognised_text")), key, "full_outer")
    both = F.col("native_text").isNotNull() & F.col("recognised_text").isNotNull()
    differ = normalise(F.col("native_text")) != normalise(F.col("recognised_text"))
    return joined.withColumn("state", F.when(both & differ, "conflicted").otherwise("known"))


def _regions(pixels: np.ndarray) -> list[dict]:
    """Shapes of the dark 4-connected regions of a raster, by row of their first pixel."""
    dark = pixels <= 32
    label = np.where(dark, np.arange(1, dark.size + 1).reshape(dark.shape), 0)
    while dark.any():  # least label of the neighbours, until nothing changes
        new = label.copy()
        for a, b in ((np.s_[1:], np.s_[:-1]), (np.s_[:-1], np.s_[1:])):
            for low, high in (((a, np.s_[:]), (b, np.s_[:])), ((np.s_[:], a), (np.s_[:], b))):
                both = dark[low] & dark[high]
                new[low] = np.where(both, np.minimum(new[low], new[high]), new[low])
        flat = np.append(0, new.ravel())
        jumped = flat[new]
        new = np.where(dark, np.minimum(new, np.where(jumped > 0, jumped, new)), 0)
        if np.array_equal(new, label):
            break
        label = new
    found = []
    for name in np.unique(label[dark]):
        ys, xs = np.nonzero(label == name)
        if len(xs) < 5:
            continue
        left, top, w, h = int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1
        part = label[top : top + h, left : left + w] == name
        rows, cols = np.flatnonzero(part.all(axis=1)).tolist(), np.flatnonzero(part.all(axis=0)).tolist()
        spaced = lambda v: 3 <= len(v) <= 8 and all(b - a >= 4 for a, b in zip(v, v[1:]))
        if w >= 12 and h >= 12 and rows == [0, h - 1] and cols == [0, w - 1] and len(xs) == 2 * (w + h) - 4:
            kind = "region.rectangle"
        elif spaced(rows) and spaced(cols):
            kind = "table.grid"
        elif w == h >= 5 and w % 2 and rows == [h // 2] and cols == [w // 2] and len(xs) == w + h - 1:
            kind = "symbol.cross"
        elif w >= 7 and h in (3, 5) and rows == [h // 2] and cols == [0, w - 1] and len(xs) == w + 2 * h - 2:
            kind = "dimension.linear"
        else:
            continue
        found.append({"kind": kind, "left": left, "top": top, "width": w, "height": h, "pixels": len(xs)})
    return found


_SHAPE = StructType([StructField("kind", StringType()), *[StructField(c, LongType()) for c in ("left", "top", "width", "height", "pixels")]])


def raster_candidates(rasters: DataFrame) -> DataFrame:
    """(raster_id, place, kind, left, top, width, height, pixels) of the shapes in rasters (raster_id, width, height, pixels).

    Pixels are one byte each, row by row. A raster without them, above 4096 on a side, or with another number of pixels
    than its sides say gives one row of kind ``error.raster_invalid`` or ``error.raster_too_large`` and no place.
    """

    @F.udf(ArrayType(_SHAPE), useArrow=True)
    def shapes(pixels: bytes, width: int, height: int):
        if pixels is None or not width or not height or len(pixels) != width * height:
            return [{"kind": "error.raster_invalid"}]
        if max(width, height) > 4096:
            return [{"kind": "error.raster_too_large"}]
        return _regions(np.frombuffer(pixels, np.uint8).reshape(height, width))

    return rasters.select("raster_id", F.posexplode(shapes("pixels", "width", "height")).alias("place", "s")).select("raster_id", F.when(~F.startswith("s.kind", F.lit("error.")), F.col("place")).alias("place"), "s.*")
