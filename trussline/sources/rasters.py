"""Pixels of PNG and PNM rasters, in strips of rows, and the dark regions of rasters of any size.

A file is unpacked in order by one task, row by row, and leaves it as strips of packed bits. Strips are then worked on apart: their runs
are joined to regions, and only the runs at their borders meet again to join regions over the borders.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels of a raster, at most; rows of a strip; and the darkest shade that is no longer dark.
PIXELS, STRIP_ROWS, LIGHT = 100_000_000, 256, 33
#: Bytes of strips that are handed over at once, about.
BATCH_BYTES = 4 << 20
#: Pixels that are worked on at once, unless one row or strip has more.
AT_ONCE = 1 << 20
# The parts of red, green and blue in a shade of grey, of 65536.
GREY = (19595, 38470, 7471)
PNG = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by the colour type of a PNG file.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_HEAD = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*")
_WORD = re.compile(rb"[0-9]+")


class Unreadable(ValueError):
    """Why a raster has no pixels."""


def _check_size(width: int, height: int) -> None:
    if width < 1 or height < 1:
        raise Unreadable("IMAGE_EMPTY")
    if width * height > PIXELS:
        raise Unreadable("IMAGE_TOO_LARGE")


def undo_filter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """The bytes of a PNG row; ``step`` is the number of bytes of a pixel, ``above`` the row before, unfiltered."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        pixels = np.zeros(-(-len(row) // step) * step, np.uint8)
        pixels[: len(row)] = row
        return np.cumsum(pixels.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()[: len(row)]
    if kind not in (3, 4):
        raise Unreadable("IMAGE_FILTER_UNKNOWN")
    out, up = [0] * step + row.tolist(), [0] * step + above.tolist()
    if kind == 3:
        for k in range(step, len(out)):
            out[k] = (out[k] + ((out[k - step] + up[k]) >> 1)) & 255
    else:
        for k in range(step, len(out)):
            left, top, corner = out[k - step], up[k], up[k - step]
            to_left, to_top, to_corner = abs(top - corner), abs(left - corner), abs(left + top - 2 * corner)
            out[k] = (out[k] + (left if to_left <= to_top and to_left <= to_corner else top if to_top <= to_corner else corner)) & 255
    return np.array(out[step:], np.uint8)


def _grey(samples: np.ndarray) -> np.ndarray:
    red, green, blue = (samples[:, k].astype(np.uint32) for k in range(3))
    return ((red * GREY[0] + green * GREY[1] + blue * GREY[2] + 0x8000) >> 16).astype(np.uint8)


def _bits(row: np.ndarray, depth: int, n: int) -> np.ndarray:
    """The first ``n`` samples of ``depth`` bits, as whole numbers."""
    if depth == 8:
        return row[:n]
    if depth == 16:
        return row[: 2 * n : 2]
    shifts = np.arange(8 - depth, -1, -depth, dtype=np.uint8)
    return ((row[:, None] >> shifts) & ((1 << depth) - 1)).ravel()[:n]


def _png_rows(data: bytes) -> tuple[int, int, Iterator[np.ndarray]]:
    at, head, palette, packed = len(PNG), None, None, []
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(data) or zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise Unreadable("IMAGE_CHUNK_DAMAGED")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body[:13])
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or not packed:
        raise Unreadable("IMAGE_CHUNK_MISSING")
    width, height, depth, colour, _, _, interlaced = head
    _check_size(width, height)
    if colour not in CHANNELS or depth not in (1, 2, 4, 8, 16) or (colour == 3 and palette is None):
        raise Unreadable("IMAGE_COLOUR_UNSUPPORTED")
    if interlaced:
        raise Unreadable("IMAGE_INTERLACED_UNSUPPORTED")
    channels = CHANNELS[colour]
    line, step = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    shades = _grey(palette) if palette is not None else None

    def rows() -> Iterator[np.ndarray]:
        unpack, held, done, above = zlib.decompressobj(), b"", 0, np.zeros(line, np.uint8)
        for part in packed:
            while part and done < height:
                held += unpack.decompress(part, 1 << 20)
                part = unpack.unconsumed_tail
                whole = len(held) // (line + 1)
                for k in range(min(whole, height - done)):
                    raw = np.frombuffer(held, np.uint8, line + 1, k * (line + 1))
                    above = undo_filter(int(raw[0]), raw[1:], above, step)
                    samples = _bits(above, depth, width * channels).reshape(width, channels)
                    if colour == 3:
                        index = samples[:, 0]
                        if index.max() >= len(shades):
                            raise Unreadable("IMAGE_COLOUR_UNSUPPORTED")
                        yield shades[index]
                    elif channels >= 3:
                        yield _grey(samples)
                    else:
                        yield samples[:, 0] if depth >= 8 else (samples[:, 0].astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
                    done += 1
                held = held[whole * (line + 1) :]
        if done < height:
            raise Unreadable("IMAGE_CUT_SHORT")

    return width, height, rows()


def _pnm_rows(data: bytes) -> tuple[int, int, Iterator[np.ndarray]]:
    kind, at, numbers = data[1] - 48, 2, []
    while len(numbers) < (2 if kind in (1, 4) else 3):
        at = _HEAD.match(data, at).end()
        m = _WORD.match(data, at)
        if not m:
            raise Unreadable("IMAGE_HEADER_INVALID")
        numbers.append(int(m[0]))
        at = m.end()
    width, height, most = (*numbers, 1)[:3]
    _check_size(width, height)
    if not 1 <= most <= 65535:
        raise Unreadable("IMAGE_HEADER_INVALID")
    channels = 3 if kind in (3, 6) else 1
    n = width * channels

    def shade(samples: np.ndarray) -> np.ndarray:
        scaled = (np.minimum(samples, most).astype(np.uint32) * 255 // most).astype(np.uint8).reshape(width, channels)
        return _grey(scaled) if channels == 3 else scaled[:, 0]

    def rows() -> Iterator[np.ndarray]:
        if kind == 1:
            digits = np.frombuffer(re.sub(rb"#[^\n\r]*", b"", data[at:]), np.uint8)
            digits = digits[(digits == 48) | (digits == 49)]
            if len(digits) < width * height:
                raise Unreadable("IMAGE_CUT_SHORT")
            step = max(1, AT_ONCE // width)
            for k in range(0, height, step):
                yield from (49 - digits[k * width : min(k + step, height) * width].reshape(-1, width)) * np.uint8(255)
        elif kind in (2, 3):
            values = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[: n * height], np.uint32)
            if len(values) < n * height:
                raise Unreadable("IMAGE_CUT_SHORT")
            yield from (shade(values[k * n : (k + 1) * n]) for k in range(height))
        else:
            line = (width + 7) // 8 if kind == 4 else n * (2 if most > 255 else 1)
            if len(data) < at + 1 + line * height:
                raise Unreadable("IMAGE_CUT_SHORT")
            for k in range(height):
                row = np.frombuffer(data, np.uint8, line, at + 1 + k * line)
                yield (1 - np.unpackbits(row)[:width]) * np.uint8(255) if kind == 4 else shade(row.view(">u2") if most > 255 else row)

    return width, height, rows()


def open_raster(data: bytes) -> tuple[int, int, Iterator[np.ndarray]]:
    """Width, height and the rows of shades, 0 for black to 255 for white; :class:`Unreadable` says why not."""
    if data.startswith(PNG):
        return _png_rows(data)
    if re.match(rb"P[1-6][\s#]", data):
        return _pnm_rows(data)
    raise Unreadable("IMAGE_FORMAT_UNSUPPORTED")


_STRIPS = "package_id string, path string, width int, height int, first_row int, n_rows int, dark binary, error string"


def dark_strips(files: DataFrame, rows: int = STRIP_ROWS, light: int = LIGHT) -> DataFrame:
    """(package_id, path, width, height, first_row, n_rows, dark, error): the pixels below ``light`` as packed bits, in strips of rows.

    A raster that can't be read gives a row with its error; strips read before it was found stay.
    """
    names = ["package_id", "path", "width", "height", "first_row", "n_rows", "dark", "error"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def ready() -> pa.RecordBatch:
            nonlocal size
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            size = 0
            return made

        for some in batches:
            for package, path, content in zip(*(some.column(c) for c in ("package_id", "path", "content"))):
                key = package.as_py(), path.as_py()
                try:
                    width, height, lines = open_raster(content.as_py() or b"")
                    held: list[np.ndarray] = []
                    packed: list[bytes] = []
                    first = n = 0
                    for line in lines:
                        held.append(line)
                        n += 1
                        full = n == rows or first + n == height
                        if full or len(held) * width >= AT_ONCE:
                            packed.append(np.packbits(np.stack(held) < light, axis=1).tobytes())
                            held.clear()
                        if full:
                            out.append((*key, width, height, first, n, b"".join(packed), None))
                            size += len(out[-1][6]) + 256
                            first, n, packed = first + n, 0, []
                            if size > BATCH_BYTES:
                                yield ready()
                except (Unreadable, ValueError, OverflowError, struct.error, zlib.error) as problem:
                    out.append((*key, None, None, None, None, None, str(problem) if isinstance(problem, Unreadable) else "IMAGE_UNREADABLE"))
        if out:
            yield ready()

    return files.select("package_id", "path", "content").mapInArrow(run, _STRIPS)


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``n`` reaches over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def touching(starts: np.ndarray, stops: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of runs of two rows that share a column."""
    first = np.searchsorted(high, starts, "right")
    last = np.searchsorted(low, stops, "left")
    n = np.maximum(last - first, 0)
    return np.repeat(np.arange(len(starts)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def strip_regions(dark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(strip, row, start, stop, region) of the runs of strips of one shape (strip, row, column), in order; a region is named by the number of its first run."""
    edges = np.diff(np.pad(dark.astype(np.int8), ((0, 0), (0, 0), (1, 1))), axis=2)
    strips, rows, starts = np.nonzero(edges == 1)
    stops = np.nonzero(edges == -1)[2]
    # rows one after the other on one line, with a gap between them
    wide = dark.shape[2] + 1
    at = (strips * dark.shape[1] + rows) * wide
    above = np.flatnonzero(rows < dark.shape[1] - 1)
    i, j = touching(at[above] + wide + starts[above], at[above] + wide + stops[above], at + starts, at + stops)
    return strips, rows, starts, stops, _least_labels(len(strips), above[i], j)


_RUN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_PARTS = "package_id string, path string, first_row int, n_rows int, pixels long, left int, top int, right int, bottom int, upper array<struct<start:int,stop:int>>, lower array<struct<start:int,stop:int>>"


def _bounds(place: np.ndarray, n: int, **ends: np.ndarray) -> list[pa.Array]:
    """Sums of ``pixels`` and least ``left`` and ``top``, largest ``right`` and ``bottom`` by place."""
    pixels = np.zeros(n, np.int64)
    np.add.at(pixels, place, ends["pixels"])
    out = [pa.array(pixels)]
    for name, least in (("left", True), ("top", True), ("right", False), ("bottom", False)):
        found = np.full(n, (1 << 31) - 1 if least else 0, np.int64)
        (np.minimum if least else np.maximum).at(found, place, ends[name])
        out.append(pa.array(found, pa.int32()))
    return out


def _stack_parts(batch: pa.RecordBatch, which: np.ndarray, n_rows: int, width: int) -> pa.RecordBatch:
    """Regions of the rows ``which`` of a batch, all strips of one shape."""
    packed = np.frombuffer(b"".join(batch.column("dark").take(pa.array(which)).to_pylist()), np.uint8).reshape(len(which), n_rows, -1)
    strips, rows, starts, stops, region = strip_regions(np.unpackbits(packed, axis=2)[:, :, :width])
    names, place = np.unique(region, return_inverse=True)
    first, height = (batch.column(c).to_numpy()[which] for c in ("first_row", "height"))
    shift = first[strips]
    ends = _bounds(place, len(names), pixels=stops - starts, left=starts, top=rows + shift, right=stops, bottom=rows + shift + 1)
    borders = []
    for meets in ((rows == 0) & (shift > 0), (rows == n_rows - 1) & (shift + n_rows < height[strips])):
        own = np.flatnonzero(meets)
        own = own[np.argsort(place[own], kind="stable")]
        offsets = np.append(0, np.cumsum(np.bincount(place[own], minlength=len(names))))
        runs = pa.StructArray.from_arrays([pa.array(starts[own], pa.int32()), pa.array(stops[own], pa.int32())], fields=list(_RUN))
        borders.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs))
    where = pa.array(which[strips[names]])
    columns = [batch.column(c).take(where) for c in ("package_id", "path", "first_row", "n_rows")]
    return pa.RecordBatch.from_arrays([*columns, *ends, *borders], ["package_id", "path", "first_row", "n_rows", "pixels", "left", "top", "right", "bottom", "upper", "lower"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions of each strip; ``upper`` and ``lower`` are their runs where the strips above and below meet them."""
    for batch in batches:
        shapes = np.stack([batch.column(c).to_numpy() for c in ("n_rows", "width")], axis=1)
        kinds, kind = np.unique(shapes, axis=0, return_inverse=True)
        for k, (n_rows, width) in enumerate(kinds.tolist()):
            own = np.flatnonzero(kind.ravel() == k)
            step = max(1, AT_ONCE // (n_rows * width))
            for low in range(0, len(own), step):
                yield _stack_parts(batch, own[low : low + step], n_rows, width)


_REGIONS = "package_id string, path string, left int, top int, width int, height int, pixels long"


def _regions(parts: pa.Table, place: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """Regions of parts; ``place`` numbers the region of each, ``first`` is a part of each."""
    ends = {c: parts.column(c).to_numpy() for c in ("pixels", "left", "top", "right", "bottom")}
    pixels, left, top, right, bottom = _bounds(place, len(first), **ends)
    keys = [parts.column(c).combine_chunks().take(pa.array(first)) for c in ("package_id", "path")]
    return pa.RecordBatch.from_arrays([*keys, left, top, pc.subtract(right, left), pc.subtract(bottom, top), pixels], ["package_id", "path", "left", "top", "width", "height", "pixels"])


def _numbered(table: pa.Table, keys: tuple[str, ...] = ("package_id", "path")) -> np.ndarray:
    """Numbers of the rasters of sorted rows, from 0."""
    changed = np.zeros(table.num_rows, bool)
    for c in keys:
        code = table.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        changed[1:] |= code[1:] != code[:-1]
    return np.cumsum(changed)


def _joined_parts(parts: pa.Table) -> pa.RecordBatch:
    """Regions of the parts of whole rasters, joined where a lower border meets the upper one below."""
    raster = _numbered(parts)
    top = parts.column("first_row").to_numpy().astype(np.int64)
    sides = []
    for side, edge in (("lower", top + parts.column("n_rows").to_numpy()), ("upper", top)):
        lists = parts.column(side).combine_chunks()
        row = np.repeat(np.arange(parts.num_rows), lists.value_lengths().to_numpy())
        runs = lists.flatten()
        sides.append((row, raster[row], edge[row], *(runs.field(c).to_numpy().astype(np.int64) for c in ("start", "stop"))))
    # borders one after the other on one line, with a gap between them
    lines = np.concatenate([np.stack(side[1:3], axis=1) for side in sides])
    wide = 1 + max((int(side[4].max()) for side in sides if len(side[4])), default=0)
    at = np.unique(lines, axis=0, return_inverse=True)[1].ravel() * wide
    (low_row, _, _, low_start, low_stop), (up_row, _, _, up_start, up_stop) = sides
    low_at, up_at = at[: len(low_row)], at[len(low_row) :]
    order = np.argsort(up_at + up_start)
    i, j = touching(low_at + low_start, low_at + low_stop, (up_at + up_start)[order], (up_at + up_stop)[order])
    first, place = np.unique(_least_labels(parts.num_rows, low_row[i], up_row[order][j]), return_inverse=True)
    return _regions(parts, place, first)


def _join_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions of parts that come raster by raster. Parts at no border leave at once; the others of a raster, whose runs are bounded by :data:`PIXELS`, are held to its end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        parts = pa.Table.from_batches([batch])
        reach = pc.or_(pc.greater(pc.list_value_length(parts.column("upper")), 0), pc.greater(pc.list_value_length(parts.column("lower")), 0))
        alone = parts.filter(pc.invert(reach))
        if alone.num_rows:
            yield _regions(alone, np.arange(alone.num_rows), np.arange(alone.num_rows))
        parts = parts.filter(reach)
        if not parts.num_rows:
            continue
        ends = pa.concat_tables([*(pa.Table.from_batches([b]).slice(b.num_rows - 1) for b in held[-1:]), parts])
        raster = _numbered(ends)[-parts.num_rows :]
        open_from = int(np.searchsorted(raster, raster[-1]))
        if raster[-1]:
            done = pa.concat_tables([pa.Table.from_batches(held), parts.slice(0, open_from)]) if held else parts.slice(0, open_from)
            yield _joined_parts(done)
            held.clear()
        held += parts.slice(open_from).combine_chunks().to_batches()
    if held:
        yield _joined_parts(pa.Table.from_batches(held))


def raster_regions(strips: DataFrame) -> DataFrame:
    """(package_id, path, left, top, width, height, pixels) of the 4-connected dark regions of rasters of :func:`dark_strips`.

    Runs of a strip are joined in its task, many strips at a time; over borders, only parts that reach one are brought
    together, a raster in one run of a task and many rasters at a time.
    """
    keys = ["package_id", "path"]
    dealt = int(strips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    good = strips.filter("error is null").repartition(dealt, *keys, "first_row")
    parts = good.select(*keys, "width", "height", "first_row", "n_rows", "dark").mapInArrow(_parts, _PARTS)
    alone = (F.size("upper") == 0) & (F.size("lower") == 0)
    runs = parts.repartition(dealt, F.xxhash64(*keys, F.when(alone, F.col("first_row")))).sortWithinPartitions(*keys)
    return runs.mapInArrow(_join_borders, _REGIONS)
