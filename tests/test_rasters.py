import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.test_scanners import files
from trussline.sources import rasters, scanners


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(kind, row, above, step):
    left = np.concatenate([np.zeros(step, np.uint8), row[:-step]]) if len(row) > step else np.zeros(len(row), np.uint8)
    corner = np.concatenate([np.zeros(step, np.uint8), above[:-step]]) if len(row) > step else np.zeros(len(row), np.uint8)
    a, b, c = (x.astype(int) for x in (left, above, corner))
    p = a + b - c
    near = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
    guess = {0: 0 * a, 1: a, 2: b, 3: (a + b) // 2, 4: near}[kind]
    return ((row.astype(int) - guess) % 256).astype(np.uint8)


def png(lines, width, depth, colour, palette=None, kinds=(0, 1, 2, 3, 4), interlaced=0):
    step = max(1, rasters.CHANNELS[colour] * depth // 8)
    above, raw = np.zeros(len(lines[0]), np.uint8), b""
    for k, row in enumerate(lines):
        kind = kinds[k % len(kinds)]
        raw += bytes([kind]) + filtered(kind, row, above, step).tobytes()
        above = row
    packed = zlib.compress(raw)
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(lines), depth, colour, 0, 0, interlaced))]
    parts += [chunk(b"PLTE", palette.tobytes())] if palette is not None else []
    return rasters.PNG + b"".join([*parts, chunk(b"IDAT", packed[:7]), chunk(b"IDAT", packed[7:]), chunk(b"IEND", b"")])


def shades(data):
    width, height, rows = rasters.open_raster(data)
    out = np.array(list(rows))
    assert out.shape == (height, width)
    return out


def test_every_filter_and_colour():
    rng = np.random.default_rng(1)
    for width in (1, 2, 13):
        grey = rng.integers(0, 256, (11, width), np.uint8)
        assert (shades(png(list(grey), width, 8, 0)) == grey).all()
        rgb = rng.integers(0, 256, (11, width * 3), np.uint8)
        want = rgb.reshape(11, width, 3).astype(float) @ [0.299, 0.587, 0.114]
        assert abs(shades(png(list(rgb), width, 8, 2)) - want).max() <= 1
        rgba = rng.integers(0, 256, (11, width * 4), np.uint8)
        assert abs(shades(png(list(rgba), width, 8, 6)) - rgba.reshape(11, width, 4)[..., :3].astype(float) @ [0.299, 0.587, 0.114]).max() <= 1
        deep = rng.integers(0, 256, (11, width * 2), np.uint8)
        assert (shades(png(list(deep), width, 16, 0)) == deep[:, ::2]).all()
        bits = rng.integers(0, 2, (11, width), np.uint8)
        assert (shades(png(list(np.packbits(bits, axis=1)), width, 1, 0)) == bits * 255).all()
        palette = np.array([[0, 0, 0], [255, 255, 255], [10, 10, 10]], np.uint8)
        index = rng.integers(0, 3, (11, width), np.uint8)
        assert (shades(png(list(index), width, 8, 3, palette)) == palette[index][..., 0]).all()


def test_every_pnm():
    grey = np.array([[0, 100, 255], [7, 8, 9]], np.uint8)
    assert (shades(b"P5 3 2 255\n" + grey.tobytes()) == grey).all()
    assert (shades(b"P2\n# c 9\n3 2\n255\n0 100 255 # x\n7 8 9") == grey).all()
    assert (shades(b"P5 3 2 65535\n" + (grey.astype(">u2") * 257).tobytes()) == grey).all()
    assert (shades(b"P1 3 2 010 # 1\n1 1 1") == [[255, 0, 255], [0, 0, 0]]).all()
    assert (shades(b"P4 3 2\n" + bytes([0b01000000, 0b11100000])) == [[255, 0, 255], [0, 0, 0]]).all()
    assert (shades(b"P6 1 1 255\n" + bytes([255, 255, 255])) == 255).all() and (shades(b"P3 1 1 9 9 9 9") == 255).all()


GOOD = png([np.arange(5, dtype=np.uint8)] * 3, 5, 8, 0)


@pytest.mark.parametrize(
    "data, error",
    [
        (b"P5 0 5 255\n", "IMAGE_EMPTY"),
        (b"P5 1 1 70000\nab", "IMAGE_HEADER_INVALID"),
        (b"P5 x", "IMAGE_HEADER_INVALID"),
        (b"P5 3 3 255\nabc", "IMAGE_CUT_SHORT"),
        (b"P4 100000 10000\n", "IMAGE_TOO_LARGE"),
        (b"P9 1 1 1\n", "IMAGE_FORMAT_UNSUPPORTED"),
        (b"", "IMAGE_FORMAT_UNSUPPORTED"),
        (GOOD[:-20] + b"x" + GOOD[-19:], "IMAGE_CHUNK_DAMAGED"),
        (png([np.arange(5, dtype=np.uint8)], 5, 8, 0, interlaced=1), "IMAGE_INTERLACED_UNSUPPORTED"),
        (png([np.arange(5, dtype=np.uint8)], 5, 8, 3, np.zeros((2, 3), np.uint8)), "IMAGE_COLOUR_UNSUPPORTED"),
    ],
)
def test_what_can_t_be_read_says_why(data, error):
    with pytest.raises(rasters.Unreadable, match=error):
        shades(data)


def flood(dark):
    """(left, top, width, height, pixels) of each region, by a stack."""
    seen, found = np.zeros_like(dark), []
    for y, x in zip(*np.nonzero(dark)):
        if seen[y, x]:
            continue
        stack, own = [(y, x)], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            own.append((a, b))
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < dark.shape[0] and 0 <= d < dark.shape[1] and dark[c, d] and not seen[c, d]:
                    seen[c, d] = True
                    stack.append((c, d))
        ys, xs = [p[0] for p in own], [p[1] for p in own]
        found.append((int(min(xs)), int(min(ys)), int(max(xs) - min(xs) + 1), int(max(ys) - min(ys) + 1), len(own)))
    return Counter(found)


def found(frame, path):
    return Counter((r.left, r.top, r.width, r.height, r.pixels) for r in frame.filter(f"path = '{path}'").collect())


def test_regions_equal_a_flood_fill(spark):
    rng = np.random.default_rng(4)
    pictures = {f"n{k}": rng.random((37, 29)) < share for k, share in enumerate((0.3, 0.55, 0.62, 1.0, 0.0))}
    spiral = np.zeros((40, 40), bool)
    for k in range(0, 20, 4):
        spiral[k, k : 40 - k] = spiral[k : 40 - k, 39 - k] = spiral[39 - k, k : 40 - k] = spiral[k + 2 : 40 - k, k] = True
        spiral[k + 2, k : k + 3] = True
    pictures["spiral"] = spiral
    data = {k: b"P4 %d %d\n" % v.shape[::-1] + np.packbits(v, axis=1).tobytes() for k, v in pictures.items()}
    for rows in (1, 5, 256):
        regions = rasters.raster_regions(rasters.dark_strips(files(spark, **data), rows=rows)).cache()
        for name, picture in pictures.items():
            assert found(regions, name) == flood(picture)


def test_large_rasters(spark):
    dark = np.zeros((4000, 20_000), bool)
    dark[10:3990, 5:8] = dark[2000, 5:19_995] = True
    dark[100:120, 100:300] = True
    dark[3999, 19_999] = True
    data = b"P4 20000 4000\n" + np.packbits(dark, axis=1).tobytes()
    regions = rasters.raster_regions(rasters.dark_strips(files(spark, a=data)))
    assert found(regions, "a") == Counter([(5, 10, 19_990, 3980, 3980 * 3 + 19_990 - 3), (100, 100, 200, 20, 4000), (19_999, 3999, 1, 1, 1)])


def test_errors_are_rows(spark):
    strips = rasters.dark_strips(files(spark, a=b"P5 0 5 255\n", b=GOOD, c=b"P5 2 4 255\n" + bytes(8)), rows=2)
    assert {r.path: r.error for r in strips.filter("error is not null").collect()} == {"a": "IMAGE_EMPTY"}
    assert sorted((r.path, r.pixels) for r in rasters.raster_regions(strips).collect()) == [("b", 15), ("c", 8)]


def test_headers(spark):
    rows = scanners.raster_headers(files(spark, a=b"P4 3 2\nab", b=b"P5 0 5 255\n", c=b"P5 1 1 70000\n", d=b"P1\n# c\n9 8 0", e=GOOD, f=b"P5 2 2 65535\n"))
    got = {r.path: (r.format, r.width, r.height, r.depth, r.error) for r in rows.collect()}
    assert got == {"a": ("PBM", 3, 2, 1, None), "b": ("PGM", 0, 5, 8, "IMAGE_EMPTY"), "c": ("PGM", 1, 1, 16, "IMAGE_HEADER_INVALID"), "d": ("PBM", 9, 8, 1, None), "e": ("PNG", 5, 3, 8, None), "f": ("PGM", 2, 2, 16, None)}


def test_many_rasters_are_joined_at_once(spark):
    rng = np.random.default_rng(6)
    pictures = {f"n{k}": rng.random(tuple(rng.integers(1, 12, 2))) < 0.6 for k in range(200)}
    data = {k: b"P4 %d %d\n" % v.shape[::-1] + np.packbits(v, axis=1).tobytes() for k, v in pictures.items()}
    regions = rasters.raster_regions(rasters.dark_strips(files(spark, **data), rows=3))
    got = Counter((r.path, r.left, r.top, r.width, r.height, r.pixels) for r in regions.collect())
    assert got == Counter({(name, *region): n for name, picture in pictures.items() for region, n in flood(picture).items()})
    # each raster once a Python call, and each strip cut twice, is what small files can't bear
    plan = regions._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Join" not in plan and plan.split("Initial Plan")[0].count("Scan") == 1
