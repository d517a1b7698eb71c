"""Media columns as Matroska files: elements, clusters, lacing and cues read into packet tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.llm.common import map_rows

# Element ids of the container format.
EBML, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, CHAPTERS, ATTACHMENTS, TAGS = 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements of the segment's own level; one of these ends a cluster of unknown size.
_TOP = frozenset((INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, CHAPTERS, ATTACHMENTS, TAGS))

#: Samples of a packet, and 8-bit samples a second.
FRAME, RATE = 192, 8000
LACED, BLOCKS_PER_CLUSTER = 8, 25


class Malformed(ValueError):
    """The bytes break off or hold an impossible length."""


def vint(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones are kept for the unknown size."""
    width = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data: bytes, at: int, end: int) -> tuple[int | None, int]:
    """(value, next position); None for the unknown size."""
    if at >= end or not data[at]:
        raise Malformed(f"no length at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Malformed(f"a length breaks off at byte {at}")
    value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def elements(data: bytes, at: int, end: int, stop: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, bool]]:
    """(id, start of body, end of body, size known) of each element; ends before an id of ``stop``."""
    while at < end:
        first = data[at]
        width = 9 - first.bit_length() if first else 9
        if width > 4 or at + width > end:
            raise Malformed(f"no element at byte {at}")
        ident = int.from_bytes(data[at : at + width], "big")
        if ident in stop:
            return
        size, body = read_vint(data, at + width, end)
        if size is not None and body + size > end:
            raise Malformed(f"element {ident:X} at byte {at} breaks off")
        if size is None:
            last = _unknown_end(data, body, end, ident)
        else:
            last = body + size
        yield ident, body, last, size is not None
        at = last


def _unknown_end(data: bytes, body: int, end: int, ident: int) -> int:
    if ident != CLUSTER:
        return end
    last = body
    for _, _, last, _ in elements(data, body, end, _TOP):
        pass
    return last


def _uint(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block and the position of the first; kind 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if kind == 0:
        return [end - at], at
    if at >= end:
        raise Malformed(f"a lace breaks off at byte {at}")
    count, at = data[at] + 1, at + 1
    if kind == 2:
        if (end - at) % count:
            raise Malformed(f"fixed lace of uneven size at byte {at}")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for k in range(count - 1):
        if kind == 1:
            size = 0
            while True:
                if at >= end:
                    raise Malformed(f"a lace breaks off at byte {at}")
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
        else:
            start = at
            value, at = read_vint(data, at, end)
            if value is None:
                raise Malformed(f"unknown frame size at byte {start}")
            size = value if k == 0 else sizes[-1] + value - ((1 << 7 * (at - start) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Malformed(f"frames beyond their block at byte {at}")
    return sizes, at


def lace(frames: list[bytes], kind: int) -> bytes:
    """The lace header and the frames."""
    if kind == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == 3 and len(sizes) > 1:
        head += vint(sizes[0])
        for before, size in zip(sizes, sizes[1:-1]):
            width = next(n for n in range(1, 9) if abs(size - before) < (1 << 7 * n - 1) - 1)
            head += vint(size - before + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


@dataclass
class Media:
    """What a file holds: tracks, packets and cues."""

    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, int, int | None, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: int = 0
    scale: int = 1_000_000
    segment: int = 0
    error: str | None = None


def _block(media: Media, data: bytes, start: int, end: int, base: int, number: int, key: bool | None) -> None:
    track, at = read_vint(data, start, end)
    if track is None or at + 3 > end:
        raise Malformed(f"a block breaks off at byte {start}")
    offset, flags = struct.unpack_from(">hB", data, at)
    sizes, at = lace_sizes(data, at + 3, end, flags >> 1 & 3)
    each = media.tracks.get(track, {}).get("default_duration", 0)
    for k, size in enumerate(sizes):
        stamp = (base + offset) * media.scale + k * each if k == 0 or each else None
        media.packets.append((track, media.clusters - 1, number, at, size, stamp, bool(flags & 0x80) if key is None else key))
        at += size


def parse(data: bytes | None) -> Media:
    """Packets (track, cluster, block, start, size, timestamp in ns, key), cues (ns, track, byte of the cluster).

    Sizes may be unknown for segments and clusters. Bytes that break off keep what was read and set ``error``. Later
    frames of a lace get a timestamp only if the track tells how long a frame lasts.
    """
    media = Media()
    try:
        for ident, start, end, _ in elements(data or b"", 0, len(data or b"")):
            if ident == SEGMENT:
                media.segment = start
                _segment(media, data, start, end)
    except Malformed as problem:
        media.error = str(problem)
    return media


def _segment(media: Media, data: bytes, start: int, end: int) -> None:
    cues = []
    for ident, s, e, _ in elements(data, start, end):
        if ident == INFO:
            for i, a, b, _ in elements(data, s, e):
                if i == TIMESTAMP_SCALE:
                    media.scale = _uint(data, a, b)
        elif ident == TRACKS:
            for i, a, b, _ in elements(data, s, e):
                if i == TRACK_ENTRY:
                    own = {k: (x, y) for k, x, y, _ in elements(data, a, b)}
                    read = {"codec": data[slice(*own[CODEC_ID])].decode("ascii", "replace") if CODEC_ID in own else ""}
                    for name, k in (("type", TRACK_TYPE), ("default_duration", DEFAULT_DURATION)):
                        read[name] = _uint(data, *own[k]) if k in own else 0
                    media.tracks[_uint(data, *own[TRACK_NUMBER]) if TRACK_NUMBER in own else 0] = read
        elif ident == CLUSTER:
            media.clusters += 1
            base, number = 0, 0
            for i, a, b, _ in elements(data, s, e):
                if i == TIMESTAMP:
                    base = _uint(data, a, b)
                elif i == SIMPLE_BLOCK:
                    _block(media, data, a, b, base, number, None)
                    number += 1
                elif i == BLOCK_GROUP:
                    inner = {k: (x, y) for k, x, y, _ in elements(data, a, b)}
                    if BLOCK in inner:
                        _block(media, data, *inner[BLOCK], base, number, REFERENCE_BLOCK not in inner)
                        number += 1
        elif ident == CUES:
            cues.append((s, e))
    for s, e in cues:  # a scale may follow them
        for i, a, b, _ in elements(data, s, e):
            if i == CUE_POINT:
                inner = [(k, x, y) for k, x, y, _ in elements(data, a, b)]
                time = next((_uint(data, x, y) for k, x, y in inner if k == CUE_TIME), 0)
                for k, x, y in inner:
                    if k == CUE_POSITIONS:
                        own = {j: _uint(data, p, q) for j, p, q, _ in elements(data, x, y) if q - p <= 8}
                        media.cues.append((time * media.scale, own.get(CUE_TRACK, 0), media.segment + own.get(CUE_CLUSTER, 0)))


def write(payload: bytes, kind: int = 2) -> bytes:
    """One track of 8-bit samples: packets of 192 samples, eight to a laced block, clusters with cues.

    Nothing in the file depends on time or chance, so equal payloads give equal files.
    """
    ms = FRAME * 1000 // RATE
    frames = [payload[k : k + FRAME] for k in range(0, len(payload), FRAME)]
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    entry = uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, ms * 1_000_000) + audio
    info = uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(frames) * ms)) + element(MUXING_APP, b"trussline") + element(WRITING_APP, b"trussline")
    parts = [element(INFO, info), element(TRACKS, element(TRACK_ENTRY, entry))]
    at, cues = sum(map(len, parts)), []
    span = LACED * BLOCKS_PER_CLUSTER
    for first in range(0, len(frames), span):
        body = [uint(TIMESTAMP, first * ms)]
        for k in range(first, min(first + span, len(frames)), LACED):
            own = frames[k : min(k + LACED, first + span)]
            how = kind if len(own) > 1 else 0
            body.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", (k - first) * ms, 0x80 | how << 1) + lace(own, how)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, first * ms) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    head = element(EBML, element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ, 2))
    return head + element(SEGMENT, b"".join(parts))


def payload_of(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of 192 bytes."""
    return text + b" " * (-len(text) % FRAME if text else FRAME)


def samples_of(data: bytes, media: Media, track: int = 1) -> bytes:
    """The packets of a track, one after the other."""
    return b"".join([data[p[3] : p[3] + p[4]] for p in media.packets if p[0] == track])


def feature_of(samples: bytes, media: Media) -> str:
    """Packets, clusters, cues, length in ms, mean and peak sample, level changes, and the loudest packet's number."""
    level = np.frombuffer(samples, np.uint8).astype(np.int32)
    turns = int(np.count_nonzero(np.diff((level >= 128).astype(np.int8))))
    each = np.add.reduceat(level, np.arange(0, len(level), FRAME))
    end = (media.packets[-1][5] or 0) // 1_000_000 + FRAME * 1000 // RATE
    return f"packets={len(media.packets)};clusters={media.clusters};cues={len(media.cues)};ms={end};sum={int(level.sum())};peak={int(level.max())};turns={turns};loudest={int(each.argmax())}"


def media_report(docs: DataFrame) -> DataFrame:
    """Each whole text stored in a Matroska file, read back from its bytes and described.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature). Null texts are
    stored as empty ones; every row gives a row, equal texts equal values; other columns are ignored.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or b""
                file = write(payload_of(text))
                media = parse(file)
                back = samples_of(file, media)
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature_of(back, media)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*rows)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names)

        return work

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary")), schema, make)


def store_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with a binary column that holds the text's bytes as a Matroska file; null texts as empty ones."""
    data = docs.withColumn(media, F.coalesce(F.col(text).cast("binary"), F.lit(b"")))
    at = data.columns.index(media)

    def make():
        return lambda batch: batch.set_column(at, media, pa.array([write(payload_of(x)) for x in batch.column(at).to_pylist()], pa.binary()))

    return map_rows(data, data.schema, make)


def packet_table(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Packets of media files: (key, track, codec, cluster, block, packet, timestamp_ns, is_key, start, size, error).

    ``start`` and ``size`` are byte ranges of the file. Null and empty files give no row; a file that breaks off gives
    the packets before and, last, a row with only the key and the error.
    """
    fields = "track long, codec string, cluster long, block long, packet long, timestamp_ns long, is_key boolean, start long, size long, error string"
    rows = files.select(F.col(key).alias("__key"), F.col(media).alias("__media"))
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.int64(), pa.int64(), pa.string()]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            take, out = [], []
            for k, data in enumerate(batch.column(1).to_pylist()):
                media = parse(data)
                own = [(t, media.tracks.get(t, {}).get("codec", ""), c, b, n, stamp, is_key, at, size, None) for n, (t, c, b, at, size, stamp, is_key) in enumerate(media.packets)]
                if media.error:
                    own.append((*[None] * 9, media.error))
                out += own
                take += [k] * len(own)
            cols = list(zip(*out)) if out else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["__key", *(f.split()[0] for f in fields.split(", "))])

        return work

    kind = rows.schema["__key"].dataType.simpleString()
    return map_rows(rows, f"__key {kind}, {fields}", make, rows=64).withColumnRenamed("__key", key)
