import hashlib
import random
import struct
import zlib

import pytest

from trussline.llm import matroska as mk


def test_vints():
    for value in (0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**55):
        data = mk.vint(value)
        assert mk.read_vint(data, 0, len(data)) == (value, len(data))
    assert mk.read_vint(b"\xff", 0, 1) == (None, 1) and mk.read_vint(b"\x01" + b"\xff" * 7, 0, 8) == (None, 8)
    for bad in (b"", b"\x00", b"\x40"):
        with pytest.raises(mk.Malformed):
            mk.read_vint(bad, 0, len(bad))


@pytest.mark.parametrize("kind", [1, 3])
def test_lacing_of_uneven_frames(kind):
    r = random.Random(kind)
    for _ in range(100):
        frames = [bytes(r.choice([0, 1, 5, 254, 255, 256, 510, 3000, 70000])) for _ in range(r.randrange(2, 9))]
        data = mk.lace(frames, kind)
        sizes, at = mk.lace_sizes(data, 0, len(data), kind)
        assert sizes == [len(f) for f in frames] and at + sum(sizes) == len(data)


@pytest.mark.parametrize("kind", [1, 2, 3])
def test_files_read_back(kind):
    r = random.Random(kind)
    for size in (0, 1, 191, 192, 193, 1536, 1537, 40000):
        text = r.randbytes(size)
        payload = mk.payload_of(text)
        assert len(payload) % 192 == 0 < len(payload) and payload.rstrip(b" ") == text.rstrip(b" ")
        file = mk.write(payload, kind)
        media = mk.parse(file)
        assert media.error is None and mk.samples_of(file, media) == payload
        assert [p[5] for p in media.packets] == [k * 24_000_000 for k in range(len(media.packets))]
        assert all(file[c[2] : c[2] + 4] == b"\x1f\x43\xb6\x75" for c in media.cues) and len(media.cues) == media.clusters


def test_unknown_sizes_groups_and_skipped_elements():
    block = mk.vint(2) + struct.pack(">hB", -5, 0) + b"abc"
    cluster = mk.uint(mk.TIMESTAMP, 100) + mk.element(0xEC, b"\0" * 9) + mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, block) + mk.uint(mk.REFERENCE_BLOCK, 1)) + mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, block))
    tracks = mk.element(mk.TRACKS, mk.element(mk.TRACK_ENTRY, mk.uint(mk.TRACK_NUMBER, 2) + mk.element(mk.CODEC_ID, b"X")))
    ident = lambda k: k.to_bytes(4, "big")
    file = mk.element(mk.EBML, b"") + ident(mk.SEGMENT) + b"\xff" + tracks + ident(mk.CLUSTER) + b"\x01" + b"\xff" * 7 + cluster + ident(mk.CLUSTER) + b"\xff" + cluster
    media = mk.parse(file)
    assert media.error is None and media.clusters == 2 and [(p[0], p[1], p[5], p[6]) for p in media.packets] == [(2, c, 95_000_000, key) for c in (0, 1) for key in (False, True)]
    assert [file[p[3] : p[3] + p[4]] for p in media.packets] == [b"abc"] * 4


def test_cut_files_keep_what_came_before():
    file = mk.write(mk.payload_of(b"x" * 5000))
    for cut in range(0, len(file), 37):
        media = mk.parse(file[:cut])
        assert cut == 0 or media.error or not media.packets
    whole = mk.parse(file[:-1])
    assert whole.error


def test_tables(docs):
    rows = [(1, "hello"), (2, None), (3, ""), (4, "hello"), (4, "hello"), (None, "é" * 96), (5, "word " * 40000)]
    table = docs(rows, {"media": "mine", "feature": "mine"})
    got = mk.media_report(table).collect()
    assert len(got) == len(rows)
    values = {}
    for r in got:
        text = next((t or "").encode() for k, t in rows if k == r.doc_id)
        payload = text + b" " * (-len(text) % 192 or (0 if text else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert values.setdefault(text, tuple(r)[1:]) == tuple(r)[1:]
    packets = mk.packet_table(mk.store_media(table.drop("media", "feature")))
    counts = {r.doc_id: r["count"] for r in packets.groupBy("doc_id").count().collect()}
    assert counts == {1: 1, 2: 1, 3: 1, 4: 2, None: 1, 5: 1042}
    assert mk.media_report(docs([])).count() == 0
    broken = table.sparkSession.createDataFrame([(1, bytearray(mk.write(b" " * 192)[:-3])), (2, None), (3, bytearray())], "doc_id long, media binary")
    assert [(r.doc_id, r.error is not None) for r in mk.packet_table(broken).filter("error is not null").collect()] == [(1, True)]
