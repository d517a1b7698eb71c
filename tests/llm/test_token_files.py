import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trussline.llm import byte_pieces as bp
from trussline.llm import packed_ids, token_files


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bp.BYTE_BPE_PATH)


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


HARD = ["", " ", "a  b", " a b ", "a\n b\nc", "it's we'll 'tis", "x y  z", "<|endoftext|> a<|endoftext|>b", "<|endoftext|>", "日本 語 です", "½ 3² a1b2", "\x1c\x1d a \x85 b", "é àb", "👩‍👩‍👧 ok", "tab\tand  \t mix", "a" * 5000, "= " * 300, "\r\n\r\n a"]


@pytest.mark.parametrize("text", HARD)
def test_parts_encode_like_the_library(library, text):
    for pieces, plain in ((bp.byte_pieces(bp.BYTE_BPE_PATH), False), (bp.byte_pieces(bp.BYTE_BPE_PATH, True), True)):
        other = Tokenizer.from_file(bp.BYTE_BPE_PATH)
        other.encode_special_tokens = plain
        assert np.frombuffer(pieces.encode(text), pieces.dtype).tolist() == other.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab'1 \n\t.é²ª  \x1c語́<|>_-")), max_size=30))
def test_any_text_encodes_like_the_library(text):
    pieces = bp.byte_pieces(bp.BYTE_BPE_PATH)
    assert pieces.encode(text) == pieces.whole(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=3000))
def test_blocks_round_trip(values):
    values = np.array(values, np.uint32)
    assert packed_ids.unpack(packed_ids.pack(values)).tolist() == values.tolist()


def test_outliers_don_t_widen_a_block():
    values = np.arange(1024, dtype=np.uint32) % 16 + 1000
    narrow = len(packed_ids.pack_blocks(values)[0])
    values[[5, 900]] = 2**32 - 1
    wide = packed_ids.pack_blocks(values)[0]
    assert narrow == 8 + 1024 * 4 // 8 and len(wide) == narrow + 2 * 2 + 2 * 4
    assert packed_ids.unpack_blocks(np.frombuffer(wide, "<u4"), np.array([0])).tolist() == values.tolist()


def test_files_give_back_every_document(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = token_files.token_file_report(docs).orderBy("doc_id").collect()
    start = 0
    for g, d in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        ids = ids_of(library, d.text)
        assert tuple(g) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_nulls_ties_repeats_and_clashing_columns(spark, library):
    rows = [(None, "none", 1), (5, None, 2), (5, "five", 3), (5, "five", 3), (2, "", 4), (2**40, "x" * 100_000, 5), (-3, "minus <|endoftext|>", 6)]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, tie long").withColumnRenamed("tie", "place")
    got = token_files.token_file_report(docs).orderBy("start").collect()
    assert [g.doc_id for g in got] == [None] * 3 + [-3] * 3 + [2] * 3 + [5] * 9 + [2**40] * 3
    assert [g.start for g in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    want = sorted(zlib.crc32(ids_of(library, t).tobytes()) for _, t, _ in rows * 3)
    assert sorted(g.ids_crc32 for g in got) == want
    assert token_files.token_file_report(docs.limit(0)).count() == 0


def test_one_document_is_read_by_the_index(spark, tmp_path, library):
    docs = spark.createDataFrame([(k, f"document {k} " * (k * 40)) for k in range(60)], "doc_id long, text string")
    token_files.write_token_files(docs.coalesce(1), str(tmp_path / "ids"))
    listed = json.loads((tmp_path / "ids" / token_files.MANIFEST).read_text())
    some = max(listed["files"], key=lambda f: f["docs"])
    system, path = token_files.place_of(str(tmp_path / "ids" / some["file"]))
    read = []
    with system.open_input_file(path) as source:
        index = token_files.read_index(source, system.get_file_info(path).size)

        class Counted:
            def seek(self, at):
                source.seek(at)

            def read(self, n):
                read.append(n)
                return source.read(n)

        k = len(index.docs) // 2
        ids = token_files.read_ids(Counted(), index, int(index.ends[k - 1]), int(index.ends[k]))
    assert ids.tolist() == ids_of(library, f"document {index.docs[k]} " * (index.docs[k] * 40)).tolist()
    assert len(read) == 1 and read[0] < 0.3 * index.blocks_end


def test_files_of_lost_tasks_don_t_count(spark, tmp_path):
    target = tmp_path / "ids"
    token_files.write_token_files(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), str(target))
    (target / "left-behind.tok").write_bytes(b"TOKPFOR1 half a file")
    assert token_files.read_token_files(spark, str(target)).count() == 2


def test_words_behind_a_space_are_kept_once():
    from trussline.llm.byte_pieces import BYTE_BPE_PATH, BytePieces

    pieces = BytePieces(BYTE_BPE_PATH, False, 1 << 10)
    text = "one two, three (two) four\nfive six, two"
    assert pieces.encode(text) == pieces.whole(text)
    assert {"two", "two,", "three"} <= set(pieces.parts) and not {w for w in pieces.words if w[0] == " " and w[1:].isalpha()}
