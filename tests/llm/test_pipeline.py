import corpus_pipeline
import numpy as np

from tests.llm.test_pii import brute
from tests.llm.test_simhash import groups, plain
from trussline.llm import pieces, pii


def test_stages_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        out[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    told = out["language_id"]
    assert {r.doc_id for r in told} <= set(rows) and len(told) >= 0.98 * len(rows) and all(r.text == rows[r.doc_id].text for r in told)
    ids = [r.doc_id for r in told]
    want = {g for g in groups([plain(r.text) for r in told], ids)}
    assert {r.doc_id for r in out["simhash_near_dedup"]} == want and len(out["simhash_near_dedup"]) == len(want)
    for r in out["pii"]:
        assert r.n_chars == len(r.text) and not brute(r.text) and r.text == pii.redacted(rows[r.doc_id].text)
    mixed = {}
    for r in out["source_mixing"]:
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + 1
    assert set(mixed.values()) <= {1, 2} and set(mixed) <= want
    model = pieces.load(pieces.read_model())
    assert len(out["sentencepiece"]) == len(out["source_mixing"])
    for r in out["sentencepiece"]:
        assert pieces.decode_ids(model[0], r.ids) == r.text
        assert list(r.ids) == np.frombuffer(pieces.encode_text(*model, r.text), np.int32).tolist()


def test_run_equals_the_stages(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert "ids" in got.columns and got.count() > 0


def test_registered_queries_have_the_contract_columns(spark, sf):
    from trussline.llm import queries

    want = {
        "op1": ["doc_id", "held_out", "lang_pred", "score"],
        "op2": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op3": ["vec_id", "n_links", "component_id", "kept"],
        "op6": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op7": ["doc_id", "size", "source_size", "target", "taken"],
        "op9": ["doc_id", "fingerprint", "component_id"],
        "op10": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    }
    found = {name.split("_")[0]: query for name, query in queries.queries().items() if name.startswith("op")}
    assert set(found) == {f"op{k}" for k in range(1, 11)}
    for op, columns in want.items():
        assert found[op](spark, sf).columns[: len(columns)] == columns
