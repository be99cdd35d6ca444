"""Texts of 5 MB without a space, and of very many lines, through every operator on documents and through the pipeline."""

import hashlib
import zlib

import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from plain import normalised
from starboard.llm.queries import QUERIES, tokenizer_file

MB5 = 5_000_000


def texts():
    code = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(MB5 // 64))
    chinese = "".join(chr(0x4E00 + i * 7919 % 20_000) for i in range(300_000))
    lines = "\n".join(f"line {i} of many" for i in range(300_000))
    return {1: code, 2: chinese, 3: lines, 4: "a short text of some words", 5: code[: MB5 // 2]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in texts().items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def found(spark, folder, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, folder).collect()}


def test_mix_and_language(spark, folder):
    assert set(found(spark, folder, "op1_mix_sources")) == set(texts())
    assert {r["lang_pred"] for r in found(spark, folder, "op2_language_id").values()} == {"en"}


def test_fingerprints(spark, folder):
    for i, r in found(spark, folder, "op3_document_fingerprints").items():
        assert r["n_chars"] == len(texts()[i]) and len(r["edited_sha256"]) == 64


def test_simhash_and_exact_dedup(spark, folder):
    rows = found(spark, folder, "op4_simhash_near_dedup")
    code = texts()[1]
    assert int(rows[1]["fingerprint"], 16) == xxhash.xxh64_intdigest(code, seed=42)
    kept = found(spark, folder, "op6_exact_dedup")
    for i, t in texts().items():
        assert kept[i]["kept"] and kept[i]["text_sha256"] == hashlib.sha256(normalised(t).encode()).hexdigest()


def test_packing_and_counts(spark, folder):
    real = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    pieces = {}
    for r in QUERIES["op5_best_fit_packing"](spark, folder).collect():
        pieces.setdefault(r["doc_id"], {})[r["piece"]] = r
    for i, t in texts().items():
        ids = [*real.encode(t, add_special_tokens=False).ids, 0]
        assert sum(r["length"] for r in pieces[i].values()) == len(ids)
        first = b"".join(x.to_bytes(4, "little") for x in ids[:2048])
        assert pieces[i][0]["ids_crc32"] == zlib.crc32(first)
    assert all(r["n_tokens"] > 0 for r in found(spark, folder, "op7_token_counts").values())


def test_lines_importance_and_collocations(spark, folder):
    lines = found(spark, folder, "op9_line_dedup")
    assert lines[3]["n_lines"] == 300_000 and all(lines[i]["text"] == t for i, t in texts().items())
    assert set(found(spark, folder, "op10_importance_resampling")) == set(texts())
    phrases = {r["phrase"]: r["a"] for r in QUERIES["op13_phrase_collocations"](spark, folder).collect()}
    assert phrases["of many"] == 300_000


def test_pipeline(spark, folder):
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in pieces} <= set(texts()) and 4 in {r["doc_id"] for r in pieces}
