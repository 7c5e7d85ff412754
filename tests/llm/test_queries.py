"""The numbered queries on the smallest tables: their SQL twins, and what can be told without one."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from parity import compare, connect
from tillview.llm import queries
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def texts(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twins(spark, name):
    assert compare(spark, connect(FOLDER), name, queries.QUERIES[name], queries.SQL[name], FOLDER) is None


def test_pieces(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in queries.op1_sentencepiece(spark, FOLDER).collect()}
    assert got == {i: len(library.encode(t, add_eos=True)) for i, t in texts}


def _ids(name, texts, end):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    return {i: [*library.encode(t, add_special_tokens=False).ids, end] for i, t in texts}


def test_packing(spark, texts):
    ids = _ids("word_bpe_49k.json", texts, 1)
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in queries.op4_packing(spark, FOLDER).collect())
    want = [(i, k, 4096 * k, len(x[4096 * k :][:4096]), zlib.crc32(np.array(x[4096 * k :][:4096], "<u4").tobytes())) for i, x in ids.items() for k in range(-(-len(x) // 4096))]
    assert got == sorted(want)


def test_token_files(spark, texts):
    start, want = 0, []
    for i, x in _ids("byte_bpe_50k.json", texts, 2).items():
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(tuple(r) for r in queries.op7_token_files(spark, FOLDER).collect()) == want


def test_quality_scores_all(spark, texts):
    got = queries.op8_quality(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in texts]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in got)
