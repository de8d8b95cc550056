import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import awkward, docs, words
from tokenizers import Tokenizer

from quillspan.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("high", [1, 2, 200, 50_257, 2**31, 2**32])
def test_blocks_round_trip(high):
    rng = np.random.default_rng(high)
    for n in (0, 1, 127, 128, 129, 5000):
        ids = rng.integers(0, high, n).astype(np.uint32)
        ids[rng.random(n) < 0.05] = 2**32 - 1 if high > 1 else 0  # outliers
        blocks, starts = token_files.pack_ids(ids)
        assert (token_files.unpack_blocks(blocks, starts)[:n] == ids).all()
        for k in range(0, len(starts), 7):  # any block alone
            assert (token_files.unpack_blocks(blocks, starts[k : k + 1])[: len(ids[128 * k :])][:128] == ids[128 * k : 128 * (k + 1)]).all()


def test_outliers_do_not_widen_a_block():
    ids = np.full(128 * 100, 1000, np.uint32) + np.arange(128 * 100, dtype=np.uint32) % 8
    ids[::128] = 50_000
    blocks, _ = token_files.pack_ids(ids)
    assert len(blocks) == 100 * (6 + 16 * 3 + 5)


def test_files_give_back_all_ids(spark, monkeypatch):
    pairs = awkward() + [(50 + i, " ".join(words(i, 40))) for i in range(40)]
    path = token_files.write_ids(docs(spark, pairs), PATH)
    got = token_files.read_ids(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in pairs), key=lambda i: (i is not None, i or 0))
    expected = sorted(tuple(ids_of(t)) for _, t in pairs)
    assert sorted(tuple(r.ids) for r in got) == expected
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    texts = {i: t for i, t in pairs if i not in (None, 10)}
    assert all(r.ids == ids_of(texts[r.doc_id]) for r in got if r.doc_id in texts)
    assert {(r.doc_id, r.start, r.n_tokens) for r in token_files.index(spark, path).collect()} == {(r.doc_id, r.start, r.n_tokens) for r in got}
    some = token_files.read_ids(spark, path, [7, 55, 10, 999]).collect()
    assert sorted(map(tuple, some)) == sorted(tuple(r) for r in got if r.doc_id in (7, 55, 10))


def test_many_segments(spark):
    r = random.Random(3)
    pairs = [(i, " ".join(words(i, r.randrange(1, 30_000)))) for i in range(30)] + [(100, "long " * 400_000)]
    path = token_files.write_ids(docs(spark, pairs), PATH)
    assert spark.read.parquet(path).count() > 4
    got = {r.doc_id: r for r in token_files.read_ids(spark, path, keep_ids=False).collect()}
    at = 0
    for i, text in pairs:
        ids = ids_of(text)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, got[i].ids) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), None)
        at += len(ids)


def test_no_rows(spark):
    path = token_files.write_ids(docs(spark, []).limit(0), PATH)
    assert token_files.read_ids(spark, path).collect() == [] and token_files.index(spark, path).collect() == []
