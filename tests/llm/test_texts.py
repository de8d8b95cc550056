import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fixtures import awkward, docs, words
from tokenizers import Tokenizer

from quillspan.llm import decontamination, fingerprints, packing, token_counts, tokens
from quillspan.llm import words as word_helpers

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_cuts_give_the_ids_of_whole_texts():
    r = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", ".", " ,", ",", "é", "日本", "1", "\t", "'s", "don't", "<|endoftext|>", "\x1c", "!", "..", "word", " the", "　", " "]
    own = tokens.Encoder(PATH)
    for _ in range(100):
        texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(20)]
        for text, ids in zip(texts, own.encode(texts)):
            assert "".join(tokens.cuts(text)) == text and list(ids) == ids_of(text)
        for text, ids in zip([*texts, None, "", "end"], own.encode_column(pa.array([*texts, None, "", "end"]))):
            assert list(ids) == ids_of(text)


def test_columns_of_plain_and_awkward_texts(monkeypatch):
    monkeypatch.setattr(tokens, "COLUMN_BYTES", 300)
    texts = ["plain words here\nand there.", "two  blanks", " before", "after ", "tab\there", "wide\u3000space", "nbsp\xa0x y", "a\n b", "x \ny", "one", None, "", "ä ö\nü", "line\u2028sep z", "\x85 a", "c\x1cd e"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = [pair for ids, encoded in tokens.encoded_columns(iter([batch]), PATH, 20) for pair in zip(ids, encoded)]
    assert [i for i, _ in got] == list(range(len(texts))) and all(list(ids) == ids_of(t) for (_, ids), t in zip(got, texts))


def test_lean_packing_gives_the_same_pieces_and_keeps_no_encoder():
    pairs = [*awkward(), *((100 + i, " ".join(words(i, 400, 10**6))) for i in range(200))]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([t for _, t in pairs])], names=["doc_id", "text"])

    def pieces(lean):
        return [row for out in packing._pieces(PATH, 64, True, 50_000, lean)(iter([batch])) for row in out.to_pylist()]

    tokens.forget(PATH, 50_000)
    lean = pieces(True)
    assert (PATH, 50_000) not in tokens._ENCODERS
    assert lean == pieces(False)
    assert (PATH, 50_000) in tokens._ENCODERS


def test_packing(spark):
    pairs = awkward()
    got = packing.pack(docs(spark, pairs), PATH, window=64).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 64 for r in got)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length for r in got)
    by_doc: dict = {}
    for r in sorted(got, key=lambda r: (str(r.doc_id), r.sequence_id)):
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in pairs:
        rows, whole = by_doc[i], ids_of(text) + [0]
        if sum(j == i for j, _ in pairs) == 1:
            assert [r.start for r in rows] == list(np.cumsum([0] + [r.length for r in rows])[:-1])
            assert sum((r.ids for r in rows), []) == whole and {r.doc_tokens for r in rows} == {len(whole)}
    assert sum(r.length for r in got) == sum(len(ids_of(t)) + 1 for _, t in pairs)
    assert packing.pack(docs(spark, []).limit(0), PATH).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs(spark, pairs), PATH, window=100)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    from pyspark.sql import functions as F

    pairs = [(i, t) for i, t in awkward() if i is not None and i != 10]
    starts = F.array(F.lit(5), F.lit(None), F.lit(2), F.lit(5), F.lit(-3), F.lit(50), F.lit(10**6))
    for given in (None, starts):
        got: dict = {}
        for r in token_counts.section_tokens(docs(spark, pairs), PATH, rule, given).collect():
            got.setdefault(r.doc_id, []).append(r)
        for i, text in pairs:
            text, rows = text or "", sorted(got[i], key=lambda r: r.section)
            cuts = [0] + [k + 1 for k, c in enumerate(text) if c == "\n"] if given is None else sorted({0, *(min(max(s, 0), len(text)) for s in (5, 2, -3, 50, 10**6))})
            assert [r.char_start for r in rows] == cuts and rows[-1].char_end == len(text)
            expected, at = [0] * len(cuts), 0
            edges = [len(text[:c].encode()) for c in cuts]
            size = tokens.encoder(PATH).n_bytes
            for t in ids_of(text):
                own = [max(e for e in range(len(edges)) if edges[e] <= b) for b in range(at, at + size[t])]
                pick = own[0] if rule == "start" else own[-1] if rule == "end" else max(own, key=lambda s: (own.count(s), -s))
                expected[pick] += 1
                at += size[t]
            assert [r.n_tokens for r in rows] == expected
    assert token_counts.section_tokens(docs(spark, []).limit(0), PATH).collect() == []
    with pytest.raises(ValueError):
        token_counts.section_tokens(docs(spark, pairs), PATH, "half")


def test_fingerprints(spark):
    r = random.Random(4)
    pairs = [p for p in awkward() if p[0] not in (None, 10)] + [(500 + 300 * i, " ".join(words(i, r.randrange(5, 400), 2000))) for i in range(80)]
    got = {x.doc_id: x for x in fingerprints.fingerprints(docs(spark, pairs)).collect()}
    assert len(got) == len(pairs)
    ordered = sorted(pairs, key=lambda p: -p[0])
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if edited == text:
            assert got[i].fingerprint == got[i].edited_fingerprint and got[i].near_edited == 1
    assert got[0].fingerprint == got[2].fingerprint and got[7].fingerprint == got[8].fingerprint and got[4].fingerprint == got[5].fingerprint
    long = [x for x in got.values() if x.doc_id >= 500 and x.doc_id < 10**6]
    assert sum(x.near_edited for x in long) / len(long) > 0.2 > 0.02 > sum(x.near_next for x in long) / len(long)


def test_fingerprints_of_repeated_rows_and_few_rows(spark):
    rows = [(None, "a b"), (1, "one two"), (1, "one two"), (1, "other"), (None, None)]
    assert len(fingerprints.fingerprints(docs(spark, rows)).collect()) == 5
    one = fingerprints.fingerprints(docs(spark, [(3, "only row")])).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"only ron").hexdigest() and one.near_next == 1
    assert fingerprints.fingerprints(docs(spark, []).limit(0)).collect() == []


def brute_alignment(a, b):
    best = 0
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, above[j - 1] + (2 if x == y else -1), above[j] - 1, row[-1] - 1))
        best, above = max(best, *row), row
    return best / (2 * len(a))


def test_alignment_against_plain_dynamic_programming():
    rng = np.random.default_rng(0)
    for _ in range(30):
        item, windows = rng.integers(1, 6, 12).astype(np.uint64), rng.integers(1, 6, (5, 20)).astype(np.uint64)
        scores, _ = decontamination.align(item, windows)
        assert np.allclose(scores, [brute_alignment(list(item), list(w)) for w in windows])


def test_columns_of_test_words_are_those_of_single_texts():
    """Words of many texts at once, and the n-grams found there: none goes over the end of a text."""
    edges = decontamination.EDGES
    texts = ["a (B) -- c. d\x0b\"e\"", None, "", "...", "x", "a b", "c d e", "_a b_ c\u00a0d, " + "w" * 70 + "!", " . a.b "]
    plain = [[w for w in (x.strip(edges) for x in word_helpers.words(t)) if w] for t in texts]
    for skip in (0, 3):
        hashes, bounds = decontamination.word_hashes(pa.array(texts, pa.string()).slice(skip))
        assert list(np.diff(bounds)) == [len(w) for w in plain[skip:]]
        named = {}
        for word, code in zip((w for ws in plain[skip:] for w in ws), hashes.tolist()):
            assert named.setdefault(word, code) == code
        assert len(set(named.values())) == len(named)
    block = decontamination.Block([(1, "a b c"), (2, "X!"), (3, "...")], 3)
    text, at, _ = block.found(*decontamination.word_hashes(pa.array(texts, pa.string())))
    assert sorted(zip(text.tolist(), at.tolist())) == [(0, 0), (4, 0)]


def test_decontamination(spark):
    items = [(i, " ".join(words(1000 + i, 25, 5000))) for i in range(20)] + [(50, None), (51, ""), (52, "tiny-one tiny-two"), (None, " ".join(words(77, 30, 5000)))]
    pairs = awkward() + [(100 + i, " ".join(words(i, 80, 5000))) for i in range(40)]
    caught = set()
    for i in range(20):
        w = items[i][1].split()
        if i % 3 == 1:
            w[5], w[15] = "changed", "words"
        if i % 3 == 2:
            w = w[:7] + w[8:18] + ["put", "in"] + w[18:]
        pairs.append((1000 + i, " ".join(words(i, 30, 5000) + w + words(i + 1, 20, 5000)).upper()))
        caught.add((1000 + i, i))
    pairs += [(2000, "before tiny-one, tiny-two. after"), (2001, items[-1][1])]
    frame = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    for block in (10**6, 60):
        got = decontamination.contaminated(docs(spark, pairs), frame, block_words=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == caught | {(2000, 52), (2001, None)}
        assert all(0.5 <= r.score <= 1 for r in got)
    assert decontamination.contaminated(docs(spark, []).limit(0), frame).collect() == []
    assert decontamination.contaminated(docs(spark, pairs), frame.limit(0)).collect() == []
