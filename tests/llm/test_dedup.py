import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures import awkward, docs, words

from quillspan.llm import anchors, line_dedup, near_dedup, substring_dedup, suffixes
from quillspan.llm import words as word_helpers
from quillspan.llm.components import components


def sets_of(pairs, size):
    out = {}
    for i, t in pairs:
        w = tuple((t or "").encode().lower().split())
        out[i] = {w[k : k + size] for k in range(max(1, len(w) - size + 1))} if w else set()
    return out


def brute_components(pairs, size, percent):
    sets = sets_of(pairs, size)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(n=120):
    """Families of copies: edits of edits, so that members of a family are linked only through others."""
    r, out = random.Random(5), []
    for family in range(6):
        texts = [words(family, 60 + 20 * family, 3000)]
        for _ in range(n // 6):
            t = list(r.choice(texts))
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                t[r.randrange(len(t))] = f"e{r.randrange(10**6)}"
            texts.append(t)
        out += [" ".join(t) for t in texts]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, size, percent):
    pairs = near_copies()
    got = near_dedup.near_duplicates(docs(spark, pairs), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(pairs, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_awkward(spark):
    got = near_dedup.near_duplicates(docs(spark, awkward())).collect()
    assert len(got) == len(awkward())
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert found[0] == (298, 0, True) and found[1][1:] == (0, False) and found[2][1:] == (0, False) and found[3][1:] == (3, True)
    assert found[4] == (0, 4, True) and found[5] == (0, 5, True) and found[6] == (0, 6, True)
    assert found[7] == (1, 7, True) and found[8] == (1, 7, False) and found[9] == (1, 9, True)
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert all(r.kept for r in got if r.doc_id in (None, 10))


def test_near_duplicates_empty(spark):
    assert near_dedup.near_duplicates(docs(spark, []).limit(0)).collect() == []


def edited_copies(n, length=150):
    """Copies of one text with one to six edits of three words each; the first ones, which lead the buckets, have ten."""
    r, text, out = random.Random(n), words(3, length, 3000), []
    for i in range(n):
        t = list(text)
        for _ in range(10 if i < 5 else r.choice([1, 2, 3, 4, 5, 6])):
            at = r.randrange(len(t) - 3)
            t[at : at + 3] = [f"e{r.randrange(10**6)}" for _ in range(3)]
        out.append(" ".join(t))
    return list(enumerate(out))


def test_few_pairs_of_a_large_family_are_compared(spark, monkeypatch):
    compared, candidates = [], near_dedup._candidates

    def counted(*args):
        compared.append(candidates(*args).count())
        return candidates(*args)

    monkeypatch.setattr(near_dedup, "_candidates", counted)
    for n in (100, 200):
        pairs = edited_copies(n)
        got = near_dedup.near_duplicates(docs(spark, pairs), 5, 80, 8, 2).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(pairs, 5, 80)
        assert 40 * compared[-1] <= n * n


def test_differences_to_the_consensus(spark):
    rows = [(0, k, k, 4, [10, 11, 20 + k], [1, 30] if k else [1]) for k in range(3)] + [(0, 3, 3, 4, [11], [])]
    members = spark.createDataFrame(rows, "centre long, node long, component long, n int, added array<long>, removed array<long>")
    got = {r.node: (r.n, sorted(r.added), sorted(r.removed), r.gap, r.room) for r in near_dedup._about_consensus(members, 80).collect()}
    # most have 10 and 11, and lack 1; 30 is missing in two of four only
    assert got == {0: (5, [20], [], 80, 100), 1: (5, [21], [30], 180, 100), 2: (5, [22], [30], 180, 100), 3: (5, [1], [10], 180, 100)}


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 140), r.randrange(100, 140)) for _ in range(25)] + [(200, 200), (None, 3), (5, 4)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and 200 not in got
    for a, b in links[61:86]:
        assert a == b or got[a] == got[b]


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(150):
        text = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 70)), 0).astype(np.int16)
        array = suffixes.suffix_array(text)
        assert list(array) == sorted(range(len(text)), key=lambda i: list(text[i:]))
        usable = np.arange(len(text)) < len(text) - 5
        shared = suffixes.common_prefixes(text, array, 5, usable)
        for a, b in zip(array[:-1], array[1:]):
            same = 0
            while same < 5 and usable[a] and usable[b] and text[a + same] == text[b + same]:
                same += 1
            assert shared[b] == same


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    shared = rng.integers(97, 100, 400).astype(np.uint8)
    found = []
    for side in range(2):
        raw = np.concatenate([rng.integers(97, 123, 300 + side).astype(np.uint8), shared, rng.integers(97, 123, 200).astype(np.uint8)])
        grams, _, starts, counts = anchors.anchors(raw)
        assert counts.sum() == len(raw) - anchors.WINDOW + 1
        each = np.repeat(grams, counts)
        found.append(each[300 + side : 300 + side + 351])
    assert (found[0] == found[1]).all()


def brute_removed(pairs):
    out, seen = {}, set()
    for key in sorted({2**63 - 1 if i is None else i for i, _ in pairs}):
        own = set()
        for i, t in pairs:
            if (2**63 - 1 if i is None else i) == key:
                b = (t or "").encode()
                gone = np.zeros(len(b), bool)
                for k in range(len(b) - 49):
                    own.add(b[k : k + 50])
                    gone[k : k + 50] |= b[k : k + 50] in seen
                runs = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].any())
                out.setdefault(i, []).append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
        seen |= own
    return out


def test_substring_dedup_against_all_windows(spark):
    r, pairs = random.Random(3), awkward()
    passage = "".join(r.choice("abc ") for _ in range(170))
    for i in range(40):
        parts = [passage[r.randrange(60) : 90 + r.randrange(80)] if r.random() < 0.5 else "".join(r.choice("abcdefgh ") for _ in range(r.randrange(80))) for _ in range(6)]
        pairs.append((100 + i, "".join(parts)))
    pairs += [(200, "z" * 49), (201, "z" * 50), (202, "z" * 70), (203, passage * 2), (204, passage[:120] * 2)]
    got: dict = {}
    for row in substring_dedup.remove_repeats(docs(spark, pairs)).collect():
        got.setdefault(row.doc_id, []).append(tuple(row)[1:])
    expected = brute_removed(pairs)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def test_substring_dedup_empty(spark):
    assert substring_dedup.remove_repeats(docs(spark, []).limit(0)).collect() == []


def test_line_dedup(spark):
    r = random.Random(9)
    prose = lambda: " ".join(words(r.random(), 9, 5000))
    pages = [(i, f"{prose()}\nCopyright {1990 + i} by the authors of page {i} all rights reserved\n\n{prose()}\n{prose()}") for i in range(12)]
    whole = "\n".join(prose() for _ in range(5))
    copies = [(100 + i, whole) for i in range(12)]
    odd = [(200, None), (201, ""), (202, "\n\n"), (None, "just a line"), (203, "same\nsame\nsame")]
    got = line_dedup.without_recurring_lines(docs(spark, pages + copies + odd)).collect()
    assert len(got) == 29
    texts = {i: t for i, t in pages}
    for row in got:
        if row.doc_id in texts:
            lines = texts[row.doc_id].split("\n")
            assert row["_dropped"] == [1] and row["_lines"] == 5 and row.text == "\n".join(lines[:1] + lines[2:])
        elif row.doc_id is not None and 100 <= row.doc_id < 112:
            assert row.text == whole and row["_dropped"] == []
        else:
            assert (row.doc_id, row.text) in odd and row["_dropped"] == []
    assert {r.doc_id: r["_lines"] for r in got if r.doc_id in (200, 201, 202)} == {200: 0, 201: 1, 202: 3}
    assert line_dedup.without_recurring_lines(docs(spark, []).limit(0)).collect() == []


def test_line_dedup_leaves_near_copies(spark):
    r = random.Random(10)
    prose = lambda: " ".join(words(r.random(), 9, 5000))
    whole, copies = [prose() for _ in range(10)], []
    for i in range(40):
        lines = list(whole)
        lines[i % 10] = prose()
        copies.append((i, "\n".join([*lines, "terms of use and privacy of the authors of this page"])))
    others = [(100 + i, "\n".join([prose(), prose(), "terms of use and privacy of the authors of this page"])) for i in range(4)]
    got = line_dedup.without_recurring_lines(docs(spark, copies + others)).collect()
    assert {r.doc_id: r["_dropped"] for r in got} == {i: [10] for i, _ in copies} | {i: [2] for i, _ in others}


def test_line_dedup_leaves_near_copies_of_few_long_lines(spark):
    r = random.Random(13)
    whole, copies = [words(r.random(), 70, 5000) for _ in range(3)], []
    for i in range(40):
        lines = [list(line) for line in whole]
        lines[i % 3].insert(r.randrange(70), f"new{r.random()}")
        copies.append((i, "\n".join(map(" ".join, lines))))
    got = line_dedup.without_recurring_lines(docs(spark, copies)).collect()
    assert [r.doc_id for r in got if r["_dropped"]] == []


def test_line_dedup_drops_whole_blocks(spark):
    r = random.Random(11)
    prose = lambda: " ".join(words(r.random(), 9, 5000))
    licence, footer = ([" ".join(words(r.random(), 8, 5000)) for _ in range(5)] for _ in range(2))
    middle = [(i, "\n".join([prose(), prose(), *licence, prose()])) for i in range(12)]
    end = [(100 + i, "\n".join([prose(), prose(), prose(), *footer])) for i in range(12)]
    start = [(200 + i, "\n".join([*footer[:2], prose(), prose()])) for i in range(12)]
    got = {r.doc_id: r["_dropped"] for r in line_dedup.without_recurring_lines(docs(spark, middle + end + start)).collect()}
    assert got == {i: [2, 3, 4, 5, 6] for i, _ in middle} | {i: [3, 4, 5, 6, 7] for i, _ in end} | {i: [0, 1] for i, _ in start}


def test_line_dedup_tells_copied_texts_apart(spark):
    """Every text has a near copy, and what all share is longer than a text; log lines come in any order."""
    r = random.Random(12)
    prose = lambda: " ".join(words(r.random(), 9, 5000))
    footer, logs, pairs = [prose() for _ in range(5)], [prose() for _ in range(60)], []
    for i in range(10):
        own = [prose() for _ in range(4)]
        pairs += [(2 * i, "\n".join([*own, *footer])), (2 * i + 1, "\n".join([*own, *footer, "ps"]))]
    runs = [(100 + i, "\n".join(r.sample(logs, 20))) for i in range(60)]
    got = {r.doc_id: r["_dropped"] for r in line_dedup.without_recurring_lines(docs(spark, pairs + runs)).collect()}
    assert all(got[i] == [4, 5, 6, 7, 8] for i, _ in pairs[::2]) and all(got[i][:5] == [4, 5, 6, 7, 8] for i, _ in pairs[1::2])
    assert all(got[i] == list(range(20)) for i, _ in runs)


def test_template_tree_generalises():
    tree = line_dedup.Templates(0.7)
    assert tree.place(1, "user a logged in from host b today now".split()) == 1
    assert tree.place(2, "user c logged in from host d today now".split()) == 1
    assert tree.place(3, "something else entirely here and there on that day".split()) == 3
    assert line_dedup.masked("id 17 ok") == ["id", "<*>", "ok"]


ODD = ["a", "B", "é", "\x1c", "\x1f", " ", "\t", "\n", "\x0b", "\r", "\x85", "İ", "9", "٣", "中", "  ", "word ", "\0", "\xa0", "abcdefgh" * 3, "x" * 70]


def odd_texts(n=1500):
    r = random.Random(5)
    plain = ["ab", " C", " ", "\n", "x y z", " é"]
    made = ["".join(r.choice(p) for _ in range(r.randrange(40))) for _ in range(n) for p in (ODD, plain)]
    return [None, "", " ", "\n\n", "x" * 64, "x" * 65, *made]


@pytest.mark.parametrize("skip", [0, 7])
def test_codes_of_whole_columns_are_those_of_words(skip):
    texts = odd_texts()
    codes, bounds = word_helpers.word_codes(pa.array(["z Z"] * skip + texts).slice(skip))
    seen = {}
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        found = word_helpers.words(text)
        assert len(found) == b - a
        assert all(seen.setdefault(w, c) == c for w, c in zip(found, codes[a:b].tolist()))
    assert len(set(seen.values())) == len(seen) and bounds[-1] == len(codes)


def test_distinct_runs_of_slices():
    texts = odd_texts(400)
    sets = sets_of(enumerate(texts), line_dedup.RUN)
    for runs, i in zip(line_dedup._word_runs(pa.array(["z"] * 3 + texts).slice(3)), sets):
        assert len(runs) == len(sets[i]) and (np.diff(runs.astype(object)) > 0).all()


def test_plain_lines_are_masked_like_others():
    texts = odd_texts()
    assert any(line_dedup._plain(pa.array(texts)))
    for text, plain in zip(texts, line_dedup._plain(pa.array(["1"] + texts).slice(1))):
        for line in (text or "").split("\n"):
            tokens = line_dedup.masked(line)
            found, n, first = line_dedup._tokens(line, plain, 3)
            assert (n, found) == (len(tokens), " ".join(tokens)) and (not n or first == tokens[:3])
