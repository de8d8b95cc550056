import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import awkward, docs, words

from quillspan.llm import collocations


def brute(pairs, longest, least, percent, top):
    """``(text, lang)`` rows by the definition, in plain Python."""
    counts, totals = {}, Counter()
    for text, lang in pairs:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            totals[lang] += len(w)
            for m in range(1, longest + 1):
                own.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def spread(seed):
    r = random.Random(seed)
    parts = ["new", "York", "city", "of", "the", "a", ".", ",", "!", "\n", "\t", "  ", "é", "日本", "\x1c", "it's", "\x0b", "New"]
    pairs = [(" ".join(r.choice(parts) for _ in range(r.randrange(60))), r.choice(["en", "de", None])) for _ in range(120)]
    return pairs + [(None, "en"), ("", None), (" \t\n", "xx"), ("of the " * 500, "en"), ("city " * 300, "de")]


@pytest.mark.parametrize("longest, least, percent, top", [(3, 10, 50, 2000), (2, 3, 50, 7), (5, 4, 80, 40)])
def test_collocations_against_counting_everything(spark, monkeypatch, longest, least, percent, top):
    monkeypatch.setattr(collocations, "PART_MASS", 500)  # many partitions
    pairs = spread(longest)
    rows = spark.createDataFrame([(t, g, "x", 1) for t, g in pairs], "text string, lang string, phrase string, n int").repartition(5)
    got = collocations.collocations(rows, longest, least, percent, top)
    assert sorted(map(tuple, got.collect())) == brute(pairs, longest, least, percent, top)


def test_collocations_of_awkward_rows(spark):
    pairs = awkward() + [(100 + i, " ".join(words(i, 300, 30))) for i in range(5)]
    got = collocations.collocations(docs(spark, pairs), least=3)
    assert sorted(map(tuple, got.collect())) == brute([(t, "en") for _, t in pairs], 3, 3, 50, 2000)
    assert collocations.collocations(docs(spark, []).limit(0)).collect() == []
    with pytest.raises(ValueError):
        collocations.collocations(docs(spark, pairs), longest=1)


def test_scores_are_exact_past_64_bits(spark):
    a, l, r = 5_000_000_000, 5_000_000_007, 5_000_000_011
    rows = [("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)]
    got = collocations._scored(spark.createDataFrame(rows, "lang string, size int, phrase string, n long")).first()
    assert (got.a, got.l, got.r, got.score) == (a, l, r, 10**6 * a * a // (l * r))


def test_a_very_long_text_is_cut_only_where_pieces_end(monkeypatch):
    raw = b"one two, three four. " * 50 + b"no end " * 40
    monkeypatch.setattr(collocations, "PORTION", 64)
    parts = list(collocations._portions(raw))
    assert b"".join(parts) == raw and len(parts) > 5
    assert [p for part in parts for p in collocations.pieces(part)] == collocations.pieces(raw)


@pytest.mark.parametrize("capacity", [1, 5, 40])
def test_merged_summaries_keep_every_frequent_key(capacity):
    rng = np.random.default_rng(capacity)
    parts = [np.concatenate([rng.zipf(1.3, 300) % 500, np.full(rng.integers(0, 40), 7)]).astype(np.uint32) for _ in range(12)]
    every = Counter(int(x) for p in parts for x in p)
    mass = sum(every.values())
    halves = [collocations.Summary(capacity), collocations.Summary(capacity)]
    for i, p in enumerate(parts):
        halves[i % 2].merge(*np.unique(p, return_counts=True))
    both = halves[0]
    both.merge(halves[1].keys, halves[1].counts, halves[1].lost)
    assert len(both.keys) <= capacity and both.lost * (capacity + 1) <= mass
    held = dict(zip(both.keys.tolist(), both.counts.tolist()))
    assert all(n - both.lost <= held.get(k, 0) <= n for k, n in every.items())
    assert {k for k, n in every.items() if n > mass // (capacity + 1)} <= set(both.may_reach(mass // (capacity + 1) + 1).tolist())


def test_distinct_grams_when_keys_would_not_fit():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 6, 2000).astype(np.uint32)
    for n_words in (5, 2**21, 2**31):  # the size of the vocabulary decides whether keys are renumbered
        for size, grams, counts in collocations.distinct_grams(ids, n_words, 4):
            expected = Counter(tuple(int(x) for x in ids[i : i + size]) for i in range(len(ids) - size + 1) if ids[i : i + size].all())
            assert Counter(dict(zip(map(tuple, grams.tolist()), counts.tolist()))) == expected
