import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import awkward, docs, words

from quillspan.llm import language_model, quality, toxicity
from quillspan.llm.labelled import training_rows


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def held(i, folds, fold):
    return i is None or zlib.crc32(str(i).encode()) % folds == fold


def test_language_model_counts_and_base(spark):
    pairs = awkward() + [(1000 + i, " ".join(words(i, 50, 60))) for i in range(60)]
    got = language_model.score_documents(docs(spark, pairs)).collect()
    assert len(got) == len(pairs)
    counts = Counter(w for i, t in pairs if not held(i, 7, 2) for w in tokens(t))
    n, v = counts.total(), len(counts)
    expected = sorted((str(i), held(i, 7, 2), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t in pairs for w in [tokens(t)])
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_language_model_adds_up_to_one(spark):
    """Probabilities of one-word texts and of the empty one: no more than 1 together, as longer texts have their share."""
    base = [(i, " ".join(words(i, 30, 12))) for i in range(30)]
    known = sorted({w for i, t in base if not held(i, 7, 2) for w in t.split()})
    probes = [i for i in range(10**6, 10**6 + 1000) if held(i, 7, 2)][: len(known) + 3]
    texts = ["", *known, "never-seen"]
    got = {r.doc_id: r.score for r in language_model.score_documents(docs(spark, base + list(zip(probes, texts)))).collect()}
    scores = [got[p] for p, _ in zip(probes, texts)]
    assert all(math.isfinite(s) and s < 0 for s in scores)
    assert 0 < sum(10**s for s in scores) <= 1


def test_language_model_passes_few_texts_at_a_time(spark, monkeypatch):
    sizes, write = [], language_model.settle

    def seen(table, name):
        def sized(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

        if name == "counts":
            sizes.extend(r.n for r in rows.mapInArrow(sized, "n long").collect())
        return write(table, name)

    monkeypatch.setattr(language_model, "settle", seen)
    rows = docs(spark, [(i, f"w{i} " * 30_000) for i in range(200)]).coalesce(1)
    got = language_model.score_documents(rows)
    assert len(sizes) > 1 and max(sizes) < 8 << 20
    assert [(r.n_tokens, r["count"]) for r in got.groupBy("n_tokens").count().collect()] == [(30_001, 200)]


def test_seats_follow_the_restaurant():
    rng = np.random.default_rng(0)
    customers = np.full(20000, 5)
    tables = language_model.seat(customers, np.full(20000, 0.7), 0.5, rng)
    # exact expectation by the sequential rule
    dist = {1: 1.0}
    for n in range(1, 5):
        new: dict = {}
        for t, p in dist.items():
            q = 0.7 / (0.7 + n - 0.5 * t)
            new[t] = new.get(t, 0) + p * (1 - q)
            new[t + 1] = new.get(t + 1, 0) + p * q
        dist = new
    assert abs(tables.mean() - sum(t * p for t, p in dist.items())) < 0.03
    assert (language_model.seat(np.array([0, 1, 10**7]), np.full(3, 0.5), 0.8, rng)[:2] == [0, 1]).all()


def test_language_model_empty(spark):
    assert language_model.score_documents(docs(spark, []).limit(0)).collect() == []


def labelled(spark, mark, n=400):
    pairs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = words(i, 60)
        if bad:
            text[i % 50] = mark
        pairs.append((i, " ".join(text)))
        labels.append((i, int(bad), int(not bad)))
    labels += [(1, None, None), (2, 7, 7), (None, 1, 1), (10**9, 1, 0)]
    return pairs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_held_out(spark):
    pairs, labels = labelled(spark, "vile-word")
    got = toxicity.toxicity(docs(spark, pairs + awkward()[4:7] + [(None, "text")]), labels, how=toxicity.Ftrl(l1=1.0)).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id > 6]
    assert len(test) > 50 and sum(r.predicted == (r.doc_id % 4 == 0) for r in test) / len(test) > 0.9
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in got)


def test_quality_held_out(spark):
    pairs, labels = labelled(spark, "!!!! " * 12)
    got = quality.quality(docs(spark, pairs + [(5000, None), (5001, ""), (None, "x")]), labels).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in test) / len(test) > 0.9


@pytest.mark.parametrize("score, without", [(toxicity.toxicity, 0.0), (quality.quality, 1.0)])
def test_no_labels_and_no_documents(spark, score, without):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r.score for r in score(docs(spark, awkward()), none).collect()} == {without}
    assert score(docs(spark, []).limit(0), none).collect() == []


def test_training_rows_are_bounded_and_not_held_out(spark):
    pairs, labels = labelled(spark, "vile")
    got = training_rows(docs(spark, pairs), labels, "toxic", 100).collect()
    assert len(got) == 100 and not any(held(r.doc_id, 5, 0) for r in got)


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality.train(x[:3000], y[:3000], quality.Gam(rounds=20, pairs=1))
    assert list(model["pairs"]) == [(0, 2)]
    assert ((quality.predict(model, x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
