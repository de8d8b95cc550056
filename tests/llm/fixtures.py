"""Small tables with every awkward case, and helpers."""

import random

from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, line_no int, key string, term string"


_LETTERS = str.maketrans("0123456789", "abcdefghij")


def docs(spark, pairs):
    """``(doc_id, text)`` rows with the columns of documents and others whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", None if t is None else len(t), 0.5, "x", 1, "k", "t") for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return ["w" + str(r.randrange(vocabulary)).translate(_LETTERS) for _ in range(n)]


def awkward():
    base = words(1, 300)
    edited = base[:150] + ["new"] + base[151:]
    far = base[:100] + words(2, 200)
    return [
        (0, " ".join(base)), (1, " ".join(edited)), (2, " ".join(base)), (3, " ".join(far)), (4, None), (5, ""), (6, " \n\t"),
        (7, "one"), (8, "one"), (9, "One\ttwo"), (10, " ".join(words(3, 5000))), (10, " ".join(words(3, 5000))), (None, "no id at all"),
        (None, " ".join(base)), (11, "Ünïcödé 日本語 text " * 30), (12, "x" * 3000), (13, "a b " * 200), (2**40, " ".join(words(4, 80))),
        (14, "line one 17 of many\nshared tail of the page\n\nlast"), (-5, " ".join(words(5, 60))),
    ]


def collect(df):
    return [Row(**r.asDict()) for r in df.collect()]
