from fixtures import awkward, docs, words

import corpus_pipeline
from quillspan.llm.queries import ORACLE, QUERIES


def write(spark, path, pairs, items=()):
    docs(spark, pairs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(t is not None and "!!" not in t), 0) for i, t in pairs if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    clean = [(i, " ".join(words(i, 70 + i, 4000))) for i in range(200)]
    junk = [(1000 + i, "BUY!! NOW!! " * (20 + i)) for i in range(60)]
    copies = [(2000 + i, clean[i][1] + " more") for i in range(10)]
    item = " ".join(words("item", 30, 4000))
    leaks = [(3000 + i, " ".join(words(9000 + i, 60, 4000)) + " " + item) for i in range(3)]
    path = f"file://{tmp_path}/all"
    write(spark, path, clean + junk + copies + leaks, [(1, item)])
    frame = spark.read.parquet(f"{path}/documents.parquet")
    columns, left = frame.columns, {r.doc_id for r in frame.collect()}
    gone = {"quality classifier": {i for i, _ in junk}, "line dedup": set(), "minhash near-dedup": {i for i, _ in copies}, "benchmark decontamination": {i for i, _ in leaks}}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, frame, path).write.parquet(f"{path}/{k}")
        frame = spark.read.parquet(f"{path}/{k}")
        after = {r.doc_id for r in frame.collect()}
        assert frame.columns == columns and left - after == gone[name], name
        left = after
    last = corpus_pipeline.STAGES[-1][1](spark, frame, path)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == left == {i for i, _ in clean}
    assert corpus_pipeline.run(spark, path).count() == last.count()


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    write(spark, f"file://{tmp_path}/odd", awkward())
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/odd").count() > 0
    write(spark, f"file://{tmp_path}/none", [])
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0


def test_rows_without_an_id_and_rows_of_one_id(spark, tmp_path):
    text = {i: " ".join(words(i, 70, 4000)) for i in range(12)}
    item = " ".join(words("item", 30, 4000))
    rows = [(None, text[0]), (None, text[1]), (None, text[2] + " " + item), (7, text[3]), (7, text[4]), (7, text[5] + " " + item), (None, text[6]), (8, text[6] + " more"), (9, text[7]), (9, text[7]), (None, None), (None, "")]
    path = f"file://{tmp_path}/ids"
    write(spark, path, rows, [(1, item)])
    frame = spark.read.parquet(f"{path}/documents.parquet")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.minhash(spark, frame, path).collect()), key=str)
    assert kept == sorted([r for r in rows if r != (None, text[6]) and r != (9, text[7])] + [(9, text[7])], key=str)
    clean = sorted(((r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, frame, path).collect()), key=str)
    assert clean == sorted([r for r in rows if item not in (r[1] or "")], key=str)


def test_every_operator_has_a_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13
    assert set(ORACLE) <= set(QUERIES)
