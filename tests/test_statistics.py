"""Counting, comparison and word pictures worked out by hand."""

import math
from dataclasses import replace

import pytest
from tiny import tiny

from quillspan import alt, any_token, gap, seq, tok
from quillspan.operators import catalogue, compare, relations, values
from quillspan.operators import count as stats
from quillspan.operators import match as m
from quillspan.operators.lemgrams import lemgram_count
from quillspan.sources.corpora import union

A = tok("word") == "a"


def table(df, *columns):
    return {tuple(r[c] for c in columns[:-1]) if len(columns) > 2 else r[columns[0]]: r[columns[-1]] for r in df.collect()}


def test_per_million(spark):
    c = tiny(spark, {"A": [[["a"] * 3 + ["b"] * 1497]]})
    counts = stats.with_relative(stats.count(m.find(c, A, keep=["word"])), c)
    assert [(r.absolute, r.relative) for r in counts.collect()] == [(3, 2000.0)]


def test_combined_uses_corpora_without_hits(spark):
    c = tiny(spark, {"A": [[["a"] * 2 + ["b"] * 998]], "B": [[["b"] * 3000]]})
    counts = stats.count(m.find(c, A, keep=["word"]))
    assert [r.relative for r in stats.combined(counts, c).collect()] == [500.0]
    sums = {r.corpus: (r.absolute, r.relative) for r in stats.sums(counts, c).collect()}
    assert sums == {"A": (2, 2000.0), "B": (0, 0.0), None: (2, 500.0)}


def test_split_top_and_empty_set(spark):
    c = tiny(spark, {"A": [[["a"]]]}, lex={"a": ["x", "y"]})
    found = m.find(c, A, keep=["lex"])
    assert table(stats.count(found, ["lex"], split=["lex"]), "lex", "absolute") == {"x": 1, "y": 1}
    assert table(stats.count(found, ["lex"], split=["lex"], top=["lex"]), "lex", "absolute") == {"x": 1}
    assert table(stats.count(found, ["lex"]), "lex", "absolute") == {"|x|y|": 1}
    c = tiny(spark, {"A": [[["a"]]]}, lex={"a": []})
    found = m.find(c, A, keep=["lex"])
    assert table(stats.count(found, ["lex"], split=["lex"]), "lex", "absolute") == {"": 1}
    assert table(stats.count(found, ["lex"]), "lex", "absolute") == {"|": 1}


def test_split_of_a_sequence_is_a_cross_product(spark):
    c = tiny(spark, {"A": [[["a", "q", "r"]]]}, lex={"a": ["a1", "a2"], "q": ["c"], "r": ["x:11", "y"]})
    found = m.find(c, seq(A, any_token(), any_token()), keep=["lex"])
    got = table(stats.count(found, ["lex"], split=["lex"], strip=["lex"]), "lex", "absolute")
    assert got == {"a1 c x": 1, "a1 c y": 1, "a2 c x": 1, "a2 c y": 1}


def test_split_sums_exceed_hits(spark):
    c = tiny(spark, {"A": [[["a", "b"]]]}, lex={"a": ["x", "y"]})
    counts = stats.count(m.find(c, A, keep=["lex"]), ["lex"], split=["lex"])
    assert {r.corpus: r.absolute for r in stats.sums(counts, c).collect()} == {"A": 2, None: 2}


def test_pages_of_frequencies(spark):
    c = tiny(spark, {"A": [[list("aabbbc")]], "B": [[list("cccc")]]})
    counts = stats.count_all(c)
    page = stats.frequency_page(stats.combined(counts, c), 0, 1)
    assert table(page, "word", "absolute") == {"c": 5, "b": 3}
    rest = {(r.corpus, r.word): r.absolute for r in stats.on_page(counts, page).collect()}
    assert rest == {("A", "b"): 3, ("A", "c"): 1, ("B", "c"): 4}


def test_relative_to_needs_the_grouping(spark):
    c = tiny(spark, {"A": [[["a"]]]})
    counts = stats.count(m.find(c, A, keep=["word"]))
    with pytest.raises(ValueError):
        stats.relative_to(counts, c, ["text_name"])


def test_counts_do_not_depend_on_partitions(spark):
    c = tiny(spark, {"A": [[list("abcab"), list("ab")]], "B": [[list("ba")]]})
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, stats.count(m.find(c, seq(A, gap(0, 1), any_token()), keep=["word"])).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def freqs(spark, rows):
    return spark.createDataFrame(rows, "word string, freq1 bigint, freq2 bigint")


def test_log_likelihood(spark):
    rows = compare.log_likelihood(freqs(spark, [("w", 10, 10), ("rest", 90, 90)])).collect()
    assert {r.word: (r.loglike, r.side) for r in rows} == {"w": (0.0, 2), "rest": (0.0, 2)}
    rows = compare.log_likelihood(freqs(spark, [("w", 20, 0), ("rest", 80, 100)])).collect()
    assert {r.word: r.loglike for r in rows}["w"] == -round(40 * math.log(2), 2)


def test_log_likelihood_changes_sign_with_the_sides(spark):
    rows = [("a", 3, 9), ("b", 7, 1), ("c", 0, 4), ("d", 5, 0)]
    one = table(compare.log_likelihood(freqs(spark, rows)), "word", "loglike")
    two = table(compare.log_likelihood(freqs(spark, [(w, y, x) for w, x, y in rows])), "word", "loglike")
    assert {w: -v for w, v in one.items()} == two


def test_strongest_per_side(spark):
    rows = [(f"w{i}", i, 0) for i in range(1, 9)] + [(f"v{i}", 0, i) for i in range(1, 9)]
    best = compare.strongest(compare.log_likelihood(freqs(spark, rows)), 2).collect()
    assert sorted(r.word for r in best) == ["v7", "v8", "w7", "w8"]


OCCURRENCES = (
    "corpus string, text_id bigint, sent_no int, headbase string, headword string, headpos string, rel string, "
    "depbase string, depword string, deppos string, depextra string, start int, end int"
)


def pair(head, dep, n=1, rel="OBJ", corpus="A"):
    return [(corpus, 0, i, head.lower(), head, "V", rel, dep.lower(), dep, "N", "", 5, 3) for i in range(n)]


def pictures(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, OCCURRENCES)
    relations.write_tables(df, str(tmp_path))
    return df, relations.read_tables(spark, str(tmp_path))


def test_mutual_information(spark, tmp_path):
    rows = pair("see", "cat", 4) + pair("eat", "cat", 4) + pair("eat", "fish", 8)
    _, tables = pictures(spark, rows, tmp_path)
    picture = relations.word_picture(relations.lookup(tables, "see")).collect()
    assert [(r.head, r.dep, r.freq, r.mi) for r in picture] == [("see", "cat", 4, 4 * math.log2(16 * 4 / (4 * 8)))]


def test_word_form_meets_base_forms(spark, tmp_path):
    _, tables = pictures(spark, pair("See", "Cats", 2) + pair("see", "cats", 1), tmp_path)
    form = relations.word_picture(relations.lookup(tables, "See")).collect()
    base = relations.word_picture(relations.lookup(tables, "see", lemgram=True)).collect()
    assert [(r.head, r.dep, r.freq) for r in form] == [("See", "cats", 2)]
    assert [(r.head, r.dep, r.freq) for r in base] == [("see", "cats", 3)]


def test_self_relation_counts_twice(spark, tmp_path):
    _, tables = pictures(spark, pair("go", "go", 3) + pair("go", "on", 1), tmp_path)
    twice = table(relations.word_picture(relations.lookup(tables, "go", lemgram=True)), "dep", "freq")
    once = table(relations.word_picture(relations.lookup(tables, "go", lemgram=True, distinct_self=True)), "dep", "freq")
    assert (twice["go"], once["go"]) == (6, 3)


def test_missing_base_form(spark):
    row = ("A", 0, 0, None, "Xyz", "N", "ATT", "big", "Big", "A", "", 1, 2)
    got = relations.relation_table(spark.createDataFrame([row], OCCURRENCES)).collect()
    flags = sorted((r.head, r.dep, r.bfhead, r.bfdep, r.wfhead, r.wfdep) for r in got)
    assert flags == [("Xyz", "Big", True, False, True, True), ("Xyz", "big", True, True, True, False)]


def test_relation_sentence_match(spark, tmp_path):
    df, tables = pictures(spark, pair("see", "cat"), tmp_path)
    asked = tables.by_head.filter("head = 'see' AND bfhead AND bfdep")
    found = relations.relation_sentences(df, asked)
    c = tiny(spark, {"A": [[list("abcdef")]]})
    line = relations.sentence_kwic(relations.sentence_page(found), c).collect()[0]
    assert (line.match_start, line.match_end) == (2, 5)  # start word 5, end word 3


def test_strongest_relations(spark, tmp_path):
    rows = [r for i in range(1, 6) for r in pair("see", f"d{i}", i)] + [r for i in range(1, 6) for r in pair("do", "see", i, rel=f"X{i}")]
    _, tables = pictures(spark, rows, tmp_path)
    picture = relations.word_picture(relations.lookup(tables, "see", lemgram=True))
    best = relations.strongest(picture, "see", lemgram=True, sort="freq", n=2).collect()
    assert sorted(r.dep for r in best if r.rel == "OBJ") == ["d4", "d5"]
    with pytest.raises(ValueError):
        relations.strongest(picture, "see", sort="length")


def test_values(spark):
    c = tiny(spark, {"A": [[["a", "b"]], [["a"]]], "B": [[["c"]]]}, lex={"a": ["x", "y"], "b": []}, names={("A", 0): "n1"})
    got = {(r.corpus, r.lex): r["count"] for r in values.attr_values(c, "lex", split=["lex"], with_count=True).collect()}
    assert got == {("A", "x"): 2, ("A", "y"): 2, ("B", "c"): 1}
    tree = values.attr_values(c, "text_name>word", with_count=True)
    assert {(r.corpus, r.text_name, r.word): r["count"] for r in tree.collect()} == {
        ("A", "n1", "a"): 1, ("A", "n1", "b"): 1, ("A", "", "a"): 1, ("B", "", "c"): 1,
    }
    assert sorted(r.word for r in values.merge_corpora(values.attr_values(c, "word")).collect()) == ["a", "b", "c"]
    with pytest.raises(KeyError):
        values.attr_values(c, "text_none")


def test_catalogue_and_access(spark):
    c = tiny(spark, {"A": [[["a", "b"]]], "B": [[["c"]], []]}, names={("A", 0): "n1"})
    assert [tuple(r) for r in catalogue.corpus_totals(c).collect()] == [(3, 2)]
    assert {(r.corpus, r.attr) for r in catalogue.attributes(c).collect() if r.kind == "s"} == {("A", "text_name")}
    protected = spark.createDataFrame([("b",)], "corpus string")
    assert {r.corpus: r.protected for r in catalogue.corpora_list(c, protected).collect()} == {"A": False, "B": True}
    assert catalogue.check_access("a,b", protected, protected) == ["A", "B"]
    with pytest.raises(PermissionError, match="B"):
        catalogue.check_access(["a", "b"], protected, spark.createDataFrame([], "corpus string"))


def test_lemgram_counts(spark):
    index = spark.createDataFrame([("A", "x", 1, 2, 4), ("B", "x", 8, 0, 0), ("A", "X", 5, 0, 0), ("A", "y", 0, 0, 3)], "corpus string, lemgram string, freq bigint, freq_prefix bigint, freq_suffix bigint")
    assert table(lemgram_count(index, ["x", "y"]), "lemgram", "freq") == {"x": 9}
    assert table(lemgram_count(index, ["x", "y"], ["a"], ["lemgram", "suffix"]), "lemgram", "freq") == {"x": 5, "y": 3}
    with pytest.raises(ValueError):
        lemgram_count(index, ["x"], count=["infix"])


def test_ngrams_with_blanks_inside_words_stay_apart(spark):
    c = tiny(spark, {"A": [[["a b", "c"]], [["a", "b c"]]]})
    found = m.find(c, seq(any_token(), any_token()), keep=["word"])
    assert {r.word: r.absolute for r in stats.count(found, ["word"]).collect()} == {r"a\ b c": 1, r"a b\ c": 1}


def test_pages_and_levels_of_each_query(spark):
    rows = [("A", q, w, n) for q, counts in enumerate(({"x": 3, "y": 2}, {"x": 5})) for w, n in counts.items()]
    counts = spark.createDataFrame(rows, "corpus string, query_no int, word string, absolute long")
    info = tiny(spark, {"A": [[["x"]]]})
    sums = {(r.query_no, r.absolute) for r in stats.statistics(counts, info).filter("level = 'corpus sum'").collect()}
    assert sums == {(0, 5), (1, 5)}
    assert sorted((r.query_no, r.word) for r in stats.frequency_page(counts.drop("corpus"), 0, 0).collect()) == [(0, "x"), (1, "x")]


def test_tokens_of_a_corpus_without_the_attribute(spark):
    first, second = tiny(spark, {"A": [[["a", "b"]]]}), tiny(spark, {"E": [[["a", "c"]]]})
    second = replace(second, sentences=second.sentences.drop("pos"), attrs=("word", "lex"))
    both = union(first, second)
    assert {(r.corpus, r.pos): r.absolute for r in stats.count_all(both, ["pos"]).collect()} == {("A", "L"): 2, ("E", None): 2}
    found = m.find(both, seq((tok("pos") == "Z") | (tok("word") == "a")))
    assert sorted(r.corpus for r in found.collect()) == ["A", "E"]
    found = m.find(both, seq((tok("pos") == "Z") | (tok("word") == "a")), within="text", block=2)
    assert sorted(r.corpus for r in found.collect()) == ["A", "E"]


def test_every_combination_of_values_is_counted(spark):
    from itertools import product

    lex = {"a": ["1", "2"], "b": [], "c": ["x y", "z\\"], "d": ["1"]}
    content = {"A": [[list("abcd")], [list("abcd")], [list("ca")], [list("c")]], "B": [[list("bca")]]}
    c = tiny(spark, content, lex=lex)
    pattern = seq(any_token(), gap(0, 1))
    expected = {}
    for name, texts in content.items():
        for words in (s for t in texts for s in t):
            for i in range(len(words)):
                for combination in product(*[lex[w] or [""] for w in words[i : i + 1]]):
                    expected[name, combination[0]] = expected.get((name, combination[0]), 0) + 1
    one = {(r.corpus, r.lex): r.absolute for r in stats.count(m.find(c, pattern, keep=["lex"]), ["lex"], split=["lex"]).collect()}
    assert one == expected
    expected = {}
    for name, texts in content.items():
        for words in (s for t in texts for s in t):
            for size in (2, 3):
                for i in range(len(words) - size + 1):
                    if words[i] == "b" and size == 3 or words[i] == "c" and size == 2:
                        for combination in product(*[lex[w] or [""] for w in words[i : i + size]]):
                            key = (name, " ".join(v.replace("\\", "\\\\").replace(" ", "\\ ") for v in combination), "|".join(words[i : i + size]).upper())
                            expected[key] = expected.get(key, 0) + 1
    found = m.find(c, seq(alt(seq(tok("word") == "b", gap(2)), seq(tok("word") == "c", gap(1)))), keep=["lex", "word"])
    got = stats.count(found, ["lex", "word"], split=["lex"])
    assert {(r.corpus, r.lex, r.word.replace(" ", "|").upper()): r.absolute for r in got.collect()} == expected
    assert got.count() == stats.count(found, ["lex", "word"], split=["lex"], longest=7).count()


def test_denied_corpora(spark):
    from quillspan.operators import catalogue

    frames = [spark.createDataFrame([(n,) for n in names], "corpus string") for names in (["a", "b", "C"], ["B", "c", "d"], ["c"])]
    assert [r.corpus for r in catalogue.denied(*frames).collect()] == ["B"]


def test_postings_give_the_same_sentences_as_all_occurrences(spark, tmp_path):
    from quillspan.operators import relations

    rows = [("A", 1, 0, "Run", "run", "V", "R1", "dogs", "dog", "N", "", 1, 2), ("A", 1, 0, "run", None, "V", "R1", "dogs", "dog", None, "", 2, 3), ("B", 7, 1, "runs", "run", "V", "R2", "dog", None, "N", "x", 4, 1)]
    schema = "corpus string, text_id long, sent_no int, headword string, headbase string, headpos string, rel string, depword string, depbase string, deppos string, depextra string, start int, end int"
    occurrences = spark.createDataFrame(rows * 2, schema)
    relations.write_tables(occurrences, str(tmp_path))
    pictures = relations.read_tables(spark, str(tmp_path))
    table = relations.relation_table(occurrences)
    assert sorted(map(str, table.collect())) == sorted(map(str, relations.forms(occurrences).groupBy(*relations.TRIPLE).count().withColumnRenamed("count", "freq").collect()))
    assert sum(r.freq for r in table.collect()) == 2 * (3 + 2 + 2)
    plain = relations.relation_sentences(occurrences, table)
    stored = relations.relation_sentences(pictures.postings, table)
    assert sorted(map(str, plain.collect())) == sorted(map(str, stored.collect())) and plain.count() == 14
    one = relations.relation_sentences(pictures.postings, table.filter("head = 'Run'")).collect()
    assert [(r.corpus, r.text_id, r.start, r.end) for r in one] == [("A", 1, 1, 2)] * 2
    found = relations.lookup(pictures, "run", lemgram=True).collect()
    assert {(r["head"], r.dep, r.freq, r.head_rel_freq, r.dep_rel_freq, r.rel_freq) for r in found} == {("run", "dog", 2, 4, 2, 4), ("run", "dog", 2, 2, 2, 2)}


def test_conversations_of_any_numbers(spark, tmp_path):
    from quillspan.operators import alignment
    from quillspan.sources import corpora as source

    rows = [(None, 0, "user", "The one"), (2**40, 0, "user", "The two. And"), (2**40, 1, "assistant", "Said. More"), (2**40, None, "user", "x"), (-3, 7, "system", "Rule"), (-3, 8, None, "who"), (2**40, 0, "user", "__UNDEF__")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    c = source.prepare(spark, str(tmp_path), "conversation")
    sizes = {r.corpus: (r.texts, r.size) for r in c.info.collect()}
    assert sizes == {"CONV-USER": (4, 6), "CONV-ASSISTANT": (1, 2), "CONV-SYSTEM": (1, 1), "CONV-UNKNOWN": (1, 1)}
    links = alignment.by_sentence_order(c.select("CONV-USER"), c.select("CONV-ASSISTANT")).collect()
    assert len(links) == 2
    kinds = sorted((r.kind, r.corpus, r.value) for r in c.regions.filter("kind = 'conversation'").collect())
    assert kinds == [("conversation", "CONV-ASSISTANT", str(2**40)), ("conversation", "CONV-SYSTEM", "-3"), ("conversation", "CONV-UNKNOWN", "-3"), ("conversation", "CONV-USER", str(2**40))]


def test_sentences_are_written_in_order_without_a_sort_of_their_attributes(spark, tmp_path, monkeypatch):
    from quillspan.sources import corpora as source

    texts = [("B" if i % 3 else "A", i, f"One tWo{i}. Three\nÉte 4 {'and more. ' * (i % 5)}") for i in range(40, 0, -1)]
    df = spark.createDataFrame(texts, "corpus string, text_id long, text string").repartition(3)
    rows = source.annotate_words(source.tokenise(source._by_text(df)))
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before, seen = spark.conf.get(setting), []
    monkeypatch.setattr(source, "neighbour_words", lambda s, t: seen.append(spark.conf.get(setting)) or t.select("corpus", "text_id"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.index("Sort [") > plan.rindex("Generate")  # below all that makes rows larger
    source.write(spark, rows, df.drop("text"), str(tmp_path / "c"))
    assert seen == [before] and spark.conf.get(setting) == before
    from pyspark.sql import functions as F

    got = spark.read.parquet(str(tmp_path / "c" / "sentences")).withColumn("f", F.input_file_name()).withColumn("i", F.monotonically_increasing_id())
    files = {}
    for r in sorted(got.collect(), key=lambda r: r.i):
        files.setdefault(r.f, []).append((r.corpus, r.text_id, r.sent_no))
    assert sum(map(len, files.values())) == rows.count() and all(x == sorted(x) for x in files.values())
    words = {r.text_id: (r.word, r.lemma, r.pos, r.sense, r.lex) for r in got.filter("sent_no = 1").collect()}
    assert words[3] == (["Three"], ["three"], ["CAP"], ["three:5"], [["three", "thr"]])
    line = got.filter("sent_no = 2 AND text_id = 5").first()
    assert (line.word, line.lemma, line.pos, line.sense, line.lex) == (["Éte", "4"], ["éte", "4"], ["CAP", "NUM"], ["éte:3", None], [["éte"], []])


def test_equal_occurrences_are_counted_before_they_take_forms(spark):
    columns = "corpus string, headbase string, headword string, headpos string, rel string, depbase string, depword string, deppos string, depextra string"
    kinds = [("A", "a", "A", "P", "R", "b", "b", None, ""), ("A", None, "a", "P", "R", "b", "B", "Q", ""), ("A", "a", "a", "P", "R", None, "b", None, ""), ("A", "c", "A", "P", "R", "b", "b", None, "")]
    rows = spark.createDataFrame([k for i, k in enumerate(kinds) for _ in range(i + 1)], columns)
    table = relations.relation_table(rows)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.rindex("Generate")  # one below the forms
    assert sorted(map(str, table.collect())) == sorted(map(str, relations.relation_table(rows, ordered=True).collect()))
    assert sum(r.freq for r in table.collect()) == 3 * 1 + 2 * 2 + 2 * 3 + 3 * 4


def test_postings_are_shuffled_without_copies_of_their_base_forms(spark, tmp_path, monkeypatch):
    columns = "corpus string, text_id long, sent_no int, headbase string, headword string, headpos string, start int, rel string, depbase string, depword string, deppos string, end int, depextra string"
    rows = spark.createDataFrame([("A", 1, 0, "b", "B", "P", 1, "R", None, "d", "P", 2, ""), ("A", 1, 1, None, "a", "P", 1, "R", "c", "C", "P", 2, "")], columns)
    kind, seen = type(rows), []
    shuffle = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda df, *by: seen.append(df.columns) or shuffle(df, *by))
    relations.write_tables(rows, str(tmp_path / "w"))
    assert seen[0] == rows.columns
    got = relations.read_tables(spark, str(tmp_path / "w")).postings.select("headkey", "depkey", "headbase", "depbase").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("b", "d", "b", None), ("a", "c", None, "c")], key=str)


def test_words_that_are_their_own_base_form_are_shuffled_once(spark, tmp_path, monkeypatch):
    columns = "corpus string, text_id long, sent_no int, headbase string, headword string, headpos string, start int, rel string, depbase string, depword string, deppos string, end int, depextra string"
    words = [("a", "a"), ("a", "A"), (None, "a"), ("a", None), ("\0", "a"), ("a", "\0"), ("a", "\0x"), (None, None), ("", "a"), ("a", "")]
    rows = [("A", i, j, *head, "P", 1, "R", *dep, None, 2, "") for i, head in enumerate(words) for j, dep in enumerate(words)]
    occurrences = spark.createDataFrame(rows, columns)
    kind, seen = type(occurrences), []
    shuffle = kind.repartitionByRange

    def counted(df, *by):
        seen.append(df)
        return shuffle(df, *by)

    monkeypatch.setattr(kind, "repartitionByRange", counted)
    relations.write_tables(occurrences, str(tmp_path / "w"))
    sent = seen[0].select("headword", "depword").collect()
    assert sum(w is None for r in sent for w in r) == 2 * 20  # equal to the base form, or both missing
    pictures = relations.read_tables(spark, str(tmp_path / "w"))
    assert sorted(map(str, pictures.postings.select(*occurrences.columns).collect())) == sorted(map(str, occurrences.collect()))
    table = relations.forms(occurrences).groupBy(*relations.TRIPLE).count().withColumnRenamed("count", "freq")
    for got, kept in ((pictures.by_head, "bfhead AND bfdep OR wfhead"), (pictures.by_dep, "bfhead AND bfdep OR wfdep")):
        assert sorted(map(str, got.collect())) == sorted(map(str, table.filter(kept).collect()))
    assert sorted(map(str, pictures.head_rel.collect())) == sorted(map(str, relations.head_rel_freq(table).collect()))
    assert sorted(map(str, pictures.dep_rel.collect())) == sorted(map(str, relations.dep_rel_freq(table).collect()))
    plain = spark.createDataFrame([("A", 0, i, "a", "a", "P", 1, "R", "b", "b", None, 2, "") for i in range(9)], columns)
    seen.clear()
    relations.write_tables(plain, str(tmp_path / "p"))
    assert [df.count() for df in seen[1:3]] == [1, 1]  # one row of triples, whatever the number of its forms


def test_equal_tokens_are_added_up_before_they_take_lemgrams(spark):
    from pyspark.sql import functions as F

    from quillspan.operators import lemgrams

    tokens = [("A", 1, 0, 0, i, "on", ["on", "on"]) for i in range(5)] + [("A", 2, 0, 0, 0, "on", ["in"]), ("A", 2, 0, 0, 1, None, []), ("B", 1, 0, 0, 0, "on", ["on"])]
    rows = spark.createDataFrame(tokens, "corpus string, text_id long, sent_no int, sent_off long, i int, lemma string, lex array<string>")
    none = F.array().cast("array<string>")
    index = lemgrams.lemgram_index(rows, F.col("lex"), F.when(F.col("lemma") == "on", F.array("lemma")).otherwise(none), none)
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.rindex("Generate")  # one below the entries
    assert sorted(map(tuple, index.collect())) == [("A", "in", 1, 0, 0), ("A", "on", 10, 6, 0), ("B", "on", 1, 1, 0)]
    assert index.dtypes[2:] == [("freq", "bigint"), ("freq_prefix", "bigint"), ("freq_suffix", "bigint")]


def test_triples_are_stored_with_the_number_of_each_form(spark, tmp_path, monkeypatch):
    rows = [r for i in range(20) for r in pair(f"h{i}", f"d{i % 3}", i + 1) + pair("See", f"d{i}", 2)]
    occurrences = spark.createDataFrame(rows, OCCURRENCES)
    kind, seen = type(occurrences), []
    shuffle = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda df, *by: seen.append(df.columns) or shuffle(df, *by))
    relations.write_tables(occurrences, str(tmp_path))
    assert len(seen) == 3 and not any({"head", "dep"} <= set(columns) for columns in seen)  # triples go through no shuffle but that of their count
    assert spark.read.parquet(f"{tmp_path}/by_head").count() == 20 + 2 * 20
    tables = relations.read_tables(spark, str(tmp_path))
    want = relations.forms(occurrences).groupBy(*relations.TRIPLE).count().withColumnRenamed("count", "freq")
    assert sorted(map(str, tables.by_head.collect())) == sorted(map(str, want.filter("bfhead AND bfdep OR wfhead").collect()))
    plan = tables.by_head.filter("head = 'See'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(head,See)" in plan  # only its pages are read
