"""Pages, context, sort orders and marks."""

import pytest
from pyspark.sql import functions as F
from tiny import tiny

from quillspan import seq, tok
from quillspan.operators import kwic
from quillspan.operators import match as m
from quillspan.operators import paging
from quillspan.sources.corpora import parse_corpora

A = tok("word") == "a"


@pytest.fixture(scope="module")
def corpora(spark):
    return tiny(
        spark,
        {
            "A": [[list("xab"), list("ca")], [], [list("a")]],
            "B": [[list("aaa")], [list("qa")]],
        },
    )


def places(page):
    return [(r.row, r.corpus, r.position) for r in page.orderBy("row").collect()]


def test_page_runs_over_corpora(corpora):
    found = m.find(corpora, A)
    want = [(2, "A", 5), (3, "B", 0), (4, "B", 1)]
    assert places(kwic.kwic_page(found, corpora, 2, 4)) == want
    assert places(kwic.page_by_hits(found, corpora, m.hits_per_corpus(found, corpora), 2, 4)) == want


def test_pages_by_counting(corpora, monkeypatch):
    found = m.find(corpora, A)
    near = [places(kwic.kwic_page(found, corpora, a, b)) for a, b in ((0, 2), (2, 4), (3, 5), (5, 9), (20, 30))]
    monkeypatch.setattr(kwic, "NEAR", 0)
    assert [places(kwic.kwic_page(found, corpora, a, b)) for a, b in ((0, 2), (2, 4), (3, 5), (5, 9), (20, 30))] == near
    hits = m.hits_per_corpus(found, corpora)
    assert [places(kwic.page_by_hits(found, corpora, hits, a, b)) for a, b in ((0, 2), (2, 4), (3, 5), (5, 9), (20, 30))] == near
    assert kwic.page_by_hits(found, corpora, hits, 0, 1500, max_rows=2000).count() == found.count()


def test_only_row_groups_near_the_texts_are_read():
    from quillspan.sources.corpora import RANGES, _ranges

    assert _ranges([5, 1, 2, 9]) == [(1, 1), (2, 2), (5, 5), (9, 9)]
    ids = [*range(0, 1000, 10), 5000, 5001]
    got = _ranges(ids)
    assert len(got) == RANGES and all(any(a <= i <= b for a, b in got) for i in ids) and not any(a <= 3000 <= b for a, b in got)


def test_ranks_by_file_equal_ranks_by_group(spark, monkeypatch):
    df = spark.range(0, 500, numPartitions=7).selectExpr("id", "id % 7 AS k", "id % 3 AS g")
    order = [F.col("k").desc(), F.col("id").asc()]
    near = sorted(map(tuple, paging.ranked(df, ["g"], order, 40).collect()))
    monkeypatch.setattr(paging, "FEW", 0)
    assert sorted(map(tuple, paging.ranked(df, ["g"], order, 40).collect())) == near and len(near) == 123
    assert paging.ranked(df, ["g"], order, -1).count() == 500


def test_corpora_on_page(spark):
    hits = spark.createDataFrame([("A", 3), ("B", 4), ("C", 0), ("D", 2)], "corpus string, hits bigint")
    got = sorted((r.corpus, r["first"], r["last"]) for r in paging.corpora_on_page(hits, 2, 7).collect())
    assert got == [("A", 2, 2), ("B", 0, 3), ("D", 0, 0)]


def test_deep_page_equals_near_page(spark, monkeypatch):
    df = spark.range(0, 500, numPartitions=7).selectExpr("id", "id % 7 AS k")
    order = [F.col("k").desc(), F.col("id").asc()]
    near = paging.page(df, order, 100, 160).collect()
    monkeypatch.setattr(paging, "NEAR", 10)
    deep = paging.page(df, order, 100, 160).collect()
    assert sorted(deep) == sorted(near)
    assert len(paging.page(df, order, 490, -1).collect()) == 10


def test_row_cap_and_bad_pages(corpora):
    with pytest.raises(ValueError):
        kwic.kwic_page(m.find(corpora, A), corpora, 0, 1000)
    with pytest.raises(ValueError):
        kwic.kwic_page(m.find(corpora, A), corpora, 0, 9, max_rows=9)
    with pytest.raises(ValueError):
        kwic.sample(m.find(corpora, A), corpora, 10**6)
    with pytest.raises(ValueError):
        paging.page(corpora.texts, [], 5, 2)


def line(corpora, rows):
    out = kwic.line_text(rows).orderBy("row").collect()
    return [(r.left, r.keyword, r.right, r.start, r.end) for r in out]


def test_words_cross_sentences_and_texts(corpora):
    page = kwic.kwic_page(m.find(corpora, A), corpora, 1, 2)
    assert line(corpora, kwic.context_words(page, corpora, 2, 2)) == [("b c", "a", "a", 2, 3), ("c a", "a", "", 2, 3)]


def test_sentence_context(corpora):
    page = kwic.kwic_page(m.find(corpora, seq(A, tok("word") == "b")), corpora)
    assert line(corpora, kwic.context_sentences(page, corpora)) == [("x", "a b", "", 1, 3)]
    assert line(corpora, kwic.context_sentences(page, corpora, 1)) == [("x", "a b", "c a", 1, 3)]


def test_context_by_corpus(corpora):
    page = kwic.kwic_page(m.find(corpora, A), corpora, 0, 3)
    rows = kwic.context_by_corpus(page, corpora, {"b": "1 sentence", "a": ("1 words", "0 words")})
    assert line(corpora, rows) == [("x", "a", "", 1, 2), ("c", "a", "", 1, 2), ("a", "a", "", 1, 2), ("", "a", "a a", 0, 1)]
    with pytest.raises(ValueError):
        kwic.context_by_corpus(page, corpora, {}, "many words")


def short_texts():
    import random

    rng = random.Random(3)
    return {c: [[[rng.choice("abc") for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(0, 2))] for _ in range(25)] for c in "AB"}


@pytest.mark.parametrize("sort", ["left", "right"])
@pytest.mark.parametrize("within, block, pattern, size", [
    ("sentence", 4096, seq(A), 1),
    ("text", 2, seq(A, tok("word") == "b"), 2),
    ("text", 4096, seq(A, tok("word") == "b"), 2),
    ("line", 2, seq(A, tok("word") == "b"), 2),
    (None, 2, seq(A, tok("word") == "b"), 2),
    (None, 4096, seq(A, tok("word") == "b"), 2),
    ("page", 4096, seq(A, tok("word") == "b"), 2),
])
def test_sort_by_neighbours_across_texts(spark, sort, within, block, pattern, size):
    words = short_texts()
    flat = {c: [w for t in texts for s in t for w in s] for c, texts in words.items()}
    ends = {c: [sum(len(s) for t in texts[: k + 1] for s in t) for k in range(len(texts))] for c, texts in words.items()}
    text_of = {c: [next(k for k, e in enumerate(ends[c]) if i < e) for i in range(len(flat[c]))] for c in words}
    lines = [(c, i, i + 1) for c in words for i in range(0, len(flat[c]) - 1, 3) if text_of[c][i] == text_of[c][i + 1]]
    pages = [(c, i, min(i + 6, len(flat[c]) - 1)) for c in words for i in range(0, len(flat[c]), 7)]
    c = tiny(spark, words, inside={"line": lines}, across={"page": pages})
    unit = {
        "text": lambda n, i: text_of[n][i],
        "line": lambda n, i: next((x for x in lines if x[0] == n and x[1] <= i <= x[2]), (n, i)),
        "page": lambda n, i: i // 7,
    }.get(within, lambda n, i: 0)
    want = []
    for n, f in flat.items():
        for i in range(len(f) - size + 1):
            if f[i : i + size] == ["a", "b"][:size] and unit(n, i) == unit(n, i + size - 1):
                at = [i - 1, i - 2, i - 3] if sort == "left" else [i + size, i + size + 1, i + size + 2]
                want.append((n, [f[j] if 0 <= j < len(f) else "" for j in at], i))
    want = [(n, p) for n, _, p in sorted(want)]
    page = kwic.kwic_page(m.find(c, pattern, within, keep=kwic.needed_for_sort(sort), block=block), c, 0, len(want) - 1, sort=sort)
    assert [x[1:] for x in places(page)] == want


def test_right_sort_of_the_last_words_of_a_text(spark):
    c = tiny(spark, {"A": [[["x", "g", "h"]], [["d", "e"]], [["x", "q"], ["r", "d"]]]})
    page = kwic.kwic_page(m.find(c, seq(tok("word") == "g", tok("word") == "h"), "text", keep=kwic.needed_for_sort("right")), c, sort="right")
    assert places(page) == [(0, "A", 1)]
    rows = kwic.sorted_matches(m.find(c, seq(tok("word") == "x", tok("word") == "g"), "text", keep=kwic.needed_for_sort("right")), c, "right", "", None)
    assert rows.first()["_sort"] == ["h", "d", "e"]


def test_matches_keep_the_side_of_the_words_around_that_is_asked_for(spark):
    c = tiny(spark, {"A": [[["x", "a"], ["b", "y"]]], "B": [[["c"]]]})
    for within in ("text", {"": "sentence", "A": "text"}, None):
        for side, want in (("words_before", ["x"]), ("words_after", ["y"])):
            found = m.find(c, seq(A, tok("word") == "b"), within, keep=[side])
            assert [r[side] for r in found.collect()] == [want]
            assert {"words_before", "words_after", "word"} & set(found.columns) == {side}


def test_words_next_to_texts_that_are_kept_with_them(spark, tmp_path):
    from quillspan.sources import corpora as source

    c = tiny(spark, short_texts())
    path = str(tmp_path)
    texts = c.texts.select("corpus", "text_id", "text_name")
    source.write(spark, c.sentences.drop("text_name"), texts, path)
    kept = source.read(spark, path, c.attrs, c.structs)
    one, two = ({(r.corpus, r.text_id): (r.before_words, r.after_words) for r in x.neighbours().collect()} for x in (c, kept))
    assert one == two and any(len(b) == 3 for b, _ in one.values())


def test_collation(spark):
    words = ["ö", "z", "ä", "a", "å", "Z"]
    c = tiny(spark, {"A": [[[w] for w in words]]})
    page = kwic.kwic_page(m.find(c, tok("word").matches(".*"), keep=["word"]), c, sort="keyword", collation="sv")
    assert [words[p] for _, _, p in places(page)] == ["a", "z", "Z", "å", "ä", "ö"]


def test_random_order_is_reproducible(corpora):
    found = m.find(corpora, A)
    one, two = (places(kwic.kwic_page(found.repartition(n), corpora, sort="random", seed="1")) for n in (1, 5))
    assert one == two
    assert one != places(kwic.kwic_page(found, corpora, sort="random", seed="2"))


def test_sample_is_from_one_corpus(corpora):
    rows = kwic.sample(m.find(corpora, A), corpora, 10, seed="5").collect()
    assert len({r.corpus for r in rows}) == 1 and len(rows) in (3, 4)


def test_marks(corpora):
    page = kwic.kwic_page(m.find(corpora, seq(tok("word") == "c", A)), corpora)
    got = [(r.word, r.open, r.close) for r in kwic.open_close(page, corpora).orderBy("i").collect()]
    assert got == [("c", ["sentence"], []), ("a", [], ["sentence", "text"])]
    page = kwic.kwic_page(m.find(corpora, tok("word") == "x"), corpora)
    assert kwic.open_close(page, corpora).orderBy("i").first().open == ["text", "sentence"]


def test_unknown_attributes_are_ignored_for_display(corpora):
    page = kwic.kwic_page(m.find(corpora, A), corpora, 0, 0)
    tokens = kwic.context_words(page, corpora, 1, 0, show=["pos", "nothing"]).first().tokens
    assert [t.asDict() for t in tokens] == [{"word": "x", "pos": "L"}, {"word": "a", "pos": "L"}]
    assert "nothing" not in kwic.with_structs(page, corpora, ["nothing", "text_name"]).columns


def test_corpus_names():
    assert parse_corpora("b,a,B") == ["A", "B"]


def test_matches_of_any_region_have_lines_marks_and_cuts(spark):
    c = tiny(spark, {"A": [[["a", "b"], ["c", "d"], ["e", "f"]], [["a", "x"]]]}, names={("A", 0): "one", ("A", 1): "two"})
    crossing = seq(tok("word") == "d", tok("word") == "e")
    for within in ("text", None):
        page = kwic.kwic_page(m.find(c, crossing, within=within, keep=["text_name"]), c)
        row = kwic.context_sentences(page, c).collect()[0]
        assert [t.word for t in row.tokens] == ["c", "d", "e", "f"] and (row.start, row.end, row.position, row.text_name) == (1, 3, 3, "one")
        marks = kwic.open_close(page, c).collect()
        assert {r.word for r in marks if r.in_match} == {"d", "e"} and len(marks) == 4
    over = m.find(c, seq(tok("word") == "f", A), within=None)
    assert [r.position for r in kwic.kwic_page(over, c).collect()] == [5]
    assert m.first_per_corpus(over, 20_000).count() == 1


def regional(spark):
    content = {"A": [[list("ab"), list("cd")], [list("efg"), list("h")], [list("ij")]]}
    lines = [("A", 0, 2), ("A", 3, 3), ("A", 4, 7)]
    return tiny(spark, content, inside={"line": lines}, across={"page": [("A", 1, 5), ("A", 6, 9)]})


def words_of(rows):
    return {r.row: ("".join(t.word for t in r.tokens), r.start, r.end) for r in rows.collect()}


@pytest.mark.parametrize("word, context, want", [
    ("b", "1 line", ("abc", 1, 2)), ("b", "2 lines", ("abcd", 1, 2)), ("d", "2 line", ("abcd", 3, 4)), ("f", "3 lines", ("efgh", 1, 2)),
    ("i", "1 line", ("i", 0, 1)), ("a", "1 page", ("a", 0, 1)), ("c", "1 page", ("bcdef", 1, 2)), ("c", "2 pages", ("bcdefghij", 1, 2)),
])
def test_regions_as_context(spark, word, context, want):
    c = regional(spark)
    page = kwic.kwic_page(m.find(c, tok("word") == word), c)
    assert words_of(kwic.context_by_corpus(page, c, {}, context)) == {0: want}


def test_context_of_matches_over_regions(spark):
    c = regional(spark)
    over = seq(tok("word") == "f", tok("word") == "g")
    page = kwic.kwic_page(m.find(c, over), c)
    assert words_of(kwic.context_regions(page, c, "page")) == {0: ("bcdefghij", 4, 6)}
    crossing = kwic.kwic_page(m.find(c, seq(tok("word") == "h", tok("word") == "i"), within=None), c)
    assert words_of(kwic.context_regions(crossing, c, "line")) == {0: ("efghi", 3, 5)}


def test_marks_of_regions(spark):
    c = regional(spark)
    page = kwic.kwic_page(m.find(c, seq(tok("word") == "c", tok("word") == "d")), c)
    got = [(r.word, r.open, r.close) for r in kwic.open_close(page, c, ("page", "text", "line", "sentence")).orderBy("i").collect()]
    assert got == [("c", ["sentence"], ["line"]), ("d", ["line"], ["line", "sentence", "text"])]
    page = kwic.kwic_page(m.find(c, tok("word") == "b"), c)
    got = [(r.word, r.open, r.close) for r in kwic.open_close(page, c, ("page", "text", "line", "sentence")).orderBy("i").collect()]
    assert got == [("a", ["text", "line", "sentence"], []), ("b", ["page"], ["sentence"])]


def parallel(spark):
    one = tiny(spark, {"A": [[["a", "b"], ["c"], ["d", "e"]], [["x"]], [["y"]]]})
    other = tiny(spark, {"B": [[["P"], ["Q", "R"]], [["S"], ["T"], ["U"]], [["V"]]]})
    given = [(0, "t0"), (1, "t1"), (2, None)]
    links = spark.createDataFrame(given, "text_id long, link_id string")
    return [type(c)(c.sentences, c.texts.join(links, "text_id").select(*c.texts.columns, "link_id"), c.info, c.attrs, c.structs) for c in (one, other)]


def test_links_between_sentences(spark):
    from quillspan.operators import alignment

    one, other = parallel(spark)
    links = alignment.by_sentence_order(one, other)
    got = sorted((r["first"], r["last"], r.p_first, r.p_last) for r in links.collect())
    # the second sentence of B belongs to all that is left of A, and three of B to the only one of A
    assert got == [(0, 1, 0, 0), (2, 4, 1, 2), (5, 5, 3, 5)]
    back = alignment.by_sentence_order(other, one)
    assert sorted((r.p_first, r.p_last, r["first"], r["last"]) for r in back.collect()) == got


def test_conditions_on_linked_segments(spark):
    from quillspan.operators import alignment

    one, other = parallel(spark)
    links = alignment.by_sentence_order(one, other)
    links = links.unionByName(spark.createDataFrame([("A", 4, 4, "B", 0, 0)], links.schema))  # a second link of one token
    every = m.find(one, tok("word").matches(".*"))

    def kept(word):
        rows = alignment.linked_matches(every, one, m.find(other, tok("word") == word), other, links)
        return sorted(r.position for r in kwic.with_position(rows, one).collect())

    assert kept("P") == [0, 1, 4] and kept("R") == [2, 3, 4] and kept("U") == [5] and kept("V") == []
    page = kwic.kwic_page(every, one)
    shown = {r.position: r.aligned_word for r in alignment.with_linked(page, other, links).collect()}
    assert shown == {0: ["P"], 1: ["P"], 2: ["Q", "R"], 3: ["Q", "R"], 4: ["P", "Q", "R"], 5: ["S", "T", "U"], 6: None}


def test_what_is_looked_up_for_few_texts_is_pruned_in_the_scan(spark, tmp_path):
    from quillspan.sources import corpora as source

    c = tiny(spark, short_texts())
    source.write(spark, c.sentences.drop("text_name"), c.texts.select("corpus", "text_id", "text_name"), str(tmp_path))
    kept = source.read(spark, str(tmp_path), c.attrs, c.structs)
    near = source.near_texts([("A", 3), ("A", 4), ("B", 20)])
    for within in ("sentence", "text"):
        found = m.find(kept, seq(A, tok("word") == "b"), within)
        plan = found.filter(near)._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in plan and "GreaterThanOrEqual(text_id,3)" in plan and "PartitionFilters: [corpus" in plan
        wanted = {("A", 3), ("A", 4), ("B", 20)}
        assert {tuple(r) for r in found.filter(near).collect()} == {tuple(r) for r in found.collect() if (r.corpus, r.text_id) in wanted}
