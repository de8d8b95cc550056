"""Step functions and trends worked out by hand."""

import pytest
from tiny import day, tiny

from quillspan import tok
from quillspan.operators import match as m
from quillspan.operators import timespan as ts
from quillspan.operators import trend

SPANS = "corpus string, datefrom timestamp_ntz, dateto timestamp_ntz, tokens bigint"


def steps(spark, spans, granularity="y", strategy=2, **options):
    df = spark.createDataFrame([("A", day(f), day(t), n) for f, t, n in spans], SPANS)
    out = ts.over_time(df, "tokens", granularity, strategy, **options)
    key = ts.time_key(ts.Calendar(granularity), out["bucket"])
    return {r[0]: r[1] for r in out.select(key, "tokens").collect()}


CASES = [
    ("two spans", [("2010-01-01", "2011-12-31", 100), ("2012-01-01", "2012-12-31", 50)], "y", 2, {"2010": 100, "2012": 50, "2013": 0}),
    ("overlap", [("2010-01-01", "2012-12-31", 5), ("2011-01-01", "2011-12-31", 7)], "y", 2, {"2010": 5, "2011": 12, "2012": 5, "2013": 0}),
    ("hole", [("2010-01-01", "2010-12-31", 3), ("2012-01-01", "2012-12-31", 4)], "y", 2, {"2010": 3, "2011": 0, "2012": 4, "2013": 0}),
    ("inward", [("2019-06-01", "2021-12-31", 9)], "y", 1, {"2020": 9, "2022": 0}),
    ("vanishing", [("2019-06-01", "2020-05-31", 9)], "y", 1, {}),
    ("vanishing beside another", [("2019-06-01", "2020-05-31", 9), ("2022-01-01", "2022-12-31", 1)], "y", 1, {"2020": 0, "2022": 1, "2023": 0}),
    ("strict", [("2010-03-01", "2011-02-01", 2), ("2010-03-01", "2010-09-30", 3)], "y", 3, {"2010": 3, "2011": 0}),
    ("undated", [(None, None, 6)], "y", 1, {"": 6}),
    ("month end", [("2020-03-01", "2020-04-30", 4)], "m", 1, {"202003": 4, "202005": 0}),
    ("month", [("2020-03-02", "2020-05-31", 4)], "m", 1, {"202004": 4, "202006": 0}),
    ("second", [("2020-12-31T23:59:58.700", "2020-12-31T23:59:59.100", 4)], "s", 2, {"20201231235958": 4, "20210101000000": 0}),
    ("hour", [("2020-12-31T22:00:00", "2020-12-31T23:59:59", 4)], "h", 1, {"2020123122": 4, "2021010100": 0}),
    ("old", [("0800-01-01", "0800-12-31", 4)], "y", 1, {"0800": 4, "0801": 0}),
    ("inverted", [("2012-01-01", "2010-12-31", 4), ("2009-01-01", "2009-12-31", 1)], "y", 1, {"2009": 1, "2010": 0}),
]


@pytest.mark.parametrize("spans,granularity,strategy,want", [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_step_function(spark, spans, granularity, strategy, want):
    assert steps(spark, spans, granularity, strategy) == want


def test_month_end_rule_of_31_days(spark):
    spans = [("2020-03-01", "2020-04-30", 4)]
    assert steps(spark, spans, "m", 1, edge_rule="reference") == {"202003": 4, "202004": 0}


def test_steps_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        got = steps(spark, [("2024-03-10T02:10:00", "2024-03-10T02:50:00", 1)], "n", 2)
        assert sum(got.values()) == 1 and len(got) == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_all_tokens_integrate_to_span_lengths(spark):
    got = steps(spark, [("2001-01-01", "2004-12-31", 5), ("2003-01-01", "2003-12-31", 2)])
    points = sorted((int(k), v) for k, v in got.items())
    area = sum(v * (k2 - k1) for (k1, v), (k2, _) in zip(points, points[1:]))
    assert area == 5 * 4 + 2 * 1


@pytest.fixture(scope="module")
def dated(spark):
    years = {("A", 0): ("2010-01-01", "2010-12-31"), ("A", 1): ("2012-01-01", "2012-12-31")}
    return tiny(spark, {"A": [[list("bbbbbbbbbb")], [list("abbbbbbbbb")]], "B": [[list("bb")]]}, dates=years)


def test_trend_with_marks(dated):
    found = m.find(dated, tok("word") == "a", keep=["datefrom", "dateto"])
    points = trend.with_marks(trend.count_time(found, dated), trend.has_text_marks(dated))
    got = {r.time: r.absolute for r in points.filter("corpus = 'A'").collect()}
    assert got == {"2010": 0, "2011": None, "2012": 1, "2013": None}


def test_trend_relative_and_sums(dated):
    found = m.find(dated, tok("word") == "a", keep=["datefrom", "dateto"])
    points = trend.count_time(found, dated)
    assert [(r.time, r.absolute, r.relative) for r in points.collect()] == [("2012", 1, 100000.0)]
    sums = {r.corpus: (r.absolute, r.relative) for r in trend.trend_sums(points, dated).collect()}
    assert sums == {"A": (1, 100000.0), "B": (0, 0.0)}
    both = trend.combined_sums(trend.count_time(found, dated, all_corpora=True), dated).collect()
    assert [(r.absolute, round(r.relative, 6)) for r in both] == [(1, round(1 / 22 * 1e6, 6))]


def test_corpora_outside_the_range_are_left_out(dated):
    near = trend.corpora_in_range(dated, "20150101000000", "20160101000000")
    assert [r.corpus for r in near.info.collect()] == ["B"]  # without dates it stays


def test_too_many_points(dated):
    trend.check_points(dated, "d", max_points=3600)
    with pytest.raises(ValueError):
        trend.check_points(dated, "h")
    with pytest.raises(ValueError):
        trend.check_points(dated, "y", "00010101000000", "50010101000000")


def test_range_needs_both_ends(dated):
    with pytest.raises(ValueError):
        ts.timespan(dated, start="20100101")
    with pytest.raises(ValueError):
        trend.corpora_in_range(dated, None, "20100101")
    with pytest.raises(ValueError):
        ts.timespan(dated, "x")
    with pytest.raises(ValueError):
        ts.timespan(dated, strategy=4)


def test_a_day_as_the_end_of_a_range_is_the_whole_day(spark):
    c = tiny(spark, {"A": [[["a"]]]}, dates={("A", 0): ("2020-01-01 10:00:00", "2020-01-01 12:00:00")})
    assert ts.in_range(ts.spans(c, False), "20200101", "20200101", 3).count() == 1
    assert ts.in_range(ts.spans(c, False), "20200102", "20200103", 3).count() == 0


@pytest.mark.parametrize("strategy, want", [(1, 1), (2, 1), (3, 0)])
@pytest.mark.parametrize("end", ["1999-12-31", "1999-12-31 15:00:00"])
def test_a_span_that_ends_on_the_last_day_holds_the_range(spark, strategy, want, end):
    c = tiny(spark, {"A": [[["a"]]]}, dates={("A", 0): ("1995-01-01", end)})
    for by_date in (True, False):
        assert ts.in_range(ts.spans(c, by_date), "19960101", "19991231", strategy).count() == want
    found = m.find(c, tok("word") == "a", keep=["datefrom", "dateto"])
    points = trend.count_time(found, c, "y", strategy, "19960101", "19991231").collect()
    assert {r.relative for r in points if r.absolute} == ({10.0**6} if want else set())


def test_too_many_points_as_rows(dated):
    got = {(r.corpus, r.granularity): r.refused for r in trend.too_many_points(dated).collect()}
    assert got["A", "d"] is False and got["A", "h"] is True and got["B", "y"] is None


def test_line_items_are_put_in_order_once(spark, tmp_path):
    from quillspan.sources import corpora as source

    day = lambda n: f"TIMESTAMP '2020-01-{n:02d} 00:00:00'"
    spark.sql("SELECT * FROM VALUES (1, 'high', 'O'), (2, 'low', 'F'), (50, 'high', 'O'), (3, 'low', 'O') t(o_orderkey, o_orderpriority, o_orderstatus)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT * FROM VALUES (7, 'a ring', 'B1') t(p_partkey, p_name, p_brand)").write.parquet(f"{tmp_path}/part.parquet")
    items = [(1, 7, 5, 2, day(9)), (1, 7, 5, 1, day(4)), (1, 8, 5, 2, day(30)), (2, 7, 5, 4, day(1)), (50, 7, 5, 1, day(2)), (99, 7, 5, 1, day(2))]
    rows = ", ".join(f"({o}, {p}, {s}, {n}, 1.0D, 2.0D, 'R', {d})" for o, p, s, n, d in items)
    spark.sql(f"SELECT * FROM VALUES {rows} t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_shipdate)").write.parquet(f"{tmp_path}/lineitem.parquet")
    sentences, _ = source._order_corpora(spark, str(tmp_path), str(tmp_path / "staging"))
    assert not (tmp_path / "staging").exists()
    plan = sentences._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and plan.index("rangepartitioning") > plan.rindex("Window ")  # windows above it
    c = source.prepare(spark, str(tmp_path), "order")
    got = [(r.corpus, r.text_id, r.sent_no, r.sent_off, r.text_n, r.word, str(r.datefrom)[:10], str(r.dateto)[:10]) for r in c.sentences.collect()]
    high = [("HIGH", 1, 0, 0, 3, ["a ring"], "2020-01-04", "2020-01-30"), ("HIGH", 1, 1, 1, 3, ["a ring"], "2020-01-04", "2020-01-30"), ("HIGH", 1, 2, 2, 3, [None], "2020-01-04", "2020-01-30")]
    assert sorted(got, key=lambda r: r[:3]) == [*high, ("HIGH", 50, 0, 0, 1, ["a ring"], "None", "None"), ("LOW", 2, 0, 0, 1, ["a ring"], "2020-01-01", "2020-01-01")]
    texts = {r.text_id: (r.corpus, r.text_status, str(r.datefrom)[:10], r.n_tokens, r.start_pos) for r in c.texts.collect()}
    assert texts == {1: ("HIGH", "O", "2020-01-04", 3, 0), 50: ("HIGH", "O", "None", 1, 3), 2: ("LOW", "F", "2020-01-01", 1, 0), 3: ("LOW", "O", "None", 0, 1)}


def test_texts_meet_their_neighbours_in_blocks(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from quillspan.sources import corpora as source

    pick, rows, places, words = random.Random(5), [], [], {"A": [], "B": []}
    for text_id in range(60):
        corpus, lengths = pick.choice("AB"), [pick.choice([1, 1, 2, 5]) for _ in range(pick.choice([0, 0, 1, 2, 3]))]
        places.append((corpus, text_id, len(words[corpus]), sum(lengths)))
        off = 0
        for n in lengths:
            mine = [None if pick.random() < 0.1 else f"w{text_id}.{off + i}" for i in range(n)]
            rows.append((corpus, text_id, off, n, sum(lengths), mine))
            words[corpus] += mine
            off += n
    sentences = spark.createDataFrame(rows, "corpus string, text_id long, sent_off long, n int, text_n long, word array<string>")
    texts = spark.createDataFrame(places, "corpus string, text_id long, start_pos long, n_tokens long")
    want = {(c, t): (words[c][max(p - 3, 0) : p], words[c][p + n : p + n + 3]) for c, t, p, n in places}
    for block in (2, 3, 1 << 16):
        monkeypatch.setattr(source, "EDGE_BLOCK", block, raising=False)
        got = source.neighbour_words(sentences, texts)
        assert {(r.corpus, r.text_id): (r.before_words, r.after_words) for r in got.collect()} == want
    assert got.columns == ["corpus", "text_id", "before_words", "after_words"]
    plan = source.neighbour_words(sentences, texts.withColumn("n_tokens", F.col("n_tokens")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") <= 4
