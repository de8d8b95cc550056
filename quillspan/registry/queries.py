"""One registered query per operator.  Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import alignment, catalogue, compare, kwic, paging, relations, timespan, trend, values
from quillspan.operators import count as stats
from quillspan.operators import match as m
from quillspan.operators.lemgrams import lemgram_count
from quillspan.plans.pattern import alt, any_token, gap, look, one, rep, seq, tok
from quillspan.registry import tables
from quillspan.sources.corpora import Corpora, prepare, union

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

THE = tok("word") == "the"
ING = tok("word").matches(".*ing")
CAP = tok("pos") == "CAP"
LOW = tok("pos") == "LOW"
EVEN_SOURCES = [f"SRC{i}" for i in range(0, 20, 2)]
ODD_SOURCES = [f"SRC{i}" for i in range(1, 20, 2)]


def _text(fn: Callable[[Corpora], DataFrame]) -> None:
    """Register a query over the text corpora under the function's name."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(prepare(spark, sf_dir, "text"))


def _order(fn: Callable[[Corpora], DataFrame]) -> None:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(prepare(spark, sf_dir, "order"))


def _event(fn: Callable[[Corpora], DataFrame]) -> None:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(prepare(spark, sf_dir, "event"))


def _raw(fn: Query) -> None:
    QUERIES[fn.__name__] = fn


def _places(matches: DataFrame) -> DataFrame:
    """Matches as corpus, text, offset in the text, and length."""
    return matches.select(
        "corpus", "text_id", kwic.place().cast("bigint").alias("offset"), (F.col("me") - F.col("ms") + 1).cast("bigint").alias("length")
    )


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns or ("relative",)})


# --------------------------------------------------------------------------------------
# sources and derived tables


@_text
def corpus_positions(c: Corpora) -> DataFrame:
    return c.texts.select("corpus", "text_id", "n_tokens", "n_sents", "start_pos")


@_text
def sentence_positions(c: Corpora) -> DataFrame:
    return c.positioned().select("corpus", "text_id", F.col("sent_no").cast("bigint").alias("sent_no"), "start_pos", F.col("n").cast("bigint").alias("n"))


@_text
def attribute_scan(c: Corpora) -> DataFrame:
    return stats.count_all(c, ["pos", "lemma"], ["text_lang"])


def _profile(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy("corpus", *keys).agg(F.count("*").alias("entries"), F.sum("freq").alias("freq"), F.max("freq").alias("highest"))


@_raw
def relation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = relations.relation_table(relations.adjacency(prepare(spark, sf_dir, "text")))
    return _profile(triples, "rel", *relations.FLAGS)


@_raw
def relation_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the stored table in which a word in -ing is the head or the dependent."""
    pictures = tables.word_pictures(spark, sf_dir)
    heads = pictures.by_head.filter(F.col("head").like("%ing"))
    deps = pictures.by_dep.filter(F.col("dep").like("%ing"))
    return heads.unionByName(deps).distinct().drop("depextra")


@_raw
def relation_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = tables.word_pictures(spark, sf_dir)
    kinds = {
        "rel": pictures.rel.select("corpus", F.lit("base").alias("form"), "rel", F.col("rel_freq").alias("freq")),
        "head": pictures.head_rel.select("corpus", "form", "rel", F.col("head_rel_freq").alias("freq")),
        "dep": pictures.dep_rel.select("corpus", "form", "rel", F.col("dep_rel_freq").alias("freq")),
    }
    first, *rest = [df.withColumn("kind", F.lit(k)) for k, df in kinds.items()]
    for df in rest:
        first = first.unionByName(df)
    return _profile(first, "kind", "form", "rel")


@_raw
def lemgram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lemgram_index(spark, sf_dir)


def _stamped(df: DataFrame, fmt: str) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.date_format(c, fmt), F.lit("")) for c in ("datefrom", "dateto")})


@_order
def timedata(c: Corpora) -> DataFrame:
    return _stamped(timespan.timedata(c), "yyyyMMddHHmmss")


@_event
def timedata_seconds(c: Corpora) -> DataFrame:
    return _stamped(timespan.timedata(c), "yyyyMMddHHmmss")


@_order
def timedata_date(c: Corpora) -> DataFrame:
    return _stamped(timespan.timedata(c, by_date=True), "yyyyMMdd")


# --------------------------------------------------------------------------------------
# catalogue


@_raw
def corpora_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sources that have a toxic text need permission.
    c = prepare(spark, sf_dir, "text")
    return catalogue.corpora_list(c, c.texts.filter("text_toxic = '1'").select("corpus"))


@_raw
def access_denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sources with a toxic text need permission; who reads SRC0 to SRC9 may read the even ones among them.
    c = prepare(spark, sf_dir, "text")
    allowed = c.info.filter(F.col("corpus").isin(EVEN_SOURCES)).select("corpus")
    asked = c.info.filter(F.col("corpus").isin([f"SRC{i}" for i in range(10)])).select(F.lower("corpus").alias("corpus"))
    return catalogue.denied(asked, c.texts.filter("text_toxic = '1'").select("corpus"), allowed)


@_order
def corpus_info(c: Corpora) -> DataFrame:
    info = catalogue.corpus_info(c)
    return info.withColumns({d: F.date_format(d, "yyyy-MM-dd HH:mm:ss") for d in ("first_date", "last_date")})


@_text
def corpus_info_totals(c: Corpora) -> DataFrame:
    return catalogue.corpus_totals(c)


@_text
def corpus_attributes(c: Corpora) -> DataFrame:
    return catalogue.attributes(c)


# --------------------------------------------------------------------------------------
# token conditions


@_text
def pred_eq(c: Corpora) -> DataFrame:
    return _places(m.find(c, THE))


@_text
def pred_regex(c: Corpora) -> DataFrame:
    return _places(m.find(c, tok("word").matches("(un|in).*tion")))


@_text
def pred_contains(c: Corpora) -> DataFrame:
    return _places(m.find(c, tok("lex").contains("ion") | tok("lex").contains_match("re.*nd")))


@_text
def pred_any(c: Corpora) -> DataFrame:
    return m.find(c, any_token()).groupBy("corpus").agg(F.count("*").alias("hits"))


@_text
def pred_ignore_case(c: Corpora) -> DataFrame:
    return _places(m.find(c, tok("word").equals("THE", ignore_case=True)))


@_text
def pred_bool(c: Corpora) -> DataFrame:
    # Numbers have no sense: neither equality nor its negation holds for them.
    return _places(m.find(c, (CAP & ~ING & (tok("sense") != "the:3")) | tok("word").isin("of", "la")))


@_text
def pred_struct(c: Corpora) -> DataFrame:
    return _places(m.find(c.where((F.col("text_lang") == "en") & (F.col("text_quality") == "1")), THE))


@_text
def pred_assert(c: Corpora) -> DataFrame:
    return _places(m.find(c, seq(THE, look(tok("word").matches("[a-m].*")), any_token())))


# --------------------------------------------------------------------------------------
# sequences


@_text
def match_sequence(c: Corpora) -> DataFrame:
    found = m.find(c, seq(THE, ING))
    starts = c.texts.select("corpus", "text_id", "start_pos")
    rows = found.join(starts, ["corpus", "text_id"])
    return rows.select("corpus", (F.col("start_pos") + kwic.place()).alias("position"))


@_text
def match_gap(c: Corpora) -> DataFrame:
    return _places(m.find(c, seq(THE, gap(0, 3), ING)))


@_text
def match_gap_chain(c: Corpora) -> DataFrame:
    return _places(m.find(c, seq(THE, gap(0, 2), LOW, ING)))


@_text
def match_open_gap(c: Corpora) -> DataFrame:
    return _places(m.find(c, seq(THE, gap(1, None), ING)))


@_text
def match_edge_wildcards(c: Corpora) -> DataFrame:
    return _places(m.find(c, seq(gap(0, 2), THE, gap(1, 2))))


@_text
def match_repetition(c: Corpora) -> DataFrame:
    return _places(m.find(c, seq(rep(CAP, 1, 3), tok("word").matches(".*n"))))


@_text
def match_alternation(c: Corpora) -> DataFrame:
    return _places(m.find(c, seq(alt(seq(THE, ING), seq(tok("word") == "of", gap(0, 1), LOW), CAP), tok("word").matches("[a-h].*"))))


@_text
def match_within_text(c: Corpora) -> DataFrame:
    return _places(m.find(c, seq(THE, gap(0, 5), ING), within="text"))


@_text
def match_within_text_open(c: Corpora) -> DataFrame:
    return _places(m.find(c, seq(CAP, THE, gap(2, None), ING), within="text"))


@_text
def match_unbounded_region(c: Corpora) -> DataFrame:
    found = kwic.with_position(m.find(c, seq(THE, gap(0, 5), ING), within=None), c)
    return found.select("corpus", F.col("position").cast("bigint").alias("position"), (F.col("me") - F.col("ms") + 1).cast("bigint").alias("length"))


@_text
def match_free_order(c: Corpora) -> DataFrame:
    found = m.free_order(c, THE, ING, tok("word") == "of")
    return found.select("corpus", "text_id", F.col("sent_no").cast("bigint").alias("sent_no"))


@_text
def match_chain_expand(c: Corpora) -> DataFrame:
    return _places(m.chain(c, [seq(THE, ING), tok("word") == "of"], within="sentence"))


@_text
def match_within_by_corpus(c: Corpora) -> DataFrame:
    # Texts as regions for one corpus, sentences for the others.
    return _places(m.find(c, seq(THE, gap(0, 5), ING), within=m.parse_within("SRC3:text", "sentence")))


@_text
def match_free_order_text(c: Corpora) -> DataFrame:
    return _places(m.free_order_in_texts(c, THE, tok("word").matches("i.*ing"), tok("word") == "of"))


@_text
def match_chain_expand_text(c: Corpora) -> DataFrame:
    return _places(m.chain(c, [seq(THE, tok("word").matches("i.*ing")), CAP & ING], within="text"))


@_text
def match_chain_spans(c: Corpora) -> DataFrame:
    return _places(m.chain(c, [seq(THE, gap(0, 6), ING), tok("word").matches("[a-m].*")], within="sentence", expand=False))


@_text
def match_cut(c: Corpora) -> DataFrame:
    return _places(m.first_per_corpus(m.find(c, THE), 25))


@_text
def match_cut_deep(c: Corpora) -> DataFrame:
    return _places(m.first_per_corpus(m.find(c, any_token()), 12_000))


@_text
def match_within_line(c: Corpora) -> DataFrame:
    return _places(m.find(c, seq(THE, gap(0, 8), ING), within="line"))


def _conversation(fn: Callable[[Corpora], DataFrame]) -> None:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(prepare(spark, sf_dir, "conversation"))


@_conversation
def match_within_conversation(c: Corpora) -> DataFrame:
    # From one text of a conversation into the next one of the same speaker.
    return _places(m.find(c, seq(CAP, gap(0, None), tok("word").matches("[xyz].*")), within="conversation"))


@_text
def match_repetition_text(c: Corpora) -> DataFrame:
    return _places(m.find(c, seq(THE, rep(LOW, 1, None), CAP), within="text"))


@_text
def match_edge_open_text(c: Corpora) -> DataFrame:
    return _places(m.find(c, seq(gap(1, None), THE, ING, gap(2, None)), within="text"))


@_text
def match_chain_spans_text(c: Corpora) -> DataFrame:
    return _places(m.chain(c, [seq(THE, gap(0, None), ING), seq(CAP, LOW)], within="text", expand=False))


@_text
def match_chain_spans_unbounded(c: Corpora) -> DataFrame:
    return _places(m.chain(c, [seq(THE, gap(0, 12), ING), seq(CAP, LOW)], within=None, expand=False))


@_text
def match_chain_expand_line(c: Corpora) -> DataFrame:
    return _places(m.chain(c, [seq(THE, ING), tok("word") == "of"], within="line"))


def _conversations(spark: SparkSession, sf_dir: str) -> tuple[Corpora, Corpora]:
    both = prepare(spark, sf_dir, "conversation")
    return both.select("CONV-USER"), both.select("CONV-ASSISTANT")


@_raw
def match_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, assistant = _conversations(spark, sf_dir)
    asked, answered = m.find(user, THE, keep=["link_id"]), m.find(assistant, ING, keep=["link_id"])
    return _places(m.linked(asked, answered))


@_raw
def alignment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sentence_links(spark, sf_dir)


@_raw
def match_aligned_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Capitalised words in sentences of questions whose counterpart in the answer has one as well.
    user, assistant = _conversations(spark, sf_dir)
    links = tables.sentence_links(spark, sf_dir)
    return _places(alignment.linked_matches(m.find(user, seq(CAP, LOW)), user, m.find(assistant, CAP), assistant, links))


@_text
def corpus_hits(c: Corpora) -> DataFrame:
    return m.hits_per_corpus(m.find(c, seq(CAP, tok("word").matches("th.*ing"))), c)


# --------------------------------------------------------------------------------------
# concordance


def _line(rows: DataFrame, *more: str) -> DataFrame:
    start, end = F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")
    return kwic.line_text(rows).select(F.col("row").cast("bigint").alias("row"), "corpus", "position", start, end, "left", "keyword", "right", *more)


@_text
def kwic_words(c: Corpora) -> DataFrame:
    page = kwic.kwic_page(m.find(c, seq(THE, ING)), c, 0, 24)
    return _line(kwic.context_words(page, c))


@_text
def kwic_context_sides(c: Corpora) -> DataFrame:
    page = kwic.kwic_page(m.find(c, seq(THE, ING)), c, 0, 49)
    return _line(kwic.context_by_corpus(page, c, {"SRC0": ("3 words", "8 words")}, "5 words"))


@_text
def kwic_sentence(c: Corpora) -> DataFrame:
    page = kwic.kwic_page(m.find(c, seq(THE, ING)), c, 0, 24)
    return _line(kwic.context_sentences(page, c))


@_text
def kwic_sentences_around(c: Corpora) -> DataFrame:
    page = kwic.kwic_page(m.find(c, seq(THE, ING)), c, 0, 24)
    return _line(kwic.context_sentences(page, c, around=1))


@_text
def kwic_context_lines(c: Corpora) -> DataFrame:
    page = kwic.kwic_page(m.find(c, seq(THE, ING)), c, 0, 24)
    return _line(kwic.context_by_corpus(page, c, {}, "2 lines"))


@_conversation
def kwic_context_conversation(c: Corpora) -> DataFrame:
    page = kwic.kwic_page(m.find(c, seq(CAP, LOW)), c, 0, 9)
    return _line(kwic.context_by_corpus(page, c, {}, "1 conversation"))


@_text
def kwic_show(c: Corpora) -> DataFrame:
    page = kwic.kwic_page(m.find(c, seq(THE, ING)), c, 0, 24)
    rows = kwic.context_words(page, c, 2, 2, show=["lemma", "pos", "no_such_attribute"])
    shown = {a: F.array_join(F.col("tokens")[a], " ", "") for a in ("word", "lemma", "pos")}
    return rows.select(F.col("row").cast("bigint").alias("row"), *[v.alias(k) for k, v in shown.items()])


@_text
def kwic_structs(c: Corpora) -> DataFrame:
    page = kwic.kwic_page(m.find(c, seq(THE, ING)), c, 0, 99)
    rows = kwic.with_structs(page, c, ["text_lang", "text_quality", "no_such_struct"])
    return rows.select(F.col("row").cast("bigint").alias("row"), "corpus", "position", "text_lang", "text_quality")


@_text
def kwic_open_close(c: Corpora) -> DataFrame:
    page = kwic.kwic_page(m.find(c, seq(CAP, LOW)), c, 0, 199)
    rows = kwic.open_close(page, c)
    marks = [F.array_join(x, " ").alias(x) for x in ("open", "close")]
    return rows.select(F.col("row").cast("bigint").alias("row"), "corpus", F.col("i").cast("bigint").alias("i"), "word", "in_match", *marks)


@_conversation
def kwic_open_close_regions(c: Corpora) -> DataFrame:
    page = kwic.kwic_page(m.find(c, seq(CAP, LOW)), c, 0, 199)
    rows = kwic.open_close(page, c, ("conversation", "text", "line", "sentence"))
    marks = [F.array_join(x, " ").alias(x) for x in ("open", "close")]
    return rows.select(F.col("row").cast("bigint").alias("row"), "corpus", F.col("i").cast("bigint").alias("i"), "word", "in_match", *marks)


def _sorted(c: Corpora, sort: str, pattern=THE, within: str | None = "sentence", block: int = 4096, **options) -> DataFrame:
    found = m.find(c, pattern, within, keep=kwic.needed_for_sort(sort), block=block)
    page = kwic.kwic_page(found, c, 5, 64, sort=sort, **options)
    return page.select(F.col("row").cast("bigint").alias("row"), "corpus", "position")


@_text
def kwic_sort_left(c: Corpora) -> DataFrame:
    return _sorted(c, "left")


@_text
def kwic_sort_keyword(c: Corpora) -> DataFrame:
    return _sorted(c, "keyword", seq(THE, any_token()))


@_text
def kwic_sort_right(c: Corpora) -> DataFrame:
    return _sorted(c, "right")


def _sort_by_neighbours(side: str, within: str | None) -> None:
    """Matches that cross sentences, sorted by the words around them, which may lie in another text."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _sorted(prepare(spark, sf_dir, "text"), side, seq(THE, gap(0, 5), ING), within)

    QUERIES[f"kwic_sort_{side}_{within or 'unbounded'}"] = query


for _side in ("left", "right"):
    for _within in ("text", "line", None):
        _sort_by_neighbours(_side, _within)


@_text
def kwic_sort_attr(c: Corpora) -> DataFrame:
    return _sorted(c, "pos", seq(any_token(), THE, any_token()))


@_text
def kwic_sort_random(c: Corpora) -> DataFrame:
    return _sorted(c, "random", seed="42")


@_text
def kwic_sort_collated(c: Corpora) -> DataFrame:
    return _sorted(c, "keyword", tok("word").matches("é.*"), collation="sv")


@_text
def kwic_page(c: Corpora) -> DataFrame:
    page = kwic.kwic_page(m.find(c, THE), c, 700, 899)
    return page.select(F.col("row").cast("bigint").alias("row"), "corpus", "position")


@_text
def kwic_page_deep(c: Corpora) -> DataFrame:
    page = kwic.kwic_page(m.find(c, any_token()), c, 123_000, 123_499)
    return page.select(F.col("row").cast("bigint").alias("row"), "corpus", "position")


@_text
def kwic_page_by_hits(c: Corpora) -> DataFrame:
    found = m.find(c, THE)
    page = kwic.page_by_hits(found, c, m.hits_per_corpus(found, c), 700, 899)
    return page.select(F.col("row").cast("bigint").alias("row"), "corpus", "position")


@_text
def kwic_free_order(c: Corpora) -> DataFrame:
    found = m.free_order(c, THE, ING)
    page = kwic.free_order_page(found, c, 0, 49)
    hits = F.array_join(F.transform("hits", lambda i: i.cast("string")), " ")
    return page.select(F.col("row").cast("bigint").alias("row"), "corpus", "text_id", F.col("sent_no").cast("bigint").alias("sent_no"), hits.alias("hits"))


@_raw
def kwic_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, assistant = _conversations(spark, sf_dir)
    page = kwic.kwic_page(m.find(user, CAP), user, 0, 99)
    rows = kwic.with_aligned(page, user, assistant)
    return rows.select(F.col("row").cast("bigint").alias("row"), "position", F.array_join("aligned_word", " ").alias("aligned"))


@_raw
def kwic_aligned_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, assistant = _conversations(spark, sf_dir)
    page = kwic.kwic_page(m.find(user, CAP), user, 0, 99)
    rows = alignment.with_linked(page, assistant, tables.sentence_links(spark, sf_dir))
    return rows.select(F.col("row").cast("bigint").alias("row"), "position", F.array_join("aligned_word", " ").alias("aligned"))


@_text
def kwic_row_cap(c: Corpora) -> DataFrame:
    return paging.beyond_cap(m.hits_per_corpus(m.find(c, THE), c), max_rows=100)


@_text
def kwic_sample(c: Corpora) -> DataFrame:
    return kwic.sample(m.find(c, seq(THE, ING)), c, rows=10, seed="7").select("corpus", "position")


# --------------------------------------------------------------------------------------
# statistics


@_text
def count_word(c: Corpora) -> DataFrame:
    return stats.count(m.find(c, ING, keep=["word"]), ["word"])


@_text
def count_ngram(c: Corpora) -> DataFrame:
    return stats.count(m.find(c, seq(THE, gap(0, 1), ING), keep=["word"]), ["word"])


@_text
def count_struct(c: Corpora) -> DataFrame:
    return stats.count(m.find(c, ING, keep=["text_lang"]), group_by_struct=["text_lang"])


@_text
def count_multi(c: Corpora) -> DataFrame:
    found = m.find(c, seq(THE, any_token()), keep=["word", "pos", "text_lang", "text_quality"])
    return stats.count(found, ["word", "pos"], ["text_quality", "text_lang"])


@_text
def count_ignore_case(c: Corpora) -> DataFrame:
    return stats.count(m.find(c, seq(CAP, ING), keep=["word"]), ["word"], ignore_case=["word"])


@_text
def count_split(c: Corpora) -> DataFrame:
    return stats.count(m.find(c, seq(THE, any_token()), keep=["lex"]), ["lex"], split=["lex"], longest=2)


@_text
def count_split_ngram(c: Corpora) -> DataFrame:
    return stats.count(m.find(c, seq(THE, gap(3)), keep=["lex"]), ["lex"], split=["lex"])


@_text
def count_split_top(c: Corpora) -> DataFrame:
    return stats.count(m.find(c, seq(THE, any_token()), keep=["lex", "pos"]), ["lex", "pos"], split=["lex"], top=["lex"])


@_text
def count_set_text(c: Corpora) -> DataFrame:
    return stats.count(m.find(c, seq(THE, any_token()), keep=["lex"]), ["lex"])


@_text
def count_strip_pointer(c: Corpora) -> DataFrame:
    return stats.count(m.find(c, seq(CAP, any_token()), keep=["sense"]), ["sense"], strip=["sense"])


@_text
def count_relative(c: Corpora) -> DataFrame:
    return _rounded(stats.with_relative(stats.count(m.find(c, ING, keep=["word"])), c))


@_text
def count_combined(c: Corpora) -> DataFrame:
    # Few corpora have hits; the denominator still is the size of all.
    return _rounded(stats.combined(stats.count(m.find(c, seq(THE, tok("word").matches("i.*ing")), keep=["word"])), c))


@_text
def count_relative_to(c: Corpora) -> DataFrame:
    counts = stats.count(m.find(c, ING, keep=["pos", "text_lang", "text_quality"]), ["pos"], ["text_lang", "text_quality"])
    return _rounded(stats.relative_to(counts, c, ["text_lang"]))


@_text
def count_relative_to_combined(c: Corpora) -> DataFrame:
    counts = stats.count(m.find(c, ING, keep=["pos", "text_lang", "text_quality"]), ["pos"], ["text_lang", "text_quality"])
    return _rounded(stats.relative_to(counts, c, ["text_lang", "text_quality"], per_corpus=False))


@_text
def count_sums(c: Corpora) -> DataFrame:
    return _rounded(stats.sums(stats.count(m.find(c, seq(CAP, tok("word").matches("th.*ing")), keep=["word"])), c))


@_text
def count_statistics(c: Corpora) -> DataFrame:
    return _rounded(stats.statistics(stats.count(m.find(c, ING, keep=["word"])), c))


@_text
def count_distinct_values(c: Corpora) -> DataFrame:
    return stats.distinct_values(stats.count(m.find(c, seq(THE, any_token()), keep=["word"])))


@_text
def count_page(c: Corpora) -> DataFrame:
    counts = stats.count(m.find(c, seq(THE, any_token()), keep=["word"]))
    chosen = stats.frequency_page(stats.combined(counts, c), 10, 29)
    return stats.on_page(counts, chosen)


@_text
def count_page_combined(c: Corpora) -> DataFrame:
    counts = stats.count(m.find(c, seq(THE, any_token()), keep=["word"]))
    return _rounded(stats.frequency_page(stats.combined(counts, c), 10, 29))


@_text
def count_target(c: Corpora) -> DataFrame:
    pattern = seq(THE, gap(0, 2), one(CAP, target=True), LOW)
    return stats.count(m.find(c, pattern, keep=["word"]), use_target=True)


def _subqueries(c: Corpora) -> DataFrame:
    """Query 0 is the main one; 1 and 2 look inside its matches."""
    return m.subqueries(c, seq(THE, gap(0, 4), ING), [CAP, seq(LOW, ING)], keep=["lemma", "text_lang"])


@_text
def count_subqueries(c: Corpora) -> DataFrame:
    return stats.count(_subqueries(c), ["lemma"], ["text_lang"], by=["query_no"])


@_text
def count_subquery_sums(c: Corpora) -> DataFrame:
    return _rounded(stats.sums(stats.count(_subqueries(c), ["lemma"], by=["query_no"]), c, queries=3))


@_text
def count_subqueries_text(c: Corpora) -> DataFrame:
    found = m.subqueries(c, seq(THE, gap(0, 9), ING), [CAP, seq(LOW, ING)], keep=["lemma", "text_lang"], within="text")
    return stats.count(found, ["lemma"], ["text_lang"], by=["query_no"])


@_text
def count_page_subqueries(c: Corpora) -> DataFrame:
    # Beyond the thousandth value of every query.
    totals = stats.combined(stats.count(_subqueries(c), ["lemma"], by=["query_no"]), c, by=["query_no"])
    return _rounded(stats.frequency_page(totals, 0, 1499))


@_raw
def count_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Event corpora have no lemma and no language; their key is null.
    parts = [prepare(spark, sf_dir, kind) for kind in ("text", "conversation", "event")]
    return stats.count_all(union(*parts), ["pos"], ["text_lang", "text_role"])


@_text
def count_all(c: Corpora) -> DataFrame:
    return stats.count_all(c, ["word"], ignore_case=["word"])


@_text
def count_all_struct(c: Corpora) -> DataFrame:
    return stats.count_all(c, group_by_struct=["text_lang", "text_toxic"])


# --------------------------------------------------------------------------------------
# attribute values


@_text
def attr_values(c: Corpora) -> DataFrame:
    return values.attr_values(c, "text_quality")


@_text
def attr_values_count(c: Corpora) -> DataFrame:
    return values.attr_values(c, "sense", with_count=True)


@_text
def attr_values_split(c: Corpora) -> DataFrame:
    return values.attr_values(c, "lex", split=["lex"], with_count=True)


@_text
def attr_values_tree(c: Corpora) -> DataFrame:
    return values.attr_values(c, "text_lang>text_quality>pos", with_count=True)


@_text
def attr_values_combined(c: Corpora) -> DataFrame:
    return values.merge_corpora(values.attr_values(c, "text_lang>pos", with_count=True))


@_text
def attr_values_combined_list(c: Corpora) -> DataFrame:
    return values.merge_corpora(values.attr_values(c, "text_lang>text_toxic"))


# --------------------------------------------------------------------------------------
# time


@_order
def timespan_year(c: Corpora) -> DataFrame:
    return timespan.timespan(c, "y")


@_order
def timespan_month(c: Corpora) -> DataFrame:
    return timespan.timespan(c, "m")


@_order
def timespan_month_edge(c: Corpora) -> DataFrame:
    return timespan.timespan(c, "m", edge_rule="reference")


@_order
def timespan_day(c: Corpora) -> DataFrame:
    return timespan.timespan(c, "d")


@_event
def timespan_hour(c: Corpora) -> DataFrame:
    return timespan.timespan(c, "h")


@_event
def timespan_minute(c: Corpora) -> DataFrame:
    return timespan.timespan(c, "n")


@_event
def timespan_second(c: Corpora) -> DataFrame:
    return timespan.timespan(c, "s")


@_order
def timespan_s2(c: Corpora) -> DataFrame:
    return timespan.timespan(c, "m", 2)


@_order
def timespan_s3(c: Corpora) -> DataFrame:
    return timespan.timespan(c, "y", 3)


@_order
def timespan_range(c: Corpora) -> DataFrame:
    return timespan.timespan(c, "m", 1, "19960101", "19991231")


@_order
def timespan_range_s2(c: Corpora) -> DataFrame:
    return timespan.timespan(c, "y", 2, "1997-01-01", "1998-06-30")


@_order
def timespan_undated(c: Corpora) -> DataFrame:
    return timespan.timespan(c, "y").filter(F.col("time") == "")


@_order
def timespan_combined(c: Corpora) -> DataFrame:
    return timespan.timespan(c, "y", per_corpus=False, all_corpora=True)


RING = tok("word").matches(".* ring")


def _dated(c: Corpora) -> DataFrame:
    return m.find(c, RING & (tok("pos") == "R"), keep=["datefrom", "dateto"])


@_order
def count_time(c: Corpora) -> DataFrame:
    return _rounded(trend.count_time(_dated(c), c, "y", 2))


@_order
def count_time_month(c: Corpora) -> DataFrame:
    return _rounded(trend.count_time(_dated(c), c, "m", 1))


@_event
def count_time_hour(c: Corpora) -> DataFrame:
    found = m.find(c, (tok("word") == "error") & (tok("pos") == "POS"), keep=["datefrom", "dateto"])
    return _rounded(trend.count_time(found, c, "h", 1))


@_event
def count_time_marks(c: Corpora) -> DataFrame:
    found = m.find(c, (tok("word") == "error") & (tok("pos") == "POS"), keep=["datefrom", "dateto"])
    return _rounded(trend.with_marks(trend.count_time(found, c, "h", 1), trend.has_text_marks(c, "h", 1)))


@_order
def count_time_range(c: Corpora) -> DataFrame:
    bounds = ("19960101000000", "19971231235959")
    near = trend.corpora_in_range(c, *bounds)
    return _rounded(trend.trend_sums(trend.count_time(_dated(near), near, "y", 1, *bounds), c))


@_event
def count_time_refused(c: Corpora) -> DataFrame:
    return trend.too_many_points(c)


@_order
def count_time_combined(c: Corpora) -> DataFrame:
    return _rounded(trend.count_time(_dated(c), c, "y", 2, all_corpora=True))


@_order
def count_time_combined_sums(c: Corpora) -> DataFrame:
    return _rounded(trend.combined_sums(trend.count_time(_dated(c), c, "y", 2, all_corpora=True), c))


@_order
def count_time_subqueries(c: Corpora) -> DataFrame:
    both = m.subqueries(c, RING, [tok("pos") == "R"], keep=["datefrom", "dateto"])
    return _rounded(trend.count_time(both, c, "y", 2))


# --------------------------------------------------------------------------------------
# comparison


def _scored(c: Corpora) -> DataFrame:
    counts = stats.count(m.find(c, seq(THE, any_token()), keep=["word", "pos"]), ["word", "pos"])
    return compare.log_likelihood(compare.two_sets(counts, EVEN_SOURCES, ODD_SOURCES))


@_text
def loglike(c: Corpora) -> DataFrame:
    return _scored(c)


@_text
def loglike_two_queries(c: Corpora) -> DataFrame:
    one_side = stats.count(m.find(c, seq(THE, any_token()), keep=["pos", "text_lang"]), ["pos"], ["text_lang"])
    other = stats.count(m.find(c, seq(ING, any_token()), keep=["pos", "text_lang"]), ["pos"], ["text_lang"])
    return compare.log_likelihood(compare.two_queries(one_side, other))


@_text
def loglike_top(c: Corpora) -> DataFrame:
    return compare.strongest(_scored(c), 15)


@_text
def loglike_top_many(c: Corpora) -> DataFrame:
    return compare.strongest(_scored(c), 1500)


@_text
def loglike_average(c: Corpora) -> DataFrame:
    return compare.average(_scored(c))


# --------------------------------------------------------------------------------------
# word picture


def _found(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return relations.lookup(tables.word_pictures(spark, sf_dir), "the", **options)


def _picture(rows: DataFrame) -> DataFrame:
    return _rounded(rows, "mi").drop("source")


@_raw
def relations_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    picture = relations.word_picture(_found(spark, sf_dir))
    sources = F.size(F.split("source", ",")).cast("bigint")
    return picture.select("head", "headpos", "rel", "dep", "deppos", "depextra", "freq", sources.alias("n_sources"))


QUERIES["relations"] = QUERIES.pop("relations_word")


@_raw
def relations_lemgram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture(relations.word_picture(_found(spark, sf_dir, lemgram=True)))


@_raw
def relations_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture(relations.word_picture(_found(spark, sf_dir, min_freq=3)))


@_raw
def relations_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture(relations.word_picture(_found(spark, sf_dir)))


@_raw
def relations_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    picture = relations.word_picture(_found(spark, sf_dir, lemgram=True))
    return _picture(relations.strongest(picture, "the", lemgram=True, n=15))


@_raw
def relations_top_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture(relations.strongest(relations.word_picture(_found(spark, sf_dir)), "the", sort="freq", n=10))


def _sentences(spark: SparkSession, sf_dir: str) -> tuple[Corpora, DataFrame]:
    text = prepare(spark, sf_dir, "text")
    asked = tables.word_pictures(spark, sf_dir).by_head.filter((F.col("head") == "the") & (F.col("rel") == "R1") & F.col("dep").isin("of", "and") & F.col("bfhead") & F.col("bfdep"))
    return text, relations.relation_sentences(tables.word_pictures(spark, sf_dir).postings, asked)


def _wide(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


@_raw
def relation_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _sentences(spark, sf_dir)
    return _wide(rows.drop("id"), "sent_no", "start", "end")


@_raw
def relation_sentence_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _sentences(spark, sf_dir)
    return relations.sentence_hits(rows)


@_raw
def relation_kwic(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, rows = _sentences(spark, sf_dir)
    lines = relations.sentence_kwic(relations.sentence_page(rows, 10, 59), text)
    match = F.array_join(F.slice("word", F.col("match_start") + 1, F.col("match_end") - F.col("match_start")), " ")
    lines = lines.select("corpus", "text_id", "sent_no", "match_start", "match_end", F.array_join("word", " ").alias("line"), match.alias("match"))
    return _wide(lines, "sent_no", "match_start", "match_end")


@_raw
def lemgram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tables.lemgram_index(spark, sf_dir)
    return lemgram_count(index, ["the", "ion", "ing", "of", "Of", "not-there"], count=["lemgram", "prefix", "suffix"])


QUERIES["lemgram_count"] = QUERIES.pop("lemgram_counts")
