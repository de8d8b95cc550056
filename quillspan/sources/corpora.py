"""Corpus tables: raw tables in, ``texts`` / ``sentences`` / ``regions`` / ``info`` out.

Layout.  One row per sentence with one array column per token attribute.  A query that needs
one attribute reads one column, and a match inside a sentence never needs a join.  Structural
attributes are repeated on the sentence rows, where Parquet stores them as dictionary runs, so
counting by them needs no join either.  Sentence rows carry only their offset inside the text;
the corpus position of a text is kept on ``texts``, so no payload is shuffled to number it.

Files hold stretches of corpus and text, in order: what is looked up for a few texts skips all other row groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.calendar import truncate
from quillspan.operators.running import running_by_file
from quillspan.session import shared_folder

# What counts as a sentence, as a token, and as an undefined value.
SENTENCE = r"[^.!?\n]+"
TOKEN = r"[\p{L}\p{N}]+"
UNDEFINED = "__UNDEF__"

# How many words around a sentence are kept with it, for sorting by neighbouring words.
EDGE_WORDS = 3

# Corpus positions in which texts meet their neighbours at a time.
EDGE_BLOCK = 1 << 16

# Ranges of text ids in a filter, for each corpus.
RANGES = 32

# Row groups of the sentence files: small enough to be read for one text.
ROW_GROUP = 16 << 20

# Of the files that are kept: a third smaller than Spark's own choice.
COMPRESSION = "zstd"

# Corpora that a task writes without sorting its rows by corpus; beyond, Spark sorts the rest.
WRITERS = 32


@dataclass(frozen=True)
class Corpora:
    """A set of corpora over the same attributes."""

    sentences: DataFrame
    texts: DataFrame
    info: DataFrame
    attrs: tuple[str, ...]
    structs: tuple[str, ...]
    spans: DataFrame | None = None
    """Tokens per dated span, where that table has been written."""
    regions: DataFrame | None = None
    """Other regions than sentences and texts: ``corpus, kind, no, text_id, off, first, last, value``.

    ``first`` and ``last`` are corpus positions, ``off`` is the offset of ``first`` in the text ``text_id``; regions
    of one kind don't overlap.  ``no`` counts them in their text or, for kinds that run over texts, in their corpus."""
    inside: tuple[str, ...] = ()
    """Kinds of regions that end with their text."""
    across: tuple[str, ...] = ()
    """Kinds of regions that may hold several texts."""

    def select(self, names: Iterable[str] | str) -> Corpora:
        """Keep the named corpora; names are upper-cased, unknown ones are skipped."""
        keep = F.col("corpus").isin(parse_corpora(names))
        return self.mapped(lambda df: df.filter(keep))

    def mapped(self, change: Callable[[DataFrame], DataFrame]) -> Corpora:
        """The same change made to every table."""
        spans, regions = (None if df is None else change(df) for df in (self.spans, self.regions))
        return replace(self, sentences=change(self.sentences), texts=change(self.texts), info=change(self.info), spans=spans, regions=regions)

    def only(self, texts: Iterable[tuple[str, int]]) -> Corpora:
        """Sentences and texts of a few texts, and perhaps of some between them: what it skips is not read."""
        near = near_texts(texts)
        return replace(self, sentences=self.sentences.filter(near), texts=self.texts.filter(near))

    def where(self, condition: Column) -> Corpora:
        """Structural condition.  Sizes in ``info`` stay those of the whole corpora."""
        return replace(self, sentences=self.sentences.filter(condition))

    def tokens(self, *attrs: str, structs: Iterable[str] = ()) -> DataFrame:
        """One row per token, with only the columns asked for."""
        attrs = attrs or ("word",)
        base = ["corpus", "text_id", "sent_no", "sent_off", *structs]
        # By position, not by the first attribute: a corpus that lacks an attribute keeps its tokens.
        rows = self.sentences.filter(F.col("n") > 0).select(*base, *[F.col(a).alias(f"_{a}") for a in attrs], positions(F.col("n")).alias("i"))
        return rows.select(*base, "i", *[F.get(F.col(f"_{a}"), F.col("i")).alias(a) for a in attrs])

    def positioned(self, sentences: DataFrame | None = None) -> DataFrame:
        """Sentences with ``start_pos``, their first corpus position."""
        starts = self.texts.select("corpus", "text_id", F.col("start_pos").alias("_t"))
        rows = self.sentences if sentences is None else sentences
        return rows.join(starts, ["corpus", "text_id"]).withColumn("start_pos", F.col("_t") + F.col("sent_off")).drop("_t")

    def neighbours(self) -> DataFrame:
        """``corpus, text_id, before_words, after_words``: the words next to each text, in corpus order, across texts."""
        if "before_words" in self.texts.columns:
            return self.texts.select("corpus", "text_id", "before_words", "after_words")
        return neighbour_words(self.sentences, self.texts)


def near_texts(texts: Iterable[tuple[str, int]]) -> Column:
    """A condition on ``corpus`` and ``text_id`` that skips row groups: at most ``RANGES`` ranges of ids for a corpus.

    It holds for all of the given texts; what is wanted exactly is joined afterwards.
    """
    by_corpus: dict[str, list[int]] = {}
    for corpus, text_id in texts:
        by_corpus.setdefault(corpus, []).append(text_id)
    near = F.lit(False)
    for corpus, ids in sorted(by_corpus.items()):
        within = F.lit(False)
        for first, last in _ranges(ids):
            within = within | F.col("text_id").between(first, last)
        near = near | ((F.col("corpus") == corpus) & within)
    return F.col("corpus").isin(sorted(by_corpus)) & near


def _ranges(ids: Iterable[int]) -> list[tuple[int, int]]:
    """Few ranges that cover all ids, parted at the widest gaps."""
    ids = sorted(set(ids))
    cuts = sorted(sorted(range(1, len(ids)), key=lambda i: ids[i] - ids[i - 1])[-RANGES + 1 :])
    return [(ids[a], ids[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(ids)])]


def positions(n: Column) -> Column:
    """One row per offset from 0 to n - 1; n is at least 1."""
    return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))


def parse_corpora(names: Iterable[str] | str) -> list[str]:
    """Upper-cased, sorted and unique corpus names from a list or a comma-separated string."""
    if isinstance(names, str):
        names = names.split(",")
    return sorted({n.upper() for n in names})


def union(*parts: Corpora) -> Corpora:
    """Corpora with different attributes side by side; an attribute a corpus lacks is null.

    Regions of a kind that only some corpora have are kept; the others have none of it.
    """
    first, *rest = parts
    for p in rest:
        first = Corpora(
            first.sentences.unionByName(p.sentences, allowMissingColumns=True),
            first.texts.unionByName(p.texts, allowMissingColumns=True),
            first.info.unionByName(p.info, allowMissingColumns=True),
            tuple(dict.fromkeys(first.attrs + p.attrs)),
            tuple(dict.fromkeys(first.structs + p.structs)),
            regions=p.regions if first.regions is None else first.regions if p.regions is None else first.regions.unionByName(p.regions),
            inside=tuple(dict.fromkeys(first.inside + p.inside)),
            across=tuple(dict.fromkeys(first.across + p.across)),
        )
    return first


# --------------------------------------------------------------------------------------
# text → sentences


def neighbour_words(sentences: DataFrame, texts: DataFrame) -> DataFrame:
    """``corpus, text_id, before_words, after_words`` of every text, at most three words each, in text order.

    Only the words with which texts begin and end are shuffled, once for each text.  They meet by their corpus position, in
    blocks of positions, so any number of texts without words may lie between two others.
    """
    off, rest = F.col("sent_off"), F.col("text_n") - F.col("sent_off")
    head = F.slice("word", 1, (F.lit(EDGE_WORDS) - off).cast("int"))
    left = F.greatest(rest - EDGE_WORDS, F.lit(0)).cast("int")  # words of the sentence before the last ones of the text
    tail = F.slice("word", left + 1, F.size("word"))
    kept = sentences.filter((off < EDGE_WORDS) | (off + F.col("n") > F.col("text_n") - EDGE_WORDS)).filter("n > 0")

    def joined(near: Column, words: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(near, F.struct("sent_off", words.alias("words")))))["words"]

    edges = kept.groupBy("corpus", "text_id").agg(
        joined(off < EDGE_WORDS, head).alias("_head"), joined(off + F.col("n") > F.col("text_n") - EDGE_WORDS, tail).alias("_tail")
    )
    starts = texts.select("corpus", "text_id", "start_pos", (F.col("start_pos") + F.col("n_tokens")).alias("_end"))
    begins = F.struct(F.col("start_pos").alias("_p"), F.lit(True).alias("_begins"), F.flatten("_head").alias("_words"))
    ends = F.struct(F.col("_end").alias("_p"), F.lit(False).alias("_begins"), F.flatten("_tail").alias("_words"))
    places = starts.join(edges, ["corpus", "text_id"], "left").select("corpus", "text_id", F.inline(F.array(begins, ends)))
    # Places next to the edge of a block are seen from the other side, too.
    block = F.floor(F.col("_p") / F.lit(EDGE_BLOCK))
    near = [F.floor((F.col("_p") + d) / F.lit(EDGE_BLOCK)) for d in (1 - EDGE_WORDS, EDGE_WORDS - 1)]
    places = places.withColumn("_own", block).withColumn("_block", F.explode(F.array_distinct(F.array("_own", *near))))
    of_block = Window.partitionBy("corpus", "_block").orderBy("_p")
    before = F.flatten(F.collect_list(F.when(~F.col("_begins"), F.col("_words"))).over(of_block.rangeBetween(1 - EDGE_WORDS, 0)))
    after = F.flatten(F.collect_list(F.when(F.col("_begins"), F.col("_words"))).over(of_block.rangeBetween(0, EDGE_WORDS - 1)))
    found = places.withColumns({"_before": before, "_after": after}).filter(F.col("_own") == F.col("_block"))
    words = F.when(F.col("_begins"), F.slice("_before", F.greatest(F.size("_before") - EDGE_WORDS, F.lit(0)) + 1, F.lit(EDGE_WORDS)))
    found = found.select("corpus", "text_id", words.alias("_before"), F.when(~F.col("_begins"), F.slice("_after", 1, EDGE_WORDS)).alias("_after"))
    first = {"_before": "before_words", "_after": "after_words"}
    return found.groupBy("corpus", "text_id").agg(*[F.first(c, ignorenulls=True).alias(name) for c, name in first.items()])


def tokenise(texts: DataFrame) -> DataFrame:
    """Sentences of ``texts(corpus, text_id, text, …)``, empty ones left out; ``line_no`` counts lines with words."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda line: F.filter(
            F.transform(F.regexp_extract_all(line, F.lit(SENTENCE), F.lit(0)), lambda p: F.regexp_extract_all(p, F.lit(TOKEN), F.lit(0))),
            lambda w: F.size(w) > 0,
        ),
    )
    keep = [c for c in texts.columns if c != "text"]
    # explode(array(x)) makes x a column of its own, so the regular expressions run once per text.
    rows = texts.select(*keep, F.explode(F.array(F.filter(lines, lambda line: F.size(line) > 0))).alias("_lines"))
    numbers = F.flatten(F.transform("_lines", lambda line, i: F.array_repeat(i, F.size(line))))
    rows = rows.select(*keep, F.flatten("_lines").alias("_sents"), F.explode(F.array(numbers)).alias("_of_line"))
    offsets = F.aggregate(
        F.col("_sents"),
        F.array(F.lit(0)),
        lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + F.size(w))),
    )
    rows = rows.select(*keep, "_sents", "_of_line", F.flatten("_sents").alias("_flat"), F.explode(F.array(offsets)).alias("_offs"))
    rows = rows.select(*keep, "_flat", "_offs", "_of_line", F.posexplode("_sents").alias("sent_no", "word"))
    off, n, line = F.get("_offs", F.col("sent_no")), F.size("word"), F.get("_of_line", F.col("sent_no"))
    rows = rows.select(*keep, "_flat", "sent_no", "word", off.alias("sent_off"), n.alias("n"), line.alias("line_no"))
    before = F.least(F.lit(EDGE_WORDS), F.col("sent_off"))
    after = F.col("sent_off") + F.col("n")
    return rows.select(
        *keep,
        "sent_no",
        "line_no",
        F.col("sent_off").cast("bigint").alias("sent_off"),
        "n",
        F.size("_flat").cast("bigint").alias("text_n"),
        "word",
        F.slice("_flat", F.col("sent_off") - before + 1, before).alias("words_before"),
        F.slice("_flat", after + 1, F.lit(EDGE_WORDS)).alias("words_after"),
    )


def annotate_words(sentences: DataFrame) -> DataFrame:
    """Token attributes derived from the word: lemma, pos, sense, and the value set lex.

    Lower case is made of all words at once, joined by a blank, which no word has; parts of speech once per word.
    """
    pos = F.transform("word", lambda w: F.when(w.rlike(r"^\p{Lu}"), "CAP").when(w.rlike(r"^\p{N}+$"), "NUM").otherwise("LOW"))
    lemma = F.split(F.lower(F.array_join("word", " ")), " ")
    # explode(array(x)) makes x a column of its own, so it is worked out once.
    rows = sentences.select("*", F.explode(F.array(lemma)).alias("lemma")).select("*", F.explode(F.array(pos)).alias("pos"))

    def sense(lemma: Column, pos: Column) -> Column:
        return F.when(pos == "CAP", F.concat(lemma, F.lit(":"), F.length(lemma).cast("string"))).when(pos == "LOW", lemma)

    def lex(lemma: Column, pos: Column) -> Column:
        none, long = F.array().cast("array<string>"), F.length(lemma) > 3
        return F.when(pos == "NUM", none).when(long, F.array(lemma, F.substring(lemma, 1, 3))).otherwise(F.array(lemma))

    return rows.withColumns({"sense": F.zip_with("lemma", "pos", sense), "lex": F.zip_with("lemma", "pos", lex)})


def undefined_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """The marker for "no value" becomes null."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(UNDEFINED)) for c in columns})


# --------------------------------------------------------------------------------------
# the corpora of the given tables


def _by_text(texts: DataFrame, *within: str) -> DataFrame:
    """Stretches of corpus and text in order, made before the texts are tokenised, while the rows are still small.

    A corpus that is too large for one task fills several; every task writes few corpora.
    """
    return texts.repartitionByRange("corpus", "text_id").sortWithinPartitions("corpus", "text_id", *within)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table; the marker for "no value" in its strings becomes null."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return undefined_to_null(df, *[c for c, kind in df.dtypes if kind == "string"])


def _text_corpora(spark: SparkSession, sf_dir: str, staging: str) -> tuple[DataFrame, DataFrame]:
    labels = _read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("text_id"),
        F.col("quality").cast("string").alias("text_quality"),
        F.col("toxic").cast("string").alias("text_toxic"),
    )
    docs = _read(spark, sf_dir, "documents").select(
        F.upper("source").alias("corpus"), F.col("doc_id").alias("text_id"), F.col("lang").alias("text_lang"), "text"
    )
    no_date = F.lit(None).cast("timestamp_ntz")
    dated = {"datefrom": no_date, "dateto": no_date}
    sentences = annotate_words(tokenise(_by_text(docs.join(labels, "text_id", "left"))))
    texts = docs.drop("text").join(labels, "text_id", "left")
    return sentences.withColumns(dated), texts.withColumns(dated)


def _conversation_corpora(spark: SparkSession, sf_dir: str, staging: str) -> tuple[DataFrame, DataFrame]:
    """One text per turn and one corpus per role, so a long conversation stays spread out.

    Texts are numbered in the order of conversation and turn, whatever their values; repeated turns are texts of
    their own.  A user turn and the assistant turn that follows it share a ``link_id``.
    """
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").withColumns({"_all": F.lit(0), "_one": F.lit(1)})
    order = [F.col(c) for c in ("conv_id", "turn", "role", "text")]
    turns = running_by_file(turns, ["_all"], order, "_one", "text_id", f"{staging}/turns")
    asked = F.when(F.col("role") == "user", F.col("turn")).when(F.col("role") == "assistant", F.col("turn") - 1)
    texts = turns.select(
        F.concat(F.lit("CONV-"), F.upper(F.coalesce("role", F.lit("unknown")))).alias("corpus"),
        "text_id",
        F.col("role").alias("text_role"),
        F.col("conv_id").cast("string").alias("text_conv"),
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), asked.cast("string")).alias("link_id"),
        "text",
    )
    sentences = annotate_words(tokenise(_by_text(texts)))
    return sentences, texts.drop("text")


def _event_corpora(spark: SparkSession, sf_dir: str, staging: str) -> tuple[DataFrame, DataFrame]:
    """One text of one token per event, dated by its instant."""
    instant = F.col("ts").cast("timestamp_ntz")
    texts = _read(spark, sf_dir, "events").select(
        F.lit("EVT").alias("corpus"),
        F.col("event_id").alias("text_id"),
        F.col("user_id").cast("string").alias("text_user"),
        instant.alias("datefrom"),
        instant.alias("dateto"),
        "event_type",
        "value",
    )
    sign = F.when(F.col("value") > 10, "POS").when(F.col("value") < 10, "NEG").otherwise("ZERO")
    empty = F.array().cast("array<string>")
    sentences = texts.select(
        "corpus", "text_id", "text_user", "datefrom", "dateto",
        F.lit(0).alias("sent_no"), F.lit(0).cast("bigint").alias("sent_off"), F.lit(1).alias("n"),
        F.lit(1).cast("bigint").alias("text_n"),
        F.array("event_type").alias("word"), F.array(sign).alias("pos"),
        empty.alias("words_before"), empty.alias("words_after"),
    )
    return sentences.sortWithinPartitions("corpus", "text_id"), texts.drop("event_type", "value")


def _order_corpora(spark: SparkSession, sf_dir: str, staging: str) -> tuple[DataFrame, DataFrame]:
    """One text per order, dated from first to last ship date; every line item is a sentence.

    Line items come in order once, in the stretches in which they are written; numbers, sizes and dates of their order are
    taken there, by windows that need no other shuffle and no row that holds an order.
    """
    orders = _read(spark, sf_dir, "orders").select(
        F.upper("o_orderpriority").alias("corpus"), F.col("o_orderkey").alias("text_id"), F.col("o_orderstatus").alias("text_status")
    )
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    items = _read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "text_id").select("text_id", *order, "l_returnflag")
    rows = items.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").join(orders, "text_id")
    whole = Window.partitionBy("corpus", "text_id")
    dated, date = F.col("text_id") % 50 != 0, F.col("l_shipdate").cast("timestamp_ntz")
    off = F.row_number().over(whole.orderBy(*order)) - 1
    empty = F.array().cast("array<string>")
    sentences = _by_text(rows.drop("p_partkey"), *order).select(
        "corpus", "text_id", "text_status",
        F.when(dated, F.min(date).over(whole)).alias("datefrom"), F.when(dated, F.max(date).over(whole)).alias("dateto"),
        off.cast("int").alias("sent_no"), off.cast("bigint").alias("sent_off"), F.lit(1).alias("n"), F.count("*").over(whole).alias("text_n"),
        F.array("p_name").alias("word"), F.array("p_brand").alias("lemma"), F.array("l_returnflag").alias("pos"),
        empty.alias("words_before"), empty.alias("words_after"),
    )
    return sentences, orders


# --------------------------------------------------------------------------------------
# regions


def line_regions(c: Corpora) -> DataFrame:
    """The lines of every text that hold words; their value is their number."""
    lines = c.sentences.groupBy("corpus", "text_id", F.col("line_no").alias("no")).agg(F.min("sent_off").alias("off"), F.sum("n").alias("_size"))
    rows = lines.join(c.texts.select("corpus", "text_id", "start_pos"), ["corpus", "text_id"])
    first = F.col("start_pos") + F.col("off")
    return rows.select(
        "corpus", F.lit("line").alias("kind"), F.col("no").cast("bigint").alias("no"), "text_id", "off",
        first.alias("first"), (first + F.col("_size") - 1).alias("last"), F.col("no").cast("string").alias("value"),
    )


def conversation_regions(c: Corpora) -> DataFrame:
    """The texts of one conversation, which follow each other in the corpus of their role."""
    texts = c.texts.filter("n_tokens > 0 AND text_conv IS NOT NULL")
    found = texts.groupBy("corpus", F.col("text_conv").alias("value")).agg(
        F.min("text_id").alias("text_id"), F.min("start_pos").alias("first"), F.max(F.col("start_pos") + F.col("n_tokens") - 1).alias("last")
    )
    zero = F.lit(0).cast("bigint")
    return found.select("corpus", F.lit("conversation").alias("kind"), "text_id", zero.alias("off"), "first", "last", "value", F.lit(1).alias("_one"))


@dataclass(frozen=True)
class _Kind:
    build: Callable[[SparkSession, str, str], tuple[DataFrame, DataFrame]]
    attrs: tuple[str, ...]
    structs: tuple[str, ...]
    inside: dict[str, Callable[[Corpora], DataFrame]] = field(default_factory=dict)
    across: dict[str, Callable[[Corpora], DataFrame]] = field(default_factory=dict)


KINDS = {
    "text": _Kind(_text_corpora, ("word", "lemma", "pos", "sense", "lex"), ("text_lang", "text_quality", "text_toxic"), {"line": line_regions}),
    "conversation": _Kind(
        _conversation_corpora, ("word", "lemma", "pos", "sense", "lex"), ("text_role", "text_conv"), {"line": line_regions}, {"conversation": conversation_regions}
    ),
    "event": _Kind(_event_corpora, ("word", "pos"), ("text_user",)),
    "order": _Kind(_order_corpora, ("word", "lemma", "pos"), ("text_status",)),
}

_PREPARED: dict[tuple[str, str, str], str] = {}


def prepare(spark: SparkSession, sf_dir: str, kind: str = "text") -> Corpora:
    """Corpus tables of one kind, written once per application and read back afterwards."""
    spec = KINDS[kind]
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _PREPARED:
        path = f"{shared_folder(spark)}/corpora/{kind}-{uuid.uuid4().hex}"
        write(spark, *spec.build(spark, sf_dir, f"{path}/staging"), path)
        if spec.inside or spec.across:
            write_regions(read(spark, path, spec.attrs, spec.structs), path, spec.inside, spec.across)
        _PREPARED[key] = path
    return read(spark, _PREPARED[key], spec.attrs, spec.structs, tuple(spec.inside), tuple(spec.across))


@contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """A setting of the session for one write, put back afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write(spark: SparkSession, sentences: DataFrame, texts: DataFrame, path: str) -> None:
    """Write ``sentences``, ``texts`` with corpus positions and the words around them, and ``info``.

    Texts without dates take those of their sentences, where these have some.

    The sentences come in order.  A sort of rows with all attributes, twenty times their text, would only be spilled;
    so the few corpora of a task are written side by side, which needs none.
    """
    with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", WRITERS):
        sentences.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).option("compression", COMPRESSION).partitionBy("corpus").parquet(f"{path}/sentences")
    written = spark.read.parquet(f"{path}/sentences")
    own = [c for c in ("datefrom", "dateto") if c in written.columns and c not in texts.columns]
    sizes = written.groupBy("corpus", "text_id").agg(
        *[F.min(c).alias(c) for c in own], F.sum("n").alias("n_tokens"), F.count("*").alias("n_sents"), F.max("n").alias("longest")
    )
    sized = texts.join(sizes, ["corpus", "text_id"], "left").fillna(0, ["n_tokens", "n_sents", "longest"])
    running_by_file(sized, ["corpus"], [F.col("text_id")], "n_tokens", "start_pos", f"{path}/staging/texts").write.mode(
        "overwrite"
    ).parquet(f"{path}/staging/placed")
    placed = spark.read.parquet(f"{path}/staging/placed")
    placed.join(neighbour_words(written, placed), ["corpus", "text_id"]).repartitionByRange("corpus", "text_id").sortWithinPartitions(
        "corpus", "text_id"
    ).write.mode("overwrite").parquet(f"{path}/texts")
    info = spark.read.parquet(f"{path}/texts")
    dates = [c for c in ("datefrom", "dateto") if c in info.columns]
    info.groupBy("corpus").agg(
        F.sum("n_tokens").alias("size"),
        F.sum("n_sents").alias("sentences"),
        F.count("*").alias("texts"),
        F.max("longest").alias("longest"),
        *([F.min("datefrom").alias("first_date"), F.max("dateto").alias("last_date")] if dates else []),
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/info")
    if dates:
        token_spans(info).write.mode("overwrite").parquet(f"{path}/spans")


def write_regions(
    corpora: Corpora, path: str, inside: Mapping[str, Callable[[Corpora], DataFrame]], across: Mapping[str, Callable[[Corpora], DataFrame]]
) -> None:
    """Write ``regions``; those that run over texts are numbered by their place in the corpus."""
    kinds = [build(corpora) for build in inside.values()]
    for name, build in across.items():
        kinds.append(running_by_file(build(corpora), ["corpus"], [F.col("first")], "_one", "no", f"{path}/staging/{name}").drop("_one"))
    rows = kinds[0]
    for more in kinds[1:]:
        rows = rows.unionByName(more)
    rows.repartitionByRange("kind", "corpus", "first").sortWithinPartitions("kind", "corpus", "first").write.mode("overwrite").parquet(f"{path}/regions")


def token_spans(texts: DataFrame) -> DataFrame:
    """Tokens per span to the second: ``corpus, datefrom, dateto, tokens``; undated texts under null."""
    ends = [truncate(F.col(c), "s").alias(c) for c in ("datefrom", "dateto")]
    dated = texts.filter(F.col("n_tokens") > 0).select("corpus", *ends, "n_tokens")
    return dated.groupBy("corpus", "datefrom", "dateto").agg(F.sum("n_tokens").alias("tokens"))


def read(
    spark: SparkSession, path: str, attrs: tuple[str, ...], structs: tuple[str, ...], inside: tuple[str, ...] = (), across: tuple[str, ...] = ()
) -> Corpora:
    """Corpus tables from a folder that ``write`` filled."""
    sentences, texts, info = (spark.read.parquet(f"{path}/{name}") for name in ("sentences", "texts", "info"))
    spans = spark.read.parquet(f"{path}/spans") if "datefrom" in texts.columns else None
    regions = spark.read.parquet(f"{path}/regions") if inside or across else None
    return Corpora(sentences, texts, info, attrs, structs, spans, regions, inside, across)
