"""Regions of any kind as rows to be searched: cut into blocks of bounded size, with the words around them.

An ``Area`` says which regions a match must stay in.  Sentence rows are cut where regions begin and end, the pieces of
a region are gathered by block, and a block also holds the next few tokens of its region, so that every match of
bounded length lies in the row of the block it starts in.  No row holds an unbounded region.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillspan.sources.corpora import EDGE_WORDS, Corpora

BLOCK_TOKENS = 4096

# Pieces of sentences and regions meet by equality on stretches of this many tokens.
STRETCH = 256

# Columns of a match that the sort by neighbouring words reads.
AROUND = ("words_before", "words_after")


# Stands between the values of a piece where they are shuffled as one string.
BETWEEN = "\u0001"


def sentence_regions(corpora: Corpora) -> DataFrame:
    """The stored rows: a sentence is a region and owns all of its start positions."""
    return corpora.sentences.withColumns({"region_off": F.col("sent_off"), "home": F.col("n")})


def stretches(first: Column, last: Column, size: int = STRETCH) -> Column:
    """The numbers of all stretches that touch ``first`` to ``last``."""
    return F.sequence(F.floor(first / size), F.floor(last / size))


def cut(columns: Sequence[str], lo: Column, hi: Column, around: bool) -> list[Column]:
    """Tokens ``lo`` to ``hi`` (exclusive) of a piece, and with ``around`` the words next to them."""
    out = [F.slice(c, lo + 1, hi - lo).alias(c) for c in columns]
    if around:
        near, at = F.concat("words_before", "word", "words_after"), F.size("words_before") + lo
        out.append(F.slice(near, F.greatest(at - EDGE_WORDS, F.lit(0)) + 1, F.least(at, F.lit(EDGE_WORDS))).alias("words_before"))
        out.append(F.slice(near, at + (hi - lo) + 1, F.lit(EDGE_WORDS)).alias("words_after"))
    return out


def _joined(attr: str) -> list[Column]:
    """Strings of a piece as one string, a third of the array in a shuffle; as they are, where one is null or holds the mark between them."""
    plain = ~F.exists(attr, lambda x: x.isNull() | x.contains(BETWEEN))
    return [F.when(plain, F.array_join(attr, BETWEEN)).alias(attr), F.when(~plain, F.col(attr)).alias(f"_raw_{attr}")]


def _parted(pieces: str, attr: str) -> Column:
    return F.transform(pieces, lambda p: F.coalesce(F.split(p[attr], BETWEEN), p[f"_raw_{attr}"]))


@dataclass(frozen=True)
class Area:
    """Regions of one kind.

    ``owner`` are the columns that tell them apart; with ``_base`` among them, offsets count from there.  Offsets of
    areas that are not ``in_text`` are corpus positions.
    """

    corpora: Corpora
    kind: str | None
    owner: tuple[str, ...]
    in_text: bool

    def pieces(self, attrs: Sequence[str], structs: Sequence[str], around: bool) -> DataFrame:
        """``*owner, *structs, _place, n, *attrs``: parts of sentences with their offset in the region."""
        c, near = self.corpora, list(AROUND) if around else []
        if self.kind == "text":
            return c.sentences.select(*self.owner, *structs, F.col("sent_off").alias("_place"), "n", *attrs, *near)
        if self.kind == "sentence":
            return c.sentences.select("corpus", "text_id", "sent_no", F.col("sent_off").alias("_base"), *structs, F.lit(0).cast("bigint").alias("_place"), "n", *attrs, *near)
        rows = c.sentences if self.in_text else c.positioned()
        if around and not self.in_text:
            rows = _known_across_texts(rows, c)
        place = F.col("sent_off") if self.in_text else F.col("start_pos")
        if self.kind is None:
            return rows.select("corpus", *structs, place.alias("_place"), "n", *attrs, *near)
        return self._cut_at_edges(rows, place, attrs, structs, around)

    def _cut_at_edges(self, rows: DataFrame, place: Column, attrs: Sequence[str], structs: Sequence[str], around: bool) -> DataFrame:
        keys = ["corpus", "text_id"] if self.in_text else ["corpus"]
        near = list(AROUND) if around else []
        rows = rows.select(*keys, *structs, place.alias("_at"), "n", *attrs, *near, F.explode(stretches(place, place + F.col("n") - 1)).alias("_stretch"))
        lo = F.greatest(F.col("_stretch") * STRETCH - F.col("_at"), F.lit(0)).cast("int")
        hi = F.least((F.col("_stretch") + 1) * STRETCH - F.col("_at"), F.col("n")).cast("int")
        rows = rows.select(*keys, *structs, "_stretch", (F.col("_at") + lo).alias("_at"), (hi - lo).alias("n"), *cut(attrs, lo, hi, around))
        size = F.col("last") - F.col("first")
        first = F.col("off") if self.in_text else F.col("first")
        regions = self.corpora.regions.filter(F.col("kind") == self.kind)
        regions = regions.select(*keys, first.alias("_base"), (first + size + 1).alias("_end"), F.explode(stretches(first, first + size)).alias("_stretch"))
        met = rows.join(regions, [*keys, "_stretch"])
        lo = F.greatest(F.col("_base") - F.col("_at"), F.lit(0)).cast("int")
        hi = F.least(F.col("_end") - F.col("_at"), F.col("n")).cast("int")
        met = met.filter(lo < hi)
        return met.select(*self.owner, *structs, (F.col("_at") + lo - F.col("_base")).alias("_place"), (hi - lo).alias("n"), *cut(attrs, lo, hi, around))

    def blocks(self, attrs: Iterable[str], overlap: int, structs: Sequence[str] = (), block: int = BLOCK_TOKENS, around: bool = False) -> DataFrame:
        """Rows of ``block`` start positions and the ``overlap`` tokens after them."""
        attrs = sorted(attrs)
        structs = [s for s in structs if s not in self.owner] if self.in_text else []
        near = list(AROUND) if around else []
        rows = self.pieces(attrs, structs, around)
        first = F.floor(F.greatest(F.col("_place") - overlap, F.lit(0)) / block)
        last = F.floor((F.col("_place") + F.col("n") - 1) / block)
        pieces = rows.select(*self.owner, *structs, "_place", "n", *attrs, *near, F.explode(F.sequence(first, last)).alias("_block"))
        # A long piece is cut too: each block takes only its own window of it.
        lo = F.greatest(F.col("_block") * block - F.col("_place"), F.lit(0)).cast("int")
        hi = F.least(F.col("_block") * block + block + overlap - F.col("_place"), F.col("n")).cast("int")
        pieces = pieces.filter(lo < hi).select(*self.owner, *structs, "_block", (F.col("_place") + lo).alias("_place"), (hi - lo).alias("_n"), *cut(attrs, lo, hi, around))
        strings = {a for a in attrs if isinstance(pieces.schema[a].dataType, ArrayType) and pieces.schema[a].dataType.elementType == StringType()}
        packed = [c for a in attrs for c in (_joined(a) if a in strings else [F.col(a)])]
        pieces = pieces.select(*[c for c in pieces.columns if c not in attrs], F.struct("_place", *packed, *near).alias("_piece"))
        gathered = pieces.groupBy(*self.owner, "_block").agg(
            F.sort_array(F.collect_list("_piece")).alias("_pieces"), F.sum("_n").cast("int").alias("n"), *[F.first(s).alias(s) for s in structs]
        )
        base = F.col("_base") if "_base" in self.owner else F.lit(0)
        added = {"sent_no": F.lit(0), "text_id": F.lit(None).cast("bigint")}
        out = gathered.select(
            *self.owner,
            *structs,
            (base + F.col("_block") * block).cast("bigint").alias("region_off"),
            *[F.flatten(_parted("_pieces", a) if a in strings else F.col("_pieces")[a]).alias(a) for a in attrs],
            *([F.col("_pieces")[0]["words_before"].alias("words_before"), F.element_at("_pieces", -1)["words_after"].alias("words_after")] if around else []),
            *[v.alias(k) for k, v in added.items() if k not in self.owner],
            "n",
        )
        if around and not self.in_text:
            out = out.withColumn("text_n", F.lit(None).cast("bigint"))
        return out.withColumn("home", F.least(F.lit(block), F.col("n")))


def _known_across_texts(rows: DataFrame, corpora: Corpora) -> DataFrame:
    """Sentence rows whose words around don't end with the text."""
    rows = rows.join(corpora.neighbours(), ["corpus", "text_id"])
    before, after = F.concat("before_words", "words_before"), F.concat("words_after", "after_words")
    skipped = F.greatest(F.size(before) - EDGE_WORDS, F.lit(0))
    near = {"words_before": F.slice(before, skipped + 1, F.lit(EDGE_WORDS)), "words_after": F.slice(after, 1, EDGE_WORDS)}
    return rows.withColumns(near).drop("before_words", "after_words")


def area(corpora: Corpora, within: str | None) -> Area:
    """The area of a kind of region; ``None`` is the whole corpus, ``ValueError`` for a kind that the corpora lack."""
    if within is None:
        return Area(corpora, None, ("corpus",), False)
    if within == "text":
        return Area(corpora, "text", ("corpus", "text_id"), True)
    if within == "sentence":
        return Area(corpora, "sentence", ("corpus", "text_id", "sent_no", "_base"), True)
    if within in corpora.inside:
        return Area(corpora, within, ("corpus", "text_id", "_base"), True)
    if within in corpora.across:
        return Area(corpora, within, ("corpus", "_base"), False)
    raise ValueError(f"unknown region {within!r}")


def at_position(rows: DataFrame, corpora: Corpora, kind: str, position: str) -> DataFrame:
    """Rows with the region of the kind that holds a corpus position, as ``no, off, first, last, value`` and its ``text_id``
    as ``region_text``; rows outside any are left out."""
    regions = corpora.regions.filter(F.col("kind") == kind)
    regions = regions.select("corpus", "no", F.col("text_id").alias("region_text"), "off", "first", "last", "value", F.explode(stretches(F.col("first"), F.col("last"), BLOCK_TOKENS)).alias("_stretch"))
    met = rows.withColumn("_stretch", F.floor(F.col(position) / BLOCK_TOKENS)).join(regions, ["corpus", "_stretch"])
    return met.filter(F.col(position).between(F.col("first"), F.col("last"))).drop("_stretch")
