"""Parallel corpora: links between stretches of two corpora, as conditions and beside concordance lines.

A link is a row ``corpus, first, last, partner, p_first, p_last`` of corpus positions.  Any number of links may hold a
position, so one stretch can be linked with many and many with one.  Positions and links meet by equality on blocks of
positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.kwic import place, tokens_between
from quillspan.operators.regions import BLOCK_TOKENS, stretches
from quillspan.sources.corpora import Corpora

LINK = ("corpus", "first", "last", "partner", "p_first", "p_last")


def by_sentence_order(one: Corpora, other: Corpora) -> DataFrame:
    """Links between the sentences of texts that share a ``link_id``, first with first and so on.

    The last sentence of the text that has fewer is linked with all that are left of the other one.  A text may share
    its ``link_id`` with several; null links nothing.
    """

    def side(c: Corpora, name: str) -> DataFrame:
        names = {k: f"_{name}_{k}" for k in ("corpus", "text_id", "start_pos", "n_tokens", "n_sents")}
        return c.texts.filter("n_tokens > 0").select("link_id", *[F.col(k).alias(v) for k, v in names.items()])

    pairs = side(one, "a").join(side(other, "b"), "link_id").withColumn("_links", F.least("_a_n_sents", "_b_n_sents")).drop("link_id")

    def segments(c: Corpora, name: str, first: str, last: str) -> DataFrame:
        own = {k: F.col(f"_{name}_{k}") for k in ("corpus", "text_id", "start_pos", "n_tokens")}
        sentences = c.sentences.select(F.col("corpus").alias(f"_{name}_corpus"), F.col("text_id").alias(f"_{name}_text_id"), "sent_no", "sent_off", "n")
        rows = sentences.join(pairs, [f"_{name}_corpus", f"_{name}_text_id"]).filter(F.col("sent_no") < F.col("_links"))
        begins = own["start_pos"] + F.col("sent_off")
        ends = F.when(F.col("sent_no") == F.col("_links") - 1, own["start_pos"] + own["n_tokens"] - 1).otherwise(begins + F.col("n") - 1)
        return rows.select("_a_corpus", "_a_text_id", "_b_corpus", "_b_text_id", "sent_no", begins.alias(first), ends.alias(last))

    keys = ["_a_corpus", "_a_text_id", "_b_corpus", "_b_text_id", "sent_no"]
    met = segments(one, "a", "first", "last").join(segments(other, "b", "p_first", "p_last"), keys)
    return met.select(F.col("_a_corpus").alias("corpus"), "first", "last", F.col("_b_corpus").alias("partner"), "p_first", "p_last")


def reversed_links(links: DataFrame) -> DataFrame:
    """The same links from the partner's side."""
    return links.select(F.col("partner").alias("corpus"), F.col("p_first").alias("first"), F.col("p_last").alias("last"), F.col("corpus").alias("partner"), F.col("first").alias("p_first"), F.col("last").alias("p_last"))


def _at(rows: DataFrame, links: DataFrame, position: str) -> DataFrame:
    """Rows with every link that holds the position."""
    stretched = links.withColumn("_stretch", F.explode(stretches(F.col("first"), F.col("last"), BLOCK_TOKENS)))
    met = rows.withColumn("_stretch", F.floor(F.col(position) / BLOCK_TOKENS)).join(stretched, ["corpus", "_stretch"])
    return met.filter(F.col(position).between(F.col("first"), F.col("last"))).drop("_stretch")


def _positions(matches: DataFrame, corpora: Corpora) -> DataFrame:
    starts = corpora.texts.select("corpus", "text_id", "start_pos")
    return matches.join(starts, ["corpus", "text_id"]).withColumn("_position", F.col("start_pos") + place()).drop("start_pos")


def linked_matches(matches: DataFrame, corpora: Corpora, partner_matches: DataFrame, partner: Corpora, links: DataFrame) -> DataFrame:
    """Matches that begin in a stretch linked with one in which a match of the partner begins; each once."""
    found = _at(_positions(partner_matches.select("corpus", "text_id", "region_off", "ms"), partner).select("corpus", "_position"), reversed_links(links), "_position")
    wanted = reversed_links(found.select(*LINK)).select("corpus", "first", "last").distinct()
    places = _positions(matches.select("corpus", "text_id", "region_off", "ms"), corpora)
    held = _at(places, wanted, "_position").select("corpus", "text_id", "region_off", "ms").distinct()
    return matches.join(held, ["corpus", "text_id", "region_off", "ms"], "left_semi")


def with_linked(hits: DataFrame, partner: Corpora, links: DataFrame, show: Sequence[str] = ("word",)) -> DataFrame:
    """Page rows with the tokens that the stretches around their position are linked with; null without a link."""
    asked = _at(hits.select("row", "corpus", "position"), links, "position")
    asked = asked.select("row", F.col("partner").alias("corpus"), F.col("p_first").alias("_lo"), (F.col("p_last") + 1).alias("_hi"))
    shown = tokens_between(asked, partner, show)
    rows = hits.join(shown, "row", "left")
    return rows.select(*hits.columns, *[F.col("_line")[a].alias(f"aligned_{a}") for a in dict.fromkeys(["word", *[a for a in show if a in partner.attrs]])])
