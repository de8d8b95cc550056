"""Line deduplication with a log-template tree.

A line's leaf in the tree is fixed by its number of tokens and its leading tokens; tokens with digits are
variable fields.  Inside a leaf a line joins the first template with which enough positions agree, and the
positions that differ become variable.  A template recurs when it stands in several documents and in several
different texts; its lines are dropped.  Copies and near copies of a text are one text, so that they are left to
the deduplication of documents.

Texts are compared by their templates and, since one edit makes a long line another one, by runs of ``RUN`` words,
too: all of them, or in texts of more than ``WHOLE`` those whose hash falls into a quarter.  Every template or run is led by one text, the one with the least hash that has it.  A text of which other
texts have nearly everything (``TAKEN`` of its words) is a near copy of a leader that has most of that
(``COMMON``); near copies are joined to classes, and a class counts once.  A text with more words of its own counts
by itself, also where a block of many lines is all that it shares with others.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.components import components
from quillspan.llm.tables import settle
from quillspan.llm.words import ROWS, mix, rows, shingles, whole_column, word_codes

LEADING, AGREE, MIN_DOCS = 3, 0.7, 4
TAKEN, COMMON, LED = 3 / 4, 2 / 3, 1 / 8
RUN, WHOLE, PART = 3, 128, 4
ANY = "<*>"
LINES = "doc_id long, text_key long, line_no int, leaf long, line long, n_words int"
_DIGIT = re.compile(r"\d")
#: White space as Python sees it, other than single blanks inside a line and the ends of lines; and digits.
_NOT_PLAIN = r"(?m)  |^ | $|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\p{Nd}"


def masked(line: str) -> list[str]:
    """Tokens, those with digits as variable fields unless they are more than half of the line."""
    tokens = line.split()
    if _DIGIT.search(line):
        fixed = [t if t.isalpha() or not _DIGIT.search(t) else ANY for t in tokens]
        return fixed if 2 * fixed.count(ANY) <= len(fixed) else tokens
    return tokens


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) - 2**63


def _plain(texts: pa.Array) -> list[bool]:
    """Texts without digits whose lines have single blanks between words and no other white space."""
    return pc.invert(pc.match_substring_regex(whole_column(texts), _NOT_PLAIN)).to_pylist()


def _tokens(line: str, plain: bool, leading: int) -> tuple[str, int, list[str]]:
    """The masked line, its number of tokens and the leading ones; a plain line need not be taken apart."""
    if plain:
        return line, line.count(" ") + 1 if line else 0, line.split(" ", leading)[:leading]
    tokens = masked(line)
    return " ".join(tokens), len(tokens), tokens[:leading]


def _lines(leading: int, with_text: bool):
    names = ["leaf", "line", "tokens"] if with_text else [f.split()[0] for f in LINES.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string()] if with_text else [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches):
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            doc_ids, texts, keys = (batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "text", "text_key"))
            leaves, lines, wholes, places = [], [], [], []
            for doc_id, text, key, plain in zip(doc_ids.to_pylist(), texts.to_pylist(), keys.to_pylist(), _plain(texts)):
                for no, line in enumerate((text or "").split("\n")):
                    whole, n, first = _tokens(line, plain, leading)
                    if n:
                        leaves.append(_hash(str(n), *first))
                        lines.append(_hash(whole))
                        if with_text:
                            wholes.append(whole)
                        else:
                            places.append((doc_id, key, no, n))
            if lines:
                if with_text:
                    columns = [leaves, lines, wholes]
                else:
                    doc_id, key, no, n = zip(*places)
                    columns = [doc_id, key, no, leaves, lines, n]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


class Templates:
    """Templates of one leaf as rows of token codes; -1 is a variable position."""

    def __init__(self, agree: float):
        self.agree, self.codes, self.rows, self.used = agree, {}, None, 0
        self.names: list[int] = []

    def place(self, name: int, tokens: list[str]) -> int:
        row = np.array([self.codes.setdefault(t, len(self.codes)) for t in tokens], np.int32)
        if self.rows is None:
            self.rows = np.empty((4, len(row)), np.int32)
        if self.used:
            same = (self.rows[: self.used] == row).sum(axis=1)
            best = int(np.argmax(same))
            if same[best] >= self.agree * len(row):
                kept = self.rows[best]
                kept[kept != row] = -1
                return self.names[best]
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[self.used] = row
        self.used += 1
        self.names.append(name)
        return name


def _parse(agree: float):
    """Lines come sorted by leaf; only the templates of the leaf at hand are in memory."""

    def run(batches):
        at, tree = None, None
        for batch in batches:
            out = []
            for where, name, whole in rows([batch], "leaf", "line", "tokens"):
                if where != at:
                    at, tree = where, Templates(agree)
                out.append((name, tree.place(name, whole.split(" "))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["line", "template"])

    return run


def _word_runs(texts: pa.Array) -> list[np.ndarray]:
    """The distinct runs of every text, in order."""
    codes, bounds = word_codes(texts)
    runs, out = shingles(codes, RUN), []
    for a, b in zip(bounds[:-1], bounds[1:]):
        own = np.sort(runs[a : b - RUN + 1] if b - a >= RUN else shingles(codes[a:b], RUN))
        out.append(own[np.append(True, own[1:] != own[:-1])] if len(own) else own)
    return out


def _runs(batches):
    """Runs of every text; with ``n_words`` 0 those that only texts on the other side of ``WHOLE`` are compared with."""
    kind = pa.list_(pa.struct([("template", pa.int64()), ("n_words", pa.int32())]))
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        keys, ends, names, sizes = [], [0], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        texts, all_keys = (batch.column(batch.schema.get_field_index(n)) for n in ("text", "text_key"))
        for found, key in zip(_word_runs(texts), all_keys.to_pylist()):
            if n := len(found):
                parts = [(found, n <= WHOLE)] if n <= 2 * WHOLE else []
                if 2 * n > WHOLE:
                    parts.append((mix(found[found % np.uint64(PART) == 0] + np.uint64(1)), n > WHOLE))
                keys.append(key)
                for run, counts in parts:
                    names.append(run.view(np.int64))
                    sizes.append(np.full(len(run), counts, np.int32))
                ends.append(ends[-1] + sum(len(run) for run, _ in parts))
        if keys:
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(sizes))], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs, type=kind)], names=["text_key", "runs"])


def leaders(held: DataFrame) -> DataFrame:
    """``template, leader, texts`` of every template of several texts."""
    return settle(held.groupBy("template").agg(F.min("text_key").alias("leader"), F.count("*").alias("texts")).filter("texts > 1"), "held-by")


def near_copies(held: DataFrame, held_by: DataFrame | None = None) -> DataFrame:
    """Links ``src, dst`` from texts to leaders of which they are near copies.

    ``held(template, text_key, n_words)``: distinct templates, or runs, of each text.  Every text is compared with
    a few leaders only, those of at least ``LED`` of its words.
    """
    held_by = leaders(held) if held_by is None else held_by
    led = held.join(held_by.select("template", "leader"), "template").groupBy("text_key", "leader").agg(F.sum("n_words").alias("led"))
    words = held.groupBy("text_key").agg(F.sum("n_words").alias("words"))
    taken = led.groupBy("text_key").agg(F.sum("led").alias("taken")).filter("taken > 0")
    whole = taken.join(words, "text_key").filter(F.col("taken") >= TAKEN * F.col("words"))
    near = led.filter("leader <> text_key").join(whole, "text_key")
    near = settle(near.filter(F.col("led") >= LED * F.col("words")).select("text_key", "leader", "taken"), "near")
    of_leader = held.select(F.col("text_key").alias("leader"), "template").join(near.select("leader").distinct(), "leader", "left_semi")
    both = near.join(held, "text_key").join(of_leader, ["leader", "template"]).groupBy("text_key", "leader", "taken").agg(F.sum("n_words").alias("common"))
    return both.filter(F.col("common") >= COMMON * F.col("taken")).select(F.col("text_key").alias("src"), F.col("leader").alias("dst"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, agree: float = AGREE, leading: int = LEADING) -> DataFrame:
    """``doc_id, text_key, line_no, template`` of every line to drop; ``docs`` has ``doc_id, text, text_key``."""
    lines = settle(docs.mapInArrow(_lines(leading, False), LINES), "lines")
    leaves = lines.select("leaf", "doc_id").distinct().groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("leaf")
    texts = docs.mapInArrow(_lines(leading, True), "leaf long, line long, tokens string")
    distinct = texts.join(leaves, "leaf", "left_semi").groupBy("leaf", "line").agg(F.min("tokens").alias("tokens"))
    templates = distinct.repartition("leaf").sortWithinPartitions("leaf", "line").mapInArrow(_parse(agree), "line long, template long")
    known = settle(lines.join(templates, "line", "left").withColumn("template", F.coalesce("template", "line")).drop("leaf", "line"), "templates")
    in_docs = known.select("template", "doc_id").distinct().groupBy("template").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    held = settle(known.groupBy("template", "text_key").agg(F.max("n_words").alias("n_words")), "held")
    held_by = leaders(held)
    often = held_by.filter(F.col("texts") >= min_docs).join(in_docs, "template").select("template")
    voting = settle(held.join(often, "template", "left_semi"), "voting")
    asked = voting.select("text_key").distinct()
    runs = docs.mapInArrow(_runs, "text_key long, runs array<struct<template:long,n_words:int>>").join(asked, "text_key", "left_semi")
    runs = runs.groupBy("text_key").agg(F.any_value("runs").alias("runs")).select("text_key", F.inline("runs"))
    links = near_copies(held, held_by).unionByName(near_copies(settle(runs, "runs")))
    classes = components(settle(links, "copies")).select(F.col("node").alias("text_key"), F.col("component").alias("class"))
    voting = voting.join(classes, "text_key", "left")
    votes = voting.select("template", F.coalesce("class", "text_key").alias("class")).distinct()
    drop = votes.groupBy("template").agg(F.count("*").alias("classes")).filter(F.col("classes") >= min_docs).select("template")
    return known.select("doc_id", "text_key", "line_no", "template").join(drop, "template", "left_semi")


def without_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, agree: float = AGREE, leading: int = LEADING) -> DataFrame:
    """The rows of ``docs`` with their recurring lines cut out of ``text``, and two more columns.

    ``_lines`` is the number of lines of the text, ``_dropped`` the numbers of the dropped ones.  Every row and
    every other column stays as it is, also when no line is left.

    ``min_docs``: documents in which a template must stand, and different texts, near copies being one text.
    Blank lines belong to no template and are never dropped.  A null text stays null, with 0 lines; an empty one
    has one line.  Rows that repeat a doc_id are one document for counting, and a null doc_id counts as one
    document; equal rows get equal results.  An empty table gives no rows.
    """
    text_key = F.xxhash64(F.col("text"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key.alias("text_key"))
    found = recurring_lines(keyed, min_docs, agree, leading).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line_no")).alias("_dropped"))
    found = found.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "_dropped")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (text_key == F.col("_key"))
    out = docs.join(found, same, "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_dropped", i)), "\n")
    columns = [F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    none = F.array().cast("array<int>")
    return out.select(*columns, F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("_lines"), F.coalesce("_dropped", none).alias("_dropped"))
