"""Concordances: a page of matches, sorted, with context and structural marks.

The page is cut first; positions and context are then looked up for its few rows only, in the row groups of their
texts.  Sort keys come from the match row itself.  Only matches at the very edge of a text need words of a
neighbouring text, which are kept with the texts, and only those rows take the lookup.

Far down the corpus order a page is found by counting: matches per text, added up by file, tell which texts hold the
page, and only these are searched again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.match import hits_per_text
from quillspan.operators.paging import MAX_ROWS, NEAR, check_page, corpora_on_page, numbered, page, settled
from quillspan.operators.regions import at_position
from quillspan.sources.corpora import EDGE_WORDS, Corpora, near_texts

# Fixed value: default context in words.
CONTEXT_WORDS = 10

# Corpus positions are grouped in stretches of this many for looking up what lies around a hit.
STRETCH = 1 << 20


def place() -> Column:
    """Offset of the first matched token in its text; after ``text_id`` it gives corpus order."""
    return F.col("region_off") + F.col("ms")


def needed_for_sort(sort: str | None) -> list[str]:
    """Columns that matches must keep for a sort order."""
    return {
        None: [],
        "random": [],
        "left": ["word", "words_before", "text_n"],
        "right": ["word", "words_after", "text_n"],
        "keyword": ["word"],
    }.get(sort, [sort])


# --------------------------------------------------------------------------------------
# page


def kwic_page(
    matches: DataFrame,
    corpora: Corpora,
    start: int = 0,
    end: int = 9,
    sort: str | None = None,
    seed: str = "",
    collation: str | None = None,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Matches ``start..end``: corpora by name, then sorted within the corpus, then by position.

    ``sort`` is ``left``, ``keyword``, ``right``, ``random`` or a positional attribute.  Adds
    ``row``, the place in the whole result, and ``position``, the corpus position.

    The search runs here; what is then looked up for the page does not repeat it.
    """
    check_page(start, end, max_rows)
    if sort is None and end >= NEAR:
        return with_position(settled(_counted_page(matches, start, end)), corpora)
    rows = matches.withColumn("_sort", F.lit(None).cast("string")) if sort is None else sorted_matches(matches, corpora, sort, seed, collation)
    order = _order()
    rows = numbered(page(rows, order, start, end), order).withColumn("row", F.col("row") + start).drop("_sort")
    return with_position(settled(rows), corpora)


def _order() -> list[Column]:
    return [F.col(c) for c in ("corpus", "_sort", "text_id")] + [place(), F.col("me")]


def _counted_page(matches: DataFrame, start: int, end: int) -> DataFrame:
    """Matches ``start..end`` in corpus order, from the texts that hold them.

    Every text of the page has a match on it, so there are no more of them than rows on the page.
    """
    texts = hits_per_text(matches, ["_all"]).filter((F.col("before") <= end) & (F.col("before") + F.col("hits") > start))
    texts = settled(texts.drop("hits"))
    # The filter goes down to the scan of the sentences.
    rows = matches.filter(near_texts(tuple(r) for r in texts.select("corpus", "text_id").collect()))
    order = Window.partitionBy("corpus", "text_id").orderBy(place(), "me")
    rows = rows.join(texts, ["corpus", "text_id"]).withColumn("row", F.row_number().over(order) - 1 + F.col("before"))
    return rows.filter(F.col("row").between(start, end)).drop("before")


def page_by_hits(matches: DataFrame, corpora: Corpora, hits: DataFrame, start: int = 0, end: int = 9, max_rows: int = MAX_ROWS) -> DataFrame:
    """The same unsorted page when the hits per corpus are known already.

    Only the corpora on the page are searched, then counted by text; each has a row on the page.
    """
    check_page(start, end, max_rows)
    names = [r.corpus for r in corpora_on_page(hits, start, end).collect()]
    if not names:
        return with_position(settled(matches.limit(0).withColumn("row", F.lit(0).cast("bigint"))), corpora)
    before = hits.filter(F.col("corpus") < min(names)).agg(F.coalesce(F.sum("hits"), F.lit(0))).first()[0]
    rows = _counted_page(matches.filter(F.col("corpus").isin(names)), start - before, end - before)
    return with_position(settled(rows.withColumn("row", F.col("row") + before)), corpora)


def with_position(rows: DataFrame, corpora: Corpora) -> DataFrame:
    """Corpus position of the first matched token."""
    starts = corpora.texts.select("corpus", "text_id", "start_pos")
    found = starts.join(rows, ["corpus", "text_id"])
    return found.withColumn("position", F.col("start_pos") + place()).drop("start_pos")


def sample(matches: DataFrame, corpora: Corpora, rows: int = 10, seed: str = "") -> DataFrame:
    """Rows in random order from the first corpus, in random order, that has a match at all."""
    check_page(0, rows - 1)
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("corpus")))
    mixed = sorted_matches(matches, corpora, "random", seed, None).withColumn("_first", key)
    order = [F.col("_first"), *_order()]
    head = numbered(mixed.orderBy(*order).limit(rows), order)
    # The list starts with the chosen corpus; what follows it belongs to later corpora.
    chosen = F.min_by("corpus", "row").over(Window.partitionBy())
    rows = head.withColumn("_c", chosen).filter(F.col("corpus") == F.col("_c")).drop("_c", "_first", "_sort")
    return with_position(settled(rows), corpora)


# --------------------------------------------------------------------------------------
# sort keys


def sorted_matches(matches: DataFrame, corpora: Corpora, sort: str, seed: str, collation: str | None) -> DataFrame:
    if sort == "random":
        key = F.md5(F.concat_ws("|", F.lit(seed), F.col("corpus"), F.col("text_id").cast("string"), place().cast("string")))
        return matches.withColumn("_sort", key)
    if sort in ("left", "right"):
        rows = _neighbour_words(matches, corpora, sort)
    else:
        attr = "word" if sort == "keyword" else sort
        rows = matches.withColumn("_sort", F.slice(attr, F.col("ms") + 1, F.col("me") - F.col("ms") + 1))
    if collation:
        # A control character sorts before all words, so shorter sequences come first.
        rows = rows.withColumn("_sort", F.collate(F.array_join("_sort", "\u0001", ""), collation))
    return rows


def _neighbour_words(matches: DataFrame, corpora: Corpora, side: str) -> DataFrame:
    """``_sort``: the words 1, 2, 3 before the match, or after it; '' beyond the corpus."""
    ks = range(1, EDGE_WORDS + 1)
    if side == "left":

        def near(k: int) -> Column:
            i = F.col("ms") - k
            return F.when(i >= 0, F.get("word", i)).otherwise(F.get("words_before", F.size("words_before") + i))
    else:

        def near(k: int) -> Column:
            i = F.col("me") + k
            return F.when(i < F.size("word"), F.get("word", i)).otherwise(F.get("words_after", i - F.size("word")))

    rows = matches.withColumn("_sort", F.array(*[near(k) for k in ks]))
    # Words beyond the text; a search that runs over texts knows them already, and has no length of its text.
    if side == "left":
        missing = F.when(F.col("text_n").isNotNull(), EDGE_WORDS - place())
    else:
        missing = F.col("region_off") + F.col("me") + 1 + EDGE_WORDS - F.col("text_n")
    reaches_out = F.coalesce(missing > 0, F.lit(False))
    inner = rows.filter(~reaches_out)
    outer = rows.filter(reaches_out).join(corpora.neighbours(), ["corpus", "text_id"])
    if side == "left":
        beyond = [F.get("before_words", F.size("before_words") - (F.lit(k) - place()).cast("int")) for k in ks]
    else:
        beyond = [F.get("after_words", (F.col("region_off") + F.col("me") + k - F.col("text_n")).cast("int")) for k in ks]
    outer = outer.withColumn("_sort", F.array(*[F.coalesce(F.get("_sort", F.lit(k - 1)), beyond[k - 1]) for k in ks])).drop("before_words", "after_words")
    every = inner.unionByName(outer)
    return every.withColumn("_sort", F.transform("_sort", lambda w: F.coalesce(w, F.lit(""))))


# --------------------------------------------------------------------------------------
# context


def context_words(
    hits: DataFrame, corpora: Corpora, left: int = CONTEXT_WORDS, right: int = CONTEXT_WORDS, show: Sequence[str] = ("word",)
) -> DataFrame:
    """Page rows with the tokens around the match, across sentences and texts.

    ``tokens`` is the shown line, ``start``/``end`` the match in it (end exclusive).
    """
    width = F.col("me") - F.col("ms") + 1
    asked = hits.select(
        "row", "corpus", (F.col("position") - left).alias("_lo"), (F.col("position") + width + right).alias("_hi")
    )
    return _lines_between(hits, asked, corpora, show)


def tokens_between(asked: DataFrame, corpora: Corpora, show: Sequence[str] = ("word",)) -> DataFrame:
    """``row, _line``: the tokens from corpus position ``_lo`` to ``_hi`` (exclusive) of each row, each once, in order.

    ``asked`` has ``row, corpus, _lo, _hi``, any number of rows for a ``row`` of one page.
    """
    show = _shown(corpora, show)
    texts = settled(_texts_around(asked, corpora))
    near = corpora.only(tuple(r) for r in texts.select("corpus", "text_id").distinct().collect())  # the texts of one page
    lines = near.sentences.join(texts, ["corpus", "text_id"])
    at = F.col("start_pos") + F.col("sent_off")
    lines = lines.filter((at < F.col("_hi")) & (at + F.col("n") > F.col("_lo")))
    tokens = lines.select("row", "_lo", "_hi", at.alias("_at"), *[F.col(a).alias(f"_{a}") for a in show], F.posexplode("word").alias("_i", "_w"))
    pos = F.col("_at") + F.col("_i")
    tokens = tokens.filter((pos >= F.col("_lo")) & (pos < F.col("_hi")))
    token = F.struct(pos.alias("at"), *[F.get(f"_{a}", F.col("_i")).alias(a) for a in show])
    # A line has as many tokens as its context asks for.
    return tokens.groupBy("row").agg(F.array_sort(F.collect_set(token)).alias("_line"))


def _lines_between(hits: DataFrame, asked: DataFrame, corpora: Corpora, show: Sequence[str]) -> DataFrame:
    """Page rows with the tokens that ``asked`` names as their line."""
    show = _shown(corpora, show)
    width = F.col("me") - F.col("ms") + 1
    rows = hits.join(tokens_between(asked, corpora, show), "row")
    start = (F.col("position") - F.col("_line")[0]["at"]).cast("int")
    return rows.select(
        *hits.columns,
        start.alias("start"),
        (start + width).alias("end"),
        F.transform("_line", lambda t: F.struct(*[t[a].alias(a) for a in show])).alias("tokens"),
    )


def context_regions(hits: DataFrame, corpora: Corpora, kind: str, around: int = 0, show: Sequence[str] = ("word",)) -> DataFrame:
    """Page rows with whole regions of a kind as context: those that the match touches, and ``around`` on each side.

    Kinds that end with their text give no region of another text.  A match outside any region stands alone, and one
    that leaves its region keeps all of its tokens.
    """
    if kind == "sentence":
        return context_sentences(hits, corpora, around, show)
    last = F.col("position") + F.col("me") - F.col("ms")
    ends = hits.select("row", "corpus", F.explode(F.array_distinct(F.array(F.col("position"), last))).alias("_at"))
    met = at_position(ends, corpora, kind, "_at")
    keys = ["corpus", "region_text"] if kind in corpora.inside else ["corpus"]
    # A match that lies in two texts has a stretch of numbers in each.
    numbers = met.groupBy("row", *keys).agg(F.min("no").alias("_a"), F.max("no").alias("_b"))
    wanted = numbers.select("row", *keys, F.explode(F.sequence(F.col("_a") - around, F.col("_b") + around)).alias("no"))
    regions = corpora.regions.filter(F.col("kind") == kind).withColumnRenamed("text_id", "region_text").select(*keys, "no", "first", "last")
    found = regions.join(wanted, [*keys, "no"]).groupBy("row").agg(F.min("first").alias("_first"), F.max("last").alias("_last"))
    asked = hits.select("row", "corpus", "position", last.alias("_end")).join(found, "row", "left")
    # Functions over nulls: a match without a region has its own bounds only.
    asked = asked.select("row", "corpus", F.least("position", "_first").alias("_lo"), (F.greatest("_end", "_last") + 1).alias("_hi"))
    return _lines_between(hits, asked, corpora, show)


def _shown(corpora: Corpora, show: Sequence[str]) -> list[str]:
    """``word`` is always shown; attributes the corpora lack are left out."""
    return ["word", *sorted({a for a in show if a in corpora.attrs} - {"word"})]


def _texts_around(asked: DataFrame, corpora: Corpora) -> DataFrame:
    """Texts that touch the stretch ``[_lo, _hi)`` of a page row, found by equality on stretches."""

    def stretches(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(F.greatest(lo, F.lit(0)) / STRETCH), F.floor((hi - 1) / STRETCH))).alias("_stretch")

    texts = corpora.texts.filter(F.col("n_tokens") > 0)
    ends = F.col("start_pos") + F.col("n_tokens")
    texts = texts.select("corpus", "text_id", "start_pos", "n_tokens", stretches(F.col("start_pos"), ends))
    wanted = asked.select("*", stretches(F.col("_lo"), F.col("_hi")))
    met = texts.join(wanted, ["corpus", "_stretch"])
    met = met.filter((F.col("start_pos") < F.col("_hi")) & (ends > F.col("_lo")))
    return met.select("row", "corpus", "text_id", "start_pos", "_lo", "_hi").distinct()


def context_sentences(hits: DataFrame, corpora: Corpora, around: int = 0, show: Sequence[str] = ("word",)) -> DataFrame:
    """Page rows with whole sentences as context: the match's own, and ``around`` on each side."""
    show = _shown(corpora, show)
    near = _matched_sentences(hits, corpora).select(
        "row", "corpus", "text_id", F.explode(F.sequence(F.col("first") - around, F.col("last") + around)).alias("sent_no")
    )
    of_page = corpora.only(tuple(r) for r in hits.select("corpus", "text_id").distinct().collect())
    lines = of_page.sentences.select("corpus", "text_id", "sent_no", "sent_off", *show)
    lines = lines.join(near, ["corpus", "text_id", "sent_no"])
    shown = lines.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("sent_off", *show))).alias("_lines"))
    rows = hits.join(shown, "row")
    start = (place() - F.col("_lines")[0]["sent_off"]).cast("int")
    rows = rows.select(*hits.columns, start.alias("start"), *[F.flatten(F.col("_lines")[a]).alias(f"_{a}") for a in show])
    tokens = F.transform(
        F.sequence(F.lit(0), F.size("_word") - 1), lambda i: F.struct(*[F.get(f"_{a}", i).alias(a) for a in show])
    )
    return rows.select(
        *hits.columns, "start", (F.col("start") + F.col("me") - F.col("ms") + 1).alias("end"), tokens.alias("tokens")
    )


def _matched_sentences(hits: DataFrame, corpora: Corpora) -> DataFrame:
    """``row, corpus, text_id, first, last``: the sentences of the text that a match of any region touches."""
    spans = hits.select("row", "corpus", "text_id", place().alias("_lo"), (place() + F.col("me") - F.col("ms")).alias("_hi"))
    of_page = corpora.only(tuple(r) for r in hits.select("corpus", "text_id").distinct().collect())
    met = of_page.sentences.select("corpus", "text_id", "sent_no", "sent_off", "n").join(spans, ["corpus", "text_id"])
    met = met.filter((F.col("sent_off") <= F.col("_hi")) & (F.col("sent_off") + F.col("n") > F.col("_lo")))
    return met.groupBy("row", "corpus", "text_id").agg(F.min("sent_no").alias("first"), F.max("sent_no").alias("last"))


def context_by_corpus(
    hits: DataFrame, corpora: Corpora, context: dict[str, str], default: str = "10 words", show: Sequence[str] = ("word",)
) -> DataFrame:
    """Different contexts for different corpora: ``{"A": "1 sentence", "B": "5 words", "C": "2 lines"}``.

    A pair ``("3 words", "8 words")`` gives the left and the right side their own width.
    """
    chosen = {k.upper(): v for k, v in context.items()}
    named = F.col("corpus").isin(list(chosen)) if chosen else F.lit(False)
    parts = [_context(hits.filter(~named), corpora, default, show)]
    parts += [_context(hits.filter(F.col("corpus") == c), corpora, spec, show) for c, spec in chosen.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _context(hits: DataFrame, corpora: Corpora, spec: str | tuple[str, str], show: Sequence[str]) -> DataFrame:
    if isinstance(spec, tuple):
        (left, lu), (right, ru) = (_parse_context(s, corpora) for s in spec)
        if lu != "words" or ru != "words":
            raise ValueError("left and right context are given in words")
        return context_words(hits, corpora, left, right, show)
    n, unit = _parse_context(spec, corpora)
    if unit == "words":
        return context_words(hits, corpora, n, n, show)
    return context_regions(hits, corpora, unit, n - 1, show)


def _parse_context(spec: str, corpora: Corpora) -> tuple[int, str]:
    number, _, unit = spec.partition(" ")
    kinds = {name: kind for kind in ("words", "sentence", *corpora.inside, *corpora.across) for name in (kind, f"{kind}s")}
    unit = kinds.get({"word": "words"}.get(unit, unit), "")
    if not number.isdigit() or not unit:
        raise ValueError(f"malformed context {spec!r}")
    return int(number), unit


# --------------------------------------------------------------------------------------
# structure


def with_structs(hits: DataFrame, corpora: Corpora, show_struct: Sequence[str]) -> DataFrame:
    """Structural values of the match (null where the region has none); unknown names are left out."""
    known = [s for s in show_struct if s in corpora.structs]
    missing = [s for s in known if s not in hits.columns]
    if not missing:
        return hits
    return corpora.texts.select("corpus", "text_id", *missing).join(hits, ["corpus", "text_id"])


def open_close(hits: DataFrame, corpora: Corpora, kinds: Sequence[str] = ("text", "sentence")) -> DataFrame:
    """Tokens of the sentences that a match touches, with the regions that open and close at each.

    ``kinds`` go from the outer to the inner one.  Opening regions are listed by falling length, closing ones by
    rising length; among equally long ones the kinds' order decides, for closing ones from the end.
    """
    of_page = corpora.only(tuple(r) for r in hits.select("corpus", "text_id").distinct().collect())
    s = of_page.positioned().select("corpus", "text_id", "sent_no", "sent_off", "n", "text_n", "start_pos", F.posexplode("word").alias("i", "word"))
    touched = _matched_sentences(hits, corpora).select("row", "corpus", "text_id", F.explode(F.sequence("first", "last")).alias("sent_no"))
    spans = hits.select("row", place().alias("_lo"), (place() + F.col("me") - F.col("ms")).alias("_hi"))
    rows = s.join(touched.join(spans, "row"), ["corpus", "text_id", "sent_no"])
    off = F.col("sent_off") + F.col("i")
    rows = rows.withColumn("_p", F.col("start_pos") + F.col("i"))
    known = {
        "text": (off == 0, off == F.col("text_n") - 1, F.col("text_n")),
        "sentence": (F.col("i") == 0, F.col("i") == F.col("n") - 1, F.col("n").cast("bigint")),
    }
    opens, closes = [], []
    for rank, kind in enumerate(kinds):
        if kind in known:
            first, last, size = known[kind]
        else:
            rows = rows.join(_edges(corpora, kind, rank), ["corpus", "_p"], "left")
            first, last, size = F.col(f"_first{rank}"), F.col(f"_last{rank}"), F.col(f"_size{rank}")
        opens.append(F.when(first, F.struct((-size).alias("size"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))))
        closes.append(F.when(last, F.struct(size.alias("size"), F.lit(-rank).alias("rank"), F.lit(kind).alias("kind"))))
    marks = {name: F.array_sort(F.array_compact(F.array(*edges)))["kind"].alias(name) for name, edges in (("open", opens), ("close", closes))}
    in_match = off.between(F.col("_lo"), F.col("_hi"))
    return rows.select("row", "corpus", "text_id", "sent_no", "i", "word", in_match.alias("in_match"), marks["open"], marks["close"])


def _edges(corpora: Corpora, kind: str, rank: int) -> DataFrame:
    """Positions at which a region of the kind begins or ends; one row for each, as they don't overlap."""
    size = F.col("last") - F.col("first") + 1
    regions = corpora.regions.filter(F.col("kind") == kind)
    both = F.array(F.struct(F.col("first").alias("_p"), F.lit(True).alias("_f"), size.alias("_s")), F.struct(F.col("last").alias("_p"), F.lit(False).alias("_f"), size.alias("_s")))
    edges = regions.select("corpus", F.inline(both)).groupBy("corpus", "_p")
    return edges.agg(F.max("_f").alias(f"_first{rank}"), F.max(~F.col("_f")).alias(f"_last{rank}"), F.max("_s").alias(f"_size{rank}"))


def with_aligned(hits: DataFrame, corpora: Corpora, partner: Corpora, show: Sequence[str] = ("word",)) -> DataFrame:
    """Page rows with the tokens of the linked text of the partner corpus; null without a link."""
    show = _shown(partner, show)
    links = corpora.texts.select("corpus", "text_id", "link_id").join(hits.select("row", "corpus", "text_id"), ["corpus", "text_id"])
    others = partner.texts.select(F.col("text_id").alias("_text"), "link_id").join(links.select("row", "link_id"), "link_id")
    lines = partner.sentences.select(F.col("text_id").alias("_text"), "sent_no", *show).join(others, "_text")
    # One linked text per row, which is one turn of the input.
    shown = lines.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("_text", "sent_no", *show))).alias("_lines"))
    rows = hits.join(shown, "row", "left")
    return rows.select(*hits.columns, *[F.flatten(F.col("_lines")[a]).alias(f"aligned_{a}") for a in show])


def free_order_page(found: DataFrame, corpora: Corpora, start: int = 0, end: int = 9, max_rows: int = MAX_ROWS) -> DataFrame:
    """Page of free-order results: one row per sentence, with all its hits."""
    rows = found.withColumns({"ms": F.col("hits")[0], "me": F.col("hits")[F.size("hits") - 1], "target": F.lit(None).cast("int")})
    return kwic_page(rows, corpora, start, end, max_rows=max_rows)


# --------------------------------------------------------------------------------------
# lines as text


def line_text(rows: DataFrame, attr: str = "word") -> DataFrame:
    """``left``, ``keyword`` and ``right`` of a shown line as plain strings."""
    words = F.col("tokens")[attr]
    start, end = F.col("start"), F.col("end")
    return rows.withColumns(
        {
            "left": F.array_join(F.slice(words, F.lit(1), start), " ", ""),
            "keyword": F.array_join(F.slice(words, start + 1, end - start), " ", ""),
            "right": F.array_join(F.slice(words, end + 1, F.size(words)), " ", ""),
        }
    )
