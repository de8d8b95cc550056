"""Frequency statistics over matches or over all tokens.

``count`` and ``count_all`` give one row per corpus and value; the functions after them add
relative frequencies, totals over corpora, sums and pages to such a frame.  Counting happens
once, with map-side partial sums; everything after it works on the small aggregated frame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quillspan.functions.keys import escaped, joined, per_million, set_text, set_values, strip_pointer
from quillspan.operators.paging import page, ranked
from quillspan.sources.corpora import Corpora


def group_columns(group_by: Sequence[str] = (), group_by_struct: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Positional attributes by name, then structural ones by name; ``word`` if there are none."""
    positional, structural = sorted(set(group_by)), sorted(set(group_by_struct))
    return (positional or ([] if structural else ["word"])), structural


def top_values(top: Mapping[str, int] | Sequence[str] | None) -> dict[str, int]:
    """``{"lex": 2}`` as given, or a list of attributes of which only the first value counts."""
    if top is None:
        return {}
    return dict(top) if isinstance(top, Mapping) else dict.fromkeys(top, 1)


def _is_set(df: DataFrame, attr: str, depth: int) -> bool:
    kind = df.schema[attr].dataType
    for _ in range(depth):
        kind = kind.elementType
    return isinstance(kind, ArrayType)


def count(
    matches: DataFrame,
    group_by: Sequence[str] = (),
    group_by_struct: Sequence[str] = (),
    ignore_case: Sequence[str] = (),
    split: Sequence[str] = (),
    top: Mapping[str, int] | Sequence[str] | None = None,
    strip: Sequence[str] = (),
    use_target: bool = False,
    by: Sequence[str] = (),
    longest: int | None = None,
) -> DataFrame:
    """Matches per corpus and value: ``*by, corpus, <attributes>, absolute``.

    A positional attribute contributes the values of all matched tokens, or of the target
    token; a structural one the value at the match.  ``matches`` must keep these attributes.

    Split attributes of several tokens count every combination of values.  ``longest`` is the greatest number of
    tokens of a match; where it isn't given, it is looked up first.
    """
    positional, structural = group_columns(group_by, group_by_struct)
    tops = top_values(top)
    lo = F.col("target") if use_target else F.col("ms")
    hi = F.col("target") if use_target else F.col("me")
    rows = matches.select(*by, "corpus", *positional, *structural, lo.alias("_lo"), hi.alias("_hi"))
    several = [a for a in positional if a in split]
    if several:
        longest = 1 if use_target else longest or (rows.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0] or 0) + 1
        several = several if longest > 1 else []
    for attr in positional:
        if attr in several:
            rows = rows.withColumn(attr, _match_sets(attr, tops.get(attr), attr in strip))
        else:
            rows = _replace(rows, attr, _match_key(rows, attr, attr in split, tops.get(attr), attr in strip), attr in split)
    if several:
        rows = _combined(rows.drop("_lo", "_hi"), several, longest)
    return _tally(rows, by, positional, structural, ignore_case, split, strip)


def count_all(
    corpora: Corpora,
    group_by: Sequence[str] = (),
    group_by_struct: Sequence[str] = (),
    ignore_case: Sequence[str] = (),
    split: Sequence[str] = (),
    top: Mapping[str, int] | Sequence[str] | None = None,
    strip: Sequence[str] = (),
) -> DataFrame:
    """Every token counted: ``corpus, <attributes>, absolute``.

    Structural attributes alone need no tokens at all, only the sizes of the texts.
    """
    positional, structural = group_columns(group_by, group_by_struct)
    if not positional:
        rows = corpora.texts.filter(F.col("n_tokens") > 0).select("corpus", "n_tokens", *structural)
        for s in structural:
            if s in ignore_case:
                rows = rows.withColumn(s, F.lower(s))
        return rows.groupBy("corpus", *structural).agg(F.sum("n_tokens").alias("absolute"))
    tops = top_values(top)
    rows = corpora.tokens(*positional, structs=structural)
    for attr in positional:
        value: Column = F.col(attr)
        if attr in split:
            value = set_values(value, tops.get(attr))
            if attr in strip:
                value = F.transform(value, strip_pointer)
        elif _is_set(rows, attr, 0):
            value = set_text(value)
        elif attr in strip:
            value = strip_pointer(value)
        rows = _replace(rows, attr, value, attr in split)
    return _tally(rows, (), positional, structural, ignore_case, split, strip)


def _replace(rows: DataFrame, attr: str, value: Column, each: bool) -> DataFrame:
    """Put ``value`` in place of a column, one row per element if it is an array to be split.

    The array is exploded where it is computed.  Exploding it as a column of its own would let
    Spark test its size first, in the scan, for tokens that do not match at all.
    """
    others = [c for c in rows.columns if c != attr]
    return rows.select(*others, (F.explode(value) if each else value).alias(attr))


def _match_sets(attr: str, top: int | None, strip: bool) -> Column:
    """The values that each matched token counts under: an array for every token."""
    clean = strip_pointer if strip else (lambda v: v)
    values = F.slice(F.col(attr), F.col("_lo") + 1, F.col("_hi") - F.col("_lo") + 1)
    return F.transform(values, lambda s: F.transform(set_values(s, top), clean))


def _combined(rows: DataFrame, attrs: Sequence[str], longest: int) -> DataFrame:
    """Every combination of values of several tokens, with ``_n``, how often it occurs.

    Tokens are taken one after the other, and what is equal so far is added up before the next one multiplies it.
    No row holds more than one combination.
    """
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")) if longest > 2 else rows.withColumn("_n", F.lit(1).cast("bigint"))
    for attr in attrs:
        others = [c for c in rows.columns if c not in (attr, "_n")]
        rows = rows.withColumns({"_alone": F.size(attr) == 1, "_key": F.lit(None).cast("string"), "_rest": F.col(attr)}).drop(attr)
        for slot in range(longest):
            value = F.when(F.col("_alone"), F.col("_v")).otherwise(escaped(F.col("_v")))
            longer = F.when(F.col("_done"), F.col("_key")).when(F.col("_key").isNull(), value).otherwise(F.concat("_key", F.lit(" "), value))
            done = F.size("_rest") == 0
            next_values = F.when(done, F.array(F.lit(None).cast("string"))).otherwise(F.get("_rest", F.lit(0)))
            rows = rows.select(*others, "_n", "_alone", "_key", done.alias("_done"), F.slice("_rest", F.lit(2), F.greatest(F.size("_rest") - 1, F.lit(0))).alias("_rest"), F.explode(next_values).alias("_v"))
            rows = rows.select(*others, "_alone", "_rest", longer.alias("_key"), "_n")
            if 0 < slot < longest - 1:
                rows = rows.groupBy(*others, "_alone", "_rest", "_key").agg(F.sum("_n").alias("_n"))
        rows = rows.withColumnRenamed("_key", attr).drop("_alone", "_rest")
    return rows


def _match_key(rows: DataFrame, attr: str, split: bool, top: int | None, strip: bool) -> Column:
    """One string per match, or for split attributes of single tokens an array with every value."""
    col, lo, hi = F.col(attr), F.col("_lo"), F.col("_hi")
    values = F.slice(col, lo + 1, hi - lo + 1)
    clean = strip_pointer if strip else (lambda v: v)
    if split:
        return F.transform(set_values(F.get(col, lo), top), clean)
    one = set_text if _is_set(rows, attr, 1) else clean
    # Most patterns match one token; that case stays in generated code.
    several = joined(values if one is clean and not strip else F.transform(values, one))
    return F.when(lo == hi, one(F.get(col, lo))).otherwise(several)


def _tally(rows, by, positional, structural, ignore_case, split, strip) -> DataFrame:
    for s in structural:
        if s in split:
            rows = _replace(rows, s, set_values(F.col(s)), True)
        if s in strip:
            rows = rows.withColumn(s, strip_pointer(F.col(s)))
    for attr in (*positional, *structural):
        if attr in ignore_case:
            rows = rows.withColumn(attr, F.lower(attr))
    amount = F.sum("_n") if "_n" in rows.columns else F.count("*")
    return rows.groupBy(*by, "corpus", *positional, *structural).agg(amount.alias("absolute"))


def key_columns(counts: DataFrame, by: Sequence[str] = ()) -> list[str]:
    return [c for c in counts.columns if c not in {"corpus", "absolute", "relative", *by}]


# --------------------------------------------------------------------------------------
# relative frequencies


def _total_size(corpora: Corpora) -> Column:
    """Tokens of all requested corpora, with or without hits, as a scalar subquery."""
    return corpora.info.agg(F.sum("size").alias("total")).scalar()


def with_relative(counts: DataFrame, corpora: Corpora) -> DataFrame:
    """Adds ``relative``: per million tokens of the corpus."""
    sizes = corpora.info.select("corpus", "size")
    return counts.join(sizes, "corpus").withColumn("relative", per_million(F.col("absolute"), F.col("size"))).drop("size")


def combined(counts: DataFrame, corpora: Corpora, by: Sequence[str] = ()) -> DataFrame:
    """Counts over all corpora, relative to the tokens of all requested corpora."""
    keys = [*by, *key_columns(counts, by)]
    rows = counts.groupBy(*keys).agg(F.sum("absolute").alias("absolute"))
    return rows.withColumn("relative", per_million(F.col("absolute"), _total_size(corpora)))


def relative_to(counts: DataFrame, corpora: Corpora, structs: Sequence[str], per_corpus: bool = True) -> DataFrame:
    """Relative to the tokens with the same structural values instead of the whole corpus."""
    if not set(structs) <= set(counts.columns):
        raise ValueError("attributes to be relative to must also be grouped by")
    place = ["corpus"] if per_corpus else []
    sizes = corpora.texts.groupBy(*place, *structs).agg(F.sum("n_tokens").alias("_size"))
    rows = counts
    if not per_corpus:
        rows = counts.groupBy(*key_columns(counts)).agg(F.sum("absolute").alias("absolute"))
    same = [rows[c] == sizes[c] for c in place] + [rows[s].eqNullSafe(sizes[s]) for s in structs]
    joined = rows.join(sizes, same)
    return joined.select(*[rows[c] for c in rows.columns], per_million(rows["absolute"], sizes["_size"]).alias("relative"))


def sums(counts: DataFrame, corpora: Corpora, queries: int | None = None) -> DataFrame:
    """Sums per corpus, 0 for corpora without hits, and over all corpora (``corpus`` null).

    With ``queries`` the counts carry a ``query_no`` from 0 and every one of them gets its sums.
    The sum over all corpora is relative to their whole size, whatever the rows are relative to.
    """
    by = [] if queries is None else ["query_no"]
    wanted = corpora.info.select("corpus", "size")
    if queries is not None:
        wanted = wanted.withColumn("query_no", F.explode(F.sequence(F.lit(0), F.lit(queries - 1))))
    own = F.sum("relative") if "relative" in counts.columns else F.lit(None).cast("double")
    found = counts.groupBy("corpus", *by).agg(F.sum("absolute").alias("absolute"), own.alias("_relative"))
    rows = wanted.join(found, ["corpus", *by], "left").fillna(0, ["absolute"])
    relative = F.coalesce("_relative", per_million(F.col("absolute"), F.col("size")))
    each = rows.select("corpus", *by, "absolute", relative.alias("relative"))
    over = rows.groupBy(*by).agg(F.sum("absolute").alias("absolute"))
    whole = per_million(F.col("absolute"), _total_size(corpora)).alias("relative")
    return each.unionByName(over.select(F.lit(None).cast("string").alias("corpus"), *by, "absolute", whole))


def statistics(counts: DataFrame, corpora: Corpora) -> DataFrame:
    """Per corpus, combined, and both kinds of sums in one frame, told apart by ``level``.

    The grouping sets work on the counted values, not on the matches.  Counts with a ``query_no`` get all
    levels for every query on its own.
    """
    by = [c for c in counts.columns if c == "query_no"]
    keys = key_columns(counts, by)
    sets = [[*by, "corpus", *keys], [*by, *keys], [*by, "corpus"], by]
    rows = counts.groupingSets(sets, *by, "corpus", *keys).agg(
        F.sum("absolute").alias("absolute"), F.grouping("corpus").alias("_all"), F.grouping(keys[0]).alias("_sum")
    )
    level = F.concat(
        F.when(F.col("_all") == 1, "combined").otherwise("corpus"), F.when(F.col("_sum") == 1, " sum").otherwise(" value")
    )
    rows = rows.withColumn("level", level).join(corpora.info.select("corpus", "size"), "corpus", "left")
    whole = F.when(F.col("_all") == 1, _total_size(corpora)).otherwise(F.col("size"))
    return rows.select("level", *by, "corpus", *keys, "absolute", per_million(F.col("absolute"), whole).alias("relative"))


def distinct_values(counts: DataFrame) -> DataFrame:
    """Number of different values over all corpora."""
    return counts.select(*key_columns(counts)).distinct().agg(F.count("*").alias("count"))


def frequency_page(totals: DataFrame, start: int = 0, end: int = -1) -> DataFrame:
    """Rows ``start..end`` of combined counts by falling frequency, ties by value; of each query on its own, if several."""
    if "query_no" in totals.columns:
        keys = key_columns(totals, ["query_no"])
        order = [F.col("absolute").desc(), *[F.col(k).asc() for k in keys]]
        if end == -1 and start == 0:
            return totals
        return ranked(totals, ["query_no"], order, end, "_rank").filter(F.col("_rank") >= start).drop("_rank")
    keys = key_columns(totals)
    return page(totals, [F.col("absolute").desc(), *[F.col(k).asc() for k in keys]], start, end)


def on_page(counts: DataFrame, page_rows: DataFrame) -> DataFrame:
    """Per-corpus rows of the values on a page of the combined counts."""
    keys = [c for c in counts.columns if c == "query_no"] + key_columns(counts, ["query_no"])
    same = [counts[k].eqNullSafe(page_rows[k]) for k in keys]
    return counts.join(page_rows, same, "left_semi")
