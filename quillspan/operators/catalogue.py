"""What corpora there are, what they hold, and who may read them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.sources.corpora import Corpora, parse_corpora


def corpora_list(corpora: Corpora, protected: DataFrame | None = None) -> DataFrame:
    """All corpora with a flag for those that need permission."""
    names = corpora.info.select("corpus")
    if protected is None:
        return names.withColumn("protected", F.lit(False))
    marked = protected.select(F.upper("corpus").alias("corpus")).distinct().withColumn("protected", F.lit(True))
    return names.join(marked, "corpus", "left").fillna(False, ["protected"])


def corpus_info(corpora: Corpora) -> DataFrame:
    return corpora.info.drop("longest")


def corpus_totals(corpora: Corpora) -> DataFrame:
    """Total size and sentence count; a corpus without a sentence count adds nothing."""
    zero = F.lit(0).cast("bigint")
    return corpora.info.agg(
        F.coalesce(F.sum("size"), zero).alias("total_size"), F.coalesce(F.sum("sentences"), zero).alias("total_sentences")
    )


def attributes(corpora: Corpora) -> DataFrame:
    """Attributes that have a value in the corpus: kind ``p``, ``s`` or ``a`` (alignment)."""
    has_token_value = {a: F.max(F.exists(F.col(a), lambda v: v.isNotNull())) for a in corpora.attrs}
    tokens = corpora.sentences.groupBy("corpus").agg(*[c.alias(a) for a, c in has_token_value.items()])
    regions = [c for c in ("datefrom", "dateto") if c in corpora.texts.columns] + list(corpora.structs)
    links = ["link_id"] if "link_id" in corpora.texts.columns else []
    texts = corpora.texts.groupBy("corpus").agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in regions + links])
    one = _listed(tokens, {a: "p" for a in corpora.attrs})
    two = _listed(texts, {**dict.fromkeys(regions, "s"), **dict.fromkeys(links, "a")})
    return one.unionByName(two)


def _listed(flags: DataFrame, kinds: dict[str, str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("attr"), F.col(a).alias("has")) for a, k in kinds.items()])
    return flags.select("corpus", F.inline(entries)).filter("has").select("corpus", "kind", "attr")


def denied(corpora: DataFrame, protected: DataFrame, allowed: DataFrame) -> DataFrame:
    """``corpus``: those of the requested corpora that are protected and not among the allowed ones.

    All three have a column ``corpus``; names are compared without regard to case.
    """
    asked, closed, given = (df.select(F.upper("corpus").alias("corpus")).distinct() for df in (corpora, protected, allowed))
    return asked.join(closed, "corpus", "left_semi").join(given, "corpus", "left_anti")


def check_access(corpora: Iterable[str] | str, protected: DataFrame, allowed: DataFrame) -> list[str]:
    """Requested corpora, or PermissionError naming the protected ones the caller may not read."""
    names = parse_corpora(corpora)
    asked = protected.select(F.upper("corpus").alias("corpus")).filter(F.col("corpus").isin(names))
    missing = sorted(r.corpus for r in denied(asked, protected, allowed).collect())  # at most the requested names
    if missing:
        raise PermissionError("no access to " + ", ".join(missing))
    return names
