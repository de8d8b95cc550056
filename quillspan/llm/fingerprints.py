"""I-Match document fingerprints with randomised lexicon subsets, in built-in functions only.

The lexicon holds the terms within a band of inverse document frequency: from ``N ** LOW`` (two at least) to
``N ** HIGH`` of N documents, so that neither slips of the pen nor everyday words count.  A subset of level l
keeps a pseudo-random 2**-l of the lexicon.  A text's levels follow its length, so that a subset keeps a few
of its terms whether it has ten words or a million.  Each of a text's sixteen parts hashes the sorted distinct
terms that one subset keeps; a part survives an edit that touches none of its terms.

Membership in a subset depends on the term's hash alone, so terms outside every subset of a text are left out
before the join with the lexicon, which then moves some tens of terms for each text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.tables import settle

LOW, HIGH, CHARS_PER_LEVEL, MOST_LEVELS = 0.05, 0.75, 12, 15
PARTS = 16
TERM_BREAK = r"[\s.,;:!?()\"|]+"
FIRST = -(2**63)


def term_hashes(text: Column) -> Column:
    """Distinct lower-case terms as 64-bit hashes."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), TERM_BREAK), lambda t: t != ""), lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, low: float, high: float) -> DataFrame:
    """Hashes of the terms within the band, counted over all documents."""
    n = docs.count()
    counts = docs.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counts.filter((F.col("df") >= max(2.0, n**low)) & (F.col("df") <= n**high)).select("term")


def _level(text: Column) -> Column:
    return F.least(F.greatest(F.floor(F.log2(F.length(text) / CHARS_PER_LEVEL)), F.lit(0)), F.lit(MOST_LEVELS - 1)).cast("int")


def _levels(level: Column) -> tuple[Column, Column]:
    """The even and the odd one of a text's two levels."""
    return level + level % 2, level + 1 - level % 2


def _masks(level: Column) -> list[Column]:
    return [F.call_function("shiftleft", F.lit(1).cast("long"), x) - 1 for x in _levels(level)]


def _subsets(first: Column, second: Column, even: Column, odd: Column) -> list[Column]:
    """Whether each of the sixteen subsets keeps a term with these two hashes.

    A subset of level l looks at l bits of the hash; those of the even level at eight places of the first hash,
    those of the odd one of the second.
    """
    return [F.shiftrightunsigned(word, 7 * i).bitwiseAND(mask) == 0 for word, mask in ((first, even), (second, odd)) for i in range(PARTS // 2)]


def _sampled(terms: Column, even: Column, odd: Column) -> Column:
    """The terms that any subset of the text keeps."""

    def kept(t: Column) -> Column:
        found, *rest = _subsets(t["first"], t["second"], even, odd)
        for test in rest:
            found = found | test
        return found

    return F.transform(F.filter(F.transform(terms, lambda t: F.struct(t.alias("first"), F.xxhash64(t).alias("second"))), kept), lambda t: t["first"])


def _bucket_above(buckets: DataFrame) -> DataFrame:
    """``(bucket, following)``: the next lower bucket that has rows, after the lowest the highest; two levels of windows."""
    wide = buckets.withColumn("wide", F.shiftright("bucket", 12))
    tops = wide.groupBy("wide").agg(F.max("bucket").alias("top"))
    order = Window.orderBy(F.desc("wide"))
    tops = tops.select("wide", F.lead("top").over(order).alias("below"), F.max("top").over(Window.partitionBy(F.lit(0))).alias("highest"))
    inside = F.lead("bucket").over(Window.partitionBy("wide").orderBy(F.desc("bucket")))
    return wide.withColumn("inside", inside).join(tops, "wide").select("bucket", F.coalesce("inside", "below", "highest").alias("following"))


def with_next(docs: DataFrame) -> DataFrame:
    """Every row with the text of the next row by descending doc_id; after the last comes the first.

    Rows are put in buckets of 256 ids; each bucket also gets the first row of the bucket that follows, so a
    window over a bucket finds every successor and no window holds more than some ids.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(FIRST))
    keyed = docs.select(key.alias("key"), F.shiftright(key, 8).alias("bucket"), F.xxhash64("text").alias("tie"), "text")
    heads = keyed.groupBy("bucket").agg(F.max(F.struct("key", "tie")).alias("head"))
    heads = settle(heads.select("bucket", "head.key", "head.tie"), "heads")
    follow = _bucket_above(heads.select("bucket"))
    follow = follow.join(heads.select(F.col("bucket").alias("following"), "key", "tie"), "following").select(F.col("bucket").alias("_to"), "key", "tie")
    guests = keyed.join(follow, ["key", "tie"]).select("key", F.col("_to").alias("bucket"), "tie", "text", F.lit(1).alias("guest"))
    both = keyed.select("key", "bucket", "tie", "text", F.lit(0).alias("guest")).unionByName(guests)
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), F.desc("tie"))
    ahead = both.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("key", "tie", "text")))
    return ahead.filter("guest = 0").drop("guest", "bucket")


def _parts(terms: Column, level: Column) -> Column:
    """PARTS strings: the level and the hash of the sorted distinct terms; null where the subset keeps none."""
    even, odd = _levels(level)
    out = []
    for i in range(PARTS):
        bit = F.lit(1 << i)
        kept = F.transform(F.filter(terms, lambda t: t["bits"].bitwiseAND(bit) != 0), lambda t: t["term"])  # noqa: B023
        value = F.concat((even if i < PARTS // 2 else odd).cast("string"), F.lit("/"), F.lower(F.hex(F.xxhash64(F.array_sort(F.array_distinct(kept))))))
        out.append(F.when(F.size(kept) > 0, value))
    return F.array(*out)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among those of the text that has more."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda same: same))
    count = lambda parts: F.size(F.filter(parts, lambda x: x.isNotNull()))
    return F.coalesce(equal / F.nullif(F.greatest(count(a), count(b)), F.lit(0)), F.lit(0.0)).cast("double")


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row.

    The edited text has its last floor(n_chars / 3) characters replaced by as many first ones (or all) of the next
    document by descending doc_id.  A fingerprint is sixteen parts, joined; ``near_*`` is the likeness of the row's
    fingerprint with that of its edited text and of the next document.

    A null text counts as empty.  A text of which no subset keeps a term has one part, the hash of the text, so
    equal texts always have equal fingerprints.  Null doc_ids come after all others; rows with one doc_id follow
    each other by a hash of their text.  The next of a single row is the row itself.  An empty table gives no
    rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = with_next(docs).withColumn("edited", edited).withColumn("level", _level(F.col("text"))).withColumn("edited_level", _level(F.col("edited")))
    for name in ("", "edited_"):
        even, odd = _masks(F.col(f"{name}level"))
        rows = rows.withColumns({f"{name}even": even, f"{name}odd": odd})
    sampled = lambda text, name: _sampled(term_hashes(F.col(text)), F.col(f"{name}even"), F.col(f"{name}odd"))
    rows = settle(rows.select(
        F.monotonically_increasing_id().alias("row"), "key", "tie", "next_key", "next_tie", n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), "level", "edited_level", F.xxhash64("edited").alias("edited_tie"),
        sampled("text", "").alias("terms"), sampled("edited", "edited_").alias("edited_terms"),
    ), "edited")
    side = lambda of, name: rows.select("row", F.lit(of).alias("side"), F.col(f"{name}level").alias("level"), F.explode(f"{name}terms").alias("term"))
    found = side(0, "").unionByName(side(1, "edited_")).join(lexicon(docs, low, high), "term")
    bits = None
    for i, test in enumerate(_subsets(F.col("term"), F.xxhash64("term"), *_masks(F.col("level")))):
        bit = F.when(test, F.lit(1 << i)).otherwise(F.lit(0))
        bits = bit if bits is None else bits + bit
    lists = found.groupBy("row", "side", "level").agg(F.collect_list(F.struct("term", bits.alias("bits"))).alias("terms"))
    parts = lists.select("row", "side", _parts(F.col("terms"), F.col("level")).alias("parts"))
    parts = parts.groupBy("row").agg(*(F.max(F.when(F.col("side") == i, F.col("parts"))).alias(name) for i, name in enumerate(("parts", "edited_parts"))))
    kept = rows.drop("terms", "edited_terms").join(parts, "row", "left")
    for name, tie in (("parts", "tie"), ("edited_parts", "edited_tie")):
        whole = F.array(F.concat(F.lit("text/"), F.lower(F.hex(tie))), *[F.lit(None).cast("string")] * (PARTS - 1))
        kept = kept.withColumn(name, F.coalesce(name, whole))
    kept = settle(kept, "parts")
    following = kept.groupBy(F.col("key").alias("next_key"), F.col("tie").alias("next_tie")).agg(F.min("parts").alias("next_parts"))
    out = kept.join(following, ["next_key", "next_tie"], "left")
    written = lambda parts: F.array_join(parts, ",", "-")
    return out.select(
        F.nullif("key", F.lit(FIRST)).alias("doc_id"), "n_chars", "edited_sha256", written("parts").alias("fingerprint"),
        written("edited_parts").alias("edited_fingerprint"), likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
        likeness(F.col("parts"), F.col("next_parts")).alias("near_next"),
    )
