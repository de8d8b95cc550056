"""Phrase collocations: Misra-Gries summaries find the frequent n-grams, a second pass counts them exactly.

Texts become slices: the words of one language in a row, as numbers of the slice's own vocabulary, with breaks between
pieces.  The n-grams of a slice are counted in the task that holds it and dealt by a hash into partitions, whose number
follows from the mass (occurrences of n-grams) of all slices.  What a slice sends to a partition is a summary: hashes
and counts.  A partition of mass m merges its summaries with a capacity above m / threshold, so all it ever subtracts
from a count stays below the threshold and every frequent n-gram survives.  A slice gets back one bit for each
n-gram it sent, counts those that may be frequent by their words, and the sums over all slices are exact.  Equal hashes
of different n-grams only let more survive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.tables import drop, settle, small_batches
from quillspan.llm.words import mix

LONGEST, LEAST, PERCENT, TOP = 3, 10, 50, 2000
SLICE_WORDS, PART_MASS, PORTION = 500_000, 2_000_000, 4 << 20
#: What ends a piece, what lies between words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_BREAK = b"\xff"  # no byte of UTF-8
_TABLE = bytes(0xFF if i in BREAKS else 0x20 if i in BLANKS else i + 32 if 65 <= i <= 90 else i for i in range(256))
_SLICES = "slice long, lang string, n_words long, n_grams long, vocabulary binary, ids binary"
_SUMMARIES = "part int, slice long, hashes binary, counts binary"
_MARKS = "slice long, part int, marks binary"
_COUNTS = "lang string, size int, phrase string, n long"


def pieces(text: str | bytes | None) -> list[list[bytes]]:
    """The words of each piece of a text; A-Z lower-cased."""
    found: list[list[bytes]] = [[]]
    for word in _tokens(text):
        found.append([]) if word == _BREAK else found[-1].append(word)
    return [p for p in found if p]


def _tokens(text: str | bytes | None) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.translate(_TABLE).replace(_BREAK, b" \xff ").split()


def _portions(raw: bytes) -> Iterator[bytes]:
    """A very long text, cut where pieces end."""
    at = 0
    while len(raw) - at > PORTION:
        ends = [e for e in (raw.find(bytes([b]), at + PORTION) for b in BREAKS) if e >= 0]
        if not ends:
            break
        yield raw[at : min(ends) + 1]
        at = min(ends) + 1
    yield raw[at:]


class _Numbers(dict):
    """Word -> number from 1, in order of first sight; 0 is a break."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class _Slice:
    def __init__(self, lang: str):
        self.lang, self.at, self.ids, self.words = lang, _Numbers({_BREAK: 0}), [np.zeros(1, np.uint32)], 0

    def add(self, tokens: list[bytes]) -> None:
        ids = np.fromiter(map(self.at.__getitem__, tokens), np.uint32, len(tokens))
        self.ids += [ids, np.zeros(1, np.uint32)]
        self.words += int(np.count_nonzero(ids))


def _slices(longest: int):
    names = [c.split()[0] for c in _SLICES.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: dict[str, _Slice] = {}

        def done(s: _Slice) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids = np.concatenate(s.ids)
            mass = sum(int(_starts(ids, size).sum()) for size in range(1, longest + 1))
            row = [number, s.lang, s.words, mass, b" ".join(list(s.at)[1:]), ids.astype("<u4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            langs, texts = (batch.column(batch.schema.get_field_index(n)) for n in ("lang", "text"))
            for lang, text in zip(langs, texts):
                lang = lang.as_py()
                for portion in _portions(text.as_py() or b""):
                    own = held.setdefault(lang, _Slice(lang))
                    own.add(_tokens(portion))
                    if own.words >= SLICE_WORDS:
                        yield done(held.pop(lang))
        for own in held.values():
            yield done(own)

    return run


def _starts(ids: np.ndarray, size: int) -> np.ndarray:
    """Where ``size`` words follow each other without a break."""
    ok = np.ones(max(0, len(ids) - size + 1), bool)
    for k in range(size):
        ok &= ids[k : k + len(ok)] != 0
    return ok


def distinct_grams(ids: np.ndarray, n_words: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(size, grams, counts)`` for sizes 1 to ``longest``: one row of word numbers for every distinct n-gram."""
    base = np.uint64(n_words + 1)
    keys, bound = ids.astype(np.uint64), int(n_words)
    known: list[np.ndarray | None] = []  # for each size but the last: what its numbers stand for, if they aren't the keys themselves
    for size in range(1, longest + 1):
        if size > 1:
            ranks = None
            if (bound + 1) * (n_words + 1) >= 2**63:
                ranks, keys = np.unique(keys, return_inverse=True)
                keys, bound = keys.astype(np.uint64), len(ranks) - 1
            known.append(ranks)
            keys, bound = keys[:-1] * base + ids[size - 1 :].astype(np.uint64), bound * (n_words + 1) + n_words
        ordered = np.sort(keys[_starts(ids, size)])
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
        left, grams = ordered[first], np.empty((len(first), size), np.int32)
        for k in range(size - 1, 0, -1):
            left, last = np.divmod(left, base)
            grams[:, k] = last
            if known[k - 1] is not None:
                left = known[k - 1][left.astype(np.int64)]
        grams[:, 0] = left
        yield size, grams, np.diff(np.append(first, len(ordered)))


def _gram_hashes(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = mix(words[grams[:, 0]])
    for k in range(1, grams.shape[1]):
        out = mix(out * np.uint64(3) + words[grams[:, k]])
    return out


class _Grams:
    """All n-grams of one slice in the order of their partition and hash."""

    def __init__(self, lang, vocabulary: bytes, ids: bytes, longest: int, parts: int):
        self.words = [b"", *vocabulary.split(b" ")] if vocabulary else [b""]
        seed = xxhash.xxh3_64_intdigest((lang or "").encode())
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed=seed) for w in self.words), np.uint64, len(self.words))
        self.sizes = list(distinct_grams(np.frombuffer(ids, "<u4"), len(self.words) - 1, longest))
        whole = np.concatenate([_gram_hashes(g, hashes) for _, g, _ in self.sizes])
        part = (whole >> np.uint64(32)) % np.uint64(parts)
        key = part << np.uint64(32) | whole & np.uint64(0xFFFFFFFF)
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        self.low, part = key.astype(np.uint32), (key >> np.uint64(32)).astype(np.int64)
        self.counts = np.concatenate([c for _, _, c in self.sizes])[self.order]
        self.edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.empty(0, np.int64)
        self.parts = part[self.edges[:-1]] if len(part) else part

    def each_part(self) -> Iterator[tuple[int, slice]]:
        for part, a, b in zip(self.parts, self.edges, self.edges[1:]):
            yield int(part), slice(a, b)

    def counted(self, chosen: np.ndarray) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
        """``(size, phrases, counts)`` of the n-grams at these places of the order."""
        picked = np.sort(self.order[chosen])
        first = 0
        for size, grams, counts in self.sizes:
            own = picked[(picked >= first) & (picked < first + len(grams))] - first
            first += len(grams)
            words = self.words
            for at in range(0, len(own), 100_000):
                few = own[at : at + 100_000]
                yield size, [b" ".join([words[i] for i in g]) for g in grams[few].tolist()], counts[few]


def _summarise(longest: int, parts: int):
    names = [c.split()[0] for c in _SUMMARIES.split(", ")]

    def run(batches):
        for batch in batches:
            for number, lang, vocabulary, ids in zip(*(batch.column(batch.schema.get_field_index(n)) for n in ("slice", "lang", "vocabulary", "ids"))):
                grams = _Grams(lang.as_py(), vocabulary.as_py(), ids.as_buffer(), longest, parts)
                out: list[tuple] = []
                for part, own in grams.each_part():
                    out.append((part, number.as_py(), *_written(grams.low[own], grams.counts[own])))
                    if len(out) == 256:
                        yield _batch(out, names)
                        out = []
                if out:
                    yield _batch(out, names)

    return run


def _batch(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    part, number, hashes, counts = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(number, pa.int64()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], names=names)


def _written(low: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending hashes as differences, byte by byte of all of them, and counts in as many bytes as they need."""
    apart = np.diff(low, prepend=np.uint32(0)).astype("<u4")
    wide = counts.astype(np.uint8 if counts.max() < 2**8 else np.uint16 if counts.max() < 2**16 else "<u4" if counts.max() < 2**32 else "<u8")
    return np.ascontiguousarray(apart.view(np.uint8).reshape(-1, 4).T).tobytes(), wide.tobytes()


def _read(hashes, counts) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(hashes, np.uint8).reshape(4, -1)
    low = np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)
    raw = np.frombuffer(counts, np.uint8)
    return low, raw.view(f"<u{len(raw) // len(low)}").astype(np.int64)


class Summary:
    """Misra-Gries: at most ``capacity`` keys; ``lost`` is the most that any count may lack."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        """Add the counts of both, then subtract the greatest count that has no place from all."""
        every, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, at, np.concatenate([self.counts, counts]))
        self.lost += lost
        if len(every) > self.capacity:
            cut = int(np.partition(total, len(total) - self.capacity - 1)[len(total) - self.capacity - 1])
            every, total = every[total > cut], total[total > cut] - cut
            self.lost += cut
        self.keys, self.counts = every, total

    def may_reach(self, least: int) -> np.ndarray:
        """Ascending keys whose true count may be ``least`` or more; all that reach it, if ``lost`` is below it."""
        return self.keys[self.counts + self.lost >= least]


def _marks(least: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: list[tuple] = []
        mass = 0
        for batch in batches:
            for row in range(batch.num_rows):
                number, hashes, counts = (batch.column(batch.schema.get_field_index(n))[row].as_py() for n in ("slice", "hashes", "counts"))
                sent.append((number, hashes, counts))
                mass += int(_read(hashes, counts)[1].sum())
        summary, few, waiting = Summary(mass // least + 1), [], 0
        for _, hashes, counts in sent:
            few.append(_read(hashes, counts))
            waiting += len(few[-1][0])
            if waiting >= max(len(summary.keys), 1 << 18):
                summary.merge(*map(np.concatenate, zip(*few)))
                few, waiting = [], 0
        if few:
            summary.merge(*map(np.concatenate, zip(*few)))
        frequent = summary.may_reach(least)
        for at in range(0, len(sent), 512):
            some = sent[at : at + 512]
            bits = [np.packbits(_among(_read(h, c)[0], frequent)).tobytes() for _, h, c in some]
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in some], pa.int64()), pa.array([key[0].as_py()] * len(some), pa.int32()), pa.array(bits, pa.binary())], names=["slice", "part", "marks"])

    return run


def _among(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if len(ordered) == 0:
        return np.zeros(len(keys), bool)
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys


def _count(longest: int, parts: int):
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]

    def run(left, right):
        marks: dict[int, bytes] = {}
        for batch in right.to_batches():
            marks.update(zip(batch.column(batch.schema.get_field_index("part")).to_pylist(), batch.column(batch.schema.get_field_index("marks")).to_pylist()))
        out = []
        for batch in left.to_batches():
            for lang, vocabulary, ids in zip(*(batch.column(batch.schema.get_field_index(n)) for n in ("lang", "vocabulary", "ids"))):
                lang = lang.as_py()
                grams = _Grams(lang, vocabulary.as_py(), ids.as_buffer(), longest, parts)
                chosen = [own.start + np.flatnonzero(np.unpackbits(np.frombuffer(marks[part], np.uint8), count=own.stop - own.start)) for part, own in grams.each_part()]
                for size, phrases, counts in grams.counted(np.concatenate([*chosen, np.empty(0, np.int64)]).astype(np.int64)):
                    text = pa.array(phrases, pa.binary()).cast(pa.string())
                    out.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(np.full(len(phrases), size), pa.int32()), text, pa.array(counts, pa.int64())], names=["lang", "size", "phrase", "n"]))
        return pa.Table.from_batches(out, pa.schema([pa.field(n.split()[0], k) for n, k in zip(_COUNTS.split(", "), kinds)]))

    return run


def frequent_phrases(texts: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``(phrases, sizes)``: ``lang, size, phrase, n`` of all phrases of 1 to ``longest`` words that occur ``least`` times
    or more, exactly; and ``lang, n_words``.  ``texts`` has ``lang, text``."""
    with small_batches(texts.sparkSession):
        return _frequent_phrases(texts, longest, least)


def _frequent_phrases(texts: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    given = texts.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    slices = settle(given.mapInArrow(_slices(longest), _SLICES), "phrase-slices")
    sizes = slices.groupBy("lang").agg(F.sum("n_words").alias("n_words"))
    parts = max(1, -(-(slices.agg(F.sum("n_grams")).first()[0] or 0) // PART_MASS))
    summaries = slices.mapInArrow(_summarise(longest, parts), _SUMMARIES)
    marks = settle(summaries.groupBy("part").applyInArrow(_marks(least), _MARKS), "phrase-marks")
    counted = slices.groupBy("slice").cogroup(marks.groupBy("slice")).applyInArrow(_count(longest, parts), _COUNTS)
    phrases = counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    phrases, sizes = settle(phrases, "phrases"), settle(sizes, "phrase-sizes")
    drop(slices, marks)
    return phrases, sizes


def _scored(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, a, k, l, r, score`` of all phrases of two words or more, cut where they score least."""
    whole = phrases.filter("size > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    left = F.concat_ws(" ", F.slice("words", F.lit(1), F.col("k")))
    right = F.concat_ws(" ", F.slice("words", F.col("k") + 1, F.size("words")))
    sides = cuts.select("lang", "phrase", "a", "k", F.posexplode(F.array(left, right)).alias("side", "part"))
    found = sides.join(phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    l, r = (F.max(F.when(F.col("side") == side, F.col("f"))).alias(name) for side, name in enumerate("lr"))
    pairs = found.groupBy("lang", "phrase", "k").agg(F.max("a").alias("a"), l, r)
    a = "cast(a as decimal(15,0))"
    score = F.expr(f"(1000000BD * ({a} * {a})) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = pairs.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.k", "b.l", "b.r", "b.score")


def _within_longer(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, longer``: how often the most frequent longer phrase occurs that holds the words of ``phrase`` in a row."""
    long = phrases.filter("size > 2").select("lang", F.split("phrase", " ").alias("words"), F.col("n"), "size")
    sizes = long.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    parts = sizes.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    part = F.concat_ws(" ", F.slice("words", F.col("at"), F.col("m")))
    return parts.groupBy("lang", part.alias("phrase")).agg(F.max("n").alias("longer"))


def collocations(texts: DataFrame, longest: int = LONGEST, least: int = LEAST, percent: int = PERCENT, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``texts`` has ``lang, text``.  A-Z lower-cased texts split into pieces at ``.,;:!?`` and line or page breaks, pieces into
    words at spaces and tabs.  Candidates are phrases of 2 to ``longest`` words in a row within a piece that occur
    ``least`` times or more (``a``).  Cut after k words, of which l and r are the frequencies of the halves, a phrase
    scores floor(1000000 a a / (l r)); the least score of its cuts counts, then the smallest k.  A candidate inside a longer
    one that occurs at least ``percent`` per cent as often is dropped.  ``n`` is the number of words of the language.
    Order: score and ``a`` descending, then the phrase by its bytes.  Exact for frequencies below 10**15.

    A null language is ``und``.  Null, empty and blank texts hold no words; repeated rows count each time; texts of any
    length are cut at ends of pieces.  An empty table gives no rows; other columns are ignored.
    """
    if longest < 2 or least < 1 or top < 1:
        raise ValueError("longest must be 2 or more, least and top positive")
    phrases, sizes = frequent_phrases(texts, longest, least)
    kept = _scored(phrases).join(_within_longer(phrases), ["lang", "phrase"], "left")
    kept = kept.filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    first = kept.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    ranked = first.filter(F.col("place") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")
