"""Hierarchical Pitman-Yor language model, sampled as a distributed Chinese-restaurant process.

A restaurant stands for each of ``CONTEXTS`` classes of the word before (a hash of it); all share one parent, the
restaurant of single words, whose own parent is the base: half for the unknown word, half spread evenly over the
V known ones.  A customer of a context joins a table of its word or opens one, and a new table sends a customer to
the parent.  Given the tables of its context in total and the parent's probability of the word, the seating of a
(context, word) pair doesn't depend on other pairs, so a Gibbs sweep reseats all pairs side by side, with the
totals of the sweep before.  In a pair, customers beyond the eighth are seated some at a time (an eighth of those
seated), so that a pair costs about log(count) steps.  The predictive probability is the mean over the kept
sweeps.

Documents are turned once into counts of (context, word) by document, packed into arrays and dealt to shards by
word; very frequent words are dealt by word and context.  A shard knows all of its words, so only totals by
context, totals of frequent words and a few sums go through the driver: their sizes don't depend on the corpus.
A sweep is reproduced from those totals and a seed; nothing else is kept between sweeps.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.tables import one_row_at_a_time, settle, small_batches
from quillspan.llm.words import HASHES, free, mix, rows, words

CONTEXTS = 1 << 16
END = np.uint64(xxhash.xxh3_64_intdigest(b" end of text"))
START = np.uint64(xxhash.xxh3_64_intdigest(b" start of text"))
FLUSH_TOKENS, FLUSH_DOCS, HELD_SUMS = 250_000, 60_000, 1_000_000
FOLDS, FOLD = 7, 2
PACKED = "shard int, kind int, flush long, " + ", ".join(f"{c} binary" for c in "abcdefghi")
SUMS = "part int, tables binary, customers binary, hot_tables binary, hot_customers binary, total_tables long, total_root long, tokens long, known long"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_known double, score double"


@dataclass(frozen=True)
class HpyConfig:
    discount: float = 0.8
    strength: float = 2.0
    root_discount: float = 0.7
    root_strength: float = 100.0
    burn_in: int = 1
    samples: int = 3
    seed: int = 7


def token_hashes(text: str | None) -> np.ndarray:
    return np.append(HASHES.of(words(text)), END)


def _freeing(run):
    """The same work on batches, or on one group; memory is freed at its end."""

    def freed(batches):
        try:
            yield from run(batches)
        finally:
            free()

    return freed


def _row(shard: int, kind: int, flush: int, *values) -> tuple:
    packed = [v.tobytes() if v is not None else None for v in values]
    return (shard, kind, flush, *packed, *[None] * (9 - len(packed)))


def _batch(schema: str, out: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*out)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _frequent(share: int):
    """Words of a quarter of 1 / ``share`` or more of some hundred thousand tokens; row null has the number of tokens."""

    def flush(counts: Counter):
        total = counts.total()
        kept = [(int(xxhash.xxh3_64_intdigest(w)) - 2**63, n) for w, n in counts.items() if 4 * n * share >= total]
        return _batch("word long, n long", [*kept, (None, total)])

    def run(batches):
        counts, n = Counter(), 0
        for (text,) in rows(batches, "text"):
            found = words(text)
            counts.update(found)
            counts[b" end of text"] += 1
            n += len(found) + 1
            if n >= FLUSH_TOKENS:
                yield flush(counts)
                counts, n = Counter(), 0
        if n:
            yield flush(counts)

    return run


def frequent_words(docs: DataFrame, shards: int) -> np.ndarray:
    """Hashes of the words with more than a quarter of a shard's share: they are dealt by context, too.

    All words of 1 / ``share`` of the tokens are found, as each part of the text hides less than a quarter of that;
    there are less than 4 / 3 * ``share`` words, and that is at most 100,000.  Which words are found has no influence
    on any score but by the order of random numbers.
    """
    share = max(4, min(4 * shards, 75_000))
    counted = docs.select("text").mapInArrow(_freeing(_frequent(share)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = settle(counted, "frequent")
    total = counted.filter("word is null").agg(F.sum("n")).first()[0] or 0
    found = counted.filter(F.col("word").isNotNull() & (F.col("n") * 4 * share >= 3 * total)).collect()
    return np.sort(np.array([r["word"] + 2**63 for r in found], np.uint64))


def _shard_of(word: np.ndarray, context: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    spread = np.where(np.isin(word, hot), mix(word + mix(context.astype(np.uint64) + np.uint64(1))), mix(word))
    return (spread % np.uint64(shards)).astype(np.int64)


def _count(hot_words, shards: int):
    """Packed counts of (word, context, document), a row for each shard and some megabytes of text."""

    def flush(number: int, docs: list[tuple]):
        ids, held, texts = zip(*docs)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        word = np.concatenate(texts)
        before = np.append(START, word[:-1])
        before[np.cumsum(lengths)[:-1]] = START
        context = (mix(before) % np.uint64(CONTEXTS)).astype(np.int64)
        doc = np.repeat(np.arange(len(docs)), lengths)
        names, name = np.unique(word, return_inverse=True)
        key = np.sort((name << 33) | (context << 17) | doc)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(first, append=len(key))
        key = key[first]
        while (over := n > 65535).any():  # counts are kept in 16 bits; larger ones in several entries
            extra, left = key[over], n[over] - 65535
            n = np.append(np.minimum(n, 65535), left)
            key = np.append(key, extra)
        name, context, doc = key >> 33, key >> 17 & 0xFFFF, key & 0x1FFFF
        shard = _shard_of(names[name], context, hot_words.value, shards)
        order = np.lexsort((key, shard))
        shard, name, context, doc, n = shard[order], name[order], context[order], doc[order], n[order]
        learns = ~np.array(held)
        out = [_row(number % shards, 1, number, np.array([LAST if i is None else i for i in ids]), np.array(held), lengths)]
        for part in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
            pair = name[part] << 16 | context[part]
            new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            trained = np.add.reduceat(n[part] * learns[doc[part]], new)
            out.append(_row(int(shard[part[0]]), 0, number, names[pair[new] >> 16], (pair[new] & 0xFFFF).astype(np.uint16), trained.astype(np.int32), np.diff(new, append=len(part)).astype(np.int32), doc[part].astype(np.uint16), n[part].astype(np.uint16)))
        return _batch(PACKED, out)

    def run(batches):
        base, done, docs, tokens = TaskContext.get().partitionId() << 24, 0, [], 0
        for doc_id, held, text in rows(batches, "doc_id", "held", "text"):
            docs.append((doc_id, held, token_hashes(text)))
            tokens += len(docs[-1][2])
            if tokens >= FLUSH_TOKENS or len(docs) >= FLUSH_DOCS:
                yield flush(base + done, docs)
                done, docs, tokens = done + 1, [], 0
        if docs:
            yield flush(base + done, docs)

    return run


LAST = 2**63 - 1
KINDS = (np.uint64, np.uint16, np.int32, np.int32, np.uint16, np.uint16)


def _merge(table: pa.Table) -> pa.Table:
    """One row for a shard: its words, pairs and training counts, and the entries of every flush by pair number."""
    out, parts = [], []
    for row in rows([table], "shard", "kind", "flush", *"abcdef"):
        if row[1] == 1:
            out.append((*row, None, None, None))
        else:
            parts.append((row[2], *(np.frombuffer(v, k) for v, k in zip(row[3:], KINDS))))
    if parts:
        parts.sort(key=lambda p: p[0])
        word, context, trained = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        names, name = np.unique(word, return_inverse=True)
        pairs, pair = np.unique(name << 16 | context, return_inverse=True)
        counts = np.bincount(pair, trained, len(pairs)).astype(np.int64)
        flushes = np.array([p[0] for p in parts])
        sizes = np.array([(len(p[1]), len(p[5])) for p in parts], np.int64)
        out.append(_row(
            table.column("shard")[0].as_py(), 0, 0, names, (pairs >> 16).astype(np.int32), (pairs & 0xFFFF).astype(np.uint16), counts, flushes, sizes,
            pair.astype(np.int32), np.concatenate([p[4] for p in parts]), np.concatenate([np.concatenate([p[5], p[6]]) for p in parts]),
        ))
        del parts, word, context, trained, names, name, pairs, pair, counts
    merged = pa.Table.from_batches([_batch(PACKED, out)])
    del out
    free()
    return merged


def seat(customers: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after all customers of each dish have sat down; ``opening``: strength and tables elsewhere, times the parent's probability."""
    tables = np.minimum(customers, 1).astype(np.float64)
    live = np.flatnonzero(customers > 1)
    left, opening = customers[live], opening[live]
    seated, own = np.ones(len(live), np.int64), np.ones(len(live))
    while len(live):
        some = np.minimum(np.maximum(seated // 8, 1), left - seated)
        own += rng.binomial(some, opening / (opening + seated - discount * own))
        seated += some
        done = seated == left
        tables[live[done]] = own[done]
        live, left, opening, seated, own = (a[~done] for a in (live, left, opening, seated, own))
    return tables


class Shard:
    """The pairs of a shard and the state of its part of the restaurants."""

    def __init__(self, number: int, a: pa.Buffer, b: pa.Buffer, c: pa.Buffer, d: pa.Buffer, hot: np.ndarray):
        self.number, self.names = number, np.frombuffer(a, np.uint64)
        self.name, self.context, self.count = np.frombuffer(b, np.int32), np.frombuffer(c, np.uint16), np.frombuffer(d, np.int64)
        at = np.minimum(np.searchsorted(hot, self.names), max(len(hot) - 1, 0))
        self.is_hot = hot[at] == self.names if len(hot) else np.zeros(len(self.names), bool)
        self.hot_at = at
        self.customers = np.bincount(self.name, self.count, len(self.names))
        self.tables = np.minimum(self.count, 1).astype(np.float64)
        self._roots(None, None, None)

    def _roots(self, totals: dict | None, how: HpyConfig | None, rng) -> None:
        self.parent = np.bincount(self.name, self.tables, len(self.names))
        self.root = np.minimum(self.parent, 1) if totals is None else seat(self.parent.astype(np.int64), np.full(len(self.parent), totals["root_opening"]), how.root_discount, rng)

    def probability(self, totals: dict, how: HpyConfig) -> np.ndarray:
        """The parent's predictive probability of each word; that of the unknown word where nothing was learnt."""
        own = np.maximum(self.parent - how.root_discount * self.root, 0) / (how.root_strength + totals["tables"]) + totals["new"] * totals["base"]
        own[self.customers == 0] = totals["new"] * 0.5
        if self.is_hot.any():
            own[self.is_hot] = totals["hot"][self.hot_at[self.is_hot]]
        return own

    def opening(self, totals: dict, how: HpyConfig) -> np.ndarray:
        """Strength and tables of the context of each pair, times the parent's probability; in place, as a shard is large."""
        out = totals["by_context"][self.context]
        out *= how.discount
        out += how.strength
        out *= self.probability(totals, how)[self.name]
        return out

    def sweep(self, totals: dict, how: HpyConfig) -> None:
        rng = np.random.default_rng([how.seed, totals["number"], self.number])
        self.tables = seat(self.count, self.opening(totals, how), how.discount, rng)
        self._roots(totals, how, rng)

    def sums(self, hot: np.ndarray) -> tuple:
        """What the next sweep needs of this one."""
        cold = ~self.is_hot
        hot_tables, hot_customers = np.zeros(len(hot)), np.zeros(len(hot))
        hot_tables[self.hot_at[self.is_hot]] = self.parent[self.is_hot]
        hot_customers[self.hot_at[self.is_hot]] = self.customers[self.is_hot]
        return (
            np.bincount(self.context, self.tables, CONTEXTS), np.bincount(self.context, self.count, CONTEXTS), hot_tables, hot_customers,
            int(self.parent[cold].sum()), int(self.root[cold].sum()), int(self.count.sum()), int(np.count_nonzero(self.customers[cold])),
        )


def _shards(batches, columns: str):
    """Shard rows one at a time: number and packed columns, which are not copied."""
    for batch in batches:
        places = [batch.schema.get_field_index(c) for c in columns]
        for at in range(batch.num_rows):
            yield batch.column(batch.schema.get_field_index("shard"))[at].as_py(), [batch.column(c)[at].as_buffer() for c in places]


def _totals_of(states, hot, how: HpyConfig):
    """Run the sweeps known so far in every shard and add up what the next one needs; one row for a task."""

    def run(batches):
        arrays, numbers = None, [0] * 4
        for number, values in _shards(batches, "abcd"):
            shard = Shard(number, *values, hot.value)
            for totals in states.value:
                shard.sweep(totals, how)
            *own, a, b, c, d = shard.sums(hot.value)
            arrays = own if arrays is None else [x + y for x, y in zip(arrays, own)]
            numbers = [x + y for x, y in zip(numbers, (a, b, c, d))]
        if arrays is not None:
            yield _batch(SUMS, [(TaskContext.get().partitionId() % 16, *(x.astype(np.float64).tobytes() for x in arrays), *numbers)])

    return run


def _added(table: pa.Table) -> pa.Table:
    values = list(rows([table], *(f.split()[0] for f in SUMS.split(", "))))
    arrays = [sum(np.frombuffer(v[i], np.float64) for v in values).tobytes() for i in (1, 2, 3, 4)]
    return pa.Table.from_batches([_batch(SUMS, [(values[0][0], *arrays, *(sum(v[i] for v in values) for i in (5, 6, 7, 8)))])])


def _state(shards: DataFrame, states: list[dict], hot: np.ndarray, how: HpyConfig) -> dict:
    sc = shards.sparkSession.sparkContext
    run = _totals_of(sc.broadcast(states), sc.broadcast(hot), how)
    sums = shards.select("shard", *"abcd").mapInArrow(_freeing(run), SUMS).groupBy("part").applyInArrow(_added, SUMS).collect()
    add = lambda name, size: sum((np.frombuffer(r[name], np.float64) for r in sums), np.zeros(size))
    by_context, customers, hot_tables, hot_customers = (add(c, n) for c, n in (("tables", CONTEXTS), ("customers", CONTEXTS), ("hot_tables", len(hot)), ("hot_customers", len(hot))))
    tokens, known = sum(r["tokens"] for r in sums), sum(r["known"] for r in sums) + int(np.count_nonzero(hot_customers))
    base = 0.5 / max(known, 1)
    rng = np.random.default_rng([how.seed, len(states)])
    root_opening = states[-1]["next_root_opening"] if states else how.root_strength * base
    hot_root = seat(hot_tables.astype(np.int64), np.full(len(hot), root_opening), how.root_discount, rng)
    tables, root = sum(r["total_tables"] for r in sums) + hot_tables.sum(), sum(r["total_root"] for r in sums) + hot_root.sum()
    new = (how.root_strength + how.root_discount * root) / (how.root_strength + tables)
    hot_probability = np.maximum(hot_tables - how.root_discount * hot_root, 0) / (how.root_strength + tables) + new * np.where(hot_customers > 0, base, 0.5)
    return {
        "number": len(states), "by_context": by_context, "customers": customers, "hot": hot_probability, "hot_customers": hot_customers, "tables": tables, "new": new, "base": base,
        "tokens": tokens, "known": known, "root_opening": (how.root_strength + how.root_discount * root) * base, "next_root_opening": (how.root_strength + how.root_discount * root) * base,
    }


def _score(states, hot, how: HpyConfig):
    """Sums over a shard's tokens for every document: log probability, log of count + 1, known tokens."""

    def rows_of(found):
        return _batch(PACKED, [_row(0, 2, flush, score, base, known.astype(np.int32)) for flush, (score, base, known) in found.items()])

    def run(batches):
        found: dict[int, list[np.ndarray]] = {}
        held = 0
        for number, values in _shards(batches, "abcdefghi"):
            shard = Shard(number, *values[:4], hot.value)
            probability, n = np.zeros(len(shard.count)), 0
            for i, totals in enumerate(states.value):
                # after sweep i the shard is in the state that totals i describe
                if i:
                    shard.sweep(states.value[i - 1], how)
                if i > how.burn_in or len(states.value) == 1:
                    own = shard.count - how.discount * shard.tables
                    np.maximum(own, 0, out=own)
                    own += shard.opening(totals, how)
                    own /= (how.strength + totals["customers"])[shard.context]
                    probability += own
                    n += 1
            probability /= n
            logs = np.log10(probability, out=probability)
            customers = shard.customers.copy()
            customers[shard.is_hot] = states.value[-1]["hot_customers"][shard.hot_at[shard.is_hot]]
            base, known = np.log10(customers + 1)[shard.name], (customers > 0)[shard.name]
            flushes, sizes, pair, docs_of = (np.frombuffer(v, k) for v, k in zip(values[4:8], (np.int64, np.int64, np.int32, np.int32)))
            entries, at, entry = np.frombuffer(values[8], np.uint16), 0, 0
            for flush, (n_pairs, n_entries) in zip(flushes, sizes.reshape(-1, 2)):
                each = np.repeat(pair[at : at + n_pairs], docs_of[at : at + n_pairs])
                doc, times = entries[entry : entry + n_entries].astype(np.int64), entries[entry + n_entries : entry + 2 * n_entries]
                at, entry = at + n_pairs, entry + 2 * n_entries
                sums = [np.bincount(doc, v[each] * times) for v in (logs, base, known)]
                old = found.get(int(flush), sums)
                if old is not sums:
                    held -= len(old[0])
                    sums = [_plus(x, y) for x, y in zip(old, sums)]
                found[int(flush)] = sums
                held += len(sums[0])
            if held > HELD_SUMS:
                yield rows_of(found)
                found, held = {}, 0
        if found:
            yield rows_of(found)

    return run


def _plus(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if len(x) < len(y):
        x, y = y, x
    x[: len(y)] += y
    return x


def _documents(table: pa.Table) -> pa.Table:
    """The documents of one flush with the sums of all shards."""
    ids = held = lengths = None
    parts = []
    for kind, a, b, c in rows([table], "kind", "a", "b", "c"):
        if kind == 1:
            ids, held, lengths = np.frombuffer(a, np.int64), np.frombuffer(b, bool), np.frombuffer(c, np.int64)
        else:
            parts.append((np.frombuffer(a, np.float64), np.frombuffer(b, np.float64), np.frombuffer(c, np.int32)))
    score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    for a, b, c in parts:
        score[: len(a)] += a
        base[: len(b)] += b
        known[: len(c)] += c
    doc_ids = pa.array(ids, mask=ids == LAST)
    return pa.table([doc_ids, pa.array(held), pa.array(lengths), pa.array(known), pa.array(base), pa.array(score)], names=[f.split()[0] for f in RESULT.split(", ")])


def score_documents(docs: DataFrame, how: HpyConfig = HpyConfig()) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs(doc_id, text)``.

    Documents whose crc32(doc_id as text) mod 7 is 2 are held out; the model learns from all others.  A document's
    tokens are its words and one end.  ``base_score`` is that of add-one smoothing of single words, ``score`` the
    model's, both log10.  Words that training doesn't have share one unknown word, so the probabilities of the known
    words and the unknown one add up to 1 in every context; perplexity is 10 ** (-score / n_tokens).

    Null and empty texts have one token, the end.  A null doc_id counts as held out, and so does the id 2**63 - 1,
    which stands for it inside.  Repeated rows count and are scored each.  With no training document every token
    is unknown.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc_id = F.col("doc_id").cast("long")
    held = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == FOLD, F.lit(True))
    docs = docs.select(doc_id.alias("doc_id"), held.alias("held"), F.col("text").cast("string").alias("text"))
    with small_batches(spark):
        hot = frequent_words(docs, shards)
        packed = docs.mapInArrow(_freeing(_count(spark.sparkContext.broadcast(hot), shards)), PACKED)
        table = settle(packed.groupBy("shard").applyInArrow(_merge, PACKED), "counts")
    main = table.filter("kind = 0")
    states: list[dict] = []
    sc = spark.sparkContext
    with one_row_at_a_time(spark):
        for _ in range(1 + how.burn_in + how.samples):
            states.append(_state(main, states, hot, how))
        scored = main.select("shard", *"abcdefghi").mapInArrow(_freeing(_score(sc.broadcast(states), sc.broadcast(hot), how)), PACKED)
        scored = settle(scored, "sums")
    both = scored.unionByName(table.filter("kind = 1")).select("flush", "kind", "a", "b", "c")
    out = both.groupBy("flush").applyInArrow(_documents, RESULT)
    tokens, known = states[-1]["tokens"], states[-1]["known"]
    base = F.col("base_known") - F.col("n_tokens") * F.log10(F.lit(float(tokens + known + 1)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
