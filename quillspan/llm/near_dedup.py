"""Near-duplicate documents: MinHash with tensored banding.

A table of plain banding needs its own ``2k`` hash functions.  Here ``side`` collections of ``k``
functions on the left and as many on the right form ``side * side`` tables: table (i, j) has the pair
(left i, right j) for its key.  100 tables of 8 minhashes so cost 80 functions, not 800.  A pair of
similarity s shares a table with probability (1 - (1 - s**k)**side)**2: 0.9988 at 0.85 with the defaults.

Documents with equal sets are one node from the start.  In every bucket all nodes are compared with the
least one (the centre), so a bucket of any size costs one comparison a member.  What that leaves open, a
link between two members of which one is not linked with the centre, is found exactly from the members'
differences to any one set of n shingles: with r of it removed and a added, and g = 100 r + 85 a, members x
and y are linked if and only if 185 * shared differences >= g(x) + g(y) - 15 n.  The set is the consensus of
the open members of a centre, the shingles that most of them have, so that copies of one text keep their own
edits only, however far the centre is.  All are compared with the member nearest to it (the hub).  For other pairs
the right side is above 0, and one of the first few differences in a fixed order, rare ones first, is common
to both.  The bounds are those of a similarity of 0.85 and follow the parameter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.components import components
from quillspan.llm.tables import drop, settle
from quillspan.llm.words import HASHES, mix, rows, shingles, words

SIDE, K, BITMAP = 10, 4, 24
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>"


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return drawn[:count] | np.uint64(1), drawn[count:]


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingles(HASHES.of(words(text)), size))


def _table_keys(values: np.ndarray, side: int, k: int) -> np.ndarray:
    factors, shifts = _functions(2 * side * k)
    least = np.full(2 * side * k, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096, None] * factors + shifts
        least = np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=0))
    halves = least.reshape(2 * side, k)
    joined = halves[:, 0]
    for i in range(1, k):
        joined = mix(joined) + halves[:, i]
    left, right = mix(joined[:side]), joined[side:]
    table = np.arange(side * side, dtype=np.uint64).reshape(side, side)
    return mix((left[:, None] + right[None, :] * np.uint64(3)) ^ mix(table + np.uint64(1))).ravel()


def _sign(size: int, side: int, k: int):
    def run(batches):
        out: list[tuple] = []
        for doc_id, text in rows(batches, "doc_id", "text"):
            values = shingle_set(text, size)
            if len(values):
                digest = xxhash.xxh3_128_digest(values.tobytes())
                a, b = np.frombuffer(digest, np.int64)
                out.append((doc_id, len(values), int(a), int(b), _table_keys(values, side, k).view(np.int64)))
            else:
                out.append((doc_id, 0, None, None, None))
            if len(out) >= 500:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return run


def _batch(out: list[tuple]) -> pa.RecordBatch:
    ids, n, a, b, keys = zip(*out)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
        names=["doc_id", "n_shingles", "set_a", "set_b", "keys"],
    )


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t, size).view(np.int64) for (t,) in rows([part], "text")]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "items"])

    return run


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Differences between the sets of ``node`` and ``centre``, and whether they reach the similarity."""
    centres = sets.select(F.col("node").alias("centre"), F.col("items").alias("of_centre"))
    both = pairs.join(sets, "node").join(centres, "centre")
    return both.select(
        "centre", "node", F.size("of_centre").alias("n"),
        F.array_except("items", "of_centre").alias("added"), F.array_except("of_centre", "items").alias("removed"),
    )


def _places(ids: np.ndarray) -> list[np.ndarray]:
    """Two places of each id in a bitmap of 2 ** BITMAP bits."""
    hashed = mix(ids.astype(np.int64).view(np.uint64))
    return [(hashed & np.uint64((1 << BITMAP) - 1)).astype(np.int64), (hashed >> np.uint64(64 - BITMAP)).astype(np.int64)]


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of the ids in ``doc_id``: of fixed size, whatever their number."""
    schema = "part int, bits binary"

    def mark(batches):
        bits = np.zeros(1 << BITMAP, bool)
        for batch in batches:
            for place in _places(batch.column(0).to_numpy()):
                bits[place] = True
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 4], pa.int32()), pa.array([np.packbits(bits).tobytes()])], names=["part", "bits"])

    def join(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for (b,) in rows([table], "bits")])
        return pa.table([table.column("part").slice(0, 1), pa.array([bits.tobytes()])], names=["part", "bits"])

    found = ids.mapInArrow(mark, schema).groupBy("part").applyInArrow(join, schema).collect()
    bits = np.zeros((1 << BITMAP) // 8, np.uint8)
    for row in found:
        bits |= np.frombuffer(row["bits"], np.uint8)
    return bits


def _perhaps(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among the ids, and few others; keeps most texts out of the join that follows."""
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(ids))

    @F.pandas_udf("boolean")
    def marked(values: pd.Series) -> pd.Series:
        first, second = ((sent.value[p >> 3] >> (7 - (p & 7)) & 1).astype(bool) for p in _places(values.to_numpy()))
        return pd.Series(first & second)

    return docs.filter(F.col("doc_id").isNotNull()).filter(marked("doc_id"))


def near_links(docs: DataFrame, signed: DataFrame, reps: DataFrame, size: int, percent: int) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Links that connect every two nodes which share a bucket and reach ``percent``; and the tables used on the way."""
    nodes = signed.join(reps.select("set_a", "set_b", F.col("node").alias("doc_id")), ["set_a", "set_b", "doc_id"])
    keys = nodes.dropDuplicates(["set_a", "set_b"]).select(F.col("doc_id").alias("node"), F.explode("keys").alias("key"))
    centres = keys.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("centre < last")
    bucketed = settle(keys.join(centres.select("key", "centre"), "key").filter("node <> centre"), "buckets")
    pairs = settle(bucketed.select("node", "centre").distinct(), "pairs")
    wanted = pairs.select(F.col("node").alias("doc_id")).unionByName(pairs.select(F.col("centre").alias("doc_id"))).distinct()
    wanted = settle(wanted, "wanted")
    sets = settle(_perhaps(docs, wanted).join(wanted, "doc_id", "left_semi").mapInArrow(_sets(size), "node long, items array<long>"), "sets")
    compared = _compared(pairs, sets)
    # 100 * common >= percent * union, in terms of the differences
    gap = 100 * F.size("removed") + percent * F.size("added")
    compared = settle(compared.withColumn("gap", gap).withColumn("room", (100 - percent) * F.col("n")), "compared")
    direct = compared.filter("gap <= room").select(F.col("node").alias("src"), F.col("centre").alias("dst"))
    beside = _links_beside(compared, bucketed, components(direct), percent)
    return settle(direct.unionByName(beside).distinct(), "near"), (bucketed, pairs, sets, compared)


def _open_members(near: DataFrame, bucketed: DataFrame, percent: int) -> DataFrame:
    """``(centre, node, first, second)``: members that share a bucket with one of another component.

    ``second``: both are far, that is not linked with the centre; ``first``: one is linked, and the other is near
    enough for it.  For a linked x and a far y of similarity: gap(y) <= room * (1 + 100 / percent).
    """
    status = near.select("centre", "node", "component", F.expr("gap > room").alias("far"), F.expr(f"gap > room and component <> of_centre and gap <= room * (1 + 100 / {percent})").alias("beyond"))
    rows = bucketed.join(status, ["centre", "node"])
    part = F.when(F.col("far"), F.col("component"))
    keys = rows.groupBy("key").agg((F.min(part) < F.max(part)).alias("second"), (F.max("beyond") & F.max(~F.col("far"))).alias("first")).filter("first or second")
    tagged = rows.join(keys, "key").groupBy("centre", "node").agg(F.max(F.expr("first and (beyond or not far)")).alias("first"), F.max(F.expr("second and far")).alias("second"))
    return tagged.filter("first or second")


def _about_consensus(members: DataFrame, percent: int) -> DataFrame:
    """The members with their differences to the consensus of their centre: the items that most of its members have.

    What more than half of the members have among their differences to the centre is turned: it goes from their
    differences and becomes one of the other members.  ``n``, ``gap`` and ``room`` follow.
    """
    each = members.select("centre", F.explode("added").alias("item"), F.lit(True).alias("new")).unionByName(members.select("centre", F.explode("removed").alias("item"), F.lit(False).alias("new")))
    count = members.groupBy("centre").agg(F.count("*").alias("members"))
    often = each.groupBy("centre", "item", "new").agg(F.count("*").alias("n")).join(count, "centre").filter("2 * n > members")
    turned = often.groupBy("centre").agg(F.collect_list(F.expr("if(new, item, null)")).alias("put_in"), F.collect_list(F.expr("if(new, null, item)")).alias("left_out"))
    none = F.array().cast("array<long>")
    put_in, left_out = F.coalesce("put_in", none), F.coalesce("left_out", none)
    out = members.join(turned, "centre", "left").select(
        "centre", "node", "component", (F.col("n") + F.size(put_in) - F.size(left_out)).alias("n"),
        F.concat(F.array_except("added", put_in), F.array_except(left_out, "removed")).alias("added"),
        F.concat(F.array_except("removed", left_out), F.array_except(put_in, "added")).alias("removed"),
    )
    return out.withColumn("gap", 100 * F.size("removed") + percent * F.size("added")).withColumn("room", (100 - percent) * F.col("n"))


def _candidates(light: DataFrame, total: int) -> DataFrame:
    """``(centre, x, y)``: members of different components that may share enough differences, one of the rarest of each among them."""

    def firsts(of: DataFrame, name: str, least: str) -> DataFrame:
        """The first differences: of ``n`` of which ``least`` are shared, one of the first n - least + 1 is."""
        of = of.withColumn("_first", F.expr(f"slice(items, 1, greatest(size(items) - cast(greatest(ceil(({least}) / {total}), 1) as int) + 1, 0))"))
        return of.select("centre", "room", F.col("node").alias(name), F.col("component").alias(f"{name}_part"), F.col("gap").alias(f"{name}_gap"), F.size("items").alias(f"{name}_size"), F.posexplode("_first").alias(f"{name}_at", "item"))

    # shared * total >= gap(x) + gap(y) - room, which is above 0 unless both are linked with the hub
    far = light.filter("not linked")
    beyond, farther = firsts(far, "y", "gap + hub_gap - room"), firsts(far, "y", "gap + least_far - room")
    first = firsts(light.filter("linked"), "x", "gap + least_far - room").join(beyond.drop("room"), ["centre", "item"])
    second = firsts(far, "x", "2 * gap - room").join(farther.drop("room"), ["centre", "item"]).filter("x_gap < y_gap or x_gap = y_gap and x < y")
    # after the first one that both have, no more are shared than either has left
    enough = f"{total} * least(x_size - x_at, y_size - y_at) >= x_gap + y_gap - room"
    return first.unionByName(second).filter(f"x_part <> y_part and {enough}").select("centre", "x", "y").distinct()


def _links_beside(compared: DataFrame, bucketed: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Links between two members of a centre of which at least one is not linked with the centre.

    ``parts(node, component)`` says what the links with centres connect already; only links between different
    components are looked for, among members that share a bucket with another component.  First all are compared
    with the member nearest to the consensus (the hub), then two joins on differences follow: of members that are
    linked with the hub and ones that are not, and of two that are not, the nearer one first.
    """
    total = 100 + percent
    near = compared.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    near = near.join(parts.select(F.col("node").alias("centre"), F.col("component").alias("of_centre")), "centre", "left")
    near = near.withColumn("of_centre", F.coalesce("of_centre", "centre"))
    open_members = settle(near.join(_open_members(near, bucketed, percent).select("centre", "node"), ["centre", "node"]), "members")
    members = settle(_about_consensus(open_members, percent), "about-consensus")

    hubs = members.groupBy("centre").agg(F.min(F.struct("gap", "node")).alias("hub")).select("centre", F.col("hub.node").alias("node"))
    hubs = members.join(hubs, ["centre", "node"]).select("centre", *(F.col(c).alias(f"hub_{c}") for c in ("node", "component", "gap", "added", "removed")))
    shared = F.size(F.array_intersect("added", "hub_added")) + F.size(F.array_intersect("removed", "hub_removed"))
    linked = (total * shared >= F.col("gap") + F.col("hub_gap") - F.col("room")).alias("linked")
    starred = settle(members.join(hubs, "centre").select("centre", "node", "component", "gap", "room", "hub_node", "hub_component", "hub_gap", linked), "starred")
    joined = starred.filter("linked and component <> hub_component")
    merged = components(joined.select(F.col("component").alias("src"), F.col("hub_component").alias("dst")))
    starred = starred.join(merged.select(F.col("node").alias("component"), F.col("component").alias("merged")), "component", "left").withColumn("component", F.coalesce("merged", "component"))
    least_far = starred.groupBy("centre").agg(F.min(F.expr("if(linked, null, gap)")).alias("least_far")).filter("least_far is not null")

    # differences in one fixed order, the ones that the fewest members of the centre have first; those of one member are shared with none
    items = members.select("centre", "node", F.explode(F.concat("added", "removed")).alias("item"))
    counted = items.withColumn("n", F.count("*").over(Window.partitionBy("centre", "item"))).filter("n > 1")
    ranked = counted.groupBy("centre", "node").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("ranked"))
    ranked = ranked.select("centre", "node", F.col("ranked.item").alias("items"))
    light = settle(starred.join(least_far, "centre").join(ranked, ["centre", "node"]), "ranked")
    found = _candidates(light, total)
    side = lambda name: members.select("centre", "room", *(F.col(c).alias(f"{name}{c}" if c != "node" else name) for c in ("node", "added", "removed", "gap")))
    found = found.join(side("x"), ["centre", "x"]).join(side("y").drop("room"), ["centre", "y"])
    shared = F.size(F.array_intersect("xadded", "yadded")) + F.size(F.array_intersect("xremoved", "yremoved"))
    found = found.filter(total * shared >= F.col("xgap") + F.col("ygap") - F.col("room")).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    return found.unionByName(joined.select(F.col("node").alias("src"), F.col("hub_node").alias("dst")))


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, side: int = SIDE, k: int = K) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    A document's set holds its distinct runs of ``size`` words (the whole sequence when it has fewer words).
    Documents are linked when 100 * common >= percent * union, confirmed on full sets; ``component_id`` is the
    least doc_id reachable, and the document that has it is kept.

    Null or empty texts, and texts without words: set size 0, linked with nothing, kept.  A null doc_id is
    linked with nothing: component null, kept.  Rows that repeat a doc_id are one document whose rows share a
    component.  Equal texts are linked, whatever their number.  An empty table gives no rows.  Other columns
    are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = settle(docs.mapInArrow(_sign(size, side, k), SIGNED), "signed")
    known = signed.filter("doc_id is not null and set_a is not null")
    reps = settle(known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node")), "nodes")
    near, used = near_links(docs, known, reps, size, percent)
    drop(*used)
    ids = known.select("doc_id", "set_a", "set_b").join(reps, ["set_a", "set_b"])
    # rows of one doc_id with different texts hang together, too
    same = ids.filter("doc_id <> node").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    repeated = same.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = components(near.unionByName(repeated))
    final = ids.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("c")).groupBy("doc_id").agg(F.min("c").alias("component"))
    out = signed.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
