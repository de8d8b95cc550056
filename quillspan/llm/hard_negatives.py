"""Hard-negative mining: spanning trees of anchors bound scores, only possible hits are scored.

Anchors are put into trees of bounded size, each the least spanning tree of its members by distance.  A row is
scored exactly against a tree's root; along an edge of length e its score can change by at most e times its own
norm, so the parent's score, or the parent's bounds, bound the child's.  A row is scored again only for an anchor
whose window its bounds overlap: the scores that could still enter one of the anchor's lists.

Trees come in passes of bounded size.  A pass reads all rows twice, once for the positives, once for the negatives
inside the windows that the positives set; the lists of all tasks meet in a ranking per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.tables import drop, settle

TREE_ANCHORS, PASS_BYTES, BATCH = 256, 16 << 20, 4096
ANCHOR_BYTES = 1024  # an anchor's ids, edges and windows, besides its vector
EXACT = 2.0**52  # whole numbers below it, and sums of them, are exact as double
_TREES = "tree long, size int, dim int, ids binary, labels binary, vectors binary, parents binary, edges binary"
_HITS = "tree long, node int, slot int, anchor_id long, vec_id long, score long"
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _vectors(batches, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(ids, labels, whole-number vectors)`` of the rows that take part, in blocks of one dimension each."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            ids, labels, vectors = (part.column(part.schema.get_field_index(n)) for n in ("vec_id", "label", "embedding"))
            length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = vectors.flatten()
            values = np.floor(scale * flat.to_numpy(zero_copy_only=False).astype(np.float64))
            wrong = ~np.isfinite(values) | flat.is_null().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(length)), length)
            good = np.bincount(row[wrong], minlength=len(length)) == 0
            for column in (ids, labels, vectors):
                good &= column.is_valid().to_numpy(zero_copy_only=False)
            ids, labels = (pc.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in (ids, labels))
            for dim in np.unique(length[good]):
                chosen = good & (length == dim)
                yield ids[chosen], labels[chosen], values[np.repeat(chosen, length)].reshape(int(chosen.sum()), dim)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, parents, edges)`` of the least spanning tree: rows in an order that puts parents first,
    the place of each one's parent in that order, and the length of the edge to it."""
    n = len(vectors)
    order, parents, edges = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n)
    near, nearest = np.full(n, np.inf), np.zeros(n, np.int32)
    now = 0
    for k in range(1, n):
        near[now] = -1.0
        apart = np.sqrt(((vectors - vectors[now]) ** 2).sum(axis=1))
        closer = apart < near
        near[closer], nearest[closer] = apart[closer], k - 1
        now = int(np.argmin(np.where(near < 0, np.inf, near)))
        if near[now] < 0:  # all that are left are infinitely far
            now = int(np.flatnonzero(near >= 0)[0])
        order[k], parents[k], edges[k] = now, nearest[now], near[now]
    return order, parents, edges


def _trees(scale: int, most: int):
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def tree(dim: int) -> pa.RecordBatch:
            nonlocal number
            parts = held.pop(dim)
            ids, labels, vectors = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order, parents, edges = spanning_tree(vectors)
            blobs = [ids[order].astype("<i8"), labels[order].astype("<i8"), vectors[order].astype("<f8"), parents.astype("<i4"), edges.astype("<f8")]
            number += 1
            row = [pa.array([number], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([dim], pa.int32())]
            return pa.RecordBatch.from_arrays(row + [pa.array([b.tobytes()], pa.binary()) for b in blobs], names=[c.split()[0] for c in _TREES.split(", ")])

        for ids, labels, vectors in _vectors(batches, scale):
            dim = vectors.shape[1]
            while len(ids):
                room = most - sum(len(p[0]) for p in held.get(dim, []))
                held.setdefault(dim, []).append((ids[:room], labels[:room], vectors[:room]))
                ids, labels, vectors = ids[room:], labels[room:], vectors[room:]
                if room <= len(held[dim][-1][0]):
                    yield tree(dim)
        for dim in list(held):
            yield tree(dim)

    return run


class Tree:
    """The anchors of one tree; parents come before their children."""

    def __init__(self, row):
        self.tree, self.dim = row["tree"], row["dim"]
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(self.ids), self.dim)
        self.parents, self.edges = np.frombuffer(row["parents"], "<i4"), np.frombuffer(row["edges"], "<f8")
        self.norm = float(np.sqrt((self.vectors**2).sum(axis=1)).max(initial=0.0))


class Search:
    """Lists of the ``keep`` best rows for every (anchor, window) of some trees.

    ``windows[tree, node]`` holds ``(slot, low, high)``: only scores from ``low`` to ``high`` count for the slot.
    ``same`` asks for rows of the anchor's label, else for rows of other labels; rows of the anchor's own id never count.
    """

    def __init__(self, trees: list[Tree], windows: dict, keep: int, same: bool):
        self.trees, self.windows, self.keep, self.same = trees, windows, keep, same
        self.best: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        self.bounded = self.scored = 0

    def feed(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        norms = np.sqrt((vectors**2).sum(axis=1))
        for tree in self.trees:
            if tree.dim != vectors.shape[1]:
                continue
            if self.same:
                near = np.isin(labels, tree.labels)
                if near.any():
                    self._tree(tree, ids[near], labels[near], vectors[near], norms[near])
            elif any((tree.tree, node) in self.windows for node in range(len(tree.ids))):
                self._tree(tree, ids, labels, vectors, norms)

    def _tree(self, tree: Tree, ids, labels, vectors, norms) -> None:
        exact = norms.max(initial=0.0) * tree.norm < EXACT
        low, high = np.empty((len(tree.ids), len(ids))), np.empty((len(tree.ids), len(ids)))
        for node in range(len(tree.ids)):
            slots = [(s, a, b, self._least(tree.tree, node, s, a)) for s, a, b in self.windows.get((tree.tree, node), [])]
            allowed = ((labels == tree.labels[node]) == self.same) & (ids != tree.ids[node])
            if not exact:  # scores past the range of exact doubles: whole numbers of any size, no bounds
                if slots and allowed.any():
                    self._keep(tree, node, slots, ids[allowed], _long_scores(vectors[allowed], tree.vectors[node]))
                continue
            if node:
                change = tree.edges[node] * norms * (1 + 1e-9) + 1
                low[node], high[node] = low[tree.parents[node]] - change, high[tree.parents[node]] + change
                wanted = np.zeros(len(ids), bool)
                for _, _, most, least in slots:
                    wanted |= (high[node] >= least) & (low[node] <= most)
                wanted &= allowed
                chosen = np.flatnonzero(wanted)
                scores = (vectors if 2 * len(chosen) > len(ids) else vectors[chosen]) @ tree.vectors[node]
                scores = scores[chosen] if len(scores) > len(chosen) else scores
                low[node, chosen] = high[node, chosen] = scores
            else:
                low[0] = high[0] = vectors @ tree.vectors[0]
                chosen = np.flatnonzero(allowed)
                scores = low[0, chosen]
            self.bounded += len(ids)
            self.scored += len(ids) if not node else len(chosen)
            self._keep(tree, node, slots, ids[chosen], scores)

    def _least(self, tree: int, node: int, slot: int, low):
        """What a score must reach to enter the list: the window's start, or the last place of a full list."""
        held = self.best.get((tree, node, slot))
        return low if held is None or len(held[0]) < self.keep else max(low, held[0][-1])

    def _keep(self, tree: Tree, node: int, slots: list, ids: np.ndarray, scores: np.ndarray) -> None:
        for slot, _, most, least in slots:
            fits = (scores >= least) & (scores <= most)
            if not fits.any():
                continue
            key = (tree.tree, node, slot)
            new, own = scores[fits], ids[fits]
            if key in self.best:
                new, own = np.concatenate([self.best[key][0], new]), np.concatenate([self.best[key][1], own])
            if len(new) > 8 * self.keep and new.dtype != object:
                last = np.partition(new, len(new) - self.keep)[len(new) - self.keep]
                new, own = new[new >= last], own[new >= last]
            first = np.array(sorted(range(len(new)), key=lambda i: (-new[i], own[i]))[: self.keep], np.int64)
            self.best[key] = new[first], own[first]

    def hits(self) -> Iterator[pa.RecordBatch]:
        ids = {(t.tree, node): int(i) for t in self.trees for node, i in enumerate(t.ids)}
        out = [(tree, node, slot, ids[tree, node], int(i), _long(s)) for (tree, node, slot), (scores, own) in self.best.items() for s, i in zip(scores, own)]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for at in range(0, len(out), 50_000):
            columns = list(zip(*out[at : at + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _HITS.split(", ")])


def _long_scores(vectors: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    own = [int(x) for x in anchor]
    return np.array([sum(int(x) * y for x, y in zip(v, own)) for v in vectors] + [None], object)[:-1]


def _long(score) -> int:
    return max(-(2**63), min(2**63 - 1, int(score)))


def _search(shared, keep: int, same: bool, scale: int):
    def run(batches):
        trees, windows = shared.value
        search = Search([Tree(t) for t in trees], windows, keep, same)
        for block in _vectors(batches, scale):
            search.feed(*block)
        yield from search.hits()

    return run


def _ranked(hits: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("tree", "node", "slot").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    scale: int = 256, tree_anchors: int = TREE_ANCHORS, pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``vec_id, label, embedding``.

    Components become ``floor(scale * x)``; a score is the inner product with the anchor, exact at any size.  The
    ``positives`` best rows of an anchor's label are its positives, ties to the smaller id.  For each of them the
    ``negatives`` best rows of other labels with ``low * p <= 100 * n <= high * p`` are returned, ranked from 1.
    A pass holds trees of ``pass_bytes`` in expectation: they and their windows are all that is sent to every task.

    Rows with a null id, label, vector, or a null or non-finite component take no part.  Only vectors of one
    dimension are compared; empty vectors score 0.  Repeated rows are rows of their own, so each is ranked; a row
    whose id is the anchor's is neither its positive nor its negative.  Scores past 64 bits are written as the
    nearest that fits.  An empty table, or one without anchors, gives no rows; other columns are ignored.
    """
    if min(positives, negatives, tree_anchors, pass_bytes) < 1 or low > high:
        raise ValueError("counts must be positive and the window not empty")
    spark = rows.sparkSession
    given = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    anchors = given.filter("is_anchor and vec_id is not null and label is not null and embedding is not null").drop("is_anchor")
    trees = settle(anchors.repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id").mapInArrow(_trees(scale, tree_anchors), _TREES), "anchor-trees")
    rows = given.drop("is_anchor")
    passes = -(-(trees.agg(F.sum(F.col("size") * (8 * F.col("dim") + ANCHOR_BYTES))).first()[0] or 0) // pass_bytes)
    found = []
    for number in range(passes):
        own = [r.asDict() for r in trees.filter(F.pmod(F.xxhash64("tree"), F.lit(passes)) == number).collect()]
        wide = {(t["tree"], node): [(0, -np.inf, np.inf)] for t in own for node in range(t["size"])}
        shared = spark.sparkContext.broadcast((own, wide))
        best = _ranked(rows.mapInArrow(_search(shared, positives, True, scale), _HITS), positives)
        windows, known = {}, []
        for r in best.select("tree", "node", "rank", "vec_id", "score").collect():  # at most `positives` for each anchor of the pass
            if low * r.score <= high * r.score:
                windows.setdefault((r.tree, r.node), []).append((r["rank"], -(-low * r.score // 100), high * r.score // 100))
                known.append(tuple(r))
        if known:
            shared = spark.sparkContext.broadcast((own, windows))
            hits = _ranked(rows.mapInArrow(_search(shared, negatives, False, scale), _HITS), negatives)
            positive = spark.createDataFrame(known, "tree long, node int, slot int, positive_id long, positive_score long")
            out = hits.join(positive, ["tree", "node", "slot"])
            found.append(settle(out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard-negatives"))
    drop(trees)
    if not found:
        return spark.createDataFrame([], SCHEMA)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
