"""Hard negatives by bounds along a spanning tree of the anchors.

The score of an anchor and a candidate is the inner product of their vectors. If it is known
for an anchor, it is known for the anchor's child in the tree up to the length of the edge
times the candidate's norm. So a task takes the anchors of a tree from parent to child, keeps
an interval for every candidate of its block, and computes a score only where the interval
meets the window of scores that are looked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shared import cut, distinct_ids, keep

#: Candidates of a block and anchors of a tree, as powers of two: each pair of these is a task's work.
BLOCK, TREE = 11, 9
#: Squared norms are this at most, so that all scores fit a long and five times a score does.
LARGEST = float(1 << 60)
#: Relative slack of bounds, far above rounding errors.
SLACK = 1e-9


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of the shortest spanning tree: vectors in an order that has children behind parents and
    subtrees together, the parent's place in that order (-1 for the root, which is the nearest to the mean), the distance to it."""
    x = vectors.astype(np.float64)
    n, squares = len(x), (x * x).sum(1)
    root = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    nearest, distance = np.full(n, root), ((x - x[root]) ** 2).sum(1)
    children: dict[int, list[int]] = {}
    open_, at = np.ones(n, bool), root
    for _ in range(n - 1):
        open_[at] = False
        closer = open_ & ((away := np.maximum(squares + squares[at] - 2 * (x @ x[at]), 0)) < distance)
        nearest[closer], distance[closer] = at, away[closer]
        at = int(np.where(open_, distance, np.inf).argmin())
        children.setdefault(int(nearest[at]), []).append(at)
    order, stack, place = [], [root], np.zeros(n, np.int64)
    while stack:
        at = stack.pop()
        place[at] = len(order)
        order.append(at)
        stack += children.get(at, ())
    order = np.array(order)
    parent = place[nearest[order]]
    parent[0] = -1
    edge = np.sqrt(((x[order] - x[nearest[order]]) ** 2).sum(1))
    return order, parent, edge


def _planted(group: pa.Table) -> pa.Table:
    """The anchors of one tree with their places, parents and edges."""
    order, parent, edge = spanning_tree(_matrix(group.column("v")))
    return group.take(pa.array(order)).append_column("place", pa.array(np.arange(len(order)))).append_column("parent", pa.array(parent)).append_column("edge", pa.array(edge))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = len(column)
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


class Scores:
    """Exact scores of a block's candidates, and intervals for those that aren't computed."""

    def __init__(self, anchors: np.ndarray, candidates: np.ndarray):
        squares = [(x.astype(np.float64) ** 2).sum(1) for x in (anchors, candidates)]
        self.anchor_norms, self.norms = (np.sqrt(x) for x in squares)
        if self.anchor_norms.max() * self.norms.max() < 2**52:  # every partial sum is a float without rounding
            anchors, candidates = anchors.astype(np.float64), candidates.astype(np.float64)
        self.anchors, self.candidates = anchors, candidates

    def exact(self, anchor: int, which: np.ndarray) -> np.ndarray:
        return (self.candidates[which] @ self.anchors[anchor]).astype(np.int64)

    def walk(self, parents: np.ndarray, edges: np.ndarray, warm, window, computed) -> None:
        """Anchor after anchor: `window(anchor, warm)` gives the lowest and highest score of interest and which candidates count,
        `computed(anchor, which, scores)` gets the scores that may lie inside and returns what its children start from."""
        left = np.bincount(parents[1:], minlength=len(parents)) if len(parents) > 1 else np.zeros(1, np.int64)
        intervals: dict[int, tuple] = {}
        for a in range(len(parents)):
            if a:
                low, high, start = intervals[parents[a]]
                reach = (edges[a] * (1 + SLACK) + SLACK * self.anchor_norms[parents[a]]) * self.norms
                low, high = low - reach, high + reach
                left[parents[a]] -= 1
                if not left[parents[a]]:
                    del intervals[parents[a]]
            else:
                low, high, start = np.full(len(self.norms), -np.inf), np.full(len(self.norms), np.inf), warm
            least, most, counts = window(a, start)
            which = np.flatnonzero(counts & (high >= least) & (low <= most)) if least <= most else np.zeros(0, np.int64)
            every = which if a and 2 * len(which) < len(low) else np.arange(len(low))  # a root, or most of a block: all at once
            if len(which) or not a:
                scores = self.exact(a, every)
                low[every] = high[every] = scores
                start = computed(a, which, scores if every is which else scores[which])
            if left[a]:
                intervals[a] = low, high, start


def _first(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties by smaller id, then row."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((rows[some], ids[some], -scores[some]))[:k]]


def _columns(table: pa.Table, *names: str) -> Iterator[np.ndarray]:
    return (table.column(name).to_numpy() for name in names)


PAIRS = "anchor long, other long, other_id long, score long"


def _pairs(found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    empty = np.zeros(0, np.int64)
    anchor = np.concatenate([empty, *(np.full(len(rows), a) for a, rows, _, _ in found)])
    rest = (np.concatenate([empty, *(x[i] for x in found)]) for i in (1, 2, 3))
    return pa.table(dict(zip(("anchor", "other", "other_id", "score"), (anchor, *rest), strict=True)))


def _positives(k: int):
    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        if not candidates.num_rows or not anchors.num_rows:
            return _pairs([])
        anchors = anchors.sort_by("place")
        rows, ids, labels = _columns(candidates, "row", "id", "label")
        own, own_labels, parents, edges = _columns(anchors, "row", "label", "parent", "edge")
        scores, found = Scores(_matrix(anchors.column("v")), _matrix(candidates.column("v"))), []

        def window(a: int, warm: np.ndarray):
            counts = (labels == own_labels[a]) & (rows != own[a])
            start = warm[counts[warm]]
            return (float(scores.exact(a, start).min()) if len(start) >= k else -np.inf), np.inf, counts

        def computed(a: int, which: np.ndarray, values: np.ndarray) -> np.ndarray:
            first = _first(values, ids[which], rows[which], k)
            best = which[first]
            if len(best):
                found.append((own[a], rows[best], ids[best], values[first]))
            return best

        scores.walk(parents, edges, np.zeros(0, np.int64), window, computed)
        return _pairs(found)

    return run


def _negatives(k: int, least: int, most: int):
    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        if not candidates.num_rows or not anchors.num_rows:
            return _pairs([])
        anchors = anchors.sort_by("place")
        rows, ids, labels = _columns(candidates, "row", "id", "label")
        own, own_labels, parents, edges = _columns(anchors, "row", "label", "parent", "edge")
        # whole numbers: least * positive <= 100 * negative <= most * positive
        windows = [sorted({(-(-least * s // 100), most * s // 100) for s in positive or () if least * s <= most * s}) for positive in anchors.column("positives").to_pylist()]
        scores, found = Scores(_matrix(anchors.column("v")), _matrix(candidates.column("v"))), []

        def window(a: int, warm: np.ndarray):
            counts = labels != own_labels[a]
            if not windows[a]:
                return 1, 0, counts
            lowest, highest = windows[a][0]
            start = warm[counts[warm]]
            inside = scores.exact(a, start)
            inside = inside[(inside >= lowest) & (inside <= highest)]
            if len(inside) >= k:  # every window reaches as high as the lowest one, so the k best below its top bound all that is returned
                lowest = np.partition(inside, len(inside) - k)[len(inside) - k]
            return lowest, windows[a][-1][1], counts

        def computed(a: int, which: np.ndarray, values: np.ndarray) -> np.ndarray:
            best = np.zeros(0, np.int64)
            for lowest, highest in windows[a]:
                inside = np.flatnonzero((values >= lowest) & (values <= highest))
                best = np.union1d(best, inside[_first(values[inside], ids[which[inside]], rows[which[inside]], k)])
            if len(best):
                found.append((own[a], rows[which[best]], ids[which[best]], values[best]))
            return which[best]

        scores.walk(parents, edges, np.zeros(0, np.int64), window, computed)
        return _pairs(found)

    return run


def hard_negatives(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", *, anchor: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its
    positives the first negatives whose score is between `least` and `most` percent of the positive's.

    A row's vector becomes floor(scale * x) in each component, its score the inner product with
    the anchor's, exactly. Higher scores come first, ties by smaller id. Anchors are rows of df
    for which `anchor` holds (ids divisible by 100 if not given); all rows are candidates. An
    anchor's positives are its first other rows of the same label, its negatives rows of other
    labels. Positives below zero have no window, hence no rows.

    Rows with a null id, label, or vector, an empty vector, a null or non-finite component, or
    with components so large that scores may not fit a long (squared norm above 2^60) take no
    part. Vectors of different lengths are not compared. Labels that aren't whole numbers are
    told apart by a 64-bit hash. Rows that repeat, also with the same
    id, are rows of their own. Other columns are ignored; an empty table gives no rows.
    """
    key = F.col(id_column).cast("long")
    chosen = key % 100 == 0 if anchor is None else anchor
    label = F.col(label_column)
    label = label.cast("long") if isinstance(df.schema[label_column].dataType, IntegralType) else F.xxhash64(label.cast("string"))
    vector = F.transform(F.col(vector_column).cast("array<double>"), lambda x: F.floor(x * scale))
    bad = F.exists(F.col(vector_column).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > float(1 << 52)))
    rows = df.filter(key.isNotNull() & F.col(label_column).isNotNull() & (F.size(vector_column) > 0) & ~F.coalesce(bad, F.lit(True)))
    rows = rows.select(key.alias("id"), label.alias("label"), F.coalesce(chosen, F.lit(False)).alias("chosen"), vector.alias("v"))
    rows = rows.filter(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) <= LARGEST)
    rows = distinct_ids(rows, "id", "v", "row").withColumn("size", F.size("v"))

    # blocks and trees hold neighbours in the order of labels: in a block of one label either positives or negatives are looked for
    def dealt(part: DataFrame, name: str, power: int) -> DataFrame:
        placed = F.monotonically_increasing_id()
        ordered = part.orderBy("size", "label", F.xxhash64("row")).withColumn("part", F.shiftright(placed, 33)).withColumn("place", placed.bitwiseAND(F.lit((1 << 33) - 1)))
        ordered = keep(ordered)
        # places without gaps, whatever the number of partitions: a row a partition says how many rows lie before it
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = ordered.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        numbered = ordered.join(F.broadcast(cut(sizes.select("part", "before"))), "part")  # as many rows as partitions
        return numbered.withColumn(name, F.concat_ws(":", "size", F.shiftright(F.col("place") + F.col("before"), power).cast("string"))).drop("place", "part", "before")

    candidates = dealt(rows.select("row", "id", "label", "size", "v"), "block", BLOCK)
    trees = dealt(rows.filter("chosen").select("row", "id", "label", "size", "v"), "tree", TREE)
    shape = trees.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    trees = keep(trees.groupBy("tree").applyInArrow(_planted, f"{shape.replace(',', ', ')}, place long, parent long, edge double"))

    def ends(part: DataFrame, name: str) -> DataFrame:
        return part.groupBy("size", name).agg(F.min("label").alias(f"{name}_low"), F.max("label").alias(f"{name}_high"))

    met = cut(ends(trees, "tree").join(ends(candidates, "block"), "size").drop("size"))
    same = met.filter("tree_low <= block_high and block_low <= tree_high").select("tree", "block")
    other = met.filter("tree_low < tree_high or block_low < block_high or tree_low <> block_low").select("tree", "block")

    def searched(pairs: DataFrame, anchors: DataFrame, work) -> DataFrame:
        left = candidates.join(pairs, "block").select("tree", "block", "row", "id", "label", "v")
        right = anchors.join(pairs.withColumnRenamed("block", "block_"), "tree").withColumnRenamed("tree", "tree_")
        return left.groupBy("tree", "block").cogroup(right.groupBy("tree_", "block_")).applyInArrow(work, PAIRS)

    def order(*by: str):
        return Window.partitionBy(*by).orderBy(F.desc("score"), "other_id", "other")

    near = searched(same, trees.drop("size", "id"), _positives(positives)).withColumn("k", F.row_number().over(order("anchor"))).filter(F.col("k") <= positives)
    near = cut(near.select("anchor", F.col("other").alias("positive"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    wanted = near.groupBy("anchor").agg(F.collect_set("positive_score").alias("positives"))
    bounded = trees.drop("size", "id").join(wanted.withColumnRenamed("anchor", "row"), "row", "left")
    found = searched(other, bounded, _negatives(negatives, least, most)).join(near, "anchor")
    whole = lambda c, percent: F.col(c).cast("decimal(20,0)") * percent
    found = found.filter((whole("positive_score", least) <= whole("score", 100)) & (whole("score", 100) <= whole("positive_score", most)))
    found = found.withColumn("rank", F.row_number().over(order("anchor", "positive"))).filter(F.col("rank") <= negatives)
    ids = trees.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return found.join(ids, "anchor").select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
