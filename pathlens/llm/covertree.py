"""Embedding near-dedup by dual traversal of cover trees.

Vectors are points of the unit sphere; a cosine threshold is a distance. Spark splits the
vectors of each label around pivots, level by level, until every node is small, and descends
the levels in pairs: pairs of nodes that their covering radii keep apart are pruned before
they have children. For the pairs of small nodes that are left a task builds both nodes'
trees, nested levels with halving radii, and walks them together: pairs of nodes too far
apart are pruned, pairs near enough are linked as a whole, the rest is compared.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, cut, discard, keep

#: A node of more than twice NODE vectors is split around a pivot for each NODE of them, FAN at most; larger ones go on at the next level.
NODE, FAN = 512, 256
#: A task compares so many vectors with the pivots of their node. Nodes still large after DEPTH levels hold vectors that rounding cannot tell apart; they are cut by a hash.
GROUP, DEPTH = 1 << 14, 12
#: Nodes of so few points are leaves; those that fall into too many children too.
LEAF, MOST_CHILDREN = 48, 0.25
#: Distances this near to a bound are not decided by it.
MARGIN = 1e-7


class CoverTree:
    """Levels with halving radii over the rows of `points`."""

    def __init__(self, points: np.ndarray, members: np.ndarray, scale: float | None = None, floor: float = 0.0):
        self.members, self.children = members, []
        self.centre = points[members[0]]
        distance = np.sqrt(np.maximum(((points[members] - self.centre) ** 2).sum(1), 0))
        self.radius = float(distance.max())
        scale = self.radius if scale is None else min(scale, self.radius)
        if len(members) <= LEAF or self.radius <= floor:
            return
        left, cells = members, []
        while len(left):
            near = ((points[left] - points[left[0]]) ** 2).sum(1) <= (scale / 2) ** 2
            near[0] = True
            cells.append(left[near])
            left = left[~near]
            if len(cells) > MOST_CHILDREN * len(members):
                return
        self.children = [CoverTree(points, cell, scale / 2, floor) for cell in cells]


def dual_traversal(points: np.ndarray, a: CoverTree, b: CoverTree, cosine: float):
    """Pairs of member arrays that are linked as a whole, and index arrays of single links; each pair of points once."""
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    whole, single, stack = [], [], [(a, b)]
    while stack:
        x, y = stack.pop()
        apart = float(np.sqrt(((x.centre - y.centre) ** 2).sum())) if x is not y else 0.0
        if x is not y and apart - x.radius - y.radius > reach + MARGIN:
            continue
        if (apart + x.radius + y.radius if x is not y else 2 * x.radius) < reach - MARGIN:
            whole.append((x.members, y.members))
        elif x is y and x.children:
            stack += [(p, q) for i, p in enumerate(x.children) for q in x.children[i:]]
        elif x.children and (not y.children or x.radius >= y.radius):
            stack += [(p, y) for p in x.children]
        elif y.children:
            stack += [(x, p) for p in y.children]
        else:
            near = points[x.members] @ points[y.members].T >= cosine
            i, j = np.nonzero(np.triu(near, 1) if x is y else near)
            single.append((x.members[i], y.members[j]))
    return whole, single


def _links(points: np.ndarray, weights: np.ndarray, split: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For each point the weight of its links, and the smallest index that it reaches: within all points, or from those before `split` to those after."""
    n = len(points)
    floor = math.sqrt(max(0.0, 2 - 2 * cosine)) / 4
    first = CoverTree(points, np.arange(split or n), floor=floor)
    second = CoverTree(points, np.arange(split, n), floor=floor) if split else first
    whole, single = dual_traversal(points, first, second, cosine)
    count, ends = np.zeros(n, np.int64), []
    for a, b in whole:
        if a is b:
            count[a] += weights[a].sum() - weights[a]
        else:
            np.add.at(count, a, weights[b].sum())
            np.add.at(count, b, weights[a].sum())
        both = np.concatenate([a, b])
        ends.append((both, np.full(len(both), both.min())))
    for a, b in single:
        np.add.at(count, a, weights[b])
        np.add.at(count, b, weights[a])
        ends.append((a, b))
    label = np.arange(n)
    if ends:
        a, b = (np.concatenate([e[i] for e in ends]) for i in (0, 1))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
    return count, label


def _nearest(points: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Each vector of a node under its nearest pivot, with the distance from it; a node that drew no pivot stays as it is."""
    if points.empty or pivots.empty:
        return points[["label", "key", "rep", "copies", "unit", "node", "away"]]
    pivots = pivots.sort_values("place")
    units, centres = np.stack(points.unit.to_numpy()), np.stack(pivots.centre.to_numpy())
    at = (units @ centres.T).argmax(1)
    away = np.sqrt(((units - centres[at]) ** 2).sum(1))
    node = points.node.to_numpy() + "/" + pivots.place.to_numpy()[at].astype(str)
    return points[["label", "key", "rep", "copies", "unit"]].assign(node=node, away=away)


def _node_pairs(classes: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """The vectors with their nodes, and the pairs of nodes (node <= node_) that may hold vectors within reach of each other.

    A label starts as one node, paired with itself. At each level large nodes are split, and
    the pairs that name them give way to pairs of their children, as far as centres and radii
    allow. Joins go by label and node, never by label alone, and a large node's vectors are
    dealt over tasks, each with a copy of the node's pivots.
    """
    node = ["label", "node"]
    points = classes.select("label", "key", "rep", "copies", "unit", F.lit("").alias("node"), F.lit(0.0).alias("away"))
    pairs = classes.select("label", F.lit("").alias("node"), F.lit("").alias("node_")).distinct()
    balls, schema = None, points.schema
    distance = F.sqrt(F.aggregate(F.zip_with("centre", "centre_", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    for _ in range(DEPTH):
        large = cut(points.groupBy(*node).count().filter(F.col("count") > 2 * NODE))
        if large.isEmpty():
            break
        rows = points.join(large, node)
        # few rows reach the window: a bound on the hash leaves some more than the pivots wanted
        wanted = F.least(F.ceil(F.col("count") / NODE), F.lit(FAN))
        lot = rows.withColumn("lot", F.pmod(F.xxhash64("key"), F.lit(1 << 40))).filter(F.col("lot") < (4 * wanted + 16) * F.lit(float(1 << 40)) / F.col("count"))
        drawn = Window.partitionBy(*node).orderBy("lot", "key")
        tops = lot.withColumn("place", F.row_number().over(drawn)).filter(F.col("place") <= FAN).filter(F.col("place") <= wanted)
        tops = cut(tops.select(*node, "place", "unit", "count"))
        tasks = F.ceil(F.col("count") / GROUP).cast("int")
        copies = tops.select(F.col("label").alias("label_"), F.col("node").alias("node_"), "place", F.col("unit").alias("centre"), F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task_"))
        dealt = rows.withColumn("task", F.pmod(F.xxhash64(F.lit("task"), "key"), tasks).cast("int")).drop("count")
        split = dealt.groupBy(*node, "task").cogroup(copies.groupBy("label_", "node_", "task_")).applyInPandas(_nearest, schema)
        whole, points = points, keep(points.join(large, node, "left_anti").unionByName(split))
        if balls is not None:
            discard(whole)

        child = F.concat_ws("/", "node", F.col("place").cast("string"))
        centres = tops.select("label", F.col("node").alias("parent"), child.alias("node"), F.col("unit").alias("centre"))
        radii = points.groupBy(*node).agg(F.max("away").alias("radius"))
        children = cut(centres.join(radii, node))
        balls = children.drop("parent") if balls is None else balls.union(children.drop("parent"))
        inner = children.select("label", "parent", "node")
        one, two = (inner.select("label", F.col("parent").alias(f"node{x}"), F.col("node").alias(f"child{x}")) for x in ("", "_"))
        met = pairs.join(one, node, "left").join(two, ["label", "node_"], "left")
        met = met.select("label", (F.col("node") == F.col("node_")).alias("same"), F.coalesce("child", "node").alias("x"), F.coalesce("child_", "node_").alias("y")).filter("not same or x <= y")
        met = met.select("label", F.least("x", "y").alias("node"), F.greatest("x", "y").alias("node_"))
        other = balls.select("label", *(F.col(c).alias(f"{c}_") for c in ("node", "centre", "radius")))
        both = met.filter("node <> node_").join(balls, node).join(other, ["label", "node_"])
        near = both.filter(distance - F.col("radius") - F.col("radius_") <= reach + MARGIN)
        pairs = cut(met.filter("node = node_").unionByName(near.select("label", "node", "node_")))
    else:
        count = cut(points.groupBy(*node).agg(F.ceil(F.count("*") / NODE).alias("parts")).filter(F.col("parts") > 2))
        part = F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1)))
        cuts = points.join(count, node, "left").withColumn("part", part)
        points = keep(cuts.withColumn("node", F.concat_ws("#", "node", F.col("part").cast("string"))).drop("parts", "part"))
        inner = cut(points.select("label", F.substring_index("node", "#", 1).alias("whole"), "node").distinct())
        one, two = (inner.select("label", F.col("whole").alias(f"node{x}"), F.col("node").alias(f"child{x}")) for x in ("", "_"))
        met = pairs.join(one, node).join(two, ["label", "node_"]).filter("node <> node_ or child <= child_")
        pairs = cut(met.select("label", F.least("child", "child_").alias("node"), F.greatest("child", "child_").alias("node_")))
    return points, pairs


def similar_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", *, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of df.

    Rows are linked if their labels and dimensions are equal and the cosine of their vectors,
    in double precision, is at least `cosine`; a component is named by its smallest id, which
    is kept. Null or zero vectors, those with null or non-finite components and rows without
    label link with nothing, nor do rows without id, which are kept without component. Rows
    that share an id are one node, but each counts as a link. Other columns are ignored; an
    empty table gives no rows. Equal vectors of a label are compared once.
    """
    vector = F.col(vector_column).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("string").alias("label"), vector.alias("v"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True))
    good = rows.filter(usable).filter((length > 0) & (length < float("inf")))
    good = good.withColumn("unit", F.transform("v", lambda x: x / length)).select("id", F.concat_ws(":", F.size("v"), "label").alias("label"), "unit")
    good = keep(good.withColumn("key", F.concat(*(F.hex(F.xxhash64(F.lit(half), "unit")) for half in (1, 2)))))  # 128 bits
    classes = keep(good.groupBy("label", "key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit")))

    points, pairs = _node_pairs(classes, math.sqrt(max(0.0, 2 - 2 * cosine)))
    left = points.join(pairs, ["label", "node"]).withColumn("side", F.lit(0))
    right = points.withColumnRenamed("node", "node_").join(pairs.filter("node < node_"), ["label", "node_"]).withColumn("side", F.lit(1))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "rep"], kind="stable")
        split = int((group.side == 0).sum()) if (group.side == 1).any() else 0
        count, label = _links(np.stack(group.unit.to_numpy()), group.copies.to_numpy(np.int64), split, cosine)
        rep = group.rep.to_numpy()
        found = count > 0
        return pd.DataFrame({"rep": rep[found], "links": count[found], "to": rep[label[found]]})

    names = ["label", "node", "node_", "side", "rep", "copies", "unit"]
    found = cut(left.select(names).union(right.select(names)).groupBy("label", "node", "node_").applyInPandas(compare, "rep long, links long, to long"))
    edges = found.select(F.col("rep").alias("a"), F.col("to").alias("b"))
    members = good.join(classes.select("label", "key", "rep"), ["label", "key"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    named = components(edges.union(members))
    by_class = found.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = good.select("id", "label", "key").join(classes.drop("unit"), ["label", "key"]).join(by_class, "rep", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    unlinked = rows.filter(~F.coalesce(usable, F.lit(False)) | ~F.coalesce((length > 0) & (length < float("inf")), F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"))
    out = linked.union(unlinked).join(named, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
