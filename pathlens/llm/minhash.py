"""MinHash near-dedup: bottom-k sketches from one hash function.

Inverted lists of retained values generate overlaps, the union's sketch estimates the
similarity and filters, the exact Jaccard similarity of the full sets verifies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bitmap, components, cut, in_bitmap, release, slot
from .words import Words, row_shingles, slices

#: Values that a sketch retains. Two texts at the similarity 0.75 share fewer than 0.375 of
#: the 32 smallest values of their union with odds of about 2e-6; such pairs alone can be missed.
SKETCH, SHARED = 32, 0.375
#: Lists of at most so many documents are compared pair by pair, longer ones by an exact prefix join.
SHORT = 16


def _sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    for row in row_shingles(Words(texts), shingle):
        yield np.unique(row.view(np.int64))


def sketches(docs: DataFrame, id_column: str, text_column: str, shingle: int, size: int) -> DataFrame:
    """(id, n, digest, sketch): size and digest of each document's set, and its smallest values."""

    def run(batches):
        for batch in slices(batches, "text"):
            sets = list(_sets(batch.column(1), shingle))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([s[:size] for s in sets], pa.list_(pa.int64())),
                ],
                ["id", "n", "digest", "sketch"],
            )

    chosen = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return chosen.mapInArrow(run, "id long, n long, digest binary, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """(id, digest, items) for the documents of `wanted` (and a few others that share their bitmap slots)."""
    bits, mask = bitmap(wanted, "id")

    def run(batches):
        for batch in batches:
            keep = in_bitmap(bits.value, batch.column(2).to_numpy())
            for part in slices([batch.filter(pa.array(keep))], "text"):
                sets = list(_sets(part.column(1), shingle))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array(sets, pa.list_(pa.int64())),
                    ],
                    ["id", "digest", "items"],
                )

    chosen = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return chosen.filter("id is not null").withColumn("slot", slot("id", mask)).mapInArrow(run, "id long, digest binary, items array<long>")


def rarest(classes: DataFrame, size: int) -> DataFrame:
    """(value, id, n): the inverted lists, of each document's rarest retained values only.

    A pair that shares at least m of s retained values shares one among the s - m + 1 rarest
    of either, in one order for all documents. So very frequent shingles generate nothing,
    unless most of a document consists of them.
    """
    each = classes.select("id", "n", F.explode("sketch").alias("value"))
    shared = each.groupBy("value").count().filter("count > 1")
    held = F.least("n", F.lit(size))
    own = each.join(shared, "value").groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("count", "value"))).alias("values"))
    prefix = (held - F.ceil(held * SHARED) + 1 - (held - F.size("values"))).cast("int")
    return own.withColumn("prefix", prefix).filter("prefix > 0").select(F.explode(F.slice("values", 1, F.col("prefix"))).alias("v"), "id", "n").select("v.value", "id", "n")


def estimate(a: Column, b: Column, size: int) -> Column:
    """Similarity estimated from the smallest values of the union of two sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def several(rows: DataFrame) -> DataFrame:
    """The rows of lists that hold more than one component, with the list's length and its commonest label."""
    by_label = rows.groupBy("value", "label").count()
    lists = by_label.groupBy("value").agg(F.sum("count").alias("length"), F.max_by("label", F.struct("count", "label")).alias("common"), F.count("*").alias("labels"))
    return rows.join(lists.filter("labels > 1").drop("labels"), "value")


class _Linker:
    """Candidate pairs and their verification for one table of classes (id, n, digest, sketch)."""

    def __init__(self, docs, classes, id_column, text_column, shingle, numerator, denominator, size):
        self.classes, self.numerator, self.denominator, self.size = classes, numerator, denominator, size
        self.sets = lambda wanted: full_sets(docs, wanted, id_column, text_column, shingle)

    def sizes_agree(self, a: str, b: str) -> Column:
        return F.least(a, b) * self.denominator >= F.greatest(a, b) * self.numerator

    def likely(self, pairs: DataFrame) -> DataFrame:
        """(a, ad, b, bd): pairs of ids with the classes' digests, if the union's sketch doesn't speak against them."""
        a, b = (self.classes.select(F.col("id").alias(x), F.col("digest").alias(f"{x}d"), F.col("sketch").alias(f"{x}s")) for x in "ab")
        return pairs.join(a, "a").join(b, "b").filter(estimate(F.col("as"), F.col("bs"), self.size) >= SHARED).select("a", "ad", "b", "bd")

    def verified(self, pairs: DataFrame) -> DataFrame | None:
        """(a, b) of the pairs whose full sets are similar enough."""
        pairs = cut(pairs)
        if pairs.isEmpty():
            return None
        items = self.sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
        left, right = (items.select(F.col("id").alias(x), F.col("digest").alias(f"{x}d"), F.col("items").alias(f"{x}i")) for x in "ab")
        both = F.size(F.array_intersect("ai", "bi"))
        either = F.size("ai") + F.size("bi") - both
        found = pairs.join(right, ["b", "bd"]).join(left, ["a", "ad"])
        return found.filter(both * self.denominator >= either * self.numerator).select("a", "b")

    def from_leaders(self, lists: DataFrame) -> DataFrame:
        """Each list's smallest id with all its others: a comparison a row, however long the list."""
        least = lists.groupBy("value").agg(F.min(F.struct("id", "n")).alias("l")).select("value", F.col("l.id").alias("a"), F.col("l.n").alias("an"))
        pairs = lists.join(least, "value").filter(F.col("a") < F.col("id")).filter(self.sizes_agree("an", "n"))
        return self.likely(pairs.select("a", F.col("id").alias("b")).distinct())

    def within_short(self, open_lists: DataFrame) -> DataFrame:
        """All pairs of different components in lists of at most SHORT documents."""
        rows = open_lists.filter(F.col("length") <= SHORT).select("value", "id", "n", "label")
        other = rows.select("value", F.col("id").alias("a"), F.col("n").alias("an"), F.col("label").alias("al"))
        pairs = rows.join(other, "value").filter((F.col("a") < F.col("id")) & (F.col("al") != F.col("label"))).filter(self.sizes_agree("an", "n"))
        return self.likely(pairs.select("a", F.col("id").alias("b")).distinct())

    def by_prefix(self, ids: DataFrame, labels: DataFrame) -> DataFrame:
        """All pairs of different components among the given documents that can be similar enough: an exact prefix join.

        Items are ordered from rare to frequent among these documents. A similar pair's first
        common item is among the first n - overlap + 1 of either, and no more items than those
        from there on can be common. So what only one of them has speaks against a document
        before any comparison, and a large group of loosely similar texts falls apart.
        """
        chosen = self.classes.join(ids, "id", "left_semi").select("id", "digest")
        items = self.sets(chosen).join(chosen, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
        each = items.select("id", "digest", F.size("items").alias("n"), F.explode("items").alias("value"))
        shared = each.groupBy("value").count().filter("count > 1")
        own = each.join(shared, "value").groupBy("id", "digest", "n").agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("values"))
        alone = F.col("n") - F.size("values")
        prefix = F.col("n") - F.ceil(F.col("n") * self.numerator / self.denominator) + 1 - alone
        own = own.withColumn("alone", alone).withColumn("prefix", prefix.cast("int")).filter("prefix > 0")
        rows = own.select("id", "digest", "n", "alone", F.posexplode(F.slice("values", 1, F.col("prefix"))).alias("place", "v"))
        rows = rows.select("id", "digest", "n", (F.col("n") - F.col("alone") - F.col("place")).alias("rest"), "v.value").join(labels, "id", "left")
        rows = cut(several(rows.withColumn("label", F.coalesce("component", "id")).drop("component")))
        other = rows.filter("label <> common").select("value", *(F.col(c).alias(f"{c}_") for c in ("id", "digest", "n", "rest", "label", "common")))
        once = (F.col("label") == F.col("common_")) | (F.col("id_") < F.col("id"))
        enough = (F.col("n") + F.col("n_")) * self.numerator <= F.least("rest", "rest_") * (self.numerator + self.denominator)
        pairs = rows.join(other, "value").filter((F.col("label") != F.col("label_")) & once & enough).filter(self.sizes_agree("n", "n_"))
        return pairs.select(F.col("id").alias("a"), F.col("digest").alias("ad"), F.col("id_").alias("b"), F.col("digest_").alias("bd")).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, shingle: int = 5, numerator: int = 75, denominator: int = 100, size: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of `docs`.

    Documents are linked when denominator * |A and B| >= numerator * |A or B| over their sets
    of distinct word shingles; a component is named by its smallest id, which is kept.
    Equal sets are one class from the start. Then each inverted list's first document is
    compared with the others of the list, which joins most groups at a comparison a member.
    What stays apart in a list is compared further: short lists pair by pair, the documents
    of long ones by an exact prefix join over their full sets. So a large group costs about
    a comparison a member, and no link between different components is lost.

    Null, empty or blank texts: n_shingles 0, linked with nothing. Null ids: linked with
    nothing, component_id null, kept. Rows that share an id are one node. Other columns of
    `docs` are neither used nor returned. An empty table gives no rows.
    """
    drawn = cut(sketches(docs, id_column, text_column, shingle, size))
    filled = drawn.filter("n > 0 and id is not null")
    classes = cut(filled.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    members = filled.join(classes.select("digest", F.col("id").alias("b")), "digest").select(F.col("id").alias("a"), "b").filter("a <> b")

    linker = _Linker(docs, classes, id_column, text_column, shingle, numerator, denominator, size)
    lists = cut(rarest(classes, size))
    links, labels = classes.limit(0).select(F.col("id").alias("a"), F.col("id").alias("b")), None

    def add(found: DataFrame | None) -> None:
        nonlocal links, labels
        if found is not None or labels is None:
            links = links if found is None else cut(links.union(found))
            labels = components(links)
            release(docs.sparkSession)

    add(linker.verified(linker.from_leaders(lists)))
    named = lists.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    open_lists = cut(several(named))
    add(linker.verified(linker.within_short(open_lists)))
    loose = cut(open_lists.filter(F.col("length") > SHORT).select("id").distinct())
    if not loose.isEmpty():
        add(linker.verified(linker.by_prefix(loose, labels)))

    if filled.groupBy("id").count().filter("count > 1").isEmpty():  # each document is in one class
        named = members.join(labels.withColumnRenamed("id", "b"), "b", "left").select(F.col("a").alias("id"), F.coalesce("component", "b").alias("component")).union(labels)
    else:
        named = components(members.union(links))
    out = drawn.select("id", "n").join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
