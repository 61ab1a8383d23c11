"""How far the sources of a language differ in their use of terms, with exact arithmetic.

What is counted and shuffled are 64-bit digests of terms; texts of terms come late. Once it is
known which digests are kept, a second pass over the documents gathers the smallest and the
largest string of each of these. Where the two differ, strings have collided: their digest is
counted anew, split by string. The text is then joined back to the rows that are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import FEW, bitmap, cut, in_bitmap, keep
from .words import MASKS, U, Words, slices

#: Terms are runs of ASCII letters and of all characters beyond ASCII.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[65:91] = TERM_BYTES[97:123] = TERM_BYTES[128:] = True
#: A task gives its counts away when it has so many, and strings (some 65 MB) likewise.
COUNTS, STRINGS = 1 << 19, 1 << 18
#: Counts of a block of terms, whose shares are compared in one task; sources that a task compares with all others; numbers that lie in memory for it.
BLOCK, TILE, DENSE = 100_000, 256, 1 << 20
SHARE = 1_000_000_000


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether spans of equal length that begin at a and at b hold the same bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    same, left, at = np.ones(len(a), bool), np.flatnonzero(a != b), 0
    while len(left):
        rest = lengths[left] - at
        differ = eight[a[left] + at] ^ eight[b[left] + at]
        differ[rest < 8] &= MASKS[rest[rest < 8]]
        same[left[differ != 0]] = False
        left, at = left[(differ == 0) & (rest > 8)], at + 8
    return same


def _digests(words: Words, bits: int) -> np.ndarray:
    return words.names >> U(64 - bits)


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new combination begins in arrays that are sorted together."""
    fresh = np.ones(len(sorted_keys[0]), bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(fresh)


def _counted(group: np.ndarray, digest: np.ndarray, n: np.ndarray, docs: np.ndarray):
    """Sums by group and digest."""
    if not len(group):
        return group, digest, n, docs
    order = np.lexsort((digest, group))
    group, digest = group[order], digest[order]
    at = _runs(group, digest)
    return group[at], digest[at], np.add.reduceat(n[order], at), np.add.reduceat(docs[order], at)


def _count(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, digest, n, docs): a task's counts, summed before they are shuffled."""
    numbers: dict[tuple[str, str], int] = {}
    have, size = [], 0

    def given() -> Iterator[pa.RecordBatch]:
        group, digest, n, docs = _counted(*(np.concatenate(x) for x in zip(*have, strict=True)))
        lang, source = (pa.array([k[i] for k in numbers], pa.string()) for i in (0, 1))
        for at in range(0, len(group), 1 << 16):
            to = slice(at, at + (1 << 16))
            place = pa.array(group[to])
            yield pa.RecordBatch.from_arrays([lang.take(place), source.take(place), pa.array(digest[to].view(np.int64)), pa.array(n[to]), pa.array(docs[to])], ["lang", "source", "digest", "n", "docs"])

    for batch in slices(batches, "text"):
        keys = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
        groups = np.array([numbers.setdefault(k, len(numbers)) for k in keys], np.int64)
        words = Words(batch.column("text"), TERM_BYTES)
        if not len(words.names):
            continue
        row, digest = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets)), _digests(words, bits)
        order = np.lexsort((digest, row))
        row, digest = row[order], digest[order]
        at = _runs(row, digest)  # a document's terms
        have.append(_counted(groups[row[at]], digest[at], np.diff(np.append(at, len(row))), np.ones(len(at), np.int64)))
        size += len(have[-1][0])
        if size > 2 * COUNTS:
            have = [_counted(*(np.concatenate(x) for x in zip(*have, strict=True)))]
            size = len(have[0][0])
            if size > COUNTS:
                yield from given()
                have, size = [], 0
    if have:
        yield from given()


def _extremes(batches: Iterator[pa.RecordBatch], bits: int, wanted, mask: int) -> Iterator[pa.RecordBatch]:
    """(digest, low, high): smallest and largest string of each wanted digest; all occurrences are compared."""
    known: dict[int, tuple[bytes, bytes]] = {}

    def given() -> pa.RecordBatch:
        low, high = (pa.array([pair[i].decode() for pair in known.values()], pa.string()) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.array(list(known), np.uint64).view(np.int64)), low, high], ["digest", "low", "high"])

    for batch in slices(batches, "text"):
        words = Words(batch.column("text"), TERM_BYTES)
        digest = _digests(words, bits)
        place = np.flatnonzero(in_bitmap(wanted.value, (digest & U(mask)).astype(np.int64)))
        if not len(place):
            continue
        place = place[np.argsort(digest[place], kind="stable")]
        at = _runs(digest[place])
        first = np.repeat(place[at], np.diff(np.append(at, len(place))))
        same = words.lengths[place] == words.lengths[first]
        same[same] = _same(words.data, words.starts[place[same]], words.starts[first[same]], words.lengths[place[same]])
        for i in [*place[at].tolist(), *place[~same].tolist()]:
            key, word = int(digest[i]), words.word(i)
            pair = known.get(key)
            if pair is None:
                known[key] = word, word
            elif word < pair[0] or word > pair[1]:
                known[key] = min(word, pair[0]), max(word, pair[1])
        if len(known) > STRINGS:
            yield given()
            known = {}
    if known:
        yield given()


def _split(batches: Iterator[pa.RecordBatch], bits: int, wanted, mask: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, digest, term, n, docs) of the terms of collided digests, by batch: the strings tell them apart."""
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"), TERM_BYTES)
        digest = _digests(words, bits)
        place = np.flatnonzero(in_bitmap(wanted.value, (digest & U(mask)).astype(np.int64)))
        row = (np.searchsorted(words.offsets, place, "right") - 1).tolist()
        keys = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
        found: dict[tuple, list[int]] = {}
        for i, r in zip(place.tolist(), row, strict=True):
            entry = found.setdefault((*keys[r], int(digest[i].astype(np.int64)), words.word(i).decode()), [0, 0, -1])
            entry[0] += 1
            entry[1] += entry[2] != r
            entry[2] = r
        if found:
            lang, source, number, term = zip(*found, strict=True)
            n, docs, _ = zip(*found.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(source), pa.array(number, pa.int64()), pa.array(term), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "digest", "term", "n", "docs"])


def _share(n: Column, total: Column, v: Column) -> Column:
    """p of a count, total and number of terms; decimals only where 64 bits would overflow."""
    below = total + 5 * v
    wide = F.call_function("div", (n + 5).cast("decimal(20,0)") * F.lit(SHARE).cast("decimal(10,0)"), below.cast("decimal(20,0)"))
    return 1 + F.when(n < 9_000_000_000, F.call_function("div", (n + 5) * F.lit(SHARE).cast("long"), below)).otherwise(wide)


def _distances(tile: int, dense: int):
    """For one block of a language's terms: of each pair of sources (the lower number in this tile) the shares' differences, summed."""

    def run(group: pa.Table) -> pa.Table:
        base = group.filter(group.column("base"))
        least = base.column("p").combine_chunks().values.to_numpy()
        terms = group.filter(pc.invert(group.column("base"))).combine_chunks()
        s, low = len(least), group.column("tile")[0].as_py() * tile
        high = min(s, low + tile)
        sums = np.zeros((high - low, s), np.int64)
        step = max(1, dense // s)
        for at in range(0, terms.num_rows, step):
            part = terms.slice(at, step)
            place, share = (part.column(c).combine_chunks() for c in ("i", "p"))
            shares = np.tile(least, (part.num_rows, 1))
            shares[np.repeat(np.arange(part.num_rows), place.value_lengths().to_numpy()), place.flatten().to_numpy()] = share.flatten().to_numpy()
            for i in range(low, high):
                sums[i - low, i + 1 :] += np.abs(shares[:, i + 1 :] - shares[:, i : i + 1]).sum(0)
        i, j = np.triu_indices(s, 1)
        here = (i >= low) & (i < high)
        i, j = i[here], j[here]
        return pa.table({"lang": pa.array([group.column("lang")[0].as_py()] * len(i), pa.string()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "value": pa.array(sums[i - low, j])})

    return run


def source_divergence(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", *, least_docs: int = 30, top: int = 50, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): how the sources of each language differ.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language
    keeps those of at least `least_docs` of its documents. A term's share p in a source is
    1 + floor(10^9 (n + 5) / (N + 5 V)), with n its count, N the count of all kept terms there
    and V their number; q is the same over the language. Part `pair`: every other source of the
    language, by the absolute differences of p summed over all kept terms. Part `term`: the
    `top` terms by p - q among those that occur and whose difference is above 0. Rank counts
    from 1, larger values first, equal ones by item in order of UTF-8 bytes.

    Null texts, languages and sources are empty strings, which are a language or source like
    others. Every row is a document, also where ids or whole rows repeat. A source without kept
    terms has its pairs, a language without kept terms pairs of value 0. A language with one
    source has no pair; an empty table gives no rows. Other columns are ignored. `bits` of a
    digest count; with few of them digests collide, which changes nothing in the result.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_column, "lang"), (source_column, "source"), (text_column, "text"))))
    groups = cut(rows.select("lang", "source").distinct())
    groups = cut(groups.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    few = F.broadcast if groups.count() <= FEW else lambda df: df

    def terms_of(counts: DataFrame, *key: str) -> DataFrame:
        """A row a term: its sources' numbers and counts, of terms in enough documents."""
        cells = counts.groupBy("lang", *key, "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).join(few(groups), ["lang", "source"])
        return cells.groupBy("lang", *key).agg(F.collect_list(F.struct("i", "n")).alias("cells"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)

    counts = rows.mapInArrow(lambda batches: _count(batches, bits), "lang string, source string, digest long, n long, docs long")
    terms = keep(terms_of(counts, "digest").select("lang", "digest", F.lit(None).cast("string").alias("term"), "cells"))
    wanted, mask = bitmap(terms.select("digest").distinct(), "digest", spread=False)
    strings = rows.select("text").mapInArrow(lambda batches: _extremes(batches, bits, wanted, mask), "digest long, low string, high string")
    strings = keep(strings.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    collided = cut(terms.select("digest").distinct().join(strings.filter("low <> high").select("digest"), "digest"))
    if not collided.isEmpty():
        split, split_mask = bitmap(collided, "digest", spread=False)
        again = rows.mapInArrow(lambda batches: _split(batches, bits, split, split_mask), "lang string, source string, digest long, term string, n long, docs long")
        apart = terms_of(again, "digest", "term").join(collided, "digest").select("lang", "digest", "term", "cells")
        terms = keep(terms.join(collided, "digest", "left_anti").select("lang", "digest", "term", "cells").union(apart))

    cells = terms.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.i").agg(F.sum("c.n").alias("n_kept"))
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.size("cells")).alias("n_cells"))
    stats = groups.join(cells, ["lang", "i"], "left").join(of_lang, "lang", "left")
    stats = cut(stats.select("lang", "source", "i", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_kept", "v", "n_cells"))))
    langs = stats.groupBy("lang").agg(F.max("v").alias("v"), F.max("n_cells").alias("n_cells"), F.sum("n_kept").alias("n_lang"), F.transform(F.array_sort(F.collect_list(F.struct("i", "n_kept"))), lambda c: c.n_kept).alias("totals"))
    langs = cut(langs)

    # pairs of sources, block of terms by block
    blocks = 1 + F.floor(F.col("n_cells") / BLOCK)
    tiles = F.explode(F.sequence(F.lit(0), F.floor((F.size("totals") - 1) / TILE).cast("int"))).alias("tile")
    located = terms.join(few(langs), "lang").select("lang", F.pmod(F.xxhash64("digest", "term"), blocks).alias("block"), tiles, F.lit(False).alias("base"), F.col("cells.i").alias("i"), F.transform("cells", lambda c: _share(c.n, F.get("totals", c.i), F.col("v"))).alias("p"))
    least = F.transform("totals", lambda n: F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), n, F.greatest("v", F.lit(1)))).otherwise(0).cast("long"))
    base = langs.filter(F.size("totals") > 1).select("lang", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "totals", least.alias("p")).select("lang", "block", tiles, F.lit(True).alias("base"), F.lit(None).cast("array<int>").alias("i"), "p")
    located = located.join(few(langs.filter(F.size("totals") > 1).select("lang")), "lang")
    sums = located.unionByName(base).groupBy("lang", "block", "tile").applyInArrow(_distances(TILE, DENSE), "lang string, i int, j int, value long")
    sums = sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = sums.union(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    own, other = groups.select("lang", "i", "source"), groups.select("lang", F.col("i").alias("j"), F.col("source").alias("item"))
    pairs = both.join(few(own), ["lang", "i"]).join(few(other), ["lang", "j"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    # terms that a source uses more than its language: their text is joined once the largest values are known
    shares = terms.select("lang", "digest", "term", F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c.n).alias("n_all"), F.explode("cells").alias("c"))
    shares = shares.select("lang", "digest", "term", "n_all", "c.i", "c.n").join(few(stats.drop("n_cells")), ["lang", "i"]).join(few(langs.select("lang", "n_lang")), "lang")
    shares = shares.withColumn("value", _share(F.col("n"), F.col("n_kept"), F.col("v")) - _share(F.col("n_all"), F.col("n_lang"), F.col("v"))).filter("value > 0")
    shares = shares.select("lang", "source", "digest", "term", "value")
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    largest = shares.groupBy("lang", "source", "value").count().withColumn("k", F.row_number().over(falling)).filter(F.col("k") <= top)
    running = F.sum("count").over(falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")
    bounds = largest.withColumn("before", running).filter(F.col("before") < top).groupBy("lang", "source").agg(F.min("value").alias("bound"))
    kept = shares.join(few(cut(bounds)), ["lang", "source"]).filter("value >= bound").join(strings.select("digest", "low"), "digest")
    kept = kept.select("lang", "source", F.lit("term").alias("part"), F.coalesce("term", "low").alias("item"), "value")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    kept = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(kept)
