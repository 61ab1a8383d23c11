"""What the operators share: the checkpoint folder, bitmaps of ids, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A bitmap that says which ids a later pass needs has this many bits for each of them, within bounds: 128 MB at most.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 30


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is set."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(named)
        return named
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def text_batches(spark: SparkSession) -> None:
    """For queries over whole texts: hand them to Python in batches of a few MB, which keeps executors' memory low. The
    setting counts when the query runs, after it was returned, so it stays; operators leave the session's as they find it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def fresh(name: str, columns: Iterable[str]) -> str:
    """The name, lengthened until none of the columns has it, in capitals or not."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def keep(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared checkpoint folder and read it back, for tables that several passes read in parts."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.parquet(path)
    kept.kept_at = path
    return kept


def discard(*kept: DataFrame) -> None:
    """Remove tables that `keep` wrote, once all that was made of them is written too."""
    for df in kept:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints of tables that nothing names any more: it does when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def distinct_ids(docs: DataFrame, id_column: str, text_column: str, name: str, nulls_first: bool = True) -> DataFrame:
    """docs with a long `name` that no two rows share, in the order of the ids.

    Where ids are neither null nor repeated they are taken as they are. Otherwise rows are
    sorted by id, a hash of the text and their place in the input, and numbered as they are
    written, so that every later read finds the same numbers. No group of rows meets in one
    task: the place tells apart even rows that are equal.
    """
    own = F.col(id_column).cast("long")
    if docs.groupBy(own.alias("id")).count().filter("count > 1 or id is null").isEmpty():
        return docs.withColumn(name, own)
    first = own.asc_nulls_first() if nulls_first else own.asc_nulls_last()
    placed = docs.withColumn(name, F.monotonically_increasing_id())
    return keep(placed.orderBy(first, F.xxhash64(text_column), name).withColumn(name, F.monotonically_increasing_id()))


def bitmap(ids: DataFrame, column: str, spread: bool = True):
    """A broadcast bitmap that holds every value of a long column, and the mask of its slots (see `slot`).

    It grows with the number of ids to at most `MOST_BITS`. It only spares work: a value
    outside certainly isn't there, one inside has to be joined, however full the bitmap is.
    """
    bits = LEAST_BITS
    wanted = ids.count() * BITS_EACH
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    at = slot(column, bits - 1, spread) + 1  # Spark counts bitmap positions from 1
    rows = ids.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toLocalIterator()
    whole = np.zeros(bits // 8, np.uint8)
    for row in rows:
        part = np.frombuffer(bytes(row.bits), np.uint8)
        whole[(row.bucket - 1) * 4096 :][: len(part)] = part
    return ids.sparkSession.sparkContext.broadcast(whole), bits - 1


def slot(column: str, mask: int, spread: bool = True) -> Column:
    """The bitmap's slot of a value: of its hash, or of the value itself if that is one."""
    return (F.xxhash64(column) if spread else F.col(column)).bitwiseAND(F.lit(mask))


def in_bitmap(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


#: Rows that may be broadcast (a few MB), and rows for which one partition is enough.
FEW, PARTITION = 200_000, 50_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id of an edge, the smallest id that it reaches.

    Each round hangs every id on its smallest neighbour and contracts the edges, so the
    graph shrinks by half at least and by far more where it has hubs. Only counts reach
    the driver; while few edges are left, the rounds' tables are broadcast, else joined.
    Edges may repeat, be loops or have null ends, which link nothing.
    """

    def contracted(df: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
        rows = df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a") < F.col("b")).distinct()
        rows = cut(rows if most is None else rows.coalesce(1 + most // PARTITION))  # few rows in few files
        n = rows.count()
        return rows.coalesce(1 + n // PARTITION), n

    left, n = contracted(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    steps: list[tuple[DataFrame, int]] = []
    while n:
        few = F.broadcast if n <= FEW else lambda df: df
        both = left.select(F.col("b").alias("id"), F.col("a").alias("to")).union(left.select(F.col("a").alias("id"), F.col("b").alias("to")))
        up = cut(both.groupBy("id").agg(F.min("to").alias("to")).filter("to < id").coalesce(1 + n // PARTITION))
        steps.append((up, n))
        for end in ("a", "b"):
            left = left.join(few(up.select(F.col("id").alias(end), "to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        left, n = contracted(left, n)
    if not steps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = steps[-1][0].select("id", F.col("to").alias("component"))
    for i in range(len(steps) - 2, -1, -1):
        up, n = steps[i]
        few = F.broadcast if n <= FEW else lambda df: df
        # an id that was hung on another lives on in later rounds as the place of those hung on it
        moved = up.join(few(labels.select(F.col("id").alias("to"), "component")), "to", "left").select("id", F.coalesce("component", "to").alias("component"))
        labels = cut(moved.union(labels.join(few(up.select("id")), "id", "left_anti")).coalesce(1 + n // PARTITION))
    roots = labels.select(F.col("component").alias("id"), "component").distinct()
    return labels.union(roots)
