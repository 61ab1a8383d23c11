"""Reads with checks, idempotent writes, run manifests and content signatures."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WRITING, COMPLETED, FAILED = "EM_GRAVACAO", "CONCLUIDA", "FALHOU"
MANIFEST = "run_id string, mode string, model string, status string, cut timestamp, ended_at timestamp, config string, metrics string, rows long"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir; a temporary one only on a local master."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    have = context._jsc.sc().getCheckpointDir()
    if named is None and have.isDefined():
        return have.get()
    if named is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = named or tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not have.isDefined():
        context.setCheckpointDir(named)
    return named


def require_columns(df: DataFrame, names: Iterable[str], source: str = "input") -> DataFrame:
    """Df, if it has the columns."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{source}: missing columns {missing}")
    return df


def require_types(df: DataFrame, types: Mapping[str, T.DataType]) -> DataFrame:
    """Df, if its columns have exactly these types."""
    wrong = {c: df.schema[c].dataType.simpleString() for c, t in types.items() if df.schema[c].dataType != t}
    if wrong:
        raise TypeError(f"wrong types: {wrong}")
    return df


def read_table(spark: SparkSession, path: str, columns: Iterable[str] = ()) -> DataFrame:
    """A Parquet table with its required columns."""
    return require_columns(spark.read.parquet(path), columns, path)


def as_events(df: DataFrame, entity: str, ts: str, state: str | Column, depth: str | Column | None = None) -> DataFrame:
    """DM1: any table as events (entity string, ts timestamp, state string, depth double)."""
    state = F.col(state) if isinstance(state, str) else state
    depth = F.lit(None) if depth is None else F.col(depth) if isinstance(depth, str) else depth
    return df.select(F.col(entity).cast("string").alias("entity"), F.col(ts).cast("timestamp").alias("ts"), state.cast("string").alias("state"), depth.cast("double").alias("depth"))


def read_events(events: DataFrame, start: str | None, cut: str, inclusive: bool = False) -> DataFrame:
    """Events from `start` on and before `cut` (or up to it); null times stay, to be counted by the gates."""
    require_types(events, {"ts": T.TimestampType()})
    ts, end = F.col("ts"), F.lit(cut).cast("timestamp")
    inside = (ts <= end if inclusive else ts < end) & (F.lit(True) if start is None else ts >= F.lit(start).cast("timestamp"))
    return events.filter(inside | ts.isNull())


def query_source(spark: SparkSession, source: str, query: str, **options: str) -> DataFrame:
    """A query that the source itself runs (JDBC, warehouse connectors)."""
    return spark.read.format(source).option("query", query).options(**options).load()


def parameterised(spark: SparkSession, sql: str, features: Iterable[str] | None = None, **args) -> DataFrame:
    """SQL with named parameters, and the check that it gives exactly the expected features."""
    df = spark.sql(sql, args=args)
    if features is not None and (odd := set(df.columns) ^ set(features)):
        raise ValueError(f"features differ: {sorted(odd)}")
    return df


def dimension(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table written out in the program."""
    return spark.createDataFrame(rows, ddl)


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row for each day, both ends included."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return spark.range(1).select(F.explode(days).alias("day"))


def share_view(df: DataFrame, name: str, everywhere: bool = False) -> None:
    """A10: hand a table to later SQL of this session, or of all sessions."""
    (df.createOrReplaceGlobalTempView if everywhere else df.createOrReplaceTempView)(name)


def signature(df: DataFrame) -> DataFrame:
    """Rows and four decimal sums of their hashes' parts: equal for equal rows in any order."""
    columns = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"sum_{i}") for i in range(4)]
    return df.agg(F.count("*").alias("rows"), *parts)


def same_source(before: DataFrame, after: DataFrame) -> None:
    """Stop if a source's signature changed during the job."""
    if before.first() != after.first():
        raise RuntimeError("the source changed during the job")


def single_run(df: DataFrame, run_id: str | None = None, column: str = "run_id") -> DataFrame:
    """The rows of the one run that there is, or of the named one."""
    if run_id is not None:
        df = df.filter(F.col(column) == run_id)
    found = df.select(column).distinct().limit(2).collect()
    if len(found) != 1 or found[0][0] is None:
        raise ValueError(f"expected one {column}, found {len(found)}")
    return df


def overwrite_slice(df: DataFrame, path: str, keys: Mapping[str, object]) -> None:
    """Replace only the partition of the given key values; refuses empty input, other rows and another schema."""
    spark = df.sparkSession
    outside = ~F.lit(True)
    for name, value in keys.items():
        outside = outside | ~F.col(name).eqNullSafe(F.lit(value))
    counts = df.agg(F.count("*").alias("rows"), F.count_if(outside).alias("outside")).first()
    if not counts.rows or counts.outside:
        raise ValueError(f"{counts.rows} rows, {counts.outside} of them outside the slice")
    if exists(spark, path):
        have = {f.name: f.dataType for f in spark.read.parquet(path).schema if f.name not in keys}
        if have != {f.name: f.dataType for f in df.schema if f.name not in keys}:
            raise ValueError("the schema differs from the table's")
    df.write.partitionBy(*keys).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has the path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def append_run(df: DataFrame, path: str, run_id: str) -> DataFrame:
    """Append the rows of a run that isn't there yet; returns the run as written."""
    spark = df.sparkSession
    if exists(spark, path) and not spark.read.parquet(path).filter(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"run {run_id} is there already")
    df.withColumn("run_id", F.lit(run_id)).write.partitionBy("run_id").mode("append").parquet(path)
    return read_run(spark, path, run_id)


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """A run's rows, pinned by its id; only its partition is read."""
    return spark.read.option("basePath", path).parquet(path).filter(F.col("run_id") == run_id)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a versioned table's manifests, in order."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    return sorted(int(name) for f in files.listStatus(folder) if (name := f.getPath().getName()).isdigit())


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A fixed version of a versioned table, or the newest; see `publish_slice`.

    A version is a list of data folders that nobody changes, so what is read stays the same
    while newer versions are published.
    """
    known = _versions(spark, path)
    chosen = known[-1] if version is None and known else version
    if chosen not in known:
        raise ValueError(f"no version {version} of {path}")
    slices = spark.read.schema(SLICES).parquet(f"{path}/versions/{chosen:08d}").collect()  # a row a slice
    return spark.read.parquet(*(f"{path}/data/{row.folder}" for row in sorted(slices, key=lambda row: row.keys)))


SLICES = "keys string, folder string"


def publish_slice(df: DataFrame, path: str, keys: Mapping[str, object], attempts: int = 10) -> int:
    """Put a slice in the place of the one with the same key values; returns the number of the version that has it.

    The rows go to a new folder; then a manifest, the last version's with this slice's folder
    exchanged, is written aside and renamed to the next number. So a reader sees the whole old
    slice or the whole new one; a write that fails before the rename changes nothing; and of two
    writers at once the second, which finds the number taken, goes on from the first's version.
    Refuses empty input, rows of other slices and another schema.
    """
    spark = df.sparkSession
    outside = reduce(lambda c, item: c | ~F.col(item[0]).eqNullSafe(F.lit(item[1])), keys.items(), F.lit(False))
    folder = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{folder}")
    written = spark.read.parquet(f"{path}/data/{folder}")
    counts = written.agg(F.count("*").alias("rows"), F.count_if(outside).alias("outside")).first()
    if not counts.rows or counts.outside:
        raise ValueError(f"{counts.rows} rows, {counts.outside} of them outside the slice")
    own = json.dumps({k: str(v) for k, v in keys.items()}, sort_keys=True)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for _ in range(attempts):
        known = _versions(spark, path)
        slices = [tuple(row) for row in spark.read.schema(SLICES).parquet(f"{path}/versions/{known[-1]:08d}").collect() if row.keys != own] if known else []
        if slices and {f.name: f.dataType for f in spark.read.parquet(f"{path}/data/{slices[0][1]}").schema} != {f.name: f.dataType for f in written.schema}:
            raise ValueError("the schema differs from the table's")
        version = known[-1] + 1 if known else 1
        aside = hadoop.Path(f"{path}/aside/{uuid.uuid4().hex}")
        spark.createDataFrame([*slices, (own, folder)], SLICES).coalesce(1).write.parquet(aside.toString())
        place = hadoop.Path(f"{path}/versions/{version:08d}")
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(place.getParent())
        if not files.exists(place) and files.rename(aside, place):
            lost = hadoop.Path(place, aside.getName())  # where the other writer's manifest came between, ours went below it
            if not files.exists(lost):
                return version
            files.delete(lost, True)
    raise RuntimeError(f"{attempts} other writers came first")


def create_only(df: DataFrame, path: str) -> None:
    """Write a table that must not exist."""
    df.write.mode("errorifexists").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a whole table, whatever its schema was."""
    df.write.mode("overwrite").parquet(path)


def with_provenance(df: DataFrame, **values) -> DataFrame:
    """Constant columns that say where the rows come from."""
    return df.select("*", *(F.lit(v).alias(k) for k, v in values.items()))


def manifest(spark: SparkSession, run_id: str, mode: str, model: str, status: str, cut, ended_at, config: Mapping, metrics: Mapping, rows: int | None) -> DataFrame:
    """A14, DM14: a run's one-row manifest, configuration and metrics as JSON."""
    values = (run_id, mode, model, status, cut, ended_at, json.dumps(dict(config), sort_keys=True), json.dumps(dict(metrics), sort_keys=True), rows)
    return spark.createDataFrame([values], MANIFEST)


def write_run(df: DataFrame, data_path: str, manifest_path: str, run_id: str, mode: str, model: str, cut, now, config: Mapping) -> DataFrame:
    """A manifest of the beginning, the rows, their count read back, and the manifest of the end or of the failure."""
    spark = df.sparkSession
    note = lambda status, metrics, rows: manifest(spark, run_id, mode, model, status, cut, now, config, metrics, rows).write.mode("append").parquet(manifest_path)
    note(WRITING, {}, None)
    try:
        written = append_run(df, data_path, run_id)
        rows, expected = written.count(), df.count()
        if rows != expected:
            raise RuntimeError(f"{rows} rows written of {expected}")
    except Exception as error:
        note(FAILED, {"error": str(error)[:500]}, None)
        raise
    note(COMPLETED, {"rows": rows}, rows)
    return written


def completed_only(df: DataFrame, manifests: DataFrame, keys: Iterable[str] = ("run_id",)) -> DataFrame:
    """Rows of completed runs."""
    done = manifests.filter(F.col("status") == COMPLETED).select(*keys).distinct()
    return df.join(done, list(keys), "left_semi")


def latest_run(manifests: DataFrame, by: Iterable[str] = ("mode", "model")) -> DataFrame:
    """Of each mode and model the newest completed run: by cut, then end, then id."""
    newest = Window.partitionBy(*by).orderBy(F.desc("cut"), F.desc("ended_at"), F.desc("run_id"))
    return manifests.filter(F.col("status") == COMPLETED).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def choose_run(manifests: DataFrame, model: str, preferred: str | None = None) -> DataFrame:
    """The preferred run if it is completed, else the one that ended last of the same model; doubles are refused."""
    done = manifests.filter((F.col("status") == COMPLETED) & (F.col("model") == model))
    if not done.groupBy("run_id").count().filter("count > 1").isEmpty():
        raise ValueError("a run is listed twice as completed")
    rank = F.struct((F.col("run_id") == F.lit(preferred)).cast("int"), "ended_at", "run_id") if preferred else F.struct("ended_at", "run_id")
    return done.agg(F.max_by(F.struct(*done.columns), rank).alias("m")).select("m.*").filter("run_id is not null")


def write_package(tables: Mapping[str, DataFrame], path: str, package: str) -> DataFrame:
    """Copy several tables under one package id, compare each with its source, store schema and signature."""
    notes = None
    for name, df in tables.items():
        create_only(df, f"{path}/{package}/{name}")
        copy = df.sparkSession.read.parquet(f"{path}/{package}/{name}")
        if not copy.exceptAll(df).isEmpty() or not df.exceptAll(copy).isEmpty():
            raise RuntimeError(f"{name} differs from its copy")
        note = signature(copy).select(F.lit(name).alias("name"), F.lit(copy.schema.json()).alias("schema"), "*")
        notes = note if notes is None else notes.unionByName(note)
    create_only(notes.coalesce(1), f"{path}/{package}/_package")
    return notes.sparkSession.read.parquet(f"{path}/{package}/_package")


def read_package(spark: SparkSession, path: str, package: str) -> dict[str, DataFrame]:
    """The tables of a package whose schema and signature are still those noted."""
    out = {}
    for note in spark.read.parquet(f"{path}/{package}/_package").collect():
        df = spark.read.parquet(f"{path}/{package}/{note.name}")
        now = signature(df).first()
        if df.schema.json() != note.schema or any(now[c] != note[c] for c in now.asDict()):
            raise RuntimeError(f"{note.name} was changed")
        out[note.name] = df
    return out


def report_rows(reports: Mapping[str, DataFrame]) -> DataFrame:
    """Reports of any shape as (report, row as JSON)."""
    out = None
    for name, df in reports.items():
        rows = df.select(F.lit(name).alias("report"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def export_csv(df: DataFrame, path: str, limit: int) -> None:
    """A report of at most `limit` rows as one CSV file."""
    df.limit(limit).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def parameter_hash(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and the sha2 of all other columns' JSON."""
    rest = [c for c in sorted(df.columns) if c not in keys]
    return df.select(*keys, F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256).alias("parameter_hash"))


def changed_parameters(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one has, or whose hashes differ, with what happened; empty if nothing changed."""
    a, b = parameter_hash(old, keys).withColumnRenamed("parameter_hash", "old_hash"), parameter_hash(new, keys).withColumnRenamed("parameter_hash", "new_hash")
    both = a.join(b, keys, "full")
    what = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").otherwise("changed")
    return both.filter(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select(*keys, what.alias("change"))


def require_unchanged(old: DataFrame, new: DataFrame, keys: list[str], refitted: DataFrame) -> None:
    """Stop if any row but those refitted differs."""
    if not changed_parameters(old, new, keys).join(refitted, keys, "left_anti").isEmpty():
        raise RuntimeError("rows that weren't refitted differ")
