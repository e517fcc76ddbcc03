"""Versioned Parquet tables: upserts by policy, snapshots, ledgers and exports.

Plain Parquet has no MERGE: an upsert joins target and source once and writes a
new version directory; a one-row pointer, written last, makes it visible, so
readers see the old table or the new one and a failed job leaves the old.
"""

from __future__ import annotations

import datetime as dt
import enum
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medialake.functions.text import blank_to_null
from medialake.sources import pointer


class Policy(enum.Enum):
    """What an upsert does with a column of a row that both sides have."""

    REPLACE = "the new value"
    KEEP = "the old value"
    COALESCE = "the new value unless null"
    COALESCE_NONEMPTY = "the new value unless null or empty"
    COALESCE_TRIMMED = "the new value unless blank, else the old unless blank, else null"


def _merged(policy: Policy, new: Column, old: Column) -> Column:
    match policy:
        case Policy.REPLACE:
            return new
        case Policy.KEEP:
            return old
        case Policy.COALESCE:
            return F.coalesce(new, old)
        case Policy.COALESCE_NONEMPTY:
            return F.coalesce(F.nullif(new, F.lit("")), old)
        case Policy.COALESCE_TRIMMED:
            return F.coalesce(blank_to_null(new), blank_to_null(old))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], policies: dict[str, Policy] | None = None, default: Policy = Policy.REPLACE) -> DataFrame:
    """``target`` with the rows of ``source``; columns that the source lacks keep their values. One join on the keys."""
    policies = policies or {}
    rest = [c for c in target.columns if c not in keys]
    new = source.select(*keys, F.lit(True).alias("__s"), *[F.col(c).alias(f"__n_{c}") for c in rest if c in source.columns])
    old = target.select(*keys, F.lit(True).alias("__t"), *[F.col(c).alias(f"__o_{c}") for c in rest])
    out = old.join(new, keys, "full")
    columns = []
    for c in rest:
        before = F.col(f"__o_{c}")
        if c not in source.columns:
            columns.append(before.alias(c))
            continue
        after = F.col(f"__n_{c}")
        both = _merged(policies.get(c, default), after, before)
        columns.append(F.when(F.col("__s").isNull(), before).when(F.col("__t").isNull(), after).otherwise(both).alias(c))
    return out.select(*keys, *columns)


def insert_absent(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """New keys only; of several new rows with one key any one is taken."""
    fresh = source.dropDuplicates([key]).join(target.select(key), key, "left_anti")
    return target.unionByName(fresh.select(target.columns))


def touch(target: DataFrame, seen: DataFrame, key: str, first: str = "first_seen_at", last: str = "last_seen_at") -> DataFrame:
    """First and last sight per key over old state and new sightings ``key, at``."""
    new = seen.groupBy(key).agg(F.min("at").alias(first), F.max("at").alias(last))
    return target.unionByName(new).groupBy(key).agg(F.min(first).alias(first), F.max(last).alias(last))


def replace_partial(target: DataFrame, source: DataFrame, key: str, complete: bool) -> DataFrame:
    """A complete snapshot replaces all rows, another one those of its keys."""
    return source if complete else target.join(source.select(key).distinct(), key, "left_anti").select(target.columns).unionByName(source)


def update_from(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    new = source.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    return target.join(new, keys, "left").withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in columns}).select(target.columns)


def reset_then_set(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str], flags: tuple[str, ...] = ()) -> DataFrame:
    """The columns cleared for all rows, flags to 0, then set where the source has the key."""
    out = target.drop(*columns).join(source.select(*keys, *columns), keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in flags}).select(target.columns)


def blank_to_null_table(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, blank_to_null(column))


def retain(df: DataFrame, ts: str, days: int, now: dt.datetime) -> DataFrame:
    return df.where(F.col(ts) >= F.lit(now - dt.timedelta(days=days)))


def append_version(target: DataFrame, source: DataFrame, key: str, version: str, order: list[str]) -> DataFrame:
    """New rows numbered behind the highest version of their key; several new rows of one key are numbered in order."""
    top = target.groupBy(key).agg(F.max(version).alias("__top"))
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    fresh = source.withColumn("__n", number).join(top, key, "left").withColumn(version, (F.coalesce("__top", F.lit(0)) + F.col("__n")).cast("int"))
    return target.unionByName(fresh.select(target.columns))


def backfill(target: DataFrame, legacy: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns from a legacy table where it has a value; one legacy row per key."""
    return update_from(target, legacy.dropDuplicates(keys), keys, columns)


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows and rows set aside with their message."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def raise_on_errors(bad: DataFrame, ident: str, ignore: bool, shown: int = 20) -> int:
    """After the good rows are written: how many failed; raises, naming the first few, unless told to ignore."""
    n = bad.count()
    if n and not ignore:
        some = [r[0] for r in bad.select(ident).orderBy(ident).limit(shown).collect()]
        raise RuntimeError(f"{n} rows failed, first {some}")
    return n


#: Rows in one JSON document at most.
DOCUMENT_ROWS = 10_000


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON documents, each file one array, in a new folder below ``path`` that one pointer then names.

    ``pointer.resolve(path)`` leads readers to the documents: to the old ones
    until the pointer moves, to the new ones after; a failed run leaves the old
    ones. Those before the last are deleted, so a reader has one write's time to
    finish. No rows give a folder without files.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    slices = [F.spark_partition_id(), F.floor(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) / DOCUMENT_ROWS)]
    documents = df.select(F.struct(*df.columns).alias("row"), *[s.alias(f"slice{k}") for k, s in enumerate(slices)]).groupBy("slice0", "slice1").agg(F.to_json(F.collect_list("row")).alias("value"))
    after, name = pointer.current(spark, root)[0], f"documents-{uuid.uuid4().hex}"
    documents.select("value").write.option("maxRecordsPerFile", 1).text(f"{root}/{name}")
    pointer.drop_before(spark, root, pointer.publish(spark, root, name, after) - 1)


CSV_COLUMNS = ("preaching_date", "title", "preacher_name", "source_system", "metric_key", "entity_id", "detail", "link")


def guarded(c: str) -> Column:
    """A cell that a spreadsheet does not take for a formula."""
    v = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.when(v.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), v)).otherwise(v)


def export_csv(issues: DataFrame, path: str, columns: tuple[str, ...] = CSV_COLUMNS) -> None:
    issues.select(*[guarded(c).alias(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)


def safe_metric_name(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), "[^a-z0-9_-]", "_")


class Table:
    """A table as a directory of versions ``v=<id>`` and a pointer that names the current one."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _pointers(self) -> DataFrame:
        return self.spark.read.schema("at timestamp, version string").parquet(f"{self.path}/_current")

    def current(self) -> str | None:
        """The version of the newest pointer, None for a table never written."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_current")
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return None
        return self._pointers().agg(F.max_by("version", F.struct("at", "version"))).first()[0]

    def read(self) -> DataFrame:
        version = self.current()
        return self.spark.createDataFrame([], self.schema) if version is None else self.spark.read.schema(self.schema).parquet(f"{self.path}/v={version}")

    def stage(self, df: DataFrame) -> str:
        """Write a new version without making it visible."""
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/v={version}")
        return version

    def publish(self, version: str) -> None:
        self.spark.range(1).select(F.current_timestamp().alias("at"), F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{self.path}/_current")

    def replace(self, df: DataFrame) -> None:
        self.publish(self.stage(df))

    def upsert(self, source: DataFrame, keys: list[str], policies: dict[str, Policy] | None = None, default: Policy = Policy.REPLACE) -> None:
        self.replace(upsert(self.read(), source, keys, policies, default))


def replace_snapshot(frames: dict[Table, DataFrame]) -> None:
    """Replace several tables together: all versions are written before the first pointer moves."""
    staged = [(table, table.stage(df)) for table, df in frames.items()]
    for table, version in staged:
        table.publish(version)


LEDGER = "run_id string, job string, source string, status string, at timestamp, error string"


def open_run(spark: SparkSession, path: str, run_id: str, job: str, source: str, now: dt.datetime) -> None:
    _ledger_row(spark, path, run_id, job, source, "running", now, None)


def close_run(spark: SparkSession, path: str, run_id: str, job: str, source: str, status: str, now: dt.datetime, error: str | None = None) -> None:
    _ledger_row(spark, path, run_id, job, source, status, now, (error or "")[:2000] or None)


def _ledger_row(spark, path, *row) -> None:
    spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("append").parquet(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The state of every run: its last row, with when it started."""
    rows = spark.read.schema(LEDGER).parquet(path)
    return rows.groupBy("run_id").agg(F.max_by(F.struct("job", "source", "status", "error"), F.struct("at", F.col("status") != "running")).alias("s"), F.min("at").alias("started_at"), F.max("at").alias("finished_at")).select("run_id", "s.*", "started_at", "finished_at")


def write_snapshot(spark: SparkSession, root: str, run_id: str, metrics: DataFrame, issues: DataFrame, now: dt.datetime) -> None:
    """A quality snapshot: metrics and issues under their run, then the ledger row that makes them count."""
    open_run(spark, f"{root}/runs", run_id, "quality", "", now)
    try:
        issues.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{root}/issues")
        metrics.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{root}/metrics")
    except Exception as e:
        close_run(spark, f"{root}/runs", run_id, "quality", "", "failed", now, str(e))
        raise
    close_run(spark, f"{root}/runs", run_id, "quality", "", "success", now)


