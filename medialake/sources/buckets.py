"""A keyed table in hash buckets that is written copy on write: a change rewrites the buckets it touches and no other.

The files are those of Spark's bucketed tables. A version is a manifest, a small
Parquet table that names its files with their bucket, their number of rows and
the range of every column; a pointer names the current manifest. A join with the
table on its keys exchanges the other side only, and a scan opens the files
whose ranges can hold what is looked for.
"""

from __future__ import annotations

import functools
import operator
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialake.sources import pointer
from medialake.sources.tables import Policy, reset_then_set, update_from, upsert

#: Letters of a text that a file's range keeps.
RANGE_LETTERS = 32
_LAST = chr(0x10FFFF)
_ORDERED = (T.StringType, T.NumericType, T.DateType, T.TimestampType, T.BooleanType)
_COMPARE = {"=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


class BucketTable:
    """Rows with unique ``keys``, in ``buckets`` hash buckets below ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = T._parse_datatype_string(schema)
        self.ranged = [f for f in self.schema.fields if isinstance(f.dataType, _ORDERED)]
        ranges = [T.StructField(f.name, T.StructType([T.StructField("low", f.dataType), T.StructField("high", f.dataType), T.StructField("nulls", T.LongType())])) for f in self.ranged]
        self.manifest = T.StructType([T.StructField("file", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n_rows", T.LongType()), T.StructField("ranges", T.StructType(ranges))])

    # versions

    def version(self) -> int:
        return pointer.current(self.spark, self.path)[0]

    def files(self, version: int | None = None) -> DataFrame:
        """``file, bucket, n_rows, ranges`` of a version, the current one unless told."""
        name = pointer.current(self.spark, self.path)[1] if version is None else pointer.named(self.spark, self.path, version)
        return self.spark.createDataFrame([], self.manifest) if name is None else self.spark.read.schema(self.manifest).parquet(f"{self.path}/{name}")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        return self._plain([r.file for r in self.files(version).select("file").collect()])

    def scan(self, *conditions: tuple[str, str, object]) -> DataFrame:
        """The rows that meet all ``(column, comparison, value)``, with ``=``, ``<``, ``<=``, ``>``, ``>=`` or ``is`` (null).

        Equal keys lead to their bucket; of the files left those are opened whose
        ranges can hold such rows.
        """
        return self._plain(self.matching(*conditions)).where(functools.reduce(operator.and_, [self._holds(*c) for c in conditions], F.lit(True)))

    def matching(self, *conditions: tuple[str, str, object]) -> list[str]:
        """The files that :meth:`scan` opens."""
        known = self.files()
        fixed = {c: v for c, op, v in conditions if op == "="}
        if set(self.keys) <= set(fixed):
            known = known.where(F.col("bucket") == self._bucket(*[F.lit(fixed[k]).cast(self.schema[k].dataType) for k in self.keys]))
        for column, op, value in conditions:
            if any(f.name == column for f in self.ranged):
                known = known.where(self._may_hold(column, op, value))
        return [r.file for r in known.select("file").collect()]

    def _holds(self, column: str, op: str, value) -> Column:
        if op == "is":
            return F.col(column).isNull()
        return _COMPARE[op](F.col(column), F.lit(value).cast(self.schema[column].dataType))

    def _may_hold(self, column: str, op: str, value) -> Column:
        seen, wanted = F.col("ranges")[column], F.lit(value).cast(self.schema[column].dataType)
        if op == "is":
            return seen["nulls"] > 0
        low, high = seen["low"] <= wanted, seen["high"] >= wanted
        return {"=": low & high, "<": low, "<=": low, ">": high, ">=": high}[op]

    # files

    def _bucket(self, *keys: Column) -> Column:
        """The bucket as Spark's own writer and joins take it."""
        return F.pmod(F.hash(*keys), F.lit(self.buckets)).cast("int")

    def _plain(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in files]) if files else self.spark.createDataFrame([], self.schema)

    def _in_buckets(self, files: list[str]) -> DataFrame:
        """The files as a bucketed table, which a join on the keys reads without an exchange."""
        if not files:
            return self.spark.createDataFrame([], self.schema)
        name, keys = f"bucketed_{uuid.uuid4().hex}", ", ".join(f"`{k}`" for k in self.keys)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        these = ",".join(f.rpartition("/")[2] for f in files)
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (pathGlobFilter '{{{these},}}', recursiveFileLookup 'true') CLUSTERED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/data'")
        try:
            return self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")  # the files stay

    def _write(self, rows: DataFrame) -> DataFrame:
        """Writes rows as one file a bucket, and lists the files; a failed or lost write leaves files that no version names."""
        folder, name = f"data/{uuid.uuid4().hex}", f"bucketed_{uuid.uuid4().hex}"
        try:
            rows.select(self.schema.names).repartition(self.buckets, *self.keys).write.format("parquet").bucketBy(self.buckets, *self.keys).option("path", f"{self.path}/{folder}").saveAsTable(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        return self._listed(folder)

    def _listed(self, folder: str) -> DataFrame:
        def ends(f: T.StructField) -> Column:
            low, high = F.min(f.name), F.max(f.name)
            if isinstance(f.dataType, T.StringType):
                low, high = F.substring(low, 1, RANGE_LETTERS), F.when(F.length(high) > RANGE_LETTERS, F.concat(F.substring(high, 1, RANGE_LETTERS), F.lit(_LAST))).otherwise(high)
            return F.struct(low.alias("low"), high.alias("high"), F.count_if(F.col(f.name).isNull()).alias("nulls")).alias(f.name)

        written = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}")
        return written.groupBy(F.concat(F.lit(f"{folder}/"), F.col("_metadata.file_name")).alias("file")).agg(F.first(self._bucket(*map(F.col, self.keys))).alias("bucket"), F.count("*").alias("n_rows"), F.struct(*map(ends, self.ranged)).alias("ranges"))

    def _publish(self, files: DataFrame, after: int) -> int:
        name = f"versions/{uuid.uuid4().hex}"
        files.select(self.manifest.names).coalesce(1).write.parquet(f"{self.path}/{name}")
        return pointer.publish(self.spark, self.path, name, after)

    # changes

    def replace(self, rows: DataFrame) -> int:
        """All rows anew."""
        at = self.version()
        return self._publish(self._write(rows), at)

    def change(self, source: DataFrame, merge) -> int:
        """Rewrites the buckets that keys of ``source`` fall into: ``merge(rows of these, source)`` gives their rows.

        The rows that are replaced stay where they are for readers of older
        versions. Raises :class:`pointer.ConcurrentWrite` if another change came first.
        """
        at = self.version()
        known = self.files(at) if at else self.files()
        touched = [r.bucket for r in source.select(self._bucket(*map(F.col, self.keys)).alias("bucket")).distinct().collect()]
        if not touched:
            return at
        hit = F.col("bucket").isin(touched)
        old = [r.file for r in known.where(hit).select("file").collect()]
        new = self._write(merge(self._in_buckets(old), source))
        return self._publish(known.where(~hit).unionByName(new), at)

    def upsert(self, source: DataFrame, policies: dict[str, Policy] | None = None, default: Policy = Policy.REPLACE) -> int:
        return self.change(source, lambda old, new: upsert(old, new, self.keys, policies, default))

    def insert_absent(self, source: DataFrame) -> int:
        """New keys only, as files beside those of their buckets; nothing stored is written again."""
        at = self.version()
        fresh = source.dropDuplicates(self.keys)
        if at:
            known = self.files(at)
            touched = [r.bucket for r in source.select(self._bucket(*map(F.col, self.keys)).alias("bucket")).distinct().collect()]
            old = self._in_buckets([r.file for r in known.where(F.col("bucket").isin(touched)).select("file").collect()])
            fresh = fresh.join(old.select(self.keys), self.keys, "left_anti")
            return self._publish(known.unionByName(self._write(fresh)), at)
        return self._publish(self._write(fresh), at)

    def update_from(self, source: DataFrame, columns: list[str]) -> int:
        """New values where the source has some; keys that the table lacks are left out."""
        return self.change(source, lambda old, new: update_from(old, new, self.keys, columns))

    def reset_then_set(self, source: DataFrame, columns: list[str], flags: tuple[str, ...] = ()) -> int:
        """Columns cleared in all rows, so in all buckets, then set by the source."""
        at = self.version()
        old = self._in_buckets([r.file for r in self.files(at).select("file").collect()]) if at else self.read()
        return self._publish(self._write(reset_then_set(old, source, self.keys, columns, flags)), at)

    def remove(self, keys: DataFrame) -> int:
        return self.change(keys.select(self.keys).distinct(), lambda old, gone: old.join(gone, self.keys, "left_anti"))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes the files that none of the newest ``keep`` versions names, and the older marks; returns the files' names.

        No change may be under way, as its files are named by no version yet.
        """
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        marks = pointer.numbers(self.spark, self.path)
        used = {r.file for n in marks[:keep] for r in self.files(n).select("file").collect()}
        gone = []
        for folder in _names(fs, path(f"{self.path}/data")):
            there = [f for f in _names(fs, path(f"{self.path}/data/{folder}")) if f.startswith("part-")]
            left = [f for f in there if f"data/{folder}/{f}" in used]
            gone += [f"data/{folder}/{f}" for f in there if f not in left]
            for f in there:
                if f not in left:
                    fs.delete(path(f"{self.path}/data/{folder}/{f}"), False)
            if not left:
                fs.delete(path(f"{self.path}/data/{folder}"), True)
        pointer.drop_before(self.spark, self.path, min(marks[:keep], default=0))
        return gone


def _names(fs, folder) -> Iterable[str]:
    return [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []


