"""Tables in partitions by day and batch, with filters of their ids and compaction of closed days."""

from __future__ import annotations

import datetime as dt
import functools
import operator
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.sources import pointer

#: Bits in a block of a filter, as Spark's bitmaps have them, and bits set for an id, all in one block.
BLOCK_BITS, BITS = 32768, 4
STATE = "day date, folder string, batches array<string>"


def _block(ident: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(blocks)).cast("int")


def _bits(ident: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(ident, F.lit(k)), F.lit(BLOCK_BITS)) for k in range(BITS)])


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1


class DayTable:
    """A table in partitions by the day of its time column ``at`` and by the batch that wrote them.

    A batch adds partitions of its own, the same batch written again replaces
    just these, and what is too old goes by whole days. With ``ident``, every
    partition has a Bloom filter of its ids beside it, in ``blocks`` bitmaps.
    :meth:`compact` joins the batches of closed days; a pointer makes the joined
    files count and hides those they are made of. Times are those of the
    session's zone.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, at: str, ident: str | None = None, blocks: int = 256) -> None:
        self.spark, self.path, self.schema, self.at, self.ident, self.blocks = spark, path.rstrip("/"), schema, at, ident, blocks
        self.compacted = f"{self.path}/_compacted"

    def _folder(self, path: str):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def _names(self, path: str, prefix: str) -> list[str]:
        fs, root = self._folder(path)
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix))

    def _delete(self, path: str) -> None:
        fs, root = self._folder(path)
        fs.delete(root, True)

    # reading

    def _state(self) -> list:
        """Compacted days: where their rows are, and the batches that these are made of."""
        name = pointer.current(self.spark, self.compacted)[1]
        return [] if name is None else self.spark.read.schema(STATE).parquet(f"{self.compacted}/{name}").collect()

    def _rows(self, since: dt.date | None, days: list[dt.date] | None) -> DataFrame:
        """Rows with ``day`` and ``batch``, each once."""
        schema = f"{self.schema}, day date, batch string"
        kept = lambda day: (since is None or day >= since) and (days is None or day in days)
        state = [r for r in self._state() if kept(r.day)]
        fs, root = self._folder(self.path)
        rows = self.spark.read.schema(schema).parquet(self.path) if fs.exists(root) else self.spark.createDataFrame([], schema)
        if since is not None:
            rows = rows.where(F.col("day") >= F.lit(since))
        if days is not None:
            rows = rows.where(F.col("day").isin(days))
        hidden = [(F.col("day") == F.lit(r.day)) & F.col("batch").isin(r.batches) for r in state]
        if hidden:
            rows = rows.where(~functools.reduce(operator.or_, hidden))
        for folder in sorted({r.folder for r in state}):
            base = f"{self.compacted}/{folder}"
            joined = self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/day={r.day}" for r in state if r.folder == folder])
            rows = rows.unionByName(joined)
        return rows

    def read(self, since: dt.datetime | None = None, but: str | None = None, days: list[dt.date] | None = None) -> DataFrame:
        """The rows, from a time on, without those of one batch, or of some days; other days are not scanned. A table never written is empty."""
        rows = self._rows(None if since is None else since.date(), days)
        if since is not None:
            rows = rows.where(F.col(self.at) >= F.lit(since))
        if but is not None:
            rows = rows.where(F.col("batch") != but)
        return rows.select(self.spark.createDataFrame([], self.schema).columns)

    def stored_before(self, rows: DataFrame, since: dt.datetime, but: str | None = None) -> DataFrame:
        """Ids of ``rows`` that are stored, from a time on, by other batches than ``but``.

        The filters tell which days may have some; other days are not opened, so
        new ids cost no look at stored rows.
        """
        days = self.days_with(rows, since, but)
        if not days:
            return rows.select(self.ident).limit(0)
        return self.read(since, but, days).select(self.ident).join(rows.select(self.ident), self.ident, "left_semi")

    def days_with(self, rows: DataFrame, since: dt.datetime, but: str | None = None) -> list[dt.date]:
        """The days whose filters have an id of ``rows``: all that do, and few that do not."""
        path = f"{self.path}/_filters"
        fs, root = self._folder(path)
        if not fs.exists(root):
            return []
        filters = self.spark.read.schema("block int, bitmap binary, day date, batch string").parquet(path).where(F.col("day") >= F.lit(since.date()))
        if but is not None:
            filters = filters.where(F.col("batch") != but)
        asked = rows.select(_block(F.col(self.ident), self.blocks).alias("block"), _bits(F.col(self.ident)).alias("bits")).distinct()
        found = asked.join(filters, "block").where(F.forall("bits", lambda b: _is_set(F.col("bitmap"), b)))
        return sorted(r.day for r in found.select("day").distinct().collect())

    # writing

    def put(self, df: DataFrame, batch: str) -> None:
        """Add the rows of a batch. They must not depend on what that batch stored before; rows without a time are refused."""
        day = F.coalesce(F.to_date(self.at), F.raise_error(f"{self.at} is missing").cast("date"))
        rows = df.withColumns({"day": day, "batch": F.lit(batch)})
        self._write(rows, self.path)
        if self.ident:
            each = rows.select("day", "batch", _block(F.col(self.ident), self.blocks).alias("block"), F.explode(_bits(F.col(self.ident))).alias("bit"))
            self._write(each.groupBy("day", "batch", "block").agg(F.bitmap_construct_agg("bit").alias("bitmap")).select("block", "bitmap", "day", "batch"), f"{self.path}/_filters")

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)

    def compact(self, before: dt.date) -> list[dt.date]:
        """Joins the batches of days before a date into few files; returns the days that had several.

        Readers see the batches until the pointer moves and the joined files from
        then on; a batch that comes late, or again, stands beside them. What was
        joined stays on disk until :meth:`vacuum`.
        """
        after, old = pointer.current(self.spark, self.compacted)[0], {r.day: r for r in self._state()}
        todo: dict[dt.date, list[str]] = {}
        for name in self._names(self.path, "day="):
            day = dt.date.fromisoformat(name)
            done = set(old[day].batches) if day in old else set()
            loose = [b for b in self._names(f"{self.path}/day={name}", "batch=") if b not in done]
            if day < before and len(loose) + (day in old) > 1:
                todo[day] = sorted(done) + loose
        if not todo:
            return []
        folder = f"data-{uuid.uuid4().hex}"
        self._rows(None, list(todo)).hint("rebalance", "day").write.partitionBy("day").parquet(f"{self.compacted}/{folder}")
        rows = [(d, folder, b) for d, b in todo.items()] + [tuple(r) for d, r in old.items() if d not in todo]
        self._publish(rows, after)
        return sorted(todo)

    def _publish(self, rows: list[tuple], after: int) -> None:
        name = f"state-{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, STATE).coalesce(1).write.parquet(f"{self.compacted}/{name}")  # a row a day
        pointer.publish(self.spark, self.compacted, name, after)

    def vacuum(self) -> None:
        """Deletes the batches that were joined and joined files that no longer count. No reader may be at them still."""
        state = self._state()
        for r in state:
            for batch in r.batches:
                self._delete(f"{self.path}/day={r.day}/batch={batch}")
        used = {(r.folder, r.day.isoformat()) for r in state}
        for folder in self._names(self.compacted, "data-"):
            for day in self._names(f"{self.compacted}/data-{folder}", "day="):
                if (f"data-{folder}", day) not in used:
                    self._delete(f"{self.compacted}/data-{folder}/day={day}")
        pointer.drop_before(self.spark, self.compacted, pointer.current(self.spark, self.compacted)[0])

    def expire(self, days: int, now: dt.datetime) -> None:
        """Drop the days that lie wholly before the horizon; ``read(since)`` leaves out the rest of the day it falls on."""
        first = (now - dt.timedelta(days=days)).date()
        state = self._state()
        gone = [r for r in state if r.day < first]
        if gone:
            self._publish([tuple(r) for r in state if r.day >= first], pointer.current(self.spark, self.compacted)[0])
        for path in [f"{self.compacted}/{r.folder}/day={r.day}" for r in gone] + [f"{p}/day={d}" for p in (self.path, f"{self.path}/_filters") for d in self._names(p, "day=") if d < first.isoformat()]:
            self._delete(path)
