"""A pointer to the current one of several folders: numbered marker files that hold a folder's name.

Readers follow the highest number; a writer that finds its number taken has met
another one. Nothing that a reader may be reading is renamed or deleted here.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class ConcurrentWrite(RuntimeError):
    """Another writer published first; what was written is not visible and can be written again."""


def _folder(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_current")
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _mark(spark: SparkSession, root, number: int):
    return spark._jvm.org.apache.hadoop.fs.Path(root, f"{number:012d}")


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the marks at ``path``, newest first."""
    fs, root = _folder(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    return sorted((int(n) for n in names if n.isdigit()), reverse=True)


def named(spark: SparkSession, path: str, number: int) -> str:
    """The folder that a mark names."""
    fs, root = _folder(spark, path)
    stream = fs.open(_mark(spark, root, number))
    try:
        return stream.readUTF()
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The newest mark; ``(0, None)`` where nothing was published."""
    for number in numbers(spark, path):
        return number, named(spark, path, number)
    return 0, None


def resolve(spark: SparkSession, path: str) -> str:
    """The folder that readers of ``path`` read: the current one, or ``path`` itself where nothing was published."""
    name = current(spark, path)[1]
    return path if name is None else f"{path.rstrip('/')}/{name}"


def publish(spark: SparkSession, path: str, name: str, after: int) -> int:
    """Makes the folder ``name`` the current one, if mark ``after`` is still the newest.

    The mark is written beside its place and renamed, which fails where another
    writer's mark stands, so marks always have a name and never change.
    """
    jvm = spark._jvm
    fs, root = _folder(spark, path)
    newest = max(numbers(spark, path), default=0)
    if newest != after:
        raise ConcurrentWrite(f"{path} is at {newest}, not {after}")
    fs.mkdirs(root)
    beside, mark = jvm.org.apache.hadoop.fs.Path(root, f".{uuid.uuid4().hex}"), _mark(spark, root, after + 1)
    stream = fs.create(beside, False)
    stream.writeUTF(name)
    stream.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(mark), how)
    except Py4JJavaError as e:
        fs.delete(beside, False)
        if "AlreadyExists" not in str(e.java_exception):
            raise
        raise ConcurrentWrite(f"{path}: {after + 1} is taken") from e
    return after + 1


def drop_before(spark: SparkSession, path: str, number: int) -> None:
    """Deletes the marks below ``number`` and the folders that they name."""
    fs, root = _folder(spark, path)
    for old in numbers(spark, path):
        if old < number:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{named(spark, path, old)}"), True)
            fs.delete(_mark(spark, root, old), False)
