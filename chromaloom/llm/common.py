"""Helpers that the operators share: tables in the shared folder, Arrow maps, id remainders."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where ``spark.checkpoint.dir`` is unset and the master is local, as in tests on one machine.
FALLBACK_CHECKPOINT_DIR = "/tmp/checkpoints/chromaloom"

#: Rows of one Arrow batch at most; long texts make a batch heavy, so it is kept short.  Functions that want more
#: rows at once gather batches themselves (:func:`gathered`), so no result depends on this setting.
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, without a trailing slash.

    ``spark.checkpoint.dir`` names it; without that setting only a local master will do.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = FALLBACK_CHECKPOINT_DIR
    return root.rstrip("/") + "/chromaloom"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the tables written inside :func:`scratch`, innermost last.
_SCRATCH: list[list[str]] = []


def written(df: DataFrame, tag: str, outer: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back; with ``outer`` it outlives the innermost :func:`scratch`.

    It cuts the lineage as ``checkpoint()`` does and survives lost executors,
    but is stored by column and compressed.  Shuffle files of the job go when it
    has ended, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if len(_SCRATCH) > outer:
        _SCRATCH[-1 - outer].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table or folder of :func:`shared_path` once nothing reads it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what :func:`written` has written inside; no frame that is used later may read it."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            delete_path(spark, path)


def text_or_empty(column: str) -> Column:
    """A text column with null taken as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_remainder(column: str, modulus: int) -> Column:
    """``crc32(id as text) mod modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def arrow_map(
    df: DataFrame,
    function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` with short batches.

    Columns whose names have dots or backticks, which it cannot take, go in under
    other names; functions that pass on all columns do so by place, and the
    schema names what comes out.
    """
    plain = [re.sub("[.`]", "_", name) for name in df.columns]
    if plain != df.columns:
        for k, name in enumerate(plain):
            while name != df.columns[k] and (name in df.columns or name in plain[:k]):
                name = "_" + name
            plain[k] = name
        df = df.toDF(*plain)
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) != ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df.mapInArrow(function, schema)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` or a few more; the last may be shorter and none is empty."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_KEPT: dict[str, tuple] = {}


def kept_by_worker(name: str, key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: the last object made only, so operators do not add up in it."""
    if _KEPT.get(name, (None,))[0] != key:
        _KEPT.clear()
        _KEPT[name] = (key, make())
    return _KEPT[name][1]


def release_kept() -> None:
    """Drop what :func:`kept_by_worker` holds; heavy functions call it before they start."""
    _KEPT.clear()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    """A column's name as it has to be written where dots and backticks mean something."""
    return f"`{name.replace('`', '``')}`"


def utf8_list(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as the empty text."""
    return [value or b"" for value in batch.column(name).cast(pa.binary()).to_pylist()]


def string_list(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column as Python strings, null as the empty text."""
    return [value or "" for value in batch.column(name).to_pylist()]


class TwoGenerationCache:
    """A dictionary of bounded size: full, it becomes the old generation, which is asked before recomputing."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: Iterable) -> list:
        """The distinct keys that neither generation has; those of the old one move up.

        Call once for a batch, then add the missing ones to ``young``: all keys of the batch are then in ``young``.
        """
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        young, old, absent = self.young, self.old, []
        for key in set(keys):
            if key not in young:
                if key in old:
                    young[key] = old[key]
                else:
                    absent.append(key)
        return absent
