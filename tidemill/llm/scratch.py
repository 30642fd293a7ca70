"""Intermediate tables in the folder that all executors share.

Written tables cut lineage: a lost executor costs the rerun of unfinished tasks only, never of earlier stages. What no
later step reads is discarded on the way; the rest goes when the session's process ends.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import ship_package

_own: list[str] = []
_made: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset on one machine (tests), one temporary folder per process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tidemill-scratch-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/tidemill/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_drop_all)
    _made[path] = spark
    return path


def _drop_all() -> None:
    for path, spark in list(_made.items()):
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before: nothing can be reached any more
            return


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later step reads."""
    for t in tables:
        drop(t.sparkSession, t.scratch_path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no later read needs."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made.pop(path, None)


def prepare(df: DataFrame) -> SparkSession:
    """The session of ``df``, with this package available to its Python workers."""
    ship_package(df.sparkSession)
    return df.sparkSession


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, after which the worker gives freed memory back to the system: workers outlive tasks, and the next stage's have their own needs."""

    def tidied(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return tidied


def whole_groups(batches: Batches, keys: list[str]) -> Iterator[pa.Table]:
    """Tables cut between groups of rows with equal long ``keys``, from batches in which such rows stand together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        head = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys], 1)
        other = np.flatnonzero((head != head[-1]).any(1))
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and not cut and tuple(head[0]) != last:
            yield pa.Table.from_batches(held)
            held = []
        elif cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
        last = tuple(head[-1])
    if held:
        yield pa.Table.from_batches(held)


#: Words of 64 bits in a filter of keys: 8 MB of bits, whatever the number of keys.
FILTER_WORDS = 1 << 20


def probably_in(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` (long) may be among those of ``keys`` (column key), before an exact join.

    A bitmap of fixed size is broadcast: at most FILTER_WORDS rows, a proven bound. It keeps all rows that the join
    needs, and the rest but for chance hits, so the join does not shuffle the whole table for a few rows.
    """
    place = lambda k: F.pmod(k, F.lit(64 * FILTER_WORDS))
    bits = keys.select(place(F.col("key")).alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"))
    bits = materialize(bits.groupBy("word").agg(F.bit_or("bit").alias("bits")), "filter")
    asked = df.withColumn("_p", place(key)).withColumn("_w", F.shiftright("_p", 6))
    return asked.join(F.broadcast(bits), F.col("_w") == F.col("word")).where("(bits & shiftleft(1L, cast(_p % 64 as int))) <> 0").select(*df.columns)
