"""Shared plumbing of the training-data operators: tables, shared folders and cuts of lineage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import pickle
import sys
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark only (the path may be in a remote store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset and driver and executors are
    one process. On a cluster executors would write to disks that no one else reads, so there it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='refsift-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort at the end of the program; a stopped session leaves the folder to the cluster's retention."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Workspace:
    """Intermediate tables of one operator call, in the shared folder, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/refsift-{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: list[tuple[DataFrame, str]] = []
        atexit.register(_at_exit, weakref.ref(spark), self.path)

    def cut(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write df as Parquet and read it back: lineage ends at the written files."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{label}"
        with freed_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files of frames that cut() returned; only for frames which no later plan reads."""
        for df in frames:
            for path in [p for f, p in self._paths if f is df]:
                _remove(self.spark, path)


def _at_exit(ref, path: str) -> None:
    spark = ref()
    if spark is not None:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the gateway may be gone already
            return


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go as soon as the query that wrote them has ended."""
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was)


def once(docs: DataFrame, pairs: DataFrame, same: Column) -> DataFrame:
    """Of the rows of docs whose doc_id is an _rs_id of pairs, one for each of its (_rs_id, _rs_same) with the value of
    same: the one whose columns have the smallest hash. Rows with other ids aren't touched. The rows of an id are
    aggregated in part before they are shuffled, so an id of very many rows is no hot key."""
    if pairs.isEmpty():
        return docs
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    marked = docs.join(pairs.select("_rs_id").distinct(), F.col("doc_id").eqNullSafe(F.col("_rs_id")), "left_semi")
    held = marked.select(row.alias("_rs_row"), F.col("doc_id").alias("_rs_id"), same.alias("_rs_same"))
    one = held.groupBy("_rs_id", "_rs_same").agg(F.min_by("_rs_row", F.xxhash64("_rs_row")).alias("_rs_row"))
    a, b = one.alias("a"), pairs.alias("b")
    hit = F.col("a._rs_id").eqNullSafe(F.col("b._rs_id")) & (F.col("a._rs_same") == F.col("b._rs_same"))
    kept = a.join(b, hit, "left_semi").select("_rs_row.*")
    return docs.join(pairs.select("_rs_id").distinct(), F.col("doc_id").eqNullSafe(F.col("_rs_id")), "left_anti").unionByName(kept)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def shipped(spark: SparkSession, model: object) -> Callable[[], object]:
    """A function that gives workers a model of bounded size; its classes travel by value with it."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(held.value)  # noqa: S301  our own bytes


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which a worker gives back the memory that it has freed: workers are kept from task to task, and what
    one operator needed would otherwise count beside the next one's."""

    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
                if trim is not None:
                    trim(0)

    return inner
