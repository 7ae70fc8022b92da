"""Written intermediate tables: lineage is cut by files in the shared folder, never on one machine."""

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Folders of written tables.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where that is unset and the master is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="kgeo-"))


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/kgeo-{tag}-{uuid.uuid4().hex}"


#: Shuffle files go with the query that made them, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and return the written table: later readers repeat no work, and a lost executor costs none of it.

    The write's shuffle files are removed at its end. ``discard`` removes the table."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, tag)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` has written and that no later query reads."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop(df))
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def width(spark: SparkSession) -> int:
    """How many partitions an explicit shuffle takes: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which its worker hands free memory back: idle, it would hold it beside the JVM's."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
        if trim:
            trim(0)

    return each
