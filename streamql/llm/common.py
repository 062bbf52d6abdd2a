"""What the operators share: word pattern, shared storage, Python workers that hold little memory."""

import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space (listed one by one, which Java matches faster than a range).
WORD = r"[^\x20\x09\x0A\x0B\x0C\x0D]+"
#: Rows of a batch that a worker takes at once.
SLICE = 512
#: Blocks of so many bytes go back to the system as soon as they are free.
MAPPED = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a session that runs on this machine alone (tests) gets a
    temporary folder; on a cluster that would not be shared, so it is an error.
    """
    own = spark.conf.get("spark.checkpoint.dir", "") or getattr(spark, "_streamql_dir", "")
    if not own:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = spark._streamql_dir = "file://" + tempfile.mkdtemp(prefix="streamql-")
    return own.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/streamql/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.__dict__.setdefault("_streamql_made", [])
    made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._streamql_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that stored() gave and that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, [t._streamql_path])


def made(spark: SparkSession) -> set[str]:
    """The tables that stored() has written in this session and that still stand."""
    return set(spark.__dict__.get("_streamql_made", ()))


def released(spark: SparkSession, paths=None) -> None:
    """Delete intermediate tables: those given, else all of this session. Results that still read them must have been written."""
    _delete(spark, list(made(spark) if paths is None else paths))


def _delete(spark, paths):
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in spark.__dict__.get("_streamql_made", ()):
            spark._streamql_made.remove(path)


def ascii_lower(text):
    """A-Z to a-z, nothing else: Spark's lower() would fold all of Unicode."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@functools.cache
def _libc():
    """The C library, told to return large free blocks at once; None if it can't be told."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, MAPPED)  # M_MMAP_THRESHOLD; given, it no longer grows with the blocks that are freed
        libc.mallopt(-1, MAPPED)  # M_TRIM_THRESHOLD
        return libc if hasattr(libc, "malloc_trim") else None
    except (AttributeError, OSError):
        return None


def _sliced(batches):
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def lean(work):
    """work (batches -> batches) for a worker process that outlives its task.

    Workers are used again and again, and what Arrow's and C's allocators keep of freed memory
    counts against the executor all along. So Arrow takes its memory from the C library,
    which gives large blocks back at once, and the rest goes back at the end of the task. Batches
    come in slices, so the Python values of a few rows are held, not of thousands. Rows are the same.
    """

    def rows(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        libc = _libc()
        try:
            yield from work(_sliced(batches))
        finally:
            gc.collect()
            if libc:
                libc.malloc_trim(0)

    return rows


def mapped(df: DataFrame, work, schema) -> DataFrame:
    """df.mapInArrow(work, schema) in workers that hold little memory."""
    return df.mapInArrow(lean(work), schema)
