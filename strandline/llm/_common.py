"""Shared helpers: tables, Arrow text buffers, hashing, materialisation in the shared folder."""

from __future__ import annotations

import contextlib
import os
import pathlib
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, read by Spark only (any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file:///tmp/strandline-checkpoints"
    return path.rstrip("/")


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the time of a block."""
    have = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if have is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, have)


#: Removes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors. Its shuffle files go as soon as it is written.

    The files go when the driver's JVM ends, since a result that is not yet computed may still read them; :func:`drop_written` removes them before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandline-{uuid.uuid4().hex}"
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str):
    """A long column as a new expression of equal value.

    An aggregate that is joined on its key shares the exchange of the other side, and then AQE can't split a hot key there. Under a new expression
    the reduced side gets an exchange of its own, and it can."""
    return F.col(name).bitwiseXOR(F.lit(0).cast("long"))


def drop_written(df: DataFrame) -> None:
    """Remove what :func:`materialise` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/strandline-" in top:
            p = jvm.org.apache.hadoop.fs.Path(top)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def hashed_sample(df: DataFrame, n: int, hashed: Column, *ties: str) -> DataFrame:
    """The ``n`` rows of least hash, as a sample that doesn't depend on the partitioning.

    A count gives a bound on the hash under which about 4 n rows are expected, so the sort that picks n of them stays small however many tasks there are."""
    count = df.count()
    part = F.pmod(hashed, F.lit(1 << 40)) / float(1 << 40)
    few = df if count <= 8 * n else df.filter(part < 4.0 * n / count)
    return few.orderBy(part, *ties).limit(n)


def texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 bounds (n + 1) of a string (or binary) array; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    binary = pa.types.is_binary(col.type)
    col = col.fill_null(b"" if binary else "").cast(pa.large_binary() if binary else pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    bounds = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package's source to the executors, once per application, so that they need no installation of it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = pathlib.Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(), f"{top.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def small_batches(spark: SparkSession, rows: int = 256, size: str = "8m") -> None:
    """Ship the package, and keep Arrow batches small, so that a Python worker holds few long texts at once. Only ever lowers what is set."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    have = int(spark.conf.get(key, "10000"))
    if have <= 0 or have > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def crc_mod(col: str, n: int):
    """crc32 of a column's decimal text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def vocab_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies: STRANDLINE_TOKENIZERS or the installed package."""
    own = os.environ.get("STRANDLINE_TOKENIZERS")
    if own:
        return os.path.join(own, name)
    import public_tokenizers

    return public_tokenizers.path(name)
