"""Tables written to the folder that the driver and all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of files read that one part of what is dealt out by :func:`dealt` stands for.
BYTES_A_PART = 16 << 20
#: Bytes of files read that one slice of :func:`in_slices` stands for, and slices that a task writes to at once without
#: sorting its rows by them.
BYTES_A_SLICE = 1 << 30
SLICES_AT_ONCE = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in local mode one is made where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(df: DataFrame, label: str, *, by: tuple[str, ...] = (), codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: its lineage ends there.

    An executor lost later costs only a reread of those files. The folder belongs to the
    run; whoever set ``spark.checkpoint.dir`` clears it.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path, compression=codec)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


@contextmanager
def _with_conf(spark: SparkSession, conf: str, value: str) -> Iterator[None]:
    before = spark.conf.get(conf)
    spark.conf.set(conf, value)
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def cleared(spark: SparkSession):
    """What the runs within shuffle goes from disk when each ends, not when the driver next collects its garbage."""
    return _with_conf(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def settled(df: DataFrame, label: str, *, by: tuple[str, ...] = ()) -> DataFrame:
    """:func:`scratch` for a step of a large job: what was shuffled to make the table is gone once it is written, so the
    steps' shuffles never lie on disk together."""
    with cleared(df.sparkSession):
        return scratch(df, label, by=by, codec="zstd")


def in_slices(rows: DataFrame, by: Column, run: Callable[[DataFrame], DataFrame], label: str, *, size: int) -> DataFrame:
    """``run`` over ``rows``, which must do the same over those of each value of ``by`` (a whole number) alone.

    Where the files behind them (``size`` bytes) are large, rows are first written by slices of ``by``, with what it takes
    to make them done once, and ``run`` goes over slice after slice: what it shuffles is a slice's share and goes with it,
    as do the slice's rows. Its outcomes are kept as one table.
    """
    n, spark = -(-size // BYTES_A_SLICE), rows.sparkSession
    if n < 2:
        return run(rows)
    with _with_conf(spark, "spark.sql.maxConcurrentOutputFileWriters", str(min(n, SLICES_AT_ONCE))):
        held = settled(rows.withColumn("_slice", F.pmod(by, F.lit(n)).cast("int")), f"{label}-slices", by=("_slice",))
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for i in range(n):
        found = run(held.filter(F.col("_slice") == i).drop("_slice"))
        with cleared(spark):
            found.write.mode("append").parquet(path, compression="zstd")
        _delete(spark, f"{held.scratch_path}/_slice={i}")
    discard(held)
    return spark.read.schema(found.schema).parquet(path)


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, as their store tells them; no file is opened."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()  # noqa: SLF001
    files = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles()]
    return sum(f.getFileSystem(conf).getFileStatus(f).getLen() for f in files)


def large(df: DataFrame) -> bool:
    """Whether the files that ``df`` reads are worth steps of their own."""
    return file_bytes(df) > BYTES_A_SLICE


def parts_for(spark: SparkSession, size: int) -> int:
    """In how many parts so many bytes are dealt out: the session's number, or more where a part would get too large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BYTES_A_PART))


def dealt(df: DataFrame, *by: str, size: int) -> DataFrame:
    """``df`` dealt out by ``by`` once; what is grouped by these columns and others then stays in the task that gets it.

    Tasks grow in number with ``size``, the bytes that it is made from, and not in what each holds.
    """
    n = parts_for(df.sparkSession, size)
    few = n == int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(*by) if few else df.repartition(n, *by)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)  # noqa: SLF001


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "scratch_path", None):
            _delete(df.sparkSession, path)
