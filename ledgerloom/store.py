"""Folders changed in one step: what is written becomes visible whole, with its metadata, or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file beside a folder's rows that holds its metadata; readers of rows pass over it.
META = "_recon_meta.json"
#: Parts that a failed write is tried again in.
CHUNKS = 8

# Fixed value: text of a failed write.
FAILED_TEXT = "整块写入失败：{path}；{whole}。分块写入失败：第 {n} 块 {path}；{chunk}"


class Store:
    """The file system of a path, as Spark's own readers and writers see it."""

    def __init__(self, spark: SparkSession, path: str):
        jvm, self.path = spark._jvm, path.rstrip("/")  # noqa: SLF001
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def empty(self, path: str) -> bool:
        return len(self._fs.listStatus(self._path(path))) == 0

    def rename(self, path: str, to: str) -> None:
        if not self._fs.rename(self._path(path), self._path(to)):
            raise OSError(f"{path} can't be renamed to {to}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def put(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def get(self, path: str) -> str | None:
        if not self.exists(path):
            return None
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def _old(path: str) -> str:
    return f"{path}__old"


def current(spark: SparkSession, path: str) -> str | None:
    """Where a folder's rows and metadata are: the folder, or, where a write was cut short between its two renames, the one
    before it; None if there is neither."""
    store = Store(spark, path)
    return next((p for p in (store.path, _old(store.path)) if store.exists(p)), None)


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a write that was cut short, so that there is one folder again."""
    store = Store(spark, path)
    if store.exists(old := _old(store.path)):
        store.delete(old) if store.exists(store.path) else store.rename(old, store.path)


def metadata(spark: SparkSession, path: str) -> dict | None:
    """A folder's metadata, None if it has none or can't be read."""
    where = current(spark, path)
    try:
        found = json.loads(Store(spark, path).get(f"{where}/{META}") or "null") if where else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def write_staged(df: DataFrame, path: str, fmt: str = "parquet", options: dict[str, str] | None = None, chunks: int = CHUNKS) -> str:
    """Rows in a new folder beside ``path``. If that fails, they are tried again in ``chunks`` parts, so that what failed for
    its size goes through; if a part fails too, nothing is left and the error tells of both."""
    spark, staged = df.sparkSession, f"{path.rstrip('/')}__staged-{uuid.uuid4().hex}"
    writer = lambda rows, mode: rows.write.format(fmt).options(**(options or {})).mode(mode).save(staged)
    try:
        writer(df, "errorifexists")
        return staged
    except Exception as whole:  # noqa: BLE001 - whatever it was, parts may go through
        store = Store(spark, path)
        store.delete(staged)
        part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(chunks))
        for n in range(chunks):
            try:
                writer(df.filter(part == n), "append")
            except Exception as chunk:  # noqa: BLE001
                store.delete(staged)
                raise OSError(FAILED_TEXT.format(path=path, whole=whole, n=n + 1, chunk=chunk)) from chunk
        return staged


def commit(spark: SparkSession, staged: str, path: str, meta: dict) -> None:
    """Put a staged folder, with its metadata in it, in the place of ``path``. The folder before it stays until the new one is
    there, and comes back if it can't be put there."""
    store = Store(spark, path)
    store.put(f"{staged}/{META}", json.dumps(meta, ensure_ascii=False))
    recover(spark, path)
    had = store.exists(store.path)
    if had:
        store.rename(store.path, _old(store.path))
    try:
        store.rename(staged, store.path)
    except Exception:
        if had:
            store.rename(_old(store.path), store.path)
        store.delete(staged)
        raise
    if had:
        store.delete(_old(store.path))


def replace(df: DataFrame, path: str, meta: dict | Callable[[], dict], fmt: str = "parquet", options: dict[str, str] | None = None) -> None:
    """Write rows and metadata as one; ``meta`` may be worked out once the rows are written."""
    staged = write_staged(df, path, fmt, options)
    commit(df.sparkSession, staged, path, meta() if callable(meta) else meta)


__all__ = ["META", "Store", "commit", "current", "metadata", "recover", "replace", "write_staged"]
