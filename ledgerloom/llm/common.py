"""Helpers shared by the operators: scratch tables, folds, bounded batches, output rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shared import discard, scratch, shared_dir

#: Characters of text that one Python step holds as objects at a time.
CHARS_AT_ONCE = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(column: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def whole_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row, null text as empty; other columns, whatever their names, are left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def bounded(batches: Iterator[pa.RecordBatch], column: str | int = "text", limit: int = CHARS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of ``column``; a longer text makes a slice of its own."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield batch.slice(start)


def arrow_of(ddl: str) -> pa.Schema:
    """The Arrow schema of a Spark DDL string; made on the driver and sent along with a task's function."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def rows_out(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    """A record batch from one sequence or Arrow array for each column of ``schema``."""
    arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def most_frequent(counted: DataFrame, most: int, key: str, by: str | None = None) -> pd.DataFrame:
    """At most ``most`` rows of (key, n), for each value of the column ``by`` if one is named: those of the highest
    ``n``, sorted by falling ``n``, then key.

    A histogram over steps of ``n``, of a fixed number of rows, tells from which step on the
    rows fit; a step is taken whole or not at all. So what reaches the driver doesn't grow with
    the number of partitions, as it would where each sends its own first rows.
    """
    step, part = F.floor(F.log2("n") * 64), F.col(by).cast("string") if by else F.lit("")
    held: dict[str, int] = {}
    least: dict[str, int] = {}
    for r in counted.groupBy(part.alias("part"), step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("step")).collect():
        held[r.part] = held.get(r.part, 0) + r.rows
        if held[r.part] <= most:
            least[r.part] = r.step
    if not least:
        return counted.limit(0).toPandas()
    found = counted.filter(step >= F.element_at(F.create_map(*(F.lit(x) for row in least.items() for x in row)), part)).toPandas()
    return found.sort_values(["n", key], ascending=[False, True], ignore_index=True)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


__all__ = ["CHARS_AT_ONCE", "arrow_of", "bounded", "discard", "id_fold", "most_frequent", "rows_out", "scratch", "shared_dir", "table", "type_of", "whole_texts"]
