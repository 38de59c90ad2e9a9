"""Incremental ingestion: new source files become canonical rows as they arrive.

The reconciliation itself is a batch over whole tables; a stream only keeps its sources typed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import CANONICAL
from ..sources.tables import canonical

RAW_DDL = ", ".join(f"{c} string" for c in CANONICAL) + ", _ord long, row_label string"


def raw_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_a_trigger: int = 100) -> DataFrame:
    """Raw canonical text columns of a growing folder."""
    return spark.readStream.schema(RAW_DDL).format(fmt).option("maxFilesPerTrigger", files_a_trigger).load(path)


def ingest(stream: DataFrame, target: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Append typed rows to ``target``; stateless, so exactly-once by the file sink's log."""
    rows = canonical(stream).withColumn("ingested_month", F.date_format(F.coalesce("doc_date", F.lit("0001-01-01").cast("date")), "yyyy-MM"))
    writer = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("ingested_month")
    return (writer.trigger(availableNow=True) if once else writer).start()
