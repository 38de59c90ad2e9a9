"""A stored index for candidate search: postings by two-character substring, of any number of fields.

Postings lie in folders by field and by a part of their gram, each with its candidate, so a query
reads the folder of its rarest gram and nothing else, and verifies what it finds there. New
candidates are added as a batch; what is there isn't written again.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import bigrams, norm_text
from ..shared import cleared
from .search import MOST_SHOWN

#: Parts that a field's grams are dealt over.
PARTS = 16
#: Candidates that a task tells the grams of and writes the postings of, so that its share doesn't grow with the batch.
VALUES_A_PIECE = 500_000

_GRAMS = "gram string, n long, field string, batch int"
_POSTINGS = "gram string, value string, _ord decimal(38,0), field string, part int, batch int"
_VALUES = "value string, _ord decimal(38,0), field string, batch int"


def grams_of(text: str) -> list[str]:
    return list(dict.fromkeys(text[i : i + 2] for i in range(len(text) - 1)))


def part_of(gram: str) -> int:
    return zlib.crc32(gram.encode()) % PARTS


@dataclass
class CandidateIndex:
    """An index below ``path``; its folders are written by :meth:`add` and read by :meth:`search`."""

    spark: SparkSession
    path: str

    def _read(self, table: str, ddl: str) -> DataFrame:
        return self.spark.read.schema(ddl).option("ignoreMissingFiles", "true").parquet(f"{self.path}/{table}") if self._there(table) else self.spark.createDataFrame([], ddl)

    def _there(self, table: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")  # noqa: SLF001
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)  # noqa: SLF001

    def batches(self) -> int:
        """How many batches are in; a batch counts once its grams are written, which is done last."""
        return (self._read("grams", _GRAMS).agg(F.max("batch")).first()[0] or 0) if self._there("grams") else 0

    def add(self, candidates: DataFrame) -> int:
        """Add (field, value, _ord) rows and tell how many candidates were new.

        Texts of a field that differ in case alone are one candidate, under its first spelling; one
        that an earlier batch has stays as it is. Blank texts are none.
        """
        batch = self.batches() + 1
        clean = candidates.select("field", norm_text(F.col("value")).alias("value"), F.col("_ord").cast("decimal(38,0)").alias("_ord")).filter("value <> ''")
        first = clean.groupBy("field", F.lower("value").alias("k")).agg(F.min(F.struct("_ord", "value")).alias("f"))
        known = self._done("values", _VALUES).select("field", F.lower("value").alias("k"))
        new = first.join(known, ["field", "k"], "left_anti").select("f.value", "f._ord", "field", F.lit(batch).alias("batch"))
        self._write(new, "values", "field", "batch")
        values = self._read("values", _VALUES).filter(F.col("batch") == batch)
        n = values.count()
        pieces = max(1, -(-n // VALUES_A_PIECE))
        held = values if pieces == 1 else values.repartition(pieces, "field", "value")  # before their grams are told, of which each has many
        rows = held.select(F.explode(bigrams(F.col("value"))).alias("gram"), "value", "_ord", "field", "batch")
        postings = rows.select("gram", "value", "_ord", "field", F.pmod(F.crc32(F.encode("gram", "utf-8")), F.lit(PARTS)).cast("int").alias("part"), "batch")
        postings = postings.repartition("field", "part") if pieces == 1 else postings
        self._write(postings, "postings", "field", "part", "batch")
        counts = self._read("postings", _POSTINGS).filter(F.col("batch") == batch).groupBy("gram", "field", "batch").agg(F.count(F.lit(1)).alias("n"))
        self._write(counts.select("gram", "n", "field", "batch").union(self.spark.createDataFrame([("", 0, "", batch)], _GRAMS)), "grams", "field", "batch")
        return n

    def _write(self, df: DataFrame, table: str, *by: str) -> None:
        """A batch's rows; what a batch cut short has left is written over."""
        conf = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(conf)
        self.spark.conf.set(conf, "dynamic")
        try:
            with cleared(self.spark):
                df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{table}", compression="zstd")
        finally:
            self.spark.conf.set(conf, before)

    def _done(self, table: str, ddl: str) -> DataFrame:
        """Rows of finished batches."""
        return self._read(table, ddl).filter(F.col("batch") <= self.batches())

    def rarest(self, field: str, query: str) -> str | None:
        """The query's gram that fewest candidates of a field have, None if there is one that none has."""
        grams = grams_of(query)
        counts = self._done("grams", _GRAMS).filter((F.col("field") == field) & F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n")).collect()
        return min(counts, key=lambda r: (r.n, r.gram)).gram if len(counts) == len(grams) else None

    def matches(self, field: str, query: str) -> DataFrame:
        """(value, _ord) of a field's candidates that contain the query, whatever their case; a blank query matches all."""
        wanted = query.strip().lower()
        values = self._done("values", _VALUES).filter(F.col("field") == field).select("value", "_ord")
        if len(wanted) > 1:
            gram = self.rarest(field, wanted)
            rows = self._done("postings", _POSTINGS).filter((F.col("field") == field) & (F.col("part") == part_of(gram or "")) & (F.col("gram") == gram))
            values = rows.select("value", "_ord") if gram is not None else values.filter(F.lit(False))
        return values.filter(F.contains(F.lower("value"), F.lit(wanted)))

    def search(self, field: str, query: str, limit: int = MOST_SHOWN) -> DataFrame:
        """The first ``limit`` matches in their order."""
        return self.matches(field, query).orderBy("_ord").limit(limit)
