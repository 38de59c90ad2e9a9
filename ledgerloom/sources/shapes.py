"""Matrices of any shape in JSON lines, brought to rows of cells inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _text(v: Column) -> Column:
    """A cell's text: of texts and numbers themselves, of what holds more its JSON, of null nothing."""
    return F.when(F.is_variant_null(v), F.lit(None).cast("string")).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


def matrix_of(value: Column) -> Column:
    """The rows of a JSON value: a scalar or an object is one cell, a list of scalars one row; in a list that holds any list
    every member is a row, a scalar one of one cell; an empty list has no rows."""
    members = _list(value)
    rows = F.transform(members, lambda m: F.coalesce(_list(m), F.array(m)))
    shaped = F.when(members.isNull(), F.array(F.array(value))).when(F.exists(members, lambda m: _list(m).isNotNull()), rows).when(F.size(members) == 0, F.filter(rows, lambda r: F.lit(False))).otherwise(F.array(members))
    return F.transform(shaped, lambda row: F.transform(row, _text))


def json_matrix(lines: DataFrame, text: str, order: str) -> DataFrame:
    """(_ord, cells) of JSON lines, each a value of any shape; ``_ord`` is the line's order and the row within it.

    A line that isn't JSON is one cell with its text; null lines have no rows. Rows may be ragged.
    """
    parsed = lines.filter(F.col(text).isNotNull()).select(F.col(order).alias("line"), F.col(text).alias("text"), F.try_parse_json(F.col(text)).alias("v"))
    rows = F.when(F.col("v").isNull(), F.array(F.array("text"))).otherwise(matrix_of(F.col("v")))
    return parsed.select("line", F.posexplode(rows).alias("row", "cells")).select(F.struct("line", "row").alias("_ord"), "cells")
