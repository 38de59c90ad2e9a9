import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import exprs
from ledgerloom.functions.values import parse_date_key, plain_text
from ledgerloom.model import Direction, OutputKind, QueryFilters, QueryState


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [(None, ""), ("  公司  ", "公司"), ("　a ﻿", "a"), ("a b", "a b"), ("\n\t", "")])
def test_norm_text(spark, text, want):
    assert one(spark, exprs.norm_text(F.lit(text))) == want
    assert plain_text(text) == want


@pytest.mark.parametrize(("value", "want"), [(12345.0, "12345"), (10000000.0, "10000000"), (1.5, "1.5")])
def test_number_text(spark, value, want):
    assert one(spark, exprs.number_text(F.lit(value))) == want


@pytest.mark.parametrize(("text", "blank"), [("   ", True), ("0", False), (None, True)])
def test_blank(spark, text, blank):
    assert one(spark, exprs.is_blank(F.lit(text))) is blank


DATES = [("2026.5.1 15:03:09", "2026-05-01"), ("2026/5/1 99:99", "2026-05-01"), ("2026-05-1", "2026-05-01"), ("2026/2/30", None), ("2026-5/1", None), ("abc", None), ("0050-01-01", None), ("", ""), ("2024/2/29", "2024-02-29")]


@pytest.mark.parametrize(("text", "want"), DATES)
def test_text_date(spark, text, want):
    assert one(spark, exprs.date_key(exprs.text_date(F.lit(text)))) == (want or "")
    assert one(spark, exprs.date_invalid(F.lit(text))) is (want is None)
    if want is None:
        with pytest.raises(ValueError, match="日期格式不正确"):
            parse_date_key(text)
    else:
        assert parse_date_key(text) == want


def test_serial_date(spark):
    assert one(spark, exprs.serial_date(F.lit(45000))) == dt.date(2023, 3, 15)
    assert one(spark, exprs.serial_date(F.lit(float("nan")))) is None
    assert parse_date_key(45000) == "2023-03-15"


@pytest.mark.parametrize(("text", "want"), [("", 0), (None, 0), (".5", 0.5), ("1,234.567", 1234.567), ("-1,234", -1234), ("+5", 5), ("5.", None), ("1e5", None), ("1,,2", None), ("12,34", None), ("1234,567", None), ("abc", None)])
def test_text_decimal(spark, text, want):
    found = one(spark, exprs.text_decimal(F.lit(text)))
    assert (None if found is None else float(found)) == want


def test_rounding_is_half_up(spark):
    assert one(spark, exprs.shown(F.lit("1.005").cast("decimal(28,10)"))) == 1.01
    assert one(spark, exprs.shown(F.lit("-1.005").cast("decimal(28,10)"))) == -1.01
    assert one(spark, exprs.shown((F.lit("0.1").cast("decimal(28,10)") + F.lit("0.2").cast("decimal(28,10)")))) == 0.3


@pytest.mark.parametrize(("texts", "want"), [(["Q1", "Q2", "Q2"], "Q1,Q2"), (["Q10", "Q20", "Q1"], "Q10,Q20,Q1"), (["Q1", ""], "Q1"), (["Q2", "Q1", "Q10", "Q1,Q2", "Q2"], "Q2,Q1,Q10,Q1,Q2"), ([], "")])
def test_append_unique(spark, texts, want):
    column = F.array(*map(F.lit, texts)) if texts else F.array().cast("array<string>")
    assert one(spark, exprs.append_unique(column, ",")) == want


def test_labels_and_notes(spark):
    assert one(spark, exprs.dept_pair(F.lit("a"), F.lit(""))) == "a"
    assert one(spark, exprs.label_of(F.lit("x"), F.lit(""), F.lit("y"))) == "x | y"
    assert one(spark, exprs.cell_safe_note(F.lit("=a\n b"))) == "'=a b"
    assert len(one(spark, exprs.cell_safe_note(F.lit("x" * 300)))) == 200
    assert one(spark, exprs.bigrams(F.lit("AbAb"))) == ["ab", "ba"]
    assert one(spark, exprs.bigrams(F.lit("a"))) == []


def test_parameters():
    assert Direction.parse("") is Direction.FORWARD
    assert Direction.parse(" ERP源单查OA ") is Direction.REVERSE
    with pytest.raises(ValueError, match="查询方向不正确"):
        Direction.parse("x")
    with pytest.raises(ValueError, match="开始日期不能晚于结束日期：2026-05-02 > 2026-05-01"):
        QueryFilters.parse(start_date="2026/5/2", end_date="2026/5/1")
    assert OutputKind.of_name("OA视角单据对比") is OutputKind.OA_COMPARE
    assert OutputKind.of_name("x") is None
    state = QueryState.parse({"company": " a ", "direction": "ERP源单查OA"}, OutputKind.OA_COMPARE)
    assert (state.filters.company, state.direction) == ("a", Direction.FORWARD)
    assert QueryState.parse(state.to_dict()) == state
