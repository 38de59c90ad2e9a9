"""Column expressions: text, dates, decimals, ordered-unique lists. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import SPACE

# Fixed value: the class of characters that text is trimmed of.
_SPACES = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# Shapes of dates and numbers.
_DATE = r"\A(\d{4})([/.-])(\d{1,2})\2(\d{1,2})(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?\z"
_NUMBER = r"\A[-+]?(?:\d+|\d*\.\d+)\z|\A[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?\z"

DECIMAL = "decimal(28,10)"


def norm_text(c: Column) -> Column:
    """Text without white space at its ends; null is empty."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")), F.lit(SPACE))


def number_text(c: Column) -> Column:
    """Text of a numeric cell: whole numbers without a fraction or exponent."""
    value = c.cast("double")
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))


def is_blank(c: Column) -> Column:
    return norm_text(c) == ""


def trimmed_date(t: Column) -> Column:
    """Date of a text without white space at its ends; null if it is blank or malformed."""
    parts = F.regexp_replace(t, _DATE, "$1-$3-$4")
    return F.when(t.rlike(_DATE) & (t >= "0100"), F.try_to_timestamp(parts, F.lit("yyyy-M-d")).cast("date"))


def text_date(c: Column) -> Column:
    """Date of a text cell; null if it is blank or malformed."""
    return trimmed_date(norm_text(c))


def serial_date(c: Column) -> Column:
    """Date of a sheet's day number, its time dropped; null if it isn't finite."""
    value = c.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < 3e6), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(value).cast("int")))


def date_invalid(c: Column) -> Column:
    """A text cell that is not blank and no date."""
    return ~is_blank(c) & text_date(c).isNull()


def trimmed_decimal(t: Column) -> Column:
    """Number of a text without white space at its ends, blank as zero, null if malformed. A leading plus sign is accepted."""
    return F.when(t == "", F.lit(0).cast(DECIMAL)).when(t.rlike(_NUMBER), F.translate(t, ",+", "").try_cast(DECIMAL))


def text_decimal(c: Column) -> Column:
    """Number of a text cell, blank as zero, null if malformed."""
    return trimmed_decimal(norm_text(c))


def decimal_invalid(c: Column) -> Column:
    return text_decimal(c).isNull()


def date_key(c: Column) -> Column:
    """``YYYY-MM-DD`` of a date, empty for null."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))


def round2(c: Column) -> Column:
    """Half-up to two places, still a decimal; null is zero."""
    return F.round(F.coalesce(c, F.lit(0).cast(DECIMAL)), 2)


def shown(c: Column) -> Column:
    """The number that outputs show."""
    return round2(c).cast("double")


def first_text(c: str | Column, order: Column) -> Column:
    """Aggregate: the text of the first row, blank or not."""
    return F.min_by(c, order)


def append_unique(texts: Column, delimiter: str) -> Column:
    """Texts of an ordered array joined, each only if the text so far doesn't hold it between delimiters.

    Equal to joining distinct texts unless a text contains the delimiter.
    """
    edge = F.lit(delimiter)

    def add(done: Column, t: Column) -> Column:
        within = F.contains(F.concat(edge, done, edge), F.concat(edge, t, edge))
        return F.when((t == "") | within, done).when(done == "", t).otherwise(F.concat(done, edge, t))

    return F.aggregate(texts, F.lit("").cast("string"), add)


def in_order(pairs: Column) -> Column:
    """Texts of an array of (order, text) structs, by order."""
    return F.transform(F.array_sort(pairs), lambda p: p["t"])


def unique_text(c: str, order: Column, delimiter: str) -> Column:
    """Aggregate: distinct texts that aren't blank, in order of first sight, joined."""
    return append_unique(in_order(F.collect_list(F.when(F.col(c) != "", F.struct(order.alias("o"), F.col(c).alias("t"))))), delimiter)


def by_priority(types: Column, priority: tuple[str, ...], delimiter: str = "、") -> Column:
    """The members of a set of texts in a fixed order, joined."""
    return F.array_join(F.filter(F.array(*map(F.lit, priority)), lambda t: F.array_contains(types, t)), delimiter)


def dept_pair(dept1: Column, dept2: Column) -> Column:
    return F.concat_ws("/", F.nullif(dept1, F.lit("")), F.nullif(dept2, F.lit("")))


def label_of(*parts: Column) -> Column:
    return F.concat_ws(" | ", *(F.nullif(p, F.lit("")) for p in parts))


def bigrams(c: Column) -> Column:
    """Distinct two-character substrings of the text in lower case."""
    t = F.lower(c)
    return F.when(F.length(t) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(2)))))


def cell_safe_note(c: Column, most: int = 200) -> Column:
    """A note for a sheet cell: runs of white space as one space, formula starts quoted, cut at ``most`` characters."""
    t = F.trim(F.regexp_replace(c, rf"{_SPACES}+", " "))
    t = F.when(t.rlike(r"\A[=+\-@]"), F.concat(F.lit("'"), t)).otherwise(t)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 3), F.lit("...")))
