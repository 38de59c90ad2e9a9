"""Values given by the caller, parsed on the driver by the rules that columns follow."""

from __future__ import annotations

import datetime as dt
import math
import re
from decimal import Decimal

#: White space that text is trimmed of: Unicode spaces, line ends and the byte-order mark (fixed values).
SPACE = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

_DATE = re.compile(r"([0-9]{4})([/.-])([0-9]{1,2})\2([0-9]{1,2})(?:\s+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?")


def plain_text(value: object) -> str:
    """Trimmed text; None is empty and whole floats lose their fraction."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return str(value).strip(SPACE)


def parse_date_key(value: object) -> str:
    """``YYYY-MM-DD`` of a date, a serial day number or a text; blank gives an empty string."""
    if isinstance(value, dt.datetime | dt.date):
        return f"{value:%Y-%m-%d}"
    if isinstance(value, int | float | Decimal) and not isinstance(value, bool):
        if not math.isfinite(value):
            raise ValueError(f"日期格式不正确：{value}")
        return str(dt.date(1899, 12, 30) + dt.timedelta(days=math.floor(value)))
    text = plain_text(value)
    if not text:
        return ""
    found = _DATE.fullmatch(text)
    try:
        day = dt.date(int(found[1]), int(found[3]), int(found[4])) if found else None
    except ValueError:
        day = None
    if day is None or day.year < 100:
        raise ValueError(f"日期格式不正确：{value}")
    return str(day)
