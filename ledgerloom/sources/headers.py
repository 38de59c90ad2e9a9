"""Find the header row of a raw sheet and name its columns. Works on the first rows only, on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from ..functions.values import plain_text

SCAN_ROWS, LEAST_HITS = 20, 5

# Texts of header errors.
NOT_FOUND, AMBIGUOUS, REPEATED = "无法识别表头", "表头识别不唯一", "关键列重复"
_SCANNED = "已扫描 UsedRange 前 {n} 行"
NOT_FOUND_TEXT = NOT_FOUND + "：" + _SCANNED + "，最多命中 {hits} 个必需字段。{where}{lacking}"
AMBIGUOUS_TEXT = AMBIGUOUS + "：" + _SCANNED + "，多个候选行最多命中 {hits} 个必需字段。{where}{lacking}"
REPEATED_TEXT = REPEATED + "：{where}{repeats}请删除或重命名重复列后重试。"


class HeaderDetectionError(ValueError):
    """No usable header row, with what a report needs."""

    def __init__(self, issue_type: str, message: str, row_label: str, hits: int, required: int, missing: list[str], duplicates: list[str]):
        super().__init__(message)
        self.issue_type, self.row_label, self.hits, self.required, self.missing, self.duplicates = issue_type, row_label, hits, required, missing, duplicates


@dataclass(frozen=True)
class Header:
    """A found header: its row (from 0), the trimmed texts of its cells, and where required ones stand."""

    row: int
    row_label: str
    cells: tuple[str, ...]
    index: dict[str, int]

    def missing(self, required: Sequence[str]) -> list[str]:
        return [h for h in required if h not in self.index]


def row_label(index: int, first_row: int | None) -> str:
    """The sheet's row number, or its place in the range where the range's origin is unknown."""
    return str(first_row + index) if first_row is not None else f"相对 UsedRange 第 {index + 1} 行"


def detect_header(rows: Sequence[Sequence[object]], required: Sequence[str], *, least: int = LEAST_HITS, scan: int = SCAN_ROWS, first_row: int | None = None) -> Header:
    """The row with most required headers, then fewest repeats of them, then most filled cells.

    Rows that tie are fine only if they hold every required header: then the first one counts.
    """
    wanted = set(required)
    ranked = []
    for i, row in enumerate(rows[:scan]):
        cells = tuple(plain_text(c) for c in row)
        hits = [c for c in cells if c in wanted]
        ranked.append(((-len(set(hits)), len(hits) - len(set(hits)), -sum(map(bool, cells))), i, cells))
    ranked.sort(key=lambda r: r[:2])

    def fail(kind: str, text: str) -> HeaderDetectionError:
        _, i, cells = ranked[0] if ranked else (None, 0, ())
        missing = [h for h in required if h not in cells]
        repeats = list(dict.fromkeys(c for k, c in enumerate(cells) if c in wanted and c in cells[:k]))
        label = row_label(i, first_row) if ranked else row_label(0, None)
        where = f"候选行：{f'第 {label} 行' if first_row is not None and ranked else label}。"
        lacking = f"缺失字段：{'、'.join(missing)}。" if missing else ""
        hits = len(wanted & set(cells))
        parts = {"n": min(scan, len(rows)), "hits": f"{hits}/{len(required)}", "where": where, "lacking": lacking, "repeats": f"重复必需字段：{'、'.join(repeats)}。" if repeats else ""}
        return HeaderDetectionError(kind, text.format(**parts), label, hits, len(required), missing, repeats)

    if not ranked or -ranked[0][0][0] < least:
        raise fail(NOT_FOUND, NOT_FOUND_TEXT)
    rank, i, cells = ranked[0]
    if sum(r[0] == rank for r in ranked) > 1 and -rank[0] < len(required):
        raise fail(AMBIGUOUS, AMBIGUOUS_TEXT)
    if rank[1]:
        raise fail(REPEATED, REPEATED_TEXT)
    return Header(i, row_label(i, first_row), cells, {h: cells.index(h) for h in required if h in cells})
