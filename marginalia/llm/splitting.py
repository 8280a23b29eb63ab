"""Cutting oversized texts into pieces at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1200
OVERLAP = 120

#: Where a text may be cut, strongest first: behind blank lines, line ends, sentence ends, and at blanks.
_BOUNDARIES = [
    re.compile(rb"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)[ \t\r\n]*"),
    re.compile(rb"(?:\r\n|\r|\n)"),
    re.compile(rb"(?:[.!?]|\xe2\x80\xa6)(?:[\"')\]]|\xc2\xbb|\xe2\x80[\x99\x9d])*[ \t]+|\xe3\x80\x82|\xef\xbc[\x81\x9f]"),
]
_BLANKS = re.compile(rb"[ \t\r\n]+")


def _cuts(data: bytes) -> list[list[int]]:
    """Positions at which ``data`` may be cut, by strength."""
    found = [sorted({m.end() for m in b.finditer(data)}) for b in _BOUNDARIES]
    found.append(sorted({p for m in _BLANKS.finditer(data) for p in (*range(m.start(), m.end(), 64), m.end())}))  # long blanks are cut inside as well
    return found


def longest_run(data: bytes) -> int:
    """Bytes of the longest run without space, tab, carriage return or line feed."""
    at = longest = 0
    for m in _BLANKS.finditer(data):
        longest, at = max(longest, m.start() - at), m.end()
    return max(longest, len(data) - at)


def _whole(data: bytes, at: int, low: int) -> int:
    """The start of the character that holds byte ``at``, if that lies behind ``low``."""
    p = at
    while p > low and p < len(data) and data[p] & 0xC0 == 0x80:
        p -= 1
    return p if p > low else at


def split_spans(data: bytes, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """Pieces ``(start, end, repeated, hard)`` of UTF-8 text, whose spans follow each other and cover it.

    Recursive bisection: a span longer than ``limit - overlap`` is cut at the
    strongest boundary in the middle half (of equals, the one nearest the
    midpoint), or else at the boundary nearest the midpoint anywhere in it. A span
    without any boundary stays whole up to ``limit`` and is otherwise cut between
    characters (``hard``). A piece then repeats up to ``overlap`` bytes before its
    start (``repeated``), from a boundary where there is one, and is never longer than ``limit``.
    """
    if limit - overlap < 8 or overlap < 0:
        raise ValueError("the limit must exceed the overlap by 8 bytes at least")
    cuts, room = _cuts(data), limit - overlap
    leaves: list[tuple[int, int, int]] = []
    todo = [(0, len(data), 0)]

    def nearest(points: list[int], low: int, high: int, mid: int) -> int | None:
        i = bisect_left(points, mid)
        near = [p for p in points[max(0, i - 1) : i + 1] if low < p < high]
        return min(near, key=lambda p: abs(p - mid)) if near else None

    while todo:
        s, e, hard = todo.pop()
        if e - s <= room:
            leaves.append((s, e, hard))
            continue
        mid, quarter = (s + e) // 2, (e - s) // 4
        at = next((p for c in cuts if (p := nearest(c, mid - quarter, mid + quarter, mid)) is not None), None)
        if at is None:
            at = next((p for c in cuts[-1:] + cuts[:-1] if (p := nearest(c, s, e, mid)) is not None), None)
        if at is None:
            if e - s <= limit:
                leaves.append((s, e, hard))
                continue
            at, hard = _whole(data, mid, s), 1
            todo += [(at, e, 1), (s, at, 1)]
            continue
        todo += [(at, e, 0), (s, at, 0)]
    out, prev = [], None
    for s, e, hard in leaves:
        repeated = 0
        if prev is not None and overlap:
            low = max(prev, s - min(overlap, limit - (e - s)))
            i = bisect_left(cuts[-1], low)
            at = cuts[-1][i] if i < bisect_right(cuts[-1], s - 1) else _ceil(data, low, s)
            repeated = s - at
        out.append((s, e, repeated, hard))
        prev = s
    return out


def _ceil(data: bytes, at: int, high: int) -> int:
    """The first start of a character at or behind byte ``at``."""
    while at < high and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for kind, ident, text in zip(b.item_kind, b.item_id, b.content):
                data = text.encode("utf-8", "replace")
                run = longest_run(data)
                for n, (s, e, rep, hard) in enumerate(split_spans(data, limit, overlap)):
                    rows.append((kind, ident, n, s, e, rep, hard, run, data[s - rep : e].decode("utf-8", "replace")))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows = []
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return run


_COLUMNS = ["item_kind", "item_id", "piece_no", "start_byte", "end_byte", "repeated_bytes", "hard", "longest_run", "content"]


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of the items ``(item_kind, item_id, content)`` with more than ``limit`` UTF-8 bytes.

    Columns: kind and id, ``piece_no`` from 0, the piece's own span ``start_byte``,
    ``end_byte`` (the spans of an item follow each other and cover it),
    ``repeated_bytes`` that the content has in front of the span, ``hard`` (1: the
    span is a part of a run longer than the limit that has no boundary at all),
    ``longest_run``, the bytes of the item's longest run without blanks, ``content``.
    Items within the limit and null contents yield nothing; repeated rows yield
    repeated pieces. Each text is cut by itself: no shuffle.
    """
    big = items.select("item_kind", "item_id", "content").where(F.octet_length("content") > limit)
    return big.mapInPandas(
        _pieces(limit, overlap),
        "item_kind string, item_id string, piece_no int, start_byte bigint, end_byte bigint, repeated_bytes int, hard int, longest_run bigint, content string",
    )
