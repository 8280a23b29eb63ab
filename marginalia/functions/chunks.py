"""Cutting texts into chunks for storing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _together(parts: list[str], glue: str, most: int) -> Iterator[str]:
    held: list[str] = []
    size = 0
    for p in parts:
        n = len(p.encode()) + (len(glue) if held else 0)
        if held and size + n > most:
            yield glue.join(held)
            held, size, n = [], 0, len(p.encode())
        held.append(p)
        size += n
    if held:
        yield glue.join(held)


def _windows(line: str, most: int, overlap: int) -> Iterator[str]:
    b, start = line.encode(), 0
    inside = lambda i: i < len(b) and b[i] & 0xC0 == 0x80
    while True:
        stop = min(start + most, len(b))
        while inside(stop):
            stop -= 1
        yield b[start:stop].decode()
        if stop == len(b):
            return
        start = stop - overlap
        while inside(start):
            start += 1


def chunks_of(text: str | None, most: int = 1200) -> list[str]:
    """Paragraphs joined up to ``most`` bytes; larger ones by lines likewise; larger lines as windows that overlap.

    The overlap is a tenth of 1,200 bytes or a fifth of ``most`` (16 or more), whichever is less, and
    no character is cut. A null, empty or blank text has no chunks.
    """
    assert most >= 16
    overlap, out = min(120, most // 5), []
    big = lambda p: len(p.encode()) > most
    parts = [p for p in map(str.strip, re.split(r"\n{2,}", (text or "").replace("\r\n", "\n"))) if p]
    for large, run in groupby(parts, big):
        if not large:
            out += _together(list(run), "\n\n", most)
            continue
        for paragraph in run:
            lines = [x for x in map(str.strip, paragraph.split("\n")) if x]
            for wide, few in groupby(lines, big):
                out += [w for x in few for w in _windows(x, most, overlap)] if wide else _together(list(few), "\n", most)
    return out


def chunked(c: Column, most: int = 1200) -> Column:
    """The chunks of a text, in order: ``array<string>``; see ``chunks_of``. Whole texts, a batch at a time."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks_of(t if isinstance(t, str) else None, most))

    return cut(c)
