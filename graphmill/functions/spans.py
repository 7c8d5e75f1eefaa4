"""Byte spans and locations as column expressions. A span is a half-open [start, end) in bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def sized(start: Column, size: Column) -> Column:
    return span(start, start + size)


def length(s: Column) -> Column:
    return s["end"] - s["start"]


def contains(s: Column, point: Column) -> Column:
    return (point >= s["start"]) & (point < s["end"])


def shift_right(s: Column, by: Column) -> Column:
    return span(s["start"] + by, s["end"] + by)


def shift_left(s: Column, by: Column) -> Column:
    return span(s["start"] - by, s["end"] - by)


def same(a: Column, b: Column) -> Column:
    return (a["start"] == b["start"]) & (a["end"] == b["end"])


def snippet(text: Column, s: Column) -> Column:
    """The bytes of a text within a span, as binary (a span may cut a character)."""
    return F.substring(F.encode(text, "UTF-8"), s["start"] + 1, s["end"] - s["start"])


def labeled(s: Column, label: Column | None = None, primary: bool = False) -> Column:
    """A span with an optional label, and whether it is the main one of a message."""
    return F.struct(s.alias("span"), (F.lit(None).cast("string") if label is None else label).alias("label"), F.lit(primary).alias("primary"))


def location(line: Column, column: Column, source_line: Column) -> Column:
    """A place in a text: line and column from 1, and the text of the line."""
    return F.struct(line.alias("line"), column.alias("column"), source_line.alias("source_line"))


def location_json(place: Column) -> Column:
    """Line and column of a place as a JSON object; the text of the line stays out."""
    return F.to_json(F.struct(place["line"].alias("line"), place["column"].alias("column")))
