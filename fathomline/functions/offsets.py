"""Positions in texts as Columns: running sums, and the pieces between boundaries with where they stand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block of running sums.
BLOCK = 256


def running(values: Column) -> Column:
    """The running sums of an array of numbers, by blocks, so that a long array costs little more than its length.

    values is read several times: give a column, not a long expression.
    """

    def sums(a: Column, first: Column) -> Column:
        zero = F.struct(first.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(a, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["all"], F.array(s["at"] + x)).alias("all")), lambda s: s["all"])

    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(values)), F.lit(BLOCK)), lambda s: F.slice(values, s, BLOCK))
    total = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + x))
    return F.flatten(F.zip_with(blocks, F.zip_with(sums(total, F.lit(0)), total, lambda s, x: s - x), sums))


def measured(text: Column, boundary: str) -> Column:
    """A text cut at boundaries: {piece, step}, step the characters of the piece and of the boundary after it."""
    return F.zip_with(F.split(text, boundary, -1), F.regexp_extract_all(text, F.lit(boundary), F.lit(0)), lambda p, b: F.struct(p.alias("piece"), (F.char_length(p) + F.coalesce(F.char_length(b), F.lit(0))).alias("step")))


def placed(pieces: Column, ends: Column) -> Column:
    """Measured pieces and the running sums of their steps as {start, end, text}: outer white space off, blank ones dropped."""

    def place(p: Column, e: Column) -> Column:
        start = e - p["step"] + F.char_length(F.regexp_extract(p["piece"], r"(?U)^\s*", 0))
        body = F.regexp_replace(p["piece"], r"(?U)^\s+|\s+$", "")
        return F.struct(start.alias("start"), (start + F.char_length(body)).alias("end"), body.alias("text"))

    return F.filter(F.zip_with(pieces, ends, place), lambda x: x["text"] != "")
