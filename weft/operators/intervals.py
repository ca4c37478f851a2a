"""Joins of places and ranges of whole numbers from 0 on, by power-of-two bins.

A range is the union of at most two bins of each size, and a place lies in one bin of each size, so ranges around a place are found by an equi-join on (size,
bin): rows grow with the logarithm of the largest place and with what is found, never with all pairs of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 40


def place_bins(place: Column) -> Column:
    """The bins (level, bin) that a place lies in."""
    one = place.cast("bigint") + 1  # from 1 on, so that no bin of a range is number 0
    levels = F.sequence(F.lit(0), F.length(F.bin(one)) - 1)
    return F.transform(levels, lambda k: F.struct(k.alias("level"), F.call_function("shiftright", one, k).alias("bin")))


def range_bins(start: Column, end: Column) -> Column:
    """The bins (level, bin) that make up a range, start and end included; none where the end comes first."""
    first, behind = start.cast("bigint") + 1, end.cast("bigint") + 2

    def at(level: Column) -> Column:
        lo = F.call_function("shiftright", first + F.call_function("shiftleft", F.lit(1).cast("bigint"), level) - 1, level)
        hi = F.call_function("shiftright", behind, level)
        some = lo < hi
        left = F.when(some & (lo % 2 == 1), F.struct(level.alias("level"), lo.alias("bin")))
        right = F.when(some & (hi % 2 == 1), F.struct(level.alias("level"), (hi - 1).alias("bin")))
        return F.array(left, right)

    levels = F.sequence(F.lit(0), F.length(F.bin(behind)))
    return F.when(start <= end, F.array_compact(F.flatten(F.transform(levels, at)))).otherwise(F.array().cast("array<struct<level:int,bin:bigint>>"))


def stabbed(places: DataFrame, ranges: DataFrame, key: list[str], place: str, start: str = "start", end: str = "end") -> DataFrame:
    """All columns of ``places`` and ``ranges`` (other than ``key`` different by name) for each range of the same key that a place lies in. Nulls lie nowhere."""
    binned = ranges.where(F.col(start) >= 0).select("*", F.explode(range_bins(F.col(start), F.col(end))).alias("_bin"))
    at = places.where(F.col(place) >= 0).select("*", F.explode(place_bins(F.col(place))).alias("_bin"))
    return at.join(binned, [*key, "_bin"]).drop("_bin")


def nested_either_way(a: DataFrame, b: DataFrame, key: list[str], a_range: tuple[str, str], b_range: tuple[str, str]) -> DataFrame:
    """Pairs of ranges of a key one of which lies within the other: the first of ``a`` lies in one of ``b``, or the other way round."""
    (a0, a1), (b0, b1) = a_range, b_range
    a, b = a.where(F.col(a0) <= F.col(a1)), b.where(F.col(b0) <= F.col(b1))
    inside = stabbed(a, b, key, a0, b0, b1).where((F.col(b0) <= F.col(a0)) & (F.col(a1) <= F.col(b1)))
    around = stabbed(b, a, key, b0, a0, a1).where((F.col(a0) <= F.col(b0)) & (F.col(b1) <= F.col(a1)) & ~((F.col(a0) == F.col(b0)) & (F.col(a1) == F.col(b1))))
    return inside.unionByName(around)
