"""Matches of a pattern with their offsets in code points, from built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once. A lambda's body is evaluated anew for each element otherwise."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, pattern: str, groups: int = 0, most: int = 1_000) -> Column:
    """The first `most` matches as array<struct<start, end, value>>, null without any.

    With groups, one of that many alternative groups holds the value, the last
    of them bare and the others in quotes at the match's end. The text between
    matches (split by the same pattern) and the matches give all offsets.
    """
    p = F.lit(pattern)
    every = F.regexp_extract_all(text, p, F.lit(0))
    # Offsets run on over the matches: where the last one ended, and what was found.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,i:int>>").alias("out"))

    def places(s: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            a = acc["at"] + F.length(F.get(s["gaps"], i))
            b = a + F.length(F.get(s["found"], i))
            return F.struct(b.alias("at"), F.array_append(acc["out"], F.struct(a.alias("start"), b.alias("end"), i.alias("i"))).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(s["found"]) - 1), start, add)["out"]

    def plain(s: Column) -> Column:
        return F.transform(places(s), lambda x: F.struct(x["start"], x["end"], F.get(s["found"], x["i"]).alias("value")))

    def grouped(s: Column) -> Column:
        def value(x: Column) -> Column:
            parts = [F.get(s[f"v{k}"], x["i"]) for k in range(1, groups + 1)]
            bare = parts[-1] != ""
            last = F.when(bare, x["end"]).otherwise(x["end"] - 1)
            whole = F.concat(*parts)  # all but one are empty
            return F.struct((last - F.length(whole)).alias("start"), last.alias("end"), whole.alias("value"), bare.alias("bare"), F.get(s["found"], x["i"]).alias("whole"))

        return F.transform(places(s), value)

    def located(found: Column) -> Column:
        fields = [F.slice(found, 1, most).alias("found"), F.split(text, pattern, -1).alias("gaps")]
        fields += [F.regexp_extract_all(text, p, F.lit(k)).alias(f"v{k}") for k in range(1, groups + 1)]
        return F.when(F.size(found) > 0, let(F.struct(*fields), grouped if groups else plain))

    return let(every, located)


def line_of(text: Column, start: Column) -> Column:
    """Line of an offset, from 1: newlines before it, and one."""
    before = F.substring(text, F.lit(1), start)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, start: Column) -> Column:
    """Column of an offset, from 1, in code points."""
    before = F.substring(text, F.lit(1), start)
    return F.length(F.substring_index(before, "\n", -1)) + 1
