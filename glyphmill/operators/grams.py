"""Shell patterns over an index of grams: only values that hold all that a pattern asks for are tested.

A value's grams are the runs of three code points of the value between two marks, so that its begin and end count, too. A pattern's
windows are the runs of three places between its stars: each place a code point, a class, or any. A window tells which grams do: a place of a
known code point has to be it, one of a class has to be in it; so a window is the union of such grams, and a pattern the intersection of its
windows. Grams are stored sorted; windows with a known first place read a range of them. A pattern without a useful window
(`*x*`) reads all values. Whatever the windows leave is tested exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

BEGIN, END = "\x02", "\x03"
SIZE = 3


@dataclass(frozen=True)
class Place:
    """What may stand at a place of a pattern: a code point, or a class as a pattern of its own, or anything."""

    char: str | None = None
    cls: str | None = None


def places(pattern: str) -> list[list[Place]]:
    """The pattern's places between its stars, with the marks of a begin or end that is no star."""
    runs: list[list[Place]] = [[Place(BEGIN)]]
    for m in re.finditer(r"\*|\?|\[\^?\]?[^\]]*\]|.", pattern, re.S):
        t = m[0]
        if t == "*":
            runs.append([])
        elif t == "?":
            runs[-1].append(Place())
        elif len(t) > 2 and t[0] == "[":
            runs[-1].append(Place(cls=t))
        else:
            runs[-1].append(Place(t))
    runs[-1].append(Place(END))
    return runs


def windows(pattern: str) -> list[list[Place]]:
    """The windows that tell anything; marks are at the ends of a run alone."""
    found = [run[k : k + SIZE] for run in places(pattern) for k in range(len(run) - SIZE + 1)]
    return [w for w in found if any(p.char or p.cls for p in w)]


def gram_test(window: list[Place], gram: Column) -> Column:
    """Is a gram one of the window's? Known first places are a range of grams."""
    lead = "".join(p.char for p in _until_unknown(window))
    test = gram.startswith(lead) if lead else F.lit(True)
    for k, p in enumerate(window):
        c = F.substring(gram, k + 1, 1)
        if p.char and k >= len(lead):
            test = test & (c == p.char)
        elif p.cls:
            test = test & X.glob(c, p.cls)
    return test


def _until_unknown(window: list[Place]) -> list[Place]:
    out = []
    for p in window:
        if not p.char:
            break
        out.append(p)
    return out


def gram_rows(values: DataFrame, value_col: str = "value") -> DataFrame:
    """gram, value: the distinct grams of each distinct value."""
    marked = F.concat(F.lit(BEGIN), "value", F.lit(END))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(marked) - SIZE + 1, F.lit(1))), lambda k: F.substring(marked, k, F.lit(SIZE)))
    return values.select(F.col(value_col).alias("value")).where("value is not null").distinct().select(F.explode(F.array_distinct(cut)).alias("gram"), "value")


def write_grams(grams: DataFrame, folder: str) -> DataFrame:
    grams.repartitionByRange("gram", "value").sortWithinPartitions("gram", "value").write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return grams.sparkSession.read.schema(grams.schema).parquet(folder)


def candidates(index: DataFrame, pattern: str) -> DataFrame:
    """value: those that hold a gram of each of the pattern's windows; all values where it has none."""
    asked = windows(pattern)
    if not asked:
        return index.select("value").distinct()
    asked = asked[:63]  # one bit each
    tests = [gram_test(w, F.col("gram")) for w in asked]
    some = tests[0]
    for t in tests[1:]:
        some = some | t
    bits = F.lit(0).cast("long")
    for k, t in enumerate(tests):
        bits = bits.bitwiseOR(F.when(t, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    held = index.where(some).groupBy("value").agg(F.bit_or(bits).alias("held"))
    return held.where(F.col("held") == (1 << len(asked)) - 1).select("value")


def glob_values(index: DataFrame, pattern: str) -> DataFrame:
    """value: the distinct values that the pattern matches."""
    return candidates(index, pattern).where(X.glob("value", pattern))
