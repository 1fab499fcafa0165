"""Property sets as bitmaps over dense numbers, combined by bit operations.

The universe's members are numbered densely. For every value of every key, the members that have it are bits in words of 64: a row (key, value, word,
bits) for each word that has any. A condition on a key is the union of the bitmaps of the values that meet it, so equality, ranges and patterns are all
tests of distinct values, not of rows. Intersection is `and`, a complement is the word's own members without the bits. A search reads the
bitmaps once, whatever the number of its conditions, and groups by word: as many groups as the universe has members, by 64.

Members without a number (not in the universe) and null ones are in no bitmap. A universe of up to 2^38 members has words of 32 bits and less.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import cut

#: The key whose bits are all members.
EVERY = ""


def dense_numbers(members: DataFrame) -> DataFrame:
    """r, id: the distinct members of a column r, numbered from 0 without gaps. No task sees more than its part."""
    own = members.select("r").where("r is not null").distinct()
    held = cut(own.withColumns({"part": F.spark_partition_id(), "k": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    begin, rows = 0, []
    for part, n in held.groupBy("part").agg(F.count("*")).orderBy("part").collect():  # a row a partition
        rows.append((part, begin))
        begin += n
    begins = members.sparkSession.createDataFrame(rows, "part int, begin long")
    return cut(held.join(F.broadcast(begins), "part").select("r", (F.col("begin") + F.col("k")).alias("id")))


def bitmaps(numbers: DataFrame, values: Mapping[str, DataFrame]) -> DataFrame:
    """key, value (as text), word, bits of the rows (r, value) of each key, and of all members under EVERY."""
    every = numbers.select(F.lit(EVERY).alias("key"), F.lit(None).cast("string").alias("value"), "id")
    rows = [every] + [df.select("r", F.col("value").cast("string").alias("value")).join(numbers, "r").select(F.lit(k).alias("key"), "value", "id") for k, df in values.items()]
    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    return reduce(DataFrame.unionByName, rows).groupBy("key", "value", F.shiftright("id", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def write_bitmaps(maps: DataFrame, folder: str) -> DataFrame:
    """The bitmaps as a stored table in order of keys and values, so that a search opens those of its keys alone."""
    maps.repartitionByRange("key", "value", "word").sortWithinPartitions("key", "value", "word").write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return maps.sparkSession.read.schema(maps.schema).parquet(folder)


Condition = tuple[str, Callable[[Column], Column], bool]


def combine(maps: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """word, bits of the members that meet all conditions (key, test of its value, whether the complement is asked for)."""
    keys = sorted({EVERY, *(k for k, _, _ in conditions)})
    own = maps.where(F.col("key").isin(keys))
    zero = F.lit(0).cast("long")
    held = [F.bit_or(F.when((F.col("key") == k) & test(F.col("value")), F.col("bits")).otherwise(zero)).alias(f"c{i}") for i, (k, test, _) in enumerate(conditions)]
    words = own.groupBy("word").agg(F.bit_or(F.when(F.col("key") == EVERY, F.col("bits")).otherwise(zero)).alias("every"), *held)
    bits = F.col("every")
    for i, (_, _, no) in enumerate(conditions):
        bits = bits.bitwiseAND(F.bitwise_not(F.col(f"c{i}")) if no else F.col(f"c{i}"))
    return words.select("word", bits.alias("bits")).where(F.col("bits") != 0)


def members(numbers: DataFrame, found: DataFrame) -> DataFrame:
    """r of the set bits."""
    bit = F.expr("filter(transform(sequence(0, 63), k -> if((shiftright(bits, k) & 1L) = 1L, k, null)), k -> k is not null)")
    ids = found.select("word", F.explode(bit).alias("k"))
    return numbers.join(ids.select((F.shiftleft("word", 6) + F.col("k")).alias("id")), "id").select("r")


def count(found: DataFrame) -> DataFrame:
    """n: how many members there are, without naming them."""
    return found.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("n"))
