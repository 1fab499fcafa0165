"""Tables stored in key ranges: pages by rank, and rebuilds that write only what changed.

A store is a folder of Parquet files, a folder for each version, and a manifest of one row for each range: its bounds, rows, version, a digest of
its rows, and where they begin. Files hold many ranges, sorted; a stored row has a place (`_at`), and a range is a run of places, so the files' own
bounds find it. Ranges are set when the store is built and hold about RANGE_ROWS rows each, so the manifest is as small as the table's rows over
RANGE_ROWS; it is the only part that the driver reads.

Rank n is in the range where the counts of all ranges before reach n, so a page opens that range alone (and the next, if it ends there). An
update deals new rows to the ranges, compares digests, and writes a new version of the ranges that differ, and of no others; readers of older versions
keep their files. The digest of a range is made of sums of its rows' hashes, so rows are summed in parts and in any order.

Rows with a null key come first, as Spark sorts them. The key may be several columns. Equal keys are in one range.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

RANGE_ROWS = 1_000_000


@dataclass(frozen=True)
class RangeStore:
    """A stored table. key: its columns; manifest: (range, lo, rows, digest, version, first, file), lo the first key of the range as a struct, file the
    one of its version that holds it, first its first place there; number: the store's version."""

    spark: SparkSession
    folder: str
    key: tuple[str, ...]
    number: int

    @property
    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/manifest-{self.number}")

    def entries(self) -> list:
        return self.manifest.orderBy("range").collect()

    def read(self, ranges: Sequence | None = None) -> DataFrame:
        """The rows, or those of some of the manifest's entries. Only these ranges' files are opened, and of them the parts that may hold the ranges."""
        every = self.entries() if ranges is None else ranges
        some = [e for e in every if e.rows]
        schema = self.spark.read.parquet(f"{self.folder}/schema").schema
        out = self.spark.createDataFrame([], schema)
        for version in sorted({e.version for e in some}):
            own = [e for e in some if e.version == version]
            files = sorted({f"{_version(self.folder, version)}/{e.file}" for e in own})
            rows = self.spark.read.schema(StructType([*schema.fields, StructField("_at", LongType())])).parquet(*files)
            if ranges is None and len(own) == len(some) and version == 0:
                return rows.drop("_at")
            out = out.unionByName(_within(rows, own).drop("_at"))
        return out

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows offset to offset + limit in order of the key. Opens the ranges that hold them."""
        before, some, skip = 0, [], 0
        for e in self.entries():
            if before + e.rows > offset and before < offset + limit:
                skip = skip if some else offset - before
                some.append(e)
            before += e.rows
        return self.read(some).orderBy(*self.key).offset(skip).limit(limit)


def _version(folder: str, version: int) -> str:
    return f"{folder}/rows/version={version}"


#: Runs of places that are named in a filter; more are joined.
_NAMED = 100


def _within(rows: DataFrame, entries: Sequence) -> DataFrame:
    """Stored rows of some ranges of one version."""
    runs = sorted((e.first, e.first + e.rows) for e in entries)
    merged = [list(runs[0])]
    for a, b in runs[1:]:
        if a == merged[-1][1]:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    rows = rows.where((F.col("_at") >= runs[0][0]) & (F.col("_at") < runs[-1][1]))
    if len(merged) <= _NAMED:
        test = F.lit(False)
        for a, b in merged:
            test = test | ((F.col("_at") >= a) & (F.col("_at") < b))
        return rows.where(test)
    # a run is in the blocks of places that it touches: two, or fewer
    block = max(b - a for a, b in runs)
    blocks = rows.sparkSession.createDataFrame([(k, a, b) for a, b in runs for k in range(a // block, (b - 1) // block + 1)], "_block long, _a long, _b long")
    found = rows.withColumn("_block", F.call_function("div", F.col("_at"), F.lit(block))).join(F.broadcast(blocks), "_block")
    return found.where("_at >= _a and _at < _b").drop("_block", "_a", "_b")


def _summed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """range, rows, digest: the sums of two 64-bit hashes of each row."""
    hashes = [F.sum(F.xxhash64(F.lit(k), *(F.col(f"`{c}`") for c in columns)).cast("decimal(20,0)")).cast("string").alias(f"d{k}") for k in (1, 2)]
    return rows.groupBy("_range").agg(F.count("*").alias("rows"), *hashes).select(F.col("_range").alias("range"), "rows", F.concat_ws("/", "d1", "d2").alias("digest"))


def _dealt(rows: DataFrame, key: Sequence[str], bounds: Sequence) -> DataFrame:
    """Rows with their range: the number of bounds (first keys of all ranges but the first) that aren't over their key."""
    own = F.struct(*key)
    kind = rows.select(own.alias("k")).schema["k"].dataType
    if not bounds:
        return rows.withColumn("_range", F.lit(0))
    # the bounds are one value, read once; a row finds its range by bisection
    table = rows.sparkSession.createDataFrame([(list(bounds),)], f"bounds array<{kind.simpleString()}>")
    steps = max(1, len(bounds).bit_length())
    at = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    mid = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    def halve(s: Column, _: Column) -> Column:
        over = F.get(F.col("bounds"), mid(s)) > own
        return F.when(s["lo"] >= s["hi"], s).when(over, F.struct(s["lo"].alias("lo"), mid(s).alias("hi"))).otherwise(F.struct((mid(s) + 1).alias("lo"), s["hi"].alias("hi")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps + 1)), at, halve)["lo"]
    return rows.withColumn("bounds", table.scalar()).withColumn("_range", found).drop("bounds")


def _write(rows: DataFrame, folder: str, version: int) -> DataFrame:
    """Sorted partitions as files, each row with its place: the partition and the number in it."""
    rows.withColumn("_at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(_version(folder, version))
    return rows.sparkSession.read.parquet(_version(folder, version))


def build_ranges(rows: DataFrame, key: Sequence[str], folder: str, range_rows: int = RANGE_ROWS) -> RangeStore:
    """A new store. The rows are sorted and written once; then a range begins at each partition's begin and every `range_rows` rows, or
    where the key found there begins."""
    spark, own = rows.sparkSession, F.struct(*key).alias("k")
    rows.limit(0).write.mode("overwrite").parquet(f"{folder}/schema")
    kept = _write(rows.repartitionByRange(*key).sortWithinPartitions(*key), folder, 0)
    in_part = F.col("_at").bitwiseAND((1 << 33) - 1)
    cell = (F.col("_at") - in_part % range_rows).alias("_cell")
    ends = kept.where((in_part % range_rows).isin(0, range_rows - 1)).select("_at", own, (in_part % range_rows == 0).alias("begins"), (in_part == 0).alias("front"), F.col("_metadata.file_name").alias("file")).collect()
    ends.sort(key=lambda r: r["_at"])
    # a key that goes on over a mark begins before it: the range does, too
    last = {r["_at"] + 1: r.k for r in ends}
    marks = [r for r in ends if r.begins]
    tied = {r.k for r in marks if not r.front and last.get(r["_at"]) == r.k}
    begin = {}
    if tied:
        many = spark.createDataFrame([(tuple(k),) for k in tied], f"k {kept.select(own).schema['k'].dataType.simpleString()}")
        same = kept.select("_at", own).join(F.broadcast(many.toDF("tied")), F.col("k").eqNullSafe(F.col("tied")))
        begin = {r.k: r.first for r in same.groupBy("k").agg(F.min("_at").alias("first")).collect()}
    bounds, firsts, dealt = [], [], []
    for r in marks:
        if not bounds or bounds[-1] != r.k:
            bounds.append(r.k)
            firsts.append((begin.get(r.k, r["_at"]), r.file))
            if dealt and firsts[-1][0] < r["_at"]:  # from there on, the cell before is of this range
                dealt[-1] = (*dealt[-1][:2], firsts[-1][0])
        dealt.append((r["_at"], len(bounds) - 1, None))
    cells = spark.createDataFrame(dealt, "_cell long, _range int, _next long")
    found = kept.withColumn("_cell", cell).join(F.broadcast(cells), "_cell").withColumn("_range", F.when(F.col("_at") >= F.col("_next"), F.col("_range") + 1).otherwise(F.col("_range")))
    summed = {r.range: (r.rows, r.digest) for r in _summed(found, rows.columns).collect()}
    return _record(spark, folder, key, 0, bounds[1:], summed, dict(enumerate(firsts)), {})


def _record(spark: SparkSession, folder: str, key: Sequence[str], number: int, bounds: Sequence, summed: dict, firsts: dict, older: dict) -> RangeStore:
    kind = spark.read.parquet(f"{folder}/schema").select(F.struct(*key).alias("k")).schema["k"].dataType.simpleString()
    entries = []
    for k in range(len(bounds) + 1):
        n, digest = summed.get(k, (0, ""))
        same = k in older and (older[k].rows, older[k].digest) == (n, digest)
        entries.append((k, bounds[k - 1] if k else None, n, digest, older[k].version if same else number, *((older[k].first, older[k].file) if same else firsts.get(k, (0, "")))))
    made = spark.createDataFrame(entries, f"range int, lo {kind}, rows long, digest string, version int, first long, file string")
    made.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest-{number}")
    return RangeStore(spark, folder, tuple(key), number)


def update_ranges(store: RangeStore, rows: DataFrame) -> tuple[RangeStore, list[int]]:
    """The store with the table's new rows, and the ranges written: those alone that differ."""
    older = {e.range: e for e in store.entries()}
    bounds = [older[k].lo for k in sorted(older) if k]
    rows = rows.select(*store.spark.read.parquet(f"{store.folder}/schema").columns)
    dealt = _dealt(rows, store.key, bounds)
    summed = {r.range: (r.rows, r.digest) for r in _summed(dealt, rows.columns).collect()}
    changed = [k for k, e in older.items() if (e.rows, e.digest) != summed.get(k, (0, ""))]
    if not changed:
        return store, []
    number = store.number + 1
    kept = _write(dealt.where(F.col("_range").isin(changed)).repartition("_range").sortWithinPartitions("_range", *store.key), store.folder, number)
    firsts = {r["_range"]: (r.first, r.file) for r in kept.groupBy("_range").agg(F.min("_at").alias("first"), F.min("_metadata.file_name").alias("file")).collect()}
    return _record(store.spark, store.folder, store.key, number, bounds, summed, firsts, older), sorted(changed)
