"""What the operators share: shared-folder tables, byte-level words and 64-bit hashes in numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D. All of those bytes are ASCII, so
splitting UTF-8 bytes gives the same words as splitting code points.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text worked on at once in a Python task; one longer text makes a piece of its own.
PIECE_BYTES = 4 << 20
#: So many tasks can work on small tables, too.
LEAST_SHARES = 16

_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


# ---------------------------------------------------------------- tables in the shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master may do without, and has a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_roots: list[str] = []
_tables: list[str] = []


class Scratch:
    """Tables written once to the shared folder, so that losing an executor costs no lineage. They stay
    there, since results read them, until clear_scratch is called."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/glyphmill-{uuid.uuid4().hex}"
        _roots.append(self.root)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def put_bucketed(self, df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
        """As put; what is grouped by the key afterwards needs no exchange of this table."""
        table = f"glyphmill_{uuid.uuid4().hex}"
        _tables.append(table)
        written = df.repartition(parts, key).write.bucketBy(parts, key).option("compression", "zstd").option("path", f"{self.root}/{name}")
        written.format("parquet").mode("overwrite").saveAsTable(table)
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that operators have written for themselves, once their results are saved."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _roots:
        _delete(spark, _roots.pop())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shares(docs: DataFrame, text_col: str, size: int) -> int:
    """In how many shares of `size` bytes the texts come, LEAST_SHARES at least: groups so counted stay as large
    as they are, however much text there is."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(LEAST_SHARES, -(-total // size))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(n: int, *cols: str) -> F.Column:
    """A number in [0, n) from the hash of the columns: even also when one value fills a third of the rows."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


# ---------------------------------------------------------------- hashes


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works in place."""
    h ^= h >> np.uint64(30)
    h *= _K2
    h ^= h >> np.uint64(27)
    h *= _K3
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of a run of texts. data: the texts' bytes; off: where each text begins (and the end);
    s, e: where each word begins and ends; first: number of each text's first word (and of all)."""

    data: np.ndarray
    off: np.ndarray
    s: np.ndarray
    e: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    n = len(texts)
    buffers = texts.buffers()
    off = np.frombuffer(buffers[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; at least a row each."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> Words:
    inside = ~space[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    start[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    s = np.flatnonzero(start)
    return Words(data, off, s, np.flatnonzero(end) + 1, np.searchsorted(s, off))


def eights(data: np.ndarray) -> np.ndarray:
    """For every byte, the eight bytes from it on as a number; beyond the end zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,)).copy()


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    view, left = eights(data), e - s
    h = left.astype(np.uint64) * _K1 + np.uint64(seed)
    at, todo = s.copy(), None
    while True:
        live = left if todo is None else left[todo]
        if todo is None:
            h ^= view[at] & _MASKS[np.minimum(live, 8)]
            h *= _K2
            h ^= h >> np.uint64(32)
            todo = np.flatnonzero(left > 8)
        else:
            x = h[todo] ^ (view[at[todo]] & _MASKS[np.minimum(live, 8)])
            x *= _K2
            x ^= x >> np.uint64(32)
            h[todo] = x
            todo = todo[live > 8]
        if not len(todo):
            return mix(h)
        at[todo] += 8
        left[todo] -= 8


def word_hashes(w: Words) -> np.ndarray:
    return span_hashes(w.data, w.s, w.e)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash (a polynomial in an odd base, mod 2**64, then mixed) of every n numbers in a row."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for k in range(1, n):
        out *= _K1
        out += h[k : k + m]
    return mix(out)


def inside_doc(w: Words, n: int) -> np.ndarray:
    """For every n words in a row, whether they are of one text."""
    doc = w.doc
    return doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on from task to task, and many of them would
    each keep the most that any task took."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def giving_back(f: Callable) -> Callable:
    """For functions of groups: memory is given back after each."""

    @functools.wraps(f)
    def run(*args):
        try:
            return f(*args)
        finally:
            give_back()

    run.__signature__ = inspect.signature(f)  # Spark looks at the number of arguments
    return run


def batches(it: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches of at most `limit` bytes of text, with their bytes and offsets."""
    for batch in it:
        if not batch.num_rows:
            continue
        data, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
        for lo, hi in pieces(off, limit):
            yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
    give_back()


def keep_rows(docs: DataFrame, text_col: str, make, limit: int = PIECE_BYTES) -> DataFrame:
    """The rows of a table whose text is to stay, with all their columns, in one pass without a shuffle.
    make(): called once a task; gives a function of (texts, bytes, offsets), at most `limit` bytes of them, to a boolean
    per text."""
    numbered = docs.toDF(*(f"_{k}" for k in range(len(docs.columns))))
    at = f"_{docs.columns.index(text_col)}"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch, data, off in batches(it, at, limit):
            yield batch.filter(pa.array(keep(batch.column(batch.schema.get_field_index(at)), data, off)))

    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
