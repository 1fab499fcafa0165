"""Substring deduplication over fixed-length word windows.

A window is `window` consecutive words of one text. A word goes if a window over it also starts in a
text with a smaller id; what goes is returned as maximal intervals of word numbers.

How it runs. Texts are dealt into blocks by a hash. A block makes the Rabin-Karp hashes of all its
windows and keeps, per distinct hash, the smallest id that has it; it sends them, sorted and packed to
eight bytes a hash, to the bucket of the hash's leading bits. A bucket finds each hash's smallest id over
all blocks and answers every block with one bit per hash: is there a smaller id elsewhere? The block
hashes its texts again and merges the windows that go. So a passage that a third of all texts share
arrives at its bucket once per block, not once per text, the text is moved once, and neither step
holds more than a block or a bucket. Both are counted by bytes of text, one for each BLOCK_BYTES, so neither grows
with the corpus. Where there are so many buckets that a message would hold few hashes, they go by relays (see `exchange`), and a passage
in all blocks arrives at its bucket once a relay.

A hash has 80 bits: 64 of one polynomial and 16 of another. Of n windows some n**2 / 2**81 pairs are
expected to be equal by chance: 10**-8 pairs at 10**8 windows, 400 at the 3 * 10**13 of 100 TB.

Cases: a null or empty text has no words, no intervals and an empty kept text; a text with a null id
is returned whole and takes nothing from others; rows of one id don't take from each other; shorter
texts than a window are kept; ids that aren't whole numbers raise an error; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, giving_back, inside_doc, mix, pieces, read_table, shares, spread, text_bytes, window_hashes, word_hashes, words
from .exchange import FAN, Exchange, earlier, messages, replies_to

WINDOW = 13
#: Bytes of text in a block, and for each bucket.
BLOCK_BYTES = 12 << 20
_NONE = np.iinfo(np.int64).max
_OTHER = np.uint64(0xA0761D6478BD642F)


def block_windows(table: pa.Table, window: int) -> Iterator[tuple[Words, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece of a block: its words, its first row, the starts of its windows, their hashes (64 and 16
    bits) and ids (the largest number for a null id)."""
    ids = np.asarray(table.column("_id").cast(pa.int64()).fill_null(_NONE).combine_chunks())
    data, off = text_bytes(table.column("_text"))
    for lo, hi in pieces(off):
        w = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        at, h = np.flatnonzero(inside_doc(w, window)), word_hashes(w)
        check = (window_hashes(mix(h ^ _OTHER), window)[at] >> np.uint64(48)).astype(np.uint16)
        yield w, lo, at, window_hashes(h, window)[at], check, ids[lo + w.doc[at]]


def distinct(h: np.ndarray, check: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, with the smallest id of each, and the number of each row's."""
    order = np.lexsort((check, h))
    h, check, ids = h[order], check[order], ids[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    first = np.flatnonzero(new)
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return h[first], check[first], np.minimum.reduceat(ids, first) if len(first) else ids, number


def block_hashes(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`distinct` over all windows of texts with an id, in the order of the pieces."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, check, ids = (np.concatenate([p[k][p[5] != _NONE] for p in parts]) for k in (3, 4, 5))
    return distinct(h, check, ids)


def rid(w: Words, gone: np.ndarray) -> pa.Array:
    """The texts' other words, one space between."""
    byte = w.data.copy()
    ends = np.repeat(w.off[1:], w.counts)
    byte[w.e[w.e < ends]] = 0x20
    edge = np.zeros(len(byte) + 2, np.int8)
    s, e = w.s[~gone], w.e[~gone]
    stop = e + (e < ends[~gone])  # with the separator after the word, if the text goes on
    # two kept words may touch at `stop`, so marks are added
    edge[s] += 1
    edge[stop] -= 1
    keep = np.cumsum(edge[: len(byte)], dtype=np.int8) > 0
    upto = np.zeros(len(byte) + 1, np.int64)
    np.cumsum(keep, out=upto[1:])
    out, off = byte[keep], upto[w.off]
    # a separator after a text's last kept word goes
    some = np.flatnonzero(off[1:] > off[:-1])
    extra = some[out[off[some + 1] - 1] == 0x20]
    drop = np.zeros(len(off), np.int64)
    drop[extra + 1] = 1
    mask = np.ones(len(out), bool)
    mask[off[extra + 1] - 1] = False
    off = off - np.cumsum(drop)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out[mask]))])


def intervals(w: Words, gone: np.ndarray) -> pa.Array:
    """Per text, the maximal runs of words that go: (first word, end) within the text."""
    n = len(gone)
    before = np.zeros(n, bool)
    before[1:] = gone[:-1]
    starts = np.zeros(n, bool)
    starts[w.first[:-1][w.counts > 0]] = True
    begin = np.flatnonzero(gone & (~before | starts))
    after = np.ones(n, bool)
    after[:-1] = ~gone[1:] | starts[1:]
    end = np.flatnonzero(gone & after) + 1
    base = w.first[:-1][np.searchsorted(w.first, begin, "right") - 1] if len(begin) else begin
    pairs = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], ["first", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, w.first).astype(np.int32)), pairs)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, blocks: int | None = None, buckets: int | None = None, fan: int = FAN) -> DataFrame:
    """id, n_words, n_removed, kept_text and removed (maximal intervals of word numbers) of every text."""
    if not (blocks and buckets):
        n = shares(docs, text_col, BLOCK_BYTES)
        blocks, buckets = blocks or n, buckets or n
    exchange = Exchange(earlier(), buckets, blocks, fan)
    targets = exchange.targets
    # the id and the text both count: copies of an id spread too
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).withColumn("_block", spread(blocks, "_id", "_text"))

    @giving_back
    def ask(table: pa.Table) -> pa.Table:
        h, check, ids, _ = block_hashes(list(block_windows(table, window)))
        return messages(table.column("_block")[0].as_py(), h, check.astype(np.uint32), ids, targets, exchange.rule.pack)

    @giving_back
    def settle(table: pa.Table, replies: pa.Table) -> pa.Table:
        parts = list(block_windows(table, window))
        h, _, least, number = block_hashes(parts)
        before = replies_to(h, targets, replies)
        out, done = [], 0
        for w, lo, starts, _, _, ids in parts:
            real = ids != _NONE
            k = number[done : done + int(real.sum())]
            done += len(k)
            goes = np.zeros(len(ids), bool)
            goes[real] = before[k] | (least[k] < ids[real])
            edge = np.zeros(len(w.s) + 1, np.int64)
            edge[starts[goes]] += 1
            edge[starts[goes] + window] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            rows = len(w.off) - 1
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(w.first[:-1], len(gone))) if rows else np.zeros(0, np.int64)
            out.append(
                pa.table(
                    {
                        "_id": table.column("_id").slice(lo, rows).cast(pa.int64()),
                        "n_words": w.counts.astype(np.int64),
                        "n_removed": np.where(w.counts > 0, removed, 0),
                        "kept_text": rid(w, gone).cast(pa.large_string()).cast(pa.string()),
                        "removed": intervals(w, gone),
                    }
                )
            )
        return pa.concat_tables(out) if out else pa.table({"_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string()), "removed": pa.array([], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))})

    asked = own.groupBy("_block").applyInArrow(ask, "_bucket int, _unit bigint, keys binary, low binary, vals binary")
    answered, _ = exchange.run(asked)
    done = own.groupBy("_block").cogroup(answered.groupBy(F.col("_unit").cast("int"))).applyInArrow(
        settle, "_id bigint, n_words bigint, n_removed bigint, kept_text string, removed array<struct<first:bigint,end:bigint>>"
    )
    return done.withColumnRenamed("_id", id_col)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("removed").cast("long").alias("n_intervals"))


#: Words as in the contract; a window's text is its words joined by a space, which no word holds.
OP2_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), k AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w
), n AS (
  SELECT doc_id, k, word, {" || ' ' || ".join(f"lead(word, {j}) OVER o" if j else "word" for j in range(WINDOW))} AS win
  FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY k)
), f AS (
  SELECT doc_id, k, word, win, min(doc_id) OVER (PARTITION BY win) AS least FROM n
), g AS (
  SELECT doc_id, k, word, max(CASE WHEN win IS NOT NULL AND least < doc_id THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone,
    lag(win) OVER (PARTITION BY doc_id ORDER BY k) AS _
  FROM f
), h AS (
  SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY k), 0) = 0 THEN 1 ELSE 0 END AS begins FROM g
), s AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, sum(begins) AS n_intervals,
    coalesce(string_agg(word, ' ' ORDER BY k) FILTER (WHERE gone = 0), '') AS kept
  FROM h GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(n_intervals, 0) AS BIGINT) AS n_intervals
FROM documents d LEFT JOIN s USING (doc_id)
"""
