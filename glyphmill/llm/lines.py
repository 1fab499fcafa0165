"""Line deduplication with two Bloom filters.

A line's key is the line without blanks (0x20, 0x09-0x0D) at its ends, A-Z in lower case. Keys of at least LEAST_CHARS
code points that at least LEAST_DOCS documents hold lose all their lines, except in the largest id that holds them. The other
lines stay, joined by newlines.

How it runs. Texts are dealt into blocks by a hash, one for each BLOCK_BYTES of text.

1. A block sends the 64-bit hash of each of its distinct keys to the filters of that hash's range, with a mark if two of
   its documents hold it. A line that a third of all documents hold so arrives once a block.
2. A range puts the hashes through two Bloom filters in one stream: what is in the first already, or is marked, goes into the
   second. Then it answers those blocks whose hashes are in the second filter. A key of two documents always is, one of a
   single document only by a false positive (some 0.2 %, at 16 bits and 4 probes a hash). A range holds the
   hashes of RANGE_BYTES of text at most, one for every LEAST_CHARS bytes, so filters have a bound however large the input is.
3. Only suspected lines are shuffled as text: each block sends a suspected key once with each of its up to
   LEAST_DOCS largest ids. These are enough to tell, exactly and over all blocks, whether LEAST_DOCS documents hold the
   key and which id is the largest; keys are compared as text, so hashes that meet by chance cost work but change nothing.
4. Confirmed keys go back to the blocks that hold them, which drop the lines.

The text is moved once, to its block; the later passes read the same exchange.

Cases: a null or empty text has one empty line, which stays; rows of one id count as one document and are each returned; a row with a
null id is returned whole and counts for nothing; ids that aren't whole numbers raise an error; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, giving_back, mix, pieces, read_table, shares, span_hashes, spread, text_bytes

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Bytes of text in a block, and for each range of hashes.
BLOCK_BYTES, RANGE_BYTES = 12 << 20, 32 << 20
#: Bits of each filter for a hash, and how many of them are set.
BITS, PROBES = 16, 4
#: Hashes put through the filters at a time.
STREAM = 1 << 16
_NONE = np.iinfo(np.int64).max


class Lines:
    """Lines of a run of texts. s, e: begin and end of each; first: number of each text's first line (and of all); ks, ke: its
    key's begin and end; long: whether the key has enough code points; h: the hashes of these keys, doc: their texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray, least_chars: int):
        self.data, self.off = data, off
        n = len(off) - 1
        cut = np.flatnonzero(data == 0x0A)
        # a text's lines begin at its own begin and behind each newline; empty texts have one line, too
        text = np.searchsorted(off, cut, "right") - 1
        counts = np.bincount(text, minlength=n) + 1 if n else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.s, self.e = (np.empty(self.first[-1], np.int64) for _ in range(2))
        place = np.arange(len(cut)) + text
        self.s[self.first[:-1]], self.e[self.first[1:] - 1] = off[:-1], off[1:]
        self.s[place + 1], self.e[place] = cut + 1, cut
        # the first and last byte that is no blank, if the line has any
        seen = np.flatnonzero(~SPACE[data])
        a, b = np.searchsorted(seen, self.s), np.searchsorted(seen, self.e)
        some = a < b
        self.ks, self.ke = self.s.copy(), self.s.copy()
        self.ks[some], self.ke[some] = seen[a[some]], seen[b[some] - 1] + 1
        begins = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
        self.long = np.flatnonzero(begins[self.ke] - begins[self.ks] >= least_chars)
        self.doc = np.searchsorted(self.first, self.long, "right") - 1
        self.lower = LOWER[data]
        self.h = span_hashes(self.lower, self.ks[self.long], self.ke[self.long])

    def key(self, k: int) -> bytes:
        """The key of the k-th long line."""
        line = self.long[k]
        return self.lower[self.ks[line] : self.ke[line]].tobytes()

    def without(self, gone: np.ndarray) -> pa.Array:
        """The texts without the lines that go (a mask over all), the others joined by newlines."""
        n = len(self.first) - 1
        mark = np.zeros(len(self.data) + 1, np.int8)
        stay = np.flatnonzero(~gone)
        # each line that stays takes the newline before it along, but for a text's first that stays
        doc = np.searchsorted(self.first, stay, "right") - 1
        lead = np.ones(len(stay), bool)
        lead[1:] = doc[1:] != doc[:-1]
        np.add.at(mark, self.s[stay] - ~lead, 1)
        np.add.at(mark, self.e[stay], -1)
        keep = np.cumsum(mark[:-1]) > 0
        upto = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(keep, out=upto[1:])
        out = np.ascontiguousarray(self.data[keep])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(upto[self.off]), pa.py_buffer(out)])


class Filters:
    """Two Bloom filters: for hashes put in once, and for those put in again. In memory a bit takes a byte, which is faster."""

    def __init__(self, n: int):
        self.bits = max(10, int(np.ceil(np.log2(max(1, n) * BITS))))
        self.once, self.twice = (np.zeros(1 << self.bits, bool) for _ in range(2))

    def _at(self, h: np.ndarray) -> list[np.ndarray]:
        step = mix(h.copy()) | np.uint64(1)
        return [((h + np.uint64(k) * step) >> np.uint64(64 - self.bits)).astype(np.int64) for k in range(PROBES)]

    def put(self, h: np.ndarray, again: np.ndarray) -> None:
        """again: hashes known to be there twice."""
        for at in range(0, len(h), STREAM):
            new, place, times = np.unique(h[at : at + STREAM], return_inverse=True, return_counts=True)
            more = (times > 1) | (np.bincount(place, again[at : at + STREAM]) > 0)
            probes = self._at(new)
            more |= np.logical_and.reduce([self.once[p] for p in probes])
            for p in probes:
                self.once[p] = True
                self.twice[p[more]] = True

    def suspects(self, h: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([self.twice[p] for p in self._at(h)])


def block_lines(table: pa.Table, least_chars: int):
    """Per piece of a block: its lines, its first row, and the ids of its texts (_NONE: null)."""
    ids = np.asarray(table.column("_id").cast(pa.int64()).fill_null(_NONE).combine_chunks())
    data, off = text_bytes(table.column("_text"))
    for lo, hi in pieces(off):
        yield Lines(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], least_chars), lo, ids[lo:hi]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, blocks: int | None = None, ranges: int | None = None) -> DataFrame:
    """id, n_lines, n_dropped and kept_text of every row."""
    blocks = blocks or shares(docs, text_col, BLOCK_BYTES)
    ranges = ranges or shares(docs, text_col, RANGE_BYTES)
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).withColumn("_block", spread(blocks, "_id", "_text"))

    @giving_back
    def ask(table: pa.Table) -> pa.Table:
        found = [(x.h[ids[x.doc] != _NONE], ids[x.doc][ids[x.doc] != _NONE]) for x, _, ids in block_lines(table, least_chars)]
        h, doc = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(h))[: len(first)] - 1
        at = (h[first] >> np.uint64(32)).astype(np.int64) * ranges >> 32
        block = table.column("_block")[0].as_py()
        return pa.table({"_range": pa.array(at, pa.int32()), "_block": pa.array(np.full(len(first), block), pa.int32()), "h": h[first].view(np.int64), "again": doc[first] != doc[last]})

    @giving_back
    def suspect(table: pa.Table) -> pa.Table:
        h = np.asarray(table.column("h").combine_chunks()).view(np.uint64)
        two = Filters(len(h))
        two.put(h, np.asarray(table.column("again").combine_chunks()))
        return table.select(["_block", "h"]).filter(pa.array(two.suspects(h)))

    @giving_back
    def show(table: pa.Table, replies: pa.Table) -> pa.Table:
        asked = np.sort(np.asarray(replies.column("h").cast(pa.int64()).combine_chunks()).view(np.uint64))
        held: dict[bytes, set[int]] = defaultdict(set)
        for x, _, ids in block_lines(table, least_chars) if len(asked) else ():
            at = np.minimum(np.searchsorted(asked, x.h), len(asked) - 1)
            for k in np.flatnonzero((asked[at] == x.h) & (ids[x.doc] != _NONE)).tolist():
                some = held[x.key(k)]
                some.add(int(ids[x.doc[k]]))
                if len(some) > least_docs:
                    some.remove(min(some))
        rows = [(k, i) for k, some in held.items() for i in some]
        block = replies.column("_block")[0].as_py() if len(asked) else 0
        return pa.table({"_block": pa.array([block] * len(rows), pa.int32()), "key": pa.array([k for k, _ in rows], pa.binary()), "id": pa.array([i for _, i in rows], pa.int64())})

    @giving_back
    def settle(table: pa.Table, replies: pa.Table) -> pa.Table:
        stays = dict(zip(replies.column("key").to_pylist(), replies.column("largest").to_pylist(), strict=True))
        wanted = _hashes(stays)
        out = []
        for x, lo, ids in block_lines(table, least_chars):
            gone = np.zeros(len(x.s), bool)
            if len(wanted):
                at = np.minimum(np.searchsorted(wanted, x.h), len(wanted) - 1)
                for k in np.flatnonzero((wanted[at] == x.h) & (ids[x.doc] != _NONE)).tolist():
                    gone[x.long[k]] = stays.get(x.key(k), ids[x.doc[k]]) != ids[x.doc[k]]
            upto = np.concatenate([[0], np.cumsum(gone)])
            out.append(
                pa.table(
                    {
                        "_id": table.column("_id").slice(lo, len(ids)).cast(pa.int64()),
                        "n_lines": np.diff(x.first).astype(np.int64),
                        "n_dropped": np.diff(upto[x.first]).astype(np.int64),
                        "kept_text": x.without(gone).cast(pa.large_string()).cast(pa.string()),
                    }
                )
            )
        return pa.concat_tables(out) if out else pa.table({"_id": pa.array([], pa.int64()), "n_lines": pa.array([], pa.int64()), "n_dropped": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})

    asked = own.groupBy("_block").applyInArrow(ask, "_range int, _block int, h bigint, again boolean")
    suspected = asked.groupBy("_range").applyInArrow(suspect, "_block int, h bigint")
    shown = own.groupBy("_block").cogroup(suspected.groupBy("_block")).applyInArrow(show, "_block int, key binary, id bigint")
    confirmed = (
        shown.select("key", "id").distinct().groupBy("key").agg(F.count("*").alias("docs"), F.max("id").alias("largest"))
        .where(F.col("docs") >= least_docs).select("key", "largest")
    )
    replies = shown.select("_block", "key").distinct().join(confirmed, "key")
    done = own.groupBy("_block").cogroup(replies.groupBy("_block")).applyInArrow(settle, "_id bigint, n_lines bigint, n_dropped bigint, kept_text string")
    return done.withColumnRenamed("_id", id_col)


def _hashes(keys) -> np.ndarray:
    """The hashes of keys, in order."""
    raw = list(keys)
    off = np.concatenate([[0], np.cumsum([len(k) for k in raw])]).astype(np.int64)
    return np.sort(span_hashes(np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:])) if raw else np.zeros(0, np.uint64)


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP12_SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS k
  FROM documents
), k AS (
  SELECT doc_id, k, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{_UPPER}', '{_LOWER}') AS key FROM l
), d AS (
  SELECT key, count(DISTINCT doc_id) AS docs, max(doc_id) AS largest FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key
), g AS (
  SELECT k.doc_id, k.k, k.line, coalesce(docs >= {LEAST_DOCS} AND k.doc_id <> largest, false) AS gone FROM k LEFT JOIN d USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""
