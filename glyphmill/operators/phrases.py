"""Phrases by positions: an index of where each word stands, and searches that read it alone.

A word's places are kept in blocks, one for the word and each RANGE_DOCS ids in a row, so a word in every document has its places in as many blocks
as there are ranges of ids. A block holds its places as sorted numbers, the id's distance from the range's begin and the position in one, which the
file's delta encoding packs to a few bits each. The table is sorted by word and range: a search opens the row groups of its words alone, and the
ranges are the skip bounds, as only ranges that hold all of a phrase's words are looked at.

A phrase is met by arithmetic on positions: the places of its k-th word, less k, are intersected. Nothing else is read, texts least of all.

Ids are whole numbers, also below 0. Null texts and ids have no places. Rows of one id are told apart by nothing, so they should be one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE_DOCS = 256
#: Positions in a text; longer texts than that have places beyond, which no block can name: an error.
POSITION_BITS = 40
GAP = "？"


def words_of(text: Column) -> Column:
    """A text's words: runs without blanks, A-Z in lower case."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def place_blocks(docs: DataFrame, words: Column, id_col: str = "doc_id", range_docs: int = RANGE_DOCS) -> DataFrame:
    """word, range, n, places of every word and range of ids. Texts move once, to their range; a range at a time is grouped, so no word is moved
    alone or sorted with those of other ranges."""
    id_ = F.col(id_col).cast("long")
    within = F.pmod(id_, F.lit(range_docs).cast("long"))
    at = F.call_function("div", id_ - within, F.lit(range_docs).cast("long"))
    dealt = docs.where(F.col(id_col).isNotNull()).withColumns({"_range": at, "_within": within}).repartition("_range").sortWithinPartitions("_range")
    return dealt.select("_range", "_within", words.alias("words")).where("words is not null").mapInArrow(_grouped, "word string, range long, n long, places array<long>")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of documents (range, distance from its begin, words) in order of ranges."""
    held: list[pa.RecordBatch] = []  # what there is of the last range
    for b in batches:
        ranges = b.column(0).to_numpy()
        ends = [*(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist(), len(ranges)] if len(ranges) else []
        for begin, end in zip([0, *ends], ends):
            if held and held[-1].column(0)[0] != b.column(0)[begin]:
                yield _blocks(held)
                held = []
            held.append(b.slice(begin, end - begin))
    if held:
        yield _blocks(held)


def _blocks(own: Sequence[pa.RecordBatch]) -> pa.RecordBatch:
    """The blocks of a range."""
    lists = pa.concat_arrays([b.column(2) for b in own])
    within = np.concatenate([b.column(1).to_numpy() for b in own])
    sizes = pc.list_value_length(lists).to_numpy()
    begins = np.cumsum(sizes) - sizes
    places = np.repeat(within.astype(np.int64) << POSITION_BITS, sizes) + np.arange(sizes.sum(), dtype=np.int64) - np.repeat(begins, sizes)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    n = np.bincount(codes, minlength=len(coded.dictionary))
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(places[np.lexsort((places, codes))]))
    made = [coded.dictionary, pa.array(np.full(len(n), own[0].column(0)[0].as_py(), dtype=np.int64)), pa.array(n.astype(np.int64)), lists]
    return pa.RecordBatch.from_arrays(made, names=["word", "range", "n", "places"])


def write_blocks(blocks: DataFrame, folder: str) -> DataFrame:
    """The index as a stored table, in order of words and ranges, places delta-encoded."""
    out = blocks.repartitionByRange("word", "range").sortWithinPartitions("word", "range").write.mode("overwrite")
    out.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false").parquet(folder)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(folder)


def _offsets(phrase: Sequence[str]) -> list[tuple[int, str]]:
    found = [(k, w) for k, w in enumerate(phrase) if w != GAP]
    if not found:
        raise ValueError("a phrase needs a word")
    return found


def phrase_blocks(index: DataFrame, phrase: Sequence[str]) -> DataFrame:
    """The blocks that a phrase opens: range and, by word, its places; ranges without one of its words are skipped."""
    words = sorted({w for _, w in _offsets(phrase)})
    own = index.where(F.col("word").isin(words))
    # a block for each of the phrase's words at most, so a group is as small as the phrase
    places = [F.first(F.when(F.col("word") == w, F.col("places")), ignorenulls=True).alias(f"p{k}") for k, w in enumerate(words)]
    held = own.groupBy("range").agg(F.count("*").alias("words"), F.sum("n").alias("n"), *places)
    return held.where(F.col("words") == len(words))


def _less(k: int):
    return lambda x: x - k


def phrase_places(index: DataFrame, phrase: Sequence[str], id_col: str = "doc_id", range_docs: int = RANGE_DOCS) -> DataFrame:
    """id, pos: every place where the phrase begins. GAP stands for any one word; at the phrase's end it says nothing."""
    words = sorted({w for _, w in _offsets(phrase)})
    first = _offsets(phrase)[0][0]
    begins: Column | None = None
    for k, w in _offsets(phrase):
        own = F.transform(F.col(f"p{words.index(w)}"), _less(k - first))
        begins = own if begins is None else F.array_intersect(begins, own)
    found = phrase_blocks(index, phrase).select("range", F.explode(begins).alias("x"))
    pos = F.col("x").bitwiseAND((1 << POSITION_BITS) - 1)
    return found.select((F.col("range") * range_docs + F.shiftright("x", POSITION_BITS)).alias(id_col), (pos - first).alias("pos")).where("pos >= 0")


def phrase_documents(index: DataFrame, phrases: Sequence[Sequence[str]], id_col: str = "doc_id", range_docs: int = RANGE_DOCS) -> DataFrame:
    """phrase (its words, space-joined), id, n: in how many places of which documents each phrase is."""
    out: DataFrame | None = None
    for p in phrases:
        own = phrase_places(index, p, id_col, range_docs).groupBy(id_col).agg(F.count("*").alias("n")).select(F.lit(" ".join(p)).alias("phrase"), id_col, "n")
        out = own if out is None else out.unionByName(own)
    return out


def blocks_read(index: DataFrame, phrases: Sequence[Sequence[str]]) -> DataFrame:
    """phrase, opened (blocks of its words), met (of these, in ranges that hold them all), blocks (of the index)."""
    total = index.agg(F.count("*").alias("blocks"))
    out: DataFrame | None = None
    for p in phrases:
        words = sorted({w for _, w in _offsets(p)})
        opened = index.where(F.col("word").isin(words)).agg(F.count("*").alias("opened"))
        met = phrase_blocks(index, p).agg(F.coalesce(F.sum("words"), F.lit(0).cast("long")).alias("met"))
        own = opened.join(met).join(total).select(F.lit(" ".join(p)).alias("phrase"), "opened", "met", "blocks")
        out = own if out is None else out.unionByName(own)
    return out
