"""Phrase collocations from vertical positional inverted lists.

Words are runs without blanks and marks in pieces between marks, A-Z in lower case, counted by language. A phrase of two or three words
is a candidate if it occurs LEAST times. It is scored by its lowest cut: MILLION * a**2 / (l * r), rounded down, where a, l, r are
how often the phrase, the part in front of the cut and the part behind it occur. A candidate goes if a longer one that holds it
occurs at least half as often. Each language's TOP best remain.

How it runs.

1. Each piece of text of one language is coded once: its distinct words, and the place of each token's word among them. Words are
   counted over all pieces; those that occur LEAST times get dense numbers, which go back to the pieces that hold them. No other word can be in
   a candidate. The pieces are stored with the numbers, bucketed, so that no later round moves them.
2. A piece's inverted lists are the sorted positions of each of its words, and then of each of its frequent phrases. A phrase is extended by
   merge-joining its list with those of the phrase as long that begins a word later: what both have is where the longer phrase is, and how many
   places there are is its frequency in the piece. Only lists of phrases that are frequent in the whole corpus are extended, as no
   part of a frequent phrase is rare.
3. Lists are cut by pieces, so a word that fills a third of the corpus has its list in as many parts. List lengths are summed over all pieces in
   an exchange of packed keys (`exchange.py`), exactly: keys are the words' numbers themselves, spread by a mapping that can be undone.
4. Frequent phrases are then rows, scored by joins with their parts, in decimals of 38 digits (counts up to 10^16 are exact).

Pieces and buckets are counted by bytes of text, so neither grows with the corpus. At most 2^31 - 2 words may occur LEAST times (checked).

Cases: null and empty texts have no words; a null language is `und`; repeated rows count each; a text without marks is one piece of any
length; without candidates the result is empty; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .brown import squeeze, unsqueeze
from .common import LOWER, Scratch, batches, give_back, giving_back, mix, read_table, shares, spread
from .exchange import Exchange, at_least, combined, messages, replies_to, unmix, unpack_numbers, unpack_sorted

LEAST, TOP, MILLION = 10, 2000, 1_000_000
#: A candidate goes if a longer one has at least so many hundredths of its occurrences.
COVERED = 50
#: Bytes of text coded together; and for each bucket of phrases, and each stored part of the pieces.
PIECE_BYTES, BUCKET_BYTES, PART_BYTES = 8 << 20, 16 << 20, 32 << 20
#: Parts of a language's candidates.
SALTS = 64
#: Bytes of text whose words are found together.
TOKEN_BYTES = 2 << 20
_MARK = np.zeros(256, bool)
_MARK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _MARK.copy()
_APART[[0x20, 0x09]] = True
_WORD_BITS = np.uint64(31)
_LOW = np.uint64(2**31 - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- pieces


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words, the text of each, and whether a mark or a text's begin stands before it."""
    inside = ~_APART[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    start[cuts] = inside[cuts]
    s, upto = np.flatnonzero(start), np.cumsum(inside)
    letters = LOWER[data[inside]]
    words = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(np.append(upto[s] - 1, len(letters)).astype(np.int64)), pa.py_buffer(letters))
    doc = np.searchsorted(off, s, "right") - 1
    marks = np.cumsum(_MARK[data])
    new = np.ones(len(s), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (marks[s[1:]] != marks[s[:-1]])
    return words, doc, new


def code_texts(docs: DataFrame) -> DataFrame:
    """Pieces of the rows (_lang, _text), each of one language: its distinct words, how often each is in it, and all its tokens: 0 where a mark or
    a text's begin stands, else 1 + the word's place."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        parts: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for k, (lang, some) in enumerate(parts.items()):
                coded = pa.chunked_array([p[0] for p in some]).combine_chunks().dictionary_encode()
                new = np.concatenate([p[1] for p in some])
                code, known = np.asarray(coded.indices), coded.dictionary
                seq = np.zeros(len(code) + int(new.sum()), "<u4")
                seq[np.arange(len(code)) + np.cumsum(new)] = code + 1
                n = np.bincount(code, minlength=len(known))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number + k]), pa.array([lang]), pa.array([len(code)], pa.int64()), pa.array([known.to_pylist()], pa.list_(pa.string())), pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([squeeze(seq)], pa.binary())],
                    ["piece", "lang", "tokens", "words", "times", "codes"],
                )

        for batch, data, off in batches(it, "_text", TOKEN_BYTES):
            if parts and held + len(data) > PIECE_BYTES:
                yield from rows()
                number, held, parts = number + len(parts), 0, {}
            words, doc, new = tokens(data, off)
            langs = batch.column(0).dictionary_encode()
            lang = np.asarray(langs.indices)[doc]
            for k, name in enumerate(langs.dictionary.to_pylist()):
                some = np.flatnonzero(lang == k)
                if len(some):
                    parts.setdefault(name, []).append((words.take(pa.array(some)), new[some]))
            held += len(data)
        yield from rows()
        give_back()

    return docs.mapInArrow(run, "piece bigint, lang string, tokens bigint, words array<string>, times array<bigint>, codes binary")


def frequent_words(pieces: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """lang, word, n, id (dense from 0) of the words that occur `least` times."""
    each = pieces.select("lang", F.explode(F.arrays_zip("words", "times")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    counted = each.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # numbers are dense within a partition; a row a partition tells where each begins
    held = scratch.put(counted.withColumns({"part": F.spark_partition_id(), "k": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "counted")
    begin, rows = 0, []
    for part, n in held.groupBy("part").agg(F.count("*")).orderBy("part").collect():
        rows.append((part, begin))
        begin += n
    if begin >= 2**31 - 1:
        raise ValueError("more than 2^31 - 2 frequent words")
    begins = held.sparkSession.createDataFrame(rows, "part int, begin long")
    return scratch.put(held.join(F.broadcast(begins), "part").select("lang", "word", "n", (F.col("begin") + F.col("k")).alias("id")), "words")


def number_tokens(pieces: DataFrame, words: DataFrame) -> DataFrame:
    """piece, seq: the pieces' tokens by the words' numbers plus one, 0 for marks, begins and rare words."""
    places = pieces.select("piece", "lang", F.posexplode("words").alias("place", "word")).join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("piece").alias("_piece"), "place", "id")

    @giving_back
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        code = unsqueeze(table.column("codes")[0].as_py(), "<u4")
        number = np.zeros(table.column("n_words")[0].as_py() + 1, "<u4")
        number[np.asarray(replies.column("place").combine_chunks()) + 1] = np.asarray(replies.column("id").combine_chunks()) + 1
        return pa.table({"piece": table.column("piece").cast(pa.int64()), "seq": pa.array([squeeze(number[code])], pa.binary())})

    own = pieces.select("piece", F.size("words").alias("n_words"), "codes")
    return own.groupBy("piece").cogroup(places.groupBy("_piece")).applyInArrow(run, "piece bigint, seq binary")


# ---------------------------------------------------------------- lists


def meet(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A merge join of two sorted position lists: where in each the positions are that both have."""
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(right, left), len(right) - 1)
    has = np.flatnonzero(right[at] == left)
    return has, at[has]


def word_lists(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the piece's frequent words are, in order, and their numbers."""
    at = np.flatnonzero(seq)
    return at, seq[at].astype(np.uint64) - np.uint64(1)


def pair_lists(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two frequent words follow each other, and the pairs' keys."""
    at, word = word_lists(seq)
    a, b = meet(at, at - 1)
    return at[a], word[a] << _WORD_BITS | word[b]


def triple_lists(at: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the places of frequent pairs: the pairs with which triples begin, and their third words."""
    a, b = meet(at, at - 1)
    return pair[a], pair[b] & _LOW


def pair_keys(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a piece as evenly spread keys in order, how often each occurs; the places of all pairs, and each one's key's number."""
    at, pair = pair_lists(seq)
    h, _, n, number = combined(mix(pair.copy()), None, np.ones(len(pair), np.int64), np.add)
    return h, n, at, number


def triple_keys(seq: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct triples of a piece as (spread key, third word) in order, and how often each occurs. held: which of `pair_keys` are frequent."""
    h, _, at, number = pair_keys(seq)
    some = held[number]
    pair, third = triple_lists(at[some], unmix(h[number[some]]))
    h, low, n, _ = combined(mix(pair + third * _STEP), third.astype(np.uint32), np.ones(len(pair), np.int64), np.add)
    return h, low, n


def unpacked(totals: DataFrame, words: int) -> DataFrame:
    """The totals as rows: the words' numbers w0, w1 (and w2), and f."""
    names = [f"w{k}" for k in range(words)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                pair, f = unmix(unpack_sorted(row["keys"])), unpack_numbers(row["vals"]).astype(np.int64)
                third = unpack_numbers(row["low"]).astype(np.uint64) if words == 3 else None
                if third is not None:
                    pair = pair - third * _STEP
                cols = [pair >> _WORD_BITS, pair & _LOW, *([third] if words == 3 else [])]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in cols), pa.array(f)], [*names, "f"])

    return totals.mapInArrow(run, ", ".join(f"{c} bigint" for c in [*names, "f"]))


# ---------------------------------------------------------------- scores


def _score(a: Column, left: Column, right: Column) -> Column:
    a, left, right = (c.cast("decimal(18,0)") for c in (a, left, right))
    return F.call_function("div", a * a * F.lit(MILLION).cast("decimal(7,0)"), left * right)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, fan: int | None = None, piece_parts: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` best candidates."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    parts = piece_parts or shares(docs, text_col, PART_BYTES)
    buckets = shares(docs, text_col, BUCKET_BYTES)
    exchange = Exchange(at_least(least), buckets, shares(docs, text_col, PIECE_BYTES), **({"fan": fan} if fan else {}))
    coded = scratch.put_bucketed(code_texts(docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("_lang"), F.col(text_col).alias("_text"))), "coded", "piece", parts)
    words = frequent_words(coded, least, scratch)
    sizes = scratch.put(coded.groupBy("lang").agg(F.sum("tokens").alias("n")), "sizes")
    pieces = scratch.put_bucketed(number_tokens(coded, words), "pieces", "piece", parts)
    scratch.drop("coded")

    def pairs_of(row: dict):
        h, n, _, _ = pair_keys(unsqueeze(row["seq"], "<u4"))
        return row["piece"], h, None, n

    replies, found = exchange.run(exchange.ask(pieces, pairs_of), scratch, "pairs", totals=True)
    targets = exchange.targets

    @giving_back
    def ask_triples(table: pa.Table, answers: pa.Table) -> pa.Table:
        seq = unsqueeze(table.column("seq")[0].as_py(), "<u4")
        return messages(table.column("piece")[0].as_py(), *triple_keys(seq, replies_to(pair_keys(seq)[0], targets, answers)), targets)

    asked = pieces.groupBy("piece").cogroup(replies.groupBy("_unit")).applyInArrow(ask_triples, "_bucket int, _unit bigint, keys binary, low binary, vals binary")
    _, longer = exchange.run(asked, scratch, "triples", bits=False, totals=True)
    scored = candidates(scratch.put(unpacked(found, 2), "found-2"), scratch.put(unpacked(longer, 3), "found-3"), words)
    return ranked(scratch.put(scored, "scored"), sizes, top)


def candidates(pairs: DataFrame, triples: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the frequent pairs (w0, w1, f) and triples (w0, w1, w2, f) that no longer one covers."""
    word = {k: words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}"), F.col("n").alias(f"n{k}"), F.col("lang").alias(f"lang{k}")) for k in range(3)}
    f = F.col("f")
    # of the triples that hold a pair, the most frequent
    ends = [triples.select("w0", "w1", "f"), triples.select(F.col("w1").alias("w0"), F.col("w2").alias("w1"), "f")]
    most = ends[0].union(ends[1]).groupBy("w0", "w1").agg(F.max("f").alias("most"))
    two = (
        pairs.join(most, ["w0", "w1"], "left").where(F.col("most").isNull() | (100 * F.col("most") < COVERED * f))
        .join(word[0], "w0").join(word[1], "w1")
        .select(F.col("lang0").alias("lang"), F.concat_ws(" ", "word0", "word1").alias("phrase"), f.alias("a"), F.col("n0").alias("l"), F.col("n1").alias("r"), _score(f, F.col("n0"), F.col("n1")).alias("score"))
    )
    front = pairs.toDF("w0", "w1", "f01")
    back = pairs.toDF("w1", "w2", "f12")
    cuts = triples.join(front, ["w0", "w1"]).join(back, ["w1", "w2"]).join(word[0], "w0").join(word[1].drop("lang1", "n1"), "w1").join(word[2].drop("lang2"), "w2")
    one, other = _score(f, F.col("n0"), F.col("f12")), _score(f, F.col("f01"), F.col("n2"))
    cut = F.when(other < one, F.struct(F.col("f01").alias("l"), F.col("n2").alias("r"), other.alias("score"))).otherwise(F.struct(F.col("n0").alias("l"), F.col("f12").alias("r"), one.alias("score")))
    three = cuts.select(F.col("lang0").alias("lang"), F.concat_ws(" ", "word0", "word1", "word2").alias("phrase"), f.alias("a"), cut.alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    return two.unionByName(three)


def ranked(scored: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """Each language's `top` best. Counts by the score's power of two tell first from where on scores matter, so that
    no task gets more of a language than that; each language's row is there once a salt, so its candidates meet it in many tasks."""
    level = F.floor(F.log2(F.col("score") + 1) * 8).cast("int")
    counts = scored.groupBy("lang", level.alias("level")).agg(F.count("*").alias("m"))
    above = F.sum("m").over(Window.partitionBy("lang").orderBy(F.desc("level"))) - F.col("m")
    least = counts.withColumn("above", above).where(F.col("above") < top).groupBy("lang").agg(F.min("level").alias("least"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = scored.withColumn("salt", spread(SALTS, "phrase")).join(least, ["lang", "salt"]).where(level >= F.col("least"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP13_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), s AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), w AS (
  SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(ws) AS w FROM s) GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM w GROUP BY lang
), f2 AS (
  SELECT lang, a, b, count(*) AS f FROM (SELECT lang, unnest(ws[:-2]) AS a, unnest(ws[2:]) AS b FROM s WHERE len(ws) > 1) GROUP BY ALL HAVING count(*) >= {LEAST}
), f3 AS (
  SELECT lang, a, b, c, count(*) AS f FROM (SELECT lang, unnest(ws[:-3]) AS a, unnest(ws[2:-2]) AS b, unnest(ws[3:]) AS c FROM s WHERE len(ws) > 2) GROUP BY ALL HAVING count(*) >= {LEAST}
), covered AS (
  SELECT DISTINCT f2.lang, f2.a, f2.b FROM f2 JOIN f3 ON f2.lang = f3.lang AND f2.a = f3.a AND f2.b = f3.b AND 100 * f3.f >= {COVERED} * f2.f
  UNION SELECT f2.lang, f2.a, f2.b FROM f2 JOIN f3 ON f2.lang = f3.lang AND f2.a = f3.b AND f2.b = f3.c AND 100 * f3.f >= {COVERED} * f2.f
), cuts AS (
  SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM f2 JOIN w x ON x.lang = f2.lang AND x.w = f2.a JOIN w y ON y.lang = f2.lang AND y.w = f2.b
  WHERE NOT EXISTS (SELECT 1 FROM covered z WHERE z.lang = f2.lang AND z.a = f2.a AND z.b = f2.b)
  UNION ALL
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, x.f, y.f, 1
  FROM f3 JOIN w x ON x.lang = f3.lang AND x.w = f3.a JOIN f2 y ON y.lang = f3.lang AND y.a = f3.b AND y.b = f3.c
  UNION ALL
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, x.f, y.f, 2
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.a = f3.a AND x.b = f3.b JOIN w y ON y.lang = f3.lang AND y.w = f3.c
), scored AS (
  SELECT *, CAST(({MILLION} * CAST(a AS HUGEINT) * CAST(a AS HUGEINT)) // (CAST(l AS HUGEINT) * CAST(r AS HUGEINT)) AS BIGINT) AS score FROM cuts
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN n USING (lang) WHERE rank <= {TOP}
"""
