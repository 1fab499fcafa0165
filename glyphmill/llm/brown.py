"""Language-model scores from a class-based bigram model with exchange clustering.

P(word | before) = P(class of word | class before) * P(word | class of word). The classes come from the
exchange algorithm: a word moves to the class that raises the training likelihood most. All words of the training
texts take part, and exchange goes on until no word moves or a sweep over all of them gains nothing:

1. The HEAD most frequent words (a parameter) are first exchanged among themselves on the driver, one after the other and until
   none moves, from their bigram counts over the whole training corpus; all other words stand as one.
2. Then all words are exchanged in rounds. A round counts, for every word, the classes before and after it at all
   its places, and the bigrams of classes. Head words are exchanged as before, now with all neighbours by class (HEAD x 2
   CLASSES counts come to the driver); the others in buckets, each by its own counts against the class counts of the
   round. Words that move at once don't see each other, so a round after the first moves the words of every other bucket
   only, and two rounds make a sweep. Moves that were gains alone may be a loss together; so the classes of the round of greatest likelihood
   are kept, not those of the last.

The gain of a move is exact for head words. For the others the best class is chosen by first order: x more bigrams on
top of m raise m log m by some x log(m + x/e) + x, which is exact at m = 0; for a class's totals this is taken, for
each cell with x = 1, which errs against the move. A word of over FEW places then moves only if the exact gain is positive.

Transitions are then counted over the whole training corpus with every word's final class, and smoothed
towards the class frequencies. Emissions are discounted by DISCOUNT per word type; the discount of a
class is its probability of an unknown word, so probabilities over the V known types and one unknown type
sum to one. As a history, an unknown word counts like a word seen once in training.

How it runs. A piece of texts of at most PIECE_BYTES (or one longer text) is coded once: its distinct words' 64-bit
hashes in order, and the place of each token's word among them. Pieces are stored, bucketed by their number, so that no
round moves them. Words live in buckets by the leading bits of their hash. In a round a piece sends each bucket the
classes around the bucket's words, at most two bytes a token and two counts a class for a word; the bucket answers with a byte
a word. Pieces and buckets are counted by bytes of text, so neither grows with the corpus; their messages are
at most as many as pairs of a piece and a distinct word in it. Words with equal hashes would count as one: among 10^10
types some 3 pairs are expected to.

Cases: null and empty texts score their end token alone; a null id counts as a training id with empty
text; ids that aren't whole numbers raise an error; repeated rows are counted and scored each; with no training
text at all every score is the base score; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Scratch, batches, give_back, giving_back, read_table, shares, word_hashes, words
from .messages import bucket_starts, bytes_apart, bytes_together, pack_hashes, unpack_hashes

HEAD, CLASSES = 1024, 64
DISCOUNT, SMOOTH = 0.5, 40.0
END = np.uint64(0x5EED0F7E87000001)
#: Class of the end token; class of all words outside the head to begin with.
END_CLASS, REST = 0, 1
UNKNOWN, ONCE = CLASSES, 128
#: Bytes of text coded together, and bytes of text for each bucket of words and each stored part of the pieces.
PIECE_BYTES, BUCKET_BYTES, PART_BYTES = 8 << 20, 16 << 20, 32 << 20
#: Bytes of text whose words are found together.
TOKEN_BYTES = 2 << 20
#: A word that a piece has more often is sent as counts of classes.
OFTEN = 64
#: Words with up to so many places are judged place by place.
FEW = 6
_E = np.float32(np.exp(-1))


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' lower-case words, each text followed by the end token; where each begins."""
    w = words(LOWER[data], off)
    n = len(off) - 1
    out = np.full(len(w.s) + n, END, np.uint64)
    first = w.first + np.arange(n + 1)
    out[np.arange(len(w.s)) + w.doc] = word_hashes(w)
    return out, first


def history(seq: np.ndarray, first: np.ndarray, before) -> np.ndarray:
    """Every token's predecessor; at the beginning of a text `before`."""
    out = np.empty_like(seq)
    out[1:] = seq[:-1]
    out[first[:-1]] = before
    return out


def in_order(words_: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of 32-bit numbers, sorted as one number each."""
    both = np.sort((words_ << np.uint64(32)) | places)
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(bytes_apart(x))


def unsqueeze(blob: bytes, kind: str) -> np.ndarray:
    return bytes_together(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), kind)


# ---------------------------------------------------------------- pieces


def code_texts(docs: DataFrame) -> DataFrame:
    """Pieces of the rows (_id, _text, held): ids, held and lengths of the texts, the piece's distinct words
    in order, how often each is in its training texts, and the place of every token's word among them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held_bytes = TaskContext.get().partitionId() << 32, 0
        parts: list[tuple] = []

        def piece() -> pa.RecordBatch:
            ids, held, lengths = ([x for p in parts for x in p[k]] for k in (0, 1, 2))
            own, code = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
            train = np.bincount(code, np.repeat(~np.array(held), lengths), len(own)).astype("<u4")
            lists = [pa.array([x], pa.list_(t)) for x, t in ((ids, pa.int64()), (held, pa.bool_()), (lengths, pa.int64()))]
            blobs = [pa.array([squeeze(x)], pa.binary()) for x in (own, train, code.astype("<u4"))]
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([number]), *lists, *blobs], ["piece", "ids", "held", "lengths", "words", "train", "codes"])

        for batch, data, off in batches(it, "_text", TOKEN_BYTES):
            if parts and held_bytes + len(data) > PIECE_BYTES:
                yield piece()
                number, held_bytes = number + 1, 0
            seq, first = tokens(data, off)
            parts.append((batch.column(0).to_pylist(), batch.column(2).to_pylist(), np.diff(first).tolist(), seq))
            held_bytes += len(data)
        if parts:
            yield piece()
        give_back()

    return docs.mapInArrow(run, "piece bigint, ids array<bigint>, held array<boolean>, lengths array<bigint>, words binary, train binary, codes binary")


class Piece:
    """A stored piece."""

    def __init__(self, row: dict):
        self.number = row["piece"]
        self.words, self.train = unsqueeze(row["words"], "<u8"), unsqueeze(row["train"], "<u4")
        if row.get("codes") is not None:
            self.codes = unsqueeze(row["codes"], "<u4").astype(np.int64)
            self.first = np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int64)
            self.held = np.array(row["held"], bool)

    def places(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted hashes the piece has, and their places in it."""
        at = np.minimum(np.searchsorted(self.words, some), len(self.words) - 1)
        there = np.flatnonzero(self.words[at] == some)
        return there, at[there]

    def training(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The training texts' codes, the word before each (of the end token's place at a text's beginning), and the word behind."""
        end = int(np.searchsorted(self.words, END))
        before, keep = history(self.codes, self.first, end), np.repeat(~self.held, np.diff(self.first))
        after = np.append(self.codes[1:], end)
        return self.codes[keep], before[keep], after[keep]


def pieces_of(it: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    for batch in it:
        for k in range(batch.num_rows):
            yield Piece(batch.slice(k, 1).to_pylist()[0])


def ask_counts(coded: DataFrame, buckets: int) -> DataFrame:
    """To each bucket, per piece: its words in the piece and how often they are in training texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces_of(it):
            at, some, packed = pack_hashes(p.words, buckets)
            times = [squeeze(p.train[at[k] : at[k + 1]]) for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([p.number] * len(some), pa.int64()), pa.array(packed, pa.binary()), pa.array(times, pa.binary())], ["_bucket", "piece", "hashes", "times"])

    return coded.select("piece", "words", "train").mapInArrow(run, "_bucket int, piece bigint, hashes binary, times binary")


_STATE = "_bucket int, words binary, n binary, cls binary, types bigint, tokens bigint, top array<struct<w:bigint,n:bigint>>"


def tally(asked: DataFrame, most: int) -> DataFrame:
    """Each bucket's words, their training counts, and its `most` most frequent ones."""

    @giving_back
    def run(table: pa.Table) -> pa.Table:
        hs = [unpack_hashes(x.as_py()) for x in table.column("hashes")]
        ns = [unsqueeze(x.as_py(), "<u4") for x in table.column("times")]
        w, place = np.unique(np.concatenate(hs), return_inverse=True)
        n = np.bincount(place, np.concatenate(ns), len(w)).astype(np.int64)
        top = np.lexsort((w.view(np.int64), -n))[:most]
        top = top[n[top] > 0]
        rows = [{"w": int(a), "n": int(b)} for a, b in zip(w[top].view(np.int64).tolist(), n[top].tolist(), strict=True)]
        return pa.table(
            {
                "_bucket": pa.array([table.column("_bucket")[0].as_py()], pa.int32()),
                "words": pa.array([squeeze(w)], pa.binary()),
                "n": pa.array([squeeze(n)], pa.binary()),
                "cls": pa.array([squeeze(np.where(n > 0, REST, UNKNOWN).astype(np.uint8))], pa.binary()),
                "types": pa.array([int((n > 0).sum())]),
                "tokens": pa.array([int(n.sum())]),
                "top": pa.array([rows], pa.list_(pa.struct([("w", pa.int64()), ("n", pa.int64())]))),
            }
        )

    return asked.groupBy("_bucket").applyInArrow(run, _STATE)


def summed(cells: DataFrame, size: int) -> np.ndarray:
    """The sums of (cells, times) arrays by cell, of at most `size` cells."""
    zipped = cells.where("cells is not null").select(F.explode(F.arrays_zip("cells", "times")).alias("x")).select("x.cells", "x.times")
    got = zipped.groupBy("cells").agg(F.sum("times").alias("times")).toArrow()
    out = np.zeros(size)
    out[np.asarray(got.column("cells").combine_chunks())] = np.asarray(got.column("times").combine_chunks())
    return out


# ---------------------------------------------------------------- exchange


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(m: np.ndarray) -> float:
    """What of the training log-likelihood depends on the classes."""
    return float(_f(m).sum() - _f(m.sum(0)).sum() - _f(m.sum(1)).sum())


def gains(m: np.ndarray, right: np.ndarray, left: np.ndarray, s: float) -> np.ndarray:
    """Change of `likelihood` for each class that a word would be put in: m: class bigrams without those of the
    word; right, left: its bigrams with the class after, before it, s with itself."""
    # class totals with the bigrams that the word has with them: the same wherever it goes
    rows, cols, diag = m.sum(1) + left, m.sum(0) + right, np.diag(m)
    gain = (_f(m + right) - _f(m)).sum(1) + (_f(m + left[:, None]) - _f(m)).sum(0)
    gain -= _f(diag + right) + _f(diag + left) - 2 * _f(diag)
    gain += _f(diag + right + left + s) - _f(diag)
    return gain - (_f(rows + right.sum() + s) - _f(rows) + _f(cols + left.sum() + s) - _f(cols))


def spread_out(n: int, by_count: np.ndarray, fixed: dict[int, int], classes: int = CLASSES) -> np.ndarray:
    """Classes to begin with: in turn to the words by falling count, but for the fixed ones."""
    of, open_classes = np.zeros(n, np.int64), [c for c in range(classes) if c not in fixed.values()]
    free = [w for w in np.argsort(-by_count, kind="stable").tolist() if w not in fixed]
    of[free] = np.resize(open_classes, len(free))
    for w, c in fixed.items():
        of[w] = c
    return of


def by_class(grams: np.ndarray, of: np.ndarray, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bigram count table: class bigrams, and each word's counts with the class after it and before it."""
    member = np.zeros((len(grams), classes))
    member[np.arange(len(grams)), of] = 1
    return member.T @ grams @ member, grams @ member, grams.T @ member


def exchange(grams: np.ndarray, of: np.ndarray, stay: set[int], m: np.ndarray, to_class: np.ndarray, from_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of words, and class bigrams, after exchange until none moves, but for those that stay. grams: bigram counts among the
    words; m, to_class, from_class: as by_class gives them, with other words too, whose classes stay."""
    of, m, to_class, from_class = of.copy(), m.copy(), to_class.copy(), from_class.copy()
    free = [w for w in np.argsort(-(to_class.sum(1) + from_class.sum(1)), kind="stable").tolist() if w not in stay]
    closed = list({int(of[w]) for w in stay})
    least = 1e-9 * max(1.0, float(m.sum()))  # beyond rounding, so that every move raises the likelihood
    moved = 1
    while moved:
        moved = 0
        for w in free:
            a, s = of[w], grams[w, w]
            right, left = to_class[w].copy(), from_class[w].copy()
            right[a] -= s
            left[a] -= s
            m[a] -= right
            m[:, a] -= left
            m[a, a] -= s
            gain = gains(m, right, left, s)
            gain[[c for c in closed if c != a]] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + least:
                b = a
            m[b] += right
            m[:, b] += left
            m[b, b] += s
            if b != a:
                of[w] = b
                moved += 1
                to_class[:, a] -= grams[:, w]
                to_class[:, b] += grams[:, w]
                from_class[:, a] -= grams[w]
                from_class[:, b] += grams[w]
    return of, m


def better_class(m: np.ndarray, n: np.ndarray, cls: np.ndarray, left: np.ndarray, right: np.ndarray, word: np.ndarray, vectors: dict[int, np.ndarray]) -> np.ndarray:
    """The best class of each word, by first-order gains. left, right: classes around the places of `word`
    (sorted); vectors: for some words, further places as counts of the classes before and after."""
    m = np.maximum(m, 0).astype(np.float32)
    rows, cols = m.sum(1), m.sum(0)
    # what a place between classes (l, r) says for each class
    into = np.log(m + _E)  # [l]: a class after l
    out = into.T.copy()  # [r]: a class before r

    def totals(n: np.ndarray) -> np.ndarray:
        x = (n * _E)[:, None]
        return n[:, None] * (np.log(rows + x) + np.log(cols + x))

    out[:, END_CLASS] = into[:, END_CLASS] = -1e9
    best = cls.copy()
    places = np.bincount(word, minlength=len(cls))
    for k in vectors:
        places[k] += FEW + 1
    starts = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(cls)))])
    few = np.flatnonzero((places > 0) & (places <= FEW))
    for lo in range(0, len(few), 1 << 16):
        some = few[lo : lo + (1 << 16)]
        take = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(places[some])[:-1]]), places[some]) + np.arange(int(places[some].sum()))
        who, l, r = np.repeat(np.arange(len(some)), places[some]), left[take], right[take]
        total = places[some].astype(np.float32)
        score = np.add.reduceat(into[l] + out[r], np.searchsorted(who, np.arange(len(some)))) - totals(total)
        own = cls[some][who]
        n = total[who]
        less = (m[own, r], np.float32(1)), (m[l, own], np.float32(1)), (rows[own], n), (cols[own], n)
        a, b, c, d = (np.log(np.maximum(x - k, 0) + k * _E) for x, k in less)
        stay = np.bincount(who, a + b - c - d, len(some))
        top = score.argmax(1)
        gain = score[np.arange(len(some)), top] - stay
        best[some] = np.where((top != cls[some]) & (gain > 1e-3 * places[some]), top, cls[some])
    many = np.flatnonzero(places > FEW)
    for lo in range(0, len(many), 1 << 13):
        some = many[lo : lo + (1 << 13)]
        number = np.full(int(some[-1] - some[0]) + 1, -1, np.int64)
        number[some - some[0]] = np.arange(len(some))
        x, y = starts[some[0]], starts[some[-1] + 1]
        who = number[word[x:y] - some[0]]
        ok = who >= 0
        side = lambda z, who=who, ok=ok, x=x, y=y, k=len(some): np.bincount(who[ok] * CLASSES + z[x:y][ok], minlength=k * CLASSES).reshape(-1, CLASSES).astype(np.float32)
        ln, rn = side(left), side(right)
        for i, k in enumerate(some.tolist()):
            if k in vectors:
                ln[i] += vectors[k][0]
                rn[i] += vectors[k][1]
        own, total = cls[some], ln.sum(1)
        top = (rn @ out + ln @ into - totals(total)).argmax(1)
        go = np.flatnonzero(top != own)
        ln, rn, total, own, top = ln[go], rn[go], total[go], own[go], top[go]
        more = lambda x, y: _f(np.maximum(x + y, 0).astype(np.float64)) - _f(np.maximum(x, 0).astype(np.float64))
        gain = more(m[top], rn).sum(1) + more(m.T[top], ln).sum(1) - more(rows[top], total) - more(cols[top], total)
        gain += more(m[own], -rn).sum(1) + more(m.T[own], -ln).sum(1) - more(rows[own], -total) - more(cols[own], -total)
        best[some[go]] = np.where(gain > 1e-3 * total, top, own)
    return best


class Head:
    """The most frequent words, the end token first: hashes, and classes."""

    def __init__(self, w: np.ndarray):
        self.w, self.of = w, np.full(len(w), REST)
        self.of[0] = END_CLASS
        self.sort = np.argsort(w)

    def places(self, p: Piece) -> tuple[np.ndarray, np.ndarray]:
        """(number, place) of the head words that the piece has."""
        there, at = p.places(self.w[self.sort])
        return self.sort[there], at


def head_bigrams(coded: DataFrame, head: Head) -> np.ndarray:
    """Counts of neighbours among the head's words and all others (last)."""
    size = len(head.w) + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces_of(it):
            number, at = head.places(p)
            rank = np.full(len(p.words), size - 1)
            rank[at] = number
            code, before, _ = p.training()
            cells, times = np.unique(rank[before] * size + rank[code], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([cells.tolist()], pa.list_(pa.int64())), pa.array([times.tolist()], pa.list_(pa.int64()))], ["cells", "times"])

    return summed(coded.mapInArrow(run, "cells array<bigint>, times array<bigint>"), size * size).reshape(size, size)


def asked_words(p: Piece, head: Head) -> np.ndarray:
    """The places of the words that rounds ask for: those in training texts, without the head's."""
    ask = p.train > 0
    ask[head.places(p)[1]] = False
    return np.flatnonzero(ask)


def classes_in(p: Piece, head: Head, ask: np.ndarray, edges: np.ndarray, answers: Iterator[tuple[int, bytes]]) -> np.ndarray:
    """The class of every word of a piece. edges: where each bucket's words begin among the asked ones."""
    own = np.full(len(ask), REST, np.uint8)
    for k, blob in answers:
        own[edges[k] : edges[k + 1]] = unsqueeze(blob, "u1")
    cls = np.full(len(p.words), REST, np.uint8)
    cls[ask] = own
    number, at = head.places(p)
    cls[at] = head.of[number]
    return cls


def look_around(coded: DataFrame, answers: DataFrame | None, head: Head, buckets: int, parity: int | None) -> DataFrame:
    """A round's messages (_bucket, piece, hashes, around) to the buckets of a parity (all), and its counts (cells,
    times): the head words' neighbours by class, then the bigrams of classes."""

    def one(p: Piece, replies: Iterator[tuple[int, bytes]]) -> pa.Table:
        ask = asked_words(p, head)
        edges = bucket_starts(p.words[ask], buckets)
        cls = classes_in(p, head, ask, edges, replies)
        # classes are a byte each: they are shifted and cut, not the words
        own, end, keep = cls[p.codes], cls[np.searchsorted(p.words, END)], np.repeat(~p.held, np.diff(p.first))
        code, mid, l, r = p.codes[keep], own[keep], history(own, p.first, end)[keep], np.append(own[1:], end)[keep]
        number, at = head.places(p)
        of = np.full(len(p.words), -1)
        of[at] = number
        mine = of[code]
        some = np.flatnonzero(mine >= 0)
        base = mine[some] * 2 * CLASSES
        cells = np.bincount(np.concatenate([base + l[some], base + CLASSES + r[some]]), minlength=len(head.w) * 2 * CLASSES)
        cells = np.concatenate([cells, np.bincount(l.astype(np.int64) * CLASSES + mid, minlength=CLASSES * CLASSES)])
        full = np.flatnonzero(cells)
        # the other words' places, word by word
        turn = np.full(len(p.words), -1)
        which = np.searchsorted(edges, np.arange(len(ask)), "right") - 1
        go = np.ones(len(ask), bool) if parity is None else which % 2 == parity
        turn[ask[go]] = np.arange(int(go.sum()))
        who = turn[code]
        some = np.flatnonzero(who >= 0)
        who, some = in_order(who[some].astype(np.uint64), some.astype(np.uint64))
        l, r = l[some], r[some]
        times = np.bincount(who, minlength=int(go.sum()))
        often = np.flatnonzero(times > OFTEN)
        mark = np.full(len(times), -1)
        mark[often] = np.arange(len(often))
        hot = mark[who]
        thick = np.flatnonzero(hot >= 0)
        vector = np.stack([np.bincount(hot[thick] * CLASSES + z[thick], minlength=len(often) * CLASSES).reshape(-1, CLASSES) for z in (l, r)], 1).astype("<u4")
        thin = np.flatnonzero(hot < 0)
        l, r, who = l[thin], r[thin], who[thin]
        h = p.words[ask[go]]
        at, ks, packed = pack_hashes(h, buckets)
        upto, vat = np.searchsorted(who, at), np.searchsorted(often, at)
        press, around = zstandard.ZstdCompressor(level=1), []
        for k in ks:
            t = times[at[k] : at[k + 1]].astype("<u4")
            around.append(press.compress(bytes_apart(t) + l[upto[k] : upto[k + 1]].tobytes() + r[upto[k] : upto[k + 1]].tobytes() + vector[vat[k] : vat[k + 1]].tobytes()))
        n = len(ks)
        return pa.table(
            {
                "_bucket": pa.array([None, *ks], pa.int32()),
                "piece": pa.array([p.number] * (n + 1), pa.int64()),
                "hashes": pa.array([None, *packed], pa.binary()),
                "around": pa.array([None, *around], pa.binary()),
                "cells": pa.array([full.tolist(), *[None] * n], pa.list_(pa.int64())),
                "times": pa.array([cells[full].tolist(), *[None] * n], pa.list_(pa.int64())),
            }
        )

    schema = "_bucket int, piece bigint, hashes binary, around binary, cells array<bigint>, times array<bigint>"
    if answers is None:

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p in pieces_of(it):
                yield from one(p, iter(())).to_batches()

        return coded.mapInArrow(run, schema)

    @giving_back
    def both(own: pa.Table, replies: pa.Table) -> pa.Table:
        pairs = zip(replies.column("_bucket").to_pylist(), replies.column("cls").to_pylist(), strict=True)
        return one(Piece(own.to_pylist()[0]), pairs)

    return coded.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(both, schema)


_MOVED = "_bucket int, piece bigint, words binary, n binary, cls binary, moved bigint"


def move_words(messages: DataFrame, state: DataFrame, m: np.ndarray) -> DataFrame:
    """The buckets' words with their new classes (piece null), and the classes that each piece asked for."""

    @giving_back
    def run(asked: pa.Table, own: pa.Table) -> pa.Table:
        if not len(own):
            raise ValueError("words of no bucket")
        w, n, cls = (unsqueeze(own.column(c)[0].as_py(), t) for c, t in (("words", "<u8"), ("n", "<i8"), ("cls", "u1")))
        words_, ls, rs, at, vectors = [], [], [], [], {}
        for a, b in zip(asked.column("hashes"), asked.column("around"), strict=True):
            h = unpack_hashes(a.as_py())
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b.as_py()), np.uint8)
            place = np.searchsorted(w, h)
            times = bytes_together(raw[: 4 * len(h)], "<u4").astype(np.int64)
            thin = np.where(times <= OFTEN, times, 0)
            k, total = 4 * len(h), int(thin.sum())
            ls.append(raw[k : k + total]), rs.append(raw[k + total : k + 2 * total])
            words_.append(np.repeat(place, thin)), at.append(place)
            for i, v in zip(place[times > OFTEN].tolist(), raw[k + 2 * total :].view("<u4").reshape(-1, 2, CLASSES), strict=True):
                vectors[i] = vectors[i] + v if i in vectors else v.astype(np.float32)
        new = cls.astype(np.int64)
        if at:
            word = np.concatenate(words_).astype(np.uint64)
            word, order = in_order(word, np.arange(len(word), dtype=np.uint64))
            l, r = (np.concatenate(x)[order].astype(np.int64) for x in (ls, rs))
            new = better_class(m, n, new, l, r, word, vectors)
        number, k = own.column("_bucket")[0].as_py(), len(at)
        pieces = asked.column("piece").to_pylist()
        return pa.table(
            {
                "_bucket": pa.array([number] * (k + 1), pa.int32()),
                "piece": pa.array([None, *pieces], pa.int64()),
                "words": pa.array([own.column("words")[0].as_py(), *[None] * k], pa.binary()),
                "n": pa.array([own.column("n")[0].as_py(), *[None] * k], pa.binary()),
                "cls": pa.array([squeeze(new.astype(np.uint8)), *(squeeze(new[x].astype(np.uint8)) for x in at)], pa.binary()),
                "moved": pa.array([int(n[new != cls].sum()), *[None] * k], pa.int64()),
            }
        )

    return messages.groupBy("_bucket").cogroup(state.groupBy("_bucket")).applyInArrow(run, _MOVED)


@dataclass
class Round:
    """Classes of all words: their likelihood, the head's, the other words' by parity of their buckets, and how many training
    tokens belong to words that the two rounds before moved."""

    likelihood: float
    head: np.ndarray
    states: list[DataFrame]
    moved: int


def cluster(coded: DataFrame, state: DataFrame, head: Head, n: int, buckets: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Exchange until a sweep gains nothing: the buckets with their words' best classes (the head's are in `head`), and
    how many training tokens belong to words that the sweep before moved."""
    grams, fixed = head_bigrams(coded, head), {0: END_CLASS, len(head.w): REST}
    of = spread_out(len(grams), grams.sum(0) + grams.sum(1), fixed)
    head.of = exchange(grams, of, set(fixed), *by_class(grams, of))[0][:-1]
    grams = grams[:-1, :-1]
    columns = ("_bucket", "words", "n", "cls")
    states: list[DataFrame] = [state.where(F.col("_bucket") % 2 == k).select(*columns) for k in (0, 1)]
    answers: list[DataFrame] = []
    rounds: list[Round] = []
    moved = [0, 0]
    while True:
        turn = len(rounds)
        parity = turn % 2 if turn else None
        told = scratch.put(look_around(coded, answers[0].unionByName(answers[1]) if answers else None, head, buckets, parity), f"around-{turn}")
        cells = summed(told.select("cells", "times"), len(head.w) * 2 * CLASSES + CLASSES * CLASSES)
        around, m = cells[: len(head.w) * 2 * CLASSES].reshape(-1, 2, CLASSES), cells[len(head.w) * 2 * CLASSES :].reshape(CLASSES, CLASSES)
        rounds.append(Round(likelihood(m), head.of, list(states), sum(moved)))
        # turn 1 is the first that all words have classes in, so a sweep's gain is known from turn 3 on
        if turn >= 3 and (rounds[-1].likelihood <= rounds[-3].likelihood or not rounds[-1].moved):
            break
        new, m = exchange(grams, head.of, {0}, m, around[:, 1], around[:, 0])
        shifted = int(around[new != head.of, 0].sum())
        head.of = new
        own = states[0].unionByName(states[1]) if parity is None else states[parity]
        done = scratch.put(move_words(told.where("_bucket is not null").select("_bucket", "piece", "hashes", "around"), own, m), f"moved-{turn}")
        scratch.drop(f"around-{turn}")
        if not answers:
            answers = [done] * 2
        for k in (0, 1) if parity is None else (parity,):
            part = done.where(F.col("_bucket") % 2 == k)
            answers[k], states[k] = part.where("piece is not null").select("_bucket", "piece", "cls"), part.where("piece is null").select(*columns)
        if turn >= 4:  # the last three rounds' buckets may be the best ones
            scratch.drop(f"moved-{turn - 4}")
        moved[turn % 2] = int(done.agg(F.sum("moved")).first()[0] or 0) + shifted
    best = max(rounds[-3:], key=lambda r: r.likelihood)
    head.of = best.head
    return best.states[0].unionByName(best.states[1]), best.moved


# ---------------------------------------------------------------- scores


def encode(coded: DataFrame, asked: DataFrame, state: DataFrame, head: Head, emission: np.ndarray, n: int, v: int, buckets: int) -> DataFrame:
    """Per text: _id, held, n_tokens, n_known, base_score, emitted (log10 of the emissions of its known
    words) and codes (compressed: a byte a token, its class or UNKNOWN, with ONCE added if seen once)."""

    @giving_back
    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        w, count, cls = (unsqueeze(own.column(c)[0].as_py(), t) for c, t in (("words", "<u8"), ("n", "<i8"), ("cls", "u1")))
        facts = []
        for blob in asked.column("hashes"):
            k = np.searchsorted(w, unpack_hashes(blob.as_py()))
            facts.append(zstandard.ZstdCompressor(level=1).compress(bytes_apart(count[k]) + cls[k].tobytes()))
        return pa.table({"piece": asked.column("piece").cast(pa.int64()), "_bucket": asked.column("_bucket").cast(pa.int32()), "facts": pa.array(facts, pa.binary())})

    @giving_back
    def settle(own: pa.Table, replies: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        p = Piece(row)
        at = bucket_starts(p.words, buckets)
        count, cls = np.zeros(len(p.words), np.int64), np.full(len(p.words), UNKNOWN, np.uint8)
        for k, facts in zip(replies.column("_bucket").to_pylist(), replies.column("facts"), strict=True):
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(facts.as_py()), np.uint8)
            size = int(at[k + 1] - at[k])
            count[at[k] : at[k + 1]], cls[at[k] : at[k + 1]] = bytes_together(raw[: 8 * size], "<i8"), raw[8 * size :]
        number, place = head.places(p)
        cls[place] = np.where(count[place] > 0, head.of[number], UNKNOWN)
        base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        emit = np.where(count > 0, np.log10(np.maximum(count - DISCOUNT, 1e-9)) - emission[np.minimum(cls, CLASSES - 1)], 0.0)
        code = cls + np.where(count == 1, ONCE, 0).astype(np.uint8)
        sums = lambda x: np.add.reduceat(x, p.first[:-1])  # noqa: E731  every text has its end token
        codes, press = code[p.codes], zstandard.ZstdCompressor(level=1)
        return pa.table(
            {
                "_id": pa.array(row["ids"], pa.int64()),
                "held": pa.array(p.held),
                "n_tokens": pa.array(np.diff(p.first)),
                "n_known": pa.array(sums((count > 0).astype(np.int64)[p.codes])),
                "base_score": pa.array(sums(base[p.codes])),
                "emitted": pa.array(sums(emit[p.codes])),
                "codes": pa.array([press.compress(codes[a:b].tobytes()) for a, b in zip(p.first[:-1], p.first[1:], strict=True)], pa.binary()),
            }
        )

    answered = asked.groupBy("_bucket").cogroup(state.groupBy("_bucket")).applyInArrow(answer, "piece bigint, _bucket int, facts binary")
    return coded.groupBy("piece").cogroup(answered.groupBy("piece")).applyInArrow(
        settle, "_id bigint, held boolean, n_tokens bigint, n_known bigint, base_score double, emitted double, codes binary"
    )


def decoded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' codes: class of each token, class as a history, and where each text begins."""
    raw = [zstandard.ZstdDecompressor().decompress(b.as_py()) for b in batch.column(batch.schema.get_field_index("codes"))]
    code = np.frombuffer(b"".join(raw), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    cls = (code & 127).astype(np.int64)
    return cls, np.where(code >= ONCE, UNKNOWN, cls), first


def transitions(texts: DataFrame) -> np.ndarray:
    """Counts of (history, class) over the training texts: CLASSES + 1 rows, the last for words seen once."""
    size = (CLASSES + 1) * (CLASSES + 1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in it:
            if batch.num_rows:
                cls, past, first = decoded(batch)
                total += np.bincount(history(past, first, END_CLASS) * (CLASSES + 1) + cls, minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([some.tolist()], pa.list_(pa.int64())), pa.array([total[some].tolist()], pa.list_(pa.int64()))], ["cells", "times"])

    out = summed(texts.where("not held").select("codes").mapInArrow(run, "cells array<bigint>, times array<bigint>"), size)
    return out.reshape(CLASSES + 1, CLASSES + 1)[:, :CLASSES]


def class_sizes(state: DataFrame, head: Head) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and known types of each class."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                w, n, cls = (unsqueeze(row[c], t) for c, t in (("words", "<u8"), ("n", "<i8"), ("cls", "u1")))
                own = cls.astype(np.int64)
                at = np.minimum(np.searchsorted(w, head.w), max(len(w) - 1, 0))
                there = np.flatnonzero(w[at] == head.w) if len(w) else at[:0]
                own[at[there]] = np.where(n[at[there]] > 0, head.of[there], UNKNOWN)
                cells = np.concatenate([np.bincount(own, n, UNKNOWN + 1)[:CLASSES], np.bincount(own, minlength=UNKNOWN + 1)[:CLASSES]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([list(range(2 * CLASSES))], pa.list_(pa.int64())), pa.array([cells.tolist()], pa.list_(pa.int64()))], ["cells", "times"])

    out = summed(state.select("words", "n", "cls").mapInArrow(run, "cells array<bigint>, times array<bigint>"), 2 * CLASSES)
    return out[:CLASSES], out[CLASSES:]


def smoothed(t: np.ndarray, size: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(class | history), and P(an unknown word | history): the discount of what the classes emit."""
    prior = (size + 1e-9) / (size + 1e-9).sum()
    p = t + SMOOTH * prior
    p /= p.sum(1, keepdims=True)
    return p, p @ (DISCOUNT * types / np.maximum(size, 1))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, classes (number in use) and moving_tokens
    (training tokens of words that the last sweep before the best classes moved)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), held_out(id_col).alias("held"))
    parts = shares(own, "_text", PART_BYTES)
    buckets = max(2, shares(own, "_text", BUCKET_BYTES))
    coded = scratch.put_bucketed(code_texts(own), "pieces", "piece", parts)
    asked = ask_counts(coded, buckets)
    state = scratch.put(tally(asked, head_words), "words")
    v, n = state.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    end = int(END.view(np.int64))
    top = state.select(F.explode("top").alias("x")).select("x.*").where(F.col("w") != end).orderBy(F.desc("n"), "w").limit(head_words - 1).collect() if n else []  # so many rows at most
    head = Head(np.array([end, *(r.w for r in top)], np.int64).view(np.uint64))
    state, moving = cluster(coded, state, head, n, buckets, scratch) if n else (state.select("_bucket", "words", "n", "cls"), 0)
    size, types = class_sizes(state, head)
    coded_texts = scratch.put(encode(coded, asked, state, head, np.log10(np.maximum(size, 1)), n, v, buckets), "codes")
    p, unknown = smoothed(transitions(coded_texts), size, types)
    # a class without words can't emit: its column is never asked for
    table = np.log10(np.concatenate([p, np.maximum(unknown, 1e-12)[:, None]], 1))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            cls, past, first = decoded(batch)
            steps = np.add.reduceat(table[history(past, first, END_CLASS), cls], first[:-1])
            total = steps + np.asarray(batch.column(5))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(total)], ["_id", "held", "n_tokens", "n_known", "base_score", "score"])

    scored = coded_texts.mapInArrow(run, "_id bigint, held boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(
        F.col("_id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score",
        (F.col("score") if n else F.col("base_score")).alias("score"), F.lit(int((size > 0).sum())).cast("long").alias("classes"), F.lit(moving).cast("long").alias("moving_tokens"),
    )


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))
