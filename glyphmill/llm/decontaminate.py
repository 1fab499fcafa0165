"""Benchmark decontamination by CGK embeddings and bit-sampling LSH, confirmed by edit distance.

Texts and items are sequences of normal words: lower case, ASCII letters and digits and all non-ASCII
bytes count, everything else separates. A text leaks an item of n words if a run of its words is within
floor(EDITS * n) word edits (insertion, deletion, replacement) of the item.

The CGK embedding walks along a sequence with shared random bits: at step j it writes the word it stands
on and moves on by one if bit j of the word's hash says so. Two walks that part over an edit meet again only by
chance, and with one word in five edited they would mostly be apart from the first edits on. So an item-sized window is
embedded as STARTS walks, begun at words spread evenly over it, one behind the other; an edit spoils the walks that
cross it only. Each of REPEATS independent embeddings is sampled at SAMPLE steps of one of its walks; items and
windows with equal samples of the same walk are candidates. A walk is the same in all windows that it is part of,
so the documents' are made once for each word, and what an item is entered under says where its window begins.
REPEATS and STARTS are set such that an item of over SHORT words with the
full number of allowed edits is still retrieved with probability over 0.99 (tests hold it to that, by length and share).
Walks over shorter items mostly end in padding, so these are retrieved without loss, by the runs of words that
the edits must leave untouched.
Candidates are confirmed exactly, by the least edit distance of the item to any run around the place.

Windows are taken at every word, but a window is embedded only if it can matter: k edits change at most
k * q of an item's n - q + 1 runs of q words, so each leak has the other runs verbatim within n + k words,
and windows further than an item's length from every place with so many runs are skipped. The screen
loses nothing.

The item table is the benchmark's and is bounded by MAX_ITEM_BYTES, which is checked; beyond it the items
are handled in groups, one pass over the documents each.

Cases: null or empty texts leak nothing; items without words (null or empty) are never found; an item of
one or two words needs an exact run; copies of an item are found each under its own id; rows are found
once each, also with null or repeated ids; an empty table of either kind gives no finds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, batches, inside_doc, keep_rows, mix, read_table, text_bytes, window_hashes, word_hashes, words

EDITS = 0.2
#: Words in the runs that the screen counts, for items long enough.
RUN = 3
REPEATS, STEPS, SAMPLE, STARTS = 12, 12, 5, 8
#: Items of up to so many words are retrieved by their untouched runs.
SHORT = SAMPLE + 2
#: Places of short items' runs looked at together.
PLACES = 1 << 20
MAX_ITEM_BYTES = 32 << 20

APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BITS = np.random.default_rng(7).integers(1, 2**63, REPEATS, dtype=np.uint64)
_PICKS = np.stack([np.sort(np.random.default_rng(70 + r).choice(STEPS, SAMPLE, replace=False)) for r in range(REPEATS)])


def normal_words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words and their hashes, of texts in lower case."""
    data, off = text_bytes(pc.utf8_lower(texts))
    w = words(data, off, APART)
    return w, word_hashes(w)


def sketch(h: np.ndarray, start: np.ndarray, end: np.ndarray, repeat: int) -> np.ndarray:
    """The samples, as one hash, of the CGK walks from `start` (ends: one past the last word of each
    window; a walk that gets there writes padding)."""
    at = start.copy()
    bits = mix(h ^ _BITS[repeat])
    key = np.full(len(start), repeat + 1, np.uint64)
    last = len(h) - 1
    picks = set(_PICKS[repeat].tolist())
    for j in range(int(_PICKS[repeat][-1]) + 1):
        inside = at < end
        word = np.minimum(at, last)
        if j in picks:
            key = mix(key * np.uint64(31) + np.where(inside, h[word], np.uint64(0)))
        at += np.where(inside, (bits[word] >> np.uint64(j)).astype(np.int64) & 1, 1)
    return key


def _scores(item: list, run: list, anchored: bool) -> Iterator[int]:
    """After each word of `run`, the least edit distance of the item to what ends there and begins anywhere (or, if
    anchored, at the beginning). A column of the table is kept as two numbers whose bits are its steps up and down."""
    n = len(item)
    same: dict = {}
    for k, x in enumerate(item):
        same[x] = same.get(x, 0) | 1 << k
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    for x in run:
        eq = same.get(x, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        more, less = down | ~(diagonal | up) & full, up & diagonal
        score += bool(more & last) - bool(less & last)
        more, less = more << 1 | anchored, less << 1
        eq |= down
        up, down = (less | ~(eq | more)) & full, more & eq & full
        yield score


def edit_distance(item: np.ndarray, run: np.ndarray, most: int) -> tuple[int, int, int]:
    """The least edit distance of the item to any run of consecutive words of `run` (most + 1 if it is
    over `most`), and where the first such run ends and the shortest one that ends there begins."""
    item, run = item.tolist(), run.tolist()
    best, end = len(item), 0
    for j, score in enumerate(_scores(item, run, False), 1):
        if score < best:
            best, end = score, j
    if best > most:
        return most + 1, 0, 0
    if best == len(item):
        return best, end, end
    back = run[:end][::-1]
    return best, end - next(j for j, score in enumerate(_scores(item[::-1], back, True), 1) if score == best), end


@dataclass
class Items:
    """The benchmark as its words' hashes, the screen's runs and the LSH tables."""

    ids: list
    h: np.ndarray
    first: np.ndarray
    most: np.ndarray
    runs: list[tuple[int, np.ndarray, np.ndarray, int, int]]
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    longest: int
    pieces: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list, texts: list[str | None]) -> Items:
        w, h = normal_words(pa.array(texts, pa.large_string()))
        n = w.counts
        most = np.floor(EDITS * n + 1e-9).astype(np.int64)
        # k edits leave a run of ceil((n - k) / (k + 1)) words at least: shorter items are screened by shorter runs
        need = np.minimum(RUN, -(-(n - most) // (most + 1)))
        doc, runs = w.doc, []
        pieces = []
        for q in sorted(set(need[(n > 0) & (n <= SHORT)].tolist())):
            of = doc[: max(0, len(doc) - q + 1)]
            at = np.flatnonzero(inside_doc(w, q) & (need[of] == q) & (n[of] <= SHORT))
            key = window_hashes(h, q)[at]
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            known = np.zeros(1 << 20, bool)
            known[(key >> np.uint64(44)).astype(np.int64)] = True
            pieces.append((q, key, known, doc[at], at - w.first[doc[at]]))
        for q in sorted(set(need[n > SHORT].tolist())):
            own = np.flatnonzero((n > SHORT) & (need == q))
            of = doc[: max(0, len(doc) - q + 1)]
            ok = np.flatnonzero(inside_doc(w, q) & (need[of] == q) & (n[of] > SHORT))
            keys = np.unique(window_hashes(h, q)[ok])
            known = np.zeros(1 << 20, bool)
            known[(keys >> np.uint64(44)).astype(np.int64)] = True
            # Cut each item's n + k words into stretches of the shortest one's: one has its share of the runs.
            span = n[own] + most[own]
            left = np.maximum(1, n[own] - q + 1 - most[own] * q)
            short = int(span.min())
            runs.append((q, keys, known, short, int((-(-left // -(-span // short))).min())))
        tables = []
        for r in range(REPEATS):
            some = np.flatnonzero(n > SHORT)
            # word positions where an item is entered: evenly over it, as far as a walk has words left
            room = np.maximum(n[some] - SAMPLE, 0)
            starts = [np.unique(np.round(np.linspace(0, x, STARTS)).astype(np.int64)) for x in room]
            item = np.repeat(some, [len(s) for s in starts])
            offset = np.concatenate(starts) if starts else np.zeros(0, np.int64)
            key = sketch(h, w.first[item] + offset, w.first[item + 1], r) if len(item) else np.zeros(0, np.uint64)
            order = np.argsort(key, kind="stable")
            tables.append((key[order], item[order], offset[order]))
        return cls(ids, h, w.first, most, runs, tables, int((n + most).max(initial=0)), pieces)

    def candidates(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, about where the item begins) of windows whose samples equal an item's."""
        near = self.near(w, h)
        found = []
        doc = w.doc
        start = np.flatnonzero(near)
        if len(start):
            end = w.first[doc[start] + 1]
            for r, (key, item, offset) in enumerate(self.tables):
                mine = sketch(h, start, end, r)
                lo, hi = np.searchsorted(key, mine), np.searchsorted(key, mine, "right")
                hit = np.flatnonzero(hi > lo)
                if not len(hit):
                    continue
                times = hi[hit] - lo[hit]
                which = np.repeat(lo[hit], times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
                who = np.repeat(hit, times)
                found.append(np.stack([doc[start[who]], item[which], start[who] - offset[which]], 1))
        short = self._short(w, h, doc)
        found += [short] if len(short) else []
        if not found:
            return (np.zeros(0, np.int64),) * 3
        out = np.unique(np.concatenate(found), axis=0)
        return out[:, 0], out[:, 1], out[:, 2]

    def near(self, w: Words, h: np.ndarray) -> np.ndarray:
        """Which words are close enough before or after an untouched run of some item."""
        edge = np.zeros(len(h) + 1, np.int64)
        for q, keys, known, short, least in self.runs:
            win = window_hashes(h, q)
            at = np.flatnonzero(known[(win >> np.uint64(44)).astype(np.int64)])
            at = at[keys[np.minimum(np.searchsorted(keys, win[at]), len(keys) - 1)] == win[at]]
            if len(at) < least:
                continue
            # places where `least` hits begin within `short` words
            at = at[: len(at) - least + 1][at[least - 1 :] - at[: len(at) - least + 1] < short]
            np.add.at(edge, np.maximum(at - self.longest, 0), 1)
            np.add.at(edge, np.minimum(at + short + self.longest, len(h)), -1)
        return np.cumsum(edge[:-1]) > 0

    def _short(self, w: Words, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Places of short items: where an untouched run of theirs stands, and all but the edited words stand
        around it, each moved by no more words than there may be edits."""
        out = [np.zeros((0, 3), np.int64)]
        for q, key, known, item, offset in self.pieces:
            win = window_hashes(h, q)
            at = np.flatnonzero(known[(win >> np.uint64(44)).astype(np.int64)] & inside_doc(w, q))
            lo, hi = np.searchsorted(key, win[at]), np.searchsorted(key, win[at], "right")
            at, lo, times = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            upto = np.concatenate([[0], np.cumsum(times)])
            for first in range(0, int(upto[-1]), PLACES):
                pair = np.arange(first, min(first + PLACES, int(upto[-1])))
                who = np.searchsorted(upto, pair, "right") - 1
                piece = lo[who] + pair - upto[who]
                mine, start = item[piece], at[who] - offset[piece]
                text = doc[at[who]]
                begin, end = w.first[text], w.first[text + 1]
                n, most = self.first[mine + 1] - self.first[mine], self.most[mine]
                same = np.zeros(len(mine), np.int64)
                for j in range(int(n.max())):
                    word = self.h[np.minimum(self.first[mine] + j, len(self.h) - 1)]
                    met = np.zeros(len(mine), bool)
                    for d in range(-int(most.max()), int(most.max()) + 1):
                        place = start + j + d
                        inside = (place >= begin) & (place < end) & (j < n) & (abs(d) <= most)
                        met |= inside & (h[np.clip(place, 0, len(h) - 1)] == word)
                    same += met
                ok = same >= n - most
                out.append(np.stack([text[ok], mine[ok], start[ok]], 1))
        return np.concatenate(out)

    def find(self, w: Words, h: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, end, edits): each item once per text, at its best place."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        texts, items, about = self.candidates(w, h)
        # candidates of one text and item that lie close together are confirmed at once
        apart = np.ones(len(texts), bool)
        apart[1:] = (texts[1:] != texts[:-1]) | (items[1:] != items[:-1]) | (about[1:] - about[:-1] > self.longest)
        cut = np.flatnonzero(apart)
        last = np.append(cut[1:], len(texts))[: len(cut)] - 1
        for t, i, at, to in zip(texts[cut].tolist(), items[cut].tolist(), about[cut].tolist(), about[last].tolist(), strict=True):
            if best.get((t, i), (1,))[0] == 0:
                continue
            item, most = self.h[self.first[i] : self.first[i + 1]], int(self.most[i])
            lo = max(int(w.first[t]), at - most - 1)
            hi = min(int(w.first[t + 1]), to + len(item) + 2 * most + 1)
            if lo >= hi:
                continue
            edits, a, b = edit_distance(item, h[lo:hi], most)
            if edits <= most:
                place = (edits, lo + a - int(w.first[t]), lo + b - int(w.first[t]))
                best[t, i] = min(best.get((t, i), place), place)
        return [(t, i, a, b, e) for (t, i), (e, a, b) in sorted(best.items())]


def item_groups(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[tuple[list, list[str]]]:
    """The benchmark in groups of at most MAX_ITEM_BYTES, one at a time on the driver."""
    ids, texts, held = [], [], 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).orderBy("i", "t").toLocalIterator():
        ids.append(r.i), texts.append(r.t)
        held += len((r.t or "").encode())
        if held > MAX_ITEM_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
    yield ids, texts


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per text and item that it leaks: id, item_id, first_word and end_word (normal words of the
    text), edits and item_words."""
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = None
    for ids, texts in item_groups(benchmark, item_col, item_text):

        def run(it: Iterator[pa.RecordBatch], ids: list = ids, texts: list = texts) -> Iterator[pa.RecordBatch]:
            items = Items.of(ids, texts)
            n_words = np.diff(items.first)
            for batch, _, _ in batches(it, "_text"):
                w, h = normal_words(batch.column(1))
                found = items.find(w, h)
                if found:
                    own = batch.column(0).take(pa.array([f[0] for f in found]))
                    cols = [pa.array([items.ids[f[1]] for f in found]), *(pa.array([f[k] for f in found], pa.int64()) for k in (2, 3, 4)), pa.array([int(n_words[f[1]]) for f in found], pa.int64())]
                    yield pa.RecordBatch.from_arrays([own, *cols], ["_id", "item_id", "first_word", "end_word", "edits", "item_words"])

        got = plain.mapInArrow(run, f"_id {kind.simpleString()}, item_id {item_kind.simpleString()}, first_word bigint, end_word bigint, edits bigint, item_words bigint")
        out = got if out is None else out.unionByName(got)
    return out.withColumnRenamed("_id", id_col)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows whose text leaks no item, with all their columns."""
    for ids, texts in item_groups(benchmark, item_col, item_text):

        def make(ids: list = ids, texts: list = texts):
            items = Items.of(ids, texts)

            def keep(own: pa.Array, data: np.ndarray, off: np.ndarray) -> np.ndarray:
                out = np.ones(len(own), bool)
                out[[f[0] for f in items.find(*normal_words(own))]] = False
                return out

            return keep

        docs = keep_rows(docs, text_col, make)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
