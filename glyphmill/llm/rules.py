"""Quality rules with an isolation forest over their statistics.

`statistics` measures every whole text; two fixed rules reject outright; for the rest an isolation
forest gives the expected path length over random splits, and texts whose anomaly score is above a
threshold are rejected too. The forest is grown on labelled rows of quality 1 among at most FIT_ROWS labelled rows,
those with the smallest hash of the id. The threshold is set on the scores of all labelled rows: counts of good and
bad ones in SCORE_BINS bins of the score, so much and no more comes to the driver. With fewer than FEW_BAD bad rows the good
ones alone tell where GOOD_LOSS of them are beyond, also, by their tail, when they are too few for one to be; bad rows may
only lower that, within the same loss. Everything else covers every row.

Cases: null and empty texts have no words and are rejected by the rules; rows with a null id are
judged like others; repeated rows give one result each, and count once as labelled rows, by their least score; ids
that aren't whole numbers have no labels; with fewer than two good labelled rows there is nothing to grow a forest on, and
the rules alone judge; an empty table gives an empty result; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, batches, inside_doc, keep_rows, read_table, span_hashes, window_hashes, word_hashes, words

WINDOW = 5
MIN_WORDS = 10
REPEAT_SHARE = 0.20
FIT_ROWS = 4096
#: Bad rows from which on they have a say in the threshold.
FEW_BAD = 20
TREES, SUBSAMPLE, SEED = 120, 256, 11
SCORE_BINS = 1 << 14
#: Bytes of text measured at once; the arrays over them take some forty times as much.
AT_ONCE = 2 << 20
#: Share of the labelled good rows that the threshold may reject.
GOOD_LOSS = 0.005

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_CONT = np.zeros(256, bool)
_CONT[128:192] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("mean_word", "symbols", "upper", "digits", "punctuation", "dup_lines", "repeats", "distinct", "symbol_words", "stop_share")


def per_doc(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of each text's bytes are in the mask."""
    upto = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=upto[1:])
    return upto[off[1:]] - upto[off[:-1]]


def repeated(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more in their text; which equal an earlier one of it."""
    order = np.lexsort((np.arange(len(keys)), keys, doc))
    k, d = keys[order], doc[order]
    same = np.zeros(len(keys), bool)
    same[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    a, b = np.empty(len(keys), bool), np.empty(len(keys), bool)
    a[order], b[order] = twice, same
    return a, b


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of `total` places a window of n places from one of `starts` covers."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def duplicate_lines(w: Words) -> np.ndarray:
    """Per text, its \\n-split lines that hold a word and equal an earlier line."""
    cut = np.union1d(np.flatnonzero(w.data == 10) + 1, w.off[:-1])
    cut = cut[cut < len(w.data)]
    if not len(cut):
        return np.zeros(len(w.off) - 1, np.int64)
    end = np.append(cut[1:], len(w.data))
    doc = np.searchsorted(w.off, cut, "right") - 1
    end = end - (w.data[end - 1] == 10)
    at = np.searchsorted(w.s, cut)
    has = at < np.searchsorted(w.s, end)
    cut, end, doc = cut[has], end[has], doc[has]
    again = repeated(span_hashes(w.data, cut, end), doc)[1]
    return np.bincount(doc[again], minlength=len(w.off) - 1)


def statistics(data: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The rules' counts and, per text, the features of the forest."""
    w, n_docs = words(data, off), len(off) - 1
    h, doc, n = word_hashes(w), w.doc, w.counts
    lead = ~_CONT[data]
    in_word = np.zeros(len(data) + 1, np.int32)
    in_word[w.s] = 1
    in_word[w.e] -= 1  # a word may end where the next text's first begins
    inside = np.cumsum(in_word[:-1]) > 0
    symbols = per_doc(SYMBOL[data], off)
    win = window_hashes(h, WINDOW)
    ok = np.flatnonzero(inside_doc(w, WINDOW))
    twice = repeated(win[ok], doc[ok])[0]
    hit = covered(ok[twice], WINDOW, len(h))
    base = {
        "n_words": n,
        "word_chars": per_doc(lead & inside, off),
        "n_symbols": symbols,
        "n_dup_lines": duplicate_lines(w),
        "n_repeat_words": np.bincount(doc[hit], minlength=n_docs),
    }
    some, chars = np.maximum(n, 1), np.maximum(base["word_chars"], 1)
    again = repeated(h, doc)[1]
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOL[data], out=upto[1:])
    marked = upto[w.e] > upto[w.s]
    short = (w.e - w.s) <= 3
    size = np.log1p(some)
    x = np.stack(
        [
            base["word_chars"] / some,
            symbols / chars,
            per_doc(_UPPER[data], off) / np.maximum(per_doc(_LETTER[data] & lead, off), 1),
            per_doc(_DIGIT[data], off) / chars,
            per_doc(_PUNCT[data], off) / chars,
            base["n_dup_lines"] / some,
            base["n_repeat_words"] / some,
            # distinct words fall with length; their log over the log of the length hardly does
            np.log1p(n - np.bincount(doc[again], minlength=n_docs)) / size,
            np.bincount(doc[marked], minlength=n_docs) / some,
            np.bincount(doc[short], minlength=n_docs) / some,
        ],
        1,
    )
    return base, x


# ---------------------------------------------------------------- the forest


@dataclass
class Forest:
    """Trees as arrays: the feature split on (-1 at a leaf), the cut, the two children, and at a leaf
    its depth with the expected depth of what it still holds."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    norm: float
    threshold: float = math.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 to the minus mean path length over its expectation: near 1 for anomalies."""
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t, at]
                if (f < 0).all():
                    break
                low = x[row, np.maximum(f, 0)] < self.cut[t, at]
                at = np.where(f < 0, at, np.where(low, self.left[t, at], self.right[t, at]))
            total += self.depth[t, at]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def expected_depth(n: int) -> float:
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(x: np.ndarray, trees: int = TREES, sample: int = SUBSAMPLE, seed: int = SEED) -> Forest:
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    deepest = math.ceil(math.log2(max(sample, 2))) + 2
    size = 2 ** (deepest + 1)
    out = Forest(*(np.full((trees, size), v, k) for v, k in ((-1, np.int64), (0.0, float), (0, np.int64), (0, np.int64), (0.0, float))), norm=max(expected_depth(sample), 1e-9))
    for t in range(trees):
        used, todo = 1, [(0, rng.choice(len(x), sample, replace=False), 0)]
        while todo:
            node, rows, deep = todo.pop()
            part = x[rows]
            lo, hi = part.min(0), part.max(0)
            wide = np.flatnonzero(hi > lo)
            if len(rows) <= 1 or deep >= deepest or not len(wide):
                out.depth[t, node] = deep + expected_depth(len(rows))
                continue
            f = rng.choice(wide)
            # The outer halves of the range beyond the data are cut too: a value outside all seen is an anomaly.
            margin = 0.25 * (hi[f] - lo[f])
            c = rng.uniform(lo[f] - margin, hi[f] + margin)
            out.feature[t, node], out.cut[t, node] = f, c
            low = part[:, f] < c
            for side, keep in ((out.left, low), (out.right, ~low)):
                side[t, node] = used
                if keep.any():
                    todo.append((used, rows[keep], deep + 1))
                else:
                    out.depth[t, used] = deep + 1
                used += 1
    return out


def score_bin(score: np.ndarray) -> np.ndarray:
    """Scores of bin b are over b / SCORE_BINS and at most (b + 1) / SCORE_BINS."""
    return np.clip(np.ceil(score * SCORE_BINS) - 1, 0, SCORE_BINS - 1).astype(np.int64)


def tail_cut(good: np.ndarray) -> float:
    """The score that GOOD_LOSS of the good rows are beyond, from counts by bin. Rows too few for that give the median and how far the scores
    above it are over it on average (at least what so few rows leave open), and an exponential tail of that mean the rest."""
    n, top = int(good.sum()), (np.arange(SCORE_BINS) + 1) / SCORE_BINS
    beyond = n - np.cumsum(good)
    if GOOD_LOSS * n >= 1:
        return float(top[np.flatnonzero(beyond <= GOOD_LOSS * n)[0]])
    middle = top[np.flatnonzero(2 * beyond <= n)[0]]
    over = np.where(top > middle, good, 0)
    mean = float((over * (top - middle)).sum() / max(int(over.sum()), 1))
    return float(middle + max(mean, (1 - middle) / (n + 1)) * math.log(0.5 / GOOD_LOSS))


def calibrate(forest: Forest, good: np.ndarray, bad: np.ndarray) -> None:
    """From counts by bin, the cut that parts bad from good rows best (share of bad rows found less share of good rows
    lost) while it loses at most GOOD_LOSS of the good; of equal cuts the middle of the widest gap. Few bad rows can only lower the
    cut that the good ones' tail gives."""
    forest.threshold = tail_cut(good) if bad.sum() < FEW_BAD and good.any() else math.inf
    if not bad.any():
        return
    lost, found = (1 - np.cumsum(x) / max(int(x.sum()), 1) for x in (good, bad))
    last = int(np.flatnonzero(good + bad)[-1])  # a cut beyond all rows is like one at the last
    worth = np.where(lost <= GOOD_LOSS, np.round(found - lost, 9), -np.inf)[: last + 1]
    best = np.flatnonzero(worth == worth.max())
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    widest = max(runs, key=len)
    forest.threshold = min(forest.threshold, float((widest[len(widest) // 2] + 1) / SCORE_BINS))


# ---------------------------------------------------------------- over tables


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest | None = None) -> DataFrame:
    """id, the counts of the rules and the array of features (with a forest: their anomaly) of every text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in batches(it, "_text", AT_ONCE):
            base, x = statistics(data, off)
            cols = [batch.column(0), *(pa.array(base[c].astype(np.int64)) for c in BASE)]
            last = pa.array(forest.score(x)) if forest else pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
            yield pa.RecordBatch.from_arrays([*cols, last], ["_id", *BASE, name])

    name = "anomaly" if forest else "features"
    schema = f"_id {kind}, " + ", ".join(f"{c} bigint" for c in BASE) + f", {name} {'double' if forest else 'array<double>'}"
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def grown(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Forest | None:
    """A forest of the good texts among at most `rows` labelled ones; None with fewer than two."""
    chosen = quality_of(labels).orderBy(F.xxhash64("_label"), "_label").limit(rows).collect()  # bounded by `rows`
    if not chosen:
        return None
    small = docs.sparkSession.createDataFrame([(int(r[0]), int(r[1])) for r in chosen], "_label long, quality int")
    own = docs.select(F.col(id_col).try_cast("long").alias("_id"), F.col(text_col).alias("_text"))
    both = own.join(F.broadcast(small), F.col("_id") == F.col("_label"), "left_semi")
    # A document may be there in many copies: one row of each id is enough, and bounds what comes back.
    stats = measure(both, "_id", "_text").groupBy("_id").agg(F.min(F.struct(*BASE, "features")).alias("x"))
    got = stats.orderBy("_id").collect()
    good_by_id = {int(r[0]): int(r[1]) for r in chosen}
    got = [r for r in got if not base_fails(r.x.n_words, r.x.n_repeat_words)]
    x = np.array([r.x.features for r in got], float).reshape(len(got), len(FEATURES))
    good = np.array([good_by_id[int(r._id)] == 1 for r in got], bool)
    return grow(x[good]) if good.sum() >= 2 else None


def quality_of(labels: DataFrame) -> DataFrame:
    """(_label, quality): one row of each labelled id, bad if any of its labels is."""
    rows = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    return rows.groupBy(F.col("doc_id").alias("_label")).agg(F.min("quality").alias("quality"))


def set_threshold(forest: Forest, scored: DataFrame, labels: DataFrame) -> Forest:
    """The forest with its threshold, from the scores (`scored` of all texts) of all labelled rows."""
    rows = scored.where(~base_failed()).groupBy(F.col("_id").try_cast("long").alias("_label")).agg(F.min("anomaly").alias("anomaly"))
    bins = F.least(F.greatest(F.ceil(F.col("anomaly") * SCORE_BINS) - 1, F.lit(0)), F.lit(SCORE_BINS - 1)).alias("bin")
    kinds = [F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad")]
    counts = rows.join(quality_of(labels), "_label").groupBy(bins).agg(*kinds).collect()  # a row a bin
    good, bad = np.zeros(SCORE_BINS, np.int64), np.zeros(SCORE_BINS, np.int64)
    for r in counts:
        good[r.bin], bad[r.bin] = r.good, r.bad
    calibrate(forest, good, bad)
    return forest


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Forest | None:
    """A forest with its threshold; None with fewer than two good labelled rows."""
    forest = grown(docs, labels, id_col, text_col, rows)
    return forest and set_threshold(forest, scored(docs, forest, id_col, text_col), labels)


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > 100 * REPEAT_SHARE * n_words


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * REPEAT_SHARE) * F.col("n_words"))


def scored(docs: DataFrame, forest: Forest | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, the counts and anomaly of every text; without a forest no text is an anomaly."""
    stats = measure(docs, id_col, text_col, forest)
    return stats if forest else stats.drop("features").withColumn("anomaly", F.lit(0.0))


def verdict(rows: DataFrame, forest: Forest | None, id_col: str = "doc_id") -> DataFrame:
    """id, the counts, base_failed, anomaly and kept of scored rows."""
    limit = F.lit(math.inf if forest is None else forest.threshold)
    return rows.select(F.col("_id").alias(id_col), *BASE, base_failed().alias("base_failed"), "anomaly", (~base_failed() & (F.col("anomaly") <= limit)).alias("kept"))


def judge(docs: DataFrame, forest: Forest | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts, base_failed, anomaly and kept of every text."""
    return verdict(scored(docs, forest, id_col, text_col), forest, id_col)


def keep_good(docs: DataFrame, forest: Forest | None, text_col: str = "text") -> DataFrame:
    """The rows that the rules and the forest keep, with all their columns."""

    def make():
        def keep(_: pa.Array, data: np.ndarray, off: np.ndarray) -> np.ndarray:
            base, x = statistics(data, off)
            ok = (base["n_words"] >= MIN_WORDS) & (100 * base["n_repeat_words"] <= int(100 * REPEAT_SHARE) * base["n_words"])
            return ok if forest is None else ok & (forest.score(x) <= forest.threshold)

        return keep

    return keep_rows(docs, text_col, make, AT_ONCE)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    forest = grown(docs, labels)
    # each text is measured once: its score serves the threshold and the verdict
    rows = Scratch(spark).put(scored(docs, forest), "scored")
    return verdict(rows, forest and set_threshold(forest, rows, labels))
