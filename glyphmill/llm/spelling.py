"""Grouping spelling variants: a self-join of the vocabulary's trie with active-node sets.

Words are maximal runs of Latin letters (A-Z, a-z, U+00C0-U+00FF) with A-Z in lower case, of at least LEAST_CHARS code points and
LEAST_COUNT occurrences. To stand for slips of the pen, an occurrence loses the code point h % length if SLIP divides h, the crc32
of `<id>:<run>`. Two words are near if one inserted, deleted or replaced code point makes one of the other. A word's form is its
near word of largest count (ties: smallest), if that is at least TIMES as frequent; its root is the last form of the chain of forms.

How it runs. Texts are counted where they are read, and counts summed by word. Then the vocabulary's trie is dealt out by prefix.
If m is the length of the shorter of two near words, their one edit is either in front of or behind the middle of m: then they share all
that stands behind it, or the prefix up to it. So a word of length L goes into four parts: for m = L and m = L - 1, by
its front half, and (as a trie read from behind that half) by its back half. A part of more than PART_WORDS words is halved again in the same
way, between what its words share in front and behind, until a part is small or the edit has one place left; then
a part holds at most a few words for each letter. So no prefix, however common, makes a large task.

Within a part the trie of what its words don't share is walked level by level. Each node u has a set of active nodes, those whose strings
are at distance 0 (u itself) or 1 of its own. A child by letter c takes from u's set the nodes' children by c, and from u
itself: u (a deletion), its other children (a replacement); and for itself its own children (an insertion). Where both nodes end a word,
the two are near. All nodes of a level, over all parts of a task, are one set of arrays. A pair whose inserted letter may
stand at the border of two parts is counted in the left one alone, so that no pair is counted twice and counts can be summed.

Forms are followed by doubling: as counts rise by TIMES or more with each form, a chain has at most 27 links, and five rounds suffice.

Cases: null and empty texts have no words; a null id counts as an empty string; repeated rows count each; ids of any type are taken as
their text; without words the result is empty; other columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LEAST_SHARES, LOWER, Scratch, batches, giving_back, read_table, spread

LEAST_CHARS, LEAST_COUNT = 6, 5
SLIP, TIMES = 199, 5
#: Words in a part of the trie, unless its edit has one place left; words in a task.
PART_WORDS, TASK_WORDS = 20_000, 100_000
#: Bytes of text whose runs are counted together.
TEXT_BYTES = 8 << 20
#: Doublings that reach the end of any chain of forms: TIMES ** 32 > 2 ** 63.
DOUBLINGS = 5
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True  # 0xC3 begins U+00C0-U+00FF in UTF-8


# ---------------------------------------------------------------- counts


@functools.lru_cache(4096)
def _shift(size: int) -> np.ndarray:
    """Four tables, one for each byte of a crc32: xored they give the crc's part in that of a string `size` bytes longer."""
    zeros = bytes(size)
    rest = zlib.crc32(zeros)
    bits = np.array([zlib.crc32(zeros, 1 << k) ^ rest for k in range(32)], np.uint32)
    bytes_, out = np.arange(256), np.zeros((4, 256), np.uint32)
    for k in range(32):
        out[k // 8] ^= np.where(bytes_ >> (k % 8) & 1, bits[k], 0).astype(np.uint32)
    return out


def joined_crcs(heads: np.ndarray, tails: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of each head followed by its tail, from the crc32 of both and the tail's bytes."""
    kinds, kind = np.unique(sizes, return_inverse=True)
    tables = np.stack([_shift(int(k)) for k in kinds]) if len(kinds) else np.zeros((0, 4, 256), np.uint32)
    out = tails.copy()
    for k in range(4):
        out ^= tables[kind, k, (heads >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def runs(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The texts' runs of letters, A-Z in lower case, and the text of each."""
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    start[cuts] = inside[cuts]
    at, upto = np.flatnonzero(start), np.cumsum(inside)
    letters = LOWER[data[inside]]
    begin = np.append(upto[at] - 1, len(letters)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(begin), pa.py_buffer(letters))
    return words, np.searchsorted(off, at, "right") - 1


def slipped_counts(ids: list[str | None], data: np.ndarray, off: np.ndarray, least_chars: int, slip: int) -> tuple[list[str], list[int]]:
    """Words of the texts after the slips, and their counts here."""
    words, doc = runs(data, off)
    coded = words.dictionary_encode()
    known, code = coded.dictionary, np.asarray(coded.indices)
    texts = known.to_pylist()
    crcs = np.array([zlib.crc32(w.encode()) for w in texts], np.uint32)
    size, length = (np.asarray(f(known)).astype(np.int64) for f in (pc.binary_length, pc.utf8_length))
    heads = np.array([zlib.crc32(f"{i or ''}:".encode()) for i in ids], np.uint32)
    h = joined_crcs(heads[doc], crcs[code], size[code])
    slips = h % np.uint32(slip) == 0
    n = np.bincount(code[~slips], minlength=len(texts))
    keep = np.flatnonzero((n > 0) & (length >= least_chars))
    out, times = [texts[k] for k in keep], n[keep].tolist()
    place = h[slips].astype(np.int64) % length[code[slips]]
    for (k, p), t in zip(*np.unique(np.stack([code[slips].astype(np.int64), place], 1), axis=0, return_counts=True), strict=True):
        if length[k] > least_chars:
            out.append(texts[k][:p] + texts[k][p + 1 :])
            times.append(int(t))
    return out, times


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """word, n: the words of all texts with enough code points and occurrences."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in batches(it, "_text", TEXT_BYTES):
            words, times = slipped_counts(batch.column(0).to_pylist(), data, off, least_chars, slip)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(times, pa.int64())], ["word", "n"])

    own = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    return own.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---------------------------------------------------------------- the trie


class Trie:
    """The trie of strings in groups. keys: for each level the sorted (node above, code point) of its nodes, each level's
    nodes numbered by their place; word: for each level the string that ends at a node, or -1."""

    def __init__(self, group: np.ndarray, chars: np.ndarray, first: np.ndarray):
        n = len(group)
        size, left = np.diff(first), np.arange(n)
        self.keys, self.word = [], []
        self.groups, node = np.unique(group, return_inverse=True)
        level = 0
        while len(left):
            ends = left[size[left] == level]
            word = np.full(len(self.groups) if not level else len(self.keys[-1]), -1)
            word[node[ends]] = ends
            self.word.append(word)
            left = left[size[left] > level]
            if len(left):
                keys, place = np.unique(node[left].astype(np.uint64) << np.uint64(21) | chars[first[left] + level].astype(np.uint64), return_inverse=True)
                node[left] = place
                self.keys.append(keys)
            level += 1

    def child(self, level: int, nodes: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have a child by their code point, and these children."""
        if level >= len(self.keys) or not len(nodes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, want = self.keys[level], nodes.astype(np.uint64) << np.uint64(21) | chars
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        has = np.flatnonzero(keys[at] == want)
        return has, at[has]

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of a node among these, a child of it), all of them."""
        if level >= len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        above = self.keys[level] >> np.uint64(21)
        lo, hi = (np.searchsorted(above, nodes.astype(np.uint64), side) for side in ("left", "right"))
        times = hi - lo
        return np.repeat(np.arange(len(nodes)), times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)


def near_in_groups(group: np.ndarray, chars: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ordered pairs of strings of a group at distance one, and for each whether the longer one may have
    its further code point in front of all others. Distinct strings in each group."""
    trie = Trie(group, chars, first)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    root = np.arange(len(trie.groups))
    # active[k]: nodes of this level, their active nodes at distance 1 of k levels below, whether the edit may be at the very front
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    at, below = trie.children(0, root)
    active = {-1: none, 0: none, 1: (at, below, np.ones(len(at), bool))}
    for level in range(len(trie.word)):
        for k, (u, v, front) in active.items():
            if len(u):
                a, b = trie.word[level][u], trie.word[level + k][v]
                both = (a >= 0) & (b >= 0)
                found.append((a[both], b[both], front[both]))
        if level >= len(trie.keys):
            break
        keys = trie.keys[level]
        above, char = (keys >> np.uint64(21)).astype(np.int64), keys & np.uint64((1 << 21) - 1)
        new: dict[int, list] = {-1: [], 0: [], 1: []}
        # matches: children by the same code point of a node and of its active nodes
        for k, (u, v, front) in active.items():
            if len(u):
                pair, x = trie.children(level, u)
                has, y = trie.child(level + k, v[pair], char[x])
                new[k].append((x[has], y, front[pair[has]]))
        nodes = np.arange(len(keys))
        new[-1].append((nodes, above, np.full(len(keys), level == 0)))
        pair, y = trie.children(level, above)
        other = pair != y
        new[0].append((pair[other], y[other], np.zeros(int(other.sum()), bool)))
        pair, y = trie.children(level + 1, nodes)
        new[1].append((pair, y, np.zeros(len(pair), bool)))
        active = {}
        for k, parts in new.items():
            u, v, front = (np.concatenate([p[i] for p in parts]) for i in range(3))
            pairs, place = np.unique(u.astype(np.uint64) << np.uint64(32) | v.astype(np.uint64), return_inverse=True)
            active[k] = ((pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), np.bincount(place, front, len(pairs)) > 0)
    return tuple(np.concatenate([f[k] for f in found]) if found else none[k] for k in range(3))


def _parts(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, lo, hi), each halved between what its part shares in front (lo) and behind (hi) unless but one place
    is left for the edit, with the texts that the new parts share."""
    m, lo, hi = (F.col(c) for c in ("m", "lo", "hi"))
    mid = F.floor((lo + m - hi) / 2).cast("int")
    part = lambda a, b: F.struct(m.alias("m"), a.alias("lo"), b.alias("hi"))
    halves = F.when(m - lo - hi > 1, F.array(part(lo, m - mid), part(mid, hi))).otherwise(F.array(part(lo, hi)))
    out = rows.select("word", "n", F.explode(halves).alias("x")).select("word", "n", "x.*")
    return out.select("*", F.expr("left(word, lo)").alias("front"), F.expr("right(word, hi)").alias("back"))


def near_words(words: DataFrame, scratch: Scratch, part_words: int = PART_WORDS, task_words: int = TASK_WORDS) -> DataFrame:
    """word, n_near, and best, the near word of largest count (ties: smallest) as (-count, word), for the words (word, n) that have any."""
    size = F.char_length("word")
    group = ["m", "lo", "hi", "front", "back"]
    own = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    todo, done = _parts(own.where("m > 0")), []
    for k in range(64):
        todo = scratch.put(todo, f"parts-{k}")
        large = todo.groupBy(*group).count().where(F.col("count") > part_words).where("m - lo - hi > 1").select(*group)
        large = scratch.put(large, f"large-{k}")
        if large.isEmpty():
            done.append(todo)
            break
        done.append(todo.join(large, group, "left_anti"))
        todo = _parts(todo.join(large, group, "left_semi").select("word", "n", "m", "lo", "hi"))
    parts = functools.reduce(DataFrame.unionByName, done)
    tasks = max(LEAST_SHARES, -(-4 * words.count() // task_words))

    @giving_back
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        names, n, m, lo, hi = table.column("word").to_pylist(), *(np.asarray(table.column(c)) for c in ("n", "m", "lo", "hi"))
        size = np.array([len(w) for w in names])
        middles = [w[a : len(w) - b] for w, a, b in zip(names, lo.tolist(), hi.tolist(), strict=True)]
        keys = list(zip(m.tolist(), lo.tolist(), hi.tolist(), table.column("front").to_pylist(), table.column("back").to_pylist(), strict=True))
        number = {g: k for k, g in enumerate(dict.fromkeys(keys))}
        chars = np.frombuffer("".join(middles).encode("utf-32-le"), "<u4")
        a, b, front = near_in_groups(np.array([number[g] for g in keys]), chars, np.concatenate([[0], np.cumsum(size - lo - hi)]))
        # a pair belongs to the part of its shorter word's length; one at a part's front border to the part before
        keep = (np.minimum(size[a], size[b]) == m[a]) & ~(front & (lo[a] > 0))
        a, b = a[keep], b[keep]
        rank = np.empty(len(names), np.int64)  # by count, then by text
        rank[sorted(range(len(names)), key=lambda k: (-n[k], names[k]))] = np.arange(len(names))
        order = np.lexsort((rank[b], a))
        a, b = a[order], b[order]
        some, at, times = np.unique(a, return_index=True, return_counts=True)
        best = b[at]
        return pa.table({"word": pa.array([names[k] for k in some], pa.string()), "n_near": times.astype(np.int64), "best_n": -n[best], "best": pa.array([names[k] for k in best], pa.string())})

    found = parts.withColumn("_task", spread(tasks, *group)).groupBy("_task").applyInArrow(run, "word string, n_near bigint, best_n bigint, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("best_n", "best")).alias("best"))


def spelling_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of (word, n)."""
    scratch = Scratch(words.sparkSession)
    words = scratch.put(words, "words")
    near = near_words(words, scratch)
    form_n = -F.col("best.best_n")
    has = form_n >= times * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", F.when(has, F.col("best.best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, form_n).alias("form_n")
    )
    forms = scratch.put(forms, "forms")
    roots = forms.where("form is not null").select("word", F.col("form").alias("root"))
    for k in range(DOUBLINGS):
        roots = scratch.put(roots, f"roots-{k}")
        on = roots.toDF("root", "further")
        roots = roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    roots = scratch.put(roots, "roots")
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(read_table(spark, sf_dir, "documents")))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BYTE = "CAST('0x' || substr(hex, 2 * k + 1, 2) AS BIGINT)"
#: crc32 bit by bit for its table, then byte by byte over all runs at once.
OP11_SQL = rf"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i AS v FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
), tab AS (
  SELECT i, v FROM steps WHERE k = 8
), r AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents
  ) GROUP BY ALL
), b AS (
  SELECT doc_id, run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hex FROM r
), crc AS (
  SELECT doc_id, run, n, hex, 0 AS k, 4294967295 AS c FROM b
  UNION ALL SELECT doc_id, run, n, hex, k + 1, xor(v, c >> 8) FROM crc JOIN tab ON i = xor(c & 255, {_BYTE}) WHERE 2 * k < length(hex)
), h AS (
  SELECT run, n, xor(c, 4294967295) AS h FROM crc WHERE 2 * k = length(hex)
), s AS (
  SELECT CASE WHEN h % {SLIP} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h
), w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), p AS (
  SELECT word, k, left(word, k - 1) || substr(word, k + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM w)
), pairs AS (
  SELECT a.word, b.word AS near FROM p a JOIN p b ON a.less = b.less AND a.k = b.k AND a.word <> b.word
  UNION SELECT p.word, w.word FROM p JOIN w ON p.less = w.word
  UNION SELECT w.word, p.word FROM p JOIN w ON p.less = w.word
), best AS (
  SELECT a.word, count(*) AS n_near, max(b.n) AS most, arg_min(b.word, (-b.n, b.word)) AS form FROM pairs a JOIN w b ON a.near = b.word GROUP BY a.word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {TIMES} * w.n THEN form END AS form, CASE WHEN most >= {TIMES} * w.n THEN most END AS form_n
  FROM w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN chain c ON c.word = f.word JOIN f g ON g.word = c.root WHERE g.form IS NULL
"""
