"""SentencePiece segmentations sampled without replacement, and their decoding.

A text is a lattice: its bytes between pieces of a SentencePiece vocabulary, a space in front and every
space a piece's mark; characters that no piece spells are written as byte pieces. A piece of rank r has
weight 1 / (r + 1) (byte pieces that of the last rank), and a segmentation's probability is the product of
its pieces' weights over the sum for all segmentations of the text.

The k segmentations of a text are its Gumbel top-k: those whose log probability plus an own Gumbel number
is largest, which is sampling without replacement. They are found by perturbed A* search without looking
at others: the maximum of a set of segmentations is itself a Gumbel number at the set's log probability,
so a path is drawn piece by piece from exact conditional probabilities, every set that it leaves at a
node gets its maximum as a Gumbel truncated at that of the path, and the next sample begins at the
largest of these. The largest left after k is the threshold; with it, a segmentation's inclusion
probability is 1 - exp(-exp(log_prob - threshold)).

All random numbers are hashes of the row's key, the sample's number and the place in the text: results
don't depend on partitions or neighbours.

Cases: null and empty texts have no pieces and one sample (the empty one); a text with fewer than k
segmentations gives all it has, with log_inclusion 0; a null key seeds like the number 0; repeated rows
give equal samples; long texts are one lattice, never cut; an empty table gives an empty result; only the
named columns are read. A text's own U+2581 is written as bytes, so that decoding is exact for every text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, mix, read_table, span_hashes

SAMPLES = 2
SEED = 0x51ED2701
_K = np.uint64(0x9E3779B97F4A7C15)
#: Sums of probabilities are multiples of 2**-_GRID_BITS: exact beside node numbers below 2**22.
_GRID_BITS = 29
_GRID = 2.0**_GRID_BITS
#: A worker's store of word lattices is emptied when it has more nodes.
STORE_NODES = 3 << 19
#: Bytes of text sampled at once: a path has a number for each of them.
RUN_BYTES = 1 << 19


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """Pieces as bytes (a space for the mark), their log weights, and a trie over them: `step` has, by the
    number of a node's row * 256 + byte, the node that this leads to or -1; `row` the row of a node that
    leads on, or that of none; `piece` the piece that ends at a node or -1."""

    text: list[bytes]
    weight: np.ndarray
    byte_id: np.ndarray
    byte_weight: float
    step: np.ndarray
    row: np.ndarray
    piece: np.ndarray

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        text, weight = [b""] * n, np.full(n, -np.log(n + 1.0))
        byte_id = np.full(256, -1, np.int64)
        trie: dict[tuple[int, int], int] = {}
        piece = [-1]
        for i in range(n):
            if sp.is_byte(i):
                byte_id[int(sp.id_to_piece(i)[3:5], 16)] = i
                text[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text[i] = sp.id_to_piece(i).replace("▁", " ").encode()
                weight[i] = -np.log1p(min(-sp.get_score(i), n))
                at = 0
                for b in text[i]:
                    if (at, b) not in trie:
                        trie[at, b] = len(piece)
                        piece.append(-1)
                    at = trie[at, b]
                if piece[at] < 0:
                    piece[at] = i
        if (byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        inner = sorted({a for a, _ in trie})
        row = np.full(len(piece), len(inner), np.int32)
        row[inner] = np.arange(len(inner))
        step = np.full((len(inner) + 1) * 256, -1, np.int32)
        for (a, b), to in trie.items():
            step[row[a] * 256 + b] = to
        return cls(text, weight, byte_id, float(-np.log(n + 1.0)), step, row, np.array(piece, np.int32))

    def decode(self, ids) -> str:
        """The text of ids: the pieces' bytes without the space in front."""
        return b"".join(self.text[i] for i in ids)[1:].decode()


class Row:
    """An array that grows at its end without being copied each time."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(1 << 12, kind), 0

    def add(self, x: np.ndarray) -> np.ndarray:
        if self.n + len(x) > len(self.held):
            held = np.empty(max(self.n + len(x), len(self.held) * 9 // 8), self.held.dtype)
            held[: self.n] = self.held[: self.n]
            self.held = held
        self.held[self.n : self.n + len(x)] = x
        self.n += len(x)
        return self.held[: self.n]


class Lattices:
    """The lattices of distinct words (a run of spaces and what follows it). Node = number of a byte of
    a stored word; edges in order of their first node: log probability given the node, log of what is
    left beside it, the sum of probabilities up to it (plus the node), bytes, and piece (-1: byte pieces)."""

    def __init__(self, vocabulary: Vocabulary, most: int = STORE_NODES):
        self.v, self.most = vocabulary, most
        self.clear()

    def clear(self) -> None:
        self.hash, self.base = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.used = 0
        self.rows = {"logp": Row(float), "rest": Row(np.float32), "upto": Row(float), "length": Row(np.int16), "piece": Row(np.int32), "source": Row(np.int32)}
        for name, row in self.rows.items():
            setattr(self, name, row.held[:0])

    def find(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The first node of each word data[s:e]; words not seen yet are added."""
        if self.used > self.most:
            self.clear()
        h = span_hashes(data, s, e)
        at = np.minimum(np.searchsorted(self.hash, h), max(len(self.hash) - 1, 0))
        new = np.flatnonzero(self.hash[at] != h) if len(self.hash) else np.arange(len(h))
        if len(new):
            own, first = np.unique(h[new], return_index=True)
            base = self._add(data, s[new[first]], e[new[first]])
            place = np.searchsorted(self.hash, own)
            self.hash, self.base = np.insert(self.hash, place, own), np.insert(self.base, place, base)
            at = np.searchsorted(self.hash, h)
        return self.base[at]

    def _add(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        size = e - s
        base = np.concatenate([[0], np.cumsum(size)])
        n = int(base[-1])
        # the new words' bytes in a row
        byte = data[np.repeat(s - base[:-1], size) + np.arange(n)]
        end = np.repeat(base[1:], size)
        head = np.flatnonzero((byte & 0xC0) != 0x80)
        edges = []
        node, at, length = np.zeros(len(head), np.int32), head, 0
        spelt = np.zeros(n, bool)
        char = np.ones(n, np.int64)
        char[head] = np.append(head[1:], n)[: len(head)] - head
        char = np.minimum(char, end - np.arange(n))
        byte_end = np.append(byte, 0).astype(np.int32)
        stop = end[head]
        while len(at):
            node = self.v.step[self.v.row[node] * 256 + byte_end[at + length]]
            # within the word, and along the trie
            ok = np.flatnonzero((node >= 0) & (at + length < stop))
            at, node, stop = at[ok], node[ok], stop[ok]
            length += 1
            piece = self.v.piece[node]
            some = np.flatnonzero(piece >= 0)
            where = at[some]
            edges.append((where, np.full(len(some), length, np.int32), piece[some]))
            spelt[where[char[where] == length]] = True
        odd = head[~spelt[head]]
        edges.append((odd, char[odd].astype(np.int32), np.full(len(odd), -1, np.int32)))
        a, length, piece = (np.concatenate(x) for x in zip(*edges, strict=True))
        order = np.argsort(a, kind="stable")
        a, length, piece = a[order], length[order], piece[order]
        weight = np.where(piece >= 0, self.v.weight[piece], length * self.v.byte_weight)
        # log of the summed weights from each node to its word's end, by the bytes left, fewest first
        left = end[a] - a
        left = left.astype(np.uint16) if len(left) and left.max() < 1 << 16 else left
        beta = np.full(n + 1, -np.inf)
        done = a + length == end[a]
        by = np.argsort(left, kind="stable")
        cut = np.flatnonzero(np.append(True, left[by][1:] != left[by][:-1]))
        # an edge that ends its word leads to the place after all others, where nothing is left
        to = np.where(done, n, a + length)
        beta[n] = 0.0
        from_, to_, weight_ = a[by], to[by], weight[by]
        new_node = np.append(True, from_[1:] != from_[:-1])
        with np.errstate(divide="ignore", invalid="ignore"):
            for lo, hi in zip(cut, np.append(cut[1:], len(by)), strict=True):
                x = weight_[lo:hi] + beta[to_[lo:hi]]
                start = np.flatnonzero(new_node[lo:hi])
                most = np.maximum.reduceat(x, start)
                most[most == -np.inf] = 0.0
                total = np.add.reduceat(np.exp(x - np.repeat(most, np.diff(np.append(start, hi - lo)))), start)
                beta[from_[lo:hi][start]] = most + np.log(total)
        logp = weight + beta[to] - beta[a]
        live = np.isfinite(logp)
        if not live.all():
            a, length, piece, logp = a[live], length[live], piece[live], logp[live]
        start = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        times = np.diff(np.append(start, len(a)))
        p = np.exp(logp)
        # sums within a node, one edge of each node at a time, on a grid: the same whatever else is stored
        upto, at, size, level = p.copy(), start[times > 1], times[times > 1], 1
        while len(at):
            upto[at + level] += upto[at + level - 1]
            level += 1
            more = size > level
            at, size = at[more], size[more]
        upto = np.minimum(np.round(upto * _GRID) / _GRID, 1.0)
        upto[start + times - 1] = 1.0
        # what is left beside an edge: for one over a half the sum of the others, as 1 - p would lose what is near 0
        large = p > 0.5
        others = np.where(large, np.repeat(np.add.reduceat(np.where(large, 0.0, p), start), times), np.repeat(np.add.reduceat(p, start), times) - p)
        with np.errstate(divide="ignore"):
            rest = np.log(others)
        shift = self.used
        new = {"logp": np.minimum(logp, 0.0), "rest": np.minimum(rest, 0.0), "upto": upto + (a + shift), "length": length, "piece": piece, "source": a + shift}
        for name, x in new.items():
            setattr(self, name, self.rows[name].add(x))
        self.used += n
        return base[:-1] + shift


def uniform(seed: np.ndarray, sample: int, stream: int, place: np.ndarray, bits: int = 52) -> np.ndarray:
    """Numbers in (0, 1) from hashes: middles of a grid of 2**bits."""
    x = mix(seed + (place.astype(np.uint64) * np.uint64(8) + np.uint64(stream)) * _K + np.uint64((sample + 1) << 48))
    return ((x >> np.uint64(64 - bits)).astype(np.float64) + 0.5) * 2.0**-bits


def truncated(location: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers at `location`, given that they are below `top`."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        out = location - np.log(np.exp(location - top) - np.log(u))
    return np.where(np.isfinite(location), np.minimum(out, top), -np.inf)


@dataclass
class Sample:
    """For every text of a run (by number): is there such a sample, its perturbed and plain log
    probability, and the edge that begins at each byte of the texts (-1: none)."""

    there: np.ndarray
    perturbed: np.ndarray
    log_prob: np.ndarray
    edge: np.ndarray


def sample_texts(store: Lattices, data: np.ndarray, off: np.ndarray, seed: np.ndarray, k: int) -> tuple[list[Sample], np.ndarray, np.ndarray, np.ndarray]:
    """k samples of every text without replacement; the largest perturbed log probability left; and the
    texts' bytes with a space in front of each (none if empty) and where they begin."""
    n = len(off) - 1
    size = np.diff(off)
    some = size > 0
    start = off[:-1][some]
    byte = np.insert(data, start, 0x20)
    first = np.concatenate([[0], np.cumsum(size + some)])
    doc_of = np.repeat(np.arange(n, dtype=np.int32), size + some)
    space = byte == 0x20
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[first[:-1][some]] = True
    s = np.flatnonzero(begin)
    e = np.append(s[1:], len(byte))
    node0 = store.find(byte, s, e) if len(s) else np.zeros(0, np.int64)
    order = np.argsort(node0, kind="stable")

    def walk(edge: np.ndarray, sample: int, pos: np.ndarray, node: np.ndarray, end: np.ndarray) -> None:
        """Draw paths from each pos (at node) to each end."""
        while len(pos):
            doc = doc_of[pos]
            u = uniform(seed[doc], sample, 0, pos - first[doc], _GRID_BITS)
            pick = np.searchsorted(store.upto, node + u, "right")
            edge[pos] = pick
            step = store.length[pick]
            pos, node = pos + step, node + step
            on = pos < end
            pos, node, end = pos[on], node[on], end[on]

    def along(edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The path's places, their texts, and log probabilities before each place and of the whole text."""
        at = np.flatnonzero(edge >= 0)
        lp = store.logp[edge[at]]
        run = np.concatenate([[0.0], np.cumsum(lp)])
        lo = np.searchsorted(at, first)
        base = run[lo[:-1]]
        doc = doc_of[at]
        return at, doc, run[:-1] - base[doc], run[lo[1:]] - base

    edge = np.full(len(byte), -1, np.int32)
    walk(edge, 0, s[order], node0[order], e[order])
    at, doc, before, log_prob = along(edge)
    with np.errstate(divide="ignore"):
        top = -np.log(-np.log(uniform(seed, 0, 2, np.zeros(n, np.int64))))
    samples = [Sample(np.ones(n, bool), top, log_prob, edge)]
    # what each path left: value by place of the path, and at the branch place the edges already taken
    left = [(at, doc, truncated(before + store.rest[edge[at]], top[doc], uniform(seed[doc], 0, 1, at - first[doc])))]
    taken: list[list[np.ndarray]] = [[]]
    branch: list[np.ndarray] = [np.full(n, -1)]
    for j in range(1, k + 1):
        # the largest of what is left: which path, which place
        best, whose, where = np.full(n, -np.inf), np.zeros(n, np.int64), np.full(n, -1)
        for p, (at, doc, value) in enumerate(left):
            if not len(at):
                continue
            lo = np.searchsorted(doc, np.arange(n + 1))
            has = np.flatnonzero(lo[1:] > lo[:-1])
            most = np.full(n, -np.inf)
            most[has] = np.maximum.reduceat(value, lo[:-1][has])
            hit = np.flatnonzero((value == most[doc]) & np.isfinite(value))[::-1]
            place = np.full(n, -1)
            place[doc[hit]] = hit  # the first, if equal
            better = most > best
            best, whose, where = np.where(better, most, best), np.where(better, p, whose), np.where(better, place, where)
        if j == k:
            return samples, best, byte, first
        there = where >= 0
        docs = np.flatnonzero(there)
        edge = np.full(len(byte), -1, np.int32)
        spot = np.full(n, -1)
        used = [np.full(n, -1) for _ in range(j)]
        for p in range(j):
            own = docs[whose[docs] == p]
            if not len(own):
                continue
            at, _, value = left[p]
            spot[own] = at[where[own]]
            value[where[own]] = -np.inf
            # the path up to the place is the parent's
            mine = np.zeros(n, bool)
            mine[own] = True
            copy = np.flatnonzero(mine[doc_of])
            copy = copy[copy < spot[doc_of[copy]]]
            edge[copy] = samples[p].edge[copy]
            used[0][own] = samples[p].edge[spot[own]]
            same = own[branch[p][own] == spot[own]]
            for i, old in enumerate(taken[p]):
                used[i + 1][same] = old[same]
        # another edge of the node, by the probabilities of those not taken
        if len(docs):
            old = np.stack([x[docs] for x in used], 1)
            node = store.source[old[:, 0]].astype(np.int64)
            lo, hi = (np.searchsorted(store.source, node.astype(np.int32), side) for side in ("left", "right"))
            wide = int((hi - lo).max())
            grid = lo[:, None] + np.arange(wide)
            ok = grid < hi[:, None]
            for i in range(old.shape[1]):
                ok &= grid != old[:, i : i + 1]
            lp = np.where(ok, store.logp[np.minimum(grid, len(store.logp) - 1)], -np.inf)
            u = uniform(seed[docs][:, None], j, 3, (spot[docs] - first[docs])[:, None] * 64 + np.arange(wide))
            new = grid[np.arange(len(docs)), np.argmax(lp - np.log(-np.log(u)), 1)]
            edge[spot[docs]] = new
            word = np.searchsorted(s, spot[docs], "right") - 1
            pos = spot[docs] + store.length[new].astype(np.int64)
            on = pos < e[word]
            own = doc_of[s]
            later = order[(there[own] & (s > spot[own]))[order]]
            walk(edge, j, np.concatenate([pos[on], s[later]]), np.concatenate([(node + store.length[new])[on], node0[later]]), np.concatenate([e[word][on], e[later]]))
        at, doc, before, log_prob = along(edge)
        value = truncated(before + store.rest[edge[at]], best[doc], uniform(seed[doc], j, 1, at - first[doc]))
        value[at < spot[doc]] = -np.inf
        # at the branch place: what is left beside all edges taken there
        here = np.flatnonzero(at == spot[doc])
        if len(here):
            both = ok & (grid != edge[spot[docs]][:, None])
            with np.errstate(divide="ignore"):
                rest = np.log(np.where(both, np.exp(lp), 0.0).sum(1))
            value[here] = truncated(before[here] + rest, best[docs], uniform(seed[docs], j, 4, at[here] - first[docs]))
        samples.append(Sample(there, best, log_prob, edge))
        left.append((at, doc, value))
        taken.append(used)
        branch.append(spot)
    raise AssertionError


def ids_of(store: Lattices, byte: np.ndarray, first: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids along a path, and where each text's begin."""
    at = np.flatnonzero(edge >= 0)
    piece, length = store.piece[edge[at]].astype(np.int64), store.length[edge[at]].astype(np.int64)
    times = np.where(piece >= 0, 1, length)
    begin = np.concatenate([[0], np.cumsum(times)])
    ids = np.repeat(piece, times)
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        inside = np.arange(len(ids)) - np.repeat(begin[:-1], times)
        ids[odd] = store.v.byte_id[byte[np.repeat(at, times)[odd] + inside[odd]]]
    return ids.astype(np.int32), begin[np.searchsorted(at, first)]


def round_trip(v: Vocabulary, byte: np.ndarray, first: np.ndarray, ids: np.ndarray, begin: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether each text's ids decode to it."""
    joined, at = table
    size = np.diff(at)[ids]
    upto = np.concatenate([[0], np.cumsum(size)])
    out = joined[np.repeat(at[ids] - upto[:-1], size) + np.arange(upto[-1])]
    if len(out) == len(byte) and (upto[begin] == first).all() and np.array_equal(out, byte):
        return np.ones(len(first) - 1, bool)
    return np.array([np.array_equal(out[upto[begin[i]] : upto[begin[i + 1]]], byte[first[i] : first[i + 1]]) for i in range(len(first) - 1)])


@functools.lru_cache(1)
def lattices_of(model: str, most: int = STORE_NODES) -> tuple[Lattices, tuple[np.ndarray, np.ndarray]]:
    """One store for each Python worker, and the pieces' bytes in a row with where each begins."""
    v = Vocabulary.load(model)
    return Lattices(v, most), (np.frombuffer(b"".join(v.text), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in v.text])]))


def sample_segmentations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, model: str | None = None, seed: int = SEED, store_nodes: int = STORE_NODES) -> DataFrame:
    """A row per text and sample: id, sample (from 0), ids, n_pieces, log_prob, perturbed, log_inclusion,
    round_trip (whether the ids decode to the text)."""
    model = model or default_model()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, table = lattices_of(model, store_nodes)
        v = store.v
        for batch, data, off in batches(it, "_text", RUN_BYTES):
            seeds = mix(np.asarray(batch.column(1)).view(np.uint64) ^ np.uint64(seed))
            samples, left, byte, first = sample_texts(store, data, off, seeds, k)
            for j, x in enumerate(samples):
                rows = np.flatnonzero(x.there)
                if not len(rows):
                    continue
                ids, begin = ids_of(store, byte, first, x.edge)
                good = round_trip(v, byte, first, ids, begin, table)[rows] if x.there.all() else None
                if good is None:  # texts without this sample have no ids: compare the others
                    good = np.array([v.decode(ids[begin[r] : begin[r + 1]]).encode() == byte[first[r] : first[r + 1]][1:].tobytes() for r in rows])
                count = np.diff(begin)[rows]
                with np.errstate(over="ignore", divide="ignore"):
                    z = x.log_prob[rows] - left[rows]
                    inclusion = np.where(z < -30, z, np.log(-np.expm1(-np.exp(np.minimum(z, 700)))))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        pa.array(np.full(len(rows), j, np.int32)),
                        # texts without the sample hold no ids, so their offsets fall together
                        pa.ListArray.from_arrays(pa.array(np.append(begin[rows], begin[-1]).astype(np.int32)), pa.array(ids)),
                        pa.array(count),
                        pa.array(x.log_prob[rows]),
                        pa.array(x.perturbed[rows]),
                        pa.array(inclusion),
                        pa.array(good),
                    ],
                    ["_id", "sample", "ids", "n_pieces", "log_prob", "perturbed", "log_inclusion", "round_trip"],
                )

    plain = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("0"))).alias("_seed"), F.col(text_col).alias("_text"))
    got = plain.mapInArrow(run, f"_id {kind}, sample int, ids array<int>, n_pieces bigint, log_prob double, perturbed double, log_inclusion double, round_trip boolean")
    return got.withColumnRenamed("_id", id_col)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(read_table(spark, sf_dir, "documents"))
