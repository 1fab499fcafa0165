"""Token ids as compressed binary files, in order of document id.

Ids of a file are one sequence, cut into blocks of BLOCK ids that reset the model and carry a checksum
each, so that any block can be read alone. Within a block a range coder codes each id under a mixture of

* order 2: the id that last followed the two ids before;
* order 1: the id that last followed the one id before;
* order 0: which of BINS bins the id is in, under frequencies that adapt in the block (renewed every
  RENEW ids), and the id within its bin under the file's frequencies.

The weights of the orders are learnt in the block. A prediction is in one of four states: none yet, not yet seen
to be right, right once in a row, right more often. For each pair of the two orders' states, and whether both predict
the same id, the share of ids that order 2 got right, and that only order 1 got right, are kept as moving averages,
and are the weights of order 2 and order 1 there; order 0 has what is left, an eighth at least.

All arithmetic is on integers. The blocks of a file are coded side by side, a numpy operation handling a
step of all of them: a block's bytes are the same as if it were coded alone.

File: b"GMIDS1\\n", the length of the head (8 bytes), the head (zstd: JSON with sizes, then the document
ids, null flags and lengths, the order-0 ids and counts, and each block's bytes and CRC-32 of its ids),
the blocks. Files are written to the shared folder under a temporary name and then moved, so a task that
runs twice leaves one whole file.

Cases: null and empty texts have the end id alone; null document ids come first; rows of one document id
are documents each, in order of a hash of their text; ids that aren't whole numbers raise an error; an empty table gives no documents; further columns
are not read. A damaged block or head is reported by number, never decoded.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batches, read_table, shares, span_hashes

MAGIC = b"GMIDS1\n"
BLOCK, BINS, RENEW = 2048, 32, 16
SLOTS1, SLOTS2 = 512, 1024
#: Bytes of text in a file.
FILE_BYTES = 16 << 20
_JOINT = 32  # pairs of states of a prediction, twice
_RATE = 4  # of the moving averages
_TOTAL = 1 << 16  # of the coder's frequencies
_FINE = 1 << 12  # of the bins' frequencies
_LOW = np.uint64(0xFFFFFFFF)


class DamagedFile(ValueError):
    pass


# ---------------------------------------------------------------- order 0


class Order0:
    """The file's ids by falling count, cut into bins of about equal mass. Per id number (place in that
    order): its bin, and its frequency range within the bin, of _TOTAL."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.counts = ids, counts
        mass = np.cumsum(counts) - counts
        self.bin = np.minimum(mass * BINS // max(int(counts.sum()), 1), BINS - 1).astype(np.int64)
        self.begin, self.size = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for b in range(BINS):
            k = np.flatnonzero(self.bin == b)
            if len(k):
                self.size[k] = self._quantised(counts[k])
                self.begin[k] = np.cumsum(self.size[k]) - self.size[k]
        self.number = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
        self.number[ids] = np.arange(len(ids))

    def by_value(self) -> np.ndarray:
        """The number at each bin * _TOTAL + value."""
        out = np.zeros(BINS * _TOTAL, np.uint16 if len(self.ids) <= 1 << 16 else np.uint32)
        for b in np.unique(self.bin):
            k = np.flatnonzero(self.bin == b)
            out[b * _TOTAL : (b + 1) * _TOTAL] = np.repeat(k, self.size[k])
        return out

    @staticmethod
    def _quantised(c: np.ndarray) -> np.ndarray:
        f = np.maximum(1, c * _TOTAL // c.sum())
        spare = _TOTAL - int(f.sum())
        if spare >= 0:
            f[0] += spare
            return f
        k = 0
        while spare < 0:  # take from the largest what the least had to be given
            cut = min(int(f[k]) - 1, -spare)
            f[k] -= cut
            spare += cut
            k += 1
        return f

    @classmethod
    def of(cls, stream: np.ndarray) -> Order0:
        counts = np.bincount(stream) if len(stream) else np.zeros(0, np.int64)
        ids = np.flatnonzero(counts)
        order = np.argsort(-counts[ids], kind="stable")
        return cls(ids[order], counts[ids][order].astype(np.int64))


# ---------------------------------------------------------------- the model, for all blocks at once


#: Weights to begin with, by the states of order 2 and of order 1 and whether they agree.
_ALONE = np.array([0, 10, 34, 54]) / 64
_FIRST2 = np.concatenate([np.repeat(_ALONE, 4), np.repeat(_ALONE, 4) ** 0.5])
_FIRST1 = np.concatenate([((1 - _ALONE)[:, None] * _ALONE).ravel(), np.zeros(16)])
_FIRST = [np.round(x * 65535).astype(np.int32) for x in (_FIRST1, _FIRST2)]


def contexts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The slots of order 1 and order 2, within a block's, of the two numbers (uint32) before: a, then b."""
    out = np.empty((2, *a.shape), np.uint32)
    np.multiply(b, np.uint32(40503), out=out[0])
    np.multiply(a, np.uint32(2654435761), out=out[1])
    out[1] += out[0]
    out[0] >>= np.uint32(4)
    out[0] &= np.uint32(SLOTS1 - 1)
    out[1] >>= np.uint32(7)
    out[1] &= np.uint32(SLOTS2 - 1)
    return out


class Model:
    """What `lanes` blocks have learnt so far. Ids are numbers of Order0. A slot of `table` holds four times the predicted
    number, and its state; `weight` the weights by joint state, of 2**16. Both have order 1's part first, then order 2's,
    as rows of two have: order 1, order 2."""

    def __init__(self, lanes: int):
        self.whole = lanes
        self.table = np.zeros(lanes * (SLOTS1 + SLOTS2), np.int32)
        self.weight = np.concatenate([np.tile(x, lanes) for x in _FIRST])
        self.bins = np.full((BINS, lanes), 4, np.int32)
        self.upto = np.zeros((BINS + 1, lanes), np.int32)
        self._lanes(lanes)

    def _lanes(self, n: int) -> None:
        self.lane = lane = np.arange(n)
        self.slots = np.stack([lane * SLOTS1, lane * SLOTS2 + self.whole * SLOTS1])
        self.states = np.stack([lane, lane + self.whole]) * _JOINT
        self.flat = self.upto.ravel()

    def shrink(self, n: int) -> None:
        """Only the first n blocks go on."""
        self.bins, self.upto = self.bins[:, :n].copy(), self.upto[:, :n].copy()
        self._lanes(n)

    def renew(self, came: np.ndarray | None) -> None:
        """New frequencies of the bins; came: the bins of the RENEW steps before."""
        n = len(self.lane)
        if came is not None:
            self.bins += (8 * np.bincount((came * n + self.lane).ravel(), minlength=BINS * n)).reshape(BINS, n)
        share = self.bins * float(_FINE - BINS)
        share /= self.bins.sum(0)  # of whole numbers this small: never rounded up to the next
        np.cumsum(share.astype(np.int32) + np.int32(1), 0, out=self.upto[1:])
        self.upto[BINS] = _FINE

    def predict(self, at: np.ndarray) -> None:
        """From the slots of both orders: sets the predicted numbers p, and the widths w, both together w12, and
        order 0's w0."""
        self.at, self.v = at, self.table.take(at)
        self.p, self.state = self.v >> 2, self.v & 3
        joint = (self.p[0] == self.p[1]) * np.int32(16)
        joint += self.state[1] << 2
        joint += self.state[0]
        self.joint = joint + self.states
        self.r = self.weight.take(self.joint)
        # at most 7/8 both together: the averages of one joint state add up to 2**16 at most
        self.w = self.r * 7
        self.w >>= 3
        self.w12 = self.w[0] + self.w[1]
        self.w0 = _TOTAL - self.w12

    def learn(self, x: np.ndarray, hit: np.ndarray) -> None:
        """x: the numbers (int32) that came, and whether each order predicted them."""
        first = x << 2
        first += 1
        # right: surer by one. Wrong: less sure by one, or the new number where it had not been right.
        fresh = (self.state < 2) > hit
        surer = hit & (self.state < 3)
        self.v += surer.view(np.int8) - (~hit).view(np.int8)
        np.copyto(self.v, first, where=fresh)
        self.table[self.at] = self.v
        hit[0] &= ~hit[1]
        self.r -= self.r >> _RATE
        self.r += hit * np.int32(65535 >> _RATE)
        self.weight[self.joint] = self.r


class Coder:
    """The interval of a carry-free range coder per lane: 64 bits, 32 of them passed at a time."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)

    def narrow(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """To [begin, begin + size) of _TOTAL; the lanes that pass 32 bits, whose interval is moved on by
        `move` after that."""
        n = len(begin)
        r = self.range[:n]
        r >>= np.uint64(16)
        self.low[:n] += r * begin.view(np.uint64)
        r *= size.view(np.uint64)
        small = np.flatnonzero(r < np.uint64(1 << 32))
        if len(small):
            lo, ra = self.low[small], r[small]
            # an interval across a multiple of 2**32 is cut there
            open_ = (lo ^ (lo + ra - np.uint64(1))) >> np.uint64(32) != 0
            ra[open_] = np.uint64(1 << 32) - (lo[open_] & _LOW)
            r[small] = ra << np.uint64(32)
        return small

    def move(self, small: np.ndarray) -> None:
        self.low[small] <<= np.uint64(32)


class Encoder(Coder):
    def __init__(self, lanes: int):
        super().__init__(lanes)
        self.out: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, begin: np.ndarray, size: np.ndarray) -> None:
        small = self.narrow(begin, size)
        if len(small):
            self.out.append((small, (self.low[small] >> np.uint64(32)).astype("<u4")))
            self.move(small)

    def finish(self) -> list[bytes]:
        lanes = len(self.low)
        every = np.arange(lanes)
        tail = [(every, (self.low >> np.uint64(32)).astype("<u4")), (every, (self.low & _LOW).astype("<u4"))]
        lane = np.concatenate([x for x, _ in [*self.out, *tail]])
        word = np.concatenate([x for _, x in [*self.out, *tail]])
        # 16-bit numbers are sorted in linear time
        order = np.argsort(lane.astype(np.uint16) if lanes <= 1 << 16 else lane, kind="stable")
        cut = np.concatenate([[0], np.cumsum(np.bincount(lane, minlength=lanes))])
        raw = word[order].astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Decoder(Coder):
    def __init__(self, blocks: list[bytes]):
        super().__init__(len(blocks))
        size = np.array([len(b) // 4 for b in blocks])
        self.word = np.concatenate([np.frombuffer(b"".join(blocks), "<u4").astype(np.uint64), np.zeros(4, np.uint64)])
        at = np.cumsum(size) - size
        self.code = (self.word[at] << np.uint64(32)) | self.word[at + 1]
        self.at = at + 2

    def value(self, n: int) -> np.ndarray:
        """Where in _TOTAL the codes of the first n lanes stand."""
        v = (self.code[:n] - self.low[:n]) // (self.range[:n] >> np.uint64(16))
        return np.minimum(v, np.uint64(_TOTAL - 1)).view(np.int64)

    def take(self, begin: np.ndarray, size: np.ndarray) -> None:
        small = self.narrow(begin, size)
        if len(small):
            at = np.minimum(self.at[small], len(self.word) - 1)
            self.code[small] = (self.code[small] << np.uint64(32)) | self.word[at]
            self.at[small] += 1
            self.move(small)


def encode_blocks(numbers: np.ndarray, o: Order0) -> list[bytes]:
    """The coded blocks of a sequence of id numbers."""
    n = len(numbers)
    lanes = -(-n // BLOCK)
    if not lanes:
        return []
    grid = np.zeros(lanes * BLOCK, np.int32)
    grid[:n] = numbers
    # a step's ids side by side, below two rows of zeros; the last block may be shorter
    grid = np.concatenate([np.zeros((2, lanes), np.int32), grid.reshape(lanes, BLOCK).T])
    last = n - (lanes - 1) * BLOCK
    m, coder, bins = Model(lanes), Encoder(lanes), None
    for t in range(min(BLOCK, n)):
        if t == last:
            lanes -= 1
            m.shrink(lanes)
        k = t % RENEW
        if k == 0:
            # what the next steps have from the ids alone
            m.renew(None if bins is None else bins[:, :lanes])
            rows = grid[t : t + RENEW + 2, :lanes]
            slots = contexts(rows[:-2].view(np.uint32), rows[1:-1].view(np.uint32)) + m.slots[:, None]
            bins, inside, wide = (a.take(rows[2:]) for a in (o.bin, o.begin, o.size))
            place = bins * lanes + m.lane
            edge = m.flat.take(np.stack([place, place + lanes]))
        x = grid[t + 2, :lanes]
        m.predict(slots[:, k, :lanes])
        begin, size = span = m.w0 * edge[:, k, :lanes]
        span >>= 12
        size -= begin
        begin += m.w12
        hit = m.p == x
        one, two = sure = hit & (m.w > 0)
        narrow(m, begin, size, one, two)
        coder.put(begin.astype(np.int64), size.astype(np.int64))
        alone, width = inside[k, :lanes], wide[k, :lanes]
        one |= two
        np.copyto(alone, 0, where=one)
        np.copyto(width, _TOTAL, where=one)
        coder.put(alone, width)
        m.learn(x, hit)
    return coder.finish()


def narrow(m: Model, begin: np.ndarray, size: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """Instead of order 0's, the ranges of order 1 (one) and of order 2 (two, which goes first)."""
    np.copyto(begin, m.w[1], where=one)
    np.copyto(size, m.w[0], where=one)
    np.copyto(begin, 0, where=two)
    np.copyto(size, m.w[1], where=two)


def decode_blocks(blocks: list[bytes], lengths: np.ndarray, o: Order0) -> np.ndarray:
    """The id numbers of blocks; only the last may be shorter than BLOCK."""
    lanes = len(blocks)
    if not lanes:
        return np.zeros(0, np.int64)
    grid = np.zeros((BLOCK + 2, lanes), np.int32)
    total, last = lanes, int(lengths[-1])
    m, coder, by_value, bins = Model(lanes), Decoder(blocks), o.by_value(), np.zeros((RENEW, lanes), np.int64)
    for t in range(int(lengths.max())):
        if t == last:
            lanes -= 1
            m.shrink(lanes)
        if t % RENEW == 0:
            m.renew(bins[:, :lanes] if t else None)
        if t % RENEW == 0 or t == last:
            edges = m.upto[1:BINS].astype(np.uint16)
        m.predict(contexts(*grid[t : t + 2, :lanes].view(np.uint32)) + m.slots)
        v = coder.value(lanes)
        y = v - m.w12
        # w0 * edge >> 12 <= y as a test of the edge
        most = (y + 1) * float(_FINE)
        most -= 1
        most /= m.w0  # of whole numbers this small: never rounded up to the next
        np.clip(most, 0, _FINE, out=most)
        b = (edges <= most.astype(np.uint16)).view(np.uint8).sum(0, dtype=np.uint8).astype(np.int64)
        place = b * lanes + m.lane
        begin, size = span = m.w0 * m.flat.take(np.stack([place, place + lanes]))
        span >>= 12
        size -= begin
        begin += m.w12
        one, two = y < 0, v < m.w[1]
        narrow(m, begin, size, one, two)
        coder.take(begin.astype(np.int64), size.astype(np.int64))
        u = coder.value(lanes)
        u += b << 16
        k = by_value.take(u).astype(np.int32)
        inside, wide = o.begin.take(k, mode="clip"), o.size.take(k, mode="clip")
        np.copyto(k, m.p[0], where=one)
        np.copyto(k, m.p[1], where=two)
        np.copyto(inside, 0, where=one)
        np.copyto(wide, _TOTAL, where=one)
        coder.take(inside, wide)
        grid[t + 2, :lanes] = k
        bins[t % RENEW, :lanes] = o.bin.take(k, mode="clip")
        m.learn(k, m.p == k)
    out = grid[2:].T.reshape(-1)
    return out[: (total - 1) * BLOCK + last].astype(np.int64)


# ---------------------------------------------------------------- files


def crc_blocks(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(ids[k : k + BLOCK].astype("<u4").tobytes()) for k in range(0, len(ids), BLOCK)], "<u4")


def dump(doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes: documents in order, all their ids in a row."""
    o = Order0.of(ids)
    blocks = encode_blocks(o.number[ids], o) if len(ids) else []
    parts = [doc_ids.astype("<i8"), null.astype("u1"), lengths.astype("<u4"), o.ids.astype("<u4"), o.counts.astype("<u8"), np.array([len(b) for b in blocks], "<u4"), crc_blocks(ids)]
    meta = json.dumps({"docs": len(doc_ids), "ids": len(ids), "symbols": len(o.ids), "blocks": len(blocks), "block": BLOCK}).encode()
    plain = struct.pack("<I", len(meta)) + meta + b"".join(p.tobytes() for p in parts)
    head = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(plain)
    return MAGIC + struct.pack("<Q", len(head)) + head + b"".join(blocks)


class IdFile:
    """A file opened from its bytes."""

    def __init__(self, raw: bytes):
        if raw[: len(MAGIC)] != MAGIC:
            raise DamagedFile("not an id file")
        (n,) = struct.unpack_from("<Q", raw, len(MAGIC))
        at = len(MAGIC) + 8
        try:
            plain = zstandard.ZstdDecompressor().decompress(raw[at : at + n])
        except zstandard.ZstdError as e:
            raise DamagedFile("damaged head") from e
        (k,) = struct.unpack_from("<I", plain)
        self.meta = json.loads(plain[4 : 4 + k])
        p = 4 + k
        out = []
        for kind, count in (("<i8", "docs"), ("u1", "docs"), ("<u4", "docs"), ("<u4", "symbols"), ("<u8", "symbols"), ("<u4", "blocks"), ("<u4", "blocks")):
            x = np.frombuffer(plain, kind, self.meta[count], p)
            p += x.nbytes
            out.append(x)
        self.doc_ids, self.null, lengths, ids, counts, sizes, self.crc = out
        self.lengths = lengths.astype(np.int64)
        self.order0 = Order0(ids.astype(np.int64), counts.astype(np.int64))
        cut = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))]) + at + n
        self.blocks = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.block_ids = np.minimum(BLOCK, self.meta["ids"] - np.arange(len(self.blocks)) * BLOCK)

    def read(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The ids of blocks lo to hi (all)."""
        hi = len(self.blocks) if hi is None else hi
        if lo >= hi:
            return np.zeros(0, np.int64)
        if any(len(b) < 8 or len(b) % 4 for b in self.blocks[lo:hi]):
            raise DamagedFile("a block is cut short")
        numbers = decode_blocks(self.blocks[lo:hi], self.block_ids[lo:hi], self.order0)
        if len(numbers) and (numbers.min() < 0 or numbers.max() >= len(self.order0.ids)):
            raise DamagedFile(f"blocks {lo} to {hi - 1} don't decode")
        ids = self.order0.ids[numbers]
        wrong = np.flatnonzero(crc_blocks(ids) != self.crc[lo:hi])
        if len(wrong):
            raise DamagedFile(f"block {lo + int(wrong[0])} has a wrong checksum")
        return ids


# ---------------------------------------------------------------- tokenising


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_SEEN = np.zeros(256, bool)
_SEEN[[*range(33, 127), 0xC3]] = True
#: Kinds of ASCII characters that the tokenizer's pattern never has in one token: letters, digits, signs.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
#: Bits of a hash that choose its place in the table of parts last met.
_NEAR = 19


class Tokens:
    """Ids of whole texts. The pattern of byte-level tokenizers always parts a text before a single space between two
    other characters, and between a letter, digit or sign and an ASCII one of another kind (but for an apostrophe and a letter, which
    may be a contraction), so the parts between are encoded on their own, each distinct one once, and remembered. A text
    that holds an added token is encoded as a whole: the tokenizer cuts at these first. Texts of tokenizers
    with another pattern, or that normalise, are all encoded as a whole."""

    HELD = 1 << 21

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        how = json.loads(self.tokenizer.to_str())
        pattern = how["pre_tokenizer"] or {}
        self.parted = how["normalizer"] is None and pattern.get("type") == "ByteLevel" and pattern["use_regex"] and not pattern["add_prefix_space"]
        # a byte-level piece has a character for each of its bytes
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.length = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for text, i in vocabulary.items():
            self.length[i] = len(text)
        self.clear()

    def clear(self) -> None:
        self.hash, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.near_hash, self.near_slot = np.zeros(1 << _NEAR, np.uint64), np.zeros(1 << _NEAR, np.int64)
        self.near_hash[0] = 2**64 - 1  # a hash whose place is another

    def _added_at(self, data: np.ndarray) -> np.ndarray:
        """Where added tokens begin, in order."""
        raw, out = data.tobytes(), []
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                out.append(at)
                at = raw.find(token, at + 1)
        return np.sort(np.array(out, np.int64))

    def encode(self, data: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each text followed by `end`; how many each has."""
        n = len(off) - 1
        if len(self.hash) > self.HELD:
            self.clear()
        if len(data):
            added = self._added_at(data)
            begin = self._cuts(data, off, added) if self.parted else np.zeros(len(data), bool)
            begin[off[:-1][np.diff(off) > 0]] = True
            s = np.flatnonzero(begin)
            e = np.append(s[1:], len(data))
            slot = self._slots(data, s, e, added)
            times = (self.begin[1:] - self.begin[:-1])[slot]
        else:
            s, slot, times = (np.zeros(0, np.int64),) * 3
        part = np.searchsorted(s, off)
        upto = np.concatenate([[0], np.cumsum(times)])
        count = upto[part[1:]] - upto[part[:-1]] + 1
        out = np.full(int(count.sum()), end, np.int32)
        # each part's ids stand after those before it and the end ids of the texts before
        place = upto[:-1] + np.repeat(np.arange(n), np.diff(part))
        inside = np.arange(upto[-1]) - np.repeat(upto[:-1], times)
        out[np.repeat(place, times) + inside] = self.ids[np.repeat(self.begin[slot], times) + inside]
        return out, count

    def _cuts(self, data: np.ndarray, off: np.ndarray, added: np.ndarray) -> np.ndarray:
        """For each byte, whether a part of a text begins at it, but for texts' first bytes."""
        # cut only between printable ASCII and letters U+00C0 to U+00FF: other bytes may be of blanks
        begin = data == 0x20
        begin[0] = False
        before = data[:-2]
        first_ok, tail = _SEEN[data], np.zeros(len(data), bool)
        tail[1:] = data[:-1] == 0xC3
        mid = begin[1:-1]
        mid &= (((before > 32) & (before < 127)) | tail[:-2]) & first_ok[2:]
        if len(begin) > 1:
            begin[-1] = False
        kind = _KIND[data]
        # letters U+00C0 to U+00FF; two signs are among them
        kind[tail & (data != 0x97) & (data != 0xB7)] = 1
        own, last = kind[1:], kind[:-1]
        between = (own != last) & (own != 0) & (last != 0)
        between &= ~((data[:-1] == 0x27) & (own == 1))
        begin[1:] |= between
        for t in np.unique(np.searchsorted(off, added, "right") - 1).tolist():
            begin[off[t] : off[t + 1]] = False
        return begin

    def _encode(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, added: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct parts, and how many each has. Parts that begin with a space or line feed are encoded
        many at once, one after the other - the tokenizer parts them - and their ids told apart by bytes. Parts
        that hold an added token are encoded each alone, since such a token may not have the bytes it stands for."""
        raw = data.tobytes()
        own = e - s
        led = ((data[s] == 0x20) | (data[s] == 0x0A)) & (own > 1)
        led[led] &= _SEEN[data[s[led] + 1]] & (data[e[led] - 1] > 32) & (data[e[led] - 1] != 0x7F)
        led[led] &= (data[e[led] - 1] < 0x80) | (data[np.maximum(e[led] - 2, 0)] == 0xC3)
        alone = np.searchsorted(added, e) > np.searchsorted(added, s) if self.parted else np.ones(len(s), bool)
        led &= ~alone
        order = np.concatenate([np.flatnonzero(led), np.flatnonzero(~led & ~alone), np.flatnonzero(alone)])
        n = int(led.sum())
        texts = []
        for lo in range(0, n, 4096):
            texts.append(b"".join([raw[a:b] for a, b in zip(s[order[lo : min(lo + 4096, n)]].tolist(), e[order[lo : min(lo + 4096, n)]].tolist(), strict=True)]).decode())
        texts += [raw[a:b].decode() for a, b in zip(s[order[n:]].tolist(), e[order[n:]].tolist(), strict=True)]
        got = [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate(got) if got else np.zeros(0, np.int32)
        # ids' bytes add up to the parts' bytes, in order
        spelt = len(s) - int(alone.sum())
        single = np.array([len(x) for x in got[len(got) - len(s) + spelt :]], np.int64)
        upto = np.concatenate([[0], np.cumsum(self.length[flat[: len(flat) - int(single.sum())]])])
        size = np.cumsum(own[order[:spelt]])
        cut = np.searchsorted(upto, np.concatenate([[0], size]))
        if upto[-1] != own[order[:spelt]].sum() or (upto[cut[1:]] != size).any():
            raise ValueError("the tokenizer's ids don't spell the texts")
        cut = np.concatenate([cut, cut[-1] + np.cumsum(single)])
        begin, count = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
        begin[order], count[order] = cut[:-1], np.diff(cut)
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return flat[at], count

    def _slots(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, added: np.ndarray) -> np.ndarray:
        """Numbers of the parts. Most are in the table of parts last met; only the others are sorted and looked up."""
        h = span_hashes(data, s, e)
        place = (h >> np.uint64(64 - _NEAR)).view(np.int64)
        out = self.near_slot.take(place)
        miss = np.flatnonzero(self.near_hash.take(place) != h)
        if len(miss):
            own, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            first = miss[first]
            slot = self._stored(own, data, s[first], e[first], added)
            out[miss] = slot[back]
            self.near_hash[place[first]], self.near_slot[place[first]] = own, slot
        return out

    def _stored(self, own: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray, added: np.ndarray) -> np.ndarray:
        """Numbers of distinct parts by their hashes, in order; parts not met before are encoded."""
        at = np.minimum(np.searchsorted(self.hash, own), max(len(self.hash) - 1, 0))
        known = self.hash[at] == own if len(self.hash) else np.zeros(len(own), bool)
        new = np.flatnonzero(~known)
        if not len(new):
            return self.slot[at]
        flat, size = self._encode(data, s[new], e[new], added)
        slots = np.arange(len(new)) + len(self.begin) - 1
        self.ids = np.concatenate([self.ids, flat])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(size)])
        self.hash, self.slot = np.concatenate([self.hash, own[new]]), np.concatenate([self.slot, slots])
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.slot = self.hash[order], self.slot[order]
        return self.slot[np.searchsorted(self.hash, own)]


@functools.lru_cache(1)
def tokens_of(path: str) -> Tokens:
    """One for each Python worker: what a task's texts had is known to the next task."""
    return Tokens(path)


# ---------------------------------------------------------------- over tables


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_ids(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, files: int | None = None) -> list[tuple[str, int, int]]:
    """Write the ids of all texts to `folder`, in order of document id over the files; (name, documents,
    ids) of each file, in order."""
    from pyarrow import fs

    path = tokenizer or default_tokenizer()
    files = files or shares(docs, text_col, FILE_BYTES)
    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    parts = plain.repartitionByRange(files, "_id", "_tie").sortWithinPartitions("_id", "_tie")
    _place(folder)[0].create_dir(_place(folder)[1], recursive=True)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        doc_ids, null, lengths, ids = [], [], [], []
        for batch, data, off in batches(it, "_text"):
            got, count = tokens.encode(data, off, end_id)
            own = batch.column(0)
            doc_ids.append(np.asarray(own.fill_null(0))), null.append(np.asarray(own.is_null()))
            lengths.append(count), ids.append(got)
        if not doc_ids:
            return
        part = TaskContext.get().partitionId()
        raw = dump(*(np.concatenate(x) for x in (doc_ids, null, lengths, ids)))
        store, at = _place(folder)
        name = f"ids-{part:06d}.gmids"
        draft = f"{at}/.{name}.{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(draft) as f:
            f.write(raw)
        if store.get_file_info(f"{at}/{name}").type != fs.FileType.NotFound and not isinstance(store, (fs.LocalFileSystem, fs.SubTreeFileSystem)):
            store.delete_file(f"{at}/{name}")
        store.move(draft, f"{at}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sum(map(len, doc_ids))]), pa.array([sum(map(len, ids))])], ["name", "docs", "ids"])

    rows = parts.mapInArrow(run, "name string, docs bigint, ids bigint").collect()  # a row per file
    return sorted((r.name, r.docs, r.ids) for r in rows)


def read_ids(spark: SparkSession, folder: str, files: list[tuple[str, int, int]], digest: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, and the ids (or, with digest, their CRC-32)."""
    start, rows = 0, []
    for name, _, n in files:
        rows.append((name, start))
        start += n
    kind = "ids_crc32 bigint" if digest else "ids array<int>"

    def lists(docs: pa.Array, cut: np.ndarray, at: int, lengths: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        lo = 0
        while lo < len(lengths):  # a list array's offsets have 32 bits
            hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + (1 << 24), "right")) - 1)
            own = pa.ListArray.from_arrays(pa.array((cut[lo : hi + 1] - cut[lo]).astype(np.int32)), pa.array(ids[cut[lo] : cut[hi]].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([docs[lo:hi], pa.array(cut[lo:hi] + at), pa.array(lengths[lo:hi]), own], ["doc_id", "start", "n_tokens", "ids"])
            lo = hi

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = _place(folder)
                with store.open_input_stream(f"{path}/{name}") as f:
                    file = IdFile(f.read())
                ids = file.read()
                cut = np.concatenate([[0], np.cumsum(file.lengths)])
                docs = pa.array(file.doc_ids, mask=file.null.astype(bool))
                if digest:
                    raw = ids.astype("<u4").tobytes()
                    last = pa.array([zlib.crc32(memoryview(raw)[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.int64())
                else:
                    yield from lists(docs, cut, at, file.lengths, ids)
                    continue
                yield pa.RecordBatch.from_arrays([docs, pa.array(cut[:-1] + at), pa.array(file.lengths), last], ["doc_id", "start", "n_tokens", kind.split()[0]])

    listed = spark.createDataFrame(rows, "name string, start bigint").repartition(max(len(rows), 1))
    return listed.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {kind}")


def op10_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{Scratch(spark).root}/ids"
    return read_ids(spark, folder, write_ids(read_table(spark, sf_dir, "documents"), folder), digest=True)
