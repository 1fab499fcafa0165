"""Keys of all pieces of a corpus brought together, without a row for each.

A piece sends each bucket (a range of the keys) one message: its distinct keys there, in order, with a value each, packed. The bucket
combines the values of equal keys over all pieces and answers each message with a bit a key. What moves is some bytes a key there
and a bit back, and messages are few as long as they hold many keys.

Pieces and buckets both grow with the corpus, so straight messages would in the end hold a key each. Beyond FAN buckets they
go by relays: a piece sends to FAN wide ranges; a relay takes one such range from some FAN pieces, merges it, and sends to the buckets as a
piece would; and takes the answers apart again. A relay holds about as many keys as a piece, and a key that all pieces have
reaches its bucket once a relay instead of once a piece. With 10^6 keys a piece, two levels keep messages at hundreds of keys up to
some 10^7 pieces.

Keys are numbers of 64 bits, evenly spread (see `mix` and `unmix`), with 32 more if wanted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _K2, _K3, Scratch, giving_back, spread
from .messages import bucket_starts, bytes_apart, bytes_together, pack_ids, unpack_ids

#: Buckets that pieces write to themselves; pieces to a relay.
FAN = 2048
#: The unit of rows that hold a bucket's totals.
TOTALS = -1
_MESSAGE = "_bucket int, _unit bigint, keys binary, low binary, vals binary"


def _inverse(k: np.uint64) -> np.uint64:
    return np.uint64(pow(int(k), -1, 1 << 64))


_I2, _I3 = _inverse(_K2), _inverse(_K3)


def unmix(h: np.ndarray) -> np.ndarray:
    """What `mix` made the hashes of; works in place."""
    h ^= (h >> np.uint64(31)) ^ (h >> np.uint64(62))
    h *= _I3
    h ^= (h >> np.uint64(27)) ^ (h >> np.uint64(54))
    h *= _I2
    h ^= (h >> np.uint64(30)) ^ (h >> np.uint64(60))
    return h


# ---------------------------------------------------------------- messages


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers as distances from the least, as narrow as these allow."""
    least = int(x.min()) if len(x) else 0
    top = int(x.max()) - least if len(x) else 0
    kind = next(k for k in ("u1", "u2", "u4", "u8") if top < 1 << 8 * int(k[1]))
    apart = (x - x.dtype.type(least)).astype(f"<{kind}") if x.dtype != np.int64 else (x.view(np.uint64) - np.uint64(least % (1 << 64))).astype(f"<{kind}")
    return kind[1:].encode() + (least % (1 << 64)).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(bytes_apart(np.ascontiguousarray(apart)))


def unpack_numbers(blob: bytes) -> np.ndarray:
    """The numbers modulo 2**64."""
    raw = zstandard.ZstdDecompressor().decompress(blob[9:])
    return bytes_together(np.frombuffer(raw, np.uint8), f"<u{blob[:1].decode()}").astype(np.uint64) + np.uint64(int.from_bytes(blob[1:9], "little"))


def pack_sorted(x: np.ndarray) -> bytes:
    return pack_numbers(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(blob), dtype=np.uint64)


def pack_bits(mask: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(mask).tobytes())


def unpack_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), count=n).astype(bool)


@dataclass(frozen=True)
class Rule:
    """combine: what the values of equal keys become. holds(total, own): the bit; what holds among some pieces must hold among all."""

    combine: np.ufunc
    holds: Callable[[np.ndarray, np.ndarray], np.ndarray]
    pack: Callable[[np.ndarray], bytes] = pack_numbers
    unpack: Callable[[bytes], np.ndarray] = unpack_numbers


def at_least(n: int) -> Rule:
    """Sums of n and more."""
    return Rule(np.add, lambda total, own: total >= n)


def earlier() -> Rule:
    """Is there a smaller value elsewhere?"""
    return Rule(np.minimum, lambda total, own: total < own, pack_ids, unpack_ids)


def combined(h: np.ndarray, low: np.ndarray | None, vals: np.ndarray, combine: np.ufunc) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Distinct keys in order with their combined values, and the number of each row's key."""
    order = np.argsort(h, kind="stable") if low is None else np.lexsort((low, h))
    h, vals = h[order], vals[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if low is not None:
        low = low[order]
        new[1:] |= low[1:] != low[:-1]
    first = np.flatnonzero(new)
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return h[first], None if low is None else low[first], combine.reduceat(vals, first) if len(first) else vals, number


def messages(unit: int, h: np.ndarray, low: np.ndarray | None, vals: np.ndarray, buckets: int, pack: Callable[[np.ndarray], bytes] = pack_numbers) -> pa.Table:
    """A unit's distinct keys, in order, as a message for each bucket that they meet."""
    at = bucket_starts(h, buckets)
    some = np.flatnonzero(np.diff(at)).tolist()
    cut = [slice(at[k], at[k + 1]) for k in some]
    blob = lambda how, x: pa.array([how(x[c]) if x is not None else None for c in cut], pa.binary())
    return pa.table({"_bucket": pa.array(some, pa.int32()), "_unit": pa.array([unit] * len(some), pa.int64()), "keys": blob(pack_sorted, h), "low": blob(pack_numbers, low), "vals": blob(pack, vals)})


def merged(table: pa.Table, rule: Rule) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, list[tuple[slice, np.ndarray]], np.ndarray]:
    """Of messages: the distinct keys, their low parts and combined values, each message's place among all rows with its own
    values, and each row's key."""
    keys = [unpack_sorted(x.as_py()) for x in table.column("keys")]
    vals = [rule.unpack(x.as_py()).astype(np.int64) for x in table.column("vals")]
    low = [unpack_numbers(x.as_py()).astype(np.uint32) for x in table.column("low")] if table.column("low").null_count == 0 else None
    h, lows, total, number = combined(np.concatenate(keys), np.concatenate(low) if low else None, np.concatenate(vals), rule.combine)
    ends = np.cumsum([len(k) for k in keys])
    return h, lows, total, [(slice(e - len(v), e), v) for e, v in zip(ends.tolist(), vals, strict=True)], number


def replies_to(h: np.ndarray, buckets: int, replies: pa.Table) -> np.ndarray:
    """The bits of a unit's distinct keys, in order, from the answers that it got."""
    at, out = bucket_starts(h, buckets), np.zeros(len(h), bool)
    for k, bits in zip(replies.column("_bucket").to_pylist(), replies.column("bits"), strict=True):
        out[at[k] : at[k + 1]] = unpack_bits(bits.as_py(), int(at[k + 1] - at[k]))
    return out


# ---------------------------------------------------------------- the exchange


class Exchange:
    """buckets: how many ranges of keys there are. units: about how many pieces send (tells the number of relays)."""

    def __init__(self, rule: Rule, buckets: int, units: int, fan: int = FAN):
        self.rule, self.buckets, self.fan = rule, buckets, fan
        self.relays = max(1, -(-units // fan)) if buckets > fan else 0
        #: What pieces give `messages` and `replies_to`.
        self.targets = fan if self.relays else buckets

    def run(self, asked: DataFrame, scratch: Scratch | None = None, name: str = "", bits: bool = True, totals: bool = False) -> tuple[DataFrame, DataFrame]:
        """The bits for each message: rows (_unit, _bucket, bits); and for each bucket a row (keys, low, vals) of the keys that
        hold with their combined values. Both are stored, if there is a scratch folder, and else part of the plan."""
        rule, buckets, relays = self.rule, self.buckets, self.relays

        @giving_back
        def answer(table: pa.Table) -> pa.Table:
            h, low, total, each, number = merged(table, rule)
            out = [("_unit", table.column("_unit").to_pylist() if bits else []), ("_bucket", table.column("_bucket").to_pylist() if bits else [])]
            packed = [pack_bits(rule.holds(total[number[c]], own)) for c, own in each] if bits else []
            more = [[None] * len(packed) for _ in range(3)]
            if totals:
                held = rule.holds(total, total)
                for name, value in (("_unit", TOTALS), ("_bucket", 0)):
                    dict(out)[name].append(value)
                packed.append(None)
                for to, pack, x in zip(more, (pack_sorted, pack_numbers, pack_numbers), (h, low, total), strict=True):
                    to.append(None if x is None else pack(x[held]))
            return pa.table([pa.array(out[0][1], pa.int64()), pa.array(out[1][1], pa.int32()), *(pa.array(x, pa.binary()) for x in (packed, *more))], ["_unit", "_bucket", "bits", "keys", "low", "vals"])

        kind = "_unit bigint, _bucket int, bits binary, keys binary, low binary, vals binary"
        @giving_back
        def relay(table: pa.Table) -> pa.Table:
            h, low, total, _, _ = merged(table, rule)
            return messages(table.column("_relay")[0].as_py(), h, low, total, buckets, rule.pack)

        @giving_back
        def part(table: pa.Table, replies: pa.Table) -> pa.Table:
            h, _, total, each, number = merged(table, rule)
            beyond = replies_to(h, buckets, replies)
            packed = [pack_bits(beyond[number[c]] | rule.holds(total[number[c]], own)) for c, own in each]
            return pa.table({"_unit": table.column("_unit").cast(pa.int64()), "_bucket": table.column("_bucket").cast(pa.int32()), "bits": pa.array(packed, pa.binary())})

        sent = asked.withColumn("_relay", F.col("_bucket").cast("long") * relays + spread(relays, "_unit")) if relays else asked
        reached = sent.groupBy("_relay").applyInArrow(relay, _MESSAGE) if relays else asked
        put = scratch.put if scratch else lambda df, _: df
        answered = put(reached.groupBy("_bucket").applyInArrow(answer, kind), name)
        replies = answered.where(F.col("_unit") != TOTALS).select("_unit", "_bucket", "bits")
        if relays and bits:
            back = replies.withColumnRenamed("_unit", "_relay")
            replies = put(sent.groupBy("_relay").cogroup(back.groupBy("_relay")).applyInArrow(part, "_unit bigint, _bucket int, bits binary"), f"{name}-parts")
        return replies, answered.where(F.col("_unit") == TOTALS).select("keys", "low", "vals")

    def ask(self, pieces: DataFrame, keys_of) -> DataFrame:
        """Messages of stored pieces. keys_of(row): the unit's number, its distinct keys in order, low parts (or None) and values."""
        targets, pack = self.targets, self.rule.pack

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for k in range(batch.num_rows):
                    yield from messages(*keys_of(batch.slice(k, 1).to_pylist()[0]), targets, pack).to_batches()

        return pieces.mapInArrow(run, _MESSAGE)

