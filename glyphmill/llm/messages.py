"""Hashes and numbers packed into messages between pieces of text and buckets of hashes."""

from __future__ import annotations

import numpy as np
import zstandard


def pack_hashes(h: np.ndarray, buckets: int) -> tuple[np.ndarray, list[int], list[bytes]]:
    """Sorted distinct hashes cut into buckets: where each begins, which have any, and for each of these the low 48
    bits as six bytes each, after a compressed count for each value of the top 16 bits."""
    at = bucket_starts(h, buckets)
    some, out = np.flatnonzero(np.diff(at)).tolist(), []
    press = zstandard.ZstdCompressor(level=1)
    for k in some:
        part = h[at[k] : at[k + 1]]
        top = (part >> np.uint64(48)).astype(np.int64)
        counts = np.bincount(top - top[0]).astype("<u4")
        head = press.compress(np.concatenate([[top[0]], counts]).astype("<u4").tobytes())
        low = np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8)[:, :6]
        out.append(len(head).to_bytes(4, "little") + head + low.tobytes())
    return at, some, out


def unpack_hashes(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    head = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4 : 4 + n]), "<u4").astype(np.int64)
    low = np.frombuffer(blob, np.uint8, offset=4 + n).reshape(-1, 6)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :6] = low
    top = np.repeat(np.arange(len(head) - 1) + head[0], head[1:]).astype(np.uint64)
    return out.view("<u8").ravel() | (top << np.uint64(48))


def bucket_starts(h: np.ndarray, buckets: int) -> np.ndarray:
    # by the leading 24 bits, so that SQL can tell a hash's bucket too
    edges = (-(-np.arange(1, buckets, dtype=np.int64) * 2**24 // buckets)).astype(np.uint64) << np.uint64(40)
    return np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])


def bytes_apart(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones...: compresses better."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def bytes_together(raw: np.ndarray, kind: str) -> np.ndarray:
    """What bytes_apart took apart."""
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids of few distinct values: the sorted values' differences and each id's place, compressed."""
    values, place = np.unique(ids, return_inverse=True)
    steps = np.diff(values, prepend=values[:1]).view(np.uint64)
    wide = np.uint32 if len(steps) == 0 or steps.max() < 2**32 else np.uint64
    small = np.uint16 if len(values) <= 65536 else np.uint32
    raw = b"".join(bytes_apart(x) for x in (steps.astype(wide), place.astype(small)))
    head = np.array([len(values), len(ids), wide().itemsize, small().itemsize], "<i8").tobytes() + values[:1].astype("<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + raw)


def unpack_ids(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    nv, n, wide, small = np.frombuffer(raw, "<i8", 4)
    first = np.frombuffer(raw, "<i8", 1, 32)[0]
    steps = bytes_together(np.frombuffer(raw, np.uint8, nv * wide, 40), f"<u{wide}")
    place = bytes_together(np.frombuffer(raw, np.uint8, n * small, 40 + nv * wide), f"<u{small}")
    return (np.cumsum(steps.astype(np.uint64)).view(np.int64) + first)[place]
