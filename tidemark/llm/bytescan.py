"""Vectorised hashing of texts that arrive in Arrow batches, shared by the near-copy operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

M = np.uint64
C1, C2, C3 = M(0x9E3779B97F4A7C15), M(0xBF58476D1CE4E5B9), M(0x94D049BB133111EB)
#: Texts are hashed in pieces of about so many bytes.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> M(30))
    x = x * C2
    x ^= x >> M(27)
    x *= C3
    x ^= x >> M(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[M(1)], np.full(max(0, n - 1), base, dtype=M)]))[:n]


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * C1)
_BASE = int(C1)
_UNBASE = pow(_BASE, -1, 1 << 64)


def prefix_sums(flat: np.ndarray) -> np.ndarray:
    """Running sums of letters times powers of the base."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[flat] * powers(_BASE, len(flat)))])


def digests(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings between starts and ends: the same for equal strings anywhere."""
    back = powers(_UNBASE, len(sums))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * C3)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o, d


def portion(buckets: int) -> int:
    """Bytes of text whose finds are dealt at once: more for more buckets, so that records, and what each one costs, don't grow in number with both texts and buckets."""
    return min(8 << 20, max(PIECE, buckets << 14))


def joined(pieces, most: int):
    """Tuples (size, arrays...) as lists of joined arrays, of `most` bytes or somewhat more each."""
    held, size = [], 0
    for n, *arrays in pieces:
        held.append(arrays)
        size += n
        if size >= most:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def runs(offsets: np.ndarray, size: int = PIECE):
    """Row ranges [a, b) of about `size` bytes each; a row is never parted."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def grouped(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of runs of equal values."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
    return begins, np.diff(np.concatenate([begins, [len(ids)]]))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    sizes = sizes.astype(np.int64)
    return np.repeat(starts.astype(np.int64) - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def blob(*arrays: np.ndarray) -> bytes:
    """Arrays as one value: their lengths, then their bytes."""
    head = np.array([len(a) for a in arrays], dtype=np.int64)
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


def unblob(value: bytes, *kinds) -> list[np.ndarray]:
    head, at, out = np.frombuffer(value, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(head, kinds, strict=True):
        kind = np.dtype(kind)
        out.append(np.frombuffer(value, kind, int(n), at))
        at += int(n) * kind.itemsize
    return out


def grouped_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of runs of equal pairs."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1])
    return begins, np.diff(np.concatenate([begins, [len(a)]]))


SHARED = "bucket int, known boolean, packed binary"


def pack_shared(values: np.ndarray, keys: np.ndarray, rows: np.ndarray, buckets: int, turn: int):
    """Deal a chunk's (64-bit value, key, row) triples into one packed record for each bucket (fields of SHARED).

    A value that two keys of the chunk have is known to be shared: its rows go
    out as a record of their own, which needs no meeting, and the bucket gets one
    mark. So a value that very many rows have costs a bucket one mark a chunk.
    """
    if not len(values):
        return
    bucket = (values % M(buckets)).astype(np.int64)
    value = (values >> M(32)).astype(np.uint32)
    order = np.lexsort((keys, value, bucket))
    b, v, k, r = bucket[order], value[order], keys[order], rows[order]
    begins, sizes = grouped_pairs(b, v)
    new_key = np.concatenate([[True], (b[1:] != b[:-1]) | (v[1:] != v[:-1]) | (k[1:] != k[:-1])])
    distinct = np.add.reduceat(new_key.astype(np.int64), begins)
    known = np.repeat(distinct > 1, sizes)
    if known.any():
        kb, kv, kr = b[known], v[known], r[known]
        order = np.lexsort((kv, kb, kr))
        yield turn % buckets, True, blob(kr[order], kb[order].astype(np.uint32), kv[order])
    marks = begins[distinct > 1]
    mb, mv = b[marks], v[marks]
    b, v, k, r = b[~known], v[~known], k[~known], r[~known]
    order = np.lexsort((r, b))
    b, v, k, r = b[order], v[order], k[order], r[order]
    cuts, mcuts = np.searchsorted(b, np.arange(buckets + 1)), np.searchsorted(mb, np.arange(buckets + 1))
    for n in np.flatnonzero((np.diff(cuts) > 0) | (np.diff(mcuts) > 0)):
        part = slice(cuts[n], cuts[n + 1])
        at, counts = grouped(r[part])
        yield int(n), False, blob(r[part][at], k[part][at], counts.astype(np.uint32), v[part], mv[mcuts[n] : mcuts[n + 1]])


def unpack_shared(bucket: int, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values) of a bucket whose value another key has too; a row's values stand together."""
    found = [unblob(x, np.int64, np.int64, np.uint32, np.uint32, np.uint32) for x in packed]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    r = np.concatenate([np.repeat(x[0], x[2]) for x in found])
    k = np.concatenate([np.repeat(x[1], x[2]) for x in found])
    v = np.concatenate([x[3] for x in found])
    marks = np.unique(np.concatenate([x[4] for x in found]))
    order = np.lexsort((k, v))
    k, v, r = k[order], v[order], r[order]
    if not len(v):
        return r, v
    begins, sizes = grouped(v)
    new_key = np.concatenate([[True], (v[1:] != v[:-1]) | (k[1:] != k[:-1])])
    distinct = np.add.reduceat(new_key.astype(np.int64), begins)
    shared = np.repeat((distinct > 1) | np.isin(v[begins], marks), sizes)
    r, v = r[shared], v[shared]
    order = np.argsort(r, kind="stable")
    return r[order], v[order]


ROUTED = "bucket int, packed binary"
#: Bytes of pairs that are packed by bucket at once.
ROUTED_AT_ONCE = 32 << 20


def routed(rows: np.ndarray, values: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(row, value) pairs, in which a row's values stand together, packed by the row's bucket: fields of ROUTED."""
    at, counts = grouped(rows)
    bucket = (mix(rows[at].astype(np.int64).view(np.uint64)) % M(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cuts))
    out = []
    for n in used:
        mine = order[cuts[n] : cuts[n + 1]]
        times = counts[mine]
        flat = np.repeat(at[mine] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        out.append(blob(rows[at[mine]], times.astype(np.uint32), values[flat]))
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(out, pa.binary())], ["bucket", "packed"])


def unrouted(packed: list[bytes], kind) -> tuple[np.ndarray, np.ndarray]:
    """All (row, value) pairs of a bucket, a row's values together."""
    parts = [unblob(x, np.int64, np.uint32, kind) for x in packed]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, kind)
    rows = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
    values = np.concatenate([p[2] for p in parts])
    order = np.argsort(rows, kind="stable")
    return rows[order], values[order]
