"""A shard of repeated strings keeps its letters on disk."""

import tracemalloc

import numpy as np
import pyarrow as pa
import zstandard

from tidemark.llm import bytescan as bs
from tidemark.llm import repeats


class Plan:
    """Stands for a DataFrame: gives back the function that would run in a task."""

    def repartitionById(self, *a):
        return self

    def mapInArrow(self, f, schema):
        return f


def test_letters_of_a_shard_lie_on_disk(spark):
    """48 MB of letters, a stretch that shares a run of 100 bytes with another of a smaller id, and a bound of 12 MB."""
    rng, size, n = np.random.default_rng(3), 1 << 20, 48
    shared = rng.integers(97, 123, 100).astype(np.uint8)
    one, two = np.concatenate([rng.integers(97, 123, 60).astype(np.uint8), shared]), np.concatenate([shared, rng.integers(65, 90, 70).astype(np.uint8)])

    def record(h1, h2, doc, letters):
        pressed = np.frombuffer(zstandard.ZstdCompressor(level=1).compress(letters.tobytes()), np.uint8)
        return bs.blob(np.array([h1]), np.array([h2]), np.array([doc]), np.zeros(1, np.uint8), np.array([len(letters)], np.uint32), np.ones(1, np.uint32), np.array([doc]), np.array([doc]), np.array([5], np.uint32), pressed)

    def batches():
        for packed in [record(7, 1, 10, one), *(record(100 + k, 1, 20 + k, np.full(size, 65 + k, np.uint8)) for k in range(n)), record(7, 2, 11, two)]:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([packed], pa.binary())], ["bucket", "kind", "packed"])

    run = repeats._sorted(Plan(), 1, 50)
    tracemalloc.start()
    try:
        out = list(run(batches()))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    ids, spans = bs.unrouted([x for b in out for x in b.column("packed").to_pylist()], np.uint64)
    assert ids.tolist() == [11] and (int(spans[0]) >> 32, int(spans[0]) & 0xFFFFFFFF) == (5, 100)
    assert peak < 12 << 20
