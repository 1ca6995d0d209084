"""What the removal of repeats costs when there are many shards, or more letters in one than a sort holds."""

import numpy as np
import pyarrow as pa

from tidemark.llm import bytescan as bs
from tidemark.llm import induced, repeats


class Plan:
    """Stands for a DataFrame: keeps the functions that would run in tasks."""

    def __init__(self):
        self.steps = []

    def repartitionById(self, *a):
        return self

    def mapInArrow(self, f, schema):
        self.steps.append(f)
        return self


def batch(rows, **columns):
    kinds = {"_id": pa.int64(), "_rid": pa.int64(), "_key": pa.int64(), "_text": pa.large_string(), "flags": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) for c in rows.split()], rows.split())


def letters(rng, n):
    return rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()


def test_a_reduced_text_beyond_memory_needs_no_recursion():
    """60,000 letters with repeats under a bound that holds a third of them: the same order and values as in memory."""
    rng = np.random.default_rng(5)
    words = [rng.integers(97, 123, int(k)).astype(np.uint8) for k in rng.integers(3, 9, 200)]
    passage = np.concatenate([words[int(k)] for k in rng.integers(0, 200, 100)])
    text = np.concatenate([*[words[int(k)] for k in rng.integers(0, 200, 5000)], passage, passage, *[words[int(k)] for k in rng.integers(0, 200, 5000)], passage])
    t = np.concatenate([text.astype(np.uint16) + 2, [0]]).astype(np.uint16)
    found = []
    for limit in (1 << 28, 400_000):
        sort = induced.Sort(t, 50, limit, 257)
        places, values = zip(*sort.descending(), strict=True)
        assert sort.levels == 1
        found.append((np.concatenate(places), np.concatenate(values)))
    (one, v), (two, w) = found
    assert v.tolist() == w.tolist() and sorted(two.tolist()) == list(range(len(t)))
    assert all(t[a : a + 50].tolist() == t[b : b + 50].tolist() for a, b in zip(one, two, strict=True))


def test_records_dealt_do_not_grow_with_shards_and_texts_both():
    """Six texts of 1 MB among 200 shards: one record for each shard, not one for each text and shard."""
    rng, buckets = np.random.default_rng(6), 200
    texts = [letters(rng, 1 << 20) for _ in range(6)]
    flags = []
    for t in texts:
        _, _, _, h = repeats._stretches(np.array([0, len(t)]), np.frombuffer(t.encode(), np.uint8), 50)
        flags.append((((h % bs.M(buckets)) << bs.M(32)) | (h >> bs.M(32)))[::10].tobytes())
    plan = Plan()
    repeats._gather(plan, buckets, 50)
    given = (batch("_id _rid _text flags", _id=[i], _rid=[100 + i], _text=[t], flags=[f]) for i, (t, f) in enumerate(zip(texts, flags, strict=True)))
    sent = [x for b in plan.steps[0](given) for x in b.column("packed").to_pylist()]
    assert sum(len(bs.unblob(x, *repeats._PACKED)[8]) for x in sent) >= sum(len(f) // 8 for f in flags)
    assert len(sent) <= 2 * buckets


def test_known_values_are_spread_over_all_shards(spark):
    """60 tasks of one portion each, in which two texts share strings, among 64 shards."""
    rng, buckets, plan = np.random.default_rng(7), 64, Plan()
    repeats._shared_hashes(plan, buckets, 50)
    scan, meet = plan.steps[:2]
    known = []
    for k in range(60):
        passage = letters(rng, 300)
        rids = rng.integers(-(1 << 62), 1 << 62, 2)
        given = [batch("_rid _key _text", _rid=rids, _key=[2 * k, 2 * k + 1], _text=[letters(rng, 100) + passage, passage + letters(rng, 100)])]
        known += [r for b in scan(given) for r in b.to_pylist() if r["known"]]
    assert len(known) == 60 and len({r["bucket"] for r in known}) > 30
    given = [pa.RecordBatch.from_pylist([r], pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("packed", pa.binary())])) for r in known]
    routed = [x for b in meet(given) for x in b.column("packed").to_pylist()]
    assert len(routed) <= buckets and len(set(bs.unrouted(routed, np.uint64)[0].tolist())) == 120
