"""Exact n-gram Jaccard join by universe partition and pigeonhole.

Sets of word shingles link when their Jaccard similarity is at least 3/4
(NUM / DEN). The result is one row for each document with its set's size, its
class of equal sets and its component of links.

1. Screen. A set can have a partner only if three quarters of its shingles occur
   in other sets too. Shingles below a fixed hash bound are counted over all
   documents; a set with too few shared ones among them has no partner.
2. Universe partition. Linked sets differ in at most H elements, a bound of
   their size band. Hashing splits the universe into more than H segments for
   each band, so linked sets agree in some whole segment. Each non-empty segment
   is a signature; small bands use single shingles as segments.
3. Allocation by cost. A signature that many sets share is costly and skipped;
   the bound is the one with the least estimated cost, from the lists' lengths.
   A set whose spare segments outnumber its skipped ones finds its partners by
   the rest. The others (mostly members of large near-copy groups) are indexed
   again by one-deletion neighbourhoods: in half as many segments, linked sets
   differ by at most one element in one of them. That is certain if one of the
   two has segments of two elements and more to spare; a set that has not also
   gets the smallest of its elements (prefix filter) as signatures, so two such
   sets meet there.
4. Links. All pairs of short lists are verified exactly. Of long lists, each set
   is first verified against one other; what that leaves in several components
   is compared in tiles, all but pairs within a cluster's largest component, so
   a group of near copies costs its size where most resemble one of them.
   Components come from rounds of minimum labels over verified links, on the
   cluster.

Defined results: null, empty and wordless texts have size 0 and are their own
component; a row with a null id takes part, and its component is the smallest id
in it, if any; repeated rows share a class; rows of one id with different texts
are sets of their own; an empty table gives an empty result; extra columns,
whatever their names, are not read. Texts are processed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import cut, drop, looked_up, partitions

SHINGLE, NUM, DEN = 5, 3, 4
#: Share of the hash range that the screen counts; sets of this size or less have single shingles as segments.
SCREEN, SMALL = 0.45, 64
#: Bounds among which the one with the least cost is chosen: a signature that more sets share is skipped where its sets can afford that.
HEAVY = (6, 12, 24, 48)
#: Estimated costs: of a pair that is met in a list, and of an entry in the index of one-deletion neighbourhoods, in the same unit.
PAIR_COST, ENTRY_COST = 1.0, 1.5
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _edges() -> list[int]:
    found = [1]
    while found[-1] < 1 << 40:
        found.append(max(found[-1] + 1, -(-found[-1] * 4 // 3)))
    return found


#: Band b holds sizes from EDGES[b] to EDGES[b + 1] - 1.
EDGES = _edges()


def shingles(offsets: np.ndarray, data: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of a chunk's texts, by row, then hash. A text with fewer words than width is one shingle."""
    base = offsets[0]
    flat = _LOWER[data[base : offsets[-1]]]
    off = offsets - base
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(flat):
        return none
    word = ~_SPACE[flat]
    edge = np.zeros(len(flat) + 1, dtype=bool)
    edge[off] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]]))) + 1
    if not len(starts):
        return none
    h = bs.digests(bs.prefix_sums(flat), starts, ends)
    row = np.searchsorted(off, starts, side="right") - 1
    first, counts = bs.grouped(row)
    out_rows, out = [], []
    n = len(h)
    if n >= width:
        total = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            total += h[j : n - width + 1 + j] * bs.M(pow(int(bs.C2), j + 1, 1 << 64))
        whole = row[: n - width + 1] == row[width - 1 :]
        out_rows.append(row[: n - width + 1][whole])
        out.append(bs.mix(total[whole] + bs.M(width)))
    for at, c in zip(first[counts < width], counts[counts < width], strict=True):
        total = sum(int(h[at + j]) * pow(int(bs.C2), j + 1, 1 << 64) for j in range(c)) + int(c)
        out_rows.append(row[at : at + 1])
        out.append(bs.mix(np.array([total % (1 << 64)], np.uint64)))
    r, v = np.concatenate(out_rows), np.concatenate(out)
    order = np.lexsort((v, r))
    r, v = r[order], v[order]
    keep = np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])])
    return r[keep], v[keep]


def _digest(r: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and two 64-bit digests of each row's set; rows without words have zeros."""
    size, k1, k2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    at, counts = bs.grouped(r)
    if len(at):
        size[r[at]] = counts
        k1[r[at]] = bs.mix(np.add.reduceat(bs.mix(v), at) + counts.astype(np.uint64))
        k2[r[at]] = bs.mix(np.add.reduceat(bs.mix(v ^ bs.C3), at))
    return size, k1.view(np.int64), k2.view(np.int64)


def _batch(columns, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def sized(texts: DataFrame, width: int) -> DataFrame:
    """rid, doc, n (set size), k1, k2 (the set's digests), x (shingles that the screen counts); texts has rid, doc, _text."""

    def run(batches):
        for batch in batches:
            offsets, data = bs.buffers(batch.column(2))
            for a, b in bs.runs(offsets):
                r, v = shingles(offsets[a : b + 1], data, width)
                n, k1, k2 = _digest(r, v, b - a)
                x = np.bincount(r[v < _bound()], minlength=b - a)
                yield _batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), n, k1, k2, x.astype(np.int64)], ["rid", "doc", "n", "k1", "k2", "x"])

    return texts.mapInArrow(run, "rid long, doc long, n long, k1 long, k2 long, x long")


def _bound() -> np.uint64:
    return bs.M(int(SCREEN * (1 << 64)))


def shared_counts(texts: DataFrame, buckets: int, width: int) -> DataFrame:
    """rid, shared: how many of the screen's shingles of a row other sets have too; texts has rid, _text."""

    def scan(batches):
        turn = 0
        for batch in batches:
            rids = batch.column(0).to_numpy()
            offsets, data = bs.buffers(batch.column(1))
            for a, b in bs.runs(offsets):
                r, v = shingles(offsets[a : b + 1], data, width)
                _, k1, _ = _digest(r, v, b - a)
                low = v < _bound()
                r, v = r[low], v[low]
                out = list(bs.pack_shared(v, k1[r], rids[a:b][r], buckets, turn))
                turn += 1
                if out:
                    yield _shared_batch(out)

    return _met(texts.mapInArrow(scan, bs.SHARED), buckets)


def shared_in_sets(sets: DataFrame, buckets: int) -> DataFrame:
    """rid, shared: how many of all shingles of a set other sets of the table have too; sets has rid, s."""

    def scan(batches):
        turn = 0
        for batch in batches:
            rids = batch.column(0).to_numpy()
            offsets, data = bs.buffers(batch.column(1))
            for a, b in bs.runs(offsets, 8 * bs.PIECE):
                v = np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), np.uint64)
                r = np.repeat(rids[a:b], np.diff(offsets[a : b + 1]) // 8)
                out = list(bs.pack_shared(v, r, r, buckets, turn))
                turn += 1
                if out:
                    yield _shared_batch(out)

    return _met(sets.select("rid", "s").mapInArrow(scan, bs.SHARED), buckets)


def _shared_batch(out: list) -> pa.RecordBatch:
    return _batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["bucket", "known", "packed"])


def _met(dealt: DataFrame, buckets: int) -> DataFrame:
    """rid, shared: the buckets' shared values, counted by row."""

    def meet(batches):
        held: dict[int, list] = {}

        def counts(r):
            at, n = bs.grouped(r)
            return bs.routed(r[at], n.astype(np.int64), buckets)

        for batch in batches:
            for n, known, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if known:
                    yield counts(bs.unblob(packed, np.int64, np.uint32, np.uint32)[0])
                else:
                    held.setdefault(n, []).append(packed)
        for n in sorted(held):
            yield counts(bs.unpack_shared(n, held.pop(n))[0])

    return summed(dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(meet, bs.ROUTED), buckets).withColumnRenamed("value", "shared")


def summed(found: DataFrame, buckets: int) -> DataFrame:
    """rid, value: sums of routed (rid, value) pairs."""

    def run(batches):
        held: list[bytes] = []
        for batch in batches:
            held += batch.column(1).to_pylist()
        r, v = bs.unrouted(held, np.int64)
        at, _ = bs.grouped(r)
        yield _batch([r[at], np.add.reduceat(v, at) if len(at) else v], ["rid", "value"])

    return found.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "rid long, value long")


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """rid, n, s (sorted 64-bit shingle hashes, packed) of rows whose set has the expected digests; texts has rid, k1, k2, _text."""

    def run(batches):
        for batch in batches:
            want1, want2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            offsets, data = bs.buffers(batch.column(3))
            for a, b in bs.runs(offsets):
                r, v = shingles(offsets[a : b + 1], data, width)
                n, k1, k2 = _digest(r, v, b - a)
                ends = np.cumsum(n)
                keep = np.flatnonzero((n > 0) & (k1 == want1[a:b]) & (k2 == want2[a:b]))
                packed = pa.array([v[ends[i] - n[i] : ends[i]].tobytes() for i in keep], pa.binary())
                yield _batch([batch.column(0).to_numpy()[a:b][keep], n[keep], packed], ["rid", "n", "s"])

    return texts.mapInArrow(run, "rid long, n long, s binary")


# ---------------------------------------------------------------- signatures


def band(n: int) -> int:
    return int(np.searchsorted(EDGES, n, side="right")) - 1


def bands(n: int) -> range:
    """The bands in which a set of n shingles can have a partner of its size or more: its own, and on to that of 4n/3."""
    return range(band(n), band(n * DEN // NUM) + 1)


def difference(n: int, b: int) -> int:
    """Most elements in which a set of n and a partner of at least its size in band b, or of at most its size, can differ."""
    return (n + min(n * DEN // NUM, EDGES[b + 1] - 1)) // 7


def _salted(v: np.ndarray, b: int) -> np.ndarray:
    return bs.mix(v + bs.M((b + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def segments(v: np.ndarray, b: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, sum of its elements' hashes, size) of the non-empty ones of m segments, with element order for deletions."""
    h = _salted(v, b)
    seg = (h >> bs.M(33)).astype(np.int64) % m
    sums, sizes = np.zeros(m, np.uint64), np.bincount(seg, minlength=m)
    np.add.at(sums, seg, bs.mix(h))
    return seg, sums, sizes


def whole_signatures(v: np.ndarray, b: int) -> tuple[np.ndarray, int]:
    """A set's signatures in band b, and how many of them a partner has for certain."""
    n, high = len(v), EDGES[b + 1] - 1
    if high <= SMALL:
        return _salted(v, b), -(-n * NUM // DEN)
    m = int(0.4 * high) + 1
    _, sums, sizes = segments(v, b, m)
    at = np.flatnonzero(sizes)
    return bs.mix(sums[at] + at.astype(np.uint64) * bs.C2), len(at) - difference(n, b)


def deletion_signatures(v: np.ndarray, b: int) -> tuple[np.ndarray, bool]:
    """Whole segments and segments less one element, in half as many segments; whether a partner shares one for certain."""
    n, high = len(v), EDGES[b + 1] - 1
    if high <= SMALL:
        return np.sort(_salted(v, b))[: n - -(-n * NUM // DEN) + 1], True
    m = int(0.165 * high) + 2
    seg, sums, sizes = segments(v, b, m)
    at = np.flatnonzero(sizes)
    tag = at.astype(np.uint64) * bs.C3
    less = sums[seg] - bs.mix(_salted(v, b))
    kept = sizes[seg] > 1
    out = np.concatenate([bs.mix(sums[at] + tag), bs.mix(less[kept] + seg[kept].astype(np.uint64) * bs.C3)])
    return np.unique(out), int((sizes >= 2).sum()) - difference(n, b) // 2 >= 1


def prefix_signatures(v: np.ndarray, b: int) -> np.ndarray:
    """The smallest elements in band b's order: linked sets share one of them, whatever their segments look like."""
    return bs.mix(np.sort(_salted(v, b))[: len(v) - -(-len(v) * NUM // DEN) + 1] ^ bs.C1)


def _signed(sets: DataFrame, buckets: int) -> DataFrame:
    """Records for the index: (bucket, kind, packed). kind 0: rows, counts, signatures; 1: rows, bands, spare signatures."""

    def run(batches):
        for batch in batches:
            rows, sigs, spare = [], [], []
            for rid, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = np.frombuffer(s, np.uint64)
                for b in bands(len(v)):
                    made, sure = whole_signatures(v, b)
                    spare.append((rid, b, sure))
                    rows.append(np.full(len(made), rid, np.int64))
                    sigs.append(made)
            if not rows:
                continue
            r, x = np.concatenate(rows), np.concatenate(sigs)
            bucket = (x % bs.M(buckets)).astype(np.int64)
            order = np.lexsort((r, bucket))
            r, x, bucket = r[order], (x[order] >> bs.M(24)), bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            out = []
            for n in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[n], cuts[n + 1])
                at, counts = bs.grouped(r[part])
                value = x[part]
                out.append((int(n), bs.blob(r[part][at], counts.astype(np.uint32), (value & bs.M(0xFFFFFFFF)).astype(np.uint32), (value >> bs.M(32)).astype(np.uint8))))
            yield _batch([pa.array([o[0] for o in out], pa.int32()), pa.array([0] * len(out), pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["bucket", "kind", "packed"])
            n = np.array(spare, dtype=np.int64)
            yield _batch([pa.array([int(n[0, 0] % buckets)], pa.int32()), pa.array([1], pa.int32()), pa.array([bs.blob(n[:, 0], n[:, 1], n[:, 2])], pa.binary())], ["bucket", "kind", "packed"])

    return sets.select("rid", "s").mapInArrow(run, "bucket int, kind int, packed binary")


GROUPS = "kind int, gid long, members array<long>, rid long, value long, bucket int, packed binary"
_FIELDS = ["kind", "gid", "members", "rid", "value", "bucket", "packed"]


def _grouped(signed: DataFrame, buckets: int, bounds: tuple[int, ...]) -> DataFrame:
    """What the index's buckets say. kind 0: a group of members (at most the greatest bound), once for each distinct group of the bucket,
    with its length (value); 1: how many signatures rows have in lists beyond each bound (routed, one number for all bounds);
    2: rid and band (gid) have `value` signatures for certain."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for n, kind, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 1:
                    r, b, sure = bs.unblob(packed, np.int64, np.int64, np.int64)
                    yield _record(2, len(r), gid=b, rid=r, value=sure)
                else:
                    held.setdefault(n, []).append(packed)
        for n in sorted(held):
            parts = [bs.unblob(x, np.int64, np.uint32, np.uint32, np.uint8) for x in held.pop(n)]
            r = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
            x = np.concatenate([p[2].astype(np.uint64) | (p[3].astype(np.uint64) << bs.M(32)) for p in parts])
            order = np.lexsort((r, x))
            r, x = r[order], x[order]
            keep = np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])])
            r, x = r[keep], x[keep]
            begins, sizes = bs.grouped(x)
            light = (sizes > 1) & (sizes <= bounds[-1])
            yield from _groups(r, begins[light], sizes[light])
            # which bands a skipped signature counts for is not told apart: it counts for all of a set's bands
            rid, where = np.unique(r[np.repeat(sizes > bounds[0], sizes)], return_inverse=True)
            if len(rid):
                long = np.repeat(sizes, sizes)[np.repeat(sizes > bounds[0], sizes)]
                times = np.stack([np.bincount(where[long > bound], minlength=len(rid)) for bound in bounds], axis=1)
                sent = bs.routed(rid, times.astype(np.int32), buckets)
                yield _record(1, sent.num_rows, bucket=sent.column(0), packed=sent.column(1))

    return signed.repartitionById(buckets, F.col("bucket")).mapInArrow(run, GROUPS)


def _skips(found: DataFrame, buckets: int, bounds: tuple[int, ...]) -> DataFrame:
    """rid, skips: for each bound, how many signatures a set has in longer lists."""
    kind = np.dtype((np.int32, (len(bounds),)))

    def run(batches):
        held: list[bytes] = []
        for batch in batches:
            held += batch.column(1).to_pylist()
        r, v = bs.unrouted(held, kind)
        at, _ = bs.grouped(r)
        sums = np.add.reduceat(v, at, axis=0) if len(at) else v
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(bounds), pa.int32()), pa.array(sums.astype(np.int32).ravel(), pa.int32()))
        yield _batch([r[at], lists], ["rid", "skips"])

    sent = found.where("kind = 1").select("bucket", "packed")
    return sent.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "rid long, skips array<int>")


def _cheapest(found: DataFrame, spare: DataFrame, bounds: tuple[int, ...]) -> int:
    """The place of the bound with the least estimated cost: pairs of the lists that are kept, and index entries of the sets that skipping leaves unsure.

    found: the index's records; spare: rid, n, sure, skips of sets and bands.
    """
    lists = found.where("kind = 0").groupBy("gid").agg(F.max("value").cast("double").alias("g"))
    pairs = lists.agg(*(F.sum(F.when(F.col("g") <= h, F.col("g") * (F.col("g") - 1) / 2)) for h in bounds)).first()
    entries = spare.agg(*(F.sum(F.when(F.col("sure") - F.get("skips", F.lit(k)) < 1, F.col("n").cast("double"))) for k in range(len(bounds)))).first()
    costs = [PAIR_COST * (p or 0) + ENTRY_COST * (e or 0) for p, e in zip(pairs, entries, strict=True)]
    return costs.index(min(costs))


def _groups(r: np.ndarray, begins: np.ndarray, sizes: np.ndarray):
    """Distinct groups of members as records of kind 0; gid is a hash of the member list."""
    if not len(begins):
        return
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bs.mix(r.view(np.uint64)))])
    gid = bs.mix(total[begins + sizes] - total[begins] + sizes.astype(np.uint64))
    _, at = np.unique(gid, return_index=True)
    begins, sizes, gid = begins[at], sizes[at], gid[at]
    flat = np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(r[flat]))
    yield _record(0, len(begins), gid=gid.view(np.int64), members=lists, value=sizes.astype(np.int64))


def _record(kind: int, n: int, **columns) -> pa.RecordBatch:
    types = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    made = [pa.array(columns[c], t) if isinstance(columns.get(c), np.ndarray) else columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(_FIELDS[1:], types, strict=True)]
    return _batch([pa.array([kind] * n, pa.int32()), *made], _FIELDS)


def _deleted(sets: DataFrame) -> DataFrame:
    """sig, rid: one-deletion signatures of the sets that skipping leaves unsure; sets has rid, s, bands."""

    def run(batches):
        for batch in batches:
            rows, sigs = [], []
            for rid, s, which in zip(*(batch.column(n).to_pylist() for n in ("rid", "s", "bands")), strict=True):
                v = np.frombuffer(s, np.uint64)
                for b in which:
                    made, sure = deletion_signatures(v, b)
                    if not sure:
                        made = np.concatenate([made, prefix_signatures(v, b)])
                    rows.append(np.full(len(made), rid, np.int64))
                    sigs.append(made.view(np.int64))
            if rows:
                yield _batch([np.concatenate(sigs), np.concatenate(rows)], ["sig", "rid"])

    return sets.select("rid", "s", "bands").mapInArrow(run, "sig long, rid long")


# --------------------------------------------------------------------- links


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, linked: exact similarity of the pairs' sets."""

    def run(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y)
                common = both - len(np.unique(np.concatenate([x, y])))
                out.append(DEN * common >= NUM * (both - common))
            yield _batch([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], ["a", "b", "linked"])

    left = pairs.join(sets.select(F.col("rid").alias("b"), F.col("s").alias("sb")), "b")
    both = left.join(sets.select(F.col("rid").alias("a"), F.col("s").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, linked boolean")


def _contracted(links: DataFrame) -> DataFrame:
    """a, b: each task's links as stars, every node beside the smallest that its task joins it to."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = sorted(parent)
        yield _batch([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"])

    # by the greater node, of which a star has many with few links each; its centre is mostly the smaller one
    placed = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).repartition("a")
    return placed.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, comp: each node's smallest reachable node. links has a, b.

    Tasks first contract what they hold; then labels spread over the links left
    and jump to their label's label, until none changes.
    """
    stars = _contracted(links)
    both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).union(stars.select("a", F.col("a").alias("b")))
    both = cut(both.distinct(), "stars")
    labels = both.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "node")
    while True:
        named = labels.select("node", F.col("comp").alias("c"))
        low = looked_up(both, "b", named, "node", "a").groupBy("a").agg(F.min("c").alias("c"), F.max(F.when(F.col("a") == F.col("b"), F.col("c"))).alias("old"))
        jump = low.select("a", F.col("c").alias("comp")).withColumnRenamed("a", "to")
        new = cut(looked_up(low, "c", jump, "to", "a").select(F.col("a").alias("node"), "comp", "old"), "labels")
        drop(labels)
        labels = new
        if not labels.where("comp <> old").limit(1).count():
            drop(both)
            return labels.select("node", "comp")


def _pairs(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of short lists' members that sizes and lone shingles allow; sizes has rid, n, lone.

    Shingles that no other set has lie in the sets' difference, which linked
    sets keep within a seventh of both sizes' sum.
    """
    rows = groups.select("gid", F.explode("members").alias("b"), "members")
    rows = rows.select("b", F.explode(F.filter("members", lambda x: x < F.col("b"))).alias("a")).distinct()
    size = lambda x: sizes.select(F.col("rid").alias(x), F.col("n").alias(f"n{x}"), F.col("lone").alias(f"l{x}"))
    met = rows.join(size("a"), "a").join(size("b"), "b")
    near = (F.col("na") * DEN >= F.col("nb") * NUM) & (F.col("nb") * DEN >= F.col("na") * NUM) & ((F.col("la") + F.col("lb")) * 7 <= F.col("na") + F.col("nb"))
    return met.where(near).select("a", "b")


def row_key(row_id: str, text: str):
    """A row is told by its id and its text: two texts may have one id."""
    return F.xxhash64(F.col(row_id).cast("long"), F.coalesce(F.col(text), F.lit("")))


def join(docs: DataFrame, width: int = SHINGLE, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id, n_shingles, class_id (smallest id with the same set), component_id, n_links (links of the class that hold its component together)."""
    return joined(docs, width, row_id, text).select(F.col("doc").alias(row_id), "n_shingles", "class_id", "component_id", "n_links")


def one_of_each(docs: DataFrame, width: int = SHINGLE, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id (of the smallest row key, where texts share it; one, where rows repeat). Rows without words all stay."""
    found = cut(joined(docs, width, row_id, text).where("n_shingles > 0").select("rid", "doc", "comp"), "members")
    best = found.groupBy("comp").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "rid")).alias("b")).select(F.col("b.rid").alias("rid"))
    times = found.groupBy("rid").count()
    gone = cut(times.join(best, "rid", "left_anti").select(F.col("rid").alias("_rid")), "gone")
    twice = cut(times.where("count > 1").join(best, "rid", "left_semi").select(F.col("rid").alias("_rid")), "repeated")
    drop(found)
    # the input row travels as one value, so no name in it can clash with those used here
    rows = docs.select(F.struct(*docs.columns).alias("_row"), row_key(row_id, text).alias("_rid")).join(gone, "_rid", "left_anti")
    if not twice.isEmpty():
        rows = rows.join(twice, "_rid", "left_anti").unionByName(rows.join(twice, "_rid", "left_semi").dropDuplicates(["_rid"]))
    return rows.select("_row.*")


def joined(docs: DataFrame, width: int, row_id: str, text: str) -> DataFrame:
    """rid (row_key), doc (the id), n_shingles, class_id, component_id, n_links and comp, a name of the component that no other has (null for rows without words)."""
    spark = docs.sparkSession
    buckets = partitions(spark)
    rows = docs.select(row_key(row_id, text).alias("rid"), F.col(row_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    sizes = cut(sized(rows, width), "sets")
    classes = cut(sizes.where(F.col("n") > 0).groupBy("k1", "k2", "n").agg(F.min("rid").alias("rep"), F.min("doc").alias("doc"), F.max("x").alias("x")), "classes")
    counts = shared_counts(rows.select("rid", "_text"), buckets, width)
    least = F.col("x") - F.floor(F.col("n") * (DEN - NUM) / DEN)
    # sets of one or two shingles link with equal ones only
    near = classes.where(F.col("n") > 2).join(counts, F.col("rep") == F.col("rid"), "left").where(F.coalesce("shared", F.lit(0)) >= least)
    near = cut(near.select(F.col("rep").alias("rid"), "k1", "k2"), "near")
    # a merge at every size: this list grows with the corpus
    met = rows.select("rid", "_text").join(near.hint("merge"), "rid").select("rid", "k1", "k2", "_text")
    screened = cut(sets_of(met, width).dropDuplicates(["rid"]), "screened")
    # once more among the sets left, with all shingles: a set may have a quarter that no other has
    again = shared_in_sets(screened, buckets)
    sets = cut(screened.join(again, "rid").where(F.col("shared") >= F.col("n") - F.floor(F.col("n") * (DEN - NUM) / DEN)).select("rid", "n", (F.col("n") - F.col("shared")).alias("lone"), "s"), "sets")
    drop(near, screened)
    found = cut(_grouped(_signed(sets, buckets), buckets, HEAVY), "groups")
    none = F.array(*(F.lit(0) for _ in HEAVY))
    spare = found.where("kind = 2").select("rid", F.col("gid").cast("int").alias("band"), F.col("value").alias("sure")).join(sets.select("rid", "n"), "rid")
    spare = cut(spare.join(_skips(found, buckets, HEAVY), "rid", "left").withColumn("skips", F.coalesce("skips", none)), "spare")
    chosen = _cheapest(found, spare, HEAVY)
    groups = found.where((F.col("kind") == 0) & (F.col("value") <= HEAVY[chosen])).select("gid", "members")
    unsure = spare.where(F.col("sure") - F.get("skips", F.lit(chosen)) < 1).groupBy("rid").agg(F.collect_list("band").alias("bands"))
    entries = _deleted(sets.join(unsure, "rid"))
    shared = entries.groupBy("sig").agg(F.count("*").alias("_n"), F.min("rid").alias("_first")).where("_n > 1")
    entries = cut(entries.join(shared, "sig").select("sig", "rid", F.col("_first").alias("first")), "deletions")
    links = _linked(groups, entries, sets)
    drop(found, spare, entries, sets)
    labels = components(links)
    named = classes.select("k1", "k2", "n", F.col("rep").alias("node"), F.col("doc").alias("class_id")).join(labels, "node", "left")
    named = cut(named.withColumn("comp", F.coalesce("comp", "node")), "named")
    # tables of their own, so that joins with all rows of a hot component or class can be split
    ids = named.groupBy("comp").agg(F.min("class_id").alias("component_id")).withColumnRenamed("comp", "of")
    ends = links.select("a").union(links.select("b")).groupBy("a").agg(F.count("*").alias("n_links")).withColumnRenamed("a", "end")
    found = looked_up(named, "comp", ids, "of", "node").join(ends, F.col("node") == F.col("end"), "left").select("k1", "k2", "n", "class_id", "comp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    found = cut(found, "class-components")
    drop(named, classes, links)
    out = sizes.join(found, ["k1", "k2", "n"], "left")
    return out.select("rid", "doc", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("component_id", "doc").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "comp")


#: Bytes of sets and number of sets in a block of the tiled comparison.
BLOCK_BYTES, BLOCK_SETS = 1 << 20, 512


def _linked(groups: DataFrame, entries: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links (a, b) that join all components.

    groups: short member lists, whose pairs are compared one by one. entries:
    one-deletion lists (sig, rid, first) of any length, whose sets are compared
    in tiles.
    """
    pairs = cut(_pairs(groups, sets.select("rid", "n", "lone")), "pairs")
    # of the long lists, each set with the first one of the list that most of its signatures name
    times = entries.where("rid <> first").groupBy("rid", "first").count().groupBy("rid").agg(F.max(F.struct("count", F.col("first").alias("to"))).alias("m"))
    stars = times.select(F.greatest("rid", "m.to").alias("b"), F.least("rid", "m.to").alias("a"))
    known = cut(verified(pairs.union(stars.select("a", "b")).distinct(), sets).where("linked").select("a", "b"), "known-links")
    out = cut(known.union(_tiled(entries, sets, known)).distinct(), "links")
    drop(pairs, known)
    return out


def _tiled(entries: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """Links a, b between sets that one-deletion lists bring together, as many as join the components that known links leave apart.

    Lists that share sets form clusters. Where known links already make one
    component of a cluster, there is nothing to compare. Elsewhere the cluster's
    largest component and its other sets are dealt into blocks of bounded bytes,
    and each pair of blocks, but for two of the largest component, is a tile: a
    product of two incidence matrices gives all common counts, and only links
    that join two components leave the tile.
    """
    bound = entries.select(F.col("rid").alias("a"), F.col("first").alias("b")).where("a <> b").distinct()
    clusters = components(bound).select(F.col("node").alias("rid"), F.col("comp").alias("cluster"))
    comps = components(known).select(F.col("node").alias("rid"), "comp")
    placed = cut(clusters.join(comps, "rid", "left").withColumn("comp", F.coalesce("comp", "rid")), "clusters")
    sizes = placed.groupBy("cluster", "comp").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.count("*").alias("parts"), F.max(F.struct("n", "comp"))["comp"].alias("main"))
    apart = sizes.where("parts > 1").select("cluster", "main")
    docs = looked_up(placed, "cluster", apart.withColumnRenamed("cluster", "of"), "of", "rid").withColumn("main", F.col("comp") == F.col("main"))
    docs = cut(docs.join(sets.select("rid", "s"), "rid").select("cluster", "main", "rid", "s"), "tile-sets")
    drop(placed)
    count = lambda which: F.greatest(F.ceil(F.sum(F.when(which, F.octet_length("s"))) / BLOCK_BYTES), F.ceil(F.sum(which.cast("int")) / BLOCK_SETS)).cast("int")
    size = cut(docs.groupBy("cluster").agg(count(F.col("main")).alias("mains"), count(~F.col("main")).alias("others")), "cluster-blocks")
    dealt = looked_up(docs, "cluster", size.withColumnRenamed("cluster", "of"), "of", "rid")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rid"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    blocks = dealt.groupBy("cluster", "main", "block", "mains", "others").agg(F.collect_list(F.struct("rid", "s")).alias("rows"))
    # tiles are named by the other sets' block and its partner: (i, false, j) with i <= j, or (i, true, block of the largest component)
    number = lambda n: F.sequence(F.lit(0), n - 1)
    tile = lambda i, main, j: F.struct(i.alias("i"), main.alias("with"), j.alias("j"))
    mine = F.col("block")
    of_main = F.transform(number(F.col("others")), lambda i: tile(i, F.lit(True), mine))
    of_other = F.concat(F.transform(number(F.col("others")), lambda k: tile(F.least(mine, k), F.lit(False), F.greatest(mine, k))), F.transform(number(F.col("mains")), lambda j: tile(mine, F.lit(True), j)))
    keyed = blocks.select("cluster", F.explode(F.when(F.col("main"), of_main).otherwise(of_other)).alias("tile"), "rows")
    tiles = keyed.groupBy("cluster", "tile").agg(F.collect_list("rows").alias("rows")).select("rows")

    def run(batches):
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                tile = batch.column(0)[k].as_py()
                found += _tile(tile[0], tile[-1])
            yield _batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return tiles.mapInArrow(run, "a long, b long")


def _tile(left: list[dict], right: list[dict]) -> list[tuple[int, int]]:
    """Links between the sets of two blocks (or within one) that join components, found by exact counts."""
    lv, rv = ([np.frombuffer(x["s"], np.uint64) for x in side] for side in (left, right))
    ln, rn = (np.array([len(v) for v in side]) for side in (lv, rv))
    values = np.intersect1d(np.unique(np.concatenate(lv)), np.unique(np.concatenate(rv)), assume_unique=True)
    common = np.zeros((len(lv), len(rv)), dtype=np.float32)  # whole numbers, exact below 2^24
    for k in range(0, len(values), 8192):
        part = values[k : k + 8192]
        common += _incidence(lv, part) @ _incidence(rv, part).T
    both = ln[:, None] + rn[None, :]
    linked = DEN * common >= NUM * (both - common)
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = root(left[i]["rid"]), root(right[j]["rid"])
        if x != y:
            parent[max(x, y)] = min(x, y)
            a, b = left[i]["rid"], right[j]["rid"]
            out.append((min(a, b), max(a, b)))
    return out


def _incidence(sets: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """One row for each set, one column for each value: 1 where the set holds it."""
    out = np.zeros((len(sets), len(values)), dtype=np.float32)
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
    held = values[at] == flat
    out[row[held], at[held]] = 1
    return out
