"""Removal of long repeated byte strings by suffix sorting.

A byte goes if a string of `length` bytes over it also starts in a document with
a smaller id. Strings are found in four steps, none of which brings all rows of
a string together:

1. Equal texts are one text, with the smallest id of them; its copies are
   covered wholly.
2. Each window of `length` bytes is filed under the smallest hash of its
   GRAM-byte strings. Equal windows have equal hashes, so a hash that one text
   alone has holds no repeated window; nearly all text ends here.
3. Of texts with shared hashes, the stretches filed under those are gathered,
   equal stretches as one with their smallest id, and dealt by hash into shards.
   A shard is one text, which external induced sorting sorts
   (tidemark.llm.induced); neighbours whose prefix value reaches `length` form
   groups, and the smallest id of each group is carried to its windows.
4. The smallest ids go back to the stretches' documents, which mark the windows
   with an id smaller than their own.

The number of shards follows from the bytes of the distinct texts. What is found
is dealt to them in portions of several chunks of text, so that records stay few
where shards are many. A shard's letters and all arrays of its sort lie in files
beyond SORT_MEMORY.

Defined results: a null text is an empty one; a row with a null id takes no part
(nothing is removed from it, or because of it); rows with equal ids don't affect
each other, whether their texts are equal or not; strings found in several
documents count for the smallest id (ties are one document); texts of any length
are scanned whole; an empty table gives an empty result; extra columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from . import induced
from .common import cut, drop, fewer, partitions

LENGTH, GRAM = 50, 24
#: Bytes that a sort holds in memory, about; more lie in files.
SORT_MEMORY = 192 << 20
#: Bytes of distinct texts for each shard: of prose, a third of what makes a reduced text that SORT_MEMORY holds.
SHARD_BYTES = 16 << 20
_OVERLAP_PIECE = 1 << 20


def _window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """For each window of `length` bytes of data, the smallest hash of the GRAM-byte strings in it."""
    b = data
    two = b[:-1].astype(np.uint16) | (b[1:].astype(np.uint16) << np.uint16(8))
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
    eight = four[:-4].astype(np.uint64) | (four[4:].astype(np.uint64) << np.uint64(32))
    n = len(eight) - (GRAM - 8)
    h = eight[:n] * bs.C1
    for k in range(8, GRAM, 8):
        h ^= h >> bs.M(29)
        h += eight[k : k + n]
        h *= bs.C2
    h = bs.mix(h)
    width = length - GRAM + 1
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < width:
        h = np.minimum(h[: len(h) - (width - have)], h[width - have :])
    return h


def _stretches(offsets: np.ndarray, data: np.ndarray, length: int):
    """(row, start, windows, hash) of maximal stretches of windows filed under one hash, for all rows of a chunk."""
    base = offsets[0]
    flat = data[base : offsets[-1]]
    rows, starts, counts, hashes = [], [], [], []
    for piece in range(0, max(1, len(flat)), _OVERLAP_PIECE):
        part = flat[piece : piece + _OVERLAP_PIECE + length - 1]
        if len(part) < length:
            continue
        h = _window_hashes(part, length)[:_OVERLAP_PIECE]
        at = np.arange(piece, piece + len(h))
        row = np.searchsorted(offsets - base, at, side="right") - 1 if len(offsets) > 2 else np.zeros(len(h), np.int64)
        inside = at + length <= (offsets - base)[row + 1]
        new = np.empty(len(h), dtype=bool)
        new[0] = True
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
        begins = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([begins, [len(h)]]))
        keep = inside[begins]
        begins, sizes = begins[keep], sizes[keep]
        rows.append(row[begins])
        starts.append(at[begins])
        counts.append(sizes)
        hashes.append(h[begins])
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(starts), np.concatenate(counts), np.concatenate(hashes)


def _shared_hashes(texts: DataFrame, buckets: int, length: int) -> DataFrame:
    """_rid, flags (bucket and upper half of each shared hash as one number, packed): texts has _rid, _key, _text."""

    def pieces(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            offsets, data = bs.buffers(batch.column(2))
            for a, b in bs.runs(offsets):
                row, _, _, h = _stretches(offsets[a : b + 1], data, length)
                yield int(offsets[b] - offsets[a]), h, keys[a:b][row], ids[a:b][row]

    def scan(batches):
        for h, keys, ids in bs.joined(pieces(batches), bs.portion(buckets)):
            # a turn by a row's hash: tasks of few portions would all begin with the same buckets
            out = list(bs.pack_shared(h, keys, ids, buckets, int(ids[0]) if len(ids) else 0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["bucket", "known", "packed"])

    def meet(batches):
        held: dict[int, list] = {}
        found = []
        for batch in batches:
            for n, known, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if known:
                    r, b, v = bs.unblob(packed, np.int64, np.uint32, np.uint32)
                    found.append((r, (b.astype(np.uint64) << bs.M(32)) | v))
                else:
                    held.setdefault(n, []).append(packed)
        for n in sorted(held):
            r, v = bs.unpack_shared(n, held.pop(n))
            found.append((r, (bs.M(n) << bs.M(32)) | v.astype(np.uint64)))
        # all at once: each call makes a record for every bucket
        for r, v in bs.joined(((16 * len(r), r, v) for r, v in found if len(r)), bs.ROUTED_AT_ONCE):
            yield bs.routed(r, v, buckets)

    dealt = texts.mapInArrow(scan, bs.SHARED).repartitionById(buckets, F.col("bucket"))
    return _by_document(dealt.mapInArrow(meet, bs.ROUTED), buckets, np.uint64, "flags")


def _by_document(routed: DataFrame, buckets: int, kind, name: str) -> DataFrame:
    """_rid and its values, packed as one array: routed pairs brought together by row."""

    def run(batches):
        held: list[bytes] = []
        for batch in batches:
            held += batch.column(1).to_pylist()
        r, v = bs.unrouted(held, kind)
        held.clear()
        at, n = bs.grouped(r)
        for k in range(0, len(at), 5000):
            packed = [v[x : x + y].tobytes() for x, y in zip(at[k : k + 5000], n[k : k + 5000], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(r[at[k : k + 5000]], pa.int64()), pa.array(packed, pa.binary())], ["_rid", name])

    return routed.repartitionById(buckets, F.col("bucket")).mapInArrow(run, f"_rid long, {name} binary")


#: A stretch that stands in more places of one portion is common: its places travel apart from its bytes.
COMMON = 16
_DEALT = "bucket int, kind int, packed binary"
_PACKED = (np.int64, np.int64, np.int64, np.uint8, np.uint32, np.uint32, np.int64, np.int64, np.uint32, np.uint8)


def _gather(texts: DataFrame, buckets: int, length: int) -> DataFrame:
    """Stretches of texts (_id, _rid, _text, flags: packed hashes) under shared hashes, packed by shard.

    kind 0: a portion's distinct stretches of a shard: hash, digest, least id,
    common or not, size, number of places, the places' ids, rows and starts (of
    those that are not common), bytes (compressed). kind 1: places of common
    stretches.
    """

    def pieces(batches):
        for batch in batches:
            ids, rids, flags = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            offsets, data = bs.buffers(batch.column(2))
            for a, b in bs.runs(offsets):
                row, start, count, h = _stretches(offsets[a : b + 1], data, length)
                wanted_rows, wanted = [], []
                for i in range(a, b):
                    w = np.frombuffer(flags[i].as_py(), np.uint64)
                    wanted.append(w)
                    wanted_rows.append(np.full(len(w), i - a, np.uint64))
                if not wanted or not len(row):
                    continue
                mark = lambda r, x: bs.mix(x + (r.astype(np.uint64) + bs.M(1)) * bs.C1)
                filed = ((h % bs.M(buckets)) << bs.M(32)) | (h >> bs.M(32))
                hit = np.isin(mark(row, filed), mark(np.concatenate(wanted_rows), np.concatenate(wanted)))
                row, start, count, h = row[hit], start[hit], count[hit], h[hit]
                if not len(row):
                    continue
                flat = data[offsets[a] : offsets[b]]
                size = count + length - 1
                digest = bs.digests(bs.prefix_sums(flat), start, start + size)
                at = start - (offsets[a : b + 1] - offsets[a])[row]
                letters = flat[bs.spread(start, size)]
                yield len(letters), h, digest, ids[a:b][row], rids[a:b][row], at, size, letters

    def scan(batches):
        import zstandard

        pressed = zstandard.ZstdCompressor(level=1)
        for h, digest, doc, rid, at, size, flat in bs.joined(pieces(batches), bs.portion(buckets)):
            turn, start = int(rid[0]), np.cumsum(size) - size
            h1, h2 = h.view(np.int64), digest.view(np.int64)
            bucket = (h % bs.M(buckets)).astype(np.int64)
            order = np.lexsort((doc, h2, h1, bucket))
            bucket, h1, h2, doc, rid, at, start, size = (x[order] for x in (bucket, h1, h2, doc, rid, at, start, size))
            begins, places = bs.grouped_pairs(h1, h2)
            common = places > COMMON
            apart = np.repeat(common, places)
            out = [(turn % buckets, 1, bs.blob(h1[apart], h2[apart], doc[apart], rid[apart], at[apart]))] if apart.any() else []
            cuts = np.searchsorted(bucket[begins], np.arange(buckets + 1))
            for n in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[n], cuts[n + 1])
                first, own = begins[part], np.arange(begins[cuts[n]], begins[cuts[n + 1]] if cuts[n + 1] < len(begins) else len(h1))
                own = own[~apart[own]]
                letters = flat[bs.spread(start[first], size[first])]
                kept = np.where(common[part], 0, places[part]).astype(np.uint32)
                out.append((int(n), 0, bs.blob(h1[first], h2[first], doc[first], common[part].astype(np.uint8), size[first].astype(np.uint32), kept, doc[own], rid[own], at[own].astype(np.uint32), np.frombuffer(pressed.compress(letters.tobytes()), np.uint8))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "packed"])

    return texts.mapInArrow(scan, _DEALT)


def _least(h1: np.ndarray, least: np.ndarray, sizes: np.ndarray, starts: np.ndarray, letters: np.ndarray, length: int):
    """Runs of the smallest id of each window: (stretch, first window, windows, id). Distinct stretches, sorted by h1; starts: their places in letters.

    A stretch alone under its hash has one id for all windows; all others are suffix-sorted together.
    """
    _, counts = bs.grouped(h1)
    alone = np.repeat(counts == 1, counts)
    one = np.flatnonzero(alone)
    yield one, np.zeros(len(one), np.int64), sizes[one].astype(np.int64) - length + 1, least[one]
    many = np.flatnonzero(~alone)
    if not len(many):
        return
    n = sizes[many].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(n + 1)])
    total, few = int(at[-1]), max(1, int(SORT_MEMORY // (64 * n.mean())))
    # one text: letters are 2 to 257, 1 parts the stretches, 0 ends all
    text = induced.scratch(total + 1, np.uint16, SORT_MEMORY)
    owner = induced.scratch(total + 1, np.int32, SORT_MEMORY)
    for a in range(0, len(many), few):
        part = slice(a, a + few)
        text[at[a] : at[min(len(many), a + few)]] = 1
        text[bs.spread(at[:-1][part], n[part])] = letters[bs.spread(starts[many[part]], n[part])].astype(np.uint16) + 2
        owner[at[a] : at[min(len(many), a + few)]] = np.repeat(np.arange(a, a + len(n[part]), dtype=np.int32), n[part] + 1)
    # suffixes come greatest first: a window opens a group unless it shares `length` letters with the one before
    group_of = induced.scratch(total + 1, np.int32 if total < 1 << 31 else np.int64, SORT_MEMORY)
    smallest = induced.scratch(total + 1, np.int64, SORT_MEMORY)
    group, ids = -1, least[many]
    for place, shared in induced.Sort(text, length, SORT_MEMORY, 257).descending():
        mine = owner[place]
        fits = place + length < at[mine + 1]
        if not fits.any():
            continue
        place, mine, new = place[fits], mine[fits], shared[fits] < length
        opened = np.cumsum(new)
        group_of[place] = group + opened
        begins = np.flatnonzero(new)
        first = int(begins[0]) if len(begins) else len(place)
        if first:
            smallest[group] = min(int(smallest[group]), int(ids[mine[:first]].min()))
        if len(begins):
            smallest[group + 1 : group + 1 + len(begins)] = np.minimum.reduceat(ids[mine], begins)
        group += int(opened[-1])
    for a in range(0, len(many), few):
        windows = n[a : a + few] - length + 1
        values = smallest[group_of[bs.spread(at[:-1][a : a + few], windows)]]
        stretch = np.repeat(np.arange(a, a + len(windows)), windows)
        first = np.arange(len(stretch)) - np.repeat(np.cumsum(windows) - windows, windows)
        begins, counts = bs.grouped_pairs(stretch, values)
        yield many[stretch[begins]], first[begins], counts, values[begins]


_FOUND = "kind int, h1 long, h2 long, doc long, rid long, at long, bucket int, packed binary"


def _found(kind: int, n: int, **columns) -> pa.RecordBatch:
    names = ["h1", "h2", "doc", "rid", "at", "bucket", "packed"]
    types = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32())] + [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], ["kind", *names])


def _spans(rid: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Spans packed by their row's bucket; a span is one number, its start and its length."""
    order = np.lexsort((start, rid))
    value = (start[order].astype(np.uint64) << bs.M(32)) | (end - start)[order].astype(np.uint64)
    return bs.routed(rid[order], value, buckets)


class _Shard:
    """Records of a shard as they come: their numbers in memory, their letters in a file."""

    def __init__(self):
        self.parts, self.file = [], tempfile.TemporaryFile()

    def add(self, packed: bytes, plain) -> None:
        *numbers, letters = bs.unblob(packed, *_PACKED)
        self.parts.append([x.copy() for x in numbers])  # views would keep the letters
        self.file.write(plain.decompress(letters))

    def column(self, k: int) -> np.ndarray:
        return np.concatenate([p[k] for p in self.parts])

    def letters(self) -> np.ndarray:
        """All records' letters, one after the other, mapped: only what is read comes to memory."""
        self.file.flush()
        return np.asarray(np.memmap(self.file, np.uint8, "r"))


def _sorted(dealt: DataFrame, buckets: int, length: int) -> DataFrame:
    """What the shards find. kind 0: rows' covered spans, packed by their bucket; 1: a place of a common stretch; 2: a common stretch's runs of smallest ids."""

    def run(batches):
        import zstandard

        plain = zstandard.ZstdDecompressor()
        held: dict[int, _Shard] = {}
        for batch in batches:
            for n, kind, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind:
                    h1, h2, doc, rid, at = bs.unblob(packed, np.int64, np.int64, np.int64, np.int64, np.int64)
                    yield _found(1, len(h1), h1=h1, h2=h2, doc=doc, rid=rid, at=at)
                else:
                    held.setdefault(n, _Shard()).add(packed, plain)
        for n in sorted(held):
            shard = held.pop(n)
            h1, h2, least, common, sizes, places, doc, rid, at = map(shard.column, range(9))
            at, letters = at.astype(np.int64), shard.letters()
            ends = np.cumsum(sizes.astype(np.int64))
            record = np.repeat(np.arange(len(h1)), places)
            order = np.lexsort((least, h2, h1))
            begins, counts = bs.grouped_pairs(h1[order], h2[order])
            ident = np.empty(len(h1), np.int64)
            ident[order] = np.repeat(np.arange(len(begins)), counts)
            first = order[begins]
            is_common = np.zeros(len(begins), bool)
            np.logical_or.at(is_common, ident, common.astype(bool))
            found = list(_least(h1[first], least[first], sizes[first], (ends - sizes)[first], letters, length))
            stretch, lo, windows, smallest = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.argsort(stretch, kind="stable")
            stretch, lo, windows, smallest = stretch[by], lo[by], windows[by], smallest[by]
            cuts = np.searchsorted(stretch, np.arange(len(begins) + 1))
            mine = ident[record]
            times = cuts[mine + 1] - cuts[mine]
            place = np.repeat(np.arange(len(record)), times)
            r = cuts[mine][place] + np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
            hit = smallest[r] < doc[place]
            place, r = place[hit], r[hit]
            sent = _spans(rid[place], at[place] + lo[r], at[place] + lo[r] + windows[r] + length - 1, buckets)
            yield _found(0, sent.num_rows, bucket=sent.column(0), packed=sent.column(1))
            which = np.flatnonzero(is_common)
            if len(which):
                packed = [bs.blob(windows[cuts[k] : cuts[k + 1]].astype(np.int32), smallest[cuts[k] : cuts[k + 1]]) for k in which]
                yield _found(2, len(which), h1=h1[first][which], h2=h2[first][which], packed=packed)

    return dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(run, _FOUND)


def _marked(places: DataFrame, length: int, buckets: int) -> DataFrame:
    """Spans packed by their row's bucket: windows of common stretches with a smaller id than their document's; places has doc, rid, at, packed."""

    def run(batches):
        for batch in batches:
            doc, rid, at = (batch.column(n).to_numpy() for n in ("doc", "rid", "at"))
            alike: dict[bytes, list[int]] = {}
            for i, least in enumerate(batch.column("packed").to_pylist()):
                alike.setdefault(least, []).append(i)
            found = []
            for least, rows in alike.items():
                counts, docs = bs.unblob(least, np.int32, np.int64)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                i, k = np.nonzero(docs[None, :] < doc[rows][:, None])
                if len(i):
                    i = np.array(rows)[i]
                    found.append((rid[i], at[i] + bounds[k], at[i] + bounds[k + 1] + length - 1))
            if found:
                yield _spans(*(np.concatenate(x) for x in zip(*found, strict=True)), buckets)

    return places.mapInArrow(run, bs.ROUTED)


def _joined(packed: bytes | None) -> list[tuple[int, int]]:
    """All (start, end) of packed spans in order."""
    v = np.sort(np.frombuffer(packed or b"", np.uint64))
    starts = (v >> bs.M(32)).astype(np.int64)
    return list(zip(starts.tolist(), (starts + (v & bs.M(0xFFFFFFFF)).astype(np.int64)).tolist(), strict=True))


def repeated_spans(docs: DataFrame, length: int = LENGTH, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' _id, _text with spans (packed starts and lengths in bytes; they may overlap) and _copy (whether an equal text has a smaller id)."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(row_id).cast("long").alias("_id"), t.alias("_text"))
    rows = rows.withColumn("_rid", F.when((F.octet_length("_text") >= length) & F.col("_id").isNotNull(), F.xxhash64("_id", "_text")))
    long_enough = F.col("_rid").isNotNull()
    keyed = rows.where(long_enough).select("_id", "_rid", F.octet_length("_text").alias("_n"), F.sha2("_text", 256).alias("_class"))
    # a table of its own, so that the join with all rows of a hot text can be split
    first = cut(keyed.groupBy("_class").agg(F.min(F.struct("_id", "_rid")).alias("_first"), F.max("_n").alias("_n")), "classes")
    size = first.agg(F.sum("_n")).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-size // SHARD_BYTES))
    firsts = first.select(F.col("_first._rid").alias("_rid")).distinct()
    texts = rows.where(long_enough).select("_rid", F.xxhash64("_text").alias("_key"), "_text")
    shared = cut(_shared_hashes(texts, buckets, length).join(firsts, "_rid", "left_semi"), "shared-hashes")
    met = rows.where(long_enough).join(shared, "_rid").select("_id", "_rid", "_text", "flags")
    found = cut(_sorted(_gather(met, buckets, length), buckets, length), "repeats")
    drop(shared)
    places = found.where("kind = 1").select("h1", "h2", "doc", "rid", "at").join(found.where("kind = 2").select("h1", "h2", "packed"), ["h1", "h2"])
    sent = found.where("kind = 0").select("bucket", "packed").union(_marked(places.select("doc", "rid", "at", "packed"), length, buckets))
    spans = _by_document(sent, buckets, np.uint64, "spans")
    copies = keyed.join(first, "_class").where(F.col("_id") > F.col("_first._id")).select("_rid").distinct().withColumn("_copy", F.lit(True))
    marks = cut(spans.join(copies, "_rid", "full"), "marks")
    drop(found, first)
    return rows.join(marks, "_rid", "left")


def remove_repeats(docs: DataFrame, length: int = LENGTH, row_id: str = "doc_id", text: str = "text", kept: bool = True) -> DataFrame:
    """row_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, kept (the remaining bytes, binary)."""

    def run(batches):
        for few in fewer(batches):
            out = []
            for t, spans, copy in zip(*(few.column(n).to_pylist() for n in ("_text", "spans", "_copy")), strict=True):
                data = t.encode("utf-8", "surrogatepass")
                if copy:
                    out.append((len(data), len(data), 1, hashlib.sha256(b"").hexdigest(), b""))
                    continue
                left, removed, n, at, last = [], 0, 0, 0, -1
                for a, b in _joined(spans):
                    if b <= last:
                        continue
                    if a > last:
                        n += 1
                        left.append(data[at:a])
                        removed += b - a
                    else:
                        removed += b - last
                    at = last = b
                left.append(data[at:])
                rest = b"".join(left)
                out.append((len(data), removed, n, hashlib.sha256(rest).hexdigest(), rest))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [few.column(0)] + [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + kept], ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + kept])

    found = repeated_spans(docs, length, row_id, text)
    schema = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept
    return found.select("_id", "_text", "spans", "_copy").mapInArrow(run, schema).withColumnRenamed("_id", row_id)
