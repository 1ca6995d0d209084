"""Packing, classifier, sharding, top-k, Jaccard join, repeated strings and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import contracts, induced, jaccard, packing, quality, repeats, sharding, topk

# ------------------------------------------------------------------- packing


def check_pieces(rows, texts, window=1024):
    """Round trip: pieces of a document join to its ids; sequences are gapless and hold at most a window."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(contracts.tokenizer())
    t.encode_special_tokens = True
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= window
    got = sorted((b"".join(bytes(r.ids) for r in sorted(ps, key=lambda r: r.start)) for ps in _by(rows, lambda r: (r.doc_id, r.copy if hasattr(r, "copy") else 0)).values()))
    want = sorted(np.asarray([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for x in texts)
    return got, want, sum(window - sum(n for _, n in p) for p in by_seq.values())


def _by(rows, key):
    out = {}
    for r in rows:
        out.setdefault(key(r), []).append(r)
    return out


def test_packing_round_trip(spark, documents):
    rows = packing.pack(documents, contracts.tokenizer()).collect()
    got, want, padding = check_pieces(rows, [r.text for r in documents.select("text").collect()])
    assert got == want and padding < 1024


def test_packing_of_odd_rows(spark, odd):
    rows = packing.pack(odd, contracts.tokenizer()).collect()
    texts = [r.text for r in odd.collect()]
    assert sum(r.length for r in rows if r.start == 0) > 0 and sum(r.doc_tokens for r in rows if r.start == 0) == sum(r.length for r in rows)
    _, want, _ = check_pieces(rows, texts)
    assert sum(len(w) // 4 for w in want) == sum(r.length for r in rows)
    assert packing.pack(odd.limit(0), contracts.tokenizer()).count() == 0


def test_packing_joins_counts_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_PARTS", 0)
    rows = [(k, "word " * (k % 700)) for k in range(900)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), contracts.tokenizer()).collect()
    got, want, padding = check_pieces(found, [t for _, t in rows])
    assert got == want and padding < 1024


def test_special_token_strings_are_text(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    assert 50256 not in np.frombuffer(bytes(packing.pack(df, contracts.tokenizer()).first().ids), "<u4")


@pytest.mark.parametrize("lengths", [{600: 1000}, {512: 7}, {1023: 5, 1: 5}, {k: 1 for k in range(1, 1024)}, {}])
def test_plans_place_every_rest_once(lengths):
    h = np.zeros(1024, np.int64)
    for k, n in lengths.items():
        h[k] = n
    p = packing.plan(h)
    assert (p["used"] <= h).all()
    for k in lengths:
        ranges = sorted((lo, hi) for length, lo, hi in zip(p["length"], p["lo"], p["hi"], strict=True) if length == k)
        assert [lo for lo, _ in ranges] == [0, *[hi for _, hi in ranges[:-1]]][: len(ranges)] and (not ranges or ranges[-1][1] == p["used"][k])


# ---------------------------------------------------------------- classifier


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = contracts.op3_quality_classifier(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    m = got.merge(labels, on="doc_id")
    m = m[m.held_out]
    assert len(m) > 50 and (m.predicted == m.quality).mean() > 0.95 and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(got.doc_id, got.held_out, strict=True))


def test_quality_score_against_brute_force():
    """The score is the logistic curve of the normalised difference of whole texts' sizes, and of nothing else."""
    import zstandard as z

    rng = random.Random(0)
    rows = [(" ".join(rng.choice(["one", "two", "three", "four", "word", "text"]) for _ in range(rng.randint(20, 400))), 1) for _ in range(60)]
    rows += [("".join(rng.choice("#%$&* !ab") for _ in range(rng.randint(100, 2000))), 0) for _ in range(40)]
    model = quality.fit(rows)
    a, b = model.weights
    for t in [rows[0][0], rows[-1][0], "é" * 5000, "", rows[3][0] * 500]:
        sizes = []
        for d in model.dictionaries:
            c = z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False)
            data = t.encode()
            sizes.append(sum(len(c.compress(data[k : k + 1024])) for k in range(0, len(data), 1024)))
        x = (sizes[1] - sizes[0]) / (sizes[1] + sizes[0]) if t else 0.0
        assert abs(model.scores([t])[0] - 1 / (1 + np.exp(-np.clip(a + b * x, -40, 40)))) < 1e-12
    assert model.scores([rows[0][0]])[0] > 0.5 > model.scores([rows[-1][0]])[0]


def test_quality_of_odd_rows(spark, odd):
    model = quality.fit([("plain words of a text " * 5 + str(k), 1) for k in range(60)] + [("#%$ && *** !! " * 5 + str(k), 0) for k in range(60)])
    out = quality.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out) and quality.score(odd.limit(0), model).count() == 0
    assert quality.fit([]).scores(["x", None]) == [0.5, 0.5] and quality.fit([("a", 1)]).scores([""]) == [1.0]
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(odd, empty).scores(["x"]) == [0.5]


# ------------------------------------------------------------------ sharding


def test_sharding(spark, odd):
    rng = random.Random(0)
    rows = [(i, "x" * rng.randint(0, 300) + str(i)) for i in range(3000)] + [(5000 + i, "y" * 250) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.histogram_sort(df, 8).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    sizes, where = {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
    text = dict(rows)
    for r in got:
        assert r["size"] == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        where.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert max(sizes.values()) <= sum(sizes.values()) / 8 + 251 * 400
    out = sharding.histogram_sort(odd, 8).collect()
    assert len(out) == odd.count() and sharding.histogram_sort(odd.limit(0), 8).count() == 0
    assert {r["size"] for r in out if r.doc_id == 1} == {1}


def test_splitters_are_near_equal(spark):
    df = spark.range(20000).select(F.xxhash64("id").alias("key"), F.lit(10).cast("long").alias("size"))
    ends = sharding.splitters(df, 8)
    keys = np.sort([r.key for r in df.select("key").collect()])
    assert np.abs(np.searchsorted(keys, ends) - np.arange(1, 8) * 2500).max() <= 3


# --------------------------------------------------------------------- top-k


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (300, 6)) / 256.0
    rows = [(i, x[i].tolist()) for i in range(300)] + [(300, None), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (500, [0.1, 0.2]), (550, [0.3, 0.1]), (None, [0.0] * 6), (600, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, _id int").repartition(4)
    v = topk.usable(df, "vec_id", "embedding", 256.0)
    got = {}
    for r in topk.search(v.where("_id % 50 = 0"), v, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: [int(np.floor(256 * np.float64(np.float32(y)))) for y in z] for i, z in rows if i is not None and z is not None and all(y is not None and np.isfinite(y) for y in z)}
    for q, z in whole.items():
        if q % 50 == 0:
            near = sorted((-sum(a * b for a, b in zip(z, w, strict=True)), i) for i, w in whole.items() if i != q and len(w) == len(z))[:5]
            assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(near)]
    assert topk.search(v.limit(0), v.limit(0), 5).count() == 0


def test_topk_of_many_blocks_tiles_and_ties(spark, monkeypatch):
    """Blocks and tiles of few rows, a tree of several levels, and one vector that a third of all rows have."""
    for name, value in (("BLOCK", 16), ("TILE", 16), ("TILE_BYTES", 8 * 4 * 7), ("FAN", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    x = rng.integers(-9, 10, (600, 4))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "_id long, _v array<double>").repartition(5)
    got = {}
    for r in topk.search(df.where("_id % 5 = 0"), df, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert len(got) == 120
    for q, found in got.items():
        near = sorted((-int(x[q] @ x[i]), i) for i in range(600) if i != q)[:5]
        assert sorted(found) == [(n + 1, i, -s) for n, (s, i) in enumerate(near)]


def test_a_tile_keeps_k_of_any_number_of_ties():
    q, c = np.ones((3, 2)), np.ones((4000, 2))
    row, score, ids = topk._tile(q, np.array([0, 1, 9999]), c, np.arange(4000), 5)
    assert len(row) == 15 and ids[row == 0].tolist() == [1, 2, 3, 4, 5] and ids[row == 2].tolist() == [0, 1, 2, 3, 4] and set(score) == {2}


# -------------------------------------------------------------- Jaccard join


def brute_components(rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for d, t in rows:
        w = word.findall((t or "").translate(low))
        sets.append((d, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    out = []
    for i, (d, s) in enumerate(sets):
        ids = [sets[k][0] for k in range(len(sets)) if root(k) == root(i) and sets[k][0] is not None]
        out.append((d, len(s), min(ids, default=None)))
    return out


def near_copies(rng, n, words, edits):
    base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(w))
            rng.choice([lambda: w.__setitem__(k, f"e{rng.randint(0, 10**6)}"), lambda: w.pop(k) if len(w) > 1 else None, lambda: w.insert(k, "ins")])()
        yield " ".join(w)


@pytest.mark.parametrize("heavy", [(2,), (6, 12, 24, 48)])
def test_jaccard_against_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    rng = random.Random(1)
    texts = [t for n, words, edits in [(60, 150, 9), (40, 30, 2), (30, 9, 1), (12, 400, 20), (20, 5, 1), (15, 6, 1)] for t in near_copies(rng, n, words, edits)]
    texts += [" ".join(f"l{k}" for k in range(40)) + f" tail{k} " + " ".join(f"z{rng.randint(0, 999)}" for _ in range(4)) for k in range(30)]
    texts += ["a b c", "a b c", "A  B\tC", "", None, " \n", "one", "a b c d e f g", "a b c d e f g h"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).orderBy("doc_id").collect()]
    assert got == brute_components(rows)


def test_texts_that_share_an_id_are_sets_of_their_own(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "pq")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (9, "alone among all of these")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 37, 1), (9, 1, 9)])


class Plan:
    """Stands for a DataFrame: gives back the function that would run in a task."""

    def select(self, *a):
        return self

    def mapInArrow(self, f, schema):
        return f


def test_uncertain_sets_meet_by_their_smallest_elements(monkeypatch):
    """With no deletion signature at all, and no certainty, linked sets share a signature, and it is an element's."""
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "deletion_signatures", lambda v, b: (np.zeros(0, np.uint64), False))
    rng = np.random.default_rng(4)
    for n in (30, 90, 300):
        for _ in range(30):
            x = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
            y = np.sort(np.concatenate([x[rng.permutation(n)[: n - n // 14]], rng.integers(0, 1 << 63, n // 14).astype(np.uint64)]))
            assert 4 * len(np.intersect1d(x, y)) >= 3 * len(np.union1d(x, y))
            band = sorted(set(jaccard.bands(len(x))) & set(jaccard.bands(len(y))))
            batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([x.tobytes(), y.tobytes()], pa.binary()), pa.array([band, band], pa.list_(pa.int32()))], ["rid", "s", "bands"])
            out = next(iter(jaccard._deleted(Plan())([batch])))
            sigs = {k: {s for s, r in zip(*(c.to_pylist() for c in out.columns), strict=True) if r == k} for k in (1, 2)}
            assert sigs[1] & sigs[2]


def test_far_parts_of_a_cluster_are_compared(spark, monkeypatch):
    """A chain: neighbours are linked, ends are not; blocks of few sets, so that tiles of one cluster are many."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    monkeypatch.setattr(jaccard, "HEAVY", (2,))
    rng = random.Random(5)
    words, rows = [f"c{k}" for k in range(120)], []
    for d in range(60):
        rows += [(3 * d + k, " ".join(words[: len(words) - k])) for k in range(3)]
        words = words[2:] + [f"n{rng.randint(0, 10**9)}" for _ in range(2)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == brute_components(rows)


def test_jaccard_of_odd_rows(spark, odd):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(odd).collect()), key=key)
    assert got == sorted(brute_components([(r.doc_id, r.text) for r in odd.collect()]), key=key)
    assert jaccard.join(odd.limit(0)).count() == 0


# ---------------------------------------------------------- repeated strings


def shared_letters(a, b, depth):
    return next((k for k in range(depth) if k >= len(a) or k >= len(b) or a[k] != b[k]), depth)


@pytest.mark.parametrize("limit", [0, 2000, 20_000, 1 << 28])
def test_suffix_arrays_against_sorting(limit):
    """With no memory at all, queues, runs and arrays lie in files, and all levels are recursion."""
    rng = np.random.default_rng(0)
    for n in range(250):
        t = rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(1, 120)))
        if n % 3 == 0:
            t = np.tile(t[: max(1, len(t) // 5)], 5)
        depth = int(rng.choice([3, 8, 20, 254]))
        order, values = induced.suffix_array(t, depth, limit)
        suffixes = [tuple(t[i:]) for i in order]
        heads = [s[:depth] for s in suffixes]
        assert sorted(order.tolist()) == list(range(len(t))) and heads == sorted(heads)
        assert values.tolist() == [0] + [shared_letters(a, b, depth) for a, b in zip(suffixes, suffixes[1:], strict=False)]


def test_a_text_ten_times_its_bound():
    """200,000 letters of words and repeated passages under a bound that holds 6,000: recursion, files, and bounded memory."""
    import tracemalloc

    rng = np.random.default_rng(1)
    words = [rng.integers(97, 123, int(k)).astype(np.uint8) for k in rng.integers(3, 9, 300)]
    passage = np.concatenate([words[int(k)] for k in rng.integers(0, 300, 200)])
    text = np.concatenate([*[words[int(k)] for k in rng.integers(0, 300, 20_000)], passage, *[words[int(k)] for k in rng.integers(0, 300, 20_000)], passage])
    assert len(text) > 200_000
    t = np.concatenate([text.astype(np.uint16) + 2, [0]]).astype(np.uint16)
    limit = 400_000
    sort = induced.Sort(t, 50, limit, 257)
    tracemalloc.start()
    kept, last = 0, None
    for places, values in sort.descending():
        kept += int((values >= 50).sum())
        pairs = zip([last, *places[:-1]], places, values, strict=True)
        for a, b, v in list(pairs)[::97]:
            if a is not None:
                assert tuple(t[a : a + 50]) >= tuple(t[b : b + 50]) and v == shared_letters(t[a:], t[b:], 50)
        last = places[-1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sort.levels > 1 and kept == len(passage) - 49 and peak < 24 * limit


def brute_removed(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for k in range(len(b) - length + 1):
                first[b[k : k + length]] = min(first.get(b[k : k + length], d), d)
    for d, t in rows:
        b, m = (t or "").encode(), None
        m = np.zeros(len(b), bool)
        if d is not None:
            for k in range(len(b) - length + 1):
                if first[b[k : k + length]] < d:
                    m[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~m])
        yield d, len(b), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()


def test_repeats_against_brute_force(spark):
    rng = random.Random(2)
    passages = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (49, 50, 51, 80, 200)]
    rows = []
    for d in range(120):
        parts = ["".join(rng.choice("xyz") for _ in range(rng.randint(0, 60))) + rng.choice([*passages, passages[4][30:120]]) for _ in range(rng.randint(0, 4))]
        rows.append((d, "".join(parts)))
    rows += [(200, "a" * 300), (201, "a" * 120 + "b"), (202, "ab" * 100), (203, None), (204, ""), (205, rows[7][1]), (206, passages[4]), (207, passages[4]), (208, "a" * 50), (-5, passages[3] + "tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(tuple(r)[:5] for r in repeats.remove_repeats(df).collect())
    assert got == sorted(brute_removed(rows))


def test_repeats_of_texts_that_share_an_id(spark):
    rng = random.Random(6)
    one, two = ("".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(2))
    rows = [(1, one + "x"), (1, two), (1, one + two), (2, "y" + two), (2, one), (2, one), (3, one + "x"), (0, one[:60])]
    got = sorted(tuple(r)[:5] for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == sorted(brute_removed(rows))


def test_repeats_of_odd_rows(spark, odd):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted((tuple(r)[:5] for r in repeats.remove_repeats(odd).collect()), key=key)
    assert got == sorted(brute_removed([(r.doc_id, r.text) for r in odd.collect()]), key=key)
    assert repeats.remove_repeats(odd.limit(0)).count() == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages_against_brute_force(spark, sf, documents):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stages = [f for _, f in corpus_pipeline.STAGES]
    one = stages[0](spark, documents, sf).cache()
    assert one.columns == documents.columns and 0 < one.count() < documents.count()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(documents, labels)
    found = documents.collect()
    kept = {r.doc_id for r, s in zip(found, model.scores([r.text for r in found]), strict=True) if s >= 0.5}
    assert {r.doc_id for r in one.collect()} == kept
    two = stages[1](spark, one, sf).cache()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert sorted(r.doc_id for r in two.collect()) == sorted({c for _, _, c in brute_components(rows)})
    from .test_native import base_secrets, hits

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    three = stages[2](spark, two, sf).cache()
    assert {r.doc_id for r in three.collect()} == {d for d, _, h, _ in hits([(r.doc_id, r.text) for r in two.collect()], items) if not h}
    four = stages[3](spark, three, sf).cache()
    assert four.columns == documents.columns and four.count() == three.count()
    assert all(base_secrets(r.text) == "" for r in four.collect())
    got, want, _ = check_pieces(stages[4](spark, four, sf).collect(), [r.text for r in four.collect()])
    assert got == want
    assert corpus_pipeline.run(spark, sf).select(F.sum("length")).first()[0] == sum(len(w) // 4 for w in want)


def test_pipeline_of_odd_rows(spark, sf, odd):
    """Null ids, repeated rows, empty texts and extra columns through all stages; one row of each group with words, by count."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    two = corpus_pipeline.near_duplicates(spark, odd, sf)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    same = "same text of a few words, over and over again, and once more"
    want = [(r.doc_id, r.text) for r in odd.collect()]
    want.remove((6, want[[i for i, _ in want].index(5)][1]))
    for _ in range(2):
        want.remove((8, same))
    assert sorted(((r.doc_id, r.text) for r in two.collect()), key=key) == sorted(want, key=key) and two.columns == odd.columns
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == odd.columns
    assert sum(r.length for r in corpus_pipeline.pack(spark, docs, sf).collect()) > 0
    assert corpus_pipeline.near_duplicates(spark, odd.limit(0), sf).count() == 0
    again = odd.where("doc_id = 8").union(odd.where("doc_id is null")).union(odd.where("doc_id is null"))
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, again, sf).collect()), key=key) == sorted([(8, same), (None, "a row without an id"), (None, None), (None, None)], key=key)
