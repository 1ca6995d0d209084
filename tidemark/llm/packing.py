"""Sequence packing by non-negative least squares.

Documents become token ids, are cut into whole windows and one rest each, and
the histogram of rest lengths (at most window - 1 numbers, whatever the input)
is packed: all combinations of two and three lengths that fill the window
exactly are enumerated, their repeat counts are solved against the histogram by
non-negative least squares, rounded to the nearest number that the rests left
allow, and what is left is packed greedily end to end, cut where a window is
full. Rows find their places by their rank in their length, so assignment is
distributed and needs no driver loop.

Defined results: a null or empty text is the single end id; a text of any length
is whole windows and a rest; equal lengths (ties) and repeated rows take places
by the order in which their task reads them; null doc_ids are kept; an empty
table gives no pieces; other columns of the input, whatever their names, are not
read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fewer

WINDOW = 1024
_ENCODERS: dict = {}


def encoder(json_path: str):
    """A function from text to ids, equal to the tokenizer file's; made once in a worker.

    Where the same vocabulary lies beside it as merge ranks, the faster library
    reads those; a text that it can't take goes to the tokenizer itself.
    """
    if json_path not in _ENCODERS:
        import base64
        import os

        slow = []

        def exact(text):
            if not slow:
                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(json_path))
                slow[0].encode_special_tokens = True
            return slow[0].encode(text, add_special_tokens=False).ids

        encode = exact
        ranks_path = json_path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks_path):
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

            def encode(text):
                try:
                    return fast.encode_ordinary(text)
                except (ValueError, RuntimeError):
                    return exact(text)

        _ENCODERS[json_path] = encode
    return _ENCODERS[json_path]


def combinations(window: int = WINDOW) -> list[tuple[int, ...]]:
    """All pairs and triples of lengths that fill the window exactly, pairs first."""
    found = [(window - a, a) for a in range(1, window // 2 + 1)]
    for c in range(1, window // 3 + 1):
        found += [(window - b - c, b, c) for b in range(c, (window - c) // 2 + 1)]
    return found


def solve(histogram: np.ndarray, combos: list[tuple[int, ...]], rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|: projected gradient steps with momentum, then rounded within what is there."""
    if not combos or not histogram.sum():
        return np.zeros(len(combos), dtype=np.int64)
    rows = np.concatenate([np.asarray(c) for c in combos])
    cols = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    size, n = len(histogram), len(combos)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=size), 1.0))  # rows with many combinations must not dominate the step
    goal = histogram * scale
    forward = lambda x: np.bincount(rows, weights=x[cols], minlength=size) * scale
    backward = lambda y: np.bincount(cols, weights=(y * scale)[rows], minlength=n)
    v = np.ones(n)
    for _ in range(20):
        v = backward(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / np.linalg.norm(backward(forward(v)))
    x, y, t = np.zeros(n), np.zeros(n), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * backward(forward(y) - goal))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    left, out = histogram.astype(np.int64).copy(), np.zeros(n, dtype=np.int64)
    for i in np.argsort(-x, kind="stable"):  # rounding may not use a length more often than it occurs
        need = {}
        for length in combos[i]:
            need[length] = need.get(length, 0) + 1
        k = min(int(round(x[i])), *(left[length] // m for length, m in need.items()))
        if k > 0:
            out[i] = k
            for length, m in need.items():
                left[length] -= k * m
    return out


def plan(histogram: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Where the n-th rest of each length goes: ranges of ranks with their first sequence and offset, and the residual stream's first position for each length."""
    combos = combinations(window)
    times = solve(histogram, combos)
    used = np.zeros(len(histogram), dtype=np.int64)
    ranges, sequence = [], 0
    for i in np.flatnonzero(times):
        offset = 0
        for length in combos[i]:
            ranges.append((length, used[length], used[length] + times[i], sequence, offset))
            used[length] += times[i]
            offset += length
        sequence += int(times[i])
    ranges.sort()
    residual = (histogram - used) * np.arange(len(histogram))
    starts = np.concatenate([[0], np.cumsum(residual)[:-1]])
    columns = [np.array(c, dtype=np.int64) for c in zip(*ranges, strict=True)] if ranges else [np.zeros(0, dtype=np.int64)] * 5
    return dict(zip(("length", "lo", "hi", "sequence", "offset"), columns, strict=True)) | {"used": used, "starts": starts, "sequences": np.array([sequence])}


def tokenized(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 0, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: _id, part (the task that made it), tokens (with the end id), rest (tokens beyond whole windows), the
    numbers of its rest among the task's rests of that length and of its first whole window in the task, and its ids (little-endian, 16 bits each where all fit)."""

    def run(batches):
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer_path)
        seen, wholes = np.zeros(window, dtype=np.int64), 0
        for few in fewer(batches):
            tokens, rests, nth, whole, blobs = [], [], [], [], []
            for t in few.column(1).to_pylist():
                found = encode(t) if t else []
                found.append(end_id)
                a = np.asarray(found, dtype="<u4")
                blobs.append((a.astype("<u2") if a.max() < 1 << 16 else a).tobytes())
                n, rest = divmod(len(found), window)
                tokens.append(len(found))
                rests.append(rest)
                nth.append(int(seen[rest]))
                whole.append(wholes)
                seen[rest] += 1
                wholes += n
            columns = [few.column(0), pa.array([part] * len(tokens), pa.int32()), pa.array(tokens, pa.int64()), pa.array(rests, pa.int32()), pa.array(nth, pa.int64()), pa.array(whole, pa.int64()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "part", "tokens", "rest", "nth", "whole", "ids"])

    few = docs.select(F.col(row_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    return few.mapInArrow(run, "_id long, part int, tokens long, rest int, nth long, whole long, ids binary")


#: Up to so many tasks, the counts by task and length (at most 1,023 small rows for each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_PARTS = 1000


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 0, row_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """Pieces of all documents: row_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids (32 bits each).

    Whole windows are sequences of their own. The n-th rest of a length is found
    by counting: each task has numbered its rests by length, and the counts of
    the tasks before it are added.
    """
    spark = docs.sparkSession
    made = cut(tokenized(docs, tokenizer_path, window, end_id, row_id, text), "tokens")
    counts = made.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("tokens") / window)).alias("wholes"))
    counts = cut(counts, "token-counts")
    hist = np.zeros(window, dtype=np.int64)
    for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect():
        if r["rest"]:
            hist[r["rest"]] = r["n"]
    found = plan(hist, window)
    stream = int(found["starts"][-1] + (hist[-1] - found["used"][-1]) * (window - 1))
    first_whole = int(found["sequences"][0]) + -(-stream // window)
    # One row for each task and length: no frame here holds more rows than there are tasks.
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    wholes = counts.groupBy("part").agg(F.sum("wholes").alias("wholes")).select("part", F.coalesce(F.sum("wholes").over(above), F.lit(0)).alias("first_whole"))
    firsts = ranks.join(wholes, "part")
    parts = counts.select("part").distinct().count()
    given = spark.sparkContext.broadcast(found)  # at most three ranges for each combination: bounded by the window alone

    def place(batches):
        p = given.value
        ends = np.searchsorted(p["length"], np.arange(window + 1))
        head = int(p["sequences"][0])
        for few in fewer(batches):
            out = []
            for r in few.to_pylist():
                tokens, rest, blob = r["tokens"], r["rest"], r["ids"]
                held = np.frombuffer(blob, "<u2" if len(blob) == 2 * tokens else "<u4").astype("<u4")
                n = tokens // window
                pieces = [(j * window, window, first_whole + r["first_whole"] + r["whole"] + j, 0) for j in range(n)]
                start, rank = n * window, r["first"] + r["nth"]
                if rest and rank < p["used"][rest]:
                    a, b = ends[rest], ends[rest + 1]
                    i = a + int(np.searchsorted(p["lo"][a:b], rank, side="right")) - 1
                    pieces.append((start, rest, int(p["sequence"][i] + rank - p["lo"][i]), int(p["offset"][i])))
                elif rest:
                    position = int(p["starts"][rest] + (rank - p["used"][rest]) * rest)
                    while rest:
                        sequence, offset = divmod(position, window)
                        length = min(rest, window - offset)
                        pieces.append((start, length, head + sequence, offset))
                        start, position, rest = start + length, position + length, rest - length
                for at, length, sequence, offset in pieces:
                    piece = held[at : at + length].tobytes()
                    out.append((r["_id"], at, length, zlib.crc32(piece), tokens, sequence, offset) + ((piece,) if ids else ()))
            names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * ids
            kinds = [pa.int64()] * 7 + [pa.binary()] * ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    joined = made.join(F.broadcast(firsts) if parts <= BROADCAST_PARTS else firsts, ["part", "rest"])
    schema = "_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * ids
    return joined.mapInArrow(place, schema).withColumnRenamed("_id", row_id)
