"""Speech on the time line: splitting long intervals, model back ends, punctuation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST, FRAME, NEAR_DB = 20.0, 0.02, 2.0


def quiet_cuts(samples: np.ndarray, rate: int, longest: float = LONGEST, frame: float = FRAME) -> list[int]:
    """Sample positions at which a long interval is cut: while what is left is too long, at the latest of the frames in the second
    half of the longest piece whose energy is within 3 dB of the quietest there."""
    most, n = int(round(longest * rate)), max(1, int(round(frame * rate)))
    cuts, at = [], 0
    while len(samples) - at > most:
        half = samples[at + most // 2 : at + most]
        whole = len(half) // n
        if whole:
            e = np.einsum("ij,ij->i", *[half[: whole * n].reshape(whole, n).astype(np.float64)] * 2) / n
            best = int(np.flatnonzero(e <= NEAR_DB * e.min() + 1e-12)[-1])
            at += most // 2 + best * n + n // 2
        else:
            at += most
        cuts.append(at)
    return cuts


def split_quiet(df: DataFrame, samples: str, rate: Column, longest: float = LONGEST, frame: float = FRAME) -> DataFrame:
    """Adds cuts (array of sample positions): an Arrow function, since each cut decides where the next is looked for."""

    @F.arrow_udf("array<bigint>")
    def run(x: pa.Array, r: pa.Array) -> pa.Array:
        return pa.array([None if s is None else quiet_cuts(np.asarray(s, dtype=np.float64), int(k), longest, frame) for s, k in zip(x.to_pylist(), r.to_pylist(), strict=True)], pa.list_(pa.int64()))

    return df.withColumn("cuts", run(F.col(samples), rate))


def detect(samples: DataFrame, keys: list[str], index: str, value: str, frame: int, frame_s: float, floor: float = -45.0, relative: float = -30.0, min_silence: float = 1.0, min_speech: float = 0.2, pad: float = 0.15) -> DataFrame:
    """keys, start, end: speech by energy. Frame levels, a mask against floor and peak, its intervals, merged and padded."""
    from .intervals import merge_and_pad
    from .islands import mask_intervals
    from .statistics import energy, speech_mask

    levels = speech_mask(energy(samples, keys, index, value, frame), keys, floor, relative)
    whole = levels.groupBy(*keys).agg(((F.max("frame") + 1) * frame_s).alias("_end"))
    found = merge_and_pad(mask_intervals(levels, keys, "frame", "speech", frame_s), keys, "start", "end", min_silence, min_speech, pad)
    return found.join(whole, keys).select(*keys, "start", F.least("end", "_end").alias("end"))


def slice_samples(samples: Column, rate: Column, start: Column, end: Column) -> Column:
    """The samples of an interval, kept within what there is; none if nothing is left. Places round half to even."""
    a = F.greatest(F.lit(0), F.bround(start * rate).cast("int"))
    z = F.least(F.size(samples), F.bround(end * rate).cast("int"))
    return F.when(z > a, F.slice(samples, a + 1, z - a)).otherwise(F.slice(samples, F.lit(1), F.lit(0)))


SEGMENTS = "array<struct<text:string,start:double,end:double,words:array<struct<word:string,start:double,end:double,probability:double>>>>"


def collect_words(df: DataFrame, segments: str) -> DataFrame:
    """A recogniser's segments as words in order (pos, text, start_s, end_s, confidence): a segment's words, or the segment as one where it has none; blanks go."""
    whole = lambda s: F.array(F.struct(s["text"].alias("word"), s["start"].alias("start"), s["end"].alias("end"), F.lit(None).cast("double").alias("probability")))
    found = F.flatten(F.transform(segments, lambda s: F.when(F.coalesce(F.size(s["words"]), F.lit(0)) > 0, s["words"]).otherwise(whole(s))))
    spoken = F.filter(F.transform(found, lambda w: F.struct(F.trim(w["word"]).alias("text"), w["start"].alias("start_s"), w["end"].alias("end_s"), w["probability"].alias("confidence"))), lambda w: w["text"] != "")
    return df.select(*[c for c in df.columns if c != segments], F.posexplode(spoken).alias("pos", "_w")).select(*[c for c in df.columns if c != segments], "pos", "_w.*")


def vad_backend(wanted: str, available: bool) -> tuple[str, list[str]]:
    """Which detector runs, with warnings: 'auto' takes the model if it can run, else energy."""
    if wanted == "energy" or (wanted == "auto" and not available):
        return "energy", [] if wanted == "energy" else ["the speech model can't run; speech is found by energy"]
    if not available:
        from ..errors import BackendUnavailableError

        raise BackendUnavailableError(f"speech detector {wanted} can't run")
    return "silero", []


# ----------------------------------------------------------------- punctuation

CHUNK = 64


def chunked(words: DataFrame, pos: str, size: int = CHUNK) -> DataFrame:
    """Adds chunk: blocks of words that a punctuation model gets at once."""
    return words.withColumn("chunk", F.floor(F.col(pos) / size))


def _letters(text: str) -> list[str]:
    return [c for c in text.lower().replace("ё", "е") if c.isalnum()]


def align(words: list[str], punctuated: str) -> list[str] | None:
    """Words as a model punctuated them, or None if it changed any letter.

    Both sides are streams of letters. A word's piece is where its letters lie,
    with the marks that cling to it: up to the next blank on the right, and from
    the last blank on the left. Marks that stand free go to the word before; none
    is lost. A word without letters takes what lies between its neighbours.
    """
    owner = [i for i, w in enumerate(words) for _ in _letters(w)]
    places = [k for k, c in enumerate(punctuated) if c.isalnum()]
    heard = _letters("".join(words))
    if heard != _letters(punctuated) or len(places) != len(owner):
        return None
    spans: dict[int, list[int]] = {}
    for i, k in zip(owner, places, strict=True):
        spans.setdefault(i, [k, k])[1] = k
    spoken = sorted(spans)
    if not spoken:
        return list(words)
    begins = {}
    for a, b in zip([None, *spoken[:-1]], spoken, strict=True):
        lo, hi = (spans[a][1] + 1 if a is not None else 0), spans[b][0]
        gap = punctuated[lo:hi]
        blank = gap.rfind(" ")
        begins[b] = lo + blank + 1 if blank >= 0 or a is None else lo + _split_marks(gap)
        if a is None:
            begins[b] = 0
    out = list(words)
    for n, i in enumerate(spoken):
        end = begins[spoken[n + 1]] if n + 1 < len(spoken) else len(punctuated)
        out[i] = "".join(punctuated[begins[i] : end].split())
    return out


def _split_marks(gap: str) -> int:
    """In marks without a blank, where the next word's opening ones begin."""
    k = len(gap)
    while k and gap[k - 1] in "«\"'([":
        k -= 1
    return k


def restore_punctuation(words: DataFrame, keys: list[str], pos: str, text: str, punctuate, size: int = CHUNK) -> DataFrame:
    """words with punctuated text and applied (false where a chunk failed or changed letters, which leaves its words alone).

    punctuate: a picklable factory that makes a function from text to text; it
    runs once in each worker.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    lists = chunked(words, pos, size).groupBy(*keys, "chunk").agg(rows.alias("_l"))
    result = "array<struct<p:bigint,t:string,ok:boolean>>"

    @F.arrow_udf(result)
    def run(batch: pa.Array) -> pa.Array:
        model, out = punctuate(), []
        for row in batch.to_pylist():
            said = [x["t"] or "" for x in row]
            try:
                new = align(said, model(" ".join(said)))
            except Exception:  # a model's failure costs its chunk only
                new = None
            out.append([{"p": x["p"], "t": t, "ok": new is not None} for x, t in zip(row, new or said, strict=True)])
        return pa.array(out, pa.list_(pa.struct([("p", pa.int64()), ("t", pa.string()), ("ok", pa.bool_())])))

    made = lists.select(*keys, F.explode(run("_l")).alias("_r")).select(*keys, F.col("_r.p").alias(pos), F.col("_r.t").alias("punctuated"), F.col("_r.ok").alias("applied"))
    return words.join(made, [*keys, pos])


def failure_note(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, failed, note: 'none', 'partial' or 'total' failure of punctuation."""
    share = F.avg((~F.col("applied")).cast("int"))
    return words.groupBy(*keys).agg(F.count_if(~F.col("applied")).alias("failed"), F.when(share == 0, "none").when(share == 1, "total").otherwise("partial").alias("note"))
