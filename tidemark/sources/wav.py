"""Wave audio as blocks of samples: a Python data source and a writer for fixtures."""

from __future__ import annotations

import io
import wave

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import UnreadableAudioError

BLOCK_SECONDS = 0.03


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """(samples in [-1, 1], rate): PCM of 8, 16 or 32 bits, channels averaged."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError) as e:
        raise UnreadableAudioError(str(e)) from e
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
    elif width == 4:
        x = (np.frombuffer(raw, "<i4").astype(np.float64) / 2147483648).astype(np.float32)
    else:
        raise UnreadableAudioError(f"{8 * width}-bit samples can't be read")
    return (x.reshape(-1, channels).mean(axis=1) if channels > 1 else x), rate


def encode(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono; samples beyond [-1, 1] are clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def duration(data: bytes) -> float:
    with wave.open(io.BytesIO(data)) as w:
        return w.getnframes() / w.getframerate()


BLOCKS = "recording_id string, block bigint, rate int, samples array<float>"


def blocks(files: DataFrame, block_seconds: float = BLOCK_SECONDS) -> DataFrame:
    """Blocks of samples of binary files (path, content), read where the file is: no file travels to the driver."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                x, rate = decode(content)
                n = max(1, int(round(block_seconds * rate)))
                cut = [x[k : k + n] for k in range(0, len(x), n)]
                yield pd.DataFrame({"recording_id": path, "block": range(len(cut)), "rate": rate, "samples": cut})

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def read(spark: SparkSession, path: str, block_seconds: float = BLOCK_SECONDS) -> DataFrame:
    return blocks(spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path), block_seconds)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.seconds = options["path"], float(options.get("blockseconds", BLOCK_SECONDS))

    def partitions(self):
        import glob
        import os

        return [_File(p) for p in sorted(glob.glob(os.path.join(self.path, "*.wav")))] or [_File("")]

    def read(self, part):
        if not part.path:
            return
        with open(part.path, "rb") as f:
            x, rate = decode(f.read())
        n = max(1, int(round(self.seconds * rate)))
        for i, k in enumerate(range(0, len(x), n)):
            yield part.path, i, rate, x[k : k + n].tolist()


class WavSource(DataSource):
    """spark.read.format("wav"): for folders that all machines mount; `read` above takes any file system of Spark's."""

    @classmethod
    def name(cls):
        return "wav"

    def schema(self):
        return BLOCKS

    def reader(self, schema):
        return _Reader(self.options)


def sample_rows(found: DataFrame) -> DataFrame:
    """recording_id, i, x: single samples, for small inputs."""
    return found.select("recording_id", F.posexplode("samples").alias("_i", "x"), "block", F.size("samples").alias("_n")).select("recording_id", (F.col("block") * F.max("_n").over(_by()) + F.col("_i")).alias("i"), "x")


def _by():
    from pyspark.sql import Window

    return Window.partitionBy("recording_id")
