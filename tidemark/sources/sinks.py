"""Writing transcripts: one UTF-8 file for each recording, with \\n line ends, byte for byte the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_transcripts(transcripts: DataFrame, path: str, key: str = "recording_id", text: str = "markdown") -> None:
    """A folder <path>/<key>=<value>/ with one text file each; Spark's commit protocol makes it whole or not at all."""
    lines = transcripts.select(key, F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n$", "").alias("value"))
    lines.repartition(key).write.mode("overwrite").partitionBy(key).text(path, lineSep="\n")


def stale(have: DataFrame, want: DataFrame, name: str) -> DataFrame:
    """Numbered slide pictures that no transcript refers to any more."""
    return have.where(F.col(name).rlike("(^|/)slide_[0-9]{3,}\\.png$")).join(want.select(name).distinct(), name, "left_anti")


def publish(spark, text: str, pictures: dict[str, str], folder: str, name: str = "transcript.md") -> list[str]:
    """One recording's transcript and slide pictures (name -> path) put into a folder; names of the numbered pictures removed there.

    The folder is on the driver's file system, as a user's is. Files are written
    beside their place and renamed; only slide pictures that the transcript no
    longer has are removed, whatever else a user keeps there stays.
    """
    import os
    import re
    import shutil

    def put(path, fill):
        with open(path + ".part", "wb") as f:
            fill(f)
        os.replace(path + ".part", path)

    os.makedirs(folder, exist_ok=True)
    put(os.path.join(folder, name), lambda f: f.write(text.replace("\r\n", "\n").replace("\r", "\n").encode()))
    images = os.path.join(folder, "slides")
    have = spark.createDataFrame([(x,) for x in sorted(os.listdir(images))] if os.path.isdir(images) else [], "name string")
    want = spark.createDataFrame([(x,) for x in pictures], "name string")
    gone = sorted(r["name"] for r in stale(have, want, "name").collect())
    for x in gone:
        os.remove(os.path.join(images, x))
    for x, path in pictures.items():
        if not re.fullmatch(r"slide_[0-9]{3,}\.png", x):
            raise ValueError(f"{x} is no name of a slide's picture")
        os.makedirs(images, exist_ok=True)
        with open(path, "rb") as source:
            put(os.path.join(images, x), lambda f, source=source: shutil.copyfileobj(source, f))
    return gone
