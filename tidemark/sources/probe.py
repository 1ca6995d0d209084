"""Media descriptions from probe output (JSON), as column expressions and a reader of media folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MissingAudioError

PROBE = (
    "format struct<duration:string,format_name:string>,"
    " streams array<struct<index:int,codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,duration:string,"
    "sample_rate:string,channels:int,tags:map<string,string>,disposition:struct<attached_pic:int>>>"
)


def number(c: Column) -> Column:
    """A positive number, else null."""
    n = c.try_cast("double")
    return F.when(n > 0, n)


def rate(c: Column) -> Column:
    """A frame rate given as a fraction or number; 0.0 if it is neither."""
    parts = F.split(c, "/")
    n, d = F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double")
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def tag(tags: Column, name: str) -> Column:
    """A tag by its name in any case; blank is null."""
    found = F.map_values(F.map_filter(tags, lambda k, _: F.lower(k) == name))
    return F.nullif(F.trim(F.get(found, F.lit(0))), F.lit(""))


def parse(df: DataFrame, json: str) -> DataFrame:
    """df with duration_s, audio_tracks, video (null without one) and readable (false: no streams).

    The container's duration counts, else the longest stream's. Covers are no
    video; the first video stream wins.
    """
    p = F.from_json(F.col(json), PROBE)
    df = df.withColumn("_p", p)
    streams = F.filter(F.coalesce(F.col("_p.streams"), F.array().cast(df.schema["_p"].dataType["streams"].dataType)), lambda s: F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0)
    longest = F.array_max(F.transform(F.col("_p.streams"), lambda s: number(s["duration"])))
    video = F.get(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(0))
    fps = F.when(rate(video["avg_frame_rate"]) > 0, rate(video["avg_frame_rate"])).otherwise(rate(video["r_frame_rate"]))
    audio = F.transform(F.filter(streams, lambda s: s["codec_type"] == "audio"), lambda s: F.struct(
        s["index"].alias("index"), s["codec_name"].alias("codec"), s["sample_rate"].try_cast("int").alias("sample_rate"), s["channels"].alias("channels"),
        tag(s["tags"], "language").alias("language"), tag(s["tags"], "title").alias("title")))
    seen = F.struct(video["index"].alias("index"), video["codec_name"].alias("codec"), video["width"].alias("width"), video["height"].alias("height"), fps.alias("fps"))
    return df.select(*[c for c in df.columns if c != "_p"], F.coalesce(number(F.col("_p.format.duration")), longest).alias("duration_s"), audio.alias("audio_tracks"), F.when(video.isNotNull(), seen).alias("video"), (F.size(streams) > 0).alias("readable"))


def select_track(media: DataFrame, index: int | None = None) -> DataFrame:
    """Adds track: the audio track with this stream index, or the first; null where there is none."""
    tracks = F.col("audio_tracks")
    found = F.get(tracks if index is None else F.filter(tracks, lambda t: t["index"] == index), F.lit(0))
    return media.withColumn("track", found)


def source_size(video: Column) -> Column:
    """(width, height) of a recording's video; null where it has none or the probe doesn't tell."""
    return F.when((video["width"] > 0) & (video["height"] > 0), F.struct(video["width"].alias("width"), video["height"].alias("height")))


def source_width(video: Column) -> Column:
    return source_size(video)["width"]


def require_track(media: DataFrame, index: int | None = None) -> DataFrame:
    """select_track, which fails where a recording lacks the track."""
    chosen = select_track(media, index)
    lacking = chosen.where(F.col("track").isNull()).select(F.transform("audio_tracks", lambda t: t["index"]).alias("have")).limit(1).collect()
    if lacking:
        raise MissingAudioError(f"no audio track {index if index is not None else ''}; there are {list(lacking[0]['have'])}")
    return chosen


def short_audio(audio: DataFrame, media: DataFrame, key: str, slack: float = 0.25) -> DataFrame:
    """Recordings whose audio ends more than slack before the container does."""
    m = media.select(key, F.col("duration_s").alias("_m"))
    return audio.join(m, key).where(F.col("_m") - F.col("duration_s") > slack).drop("_m")


def frame_times(media: DataFrame, key: str, fps: float) -> DataFrame:
    """key, idx, ts: the grid of frames at a fixed rate."""
    n = F.floor(F.col("duration_s") * fps).cast("int")
    return media.where(n > 0).select(key, F.explode(F.sequence(F.lit(0), n - 1)).alias("idx")).withColumn("ts", F.col("idx") / F.lit(fps))


def picture_frames(files: DataFrame, key: str, path: str, fps: float) -> DataFrame:
    """key, idx, ts, path: pictures of a folder, in the order of their paths."""
    from ..operators.islands import ordered

    idx = (F.row_number().over(ordered([key], [path])) - 1).cast("int")
    return files.select(key, path, idx.alias("idx")).withColumn("ts", F.col("idx") / F.lit(fps))
