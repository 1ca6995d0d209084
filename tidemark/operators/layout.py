"""Layout of a recording: stretches with and without a shown slide, and the region of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals, islands
from .stages import staged


def layout_intervals(frames: DataFrame, key: str, idx: str, ts: str, present: str, region: str, step: float, min_absence: float, least: float, stable: float = 0.75) -> DataFrame:
    """key, piece, start, end, present, region: covers each recording without gaps.

    Presence is smoothed; a shown stretch is split where its region changes,
    pieces shorter than least join a neighbour of the same stretch, and a piece's
    region is the union of its frames' regions.
    """
    f = islands.smooth_presence(frames, [key], [idx], present, step, min_absence)
    f = staged(islands.runs(f, [key], [idx], "smoothed", "_run"), "presence-runs")
    parts = intervals.split_by_region(f.where("smoothed"), [key, "_run"], [idx], region, stable, "_part")
    lengths = parts.groupBy(key, "_run", "_part").agg((F.count("*") * F.lit(step)).alias("_len"))
    joined = islands.merge_short_pieces(lengths, [key, "_run"], ["_part"], "_len", least, "_piece").select(key, "_run", "_part", "_piece")
    shown = parts.join(joined, [key, "_run", "_part"]).drop("_part")
    pieces = shown.unionByName(f.where("not smoothed").withColumn("_piece", F.lit(0).cast("long")))
    r = F.when(F.col("smoothed"), F.col(region))
    box = pieces.withColumn("_r", r).groupBy(key, "_run", "_piece").agg(F.min(ts).alias("start"), F.max("smoothed").alias("present"), intervals.union_rect("_r").alias("_box"), F.max(F.col("_r").isNotNull()).alias("_any"))
    end = f.groupBy(key).agg((F.max(ts) + F.lit(step)).alias("_last"))
    w = Window.partitionBy(key).orderBy("start")
    out = islands.cover(box.join(end, key), [key], "start", "_last").withColumn("piece", F.row_number().over(w) - 1)
    return out.select(key, "piece", "start", "end", "present", F.when(F.col("_any"), F.col("_box")).alias("region"))


def groups_of_layout(frames: DataFrame, found: DataFrame, key: str, idx: str, ts: str, hash_column: str, step: float, min_absence: float, threshold: int = 43, min_group: float = 0.0) -> DataFrame:
    """key, piece, group_id, start, end, representative, n: near-equal frames of each shown piece."""
    inside = intervals.within(frames, found.where("present"), key, ts, "start", "end", "piece")
    g = islands.frame_groups(inside, [key, "piece"], [idx], ts, hash_column, step, min_absence, threshold)
    return islands.long_groups(islands.group_table(g, [key, "piece"], "group_id", ts, idx, step), min_group)


def number_slides(groups: DataFrame, key: str) -> DataFrame:
    """Adds slide_index (from 1, by start, then end) and representative_s halfway."""
    w = Window.partitionBy(key).orderBy("start", "end")
    return groups.withColumn("slide_index", F.row_number().over(w)).withColumn("representative_s", (F.col("start") + F.col("end")) / 2)
