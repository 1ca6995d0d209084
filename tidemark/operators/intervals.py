"""Interval algebra: overlap joins, merging, padding, rectangles, tiling, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import number_breaks, ordered, upto


def merge(df: DataFrame, keys: list[str], start: str, end: str, gap, touching: bool = False) -> DataFrame:
    """Merge intervals whose gap to all before is smaller than gap (or equal, if touching)."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    since = F.col(start) - F.col("_reach")
    broken = (since > gap) if touching else (since >= gap)
    df = df.select(*keys, start, end).withColumn("_reach", F.max(end).over(w))
    found = number_breaks(df, keys, [start, end], broken, "_g")
    return found.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def merge_and_pad(df: DataFrame, keys: list[str], start: str, end: str, min_silence, min_speech, pad, duration: Column | None = None) -> DataFrame:
    """Speech intervals: merge over gaps shorter than min_silence, drop those shorter than min_speech, pad both ends within
    [0, duration], and merge what then touches or overlaps."""
    one = merge(df, keys, start, end, min_silence).where(F.col(end) - F.col(start) >= min_speech)
    low = F.greatest(F.lit(0).cast(df.schema[start].dataType), F.col(start) - pad)
    high = F.col(end) + pad
    padded = one.select(*keys, low.alias(start), (high if duration is None else F.least(duration, high)).alias(end))
    return merge(padded, keys, start, end, 0, touching=True)


def overlap_labels(points: DataFrame, spans: DataFrame, key: str, index: str, start: str = "start", end: str = "end", pos: str = "pos", bucket=None) -> DataFrame:
    """points (key, pos, start, end, ...) with the index of the span each belongs to, or null.

    The longest overlap wins, then the smaller index; a point without length
    belongs to the span it is in (half-open first, then the one it ends). The
    join is by key and, if bucket is given, by time bucket, so it never compares
    all points of a recording with all its spans; there is no range join in
    Catalyst that would do so by itself.
    """
    s = spans.select(F.col(key).alias("_k"), F.col(index).alias("_i"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    p = points
    on = [F.col(key) == F.col("_k")]
    if bucket is not None:
        number = lambda c: F.floor(c / F.lit(bucket)).cast("long")
        s = s.withColumn("_bucket", F.explode(F.sequence(number(F.col("_s")), number(F.col("_e")))))
        p = p.withColumn("_pb", F.explode(F.sequence(number(F.col(start)), F.greatest(number(F.col(start)), number(F.col(end))))))
        on.append(F.col("_pb") == F.col("_bucket"))
    is_point = F.col(end) <= F.col(start)
    over = F.least(F.col(end), F.col("_e")) - F.greatest(F.col(start), F.col("_s"))
    near = (~is_point & (over > 0)) | (is_point & (F.col("_s") <= F.col(start)) & (F.col(start) <= F.col("_e")))
    rank = F.struct(F.when(is_point, F.when(F.col(start) < F.col("_e"), 0).otherwise(1)).otherwise(0).alias("closed"), F.when(is_point, F.lit(0)).otherwise(-over).alias("less"), F.col("_i").alias("i"))
    best = p.join(s, on).where(near).groupBy(key, pos).agg(F.min(rank).alias("_b"))
    best = best.select(F.col(key).alias("_k"), F.col(pos).alias("_p"), F.col("_b.i").alias(index))
    return points.join(best, (F.col(key) == F.col("_k")) & (F.col(pos) == F.col("_p")), "left").drop("_k", "_p")


def within(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, *values: str, closed: bool = False) -> DataFrame:
    """points that lie in a span of their key, with the span's values; spans of a key don't overlap, and start is of at's type.

    Spans are laid among the points by time, and each point looks back to the
    last one: one window instead of a join of all points with all spans of a key.
    A span that is not closed leaves its end out.
    """
    some = F.col(end) >= F.col(start) if closed else F.col(end) > F.col(start)
    marks = spans.where(some).select(key, F.col(start).alias(at), F.struct(F.col(end).alias("_end"), *values).alias("_span"), F.lit(0).alias("_kind"))
    rows = points.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("_span", F.last("_span", ignorenulls=True).over(w)).where("_kind = 1")
    inside = F.col(at) <= F.col("_span._end") if closed else F.col(at) < F.col("_span._end")
    return seen.where(inside).select(*points.columns, *[F.col("_span")[v].alias(v) for v in values])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two rectangles (x, y, width, height); 0 if they don't meet or only touch."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    both = (w * h).cast("double")
    return F.when((w > 0) & (h > 0), both / (a["width"] * a["height"] + b["width"] * b["height"] - both)).otherwise(F.lit(0.0))


def split_by_region(df: DataFrame, keys: list[str], order: list[str], rect: str, least: float = 0.75, name: str = "piece_id") -> DataFrame:
    """Numbers pieces: cut where the region's overlap with the one before is under least, or one of the two is null."""
    before = F.lag(rect).over(ordered(keys, order))
    cut = F.when(F.col(rect).isNull() & before.isNull(), F.lit(False)).when(F.col(rect).isNull() | before.isNull(), F.lit(True)).otherwise(iou(F.col(rect), before) < least)
    return number_breaks(df, keys, order, cut, name)


def union_rect(rect: str) -> Column:
    """Aggregate: the bounding box of rectangles."""
    r = F.col(rect)
    x, y = F.min(r["x"]), F.min(r["y"])
    return F.struct(x.alias("x"), y.alias("y"), (F.max(r["x"] + r["width"]) - x).alias("width"), (F.max(r["y"] + r["height"]) - y).alias("height"))


def scale_rect(rect: Column, x: float, y: float) -> Column:
    """Scaled with half-to-even rounding; sides at least 1."""
    n = lambda c, f: F.bround(c * F.lit(f)).cast("int")
    return F.struct(n(rect["x"], x).alias("x"), n(rect["y"], y).alias("y"), F.greatest(F.lit(1), n(rect["width"], x)).alias("width"), F.greatest(F.lit(1), n(rect["height"], y)).alias("height"))


def clamp_rect(rect: Column, width: Column, height: Column) -> Column:
    """The part of a rectangle inside a frame, at least one pixel."""
    x = F.least(F.greatest(rect["x"], F.lit(0)), width - 1)
    y = F.least(F.greatest(rect["y"], F.lit(0)), height - 1)
    return F.struct(x.alias("x"), y.alias("y"), F.greatest(F.lit(1), F.least(rect["width"], width - x)).alias("width"), F.greatest(F.lit(1), F.least(rect["height"], height - y)).alias("height"))


def median_step(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """keys, step: the median time between neighbours; 1 where that isn't positive."""
    since = df.select(*keys, (F.col(time) - F.lag(time).over(ordered(keys, [time]))).alias("_d"))
    mid = F.percentile("_d", 0.5)
    return since.groupBy(*keys).agg(F.when(mid > 0, mid).otherwise(F.lit(1.0)).alias("step"))


def tile(df: DataFrame, keys: list[str], time: str, window) -> DataFrame:
    """keys, tile, n: rows in each of the windows of fixed length from the first time on; empty windows have 0."""
    bounds = df.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_z"))
    every = bounds.select(*keys, "_a", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_z") - F.col("_a")) / F.lit(window)))).alias("tile"))
    first = F.min(time).over(Window.partitionBy(*keys))
    counts = df.withColumn("tile", F.floor((F.col(time) - first) / F.lit(window))).groupBy(*keys, "tile").agg(F.count("*").alias("n"))
    return every.join(counts, [*keys, "tile"], "left").select(*keys, "tile", F.coalesce("n", F.lit(0)).alias("n"))


def to_absolute(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Times in a piece as times in the recording: shifted, kept within the piece, never running backwards."""
    a = F.least(F.greatest(low + start, low), high)
    return a, F.greatest(a, F.least(F.greatest(low + end, low), high))


def validate_intervals(df: DataFrame, keys: list[str], index: str, start: str, end: str) -> DataFrame:
    """keys with n, gaps in numbering, overlaps and intervals without length."""
    w = ordered(keys, [start, index])
    before = df.withColumn("_n", F.row_number().over(w)).withColumn("_e", F.lag(end).over(w)).withColumn("_i", F.lag(index).over(w))
    return before.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("_i").isNotNull() & (F.col(index) != F.col("_i") + 1)).alias("numbering_gaps"),
        F.count_if(F.col(start) < F.col("_e")).alias("overlaps"), F.count_if(F.col(end) <= F.col(start)).alias("empty"),
    )


def validate_words(df: DataFrame, keys: list[str], pos: str, start: str, end: str, duration: Column | None = None, slack: float = 0.05) -> DataFrame:
    """keys with n, backward (start before the one before), reversed (end before start), early, late and zero_length counts."""
    before = df.withColumn("_s", F.lag(start).over(ordered(keys, [pos])))
    late = F.lit(False) if duration is None else F.col(end) > duration + slack
    return before.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col(start) < F.col("_s")).alias("backward"), F.count_if(F.col(end) < F.col(start)).alias("reversed"),
        F.count_if(F.col(start) < -slack).alias("early"), F.count_if(late).alias("late"), F.count_if(F.col(end) == F.col(start)).alias("zero_length"),
    )


def running_end(df: DataFrame, keys: list[str], order: list[str], end: str) -> DataFrame:
    """Adds reach: the largest end so far."""
    return df.withColumn("reach", F.max(end).over(upto(keys, order)))
