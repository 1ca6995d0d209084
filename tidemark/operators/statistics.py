"""Robust statistics: pixels, energy, sampling of words over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns a median absolute deviation into a standard deviation of normal data.
MAD_SIGMA = 1.4826


def pixel_stats(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys with median, spread (scaled median absolute deviation), mean and population variance, all exact.

    Two aggregates over one exchange: the median is joined back by a window, so
    the deviation needs no second shuffle.
    """
    v = F.col(value).cast("double")
    with_median = pixels.select(*keys, v.alias("_v")).withColumn("_m", F.percentile("_v", 0.5).over(Window.partitionBy(*keys)))
    return with_median.groupBy(*keys).agg(
        F.first("_m").alias("median"), (F.percentile(F.abs(F.col("_v") - F.col("_m")), 0.5) * MAD_SIGMA).alias("spread"),
        F.avg("_v").alias("mean"), F.var_pop("_v").alias("variance"), F.count("*").alias("n"),
    )


def static_and_bright(spread: Column, brightness: Column, max_spread: float = 8.0, min_brightness: float = 150.0) -> Column:
    return (spread <= max_spread) & (brightness >= min_brightness)


def energy(samples: DataFrame, keys: list[str], index: str, value: str, frame: int) -> DataFrame:
    """keys, frame, dbfs: root-mean-square level of each whole frame of samples; an unfinished last frame is left out."""
    of = F.floor(F.col(index) / F.lit(frame)).alias("frame")
    rms = F.sqrt(F.avg(F.col(value) * F.col(value)))
    out = samples.groupBy(*keys, of).agg((F.lit(20.0) * F.log10(F.greatest(rms, F.lit(1e-12)))).alias("dbfs"), F.count("*").alias("_n"))
    return out.where(F.col("_n") == frame).drop("_n")


def speech_mask(levels: DataFrame, keys: list[str], floor: float = -45.0, relative: float = -30.0) -> DataFrame:
    """Adds threshold (the greater of floor and peak + relative) and speech."""
    peak = F.max("dbfs").over(Window.partitionBy(*keys))
    return levels.withColumn("threshold", F.greatest(F.lit(floor), peak + relative)).withColumn("speech", F.col("dbfs") >= F.col("threshold"))


def distribute(words: DataFrame, keys: list[str], pos: str, text: str, duration: Column) -> DataFrame:
    """Adds start and end: the duration dealt to words in order, in proportion to their lengths (1 at least)."""
    weight = F.greatest(F.lit(1), F.length(text))
    w = Window.partitionBy(*keys).orderBy(pos)
    df = words.withColumn("_w", weight).withColumn("_t", F.sum("_w").over(Window.partitionBy(*keys))).withColumn("_c", F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    end = F.least(duration, F.col("_c") / F.col("_t") * duration)
    start = F.least(duration, (F.col("_c") - F.col("_w")) / F.col("_t") * duration)
    return df.withColumn("start", start).withColumn("end", end).drop("_w", "_t", "_c")


def dominant_size(frames: DataFrame, keys: list[str], index: str, width: str = "width", height: str = "height") -> DataFrame:
    """keys with the most frequent frame size; a tie goes to the size seen first."""
    sizes = frames.groupBy(*keys, width, height).agg(F.count("*").alias("_n"), F.min(index).alias("_i"))
    return sizes.groupBy(*keys).agg(F.max_by(F.struct(width, height), F.struct("_n", -F.col("_i"))).alias("size"))


def prompt_budget(terms: DataFrame, keys: list[str], rank: str, term: str, budget: int = 800) -> DataFrame:
    """Terms in rank order while the sum of length + 2 stays within the budget; the first that doesn't fit ends the list."""
    some = terms.where(F.length(F.trim(term)) > 0)
    w = Window.partitionBy(*keys).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return some.withColumn("used", F.sum(F.length(term) + 2).over(w)).where(F.col("used") <= budget)


def prompt(terms: DataFrame, keys: list[str], rank: str, term: str) -> DataFrame:
    """keys, prompt: chosen terms joined in rank order."""
    rows = F.array_sort(F.collect_list(F.struct(rank, term)))
    return terms.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r[term]), ", ").alias("prompt"))
