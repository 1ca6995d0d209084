"""Runs, smoothing and grouping of ordered records (gaps and islands).

Every operator takes the columns that part the records (keys) and those that
order them, and uses windows over that one partitioning, so a chain of them
shares one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def upto(keys: list[str], order: list[str]) -> WindowSpec:
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def number_breaks(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str) -> DataFrame:
    """Adds name: how many breaks there are up to the row, counted from 0 at the first row."""
    w = ordered(keys, order)
    flag = F.when(F.row_number().over(w) == 1, 0).when(breaks, 1).otherwise(0)
    return df.withColumn("_b", flag).withColumn(name, F.sum("_b").over(upto(keys, order))).drop("_b")


def runs(df: DataFrame, keys: list[str], order: list[str], label: str, name: str = "run_id") -> DataFrame:
    """Adds the number of the run of equal labels; null equals null."""
    before = F.lag(label).over(ordered(keys, order))
    return number_breaks(df, keys, order, ~F.col(label).eqNullSafe(before), name)


def run_table(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """One row for each run: run_id, label, n and the first row's order columns as first_<name>."""
    found = runs(df, keys, order, label)
    first = [F.min(F.struct(*order))[c].alias(f"first_{c}") for c in order]
    return found.groupBy(*keys, "run_id", label).agg(F.count("*").alias("n"), *first)


def sessions(df: DataFrame, keys: list[str], order: list[str], time: str, gap, name: str = "session_id") -> DataFrame:
    """Adds session numbers: a new one where the time since the row before is at least gap (a shorter gap merges)."""
    since = F.col(time) - F.lag(time).over(ordered(keys, order))
    return number_breaks(df, keys, order, since >= gap, name)


def mask_intervals(df: DataFrame, keys: list[str], index: str, flag: str, step) -> DataFrame:
    """Intervals of the true runs of a frame mask: [first * step, (last + 1) * step)."""
    found = runs(df, keys, [index], flag).where(F.col(flag))
    spans = found.groupBy(*keys, "run_id").agg(F.min(index).alias("_a"), F.max(index).alias("_b"))
    return spans.select(*keys, (F.col("_a") * step).alias("start"), ((F.col("_b") + 1) * step).alias("end"))


def smooth_presence(df: DataFrame, keys: list[str], order: list[str], flag: str, step: float, min_absence: float, name: str = "smoothed") -> DataFrame:
    """Presence without noise: true runs of at most two steps become false; then false runs shorter than min_absence that
    lie between true ones become true. A run's length is its count of rows times step."""
    by_run = Window.partitionBy(*keys, "_r")
    one = runs(df.withColumn("_f", F.col(flag)), keys, order, "_f", "_r")
    one = one.withColumn("_n", F.count("*").over(by_run) * F.lit(step))
    two = one.withColumn("_f", F.col("_f") & (F.col("_n") > 2 * step)).drop("_r", "_n")
    two = runs(two, keys, order, "_f", "_r").withColumn("_n", F.count("*").over(by_run) * F.lit(step))
    two = two.withColumn("_last", F.max("_r").over(Window.partitionBy(*keys)))
    inner = ~F.col("_f") & (F.col("_r") > 0) & (F.col("_r") < F.col("_last")) & (F.col("_n") < min_absence)
    return two.withColumn(name, F.col("_f") | inner).drop("_f", "_r", "_n", "_last")


def frame_groups(df: DataFrame, keys: list[str], order: list[str], time: str, hash_column: str, step, min_absence, threshold: int, name: str = "group_id") -> DataFrame:
    """Numbers groups of near-equal frames: a new one after a gap (over 1.5 steps, and absent for min_absence at least) or
    where the hash (one bigint, or an array of them) differs in threshold bits or more from the frame before."""
    w = ordered(keys, order)
    gap = F.col(time) - F.lag(time).over(w)
    before = F.lag(hash_column).over(w)
    broken = ((gap > 1.5 * step) & (gap - step >= min_absence)) | (hamming(F.col(hash_column), before, df.schema[hash_column].dataType.typeName()) >= threshold)
    return number_breaks(df, keys, order, F.coalesce(broken, F.lit(False)), name)


def hamming(a: Column, b: Column, kind: str = "long") -> Column:
    """Bits in which two hashes differ."""
    if kind == "array":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return F.bit_count(a.bitwiseXOR(b))


def group_table(df: DataFrame, keys: list[str], group: str, time: str, ident: str, step) -> DataFrame:
    """One row for each frame group: start, end (last time + step), representative (the last frame) and n."""
    out = df.groupBy(*keys, group).agg(F.min(time).alias("start"), (F.max(time) + step).alias("end"), F.max_by(ident, time).alias("representative"), F.count("*").alias("n"))
    return out


def long_groups(groups: DataFrame, least) -> DataFrame:
    """Groups of at least this length."""
    return groups.where(F.col("end") - F.col("start") >= least)


def merge_short_pieces(df: DataFrame, keys: list[str], order: list[str], length: str, least, name: str = "piece_id") -> DataFrame:
    """Numbers merged pieces: one shorter than least joins the piece before; short leading ones join the first long one,
    unless together they reach least themselves."""
    w = ordered(keys, order)
    long_ = (F.col(length) >= least).cast("int")
    df = df.withColumn("_g", F.sum(long_).over(upto(keys, order)))
    lead = Window.partitionBy(*keys)
    df = df.withColumn("_lead", F.sum(F.when(F.col("_g") == 0, F.col(length)).otherwise(F.lit(0))).over(lead))
    df = df.withColumn("_has0", F.max((F.col("_g") == 0).cast("int")).over(lead)).withColumn("_max", F.max("_g").over(lead))
    merged = (F.col("_has0") == 1) & (F.col("_lead") < least) & (F.col("_max") >= 1)
    number = F.when(merged, F.greatest(F.col("_g"), F.lit(1)) - 1).when(F.col("_has0") == 1, F.col("_g")).otherwise(F.col("_g") - 1)
    return df.withColumn(name, number).drop("_g", "_lead", "_has0", "_max")


def cover(df: DataFrame, keys: list[str], start: str, last_end: str) -> DataFrame:
    """Adds end: the next piece's start, for the last piece the record's end."""
    return df.withColumn("end", F.coalesce(F.lead(start).over(ordered(keys, [start])), F.col(last_end)))


def uniform_sample(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """At most n rows of each key, evenly spread: positions round-half-even of k * (count - 1) / (n - 1), each once."""
    w = ordered(keys, order)
    placed = df.withColumn("_pos", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    # position p is chosen if one of the k around p * (n - 1) / (count - 1) rounds to it
    k = F.col("_pos") * F.lit(n - 1.0) / (F.col("_n") - 1)
    at = lambda j: (j >= 0) & (j <= n - 1) & (F.bround(j * ((F.col("_n") - 1) / F.lit(n - 1.0))) == F.col("_pos"))
    chosen = (F.col("_n") <= n) | at(F.floor(k) - 1) | at(F.floor(k)) | at(F.floor(k) + 1) | at(F.floor(k) + 2)
    if n == 1:
        chosen = F.col("_pos") == 0
    return placed.where(chosen).drop("_pos", "_n")
