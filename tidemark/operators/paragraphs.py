"""Paragraphs and time codes: folds over a section's words that carry a few numbers and give positions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.text import capitalized, ends_sentence, joined_words
from .islands import ordered


@dataclass(frozen=True)
class ParagraphRules:
    """Seconds and words; scale the times if the columns hold another unit."""

    pause: float = 2.5
    soft_pause: float = 0.8
    least: float = 45.0
    most: float = 180.0
    least_words: int = 90
    most_words: int = 320
    hard: float = 1.5


def split(words: DataFrame, keys: list[str], pos: str, text: str, start: str, end: str, rules: ParagraphRules = ParagraphRules()) -> DataFrame:
    """words with paragraph, numbered from 0. Whether a paragraph ends depends on where it began, so one fold over a section's
    (start, pause, sentence end) finds the first words of paragraphs; it keeps three numbers and those positions."""
    w = ordered(keys, [pos])
    row = F.struct(F.col(pos).alias("p"), F.col(start).cast("double").alias("s"), F.lag(end).over(w).cast("double").alias("e"), ends_sentence(F.lag(text).over(w)).alias("stop"))
    listed = words.select(*keys, row.alias("_r")).groupBy(*keys).agg(F.array_sort(F.collect_list("_r")).alias("_rows"))
    zero = F.struct(F.lit(None).cast("double").alias("from"), F.lit(0).alias("n"), *folds.nothing("bigint"))

    def step(acc: Column, r: Column) -> Column:
        length, gap = r["e"] - acc["from"], r["s"] - r["e"]
        mature = (length >= rules.least) | (acc["n"] >= rules.least_words)
        overgrown = (length >= rules.most) | (acc["n"] >= rules.most_words)
        ends = (mature & (r["stop"] | (gap >= rules.pause))) | (overgrown & (gap >= rules.soft_pause)) | (length >= rules.most * rules.hard)
        new = acc["from"].isNull() | F.coalesce(ends, F.lit(False))
        return F.struct(F.when(new, r["s"]).otherwise(acc["from"]).alias("from"), F.when(new, 1).otherwise(acc["n"] + 1).alias("n"), *folds.added(acc, r["p"].cast("bigint"), new))

    firsts = listed.select(*keys, F.explode(F.aggregate("_rows", zero, step, folds.gathered)).alias(pos)).withColumn("_first", F.lit(1))
    marked = words.join(firsts, [*keys, pos], "left")
    n = F.count("_first").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    return marked.withColumn("paragraph", n).drop("_first")


def texts(words: DataFrame, keys: list[str], pos: str, text: str, start: str) -> DataFrame:
    """keys, paragraph, start, text: words of a paragraph as running text with capitals."""
    rows = F.array_sort(F.collect_list(F.struct(pos, text)))
    out = words.groupBy(*keys, "paragraph").agg(F.min_by(start, pos).alias("start"), rows.alias("_w"))
    return out.select(*keys, "paragraph", "start", capitalized(joined_words(F.col("_w")[text])).alias("text"))


def timecodes(paragraphs: DataFrame, keys: list[str], order: str, start: str, anchor: str, every) -> DataFrame:
    """Adds timecode (true where one is shown): a paragraph that begins `every` or more after the last shown one, or after the
    section's start (anchor). Each shown one resets the count, so one fold finds them."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(start).alias("s"))))
    listed = paragraphs.groupBy(*keys).agg(rows.alias("_rows"), F.min(anchor).alias("_a"))
    kind = dict(paragraphs.dtypes)[order]
    zero = F.struct(F.col("_a").cast("double").alias("last"), *folds.nothing(kind))

    def step(acc: Column, r: Column) -> Column:
        due = r["s"] - acc["last"] >= every
        return F.struct(F.when(due, r["s"].cast("double")).otherwise(acc["last"]).alias("last"), *folds.added(acc, r["o"], due))

    shown = listed.select(*keys, F.explode(F.aggregate("_rows", zero, step, folds.gathered)).alias(order)).withColumn("_t", F.lit(True))
    return paragraphs.join(shown, [*keys, order], "left").withColumn("timecode", F.coalesce("_t", F.lit(False))).drop("_t")
