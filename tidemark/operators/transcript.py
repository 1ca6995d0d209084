"""From words and slides to sections: labels, boundary shifts, sections, consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.text import ends_sentence
from .islands import number_breaks, ordered, runs


def phrase_boundaries(words: DataFrame, key: str, pos: str, text: str, start: str, end: str, gap) -> DataFrame:
    """Adds boundary: speech may be cut before the word, after a pause of gap or a sentence's end; never before the first."""
    w = ordered([key], [pos])
    pause = F.col(start) - F.lag(end).over(w) >= gap
    return words.withColumn("boundary", F.coalesce(pause | ends_sentence(F.lag(text).over(w)), F.lit(False)))


def shift_boundaries(words: DataFrame, key: str, pos: str, start: str, label: str, tolerance) -> DataFrame:
    """words (with label and boundary; pos from 0 without gaps) with section_label: label runs whose cuts have moved to the
    nearest phrase boundary within tolerance, ties to the earlier; each run keeps a word.

    Each cut's candidates come from a join by recording and stretch of time; the
    choice depends on the cut before, so one fold over a recording's cuts makes it.
    """
    r = runs(words, [key], [pos], label, "_run")
    cuts = r.groupBy(key, "_run").agg(F.min(pos).alias("_cut"), F.min_by(start, pos).alias("_t"), F.first(label).alias("_label"), F.max(pos).alias("_end"))
    w = ordered([key], ["_cut"])
    cuts = cuts.withColumn("_high", F.coalesce(F.lead("_cut").over(w), F.max("_end").over(Window.partitionBy(key)) + 1) - 1)
    # within tolerance is within half a stretch: a boundary lies in the cut's stretch or beside it
    stretch = lambda c: F.floor(F.col(c) / F.lit(2.0 * tolerance or 1.0)).cast("long")
    b = words.where("boundary").select(F.col(key).alias("_k"), F.col(pos).alias("_p"), F.col(start).alias("_s"), stretch(start).alias("_at"))
    moved = cuts.where("_run > 0").withColumn("_b", F.explode_outer(F.sequence(stretch("_t") - 1, stretch("_t") + 1)))
    near = moved.join(b, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_at")) & (F.abs(F.col("_s") - F.col("_t")) <= tolerance) & (F.col("_p") <= F.col("_high")), "left")
    some = F.array_sort(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct(F.abs(F.col("_s") - F.col("_t")).alias("d"), F.col("_p").alias("p")))))
    listed = near.groupBy(key, "_run", "_cut", "_high").agg(some.alias("_near"))
    rows = listed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_run", "_cut", "_high", "_near"))).alias("_rows"))
    first = F.struct(F.lit(0).cast("long").alias("last"), *folds.nothing("bigint"))

    def step(acc: Column, c: Column) -> Column:
        fits = F.filter(c["_near"], lambda n: (n["p"] > acc["last"]) & (n["p"] <= c["_high"]))
        new = F.coalesce(F.get(fits, F.lit(0))["p"], c["_cut"]).cast("long")
        return F.struct(new.alias("last"), *folds.added(acc, new))

    shifted = rows.select(key, F.posexplode(F.aggregate("_rows", first, step, folds.gathered)).alias("_n", "_cut")).select(key, (F.col("_n") + 1).alias("_run"), "_cut")
    labels = cuts.select(key, "_run", F.col("_label").alias("section_label"))
    begins = shifted.select(F.col(key).alias("_k"), F.col("_cut").alias("_p"))
    marked = words.join(begins, (F.col(key) == F.col("_k")) & (F.col(pos) == F.col("_p")), "left")
    marked = marked.withColumn("_run", F.count("_p").over(ordered([key], [pos]).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.drop("_k", "_p").join(labels, [key, "_run"]).withColumnRenamed("_run", "run")


def sections(words: DataFrame, slides: DataFrame, key: str, pos: str, start: str, end: str, label: str, run: str, index: str, s0: str, s1: str) -> DataFrame:
    """One row for each section: section_pos, slide (null: speech off slides), start, end, first_word, last_word (null: a silent slide).

    Runs keep their order: a run's time is the latest so far. Silent slides are
    set among them by their start, before a run of the same time.
    """
    spoken = words.groupBy(key, run).agg(F.min(pos).alias("first_word"), F.max(pos).alias("last_word"), F.first(label).alias("slide"), F.min_by(start, pos).alias("_ws"), F.max_by(end, pos).alias("_we"))
    s = slides.select(F.col(key).alias("_k"), F.col(index).alias("_i"), F.col(s0).alias("_s0"), F.col(s1).alias("_s1"))
    with_slide = spoken.join(s, (F.col(key) == F.col("_k")) & (F.col("slide") == F.col("_i")), "left")
    own = F.coalesce("_s0", "_ws")
    late = F.max(own).over(ordered([key], ["first_word"]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    a = with_slide.select(key, "slide", own.alias("start"), F.coalesce("_s1", "_we").alias("end"), "first_word", "last_word", late.alias("_t"), F.lit(1).alias("_kind"), F.col("first_word").cast("long").alias("_tie"))
    silent = s.join(spoken.select(F.col(key).alias("_k"), F.col("slide").alias("_i")), ["_k", "_i"], "left_anti")
    none = F.lit(None).cast(words.schema[pos].dataType)
    b = silent.select(F.col("_k").alias(key), F.col("_i").alias("slide"), F.col("_s0").alias("start"), F.col("_s1").alias("end"), none.alias("first_word"), none.alias("last_word"), F.col("_s0").alias("_t"), F.lit(0).alias("_kind"), F.col("_i").cast("long").alias("_tie"))
    both = a.unionByName(b)
    return both.withColumn("section_pos", F.row_number().over(ordered([key], ["_t", "_kind", "_tie"])) - 1).drop("_t", "_kind", "_tie")


def completeness(words: DataFrame, found: DataFrame, key: str, pos: str) -> DataFrame:
    """key, words, placed, complete: the sections' words, in section order, are the recording's words in order."""
    w = ordered([key], ["section_pos"])
    spoken = found.where(F.col("first_word").isNotNull()).withColumn("_before", F.lag("last_word").over(w))
    ok = F.col("first_word") == F.coalesce(F.col("_before") + 1, F.lit(0))
    placed = spoken.groupBy(key).agg(F.sum(F.col("last_word") - F.col("first_word") + 1).alias("placed"), F.bool_and(ok).alias("_ok"))
    counts = words.groupBy(key).agg(F.count("*").alias("words"))
    return counts.join(placed, key, "left").select(key, "words", F.coalesce("placed", F.lit(0)).alias("placed"), (F.coalesce("_ok", F.lit(False)) & (F.col("words") == F.col("placed"))).alias("complete"))


def absorb_short(found: DataFrame, key: str, least) -> DataFrame:
    """Adds target: the section_pos of the section each one joins. Off-slide speech shorter than least goes to the slide before
    it, else to the one after, if no longer off-slide section lies between; else it stays."""
    w = ordered([key], ["section_pos"])
    short = F.col("slide").isNull() & (F.col("end") - F.col("start") < least)
    anchor = F.when(~short, F.struct("section_pos", F.col("slide").isNotNull().alias("on")))
    back = F.last(anchor, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.first(anchor, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    target = F.when(~short, F.col("section_pos")).when(back["on"], back["section_pos"]).when(ahead["on"], ahead["section_pos"]).otherwise(F.col("section_pos"))
    return found.withColumn("target", target)


def consolidated(found: DataFrame, key: str, least) -> DataFrame:
    """Sections after absorb_short: one row for each target, with joined interval and words."""
    t = absorb_short(found, key, least)
    out = t.groupBy(key, "target").agg(F.max(F.when(F.col("section_pos") == F.col("target"), F.col("slide"))).alias("slide"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"))
    return out.withColumn("section_pos", F.row_number().over(ordered([key], ["target"])) - 1).drop("target")


def same_content_groups(found: DataFrame, key: str, order: list[str], content: str, on_slide: Column, name: str = "group_id") -> DataFrame:
    """Numbers groups of neighbours on slides with the same, non-null content."""
    w = ordered([key], order)
    same = on_slide & F.lag(on_slide).over(w) & F.col(content).isNotNull() & (F.col(content) == F.lag(content).over(w))
    return number_breaks(found, [key], order, ~F.coalesce(same, F.lit(False)), name)
