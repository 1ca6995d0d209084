"""The whole way from words and slides to a Markdown transcript, one row for each recording."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PipelineError
from ..functions import markdown as md
from . import cleanup, intervals, paragraphs, transcript
from .stages import staged


@dataclass(frozen=True)
class AssemblyRules:
    tolerance: float = 2.0
    phrase_gap: float = 0.45
    short_off_slide: float = 15.0
    timecode_every: float = 120.0
    clean: bool = True
    cleanup: cleanup.CleanupRules = cleanup.CleanupRules()
    paragraphs: paragraphs.ParagraphRules = paragraphs.ParagraphRules()
    title: str = md.TITLE


KEY = "recording_id"


def placed_words(words: DataFrame, slides: DataFrame, rules: AssemblyRules) -> tuple[DataFrame, DataFrame]:
    """(words with run and section_label, sections in order, short off-slide ones absorbed)."""
    labelled = intervals.overlap_labels(words, slides, KEY, "slide_index", "start_s", "end_s", bucket=60.0)
    marked = staged(transcript.phrase_boundaries(labelled, KEY, "pos", "text", "start_s", "end_s", rules.phrase_gap), "labelled-words")
    shifted = staged(transcript.shift_boundaries(marked, KEY, "pos", "start_s", "slide_index", rules.tolerance), "shifted-words")
    found = transcript.sections(shifted, slides, KEY, "pos", "start_s", "end_s", "section_label", "run", "slide_index", "start_s", "end_s")
    return shifted, staged(transcript.consolidated(staged(found, "sections"), KEY, rules.short_off_slide), "consolidated")


def check_complete(words: DataFrame, found: DataFrame) -> None:
    """Fails if the sections' words aren't the words in order; only a failing recording's numbers reach the driver."""
    bad = transcript.completeness(words, found, KEY, "pos").where(~F.col("complete")).limit(1).collect()
    if bad:
        raise PipelineError(f"sections of {bad[0][KEY]} hold {bad[0]['placed']} of {bad[0]['words']} words in order")


def assemble(words: DataFrame, slides: DataFrame, ocr: DataFrame | None = None, metadata: DataFrame | None = None, rules: AssemblyRules = AssemblyRules(), check: bool = False) -> DataFrame:
    """recording_id, markdown.

    words: recording_id, pos, text, start_s, end_s; slides: recording_id,
    slide_index, start_s, end_s, image_path and, where pictures are at hand,
    image_digest (of their bytes; equal ones are linked once); ocr: recording_id, slide_index,
    markdown, unreliable; metadata: recording_id, metadata (map). All steps are
    parted by recording, so they share one exchange of the words.
    """
    words, slides = staged(words, "words"), staged(slides, "slides")
    _, found = placed_words(words, slides, rules)
    if check:
        check_complete(words, found)
    spans = found.where(F.col("first_word").isNotNull()).withColumn("section_start", F.col("start"))
    spoken = intervals.within(words, spans, KEY, "pos", "first_word", "last_word", "section_pos", "section_start", closed=True)
    spoken = spoken.select(KEY, "section_pos", "section_start", "pos", "text", "start_s", "end_s")
    keys = [KEY, "section_pos"]
    spoken = staged(spoken, "spoken")
    if rules.clean:
        spoken = cleanup.cleaned(spoken, keys, "pos", "text", "start_s", "end_s", rules.cleanup)
    spoken = staged(spoken, "cleaned")
    info = found
    if ocr is not None:
        one = ocr.groupBy(KEY, "slide_index").agg(F.max_by(F.struct("markdown", "unreliable"), F.struct("markdown")).alias("ocr"))
        info = info.join(one.withColumnRenamed("slide_index", "slide"), [KEY, "slide"], "left")
    else:
        info = info.withColumn("ocr", F.lit(None).cast("struct<markdown:string,unreliable:boolean>"))
    # pictures are told apart by what they hold; one that can't be read, by its path
    path = F.coalesce(F.col("image_path"), F.lit(""))
    digest = F.coalesce("image_digest", F.concat(F.lit("path:"), path)) if "image_digest" in slides.columns else F.concat(F.lit("path:"), path)
    images = slides.select(KEY, F.col("slide_index").alias("slide"), "image_path", digest.alias("image_key"))
    info = info.join(images, [KEY, "slide"], "left").withColumn("_content", md.signature(F.col("ocr.markdown")))
    grouped = transcript.same_content_groups(staged(info, "section-info"), KEY, ["section_pos"], "_content", F.col("slide").isNotNull())
    last = F.max_by(F.struct("slide", "ocr"), "section_pos")
    heads = grouped.groupBy(KEY, "group_id").agg(
        F.min("section_pos").alias("group_pos"), F.min("start").alias("start"), F.max("end").alias("end"), last.alias("_last"), F.min_by("slide", "section_pos").alias("first_slide"),
        F.array_sort(F.collect_list(F.when(F.col("slide").isNotNull(), F.struct("section_pos", "slide", "image_path", "image_key")))).alias("_images"),
    ).select("*", "_last.*").drop("_last")
    to_group = grouped.select(KEY, "section_pos", "group_id")
    # groups of one section keep its words; groups of several are one section for paragraphs
    spoken = spoken.join(to_group, keys).drop("section_pos", "section_start").join(heads.select(KEY, "group_id", F.col("start").alias("section_start")), [KEY, "group_id"])
    gkeys = [KEY, "group_id"]
    spoken, heads = staged(spoken, "grouped-words"), staged(heads, "heads")
    parts = paragraphs.split(spoken, gkeys, "pos", "text", "start_s", "end_s", rules.paragraphs)
    texts = paragraphs.texts(staged(parts, "paragraphs"), gkeys, "pos", "text", "start_s")
    anchors = heads.select(*gkeys, F.col("start").alias("anchor"))
    coded = paragraphs.timecodes(texts.join(anchors, gkeys), gkeys, "paragraph", "start", "anchor", rules.timecode_every)
    block = F.when(F.col("timecode"), F.concat(F.lit("**["), md.timecode(F.col("start"), True), F.lit("]**\n\n"), "text", F.lit("\n"))).otherwise(F.concat("text", F.lit("\n")))
    speech = coded.where(F.col("text") != "").groupBy(*gkeys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", block.alias("b")))), lambda r: r["b"]), "\n").alias("speech"))
    whole = heads.join(speech, gkeys, "left")
    rendered = whole.select(KEY, "group_pos", F.concat(_heading(), F.lit("\n\n"), _slide_block(), F.coalesce("speech", F.lit(md.NO_SPEECH + "\n"))).alias("_t"))
    out = rendered.groupBy(KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_pos", "_t"))), lambda r: r["_t"]), "\n").alias("_body"))
    if metadata is None:
        head = F.lit(f"# {rules.title}\n\n")
    else:
        out = out.join(metadata, KEY, "left")
        lines = md.metadata_lines(F.col("metadata"))
        head = F.concat(F.lit(f"# {rules.title}\n\n"), F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n\n"))).otherwise(F.lit("")))
    return out.select(KEY, F.concat(F.regexp_replace(F.concat(head, "_body"), "\n+$", ""), F.lit("\n")).alias("markdown"))


def _heading():
    title = md.slide_title(F.col("ocr.markdown"))
    number = F.when(F.col("first_slide") != F.col("slide"), F.concat(F.lit(md.SLIDES + " "), F.col("first_slide").cast("string"), F.lit("–"), F.col("slide").cast("string"))).otherwise(F.concat(F.lit(md.SLIDE + " "), F.col("slide").cast("string")))
    label = F.when(F.col("slide").isNull(), F.lit(md.OFF_SLIDE)).when(F.coalesce(title, F.lit("")) != "", F.concat(number, F.lit(" — "), title)).otherwise(number)
    return F.concat(F.lit("## "), label, F.lit(" — "), md.interval(F.col("start"), F.col("end")))


def _slide_block():
    content = md.body(F.col("ocr.markdown"))
    lines = F.transform(F.split(content, "\n"), lambda x: F.rtrim(x))
    said = F.when(F.col("ocr").isNull(), F.array(F.lit(md.NOT_RECOGNISED))).otherwise(F.concat(
        F.when(F.coalesce(F.col("ocr.unreliable"), F.lit(False)), F.array(F.lit(md.UNRELIABLE), F.lit(""))).otherwise(F.array().cast("array<string>")),
        F.when(content == "", F.array(F.lit(md.EMPTY_TEXT))).otherwise(lines)))
    distinct = F.filter("_images", lambda i, n: i.isNotNull() & (F.array_position(F.transform("_images", lambda j: j["image_key"]), i["image_key"]) == n + 1))
    links = F.flatten(F.transform(distinct, lambda i: F.array(F.lit(""), md.image_link(F.concat(F.lit(md.SLIDE + " "), i["slide"].cast("string")), F.coalesce(i["image_path"], F.lit(""))))))
    quoted = F.transform(F.concat(said, links), lambda x: F.rtrim(F.concat(F.lit("> "), x)))
    return F.when(F.col("slide").isNull(), F.lit("")).otherwise(F.concat(F.array_join(quoted, "\n"), F.lit("\n\n")))
