"""The stages of a transcript as functions from a context to a DataFrame, bound to the DAG.

A context's inputs hold what programs outside make: media (recording_id, json:
probe output), audio (recording_id, rate, samples), pictures (recording_id, idx,
present, region, hash, content). Models come by name from the registries.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..config import Settings, assembly_rules, stage_params
from ..operators import assembly, backends, glossary, layout, ocr, speech, statistics
from ..sources import probe
from . import cache, dag

KEY = "recording_id"
PICTURES = f"recording_id string, idx int, present boolean, region {schemas.RECT}, hash bigint, content binary"
LOG = logging.getLogger("tidemark")
FRAME_S = 0.03


def warned(context: dag.Context, text: str) -> None:
    """A warning, logged and kept once, in the order of first sight."""
    LOG.warning(text)
    if text not in context.warnings:
        context.warnings.append(text)


def audio(c: dag.Context) -> DataFrame:
    """recording_id, duration_s, rate, samples."""
    index = c.params["audio"]["audio_track"]
    media = probe.require_track(probe.parse(c.inputs["media"], "json"), None if index < 0 else index)
    found = c.inputs["audio"].withColumn("duration_s", F.size("samples") / F.col("rate"))
    if not probe.short_audio(found.select(KEY, "duration_s"), media, KEY).isEmpty():
        warned(c, "audio ends before its recording does")
    return found.select(KEY, "duration_s", "rate", "samples")


def frames(c: dag.Context) -> DataFrame:
    """recording_id, idx, ts, present, region, hash, content, duration_s: the grid's pictures. Recordings without video have none."""
    media = probe.parse(c.inputs["media"], "json")
    if not media.where(F.col("video").isNull()).isEmpty():
        warned(c, "a recording without video has no slides")
    grid = probe.frame_times(media.where(F.col("video").isNotNull()), KEY, c.params["frames"]["frames_fps"])
    return grid.join(c.inputs["pictures"], [KEY, "idx"]).join(media.select(KEY, "duration_s"), KEY)


def slides(c: dag.Context) -> DataFrame:
    """recording_id, slide_index, start_s, end_s, region, representative_s, image_path, image_digest, content."""
    f, p = c.results["frames"], c.params["slides"]
    step = 1.0
    found = layout.layout_intervals(f, KEY, "idx", "ts", "present", "region", step, p["min_absence_s"], p["min_layout_interval_s"])
    groups = layout.groups_of_layout(f, found, KEY, "idx", "ts", "hash", step, p["min_absence_s"], p["hamming_threshold"], p["min_group_s"])
    numbered = layout.number_slides(groups, KEY)
    last = f.select(KEY, F.col("idx").alias("representative"), F.col("region"), "content")
    path = F.format_string("slides/slide_%03d.png", "slide_index")
    return numbered.join(last, [KEY, "representative"]).select(KEY, "slide_index", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "region", "representative_s", path.alias("image_path"), F.sha2("content", 256).alias("image_digest"), "content")


def slide_ocr(c: dag.Context) -> DataFrame:
    """Fragments of all slides, in reading order (place)."""
    made = backends.recognize(c.results["slides"], backends.OCR.require(c.params["ocr"]["backend"]), KEY).where(F.col("error").isNull())
    kept, _ = ocr.drop_handwriting(ocr.mark_low(made, least=c.params["ocr"]["low_confidence"]), [KEY, "slide_index"], "text", "confidence")
    placed = ocr.reading_order(kept, [KEY, "slide_index"], "pos", "bbox").select(KEY, "slide_index", "pos", "place")
    return kept.join(placed, [KEY, "slide_index", "pos"])


def terms(c: dag.Context) -> DataFrame:
    p = c.params["glossary"]
    rules = glossary.GlossaryRules(least_length=p["glossary_min_term_length"], most_terms=p["glossary_max_terms"], stopped=tuple(p["glossary_stopwords"]))
    return glossary.build(c.results["ocr"], KEY, "slide_index", "pos", "text", "bbox", rules)


def vad(c: dag.Context) -> DataFrame:
    """recording_id, start, end: speech."""
    p = c.params["vad"]
    name, notes = speech.vad_backend(p["vad_backend"], False)
    for note in notes:
        warned(c, note)
    a = c.results["audio"].select(KEY, "rate", F.posexplode("samples").alias("i", "x"))
    rate = c.results["audio"].select("rate").first()
    frame = max(1, round((rate["rate"] if rate else 16000) * FRAME_S))
    return speech.detect(a, [KEY], "i", "x", frame, FRAME_S, min_silence=p["min_silence_s"], min_speech=p["min_speech_s"], pad=p["pad_s"])


def asr(c: dag.Context) -> DataFrame:
    """recording_id, pos, text, start_s, end_s, confidence."""
    p = c.params["asr"]
    pieces = c.results["vad"].join(c.results["audio"], KEY).select(KEY, F.col("start").alias("start_s"), F.col("end").alias("end_s"), "rate", speech.slice_samples(F.col("samples"), F.col("rate"), F.col("start"), F.col("end")).alias("samples"))
    hint = ""
    if p["use_glossary"]:
        first = statistics.prompt(statistics.prompt_budget(c.results["glossary"], [KEY], "rank", "term"), [KEY], "rank", "term").orderBy(KEY).first()
        hint = first["prompt"] if first else ""
    return backends.transcribe(pieces, backends.ASR.require(p["backend"]), hint, KEY)


def punctuation(c: dag.Context) -> DataFrame:
    words = c.results["asr"]
    if c.params["punctuation"]["punctuation"] == "none":
        return words
    made = speech.restore_punctuation(words, [KEY], "pos", "text", backends.PUNCTUATION.factory(c.params["punctuation"]["punctuation"]))
    if not made.where(~F.col("applied")).isEmpty():
        warned(c, "punctuation failed in part: words are as they were heard")
    return made.withColumn("text", F.col("punctuated")).drop("punctuated", "applied")


def recording_duration(results: dict[str, DataFrame]) -> DataFrame | None:
    """recording_id, duration_s: as the audio tells, else as the frames do; None without either."""
    have = [results[n].select(KEY, F.col("duration_s").alias(n)).distinct() for n in ("audio", "frames") if n in results]
    if not have:
        return None
    both = have[0] if len(have) == 1 else have[0].join(have[1], KEY, "full")
    return both.select(KEY, F.coalesce(*(F.col(x) for x in both.columns if x != KEY)).alias("duration_s"))


def merge(c: dag.Context) -> DataFrame:
    """recording_id, markdown."""
    f = c.results["ocr"].withColumn("low_confidence", F.coalesce("low_confidence", F.lit(False)))
    shown = ocr.assemble(f, [KEY, "slide_index"], "place", F.lit(None).cast("string"))
    sure = ocr.unreliable(f, [KEY, "slide_index"])
    read = shown.join(sure.select(KEY, "slide_index", "unreliable"), [KEY, "slide_index"], "left")
    info = recording_duration(c.results).select(KEY, F.create_map(F.lit("duration"), F.round("duration_s", 1).cast("string")).alias("metadata"))
    return assembly.assemble(c.results["punctuation"], c.results["slides"], read, info, c.rules)


FUNCTIONS = {"audio": audio, "frames": frames, "slides": slides, "ocr": slide_ocr, "glossary": terms, "vad": vad, "asr": asr, "punctuation": punctuation, "merge": merge}


def run(spark, root: str, inputs: dict[str, DataFrame], settings: Settings = Settings(), identity: str = "", **options):
    """All stages over the inputs: (results, report). The identity of cached results covers the inputs' and the code's."""
    params = {s: stage_params(settings, s) for s in dag.STAGES}
    return dag.run(spark, root, f"{identity}|{cache.fingerprint()}", FUNCTIONS, params, inputs=inputs, rules=assembly_rules(settings), **options)


def encoded(df: DataFrame) -> Column:
    """A row as a JSON payload, for interchange; nulls are written."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def decoded(payload: Column, ddl: str) -> Column:
    """A payload as a record of one of the schemas (see tidemark.schemas)."""
    return F.from_json(payload, schemas.of(ddl), {"mode": "FAILFAST"})


def set_up_logging(verbose: bool = False) -> None:
    """Plain lines on standard error; details only if asked for."""
    logging.basicConfig(level=logging.DEBUG if verbose else logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s", force=True)
