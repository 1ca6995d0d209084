"""Markdown pieces and time codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the mark after a line that was read with low confidence.
LOW_CONFIDENCE_MARK = "_(?)_"
TITLE_MAX = 60

#: The transcript's labels and the order of its head.
TITLE = "Транскрипт лекции"
OFF_SLIDE = "Речь вне слайдов"
SLIDE, SLIDES = "Слайд", "Слайды"
NO_SPEECH = "_Речи в этом интервале нет._"
NOT_RECOGNISED = "_Содержимое слайда не распознано — смотрите изображение._"
UNRELIABLE = "_Распознавание ненадёжно, сверьтесь с изображением слайда._"
EMPTY_TEXT = "_Текст на слайде не распознан — смотрите изображение._"
METADATA = [
    ("source", "Исходный файл"), ("duration", "Длительность"), ("asr_backend", "ASR-бэкенд"), ("ocr_backend", "OCR-бэкенд"),
    ("punctuation", "Пунктуация"), ("slides", "Слайдов"), ("words", "Слов распознано"),
]


def timecode(seconds: Column, hours: bool = False) -> Column:
    """MM:SS, or H:MM:SS from an hour on or if hours is set; whole seconds, negative ones as 0."""
    s = F.floor(F.greatest(F.lit(0.0), seconds.cast("double"))).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    long_ = F.format_string("%d:%02d:%02d", h, m, r)
    return long_ if hours else F.when(h > 0, long_).otherwise(F.format_string("%02d:%02d", m, r))


def duration(seconds: Column) -> Column:
    """A time taken, for people: '12.3 с' below a minute, else 'M мин SS с'."""
    whole = F.floor(seconds).cast("long")
    long = F.concat(F.floor(whole / 60).cast("string"), F.lit(" мин "), F.lpad((whole % 60).cast("string"), 2, "0"), F.lit(" с"))
    return F.when(seconds < 60, F.format_string("%.1f с", F.bround(seconds, 1))).otherwise(long)


def interval(start: Column, end: Column) -> Column:
    return F.concat(timecode(start, True), F.lit("–"), timecode(end, True))


def escape(c: Column) -> Column:
    """Text as Markdown shows it: special characters get a backslash, and so do those that are special where a line begins."""
    c = F.regexp_replace(c, r"([\\`*_{}\[\]$|])", r"\\$1")
    return F.regexp_replace(c, r"^([#>+=-])", r"\\$1")


def link_target(path: Column) -> Column:
    """A link's target with the characters escaped that would end it."""
    for raw, coded in ((" ", "%20"), ("(", "%28"), (")", "%29"), ("<", "%3C"), (">", "%3E")):
        path = F.replace(path, F.lit(raw), F.lit(coded))
    return path


def image_link(text: Column, path: Column) -> Column:
    """An image link; a target with blanks or parentheses stands in angle brackets."""
    target = F.when(path.rlike("[ ()]"), F.concat(F.lit("<"), path, F.lit(">"))).otherwise(path)
    return F.concat(F.lit("!["), text, F.lit("]("), target, F.lit(")"))


def slide_markdown(fragments: Column, image: Column) -> Column:
    """Lines of a slide (array of struct text, kind, low_confidence), then its image, a blank line between.

    Empty lines go; text is escaped, formulas stay as they are; lines read with
    low confidence are marked.
    """
    kept = F.filter(fragments, lambda f: F.trim(f["text"]) != "")
    lines = F.transform(kept, lambda f: F.concat(F.when(f["kind"] == "text", escape(F.trim(f["text"]))).otherwise(F.trim(f["text"])), F.when(f["low_confidence"], F.lit(" " + LOW_CONFIDENCE_MARK)).otherwise(F.lit(""))))
    return F.array_join(F.concat(lines, F.array(image)), "\n\n")


def body(markdown: Column) -> Column:
    """A slide's Markdown without image links and without leading blank or quoted lines; line ends trimmed."""
    lines = F.split(F.trim(F.regexp_replace(markdown, r"!\[[^\]]*\]\([^)]*\)", ""), F.lit(" \t\n\r")), "\n")
    first = F.array_position(F.transform(lines, lambda x: ~x.rlike(r"^\s*(>.*)?$")), True).cast("int")
    kept = F.when(first > 0, F.slice(lines, first, F.size(lines))).otherwise(F.array().cast("array<string>"))
    return F.trim(F.array_join(F.transform(kept, lambda x: F.rtrim(x)), "\n"), F.lit(" \t\n\r"))


def signature(markdown: Column) -> Column:
    """What is compared of two slides' contents: the body without marks, blanks collapsed; null if there is nothing."""
    text = F.trim(F.regexp_replace(F.replace(body(markdown), F.lit(LOW_CONFIDENCE_MARK), F.lit(" ")), "\\s+", " "))
    return F.nullif(text, F.lit(""))


def slide_title(markdown: Column, most: int = TITLE_MAX) -> Column:
    """The first line with a letter or digit once formulas, emphasis and leading markup are gone; cut at a word's end. Empty if none."""
    def plain(x: Column) -> Column:
        x = F.replace(x, F.lit(LOW_CONFIDENCE_MARK), F.lit(" "))
        x = F.regexp_replace(x, r"(?<!\\)\$\$.*?(?<!\\)\$\$|(?<!\\)\$.*?(?<!\\)\$|(?<!\\)\$", " ")
        x = F.regexp_replace(x, r"(?<!\\)(\*\*|__|\*|_)", "")
        x = F.regexp_replace(x, r"^\s*(?:#+|>|[-+*])\s+", "")
        return F.trim(F.regexp_replace(x, r"\s+", " "))

    lines = F.filter(F.transform(F.split(body(markdown), "\n"), plain), lambda x: x.rlike("[\\p{L}\\p{N}]"))
    text = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    head = F.substring(text, 1, most)
    head = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(text) > most, F.concat(F.rtrim(head, F.lit(" ,;:—–-\\")), F.lit("…"))).otherwise(text)


def metadata_lines(metadata: Column) -> Column:
    """Head lines of a map: known keys in their order, then the others by name."""
    known = F.array(*(F.when(F.map_contains_key(metadata, F.lit(k)), F.concat(F.lit(f"- **{label}:** "), F.element_at(metadata, k))) for k, label in METADATA))
    names = F.array_sort(F.array_except(F.map_keys(metadata), F.array(*(F.lit(k) for k, _ in METADATA))))
    extra = F.transform(names, lambda k: F.concat(F.lit("- **"), k, F.lit(":** "), F.element_at(metadata, k)))
    return F.concat(F.array_compact(known), extra)
