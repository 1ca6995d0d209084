"""Settings: typed, closed sections with defaults, and an overlay that may only change what exists."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from .errors import ConfigError


@dataclass(frozen=True)
class MediaIngest:
    frames_fps: float = 1.0
    audio_sample_rate: int = 16000
    audio_track: int = -1
    hwaccel: str = "auto"


@dataclass(frozen=True)
class SlideExtraction:
    variance_window_s: float = 300.0
    variance_samples: int = 100
    min_region_area_ratio: float = 0.05
    min_layout_interval_s: float = 20.0
    min_absence_s: float = 2.0
    max_spread: float = 8.0
    min_brightness: float = 150.0
    hash_size: int = 16
    hamming_threshold: int = 43
    min_group_s: float = 0.0
    region: str = ""


@dataclass(frozen=True)
class SlideOcr:
    backend: str = "hybrid"
    low_confidence: float = 0.60
    unreliable_ratio: float = 0.5
    glossary_min_term_length: int = 4
    glossary_max_terms: int = 500
    glossary_stopwords: tuple = ()


@dataclass(frozen=True)
class SpeechTranscription:
    backend: str = "gigaam"
    vad_backend: str = "auto"
    punctuation: str = "auto"
    use_glossary: bool = True
    min_silence_s: float = 1.0
    min_speech_s: float = 0.2
    pad_s: float = 0.15


@dataclass(frozen=True)
class TranscriptAssembly:
    boundary_tolerance_s: float = 2.0
    short_offslide_section_s: float = 15.0
    timecode_every_s: float = 120.0
    filler_cleanup: bool = True


@dataclass(frozen=True)
class Cache:
    enabled: bool = True
    dir: str = ".cache"


@dataclass(frozen=True)
class Settings:
    media_ingest: MediaIngest = field(default_factory=MediaIngest)
    slide_extraction: SlideExtraction = field(default_factory=SlideExtraction)
    slide_ocr: SlideOcr = field(default_factory=SlideOcr)
    speech_transcription: SpeechTranscription = field(default_factory=SpeechTranscription)
    transcript_assembly: TranscriptAssembly = field(default_factory=TranscriptAssembly)
    cache: Cache = field(default_factory=Cache)


def _typed(where: str, default, value):
    kind = type(default)
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if kind is tuple and isinstance(value, list):
        return tuple(value)
    if type(value) is not kind:  # a bool is no number here
        raise ConfigError(f"{where} is a {kind.__name__}, not {value!r}")
    return value


def overlaid(settings: Settings, changes: dict) -> Settings:
    """settings with changes ({section: {key: value}}); unknown sections, keys and kinds of values are errors."""
    for section, values in (changes or {}).items():
        if section not in {f.name for f in fields(settings)}:
            raise ConfigError(f"no section {section}")
        old = getattr(settings, section)
        known = {f.name for f in fields(old)}
        if unknown := set(values or {}) - known:
            raise ConfigError(f"no setting {section}.{sorted(unknown)[0]}")
        settings = replace(settings, **{section: replace(old, **{k: _typed(f"{section}.{k}", getattr(old, k), v) for k, v in (values or {}).items()})})
    return settings


#: Of each stage, its section and the settings that decide its result; no names: all of the section.
_PARAMS = {
    "audio": ("media_ingest", "audio_track audio_sample_rate"), "frames": ("media_ingest", "frames_fps hwaccel"), "slides": ("slide_extraction", ""),
    "ocr": ("slide_ocr", "backend low_confidence unreliable_ratio"), "glossary": ("slide_ocr", "glossary_min_term_length glossary_max_terms glossary_stopwords"),
    "vad": ("speech_transcription", "vad_backend min_silence_s min_speech_s pad_s"), "asr": ("speech_transcription", "backend use_glossary"),
    "punctuation": ("speech_transcription", "punctuation"), "merge": ("transcript_assembly", ""),
}


def stage_params(settings: Settings, stage: str) -> dict:
    """The settings on which a stage's result depends: those whose change must renew it, and no others."""
    if stage not in _PARAMS:
        raise ConfigError(f"no stage {stage}; there are {', '.join(_PARAMS)}")
    section, names = _PARAMS[stage]
    held = getattr(settings, section)
    return {n: list(v) if isinstance(v := getattr(held, n), tuple) else v for n in (names.split() or [f.name for f in fields(held)])}


def assembly_rules(settings: Settings):
    """The rules of transcript assembly that settings name."""
    from .operators.assembly import AssemblyRules

    t = settings.transcript_assembly
    return AssemblyRules(tolerance=t.boundary_tolerance_s, short_off_slide=t.short_offslide_section_s, timecode_every=t.timecode_every_s, clean=t.filler_cleanup)


def changed(settings: Settings, given: list[str]) -> Settings:
    """settings with changes as a command line gives them: section.key=value, the value in JSON or as plain text."""
    import json

    for entry in given:
        name, mark, value = entry.partition("=")
        section, dot, key = name.partition(".")
        if not mark or not dot:
            raise ConfigError(f"a setting is given as section.key=value, not {entry!r}")
        try:
            value = json.loads(value)
        except ValueError:
            pass
        settings = overlaid(settings, {section: {key: value}})
    return settings


def as_text(settings: Settings) -> str:
    """All settings as YAML that `load` reads."""
    lines = []
    for f in fields(settings):
        held = getattr(settings, f.name)
        lines += [f"{f.name}:"] + [f"  {k.name}: {json_of(getattr(held, k.name))}" for k in fields(held)]
    return "\n".join(lines) + "\n"


def json_of(value) -> str:
    import json

    return json.dumps(list(value) if isinstance(value, tuple) else value, ensure_ascii=False)


def load(path: str) -> Settings:
    import yaml

    with open(path, encoding="utf-8") as f:
        return overlaid(Settings(), yaml.safe_load(f) or {})


def region(text: str) -> tuple[int, int, int, int] | None:
    """A rectangle given as X,Y,W,H; empty is none; a negative corner or a side that isn't positive is an error."""
    if not text:
        return None
    try:
        x, y, w, h = (int(p) for p in text.split(","))
    except ValueError as e:
        raise ConfigError(f"a region is X,Y,W,H, not {text!r}") from e
    if x < 0 or y < 0 or w <= 0 or h <= 0:
        raise ConfigError(f"a region lies in the picture and has sides: {text!r}")
    return x, y, w, h
