"""The stages of a transcript in order, and a runner that reads, makes or skips each."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import CacheError, PipelineError
from .cache import Cell, key

#: The stages with what each needs, in an order in which they can run.
STAGES: dict[str, tuple[str, ...]] = {
    "audio": (), "frames": (), "slides": ("frames",), "ocr": ("slides",), "glossary": ("ocr",), "vad": ("audio",), "asr": ("audio", "vad", "glossary"),
    "punctuation": ("asr",), "merge": ("punctuation", "slides", "ocr"),
}


def checked(stages: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """The stages, if each stands after all that it needs."""
    seen: set[str] = set()
    for name, needs in stages.items():
        if name in seen:
            raise CacheError(f"{name} stands twice")
        if missing := set(needs) - seen:
            raise CacheError(f"{name} stands before {', '.join(sorted(missing))}")
        seen.add(name)
    return stages


def selected(stages: dict, first: str | None = None, only: str | None = None) -> list[str]:
    """Stages to run: all, those from one on, or one alone."""
    names = list(stages)
    for x in (first, only):
        if x is not None and x not in stages:
            raise PipelineError(f"no stage {x}; there are {', '.join(names)}")
    return [only] if only else names[names.index(first) :] if first else names


def from_cache(stages: dict[str, tuple[str, ...]], chosen: list[str]) -> list[str]:
    """What a selection needs and doesn't make: only the cache has it."""
    return sorted({n for name in chosen for n in stages[name]} - set(chosen))


@dataclass
class Context:
    spark: SparkSession
    params: dict
    results: dict[str, DataFrame] = field(default_factory=dict)
    inputs: dict[str, DataFrame] = field(default_factory=dict)
    rules: object = None
    warnings: list[str] = field(default_factory=list)


@dataclass
class Report:
    hits: list[str] = field(default_factory=list)
    made: list[str] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def run(spark: SparkSession, root: str, identity: str, functions: dict[str, Callable[[Context], DataFrame]], params: dict[str, dict], stages=None, first=None, only=None, use_cache: bool = True, inputs=None, rules=None) -> tuple[dict[str, DataFrame], Report]:
    """Results of all stages that are selected or cached. A stage's key holds its parents' keys, so a change renews it and what follows."""
    stages = checked(stages or STAGES)
    chosen, keys, report = selected(stages, first, only), {}, Report()
    context = Context(spark, params, inputs=inputs or {}, rules=rules)
    report.warnings = context.warnings
    for name, needs in stages.items():
        keys[name] = key(name, params.get(name, {}), identity, [keys[n] for n in needs])
        cell = Cell(spark, root, name, keys[name], use_cache or name not in chosen)
        if cell.hit():
            context.results[name] = cell.load()
            report.hits.append(name)
            continue
        if name not in chosen:
            continue
        if missing := [n for n in needs if n not in context.results]:
            raise PipelineError(f"{name} needs {', '.join(missing)}, which aren't there; run them first")
        began = time.monotonic()
        context.results[name] = cell.save(functions[name](context))
        report.made.append(name)
        report.seconds[name] = time.monotonic() - began
    return context.results, report
