"""Model back ends: what they must offer, where they are registered, and fakes for tests. A factory travels, never a model."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BackendUnavailableError


@dataclass(frozen=True)
class Availability:
    available: bool
    reason: str = ""


class OcrBackend(Protocol):
    name: str

    def check_availability(self) -> Availability: ...
    def recognize(self, content: bytes) -> Iterable[dict]: ...
    def unload(self) -> None: ...


class AsrBackend(Protocol):
    name: str
    provides_punctuation: bool
    supports_glossary: bool

    def check_availability(self) -> Availability: ...
    def transcribe(self, samples, rate: int, glossary: str) -> Iterable[dict]: ...
    def unload(self) -> None: ...


class Punctuator(Protocol):
    def restore(self, text: str) -> str: ...


class Registry:
    """Factories by name, with aliases."""

    def __init__(self, kind: str):
        self.kind, self.factories, self.aliases = kind, {}, {}

    def register(self, name: str, factory: Callable, *aliases: str) -> None:
        self.factories[name] = factory
        self.aliases.update({a: name for a in aliases})

    def names(self) -> list[str]:
        return sorted(self.factories)

    def factory(self, name: str) -> Callable:
        name = self.aliases.get(name, name)
        if name not in self.factories:
            raise BackendUnavailableError(f"no {self.kind} named {name}; there are {', '.join(self.names()) or 'none'}")
        return self.factories[name]

    def require(self, name: str) -> Callable:
        """The factory, after the driver has asked its model whether it could run."""
        made = self.factory(name)
        answer = made().check_availability()
        if not answer.available:
            raise BackendUnavailableError(f"{self.kind} {name}: {answer.reason}")
        return made


def release(model) -> None:
    """Free what a model holds, if it holds anything; one that can't be freed doesn't fail a run that has its results."""
    try:
        getattr(model, "unload", lambda: None)()
    except Exception as e:
        logging.getLogger("tidemark").warning("%s can't be released: %s", getattr(model, "name", model), e)


OCR, ASR, PUNCTUATION = Registry("OCR back end"), Registry("ASR back end"), Registry("punctuator")

FRAGMENT_ROWS = "slide_index int, pos int, text string, kind string, confidence double, low_confidence boolean, bbox struct<x:int,y:int,width:int,height:int>, error string"


def recognize(slides: DataFrame, factory: Callable, key: str = "recording_id") -> DataFrame:
    """Fragments of slides (key, slide_index, content): one model for each task, released at its end; a failure is a row with its error."""

    def run(batches):
        model = factory()
        try:
            for pdf in batches:
                rows = []
                for rec, index, content in zip(pdf[key], pdf["slide_index"], pdf["content"], strict=True):
                    try:
                        for n, f in enumerate(model.recognize(content)):
                            rows.append({key: rec, "slide_index": index, "pos": n, "error": None} | f)
                    except Exception as e:
                        rows.append({key: rec, "slide_index": index, "pos": -1, "text": None, "kind": None, "confidence": None, "low_confidence": None, "bbox": None, "error": str(e)})
                yield pd.DataFrame(rows, columns=[key, "slide_index", "pos", "text", "kind", "confidence", "low_confidence", "bbox", "error"])
        finally:
            release(model)

    kind = dict(slides.dtypes)[key]
    return slides.select(key, "slide_index", "content").mapInPandas(run, f"{key} {kind}, {FRAGMENT_ROWS}")


def transcribe(pieces: DataFrame, factory: Callable, glossary: str = "", key: str = "recording_id") -> DataFrame:
    """Words of pieces (key, start_s, end_s, rate, samples): times are shifted into the recording and kept within the piece."""

    def run(batches):
        model = factory()
        try:
            for pdf in batches:
                rows = []
                for rec, low, high, rate, samples in zip(pdf[key], pdf["start_s"], pdf["end_s"], pdf["rate"], pdf["samples"], strict=True):
                    for w in model.transcribe(samples, int(rate), glossary if model.supports_glossary else ""):
                        a = min(max(low + w["start_s"], low), high)
                        rows.append((rec, w["text"], a, max(a, min(low + w["end_s"], high)), w.get("confidence")))
                yield pd.DataFrame(rows, columns=[key, "text", "start_s", "end_s", "confidence"])
        finally:
            release(model)

    kind = dict(pieces.dtypes)[key]
    words = pieces.select(key, "start_s", "end_s", "rate", "samples").mapInPandas(run, f"{key} {kind}, text string, start_s double, end_s double, confidence double")
    from .islands import ordered

    return words.where(F.trim("text") != "").withColumn("pos", (F.row_number().over(ordered([key], ["start_s", "end_s", "text"])) - 1).cast("long"))


class FakeOcr:
    """Fragments that depend on the picture's digest alone."""

    name = "fake"

    def check_availability(self):
        return Availability(True)

    def recognize(self, content: bytes):
        n = hashlib.sha256(content).digest()[0]
        for k in range(1 + n % 3):
            yield {"text": f"line {n} {k}", "kind": "text", "confidence": 0.99 - 0.2 * k, "low_confidence": False, "bbox": {"x": 40, "y": 60 * k, "width": 200, "height": 40}}

    def unload(self):
        pass


class FakeAsr:
    """Two and a half words a second."""

    name, provides_punctuation, supports_glossary = "fake", False, True

    def check_availability(self):
        return Availability(True)

    def transcribe(self, samples, rate, glossary):
        n = int(len(samples) / rate * 2.5)
        for k in range(n):
            yield {"text": f"word{k}", "start_s": k * 0.4, "end_s": k * 0.4 + 0.3}

    def unload(self):
        pass


class FakePunctuator:
    """A capital and a full stop for each chunk: a factory that makes a function from text to text."""

    def __call__(self):
        return lambda text: text[:1].upper() + text[1:] + "."


PUNCTUATION.register("fake", FakePunctuator())
OCR.register("fake", FakeOcr)
ASR.register("fake", FakeAsr, "test")
