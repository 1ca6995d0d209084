"""Registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from . import records, timeline, transcripts

MODULES = [timeline, transcripts, records]


def queries():
    return {k: f for m in MODULES for k, f in sorted(m.QUERIES.items())}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}


def flagship(spark, sf_dir):
    return transcripts.q44_transcript_markdown(spark, sf_dir)
