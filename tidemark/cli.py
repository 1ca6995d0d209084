"""python -m tidemark.cli: run registered queries over a folder of tables and write their results as Parquet; 'settings'
instead of a folder prints all settings with the changes given; --stages makes transcripts from a folder's media, audio and
pictures (Parquet; without pictures the transcripts have no slides)."""

from __future__ import annotations

import argparse
import sys

from . import config
from .errors import ConfigError, PipelineError
from .plans import cache, dag, stages
from .sources import sinks


def _stages(a, settings) -> int:
    """0: done; 1: the stages have run, but there is no transcript; 2: wrong arguments or settings, or no input."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession

    if a.no_cache and (lacking := dag.from_cache(dag.STAGES, dag.selected(dag.STAGES, a.from_stage, a.only_stage))):
        print(f"without the cache there is no {', '.join(lacking)}; select them too", file=sys.stderr)
        return 2
    stages.set_up_logging(a.verbose)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    try:
        inputs = {n: spark.read.parquet(f"{a.tables}/{n}.parquet") for n in ("media", "audio")}
        try:
            inputs["pictures"] = spark.read.parquet(f"{a.tables}/pictures.parquet")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            inputs["pictures"] = spark.createDataFrame([], stages.PICTURES)
        root = settings.cache.dir if "://" in settings.cache.dir or settings.cache.dir.startswith("/") else f"{a.tables}/{settings.cache.dir}"
        use = settings.cache.enabled and not a.no_cache
        results, report = stages.run(spark, root, inputs, settings, cache.file_identity(spark, a.tables + "/*.parquet"), first=a.from_stage, only=a.only_stage, use_cache=use)
        for name in dag.STAGES:
            print(name, "cached" if name in report.hits else f"{report.seconds[name]:.1f} s" if name in report.made else "left out")
        if a.out and "merge" in results:
            sinks.write_transcripts(results["merge"], a.out)
    except (PipelineError, AnalysisException) as e:
        print(e, file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130
    wanted = "merge" in dag.selected(dag.STAGES, a.from_stage, a.only_stage)
    return 1 if wanted and "merge" not in results else 0


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .plans import registry

    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("tables", help="folder with the tables as Parquet")
    p.add_argument("queries", nargs="*", help="names; none: list them")
    p.add_argument("--out", help="folder for results; without it, rows are shown")
    p.add_argument("--explain", action="store_true", help="print the plans")
    p.add_argument("--set", action="append", default=[], metavar="SECTION.KEY=VALUE", help="a change of settings")
    p.add_argument("--config", help="file of settings")
    p.add_argument("--stages", action="store_true", help="run the stages of a transcript")
    part = p.add_mutually_exclusive_group()
    part.add_argument("--from-stage", choices=list(dag.STAGES))
    part.add_argument("--only-stage", choices=list(dag.STAGES))
    p.add_argument("--no-cache", action="store_true", help="make all that is selected anew")
    p.add_argument("--verbose", action="store_true")
    a = p.parse_args(args)
    try:
        settings = config.changed(config.load(a.config) if a.config else config.Settings(), a.set)
    except ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    if a.stages:
        return _stages(a, settings)
    if a.tables == "settings":
        print(config.as_text(settings), end="")
        return 0
    known = registry.queries()
    if not a.queries:
        print("\n".join(known))
        return 0
    if unknown := [q for q in a.queries if q not in known]:
        print(f"no query {unknown[0]}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    try:
        for q in a.queries:
            df = known[q](spark, a.tables)
            if a.explain:
                df.explain("formatted")
            if a.out:
                df.write.mode("overwrite").parquet(f"{a.out}/{q}")
            else:
                df.show(20, truncate=80)
    except PipelineError as e:
        print(e, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130
    return 0


if __name__ == "__main__":
    sys.exit(main())
