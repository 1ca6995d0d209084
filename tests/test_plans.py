"""Cache, DAG, settings, sources, back ends, streams, and every query against its SQL on the smallest tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import config, errors
from tidemark.operators import backends
from tidemark.plans import cache, dag, registry
from tidemark.sources import probe, wav


def test_cache_keys_and_cells(spark, tmp_path):
    k = cache.key("a", {"x": 1, "y": 2}, "id", ["p", "q"])
    assert k == cache.key("a", {"y": 2, "x": 1}, "id", ["q", "p"]) and len(k) == 32 and k != cache.key("a", {"x": 2, "y": 2}, "id", ["p", "q"])
    with pytest.raises(errors.CacheError):
        cache.canonical({"x": object()})
    cell = cache.Cell(spark, str(tmp_path), "a", k)
    assert not cell.hit()
    assert cell.save(spark.range(3)).count() == 3 and cell.hit() and cell.load().count() == 3
    assert not cache.Cell(spark, str(tmp_path), "a", k, enabled=False).hit()


def test_dag_reuses_and_renews(spark, tmp_path):
    stages = {"a": (), "b": ("a",), "c": ()}
    functions = {"a": lambda c: c.spark.range(2), "b": lambda c: c.results["a"].withColumn("z", F.lit(c.params["b"]["z"])), "c": lambda c: c.spark.range(1)}
    go = lambda z, **o: dag.run(spark, str(tmp_path), "id", functions, {"b": {"z": z}}, stages, **o)[1]
    assert go(1).made == ["a", "b", "c"] and go(1).hits == ["a", "b", "c"]
    assert (r := go(2)).made == ["b"] and r.hits == ["a", "c"]
    assert dag.run(spark, str(tmp_path / "x"), "id", functions, {}, stages, only="c")[1].made == ["c"]
    with pytest.raises(errors.PipelineError):
        dag.run(spark, str(tmp_path / "y"), "id", functions, {}, stages, only="b")
    with pytest.raises(errors.CacheError):
        dag.checked({"b": ("a",), "a": ()})
    assert dag.selected(dag.STAGES, first="asr") == ["asr", "punctuation", "merge"]


def test_settings_are_closed_and_typed():
    s = config.overlaid(config.Settings(), {"cache": {"enabled": False}, "media_ingest": {"frames_fps": 2}})
    assert s.media_ingest.frames_fps == 2.0 and not s.cache.enabled
    for bad in ({"x": {}}, {"cache": {"x": 1}}, {"slide_extraction": {"hash_size": True}}, {"cache": {"enabled": 1}}):
        with pytest.raises(errors.ConfigError):
            config.overlaid(config.Settings(), bad)
    assert config.region("1,2,3,4") == (1, 2, 3, 4) and config.region("") is None
    with pytest.raises(errors.ConfigError):
        config.region("1,2,0,4")


def test_probe(spark):
    j = '{"format":{"duration":"0"},"streams":[{"index":0,"codec_type":"video","avg_frame_rate":"30000/1001","disposition":{"attached_pic":0}},{"index":1,"codec_type":"audio","duration":"7.5","tags":{"Language":"ru"}}]}'
    m = probe.parse(spark.createDataFrame([("a", j), ("b", '{"streams":[]}')], "r string, j string"), "j")
    a, b = m.orderBy("r").collect()
    assert a.duration_s == 7.5 and round(a.video.fps, 3) == 29.97 and a.audio_tracks[0].language == "ru" and a.readable
    assert b.video is None and not b.readable
    with pytest.raises(errors.MissingAudioError):
        probe.require_track(m)


def test_wave_round_trip(spark, tmp_path):
    x = np.sin(np.arange(1000) / 5).astype(np.float32) * 0.5
    (tmp_path / "a.wav").write_bytes(wav.encode(x, 1000))
    got = wav.read(spark, str(tmp_path)).orderBy("block").collect()
    assert len(got) == 34 and np.allclose(np.concatenate([r.samples for r in got]), x, atol=1e-4)
    spark.dataSource.register(wav.WavSource)
    assert spark.read.format("wav").option("path", str(tmp_path)).load().count() == 34
    with pytest.raises(errors.UnreadableAudioError):
        wav.decode(b"no wave")


def test_backends(spark):
    slides = spark.createDataFrame([("r", 1, b"x"), ("r", 2, b"y")], "recording_id string, slide_index int, content binary")
    assert backends.recognize(slides, backends.OCR.require("fake")).where("error is null").count() >= 2
    pieces = spark.createDataFrame([("r", 10.0, 12.0, 100, [0.0] * 200)], "recording_id string, start_s double, end_s double, rate int, samples array<double>")
    w = backends.transcribe(pieces, backends.ASR.require("test")).orderBy("pos").collect()
    assert [r.text for r in w] == [f"word{k}" for k in range(5)] and all(10 <= r.start_s <= r.end_s <= 12 for r in w)
    with pytest.raises(errors.BackendUnavailableError):
        backends.OCR.factory("none")


def test_stream_sessions(spark, tmp_path):
    from tidemark.streaming.sessions import sessions

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, ts in enumerate([["2024-01-01 00:00:00", "2024-01-01 00:00:05", "2024-01-01 00:00:15"], ["2024-01-01 02:00:00"], ["2024-01-01 04:00:00"]]):
        spark.createDataFrame([("u", t) for t in ts], "k string, t string").selectExpr("k", "cast(t as timestamp) t").coalesce(1).write.mode("append" if n else "overwrite").parquet(f"{src}/{n}")
    for n in range(3):
        q = sessions(spark.readStream.schema("k string, t timestamp").parquet(f"{src}/*"), "k", "t", 10_000, "1 minute")
        break
    run = q.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(90)
    got = spark.read.parquet(out).orderBy("start").collect()
    assert [(r.n) for r in got][:2] == [2, 1]


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.sql(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    as_rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    assert as_rows(got) == as_rows(want)
