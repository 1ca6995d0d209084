"""The stages end to end with deterministic fakes, publishing, settings of stages, media arguments and payloads."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import cli, config, errors, schemas
from tidemark.operators import assembly, backends, ocr, speech
from tidemark.plans import cache, dag, stages
from tidemark.sources import media, probe, sinks


def inputs(spark):
    def probe(video, seconds):
        streams = [{"index": 1, "codec_type": "audio"}] + ([{"index": 0, "codec_type": "video", "avg_frame_rate": "25/1"}] if video else [])
        return json.dumps({"format": {"duration": str(seconds)}, "streams": streams})

    loud, quiet = (np.sin(np.arange(1000 * 20) / 3) * 0.5).tolist(), [0.0] * 5000
    region = {"x": 0, "y": 0, "width": 100, "height": 80}
    pictures = [("lecture", i, i < 50, region if i < 50 else None, 0 if i < 25 else -1, bytes([i // 25])) for i in range(60)]
    return {
        "media": spark.createDataFrame([("lecture", probe(True, 60)), ("talk", probe(False, 45))], "recording_id string, json string"),
        "audio": spark.createDataFrame([("lecture", 1000, loud + quiet + loud + [0.0] * 15000), ("talk", 1000, quiet + loud + loud)], "recording_id string, rate int, samples array<double>"),
        "pictures": spark.createDataFrame(pictures, f"recording_id string, idx int, present boolean, region {schemas.RECT}, hash bigint, content binary"),
    }


def settings(**changes):
    base = {"slide_ocr": {"backend": "fake"}, "speech_transcription": {"backend": "fake", "vad_backend": "auto", "punctuation": "fake"}, "slide_extraction": {"min_layout_interval_s": 5.0}}
    return config.overlaid(config.overlaid(config.Settings(), base), changes)


def test_all_stages_with_fakes(spark, tmp_path):
    results, report = stages.run(spark, str(tmp_path), inputs(spark), settings(), "in")
    assert report.made == list(dag.STAGES) and not report.hits
    texts = {r.recording_id: r.markdown for r in results["merge"].collect()}
    assert set(texts) == {"lecture", "talk"} and texts["lecture"].count("![") == 2 and "![" not in texts["talk"]
    assert [tuple(r) for r in results["slides"].select("slide_index", "start_s", "end_s", "image_path").orderBy("slide_index").collect()] == [(1, 0.0, 25.0, "slides/slide_001.png"), (2, 25.0, 50.0, "slides/slide_002.png")]
    words = results["asr"].groupBy("recording_id").count().collect()
    assert all(r["count"] > 50 for r in words) and "Word0" in texts["talk"]
    assert report.warnings == ["a recording without video has no slides", "the speech model can't run; speech is found by energy"]
    again = stages.run(spark, str(tmp_path), inputs(spark), settings(), "in")[1]
    assert again.hits == list(dag.STAGES)
    renewed = stages.run(spark, str(tmp_path), inputs(spark), settings(transcript_assembly={"timecode_every_s": 30.0}), "in")[1]
    assert renewed.made == ["merge"]
    assert {r.recording_id: r.duration_s for r in stages.recording_duration(results).collect()} == {"lecture": 60.0, "talk": 45.0}
    assert stages.recording_duration({}) is None


def test_settings_of_stages():
    s = config.Settings()
    assert config.stage_params(s, "audio") == {"audio_track": -1, "audio_sample_rate": 16000} and config.stage_params(s, "punctuation") == {"punctuation": "auto"}
    assert set(dag.STAGES) == {x for x in dag.STAGES if config.stage_params(s, x)}
    with pytest.raises(errors.ConfigError):
        config.stage_params(s, "x")
    t = config.changed(s, ["transcript_assembly.filler_cleanup=false", "slide_ocr.backend=vlm", "media_ingest.frames_fps=2"])
    assert not t.transcript_assembly.filler_cleanup and t.slide_ocr.backend == "vlm" and t.media_ingest.frames_fps == 2.0
    assert config.assembly_rules(t).clean is False and config.assembly_rules(s) == assembly.AssemblyRules()
    for bad in ("x", "cache.x=1", "slide_ocr.backend=1"):
        with pytest.raises(errors.ConfigError):
            config.changed(s, [bad])


def test_settings_as_text(tmp_path):
    path = tmp_path / "s.yaml"
    s = settings(slide_ocr={"glossary_stopwords": ["ряд"]})
    path.write_text(config.as_text(s), encoding="utf-8")
    pytest.importorskip("yaml")
    assert config.load(str(path)) == s


def test_fingerprint_follows_the_code(tmp_path):
    (tmp_path / "a.py").write_text("x = 1")
    one = cache.fingerprint(str(tmp_path))
    (tmp_path / "note.txt").write_text("no code")
    assert cache.fingerprint(str(tmp_path)) == one and len(one) == 32
    (tmp_path / "a.py").write_text("x = 2")
    assert cache.fingerprint(str(tmp_path)) != one


def test_publishing(spark, tmp_path):
    cell, out = tmp_path / "cell", tmp_path / "out"
    cell.mkdir(), (out / "slides").mkdir(parents=True)
    for n in (1, 2):
        (cell / f"p{n}").write_bytes(bytes([n]))
    for name in ("slide_001.png", "slide_007.png", "mine.png", "slide_1.png"):
        (out / "slides" / name).write_bytes(b"old")
    gone = sinks.publish(spark, "a\r\nb\n", {"slide_001.png": str(cell / "p1"), "slide_002.png": str(cell / "p2")}, str(out))
    assert gone == ["slide_007.png"] and (out / "transcript.md").read_bytes() == b"a\nb\n"
    assert sorted(os.listdir(out / "slides")) == ["mine.png", "slide_001.png", "slide_002.png", "slide_1.png"] and (out / "slides" / "slide_001.png").read_bytes() == b"\x01"
    sinks.write_transcripts(spark.createDataFrame([("r", "x\ny\n")], "recording_id string, markdown string"), str(tmp_path / "t"))
    [file] = [f for f in os.listdir(tmp_path / "t" / "recording_id=r") if f.endswith(".txt")]
    assert (tmp_path / "t" / "recording_id=r" / file).read_bytes() == b"x\ny\n"


def test_media_arguments():
    have = media.parse_decoders("Hardware acceleration methods:\nvdpau\ncuda\n\n")
    assert have == ("vdpau", "cuda") and media.decoder("auto", have) == "cuda" and media.decoder("", have) == "none" and media.attempts("auto", have) == ["cuda", "none"] and media.attempts("cuda", have) == ["cuda"]
    with pytest.raises(errors.HwaccelUnavailableError):
        media.decoder("videotoolbox", have)
    with pytest.raises(errors.MissingVideoError):
        media.frame_arguments("a.mp4", None, 1)
    a = media.frame_arguments("a 100%.mp4", 0, 1.0, "cuda", 480)
    assert a[-1] == "frame_%06d.jpg" and a[a.index("-i") + 1] == os.path.abspath("a 100%.mp4") and a[a.index("-vf") + 1] == "fps=1,scale=480:-2" and a[a.index("-hwaccel") + 1] == "cuda"
    assert "aresample=async=1:first_pts=0" in media.audio_arguments("a.mp4", 1, 16000, "a.wav")
    plan = dict(media.warm_up_plan(settings(speech_transcription={"vad_backend": "energy"}), {"ocr:fake": True}))
    assert plan == {"ocr:fake": "ready", "asr:fake": "fetch", "vad:silero": "skip", "punctuation:fake": "fetch"} and media.offline({"A": "1"})["HF_HUB_OFFLINE"] == "1"


def test_payloads(spark):
    rows = spark.createDataFrame([("r", 1, 0.5, 2.0, (1, 2, 3, 4), 1.0, None)], schemas.of(schemas.SLIDES))
    back = rows.select(stages.encoded(rows).alias("j")).select("j", stages.decoded(F.col("j"), schemas.SLIDES).alias("s"))
    assert back.select("s.*").collect() == rows.collect() and '"image_path":null' in back.first().j
    with pytest.raises(Exception):  # noqa: B017
        spark.createDataFrame([("{x",)], "j string").select(stages.decoded(F.col("j"), schemas.SLIDES)).collect()


def test_equal_pictures_are_linked_once(spark):
    words = spark.createDataFrame([("r", k, f"слово{k}", k * 1.0, k + 0.5) for k in range(60)], "recording_id string, pos bigint, text string, start_s double, end_s double")
    slides = spark.createDataFrame([("r", n + 1, n * 20.0, n * 20 + 20.0, f"s{n + 1}.png", d) for n, d in enumerate(["aa", "bb", "aa"])], "recording_id string, slide_index int, start_s double, end_s double, image_path string, image_digest string")
    read = spark.createDataFrame([("r", n, "same text", False) for n in (1, 2, 3)], "recording_id string, slide_index int, markdown string, unreliable boolean")
    text = assembly.assemble(words, slides, read).first().markdown
    assert text.count("![") == 2 and "s1.png" in text and "s2.png" in text and "s3.png" not in text
    assert assembly.assemble(words, slides.drop("image_digest"), read).first().markdown.count("![") == 3


def test_recogniser_output_of_both_shapes(spark):
    quad = [[1.4, 2.0], [10.6, 2.0], [10.6, 8.0], [1.4, 8.0]]
    shapes = [("new", json.dumps({"rec_texts": ["a"], "rec_scores": [0.5], "rec_polys": [quad]})), ("pages", json.dumps([{"rec_texts": ["a"], "rec_scores": [0.5], "dt_polys": [quad]}])), ("old", json.dumps([[[quad, ["a", 0.5]]]])), ("none", "null"), ("empty", "[]")]
    got = ocr.parse_recognised(spark.createDataFrame(shapes, "k string, j string"), "j").collect()
    assert sorted((r.k, r.pos, r.text, r.confidence, tuple(r.bbox)) for r in got) == [(k, 0, "a", 0.5, (1, 2, 10, 6)) for k in ("new", "old", "pages")]


def test_words_of_segments_and_samples(spark):
    rows = [("r", [("whole", 0.0, 2.0, None), ("x", 2.0, 3.0, [(" one ", 2.0, 2.5, 0.9), (" ", 2.5, 2.6, 0.1)]), ("  ", 3.0, 4.0, [])])]
    got = speech.collect_words(spark.createDataFrame(rows, f"r string, s {speech.SEGMENTS}"), "s").collect()
    assert [tuple(x) for x in got] == [("r", 0, "whole", 0.0, 2.0, None), ("r", 1, "one", 2.0, 2.5, 0.9)]
    df = spark.createDataFrame([(list(range(10)),)], "s array<int>")
    cut = lambda a, z: df.select(speech.slice_samples(F.col("s"), F.lit(4), F.lit(a), F.lit(z)).alias("x")).first().x
    assert cut(0.5, 1.0) == [2, 3] and cut(-1.0, 0.25) == [0] and cut(2.0, 9.0) == [8, 9] and cut(3.0, 2.0) == [] and cut(9.0, 10.0) == []


def test_command_line_changes(tmp_path, capsys):
    assert cli.main(["settings", "--set", "slide_ocr.backend=vlm"]) == 0 and 'backend: "vlm"' in capsys.readouterr().out
    assert cli.main(["settings", "--set", "slide_ocr.nothing=1"]) == 2


def test_command_line_stages(spark, tmp_path, capsys):
    folder, out = tmp_path / "in", tmp_path / "out"
    for name, df in inputs(spark).items():
        if name != "pictures":
            df.write.parquet(f"{folder}/{name}.parquet")
    fakes = [x for k in ("slide_ocr.backend=fake", "speech_transcription.backend=fake", "speech_transcription.punctuation=fake", "speech_transcription.vad_backend=energy") for x in ("--set", k)]
    call = [str(folder), "--stages", *fakes, "--set", f"cache.dir={tmp_path / 'cells'}"]
    assert cli.main([*call, "--only-stage", "merge", "--no-cache"]) == 2 and "ocr, punctuation, slides" in capsys.readouterr().err
    assert cli.main([*call, "--only-stage", "merge"]) == 2 and "run them first" in capsys.readouterr().err
    assert cli.main([*call, "--out", str(out)]) == 0
    assert {d for d in os.listdir(out) if d.startswith("recording_id=")} == {"recording_id=lecture", "recording_id=talk"}
    assert "merge cached" not in capsys.readouterr().out
    assert cli.main(call) == 0 and capsys.readouterr().out.count("cached") == len(dag.STAGES)
    assert cli.main([*call, "--from-stage", "punctuation", "--set", "transcript_assembly.timecode_every_s=5.0"]) == 0
    lines = dict(x.split(" ", 1) for x in capsys.readouterr().out.splitlines())
    assert lines["audio"] == "cached" and lines["merge"].endswith(" s")
    assert cli.main([str(tmp_path / "none"), "--stages", *fakes]) == 2
    with pytest.raises(SystemExit):
        cli.main([*call, "--from-stage", "ocr", "--only-stage", "ocr"])


def test_models_are_released_whatever_happens(caplog):
    class Stuck:
        name = "stuck"

        def unload(self):
            raise RuntimeError("busy")

    backends.release(Stuck())
    backends.release(object())
    assert "stuck can't be released: busy" in caplog.text


def test_size_of_the_source(spark):
    def video(**more):
        return json.dumps({"format": {}, "streams": [{"index": 0, "codec_type": "video"} | more]})

    df = spark.createDataFrame([("a", video(width=1280, height=720)), ("b", video(width=0, height=720)), ("c", video()), ("d", json.dumps({"streams": [{"index": 0, "codec_type": "audio"}]}))], "r string, j string")
    got = probe.parse(df, "j").select("r", probe.source_size(F.col("video")).alias("s"), probe.source_width(F.col("video")).alias("w")).collect()
    assert {r.r: (r.s and tuple(r.s), r.w) for r in got} == {"a": ((1280, 720), 1280), "b": (None, None), "c": (None, None), "d": (None, None)}
