"""Operators against brute force in plain Python, their boundaries, and degenerate inputs."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import markdown as md
from tidemark.functions import folds, routing, text
from tidemark.operators import cleanup, glossary, intervals, islands, ocr, paragraphs, speech, statistics, transcript, vision


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def words_df(spark, said, step=1.0, length=0.5, key="r"):
    return spark.createDataFrame([(key, i, w, i * step, i * step + length) for i, w in enumerate(said)], "k string, pos long, text string, s double, e double")


def test_runs_null_equals_null(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([None, None, "x", "x", None, "y"])], "k string, p int, l string")
    assert [r[3] for r in rows(islands.runs(df, ["k"], ["p"], "l"), "p")] == [0, 0, 1, 1, 2, 3]
    assert islands.run_table(df.limit(0), ["k"], ["p"], "l").count() == 0


def test_sessions_split_at_the_gap(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 9, 19, 28)], "k string, t int")
    assert [r[2] for r in rows(islands.sessions(df, ["k"], ["t"], "t", 10), "t")] == [0, 0, 1, 1]


def smooth(flags, least):
    def groups(f):
        out, i = [], 0
        while i < len(f):
            j = i
            while j < len(f) and f[j] == f[i]:
                j += 1
            out.append((f[i], i, j))
            i = j
        return out

    f = list(flags)
    for v, i, j in groups(f):
        if v and j - i <= 2:
            f[i:j] = [False] * (j - i)
    g = groups(f)
    for n, (v, i, j) in enumerate(g):
        if not v and 0 < n < len(g) - 1 and j - i < least:
            f[i:j] = [True] * (j - i)
    return f


def test_presence_smoothing_against_brute_force(spark):
    rng = random.Random(1)
    cases = [[rng.random() < 0.6 for _ in range(rng.randint(1, 30))] for _ in range(60)]
    df = spark.createDataFrame([(c, i, f) for c, fs in enumerate(cases) for i, f in enumerate(fs)], "k int, p int, f boolean")
    got = {(r.k, r.p): r.smoothed for r in islands.smooth_presence(df, ["k"], ["p"], "f", 1, 3).collect()}
    for c, fs in enumerate(cases):
        assert [got[c, i] for i in range(len(fs))] == smooth(fs, 3)


def merged(spans, silence, least, pad, end):
    out = []
    for a, b in sorted(spans):
        if out and a - out[-1][1] < silence:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    again = []
    for a, b in [(max(0, a - pad), min(end, b + pad)) for a, b in out if b - a >= least]:
        if again and a <= again[-1][1]:
            again[-1][1] = max(again[-1][1], b)
        else:
            again.append([a, b])
    return [tuple(x) for x in again]


def test_merge_and_pad_against_brute_force(spark):
    rng = random.Random(2)
    cases = [[(a := rng.randint(0, 80), a + rng.randint(0, 9)) for _ in range(rng.randint(1, 12))] for _ in range(80)]
    df = spark.createDataFrame([(c, a, b) for c, s in enumerate(cases) for a, b in s], "k int, a int, b int")
    got = intervals.merge_and_pad(df, ["k"], "a", "b", 4, 3, 2, F.lit(85)).collect()
    for c, s in enumerate(cases):
        assert sorted((r.a, r.b) for r in got if r.k == c) == merged(s, 4, 3, 2, 85)


def test_merge_keeps_an_exact_gap_apart(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 9, 12), ("a", 15, 16)], "k string, a int, b int")
    assert rows(intervals.merge(df, ["k"], "a", "b", 4), "a") == [("a", 0, 5), ("a", 9, 16)]
    assert rows(intervals.merge(df, ["k"], "a", "b", 4, touching=True), "a") == [("a", 0, 16)]


@pytest.mark.parametrize("bucket", [None, 7])
def test_overlap_labels_against_brute_force(spark, bucket):
    rng = random.Random(3)
    spans = [(1, i, s := rng.randint(0, 60), s + rng.randint(1, 15)) for i in range(12)]
    points = [(1, p, s := rng.randint(0, 70), s + rng.choice([0, 0, 1, 3, 8])) for p in range(80)]
    got = {r.pos: r.i for r in intervals.overlap_labels(spark.createDataFrame(points, "k int, pos int, start int, end int"), spark.createDataFrame(spans, "k int, i int, start int, end int"), "k", "i", bucket=bucket).collect()}
    for _, p, s, e in points:
        if e > s:
            best = [(-(min(e, b) - max(s, a)), i) for _, i, a, b in spans if min(e, b) > max(s, a)]
        else:
            best = [(0 if s < b else 1, i) for _, i, a, b in spans if a <= s <= b]
        assert got[p] == (min(best)[1] if best else None)


def test_iou_touching_is_zero(spark):
    r = "named_struct('x', {}, 'y', 0, 'width', 10, 'height', 10)"
    df = spark.sql(f"select {r.format(0)} a, {r.format(10)} b, {r.format(5)} c")
    assert tuple(df.select(intervals.iou(F.col("a"), F.col("b")), F.round(intervals.iou(F.col("a"), F.col("c")), 4)).first()) == (0.0, 0.3333)


def test_uniform_sample_is_linspace_half_even(spark):
    for n in (1, 2, 6, 7, 8, 20, 99):
        df = spark.range(n).withColumn("k", F.lit(1))
        want = sorted({round(x) for x in np.linspace(0, n - 1, 7)}) if n > 7 else list(range(n))
        assert [r.id for r in islands.uniform_sample(df, ["k"], ["id"], 7).orderBy("id").collect()] == want


def test_merge_short_pieces_against_brute_force(spark):
    rng = random.Random(4)
    cases = [[rng.choice([1, 2, 5, 9]) for _ in range(rng.randint(1, 9))] for _ in range(80)]

    def brute(lengths):
        out = []
        for x in lengths:
            if out and x < 5:
                out[-1].append(x)
            else:
                out.append([x])
        if len(out) > 1 and sum(out[0]) < 5:
            out = [out[0] + out[1], *out[2:]]
        return [i for i, g in enumerate(out) for _ in g]

    df = spark.createDataFrame([(c, i, x) for c, xs in enumerate(cases) for i, x in enumerate(xs)], "k int, p int, n int")
    got = {(r.k, r.p): r.piece_id for r in islands.merge_short_pieces(df, ["k"], ["p"], "n", 5).collect()}
    for c, xs in enumerate(cases):
        assert [got[c, i] for i in range(len(xs))] == brute(xs)


def test_pixel_stats_are_numpys(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 255, (9, 4))
    df = spark.createDataFrame([(j, float(x[i, j])) for i in range(9) for j in range(4)], "d int, v double")
    for r in statistics.pixel_stats(df, ["d"], "v").collect():
        c = x[:, r.d]
        assert np.allclose([r.median, r.spread, r["mean"], r.variance], [np.median(c), 1.4826 * np.median(np.abs(c - np.median(c))), c.mean(), c.var()])


def test_prompt_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, "aaa"), (1, 2, " "), (1, 3, "bbbbb"), (1, 4, "c")], "k int, r int, t string")
    assert [r.t for r in statistics.prompt_budget(df, ["k"], "r", "t", 11).orderBy("r").collect()] == ["aaa"]


# ------------------------------------------------------------------ clean-up


def clean(spark, said, **at):
    df = words_df(spark, said, **at)
    return [r.text for r in cleanup.cleaned(df, ["k"], "pos", "text", "s", "e").orderBy("pos").collect()]


@pytest.mark.parametrize(("said", "left"), [
    ("э мы рассмотрим", "мы рассмотрим"), ("ээ ну вот смотрите", "смотрите"), ("то есть то есть важно", "то есть важно"),
    ("мы мы мы рассмотрим", "мы рассмотрим"), ("давайте рас- рассмотрим", "давайте рассмотрим"), ("очень очень важный результат", "очень очень важный результат"),
    ("как бы предел функции", "как бы предел функции"), ("два плюс два плюс два", "два плюс два плюс два"), ("Пусть n n стремится", "Пусть n n стремится"),
    ("Он он знает", "Он знает"), ("Это, это важно", "Это, это важно"), ("очень очень очень важно", "очень очень важно"), ("в в этом случае", "в этом случае"), ("э ээ", "э ээ"), ("конец. конец", "конец. конец"),
])
def test_cleanup_table(spark, said, left):
    assert clean(spark, said.split()) == left.split()


@pytest.mark.parametrize(("gaps", "goes"), [((0.4, 0.5), True), ((0.2, 0.5), False), ((0.4, 0.2), False)])
def test_ambiguous_phrase_needs_marks_and_pauses(spark, gaps, goes):
    said, t, out = "предел, как бы, равен нулю.".split(), 0.0, []
    for i, w in enumerate(said):
        t += gaps[0] if i == 1 else gaps[1] if i == 3 else 0.05
        out.append(("r", i, w, t, t + 0.5))
        t += 0.5
    df = spark.createDataFrame(out, "k string, pos long, text string, s double, e double")
    left = [r.text for r in cleanup.cleaned(df, ["k"], "pos", "text", "s", "e").orderBy("pos").collect()]
    assert left == (["предел,", "равен", "нулю."] if goes else said)


# ------------------------------------------------------- sections, paragraphs


def test_shift_boundaries_against_brute_force(spark):
    rng = random.Random(5)
    cases = []
    for c in range(40):
        t, ws = 0, []
        label = None
        for p in range(rng.randint(2, 30)):
            t += rng.choice([1, 1, 1, 6])
            if rng.random() < 0.2:
                label = rng.choice([None, 1, 2, 3])
            ws.append((c, p, rng.choice(["a", "b."]), t, t + 1, label))
            t += 1
        cases.append(ws)
    df = spark.createDataFrame([w for ws in cases for w in ws], "k int, pos long, text string, s int, e int, label int")
    marked = transcript.phrase_boundaries(df, "k", "pos", "text", "s", "e", 5)
    got = {(r.k, r.pos): r.section_label for r in transcript.shift_boundaries(marked, "k", "pos", "s", "label", 7).collect()}
    for c, ws in enumerate(cases):
        bound = [p > 0 and (ws[p][3] - ws[p - 1][4] >= 5 or ws[p - 1][2].endswith(".")) for p in range(len(ws))]
        cuts = [p for p in range(1, len(ws)) if ws[p][5] != ws[p - 1][5]]
        labels, new = [ws[0][5]] + [ws[p][5] for p in cuts], []
        for n, cut in enumerate(cuts):
            low, high = (new[-1] if new else 0) + 1, (cuts[n + 1] if n + 1 < len(cuts) else len(ws)) - 1
            near = [(abs(ws[p][3] - ws[cut][3]), p) for p in range(low, high + 1) if bound[p] and abs(ws[p][3] - ws[cut][3]) <= 7]
            new.append(min(near)[1] if near else cut)
        ends = [0, *new, len(ws)]
        assert [got[c, p] for p in range(len(ws))] == [labels[n] for n in range(len(labels)) for _ in range(ends[n], ends[n + 1])]


def test_absorb_short_against_brute_force(spark):
    rng = random.Random(6)
    cases = [[(rng.choice([None, None, 1]), rng.choice([5, 14, 15, 40])) for _ in range(rng.randint(1, 9))] for _ in range(80)]
    df = spark.createDataFrame([(c, i, s, 0, n) for c, xs in enumerate(cases) for i, (s, n) in enumerate(xs)], "k int, section_pos int, slide int, start int, end int")
    got = {(r.k, r.section_pos): r.target for r in transcript.absorb_short(df, "k", 15).collect()}
    for c, xs in enumerate(cases):
        want, last, pending = {}, None, []
        for i, (s, n) in enumerate(xs):
            if s is None and n < 15:
                if last is not None and xs[last][0] is not None:
                    want[i] = last
                else:
                    pending.append(i)
                continue
            for p in pending:
                want[p] = i if s is not None else p
            pending, want[i], last = [], i, i
        for p in pending:
            want[p] = p
        assert {i: got[c, i] for i in range(len(xs))} == want


def test_completeness_tells_lost_words(spark):
    w = words_df(spark, list("abcd"))
    s = spark.createDataFrame([("r", 0, 0, 1), ("r", 1, 3, 3)], "k string, section_pos int, first_word long, last_word long")
    assert rows(transcript.completeness(w, s, "k", "pos"), "k") == [("r", 4, 3, False)]


def test_paragraphs_and_text(spark):
    w = words_df(spark, ["пусть", "«", "x", "»", "равно", ",", "т.", "е.", "да", ".", "далее"], 1.0)
    p = paragraphs.split(w, ["k"], "pos", "text", "s", "e", paragraphs.ParagraphRules(2.5, 0.4, 9, 20, 100, 200))
    t = paragraphs.texts(p, ["k"], "pos", "text", "s")
    assert [r.text for r in t.orderBy("paragraph").collect()] == ["Пусть «x» равно, т. е. да.", "Далее"]
    assert paragraphs.split(w.limit(0), ["k"], "pos", "text", "s", "e").count() == 0


def test_timecodes_reset_where_shown(spark):
    p = spark.createDataFrame([("r", i, s, 0.0) for i, s in enumerate([10.0, 120.0, 200.0, 240.0, 700.0])], "k string, paragraph long, start double, anchor double")
    assert [r.timecode for r in paragraphs.timecodes(p, ["k"], "paragraph", "start", "anchor", 120).orderBy("paragraph").collect()] == [False, True, False, True, True]


# ---------------------------------------------------------------- text, OCR


def test_term_keys_join_forms(spark):
    df = spark.createDataFrame([(x,) for x in "уравнение уравнений корень корни ёлка день".split()], "w string")
    k = [r[0] for r in df.select(text.term_key(F.col("w"))).collect()]
    assert k[0] == k[1] and k[2] == k[3] and k[4] == "елка" and k[5] == "день"


@pytest.mark.parametrize(("line", "confidence", "kind"), [
    ("√2 + 1", 0.9, "formula"), ("x = 2", 0.9, "formula"), ("обычный текст", 0.9, "text"), ("скорость равна a = 5", 0.9, "text"), ("скорость = 5", 0.5, "formula"), ("почерк", 0.3, "text"), ("  ", 0.1, "text"), ("sin x = cos y", 0.9, "formula"),
])
def test_routing(spark, line, confidence, kind):
    df = spark.createDataFrame([(line, confidence)], "t string, c double")
    assert df.select(routing.route(F.col("t"), F.col("c"))).first()[0] == kind


def test_handwriting(spark):
    df = spark.createDataFrame([("почерк", 0.3), ("x = 1", 0.3), ("", 0.1), ("почерк", 0.35)], "t string, c double")
    assert [r[0] for r in df.select(routing.looks_like_handwriting(F.col("t"), F.col("c"))).collect()] == [True, False, False, False]


def test_markdown(spark):
    df = spark.createDataFrame([("> mark\n\n# Тема *урока* $x$ 10\nстрока  \n![a](b.png)",), ("",), ("$x$\n1. пункт",)], "m string")
    got = df.select(md.slide_title(F.col("m")), md.signature(F.col("m")), md.body(F.col("m"))).collect()
    assert got[0][0] == "Тема урока 10" and got[0][2] == "# Тема *урока* $x$ 10\nстрока" and got[1][1] is None and got[2][0] == "1. пункт"
    assert spark.range(1).select(md.timecode(F.lit(59.9)), md.timecode(F.lit(3600.0)), md.timecode(F.lit(-3.0), True), md.interval(F.lit(1), F.lit(3661))).first() == ("00:59", "1:00:00", "0:00:00", "0:00:01–1:01:01")


def test_reading_order(spark):
    f = spark.createDataFrame([("s", 0, (50, 3, 10, 10)), ("s", 1, (0, 0, 10, 10)), ("s", 2, (0, 30, 10, 10)), ("s", 3, None)], "k string, pos long, bbox struct<x:int,y:int,width:int,height:int>")
    assert [r.pos for r in ocr.reading_order(f, ["k"], "pos", "bbox").orderBy("place").collect()] == [1, 0, 2, 3]


def test_glossary_drops_decoration(spark):
    lines = [(1, s, p, t, "text", False, (0, 60 * p, 100, 20)) for s in range(4) for p, t in enumerate(["Онлайн школа", "Квадратное уравнение", f"корень уравнения Виета{s}"])]
    f = spark.createDataFrame(lines, "k int, slide int, pos int, text string, kind string, low_confidence boolean, bbox struct<x:int,y:int,width:int,height:int>")
    got = [r.term for r in glossary.build(f, "k", "slide", "pos", "text", "bbox").orderBy("rank").collect()]
    assert got and not any("школа" in g.lower() for g in got) and got[0] in ("уравнения", "корень")


# ----------------------------------------------------------- speech, pictures


def test_alignment_loses_no_mark():
    rng = random.Random(7)
    for _ in range(2000):
        said = ["".join(rng.choice("абвёxyz1") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))]
        marked = " ".join(rng.choice(["", "«", "("]) + (w.capitalize() if rng.random() < 0.3 else w) + rng.choice(["", ",", ".", "»", " —", "?!"]) for w in said)
        got = speech.align(said, marked)
        assert got is not None and len(got) == len(said)
        assert "".join("".join(got).split()) == "".join(marked.split())
        assert ["".join(c for c in g.lower().replace("ё", "е") if c.isalnum()) for g in got] == [w.replace("ё", "е") for w in said]


def test_alignment_rejects_changed_letters():
    assert speech.align(["да", "нет"], "Да, нед.") is None


def test_quiet_cuts():
    x = np.ones(100)
    x[70:72] = 0
    assert speech.quiet_cuts(x, 1, 100, 2) == [] and all(50 <= c <= 100 for c in speech.quiet_cuts(np.concatenate([x, x]), 1, 100, 2)[:1])
    cuts = speech.quiet_cuts(np.random.default_rng(0).normal(size=1000), 10, 20.0, 0.5)
    assert all(b - a <= 200 for a, b in zip([0, *cuts], [*cuts, 1000], strict=True))


def test_region_and_hash():
    m = np.zeros((60, 80), bool)
    m[10:40, 20:70] = True
    m[20, 30] = False
    m[55, 5] = True
    assert vision.mask_region(m)[0] == (20, 10, 50, 30)
    assert vision.mask_region(np.zeros((20, 20), bool))[0] is None
    g = np.where(m, 200.0, 20.0)
    assert vision.grown(g, (25, 15, 40, 20)) == (20, 10, 50, 30)
    a = np.random.default_rng(1).integers(0, 255, (90, 120))
    h = vision.phash(a)
    assert len(h) == 256 and (h == vision.phash(a)).all() and (h != vision.phash(a[::-1])).sum() > 43 > (h != vision.phash(a + 3)).sum()


def test_word_counts_do_not_depend_on_partitions(spark):
    from tidemark.plans import transcripts

    got = []
    for n in ("1", "4", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, transcripts.q44_transcript_markdown(spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == got[2]


def test_answers_of_models(spark):
    df = spark.createDataFrame([("a", "# T\n\n```md\n$$ x^2 $$\n\\[y\\]\nплюс $z$ да\n```"), ("b", None)], "k string, m string")
    got = ocr.parse_markdown(df, "m").orderBy("pos").collect()
    assert [(r.text, r.kind) for r in got] == [("# T", "text"), ("$x^2$", "formula"), ("$y$", "formula"), ("плюс $z$ да", "text")]
    f = spark.createDataFrame([("\\( a  b \\)",), ("$$",), ("$c$",)], "t string").select(ocr.latex_to_markdown(F.col("t"))).collect()
    assert [r[0] for r in f] == ["$a b$", "", "$c$"]


def test_speech_by_energy(spark):
    x = [0.0] * 40 + [0.5] * 60 + [0.0] * 6 + [0.5] * 30 + [0.0] * 64
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(x)], "k string, i int, x double")
    got = [(round(r.start, 3), round(r.end, 3)) for r in speech.detect(df, ["k"], "i", "x", 2, 0.2, min_silence=1.0, min_speech=0.2, pad=0.15).collect()]
    assert got == [(3.85, 13.75)]
    assert speech.vad_backend("auto", False)[0] == "energy" and speech.vad_backend("auto", True) == ("silero", [])


def test_layout_covers_without_gaps(spark):
    from tidemark.operators import layout

    r, q = (0, 0, 100, 80), (0, 0, 50, 40)
    shown = [None] * 5 + [r] * 30 + [q] * 30 + [r] * 3 + [None] * 2 + [r] * 30
    df = spark.createDataFrame([("k", i, float(i), s is not None, s or r) for i, s in enumerate(shown)], "k string, i int, t double, p boolean, g struct<x:int,y:int,width:int,height:int>")
    got = layout.layout_intervals(df, "k", "i", "t", "p", "g", 1.0, 2.0, 20.0).orderBy("piece").collect()
    assert [(x.start, x.end, x.present) for x in got] == [(0.0, 5.0, False), (5.0, 35.0, True), (35.0, 68.0, True), (68.0, 70.0, False), (70.0, 100.0, True)]
    assert got[0].region is None and tuple(got[1].region) == r


@pytest.mark.parametrize("closed", [False, True])
def test_within_against_brute_force(spark, closed):
    rng = np.random.default_rng(5)
    points = [(int(k), int(n), int(t)) for n, (k, t) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 120, 400)))]
    spans = []
    for k in range(4):
        edges = sorted(rng.choice(120, 12, replace=False).tolist())
        spans += [(k, i, a, b) for i, (a, b) in enumerate(zip(edges[::2], edges[1::2]))]
    spans.append((0, 99, 200, 200))
    points += [(0, 1000, 200), (2, 1001, None), (None, 1002, 5)]
    p = spark.createDataFrame(points, "k int, n int, t int")
    s = spark.createDataFrame(spans, "k int, i int, a int, b int")
    got = sorted(tuple(r) for r in intervals.within(p, s, "k", "t", "a", "b", "i", closed=closed).collect())
    want = sorted((k, n, t, i) for k, n, t in points if t is not None for q, i, a, b in spans if q == k and a <= t and (t <= b if closed else t < b))
    assert got == want and len(got) > 100


def test_folds_gather_all_in_order(spark):
    got = spark.range(1).select(F.aggregate(F.sequence(F.lit(1), F.lit(1000)), F.struct(*folds.nothing("int")), lambda a, x: F.struct(*folds.added(a, x, x % 3 > 0)), folds.gathered).alias("x")).first().x
    assert got == [x for x in range(1, 1001) if x % 3 > 0]
    none = spark.range(1).select(F.aggregate(F.array().cast("array<int>"), F.struct(*folds.nothing("int")), lambda a, x: F.struct(*folds.added(a, x)), folds.gathered).alias("x")).first().x
    assert none == []


def test_long_walks_stay_linear():
    words = [f"w{n}" for n in range(40_000)]
    began = time.perf_counter()
    assert cleanup.Collapser(cleanup.CleanupRules()).keep(words) == list(range(40_000))
    assert cleanup.Collapser(cleanup.CleanupRules()).keep(["ещё раз вот"] * 3 + words[:5]) == [2, 3, 4, 5, 6, 7]
    assert time.perf_counter() - began < 20


def test_refined_regions(spark):
    def rows(g, mask):
        return [(g, y, x, 200.0 if m else 10.0, bool(m)) for (y, x), m in np.ndenumerate(mask)]

    box = lambda y0, y1, x0, x1: np.pad(np.ones((y1 - y0, x1 - x0), bool), ((y0, 60 - y1), (x0, 80 - x1)))
    grid = box(10, 50, 20, 70)
    grid[:, 22:70:5] = False  # gaps that the weak closing bridges
    far = box(40, 58, 60, 79)
    stats = spark.createDataFrame(rows("same", box(10, 50, 20, 70)) + rows("lines", grid) + rows("far", far) + rows("dark", np.zeros((60, 80), bool)), "g string, y int, x int, b double, s boolean")
    rect = "struct<x:int,y:int,width:int,height:int>"
    groups = spark.createDataFrame([(g, (18, 8, 50, 40)) for g in ("same", "lines", "far", "dark", "unseen")], f"g string, rect {rect}")
    got = {r.g: (tuple(r.rect), r.refined) for r in vision.refine_regions(groups, stats, ["g"], "rect", "y", "x", "b", "s").collect()}
    assert got["same"] == ((20, 10, 50, 40), True) and got["lines"][1]
    assert all(got[g] == ((18, 8, 50, 40), False) for g in ("far", "dark", "unseen"))
    split = np.pad(np.ones((40, 50), bool), ((10, 10), (20, 10)))
    split[:, 42:48] = False  # a gap that only the usual closing bridges
    stats = spark.createDataFrame(rows("split", split), "g string, y int, x int, b double, s boolean")
    tries = {r.attempt: r.width for r in vision.find_regions(stats, ["g"], "y", "x", "b", "s", (vision.REFINE_CLOSE, vision.CLOSE)).collect()}
    assert tries[0] < 50 and tries[1] == 50
