"""Queries over events, frames, rectangles and audio stand-ins, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals, islands, statistics
from . import views as v

ID = "recording_id"
HOUR = 3_600_000_000


def q01_event_runs(spark, sf):
    t = islands.run_table(v.events(spark, sf), [ID], ["us", "event_id"], "event_type")
    return t.select(ID, "run_id", "event_type", "n", "first_us")


def q02_sessions_by_gap(spark, sf):
    s = islands.sessions(v.events(spark, sf), [ID], ["us", "event_id"], "us", 12 * HOUR)
    return s.groupBy(ID, "session_id").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n"))


def _speech(spark, sf):
    e = v.events(spark, sf)
    return e.select(ID, F.col("us").alias("a"), (F.col("us") + F.round(F.col("value") * 100).cast("long") * 1_000_000).alias("z"))


def q03_merge_and_pad(spark, sf):
    return intervals.merge_and_pad(_speech(spark, sf), [ID], "a", "z", 2 * HOUR, HOUR // 2, HOUR // 4, F.lit(1706659200000000)).select(ID, F.col("a").alias("start_us"), F.col("z").alias("end_us"))


def q04_mask_intervals(spark, sf):
    m = islands.mask_intervals(v.flags(spark, sf), [ID], "pos", "present", 3)
    return m.select(ID, "start", "end", (F.sum(F.col("end") - F.col("start")).over(Window.partitionBy(ID))).alias("total"))


def q05_presence_smoothing(spark, sf):
    return islands.smooth_presence(v.flags(spark, sf, 20.0), [ID], ["pos"], "present", 1, 3).select(ID, "pos", "smoothed")


def q06_frame_groups(spark, sf):
    f = v.frames(spark, sf).withColumn("ts", F.col("idx"))
    g = islands.frame_groups(f, [ID], ["idx"], "ts", "hash", 10, 25, 33)
    return islands.group_table(g, [ID], "group_id", "ts", "idx", 10).select(ID, "group_id", "start", "end", "representative", "n")


def q27_robust_pixel_stats(spark, sf):
    p = v.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double") * 1000)
    s = statistics.pixel_stats(p, ["label", "dim"], "x")
    r = lambda c: F.round(c, 4)
    return s.select("label", "dim", r("median").alias("median"), r("spread").alias("spread"), r("mean").alias("mean"), r("variance").alias("variance"), statistics.static_and_bright(F.col("spread"), F.col("median"), 150.0, 0.0).alias("static"))


def q28_step_and_tiling(spark, sf):
    e = v.events(spark, sf)
    return intervals.tile(e, [ID], "us", 48 * HOUR).join(intervals.median_step(e, [ID], "us"), ID)


def q29_uniform_sample(spark, sf):
    d = v.table(spark, sf, "documents").select("source", "doc_id")
    return islands.uniform_sample(d, ["source"], ["doc_id"], 7)


def q30_rect_iou_split(spark, sf):
    p = intervals.split_by_region(v.rects(spark, sf), [ID], ["pos"], "rect", 0.75)
    return p.select(ID, "pos", "piece_id")


def q31_merge_short_pieces(spark, sf):
    e = v.events(spark, sf)
    t = islands.run_table(e, [ID], ["us", "event_id"], "event_type")
    return islands.merge_short_pieces(t, [ID], ["run_id"], "n", 2).select(ID, "run_id", "piece_id")


def q32_union_rect(spark, sf):
    u = v.rects(spark, sf).groupBy(ID).agg(intervals.union_rect("rect").alias("r"))
    return u.select(ID, "r.x", "r.y", "r.width", "r.height")


def q33_dbfs_threshold(spark, sf):
    s = v.flags(spark, sf).select(ID, "pos", (F.col("value") / 500).alias("x"))
    m = statistics.speech_mask(statistics.energy(s, [ID], "pos", "x", 16), [ID], -45.0, -6.0)
    return m.select(ID, "frame", F.round("dbfs", 6).alias("dbfs"), F.round("threshold", 6).alias("threshold"), "speech")


def q35_to_absolute_clamp(spark, sf):
    e = v.flags(spark, sf)
    low, high = F.col("pos") * 10, F.col("pos") * 10 + 8
    a, z = intervals.to_absolute(F.floor("value") - 5, F.floor(F.col("value") / 2), low, high)
    return e.select(ID, "pos", a.alias("start"), z.alias("end"))


def q47_dominant_size(spark, sf):
    r = v.rects(spark, sf).select((F.col(ID) % 100).alias(ID), "pos", F.col("rect.x").alias("width"), F.col("rect.y").alias("height"), (F.col(ID) * 100 + F.col("pos")).alias("idx"))
    s = statistics.dominant_size(r, [ID], "idx")
    return s.select(ID, "size.width", "size.height")


def q48_interval_coverage(spark, sf):
    e = v.events(spark, sf)
    runs = islands.run_table(e, [ID], ["us", "event_id"], "event_type").withColumn("record_end", F.lit(1706659200000000))
    return islands.cover(runs, [ID], "first_us", "record_end").select(ID, "run_id", "first_us", "end")


def q49_scale_and_clamp(spark, sf):
    r = v.rects(spark, sf)
    c = intervals.clamp_rect(intervals.scale_rect(F.col("rect"), 0.25, 0.5), F.lit(20), F.lit(15))
    return r.select(ID, "pos", c.alias("c")).select(ID, "pos", "c.x", "c.y", "c.width", "c.height")


QUERIES = {k: f for k, f in globals().items() if k[0] == "q" and k[1:3].isdigit()}

_EV = "ev AS (SELECT user_id AS recording_id, event_id, epoch_us(ts) AS us, event_type, value FROM events)"
_RUNS = _EV + """, b AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS f
    FROM ev WINDOW w AS (PARTITION BY recording_id ORDER BY us, event_id)),
    r AS (SELECT *, CAST(sum(f) OVER (PARTITION BY recording_id ORDER BY us, event_id) AS BIGINT) AS run_id FROM b),
    t AS (SELECT recording_id, run_id, event_type, count(*) AS n, min(us) AS first_us FROM r GROUP BY ALL)"""

ORACLES = {
    "q01_event_runs": f"WITH {_RUNS} SELECT * FROM t",
    "q02_sessions_by_gap": f"""WITH {_EV}, b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY recording_id ORDER BY us, event_id) >= {12 * HOUR} THEN 1 ELSE 0 END AS f FROM ev),
        s AS (SELECT *, CAST(sum(f) OVER (PARTITION BY recording_id ORDER BY us, event_id) AS BIGINT) AS session_id FROM b)
        SELECT recording_id, session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY ALL""",
    "q03_merge_and_pad": f"""WITH s AS (SELECT user_id AS recording_id, epoch_us(ts) AS a, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 1000000 AS z FROM events),
        f AS (SELECT *, CASE WHEN a - max(z) OVER w >= {2 * HOUR} THEN 1 ELSE 0 END AS f FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        g AS (SELECT *, sum(f) OVER (PARTITION BY recording_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM f),
        m AS (SELECT recording_id, g, min(a) AS a, max(z) AS z FROM g GROUP BY ALL),
        p AS (SELECT recording_id, greatest(0, a - {HOUR // 4}) AS a, least(1706659200000000, z + {HOUR // 4}) AS z FROM m WHERE z - a >= {HOUR // 2}),
        f2 AS (SELECT *, CASE WHEN a - max(z) OVER w > 0 THEN 1 ELSE 0 END AS f FROM p WINDOW w AS (PARTITION BY recording_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        g2 AS (SELECT *, sum(f) OVER (PARTITION BY recording_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM f2)
        SELECT recording_id, min(a) AS start_us, max(z) AS end_us FROM g2 GROUP BY recording_id, g""",
    "q04_mask_intervals": f"""WITH {v.FLAGS}, i AS (SELECT *, pos - row_number() OVER (PARTITION BY recording_id ORDER BY pos) AS g FROM flags WHERE present),
        m AS (SELECT recording_id, min(pos) * 3 AS start, (max(pos) + 1) * 3 AS "end" FROM i GROUP BY recording_id, g)
        SELECT *, CAST(sum("end" - start) OVER (PARTITION BY recording_id) AS BIGINT) AS total FROM m""",
    "q05_presence_smoothing": f"""WITH {v.FLAGS.replace("30.0", "20.0")},
        a AS (SELECT *, pos - row_number() OVER (PARTITION BY recording_id, present ORDER BY pos) AS g FROM flags),
        b AS (SELECT recording_id, pos, present AND count(*) OVER (PARTITION BY recording_id, present, g) > 2 AS f FROM a),
        c AS (SELECT *, pos - row_number() OVER (PARTITION BY recording_id, f ORDER BY pos) AS g FROM b),
        d AS (SELECT *, count(*) OVER (PARTITION BY recording_id, f, g) AS n, min(pos) OVER (PARTITION BY recording_id, f, g) AS lo, max(pos) OVER (PARTITION BY recording_id, f, g) AS hi, max(pos) OVER (PARTITION BY recording_id) AS last FROM c)
        SELECT recording_id, pos, f OR (n < 3 AND lo > 0 AND hi < last) AS smoothed FROM d""",
    "q06_frame_groups": """WITH f AS (SELECT label AS recording_id, vec_id AS idx, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
        n AS (SELECT *, lag(bits) OVER w AS pb, idx - lag(idx) OVER w AS gap FROM f WINDOW w AS (PARTITION BY recording_id ORDER BY idx)),
        b AS (SELECT *, CASE WHEN pb IS NULL THEN 0 WHEN (gap > 15 AND gap - 10 >= 25) OR list_sum(list_transform(list_zip(bits, pb), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) >= 33 THEN 1 ELSE 0 END AS brk FROM n),
        g AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY recording_id ORDER BY idx) AS BIGINT) AS group_id FROM b)
        SELECT recording_id, group_id, min(idx) AS start, max(idx) + 10 AS "end", max(idx) AS representative, count(*) AS n FROM g GROUP BY recording_id, group_id""",
    "q27_robust_pixel_stats": """WITH p AS (SELECT label, CAST(i - 1 AS INT) AS dim, CAST(embedding[i] AS DOUBLE) * 1000 AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
        s AS (SELECT label, dim, median(x) AS median, mad(x) * 1.4826 AS spread, avg(x) AS mean, var_pop(x) AS variance FROM p GROUP BY ALL)
        SELECT label, dim, round(median, 4) AS median, round(spread, 4) AS spread, round(mean, 4) AS mean, round(variance, 4) AS variance, spread <= 150 AND median >= 0 AS static FROM s""",
    "q28_step_and_tiling": f"""WITH {_EV}, m AS (SELECT recording_id, min(us) AS a, max(us) AS z FROM ev GROUP BY ALL),
        tiles AS (SELECT recording_id, a, unnest(range(0, (z - a) // {48 * HOUR} + 1)) AS tile FROM m),
        c AS (SELECT ev.recording_id, (us - a) // {48 * HOUR} AS tile, count(*) AS n FROM ev JOIN m USING (recording_id) GROUP BY ALL),
        d AS (SELECT recording_id, us - lag(us) OVER (PARTITION BY recording_id ORDER BY us) AS d FROM ev), st AS (SELECT recording_id, CASE WHEN median(d) > 0 THEN CAST(median(d) AS DOUBLE) ELSE 1.0 END AS step FROM d GROUP BY ALL)
        SELECT tiles.recording_id, tile, coalesce(n, 0) AS n, step FROM tiles LEFT JOIN c USING (recording_id, tile) JOIN st USING (recording_id)""",
    "q29_uniform_sample": """WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents),
        k AS (SELECT DISTINCT source, CAST(round_even(k * ((n - 1) / 6.0), 0) AS BIGINT) AS pos FROM (SELECT DISTINCT source, n FROM p), (SELECT unnest(range(0, 7)) AS k) WHERE n > 7)
        SELECT source, doc_id FROM p WHERE n <= 7 UNION ALL SELECT source, doc_id FROM p JOIN k USING (source, pos)""",
    "q30_rect_iou_split": f"""WITH {v.RECTS}, n AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(width) OVER w AS pw, lag(height) OVER w AS ph FROM rects WINDOW w AS (PARTITION BY recording_id ORDER BY pos)),
        o AS (SELECT *, least(x + width, px + pw) - greatest(x, px) AS iw, least(y + height, py + ph) - greatest(y, py) AS ih FROM n),
        c AS (SELECT *, CASE WHEN px IS NULL THEN 0 WHEN iw > 0 AND ih > 0 THEN CASE WHEN CAST(iw * ih AS DOUBLE) / (width * height + pw * ph - iw * ih) < 0.75 THEN 1 ELSE 0 END ELSE 1 END AS cut FROM o)
        SELECT recording_id, CAST(pos AS INT) AS pos, CAST(sum(cut) OVER (PARTITION BY recording_id ORDER BY pos) AS BIGINT) AS piece_id FROM c""",
    "q31_merge_short_pieces": f"""WITH {_RUNS}, g AS (SELECT *, sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY run_id) AS g FROM t),
        l AS (SELECT recording_id, sum(CASE WHEN g = 0 THEN n ELSE 0 END) AS lead, max(CASE WHEN g = 0 THEN 1 ELSE 0 END) AS has0, max(g) AS most FROM g GROUP BY ALL)
        SELECT recording_id, run_id, CAST(CASE WHEN has0 = 1 AND lead < 2 AND most >= 1 THEN greatest(g, 1) - 1 WHEN has0 = 1 THEN g ELSE g - 1 END AS BIGINT) AS piece_id FROM g JOIN l USING (recording_id)""",
    "q32_union_rect": f"WITH {v.RECTS} SELECT recording_id, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM rects GROUP BY recording_id",
    "q33_dbfs_threshold": f"""WITH {v.FLAGS}, e AS (SELECT recording_id, pos // 16 AS frame, 20 * log10(greatest(sqrt(avg((value / 500) * (value / 500))), 1e-12)) AS dbfs FROM flags GROUP BY ALL HAVING count(*) = 16),
        t AS (SELECT *, greatest(-45.0, max(dbfs) OVER (PARTITION BY recording_id) - 6.0) AS threshold FROM e)
        SELECT recording_id, frame, round(dbfs, 6) AS dbfs, round(threshold, 6) AS threshold, dbfs >= threshold AS speech FROM t""",
    "q35_to_absolute_clamp": f"""WITH {v.FLAGS}, a AS (SELECT recording_id, pos, least(greatest(pos * 10 + CAST(floor(value) AS BIGINT) - 5, pos * 10), pos * 10 + 8) AS start, least(greatest(pos * 10 + CAST(floor(value / 2) AS BIGINT), pos * 10), pos * 10 + 8) AS e FROM flags)
        SELECT recording_id, pos, start, greatest(start, e) AS "end" FROM a""",
    "q47_dominant_size": f"""WITH {v.RECTS}, c AS (SELECT recording_id % 100 AS recording_id, x AS width, y AS height, count(*) AS n, min(recording_id * 100 + pos) AS i FROM rects GROUP BY ALL)
        SELECT recording_id, arg_max(width, (n, -i)) AS width, arg_max(height, (n, -i)) AS height FROM c GROUP BY recording_id""",
    "q48_interval_coverage": f"""WITH {_RUNS} SELECT recording_id, run_id, first_us, coalesce(lead(first_us) OVER (PARTITION BY recording_id ORDER BY first_us), 1706659200000000) AS "end" FROM t""",
    "q49_scale_and_clamp": f"""WITH {v.RECTS}, s AS (SELECT recording_id, CAST(pos AS INT) AS pos, CAST(round_even(x * 0.25, 0) AS INT) AS x, CAST(round_even(y * 0.5, 0) AS INT) AS y, greatest(1, CAST(round_even(width * 0.25, 0) AS INT)) AS width, greatest(1, CAST(round_even(height * 0.5, 0) AS INT)) AS height FROM rects),
        c AS (SELECT recording_id, pos, least(greatest(x, 0), 19) AS x, least(greatest(y, 0), 14) AS y, width, height FROM s)
        SELECT recording_id, pos, x, y, greatest(1, least(width, 20 - x)) AS width, greatest(1, least(height, 15 - y)) AS height FROM c""",
}
