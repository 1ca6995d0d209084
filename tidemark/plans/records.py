"""Queries over records of media, slides, fragments and results, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import routing
from ..operators import intervals, islands, layout, ocr, speech, vision
from ..sources import probe, sinks
from . import views as v

ID = "recording_id"


def q55_duration_text(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", md.duration(F.col("n_chars") / 8).alias("took"))


def q56_collect_words(spark, sf):
    """A segment for each turn; even turns have words, the others stand as one."""
    words = F.transform(F.split("text", " "), lambda w, n: F.struct(w.alias("word"), n.cast("double").alias("start"), (n + 0.5).alias("end"), F.lit(0.5).alias("probability")))
    one = F.struct("text", F.lit(0.0).alias("start"), F.lit(9.0).alias("end"), F.when(F.col("turn") % 2 == 0, words).alias("words"))
    c = v.table(spark, sf, "conversations").select("conv_id", "turn", F.array(one).alias("segments"))
    return speech.collect_words(c, "segments")


def q57_frame_grid(spark, sf):
    media = v.table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 7 + 0.5).alias("duration_s"))
    return probe.frame_times(media, "s_suppkey", 4.0)


def q58_picture_frames(spark, sf):
    files = v.table(spark, sf, "pages").select((F.col("page_id") % 10).alias("folder"), F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("path"))
    return probe.picture_frames(files, "folder", "path", 2.0)


def q59_number_slides(spark, sf):
    s = v.slides(v.words(spark, sf)).select(ID, F.col("s0").alias("start"), F.col("s1").alias("end"))
    return layout.number_slides(s, ID)


def q60_stale_pictures(spark, sf):
    name = lambda c: F.format_string("slides/slide_%03d.png", c)
    parts = v.table(spark, sf, "part")
    have = parts.select(name("p_partkey").alias("name")).union(parts.select(F.concat(F.lit("slides/"), "p_name", F.lit(".png"))))
    return sinks.stale(have, parts.where("p_size > 20").select(name("p_partkey").alias("name")), "name")


def q61_layout_groups(spark, sf):
    """Groups of near-equal frames within slides; those shorter than 8 s go."""
    w = v.words(spark, sf)
    found = v.slides(w).select(ID, F.col("slide_index").alias("piece"), F.lit(True).alias("present"), F.col("s0").alias("start"), F.col("s1").alias("end"))
    frames = w.select(ID, F.col("pos").alias("idx"), F.col("st").alias("ts"), (F.floor(F.col("pos") / 10) % 3 * 255).alias("hash"))
    return layout.groups_of_layout(frames, found, ID, "idx", "ts", "hash", 4, 4, threshold=5, min_group=8)


def q62_reach(spark, sf):
    return intervals.running_end(v.slides(v.words(spark, sf)), [ID], ["s0", "slide_index"], "s1").select(ID, "slide_index", "reach")


def q63_route_reason(spark, sf):
    f = v.fragments(spark, sf)
    return f.select("slide_index", "pos", routing.reason(F.col("text"), F.col("confidence")).alias("reason"))


def q64_formula_crops(spark, sf):
    """Boxes with a margin, the confidence of a formula in them, and whether it was routed by confidence alone."""
    f = v.fragments(spark, sf)
    box = ocr.crop(F.struct((F.col("bbox.x") - 38).alias("x"), F.col("bbox.y").alias("y"), F.col("bbox.width").alias("width"), F.col("bbox.height").alias("height")))
    return f.select("slide_index", "pos", box.alias("_b"), ocr.formula_confidence(F.col("confidence")).alias("confidence"), ((F.col("confidence") < 0.6) & ~routing.looks_like_formula(F.col("text"))).alias("low")).select("slide_index", "pos", "_b.*", "confidence", "low")


def q65_remapped_images(spark, sf):
    s = v.slides(v.words(spark, sf)).select(ID, "slide_index", F.concat(F.lit("a/"), F.col("slide_index").cast("string")).alias("image_path"))
    moved = s.where("slide_index % 3 = 0").withColumn("image_path", F.concat(F.lit("b/"), F.col("slide_index").cast("string")))
    return ocr.remapped(s, moved, [ID, "slide_index"])


def q66_ordered_warnings(spark, sf):
    """What is said first stands first, each text once."""
    rows = F.array_sort(F.collect_list(F.struct("us", "event_id", "event_type")))
    said = v.events(spark, sf).groupBy(ID).agg(rows.alias("rows"))
    return said.select(ID, F.array_join(F.array_distinct(F.transform("rows", lambda r: r["event_type"])), " > ").alias("warnings"))


def q67_presence(spark, sf):
    return v.table(spark, sf, "embeddings").select("vec_id", vision.present(F.transform("embedding", lambda x: x.cast("double") * 1000 + 128)).alias("present"))


def q68_last_frames(spark, sf):
    """The last five frames of each group of a recording, for its region to be looked for again."""
    f = v.flags(spark, sf).select(ID, "pos", F.floor(F.col("pos") / 12).alias("group_id"))
    return vision.last_frames(f, [ID, "group_id"], "pos")


def q69_recording_duration(spark, sf):
    from . import stages

    o = v.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias(ID), F.col("o_custkey").cast("double").alias("duration_s"))
    return stages.recording_duration({"audio": o.where("duration_s % 2 = 0"), "frames": o.withColumn("duration_s", F.col("duration_s") + 1)})


def q70_enough_samples(spark, sf):
    counted = v.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias(ID)).agg(F.count("*").alias("sample_size"), F.min("l_quantity").cast("double").alias("least"))
    return vision.enough(counted)


def q71_region_of_group(spark, sf):
    """The region found at a group's last frames, where it overlaps the group's by half; else the group's."""
    r = v.rects(spark, sf)
    w = islands.ordered([ID], ["pos"])
    both = r.withColumn("found", F.lead("rect").over(w))
    chosen = vision.refined(F.col("rect"), F.col("found"), intervals.iou(F.col("rect"), F.col("found")))
    return both.select(ID, "pos", chosen.alias("_r")).select(ID, "pos", "_r.*")


def q72_word_slide_points(spark, sf):
    """Words without length on slides: half-open first, then the slide that they end."""
    w = v.words(spark, sf)
    points = w.select(ID, "pos", F.col("st").alias("start"), F.col("st").alias("end"))
    s = v.slides(w).select(ID, "slide_index", (F.col("s0") - 5).alias("start"), (F.col("s1") - 4).alias("end"))
    return intervals.overlap_labels(points, s, ID, "slide_index", bucket=600).select(ID, "pos", F.coalesce("slide_index", F.lit(-1)).alias("slide"))


def q73_unreliable_slides(spark, sf):
    """Fragments that look like handwriting go, with their numbers kept."""
    f = ocr.mark_low(v.fragments(spark, sf))
    kept, dropped = ocr.drop_handwriting(f, ["slide_index"], "text", "confidence")
    return kept.groupBy("slide_index").agg(F.count("*").alias("kept")).join(dropped, "slide_index", "full").select("slide_index", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("dropped", F.lit(0)).alias("dropped"))


QUERIES = {k: f for k, f in globals().items() if k[0] == "q" and k[1:3].isdigit()}

_SIGNS = f"""a AS (SELECT slide_index, pos, confidence AS c, text, regexp_matches(text, '[{routing.STRONG}{routing.SCRIPT}{routing.GREEK}]') AS strong, regexp_matches(text, '[=+*/\\^_<>|\\\\−–—]') AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AS weak,
    coalesce(list_sum(list_transform(list_filter(regexp_extract_all(text, '[A-Za-zА-Яа-яЁё]{{3,}}'), lambda w: lower(w) NOT IN ({', '.join(f"'{w}'" for w in routing.MATH_WORDS)})), lambda w: length(w))), 0) / length(regexp_replace(text, '\\s+', '', 'g')) AS r FROM fragments),
    s AS (SELECT *, CASE WHEN strong THEN r <= 0.7 WHEN weak THEN r <= 0.5 ELSE false END AS like_formula FROM a)"""

ORACLES = {
    "q55_duration_text": """WITH t AS (SELECT doc_id, n_chars / 8 AS s, CAST(floor(n_chars / 8) AS BIGINT) AS w FROM documents)
        SELECT doc_id, CASE WHEN s < 60 THEN printf('%.1f с', round_even(s, 1)) ELSE printf('%d мин %02d с', w // 60, w % 60) END AS took FROM t""",
    "q56_collect_words": """WITH w AS (SELECT conv_id, turn, ws[i] AS t, i - 1 AS n FROM (SELECT conv_id, turn, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations WHERE turn % 2 = 0)) WHERE trim(ws[i]) <> '')
        SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) - 1 AS INT) AS pos, trim(t) AS text, CAST(n AS DOUBLE) AS start_s, n + CAST(0.5 AS DOUBLE) AS end_s, CAST(0.5 AS DOUBLE) AS confidence FROM w
        UNION ALL SELECT conv_id, turn, 0, trim(text), CAST(0 AS DOUBLE), CAST(9 AS DOUBLE), NULL FROM conversations WHERE turn % 2 <> 0 AND trim(text) <> ''""",
    "q57_frame_grid": "SELECT s_suppkey, CAST(i AS INT) AS idx, CAST(i / 4.0 AS DOUBLE) AS ts FROM (SELECT s_suppkey, unnest(range(0, CAST(floor((s_suppkey % 7 + 0.5) * 4) AS BIGINT))) AS i FROM supplier)",
    "q58_picture_frames": "SELECT folder, path, CAST(n AS INT) AS idx, CAST(n / 2.0 AS DOUBLE) AS ts FROM (SELECT page_id % 10 AS folder, url || '#' || page_id AS path, row_number() OVER (PARTITION BY page_id % 10 ORDER BY url || '#' || page_id) - 1 AS n FROM pages)",
    "q59_number_slides": f"""WITH {v.SLIDES} SELECT recording_id, s0 AS start, s1 AS "end", CAST(row_number() OVER (PARTITION BY recording_id ORDER BY s0, s1) AS INT) AS slide_index, CAST((s0 + s1) / 2 AS DOUBLE) AS representative_s FROM slides""",
    "q60_stale_pictures": "SELECT printf('slides/slide_%03d.png', p_partkey) AS name FROM part WHERE NOT p_size > 20",
    "q61_layout_groups": f"""WITH {v.SLIDES}, f AS (SELECT w.recording_id, s.slide_index AS piece, w.pos, w.st, w.pos // 10 % 3 AS h FROM words w JOIN slides s ON w.recording_id = s.recording_id AND w.st >= s.s0 AND w.st < s.s1),
        b AS (SELECT *, CASE WHEN (st - lag(st) OVER k > 6 AND st - lag(st) OVER k - 4 >= 4) OR (h > 0) <> (lag(h) OVER k > 0) THEN 1 ELSE 0 END AS n FROM f WINDOW k AS (PARTITION BY recording_id, piece ORDER BY pos)),
        g AS (SELECT *, sum(n) OVER (PARTITION BY recording_id, piece ORDER BY pos) AS group_id FROM b)
        SELECT recording_id, piece, CAST(group_id AS BIGINT) AS group_id, min(st) AS start, max(st) + 4 AS "end", arg_max(pos, st) AS representative, count(*) AS n FROM g GROUP BY recording_id, piece, group_id HAVING max(st) + 4 - min(st) >= 8""",
    "q62_reach": f"WITH {v.SLIDES} SELECT recording_id, slide_index, max(s1) OVER (PARTITION BY recording_id ORDER BY s0, slide_index ROWS UNBOUNDED PRECEDING) AS reach FROM slides",
    "q63_route_reason": f"""WITH {v.FRAGMENTS}, {_SIGNS}, z AS (SELECT *, CASE WHEN c < 0.6 THEN strong OR weak ELSE like_formula END AS f FROM s)
        SELECT slide_index, pos, CASE WHEN f AND c < 0.6 THEN 'formula: low confidence' WHEN f AND strong THEN 'formula: strong signs' WHEN f THEN 'formula: operators, few words'
            WHEN c < 0.35 AND NOT (strong OR weak) THEN 'text: handwriting' WHEN c < 0.6 THEN 'text: low confidence, no signs' ELSE 'text: words' END AS reason FROM z""",
    "q64_formula_crops": f"""WITH {v.FRAGMENTS}, {_SIGNS}
        SELECT slide_index, pos, 0 AS x, CAST(pos * 60 + 54 AS INT) AS y, CAST(2 + length(text) * 10 + 6 AS INT) AS width, CAST(52 AS INT) AS height, least(CAST(0.85 AS DOUBLE), c) AS confidence, c < 0.6 AND NOT like_formula AS low FROM s""",
    "q65_remapped_images": f"WITH {v.SLIDES} SELECT recording_id, slide_index, CASE WHEN slide_index % 3 = 0 THEN 'b/' ELSE 'a/' END || slide_index AS image_path FROM slides",
    "q66_ordered_warnings": "SELECT recording_id, string_agg(event_type, ' > ' ORDER BY u, e) AS warnings FROM (SELECT user_id AS recording_id, event_type, min(ts) AS u, arg_min(event_id, (ts, event_id)) AS e FROM events GROUP BY ALL) GROUP BY recording_id",
    "q67_presence": "SELECT vec_id, coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) * 1000 + 128 >= 150)) / len(embedding) >= 0.4, false) AS present FROM embeddings",
    "q68_last_frames": f"WITH {v.FLAGS} SELECT recording_id, pos, pos // 12 AS group_id FROM flags QUALIFY row_number() OVER (PARTITION BY recording_id, pos // 12 ORDER BY pos DESC) <= 5",
    "q69_recording_duration": "SELECT CAST(o_orderkey AS VARCHAR) AS recording_id, CAST(o_custkey + CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS duration_s FROM orders",
    "q70_enough_samples": "SELECT l_orderkey AS recording_id, count(*) AS sample_size, CAST(min(l_quantity) AS DOUBLE) AS least FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3",
    "q71_region_of_group": f"""WITH {v.RECTS}, n AS (SELECT *, lead(x) OVER k AS nx, lead(y) OVER k AS ny, lead(width) OVER k AS nw, lead(height) OVER k AS nh FROM rects WINDOW k AS (PARTITION BY recording_id ORDER BY pos)),
        i AS (SELECT *, greatest(0, least(x + width, nx + nw) - greatest(x, nx)) * greatest(0, least(y + height, ny + nh) - greatest(y, ny)) AS common FROM n),
        t AS (SELECT *, nx IS NOT NULL AND common / (width * height + nw * nh - common) >= 0.5 AS take FROM i)
        SELECT recording_id, CAST(pos AS INT) AS pos, CAST(CASE WHEN take THEN nx ELSE x END AS INT) AS x, CAST(CASE WHEN take THEN ny ELSE y END AS INT) AS y, CASE WHEN take THEN nw ELSE width END AS width, CASE WHEN take THEN nh ELSE height END AS height FROM t""",
    "q72_word_slide_points": f"""WITH {v.SLIDES}, z AS (SELECT recording_id, slide_index, s0 - 5 AS a, s1 - 4 AS e FROM slides),
        m AS (SELECT w.recording_id, w.pos, arg_min(z.slide_index, (CASE WHEN w.st < z.e THEN 0 ELSE 1 END, z.slide_index)) AS slide FROM words w JOIN z ON w.recording_id = z.recording_id AND z.a <= w.st AND w.st <= z.e GROUP BY ALL)
        SELECT w.recording_id, w.pos, coalesce(slide, -1) AS slide FROM words w LEFT JOIN m ON w.recording_id = m.recording_id AND w.pos = m.pos""",
    "q73_unreliable_slides": f"WITH {v.FRAGMENTS}, {_SIGNS} SELECT slide_index, count(*) FILTER (NOT (c < 0.35 AND NOT (strong OR weak))) AS kept, count(*) FILTER (c < 0.35 AND NOT (strong OR weak)) AS dropped FROM s GROUP BY slide_index",
}
