"""Queries over words, slides and documents' lines, with their SQL. Times are tenths of a second."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import routing
from ..functions.text import joined_words, line_key, normalized, term_key
from ..operators import assembly, cleanup, glossary, intervals, islands, layout, ocr, paragraphs, speech, statistics, transcript
from ..sources import probe
from . import views as v

ID = "recording_id"


def _labelled(spark, sf):
    w = v.words(spark, sf)
    s = v.slides(w).select(ID, F.col("slide_index").alias("slide"), F.col("s0").alias("st"), F.col("s1").alias("en"))
    return intervals.overlap_labels(w, s, ID, "slide", "st", "en", bucket=600)


def q07_word_slide_overlap(spark, sf):
    return _labelled(spark, sf).select(ID, "pos", F.coalesce("slide", F.lit(-1)).alias("slide"))


def _bounded(spark, sf):
    return transcript.phrase_boundaries(_labelled(spark, sf), ID, "pos", "text", "st", "en", 4.5)


def q08_phrase_boundaries(spark, sf):
    return transcript.phrase_boundaries(v.words(spark, sf), ID, "pos", "text", "st", "en", 4.5).select(ID, "pos", "boundary")


def _sections(spark, sf):
    w = islands.runs(_labelled(spark, sf), [ID], ["pos"], "slide", "run")
    s = v.slides(v.words(spark, sf))
    return w, transcript.sections(w, s, ID, "pos", "st", "en", "slide", "run", "slide_index", "s0", "s1")


def q09_sections(spark, sf):
    return _sections(spark, sf)[1].select(ID, "section_pos", F.coalesce("slide", F.lit(-1)).alias("slide"), "start", "end", "first_word", "last_word")


def q10_completeness(spark, sf):
    w, s = _sections(spark, sf)
    return transcript.completeness(w, s, ID, "pos")


def q11_boundary_shift(spark, sf):
    return transcript.shift_boundaries(_bounded(spark, sf), ID, "pos", "st", "slide", 20).select(ID, "pos", F.coalesce("section_label", F.lit(-1)).alias("section_label"))


def q12_absorb_short(spark, sf):
    return transcript.absorb_short(_sections(spark, sf)[1], ID, 150).select(ID, "section_pos", "target")


def q13_same_content_groups(spark, sf):
    d = v.table(spark, sf, "documents").withColumn("content", md.signature(F.concat(F.lit("  "), "lang", F.lit(" \n "), F.lit(md.LOW_CONFIDENCE_MARK))))
    return transcript.same_content_groups(d, "source", ["doc_id"], "content", F.col("doc_id") % 5 != 0).select("source", "doc_id", "content", "group_id")


FILLERS = cleanup.CleanupRules(fillers=("la", "the", "die"), phrases=(("of", "and"), ("in", "a"), ("de", "en")), ambiguous=(("and", "in"), ("der", "und"), ("et", "le")), doubles=(), content=(), service_letters=(), gap=1)


def q14_fillers(spark, sf):
    return cleanup.mark_fillers(v.words(spark, sf), [ID], "pos", "text", "st", "en", FILLERS).select(ID, "pos", "filler")


def q15_repeat_collapse(spark, sf):
    return cleanup.collapse_repeats(v.words(spark, sf), [ID], "pos", "text", FILLERS, (1,)).select(ID, "pos", "text")


def q16_truncated_starts(spark, sf):
    w = v.words(spark, sf)
    cut = F.when(F.col("pos") % 9 == 0, F.concat(F.substring(F.lead("text").over(islands.ordered([ID], ["pos"])), 1, 2), F.lit("-"))).otherwise(F.col("text"))
    return cleanup.mark_truncated(w.withColumn("text", F.coalesce(cut, F.col("text"))), [ID], "pos", "text").select(ID, "pos", "truncated")


PARAGRAPHS = paragraphs.ParagraphRules(25, 8, 100, 300, 40, 120)


def q17_paragraph_split(spark, sf):
    return paragraphs.split(v.words(spark, sf), [ID], "pos", "text", "st", "en", PARAGRAPHS).select(ID, "pos", "paragraph")


def q18_timecode_emission(spark, sf):
    p = v.words(spark, sf).withColumn("block", F.floor(F.col("pos") / 7)).groupBy(ID, "block").agg(F.min("st").alias("start")).withColumn("anchor", F.lit(0))
    t = paragraphs.timecodes(p, [ID], "block", "start", "anchor", 200)
    return t.where("timecode").select(ID, "block", md.timecode(F.col("start") / 10, True).alias("code"), md.timecode(F.col("start") * 10).alias("short_code"))


def q19_paragraph_text(spark, sf):
    w = v.words(spark, sf).groupBy(ID, "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("l"))
    return w.select(ID, "turn", joined_words(F.col("l.text")).alias("text"))


GLOSSARY = glossary.GlossaryRules(decoration_ratio=0.15, most_terms=50)


def q20_glossary_counts(spark, sf):
    t = v.fragments(spark, sf).select(F.explode(glossary.terms_of(F.col("text"))).alias("surface"))
    return t.select(glossary.key_of(F.col("surface")).alias("key"), "surface").groupBy("key", "surface").agg(F.count("*").alias("n"))


def q21_glossary_topk(spark, sf):
    return glossary.build(v.fragments(spark, sf), ID, "slide_index", "pos", "text", "bbox", GLOSSARY)


def q22_decoration_lines(spark, sf):
    return glossary.decoration(v.fragments(spark, sf), ID, "slide_index", "text", "bbox", glossary.GlossaryRules(decoration_ratio=0.1, stable_ratio=0.2, tolerance=100))


def q23_ocr_row_order(spark, sf):
    f = v.fragments(spark, sf).select("slide_index", F.col("pos").cast("bigint").alias("pos"), F.struct((F.col("pos") * 37 % 101).alias("x"), (F.col("pos") * 17 % 90).alias("y"), F.lit(50).alias("width"), (F.length("text") % 5 * 10 + 10).alias("height")).alias("bbox"))
    return ocr.reading_order(f, ["slide_index"], "pos", "bbox").select("slide_index", "pos", "row", "place")


def q24_low_confidence(spark, sf):
    return ocr.unreliable(ocr.mark_low(v.fragments(spark, sf)), [ID, "slide_index"])


def q25_route_lines(spark, sf):
    t, c = F.col("text"), F.col("confidence")
    f = v.fragments(spark, sf).withColumn("_strong", routing.has_strong(t)).withColumn("_signal", routing.has_signal(t)).withColumn("_ratio", routing.word_ratio(t))
    signs = (F.col("_strong"), F.col("_signal"), F.col("_ratio"))
    return f.select("slide_index", "pos", routing.route(t, c, signs=signs).alias("route"), F.round("_ratio", 6).alias("ratio"), routing.looks_like_handwriting(t, c, signs=signs).alias("handwriting"))


def q26_escape_markdown(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", md.escape(F.col("html")).alias("escaped"))


def q34_distribute_words(spark, sf):
    w = statistics.distribute(v.words(spark, sf), [ID, "turn"], "pos", "text", F.lit(60.0))
    return w.select(ID, "turn", "pos", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def q36_validate_words(spark, sf):
    w = v.words(spark, sf).withColumn("st", F.when(F.col("pos") % 11 == 3, F.col("st") - 9).otherwise(F.col("st")))
    return intervals.validate_words(w, [ID], "pos", "st", "en", F.lit(2000))


def q37_validate_intervals(spark, sf):
    return intervals.validate_intervals(v.slides(v.words(spark, sf)), [ID], "slide_index", "s0", "s1")


def q38_prompt_budget(spark, sf):
    t = v.table(spark, sf, "documents").select("source", "doc_id", F.trim("text").alias("term"))
    kept = statistics.prompt_budget(t, ["source"], "doc_id", "term", 20_000)
    return statistics.prompt(kept, ["source"], "doc_id", "term")


def q39_distinct_content_hash(spark, sf):
    d = v.table(spark, sf, "documents").select("source", "doc_id", F.sha2("text", 256).alias("digest"))
    return d.groupBy("source", "digest").agg(F.min("doc_id").alias("doc_id"))


def q40_word_chunks(spark, sf):
    return speech.chunked(v.words(spark, sf), "pos").groupBy(ID, "chunk").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"))


def q41_section_headings(spark, sf):
    d = v.table(spark, sf, "documents")
    return d.select("doc_id", md.slide_title(F.col("text"), 40).alias("title"), md.interval(F.col("doc_id") * 7.5, F.col("doc_id") * 11).alias("interval"))


def q42_metadata(spark, sf):
    c = v.table(spark, sf, "conversations")
    return c.groupBy(F.col("conv_id").alias(ID)).agg(F.count("*").alias("turns"), F.count_distinct("role").alias("n_roles"), F.array_join(F.array_sort(F.collect_set("role")), ", ").alias("roles"))


def q43_media_probe(spark, sf):
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"format":{"duration":"'), k, F.lit('.5"},"streams":[{"index":0,"codec_type":"video","codec_name":"mjpeg","disposition":{"attached_pic":1}},{"index":1,"codec_type":"video","codec_name":"h264","width":640,"height":360,"avg_frame_rate":"0/0","r_frame_rate":"'), k, F.lit('/4"},{"index":2,"codec_type":"audio","codec_name":"aac","sample_rate":"48000","channels":2,"duration":"9","tags":{"LANGUAGE":"ru","title":" "}}]}'))
    m = probe.select_track(probe.parse(v.table(spark, sf, "events").select("event_id", text.alias("json")), "json"))
    return m.select("event_id", "duration_s", F.col("video.index").alias("video_index"), F.round("video.fps", 6).alias("fps"), F.col("track.language").alias("language"), F.col("track.title").alias("title"), F.col("track.sample_rate").alias("sample_rate"), F.size("audio_tracks").alias("n_audio"))


def _seconds(spark, sf):
    w = v.words(spark, sf)
    s = v.slides(w).select(F.col(ID).cast("string"), F.col("slide_index").cast("int"), (F.col("s0") / 10).alias("start_s"), (F.col("s1") / 10).alias("end_s"), F.format_string("slides/slide_%03d.png", F.col("slide_index")).alias("image_path"))
    return w.select(F.col(ID).cast("string"), "pos", "text", (F.col("st") / 10).alias("start_s"), (F.col("en") / 10).alias("end_s")), s


def q44_transcript_markdown(spark, sf):
    """Words and slides of every conversation to a Markdown transcript. Rows only: the parts have their own SQL."""
    w, s = _seconds(spark, sf)
    o = s.select(ID, "slide_index", F.concat(F.lit("# "), F.lit("Topic "), (F.col("slide_index") % 2).cast("string"), F.lit("\n\nbody")).alias("markdown"), (F.col("slide_index") % 4 == 0).alias("unreliable"))
    rules = assembly.AssemblyRules(cleanup=FILLERS)
    return assembly.assemble(w, s, o, w.groupBy(ID).agg(F.create_map(F.lit("words"), F.count("*").cast("string"), F.lit("source"), F.concat(F.lit("conversation "), ID)).alias("metadata")), rules)


def q45_split_quiet_point(spark, sf):
    f = v.flags(spark, sf).groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("l"))
    x = f.select(ID, F.transform("l", lambda p: p["value"] / 500).alias("samples"))
    return speech.split_quiet(x, "samples", F.lit(1), 20.0, 2.0).select(ID, "cuts")


def _marks():
    def punctuate(text):
        words = text.split(" ")
        return " ".join(w + ("," if i % 5 == 4 else "") for i, w in enumerate(words)).capitalize() + "."

    return punctuate


def q46_punctuation_align(spark, sf):
    w = v.words(spark, sf).withColumn("text", F.regexp_replace("text", "[^\\p{L}\\p{N}]", ""))
    return speech.restore_punctuation(w, [ID], "pos", "text", _marks).select(ID, "pos", "punctuated", "applied")


def q53_detect_speech(spark, sf):
    s = v.flags(spark, sf).select(ID, "pos", (F.col("value") / 500).alias("x"))
    return speech.detect(s, [ID], "pos", "x", 4, 4.0, relative=-6.0, min_silence=5.0, min_speech=4.5, pad=1.0)


def q54_layout_intervals(spark, sf):
    f = v.flags(spark, sf, 20.0).withColumn("ts", F.col("pos").cast("double"))
    region = F.when(F.col("pos") % 40 < 25, F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(100).alias("width"), F.lit(80).alias("height"))).otherwise(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(50).alias("width"), F.lit(40).alias("height")))
    return layout.layout_intervals(f.withColumn("region", region), ID, "pos", "ts", "present", "region", 1.0, 3.0, 5.0).select(ID, "piece", "start", "end", "present", F.coalesce("region.width", F.lit(-1)).alias("width"))


def q50_line_keys(spark, sf):
    f = v.fragments(spark, sf)
    return f.select("slide_index", "pos", line_key(F.col("text")).alias("line"), normalized(F.col("text")).alias("normalized"))


def q51_fragment_markdown(spark, sf):
    f = ocr.mark_low(v.fragments(spark, sf))
    return ocr.assemble(f, ["slide_index"], "pos", F.concat(F.lit("![Slide]("), md.link_target(F.concat(F.lit("img "), F.col("slide_index").cast("string"), F.lit(" (1).png"))), F.lit(")")))


def q52_term_keys(spark, sf):
    """Keys of Russian words given as rows."""
    words = F.array(*map(F.lit, "уравнение уравнений уравнениями корень корни корней точка точками предел пределов синуса ёлка ёлки Виета день квадратный квадратного".split()))
    w = v.table(spark, sf, "region").select("r_regionkey", F.explode(words).alias("word"))
    return w.select("r_regionkey", "word", term_key(F.col("word")).alias("key"))


QUERIES = {k: f for k, f in globals().items() if k[0] == "q" and k[1:3].isdigit()}

_STOP = ", ".join(f"'{w}'" for w in glossary.STOP_WORDS)
_TERMS = v.FRAGMENTS + f""", toks AS (SELECT recording_id, slide_index, pos, text, regexp_extract_all(text, '[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё\\-'']*') AS ts FROM fragments),
    tk AS (SELECT recording_id, slide_index, pos, i, ts[i] AS t, ts[i + 1] AS nx FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM toks)),
    own AS (SELECT *, 0 AS k, t AS surface FROM tk WHERE length(t) >= 4 AND translate(lower(t), 'ё', 'е') NOT IN ({_STOP})),
    pairs AS (SELECT * REPLACE (1 AS k, t || ' ' || nx AS surface) FROM own WHERE regexp_matches(nx, '^\\p{{Lu}}') AND length(nx) >= 4 AND NOT (t = upper(t) AND nx = upper(nx)) AND translate(lower(nx), 'ё', 'е') NOT IN ({_STOP})),
    terms AS (SELECT recording_id, slide_index, pos, i, k, surface FROM own UNION ALL SELECT recording_id, slide_index, pos, i, k, surface FROM pairs)"""


def _sql_key(c: str) -> str:
    from ..functions.text import ENDINGS

    ends = "|".join(sorted(ENDINGS, key=len, reverse=True))
    vow = "аеиоуыэюя"
    return (
        f"regexp_replace(regexp_replace(regexp_replace(trim(translate(lower({c}), 'ё', 'е'), '-'''), '^(.{{4,}}?)(?:{ends})$', '\\1'), '^(.{{4,}})[иьй]$', '\\1'),"
        f" '^(.{{2,}}[^{vow}])[ео]([^{vow}])$', '\\1\\2')"
    )


_KEYED = _TERMS + f""", keyed AS (SELECT *, array_to_string(list_transform(string_split(surface, ' '), lambda w: {_sql_key('w')}), ' ') AS key FROM terms)"""
_LINE = r"trim(regexp_replace(regexp_replace(translate(replace(lower(text), 'ß', 'ss'), 'ё', 'е'), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _decoration(ratio, stable, tolerance):
    return v.FRAGMENTS + f""", fl AS (SELECT *, {_LINE} AS line, 40 + length(text) * 5 AS cx, 60 + 60 * pos + 20 AS cy FROM fragments),
    tot AS (SELECT recording_id, count(DISTINCT slide_index) AS total FROM fragments GROUP BY ALL),
    byl AS (SELECT recording_id, line, count(DISTINCT slide_index) AS n, median(cx) AS mx, median(cy) AS my FROM fl WHERE line <> '' GROUP BY ALL),
    often AS (SELECT byl.* FROM byl JOIN tot USING (recording_id) WHERE total >= 3 AND n / total >= {ratio}),
    stab AS (SELECT recording_id, line, min(text) AS t FROM fl JOIN often USING (recording_id, line) GROUP BY ALL HAVING avg(CASE WHEN abs(cx - mx) <= {tolerance} AND abs(cy - my) <= {tolerance} THEN 1 ELSE 0 END) >= {stable}),
    wk AS (SELECT recording_id, line, {_sql_key('w')} AS k, isstab FROM (
        SELECT recording_id, line, isstab, unnest(list_filter(regexp_extract_all(text, '[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё\\-'']*'), lambda x: length(x) >= 4 AND translate(lower(x), 'ё', 'е') NOT IN ({_STOP}))) AS w
        FROM (SELECT recording_id, line, text, 0 AS isstab FROM fl ANTI JOIN stab USING (recording_id, line) WHERE line <> '' UNION ALL SELECT recording_id, line, t, 1 FROM stab))),
    made AS (SELECT recording_id, line FROM wk WHERE isstab = 1 GROUP BY ALL HAVING bool_and((recording_id, k) IN (SELECT (recording_id, k) FROM wk WHERE isstab = 0))),
    deco AS (SELECT recording_id, line FROM stab ANTI JOIN made USING (recording_id, line))"""


_NORM = "translate(lower(trim({0}, ' \t«»\"''`(),.!?;:—–…')), 'ё', 'е')"
_RUNS = v.LABELLED + """, rb AS (SELECT *, CASE WHEN pos = 0 OR slide IS DISTINCT FROM lag(slide) OVER (PARTITION BY recording_id ORDER BY pos) THEN 1 ELSE 0 END AS f FROM labelled),
    rn AS (SELECT *, CAST(sum(f) OVER (PARTITION BY recording_id ORDER BY pos) AS BIGINT) - 1 AS run FROM rb)"""
_SECTIONS = _RUNS + """, sp AS (SELECT recording_id, run, slide, min(pos) AS fw, max(pos) AS lw, min(st) AS ws, max(en) AS we FROM rn GROUP BY ALL),
    wi AS (SELECT sp.*, s0, s1 FROM sp LEFT JOIN slides s ON sp.recording_id = s.recording_id AND sp.slide = s.slide_index),
    en AS (SELECT recording_id, slide, coalesce(s0, ws) AS start, coalesce(s1, we) AS "end", fw AS first_word, lw AS last_word, max(coalesce(s0, ws)) OVER (PARTITION BY recording_id ORDER BY fw) AS t, 1 AS kind, fw AS tie FROM wi
        UNION ALL SELECT recording_id, slide_index, s0, s1, NULL, NULL, s0, 0, slide_index FROM slides s WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.recording_id = s.recording_id AND sp.slide = s.slide_index)),
    sections AS (SELECT *, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY t, kind, tie) - 1 AS INT) AS section_pos FROM en)"""
_STOPS = "regexp_matches(rtrim({0}), '[.?!…]$')"
_ESC = r"regexp_replace(regexp_replace(html, '([\\`*_{}\[\]$|])', '\\\1', 'g'), '^([#>+=-])', '\\\1')"


def _pairs(some, a, b):
    return " OR ".join(f"({a} = '{x}' AND {b} = '{y}')" for x, y in some)


ORACLES = {
    "q07_word_slide_overlap": f"WITH {v.LABELLED} SELECT recording_id, pos, coalesce(slide, -1) AS slide FROM labelled",
    "q08_phrase_boundaries": f"""WITH {v.WORDS} SELECT recording_id, pos, coalesce(st - lag(en) OVER w >= 4.5 OR {_STOPS.format('lag(text) OVER w')}, false) AS boundary FROM words WINDOW w AS (PARTITION BY recording_id ORDER BY pos)""",
    "q09_sections": f'WITH {_SECTIONS} SELECT recording_id, section_pos, coalesce(slide, -1) AS slide, start, "end", first_word, last_word FROM sections',
    "q10_completeness": f"""WITH {_SECTIONS}, p AS (SELECT recording_id, CAST(sum(last_word - first_word + 1) AS BIGINT) AS placed FROM sections GROUP BY ALL), c AS (SELECT recording_id, count(*) AS words FROM words GROUP BY ALL)
        SELECT recording_id, words, placed, words = placed AS complete FROM c JOIN p USING (recording_id)""",
    "q11_boundary_shift": f"""WITH RECURSIVE {_RUNS},
        bd AS (SELECT recording_id, pos AS p, st AS s FROM (SELECT *, st - lag(en) OVER w >= 4.5 OR {_STOPS.format('lag(text) OVER w')} AS b FROM words WINDOW w AS (PARTITION BY recording_id ORDER BY pos)) WHERE b),
        c0 AS (SELECT recording_id, run, min(pos) AS cut, min(st) AS t, any_value(slide) AS slide, max(pos) AS z FROM rn GROUP BY ALL),
        c AS (SELECT *, coalesce(lead(cut) OVER (PARTITION BY recording_id ORDER BY cut), max(z) OVER (PARTITION BY recording_id) + 1) - 1 AS high FROM c0),
        near AS (SELECT c.recording_id, c.run, p, abs(s - t) AS d FROM c JOIN bd ON c.recording_id = bd.recording_id AND abs(s - t) <= 20 AND p <= high WHERE run > 0),
        r AS (SELECT recording_id, run, CAST(0 AS BIGINT) AS last FROM c WHERE run = 0
            UNION ALL SELECT c.recording_id, c.run, coalesce(arg_min(n.p, (n.d, n.p)), any_value(c.cut)) FROM r JOIN c ON c.recording_id = r.recording_id AND c.run = r.run + 1
                LEFT JOIN near n ON n.recording_id = c.recording_id AND n.run = c.run AND n.p > r.last GROUP BY c.recording_id, c.run),
        l AS (SELECT r.recording_id, r.last, c.slide FROM r JOIN c USING (recording_id, run))
        SELECT w.recording_id, w.pos, coalesce(l.slide, -1) AS section_label FROM words w ASOF JOIN l ON w.recording_id = l.recording_id AND w.pos >= l.last""",
    "q12_absorb_short": f"""WITH {_SECTIONS}, k AS (SELECT *, slide IS NULL AND "end" - start < 150 AS short FROM sections),
        a AS (SELECT *, last_value(CASE WHEN NOT short THEN section_pos END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(CASE WHEN NOT short THEN section_pos END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f FROM k WINDOW w AS (PARTITION BY recording_id ORDER BY section_pos))
        SELECT a.recording_id, a.section_pos, CASE WHEN NOT short THEN a.section_pos WHEN kb.slide IS NOT NULL THEN a.b WHEN kf.slide IS NOT NULL THEN a.f ELSE a.section_pos END AS target
        FROM a LEFT JOIN sections kb ON kb.recording_id = a.recording_id AND kb.section_pos = a.b LEFT JOIN sections kf ON kf.recording_id = a.recording_id AND kf.section_pos = a.f""",
    "q13_same_content_groups": """WITH d AS (SELECT source, doc_id, lang AS content, doc_id % 5 <> 0 AS os FROM documents),
        b AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN coalesce(os AND lag(os) OVER w AND content = lag(content) OVER w, false) THEN 0 ELSE 1 END AS f FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id))
        SELECT source, doc_id, content, CAST(sum(f) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS group_id FROM b""",
    "q14_fillers": f"""WITH {v.WORDS}, n AS (SELECT *, {_NORM.format('text')} AS n, {_STOPS.format('text')} AS p, regexp_matches(rtrim(text), '[,;:—–-]$') AS c, regexp_matches(ltrim(text, ' \t«»"''`(),.!?;:—–…'), '^\\p{{Lu}}') AS u FROM words),
        l AS (SELECT *, lead(n) OVER w AS n2, lead(p) OVER w AS p2, lead(c) OVER w AS c2, lead(en) OVER w AS en2, lead(st, 2) OVER w AS st3, lag(p) OVER w AS p0, lag(c) OVER w AS c0, lag(en) OVER w AS en0 FROM n WINDOW w AS (PARTITION BY recording_id ORDER BY pos)),
        b AS (SELECT *, coalesce(NOT p AND NOT coalesce(p2, true) AND (({_pairs(FILLERS.phrases, 'n', 'n2')}) OR (({_pairs(FILLERS.ambiguous, 'n', 'n2')}) AND NOT u AND NOT coalesce(p0, false)
            AND coalesce(c0 AND st - en0 >= 1, false) AND coalesce(c2 AND coalesce(st3 - en2 >= 1, true), false))), false) AS bg FROM l)
        SELECT recording_id, pos, (n IN ('la', 'the', 'die') AND NOT p) OR bg OR coalesce(lag(bg) OVER (PARTITION BY recording_id ORDER BY pos), false) AS filler FROM b""",
    "q15_repeat_collapse": f"""WITH RECURSIVE {v.WORDS}, n AS (SELECT *, {_NORM.format('text')} AS n, {_STOPS.format('text')} AS p, regexp_matches(ltrim(text, ' \t«»"''`(),.!?;:—–…'), '^\\p{{Lu}}') AS u, translate(lower(trim(text)), 'ё', 'е') AS raw FROM words),
        r AS (SELECT recording_id, pos AS nxt, pos AS cur, n, p, u, raw, CAST(NULL AS BIGINT) AS gone FROM n WHERE pos = 0
            UNION ALL SELECT recording_id, nxt, CASE WHEN side = 2 THEN cur ELSE nxt END, CASE WHEN side = 2 THEN rn ELSE n END, CASE WHEN side = 2 THEN rp ELSE p END, CASE WHEN side = 2 THEN ru ELSE u END, CASE WHEN side = 2 THEN rraw ELSE raw END,
                CASE WHEN side = 1 THEN cur WHEN side = 2 THEN nxt END FROM (
                SELECT r.recording_id, n.pos AS nxt, r.cur, r.n AS rn, r.p AS rp, r.u AS ru, r.raw AS rraw, n.n, n.p, n.u, n.raw,
                    CASE WHEN r.n <> n.n OR r.n = '' OR regexp_matches(r.n, '\\p{{Nd}}') OR length(r.n) = 1 THEN 0
                        WHEN NOT (r.u AND NOT n.u) THEN CASE WHEN r.p THEN 0 ELSE 1 END WHEN r.raw = n.raw THEN CASE WHEN n.p THEN 0 ELSE 2 END ELSE 0 END AS side
                FROM r JOIN n ON n.recording_id = r.recording_id AND n.pos = r.nxt + 1))
        SELECT recording_id, pos, text FROM words WHERE (recording_id, pos) NOT IN (SELECT (recording_id, gone) FROM r WHERE gone IS NOT NULL)""",
    "q16_truncated_starts": f"""WITH {v.WORDS}, t AS (SELECT recording_id, pos, coalesce(CASE WHEN pos % 9 = 0 THEN substr(lead(text) OVER w, 1, 2) || '-' ELSE text END, text) AS text FROM words WINDOW w AS (PARTITION BY recording_id ORDER BY pos)),
        n AS (SELECT *, {_NORM.format('lead(text) OVER (PARTITION BY recording_id ORDER BY pos)')} AS nx, trim(text, ' \t«»"''`') AS raw FROM t), s AS (SELECT *, rtrim({_NORM.format('raw')}, '-') AS stem FROM n)
        SELECT recording_id, pos, coalesce(regexp_matches(raw, '-$') AND stem <> '' AND starts_with(nx, stem) AND length(nx) > length(stem) AND NOT {_STOPS.format('text')}, false) AS truncated FROM s""",
    "q17_paragraph_split": f"""WITH RECURSIVE {v.WORDS}, n AS (SELECT recording_id, pos, st, lag(en) OVER w AS e, {_STOPS.format('lag(text) OVER w')} AS stop FROM words WINDOW w AS (PARTITION BY recording_id ORDER BY pos)),
        r AS (SELECT recording_id, pos, st AS s0, 1 AS k, CAST(0 AS BIGINT) AS paragraph FROM n WHERE pos = 0
            UNION ALL SELECT recording_id, pos, CASE WHEN b THEN st ELSE s0 END, CASE WHEN b THEN 1 ELSE k + 1 END, paragraph + CASE WHEN b THEN 1 ELSE 0 END FROM (
                SELECT n.recording_id, n.pos, n.st, r.s0, r.k, r.paragraph, ((e - s0 >= 100 OR k >= 40) AND (stop OR n.st - e >= 25)) OR ((e - s0 >= 300 OR k >= 120) AND n.st - e >= 8) OR e - s0 >= 450 AS b
                FROM r JOIN n ON n.recording_id = r.recording_id AND n.pos = r.pos + 1))
        SELECT recording_id, pos, paragraph FROM r""",
    "q18_timecode_emission": f"""WITH RECURSIVE {v.WORDS}, p AS (SELECT recording_id, pos // 7 AS block, min(st) AS start FROM words GROUP BY ALL),
        r AS (SELECT recording_id, CAST(-1 AS BIGINT) AS block, CAST(0 AS BIGINT) AS last, CAST(0 AS BIGINT) AS start, false AS shown FROM (SELECT DISTINCT recording_id FROM p)
            UNION ALL SELECT p.recording_id, p.block, CASE WHEN p.start - r.last >= 200 THEN p.start ELSE r.last END, p.start, p.start - r.last >= 200 FROM r JOIN p ON p.recording_id = r.recording_id AND p.block = r.block + 1),
        s AS (SELECT recording_id, block, start // 10 AS a, start * 10 AS b FROM r WHERE shown)
        SELECT recording_id, block, printf('%d:%02d:%02d', a // 3600, a % 3600 // 60, a % 60) AS code, CASE WHEN b >= 3600 THEN printf('%d:%02d:%02d', b // 3600, b % 3600 // 60, b % 60) ELSE printf('%02d:%02d', b // 60, b % 60) END AS short_code FROM s""",
    "q19_paragraph_text": f"""WITH {v.WORDS} SELECT recording_id, turn, trim(regexp_replace(regexp_replace(string_agg(trim(text), ' ' ORDER BY pos), '\\s+([,.!?;:…»)])', '\\1', 'g'), '([«(])\\s+', '\\1', 'g')) AS text FROM words WHERE trim(text) <> '' GROUP BY recording_id, turn""",
    "q20_glossary_counts": f"WITH {_KEYED} SELECT key, surface, count(*) AS n FROM keyed GROUP BY ALL",
    "q21_glossary_topk": f"""WITH {_decoration(0.15, 0.8, 32)}, {_KEYED.replace(v.FRAGMENTS + ',', '').replace('FROM fragments)', 'FROM fl ANTI JOIN deco USING (recording_id, line))', 1)},
        forms AS (SELECT recording_id, key, surface, count(*) AS n, min((slide_index, pos, i, k)) AS f FROM keyed WHERE key <> '' GROUP BY ALL),
        g AS (SELECT recording_id, key, CAST(sum(n) AS BIGINT) AS total, min(f) AS f, arg_min(surface, (-n, length(surface), surface)) AS term FROM forms GROUP BY ALL)
        SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY total DESC, f, term) AS INT) AS rank, term, total FROM g QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY total DESC, f, term) <= 50""",
    "q22_decoration_lines": f"WITH {_decoration(0.1, 0.2, 100)} SELECT recording_id, line FROM deco",
    "q23_ocr_row_order": f"""WITH RECURSIVE {v.FRAGMENTS}, f AS (SELECT slide_index, pos, pos * 37 % 101 AS x, pos * 17 % 90 AS y, CAST(length(text) % 5 * 10 + 10 AS DOUBLE) AS h FROM fragments),
        o AS (SELECT *, row_number() OVER (PARTITION BY slide_index ORDER BY y, x, pos) AS k FROM f),
        r AS (SELECT slide_index, pos, x, k, 0 AS row, y + h / 2 AS mean, 1 AS n, h AS tall FROM o WHERE k = 1
            UNION ALL SELECT slide_index, pos, x, k, CASE WHEN j THEN row ELSE row + 1 END, CASE WHEN j THEN (mean * n + c) / (n + 1) ELSE c END, CASE WHEN j THEN n + 1 ELSE 1 END, CASE WHEN j THEN greatest(tall, h) ELSE h END FROM (
                SELECT o.slide_index, o.pos, o.x, o.k, o.h, o.y + o.h / 2 AS c, r.row, r.mean, r.n, r.tall, abs(o.y + o.h / 2 - r.mean) <= 0.5 * greatest(r.tall, o.h) AS j FROM r JOIN o ON o.slide_index = r.slide_index AND o.k = r.k + 1))
        SELECT slide_index, pos, row, CAST(row_number() OVER (PARTITION BY slide_index ORDER BY row, x, pos) - 1 AS INT) AS place FROM r""",
    "q24_low_confidence": f"WITH {v.FRAGMENTS} SELECT recording_id, slide_index, avg(CASE WHEN confidence < 0.6 THEN 1 ELSE 0 END) >= 0.5 AS unreliable FROM fragments GROUP BY ALL",
    "q25_route_lines": f"""WITH {v.FRAGMENTS}, a AS (SELECT slide_index, pos, confidence AS c, regexp_matches(text, '[{routing.STRONG}{routing.SCRIPT}{routing.GREEK}]') AS strong, regexp_matches(text, '[=+*/\\^_<>|\\\\−–—]') AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AS weak,
            coalesce(list_sum(list_transform(list_filter(regexp_extract_all(text, '[A-Za-zА-Яа-яЁё]{{3,}}'), lambda w: lower(w) NOT IN ({', '.join(f"'{w}'" for w in routing.MATH_WORDS)})), lambda w: length(w))), 0) / length(regexp_replace(text, '\\s+', '', 'g')) AS r FROM fragments)
        SELECT slide_index, pos, CASE WHEN CASE WHEN c < 0.6 THEN strong OR weak WHEN strong THEN r <= 0.7 WHEN weak THEN r <= 0.5 ELSE false END THEN 'formula' ELSE 'text' END AS route, round(r, 6) AS ratio, c < 0.35 AND NOT (strong OR weak) AS handwriting FROM a""",
    "q26_escape_markdown": f"SELECT page_id, {_ESC} AS escaped FROM pages",
    "q34_distribute_words": f"""WITH {v.WORDS}, c AS (SELECT *, greatest(1, length(text)) AS k, sum(greatest(1, length(text))) OVER (PARTITION BY recording_id, turn) AS t, sum(greatest(1, length(text))) OVER (PARTITION BY recording_id, turn ORDER BY pos) AS s FROM words)
        SELECT recording_id, turn, pos, round(least(60.0, CAST(s - k AS DOUBLE) / t * 60.0), 6) AS start, round(least(60.0, CAST(s AS DOUBLE) / t * 60.0), 6) AS "end" FROM c""",
    "q36_validate_words": f"""WITH {v.WORDS}, w AS (SELECT recording_id, pos, CASE WHEN pos % 11 = 3 THEN st - 9 ELSE st END AS st, en FROM words), b AS (SELECT *, lag(st) OVER (PARTITION BY recording_id ORDER BY pos) AS ps FROM w)
        SELECT recording_id, count(*) AS n, count(*) FILTER (st < ps) AS backward, count(*) FILTER (en < st) AS reversed, count(*) FILTER (st < -0.05) AS early, count(*) FILTER (en > 2000.05) AS late, count(*) FILTER (en = st) AS zero_length FROM b GROUP BY recording_id""",
    "q37_validate_intervals": f"""WITH {v.SLIDES}, b AS (SELECT *, lag(s1) OVER w AS e, lag(slide_index) OVER w AS i FROM slides WINDOW w AS (PARTITION BY recording_id ORDER BY s0, slide_index))
        SELECT recording_id, count(*) AS n, count(*) FILTER (slide_index <> i + 1) AS numbering_gaps, count(*) FILTER (s0 < e) AS overlaps, count(*) FILTER (s1 <= s0) AS empty FROM b GROUP BY recording_id""",
    "q38_prompt_budget": """WITH t AS (SELECT source, doc_id, trim(text) AS term FROM documents), c AS (SELECT *, sum(length(term) + 2) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM t WHERE trim(term) <> '')
        SELECT source, string_agg(term, ', ' ORDER BY doc_id) AS prompt FROM c WHERE used <= 20000 GROUP BY source""",
    "q39_distinct_content_hash": "SELECT source, sha256(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY ALL",
    "q40_word_chunks": f"WITH {v.WORDS} SELECT recording_id, pos // 64 AS chunk, min(pos) AS first, max(pos) AS last, count(*) AS n FROM words GROUP BY ALL",
    "q41_section_headings": r"""WITH b AS (SELECT doc_id, string_split(trim(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', '', 'g')), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, list_filter(list_transform(ls, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(rtrim(x), '_(?)_', ' '), '\$\$.*?\$\$|\$.*?\$|\$', ' ', 'g'), '(\*\*|__|\*|_)', '', 'g'), '^\s*(?:#+|>|[-+*])\s+', ''), '\s+', ' ', 'g'))), lambda x: regexp_matches(x, '[\p{L}\p{N}]'))[1] AS t FROM b),
        h AS (SELECT doc_id, coalesce(t, '') AS t, CASE WHEN contains(substr(coalesce(t, ''), 1, 40), ' ') THEN regexp_replace(substr(t, 1, 40), ' [^ ]*$', '') ELSE substr(t, 1, 40) END AS head, CAST(floor(doc_id * 7.5) AS BIGINT) AS a, doc_id * 11 AS z FROM l)
        SELECT doc_id, CASE WHEN length(t) > 40 THEN rtrim(head, ' ,;:—–-' || chr(92)) || '…' ELSE t END AS title, printf('%d:%02d:%02d', a // 3600, a % 3600 // 60, a % 60) || '–' || printf('%d:%02d:%02d', z // 3600, z % 3600 // 60, z % 60) AS interval FROM h""",
    "q42_metadata": "SELECT conv_id AS recording_id, count(*) AS turns, count(DISTINCT role) AS n_roles, string_agg(DISTINCT role, ', ' ORDER BY role) AS roles FROM conversations GROUP BY conv_id",
    "q43_media_probe": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 0.5 AS duration_s, 1 AS video_index, round(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 4, 6) AS fps, 'ru' AS language, CAST(NULL AS VARCHAR) AS title, 48000 AS sample_rate, 1 AS n_audio FROM events""",
    "q53_detect_speech": f"""WITH {v.FLAGS}, e AS (SELECT recording_id, pos // 4 AS frame, 20 * log10(greatest(sqrt(avg((value / 500) * (value / 500))), 1e-12)) AS dbfs FROM flags GROUP BY ALL HAVING count(*) = 4),
        t AS (SELECT *, dbfs >= greatest(-45.0, max(dbfs) OVER (PARTITION BY recording_id) - 6.0) AS sp FROM e), w AS (SELECT recording_id, CAST((max(frame) + 1) * 4 AS DOUBLE) AS stop FROM e GROUP BY ALL),
        i AS (SELECT *, frame - row_number() OVER (PARTITION BY recording_id ORDER BY frame) AS g FROM t WHERE sp),
        m AS (SELECT recording_id, CAST(min(frame) * 4 AS DOUBLE) AS a, CAST((max(frame) + 1) * 4 AS DOUBLE) AS z FROM i GROUP BY recording_id, g),
        f AS (SELECT *, CASE WHEN a - max(z) OVER (PARTITION BY recording_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 5 THEN 1 ELSE 0 END AS f FROM m),
        g AS (SELECT *, sum(f) OVER (PARTITION BY recording_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM f), s AS (SELECT recording_id, min(a) AS a, max(z) AS z FROM g GROUP BY recording_id, g),
        p AS (SELECT recording_id, greatest(CAST(0 AS DOUBLE), a - 1) AS a, z + 1 AS z FROM s WHERE z - a >= 4.5),
        f2 AS (SELECT *, CASE WHEN a - max(z) OVER (PARTITION BY recording_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 1 ELSE 0 END AS f FROM p),
        g2 AS (SELECT *, sum(f) OVER (PARTITION BY recording_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM f2)
        SELECT recording_id, min(a) AS start, least(max(z), any_value(stop)) AS "end" FROM g2 JOIN w USING (recording_id) GROUP BY recording_id, g""",
    "q54_layout_intervals": f"""WITH {v.FLAGS.replace("30.0", "20.0")},
        a AS (SELECT *, pos - row_number() OVER (PARTITION BY recording_id, present ORDER BY pos) AS g FROM flags),
        b AS (SELECT recording_id, pos, present AND count(*) OVER (PARTITION BY recording_id, present, g) > 2 AS f FROM a),
        c AS (SELECT *, pos - row_number() OVER (PARTITION BY recording_id, f ORDER BY pos) AS g FROM b),
        d AS (SELECT *, count(*) OVER (PARTITION BY recording_id, f, g) AS n, min(pos) OVER (PARTITION BY recording_id, f, g) AS lo, max(pos) OVER (PARTITION BY recording_id, f, g) AS hi, max(pos) OVER (PARTITION BY recording_id) AS last FROM c),
        sm AS (SELECT recording_id, pos, f OR (n < 3 AND lo > 0 AND hi < last) AS s, pos % 40 < 25 AS big FROM d),
        r AS (SELECT *, sum(CASE WHEN pos > 0 AND s <> ps THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY pos) AS run FROM (SELECT *, lag(s) OVER (PARTITION BY recording_id ORDER BY pos) AS ps FROM sm)),
        q AS (SELECT *, sum(CASE WHEN big <> pb THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, run ORDER BY pos) AS part FROM (SELECT *, lag(big) OVER (PARTITION BY recording_id, run ORDER BY pos) AS pb FROM r)),
        l AS (SELECT recording_id, run, part, count(*) AS n FROM q WHERE s GROUP BY ALL),
        m AS (SELECT *, sum(CASE WHEN n >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, run ORDER BY part) AS g FROM l),
        k AS (SELECT recording_id, run, sum(CASE WHEN g = 0 THEN n ELSE 0 END) AS lead, max(CASE WHEN g = 0 THEN 1 ELSE 0 END) AS has0, max(g) AS most FROM m GROUP BY ALL),
        z AS (SELECT recording_id, run, part, CASE WHEN has0 = 1 AND lead < 5 AND most >= 1 THEN greatest(g, 1) - 1 WHEN has0 = 1 THEN g ELSE g - 1 END AS piece FROM m JOIN k USING (recording_id, run)),
        y AS (SELECT q.recording_id, q.run, coalesce(z.piece, 0) AS p, min(pos) AS start, bool_or(s) AS present, max(CASE WHEN s THEN CASE WHEN big THEN 100 ELSE 50 END ELSE -1 END) AS width
            FROM q LEFT JOIN z ON q.s AND q.recording_id = z.recording_id AND q.run = z.run AND q.part = z.part GROUP BY ALL),
        e AS (SELECT recording_id, max(pos) + 1 AS stop FROM sm GROUP BY ALL)
        SELECT recording_id, CAST(row_number() OVER w - 1 AS INT) AS piece, CAST(start AS DOUBLE) AS start, CAST(coalesce(lead(start) OVER w, stop) AS DOUBLE) AS "end", present, CAST(width AS INT) AS width
        FROM y JOIN e USING (recording_id) WINDOW w AS (PARTITION BY recording_id ORDER BY start)""",
    "q50_line_keys": f"WITH {v.FRAGMENTS} SELECT slide_index, pos, {_LINE} AS line, {_NORM.format('text')} AS normalized FROM fragments",
    "q51_fragment_markdown": "WITH " + v.FRAGMENTS + ", e AS (SELECT slide_index, pos, " + _ESC.replace("html", "trim(text)") + """ || CASE WHEN confidence < 0.6 THEN ' _(?)_' ELSE '' END AS x FROM fragments)
        SELECT slide_index, string_agg(x, chr(10) || chr(10) ORDER BY pos) || chr(10) || chr(10) || '![Slide](img%20' || slide_index || '%20%281%29.png)' AS markdown FROM e GROUP BY slide_index""",
    "q52_term_keys": f"SELECT r_regionkey, word, {_sql_key('word')} AS key FROM region, (SELECT unnest(string_split('уравнение уравнений уравнениями корень корни корней точка точками предел пределов синуса ёлка ёлки Виета день квадратный квадратного', ' ')) AS word)",
}
