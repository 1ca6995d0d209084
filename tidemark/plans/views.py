"""Words, slides, fragments, frames and signals derived from the driver's tables, the same way in Spark and in SQL.

Times are whole tenths of a second, so no tie depends on floating point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, turn, pos (from 0), text, st, en: a word every 0.4 s, a pause of 3 s before every 25th."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.trim("text"), "\\s+")).alias("i", "text"))
    pos = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "i")) - 1).cast("long")
    st = F.col("pos") * 4 + F.floor(F.col("pos") / 25) * 30
    return c.select(F.col("conv_id").alias("recording_id"), "turn", pos.alias("pos"), "text").withColumn("st", st).withColumn("en", F.col("st") + 3)


def slides(w: DataFrame) -> DataFrame:
    """recording_id, slide_index, s0, s1: two of three turns have a slide, half a second late."""
    return w.where("turn % 3 <> 2").groupBy("recording_id", F.col("turn").alias("slide_index")).agg((F.min("st") + 5).alias("s0"), (F.max("en") + 5).alias("s1"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, slide_index, pos, text, kind, confidence, low_confidence, bbox: the non-blank lines of documents."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(F.trim("text") != "")
    box = F.struct(F.lit(40).alias("x"), (F.col("pos") * 60 + 60).alias("y"), (F.length("text") * 10).alias("width"), F.lit(40).alias("height"))
    confidence = (F.pmod(F.col("doc_id") * 7 + F.col("pos") * 13, F.lit(100)) / 100).alias("confidence")
    return d.select(F.col("source").alias("recording_id"), F.col("doc_id").alias("slide_index"), "pos", "text", F.lit("text").alias("kind"), confidence, F.lit(False).alias("low_confidence"), box.alias("bbox"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, idx, hash: a 64-bit hash of the signs of an embedding."""
    bits = F.aggregate(F.col("embedding"), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long")))
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("recording_id"), F.col("vec_id").alias("idx"), bits.alias("hash"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, event_id, us (microseconds), event_type, value."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), "event_id", us.alias("us"), "event_type", "value")


def flags(spark: SparkSession, sf_dir: str, least: float = 30.0) -> DataFrame:
    """recording_id, pos (from 0), present."""
    e = events(spark, sf_dir)
    pos = (F.row_number().over(Window.partitionBy("recording_id").orderBy("us", "event_id")) - 1).cast("long")
    return e.select("recording_id", pos.alias("pos"), (F.col("value") >= least).alias("present"), "value", "us", "event_id")


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, pos, rect: one rectangle for each order line."""
    li = table(spark, sf_dir, "lineitem")
    rect = F.struct((F.col("l_linenumber") * 10).alias("x"), F.pmod(F.col("l_partkey"), F.lit(5)).cast("int").alias("y"), (F.col("l_quantity").cast("int") + 40).alias("width"), F.lit(40).alias("height"))
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")).cast("int")
    return li.select(F.col("l_orderkey").alias("recording_id"), pos.alias("pos"), rect.alias("rect"))


#: The same views as common table expressions.
WORDS = """words AS (
    SELECT recording_id, turn, pos, text, pos * 4 + (pos // 25) * 30 AS st, pos * 4 + (pos // 25) * 30 + 3 AS en FROM (
        SELECT conv_id AS recording_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS pos, ws[i] AS text
        FROM (SELECT conv_id, turn, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT conv_id, turn, string_split_regex(trim(text), '\\s+') AS ws FROM conversations))))"""
SLIDES = WORDS + """, slides AS (
    SELECT recording_id, turn AS slide_index, min(st) + 5 AS s0, max(en) + 5 AS s1 FROM words WHERE turn % 3 <> 2 GROUP BY ALL)"""
LABELLED = SLIDES + """, labelled AS (
    SELECT w.recording_id, w.pos, w.text, w.st, w.en, arg_min(s.slide_index, (-(least(w.en, s.s1) - greatest(w.st, s.s0)), s.slide_index)) AS slide
    FROM words w LEFT JOIN slides s ON w.recording_id = s.recording_id AND w.st < s.s1 AND s.s0 < w.en GROUP BY ALL)"""
FRAGMENTS = """fragments AS (
    SELECT source AS recording_id, doc_id AS slide_index, i - 1 AS pos, ls[i] AS text, 'text' AS kind, ((doc_id * 7 + (i - 1) * 13) % 100) / 100 AS confidence
    FROM (SELECT source, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(ls[i]) <> '')"""
FLAGS = """flags AS (
    SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value >= 30.0 AS present, value, epoch_us(ts) AS us, event_id FROM events)"""
RECTS = """rects AS (
    SELECT l_orderkey AS recording_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS pos,
        l_linenumber * 10 AS x, l_partkey % 5 AS y, CAST(l_quantity AS INT) + 40 AS width, 40 AS height FROM lineitem)"""
