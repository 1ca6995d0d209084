"""Benchmark decontamination by word windows.

The benchmark's windows (ten words; all of a shorter item) are a hash set that
is broadcast when it is small enough, as a benchmark is, and joined by a shuffle
when it isn't. Places in texts are first screened where they are: a window can
only begin with two words that some window begins with. Windows at the places
left are looked up by hash and verified word by word, and hits are gathered by
text, so that copies share one record of hits. Only built-in functions run.

Defined results: null and empty texts have no words and are clean; texts of any
length are scanned whole; an item without words has no windows; items with the
same text (ties) count each; repeated rows and null ids are answered each; an
empty benchmark leaves all texts clean; extra columns are kept, but for those
named as the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SIZE = 10
#: What parts words: ASCII that is neither digit nor lower-case letter, after A-Z are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bounds within which windows are broadcast, and within which their first words screen places; beyond, windows are joined, and all places are taken.
BROADCAST_WINDOWS, SCREEN_HEADS = 200_000, 50_000
#: So many digests of texts with hits at most are broadcast, so that clean texts stay where they are; more are joined by a shuffle.
BROADCAST_HITS = 200_000


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; other letters keep their case."""
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.length(t) == F.octet_length(t)
    low = F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.array_remove(F.split(low, BREAK), "")


def windows(benchmark: DataFrame, size: int = SIZE, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, size, joined (words with a space between), hash: each distinct window of each item."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("size", F.least(F.size("w"), F.lit(size)))
    rows = items.select("item_id", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.slice("w", i, F.col("size")))).alias("g"))
    head = F.array_join(F.slice("g", 1, 2), " ")
    return rows.select("item_id", "size", F.array_join("g", " ").alias("joined"), head.alias("head")).distinct()


def _places(heads: list[str] | None, two: bool) -> Column:
    """Numbers of the words of _w that begin a head (one word, or two); all, if heads is None."""
    last = F.size("_w") - (1 if two else 0)
    every = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    if heads is None:
        return every
    word = lambda i: F.get(F.col("_w"), i - 1)
    return F.filter(every, lambda i: (F.concat(word(i), F.lit(" "), word(i + 1)) if two else word(i)).isin(heads))


def _grams(n: int) -> Column:
    """Runs of n words of _w at the places that a window of n can begin at, with their first word's number."""
    at = F.filter("_at" if n > 1 else "_one", lambda i: i <= F.size("_w") - (n - 1))
    return F.transform(at, lambda i: F.struct(i.alias("start"), F.array_join(F.slice("_w", i, F.lit(n)), " ").alias("joined"), F.lit(n).alias("size")))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(keyed, found): docs as _row, with n_words and _key, a digest of the text; and for each key with hits: spans (start word, words) and items."""
    wins = cut(windows(benchmark, size), "windows")
    n_windows = wins.count()
    sizes = [r[0] for r in wins.select("size").distinct().collect()]  # at most `size` numbers
    heads = [r[0] for r in wins.select("head").distinct().limit(SCREEN_HEADS + 1).collect()]
    few = len(heads) <= SCREEN_HEADS
    twos, ones = [h for h in heads if " " in h], [h for h in heads if " " not in h]
    wins_by = wins.groupBy("size", "joined").agg(F.sort_array(F.collect_set("item_id")).alias("items")).withColumn("hash", F.xxhash64("joined"))
    # the input row travels as one value, so no name in it can clash with those used here
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.size(words(F.col(text))).cast("long").alias("n_words"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_key"))
    small = docs.select(F.col(text).alias("_t")).select(F.sha2(F.coalesce("_t", F.lit("")), 256).alias("_key"), words(F.col("_t")).alias("_w"))
    small = small.withColumn("_at", _places(twos if few else None, True)).withColumn("_one", _places(ones if few else None, False))
    grams = None
    for n in sizes:
        one = _grams(n)
        grams = one if grams is None else F.concat(grams, one)
    if grams is None:
        grams = F.array().cast("array<struct<start:int,joined:string,size:int>>")
    tokens = small.select("_key", F.explode(grams).alias("g")).select("_key", "g.start", "g.joined", "g.size", F.xxhash64("g.joined").alias("hash"))
    table = F.broadcast(wins_by) if n_windows <= BROADCAST_WINDOWS else wins_by
    table = table.select("hash", F.col("joined").alias("_j"), F.col("size").alias("_n"), "items")
    # met by hash, verified by the words themselves
    met = tokens.join(table, "hash").where((F.col("joined") == F.col("_j")) & (F.col("size") == F.col("_n")))
    found = met.groupBy("_key").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    # a table of its own, so that the join with all rows of a hot text can be split
    return keyed, cut(found, "hits")


def covered(spans: Column) -> Column:
    """Words under (start, size) spans sorted by start; those under several count once."""
    def step(acc, s):
        end = s["start"] + s["size"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).cast("long").alias("n"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, text: str = "text") -> DataFrame:
    """docs with n_words, n_hit (long), items (ids found), hit_spans (start word from 1, words) and contaminated."""
    keyed, found = hits(docs, benchmark, size, text)
    joined = keyed.join(found, "_key", "left")
    kept = [f"_row.{c}" for c in docs.columns if c not in ("n_words", "n_hit", "items", "hit_spans", "contaminated")]
    return joined.select(*kept, "n_words", F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"), "items", F.col("spans").alias("hit_spans"), F.col("spans").isNotNull().alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, text: str = "text") -> DataFrame:
    """docs without those that hold a window of the benchmark; columns unchanged."""
    keyed, found = hits(docs, benchmark, size, text)
    gone = found.select("_key")
    few = found.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
    return keyed.join(F.broadcast(gone) if few else gone, "_key", "left_anti").select("_row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, text: str = "text") -> DataFrame:
    """docs whose hit words are cut out of the text (what stands between words stays); columns unchanged."""
    keyed, found = hits(docs, benchmark, size, text)
    out = keyed.join(found, "_key", "left").select("_row", F.col(f"_row.{text}").alias("_t"), F.col("spans").alias("hit_spans"))
    parts = F.regexp_extract_all(F.col("_t"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    gaps = F.split(F.col("_t"), r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)
    kept = F.transform(parts, lambda w, i: F.when(F.exists("hit_spans", lambda s: (i + 1 >= s["start"]) & (i + 1 < s["start"] + s["size"])), F.lit("")).otherwise(w))
    woven = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(parts)), kept, lambda g, w: F.concat(g, w)), ""), F.element_at(gaps, -1))
    new = F.when(F.col("hit_spans").isNotNull(), woven).otherwise(F.col("_t"))
    return out.select(*[new.alias(c) if c == text else F.col(f"_row.{c}") for c in docs.columns])
