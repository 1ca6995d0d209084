"""Glossary of a recording's terms, without the decoration that slides share."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded, line_key, term_key
from .stages import staged

#: Words that are no terms.
STOP_WORDS = (
    "если тогда значит также поэтому потому который которая которое которые когда чтобы этот эта это эти того этом этого"
    " таким образом более менее между через после перед около каждый каждая любой любое такой такая такие была были было быть"
    " есть будет будут может можно нужно надо очень уже ещё еще только всех всего весь вся все или либо даже итак пусть здесь"
    " там где как что чем чтоб при над под без для про свои свой своя the and for with this that from you are not but all any"
).split()
TOKEN = "[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё\\-']*"


@dataclass(frozen=True)
class GlossaryRules:
    least_length: int = 4
    decoration_ratio: float = 0.8
    least_slides: int = 3
    tolerance: int = 32
    stable_ratio: float = 0.8
    with_low_confidence: bool = False
    most_terms: int = 500
    stop_words: tuple = tuple(STOP_WORDS)
    stopped: tuple = ()


def _stop(c: Column, rules: GlossaryRules) -> Column:
    return F.translate(F.lower(c), "ё", "е").isin(list(rules.stop_words))


def terms_of(c: Column, rules: GlossaryRules = GlossaryRules()) -> Column:
    """array<string>: a line's terms in order; after a word its pair with a following name, if that is capitalised and long enough
    and the two aren't both in capitals."""
    tokens = F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
    following = F.concat(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), F.array(F.lit("")))
    capitals = lambda x: (x == F.upper(x)) & (x != F.lower(x))

    def of(t: Column, n: Column) -> Column:
        pair = n.rlike("^\\p{Lu}") & (F.length(n) >= rules.least_length) & ~(capitals(t) & capitals(n)) & ~_stop(n, rules)
        own = (F.length(t) >= rules.least_length) & ~_stop(t, rules)
        return F.when(own & pair, F.array(t, F.concat(t, F.lit(" "), n))).when(own, F.array(t)).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.zip_with(tokens, following, of))


def key_of(term: Column) -> Column:
    """A term's key: the keys of its words, folded."""
    return F.array_join(F.transform(F.split(folded(term), " "), term_key), " ")


def decoration(fragments: DataFrame, key: str, slide: str, text: str, bbox: str, rules: GlossaryRules = GlossaryRules()) -> DataFrame:
    """key, line: lines on most slides, in a stable place, that aren't made of the recording's own words only.

    fragments: text lines. A line counts once for a slide; its place is stable if
    most of its boxes lie around the median centre, or if it has no boxes.
    """
    f = fragments.select(key, slide, F.col(text).alias("_t"), line_key(F.col(text)).alias("line"), (F.col(bbox)["x"] + F.col(bbox)["width"] / 2).alias("_x"), (F.col(bbox)["y"] + F.col(bbox)["height"] / 2).alias("_y")).where(F.col("line") != "")
    f = staged(f, "lines")
    total = fragments.groupBy(key).agg(F.count_distinct(slide).alias("_total"))
    by = f.groupBy(key, "line").agg(F.count_distinct(slide).alias("_n"), F.percentile("_x", 0.5).alias("_mx"), F.percentile("_y", 0.5).alias("_my"))
    often = by.join(total, key).where((F.col("_total") >= rules.least_slides) & (F.col("_n") / F.col("_total") >= rules.decoration_ratio))
    placed = f.join(often.select(key, "line", "_mx", "_my"), [key, "line"])
    near = (F.abs(F.col("_x") - F.col("_mx")) <= rules.tolerance) & (F.abs(F.col("_y") - F.col("_my")) <= rules.tolerance)
    stable = placed.groupBy(key, "line").agg(F.avg(near.cast("int")).alias("_share"), F.min("_t").alias("_t")).where(F.coalesce(F.col("_share") >= rules.stable_ratio, F.lit(True)))
    said = lambda df: df.select(key, "line", F.explode(F.filter(terms_of(F.col("_t"), rules), lambda t: ~F.contains(t, F.lit(" ")))).alias("_w"))
    keyed = lambda df: df.withColumn("_k", term_key(folded(F.col("_w")))).drop("_w")
    # keys are made for different words, not for each place
    own = keyed(said(f.join(stable.select(key, "line"), [key, "line"], "left_anti")).select(key, "_w").distinct()).distinct().withColumn("_own", F.lit(True))
    made = keyed(said(stable)).join(own, [key, "_k"], "left").groupBy(key, "line").agg(F.bool_and(F.coalesce("_own", F.lit(False))).alias("_all")).where("_all").select(key, "line")
    return stable.select(key, "line").join(made, [key, "line"], "left_anti")


def stopped_keys(rules: GlossaryRules) -> list[str]:
    """Entries, folded: phrases and each of their words; the keys' endings are cut where they are compared."""
    fold = lambda x: unicodedata.normalize("NFKC", x).casefold()
    return sorted({fold(p) for e in rules.stopped for p in (e, *e.split())})


def build(fragments: DataFrame, key: str, slide: str, pos: str, text: str, bbox: str, rules: GlossaryRules = GlossaryRules(), kind: str = "kind", low: str = "low_confidence") -> DataFrame:
    """key, rank, term, total: the most frequent terms; a term is shown as its most frequent, then shortest, then first form."""
    lines = fragments.where(F.col(kind) == "text")
    kept = lines if rules.with_low_confidence else lines.where(~F.col(low))
    kept = kept.withColumn("line", line_key(F.col(text))).join(decoration(lines, key, slide, text, bbox, rules), [key, "line"], "left_anti")
    rows = kept.select(key, slide, pos, F.posexplode(terms_of(F.col(text), rules)).alias("_i", "surface"))
    # keys are made for different forms, of which there are few, not for each place
    forms = rows.groupBy(key, "surface").agg(F.count("*").alias("n"), F.min(F.struct(slide, pos, "_i")).alias("first")).withColumn("_key", key_of(F.col("surface"))).where(F.col("_key") != "")
    if rules.stopped:
        words = [F.array_join(F.transform(F.split(F.lit(x), " "), term_key), " ") for x in stopped_keys(rules)]
        forms = forms.where(~F.col("_key").isin(words))
    best = F.min_by("surface", F.struct(-F.col("n"), F.length("surface"), "surface"))
    found = forms.groupBy(key, "_key").agg(F.sum("n").alias("total"), F.min("first").alias("first"), best.alias("term"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("total"), "first", "term"))
    return found.withColumn("rank", rank).where(F.col("rank") <= rules.most_terms).select(key, "rank", "term", "total")
