"""Recognised fragments: reading order, confidence, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import folds, markdown, routing

LOW, UNRELIABLE, ROW_TOLERANCE = 0.60, 0.5, 0.5
CROP_PAD, FORMULA_MOST = 6, 0.85


def mark_low(fragments: DataFrame, confidence: str = "confidence", low: str = "low_confidence", least: float = LOW) -> DataFrame:
    """A fragment read with less confidence is marked; a mark is never taken back."""
    return fragments.withColumn(low, F.col(low) | (F.col(confidence) < least))


def remapped(slides: DataFrame, moved: DataFrame, keys: list[str], path: str = "image_path") -> DataFrame:
    """slides with the paths that moved (keys, path) names for them; the others keep theirs."""
    new = moved.select(*keys, F.col(path).alias("_to"))
    return slides.join(new, keys, "left").withColumn(path, F.coalesce("_to", path)).drop("_to")


def drop_handwriting(fragments: DataFrame, key: list[str], text: str, confidence: str) -> tuple[DataFrame, DataFrame]:
    """(fragments without handwriting, key with how many were dropped)."""
    hand = routing.looks_like_handwriting(F.col(text), F.col(confidence))
    return fragments.where(~hand), fragments.groupBy(*key).agg(F.count_if(hand).alias("dropped"))


def unreliable(fragments: DataFrame, key: list[str], low: str = "low_confidence", dropped: str | None = None) -> DataFrame:
    """key, unreliable: half or more of the fragments are marked, or some were dropped; none at all is reliable."""
    share = F.coalesce(F.avg(F.col(low).cast("int")) >= UNRELIABLE, F.lit(False))
    return fragments.groupBy(*key).agg((share if dropped is None else share | (F.max(dropped) > 0)).alias("unreliable"))


def reading_order(fragments: DataFrame, keys: list[str], pos: str, bbox: str, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """fragments with row and place (from 0): rows from top to bottom, in a row from left to right, those without a box last.

    A fragment joins the row if its centre is near the row's mean centre, which
    then moves: a fold over a slide's fragments by (y, x, pos) gives row numbers.
    """
    boxed = F.struct(F.col(bbox)["y"].alias("y"), F.col(bbox)["x"].alias("x"), F.col(pos).alias("p"), F.col(bbox)["height"].cast("double").alias("h"))
    lists = fragments.where(F.col(bbox).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(boxed)).alias("_l"))
    zero = F.struct(F.lit(-1).alias("row"), F.lit(0.0).alias("mean"), F.lit(0).alias("n"), F.lit(0.0).alias("tall"), *folds.nothing("struct<p:bigint,row:int>"))

    def step(acc: Column, f: Column) -> Column:
        centre = f["y"] + f["h"] / 2
        joins = (acc["n"] > 0) & (F.abs(centre - acc["mean"]) <= tolerance * F.greatest(acc["tall"], f["h"]))
        row = F.when(joins, acc["row"]).otherwise(acc["row"] + 1)
        return F.struct(
            row.alias("row"), F.when(joins, (acc["mean"] * acc["n"] + centre) / (acc["n"] + 1)).otherwise(centre).alias("mean"),
            F.when(joins, acc["n"] + 1).otherwise(F.lit(1)).alias("n"), F.when(joins, F.greatest(acc["tall"], f["h"])).otherwise(f["h"]).alias("tall"),
            *folds.added(acc, F.struct(f["p"].cast("bigint").alias("p"), row.alias("row"))),
        )

    rows = lists.select(*keys, F.inline(F.aggregate("_l", zero, step, folds.gathered))).withColumnRenamed("p", pos)
    from .islands import ordered

    placed = fragments.join(rows, [*keys, pos], "left").withColumn("_last", F.col("row").isNull().cast("int")).withColumn("_x", F.col(bbox)["x"])
    return placed.withColumn("place", F.row_number().over(ordered(keys, ["_last", "row", "_x", pos])) - 1).drop("_last", "_x")


def assemble(fragments: DataFrame, keys: list[str], place: str, image: Column) -> DataFrame:
    """keys, markdown: a slide's fragments in order as Markdown."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(place).alias("o"), "text", "kind", "low_confidence")))
    return fragments.groupBy(*keys).agg(rows.alias("_f")).select(*keys, markdown.slide_markdown(F.col("_f"), image).alias("markdown"))


def crop(bbox: Column, pad: int = CROP_PAD) -> Column:
    """A box with a margin, within the picture's upper left corner."""
    x, y = F.greatest(F.lit(0), bbox["x"] - pad), F.greatest(F.lit(0), bbox["y"] - pad)
    return F.struct(x.alias("x"), y.alias("y"), (bbox["x"] + bbox["width"] + pad - x).alias("width"), (bbox["y"] + bbox["height"] + pad - y).alias("height"))


def formula_confidence(line: Column, most: float = FORMULA_MOST) -> Column:
    return F.least(F.lit(most), line)


_QUAD = "array<array<double>>"


def box_of(quad: Column) -> Column:
    """The bounding box of four corners, whole numbers by rounding half to even."""
    xs, ys = F.transform(quad, lambda p: p[0]), F.transform(quad, lambda p: p[1])
    x, y = F.array_min(xs), F.array_min(ys)
    whole = lambda c: F.bround(c).cast("int")
    return F.struct(whole(x).alias("x"), whole(y).alias("y"), (whole(F.array_max(xs)) - whole(x)).alias("width"), (whole(F.array_max(ys)) - whole(y)).alias("height"))


def parse_recognised(df: DataFrame, json: str) -> DataFrame:
    """Explodes a recogniser's output, given as JSON, into pos, text, confidence, bbox.

    Two shapes are known: parallel lists (rec_texts, rec_scores, rec_polys or
    dt_polys), one object or a list of them, and nested lists of [quad, [text,
    score]] by page. What fits neither has no rows.
    """
    page = f"struct<rec_texts:array<string>,rec_scores:array<double>,rec_polys:array<{_QUAD}>,dt_polys:array<{_QUAD}>>"
    line = "array<array<array<string>>>"
    text = F.trim(F.col(json))
    lists = text.rlike(r"^\[\s*\[")
    pages = F.when(lists, F.lit(None)).when(text.startswith("["), F.from_json(text, f"array<{page}>")).otherwise(F.array(F.from_json(text, page)))
    parallel = F.flatten(F.transform(pages, lambda p: F.transform(p["rec_texts"], lambda t, n: F.struct(t.alias("text"), F.get(p["rec_scores"], n).alias("confidence"), box_of(F.get(F.coalesce(p["rec_polys"], p["dt_polys"]), n)).alias("bbox")))))
    # a nested line is a quad and a pair of different kinds, so both are read as JSON texts first
    nested = F.transform(F.flatten(F.from_json(text, line)), lambda x: F.struct(F.from_json(x[0], _QUAD).alias("q"), F.from_json(x[1], "array<string>").alias("t")))
    nested = F.transform(F.filter(nested, lambda x: x["q"].isNotNull() & x["t"].isNotNull()), lambda x: F.struct(x["t"][0].alias("text"), x["t"][1].try_cast("double").alias("confidence"), box_of(x["q"]).alias("bbox")))
    rows = df.select("*", F.posexplode(F.coalesce(F.when(lists, nested), parallel)).alias("pos", "_r"))
    return rows.select(*df.columns, "pos", "_r.*")


def _formula_body(c: Column) -> Column:
    """What stands between a formula's delimiters."""
    for delimiters in ("^\\$+|\\$+$", "^\\\\\\[|\\\\\\]$", "^\\\\\\(|\\\\\\)$"):
        c = F.trim(F.regexp_replace(c, delimiters, ""))
    return c


def latex_to_markdown(c: Column) -> Column:
    """A recognised formula between dollar signs, blanks collapsed; nothing stays nothing."""
    bare = F.regexp_replace(_formula_body(F.trim(c)), "\\s+", " ")
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.lit("$"), bare, F.lit("$")))


def parse_markdown(df: DataFrame, markdown_column: str, confidence: float = 0.9) -> DataFrame:
    """Fragments (pos, text, kind, confidence, low_confidence) of a model's Markdown answer: a line each; fences and blank lines go,
    a line that is one delimited formula is a formula."""
    lines = df.select("*", F.posexplode(F.split(F.col(markdown_column), "\r?\n")).alias("pos", "_l")).withColumn("_l", F.trim("_l"))
    lines = lines.where((F.col("_l") != "") & ~F.col("_l").rlike("^```"))
    formula = F.col("_l").rlike(r"^(\$\$?.+\$\$?|\\\[.+\\\]|\\\(.+\\\))$")
    text = F.when(formula, F.concat(F.lit("$"), _formula_body(F.col("_l")), F.lit("$"))).otherwise(F.col("_l"))
    return lines.select(*df.columns, "pos", text.alias("text"), F.when(formula, "formula").otherwise("text").alias("kind"), F.lit(confidence).alias("confidence"), F.lit(False).alias("low_confidence"))
