"""Positions of regular-expression matches with built-in functions only.

Spark returns matches but not their places. Splitting the text by the same
pattern gives the gaps between them, so a running sum of the lengths of gaps
and matches is each match's place. All places are in code points. Sums are made
in two levels, so a text with very many matches costs no quadratic copying.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,kind:int,text:string>>"


def matches(df: DataFrame, text: str, patterns: dict[str, str], needs: dict[str, Column] | None = None) -> DataFrame:
    """Adds, for each name, its pattern's leftmost non-overlapping matches and the gaps before them (null where there are none).

    needs: conditions without which a pattern has no matches of interest; where they fail, it is not searched for.
    """
    for name, pattern in patterns.items():
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        if needs and name in needs:
            found = F.when(needs[name], found).otherwise(F.array().cast("array<string>"))
        df = df.withColumn(f"_m_{name}", found)
    for name, pattern in patterns.items():
        df = df.withColumn(f"_g_{name}", F.when(F.size(f"_m_{name}") > 0, F.split(F.col(text), pattern, -1)))
    return df


def _let(value: Column, use) -> Column:
    """use(value), in which value is made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(lengths: Column) -> Column:
    """array<struct<g, m>> of gap and match lengths -> array<struct<start, end>>.

    The array is cut into about as many blocks as a block has entries; a place is
    the sum of the blocks before plus that of its block up to it. A fold that
    carried the result along would copy it at each step.
    """
    total = lambda pairs: F.aggregate(pairs, F.lit(0), lambda a, x: a + x["g"] + x["m"])
    size = lambda pairs: F.ceil(F.sqrt(F.size(pairs))).cast("int")
    blocks = lambda pairs: _let(size(pairs), lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / n).cast("int")), lambda k: F.slice(pairs, k * n + 1, n)))
    before = lambda sums: F.transform(sums, lambda s, k: F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), lambda a, x: a + x))

    def placed(block, offset):
        def one(x, i):
            return _let(offset + total(F.slice(block, F.lit(1), i)) + x["g"], lambda at: F.struct(at.alias("start"), (at + x["m"]).alias("end")))

        return F.transform(block, one)

    return _let(lengths, lambda pairs: _let(blocks(pairs), lambda bs: F.flatten(F.zip_with(bs, _let(F.transform(bs, total), before), placed))))


def located(df: DataFrame, names: list[str]) -> DataFrame:
    """Replaces matches and gaps of each name by _s_<name>: array<struct<start, end, text>> in text order."""
    for name in names:
        m, g = F.col(f"_m_{name}"), F.col(f"_g_{name}")
        df = df.withColumn(f"_l_{name}", F.when(g.isNotNull(), F.zip_with(F.transform(F.slice(g, 1, F.size(m)), F.length), F.transform(m, F.length), lambda a, b: F.struct(a.alias("g"), b.alias("m")))))
    for name in names:
        lengths = F.col(f"_l_{name}")
        df = df.withColumn(f"_p_{name}", F.when(lengths.isNotNull(), _running(lengths)))
    for name in names:
        placed = F.zip_with(F.col(f"_p_{name}"), F.col(f"_m_{name}"), lambda p, t: F.struct(p["start"].alias("start"), p["end"].alias("end"), t.alias("text")))
        empty = F.array().cast("array<struct<start:int,end:int,text:string>>")
        df = df.withColumn(f"_s_{name}", F.coalesce(F.when(F.col(f"_p_{name}").isNotNull(), placed), empty))
    return df.drop(*[f"_{x}_{n}" for n in names for x in "mglp"])


def tagged(spans: Column, kind: int) -> Column:
    """Spans as structs that sort by start, then kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def listed(spans: Column, kinds: list[str], by_kind: bool = False) -> Column:
    """Spans as kind:start:end, comma-joined; sorted by start, then kind, or by kind, then start."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))) if by_kind else F.array_sort(spans)
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
