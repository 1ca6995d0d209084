"""Conservative clean-up of spoken words: fillers, repeats, truncated starts. Dictionaries are parameters; the Russian ones are defaults."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STRIP, ends_clause, ends_sentence, normalized, starts_upper
from .islands import ordered
from .stages import staged

# The Russian dictionaries.
FILLER_WORDS = "э ээ эээ ээээ эм эмм мм ммм мда ааа аа ээм нуу нуэ".split()
FILLER_PHRASES = [("ну", "вот"), ("вот", "ну")]
AMBIGUOUS_PHRASES = [("как", "бы"), ("так", "сказать"), ("скажем", "так"), ("это", "самое")]
ALLOWED_DOUBLES = "очень чуть еле давно далеко долго много совсем тихо быстро едва".split()
NUMERALS = (
    "ноль нуля нулю нулём нуль один одна одно одного одной одному одним два две двух двум двумя дважды"
    " три трёх трех трём трем тремя трижды четыре четырёх четырех четырём четырем пять пяти пятью"
    " шесть шести семь семи восемь восьми девять девяти десять десяти одиннадцать двенадцать тринадцать четырнадцать"
    " пятнадцать шестнадцать семнадцать восемнадцать девятнадцать двадцать тридцать сорок пятьдесят"
    " шестьдесят семьдесят восемьдесят девяносто сто ста двести триста четыреста пятьсот"
    " шестьсот семьсот восемьсот девятьсот тысяча тысячи тысяч миллион миллиона миллионов раз раза"
).split()
MATH_TOKENS = (
    "плюс минус равно равен равна равны равняется умножить умноженное разделить делить деленное"
    " дробь модуль степень степени квадрат квадрате куб кубе корень корня факториал процент процентов сумма интеграл"
    " икс игрек зет эн ка эль эс тэ бэ вэ гэ дэ жэ пэ цэ эр эф аш"
    " альфа бета гамма дельта эпсилон дзета эта тета тэта йота каппа лямбда мю ню кси пи ро сигма тау фи хи пси омега"
).split()
SERVICE_LETTERS = "в и с к у я".split()


@dataclass(frozen=True)
class CleanupRules:
    fillers: tuple = tuple(FILLER_WORDS)
    phrases: tuple = tuple(FILLER_PHRASES)
    ambiguous: tuple = tuple(AMBIGUOUS_PHRASES)
    doubles: tuple = tuple(ALLOWED_DOUBLES)
    content: tuple = tuple(NUMERALS + MATH_TOKENS)
    service_letters: tuple = tuple(SERVICE_LETTERS)
    longest: int = 3
    gap: float = 0.3


def mark_fillers(words: DataFrame, keys: list[str], pos: str, text: str, start: str, end: str, rules: CleanupRules = CleanupRules()) -> DataFrame:
    """Adds filler: single fillers and phrases of two words; an ambiguous phrase only where it is set off by marks and pauses on
    both sides within a sentence. A word that ends a sentence stays. A phrase's two words differ, so neighbours decide."""
    w = ordered(keys, [pos])
    at = lambda c, n: F.lag(c, n).over(w) if n > 0 else F.lead(c, -n).over(w) if n < 0 else F.col(c)
    df = words.withColumn("_n", normalized(F.col(text))).withColumn("_p", ends_sentence(F.col(text))).withColumn("_c", ends_clause(F.col(text))).withColumn("_u", starts_upper(F.col(text)))
    in_list = lambda some: _any([(F.col("_n") == a) & (at("_n", -1) == b) for a, b in some])
    free = ~F.col("_p") & ~F.coalesce(at("_p", -1), F.lit(True))
    left = F.coalesce(at("_c", 1) & (F.col(start) - at(end, 1) >= rules.gap), F.lit(False))
    right = at("_c", -1) & F.coalesce(at(start, -2) - at(end, -1) >= rules.gap, F.lit(True))
    inserted = ~F.col("_u") & ~F.coalesce(at("_p", 1), F.lit(False)) & left & F.coalesce(right, F.lit(False))
    begins = free & (in_list(rules.phrases) | (in_list(rules.ambiguous) & inserted))
    df = df.withColumn("_begin", F.coalesce(begins, F.lit(False)))
    # "a b a": with phrases (a, b) and (b, a) both match; each phrase is judged by itself, and all matches go
    single = F.col("_n").isin(list(rules.fillers)) & ~F.col("_p") if rules.fillers else F.lit(False)
    filler = F.coalesce(single, F.lit(False)) | F.col("_begin") | F.coalesce(at("_begin", 1), F.lit(False))
    return df.withColumn("filler", filler).drop("_n", "_p", "_c", "_u", "_begin")


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def mark_truncated(words: DataFrame, keys: list[str], pos: str, text: str) -> DataFrame:
    """Adds truncated: a word cut off with a hyphen whose stem the next word begins with and goes on from."""
    w = ordered(keys, [pos])
    raw = F.trim(F.col(text), F.lit(" \t«»\"'`"))
    stem = F.rtrim(normalized(raw), F.lit("-"))
    following = normalized(F.lead(text).over(w))
    cut = raw.rlike("-$") & (stem != "") & F.startswith(following, stem) & (F.length(following) > F.length(stem)) & ~ends_sentence(F.col(text))
    return words.withColumn("truncated", F.coalesce(cut, F.lit(False)))


# ------------------------------------------------------------ repeated words


def _bare(text: str) -> str:
    return text.strip(STRIP).lower().replace("ё", "е")


def _upper(text: str) -> bool:
    return text.lstrip(STRIP)[:1].isupper()


def _ends(text: str) -> bool:
    return text.rstrip()[-1:] in tuple(".?!…")


class Collapser:
    """Finds which words a repeated run of n words loses. A list is walked with a stack of survivors: after a loss the place is
    looked at again, so a series of any length becomes one copy."""

    def __init__(self, rules: CleanupRules):
        self.rules, self.doubles, self.content, self.letters = rules, set(rules.doubles), set(rules.content), set(rules.service_letters)

    def _meant(self, early: str, late: str, key: str) -> bool:
        """A number, a sign's name or a letter: said twice on purpose."""
        if len(key) == 1:
            return key not in self.letters or (_upper(early) and _upper(late))
        return key in self.content or any(ch.isdigit() for ch in key)

    def _loses(self, texts, keys, live, at, n):
        """'early', 'late' or None for the two copies of n words at a place."""
        one, two = live[at : at + n], live[at + n : at + 2 * n]
        if len(two) < n or any(not keys[i] or keys[i] != keys[j] for i, j in zip(one, two, strict=True)):
            return None
        if any(self._meant(texts[i], texts[j], keys[i]) for i, j in zip(one, two, strict=True)):
            return None
        if n == 1 and keys[one[0]] in self.doubles:
            third = live[at + 2 : at + 3]
            if not third or keys[third[0]] != keys[one[0]]:
                return None
        side, gone = "early", one
        if _upper(texts[one[0]]) and not _upper(texts[two[0]]):
            plain = lambda i: texts[i].strip().lower().replace("ё", "е")
            if any(plain(i) != plain(j) for i, j in zip(one, two, strict=True)):
                return None
            side, gone = "late", two
        return None if any(_ends(texts[i]) for i in gone) else side

    def keep(self, texts: list[str], sizes=None) -> list[int]:
        keys, live = [_bare(t) for t in texts], list(range(len(texts)))
        for n in sizes or range(self.rules.longest, 0, -1):
            # what is settled is done; the rest lies reversed, so that a look costs its few words whatever lies behind
            done, rest = [], live[::-1]
            while rest:
                side = self._loses(texts, keys, rest[: -2 * n - 2 : -1], 0, n)
                if side == "early":
                    del rest[-n:]
                elif side == "late":
                    del rest[-2 * n : -n]
                else:
                    done.append(rest.pop())
            live = done
        return live


def kept_after_repeats(texts: Column, rules: CleanupRules = CleanupRules(), sizes: tuple | None = None) -> Column:
    """Positions (from 0) of the words of an array that stay when repeats collapse; an Arrow function, since each loss moves the next look."""

    @F.arrow_udf("array<int>")
    def positions(lists: pa.Array) -> pa.Array:
        c = Collapser(rules)
        return pa.array([None if x is None else c.keep([t or "" for t in x], sizes) for x in lists.to_pylist()], pa.list_(pa.int32()))

    return positions(texts)


def collapse_repeats(words: DataFrame, keys: list[str], pos: str, text: str, rules: CleanupRules = CleanupRules(), sizes: tuple | None = None) -> DataFrame:
    """words without collapsed repeats. Only positions and texts of a section go through the function."""
    lists = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(pos, text))).alias("_l"))
    kept = lists.select(*keys, F.col("_l")[pos].alias("_p"), kept_after_repeats(F.col("_l")[text], rules, sizes).alias("_k"))
    kept = kept.select(*keys, F.explode(F.transform("_k", lambda i: F.get(F.col("_p"), i))).alias(pos))
    return words.join(kept, [*keys, pos], "left_semi")


def cleaned(words: DataFrame, keys: list[str], pos: str, text: str, start: str, end: str, rules: CleanupRules = CleanupRules()) -> DataFrame:
    """All rules in their order; a section that would lose all its words keeps them all."""
    one = mark_fillers(words, keys, pos, text, start, end, rules).where(~F.col("filler")).drop("filler")
    two = collapse_repeats(one, keys, pos, text, rules)
    three = staged(mark_truncated(two, keys, pos, text).where(~F.col("truncated")).select(*keys, pos), "kept-words")
    some = three.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    lost = words.join(some, on, "left_anti")
    return words.join(three, [*keys, pos], "left_semi").unionByName(lost)
