"""Whether a recognised line is text, a formula or handwriting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that only formulas have; raised and lowered signs; Greek letters as signs; weak operators.
STRONG = "√∛∜∫∮∑∏±∓≤≥≠≡≈∞∈∉∋⊂⊃⊆⊇∪∩∅∀∃∄∂∇⊥∠∡°′″×÷⋅→⇒⇔↔↦∧∨¬⌊⌋⌈⌉∆"
SCRIPT = "⁰¹²³⁴⁵⁶⁷⁸⁹ⁿ⁺⁻⁽⁾₀₁₂₃₄₅₆₇₈₉₊₋₍₎"
GREEK = "αβγδεζηθικλμνξοπρςστυφχψωΓΔΘΛΞΠΣΦΨΩ"
WEAK = "=+*/^_<>|\\−–—"
#: Names of functions, which are not words.
MATH_WORDS = "sin cos tg ctg tan cot sec csc log lg ln lim max min sup inf exp sqrt det mod arcsin arccos arctg arcctg sh ch th".split()

LOW_CONFIDENCE, WEAK_RATIO, STRONG_RATIO, HANDWRITING = 0.60, 0.5, 0.7, 0.35

_STRONG = f"[{STRONG}{SCRIPT}{GREEK}]"
_WEAK = "[=+*/\\^_<>|\\\\−–—]"


def has_strong(c: Column) -> Column:
    return c.rlike(_STRONG)


def has_weak(c: Column) -> Column:
    return c.rlike(_WEAK)


def has_signal(c: Column) -> Column:
    """Strong signs, or weak ones beside a letter or digit."""
    return has_strong(c) | (has_weak(c) & c.rlike("[\\p{L}\\p{N}]"))


def word_ratio(c: Column) -> Column:
    """Share of a line's visible characters in words of three letters and more that aren't names of functions."""
    words = F.filter(F.regexp_extract_all(c, F.lit("[A-Za-zА-Яа-яЁё]{3,}"), F.lit(0)), lambda w: ~F.lower(w).isin(MATH_WORDS))
    total = F.length(F.regexp_replace(c, "\\s+", ""))
    letters = F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w))
    return F.when(total == 0, F.lit(0.0)).otherwise(letters / total)


def looks_like_formula(c: Column, weak: float = WEAK_RATIO, strong: float = STRONG_RATIO, signs: tuple | None = None) -> Column:
    """signs: has_strong, has_signal and word_ratio of the line as columns, where they are at hand."""
    is_strong, signal, ratio = signs or (has_strong(c), has_signal(c), word_ratio(c))
    return F.when(F.trim(c) == "", F.lit(False)).when(is_strong, ratio <= strong).when(signal, ratio <= weak).otherwise(F.lit(False))


def route(c: Column, confidence: Column, low: float = LOW_CONFIDENCE, signs: tuple | None = None) -> Column:
    """'formula' or 'text'. A line read with low confidence needs a sign only, whatever its share of words."""
    formula = F.when(F.trim(c) == "", F.lit(False)).when(confidence < low, signs[1] if signs else has_signal(c)).otherwise(looks_like_formula(c, signs=signs))
    return F.when(formula, F.lit("formula")).otherwise(F.lit("text"))


def looks_like_handwriting(c: Column, confidence: Column, least: float = HANDWRITING, signs: tuple | None = None) -> Column:
    return (F.trim(c) != "") & (confidence < least) & ~(signs[1] if signs else has_signal(c))


def reason(c: Column, confidence: Column, low: float = LOW_CONFIDENCE) -> Column:
    """A name for why a line was routed as it was."""
    formula = route(c, confidence, low) == "formula"
    return (
        F.when(formula & (confidence < low), F.lit("formula: low confidence")).when(formula & has_strong(c), F.lit("formula: strong signs")).when(formula, F.lit("formula: operators, few words"))
        .when(looks_like_handwriting(c, confidence), F.lit("text: handwriting")).when(confidence < low, F.lit("text: low confidence, no signs")).otherwise(F.lit("text: words"))
    )
