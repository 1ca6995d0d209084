"""Text functions as column expressions; classes of letters are written out or as \\p{...}, since \\w is ASCII only in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters stripped from both ends of a word before it is compared.
STRIP = " \t«»\"'`(),.!?;:—–…"
#: What ends a sentence, and what parts clauses.
SENTENCE_END = ".?!…"
CLAUSE_END = ",;:—–-"

#: Word endings that a term's key loses.
ENDINGS = (
    "иями ями ами ого его ему ыми ими ией ов ев ая ое ые ий ый ой ей ам ям ах ях ом ем ью ия ии ие ию а о е и ы у ю я ь й"
).split()
_VOWELS = "аеиоуыэюя"


def stripped(c: Column, chars: str = STRIP) -> Column:
    return F.trim(c, F.lit(chars))


def normalized(c: Column) -> Column:
    """A word as compared: stripped, lower case, ё as е."""
    return F.translate(F.lower(stripped(c)), "ё", "е")


def ends_sentence(c: Column) -> Column:
    return F.rtrim(c).rlike("[.?!…]$")


def ends_clause(c: Column) -> Column:
    return F.rtrim(c).rlike("[,;:—–-]$")


def starts_upper(c: Column) -> Column:
    return F.ltrim(c, F.lit(STRIP)).rlike("^\\p{Lu}")


def core(c: Column) -> Column:
    """Letters and digits alone, lower case, ё as е."""
    return F.translate(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]", ""), "ё", "е")


def line_key(c: Column) -> Column:
    """A line as compared: folded, ё as е, without punctuation, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(folded(c), "ё", "е"), "[^\\p{L}\\p{N}_\\s]+", " "), "\\s+", " "))


def term_key(c: Column) -> Column:
    """A word's key: lower case, ё as е, without its ending (four letters stay), a second soft tail and a fleeting vowel.

    A column expression that lambdas can hold; `folded`, which they can't, goes first where a word may hold other forms of its letters.
    """
    endings = "|".join(sorted(ENDINGS, key=len, reverse=True))
    k = F.trim(F.translate(F.lower(c), "ё", "е"), F.lit("-'"))
    k = F.regexp_replace(k, f"^(.{{4,}}?)(?:{endings})$", "$1")
    k = F.regexp_replace(k, "^(.{4,})[иьй]$", "$1")
    return F.regexp_replace(k, f"^(.{{2,}}[^{_VOWELS}])[ео]([^{_VOWELS}])$", "$1$2")


def folded(c: Column) -> Column:
    """Compatibility form (NFKC) and case folding, which have no built-in; in Arrow batches."""
    def fold(batch: pd.Series) -> pd.Series:
        return batch.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())

    return F.pandas_udf(fold, "string")(c)


def joined_words(words: Column) -> Column:
    """Words (array of strings) as running text: no blank before closing marks or after opening ones."""
    text = F.array_join(F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != ""), " ")
    text = F.regexp_replace(text, "\\s+([,.!?;:…»)])", "$1")
    return F.trim(F.regexp_replace(text, "([«(])\\s+", "$1"))


#: Abbreviations after whose full stop a sentence goes on.
ABBREVIATIONS = "т е д п т.е т.д т.п др пр ср см рис стр напр г гг в вв им".split()


def capitalized(text: Column) -> Column:
    """The first lower-case Cyrillic letter of a text and of each sentence in it as a capital.

    A token opens a sentence if it is the first, or if the token before it ends
    one; each token needs its neighbour alone, so no state is carried along.
    """
    tokens = F.split(text, "(?<=\\s)(?=\\S)")

    def ends(t: Column) -> Column:
        tail = F.rtrim(F.rtrim(t), F.lit("»\"')]"))
        bare = F.lower(F.rtrim(tail, F.lit(SENTENCE_END)))
        return tail.rlike("[.?!…]$") & ~(tail.rlike("\\.$") & bare.isin(ABBREVIATIONS))

    def opened(t: Column) -> Column:
        lead = F.regexp_extract(t, "^([«\"'(\\[]*)", 1)
        letter = F.substring(t, F.length(lead) + 1, F.lit(1))
        return F.when(letter.rlike("^[а-яё]$"), F.concat(lead, F.upper(letter), F.substring(t, F.length(lead) + 2, F.length(t)))).otherwise(t)

    before = F.concat(F.array(F.lit(True)), F.transform(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), ends))
    return F.array_join(F.zip_with(tokens, before, lambda t, b: F.when(b, opened(t)).otherwise(t)), "")
