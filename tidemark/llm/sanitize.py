"""Sanitisation of personal data by what terms disclose.

Protected entities (addresses, numbers) are found by pattern. Over the corpus,
the co-occurrence of terms and entities in different texts estimates how much a
term tells about an entity: with p(e) and p(e|t) by texts, the pointwise mutual
information log p(e|t) / p(e), as a share of the entity's information content
-log p(e). A term whose share reaches the disclosure threshold, with enough
texts behind it, reveals the entity and is removed like the entity itself; an
entity is generalised to its kind. Copies of a text count once, so a text
reveals nothing by being repeated. All counts are exact. Only built-in functions
run.

Defined results: a null text is an empty one; texts are scanned whole; repeated
rows, equal texts (ties) and null ids are answered each; spans that start together
are ordered by kind; an empty table gives an empty result; input columns are
kept, except those named n_* of a base kind, spans and base_spans, which are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import cut, drop

#: The base patterns, written so that no text makes matching quadratic or deep: a match begins where its run of characters
#: begins (or at the end of the match before, \\G), and loops don't give back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "term"]
BASE = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=False))

#: A term reveals an entity if its share of the entity's information reaches THRESHOLD and SUPPORT different texts hold both.
THRESHOLD, SUPPORT = 0.9, 3
#: Terms are runs of three letters or digits and more, in lower case; beyond ASCII, of all characters but punctuation blocks.
TERM = r"[0-9A-Za-z\x{C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{3040}-\x{10FFFF}]{3,}"
#: So many terms, or digests of texts, at most are broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 50_000


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _bare(x: Column) -> Column:
    return F.ltrim(x, F.lit("0"))


def _luhn(s: Column) -> Column:
    digits = F.transform(F.split(F.reverse(s), ""), lambda c, i: F.when(i % 2 == 1, F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(digits, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    t = s["text"]
    if kind == "ip":
        # a part is at most 255 if, without leading zeros, it has at most three digits and isn't greater
        return F.forall(F.split(t, r"\."), lambda x: F.when(F.length(_bare(x)) <= 3, F.concat(F.lit("0"), _bare(x)).cast("int")).otherwise(F.lit(999)) <= 255)
    if kind == "card":
        d = _digits(t)
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(t)).between(8, 15)
    return F.lit(True)


def _found(docs: DataFrame) -> DataFrame:
    """docs with _m_email and so on: what the base patterns match in _text, valid or not."""
    # a text without the characters that a kind needs costs a search, not a match
    digit4 = F.col("_text").rlike("[0-9]")
    for name, pattern in BASE.items():
        needs = F.col("_text").contains("@") if name == "email" else F.col("_text").contains("+") & digit4 if name == "phone" else digit4
        docs = docs.withColumn(f"_m_{name}", F.when(needs, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    return docs


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _s_email, _s_ip, _s_card, _s_phone: arrays of (start, end, text)."""
    df = _found(docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))  # docs: internal columns and the text only
    for name, pattern in BASE.items():
        df = df.withColumn(f"_g_{name}", F.when(F.size(f"_m_{name}") > 0, F.split("_text", pattern, -1)))
    df = spans.located(df.drop("_text"), list(BASE))
    for name in BASE:
        if name != "email":
            df = df.withColumn(f"_s_{name}", _kept(name))
    return df


def _kept(name: str) -> Column:
    return F.filter(f"_s_{name}", lambda s: _valid(name, s))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """_key (a digest), _text of all rows with a text."""
    return docs.select(F.col(text).alias("_text")).where(F.length("_text") > 0).select(F.sha2("_text", 256).alias("_key"), "_text")


def disclosure(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(revealing, places): term and share, what each revealing term discloses at most; and _key, n, term: each text's n-th term, of those and other candidates.

    Terms beside entities are counted first. Those with enough support, and few
    enough texts among these, are candidates, and one pass over the terms of all
    texts finds their places, from which they are counted.
    """
    texts = _texts(docs, text)
    marked = _found(texts.where(F.col("_text").rlike(r"@[A-Za-z0-9-]+\.|[0-9][\x20.-]?[0-9]|\+[0-9]")))
    names = F.array_distinct(F.flatten(F.array(*(F.transform(F.filter(F.transform(f"_m_{k}", lambda t: F.struct(t.alias("text"))), _valid_of(k)), _named(k)) for k in BASE))))
    # a filter of one value, so that names are made once
    one = F.filter(F.array(F.struct(names.alias("entities"), F.col("_text"))), lambda s: F.size(s["entities"]) > 0)
    beside = cut(marked.select("_key", F.explode(one).alias("s")).select("_key", "s.*").dropDuplicates(["_key"]), "entity-texts")
    n_texts = texts.select("_key").distinct().count()
    # an entity that stands in fewer texts than the support can't be revealed: most are left here, before terms are paired with them
    by_entity = beside.select("_key", F.explode("entities").alias("entity"))
    often = by_entity.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support)
    held = by_entity.join(often, "entity").groupBy("_key").agg(F.collect_list(F.struct("entity", "n_e")).alias("often"))
    bare = F.col("_text")
    for pattern in BASE.values():
        bare = F.regexp_replace(bare, pattern, " ")
    apart = cut(beside.join(held, "_key").select("often", F.array_distinct(F.transform(_terms(bare), F.lower)).alias("terms")), "terms-beside")
    pairs = apart.select(F.explode("often").alias("e"), "terms").select("e.*", F.explode("terms").alias("term"))
    together = pairs.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support)
    # a term's texts are at least those with any entity: that alone rules out common words, before all texts are counted
    among = beside.select(F.explode(F.array_distinct(F.transform(_terms(F.col("_text")), F.lower))).alias("term")).groupBy("term").agg(F.count("*").alias("n_among"))
    least = F.pow(F.col("n_e") / max(1, n_texts), 1 - threshold)
    together = cut(together.join(among, "term").where(F.col("n_et") >= F.col("n_among") * least * (1 - 1e-9)).drop("n_among"), "term-entities")
    drop(apart, beside)
    terms = together.select("term").distinct()
    if terms.isEmpty():
        return together.select("term", F.lit(0.0).alias("share")), texts.select("_key", F.lit(0).alias("n"), F.lit("").alias("term")).limit(0)
    words = texts.select("_key", F.posexplode(_terms(F.col("_text"))).alias("n", "term")).withColumn("term", F.lower("term"))
    places = cut(words.join(_given(terms), "term", "left_semi").distinct(), "term-places")
    spread = places.select("_key", "term").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    p_e, p_et = F.col("n_e") / n_texts, F.least(F.lit(1.0), F.col("n_et") / F.col("n_t"))
    share = F.log(p_et / p_e) / F.greatest(-F.log(p_e), F.lit(1e-9))
    revealing = together.join(spread, "term").select("term", share.alias("share")).where(F.col("share") >= threshold).groupBy("term").agg(F.max("share").alias("share"))
    return cut(revealing, "revealing-terms"), places


def _given(terms: DataFrame) -> DataFrame:
    """Terms, or texts' digests, to be joined with all words or texts: broadcast while they are few."""
    return F.broadcast(terms) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else terms


def _chosen(texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """texts whose _key a table has; they stay where they are while the table is small."""
    return texts.join(_given(cut(keyed.select("_key").distinct(), "chosen-texts")), "_key", "left_semi")


def disclosing_terms(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """term, share: what each revealing term discloses at most, from counts over all different texts of the corpus."""
    return disclosure(docs, text, threshold, support)[0]


def _hits(docs: DataFrame, text: str, threshold: float, support: int) -> DataFrame | None:
    """_key, _terms: the places (start, kind, end) of the revealing terms of texts that hold one; None if there are none."""
    revealing, places = disclosure(docs, text, threshold, support)
    if revealing.isEmpty():
        return None
    chosen = cut(places.join(_given(revealing.select("term")), "term", "left_semi").select("_key", "n"), "chosen-places")
    drop(places)
    # few texts hold a term that reveals: only in those are words placed
    texts = _chosen(_texts(docs, text), chosen).dropDuplicates(["_key"])
    placed = spans.located(spans.matches(texts, "_text", {"term": TERM}).drop("_text"), ["term"])
    hit = placed.join(chosen.groupBy("_key").agg(F.sort_array(F.collect_set("n")).alias("which")), "_key")
    word = lambda n: F.get(F.col("_s_term"), n)
    hit = hit.select("_key", F.transform("which", lambda n: F.struct(word(n)["start"].alias("start"), F.lit(4).alias("kind"), word(n)["end"].alias("end"))).alias("_terms"))
    # a table of its own, so that the join with all rows of a hot text can be split
    made = cut(hit, "term-hits")
    drop(chosen, revealing)
    return made


def _valid_of(kind: str):
    return lambda s: _valid(kind, s)


def _named(kind: str):
    """An entity as compared: its kind and its characters, digits only where the kind's separators vary."""
    return lambda s: F.concat(F.lit(kind + ":"), _digits(s["text"]) if kind in ("card", "phone") else F.lower(s["text"]))


def scan(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (long), base_spans and spans (arrays of start, kind number, end; kinds as in KINDS)."""
    names = [f"n_{k}" for k in BASE]
    kept = [c for c in docs.columns if c not in (*names, "base_spans", "spans")]
    # the input row travels as one value, so no name in it can clash with those used here
    df = entities(docs.select(F.struct(*kept).alias("_row"), F.col(text).alias("_t")), "_t")
    base = F.concat(*(spans.tagged(F.col(f"_s_{k}"), n) for n, k in enumerate(BASE)))
    df = df.select("_row", "_t", *(F.size(f"_s_{k}").cast("long").alias(f"n_{k}") for k in BASE), F.array_sort(base).alias("base_spans"))
    hit = _hits(docs, text, threshold, support)
    if hit is None:
        return df.select("_row.*", *names, "base_spans", F.col("base_spans").alias("spans"))
    joined = df.withColumn("_key", F.sha2(F.coalesce("_t", F.lit("")), 256)).join(hit, "_key", "left")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return joined.select("_row.*", *names, "base_spans", F.array_sort(F.concat("base_spans", F.coalesce("_terms", empty))).alias("spans"))


def sanitized(text: str = "text", found: str = "spans") -> Column:
    """The text with entities generalised to their kind ([EMAIL] and so on) and revealing terms removed."""
    t = F.coalesce(F.col(text), F.lit(""))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]], F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        piece = F.when(s["start"] >= acc["at"], F.concat(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    done = F.aggregate(F.col(found), start, step)
    return F.when(F.size(found) == 0, F.col(text)).otherwise(F.concat(F.array_join(done["out"], ""), F.substring(t, done["at"] + 1, F.length(t))))
