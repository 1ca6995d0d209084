"""Secret scans with character Markov models.

Two first-order models over characters, one of random strings and one of
ordinary identifiers, are trained from labelled samples: bigram counts by an
aggregate, smoothed, as log-probabilities. Random strings are made in several
alphabets and lengths. Ordinary ones are the corpus's own tokens that stand in
several texts, beside numbers and identifiers made of common words. A candidate
token's evidence is the greatest sum of log-likelihood ratios of neighbouring
bigrams in it, so what is ordinary around a secret does not dilute it. The
threshold is fitted on labelled rows that the models have not seen: of the
ordinary ones a share of FALSE at most reaches it. Fixed-format secrets
(assignments, access keys, long hex) are found by pattern and always kept. Only
built-in functions run: no Python on the executors.

Defined results: a null text is an empty one and has no spans; texts of any
length are scanned whole; repeated rows, equal texts (ties) and null ids are
answered each; spans that start together are ordered by kind; an empty table
gives an empty result, and models of made samples alone; input columns are kept,
except that columns named spans, base_spans or n_* of a base kind are replaced.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .common import cut, drop

#: Fixed patterns of the base kinds; the keyword's letters count in either case.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Tokens that the models judge; what adjoins another letter or digit is a part of a word.
CANDIDATE = r"(?<![\p{L}\p{N}+/_=-])[A-Za-z0-9+/_=-]{8,}+(?![\p{L}\p{N}])"
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: The share of unseen ordinary samples that may reach the threshold.
FALSE = 0.0005
#: A token of the corpus is ordinary if texts with it fall into so many of 64 hash classes: it stands in as many different texts at least.
COMMON = 3
#: Odds of a token against being a secret, before it is looked at: the least evidence is their logarithm.
ODDS = 10_000

#: Words of which ordinary identifiers are made.
WORDS = (
    "account action address after array before between block body border bottom buffer build button cache call case change channel check child class "
    "clear click client close code color column comment commit config connection content context control copy count create current data date default "
    "delete display document double down element empty enable encode error event example export field file filter first float folder font form "
    "format function get group handler header height hidden history home image import index info initial input insert integer item join key label language "
    "last layout length level library light limit line link list load local location lock login long manager mask match message method middle model module "
    "month mouse move name native network next node note number object offset open option order output owner page panel parent parse password path pattern "
    "payment pending people picture place player point position post prefix present previous price print private process product profile project property "
    "protocol public query queue range read record reference region remove render report request reset resource response result return right role root row "
    "sample save scale schema scroll search section select send server service session setting shadow shape share shift short show simple single size "
    "source space special start state status step storage stream string style submit success summary support switch symbol system table target task "
    "template text theme thread time title today token total track train transfer tree trigger type under union unit update upload user utility valid value "
    "vector version video view visible volume wait warning weather width window with without word work write year zone "
    "and are from have that the their there these this those through what when where which while with would about other into than then them some "
    "der die das und nicht mit eine werden auf fur ist sich von dem les des une est dans pour que qui avec sur las los una por para con del como"
).split()


def generated(spark: SparkSession, n: int = 6000, salt: str = "") -> DataFrame:
    """Labelled samples (text, label 1: random) made by a rule: digests in several alphabets and lengths; words joined in the usual styles, and numbers."""
    ids = spark.range(n)
    words = F.array(*map(F.lit, WORDS))
    number = lambda k, m: F.pmod(F.xxhash64("id", F.lit(f"{salt}{k}")), F.lit(m))
    pick = lambda k: F.element_at(words, (number(k, len(WORDS)) + 1).cast("int"))
    digest = lambda k: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt + k)), 512)
    raw = lambda k: F.regexp_replace(F.base64(F.unhex(digest(k))), "\\s", "")
    plain = lambda k: F.regexp_replace(raw(k), "[+/=]", "")
    one_of = lambda k, options: F.element_at(F.array(*options), (number(k, len(options)) + 1).cast("int"))
    random = one_of("kind", [raw("a"), F.translate(raw("b"), "+/=", "-_"), plain("c"), F.upper(plain("d")), F.lower(plain("e")), digest("f"), F.upper(digest("g"))])
    random = F.substring(random, F.lit(1), (number("length", 57) + 8).cast("int"))
    four = F.slice(F.array(*(pick(k) for k in range(4))), F.lit(1), (number("words", 3) + 2).cast("int"))
    title = F.transform(four, F.initcap)
    digits = lambda k, m: F.lpad(number(k, 10**m).cast("string"), m, "0")
    ordinary = one_of("style", [
        F.array_join(four, "_"), F.array_join(four, "-"), F.array_join(title, ""), F.array_join(four, ""), F.upper(F.array_join(four, "_")), F.concat(F.array_join(four, "/"), number("tail", 100).cast("string")),
        F.concat(digits("x", 8), digits("y", 8)), F.concat_ws("-", digits("x", 4), digits("y", 2), digits("z", 2)), F.concat_ws("-", digits("x", 3), digits("y", 4)), F.concat(F.lit("="), F.array_join(four, "=")),
    ])
    return ids.select(random.alias("text"), F.lit(1).alias("label")).union(ids.select(ordinary.alias("text"), F.lit(0).alias("label")))


def ordinary(docs: DataFrame, text: str = "text") -> DataFrame:
    """text: the corpus's tokens that stand in several different texts, each once; what the base patterns hold is left out."""
    t = F.col(text)
    found = "|".join((ASSIGN, ACCESS, HEX))
    bare = F.when(t.rlike(found), F.regexp_replace(t, found, " ")).otherwise(t)
    tokens = F.array_distinct(F.regexp_extract_all(bare, F.lit(CANDIDATE), F.lit(0)))
    # one bit for each of 64 classes of texts: copies of a text set one bit, and the classes of all rows are joined before the shuffle
    seen = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))
    rows = docs.where(t.isNotNull()).select(F.explode(tokens).alias("text"), seen.alias("seen"))
    return rows.groupBy("text").agg(F.bit_or("seen").alias("seen")).where(F.bit_count("seen") >= COMMON).select("text")


def samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """Labelled samples (text, label): made ones of both kinds, and the corpus's ordinary tokens, as they are, in capitals and as titles."""
    styles = F.array_distinct(F.array("text", F.upper("text"), F.initcap("text")))
    return generated(docs.sparkSession).union(ordinary(docs, text).select(F.explode(styles).alias("text"), F.lit(0).alias("label")))


class Model(NamedTuple):
    """Log-likelihood ratios of all bigrams (first character times alphabet size plus second) and the evidence from which a token is a secret."""

    ratios: list[float]
    threshold: float


def train(labelled: DataFrame, text: str = "text", label: str = "label", false: float = FALSE) -> Model:
    """Fit on labelled rows: bigrams, add-half smoothed, from three quarters of them by hash, the threshold from the last quarter's ordinary ones.

    The counts are one aggregate over the sample; at most 2 * 67 * 67 of them
    reach the driver.
    """
    size = len(ALPHABET)
    rows = labelled.select(F.col(label).alias("y"), F.col(text).alias("text")).where(F.col("y").isin(0, 1) & (F.length("text") > 1))
    table = cut(rows.withColumn("fit", F.pmod(F.xxhash64("text"), F.lit(4)) > 0), "labelled-tokens")
    # one character after the other, as number in the alphabet (-1: another character)
    codes = F.transform(F.split("text", ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
    pairs = table.where("fit").select("y", codes.alias("c"))
    pairs = pairs.select("y", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: F.when((a >= 0) & (b >= 0), a * size + b))).alias("pair"))
    counts = {0: [0.5] * size * size, 1: [0.5] * size * size}
    for r in pairs.where(F.col("pair").isNotNull()).groupBy("y", "pair").count().collect():
        counts[r["y"]][r["pair"]] += r["count"]
    ratios = []
    for a in range(size):
        row = slice(a * size, (a + 1) * size)
        sums = {y: sum(counts[y][row]) for y in counts}
        ratios += [math.log(p / sums[1]) - math.log(q / sums[0]) for p, q in zip(counts[1][row], counts[0][row], strict=True)]
    whole = F.length("text") >= 8
    rest = table.where(~F.col("fit") & (F.col("y") == 0) & whole).agg(F.percentile(evidence(F.col("text"), ratios), 1 - false)).first()[0]
    drop(table)
    return Model(ratios, max(math.log(ODDS), rest or 0.0))


def evidence(token: Column, ratios: list[float]) -> Column:
    """The greatest sum of the log-likelihood ratios of neighbouring bigrams in a token; it holds characters of ALPHABET only."""
    size = len(ALPHABET)
    table = F.array(*[F.lit(round(x, 6)) for x in ratios])
    number = F.array(*[F.lit(ALPHABET.find(chr(c))) for c in range(128)])
    zero = F.lit(0.0)
    start = F.struct(F.lit(-1).alias("last"), zero.alias("run"), zero.alias("best"))

    def step(acc, c):
        n = F.get(number, F.ascii(c))
        here = F.when(acc["last"] >= 0, F.get(table, acc["last"] * size + n)).otherwise(zero)
        return F.struct(n.alias("last"), F.greatest(zero, acc["run"] + here).alias("run"), F.greatest(acc["best"], acc["run"]).alias("best"))

    return F.aggregate(F.split(token, ""), start, step, lambda acc: F.greatest(acc["best"], acc["run"]))


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex (long), base_spans and spans (arrays of kind number, start, end; kinds as in KINDS).

    A token that a base span holds is not given again.
    """
    kept = [c for c in docs.columns if c not in ("n_assign", "n_access", "n_hex", "spans", "base_spans")]
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "markov": CANDIDATE}
    # the input row travels as one value, so no name in it can clash with those used here
    df = docs.select(F.struct(*kept).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    secret = lambda t: evidence(t, model.ratios) >= model.threshold
    # tokens are placed in texts that hold a secret one only
    tokens = F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0))
    df = df.withColumn("_tokens", tokens).withColumn("_text", F.struct("_text", F.exists("_tokens", secret).alias("any"))).select("_row", "_text.*")
    df = spans.located(spans.matches(df, "_text", patterns, {"markov": F.col("any")}).drop("_text", "any"), list(patterns))
    value = lambda s: F.regexp_extract(s["text"], r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1)
    df = df.withColumn("_s_assign", F.filter("_s_assign", lambda s: F.length(value(s)) >= 8))
    df = df.withColumn("_s_markov", F.filter("_s_markov", lambda s: secret(s["text"])))
    base = F.concat(*(spans.tagged(F.col(f"_s_{k}"), n) for n, k in enumerate(KINDS[:3])))
    df = df.withColumn("_base", base).withColumn("_s_markov", F.filter("_s_markov", lambda s: ~F.exists("_base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))))
    base = F.col("_base")
    df = df.withColumn("base_spans", F.array_sort(base)).withColumn("spans", F.array_sort(F.concat(F.col("base_spans"), spans.tagged(F.col("_s_markov"), 3))))
    return df.select("_row.*", *(F.size(f"_s_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]), "base_spans", "spans")


def redact(text: str, found: str = "spans", mask: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans are one. Pieces are joined in text order."""
    t = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        piece = F.when(s["start"] >= acc["at"], F.concat(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    done = F.aggregate(F.col(found), start, step)
    return F.when(F.size(found) == 0, F.col(text)).otherwise(F.concat(F.array_join(done["out"], ""), F.substring(t, done["at"] + 1, F.length(t))))
