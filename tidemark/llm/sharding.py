"""Sharding by histogram sort.

Rows are ordered by a 64-bit hash of their text, so equal texts are one key and
never part. The splitters between shards are found by counting: each round
cuts the key intervals that still hold a target into equal parts, counts the
exact bytes of each part over all partitions (one partial aggregate; only the
counts reach the driver, at most ``probes`` for each open splitter), and goes on
until each splitter meets its target within the tolerance or its interval holds
a single key. One exchange then deals the rows.

Defined results: a null text has no bytes and the crc of no bytes; empty texts
are one key; texts of any length count with all their bytes, and none travels;
equal texts (ties) share a shard, so a text that outweighs a share makes its
shard heavier; rows with a null doc_id take part like all others; repeated rows
are all kept, each with a slot; an empty table gives an empty result; other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SPAN = 1 << 64
LOW = -(1 << 63)
#: Rows of one slot range, the unit in which positions in a shard are numbered.
RANGE_ROWS = 50_000


def splitters(keyed: DataFrame, shards: int, tolerance: float = 0.001, probes: int = 256) -> list[int]:
    """Upper bounds (exclusive) of all shards but the last: the key boundaries with byte counts nearest to equal shares.

    keyed has ``key`` long and ``size`` long. The driver holds counts of at
    most (shards - 1) * probes intervals at a time, whatever the input.
    """
    # Fixed-width intervals, so that an interval's number is plain integer arithmetic in the JVM.
    width = SPAN // 4096
    part = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(LOW)), 52).cast("long")
    counts = {r[0]: r[1] for r in keyed.groupBy(part.alias("part")).agg(F.sum("size")).collect()}
    total = sum(counts.values())
    allowed = max(1, int(total / shards * tolerance))
    found: dict[int, int] = {}
    open_: dict[int, tuple[int, int, int]] = {}  # splitter -> interval's low end, its width, bytes below it
    below, order = 0, sorted(counts)
    nth = 1
    for p in order:
        while nth < shards and below + counts[p] >= total * nth / shards:
            open_[nth] = (LOW + p * width, width, below)
            nth += 1
        below += counts[p]
    for n in range(nth, shards):
        found[n] = LOW + SPAN
    while open_:
        bounds = sorted({(low, w) for low, w, _ in open_.values()})
        chosen, sub = None, None
        for low, w in bounds:
            step = max(1, w // probes)
            inside = (F.col("key") >= F.lit(low)) & (F.col("key") <= F.lit(low + w - 1))
            n = F.floor((F.col("key") - F.lit(low)) / F.lit(step)) if step < (1 << 40) else F.shiftright(F.col("key") - F.lit(low), step.bit_length() - 1)
            entry = F.struct(F.lit(low).alias("low"), n.cast("long").alias("n"))
            chosen = inside if chosen is None else chosen | inside
            sub = F.when(inside, entry) if sub is None else sub.when(inside, entry)
        near = keyed.where(chosen).groupBy(sub.alias("at")).agg(F.sum("size").alias("size"), F.min("key").alias("least"), F.max("key").alias("most"))
        parts: dict[int, list] = {}
        for r in near.collect():
            parts.setdefault(r["at"]["low"], []).append((r["at"]["n"], r["size"], r["least"], r["most"]))
        nxt = {}
        for nth, (low, w, under) in open_.items():
            step = max(1, w // probes)
            goal = total * nth / shards
            for n, size, least, most in sorted(parts.get(low, [])):
                if under + size >= goal or n == max(x[0] for x in parts[low]):
                    if min(abs(goal - under), abs(under + size - goal)) <= allowed or least == most or step == 1:
                        # the nearer of the two boundaries around this part
                        found[nth] = least if goal - under <= under + size - goal else most + 1
                    else:
                        nxt[nth] = (low + n * step, step, under)
                    break
                under += size
            else:
                found[nth] = low
        open_ = nxt
    return [found[n] for n in range(1, shards)]


def histogram_sort(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal rows into shards of near equal bytes (UTF-8 bytes of the text plus 1); equal texts share a shard.

    Returns row_id, size, text_crc32, shard and slot. slot counts the rows of a
    shard from 0 without gaps. Positions are numbered by (shard, hash range of
    the row) and shifted by the ranges' counts, so no task holds a shard.
    """
    rows = docs.select(
        F.col(row_id).alias("_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"),
    )
    # the row's place tells equal rows apart, so that they can be dealt over ranges
    keyed = cut(rows.withColumn("place", F.monotonically_increasing_id()), "shard-keys")
    ends = splitters(keyed.select("key", "size"), shards, tolerance)
    shard = F.lit(0)
    for n, end in enumerate(ends, 1):
        if end < LOW + SPAN:
            shard = F.when(F.col("key") >= F.lit(end), F.lit(n)).otherwise(shard)
    count = keyed.count()
    bits = max(0, (count // max(1, shards) // RANGE_ROWS).bit_length())
    spread = F.xxhash64("_id", "text_crc32", "place")
    placed = keyed.select(
        "_id", "size", "text_crc32", "place", shard.cast("int").alias("shard"), spread.alias("spread"),
        (F.shiftrightunsigned(spread, 64 - bits) if bits else F.lit(0)).cast("long").alias("range"),
    )
    ranges = placed.groupBy("shard", "range").count()
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("shard").alias("_s"), F.col("range").alias("_r"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "range").orderBy("spread", "place")
    numbered = placed.withColumn("n", F.row_number().over(within))
    return numbered.join(ranges, (F.col("shard") == F.col("_s")) & (F.col("range") == F.col("_r"))).select(
        F.col("_id").alias(row_id), "size", "text_crc32", "shard", (F.col("first") + F.col("n") - 1).cast("long").alias("slot")
    )
