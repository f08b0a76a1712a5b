"""Range sharding by sampled splitters.

Records are ordered by (hash of the text, hash of doc_id, row number), so equal texts
lie together and no two records have one key. A size-weighted sample of keys gives
quantile boundaries; records are range partitioned by them; ranges whose measured
bytes are far above their share get more splitters from samples of their own until
none is. Prefix sums over the ranges then place every record exactly: a shard is an
equal stretch of bytes. Ranges and samples grow with the number of records.

Defined results: a null text has no bytes (size 1); null and repeated ids are placed
like any other; repeated rows are placed each, also where one text holds a large share
of all rows, since their row numbers let splitters part them; an empty table gives no
rows; further columns are ignored. A group of equal texts that would straddle a
boundary stays whole if it is at most ``whole`` of a shard.
"""

from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.llm.common import numbered, text_of

KEY = ["h", "s", "row"]
RANGE_ROWS = 400_000
PER_RANGE = 150  # of the sample


def measured(docs: DataFrame) -> DataFrame:
    raw, ident = text_of("text").cast("binary"), F.col("doc_id").cast("long")
    x = docs.select(
        ident.alias("doc_id"), (F.octet_length(text_of("text")) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.xxhash64(text_of("text"), F.lit(7)).alias("h"), F.xxhash64(ident, F.lit(9)).alias("s"),
    )
    return numbered(x, "row")


def sample(keys: DataFrame, step: F.Column, seed: int) -> list:
    """Keys, each drawn with a chance of its size to the column ``step`` (sizes above the step always): the sizes over the steps
    add up to how many are drawn, about."""
    u = F.pmod(F.xxhash64(*KEY, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return [(r["part"], (r["h"], r["s"], r["row"])) for r in keys.filter(u < F.col("size") / step).select("part", *KEY).collect()]


def quantiles(keys: list, parts: int) -> list:
    keys = sorted(keys)
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def ranged(keys: DataFrame, splitters: list[tuple[int, int, int]]) -> DataFrame:
    """Adds part: how many splitters are at or below the key. The splitters are a bounded sample."""
    hs = np.array([k[0] for k in splitters], np.int64)
    rest = np.array([k[1:] for k in splitters], [("s", np.int64), ("row", np.int64)])

    @F.pandas_udf("int")
    def part(h: pd.Series, s: pd.Series, row: pd.Series) -> pd.Series:
        lo, hi = np.searchsorted(hs, h.to_numpy(), "left"), np.searchsorted(hs, h.to_numpy(), "right")
        out = lo.copy()
        tie = np.nonzero(lo < hi)[0]
        own = np.empty(len(tie), rest.dtype)
        own["s"], own["row"] = s.to_numpy()[tie], row.to_numpy()[tie]
        for a, b in set(zip(lo[tie].tolist(), hi[tie].tolist())):  # a hash that splitters cut
            here = lo[tie] == a
            out[tie[here]] = a + np.searchsorted(rest[a:b], own[here], "right")
        return pd.Series(out.astype("int32"))

    return keys.withColumn("part", part(*KEY) if splitters else F.lit(0))


def shard(docs: DataFrame, shards: int = 8, ranges: int | None = None, whole: float = 0.02, seed: int = 5) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): byte sums near equal, slots gapless from 0 in key order."""
    keys = measured(docs)
    total, rows = keys.agg(F.sum("size"), F.count("*")).first()
    if total is None:
        return keys.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = ranges or max(128, rows // RANGE_ROWS)
    fair = total / ranges
    x = keys.withColumn("part", F.lit(0))
    splitters = quantiles([k for _, k in sample(x, F.lit(max(1.0, fair / PER_RANGE)), seed)], ranges)
    for again in range(4):
        x = ranged(keys, splitters)
        # One row a range; those far above their share, other than through one huge record, are split again.
        sums = x.groupBy("part").agg(F.sum("size").alias("n"), F.max("size").alias("m")).collect()
        big = {r.part: r.n for r in sums if r.n > 2 * fair and r.n > 2 * r.m}
        if not big:
            break
        steps = keys.sparkSession.createDataFrame([(p, n / (2.0 * PER_RANGE)) for p, n in big.items()], "part int, step double")
        got = sample(x.join(F.broadcast(steps), "part"), F.greatest(F.lit(1.0), F.col("step")), seed + 1 + again)
        for p, own in groupby(sorted(got), lambda g: g[0]):
            splitters += quantiles([k for _, k in own], int(np.ceil(big[p] / fair)))
        splitters = sorted(set(splitters))
    x = ranged(keys, splitters)
    # Prefix sums: one row a range, then rows inside each range.
    sums = x.groupBy("part").agg(F.sum("size").alias("n"), F.count("*").alias("k"))
    w = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = F.broadcast(sums.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_bytes"), F.coalesce(F.sum("k").over(w), F.lit(0)).alias("_rows")))
    inside = W.partitionBy("part").orderBy(*KEY)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    x = x.join(starts, "part")
    x = x.withColumn("_end", F.col("_bytes") + F.sum("size").over(upto)).withColumn("_row", F.col("_rows") + F.row_number().over(inside))
    mid = lambda end, n: F.least(F.floor((end - n / 2.0) * shards / F.lit(float(total))), F.lit(shards - 1)).cast("int")
    group = x.groupBy("h").agg(F.min(F.col("_end") - F.col("size")).alias("_from"), F.max("_end").alias("_to"), F.count("*").alias("_k")).filter("_k > 1")
    # Only groups that a boundary cuts need their own place; all their rows are within ``whole`` of a shard.
    cut = mid(F.col("_from") + 1, F.lit(1)) != mid(F.col("_to"), F.lit(1))
    small = group.filter(((F.col("_to") - F.col("_from")) <= whole * total / shards) & cut).select("h", mid(F.col("_to"), F.col("_to") - F.col("_from")).alias("_shard"))
    x = x.join(F.broadcast(small), "h", "left")  # at most one group a boundary
    x = x.withColumn("shard", F.coalesce("_shard", mid(F.col("_end"), F.col("size"))))
    # Shards follow the key order, so a shard's first row number is where its slots begin.
    firsts = F.broadcast(x.groupBy("shard").agg(F.min("_row").alias("_first")))  # one row a shard
    return x.join(firsts, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).cast("long").alias("slot"))
