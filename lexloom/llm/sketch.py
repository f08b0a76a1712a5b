"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

A sketch keeps every hash of a five-word shingle below a fixed fraction of the hash
range. The fraction is the same for every document, so sketches of very unequal
texts compare directly and containment is estimated without bias. A text of fewer
than five words is one shingle. Where no hash falls below the fraction, the smallest
one stands in, so that no sketch of a text is empty; ``merged`` drops stand-ins where
the union has a hash below the fraction, so the union of sketches is the sketch of the
union. Sketches are sorted sets, so equal texts have equal sketches.

Defined results: a null text is empty; a text without words has an empty sketch,
like only another such sketch; rows without id come first; the successor of the last
row is the first, of a table of one row itself; equal ids are ordered by a hash of
their texts (rows of equal id and text meet in one range); an empty table gives no rows.
"""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.llm.common import leading, text_of

SHINGLE = 5
FRACTION = 0.25
RANGES = 20_000  # at most so many heads of ranges are broadcast
PER_RANGE = 10  # sampled keys
NO_ID = -(2**63)


def words(text: Column) -> Column:
    w = F.split(text, "[\\x20\\x09-\\x0D]+", -1)
    return F.filter(w, lambda x: x != "")


def shingle_hashes(hashes: str, size: int = SHINGLE) -> Column:
    """Hashes of runs of word hashes; ``hashes`` is an array column of words' hashes."""
    n = F.size(hashes)
    at = lambda i, k: F.get(F.col(hashes), i + k)
    runs = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[at(i, k) for k in range(size)]))
    return F.when(n >= size, runs).when(n > 0, F.array(F.xxhash64(F.col(hashes))))


def limit(fraction: float) -> int:
    return int(-(2**63) + fraction * 2**64)


def scaled(h: Column, fraction: float = FRACTION) -> Column:
    """Hashes below the fraction of the range, sorted and distinct; if none is, the smallest."""
    few = F.array_distinct(F.filter(h, lambda x: x < limit(fraction)))
    least = F.when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(F.array().cast("array<bigint>"))
    return F.when(h.isNull(), F.array().cast("array<bigint>")).when(F.size(few) > 0, F.sort_array(few)).otherwise(least)


def sketched(df: DataFrame, text: str, out: str, fraction: float = FRACTION) -> DataFrame:
    """Adds ``out``: the sketch of a text column, three projections that Spark keeps apart."""
    x = df.withColumn("_w", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    return x.withColumn("_h", shingle_hashes("_w")).withColumn(out, scaled(F.col("_h"), fraction)).drop("_w", "_h")


def shared(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def jaccard(a: str, b: str) -> Column:
    """Resemblance of two sketches; two empty ones are alike."""
    both = shared(a, b)
    whole = F.size(a) + F.size(b) - both
    return F.when(whole == 0, 1.0).otherwise(both / whole)


def containment(a: str, b: str) -> Column:
    """How much of a's text b holds, however unequal both are."""
    return F.when(F.size(a) == 0, 1.0).otherwise(shared(a, b) / F.size(a))


def merged(sketches: DataFrame, key: str, sketch: str, fraction: float = FRACTION) -> DataFrame:
    """Sketches of the unions of each key's texts: distinct hashes, combined before the shuffle; no text with a word, no hash.

    The outer form of explode brings no filter on the sketch with it. Spark would move such a filter below the
    projections of ``sketched`` and compute the hashes of a whole text anew for every shingle.
    """
    one = sketches.select(key, F.explode_outer(sketch).alias("h")).distinct()
    few = F.sort_array(F.collect_list(F.when(F.col("h") < limit(fraction), F.col("h"))))
    least = F.array_compact(F.array(F.min("h")))
    return one.groupBy(key).agg(few.alias("_few"), least.alias("_least")).select(key, F.when(F.size("_few") > 0, F.col("_few")).otherwise(F.col("_least")).alias(sketch))


def hexadecimal(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def with_next(docs: DataFrame, rows_per_range: int = 1500) -> DataFrame:
    """Adds next_text, the text of the following row by (doc_id, hash of the text), one shuffle of the texts.

    Keys are dealt to ranges by quantiles of a sample; each range also receives the first row of the
    following one, so a look ahead inside a range suffices. Ranges grow in size once there are ``RANGES`` of them.
    """
    text = text_of("text")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("h")).alias("_k"))
    rows = docs.count()
    parts = max(1, min(RANGES, rows // rows_per_range))
    x = base.withColumn("_r", range_of(F.col("_k"), cuts(base, rows, parts)))
    first = x.groupBy("_r").agg(F.min("_k").alias("_k"))
    # Each range's first row also goes to the range before it; the first row of all goes to the last one.
    before = F.lag("_r").over(W.partitionBy(F.lit(0)).orderBy("_r"))
    last = F.max("_r").over(W.partitionBy(F.lit(0)))
    heads = F.broadcast(first.select("_k", F.coalesce(before, last).alias("_to")))  # one row a range
    guests = base.join(heads, "_k").select("doc_id", "text", "_k", F.col("_to").alias("_r"), F.lit(1).alias("_guest"))
    everyone = x.withColumn("_guest", F.lit(0)).unionByName(guests)
    order = W.partitionBy("_r").orderBy("_guest", "_k")
    return everyone.withColumn("next_text", F.lead("text").over(order)).filter("_guest = 0").drop("_guest", "_r", "_k")


def cuts(keyed: DataFrame, rows: int, parts: int) -> list[tuple[int, int]]:
    """Upper bounds of ranges: quantiles of a sample of some PER_RANGE keys a range, the only data that reach the driver."""
    if parts < 2:
        return []
    chance = min(1.0, parts * PER_RANGE / rows) * (1 << 30)
    some = keyed.select("_k.d", "_k.h").filter(F.pmod(F.xxhash64("d", "h", F.lit(13)), F.lit(1 << 30)) < chance)
    keys = sorted((r.d, r.h) for r in some.collect())
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def range_of(key: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many bounds are below the key, by binary search in one constant array."""
    told = F.from_json(F.lit(json.dumps([{"d": d, "h": h} for d, h in bounds])), "array<struct<d:bigint,h:bigint>>")
    return leading(told, lambda c: c < key) if bounds else F.lit(0)


def compared(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every text and its edited text (its last half replaced by the next text's beginning), and likenesses;
    contained_edited estimates how much of the text the edited one still holds."""
    x = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    x = x.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    x = x.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    for text, out in (("text", "_a"), ("edited", "_b"), ("next_text", "_c")):
        x = sketched(x, text, out, fraction)
    return x.select(
        "doc_id", "n_chars", "edited_sha256", hexadecimal("_a").alias("fingerprint"), hexadecimal("_b").alias("edited_fingerprint"),
        jaccard("_a", "_b").alias("near_edited"), jaccard("_a", "_c").alias("near_next"), containment("_a", "_b").alias("contained_edited"),
    )
