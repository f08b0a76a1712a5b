"""Mixes sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are permuted by hash and cut into blocks; its target says
how many blocks the mixture draws, whole passes first, and of the block at which the
target falls the rows up to it. A tree halves the set of output shards again and again
and splits the exact block quotas of all sources at random between both halves; a shard
then draws the next blocks of each source, so draws are disjoint and nothing is sampled
twice in a pass. What a document is taken for follows from the blocks drawn alone.
Rows are shuffled inside their shard by hash.

Defined results: null texts have size 0; null sources form one source, last in
order; null and repeated ids are rows like others: rows that agree in doc_id, source
and size are numbered, so that they lie in blocks of their own each; sources without
words have target 0; documents of size 0 are taken as often as the documents around
them, and count no words; an empty table gives no rows; columns named like an output
are replaced, all others pass through. Reruns agree because every choice comes from
hashes and a seed. What each pass and block of a source hold is summed by Spark; one
row a source reaches the driver (at most ``MOST_SOURCES``).
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.llm.common import keep, n_words, named, numbered, text_of

MOST_SOURCES = 100_000
BLOCKS = 4096
MOST_DRAWN = 900_000_000  # NumPy draws from fewer than 1e9 blocks in all
OUT = ["size", "source_size", "target", "taken", "copies"]


def targets(sizes: list[tuple[str | None, int]], weights=(5, 2, 1), cap: float = 3.0) -> dict[str | None, float]:
    """Words to take of each source: shares of the whole by weight, none above ``cap`` times its size."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, out, free = dict(sizes), {}, [s for s, n in order if n > 0]
    out = {s: 0.0 for s, n in order if n == 0}
    left = float(sum(size.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * size[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = cap * size[s]
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in set(over)]
    return out


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Block quotas of the sources dealt to shards, shape (shards, sources), by recursive hypergeometric draws."""
    if shards == 1:
        return quotas[None, :]
    left, total = shards // 2, int(quotas.sum())
    first = rng.multivariate_hypergeometric(quotas, total * left // shards, method="marginals")
    return np.concatenate([split(first, left, rng), split(quotas - first, shards - left, rng)])


def without_repeats(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds k, a number among the rows that agree in id, source and size (0 where there is one); second, the narrow columns, kept.

    Where rows repeat, they are numbered in the partitions that hold them and partitions after each other, so that no repeated row is one group.
    """
    same = F.xxhash64("id", "source", "size")
    base = keep(x.select("id", "source", "size"))
    if base.groupBy(same).count().filter("count > 1").isEmpty():
        return x.withColumn("k", F.lit(0).cast("long")), base.withColumn("k", F.lit(0).cast("long"))
    x = numbered(x, "row")
    rows = x.select("row", same.alias("same"), F.shiftright("row", 33).alias("part"))
    before = F.sum("n").over(W.partitionBy("same").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = rows.groupBy("same", "part").agg(F.count("*").alias("n")).select("same", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("same", "part").orderBy("row"))
    later = rows.withColumn("i", inside).join(starts, ["same", "part"]).select("row", (F.col("before") + F.col("i") - 1).alias("k")).filter("k > 0")
    x = x.join(later, "row", "left").withColumn("k", F.coalesce("k", F.lit(0).cast("long"))).drop("row")
    return x, keep(x.select("id", "source", "size", "k"))


def mix(docs: DataFrame, size: Column | None = None, shards: int = 8, weights=(5, 2, 1), cap: float = 3.0, blocks: int | None = None, seed: int = 17) -> DataFrame:
    """The documents with size, source_size, target, taken and copies (array of pass, block, shard; empty: not taken).

    ``size`` is a long Column, words of the text by default.
    """
    spark, own = docs.sparkSession, [c for c in docs.columns if c not in OUT]
    words = (n_words(text_of("text")) if size is None else size).cast("long").alias("size")
    x, base = without_repeats(docs.select(F.struct(*named(own)).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.col("source").alias("source"), words))
    sums = base.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError("too many sources")
    total = {r["source"]: r["n"] for r in sums}
    goal = targets(list(total.items()), weights, cap)
    passes = {s: int(goal[s] // n) if n else 0 for s, n in total.items()}
    rest = {s: goal[s] - passes[s] * n for s, n in total.items()}
    blocks = blocks or max(1, min(BLOCKS, MOST_DRAWN // (max(1, len(total)) * (int(cap) + 1))))
    key = ["id", "size", "k"]

    def block_of(n):
        """A block of a pass: the pass's own permutation of the source's rows."""
        return F.pmod(F.xxhash64(*key, F.lit(seed), n), F.lit(blocks)).cast("int")

    def told(frame, rows, schema):
        """One row a source, so at most MOST_SOURCES rows are broadcast."""
        names = F.broadcast(spark.createDataFrame(rows, f"_source string, {schema}"))
        return frame.join(names, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    place = F.struct(F.xxhash64(*key, F.lit(seed + 1)).alias("h"), *key)
    # The last pass of a source: whole blocks while they fit, then rows of the next block up to the target.
    parted = told(base, [(s, passes[s], rest[s]) for s in total if rest[s] > 0], "_passes int, _rest double").withColumn("_last", block_of(F.col("_passes")))
    by_block = parted.groupBy("source", "_last").agg(F.sum("size").alias("_n"), F.first("_rest").alias("_rest"))
    end = F.sum("_n").over(W.partitionBy("source").orderBy("_last").rowsBetween(W.unboundedPreceding, 0))
    over = by_block.withColumn("_end", end).filter(F.col("_end") > F.col("_rest"))
    edge = over.groupBy("source").agg(F.min("_last").alias("edge"), F.min_by(F.col("_rest") - F.col("_end") + F.col("_n"), "_last").alias("room"))
    edge = {r["source"]: (r["edge"], r["room"]) for r in edge.collect()}
    # One block of a source, one in ``blocks`` of its rows.
    at_edge = told(parted, [(s, *v) for s, v in edge.items()], "_edge int, _room double").filter(F.col("_last") == F.col("_edge"))
    upto = F.sum("size").over(W.partitionBy("source").orderBy(place).rowsBetween(W.unboundedPreceding, 0))
    fits = at_edge.withColumn("_upto", upto).filter(F.col("_upto") - F.col("size") / 2 <= F.col("_room"))
    cut = {r["source"]: r["p"] for r in fits.groupBy("source").agg(F.max(place).alias("p")).collect()}

    def last_block(s):
        return edge[s][0] if s in edge else blocks if rest[s] > 0 else 0

    quotas = np.array([passes[s] * blocks + last_block(s) + (s in cut) for s in total], np.int64)
    dealt = np.cumsum(split(quotas, shards, np.random.Generator(np.random.PCG64(seed))), 0) if total else None
    rows = [(s, total[s], goal[s], passes[s], last_block(s) if rest[s] > 0 else -1, cut.get(s), [int(v) for v in dealt[:, i]]) for i, s in enumerate(total)]
    x = told(x, rows, "source_size long, target double, _passes int, _edge int, _cut struct<h:long,id:long,size:long,k:long>, _ends array<long>")
    last = block_of(F.col("_passes"))
    drawn = (last < F.col("_edge")) | ((last == F.col("_edge")) & F.coalesce(place <= F.col("_cut"), F.lit(False)))
    n = F.col("_passes") + F.when(drawn, 1).otherwise(0)

    def copy(p):
        at = p.cast("long") * blocks + block_of(p)
        return F.struct(p.alias("pass"), block_of(p).alias("block"), F.size(F.filter("_ends", lambda e: e <= at)).alias("shard"))

    none = F.array().cast("array<struct<pass:int,block:int,shard:int>>")
    x = x.withColumn("copies", F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), copy)).otherwise(none))
    return x.select(*[F.col("doc")[c].alias(c) for c in own], "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"), "copies")


def draw(mixed: DataFrame, seed: int = 17) -> DataFrame:
    """One row a copy (the copy's pass, block and shard in the column ``copy``), in its shard, shuffled inside the shard; shards
    split over tasks by block as they grow."""
    x = mixed.drop("copy").select("*", F.explode("copies").alias("copy")).drop("copies")
    return x.repartition("copy.shard", "copy.block").sortWithinPartitions("copy.shard", F.xxhash64("doc_id", "size", "copy.pass", F.lit(seed)))
