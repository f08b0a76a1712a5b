"""Inverted-file index of vectors that searches exactly.

Vectors lie in the cells of trained centroids, written partitioned by cell with their
distance to its centroid. A search goes best first: every query reads the cells nearest
to it until they hold enough vectors, which bounds its k-th distance; then only cells
that the triangle bound leaves (distance to the centroid less the cell's radius), and in
them only vectors whose own distance to the centroid differs from the query's by no more
than the bound. What is passed over cannot be among the k nearest, so the result is that
of comparing all, whatever the cells are; cells decide how much is read.

A vector meets the queries of its own cell only and is never copied: large cells are cut
in blocks, and queries travel to every block of the cells they reach. Null and empty
vectors, and those with null or non-finite components, are neither indexed nor searched;
vectors of another length than the query's are no neighbours. Ties go to the smaller id.
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCK = 20_000  # vectors of a cell in one task
QUERIES_AT_ONCE = 256
SLACK = 1e-9  # what rounding may add to a bound


@dataclass
class Cells:
    """Where the vectors lie and what is known of each cell: number, length of its vectors, count, radius. As many rows as cells."""

    path: str
    centroids: dict[int, np.ndarray]  # by length of the vectors, one a cell
    first: dict[int, int]  # by length, the number of its first cell
    count: np.ndarray
    radius: np.ndarray


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(embedding) > 0) & ~bad, F.lit(False))


def train(vectors: DataFrame, cells: int | None = None, sample: int = 20_000, rounds: int = 10, seed: int = 3) -> dict[int, np.ndarray]:
    """Centroids by k-means over about ``sample`` vectors a length, chosen by hash: the bound on what reaches the driver.
    Without ``cells``, as many as the root of the number of vectors, 4096 at most."""
    out = {}
    for r in vectors.groupBy(F.size("embedding").alias("dim")).count().collect():
        share = min(1.0, sample / r["count"]) * (1 << 30)
        some = vectors.filter((F.size("embedding") == r.dim) & (F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < share))
        m = np.array([x.embedding for x in some.orderBy("vec_id").select("embedding").limit(2 * sample).collect()], float)
        if not len(m):
            continue
        k = min(len(m), cells or max(1, min(4096, math.isqrt(r["count"]))))
        c = m[np.random.default_rng(seed).choice(len(m), k, replace=False)]
        for _ in range(rounds):
            at = ((c * c).sum(1) - 2 * m @ c.T).argmin(1)
            n = np.bincount(at, minlength=k)
            sums = np.zeros_like(c)
            np.add.at(sums, at, m)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        out[r.dim] = c
    return out


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """From every row of x to every row of c, by differences: no cancellation, so equal vectors are at 0."""
    return np.stack([np.sqrt(((x - one) ** 2).sum(1)) for one in c], 1) if len(c) < len(x) else np.stack([np.sqrt(((c - one) ** 2).sum(1)) for one in x])


def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = 20_000) -> Cells:
    """Writes (vec_id, embedding, away) partitioned by cell; every vector is indexed."""
    v = vectors.filter(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    centroids = train(v, cells, sample)
    first, n = {}, 0
    for dim, c in sorted(centroids.items()):
        first[dim], n = n, n + len(c)

    def place(batches):
        for b in batches:
            b["cell"], b["away"] = -1, 0.0
            dims = b["embedding"].map(len)
            for dim in dims.unique():
                own = (dims == dim).to_numpy()
                d = distances(np.stack(b["embedding"][own].to_list()).astype(float), centroids[dim])
                at = d.argmin(1)
                b.loc[own, "cell"], b.loc[own, "away"] = first[dim] + at, d[np.arange(len(at)), at]
            yield b

    kind = v.schema["embedding"].dataType.simpleString()
    v.mapInPandas(place, f"vec_id long, embedding {kind}, cell int, away double").write.partitionBy("cell").mode("overwrite").parquet(path)
    count, radius = np.zeros(n, np.int64), np.zeros(n)
    if n:
        for r in v.sparkSession.read.schema(f"vec_id long, embedding {kind}, away double, cell int").parquet(path).groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():
            count[r.cell], radius[r.cell] = r.n, r.r
    return Cells(path, centroids, first, count, radius)


def nearest_first(index: Cells, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, q, cell, gap): the cells nearest to each query until they hold k vectors besides the query; gap is the distance to the centroid."""

    def order(batches):
        for b in batches:
            out = []
            for i, q in zip(b["query_id"], b["q"]):
                c = index.centroids.get(len(q))
                if c is None:
                    continue
                d = distances(np.asarray(q, float)[None], c)[0]
                at = np.argsort(d, kind="stable")
                held = np.cumsum(index.count[index.first[len(q)] + at])
                at = at[: int(np.searchsorted(held, k + 1)) + 1]
                out.append(pd.DataFrame({"query_id": i, "q": [q] * len(at), "cell": (index.first[len(q)] + at).astype("int32"), "gap": d[at]}))
            if out:
                yield pd.concat(out)

    return queries.mapInPandas(order, f"query_id long, q {queries.schema['q'].dataType.simpleString()}, cell int, gap double")


def reachable(index: Cells, bounded: DataFrame, k: int) -> DataFrame:
    """(query_id, q, cell, gap, bound) of the cells not read yet that may hold a nearer vector than ``bound``."""

    def reach(batches):
        for b in batches:
            out = []
            for i, q, bound in zip(b["query_id"], b["q"], b["bound"]):
                c = index.centroids.get(len(q))
                if c is None:
                    continue
                d, base = distances(np.asarray(q, float)[None], c)[0], index.first[len(q)]
                at = np.argsort(d, kind="stable")
                n, r = index.count[base + at], index.radius[base + at]
                later = np.arange(len(at)) > int(np.searchsorted(np.cumsum(n), k + 1))
                at = at[later & (n > 0) & (d[at] - r <= bound * (1 + SLACK) + SLACK * (1 + d[at]))]
                if len(at):
                    out.append(pd.DataFrame({"query_id": i, "q": [q] * len(at), "cell": (base + at).astype("int32"), "gap": d[at], "bound": bound}))
            if out:
                yield pd.concat(out)

    return bounded.mapInPandas(reach, f"query_id long, q {bounded.schema['q'].dataType.simpleString()}, cell int, gap double, bound double")


def within(index: Cells, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, d): of every block of the cells asked for, the k nearest vectors a query within its bound."""
    spark = asked.sparkSession
    cells = sorted(r.cell for r in asked.select("cell").distinct().collect())  # as many as there are cells, at most
    blocks = np.maximum(1, -(-index.count // BLOCK))
    parts = F.element_at(F.array(*[F.lit(int(n)) for n in blocks]) if len(blocks) else F.array(F.lit(1)), F.col("cell") + 1)
    v = spark.read.parquet(index.path) if cells else None
    if v is None:
        return spark.createDataFrame([], "query_id long, vec_id long, d double")
    v = v.filter(F.col("cell").isin(cells)).withColumn("block", F.pmod(F.xxhash64("vec_id"), parts).cast("int"))
    q = asked.withColumn("block", F.explode(F.sequence(F.lit(0), parts - 1)))

    def nearest(own: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asks):
            own = own.sort_values("vec_id")
            ids, m, away = own["vec_id"].to_numpy(), np.stack(own["embedding"].to_list()).astype(float), own["away"].to_numpy()
            for i, q, gap, bound in zip(asks["query_id"], asks["q"], asks["gap"], asks["bound"]):
                near = np.nonzero((np.abs(away - gap) <= bound * (1 + SLACK) + SLACK * (1 + gap)) & (ids != i))[0]
                d = np.sqrt(((m[near] - np.asarray(q, float)) ** 2).sum(1))
                best = np.argsort(d, kind="stable")[:k]
                out.append(pd.DataFrame({"query_id": i, "vec_id": ids[near[best]], "d": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "d": []})

    return v.groupBy("cell", "block").cogroup(q.groupBy("cell", "block")).applyInPandas(nearest, "query_id long, vec_id long, d double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("d", "vec_id")).cast("long")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def steps(index: Cells, queries: DataFrame, k: int, keep) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first cells, what they gave, further cells) of queries (vec_id, embedding); ``keep`` writes a table down, so that its
    rows are made once."""
    q = queries.filter(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("q"))
    first = keep(nearest_first(index, q, k).withColumn("bound", F.lit(float("inf"))))
    found = keep(ranked(within(index, first, k), k).drop("rank"))
    bound = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(float("inf")).alias("bound"))
    further = keep(reachable(index, q.join(bound, "query_id", "left").fillna(float("inf"), ["bound"]), k))
    return first, found, further


def search(index: Cells, queries: DataFrame, k: int, keep) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest vectors of every query, itself left out, exactly."""
    _, found, further = steps(index, queries, k, keep)
    x = ranked(found.unionByName(within(index, further, k)), k)
    return x.select("query_id", "rank", "vec_id", F.round("d", 6).alias("distance"))


def read_shares(index: Cells, queries: DataFrame, k: int, keep) -> DataFrame:
    """One row: queries, cells and vectors that a query reads on average, and what share of all vectors these are."""
    first, _, further = steps(index, queries, k, keep)
    size = F.element_at(F.array(*[F.lit(int(n)) for n in index.count]), F.col("cell") + 1)
    x = first.select("query_id", size.alias("n")).unionByName(further.select("query_id", size.alias("n"))).groupBy("query_id").agg(F.count("*").alias("cells"), F.sum("n").alias("vectors"))
    return x.agg(F.count("*").alias("n_queries"), F.avg("cells").alias("cells"), F.avg("vectors").alias("vectors"), (F.avg("vectors") / int(index.count.sum())).alias("share"))


def kept_in(spark: SparkSession, folder: str):
    """Writes tables down in a shared folder, a new one each."""
    import uuid

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep
