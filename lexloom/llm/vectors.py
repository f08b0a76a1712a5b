"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors lexicographically by a concatenation of random projection bits
and compares neighbours in that order: a window holds about ``rows`` vectors and overlaps the
next by half, so every vector meets at least a quarter window on either side. A bit says
on which side of the local median a projection lies, so windows stay even and keep dividing
where vectors crowd in a cone. Medians come from a bounded sample, which decides where
windows end; a window that grew beyond its size is compared whole. Verified pairs of all
passes are united into components.

Passes are added until, in every part of the order, a made pair at the threshold is missed
with a chance of at most ``miss``, and half as many again for pairs inside a cone. The sample
proposes how many; then every vector of the table is paired with a made one and sent through
the passes, and passes are added until that holds of all. They are all there is at every size of table; a table that is smaller than a window is one window.
A second step makes the links inside each component complete: small components are compared
whole side by side, large ones in pairs of blocks, so the windows bound the search for
components but never a vector's links.

Exact copies are one class throughout and never compared with each other. Vectors
travel in the type in which they are stored; cosines are taken in double precision, and where
a product of matrices comes so near the threshold that its rounding could decide, one formula
(``linked``) does, in every step.

Defined results: null, empty, zero or non-finite vectors link with nothing; vectors
of different lengths never link; repeated rows are copies; an id that several rows
bear stays one row each, with that row's own vector; a row without id has no id to be
kept by but links like others; an empty table gives no rows; further columns are ignored.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import components, forest, keep, numbered

BLOCK = 1024
SMALL = 32


def unit(v: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of length one from vectors of one dimension; powers of two keep squares in range without rounding."""
    if not len(v):
        return np.zeros((0, 1))
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vec_id, v) of usable rows, vec_id of the others, and one row a distinct vector: class (any number), first (its
    smallest vec_id), copies, v, dim."""
    e, ident = F.col("embedding"), F.col("vec_id").cast("long").alias("vec_id")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    fine = F.coalesce(~bad & F.exists(e, lambda x: x != 0), F.lit(False))
    ok = vectors.filter(fine).select(ident, e.alias("v"))
    reps = numbered(ok.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("dim", F.size("v")), "class")
    return ok, vectors.filter(~fine).select(ident), reps


def directions(seed: int, k: int, dim: int, depth: int) -> np.ndarray:
    return np.random.default_rng([seed, k]).standard_normal((dim, depth))


def halves(sample: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The local medians of one pass: entry 2 ** level + node, where the node is the number of the bits before."""
    node, cuts = np.zeros(len(sample), np.int64), np.zeros(1 << planes.shape[1])
    for level in range(planes.shape[1]):
        x = sample @ planes[:, level]
        order = np.lexsort((x, node))
        size = np.bincount(node, minlength=1 << level)
        middle = np.minimum(np.cumsum(size) - size + size // 2, len(x) - 1)
        cuts[1 << level : 2 << level] = x[order][middle]
        node = 2 * node + (x >= cuts[(1 << level) + node])
    return cuts


def ranges(v: np.ndarray, planes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The range of every vector in one pass."""
    node, x = np.zeros(len(v), np.int64), v @ planes
    for level in range(planes.shape[1]):
        node = 2 * node + (x[:, level] >= cuts[(1 << level) + node])
    return node


def windows_of(half: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that half-windows lie in: as the first half of one and as the second of the one before (-1: none)."""
    last = (1 << depth) - 1
    return np.where((half < last) | (last == 0), half, -1), half - 1


def plan(sample: np.ndarray, n: int, threshold: float, miss: float, rows: int, seed: int, pairs: int = 1 << 14, least: int = 0) -> list[np.ndarray]:
    """The cuts of each pass into half-windows; ``least`` passes at least, unless there is one window."""
    depth = max(0, min(math.ceil(math.log2(2 * n / rows)), int(math.log2(max(1, len(sample) / 8)))))
    if sample.shape[1] < 2 or not depth:  # two directions, or one window
        return [np.zeros(2) if depth else np.zeros(1)]
    rng, cuts = np.random.default_rng(seed), []
    x = sample[rng.integers(0, len(sample), pairs)]
    w = rng.standard_normal(x.shape)
    w -= (w * x).sum(1)[:, None] * x
    y = threshold * x + math.sqrt(1 - threshold * threshold) * w / np.sqrt((w * w).sum(1))[:, None]
    apart, part, enough = np.ones(pairs, bool), None, None
    while enough is None or len(cuts) < max(enough, least):
        planes = directions(seed, len(cuts), x.shape[1], depth)
        cuts.append(halves(sample, planes))
        if enough is None:
            at = ranges(x, planes, cuts[-1])
            part = at >> max(0, depth - 5) if part is None else part
            apart &= np.abs(at - ranges(y, planes, cuts[-1])) > 1
            size = np.bincount(part)
            if (np.bincount(part, apart) <= miss * size).all():
                enough = math.ceil(1.5 * len(cuts))
    return cuts


def partners(v: np.ndarray, names: np.ndarray, threshold: float, seed: int) -> np.ndarray:
    """A made vector at the threshold for each unit vector, which its number decides."""
    w = np.stack([np.random.Generator(np.random.Philox(key=[seed, int(c)])).standard_normal(v.shape[1]) for c in names])
    w -= (w * v).sum(1)[:, None] * v
    return threshold * v + math.sqrt(1 - threshold * threshold) * w / np.sqrt((w * w).sum(1))[:, None]


def needed(reps: DataFrame, dim: int, cuts: list[np.ndarray], threshold: float, miss: float, seed: int) -> int | None:
    """After how many passes at most ``miss`` of the made pairs of every part are missed, over all vectors of a length; None:
    not after these. A count by part and pass reaches the driver."""
    depth = len(cuts[0]).bit_length() - 1

    def met(batches):
        for b in batches:
            if not len(b):
                continue
            v = unit(b.column("v"))
            y = partners(v, b.column("class").to_numpy(), threshold, seed)
            part, first = None, np.full(len(v), len(cuts))
            for k, c in enumerate(cuts):
                planes = directions(seed, k, dim, depth)
                at = ranges(v, planes, c)
                part = at >> max(0, depth - 5) if part is None else part
                first = np.where((first == len(cuts)) & (np.abs(at - ranges(y, planes, c)) <= 1), k, first)
            both, n = np.unique(part * (len(cuts) + 1) + first, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both // (len(cuts) + 1)), pa.array(both % (len(cuts) + 1)), pa.array(n)], ["part", "first", "n"])

    rows = reps.filter(F.col("dim") == dim).select("class", "v").mapInArrow(met, "part long, first long, n long").groupBy("part", "first").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((1 << min(5, depth), len(cuts) + 1), np.int64)
    for r in rows:
        counts[r.part, r.first] = r.n
    left = counts.sum(1)[:, None] - counts.cumsum(1)[:, :-1]  # missed after one pass, two, ...
    fine = np.nonzero((left <= miss * counts.sum(1)[:, None]).all(0))[0]
    return int(fine[0]) + 1 if len(fine) else None


def linked(v: np.ndarray, w: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of unit vectors have a cosine of the threshold or more. Products within rounding of it are summed anew, pair by
    pair in one order, so that every step says the same of a pair."""
    m = v @ w.T
    hit = m >= threshold
    i, j = np.nonzero(np.abs(m - threshold) < 1e-12 * v.shape[1])
    hit[i, j] = (v[i] * w[j]).sum(1) >= threshold
    return hit


def passes(reps: DataFrame, threshold: float, miss: float = 0.002, rows: int = 1024, seed: int = 11, sampled: int = 400_000) -> DataFrame:
    """Edges (a, b) of classes that unite all verified pairs; each window of a pass returns one a member at most.

    All vectors decide how many passes there are. About ``sampled`` a length, chosen by hash, decide where windows end: what the driver holds, and eight a half-window
    at least, so windows grow beyond ``rows`` where a table has more than ``sampled`` / 16 of them.
    """
    plans = {}
    for dim, size in reps.groupBy("dim").count().collect():
        share = min(1.0, sampled / size)
        some = reps.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("class", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30)))
        x = unit(some.select("v").toArrow()["v"])
        cuts = plan(x, size, threshold, miss, rows, seed)
        while dim > 1 and len(cuts[0]) > 1:
            base = needed(reps, dim, cuts, threshold, miss, seed)
            least = math.ceil(1.5 * (base or len(cuts)))
            if base and least <= len(cuts):
                break
            cuts = plan(x, size, threshold, miss, rows, seed, least=least)
            if base:
                break
        plans[dim] = cuts

    def codes(batches):
        for whole in batches:
            for dim in pc.unique(whole.column("dim")).to_pylist():
                b = whole.filter(pc.equal(whole.column("dim"), dim))
                v = unit(b.column("v"))
                for k, cuts in enumerate(plans[dim]):
                    depth = len(cuts).bit_length() - 1
                    half = ranges(v, directions(seed, k, v.shape[1], depth), cuts)
                    for first, window in zip((True, False), windows_of(half, depth)):
                        some = b.filter(pa.array(window >= 0))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(some), k, np.int32)), pa.array(window[window >= 0]), pa.array(np.full(len(some), first)), *some.columns], ["pass", "window", "first", *b.schema.names]
                        )

    kind = reps.schema["v"].dataType.simpleString()
    dealt = reps.select("class", "v", "dim").mapInArrow(codes, f"pass int, window long, first boolean, class long, v {kind}, dim int")

    def compare(part: pa.Table) -> pa.Table:
        """The first half with itself and with the second, which is the first half of the next window."""
        part = part.sort_by([("first", "descending"), ("class", "ascending")])
        v, c = unit(part["v"]), part["class"].to_numpy()
        n, root = int(pc.sum(part["first"].cast(pa.int64())).as_py() or 0), np.arange(len(c))
        last = n == len(c) or part["window"][0].as_py() + 2 == len(plans[part["dim"][0].as_py()][0])
        n = len(c) if last else n  # the last half is in no window of its own
        if len(c) > 4 * rows:
            # Rows of the same direction to the last bit have the same cosines: one of them stands for all.
            _, one, like = np.unique(v, axis=0, return_index=True, return_inverse=True)
            root = forest(len(c), np.arange(len(c)), one[like.ravel()])
            stand = np.sort(one)
            v, n = v[stand], int((stand < n).sum())
        else:
            stand = np.arange(len(c))
        for i in range(0, n, 128):
            a, b = np.nonzero(linked(v[i : min(n, i + 128)], v[i:], threshold))
            a, b = stand[a + i], stand[b + i]
            new = root[a] != root[b]
            if new.any():
                own = np.nonzero(root != np.arange(len(c)))[0]
                root = forest(len(c), np.concatenate([own, a[new]]), np.concatenate([root[own], b[new]]))
        own = np.nonzero(root != np.arange(len(c)))[0]
        return pa.table({"a": c[own], "b": c[root[own]]})

    return dealt.groupBy("dim", "pass", "window").applyInArrow(compare, "a long, b long")


def complete(reps: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(class, linked): rows linked to each class from other classes of its component."""
    x = reps.join(found, F.col("class") == F.col("id")).select("class", "copies", "v", "dim", "component")
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    x = x.join(sizes, "component")
    out = "class long, linked long"

    def beside(part: pa.Table) -> pa.Table:
        """Whole small components next to each other: row i meets rows i + 1 ... i + SMALL."""
        part = part.sort_by([("component", "ascending"), ("class", "ascending")])
        v, c, n, k = unit(part["v"]), part["component"].to_numpy(), part["copies"].to_numpy(), part["class"].to_numpy()
        found = np.zeros(len(c), np.int64)
        for s in range(1, min(SMALL, len(c) - 1) + 1):
            hit = np.nonzero((c[:-s] == c[s:]) & ((v[:-s] * v[s:]).sum(1) >= threshold))[0]
            np.add.at(found, hit, n[hit + s])
            np.add.at(found, hit + s, n[hit])
        return pa.table({"class": k, "linked": found})

    def across(part: pa.Table) -> pa.Table:
        """Block i against block j of one component."""
        i, j = part["i"][0], part["j"][0]
        p, q = (part.filter(pc.equal(part["block"], n)) for n in (i, j))
        hit = linked(unit(p["v"]), unit(q["v"]), threshold) if len(p) and len(q) else np.zeros((len(p), len(q)), bool)
        left = hit @ q["copies"].to_numpy()
        if i == j:
            return pa.table({"class": p["class"], "linked": left - p["copies"].to_numpy() * np.diag(hit)})
        return pa.concat_tables([pa.table({"class": p["class"], "linked": left}), pa.table({"class": q["class"], "linked": hit.T @ p["copies"].to_numpy()})])

    buckets = F.pmod(F.xxhash64("component"), F.greatest(F.lit(1), F.lit(found.count() // 2000))).alias("bucket")
    small = x.filter(F.col("size") <= SMALL).withColumn("bucket", buckets).groupBy("dim", "bucket").applyInArrow(beside, out)
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    large = x.filter(F.col("size") > SMALL).withColumn("n", n).withColumn("block", F.pmod(F.xxhash64("class"), F.col("n")).cast("int"))
    pairs = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = pairs.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return small.unionByName(pairs.groupBy("component", "i", "j").applyInArrow(across, out)).groupBy("class").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    ok, others, reps = classes(vectors)
    found = keep(components(passes(reps, threshold)))
    within = complete(reps, found, threshold)
    per = reps.select("class", "first", "copies").join(found.withColumnRenamed("id", "class"), "class", "left").join(within, "class", "left")
    per = per.select("class", "first", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component"))
    least = per.groupBy("component").agg(F.min("first").alias("component_id"))
    per = per.join(least, "component").select("class", "n_links", "component_id")
    own = ok.join(reps.select("v", "class"), "v").select("vec_id", "class").join(per, "class").select("vec_id", "n_links", "component_id")
    alone = others.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = own.unionByName(alone)
    return rows.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
