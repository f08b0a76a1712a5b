"""Vector codes: each of eight parts of a vector is named by the nearest entry of that part's codebook.

Entries are found by Orchard search. Every entry keeps the list of the others by
distance; a search stands at an entry, walks its list, jumps to the list of any entry
that is nearer, marks what it visited, and stops where the list is beyond twice the
present distance, since by the triangle bound nothing further on can be as near. All
rows of an Arrow batch walk at once. Codebooks are trained by rounds of assignment and
integer means: a task adds up its rows by entry, Spark adds up the tasks, and what
reaches the driver is one codebook (parts * entries * width numbers), whatever the rows.

All arithmetic is that of integers: components become floor(scale * x), in 64 bits where
no sum can leave them and as Python integers elsewhere, so results do not depend on how
rows are dealt to tasks.

Defined results: rows without a vector, or with null or non-finite components, are
dropped; vectors of each length have codebooks of their own, and where the length is no
multiple of the parts, the first parts are one longer; an empty vector is eight empty
parts, code 00 each; of equal ids the vectors decide which start the codebook, null ids
come last; repeated rows count as often as they stand; fewer rows than entries make
fewer entries; an error beyond a long is shown as the largest long; an empty table
gives no rows; further columns are ignored.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import join_groups, keep

LARGEST = (1 << 63) - 1
LIMB = 32
#: Components below this in size take the path of 64-bit integers: squares of their differences, 2^12 of them, fit.
NARROW = 1 << 24


def usable(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(F.coalesce(~bad, F.lit(False)))


def bounds(dim: int, parts: int) -> list[int]:
    """Where the parts of a vector of this length begin, and its end."""
    each, more = divmod(dim, parts)
    return [k * each + min(k, more) for k in range(parts + 1)]


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: as int64 where small, else as Python integers."""
    y = np.floor(x * float(scale))  # a power of two moves the exponent only
    if not y.size or np.abs(y).max() < NARROW and x.shape[1] <= 4096:
        return y.astype(np.int64)
    return np.array([[int(v) if np.isfinite(v) else int(u) * scale for u, v in zip(a, b)] for a, b in zip(x, y)], object).reshape(x.shape)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(-1)


class Orchard:
    """Nearest entries of one codebook (squared distance, ties to the lower index)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = distances(entries[:, None, :], entries[None, :, :])
        self.lists = np.stack([np.array(sorted((j for j in range(len(entries)) if j != i), key=lambda j: (apart[i, j], j)), np.int64) for i in range(len(entries))])
        self.gaps = np.take_along_axis(apart, self.lists, 1)
        weight = entries.sum(1)  # where to begin: the entry whose components add up to nearly as much
        self.by_weight = np.array(sorted(range(len(entries)), key=lambda i: weight[i]), np.int64)
        self.weights = weight[self.by_weight]

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every row."""
        n, last = len(x), self.lists.shape[1]
        at = self.by_weight[np.minimum(np.searchsorted(self.weights, x.sum(1)), last)]
        best = distances(x, self.entries[at])
        step, live = np.zeros(n, np.int64), np.arange(n if last else 0)
        visited = np.zeros((n, len(self.entries)), bool)
        visited[np.arange(n), at] = True
        while len(live):
            here, k = at[live], step[live]
            beyond = self.gaps[here, k] > 4 * best[live]  # of squares: twice the distance
            live, here, k = live[~beyond], here[~beyond], k[~beyond]
            other = self.lists[here, k]
            step[live] = k + 1
            fresh = ~visited[live, other]
            rows, other = live[fresh], other[fresh]
            visited[rows, other] = True
            d = distances(x[rows], self.entries[other])
            nearer = (d < best[rows]) | ((d == best[rows]) & (other < at[rows]))
            rows = rows[nearer]
            at[rows], best[rows], step[rows] = other[nearer], d[nearer], 0
            live = live[step[live] < last]
        return at, best


def assigned(v: pa.Array, books: dict[int, list[np.ndarray]], scale: int):
    """By length: (which rows, their integers, part by part their entries and distances)."""
    sizes = pc.list_value_length(v).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        if dim not in books:
            continue
        own = np.nonzero(sizes == dim)[0]
        flat = v.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = integers(flat.reshape(len(own), dim), scale)
        cut = bounds(dim, len(books[dim]))
        searches = [Orchard(as_kind(b, x.dtype)) for b in books[dim]]
        yield dim, own, x, [s.search(x[:, a:z]) for s, a, z in zip(searches, cut, cut[1:])]


def as_kind(entries: np.ndarray, kind) -> np.ndarray:
    """Entries in the arithmetic of the rows, unless they are too large for it."""
    return entries.astype(np.int64) if kind == np.int64 and (not entries.size or np.abs(entries).max() < NARROW) else entries.astype(object)


def first_books(rows: DataFrame, parts: int, entries: int, scale: int) -> dict[int, list[np.ndarray]]:
    """By length, the parts of the vectors of the smallest ids: one heap of so many rows a task, which Spark merges."""
    books = {}
    for (dim,) in rows.select(F.size("embedding")).distinct().collect():
        least = rows.filter(F.size("embedding") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
        x = integers(np.array([r.embedding for r in least], np.float64).reshape(len(least), dim), scale).astype(object)
        cut = bounds(dim, parts)
        books[dim] = [x[:, a:z] for a, z in zip(cut, cut[1:])]
    return books


def limbs(value: int) -> list[int]:
    """The value in digits of 32 bits, lowest first, the last of them signed."""
    out = []
    while not -(1 << LIMB - 1) <= value < 1 << LIMB - 1:
        out.append(value & (1 << LIMB) - 1)
        value >>= LIMB
    return out + [value]


def retrained(rows: DataFrame, books: dict[int, list[np.ndarray]], scale: int) -> dict[int, list[np.ndarray]]:
    """One round: every part goes to its nearest entry, every entry becomes floor(sum / count) of its parts; unused ones stay."""

    def add_up(batches):
        totals: dict[tuple, int] = {}
        for b in batches:
            for dim, _, x, found in assigned(b.column(0), books, scale):
                cut = bounds(dim, len(found))
                for p, (at, _) in enumerate(found):
                    for e in np.unique(at).tolist():
                        own = x[at == e, cut[p] : cut[p + 1]]
                        for i, s in enumerate([len(own), *own.sum(0).tolist()]):
                            totals[dim, p, e, i] = totals.get((dim, p, e, i), 0) + s
        flat = [(*k, n, digit) for k, s in totals.items() for n, digit in enumerate(limbs(s))]
        names = ["dim", "part", "entry", "place", "limb", "digit"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in range(6)], names)

    sums = rows.select("embedding").mapInArrow(add_up, "dim long, part long, entry long, place long, limb long, digit long")
    got: dict[tuple, int] = {}
    for r in sums.groupBy("dim", "part", "entry", "place", "limb").agg(F.sum("digit").alias("digit")).collect():
        key = (r.dim, r.part, r.entry, r.place)
        got[key] = got.get(key, 0) + (r.digit << LIMB * r.limb)
    new = {dim: [b.copy() for b in own] for dim, own in books.items()}
    for (dim, p, e, i), s in got.items():
        if i:
            new[dim][p][e, i - 1] = s // got[dim, p, e, 0]
    return new


def train(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> dict[int, list[np.ndarray]]:
    """By length of the vectors, a codebook a part: rows of Python integers. A round is one pass over the vectors' column."""
    rows = usable(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    books = first_books(rows, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = retrained(rows, books, scale)
    return books


def encode(vectors: DataFrame, books: dict[int, list[np.ndarray]], columns: list[str | Column], scale: int = 4096) -> DataFrame:
    """``columns`` of the rows that have a vector, with dim, code (an index a part, as bytes) and error."""
    rows = usable(vectors).select(F.col("embedding").alias("_vector"), *columns)
    rest = rows.drop("_vector")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", dim int, code binary, error long"

    def name(batches):
        for b in batches:
            code, error, dims = [b""] * len(b), [0] * len(b), [0] * len(b)
            for dim, own, _, found in assigned(b.column(0), books, scale):
                codes = np.stack([at for at, _ in found], 1).astype(np.uint8)
                total = sum(d.astype(object) for _, d in found)
                for i, c, t in zip(own.tolist(), codes, total):
                    code[i], error[i], dims[i] = c.tobytes(), min(int(t), LARGEST), dim
            added = [pa.array(dims, pa.int32()), pa.array(code, pa.binary()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *added], [*b.schema.names[1:], "dim", "code", "error"])

    return rows.mapInArrow(name, schema)


def decode(coded: DataFrame, books: dict[int, list[np.ndarray]], scale: int = 4096) -> DataFrame:
    """Adds approximation (array<double>): the entries that a code names, scaled back."""

    @F.pandas_udf("array<double>")
    def back(dim: pd.Series, code: pd.Series) -> pd.Series:
        return pd.Series([[float(v) / scale for b, i in zip(books[d], c) for v in b[i]] for d, c in zip(dim, code)])

    return coded.withColumn("approximation", back("dim", "code"))


def fingerprint(books: list[np.ndarray]) -> str:
    """Of one length's codebooks: all components, by part, entry and place, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for row in b for v in row).encode()).hexdigest()


def compressed(vectors: DataFrame, label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): label_error is the error summed over rows of an equal label."""
    books = train(vectors, parts, entries, rounds)
    key = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")).alias("key")  # nulls are one label
    x = keep(encode(vectors, books, [F.col("vec_id").cast("long").alias("vec_id"), key]))
    sums = keep(x.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("total")))
    x = join_groups(x, sums, ["key"])
    marks = F.lit(None).cast("string")
    for dim, own in books.items():
        marks = F.when(F.col("dim") == dim, fingerprint(own)).otherwise(marks)
    total = F.least(F.col("total"), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    return x.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", total.alias("label_error"), marks.alias("codebooks_sha256"))
