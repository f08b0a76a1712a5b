"""SimHash near-duplicates: Hamming search with vantage-point trees.

Distinct fingerprints are partitioned by vantage-point trees, one over each 32-bit
part: of two fingerprints of two parts that differ in at most two bits, one part differs
in at most one. A node of a tree holds a vantage point and a radius; a fingerprint
lives in one leaf, and visits as a guest every other leaf that the triangle
inequality cannot rule out. Leaves are searched on their own, large ones by
vantage-point trees inside the task; each leaf returns one edge a member at most, and
connected components join the leaves.

With 64 bits and two parts every pair within two bits is found. ``survivors`` uses longer
fingerprints, where pairs of the least likeness asked for differ in more bits: pairs are
candidates if one of four parts differs in at most three bits, and linked if all bits
together differ in few enough; what that finds of such pairs is measured, not certain.

The trees are fitted on a sample that grows with the leaves wanted (``LEAF`` of the
sample a leaf, which is to hold at most about ``HELD`` fingerprints); they decide only
where fingerprints meet, not which pairs are linked.

Defined results: null and empty texts have fingerprint zero and are linked like
others; a null id is smaller than none: it counts where a component has no other; repeated
rows share their component; an empty table gives no rows.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import components, forest, keep, named, numbered, text_of
from lexloom.llm.lines import before

SAMPLE = 20_000
LEAF = 40  # of the sample
HELD = 100_000
RADIUS = 2
PAIRS_AT_ONCE = 1 << 21
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # of splitmix64


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; bits are added up as bytes, 255 hashes at a time."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 255 * 64):
        part = hashes[i : i + 255 * 64]
        if len(part) > 255:
            part = np.concatenate([part, np.zeros(-len(part) % 255, np.uint64)])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits.reshape(-1, min(255, len(part)), 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: str, size: int, seed: int) -> np.ndarray:
    """XXH64 of all word shingles; A-Z are lower-cased, words end at ASCII white space."""
    import xxhash

    words = text.encode().lower().split()
    n, h = len(words), xxhash.xxh64_intdigest
    if n < size:
        return np.array([h(b" ".join(words), seed)] if n else [], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n -= size - 1
    return np.fromiter((h(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist())), np.uint64, n)


def fingerprint(text: str, size: int = 3, seed: int = 42, words: int = 1) -> list[int]:
    """``words`` times 64 bits: those of the hashes, then those of the hashes mixed anew."""
    hashes, out = shingle_hashes(text, size, seed), []
    for k in range(words):
        x = hashes
        if k:
            x = hashes + np.uint64(int(MIX[0]) * k % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * MIX[1]
            x = (x ^ (x >> np.uint64(27))) * MIX[2]
            x ^= x >> np.uint64(31)
        out.append(majority(x))
    return out


def fingerprints(docs: DataFrame, size: int = 3, words: int = 1, own: list[str] | None = None) -> DataFrame:
    """``own`` columns (doc_id as a long) and fp: an array of signed longs."""
    ident = F.col("doc_id").cast("long").alias("doc_id")
    x = docs.select(*([ident] if own is None else own), text_of("text").alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema.fields[:-1]) + ", fp array<long>"

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size, words=words) for t in b.column(b.num_columns - 1)], np.uint64).view(np.int64)
            rows = pa.ListArray.from_arrays(np.arange(0, fps.size + 1, words, dtype=np.int32), pa.array(fps.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], rows], [*b.schema.names[:-1], "fp"])

    return x.mapInArrow(run, schema)


def differ(x: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(x ^ v).astype(np.int16)


def grow(x: np.ndarray, least: int, rng) -> tuple | None:
    """A vantage-point tree over a sample: (vantage, radius, inside, outside), None a leaf."""
    if len(x) < 2 * least:
        return None
    best = None
    for v in rng.choice(x, min(4, len(x)), replace=False):
        d = differ(x, v)
        for t in {int(np.median(d)), int(np.median(d)) - 1}:
            inside = int((d <= t).sum())
            crossing = int(((d == t) | (d == t + 1)).sum())
            if min(inside, len(x) - inside) >= len(x) // 5:
                cost = crossing + abs(len(x) - 2 * inside)
                if best is None or cost < best[0]:
                    best = (cost, v, t)
    if best is None:
        return None
    _, v, t = best
    inside = differ(x, v) <= t
    return v, t, grow(x[inside], least, rng), grow(x[~inside], least, rng)


def route(x: np.ndarray, tree, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, leaf, guest) of every leaf that each x lives in or has to visit."""
    out, todo, leaf = [], [(tree, np.arange(len(x)), np.zeros(len(x), bool))], 0
    while todo:
        node, i, guest = todo.pop()
        if node is None:
            out.append((i, np.full(len(i), leaf), guest))
            leaf += 1
            continue
        v, t, inside, outside = node
        d = differ(x[i], v)
        # Residents from outside visit inside; the other way round would find each pair twice.
        here = d <= t
        visit = ~here & (d <= t + reach)
        todo.append((inside, np.concatenate([i[here], i[visit]]), np.concatenate([guest[here], np.ones(visit.sum(), bool)])))
        there = ~here
        back = here & guest & (d > t - reach)
        todo.append((outside, np.concatenate([i[there], i[back]]), np.concatenate([guest[there], np.ones(back.sum(), bool)])))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def near(hosts: np.ndarray, guests: np.ndarray, at, radius: int, rng, depth: int = 0):
    """Yields index pairs (into ``at``) of a host and another host or guest that differ in at most ``radius`` bits."""
    h, n = len(hosts), len(hosts) + len(guests)
    if not h or n < 2:
        return
    if h * n > 4 * PAIRS_AT_ONCE and depth < 40:
        d = differ(at[hosts], v := at[rng.choice(hosts)])
        t = int(np.median(d))
        t -= t == d.max()
        inside = d <= t
        g = differ(at[guests], v)
        cross = ~inside & (d <= t + radius)
        in_guests, out_guests = np.concatenate([guests[g <= t + radius], hosts[cross]]), guests[g > t - radius]
        a, b = hosts[inside], hosts[~inside]
        if len(a) and len(b) and len(a) * (len(a) + len(in_guests)) + len(b) * (len(b) + len(out_guests)) < 0.95 * h * n:
            yield from near(a, in_guests, at, radius, rng, depth + 1)
            yield from near(b, out_guests, at, radius, rng, depth + 1)
            return
    everyone = np.concatenate([hosts, guests])
    others, step = at[everyone], max(1, PAIRS_AT_ONCE // n)
    for k in range(0, h, step):
        i, j = np.nonzero(np.bitwise_count(at[hosts[k : k + step], None] ^ others[None, :]) <= radius)
        ok = j > i + k
        yield hosts[i[ok] + k], everyone[j[ok]]


def part_of(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th 32 bits of fingerprints given as rows of 64-bit words."""
    return (x[:, k // 2] >> np.uint64(32 * (k % 2))).astype(np.uint32)


def rows_of(fp: pa.ListArray) -> np.ndarray:
    return fp.flatten().to_numpy().view(np.uint64).reshape(len(fp), -1)


def links(fps: DataFrame, parts: int = 2, reach: int = RADIUS // 2, radius: int = RADIUS, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) of classes of ``fps`` (class: distinct longs, fp): of all pairs of which one of the first ``parts`` parts
    differs in at most ``reach`` bits and all bits together in at most ``radius``, as many as their components need."""
    n = fps.count()
    sample = max(sample, leaf * math.ceil(n / HELD))
    share = F.pmod(F.xxhash64("class", F.lit(3)), F.lit(1 << 30)) < (1 << 30) * min(1.0, sample / max(n, 1))
    some = rows_of(fps.filter(share).orderBy("class").limit(2 * sample).select("fp").toArrow()["fp"].combine_chunks()) if n else np.zeros((0, parts), np.uint64)
    rng = np.random.default_rng(1)
    trees = [grow(part_of(some, k), leaf, rng) for k in range(parts)]

    def deal(batches):
        for b in batches:
            x = rows_of(b.column("fp"))
            for k, tree in enumerate(trees):
                i, at, guest = route(part_of(x, k), tree, reach)
                took = b.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([pa.array((parts * at + k).astype(np.int64)), took.column("class"), took.column("fp"), pa.array(guest)], ["leaf", "class", "fp", "guest"])

    def search(rows: pa.Table) -> pa.Table:
        x, guest, name = rows_of(rows["fp"].combine_chunks()), rows["guest"].to_numpy(), rows["class"].to_numpy()
        root = np.arange(len(x))
        for i, j in near(np.nonzero(~guest)[0], np.nonzero(guest)[0], part_of(x, rows["leaf"][0].as_py() % parts), reach, np.random.default_rng(2)):
            new = root[i] != root[j]
            i, j = i[new], j[new]
            new = np.bitwise_count(x[i] ^ x[j]).sum(1) <= radius
            if new.any():  # the forest so far and the new pairs
                own = np.nonzero(root != np.arange(len(x)))[0]
                root = forest(len(x), np.concatenate([own, i[new]]), np.concatenate([root[own], j[new]]))
        own = np.nonzero(root != np.arange(len(x)))[0]
        return pa.table({"a": name[own], "b": name[root[own]]})

    dealt = fps.select("class", "fp").mapInArrow(deal, "leaf long, class long, fp array<long>, guest boolean")
    return dealt.groupBy("leaf").applyInArrow(search, "a long, b long")


def grouped(own: DataFrame, key: str, **search) -> DataFrame:
    """Adds to rows with a fingerprint the smallest ``key`` reachable through links, as component."""
    fps = numbered(own.groupBy("fp").agg(F.min(key).alias("first")), "class")
    found = components(links(fps, **search)).withColumnRenamed("id", "class")
    root = fps.join(found, "class", "left").select("fp", "first", F.coalesce("component", "class").alias("root"))
    least = root.groupBy("root").agg(F.min("first").alias("component"))
    return own.join(root.join(least, "root").select("fp", "component"), "fp")


SMALL, SHINGLES = 4000, 1 << 21  # members of a group that one task compares, and what they weigh together


def shingle_sets(docs: DataFrame, size: int, columns: list) -> DataFrame:
    """``columns`` of documents and sh: the distinct hashes of their shingles in ascending order."""
    x = docs.select(*columns, text_of("text").alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema.fields[:-1]) + ", sh array<long>"

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.slice(at, 64)
                sets = [np.unique(shingle_hashes(t.as_py(), size, 42).view(np.int64)) for t in part.column(part.num_columns - 1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], [*part.schema.names[:-1], "sh"])

    return x.mapInArrow(run, schema)


def weight() -> Column:
    """Of a member of a group: its shingles, and as many as let a task have at most SMALL members."""
    return F.size("sh") + F.lit(SHINGLES // SMALL)


class Postings:
    """The sets of a list by their hashes."""

    def __init__(self, sets: pa.ListArray):
        self.sizes, flat = np.asarray(sets.value_lengths()), np.asarray(sets.flatten())
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.values, self.count = np.unique(flat, return_counts=True)
        self.begin = np.cumsum(self.count) - self.count

    def like(self, own: np.ndarray, least: float) -> np.ndarray:
        """Which sets have a Jaccard index of ``least`` or more with one given as a sorted array; two empty sets are equal."""
        at = np.searchsorted(self.values, own)
        at = at[self.values.take(at, mode="clip") == own] if len(self.values) else at[:0]
        n = self.count[at]
        i = np.repeat(self.begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(self.owner[i], minlength=len(self.sizes))
        return both >= least * (self.sizes + len(own) - both)


def first_kept(rows: pa.Table, least: float) -> pa.Table:
    """The rows that stay of a group (key, sh): in order of the key, those that no earlier one which stays is like."""
    keys, sets = rows["key"].to_pylist(), rows["sh"].combine_chunks()
    found, gone, out = Postings(sets), np.zeros(len(rows), bool), []
    for i in sorted(range(len(rows)), key=lambda i: tuple(keys[i].values())):
        if not gone[i]:
            out.append(i)
            gone |= found.like(np.asarray(sets[i].values), least)
    return rows.take(out)


def leaders(members: DataFrame, least: float) -> DataFrame:
    """The keys that stay of groups of candidates (component, key, sh: kept rows): in order of the key, every member that no
    earlier one which stays is like.

    At first every member is compared with the first of its group: a join by group, whose large sides Spark splits. That takes
    the copies of one text, however many. Groups of which little is left are settled in one task each. Larger ones are dealt in
    order of the key into parts that a task can hold: the first part is settled, the others are compared with what stays of
    it, each in a task, and the rest goes on; so a group takes a round a part, not a round a member that stays.
    """
    first = keep(members.groupBy("component").agg(F.min_by(F.struct("key", "sh"), "key").alias("f"), F.count("*").alias("n")))
    stays = first.select(F.col("f.key").alias("key"))
    x = members.join(first.filter("n > 1").select("component", "f"), "component").filter(F.col("key") != F.col("f")["key"])
    sizes, both = F.size("sh") + F.size(F.col("f")["sh"]), F.size(F.array_intersect("sh", F.col("f")["sh"]))
    left = keep(x.filter(F.coalesce(both < least * (sizes - both), F.lit(True))).select("component", "key", "sh"), sweep=True)
    row = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema.fields)

    def settle(*names: str):
        return lambda rows: first_kept(rows, least).select(list(names))

    def compare(rows: pa.Table, firsts: pa.Table) -> pa.Table:
        found, gone = Postings(rows["sh"].combine_chunks()), np.zeros(len(rows), bool)
        for own in firsts["sh"].combine_chunks():
            gone |= found.like(np.asarray(own.values), least)
        return rows.filter(pa.array(~gone)).select(["component", "key", "sh"])

    while True:
        counts = keep(left.groupBy("component").agg(F.sum(weight()).alias("n")))
        if counts.isEmpty():
            return stays
        few = counts.filter(F.col("n") <= SHINGLES).select("component")
        small = left.join(few, "component", "left_semi")
        stays = stays.unionByName(small.groupBy("component").applyInArrow(settle("key"), f"key {left.schema['key'].dataType.simpleString()}"))
        left = keep(left.join(few, "component", "left_anti"), sweep=True)
        if left.isEmpty():
            return stays
        placed = before(left, ["component", "key"], weight())
        start = F.broadcast(placed.groupBy("component").agg(F.min("_r").alias("_s")))  # groups of more than SHINGLES each
        parts = keep(placed.join(start, "component").select("component", "key", "sh", F.floor((F.col("_r") - F.col("_s")) / SHINGLES).alias("part")))
        new = keep(parts.filter("part = 0").groupBy("component").applyInArrow(settle("component", "key", "sh"), row))
        stays = stays.unionByName(new.select("key"))
        rest = parts.filter("part > 0")
        firsts = new.join(rest.select("component", F.col("part").alias("of")).distinct(), "component")
        left = keep(rest.groupBy("component", "part").cogroup(firsts.groupBy("component", "of")).applyInArrow(compare, row), sweep=True)


def survivors(docs: DataFrame, size: int = 5, words: int = 4, parts: int = 8, reach: int = 3, radius: int = 50, least_held: int = 25_000, least: float = 0.8) -> DataFrame:
    """The rows of one document of each group of near copies, the smallest by (doc_id, nulls last; hashes of the text and of all columns).

    Candidates are groups of documents whose fingerprints of ``words`` times 64 bits over shingles of ``size`` words link at
    ``radius`` bits or fewer, wider than ``least`` asks for. Of a group, in order, every document goes that has a Jaccard
    index of ``least`` or more, over all its shingles, with one that stays; so none goes for a likeness that is not there, and
    no two alike of a group stay. Leaves hold more fingerprints the more there are, because each level of a tree makes more
    of them visit others.
    """
    plain = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    key = [ident.alias("_d"), F.xxhash64(text_of("text")).alias("_t"), F.xxhash64(*named(plain)).alias("_o")]
    names = ["_d", "_t", "_o"]
    own = keep(fingerprints(docs, size, words, key).select(F.struct(*names).alias("key"), "fp"), sweep=True)
    n = own.count()
    held = min(200_000, max(least_held, int(54 * n**0.5)))
    sample = max(4000, LEAF * math.ceil(n / held))
    search = {"parts": parts, "reach": reach, "radius": radius, "sample": sample, "leaf": max(LEAF, math.ceil(sample * held / max(n, 1)))}
    x = keep(grouped(own, "key", **search).select("key", "component").distinct(), sweep=True)  # rows that agree in all columns are one
    grown = x.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    several = keep(x.join(grown, "component", "left_semi"))
    sets = shingle_sets(docs.select(*key, "text").join(several.select("key.*").distinct(), names, "left_semi").dropDuplicates(names), size, names)
    members = keep(several.join(sets.select(F.struct(*names).alias("key"), "sh"), "key").select("component", "key", "sh"), sweep=True)
    gone = several.select("key").join(leaders(members, least), "key", "left_anti").select("key.*")
    rows = docs.select(F.struct(*named(docs.columns)).alias("doc"), *key).join(gone, names, "left_anti")
    if x.count() < n:
        rows = rows.dropDuplicates(names)  # rows that repeat in every column
    return rows.select("doc.*")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable through links of 64-bit fingerprints of three-word shingles."""
    x = grouped(keep(fingerprints(docs)), "doc_id")
    return x.select("doc_id", F.get("fp", 0).alias("fp"), F.col("component").alias("component_id"))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
