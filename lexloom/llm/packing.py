"""Pattern packing: documents cut into pieces, pieces packed into sequences of bounded length.

Few-document length patterns that fill a sequence exactly are enumerated, their
repeat counts fitted to the histogram of lengths by non-negative least squares
and rounded; what is left is packed best-fit decreasing, length by length.
The plan depends on the histogram alone (at most ``capacity`` rows reach the
driver); each piece finds its place from its rank among pieces of its length.

Defined results: a null or empty text is one piece that holds the end id only; null
ids are ids like others; repeated rows are packed as often as they occur, each at a
place of its own; an empty table gives no rows; other columns of the input, whatever
their names, are ignored.
"""

import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.llm.common import leading, numbered, text_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# Characters for which Python's classes agree with the Unicode properties of the tokenizer's pattern.
UNSAFE = re.compile("[^\t-\r -~\xa0\xa1\xa7\xa9\xab\xae\xb0\xb1\xb5-\xb7\xba\xbb\xbf-ɏ‐-‧‰-⁞€]")
SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall


LONGEST = 64


class Ids:
    """Token ids of a byte-level BPE file as little-endian unsigned 32-bit bytes.

    Pieces of the pre-tokenizer are looked up in a cache bounded in entries and in the
    length of each (``LONGEST`` characters), so frequent words are merged once a task; texts with characters outside ``UNSAFE``'s complement,
    or with a special token in them, go through the plain library call.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer")
        if self.fast:
            import tiktoken

            # The byte alphabet of byte-level BPE: printable bytes stand for themselves, the rest follow from 256 on.
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            other = [b for b in range(256) if b not in set(plain)]
            byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
            ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
            merge = tiktoken.Encoding("bytes", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

            class Cache(dict):
                def __missing__(self, s):
                    got = np.array(merge(s), "<u4").tobytes()
                    if len(s) <= LONGEST and len(self) < most:
                        self[s] = got
                    return got

            self.of = Cache().__getitem__

    def __call__(self, text: str) -> bytes:
        if self.fast and not UNSAFE.search(text) and not any(s in text for s in self.special):
            return b"".join(map(self.of, SPLIT(text)))
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]): each text's ids plus the end id, cut from the end
    into full pieces, so that only a first piece may be shorter."""
    schema = PIECES + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches):
        ids_of, end = Ids(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = {n: [] for n in names}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text.as_py()) + end
                n = len(ids) // 4
                first = n % capacity or capacity
                begin = 0
                for k, stop in enumerate(range(first, n + 1, capacity)):
                    own = ids[4 * begin : 4 * stop]
                    for name, v in zip(names, (doc, k, begin, stop - begin, zlib.crc32(own), own)):
                        out[name].append(v)
                    begin = stop
            types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(out[n], types[n]) for n in names], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(cut, schema)


def patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, most: int) -> np.ndarray:
    """Rows of three indices into ``lengths`` (-1: none) whose lengths add up to the capacity.

    Where all triples are more than ``most``, those of the most frequent lengths are taken.
    """
    at = np.full(capacity + 1, -1)
    at[lengths] = np.arange(len(lengths))
    pair = [(at[a], at[capacity - a], -1) for a in lengths if 2 * a <= capacity and at[capacity - a] >= 0]
    often = np.sort(lengths[np.argsort(-counts, kind="stable")[: max(2, int((6 * most) ** 0.5))]])
    found = [np.array(pair, int).reshape(-1, 3)]
    for a in often:
        b = often[(often >= a) & (a + 2 * often <= capacity)]
        c = at[capacity - a - b]
        ok = c >= 0
        found.append(np.stack([np.full(ok.sum(), at[a]), at[b[ok]], c[ok]], 1))
    return np.concatenate(found)


def least_squares(pats: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |A x - target|, A counting each pattern's lengths: projected accelerated gradient."""
    n, used = len(target), pats >= 0
    flat, where = pats[used], np.nonzero(used)[0]
    forward = lambda x: np.bincount(flat, x[where], n)
    back = lambda r: np.bincount(where, r[flat], len(pats))
    v = np.ones(len(pats))
    for _ in range(20):
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(forward(y) - target) / (1.05 * top))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over counts of lengths: groups (how many sequences, lengths in each)."""
    open_: dict[int, list] = defaultdict(list)  # by room left
    for length in sorted(left, reverse=True):
        n = left[length]
        for room in range(length, capacity):
            while n and open_[room]:
                count, items = open_[room].pop()
                fit = min(room // length, -(-n // count))
                take = min(count, n // fit)
                if take < count:
                    open_[room].append((count - take, items))
                open_[room - fit * length].append((take, items + (length,) * fit))
                n -= take * fit
            if not n:
                break
        each = capacity // length
        if n >= each:
            open_[capacity - each * length].append((n // each, (length,) * each))
        if n % each:
            open_[capacity - n % each * length].append((1, (length,) * (n % each)))
    return [g for groups in open_.values() for g in groups]


def plan(histogram: dict[int, int], capacity: int, most_patterns: int = 200_000, refits: int = 3) -> list[tuple[int, tuple[int, ...]]]:
    """Groups (how many sequences, lengths in each) that use up the histogram exactly."""
    left = dict(histogram)
    groups = [(left.pop(capacity), (capacity,))] if left.get(capacity) else []
    for _ in range(refits):
        lengths = np.array(sorted(k for k, v in left.items() if v), int)
        if len(lengths) < 2:
            break
        counts = np.array([left[k] for k in lengths], float)
        pats = patterns(lengths, counts, capacity, most_patterns)
        if not len(pats):
            break
        x = least_squares(pats, counts)
        used = False
        for i in np.argsort(-x, kind="stable"):
            want = int(x[i] + 0.5)
            if not want:
                break
            items = tuple(int(lengths[j]) for j in pats[i] if j >= 0)
            take = min([want] + [left[v] // items.count(v) for v in items])
            if take:
                used = True
                groups.append((take, items))
                for v in items:
                    left[v] -= take
        if not used:
            break
    return groups + best_fit({k: v for k, v in left.items() if v}, capacity)


def layout(groups: list[tuple[int, tuple[int, ...]]]) -> dict[int, list[tuple[int, int, int]]]:
    """Per length, runs (first rank, sequence of that rank, offset); the next rank goes to the next sequence."""
    runs, used, base = defaultdict(list), defaultdict(int), 0
    for count, items in groups:
        offset = 0
        for v in items:
            runs[v].append((used[v], base, offset))
            used[v] += count
            offset += v
        base += count
    return runs


def places(spark, runs: dict[int, list[tuple[int, int, int]]], histogram: dict[int, int], width: int) -> DataFrame:
    """(length, _bin, runs): the runs that hold ranks of a bin of ``width`` ranks, in order. Rows and runs in them are at most
    the runs plus the bins; they are broadcast only where that is few."""
    rows = []
    for length, own in runs.items():
        ends = [r[0] for r in own[1:]] + [histogram[length]]
        by: dict[int, list] = defaultdict(list)
        for run, end in zip(own, ends):
            for k in range(run[0] // width, (end - 1) // width + 1):
                by[k].append(run)
        rows.extend((length, k, v) for k, v in by.items())
    df = spark.createDataFrame(rows, "length long, _bin long, runs array<struct<first:long,base:long,offset:long>>")
    return F.broadcast(df) if sum(len(r[2]) for r in rows) <= FEW_RUNS else df


FEW_RUNS = 100_000  # of 24 bytes each


def pack(cut: DataFrame, capacity: int = 1024, rows_per_block: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns length, doc_id, piece and any more)."""
    own = [c for c in cut.columns if c != "_row"]
    cut = numbered(cut.select(own), "_row")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    n = sum(histogram.values())
    width = max(4096, n // 100_000)
    table = places(cut.sparkSession, layout(plan(histogram, capacity)), histogram, width)
    # Ranks among equal lengths, without gathering a common length: numbered in blocks, blocks after each other.
    x = cut.withColumn("_b", F.pmod(F.xxhash64("_row"), F.lit(max(64, n // rows_per_block))).cast("int"))
    counts = x.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("length", "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    x = x.withColumn("_i", F.row_number().over(W.partitionBy("length", "_b").orderBy("_row")))
    x = x.join(starts, ["length", "_b"]).withColumn("_r", F.col("_before") + F.col("_i") - 1)
    x = x.withColumn("_bin", F.floor(F.col("_r") / width)).join(table, ["length", "_bin"])
    x = x.withColumn("_run", F.get("runs", leading(F.col("runs"), lambda v: v["first"] <= F.col("_r")) - 1))
    return x.select(*own, (F.col("_run")["base"] + F.col("_r") - F.col("_run")["first"]).alias("sequence_id"), F.col("_run")["offset"].alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, pieces in order, length): a sequence holds at most ``capacity`` pieces."""
    item = F.struct("offset", "doc_id", "piece", "start", "length")
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(item)).alias("pieces"), F.sum("length").alias("length"))
