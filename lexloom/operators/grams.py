"""Substring search by an index of trigrams.

Every field's upper-cased text is cut into its distinct runs of three characters; postings
(gram, field, ids: those of some rows that have it) lie partitioned by a hash of the gram. A search reads only the postings of
its own grams, keeps the ids that have all of them in one field, and looks at the texts of
these rows again, so the rows are those of a scan. A needle shorter than three characters
has no gram and is searched for by a scan.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import contains_ci

SIZE = 3
CHARS_AT_ONCE = 1 << 21


@dataclass
class Grams:
    path: str
    fields: list[str]
    buckets: int


def grams(text):
    """Distinct runs of three characters of an upper-cased text."""
    up = F.upper(text)
    at = F.sequence(F.lit(1), F.length(up) - (SIZE - 1))
    return F.when(F.length(up) >= SIZE, F.array_distinct(F.transform(at, lambda i: F.substring(up, i, F.lit(SIZE)))))


def bucket(gram, buckets: int):
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def posted(texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(grams in order, ends, rows): the rows of gram k, each once, lie in rows[ends[k]:ends[k + 1]]."""
    chars = [t.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = np.array([len(c) // 4 for c in chars])
    c = np.frombuffer(b"".join(chars), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    if len(c) < SIZE:
        return [], np.zeros(1, np.int32), row[:0]
    whole = row[: 1 - SIZE] == row[SIZE - 1 :]
    gram, row = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[whole], row[: 1 - SIZE][whole]  # a code point has 21 bits
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    gram, row = gram[new], row[new]
    first = np.nonzero(np.diff(gram, prepend=-1))[0]
    names = np.stack([gram[first] >> k & 0x1FFFFF for k in (42, 21, 0)], 1).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return [names[i : i + SIZE] for i in range(0, len(names), SIZE)], np.append(first, len(gram)).astype(np.int32), row


def build(rows: DataFrame, fields: list[str], path: str, key: str = "id", buckets: int = 64) -> Grams:
    """Writes the postings of the fields (of any type, as strings); a bucket is one folder, sorted by gram.

    A batch of rows gives one posting a gram and field, so what travels are ids, not a gram each.
    """
    kind = rows.schema[key].dataType.simpleString()
    upper = [F.upper(F.col(c).cast("string")).cast("binary").alias(f"_{i}") for i, c in enumerate(fields)]

    def post(batches):
        for b in batches:
            for i in range(1, b.num_columns):
                texts = [t or b"" for t in b.column(i).to_pylist()]
                part = np.cumsum([len(t) for t in texts]) // CHARS_AT_ONCE
                cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), len(texts)]
                for lo, hi in zip(cuts, cuts[1:]):
                    names, ends, at = posted(texts[lo:hi])
                    ids = pa.ListArray.from_arrays(pa.array(ends), b.column(0).take(pa.array(at + lo)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(names), i - 1, np.int32)), pa.array(names, pa.string())], ["ids", "field", "gram"])

    x = rows.select(F.col(key).alias("id"), *upper).mapInArrow(post, f"ids array<{kind}>, field int, gram string")
    x = x.withColumn("bucket", bucket(F.col("gram"), buckets))
    # Common grams are many ids: salted, so that no bucket is one task.
    x = x.repartition("bucket", F.pmod(F.xxhash64("ids"), F.lit(8))).sortWithinPartitions("bucket", "gram", "field")
    x.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return Grams(path, list(fields), buckets)


def candidates(index: Grams, rows: DataFrame, needle: str, key: str = "id") -> DataFrame | None:
    """Ids that have every gram of the needle in one field; None where the needle has no gram."""
    spark = rows.sparkSession
    asked = spark.range(1).select(F.explode(grams(F.lit(needle))).alias("gram")).withColumn("bucket", bucket(F.col("gram"), index.buckets)).collect()
    if not asked:
        return None
    kind = rows.schema[key].dataType.simpleString()
    postings = spark.read.schema(f"ids array<{kind}>, field int, gram string, bucket int").parquet(index.path)
    own = postings.filter(F.col("bucket").isin(sorted({r.bucket for r in asked})) & F.col("gram").isin([r.gram for r in asked]))
    full = own.select(F.explode("ids").alias("id"), "field", "gram").groupBy("id", "field").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(asked))
    return full.select(F.col("id").alias(key)).distinct()


def search(index: Grams, rows: DataFrame, needle: str, key: str = "id") -> DataFrame:
    """The rows in one of whose indexed fields the needle stands, whatever the case."""
    hit = contains_ci(needle, *[F.col(c).cast("string") for c in index.fields])
    some = candidates(index, rows, needle, key)
    return (rows if some is None else rows.join(some, key, "left_semi")).filter(hit)
