"""Shared pieces: reading, cutting lineage, connected components."""

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one set by setCheckpointDir, else, only
    where driver and executors are one process, a new local one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or tempfile.mkdtemp(prefix="lexloom-")).rstrip("/")


def keep(df: DataFrame, sweep: bool = False) -> DataFrame:
    """Checkpoint in the shared folder.

    ``sweep``, for rounds of many queries: the driver collects its garbage afterwards. Plans, tasks and events of queries that are
    over else fill its heap up to the limit, though little of that is live, and Spark drops their shuffle files only then.
    The size that Spark assumed goes, too: a checkpoint keeps it, a join multiplies its sides', so rounds that join square it, and
    the digits of that one number double with every round until they fill the heap. Sizes of shuffled rows are measured anyway.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    kept = df.checkpoint()
    if sweep:
        plain = df.sparkSession._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().logical().rdd(), kept._jdf.schema(), False)
        kept = DataFrame(plain, df.sparkSession)
        sc._jvm.System.gc()
    return kept


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds a distinct number a row, kept with the rows, so that it stays the same whoever reads them again."""
    return keep(df.withColumn(name, F.monotonically_increasing_id()))


def leading(items: Column, holds) -> Column:
    """How many elements at the start of an array pass ``holds``, which is true up to some element: a binary search."""
    struct = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        step = F.when(F.coalesce(holds(F.get(items, mid)), F.lit(False)), struct(mid + 1, s["hi"])).otherwise(struct(s["lo"], mid))
        return F.when(s["lo"] < s["hi"], step).otherwise(s)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(items) + F.lit(1.0))).cast("int"))
    return F.aggregate(steps, struct(F.lit(0), F.size(items)), halve)["lo"]


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_of(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def named(columns: list[str]) -> list[Column]:
    """Columns by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in columns]


WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(c: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], count: str = "n", hot: int = 1000) -> DataFrame:
    """Rows (kept) with the row of their group (kept; ``count``: how many rows it has).

    Groups with more than one in ``hot`` of all rows, fewer than ``hot`` of them, are broadcast, so that none is one task.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * hot > total
    big = F.broadcast(groups.filter(is_hot))
    rest = rows.join(big.select(*key), key, "left_anti").join(groups.filter(~is_hot), key)
    return rows.join(big, key).unionByName(rest).drop(count)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n vertices reaches."""
    label = np.arange(n)
    while len(a):
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], m)
        np.minimum.at(new, label[b], m)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every endpoint of ``edges`` (a, b: comparable values); component is the smallest id reachable.

    Alternates large-star and small-star steps, each one group-by and one join on
    vertices, until nothing changes; the rounds grow with the logarithm of the
    longest path. Minima combine before the shuffle; joins are plain equi-joins
    that AQE splits when a hub is skewed. Each round is checkpointed.
    """
    e = keep(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), sweep=True)
    before = None
    for _ in range(most_rounds):
        # Large star: neighbours above a vertex move to the vertex's smallest neighbour.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: neighbours at or below a vertex move to the smallest of them.
        large = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = keep(moved.filter("a <> b").distinct(), sweep=True)
        sign = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before:
            roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
        before = sign
    raise RuntimeError("components did not settle")
