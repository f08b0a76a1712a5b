"""Line deduplication by a suffix array over sequences of line ids.

A line's id is the hash of its text without outer blanks (tabs and carriage returns are part of it); a second, independent hash
shows ids that different lines share, and replaces them. Lines that occur once cannot lie in a repeated run, so they cut documents into islands of repeated lines;
islands with fewer words than a run needs go, too. Over the islands a suffix array
is built by prefix doubling: a suffix's rank is its place among all suffixes in the
order of their first lines' ids; ranks by the first 2, 4, 8 ... lines come from pairs
of ranks, whose distinct values are counted (not their rows), range-partitioned and
summed in order, so that no line's suffixes have to meet in one task.

Suffixes whose longest common prefix covers n lines form an interval, which two
ranks name: of the first 2**k lines and of the last 2**k of the n. A run of at least
``min_words`` words is the union of its shortest runs of that many words from each
line on, and up to each line; so each such shortest run is looked up in its interval,
and where the interval holds an earlier suffix, by (doc_id, line), its lines are
deleted. Only as many doublings are needed as the longest of these runs asks for.

Defined results: a null text stays null and has no lines; rows with the same doc_id and text are one
document and stay repeated; lines may be empty (they count no words); ``keep_empty``
says whether documents that lose every word stay; null ids are one id; an empty table
gives no rows; further columns pass through, but for ones named n_lines and n_removed.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.llm.common import join_groups, keep, n_words, named, text_of

KEY = ["d", "t"]
HOT = 1000  # a line with more than one in so many of all lines is hot: fewer than HOT ids are broadcast


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, d, t, text): all columns but the text as one, so that their names cannot clash, and the key of a document."""
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return docs.select(F.struct(*named([c for c in docs.columns if c != "text"])).alias("doc"), ident.alias("d"), F.xxhash64(text_of("text")).alias("t"), F.col("text").alias("text"))


def line_id(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def second_id(line: Column) -> Column:
    """Independent of the first: the constant goes in before the line."""
    return F.xxhash64(F.lit(77), F.trim(line))


def islands(docs: DataFrame, min_words: int) -> DataFrame:
    """(d, t, island, ln, id, words): runs of lines that each occur more than once."""
    base = keyed(docs).filter("text is not null").select("d", "t", "text")
    line = F.transform(F.split("text", "\n", -1), lambda x: F.struct(line_id(x).alias("id"), second_id(x).alias("id2"), x.alias("line")))
    rows = base.select("d", "t", F.posexplode(line).alias("ln", "x")).select("d", "t", "ln", "x.*")
    # A repeated row is the same document: its lines count once.
    hashed = rows.groupBy("d", "t", "ln").agg(F.first("id").alias("id"), F.first("id2").alias("id2"), F.first(n_words(F.col("line"))).alias("words"))
    lines = keep(hashed)
    count = lambda x: keep(x.groupBy("id").agg(F.count("*").alias("count"), (F.min("id2") != F.max("id2")).alias("shared")).filter("count > 1"))
    often = count(lines)
    if not often.filter("shared").isEmpty():
        # Ids of different lines: about the square of the number of lines over 2 ** 65, none at all in most tables.
        shared = F.broadcast(often.filter("shared").select("id", "shared"))
        lines = keep(lines.join(shared, "id", "left").withColumn("id", F.when(F.col("shared"), F.col("id2")).otherwise(F.col("id"))).drop("shared"))
        often = count(lines)
    lines, often = lines.drop("id2"), often.drop("shared")
    is_hot = F.col("count") * HOT > lines.count()
    marked = lines.join(F.broadcast(often.filter(is_hot).select("id", F.lit(True).alias("hot"))), "id", "left")
    rare = marked.filter("hot is null").join(often.filter(~is_hot).select("id"), "id", "left_semi")
    x = marked.filter("hot").unionByName(rare).drop("hot")
    doc = W.partitionBy(*KEY).orderBy("ln")
    x = x.withColumn("island", F.col("ln") - F.row_number().over(doc))
    total = F.sum("words").over(W.partitionBy(*KEY, "island"))
    return keep(x.withColumn("_w", total).filter(F.col("_w") >= min_words).drop("_w"))


def windows(x: DataFrame, min_words: int) -> DataFrame:
    """(d, t, island, b, m): the shortest runs of ``min_words`` words from each line on and up to each line."""
    where = W.partitionBy(*KEY, "island")
    x = x.withColumn("c1", F.sum("words").over(where.orderBy("ln"))).withColumn("c0", F.col("c1") - F.col("words"))
    on, upto = where.orderBy("c0").rangeBetween(0, min_words - 1), where.orderBy("c1").rangeBetween(1 - min_words, 0)
    from_here = x.select(*KEY, "island", F.col("ln").alias("b"), F.max("ln").over(on).alias("e"), (F.max("c1").over(on) - F.col("c0")).alias("w"))
    to_here = x.select(*KEY, "island", F.min("ln").over(upto).alias("b"), F.col("ln").alias("e"), (F.col("c1") - F.min("c0").over(upto)).alias("w"))
    both = from_here.unionByName(to_here).filter(F.col("w") >= min_words)
    return both.select(*KEY, "island", "b", (F.col("e") - F.col("b") + 1).alias("m")).distinct()


def before(x: DataFrame, by: list[str], n: Column) -> DataFrame:
    """Adds _r, the sum of ``n`` over all rows that come earlier in the order of ``by`` (nulls first; rows distinct).

    Rows are range-partitioned; one sum a partition reaches the driver.
    """
    x = keep(x.withColumn("_n", n).repartitionByRange(*by).withColumn("_p", F.spark_partition_id()))
    starts, total = [], 0
    for p, s in sorted((r["_p"], r["s"]) for r in x.groupBy("_p").agg(F.sum("_n").alias("s")).collect()):
        starts.append((p, total))
        total += s
    told = F.broadcast(x.sparkSession.createDataFrame(starts, "_p int, _start long"))
    inside = F.sum("_n").over(W.partitionBy("_p").orderBy(*by).rowsBetween(W.unboundedPreceding, -1))
    return x.join(told, "_p").withColumn("_r", F.col("_start") + F.coalesce(inside, F.lit(0))).drop("_n", "_p", "_start")


def suffix_ranks(x: DataFrame, longest: int) -> DataFrame:
    """(d, t, island, ln, id, r): r holds each suffix's place by its first 1, 2, 4 ... lines; places compare where first lines agree."""
    x = x.select(*KEY, "island", "ln", "id", F.array(F.lit(0).cast("long")).alias("r"))
    where, h = W.partitionBy(*KEY, "island").orderBy("ln"), 1
    while 2 * h <= longest:
        last = F.element_at("r", -1)
        x = x.withColumn("p", last).withColumn("id2", F.lead("id", h).over(where)).withColumn("p2", F.coalesce(F.lead(last, h).over(where), F.lit(-1).cast("long")))
        pairs = x.groupBy("id", "p", "id2", "p2").agg(F.count("*").alias("n"))
        names = {c: f"_{c}" for c in ("id", "p", "id2", "p2")}
        placed = before(pairs, list(names), F.col("n")).drop("n").withColumnsRenamed(names)
        same = (F.col("id") == F.col("_id")) & (F.col("p") == F.col("_p")) & F.col("id2").eqNullSafe(F.col("_id2")) & (F.col("p2") == F.col("_p2"))
        x = keep(x.join(placed, same).select(*KEY, "island", "ln", "id", F.concat("r", F.array("_r")).alias("r")))
        h *= 2
    return x


def suffix_array(ranked: DataFrame) -> DataFrame:
    """The suffixes in order: by first line, then rank; those that agree as far as ranks go, by position."""
    x = ranked.select("id", F.element_at("r", -1).alias("last"), *KEY, "island", "ln")
    return before(x, ["id", "last", *KEY, "ln"], F.lit(1).cast("long")).withColumnRenamed("_r", "place").drop("last")


def intervals(x: DataFrame, min_words: int) -> DataFrame:
    """(d, t, b, m, i1, p1, i2, p2): the shortest runs with their interval; runs of one m and one interval are equal line by line."""
    runs = keep(windows(x, min_words))
    ranked = suffix_ranks(x, runs.agg(F.max("m")).first()[0] or 0)
    k = F.floor(F.log2("m") + 1e-9).cast("int")
    at = lambda n, i, r: ranked.select(*KEY, F.col("ln").alias(n), F.col("id").alias(i), F.col("r").alias(r))
    runs = runs.withColumn("k", k).withColumn("b2", (F.col("b") + F.col("m") - F.pow(F.lit(2), F.col("k"))).cast("int"))
    runs = runs.join(at("b", "i1", "r1"), [*KEY, "b"]).join(at("b2", "i2", "r2"), [*KEY, "b2"])
    return runs.select(*KEY, "b", "m", "i1", F.get("r1", "k").alias("p1"), "i2", F.get("r2", "k").alias("p2"))


def deletions(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(d, t, gone): the stretches of lines (b, e) to delete of each document that repeats an earlier run, apart and in order."""
    runs = keep(intervals(islands(docs, min_words), min_words))
    interval, here = ["m", "i1", "p1", "i2", "p2"], F.struct("d", "t", "b")
    first = keep(runs.groupBy(*interval).agg(F.min(here).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    later = join_groups(runs, first, interval).filter(F.col("first") < here)
    # Runs overlap, so their union is taken by their ends, not line by line.
    doc = W.partitionBy(*KEY).orderBy("b", "e")
    ends = later.select(*KEY, "b", (F.col("b") + F.col("m") - 1).alias("e"))
    reach = F.max("e").over(doc.rowsBetween(W.unboundedPreceding, -1))
    ends = ends.withColumn("begins", F.coalesce(F.col("b") > reach + 1, F.lit(True))).withColumn("part", F.sum(F.col("begins").cast("int")).over(doc))
    parts = ends.groupBy(*KEY, "part").agg(F.min("b").alias("b"), F.max("e").alias("e"))
    return parts.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("b", "e"))).alias("gone"))


def deduplicate(docs: DataFrame, min_words: int = 50, keep_empty: bool = True) -> DataFrame:
    """The documents without later copies of repeated runs, with n_lines and n_removed."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = deletions(docs, min_words)
    x = keyed(docs.select(named(own))).join(gone, KEY, "left")
    rows = F.split("text", "\n", -1)
    # What stays are the slices between deleted lines: (first line, how many).
    starts, ends = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["e"] + 1)), F.concat(F.transform("gone", lambda g: g["b"]), F.array(F.size(rows)))
    stays = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), (e - s).alias("n"))), lambda v: v["n"] > 0)
    sliced = F.transform(F.array(rows), lambda own: F.flatten(F.transform(stays, lambda v: F.slice(own, v["s"] + 1, v["n"]))))  # splits the text once
    left = F.array_join(F.get(sliced, 0), "\n")
    x = x.withColumn("n_lines", F.coalesce(F.size(rows), F.lit(0)).cast("long")).withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left))
    x = x.withColumn("n_removed", F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda n, g: n + g["e"] - g["b"] + 1), F.lit(0)).cast("long"))
    if not keep_empty:
        x = x.filter(F.col("gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return x.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in own], "n_lines", "n_removed")
