"""Lists, pages, facets and details of norms."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.functions.text import clause_label, contains_ci, has_text, norm_label
from lexloom.schema import clamp_page


def search(norms: DataFrame, q: str | None = None, status: str | None = None, statuses: list[str] | None = None) -> DataFrame:
    if status:
        norms = norms.filter(F.col("status") == status)
    if statuses:
        norms = norms.filter(F.col("status").isin(statuses))
    return norms.filter(contains_ci(q, F.col("ementa"), F.col("numero"), F.col("tipo"))) if q else norms


def card(norms: DataFrame) -> DataFrame:
    summary = F.when(has_text(F.col("ementa")), F.substring("ementa", 1, 200))
    return norms.select("id", "tipo", "numero", F.col("ano").cast("long").alias("ano"), summary.alias("ementa"), "status", F.date_format("data_publicacao", "yyyy-MM-dd").alias("published"), F.concat(F.lit("/normas/"), F.col("id").cast("string"), F.lit("/")).alias("url"))


# The default order of lists; the id makes it total.
DEFAULT = [("ano", True), ("numero", True), ("id", False)]


def sort_columns(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc() if down else F.col(c).asc() for c, down in order]


def default_order(norms: DataFrame) -> DataFrame:
    return norms.orderBy(*sort_columns(DEFAULT))


def precedes(order: list[tuple[str, bool]], key: tuple) -> Column:
    """Whether a row stands before a key in an order of (column, descending); nulls are the least."""
    before, same = F.lit(False), F.lit(True)
    for (c, down), v in zip(order, key):
        col, value = F.col(c), F.lit(v)
        if v is None:
            less = col.isNotNull() if down else F.lit(False)
        else:
            less = F.coalesce(col > value, F.lit(False)) if down else F.coalesce(col < value, F.lit(True))
        before, same = before | (same & less), same & col.eqNullSafe(value)
    return before


def slice_of(rows: DataFrame, order: list[tuple[str, bool]], offset: int, size: int, n: int | None = None, most: int = 200_000, fan: int = 128) -> DataFrame:
    """``size`` rows from ``offset`` on in a total order, however deep, without sorting what comes before.

    Keys sampled by hash (some 30 for each of ``fan`` ranges) cut the order; one scan counts the ranges; only those that
    the slice touches are looked at further, cut again while they hold more than ``most`` rows, and sorted.
    """
    n, columns = rows.count() if n is None else n, [c for c, _ in order]
    while n > most:
        share = min(1.0, 30 * fan / n) * (1 << 30)
        keys = [tuple(r) for r in rows.filter(F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < share).select(*columns).collect()]
        for i, (_, down) in reversed(list(enumerate(order))):
            keys.sort(key=lambda k: (k[i] is not None, k[i]), reverse=down)  # noqa: B023
        cuts = list(dict.fromkeys(keys[len(keys) * i // fan] for i in range(1, fan) if keys))
        if not cuts:
            break
        number = halving(order, cuts, 0, len(cuts))
        counts = {r["_r"]: r["count"] for r in rows.select(number.alias("_r")).groupBy("_r").count().collect()}
        ends, total = [], 0
        for i in range(len(cuts) + 1):
            total += counts.get(i, 0)
            ends.append(total)
        first = next((i for i, e in enumerate(ends) if e > offset), len(cuts))
        last = next((i for i, e in enumerate(ends) if e >= offset + size), len(cuts))
        before = ends[first - 1] if first else 0
        if ends[last] - before == n:
            break  # the slice touches all ranges
        if first:
            rows = rows.filter(~precedes(order, cuts[first - 1]))
        if last < len(cuts):
            rows = rows.filter(precedes(order, cuts[last]))
        offset, n = offset - before, ends[last] - before
    return rows.orderBy(*sort_columns(order)).offset(offset).limit(size)


def halving(order: list[tuple[str, bool]], cuts: list[tuple], lo: int, hi: int) -> Column:
    """The number of cuts from ``lo`` on that a row does not precede: a tree of comparisons, of which a row passes one branch."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(precedes(order, cuts[mid]), halving(order, cuts, lo, mid)).otherwise(halving(order, cuts, mid + 1, hi))


def page(rows: DataFrame, number: int | None = 1, size: int | None = 20, most: int = 200_000) -> DataFrame:
    """One page in default order, each row with total, n_pages, has_next, has_prev.

    A page beyond the last shows the last. Deep pages are found by ``slice_of``.
    """
    number, size = clamp_page(number, size)
    n = rows.count()
    pages = max(1, -(-n // size))
    number = min(number, pages)
    got = default_order(slice_of(rows, DEFAULT, (number - 1) * size, size, n, most))
    return card(got).withColumns({"total": F.lit(n).cast("long"), "n_pages": F.lit(pages).cast("long"), "has_next": F.lit(number < pages), "has_prev": F.lit(number > 1)})


def status_histogram(norms: DataFrame) -> DataFrame:
    return norms.groupBy("status").agg(F.count("*").alias("n_norms")).orderBy("status")


def coverage(clauses: DataFrame) -> DataFrame:
    """How many clauses have a vector; an empty array is none."""
    n, k = F.count("*"), F.count_if(F.coalesce(F.size("embedding") > 0, F.lit(False)))
    return clauses.agg(n.alias("total"), k.alias("with_embedding"), F.coalesce(F.round(100.0 * k / F.nullif(n, F.lit(0)), 1), F.lit(0.0)).alias("percent"))


def with_events(clauses: DataFrame, events: DataFrame) -> DataFrame:
    """(norma_id, n_clauses, n_with_events, n_events): clauses looked at, those that events come from, events."""
    e = events.groupBy(F.col("source_clause_id").alias("id")).agg(F.count("*").alias("_n"))
    x = clauses.select("norma_id", "id").join(e, "id", "left")
    return x.groupBy("norma_id").agg(F.count("*").alias("n_clauses"), F.count("_n").alias("n_with_events"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_events"))


def statistics(norms: DataFrame, clauses: DataFrame, events: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, n_clauses, n_events, n_chars, has_original, has_consolidated) of every norm: events are those it receives, characters those of
    its consolidated text (``texts``: norma_id, text), the original is its file."""
    c = clauses.groupBy(F.col("norma_id").alias("id")).agg(F.count("*").alias("n_clauses"))
    e = events.filter("target_norm_id is not null").groupBy(F.col("target_norm_id").alias("id")).agg(F.count("*").alias("n_events"))
    t = texts.select(F.col("norma_id").alias("id"), F.length("text").cast("long").alias("n_chars"))
    x = norms.select("id", has_text(F.col("pdf_path")).alias("has_original")).join(c, "id", "left").join(e, "id", "left").join(t, "id", "left")
    x = x.fillna(0, ["n_clauses", "n_events", "n_chars"])
    return x.select("id", "n_clauses", "n_events", "n_chars", "has_original", (F.col("n_chars") > 0).alias("has_consolidated"))


def search_fields(df: DataFrame, q: str, *cols: str) -> DataFrame:
    """Rows in which any of the columns holds the text, whatever the case."""
    return df.filter(contains_ci(q, *[F.col(c) for c in cols]))


def facet(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n_rows"))


def date_drill_down(norms: DataFrame) -> DataFrame:
    return norms.rollup(F.year("data_publicacao").cast("long").alias("y"), F.month("data_publicacao").cast("long").alias("m")).agg(F.count("*").alias("n_norms"))


def detail(norms: DataFrame, clauses: DataFrame) -> DataFrame:
    """Norm with its clause list in order and its counts.

    What is sorted by norm is what is shown: a label, a length and whether there is a vector, not the text and the vector. (``has``
    is used twice, so that Spark does not take its source into the aggregation.)
    """
    has = F.col("embedding").isNotNull().alias("has")
    x = clauses.select(F.col("norma_id").alias("id"), "ordem", clause_label(F.col("tipo"), F.col("numero")).alias("label"), F.length("texto").alias("chars"), has)
    c = x.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("ordem", "label", F.col("has").alias("has_embedding")))).alias("clauses"),
        F.count("*").alias("n_clauses"), F.sum("chars").cast("long").alias("n_chars"), F.count_if("has").alias("n_embedded"),
    )
    return norms.withColumn("label", norm_label(F.col("tipo"), F.col("numero"), F.col("ano"))).join(c, "id", "left")


def work_selection(norms: DataFrame, statuses: list[str], offset: int, limit: int, most: int = 200_000) -> DataFrame:
    """So many rows of some statuses from an offset on, by id."""
    return slice_of(norms.filter(F.col("status").isin(statuses)), [("id", False)], offset, limit, most=most)


def without_file(norms: DataFrame) -> DataFrame:
    return norms.filter(~has_text(F.col("pdf_path")) & has_text(F.col("pdf_url")))


def in_vacancy(norms: DataFrame, today: str) -> DataFrame:
    """Published but not yet in force on ``today``."""
    d = F.lit(today).cast("date")
    return norms.filter((F.col("data_publicacao") <= d) & (d < F.col("data_vigencia")))


def mini_batches(rows: DataFrame, size: int, order: str = "id", rows_per_range: int = 200_000, most_ranges: int = 10_000) -> DataFrame:
    """Adds batch: rows in order (distinct longs), ``size`` a batch, without a single-task window.

    Rows are numbered inside ranges that quantiles of a sample bound, so ranges stay even however the key is
    spread; range totals, one row a range, give where each starts.
    """
    n = rows.count()
    parts = max(1, min(most_ranges, n // rows_per_range))
    cuts = []
    if parts > 1:
        share = min(1.0, 50 * parts / n) * (1 << 30)
        some = sorted(r[0] for r in rows.filter(F.pmod(F.xxhash64(order), F.lit(1 << 30)) < share).select(order).collect())
        cuts = sorted({some[len(some) * i // parts] for i in range(1, parts)}) if some else []
    x = rows.withColumn("_p", range_number(cuts)(F.col(order)) if cuts else F.lit(0))
    counts = x.groupBy("_p").count()
    before = F.coalesce(F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_p", before.alias("_b")))
    x = x.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(order))).join(starts, "_p")
    return x.withColumn("batch", F.floor((F.col("_b") + F.col("_i") - 1) / size).cast("long")).drop("_p", "_i", "_b")


def range_number(cuts: list[int]):
    """How many of the sorted cuts are below a value."""
    import numpy as np
    import pandas as pd

    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def number(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, v.to_numpy(), "left").astype("int32"))

    return number
