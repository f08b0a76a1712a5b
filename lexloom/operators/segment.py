"""Legal text to a clause tree: marker scan, slices, parents. All in the JVM, inside the row of a text.

A text is cut at line starts that a marker could open; every pattern is matched once against
the stretch that follows, with the few stretches after it that a marker may reach into. What leaves
the row are positions, numbers and slices, so a text's size counts once, however many markers it has.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.functions.patterns import MARKERS
from lexloom.functions.text import clean_text

REACH = 4  # stretches that open with a word, a number, a dash and what follows
BEFORE = 5  # stretches of two characters or more, ten in all


def opens(x: Column) -> dict[str, Column]:
    """Which kind a stretch may open, by its first characters; the first that holds is meant. Digits may be of any script."""
    first, three = F.substring(x, 1, 1), F.upper(F.substring(x, 1, 3))
    return {
        "artigo": three == "ART", "paragrafo": first == "§", "paragrafo_unico": three == "PAR", "inciso": first.isin("I", "V", "X"),
        "alinea": F.substring(x, 2, 1) == ")", "item": first.between("0", "9") | ~first.between(" ", "~"),
    }


def markers(stretches: Column) -> Column:
    """Markers of a text cut into stretches: array of i (stretch), kind, marker, numero."""

    def one(x: Column, i: Column) -> Column:
        rest = F.array_join(F.slice(stretches, i + 1, REACH), "\n")
        hit = F.lit(None).cast("struct<kind:string,marker:string,numero:string>")
        for kind, may in reversed(opens(x).items()):
            p = MARKERS[kind]
            hit = F.when(may, F.struct(F.lit(kind).alias("kind"), F.regexp_extract(rest, p, 0).alias("marker"), F.regexp_extract(rest, p, 1).alias("numero"))).otherwise(hit)
        return F.struct(i.alias("i"), hit.alias("m"))

    return F.filter(F.transform(stretches, one), lambda x: F.coalesce(x["m"]["marker"] != "", F.lit(False)))


def scanned(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _s, _f) of every text: its stretches, its markers."""
    x = texts.select(key, F.split(F.coalesce(F.col(text), F.lit("")), r"\n(?=\S)", -1).alias("_s"))
    return x.withColumn("_f", markers(F.col("_s")))


def marker_scan(texts: DataFrame, key: str = "norma_id", text: str = "raw_text") -> DataFrame:
    """Rows (key, pos, kind, numero, marker, marker_end, texto, slice_end, end_pos, dated) of every marker that opens a line.

    ``texto`` reaches from the marker's end to the next marker, whatever its kind, and is never negative; ``end_pos`` is
    the marker's end plus the length of ``texto``, which is shorter than the slice where cleaning took something out;
    ``dated`` says that the ten characters before an incise look like a date.
    """
    size = F.size("_s")

    def row(f: Column, k: Column) -> Column:
        after = F.coalesce(F.get(F.col("_f"), k + 1)["i"], size)
        slice_ = F.array_join(F.slice("_s", f["i"] + 1, after - f["i"]), "\n")
        before = F.array_join(F.slice("_s", F.greatest(f["i"] - BEFORE, F.lit(0)) + 1, F.least(f["i"], F.lit(BEFORE))), "\n")
        return F.struct(
            f["m"]["kind"].alias("kind"), f["m"]["marker"].alias("marker"), f["m"]["numero"].alias("numero"), slice_.alias("slice"), F.when(after < size, 1).otherwise(0).alias("more"),
            # What stands before the first marker; before the others, the slices of those that precede.
            F.when((k == 0) & (f["i"] > 0), F.length(F.array_join(F.slice("_s", 1, f["i"]), "\n")) + 1).otherwise(0).alias("lead"),
            F.when((f["m"]["kind"] == "inciso") & (f["i"] > 0), F.right(F.concat(before, F.lit("\n")), F.lit(10))).alias("before"),
        )

    x = scanned(texts, key, text).select(key, F.posexplode(F.transform("_f", row)).alias("n", "r")).select(key, "n", "r.*")
    x = x.withColumn("width", F.length("slice") + F.col("more"))
    w = W.partitionBy(key).orderBy("n")
    past = F.coalesce(F.sum("width").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("pos", (past + F.max("lead").over(w.rowsBetween(W.unboundedPreceding, 0))).cast("long"))
    x = x.withColumn("texto", clean_text(F.substring(F.col("slice"), F.length("marker") + 1, F.length("slice"))))
    x = x.withColumn("marker_end", F.col("pos") + F.length("marker")).withColumn("slice_end", F.col("pos") + F.col("width"))
    x = x.withColumn("end_pos", F.col("marker_end") + F.length("texto")).withColumn("dated", F.coalesce(F.col("before").rlike(r"\d{4}|\d{1,2}/\d{1,2}"), F.lit(False)))
    return x.select(key, "pos", "kind", "numero", "marker", "marker_end", "texto", "slice_end", "end_pos", "dated")


def date_guard(found: DataFrame) -> DataFrame:
    """Drops an incise whose ten characters before look like a date; it has already cut the text before it."""
    return found.filter((F.col("kind") != "inciso") | ~F.col("dated"))


def parent_index(kind: Column, index: Column, w) -> Column:
    """Index of the parent: the last article, paragraph or incise still open."""
    past = w.rowsBetween(W.unboundedPreceding, -1)
    last = lambda k: F.last(F.when(kind == k, index), ignorenulls=True).over(past)
    a, p, i = last("artigo"), last("paragrafo"), last("inciso")
    none = F.lit(-1).cast("long")
    p_open = F.coalesce(p, none) > F.coalesce(a, none)
    i_open = F.coalesce(i, none) > F.greatest(F.coalesce(a, none), F.coalesce(p, none))
    above = F.when(p_open, p).otherwise(a)
    return F.when(kind == "paragrafo", a).when(kind == "inciso", above).when(kind == "alinea", F.when(i_open, i).otherwise(above))


def segment(texts: DataFrame, key: str = "norma_id", text: str = "raw_text") -> DataFrame:
    """Clauses (key, ordem, tipo, numero, texto, end_pos, parent_ordem) of every text."""
    kept = date_guard(marker_scan(texts, key, text)).filter(F.col("kind") != "item")
    by = W.partitionBy(key).orderBy("pos")
    kept = kept.withColumn("tipo", F.when(F.col("kind") == "paragrafo_unico", "paragrafo").otherwise(F.col("kind")))
    kept = kept.withColumn("numero", F.when(F.col("kind") == "paragrafo_unico", "único").otherwise(F.col("numero")))
    kept = kept.withColumn("ordem", (F.row_number().over(by) - 1).cast("long"))
    kept = kept.withColumn("parent_ordem", parent_index(F.col("tipo"), F.col("ordem"), by))
    return kept.select(key, "ordem", "tipo", "numero", "texto", "end_pos", "parent_ordem")
