"""Alteration events in clause texts: actions with offsets, references near them."""

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.patterns import ACTIONS, ELEMENTS, HINTS, INITIALS, LAW, SELF, SIGNS, STEMS
from lexloom.functions.text import strip


def any_of(patterns) -> str:
    """One pattern for texts that any of some patterns of whole words is in, so that a place inside a word is passed over at
    once; each match is one of theirs, since they never overlap."""
    inner = [p.removeprefix("(?iuU)\\b").removesuffix("\\b") for p in patterns]
    return f"(?iuU)\\b(?:{'|'.join(inner)})\\b"


MARK = "\x01"


def matches(text: Column, pattern: str) -> Column:
    """All matches with their offsets, in order: array<struct<start, hit>>, in one pass over the text, which puts a mark on
    either side of each match; one fold adds up the lengths. A text that holds the mark itself is searched twice."""
    none = F.array().cast("array<struct<start:int,hit:string>>")

    def add(found, start, hit):
        return F.concat(found, F.array(F.struct(start.alias("start"), hit.alias("hit"))))

    def part(s, x):
        return F.struct((s["at"] + F.length(x)).alias("at"), (~s["is_hit"]).alias("is_hit"), F.when(s["is_hit"], add(s["found"], s["at"], x)).otherwise(s["found"]).alias("found"))

    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    once = F.aggregate(marked, F.struct(F.lit(0).alias("at"), F.lit(False).alias("is_hit"), none.alias("found")), part)["found"]

    def pair(s, x):
        start = s["at"] + x["gap"]
        return F.struct((start + F.length(x["hit"])).alias("at"), add(s["found"], start, x["hit"]).alias("found"))

    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    twice = F.aggregate(F.filter(both, lambda x: x["hit"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("found")), pair)["found"]
    return F.when(F.contains(text, F.lit(MARK)), twice).otherwise(once)


def action_mentions(clauses: DataFrame, text: str = "texto") -> DataFrame:
    """One row per action match, all actions: adds acao, start, hit. Texts without the sign of any are passed over unsearched."""
    upper = F.array(F.translate(F.upper(text), "\u0130", "I"))  # as the one element of an array it is found once for all signs
    x = clauses.filter(F.exists(upper, lambda u: reduce(or_, [F.contains(u, F.lit(s)) for s in SIGNS])))
    x = x.withColumn("_m", F.explode(matches(F.col(text), any_of(ACTIONS.values())))).select("*", "_m.*").drop("_m")
    return x.withColumn("acao", action_of(F.upper("hit"))).select(*clauses.columns, "acao", "start", "hit")


def action_of(hit: Column) -> Column:
    """The action whose pattern an upper-cased match is of, told by the stem it holds; the last action takes the rest."""
    name = F.lit(list(ACTIONS)[-1])
    for acao, stems in reversed(STEMS.items()):
        has = [F.contains(hit, F.lit(s)) for s in stems]
        name = F.when(reduce(or_, has), acao).otherwise(name)
    return name


def reference(tipo, numero, hit, confidence, law_tipo=None, law_numero=None, law_ano=None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return F.struct(
        tipo.alias("ref_tipo"), numero.alias("ref_numero"), hit.alias("ref_text"), confidence.alias("confidence"),
        text(law_tipo).alias("law_tipo"), text(law_numero).alias("law_numero"), text(law_ano).alias("law_ano"),
    )


def alone(pattern: str) -> str:
    """The pattern for one of its matches without what surrounds it: the groups are those that it had there, the word
    boundary before it, which may be another character's, is not asked for again."""
    return "(?iuU)^" + pattern.removeprefix("(?iuU)\\b")


def at_initial(pattern: str, letters: str) -> str:
    """The pattern, which asks for its first character before it asks for the dearer word boundary."""
    return pattern.replace("(?iuU)\\b", f"(?iuU)(?=[{letters}])\\b", 1)


def references(context: Column, upper: Column) -> Column:
    """References within a context, kind by kind, as an array of structs. A kind is searched for only where the upper-cased
    context holds one of its hints."""
    none = F.array().cast("array<string>")

    def hits(kind, pattern):
        may = reduce(or_, [F.contains(upper, F.lit(h)) for h in HINTS[kind]])
        return F.when(may, F.regexp_extract_all(context, F.lit(at_initial(pattern, INITIALS[kind])), F.lit(0))).otherwise(none)

    def groups(h):
        kind, n, y = (F.regexp_extract(h, alone(LAW), g) for g in (1, 2, 3))
        return F.struct(h.alias("h"), F.trim(kind).alias("kind"), n.alias("n"), y.alias("y"))

    def law(x):  # of groups that are found once, however often they are named here
        h, kind, n, y = (x[c] for c in ("h", "kind", "n", "y"))
        dated = y != ""
        number = F.when(dated, F.concat(n, F.lit("/"), y)).otherwise(n)
        return reference(F.lower(kind), number, h, F.when(dated, 0.9).otherwise(0.7), F.when(dated, kind), F.when(dated, n), F.when(dated, y))

    found = [F.transform(F.transform(hits("law", LAW), groups), law), F.transform(hits("self", SELF), lambda h: reference(F.lit("self_reference"), F.lit(""), h, F.lit(0.95)))]

    def element(name, pattern, g):
        return lambda h: reference(F.lit(name), F.trim(F.regexp_extract(h, alone(pattern), g)), h, F.lit(0.9))

    return F.concat(*found, *[F.transform(hits(name, pattern), element(name, pattern, g)) for name, pattern, g in ELEMENTS])


def events(clauses: DataFrame, text: str = "texto", reach: int = 200, least: int = 20) -> DataFrame:
    """Actions times the references that follow within ``reach`` characters; an action
    without any keeps the start of its context as target. Texts under ``least`` characters are skipped."""
    plain = reduce(and_, [F.ascii(F.substring(text, i, 1)).between(33, 126) for i in (1, -1)])  # nothing to strip
    n = F.when(plain, F.length(text)).otherwise(F.length(strip(F.col(text))))
    acts = action_mentions(clauses.filter(n >= least), text)
    acts = acts.withColumn("context", F.expr(f"substring({text}, start + 1, length(hit) + {reach})"))
    rows = acts.withColumn("_u", F.upper("context")).withColumn("r", F.explode_outer(references(F.col("context"), F.col("_u")))).select("*", "r.*").drop("r", "_u")
    alone = F.col("ref_tipo").isNull()
    return (
        rows.withColumn("target_text", F.substring(F.when(alone, F.substring("context", 1, 100)).otherwise(F.col("ref_text")), 1, 500))
        .withColumn("confidence", F.when(alone, 0.5).otherwise(F.col("confidence")))
        .withColumn("ref_tipo", F.coalesce("ref_tipo", F.lit("")))
        .withColumn("ref_numero", F.coalesce("ref_numero", F.lit("")))
        .drop("context", "ref_text")
    )
