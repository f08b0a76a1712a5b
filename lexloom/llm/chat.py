"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a JSON value or a row of typed columns, of some layout: a message list, a
prompt and its completion, an instruction with input and output, or one row a turn.
Its nested field paths, without values, are hashed; the hash selects one of the
declared mappings, which turns the record into canonical turns (order, role, text).
A column that is null in a row is absent from that row's layout, so sources of
different layouts may share one table. Records whose fingerprint no mapping declares,
and JSON that cannot be read, keep a null layout and null turns: ``rejects`` returns
them, nothing is guessed and nothing dropped. Typed columns are read as they are and
never pass through JSON, so texts have no size limit but Spark's own.

The template writes a turn as ``<|turn|>role``, a line break, the text, ``<|end|>``
and a line break. In roles and texts, a backslash becomes ``\\e`` and ``<|`` becomes
``<\\p`` (a line break in a role ``\\n``), so no text can hold a marker, and the
replacements undo exactly. The loss mask lists the spans of assistant texts: turn,
start and length in code points of what the output holds between two end markers.

Defined results: null texts are empty, null roles are empty roles (without loss);
turns sort by (turn, role, text), null turns first; a conversation is one row, so a
conversation's turns meet in one row by nature, while conversations spread over
tasks; repeated rows are repeated turns; an empty table gives no rows; columns that
are not fields of a turn are dropped before anything is hashed.
"""

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, END = "<|turn|>", "<|end|>\n"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"
SCALAR = r": (?!OBJECT|ARRAY)[A-Z0-9(), ]*?(?=[,>]|$)"


def one(role: Column | str, text: Column, turn: Column | int = 0) -> Column:
    role = F.lit(role) if isinstance(role, str) else F.coalesce(role, F.lit(""))
    turn = F.lit(turn).cast("bigint") if isinstance(turn, int) else turn
    return F.struct(turn.alias("turn"), role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


class Json:
    """Fields of the variant column ``_v``."""

    def __call__(self, name: str, kind: str = "string") -> Column:
        return F.try_variant_get(F.col("_v"), f"$.{name}", kind)

    def items(self, name: str, role: str, text: str) -> Column:
        return F.from_json(self(name), f"array<struct<`{role}`:string,`{text}`:string>>")


class Typed:
    """Fields of typed columns; those that a frame lacks are null."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def __call__(self, name: str, kind: str = "string") -> Column:
        return (F.col(name) if name in self.schema.names else F.lit(None)).cast(kind)

    def items(self, name: str, role: str, text: str) -> Column:
        has = name in self.schema.names and shape(self.schema[name].dataType) == shape(T._parse_datatype_string(f"array<struct<`{role}`:string,`{text}`:string>>"))
        return F.col(name) if has else F.lit(None).cast(f"array<struct<`{role}`:string,`{text}`:string>>")


def listed(items: Column, role: str, text: str, names: dict[str, str]) -> Column:
    """Turns of a message list, its roles renamed."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform(items, lambda m, i: one(F.coalesce(F.element_at(pairs, m[role]), m[role]), m[text].cast("string"), i.cast("bigint")))


# How sources name the speakers.
SAME = {"user": "user", "assistant": "assistant", "system": "system"}
SHARE = {"human": "user", "gpt": "assistant", "system": "system"}
# Layouts by their fields, fields that may be absent, and how their turns are read.
LISTS = {"messages": ("role", "content", SAME), "conversations": ("from", "value", SHARE)}
PAIRS = {"prompt": ("prompt", "completion"), "question": ("question", "answer"), "instruction": ("instruction", "output")}
ROWS = {"row": ("role", "text", SAME), "share_row": ("from", "value", SHARE)}


def layouts() -> dict:
    """Per fingerprinted shape: the mapping's name and its reader."""
    out = {}
    for name, (role, text, names) in LISTS.items():
        out[f"OBJECT<{name}: ARRAY<OBJECT<{', '.join(sorted((role, text)))}>>>"] = (name, lambda f, n=name, r=role, t=text, m=names: listed(f.items(n, r, t), r, t, m))
    for name, (asked, said) in PAIRS.items():
        out[f"OBJECT<{', '.join(sorted((asked, said)))}>"] = (name, lambda f, a=asked, s=said: F.array(one("user", f(a), 0), one("assistant", f(s), 1)))
    both = lambda f: F.concat_ws("\n\n", f("instruction"), F.nullif(f("input"), F.lit("")))
    out["OBJECT<input, instruction, output>"] = ("instruction_input", lambda f: F.array(one("user", both(f), 0), one("assistant", f("output"), 1)))
    for name, (role, text, names) in ROWS.items():  # one row a turn, any of its fields may be absent
        pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        who = lambda f, r=role, p=pairs: F.coalesce(F.element_at(p, f(r)), f(r))
        fields = sorted((role, text, "turn"))
        for some in (c for n in range(len(fields), -1, -1) for c in combinations(fields, n)):
            out.setdefault(f"OBJECT<{', '.join(some)}>", (name, lambda f, w=who, t=text: F.array(one(w(f), f(t), f("turn", "bigint")))))
    return out


def shape(kind: T.DataType) -> str:
    """Nested field paths of a type, in the notation of ``schema_of_variant`` without scalar types."""
    if isinstance(kind, T.StructType):
        inner = [(f.name, shape(f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        return f"OBJECT<{', '.join(n + (': ' + s if s else '') for n, s in inner)}>"
    return f"ARRAY<{shape(kind.elementType) or 'SCALAR'}>" if isinstance(kind, T.ArrayType) else ""


def paths(record: Column) -> Column:
    """The field paths of a JSON record."""
    return F.regexp_replace(F.schema_of_variant(F.parse_json(record)), SCALAR, "")


def present(schema: T.StructType) -> Column:
    """The field paths of a row of typed columns: those that are not null."""
    parts = [(f.name, shape(f.dataType)) for f in sorted(schema.fields, key=lambda f: f.name)]
    named = [F.when(F.col(n).isNotNull(), n + (f": {s}" if s else "")) for n, s in parts]
    return F.concat(F.lit("OBJECT<"), F.concat_ws(", ", *named), F.lit(">"))


def mapped(x: DataFrame, fields: Json | Typed, mappings: dict) -> DataFrame:
    """Adds layout and turns, selected by the column ``fingerprint``."""
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for paths_, (name, read) in mappings.items():
        is_it = F.col("fingerprint") == F.xxhash64(F.lit(paths_))
        layout, turns = F.when(is_it, name).otherwise(layout), F.when(is_it, read(fields).cast(TURNS)).otherwise(turns)
    return x.withColumn("layout", layout).withColumn("turns", turns)


def canonical(records: DataFrame, record: str = "record", mappings: dict | None = None) -> DataFrame:
    """Adds fingerprint, layout (null: unknown or not JSON) and turns of JSON records."""
    x = records.withColumn("_v", F.try_parse_json(record))
    x = x.withColumn("fingerprint", F.when(F.col("_v").isNotNull(), F.xxhash64(F.regexp_replace(F.schema_of_variant("_v"), SCALAR, ""))))
    return mapped(x, Json(), layouts() if mappings is None else mappings).drop("_v")


def canonical_rows(rows: DataFrame, key: str, mappings: dict | None = None) -> DataFrame:
    """(key, fields, fingerprint, layout, turns) of records that are rows of typed columns."""
    own = T.StructType([f for f in rows.schema.fields if f.name != key])
    x = rows.withColumn("fingerprint", F.xxhash64(present(own)))
    return mapped(x, Typed(own), layouts() if mappings is None else mappings)


def rejects(canon: DataFrame) -> DataFrame:
    """Records that no mapping declares."""
    return canon.filter("layout is null")


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\e")), F.lit("<|"), F.lit("<\\p"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\p"), F.lit("<|")), F.lit("\\e"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def formatted(conversations: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds formatted and loss_spans (array of turn, start, length: within the turn's stretch of the formatted text)."""
    head = lambda t: F.concat(F.lit(TURN), escape_role(t["role"]), F.lit("\n"))
    parts = F.transform(turns, lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    x = conversations.withColumn("_p", parts)
    span = lambda p, i: F.when(p["loss"], F.struct(i.alias("turn"), F.length(p["head"]).alias("start"), F.length(p["body"]).alias("length")))
    text = F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return x.withColumn("formatted", text).withColumn("loss_spans", F.filter(F.transform("_p", span), lambda s: s.isNotNull())).drop("_p")


def stretches(formatted: str | Column) -> Column:
    """What lies between the end markers of a formatted text, a turn each."""
    return F.split(formatted, r"<\|end\|>\n", -1)


def read_back(c: str = "formatted") -> Column:
    """The turns that a formatted text holds: array of role, text."""
    turns = F.filter(stretches(c), lambda s: s != "")
    head = lambda s: F.substring_index(s, "\n", 1)
    role = lambda s: unescape_role(F.replace(head(s), F.lit(TURN), F.lit("")))
    body = lambda s: unescape(F.substring(s, F.length(head(s)) + 2, F.length(s)))
    return F.transform(turns, lambda s: F.struct(role(s).alias("role"), body(s).alias("text")))


def loss_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask; the formatted text is cut once, so the work grows with its length."""
    under = lambda parts: F.transform(spans, lambda s: unescape(F.substring(F.get(parts, s["turn"]), s["start"] + 1, s["length"])))
    return F.array_join(F.flatten(F.transform(F.array(stretches(formatted)), under)), "")


def conversations(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Formatted conversations of a table of rows, whose layouts their fingerprints tell; see ``rejects`` for unknown ones."""
    each = canonical_rows(rows, key).filter("layout is not null").select(key, F.explode("turns").alias("t"))
    grouped = each.groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return formatted(grouped)
