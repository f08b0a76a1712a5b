"""Text as Column expressions: cleaning, previews, labels, keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)[\s\x1c-\x1f]+"


def clean_text(c: Column) -> Column:
    """White space runs to one blank, ends trimmed, en and em dashes to hyphens."""
    return F.translate(F.trim(F.regexp_replace(c, WHITE, " ")), "–—", "--")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalise_slice(c: Column) -> Column:
    """At most one empty line in a row; blanks and tabs inside each line collapse."""
    c = F.regexp_replace(strip(c), r"\n{3,}", "\n\n")
    return strip(F.array_join(F.transform(F.split(c, "\n", -1), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " "))), "\n"))


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def words(c: Column) -> Column:
    return F.filter(F.split(c, WHITE), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def truncate_words(c: Column, n: int) -> Column:
    w = words(c)
    return F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, F.lit(" …")).otherwise(F.lit("")))


def line_count(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, "\n", -1))).cast("long")


def has_text(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def contains_ci(needle: str, *cols: Column) -> Column:
    """Any of the columns contains the needle whatever the case; wildcards are literal."""
    found = F.lit(False)
    for c in cols:
        found = found | F.coalesce(F.contains(F.upper(c), F.upper(F.lit(needle))), F.lit(False))
    return found


def norm_label(tipo: Column, numero: Column, ano: Column) -> Column:
    return F.concat(tipo, F.lit(" "), numero, F.lit("/"), ano.cast("string"))


def clause_label(tipo: Column, numero: Column) -> Column:
    head = (
        F.when(tipo == "artigo", "Art.").when(tipo == "paragrafo", "§").when(tipo == "inciso", "Inciso")
        .when(tipo == "alinea", "Alínea").otherwise(F.initcap(tipo))
    )
    return F.concat(head, F.lit(" "), numero)


# Display names of actions.
ACTION_NAMES = {
    "REVOGA": "Revogação", "ALTERA": "Alteração", "ADICIONA": "Adição", "SUBSTITUI": "Substituição",
    "REGULAMENTA": "Regulamentação", "REFERENCIA": "Referência",
}
# Badge colours of statuses; others are grey.
STATUS_COLOURS = {"consolidated": "green", "failed": "red", "pending": "gray", "segmented": "blue", "entities_extracted": "purple"}


def lookup(c: Column, names: dict[str, str], default: Column) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), default)


def action_name(acao: Column) -> Column:
    return lookup(acao, ACTION_NAMES, acao)


def counted(n: Column, one: str, many: str) -> Column:
    """A number with the noun form that it asks for."""
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def cache_key(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(c.cast("binary")))


def slug(ident: Column, salt: str = "chat") -> Column:
    """Twelve hex characters that only the id and the salt decide."""
    return F.substring(F.sha2(F.concat(ident.cast("string"), F.lit(salt)), 256), 1, 12)


ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def wide_slug(ident: Column, salt: str, length: int) -> Column:
    """As ``slug``, of letters of both cases and digits, 16 of them at most: each from four hex characters of the hash."""
    h = F.sha2(F.concat(ident.cast("string"), F.lit(salt)), 256)
    digit = lambda i: (F.conv(F.substring(h, 4 * i + 1, 4), 16, 10).cast("int") % len(ALPHABET) + 1).cast("int")
    return F.concat(*[F.substring(F.lit(ALPHABET), digit(i), F.lit(1)) for i in range(length)])


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def repair_lists(c: Column) -> Column:
    """Puts bullets of a generated answer on lines of their own."""
    # Rewrites, in order.
    for pattern, put in (
        (r"([•\-])\s+([^•\n]+?);\s+([•\-])", "$1 $2\n$3"),
        (r"([•\-])\s+([^•\n]+?)\s+([•\-])\s+", "$1 $2\n$3 "),
        (r";\s+([•\-])", "\n$1"),
        (r"([^\n])([•\-])\s+", "$1\n$2 "),
        (r"\n{3,}", "\n\n"),
    ):
        c = F.regexp_replace(c, pattern, put)
    return c


def normal_reference(tipo: Column, numero: Column) -> tuple[Column, Column]:
    """Canonical kind and a number without separators, for the lenient resolver."""
    # Spelled-out kinds.
    kinds = {"lei": "Lei", "lc": "Lei Complementar", "lei complementar": "Lei Complementar", "decreto": "Decreto", "resolução": "Resolução", "resoluçao": "Resolução"}
    return lookup(F.lower(tipo), kinds, tipo), F.translate(numero, ".,", "")
