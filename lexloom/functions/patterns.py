"""Regular expressions of the domain, in Java syntax. All are fixed values."""

NUMBER = r"(\d+[ºª°]?(?:-[A-Z])?)"
TRAILER = r"\s*[.–-]?\s*"

# Marker kinds, matched at the start of what is left of a text.
MARKERS = {
    "artigo": rf"(?iuU)\AArt\.?\s+{NUMBER}{TRAILER}",
    "paragrafo": rf"(?U)\A§\s*{NUMBER}{TRAILER}",
    "paragrafo_unico": rf"(?iuU)\AParágrafo\s+(único)\.?{TRAILER}",
    "inciso": rf"(?U)\A([IVX]+){TRAILER}",
    "alinea": r"(?U)\A([a-z])\)\s+",
    "item": r"(?U)\A(\d+)\.\s+",
}

ACTIONS = {
    "REVOGA": r"(?iuU)\b(revog[a-z]+|ficam?\s+revogad[oa]s?)\b",
    "ALTERA": r"(?iuU)\b(alter[a-z]+|modific[a-z]+|ficam?\s+alterad[oa]s?)\b",
    "ADICIONA": r"(?iuU)\b(adicion[a-z]+|acrescen[a-z]+|inclui|ficam?\s+adicionad[oa]s?)\b",
    "SUBSTITUI": r"(?iuU)\b(substitu[íi][a-z]*|ficam?\s+substitu[íi]d[oa]s?)\b",
    "REGULAMENTA": r"(?iuU)\b(regulamenta[a-z]*|disciplina[a-z]*)\b",
    "REFERENCIA": r"(?iuU)\b(conforme|nos\s+termos|de\s+acordo\s+com|previsto|disposto)\b",
}

LAW = r"(?iuU)\b(lei\s+(?:complementar|ordinária|delegada)?|lc|decreto|resolução)\s*(?:n[º°]?\s*)?([\d.,]+)\s*[/\-]?\s*(\d{4})?"
SELF = r"(?iuU)\b(d[aeo]st[ae]|d[aeo])\s+(lei|decreto|resolução)"
# Kind of element, pattern, group that holds its number.
ELEMENTS = [
    ("artigo", r"(?iuU)\b(art(?:igo)?\.?\s*(?:n[º°]?\s*)?)(\d+[º°]?)", 2),
    ("paragrafo", r"(?iuU)\b([§¶]|par[áa]grafo)\s*(?:n[º°]?\s*)?(\d+[º°]?|[ÚUÚ]nico)", 2),
    ("inciso", r"(?iuU)\binciso\s+([IVXLCDM]+|\d+)", 1),
    ("alinea", r"(?iuU)\bal[íi]nea\s+([a-z])\)", 1),
]

# Stems, upper-cased, that a match of an action holds; REFERENCIA has all others.
STEMS = {
    "REVOGA": ["REVOG"], "ALTERA": ["ALTER", "MODIFIC"], "ADICIONA": ["ADICION", "ACRESCEN", "INCLUI"], "SUBSTITUI": ["SUBSTITU"],
    "REGULAMENTA": ["REGULAMENTA", "DISCIPLINA"],
}
# What a text with any action holds, upper-cased with a plain I: each alternative of each pattern above has one.
SIGNS = [s for stems in STEMS.values() for s in stems] + ["CONFORME", "TERMOS", "ACORDO", "PREVISTO", "DISPOSTO"]
# What a text must hold, upper-cased, to match at all.
HINTS = {
    "law": ["LEI", "LC", "DECRETO", "RESOLU"], "self": ["LEI", "DECRETO", "RESOLU"], "artigo": ["ART"], "paragrafo": ["§", "¶", "GRAFO"], "inciso": ["INCISO"], "alinea": ["NEA"],
}
# With what letters a match begins, whatever their case.
INITIALS = {"law": "ldr", "self": "d", "artigo": "a", "paragrafo": "§¶p", "inciso": "i", "alinea": "a"}
