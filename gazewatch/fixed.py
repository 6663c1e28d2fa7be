"""Patterns, word lists, limits, labels and file-name formats.

Results depend on these being exactly as they are, so they are kept together
and in plain text. Regular expressions are written with the usual ``\\s \\w \\d``
shorthands; :func:`gazewatch.functions.text.portable` spells those out for the
regex engine that runs them.
"""

# Titles that open a legal act, in the order they are tried on a line.
TITLE_PATTERNS = (
    r"DECISÃO\s+\w+\s+N[ºO°]\s*\d+.*?(?:\d{4}|\d{2}\s+DE\s+\w+\s+DE\s+\d{4})",
    r"PORTARIA\s+\w+\s+N[ºO°]\s*\d+.*?(?:\d{4}|\d{2}\s+DE\s+\w+\s+DE\s+\d{4})",
    r"DELIBERAÇÃO\s+\w+\s+N[ºO°]\s*\d+.*?(?:\d{4}|\d{2}\s+DE\s+\w+\s+DE\s+\d{4})",
    r"INSTRUÇÃO\s+NORMATIVA\s+\w+\s+N[ºO°]\s*\d+.*?(?:\d{4}|\d{2}\s+DE\s+\w+\s+DE\s+\d{4})",
    r"RETIFICAÇÃO.*?(?:\d{4}|\d{2}\s+DE\s+\w+\s+DE\s+\d{4})",
)

# Lower-case stems, one per title pattern: a line without any of them holds no title.
TITLE_STEMS = ("decis", "portaria", "delibera", "instru", "retifica")

# Letters outside ASCII that case-insensitive matching takes for one in a stem.
STEM_LOOKALIKES = ("ſ", "ı", "İ")

# The date phrase inside a title.
DATE_PHRASE = r"\d{1,2}\s+DE\s+\w+\s+DE\s+\d{4}"

# White space as Unicode text handling understands it, separators U+001C-001F included.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Edition file names on a listing; {n} is the section number.
LISTING_PATTERNS = (
    r"\d{4}-\d{2}-\d{2}-DO{n}\.zip",
    r"\d{4}-\d{2}-\d{2}-DO{n}E\.zip",
    r"\d{4}_\d{2}_\d{2}_ASSINADO_do{n}\.pdf",
    r"\d{4}_\d{2}_\d{2}_ASSINADO_do{n}_extra_[ABC]\.pdf",
)

# Limits.
LINES_BACK = 50  # a title opens the act of a hit up to 49 lines above it
LINES_FORWARD = 200  # a title closes an act up to 199 lines below its start
SNIPPET_CHARS = 500
CONTEXT_CHARS = 250
TITLE_CHARS = 200
FALLBACK_CHARS = 2000  # of the text of an act without any title
LOOKBACK_DAYS = 2
HISTORY_DAYS = 30
HEARTBEAT_HOURS = (9, 11)  # UTC, Monday to Friday, end excluded

# Digest labels.
NO_TITLE_LABEL = "Sem título identificado"
ITEM_LABEL = "Achado #"
FILTER_LABEL = "Filtro:"
KEYWORD_LABEL = "Palavra-chave:"
SOURCE_LABEL = "Arquivo fonte:"
TOTAL_LABEL = "Total de achados:"
WINDOW_LABEL = "Janela de busca:"
HEARTBEAT_LABEL = "Sistema operacional"
NO_MATCH_LABEL = "Nenhuma publicação encontrada com os critérios de busca."

# Filter rules as shipped: name, section, organisation, keywords.
SHIPPED_RULES = (
    ("SUFER-Todas", "DO1", "Agência Nacional de Transportes Terrestres", ("SUFER",)),
    ("ANTT-Portarias", "DO1", "Agência Nacional de Transportes Terrestres", ("PORTARIA",)),
    ("ANTT-Deliberacoes", "DO1", "Diretoria Colegiada", ("DELIBERAÇÃO",)),
    ("ANTT-Instrucoes", "DO1", "Diretoria Colegiada", ("INSTRUÇÃO NORMATIVA",)),
    ("ANTT-Retificacoes", "DO1", "Agência Nacional de Transportes Terrestres", ("RETIFICAÇÃO",)),
)
