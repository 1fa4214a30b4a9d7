"""Repair of mathematical notation, escaping for TeX, and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.cleaning import trim_blanks, trim_space

#: Literal substitutions, in this order.
LITERALS = {
    ":=:=": ":=", "W:=": ":=", "WWD": ":=", "&forall;": "∀", "&exist;": "∃", "&isin;": "∈", "&notin;": "∉", "&sub;": "⊂",
    "&sube;": "⊆", "&supe;": "⊇", "&cap;": "∩", "&cup;": "∪", "&rArr;": "⇒", "&lArr;": "⇐", "&hArr;": "⇔", "&rarr;": "→",
    "&larr;": "←", "&equiv;": "≡", "&not;": "¬", "&and;": "∧", "&or;": "∨", "&empty;": "∅", "&ne;": "≠", "&le;": "≤", "&ge;": "≥",
}
#: Patterns and replacements, in this order.
PATTERNS = [
    (r"\.\s*([A-Za-z]\w{0,9})\s+D\s+([A-Za-z]\w{0,9})\s*/", "$1 = $2"),
    (r"\.\s*([A-Za-z])\s+([A-Za-z])\s*/", "$1 ⊆ $2"),
    (r"(?<![A-Za-z\d])8\s*([A-Za-z])\s*:", "∀$1:"),
    (r"(?<![A-Za-z])E\s*([a-z])\s*:", "∃$1:"),
    (r"(?<![A-Za-z\d])3\s*([a-z])\s*:", "∃$1:"),
    (r"\bIFF\b", "⇔"),
    (r"\bIMPLIES\b", "⇒"),
    (r"\bAND\b", "∧"),
    (r"\bOR\b", "∨"),
    (r"\bNOT\b", "¬"),
    (r"\bFORALL\b", "∀"),
    (r"\bEXISTS\b", "∃"),
    (r"\bNEQ\b", "≠"),
    (r"\bSUBSETEQ\b", "⊆"),
    (r"\bSUBSET\b", "⊂"),
    (r"\bUNION\b", "∪"),
    (r"\bINTERSECT\b", "∩"),
    (r"\bEMPTYSET\b", "∅"),
    (r"(?<![A-Za-z])([a-z])\s+2\s+([A-Z\{])", "$1∈$2"),
    (r"(?<![A-Za-z])([a-z])2([A-Z\{])", "$1∈$2"),
    (r"(?<![A-Za-z])([a-z])\s+2\s+([a-z])(?![A-Za-z])", "$1∈$2"),
    (r"<\s*=(?!=)", "≤"),
    (r">\s*=(?!=)", "≥"),
    (r" {2,}", " "),
]
#: The ten characters that TeX reserves.
TEX = {"\\": "\\textbackslash{}", "&": "\\&", "%": "\\%", "$": "\\$", "#": "\\#", "_": "\\_", "{": "\\{", "}": "\\}", "~": "\\textasciitilde{}", "^": "\\textasciicircum{}"}


#: Of each pattern, in their order, a piece that every match has: a text without it needs no look by the pattern.
PIECES = ["D", "/", "8", "E", "3", "IFF", "IMPLIES", "AND", "OR", "NOT", "FORALL", "EXISTS", "NEQ", "SUBSETEQ", "SUBSET", "UNION", "INTERSECT", "EMPTYSET", "2", "2", "2", "<", ">", "  "]


def repair_math(text: Column) -> Column:
    for bad, good in LITERALS.items():
        text = F.replace(text, F.lit(bad), F.lit(good))
    for (pattern, good), piece in zip(PATTERNS, PIECES, strict=True):
        # bound to a name, since the text is named three times
        mended = lambda t: F.when(F.contains(t, F.lit(piece)), F.regexp_replace(t, pattern, good)).otherwise(t)  # noqa: B023, E731
        text = F.get(F.transform(F.array(text), mended), F.lit(0))
    return text


def definitions_to_equivalence(text: Column) -> Column:
    """On each line, the first := becomes an equivalence if what follows has a quantifier or connective."""

    def line(x: Column) -> Column:
        left, right = F.substring_index(x, ":=", 1), F.regexp_replace(x, r"^.*?:=\s*", "")
        swapped = F.regexp_replace(F.concat(left, F.lit(" ⇔ "), right), " {2,}", " ")
        return F.when(x.rlike(":=.*[∀∃⇒⇔∧∨]"), swapped).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def repair_notation(text: Column) -> Column:
    """repair_math, then equivalences, dot and slash wrappers (at most five deep), and spacing."""
    text = definitions_to_equivalence(repair_math(text))
    for _ in range(5):
        text = F.regexp_replace(text, r"\.([^/\n]{1,4000})/", "($1)")
    for pattern, good in ((r"([A-Za-z0-9}])∈([A-Za-z0-9{])", "$1 ∈ $2"), (r"([∀∃][A-Za-z]):(\S)", "$1: $2"), (r"\(\s+", "("), (r"\s+\)", ")"), (r" {2,}", " "), (r"^\s+|\s+$", "")):
        text = F.regexp_replace(text, pattern, good)
    return text


def escape_tex(text: Column) -> Column:
    """One pass over the characters, so that replacements are not escaped again; null becomes empty."""
    table = F.create_map(*(F.lit(x) for pair in TEX.items() for x in pair))
    escaped = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(table[c], c)), "")
    return F.coalesce(F.when(text.rlike(r"[\\&%$#_{}~^]"), escaped).otherwise(text), F.lit(""))


def title_case(text: Column) -> Column:
    """Strip numbering and bullets, collapse spaces, and capitalise every run of letters."""
    bare = F.regexp_replace(trim_blanks(F.regexp_replace(text, r"^[\d.\-–•*]+\s*", "")), r"\s+", " ")
    runs = F.regexp_extract_all(bare, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000)))), "")


def topic_title(text: Column) -> Column:
    """Without trailing page number, leading numbering, slide prefix and outer punctuation."""
    for pattern in (r"\s+\d{1,4}$", r"(?i)^(\d+(\.\d+)*|[IVXLC]+\.?)\s+", r"(?i)^slide\s*\d+\s*[:\-–]?\s*"):
        text = trim_blanks(F.regexp_replace(text, pattern, ""))
    return F.regexp_replace(trim_blanks(F.regexp_replace(text, r"\s{2,}", " ")), r"""^[.\-–—:;,!?"'()\[\]{}]+|[.\-–—:;,!?"'()\[\]{}]+$""", "")


def outline_title(text: Column) -> Column:
    bare = F.regexp_replace(trim_blanks(text), r"(?i)^(?:(?:chapter|section|part|unit|lecture|module|appendix|slide)\s*[\d.]*\s*[:\-–]?\s*|[\d]+(?:\.[\d]+)*\.?\s+)", "")
    return F.regexp_replace(trim_blanks(bare), r"\s{2,}", " ")


PAGE_SUFFIX = r"[\s.·*]+(\d{1,4})\s*$"


def toc_title(text: Column) -> Column:
    bare = trim_blanks(F.regexp_replace(text, PAGE_SUFFIX, ""))
    return F.regexp_replace(trim_blanks(F.regexp_replace(bare, r"[.\s]{2,}$", "")), r"\s{2,}", " ")


def toc_page(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, PAGE_SUFFIX, 1), F.lit("")).cast("int")


STRUCTURAL = "Chapter|Section|Unit|Lecture|Topic|Part|Module|Appendix"


def subtitle(line: Column) -> Column:
    """Null for a bare label such as "Chapter 7"; the part after the separator; else the line."""
    bare = line.rlike(rf"(?i)^({STRUCTURAL})\s*[\d.\-–]*\s*$")
    compound = line.rlike(rf"(?i)^({STRUCTURAL})\s*[\d:–\-]") & line.rlike(r"[:\-–]\s*\S")
    return F.when(bare, F.lit(None).cast("string")).when(compound, trim_blanks(F.regexp_extract(line, r"[:\-–]\s*(.+)$", 1))).otherwise(line)


def option_text(text: Column) -> Column:
    return trim_blanks(F.regexp_replace(F.regexp_replace(trim_space(F.lower(text)), r"^\.+|\.+\z", ""), r"\s+", " "))


def fingerprint(stem: Column) -> Column:
    """SHA-256 of the stem without case, option labels, punctuation and extra spaces."""
    bare = F.regexp_replace(F.lower(stem), r"(?U)(?<!\w)[(\[]*[a-d][)\].:\s]+", " ")
    words = trim_blanks(F.regexp_replace(F.regexp_replace(bare, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    return F.sha2(words, 256)


def snippet(text: Column, most: int = 500) -> Column:
    return F.concat(trim_space(F.substring(text, 1, most)), F.when(F.length(text) > most, F.lit(" …")).otherwise(""))


def evidence(text: Column, cap: int = 1400) -> Column:
    """Cut at the last full stop if it lies beyond half the cap."""
    body, head = trim_blanks(text), F.substring(trim_blanks(text), 1, cap)
    last = F.length(head) - F.instr(F.reverse(head), ".") + 1
    cut = F.when((F.instr(head, ".") > 0) & (last - 1 > cap // 2), F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(body) > cap, F.concat(cut, F.lit(" …"))).otherwise(body)


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")
