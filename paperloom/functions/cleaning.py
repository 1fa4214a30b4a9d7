"""Text cleaning: ligatures, control characters, spaces and blank lines."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Ligatures and what they stand for; characters that count as a space.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
EXOTIC_SPACES = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Fixed value: the separators of Unicode (Zs), which SQL's trim strips as well as the blank.
BLANKS = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
#: Texts of a batch that are Python objects at a time.
TEXTS = 100
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    """A batch's texts are Python objects a few at a time only. (Arrow's own utf8_normalize leaves letters decomposed.)"""
    mended = lambda part: pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in part.to_pylist()], pa.string())
    return pa.concat_arrays([mended(text.slice(k, TEXTS)) for k in range(0, max(1, len(text)), TEXTS)])


def nfkc(text: Column) -> Column:
    """Unicode NFKC; ASCII text, on which it is the identity, never leaves the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)


def expand_ligatures(text: Column) -> Column:
    for one, several in LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(several))
    return text


def drop_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, "")


def trim_space(text: Column) -> Column:
    """Strip all white space at both ends, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def trim_blanks(text: Column | str) -> Column:
    """Strip blanks of any kind at both ends, but no line ends or tabs: what SQL's trim does."""
    return F.btrim(text, F.lit(BLANKS))


def tidy_spaces(text: Column) -> Column:
    plain = F.regexp_replace(text, EXOTIC_SPACES, " ")
    return F.array_join(F.transform(F.split(plain, "\n"), lambda line: trim_space(F.regexp_replace(line, "[ \t]{2,}", " "))), "\n")


def limit_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def clean(text: Column) -> Column:
    """All steps in their order, then strip the whole."""
    return trim_space(limit_blank_lines(tidy_spaces(drop_controls(expand_ligatures(nfkc(text))))))
