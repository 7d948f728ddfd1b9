"""Text functions as Spark columns: everything here stays in whole-stage code generation."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it; Java's ``\s`` and Spark's trim know less.
SPACE = "[\\s\\x0b\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks whose canonical decomposition starts with an ASCII letter, and those letters."""
    pairs = []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp))
        if len(base) > 1 and base[0].isascii():
            pairs.append((chr(cp), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()
#: Letters without a decomposition and signs that are spelt out (fixed values).
SPELT = (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("Đ", "D"), ("€", "EUR"), ("º", "o"), ("ª", "a"), ("°", "deg"), ("…", "..."), ("–", "-"), ("—", "--"), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("«", "<<"), ("»", ">>"), ("¿", "?"), ("¡", "!"))


def unaccent(c: Column) -> Column:
    """Latin letters without accents, a few letters and signs spelt out; other characters stay. Null stays null."""
    one = [(a, b) for a, b in SPELT if len(b) == 1]
    whole = c
    c = F.translate(c, _FROM + "".join(a for a, _ in one), _TO + "".join(b for _, b in one))
    c = F.regexp_replace(c, "[\\u0300-\\u036f]", "")
    for a, b in SPELT:
        if len(b) > 1:
            c = F.replace(c, F.lit(a), F.lit(b))
    return F.when(whole.rlike("[^\\x00-\\x7f]"), c).otherwise(whole)


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.lower(unaccent(F.lower(c)))


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")
