"""Markup in text columns. Entities need Python; only texts with an ampersand pay for it."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from noticiario.functions.text import SPACE, strip

_HEX, _DEC = re.compile(r"&#x([0-9A-Fa-f]+);"), re.compile(r"&#(\d+);")


def _char(m: re.Match, base: int) -> str:
    try:
        return chr(int(m.group(1), base))
    except (ValueError, OverflowError):
        return m.group(0)


def decode_once(s: str) -> str:
    """Entities decoded; numeric references left over (escaped twice) once more."""
    s = html.unescape(s)
    if "&#" in s:
        s = _DEC.sub(lambda m: _char(m, 10), _HEX.sub(lambda m: _char(m, 16), s))
    return s


@pandas_udf(StringType())
def _decoded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: decode_once(x) if x is not None and "&" in x else x)


def entities(c: Column) -> Column:
    """Decoded entities, straight quotes, without the debris of wrong encodings (fixed values). Null stays null."""
    return F.translate(_decoded(c), "“”‘’Ââ€™", "\"\"''")


def clean_text(c: Column) -> Column:
    return strip(entities(c))


def body_text(c: Column) -> Column:
    """Breaks to line ends, other tags dropped, stripped; a blank text stays as it is, null too."""
    s = F.regexp_replace(F.regexp_replace(entities(c), "(?i)<br\\s*/?>", "\n"), "<[^>]+>", "")
    return F.when(c.rlike(f"^{SPACE}*$"), c).otherwise(strip(s))
