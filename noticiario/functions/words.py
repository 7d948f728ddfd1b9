"""Python-side text kernel for operators whose normalisation Spark's built-ins can't express.

Used inside Arrow batches only. Markup entities are decoded with the standard library; everything
after that works on whole strings in C (replace, bytes.translate, split), not character by character.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
NOT_ASCII = re.compile(r"[^\x00-\x7f]")
#: Lower-case a-z and 0-9 stay, everything else separates.
_KEEP = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else c + 32 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for c in range(256))


def decode(s: str, times: int = 2) -> str:
    """Markup entities decoded, also when escaped twice."""
    for _ in range(times):
        if "&" not in s:
            break
        s = html.unescape(s)
    return s


@lru_cache(maxsize=1 << 16)
def ascii_of(ch: str) -> str:
    """A letter without its accent; nothing for invisible and combining characters; else the character."""
    kind = unicodedata.category(ch)
    if kind in ("Cf", "Mn", "Me"):
        return ""
    base = unicodedata.normalize("NFD", ch)
    return base[0] if base[0].isascii() and len(base) > 1 else ch


def ascii_words(s: str | None) -> list[bytes]:
    """Runs of a-z and 0-9 after decoding entities, dropping tags and ignoring case and accents.

    None and texts without any such run give an empty list.
    """
    if not s:
        return []
    s = decode(s)
    if "<" in s:
        s = TAG.sub(" ", s)
    if not s.isascii():
        for ch in set(NOT_ASCII.findall(s)):
            s = s.replace(ch, ascii_of(ch))
    return s.encode("ascii", "replace").translate(_KEEP).split()


@pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Markup entities decoded, also when escaped twice; null stays null."""
    return s.map(lambda x: decode(x) if x is not None and "&" in x else x)
