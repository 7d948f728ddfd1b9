"""Sheets with free headers: names, configuration maps, previews, appended columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticiario.operators.brand import plain
from noticiario.operators.dossier import config_map

TITLES = ("Título", "Titulo", "Titular", "Headline")
SUMMARIES = ("CuerpoEs", "Resumen - Aclaración", "Resumen - Aclaracion", "Resumen", "Cuerpo", "Descripción", "Descripcion")


def text_column(columns: list[str], wanted: tuple[str, ...], fallback: int = 0) -> int:
    """Place of the column a header name means, ignoring case and accents: equal first, then contained either way, else the fallback."""
    have, want = [plain(c) for c in columns], [plain(w) for w in wanted]
    for test in (lambda w, h: w == h, lambda w, h: w in h or h in w):
        for w in want:
            for i, h in enumerate(have):
                if h and test(w, h):
                    return i
    return min(fallback, max(0, len(columns) - 1))


def snake(df: DataFrame) -> DataFrame:
    """Headers as lower-case ASCII words joined by underscores; names that clash get their place appended."""
    seen: dict[str, int] = {}
    names = []
    for i, c in enumerate(df.columns):
        n = plain(c).replace(" ", "_") or f"columna_{i}"
        names.append(n if n not in seen else f"{n}_{i}")
        seen[n] = i
    return df.toDF(*names)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """(clave, valor) of a two-column sheet without headers; the last of a repeated key wins. Lines keep their order within the one small file."""
    raw = spark.read.csv(path, header=False, schema="clave string, valor string")
    return config_map(raw.coalesce(1).withColumn("row_id", F.monotonically_increasing_id()))


def preview(df: DataFrame, n: int = 10, row: str = "row_id") -> DataFrame:
    """The first rows, in order."""
    return df.orderBy(row).limit(n)


def append_columns(original: DataFrame, new: DataFrame, row: str = "row_id") -> DataFrame:
    """The original sheet with only the new sheet's new columns."""
    return original.join(new.select(row, *[c for c in new.columns if c not in original.columns]), row, "left")
