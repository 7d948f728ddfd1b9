"""The dossier: normalising clippings, expanding them to a row a mentioned company, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticiario.functions import lexicon as L
from noticiario.functions.html import body_text, clean_text
from noticiario.functions.labels import snippet, title_output
from noticiario.functions.numeric import parse_numeric
from noticiario.functions.text import fold, strip
from noticiario.operators.numbering import numbered
from noticiario.operators.skew import skew_join

#: Input columns and their alternatives, first one present wins.
ALTERNATIVES = {
    "noticia_id": ("noticia_id", "noticiaid", "id_noticia"),
    "titulo": ("titulo",),
    "dimension": ("dimensioncm2", "dimension"),
    "tema": ("tematica", "tema"),
    "cuerpo": ("cuerpo_es", "cuerpoes", "resumen_aclaracion"),
    "url_av": ("url_nota_av", "link_nota_av"),
    "url_imagen": ("url_streaming_imagen",),
    "duracion": ("duracion_nro_caracteres",),
    "seccion_programa": ("seccion_programa",),
    "temas_generales_tema": ("temas_generales_tema",),
}
AV = ("Radio", "Televisión")
PRINT = ("Prensa", "Internet", "Revistas")


def pick(df: DataFrame, name: str) -> Column:
    """The first of a column's alternatives that the table has, as string; null if it has none."""
    for c in ALTERNATIVES.get(name, (name,)):
        if c in df.columns:
            return F.col(c).cast("string")
    return F.lit(None).cast("string")


def _mapped(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.coalesce(key, F.lit("")))


def media_type(c: Column) -> Column:
    """Media type at ingest: nine known spellings, others stay as they are without outer space; null stays null."""
    return F.coalesce(_mapped(F.lower(strip(c)), L.MEDIA), strip(c))


def media_type_wide(c: Column) -> Column:
    """Media type of the duplicate rules: folded, more spellings; unknown ones with initial capitals, ``Otro`` for blank and null."""
    rest = F.initcap(strip(c))
    return F.coalesce(_mapped(strip(fold(c)), L.MEDIA_WIDE), F.when(rest != "", rest), F.lit("Otro"))


def parse_date(c: Column) -> Column:
    """Day first, then ISO; each value by itself, years of two digits being of this century. What is no date is null."""
    s = strip(c)
    return F.coalesce(*[F.try_to_date(s, f) for f in ("d/M/yyyy", "d-M-yyyy", "yyyy-MM-dd", "d.M.yyyy", "d/M/yy", "d-M-yy")], F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))


def config_map(df: DataFrame, key: str = "clave", value: str = "valor", order: str = "row_id") -> DataFrame:
    """(clave, valor) of a two-column sheet: keys lower and stripped, blank and ``nan`` ones dropped, the last of a repeated key wins."""
    k = F.lower(strip(F.col(key)))
    return df.select(k.alias("clave"), F.col(value).alias("valor"), F.col(order).alias("_o")).where("clave is not null and clave not in ('', 'nan')").groupBy("clave").agg(F.max_by("valor", "_o").alias("valor"))


#: A lookup table is broadcast up to so many rows; a larger one is joined by shuffle.
SMALL_TABLE = 100_000


def look_up(df: DataFrame, key: Column, table: DataFrame, name: str) -> DataFrame:
    """``df`` with the table's value as ``name``, null without one. Outlets are few: a bounded table is broadcast, so no outlet's rows gather."""
    side = table.select(F.col("clave").alias("_clave"), F.col("valor").alias(name))
    keyed = df.withColumn("_clave", key)
    if side.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE:
        return keyed.join(F.broadcast(side), "_clave", "left").drop("_clave")
    return skew_join(keyed, side, ["_clave"], how="left").drop("_clave")


def normalize(df: DataFrame, regions: DataFrame | None = None, outlets: DataFrame | None = None, row: str = "row_id") -> DataFrame:
    """The clippings in the report's terms; one narrow projection besides two lookups.

    Fully blank rows are dropped. The region is looked up before the outlet is renamed. Missing input
    columns give nulls, a missing media type ``Otro``, a missing outlet ``N/A``. A missing text is null,
    not the word for it.
    """
    data = [c for c in df.columns if c not in (row, "cargado")]
    blank = F.lit(True)
    for c in data:
        blank = blank & (F.col(c).isNull() | (F.col(c).cast("string") == ""))
    src = df.where(~blank) if data else df
    base = src.select(
        F.col(row).alias("row_id"),
        pick(src, "noticia_id").alias("id_noticia"),
        parse_date(pick(src, "fecha")).alias("fecha"),
        pick(src, "hora").alias("hora"),
        (pick(src, "medio") if "medio" in src.columns else F.lit("N/A")).alias("medio_original"),
        (media_type(pick(src, "tipo_de_medio")) if "tipo_de_medio" in src.columns else F.lit("Otro")).alias("tipo_de_medio"),
        *[clean_text(pick(src, c)).alias(c) for c in ("seccion_programa", "titulo", "autor_conductor", "tono", "tema", "temas_generales_tema")],
        *[pick(src, c).alias(c) for c in ("nro_pagina", "tier", "audiencia")],
        pick(src, "dimension").alias("_dimension"),
        pick(src, "duracion").alias("_duracion"),
        pick(src, "cpe").try_cast("double").alias("_cpe"),
        pick(src, "valor_de_nota").try_cast("double").alias("_valor"),
        body_text(pick(src, "cuerpo")).alias("cuerpo_completo"),
        strip(pick(src, "url_av")).alias("_av"),
        strip(pick(src, "url_imagen")).alias("_imagen"),
        strip(pick(src, "url_nota")).alias("_nota"),
        clean_text(pick(src, "menciones_empresa")).alias("_menciones"),
        clean_text(pick(src, "empresa_rel")).alias("_rel"),
    )
    av, printed, internet = F.coalesce(F.col("tipo_de_medio").isin(*AV), F.lit(False)), F.coalesce(F.col("tipo_de_medio").isin(*PRINT), F.lit(False)), F.coalesce(F.col("tipo_de_medio") == "Internet", F.lit(False))
    outlet = F.lower(strip(F.col("medio_original")))
    wide = look_up(base, outlet, config_map(regions), "_region") if regions is not None else base.withColumn("_region", F.lit(None).cast("string"))
    wide = look_up(wide, F.when(internet, outlet), config_map(outlets), "_alias") if outlets is not None else wide.withColumn("_alias", F.lit(None).cast("string"))
    lines = F.filter(F.transform(F.split("cuerpo_completo", "\n"), strip), lambda x: x != "")
    link = lambda url: F.when(F.coalesce(url, F.lit("")) != "", F.struct(F.lit("Link").alias("value"), url.alias("url")))
    return wide.select(
        "row_id", "id_noticia", "fecha", "hora",
        F.coalesce(F.when(internet, F.col("_alias")), F.col("medio_original")).alias("medio"),
        "tipo_de_medio", "seccion_programa", F.coalesce("_region", F.lit("N/A")).alias("region"), "medio_original", "titulo", "autor_conductor", "nro_pagina",
        F.when(av, F.col("_duracion")).otherwise(F.col("_dimension")).alias("dimension"),
        F.when(av, F.lit("0")).otherwise(F.col("_duracion")).alias("duracion"),
        F.when(av, F.col("_cpe")).when(printed, F.col("_valor")).alias("cpe"),
        "tier", "audiencia", "tono", "tema", "temas_generales_tema",
        F.when(av | (F.size(lines) <= 1), F.col("cuerpo_completo")).otherwise(F.array_join(lines, "\n\n")).alias("resumen_aclaracion"),
        "cuerpo_completo",
        link(F.when(av, F.replace("_av", F.lit(".com.ar"), F.lit(".com.co"))).otherwise(F.col("_imagen"))).alias("link_nota"),
        F.when(internet, link(F.col("_nota"))).alias("link_streaming"),
        F.when(printed, F.col("_rel")).otherwise(F.col("_menciones")).alias("menciones_empresa"),
    )


def explode_mentions(df: DataFrame, mentions: str = "menciones_empresa", row: str = "row_id") -> DataFrame:
    """A row for each mentioned company (``mencion``), one with the empty text for none; (row, ``posicion``) tells them apart and keeps their order."""
    each = F.filter(F.transform(F.split(F.coalesce(mentions, F.lit("")), ";"), strip), lambda x: x != "")
    return df.select("*", F.posexplode(F.when(F.size(each) > 0, each).otherwise(F.array(F.lit("")))).alias("posicion", "mencion"))


def expanded_index(df: DataFrame, row: str = "row_id") -> DataFrame:
    """``expanded_index``: consecutive numbers in the order of (row, position)."""
    return numbered(df, [row, "posicion"], "expanded_index")


def unmapped_outlets(normalized: DataFrame) -> DataFrame:
    """(medio) of the outlets without a region."""
    return normalized.where("region = 'N/A'").select(strip(F.col("medio_original")).alias("medio")).where("medio is not null and lower(medio) not in ('', 'nan', 'none')").distinct()


def stamp_duplicates(df: DataFrame) -> DataFrame:
    """Duplicates carry marks instead of labels; others keep what they have."""
    out = df
    for c, mark in (("tono_ia", "Duplicada"), ("tema", "-"), ("subtema", "-")):
        has = F.col(c) if c in df.columns else F.lit(None).cast("string")
        out = out.withColumn(c, F.when(F.col("is_duplicate"), mark).otherwise(has))
    return out


REPORT = "id_noticia fecha hora medio tipo_de_medio seccion_programa region titulo autor_conductor nro_pagina dimension duracion cpe tier audiencia tono tono_ia tema subtema grupo_noticia link_nota resumen_aclaracion link_streaming menciones_empresa id_duplicada cuerpo_completo contexto_analizado coincidencia_marca origen_coincidencia".split()
NUMERIC = {"nro_pagina", "dimension", "duracion", "tier", "audiencia"}


def report(df: DataFrame) -> DataFrame:
    """The report's columns in order: numbers parsed, title and summary cleaned; columns not there yet are null. The id stays text."""
    out = []
    for c in REPORT:
        x = F.col(c) if c in df.columns else F.lit(None).cast("string")
        if c in NUMERIC and c in df.columns:
            x = parse_numeric(x.cast("string"))
        elif c == "titulo" and c in df.columns:
            x = title_output(x)
        elif c == "resumen_aclaracion" and c in df.columns:
            x = snippet(x)
        out.append(x.alias(c))
    return df.select("row_id", *out)


def kpis(df: DataFrame) -> DataFrame:
    """(total, unicas, duplicadas) in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_duplicate")).alias("unicas"), F.count_if("is_duplicate").alias("duplicadas"))


def cache_stats(df: DataFrame, key: str) -> DataFrame:
    """(texto): how many rows find the key of an earlier row, how many don't, and the rate in whole percent."""
    n = df.agg(F.count(F.lit(1)).alias("t"), F.count_distinct(F.coalesce(F.col(key), F.lit(""))).alias("m"))
    rate = F.when(F.col("t") > 0, F.bround(100 * (F.col("t") - F.col("m")) / F.col("t"), 0)).otherwise(0).cast("bigint")
    return n.select(F.format_string("Cache: %d hits, %d misses (%d%%)", F.col("t") - F.col("m"), F.col("m"), rate).alias("texto"))
