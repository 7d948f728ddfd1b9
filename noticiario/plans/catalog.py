"""The registered queries of the core, over whole tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticiario.functions import labels as T
from noticiario.functions import lexicon as L
from noticiario.functions.html import body_text
from noticiario.functions.numeric import parse_numeric
from noticiario.functions.text import SPELT, strip
from noticiario.functions.vectors import centroids, cosine
from noticiario.operators import brand as B
from noticiario.operators import dossier as D
from noticiario.operators import duplicates as U
from noticiario.operators import alike, graph, labeling, numbering, stories, tone
from noticiario.operators.skew import skew_join
from noticiario.operators import subtopics, topics
from noticiario.plans import pipeline
from noticiario.session import Scratch
from noticiario.sources import sheets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- pieces of SQL that say what the columns' functions say

_SP = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def s_unaccent(x: str) -> str:
    for a, b in SPELT:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return f"strip_accents({x})"


def s_fold(x: str) -> str:
    return f"lower({s_unaccent(f'lower({x})')})"


def s_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def s_key(x: str) -> str:
    return f"regexp_replace({s_fold(f'coalesce({x}, {chr(39) * 2})')}, '[^a-z0-9]+', '', 'g')"


def s_mention(x: str) -> str:
    return f"trim(regexp_replace({s_fold(f'coalesce({x}, {chr(39) * 2})')}, '[^a-z0-9]+', ' ', 'g'))"


def s_label_words(x: str) -> str:
    return f"list_filter(string_split({s_mention(x)}, ' '), lambda t: t <> '' and not list_contains({s_list(L.STOPWORDS)}, t))"


def s_distinctive(x: str, least: int = 4) -> str:
    return f"list_distinct(list_filter({s_label_words(x)}, lambda t: length(t) >= {least} and not list_contains({s_list(L.WEAK)}, t) and not regexp_full_match(t, '[0-9]+')))"


def s_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{_SP}+'), lambda w: w <> '')"


def s_title(x: str) -> str:
    short = s_strip(f"regexp_replace(coalesce({x}, ''), '{_SP}+[|–—-]{_SP}+[^|–—-]+$', '')")
    rest = s_strip(f"regexp_replace({short}, '^[^:]*:', '')")
    cut = f"case when contains({short}, ':') and length({rest}) >= 10 then {rest} else {short} end"
    return f"trim(lower(regexp_replace({s_unaccent(f'({cut})')}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')))"


def s_bare(x: str) -> str:
    return f"regexp_replace(lower({x}), '[.,;:!?]+$', '')"


def s_complete(x: str) -> str:
    last = s_bare(f"coalesce(list_extract({s_words(x)}, -1), '')")
    return f"(not list_contains({s_list(L.TRAILING)}, {s_unaccent(last)}) and length({last}) > 1)"


def s_headline(x: str) -> str:
    return f"(regexp_matches({x}, '(?i)^({'|'.join(L.HEADLINE)})([^\\p{{L}}\\p{{N}}_]|$)') or regexp_matches({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(L.STATE)})\\s*$'))"


def s_url(x: str) -> str:
    a = f"regexp_replace(lower({s_strip(f'coalesce({x}, {chr(39) * 2})')}), '^https?://', '')"
    return f"regexp_replace(regexp_replace({a}, '^www[.]', ''), '/+$', '')"


def s_date(x: str) -> str:
    s = s_strip(x)
    tries = [f"case when regexp_full_match({s}, '{p}') then try_strptime({s}, '{f}') end" for p, f in (("[0-9]+/[0-9]+/[0-9]{4}", "%d/%m/%Y"), ("[0-9]+-[0-9]+-[0-9]{4}", "%d-%m-%Y"), ("[0-9]{4}-[0-9]+-[0-9]+", "%Y-%m-%d"), ("[0-9]+[.][0-9]+[.][0-9]{4}", "%d.%m.%Y"), ("[0-9]+/[0-9]+/[0-9]{2}", "%d/%m/%y"), ("[0-9]+-[0-9]+-[0-9]{2}", "%d-%m-%y"))]
    return f"cast(coalesce({', '.join(tries)}, try_strptime(left({s}, 10), '%Y-%m-%d')) as date)"


def s_media(x: str) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in L.MEDIA.items())
    return f"case lower({s_strip(x)}) {cases} else {s_strip(x)} end"


def s_decode(x: str) -> str:
    """Named references of the Latin-1 block, quotes and dashes, once."""
    for name, cp in sorted(name2codepoint.items()):
        if name != "amp" and (160 <= cp < 256 or cp in (34, 60, 62) or 0x2010 <= cp <= 0x2026):
            x = f"replace({x}, '&{name};', chr({cp}))"
    return f"replace({x}, '&amp;', '&')"


#: Two double and two single quotes as a SQL literal.
_STRAIGHT = "'" + '""' + "''" * 2 + "'"


def s_entities(x: str) -> str:
    return f"translate({s_decode(x)}, '“”‘’Ââ€™', {_STRAIGHT})"


def s_body(x: str) -> str:
    flat = f"regexp_replace(regexp_replace({s_entities(x)}, '<[bB][rR]{_SP}*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')"
    return f"case when regexp_full_match({x}, '{_SP}*') then {x} else {s_strip(flat)} end"


def s_accents(x: str) -> str:
    """Words looked up one by one: the fixed table, plurals in -s, then the rule."""
    table = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in L.ACCENTS.items()) + "}"
    found = f"coalesce({table}[lower(w)], case when lower(w) like '%s' then {table}[left(lower(w), length(w) - 1)] || 's' end, regexp_replace(lower(w), '([cs])ion$', '\\1ión'))"
    out = f"case when {found} = lower(w) then w when left(w, 1) <> left(lower(w), 1) then upper(left({found}, 1)) || substr({found}, 2) else {found} end"
    return f"array_to_string(list_transform({s_words(x)}, lambda w: {out}), ' ')"


def s_capitalise(x: str) -> str:
    a = s_accents(f"lower({x})")
    return f"(select case when a = '' then 'Sin tema' else upper(left(a, 1)) || substr(a, 2) end from (select {a} as a))"


def s_trim(x: str, most: int) -> str:
    h = f"list_slice({s_words(x)}, 1, {most})"
    kept = f"coalesce(list_max(list_transform(range(1, len({h}) + 1), lambda i: case when list_contains({s_list(L.TRAILING)}, {s_unaccent(s_bare(f'({h})[i]'))}) then 0 else i end)), 0)"
    return f"case when len({s_words(x)}) = 0 then 'Sin tema' when {kept} = 0 then ({h})[1] else array_to_string(list_slice({h}, 1, {kept}), ' ') end"


# ---- flagship


@query(f"""
with r as (select doc_id, coalesce(source, '') as medio, {s_title('titulo')} as t from documents),
g as (select t, min(doc_id) as primera from r where t <> '' group by t)
select r.medio, count(*) as total, cast(count(*) filter (where g.primera is null or g.primera = r.doc_id) as bigint) as unicas,
       cast(count(*) filter (where g.primera is not null and g.primera <> r.doc_id) as bigint) as duplicadas
from r left join g using (t) group by 1""")
def unique_stories(spark, folder):
    """Stories per outlet, by normalised title: total, first ones, repeats."""
    r = table(spark, folder, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("medio"), T.title_norm(F.col("titulo")).alias("t"))
    first = r.where("t != ''").groupBy("t").agg(F.min("doc_id").alias("primera"))
    j = skew_join(r.withColumn("t", F.when(F.col("t") != "", F.col("t"))), first, ["t"], how="left")
    again = F.coalesce(F.col("primera") != F.col("doc_id"), F.lit(False))
    return j.groupBy("medio").agg(F.count(F.lit(1)).alias("total"), F.count_if(~again).alias("unicas"), F.count_if(again).alias("duplicadas"))


# ---- text functions


@query(f"select row_id, {s_key('medio')} as clave from clipping")
def key_norm(spark, folder):
    return table(spark, folder, "clipping").select("row_id", T.key_norm(F.col("medio")).alias("clave"))


@query(f"select row_id, {s_mention('titulo')} as texto from clipping")
def mention_norm(spark, folder):
    return table(spark, folder, "clipping").select("row_id", T.mention_norm(F.col("titulo")).alias("texto"))


@query(f"select row_id, array_to_string({s_label_words('resumen_aclaracion')}, ' ') as texto from nota")
def label_norm(spark, folder):
    return table(spark, folder, "nota").select("row_id", T.label_norm(F.col("resumen_aclaracion")).alias("texto"))


@query(f"select row_id, {s_title('titulo')} as texto from clipping")
def title_norm(spark, folder):
    return table(spark, folder, "clipping").select("row_id", T.title_norm(F.col("titulo")).alias("texto"))


@query(f"select row_id, {s_strip(f'''regexp_replace(titulo, '{_SP}*[|]([\\p{{L}}\\p{{M}}\\p{{N}}_]|{_SP})+$', '')''')} as texto from clipping")
def title_output(spark, folder):
    return table(spark, folder, "clipping").select("row_id", T.title_output(F.col("titulo")).alias("texto"))


@query(f"""
with f as (select doc_id, {s_strip(f"regexp_replace(text, '<br>|\\[\\.\\.\\.\\]|{_SP}+', ' ', 'g')")} as s from documents),
g as (select doc_id, case when regexp_matches(s, '[A-ZÁÉÍÓÚÑ]') then regexp_replace(s, '^[^A-ZÁÉÍÓÚÑ]*', '') else s end as s from f)
select doc_id, case when s = '' or s like '%...' then s else regexp_replace(s, '[.]+$', '') || '...' end as texto from g""")
def snippet(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.snippet(F.col("text")).alias("texto"))


@query(f"""select row_id, case when lower({s_strip("coalesce(url_nota, '')")}) in ('nan', 'none', 'null') then '' else {s_url('url_nota')} end as url from clipping""")
def url_norm(spark, folder):
    return table(spark, folder, "clipping").select("row_id", T.url_norm(F.col("url_nota")).alias("url"))


@query(f"select row_id, {s_complete('subtema')} as completa from informe")
def label_complete(spark, folder):
    return table(spark, folder, "informe").select("row_id", T.is_complete(F.col("subtema")).alias("completa"))


@query(f"""
with w as (select row_id, list_slice({s_words('titulo')}, 1, 5) as h, len({s_words('titulo')}) as n from nota),
k as (select row_id, h, n, coalesce(list_max(list_transform(range(1, len(h) + 1), lambda i: case when list_contains({s_list(L.TRAILING)}, {s_unaccent(s_bare('h[i]'))}) then 0 else i end)), 0) as k from w)
select row_id, case when n = 0 then 'Sin tema' when k = 0 then h[1] else array_to_string(list_slice(h, 1, k), ' ') end as etiqueta from k""")
def label_trim(spark, folder):
    return table(spark, folder, "nota").select("row_id", T.trim_label(F.col("titulo"), 5).alias("etiqueta"))


@query(f"""
select row_id, (len(w) between 2 and 5) and not {s_headline("s")} and (len(w) = 5 or len(list_filter(list_slice(w, 2, 10), lambda x: list_contains({s_list(L.CONNECTIVES)}, {s_unaccent(s_bare('x'))}))) > 0) as valida
from (select row_id, coalesce(subtema, '') as s, {s_words('subtema')} as w from informe)""")
def label_valid(spark, folder):
    return table(spark, folder, "informe").select("row_id", T.valid_subtopic(F.col("subtema")).alias("valida"))


@query(f"""
select row_id, (len(w) between 2 and 5) and not regexp_matches(s, '^[0-9]') and not regexp_matches(s, '(?i)^({'|'.join(L.NUMBER_WORDS)})') and not {s_headline("s")}
       and not list_contains({s_list(L.GENERIC_TOPICS)}, n) as valida
from (select row_id, coalesce(tema, '') as s, {s_words('tema')} as w, array_to_string({s_label_words('tema')}, ' ') as n from informe)""")
def topic_valid(spark, folder):
    return table(spark, folder, "informe").select("row_id", T.valid_topic(F.col("tema")).alias("valida"))


_UNPREFIXED = "regexp_replace(" + s_strip("coalesce(subtema, '')") + """, '^["'']+|["'']+$', '', 'g')"""
_CASES = "x"
for _p in L.LABEL_PREFIXES:
    _CASES = f"case when starts_with(lower({_CASES}), '{_p}') then {s_strip(f'substr({_CASES}, {len(_p) + 1})')} else {_CASES} end" if _CASES == "x" else f"(select case when starts_with(lower(y), '{_p}') then {s_strip(f'substr(y, {len(_p) + 1})')} else y end from (select {_CASES} as y))"


@query(f"""
with a as (select row_id, {_UNPREFIXED} as x from informe), b as (select row_id, {_CASES} as s from a), c as (select row_id, {s_trim('s', 5)} as t from b)
select row_id, {s_capitalise('t')} as etiqueta from c""")
def label_clean(spark, folder):
    return table(spark, folder, "informe").select("row_id", T.clean_topic(F.col("subtema")).alias("etiqueta"))


_NUM = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?"


def s_number(x: str) -> str:
    s = f"lower({s_strip(x)})"
    plain = f"""case when contains({s}, 'e') then replace({s}, ',', '.')
      when contains({s}, '.') and contains({s}, ',') then case when regexp_matches({s}, ',[^.]*$') then replace(replace({s}, '.', ''), ',', '.') else replace({s}, ',', '') end
      when contains({s}, ',') then case when length({s}) - length(replace({s}, ',', '')) > 1 or (regexp_matches({s}, '^[^,]*,[^,]{{3}}$') and not starts_with({s}, '0,')) then replace({s}, ',', '') else replace({s}, ',', '.') end
      when contains({s}, '.') then case when length({s}) - length(replace({s}, '.', '')) > 1 or (regexp_matches({s}, '^[^.]*[.][^.]{{3}}$') and not starts_with({s}, '0.')) then replace({s}, '.', '') else {s} end
      else {s} end"""
    return f"case when regexp_full_match({plain}, '{_NUM}') then try_cast({plain} as double) end"


@query(f"select row_id, {s_number('dimensioncm2')} as dimension, {s_number('audiencia')} as audiencia, {s_number('tier')} as tier from clipping")
def numeric_parse(spark, folder):
    cells = table(spark, folder, "clipping").select("row_id", *[strip(F.col(c)).alias(c) for c in ("dimensioncm2", "audiencia", "tier")])
    return cells.select("row_id", *[parse_numeric(F.col(a), stripped=True).alias(b) for a, b in (("dimensioncm2", "dimension"), ("audiencia", "audiencia"), ("tier", "tier"))])


@query(f"select row_id, {s_date('fecha')} as fecha from clipping")
def date_parse(spark, folder):
    return table(spark, folder, "clipping").select("row_id", D.parse_date(F.col("fecha")).alias("fecha"))


@query(f"select row_id, {s_accents('lower(titulo)')} as texto from nota")
def accents(spark, folder):
    """Titles in lower case with their words' accents restored."""
    return table(spark, folder, "nota").select("row_id", T.restore_accents(F.lower("titulo")).alias("texto"))


@query("""
select * from (values ('gestion', 'gestión'), ('GESTION', 'Gestión'), ('Disenos', 'Diseños'), ('ensenanzas', 'enseñanzas'), ('acompanamiento', 'acompanamiento'), ('pequenas', 'peñas'), ('espana', 'España'), ('gastronomia', 'gastrónomía'),
('regiones', 'regiones'), ('analisis', 'análisis'), ('canones', 'cañones'), ('munoz', 'Muñoz'), ('tecnologias', 'tecnologías'), ('sanciones', 'sanciones'), ('fusion', 'fusión'), ('Expansion', 'Expansión'), ('estrategia', 'estrategia'), ('ninas', 'niñas'), ('rinon', 'riñón')) t(palabra, texto)""")
def accent_cases(spark, folder):
    """Single words of each kind: by rule, by table, by plural, odd ones, and such as have none."""
    words = "gestion GESTION Disenos ensenanzas acompanamiento pequenas espana gastronomia regiones analisis canones munoz tecnologias sanciones fusion Expansion estrategia ninas rinon".split()
    df = spark.createDataFrame([(w,) for w in words], "palabra string")
    return df.select("palabra", T.restore_accents(F.col("palabra")).alias("texto"))


@query(f"select row_id, case when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b)) / least(len(a), len(b)) end as comun from (select row_id, {s_distinctive('titulo')} as a, {s_distinctive('resumen_aclaracion')} as b from nota)")
def text_overlap(spark, folder):
    """Overlap of a note's distinctive title and summary words."""
    return table(spark, folder, "nota").select("row_id", T.overlap(T.distinctive(F.col("titulo")), T.distinctive(F.col("resumen_aclaracion"))).alias("comun"))


_FILE = s_strip(f"regexp_replace({s_unaccent('x')}, '[^A-Za-z0-9_-]+', '_', 'g')")


@query(f"select row_id, case when s = '' then 'marca' else s end as archivo from (select row_id, regexp_replace({_FILE}, '^_+|_+$', '', 'g') as s from (select row_id, trim(coalesce(marca, '')) as x from nota))")
def file_names(spark, folder):
    return table(spark, folder, "nota").select("row_id", T.file_name(F.col("marca")).alias("archivo"))


@query("""select doc_id, nullif(regexp_extract(celda, '=HYPERLINK\\("([^"]+)"', 1), '') as enlace from (select doc_id, case when doc_id % 3 = 0 then titulo else '=HYPERLINK("https://a.co/' || doc_id || '";"Link")' end as celda from documents)""")
def hyperlinks(spark, folder):
    """The target of a cell's link formula."""
    d = table(spark, folder, "documents")
    cell = F.when(F.col("doc_id") % 3 == 0, F.col("titulo")).otherwise(F.concat(F.lit('=HYPERLINK("https://a.co/'), F.col("doc_id").cast("string"), F.lit('";"Link")')))
    return d.select("doc_id", T.hyperlink(cell).alias("enlace"))


@query("select row_id, titulo, medio from clipping order by row_id limit 10")
def preview(spark, folder):
    """The first rows of a sheet."""
    return sheets.preview(table(spark, folder, "clipping").select("row_id", "titulo", "medio"))


@query(f"select row_id, {s_body('cuerpo_es')} as cuerpo from clipping")
def body_clean(spark, folder):
    return table(spark, folder, "clipping").select("row_id", body_text(F.col("cuerpo_es")).alias("cuerpo"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def json_field(spark, folder):
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(f"""
with t as (select row_id, {s_strip("coalesce(titulo, '')")} as t, {s_strip("coalesce(resumen_aclaracion, '')")} as r from nota)
select row_id, left(t || '. ' || t || '. ' || t || '. ' || r, 1800) as texto, md5(left(t || '. ' || t || '. ' || t || '. ' || r, 1800)) as clave from t""")
def embedding_text(spark, folder):
    text = T.embedding_text(F.col("titulo"), F.col("resumen_aclaracion"))
    return table(spark, folder, "nota").select("row_id", text.alias("texto"), F.md5(text.cast("binary")).alias("clave"))


# ---- dossier


@query(f"""select row_id, tipo, tipo in ('Radio', 'Televisión') as av, tipo in ('Prensa', 'Internet', 'Revistas') as grafica from (select row_id, coalesce({s_media('tipo_de_medio')}, '') as tipo from clipping)""")
def media_type(spark, folder):
    t = F.coalesce(D.media_type(F.col("tipo_de_medio")), F.lit(""))
    return table(spark, folder, "clipping").select("row_id", t.alias("tipo"), t.isin(*D.AV).alias("av"), t.isin(*D.PRINT).alias("grafica"))


_WIDE = " ".join(f"when '{k}' then '{v}'" for k, v in L.MEDIA_WIDE.items())


@query(f"""select row_id, case k {_WIDE} else case when t is null or t = '' then 'Otro' else array_to_string(list_transform(string_split(lower(t), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') end end as tipo
from (select row_id, {s_strip('tipo_de_medio')} as t, coalesce({s_strip(s_fold('tipo_de_medio'))}, '') as k from clipping)""")
def media_type_wide(spark, folder):
    """Media types of the duplicate rules."""
    return table(spark, folder, "clipping").select("row_id", D.media_type_wide(F.col("tipo_de_medio")).alias("tipo"))


def _normal(spark, folder):
    return D.normalize(table(spark, folder, "clipping"), table(spark, folder, "mapa_region"), table(spark, folder, "mapa_internet"))


_DATA = "noticia_id fecha hora medio tipo_de_medio seccion_programa titulo autor_conductor nro_pagina dimensioncm2 duracion_nro_caracteres cpe valor_de_nota tier audiencia tono tematica temas_generales_tema cuerpo_es url_nota_av url_streaming_imagen url_nota menciones_empresa empresa_rel".split()
_NOT_BLANK = "not (" + " and ".join(f"({c} is null or cast({c} as varchar) = '')" for c in _DATA) + ")"


def s_map(name: str) -> str:
    return f"(select clave, arg_max(valor, row_id) as valor from (select row_id, lower({s_strip('clave')}) as clave, valor from {name}) where clave is not null and clave not in ('', 'nan') group by clave)"


_BASE = f"""(select row_id, medio, coalesce(r.valor, 'N/A') as region, case when coalesce(tipo, '') = 'Internet' then coalesce(i.valor, medio) else medio end as nuevo, tipo, cpe, valor_de_nota, dimensioncm2, duracion_nro_caracteres
  from (select *, lower({s_strip('medio')}) as k, {s_media('tipo_de_medio')} as tipo from clipping where {_NOT_BLANK}) c
  left join {s_map('mapa_region')} r on r.clave = k left join {s_map('mapa_internet')} i on i.clave = k)"""


@query(f"select row_id, region, nuevo as medio from {_BASE}")
def region_lookup(spark, folder):
    return _normal(spark, folder).select("row_id", "region", "medio")


@query(f"select distinct {s_strip('medio')} as medio from {_BASE} where region = 'N/A' and medio is not null and lower({s_strip('medio')}) not in ('', 'nan', 'none')")
def unmapped_outlets(spark, folder):
    return D.unmapped_outlets(_normal(spark, folder))


@query(f"""select row_id, case when tipo in ('Radio', 'Televisión') then duracion_nro_caracteres else dimensioncm2 end as dimension,
  case when tipo in ('Radio', 'Televisión') then '0' else duracion_nro_caracteres end as duracion,
  case when tipo in ('Radio', 'Televisión') then cpe when tipo in ('Prensa', 'Internet', 'Revistas') then valor_de_nota end as cpe from {_BASE}""")
def value_choice(spark, folder):
    return _normal(spark, folder).select("row_id", "dimension", "duracion", "cpe")


@query(f"""
with m as (select row_id, list_filter(list_transform(string_split(coalesce(menciones_empresa, ''), ';'), lambda x: {s_strip('x')}), lambda x: x <> '') as l from clipping),
e as (select row_id, unnest(case when len(l) > 0 then l else [''] end) as mencion, unnest(range(0, greatest(len(l), 1))) as posicion from m)
select row_id, cast(posicion as integer) as posicion, mencion, row_number() over (order by row_id, posicion) - 1 as expanded_index from e""")
def mention_explode(spark, folder):
    rows = table(spark, folder, "clipping").select("row_id", "menciones_empresa")
    return D.expanded_index(D.explode_mentions(rows)).select("row_id", "posicion", "mencion", "expanded_index")


def s_clean(c: str) -> str:
    return s_strip(s_entities(c))


_DOSSIER = f"""
base as (select *, lower({s_strip('medio')}) as k, {s_media('tipo_de_medio')} as tipo, {s_body('cuerpo_es')} as cuerpo, {s_clean('titulo')} as t, {s_strip('url_nota_av')} as av, {s_strip('url_streaming_imagen')} as im, {s_strip('url_nota')} as un,
  {s_clean('menciones_empresa')} as me, {s_clean('empresa_rel')} as re, {s_date('fecha')} as f from clipping where {_NOT_BLANK}),
lined as (select *, list_filter(list_transform(string_split(cuerpo, chr(10)), lambda x: {s_strip('x')}), lambda x: x <> '') as lineas, coalesce(tipo in ('Radio', 'Televisión'), false) as es_av, coalesce(tipo in ('Prensa', 'Internet', 'Revistas'), false) as es_gr, coalesce(tipo = 'Internet', false) as es_in from base),
dossier as (select lined.row_id, noticia_id as id_noticia, f as fecha, hora, case when es_in then coalesce(i.valor, medio) else medio end as medio, tipo as tipo_de_medio, coalesce(r.valor, 'N/A') as region, t as titulo,
  case when es_av then cpe when es_gr then valor_de_nota end as cpe, nullif(case when es_av then replace(av, '.com.ar', '.com.co') else im end, '') as link_nota, case when es_in then nullif(un, '') end as link_streaming,
  case when es_gr then re else me end as menciones_empresa, case when es_av or len(lineas) <= 1 then cuerpo else array_to_string(lineas, chr(10) || chr(10)) end as resumen
  from lined left join {s_map('mapa_region')} r on r.clave = k left join {s_map('mapa_internet')} i on i.clave = k)"""


@query(f"with {_DOSSIER} select row_id, id_noticia, fecha, medio, tipo_de_medio, region, titulo, cpe, link_nota, link_streaming, menciones_empresa, md5(resumen) as resumen from dossier")
def dossier_normalize(spark, folder):
    n = _normal(spark, folder)
    return n.select("row_id", "id_noticia", "fecha", "medio", "tipo_de_medio", "region", "titulo", "cpe", F.col("link_nota.url").alias("link_nota"), F.col("link_streaming.url").alias("link_streaming"), "menciones_empresa", F.md5(F.col("resumen_aclaracion").cast("binary")).alias("resumen"))


# ---- duplicates


def s_link(x: str) -> str:
    inner = f"coalesce({x}, '')"
    return f"case when lower({s_strip(inner)}) in ('nan', 'none', 'null') then '' else {s_url(x)} end"


_EXACT_DUPLICATES = f"""
{_DOSSIER},
m as (select *, list_filter(list_transform(string_split(coalesce(menciones_empresa, ''), ';'), lambda x: {s_strip('x')}), lambda x: x <> '') as l from dossier),
x as (select *, unnest(case when len(l) > 0 then l else [''] end) as mencion, unnest(range(0, greatest(len(l), 1))) as pos from m),
w as (select row_number() over (order by row_id, pos) - 1 as expanded_index, row_id, mencion, id_noticia, {s_key('mencion')} as mk, {s_key('medio')} as o, {s_link('link_streaming')} as s, {s_link('link_nota')} as u, coalesce({s_strip('hora')}, '') as h,
  case coalesce({s_strip(s_fold('tipo_de_medio'))}, '') {_WIDE} else '' end as kind from x),
f1 as (select *, mk <> '' and s <> '' as ok1, row_number() over (partition by mk <> '' and s <> '', s, mk order by expanded_index) as n1, first_value(id_noticia) over (partition by mk <> '' and s <> '', s, mk order by expanded_index) as i1 from w),
g as (select *, ok1 and n1 > 1 as d1, case when kind = 'Internet' then 'u' || chr(31) || u when kind in ('Radio', 'Televisión') then 'h' || chr(31) || o || chr(31) || h end as key2,
  mk <> '' and ((kind = 'Internet' and u <> '') or (kind in ('Radio', 'Televisión') and o <> '' and h <> '')) as ok2 from f1),
f2 as (select *, ok2 and not d1 as a2, row_number() over (partition by ok2 and not d1, key2, mk order by expanded_index) as n2, first_value(id_noticia) over (partition by ok2 and not d1, key2, mk order by expanded_index) as i2 from g),
marked as (select expanded_index, row_id, mencion, d1 or (a2 and n2 > 1) as is_duplicate, case when d1 then i1 when a2 and n2 > 1 then i2 end as id_duplicada from f2)"""


@query(f"with {_EXACT_DUPLICATES} select * from marked")
def exact_duplicates(spark, folder):
    """The three exact rules (link of the note, note's address, broadcast slot) over the normalised, expanded dossier."""
    return pipeline.expanded(_normal(spark, folder), None).select("expanded_index", "row_id", "mencion", "is_duplicate", "id_duplicada")


@query()
def dossier_duplicates(spark, folder):
    """All four rules over the normalised, expanded dossier."""
    return pipeline.expanded(_normal(spark, folder)).select("expanded_index", "row_id", "mencion", "is_duplicate", "id_duplicada")


@query(f"with {_EXACT_DUPLICATES} select count(*) as total, count(*) filter (not is_duplicate) as unicas, count(*) filter (is_duplicate) as duplicadas from marked")
def dossier_kpis(spark, folder):
    """Totals of a dossier marked by the exact rules."""
    return D.kpis(pipeline.expanded(_normal(spark, folder), None))


@query()
def near_titles(spark, folder):
    """Near-identical titles within one outlet and brand of the generic sheet."""
    n = table(spark, folder, "nota").select(F.concat_ws("|", T.key_norm(F.col("medio")), T.key_norm(F.col("marca"))).alias("grupo"), F.col("row_id").alias("k"), T.title_norm(F.col("titulo")).alias("t"))
    return U.title_duplicates(n)


# ---- brand

_BRAND, _ALIASES = "Banco Orquidal", ["Lumbral"]
_QUORUM = " or ".join(f"len(list_intersect(string_split(x, ' '), {s_list(B._name_words(n))})) >= {min(2, len(B._name_words(n)))}" for n in B.variants(_BRAND, _ALIASES) if B._name_words(n))
_WHOLE = " or ".join(f"contains(' ' || x || ' ', ' {B.plain(n)} ')" for n in B.variants(_BRAND, _ALIASES))


@query(f"select row_id, ({_WHOLE} or {_QUORUM}) as menciona from (select row_id, {s_mention('menciones_empresa')} as x from informe)")
def brand_mentions(spark, folder):
    return table(spark, folder, "informe").select("row_id", B.exact_mention(T.mention_norm(F.col("menciones_empresa")), B.variants(_BRAND, _ALIASES)).alias("menciona"))


@query(f"""
select row_id, case when len(w) between 2 and 6 then array_to_string(list_transform(w, lambda t: t[1]), '') else '' end as sigla
from (select row_id, list_filter(string_split({s_mention('medio')}, ' '), lambda t: t <> '' and not list_contains({s_list(L.ACRONYM_EMPTY)}, t)) as w from clipping)""")
def brand_acronym(spark, folder):
    return table(spark, folder, "clipping").select("row_id", B.acronym_column(F.col("medio")).alias("sigla"))


_ORIGIN = [B.plain(n) for n in B.variants("Ferrovía Cuatro", ["Lumbral", "Nevoa Telecom"]) if len(B.plain(n)) >= 2]
_IN_TITLE, _IN_SUMMARY = (" or ".join(f"contains({c}, ' {n} ')" for n in _ORIGIN) for c in "tr")


@query(f"""
select row_id, nullif(concat_ws(', ', case when {_IN_TITLE} then 'Título' end, case when {_IN_SUMMARY} then 'Resumen' end), '') as origen
from (select row_id, ' ' || {s_mention('titulo')} || ' ' as t, ' ' || {s_mention('resumen_aclaracion')} || ' ' as r from nota)""")
def brand_origin(spark, folder):
    """Where a brand's names stand as whole words."""
    names = B.variants("Ferrovía Cuatro", ["Lumbral", "Nevoa Telecom"])
    n = table(spark, folder, "nota")
    where = F.concat_ws(", ", *[F.when(B.whole_words(T.mention_norm(F.col(c)), names), F.lit(name)) for c, name in (("titulo", "Título"), ("resumen_aclaracion", "Resumen"))])
    return n.select("row_id", F.nullif(where, F.lit("")).alias("origen"))


@query()
def brand_audit(spark, folder):
    return B.audit(table(spark, folder, "nota"), "Ferrovía Cuatro", ["Lumbral", "Nevoa Telecom"], "titulo", "resumen_aclaracion").select("row_id", "marca_encontrada", "origen_coincidencia", "coincidencia_marca", "contexto_analizado")


# ---- pairs, groups, graph


@query(f"select row_id, array_to_string(list_sort({s_distinctive('titulo')}), ' ') as palabras from nota")
def distinct_tokens(spark, folder):
    return table(spark, folder, "nota").select("row_id", F.array_join(F.sort_array(T.distinctive(F.col("titulo"))), " ").alias("palabras"))


@query(f"""
with w as (select row_id as id, unnest({s_distinctive(s_title('titulo'))}) as p from nota), d as (select p from w group by p having count(*) between 2 and 100),
r as (select w.id, w.p from w join d using (p))
select distinct a.id as i, b.id as j from r a join r b on a.p = b.p and a.id < b.id""")
def token_pairs(spark, folder):
    return stories.word_pairs(stories.title_words(table(spark, folder, "nota"), "row_id", "titulo"))


@query(f"""
with w as (select row_id as id, unnest(list_distinct(list_filter(regexp_split_to_array({s_fold("coalesce(titulo, '')")}, '[^a-z]+'), lambda t: length(t) >= 5 and not list_contains({s_list(L.RARE_STOP)}, t)))) as p from informe),
n as (select greatest(2, cast(floor(count(*) * 0.03) as bigint)) as most from informe), d as (select p from w group by p having count(*) between 2 and (select most from n)),
r as (select w.id, w.p from w join d using (p))
select distinct a.id as i, b.id as j from r a join r b on a.p = b.p and a.id < b.id""")
def rare_pairs(spark, folder):
    """Rows sharing a rare title word: one of at most 3 % of the rows."""
    df = table(spark, folder, "informe")
    return stories.word_pairs(stories.rare_words(df, "row_id", "titulo"), stories.rare_limit(df.count()))


def s_conflict(a: str, b: str) -> str:
    return "(" + " or ".join(f"(list_has_any({a}, {s_list(x)}) and list_has_any({b}, {s_list(y)})) or (list_has_any({a}, {s_list(y)}) and list_has_any({b}, {s_list(x)}))" for x, y in L.OPPOSED) + ")"


@query(f"select row_id, {s_conflict('a', 'b')} as conflicto from (select row_id, {s_distinctive('titulo', 3)} as a, {s_distinctive('resumen_aclaracion', 3)} as b from nota)")
def action_conflict(spark, folder):
    return table(spark, folder, "nota").select("row_id", T.action_conflict(T.distinctive(F.col("titulo"), 3), T.distinctive(F.col("resumen_aclaracion"), 3)).alias("conflicto"))


_EXACT = f"""
t as (select row_id as id, list_filter(regexp_split_to_array(regexp_replace({s_fold("coalesce(titulo, '')")}, '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda x: x <> '') as a,
             list_filter(regexp_split_to_array(regexp_replace({s_fold("coalesce(resumen_aclaracion, '')")}, '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda x: x <> '') as b from nota),
k as (select id, 't' || array_to_string(list_slice(a, 1, 40), ' ') as k from t where len(a) > 0 union all select id, 's' || array_to_string(list_slice(b, 1, 120), ' ') from t where len(b) >= 25),
f as (select k, min(id) as grupo from k group by k),
e as (select distinct k.id, f.grupo from k join f using (k) where k.id <> f.grupo)"""


@query(f"with {_EXACT} select id, grupo from e")
def exact_story_groups(spark, folder):
    return stories.exact_keys(table(spark, folder, "nota"))


@query(f"""
with recursive {_EXACT}, b as (select id as x, grupo as y from e union select grupo, id from e),
r as (select distinct x as id, x as seen from b union select r.id, b.y from r join b on b.x = r.seen)
select id, min(seen) as grupo from r group by id""")
def story_components(spark, folder):
    return graph.components(stories.exact_keys(table(spark, folder, "nota")), "id", "grupo")


@query(f"""
with recursive {_EXACT}, b as (select id as x, grupo as y from e union select grupo, id from e),
r as (select distinct x as id, x as seen from b union select r.id, b.y from r join b on b.x = r.seen), g as (select id, min(seen) as grupo from r group by id),
h as (select row_id, coalesce(g.grupo, row_id) as grupo from nota left join g on g.id = row_id)
select row_id, 'G' || lpad(cast(dense_rank() over (order by grupo) as varchar), 5, '0') as grupo_noticia from h""")
def story_group_ids(spark, folder):
    df = table(spark, folder, "nota")
    return stories.group_ids(df.select("row_id"), graph.components(stories.exact_keys(df), "id", "grupo"))


@query()
def story_groups(spark, folder):
    return stories.story_groups(table(spark, folder, "nota").select("row_id", "titulo", "resumen_aclaracion")).select("row_id", "grupo_noticia")


@query()
def title_fuzzy_pairs(spark, folder):
    """All rows of nearly equal titles."""
    return stories.title_pairs(table(spark, folder, "nota"))


# ---- vectors


@query("""
select q.vec_id as consulta, e.vec_id as vecino, round(list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])), 4) as similitud
from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 50 = 0 and round(list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])), 4) >= 0.3""")
def cosine_search(spark, folder):
    """Stated queries (ids divisible by 50) against all vectors, in blocks."""
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    blocks = 16
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("consulta"), F.col("embedding").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    side = e.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    s = F.round(cosine(F.col("q"), F.col("embedding")), 4)
    return q.join(side, "b").where("consulta != vec_id").select("consulta", F.col("vec_id").alias("vecino"), s.alias("similitud")).where("similitud >= 0.3")


@query("""select label, cast(d as integer) as d, round(avg(x), 4) as media from (select label, unnest(embedding) as x, unnest(range(0, len(embedding))) as d from embeddings) group by all""")
def centroid(spark, folder):
    c = centroids(table(spark, folder, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centro").alias("d", "x")).select("label", "d", F.round("x", 4).alias("media"))


_CENTER = """
c as (select label, list(m order by d) as centro from (select label, d, avg(x) as m from (select label, unnest(cast(embedding as double[])) as x, unnest(range(0, len(embedding))) as d from embeddings) group by label, d) group by label),
s as (select e.label, vec_id, list_cosine_similarity(cast(embedding as double[]), centro) as similitud from embeddings e join c using (label))"""


@query(f"with {_CENTER} select label, arg_min(vec_id, (-round(similitud, 9), vec_id)) as representante, round(max(similitud), 4) as similitud from s group by label")
def medoid(spark, folder):
    return stories.medoids(table(spark, folder, "embeddings"), "label", "vec_id", "embedding").withColumn("similitud", F.round("similitud", 4))


@query(f"""with {_CENTER}, t as (select label, avg(similitud) - 2 * stddev_pop(similitud) as u from s group by label having count(*) >= 3)
select label, vec_id, similitud < greatest(0.6, u) as fuera from s join t using (label)""")
def outliers(spark, folder):
    return stories.outliers(table(spark, folder, "embeddings"), "label", "vec_id", "embedding").select("label", "vec_id", "fuera")


@query(f"""with {_CENTER}, t as (select label, avg(similitud) - 2 * stddev_pop(similitud) as u from s group by label having count(*) >= 3),
o as (select s.label, vec_id, similitud from s join t using (label) where similitud < greatest(0.1, u)),
m as (select o.vec_id, c.label, round(list_cosine_similarity(cast(e.embedding as double[]), centro), 9) as x, o.similitud from o join embeddings e using (vec_id) join c on c.label <> o.label)
select o.vec_id, b.label as label_nueva from o left join (select vec_id, arg_min(label, (-x, label)) as label from m where x > greatest(similitud, 0.05) group by vec_id) b using (vec_id)""")
def reassigned(spark, folder):
    """Vectors far from their label's mean, and the label whose mean fits better (lower limits than a run's, so that these data have cases)."""
    return stories.reassign(table(spark, folder, "embeddings"), "label", "vec_id", "embedding", jump=0.05, floor=0.1).select("vec_id", "label_nueva")


@query(f"""with {_CENTER.split('s as (select')[0].rstrip().rstrip(',')}
select a.label as a, b.label as b, round(list_cosine_similarity(a.centro, b.centro), 6) as similitud, cast(row_number() over (order by round(list_cosine_similarity(a.centro, b.centro), 9) desc, a.label, b.label) as bigint) as puesto from c a join c b on a.label < b.label""")
def sorted_pairs(spark, folder):
    """All pairs of labels by the similarity of their means, the most similar first."""
    means, _ = Scratch(spark, "means").save(numbering.numbered(centroids(table(spark, folder, "embeddings"), "label", "embedding"), ["label"], "k"))
    pairs = alike.vector_pairs(means.select("k", F.col("centro").alias("v")), -1.0).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "s")
    named = pairs.join(means.select(F.col("k").alias("x"), F.col("label").alias("a")), "x").join(means.select(F.col("k").alias("y"), F.col("label").alias("b")), "y")
    ranked = numbering.numbered(named.withColumn("_o", -F.round("s", 9)), ["_o", "a", "b"], "puesto", 1)
    return ranked.select("a", "b", F.round("s", 6).alias("similitud"), F.col("puesto").cast("bigint").alias("puesto"))

@query(f"with {_CENTER} select label, vec_id, similitud >= 0.35 as pertenece from s")
def membership(spark, folder):
    return stories.membership(table(spark, folder, "embeddings"), "label", "vec_id", "embedding", 0.35).select("label", "vec_id", "pertenece")


# ---- labels and tone


@query(f"""
with w as (select coalesce(marca, '') as marca, row_id, unnest(l) as p, unnest(range(0, len(l))) as pos from (select marca, row_id, {s_label_words('titulo')} as l from nota)),
c as (select marca, p as palabra, count(*) as n, min(row_id * 100000 + pos) as f from w where length(p) >= 4 group by 1, 2),
r as (select *, row_number() over (partition by marca order by n desc, f) as puesto from c)
select marca, palabra, n, cast(puesto as integer) as puesto from r where puesto <= 10""")
def top_keywords(spark, folder):
    df = table(spark, folder, "nota").withColumn("marca", F.coalesce("marca", F.lit("")))
    return labeling.top_words(df, "marca", "row_id", "titulo", 10)


_VOID = "(" + ", ".join(f"'{v}'" for v in labeling.VOID) + ")"


@query(f"""
with w as (select row_id, tema, array_to_string({s_label_words('subtema')}, ' ') as k from informe),
v as (select k, tema, count(*) as n, min(row_id) as o from w where k not in {_VOID} and lower(trim(coalesce(tema, ''))) not in {_VOID} group by 1, 2),
b as (select k, arg_min(tema, (-n, o)) as t from v group by k)
select row_id, coalesce(b.t, w.tema) as tema from w left join b using (k)""")
def majority_label(spark, folder):
    return labeling.majority_topic(table(spark, folder, "informe").select("row_id", "tema", "subtema")).select("row_id", "tema")


@query()
def canonical_labels(spark, folder):
    return labeling.canonical_labels(table(spark, folder, "informe").select("row_id", "subtema"), "subtema")


@query("select coalesce(tema, '') as tema, count(*) as n, cast(row_number() over (order by count(*) desc, min(row_id)) as bigint) as puesto from informe group by 1")
def group_sizes(spark, folder):
    """Groups from the largest to the smallest, on ties the one seen first."""
    df = table(spark, folder, "informe").select("row_id", F.coalesce("tema", F.lit("")).alias("tema"))
    return subtopics.group_sizes(df, "tema", "row_id").select("tema", "n", F.col("puesto").cast("bigint").alias("puesto"))


@query(f"""
with h as (select *, row_number() over (partition by marca order by row_id) as k from (select row_id, titulo, coalesce(marca, '') as marca from nota)),
w as (select marca, row_id, unnest(l) as p, unnest(range(0, len(l))) as pos from (select marca, row_id, {s_label_words('titulo')} as l from h where k <= 30)),
c as (select marca, p, count(*) as n, min(row_id * 100000 + pos) as f from w where length(p) >= 4 group by 1, 2),
r as (select *, row_number() over (partition by marca order by n desc, f) as puesto from c),
t as (select marca, string_agg(p, ' ' order by puesto) as x from r where puesto <= 12 group by 1)
select marca, left(marca || '. ' || marca || '. ' || coalesce(x, ''), 500) as texto from (select distinct marca from h) left join t using (marca)""")
def group_text(spark, folder):
    """What represents a group: its label and the commonest words of its first texts."""
    df = table(spark, folder, "nota").select("row_id", "titulo", F.coalesce("marca", F.lit("")).alias("marca"))
    return topics.group_text(df, "marca", "row_id", "titulo")


_TITLE3 = s_strip("coalesce(titulo, '')")


@query(f"""
with t as (select left({_TITLE3} || '. ' || {_TITLE3} || '. ' || {_TITLE3} || '. ' || {s_strip("coalesce(resumen_aclaracion, '')")}, 1800) as x from nota),
n as (select count(*) as total, count(distinct md5(x)) as misses from t)
select 'Cache: ' || (total - misses) || ' hits, ' || misses || ' misses (' || cast(case when total > 0 then round_even(100.0 * (total - misses) / total, 0) else 0 end as bigint) || '%)' as texto from n""")
def cache_stats(spark, folder):
    """How many texts need no embedding of their own."""
    return D.cache_stats(table(spark, folder, "nota").select(F.md5(T.embedding_text(F.col("titulo"), F.col("resumen_aclaracion")).cast("binary")).alias("k")), "k")


_JOINED = s_mention("string_agg(titulo, ' ' order by row_id)")
_ACTION = " ".join(f"when regexp_matches(x, ' ({'|'.join(words)}) ') then '{name}'" for words, name in L.ACTIONS)
_FALL = f"""
h as (select * from (select *, row_number() over (partition by marca order by row_id) as k from (select row_id, coalesce(titulo, '') as titulo, coalesce(marca, '') as marca from nota)) where k <= 5),
j as (select marca, ' ' || {_JOINED} || ' ' as x from h group by marca),
w as (select marca, row_id, unnest(l) as p, unnest(range(0, len(l))) as pos from (select marca, row_id, {s_label_words('titulo')} as l from h)),
c as (select marca, p, count(*) as n, min(row_id * 100000 + pos) as f from w where length(p) >= 4 and not list_contains({s_list(L.FALLBACK_EMPTY)}, p) group by 1, 2),
r as (select *, row_number() over (partition by marca order by n desc, f) as puesto from c),
q as (select marca, list(p order by puesto) as w from r where puesto <= 3 group by marca),
z as (select j.marca, case {_ACTION} end as accion, coalesce(q.w, []) as w from j left join q using (marca)),
y as (select *, accion || ' de ' || array_to_string(w, ' ') as a0, w[1] || ' de ' || w[2] as b from z),
v as (select *, {s_trim('a0', 5)} as a from y)"""


def s_not_empty(x: str) -> str:
    return f"len(list_filter(string_split({s_mention(x)}, ' '), lambda t: t <> '' and not list_contains({s_list(L.BRAND_EMPTY)}, t))) > 0"


@query(f"""with {_FALL}, e as (select marca, case when len(w) = 0 then null when accion is not null and {s_complete('a')} and {s_not_empty('a')} then a when len(w) >= 2 and {s_complete('b')} and {s_not_empty('b')} then b
  when len(w) >= 2 then 'Asuntos de ' || w[1] || ' y ' || w[2] else 'Asuntos relacionados con ' || w[1] end as l from v)
select marca, case when l is null then '{L.FALLBACK_LABEL}' else {s_capitalise('l')} end as etiqueta from e""")
def fallback_labels(spark, folder):
    df = table(spark, folder, "nota").select("row_id", "titulo", F.coalesce("marca", F.lit("")).alias("marca"))
    return labeling.fallback_labels(df, "marca")


@query("""
with c as (select lote, id_noticia, bool_or(tono = 'Positivo') as p, bool_or(tono = 'Negativo') as n from (select *, coalesce(tono, '') as t from informe) group by 1, 2)
select i.row_id, case when coalesce(i.tono, '') in ('Neutro', 'N/A', '', 'Nan') and coalesce(p, false) and not coalesce(n, false) then 'Positivo'
                      when coalesce(i.tono, '') in ('Neutro', 'N/A', '', 'Nan') and coalesce(n, false) and not coalesce(p, false) then 'Negativo' else i.tono end as tono
from informe i join c on c.lote = i.lote and c.id_noticia = i.id_noticia""")
def tone_propagation(spark, folder):
    """Neutral tones take the pole of the records delivered under the same id in the same run."""
    df = table(spark, folder, "informe").select("row_id", "lote", "id_noticia", "tono")
    first = df.groupBy("lote", "id_noticia").agg(F.min("row_id").alias("grupo"))
    groups = df.join(first, ["lote", "id_noticia"]).select(F.col("row_id").alias("id"), "grupo")
    return tone.propagate(df, groups, "row_id", "tono").select("row_id", "tono")


@query()
def tone_equivalent(spark, folder):
    return tone.equivalent_pairs(table(spark, folder, "nota"))


@query()
def contained_labels(spark, folder):
    return labeling.merge_contained(table(spark, folder, "informe").select("row_id", "subtema"), "subtema")


@query()
def topic_repeats_subtopic(spark, folder):
    return table(spark, folder, "informe").select("row_id", labeling.same_as_subtopic(F.col("tema"), F.col("subtema")).alias("igual"))


@query()
def title_leaders(spark, folder):
    return stories.title_leaders(table(spark, folder, "nota"))


# ---- whole runs


@query()
def run_dossier(spark, folder):
    return pipeline.full(table(spark, folder, "clipping"), table(spark, folder, "mapa_region"), table(spark, folder, "mapa_internet"), "Lumbral", ["Banco Orquidal"]).drop("cuerpo_completo", "link_nota", "link_streaming")


@query()
def run_quick(spark, folder):
    return pipeline.quick(table(spark, folder, "nota"), "Lumbral", [])


@query()
def run_custom(spark, folder):
    return pipeline.custom(table(spark, folder, "nota"), "Lumbral", []).select("row_id", "tono_ia", "tema", "subtema", "origen_coincidencia")


@query()
def run_sentiment(spark, folder):
    return pipeline.sentiment(table(spark, folder, "nota"), "Lumbral", []).select("row_id", "tono_ia", "confianza_tono", "marca_encontrada")
