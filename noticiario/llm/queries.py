"""The registered queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import DataFrame, SparkSession

from noticiario.llm import components, fusion, happenings, leakage, ledger, neardup, packing, splitting

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.survivors(_table(spark, folder, "informe"))


def p1_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.fuse(_table(spark, folder, "informe"))


def p1_votes(spark: SparkSession, folder: str) -> DataFrame:
    """What the model is fitted on: the distinct values of each group's fields."""
    return fusion.votes(_table(spark, folder, "informe"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_pairs(_table(spark, folder, "nota"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_classes(_table(spark, folder, "nota"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.linked_records(_table(spark, folder, "coincidencia"), _table(spark, folder, "informe"), "noticia_id", "id_duplicada", "id_noticia")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return happenings.found(_table(spark, folder, "informe"))


def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return happenings.describe(_table(spark, folder, "informe"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.repeated_rows(_table(spark, folder, "clipping"))


def p5_copies(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.copies(_table(spark, folder, "clipping"))


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.found(_table(spark, folder, "documents"), _table(spark, folder, "prueba_eval"))


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.scrub(_table(spark, folder, "documents"), _table(spark, folder, "prueba_eval"))


def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without any leaked passage."""
    return leakage.scrub(_table(spark, folder, "documents"), _table(spark, folder, "prueba_eval"), remove="documents").select("doc_id")


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.pieces(_table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_fusion, p1_votes, p2_found, p2_classes, p3_found, p4_found, p4_clusters, p5_found, p5_copies, p6_pack, p7_found, p7_clean, p7_kept, p8_pieces)}

_NOTHING = ", ".join(f"'{w}'" for w in fusion.NOTHING)


def _decoded(x: str) -> str:
    """Named references of the Latin-1 block and of quotes and dashes in SQL, also when escaped twice."""
    x = f"replace({x}, '&amp;', '&')"
    for name, cp in sorted(name2codepoint.items()):
        if name != "amp" and (160 <= cp < 256 or cp in (34, 60, 62) or 0x2010 <= cp <= 0x2026):
            x = f"replace({x}, '&{name};', chr({cp}))"
    return x


def _word_list(x: str) -> str:
    """The words of a text, in order: entities decoded, tags separating, invisible characters dropped, folded."""
    s = f"regexp_replace({_decoded(x)}, '</?[A-Za-z!][^<>]*>', ' ', 'g')"
    s = f"regexp_replace({s}, '[\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}]', '', 'g')"
    return f"regexp_extract_all(lower(strip_accents({s})), '[a-z0-9]+')"


def _windows(key: str, table: str) -> str:
    return f"select {key}, array_to_string(list_slice(w, i, i + 11), ' ') as g from (select {key}, w, unnest(range(1, len(w) - 10)) as i from (select {key}, {_word_list('text')} as w from {table}))"


def _close(x: str, y: str) -> str:
    return f"({x} = {y} or (least(length({x}), length({y})) >= 4 and abs(length({x}) - length({y})) <= 2 and damerau_levenshtein({x}, {y}) <= case when least(length({x}), length({y})) < 6 then 1 else 2 end))"


#: Happenings as connected rows: every two rows that share a party, agree in another one and in enough of the matter, misspellings allowed.
_HAPPENINGS = f"""
with recursive t as (select row_id, regexp_replace({_decoded('titulo')}, '\\s+[|–—-]\\s+[^|–—-]+$', '') as s from informe),
w as (select row_id, unnest(l) as word, unnest(range(0, len(l))) as pos from (select row_id, regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+') as l from t)),
f as (select row_id, pos, word, lower(strip_accents(word)) as p, lag(lower(strip_accents(word))) over (partition by row_id order by pos) as before from w),
m as (select row_id, count(*) filter (regexp_matches(word, '^\\p{{L}}')) as letters, count(*) filter (regexp_matches(word, '^\\p{{Ll}}')) as low from f group by 1),
k as (select p, count(*) as n, count(*) filter (before in ({", ".join(f"'{x}'" for x in sorted(happenings.OF_PLACE))})) as place, count(*) filter (pos > 0 and letters > m.low and 3 * m.low >= letters and not regexp_matches(word, '^\\p{{Lu}}')) as low,
  count(*) filter (pos > 0 and letters > m.low and 3 * m.low >= letters and regexp_matches(word, '^\\p{{Lu}}')) as cap from f join m using (row_id) where regexp_full_match(p, '[a-z]{{2,}}') and p not in ({", ".join(f"'{x}'" for x in sorted(happenings.EMPTY))}) group by p),
names as (select p from k where (cap + low = 0 or cap >= {happenings.NAME} * (cap + low)) and place < {happenings.PLACE} * n),
r as (select row_id, list_distinct(list(p) filter (p in (from names))) as nombres, list_distinct(list(p) filter (p not in (from names) and p not in ({", ".join(f"'{x}'" for x in sorted(happenings.EMPTY))}) and (length(p) > 1 or regexp_full_match(p, '[0-9]')))) as otras from f group by row_id),
c as (select distinct a.row_id as x, b.row_id as y from (select row_id, unnest(nombres) as p from r) a join (select row_id, unnest(nombres) as p from r) b on a.p = b.p and a.row_id < b.row_id),
e as (select x, y from c join r a on a.row_id = x join r b on b.row_id = y
  where len(list_filter(a.nombres, lambda i: len(list_filter(b.nombres, lambda j: {_close('i', 'j')})) > 0)) >= 2
  and len(list_filter(a.otras, lambda i: len(list_filter(b.otras, lambda j: {_close('i', 'j')})) > 0)) >= {happenings.MATTER} * least(len(a.otras), len(b.otras))),
z as (select x, y from e union select y, x from e),
reach as (select distinct x as id, x as seen from z union select reach.id, z.y from reach join z on z.x = reach.seen),
g as (select id, min(seen) as cluster from reach group by id)
select id as row_id, cluster from g where cluster in (select cluster from g group by cluster having count(*) >= 3)"""

ORACLE: dict[str, str] = {
    "p4_found": _HAPPENINGS,
    "p7_found": f"select distinct doc_id, item_id from ({_windows('doc_id', 'documents')}) d join ({_windows('item_id', 'prueba_eval')}) e using (g)",
    "p7_kept": f"""
with hits as (select distinct doc_id from ({_windows('doc_id', 'documents')}) d join ({_windows('item_id', 'prueba_eval')}) e using (g))
select doc_id from documents where doc_id not in (select doc_id from hits)""",
    "p2_found": f"""
with t as (select row_id, {_decoded("coalesce(titulo, '') || ' ' || coalesce(resumen_aclaracion, '')")} as s from nota),
w as (select distinct row_id, unnest(regexp_extract_all(lower(strip_accents(regexp_replace(s, '</?[A-Za-z!][^<>]*>', ' ', 'g'))), '[a-z0-9]+')) as w from t),
n as (select row_id, count(*) as n from w group by 1),
c as (select a.row_id as x, b.row_id as y, count(*) as k from w a join w b on a.w = b.w and a.row_id < b.row_id group by 1, 2)
select x as row_id_a, y as row_id_b from c join n a on a.row_id = x join n b on b.row_id = y where 10 * k >= 7 * (a.n + b.n - k)""",
    "p2_classes": f"""
with t as (select row_id, {_decoded("coalesce(titulo, '') || ' ' || coalesce(resumen_aclaracion, '')")} as s from nota),
l as (select row_id, list_sort(list_distinct(regexp_extract_all(lower(strip_accents(regexp_replace(s, '</?[A-Za-z!][^<>]*>', ' ', 'g'))), '[a-z0-9]+'))) as l from t),
k as (select row_id, l, case when len(l) > 0 then min(row_id) over (partition by l) else row_id end as clase from l),
r as (select clase, l, len(l) as n from k where row_id = clase and len(l) > 0),
w as (select clase, unnest(l) as w from r),
c as (select a.clase as x, b.clase as y, count(*) as k from w a join w b on a.w = b.w and a.clase <> b.clase group by 1, 2),
e as (select x, count(*) as enlaces from c join r a on a.clase = x join r b on b.clase = y where 10 * k >= 7 * (a.n + b.n - k) group by x)
select row_id, k.clase, coalesce(enlaces, 0) as enlaces from k left join e on e.x = k.clase""",
    "p5_copies": f"""
with t as (select row_id, lower(nfc_normalize({_decoded('titulo')})) as s from clipping),
k as (select row_id, list_sort(list_filter(list_transform(string_split(s, '|'), lambda p: regexp_replace(p, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), lambda p: p <> '')) as k from t)
select md5(array_to_string(k, '|')) as clave, min(row_id) as primera_row_id, count(*) as copias from k where len(k) > 0 group by k""",
    "p5_found": f"""
with t as (select row_id, lower(nfc_normalize({_decoded('titulo')})) as s from clipping),
k as (select row_id, list_sort(list_filter(list_transform(string_split(s, '|'), lambda p: regexp_replace(p, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), lambda p: p <> '')) as k from t),
g as (select k, min(row_id) as primera from k where len(k) > 0 group by k having count(*) > 1)
select row_id, primera as primera_row_id from k join g using (k)""",
    "p1_votes": f"""
with base as (
  select lote, row_id, tono_ia, tema, subtema, nullif(regexp_extract(grupo_noticia, '([0-9]+)', 1), '') as digits,
         case lower(regexp_replace(coalesce(origen_etiqueta, ''), '^\\s+|\\s+$', '', 'g')) when 'analista' then 0 when 'modelo' then 1 when 'regla' then 2 else 3 end as trust
  from informe),
g as (select *, 'G' || lpad(cast(cast(digits as bigint) as varchar), cast(greatest(5, length(cast(cast(digits as bigint) as varchar))) as integer), '0') as g from base where digits is not null),
f as (select lote, g, trust, 'tono_ia' as campo, tono_ia as v from g union all select lote, g, trust, 'tema', tema from g union all select lote, g, trust, 'subtema', subtema from g),
k as (select *, regexp_replace(strip_accents(lower(coalesce(v, ''))), '[^a-z0-9]+', '', 'g') as clave from f)
select lote, g as grupo_noticia, campo, clave, count(*) as votos, count(distinct trust) as fuentes from k where clave not in ({_NOTHING}) group by all""",
    "p1_found": f"""
with base as (
  select lote, row_id, coalesce(actualizado, timestamp '0001-01-01') as momento, tono_ia, tema, subtema,
         nullif(regexp_extract(grupo_noticia, '([0-9]+)', 1), '') as digits,
         case lower(regexp_replace(coalesce(origen_etiqueta, ''), '^\\s+|\\s+$', '', 'g')) when 'analista' then 0 when 'modelo' then 1 when 'regla' then 2 else 3 end as trust
  from informe),
grouped as (select *, 'G' || lpad(cast(cast(digits as bigint) as varchar), cast(greatest(5, length(cast(cast(digits as bigint) as varchar))) as integer), '0') as g,
            count(*) over (partition by lote, cast(digits as bigint)) as n from base where digits is not null),
fields as (select lote, g, n, row_id, momento, trust, 'tono_ia' as campo, tono_ia as v from grouped
           union all select lote, g, n, row_id, momento, trust, 'tema', tema from grouped
           union all select lote, g, n, row_id, momento, trust, 'subtema', subtema from grouped),
said as (select * from fields where n >= 2
         and regexp_replace(strip_accents(lower(coalesce(v, ''))), '[^a-z0-9]+', '', 'g') not in ({_NOTHING}))
select lote, g as grupo_noticia, campo, row_id from (
  select *, row_number() over (partition by lote, g, campo order by trust, momento desc, row_id) as k from said) where k = 1""",
    "p3_found": """
with recursive spelt as (
  select a, b from (select trim(noticia_id, chr(160) || ' ') as x, trim(id_duplicada, chr(160) || ' ') as y from coincidencia) t,
  lateral (select case when regexp_full_match(x, '[0-9]+') then try_cast(x as bigint)
                       when regexp_full_match(x, '[0-9]{1,3}([.][0-9]{3})+|[0-9]{1,3}(,[0-9]{3})+') then try_cast(regexp_replace(x, '[.,]', '', 'g') as bigint)
                       when regexp_full_match(x, '[0-9.]+([eE][+-]?[0-9]+)?') and try_cast(x as double) = floor(try_cast(x as double)) then try_cast(try_cast(x as double) as bigint) end as a,
                  case when regexp_full_match(y, '[0-9]+') then try_cast(y as bigint)
                       when regexp_full_match(y, '[0-9]{1,3}([.][0-9]{3})+|[0-9]{1,3}(,[0-9]{3})+') then try_cast(regexp_replace(y, '[.,]', '', 'g') as bigint)
                       when regexp_full_match(y, '[0-9.]+([eE][+-]?[0-9]+)?') and try_cast(y as double) = floor(try_cast(y as double)) then try_cast(try_cast(y as double) as bigint) end as b)),
links as (select distinct a, b from spelt where a <> b and a in (select id_noticia from informe) and b in (select id_noticia from informe)),
both_ways as (select a, b from links union select b, a from links),
reach as (select distinct a as id, a as seen from both_ways union select r.id, e.b from reach r join both_ways e on e.a = r.seen)
select id as noticia_id, min(seen) as grupo from reach group by id""",
}
