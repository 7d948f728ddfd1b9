import random
import time
from collections import Counter
from difflib import SequenceMatcher
from functools import cache
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticiario.functions.labels import conflict_bits, distinctive, embedding_text, title_norm
from noticiario.functions.vectors import agglomerate
from noticiario.functions.ratio import ratio_of
from noticiario.operators import alike
from noticiario.operators import brand as B
from noticiario.operators import dossier as D
from noticiario.operators import duplicates as U
from noticiario.operators import graph, labeling, stories, tone
from noticiario.operators.numbering import numbered
from noticiario.operators.skew import skew_join


def brute_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)] + [(None, 3), (7, 7), (500, 501), (501, 500)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    for few in (10**6, 0):
        assert {r.id: r.grupo for r in graph.components(df, few=few).collect()} == brute_components(edges)


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_skew_join_is_a_join(spark):
    left = spark.createDataFrame([(i % 5 if i % 7 else None, i) for i in range(200)], "k int, v int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "k int, w string")
    for how in ("inner", "left"):
        plain = sorted(map(str, left.join(right, "k", how).select("k", "v", "w").collect()))
        for least in (1, 20, 10**6):
            assert sorted(map(str, skew_join(left, right, ["k"], how, share=0.01, least=least).select("k", "v", "w").collect())) == plain


def test_numbered(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(3).sample(range(1000), 300)], "x int")
    out = sorted((r.x, r.n) for r in numbered(df, ["x"], "n").collect())
    assert [n for _, n in out] == list(range(300))


def test_explode_mentions(spark):
    df = spark.createDataFrame([(1, "A; B ;;C"), (2, ""), (3, None), (4, " ; ")], "row_id bigint, menciones_empresa string")
    out = [tuple(r) for r in D.expanded_index(D.explode_mentions(df)).orderBy("expanded_index").select("expanded_index", "row_id", "posicion", "mencion").collect()]
    assert out == [(0, 1, 0, "A"), (1, 1, 1, "B"), (2, 1, 2, "C"), (3, 2, 0, ""), (4, 3, 0, ""), (5, 4, 0, "")]


def test_normalize(spark):
    rows = [
        (1, "x1", "05/06/2024", "Radio Uno", "FM", "T&iacute;tulo", "7", "60", 10.0, 20.0, "A;B", "C", "http://r.com.ar/1", "http://i/1", "http://n/1", "a<br>b"),
        (2, "x2", "2024-06-05", " diario dos ", "online", "T", "7", "60", 10.0, 20.0, "A;B", "C", "http://r/1", "http://i/2", "http://n/2", "a<br>  <br>b"),
        (3, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
        (4, "x4", "31/02/2024", "Tres", "tv", None, "1,5", None, None, None, None, None, None, None, None, ""),
    ]
    names = "row_id bigint, noticia_id string, fecha string, medio string, tipo_de_medio string, titulo string, dimensioncm2 string, duracion_nro_caracteres string, cpe double, valor_de_nota double, menciones_empresa string, empresa_rel string, url_nota_av string, url_streaming_imagen string, url_nota string, cuerpo_es string"
    maps = spark.createDataFrame([(1, "radio uno", "Norte"), (2, " RADIO UNO", "Sur"), (3, None, None), (4, "", "x"), (5, "diario dos", "Dos")], "row_id bigint, clave string, valor string")
    out = {r.row_id: r for r in D.normalize(spark.createDataFrame(rows, names), maps, maps).collect()}
    assert sorted(out) == [1, 2, 4]
    a, b, c = out[1], out[2], out[4]
    assert (str(a.fecha), a.tipo_de_medio, a.region, a.titulo, a.dimension, a.duracion, a.cpe, a.link_nota.url, a.link_streaming, a.menciones_empresa, a.resumen_aclaracion) == ("2024-06-05", "Radio", "Sur", "Título", "60", "0", 10.0, "http://r.com.co/1", None, "A;B", "a\nb")
    assert (str(b.fecha), b.medio, b.region, b.cpe, b.link_nota.url, b.link_streaming.url, b.menciones_empresa, b.resumen_aclaracion) == ("2024-06-05", "Dos", "Dos", 20.0, "http://i/2", "http://n/2", "C", "a\n\nb")
    assert (c.fecha, c.tipo_de_medio, c.region, c.cpe) == (None, "tv", "N/A", None)


def test_duplicate_rules(spark):
    link = "struct<value:string,url:string>"
    n = lambda u: None if u is None else ("Link", u)
    rows = [
        (0, "a", "Internet", "M", "x", "1", n("http://www.u.com/1/"), n("s.com/1"), "Sube el precio del pan en la ciudad"),
        (1, "b", "Internet", "M", "x", "1", n("q"), n("https://s.com/1/"), "otra cosa"),  # same streaming link as 0
        (2, "c", "Internet", "M", "x", "1", n("https://u.com/1"), None, "algo"),  # same note link as 0
        (3, "d", "Internet", "M", "x", "1", n("v"), None, "Sube el precio del pan en la ciudad hoy"),  # longer title: 0 repeats it
        (4, "e", "radio", "R", "x", " 9:00", None, None, "t"),
        (5, "f", "FM", "r", "X", "9:00", None, None, "u"),  # same slot as 4
        (6, "g", "Internet", "M", "", "1", n("v"), None, "Sube el precio del pan en la ciudad hoy"),  # no mention
        (7, "h", "Internet", "M", "x", "1", n("w"), None, "Sube el precio del pan en la ciudad hoy"),  # copy of 3
    ]
    df = spark.createDataFrame(rows, f"expanded_index bigint, id_noticia string, tipo_de_medio string, medio string, mencion string, hora string, link_nota {link}, link_streaming {link}, titulo string")
    out = {r.expanded_index: (r.is_duplicate, r.id_duplicada) for r in U.mark_duplicates(df).collect()}
    assert out == {0: (True, "d"), 1: (True, "a"), 2: (True, "a"), 3: (False, None), 4: (False, None), 5: (True, "e"), 6: (False, None), 7: (True, "d")}


def test_similar_titles_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(10, 60))) for _ in range(40)]
    titles = list(dict.fromkeys(base + [t[:-1] for t in base] + [t + "z" for t in base[:10]]))
    rows = [("g", i, i, t) for i, t in enumerate(titles)]
    out = U.similar_titles(spark.createDataFrame(rows, "grupo string, k bigint, o bigint, t string"), 0.92, block=15)
    from difflib import SequenceMatcher

    want = {(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if SequenceMatcher(None, titles[i], titles[j]).ratio() >= 0.92}
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_brand(spark):
    assert B.variants("Universidad Tecnológica de Bolívar", ["UTB", " utb "]) == ["Universidad Tecnológica de Bolívar", "UTB"]
    names = B.variants("Banco Orquidal", None)
    texts = ["El Banco Orquidal crece", "el bo crece", "banco de arena", "Orquidal y el banco", "Banca Orquidall crece", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    from noticiario.functions.labels import mention_norm

    assert [r[0] for r in df.orderBy("i").select(B.mentions(mention_norm(F.col("x")), names)).collect()] == [True, True, False, True, False, False, False]
    assert B.fuzzy("orquidall crece", ["Orquidal"]) and not B.fuzzy("cosa", ["Orquidal"])
    assert B.context("Título", "Nada aquí. El banco Orquidal crece. Fin.", names) == "Nada aquí. Título El banco Orquidal crece."
    only = df.sparkSession.createDataFrame([("Banco Orquidal",), ("Banco de arena",), ("de la",)], "x string").select(B.only_brand(F.col("x"), names))
    assert [r[0] for r in only.collect()] == [True, False, True]


def test_audit(spark):
    rows = [(1, "Sube Lumbral", "Nada. Lumbral crece mucho. Fin."), (2, "Otra", None), (3, None, "Grupo Lumbral")]
    out = {r.row_id: r for r in B.audit(spark.createDataFrame(rows, "row_id bigint, titulo string, resumen_aclaracion string"), "Lumbral").collect()}
    assert (out[1].marca_encontrada, out[1].origen_coincidencia, out[1].coincidencia_marca) == ("Sí", "Título, Resumen", "Lumbral")
    assert out[1].contexto_analizado == "Sube Lumbral Lumbral crece mucho. Nada. Fin"
    assert (out[2].marca_encontrada, out[2].contexto_analizado) == ("No", "")
    assert out[3].origen_coincidencia == "Resumen"


def test_labels_of_groups(spark):
    df = spark.createDataFrame([(1, "g", "Firma de convenio agrícola"), (2, "g", "Convenio agrícola avanza"), (3, "h", None)], "row_id bigint, g string, titulo string")
    out = {r.g: r.etiqueta for r in labeling.fallback_labels(df, "g").collect()}
    assert out == {"g": "Convenio de convenio agrícola firma", "h": "Cobertura de información relevante"}


def test_majority_topic(spark):
    rows = [(1, "A", "Plan de salud"), (2, "B", "plan salud"), (3, "B", "Plan de salud"), (4, "C", ""), (5, None, "Plan salud")]
    out = {r.row_id: r.tema for r in labeling.majority_topic(spark.createDataFrame(rows, "row_id bigint, tema string, subtema string")).collect()}
    assert out == {1: "B", 2: "B", 3: "B", 4: "C", 5: "B"}


def test_canonical_labels(spark):
    rows = [(1, "Plan de salud rural"), (2, "Plan de salud rural"), (3, "Plan salud rural"), (4, "Otra cosa distinta"), (5, None)]
    out = {r.etiqueta: r.canonica for r in labeling.canonical_labels(spark.createDataFrame(rows, "row_id bigint, s string"), "s").collect()}
    assert out["Plan salud rural"] == out["Plan de salud rural"] == "Plan de salud rural" and out["Otra cosa distinta"] == "Otra cosa distinta"


def test_tone(spark):
    rows = [(1, "Neutro"), (2, "Positivo"), (3, "Neutro"), (4, "Negativo"), (5, "Positivo"), (6, None)]
    groups = [(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 1)]
    out = tone.propagate(spark.createDataFrame(rows, "row_id bigint, tono_ia string"), spark.createDataFrame(groups, "id bigint, grupo bigint"))
    assert {r.row_id: r.tono_ia for r in out.collect()} == {1: "Positivo", 2: "Positivo", 3: "Neutro", 4: "Negativo", 5: "Positivo", 6: "Positivo"}


def test_group_ids_are_dense(spark):
    df = spark.createDataFrame([(i,) for i in (5, 7, 9, 11)], "row_id bigint")
    out = {r.row_id: r.grupo_noticia for r in stories.group_ids(df, spark.createDataFrame([(9, 5), (5, 5)], "id bigint, grupo bigint")).collect()}
    assert out == {5: "G00001", 9: "G00001", 7: "G00002", 11: "G00003"}


def test_agglomerate():
    s = np.array([[1, 0.9, 0.1], [0.9, 1, 0.1], [0.1, 0.1, 1]])
    assert agglomerate(s, 0.8).tolist() == [0, 0, 1]
    assert agglomerate(s, 0.95).tolist() == [0, 1, 2]


def test_runs_on_odd_tables(spark):
    from noticiario.plans import pipeline

    schema = "row_id bigint, titulo string, resumen_aclaracion string, tema string, _k string"
    rows = [(1, None, None, "x", "y"), (2, "", "", None, None), (3, "Lumbral sube " * 300, "z" * 5000, None, None), (4, "Lumbral gana premio", "Bien.", None, None), (5, "Lumbral gana premio", "Bien.", None, None)]
    out = {r.row_id: r for r in pipeline.custom(spark.createDataFrame(rows, schema), "Lumbral", []).collect()}
    assert len(out) == 5 and out[4].tono_ia == "Positivo" and out[4].subtema == out[5].subtema
    assert pipeline.custom(spark.createDataFrame([], schema), "Lumbral", []).count() == 0


def test_leader_clusters(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9)], "a bigint, b bigint")
    assert {r.id: r.lider for r in stories.leader_clusters(pairs).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 8: 8, 9: 8}


def test_contained_labels(spark):
    rows = [(1, "Plan de salud rural nuevo"), (2, "Plan de salud rural nuevos"), (3, "Otra cosa")]
    out = {r.etiqueta: r.mayor for r in labeling.merge_contained(spark.createDataFrame(rows, "row_id bigint, s string"), "s").collect()}
    assert out == {rows[0][1]: rows[1][1], rows[1][1]: rows[1][1], "Otra cosa": "Otra cosa"}
    same = spark.createDataFrame([("Salud", "Plan de salud"), ("Banca", "Pesca"), (None, "x")], "a string, b string").select(labeling.same_as_subtopic(F.col("a"), F.col("b")))
    assert [r[0] for r in same.collect()] == [True, False, False]


def test_rare_word_pairs(spark):
    rows = [(1, "Inauguran biblioteca popular", [1.0, 0.0]), (2, "La biblioteca abre", [1.0, 0.1]), (3, "biblioteca sin datos", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "row_id bigint, titulo string, v array<double>")
    assert [tuple(r) for r in stories.rare_word_pairs(df, "row_id", "titulo", "v", 100).collect()] == [(1, 2)]


def test_rare_words_meet_by_vectors_first(spark, monkeypatch):
    """Rows that share a rare word are many, those with close vectors few: pairs of the first don't travel."""
    monkeypatch.setattr(stories, "word_pairs", lambda *a, **k: 1 / 0)
    rng = np.random.default_rng(6)
    words = "puente vivero museo cosecha lluvia tarifa".split()
    rows = [(k, " ".join(rng.choice(words, 2)) + (" aprueba" if k % 9 == 0 else " rechaza" if k % 9 == 1 else ""), [float(x) for x in rng.normal(size=3)]) for k in range(60)] + [(60, None, [1.0, 0.0, 0.0]), (61, "puente", None), (62, "puente", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "row_id bigint, titulo string, v array<double>")
    held = {k: {w for w in (t or "").split() if len(w) >= 5 and w not in stories.L.RARE_STOP} for k, t, _ in rows}
    said = {k: t or "" for k, t, _ in rows}
    many = {w: sum(w in h for h in held.values()) for w in set().union(*held.values())}
    unit = {k: np.array(v) / (np.linalg.norm(v) or 1) for k, _, v in rows if v}
    clash = lambda a, b: ("aprueba" in a) and ("rechaza" in b)
    want = {(i, j) for i in unit for j in unit if i < j and any(2 <= many[w] <= 21 for w in held[i] & held[j]) and unit[i] @ unit[j] >= 0.86 and not clash(said[i], said[j]) and not clash(said[j], said[i])}
    assert {tuple(r) for r in stories.rare_word_pairs(df, "row_id", "titulo", "v", 700).collect()} == want and want


def test_equivalent_pairs_need_no_shared_word(spark):
    from difflib import SequenceMatcher

    told = "la junta aprobo ayer un plan de cinco puntos que ordena el trafico pesado y limita las obras nocturnas en el centro historico"
    rows = [(1, "Zorros cruzan montes", told), (2, "Bahia quieta", told.replace("ayer", "anoche")), (3, "Hoy mismo", "x"), (4, "Hoy mismos", ""), (5, "", ""), (6, "", None), (7, "Hoy mismo", "x")]
    rng = random.Random(3)
    words = "kilo jazz queso hielo faro viga buho".split()
    for k in range(8, 60):  # texts above and below the length from which difflib leaves out frequent characters
        rows.append((k, " ".join(rng.choices(words, k=5)), " ".join(rng.choices(words, k=rng.choice([4, 30, 50])))))
    rows += [(60 + k, "Repetido siempre", "") for k in range(120)]
    df = spark.createDataFrame(rows, "row_id bigint, titulo string, resumen_aclaracion string")
    out = {(r.i, r.j) for r in tone.equivalent_pairs(df, block=20).collect()}
    assert {(1, 2), (3, 4), (3, 7)} <= out and (5, 6) not in out and sum(i >= 60 for i, _ in out) == 120 * 119 // 2

    def alike(a, b):
        (ta, sa), (tb, sb) = ((t.lower(), (s or "")[:320].strip()) for _, t, s in (a, b))
        t, s = (SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in ((ta, tb), (sa, sb)))
        wa, wb = ({w for w in f"{t} {s}".split() if len(w) >= 4} for t, s in ((ta, sa), (tb, sb)))
        ov = len(wa & wb) / min(len(wa), len(wb)) if wa and wb else 0.0
        return t >= 0.80 or s >= 0.78 or (t >= 0.62 and s >= 0.58) or (ov >= 0.5 and (t >= 0.55 or s >= 0.55))

    made = [r for r in rows if 8 <= r[0] < 60]
    assert {p for p in out if 8 <= p[0] and p[1] < 60} == {(a[0], b[0]) for k, a in enumerate(made) for b in made[k + 1 :] if alike(a, b)}


@pytest.mark.parametrize("seed", [1, 2])
def test_tones_spread_as_over_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(200)]
    rows = [(k, " ".join(rng.choices(words, k=6)), " ".join(rng.choices(words, k=5)), rng.choice(["Neutro"] * 6 + ["Positivo", "Negativo", None, "N/A"])) for k in range(90)]
    rows += [(100 + k, t[: rng.choice([30, 40, 60])], s[rng.choice([0, 5, 20]) :], rng.choice(["Neutro", "Neutro", "Positivo"])) for k, (_, t, s, _) in enumerate(rows[:40:2] + rows[:40:3] + rows[:40:5])] + [(200, "", None, "Positivo"), (201, "", None, "Neutro")]
    df = spark.createDataFrame(rows, "row_id bigint, titulo string, resumen_aclaracion string, tono_ia string")
    want = {r.row_id: r.tono_ia for r in tone.propagate(df, graph.components(tone.equivalent_edges(df), "i", "j")).collect()}
    assert {r.row_id: r.tono_ia for r in tone.propagate_tone(df).collect()} == want
    told = dict((r[0], r[3]) for r in rows)
    assert any(told[k] != t for k, t in want.items()) and any(t == "Neutro" for t in want.values())


def test_rows_that_no_pole_reaches_are_not_compared(spark, monkeypatch):
    met = []
    for name in ("meetings", "crossings"):
        monkeypatch.setattr(tone, name, lambda one, *a, real=getattr(alike, name), name=name, **k: met.append((name, one.count())) or real(one, *a, **k))
    rows = [(k, f"Titular {k * 7919} sobre {chr(97 + k % 26) * 9}", f"{chr(97 + k % 26) * 40} {k}", "Neutro") for k in range(30)]
    df = spark.createDataFrame(rows, "row_id bigint, titulo string, resumen_aclaracion string, tono_ia string")
    assert {r.tono_ia for r in tone.propagate_tone(df).collect()} == {"Neutro"} and not met
    out = {r.row_id: r.tono_ia for r in tone.propagate_tone(df.withColumn("tono_ia", F.when(F.col("row_id") == 0, "Negativo").otherwise("Neutro"))).collect()}
    assert {k for k, t in out.items() if t == "Negativo"} == {0, 26} and max(n for _, n in met) == 1


def test_title_pairs_beyond_the_cap(spark):
    from difflib import SequenceMatcher

    base = "la empresa anuncio su nueva sede regional"
    rows = [(k, base + (" hoy" if k % 3 == 0 else "")) for k in range(150)] + [(200, "abc de fg hi jk lm no"), (201, "abc de fg hi jk lm ño"), (202, ""), (203, None)]
    df = spark.createDataFrame(rows, "row_id bigint, titulo string")
    out = {(r.i, r.j) for r in stories.title_pairs(df, block=1).collect()}
    text = {k: (t or "").replace("ñ", "n") for k, t in rows}
    assert out == {(i, j) for i in text for j in text if i < j and text[i] and text[j] and SequenceMatcher(None, text[i], text[j]).ratio() >= 0.92}
    groups = {r.id: r.grupo for r in graph.components(stories.subject_edges(df), "i", "j").collect()}
    assert {groups[k] for k in range(150)} == {0} and not {200, 201} & set(groups)  # no distinctive word in common


def test_titles_meet_only_within_reach(spark):
    """Pairs of brute force, whatever the blocks; texts whose lengths can't reach the ratio don't meet."""
    from difflib import SequenceMatcher

    rng = random.Random(5)
    base = ["".join(rng.choices("aeiou bcdñ7", k=n)) for n in (8, 9, 30, 31, 60, 61, 120, 230) for _ in range(4)]
    texts = sorted({x for t in base for x in (t, t[:-1] + "z", t[1:], t[: len(t) // 2] + "q" + t[len(t) // 2 :], t[::-1])} | {"x" * n for n in range(1, 40)})
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    reach = lambda a, b: SequenceMatcher(None, a, b).ratio() >= 0.92
    want = {(a, b) for a in range(len(texts)) for b in range(len(texts)) if a != b and reach(texts[a], texts[b])}
    for block in (None, 40):
        out = alike.ratio_pairs(df, 0.92, block).collect()
        assert {p for r in out for p, ok in (((r.a, r.b), r.ab), ((r.b, r.a), r.ba)) if ok} == want
    met, count = alike.length_blocks(df, 0.92, 20)
    blocks = met.select("_b").distinct().count()
    assert count < blocks * (blocks + 1) // 4


def test_bounds_of_long_texts_are_tight():
    """Never below the ratios of both orders; long texts of other words don't come near a ratio that counts."""
    from difflib import SequenceMatcher

    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghilmnopqrstuvz", weights=[12, 2, 4, 5, 13, 1, 1, 1, 7, 5, 3, 7, 9, 3, 1, 7, 8, 5, 4, 1, 1], k=rng.randint(2, 9))) for _ in range(900)]
    texts = [" ".join(rng.choices(words[:300] if k % 2 else words[300:], k=60))[: 290 + k] for k in range(12)]
    texts += [texts[0][:150] + texts[1][150:], texts[0][:-9], texts[2][:199], "e" * 310, "", "abc"]
    side, at = alike.Side(texts, 4, 4096), np.arange(len(texts))
    there, back = side.bounds(at, at)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if a and b:
                assert there[i, j] >= SequenceMatcher(None, a, b).ratio() and back[i, j] >= SequenceMatcher(None, b, a).ratio()
    assert max(there[i, j] for i in range(12) for j in range(12) if i % 2 != j % 2) < 0.55


def test_ratio_of_blocks_is_difflibs():
    from difflib import SequenceMatcher

    rng, ratio = random.Random(6), alike.Ratio()
    for _ in range(3000):
        a, b = ("".join(rng.choices("abc ñ"[: rng.randint(1, 5)], k=rng.choice([0, 1, 5, 20, 199, 201]) if rng.random() < 0.1 else rng.randint(0, 30))) for _ in "ab")
        assert ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_labels_without_a_common_word(spark):
    rows = [(1, "Deportes"), (2, "Deporte"), (3, "Deportes"), (4, "Sin tema"), (5, "Salud rural de montaña"), (6, "Rural salud"), (7, "Cultura"), (8, None), (9, "-")]
    df = spark.createDataFrame(rows, "row_id bigint, s string")
    out = {r.etiqueta: r.canonica for r in labeling.canonical_labels(df, "s").collect()}
    assert out["Deporte"] == out["Deportes"] == "Deportes" and out["Rural salud"] == out["Salud rural de montaña"] and out["Cultura"] == "Cultura" and len(out) == 7
    out = {r.etiqueta: r.mayor for r in labeling.merge_contained(df, "s").collect()}
    assert out["Deporte"] == "Deportes" and out["Rural salud"] == "Rural salud" and len(out) == 7


def test_contained_norms_have_no_cap(spark):
    norms = [(k, f"plan w{k}") for k in range(1200)] + [(2000, "plan w7 centro sur"), (2001, "plan")]
    out = labeling.contained_norms(spark.createDataFrame(norms, "k bigint, t string")).collect()
    assert [tuple(r) for r in out] == [(7, 2000)]


def test_word_pairs_of_a_word_in_many_rows(spark):
    words = spark.createDataFrame([(k, "puerto") for k in range(1100)] + [(5, "sur"), (2000, "sur"), (2001, "uno")], "id bigint, palabra string")
    out = stories.word_pairs(words, 1100)
    assert out.count() == 1100 * 1099 // 2 + 1 and out.where("i >= j").count() == 0
    assert {tuple(r) for r in stories.word_pairs(words, 1099).collect()} == {(5, 2000)}
    assert stories.rare_limit(20_000) == 600 and stories.rare_limit(10) == 2


def test_word_pairs_that_share_several_words_come_once_and_do_not_travel(spark):
    rng = np.random.default_rng(4)
    own = {k: {int(w) for w in rng.zipf(1.3, 12) if w < 600} for k in range(700)}
    out = stories.word_pairs(spark.createDataFrame([(k, f"w{w}") for k, ws in own.items() for w in ws], "id bigint, palabra string"), 700)
    rows = [tuple(r) for r in out.collect()]
    seen = {}
    for k, ws in own.items():
        for w in ws:
            seen.setdefault(w, []).append(k)
    assert len(seen) > stories.BIT_WORDS and max(map(len, seen.values())) > stories.WORD_BLOCK
    assert len(rows) == len(set(rows)) and set(rows) == {(i, j) for ids in seen.values() for i in ids for j in ids if i < j}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join ")]  # the pairs leave the join as they are


def test_blocks_that_travel_in_waves_give_the_same_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=3)]) for k in range(60)], "k bigint, v array<double>")
    left, right = df.where("k < 20"), df.where("k >= 20")
    queries = left.select(F.col("k").alias("q"), F.lit(25).cast("bigint").alias("k0"), F.lit(0.2).alias("piso"), "v")
    every = lambda: [sorted(tuple(sorted(r[:2])) for r in d.collect()) for d in (alike.vector_pairs(df, 0.6, 7), alike.vector_crossings(left, right, 0.6, 7), alike.best_matches(queries, right, 7))]
    whole = every()
    met = []
    monkeypatch.setattr(alike, "TRAVEL", 1)
    monkeypatch.setattr(alike.Scratch, "save", lambda self, d, real=alike.Scratch.save, **k: met.append(self.root) or real(self, d, **k))
    assert every() == whole and all(whole) and sum("/waves-" in r for r in met) == 9 + 6 + 6


def test_postings_travel_once_and_leave_nothing_behind(spark, monkeypatch):
    from noticiario import session

    monkeypatch.setattr(session, "LONG", 0, raising=False)
    disk = lambda: sum(f.getName().startswith("shuffle_") for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = disk()
    scratch = session.Scratch(spark, "left")
    scratch.save(spark.range(1000).repartition(7, "id"))
    scratch.save(spark.range(10))  # Spark itself refers to its last statement
    for _ in range(100):
        if disk() <= before:
            break
        time.sleep(0.1)  # files are removed in the background
    assert disk() <= before
    words = spark.createDataFrame([(k, f"w{k % 3}") for k in range(90)] + [(k, f"v{k % 5}") for k in range(90)], "id bigint, palabra string")
    out = stories.word_pairs(words, 90)
    assert out.count() == sum(k % 3 == m % 3 or k % 5 == m % 5 for k in range(90) for m in range(k))
    assert len(out.collect()) and "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_rare_pairs_keep_words_of_more_than_100_rows(spark, tmp_path):
    from noticiario.plans.catalog import QUERIES

    rows = [(k, "puerto" if k < 102 else "ab") for k in range(3500)]
    spark.createDataFrame(rows, "row_id bigint, titulo string").write.parquet(str(tmp_path / "informe.parquet"))
    assert QUERIES["rare_pairs"](spark, str(tmp_path)).count() == 102 * 101 // 2


def test_story_groups_lose_no_pair_at_words_of_many_rows(spark):
    """Every word is in more than 100 rows; groups are those of all pairs, one at a time, with and without vectors."""
    rng = np.random.default_rng(7)
    matters = ["Feria regional del libro abre puertas", "Feria regional del libro abre sus puertas", "Feria regional ganadera abre en mayo", "Concejo aprueba plan vial regional", "Concejo rechaza plan vial regional", "Concejo aprueba y rechaza plan vial regional", "Puente colgante regional inaugurado feria", "Feria", "Ya es", "", None]
    told = ["la gobernadora entrega obras del puente colgante", "la gobernadora entrega obras del puente antiguo", "aprueba el convenio", "rechaza el convenio", None]
    rows = []
    for k in range(1500):
        t, s = matters[int(rng.integers(len(matters)))], told[int(rng.integers(len(told)))]
        v = None if k % 11 == 0 else [float(x) for x in np.eye(3)[k % 3] + 0.3 * (k % 2)]
        rows.append((k, t, s, v))
    df = spark.createDataFrame(rows, "row_id bigint, titulo string, resumen_aclaracion string, v array<double>")
    w = {r.row_id: r for r in df.select("row_id", title_norm(F.col("titulo")).alias("t"), distinctive(title_norm(F.col("titulo"))).alias("w"), distinctive(embedding_text(F.col("titulo"), F.col("resumen_aclaracion"))).alias("w4"), conflict_bits(distinctive(embedding_text(F.col("titulo"), F.col("resumen_aclaracion")), 3)).alias("bits")).collect()}
    seen = Counter(x for r in w.values() for x in r.w)
    assert min(seen.values()) > 100
    one = lambda b: sum(1 << k for k in range(0, 30, 2) if b >> k & 1)
    two = lambda b: sum(1 << k for k in range(0, 30, 2) if b >> k & 2)
    near = cache(lambda a, b: SequenceMatcher(None, a, b).ratio() >= 0.92)
    cos = cache(lambda x, y: np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    for vector in (None, "v"):
        root = list(range(len(rows)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in combinations(range(len(rows)), 2):
            a, b, x, y = w[i], w[j], rows[i][3], rows[j][3]
            if not set(a.w) & set(b.w) or one(a.bits) & two(b.bits) or two(a.bits) & one(b.bits):
                continue
            close = vector and x and y and cos(tuple(x), tuple(y)) >= 0.94 and len(set(a.w4) & set(b.w4)) / min(len(a.w4), len(b.w4)) >= 0.45
            if near(a.t, b.t) or close:
                root[find(j)] = find(i)
        want = {}
        for k in range(len(rows)):
            want.setdefault(find(k), set()).add(k)
        out = {}
        for r in stories.story_groups(df, vector=vector).collect():
            out.setdefault(r.grupo_noticia, set()).add(r.row_id)
        assert sorted(map(sorted, out.values())) == sorted(map(sorted, want.values()))


def brute_clusters(s, threshold, linkage):
    """One pair at a time."""
    groups = [[i] for i in range(len(s))]
    join = np.mean if linkage == "average" else np.min
    while len(groups) > 1:
        best, i, j = max((join([s[x, y] for x in a for y in b]), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if not best > threshold:
            break
        groups[-i] += groups.pop(-j)
    return sorted(sorted(g) for g in groups)


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_agglomerate_is_one_pair_at_a_time(linkage):
    rng = np.random.default_rng(4)
    for _ in range(20):
        m = rng.normal(size=(25, 4))
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        label = agglomerate(m @ m.T, 0.55, linkage)
        assert sorted(np.flatnonzero(label == c).tolist() for c in np.unique(label)) == brute_clusters(m @ m.T, 0.55, linkage)


def vectors_of(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(m)], "k bigint, v array<double>")


def test_vector_operators_in_blocks(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(60, 3))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    df = vectors_of(spark, m)
    for block in (1000, 7):
        found = {(r.a, r.b) if r.a < r.b else (r.b, r.a) for r in alike.vector_pairs(df, 0.8, block).collect()}
        assert found == {(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.8}
        clusters = {}
        for r in alike.average_clusters(df, 0.7, block=block).collect():
            clusters.setdefault(r.cluster, []).append(r.k)
        assert sorted(map(sorted, clusters.values())) == brute_clusters(s, 0.7, "average") and all(k == min(v) for k, v in clusters.items())
        queries = df.where("k < 20").selectExpr("k as q", "k as k0", "0.5D as piso", "v")
        best = {r.q: r.k for r in alike.best_matches(queries, df, block).collect()}
        want = {}
        for i in range(20):
            j = max((x for x in range(60) if x != i), key=lambda x: (round(s[i, x], 9), -x))
            if s[i, j] > 0.5:
                want[i] = j
        assert best == want


def test_long_vectors_meet_by_few_columns_first(spark):
    """Many words, few rows close: hardly any pair is left for the whole product, and none is lost; with all close, none either."""
    rng = np.random.default_rng(4)
    for spread in (1.0, 0.01):
        m = rng.normal(size=(300, 160)) * spread * (1.0 / np.arange(1, 161)) ** 0.5 + (spread < 1)
        m[150:200] = m[:50] + rng.normal(size=(50, 160)) * 0.05 * spread
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        near = {(i, j) for i in range(300) for j in range(i + 1, 300) if u[i] @ u[j] >= 0.9}
        products = alike.Products(list(m), 0.9)
        assert products.bounds.shape == (300, alike.FIRST + 1) and set(zip(*(x.tolist() for x in products.reach(np.arange(300), np.arange(300), True)))) == near
        df = vectors_of(spark, m)
        both = lambda out: {(min(r.a, r.b), max(r.a, r.b)) for r in out.collect()}
        assert both(alike.vector_pairs(df, 0.9, 70)) == near
        assert both(alike.vector_crossings(df.where("k < 100"), df.where("k >= 100"), 0.9, 70)) == {(i, j) for i, j in near if i < 100 <= j}
    hit = rng.random((37, 53)) < 0.1
    assert [x.tolist() for x in alike.true_at(hit)] == [x.tolist() for x in np.nonzero(hit)]


def test_clusters_that_no_pair_connects_need_no_rounds(spark, monkeypatch):
    met = []
    monkeypatch.setattr(alike, "meetings", lambda *a, real=alike.meetings, **k: met.append(1) or real(*a, **k))
    rng = np.random.default_rng(5)
    m = np.concatenate([np.eye(12)[k] + rng.normal(size=(5, 12)) * 0.08 for k in range(12)] + [np.eye(12)[:1] * 0.5 - np.eye(12)[1:2]])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = vectors_of(spark, m)
    clusters = {}
    for r in alike.average_clusters(df, 0.93, block=7).collect():
        clusters.setdefault(r.cluster, []).append(r.k)
    assert sorted(map(sorted, clusters.values())) == brute_clusters(u @ u.T, 0.93, "average") and len(met) == 1
    # one part of many, and pairs above the threshold in it: as many links as connect
    links = alike.vector_links(df, 0.5, 7).collect()
    assert len({tuple(r) for r in links}) == len(links) and {g for _, g in graph.components(alike.vector_links(df, 0.5, 1000), "a", "b").collect()} == {g for _, g in graph.components(alike.vector_pairs(df, 0.5), "a", "b").collect()}
    parts = brute_components([(i, j) for i in range(len(u)) for j in range(i) if u[i] @ u[j] >= 0.5])
    assert alike.vector_links(df, 0.5, 1000).count() == len(parts) - len(set(parts.values()))


def test_leaders_and_replay_in_rounds(spark):
    rng = random.Random(9)
    for size, many in ((30, 60), (200, 150)):
        pairs = sorted({tuple(sorted(rng.sample(range(size), 2))) for _ in range(many)} | {(i, i + 1) for i in range(300, 330)})
        df = spark.createDataFrame(pairs, "a bigint, b bigint")
        one, rounds = ({r.id: r.lider for r in stories.leaders(df, few).collect()} for few in (10**6, 0))
        leader = {}
        for i in sorted({x for p in pairs for x in p}):
            if i not in leader:
                leader.update({i: i} | {b: i for a, b in pairs if a == i and b not in leader})
        assert one == rounds == leader
        losers = [(a, b, rng.choice([a, b])) for a, b in pairs]
        ldf = spark.createDataFrame(losers, "a bigint, b bigint, k bigint")
        out = {}
        for a, b, k in losers:
            if a not in out and b not in out:
                out[k] = a if k == b else b
        for few in (10**6, 0):
            assert {r.k: r.otra for r in U.replay(ldf, few).collect()} == out


def test_one_outlet_holds_all_titles(spark):
    """All rows in one group, blocks of a few titles: the pairs of brute force."""
    rng = random.Random(2)
    base = ["".join(rng.choices("abcdefgh ", k=30)).strip() for _ in range(30)]
    titles = base + [t[:-1] + "z" for t in base[:15]]
    df = spark.createDataFrame([("g", i, i, t) for i, t in enumerate(titles)], "grupo string, k bigint, o bigint, t string")
    want = {(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if ratio_of(titles[i], titles[j]) >= 0.92}
    assert {(r.a, r.b) for r in U.similar_titles(df, block=6).collect()} == want and want


def test_reassign(spark):
    rows = [(i, "a", [1.0, 0.01 * i]) for i in range(8)] + [(10 + i, "b", [0.01 * i, 1.0]) for i in range(8)] + [(30, "a", [0.05, 1.0]), (31, "a", [-1.0, -1.0]), (32, "a", None)]
    df = spark.createDataFrame(rows, "row_id bigint, g string, v array<double>")
    out = {r.row_id: r.g_nueva for r in stories.reassign(df, "g", "row_id", "v").collect()}
    assert out == {30: "b", 31: None}
    assert stories.reassign(df.limit(0), "g", "row_id", "v").count() == 0
