import pytest
from pyspark.sql import functions as F

from noticiario.functions import labels as T
from noticiario.functions.html import body_text, clean_text
from noticiario.functions.numeric import parse_numeric, whole_number
from noticiario.functions.ratio import ratio, ratio_at_least
from noticiario.functions.text import fold, strip


def values(spark, column, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_fold_and_strip(spark):
    assert values(spark, fold, ["ÑANDÚ Größe", "ø–…", None, ""]) == ["nandu grosse", "o-...", None, ""]
    assert values(spark, strip, [" \t a\n ", None]) == ["a", None]


def test_keys(spark):
    texts = ["El País (Cali)", None, "", "  "]
    assert values(spark, T.key_norm, texts) == ["elpaiscali", "", "", ""]
    assert values(spark, T.mention_norm, texts) == ["el pais cali", "", "", ""]
    assert values(spark, T.label_norm, ["La educación de los Niños y la ley", None]) == ["educacion ninos ley", ""]


def test_title_norm(spark):
    texts = ["Sube el dólar | El País", "Sube el dólar - El-País", "Urgente: sube el dólar hoy", "Nota: corta", "a_b c", None, "Sube – El País | Cali"]
    assert values(spark, T.title_norm, texts) == ["sube el dolar", "sube el dolar el pais", "sube el dolar hoy", "nota corta", "a_b c", "", "sube el pais"]


def test_title_output_and_snippet(spark):
    assert values(spark, T.title_output, ["Sube el dólar | El País", "a | b.c", None]) == ["Sube el dólar", "a | b.c", None]
    assert values(spark, T.snippet, ["... y así <br>Sube  el\ndólar.", "Ya está...", "", "sin mayúscula", None]) == ["Sube el dólar...", "Ya está...", "", "sin mayúscula...", None]


@pytest.mark.parametrize("text,number", [("1.234", 1234.0), ("1,5", 1.5), ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1e3", 1000.0), ("0,123", 0.123), ("x", None), ("", None), (None, None), ("1.234.567", 1234567.0), ("inf", None), ("nan", None), ("1_000", None), ("1d", None), (" 7 ", 7.0), ("-3,5", -3.5)])
def test_parse_numeric(spark, text, number):
    assert values(spark, parse_numeric, [text]) == [number]


def test_whole_number(spark):
    texts = ["10.475.157", "10,806,724", "1.00000000E+07", "10000982.0", "00010002463", "1.5", "N/A", None]
    assert values(spark, lambda c: whole_number(strip(c), parse_numeric(c)), texts) == [10475157, 10806724, 10000000, 10000982, 10002463, None, None, None]


def test_url(spark):
    texts = ["https://www.A.com/x/", "http://a.com/x//", " a.com/x", "nan", None]
    assert values(spark, T.url_norm, texts) == ["a.com/x", "a.com/x", "a.com/x", "", ""]


def test_labels(spark):
    assert values(spark, T.is_complete, ["Plan de", "Plan de salud", "", None, "Plan y,"]) == [False, True, False, False, False]
    assert values(spark, T.trim_label, ["Plan de salud de la", "de la", "", None, "uno dos tres cuatro cinco seis siete ocho"]) == ["Plan de salud", "de", "Sin tema", "Sin tema", "uno dos tres cuatro cinco seis siete"]
    assert values(spark, T.clean_topic, ['"Tema: EDUCACION publica"', None]) == ["Educación pública", "Sin tema"]
    assert values(spark, T.valid_subtopic, ["Plan de salud", "Plan salud", "Lanza plan de salud", "Plan de hoy", "a b c d e", "Plan", None]) == [True, False, False, False, True, False, False]
    assert values(spark, T.valid_topic, ["Salud pública", "3 planes", "unos planes", "economía", None]) == [True, False, False, False, False]
    assert values(spark, T.file_name, ["Año / X", None]) == ["Ano_X", "marca"]


def test_conflict_and_overlap(spark):
    a, b = F.split(F.lit("alza precios"), " "), F.split(F.lit("baja precios"), " ")
    assert spark.range(1).select(T.action_conflict(a, b), T.overlap(a, b), T.overlap(a, F.array().cast("array<string>"))).first() == (True, 0.5, 0.0)


def test_markup(spark):
    assert values(spark, clean_text, ["&amp;oacute; &#xF3; &amp;#243; “x”", None]) == ['&oacute; ó ó "x"', None]
    assert values(spark, body_text, ["<p>a<br/>b</p>", "  ", None]) == ["a\nb", "  ", None]


def test_ratio_is_asymmetric(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(ratio("a", "b")).collect()] == [0.25, 0.5, 0.0]
    assert [r[0] for r in df.select(ratio_at_least("a", "b", 0.5)).collect()] == [False, True, False]
