from pyspark.sql import functions as F

from noticiario.sources import sheets
from noticiario.sources.xlsx import XlsxSource, workbook


def test_workbook_round_trip(spark, tmp_path):
    data = [["Título", None, "Link"], ["a & <b>", 1.5, ("ver", "http://x/?a=1&b=2")], [None, None, None], ["c", 2, None]]
    (tmp_path / "one.xlsx").write_bytes(workbook(data))
    spark.dataSource.register(XlsxSource)
    df = spark.read.format("xlsx").option("links", "Link").load(str(tmp_path / "one.xlsx"))
    out = [tuple(r) for r in df.orderBy("row_id").select("row_id", "Título", "Link", "Link__url").collect()]
    assert out == [(1, "a & <b>", "ver", "http://x/?a=1&b=2"), (3, "c", None, None)]


def test_writer(spark, tmp_path):
    spark.dataSource.register(XlsxSource)
    df = spark.createDataFrame([(1, "x"), (2, None)], "n bigint, t string").coalesce(1)
    df.write.format("xlsx").mode("overwrite").save(str(tmp_path / "out"))
    back = spark.read.format("xlsx").load(str(tmp_path / "out"))
    assert [tuple(r) for r in back.orderBy("row_id").select("n", "t").collect()] == [("1", "x"), ("2", None)]


def test_headers(spark):
    assert sheets.text_column(["ID", "Titular", "Cuerpo"], sheets.TITLES) == 1
    assert sheets.text_column(["ID", "Mi Título largo"], sheets.TITLES) == 1
    assert sheets.text_column(["x", "y"], sheets.TITLES, 5) == 1
    df = spark.createDataFrame([(1, 2, 3)], "`Título` int, `Titulo` int, `Nro. Pagina` int")
    assert sheets.snake(df).columns == ["titulo", "titulo_1", "nro_pagina"]


def test_config(spark, tmp_path):
    (tmp_path / "m.csv").write_text("A ,1\n,2\na,3\nnan,4\nB,5\n")
    assert {r.clave: r.valor for r in sheets.read_config(spark, str(tmp_path / "m.csv")).collect()} == {"a": "3", "b": "5"}


def test_append(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "row_id int, c string"), spark.createDataFrame([(1, "q", "n")], "row_id int, c string, d string")
    assert sorted(map(tuple, sheets.append_columns(a, b).collect())) == [(1, "x", "n"), (2, "y", None)]
    assert sheets.preview(a, 1).collect()[0].row_id == 1


def test_stream(spark, tmp_path):
    from noticiario.streaming.ingest import first_links

    rows = [(1, "http://a/1", "M"), (2, "https://www.a/1/", "m"), (3, None, "M"), (4, None, "M")]
    df = spark.createDataFrame(rows, "row_id bigint, url_nota string, medio string").withColumn("cargado", F.timestamp_seconds(F.col("row_id") * 60))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = first_links(stream).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 3


def test_sinks_of_the_runs(spark, tmp_path):
    import zipfile

    from noticiario.plans import pipeline

    df = spark.createDataFrame([(1, "Lumbral gana premio", "Lumbral celebra.", "x"), (2, "Nada", None, "y")], "row_id bigint, titulo string, resumen_aclaracion string, tono_ia string").coalesce(1)
    path = pipeline.sentiment_sheet(df, "Lumbral S.A.", [], str(tmp_path))
    assert path.endswith("/sentimiento_Lumbral_S_A.xlsx")
    spark.dataSource.register(XlsxSource)
    back = {r["titulo"]: (r["tono_ia"], r["confianza_tono"], r["marca_encontrada"]) for r in spark.read.format("xlsx").load(path).collect()}
    assert back == {"Lumbral gana premio": ("Positivo", "Alta", "Sí"), "Nada": ("Neutro", "Alta", "No")}
    book = next((tmp_path / "sentimiento_Lumbral_S_A.xlsx").glob("*.xlsx"))
    assert 'name="Sentimiento"' in zipfile.ZipFile(book).read("xl/workbook.xml").decode()
    user = pipeline.sentiment(df, "Lumbral", [], models=pipeline.Models(user_tone=lambda texts: [-1] * len(texts)))
    assert {r.row_id: r.tono_ia for r in user.collect()} == {1: "Negativo", 2: "Neutro"}
