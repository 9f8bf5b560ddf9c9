"""Sources, sinks, streams and schema guards."""
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from papyrine.operators import profile
from papyrine.sources import io
from papyrine.streaming import documents as stream


def test_csv_keeps_every_text(spark, tmp_path):
    texts = [" lead", "trail ", "", None, "NA", "null", "\n", "\t", "\r", "a\r\nb", 'q"uo"te', '"', '""', "\\", 'a\\"b', "a,b", "\ufeffx", "\x00z", "#x", "é€😀"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    io.write_csv(df, str(tmp_path / "out"))
    assert {r.id: r.t for r in io.read_csv(spark, str(tmp_path / "out"), df.schema, null_words=False).collect()} == dict(enumerate(texts))


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes('﻿id,texto_ocr,nombre,clasificacion\n1,"uno\ndos ""x""",NA,Oficio\n2,,b,Embargo\n'.encode())
    df = io.read_csv(spark, str(tmp_path / "in.csv"), io.RAW_SCHEMA)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'uno\ndos "x"', None, "Oficio"), (2, None, "b", "Embargo")]
    io.write_csv(df, str(tmp_path / "out"))
    back = io.read_csv(spark, str(tmp_path / "out"), io.RAW_SCHEMA)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_missing_input(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        io.read_json(spark, str(tmp_path / "none.json")).count()


@pytest.mark.parametrize("n", [0, 1, 5])
def test_json_array(spark, tmp_path, n):
    df = spark.range(n).select("id", F.lit("ñ").alias("t"), F.lit(None).cast("string").alias("z"))
    io.write_json_array(df, str(tmp_path / "a"))
    text = "".join(p.read_text() for p in sorted(Path(tmp_path / "a").glob("part-*")))
    assert sorted(r["id"] for r in json.loads(text)) == list(range(n))


def test_json_lines_and_documents(spark, tmp_path):
    df = spark.createDataFrame([("a", "x\ny"), ("b", None)], "n string, t string")
    io.write_json_lines(df, str(tmp_path / "l"))
    assert io.read_json(spark, str(tmp_path / "l"), lines=True).count() == 2
    io.write_documents(df, str(tmp_path / "d"), "n", "t")
    assert (tmp_path / "d" / "a").read_text() == "x\ny" and (tmp_path / "d" / "b").read_text() == ""
    with pytest.raises(ValueError, match="more than"):
        io.write_documents(df, str(tmp_path / "e"), "n", "t", most=1)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in io.list_files(spark, str(tmp_path / "d")).collect()) == ["a", "b"]
    assert io.list_files(spark, str(tmp_path / "none")).count() == 0 and not io.exists(spark, str(tmp_path / "none"))


def test_workbook(spark, tmp_path):
    """The parts of the file, read back as XML."""
    import xml.etree.ElementTree as ET
    import zipfile

    from papyrine.sources import workbook

    rows = spark.createDataFrame([("7", 1, "a < b & c", "pendiente"), ("7", 2, None, "pendiente"), ("9", 1, "ñ\x00", "bien")], "grupo_revision string, entidad_n int, valor string, estado_revision string")
    summary = spark.createDataFrame([("7", True, 0.5), ("9", False, None)], "id string, revision_manual boolean, confianza double")
    path = str(tmp_path / "r.xlsx")
    workbook.write_workbook(workbook.review_sheets(rows, summary), path)
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as book:
        names = [s.get("name") for s in ET.fromstring(book.read("xl/workbook.xml")).iterfind(".//m:sheet", ns)]
        sheet = ET.fromstring(book.read("xl/worksheets/sheet1.xml"))
        small = ET.fromstring(book.read("xl/worksheets/sheet2.xml"))
        styles = ET.fromstring(book.read("xl/styles.xml"))
        assert all(ET.fromstring(book.read(n)) is not None for n in book.namelist())
    assert names == ["entidades", "para_revisar", "resumen"]
    cells = [[c.findtext(".//m:t", None, ns) or c.findtext("m:v", None, ns) for c in r] for r in sheet.iterfind(".//m:row", ns)]
    assert cells == [["grupo_revision", "entidad_n", "valor", "estado_revision"], ["7", "1", "a < b & c", "pendiente"], ["7", "2", None, "pendiente"], ["9", "1", "ñ", "bien"]]
    bands = [r[0].get("s") for r in sheet.iterfind(".//m:row", ns)]
    assert bands == ["1", "4", "4", "6"] and len(styles.findall(".//m:cellXfs/m:xf", ns)) == 7
    assert sheet.find(".//m:pane", ns).get("ySplit") == "1" and sheet.find("m:autoFilter", ns).get("ref") == "A1:D4"
    assert sheet.find(".//m:dataValidation", ns).get("sqref") == "D2:D4" and sheet.findall(".//m:col", ns)[2].get("width") == "40"
    assert len(small.findall(".//m:row", ns)) == 2
    with pytest.raises(ValueError, match="more than"):
        workbook.write_workbook({"x": rows}, path, most=2)


def test_template(spark):
    t = io.manual_template(spark)
    assert len(t.columns) == 16 and t.count() == 0


def test_text_column_choice(spark):
    df = spark.createDataFrame([("aaa", "b", 1)], "x string, y string, z int")
    assert profile.find_text_column(df) == "x"
    assert profile.find_text_column(df.withColumn("texto_ocr", F.lit(""))) == "texto_ocr"
    with pytest.raises(ValueError):
        profile.find_text_column(df, "rich")
    with pytest.raises(ValueError):
        profile.require_columns(df, ["x", "q"])


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["El embarg0 por $ 10.000,50", "", None, "DNI 20111222 " * 10])]
    df = spark.createDataFrame(rows, "id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    src = stream.cleaned(stream.read_documents(spark, str(tmp_path / "in"), df.schema))
    q = src.writeStream.format("memory").queryName("cleaned_docs").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("cleaned_docs").collect()), key=str)
    assert got == sorted(map(tuple, stream.cleaned(df).collect()), key=str)


def test_stream_counts_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "corto", "x" * 200, "y" * 300])], "id long, text string")
    df = df.withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("id") * 400))
    df.write.parquet(str(tmp_path / "in"))
    src = stream.state_counts(stream.read_documents(spark, str(tmp_path / "in"), df.schema), "ts")
    q = src.writeStream.format("memory").queryName("state_counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    shown = lambda d: sorted(map(str, d.select("window.start", "estado", "cantidad").collect()))
    assert shown(spark.table("state_counts")) == shown(stream.state_counts(df, "ts")) and spark.table("state_counts").agg(F.sum("cantidad")).first()[0] == 5


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, b int")
    assert profile.null_report(df).count() == 2
    assert profile.text_columns(df).count() == 0
    assert profile.duplicate_counts(df, {"a": ["a"]}).first()["duplicados"] == 0
