"""Reading and writing document tables."""
from __future__ import annotations

import uuid
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions import patterns as P

#: Strings that count as null in CSV input, as spreadsheet exports write them.
NULL_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
RAW_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("texto_ocr", T.StringType()), T.StructField("nombre", T.StringType()), T.StructField("clasificacion", T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, null_words: bool = True) -> DataFrame:
    """Quoted multi-line CSV with a header; a byte-order mark is dropped. Give a schema to spare the inference pass.

    Without ``null_words`` only fields that are blank without quotes are null: what ``write_csv`` writes comes back as it was.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
    if not null_words:  # the reader takes a text that equals its word for null as null, so the word is one that no text holds
        reader = reader.option("nullValue", f"null_{uuid.uuid4().hex}").option("emptyValue", "")
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    if null_words:
        df = df.withColumns({f.name: F.when(~F.col(f.name).isin(NULL_WORDS), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})
    return df


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.option("multiLine", not lines).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV, quoted where a text needs it, that keeps white space at the ends of texts; null is blank, the empty text a pair of quotes."""
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def json_array_parts(df: DataFrame) -> DataFrame:
    """One string per row of a JSON array document: the rows of ``df`` with the commas between them.

    Rows are written side by side; the brackets are rows of their own, first and last in order.
    """
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    numbered = rows.withColumn("n", F.monotonically_increasing_id())
    first = numbered.agg(F.min("n").alias("first"))
    body = numbered.join(F.broadcast(first)).select("n", F.concat(F.when(F.col("n") == F.col("first"), "").otherwise(","), "value").alias("value"))
    spark = df.sparkSession
    return spark.createDataFrame([(-1, "[")], "n long, value string").unionByName(body).unionByName(spark.createDataFrame([((1 << 63) - 1, "]")], "n long, value string"))


def write_json_array(df: DataFrame, path: str) -> None:
    """A folder whose part files, in order, are one JSON array."""
    json_array_parts(df).orderBy("n").select("value").write.text(path)


def write_report(row: DataFrame, path: str) -> None:
    """A one-row report as one JSON object."""
    row.limit(1).coalesce(1).write.option("ignoreNullFields", False).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files below a folder whose name fits; a missing folder gives none. The driver lists, as for any scan."""
    found, place = [], spark._jvm.org.apache.hadoop.fs.Path(path)
    if exists(spark, path):
        files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
        while files.hasNext():
            status = files.next()
            if fnmatch(status.getPath().getName(), pattern):
                found.append((status.getPath().toString(), status.getLen()))
    return spark.createDataFrame(found, "path string, length long")


def write_documents(df: DataFrame, path: str, name: str, text: str, most: int = 1000) -> None:
    """One file per document, ``path``/``name``: a sample for people, so more than ``most`` rows are refused."""
    spark = df.sparkSession
    rows = df.select(F.col(name).alias("n"), F.coalesce(F.col(text), F.lit("")).alias("t")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} documents; write_json_lines takes any number")
    for row in rows:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{row['n']}")
        out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
        try:
            out.write(bytearray(row["t"].encode()))
        finally:
            out.close()


def markdown_sample(df: DataFrame, per_class: int = 5, kind: str = "clasificacion", id_col: str = "id", text: str = "texto_markdown") -> DataFrame:
    """(archivo, contenido): ``per_class`` documents of each class by a seeded hash, as class_id.md."""
    from papyrine.operators.selection import stratified_sample

    picked = stratified_sample(df, kind, id_col, per_class)
    return picked.select(F.concat_ws("_", F.lower(kind), F.concat(F.col(id_col).cast("string"), F.lit(".md"))).alias("archivo"), F.col(text).alias("contenido"))


def reading_sample(df: DataFrame, kind: str = "clasificacion", text: str = "texto_ocr") -> DataFrame:
    """(archivo, contenido): the header that a reader sees above the raw text."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"))
    body = F.concat(line("TIPO", kind), line("ID", "id"), line("NOMBRE", "nombre"), line("CLASIFICACION", "clasificacion"), F.lit("\n" + "=" * 80 + "\n\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
    return df.select(F.concat(F.lower(kind), F.lit("_"), F.col("id").cast("string"), F.lit(".txt")).alias("archivo"), body.alias("contenido"))


def manual_template(spark: SparkSession) -> DataFrame:
    """The empty sheet for manual analysis."""
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in P.MANUAL_COLUMNS]))


def workbook_rows(review: DataFrame, group: str = "grupo_revision") -> DataFrame:
    """Review rows as a workbook shows them: a colour band per group, and whether the state is one of the list."""
    return review.withColumns({"banda": F.pmod(F.xxhash64(group), F.lit(2)) if dict(review.dtypes)[group] == "string" else F.pmod(F.col(group), F.lit(2)), "estado_valido": F.col("estado_revision").isin(P.REVIEW_STATES)})
