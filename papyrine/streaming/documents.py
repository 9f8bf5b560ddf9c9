"""The row-local stages on a stream of documents: the same expressions, no state."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions.predicates import ocr_state
from papyrine.functions.text import clean_legal, clean_ocr
from papyrine.operators.resolve import process, summary


def read_documents(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def cleaned(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """State and both cleanings of every arriving document."""
    return stream.withColumns({"estado_texto_ocr": ocr_state(F.col(text_col)), "texto_limpio": clean_legal(F.col(text_col)), "texto_limpieza_avanzada": clean_ocr(F.col(text_col))})


def summaries(stream: DataFrame, text_col: str, **columns: str) -> DataFrame:
    """Extraction summaries of every arriving document."""
    return summary(process(stream, text_col, **columns))


def state_counts(stream: DataFrame, time_col: str, late: str = "1 hour", window: str = "10 minutes", text_col: str = "text") -> DataFrame:
    """Documents per state and time window; rows later than the watermark are left out."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), ocr_state(F.col(text_col)).alias("estado")).agg(F.count(F.lit(1)).alias("cantidad"))
