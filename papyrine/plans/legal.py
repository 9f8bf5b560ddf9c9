"""Synthetic legal texts out of the order tables: what the extraction queries run on.

One expression serves both engines, so both read the same texts.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(key: str, words: list[str]) -> str:
    return f"(case {key} % {len(words)} " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(words)) + " end)"


_FIRST = _pick("o_orderkey", ["JUAN", "MARIA", "DIEGO", "LAURA", "PEDRO", "SOFIA", "RAMON", "ELENA"])
_SECOND = _pick("o_orderkey", ["CARLOS", "FERNANDA", "FABIAN", "BEATRIZ", "OSCAR", "LUCIA", "ALBERTO"])
_LAST = _pick("(o_orderkey + o_custkey)", ["PEREZ", "GOMEZ", "FRETES", "BRAVO", "ARIAS", "MAZA", "SOSA", "RUIZ", "VEGA"])
NAME = f"({_FIRST} || ' ' || {_SECOND} || ' ' || {_LAST})"
DNI = "lpad(cast(20000000 + (o_custkey * 7919) % 9999999 as string), 8, '0')"
DNI_TEXT = f"(case when o_orderkey % 3 = 0 then substr({DNI}, 1, 2) || '.' || substr({DNI}, 3, 3) || '.' || substr({DNI}, 6, 3) else {DNI} end)"
ACCOUNT = "lpad(cast(o_orderkey * 1000003 as string), 22, '2907')"


def _money(cents: str) -> str:
    whole = f"cast(floor({cents} / 100.0) as bigint)"
    return (
        f"((case when {whole} >= 1000 then cast(cast(floor({whole} / 1000.0) as bigint) as string) || '.' || lpad(cast({whole} % 1000 as string), 3, '0')"
        f" else cast({whole} as string) end) || ',' || lpad(cast({cents} % 100 as string), 2, '0'))"
    )


_CENTS = "cast(round(o_totalprice * 100) as bigint)"
_COSTS = f"cast(floor({_CENTS} / 5.0) as bigint)"
_NL = "chr(10)"
TEXT = f"""(
  'JUZGADO CIVIL NRO ' || cast(o_orderkey % 20 + 1 as string) || {_NL}
  || 'Expte. Nro ' || cast(o_orderkey as string) || '/' || cast(2000 + o_orderkey % 24 as string) || {_NL}
  || 'Autos: BANCO ' || n_name || ' S.A. c/ ' || {NAME} || ' s/ cobro ejecutivo' || {_NL}
  || (case when o_orderkey % 6 = 0 then '|||| |||' || {_NL} || '-----' || {_NL} || '~~~~  ~~~~' || {_NL} || {_NL} || {_NL} else '' end)
  || 'Se ha decretado el embargo sobre los fondos que posea el Sr. ' || {NAME} || ', DNI ' || {DNI_TEXT}
  || (case when o_orderkey % 2 = 0 then ', CUIL 20-' || {DNI} || '-' || cast(o_orderkey % 10 as string) else '' end)
  || ', hasta cubrir la suma de $ ' || {_money(_CENTS)} || ' con mas la suma de $ ' || {_money(_COSTS)} || ' en concepto de intereses y costas.' || {_NL}
  || (case when o_orderkey % 4 <> 3 then 'Debera depositar en el Banco ' || n_name || ', Sucursal Centro, ' || (case when o_orderkey % 8 = 1 then 'CVU ' else 'CBU ' end) || {ACCOUNT} || ' a nombre de autos.' else '' end)
  || (case when o_orderkey % 5 = 0 then ' Alias: pago.' || lower({_LAST}) || '.' || cast(o_orderkey % 97 as string) else '' end) || {_NL}
  || (case when o_orderkey % 7 = 0 then 'El embarg0   sera comunicado al juzgad0  , con copia del exped1ente .' || {_NL} else '' end)
  || 'Fecha ' || cast(1 + o_orderkey % 28 as string) || '/03/' || cast(2000 + o_orderkey % 24 as string) || '. Firmado: Dra. ANA GOMEZ, Secretaria.'
)"""
KIND = "(case when o_orderkey % 3 = 1 then 'Oficio' else 'Embargo' end)"
FILE = "('doc_' || cast(o_orderkey as string))"
CTE = f"""legal as (
  select o_orderkey as id, {FILE} as nombre, {KIND} as clasificacion, {TEXT} as texto
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer input partitions than cores, dealt out: small files of one row group cannot be split otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Bytes of the order table behind one task. The texts take some fifty times as much, so a task stays short and small at any size.
SLICE = 2 << 20


def parts_of(table: DataFrame, size: int | None = None) -> int:
    """Tasks for what is built from the rows of a table: one for so many bytes of its files, as many as there are cores at least."""
    stored = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(table.sparkSession.sparkContext.defaultParallelism, stored // (size or SLICE))


def legal_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, nombre, clasificacion, texto), one per order. Customer and nation are dimension tables; the planner picks the join.

    The few columns that make a text are dealt out before it is made: by all of them, which sorts nothing.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = read("orders")
    joined = orders.join(read("customer"), F.expr("o_custkey = c_custkey")).join(read("nation"), F.expr("c_nationkey = n_nationkey"))
    dealt = joined.select("o_orderkey", "o_custkey", "o_totalprice", "n_name").repartition(parts_of(orders), "o_orderkey", "o_custkey", "o_totalprice")
    return dealt.select(F.col("o_orderkey").alias("id"), F.expr(FILE).alias("nombre"), F.expr(KIND).alias("clasificacion"), F.expr(TEXT).alias("texto"))
