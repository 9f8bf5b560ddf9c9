"""Bounded, deterministic samples of labelled rows for fitting classifiers on the driver.

Defined results: rows with a null id or a null text hold no place of their own (a null text is a text, a
null id is in no table of labels); rows of equal id and text are one; ids that several texts share, and ids
labelled in two ways, teach nothing, as nothing tells which text was meant; ties of the salted hash go by
id; fewer rows than asked for give all; empty tables give none.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.common import row_key


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, values: list, per_value: int, salt: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text) of at most ``per_value`` labelled rows of each value, the smallest by a salted hash of the id.

    One scan of the texts: the ids, at most ``per_value * len(values)``, are broadcast to it.
    """
    order = F.xxhash64(F.lit(salt), F.col(id_col))
    clear = labels.filter(F.col(label).isin(values)).groupBy(id_col).agg(F.min(label).alias(label), F.max(label).alias("__other__"))
    clear = clear.filter(F.col(label) == F.col("__other__")).select(id_col, label)
    parts = [clear.filter(F.col(label) == v).orderBy(order, id_col).limit(per_value) for v in values]
    chosen = reduce(DataFrame.unionByName, parts)
    keyed = docs.select(F.col(id_col), F.col(text_col).alias("text"), *row_key(text_col, "__a__", "__b__"))
    found = keyed.join(F.broadcast(chosen), id_col).dropDuplicates([id_col, "__a__", "__b__"])
    alone = F.count(F.lit(1)).over(Window.partitionBy(id_col))
    return found.withColumn("__n__", alone).filter("__n__ = 1").select(id_col, label, "text")


def text_sample(docs: DataFrame, group: str, order: Column, per_group: int) -> DataFrame:
    """Rows of ``docs`` among the ``per_group`` smallest of their group by ``order``, a hash; a few more where hashes are equal.

    Two scans: only groups and hashes are ranked, one threshold a group is broadcast to the texts.
    """
    ranked = docs.select(group, order.alias("__h__"))
    ranked = ranked.withColumn("__r__", F.dense_rank().over(Window.partitionBy(group).orderBy("__h__"))).filter(F.col("__r__") <= per_group)
    limits = ranked.groupBy(F.col(group).alias("__g__")).agg(F.max("__h__").alias("__most__"))
    hashed = docs.withColumn("__h__", order)
    return hashed.join(F.broadcast(limits), (F.col(group) == F.col("__g__")) & (F.col("__h__") <= F.col("__most__"))).drop("__h__", "__g__", "__most__")
