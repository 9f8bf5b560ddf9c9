"""The ten registered queries: each applies its operator, with production parameters, to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.common import fold, materialise, table, texts
from papyrine.session import scratch


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyrine.llm import sentencepiece_codec as codec

    docs = texts(spark, sf_dir).select("doc_id", "text")
    return codec.encode_decode_digests(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 2) and rejected of every whole text."""
    from papyrine.llm import toxicity

    docs = texts(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "severity", toxicity.is_rejected(F.col("severity")).alias("rejected"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyrine.llm import quality

    docs = texts(spark, sf_dir).select("doc_id", "text")
    described = materialise(quality.describe(docs).select("doc_id", "stats"), "quality")
    held = fold("doc_id", 3) == 1
    model = quality.fit(described.filter(~held), table(spark, sf_dir, "labels"))
    found = quality.score(described, model)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyrine.llm import ann

    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyrine.llm import warc

    path = scratch(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    found = warc.read_archive(spark, path)
    # What the rebuilt bytes say: the payload's size and digest are taken from it, not from the header.
    digest = warc.base32_of_hex(F.upper(F.sha1("payload")))
    return found.select(F.col("id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyrine.llm import langid

    docs = texts(spark, sf_dir).select("doc_id", "text", "lang")
    held = fold("doc_id", 5) == 0
    model = langid.fit(docs.filter(~held))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyrine.llm import suffix_dedup

    return suffix_dedup.deduplicate(texts(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyrine.llm import simhash

    found = simhash.components(texts(spark, sf_dir), words=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, perspective, segment, start_char, rendered and mask ("start-end" spans, comma-joined)."""
    from papyrine.llm import chat

    found = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return found.withColumn("mask", F.array_join(spans, ","))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyrine.llm import decontaminate

    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


OP5_SQL = """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as d from pages),
g as (select *, max(page_id) over (partition by h) as head from p)
select page_id, cast(strlen(h) as bigint) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + cast((cast(('0x' || substr(d, cast(5 * (i // 4) as int) + 1, 5)) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31 as int), 1)), '') as payload_digest,
       case when page_id = head then 'response' else 'revisit' end as record_type,
       case when page_id <> head then head end as refers_to
from g
"""


def oracle_sql() -> dict[str, str]:
    from papyrine.llm import chat, decontaminate

    return {"op5_warc": OP5_SQL, "op7_chat": chat.ORACLE, "op10_decontaminate": decontaminate.oracle()}
