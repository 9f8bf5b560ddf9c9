"""Multi-party perspective rotation, in DataFrame expressions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant
and all others as named users; the mask covers what the assistant says, its end marker included.
Roles in ``context_roles`` are no participants: their turns stay system messages in every rendering.

A conversation is cut into segments of ``SEGMENT`` turn numbers, one row each, so that no task ever
gathers a whole one; ``start_char`` places a segment in the whole rendering, which is the segments
joined in order. Conversations of fewer turns have one segment. Where segments start follows from
lengths alone, summed in two levels (within ``CHUNK`` segments, then over chunks): texts are shuffled
once, to their segment, and no running sum holds a whole long conversation.

Defined results: a null text is empty, a null role is ``unknown``, a null turn comes first; equal
turns are ordered by role, then text; repeated rows are rendered as often as they occur; the null
conversation is one of its own; conversations of context turns alone have no rendering; an empty table
gives none. ``<|`` in a text is written ``< |`` so that no text can forge a marker.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 64
CHUNK = 4096
CONTEXT_ROLES = ("system",)
OWN, CONTEXT, USER, END = "<|assistant|>\n", "<|system|>\n", ("<|user name=", "|>\n"), "<|end|>\n"


def _segment(turn: Column) -> Column:
    return F.coalesce(F.floor(turn / SEGMENT), F.lit(-(1 << 40))).cast("long")


def _starts(turns: DataFrame, context: Column) -> DataFrame:
    """(conv, lost, segment, perspective, start_char) of every segment in every participant's rendering, from lengths."""
    place = ["conv", "lost", "segment"]
    as_other = F.when(context, F.lit(len(CONTEXT))).otherwise(F.length("speaker") + sum(map(len, USER)))
    said = turns.groupBy(*place, "speaker").agg(F.sum(F.length("said") + len(END)).alias("n"), F.count(F.lit(1)).alias("c"))
    said = said.withColumns({"n": F.col("n") + F.col("c") * as_other, "less": F.col("c") * (as_other - len(OWN))})
    segments = said.groupBy(*place).agg(F.sum("n").alias("n"))
    own = said.filter(~context).select(*place, F.col("speaker").alias("perspective"), "less")
    grid = segments.join(own.select("conv", "lost", "perspective").distinct(), ["conv", "lost"]).join(own, [*place, "perspective"], "left")
    grid = grid.select(*place, "perspective", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n"), F.floor(F.col("segment") / CHUNK).alias("chunk"))
    voice = ["conv", "lost", "perspective"]
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda window: F.coalesce(F.sum("n").over(window), F.lit(0)).cast("long")
    chunks = grid.groupBy(*voice, "chunk").agg(F.sum("n").alias("n")).select(*voice, "chunk", so_far(before(*voice).orderBy("chunk")).alias("base"))
    inside = grid.select(*place, "perspective", "chunk", so_far(before(*voice, "chunk").orderBy("segment")).alias("at"))
    return inside.join(chunks, [*voice, "chunk"]).select(*place, "perspective", (F.col("at") + F.col("base")).alias("start_char"))


def rotate(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """(conv_id, perspective, segment, start_char, rendered, mask): mask is an array of [start, end) spans within ``rendered``."""
    kind = conversations.schema[id_col].dataType
    turns = conversations.select(
        F.coalesce(F.col(id_col), F.lit("0").cast(kind)).alias("conv"),  # keys without nulls join by plain equality
        F.col(id_col).isNull().alias("lost"),
        _segment(F.col(turn_col)).alias("segment"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |")).alias("said"),
    )
    is_context = lambda c: c.isin(*context_roles) if context_roles else F.lit(False)
    starts = _starts(turns, is_context(F.col("speaker")))
    # A segment holds SEGMENT turn numbers: bounded however long the conversation is.
    parts = turns.groupBy("conv", "lost", "segment").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "said"))).alias("turns"))
    rows = parts.join(starts, ["conv", "lost", "segment"])

    def piece(t: Column) -> Column:
        own = t["speaker"] == F.col("perspective")
        head = F.when(own, F.lit(OWN)).when(is_context(t["speaker"]), F.lit(CONTEXT)).otherwise(F.concat(F.lit(USER[0]), t["speaker"], F.lit(USER[1])))
        return F.struct(own.alias("own"), F.length(head).alias("head"), F.concat(head, t["said"], F.lit(END)).alias("text"))

    rows = rows.withColumn("pieces", F.transform("turns", piece)).drop("turns")
    rows = rows.withColumn("rendered", F.array_join(F.transform("pieces", lambda p: p["text"]), ""))
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["text"])).alias("at"),
        F.when(p["own"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["head"]).alias("start"), (acc["at"] + F.length(p["text"])).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
    )
    zero = F.expr("struct(0 as at, cast(array() as array<struct<start:int,end:int>>) as spans)")
    rows = rows.withColumn("mask", F.aggregate("pieces", zero, step, lambda acc: acc["spans"]))
    return rows.select(F.when(~F.col("lost"), F.col("conv")).alias("conv_id"), "perspective", "segment", "start_char", "rendered", "mask")


ORACLE = f"""
with t as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker,
         replace(coalesce(text, ''), '<|', '< |') as said,
         cast(floor(turn / {SEGMENT}.0) as bigint) as segment
  from conversations),
p as (select distinct conv_id, speaker as perspective from t where speaker <> 'system'),
m as (
  select t.conv_id, perspective, segment, turn, speaker, said, speaker = perspective as own,
         case when speaker = perspective then '<|assistant|>' when speaker = 'system' then '<|system|>'
              else '<|user name=' || speaker || '|>' end || chr(10) as head
  from t join p on t.conv_id = p.conv_id),
s as (
  select *, head || said || '<|end|>' || chr(10) as piece,
         row_number() over (partition by conv_id, perspective order by turn, speaker, said) as n
  from m),
o as (
  select *, sum(length(piece)) over (partition by conv_id, perspective, segment order by n) - length(piece) as pos
  from s),
g as (
  select conv_id, perspective, segment, string_agg(piece, '' order by n) as rendered,
         coalesce(string_agg(cast(cast(pos + length(head) as bigint) as varchar) || '-' || cast(cast(pos + length(piece) as bigint) as varchar), ',' order by n) filter (own), '') as mask
  from o group by conv_id, perspective, segment)
select conv_id, perspective, segment,
       cast(coalesce(sum(length(rendered)) over (partition by conv_id, perspective order by segment rows between unbounded preceding and 1 preceding), 0) as bigint) as start_char,
       rendered, mask
from g
"""
